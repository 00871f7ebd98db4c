"""Retrieval over documents, with benchmark items as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import corpus, index
from loomline.sources.tables import table

#: White space as the library reads it, for DuckDB.
WS = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sql_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word windows of documents: ord, doc_id, source, chunk_index, text. ord numbers chunks by document and place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    made = corpus.word_chunks(docs)
    return made.withColumn("ord", F.col("doc_id") * 100_000 + F.col("chunk_index"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("q"), "text")


SQL_CHUNKS = f"""
w AS (SELECT doc_id, source, {sql_words('text')} AS ws FROM documents),
chunks AS (SELECT doc_id, source, (i // 110)::INT AS chunk_index, array_to_string(ws[i + 1 : i + 140], ' ') AS text, doc_id * 100000 + i // 110 AS ord
  FROM (SELECT *, unnest(range(0, len(ws), 110)) AS i FROM w WHERE len(ws) > 0))"""

SQL_INDEX = f"""
toks AS (SELECT ord, {sql_tokens('text')} AS t FROM chunks),
tf AS (SELECT ord, term, count(*) AS tf, max(dl) AS dl FROM (SELECT ord, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ord, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM toks),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT item_id AS q, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY q, term),
sc AS (SELECT q, ord, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) * qtf), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY q, ord),
base AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, ord DESC) AS rank FROM sc WHERE score > 0)"""


def word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", "chunk_index", "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25_topk(chunks(spark, sf_dir), questions(spark, sf_dir), 8).select("q", "ord", "score", "rank")


def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = index.postings(chunks(spark, sf_dir))
    stats = index.statistics(chunks(spark, sf_dir))
    return index.document_frequency(terms).crossJoin(F.broadcast(stats)).select("term", "df", F.round(index.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


def bm25_page_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are sources, each of its first 8 chunks."""
    groups = index.group_documents(chunks(spark, sf_dir), "source")
    return index.bm25_topk(groups, questions(spark, sf_dir), 48).select("q", F.col("ord").alias("source"), "score", "rank")


SQL_PAGES = f"""
ptok AS (SELECT source, {sql_tokens('text')} AS t FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ord) AS n FROM chunks) WHERE n <= 8),
pdl AS (SELECT source, sum(len(t)) AS dl FROM ptok GROUP BY source),
ptf AS (SELECT source, term, count(*) AS tf FROM (SELECT source, unnest(t) AS term FROM ptok) GROUP BY ALL),
pdf AS (SELECT term, count(*) AS df FROM ptf GROUP BY term),
pst AS (SELECT count(*) AS n_docs, avg(dl) AS avg_len FROM pdl),
psc AS (SELECT q, source, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) * qtf), 6) AS score
  FROM qt JOIN ptf USING (term) JOIN pdf USING (term) JOIN pdl USING (source), pst GROUP BY q, source),
pages_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, source DESC) AS rank FROM psc WHERE score > 0) WHERE rank <= 48)"""

QUERIES = {
    "word_chunks": (word_chunks, f"WITH {SQL_CHUNKS} SELECT doc_id, chunk_index, text FROM chunks"),
    "bm25_topk": (bm25_topk, f"WITH {SQL_CHUNKS}, {SQL_INDEX} SELECT q, ord, score, rank::INT AS rank FROM base WHERE rank <= 8"),
    "document_frequency_idf": (document_frequencies, f"WITH {SQL_CHUNKS}, {SQL_INDEX} SELECT term, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st"),
    "bm25_page_topk": (bm25_page_topk, f"WITH {SQL_CHUNKS}, {SQL_INDEX}, {SQL_PAGES} SELECT q, source, score, rank::INT AS rank FROM pages_top"),
}
