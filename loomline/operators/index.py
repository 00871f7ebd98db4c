"""Lexical index in tidy tables: postings (ord, term, tf, dl) and one row of corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import text as X
from loomline.functions import urls as U
from loomline.operators import blocks

#: Query terms sent to every task at most; more are joined.
BROADCAST_TERMS = 500_000
K1, B = 1.5, 0.75


def retrieval_text(url: Column, title: Column, text: Column, legacy_label: str = "www2", home_labels: tuple[str, ...] = ()) -> Column:
    """Title twice, words of host and path, what the path stands for, text."""
    return X.collapse(F.concat_ws(" ", title, title, U.host_terms(url, legacy_label, home_labels), U.path_terms(url), U.features(url), text))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """n_docs and avg_len, in one row."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg(F.regexp_count(F.lower(F.col(text)), F.lit("[a-z0-9]+"))).alias("avg_len"))


def checked_broadcast(frame: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """The frame, sent to every task if it has no more rows than the limit."""
    return F.broadcast(frame) if frame.limit(limit + 1).count() <= limit else frame


def postings(docs: DataFrame, text: str = "text", order: str = "ord", vocabulary: DataFrame | None = None) -> DataFrame:
    """(ord, term, tf, dl); with a vocabulary (term) only of its terms, so that nothing else is shuffled."""
    made = docs.select(F.col(order).alias("ord"), X.tokens(F.col(text)).alias("t"))
    # the outer form, so that no filter computes the tokens once more; semi join and grouping drop its nulls
    exploded = made.select("ord", F.size("t").alias("dl"), F.explode_outer("t").alias("term")).where("term is not null")
    if vocabulary is not None:
        exploded = exploded.join(checked_broadcast(vocabulary), "term", "left_semi")
    # dealt by document, so that whoever adds up postings of one needs no other shuffle
    return exploded.repartition("ord").groupBy("ord", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def group_documents(docs: DataFrame, group: str, text: str = "text", order: str = "ord", first: int = 8) -> DataFrame:
    """(ord, text) of groups of documents: ord is the group, text those of its first so many members, which `order` tells apart.

    Members are chosen without their texts, so that only chosen texts are moved. Kept by Spark, since two passes read it.
    """
    by = Window.partitionBy("group").orderBy("at")
    chosen = docs.select(F.col(group).alias("group"), F.col(order).alias("at")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= first).select(F.col("at").alias(order)).persist()
    met = docs.select(order, F.col(group).alias("group"), F.col(text).alias("t")).join(checked_broadcast(chosen), order, "left_semi")
    return met.groupBy(F.col("group").alias("ord")).agg(F.array_join(F.collect_list(F.coalesce("t", F.lit(""))), " ").alias("text")).persist()


def document_frequency(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def idf(n_docs: Column, df: Column) -> Column:
    """Always positive."""
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, q: str = "q", text: str = "text") -> DataFrame:
    """(q, term, qtf): a repeated term counts as often as it stands."""
    return queries.select(F.col(q).alias("q"), F.explode(X.tokens(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(asked: DataFrame, terms: DataFrame, stats: DataFrame) -> DataFrame:
    """(q, ord, score) of all documents that hold a term of the query, rounded to 6 digits so that ties are ties everywhere.

    Query terms go to every task while there are few; scores then add up where the postings of a document lie, and only
    the best of each task need be shuffled.
    """
    weighed = asked.join(document_frequency(terms), "term").crossJoin(F.broadcast(stats))
    weighed = weighed.select("q", "term", "qtf", "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    if asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS:
        weighed = F.broadcast(weighed)
    share = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_len")))
    met = terms.join(weighed, "term").select("q", "ord", (F.col("idf") * share * F.col("qtf")).alias("w"))
    return met.groupBy("q", "ord").agg(F.round(F.sum("w"), 6).alias("score")).where("score > 0")


def top(scores: DataFrame, k: int, order: tuple[str, ...] = ("score", "ord"), name: str = "rank") -> DataFrame:
    """The k best of each query, the highest first in each of the columns named."""
    by = Window.partitionBy("q").orderBy(*[F.desc(c) for c in order])
    return scores.withColumn(name, F.row_number().over(by)).where(F.col(name) <= k)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int = 8, text: str = "text") -> DataFrame:
    """(q, ord, score, rank) of the k best documents (ord, text) for each query (q, text).

    Queries go to every task while they have few terms; tasks then keep the k best of each. More queries meet postings.
    """
    asked = query_terms(queries)
    rows = asked.limit(BROADCAST_TERMS + 1).collect()
    if len(rows) > BROADCAST_TERMS:
        terms = postings(docs, text, vocabulary=asked.select("term").distinct())
        return top(bm25_scores(asked, terms, statistics(docs, text)), k)
    number = {q: n for n, q in enumerate(dict.fromkeys(r["q"] for r in rows))}
    names = queries.sparkSession.createDataFrame(list(enumerate(number)), T.StructType([T.StructField("n", T.LongType()), T.StructField("q", asked.schema["q"].dataType)]))
    found = blocks.best(docs, [(number[r["q"]], r["term"], r["qtf"]) for r in rows], len(number), k, text)
    return top(found.join(F.broadcast(names), "n").select("q", "ord", "score"), k)
