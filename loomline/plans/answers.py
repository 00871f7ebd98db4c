"""Fusion, spread picks, known answers, reading and scoring, over documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.operators import evaluate, index, knowledge, reader, retrieve
from loomline.plans.retrieval import SQL_CHUNKS, SQL_INDEX, SQL_PAGES, WS, chunks, questions, sql_collapse, sql_tokens, sql_words
from loomline.plans.texts import FOCUS, PUNCTUATION, sql_clean, sql_focus, sql_types
from loomline.sources.tables import table

C = F.col


def sql_norm(x: str) -> str:
    return sql_collapse(f"regexp_replace(lower({x}), '{PUNCTUATION}', '', 'g')")


def sql_f1(p: str, g: str) -> str:
    p, g = sql_words(sql_norm(p)), sql_words(sql_norm(g))
    common = f"coalesce(list_sum(list_transform(list_intersect({p}, {g}), lambda x: least(len(list_filter({p}, lambda y: y = x)), len(list_filter({g}, lambda y: y = x))))), 0)"
    return f"CASE WHEN len({p}) + len({g}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {common} / (len({p}) + len({g})) END"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of users with the answer of the next turn: ord, question, answer (alternatives parted by |), url."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", C("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (C("turn") - 1).alias("turn"), C("text").alias("answer"))
    rows = asked.join(told, ["conv_id", "turn"])
    return rows.select((C("conv_id") * 1000 + C("turn")).alias("ord"), "question", F.translate("answer", ".", "|").alias("answer"), F.concat(F.lit("https://h.example/"), C("conv_id").cast("string"), F.lit("/")).alias("url"))


PAIRS = "pairs AS (SELECT u.conv_id * 1000 + u.turn AS ord, u.text AS question, translate(a.text, '.', '|') AS answer, 'https://h.example/' || u.conv_id || '/' AS url FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known questions again, in capitals and with a word before."""
    return pairs(spark, sf_dir).select(C("ord").alias("q"), F.concat(F.lit("Well "), "question").alias("text"))


ASKED = "asked AS (SELECT ord AS q, 'Well ' || question AS text FROM pairs)"
OPTIONS = f"list_filter(list_transform(string_split(answer, '|'), lambda x: {sql_clean('x')}), lambda x: x <> '')"
SHORTEST = f"coalesce((list_sort(list_transform({OPTIONS}, lambda o, i: {{'w': len({sql_words('o')}), 'n': length(o), 'i': i, 'o': o}}))[1]).o, 'unknown')"
OVERLAP = f"""ta AS (SELECT q AS a, len(t) AS na, unnest(t) AS term FROM (SELECT q, list_distinct({sql_focus('text')}) AS t FROM asked)),
tb AS (SELECT ord AS b, len(t) AS nb, unnest(t) AS term FROM (SELECT ord, list_distinct({sql_focus('question')}) AS t FROM pairs)),
ov AS (SELECT a, b, count(*) AS shared, count(*) / (max(na) + max(nb) - count(*))::DOUBLE AS jaccard FROM ta JOIN tb USING (term) GROUP BY a, b)"""


def known_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir)
    return knowledge.known_answers(rows.select(C("ord").alias("q"), F.concat(F.lit("  "), F.upper(F.lit("x")), F.lit(" "), "question").alias("text")), rows.withColumn("question", F.concat(F.lit("x: "), "question")))


def known_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.similar_answers(_asked(spark, sf_dir), pairs(spark, sf_dir))


def hint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.hint_urls(_asked(spark, sf_dir), pairs(spark, sf_dir)).select("q", "url", "score", "rank")


def leakage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known questions against all answers of assistants and all benchmark items as evaluated ones."""
    told = table(spark, sf_dir, "conversations").where("role = 'assistant'").select((C("conv_id") * 1000 + C("turn")).alias("q"), "text")
    evaluated = told.unionByName(questions(spark, sf_dir).select((-1 - C("q")).alias("q"), "text"))
    return knowledge.without_leaks(pairs(spark, sf_dir), evaluated).select("ord", "leaked")


def question_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each role and question key."""
    turns = table(spark, sf_dir, "conversations").select("role", X.question_key(C("text")).alias("key"), (C("conv_id") * 1000 + C("turn")).alias("ord"), "text")
    return knowledge.last_by_key(turns, ["role", "key"]).select("role", "key", "ord", F.length("text").cast("long").alias("n"))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first alternative with marks, or all of them but marks, as prediction."""
    guess = F.when(C("ord") % 2 == 0, F.concat(F.split("answer", r"\|")[0], F.lit("?!"))).otherwise(F.translate("answer", "|,", " "))
    return evaluate.details(pairs(spark, sf_dir).withColumn("prediction", guess))


DETAILS = f"""gd AS (SELECT ord, unnest(list_filter(list_transform(string_split(answer, '|'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')) AS gold,
  CASE WHEN ord % 2 = 0 THEN string_split(answer, '|')[1] || '?!' ELSE translate(answer, '|,', ' ') END AS p FROM pairs),
det AS (SELECT ord, max(CASE WHEN {sql_norm('p')} = {sql_norm('gold')} THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match, round(max({sql_f1('p', 'gold')}), 6) AS f1 FROM gd GROUP BY ord)"""


def em_f1_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).where("has_gold").select("ord", "exact_match", "f1")


def em_f1_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(scored_pairs(spark, sf_dir).where("has_gold")).select("count", "exact_match", "f1", "exact_match_percent")


def squad_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested gold; the first sentence in small letters is the prediction, and every third is missing."""
    rows = pairs(spark, sf_dir)
    qas = rows.groupBy((C("ord") / 1000).cast("long").alias("conv")).agg(F.collect_list(F.struct(C("ord").cast("string").alias("id"), F.array(F.struct(C("answer").alias("text"))).alias("answers"))).alias("qas"))
    data = qas.select(F.array(F.struct(F.array(F.struct("qas")).alias("paragraphs"))).alias("data"))
    told = rows.where("ord % 3 <> 0").select(C("ord").cast("string").alias("id"), F.lower(F.split("answer", r"\|")[0]).alias("prediction"))
    return evaluate.squad(data, told).select("id", "exact_match", "f1", "missing")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    one = asked.select("q", F.lit(1).alias("pos"), F.array_join(R.focus_list(C("text")), " ").alias("text"), F.lit(1.15).cast("double").alias("weight"))
    return one.unionByName(asked.select("q", F.lit(2).alias("pos"), F.array_join(F.array_distinct(X.tokens(C("text"))), " ").alias("text"), F.lit(0.95).cast("double").alias("weight")))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.ranked(chunks(spark, sf_dir), questions(spark, sf_dir), _variants(spark, sf_dir))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.fused(_ranked(spark, sf_dir), _variants(spark, sf_dir))


FUSION = f"""vt AS (SELECT q, pos, term, count(*) AS qtf FROM (SELECT item_id AS q, 1 AS pos, unnest({FOCUS}) AS term FROM benchmark UNION ALL SELECT item_id, 2, unnest(list_distinct({sql_tokens('text')})) FROM benchmark) GROUP BY ALL),
vs AS (SELECT q, pos, ord, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_len)) * qtf), 6) AS score FROM vt JOIN tf USING (term) JOIN df USING (term), st GROUP BY q, pos, ord),
vr AS (SELECT *, row_number() OVER (PARTITION BY q, pos ORDER BY score DESC, ord DESC) AS rank FROM vs),
fus AS (SELECT q, ord, round(sum(CASE pos WHEN 1 THEN 1.15::DOUBLE ELSE 0.95::DOUBLE END / (10 + rank)), 6) AS fusion FROM vr WHERE rank <= 96 GROUP BY q, ord)"""


def feature_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts of the best chunks, without URL and title."""
    best = bm25(spark, sf_dir, 24)
    met = chunks(spark, sf_dir).select("ord", C("text").alias("body")).join(index.checked_broadcast(best), "ord").join(questions(spark, sf_dir), "q")
    empty = F.lit("")
    return met.select("q", "ord", retrieve.boost(retrieve.question_features(F.concat(F.lit("advisor of "), C("text"))), empty, empty, F.concat(F.lit("a dean: "), C("body")), C("body")).alias("bonus"))


def bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Kept by Spark: what meets chunks is counted first, so that it goes to them and not they to it."""
    return index.bm25_topk(chunks(spark, sf_dir), questions(spark, sf_dir), k).persist()


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = index.group_documents(chunks(spark, sf_dir), "source")
    return index.bm25_topk(groups, questions(spark, sf_dir), 48).select("q", C("ord").alias("url"), "score", "rank").persist()


def page_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = bm25(spark, sf_dir, 96).select("q", "ord", "score")
    docs = chunks(spark, sf_dir).select("ord", C("source").alias("url"))
    return retrieve.page_injection(_pages(spark, sf_dir), docs, base, base.select("q", "ord", F.lit(0.0).alias("bonus")), base)


def diversified_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _ranked(spark, sf_dir)
    base = found.where("pos = 0").select("q", "ord", "score")
    rows = chunks(spark, sf_dir).select("ord", C("source").alias("url")).join(index.checked_broadcast(base), "ord").join(retrieve.fused(found, _variants(spark, sf_dir)), ["q", "ord"], "left")
    rows = rows.join(_pages(spark, sf_dir).select("q", "url", C("score").alias("page_score")), ["q", "url"], "left")
    rows = rows.withColumn("bonus", F.lit(0.0)).withColumn("preferred", C("url") == "src3").withColumn("types", F.when(C("q") % 2 == 0, F.array(F.lit("person"))).otherwise(F.array().cast("array<string>")))
    return retrieve.diversified(rows).select("q", "ord", "rank", "value")


DIVERSE = f"""cand AS (SELECT base.q, base.ord, chunks.source, base.score, round(base.score + coalesce(fusion, 0) + 0.7::DOUBLE * coalesce(p.score, 0), 6) AS adj
  FROM base JOIN chunks USING (ord) LEFT JOIN fus ON fus.q = base.q AND fus.ord = base.ord LEFT JOIN pages_top p ON p.q = base.q AND p.source = chunks.source WHERE base.rank <= 96),
pl AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY adj DESC, score DESC, ord DESC) - 1 AS pr FROM cand),
gs AS (SELECT *, round(sum(CASE WHEN pr = 0 THEN adj WHEN pr <= 2 THEN 0.25::DOUBLE * adj END) OVER (PARTITION BY q, source), 6) AS g FROM pl),
val AS (SELECT *, round(adj + 0.08::DOUBLE * g + CASE WHEN source = 'src3' THEN 2 ELSE 0 END - (CASE WHEN q % 2 = 0 THEN 0.8::DOUBLE ELSE 1.25::DOUBLE END + 0.3::DOUBLE) * pr, 6) AS value FROM gs WHERE pr < CASE WHEN q % 2 = 0 THEN 3 ELSE 2 END),
picks AS (SELECT q, ord, (row_number() OVER (PARTITION BY q ORDER BY value DESC, g DESC, source DESC, pr))::INT AS rank, value FROM val)"""


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with URLs and titles."""
    return chunks(spark, sf_dir).select("ord", F.concat(F.lit("https://www2.example/people/"), "source").alias("url"), F.concat(F.lit("Page "), "source").alias("title"), "text")


def full_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ranking, with hints."""
    hints = questions(spark, sf_dir).select("q", F.lit("https://www2.example/people/src3/").alias("url"))
    return retrieve.retrieve(_site(spark, sf_dir), questions(spark, sf_dir), 8, hints).select("q", "ord", "url", "rank", "value")


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = index.checked_broadcast(bm25(spark, sf_dir, 8).select("q", "ord", "rank"))
    return chunks(spark, sf_dir).select("ord", C("source").alias("title"), F.concat(F.lit("u/"), "source").alias("url"), "text").join(best, "ord")


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reader.prompts(questions(spark, sf_dir), _top(spark, sf_dir))


def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the whole cascade without a language model, to questions of several types."""
    kinds = F.get(F.array(*[F.lit(x) for x in ("Who is the director, ", "How many units, ", "What year, ", "Which email, ", "Is it so, ")]), F.pmod("q", F.lit(5)).cast("int"))
    asked = questions(spark, sf_dir).withColumn("text", F.concat(kinds, "text"))
    return reader.answers(asked, _top(spark, sf_dir), known=pairs(spark, sf_dir).select("ord", "question", "answer"), exact=True)


def candidate_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of some typed patterns, with their place among those of a document."""
    kinds = {"email": R.EMAIL, "date": R.DATE, "units": R.UNITS, "name": r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"}
    rows = None
    for name, pattern in kinds.items():
        one = table(spark, sf_dir, "documents").select("doc_id", F.lit(name).alias("kind"), F.posexplode(F.transform(X.matches(C("text"), pattern), lambda m: m["hit"])).alias("pos", "hit"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


HITS = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS kind, unnest(range(len(h)))::INT AS pos, unnest(h) AS hit FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS h FROM documents)" for n, p in {"email": R.EMAIL, "date": R.DATE, "units": R.UNITS, "name": r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}"}.items())


def _recall(spark: SparkSession, sf_dir: str, top: DataFrame) -> DataFrame:
    """The best page of an item as its gold page, its text as gold answer."""
    gold = _pages(spark, sf_dir).where("rank = 1").select("q", F.concat(F.lit("u/"), "url", F.lit("/")).alias("url")).join(questions(spark, sf_dir).select("q", C("text").alias("answer")), "q")
    return evaluate.recall(gold, top.select("q", "url", "text"))


def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recall(spark, sf_dir, _top(spark, sf_dir))


def conditional_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _top(spark, sf_dir).persist()
    first = top.where("rank = 1").select("q", C("text").alias("prediction")).join(questions(spark, sf_dir).select("q", C("text").alias("gold")), "q")
    return evaluate.conditional(first.select("q", F.round(evaluate.token_f1(C("prediction"), C("gold")), 6).alias("f1")), _recall(spark, sf_dir, top))


TOP8 = "top8 AS (SELECT q, base.rank, source, text, 'u/' || source AS url FROM base JOIN chunks USING (ord) WHERE base.rank <= 8)"
RECALL = f"""gold AS (SELECT p.q, 'u/' || p.source AS url, {sql_norm('b.text')} AS a FROM pages_top p JOIN benchmark b ON b.item_id = p.q WHERE p.rank = 1),
rec AS (SELECT gold.q, coalesce(max((top8.url = gold.url)::INT), 0) = 1 AS url_found, coalesce(max(contains({sql_norm('top8.text')}, a)::INT), 0) = 1 AS answer_found FROM gold LEFT JOIN top8 USING (q) GROUP BY gold.q)"""
WITH = f"WITH {SQL_CHUNKS}, {SQL_INDEX}"

QUERIES = {
    "known_answer_exact": (known_exact, f"WITH {PAIRS}, k AS (SELECT ord, answer, trim(regexp_replace(lower('x: ' || question), '[^a-z0-9]+', ' ', 'g')) AS key FROM pairs), f AS (SELECT key, arg_min(answer, ord) AS answer FROM k GROUP BY key) SELECT k.ord AS q, {SHORTEST} AS answer FROM (SELECT k.ord, f.answer FROM k JOIN f USING (key)) k"),
    "known_answer_similar": (known_similar, f"WITH {PAIRS}, {ASKED}, {OVERLAP}, c AS (SELECT a AS q, b, round(shared + 3 * jaccard, 6) AS score FROM ov WHERE shared >= 5 AND jaccard >= 0.68), t AS (SELECT c.*, x.text, p.question, p.answer FROM c JOIN asked x ON x.q = c.q JOIN pairs p ON p.ord = c.b), g AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, b) AS n FROM t WHERE len({sql_types('text')}) = 0 OR len({sql_types('question')}) = 0 OR len(list_intersect({sql_types('text')}, {sql_types('question')})) > 0) SELECT q, {SHORTEST} AS answer, score FROM g WHERE n = 1"),
    "hint_urls": (hint_urls, f"WITH {PAIRS}, {ASKED}, {OVERLAP}, c AS (SELECT a AS q, url, round(shared + 2 * jaccard, 6) AS score FROM ov JOIN pairs ON pairs.ord = ov.b WHERE round(shared + 2 * jaccard, 6) >= 2), m AS (SELECT q, url, max(score) AS score FROM c GROUP BY q, url), r AS (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, url DESC))::INT AS rank FROM m) SELECT * FROM r WHERE rank <= 3"),
    "leakage_guard": (leakage_guard, f"WITH {PAIRS}, asked AS (SELECT conv_id * 1000 + turn AS q, text FROM conversations WHERE role = 'assistant' UNION ALL SELECT -1 - item_id, text FROM benchmark), {OVERLAP} SELECT ord, ord IN (SELECT b FROM ov WHERE shared >= 5 AND jaccard >= 0.68) OR trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) IN (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) FROM asked) AS leaked FROM pairs"),
    "question_index": (question_index, "SELECT role, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key, max(conv_id * 1000 + turn) AS ord, length(arg_max(text, conv_id * 1000 + turn)) AS n FROM conversations GROUP BY ALL"),
    "em_f1_detail": (em_f1_detail, f"WITH {PAIRS}, {DETAILS} SELECT * FROM det"),
    "em_f1_summary": (em_f1_summary, f"WITH {PAIRS}, {DETAILS} SELECT count(*) AS count, round(avg(exact_match), 6) AS exact_match, round(avg(f1), 6) AS f1, round(round(avg(exact_match), 6) * 100, 2) AS exact_match_percent FROM det"),
    "squad_eval": (squad_eval, f"WITH {PAIRS}, told AS (SELECT ord, answer, lower(string_split(answer, '|')[1]) AS p FROM pairs) SELECT ord::VARCHAR AS id, CASE WHEN ord % 3 <> 0 AND {sql_norm('p')} = {sql_norm('answer')} THEN 1.0 ELSE 0.0 END::DOUBLE AS exact_match, CASE WHEN ord % 3 = 0 THEN 0.0 ELSE round({sql_f1('p', 'answer')}, 6) END::DOUBLE AS f1, ord % 3 = 0 AS missing FROM told"),
    "rrf_fusion": (rrf_fusion, f"{WITH}, {FUSION} SELECT q, ord, fusion FROM fus"),
    "feature_boost": (feature_boost, None),
    "page_injection": (page_injection, f"{WITH}, {SQL_PAGES}, b AS (SELECT * FROM base WHERE rank <= 96), m AS (SELECT p.q, p.source, p.score AS ps, p.rank, c.ord, coalesce(b.score, 0) AS v, b.ord IS NOT NULL AS there FROM pages_top p JOIN chunks c USING (source) LEFT JOIN b ON b.q = p.q AND b.ord = c.ord), r AS (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY v DESC, ord) AS n FROM m) SELECT q, ord, round(greatest(0.001::DOUBLE, ps / (1.2::DOUBLE + 0.03::DOUBLE * rank)), 6) AS score FROM r WHERE n = 1 AND NOT there"),
    "diversified_topk": (diversified_topk, f"{WITH}, {SQL_PAGES}, {FUSION}, {DIVERSE} SELECT q, ord, rank, value FROM picks WHERE rank <= 8"),
    "full_retrieval": (full_retrieval, None),
    "prompt_assembly": (prompt_assembly, f"{WITH}, {TOP8} SELECT q, string_agg('[' || rank || '] ' || source || chr(10) || url || chr(10) || top8.text, chr(10) || '---' || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(b.text) AS prompt FROM top8 JOIN benchmark b ON b.item_id = q GROUP BY q"),
    "extractive_answer": (extractive_answer, None),
    "candidate_hits": (candidate_hits, HITS),
    "recall_at_k": (recall_at_k, f"{WITH}, {SQL_PAGES}, {TOP8}, {RECALL} SELECT * FROM rec"),
    "conditional_f1": (conditional_f1, f"{WITH}, {SQL_PAGES}, {TOP8}, {RECALL}, sc1 AS (SELECT q, round({sql_f1('t', 'g')}, 6) AS f1 FROM (SELECT q, top8.text AS t, b.text AS g FROM top8 JOIN benchmark b ON b.item_id = q WHERE rank = 1)) SELECT round(avg(url_found::INT), 6) AS url_recall, round(avg(answer_found::INT), 6) AS answer_recall, round(avg(f1) FILTER (url_found), 6) AS f1_url_found, round(avg(f1) FILTER (answer_found), 6) AS f1_answer_found FROM rec LEFT JOIN sc1 USING (q)"),
}
