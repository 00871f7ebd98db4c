"""Answers that are known already: exact and similar questions, hinted pages, and the guard against leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.functions import urls as U
from loomline.operators import overlaps

MIN_SHARED, MIN_JACCARD, MIN_HINT = 5, 0.68, 2.0


def last_by_key(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The last row, by `order`, of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def pick_known(question: Column, field: Column) -> Column:
    """A yes or no among the alternatives of a yes/no question, else the shortest by words, then letters; first on ties."""
    asks = F.array_contains(R.question_types(question), "yesno")

    def pick(options: Column) -> Column:
        yes_no = F.get(F.filter(options, lambda o: F.lower(o).isin("yes", "no")), F.lit(0))
        ranked = F.transform(options, lambda o, i: F.struct(X.n_words(o).alias("w"), F.length(o).alias("n"), i.alias("i"), o.alias("o")))
        return F.when(asks & yes_no.isNotNull(), F.initcap(yes_no)).otherwise(F.coalesce(F.array_min(ranked)["o"], F.lit("unknown")))

    return X.let(X.answer_options(field), pick)


def known_answers(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(q, answer) where a question is known word for word. known: question, answer, ord; the first of a key wins."""
    rows = known.select(X.question_key(F.col("question")).alias("key"), "answer", "ord").where("key <> ''")
    first = rows.groupBy("key").agg(F.min_by("answer", "ord").alias("answer"))
    asked = questions.select("q", "text", X.question_key(F.col("text")).alias("key"))
    return asked.join(first, "key").select("q", pick_known(F.col("text"), F.col("answer")).alias("answer"))


def token_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, shared, jaccard) of all pairs of (a, text) and (b, text) with a common token that is no stop word."""
    left = a.select("a", R.focus_terms(F.col("text")).alias("t")).select("a", F.size("t").alias("na"), F.explode("t").alias("term"))
    right = b.select("b", R.focus_terms(F.col("text")).alias("t")).select("b", F.size("t").alias("nb"), F.explode("t").alias("term"))
    shared = left.join(right, "term").groupBy("a", "b").agg(F.count("*").alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return shared.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def similar_sets(a: DataFrame, b: DataFrame, least_shared: int = MIN_SHARED, least_jaccard: float = MIN_JACCARD) -> DataFrame:
    """token_overlap of the pairs with that many shared tokens and that similarity, counted in blocks of both sides."""
    sides = [f.select(n, R.focus_terms(F.col("text")).alias("t")).where(F.size("t") >= least_shared) for f, n in ((a, "a"), (b, "b"))]
    return overlaps.similar(*sides, least_shared, least_jaccard)


def similar_answers(questions: DataFrame, known: DataFrame) -> DataFrame:
    """(q, answer, score) of the most similar known question (question, answer, ord) that is similar enough and whose
    types agree, where both have some; the first on ties."""
    met = similar_sets(questions.select(F.col("q").alias("a"), "text"), known.select(F.col("ord").alias("b"), F.col("question").alias("text")))
    met = met.join(questions.select(F.col("q").alias("a"), "text"), "a").join(known.select(F.col("ord").alias("b"), "question", "answer"), "b")
    mine, theirs = R.question_types(F.col("text")), R.question_types(F.col("question"))
    met = met.where((F.size(mine) == 0) | (F.size(theirs) == 0) | F.arrays_overlap(mine, theirs))
    met = met.withColumn("score", F.round(F.col("shared") + 3.0 * F.col("jaccard"), 6))
    best = met.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where("n = 1")
    return best.select(F.col("a").alias("q"), pick_known(F.col("text"), F.col("answer")).alias("answer"), "score")


def hint_urls(questions: DataFrame, known: DataFrame, k: int = 3) -> DataFrame:
    """(q, url, score, rank) of the pages of the most similar known questions (question, url, ord).

    Two shared tokens are enough, so all pairs are counted, in blocks; only the k best pages of a question leave a block.
    """
    asked = questions.select(F.col("q").alias("a"), R.focus_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    told = known.select(F.col("ord").alias("b"), R.focus_terms(F.col("question")).alias("t"), "url", U.key(F.col("url")).alias("key")).where((F.size("t") > 0) & F.col("url").isNotNull())
    best = overlaps.best_pages(asked, told, k, MIN_HINT).groupBy("a", "key").agg(F.max(F.struct("score", "url")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("m.score"), F.desc("m.url")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("a").alias("q"), "m.url", "m.score", "rank")


def without_leaks(known: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Known rows (question, ord, ...) with `leaked`: the question is an evaluated one (q, text), or similar to one."""
    keys = evaluated.select(X.question_key(F.col("text")).alias("key")).distinct()
    exact = known.withColumn("key", X.question_key(F.col("question"))).join(keys, "key", "left_semi").select("ord")
    near = similar_sets(evaluated.select(F.col("q").alias("a"), "text"), known.select(F.col("ord").alias("b"), F.col("question").alias("text"))).select(F.col("b").alias("ord"))
    found = exact.unionByName(near).distinct().withColumn("leaked", F.lit(True))
    return known.join(found, "ord", "left").withColumn("leaked", F.coalesce("leaked", F.lit(False)))
