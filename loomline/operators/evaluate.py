"""Scores of answers against gold: exact match, token F1, recall of retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.functions import urls as U


def exact_match(prediction: Column, gold: Column) -> Column:
    return (X.normalize_answer(prediction) == X.normalize_answer(gold)).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of token multisets: 1 if both are empty, 0 if one is."""
    count = lambda items, x: F.size(F.filter(items, lambda y: y == x))

    def f1(v: Column) -> Column:
        p, g = v["p"], v["g"]
        common = F.aggregate(F.array_intersect(p, g), F.lit(0), lambda acc, x: acc + F.least(count(p, x), count(g, x)))
        return F.when(F.size(p) + F.size(g) == 0, 1.0).otherwise(2.0 * common / (F.size(p) + F.size(g)))

    return X.let(F.struct(X.words(X.normalize_answer(prediction)).alias("p"), X.words(X.normalize_answer(gold)).alias("g")), f1)


def best_of_gold(metric: Callable[[Column, Column], Column], prediction: Column, gold: Column) -> Column:
    """The best value over an array of gold answers; 0 where there is none."""
    return F.coalesce(F.array_max(F.transform(gold, lambda g: metric(prediction, g))), F.lit(0.0))


def details(rows: DataFrame) -> DataFrame:
    """Adds exact_match, f1 and has_gold to rows of prediction and answer, the gold alternatives parted by |."""
    gold = X.gold_answers(F.col("answer"))
    return rows.withColumn("exact_match", best_of_gold(exact_match, F.col("prediction"), gold)).withColumn("f1", F.round(best_of_gold(token_f1, F.col("prediction"), gold), 6)).withColumn("has_gold", F.size(gold) > 0)


def summary(scored: DataFrame) -> DataFrame:
    """count, exact_match, f1 and both in percent, in one row; zeros without any row."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    out = scored.agg(F.count("*").alias("count"), mean("exact_match").alias("exact_match"), mean("f1").alias("f1"))
    return out.withColumn("exact_match_percent", F.round(F.col("exact_match") * 100, 2)).withColumn("f1_percent", F.round(F.col("f1") * 100, 2))


def refuse(rows: DataFrame, message: str) -> None:
    """An error if there is any row."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{message}: {[tuple(r) for r in found]}")


def by_position(references: DataFrame, predictions: DataFrame, allow_prefix: bool = False) -> DataFrame:
    """References (pos, question, answer, ...) with the prediction (pos, prediction) of the same place.

    Counts must agree, unless a shorter list of predictions is allowed.
    """
    n, m = references.count(), predictions.count()
    if n != m and not (allow_prefix and m < n):
        raise ValueError(f"{n} references but {m} predictions")
    return references.join(predictions, "pos")


def by_question(references: DataFrame, questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions (pos, prediction) of questions (pos, question), with the references (question, answer) of that text.

    Refuses repeated references and questions without one.
    """
    refuse(references.groupBy("question").count().where("count > 1").select("question"), "repeated reference questions")
    refuse(questions.join(references, "question", "left_anti").select("question"), "questions without a reference")
    if questions.count() != predictions.count():
        raise ValueError("as many predictions as questions are needed")
    return questions.join(predictions, "pos").join(references, "question")


def squad(dataset: DataFrame, predictions: DataFrame) -> DataFrame:
    """Details of nested gold (data: paragraphs: qas: id, answers: text) and predictions (id, prediction); a missing
    prediction scores 0 and has `missing` true."""
    rows = dataset.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select(F.explode("p.qas").alias("q"))
    rows = rows.select("q.id", F.col("q.answers.text").alias("gold")).join(predictions, "id", "left")
    zero = lambda metric: F.when(F.col("prediction").isNull(), 0.0).otherwise(best_of_gold(metric, F.col("prediction"), F.col("gold")))
    return rows.withColumn("exact_match", zero(exact_match)).withColumn("f1", F.round(zero(token_f1), 6)).withColumn("missing", F.col("prediction").isNull())


def recall(gold: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(q, url_found, answer_found) of gold (q, url, answer) against retrieved chunks (q, url, text)."""
    wanted = gold.select("q", U.key(F.col("url")).alias("key"), X.normalize_answer(F.col("answer")).alias("a"))
    met = wanted.join(retrieved.select("q", U.key(F.col("url")).alias("got"), X.normalize_answer(F.col("text")).alias("t")), "q", "left")
    found = met.groupBy("q").agg(F.max((F.col("got") == F.col("key")).cast("int")).alias("u"), F.max(F.contains("t", "a").cast("int")).alias("c"))
    return found.select("q", (F.coalesce("u", F.lit(0)) == 1).alias("url_found"), (F.coalesce("c", F.lit(0)) == 1).alias("answer_found"))


def conditional(scored: DataFrame, found: DataFrame) -> DataFrame:
    """One row: recall of URLs and answers, and mean F1 where each was found. scored: q, f1."""
    met = found.join(scored.select("q", "f1"), "q", "left")
    mean = lambda c: F.round(F.avg(c), 6)
    return met.agg(mean(F.col("url_found").cast("double")).alias("url_recall"), mean(F.col("answer_found").cast("double")).alias("answer_recall"), mean(F.when(F.col("url_found"), F.col("f1"))).alias("f1_url_found"), mean(F.when(F.col("answer_found"), F.col("f1"))).alias("f1_answer_found"))
