"""Picking pages for annotation, and the subset that a second annotator gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.functions import urls as U
from loomline.operators.corpus import LOOSE_PHONE, rank_within
from loomline.operators.evaluate import refuse

# ---- fixed values
MONTH_OR_YEAR = rf"\b{R.MONTH}\b|\b(?:19|20)\d{{2}}\b"
NUMBER = r"\b\d[\d,./:-]*\b"
KEYWORDS = {
    "contact": ("email", "phone", "office", "contact", "hours", "hall"),
    "academics": ("admission", "application", "degree", "course", "program", "units"),
    "people": ("director", "chair", "professor", "student", "staff"),
    "rankings": ("rank", "ranking", "enrollment", "fellow", "award", "members"),
    "events": ("event", "colloquium", "celebrating", "program", "lecture"),
}
#: (count, at most, weight)
WEIGHTS = (("emails", 8, 4.0), ("phones", 6, 3.0), ("dates", 8, 2.0), ("numbers", 20, 0.5), ("contact", 10, 0.8), ("academics", 10, 0.8), ("people", 10, 0.5), ("rankings", 10, 0.6), ("events", 10, 0.6))
BY_TYPE = {"contact": "contact email, office location, phone, office hours", "academics": "requirement, degree type, deadline, unit load", "people": "person-role, title, office, contact detail", "news": "award, honoree, date, count, affiliation", "about": "ranking, count, year, historical milestone", "connect": "support contact, donation program, named initiative", "research": "event name, archive year, research area"}
BY_WORDS = ((("admission", "degree", "course", "units", "deadline"), "requirement, degree type, deadline, unit load"), (("chair", "director", "professor", "manager", "fellow"), "person-role, title, award, affiliation"), (("rank", "ranking", "number of", "enrollment"), "ranking, count, total enrollment, year"), (("event", "lecture", "program", "ceremony", "announced"), "event date, venue, month, named program"))
GENERAL = "count, named entity, year, location"


def feature_counts(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    out = {"emails": F.regexp_count(text, F.lit(R.EMAIL)), "phones": F.regexp_count(text, F.lit(LOOSE_PHONE)), "dates": F.regexp_count(text, F.lit(MONTH_OR_YEAR)), "numbers": F.regexp_count(text, F.lit(NUMBER))}
    for name, words in KEYWORDS.items():
        counts = [((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int") for w in words]
        out[name] = sum(counts[1:], counts[0])
    return out


def score(counts: dict[str, Column], n_words: Column) -> Column:
    total = F.lit(0.0)
    for name, most, weight in WEIGHTS:
        total = total + F.least(counts[name], F.lit(most)) * F.lit(weight)
    return F.round(total / (1 + F.greatest(n_words, F.lit(1)) / 900), 6)


def question_ideas(url: Column, text: Column) -> Column:
    kind, low = U.page_type(url), F.lower(text)
    marks = [F.when(kind == k, F.lit(v)) for k, v in BY_TYPE.items()]
    marks.append(F.when(kind.isin("contact", "people", "connect") & (text.rlike(R.EMAIL) | text.rlike(LOOSE_PHONE)), F.lit(BY_TYPE["contact"])))
    marks += [F.when(R.any_in(low, words), F.lit(idea)) for words, idea in BY_WORDS]
    found = F.slice(F.array_distinct(F.filter(F.array(*marks), lambda m: m.isNotNull())), 1, 3)
    return F.when(F.size(found) == 0, F.lit(GENERAL)).otherwise(F.array_join(found, "; "))


def exclude_urls(docs: DataFrame, excluded: DataFrame) -> DataFrame:
    return docs.join(excluded.select("url").distinct(), "url", "left_anti")


def select_pages(docs: DataFrame, limit: int = 45, per_type: int = 8) -> DataFrame:
    """The best pages (url, text, ord), no more than so many of each type, with page_type, score and rank."""
    scored = docs.withColumn("page_type", U.page_type(F.col("url"))).withColumn("score", score(feature_counts(F.col("text")), X.n_words(F.col("text"))))
    best = rank_within(scored, ["page_type"], [F.desc("score"), F.asc("ord")], "n").where(F.col("n") <= per_type)
    # at most per_type rows of each of a few types reach this sort
    return best.orderBy(F.desc("score"), F.asc("ord")).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("ord")))).drop("n")


def worklist(selected: DataFrame) -> DataFrame:
    """Rows to fill in by an annotator."""
    blank = lambda name: F.lit("").alias(name)
    return selected.select(F.format_string("page_%03d", "rank").alias("item_id"), "url", "page_type", F.round("score", 1).alias("score"), question_ideas(F.col("url"), F.col("text")).alias("suggested_question_types"), X.preview(F.col("text")).alias("text_preview"), F.lit("todo").alias("status"), blank("question"), blank("answer"), blank("evidence_text"), blank("needs_second_annotation"))


def second_annotation(metadata: DataFrame, questions: DataFrame) -> DataFrame:
    """id, question, url, answer of the items that need a second annotation; refuses items that match no question.

    metadata: id, question, url, needs_second_annotation; questions: question, url, answer, ord, the last of a key wins.
    """
    last = questions.groupBy("question", "url").agg(F.max_by("answer", "ord").alias("answer"))
    wanted = metadata.where("needs_second_annotation").select("id", "question", "url")
    refuse(wanted.join(last, ["question", "url"], "left_anti"), "items without a question")
    return wanted.join(last, ["question", "url"]).select("id", "question", "url", "answer")


def blind(subset: DataFrame) -> DataFrame:
    blank = lambda name: F.lit("").alias(name)
    return subset.select("id", "question", "url", blank("second_annotator_answer"), blank("second_annotator_evidence"), blank("notes"))
