"""Answers read from retrieved chunks: prompts, a pluggable language-model reader, typed and relation candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.operators import corpus
from loomline.operators.knowledge import known_answers, similar_answers

SYSTEM_PROMPT = "Answer from the passages only, in as few words as possible: a name alone for who, a number alone for how many, a date alone for when, Yes or No where asked. Say unknown if the passages don't tell."
CANDIDATE = "array<struct<hit:string,bonus:double,context:string>>"


def prompts(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(q, prompt): numbered passages in order of rank, then the question. Bounded by the k passages of a question."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("url", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    joined = retrieved.select("q", "rank", block.alias("block")).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return questions.join(joined, "q").select("q", F.concat(F.array_join(F.transform("b", lambda x: x["block"]), "\n---\n"), F.lit("\n\nQuestion: "), F.col("text")).alias("prompt"))


def read_with(prompted: DataFrame, reader: Callable[[str, str], str], max_tokens: int = 20) -> DataFrame:
    """(q, answer, error): the first line of what the reader makes of (system prompt, prompt); null where it fails or says nothing."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for prompt in batch["prompt"]:
                try:
                    lines = (reader(SYSTEM_PROMPT, prompt) or "").strip().splitlines()
                    answers.append(" ".join(lines[0].split()[:max_tokens]) if lines else None)
                    errors.append(None)
                except Exception as error:  # a reader may fail in any way; its question falls back to extraction
                    answers.append(None)
                    errors.append(str(error)[:200])
            yield pd.DataFrame({"q": batch["q"], "answer": answers, "error": errors})

    kind = prompted.schema["q"].dataType.simpleString()
    return prompted.select("q", "prompt").mapInPandas(ask, f"q {kind}, answer string, error string")


def _as_candidates(found: Column, span: Column, bonus: float) -> Column:
    return F.transform(found, lambda m: F.struct(m["hit"].alias("hit"), F.lit(bonus).alias("bonus"), X.context(span, m["start"], F.length(m["hit"])).alias("context")))


def typed_candidates(types: Column, span: Column) -> Column:
    """Candidates of a span for the types of a question, in a fixed order, with the text around each."""
    none = F.array().cast(CANDIDATE)
    parts = []
    for name, pattern, bonus in R.TYPED:
        found = X.matches(span, pattern)
        if pattern == R.NUMBER:
            found = F.filter(found, lambda m: ~F.trim(m["hit"]).rlike(r"^(?:19|20)\d{2}$"))
        if pattern == R.NAME:
            found = F.filter(found, lambda m: R.plausible_name(m["hit"]))
        parts.append(F.when(F.array_contains(types, name), _as_candidates(found, span, bonus)).otherwise(none))
    said = X.yes_no(span)
    parts.append(F.when(F.array_contains(types, "yesno") & said.isNotNull(), F.array(F.struct(said.alias("hit"), F.lit(6.0).alias("bonus"), span.alias("context")))).otherwise(none))
    return F.concat(*parts)


def relation_candidates(question: Column, span: Column, relations: tuple = R.RELATIONS) -> Column:
    """First group of the first match of each relation whose cues are in the question; slots are filled from it."""
    low, none, parts = F.lower(question), F.array().cast(CANDIDATE), []
    part = lambda pattern: F.nullif(F.upper(F.regexp_extract(question, pattern, 1)), F.lit(""))
    # the marks between a subject and a number may differ
    course = F.concat(part(R.COURSE_SUBJECT), F.lit(r"\E\s*-?\s*\Q"), part(R.COURSE_NUMBER))
    slots = {"years": F.nullif(F.regexp_extract(question, r"(\d{4}-\d{2})", 1), F.lit("")), "person": R.person_in_question(question), "course": course}
    for groups, pattern, slot, bonus in relations:
        test = F.lit(True)
        for cues in groups:
            test = test & (R.any_in(low, tuple(c for c in cues if c[0] != "^")) | reduce(or_, [low.startswith(c[1:]) for c in cues if c[0] == "^"], F.lit(False)))
        if slot:
            head, tail = pattern.split("%s")
            regex = F.concat(F.lit(head + r"\Q"), slots[slot], F.lit(r"\E" + tail))
            test = test & slots[slot].isNotNull()
        else:
            regex = F.lit(pattern)
        whole, hit = (F.call_function("regexp_extract", span, regex, F.lit(k)) for k in (0, 1))
        start = F.locate("\u0001", F.replace(span, whole, F.concat(F.lit("\u0001"), whole))) - 1
        start = start + F.greatest(F.length(F.call_function("substring_index", whole, hit, F.lit(1))), F.lit(0))
        made = F.array(F.struct(hit.alias("hit"), F.lit(bonus).alias("bonus"), X.context(span, start, F.length(hit)).alias("context")))
        parts.append(F.when(test & (hit != ""), made).otherwise(none))
    return F.array_distinct(F.concat(*parts)) if parts else none


def candidate_score(candidate: Column, focus: Column, rank: Column, bonus: Column, context: Column) -> Column:
    """Null for what is refused: a candidate out of all context whose bonus doesn't stand alone."""
    overlap = F.size(F.array_intersect(X.tokens(F.when(context == "", candidate).otherwise(context)), focus))
    value = bonus + 0.75 * overlap - 0.08 * F.greatest(F.size(X.tokens(candidate)) - 5, F.lit(0)) - 0.2 * rank
    return F.when((F.size(focus) > 0) & (overlap == 0) & (bonus < 4.5), None).otherwise(F.round(value, 6))


def candidates(questions: DataFrame, retrieved: DataFrame, relations: tuple = R.RELATIONS) -> DataFrame:
    """(q, pool, key, answer, score, place): the best of each candidate of a question's retrieved chunks (q, rank from 1, text).

    pool 0 holds typed and relation candidates, 1 fragments of spans that share two focus terms. place orders equals:
    chunk, span, kind, position.
    """
    about = questions.select("q", F.col("text").alias("question"), R.question_types(F.col("text")).alias("types"), R.focus_terms(F.col("text")).alias("focus"))
    rows = retrieved.select("q", (F.col("rank") - 1).alias("rank"), F.posexplode(corpus.spans(F.col("text"))).alias("span_no", "span")).join(about, "q")
    typed = F.transform(typed_candidates(F.col("types"), F.col("span")), lambda c, i: F.struct(F.lit(0).alias("pool"), F.lit(0).alias("kind"), i.alias("i"), c["hit"].alias("hit"), (c["bonus"] + 0.25).alias("bonus"), c["context"].alias("context")))
    related = F.transform(relation_candidates(F.col("question"), F.col("span"), relations), lambda c, i: F.struct(F.lit(0).alias("pool"), F.lit(1).alias("kind"), i.alias("i"), c["hit"].alias("hit"), (c["bonus"] + 0.2).alias("bonus"), c["context"].alias("context")))
    words = X.words(F.col("span"))
    near = F.size(F.array_intersect(X.tokens(F.col("span")), F.col("focus"))) >= 2
    piece = lambda i, value, bonus: F.struct(F.lit(1).alias("pool"), F.lit(2).alias("kind"), F.lit(i).alias("i"), value.alias("hit"), F.lit(bonus).alias("bonus"), F.col("span").alias("context"))
    head = piece(0, F.array_join(F.slice(words, 1, 10), " "), 1.9)
    fragments = F.when(near & (F.size(words) <= 8), F.array(head, piece(1, F.col("span"), 2.1))).when(near, F.array(head)).otherwise(F.array().cast("array<struct<pool:int,kind:int,i:int,hit:string,bonus:double,context:string>>"))
    made = rows.select("q", "rank", "span_no", "focus", F.explode(F.concat(typed, related, fragments)).alias("c"))
    made = made.select("q", "rank", "span_no", "focus", "c.*").withColumn("answer", X.cleanup_answer(F.col("hit"))).where("answer <> ''")
    made = made.withColumn("score", candidate_score(F.col("answer"), F.col("focus"), F.col("rank"), F.col("bonus"), F.col("context"))).where("score is not null")
    place = F.struct("rank", "span_no", "kind", "i")
    return made.groupBy("q", "pool", F.lower("answer").alias("key")).agg(F.max("score").alias("score"), F.min_by("answer", F.struct(-F.col("score"), place)).alias("answer"), F.min(place).alias("place"))


def extracted_answers(questions: DataFrame, retrieved: DataFrame, relations: tuple = R.RELATIONS) -> DataFrame:
    """(q, answer): the best candidate, typed ones before fragments; questions without any have no row."""
    best = candidates(questions, retrieved, relations).groupBy("q").agg(F.min(F.struct("pool", (-F.col("score")).alias("s"), "place", "answer")).alias("b"))
    return best.select("q", F.col("b.answer").alias("answer"))


def postprocess(question: Column, answer: Column) -> Column:
    """An answer in the form its question asks for; unknown where it says nothing."""
    clean, types, low = X.cleanup_answer(answer), R.question_types(question), F.lower(question)
    has = lambda name: F.array_contains(types, name)
    order = (("email", R.EMAIL), ("phone", R.PHONE), ("location", R.ROOM), ("location", R.BUILDING), ("course", R.COURSE), ("university", R.UNIVERSITY), ("professorship", R.PROFESSORSHIP), ("token", R.TOKEN_NAME), ("team", R.TEAM), ("degree", R.DEGREE), ("time", R.TIME), ("date", R.DATE_RANGE), ("date", R.DATE), ("year", R.YEAR_RANGE), ("year", R.YEAR), ("number", R.TEXT_COUNT), ("number", R.UNITS))
    found = []
    for name, pattern in order:
        hit = F.nullif(F.regexp_extract(clean, pattern, 0), F.lit(""))
        shaped = X.course_code(hit) if pattern == R.COURSE else X.degree_text(hit) if pattern == R.DEGREE else X.cleanup_answer(hit)
        found.append(F.when(has(name), shaped))
    degree = X.degree_text(clean)
    flat = F.replace(F.lower(degree), F.lit(" "), F.lit(""))
    rest = F.when(has("degree"), F.when(flat.isin("phdonly", "phd.only", "ph.donly", "ph.d.only"), F.lit("PhD. only")).otherwise(degree)).otherwise(clean)
    window = F.nullif(F.regexp_extract(rest, R.DATE_RANGE, 0), F.lit(""))
    rest = F.coalesce(F.when(F.contains(low, F.lit("listed first")) & rest.startswith("Recipients "), X.cleanup_answer(F.regexp_replace(rest, "^Recipients ", ""))), F.when(F.contains(low, F.lit("application period")), X.cleanup_answer(window)), rest)
    shaped = F.coalesce(*found, F.when(has("yesno"), X.yes_no(clean)), F.when(has("course"), X.course_code(clean)), rest)
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("unknown")).when(clean.rlike(X.UNKNOWN_LIKE), F.lit("unknown")).otherwise(shaped)


def answers(questions: DataFrame, retrieved: DataFrame, known: DataFrame | None = None, exact: bool = False, reader: Callable[[str, str], str] | None = None, relations: tuple = R.RELATIONS) -> DataFrame:
    """(q, answer, how) of every question: known, similar, read, extracted or unknown; blank questions are unknown.

    Each step sees only what the steps before left open. known: question, answer, ord; exact allows word-for-word lookup.
    """
    # every step reads these again, so Spark keeps them
    left, out, retrieved = questions.where(F.trim("text") != ""), None, retrieved.persist()

    def settle(found: DataFrame, how: str) -> None:
        nonlocal left, out
        named = found.select("q", "answer", F.lit(how).alias("how")).persist()
        out = named if out is None else out.unionByName(named)
        left = left.join(named.select("q"), "q", "left_anti")

    def shaped(found: DataFrame) -> DataFrame:
        return found.select("q", "answer").join(left, "q").select("q", postprocess(F.col("text"), F.col("answer")).alias("answer"))

    if known is not None:
        if exact:
            settle(shaped(known_answers(left, known)), "known")
        settle(shaped(similar_answers(left, known)), "similar")
    open_ = retrieved.join(left.select("q"), "q", "left_semi")
    if reader is not None:
        settle(shaped(read_with(prompts(left, open_), reader).where("answer is not null")), "read")
    settle(shaped(extracted_answers(left, open_.join(left.select("q"), "q", "left_semi"), relations)), "extracted")
    return questions.select("q").join(out, "q", "left").select("q", F.coalesce("answer", F.lit("unknown")).alias("answer"), F.coalesce("how", F.lit("unknown")).alias("how"))
