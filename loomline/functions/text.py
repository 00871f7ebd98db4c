"""Scalar text functions over columns; white space is Unicode's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values
ANSWER_PREFIX = r"(?i)^(?:answer|short answer|final answer|response)\s*[:\-]\s*"
LEADING_PHRASE = r"(?i)^(?:the answer is|it is|it's|this is|the page says)\s+"
MARKDOWN = r"[*_`#>]+"
UNKNOWN_LIKE = r"(?i)^(?:unknown|not (?:available|listed|provided|specified|mentioned|supported)|n/?a|none|no answer)$"
NEGATIVE_CUES = (" no ", " not ", " do not ", " does not ", " did not ", " without ")
#: What the cleaner writes plainly: single quotes, double quotes, two dashes; NBSP and NUL become spaces.
CURLY, PLAIN = "‘’“”–— \u0000", "''\"\"--  "
DEGREES = ((r"(?i)\bM\s*\.?\s*Eng\b(?:\.)?", "M.Eng."), (r"(?i)\bM\s*\.?\s*S\b(?:\.)?", "M.S."), (r"(?i)\bB\s*\.?\s*S\b(?:\.)?", "B.S."), (r"(?i)\bB\s*\.?\s*A\b(?:\.)?", "B.A."))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, also where lambdas within refer to it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def collapse_plain(text: Column) -> Column:
    """collapse, after typographic quotes, dashes, NBSP and NUL became ASCII."""
    return collapse(F.translate(text, CURLY, PLAIN))


def words(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def question_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def normalize_answer(text: Column) -> Column:
    """Lower case, no ASCII punctuation, single spaces; articles stay."""
    return collapse(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""))


def cleanup_answer(text: Column) -> Column:
    out = collapse(F.regexp_replace(text, MARKDOWN, " "))
    for pattern in (ANSWER_PREFIX, LEADING_PHRASE):
        out = F.regexp_replace(out, pattern, "")
    out = F.btrim(out, F.lit("\"'[]() "))
    joined = F.regexp_replace(F.regexp_replace(out, r"(?U)\s*@\s*", "@"), r"(?U)\s*\.\s*", ".")
    out = F.when(F.contains(out, F.lit("@")), joined).otherwise(out)
    for pattern in (ANSWER_PREFIX, LEADING_PHRASE):
        out = F.regexp_replace(out, pattern, "")
    return F.btrim(out, F.lit(" ,;:."))


def answer_options(field: Column) -> Column:
    """Gold alternatives of a field parted by |, cleaned, without empty ones."""
    return F.filter(F.transform(F.split(field, r"\|"), cleanup_answer), lambda x: x != "")


def gold_answers(field: Column) -> Column:
    """Gold alternatives as they stand, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(field, r"\|"), collapse_ends), lambda x: x != "")


def collapse_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_words(title: Column, text: Column) -> Column:
    """A given title, else the first 16 words of the first sentence."""
    head = F.array_join(F.slice(words(F.get(F.split(text, r"[.!?]", 2), F.lit(0))), 1, 16), " ")
    return F.coalesce(F.nullif(collapse(title), F.lit("")), head)


def title_case(text: Column) -> Column:
    """Capital after anything that isn't a letter, small letters otherwise."""
    after_letter = lambda low, i: (i > 0) & F.coalesce(F.get(low, i - 1), F.lit("")).rlike(r"^\p{L}$")
    return let(F.split(F.lower(text), ""), lambda low: F.array_join(F.transform(low, lambda c, i: F.when(after_letter(low, i), c).otherwise(F.upper(c))), ""))


def preview(text: Column, limit: int = 260) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("...")))


def yes_no(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    negative = F.lit(False)
    for cue in NEGATIVE_CUES:
        negative = negative | F.contains(padded, F.lit(cue))
    return F.when(negative, "No").when(F.contains(padded, F.lit(" yes ")), "Yes")


def course_code(text: Column) -> Column:
    clean, pattern = cleanup_answer(text), r"^([A-Za-z]{2,8})\s*-?\s*(\d{1,3}[A-Z]?)$"
    return F.when(clean.rlike(pattern), F.upper(F.concat_ws(" ", F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)))).otherwise(clean)


def degree_text(text: Column) -> Column:
    out = cleanup_answer(text)
    for pattern, name in DEGREES:
        out = F.regexp_replace(out, pattern, name)
    return out


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<hit, start>>, start counting characters from 0; the pattern has no group that captures."""
    none = F.array().cast("array<struct<hit:string,start:int>>")

    def walk(v: Column) -> Column:
        hits, gaps = v["hits"], v["gaps"]
        step = lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get(gaps, i)) + F.length(F.get(hits, i))).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.get(hits, i).alias("hit"), (acc["at"] + F.length(F.get(gaps, i))).alias("start")))).alias("out"),
        )
        found = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(hits) - 1, F.lit(0))), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.when(F.size(hits) == 0, none).otherwise(found)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits"), F.split(text, pattern, -1).alias("gaps")), walk)


def context(text: Column, start: Column, length: Column, radius: int = 90) -> Column:
    """The text around a match, collapsed."""
    first = F.greatest(start - radius, F.lit(0))
    return collapse(F.substring(text, first + 1, start + length + radius - first))
