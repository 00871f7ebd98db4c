"""Scalar text and URL functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.functions import urls as U
from loomline.operators import index
from loomline.plans.retrieval import WS, sql_collapse, sql_tokens, sql_words
from loomline.sources.tables import table


def over(name: str, *columns: Callable[[], list]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that selects columns of one table; they are made once there is a session."""
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(*[c for make in columns for c in make()])


TEXT, ITEM, TURN = F.col, "item_id", "text"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
PREFIX = r"^(?:answer|short answer|final answer|response)\s*[:\-]\s*"
LEAD = r"^(?:the answer is|it is|it''s|this is|the page says)\s+"


def sql_clean(x: str) -> str:
    a = f"trim(regexp_replace(regexp_replace({x}, '[*_`#>]+', ' ', 'g'), '{WS}+', ' ', 'g'))"
    for p in (PREFIX, LEAD):
        a = f"regexp_replace({a}, '{p}', '', 'i')"
    a = f"trim({a}, '\"''[]() ')"
    a = f"CASE WHEN contains({a}, '@') THEN regexp_replace(regexp_replace({a}, '{WS}*@{WS}*', '@', 'g'), '{WS}*\\.{WS}*', '.', 'g') ELSE {a} END"
    for p in (PREFIX, LEAD):
        a = f"regexp_replace({a}, '{p}', '', 'i')"
    return f"trim({a}, ' ,;:.')"


def said(text):
    return F.concat(F.lit('**Short answer: The answer is "'), text, F.lit('" (see a @ b . org).'))


SAID = "'**Short answer: The answer is \"' || text || '\" (see a @ b . org).'"
STOP = "[" + ", ".join(f"'{w}'" for w in R.STOP_WORDS) + "]"


def sql_focus(x: str) -> str:
    return f"list_filter({sql_tokens(x)}, lambda t: NOT list_contains({STOP}, t))"


FOCUS = sql_focus("text")


def sql_types(x: str) -> str:
    parts = []
    for name, starts, cues in R.TYPE_CUES:
        test = " OR ".join([f"contains(lower({x}), '{c}')" for c in cues] + [f"starts_with(lower({x}), '{s}')" for s in starts])
        parts.append(f"CASE WHEN {test} THEN '{name}' END")
    parts.append(f"CASE WHEN regexp_matches(lower({x}), '{R.YES_NO_START}') THEN 'yesno' END")
    return f"list_filter([{', '.join(parts)}], lambda t: t IS NOT NULL)"


HOST = "regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':.*$', '')"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
HOST_TERMS = f"array_to_string(list_concat(list_filter(regexp_split_to_array({HOST}, '[.\\-]+'), lambda p: p <> ''), CASE WHEN list_contains(regexp_split_to_array({HOST}, '[.\\-]+'), 'www2') THEN ['legacy', 'legacy_site'] ELSE [] END), ' ')"
PATH_TERMS = f"array_to_string(list_filter(regexp_split_to_array({PATH}, '[/_.\\-]+'), lambda p: p <> ''), ' ')"
FEATURES = "concat_ws(' ', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower({PATH}), '{c}')" for c in cues) + f" THEN '{named}' END" for cues, named in U.PATH_FEATURES) + ")"
PAGE_TYPE = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(url, '{c}')" for c in cues] + ([f"regexp_matches(url, '{p}')"] if p else [])) + f" THEN '{n}'" for n, cues, p in U.PAGE_TYPES) + " ELSE 'general' END"
#: Pages of the test tables have no paths of these kinds, so the kinds are put before what there is.
KINDS = ("/contact", "/academics/", "/people/", "/news/", "/2031/", "/about/", "/connect/", "/research/", "/pubs/techrpts/x.pdf", "/faculty/homepages/", "/book/", "/a_b-c.d//")


#: Each run of letters with a capital first, the rest small.
TITLE = "array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(p, '[-_]+', ' ', 'g')), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"


def _varied() -> list:
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), F.pmod(F.col("page_id"), F.lit(len(KINDS))).cast("int"))
    return [F.col("page_id"), F.concat(F.regexp_replace(F.col("url"), r"^(https?://)", "$1www2."), kind).alias("url")]


VARIED = "(SELECT page_id, regexp_replace(url, '^(https?://)', '\\1www2.') || [" + ", ".join(f"'{k}'" for k in KINDS) + f"][(page_id % {len(KINDS)} + 1)::INT] AS url, html FROM pages)"


def varied(*make: Callable[[], list]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, "pages").select(*_varied()).select(*[c for m in make for c in m()])


def _retrieval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(*_varied(), "html")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return pages.select("page_id", index.retrieval_text(F.col("url"), title, F.col("html")).alias("t"))


C = F.col
QUERIES = {
    "tokenize_stats": (over("documents", lambda: [C("doc_id"), F.size(X.tokens(C("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(X.tokens(C("text")))).cast("long").alias("n_distinct"), X.n_words(C("text")).cast("long").alias("n_words")]), f"SELECT doc_id, len({sql_tokens('text')}) AS n_tokens, len(list_distinct({sql_tokens('text')})) AS n_distinct, len({sql_words('text')}) AS n_words FROM documents"),
    "normalize_space": (over("documents", lambda: [C("doc_id"), F.md5(X.collapse(C("text")).cast("binary")).alias("h"), F.md5(X.collapse_plain(C("text")).cast("binary")).alias("h_plain")]), f"SELECT doc_id, md5({sql_collapse('text')}) AS h, md5({sql_collapse(chr(39).join(['translate(text, ', '‘’“”–—' + chr(0xA0), ', ', chr(39) * 4 + chr(34) * 2 + '-- ', ')']))}) AS h_plain FROM documents"),
    "question_key": (over("benchmark", lambda: [C("item_id"), X.question_key(C("text")).alias("key")]), "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM benchmark"),
    "normalize_answer": (over("conversations", lambda: [C("conv_id"), C("turn"), X.normalize_answer(C("text")).alias("answer")]), f"SELECT conv_id, turn, {sql_collapse(f'regexp_replace(lower(text), {chr(39)}{PUNCTUATION}{chr(39)}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} AS answer FROM conversations"),
    "cleanup_answer": (over("conversations", lambda: [C("conv_id"), C("turn"), X.cleanup_answer(said(C("text"))).alias("said"), X.cleanup_answer(C("text")).alias("plain")]), f"SELECT conv_id, turn, {sql_clean(SAID)} AS said, {sql_clean('text')} AS plain FROM conversations"),
    "answer_options": (over("conversations", lambda: [C("conv_id"), C("turn"), F.array_join(X.answer_options(F.regexp_replace(C("text"), r"\.", " | ")), "/").alias("options"), F.size(X.gold_answers(F.regexp_replace(C("text"), r"\.", " | "))).cast("long").alias("n_gold")]), f"SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(replace(text, '.', ' | '), '|'), lambda x: {sql_clean('x')}), lambda x: x <> ''), '/') AS options, len(list_filter(string_split(replace(text, '.', ' | '), '|'), lambda x: {sql_collapse('x')} <> '')) AS n_gold FROM conversations"),
    "infer_title_words": (over("documents", lambda: [C("doc_id"), X.title_words(F.lit(" "), C("text")).alias("title")]), f"SELECT doc_id, array_to_string(({sql_words(chr(39).join(['regexp_split_to_array(text, ', '[.!?]', ')[1]']))})[1:16], ' ') AS title FROM documents"),
    "preview_text": (over("documents", lambda: [C("doc_id"), X.preview(C("text")).alias("preview")]), f"SELECT doc_id, CASE WHEN length({sql_collapse('text')}) <= 260 THEN {sql_collapse('text')} ELSE rtrim(substr({sql_collapse('text')}, 1, 257)) || '...' END AS preview FROM documents"),
    "yes_no": (over("documents", lambda: [C("doc_id"), X.yes_no(F.concat_ws(" ", F.get(F.array(*[F.lit(x) for x in ("Yes", "that does not", "maybe", "without it")]), F.pmod(C("doc_id"), F.lit(4)).cast("int")), "text")).alias("answer")]), "SELECT doc_id, CASE WHEN " + " OR ".join(f"contains(p, '{c}')" for c in X.NEGATIVE_CUES) + " THEN 'No' WHEN contains(p, ' yes ') THEN 'Yes' END AS answer FROM (SELECT doc_id, ' ' || lower(['Yes', 'that does not', 'maybe', 'without it'][(doc_id % 4 + 1)::INT] || ' ' || text) || ' ' AS p FROM documents)"),
    "course_and_degree": (over("documents", lambda: [C("doc_id"), X.course_code(F.concat(F.lit("cs - "), F.pmod(C("doc_id"), F.lit(1000)).cast("string"), F.lit("B"))).alias("course"), X.degree_text(F.concat(F.lit("the M S or b.a. "), C("doc_id").cast("string"))).alias("degree")]), "SELECT doc_id, 'CS ' || (doc_id % 1000) || 'B' AS course, 'the M.S. or B.A. ' || doc_id AS degree FROM documents"),
    "question_types": (over("documents", lambda: [C("doc_id"), F.array_join(R.question_types(C("text")), ",").alias("types")]), f"SELECT doc_id, array_to_string({sql_types('text')}, ',') AS types FROM documents"),
    "focus_terms": (over("benchmark", lambda: [C("item_id"), F.array_join(F.array_sort(R.focus_terms(C("text"))), " ").alias("terms"), F.array_join(R.focus_list(C("text")), " ").alias("in_order")]), f"SELECT item_id, array_to_string(list_sort(list_distinct({FOCUS})), ' ') AS terms, array_to_string({FOCUS}, ' ') AS in_order FROM benchmark"),
    "focus_bigrams": (over("benchmark", lambda: [C("item_id"), F.explode(R.focus_ngrams(C("text"))).alias("bigram")]), f"SELECT DISTINCT item_id, f[i] || ' ' || f[i + 1] AS bigram FROM (SELECT item_id, f, unnest(range(1, len(f))) AS i FROM (SELECT item_id, {FOCUS} AS f FROM benchmark))"),
    "query_variants": (over("benchmark", lambda: [C("item_id"), F.explode(R.query_variants(F.concat(F.lit("Who is the Director in Cory Hall, "), C("text")))).alias("v")]), None),
    "url_path_terms": (varied(lambda: [C("page_id"), U.path_terms(C("url")).alias("terms")]), f"SELECT page_id, {PATH_TERMS} AS terms FROM {VARIED}"),
    "url_host_terms": (varied(lambda: [C("page_id"), U.host(C("url")).alias("host"), U.host_terms(C("url")).alias("terms")]), f"SELECT page_id, {HOST} AS host, {HOST_TERMS} AS terms FROM {VARIED}"),
    "url_features": (varied(lambda: [C("page_id"), U.features(C("url")).alias("features"), U.key(C("url")).alias("key")]), f"SELECT page_id, {FEATURES} AS features, regexp_replace(url, '/+$', '') AS key FROM {VARIED}"),
    "url_families": (varied(lambda: [C("page_id"), *[U.family(C("url"), n).alias(n) for n in U.FAMILIES]]), "SELECT page_id, " + ", ".join("(" + " OR ".join(f"contains(lower(url), '{c}')" for c in cues) + f") AS {n}" for n, cues in U.FAMILIES.items()) + f" FROM {VARIED}"),
    "page_type": (varied(lambda: [C("page_id"), U.page_type(C("url")).alias("page_type")]), f"SELECT page_id, {PAGE_TYPE} AS page_type FROM {VARIED}"),
    "slug_title": (varied(lambda: [C("page_id"), U.slug_title(C("url")).alias("title")]), f"SELECT page_id, CASE WHEN p = '' OR p = h THEN 'Home' ELSE {TITLE} END AS title FROM (SELECT page_id, {HOST} AS h, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS p FROM {VARIED})"),
    "retrieval_text": (_retrieval_text, f"SELECT page_id, {sql_collapse(f'concat_ws({chr(39)} {chr(39)}, t, t, {HOST_TERMS}, {PATH_TERMS}, {FEATURES}, html)')} AS t FROM (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM {VARIED})"),
}
