"""From a crawl to clean chunks: filters, deduplication, cleaning, sentence and word windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.functions import urls as U

# ---- fixed values
NOISE_PREFIXES = ("categories ", "related links ", "book an appointment", "view photos", "view lectures", "watch the program", "see the winners", "submit an event", "map it", "read more", "read about", "learn more about", "more information about")
NOISE_EXACT = ("in this page", "directory", "quick links", "home", "menu", "search", "skip to main content", "staff contact quick list", "check system status")
LOOSE_PHONE = r"\+?\d[\d()\-\s]{7,}\d"
NAVIGATION_OFFSET = 220
KEY_CHARS = 260
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9])"


def crawl_filter(docs: DataFrame, url: str = "url", text: str = "text", min_chars: int = 75, deny: tuple[str, ...] = ()) -> DataFrame:
    """Rows of enough characters whose URL holds none of the denied parts. Null text is empty; a null URL is refused."""
    keep = F.length(F.coalesce(F.col(text), F.lit(""))) >= min_chars
    for part in deny:
        keep = keep & ~F.contains(F.col(url), F.lit(part))
    return docs.where(keep & F.col(url).isNotNull())


def first_of(docs: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row, by `order`, of each combination of keys.

    Minima are combined before the shuffle, so a key with very many rows needs no group; rows meet by the order column,
    which must tell rows apart.
    """
    first = docs.groupBy(*[k.alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.min(order).alias(order)).select(order)
    return docs.join(first, order, "left_semi")


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "ord") -> DataFrame:
    """The first row of each text, by 256 bits of it."""
    return first_of(docs, [F.unhex(F.sha2(F.col(text), 256))], order)


def chunk_dedup(chunks: DataFrame, url: str = "url", text: str = "text", order: str = "ord") -> DataFrame:
    """The first chunk of each URL and beginning of the collapsed text, both without regard to case."""
    return first_of(chunks, [F.lower(F.col(url)), F.lower(F.substring(X.collapse(F.col(text)), 1, KEY_CHARS))], order)


def word_windows(text: Column, size: int = 140, overlap: int = 30) -> Column:
    """Windows of words at steps of size - overlap; the last may lie within the one before."""
    step, none = max(1, size - overlap), F.array().cast("array<string>")
    cut = lambda words: F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))
    return X.let(X.words(text), lambda words: F.when(F.size(words) == 0, none).otherwise(cut(words)))


def word_chunks(docs: DataFrame, text: str = "text", size: int = 140, overlap: int = 30) -> DataFrame:
    """One row per window: the other columns, chunk_index and text."""
    rest = [F.col(c) for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(word_windows(F.col(text), size, overlap)).alias("chunk_index", text))


def strip_navigation(text: Column, markers: tuple[str, ...]) -> Column:
    """Cut at each marker whose first occurrence is far enough in."""
    def cut(marker: str) -> Callable[[Column], Column]:
        return lambda t: F.when(F.locate(marker, t) > NAVIGATION_OFFSET, F.regexp_replace(F.substring(t, F.lit(1), F.locate(marker, t) - 1), r"(?U)\s+$", "")).otherwise(t)

    for marker in markers:
        text = X.let(text, cut(marker))
    return text


def strip_inline(text: Column, phrases: tuple[str, ...]) -> Column:
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(" "))
    return X.collapse_plain(text)


def sentences(text: Column) -> Column:
    """Sentences end at . ! or ? and white space before a capital or digit."""
    return F.filter(F.split(X.collapse_plain(text), SENTENCE_END), lambda s: s != "")


_NOISE = "^(?:(?:" + "|".join(re.escape(x) for x in NOISE_PREFIXES) + ")|(?:" + "|".join(re.escape(x) for x in NOISE_EXACT) + r")\z)"


def is_noise(sentence: Column) -> Column:
    """By one pattern each, since lambdas compute every expression again wherever it stands."""
    short = ~sentence.rlike(r"(?U)\S\s+\S+\s+\S") & ~sentence.rlike(R.EMAIL) & ~sentence.rlike(LOOSE_PHONE)
    return (sentence == "") | F.lower(sentence).rlike(_NOISE) | short


def distinct_sentences(items: Column) -> Column:
    """First of each sentence without regard to case, in order: sorted by small form and place, so that repeats stand together."""
    ranked = F.array_sort(F.transform(items, lambda s, i: F.struct(F.lower(s).alias("key"), i.alias("i"), s.alias("s"))))
    first = lambda r: F.filter(r, lambda x, i: (i == 0) | (x["key"] != F.get(r, i - 1)["key"]))
    back = lambda f: F.transform(F.array_sort(F.transform(f, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])
    return back(X.let(ranked, first))


def clean_documents(docs: DataFrame, site: R.SiteRules | None = None, min_chars: int = 80) -> DataFrame:
    """Clean documents (url, title, text, word_count and the other columns) of at least so many characters.

    Null texts count as empty and so are dropped.
    """
    site = site or R.SiteRules()
    stripped = strip_inline(strip_navigation(X.collapse_plain(F.coalesce("text", F.lit(""))), site.navigation_markers), site.inline_noise)
    rest = [F.col(c) for c in docs.columns if c not in ("text", "title", "word_count")]
    staged = docs.select(*rest, sentences(stripped).alias("s")).select(*rest, F.filter("s", lambda s: ~is_noise(s)).alias("s"))
    # the outer form of a generator, so that no filter computes the texts once more
    whole = F.filter(F.array(F.array_join(distinct_sentences(F.col("s")), " ")), lambda t: F.length(t) >= min_chars)
    staged = staged.select(*rest, F.explode_outer(whole).alias("text")).where("text is not null")
    # a clean text is plain and collapsed, so its first sentence ends where it first may
    first = F.btrim(F.get(F.split("text", SENTENCE_END, 2), F.lit(0)), F.lit(" -"))
    good = lambda x: X.n_words(x).between(1, 12) & ~x.rlike(R.EMAIL) & ~x.rlike(LOOSE_PHONE)
    title = F.coalesce(X.let(first, lambda x: F.when(good(x), x)), U.slug_title(F.col("url"), site.home_title))
    return staged.select(*rest, title.alias("title"), "text", X.n_words(F.col("text")).alias("word_count"))


def pack_sentences(items: list[str], min_words: int, max_words: int, overlap: int, slack: int = 30, window_overlap: int = 25) -> list[str]:
    """Sentences packed into chunks: one ends where it has min_words and the next sentence would pass max_words; the
    next begins `overlap` sentences back. A chunk of over max_words + slack words becomes windows of words."""
    out, sizes, start = [], [len(s.split()) for s in items], 0
    while start < len(items):
        end, total = start, 0
        while end < len(items) and not (total >= min_words and total + sizes[end] > max_words):
            total, end = total + sizes[end], end + 1
        words = " ".join(items[start:end]).split()
        if len(words) <= max_words + slack:
            out.append(" ".join(words))
        else:
            step = max(1, max_words - window_overlap)
            last = max(0, -(-(len(words) - max_words) // step))
            out += [" ".join(words[k * step : k * step + max_words]) for k in range(last + 1)]
        if end >= len(items):
            break
        start = max(start + 1, end - overlap)
    return [chunk for chunk in out if chunk]


def packed_sentences(text: Column, min_words: int = 45, max_words: int = 140, overlap: int = 1) -> Column:
    """Chunks of a clean text. Packing depends on where the chunk before ended, so it runs in Arrow batches, one document
    at a time."""

    @F.pandas_udf("array<string>")
    def packed(column: pd.Series) -> pd.Series:
        return column.map(lambda items: pack_sentences(list(items) if items is not None else [], min_words, max_words, overlap))

    return packed(sentences(text))


def sentence_chunks(docs: DataFrame, min_words: int = 45, max_words: int = 140, overlap: int = 1) -> DataFrame:
    """Chunks of clean documents: chunk_id, url, title, text, chunk_index, word_count."""
    rows = docs.select("url", "title", F.posexplode(packed_sentences(F.col("text"), min_words, max_words, overlap)).alias("chunk_index", "text"))
    return rows.select(F.concat_ws("#chunk-", "url", F.col("chunk_index").cast("string")).alias("chunk_id"), "url", "title", "text", "chunk_index", X.n_words(F.col("text")).alias("word_count"))


SPAN_ENDS = r"(?U)(?<=[.!?])\s+|\s*[;|]\s*|\n+"
ANCHORS = rf"(?U)(?=\b[\w.+-]+@[\w.-]+\.[A-Za-z]{{2,}}\b)|(?=\b(?:18|19|20)\d{{2}}(?:\s*[-–]\s*\d{{2,4}})?\b)|(?=\b{R.PHONE_BODY}\b)"


def spans(text: Column, long_words: int = 24) -> Column:
    """Pieces of text to read answers from; long ones are cut again before e-mail addresses, years and phone numbers."""
    parts = F.filter(F.transform(F.split(text, SPAN_ENDS), X.collapse), lambda s: s != "")
    cut = lambda s: F.filter(F.transform(F.split(s, ANCHORS), X.collapse), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda s: F.when(X.n_words(s) > long_words, cut(s)).otherwise(F.array(s))))


class _Text(HTMLParser):
    SKIP, BLOCK = {"script", "style", "noscript", "template"}, {"p", "div", "li", "br", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "title", "article", "section", "header", "footer", "nav"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.SKIP
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.SKIP and self.hidden > 0
        if tag in self.BLOCK:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(html: str | None) -> str:
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def html_to_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with a text column of the visible text instead of the HTML."""

    @F.pandas_udf("string")
    def visible(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in column:
            yield part.map(html_text)

    return pages.withColumn("text", visible(F.col(html))).drop(html)


def cleaning_stats(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Raw and clean documents and the chunks of these, which are cleaned once for both counts."""
    made = clean.select(F.size(packed_sentences(F.col("text"))).alias("n")).agg(F.count("*").alias("clean_documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    return raw.agg(F.count("*").alias("raw_documents")).crossJoin(made)


def kept_and_removed(docs: DataFrame, kept: DataFrame) -> DataFrame:
    both = docs.agg(F.count("*").alias("n")).crossJoin(kept.agg(F.count("*").alias("kept")))
    return both.select("kept", (F.col("n") - F.col("kept")).alias("removed"))


def rank_within(frame: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
