"""Readers and writers of JSON lines, text lines, nested JSON and CSV, with the order of lines where it matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomline.functions import text as X
from loomline.operators import corpus
from loomline.operators.evaluate import refuse

TEXT_KEYS = ("summary", "text", "clean_text", "content", "page_text")
LOOSE = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "title", *TEXT_KEYS, "chunk_id")] + [T.StructField("chunk_index", T.LongType())])
QA = T.StructType([T.StructField(c, T.StringType()) for c in ("question", "answer", "url")])
SQUAD = "version string, data array<struct<paragraphs:array<struct<qas:array<struct<id:string,answers:array<struct<text:string>>>>>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of one text file in order, blank lines kept; a line feed at the end of the file opens no line.

    The file is read as one value, so it is meant for lists of questions and answers, not for a corpus.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), "\n$", "").alias("v"))
    return whole.select(F.posexplode(F.split("v", "\n")).alias("pos", "line"))


def read_questions(spark: SparkSession, path: str, skip_blank: bool = False) -> DataFrame:
    """(pos, question) of JSON lines, where a missing question is "unknown", or of text lines; blank text lines are kept unless skipped."""
    lines = numbered_lines(spark, path)
    if path.endswith(".jsonl"):
        rows = lines.where(F.trim("line") != "").select("pos", F.coalesce(F.nullif(F.trim(F.from_json("line", QA)["question"]), F.lit("")), F.lit("unknown")).alias("question"))
    else:
        rows = lines.select("pos", F.trim("line").alias("question"))
        rows = rows.where("question <> ''") if skip_blank else rows
    return rows.select((F.row_number().over(Window.orderBy("pos")) - 1).alias("pos"), "question")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(pos, prediction) by line, blank ones kept."""
    return numbered_lines(spark, path).select("pos", F.trim("line").alias("prediction"))


def read_qa(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(pos, question, answer, url) of JSON lines; strict refuses rows without question or answer, else those without question go."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "").select("pos", F.from_json("line", QA).alias("r")).select("pos", "r.*")
    if strict:
        refuse(rows.where("coalesce(trim(question), '') = '' or coalesce(trim(answer), '') = ''").select("pos"), "rows without question or answer")
        return rows
    return rows.where("coalesce(trim(question), '') <> ''")


def read_knowledge(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ord, question, answer, url) of several files, earlier files first; files that aren't there are passed over."""
    out = None
    for rank, path in enumerate(p for p in paths if exists(spark, p)):
        rows = read_qa(spark, path, strict=False).select((F.lit(rank * 1_000_000_000) + F.col("pos")).alias("ord"), "question", "answer", "url")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "ord long, question string, answer string, url string")


def first_text(*names: str):
    """The first text that isn't blank, stripped."""
    return F.coalesce(*[F.nullif(X.collapse_ends(F.col(n)), F.lit("")) for n in names])


def read_loose(spark: SparkSession, path: str, size: int = 140, overlap: int = 30) -> DataFrame:
    """Chunks (url, title, text, chunk_index) of a loose corpus; rows that are chunks already pass, rows without URL or text go."""
    rows = spark.read.schema(LOOSE).json(path).select("url", "title", first_text(*TEXT_KEYS).alias("text"), "chunk_id", "chunk_index")
    rows = rows.where("coalesce(trim(url), '') <> '' and text is not null").withColumn("title", X.title_words(F.col("title"), F.col("text")))
    ready = F.col("chunk_id").isNotNull() | F.col("chunk_index").isNotNull()
    pieces = F.when(ready, F.array("text")).otherwise(corpus.word_windows(F.col("text"), size, overlap))
    return rows.select("url", "title", "chunk_index", F.posexplode(pieces).alias("at", "text")).select("url", "title", "text", F.coalesce("chunk_index", F.col("at").cast("long")).alias("chunk_index"))


def read_corpora(spark: SparkSession, defaults: list[str], supplements: list[str] = (), **windows: int) -> DataFrame:
    """The first default that is there and all supplements that are, other than it."""
    there = [p for p in defaults if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"none of {defaults}")
    out = read_loose(spark, there[0], **windows)
    for path in supplements:
        if path != there[0] and exists(spark, path):
            out = out.unionByName(read_loose(spark, path, **windows))
    return out


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) of a crawl; a row without either is an error when it is read."""
    rows = spark.read.schema("url string, text string").option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.raise_error(F.lit(f"row without {c}"))).otherwise(F.col(c))
    return rows.select(X.collapse(need("url")).alias("url"), need("text").alias("text"))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """(url, text) of a crawl; the URL must be there, a missing text is empty."""
    rows = spark.read.schema("url string, text string").json(path)
    return rows.select(F.when(F.col("url").isNull(), F.raise_error(F.lit("row without url"))).otherwise(F.col("url")).alias("url"), F.coalesce("text", F.lit("")).alias("text"))


def read_squad(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SQUAD).option("multiLine", True).json(path)
    refuse(rows.where("version is null or data is null").select("version"), "no SQuAD data set")
    return rows


def read_squad_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction) of one JSON object."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return rows.select(F.explode("m").alias("id", "prediction"))


def read_urls(spark: SparkSession, path: str | None) -> DataFrame:
    """Distinct URLs of JSON lines; none without a path."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], "url string")
    return spark.read.schema("url string").json(path).where("url is not null").distinct()


def write_lines(frame: DataFrame, path: str, column: str, order: str) -> None:
    """One value per line in one file, in order; for lists of questions and answers."""
    frame.select(order, F.regexp_replace(F.col(column), r"[\r\n]+", " ").alias("value")).coalesce(1).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_questions(rows: DataFrame, path: str, order: str = "pos") -> None:
    refuse(rows.where("coalesce(trim(question), '') = ''").select(order), "rows without a question")
    write_lines(rows, path, "question", order)


class _Fetch(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class FetchReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls, self.timeout = [u for u in options.get("urls", "").split("\n") if u], float(options.get("timeout", 10))

    def partitions(self) -> list[InputPartition]:
        return [_Fetch(u) for u in self.urls]

    def read(self, partition: _Fetch):
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(partition.url, headers={"User-Agent": "Mozilla/5.0"}), timeout=self.timeout) as reply:
                yield partition.url, reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")
        except Exception:  # any failure to fetch is a page without HTML
            yield partition.url, None


class FetchSource(DataSource):
    """spark.read.format("fetch").option("urls", "one per line").load(): url, html, null where a page can't be had."""

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return "url string, html string"

    def reader(self, schema: T.StructType) -> FetchReader:
        return FetchReader(self.options)
