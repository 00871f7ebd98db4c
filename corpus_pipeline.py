"""A training corpus from raw documents: five stages, each of one operator, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.decontaminate import find_leaks
from loomline.llm.jaccard_join import similar_documents
from loomline.llm.mixing import mix_sources
from loomline.llm.shared import checkpoint_dir, kept
from loomline.llm.token_files import read_digests, scratch_folder, write_tokens
from loomline.llm.toxicity import score_toxicity
from loomline.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.7."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), threshold=0.7, keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def _row_key() -> Column:
    """A text that names a row and sorts by its id, null ids last; rows have the same one only if they are equal."""
    place = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    own = F.lpad(F.hex(F.xxhash64(*COLUMNS, *[F.col(c).isNull() for c in COLUMNS])), 16, "0")
    return F.concat(F.when(F.col("doc_id").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), place)), F.lit("-"), own)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that of the smallest id (null ids last), whatever ids are repeated.

    Rows without words are in no group and all stay. Of equal rows that are chosen one stays; only these are shuffled.
    """
    rows = docs.select(*COLUMNS, _row_key().alias("row_key"))
    found = kept(similar_documents(rows, doc_id="row_key", width=5, percent=80).where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count("*").alias("n")))
    gone = found.where("doc_id <> component_id or n > 1").select(F.col("doc_id").alias("row_key"))
    again = found.where("doc_id = component_id and n > 1").select(F.col("doc_id").alias("row_key"))
    alone = rows.join(gone, "row_key", "left_anti").select(*COLUMNS)
    return alone.unionByName(rows.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any test item: one leaked item is enough to go."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), width=8, min_items=1, keep=COLUMNS[2:])
    return found.where("not contaminated").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_sources(docs, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0, keep=COLUMNS)
    repeated = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*[F.col(f"keep_{c}").alias(c) for c in COLUMNS])


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document in segments, and what the segments say when they are read back."""
    folder = scratch_folder(spark)
    write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return read_digests(spark, folder)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_similar),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("token_output", write_token_files),
]

#: Neither the classifier, the components nor the tokens can be said in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/loomline-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
