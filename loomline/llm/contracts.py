"""One thin query for each operator, with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomline.llm import chat, mixing
from loomline.llm.decontaminate import find_leaks
from loomline.llm.jaccard_join import similar_documents
from loomline.llm.line_dedup import near_lines
from loomline.llm.neighbours import nearest
from loomline.llm.sharding import shard_documents
from loomline.llm.substring_dedup import repeated_windows
from loomline.llm.token_files import read_digests, scratch_folder, write_tokens
from loomline.llm.toxicity import score_toxicity
from loomline.sources.tables import table


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents"), width=35).select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines(table(spark, sf_dir, "documents"), percent=80)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), width=5, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=8, min_items=2)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3.0, 1.0, 2.0), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408, end_id=2)
    return read_digests(spark, folder)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)
    return scored.select("doc_id", "held_out", "score", "predicted", "lang_threshold", "toxic")


QUERIES: dict = {
    "op1_chat_formatting": (chat.chat_records, chat.SQL),
    "op2_line_dedup": (op2_line_dedup, None),
    "op3_substring_dedup": (op3_substring_dedup, None),
    "op4_sharding": (op4_sharding, None),
    "op5_ngram_jaccard_join": (op5_ngram_jaccard_join, None),
    "op6_decontamination": (op6_decontamination, None),
    "op7_mixing": (op7_mixing, mixing.SQL),
    "op8_neighbours": (op8_neighbours, None),
    "op9_token_output": (op9_token_output, None),
    "op10_toxicity": (op10_toxicity, None),
}
