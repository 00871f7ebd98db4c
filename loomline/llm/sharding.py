"""Sharding by longest-processing-time scheduling of groups that must stay together.

Groups of equal texts, sorted by their size, go one after the other to the least-loaded shard of a heap. Groups of
one size are interchangeable, so the schedule needs only how many groups there are of each size: the heap then hands
out whole counts, which is the same schedule as one group at a time. Distinct sizes with a sum of T are fewer than the
square root of 2 T; the driver reads them in order, a partition at a time, holds the loads of the shards alone, and
writes the schedule to shared storage in pieces of PIECE rows. Each group finds its shard by its rank among
the groups of its size; ranks and slots come from counts by bucket, not from one window over all rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable, Iterator
from itertools import batched

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.shared import checkpoint_dir

#: Rows for which another bucket is added.
BUCKET_ROWS = 1 << 20
#: Rows of the schedule that the driver holds at once.
PIECE = 100_000
SCHEDULE = "group_size long, shard int, first long, end long"


def lpt_counts(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, int, int, int]]:
    """(size, shard, first rank, end rank) of groups given as (size, number of groups), the largest size first.

    A shard of load x takes groups of one size at the levels x, x + size, x + 2 size and so on; popping a heap takes the
    n lowest levels of all shards, ties by the number of the shard. For few groups the heap itself is run; for many,
    the level up to which all are taken is found by bisection, which gives the same counts.
    """
    loads = [0] * shards
    for size, n in sizes:
        given = [0] * shards
        if n > 8 * shards:
            low, high = min(loads) - 1, max(loads) + size * n
            while low < high:
                level = (low + high + 1) // 2
                if sum(max(0, (level - x) // size + 1) for x in loads) <= n:
                    low = level
                else:
                    high = level - 1
            given = [max(0, (low - x) // size + 1) for x in loads]
        heap = [(x + g * size, k) for k, (x, g) in enumerate(zip(loads, given, strict=True))]
        heapq.heapify(heap)
        for _ in range(n - sum(given)):
            load, k = heapq.heappop(heap)
            given[k] += 1
            heapq.heappush(heap, (load + size, k))
        at = 0
        for k, g in enumerate(given):
            if g:
                yield size, k, at, at + g
            at += g
            loads[k] += g * size


def _schedule(by_size: DataFrame, shards: int) -> DataFrame:
    """lpt_counts of (group_size, n) as a table; more than one piece goes through shared storage."""
    spark, folder = by_size.sparkSession, None
    rows = ((r["group_size"], r["n"]) for r in by_size.orderBy(F.desc("group_size")).toLocalIterator())
    for k, piece in enumerate(batched(lpt_counts(rows, shards), PIECE)):
        found = spark.createDataFrame(list(piece), SCHEDULE)
        if k == 0 and len(piece) < PIECE:
            return found
        folder = folder or f"{checkpoint_dir(spark)}/loomline-schedule-{uuid.uuid4().hex}"
        found.write.parquet(f"{folder}/piece={k}")
    return spark.read.parquet(folder).select("group_size", "shard", "first", "end") if folder else spark.createDataFrame([], SCHEDULE)


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes and 1), text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Equal texts share a shard; null and empty texts are equal, of size 1. Slots count from 0 without a gap within each
    shard. Ties between groups of one size go by the hash of the text. Repeated rows and null ids are rows like others.
    Only `text` and `doc_id` are read, whatever other columns are called; an empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(value).cast("long") + 1).alias("size"), F.crc32(value.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(value, 256)).alias("group"))
    n_buckets = docs.count() // BUCKET_ROWS + 1
    bucket = F.pmod(F.xxhash64("group"), F.lit(n_buckets)) if n_buckets > 1 else F.lit(0).cast("long")
    groups = rows.groupBy("group").agg(F.sum("size").alias("group_size")).withColumn("bucket", bucket)
    counts = groups.groupBy("group_size", "bucket").agg(F.count("*").alias("n"))
    by_size = counts.groupBy("group_size").agg(F.sum("n").alias("n"))
    plan = _schedule(by_size, shards)
    order = Window.partitionBy("group_size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("group_size", "bucket").orderBy("group")) - 1
    ranked = groups.withColumn("rank", rank).join(before, ["group_size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    chosen = ranked.join(plan, (ranked["group_size"] == plan["group_size"]) & (ranked["rank"] >= plan["first"]) & (ranked["rank"] < plan["end"])).select("group", "shard")
    placed = rows.join(chosen, "group").withColumn("law", F.lit("bytes"))
    slot_bucket = F.pmod(F.xxhash64("doc_id"), F.lit(max(32, n_buckets)))
    placed = placed.withColumn("slot_bucket", slot_bucket)
    filled = placed.groupBy("shard", "slot_bucket").agg(F.count("*").alias("n"))
    slots = Window.partitionBy("shard").orderBy("slot_bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = filled.withColumn("before", F.coalesce(F.sum("n").over(slots), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("shard", "slot_bucket").orderBy("doc_id", "group")) - 1
    out = placed.withColumn("within", within).join(filled, ["shard", "slot_bucket"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("within") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
