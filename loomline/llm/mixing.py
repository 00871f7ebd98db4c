"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source has the same expected number of copies, target / size of the source. The documents of a
source stand in order of size, so that the copies taken at even steps also take an even share of the words; the
prefix sum of expected copies is then rank * copies, shifted by one random offset for the source, and a document is
emitted once for each whole number that its step crosses.

Ranks come from counts instead of one window over a source: documents are dealt by (source, size, bucket of the id);
counts for each such group are summed before the shuffle and turned into the rank of its first document by windows
over counts alone. No task holds more than one group, and buckets multiply with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows for which another bucket of ids is added.
BUCKET_ROWS = 1 << 20


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target` to one row per (source, source_size): weights repeat over sources by code point, null last.

    The targets share out `share` times all sizes by weight, none above `most` times its source: with w the level at
    which sources in order of most * size / weight stop to be full, a target is the smaller of its limit and w * weight.
    That is what resharing the excess by weight ends in. Sources without words get nothing.
    """
    # one row per source: these windows see no documents
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    known = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    filled = F.coalesce(F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = known.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole)).withColumn("level", (F.col("budget") - filled) / open_weight).withColumn("place", F.row_number().over(by_level))
    # the first source that the level of those from it on doesn't fill sets the level for all later ones
    first = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct("place", "level"))).over(whole)
    return level.withColumn("first", first).withColumn("target", F.when(F.col("first").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("first.level") * F.col("weight")))).select("source", "source_size", "target")


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, from 0 to under 1, the same in every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which null keys are equal; the keys come once."""
    renamed = b.select(*[F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in b.columns])
    return a.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "inner").drop(*[f"_{k}" for k in keys])


def mix_sources(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (of its source), copies, taken (words).

    Null and empty texts have size 0 and can be emitted without taking a word; a null source is a source of its own,
    the last in order. Ties in size are put in order of the id (null first); rows that agree in all of these are alike,
    so which of them is emitted doesn't matter. Columns named in `keep` are handed on under the name keep_<name>; others
    are ignored, whatever their names. An empty table, or one without any word, gives copies of 0.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    n_rows = docs.count()
    n_buckets = n_rows // BUCKET_ROWS + 1
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets)) if n_buckets > 1 else F.lit(0).cast("long")
    rows = rows.withColumn("bucket", bucket)
    key = ["source", "size", "bucket"]
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("in_size", F.coalesce(F.sum("n").over(in_size), F.lit(0)))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.withColumn("in_source", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
    sizes = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    goal = targets(sizes, weights, share, most)
    left = _joined(by_size.select("source", "size", "in_source"), goal, ["source"])
    start = _joined(counts, left, ["source", "size"]).select(*key, (F.col("in_size") + F.col("in_source")).alias("before"), "source_size", "target")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("doc_id")))
    placed = _joined(ranked, start, key)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    step = lambda k: F.floor((F.col("before") + F.col("rank") - k) * F.col("each") + F.col("offset"))
    out = placed.withColumn("each", each).withColumn("offset", offset(F.col("source"), seed)).withColumn("copies", (step(0) - step(1)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[f"keep_{c}" for c in keep])


#: DuckDB SQL for the query; {{buckets}} of the operator are 1 below BUCKET_ROWS rows.
SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS lim FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
  row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place FROM w),
f AS (SELECT arg_min(level, place) FILTER (level * weight < lim) AS level FROM l),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN lim ELSE least(lim, f.level * weight) END AS target FROM l, f),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) AS rank FROM d),
x AS (SELECT doc_id, size, source_size, target, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
  ('0x' || substr(md5('mix:' || coalesce('s' || r.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rank * each + u) - floor((rank - 1) * each + u))::BIGINT * size)::BIGINT AS taken FROM x
"""
