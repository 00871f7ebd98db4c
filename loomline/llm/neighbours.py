"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes come from principal directions turned by learned rotations (iterative quantisation), fitted on a bounded sample.
A code is cut into substrings of 8 bits, each with its own table from value to rows. Codes within R differ in at most
R / m bits in one of m substrings, so probing each table with all values that near, and one less in the later tables,
retrieves every code within R; those candidates are ranked by the true distance. R is the radius that holds the
wanted share of true neighbours within the sample; among all rows neighbours are nearer, so it holds more.

Rows and queries are dealt into blocks and every block of rows meets every block of queries, with the tables built for
the block at hand, so memory depends on the block sizes alone. Each meeting hands on a few rows for each query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS, ROTATIONS, STEPS = 20_000, 2, 25
BLOCK_ROWS, QUERY_ROWS = 8192, 1024
_BITS = np.array([bin(k).count("1") for k in range(256)], dtype=np.uint8)
#: Distance of each two values of a substring.
_APART = _BITS[np.arange(256)[:, None] ^ np.arange(256)[None]]


class Coder:
    """Turns vectors into codes of bytes."""

    def __init__(self, sample: np.ndarray, seed: int = 5) -> None:
        rng, dims = np.random.default_rng(seed), sample.shape[1]
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        inside, turns = centred @ axes, []
        for _ in range(ROTATIONS):
            turn = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
            for _ in range(STEPS):
                left, _, right = np.linalg.svd(np.where(inside @ turn > 0, 1.0, -1.0).T @ inside)
                turn = (left @ right).T
            turns.append(axes @ turn)
        self.turn = np.concatenate(turns, axis=1)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _BITS[a ^ b].sum(axis=-1, dtype=np.int32)


def radius_for(vectors: np.ndarray, codes: np.ndarray, k: int, share: float, n_queries: int = 256) -> int:
    """The smallest radius that holds that share of the k nearest within the sample."""
    inside = []
    for q in range(0, len(vectors), max(1, len(vectors) // n_queries)):
        near = ((vectors - vectors[q]) ** 2).sum(axis=1)
        near[q] = np.inf
        best = np.argsort(near, kind="stable")[: min(k, len(vectors) - 1)]
        inside.append(hamming(codes[best], codes[q]))
    found = np.concatenate(inside) if inside else np.zeros(0)
    return int(np.quantile(found, share, method="higher")) if len(found) else 0


class Tables:
    """For each substring, the rows of a block in order of its value."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes, self.order, self.begin = codes, [], []
        for t in range(codes.shape[1]):
            self.order.append(np.argsort(codes[:, t], kind="stable"))
            self.begin.append(np.searchsorted(codes[self.order[t], t], np.arange(257)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is that near, by probing."""
        m = len(code)
        near, rest = divmod(radius, m)
        seen = np.zeros(len(self.codes), dtype=bool)
        for t in range(m):
            reach = near if t <= rest else near - 1
            if reach < 0:
                continue
            for value in np.flatnonzero(_APART[code[t]] <= reach).tolist():
                seen[self.order[t][self.begin[t][value] : self.begin[t][value + 1]]] = True
        rows = np.flatnonzero(seen)
        return rows[hamming(self.codes[rows], code) <= radius]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, every: int, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", share: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row whose id is divisible by `every`.

    Candidates are all other rows; the score is the Euclidean distance in double precision; ties go to the smaller id.
    Vectors that are null, empty, zero, not of the commonest length, or hold nulls or non-finite numbers take no part,
    nor do rows without an id; rows that repeat an id are candidates of their own, but not for a query of that id, which
    is asked once. If fewer than k candidates exist, all are returned. Other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == lengths["n"])
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "v").limit(SAMPLE_ROWS).collect()])
    coder = Coder(sample)
    radius = radius_for(sample, coder(sample), k, share)
    n_blocks, n_query_blocks = lengths["c"] // BLOCK_ROWS + 1, asked.count() // QUERY_ROWS + 1

    def meet(key: tuple, block: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if block.num_rows and queries.num_rows:
            ids, vectors, names, points = block.column("vec_id").to_numpy(), _matrix(block.column("v")), queries.column("vec_id").to_numpy(), _matrix(queries.column("v"))
            tables, codes = Tables(coder(vectors)), coder(points)
            for name, point, code in zip(names, points, codes, strict=True):
                wide, most = radius, 8 * codes.shape[1]
                while True:
                    found = tables.within(code, wide)
                    found = found[ids[found] != name]
                    if len(found) >= k or wide >= most:
                        break
                    wide = min(most, wide + 8)
                score = np.sqrt(((vectors[found] - point) ** 2).sum(axis=1))
                best = np.lexsort((ids[found], score))[:k]
                out[0].append(np.full(len(best), name))
                out[1].append(ids[found][best])
                out[2].append(score[best])
        columns = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float64))], names=["query_id", "vec_id", "score"])

    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int")).withColumn("part", spread(n_query_blocks))
    right = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int")).withColumn("block", spread(n_blocks))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(meet, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
