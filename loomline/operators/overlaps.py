"""Pairs of token sets by how much they share, found in blocks: all pairs are counted, but only those asked for leave a task.

Every block of one side meets every block of the other in one task; common tokens are counted there by a matrix product
for the most frequent tokens and by lists for the rest. Work grows with the product of both sides, what is shuffled is a
copy of a side for each 32,768 sets of the other, and memory holds one pair of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Sets of a block; those of each side counted at a time; tokens by matrix product.
SIZE, ROWS, COLUMNS, DENSE = 32_768, 512, 4_096, 64


class Side:
    """Token sets in rows, by codes of tokens from 0."""

    def __init__(self, codes: np.ndarray, size: np.ndarray, dense: np.ndarray) -> None:
        rows = np.repeat(np.arange(len(size)), size)
        column = dense[codes]
        self.size, self.first = size, np.append(0, np.cumsum(np.bincount(rows[column < 0], minlength=len(size))))
        self.matrix = np.zeros((len(size), DENSE), np.float32)
        self.matrix[rows[column >= 0], column[column >= 0]] = 1
        self.codes, self.rows = codes[column < 0], rows[column < 0]


def encoded(left: pa.ListArray, right: pa.ListArray) -> tuple[Side, Side, int]:
    sizes = [np.diff(x.offsets.to_numpy()) for x in (left, right)]
    codes = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode()
    n, codes = len(codes.dictionary), codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    a, b = codes[: sizes[0].sum()], codes[sizes[0].sum() :]
    met = np.bincount(a, minlength=n).astype(np.float64) * np.bincount(b, minlength=n)
    dense = np.full(n, -1, np.int64)
    often = np.argsort(-met, kind="stable")[:DENSE]
    dense[often] = np.arange(len(often))
    return Side(a, sizes[0], dense), Side(b, sizes[1], dense), n


class Columns:
    """Rows [lo, hi) of a side as the other meets them: the rows of each token."""

    def __init__(self, side: Side, lo: int, hi: int, n: int) -> None:
        codes, rows = side.codes[side.first[lo] : side.first[hi]], side.rows[side.first[lo] : side.first[hi]] - lo
        order = np.argsort(codes, kind="stable")
        self.rows, self.lo, self.hi = rows[order], lo, hi
        self.first, self.matrix = np.append(0, np.cumsum(np.bincount(codes, minlength=n))), side.matrix[lo:hi].T

    def shared(self, side: Side, lo: int, hi: int) -> np.ndarray:
        """Common tokens of rows [lo, hi) of the other side with each of these."""
        out = side.matrix[lo:hi] @ self.matrix
        codes, rows = side.codes[side.first[lo] : side.first[hi]], side.rows[side.first[lo] : side.first[hi]] - lo
        size = self.first[codes + 1] - self.first[codes]
        at = np.arange(size.sum()) + np.repeat(self.first[codes] - (np.cumsum(size) - size), size)
        flat = np.repeat(rows, size) * out.shape[1] + self.rows[at]
        out += np.bincount(flat, minlength=out.size).reshape(out.shape)
        return out


def lists(table: pa.Table) -> pa.ListArray:
    made = table.column("t").combine_chunks()
    return made.chunk(0) if isinstance(made, pa.ChunkedArray) else made


def meet(a: DataFrame, b: DataFrame, pairs: Callable[[pa.Table, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `pairs` makes of each block of a (a, t, ...) and each of b (b, t, ...), of sets t without nulls or repeats."""
    parts = [max(ceil(f.count() / SIZE), 4) for f in (a, b)]
    block = lambda f, key, n: F.pmod(F.xxhash64(key), F.lit(n)).alias(f"block_{key}")
    copies = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias(name)
    left = a.select("*", block(a, "a", parts[0]), copies(parts[1], "block_b"))
    right = b.select("*", copies(parts[0], "block_a"), block(b, "b", parts[1]))

    names = to_arrow_schema(T._parse_datatype_string(schema))

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        found = list(pairs(x, y)) if x.num_rows and y.num_rows else []
        return pa.Table.from_batches(found).cast(names) if found else names.empty_table()

    # as many tasks as there are pairs of blocks, so that none is left with many of them
    dealt = lambda f: f.repartition(parts[0] * parts[1], "block_a", "block_b").groupBy("block_a", "block_b")
    return dealt(left).cogroup(dealt(right)).applyInArrow(met, schema)


def similar(a: DataFrame, b: DataFrame, least_shared: int, least_jaccard: float) -> DataFrame:
    """(a, b, shared, jaccard) of the pairs of (a, t) and (b, t) with that many common tokens and that similarity."""

    def pairs(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        # by size, so that a block meets only sets of a size that can be so similar
        x, y = (t.take(np.argsort(np.diff(lists(t).offsets.to_numpy()), kind="stable")) for t in (x, y))
        left, right, n = encoded(lists(x), lists(y))
        for first in range(0, len(right.size), COLUMNS):
            columns = Columns(right, first, min(first + COLUMNS, len(right.size)), n)
            low, high = right.size[columns.lo] * least_jaccard - 1e-9, right.size[columns.hi - 1] / least_jaccard + 1e-9
            begin, end = np.searchsorted(left.size, low), np.searchsorted(left.size, high, "right")
            for lo in range(begin, end, ROWS):
                hi = min(lo + ROWS, end)
                shared = columns.shared(left, lo, hi)
                i, j = np.nonzero(shared >= np.maximum(least_shared, left.size[lo:hi] * least_jaccard - 1e-3)[:, None].astype(np.float32))
                count = shared[i, j].astype(np.int64)
                jaccard = count / (left.size[lo + i] + right.size[first + j] - count)
                good = (count >= least_shared) & (jaccard >= least_jaccard)
                if good.any():
                    yield pa.RecordBatch.from_arrays([x.column("a").take(lo + i[good]).combine_chunks(), y.column("b").take(first + j[good]).combine_chunks(), pa.array(count[good]), pa.array(jaccard[good])], ["a", "b", "shared", "jaccard"])

    kind = [f.schema[n].dataType.simpleString() for f, n in ((a, "a"), (b, "b"))]
    return meet(a.select("a", "t"), b.select("b", "t"), pairs, f"a {kind[0]}, b {kind[1]}, shared long, jaccard double")


def best_pages(a: DataFrame, b: DataFrame, k: int, least: float) -> DataFrame:
    """(a, key, url, score) that hold the k pages with the best set of each (a, t), and more. b: b, t, url, key of the page.

    The score is the number of common tokens and twice the similarity, rounded; a page of a lower one than `least` is none.
    """

    def pairs(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        left, right, n = encoded(lists(x), lists(y))
        (_, url), (keys, key) = (np.unique(y.column(c).to_numpy(), return_inverse=True) for c in ("url", "key"))
        # few columns first: what they give rules out most of the others
        ends = [min(e, len(right.size)) for e in (64, 320, 1344)] + list(range(1344 + COLUMNS, len(right.size) + COLUMNS, COLUMNS))
        ends = sorted({min(e, len(right.size)) for e in ends})
        columns = [Columns(right, lo, hi, n) for lo, hi in zip([0, *ends], ends, strict=False)]
        for lo in range(0, len(left.size), ROWS):
            hi = min(lo + ROWS, len(left.size))
            mine, floor, found, waiting = left.size[lo:hi], np.full(hi - lo, least), [], 0
            for c in columns:
                shared = c.shared(left, lo, hi)
                # the similarity is no more than shared / size
                bound = np.maximum(0.5, floor / (1 + 2 / np.maximum(mine, 1)) - 1e-3).astype(np.float32)
                i, j = np.nonzero(shared >= bound[:, None])
                count, j = shared[i, j].astype(np.int64), j + c.lo
                score = np.round(count + 2.0 * (count / (mine[i] + right.size[j] - count)), 6)
                good = score >= floor[i]
                found.append((i[good], j[good], score[good]))
                waiting += int(good.sum())
                if waiting > 16 * (hi - lo) or c is columns[-1]:
                    i, j, score = (np.concatenate(v) for v in zip(*found, strict=True))
                    order = np.lexsort((-url[j], -score, i))
                    i, j, score = i[order], j[order], score[order]
                    once = np.sort(np.unique(i * len(keys) + key[j], return_index=True)[1])
                    i, j, score = i[once], j[once], score[once]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    floor[i[rank == k - 1]] = score[rank == k - 1]
                    found, waiting = [tuple(v[rank < k] for v in (i, j, score))], 0
            i, j, score = found[0]
            if len(i):
                yield pa.RecordBatch.from_arrays([x.column("a").take(lo + i).combine_chunks(), y.column("key").take(j).combine_chunks(), y.column("url").take(j).combine_chunks(), pa.array(score)], ["a", "key", "url", "score"])

    kind = a.schema["a"].dataType.simpleString()
    return meet(a.select("a", "t"), b.select("b", "t", "url", "key"), pairs, f"a {kind}, key string, url string, score double")
