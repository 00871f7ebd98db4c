"""What several operators need: shared storage, input sizing, hashing of words in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one group of a packed shuffle stands for; bounds the memory of the Python worker that reads it.
GROUP_BYTES = 16 << 20
#: Text hashed in one numpy pass; a single longer text makes its own pass.
PASS_BYTES = 1 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; an own one only where that is unset and Spark runs locally, as in tests."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomline-checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def kept(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; shuffles made for it are deleted once it is written."""
    checkpoint_dir(frame.sparkSession)
    name, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", frame.sparkSession.conf
    before = conf.get(name)
    conf.set(name, "true")
    try:
        # a new query, as the setting counts when a query is made
        return frame.select("*").checkpoint(eager=True)
    finally:
        conf.set(name, before)


def let_go(frame: DataFrame) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a driver of little work puts off until it has filled its
    memory; by then the shuffles of all steps before lie on the disks of the executors.
    """
    gc.collect()
    frame.sparkSession.sparkContext._jvm.System.gc()


#: Bytes of one Arrow batch; the JVM and a Python worker each hold a few of them at once.
BATCH_BYTES = 4 << 20


def texts_in_batches(frame: DataFrame) -> DataFrame:
    """The same frame; its session from now on sends rows to Python in batches of BATCH_BYTES, or fewer if it's set so."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", frame.sparkSession.conf
    now = conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return frame


def release() -> None:
    """Give memory that is free in this Python worker back to the system, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows; once all are done, memory is released."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
    release()


def text_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about so many bytes of a text column, one row at least; once all are done, memory is released."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for start, stop in passes(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), limit):
            yield batch.slice(start, stop - start)
    release()


def n_groups(frame: DataFrame, text: str, group_bytes: int = GROUP_BYTES) -> int:
    """Number of groups so that each stands for about that much text, and no fewer than the shuffle partitions."""
    total = frame.agg(F.sum(F.octet_length(text).cast("long")).alias("b")).first()["b"] or 0
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // group_bytes), 1)


# ------------------------------------------------------------------ hashing of words

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the Rabin-Karp hashes: over the bytes of a word, and two over the words of a window.
BYTE_BASE, WORD_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


#: Powers that a worker keeps of a base; those of a longer text live no longer than its pass.
KEPT_POWERS = 1 << 20


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=4)
def _kept_powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, n)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > KEPT_POWERS:
        return _powers(base, n)
    up, down = _kept_powers(base, 1 << 16 if n <= 1 << 16 else KEPT_POWERS)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins and ends; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """A 64-bit hash of every word [^\\x20\\x09-\\x0D]+ and, for each text, where its words begin in that array.

    Another table of bytes that part words may be given; for each number in `prefixes`, hashes of the words' first bytes follow.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.uint64)
        return (none, np.zeros(len(bounds), np.int64), *[none for _ in prefixes])
    solid = ~space[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    at = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[at] = solid[at]
    at = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    ends[at] = solid[at]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(BYTE_BASE, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(SECOND_BASE))
    at = np.searchsorted(first, bounds)
    stems = []
    for k in prefixes:
        cut = np.minimum(first + k, last)
        stems.append(mix((sums[cut] - sums[first]) * down[first] + (cut - first).astype(np.uint64) * np.uint64(SECOND_BASE)))
    return (hashes, at, *stems)


def window_hashes(words: np.ndarray, width: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of the window of that many words that begins at each word, across texts too; callers drop those."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(words * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def passes(bounds: np.ndarray, limit: int = PASS_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts of about limit bytes."""
    out, start = [], 0
    while start < len(bounds) - 1:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + limit, side="right")) - 1)
        out.append((start, stop))
        start = stop
    return out
