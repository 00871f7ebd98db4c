"""Removal of word windows that occur more than once in a corpus.

Every window of `width` consecutive words gets a Rabin-Karp hash. The hashes are counted in two
shuffles: each chunk of documents first reduces its windows to distinct hashes, those seen once and
those seen again within the chunk, dealt into buckets; each bucket then answers each chunk with one
bit for every hash that the chunk saw once: does another chunk hold it too? The chunk marks its
repeated windows, and overlapping or touching ones merge into maximal intervals of words. A hash
travels at most once from each chunk, so a passage in a third of all rows weighs no more in a bucket
than there are chunks. The bucket comes from a second, independent hash: two different windows count
as equal only if 64 bits and the bucket agree, so the certainty rises as buckets multiply with the data.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.shared import SECOND_BASE, n_groups, passes, release, text_buffer, texts_in_batches, window_hashes, word_hashes

MESSAGE = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])
ANSWER = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])
MESSAGE_DDL = "bucket int, chunk int, once binary, again binary"
ANSWER_DDL = "chunk int, bucket int, bits binary"


def _windows(texts: pa.Array, width: int):
    """For each pass over the texts: its range, where words begin, the windows' first words, their hash and second hash."""
    data, bounds = text_buffer(texts)
    for start, stop in passes(bounds):
        words, at = word_hashes(data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start])
        hashes = window_hashes(words, width)
        inside = np.zeros(len(words) + 1, dtype=np.int64)
        lengths = np.diff(at)
        has = lengths >= width
        np.add.at(inside, at[:-1][has], 1)
        np.add.at(inside, at[:-1][has] + lengths[has] - width + 1, -1)
        first = np.flatnonzero(np.cumsum(inside[:-1])[: len(hashes)])
        yield start, stop, at, first, hashes[first], window_hashes(words, width, SECOND_BASE)[first] if len(first) else hashes[first]


def _once_and_again(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, sorted: those that occur once, and the others."""
    hashes = np.sort(hashes)
    if not len(hashes):
        return hashes, hashes
    new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    at = np.flatnonzero(new)
    single = np.diff(np.append(at, len(hashes))) == 1
    return hashes[at[single]], hashes[at[~single]]


def _by_bucket(hashes: np.ndarray, second: np.ndarray, n_buckets: int):
    """(bucket, its hashes) for every bucket that has some."""
    bucket = ((second >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int((int(second[part[0]]) >> 32) * n_buckets >> 32), hashes[part]


def _chunk_windows(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    found = [(h, s) for *_, h, s in _windows(texts, width)]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([h for h, _ in found]), np.concatenate([s for _, s in found])


def repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 35) -> DataFrame:
    """One row per input row: its id as `doc_id`, n_words, n_removed, kept_sha256, kept (the words left, joined by one
    space) and spans (maximal intervals of removed words, from inclusive, to exclusive).

    Only `text` and `doc_id` are read; other columns, whatever their names, are ignored. Null text has no words, and
    an empty or short text has no window: such rows come back whole. A null id stays null. Repeated rows are documents
    of their own and so repeat each other. An empty table gives an empty result.
    """
    groups = n_groups(docs, text)
    rows = texts_in_batches(docs).select(
        F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(groups)).cast("int").alias("chunk"),
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
    )

    def send(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, second = _chunk_windows(rows.column("text"), width)
        out = [(b, *_once_and_again(h)) for b, h in _by_bucket(hashes, second, groups)]
        release()
        return pa.table([[b for b, _, _ in out], [key[0].as_py()] * len(out), [x.tobytes() for _, x, _ in out], [x.tobytes() for _, _, x in out]], schema=MESSAGE)

    def answer(key: tuple, rows: pa.Table) -> pa.Table:
        once = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("once").to_pylist()]
        again = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("again").to_pylist()]
        every = np.sort(np.concatenate(once + again))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        bits = []
        for x in once:
            at = np.searchsorted(twice, x)
            bits.append(np.packbits(twice[np.minimum(at, len(twice) - 1)] == x).tobytes() if len(twice) else bytes(-(-len(x) // 8)))
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array(bits, pa.binary())], schema=ANSWER)

    id_type = rows.schema["doc_id"].dataType
    result = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_sha256", T.StringType()),
            T.StructField("kept", T.StringType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
        ]
    )

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts = rows.column("text")
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        hashes, second = _chunk_windows(texts, width)
        repeated = [np.zeros(0, np.uint64)]
        for b, h in _by_bucket(hashes, second, groups):
            once, again = _once_and_again(h)
            told = np.unpackbits(np.frombuffer(bits[b], dtype=np.uint8), count=len(once)).astype(bool)
            repeated += [once[told], again]
        repeated = np.sort(np.concatenate(repeated))
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": [], "spans": []}
        for start, stop, at, first, hashes, _ in _windows(texts, width):
            edge = np.zeros(at[-1] + 1, dtype=np.int64)
            if len(repeated):
                hit = first[repeated[np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)] == hashes]
                edge[hit] += 1
                np.add.at(edge, hit + width, -1)
            gone = np.cumsum(edge[:-1]) > 0
            for k in range(start, stop):
                words, mask = (texts[k].as_py() or "").encode().split(), gone[at[k - start] : at[k - start + 1]]
                turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                if len(turn):
                    words = [w for w, g in zip(words, mask.tolist(), strict=True) if not g]
                whole = b" ".join(words)
                out["n_words"].append(len(mask))
                out["n_removed"].append(len(mask) - len(words))
                out["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
                out["kept"].append(whole.decode())
                out["spans"].append([{"from": a, "to": b} for a, b in turn.reshape(-1, 2).tolist()])
        spans = pa.array(out["spans"], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))
        release()
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(out["n_words"], pa.int64()), "n_removed": pa.array(out["n_removed"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string()), "kept": pa.array(out["kept"], pa.string()), "spans": spans})

    grouped = rows.groupBy("chunk")
    answers = grouped.applyInArrow(send, MESSAGE_DDL).groupBy("bucket").applyInArrow(answer, ANSWER_DDL)
    return grouped.cogroup(answers.groupBy("chunk")).applyInArrow(finish, result)
