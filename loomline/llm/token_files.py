"""Token ids in fixed-width binary segments.

A segment holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs:

    magic "LTS1" | bits u32 | n_ids u64 | n_docs u64 | block ids u64 | n_blocks u64
    block offsets u64[n_blocks]   byte at which each block begins, from the start of the payload
    document starts u64[n_docs]   ids before each document within the segment
    payload                       blocks of block ids each, packed, the least significant bit first

All numbers are little endian. Each block begins at a byte of its own, so any range of ids unpacks by
numpy from the blocks that it touches. Segments are written by Spark as rows of a Parquet folder
(segment number, ids of its documents, bytes), which works on every file system that Spark knows and whose
commit survives lost executors; `segment_bytes` can equally be put in plain files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.shared import BYTE_BASE, WORD_BASE, checkpoint_dir, mix, powers, text_buffer, text_slices, texts_in_batches

MAGIC = b"LTS1"
HEAD = struct.Struct("<4sIQQQQ")
BLOCK_IDS = 1 << 14
#: Ids in a segment, at least one document; bounds the memory of writers and readers, save for one longer document.
SEGMENT_IDS = 1 << 20
#: Units of text whose ids a worker keeps, of some 32 bytes each, before it starts anew.
CACHE_UNITS = 1_000_000
#: Bytes of text and words that are encoded together.
SLICE_BYTES, WORDS_AT_ONCE = 2 << 20, 1 << 19


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in that many bits, the least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (spread.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def segment_bytes(ids: np.ndarray, starts: np.ndarray, vocabulary: int, block: int = BLOCK_IDS) -> bytes:
    """One segment of documents that begin at those ids."""
    bits = bits_for(vocabulary)
    if len(ids) and int(ids.max()) >= vocabulary:
        raise ValueError(f"id {int(ids.max())} is outside the vocabulary of {vocabulary}")
    blocks = [pack(ids[k : k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1]
    return b"".join([HEAD.pack(MAGIC, bits, len(ids), len(starts), block, len(blocks)), offsets.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), *blocks])


class Segment:
    """Random access to a segment."""

    def __init__(self, data: bytes) -> None:
        magic, self.bits, self.n_ids, n_docs, self.block, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        self.offsets = np.frombuffer(data, "<u8", n_blocks, HEAD.size).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_docs, HEAD.size + 8 * n_blocks).astype(np.int64)
        self.payload = memoryview(data)[HEAD.size + 8 * (n_blocks + n_docs) :]

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from start to before stop, from the blocks that hold them only."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        out = []
        for b in range(start // self.block, (stop - 1) // self.block + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(self.payload[self.offsets[b] : self.offsets[b] + (n * self.bits + 7) // 8], n, self.bits))
        first = start // self.block * self.block
        return np.concatenate(out)[start - first : stop - first]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n_ids)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers from each start on, as many as its length."""
    stop = np.cumsum(lengths)
    return np.repeat(starts - (stop - lengths), lengths) + np.arange(int(stop[-1]) if len(stop) else 0)


class WordEncoder:
    """Encodes texts by a byte-level tokenizer whose pieces never span ASCII white space and are cut at letters; it
    lower-cases.

    Arrow cuts texts into words and finds the different ones, so Python sees each of those once for some texts. A word
    that is a run of letters, then of plain marks, is two units; any other word is one. The ids of units that were met
    are kept in arrays, found by 128 bits of hash; new letters or marks are normalised and spelt in bytes together,
    then given to the model one by one, and any other unit is encoded by itself.
    """

    #: Marks that cut a word from what follows it and take no part in a longer rule.
    MARKS = '!"#$%&()*+,-./:;=?@[]^_`{}~'

    def __init__(self, path: str, cache_units: int = CACHE_UNITS) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), cache_units
        self.tokenize = self.tokenizer.model.tokenize
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._clear()

    def _clear(self) -> None:
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.length, self.flat = np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.uint32)

    def _spelt(self, units: list[str]) -> list[list[int]]:
        """Ids of units of letters or marks only: each stays whole, so the model takes it without searching for cuts."""
        out = []
        for k in range(0, len(units), 5000):
            some = units[k : k + 5000]
            spelt = self.byte_level.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(" ".join(some)))[0][0].split("Ġ")
            out += [[t.id for t in self.tokenize(y)] for y in spelt] if len(spelt) == len(some) else self._alone(some)
        return out

    def _alone(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)] if units else []

    def _found(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where units are kept, whether they are, and their first hash, which moves on while another unit has the same."""
        if not len(self.first):
            return np.zeros(len(first), np.int64), np.zeros(len(first), bool), first
        while True:
            at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
            same = self.first[at] == first
            other = same & (self.second[at] != second)
            if not other.any():
                return at, same, first
            first = np.where(other, mix(first + second), first)

    def _learn(self, data: bytes, begin: np.ndarray, end: np.ndarray, first: np.ndarray, second: np.ndarray, whole: np.ndarray) -> None:
        """Keep the ids of units, given as stretches of data; whole ones aren't letters or marks only."""
        _, one = np.unique(first, return_index=True)
        units = [data[a:b].decode() for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
        ids: list = [None] * len(units)
        for kind, encode in ((False, self._spelt), (True, self._alone)):
            which = np.flatnonzero(whole[one] == kind).tolist()
            for k, x in zip(which, encode([units[k] for k in which]), strict=True):
                ids[k] = x
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        if len(length) and length.max() >= 1 << 16:
            self.length = self.length.astype(np.uint32)
        start = len(self.flat) + np.cumsum(length) - length
        at = np.searchsorted(self.first, first[one])
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))))
        self.first, self.second = np.insert(self.first, at, first[one]), np.insert(self.second, at, second[one])
        self.begin, self.length = np.insert(self.begin, at, start.astype(np.uint32)), np.insert(self.length, at, length.astype(self.length.dtype))

    def _units(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, one word after the other, and their number in each."""
        plain = pc.invert(pc.or_(pc.match_substring_regex(words, "[\u0300-\u036f]"), pc.match_substring(words, "<|")))
        # not lower-cased early where a mark may compose with a small letter only, or a special token may be spelt
        words = pc.if_else(plain, pc.ascii_lower(words), words)
        stems = pc.ascii_rtrim(words, self.MARKS)
        letters = pc.if_else(pc.string_is_ascii(stems), pc.ascii_is_alpha(stems), pc.utf8_is_alpha(stems)).to_numpy(zero_copy_only=False)
        # the small form of İ ends in a mark that would join the marks after it; what counts as a letter is Python's view
        for k in np.flatnonzero(letters & ~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False)).tolist():
            stem = stems[k].as_py()
            letters[k] = stem.isalpha() and "İ" not in stem
        data, bounds = text_buffer(words)
        begin, end = bounds[:-1], bounds[1:]
        cut = np.where(letters, begin + np.diff(text_buffer(stems)[1]), end)
        up, sums = {}, {}
        for base in (BYTE_BASE, WORD_BASE):
            up[base] = powers(base, max(1, len(data)))
            sums[base] = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[base][0][: len(data)], dtype=np.uint64)))
        a, b = np.concatenate((begin, cut)), np.concatenate((cut, end))
        whole = np.concatenate((~letters, np.zeros(len(letters), bool)))
        some = np.flatnonzero(a < b)
        a, b, whole = a[some], b[some], whole[some]
        first, second = (mix((sums[base][b] - sums[base][a]) * up[base][1][a] + (b - a).astype(np.uint64)) for base in (BYTE_BASE, WORD_BASE))
        if len(self.first) > self.limit:
            self._clear()
        at, known, first = self._found(first, second)
        while not known.all():
            new = np.flatnonzero(~known)
            self._learn(data.tobytes(), a[new], b[new], first[new], second[new], whole[new])
            at, known, first = self._found(first, second)
        start, length = np.zeros(2 * len(words), np.int64), np.zeros(2 * len(words), np.int64)
        start[some], length[some] = self.begin[at], self.length[at]
        n = length[: len(words)] + length[len(words) :]
        place = np.cumsum(n) - n
        ids = np.empty(int(n.sum()), np.uint32)
        ids[_spread(np.concatenate((place, place + length[: len(words)])), length)] = self.flat[_spread(start, length)]
        return ids, n

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end id after each text, and the number of ids of each text; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        words, cuts = split.flatten(), np.asarray(split.offsets)
        cuts = cuts - cuts[0]
        ids, counts = [], [np.zeros(0, np.int64)]
        for k in range(0, len(words), WORDS_AT_ONCE):
            coded = words[k : k + WORDS_AT_ONCE].dictionary_encode()
            flat, n = self._units(coded.dictionary)
            which = coded.indices.to_numpy()
            counts.append(n[which])
            ids.append(flat[_spread((np.cumsum(n) - n)[which], counts[-1])])
        before = np.concatenate(([0], np.cumsum(np.concatenate(counts))))[cuts]
        sizes = np.diff(before) + 1
        out = np.full(int(sizes.sum()), end_id, np.uint32)
        inner = np.ones(len(out), dtype=bool)
        inner[np.cumsum(sizes) - 1] = False
        if ids:
            out[inner] = np.concatenate(ids)
        return out, sizes


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which keeps what it learnt from task to task."""
    return WordEncoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int, text: str = "text", doc_id: str = "doc_id", segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of all documents, in ascending order of their id, as segments in that folder.

    Null and empty texts hold the end id alone. Null ids come first; rows of one id, repeated ones too, follow each
    other in the order of their texts. Only `text` and `doc_id` are read, whatever other columns are called. The
    folder must not exist. An empty table gives a folder without segments.
    """
    spark = docs.sparkSession
    rows = texts_in_batches(docs).select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total) // (32 << 20) + 1)
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType

    def encode(batches):
        encoder, part, number, held, ids, kind = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0, [], [], None

        def segment():
            nonlocal number, held, ids
            flat, sizes = np.concatenate([x for x, _ in ids]), np.concatenate([n for _, n in ids])
            row = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([held], pa.list_(kind)), pa.array([segment_bytes(flat, np.cumsum(sizes) - sizes, vocabulary)], pa.binary())]
            number, held, ids = number + 1, [], []
            return pa.RecordBatch.from_arrays(row, names=["part", "number", "n_ids", "doc_ids", "bytes"])

        for some in text_slices(batches, "text", SLICE_BYTES):
            held += some.column("doc_id").to_pylist()  # a slice would hold on to the whole batch
            kind = some.column("doc_id").type
            ids.append(encoder(some.column("text"), end_id))
            if sum(len(x) for x, _ in ids) >= segment_ids:
                yield segment()
        if held:
            yield segment()

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("number", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("bytes", T.BinaryType())])
    ordered.mapInArrow(encode, schema).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids."""
    segments = spark.read.parquet(folder)
    # one narrow row per segment: the window sees no document and no id
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    before = segments.select("part", "number", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0).cast("long"))).drop("n_ids")
    placed = segments.join(before, ["part", "number"]).select("before", "doc_ids", "bytes")
    id_type = segments.schema["doc_ids"].dataType.elementType

    def decode(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch.column("bytes")[row].as_py())
                ids, ends = segment.ids().astype("<u4"), [*segment.starts[1:].tolist(), segment.n_ids]
                starts, keys = segment.starts.tolist(), batch.column("doc_ids")[row].values
                offset = batch.column("before")[row].as_py()
                pieces = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([keys, pa.array([offset + a for a in starts], pa.int64()), pa.array(map(len, pieces), pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in pieces], pa.int64()), pa.ListArray.from_arrays(pa.array([*starts, segment.n_ids], pa.int32()), pa.array(ids.astype(np.int32)))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return placed.mapInArrow(decode, schema)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """read_tokens without the ids themselves, which then never leave the Python worker."""
    return read_tokens(spark, folder).drop("ids")


def scratch_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/loomline-tokens-{uuid.uuid4().hex}"
