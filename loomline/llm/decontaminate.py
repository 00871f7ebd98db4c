"""Benchmark decontamination by one Aho-Corasick automaton over all word windows of the test items.

The automaton's patterns are the windows, normalised to small words between single spaces. Each text is normalised
alike and scanned once; the end of a match gives its words, and each word keeps its place in the original text.
The patterns are sent to every worker only while their size is proven to be under a bound; a larger benchmark is cut
into several automata that each scan the texts in turn, handing on what they found; an item is never cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.shared import text_slices, texts_in_batches

#: Bytes of item text behind one automaton, which takes some 40 times as much memory.
AUTOMATON_BYTES = 4 << 20
#: Bytes of text whose results make one batch.
SLICE_BYTES = 4 << 20

#: A-Z become small; other ASCII than 0-9 and a-z parts words; everything else belongs to a word.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_windows(text: str | None, width: int) -> list[str]:
    """Windows of an item: of that many words, or all words if there are fewer."""
    words = [w.decode() for w in (text or "").encode().translate(NORMAL).split()]
    return [" " + " ".join(words[k : k + width]) + " " for k in range(max(1, len(words) - width + 1))] if words else []


class Windows:
    """The automaton of some items' windows."""

    def __init__(self, items: list[tuple], width: int) -> None:
        import ahocorasick

        owners: dict[str, list] = {}
        for name, text in items:
            for window in dict.fromkeys(item_windows(text, width)):
                owners.setdefault(window, []).append(name)
        self.automaton = ahocorasick.Automaton()
        for window, names in owners.items():
            self.automaton.add_word(window, (len(window), window.count(" ") - 1, names))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, normal: str) -> tuple[list[tuple[int, int]], set]:
        """Ranges of words that match, of a normalised text in single spaces, and the items whose windows do."""
        if self.empty:
            return [], set()
        spans, names, words_at = [], set(), None
        for end, (length, n_words, owners) in self.automaton.iter(normal):
            if words_at is None:
                words_at = np.cumsum(np.frombuffer(normal.encode("utf-32-le"), dtype="<u4") == 32)
            first = int(words_at[end - length + 1]) - 1
            spans.append((first, first + n_words))
            names.update(owners)
        return spans, names


_KEPT: dict = {}


def worker_windows(part: Broadcast) -> Windows:
    """The automaton of some items, made once in a Python worker, which keeps a broadcast's value; an earlier one is let go."""
    if id(part.value) not in _KEPT:
        _KEPT.clear()
        _KEPT[id(part.value)] = Windows(*part.value), part.value
    return _KEPT[id(part.value)][0]


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", width: int = 8, min_items: int = 2, automaton_bytes: int = AUTOMATON_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its id as `doc_id`, n_words, n_hit, n_items, items_sha256, contaminated, item_ids, spans.

    spans holds the hit stretches as character ranges of the original text (from inclusive, to exclusive). Words are
    runs of letters, digits and all that isn't ASCII, A-Z lower-cased. Null, empty or wordless texts and items have no
    words, no windows and no hits. Items with a null id are left out, as they can't be named; several rows of one item
    id count as one item. A document row is judged by itself, so repeated rows get the same result. Columns named in
    `keep` are handed on unchanged; any others are ignored, whatever their names. Empty tables on either side work.
    """
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("n"), F.col(item_text).alias("t"))
    size = known.agg(F.sum(F.octet_length("t").cast("long")).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(size) // automaton_bytes))
    out = texts_in_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep, F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("item_ids"))
    span = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    result = T.StructType([*out.schema.fields[:-2], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", span)])
    for k in range(parts):
        own = known.where(F.pmod(F.xxhash64("n"), F.lit(parts)) == k)
        items_of_part = docs.sparkSession.sparkContext.broadcast(([(r["n"], r["t"]) for r in own.toLocalIterator()], width))  # under automaton_bytes, but for one longer item

        def scan(batches, part=items_of_part, last=k == parts - 1):
            windows = worker_windows(part)
            for batch in text_slices(batches, "text", SLICE_BYTES):
                cells: dict = {"hit": [], "item_ids": []} if not last else {n: [] for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans")}
                for value, hit, own in zip(batch.column("text"), batch.column("hit"), batch.column("item_ids"), strict=True):
                    data = (value.as_py() or "").encode()
                    # translated text has no other ASCII white space than spaces, and bytes know no other
                    words = data.translate(NORMAL).split()
                    found, more = windows.scan(" " + b" ".join(words).decode() + " ")
                    mask, names = np.frombuffer(hit.as_py(), dtype=bool) if hit.is_valid else None, own.as_py() or []
                    if found:
                        edge = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(edge, [a for a, _ in found], 1)
                        np.add.at(edge, [b for _, b in found], -1)
                        mask = (np.cumsum(edge)[:-1] > 0) | (False if mask is None else mask)
                        names = sorted(more | set(names))
                    if not last:
                        cells["hit"].append(None if mask is None else mask.tobytes())
                        cells["item_ids"].append(names)
                        continue
                    row = (len(words), 0 if mask is None else int(mask.sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(names) >= min_items, names, [] if mask is None else original_spans(data, mask))
                    for cell, x in zip(cells.values(), row, strict=True):
                        cell.append(x)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))] if last else [pa.binary(), pa.list_(pa.string())]
                columns = [batch.column(c) for c in batch.schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, kind) for v, kind in zip(cells.values(), kinds, strict=True))], names=[*batch.schema.names[:-2], *cells])

        out = out.mapInArrow(scan, result if k == parts - 1 else out.schema)
    return out


def original_spans(data: bytes, mask: np.ndarray) -> list[dict]:
    """Character ranges of the original text that the runs of masked words cover."""
    solid = np.frombuffer(data.translate(NORMAL), dtype=np.uint8) != 32
    begins = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
    ends = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False]))) + 1
    turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2)
    letters = np.concatenate(([0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)))
    return [{"from": int(letters[begins[a]]), "to": int(letters[ends[b - 1]])} for a, b in turn.tolist()]
