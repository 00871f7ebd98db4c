"""The chunks of a page that may be the best for a question by their bonus: of all that are alike, the first.

A bonus depends on a chunk by its URL, title and marks, by how many words and pairs of words it shares with the question,
up to a few, and by whether it names a person. Chunks that agree in these have the same bonus, so one of each kind is
enough. Kinds are counted in blocks in Arrow batches; no pair of a question and a chunk leaves a task but the first of a kind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators import blocks

#: Spaces and bytes of tokens as they are, all others as one that no word of a question has.
_WORDS = np.array([c if chr(c).isdigit() or chr(c).islower() or c == 32 else 1 for c in range(128)] + [1] * 128, np.uint8)
MARKS = 1024


class Pairs:
    """Which pairs of words, as one space joins them, are anywhere in texts."""

    def __init__(self, bigrams: list[tuple[str, str]]) -> None:
        self.heads, self.tails = ({w: i for i, w in enumerate(sorted({b[n] for b in bigrams}))} for n in (1, 0))
        code = np.array([self.tails[a] * len(self.heads) + self.heads[b] for a, b in bigrams], np.int64)
        self.number = np.argsort(code)
        self.code, self.seen = code[self.number], {}

    def parts(self, word: str) -> tuple[list[int], list[int]]:
        """First words that end a word, second words that begin it."""
        if word not in self.seen:
            if len(self.seen) > 1_000_000:
                self.seen.clear()
            n = range(1, len(word) + 1)
            self.seen[word] = [self.tails[word[-k:]] for k in n if word[-k:] in self.tails], [self.heads[word[:k]] for k in n if word[:k] in self.heads]
        return self.seen[word]

    def found(self, full: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each pair that a text holds, once."""
        none = np.zeros(0, np.int64)
        if not len(self.code) or not len(full):
            return none, none
        words = pc.split_pattern(blocks.rewritten(full, _WORDS), " ")
        rows = np.repeat(np.arange(len(full)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        parts = [self.parts(w) for w in coded.dictionary.to_pylist()]
        (size_t, tails), (size_h, heads) = ((np.array([len(p[n]) for p in parts], np.int64), np.array([x for p in parts for x in p[n]], np.int64)) for n in (0, 1))
        first_t, first_h = np.cumsum(size_t) - size_t, np.cumsum(size_h) - size_h
        a, b, row = at[:-1], at[1:], rows[:-1]
        good = (row == rows[1:]) & (size_t[a] > 0) & (size_h[b] > 0)
        a, b, row = a[good], b[good], row[good]
        # each tail of the word before with each head of the word after
        size = size_t[a] * size_h[b]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        a, b, row = (np.repeat(x, size) for x in (a, b, row))
        code = tails[first_t[a] + k // size_h[b]] * len(self.heads) + heads[first_h[b] + k % size_h[b]]
        place = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        hit = self.code[place] == code
        once = np.unique(row[hit] * len(self.code) + self.number[place[hit]])
        return once // len(self.code), once % len(self.code)


def firsts(chunks: DataFrame, asked: list[dict], pages: list[tuple[int, str]]) -> DataFrame:
    """(n, url, ord) of the first chunk of each kind on each page of a question, and more.

    chunks: ord, url, title, full (text in small letters), marks (bits). asked, by number: focus, bigrams, person and
    surname (or none), marks that its bonus depends on. pages: number of a question, url.
    """
    n_q = len(asked)
    terms = sorted({t for q in asked for t in q["focus"]})
    code, known = {t: i for i, t in enumerate(terms)}, pa.array(terms, pa.string())
    focus = [(code[t], n) for n, q in enumerate(asked) for t in q["focus"]]
    bigrams = sorted({tuple(b.split(" ")) for q in asked for b in q["bigrams"]})
    number = {b: i for i, b in enumerate(bigrams)}
    paired = sorted((number[tuple(b.split(" "))], n) for n, q in enumerate(asked) for b in q["bigrams"])
    begins = np.searchsorted([p[0] for p in paired], np.arange(len(bigrams) + 1))
    whose = np.array([p[1] for p in paired], np.int64)
    weights = blocks.Weights(np.array([f[0] for f in focus], np.int64), np.array([f[1] for f in focus], np.int64), np.ones(len(focus)), len(terms), n_q)
    mask = np.array([q["marks"] for q in asked], np.int64)
    names = [(n, q[kind], bit) for n, q in enumerate(asked) for kind, bit in (("person", 2), ("surname", 1)) if q[kind] is not None]
    on: dict[str, list[int]] = {}
    for n, url in pages:
        on.setdefault(url, []).append(n)

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, place, state = Pairs(bigrams), {}, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            batch = batch.filter(pc.is_in(batch.column(1), value_set=pa.array(list(on), pa.string())))
            batch = batch.take(pc.sort_indices(batch.column(0)))
            if not batch.num_rows:
                continue
            ords, urls, titles, full, marks = (batch.column(i) for i in range(5))
            page = np.array([place.setdefault(x, len(place)) for x in zip(urls.to_pylist(), titles.to_pylist(), strict=True)], np.int64)
            allowed = np.zeros((len(place), n_q), bool)
            for (url, _), i in place.items():
                allowed[i, on[url]] = True
            ords, marks, full = ords.to_numpy(zero_copy_only=False), marks.to_numpy(zero_copy_only=False).astype(np.int64), pc.fill_null(full, "")
            rows, codes, _ = blocks.token_codes(full, known)
            row, bigram = pairs.found(full)
            named = [(n, np.asarray(pc.match_substring(full, name).to_numpy(zero_copy_only=False)), bit) for n, name, bit in names]
            for a in range(0, len(ords), blocks.ROWS):
                b = min(a + blocks.ROWS, len(ords))
                lo, hi = np.searchsorted(rows, (a, b))
                used, column = np.unique(codes[lo:hi], return_inverse=True)
                has = np.zeros((b - a, len(used)), np.float32)
                has[rows[lo:hi] - a, column] = 1
                shared = np.minimum(has @ weights.dense(used).astype(np.float32), 4).astype(np.int64)
                shared = np.where(shared < 2, 0, shared - 1)
                lo, hi = np.searchsorted(row, (a, b))
                size = begins[bigram[lo:hi] + 1] - begins[bigram[lo:hi]]
                k = np.arange(size.sum()) + np.repeat(begins[bigram[lo:hi]] - (np.cumsum(size) - size), size)
                two = np.bincount(np.repeat(row[lo:hi] - a, size) * n_q + whose[k], minlength=(b - a) * n_q).reshape(b - a, n_q)
                told = np.zeros((b - a, n_q), np.int64)
                for n, hit, bit in named:
                    told[:, n] += bit * hit[a:b]
                kind = (((page[a:b, None] * MARKS + (marks[a:b, None] & mask)) * 4 + shared) * 3 + np.minimum(two, 2)) * 4 + told
                at, n = np.nonzero(allowed[page[a:b]])
                key, first = np.unique(kind[at, n] * n_q + n, return_index=True)
                key, ord_ = np.concatenate([state[0], key]), np.concatenate([state[1], ords[a:b][at[first]]])
                order = np.lexsort((ord_, key))
                key, first = np.unique(key[order], return_index=True)
                state = key, ord_[order][first]
        key, ord_ = state
        back = list(place)
        for a in range(0, len(key), 10_000):
            part = key[a : a + 10_000]
            where = part // n_q // (MARKS * 48)
            yield pa.RecordBatch.from_arrays([pa.array(part % n_q), pa.array([back[i][0] for i in where], pa.string()), pa.array([back[i][1] for i in where], pa.string()), pa.array(part // n_q % (MARKS * 48)), pa.array(ord_[a : a + 10_000])], ["n", "url", "title", "kind", "ord"])

    return chunks.select("ord", "url", "title", "full", "marks").mapInArrow(kinds, "n long, url string, title string, kind long, ord long").groupBy("n", "url", "title", "kind").agg(F.min("ord").alias("ord")).select("n", "url", "ord")
