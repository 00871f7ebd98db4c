"""Toxicity by a convolutional text classifier in numpy.

A word is the sum of four rows of one hashed embedding table: two by independent hashes of the word, so that words
seldom share both, and two by hashes of its first 4 and 5 bytes, which speak for unseen forms of a known stem. Filters of
several widths slide over the whole text; the largest answer of each filter goes to a logistic unit. Only the windows
with the largest answers carry a gradient, so a step updates few rows of the table.

One dimension of the table starts as how much oftener a word is in texts of label 1, and one filter reads it, so that
few labels are enough to know the plainest words; gradient steps go on from there, and the state of least loss on rows
that aren't fitted, the start among them, is the one that stays.

The model is fitted on every labelled row that isn't held out, whole texts: on the driver while they have no more text
than `sample_bytes`, else by tasks, which go over shards of that size from one state whose moves are then averaged. Word
counts, losses and cuts are sums over all rows too. A fifth of the rows is not fitted: it says when to stop and sets a
threshold for each language.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.shared import kept, let_go, mix, passes, release, slices, text_buffer, texts_in_batches, word_hashes

ROWS, WIDTHS, FILTERS, SIZE, PREFIXES = 1 << 17, (1, 2, 3), 8, 8, (4, 5)
PAD = max(WIDTHS) - 1
#: Steps at least, and how many times over the rows without a smaller loss before fitting stops.
MIN_STEPS, PATIENCE = 200, 3
#: Times over all texts, or rounds of tasks; texts of a step; tasks that fit side by side at most.
EPOCHS, BATCH, TASKS = 8, 32, 256
#: Words that are scored in one go; a longer text goes alone.
WORDS_AT_ONCE = 2048
#: Labelled ids that are sent to every task at most; beyond that they are joined.
BROADCAST_IDS = 1_000_000
_PARTS = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])


def encoded(texts: pa.Array, limit: int):
    """For each pass over the texts: its range, table rows of its words (0: padding) and first word and length of each text.

    Padding follows each text; a text without words is one padding long.
    """
    data, bounds = text_buffer(texts)
    for start, stop in passes(bounds, limit):
        words, at, *stems = word_hashes(data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start], lower=True, space=_PARTS, prefixes=PREFIXES)
        sizes = np.diff(at)
        length = np.maximum(sizes, 1)
        first = np.cumsum(length + PAD) - (length + PAD)
        place = np.arange(len(words)) + np.repeat(first - at[:-1], sizes)
        rows = np.zeros((int(first[-1] + length[-1] + PAD), 2 + len(PREFIXES)), dtype=np.int32)
        for k, h in enumerate((words, mix(words + np.uint64(1)), *stems)):
            rows[place, k] = (h >> np.uint64(40)) % np.uint64(ROWS - 1) + np.uint64(1)
        yield start, stop, rows, first, length


def word_counts(texts: list, labels: np.ndarray) -> np.ndarray:
    """In how many texts of label 0 and 1 each row of the table is, by the two hashes of whole words, which add up."""
    counts = np.zeros((2, ROWS))
    for k in (0, 1):
        for rows, label in zip(texts, labels.tolist(), strict=True):
            counts[label, np.unique(rows[:, k])] += 1
    return counts


class Model:
    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((ROWS, SIZE)) * 0.02).astype(np.float32)
        self.table[0] = 0
        self.filters = {w: (rng.standard_normal((w, SIZE, FILTERS)) / np.sqrt(w * SIZE)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out, self.shift = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32), 0.0

    def answers(self, rows: np.ndarray, first: np.ndarray, length: np.ndarray):
        """Largest answer of each filter for each text, the word vectors and all answers."""
        vectors = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            vectors += self.table[rows[:, k]]
        edges = np.stack((first, first + length), axis=1).reshape(-1)
        best, every = [], {}
        for w in WIDTHS:
            n = len(vectors) - PAD
            got = vectors[:n] @ self.filters[w][0]
            for k in range(1, w):
                got += vectors[k : n + k] @ self.filters[w][k]
            every[w] = got
            cut = edges if edges[-1] < n else edges[:-1]
            best.append(np.maximum.reduceat(got, cut, axis=0)[::2] + self.bias[w])
        return np.concatenate(best, axis=1), vectors, every

    def logits(self, rows: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """By sums and products of single numbers in a fixed order, some texts at a time, so that equal texts score alike.

        Products of matrices round as their library sees fit; these round the same in any company, task and process.
        """
        out = np.empty(len(first))
        bounds = np.append(first, first[-1] + length[-1] + PAD) if len(first) else np.zeros(1, np.int64)
        for start, stop in passes(bounds, WORDS_AT_ONCE):
            own, begin = rows[bounds[start] : bounds[stop]], first[start:stop] - bounds[start]
            vectors = self.table[own[:, 0]]
            for k in range(1, own.shape[1]):
                vectors += self.table[own[:, k]]
            vectors, n = np.ascontiguousarray(vectors.T), len(own) - PAD
            # from each text's first word to its last, then to the next text
            edges = np.stack((begin, begin + length[start:stop]), axis=1).reshape(-1)[:-1]
            logits, each = np.full(stop - start, self.shift, np.float64), iter(self.out.tolist())
            for w in WIDTHS:
                got, term = np.zeros((FILTERS, n), np.float32), np.empty((FILTERS, n), np.float32)
                for k in range(w):
                    for s in range(SIZE):
                        got += np.multiply(self.filters[w][k, s][:, None], vectors[s, k : n + k], out=term)
                for best, bias in zip(np.maximum.reduceat(got, edges, axis=1)[:, ::2], self.bias[w], strict=True):
                    logits += np.maximum(best + bias, 0).astype(np.float64) * next(each)
            out[start:stop] = logits
        return out

    def prime(self, counts: np.ndarray, texts: np.ndarray) -> None:
        """Let the first dimension hold the log of how much oftener a word is in texts of label 1, and a filter read it.

        counts: word_counts of all texts; texts: how many of them have label 0 and 1.
        """
        counts = counts / np.maximum(1, texts)[:, None] * texts[1]
        self.table[:, 0] = 0.5 * np.log((counts[1] + 0.5) / (counts[0] + 0.5))
        self.table[0] = 0
        self.filters[1][0, :, 0], self.bias[1][0] = np.eye(SIZE)[0], -1.5
        self.out[0] = 1.5

    def each(self, texts: list) -> np.ndarray:
        out = np.empty(len(texts))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        for start, stop in passes(bounds, WORDS_AT_ONCE):
            out[start:stop] = self.logits(np.concatenate(texts[start:stop]), bounds[start:stop] - bounds[start], sizes[start:stop] - PAD)
        return out

    def losses(self, texts: list, labels: np.ndarray) -> np.ndarray:
        logits = self.each(texts)
        return np.logaddexp(0, np.where(labels == 1, -logits, logits))

    def loss(self, texts: list, labels: np.ndarray) -> float:
        return float(self.losses(texts, labels).mean())

    def state(self) -> tuple:
        return self.table.copy(), {w: (self.filters[w].copy(), self.bias[w].copy()) for w in WIDTHS}, self.out.copy(), self.shift

    def restore(self, state: tuple) -> None:
        self.table, filters, self.out, self.shift = state
        self.filters, self.bias = {w: f for w, (f, _) in filters.items()}, {w: x for w, (_, x) in filters.items()}

    def gradient(self, rows: np.ndarray, first: np.ndarray, length: np.ndarray, labels: np.ndarray):
        """Of the mean loss of some texts: by filter and bias of each width, out, shift, and rows of the table with theirs."""
        best, vectors, every = self.answers(rows, first, length)
        hidden = np.maximum(best, 0)
        error = (1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30))) - labels) / len(labels)
        back = error[:, None] * self.out * (best > 0)
        touched, steps, by_width = [], [], {}
        for j, w in enumerate(WIDTHS):
            own, peak = back[:, j * FILTERS : (j + 1) * FILTERS], best[:, j * FILTERS : (j + 1) * FILTERS] - self.bias[w]
            place = np.empty(own.shape, dtype=np.int64)
            for i, (a, n) in enumerate(zip(first.tolist(), length.tolist(), strict=True)):
                place[i] = a + (every[w][a : a + n] >= peak[i] - 1e-6).argmax(axis=0)
            by_width[w] = np.stack([np.einsum("if,ifs->sf", own, vectors[place + d]) for d in range(w)]), own.sum(axis=0)
            for d in range(w):
                touched.append(rows[(place + d).reshape(-1)])
                steps.append((own[:, :, None] * self.filters[w][d].T[None]).reshape(-1, SIZE))
        touched, steps = np.concatenate(touched), np.concatenate(steps)
        live = np.abs(steps).max(axis=1) > 0
        row, where = np.unique(touched[live].reshape(-1), return_inverse=True)
        grad = np.zeros((len(row), SIZE), np.float32)
        np.add.at(grad, where.reshape(-1), np.repeat(steps[live], touched.shape[1], axis=0))
        return by_width, hidden.T @ error, float(error.sum()), row, grad

    def start(self, n0: int, n1: int) -> None:
        self.shift = float(np.log((n1 + 1) / (n0 + 1)))

    def squares(self) -> dict:
        """Where Adagrad begins."""
        squares = {"table": np.full((ROWS, SIZE), 1e-2, np.float32), "out": np.full(self.out.shape, 1e-1), "shift": 1e-1}
        return squares | {w: [np.full(self.filters[w].shape, 1e-1), np.full(FILTERS, 1e-1)] for w in WIDTHS}

    def epoch(self, texts: list, labels: np.ndarray, squares: dict, rng: np.random.Generator, batch: int = BATCH, rate: float = 0.05) -> None:
        """Once over the texts by Adagrad on the logistic loss."""
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            length = np.array([len(texts[i]) - PAD for i in some])
            first = np.cumsum(length + PAD) - (length + PAD)
            by_width, by_out, by_shift, row, by_row = self.gradient(np.concatenate([texts[i] for i in some]), first, length, labels[some])
            for w, grads in by_width.items():
                for value, g, total in zip((self.filters[w], self.bias[w]), grads, squares[w], strict=True):
                    total += g * g
                    value -= (rate * g / np.sqrt(total)).astype(np.float32)
            squares["out"] += by_out * by_out
            self.out -= (rate * by_out / np.sqrt(squares["out"])).astype(np.float32)
            squares["shift"] += by_shift * by_shift
            self.shift -= rate * by_shift / np.sqrt(squares["shift"])
            squares["table"][row] += by_row * by_row
            self.table[row] -= rate * by_row / np.sqrt(squares["table"][row])
            self.table[0] = 0

    def fit(self, texts: list, labels: np.ndarray, own: list, own_labels: np.ndarray, seed: int = 11) -> None:
        """A few texts are gone over more often, for MIN_STEPS steps in all.

        `own` and its labels are the rows that say when to stop; without any, all epochs are gone through.
        """
        rng, squares = np.random.default_rng(seed), self.squares()
        self.prime(word_counts(texts, labels), np.bincount(labels, minlength=2))
        self.start(len(labels) - labels.sum(), labels.sum())
        least, best, since = (self.loss(own, own_labels) if own else np.inf), self.state() if own else None, 0
        for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(texts)))):
            self.epoch(texts, labels, squares, rng)
            if own:
                now = self.loss(own, own_labels)
                least, best, since = (now, self.state(), 0) if now < least else (least, best, since + 1)
                if since >= PATIENCE:
                    break
        if own:
            self.restore(best)


def probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))


def best_cut(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float, int] | None:
    """The smallest logit above the threshold of highest F1, the largest below it and the number of labels 1; None without both labels."""
    if not len(labels) or labels.min() == labels.max():
        return None
    order = np.argsort(-logits, kind="stable")
    ranked, hits = logits[order], np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    f1[:-1][ranked[1:] == ranked[:-1]] = -1
    k = int(f1.argmax())
    return float(ranked[k]), float(ranked[k + 1]) if k + 1 < len(ranked) else -np.inf, int(labels.sum())


def best_cuts(scored: DataFrame) -> dict:
    """best_cut of each lang and, as None, of all rows (lang, label, logit): prefix sums by bins of logits, in DataFrames."""
    each = scored.groupBy("lang", "logit").agg(F.sum("label").alias("hits"), F.count("*").alias("n"))
    whole = each.groupBy("logit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "logit", "hits", "n")
    # no language is written with a mark before it, so null and texts are told apart
    each = kept(each.unionByName(whole).withColumn("lang", F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).withColumn("bin", F.floor(F.col("logit") * 64)))
    bins = each.groupBy("lang", "bin").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    above = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("lang")
    bins = bins.select("lang", "bin", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("hits", "n")], *[F.sum(c).over(own).alias(f"{c}_all") for c in ("hits", "n")])
    upto = Window.partitionBy("lang", "bin").orderBy(F.desc("logit")).rowsBetween(Window.unboundedPreceding, 0)
    rows = each.join(bins.where("hits_all > 0 and hits_all < n_all"), ["lang", "bin"])
    f1 = 2 * (F.col("hits_above") + F.sum("hits").over(upto)) / (F.col("n_above") + F.sum("n").over(upto) + F.col("hits_all"))
    best = kept(rows.withColumn("f1", f1).groupBy("lang", "hits_all").agg(F.max(F.struct("f1", "logit")).alias("b")).select("lang", "hits_all", F.col("b.logit").alias("cut")))
    below = each.join(best, "lang").where("logit < cut").groupBy("lang").agg(F.max("logit").alias("below"))
    return {(r["lang"][1:] if r["lang"] else None): (r["cut"], -np.inf if r["below"] is None else r["below"], r["hits_all"]) for r in best.join(below, "lang", "left").collect()}


def labelled_rows(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, lang: str) -> DataFrame:
    """Every row (text, label, lang, order, own) to fit on, one of each id, whole; held-out ids never. A fifth is `own`."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out)
    known = kept(known.groupBy("doc_id").agg(F.max("label").alias("label")))
    known = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(known, "doc_id")
    # repeated ids bring one text
    rows = rows.groupBy("doc_id", "label").agg(F.min_by(F.struct("text", "lang"), F.struct("text", "lang")).alias("r"))
    order = F.xxhash64("doc_id")
    return rows.select("label", order.alias("order"), F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.lang", F.lit("")).alias("lang"), (F.pmod(F.shiftright(order, 16), F.lit(5)) == 4).alias("own"))


def _encoded_rows(texts: pa.Array) -> list[np.ndarray]:
    return [ids[a : a + n + PAD] for _, _, ids, first, length in encoded(texts, 1 << 20) for a, n in zip(first.tolist(), length.tolist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str = "lang", threshold: float = 0.7, sample_bytes: int = 8 << 20) -> tuple[Model, dict, float]:
    """A model, its threshold for each language and that for others, from every labelled row that isn't held out.

    Up to sample_bytes of text are fitted by the driver; of more, each task fits as much at once. Labels other than 0
    and 1, and null ids, are left out; an id with both labels counts as 1. Without rows of both labels the model gives
    the share of label 1 (0 without any row) for every text.
    """
    rows = kept(labelled_rows(texts_in_batches(docs), labels, text, doc_id, label, lang))
    tally = {(r["label"], r["own"]): r for r in rows.groupBy("label", "own").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).collect()}
    n = np.array([[tally[k, own]["n"] if (k, own) in tally else 0 for own in (False, True)] for k in (0, 1)])
    model = Model()
    if not n.sum(axis=1).all():
        share = float(n[1].sum() / n.sum()) if n.sum() else 0.0
        model.out[:], model.shift = 0, float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return model, {}, threshold
    if not n.all():
        # too few to leave some out
        n, rows = np.stack((n.sum(axis=1), n.sum(axis=1) * 0), axis=1), rows.withColumn("own", F.lit(False))
    size = sum(r["b"] for r in tally.values())
    if size <= sample_bytes:
        found = fit_here(model, rows)
    else:
        found = fit_in_tasks(model, rows, n, -(-size // sample_bytes))
    return calibrated(model, found, threshold)


def fit_here(model: Model, rows: DataFrame) -> dict:
    frame, rows = rows, sorted(rows.collect(), key=lambda r: (r["order"], r["text"]))
    y, own, langs = (np.array([r[c] for r in rows]) for c in ("label", "own", "lang"))
    texts = _encoded_rows(pa.array([r["text"] for r in rows], pa.large_string()))
    rows.clear()
    let_go(frame)
    release()
    some = lambda keep: [t for t, k in zip(texts, keep.tolist(), strict=True) if k]
    model.fit(some(~own), y[~own], some(own), y[own])
    own = own if own.any() else ~own
    logits, y, langs = model.each(some(own)), y[own], langs[own]
    return {None: best_cut(logits, y)} | {x: best_cut(logits[langs == x], y[langs == x]) for x in set(langs.tolist())}


PACKED = "worker int, shard int, texts array<string>, labels array<long>, langs array<string>, own array<boolean>"
#: So many pieces a task cuts its numbers in, to be added up; what follows the table is another.
PIECES = 64


def _shards(batches):
    """worker, shard, encoded texts, labels, languages and which rows are own, shard by shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            worker, shard, texts, labels, langs, own = (batch.column(c).slice(k, 1) for c in range(6))
            yield worker[0].as_py(), shard[0].as_py(), _encoded_rows(texts.flatten()), np.array(labels[0].as_py(), dtype=np.int64), langs[0].as_py(), np.array(own[0].as_py(), dtype=bool)
    release()


def _pieces(worker: int, values: np.ndarray, tail: np.ndarray) -> pa.RecordBatch:
    data = [x.astype(np.float32).tobytes() for x in values.reshape(PIECES, -1)] + [tail.astype(np.float64).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES + 1), pa.int32()), pa.array([worker] * (PIECES + 1), pa.int32()), pa.array(data, pa.binary())], names=["part", "worker", "data"])


def _added(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sums of what _pieces of all workers hold, added in the same order in each run."""

    def add(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        numbers = [np.frombuffer(x, dtype=np.float32 if part < PIECES else np.float64) for x in rows.sort_by("worker").column("data").to_pylist()]
        total = np.zeros(len(numbers[0]))
        for x in numbers:
            total += x
        return pa.table([pa.array([part], pa.int32()), pa.array([total.astype(numbers[0].dtype).tobytes()], pa.binary())], names=["part", "data"])

    added = kept(frame.groupBy("part").applyInArrow(add, "part int, data binary"))
    values, tail = None, None
    # the driver holds one copy; it gets a part of the pieces at a time and gives back what they needed
    for k in range(0, PIECES + 1, 16):
        for r in added.where(F.col("part").between(k, k + 15)).collect():
            if r["part"] == PIECES:
                tail = np.frombuffer(r["data"], dtype=np.float64)
                continue
            piece = np.frombuffer(r["data"], dtype=np.float32)
            values = np.empty((PIECES, len(piece)), np.float32) if values is None else values
            values[r["part"]] = piece
    let_go(added)
    release()
    return values.reshape(-1), tail


def _dense(model: Model, squares: dict) -> np.ndarray:
    """All that is fitted besides the table, in one row of numbers."""
    return np.concatenate([x.reshape(-1).astype(np.float64) for w in WIDTHS for x in (model.filters[w], model.bias[w], *squares[w])] + [model.out.astype(np.float64), squares["out"], [model.shift, squares["shift"]]])


def _set_dense(model: Model, squares: dict, values: np.ndarray) -> None:
    for x in [x for w in WIDTHS for x in (model.filters[w], model.bias[w], *squares[w])] + [model.out, squares["out"]]:
        x[...], values = values[: x.size].reshape(x.shape), values[x.size :]
    model.shift, squares["shift"] = float(values[0]), float(values[1])


def fit_in_tasks(model: Model, rows: DataFrame, n: np.ndarray, shards: int) -> dict:
    """Fits on all rows, in rounds: each worker goes over all its shards from the same state, then states are averaged.

    A row of the table is averaged over the workers that moved it. The least loss on all own rows says which state stays.
    """
    workers, context = min(shards, TASKS), rows.sparkSession.sparkContext

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("order", "ascending"), ("text", "ascending")]).combine_chunks()
        lists = [pa.array([group.column(c).to_pylist()], t) for c, t in (("text", pa.list_(pa.string())), ("label", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("own", pa.list_(pa.bool_())))]
        return pa.table([pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("worker", "shard")] + lists, names=["worker", "shard", "texts", "labels", "langs", "own"])

    dealt = rows.withColumn("shard", F.pmod("order", F.lit(shards)).cast("int")).withColumn("worker", F.col("shard") % workers)
    packed = kept(dealt.repartition(workers, "worker").groupBy("worker", "shard").applyInArrow(pack, PACKED).sortWithinPartitions("worker", "shard"))

    def count(batches):
        total, last = np.zeros((2, ROWS)), None
        for last, _, texts, labels, _, own in _shards(batches):
            total += word_counts([t for t, k in zip(texts, own.tolist(), strict=True) if not k], labels[~own])
        if last is not None:
            yield _pieces(last, total, np.zeros(1))

    model.prime(_added(packed.mapInArrow(count, "part int, worker int, data binary"))[0].reshape(2, ROWS), n[:, 0])
    model.start(int(n[0, 0]), int(n[1, 0]))
    squares, has_own = model.squares(), bool(n[:, 1].all())
    least, best, since = np.inf, None, 0
    for k in range(EPOCHS + has_own):
        sent = context.broadcast((model, squares))

        def go(batches, sent=sent, k=k):
            def moved():
                touched = (squares["table"] != sent.value[1]["table"]).any(axis=1)
                return _pieces(worker, np.concatenate(((model.table - sent.value[0].table).reshape(-1), (squares["table"] - sent.value[1]["table"]).reshape(-1), touched)), np.concatenate((_dense(model, squares) - _dense(*sent.value), [1.0, loss])))

            worker = None
            for whose, shard, texts, labels, _, own in _shards(batches):
                if whose != worker:
                    if worker is not None:
                        yield moved()
                    worker, loss, (model, squares) = whose, 0.0, copy.deepcopy(sent.value)
                loss += float(sent.value[0].losses([t for t, x in zip(texts, own.tolist(), strict=True) if x], labels[own]).sum())
                texts, labels = [t for t, x in zip(texts, own.tolist(), strict=True) if not x], labels[~own]
                if k < EPOCHS and texts:
                    rng = np.random.default_rng([11, k, shard])
                    # few texts are gone over more often, as on the driver
                    for _ in range(min(4, max(1, -(-MIN_STEPS // EPOCHS // -(-len(texts) // BATCH))))):
                        model.epoch(texts, labels, squares, rng)
            if worker is not None:
                yield moved()

        values, tail = _added(packed.mapInArrow(go, "part int, worker int, data binary"))
        sent.destroy()
        if has_own:
            loss = tail[-1] / n[:, 1].sum()
            least, best, since = (loss, model.state(), 0) if loss < least else (least, best, since + 1)
            if since >= PATIENCE:
                break
        table, square, touched = np.split(values, [ROWS * SIZE, 2 * ROWS * SIZE])
        touched = np.maximum(1, touched)[:, None]
        model.table += (table.reshape(ROWS, SIZE) / touched).astype(np.float32)
        squares["table"] += (square.reshape(ROWS, SIZE) / touched).astype(np.float32)
        _set_dense(model, squares, _dense(model, squares) + tail[:-2] / tail[-2])
    if has_own:
        model.restore(best)
    sent = context.broadcast(model)

    def score(batches):
        for _, _, texts, labels, langs, own in _shards(batches):
            own = own if has_own else ~own
            logits = sent.value.each([t for t, x in zip(texts, own.tolist(), strict=True) if x])
            yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(langs, own.tolist(), strict=True) if k], pa.string()), pa.array(labels[own]), pa.array(logits, pa.float64())], names=["lang", "label", "logit"])

    return best_cuts(kept(packed.mapInArrow(score, "lang string, label long, logit double")))


def calibrated(model: Model, cuts: dict, threshold: float) -> tuple[Model, dict, float]:
    """The model with its scale moved to the threshold, and the thresholds of languages, from their best cuts."""

    def between(cut: tuple[float, float, int], move: float = 0.0) -> float:
        return float(probability(cut[0] + move) + (probability(cut[1] + move) if np.isfinite(cut[1]) else 0.0)) / 2

    # the scale of scores moves towards the best threshold lying at the usual one, less so after few cases
    best, hits = float(np.clip(between(cuts[None]), 1e-6, 1 - 1e-6)), cuts[None][2]
    move = float(np.clip(np.log(threshold / (1 - threshold)) - np.log(best / (1 - best)), -2, 2) * hits / (hits + 30))
    model.shift += move
    return model, {x: between(cut, move) for x, cut in cuts.items() if x is not None and cut}, threshold


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", lang: str = "lang", threshold: float = 0.7, keep: tuple[str, ...] = (), **sample) -> DataFrame:
    """One row per document: its id as `doc_id`, held_out, score, predicted (score >= threshold), lang_threshold, toxic.

    The score depends on nothing but the text; null and empty texts get that of no word. held_out is crc32 of the id as
    text, modulo 3, equal to 1; null for a null id. `toxic` compares the score with the threshold calibrated for the row's language (all
    languages together where a language had no labels of both kinds). Repeated rows score alike. Columns named in
    `keep` are handed on unchanged; others are ignored, whatever their names. Empty tables work.
    """
    model, by_lang, default = fit(docs, labels, text, doc_id, label, lang, threshold, **sample)
    release()  # the driver lives on without the sample
    rows = texts_in_batches(docs).select(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in keep if c != "doc_id"], F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    packed = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, some 4 MB
    names = [c for c in rows.columns if c not in ("_text", "_lang")]

    def score(batches):
        model = packed.value
        for batch in slices(batches):
            scores = np.empty(batch.num_rows)
            for start, stop, ids, first, length in encoded(batch.column("_text"), 1 << 20):
                scores[start:stop] = probability(model.logits(ids, first, length))
            thresholds = [by_lang.get(x or "", default) for x in batch.column("_lang").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores), pa.array(thresholds, pa.float64())], names=[*names, "score", "lang_threshold"])

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("score", T.DoubleType()), T.StructField("lang_threshold", T.DoubleType())])
    out = rows.mapInArrow(score, schema)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("toxic", F.col("score") >= F.col("lang_threshold"))
