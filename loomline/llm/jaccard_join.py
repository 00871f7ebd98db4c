"""Exact similarity join of documents on their sets of word shingles.

Sets are cut into segments by universe partition: the range of shingle hashes is split evenly into m
segments, with one m for each band of set sizes. Two sets of Jaccard similarity 0.8 or more differ in
at most H = (|r| + |s|) / 9 shingles, so of m > H segments one holds the same shingles in both. A set
is indexed in the scheme of its own band and in that of the next one if a partner there is possible.

A segment that is empty in both sets tells nothing, so each set allocates its signatures by cost:
- one signature for each segment that isn't empty, if more than H segments aren't empty;
- otherwise also the one-deletion neighbourhood of each segment, which survives one difference, so two
  sets match if twice that number is over H;
- otherwise also each shingle by itself, which any two similar sets share.
A pair is safe if either set is, so each kind needs to meet only its own kind. m itself is chosen to
make the expected number of signatures smallest.

Signatures travel packed, dealt into buckets by hash; sets that share one form a run. Runs with the
same members count once. Within a run every set is verified against one pivot on the full sets. In runs
that then still hold several components, all pairs of sets in different components are compared by
sketch, in blocks, and verified unless the sketches rule them out: no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.components import connected_components
from loomline.llm.shared import kept, let_go, mix, n_groups, passes, release, slices, text_buffer, text_slices, texts_in_batches, window_hashes, word_hashes

BAND_GROWTH = 1.5
#: So many different sets with one signature in one pass leave it as rows of their own instead of meeting in a bucket.
HEAVY = 64
#: Sets of a run that meet at once, and rows of runs in one group.
BLOCK_SETS, GROUP_ROWS = 512, 30_000
#: Text that is read at once; batches hold no more, but for one longer text.
MESSAGE_BYTES = 4 << 20
#: Row keys broadcast at most; beyond that they are joined.
BROADCAST_KEYS = 1_000_000

_SALT = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
MESSAGE_DDL = "bucket int, signatures binary, counts binary, sets binary, heavy binary, run long"
MESSAGE = pa.schema([("bucket", pa.int32()), ("signatures", pa.binary()), ("counts", pa.binary()), ("sets", pa.binary()), ("heavy", pa.binary()), ("run", pa.int64())])
MEMBER_DDL = "run long, set binary"


class Similarity:
    """Jaccard similarity of at least percent / 100, in integers."""

    def __init__(self, percent: int = 80) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent

    def differences(self, total):
        """Most shingles in which two similar sets of that total size differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def largest_partner(self, n):
        return n * 100 // self.percent

    def smallest_partner(self, n):
        return -(-n * self.percent // 100)

    def holds(self, common, union):
        return 100 * common >= self.percent * union


def _expected(m: int, sizes: np.ndarray, worst: np.ndarray) -> float:
    """Expected signatures of sets of those sizes, all together, with m segments: empty ones are about Poisson."""
    total = 0.0
    for n, h in zip(sizes.tolist(), worst.tolist(), strict=True):
        mean, k = m * exp(-n / m), np.arange(m - h)
        enough = np.exp(k * log(mean) - mean - np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))).sum()
        total += m + max(0.0, 1 - enough) * (n + m)
    return total


@lru_cache(maxsize=4)
def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, last size and number of segments of each band, up to the one that holds sets of that size."""
    law, low, out = Similarity(percent), 1, []
    while not out or out[-1][1] < most:
        high = max(low, int(low * BAND_GROWTH))
        least = law.differences(2 * high) + 1
        sizes = np.unique([low, (3 * low + high) // 4, (low + high) // 2, (low + 3 * high) // 4, high])
        worst = law.differences(sizes + np.minimum(high, law.largest_partner(sizes)))
        spare = np.unique(np.concatenate((np.arange(8), np.geomspace(8, max(9, least // 4 + 8), 24).astype(np.int64))))
        out.append((low, high, int(min(least + spare, key=lambda m: _expected(int(m), sizes, worst)))))
        low = high + 1
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True))


def shingle_sets(texts: pa.Array, width: int):
    """For each pass over the texts: its range, all sets' shingle hashes, sorted within each set, and where sets begin."""
    data, bounds = text_buffer(texts)
    for start, stop in passes(bounds):
        words, at = word_hashes(data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start], lower=True)
        full, sets = window_hashes(words, width), []
        for k in range(stop - start):
            a, b = at[k], at[k + 1]
            if b - a >= width:
                sets.append(np.unique(full[a : b - width + 1]))
            else:
                sets.append(mix(window_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else full[:0])
        yield start, stop, np.concatenate(sets) if sets else full[:0], np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[at[1:]] - total[at[:-1]]


def set_keys(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits that stand for each set, as rows of two numbers."""
    return np.stack([mix(_sums(mix(shingles ^ _SALT[k]), at) + np.diff(at).astype(np.uint64)) for k in (0, 1)], axis=1)


#: How many shingles of a set fall into each of 256 parts of the hash range, up to 255. The sum of differences between
#: two sketches is at most the number of shingles in which the sets differ.
_SKETCH = np.dtype([("n", "<i8"), ("counts", "u1", 256)])


def sketches(shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
    out, sizes = np.zeros(len(at) - 1, dtype=_SKETCH), np.diff(at)
    part = np.repeat(np.arange(len(sizes)) * 256, sizes) + (shingles >> np.uint64(56)).astype(np.int64)
    out["n"], out["counts"] = sizes, np.minimum(np.bincount(part, minlength=256 * len(sizes)), 255).reshape(-1, 256)
    return out


def signatures(shingles: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the number of the set that each is of, for sets that aren't empty."""
    law, sizes = Similarity(percent), np.diff(at)
    if not len(sizes):
        return shingles, sizes
    low, high, segments = bands(percent, 8 << int(sizes.max()).bit_length())
    own = np.searchsorted(high, sizes)
    content, place, found, whose = mix(shingles ^ _SALT[2]), shingles >> np.uint64(32), [], []
    for step in (0, 1, 2):
        band = own + step
        part = np.flatnonzero(sizes >= law.smallest_partner(low[band])) if step else np.arange(len(sizes))
        if not len(part):
            continue
        take = np.concatenate([np.arange(at[k], at[k + 1]) for k in part]) if step else slice(None)
        number = np.repeat(np.arange(len(part)), sizes[part])
        value, m, scheme = content[take], segments[band[part]], mix(band[part].astype(np.uint64) + _SALT[3])
        segment = (place[take] * m[number].astype(np.uint64)) >> np.uint64(32)
        new = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (number[1:] != number[:-1]))))
        total = np.add.reduceat(value, new)
        tag = mix(scheme[number[new]] + segment[new])
        found.append(mix(total ^ tag))
        whose.append(part[number[new]])
        filled = np.bincount(number[new], minlength=len(part))
        worst = law.differences(sizes[part] + np.minimum(high[band[part]], law.largest_partner(sizes[part])))
        short = filled <= worst
        if short.any():
            each = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(value))))
            seg, tok = short[number[new]], short[number]
            found += [mix((total ^ _SALT[0]) + tag)[seg], mix(((total[each] - value) ^ _SALT[0]) + tag[each])[tok]]
            whose += [part[number[new]][seg], part[number][tok]]
            tok = (2 * filled <= worst)[number]
            found.append(mix((value ^ _SALT[1]) + scheme[number])[tok])
            whose.append(part[number][tok])
    return np.concatenate(found), np.concatenate(whose)


def _messages(texts: pa.Array, width: int, percent: int, buckets: int):
    for _, _, shingles, at in shingle_sets(texts, width):
        keys, sizes = set_keys(shingles, at), np.diff(at)
        _, one = np.unique(keys[sizes > 0], axis=0, return_index=True)
        one = np.sort(np.flatnonzero(sizes > 0)[one])
        if not len(one):
            continue
        shingles, keys = np.concatenate([shingles[at[k] : at[k + 1]] for k in one]), keys[one]
        found, whose = signatures(shingles, np.concatenate(([0], np.cumsum(sizes[one]))), percent)
        order = np.lexsort((whose, found))
        found, whose = found[order], whose[order]
        keep = np.concatenate(([True], (found[1:] != found[:-1]) | (whose[1:] != whose[:-1])))
        found, whose = found[keep], whose[keep]
        new = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
        length = np.diff(np.append(new, len(found)))
        keep, rows = np.ones(len(found), dtype=bool), []
        for k in np.flatnonzero(length >= HEAVY):
            members = whose[new[k] : new[k] + length[k]]
            run = np.uint64(found[new[k]])
            rows.append((int(mix(run + keys[members[:1], 0])[0] % np.uint64(buckets)), b"", b"", keys[members].tobytes(), b"", int(run.view(np.int64))))
            keep[new[k] + 1 : new[k] + length[k]] = False
        heavy = found[new[length >= HEAVY]]
        found, whose = found[keep], whose[keep]
        bucket = ((found >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((whose, bucket))
        found, whose, bucket = found[order], whose[order], bucket[order]
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            number, count = np.unique(whose[a:b], return_counts=True)
            here = heavy[((heavy >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) == bucket[a]]
            rows.append((int(bucket[a]), found[a:b].astype(np.uint32).tobytes(), count.astype(np.uint32).tobytes(), keys[number].tobytes(), here.tobytes(), None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), MESSAGE, strict=True)], schema=MESSAGE)


def _runs(rows: pa.Table) -> pa.Table:
    """The members of each run of a bucket; runs of the same members once."""
    own = rows.filter(pa.compute.is_null(rows.column("run"))).to_pydict()
    moved = rows.filter(pa.compute.is_valid(rows.column("run"))).to_pydict()
    out_run, out_set = [np.full(len(x) // 16, r, dtype=np.int64) for r, x in zip(moved["run"], moved["sets"], strict=True)], [np.frombuffer(x, dtype=np.uint64).reshape(-1, 2) for x in moved["sets"]]
    if own["sets"]:
        keys, number = np.unique(np.frombuffer(b"".join(own["sets"]), dtype=np.uint64).reshape(-1, 2), axis=0, return_inverse=True)
        number = np.repeat(number.reshape(-1), np.frombuffer(b"".join(own["counts"]), dtype=np.uint32))
        entry = np.unique((np.frombuffer(b"".join(own["signatures"]), dtype=np.uint32).astype(np.uint64) << np.uint64(32)) | number.astype(np.uint64))
        mark, member = (entry >> np.uint64(32)), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], mark[1:] != mark[:-1]))) if len(mark) else np.zeros(0, np.int64)
        length = np.diff(np.append(new, len(mark)))
        heavy = np.unique(np.frombuffer(b"".join(own["heavy"]), dtype=np.uint64))
        short = heavy & np.uint64(0xFFFFFFFF)
        for full, k in zip(heavy, np.searchsorted(mark[new], short).tolist(), strict=True):
            part = member[new[k] : new[k] + length[k]]
            out_run.append(np.full(len(part), full.view(np.int64)))
            out_set.append(keys[part])
        whole = np.flatnonzero((length >= 2) & ~np.isin(mark[new], short))
        if len(whole):
            at = np.concatenate((new, [len(mark)]))
            same = _sums(mix(keys[member, 0] + keys[member, 1]), at)[whole]
            _, one = np.unique(same, return_index=True)
            whole, same = whole[one], mix(same[one])
            take = np.concatenate([np.arange(new[k], new[k] + length[k]) for k in whole])
            out_run.append(np.repeat(same, length[whole]).view(np.int64))
            out_set.append(keys[member[take]])
    release()
    runs = np.concatenate(out_run) if out_run else np.zeros(0, np.int64)
    sets = np.concatenate(out_set) if out_set else np.zeros((0, 2), np.uint64)
    return pa.table([pa.array(runs, pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], schema=pa.schema([("run", pa.int64()), ("set", pa.binary())]))


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar; sketches first rule out pairs that differ too much, sets are read for the rest."""
    law = Similarity(percent)

    def rule_out(batches):
        for batch in slices(batches, 4096):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=_SKETCH) for c in ("x", "y"))
            apart = np.abs(x["counts"].astype(np.int16) - y["counts"].astype(np.int16)).sum(axis=1, dtype=np.int64)
            apart = np.maximum(apart, np.abs(x["n"] - y["n"]))
            yield batch.select(["a", "b"]).filter(pa.array(apart <= law.differences(x["n"] + y["n"])))

    def shingle(batches):
        for batch in slices(batches):
            for _, _, shingles, at in shingle_sets(batch.column(0), width):
                keys = set_keys(shingles, at)
                for k in range(0, len(keys), 256):
                    stop = min(k + 256, len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in keys[k:stop]], pa.binary()), pa.array([shingles[at[i] : at[i + 1]].tobytes() for i in range(k, stop)], pa.binary())], names=["set", "shingles"])

    def check(batches):
        for batch in slices(batches, 256):
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                good.append(law.holds(common, len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def both(pairs: DataFrame, frame: DataFrame, value: str) -> DataFrame:
        sides = [frame.select(F.col("set").alias(k), F.col(value).alias(v)) for k, v in (("b", "y"), ("a", "x"))]
        return pairs.join(sides[0], "b").join(sides[1], "a").select("a", "b", "x", "y")

    near = kept(both(pairs, classes, "sketch").mapInArrow(rule_out, "a binary, b binary"))
    wanted = kept(near.select(F.explode(F.array("a", "b")).alias("set")).distinct().join(classes, "set").select("row"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    # rows that repeat a row bring a set twice, which only repeats a link
    sets = rows.join(wanted, "row", "left_semi").select("text").mapInArrow(shingle, "set binary, shingles binary")
    return both(near, sets, "shingles").mapInArrow(check, "a binary, b binary").distinct()


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of runs that hold more than one component."""
    if labels is None:
        members = members.withColumn("component", F.col("set"))
    else:
        members = members.join(labels.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    mixed = members.groupBy("run").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y").select("run", "n")
    return members.join(mixed, "run")


def _pairs_between(runs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a run in different components whose sketches don't rule them out.

    runs: run, set, component, n (members of the run). Long runs are cut into blocks, of which each two meet, and what
    meets is packed into groups of about GROUP_ROWS rows; pairs that are ruled out never leave numpy.
    """
    law = Similarity(percent)

    def meet(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("run", "ascending"), ("i", "ascending"), ("j", "ascending")])
        run, i, j, own = (rows.column(c).to_numpy() for c in ("run", "i", "j", "block"))
        sets, component = rows.column("set").to_pylist(), rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        drawn = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=_SKETCH)
        size, counts, found = drawn["n"], drawn["counts"], []
        cuts = np.flatnonzero((run[1:] != run[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(run)], strict=True):
            last = np.arange(a, b) if i[a] == j[a] else a + np.flatnonzero(own[a:b] == j[a])
            first = last if i[a] == j[a] else a + np.flatnonzero(own[a:b] == i[a])
            for k in range(0, len(first), 64):
                some = first[k : k + 64]
                most = law.differences(size[some][:, None] + size[last][None])
                good = (component[some][:, None] != component[last][None]) & (np.abs(size[some][:, None] - size[last][None]) <= most)
                if i[a] == j[a]:
                    good &= some[:, None] < last[None]
                x, y = np.nonzero(good)
                for c in range(0, len(x), 1 << 13):
                    p, q = some[x[c : c + (1 << 13)]], last[y[c : c + (1 << 13)]]
                    near = (np.maximum(counts[p], counts[q]) - np.minimum(counts[p], counts[q])).sum(axis=1, dtype=np.int64) <= law.differences(size[p] + size[q])
                    found += zip(p[near].tolist(), q[near].tolist(), strict=True)
        release()
        ends = [sorted((sets[p], sets[q])) for p, q in set(found)]
        return pa.table([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["a", "b"])

    blocks = F.floor((F.col("n") - 1) / BLOCK_SETS).cast("int") + 1
    rows = runs.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("run", "set", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    groups = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // GROUP_ROWS + 1)
    packed = rows.join(classes.select("set", "sketch"), "set").withColumn("group", F.pmod(F.xxhash64("run", "i", "j"), F.lit(groups)))
    return packed.groupBy("group").applyInArrow(meet, "a binary, b binary").distinct()


def _links(members: DataFrame, classes: DataFrame, percent: int, verified: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The component of each set that is in a link; None if there is no link.

    First every member of a run is verified against one, the set that is in most runs, as a text that others were
    copied from is. Then, in runs that still hold several components, all pairs between components.
    """
    degree = members.groupBy("set").agg(F.count("*").alias("degree"))
    ranked = members.join(degree, "set")
    pivots = ranked.groupBy("run").agg(F.max(F.struct("degree", "set")).alias("p")).select("run", F.col("p.set").alias("pivot"))
    star = members.join(pivots, "run").where("set <> pivot").select(F.least("set", "pivot").alias("a"), F.greatest("set", "pivot").alias("b")).distinct()
    links = kept(verified(kept(star)))
    labels = None if links.isEmpty() else kept(connected_components(links))
    del degree, ranked, pivots, star
    let_go(members)
    runs = kept(_labelled(members, labels))
    more = kept(verified(kept(_pairs_between(runs, classes, percent))))
    let_go(members)
    if more.isEmpty():
        return labels
    return kept(connected_components(links.unionByName(more)))


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: its id as `doc_id`, n_shingles, component_id (the smallest id reachable by links).

    The set of a document is that of its shingles of `width` words, A-Z lower-cased; with fewer words, the whole
    sequence is the only one. Null, empty and blank texts have no shingle and are linked with nothing: their
    component is their own id. Equal sets are linked, so repeated rows share a component. A row with a null id takes
    part and can connect others, but is nobody's smallest id; a component without any id has a null one. Only `text`
    and `doc_id` are read, so further columns may have any name. An empty table gives an empty result.
    """
    buckets = n_groups(docs, text, 8 << 20)
    rows = texts_in_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("row"))

    def message(batches):
        # whole batches, as equal sets of one pass send their signatures once
        for batch in text_slices(batches, "text", MESSAGE_BYTES):
            yield from _messages(batch.column(0), width, percent, buckets)

    def key(batches):
        for batch in text_slices(batches, "text", MESSAGE_BYTES):
            for start, stop, shingles, at in shingle_sets(batch.column("text"), width):
                keys, sizes = set_keys(shingles, at), np.diff(at)
                names = [k.tobytes() if n else None for k, n in zip(keys, sizes.tolist(), strict=True)]
                own, drawn = batch.slice(start, stop - start), [x.tobytes() for x in sketches(shingles, at)]
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("row"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(drawn, pa.binary())], names=["doc_id", "row", "n_shingles", "set", "sketch"])

    id_type = rows.schema["doc_id"].dataType
    keyed = kept(rows.mapInArrow(key, T.StructType([T.StructField("doc_id", id_type), T.StructField("row", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("sketch", T.BinaryType())])))
    members = kept(rows.select("text").mapInArrow(message, MESSAGE_DDL).groupBy("bucket").applyInArrow(_runs, MEMBER_DDL).distinct())
    classes = kept(keyed.where("set is not null").groupBy("set").agg(F.min("row").alias("row"), F.min("doc_id").alias("first_id"), F.min("sketch").alias("sketch")))
    let_go(members)
    found = _links(members, classes, percent, lambda pairs: _verified(pairs, classes, rows, width, percent))
    classes = classes.select("set", "first_id")
    if found is not None:
        labelled = classes.join(found.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
        least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
        classes = labelled.join(least, "component").select("set", "component_id")
    else:
        classes = classes.withColumnRenamed("first_id", "component_id")
    out = keyed.join(classes, "set", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
