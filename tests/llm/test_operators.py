"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import heapq
import json
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomline.llm import chat, mixing, sharding, toxicity
from loomline.llm.decontaminate import find_leaks
from loomline.llm.jaccard_join import similar_documents
from loomline.llm.line_dedup import near_lines
from loomline.llm.neighbours import nearest
from loomline.llm.shared import kept
from loomline.llm.sharding import lpt_counts, shard_documents
from loomline.llm.substring_dedup import repeated_windows
from loomline.llm.token_files import Segment, WordEncoder, pack, read_digests, segment_bytes, unpack, write_tokens
from loomline.llm.toxicity import score_toxicity

WORDS = [f"w{k}" for k in range(400)]
#: Columns whose names the operators use inside.
CLASH = "doc_id long, text string, source string, lang string, bucket string, chunk string, row string, component_id string"


def corpus(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([3, 20, 60, 200]))) for _ in range(25)]
    passage = " ".join(rng.choice(WORDS) for _ in range(50))
    texts = base + base[:4] + [f"{base[5]} {passage}", f"{passage} {base[6]}", f"{base[7]}\n{passage}\t{base[8]}"]
    for text in base[9:14]:
        words = text.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "  \n\t ", "one", "é" * 50 + " Ünï ", " ".join(WORDS) * 20]
    rows = [(k, t, "ab"[k % 2], ["en", "de", None][k % 3], "x", "y", "z", "c") for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[2], None, "en", "x", "y", "z", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), CLASH)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], CLASH)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def test_substring_dedup(docs, nothing):
    rows = corpus()
    count = Counter(tuple(w[i : i + 35]) for w in (words(r[1]) for r in rows) for i in range(len(w) - 34))
    expected = []
    for row in rows:
        w = words(row[1])
        gone = {j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((row[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    got = repeated_windows(docs).collect()
    key = lambda r: (str(r[0]), *r[1:4])
    assert sorted(map(key, got)) == sorted(map(key, expected))
    assert all(r["n_removed"] == sum(s["to"] - s["from"] for s in r["spans"]) for r in got)
    assert repeated_windows(nothing).count() == 0


def shingles(text: str | None) -> set:
    w = [x.lower() for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(items: dict, linked) -> dict:
    parent = {k: k for k in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(items)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(items[a], items[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in items}


def test_jaccard_join(spark, nothing):
    rng, rows = random.Random(4), {}
    for k in range(160):
        if k % 4 == 0 or not rows:
            text = [rng.choice(WORDS) for _ in range(rng.choice([2, 4, 5, 6, 9, 15, 40, 120]))]
        else:
            text = list(rows[k - k % 4])
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = rng.choice(WORDS)
        rows[k] = text
    texts = {k: " ".join(v) for k, v in rows.items()} | {900: None, 901: "", 902: " \n"}
    sets = {k: shingles(t) for k, t in texts.items()}
    similar = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    expected = components(sets, similar)
    frame = spark.createDataFrame([(k, t, "s") for k, t in texts.items()], "doc_id long, text string, `set` string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similar_documents(frame).collect()}
    assert got == {k: (len(sets[k]), expected[k]) for k in texts}
    assert similar_documents(nothing).count() == 0


def test_jaccard_join_with_nulls_and_repeats(docs):
    got = similar_documents(docs).collect()
    assert len(got) == len(corpus())
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[25] == 0 and by_id[None] == 2 and by_id[28] == 3


def test_shuffles_of_a_step_are_deleted_with_it(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    shuffled = lambda: {f.getName() for f in (lambda files: [files.apply(k) for k in range(files.size())])(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()
    held = spark.range(1000).repartition(3, "id").groupBy(F.col("id") % 7).count()
    out = kept(held)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and out.count() == 7 and held.count() == 7


def test_decontamination(spark, docs, nothing):
    items = [(1, " ".join(WORDS[:12]), "x"), (1, "w1 w2", "x"), (2, "w7", "x"), (3, None, "x"), (4, "...", "x"), (None, "w1", "x"), (5, corpus()[5][1].upper() if corpus()[5][1] else "", "x")]
    frame = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for name, text, _ in items:
        w = split(text)
        if w and name is not None:
            for i in range(max(1, len(w) - 7)):
                windows.setdefault(tuple(w[i : i + 8]), set()).add(str(name))
    expected = []
    for row in corpus():
        w, hit, names = split(row[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    names |= windows[tuple(w[i : i + n])]
                    hit |= set(range(i, i + n))
        expected.append((str(row[0]), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names) >= 2))
    for limit in (1 << 20, 40):
        got = find_leaks(docs, frame, automaton_bytes=limit).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(expected)
    assert find_leaks(nothing, frame).count() == 0
    assert find_leaks(docs, frame.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_spans_are_original(spark):
    text = "ÄÖ, The  Quick-brown FOX\njumps! ende"
    found = find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, "quick brown fox jumps")], "item_id long, text string")).first()
    assert [text[s["from"] : s["to"]] for s in found["spans"]] == ["Quick-brown FOX\njumps"]


def test_mixing(docs, nothing):
    rows = mixing.mix_sources(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted((str(r[0]), len(words(r[1]))) for r in corpus())
    total = sum(r["size"] for r in rows)
    goals = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert sum(t for _, t in goals.values()) == pytest.approx(1.5 * total)
    assert all(t <= 2 * s + 1e-9 for s, t in goals.values()) and None in goals
    assert all(0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] for r in rows)
    for source, (_, target) in goals.items():
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - target) <= 2 * max(r["size"] for r in own)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.mix_sources(nothing).count() == 0
    assert [r["copies"] for r in mixing.mix_sources(docs.where("doc_id is not null and coalesce(trim(text), '') = ''")).collect()] == [0] * docs.where("doc_id is not null and coalesce(trim(text), '') = ''").count()


def test_mixing_targets_are_those_of_resharing(spark):
    rng = random.Random(2)
    for _ in range(3):
        sizes = {f"s{k}": rng.choice([1, 5, 100, 2000]) for k in range(7)} | {None: 50}
        names = sorted((k for k in sizes if k), key=lambda s: s.encode()) + [None]
        weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
        goal, full = {}, set()
        while True:
            left = 1.5 * sum(sizes.values()) - sum(2 * sizes[n] for n in full)
            share = sum(weight[n] for n in names if n not in full)
            goal = {n: 2.0 * sizes[n] if n in full else left * weight[n] / share for n in names}
            over = {n for n in names if goal[n] > 2 * sizes[n] + 1e-9}
            if not over:
                break
            full |= over
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        assert {r["source"]: pytest.approx(r["target"]) for r in mixing.targets(frame).collect()} == goal


def test_longest_processing_time_is_that_of_a_plain_heap():
    rng = random.Random(3)
    for _ in range(200):
        sizes = {rng.randint(1, rng.choice([5, 50, 1000])): rng.choice([1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 20))}
        shards = rng.choice([1, 2, 8])
        heap = [(0, k) for k in range(shards)]
        for size, n in sorted(sizes.items(), reverse=True):
            for _ in range(n):
                load, k = heapq.heappop(heap)
                heapq.heappush(heap, (load + size, k))
        loads = [0] * shards
        for size, k, a, b in lpt_counts(sorted(sizes.items(), reverse=True), shards):
            loads[k] += size * (b - a)
        assert sorted(loads) == sorted(x for x, _ in heap)


def test_sharding(docs, nothing):
    rows, texts = shard_documents(docs, 3).collect(), {}
    assert len(rows) == len(corpus())
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    by_id = {r[0]: (r[1] or "").encode() for r in corpus()}
    for r in rows:
        data = by_id[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert texts.setdefault(data, r["shard"]) == r["shard"]
    assert shard_documents(nothing).count() == 0


def test_schedule_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * (k % 37)) for k in range(200)], "doc_id long, text string")
    whole = sorted(map(tuple, shard_documents(docs, 4).collect()))
    monkeypatch.setattr(sharding, "PIECE", 5)
    assert sorted(map(tuple, shard_documents(docs, 4).collect())) == whole


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((400, 16)).round(3)
    points[7] = points[3]
    rows = [(k, [float(x) for x in v], "x") for k, v in enumerate(points)]
    bad = [(900, None, "x"), (1000, [0.0] * 16, "x"), (901, [float("nan")] * 16, "x"), (902, [None] * 16, "x"), (903, [1.0], "x"), (None, [1.0] * 16, "x"), (904, [], "x")]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank string")
    got = nearest(frame, every=20, k=10)
    hits, found = 0, {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert sorted(found) == list(range(0, 400, 20))
    for q, rest in found.items():
        apart = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(400), apart)) if i != q][:10]
        assert [r for r, _, _ in sorted(rest)] == list(range(1, 11))
        assert all(abs(apart[i] - s) < 1e-12 for _, s, i in rest)
        hits += len(set(best) & {i for _, _, i in rest})
    assert hits >= 0.9 * 200
    assert nearest(frame.where("false"), every=20).count() == 0
    assert nearest(frame.where("vec_id < 3"), every=20).count() == 2


def test_bit_packing_round_trip():
    rng = np.random.default_rng(1)
    for vocabulary in (2, 3, 50, 256, 257, 49_408, 65_536, 70_000, 1 << 21):
        ids = rng.integers(0, vocabulary, 10_007).astype(np.uint32)
        bits = max(1, (vocabulary - 1).bit_length())
        assert (unpack(pack(ids, bits), len(ids), bits) == ids).all() and len(pack(ids, bits)) == -(-len(ids) * bits // 8)
        segment = Segment(segment_bytes(ids, np.array([0, 5, 5, 9000]), vocabulary, 512))
        assert (segment.ids() == ids).all() and (segment.ids(500, 1500) == ids[500:1500]).all()
        assert len(segment.document(1)) == 0 and (segment.document(3) == ids[9000:]).all()
    with pytest.raises(ValueError):
        segment_bytes(np.array([7], np.uint32), np.array([0]), 7)


def test_word_encoder_is_the_plain_tokenizer():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(2)
    plain, own = Tokenizer.from_file(path), WordEncoder(path, 500)
    letters = "aAbZzéÉßİΣς'sSt.,!$<|>09 \n\t  ́̌JjhHtT中文😀_-"
    for _ in range(4):
        texts = ["", "<|endoftext|>x", "J̌", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(500))]
        ids, sizes = own(pa.array(texts), 2)
        for text, part in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert part.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2]


def test_token_files(spark, docs, nothing, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    write_tokens(docs, str(tmp_path / "a"), path, 49_408, 2, segment_ids=500)
    got = sorted(read_digests(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    rows, plain, before = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), Tokenizer.from_file(path), 0
    for r, row in zip(got, rows, strict=True):
        ids = [*plain.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    write_tokens(nothing, str(tmp_path / "b"), path, 49_408, 2)
    assert read_digests(spark, str(tmp_path / "b")).count() == 0


def test_toxicity(spark, nothing):
    rng, bad = random.Random(1), ["vile", "nasty"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 3 == 0
        text = [rng.choice(WORDS) for _ in range(40)]
        if toxic:
            text[rng.randrange(40)] = rng.choice(bad)
        rows.append((k, " ".join(text) if k % 50 else "", "en" if k % 2 else None, "x"))
        labels.append((k, int(toxic and k % 50 != 0)))
    rows.append((None, None, "en", "x"))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(frame, known).collect()}
    truth = dict(labels)
    assert len(got) == 901 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert {k for k in truth if got[k]["held_out"]} == set(held)
    assert sum(got[k]["predicted"] == truth[k] for k in held) >= 0.95 * len(held)
    assert score_toxicity(nothing, known).count() == 0
    assert score_toxicity(frame, known.where("false")).where("predicted = 1").count() == 0


@pytest.mark.parametrize("at_once", [8 << 20, 40_000])
def test_toxicity_learns_from_every_labelled_row(spark, at_once):
    """A word that only the last rows in order of the id's hash have, here and in tasks."""
    rng, ids = random.Random(6), [r["id"] for r in spark.range(9000).orderBy(F.xxhash64("id")).collect()]
    kind = {k: 2 if n >= 7200 and n % 2 else 1 if n % 2 else 0 for n, k in enumerate(ids)}
    rows = [(k, " ".join([rng.choice(WORDS) for _ in range(12)] + [("calm", "vile", "nasty")[x]]), "en") for k, x in kind.items()]
    frame, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(k, int(x > 0)) for k, x in kind.items()], "doc_id long, toxic int")
    got = score_toxicity(frame, labels, sample_bytes=at_once).collect()
    late = [r["predicted"] for r in got if r["held_out"] and kind[r["doc_id"]] == 2]
    assert len(late) > 200 and np.mean(late) >= 0.95
    assert np.mean([r["predicted"] for r in got if r["held_out"] and kind[r["doc_id"]] == 0]) <= 0.05


def test_scores_are_rounded_in_a_fixed_order():
    """Bit by bit the sums of single products, whatever texts are scored together."""
    rng, model = random.Random(12), toxicity.Model()
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in [1, 2, 3, 10, 10, 40, 3000] * 3] + ["", None]
    alone = [toxicity._encoded_rows(pa.array([t], pa.string()))[0] for t in texts]
    expected = []
    for rows in alone:
        vectors = model.table[rows[:, 0]] + model.table[rows[:, 1]] + model.table[rows[:, 2]] + model.table[rows[:, 3]]
        total, n, j = np.float64(model.shift), len(rows) - toxicity.PAD, 0
        for w in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                got = np.zeros(n, np.float32)
                for k in range(w):
                    for s in range(toxicity.SIZE):
                        got = got + vectors[k : n + k, s] * model.filters[w][k, s, f]
                total, j = total + np.float64(max(got.max() + model.bias[w][f], np.float32(0))) * np.float64(model.out[j]), j + 1
        expected.append(float(total))
    order = rng.sample(range(len(texts)), len(texts))
    mixed = np.empty(len(texts))
    for start, stop, rows, first, length in toxicity.encoded(pa.array([texts[k] for k in order], pa.string()), 1 << 12):
        mixed[order[start:stop]] = model.logits(rows, first, length)
    assert model.each(alone).tolist() == expected and mixed.tolist() == expected
    assert model.each([]).tolist() == []


def test_best_cuts_of_tasks_are_those_of_the_driver(spark):
    rng = np.random.default_rng(3)
    langs, logits = rng.choice(["", "de", "en", "one"], 600), np.round(rng.standard_normal(600) * 3, 2)
    labels = ((logits + rng.standard_normal(600) > 1) & (langs != "one")).astype(np.int64)
    got = toxicity.best_cuts(spark.createDataFrame(list(zip(langs.tolist(), labels.tolist(), logits.tolist(), strict=True)), "lang string, label long, logit double"))
    expected = {x: toxicity.best_cut(logits[own], labels[own]) for x, own in [(None, langs != "?")] + [(x, langs == x) for x in ("", "de", "en", "one")]}
    assert got == {x: cut for x, cut in expected.items() if cut}


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    """Under the curve of true against false positives."""
    high, low = scores[labels == 1], scores[labels == 0]
    return float(((high[:, None] > low).sum() + 0.5 * (high[:, None] == low).sum()) / (len(high) * len(low)))


@pytest.mark.parametrize("size, least, found", [("0.01", 0.9, 0.4), ("0.1", 0.95, 0.75)])
def test_toxicity_of_held_out_documents(spark, size, least, found):
    folder = f"/root/testdata/sf{size}"
    scored = score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    truth = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("toxic").alias("truth"))
    rows = scored.where("held_out").join(truth, "doc_id").where("truth is not null").select("score", "predicted", "truth").collect()
    scores, predicted, labels = (np.array([r[k] for r in rows]) for k in range(3))
    assert area(scores, labels) >= least
    assert predicted[labels == 1].mean() >= found and labels[predicted == 1].mean() >= 0.85


def test_toxicity_of_repeated_and_long_rows(spark):
    rows = [(k, "vile word " * 5 if k % 2 else "good word " * 5, "en") for k in range(60)]
    rows += [(1, "vile word " * 5, "en"), (100, "good word " * 200_000, "en"), (101, "good word " * 200_000 + "vile", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(101, 1)], "doc_id long, toxic int")
    got = score_toxicity(frame, labels, sample_bytes=1 << 20).collect()
    assert len(got) == len(rows) and len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    by_id = {r["doc_id"]: r["score"] for r in got}
    assert by_id[101] > by_id[100] and by_id[1] > 0.5 > by_id[2]


def test_gradient_of_the_classifier():
    """Against differences of the loss, for every kind of parameter."""
    rng, model = np.random.default_rng(2), toxicity.Model()
    model.table = model.table.astype(np.float64) * 30
    model.filters, model.out = {w: f.astype(np.float64) for w, f in model.filters.items()}, model.out.astype(np.float64)
    model.bias = {w: rng.standard_normal(toxicity.FILTERS) * 0.1 + 0.5 for w in toxicity.WIDTHS}
    length, labels = np.array([9, 1, 14]), np.array([1, 0, 0])
    first = np.cumsum(length + toxicity.PAD) - (length + toxicity.PAD)
    rows = np.zeros((int((length + toxicity.PAD).sum()), 4), np.int32)
    for a, n in zip(first, length, strict=True):
        rows[a : a + n] = rng.integers(1, toxicity.ROWS, (n, 4))

    def loss() -> float:
        logits = model.logits(rows, first, length)
        return float(np.logaddexp(0, np.where(labels == 1, -logits, logits)).mean())

    by_width, by_out, by_shift, row, by_row = model.gradient(rows, first, length, labels)

    def difference(array: np.ndarray, at: tuple) -> float:
        step, was = 1e-5, array[at]
        array[at] = was + step
        up = loss()
        array[at] = was - step
        down = loss()
        array[at] = was
        return (up - down) / (2 * step)

    for w in toxicity.WIDTHS:
        for at in np.ndindex(*model.filters[w].shape):
            assert difference(model.filters[w], at) == pytest.approx(by_width[w][0][at], abs=1e-6)
        for k in range(toxicity.FILTERS):
            assert difference(model.bias[w], (k,)) == pytest.approx(by_width[w][1][k], abs=1e-6)
    for k in range(len(model.out)):
        assert difference(model.out, (k,)) == pytest.approx(by_out[k], abs=1e-6)
    for k in range(0, len(row), 3):
        for d in range(toxicity.SIZE):
            assert difference(model.table, (row[k], d)) == pytest.approx(by_row[k, d], abs=1e-6)
    model.shift += 1e-5
    up = loss()
    model.shift -= 2e-5
    assert (up - loss()) / 2e-5 == pytest.approx(by_shift, abs=1e-6)


def test_lines(spark, nothing):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [line(n) for n in (1, 5, 30, 60, 80, 100)]
    near = [base[3].replace("w1", "w2", 1), base[4] + " w5", base[5][:-1] + "x"]
    rows = [(k, "\n".join(rng.sample(base + near, 5) + ["", "  "]), "x") for k in range(20)] + [(50, None, "x"), (51, "", "x"), (52, "\n\n", "x"), (53, "short", "x"), (54, base[2], "x"), (54, base[2], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, line_id string")
    got = near_lines(frame).collect()
    texts = {(k, i): x for k, t, _ in rows for i, x in enumerate((t or "").split("\n")) if x.strip()}
    assert len(got) == sum(1 for k, t, _ in rows for x in (t or "").split("\n") if x.strip())
    grams = lambda x: {x[i : i + 9] for i in range(len(x) - 8)} or {x}
    sets = {x: grams(x) for x in sorted(set(texts.values()))}
    expected = components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    own = {}
    for r in got:
        own.setdefault(expected[texts[r["doc_id"], r["line"]]], set()).add(r["component_id"])
    assert all(len(v) == 1 for v in own.values()) and len(own) == len({c for v in own.values() for c in v})
    assert sum(r["kept"] for r in got) == len(own)
    assert near_lines(nothing).count() == 0


def test_one_line_of_each_component_stays_whatever_ids_are_repeated(spark):
    line = "a line that is long enough to be a near copy of another one, number "
    rows = [(None, line + "1"), (None, line + "1"), (None, line + "2"), (3, "quite another line of text"), (3, "quite another line of text"), (3, "nothing like any of the rest"), (4, " ".join(map(str, range(6000)))), (4, " ".join(map(str, range(6001))))]
    got = near_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and len({r["component_id"] for r in got}) == 4
    assert Counter(r["component_id"] for r in got if r["kept"]) == Counter({r["component_id"] for r in got})


@pytest.mark.parametrize("at", [0, 199])
def test_lines_of_one_word_meet_wherever_they_differ(spark, at):
    rng = random.Random(at)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(lines + [x[:at] + "#" + x[at + 1 :] for x in lines])), "doc_id long, text string")
    own = {r["doc_id"]: r["component_id"] for r in near_lines(frame).collect()}
    assert all(own[k] == own[k + 20] for k in range(20)) and len(set(own.values())) == 20


def test_recall_of_similar_lines(spark):
    """Real lines, and lines without spaces, each with a changed copy; all pairs of similarity 0.8 or more by brute force."""
    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").orderBy("doc_id").collect()]
    real = sorted({x for t in texts for x in t.split("\n") if x.strip()})
    lines = rng.sample(real, 1200)
    lines += [x.replace(" ", "") for x in lines[:300]]
    for x in list(lines):
        at = sorted(rng.sample(range(len(x) + 1), min(len(x), rng.randint(1, max(1, len(x) // 90)))))
        lines.append("".join(x[a:b] + "~" for a, b in zip([0, *at], [*at, len(x)], strict=True)))
    lines = sorted(set(lines))
    grams = [{x[i : i + 9] for i in range(len(x) - 8)} or {x} for x in lines]
    where = {}
    for k, g in enumerate(grams):
        for x in g:
            where.setdefault(x, []).append(k)
    common = Counter((a, b) for ks in where.values() if len(ks) < 400 for i, a in enumerate(ks) for b in ks[i + 1 :])
    pairs = [(a, b) for a, b in common if 5 * len(grams[a] & grams[b]) >= 4 * len(grams[a] | grams[b])]
    own = {r["doc_id"]: r["component_id"] for r in near_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert len(pairs) > 700 and sum(own[a] == own[b] for a, b in pairs) >= 0.95 * len(pairs)


def test_lines_without_white_space_meet(spark):
    rng = random.Random(8)
    urls = ["".join(rng.choice("abcdefghijklmnop/") for _ in range(300)) for _ in range(6)]
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(urls + ["#" + x[1:] for x in urls])], "doc_id long, text string")
    own = {r["doc_id"]: r["component_id"] for r in near_lines(frame).collect()}
    assert all(own[k] == own[k + 6] for k in range(6)) and len(set(own.values())) == 6


def test_similar_lines_of_a_band_need_no_pivot(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    fixed = " ".join(word() for _ in range(12))
    lines = []
    for _ in range(150):
        own = " ".join(word() for _ in range(5))
        lines += [f"{fixed} {own}", f"{fixed} {own[:-1]}#"]
    frame = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    own = {r["doc_id"]: r["component_id"] for r in near_lines(frame).collect()}
    grams = [{x[i : i + 9] for i in range(len(x) - 8)} for x in lines]
    expected = components(dict(enumerate(grams)), lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert len(set(expected.values())) == 150
    assert all(own[k] == own[k + 1] for k in range(0, 300, 2)) and len(set(own.values())) == 150


def test_every_pair_of_a_band_is_compared(spark):
    """Lines that share most of their bands and differ too much, so that a smaller one is in every part of a pair's bands."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    fixed = " ".join(word() for _ in range(12))
    lines = []
    for _ in range(150):
        own = f"{word()} {word()}"
        lines += [f"{fixed} {own}", f"{fixed} {own[:-1]}#"]
    grams = [{x[i : i + 9] for i in range(len(x) - 8)} for x in lines]
    expected = components(dict(enumerate(grams)), lambda a, b: 100 * len(a & b) >= 80 * len(a | b))
    assert len(set(expected.values())) == 150
    own = {r["doc_id"]: r["component_id"] for r in near_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert all(own[k] == own[k + 1] for k in range(0, 300, 2)) and len(set(own.values())) == 150


def test_chat(spark):
    calls = [("c", "a", "sum", '{"y": 2, "x": 1}', None), ("c", "b", "sum", '{"x": "no", "z": {"q": 1, "p": null}}', ["a"]), ("c", "d", "none", "{}", ["b", "missing"]), ("c", "e", "sum", "nonsense", ["f"]), ("c", "f", "sum", None, ["e"]), ("c", "g", "sum", '{"x": 1.5}', ["f"]), ("c", "a", "sum", '{"y": 2, "x": 1}', ["a0"]), (None, "a", "sum", "{}", None)]
    results = [("c", "a", "3", 1), ("c", "a", "4", 1), ("c", "z", "lost", 1), ("c", None, "x", 1)]
    schemas = [("sum", "x", "integer", True), ("sum", "y", "number", False)]
    made = chat.link_calls(spark.createDataFrame(calls, "conv_id string, call_id string, name string, arguments string, after array<string>"), spark.createDataFrame(results, "conv_id string, call_id string, content string, level int"), spark.createDataFrame(schemas, "name string, field string, kind string, required boolean"))
    got = {r["call_id"]: r for r in made.collect()}
    assert {k: r["level"] for k, r in got.items()} == {"a": 0, "b": 1, "d": 2, "e": None, "f": None, "g": None, "z": None}
    assert (got["a"]["valid"], got["a"]["n_calls"], got["a"]["n_results"]) == (True, 2, 2)
    assert got["a"]["json"] == '{"arguments":{"x":1,"y":2},"call_id":"a","errors":[],"level":0,"name":"sum","result":"3"}'
    assert got["b"]["errors"] == ["kind:x", "unexpected:z"] and '"arguments":{"x":"no","z":{"p":null,"q":1}}' in got["b"]["json"]
    assert got["d"]["errors"] == ["tool"] and got["e"]["errors"] == ["arguments"] and got["f"]["errors"] == ["arguments"] and got["g"]["errors"] == ["kind:x"] and got["z"]["errors"] == ["call"]
    assert all(json.loads(r["json"]) for r in got.values())


CALLS, RESULTS, SCHEMAS = "conv_id string, call_id string, name string, arguments string, after array<string>, json string", "conv_id string, call_id string, content string, valid int", "name string, field string, kind string, required boolean"


def test_chat_of_empty_tables_and_deep_arguments(spark):
    depth = 200
    deep = '{"x": ' + '{"b": 1, "a": ' * depth + '"é"' + "}" * depth + "}"
    long = json.dumps({"x": "w " * 200_000})
    calls = spark.createDataFrame([("c", "a", "t", deep, None, "j"), ("c", "b", "t", long, ["a", "a", "b0"], "j"), ("d", "a", None, "[1]", [], None)], CALLS)
    results, schemas = spark.createDataFrame([("c", "b", None, 1)], RESULTS), spark.createDataFrame([("t", "x", "any", True)], SCHEMAS)
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_calls(calls, results, schemas).collect()}
    assert {k: (r["level"], r["n_results"], r["valid"]) for k, r in got.items()} == {("c", "a"): (0, 0, True), ("c", "b"): (1, 1, True), ("d", "a"): (0, 0, False)}
    assert json.loads(got["c", "b"]["json"])["arguments"] == json.loads(long) and '{"a":{"a":' in got["c", "a"]["json"]
    none = [spark.createDataFrame([], x) for x in (CALLS, RESULTS, SCHEMAS)]
    assert chat.link_calls(*none).count() == 0
    assert [(r["n_calls"], r["errors"]) for r in chat.link_calls(none[0], results, none[2]).collect()] == [(0, ["call"])]
    assert {tuple(r["errors"]) for r in chat.link_calls(calls, none[1], none[2]).collect()} == {("tool",), ("arguments",)}


def test_calls_and_results_meet_by_a_hash_join(spark):
    plan = chat.link_calls(*(spark.createDataFrame([], x) for x in (CALLS, RESULTS, SCHEMAS)))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "FullOuter" in plan.split("ShuffledHashJoin")[1].split("\n")[0]


def test_levels_of_long_chains_and_joints(spark):
    rng = random.Random(1)
    deps = {k: ([k - 1] if k < 60 else rng.sample(range(k), 3)) if k else [] for k in range(90)}
    level = {}
    for k, ds in deps.items():
        level[k] = 1 + max((level[d] for d in ds), default=-1)
    calls = spark.createDataFrame([("c", str(k)) for k in deps], "conv_id string, call_id string")
    edges = spark.createDataFrame([("c", str(k), str(d)) for k, ds in deps.items() for d in ds], "conv_id string, call_id string, dep string")
    assert {int(r["call_id"]): r["level"] for r in chat.levels(calls, edges).collect()} == level


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if k < 4:
            assert tuple(docs.columns) == corpus_pipeline.COLUMNS
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[4] == sizes[5] > 0
    kept = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert similar_documents(kept).where(F.col("doc_id") != F.col("component_id")).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    text = [" ".join(f"{name}{k}" for k in range(60)) for name in "abcde"]
    near = text[0] + " end"
    rows = [(1, text[0]), (1, text[0]), (2, text[0]), (2, text[1]), (3, near), (-4, text[2]), (5, text[2]), (None, text[3]), (None, text[3]), (None, text[4]), (7, text[4]), (8, ""), (8, ""), (None, None)]
    frame = spark.createDataFrame([(k, x, "en", None, 1) for k, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_similar(spark, frame, "").collect())
    assert got == Counter([(1, text[0]), (2, text[1]), (-4, text[2]), (None, text[3]), (7, text[4]), (8, ""), (8, ""), (None, None)])


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Every stage on rows with nulls, repeats and copies, against plain Python; then on an empty table."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(6)
    item = " ".join(rng.choice(WORDS) for _ in range(20))
    plain = [" ".join(rng.choice(WORDS) for _ in range(rng.choice([4, 30, 90]))) for _ in range(40)]
    texts = plain + plain[:5] + [x + " end" for x in plain[5:8]] + [f"{plain[9]} {item}", None, "", " \n"]
    rows = [(k, x, "en", [None, "a", "b"][k % 3], None if x is None else len(x)) for k, x in enumerate(texts)]
    rows += [rows[0], rows[0], (None, plain[11], None, None, 1), (None, None, None, None, None)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(30)] + [(None, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None), (None, plain[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, folder, stages = spark.createDataFrame(rows, kinds), str(tmp_path), dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(map(str, r))
    out = lambda name, frame: sorted(map(key, stages[name](spark, frame, folder).collect()))

    scores = score_toxicity(docs, spark.read.parquet(f"{folder}/labels.parquet"), keep=corpus_pipeline.COLUMNS).collect()
    assert out("toxicity", docs) == sorted(key([r[c] for c in corpus_pipeline.COLUMNS]) for r in scores if r["score"] < 0.7)

    sets = {k: shingles(r[1]) for k, r in enumerate(rows)}
    whose = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    first = {}
    for k, r in enumerate(rows):
        if sets[k]:
            first.setdefault(whose[k], []).append((r[0] is None, r[0] or 0, k))
    kept = [rows[min(group)[2]] for group in first.values()] + [r for k, r in enumerate(rows) if not sets[k]]
    assert out("near_duplicates", docs) == sorted(map(key, kept))

    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    windows = {tuple(split(item)[i : i + 8]) for i in range(13)}
    leaks = lambda t: any(tuple(split(t)[i : i + 8]) in windows for i in range(len(split(t))))
    assert out("decontamination", docs) == sorted(key(r) for r in rows if not leaks(r[1])) and sum(leaks(r[1]) for r in rows) == 1

    mixed = Counter(key(r) for r in stages["mixing"](spark, docs, folder).collect())
    taken = Counter()
    for r in mixing.mix_sources(docs, keep=corpus_pipeline.COLUMNS).collect():
        taken[key([r[f"keep_{c}"] for c in corpus_pipeline.COLUMNS])] += r["copies"]
    assert mixed == +taken and set(mixed) <= set(map(key, rows))

    before, coder = 0, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(stages["token_output"](spark, docs, folder).collect(), key=lambda r: r["start"])
    for r, row in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*coder.encode(row[1] or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (row[0], before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    empty = spark.createDataFrame([], kinds)
    assert all(stage(spark, empty, folder).count() == 0 for stage in stages.values())
