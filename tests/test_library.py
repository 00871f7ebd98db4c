"""The library's operators on small fixtures, and its queries against SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.functions import urls as U
from loomline.operators import annotate, corpus, evaluate, index, knowledge, reader, retrieve
from loomline.plans import catalogue
from loomline.sources import files

SMALL = "/root/testdata/sf0.001"
CHECKED = ("word_chunks", "bm25_topk", "bm25_page_topk", "tokenize_stats", "cleanup_answer", "question_types", "url_host_terms", "crawl_dedup", "clean_docs", "worklist_select", "known_answer_exact", "em_f1_detail", "recall_at_k")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_sql(spark, name):
    frame = catalogue.queries()[name](spark, SMALL)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    told = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == sorted(frame.columns)
    got = sorted(str([plain(r[n]) for n in names]) for r in frame.collect())
    assert got == sorted(str([plain(v) for v in row]) for row in told.fetchall())


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("prediction", "gold", "em", "f1"),
    [("", "", 1, 1), ("x", "", 0, 0), ("", "x", 0, 0), ("The Cat!", "the cat", 1, 1), ("the cat", "cat", 0, 2 / 3), ("a a b", "a b b", 0, 2 / 3)],
)
def test_metrics(spark, prediction, gold, em, f1):
    p, g = F.col("p"), F.col("g")
    assert one(spark, evaluate.exact_match(p, g), p=prediction, g=gold) == em
    assert math.isclose(one(spark, evaluate.token_f1(p, g), p=prediction, g=gold), f1)
    assert math.isclose(one(spark, evaluate.token_f1(p, g), p=gold, g=prediction), f1)


def test_best_of_gold(spark):
    rows = spark.createDataFrame([("b", "a|b"), ("x", " | "), ("a", "a")], "prediction string, answer string")
    assert [(r["exact_match"], r["has_gold"]) for r in evaluate.details(rows).collect()] == [(1.0, True), (0.0, False), (1.0, True)]
    assert evaluate.summary(evaluate.details(rows.where("false"))).first()["f1"] == 0


def test_alignment_is_strict(spark):
    refs = spark.createDataFrame([(0, "q", "a"), (1, "r", "b"), (2, "s", "c")], "pos int, question string, answer string")
    told = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, prediction string")
    with pytest.raises(ValueError):
        evaluate.by_position(refs, told)
    assert evaluate.by_position(refs, told, allow_prefix=True).count() == 2
    asked = spark.createDataFrame([(0, "r"), (1, "q")], "pos int, question string")
    assert {(r["question"], r["prediction"], r["answer"]) for r in evaluate.by_question(refs.drop("pos"), asked, told).collect()} == {("r", "a", "b"), ("q", "b", "a")}
    with pytest.raises(ValueError):
        evaluate.by_question(refs.drop("pos"), spark.createDataFrame([(0, "no"), (1, "q")], "pos int, question string"), told)


@pytest.mark.parametrize("n", [0, 1, 110, 139, 140, 141, 250, 251])
def test_word_windows(spark, n):
    words = [f"w{k}" for k in range(n)]
    got = one(spark, corpus.word_windows(F.col("t")), t=" ".join(words))
    assert got == [" ".join(words[k : k + 140]) for k in range(0, n, 110)]


def test_sentence_packing():
    short = [f"s{k} " + "x " * 18 + "e." for k in range(20)]
    packed = corpus.pack_sentences(short, 45, 140, 1)
    assert packed[0] == " ".join(" ".join(short[:7]).split()) and packed[1].startswith("s6 ")
    assert len(corpus.pack_sentences([" ".join(["w"] * 170)], 45, 140, 1)) == 1
    assert [len(c.split()) for c in corpus.pack_sentences([" ".join(["w"] * 171)], 45, 140, 1)] == [140, 56]


def test_sentences_and_noise(spark):
    assert one(spark, corpus.sentences(F.col("t")), t="At x.edu. Foo is 3. Next one! no split? Yes") == ["At x.edu.", "Foo is 3.", "Next one! no split?", "Yes"]
    for text, noise in (("Home", True), ("read more of this now", True), ("a b", True), ("mail a@b.org", False), ("three words here", False), ("", True)):
        assert one(spark, corpus.is_noise(F.col("t")), t=text) is noise


def test_navigation_tail(spark):
    cut = lambda t: one(spark, corpus.strip_navigation(F.col("t"), ("NAV ",)), t=t)
    assert cut("a" * 219 + "NAV x") == "a" * 219 + "NAV x"
    assert cut("a" * 220 + "NAV x") == "a" * 220
    assert cut("NAV " + "a" * 300 + "NAV x") == "NAV " + "a" * 300 + "NAV x"


def test_question_types(spark):
    kinds = lambda q: set(one(spark, R.question_types(F.col("q")), q=q))
    assert kinds("Who is it?") == {"person"} and kinds("the candidate") == {"date"} and kinds("steam") == {"team"}
    assert kinds("Is the office open?") == {"location", "time", "yesno"} and kinds("island") == set() and kinds("How many units?") == {"number"}


def test_query_variants(spark):
    got = one(spark, R.query_variants(F.col("q")), q="Who is the director Ada Byron in the Office?")
    assert len(got) == 6 and got[0]["weight"] == 1.5 and got[1]["text"] == "director ada byron office"
    assert len({v["text"].lower() for v in got}) == 6 and got[3]["text"] == "Ada Byron"


def test_matches_have_offsets(spark):
    text = "a 12, bb 345 é 6"
    got = one(spark, X.matches(F.col("t"), r"\d+"), t=text)
    assert [(m["hit"], m["start"]) for m in got] == [(m[0], m.start()) for m in re.finditer(r"\d+", text)]
    assert one(spark, X.matches(F.col("t"), r"\d+"), t="none") == []


def test_titles_and_urls(spark):
    assert one(spark, X.title_case(F.col("t")), t="cs 189b o'neil") == "cs 189b o'neil".title()
    assert one(spark, U.slug_title(F.col("u")), u="https://x.org/a/my-page_two/") == "My Page Two"
    assert one(spark, U.slug_title(F.col("u")), u="https://x.org/") == "Home"
    assert one(spark, U.host(F.col("u")), u="https://me:pw@WWW.x.org:80/p?q#f") == "www.x.org"


def test_postprocess(spark):
    done = lambda q, a: one(spark, reader.postprocess(F.col("q"), F.col("a")), q=q, a=a)
    assert done("Which course?", "it is cs-189") == "CS 189" and done("What email?", "mail **a.b@c.org** now") == "a.b@c.org"
    assert done("Is it?", "no, not at all") == "No" and done("What?", "N/A") == "unknown" and done("What?", "  ") == "unknown"
    assert done("What degree?", "the M.S. degree") == "M.S." and done("What year?", "in 1999 or so") == "1999"


def test_known_answers(spark):
    known = spark.createDataFrame([(0, "Where is it, the big old blue house?", "Long answer here|Here"), (1, "where is it the big old blue house", "Other"), (2, "Is it?", "yes|certainly")], "ord long, question string, answer string")
    asked = spark.createDataFrame([(0, "WHERE is it, the big old blue house"), (1, "Is it"), (2, "Where is it the big old blue house now"), (3, "else")], "q long, text string")
    assert {r["q"]: r["answer"] for r in knowledge.known_answers(asked, known).collect()} == {0: "Here", 1: "Yes"}
    assert {r["q"]: r["answer"] for r in knowledge.similar_answers(asked, known).collect()} == {0: "Here", 2: "Here"}
    assert {r["ord"] for r in knowledge.without_leaks(known, asked).where("leaked").collect()} == {0, 1, 2}


def test_stop_words_make_no_questions_similar(spark):
    known = spark.createDataFrame([(0, "What is the name of the tower in the city?", "Long Tower", "u/")], "ord long, question string, answer string, url string")
    asked = spark.createDataFrame([(0, "What is the age of the bridge in the valley?")], "q long, text string")
    assert knowledge.similar_answers(asked, known).count() == 0 and knowledge.hint_urls(asked, known).count() == 0


def test_similar_sets_equal_all_overlaps(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(f"t{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randint(3, 14))) for _ in range(150)]
    texts += [x + " more" for x in texts[:60]]
    a = spark.createDataFrame(list(enumerate(texts)), "a long, text string")
    b = a.withColumnRenamed("a", "b")
    found = sorted(map(tuple, knowledge.similar_sets(a, b).collect()))
    assert found == sorted(map(tuple, knowledge.token_overlap(a, b).where("shared >= 5 and jaccard >= 0.68").collect())) and len(found) > 150


def test_known_answers_take_the_form_of_their_question(spark):
    known = spark.createDataFrame([(0, "Which course covers the blue whale and other sea animals?", "it is cs-189 of spring")], "ord long, question string, answer string")
    asked = spark.createDataFrame([(0, "Which course covers the blue whale and other sea animals?"), (1, "And which course covers the blue whale and other sea animals?")], "q long, text string")
    nothing = spark.createDataFrame([], "q long, rank int, title string, url string, text string")
    got = {r["q"]: (r["answer"], r["how"]) for r in reader.answers(asked, nothing, known, exact=True).collect()}
    assert {k: how for k, (_, how) in got.items()} == {0: "known", 1: "similar"} and all(x.upper().replace("-", " ") == "CS 189" for x, _ in got.values())


def test_course_relations(spark):
    rows = spark.createDataFrame([("Who teaches CS 189 in spring?", "In spring EE 120 is by Jo Ray; CS-189 is taught by Ada Byron in the hall"), ("What room is EE 16A in this fall?", "EE16A meets in Wheeler 150 daily"), ("Who teaches it?", "CS 189 by Ada Byron")], "q string, span string")
    got = [[(c["hit"], c["bonus"]) for c in r["c"]] for r in rows.select(reader.relation_candidates(F.col("q"), F.col("span")).alias("c")).collect()]
    assert got == [[("Ada Byron", 5.8)], [("Wheeler 150", 5.7)], []]


def test_reader_falls_back(spark):
    asked = spark.createDataFrame([(1, "What year was it built?"), (2, "Who leads Foo Hall?"), (3, " ")], "q long, text string")
    found = spark.createDataFrame([(1, 1, "t", "u", "The hall was built in 1931. It stands."), (2, 1, "t", "u", "Ada Byron leads Foo Hall.")], "q long, rank int, title string, url string, text string")
    plain_answers = {r["q"]: (r["answer"], r["how"]) for r in reader.answers(asked, found).collect()}
    assert plain_answers[1] == ("1931", "extracted") and plain_answers[2][1] == "extracted" and plain_answers[3] == ("unknown", "unknown")

    def model(system: str, prompt: str) -> str:
        if "built" in prompt.rsplit("Question:", 1)[1]:
            return "1932\nsurely"
        raise RuntimeError("down")

    read = {r["q"]: (r["answer"], r["how"]) for r in reader.answers(asked, found, reader=model).collect()}
    assert read[1] == ("1932", "read") and read[2][1] == "extracted"


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a a c"), (2, "c c"), (3, "d")], "ord long, text string")
    asked = spark.createDataFrame([(0, "A c a"), (1, "zzz")], "q long, text string")
    lengths, tf, n = {0: 2, 1: 3, 2: 2, 3: 1}, {0: {"a": 1}, 1: {"a": 2, "c": 1}, 2: {"c": 2}}, 4
    weight = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = {d: round(sum(q * weight(2) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * lengths[d] / 2)) for t, q in (("a", 2), ("c", 1)) if (f := tf[d].get(t))), 6) for d in tf}
    got = index.bm25_topk(docs, asked).collect()
    assert {r["ord"]: r["score"] for r in got} == want and {r["q"] for r in got} == {0}


def test_picks_equal_the_greedy_loop(spark):
    rng, rows = random.Random(7), []
    for q in range(30):
        for k in range(12):
            rows.append((q, q * 100 + k, f"u{rng.randrange(4)}", round(rng.uniform(0, 9), 3), rng.random() < 0.1, rng.choice([[], ["person"], ["year"]]) if k == 0 else None))
    kinds = {q: next(r[5] for r in rows if r[0] == q) for q in range(30)}
    frame = spark.createDataFrame([(q, o, u, s, 0.0, None, None, u == "u1", kinds[q]) for q, o, u, s, _, _ in rows], "q long, ord long, url string, score double, bonus double, fusion double, page_score double, preferred boolean, types array<string>")
    got = {}
    for r in retrieve.diversified(frame, 5).collect():
        got.setdefault(r["q"], {})[r["rank"]] = r["ord"]
    for q in range(30):
        pages, own = {}, [r for r in rows if r[0] == q]
        for _, o, u, s, *_ in sorted(own, key=lambda r: (-r[3], -r[1])):
            pages.setdefault(u, []).append((s, o))
        group = {u: v[0][0] + 0.25 * sum(s for s, _ in v[1:3]) for u, v in pages.items()}
        penalty, cap = (0.8, 3) if "person" in kinds[q] else (1.0, 2) if "year" in kinds[q] else (1.25, 2)
        pool = [(u, k, s, o) for u in sorted(pages, key=lambda u: (group[u], u), reverse=True) for k, (s, o) in enumerate(pages[u][:cap])]
        used, picked = {}, []
        while len(picked) < 5 and len(picked) < len(pool):
            best = max((x for x in pool if x[3] not in picked), key=lambda x: round(x[2] + 0.08 * group[x[0]] + 2.0 * (x[0] == "u1") - penalty * used.get(x[0], 0) - 0.3 * x[1], 6))
            picked.append(best[3])
            used[best[0]] = used.get(best[0], 0) + 1
        assert [got[q][k + 1] for k in range(len(picked))] == picked


def test_dedup_is_idempotent(spark):
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None), (4, None)], "ord long, text string")
    once = corpus.exact_dedup(rows)
    assert sorted(r["ord"] for r in once.collect()) == [0, 1, 3] == sorted(r["ord"] for r in corpus.exact_dedup(once).collect())


def test_files(spark, tmp_path):
    (tmp_path / "q.txt").write_text("one\n\n three \n")
    (tmp_path / "q.jsonl").write_text('{"question": "a", "answer": "x|y", "url": "u"}\n\n{"answer": "z"}\n')
    (tmp_path / "c.jsonl").write_text('{"url": "u", "text": "body text. More", "summary": " "}\n{"url": "", "text": "x"}\n{"url": "v", "content": "c", "chunk_id": "v#1"}\n')
    (tmp_path / "s.json").write_text('{"version": "1", "data": [{"paragraphs": [{"qas": [{"id": "i", "answers": [{"text": "Yes"}]}, {"id": "j", "answers": []}]}]}]}')
    (tmp_path / "p.json").write_text('{"i": "yes!"}')
    at = lambda name: str(tmp_path / name)
    assert [r["question"] for r in files.read_questions(spark, at("q.txt")).orderBy("pos").collect()] == ["one", "", "three"]
    assert [r["question"] for r in files.read_questions(spark, at("q.txt"), skip_blank=True).orderBy("pos").collect()] == ["one", "three"]
    assert [r["question"] for r in files.read_questions(spark, at("q.jsonl")).orderBy("pos").collect()] == ["a", "unknown"]
    assert files.read_knowledge(spark, [at("none"), at("q.jsonl")]).count() == 1
    with pytest.raises(ValueError):
        files.read_qa(spark, at("q.jsonl"))
    loose = {r["url"]: (r["title"], r["text"]) for r in files.read_corpora(spark, [at("none"), at("c.jsonl")]).collect()}
    assert loose == {"u": ("body text", "body text. More"), "v": ("c", "c")}
    scored = evaluate.squad(files.read_squad(spark, at("s.json")), files.read_squad_predictions(spark, at("p.json")))
    assert {r["id"]: (r["exact_match"], r["missing"]) for r in scored.collect()} == {"i": (1.0, False), "j": (0.0, True)}
    files.write_lines(spark.createDataFrame([(1, "b\nc"), (0, "a")], "pos int, answer string"), at("out"), "answer", "pos")
    assert [r["prediction"] for r in files.read_predictions(spark, at("out")).orderBy("pos").collect()] == ["a", "b c"]
    spark.dataSource.register(files.FetchSource)
    assert spark.read.format("fetch").option("urls", "http://127.0.0.1:9/x").option("timeout", "1").load().first()["html"] is None


def test_annotation(spark):
    questions = spark.createDataFrame([("q", "u", "old", 0), ("q", "u", "new", 1)], "question string, url string, answer string, ord int")
    wanted = spark.createDataFrame([("1", "q", "u", True), ("2", "x", "u", False)], "id string, question string, url string, needs_second_annotation boolean")
    assert annotate.second_annotation(wanted, questions).first()["answer"] == "new"
    assert "answer" not in annotate.blind(annotate.second_annotation(wanted, questions)).columns
    with pytest.raises(ValueError):
        annotate.second_annotation(wanted.withColumn("needs_second_annotation", F.lit(True)), questions)


def test_streamed_postings(spark, tmp_path):
    from loomline.streaming import ingest_postings, read_postings

    docs = spark.createDataFrame([(0, "a b a"), (1, "b")], "ord long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    ingest_postings(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination(60)
    assert sorted(map(tuple, read_postings(spark, str(tmp_path / "index")).collect())) == sorted(map(tuple, index.postings(docs).collect()))


def test_entry_contract(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(entry.oracle_sql()) <= set(found) and entry.entry(spark).count() > 0


def test_command_line(spark, tmp_path, capsys):
    import json

    from loomline import cli

    at = lambda name: str(tmp_path / name)
    (tmp_path / "r.jsonl").write_text('{"question": "a", "answer": "x|y", "url": "u"}\n{"question": "b", "answer": "z", "url": "u"}\n')
    (tmp_path / "p.txt").write_text("Y\nno\n")
    cli.main(["evaluate", at("r.jsonl"), at("p.txt"), "--details-out", at("d")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["exact_match_percent"] == 50.0
    (tmp_path / "q.txt").write_text("b\na\n")
    cli.main(["evaluate", at("r.jsonl"), at("p.txt"), "--questions", at("q.txt")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["exact_match_percent"] == 0.0
    body = "word " * 30
    (tmp_path / "c.jsonl").write_text(f'{{"url": "u", "text": "{body}"}}\n{{"url": "v", "text": "{body}"}}\n{{"url": "w"}}\n')
    cli.main(["filter", at("c.jsonl"), at("kept")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1]) == {"kept": 1, "removed": 2}
    cli.main(["evaluate", at("r.jsonl"), at("p.txt"), "--first", "1"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["exact_match_percent"] == 100.0
    (tmp_path / "site.json").write_text('{"inline_noise": ["Skip this"], "relations": [[[["hall"]], "named ([A-Z][a-z]+)", null, 9.0]]}')
    lines = " ".join(f"Sentence number {k} of the long page is here." for k in range(10))
    (tmp_path / "raw.jsonl").write_text(json.dumps({"url": "https://x.org/a", "text": f"Skip this The hall was named Turing. {lines}"}) + "\n")
    cli.main(["clean", at("raw.jsonl"), at("docs"), at("chunks"), "--site", at("site.json")])
    assert "Skip" not in spark.read.json(at("docs")).first()["text"]
    (tmp_path / "asked.txt").write_text("How was the hall named?\n")
    (tmp_path / "known.jsonl").write_text('{"question": "hall named once", "answer": "", "url": "https://x.org/a"}\n')
    cli.main(["answer", at("docs"), at("asked.txt"), at("told"), "--known", at("known.jsonl"), "--site", at("site.json")])
    assert [r["value"] for r in spark.read.text(at("told")).collect()] == ["Turing"]
    cli.main(["answer", at("docs"), at("asked.txt"), at("told2"), "--reader", "tests.readers:shout"])
    assert [r["value"] for r in spark.read.text(at("told2")).collect()] == ["LOUD"]
    cli.main(["worklist", at("c.jsonl"), at("list"), "--limit", "2"])
    assert spark.read.option("header", True).csv(at("list")).count() == 2
    cli.main(["export", at("r.jsonl"), at("questions")])
    assert [r["value"] for r in spark.read.text(at("questions")).collect()] == ["a", "b"]


def differences_from_sql(spark, name, **tables):
    """What a query gives of tables (rows, schema) less what its SQL gives, and the other way round."""
    import tempfile

    folder, con = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    frame, told = catalogue.queries()[name](spark, folder), con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in told.description]
    got, want = [str([plain(r[n]) for n in names]) for r in frame.collect()], [str([plain(v) for v in row]) for row in told.fetchall()]
    return sorted((Counter(got) - Counter(want)).elements()), sorted((Counter(want) - Counter(got)).elements())


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(*texts, sources=3):
    return [(i, t, "en", f"src{i % sources}", len(t or "")) for i, t in enumerate(texts)], DOCUMENTS


def test_yes_no_starts_as_in_sql(spark):
    assert differences_from_sql(spark, "question_types", documents=documents("Doó is it", "Doñci, x", "do ó", "Does_ x", "Do2", "Do", "Isé", "Have-x")) == ([], [])


def test_documents_without_a_sentence_have_no_row(spark):
    assert differences_from_sql(spark, "sentence_dedup", documents=documents("", "  \n\u00a0", None, "One. one. Two", ".", "a! A! 1? 1?")) == ([], [])


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_of_blocks_equals_the_best_of_all_scores(spark, kind):
    rng = random.Random(5)
    word = lambda: f"w{min(rng.randrange(40), rng.randrange(40))}"
    texts = [" ".join(word() for _ in range(rng.randrange(12))) for _ in range(1300)]
    texts = texts + texts[:200] + ["É W1-w2", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string").withColumn("ord", F.col("ord").cast(kind)).repartition(3)
    asked = spark.createDataFrame([(q, " ".join(word() for _ in range(q % 7))) for q in range(600)], "q long, text string")
    terms = index.query_terms(asked)
    want = index.top(index.bm25_scores(terms, index.postings(docs), index.statistics(docs)), 5)
    got = index.bm25_topk(docs, asked, 5)
    shown = lambda f: sorted((r["q"], r["rank"], r["ord"], round(r["score"], 6)) for r in f.collect())
    assert shown(got) == shown(want) and got.count() > 2000
    # neither postings nor pairs of query and document are dealt out: only the best of each task
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_page_injection_meets_no_pair_without_a_value(spark):
    rng = random.Random(6)
    page_of = {o: f"p{o % 7}" for o in range(120)}
    chunks = spark.createDataFrame(list(page_of.items()), "ord long, url string")
    pages = [(q, f"p{p}", round(rng.random(), 3), r + 1) for q in range(5) for r, p in enumerate(rng.sample(range(7), 4))]
    base = [(q, o, rng.choice([0.5, 1.0])) for q in range(5) for o in rng.sample(range(120), 12)]
    bonus = [(q, o, rng.choice([-2.0, -1.0, 0.0, 1.0])) for q in range(5) for o in list(range(30)) + rng.sample(range(30, 120), 10)]
    present = [(q, o) for q, o, _ in base]
    value = {(q, o): s for q, o, s in base}
    for q, o, b in bonus:
        value[q, o] = value.get((q, o), 0.0) + b
    want = []
    for q, url, score, rank in pages:
        best = max((o for o in page_of if page_of[o] == url), key=lambda o: (value.get((q, o), 0.0), -o))
        if (q, best) not in present:
            want.append((q, best, round(max(0.001, score / (1.2 + 0.03 * rank)), 6)))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    base_, bonus_ = frame(base, "q long, ord long, score double"), frame(bonus, "q long, ord long, bonus double")
    got = retrieve.page_injection(frame(pages, "q long, url string, score double, rank int"), chunks, base_, bonus_, frame(present, "q long, ord long"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("n", [9, 1500])
def test_hints_equal_the_best_of_all_pairs(spark, n):
    rng = random.Random(7)
    text = lambda: " ".join(f"t{min(rng.randrange(90), rng.randrange(90))}" for _ in range(rng.randint(0, 9)))
    known = [(i, text(), f"u{i % (n // 3)}" + "/" * (i % 2)) for i in range(n)]
    asked = [(q, text()) for q in range(530)]
    want = []
    for q, a in asked:
        best = {}
        for _, b, url in known:
            x, y = set(a.split()), set(b.split())
            if x & y and (score := round(len(x & y) + 2 * len(x & y) / len(x | y), 6)) >= 2:
                key = url.rstrip("/")
                best[key] = max(best.get(key, (0, "")), (score, url))
        want += [(q, url, score, r + 1) for r, (score, url) in enumerate(sorted(best.values(), reverse=True)[:3])]
    got = knowledge.hint_urls(spark.createDataFrame(asked, "q long, text string"), spark.createDataFrame(known, "ord long, question string, url string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # no pair of questions by a common token is dealt out
    assert "Generate explode(t" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_similar_questions_are_counted_in_blocks(spark):
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(30), rng.choice((4, 6, 8, 20)))) for _ in range(700)]
    a = spark.createDataFrame([(i, " ".join(f"w{x}" for x in s)) for i, s in enumerate(sets)], "q long, text string")
    known = spark.createDataFrame([(i, " ".join(f"w{x}" for x in (*s[1:], i % 30))) for i, s in enumerate(sets)], "ord long, question string")
    theirs = [{*s[1:], i % 30} for i, s in enumerate(sets)]
    text = lambda items: [f"w{x}" for x in items]
    like = lambda b, s: len(b & s) >= 5 and len(b & s) / len(b | s) >= 0.68
    leaked = {i for i, b in enumerate(theirs) if any(like(b, set(s)) or text((*sets[i][1:], i % 30)) == text(s) for s in sets)}
    got = knowledge.without_leaks(known, a)
    assert {r["ord"] for r in got.where("leaked").collect()} == leaked and 0 < len(leaked) < 700
    assert "Generate explode(t" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_best_chunk_of_a_page_by_bonus_is_among_the_first_of_each_kind(spark):
    rng = random.Random(9)
    words = ("alpha", "beta", "xbeta", "gamma", "betas", "delta.", "Ada Byron", "office", "room", "a@b.org", "dean", "510 642 1234", "archive", "é", "Foo Hall", "-beta", "gamma-")
    rows = [(o, f"https://www2.x.org/{('people', 'news', 'contact')[o % 3]}/p{o % 3}", f"Page {o % 2}" if o % 5 else "Ada Byron", " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for o in range(240)]
    docs = spark.createDataFrame(rows, "ord long, url string, title string, text string")
    docs = docs.withColumn("retrieval", index.retrieval_text(F.col("url"), F.col("title"), F.col("text")))
    asked = ("Who is Ada Byron, dean of alpha beta gamma?", "What email has the office of beta gamma delta?", "Where is the room of alpha beta?", "alpha beta gamma delta", "When was the archive date of gamma delta beta?", "the of")
    about = spark.createDataFrame(list(enumerate(asked)), "q long, text string").select("q", retrieve.question_features(F.col("text")).alias("asked"))
    pages = about.select("q").crossJoin(docs.select("url").distinct()).where("q <> 3 or url like '%news%'")
    value = docs.join(pages, "url").join(about, "q").select("q", "url", "ord", retrieve.boost(F.col("asked"), F.col("title"), F.col("url"), F.col("text"), F.col("retrieval")).alias("bonus"))
    best = {}
    for r in value.collect():
        best[r["q"], r["url"]] = max(best.get((r["q"], r["url"]), (-9, 0)), (r["bonus"], -r["ord"]))
    got = {(r["q"], r["ord"]) for r in retrieve.worth_a_bonus(docs, about, pages).collect()}
    assert len(best) == 16 and all((q, -o) in got for (q, _), (_, o) in best.items())
    assert len(got) < value.count() / 2


def test_texts_are_cleaned_once(spark):
    long = "The first sentence has words. Home is where it is, and so on! READ MORE of it now? menu"
    odd = documents("", None, long, long + " " + long.lower() + ". Four more words here, and then some more of them to come. Menu. One two. A b c.", "x" * 79, "x y z " * 14, "Directory " * 9, "a.b@c.org 5106421234567. Home\n. In this page " + "w " * 50)
    assert differences_from_sql(spark, "clean_docs", documents=odd) == ([], [])
    rows = spark.createDataFrame(*odd).select(F.col("doc_id").alias("ord"), F.lit("u/a-b").alias("url"), "text")
    clean = corpus.clean_documents(rows)
    # sorting for repeats and back again
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 2
    chunks = corpus.sentence_chunks(clean)
    assert corpus.cleaning_stats(rows, clean).first().asDict() == {"raw_documents": 8, "clean_documents": clean.count(), "chunks": chunks.count()}
    assert {r["title"] for r in clean.collect()} >= {"The first sentence has words.", "A B"}
