"""Ranked retrieval beyond BM25: fusion of query variants, boosts, page scores and picks spread over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import rules as R
from loomline.functions import text as X
from loomline.functions import urls as U
from loomline.operators import classes, index

CHUNK_CANDIDATES, PAGE_CANDIDATES = 96, 48


def ranked(docs: DataFrame, questions: DataFrame, variants: DataFrame, k: int = CHUNK_CANDIDATES, text: str = "text") -> DataFrame:
    """(q, pos, ord, score, rank): the k best of each question (q, text), as pos 0, and of each variant (q, pos, text) from
    pos 1, in one pass over all of them. Kept by Spark, since several branches read it."""
    asked = questions.select("q", F.lit(0).alias("pos"), "text").unionByName(variants.where("pos > 0").select("q", "pos", "text"))
    found = index.bm25_topk(docs, asked.select(F.struct("q", "pos").alias("q"), "text"), k, text)
    return found.select("q.q", "q.pos", "ord", "score", "rank").persist()


def fused(found: DataFrame, variants: DataFrame) -> DataFrame:
    """(q, ord, fusion): weighted reciprocal ranks over the best of each variant (q, pos, weight) in ranked().

    Rounded as SQL does, by the millionths: sums such as 1.15 / 40 + 0.95 / 32 lie between two of them."""
    weight = index.checked_broadcast(variants.where("pos > 0").select("q", "pos", "weight"))
    return found.join(weight, ["q", "pos"]).groupBy("q", "ord").agg((F.round(F.sum(F.col("weight") / (10 + F.col("rank"))) * 1e6) / 1e6).alias("fusion"))


def question_features(question: Column) -> Column:
    """What boosts need of a question, computed once for all its pages."""
    return F.struct(F.lower(question).alias("low"), R.question_types(question).alias("types"), R.focus_terms(question).alias("focus"), R.focus_ngrams(question).alias("bigrams"), R.person_in_question(question).alias("person"))


def marks(title: Column, text: Column, retrieval: Column) -> dict[str, Column]:
    """What a bonus needs of a chunk alone, besides its URL and title."""
    body, heading = F.lower(text), F.lower(title)
    return {
        "role": R.any_in(body, R.ROLE_TERMS),
        "role_title": R.any_in(heading, R.ROLE_TERMS),
        "contact": R.any_in(body, ("email", "contact", "phone", "telephone")),
        "email": text.rlike(R.EMAIL),
        "phone": text.rlike(R.PHONE),
        "place": R.any_in(body, ("office", "located", "address", "hall", "room", "building")),
        "room": text.rlike(R.ROOM),
        "building": text.rlike(R.BUILDING),
        "archive": F.contains(F.lower(retrieval), F.lit("archive")),
    }


#: Marks that count for questions of a type; those of roles count where a question asks for one.
MARKS_OF = {"email": ("contact", "email", "phone"), "phone": ("contact", "email", "phone"), "location": ("place", "room", "building"), "date": ("archive",), "year": ("archive",)}


def boost(asked: Column, title: Column, url: Column, text: Column, retrieval: Column, legacy_host: str = "", people_host: str = "", help_host: str = "") -> Column:
    """What a question (by question_features) and a page have in common beyond term weights, and whether the page is of
    the kind asked for."""
    types, low, mark = asked["types"], asked["low"], marks(title, text, retrieval)
    page, full = F.lower(url), F.lower(retrieval)
    focus, site = asked["focus"], U.host(url)
    zero = F.lit(0.0)
    has = lambda *names: F.arrays_overlap(types, F.array(*[F.lit(n) for n in names]))
    on = lambda name: U.family(url, name)
    give = lambda test, value: F.when(F.coalesce(test, F.lit(False)), F.lit(value)).otherwise(zero)
    at = lambda name: F.contains(site, F.lit(name)) if name else F.lit(False)
    overlap = F.size(F.array_intersect(focus, X.tokens(retrieval)))
    bigrams = F.size(F.filter(asked["bigrams"], lambda b: F.contains(full, b)))
    in_title = F.size(F.array_intersect(focus, X.tokens(title)))
    person = asked["person"]
    surname = F.element_at(F.split(F.lower(X.collapse(person)), " "), -1)
    personal = on("homepage") | at(people_host)
    office = R.any_in(low, ("division office", "main office", "office located", "office location", "main office close"))
    report, published = on("report") | (at(legacy_host) & F.contains(page, F.lit("/pubs/"))), on("publication")
    asks_role = R.any_in(low, R.ROLE_TERMS)
    light = on("news") | on("book")
    general = [
        F.when(overlap >= 2, 0.15 * F.least(overlap, F.lit(4))).otherwise(zero),
        0.35 * F.least(bigrams, F.lit(2)),
        give(asks_role & mark["role"], 0.7),
        give(asks_role & mark["role_title"], 0.4),
        0.35 * F.least(in_title, F.lit(3)),
        give(at(legacy_host) & (overlap >= 2), 0.6),
        give(F.contains(low, F.lit("memorial")) & F.contains(page, F.lit("/connect/support/")), 0.8),
        give(R.any_in(low, ("publication", "paper")) & published, 1.0),
        F.when(R.any_in(low, ("technical report", "tech report")), F.when(report, 2.0).when(published, 1.0).otherwise(-0.5)).otherwise(zero),
    ]
    for_person = [
        give(F.contains(full, F.lower(X.collapse(person))), 3.0),
        F.when(F.contains(page, surname), 1.4).when(F.contains(full, surname), 0.8).otherwise(zero),
        give(R.plausible_name(title), 0.6),
        give(on("people"), 1.2),
        give(personal, 1.0),
        give(on("news"), -0.4),
    ]
    for_contact = [
        give(mark["contact"], 0.9),
        give(has("email") & mark["email"], 1.0),
        give(has("phone") & mark["phone"], 1.0),
        give(on("contact"), 1.3),
        give(on("people"), 1.0),
        give(at(help_host) & R.any_in(low, ("helpdesk", "account", "password", "email", "network", "service")), 1.0),
        give(office & personal, -1.2),
        give(light, -0.6),
    ]
    for_place = [
        give(mark["place"], 0.9),
        F.when(mark["room"], 0.8).when(mark["building"], 0.6).otherwise(zero),
        give(on("contact"), 1.3),
        give(on("people") | personal, 0.9),
        give(office & personal, -1.0),
        give(light, -0.5),
    ]
    for_time = [
        give(R.any_in(page, ("/news/", "/about/history", "/special-events", "/events/")), 0.7),
        give(F.contains(low, F.lit("archive")) & mark["archive"], 0.7),
        give(F.contains(low, F.lit("colloquium")) & F.contains(page, F.lit("/research/colloquium/")), 1.0),
    ]
    total = sum(general[1:], general[0])
    for test, parts in ((has("person"), for_person), (has("email", "phone"), for_contact), (has("location"), for_place), (has("date", "year"), for_time)):
        total = total + F.when(test, sum(parts[1:], parts[0])).otherwise(zero)
    return F.round(total, 6)


def preferred_chunks(chunks: DataFrame, questions: DataFrame, hints: DataFrame) -> DataFrame:
    """(q, ord): for each hinted URL (q, url) the chunk with the most tokens of the question; first on ties."""
    keyed = chunks.select("ord", U.key(F.col("url")).alias("key"), X.tokens(F.col("retrieval")).alias("t"))
    asked = hints.select("q", U.key(F.col("url")).alias("key")).distinct().join(questions.select("q", F.array_distinct(X.tokens(F.col("text"))).alias("qt")), "q")
    met = keyed.join(index.checked_broadcast(asked), "key").withColumn("n", F.size(F.array_intersect("qt", "t")))
    best = met.groupBy("q", "key").agg(F.max(F.struct("n", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("q", (-F.col("b.o")).alias("ord"))


def page_injection(page_top: DataFrame, chunks: DataFrame, base: DataFrame, bonus: DataFrame, present: DataFrame) -> DataFrame:
    """(q, ord, score) of the best chunk of each page among a query's best pages, where it isn't present yet.

    page_top: q, url, score, rank; chunks: ord, url; base: q, ord, score; bonus: q, ord, bonus; present: q, ord. Chunks
    without a score or bonus have the value 0, so only the first of those on a page counts: of the first n + 1 chunks of
    a page one has neither where no query has more than n that do. No query meets all chunks of a page.
    """
    valued = base.select("q", "ord", F.col("score").alias("v")).unionByName(bonus.select("q", "ord", F.col("bonus").alias("v"))).groupBy("q", "ord").agg(F.sum("v").alias("v"))
    valued = chunks.select("ord", "url").join(index.checked_broadcast(valued.persist()), "ord").join(page_top.select("q", "url"), ["q", "url"]).select("q", "url", "ord", "v").persist()
    most = valued.groupBy("q", "url").count().agg(F.max("count").alias("n")).first()["n"] or 0
    place = F.row_number().over(Window.partitionBy("url").orderBy("ord"))
    early = chunks.select("url", "ord").withColumn("place", place).where(F.col("place") <= most + 1).select("url", "ord").persist()
    first = page_top.select("q", "url").join(early, "url").join(valued.select("q", "ord"), ["q", "ord"], "left_anti").groupBy("q", "url").agg(F.min("ord").alias("ord"))
    return injected(page_top, valued.unionByName(first.withColumn("v", F.lit(0.0))), present)


def injected(page_top: DataFrame, valued: DataFrame, present: DataFrame) -> DataFrame:
    """(q, ord, score) of the chunk (q, url, ord, v) of the highest value on each page, the first on ties, if not present."""
    best = valued.groupBy("q", "url").agg(F.max(F.struct("v", (-F.col("ord")).alias("o"))).alias("b")).join(page_top.select("q", "url", F.col("score").alias("page_score"), "rank"), ["q", "url"])
    score = F.greatest(F.lit(0.001), F.col("page_score") / (1.2 + 0.03 * F.col("rank")))
    return best.select("q", (-F.col("b.o")).alias("ord"), F.round(score, 6).alias("score")).join(present, ["q", "ord"], "left_anti")


def worth_a_bonus(docs: DataFrame, about: DataFrame, pages: DataFrame) -> DataFrame:
    """(q, ord) of chunks among which is the one of the highest bonus, the first on ties, of each page (q, url).

    docs: ord, url, title, text, retrieval; about: q, asked. If there are many pages of questions, all their chunks.
    """
    rows = pages.select("q", "url").limit(index.BROADCAST_TERMS + 1).collect()
    if len(rows) > index.BROADCAST_TERMS:
        return pages.select("q", "url").join(docs.select("ord", "url"), "url").select("q", "ord")
    person = F.when(F.array_contains("asked.types", "person"), F.lower(X.collapse(F.col("asked.person"))))
    needed = about.select("q", "asked.low", "asked.types", "asked.focus", "asked.bigrams", person.alias("person")).withColumn("role", R.any_in(F.col("low"), R.ROLE_TERMS)).collect()
    made = marks(F.col("title"), F.col("text"), F.col("retrieval"))
    bit = {name: 1 << i for i, name in enumerate(made)}
    asked = []
    for r in needed:
        counted = {m for t in r["types"] or () for m in MARKS_OF.get(t, ())} | ({"role", "role_title"} if r["role"] else set())
        asked.append({"focus": r["focus"] or [], "bigrams": r["bigrams"] or [], "person": r["person"], "surname": None if r["person"] is None else r["person"].split(" ")[-1], "marks": sum(bit[m] for m in counted)})
    number = {r["q"]: n for n, r in enumerate(needed)}
    bits = sum((F.when(F.coalesce(made[m], F.lit(False)), F.lit(b)).otherwise(F.lit(0)) for m, b in bit.items()), F.lit(0))
    found = classes.firsts(docs.select("ord", "url", "title", F.lower("retrieval").alias("full"), bits.alias("marks")), asked, [(number[r["q"]], r["url"]) for r in rows])
    names = about.sparkSession.createDataFrame([(n, q) for q, n in number.items()], T.StructType([T.StructField("n", T.LongType()), about.schema["q"]]))
    return found.join(F.broadcast(names), "n").select("q", "ord")


def diversified(candidates: DataFrame, k: int = 8) -> DataFrame:
    """The k picks of each query with a rank, spread over pages.

    candidates: q, ord, url, score, bonus, fusion, page_score, preferred and types (of the question). Picking the best
    of what is left, each time with a penalty for pages used before, comes down to one sort: within a page values fall
    with rank, so a page's picks come in order and its uses equal the rank.
    """
    zero = F.lit(0.0)
    adjusted = F.round(F.col("score") + F.coalesce("bonus", zero) + F.coalesce("fusion", zero) + 0.7 * F.coalesce("page_score", zero), 6)
    scored = candidates.withColumn("adjusted", adjusted)
    in_page = Window.partitionBy("q", "url").orderBy(F.desc("adjusted"), F.desc("score"), F.desc("ord"))
    placed = scored.withColumn("page_rank", F.row_number().over(in_page) - 1)
    share = F.when(F.col("page_rank") == 0, F.col("adjusted")).when(F.col("page_rank") <= 2, 0.25 * F.col("adjusted"))
    placed = placed.withColumn("group_score", F.round(F.sum(share).over(Window.partitionBy("q", "url")), 6))
    wide = F.arrays_overlap("types", F.array(*[F.lit(t) for t in ("person", "email", "phone", "location")]))
    dated = F.arrays_overlap("types", F.array(F.lit("date"), F.lit("year")))
    penalty = F.when(wide, 0.8).when(dated, 1.0).otherwise(1.25)
    value = F.round(F.col("adjusted") + 0.08 * F.col("group_score") + F.when(F.coalesce("preferred", F.lit(False)), 2.0).otherwise(zero) - (penalty + 0.3) * F.col("page_rank"), 6)
    picks = placed.where(F.col("page_rank") < F.when(wide, 3).otherwise(2)).withColumn("value", value)
    # pool order: pages by score, the later name first, then places within a page
    order = Window.partitionBy("q").orderBy(F.desc("value"), F.desc("group_score"), F.desc("url"), F.asc("page_rank"))
    return picks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 8, hints: DataFrame | None = None, **hosts: str) -> DataFrame:
    """The k chunks of each question: q, ord, url, title, text, rank and value.

    chunks: ord, url, title, text; questions: q, text; hints: q, url of pages that likely answer. Questions without any
    candidate have no row.
    """
    docs = chunks.withColumn("retrieval", index.retrieval_text(F.col("url"), F.col("title"), F.col("text"), hosts.get("legacy_label", "www2")))
    variants = questions.select("q", F.explode(R.query_variants(F.col("text"))).alias("v")).select("q", "v.*")
    # what several branches of the plan read is kept by Spark, which rebuilds lost parts
    found = ranked(docs, questions, variants, max(32, 12 * k), "retrieval")
    base = found.where("pos = 0").select("q", "ord", "score")
    pages = index.bm25_topk(index.group_documents(docs, "url", "retrieval"), questions, max(20, 6 * k)).select("q", F.col("ord").alias("url"), "score", "rank")
    pages = pages.join(base.select("q").distinct(), "q", "left_semi").persist()
    fusion = fused(found, variants).join(base.select("q").distinct(), "q", "left_semi")
    body = docs.select("ord", "url", "title", "text", "retrieval")
    about = questions.select("q", question_features(F.col("text")).alias("asked"))
    named = {n: hosts[n] for n in ("legacy_host", "people_host", "help_host") if n in hosts}

    def bonus_of(pairs: DataFrame) -> DataFrame:
        # kept and counted, so that pairs are sent to the chunks
        met = body.join(index.checked_broadcast(pairs.select("q", "ord").distinct().persist()), "ord").join(index.checked_broadcast(about), "q")
        return met.select("q", "ord", boost(F.col("asked"), F.col("title"), F.col("url"), F.col("text"), F.col("retrieval"), **named).alias("bonus"))

    pool = base
    if hints is not None:
        preferred = preferred_chunks(docs, questions, hints).join(base.select("q").distinct(), "q", "left_semi")
        pool = pool.unionByName(preferred.select("q", "ord", F.lit(0.01).alias("score")).join(pool, ["q", "ord"], "left_anti"))
    # a score only adds to a bonus, so the best of a page is among the best by bonus or has a score
    valued = bonus_of(worth_a_bonus(docs, about, pages).unionByName(base.select("q", "ord"))).join(base, ["q", "ord"], "left")
    valued = body.select("ord", "url").join(index.checked_broadcast(valued.select("q", "ord", (F.col("bonus") + F.coalesce("score", F.lit(0.0))).alias("v")).persist()), "ord")
    pool = pool.unionByName(injected(pages, valued.join(pages.select("q", "url"), ["q", "url"]), pool)).persist()
    met = body.select("ord", "url").join(index.checked_broadcast(pool), "ord").join(bonus_of(pool), ["q", "ord"]).join(fusion, ["q", "ord"], "left")
    met = met.join(pages.select("q", "url", F.col("score").alias("page_score")), ["q", "url"], "left")
    met = met.join(index.checked_broadcast(about.select("q", F.col("asked.types").alias("types"))), "q")
    if hints is None:
        met = met.withColumn("preferred", F.lit(False))
    else:
        liked = hints.select("q", U.key(F.col("url")).alias("key"), F.lit(True).alias("preferred")).distinct()
        met = met.withColumn("key", U.key(F.col("url"))).join(liked, ["q", "key"], "left").drop("key")
    picks = diversified(met, k).select("q", "ord", "rank", "value").persist()
    return body.select("ord", "url", "title", "text").join(index.checked_broadcast(picks), "ord")
