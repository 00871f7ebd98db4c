"""Near-duplicate lines by MinHash, with DataFrame functions only.

The signature of a line comes from all its character shingles, and minima of equal lines are combined before they are
shuffled; ROWS minima make a band key, each minimum in two bands of BANDS, and lines that share any key meet the
smallest of them, so a key with very many lines needs no group. Candidates are verified by the exact Jaccard similarity
of all their character shingles, and links become components by distributed union-find.

In bands that then still hold several components (a template that many lines share, say) each two lines of different
components meet, first some and then all, and are verified unless bit maps of their shingles rule them out. So every
pair that shares a band is compared or linked already: exact, and quadratic in the lines of such a band.

With a similarity s of all shingles, the one that defines a link, a pair shares a band with a probability of 0.993 at
0.8, 0.998 at 0.85, 0.9998 at 0.9 if minima are independent; a pair that shares none is not seen. The orders are XORs of
one hash, so lines of few shingles fall short of that.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import let
from loomline.llm.components import connected_components
from loomline.llm.shared import kept

WIDTH, ROWS, BANDS = 9, 3, 10
#: Shingles whose hashes make one row.
AT_ONCE = 8
#: White space but line feeds.
BLANK = " \t\x0b\f\r"
#: Narrow rows that are sent to every task at most; beyond that they are joined.
BROADCAST_IDS = 1_000_000
#: Numbers of 64 bits that the shingles of a line are drawn in, and lines of a band that meet at once.
DRAWN, BLOCK_LINES = 32, 2000
#: How far after a line in a band the lines are that it meets before all do.
NEXT = (1, 2, 4)


def _masks(n: int) -> list[int]:
    """Fixed numbers of 64 bits, one for each order of shingles."""
    state, out = 0x5DEECE66D, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(state - (1 << 63))
    return out


def _bands() -> list[list[int]]:
    """The numbers of the minima of each band: ROWS in turn, then one of each of ROWS such bands."""
    half = BANDS // 2
    return [[b * ROWS + k for k in range(ROWS)] for b in range(half)] + [[(b + k) % half * ROWS + k for k in range(ROWS)] for b in range(half)]


def _points(line: Column) -> Column:
    """The characters in four bytes each, so that a shingle is found without counting from the start."""
    return F.encode(line, "UTF-32")


def _last(line: Column) -> Column:
    """The byte from 1 at which the last shingle begins; a line shorter than one is one by itself."""
    return F.greatest(F.length(line) - WIDTH, F.lit(0)) * 4 + 1


def _shingle(points: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(points, place, F.lit(4 * WIDTH)))


def _shingles(line: Column) -> Column:
    """Hashes of all distinct character shingles."""
    return let(F.struct(_points(line).alias("p"), F.sequence(F.lit(1), _last(line), F.lit(4)).alias("i")), lambda v: F.array_distinct(F.transform(v["i"], lambda i: _shingle(v["p"], i))))


def _similar(x: Column, y: Column, percent: int) -> Column:
    """Whether two lines are similar; their shingles are made once, though the filter may be moved into other plans."""
    enough = lambda v: let(F.size(F.array_intersect(v["x"], v["y"])), lambda n: 100 * n >= percent * (F.size(v["x"]) + F.size(v["y"]) - n))
    return let(F.struct(_shingles(x).alias("x"), _shingles(y).alias("y")), enough)


def _sent(frame: DataFrame) -> DataFrame:
    """Kept, and sent to every task where it is proven to be small."""
    frame = kept(frame)
    return F.broadcast(frame) if frame.count() <= BROADCAST_IDS else frame


def _lines(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, line_no, line and two hashes that name the line by 128 bits."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line")).where(F.ltrim(F.col("line"), F.lit(BLANK)) != "")
    return lines.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit("line"), "line")})


def _signed(lines: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The key and the band keys of each distinct line, and the least and largest k2.

    Minima of equal lines are combined before the shuffle, so no text is shuffled.
    """
    spread = lines.select("k1", "k2", _points(F.col("line")).alias("points"), _last(F.col("line")).alias("last"))
    spread = spread.select("k1", "k2", "points", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(4 * AT_ONCE))).alias("place"))
    # a row for some shingles, the last of a line repeated, so that fewer rows reach the aggregate
    hashes = [_shingle(F.col("points"), F.least(F.col("place") + 4 * j, F.col("last"))).alias(f"h{j}") for j in range(AT_ONCE)]
    least = lambda m: F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(m)) for j in range(AT_ONCE)]))
    signed = spread.select("k1", "k2", *hashes).groupBy(*key).agg(F.min("k2").alias("x"), F.max("k2").alias("y"), *[least(m).alias(f"m{k}") for k, m in enumerate(_masks(ROWS * BANDS // 2))])
    keys = [F.xxhash64(F.lit(b), *[f"m{k}" for k in own]) for b, own in enumerate(_bands())]
    return signed.select(*key, "x", "y", F.array(*keys).alias("bands"))


def _named(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Adds line_id: k1, but a hash of both where different lines share k1."""
    if shared is None:
        return rows.withColumn("line_id", F.col("k1"))
    rows = rows.join(shared.withColumn("shared", F.lit(True)), "k1", "left")
    return rows.withColumn("line_id", F.when(F.col("shared"), F.xxhash64("k2", "k1")).otherwise(F.col("k1"))).drop("shared")


def _banded(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(line_id, bands) of all distinct lines, and the k1 that different lines share, if any."""
    signed = kept(_signed(lines, ("k1",)))
    shared = signed.where("x <> y").select("k1")
    if shared.isEmpty():
        return signed.select(F.col("k1").alias("line_id"), "bands"), None
    shared = _sent(shared)
    apart = _named(_signed(lines.join(shared, "k1", "left_semi"), ("k1", "k2")), shared)
    return kept(signed.where("x = y").select(F.col("k1").alias("line_id"), "bands").unionByName(apart.select("line_id", "bands"))), shared


def _met(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that several lines have, with the smallest of them and their number, and the pairs of that line and each other."""
    several = keys.groupBy("key").agg(F.min("line_id").alias("pivot"), F.max("line_id").alias("last"), F.count("*").alias("n")).where("pivot <> last")
    pivots = _sent(several.select("key", "pivot", "n"))
    pairs = keys.join(pivots, "key").where("line_id <> pivot").select(F.col("pivot").alias("a"), F.col("line_id").alias("b")).distinct()
    return pivots, kept(pairs)


def _texts(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line_id, line) of the lines in pairs."""
    wanted = _sent(pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct())
    return kept(lines.select("line_id", "line").join(wanted, "line_id", "left_semi").groupBy("line_id").agg(F.min("line").alias("line")))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of line_ids whose lines are similar by all their shingles."""
    both = pairs.join(texts.select(F.col("line_id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("line_id").alias("b"), F.col("line").alias("y")), "b")
    return kept(both.where(_similar(F.col("x"), F.col("y"), percent)).select("a", "b"))


def _drawn(texts: DataFrame) -> DataFrame:
    """line_id, the number n of distinct shingles and DRAWN numbers whose bits are the shingles' hashes.

    Where a bit differs, at least one shingle does; so the number of such bits is at most that of differing shingles.
    """
    each = texts.select("line_id", F.explode(_shingles(F.col("line"))).alias("h"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    part = F.pmod(F.shiftright("h", 6), F.lit(DRAWN))
    return each.groupBy("line_id").agg(F.count("*").alias("n"), *[F.coalesce(F.bit_or(F.when(part == k, bit)), F.lit(0).cast("long")).alias(f"d{k}") for k in range(DRAWN)])


def _mixed(held: DataFrame, found: DataFrame) -> DataFrame:
    """line_id, key and component c in the bands that hold several components, the largest of these and the number of lines."""
    held = held.join(found, "line_id", "left").withColumn("c", F.coalesce("component_id", "line_id")).select("line_id", "key", "c")
    sizes = held.groupBy("key", "c").agg(F.count("*").alias("n")).groupBy("key")
    mixed = sizes.agg(F.max(F.struct("n", "c")).alias("largest"), F.sum("n").alias("lines"), F.count("*").alias("several")).where("several > 1")
    return kept(held.join(_sent(mixed.select("key", F.col("largest.c").alias("most"), "lines")), "key"))


def _near(percent: int) -> Column:
    """Whether bit maps and sizes of the lines x and y leave it open that they are similar."""
    apart = reduce(add, [F.bit_count(F.col(f"x.d{k}").bitwiseXOR(F.col(f"y.d{k}"))) for k in range(DRAWN)])
    # common / (all - common) is at least percent / 100 only if no more shingles than that differ
    return F.greatest(apart, F.abs(F.col("x.n") - F.col("y.n"))) * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.line_id", "y.line_id").alias("a"), F.greatest("x.line_id", "y.line_id").alias("b")).distinct()


def _met_next(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of lines and those that come soon after them in a band, which join most of a large group at little cost."""
    line = F.struct("line_id", "c", "n", *[f"d{k}" for k in range(DRAWN)])
    window = Window.partitionBy("key").orderBy("line_id")
    ahead = [F.lead(line, k).over(window).alias(f"y{k}") for k in NEXT]
    met = rows.select(line.alias("x"), *ahead).select("x", F.explode(F.array(*[f"y{k}" for k in NEXT])).alias("y"))
    return _pairs(met.where("y is not null and x.c <> y.c").where(_near(percent)))


def _met_across(rows: DataFrame, percent: int) -> DataFrame:
    """The pairs of lines that share a band and no component, but for those whose drawn shingles differ too much.

    In each band the lines outside its largest component meet all others, these in blocks of about BLOCK_LINES; a pair
    meets in the first band that it shares.
    """
    own = rows.groupBy("line_id").agg(F.collect_set("key").alias("keys"))
    rows = rows.join(own, "line_id").withColumn("blocks", F.floor((F.col("lines") - 1) / BLOCK_LINES).cast("int") + 1)
    x = rows.where("c <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = rows.withColumn("block", F.pmod(F.xxhash64("line_id"), F.col("blocks")).cast("int")).alias("y")
    once = F.expr("x.c <> y.c and (y.c = y.most or x.line_id < y.line_id)")
    first = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    return _pairs(x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.block") == F.col("y.block")) & once & _near(percent) & first))


def near_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = 80) -> DataFrame:
    """One row per line that isn't blank: doc_id, line (from 0), line_id, component_id, kept.

    Lines end at line feeds. Lines are linked if 100 * common shingles >= percent * all shingles of both; equal lines
    always are. line_id is a 64-bit hash of the line, another where different lines share that, component_id the
    smallest line_id reachable, and kept is true for one line of each component: the first by document (null ids
    first), place and hash, and of rows that agree in all of these any one. Null, empty and blank texts give no row;
    their lines always stay. Only `text` and `doc_id` are read, whatever other columns are called; an empty table gives
    an empty result.
    """
    lines = _lines(docs, text, doc_id)
    banded, shared = _banded(lines)
    lines = _named(lines, shared)
    pivots, pairs = _met(banded.select("line_id", F.explode("bands").alias("key")))
    texts = _texts(pairs, lines)
    links = _verified(pairs, texts, percent)
    label = lambda x: _sent(x.withColumnRenamed("node", "line_id").withColumnRenamed("component", "component_id"))
    found = label(connected_components(links))
    held = kept(banded.select("line_id", F.explode("bands").alias("key")).join(_sent(pivots.where("n > 2").select("key")), "key"))
    mixed, done = _mixed(held, found), pairs
    drawn = kept(_drawn(texts.join(_sent(mixed.select("line_id").distinct()), "line_id", "left_semi")))
    for meet in (_met_next, _met_across):
        more = kept(meet(mixed.join(drawn, "line_id"), percent).join(done, ["a", "b"], "left_anti"))
        done = done.unionByName(more)
        if not more.isEmpty():
            links = links.unionByName(_verified(more, texts, percent))
            found = label(connected_components(links))
            mixed = _mixed(held, found)
    places = kept(lines.drop("line").join(found, "line_id", "left").withColumn("component_id", F.coalesce("component_id", "line_id")))
    place = F.struct("doc_id", "line_no", "k1", "k2")
    chosen = places.groupBy("component_id").agg(F.min(place).alias("chosen"))
    out = places.join(chosen, "component_id").withColumn("kept", place.eqNullSafe(F.col("chosen")))
    return _one_of_equal(out, docs, doc_id).select("doc_id", F.col("line_no").cast("long").alias("line"), "line_id", "component_id", "kept")


def _one_of_equal(out: DataFrame, docs: DataFrame, doc_id: str) -> DataFrame:
    """Of rows that agree in id, place and line, one at most stays kept; they need ids that are repeated."""
    again = kept(docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.count("*").alias("n")).where("n > 1"))
    if again.isEmpty():
        return out
    repeated = out.alias("o").join(again.alias("r"), F.expr("o.doc_id <=> r.doc_id"), "left").select("o.*", F.expr("r.n is not null and o.kept").alias("several"))
    # numbers of rows don't change once they are written
    rows = kept(repeated.where("several").withColumn("number", F.monotonically_increasing_id()))
    key = ["line_id", "line_no"]
    one = rows.groupBy("doc_id", *key).agg(F.min("number").alias("least")).withColumnRenamed("doc_id", "_id")
    told = rows.join(one, key).where("doc_id <=> _id").withColumn("kept", F.col("number") == F.col("least"))
    return repeated.where("not several").select(*out.columns).unionByName(told.select(*out.columns))
