"""Tool calls of conversations: linked to their results, put in order, checked against schemas and serialised.

Calls and results meet by a shuffled hash join on conversation and identifier, after repeated ones are folded before
the shuffle, so a key has one row on either side and a partition's table holds no hot key.
The order is the level of each call: 0 without a dependency, else one more than the highest level it depends on. Levels
come from rounds over the edges not yet settled; in each round an edge to a call that itself has a single dependency
is lengthened over it, so a chain of n calls takes about log2(n) rounds. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import kept
from loomline.sources.tables import table

#: Tools whose schemas are sent to every task; with more, they are joined by name.
BROADCAST_TOOLS = 10_000

KEY = ["conv_id", "call_id"]


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for all calls; level is null for a call on a cycle or behind one.

    calls: distinct (conv_id, call_id). edges: (conv_id, call_id, dep); those to no call are left out.
    """
    known = calls.select("conv_id", F.col("call_id").alias("dep"))
    edges = kept(edges.distinct().join(known, ["conv_id", "dep"], "left_semi").select(*KEY, "dep", F.lit(1).cast("long").alias("w")))
    done = kept(calls.join(edges, KEY, "left_anti").select(*KEY, F.lit(0).cast("long").alias("level")))
    while not edges.isEmpty():
        low = done.select("conv_id", F.col("call_id").alias("dep"), "level")
        state = edges.join(low, ["conv_id", "dep"], "left").groupBy(*KEY).agg(F.max(F.col("level") + F.col("w")).alias("level"), F.count("*").alias("n"), F.count("level").alias("n_done"))
        new = kept(state.where("n = n_done").select(*KEY, "level"))
        if new.isEmpty():
            break  # only cycles and what is behind them are left
        done = done.unionByName(new)
        left = edges.join(new, KEY, "left_anti")
        one = left.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("dep").alias("over"), F.min("w").alias("more")).where("n = 1").select("conv_id", F.col("call_id").alias("dep"), "over", "more")
        longer = left.join(one, ["conv_id", "dep"], "left").select(*KEY, F.coalesce("over", "dep").alias("dep"), (F.col("w") + F.coalesce("more", F.lit(0).cast("long"))).alias("w"))
        edges = kept(longer.groupBy(*KEY, "dep").agg(F.max("w").alias("w")))
    return calls.join(done, KEY, "left").select(*KEY, "level")


def _kind(value: Column) -> Column:
    """JSON kind of a variant."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "missing")
        .when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "BIGINT", "integer")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _errors() -> Column:
    """What is wrong with a call, as sorted messages; empty if it fits its schema."""
    wrong = F.transform(
        F.col("fields"),
        lambda f: F.when(F.map_contains_key("cells", f["field"]), F.when((f["kind"] != "any") & ~((_kind(F.col("cells")[f["field"]]) == f["kind"]) | ((f["kind"] == "number") & (_kind(F.col("cells")[f["field"]]) == "integer"))), F.concat(F.lit("kind:"), f["field"]))).when(f["required"], F.concat(F.lit("missing:"), f["field"])),
    )
    more = F.transform(F.array_except(F.map_keys("cells"), F.transform("fields", lambda f: f["field"])), lambda k: F.concat(F.lit("unexpected:"), k))
    told = F.array_sort(F.concat(F.filter(wrong, lambda x: x.isNotNull()), more))
    return F.when(F.col("args").isNull() | (F.schema_of_variant("args").startswith("OBJECT") == F.lit(False)), F.array(F.lit("arguments"))).when(F.col("fields").isNull(), F.array(F.lit("tool"))).otherwise(told)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, level, n_calls, n_results, valid, errors, json; results without a call come last.

    calls: conv_id, call_id, name, arguments (JSON), after (ids of calls that come first, or null); results: conv_id,
    call_id, content; schemas: name, field, kind (string, integer, number, boolean, object, array or any), required.
    Calls of one id fold into one, the smallest by name and arguments, with the dependencies of all, and n_calls counts
    them; so do results, with the smallest content. A result without a call has n_calls 0 and no level; a call without
    a result has n_results 0 and a null result. Rows with a null conversation or id can't be linked and are left out.
    Arguments that are null or no JSON object are one error, as is an unknown tool; else each missing, unexpected or
    ill-typed field is one. json has sorted keys at every depth and no spaces. Other columns are ignored.
    """
    calls = calls.where("conv_id is not null and call_id is not null")
    edges = calls.select(*KEY, F.explode("after").alias("dep")).where("dep is not null")
    folded = calls.groupBy(*KEY).agg(F.min(F.struct("name", "arguments")).alias("c"), F.count("*").alias("n_calls")).select(*KEY, "c.name", "c.arguments", "n_calls")
    found = results.where("conv_id is not null and call_id is not null").groupBy(*KEY).agg(F.min("content").alias("content"), F.count("*").alias("n_results"))
    rules = schemas.where("name is not null and field is not null").groupBy("name").agg(F.array_sort(F.collect_set(F.struct("field", "kind", "required"))).alias("fields"))
    rules = F.broadcast(rules) if rules.limit(BROADCAST_TOOLS + 1).count() <= BROADCAST_TOOLS else rules
    ordered = levels(folded.select(*KEY), edges)
    linked = folded.join(ordered, KEY).join(found.hint("shuffle_hash"), KEY, "full_outer").join(rules, "name", "left")
    linked = linked.withColumn("args", F.try_parse_json("arguments")).withColumn("n_calls", F.coalesce("n_calls", F.lit(0)).cast("long")).withColumn("n_results", F.coalesce("n_results", F.lit(0)).cast("long"))
    linked = linked.withColumn("cells", F.coalesce(F.try_variant_get("args", "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
    linked = linked.withColumn("errors", F.when(F.col("n_calls") == 0, F.array(F.lit("call"))).otherwise(_errors()))
    body = F.struct(F.col("args").alias("arguments"), F.col("call_id"), F.col("errors"), F.col("level"), F.col("name"), F.col("content").alias("result"))
    return linked.select(*KEY, "level", "n_calls", "n_results", (F.size("errors") == 0).alias("valid"), "errors", F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


#: Fields of a turn taken as a call.
TURN_SCHEMA = [("system", "text", "string", True), ("system", "turn", "integer", True), ("user", "text", "string", True), ("user", "turn", "integer", True)]


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain turns: every turn but the assistant's asks, and the assistant's next turn answers it.

    A call has the identifier conv_id:turn and follows the two turns before it, as far as they ask.
    """
    name = lambda back: F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))
    asks = F.coalesce(F.col("role"), F.lit("")) != "assistant"
    rows = turns.where("conv_id is not null and turn is not null")
    arguments = F.to_json(F.struct("text", "turn"), {"ignoreNullFields": "false"})
    calls = rows.where(asks).select("conv_id", name(0).alias("call_id"), F.col("role").alias("name"), arguments.alias("arguments"), F.array(name(1), name(2)).alias("after"))
    return calls, rows.where(~asks).select("conv_id", name(1).alias("call_id"), F.col("text").alias("content"))


def chat_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(table(spark, sf_dir, "conversations"))
    schemas = spark.createDataFrame(TURN_SCHEMA, "name string, field string, kind string, required boolean")
    return link_calls(calls, results, schemas).drop("errors")


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, turn, min(struct_pack(name := role, text := text)) AS m, count(*) AS n_calls FROM t WHERE coalesce(role, '') <> 'assistant' GROUP BY ALL),
r AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, count(*) AS n_results FROM t WHERE role = 'assistant' GROUP BY ALL),
e AS (SELECT c.conv_id, c.turn, d.turn AS dep FROM c JOIN c AS d ON c.conv_id = d.conv_id AND d.turn IN (c.turn - 1, c.turn - 2)),
w AS (SELECT conv_id, turn, 0::BIGINT AS level FROM c UNION SELECT e.conv_id, e.turn, w.level + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.dep = w.turn),
l AS (SELECT conv_id, turn, max(level) AS level FROM w GROUP BY ALL),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, c.m, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results, r.content
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT j.conv_id, j.conv_id || ':' || j.turn AS call_id, l.level, n_calls::BIGINT AS n_calls, n_results::BIGINT AS n_results, n_calls > 0 AND m.text IS NOT NULL AND m.name IN ('system', 'user') AS valid,
  CASE WHEN n_calls = 0 THEN '{"arguments":null,"call_id":' || to_json(j.conv_id || ':' || j.turn) || ',"errors":["call"],"level":null,"name":null,"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}'
  ELSE '{"arguments":{"text":' || coalesce(to_json(m.text)::VARCHAR, 'null') || ',"turn":' || j.turn || '},"call_id":' || to_json(j.conv_id || ':' || j.turn) || ',"errors":'
    || CASE WHEN m.name IS NULL OR m.name NOT IN ('system', 'user') THEN '["tool"]' WHEN m.text IS NULL THEN '["kind:text"]' ELSE '[]' END
    || ',"level":' || l.level || ',"name":' || coalesce(to_json(m.name)::VARCHAR, 'null') || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' END AS json
FROM j LEFT JOIN l ON j.conv_id = l.conv_id AND j.turn = l.turn
"""
