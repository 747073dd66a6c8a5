"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are joined by identifier, ordered so that a result follows its call and a call follows
the results it needs, checked against the tools' argument schemas and written as canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import saved

#: Rows of a chain of waits, beyond any table (so that sums that run round a cycle stay small); turns of a window; tools broadcast at most.
DEPTH, TURNS, TOOLS = 1 << 41, 4096, 10_000
_FIELDS = ("conv_id long", "turn long", "kind string", "role string", "call_id string", "name string", "arguments string", "content string", "after array<string>")


def _type_name(sql_type: Column) -> Column:
    """JSON type of a variant's SQL type."""
    return (
        F.when(sql_type == "BIGINT", "integer").when(sql_type == "STRING", "string").when(sql_type == "BOOLEAN", "boolean").when(sql_type == "VOID", "null")
        .when(sql_type.startswith("ARRAY"), "array").when(sql_type.startswith("OBJECT"), "object").otherwise("number")
    )


def argument_errors(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Add errors, the sorted list of what is wrong with ``arguments``.

    ``tools``: name, required (array of names), types (map from name to string, integer, number, boolean,
    array or object; an integer is a number).  ``unknown tool``, ``no object`` (also for null, invalid JSON
    and repeated names), ``missing: x``, ``unknown: x`` and ``type: x``.
    """
    known = tools.groupBy(F.col("name").alias("tool")).agg(F.first("required").alias("required"), F.first("types").alias("types"))
    if known.count() <= TOOLS:  # beyond, the tools are joined by shuffle
        known = F.broadcast(known)
    given = F.when(F.try_parse_json("arguments").isNotNull(), F.from_json("arguments", "map<string,variant>"))
    rows = calls.withColumn("given", given).join(known, F.col("name") == F.col("tool"), "left")
    keys = F.map_keys("given")
    right = lambda k: F.element_at("types", k)
    found = lambda k: _type_name(F.schema_of_variant(F.element_at("given", k)))
    missing = F.transform(F.array_except("required", keys), lambda k: F.concat(F.lit("missing: "), k))
    unknown = F.transform(F.filter(keys, lambda k: ~F.map_contains_key("types", k)), lambda k: F.concat(F.lit("unknown: "), k))
    typed = F.filter(keys, lambda k: F.map_contains_key("types", k) & (found(k) != right(k)) & ~((right(k) == "number") & (found(k) == "integer")))
    wrong = F.transform(typed, lambda k: F.concat(F.lit("type: "), k))
    errors = F.when(F.col("tool").isNull(), F.array(F.lit("unknown tool"))).when(F.col("given").isNull(), F.array(F.lit("no object"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))
    return rows.withColumn("errors", errors).drop("given", "tool", "required", "types")


def _times(nodes: DataFrame, waits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, t) of nodes (uid, t) moved behind what they wait for (before, uid); and uids on or behind a cycle, which have no place.

    In every round a wait for a placed row is settled, and a wait for a row that itself waits for one row
    only goes on to that row, so a chain is halved.  Without a cycle each round settles some wait; once
    none is, all that still wait are on or behind a cycle.
    """
    edges = saved(waits.select("before", "uid", F.lit(1).cast("long").alias("far")).distinct(), "waits")
    times = nodes
    while True:
        waiting = edges.groupBy("uid").agg(F.count("*").alias("m"), F.first("before").alias("next"), F.first("far").alias("more"))
        state = times.join(waiting, "uid", "left").select(F.col("uid").alias("before"), F.col("t").alias("t0"), F.coalesce("m", F.lit(0)).alias("m"), "next", "more")
        seen = saved(edges.join(state, "before"), "seen")
        if seen.filter("m = 0").isEmpty():
            return times, edges.select("uid").distinct()
        passed = seen.filter("m <= 1").groupBy("uid").agg(F.max(F.col("t0") + F.col("far")).alias("to"))
        times = saved(times.join(passed, "uid", "left").select("uid", F.greatest("t", F.coalesce("to", "t")).alias("t")), "times")
        on = F.col("m") == 1
        left = seen.filter("m > 0").select("uid", F.when(on, F.col("next")).otherwise(F.col("before")).alias("before"), F.when(on, F.least(F.col("far") + F.col("more"), F.lit(DEPTH))).otherwise(F.col("far")).alias("far"))
        edges = saved(left.groupBy("before", "uid").agg(F.max("far").alias("far")), "waits")


def _ordered(rows: DataFrame) -> DataFrame:
    """Add at: the turn, moved behind what a row waits for; and late for rows on a cycle (or between two), which keep their turns."""
    calls = rows.filter("kind = 'call' and first").select("uid", "conv_id", "call_id", "after")
    results = rows.filter("kind = 'result' and first").select(F.col("uid").alias("result_uid"), F.col("conv_id").alias("c"), F.col("call_id").alias("i"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i"))
    own = calls.join(results, same).select(F.col("uid").alias("before"), F.col("result_uid").alias("uid"), "conv_id")
    needs = calls.select("uid", "conv_id", F.explode("after").alias("call_id")).join(results, same).select(F.col("result_uid").alias("before"), "uid", "conv_id")
    edges = saved(own.union(needs), "waits")
    turns = rows.select("uid", F.col("at").alias("t"))
    behind = edges.join(turns.select(F.col("uid").alias("before"), F.col("t").alias("t0")), "before").join(turns, "uid").filter("t <= t0")
    # conversations in order stay as they are
    moving = saved(behind.select(F.col("conv_id").alias("c")).distinct(), "moving")
    if moving.isEmpty():
        return rows.withColumn("late", F.lit(False))
    edges = saved(edges.join(moving, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi").select("before", "uid"), "waits")
    nodes = saved(turns.join(edges.select("uid").union(edges.select("before")).distinct(), "uid"), "nodes")
    times, stuck = _times(nodes, edges)
    if stuck.isEmpty():
        cyclic = stuck
    else:
        # of these, what nothing on a cycle waits for is only behind one and finds its place after it
        stuck = saved(stuck, "stuck")
        among = edges.join(stuck, "uid", "left_semi").join(stuck.withColumnRenamed("uid", "before"), "before", "left_semi")
        back = among.select(F.col("uid").alias("before"), F.col("before").alias("uid"))
        cyclic = saved(_times(nodes.join(stuck, "uid", "left_semi"), back)[1], "cyclic")
        times = _times(nodes, edges.join(cyclic, "uid", "left_anti"))[0]
    times = times.join(cyclic.withColumn("late", F.lit(True)), "uid", "left")
    out = rows.join(times, "uid", "left")
    return out.withColumn("at", F.coalesce("t", "at")).withColumn("late", F.coalesce("late", F.lit(False))).drop("t")


def format_tool_calls(messages: DataFrame, tools: DataFrame) -> DataFrame:
    """One row a message: conv_id, position (from 0 in the conversation), kind, call_id, status, errors and json.

    ``messages``: conv_id, turn, kind (text, call or result), role, call_id, name, arguments (JSON), content
    and after (ids of calls whose results a call needs); other columns are left out.  The first call and the
    first result of an id in a conversation are linked; status is linked, unanswered, orphan (a result
    without call), repeated (a later one of the same id) or text (also for calls and results without an id).
    Null turns come last, in no special order; null conversations are one; every row on a cycle of needs, or
    between two, has the error ``cycle`` and keeps its turn; an empty table gives no rows.  Canonical JSON has sorted keys,
    no blanks, no null fields.
    """
    types = dict(f.split(" ", 1) for f in _FIELDS)
    rows = messages.select(F.monotonically_increasing_id().alias("uid"), *[F.col(c).cast(t).alias(c) for c, t in types.items()])
    rows = saved(rows, "messages")
    linkable = rows.filter("kind in ('call', 'result') and call_id is not null")
    order = F.struct(F.isnull("turn").alias("none"), "turn", "uid")
    ids = linkable.groupBy("conv_id", "call_id").agg(F.min(F.when(F.col("kind") == "call", order)).alias("call"), F.min(F.when(F.col("kind") == "result", order)).alias("result"))
    ids = saved(ids.select("conv_id", "call_id", F.col("call.uid").alias("call_uid"), F.col("result.uid").alias("result_uid")), "ids")
    left = linkable.withColumnRenamed("conv_id", "c").withColumnRenamed("call_id", "i")
    linked = left.join(ids, left["c"].eqNullSafe(ids["conv_id"]) & (left["i"] == ids["call_id"])).drop("c", "i")
    first = F.col("uid") == F.when(F.col("kind") == "call", F.col("call_uid")).otherwise(F.col("result_uid"))
    first = F.coalesce(first, F.lit(False))
    status = F.when(~first, "repeated").when((F.col("kind") == "call") & F.col("result_uid").isNull(), "unanswered").when((F.col("kind") == "result") & F.col("call_uid").isNull(), "orphan").otherwise("linked")
    linked = linked.withColumn("first", first).withColumn("status", status).drop("call_uid", "result_uid")
    others = rows.filter("not coalesce(kind in ('call', 'result') and call_id is not null, false)").withColumn("first", F.lit(False)).withColumn("status", F.lit("text"))
    # null turns are dealt out behind all real ones
    at = F.coalesce("turn", F.pmod(F.xxhash64("uid"), F.lit(1 << 40)) + (1 << 41))
    both = saved(linked.unionByName(others).withColumn("at", at), "linked")
    placed = _ordered(both).withColumn("slice", F.floor(F.col("at") / TURNS))
    placed = saved(argument_errors(placed.filter("kind = 'call'"), tools).unionByName(placed.filter("kind is null or kind <> 'call'").withColumn("errors", F.array().cast("array<string>"))), "checked")
    slices = placed.groupBy("conv_id", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = saved(slices.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "slices")
    inside = Window.partitionBy("conv_id", "slice").orderBy("at", F.col("kind") == "result", "call_id", F.xxhash64("uid"), "uid")
    numbered = placed.withColumn("k", F.row_number().over(inside) - 1).join(slices, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("slice") == F.col("s")))
    position = (F.col("base") + F.col("k")).cast("long")
    errors = F.when(F.col("late"), F.array_sort(F.array_append("errors", F.lit("cycle")))).otherwise(F.col("errors"))
    out = numbered.select("*", position.alias("position"), errors.alias("e"))
    body = F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "content", F.when(F.size("e") > 0, F.col("e")).alias("errors"), "kind", "name", "position", "role", "status")
    return out.select("conv_id", "position", "kind", "call_id", "status", F.col("e").alias("errors"), F.to_json(body).alias("json"))


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: a user turn is a call that needs the last answer, an assistant turn its result.

    Short questions call ``search``, longer ones ``summarise``; system turns are text.
    """
    number = F.col("turn").cast("string")
    name = lambda t: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    is_call, is_result = F.col("role") == "user", F.col("role") == "assistant"
    tool = F.when(F.length("text") < 150, "search").otherwise("summarise")
    arguments = F.to_json(F.struct(F.col("text").alias("text"), F.when(tool == "search", F.col("turn") + 1).alias("limit"), F.when(tool == "summarise", F.length("text").cast("string")).alias("length")))
    return conversations.select(
        "conv_id", "turn", F.when(is_call, "call").when(is_result, "result").otherwise("text").alias("kind"), "role",
        F.when(is_call, name(number)).when(is_result, name(F.col("turn") - 1)).alias("call_id"),
        F.when(is_call, tool).alias("name"), F.when(is_call, arguments).alias("arguments"), F.when(~is_call | is_call.isNull(), F.col("text")).alias("content"),
        F.when(is_call & (F.col("turn") >= 2), F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("after"),
    )


def example_tools(messages: DataFrame) -> DataFrame:
    """Schemas of the two tools above, as rows; ``length`` must be an integer."""
    spark = messages.sparkSession
    tools = "array('search', 'summarise')"
    return spark.range(2).selectExpr(f"{tools}[id] as name", "array('text') as required", "if(id = 0, map('text', 'string', 'limit', 'integer'), map('text', 'string', 'length', 'integer')) as types")
