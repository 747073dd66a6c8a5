"""Running values and folds over hot keys: a key's rows are cut into slices, and slices pass on what they hold.

A window by a key alone is one task for each key, however many rows it has.  Here each slice of a key's order is a
task's unit: a slice is summed up (its last mark, its maximum, the map from the state before it to the one after
it), the few summaries of a key are run through in order, and what came before reaches the slice as one more row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of an order that a slice spans; seconds, where the order is by time.
PLACES, SECONDS = 10_000, 86_400
_PAST = (1 << 62) - 1


def slice_of(place: Column, width: float = PLACES) -> Column:
    """Number of a place's slice; nulls come last."""
    return F.coalesce(F.floor(place / width).cast("long"), F.lit(_PAST))


def time_slice(at: Column, seconds: float = SECONDS) -> Column:
    return slice_of(F.unix_micros(at), seconds * 1_000_000)


def _nulls_last(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in columns]


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, how: str = "last", width: float = PLACES) -> DataFrame:
    """Adds ``name``: the last value that isn't null, or the maximum, minimum or sum (``how``), of the rows up to each one.

    ``order``: columns, nulls last; the first is a number and a slice spans ``width`` of it.
    """
    by_place = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))])
    total = {"last": F.max_by(value, F.when(F.col(value).isNotNull(), by_place)), "max": F.max(value), "min": F.min(value), "sum": F.sum(value)}[how]
    so_far = {"last": lambda c: F.last(c, ignorenulls=True), "max": F.max, "min": F.min, "sum": F.sum}[how]
    own = df.withColumn("_slice", slice_of(F.col(order[0]), width)).withColumn("_row", F.lit(1))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy(*keys, "_slice").agg(total.alias(value)).withColumn(value, so_far(value).over(before)).filter(F.col(value).isNotNull()).withColumn("_row", F.lit(0))
    line = own.unionByName(carried, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slice").orderBy("_row", *_nulls_last(order)).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn(name, so_far(value).over(w)).filter("_row = 1").drop("_slice", "_row")


def next_greater(df: DataFrame, keys: Sequence[str], value: str, name: str, width: float = PLACES) -> DataFrame:
    """Adds ``name``: the smallest whole number of the column ``value`` above a row's own, within the keys."""
    own = df.withColumn("_slice", slice_of(F.col(value), width)).withColumn("_row", F.lit(1))
    ahead = F.lead(value).over(Window.partitionBy(*keys).orderBy("_slice"))
    carried = own.groupBy(*keys, "_slice").agg(F.min(value).alias(value)).withColumn(value, ahead).filter(F.col(value).isNotNull()).withColumn("_row", F.lit(0))
    w = Window.partitionBy(*keys, "_slice").orderBy(value).rangeBetween(1, Window.unboundedFollowing)
    return own.unionByName(carried, allowMissingColumns=True).withColumn(name, F.min(value).over(w)).filter("_row = 1").drop("_slice", "_row")


def fold_states(events: DataFrame, keys: Sequence[str], order: Sequence[str], event: str, states: Sequence[str], allowed: dict[str, Sequence[str]], cut: Column) -> DataFrame:
    """Adds before, state and ok: the state that each event met and left; an event that ``allowed[state]`` lacks changes nothing.

    ``states``: all of them, the first is where every key starts; an event is the name of the state it leads to.
    ``cut``: number of an event's slice, never falling in ``order``.  A slice becomes a map from each state before it
    to the one after it; a key's maps are run through in order, and each slice is run again from the state it meets.
    """
    n = len(states)
    to = [k if states[k] in allowed.get(s, ()) else j for j, s in enumerate(states) for k in range(n)]
    table, code = F.lit(to), F.coalesce(F.array_position(F.lit(list(states)), F.col(event)).cast("int") - 1, F.lit(-1))
    moved = lambda s, e: F.when(e < 0, s).otherwise(F.get(table, s * n + e))
    place = F.struct(*[x for k, c in enumerate(order) for x in (F.col(c).isNull().alias(f"none{k}"), F.col(c).alias(f"at{k}"))])
    row = F.struct(place.alias("_place"), code.alias("_code"), F.struct(*[F.col(c) for c in events.columns if c not in keys]).alias("_row"))
    own = events.withColumn("_slice", cut).groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    codes = F.transform("_rows", lambda r: r["_code"])
    maps = own.select(*keys, F.struct("_slice", F.aggregate(codes, F.lit(list(range(n))), lambda v, e: F.transform(v, lambda s: moved(s, e))).alias("map")).alias("_map"))
    # states are single characters of a text, which grows without copying a list each time
    digit = lambda s: F.char(s + 48)
    run = lambda rows, start, step: F.aggregate(rows, F.struct(start.alias("at"), F.lit("").alias("out")), step, lambda s: F.split(s["out"], ""))
    number = lambda c: F.transform(c, lambda x: x.cast("int"))
    met = run("_maps", F.lit(0), lambda s, m: F.struct(F.get(m["map"], s["at"]).alias("at"), F.concat(s["out"], digit(s["at"])).alias("out")))
    starts = maps.groupBy(*keys).agg(F.array_sort(F.collect_list("_map")).alias("_maps")).select(*keys, F.explode(F.arrays_zip(F.col("_maps._slice").alias("slice"), number(met).alias("start"))).alias("s"))
    both = own.join(starts.select(*keys, F.col("s.slice").alias("_slice"), F.col("s.start").alias("_start")), [*keys, "_slice"])

    def step(s: Column, e: Column) -> Column:
        after = moved(s["at"], e)
        return F.struct(after.alias("at"), F.concat(s["out"], digit(after)).alias("out"))

    after = number(run(codes, F.col("_start"), step))
    both = both.withColumn("_after", after).withColumn("_before", F.concat(F.array("_start"), F.slice("_after", F.lit(1), F.size("_after") - 1)))
    one = both.select(*keys, F.explode(F.arrays_zip("_rows", "_before", "_after")).alias("e")).select(*keys, "e._rows._row.*", F.col("e._rows._code").alias("_code"), F.col("e._before").alias("_b"), F.col("e._after").alias("_a"))
    names = F.lit(list(states))
    fits = F.get(F.lit([states[k] in allowed.get(s, ()) for s in states for k in range(n)]), F.col("_b") * n + F.col("_code"))
    return one.withColumn("before", F.get(names, "_b")).withColumn("state", F.get(names, "_a")).withColumn("ok", (F.col("_code") >= 0) & F.coalesce(fits, F.lit(False))).drop("_code", "_b", "_a")


def _exits(revisions):
    """Of the revisions that a slice's edits name: where each of them ends, seen from the last edit back."""
    after: dict[int, int] = {}
    for r in reversed(revisions):
        if r is not None:
            after[r] = after.get(r + 1, r + 1)
    return [{"at": k, "to": v} for k, v in after.items()]


def fold_counter(edits: DataFrame, keys: Sequence[str], order: str, named: str, starts: DataFrame, start: str, width: float = PLACES) -> DataFrame:
    """Adds actual (the count an edit met) and ok: an edit that names the count of its key raises it by one, others change nothing.

    ``starts``: keys and ``start``, the count before the first edit; 0 where there is none.  Slices are maps as in
    ``fold_states``, of the counts that their edits name; a key's last slice needs none, so most keys need none at all.
    """
    row = F.struct(F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at")).alias("_place"), F.col(named).alias("_named"), F.struct(*[F.col(c) for c in edits.columns if c not in keys]).alias("_row"))
    own = edits.withColumn("_slice", slice_of(F.col(order), width)).groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    last = edits.groupBy(*keys).agg(F.max(slice_of(F.col(order), width)).alias("_last"))
    exits = F.udf(_exits, "array<struct<at:bigint,to:bigint>>", useArrow=True)
    inner = own.join(last, list(keys)).filter(F.col("_slice") < F.col("_last")).select(*keys, "_slice", exits(F.transform("_rows", lambda r: r["_named"])).alias("exits"))
    ends = last.select(*keys, F.col("_last").alias("_slice"), F.array().cast("array<struct<at:bigint,to:bigint>>").alias("exits"))
    maps = inner.unionByName(ends).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slice", "exits"))).alias("_maps"))
    maps = maps.join(starts.select(*keys, F.col(start).cast("long").alias("_start")), list(keys), "left")
    written = lambda s: F.concat(s["out"], F.lit(","), s["at"].cast("string"))
    read = lambda s: F.transform(F.split(F.substring(s["out"], F.lit(2), F.length(s["out"])), ","), lambda x: x.cast("long"))
    begin = lambda c: F.struct(F.coalesce(c, F.lit(0).cast("long")).alias("at"), F.lit("").alias("out"))
    met = F.aggregate("_maps", begin(F.col("_start")), lambda s, m: F.struct(F.coalesce(F.try_element_at(F.map_from_entries(m["exits"]), s["at"]), s["at"]).alias("at"), written(s).alias("out")), read)
    each = maps.select(*keys, F.explode(F.arrays_zip(F.col("_maps._slice").alias("slice"), met.alias("start"))).alias("s")).select(*keys, F.col("s.slice").alias("_slice"), F.col("s.start").alias("_start"))
    both = own.join(each, [*keys, "_slice"])
    step = lambda s, e: F.struct(F.when(e["_named"] == s["at"], s["at"] + 1).otherwise(s["at"]).alias("at"), written(s).alias("out"))
    actual = F.aggregate("_rows", begin(F.col("_start")), step, read)
    one = both.select(*keys, F.explode(F.arrays_zip(F.col("_rows"), actual.alias("actual"))).alias("e")).select(*keys, "e._rows._row.*", F.col("e.actual").alias("actual"))
    return one.withColumn("ok", F.coalesce(F.col(named) == F.col("actual"), F.lit(False)))


def upper_medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): ``sorted[n // 2]`` of the values that aren't null, from how often each occurs."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    by_value = Window.partitionBy(*keys).orderBy(value)
    seen = F.sum("_n").over(by_value.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    found = counts.withColumn("_seen", seen).withColumn("_total", total).filter(F.col("_seen") > F.floor(F.col("_total") / 2))
    return found.groupBy(*keys).agg(F.min(value).alias(name))
