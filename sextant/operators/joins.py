"""Joins: as-of, interval lookup, validated, null-safe and cascading."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast; its size is taken from the optimizer's statistics.
BROADCAST_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the optimizer knows it to be small; else df as it is, for a shuffled join."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= limit else df


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_on: str,
    right_on: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    fallback: bool = False,
    allow_exact: bool = True,
    with_next: bool = False,
    slices: str | None = "month",
    methods: tuple[str, str] = ("latest_on_or_before", "fallback_to_earliest"),
) -> DataFrame:
    """Each left row with the latest right row of its group at or before it.

    Both sides are laid into one sequence for each group and slice of time (a unit of date_trunc; None: no slices), and the
    last right row is carried forward within it. What a slice starts with comes from a table of the last right row of each
    group and slice, which is as small as their number. So it takes one shuffle of the rows and one sort, makes no pairs, and
    a group that holds most rows is still spread over its slices.

    Of right rows at the same time the last by `tie` counts. With `fallback`, left rows before the first right row take the
    earliest one, selection is told in `selection_method` (by `methods`), and groups without right rows are left out; otherwise such rows get
    nulls. With `with_next`, `next_<right_on>` is the time of the row after the one selected. Null times on the right are left
    out; a null time on the left matches nothing; null groups match null groups.
    """
    r = right.filter(F.col(right_on).isNotNull())
    if with_next:
        r = r.withColumn(f"next_{right_on}", F.lead(right_on).over(Window.partitionBy(*by).orderBy(right_on, *tie)))
        columns = [*columns, f"next_{right_on}"]
    names = [right_on, *(c for c in columns if c != right_on)]
    keys = [f"_k{i}" for i in range(len(by))]
    key = [F.col(c).alias(k) for c, k in zip(by, keys)]
    cut = lambda at: F.date_trunc(slices, at) if slices else F.lit(None).cast("timestamp")
    at_r, at_l = F.col(right_on).cast("timestamp"), F.col(left_on).cast("timestamp")
    side_r = r.select(*key, cut(at_r).alias("_slice"), at_r.alias("_at"), F.struct(*(F.col(c) for c in tie), F.lit(0).alias("_0")).alias("_tie"), F.struct(*(F.col(c) for c in names)).alias("_right"))
    side_l = left.select(*key, cut(at_l).alias("_slice"), at_l.alias("_at"), F.struct(*left.columns).alias("_left"))
    right_type, left_type, tie_type = side_r.schema["_right"].dataType, side_l.schema["_left"].dataType, side_r.schema["_tie"].dataType
    # _side orders what happens at the same time: what a slice starts with, then right rows, then left rows (or the reverse).
    rows_r = side_r.select(*keys, "_slice", "_at", F.lit(1).alias("_side"), "_tie", "_right", F.lit(None).cast(left_type).alias("_left"))
    rows_l = side_l.select(*keys, "_slice", "_at", F.lit(2 if allow_exact else 0).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), F.lit(None).cast(right_type).alias("_right"), "_left")
    both = rows_r.unionByName(rows_l.filter("_at is not null"))
    if slices:
        last = side_r.groupBy(*keys, "_slice").agg(F.max_by("_right", F.struct("_at", "_tie")).alias("_right"))
        wanted = side_l.filter("_slice is not null").select(*keys, "_slice").distinct().withColumn("_right", F.lit(None).cast(right_type))
        known = last.unionByName(wanted).groupBy(*keys, "_slice").agg(F.first("_right", ignorenulls=True).alias("_right"))
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = known.withColumn("_right", F.last("_right", ignorenulls=True).over(earlier)).filter("_right is not null")
        both = both.unionByName(starts.select(*keys, "_slice", F.col("_slice").alias("_at"), F.lit(-1).alias("_side"), F.lit(None).cast(tie_type).alias("_tie"), "_right", F.lit(None).cast(left_type).alias("_left")))
    sequence = Window.partitionBy(*keys, "_slice").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_right", ignorenulls=True).over(sequence)).filter("_left is not null").select(*keys, "_left", "_last")
    # Left rows without a time match nothing and need no order: they stay out of the window.
    found = found.unionByName(side_l.filter("_at is null").select(*keys, "_left", F.lit(None).cast(right_type).alias("_last")))
    if not fallback:
        return found.select("_left.*", *(F.col(f"_last.{c}").alias(c) for c in names))
    firsts = side_r.groupBy(*keys).agg(F.min_by("_right", F.struct("_at", "_tie")).alias("_first")).toDF(*(f"_f{k}" for k in keys), "_first")
    same = [F.col(k).eqNullSafe(F.col(f"_f{k}")) for k in keys]
    found = found.join(sized_broadcast(firsts), same) if same else found.crossJoin(firsts)  # without groups: one row
    found = found.withColumn("selection_method", F.when(F.col("_last").isNotNull(), methods[0]).otherwise(methods[1])).withColumn("_last", F.coalesce("_last", "_first"))
    return found.select("_left.*", "selection_method", *(F.col(f"_last.{c}").alias(c) for c in names))


#: Blocks of days have 8 ** level days; all levels hold the dates that a timestamp can have, which reach 290,000 years either way.
BLOCK_LEVELS = 10
#: Right rows of a group that interval_lookup lays beside each left row; a group with more goes by blocks of days.
FEW_INTERVALS = 64


def interval_lookup(left: DataFrame, right: DataFrame, by: Sequence[str], day: str, start: str, end: str, priority: Column, columns: Sequence[str], undated: bool = False) -> DataFrame:
    """Each left row with one right row of its group: in range before out of range, then by priority, then the latest start,
    then the least of `columns`. Days, starts and ends are dates; a null start or end is open. Right rows with a null priority
    take no part; a left row without a day is out of range (with `undated`, of all but intervals without start and end), and one
    whose group has no right rows gets nulls and is out of range.

    Groups of FEW_INTERVALS right rows or fewer are one array, which each left row looks through. In larger groups no left
    row meets an interval: an interval is cut into the few aligned blocks of days that fill it (at most 14 of a level), and the
    best row of each group and block is kept, by map-side minima. A day lies in one block of each level, so each distinct
    group and day of the left looks up BLOCK_LEVELS rows and takes the best; out of range, one best row a group serves. So a
    hot group is spread over its days and blocks.
    """
    number = lambda at: F.datediff(at, F.lit("1970-01-01").cast("date")).cast("long") + 8**BLOCK_LEVELS // 2
    least = F.struct(F.col("_priority"), F.col(start).isNull().alias("_open"), (-number(F.col(start))).alias("_latest"), *(F.col(c).alias(f"_c_{c}") for c in columns))
    r = right.withColumn("_priority", priority).filter("_priority is not null")
    always = (F.col(start).isNull() & F.col(end).isNull() & F.lit(undated)).alias("_always")
    r = r.select(*by, least.alias("_row"), F.coalesce(number(F.col(start)), F.lit(0)).alias("_s"), F.coalesce(number(F.col(end)) + 1, F.lit(8**BLOCK_LEVELS)).alias("_e"), always)
    r = r.join(r.groupBy(*by).agg(F.count("*").alias("_size")), list(by))
    few = r.filter(F.col("_size") <= FEW_INTERVALS).groupBy(*by).agg(F.collect_list(F.struct("_row", "_s", "_e", "_always")).alias("_rows"))
    many = r.filter(F.col("_size") > FEW_INTERVALS)
    best = many.groupBy(*by).agg(F.min("_row").alias("_any"), F.min(F.when(F.col("_always"), F.col("_row"))).alias("_without_day"))
    days = left.select(*by, F.col(day).alias("_day")).filter("_day is not null").join(sized_broadcast(best.select(*by)), list(by), "left_semi").distinct()
    own = F.array(*(F.struct(F.lit(level).alias("_level"), F.expr(f"_n div {8**level}").alias("_block")) for level in range(BLOCK_LEVELS)))
    asked = days.withColumn("_n", number(F.col("_day"))).select(*by, "_day", F.explode(own).alias("_at"))
    inside = asked.join(_day_blocks(many, by), [*by, "_at"]).groupBy(*by, "_day").agg(F.min("_row").alias("_inside"))
    found = left.withColumn("_day", F.col(day)).withColumn("_n", number(F.col(day))).join(few, list(by), "left")
    found = found.join(inside, [*by, "_day"], "left").join(sized_broadcast(best), list(by), "left")
    held = F.filter("_rows", lambda x: F.coalesce((F.col("_n") >= x["_s"]) & (F.col("_n") < x["_e"]), x["_always"]))
    hit = F.coalesce(F.array_min(F.transform(held, lambda x: x["_row"])), "_inside", F.when(F.col("_n").isNull(), F.col("_without_day")))
    found = found.withColumn("_hit", hit).withColumn("_found", F.coalesce("_hit", F.array_min(F.transform("_rows", lambda x: x["_row"])), "_any"))
    return found.select(*left.columns, *(F.col(f"_found._c_{c}").alias(c) for c in columns), F.col("_hit").isNotNull().alias("in_range"))


def _day_blocks(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _at, _row): the best row of each group and aligned block, of intervals of days from _s to before _e."""
    up = lambda level: F.expr(f"_s div {8**level} + if(_s % {8**level} > 0, 1, 0)")
    down = lambda level: F.expr(f"_e div {8**level}")
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda k: F.struct(F.lit(level).alias("_level"), k.alias("_block"))))
    parts = []
    for level in range(BLOCK_LEVELS):
        a, b = up(level), down(level)
        # What the next level does not fill; above the last one, nothing is filled.
        inner_a, inner_b = (up(level + 1) * 8, down(level + 1) * 8) if level + 1 < BLOCK_LEVELS else (F.lit(0), F.lit(0))
        split = inner_a < inner_b
        parts += [run(level, a, F.when(split, inner_a).otherwise(b)), F.when(split, run(level, inner_b, b))]
    none = F.array().cast("array<struct<_level:int,_block:bigint>>")
    cut = intervals.select(*by, "_row", F.explode(F.concat(*(F.coalesce(p, none) for p in parts))).alias("_at"))
    return cut.groupBy(*by, "_at").agg(F.min("_row").alias("_row"))


class CardinalityError(ValueError):
    pass


def validated_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", validate: str = "many_to_one", suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """A join that first checks that keys are unique where they must be; columns of both sides get suffixes."""
    for side, df, wanted in (("left", left, validate.startswith("one_to")), ("right", right, validate.endswith("to_one"))):
        if wanted and not df.groupBy(*on).count().filter("count > 1").isEmpty():
            raise CardinalityError(f"{validate}: keys repeat on the {side}")
    shared = [c for c in left.columns if c in right.columns and c not in on]
    for c in shared:
        left, right = left.withColumnRenamed(c, c + suffixes[0]), right.withColumnRenamed(c, c + suffixes[1])
    return left.join(right, list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null matches null. Keys come from the left."""
    r = right.select(*(F.col(c).alias(f"_k_{c}") if c in on else F.col(c) for c in right.columns))
    condition = None
    for c in on:
        this = left[c].eqNullSafe(r[f"_k_{c}"])
        condition = this if condition is None else condition & this
    return left.join(r, condition, how).drop(*(f"_k_{c}" for c in on))


def unmatched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right.select(*on).distinct(), list(on), "left_anti")


def require_matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    missing = unmatched(left, right, on).select(*on).distinct().limit(5).collect()
    if missing:
        raise KeyError(f"no match for {[tuple(r) for r in missing]}")
    return left


def lookup_table(catalogue: DataFrame, key: Column, entity: str, name: str) -> DataFrame:
    """key -> the one entity it names (smallest name), or null and a note if it names several."""
    pair = F.struct(F.col(name).alias("name"), F.col(entity).alias("entity"))
    # A key's rows are counted before they are listed; what is listed are distinct entities.
    t = catalogue.select(key.alias("key"), pair.alias("p"), F.col(entity).alias("e")).filter("key <> ''").distinct()
    t = t.groupBy("key").agg(F.countDistinct("e").alias("n"), F.min("p").alias("p"), F.array_sort(F.collect_set(F.concat_ws(":", F.col("e").cast("string"), F.col("p.name")))).alias("all"))
    return t.select("key", F.when(F.col("n") == 1, F.col("p")).alias("hit"), F.when(F.col("n") > 1, F.concat(F.lit("Ambiguous "), F.col("key"), F.lit(" -> "), F.array_join("all", "; "))).alias("note"))


def cascade_lookup(labels: DataFrame, label: str, steps: Sequence[tuple[str, Column, DataFrame]]) -> DataFrame:
    """Labels resolved by the first step that knows them. A step is (method, key of the label, lookup_table); the tables hold
    a row for each key. Adds entity, entity_name, method ('unmapped' if none) and the first note of ambiguity."""
    out = labels
    for i, (_, key, lookup) in enumerate(steps):
        t = lookup.select(F.col("key").alias(f"_key{i}"), F.col("hit").alias(f"_hit{i}"), F.col("note").alias(f"_note{i}"))
        out = out.withColumn(f"_own{i}", key).join(sized_broadcast(t), F.col(f"_own{i}") == F.col(f"_key{i}"), "left")
    hits = [F.col(f"_hit{i}") for i in range(len(steps))]
    method = F.coalesce(*(F.when(h.isNotNull(), F.lit(m)) for h, (m, _, _) in zip(hits, steps)), F.lit("unmapped"))
    found = F.coalesce(*hits)
    return out.select(*labels.columns, found["entity"].alias("entity"), found["name"].alias("entity_name"), method.alias("method"), F.coalesce(*(F.col(f"_note{i}") for i in range(len(steps)))).alias("note"))
