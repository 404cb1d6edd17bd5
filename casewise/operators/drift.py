"""Artificial drift: change a log from some step on.

The two most frequent activities so far are kept as entries (count, minus first step, activity), of which the greater one leads. An
activity's entries only grow, so the leader is a running maximum, and whoever is overtaken is second at that moment: the second is the
greater of the last one overtaken and of all other entries since. Both take windows inside a chunk only, whatever the number of activities,
and what a chunk inherits comes from a table with two rows a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.ordering import UNBOUNDED, running, running_total
from casewise.functions.values import hash_uniform

# The four kinds of alteration and the names of inserted activities.
ALTERATIONS = ("switch", "insert", "split", "delete")
INSERTED = "A_new"
SPLIT_SUFFIX = "_post"

ENTRY = "struct<n:bigint,first:bigint,activity:string>"


def check_alteration(kind: str, start: int, transition: int) -> None:
    if kind not in ALTERATIONS:
        raise ValueError(f"kind must be one of {sorted(ALTERATIONS)}")
    if transition < 1:
        raise ValueError("transition must be >= 1")
    if start < 0:
        raise ValueError("start must be >= 0")


def applies(step: Column, draw: Column, rate: float, start: int, transition: int) -> Column:
    """Whether the alteration hits a step: never before ``start``, then with chance ``rate``, ramped up if asked for."""
    if transition == 1:
        chance = F.lit(float(rate))
    else:
        progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - start) / F.lit(float(transition))))
        chance = progress * F.lit(float(rate))
    return (step >= start) & (draw < chance)


def altered_rows(kind: str, hit: Column, first: Column, second: Column) -> Column:
    """Array of (part, activity, ts) rows that an event turns into."""
    activity, ts = F.col("activity"), F.col("ts")

    def row(part: int, name: Column, time: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), name.alias("activity"), time.alias("ts"))

    none = F.lit(None).cast("timestamp")
    same = F.array(row(0, activity, ts))
    if kind == "switch":
        swapped = F.when(activity == first, second).when(activity == second, first).otherwise(activity)
        return F.when(hit & first.isNotNull() & second.isNotNull(), F.array(row(0, swapped, ts))).otherwise(same)
    if kind == "insert":
        return F.when(hit, F.array(row(-1, F.lit(INSERTED), none), row(0, activity, ts))).otherwise(same)
    is_first = F.coalesce(hit & (activity == first), F.lit(False))
    if kind == "split":
        post = row(1, F.concat(first, F.lit(SPLIT_SUFFIX)), none)
        return F.when(is_first, F.array(row(0, activity, ts), post)).otherwise(same)
    return F.when(~is_first, same)


def numbered(log: DataFrame, steps_before: int = 0) -> DataFrame:
    """The log with ``step``, the number of each event, from 1 on or continuing after ``steps_before`` events."""
    steps = running_total(log, ["seq"], {"step": F.lit(1).cast("bigint")})
    return steps.withColumn("step", F.col("step") + steps_before)


def entry(n: Column, first: Column) -> Column:
    """What activities are ranked by; null if it was never counted."""
    return F.when(n > 0, F.struct(n.alias("n"), (-first).alias("first"), F.col("activity").alias("activity")).cast(ENTRY))


def running_two(rows: DataFrame, keys: list[Column | str], order: list[str]) -> DataFrame:
    """Add ``_lead`` and ``_second``: the two best activities of all ``_entry`` up to each row of a key, those of ``_lead0`` and ``_second0`` included."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(UNBOUNDED, 0)
    led = rows.withColumn("_lead", F.greatest("_lead0", F.max("_entry").over(upto)))
    led = led.withColumn("_old", F.coalesce(F.lag("_lead").over(Window.partitionBy(*keys).orderBy(*order)), "_lead0"))
    led = led.withColumn("_new", ~F.col("_lead.activity").eqNullSafe(F.col("_old.activity")))
    led = led.withColumn("_reign", F.sum(F.col("_new").cast("bigint")).over(upto))
    inside = Window.partitionBy(*keys, "_reign").orderBy(*order).rowsBetween(UNBOUNDED, 0)
    overtaken = F.when(F.col("_reign") == 0, F.col("_second0")).otherwise(F.first("_old").over(inside))
    others = F.max(F.when(F.col("_entry.activity") != F.col("_lead.activity"), F.col("_entry"))).over(inside)
    return led.withColumn("_second", F.greatest(overtaken, others)).drop("_old", "_new", "_reign")


def top_activities(steps: DataFrame, start: int, before: DataFrame | None = None) -> DataFrame:
    """Add ``a1`` and ``a2``, the two most frequent activities among steps from ``start`` on up to each event, itself included.

    Among equals the one seen first leads. Both are null as long as there are none. ``before`` (activity, n, first) has the counts and first
    steps of an earlier part of the log.
    """
    counting = F.col("step") >= start
    folds = {"_n": ("sum", counting.cast("bigint")), "_first": ("min", F.when(counting, F.col("step")))}
    counted = running(steps, ["activity"], ["seq"], folds, inclusive=True, split="chunk")
    lead0 = second0 = F.lit(None).cast(ENTRY)
    if before is not None:
        before = before.filter("n > 0")
        counted = counted.join(before.select("activity", F.col("n").alias("_n0"), F.col("first").alias("_first0")), "activity", "left")
        counted = counted.withColumns({"_n": F.col("_n") + F.coalesce("_n0", F.lit(0)), "_first": F.least("_first", "_first0")}).drop("_n0", "_first0")
        best = before.select(entry(F.col("n"), F.col("first")).alias("e")).orderBy(F.desc("e")).limit(2)
        known = best.agg(F.sort_array(F.collect_list("e"), asc=False)).scalar()
        lead0, second0 = F.get(known, F.lit(0)), F.get(known, F.lit(1))
    counted = counted.withColumn("_entry", F.when(counting, entry(F.col("_n"), F.col("_first")))).drop("_n", "_first")
    # two rows per chunk, so the windows without a key see rows / chunkRows rows
    last = counted.groupBy("chunk", "activity").agg(F.max("_entry").alias("_entry"))
    rank = F.row_number().over(Window.partitionBy("chunk").orderBy(F.desc("_entry")))
    last = last.withColumn("_r", rank).filter("_r <= 2").withColumns({"_lead0": lead0, "_second0": second0})
    ends = running_two(last, [F.lit(0)], ["chunk", "_entry"]).groupBy("chunk").agg(F.max("_lead").alias("_lead"), F.max("_second").alias("_second"))
    previous = Window.partitionBy(F.lit(0)).orderBy("chunk")
    inherited = ends.select(
        "chunk", F.coalesce(F.lag("_lead").over(previous), lead0).alias("_lead0"), F.coalesce(F.lag("_second").over(previous), second0).alias("_second0")
    )
    both = running_two(counted.join(inherited, "chunk"), ["chunk"], ["seq"])
    return both.withColumns({"a1": F.col("_lead.activity"), "a2": F.col("_second.activity")}).drop("_lead", "_second", "_lead0", "_second0", "_entry")


def alter_log(
    log: DataFrame,
    kind: str,
    *,
    rate: float = 1.0,
    start: int = 5000,
    transition: int = 1,
    seed: int | str = 0,
    before: DataFrame | None = None,
    steps_before: int = 0,
) -> DataFrame:
    """The altered log with ``step`` (of the original event) and ``part`` (-1 before, 0, 1 after) as its order.

    What it does goes by the two most frequent activities since ``start`` (:func:`top_activities`). ``before`` (activity, n, first) and
    ``steps_before`` continue an earlier part of the log.
    """
    check_alteration(kind, start, transition)
    kept = [c for c in log.columns if c not in ("activity", "ts")]
    rows = top_activities(numbered(log, steps_before), start, before)
    hit = applies(F.col("step"), hash_uniform(F.col("step"), seed), rate, start, transition)
    rows = rows.withColumn("_hit", hit)
    out = altered_rows(kind, F.col("_hit"), F.col("a1"), F.col("a2"))
    return rows.select(*kept, "step", F.explode(out).alias("_r")).select(*kept, "step", "_r.*")
