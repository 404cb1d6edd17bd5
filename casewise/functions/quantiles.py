"""Exact order statistics of any number of groups by distributed selection.

The range of a group's values is cut into equal parts, the parts are counted, and only the part that holds a wanted rank is looked at
again, now between its own least and greatest value. A part with few rows is sorted. So no task and no aggregation buffer ever holds all
values of a group, whether they are few values repeated or all distinct: a round moves at most ``PARTS`` counts per range, and the last step sorts
``few`` rows. Two different values never stay in one part together with all others, so every round makes progress.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.scratch import written

#: parts of a range that are counted in one round
PARTS = 4096
#: rows of a range that are sorted instead
FEW = 100_000
#: stands for infinity while parts are computed; fixed value
GREATEST = 1.7976931348623157e308


def ranked_values(df: DataFrame, value: str, ranks: DataFrame, by: list[str], *, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """``ranks`` (by..., rank from 1) with ``v``, the value of that rank in its group; ranks that don't exist fall away.

    Null and NaN are no values. An infinite value comes out as infinite (and so would the greatest finite double).
    """
    keys = [F.col(c) for c in by] or [F.lit(0).alias("_g")]
    names = by or ["_g"]
    v = F.greatest(F.least(F.col(value).cast("double"), F.lit(GREATEST)), F.lit(-GREATEST))
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, v.alias("v"))
    span = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = ranks.select(*keys, "rank").distinct().withColumn("left", F.col("rank"))
    wanted = written(_same(wanted, span, names, []).filter("rank BETWEEN 1 AND n"), "ranks")
    while not (open_ := wanted.filter((F.col("n") > few) & (F.col("lo") < F.col("hi")))).isEmpty():
        ranges = open_.select(*names, "lo", "hi").distinct()
        inside = _inside(rows, ranges, names)
        # halves, so that the width of a range can't overflow
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        counted = inside.groupBy(*names, "lo", "hi", F.least(F.floor(share * parts), F.lit(parts)).alias("part")).agg(
            F.count(F.lit(1)).alias("m"), F.min("v").alias("from"), F.max("v").alias("to")
        )
        upto = F.sum("m").over(Window.partitionBy(*names, "lo", "hi").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        counted = counted.withColumn("before", upto - F.col("m"))
        closer = _same(open_.drop("n"), counted, names, ["lo", "hi"]).filter((F.col("left") > F.col("before")) & (F.col("left") <= F.col("before") + F.col("m")))
        closer = closer.select(*names, "rank", (F.col("left") - F.col("before")).alias("left"), F.col("m").alias("n"), F.col("from").alias("lo"), F.col("to").alias("hi"))
        done = wanted.filter((F.col("n") <= few) | (F.col("lo") >= F.col("hi"))).select(closer.columns)
        wanted = written(done.unionByName(closer), "ranks")
    flat = wanted.filter("lo = hi").select(*names, "rank", F.col("lo").alias("v"))
    rest = wanted.filter("lo < hi")
    place = F.row_number().over(Window.partitionBy(*names, "lo", "hi").orderBy("v"))
    sorted_ = _inside(rows, rest.select(*names, "lo", "hi").distinct(), names).withColumn("place", place)
    found = _same(rest, sorted_, names, ["lo", "hi"]).filter(F.col("left") == F.col("place")).select(*names, "rank", "v")
    whole = F.when(F.col("v") >= GREATEST, F.lit(float("inf"))).when(F.col("v") <= -GREATEST, F.lit(float("-inf"))).otherwise(F.col("v"))
    return flat.unionByName(found).select(*by, "rank", whole.alias("v"))


def _same(left: DataFrame, right: DataFrame, names: list[str], more: list[str]) -> DataFrame:
    """Join by group, null groups included, and by further columns; the columns of both once."""
    a, b = left.alias("a"), right.alias("b")
    equal = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in (*names, *more)]
    return a.join(b, equal).select("a.*", *[F.col(f"b.`{c}`") for c in right.columns if c not in (*names, *more)])


def _inside(rows: DataFrame, ranges: DataFrame, names: list[str]) -> DataFrame:
    """Rows with the ranges (lo, hi) of their group that hold their value; the ranges of a group have no value in common."""
    return _same(rows, ranges, names, []).filter("v BETWEEN lo AND hi")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, *, few: int = FEW, parts: int = PARTS) -> DataFrame:
    """(by..., <name>...) with linearly interpolated quantiles, one row per group that has values; without groups always one row."""
    by = by or []
    sizes = written(df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("n")), "sizes")
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("at")) for n, q in shares.items()]))
    spots = sizes.filter("n > 0").select(*by, at.alias("q")).select(*by, "q.name", "q.at")
    ends = spots.select(*by, "name", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("spot")).withColumn("rank", (F.col("spot") + 1).cast("bigint"))
    found = ranked_values(df, value, ends.select(*by, "rank"), by, few=few, parts=parts)
    ends = _same(ends, found, by, ["rank"])
    weight = F.when(F.floor("at") == F.ceil("at"), F.lit(0.5)).otherwise(1 - F.abs(F.col("at") - F.col("spot")))
    # both ends are the same row where the place is whole
    value_ = F.sum(F.col("v") * weight)
    each = ends.groupBy(*by, "name").agg(value_.alias("v"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares])


def with_quantiles(stats: DataFrame, df: DataFrame, value: str, shares: dict[str, float], by: list[str], **options) -> DataFrame:
    """``stats`` (one row per group) with quantile columns; null for groups without values."""
    found = quantiles(df, value, shares, by, **options).alias("b")
    equal = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in by] or [F.lit(True)]
    return stats.alias("a").join(found, equal, "left").select("a.*", *[F.col(f"b.{n}") for n in shares])


