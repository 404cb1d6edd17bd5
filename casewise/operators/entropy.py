"""How much a longer history tells about the next activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.operators.positions import case_lookback, positioned


def conditional_next(log: DataFrame, max_len: int) -> DataFrame:
    """Counts and shares of the next activity by (last activity, length).

    Length ``l`` counts the events that have at least ``l`` earlier events.  An event takes part in lengths
    ``2 .. min(pos, max_len)``; since only the last activity matters, events are first counted per capped position and
    the lengths are expanded on that small table.
    """
    rows = case_lookback(positioned(log), "activity", 1, "_prev").filter(F.col("pos") >= 2)
    capped = rows.groupBy(
        F.col("_prev")[0].alias("last_activity"),
        F.col("activity").alias("next_activity"),
        F.least(F.col("pos"), F.lit(max_len)).cast("int").alias("_cap"),
    ).agg(F.count(F.lit(1)).alias("n"))
    counts = (
        capped.withColumn("len", F.explode(F.sequence(F.lit(2), F.col("_cap"))))
        .groupBy("last_activity", "len", "next_activity")
        .agg(F.sum("n").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("last_activity", "len"))
    return counts.withColumn("share", F.col("n") / total)


def prefix_next(log: DataFrame, max_len: int | None = None, min_len: int = 1) -> DataFrame:
    """Counts and shares of the next activity by the actual last ``min_len..max_len`` activities.

    Without ``max_len`` prefixes of all lengths come out, which is quadratic in the length of a case.
    """
    if max_len is None:
        longest = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        max_len = max((longest or 0) - 1, min_len)
    rows = case_lookback(positioned(log), "activity", max_len, "_h").filter(F.col("pos") >= min_len)
    # count whole windows first, then expand their suffixes on the much smaller table
    windows = rows.groupBy("_h", "activity").agg(F.count(F.lit(1)).alias("n"))
    expanded = windows.withColumn("len", F.explode(F.sequence(F.lit(min_len), F.size("_h")))).select(
        F.slice("_h", F.size("_h") - F.col("len") + 1, F.col("len")).alias("prefix"),
        "len",
        F.col("activity").alias("next_activity"),
        "n",
    )
    counts = expanded.groupBy("prefix", "len", "next_activity").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("prefix", "len"))
    return counts.withColumn("share", F.col("n") / total)


def entropy(share: Column) -> Column:
    """``max(0, -sum p log2 p)`` as an aggregate."""
    return F.greatest(F.lit(0.0), -F.sum(share * F.log2(share)))


def conditional_entropy(next_counts: DataFrame, keys: list[str]) -> DataFrame:
    """Entropy and total count per key of :func:`conditional_next` or :func:`prefix_next`."""
    return next_counts.groupBy(*keys).agg(entropy(F.col("share")).alias("entropy"), F.sum("n").alias("total"))


def mean_entropy_by_length(prefix_entropy: DataFrame) -> DataFrame:
    """Count-weighted mean entropy by (last activity, length) with its weight."""
    return prefix_entropy.groupBy(F.element_at("prefix", -1).alias("last_activity"), "len").agg(
        (F.sum(F.col("entropy") * F.col("total")) / F.sum("total")).alias("mean_entropy"), F.sum("total").alias("weight")
    )


def weighted_mean_curve(by_activity: DataFrame, value: str = "mean_entropy", weight: str = "weight") -> DataFrame:
    """Weighted mean over activities per length."""
    return by_activity.groupBy("len").agg(
        (F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.sum(weight).alias("weight")
    )


def _grid(entropies: DataFrame, max_len: int) -> DataFrame:
    """Every (activity, length 2..max_len) with absent ones as zero: activities × lengths, both small."""
    activities = entropies.select("last_activity").distinct()
    cells = activities.withColumn("len", F.explode(F.sequence(F.lit(2), F.lit(max_len))))
    return cells.join(entropies, ["last_activity", "len"], "left").fillna(0, ["entropy", "total"])


def entropy_difference(entropies: DataFrame, max_len: int) -> DataFrame:
    """``H(l+1) - H(l)`` per activity for ``l`` in ``2..max_len-1``."""
    along = Window.partitionBy("last_activity").orderBy("len")
    return (
        _grid(entropies, max_len)
        .withColumn("difference", F.lead("entropy").over(along) - F.col("entropy"))
        .filter(F.col("len") < max_len)
        .select("last_activity", "len", "difference")
    )


def weighted_entropy_difference(entropies: DataFrame, max_len: int, normalize: str = "per_bin") -> DataFrame:
    """Difference of weighted entropies: by share of the two totals, or times log2 of the total."""
    if normalize not in ("per_bin", "max_entropy"):
        raise ValueError("normalize must be 'per_bin' or 'max_entropy'")
    along = Window.partitionBy("last_activity").orderBy("len")
    rows = (
        _grid(entropies, max_len)
        .withColumn("h1", F.lead("entropy").over(along))
        .withColumn("t1", F.lead("total").over(along))
        .filter(F.col("len") < max_len)
    )
    h0, h1, t0, t1 = F.col("entropy"), F.col("h1"), F.col("total"), F.col("t1")
    if normalize == "per_bin":
        both = t0 + t1
        low = F.when(t0 > 0, h0 * t0 / both).otherwise(0.0)
        high = F.when(t1 > 0, h1 * t1 / both).otherwise(0.0)
    else:
        low = F.when(t0 > 1, h0 * F.log2(t0)).otherwise(0.0)
        high = F.when(t1 > 1, h1 * F.log2(t1)).otherwise(0.0)
    return rows.select("last_activity", "len", (high - low).alias("difference"))


def total_entropy_difference(weighted: DataFrame, max_len: int) -> DataFrame:
    """Per length ``3..max_len``: sum over activities of the change of the weighted difference; and the plain sum.

    The input exists for lengths ``2..max_len-1``; a missing one counts as zero.
    """
    sums = weighted.groupBy("len").agg(F.sum("difference").alias("outline"))
    lengths = weighted.sparkSession.range(2, max_len + 1).select(F.col("id").cast("int").alias("len"))
    grid = lengths.join(sums, "len", "left").fillna(0.0, ["outline"])
    order = Window.partitionBy(F.lit(0)).orderBy("len")
    return (
        grid.withColumn("total_difference", F.col("outline") - F.lag("outline").over(order))
        .filter(F.col("len") >= 3)
        .select("len", "outline", "total_difference")
    )


def select_best_ngrams(totals: DataFrame, k: int) -> DataFrame:
    """The first ``k`` lengths that set a new negative low, filled up by the largest drops (first length excluded)."""
    order = Window.partitionBy(F.lit(0)).orderBy("len")
    lowest = F.min(F.when(F.col("total_difference") < 0, F.col("total_difference"))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = totals.withColumn("_low", lowest).withColumn(
        "_record",
        (F.col("total_difference") < 0) & (F.col("_low").isNull() | (F.col("total_difference") < F.col("_low"))),
    )
    rows = rows.withColumn("_drop", F.col("total_difference") - F.lag("total_difference").over(order))
    rows = rows.withColumn("_first", F.row_number().over(order) == 1)
    ranked = rows.filter(F.col("_record") | ~F.col("_first")).withColumn(
        "_rank",
        F.row_number().over(
            Window.partitionBy(F.lit(0)).orderBy(
                F.when(F.col("_record"), 0).otherwise(1),
                F.when(F.col("_record"), F.col("len")),
                F.round("_drop", 12),
                "len",
            )
        ),
    )
    return ranked.filter(F.col("_rank") <= k).select(F.col("_rank").alias("place"), "len")
