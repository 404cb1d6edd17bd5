"""Descriptive statistics of an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.quantiles import with_quantiles
from casewise.functions.scratch import written
from casewise.functions.values import hash_uniform, seconds_between
from casewise.operators.positions import case_lookback, case_order, case_parts, positioned, split_of


def log_statistics(log: DataFrame) -> DataFrame:
    """One row: cases, events, mean and longest case, alphabet size."""
    sizes = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("cases"), F.sum("n").alias("events"), F.avg("n").alias("mean_len"), F.max("n").alias("max_len")
    )
    alphabet = log.select("activity").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return sizes.withColumn("activities", alphabet)


def activity_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, quartiles (linear) and max, one row per column (and ``by`` key).

    Quartiles are exact and selected in rounds (:mod:`casewise.functions.quantiles`), so no task holds all values of a group.
    """
    pairs = [x for v in values for x in (F.lit(v), F.col(v).cast("double"))]
    tall = df.select(*(by or []), F.explode(F.create_map(*pairs)).alias("column", "v"))
    keys = [*(by or []), "column"]
    tall = written(tall, "described")
    stats = tall.groupBy(*keys).agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    return with_quantiles(stats, tall, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys).select(
        *keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def case_sizes(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("num_events"))


def case_durations(log: DataFrame) -> DataFrame:
    return log.groupBy("case_id").agg(seconds_between(F.max("ts"), F.min("ts")).alias("duration_s"))


def case_activity_counts(log: DataFrame) -> DataFrame:
    """Long form (case, activity, n) without zeros."""
    return log.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("n"))


def case_activity_matrix(log: DataFrame) -> DataFrame:
    """Cases × all activities, zero-filled; :func:`case_activity_counts` is the long form for large alphabets.

    The columns come from the log itself; Spark refuses more than ``spark.sql.pivotMaxValues`` of them.
    """
    return log.groupBy("case_id").pivot("activity").agg(F.count(F.lit(1))).na.fill(0)


def case_activity_describe(log: DataFrame) -> DataFrame:
    """:func:`describe` of the zero-filled matrix, one row per activity, without building the matrix."""
    return zero_filled_describe(case_activity_counts(log), log)


def max_repeats_describe(log: DataFrame) -> DataFrame:
    """:func:`describe` of the longest run of each activity over all cases, zero where it does not occur."""
    return zero_filled_describe(max_repeats(log).withColumnRenamed("max_run", "n"), log)


def zero_filled_describe(counts: DataFrame, log: DataFrame) -> DataFrame:
    """Describe ``n`` of (case_id, activity, n) by activity over all cases of ``log``.

    Zeros are put back as a count: cases without the activity.
    """
    cases = log.select("case_id").distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    per_value = counts.groupBy("activity", "n").agg(F.count(F.lit(1)).alias("freq"))
    zero = (
        counts.groupBy("activity")
        .agg(F.count(F.lit(1)).alias("present"))
        .select("activity", F.lit(0).cast("bigint").alias("n"), (cases - F.col("present")).alias("freq"))
        .filter(F.col("freq") > 0)
    )
    values = per_value.unionByName(zero)
    return weighted_describe(values, "activity", F.col("n").cast("double"), F.col("freq"))


def weighted_describe(df: DataFrame, key: str, value: Column, freq: Column) -> DataFrame:
    rows = df.select(F.col(key), value.alias("v"), freq.alias("f"))
    mean = F.sum(F.col("v") * F.col("f")) / F.sum("f")
    with_mean = rows.join(rows.groupBy(key).agg(mean.alias("m")), key)
    return with_mean.groupBy(key).agg(
        F.sum("f").alias("count"),
        F.max("m").alias("mean"),
        F.sqrt(F.try_divide(F.sum(F.col("f") * F.pow(F.col("v") - F.col("m"), 2)), F.sum("f") - 1)).alias("std"),
        F.min("v").alias("min"),
        F.percentile("v", F.lit(0.25), F.col("f")).alias("q25"),
        F.percentile("v", F.lit(0.5), F.col("f")).alias("q50"),
        F.percentile("v", F.lit(0.75), F.col("f")).alias("q75"),
        F.max("v").alias("max"),
    )


def repeat_runs(log: DataFrame) -> DataFrame:
    """Runs of equal consecutive activities: case, activity, length of the run."""
    plog = positioned(log)
    rows = case_lookback(plog, "activity", 1, "_prev")
    opens = F.when(F.size("_prev") == 0, F.lit(True)).otherwise(F.col("_prev")[0] != F.col("activity"))
    # the run is named by the position that opened it: the latest opening position so far
    parts = case_parts(rows)
    upto = Window.partitionBy(*parts).orderBy(*case_order(rows))
    named = rows.withColumn("_open", F.when(opens, F.col("pos"))).withColumn(
        "_run", F.last("_open", ignorenulls=True).over(upto)
    )
    if split_of(named):
        pieces = named.filter(F.col("split").isNotNull()).groupBy(*parts).agg(F.max("_open").alias("_o"))
        earlier = Window.partitionBy("case_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        carry = pieces.select(*parts, F.max("_o").over(earlier).alias("_c"))
        named = named.join(carry, parts, "left").withColumn("_run", F.coalesce("_run", "_c"))
    return named.groupBy("case_id", "activity", "_run").agg(F.count(F.lit(1)).alias("run_len")).drop("_run")


def max_repeats(log: DataFrame) -> DataFrame:
    """Longest run of each activity inside each case."""
    return repeat_runs(log).groupBy("case_id", "activity").agg(F.max("run_len").alias("max_run"))


def case_summary(log: DataFrame) -> DataFrame:
    """Per case: events, seconds from first to last event, longest run of any activity."""
    runs = repeat_runs(log).groupBy("case_id").agg(F.max("run_len").alias("max_run"))
    sizes = log.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("num_events"), seconds_between(F.max("ts"), F.min("ts")).alias("duration_s")
    )
    return sizes.join(runs, "case_id")


def first_activity_counts(log: DataFrame) -> DataFrame:
    firsts = log.groupBy("case_id").agg(F.min_by("activity", "seq").alias("activity"))
    return firsts.groupBy("activity").agg(F.count(F.lit(1)).alias("n"))


def case_length_histogram(log: DataFrame) -> DataFrame:
    return case_sizes(log).groupBy(F.col("num_events").alias("case_len")).agg(F.count(F.lit(1)).alias("cases"))


def histogram_bins(lengths: DataFrame, bins: int = 100) -> DataFrame:
    """Equal-width bins of a (case_len, cases) histogram; the last bin is closed."""
    edges = lengths.agg(F.struct(F.min("case_len").alias("lo"), F.max("case_len").alias("hi")).alias("e")).scalar()
    width = F.greatest((F.col("hi") - F.col("lo")) / F.lit(float(bins)), F.lit(1e-12))
    return (
        lengths.withColumn("_e", edges)
        .withColumns({"lo": F.col("_e.lo"), "hi": F.col("_e.hi")})
        .withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("case_len") - F.col("lo")) / width)))
        .groupBy("bin")
        .agg(F.sum("cases").alias("cases"))
    )


def directly_follows(log: DataFrame) -> DataFrame:
    """Counts of (activity, next activity)."""
    rows = case_lookback(positioned(log), "activity", 1, "_prev").filter(F.size("_prev") == 1)
    return rows.groupBy(F.col("_prev")[0].alias("activity"), F.col("activity").alias("next_activity")).agg(
        F.count(F.lit(1)).alias("n")
    )


def directly_follows_shares(log: DataFrame) -> DataFrame:
    counts = directly_follows(log)
    total = F.sum("n").over(Window.partitionBy("activity"))
    return counts.withColumn("share", F.col("n") / total).withColumn("log_n", F.log1p("n"))


# --------------------------------------------------------------------------------------------------------------
# contiguous subsequences
# --------------------------------------------------------------------------------------------------------------


def subsequences(log: DataFrame, max_len: int | None = None, min_len: int = 2) -> DataFrame:
    """One row per contiguous run of ``min_len..max_len`` activities, named by its last event.

    Without ``max_len`` runs of all lengths come out, which is quadratic in the length of a case.
    """
    if max_len is None:
        longest = log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        max_len = max(longest or 0, min_len)
    rows = case_lookback(positioned(log), "activity", max_len - 1, "_h", inclusive=True)
    lengths = F.when(
        F.size("_h") >= min_len, F.sequence(F.lit(min_len), F.greatest(F.size("_h"), F.lit(min_len)))
    )
    return rows.withColumn("len", F.explode(lengths)).select(
        "case_id", F.slice("_h", F.size("_h") - F.col("len") + 1, F.col("len")).alias("subsequence"), "len"
    )


def subsequence_counts(log: DataFrame, max_len: int | None = None) -> DataFrame:
    return subsequences(log, max_len).groupBy("subsequence", "len").agg(F.count(F.lit(1)).alias("frequency"))


def distinct_subsequences_by_length(log: DataFrame, max_len: int | None = None) -> DataFrame:
    return subsequence_counts(log, max_len).groupBy("len").agg(F.count(F.lit(1)).alias("n"))


def suffix_frequencies(log: DataFrame, max_len: int | None = None) -> DataFrame:
    """For each distinct subsequence and suffix length >= 2: frequency of the suffix over the distinct ones of its length.

    The length and frequency tables are small next to the log; the join keys are arrays of at most ``max_len``.
    """
    counts = subsequence_counts(log, max_len)
    distinct = counts.groupBy(F.col("len").alias("suffix_len")).agg(F.count(F.lit(1)).alias("distinct_n"))
    suffixes = counts.withColumn("suffix_len", F.explode(F.sequence(F.lit(2), F.col("len")))).withColumn(
        "suffix", F.slice("subsequence", F.col("len") - F.col("suffix_len") + 1, F.col("suffix_len"))
    )
    freq = counts.select(F.col("subsequence").alias("suffix"), F.col("frequency").alias("suffix_frequency"))
    return (
        suffixes.join(freq, "suffix")
        .join(distinct, "suffix_len")
        .select(
            "subsequence",
            "len",
            "frequency",
            "suffix_len",
            "suffix_frequency",
            (F.col("suffix_frequency") / F.col("distinct_n")).alias("suffix_share"),
        )
    )


def suffix_distribution(log: DataFrame, max_len: int | None = None) -> DataFrame:
    """Spread of the suffix shares by subsequence length and suffix length."""
    return share_spread(suffix_frequencies(log, max_len))


def share_spread(rows: DataFrame) -> DataFrame:
    """Mean, spread and quartiles of ``suffix_share`` by ``len`` and ``suffix_len``."""
    v, keys = "suffix_share", ["len", "suffix_len"]
    rows = written(rows.select(*keys, v), "suffix-shares")
    stats = rows.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sqrt(F.avg(v)).alias("sqrt_mean")
    )
    return with_quantiles(stats, rows, v, {"median": 0.5, "p25": 0.25, "p75": 0.75}, keys).select(
        *keys, "mean", "std", "min", "max", "median", "p25", "p75", "sqrt_mean"
    )


# --------------------------------------------------------------------------------------------------------------
# baselines and distances
# --------------------------------------------------------------------------------------------------------------


def random_baseline(log: DataFrame, seed: int | str = 0) -> DataFrame:
    """The same cases and positions, activities redrawn by overall frequency.

    Every event turns a hash-uniform number into a row of the cumulative frequency table.  That table has one entry
    per activity and travels as one array.
    """
    counts = activity_counts(log)
    upto = Window.partitionBy(F.lit(0)).orderBy("activity")
    table = (
        counts.withColumn("hi", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(F.lit(0))))
        .agg(F.sort_array(F.collect_list(F.struct("hi", "activity"))).alias("cdf"))
        .scalar()
    )
    draw = hash_uniform(F.concat_ws("#", "case_id", "pos"), seed)
    rows = positioned(log).withColumn("_u", draw).withColumn("_cdf", table)
    hit = F.filter("_cdf", lambda x: x["hi"] > F.col("_u"))
    drawn = F.when(F.size(hit) > 0, hit[0]["activity"]).otherwise(F.element_at(F.col("_cdf"), -1)["activity"])
    return rows.withColumn("activity", drawn).drop("_u", "_cdf")


def wasserstein_1d(a: DataFrame, b: DataFrame, value: str, weight: str) -> DataFrame:
    """Distance between two weighted one-dimensional samples given as (value, weight) histograms."""
    both = (
        a.select(F.col(value).alias("x"), F.col(weight).alias("wa"), F.lit(0).cast("bigint").alias("wb"))
        .unionByName(b.select(F.col(value).alias("x"), F.lit(0).cast("bigint").alias("wa"), F.col(weight).alias("wb")))
        .groupBy("x")
        .agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    )
    total = Window.partitionBy(F.lit(0))
    order = total.orderBy("x")
    cdf = both.select(
        "x",
        (F.sum("wa").over(order) / F.sum("wa").over(total)).alias("fa"),
        (F.sum("wb").over(order) / F.sum("wb").over(total)).alias("fb"),
        F.lead("x").over(order).alias("nx"),
    )
    return cdf.agg(
        F.coalesce(F.sum(F.abs(F.col("fa") - F.col("fb")) * (F.col("nx") - F.col("x"))), F.lit(0.0)).alias("distance")
    )
