"""Queries on descriptive statistics and entropies."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.functions.values import joined
from casewise.operators import describe, entropy, runs
from casewise.plans.preparation import DRAW
from casewise.plans.registry import CONVERSATIONS, EVENTS, ORDERS, POSITIONS, describe_sql, query, rounded, with_

STATS = ["mean", "std", "q25", "q50", "q75"]

SIZES = "sizes AS (SELECT case_id, count(*) AS num_events, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM log GROUP BY case_id)"


@query(
    "log_statistics",
    with_(
        EVENTS,
        SIZES,
        "SELECT count(*) AS cases, CAST(sum(num_events) AS BIGINT) AS events, round(avg(num_events), 6) AS mean_len, "
        "max(num_events) AS max_len, (SELECT count(DISTINCT activity) FROM log) AS activities FROM sizes",
    ),
)
def log_statistics(src):
    return rounded(describe.log_statistics(src.events()), "mean_len")


@query("activity_counts", with_(EVENTS, "SELECT activity, count(*) AS n FROM log GROUP BY activity"))
def activity_counts(src):
    return describe.activity_counts(src.events())


@query("case_size_describe", with_(ORDERS, SIZES, describe_sql("sizes", ["num_events"])))
def case_size_describe(src):
    return rounded(describe.describe(describe.case_sizes(src.orders()), ["num_events"]), *STATS)


@query(
    "case_duration_describe",
    with_(
        EVENTS,
        SIZES,
        "d AS (SELECT us / 1000000.0 AS duration_s FROM sizes)",
        describe_sql("d", ["duration_s"]),
    ),
)
def case_duration_describe(src):
    return rounded(describe.describe(describe.case_durations(src.events()), ["duration_s"]), *STATS)


# The activities of the events table, which are the columns of the matrix.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "case_activity_matrix",
    with_(EVENTS, "SELECT case_id, " + ", ".join(f"count(*) FILTER (activity = '{a}') AS {a}" for a in EVENT_TYPES) + " FROM log GROUP BY case_id"),
)
def case_activity_matrix(src):
    return describe.case_activity_matrix(src.events())


@query(
    "case_activity_counts",
    with_(
        ORDERS,
        "SELECT c.case_id, a.activity, count(l.seq) AS n FROM (SELECT DISTINCT case_id FROM log) c CROSS JOIN (SELECT DISTINCT activity FROM log) a "
        "LEFT JOIN log l ON l.case_id = c.case_id AND l.activity = a.activity GROUP BY ALL HAVING count(l.seq) > 0",
    ),
)
def case_activity_counts(src):
    """How often each activity occurs in each case, in long form."""
    return describe.case_activity_counts(src.orders())


@query(
    "case_activity_describe",
    with_(
        ORDERS,
        "grid AS (SELECT c.case_id, a.activity, count(l.seq) AS n FROM (SELECT DISTINCT case_id FROM log) c "
        "CROSS JOIN (SELECT DISTINCT activity FROM log) a LEFT JOIN log l ON l.case_id = c.case_id "
        "AND l.activity = a.activity GROUP BY ALL)",
        "SELECT activity, count(*) AS \"count\", round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, "
        "CAST(min(n) AS DOUBLE) AS min, round(quantile_cont(CAST(n AS DOUBLE), 0.25), 6) AS q25, "
        "round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST(n AS DOUBLE), 0.75), 6) AS q75, "
        "CAST(max(n) AS DOUBLE) AS max FROM grid GROUP BY activity",
    ),
)
def case_activity_describe(src):
    return rounded(describe.case_activity_describe(src.orders()), *STATS)


RUNS = (
    "runs AS (SELECT case_id, activity, count(*) AS run_len FROM (SELECT *, "
    "pos - row_number() OVER (PARTITION BY case_id, activity ORDER BY pos) AS g FROM ev) GROUP BY case_id, activity, g)"
)


@query(
    "max_repeats",
    with_(EVENTS, POSITIONS, RUNS, "SELECT case_id, activity, max(run_len) AS max_run FROM runs GROUP BY ALL"),
)
def max_repeats(src):
    return describe.max_repeats(src.events())


@query(
    "max_repeats_describe",
    with_(
        EVENTS, POSITIONS, RUNS,
        "grid AS (SELECT c.case_id, a.activity, coalesce(max(r.run_len), 0) AS n FROM (SELECT DISTINCT case_id FROM log) c "
        "CROSS JOIN (SELECT DISTINCT activity FROM log) a LEFT JOIN runs r ON r.case_id = c.case_id "
        "AND r.activity = a.activity GROUP BY ALL)",
        "SELECT activity, count(*) AS \"count\", round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, "
        "CAST(min(n) AS DOUBLE) AS min, round(quantile_cont(CAST(n AS DOUBLE), 0.25), 6) AS q25, "
        "round(quantile_cont(CAST(n AS DOUBLE), 0.5), 6) AS q50, round(quantile_cont(CAST(n AS DOUBLE), 0.75), 6) AS q75, "
        "CAST(max(n) AS DOUBLE) AS max FROM grid GROUP BY activity",
    ),
)
def max_repeats_describe(src):
    return rounded(describe.max_repeats_describe(src.events()), *STATS)


SUMMARY = (
    "summary AS (SELECT s.case_id, s.num_events, s.us / 1000000.0 AS duration_s, r.max_run FROM sizes s JOIN "
    "(SELECT case_id, max(run_len) AS max_run FROM runs GROUP BY case_id) r USING (case_id))"
)


@query(
    "case_summary",
    with_(
        EVENTS, POSITIONS, SIZES, RUNS, SUMMARY,
        "SELECT case_id, num_events, round(duration_s, 6) AS duration_s, max_run FROM summary",
    ),
)
def case_summary(src):
    return rounded(describe.case_summary(src.events()), "duration_s")


@query(
    "case_summary_describe",
    with_(EVENTS, POSITIONS, SIZES, RUNS, SUMMARY, describe_sql("summary", ["num_events", "duration_s", "max_run"])),
)
def case_summary_describe(src):
    rows = describe.case_summary(src.events())
    return rounded(describe.describe(rows, ["num_events", "duration_s", "max_run"]), *STATS)


@query(
    "first_activity_counts",
    with_(ORDERS, POSITIONS, "SELECT activity, count(*) AS n FROM ev WHERE pos = 0 GROUP BY activity"),
)
def first_activity_counts(src):
    return describe.first_activity_counts(src.orders())


HIST = "hist AS (SELECT num_events AS case_len, count(*) AS cases FROM sizes GROUP BY num_events)"


@query("case_length_hist", with_(ORDERS, SIZES, HIST, "SELECT case_len, cases FROM hist"))
def case_length_hist(src):
    return describe.case_length_histogram(src.orders())


@query(
    "case_length_bins",
    with_(
        EVENTS,
        SIZES,
        HIST,
        "b AS (SELECT min(case_len) AS lo, (max(case_len) - min(case_len)) / 10.0 AS w FROM hist)",
        "SELECT CAST(least(9, floor((case_len - lo) / w)) AS BIGINT) AS bin, CAST(sum(cases) AS BIGINT) AS cases "
        "FROM hist, b GROUP BY 1",
    ),
)
def case_length_bins(src):
    return describe.histogram_bins(describe.case_length_histogram(src.events()), 10)


FOLLOWS = (
    "follows AS (SELECT activity, nxt AS next_activity, count(*) AS n FROM (SELECT activity, "
    "lead(activity) OVER (PARTITION BY case_id ORDER BY seq) AS nxt FROM log) WHERE nxt IS NOT NULL GROUP BY ALL)"
)


@query("directly_follows", with_(EVENTS, FOLLOWS, "SELECT activity, next_activity, n FROM follows"))
def directly_follows(src):
    return describe.directly_follows(src.events())


@query(
    "directly_follows_prob",
    with_(
        EVENTS,
        FOLLOWS,
        "SELECT activity, next_activity, n, round(n / sum(n) OVER (PARTITION BY activity), 6) AS share, "
        "round(ln(1 + n), 6) AS log_n FROM follows",
    ),
)
def directly_follows_prob(src):
    return rounded(describe.directly_follows_shares(src.events()), "share", "log_n")


def subs_sql(base, max_len):
    """All contiguous runs of 2..max_len activities as '|' text."""
    return [
        base,
        POSITIONS,
        "subs AS ("
        + " UNION ALL ".join(
            f"SELECT case_id, {n} AS len, s AS subsequence FROM (SELECT case_id, pos, string_agg(activity, '|') OVER "
            f"(PARTITION BY case_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s FROM ev) "
            f"WHERE pos >= {n - 1}"
            for n in range(2, max_len + 1)
        )
        + ")",
        "counts AS (SELECT subsequence, len, count(*) AS frequency FROM subs GROUP BY ALL)",
    ]


@query("subsequence_counts", with_(*subs_sql(EVENTS, 4), "SELECT subsequence, len, frequency FROM counts"))
def subsequence_counts(src):
    rows = describe.subsequence_counts(src.events(), 4)
    return rows.withColumn("subsequence", joined(F.col("subsequence")))


@query(
    "distinct_subsequences_by_length",
    with_(*subs_sql(ORDERS, 6), "SELECT len, count(*) AS n FROM counts GROUP BY len"),
)
def distinct_subsequences_by_length(src):
    return describe.distinct_subsequences_by_length(src.orders(), 6)


#: all runs of all lengths, by joining every pair of places of a case
ALL_RUNS = [
    CONVERSATIONS,
    POSITIONS,
    "subs AS (SELECT a.case_id, b.pos - a.pos + 1 AS len, (SELECT string_agg(m.activity, '|' ORDER BY m.pos) FROM ev m "
    "WHERE m.case_id = a.case_id AND m.pos BETWEEN a.pos AND b.pos) AS subsequence FROM ev a JOIN ev b "
    "ON a.case_id = b.case_id AND b.pos > a.pos)",
    "counts AS (SELECT subsequence, CAST(len AS INTEGER) AS len, count(*) AS frequency FROM subs GROUP BY ALL)",
]


@query("subsequence_counts_all", with_(*ALL_RUNS, "SELECT subsequence, len, frequency FROM counts"))
def subsequence_counts_all(src):
    """Runs of every length in the conversations."""
    rows = describe.subsequence_counts(src.conversations())
    return rows.withColumn("subsequence", joined(F.col("subsequence")))


@query("distinct_subsequences_by_length_all", with_(*ALL_RUNS, "SELECT len, count(*) AS n FROM counts GROUP BY len"))
def distinct_subsequences_by_length_all(src):
    """Distinct runs of every length in the conversations."""
    return describe.distinct_subsequences_by_length(src.conversations())


SUFFIXES = (
    "suffixes AS (SELECT c.subsequence, c.len, c.frequency, s.len AS suffix_len, s.frequency AS suffix_frequency, "
    "s.frequency / (SELECT count(*) FROM counts k WHERE k.len = s.len) AS suffix_share "
    "FROM counts c JOIN counts s ON s.len <= c.len AND (c.subsequence = s.subsequence OR c.subsequence LIKE '%|' || s.subsequence))"
)


@query(
    "suffix_frequencies",
    with_(
        *subs_sql(ORDERS, 4),
        SUFFIXES,
        "SELECT subsequence, len, frequency, suffix_len, suffix_frequency, round(suffix_share, 6) AS suffix_share FROM suffixes",
    ),
)
def suffix_frequencies(src):
    rows = describe.suffix_frequencies(src.orders(), 4)
    return rounded(rows.withColumn("subsequence", joined(F.col("subsequence"))), "suffix_share")


@query(
    "suffix_distribution",
    with_(
        *subs_sql(ORDERS, 4),
        SUFFIXES,
        "SELECT len, suffix_len, round(avg(suffix_share), 6) AS mean, round(stddev_pop(suffix_share), 6) AS std, "
        "round(min(suffix_share), 6) AS min, round(max(suffix_share), 6) AS max, "
        "round(quantile_cont(suffix_share, 0.5), 6) AS median, round(quantile_cont(suffix_share, 0.25), 6) AS p25, "
        "round(quantile_cont(suffix_share, 0.75), 6) AS p75, round(sqrt(avg(suffix_share)), 6) AS sqrt_mean "
        "FROM suffixes GROUP BY ALL",
    ),
)
def suffix_distribution(src):
    rows = describe.suffix_distribution(src.orders(), 4)
    return rounded(rows, "mean", "std", "min", "max", "median", "p25", "p75", "sqrt_mean")


ALL_SUFFIXES = (
    "suffixes AS (SELECT c.subsequence, c.len, c.frequency, s.len AS suffix_len, s.frequency AS suffix_frequency, "
    "s.frequency / k.n AS suffix_share FROM (SELECT *, unnest(range(2, len + 1)) AS suffix_len, string_split(subsequence, '|') AS parts FROM counts) c "
    "JOIN counts s ON s.subsequence = array_to_string(c.parts[c.len - c.suffix_len + 1:], '|') "
    "JOIN (SELECT len, count(*) AS n FROM counts GROUP BY len) k ON k.len = s.len)"
)


@query(
    "suffix_frequencies_all",
    with_(
        *ALL_RUNS,
        ALL_SUFFIXES,
        "SELECT subsequence, len, frequency, suffix_len, suffix_frequency, round(suffix_share, 6) AS suffix_share FROM suffixes",
    ),
)
def suffix_frequencies_all(src):
    """Suffixes of every length of the runs in the conversations."""
    rows = describe.suffix_frequencies(src.conversations())
    return rounded(rows.withColumn("subsequence", joined(F.col("subsequence"))), "suffix_share")


@query(
    "suffix_distribution_all",
    with_(
        *ALL_RUNS,
        ALL_SUFFIXES,
        "SELECT len, suffix_len, round(avg(suffix_share), 6) AS mean, round(stddev_pop(suffix_share), 6) AS std, "
        "round(min(suffix_share), 6) AS min, round(max(suffix_share), 6) AS max, "
        "round(quantile_cont(suffix_share, 0.5), 6) AS median, round(quantile_cont(suffix_share, 0.25), 6) AS p25, "
        "round(quantile_cont(suffix_share, 0.75), 6) AS p75, round(sqrt(avg(suffix_share)), 6) AS sqrt_mean "
        "FROM suffixes GROUP BY ALL",
    ),
)
def suffix_distribution_all(src):
    """Spread of the suffix shares in the conversations, all lengths."""
    rows = describe.suffix_distribution(src.conversations())
    return rounded(rows, "mean", "std", "min", "max", "median", "p25", "p75", "sqrt_mean")


def named_sql(log: str, longest: str = "") -> list[str]:
    """Runs of all lengths from two activities on, with their last position, as text."""
    return [
        log, POSITIONS,
        "runs AS (SELECT a.case_id, b.pos, b.pos - a.pos + 1 AS len, array_to_string(list_slice(t.acts, a.pos + 1, b.pos + 1), '|') AS run FROM ev a "
        "JOIN ev b ON a.case_id = b.case_id AND b.pos > a.pos JOIN (SELECT case_id, list(activity ORDER BY pos) AS acts FROM ev GROUP BY case_id) t "
        f"ON t.case_id = a.case_id{longest})",
        "counts AS (SELECT run, len, count(*) AS frequency FROM runs GROUP BY run, len)",
    ]


@query(
    "distinct_runs_by_length",
    with_(*named_sql(EVENTS), "SELECT len, CAST(sum(frequency) AS BIGINT) AS runs, count(*) AS \"distinct\", max(frequency) AS most FROM counts GROUP BY len"),
)
def distinct_runs_by_length(src):
    """Runs of every length in the events, under names of fixed size."""
    return runs.distinct_runs_by_length(src.events())


@query(
    "next_entropy_by_length",
    with_(
        EVENTS, POSITIONS,
        "acts AS (SELECT case_id, list(activity ORDER BY pos) AS acts FROM ev GROUP BY case_id)",
        "pn AS (SELECT b.pos - a.pos AS len, array_to_string(list_slice(t.acts, a.pos + 1, b.pos), '|') AS run, b.activity AS nxt, count(*) AS n FROM ev a "
        "JOIN ev b ON a.case_id = b.case_id AND b.pos > a.pos JOIN acts t ON t.case_id = a.case_id GROUP BY ALL)",
        "ps AS (SELECT *, sum(n) OVER (PARTITION BY len, run) AS total FROM pn)",
        "pe AS (SELECT len, run, any_value(total) AS total, greatest(0, -sum(n / total * log2(n / total))) AS h FROM ps GROUP BY len, run)",
        "SELECT len, count(*) AS prefixes, CAST(sum(total) AS BIGINT) AS total, round(sum(h * total) / sum(total), 6) AS mean_entropy FROM pe GROUP BY len",
    ),
)
def next_entropy_by_length(src):
    """Entropy of the next activity after prefixes of every length in the events, weighted by how often they occur."""
    counts = runs.next_counts(src.events(), spans=True)
    each = counts.groupBy("len", "upto", "name").agg(F.sum("n").alias("total"), entropy.entropy(F.col("share")).alias("h"))
    sums = {"prefixes": F.count(F.lit(1)), "total": F.sum("total"), "weighted": F.sum(F.col("h") * F.col("total"))}
    spans = each.groupBy("len", "upto").agg(*[c.alias(n) for n, c in sums.items()])
    lengths = spans.withColumn("len", F.explode(F.sequence("len", "upto")))
    rows = lengths.groupBy("len").agg(F.sum("prefixes").alias("prefixes"), F.sum("total").alias("total"), (F.sum("weighted") / F.sum("total")).alias("mean_entropy"))
    return rounded(rows, "mean_entropy")


@query(
    "suffix_spread",
    with_(
        *named_sql(ORDERS),
        "example AS (SELECT len, run, min((case_id, pos)) AS e FROM runs GROUP BY len, run)",
        "sizes AS (SELECT len, count(*) AS n FROM counts GROUP BY len)",
        "suffixes AS (SELECT x.len, r.len AS suffix_len, c.frequency / s.n AS suffix_share FROM example x JOIN runs r "
        "ON r.case_id = x.e[1] AND r.pos = x.e[2] AND r.len <= x.len JOIN counts c ON c.len = r.len AND c.run = r.run JOIN sizes s ON s.len = r.len)",
        "SELECT len, suffix_len, round(avg(suffix_share), 6) AS mean, round(stddev_pop(suffix_share), 6) AS std, round(min(suffix_share), 6) AS min, "
        "round(max(suffix_share), 6) AS max, round(quantile_cont(suffix_share, 0.5), 6) AS median, round(quantile_cont(suffix_share, 0.25), 6) AS p25, "
        "round(quantile_cont(suffix_share, 0.75), 6) AS p75, round(sqrt(avg(suffix_share)), 6) AS sqrt_mean FROM suffixes GROUP BY ALL",
    ),
)
def suffix_spread(src):
    """Spread of the suffix shares of runs of every length in the orders."""
    rows = runs.suffix_spread(src.orders())
    return rounded(rows, "mean", "std", "min", "max", "median", "p25", "p75", "sqrt_mean")


BASELINE = [
    POSITIONS,
    f"u AS (SELECT *, {DRAW.format(what='case_id || chr(35) || pos', seed=11)} AS u FROM ev)",
    "cdf AS (SELECT activity, sum(n) OVER (ORDER BY activity) / sum(n) OVER () AS hi, "
    "coalesce(sum(n) OVER (ORDER BY activity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(n) OVER () AS lo "
    "FROM (SELECT activity, count(*) AS n FROM log GROUP BY activity))",
]


@query(
    "random_baseline",
    with_(
        EVENTS, *BASELINE,
        "SELECT u.case_id, u.pos, cdf.activity FROM u JOIN cdf ON u.u >= cdf.lo AND u.u < cdf.hi",
    ),
)
def random_baseline(src):
    return describe.random_baseline(src.events(), 11).select("case_id", "pos", "activity")


@query(
    "wasserstein_lengths",
    with_(
        EVENTS,
        "lens AS (SELECT count(*) AS x, 'a' AS side FROM log GROUP BY case_id UNION ALL "
        "SELECT count(*) AS x, 'b' AS side FROM orders GROUP BY o_custkey)",
        "xs AS (SELECT x, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM lens GROUP BY x)",
        "f AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb, "
        "lead(x) OVER (ORDER BY x) AS nx FROM xs)",
        "SELECT round(sum(abs(fa - fb) * (nx - x)), 6) AS distance FROM f",
    ),
)
def wasserstein_lengths(src):
    a = describe.case_length_histogram(src.events())
    b = describe.case_length_histogram(src.orders())
    return rounded(describe.wasserstein_1d(a, b, "case_len", "cases"), "distance")


@query(
    "wasserstein_subsequences",
    with_(
        *subs_sql(EVENTS, 4),
        *BASELINE[1:],
        "rnd AS (SELECT u.case_id, u.pos, cdf.activity FROM u JOIN cdf ON u.u >= cdf.lo AND u.u < cdf.hi)",
        "rsubs AS ("
        + " UNION ".join(
            f"SELECT {n} AS len, s AS subsequence FROM (SELECT pos, string_agg(activity, '|') OVER (PARTITION BY case_id "
            f"ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s FROM rnd) WHERE pos >= {n - 1}"
            for n in (2, 3, 4)
        )
        + ")",
        "xs AS (SELECT len AS x, (SELECT count(*) FROM counts c WHERE c.len = l.len) AS a, "
        "(SELECT count(*) FROM rsubs c WHERE c.len = l.len) AS b FROM (SELECT unnest([2, 3, 4]) AS len) l)",
        "f AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb, "
        "lead(x) OVER (ORDER BY x) AS nx FROM xs)",
        "SELECT round(coalesce(sum(abs(fa - fb) * (nx - x)), 0), 6) AS distance FROM f",
    ),
)
def wasserstein_subsequences(src):
    """Lengths of distinct subsequences, real log against random baseline."""
    real = describe.distinct_subsequences_by_length(src.events(), 4)
    drawn = describe.random_baseline(src.events(), 11)
    rand = describe.distinct_subsequences_by_length(drawn, 4)
    return rounded(describe.wasserstein_1d(real, rand, "len", "n"), "distance")


@query(
    "wasserstein_subsequences_all",
    with_(
        *ALL_RUNS,
        *BASELINE[1:],
        "rnd AS (SELECT u.case_id, u.pos, cdf.activity FROM u JOIN cdf ON u.u >= cdf.lo AND u.u < cdf.hi)",
        "rsubs AS (SELECT DISTINCT b.pos - a.pos + 1 AS len, (SELECT string_agg(m.activity, '|' ORDER BY m.pos) FROM rnd m "
        "WHERE m.case_id = a.case_id AND m.pos BETWEEN a.pos AND b.pos) AS subsequence FROM rnd a JOIN rnd b "
        "ON a.case_id = b.case_id AND b.pos > a.pos)",
        "xs AS (SELECT len AS x, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM "
        "(SELECT len, 'a' AS side FROM counts UNION ALL SELECT len, 'b' AS side FROM rsubs) GROUP BY len)",
        "f AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb, "
        "lead(x) OVER (ORDER BY x) AS nx FROM xs)",
        "SELECT round(coalesce(sum(abs(fa - fb) * (nx - x)), 0), 6) AS distance FROM f",
    ),
)
def wasserstein_subsequences_all(src):
    """Lengths of distinct subsequences of all lengths, conversations against random baseline."""
    real = describe.distinct_subsequences_by_length(src.conversations())
    rand = describe.distinct_subsequences_by_length(describe.random_baseline(src.conversations(), 11))
    return rounded(describe.wasserstein_1d(real, rand, "len", "n"), "distance")


# --------------------------------------------------------------------------------------------------------------
# entropies
# --------------------------------------------------------------------------------------------------------------

MAX = 8


def next_sql(base):
    return [
        base,
        POSITIONS,
        "p AS (SELECT *, lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS last_activity FROM ev)",
        "nxt AS (SELECT last_activity, CAST(g.len AS INTEGER) AS len, activity AS next_activity, count(*) AS n "
        f"FROM p JOIN range(2, {MAX + 1}) g(len) ON p.pos >= g.len GROUP BY ALL)",
        "shares AS (SELECT *, n / sum(n) OVER (PARTITION BY last_activity, len) AS share FROM nxt)",
        "ent AS (SELECT last_activity, len, greatest(0, -sum(share * log2(share))) AS entropy, "
        "CAST(sum(n) AS BIGINT) AS total FROM shares GROUP BY ALL)",
    ]


@query(
    "conditional_next",
    with_(*next_sql(EVENTS), "SELECT last_activity, len, next_activity, n, round(share, 6) AS share FROM shares"),
)
def conditional_next(src):
    return rounded(entropy.conditional_next(src.events(), MAX), "share")


def prefix_next_sql(base, max_len, min_len):
    return [
        base,
        POSITIONS,
        "pn AS ("
        + " UNION ALL ".join(
            f"SELECT p AS prefix, {n} AS len, activity AS next_activity FROM (SELECT pos, activity, string_agg(activity, '|') "
            f"OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS p FROM ev) WHERE pos >= {n}"
            for n in range(min_len, max_len + 1)
        )
        + ")",
        "pc AS (SELECT prefix, len, next_activity, count(*) AS n FROM pn GROUP BY ALL)",
        "ps AS (SELECT *, n / sum(n) OVER (PARTITION BY prefix) AS share FROM pc)",
        "pe AS (SELECT prefix, len, greatest(0, -sum(share * log2(share))) AS entropy, CAST(sum(n) AS BIGINT) AS total "
        "FROM ps GROUP BY ALL)",
    ]


@query(
    "prefix_next",
    with_(*prefix_next_sql(EVENTS, 4, 1), "SELECT prefix, len, next_activity, n, round(share, 6) AS share FROM ps"),
)
def prefix_next(src):
    rows = entropy.prefix_next(src.events(), 4)
    return rounded(rows.withColumn("prefix", joined(F.col("prefix"))), "share")


#: prefixes of all lengths, by joining every pair of places of a case
ALL_PREFIXES = [
    CONVERSATIONS,
    POSITIONS,
    "pn AS (SELECT b.pos - a.pos AS len, b.activity AS next_activity, (SELECT string_agg(m.activity, '|' ORDER BY m.pos) FROM ev m "
    "WHERE m.case_id = a.case_id AND m.pos >= a.pos AND m.pos < b.pos) AS prefix FROM ev a JOIN ev b ON a.case_id = b.case_id AND b.pos > a.pos)",
    "pc AS (SELECT prefix, CAST(len AS INTEGER) AS len, next_activity, count(*) AS n FROM pn GROUP BY ALL)",
    "ps AS (SELECT *, n / sum(n) OVER (PARTITION BY prefix, len) AS share FROM pc)",
]


@query("prefix_next_all", with_(*ALL_PREFIXES, "SELECT prefix, len, next_activity, n, round(share, 6) AS share FROM ps"))
def prefix_next_all(src):
    """Next activities by prefixes of every length in the conversations."""
    rows = entropy.prefix_next(src.conversations())
    return rounded(rows.withColumn("prefix", joined(F.col("prefix"))), "share")


@query(
    "conditional_entropy",
    with_(*next_sql(EVENTS), "SELECT last_activity, len, round(entropy, 6) AS entropy, total FROM ent"),
)
def conditional_entropy(src):
    rows = entropy.conditional_next(src.events(), MAX)
    return rounded(entropy.conditional_entropy(rows, ["last_activity", "len"]), "entropy")


@query(
    "prefix_entropy",
    with_(*prefix_next_sql(EVENTS, 4, 2), "SELECT prefix, len, round(entropy, 6) AS entropy, total FROM pe"),
)
def prefix_entropy(src):
    rows = entropy.conditional_entropy(entropy.prefix_next(src.events(), 4, 2), ["prefix", "len"])
    return rounded(rows.withColumn("prefix", joined(F.col("prefix"))), "entropy")


MEANS = (
    "me AS (SELECT split_part(prefix, '|', -1) AS last_activity, len, sum(entropy * total) / sum(total) AS mean_entropy, "
    "CAST(sum(total) AS BIGINT) AS weight FROM pe GROUP BY ALL)"
)


def _means(log):
    prefixes = entropy.conditional_entropy(entropy.prefix_next(log, 4, 2), ["prefix", "len"])
    return entropy.mean_entropy_by_length(prefixes)


@query(
    "mean_entropy",
    with_(
        *prefix_next_sql(EVENTS, 4, 2), MEANS,
        "SELECT last_activity, len, round(mean_entropy, 6) AS mean_entropy, weight FROM me",
    ),
)
def mean_entropy(src):
    return rounded(_means(src.events()), "mean_entropy")


@query(
    "weighted_mean_entropy_curve",
    with_(
        *prefix_next_sql(EVENTS, 4, 2), MEANS,
        "SELECT len, round(sum(mean_entropy * weight) / sum(weight), 6) AS weighted_mean, CAST(sum(weight) AS BIGINT) AS weight "
        "FROM me GROUP BY len",
    ),
)
def weighted_mean_entropy_curve(src):
    return rounded(entropy.weighted_mean_curve(_means(src.events())), "weighted_mean")


GRID = (
    "grid AS (SELECT a.last_activity, CAST(g.len AS INTEGER) AS len, coalesce(e.entropy, 0) AS h, coalesce(e.total, 0) AS t "
    f"FROM (SELECT DISTINCT last_activity FROM ent) a CROSS JOIN range(2, {MAX + 1}) g(len) "
    "LEFT JOIN ent e ON e.last_activity = a.last_activity AND e.len = g.len)"
)
PAIRS = (
    "pairs AS (SELECT a.last_activity, a.len, a.h AS h0, a.t AS t0, b.h AS h1, b.t AS t1 FROM grid a JOIN grid b "
    "ON a.last_activity = b.last_activity AND b.len = a.len + 1)"
)
PER_BIN = (
    "wd AS (SELECT last_activity, len, CASE WHEN t1 > 0 THEN h1 * t1 / (t0 + t1) ELSE 0 END - "
    "CASE WHEN t0 > 0 THEN h0 * t0 / (t0 + t1) ELSE 0 END AS difference FROM pairs)"
)
LOG_WEIGHT = (
    "wd AS (SELECT last_activity, len, CASE WHEN t1 > 1 THEN h1 * log2(t1) ELSE 0 END - "
    "CASE WHEN t0 > 1 THEN h0 * log2(t0) ELSE 0 END AS difference FROM pairs)"
)
DIFFERENCE = "SELECT last_activity, len, round(difference, 6) AS difference FROM wd"
TOTALS = (
    "tot AS (SELECT CAST(g.len AS INTEGER) AS len, coalesce((SELECT sum(difference) FROM wd WHERE wd.len = g.len), 0) AS outline "
    f"FROM range(2, {MAX + 1}) g(len)), "
    "dif AS (SELECT len, outline, outline - lag(outline) OVER (ORDER BY len) AS total_difference FROM tot)"
)


def _entropies(src):
    return entropy.conditional_entropy(entropy.conditional_next(src.orders(), MAX), ["last_activity", "len"])


@query(
    "entropy_difference",
    with_(*next_sql(ORDERS), GRID, PAIRS, "SELECT last_activity, len, round(h1 - h0, 6) AS difference FROM pairs"),
)
def entropy_difference(src):
    return rounded(entropy.entropy_difference(_entropies(src), MAX), "difference")


@query("weighted_entropy_per_bin", with_(*next_sql(ORDERS), GRID, PAIRS, PER_BIN, DIFFERENCE))
def weighted_entropy_per_bin(src):
    return rounded(entropy.weighted_entropy_difference(_entropies(src), MAX), "difference")


@query("weighted_entropy_max", with_(*next_sql(ORDERS), GRID, PAIRS, LOG_WEIGHT, DIFFERENCE))
def weighted_entropy_max(src):
    return rounded(entropy.weighted_entropy_difference(_entropies(src), MAX, "max_entropy"), "difference")


def _totals(src):
    return entropy.total_entropy_difference(entropy.weighted_entropy_difference(_entropies(src), MAX), MAX)


@query(
    "total_entropy_difference",
    with_(
        *next_sql(ORDERS), GRID, PAIRS, PER_BIN, TOTALS,
        "SELECT len, round(outline, 6) AS outline, round(total_difference, 6) AS total_difference FROM dif WHERE len >= 3",
    ),
)
def total_entropy_difference(src):
    return rounded(_totals(src), "outline", "total_difference")


@query(
    "best_ngrams",
    with_(
        *next_sql(ORDERS), GRID, PAIRS, PER_BIN, TOTALS,
        "t AS (SELECT len, total_difference AS d FROM dif WHERE len >= 3)",
        "rec AS (SELECT t.len, t.d FROM t WHERE t.d < 0 AND NOT EXISTS (SELECT 1 FROM t p WHERE p.len < t.len AND p.d < 0 "
        "AND p.d <= t.d))",
        "rest AS (SELECT a.len, a.d - b.d AS fall FROM t a JOIN t b ON b.len = a.len - 1 WHERE a.len NOT IN (SELECT len FROM rec))",
        "u AS (SELECT len, 0 AS g, CAST(len AS DOUBLE) AS o FROM rec UNION ALL SELECT len, 1, round(fall, 12) FROM rest)",
        "SELECT place, len FROM (SELECT row_number() OVER (ORDER BY g, o, len) AS place, len FROM u) WHERE place <= 3",
    ),
)
def best_ngrams(src):
    return entropy.select_best_ngrams(_totals(src), 3)
