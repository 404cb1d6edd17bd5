"""Comparing models with each other on the same positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import EMPTY
from casewise.functions.ordering import CHUNK_ROWS, add_index, running_total, setting


def align_predictions(models: dict[str, DataFrame], actual: DataFrame, key: str = "step") -> DataFrame:
    """One row per step that every model and the actual log have, with the predictions as an array.

    The rows of one step are as many as there are models, so they are gathered by one aggregation instead of a chain of
    joins; steps that some model lacks fall away.
    """
    tall = actual.select(key, F.lit(None).cast("string").alias("model"), F.col("actual").alias("value"))
    for name, rows in models.items():
        tall = tall.unionByName(rows.select(key, F.lit(name).alias("model"), F.col("predicted").alias("value")))
    entry = F.struct("model", F.coalesce("value", F.lit(EMPTY)).alias("predicted"))
    return (
        tall.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max(F.when(F.col("model").isNull(), F.col("value"))).alias("actual"),
            F.sort_array(F.collect_list(F.when(F.col("model").isNotNull(), entry))).alias("votes"),
        )
        .filter((F.col("_n") == len(models) + 1) & F.col("actual").isNotNull())
        .drop("_n")
    )


def vote_array(predictions: dict[str, Column]) -> Column:
    """``votes`` from prediction columns of one row."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("model"), F.coalesce(c, F.lit(EMPTY)).alias("predicted"))
            for n, c in predictions.items()
        ]
    )


def vote_patterns(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(votes, actual, n): equal rows counted once, map-side combined.  Everything pairwise works on this table."""
    return rows.groupBy(*(by or []), "votes", "actual").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(patterns: DataFrame, by: list[str] | None = None, *, include_empty: bool = False, with_actual: bool = False) -> DataFrame:
    """Counts for every (tested, reference) pair of models."""
    votes = F.col("votes")
    if with_actual:
        actual = F.struct(F.lit("actual").alias("model"), F.col("actual").alias("predicted"))
        votes = F.concat(votes, F.array(actual))
    pairs = (
        patterns.withColumn("_v", votes)
        .withColumn("_t", F.explode("_v"))
        .withColumn("_r", F.explode("_v"))
        .select(
            *(by or []), "actual", "n",
            F.col("_t.model").alias("tested"), F.col("_r.model").alias("reference"),
            F.col("_t.predicted").alias("t"), F.col("_r.predicted").alias("r"),
        )
    )
    if not include_empty:
        pairs = pairs.filter((F.col("t") != EMPTY) & (F.col("r") != EMPTY))

    def count(test: Column) -> Column:
        return F.sum(F.when(test, F.col("n")).otherwise(F.lit(0)))

    good_r, good_t = F.col("r") == F.col("actual"), F.col("t") == F.col("actual")
    return pairs.groupBy(*(by or []), "tested", "reference").agg(
        F.sum("n").alias("positions"),
        count(good_r).alias("ref_correct"),
        count(good_r & good_t).alias("both_correct"),
        count(~good_r).alias("ref_incorrect"),
        count(~good_r & good_t).alias("tested_only"),
        count(F.col("t") == F.col("r")).alias("matches"),
    )


def ratios(counts: DataFrame, scale: float = 1.0) -> DataFrame:
    """Correlation, anticorrelation and similarity; null where there is nothing to divide by."""

    def ratio(a: str, b: str) -> Column:
        return F.try_divide(F.col(a) * F.lit(scale), F.col(b))

    return counts.withColumns(
        {
            "correlation": ratio("both_correct", "ref_correct"),
            "anticorrelation": ratio("tested_only", "ref_incorrect"),
            "similarity": ratio("matches", "positions"),
        }
    )


def compare_models(rows: DataFrame, tested: str, reference: str, *, include_empty: bool = False, by: list[str] | None = None) -> DataFrame:
    counts = pair_counts(vote_patterns(rows, by), by, include_empty=include_empty)
    return ratios(counts.filter((F.col("tested") == tested) & (F.col("reference") == reference)))


def comparison_matrix(rows: DataFrame, *, with_actual: bool = True) -> DataFrame:
    """All pairs in percent, long form."""
    return ratios(pair_counts(vote_patterns(rows), with_actual=with_actual), 100.0)


def as_matrix(matrix: DataFrame, value: str, models: list[str]) -> DataFrame:
    """One of the measures as tested × reference."""
    return matrix.groupBy("tested").pivot("reference", models).agg(F.first(value))


def default_reference(models: list[str]) -> str:
    return "ngram_3" if "ngram_3" in models else models[0]


def versus_reference(rows: DataFrame, models: list[str], reference: str | None = None) -> DataFrame:
    """All models against one reference, in percent."""
    reference = reference if reference in models else default_reference(models)
    return comparison_matrix(rows, with_actual=False).filter(F.col("reference") == reference)


def comparison_curves(
    steps: DataFrame, stride: int = 100, horizon: int | None = None, *, step: str = "step"
) -> DataFrame:
    """Measures of one pair at every ``stride``, from the start or over the last ``horizon`` predictions.

    ``steps`` has ``tested``, ``reference`` and ``actual`` per step.  Steps with an empty prediction are dropped and the
    rest renumbered.  A window sum is the difference of two running sums, so a long horizon costs no more than a short one.
    """
    stride = stride if stride > 0 else 100
    rows = setting(steps, "chunkRows", CHUNK_ROWS)
    live = steps.filter((F.col("tested") != EMPTY) & (F.col("reference") != EMPTY)).withColumn(
        "_chunk", F.floor(F.col(step) / rows)
    )
    good_r, good_t = F.col("reference") == F.col("actual"), F.col("tested") == F.col("actual")
    sums = {
        "t": F.lit(1).cast("bigint"),
        "ref_correct": good_r.cast("bigint"),
        "both_correct": (good_r & good_t).cast("bigint"),
        "ref_incorrect": (~good_r).cast("bigint"),
        "tested_only": (~good_r & good_t).cast("bigint"),
        "matches": (F.col("tested") == F.col("reference")).cast("bigint"),
        "tested_correct": good_t.cast("bigint"),
    }
    cums = running_total(live, [step], sums, chunk="_chunk").select(*sums)
    at = cums.filter(F.col("t") % stride == 0)
    width = F.col("t")
    if horizon is not None:
        before = cums.filter((F.col("t") + horizon) % stride == 0).select(
            (F.col("t") + horizon).alias("t"), *[F.col(c).alias(f"_b_{c}") for c in sums if c != "t"]
        )
        at = at.join(before, "t", "left").withColumns(
            {c: F.col(c) - F.coalesce(F.col(f"_b_{c}"), F.lit(0)) for c in sums if c != "t"}
        )
        width = F.least(F.col("t"), F.lit(horizon))
    return at.select(
        "t",
        F.try_divide(F.col("both_correct"), F.col("ref_correct")).alias("correlation"),
        F.try_divide(F.col("tested_only"), F.col("ref_incorrect")).alias("anticorrelation"),
        (F.col("matches") / width).alias("similarity"),
        (F.col("tested_correct") / width).alias("accuracy"),
    )


def accuracy_by_window(scores: DataFrame) -> DataFrame:
    """Mean accuracy in percent by family and window, both read from names ``ngram_<k>`` and ``<family>_win<w>``."""
    gram = F.regexp_extract("model", r"^ngram_(\d+)$", 1)
    family = F.regexp_extract("model", r"^(.+)_win(\d+)$", 1)
    width = F.regexp_extract("model", r"^(.+)_win(\d+)$", 2)
    return (
        scores.withColumns(
            {
                "family": F.when(gram != "", F.lit("ngram")).when(family != "", family),
                "window": F.when(gram != "", F.try_to_number(gram, F.lit("999")).cast("int") - 1).when(
                    width != "", F.try_to_number(width, F.lit("999")).cast("int")
                ),
            }
        )
        .filter(F.col("family").isNotNull())
        .groupBy("family", "window")
        .agg((F.avg("accuracy") * 100).alias("accuracy_pct"))
    )


def number_steps(rows: DataFrame, order: list[str], chunk: str = "chunk") -> DataFrame:
    return add_index(rows, order, name="step", chunk=chunk)
