"""Scoring of predictions on a held-out log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.config import EMPTY
from casewise.functions.quantiles import ranked_values
from casewise.functions.scratch import written
from casewise.functions.values import seconds_between
from casewise.operators.lookup import context_table, resolve, test_rows
from casewise.operators.models import Model, access_states
from casewise.operators.positions import previous_ts
from casewise.operators.predict import all_distributions, predict_states, prob_of
from casewise.operators.structures import NGram


def score(log: DataFrame, model: Model, *, likelihood: bool = False, stop: bool = True) -> DataFrame:
    """Every test position with state, distribution and prediction (null where the model has none).

    The tables joined here have one row per state.  Rows of a state that many events share are spread by the skew
    handling of the join, since the state side is unique.
    """
    rows = resolve(test_rows(log, {"_raw": model}, stop=stop), model, "_raw", "state").drop("_raw")
    scored = rows.join(predict_states(model).select("state", "total_visits", "dist", "prediction"), "state", "left")
    if likelihood:
        scored = scored.join(all_distributions(model), "state", "left").withColumn(
            "likelihood", prob_of(F.col("full_dist"), F.col("activity"))
        )
    return scored


def rank_of_actual(prediction: Column, actual: Column) -> Column:
    """1-based place of the actual activity in the top-k list, 0 if absent; the single prediction counts as place 1."""
    return F.when(prediction["activity"] == actual, F.lit(1)).otherwise(
        F.array_position(prediction["top_k"], actual).cast("int")
    )


def outcome_counts(
    rows: DataFrame, top_k: int, by: list[str] | None = None, prediction: str = "prediction", *, double_empty: bool = False
) -> DataFrame:
    """total / correct / wrong / empty and correct within the first 1..k.

    ``double_empty`` counts rows without any state twice, which some published figures do.
    """
    p, actual = F.col(prediction), F.col("activity")
    hit = p["activity"] == actual
    rank = rank_of_actual(p, actual)
    weight = F.lit(1)
    if double_empty:
        weight = F.when(F.col("state").isNull(), F.lit(2)).otherwise(F.lit(1))
    sums = [
        F.sum(weight).alias("total"),
        F.count_if(hit).alias("correct"),
        F.count_if(~hit).alias("wrong"),
        F.sum(F.when(p.isNull(), weight).otherwise(F.lit(0))).alias("empty"),
        *[F.count_if((rank >= 1) & (rank <= k)).alias(f"top{k}") for k in range(1, top_k + 1)],
    ]
    return rows.groupBy(*(by or [])).agg(*sums)


def evaluate(log: DataFrame, model: Model, *, stop: bool = True) -> DataFrame:
    """One row of outcome counts.

    Positions are first counted by (raw state, actual activity), map-side combined, so everything after the scan works
    on states instead of events.  Structures that can lose track of a case keep the per-event check.
    """
    top_k = model.config.top_k
    rows = test_rows(log, {"_raw": model}, stop=stop)
    if model.structure.sticky:
        rows = resolve(rows, model, "_raw", "state").groupBy("state", "activity").agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = rows.groupBy("_raw", "activity").agg(F.count(F.lit(1)).alias("n"))
        if isinstance(model.structure, NGram):
            table = context_table(rows, access_states(model), "_raw")
            rows = rows.join(
                table.select(F.col("_context").alias("_raw"), F.col("resolved").alias("state")), "_raw", "left"
            )
        else:
            rows = rows.withColumnRenamed("_raw", "state")
    scored = rows.join(predict_states(model).select("state", "prediction"), "state", "left")
    return weighted_outcomes(scored, top_k)


def weighted_outcomes(scored: DataFrame, top_k: int, by: list[str] | None = None) -> DataFrame:
    """:func:`outcome_counts` of rows that stand for ``n`` positions each."""
    p, n = F.col("prediction"), F.col("n")
    rank = rank_of_actual(p, F.col("activity"))

    def count(test: Column) -> Column:
        return F.sum(F.when(test, n).otherwise(F.lit(0)))

    hit = p["activity"] == F.col("activity")
    return scored.groupBy(*(by or [])).agg(
        F.sum(n).alias("total"),
        count(hit).alias("correct"),
        count(~hit).alias("wrong"),
        count(p.isNull()).alias("empty"),
        *[count((rank >= 1) & (rank <= k)).alias(f"top{k}") for k in range(1, top_k + 1)],
    )


def prediction_vector(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Predicted and actual activity at every test position; ``__empty__`` where there is no prediction."""
    return scored.select(
        "case_id", "case_seq", "case_chunk", "pos",
        F.coalesce(F.col(prediction)["activity"], F.lit(EMPTY)).alias("predicted"),
        F.col("activity").alias("actual"),
    )


def case_perplexity(scored: DataFrame) -> DataFrame:
    """Inverse geometric mean of the likelihoods per case; infinite if one is zero."""
    impossible = F.min("likelihood") <= 0
    mean_log = F.avg(F.ln(F.when(F.col("likelihood") > 0, F.col("likelihood"))))
    return scored.groupBy("case_id").agg(
        F.when(impossible, F.lit(float("inf"))).otherwise(F.exp(-mean_log)).alias("perplexity")
    )


def perplexity_stats(perplexities: DataFrame, value: str = "perplexity") -> DataFrame:
    """Arithmetic and harmonic mean, and the elements at ``int(q n)`` of the sorted list for q = .25, .5, .75.

    The elements are selected in rounds (:mod:`casewise.functions.quantiles`), so no task holds all cases.
    """
    rows = written(perplexities.select(F.col(value).alias("v")), "perplexities")
    inverse = F.sum(F.lit(1.0) / F.col("v"))
    stats = rows.agg(
        F.count("v").alias("cases"), F.avg("v").alias("pp_arithmetic_mean"),
        F.when(inverse > 0, F.count("v") / inverse).otherwise(F.lit(float("inf"))).alias("pp_harmonic_mean"),
    )
    spots = {"pp_q1": 0.25, "pp_median": 0.5, "pp_q3": 0.75}
    names = F.array(*[F.struct(F.lit(n).alias("name"), (F.floor(F.col("cases") * F.lit(q)) + 1).alias("rank")) for n, q in spots.items()])
    wanted = written(stats.select(F.explode(names).alias("s")).select("s.*"), "perplexity-ranks")
    found = ranked_values(rows, "v", wanted.select("rank"), [])
    each = wanted.join(found, "rank").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in spots])
    return stats.join(each, F.lit(True)).select("cases", "pp_arithmetic_mean", "pp_harmonic_mean", *spots)


def per_state_stats(scored: DataFrame, model: Model) -> DataFrame:
    """Outcomes by state, with level and visits."""
    label, level = model.structure.label(F.col("state")), model.structure.level(F.col("state"))
    rows = scored.filter(F.col("state").isNotNull()).withColumns(
        {"_hit": F.col("prediction.activity") == F.col("activity"), "_none": F.col("prediction").isNull()}
    )
    counts = rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("_hit").alias("correct"),
        F.count_if(~F.col("_hit")).alias("wrong"),
        F.count_if("_none").alias("empty"),
    )
    visits = model.states().select("state", F.col("total_visits").alias("visits"))
    return counts.join(visits, "state", "left").select(
        label.alias("state"), level.alias("level"), F.coalesce("visits", F.lit(0)).alias("visits"),
        "total", "correct", "wrong", "empty",
    )


def state_rates(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {
            "correct_rate": F.try_divide(F.col("correct"), F.col("total")),
            "wrong_rate": F.try_divide(F.col("wrong"), F.col("total")),
        }
    )


def rate_by_group(stats: DataFrame, key: str) -> DataFrame:
    """Correct rate weighted by predictions, by visits, level or state."""
    return stats.groupBy(key).agg(
        F.sum("total").alias("total"), (F.sum("correct") / F.sum("total")).alias("correct_rate")
    )


def delay_errors(scored: DataFrame, delays: DataFrame) -> DataFrame:
    """Predicted against actual delay of the actual activity: count, mean error, mean delay, mean normalised error."""
    timed = previous_ts(scored).filter(F.col("ts").isNotNull() & F.col("prev_ts").isNotNull())
    rows = timed.filter(F.col("prediction").isNotNull()).join(delays, ["state", "activity"])
    actual = seconds_between(F.col("ts"), F.col("prev_ts"))
    return summarize_delays(rows.withColumn("actual_delay", actual))


def summarize_delays(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    error = F.abs(F.col("delay_s") - F.col("actual_delay"))
    both = F.col("actual_delay") + F.col("delay_s")
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("num_delays"),
        F.avg(error).alias("mean_error"),
        F.avg("actual_delay").alias("mean_delay"),
        F.avg(F.when(both == 0, F.lit(0.0)).otherwise(error / both)).alias("mean_normalized"),
    )


def model_scores(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy as a ratio and a percentage per strategy (and batch); a stored percentage wins over counts."""
    keys = ["strategy", *(by or [])]
    ratio = F.sum("correct") / F.sum("total")
    columns = [ratio.alias("accuracy"), (ratio * 100).alias("accuracy_pct")]
    if "perplexity" in stats.columns:
        columns.append(F.avg("perplexity").alias("perplexity"))
    return stats.groupBy(*keys).agg(*columns)

