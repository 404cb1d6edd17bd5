"""From a distribution to a prediction, as column expressions.

A distribution is ``ARRAY<STRUCT<activity, prob>>`` with STOP as one of its entries and absent activities at zero.
Null means that a model has no answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.values import hash_uniform, let
from casewise.operators.models import DIST, Model, alphabet, distribution, gated_states, known_states, weights

DIGITS = 12


def total(dist: Column) -> Column:
    return F.aggregate(dist, F.lit(0.0), lambda acc, x: acc + x["prob"])


def prob_of(dist: Column, activity: Column) -> Column:
    return F.coalesce(F.get(F.filter(dist, lambda x: x["activity"] == activity), 0)["prob"], F.lit(0.0))


def without_stop(dist: Column, stop: str, known: Column | None) -> Column:
    """Drop STOP and renormalise; if nothing but STOP had weight, every known activity is equally likely.

    ``dist`` may hold counts instead of probabilities (:func:`~casewise.operators.models.weights`), which avoids rounding twice.
    """

    def answer(rest: Column) -> Column:
        listed = F.transform(rest, lambda x: x["activity"]) if known is None else known
        even = F.when(F.size(listed) > 0, F.transform(listed, lambda a: _entry(a, F.lit(1.0) / F.size(listed))))

        def scale(weight: Column) -> Column:
            certain = (weight <= 0) & (prob_of(dist, F.lit(stop)) > 0)
            scaled = F.transform(rest, lambda x: _entry(x["activity"], x["prob"] / weight))
            return F.when(certain, even).when(weight > 0, scaled).otherwise(F.when(F.size(rest) > 0, rest))

        return let(total(rest), scale)

    return let(F.filter(dist, lambda x: x["activity"] != stop), answer).cast(DIST)


def _entry(activity: Column, prob: Column) -> Column:
    return F.struct(activity.alias("activity"), prob.alias("prob"))


def prediction(
    dist: Column, config: Config, known: Column | None = None, draw: Column | None = None
) -> Column:
    """STRUCT<activity, top_k, probability>; null without a distribution.

    Order is by falling probability, then by name.  Activities without weight are offered only if none has any.
    ``draw`` is the uniform number used when ``config.randomized`` is set.
    """
    if config.randomized and draw is None:
        raise ValueError("a randomized prediction needs a draw column")
    if not config.include_stop:
        dist = without_stop(dist, config.stop_symbol, known)

    def keyed(x: Column) -> Column:
        return F.struct(
            (-F.round(x["prob"], DIGITS)).alias("order"), x["activity"].alias("activity"), x["prob"].alias("prob")
        )

    def choose(ranked: Column) -> Column:
        hopeless = F.get(ranked, 0)["prob"] <= 0
        offered = F.filter(F.slice(ranked, 1, config.top_k), lambda x: (x["prob"] > 0) | hopeless)
        best = _drawn(ranked, draw) if config.randomized else F.get(ranked, 0)
        return F.struct(
            best["activity"].alias("activity"),
            F.transform(offered, lambda x: x["activity"]).alias("top_k"),
            best["prob"].alias("probability"),
        )

    # null stays null; the distribution may be a long expression, so it is named once only
    return let(F.sort_array(F.transform(dist, keyed)), lambda r: F.when(F.size(r) > 0, choose(r)))


def _drawn(ranked: Column, draw: Column) -> Column:
    """The entry in whose slice of the cumulative distribution the draw falls; even slices if all weights are zero."""
    start = F.struct(F.lit(0.0).alias("upto"), F.lit(-1).alias("i"), F.lit(-1).alias("hit"))

    def pick(weight: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            share = F.when(weight > 0, x["prob"] / weight).otherwise(F.lit(1.0) / F.size(ranked))
            upto = acc["upto"] + share
            i = acc["i"] + 1
            hit = F.when((acc["hit"] < 0) & (draw < upto), i).otherwise(acc["hit"])
            return F.struct(upto.alias("upto"), i.alias("i"), hit.alias("hit"))

        hit = F.aggregate(ranked, start, step)["hit"]
        return let(hit, lambda h: F.get(ranked, F.when(h < 0, F.size(ranked) - 1).otherwise(h)))

    return let(total(ranked), pick)


def row_draw(seed: int | str = 0) -> Column:
    """One uniform number per (case, position)."""
    return hash_uniform(F.concat_ws("#", "case_id", "pos"), seed)


def predict_states(model: Model) -> DataFrame:
    """(state, total_visits, dist, prediction) for every state that passes the gate."""
    config = model.config
    if config.randomized:
        raise ValueError("randomized predictions are drawn per row, not per state")
    states = gated_states(model)
    if config.include_stop:
        return states.withColumn("prediction", prediction(F.col("dist"), config))
    states = states.withColumn("_known", alphabet(model.transitions))
    counts = weights(F.col("freqs"), F.col("total_visits"), config.stop_symbol)
    return states.withColumn("prediction", prediction(counts, config, F.col("_known"))).drop("_known")


def delay_map(delays: DataFrame) -> DataFrame:
    """(state, delays MAP<activity, seconds>)."""
    return delays.groupBy("state").agg(
        F.map_from_entries(F.collect_list(F.struct("activity", "delay_s"))).alias("delays")
    )


def predict_with_delays(model: Model) -> DataFrame:
    """:func:`predict_states` with the expected delay of each activity."""
    return predict_states(model).join(delay_map(model.delays), "state", "left")


def all_distributions(model: Model) -> DataFrame:
    """(state, full_dist) of every known state without any gate, for likelihoods.

    A state that exists but was never visited gives STOP the whole weight.
    """
    return known_states(model).select(
        "state", distribution(F.col("freqs"), F.col("total_visits"), model.config.stop_symbol).alias("full_dist")
    )


def bayes_states(counts: DataFrame, config: Config, *, nonsingle: bool = False) -> DataFrame:
    """Predictions from exact-prefix counts with explicit STOP; ``nonsingle`` blanks prefixes seen once."""
    rows = counts.groupBy("state").agg(
        F.sum("freq").alias("total_visits"), F.collect_list(F.struct("activity", "freq")).alias("freqs")
    )
    if nonsingle:
        rows = rows.filter(F.col("total_visits") > 1)
    dist = F.transform(
        "freqs", lambda x: F.struct(x["activity"].alias("activity"), (x["freq"] / F.col("total_visits")).alias("prob"))
    ).cast(DIST)
    return rows.withColumn("dist", dist).withColumn("prediction", prediction(F.col("dist"), config))
