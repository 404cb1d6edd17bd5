"""Tables for files: predictions, actuals, statistics, automata, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.values import duration_text, joined
from casewise.operators.models import Model


def prediction_rows(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """step, case_id, timestamp, actual, predicted, ``a|b|c`` top-k, correct (null without a prediction)."""
    p = F.col(prediction)
    return scored.select(
        "step", "case_id", F.col("ts").alias("timestamp"), F.col("activity").alias("actual"),
        p["activity"].alias("predicted"),
        F.when(p.isNotNull(), joined(p["top_k"])).alias("top_k"),
        (p["activity"] == F.col("activity")).cast("int").alias("correct"),
    )


def actual_rows(log: DataFrame) -> DataFrame:
    return log.select("step", "case_id", F.col("ts").alias("timestamp"), F.col("activity").alias("actual"))


def write_rows(df: DataFrame, path: str, *, by: list[str] | None = None, fmt: str = "csv", append: bool = True) -> None:
    """Write in parallel; ``append=False`` replaces what is there."""
    writer = df.write.mode("append" if append else "overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_predictions(models: dict[str, DataFrame], path: str, *, fmt: str = "csv", append: bool = True) -> None:
    """One folder per model under ``path``."""
    tall = None
    for name, rows in models.items():
        rows = rows.withColumn("model", F.lit(name))
        tall = rows if tall is None else tall.unionByName(rows)
    write_rows(tall, path, by=["model"], fmt=fmt, append=append)


def stats_rows(wide: DataFrame, keys: list[str], durations: tuple[str, ...] = ()) -> DataFrame:
    """One row per model from columns ``model.metric``: decimals to two places, ``durations`` (seconds) as text.

    The column names say which row they belong to, so no unpivot or pivot moves data: each input row turns into one
    array entry per model.
    """
    models: dict[str, dict[str, str]] = {}
    for name in wide.columns:
        if name not in keys and "." in name:
            model, metric = name.split(".", 1)
            models.setdefault(model, {})[metric] = name
    metrics = sorted({m for columns in models.values() for m in columns})
    types = dict(wide.dtypes)

    def cell(metric: str, column: str | None) -> Column:
        if column is None:
            return F.lit(None)
        value = F.col(f"`{column}`")
        if metric in durations:
            return duration_text(value)
        return F.round(value, 2) if types[column] in ("double", "float") else value

    entries = [
        F.struct(F.lit(model).alias("model"), *[cell(m, columns.get(m)).alias(m) for m in metrics])
        for model, columns in models.items()
    ]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")


def automaton_edges(model: Model) -> DataFrame:
    """state, activity, next_state, occurrences and their share among the departures of the state."""
    label = model.structure.label
    states = model.states().select("state", (F.col("total_visits") - F.col("active_visits")).alias("_out"))
    return (
        model.transitions.filter((F.col("freq") > 0) & (F.col("activity") != model.config.stop_symbol))
        .join(states, "state")
        .select(
            label(F.col("state")).alias("state"), "activity", label(F.col("next_state")).alias("next_state"),
            F.col("freq").alias("occurrences"), F.try_divide(F.col("freq"), F.col("_out")).alias("frequency"),
        )
    )


def automaton_nodes(model: Model) -> DataFrame:
    from casewise.operators.models import known_states

    return known_states(model).select(model.structure.label(F.col("state")).alias("state"), "total_visits")


def export_automaton(model: Model, path: str) -> None:
    """Nodes and edges as JSON lines under ``path``."""
    automaton_nodes(model).write.mode("overwrite").json(f"{path}/states")
    automaton_edges(model).write.mode("overwrite").json(f"{path}/transitions")


def results_summary(metrics: DataFrame, accuracy: str = "accuracy") -> DataFrame:
    """Per model over iterations: mean and population deviation of accuracy, mean of every other number, in percent."""
    others = [c for c, t in metrics.dtypes if c not in ("model", "iteration", accuracy) and t in ("int", "bigint", "double")]
    return metrics.groupBy("model").agg(
        (F.avg(accuracy) * 100).alias("mean_accuracy_pct"),
        (F.stddev_pop(accuracy) * 100).alias("std_pct"),
        *[F.avg(c).alias(f"mean_{c}") for c in others],
    )


def run_summaries(spark, folder: str, patterns: list[str], names: dict[str, str]) -> DataFrame:
    """Summaries of all runs whose own name below ``folder`` contains one of ``patterns``, averaged per model, under display names."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/*.csv")
    parent = folder.rstrip("/").rsplit("/", 1)[-1]
    path = F.split(F.substring_index(F.col("_metadata.file_path"), f"/{parent}/", -1), "/")[0]
    wanted = F.lit(False)
    for p in patterns:
        wanted = wanted | path.contains(p)
    numbers = [c for c, t in rows.dtypes if t in ("int", "bigint", "double")]
    display = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        rows.filter(wanted)
        .filter(F.col("Model").isin(*names))
        .groupBy("Model")
        .agg(*[F.avg(F.col(f"`{c}`")).alias(c) for c in numbers])
        .withColumn("name", display[F.col("Model")])
    )
