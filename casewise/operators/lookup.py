"""State lookup: in which state of a trained model is a running case?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.operators.models import Model, access_states, known_states
from casewise.operators.positions import case_running, positioned
from casewise.operators.structures import NGram, annotate, last_states, with_stop_rows


def context_table(contexts: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """(context, resolved): the longest suffix of each distinct context among the known states.

    Only distinct contexts take part, so the expansion is by states, not by events.  The empty suffix counts only for
    the empty context: a case that matches nothing has no state.
    """
    distinct = contexts.select(F.col(name).alias("_context")).distinct()
    suffixes = distinct.withColumn(
        "_n", F.explode(F.sequence(F.least(F.lit(1), F.size("_context")), F.size("_context")))
    ).withColumn("_suffix", F.slice("_context", F.size("_context") - F.col("_n") + 1, F.col("_n")))
    hits = suffixes.join(known.select(F.col("state").alias("_suffix")), "_suffix")
    return hits.groupBy("_context").agg(F.max_by("_suffix", "_n").alias("resolved"))


def path_matches(rows: DataFrame, model: Model, name: str) -> DataFrame:
    """Add ``_valid``: every earlier step of the case is a known transition."""
    steps = model.transitions.select(F.col("state").alias(name), "activity").distinct().withColumn("_hit", F.lit(1))
    hit = rows.join(steps, [name, "activity"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(0)))
    run = case_running(hit, {"_ok": ("min", F.col("_hit"))})
    return run.withColumn("_valid", F.coalesce("_ok", F.lit(1)) == 1).drop("_hit", "_ok")


def resolve(rows: DataFrame, model: Model, name: str, out: str) -> DataFrame:
    """Add ``out``: the state of the model at every row, null where it has none.

    ``rows`` carry the raw state of the structure in column ``name`` (see :func:`annotate`).
    """
    structure = model.structure
    if structure.sticky:
        valid = path_matches(rows, model, name)
        return valid.withColumn(out, F.when(F.col("_valid"), F.col(name))).drop("_valid")
    if isinstance(structure, NGram):
        table = context_table(rows, access_states(model), name)
    else:
        table = model.states().select(F.col("state").alias("_context"), F.col("state").alias("resolved"))
    table = table.select(F.col("_context").alias(name), F.col("resolved").alias(out))
    return rows.join(table, name, "left")


def test_rows(log: DataFrame, models: dict[str, Model], *, stop: bool = True) -> DataFrame:
    """Positions of a test log with the raw state of every model, STOP rows included."""
    rows = annotate(log, {n: m.structure for n, m in models.items()})
    symbol = next(iter(models.values())).config.stop_symbol
    if stop:
        return with_stop_rows(rows, list(models), symbol)
    return rows.drop(*[f"{n}_next" for n in models])


def lookup(log: DataFrame, model: Model, *, stop: bool = True) -> DataFrame:
    """State at every position of a test log."""
    rows = test_rows(log, {"_raw": model}, stop=stop)
    return resolve(rows, model, "_raw", "state").drop("_raw")


def parse_sequences(log: DataFrame, model: Model) -> DataFrame:
    """Final state of every case by exact steps only, null if the case leaves the automaton."""
    rows = test_rows(log, {"_raw": model})
    end = path_matches(rows, model, "_raw").filter(F.col("activity") == model.config.stop_symbol)
    return end.select("case_id", F.when(F.col("_valid"), F.col("_raw")).alias("state"))


def case_states(model: Model, trained_on: DataFrame, cases: DataFrame) -> DataFrame:
    """Current state of the given cases; the initial state for unknown ones."""
    now = last_states(annotate(positioned(trained_on), {"state": model.structure}), "state")
    return cases.select("case_id").distinct().join(now, "case_id", "left").withColumn(
        "state", F.coalesce("state", model.structure.initial())
    )


def composed_states(rows: DataFrame, names: list[str], out: str = "composed") -> DataFrame:
    """Add the member states as one struct; null from the first position on at which all members had none."""
    dead = F.lit(True)
    for n in names:
        dead = dead & F.col(n).isNull()
    run = case_running(rows.withColumn("_dead", dead.cast("int")), {"_d": ("max", F.col("_dead"))}, inclusive=True)
    alive = F.coalesce("_d", F.lit(0)) == 0
    return run.withColumn(out, F.when(alive, F.struct(*names))).drop("_dead", "_d")


__all__ = [
    "case_states",
    "composed_states",
    "context_table",
    "known_states",
    "lookup",
    "parse_sequences",
    "path_matches",
    "resolve",
    "test_rows",
]
