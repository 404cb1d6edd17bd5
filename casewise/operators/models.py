"""Learning: everything a frequency automaton knows follows from its transition counts.

``transitions`` is one map-side-combined aggregation over the annotated log.  Visits of a state are the arrivals into it
(plus one per case for the initial state), so states, probabilities and lookups are all derived from that small table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.scratch import written
from casewise.functions.values import literal, seconds_between
from casewise.operators.positions import positioned, previous_ts
from casewise.operators.structures import NGram, Structure, annotate, last_states

DIST = "array<struct<activity:string,prob:double>>"


@dataclass(frozen=True)
class Miner:
    """A structure with the gate its predictions have to pass."""

    structure: Structure
    min_total_visits: int = 1
    min_max_prob: float = 0.0


@dataclass
class Model:
    """A trained miner: transition counts, and mean delays when time is included."""

    miner: Miner
    transitions: DataFrame
    delays: DataFrame | None = None
    config: Config = field(default_factory=Config)

    @property
    def structure(self) -> Structure:
        return self.miner.structure

    def states(self) -> DataFrame:
        return state_table(self.transitions)

    def persist(self) -> Model:
        """Keep the transition table for repeated use; it is small next to the log."""
        return replace(self, transitions=self.transitions.persist())

    def unpersist(self) -> None:
        self.transitions.unpersist()


def transitions(annotated: DataFrame, name: str = "state") -> DataFrame:
    """(state, activity, next_state, freq, opens): ``opens`` counts the cases that started with the step."""
    return annotated.groupBy(
        F.col(name).alias("state"), "activity", F.col(f"{name}_next").alias("next_state")
    ).agg(F.count(F.lit(1)).alias("freq"), F.count_if(F.col("pos") == 0).alias("opens"))


def train(log: DataFrame, miner: Miner, config: Config | None = None, *, with_delays: bool = False) -> Model:
    """One model, planned lazily."""
    config = config or Config()
    annotated = annotate(log, {"state": miner.structure})
    delays = transition_delays(previous_ts(annotated), "state", config.maxlen_delays) if with_delays else None
    return Model(miner, transitions(annotated), delays, config)


class ModelSet(dict):
    """Models by name, trained together; ``table`` holds the packed transitions of all of them."""

    def __init__(self, models: dict[str, Model], table: DataFrame) -> None:
        super().__init__(models)
        self.table = table

    def number(self, name: str) -> int:
        return list(self).index(name)


def train_all(
    log: DataFrame, miners: dict[str, Miner], config: Config | None = None, *, with_delays: bool = False
) -> ModelSet:
    """Train several miners on one pass: every event gives one packed row per structure to one aggregation.

    The transition counts, which are small next to the log, are written to the working folder, so whatever is planned on
    top of the models starts from a table and not from the log.
    """
    config = config or Config()
    annotated = annotate(log, {n: m.structure for n, m in miners.items()})
    # miners that differ in their gate only share their counts
    twins: dict[Structure, list[int]] = {}
    for i, m in enumerate(miners.values()):
        twins.setdefault(m.structure, []).append(i)
    names = list(miners)
    steps = F.array(
        *[
            F.struct(
                F.lit(k).alias("structure"),
                s.pack(F.col(names[numbers[0]])).alias("state"),
                s.pack(F.col(f"{names[numbers[0]]}_next")).alias("next_state"),
            )
            for k, (s, numbers) in enumerate(twins.items())
        ]
    )
    members = F.element_at(F.array(*[F.array(*map(F.lit, numbers)) for numbers in twins.values()]), F.col("structure") + 1)
    counts = (
        annotated.select("activity", "pos", F.explode(steps).alias("_s"))
        .groupBy("_s.structure", "_s.state", "activity", "_s.next_state")
        .agg(F.count(F.lit(1)).alias("freq"), F.count_if(F.col("pos") == 0).alias("opens"))
        .select(F.explode(members).alias("member"), "state", "activity", "next_state", "freq", "opens")
    )
    table = written(counts, "transitions", ["member"])
    models = {}
    for i, (name, miner) in enumerate(miners.items()):
        unpack = miner.structure.unpack
        own = table.filter(F.col("member") == i).select(
            unpack(F.col("state")).alias("state"), "activity", unpack(F.col("next_state")).alias("next_state"), "freq", "opens"
        )
        models[name] = Model(miner, own, None, config)
    if with_delays:
        timed = previous_ts(annotated)
        for name, model in models.items():
            model.delays = transition_delays(timed, name, config.maxlen_delays)
    return ModelSet(models, table)


def state_table(trans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(state, total_visits, active_visits, freqs): one row per visited state.

    Each transition gives a departure and an arrival; one aggregation puts them together.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    departure = F.struct(
        F.col("state").alias("state"), F.col("activity").alias("activity"), F.col("freq").alias("out"), F.col("opens").alias("in")
    )
    arrival = F.struct(
        F.col("next_state").alias("state"), none.alias("activity"), zero.alias("out"), F.col("freq").alias("in")
    )
    by = by or []
    rows = trans.select(*by, F.explode(F.array(departure, arrival)).alias("r")).select(*by, "r.*")
    return rows.groupBy(*by, "state").agg(
        F.sum("in").alias("total_visits"),
        (F.sum("in") - F.sum("out")).alias("active_visits"),
        F.collect_list(F.when(F.col("out") > 0, F.struct("activity", F.col("out").alias("freq")))).alias("freqs"),
    )


def distribution(freqs: Column, visits: Column, stop: str) -> Column:
    """Probabilities of the activities of a state and, as the remainder, of STOP."""
    seen = F.aggregate(freqs, F.lit(0).cast("bigint"), lambda acc, x: acc + x["freq"])
    rest = F.when(visits > 0, F.greatest(F.lit(0.0), (visits - seen) / visits)).otherwise(F.lit(1.0))
    probs = F.transform(
        freqs, lambda x: F.struct(x["activity"].alias("activity"), (x["freq"] / visits).alias("prob"))
    )
    return F.concat(probs, F.array(F.struct(F.lit(stop).alias("activity"), rest.alias("prob")))).cast(DIST)


def weights(freqs: Column, visits: Column, stop: str) -> Column:
    """The counts behind :func:`distribution`, as weights: shares of them carry no rounding from an earlier division."""
    seen = F.aggregate(freqs, F.lit(0).cast("bigint"), lambda acc, x: acc + x["freq"])
    rest = F.when(visits > 0, F.greatest(F.lit(0), visits - seen)).otherwise(F.lit(1)).cast("double")
    counts = F.transform(freqs, lambda x: F.struct(x["activity"].alias("activity"), x["freq"].cast("double").alias("prob")))
    return F.concat(counts, F.array(F.struct(F.lit(stop).alias("activity"), rest.alias("prob")))).cast(DIST)


def max_prob(dist: Column) -> Column:
    return F.array_max(F.transform(dist, lambda x: x["prob"]))


def alphabet(trans: DataFrame) -> Column:
    """All activities a model knows, sorted, as a scalar array."""
    return trans.agg(F.sort_array(F.collect_set("activity")).alias("a")).scalar()


def gated_states(model: Model) -> DataFrame:
    """Visited states that pass the gate, with their distribution."""
    m = model.miner
    return (
        model.states()
        .filter(F.col("total_visits") >= m.min_total_visits)
        .withColumn("dist", distribution(F.col("freqs"), F.col("total_visits"), model.config.stop_symbol))
        .filter(max_prob(F.col("dist")) >= m.min_max_prob)
    )


def state_probabilities(model: Model) -> DataFrame:
    """(state, activity, prob) over every known activity and STOP, zeros included."""
    freq = F.map_from_entries("freqs")
    stop = model.config.stop_symbol
    rows = model.states().withColumn("dist", distribution(F.col("freqs"), F.col("total_visits"), stop))
    rows = rows.withColumn(
        "activity", F.explode(F.concat(alphabet(model.transitions), F.array(F.lit(stop))))
    )
    remainder = F.element_at("dist", -1)["prob"]
    prob = F.when(F.col("activity") == stop, remainder).otherwise(
        F.coalesce(F.try_element_at(freq, F.col("activity")) / F.col("total_visits"), F.lit(0.0))
    )
    return rows.select("state", "activity", prob.alias("prob"))


def access_states(model: Model) -> DataFrame:
    """Every state an n-gram model can be in: the initial one and all prefixes of visited contexts."""
    contexts = model.transitions.select("next_state").distinct()
    prefixes = contexts.filter(F.size("next_state") > 0).select(
        F.explode(
            F.transform(F.sequence(F.lit(1), F.size("next_state")), lambda n: F.slice("next_state", F.lit(1), n))
        ).alias("state")
    )
    first = model.transitions.sparkSession.range(1).select(model.structure.initial().alias("state"))
    return prefixes.unionByName(first).distinct()


def known_states(model: Model) -> DataFrame:
    """(state, total_visits, ...) including states that exist without ever being visited."""
    states = model.states()
    if isinstance(model.structure, NGram) and model.structure.window > 1:
        return access_states(model).join(states, "state", "left").select(
            "state",
            F.coalesce("total_visits", F.lit(0).cast("bigint")).alias("total_visits"),
            F.coalesce("active_visits", F.lit(0).cast("bigint")).alias("active_visits"),
            F.coalesce("freqs", F.array().cast("array<struct<activity:string,freq:bigint>>")).alias("freqs"),
        )
    return states


def num_states(model: Model) -> DataFrame:
    return known_states(model).agg(F.count(F.lit(1)).alias("states"))


def transition_delays(timed: DataFrame, name: str = "state", maxlen: int = 50) -> DataFrame:
    """Mean of the last ``maxlen`` delays per (state, activity).

    The rank limit is applied map-side before the shuffle, so a state that every case visits sends at most ``maxlen``
    rows per task.
    """
    delay = seconds_between(F.col("ts"), F.col("prev_ts"))
    latest = Window.partitionBy("state", "activity").orderBy(F.col("seq").desc())
    return (
        timed.filter(F.col("ts").isNotNull() & F.col("prev_ts").isNotNull())
        .select(F.col(name).alias("state"), "activity", "seq", delay.alias("delay"))
        .withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= maxlen)
        .groupBy("state", "activity")
        .agg(F.avg("delay").alias("delay_s"), F.count(F.lit(1)).alias("delays"))
    )


def active_cases(annotated: DataFrame, name: str = "state") -> DataFrame:
    """Number of cases now in each state; the states themselves come from :func:`last_states`."""
    return last_states(annotated, name).groupBy("state").agg(F.count(F.lit(1)).alias("active_cases"))


def modified_cases(log: DataFrame, structures: dict[str, Structure], at=None) -> DataFrame:
    """Cases whose prediction may change with the event of order ``at`` (by default the last one).

    These are the cases now in a state the event left or entered, in any of the structures.
    """
    if at is None:
        at = log.agg(F.max("seq")).first()[0]
    annotated = annotate(log.filter(F.col("seq") <= literal(at)), structures)
    out = None
    for name in structures:
        event = annotated.filter(F.col("seq") == literal(at))
        touched = event.select(F.explode(F.array(F.col(name), F.col(f"{name}_next"))).alias("state"))
        cases = last_states(annotated, name).join(F.broadcast(touched), "state", "left_semi").select("case_id")
        out = cases if out is None else out.unionByName(cases)
    return out.distinct()


def top_visited_states(model: Model, n: int = 3) -> DataFrame:
    """The most visited states and their share of visits, the initial state left out."""
    label = model.structure.label(F.col("state"))
    rows = model.states().filter(F.col("state") != model.structure.initial())
    total = rows.agg(F.sum("total_visits").alias("t")).scalar()
    return (
        rows.select(label.alias("state"), F.col("total_visits").alias("visits"))
        .orderBy(F.desc("visits"), "state")
        .limit(n)
        .withColumn("visit_rate", F.col("visits") / total)
    )


def automaton_graph(annotated: DataFrame, model: Model, name: str = "state") -> tuple[DataFrame, DataFrame]:
    """Nodes with total and active visits; edges with the most recent transition marked."""
    label = model.structure.label
    nodes = model.states().select(label(F.col("state")).alias("state"), "total_visits", "active_visits")
    last = annotated.agg(F.max("seq").alias("s")).scalar()
    edges = annotated.groupBy(
        F.col(name).alias("state"), "activity", F.col(f"{name}_next").alias("next_state")
    ).agg(F.count(F.lit(1)).alias("freq"), F.max("seq").alias("_last"))
    return nodes, edges.select(
        label(F.col("state")).alias("state"),
        "activity",
        label(F.col("next_state")).alias("next_state"),
        "freq",
        (F.col("_last") == last).alias("is_last"),
    )


def exact_prefix_counts(log: DataFrame, name: str = "state") -> DataFrame:
    """(state, activity, freq) of a log whose cases end in an explicit STOP row."""
    from casewise.operators.structures import PrefixTree, with_stop_rows

    rows = with_stop_rows(annotate(positioned(log), {name: PrefixTree()}), [name], Config().stop_symbol)
    return rows.groupBy(F.col(name).alias("state"), "activity").agg(F.count(F.lit(1)).alias("freq"))
