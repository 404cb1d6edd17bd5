"""Walking cases through a supplied probabilistic automaton.

An event is a partial map from states to states, and maps compose. Cases are cut into blocks of events. Where the state before a block is
known, its events are folded one after the other, many blocks at a time; a case of one block needs nothing else. Longer cases first learn
those states: every block's map, as rows of the states it leads somewhere, is composed with its neighbour's over and over (blocks of 1, 2, 4, ...),
and the state at the start of a case is handed down the same tree. So no task holds more than a block of a case, and no event carries an array
of states.

The transitions are sent to every task after a check of their number. Larger tables are joined instead: then each event is a block of its
own, whose map holds only the states that can stand between it and the event before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions.scratch import written
from casewise.operators.models import DIST
from casewise.operators.positions import case_lookback, positioned

BLOCK = 256
#: transitions that are sent to every task (about 12 bytes each, and the names)
MOST_TRANSITIONS = 1 << 20
#: rows that a task hands on at a time
PART = 1 << 18


@dataclass
class Transitions:
    """Transitions by number of activity and state, in this order; -1 is no state."""

    states: pa.Array
    activities: pa.Array
    keys: np.ndarray
    targets: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Transitions:
        """From (state, activity, next_state), each next state being a state."""
        states = pc.unique(pa.chunked_array([*rows["state"].chunks, *rows["next_state"].chunks], pa.string())).sort()
        activities = pc.unique(rows["activity"]).sort()
        out = cls(states, activities, np.zeros(0, np.int64), np.zeros(0, np.int64))
        s, t, a = out.numbers(rows["state"], states), out.numbers(rows["next_state"], states), out.numbers(rows["activity"], activities)
        keys = a * len(states) + s
        order = np.argsort(keys)
        out.keys, out.targets = keys[order], t[order]
        return out

    @staticmethod
    def numbers(names: pa.Array, known: pa.Array) -> np.ndarray:
        """Places of names, -1 for those that aren't known."""
        return pc.fill_null(pc.index_in(names, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.zeros(0, np.int64)

    def step(self, states: np.ndarray, activities: np.ndarray) -> np.ndarray:
        """The state after each activity."""
        key = activities * len(self.states) + states
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (states >= 0) & (activities >= 0) & (self.keys[at] == key)
        return np.where(known, self.targets[at], -1)

    def sources(self, activity: int) -> np.ndarray:
        """States that an activity leads somewhere from."""
        n = len(self.states)
        low, high = np.searchsorted(self.keys, [activity * n, (activity + 1) * n])
        return self.keys[low:high] - activity * n if activity >= 0 else self.keys[:0]

    def composed(self, states: np.ndarray, activities: np.ndarray) -> np.ndarray:
        """The states that ``activities``, one after the other, lead to; states that meet are walked once."""
        own = np.arange(len(states))
        for a in activities:
            states, met = np.unique(self.step(states, np.full(len(states), a)), return_inverse=True)
            own = met[own]
        return states[own]


def _lists(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All activities of a batch of blocks, and where each block begins and how many it has."""
    lengths = pc.list_value_length(batch.column("steps")).to_numpy(zero_copy_only=False).astype(np.int64)
    return batch.column("steps").flatten(), np.cumsum(lengths) - lengths, lengths


def _block_maps(blocks: DataFrame, shared, initial: str) -> DataFrame:
    """(case_id, i, s, t): where each block leads, from the states that its first activity leads somewhere; from ``initial`` in first blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        first = known.numbers(pa.array([initial]), known.states)
        parts, size = [], 0

        def rows() -> pa.RecordBatch:
            row, s, t = (np.concatenate(x) for x in zip(*[p[2:] for p in parts], strict=True))
            cases, at = pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.int64())
            owner = pa.array(np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts]) if len(row) else row)
            return pa.RecordBatch.from_arrays([cases.take(owner), at.take(owner), known.states.take(pa.array(s)), known.states.take(pa.array(t))], ["case_id", "i", "s", "t"])

        for batch in batches:
            names, begins, lengths = _lists(batch)
            codes = known.numbers(names, known.activities)
            for case, i, begin, n in zip(batch.column("case_id").to_pylist(), batch.column("b").to_pylist(), begins, lengths, strict=True):
                s = known.sources(codes[begin]) if i else first
                t = known.composed(s, codes[begin : begin + n])
                s, t = s[t >= 0], t[t >= 0]
                parts.append((case, i, np.full(len(s), i), s, t))
                size += len(s) + 1
                if size >= PART:
                    yield rows()
                    parts, size = [], 0
        if parts:
            yield rows()

    return blocks.select("case_id", "b", "steps").mapInArrow(run, "case_id string, i long, s string, t string")


def _folded(blocks: DataFrame, shared, block: int) -> DataFrame:
    """(case_id, pos, activity, state) of all events, from the state ``at`` before each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            names, begins, lengths = _lists(batch)
            codes = known.numbers(names, known.activities)
            current = known.numbers(batch.column("at"), known.states)
            before = np.full(len(codes), -1, np.int64)
            longest_first = np.argsort(-lengths, kind="stable")
            for k in range(lengths.max(initial=0)):
                rows = longest_first[: np.count_nonzero(lengths > k)]
                at = begins[rows] + k
                before[at] = current[rows]
                current[rows] = known.step(current[rows], codes[at])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            pos = batch.column("b").to_numpy()[owner] * block + np.arange(len(codes)) - begins[owner]
            states = known.states.take(pa.array(before, mask=before < 0))
            yield pa.RecordBatch.from_arrays([batch.column("case_id").take(pa.array(owner)), pa.array(pos), names, states], ["case_id", "pos", "activity", "state"])

    return blocks.select("case_id", "b", "at", "steps").mapInArrow(run, "case_id string, pos long, activity string, state string")


def starting_states(maps: DataFrame, initial: str, longest: int) -> DataFrame:
    """(case_id, i, at): the state before every element of each case that has one.

    ``maps`` (case_id, i, s, t) has for each element 0, 1, ... ``longest`` at most the pairs of states that it leads from and to.
    """
    levels = [written(maps, "automaton")]  # each level is half as long as the one before; written, so that none is worked out twice
    while longest >> len(levels):
        half = levels[-1].withColumns({"_half": F.floor(F.col("i") / 2).cast("bigint"), "_right": F.col("i") % 2 == 1})
        left = half.filter(~F.col("_right")).select("case_id", "_half", "s", F.col("t").alias("_mid"))
        right = half.filter("_right").select("case_id", "_half", F.col("s").alias("_mid"), "t")
        maps = left.join(right, ["case_id", "_half", "_mid"]).select("case_id", F.col("_half").alias("i"), "s", "t")
        levels.append(written(maps, "automaton"))
    starts = levels[0].filter("i = 0").select("case_id").distinct().select("case_id", F.lit(0).cast("bigint").alias("i"), F.lit(initial).alias("at"))
    for level in reversed(levels):
        left = level.filter("i % 2 = 0").select("case_id", (F.col("i") / 2).cast("bigint").alias("i"), F.col("s").alias("at"), "t")
        children = F.array(F.struct((F.col("i") * 2).alias("i"), F.col("at").alias("at")), F.struct((F.col("i") * 2 + 1).alias("i"), F.col("t").alias("at")))
        starts = starts.join(left, ["case_id", "i", "at"], "left").select("case_id", F.explode(children).alias("_c")).select("case_id", "_c.*").filter("at IS NOT NULL")
    return starts


def walk_automaton(log: DataFrame, table: DataFrame, initial: str, *, block: int = BLOCK, most: int = MOST_TRANSITIONS) -> DataFrame:
    """State before every event and its distribution; no state once a step is missing.

    ``table`` has (state, activity, next_state, prob); a STOP row has no next state, and a next state without rows of its own is none. Of
    several next states of one activity the first by name counts. Up to ``most`` transitions are sent to every task.
    """
    states = table.select("state").distinct()
    if states.filter(F.col("state") == initial).isEmpty():
        raise ValueError(f"the automaton has no state {initial!r}")
    steps = table.join(states.select(F.col("state").alias("next_state")), "next_state", "left_semi")
    steps = steps.groupBy("state", "activity").agg(F.min("next_state").alias("next_state"))
    rows = positioned(log)
    listed = steps.limit(most + 1).toArrow()
    if listed.num_rows > most:
        walked = _walked_by_joins(rows, steps, initial)
    elif listed.num_rows == 0:
        walked = rows.select("case_id", "pos", "activity", F.when(F.col("pos") == 0, F.lit(initial)).alias("state"))
    else:
        walked = _walked_by_blocks(rows, Transitions.of(listed), initial, block)
    dists = table.groupBy("state").agg(F.collect_list(F.struct("activity", "prob")).cast(DIST).alias("dist"))
    return walked.join(dists, "state", "left").select("case_id", "pos", "activity", "state", "dist")


def _walked_by_blocks(rows: DataFrame, transitions: Transitions, initial: str, block: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(transitions)
    cut = F.floor(F.col("pos") / block).cast("bigint")
    steps = F.transform(F.sort_array(F.collect_list(F.struct("pos", "activity"))), lambda x: x["activity"])
    blocks = rows.groupBy("case_id", cut.alias("b")).agg(steps.alias("steps"))
    longest = rows.agg(F.max(cut)).first()[0] or 0
    if longest == 0:
        return _folded(blocks.withColumn("at", F.lit(initial)), shared, block)
    long = rows.filter(F.col("case_len") > block).groupBy("case_id", cut.alias("b")).agg(steps.alias("steps"))
    starts = starting_states(_block_maps(long, shared, initial), initial, longest)
    at = F.when(F.col("b") == 0, F.lit(initial)).otherwise(F.col("at"))
    return _folded(blocks.join(starts.withColumnRenamed("i", "b"), ["case_id", "b"], "left").withColumn("at", at), shared, block)


def _walked_by_joins(rows: DataFrame, steps: DataFrame, initial: str) -> DataFrame:
    longest = rows.agg(F.max("pos")).first()[0] or 0
    named = case_lookback(rows, "activity", 1, "_before").select("case_id", "pos", "activity", F.get("_before", F.lit(0)).alias("_previous"))
    entered = steps.select(F.col("activity").alias("_previous"), F.col("next_state").alias("state")).distinct()
    pairs = entered.join(steps, "state").select("_previous", "activity", F.col("state").alias("s"), F.col("next_state").alias("t"))
    first = steps.filter(F.col("state") == initial).select("activity", F.col("state").alias("s"), F.col("next_state").alias("t"))
    maps = named.filter("pos = 0").join(first, "activity").select("case_id", "pos", "s", "t")
    maps = maps.unionByName(named.filter("pos > 0").join(pairs, ["_previous", "activity"]).select("case_id", "pos", "s", "t"))
    starts = starting_states(maps.withColumnRenamed("pos", "i"), initial, longest).withColumnsRenamed({"i": "pos", "at": "_at"})
    state = F.when(F.col("pos") == 0, F.lit(initial)).otherwise(F.col("_at"))
    return rows.select("case_id", "pos", "activity").join(starts, ["case_id", "pos"], "left").select("case_id", "pos", "activity", state.alias("state"))
