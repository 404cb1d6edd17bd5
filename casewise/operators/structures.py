"""State functions: what a model remembers of a case.

A structure turns the events of a case into the state before and after each event, as plain columns of the positioned
log.  All structures share the shuffle by case, so any number of them costs one pass.  A new structure needs only a
``columns`` method that returns the log with two more columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.ordering import running
from casewise.functions.values import joined
from casewise.operators.positions import case_lookback, case_running, positioned, split_of


class Structure(Protocol):
    """What :func:`annotate` needs of a structure."""

    #: a state is valid only if every earlier step of the case was seen in training
    sticky: bool

    def columns(self, plog: DataFrame, state: str, after: str) -> DataFrame: ...

    def level(self, state: Column) -> Column: ...

    def label(self, state: Column) -> Column: ...

    def initial(self) -> Column: ...

    def pack(self, state: Column) -> Column: ...

    def unpack(self, packed: Column) -> Column: ...


NO_STRINGS = "array<string>"


def packed_state(items: Column | None = None, level: Column | None = None, a: Column | None = None, b: Column | None = None) -> Column:
    """The one type that holds the states of all structures, so that models can share a table."""
    zero = F.lit(0).cast("bigint")
    return F.struct(
        (F.array().cast(NO_STRINGS) if items is None else items).alias("items"),
        (zero if level is None else level).alias("level"),
        (zero if a is None else a).alias("a"),
        (zero if b is None else b).alias("b"),
    )


@dataclass(frozen=True)
class NGram:
    """The last ``window`` activities."""

    window: int = 1

    @property
    def sticky(self) -> bool:
        return self.window == 0

    def columns(self, plog: DataFrame, state: str, after: str) -> DataFrame:
        history = "_history"
        if history not in plog.columns:
            plog = case_lookback(plog, "activity", self.window, history, inclusive=True)
        n = F.size(history)
        before = F.least(F.lit(self.window), n - 1)
        kept = F.least(F.lit(self.window), n)
        return plog.withColumns(
            {state: F.slice(history, n - before, before), after: F.slice(history, n - kept + 1, kept)}
        )

    def level(self, state: Column) -> Column:
        return F.size(state)

    def label(self, state: Column) -> Column:
        return joined(state)

    def initial(self) -> Column:
        return F.array().cast(NO_STRINGS)

    def pack(self, state: Column) -> Column:
        return packed_state(items=state)

    def unpack(self, packed: Column) -> Column:
        return packed["items"]


@dataclass(frozen=True)
class PrefixTree:
    """The whole prefix, as its length and two 64-bit fingerprints of (position, activity) pairs.

    A fingerprint is an exclusive-or, so it runs along a case in constant space and pieces of a long case combine.
    """

    sticky = False

    def columns(self, plog: DataFrame, state: str, after: str) -> DataFrame:
        a = F.xxhash64(F.lit(1), F.col("pos"), F.col("activity"))
        b = F.xxhash64(F.lit(2), F.col("activity"), F.col("pos"))
        plog = case_running(plog, {"_a": ("xor", a), "_b": ("xor", b)})
        return plog.withColumns(
            {
                state: _fingerprint(F.col("pos"), F.col("_a"), F.col("_b")),
                after: _fingerprint(F.col("pos") + 1, F.col("_a").bitwiseXOR(a), F.col("_b").bitwiseXOR(b)),
            }
        ).drop("_a", "_b")

    def level(self, state: Column) -> Column:
        return state["level"].cast("int")

    def label(self, state: Column) -> Column:
        return F.concat_ws(":", state["level"].cast("string"), F.hex(state["a"]), F.hex(state["b"]))

    def initial(self) -> Column:
        zero = F.lit(0).cast("bigint")
        return _fingerprint(zero, zero, zero)

    def pack(self, state: Column) -> Column:
        return packed_state(level=state["level"], a=state["a"], b=state["b"])

    def unpack(self, packed: Column) -> Column:
        return _fingerprint(packed["level"], packed["a"], packed["b"])


def _fingerprint(level: Column, a: Column, b: Column) -> Column:
    return F.struct(level.alias("level"), a.alias("a"), b.alias("b"))


@dataclass(frozen=True)
class Bag:
    """The set of activities so far."""

    sticky = True

    def columns(self, plog: DataFrame, state: str, after: str) -> DataFrame:
        plog = case_running(plog, {"_set": ("set", F.col("activity"))})
        return plog.withColumns(
            {
                state: F.sort_array("_set"),
                after: F.sort_array(F.array_union(F.col("_set"), F.array("activity"))),
            }
        ).drop("_set")

    def level(self, state: Column) -> Column:
        return F.lit(None).cast("int")

    def label(self, state: Column) -> Column:
        return joined(state)

    def initial(self) -> Column:
        return F.array().cast(NO_STRINGS)

    def pack(self, state: Column) -> Column:
        return packed_state(items=state)

    def unpack(self, packed: Column) -> Column:
        return packed["items"]


@dataclass(frozen=True)
class Parikh:
    """How often each activity occurred so far, optionally capped.

    The counts are kept as two fingerprints over (activity, occurrence number) pairs: order does not matter and an
    occurrence beyond the cap adds nothing.
    """

    upper_bound: int | None = None
    sticky = True

    def columns(self, plog: DataFrame, state: str, after: str) -> DataFrame:
        plog = running(
            plog, ["case_id", "activity"], ["pos"], {"_nth": ("sum", F.lit(1).cast("bigint"))}, split=split_of(plog)
        )
        counted = F.lit(True) if self.upper_bound is None else F.col("_nth") < self.upper_bound
        a = F.when(counted, F.xxhash64(F.lit(3), F.col("activity"), F.col("_nth"))).otherwise(F.lit(0).cast("bigint"))
        b = F.when(counted, F.xxhash64(F.lit(4), F.col("_nth"), F.col("activity"))).otherwise(F.lit(0).cast("bigint"))
        plog = plog.withColumns({"_ha": a, "_hb": b})
        plog = case_running(plog, {"_a": ("xor", F.col("_ha")), "_b": ("xor", F.col("_hb"))})
        return plog.withColumns(
            {
                state: F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")),
                after: F.struct(
                    F.col("_a").bitwiseXOR(F.col("_ha")).alias("a"), F.col("_b").bitwiseXOR(F.col("_hb")).alias("b")
                ),
            }
        ).drop("_nth", "_ha", "_hb", "_a", "_b")

    def level(self, state: Column) -> Column:
        return F.lit(None).cast("int")

    def label(self, state: Column) -> Column:
        return F.concat_ws(":", F.hex(state["a"]), F.hex(state["b"]))

    def initial(self) -> Column:
        zero = F.lit(0).cast("bigint")
        return F.struct(zero.alias("a"), zero.alias("b"))

    def pack(self, state: Column) -> Column:
        return packed_state(a=state["a"], b=state["b"])

    def unpack(self, packed: Column) -> Column:
        return F.struct(packed["a"].alias("a"), packed["b"].alias("b"))


def annotate(log: DataFrame, structures: dict[str, Structure]) -> DataFrame:
    """Add ``<name>`` (state before the event) and ``<name>_next`` for every named structure."""
    plog = positioned(log)
    windows = [s.window for s in structures.values() if isinstance(s, NGram)]
    if windows:
        plog = case_lookback(plog, "activity", max(windows), "_history", inclusive=True)
    made: dict[Structure, str] = {}
    for name, structure in structures.items():
        if structure in made:
            twin = made[structure]
            plog = plog.withColumns({name: F.col(twin), f"{name}_next": F.col(f"{twin}_next")})
        else:
            plog = structure.columns(plog, name, f"{name}_next")
            made[structure] = name
    return plog.drop("_history")


def with_stop_rows(annotated: DataFrame, names: list[str], stop: str) -> DataFrame:
    """Append the STOP row of every case: its state is the state after the last event.

    STOP has no place in the arrival order, so the rows are ordered by ``pos`` from here on.
    """
    here = {"pos": F.col("pos"), "activity": F.col("activity"), "ts": F.col("ts"), **{n: F.col(n) for n in names}}
    end = {
        "pos": F.col("pos") + 1,
        "activity": F.lit(stop),
        "ts": F.lit(None).cast("timestamp"),
        **{n: F.col(f"{n}_next") for n in names},
    }
    row = F.struct(*[c.alias(n) for n, c in here.items()])
    last = F.struct(*[c.alias(n) for n, c in end.items()])
    rows = F.when(F.col("pos") == F.col("case_len") - 1, F.array(row, last)).otherwise(F.array(row))
    dropped = {"seq", "chunk", *here}
    kept = [c for c in annotated.columns if c not in dropped and not (c.endswith("_next") and c[:-5] in names)]
    return annotated.select(*kept, F.explode(rows).alias("_row")).select(*kept, "_row.*")


def last_states(annotated: DataFrame, name: str) -> DataFrame:
    """Current state of every case: the state after its last event."""
    return annotated.filter(F.col("pos") == F.col("case_len") - 1).select("case_id", F.col(f"{name}_next").alias("state"))


__all__ = ["Bag", "NGram", "Parikh", "PrefixTree", "Structure", "annotate", "last_states", "with_stop_rows"]
