"""From any table to an event log.

An event log has one row per event::

    case_id STRING, activity STRING, ts TIMESTAMP NULL, seq <orderable>, chunk LONG, attributes MAP NULL

``seq`` is the arrival order and must be total.  ``chunk`` is any column that never decreases with ``seq`` and of
which one value holds a bounded number of rows; long cases and whole-log scans are cut along it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.functions.ordering import CHUNK_ROWS, setting
from casewise.functions.values import composite_key


def to_event_log(
    df: DataFrame,
    case_keys: list[str],
    activity_keys: list[str],
    *,
    seq: Column,
    ts: Column | None = None,
    chunk: Column | None = None,
    attributes: list[str] | None = None,
) -> DataFrame:
    """Map a table to the event-log columns; several key columns are joined by ``", "``.

    ``chunk`` may be left out when ``seq`` is a dense number.
    """
    if chunk is None:
        chunk = F.floor(seq / F.lit(setting(df, "chunkRows", CHUNK_ROWS)))
    columns = [
        composite_key(case_keys).alias("case_id"),
        composite_key(activity_keys).alias("activity"),
        (F.lit(None) if ts is None else ts).cast("timestamp").alias("ts"),
        seq.alias("seq"),
        chunk.cast("bigint").alias("chunk"),
    ]
    if attributes:
        pairs = [x for a in attributes for x in (F.lit(a), F.col(a).cast("string"))]
        columns.append(F.create_map(*pairs).alias("attributes"))
    return df.select(*columns)


def select_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keys])


#: what :func:`~casewise.operators.positions.positioned` adds; it holds for the log it was worked out on only
DERIVED = ("pos", "case_len", "case_seq", "case_chunk", "split")


def filter_events(df: DataFrame, predicate: Column | str) -> DataFrame:
    """The events that fulfil ``predicate``. Positions inside cases are dropped, since they no longer hold."""
    return df.filter(predicate).drop(*DERIVED)


def packed_order(major: Column, minor: Column, minor_span: int) -> Column:
    """A LONG that sorts like (major, minor); a ``minor`` outside ``0 .. minor_span - 1`` is an error."""
    packed = major.cast("bigint") * F.lit(minor_span).cast("bigint") + minor.cast("bigint")
    fits = F.coalesce(minor.between(0, minor_span - 1), F.lit(True))
    return F.when(fits, packed).otherwise(F.raise_error(F.lit(f"order key outside 0..{minor_span - 1}")))


# --------------------------------------------------------------------------------------------------------------
# bindings of the benchmark tables
# --------------------------------------------------------------------------------------------------------------

ORDER_KEY_SPAN = 10**13
TURN_SPAN = 10**6


def events_log(df: DataFrame) -> DataFrame:
    """Users as cases, event types as activities."""
    return to_event_log(df, ["user_id"], ["event_type"], seq=F.col("event_id"), ts=F.col("ts"))


def orders_log(df: DataFrame, *, with_priority: bool = False) -> DataFrame:
    """Customers as cases, order states (and priorities) as activities, in order of date and key."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    activity = ["o_orderstatus", "o_orderpriority"] if with_priority else ["o_orderstatus"]
    return to_event_log(
        df,
        ["o_custkey"],
        activity,
        seq=packed_order(day, F.col("o_orderkey"), ORDER_KEY_SPAN),
        ts=F.col("o_orderdate"),
        # a day, cut into ranges of the unique order key: never more than chunkRows rows
        chunk=packed_order(day, F.floor(F.col("o_orderkey") / setting(df, "chunkRows", CHUNK_ROWS)), ORDER_KEY_SPAN),
    )


def conversations_log(df: DataFrame) -> DataFrame:
    """Conversations as cases, roles as activities, no time."""
    seq = packed_order(F.col("conv_id"), F.col("turn"), TURN_SPAN)
    rows = setting(df, "chunkRows", CHUNK_ROWS)
    # a chunk is a run of turns of one conversation, or (for short ones) a run of conversations
    long_turns = F.floor(F.col("turn") / F.lit(min(rows, TURN_SPAN)))
    return to_event_log(
        df,
        ["conv_id"],
        ["role"],
        seq=seq,
        chunk=packed_order(F.floor(F.col("conv_id") / 4096), F.lit(0), TURN_SPAN)
        if rows >= TURN_SPAN
        else packed_order(F.col("conv_id"), long_turns, TURN_SPAN),
    )


def lineitem_log(df: DataFrame) -> DataFrame:
    """Orders as cases, flag and line state as activities.

    Line numbers repeat inside an order, so the order key ends with every column the log keeps: rows that still tie
    are equal in all respects.
    """
    seq = F.struct("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus")
    rows = setting(df, "chunkRows", CHUNK_ROWS)
    return to_event_log(
        df,
        ["l_orderkey"],
        ["l_returnflag", "l_linestatus"],
        seq=seq,
        ts=F.col("l_shipdate"),
        chunk=F.floor(F.col("l_orderkey") * 4 / F.lit(rows)),
    )
