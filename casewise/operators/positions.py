"""Positions inside cases: the one shuffle by case that everything else builds on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.ordering import UNBOUNDED, cut_hot_keys, lookback, running


def split_of(df: DataFrame) -> str | None:
    return "split" if "split" in df.columns else None


def case_parts(df: DataFrame) -> list[str]:
    """Columns that keep one case (or one piece of a very long case) together."""
    return ["case_id", "split"] if split_of(df) else ["case_id"]


def case_order(df: DataFrame) -> list[str]:
    """Order inside a case: ``seq`` while it is there, since the rows are already sorted by it, else ``pos``."""
    return ["seq"] if "seq" in df.columns else ["pos"]


def positioned(log: DataFrame, *, cut: bool = True) -> DataFrame:
    """Add ``pos`` (0-based place in the case), ``case_len``, ``case_seq`` and ``case_chunk`` (order of its first event).

    A case above the hot-key limit is cut along ``chunk``; its pieces keep a ``split`` column so that later windows
    stay small, and only such cases pay for the second, tiny aggregation. ``cut=False`` is for logs known to have none.
    """
    if "pos" in log.columns:
        return log
    log = cut_hot_keys(log, ["case_id"]) if cut else log
    parts = case_parts(log)
    ordered = Window.partitionBy(*parts).orderBy("seq")
    whole = Window.partitionBy(*parts)
    log = log.withColumns(
        {
            "pos": F.row_number().over(ordered).cast("bigint") - 1,
            "case_len": F.count(F.lit(1)).over(whole),
            "case_seq": F.min("seq").over(whole),
            "case_chunk": F.min("chunk").over(whole),
        }
    )
    if not split_of(log):
        return log

    pieces = (
        log.filter(F.col("split").isNotNull())
        .groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_s"), F.min("chunk").alias("_k"))
    )
    case = Window.partitionBy("case_id")
    earlier = case.orderBy("split").rowsBetween(UNBOUNDED, -1)
    carry = pieces.select(
        *parts,
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
        F.sum("_n").over(case).alias("_tot"),
        F.min("_s").over(case).alias("_seq"),
        F.min("_k").over(case).alias("_chunk"),
    )
    return (
        log.join(carry, parts, "left")
        .withColumns(
            {
                "pos": F.col("pos") + F.coalesce(F.col("_off"), F.lit(0)),
                "case_len": F.coalesce(F.col("_tot"), F.col("case_len")),
                "case_seq": F.coalesce(F.col("_seq"), F.col("case_seq")),
                "case_chunk": F.coalesce(F.col("_chunk"), F.col("case_chunk")),
            }
        )
        .drop("_off", "_tot", "_seq", "_chunk")
    )


def case_lookback(plog: DataFrame, value: str, n: int, name: str, *, inclusive: bool = False) -> DataFrame:
    """Last ``n`` earlier values of ``value`` in the case."""
    return lookback(plog, ["case_id"], case_order(plog), value, n, name, inclusive=inclusive, split=split_of(plog))


def case_running(plog: DataFrame, folds: dict[str, tuple[str, Column]], *, inclusive: bool = False) -> DataFrame:
    """Running folds along each case."""
    return running(plog, ["case_id"], case_order(plog), folds, inclusive=inclusive, split=split_of(plog))


def previous_ts(plog: DataFrame, name: str = "prev_ts") -> DataFrame:
    """Add the latest non-null ``ts`` of earlier events of the case, in case order."""
    parts = case_parts(plog)
    frame = Window.partitionBy(*parts).orderBy(*case_order(plog)).rowsBetween(UNBOUNDED, -1)
    plog = plog.withColumn(name, F.last("ts", ignorenulls=True).over(frame))
    if not split_of(plog):
        return plog
    pieces = (
        plog.filter(F.col("split").isNotNull() & F.col("ts").isNotNull())
        .groupBy(*parts)
        .agg(F.max_by("ts", "pos").alias("_t"))
    )
    # a piece may hold no timestamp at all, so the carry is kept for every piece
    all_pieces = plog.filter(F.col("split").isNotNull()).select(*parts).distinct().join(pieces, parts, "left")
    earlier = Window.partitionBy("case_id").orderBy("split").rowsBetween(UNBOUNDED, -1)
    carry = all_pieces.select(*parts, F.last("_t", ignorenulls=True).over(earlier).alias("_prev"))
    return (
        plog.join(carry, parts, "left").withColumn(name, F.coalesce(F.col(name), F.col("_prev"))).drop("_prev")
    )


def case_table(log: DataFrame) -> DataFrame:
    """One row per case: length, order and chunk of the first and last event (map-side combined)."""
    return log.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("case_len"),
        F.min("seq").alias("case_seq"),
        F.max("seq").alias("last_seq"),
        F.min("chunk").alias("case_chunk"),
        F.max("chunk").alias("last_chunk"),
    )
