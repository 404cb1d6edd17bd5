"""Log preparation: sequences, START/STOP rows, splits, samples, prefixes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import START, STOP
from casewise.functions.ordering import add_index, kth_smallest, running_total
from casewise.functions.values import hash_order, hash_uniform, literal
from casewise.operators.positions import case_lookback, case_table, positioned, split_of

#: ranges of a uniform number that are sorted one by one
VALUE_RANGES = 1 << 20


def case_sequences(log: DataFrame) -> DataFrame:
    """One row per case with its activities in order.

    Arrays hold whole cases, so this is for logs of bounded case length.
    """
    plog = positioned(log)
    return plog.groupBy("case_id").agg(
        F.min("case_seq").alias("case_seq"),
        F.min("case_chunk").alias("case_chunk"),
        F.sort_array(F.collect_list(F.struct("pos", "activity")))["activity"].alias("activities"),
    )


def add_start(log: DataFrame, symbol: str = START) -> DataFrame:
    """A row with null time at position 0 of every case; the other positions move up by one."""
    plog = positioned(log)
    first = F.col("pos") == 0
    event = F.struct((F.col("pos") + 1).alias("pos"), F.col("activity").alias("activity"), F.col("ts").alias("ts"))
    start = F.struct(
        F.lit(0).cast("bigint").alias("pos"), F.lit(symbol).alias("activity"), F.lit(None).cast("timestamp").alias("ts")
    )
    return _emit(plog, F.when(first, F.array(start, event)).otherwise(F.array(event)))


def add_stop(log: DataFrame, symbol: str = STOP) -> DataFrame:
    """A row with null time after the last event of every case."""
    plog = positioned(log)
    event = F.struct(F.col("pos").alias("pos"), F.col("activity").alias("activity"), F.col("ts").alias("ts"))
    stop = F.struct(
        (F.col("pos") + 1).alias("pos"), F.lit(symbol).alias("activity"), F.lit(None).cast("timestamp").alias("ts")
    )
    return _emit(plog, F.when(F.col("pos") == F.col("case_len") - 1, F.array(event, stop)).otherwise(F.array(event)))


def _emit(plog: DataFrame, rows: Column) -> DataFrame:
    out = plog.withColumn("_row", F.explode(rows))
    return out.withColumns(
        {
            "pos": F.col("_row.pos"),
            "activity": F.col("_row.activity"),
            "ts": F.col("_row.ts"),
            "seq": F.struct("seq", F.col("_row.pos").alias("pos")),
            "case_len": F.col("case_len") + 1,
        }
    ).drop("_row")


# --------------------------------------------------------------------------------------------------------------
# splits and samples
# --------------------------------------------------------------------------------------------------------------


def _exact(share: float | Decimal) -> Decimal:
    """A share as it is written: 0.7 is seven tenths, so that 0.7 of 90,000 cases is 63,000 and not one less."""
    return Decimal(str(share))


def _share_of_cases(share: Decimal) -> Column:
    """``floor(n * share)`` without rounding before the cut."""
    return F.floor(F.col("n") * F.lit(share)).cast("bigint")


def _hash_edge(log: DataFrame, k: Column, seed: int | str) -> Column:
    """The test that a case is among the first ``k`` of ``n`` cases in hash order."""
    key = hash_order(F.col("case_id"), seed)
    cases = log.select("case_id").distinct().select(key.alias("_key"))
    edge = kth_smallest(cases, "_key", k, F.conv(F.substring("_key", 1, 4), 16, 10).cast("bigint"))
    return F.lit(False) if edge is None else key <= F.lit(edge)


def _arrival_edge(log: DataFrame, k: Column) -> Column:
    """The test that the case of a positioned event is among the first ``k`` of ``n`` cases in arrival order."""
    edge = kth_smallest(case_table(log), "case_seq", k, F.col("case_chunk"))
    return F.lit(False) if edge is None else F.col("case_seq") <= literal(edge)


def split_cases(
    log: DataFrame, test_size: float | Decimal = 0.2, *, shuffle: bool = False, seed: int | str = 0
) -> tuple[DataFrame, DataFrame]:
    """Train and test part: the first ``floor(n * (1 - test_size))`` cases, in arrival or in shuffled order.

    No event is joined to a case table: the key of the last training case is found once and the events are filtered
    against that one value.  The shuffled split therefore needs no shuffle of events at all.
    """
    k = _share_of_cases(1 - _exact(test_size))
    if shuffle:
        rows = log
        in_train = _hash_edge(log, k, seed)
    else:
        rows = positioned(log)
        in_train = _arrival_edge(log, k)
    return rows.filter(in_train), rows.filter(~in_train)


def split_three_way(
    log: DataFrame, test_size: float = 0.3, validation_share: float = 0.5, *, seed: int | str = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shuffled train, validation and test parts: cut off ``test_size``, then cut that part again.

    The second cut takes its own shuffle, so validation and test are both random parts of what was held out.
    """
    train, held_out = split_cases(log, test_size, shuffle=True, seed=seed)
    validation, test = split_cases(held_out, 1 - _exact(validation_share), shuffle=True, seed=f"{seed}b")
    return train, validation, test


def sample_cases(log: DataFrame, fraction: float, *, seed: int | str = 0) -> DataFrame:
    """``max(1, floor(n * fraction))`` whole cases, drawn without replacement by hash order."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    drawn = _hash_edge(log, F.greatest(F.lit(1).cast("bigint"), _share_of_cases(_exact(fraction))), seed)
    return log.filter(drawn)


def head_cases(log: DataFrame, fraction: float) -> DataFrame:
    """The first ``floor(n * fraction)`` cases in arrival order."""
    return positioned(log).filter(_arrival_edge(log, _share_of_cases(_exact(fraction))))


def filter_cases_by_length(log: DataFrame, length: int, mode: str = "greater") -> DataFrame:
    plog = positioned(log)
    tests = {
        "greater": F.col("case_len") > length,
        "lower": F.col("case_len") < length,
        "equal": F.col("case_len") == length,
    }
    if mode not in tests:
        raise ValueError(f"mode must be one of {sorted(tests)}")
    return plog.filter(tests[mode])


# --------------------------------------------------------------------------------------------------------------
# order and encoding
# --------------------------------------------------------------------------------------------------------------


def evaluation_index(frame: DataFrame, name: str = "index", start: int = 1) -> DataFrame:
    """Index rows by (case order, position): events of a case stay together, cases in arrival order.

    The offset of a case comes from the table of cases, so no window spans more than one chunk of cases.
    """
    cases = frame.groupBy("case_id", "case_seq", "case_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_total(cases, ["case_seq"], {"_off": F.col("_n")}, inclusive=False, chunk="case_chunk")
    return (
        frame.join(offsets.select("case_id", "_off"), "case_id")
        .withColumn(name, F.col("_off") + F.col("pos") + start)
        .drop("_off")
    )


def interleave(log: DataFrame, *, mix: bool = True, seed: int | str = 0) -> DataFrame:
    """A new global order that keeps the order inside every case.

    Concatenation puts case after case.  Mixing draws one sortable number per event, sorts the draws of each case and
    hands them out in position order, so that cases interleave at random; ties fall back to the old order.
    """
    plog = positioned(log)
    if not mix:
        return evaluation_index(plog, "index")
    draw = hash_uniform(F.concat_ws("#", "case_id", "pos"), seed)
    hot = F.col("split").isNotNull() if split_of(plog) else F.lit(False)
    draws = plog.select("case_id", "pos", draw.alias("draw"), hot.alias("_hot"))
    # the i-th smallest draw of the case; the draws of a very long case are sorted in narrow value ranges
    bucket = F.when(F.col("_hot"), F.floor(F.col("draw") * VALUE_RANGES)).otherwise(F.lit(0))
    ranked = running_total(
        draws.withColumn("_bucket", bucket),
        ["draw", "pos"],
        {"_rank": F.lit(1).cast("bigint")},
        chunk="_bucket",
        within=["case_id"],
    ).select("case_id", (F.col("_rank") - 1).alias("pos"), "draw")
    mixed = plog.join(ranked, ["case_id", "pos"]).withColumn("_chunk", F.floor(F.col("draw") * VALUE_RANGES))
    return add_index(mixed, ["draw", "case_id", "pos"], chunk="_chunk").drop("_chunk", "draw")


def tag_input(log: DataFrame, symbol: str) -> DataFrame:
    return log.withColumn("tagged", F.struct(F.lit(symbol).alias("input"), F.col("activity").alias("activity")))


def activity_index(log: DataFrame) -> DataFrame:
    """Dense index of activities by first occurrence, from 1 (0 is padding); one row per activity."""
    firsts = log.groupBy("activity").agg(F.min("seq").alias("first_seq"), F.min("chunk").alias("_chunk"))
    return add_index(firsts, ["first_seq"], name="activity_idx", chunk="_chunk").drop("_chunk")


def encode(log: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Add ``activity_idx``; unknown activities get 0."""
    index = activity_index(log) if index is None else index
    joined = log.join(index.select("activity", "activity_idx"), "activity", "left")
    return joined.withColumn("activity_idx", F.coalesce(F.col("activity_idx"), F.lit(0)))


def prefix_windows(
    log: DataFrame, window: int, pad: str = "left", index: DataFrame | None = None, *, min_prefix: int = 1
) -> DataFrame:
    """One row per (prefix, next): the last ``window`` indices, zero-padded, and the target index."""
    if pad not in ("left", "right"):
        raise ValueError("pad must be 'left' or 'right'")
    rows = case_lookback(positioned(encode(log, index)), "activity_idx", window, "_x")
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(window) - F.size("_x"))
    x = F.concat(zeros, F.col("_x")) if pad == "left" else F.concat(F.col("_x"), zeros)
    return (
        rows.filter(F.col("pos") >= min_prefix)
        .withColumn("x", x)
        .withColumnRenamed("activity_idx", "y")
        .select("case_id", "case_seq", "pos", "x", "y")
    )


def padded_sequences(log: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Case → index array, right-padded with 0 to the longest case."""
    rows = positioned(encode(log, index))
    longest = case_table(log).agg(F.max("case_len").alias("n")).scalar()
    seqs = rows.groupBy("case_id").agg(
        F.min("case_seq").alias("case_seq"),
        F.sort_array(F.collect_list(F.struct("pos", "activity_idx")))["activity_idx"].alias("x"),
    )
    missing = (longest - F.size("x")).cast("int")
    return seqs.withColumn("x", F.concat(F.col("x"), F.array_repeat(F.lit(0).cast("bigint"), missing)))
