"""Small column helpers: keys, timestamps, durations, pseudo-random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Separator of composite keys, fallback timestamp layout, text of durations.
KEY_SEPARATOR = ", "
SLASH_TIMESTAMP = "yyyy/MM/dd HH:mm:ss.SSS"
DURATION_TEXT = "%dd %02dh %02dm %02ds"


def composite_key(columns: list[str]) -> Column:
    """One string from one or several columns."""
    return F.concat_ws(KEY_SEPARATOR, *[F.col(f"`{c}`").cast("string") for c in columns])


def parse_timestamp(text: Column) -> Column:
    """ISO-8601 first, then the slash layout, else null.  Text without a zone is read in the session zone."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit(SLASH_TIMESTAMP)))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1_000_000.0)


def duration_text(seconds: Column) -> Column:
    """``1d 02h 03m 04s`` from seconds, floored like a day/second pair (negative durations have negative days)."""
    days = F.floor(seconds / 86400)
    rest = F.floor(seconds - days * 86400)
    return F.when(
        seconds.isNotNull(),
        F.format_string(
            DURATION_TEXT,
            days.cast("int"),
            F.floor(rest / 3600).cast("int"),
            F.floor(rest % 3600 / 60).cast("int"),
            (rest % 60).cast("int"),
        ),
    )


def hash_order(column: Column, seed: int | str) -> Column:
    """A reproducible pseudo-random order key: md5 of the value and a seed."""
    return F.md5(F.concat(column.cast("string"), F.lit(f"#{seed}")))


def hash_uniform(column: Column, seed: int | str) -> Column:
    """A reproducible uniform number in [0, 1) from the first 32 bits of :func:`hash_order`."""
    return F.conv(F.substring(hash_order(column, seed), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def joined(array: Column, separator: str = "|") -> Column:
    """Array as text, for sinks and reports."""
    return F.array_join(array, separator)


def literal(value) -> Column:
    """A literal for a driver value, rows included."""
    if hasattr(value, "asDict"):
        return F.struct(*[F.lit(v).alias(n) for n, v in value.asDict().items()])
    return F.lit(value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
