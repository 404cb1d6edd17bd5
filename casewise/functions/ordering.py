"""Running values over ordered data without ever putting a large group into one task.

Two situations occur all over the library:

* a value that runs along the *whole* log (an index, a running accuracy), and
* a value that runs along one key (a case, a model state) that may hold a third of all rows.

Both are solved the same way.  Rows carry ``chunk``, a coarse monotone bucket of their order key.  A value is
folded inside a chunk by a window, folded per chunk by a map-side-combined aggregation, and the (small) table of
earlier chunks is joined back as a carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of one key above which the key is cut along its chunks
HOT_ROWS = 1_000_000
#: rows of a dense order key that form one chunk
CHUNK_ROWS = 1 << 20

UNBOUNDED = Window.unboundedPreceding


def setting(df: DataFrame, name: str, default: int) -> int:
    """Session override ``casewise.<name>`` of a size limit."""
    return int(df.sparkSession.conf.get(f"casewise.{name}", str(default)))


# --------------------------------------------------------------------------------------------------------------
# folds
# --------------------------------------------------------------------------------------------------------------

_FOLD = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "xor": F.bit_xor,
    "set": F.collect_set,
}



def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if kind == "xor":
        return F.coalesce(local, F.lit(0)).bitwiseXOR(F.coalesce(carry, F.lit(0)))
    if kind == "min":
        return F.least(local, carry)
    if kind == "max":
        return F.greatest(local, carry)
    if kind == "set":
        empty = F.array().cast("array<string>")
        return F.array_union(F.coalesce(local, empty), F.coalesce(carry, empty))
    raise ValueError(f"unknown fold {kind!r}")


def _neutral(kind: str, local: Column) -> Column:
    return F.coalesce(local, F.lit(0)) if kind in ("sum", "xor") else local


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    folds: dict[str, tuple[str, Column]],
    *,
    inclusive: bool = False,
    split: str | None = None,
) -> DataFrame:
    """Add running folds per key in ``order``.

    ``split`` names a column that cuts long keys into consecutive pieces; rows with a null ``split`` belong to a
    key that is not cut and need no carry.  ``split`` must grow with ``order`` inside a key.
    """
    parts = [*keys, split] if split else keys
    frame = Window.partitionBy(*parts).orderBy(*order).rowsBetween(UNBOUNDED, 0 if inclusive else -1)
    if not split:
        return df.withColumns({n: _neutral(k, _FOLD[k](c).over(frame)) for n, (k, c) in folds.items()})

    local = df.withColumns({f"_l_{n}": _FOLD[k](c).over(frame) for n, (k, c) in folds.items()})
    per_piece = (
        df.filter(F.col(split).isNotNull())
        .groupBy(*parts)
        .agg(*[_FOLD[k](c).alias(f"_p_{n}") for n, (k, c) in folds.items()])
    )
    earlier = Window.partitionBy(*keys).orderBy(split).rowsBetween(UNBOUNDED, -1)
    carry = per_piece.select(
        *parts,
        *[
            F.array_distinct(F.flatten(F.collect_list(f"_p_{n}").over(earlier))).alias(f"_c_{n}")
            if k == "set"
            else _FOLD[k](f"_p_{n}").over(earlier).alias(f"_c_{n}")
            for n, (k, _) in folds.items()
        ],
    )
    joined = local.join(carry, parts, "left")
    return joined.withColumns(
        {n: _combine(k, F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n, (k, _) in folds.items()}
    ).drop(*[f"_{t}_{n}" for t in "lc" for n in folds])


def lookback(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: str,
    n: int,
    name: str,
    *,
    inclusive: bool = False,
    split: str | None = None,
) -> DataFrame:
    """Add the array of the last ``n`` earlier values (oldest first); ``inclusive`` appends the row's own value.

    The carry into a piece is at most ``n`` values taken from at most ``n`` earlier pieces, so every array and
    every group stays bounded by ``n`` no matter how long the key is.
    """
    parts = [*keys, split] if split else keys
    frame = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-n, 0 if inclusive else -1)
    if n == 0 and not inclusive:
        return df.withColumn(name, F.array().cast(f"array<{dict(df.dtypes)[value]}>"))
    if not split:
        return df.withColumn(name, F.collect_list(value).over(frame))

    local = df.withColumn("_own", F.collect_list(value).over(frame))
    if n == 0:
        return local.withColumnRenamed("_own", name)
    newest = Window.partitionBy(*parts).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        df.filter(F.col(split).isNotNull())
        .select(*parts, *[c for c in order if c not in parts], value)
        .withColumn("_r", F.row_number().over(newest))
        .filter(F.col("_r") <= n)
        .groupBy(*parts)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))).alias("_t"))
        .withColumn("_t", F.col("_t.v"))
    )
    earlier = Window.partitionBy(*keys).orderBy(split).rowsBetween(-n, -1)
    carry = tails.select(*parts, F.flatten(F.collect_list("_t").over(earlier)).alias("_carry"))
    empty = F.array().cast(f"array<{dict(df.dtypes)[value]}>")
    both = F.concat(F.coalesce(F.col("_carry"), empty), F.col("_own"))
    keep = F.least(F.size(both), F.lit(n + 1 if inclusive else n))
    return (
        local.join(carry, parts, "left")
        .withColumn("_both", both)
        .withColumn(name, F.when(keep == 0, empty).otherwise(F.slice("_both", F.size("_both") - keep + 1, keep)))
        .drop("_both", "_carry", "_own")
    )


# --------------------------------------------------------------------------------------------------------------
# hot keys
# --------------------------------------------------------------------------------------------------------------


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys with more than ``casewise.hotRows`` rows, or None when there are none.

    The table has at most ``rows / hotRows`` entries, which bounds what may be broadcast.  The check is one
    map-side-combined count over the key columns only.
    """
    limit = setting(df, "hotRows", HOT_ROWS)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    return None if hot.isEmpty() else hot


def cut_hot_keys(df: DataFrame, keys: list[str], split: str = "split", chunk: str = "chunk") -> DataFrame:
    """Add ``split`` (the chunk for rows of hot keys, else null) if any hot key exists; otherwise return ``df``."""
    hot = hot_keys(df, keys)
    if hot is None:
        return df
    flagged = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    return flagged.withColumn(split, F.when(F.col("_hot"), F.col(chunk))).drop("_hot")


# --------------------------------------------------------------------------------------------------------------
# whole-log order
# --------------------------------------------------------------------------------------------------------------


def running_total(
    df: DataFrame,
    order: list[str],
    sums: dict[str, Column],
    *,
    inclusive: bool = True,
    chunk: str = "chunk",
    within: list[str] | None = None,
) -> DataFrame:
    """Add running sums along the whole table (or along each ``within`` key) in ``order``."""
    keys = within or []
    parts = [*keys, chunk]
    frame = Window.partitionBy(*parts).orderBy(*order).rowsBetween(UNBOUNDED, 0 if inclusive else -1)
    totals = df.groupBy(*parts).agg(*[F.sum(c).alias(f"_p_{n}") for n, c in sums.items()])
    # one row per chunk, so the window without a key sees rows / chunkRows rows
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(chunk).rowsBetween(UNBOUNDED, -1)
    carry = totals.select(*parts, *[F.sum(f"_p_{n}").over(earlier).alias(f"_c_{n}") for n in sums])
    local = df.withColumns({f"_l_{n}": F.sum(c).over(frame) for n, c in sums.items()})
    return (
        local.join(carry, parts, "left")
        .withColumns({n: _combine("sum", F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in sums})
        .drop(*[f"_{t}_{n}" for t in "lc" for n in sums])
    )


def add_index(df: DataFrame, order: list[str], *, start: int = 1, name: str = "index", chunk: str = "chunk") -> DataFrame:
    """Dense running index of the whole table in ``order``."""
    indexed = running_total(df, order, {name: F.lit(1).cast("bigint")}, chunk=chunk)
    return indexed.withColumn(name, F.col(name) + (start - 1))


def kth_smallest(df: DataFrame, key: str, k: Column, chunk: Column):
    """The ``k``-th smallest ``key`` (1-based) as a driver value, or None if there are fewer rows.

    ``k`` may refer to ``n``, the number of rows.  Only the chunk in which the answer lies is ranked, and one value
    comes back, so filters against it are plain literals that reach the scan.
    """
    rows = df.select(F.col(key), chunk.alias("_chunk"))
    counts = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    table = Window.partitionBy(F.lit(0))
    spot = (
        counts.withColumn("_upto", F.sum("_n").over(table.orderBy("_chunk")))
        .withColumn("n", F.sum("_n").over(table))
        .withColumn("_k", k)
        .filter((F.col("_k") > F.col("_upto") - F.col("_n")) & (F.col("_k") <= F.col("_upto")))
        .select("_chunk", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_rank"))
        .first()
    )
    if spot is None:
        return None
    inside = rows.filter(F.col("_chunk") == spot["_chunk"]).select(key)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(key))
    return inside.withColumn("_r", rank).filter(F.col("_r") == spot["_rank"]).first()[0]
