"""Mixing sources to target weights by capped water-filling. DataFrame operations only.

Every source ``s`` holds ``size_s`` words and weighs ``w_s``. Its target is ``min(cap * size_s, level * w_s)``, where the
level makes all targets add up to the total wanted. A source above its cap is clamped there, and what it can't take is
shared again by weight among the rest, until none is above. Within a source, every row is taken whole ``floor(target/size)``
times; the rest of the target is filled by the rows that come first in a seeded order.

Nulls, ties and the like: a null text has size 0 and is never counted; a null source is a source of its own, ordered last; rows
with equal ids are told apart by their text's hash, and fully equal rows are interchangeable; an empty table gives an empty
result. Columns beyond the named ones are handed through by ``mixture`` unless they bear the name of a result column, which
then replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import SPACED_WORD, settled, stored

#: The seeded order of a source's rows is cut into so many slices; only the slice in which a target ends is ranked row by row.
SLICES = 4096


def word_count(text: str = "text") -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, the place of each source by code point, null last, from 0. One row per source comes in.

    Range partitions are counted and offset, so no task holds all sources.
    """
    named = sources.where(F.col("source").isNotNull()).repartitionByRange(F.col("source"))
    parts = stored(named.withColumn("part", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    ranked = parts.withColumn("inner", inner).join(starts, "part").withColumn("rank", F.col("inner") + F.col("start"))
    total = parts.count()
    last = sources.where(F.col("source").isNull()).withColumn("rank", F.lit(total).cast("long"))
    return ranked.drop("part", "inner", "start").unionByName(last)


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to sources (source, size, weight): clamp, share the excess again by weight, until nothing is above.

    A round is one sum over the source table; only two numbers reach the driver. At most the capacity of all is shared.
    """
    cap = F.col("size") * F.lit(float(max_epochs))
    level = -1.0
    while True:
        # what is full at this level stays full, because the level only rises
        full = F.lit(level) * F.col("weight") >= cap
        row = sources.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        reached = (total - row["taken"]) / row["open"]
        if reached <= level:
            break
        level = reached
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix_plan(docs: DataFrame, pattern: tuple[float, ...] = (5.0, 2.0, 1.0), max_epochs: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` is the number of times the row is in the mix and ``taken = copies * size``. A source's taken words differ from
    its target by half of one row at most. ``pattern`` are the weights that repeat along the sources by code point.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken", "_h", "_slice", "_rank", "_edge", "_need", "_whole")
    edge = settled(docs.sparkSession, "mix-targets", lambda: source_plan(with_slices(docs, seed), pattern, max_epochs))
    known = with_slices(docs, seed).join(edge, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    before = F.col("_slice") < F.col("_edge")
    away = known.where(F.col("_edge").isNull() | (F.col("_slice") != F.col("_edge"))).withColumn(
        "copies", F.col("_whole") + F.when(before, 1).otherwise(0)
    )
    order = Window.partitionBy("source").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    # where nothing is left to fill, no row is repeated once more, an empty text neither
    ended = (F.sum("size").over(order) - F.col("size") / 2 <= F.col("_need")) & (F.col("_need") > 0)
    at = known.where(F.col("_slice") == F.col("_edge")).withColumn("copies", F.col("_whole") + F.when(ended, 1).otherwise(0))
    out = away.unionByName(at).withColumn("copies", F.col("copies").cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("_h", "_slice", "_edge", "_need", "_whole")


def with_slices(docs: DataFrame, seed: int) -> DataFrame:
    """Adds the size of each row, its seeded place ``_h`` and the slice of places it is in."""
    sized = docs.withColumn("size", word_count()).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    return sized.withColumn("_slice", F.shiftrightunsigned("_h", 52))


def source_plan(sized: DataFrame, pattern: tuple[float, ...], max_epochs: float) -> DataFrame:
    """Per source (``_s``): size, target, whole copies, and where the seeded order of its rows is cut for the rest."""
    slices = stored(sized.groupBy("source", "_slice").agg(F.sum("size").alias("size")), "mix-slices")
    sources = slices.groupBy("source").agg(F.sum("size").alias("size"))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (F.col("rank") % len(pattern) + 1).cast("int"))
    sources = stored(ranked_sources(sources).withColumn("weight", weight).drop("rank"), "mix-weights")
    total = sources.agg(F.sum("size")).first()[0] or 0
    filled = water_fill(sources, float(total), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = filled.withColumnRenamed("size", "source_size").withColumn("_whole", whole)
    filled = filled.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    # the slice in which the rest of the target ends, and what is left of it there
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0))
    reach = slices.withColumn("upto", upto).select(F.col("source").alias("s"), "_slice", "upto", "size")
    edge = (
        filled.join(reach, F.col("source").eqNullSafe(F.col("s")) & (F.col("upto") >= F.col("_rest")), "left")
        .groupBy("source", "source_size", "target", "_whole")
        .agg(
            F.min("_slice").alias("_edge"), F.min_by(F.col("_rest") - F.col("upto") + F.col("size"), "_slice").alias("_need")
        )
    )
    return edge.withColumnRenamed("source", "_s")


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row as often as its plan says, with its own columns."""
    planned = mix_plan(docs, **options)
    repeats = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return planned.where("copies > 0").select(*docs.columns, repeats).drop("_copy")
