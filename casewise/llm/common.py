"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.functions.scratch import temporary_tables, written

#: One word of the white-space contracts; fixed value.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(doc_id: str, modulus: int) -> Column:
    """Remainder of the crc32 of an id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, as a table; the tables stored on the way are deleted."""
    with temporary_tables(spark):
        return stored(build(), label, keep=True)


def stored(df: DataFrame, label: str, *, keep: bool = False) -> DataFrame:
    """The rows as a table in the shared folder; what was shuffled to make them is given up afterwards."""
    out = written(df, label, keep=keep)
    released(df.sparkSession)
    return out


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files that no plan refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting that holds inside and is put back on leaving."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of ``df`` and one more field; a frame's own schema object must not be changed."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def blocks(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that ``column`` holds about ``most`` bytes in each; one row is never cut."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0)
        if batch.num_rows == 0:
            continue
        total, start = pc.cumulative_sum(sizes.cast(pa.int64())).to_numpy(zero_copy_only=False), 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(total.searchsorted(before + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


def seed_of(*parts) -> int:
    """A stable 32-bit seed."""
    return int.from_bytes(hashlib.blake2b(json.dumps(parts).encode(), digest_size=4).digest(), "big")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest id that each end of undirected ``edges`` (a, b long) reaches, as a table: rows (id, component)."""
    return settled(edges.sparkSession, label, lambda: star_rounds(edges, label))


def star_rounds(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Smallest id that each end of undirected ``edges`` (a, b long) reaches: rows (id, component).

    Alternating large-star and small-star steps; each is one aggregation with map-side combining, and the edge table is
    written between rounds. A vertex with very many neighbours is no bottleneck: only minima are gathered per vertex, and the
    join back to its edges is one that adaptive execution splits.
    """
    now = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)
    previous = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of a vertex is linked to the smallest vertex around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = stored(large, label)
        # small star: a vertex and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m"), F.explode(F.array("a", "b")).alias("v")).where("m <> v")
        now = stored(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), label)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(roots)
