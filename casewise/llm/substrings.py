"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of a text; where its value is small, a chunk ends. Whether a place is a cut depends on the bytes
just before it only, so an insertion moves cuts but changes few chunks, and equal passages are cut alike wherever they stand.
A unit is the shortest run of chunks from a cut that holds ``least_bytes``; units are compared by digest. Units that occur more than
once, in one document or in several, are repeats; overlapping repeats of a document are joined into spans.

A text shorter than a unit is one unit, so copies of short texts are found too. Null and empty texts have no units. Rows with equal
id and text are repeats of each other; of units that occur several times, the first in the document with the least id is kept
(all of them in rows without an id if no other row has one). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import blocks, settled, stored, text_of

#: Bytes that the rolling hash looks back.
REACH = 16
#: Mean distance of cuts in bytes, and the longest chunk.
MEAN, LONGEST = 24, 512
GEAR = np.random.default_rng(20).integers(0, 1 << 16, 256, dtype=np.uint16)


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in a byte array where chunks end, the end included. Only whole characters are cut apart."""
    n = len(data)
    h = GEAR[data]
    step = 1
    while step < REACH:  # sum of gear values, each shifted by its distance, over 2, 4, 8, 16 bytes
        rolled = h.copy()
        rolled[step:] += h[:-step] << np.uint16(step)
        h, step = rolled, step * 2
    whole = np.ones(n, bool)
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    natural = np.flatnonzero((h < (1 << 16) // MEAN) & whole) + 1
    natural = natural[natural >= REACH]
    ends = np.append(natural[natural < n], n)
    gaps = np.diff(ends, prepend=0)
    if gaps.max() <= LONGEST:
        return ends
    # long stretches without a cut are cut at equal distances from the last one
    extra = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
    forced = np.concatenate(extra)
    for _ in range(3):  # a character has at most three more bytes
        inside = (forced < n) & ((data[np.minimum(forced, n - 1)] & 0xC0) == 0x80)
        forced = forced + inside
    return np.unique(np.concatenate([ends, forced]))


def units(text: str, least_bytes: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Digests of the units of a text, with their starts and ends in characters."""
    raw = text.encode()
    if not raw:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(raw, np.uint8)
    ends = cuts(data)
    starts = np.concatenate([[0], ends[:-1]])
    last = np.searchsorted(ends, starts + least_bytes)
    full = last < len(ends)
    a, b = (starts[full], ends[last[full]]) if full.any() else (np.zeros(1, np.int64), np.array([len(data)]))
    digest = xxhash.xxh3_64_intdigest
    found = [digest(raw[i:j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    if len(raw) > len(text):
        characters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        a, b = characters[a], characters[b]
    return found, a, b


def unit_rows(docs: DataFrame, least_bytes: int, *more: str) -> DataFrame:
    """r (a row number), doc_id, and arrays: digests, starts, ends; and ``more`` columns of ``docs`` as they are."""
    rows = docs.select("doc_id", text_of().alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            digests, starts, ends = [], [], []
            for text in batch.column("text").to_pylist():
                found, a, b = units(text, least_bytes)
                digests.append(np.array(found, np.uint64).view(np.int64))
                starts.append(a.astype(np.int32))
                ends.append(b.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(digests, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), *map(batch.column, more)],
                ["doc_id", "digests", "starts", "ends", *more],
            )

    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)
    made = rows.mapInArrow(run, "doc_id long, digests array<long>, starts array<int>, ends array<int>" + kinds)
    return stored(made.withColumn("r", F.monotonically_increasing_id()), "units")


def repeated_spans(docs: DataFrame, least_bytes: int = 100) -> DataFrame:
    """One row per span of repeats: doc_id, start, end (characters, end exclusive), occurrences, first_doc_id, kept, cuts.

    ``occurrences`` is the largest number of times one of its units occurs, ``first_doc_id`` the least id of a document with
    one of its units, and ``kept`` tells that every unit of the span occurs here first. ``cuts`` lists the parts of the span
    (start, end) that are in units which occur earlier and in none that occurs here first: without them one of each unit is left.
    """
    return settled(docs.sparkSession, "spans", lambda: spans(unit_rows(docs, least_bytes)).drop("r"))


def spans(made: DataFrame) -> DataFrame:
    keyed = made.select("doc_id", F.explode("digests").alias("u"))
    often = keyed.groupBy("u").agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("first")).where("occurrences > 1")
    often = stored(often, "repeated-units")
    placed = made.select("r", F.posexplode("digests").alias("i", "u"))
    met = stored(placed.join(often, "u").select("r", "i", "u", "occurrences", "first"), "repeats")
    # from here on all windows are over one document's units
    same = Window.partitionBy("r", "u").orderBy("i")
    met = met.withColumn("nth", F.row_number().over(same))
    found = met.join(made.select("r", "doc_id", "starts", "ends"), "r")
    found = found.select(
        "r", "doc_id", "occurrences", "first", F.element_at("starts", F.col("i") + 1).alias("start"), F.element_at("ends", F.col("i") + 1).alias("end"),
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("first"))).alias("own"),
    )
    along = Window.partitionBy("r").orderBy("start", "end")
    back = Window.partitionBy("r").orderBy(F.desc("start"), F.desc("end"))
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # units of a document start and end in the same order, so the own units next to another one cover all of it that own units cover
    bounds = found.withColumn("next_own", F.min(F.when(F.col("own"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    bounds = bounds.withColumn("last_own", F.max(F.when(F.col("own"), F.col("end"))).over(before))
    part = F.struct(F.greatest("start", "last_own").alias("start"), F.least("end", "next_own").alias("end"))
    parts = bounds.withColumn("part", F.when(~F.col("own"), part)).withColumn("part", F.when(F.col("part.start") < F.col("part.end"), F.col("part")))
    opened = parts.withColumn("opens", F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1))
    opened = opened.withColumn("splits", F.when(F.col("part.start") > F.max("part.end").over(before), 1).otherwise(0))
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    numbered = opened.withColumn("span", F.sum("opens").over(upto)).withColumn("piece", F.sum("splits").over(upto))
    pieces = numbered.groupBy("r", "doc_id", "span", "piece").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("occurrences").alias("occurrences"), F.min("first").alias("first"),
        F.min("own").alias("own"), F.struct(F.min("part.start").alias("start"), F.max("part.end").alias("end")).alias("cut"),
    )
    return pieces.groupBy("r", "doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("occurrences").alias("occurrences"), F.min("first").alias("first_doc_id"),
        F.min("own").alias("kept"), F.array_sort(F.collect_list(F.when(F.col("cut.start").isNotNull(), F.col("cut")))).alias("cuts"),
    ).drop("span")


def remove_repeats(docs: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``docs`` with the ``cuts`` of every span taken out of the text, so the first of each repeated unit stays.

    Rows are told apart by id and text, so different texts under one id are cut each at its own places. Fully equal rows count as one and are cut
    alike. Rows without an id stay as they are. All columns are handed through, whatever their names.
    """
    return settled(docs.sparkSession, "without-repeats", lambda: without_repeats(docs, least_bytes))


def without_repeats(docs: DataFrame, least_bytes: int) -> DataFrame:
    key = F.sha2(text_of().cast("binary"), 256).alias("h")
    made = unit_rows(docs.select("doc_id", "text").distinct().select("doc_id", "text", key), least_bytes, "h")
    found = spans(made).where("size(cuts) > 0 and doc_id is not null")
    cut = found.groupBy("r").agg(F.array_sort(F.flatten(F.collect_list("cuts"))).alias("cut"))
    cut = stored(cut.join(made.select("r", F.col("doc_id").alias("id"), "h"), "r").drop("r"), "cuts")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), key).join(cut, ["id", "h"], "left")
    text = F.col("row.text")
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), F.col("cut"))
    after = F.concat(F.transform("cut", lambda s: s["start"]), F.array(F.length(text)))
    pieces = F.transform(F.arrays_zip(edges.alias("e"), after.alias("a")), lambda p: F.substring(text, p["e"]["end"] + 1, p["a"] - p["e"]["end"]))
    return held.select(F.col("row").withField("text", F.when(F.col("cut").isNull(), text).otherwise(F.array_join(pieces, ""))).alias("row")).select("row.*")
