"""Readers for delimited and XES logs, and the layouts of well-known public logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from casewise.functions.values import let, parse_timestamp
from casewise.sources.tables import to_event_log


@dataclass(frozen=True)
class DatasetSpec:
    """Where the case, activity and time of a log are."""

    case_keys: tuple[str, ...]
    activity_keys: tuple[str, ...]
    ts: str
    separator: str = ","


_XES = DatasetSpec(("case:concept:name",), ("concept:name",), "time:timestamp")

# Columns of public logs.
SPECS: dict[str, DatasetSpec] = {
    "sepsis": _XES,
    "bpi_2011": _XES,
    "bpi_2012": _XES,
    "bpi_2013": DatasetSpec(("case:concept:name",), ("lifecycle:transition",), "time:timestamp"),
    "bpi_2014": DatasetSpec(("Incident ID",), ("IncidentActivity_Type",), "DateStamp", ";"),
    "bpi_2017": _XES,
    "bpi_2018": _XES,
    "bpi_2019": DatasetSpec(("case:Purchasing Document", "case:Item"), ("concept:name",), "time:timestamp"),
    "helpdesk": DatasetSpec(("Case ID",), ("Activity",), "Complete Timestamp"),
    "synthetic": _XES,
    "synthetic_111000": _XES,
    "synthetic_train": _XES,
    "synthetic_test": _XES,
    "lazy_decrement": _XES,
    "random_decision_win2": _XES,
    "random_decision_win3": _XES,
}



def read_csv_log(
    spark: SparkSession,
    path: str,
    spec: DatasetSpec,
    *,
    seq: str | None = None,
    schema: str | None = None,
) -> DataFrame:
    """A delimited log with header; all columns are text unless ``schema`` says otherwise, and "na" stays text.

    ``seq`` names a column with the arrival order.  Without one, files come in the order of their paths and rows as they stand
    in a file: the order key is (number of the piece of a file, row in the scan), and a piece is one chunk.
    """
    reader = spark.read.option("header", True).option("sep", spec.separator).option("nullValue", "\u0000").option("emptyValue", "")
    rows = (reader.schema(schema) if schema else reader).csv(path)
    if seq:
        order, chunk = F.col(f"`{seq}`").cast("bigint"), None
    else:
        # Spark packs pieces of files into partitions by size, so their order is worked out from where they begin
        place = {"_path": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start")}
        rows = rows.withColumns(place | {"_row": F.monotonically_increasing_id()})
        pieces = rows.select("_path", "_start").distinct()  # one row per piece of a file
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_path", "_start")).cast("bigint")
        rows = rows.join(pieces.withColumn("_piece", number), ["_path", "_start"])
        order, chunk = F.struct("_piece", "_row"), F.col("_piece")
    return to_event_log(
        rows,
        list(spec.case_keys),
        list(spec.activity_keys),
        seq=order,
        ts=parse_timestamp(F.col(f"`{spec.ts}`").cast("string")),
        chunk=chunk,
    )


# Element names of attributes in the XES standard, in falling order of precedence for one key.
XES_TYPES = ("string", "date", "int", "float", "boolean", "id", "list", "container")
#: how deep attributes of attributes are read
XES_DEPTH = 2
PAIRS = "array<struct<k:string,v:string>>"


def xes_attributes(depth: int = XES_DEPTH) -> str:
    """Fields of an element that has attributes; lists may hold theirs in ``values``."""
    own = "_key:string,_value:string"
    inner = f",{xes_attributes(depth - 1)}" if depth > 1 else ""
    values = f",values:struct<{xes_attributes(depth - 1)}>" if depth > 1 else ""
    return ",".join(f"{t}:array<struct<{own}{inner}{values if t == 'list' else ''}>>" for t in XES_TYPES)


#: a trace: its attributes and its events
XES_SCHEMA = f"trace:struct<{xes_attributes()},event:array<struct<{xes_attributes()}>>>"
#: traces whose events without time share a chunk
TRACES_PER_CHUNK = 1024


def xes_pairs(node: Column, depth: int = XES_DEPTH) -> Column:
    """(k, v) of all attributes below an element, in ascending precedence; ``outer/inner`` names an attribute of an attribute."""
    none = F.array().cast(PAIRS)

    def of(e: Column, kind: str) -> Column:
        pairs = F.when(e["_value"].isNotNull(), F.array(F.struct(e["_key"].alias("k"), e["_value"].alias("v"))).cast(PAIRS)).otherwise(none)
        if depth == 1:
            return pairs
        below = [xes_pairs(e, depth - 1)] + ([F.when(e["values"].isNotNull(), xes_pairs(e["values"], depth - 1))] if kind == "list" else [])
        named = [F.transform(p, lambda x: F.struct(F.concat(e["_key"], F.lit("/"), x["k"]).alias("k"), x["v"].alias("v"))).cast(PAIRS) for p in below]
        return F.concat(*[F.coalesce(p, none) for p in reversed(named)], pairs)

    def all_of(kind: str) -> Column:
        return F.coalesce(F.flatten(F.transform(node[kind], lambda e: of(e, kind))), none)

    return F.concat(*[all_of(kind) for kind in reversed(XES_TYPES)])


def last_values(pairs: Column) -> Column:
    """A map from pairs; of a key that occurs several times the last value stays, and pairs without a key go."""
    def made(named: Column) -> Column:
        keys = F.array_distinct(F.transform(named, lambda p: p["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(named, lambda p: p["k"] == k), -1)["v"]))

    return let(F.filter(pairs, lambda p: p["k"].isNotNull()), made)


def read_xes_log(spark: SparkSession, path: str) -> DataFrame:
    """An XES log (plain or gzip) as an event log ordered by time, then by place in the file; events without time come first.

    The schema is given, not inferred: an element that occurs once must still be an array.  Attributes of the event and,
    with the prefix ``case:``, of its trace are kept in ``attributes``; attributes of attributes, those in lists and containers included, under
    ``outer/inner``.  Of a key that occurs several times in one element the last value stays; if it occurs under several types, that
    of the type that comes first in ``XES_TYPES``.
    """
    traces = spark.read.format("xml").option("rowTag", "trace").schema(StructType.fromDDL(XES_SCHEMA)["trace"].dataType).load(path)
    traces = traces.select(F.monotonically_increasing_id().alias("_trace"), F.struct(*XES_TYPES).alias("_case"), "event")
    events = traces.select("_trace", last_values(xes_pairs(F.col("_case"))).alias("_c"), F.posexplode("event").alias("_place", "_event"))
    rows = events.select("_trace", "_place", "_c", last_values(xes_pairs(F.col("_event"))).alias("attributes"))
    ts = parse_timestamp(F.try_element_at("attributes", F.lit("time:timestamp")))
    hour = F.floor(F.unix_micros(ts) / F.lit(3_600_000_000))
    # events without time are cut along their traces, far below any hour
    untimed = F.floor(F.col("_trace") / F.lit(TRACES_PER_CHUNK)) - F.lit(1 << 60)
    of_case = F.transform_keys("_c", lambda k, _: F.concat(F.lit("case:"), k))
    of_event = F.map_filter("attributes", lambda k, _: ~F.array_contains(F.map_keys(of_case), k))
    return rows.select(
        F.try_element_at("_c", F.lit("concept:name")).alias("case_id"),
        F.try_element_at("attributes", F.lit("concept:name")).alias("activity"),
        ts.alias("ts"),
        F.struct(F.coalesce(F.unix_micros(ts), F.lit(-(1 << 62))).alias("us"), F.col("_trace"), F.col("_place")).alias("seq"),
        F.coalesce(hour, untimed).cast("bigint").alias("chunk"),
        F.map_concat(of_case, of_event).alias("attributes"),
    )
