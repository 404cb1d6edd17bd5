"""Queries on ingestion and log preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.functions.ordering import add_index as index_rows
from casewise.functions.values import joined, parse_timestamp
from casewise.operators import prepare
from casewise.plans.registry import CASES, CONVERSATIONS, EVENTS, ORDERS, POSITIONS, query, with_
from casewise.sources.tables import filter_events

LOG_OUT = "SELECT case_id, activity, ts, pos FROM ev"


def events_out(df):
    return df.select("case_id", "activity", F.col("ts").cast("timestamp_ntz").alias("ts"), "pos")


@query("event_log_single_key", with_(EVENTS, "SELECT case_id, activity, ts, seq FROM log"))
def event_log_single_key(src):
    return src.events().select("case_id", "activity", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq")


@query(
    "event_log_composite_key",
    "SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderstatus || ', ' || o_orderpriority AS activity, "
    "o_orderdate AS ts, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10000000000000 + o_orderkey AS seq "
    "FROM orders",
)
def event_log_composite_key(src):
    log = src.orders(with_priority=True)
    return log.select("case_id", "activity", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq")


@query(
    "parse_timestamp",
    "SELECT event_id, ts AS iso, date_trunc('millisecond', ts) AS slash, CAST(NULL AS TIMESTAMP) AS bad FROM events",
)
def parse_timestamp_query(src):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    slash = F.date_format(ts, "yyyy/MM/dd HH:mm:ss.SSS")
    return src.table("events").select(
        "event_id",
        parse_timestamp(iso).cast("timestamp_ntz").alias("iso"),
        parse_timestamp(slash).cast("timestamp_ntz").alias("slash"),
        parse_timestamp(F.concat(F.lit("t="), iso)).cast("timestamp_ntz").alias("bad"),
    )


@query(
    "sample_every_n",
    with_(
        EVENTS,
        "ix AS (SELECT *, row_number() OVER (ORDER BY seq) AS i, count(*) OVER () AS n FROM log)",
        "SELECT i AS \"index\", case_id, activity FROM ix WHERE i % 100 = 0 OR i = n",
    ),
)
def sample_every_n(src):
    rows = index_rows(src.events(), ["seq"])
    last = src.events().agg(F.count(F.lit(1)).alias("n")).scalar()
    picked = filter_events(rows, (F.col("index") % 100 == 0) | (F.col("index") == last))
    return picked.select("index", "case_id", "activity")


@query("add_index", with_(EVENTS, "SELECT seq, row_number() OVER (ORDER BY seq) AS \"index\" FROM log"))
def add_index(src):
    return index_rows(src.events(), ["seq"]).select("seq", "index")


@query(
    "case_sequences",
    with_(
        EVENTS,
        "SELECT case_id, row_number() OVER (ORDER BY min(seq)) AS case_rank, "
        "string_agg(activity, '|' ORDER BY seq) AS activities FROM log GROUP BY case_id",
    ),
)
def case_sequences(src):
    seqs = prepare.case_sequences(src.events())
    ranked = index_rows(seqs, ["case_seq"], name="case_rank", chunk="case_chunk")
    return ranked.select("case_id", "case_rank", joined(F.col("activities")).alias("activities"))


@query(
    "add_start_symbol",
    with_(
        EVENTS,
        POSITIONS,
        "SELECT case_id, activity, ts, pos + 1 AS pos FROM ev UNION ALL "
        "SELECT DISTINCT case_id, '__start__', CAST(NULL AS TIMESTAMP), 0 FROM ev",
    ),
)
def add_start_symbol(src):
    return events_out(prepare.add_start(src.events()))


@query(
    "add_stop_symbol",
    with_(
        ORDERS,
        POSITIONS,
        LOG_OUT + " UNION ALL SELECT DISTINCT case_id, '__stop__', CAST(NULL AS TIMESTAMP), case_len FROM ev",
    ),
)
def add_stop_symbol(src):
    return events_out(prepare.add_stop(src.orders()))


RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY {key}) AS r, count(*) OVER () AS n FROM cases)"
ARRIVAL = RANKED.format(key="case_seq")


def shuffled(seed, source="cases", name="ranked"):
    return (
        f"{name} AS (SELECT *, row_number() OVER (ORDER BY md5(case_id || '#{seed}')) AS r, count(*) OVER () AS n FROM {source})"
    )


@query(
    "split_in_order",
    with_(
        EVENTS,
        CASES,
        ARRIVAL,
        "SELECT log.seq, CASE WHEN r <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part "
        "FROM log JOIN ranked USING (case_id)",
    ),
)
def split_in_order(src):
    train, test = prepare.split_cases(src.events(), 0.3)
    return _parts({"train": train, "test": test})


@query(
    "split_shuffled",
    with_(
        ORDERS,
        CASES,
        shuffled(7),
        "SELECT log.seq, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part "
        "FROM log JOIN ranked USING (case_id)",
    ),
)
def split_shuffled(src):
    train, test = prepare.split_cases(src.orders(), 0.2, shuffle=True, seed=7)
    return _parts({"train": train, "test": test})


@query(
    "split_three_way",
    with_(
        ORDERS,
        CASES,
        shuffled(1),
        "held AS (SELECT case_id FROM ranked WHERE r > floor(n * 0.7))",
        shuffled("1b", "held", "again"),
        "SELECT log.seq, CASE WHEN a.case_id IS NULL THEN 'train' WHEN a.r <= floor(a.n * 0.5) THEN 'validation' "
        "ELSE 'test' END AS part FROM log LEFT JOIN again a USING (case_id)",
    ),
)
def split_three_way(src):
    train, validation, test = prepare.split_three_way(src.orders(), 0.3, seed=1)
    return _parts({"train": train, "validation": validation, "test": test})


def _parts(parts):
    out = None
    for name, rows in parts.items():
        rows = rows.select("seq", F.lit(name).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "sample_cases",
    with_(
        ORDERS,
        CASES,
        shuffled(3),
        "SELECT log.seq FROM log JOIN ranked USING (case_id) WHERE r <= greatest(1, floor(n * 0.1))",
    ),
)
def sample_cases(src):
    return prepare.sample_cases(src.orders(), 0.1, seed=3).select("seq")


@query(
    "head_cases",
    with_(ORDERS, CASES, ARRIVAL, "SELECT log.seq FROM log JOIN ranked USING (case_id) WHERE r <= floor(n * 0.25)"),
)
def head_cases(src):
    return prepare.head_cases(src.orders(), 0.25).select("seq")


for _name, _mode, _op in (("longer", "greater", ">"), ("shorter", "lower", "<"), ("equal", "equal", "=")):

    def _length(src, mode=_mode):
        return events_out(prepare.filter_cases_by_length(src.orders(), 10, mode))

    query(f"cases_{_name}", with_(ORDERS, POSITIONS, f"{LOG_OUT} WHERE case_len {_op} 10"))(_length)


@query(
    "interleave_concat",
    with_(ORDERS, POSITIONS, "SELECT row_number() OVER (ORDER BY case_seq, pos) AS \"index\", seq FROM ev"),
)
def interleave_concat(src):
    return prepare.interleave(src.orders(), mix=False).select("index", "seq")


DRAW = "CAST('0x' || substr(md5({what} || '#{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "interleave_random",
    with_(
        ORDERS,
        POSITIONS,
        f"draws AS (SELECT *, {DRAW.format(what='case_id || chr(35) || pos', seed=5)} AS draw FROM ev)",
        "sorted AS (SELECT case_id, draw, row_number() OVER (PARTITION BY case_id ORDER BY draw, pos) - 1 AS pos FROM draws)",
        "SELECT row_number() OVER (ORDER BY s.draw, ev.case_id, ev.pos) AS \"index\", ev.seq "
        "FROM ev JOIN sorted s USING (case_id, pos)",
    ),
)
def interleave_random(src):
    return prepare.interleave(src.orders(), mix=True, seed=5).select("index", "seq")


@query("tag_input", with_(ORDERS, "SELECT seq, 'in' AS input, activity FROM log"))
def tag_input(src):
    return prepare.tag_input(src.orders(), "in").select("seq", "tagged.input", "tagged.activity")


INDEX = "ix AS (SELECT activity, row_number() OVER (ORDER BY min(seq)) AS activity_idx FROM log GROUP BY activity)"


@query("activity_index", with_(EVENTS, INDEX, "SELECT activity, activity_idx FROM ix"))
def activity_index(src):
    return prepare.activity_index(src.events()).select("activity", "activity_idx")


def prefix_sql(window, left):
    digits = "lpad" if left else "rpad"
    return with_(
        EVENTS,
        INDEX,
        POSITIONS,
        "co AS (SELECT ev.case_id, ev.pos, ix.activity_idx AS y FROM ev JOIN ix USING (activity))",
        f"h AS (SELECT *, string_agg(CAST(y AS VARCHAR), '') OVER (PARTITION BY case_id ORDER BY pos "
        f"ROWS BETWEEN {window} PRECEDING AND 1 PRECEDING) AS x FROM co)",
        f"SELECT case_id, pos, {digits}(x, {window}, '0') AS x, y FROM h WHERE pos >= 1",
    )


for _pad in ("left", "right"):

    def _prefixes(src, pad=_pad):
        rows = prepare.prefix_windows(src.events(), 5, pad)
        return rows.select("case_id", "pos", F.array_join("x", "").alias("x"), "y")

    query(f"prefix_windows_{_pad}", prefix_sql(5, _pad == "left"))(_prefixes)


@query(
    "padded_sequences",
    with_(
        ORDERS,
        INDEX,
        "s AS (SELECT case_id, string_agg(CAST(activity_idx AS VARCHAR), '' ORDER BY seq) AS x "
        "FROM log JOIN ix USING (activity) GROUP BY case_id)",
        "SELECT case_id, rpad(x, CAST((SELECT max(length(x)) FROM s) AS INTEGER), '0') AS x FROM s",
    ),
)
def padded_sequences(src):
    return prepare.padded_sequences(src.orders()).select("case_id", F.array_join("x", "").alias("x"))


@query("conversation_log", with_(CONVERSATIONS, POSITIONS, LOG_OUT))
def conversation_log(src):
    """A log without any timestamps."""
    return events_out(prepare.positioned(src.conversations()))
