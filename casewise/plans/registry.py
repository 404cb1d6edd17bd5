"""Registry of named queries and, next to each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(source)`` under ``name``; ``source`` gives the logs of one data folder."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Source(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


class Source:
    """The logs of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return tables.events_log(self.table("events"))

    def orders(self, **options) -> DataFrame:
        return tables.orders_log(self.table("orders"), **options)

    def conversations(self) -> DataFrame:
        return tables.conversations_log(self.table("conversations"))

    def lineitem(self) -> DataFrame:
        return tables.lineitem_log(self.table("lineitem"))


def r6(column) -> F.Column:
    """Round for comparison across engines."""
    return F.round(column, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(F.col(n)) for n in names})


# --------------------------------------------------------------------------------------------------------------
# SQL building blocks
# --------------------------------------------------------------------------------------------------------------

EVENTS = "log AS (SELECT CAST(user_id AS VARCHAR) AS case_id, event_type AS activity, ts, event_id AS seq FROM events)"
ORDERS = (
    "log AS (SELECT CAST(o_custkey AS VARCHAR) AS case_id, o_orderstatus AS activity, o_orderdate AS ts, "
    "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) * 10000000000000 + o_orderkey AS seq FROM orders)"
)
CONVERSATIONS = (
    "log AS (SELECT CAST(conv_id AS VARCHAR) AS case_id, role AS activity, CAST(NULL AS TIMESTAMP) AS ts, "
    "conv_id * 1000000 + turn AS seq FROM conversations)"
)
LINEITEM = (
    "log AS (SELECT CAST(l_orderkey AS VARCHAR) AS case_id, l_returnflag || ', ' || l_linestatus AS activity, "
    "l_shipdate AS ts, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus) "
    "AS seq FROM lineitem)"
)
POSITIONS = (
    "ev AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS pos, "
    "count(*) OVER (PARTITION BY case_id) AS case_len, min(seq) OVER (PARTITION BY case_id) AS case_seq FROM log)"
)
CASES = "cases AS (SELECT case_id, count(*) AS case_len, min(seq) AS case_seq FROM log GROUP BY case_id)"


def with_(*parts: str) -> str:
    """``WITH a, b, ... final`` from parts; the last one is the final select."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def describe_sql(source: str, columns: list[str]) -> str:
    """Final select that describes columns of ``source``."""
    one = (
        "SELECT '{c}' AS \"column\", count({c}) AS \"count\", round(avg({c}), 6) AS mean, "
        "round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM " + source
    )
    return "\nUNION ALL ".join(one.format(c=c) for c in columns)
