"""Queries on live streams, file formats, given automata and the trainable classifier.

The stream queries cut a table into five files in arrival order and run over them one file per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.functions.scratch import scratch_dir
from casewise.functions.values import joined
from casewise.operators import classifier as cl
from casewise.operators import models as md
from casewise.operators.automaton import walk_automaton
from casewise.operators.ensembles import Strategy
from casewise.operators.evaluate import case_perplexity, evaluate
from casewise.operators.models import Miner
from casewise.operators.prepare import activity_index, prefix_windows, split_cases, split_three_way
from casewise.operators.structures import Bag, NGram, PrefixTree
from casewise.plans import model_sql as m
from casewise.plans.preparation import LOG_OUT
from casewise.plans.replay import SWITCH, drift_sql
from casewise.plans.registry import EVENTS, ORDERS, POSITIONS, query, rounded, with_
from casewise.sinks.tables import run_summaries, write_rows
from casewise.sources.files import SPECS, read_csv_log, read_xes_log
from casewise.sources.tables import events_log
from casewise.streaming.cases import StreamingContexts, with_start
from casewise.streaming.contexts import read_stream_log
from casewise.streaming.learning import StreamingDrift, StreamingModels

BATCHES = 5
#: rows of a file of a batch, and most files of one; a batch of one file would be written and read by one task
FILE_ROWS = 1 << 16
MOST_FILES = 64


def event_stream(src, folder: str) -> DataFrame:
    """The events table as a stream of ``BATCHES`` micro-batches in arrival order."""
    rows = src.table("events")
    # equal ranges of the ids that occur, so that gaps and other first ids lose no row; rows without id come first
    span = rows.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = span["lo"] or 0, span["hi"] or 0
    edges = [lo + -(-i * (hi - lo + 1) // BATCHES) for i in range(BATCHES + 1)]
    # plain ranges, so that a batch opens its own part of the table only
    ranges = [(F.col("event_id") >= a) & (F.col("event_id") < b) for a, b in zip(edges, edges[1:], strict=False)]
    ranges[0] = ranges[0] | F.col("event_id").isNull()
    files = 1
    if span["n"] >= 2 * BATCHES * FILE_ROWS:
        # every batch needs the same number of files, so the smallest one decides
        least = min(rows.agg(*[F.count_if(r).alias(f"_{i}") for i, r in enumerate(ranges)]).first())
        files = max(1, min(MOST_FILES, least // FILE_ROWS))
    for own in ranges:
        batch = rows.filter(own)
        (batch.repartition(files) if files > 1 else batch.coalesce(1)).write.mode("append").parquet(f"{folder}/in")
    return read_stream_log(src.spark, f"{folder}/in", rows.schema, events_log, files_per_batch=files)


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream into files and read them back."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query("stream_source", with_(EVENTS, "SELECT case_id, activity, ts, seq FROM log"))
def stream_source(src):
    folder = scratch_dir(src.spark, "stream_source")
    rows = drain(event_stream(src, folder), folder)
    return rows.select("case_id", "activity", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq")


def _contexts(src, window: int) -> DataFrame:
    folder = scratch_dir(src.spark, "stream_contexts")
    stream = StreamingContexts(src.spark, f"{folder}/cases", window, compact_every=2)
    stream.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    return stream.contexts()


@query(
    "stream_contexts",
    with_(
        *m.base(EVENTS),
        f"SELECT seq, pos, {m.state(('ngram', 3))} AS state, {m.state(('ngram', 3), after=True)} AS state_next, "
        "lag(ts) OVER (PARTITION BY case_id ORDER BY pos) AS prev_ts FROM evs",
    ),
)
def stream_contexts(src):
    rows = _contexts(src, 3)
    return rows.select(
        "seq", "pos", joined(F.col("state")).alias("state"), joined(F.col("state_next")).alias("state_next"),
        F.col("prev_ts").cast("timestamp_ntz").alias("prev_ts"),
    )


@query(
    "stream_start_symbol",
    with_(
        EVENTS, POSITIONS,
        "SELECT seq, 0 AS part, case_id, activity FROM ev UNION ALL SELECT seq, -1, case_id, '__start__' FROM ev WHERE pos = 0",
    ),
)
def stream_start_symbol(src):
    return with_start(_contexts(src, 0)).select("seq", "part", "case_id", "activity")


def batched_sql(kind, n):
    """Predictions by the model as it was before the batch of each event."""
    return [
        f"{n}_tr AS (SELECT *, floor(seq * {BATCHES} / (SELECT count(*) FROM log)) AS b, {m.state(kind)} AS s, {m.state(kind, after=True)} AS n FROM evs)",
        f"{n}_arr AS (SELECT n AS s, b FROM {n}_tr UNION ALL SELECT '', b FROM {n}_tr WHERE pos = 0)",
        f"{n}_bs AS (SELECT DISTINCT s, b FROM {n}_tr)",
        f"{n}_vb AS (SELECT e.s, e.b, count(*) AS v FROM {n}_bs e JOIN {n}_arr a ON a.s = e.s AND a.b < e.b GROUP BY ALL)",
        f"{n}_fb AS (SELECT e.s, e.b, d.activity, count(*) AS c FROM {n}_bs e JOIN {n}_tr d ON d.s = e.s AND d.b < e.b GROUP BY ALL)",
        f"{n}_pp AS (SELECT v.s, v.b, f.activity, f.c / v.v AS p FROM {n}_vb v JOIN {n}_fb f USING (s, b) UNION ALL "
        f"SELECT v.s, v.b, '__stop__', (v.v - coalesce(f.c, 0)) / v.v FROM {n}_vb v LEFT JOIN (SELECT s, b, sum(c) AS c FROM {n}_fb GROUP BY s, b) f USING (s, b))",
        f"{n}_rk AS (SELECT *, row_number() OVER (PARTITION BY s, b ORDER BY round(p, 12) DESC, activity) AS rk FROM {n}_pp WHERE p > 0)",
        f"{n}_sc AS (SELECT e.*, q.activity AS a1 FROM {n}_tr e LEFT JOIN {n}_rk q ON q.s = e.s AND q.b = e.b AND q.rk = 1)",
    ]


LIVE = {"ngram_2": Miner(NGram(1)), "ngram_4": Miner(NGram(3))}


def _live(src) -> StreamingModels:
    folder = scratch_dir(src.spark, "stream_predict")
    models = StreamingModels(src.spark, f"{folder}/model", LIVE, compact_every=2)
    models.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    return models


@query(
    "stream_predict",
    with_(
        *m.base(EVENTS), *batched_sql(("ngram", 1), "x"), *batched_sql(("ngram", 3), "y"),
        "SELECT x_sc.seq, x_sc.a1 AS ngram_2, y_sc.a1 AS ngram_4 FROM x_sc JOIN y_sc USING (seq)",
    ),
)
def stream_predict(src):
    rows = _live(src).predictions()
    return rows.select("seq", F.col("p_ngram_2.activity").alias("ngram_2"), F.col("p_ngram_4.activity").alias("ngram_4"))


MIXED = {"bag": Miner(Bag()), "fpt": Miner(PrefixTree()), "ngram_4": Miner(NGram(3))}
SOFT = {"soft": Strategy(tuple(MIXED), "soft")}
MIXED_SQL = [
    *m.base(EVENTS), *batched_sql(("bag",), "x"), *batched_sql(("fpt",), "y"), *batched_sql(("ngram", 3), "z"),
    "dd AS (" + " UNION ALL ".join(f"SELECT t.seq, q.activity, q.p FROM {n}_tr t JOIN {n}_pp q ON q.s = t.s AND q.b = t.b" for n in "xyz") + ")",
    "ss AS (SELECT seq, activity, sum(p) / sum(sum(p)) OVER (PARTITION BY seq) AS p FROM dd GROUP BY seq, activity)",
    "sk AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(p, 12) DESC, activity) AS rk FROM ss WHERE p > 0)",
    "ans AS (SELECT x_sc.seq, x_sc.activity AS actual, x_sc.a1 AS bag, y_sc.a1 AS fpt, z_sc.a1 AS ngram_4, sk.activity AS soft "
    "FROM x_sc JOIN y_sc USING (seq) JOIN z_sc USING (seq) LEFT JOIN sk ON sk.seq = x_sc.seq AND sk.rk = 1)",
]


def _mixed(src) -> StreamingModels:
    folder = scratch_dir(src.spark, "stream_mixed")
    models = StreamingModels(src.spark, f"{folder}/model", MIXED, compact_every=2, strategies=SOFT)
    models.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    return models


@query("stream_soft_voting", with_(*MIXED_SQL, "SELECT seq, bag, fpt, ngram_4, soft FROM ans"))
def stream_soft_voting(src):
    """Sets, prefixes and n-grams that learn along a stream, and their soft vote."""
    rows = _mixed(src).predictions()
    return rows.select("seq", *[F.col(f"p_{n}.activity").alias(n) for n in (*MIXED, "soft")])


@query(
    "stream_evaluation",
    with_(
        *MIXED_SQL,
        " UNION ALL ".join(
            f"SELECT '{n}' AS model, count(*) AS total_predictions, count(*) FILTER ({n} = actual) AS correct_predictions, "
            f"count(*) FILTER ({n} IS NULL) AS missing_predictions, round(count(*) FILTER ({n} = actual) * 100.0 / count(*), 6) AS accuracy FROM ans"
            for n in (*MIXED, "soft")
        ),
    ),
)
def stream_evaluation(src):
    """Running evaluation of live members and their vote after the last batch."""
    return rounded(_mixed(src).evaluation().drop("top_k_correct_preds", "top_k_accuracy"), "accuracy")


# --------------------------------------------------------------------------------------------------------------
# combinations that go by earlier answers, and delays
# --------------------------------------------------------------------------------------------------------------

STEPS = ("ngram_2", "ngram_4", "ngram_3")
THRESHOLD, VOTES = 0.0, 2
ALONG = {
    "acc": Strategy(STEPS[:2], "adaptive", options={"select_best": "acc"}),
    "prob_acc": Strategy(STEPS[:2], "adaptive", options={"select_best": "prob x acc"}),
    "promotion": Strategy(STEPS, "promotion", options={"threshold": THRESHOLD, "min_votes": VOTES}),
}


def _along(src, names: list[str], **options) -> StreamingModels:
    folder = scratch_dir(src.spark, "stream_along")
    miners = LIVE | {"ngram_3": Miner(NGram(2))}
    models = StreamingModels(src.spark, f"{folder}/model", miners, compact_every=2, strategies={n: ALONG[n] for n in names}, **options)
    models.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    return models


def _so_far(n: str) -> str:
    return f"coalesce(sum(CASE WHEN {n}1 = activity THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(
    "stream_adaptive",
    with_(
        *m.base(EVENTS), *batched_sql(("ngram", 1), "x"), *batched_sql(("ngram", 3), "y"),
        "two AS (SELECT x_sc.seq, x_sc.activity, x_sc.a1 AS x1, y_sc.a1 AS y1, coalesce(x_rk.p, 0) AS xp, coalesce(y_rk.p, 0) AS yp FROM x_sc JOIN y_sc USING (seq) "
        "LEFT JOIN x_rk ON x_rk.s = x_sc.s AND x_rk.b = x_sc.b AND x_rk.rk = 1 LEFT JOIN y_rk ON y_rk.s = y_sc.s AND y_rk.b = y_sc.b AND y_rk.rk = 1)",
        f"sofar AS (SELECT *, {_so_far('x')} AS cx, {_so_far('y')} AS cy FROM two)",
        "SELECT seq, CASE WHEN cx >= cy THEN x1 ELSE y1 END AS acc, CASE WHEN round(xp * cx, 12) >= round(yp * cy, 12) THEN x1 ELSE y1 END AS prob_acc FROM sofar",
    ),
)
def stream_adaptive(src):
    """Votes of the member that has been right most often so far, live."""
    rows = _along(src, ["acc", "prob_acc"]).predictions()
    return rows.select("seq", F.col("p_acc.activity").alias("acc"), F.col("p_prob_acc.activity").alias("prob_acc"))


def late_sql(kind, n, since):
    """As :func:`batched_sql` for a member that learns from the events after ``since`` only."""
    first, *rest = batched_sql(kind, n)
    learned = [
        f"{n}_ln AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS k FROM {n}_tr WHERE seq > {since})",
        f"{n}_arr AS (SELECT n AS s, b FROM {n}_ln UNION ALL SELECT s, b FROM {n}_ln WHERE k = 1)",
    ]
    return [first, *learned, *[c.replace(f"JOIN {n}_tr d", f"JOIN {n}_ln d") for c in rest if not c.startswith(f"{n}_arr")]]


def stage_sql(k, now, nxt, since):
    return [
        f"j{k} AS (SELECT a.seq, CASE WHEN a.a1 = a.activity THEN 1 ELSE 0 END AS rn, CASE WHEN b.a1 = b.activity THEN 1 ELSE 0 END AS rx "
        f"FROM {now}_sc a JOIN {nxt}_sc b USING (seq) WHERE a.seq > {since})",
        f"g{k} AS (SELECT seq, sum(CASE WHEN rx > rn THEN 1 ELSE 0 END) OVER w AS votes, sum(rx) OVER w AS cx, sum(rn) OVER w AS cn, "
        f"count(*) OVER w AS n FROM j{k} WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING))",
        f"at{k} AS (SELECT coalesce(min(seq), 1000000000000000000) AS s FROM g{k} WHERE votes >= {VOTES} AND round(cx / n - cn / n, 12) > {THRESHOLD})",
    ]


@query(
    "stream_promotion",
    with_(
        *m.base(EVENTS), *batched_sql(("ngram", 1), "x"), *batched_sql(("ngram", 3), "y"), *stage_sql(1, "x", "y", -1),
        *late_sql(("ngram", 2), "z", "(SELECT s FROM at1)"), *stage_sql(2, "y", "z", "(SELECT s FROM at1)"),
        "SELECT x_sc.seq, CASE WHEN seq > (SELECT s FROM at2) THEN 2 WHEN seq > (SELECT s FROM at1) THEN 1 ELSE 0 END AS active, "
        "CASE WHEN seq > (SELECT s FROM at2) THEN z_sc.a1 WHEN seq > (SELECT s FROM at1) THEN y_sc.a1 ELSE x_sc.a1 END AS predicted "
        "FROM x_sc JOIN y_sc USING (seq) JOIN z_sc USING (seq)",
    ),
)
def stream_promotion(src):
    """Promotion on a live stream; the third member learns from the first promotion on."""
    rows = _along(src, ["promotion"]).predictions()
    return rows.select("seq", F.col("active_promotion").alias("active"), F.col("p_promotion.activity").alias("predicted"))


def _stats_sql(model: str, n: str) -> str:
    return (
        f"SELECT '{model}' AS model, CAST(b AS BIGINT) AS batch_id, CAST(sum(n) OVER w AS BIGINT) AS total_predictions, CAST(sum(c) OVER w AS BIGINT) AS correct_predictions, "
        f"CAST(sum(e) OVER w AS BIGINT) AS missing_predictions, round(100.0 * sum(c) OVER w / sum(n) OVER w, 6) AS accuracy FROM (SELECT b, count(*) AS n, "
        f"count(*) FILTER (a1 = activity) AS c, count(*) FILTER (a1 IS NULL) AS e FROM {n}_sc GROUP BY b) WINDOW w AS (ORDER BY b)"
    )


@query(
    "stream_stats_table",
    with_(
        *m.base(EVENTS), *batched_sql(("ngram", 1), "x"), *batched_sql(("ngram", 3), "y"),
        f"{_stats_sql('ngram_2', 'x')} UNION ALL {_stats_sql('ngram_4', 'y')}",
    ),
)
def stream_stats_table(src):
    """Running evaluation of live models after every batch."""
    folder = scratch_dir(src.spark, "stream_stats")
    models = StreamingModels(src.spark, f"{folder}/model", LIVE, compact_every=2, with_stats=True)
    models.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    columns = ("model", "batch_id", "total_predictions", "correct_predictions", "missing_predictions", "accuracy")
    return rounded(models.stats.read().select(*columns), "accuracy")


@query(
    "stream_delays",
    with_(
        *m.base(EVENTS), *batched_sql(("ngram", 1), "x")[:1],
        "t0 AS (SELECT *, lag(ts) OVER (PARTITION BY case_id ORDER BY pos) AS prev FROM x_tr)",
        "t1 AS (SELECT *, (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS actual FROM t0 WHERE prev IS NOT NULL)",
        "near AS (SELECT e.s, e.activity, e.b, d.actual, row_number() OVER (PARTITION BY e.s, e.activity, e.b ORDER BY d.seq DESC) AS k "
        "FROM (SELECT DISTINCT s, activity, b FROM t1) e JOIN t1 d ON d.s = e.s AND d.activity = e.activity AND d.b < e.b)",
        "mean AS (SELECT s, activity, b, avg(actual) AS delay_s FROM near WHERE k <= 50 GROUP BY ALL)",
        "SELECT seq, round(delay_s, 3) AS delay_s, round(actual, 6) AS actual_delay FROM t1 JOIN mean USING (s, activity, b)",
    ),
)
def stream_delays(src):
    """Delay that a live model expects of each event, by the last 50 delays of its state and activity before the batch."""
    folder = scratch_dir(src.spark, "stream_delays")
    models = StreamingModels(src.spark, f"{folder}/model", {"ngram_2": LIVE["ngram_2"]}, compact_every=2, with_delays=True)
    models.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    rows = models.delay_predictions("ngram_2")
    return rows.select("seq", F.round("delay_s", 3).alias("delay_s"), F.round("actual_delay", 6).alias("actual_delay"))


@query("stream_counts", with_(*m.base(EVENTS), *m.model(("ngram", 3)), "SELECT s AS state, activity, n AS next_state, f AS freq FROM freq"))
def stream_counts(src):
    rows = _live(src).transition_counts("ngram_4")
    return rows.select(joined(F.col("state")).alias("state"), "activity", joined(F.col("next_state")).alias("next_state"), "freq")


@query(
    "stream_compare",
    with_(
        *m.base(EVENTS), *batched_sql(("ngram", 1), "x"), *batched_sql(("ngram", 3), "y"),
        "pv AS (SELECT 'ngram_2' AS model, seq, activity AS actual, a1 AS predicted FROM x_sc WHERE a1 IS NOT NULL UNION ALL "
        "SELECT 'ngram_4', seq, activity, a1 FROM y_sc WHERE a1 IS NOT NULL)",
        "SELECT t.model AS tested, r.model AS reference, count(*) AS positions, "
        "round(100.0 * count(*) FILTER (r.predicted = r.actual AND t.predicted = t.actual) / count(*) FILTER (r.predicted = r.actual), 6) AS correlation, "
        "round(100.0 * count(*) FILTER (r.predicted <> r.actual AND t.predicted = t.actual) / count(*) FILTER (r.predicted <> r.actual), 6) AS anticorrelation, "
        "round(100.0 * count(*) FILTER (r.predicted = t.predicted) / count(*), 6) AS similarity FROM pv t JOIN pv r USING (seq) GROUP BY ALL",
    ),
)
def stream_compare(src):
    rows = _live(src).comparison().select("tested", "reference", "positions", "correlation", "anticorrelation", "similarity")
    return rounded(rows, "correlation", "anticorrelation", "similarity")


@query("stream_drift", drift_sql(SWITCH))
def stream_drift(src):
    folder = scratch_dir(src.spark, "stream_drift")
    drift = StreamingDrift(src.spark, f"{folder}/drift", "switch", start=3000)
    drift.start(event_stream(src, folder), f"{folder}/state").awaitTermination()
    rows = drift.log()
    return rows.select("step", "part", "case_id", "activity", F.col("ts").isNull().alias("no_ts"))


# --------------------------------------------------------------------------------------------------------------
# files
# --------------------------------------------------------------------------------------------------------------


@query("ingest_csv", with_(EVENTS, POSITIONS, LOG_OUT))
def ingest_csv(src):
    """The events table written as delimited text in a public layout and read back."""
    folder = scratch_dir(src.spark, "ingest_csv")
    spec = SPECS["bpi_2014"]
    rows = src.table("events").select(
        F.col("user_id").alias(spec.case_keys[0]), F.col("event_type").alias(spec.activity_keys[0]),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(spec.ts), F.col("event_id").alias("nr"),
    )
    rows.write.option("header", True).option("sep", spec.separator).csv(f"{folder}/log")
    log = read_csv_log(src.spark, f"{folder}/log", spec, seq="nr")
    from casewise.plans.preparation import events_out
    from casewise.operators.positions import positioned

    return events_out(positioned(log))


@query(
    "ingest_xes",
    with_(
        ORDERS, "ordered AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS pos FROM log)",
        "SELECT case_id, activity, ts, pos FROM ordered",
    ),
)
def ingest_xes(src):
    """The orders log written as XES traces and read back."""
    folder = scratch_dir(src.spark, "ingest_xes")
    log = src.orders()
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    pair = F.struct(F.lit("concept:name").alias("_key"), F.col("activity").alias("_value"))
    when = F.struct(F.lit("time:timestamp").alias("_key"), date.alias("_value"))
    event = F.struct(F.array(when).alias("date"), F.array(pair).alias("string"))
    traces = log.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("seq", event.alias("event"))))["event"].alias("event"))
    name = F.array(F.struct(F.lit("concept:name").alias("_key"), F.col("case_id").alias("_value")))
    traces.select(name.alias("string"), "event").write.format("xml").option("rootTag", "log").option("rowTag", "trace").save(f"{folder}/log")
    from casewise.plans.preparation import events_out
    from casewise.operators.positions import positioned

    return events_out(positioned(read_xes_log(src.spark, f"{folder}/log")))


@query(
    "run_summaries",
    with_(
        *m.base(ORDERS, split=True), *m.scored(("ngram", 1), "a_"), *m.scored(("ngram", 2), "b_"),
        "SELECT 'ngram_2' AS \"Model\", '2-gram' AS name, round(100.0 * count(*) FILTER (a1 = activity) / count(*), 6) AS accuracy FROM a_sc "
        "UNION ALL SELECT 'ngram_3', '3-gram', round(100.0 * count(*) FILTER (a1 = activity) / count(*), 6) FROM b_sc",
    ),
)
def run_summaries_query(src):
    """Two runs written as summaries, one of them under a name that does not match."""
    folder = scratch_dir(src.spark, "run_summaries")
    train, test = split_cases(src.orders(), 0.3)
    models = md.train_all(train, {"ngram_2": Miner(NGram(1)), "ngram_3": Miner(NGram(2))})
    for run, factor in (("real", 100.0), ("other", 1.0)):
        for name, model in models.items():
            row = evaluate(test, model).select(F.lit(name).alias("Model"), (F.col("correct") * factor / F.col("total")).alias("accuracy"))
            write_rows(row.coalesce(1), f"{folder}/{run}_{name}.csv")
    rows = run_summaries(src.spark, folder, ["real_"], {"ngram_2": "2-gram", "ngram_3": "3-gram"})
    return rounded(rows.select("Model", "name", "accuracy"), "accuracy")


# --------------------------------------------------------------------------------------------------------------
# given automaton, classifier
# --------------------------------------------------------------------------------------------------------------

# a small automaton over the order states: has the last finished order been followed by an open one?
AUTOMATON = [
    ("idle", "F", "done", 0.5), ("idle", "O", "open", 0.5),
    ("done", "F", "done", 0.6), ("done", "O", "open", 0.3), ("done", "__stop__", None, 0.1),
    ("open", "F", "done", 0.5), ("open", "O", "open", 0.2), ("open", "P", "open", 0.1), ("open", "__stop__", None, 0.2),
]
_VALUES = ", ".join(f"('{s}', '{a}', " + (f"'{t}'" if t else "NULL") + f", {p})" for s, a, t, p in AUTOMATON)


@query(
    "given_automaton",
    "WITH RECURSIVE " + with_(
        ORDERS, POSITIONS,
        f"au(state, activity, nxt, p) AS (VALUES {_VALUES})",
        "walk AS (SELECT case_id, pos, activity, 'idle' AS state FROM ev WHERE pos = 0 UNION ALL "
        "SELECT e.case_id, e.pos, e.activity, au.nxt FROM walk w JOIN ev e ON e.case_id = w.case_id AND e.pos = w.pos + 1 "
        "LEFT JOIN au ON au.state = w.state AND au.activity = w.activity)",
        "best AS (SELECT state, max_by(activity, p) AS predicted FROM au GROUP BY state)",
        "SELECT case_id, pos, w.state, b.predicted FROM walk w LEFT JOIN (SELECT state, activity AS predicted FROM au "
        "QUALIFY row_number() OVER (PARTITION BY state ORDER BY p DESC, activity) = 1) b ON w.state = b.state",
    ).removeprefix("WITH "),
)
def given_automaton(src):
    from casewise.config import Config
    from casewise.operators.predict import prediction

    table = src.spark.createDataFrame(AUTOMATON, "state string, activity string, next_state string, prob double")
    rows = walk_automaton(src.orders(), table, "idle", block=8)
    return rows.select("case_id", "pos", "state", prediction(F.col("dist"), Config())["activity"].alias("predicted"))


def _classified(src):
    log = src.orders()
    index = activity_index(log)
    parts = [prefix_windows(p, 3, "left", index, min_prefix=0) for p in split_three_way(log, 0.3, seed=2)]
    return cl.window_classifier(parts[0], parts[1], 3, index).score(parts[2])


@query("window_classifier")
def window_classifier(src):
    return _classified(src).select("case_id", "pos", "activity", F.col("prediction.activity").alias("predicted"))


@query("classifier_metrics")
def classifier_metrics(src):
    return cl.top_k_nll(_classified(src))


def _network(src):
    """A network on the last three activities of the orders, scored on held-out cases."""
    log = src.orders()
    index = activity_index(log)
    parts = [prefix_windows(p, 3, "left", index, min_prefix=0) for p in split_three_way(log, 0.3, seed=2)]
    return cl.window_network(parts[0], parts[1], 3, index, hidden=(16,), rounds=4).score(parts[2])


@query("network_perplexity")
def network_perplexity(src):
    return case_perplexity(_network(src))


@query("network_metrics")
def network_metrics(src):
    return cl.sequence_metrics(_network(src))
