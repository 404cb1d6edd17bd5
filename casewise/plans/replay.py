"""Queries on prequential evaluation and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.values import joined
from casewise.operators import ensembles as en
from casewise.operators import evaluate as ev
from casewise.operators import prequential as pq
from casewise.operators.drift import alter_log
from casewise.operators.models import Miner
from casewise.operators.predict import prediction
from casewise.operators.structures import Bag, NGram, PrefixTree
from casewise.plans import model_sql as m
from casewise.plans.registry import EVENTS, ORDERS, query, r6, rounded, with_
from casewise.sinks.tables import stats_rows

CONFIG = Config()
POOL = {
    "bag": (Miner(Bag()), ("bag",), 1),
    "w1": (Miner(NGram(1)), ("ngram", 1), 1),
    "w2": (Miner(NGram(2)), ("ngram", 2), 1),
    "w3g": (Miner(NGram(3), min_total_visits=10), ("ngram", 3), 10),
    "fpt": (Miner(PrefixTree()), ("fpt",), 1),
    "w0": (Miner(NGram(0)), ("ngram", 0), 1),
}


def replayed(log, *names, config=None, **options):
    return pq.prequential(log, {n: POOL[n][0] for n in names}, config or CONFIG, **options)


def member_sql(n, after=""):
    """CTEs <n>_tr, <n>_pp (event, activity, probability before the event), <n>_sc (a1, a2, a3, p1)."""
    _, kind, gate = POOL[n]
    return [
        f"{n}_tr AS (SELECT *, {m.state(kind)} AS s, {m.state(kind, after=True)} AS n FROM evs{after})",
        f"{n}_arr AS (SELECT n AS s, seq FROM {n}_tr UNION ALL SELECT '{m.initial(kind)}', seq FROM {n}_tr WHERE pos = 0)",
        f"{n}_vb AS (SELECT e.seq, count(*) AS v FROM {n}_tr e JOIN {n}_arr a ON a.s = e.s AND a.seq < e.seq GROUP BY e.seq)",
        f"{n}_fb AS (SELECT e.seq, d.activity, count(*) AS c FROM {n}_tr e JOIN {n}_tr d ON d.s = e.s AND d.seq < e.seq GROUP BY ALL)",
        f"{n}_pp AS (SELECT v.seq, f.activity, f.c / v.v AS p, v.v FROM {n}_vb v JOIN {n}_fb f USING (seq) WHERE v.v >= {gate} UNION ALL "
        f"SELECT v.seq, '__stop__', (v.v - coalesce(f.c, 0)) / v.v, v.v FROM {n}_vb v LEFT JOIN "
        f"(SELECT seq, sum(c) AS c FROM {n}_fb GROUP BY seq) f USING (seq) WHERE v.v >= {gate})",
        *[x.replace(f"{n}_probs", f"{n}_pp") for x in m.ranks(f"{n}_", "probs", "seq")],
        f"{n}_sc AS (SELECT e.case_id, e.pos, e.seq, e.activity, q.a1, q.a2, q.a3, q.p1 FROM {n}_tr e LEFT JOIN {n}_pred q USING (seq))",
    ]


ANSWERS = (
    "SELECT seq, a1 AS predicted, CASE WHEN a1 IS NOT NULL THEN concat_ws('|', a1, a2, a3) END AS top_k, round(p1, 6) AS probability FROM {n}_sc"
)


def answers(rows, p):
    return rows.select(
        "seq", p["activity"].alias("predicted"), joined(p["top_k"]).alias("top_k"), r6(p["probability"]).alias("probability")
    )


for _name, _member, _log in (
    ("prequential_ngram", "w2", "events"),
    ("prequential_gram0", "w0", "events"),
    ("prequential_bag", "bag", "orders"),
    ("prequential_fpt", "fpt", "orders"),
):

    def _replay(src, member=_member, log=_log):
        return answers(replayed(getattr(src, log)(), member), F.col(f"p_{member}"))

    query(
        _name,
        with_(*m.base(EVENTS if _log == "events" else ORDERS), *member_sql(_member), ANSWERS.format(n=_member)),
    )(_replay)


@query(
    "prequential_no_stop",
    with_(
        *m.base(ORDERS), *member_sql("bag")[:4],
        "fs AS (SELECT activity, min(seq) AS first FROM log GROUP BY activity)",
        "dep AS (SELECT seq, sum(c) AS c FROM bag_fb GROUP BY seq)",
        "pp AS (SELECT v.seq, k.activity, CASE WHEN d.c IS NULL THEN 1.0 / count(*) OVER (PARTITION BY v.seq) ELSE coalesce(f.c, 0) / d.c END AS p "
        "FROM bag_vb v JOIN fs k ON k.first < v.seq LEFT JOIN dep d ON d.seq = v.seq LEFT JOIN bag_fb f ON f.seq = v.seq AND f.activity = k.activity)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY round(p, 12) DESC, activity) AS rk FROM pp WHERE p > 0)",
        "pred AS (SELECT seq, max(activity) FILTER (rk = 1) AS a1, max(activity) FILTER (rk = 2) AS a2, max(activity) FILTER (rk = 3) AS a3, "
        "max(p) FILTER (rk = 1) AS p1 FROM rk GROUP BY seq)",
        "bag_sc AS (SELECT e.seq, q.* EXCLUDE (seq) FROM bag_tr e LEFT JOIN pred q USING (seq))",
        ANSWERS.format(n="bag"),
    ),
)
def prequential_no_stop(src):
    """Without STOP, a state that only ended cases so far shares its weight among the activities known by then."""
    return answers(replayed(src.orders(), "bag", config=Config(include_stop=False)), F.col("p_bag"))


MEMBERS = ("bag", "w1", "w3g")


def all_sql(names=MEMBERS, log=EVENTS):
    return [*m.base(log), *[x for n in names for x in member_sql(n)]]


@query(
    "prequential_soft",
    with_(
        *all_sql(),
        "dd AS (" + " UNION ALL ".join(f"SELECT seq, activity, p FROM {n}_pp" for n in MEMBERS) + ")",
        "ss_probs AS (SELECT seq, activity, sum(p) / sum(sum(p)) OVER (PARTITION BY seq) AS p FROM dd GROUP BY seq, activity)",
        *m.ranks("ss_", "probs", "seq"),
        "ss_sc AS (SELECT e.seq, q.* EXCLUDE (seq) FROM bag_tr e LEFT JOIN ss_pred q USING (seq))",
        ANSWERS.format(n="ss"),
    ),
)
def prequential_soft(src):
    rows = replayed(src.events(), *MEMBERS)
    return answers(rows, prediction(en.soft_voting([F.col(f"d_{n}") for n in MEMBERS]), CONFIG))


CHAIN = ("w3g", "w1")


@query(
    "prequential_fallback",
    with_(
        *all_sql(CHAIN),
        "SELECT a.seq, coalesce(a.a1, b.a1) AS predicted, CASE WHEN a.a1 IS NOT NULL THEN concat_ws('|', a.a1, a.a2, a.a3) "
        "WHEN b.a1 IS NOT NULL THEN concat_ws('|', b.a1, b.a2, b.a3) END AS top_k, round(coalesce(a.p1, b.p1), 6) AS probability "
        "FROM w3g_sc a JOIN w1_sc b USING (seq)",
    ),
)
def prequential_fallback(src):
    rows = replayed(src.events(), *CHAIN)
    return answers(rows, prediction(en.fallback([F.col(f"d_{n}") for n in CHAIN]), CONFIG))


@query(
    "prequential_hard",
    with_(
        *all_sql(),
        "votes AS (" + " UNION ALL ".join(f"SELECT {i} AS i, seq, a1 FROM {n}_sc WHERE a1 IS NOT NULL" for i, n in enumerate(MEMBERS)) + ")",
        "win AS (SELECT seq, a1 FROM (SELECT seq, a1, count(*) AS n, min(i) AS f FROM votes GROUP BY ALL) QUALIFY "
        "row_number() OVER (PARTITION BY seq ORDER BY n DESC, f) = 1)",
        "SELECT e.seq, w.a1 AS predicted FROM bag_tr e LEFT JOIN win w USING (seq)",
    ),
)
def prequential_hard(src):
    rows = replayed(src.events(), *MEMBERS)
    dist = en.hard_voting([F.col(f"p_{n}.activity") for n in MEMBERS], CONFIG.stop_symbol)
    return rows.select("seq", prediction(dist, CONFIG)["activity"].alias("predicted"))


@query(
    "prequential_adaptive",
    with_(
        *all_sql(),
        "j AS (SELECT a.seq, a.activity, a.a1 AS x0, b.a1 AS x1, c.a1 AS x2 FROM bag_sc a JOIN w1_sc b USING (seq) JOIN w3g_sc c USING (seq))",
        "k AS (SELECT *, " + ", ".join(
            f"coalesce(sum(CASE WHEN x{i} = activity THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c{i}"
            for i in range(3)
        ) + " FROM j)",
        "SELECT seq, CASE WHEN c0 >= c1 AND c0 >= c2 THEN x0 WHEN c1 >= c2 THEN x1 ELSE x2 END AS predicted FROM k",
    ),
)
def prequential_adaptive(src):
    rows = pq.adaptive_live(replayed(src.events(), *MEMBERS), list(MEMBERS))
    return rows.select("seq", F.col("p_dist.activity").alias("predicted"))


@query(
    "live_accuracy",
    with_(
        *all_sql(CHAIN),
        " UNION ALL ".join(
            f"SELECT row_number() OVER w AS \"index\", seq, '{n}' AS model, round(sum(CASE WHEN a1 = activity THEN 1 ELSE 0 END) OVER w / "
            f"row_number() OVER w, 6) AS accuracy FROM {n}_sc WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)"
            for n in CHAIN
        ),
    ),
)
def live_accuracy(src):
    return rounded(pq.live_accuracy(replayed(src.events(), *CHAIN), list(CHAIN)), "accuracy")


THRESHOLD, VOTES = 0.0005, 5
LADDER = ("w0", "w1", "w2")


def ladder_sql():
    """Three members; the last one starts to learn after the first promotion."""
    def stage(k, now, nxt, start):
        return [
            f"j{k} AS (SELECT a.seq, CASE WHEN a.a1 = a.activity THEN 1 ELSE 0 END AS rn, CASE WHEN b.a1 = b.activity THEN 1 ELSE 0 END AS rx "
            f"FROM {now}_sc a JOIN {nxt}_sc b USING (seq) WHERE a.seq > {start})",
            f"g{k} AS (SELECT seq, sum(CASE WHEN rx > rn THEN 1 ELSE 0 END) OVER w AS votes, sum(rx) OVER w AS cx, sum(rn) OVER w AS cn, "
            f"count(*) OVER w AS n FROM j{k} WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING))",
            f"at{k} AS (SELECT coalesce(min(seq), 1000000000000000000) AS s FROM g{k} WHERE votes >= {VOTES} AND round(cx / n - cn / n, 12) > {THRESHOLD})",
        ]

    return [
        *m.base(EVENTS), *member_sql("w0"), *member_sql("w1"), *stage(1, "w0", "w1", -1),
        "logx AS (SELECT case_id, activity, ts, seq FROM log WHERE seq > (SELECT s FROM at1))",
        "evx AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) - 1 AS pos FROM logx)",
        *[x.replace("FROM evsx", "FROM evx") for x in member_sql("w2", "x")],
        *stage(2, "w1", "w2", "(SELECT s FROM at1)"),
    ]


@query(
    "promotion_stream",
    with_(
        *ladder_sql(),
        "SELECT a.seq, CASE WHEN a.seq > (SELECT s FROM at2) THEN 2 WHEN a.seq > (SELECT s FROM at1) THEN 1 ELSE 0 END AS active, "
        "CASE WHEN a.seq > (SELECT s FROM at2) THEN c.a1 WHEN a.seq > (SELECT s FROM at1) THEN b.a1 ELSE a.a1 END AS predicted "
        "FROM w0_sc a JOIN w1_sc b USING (seq) LEFT JOIN w2_sc c USING (seq)",
    ),
)
def promotion_stream(src):
    rows = pq.promotion_live(src.events(), {n: POOL[n][0] for n in LADDER}, CONFIG, THRESHOLD, VOTES)
    return rows.select("seq", "active", F.col("prediction.activity").alias("predicted"))


RUNNING = (
    "SELECT row_number() OVER w AS \"index\", CAST(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct_predictions, "
    "CAST(sum(CASE WHEN a1 IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS missing_predictions, "
    "CAST(sum(CASE WHEN activity IN (a1, a2, a3) THEN 1 ELSE 0 END) OVER w AS BIGINT) AS top_k_correct_preds, "
    "round(100.0 * sum(CASE WHEN {hit} THEN 1 ELSE 0 END) OVER w / row_number() OVER w, 6) AS accuracy, "
    "round(100.0 * sum(CASE WHEN activity IN (a1, a2, a3) THEN 1 ELSE 0 END) OVER w / row_number() OVER w, 6) AS top_k_accuracy "
    "FROM w2_sc WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)"
)
COLUMNS = ["index", "correct_predictions", "missing_predictions", "top_k_correct_preds", "accuracy", "top_k_accuracy"]

for _name, _top, _hit in (("running_evaluation", False, "a1 = activity"), ("running_evaluation_topk", True, "activity IN (a1, a2, a3)")):

    def _running(src, top=_top):
        rows = pq.running_evaluation(replayed(src.events(), "w2"), "p_w2", top_activities=top)
        return rounded(rows.select(*COLUMNS), "accuracy", "top_k_accuracy")

    query(_name, with_(*m.base(EVENTS), *member_sql("w2"), RUNNING.format(hit=_hit)))(_running)


@query(
    "evaluation_snapshots",
    with_(
        *m.base(EVENTS), *member_sql("w2"), f"r AS ({RUNNING.format(hit='a1 = activity')})",
        "SELECT * FROM r WHERE \"index\" % 100 = 0 OR \"index\" = (SELECT max(\"index\") FROM r)",
    ),
)
def evaluation_snapshots(src):
    rows = pq.snapshot_every(pq.running_evaluation(replayed(src.events(), "w2"), "p_w2"), 100)
    return rounded(rows.select(*COLUMNS), "accuracy", "top_k_accuracy")


def stream_sql(places):
    def one(n):
        return (
            f"SELECT row_number() OVER w AS \"index\", '{n}' AS model, CAST(sum(CASE WHEN a1 = activity THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct_predictions, "
            f"CAST(sum(CASE WHEN a1 IS NULL THEN 1 ELSE 0 END) OVER w AS BIGINT) AS missing_predictions, row_number() OVER w AS total_predictions, "
            f"round(100.0 * sum(CASE WHEN a1 = activity THEN 1 ELSE 0 END) OVER w / row_number() OVER w, {places}) AS accuracy, "
            f"round(100.0 * sum(CASE WHEN activity IN (a1, a2, a3) THEN 1 ELSE 0 END) OVER w / row_number() OVER w, {places}) AS top_k_accuracy "
            f"FROM {n}_sc WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)"
        )

    return "r AS (" + " UNION ALL ".join(one(n) for n in ("bag", "w1", "w2")) + ")"


TRIO = ("bag", "w1", "w2")


@query(
    "multi_model_stream",
    with_(
        *all_sql(TRIO, ORDERS), stream_sql(2),
        "SELECT * FROM r WHERE \"index\" % 100 = 0 OR \"index\" = (SELECT max(\"index\") FROM r)",
    ),
)
def multi_model_stream(src):
    wide = pq.snapshot_every(pq.wide_evaluation(replayed(src.orders(), *TRIO), list(TRIO)), 100)
    return stats_rows(wide, ["index"])


@query(
    "stats_table",
    with_(
        *all_sql(TRIO, ORDERS), stream_sql(2),
        "SELECT * FROM r WHERE \"index\" % 1000 = 0 OR \"index\" = (SELECT max(\"index\") FROM r)",
    ),
)
def stats_table(src):
    wide = pq.snapshot_every(pq.wide_evaluation(replayed(src.orders(), *TRIO), list(TRIO)), 1000)
    return stats_rows(wide, ["index"])


DELAY = [
    "t0 AS (SELECT *, lag(ts) OVER (PARTITION BY case_id ORDER BY pos) AS prev FROM w1_tr)",
    "t1 AS (SELECT *, (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS actual FROM t0 WHERE prev IS NOT NULL)",
    "t2 AS (SELECT case_id, pos, seq, activity, actual, avg(actual) OVER (PARTITION BY s, activity ORDER BY seq ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS d FROM t1)",
]


@query(
    "prequential_delays",
    with_(
        *m.base(EVENTS), *member_sql("w1")[:1], *DELAY,
        "SELECT seq, round(d, 3) AS delay_s, round(actual, 6) AS actual_delay FROM t2 WHERE d IS NOT NULL",
    ),
)
def prequential_delays(src):
    rows = pq.prequential_delays(src.events(), Miner(NGram(1)))
    return rows.select("seq", F.round("delay_s", 3).alias("delay_s"), r6(F.col("actual_delay")).alias("actual_delay"))


@query(
    "running_delay_evaluation",
    with_(
        *m.base(EVENTS), *member_sql("w1"), *DELAY,
        "x AS (SELECT c.seq, t2.d, t2.actual FROM w1_sc c LEFT JOIN t2 ON t2.seq = c.seq AND t2.d IS NOT NULL)",
        "SELECT row_number() OVER w AS \"index\", count(d) OVER w AS delay_predictions, round(avg(abs(d - actual)) OVER w, 3) AS mean_delay_error, "
        "round(avg(CASE WHEN d IS NOT NULL THEN actual END) OVER w, 3) AS mean_actual_delay, "
        "round(avg(abs(d - actual) / (d + actual)) OVER w, 5) AS mean_normalized_error FROM x WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)",
    ),
)
def running_delay_evaluation(src):
    log = src.events()
    rows = pq.running_evaluation(replayed(log, "w1"), "p_w1", delays=pq.prequential_delays(log, Miner(NGram(1))))
    return rows.select(
        "index", "delay_predictions", F.round("mean_delay_error", 3).alias("mean_delay_error"),
        F.round("mean_actual_delay", 3).alias("mean_actual_delay"), F.round("mean_normalized_error", 5).alias("mean_normalized_error"),
    )


@query(
    "prequential_perplexity",
    with_(
        *m.base(ORDERS), *member_sql("w2"),
        "l AS (SELECT c.case_id, coalesce(p.p, 0) AS likelihood FROM w2_sc c LEFT JOIN w2_pp p ON p.seq = c.seq AND p.activity = c.activity)",
        "SELECT case_id, round(CASE WHEN min(likelihood) <= 0 THEN CAST('inf' AS DOUBLE) ELSE exp(-avg(ln(CASE WHEN likelihood > 0 THEN likelihood END))) END, 6) "
        "AS perplexity FROM l GROUP BY case_id",
    ),
)
def prequential_perplexity(src):
    rows = replayed(src.orders(), "w2", likelihood=True).withColumnRenamed("l_w2", "likelihood")
    return rounded(ev.case_perplexity(rows), "perplexity")


# --------------------------------------------------------------------------------------------------------------
# drift
# --------------------------------------------------------------------------------------------------------------

DRIFT = [
    EVENTS,
    "st AS (SELECT *, row_number() OVER (ORDER BY seq) AS step FROM log)",
    "kinds AS (SELECT activity AS k, min(step) AS first FROM st WHERE step >= {start} GROUP BY activity)",
    "cnt AS (SELECT st.*, k, first, sum(CASE WHEN activity = k AND step >= {start} THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY step) AS n FROM st CROSS JOIN kinds)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY n DESC, first) AS r FROM cnt WHERE n > 0)",
    "top AS (SELECT step, max(k) FILTER (r = 1) AS a1, max(k) FILTER (r = 2) AS a2 FROM rk GROUP BY step)",
    "x AS (SELECT st.*, a1, a2, step >= {start} AND {hit} AS hit FROM st LEFT JOIN top USING (step))",
]
PLAIN = "SELECT step, 0 AS part, case_id, activity, ts IS NULL AS no_ts FROM x"


def drift_sql(final, hit="true", start=3000):
    return with_(*[d.format(start=start, hit=hit) for d in DRIFT], final)


def drifted(src, kind, **options):
    rows = alter_log(src.events(), kind, start=3000, **options)
    return rows.select("step", "part", "case_id", "activity", F.col("ts").isNull().alias("no_ts"))


SWITCH = (
    "SELECT step, 0 AS part, case_id, CASE WHEN hit AND a2 IS NOT NULL AND activity = a1 THEN a2 WHEN hit AND a2 IS NOT NULL AND activity = a2 THEN a1 "
    "ELSE activity END AS activity, false AS no_ts FROM x"
)


@query("drift_switch", drift_sql(SWITCH))
def drift_switch(src):
    return drifted(src, "switch")


@query("drift_insert", drift_sql(PLAIN + " UNION ALL SELECT step, -1, case_id, 'A_new', true FROM x WHERE hit"))
def drift_insert(src):
    return drifted(src, "insert")


@query("drift_split", drift_sql(PLAIN + " UNION ALL SELECT step, 1, case_id, a1 || '_post', true FROM x WHERE hit AND activity = a1"))
def drift_split(src):
    return drifted(src, "split")


@query("drift_delete", drift_sql(PLAIN + " WHERE NOT (hit AND activity = a1)"))
def drift_delete(src):
    return drifted(src, "delete")


RAMP = (
    "CAST('0x' || substr(md5(step || '#4'), 1, 8) AS BIGINT) / 4294967296.0 < least(1.0, greatest(0.0, (step - 3000) / 4000.0)) * 0.8"
)


@query("drift_ramp", drift_sql(SWITCH, RAMP))
def drift_ramp(src):
    return drifted(src, "switch", rate=0.8, transition=4000, seed=4)
