"""Queries on model comparison and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from casewise.operators import compare as cp
from casewise.operators import evaluate as ev
from casewise.operators import models as md
from casewise.operators.models import Miner
from casewise.operators.prepare import evaluation_index, split_cases
from casewise.operators.structures import Bag, NGram
from casewise.plans import model_sql as m
from casewise.plans.learning import trained
from casewise.plans.registry import EVENTS, ORDERS, POSITIONS, query, rounded, with_
from casewise.plans.voting import member_frame, members_sql
from casewise.sinks import tables as out

MODELS = {"bag": "bag", "ngram_3": "w2", "ngram_4": "w3", "ngram_5": "w4"}
NAMES = tuple(MODELS.values())


def voted(src):
    rows = member_frame(src.orders(), NAMES)
    votes = cp.vote_array({n: F.col(f"p_{p}.activity") for n, p in MODELS.items()})
    return rows.select("case_id", "case_seq", "case_chunk", "pos", F.col("activity").alias("actual"), votes.alias("votes"))


LONG = (
    "pv AS (" + " UNION ALL ".join(
        f"SELECT '{n}' AS model, g.case_id, g.pos, g.activity AS actual, coalesce(CASE WHEN NOT gone THEN s.a1 END, '__empty__') AS predicted "
        f"FROM gone g JOIN {p}_sc s USING (case_id, pos)"
        for n, p in MODELS.items()
    ) + ")"
)
WITH_ACTUAL = "pa AS (SELECT * FROM pv UNION ALL SELECT DISTINCT 'actual', case_id, pos, actual, actual FROM pv)"


def pairs_sql(source, empty=False, by=""):
    keep = "" if empty else "WHERE t.predicted <> '__empty__' AND r.predicted <> '__empty__'"
    return (
        f"pc AS (SELECT {by} t.model AS tested, r.model AS reference, count(*) AS positions, count(*) FILTER (r.predicted = r.actual) AS ref_correct, "
        f"count(*) FILTER (r.predicted = r.actual AND t.predicted = t.actual) AS both_correct, count(*) FILTER (r.predicted <> r.actual) AS ref_incorrect, "
        f"count(*) FILTER (r.predicted <> r.actual AND t.predicted = t.actual) AS tested_only, count(*) FILTER (r.predicted = t.predicted) AS matches "
        f"FROM {source} t JOIN {source} r USING (case_id, pos) {keep} GROUP BY ALL)"
    )


RATIOS = (
    "*, round({k} * both_correct / nullif(ref_correct, 0), 6) AS correlation, "
    "round({k} * tested_only / nullif(ref_incorrect, 0), 6) AS anticorrelation, round({k} * matches / nullif(positions, 0), 6) AS similarity"
)
MEASURES = ("correlation", "anticorrelation", "similarity")


for _name, _empty in (("compare_pair", False), ("compare_pair_with_empty", True)):

    def _pair(src, empty=_empty):
        return rounded(cp.compare_models(voted(src), "ngram_4", "bag", include_empty=empty), *MEASURES)

    query(
        _name,
        with_(
            *members_sql(ORDERS, NAMES), LONG, pairs_sql("pv", _empty),
            f"SELECT {RATIOS.format(k='1.0')} FROM pc WHERE tested = 'ngram_4' AND reference = 'bag'",
        ),
    )(_pair)


@query(
    "comparison_matrix",
    with_(*members_sql(ORDERS, NAMES), LONG, WITH_ACTUAL, pairs_sql("pa"), f"SELECT {RATIOS.format(k='100.0')} FROM pc"),
)
def comparison_matrix(src):
    return rounded(cp.comparison_matrix(voted(src)), *MEASURES)


@query(
    "versus_reference",
    with_(
        *members_sql(ORDERS, NAMES), LONG, pairs_sql("pv"),
        f"SELECT {RATIOS.format(k='100.0')} FROM pc WHERE reference = 'ngram_3'",
    ),
)
def versus_reference(src):
    return rounded(cp.versus_reference(voted(src), list(MODELS)), *MEASURES)


@query(
    "align_predictions",
    with_(
        *members_sql(ORDERS, ("bag", "w2")),
        "ix AS (SELECT *, row_number() OVER (ORDER BY case_seq, pos) AS step FROM gone)",
        "SELECT step, g.activity AS actual, 'bag=' || coalesce(CASE WHEN NOT gone THEN b.a1 END, '__empty__') || '|ngram_3=' || "
        "coalesce(CASE WHEN NOT gone THEN w.a1 END, '__empty__') AS votes FROM ix g JOIN bag_sc b USING (case_id, pos) JOIN w2_sc w USING (case_id, pos)",
    ),
)
def align_predictions(src):
    rows = evaluation_index(member_frame(src.orders(), ("bag", "w2")), "step")
    one = {n: rows.select("step", F.col(f"p_{p}.activity").alias("predicted")) for n, p in (("bag", "bag"), ("ngram_3", "w2"))}
    aligned = cp.align_predictions(one, rows.select("step", F.col("activity").alias("actual")))
    text = F.array_join(F.transform("votes", lambda v: F.concat(v["model"], F.lit("="), v["predicted"])), "|")
    return aligned.select("step", "actual", text.alias("votes"))


CURVE = [
    *members_sql(ORDERS, ("bag", "w2")),
    "ix AS (SELECT *, row_number() OVER (ORDER BY case_seq, pos) AS step FROM gone)",
    "pr AS (SELECT step, g.activity AS actual, CASE WHEN NOT gone THEN w.a1 END AS t, CASE WHEN NOT gone THEN b.a1 END AS r FROM ix g "
    "JOIN bag_sc b USING (case_id, pos) JOIN w2_sc w USING (case_id, pos))",
    "lv AS (SELECT *, row_number() OVER (ORDER BY step) AS i FROM pr WHERE t IS NOT NULL AND r IS NOT NULL)",
]


def curve_sql(frame, width):
    def s(test):
        return f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) OVER w"

    return with_(
        *CURVE,
        f"cu AS (SELECT i AS t, {s('r = actual')} AS rc, {s('r = actual AND t = actual')} AS bc, {s('r <> actual')} AS ri, "
        f"{s('r <> actual AND t = actual')} AS tr, {s('t = r')} AS mt, {s('t = actual')} AS tc FROM lv "
        f"WINDOW w AS (ORDER BY i ROWS {frame}))",
        f"SELECT t, round(bc / nullif(rc, 0), 6) AS correlation, round(tr / nullif(ri, 0), 6) AS anticorrelation, "
        f"round(mt / {width}, 6) AS similarity, round(tc / {width}, 6) AS accuracy FROM cu WHERE t % 100 = 0",
    )


for _name, _horizon, _sql in (
    ("curves_cumulative", None, curve_sql("UNBOUNDED PRECEDING", "t")),
    ("curves_horizon", 250, curve_sql("BETWEEN 249 PRECEDING AND CURRENT ROW", "least(t, 250)")),
):

    def _curve(src, horizon=_horizon):
        rows = evaluation_index(member_frame(src.orders(), ("bag", "w2")), "step")
        steps = rows.select(
            "step", F.col("activity").alias("actual"),
            F.coalesce("p_w2.activity", F.lit("__empty__")).alias("tested"),
            F.coalesce("p_bag.activity", F.lit("__empty__")).alias("reference"),
        )
        return rounded(cp.comparison_curves(steps, 100, horizon), *MEASURES, "accuracy")

    query(_name, _sql)(_curve)


GRAMS = (1, 2, 3)


@query(
    "accuracy_by_window",
    with_(
        *m.base(ORDERS, split=True), *[x for w in GRAMS for x in m.scored(("ngram", w), f"w{w}_")],
        " UNION ALL ".join(
            f"SELECT 'ngram' AS family, {w} AS \"window\", round(100.0 * count(*) FILTER (a1 = activity) / count(*), 6) AS accuracy_pct FROM w{w}_sc"
            for w in GRAMS
        ),
    ),
)
def accuracy_by_window(src):
    train, test = split_cases(src.orders(), 0.3)
    models = md.train_all(train, {f"ngram_{w + 1}": Miner(NGram(w)) for w in GRAMS})
    scores = reduce(
        lambda a, b: a.unionByName(b),
        [ev.evaluate(test, mo).select(F.lit(n).alias("model"), (F.col("correct") / F.col("total")).alias("accuracy")) for n, mo in models.items()],
    )
    return rounded(cp.accuracy_by_window(scores), "accuracy_pct")


@query(
    "model_scores",
    with_(
        *m.base(ORDERS, split=True), *m.scored(("ngram", 2), "a_"), *m.scored(("bag",), "b_"),
        " UNION ALL ".join(
            f"SELECT '{n}' AS strategy, round(count(*) FILTER (a1 = activity) / count(*), 6) AS accuracy, "
            f"round(100.0 * count(*) FILTER (a1 = activity) / count(*), 6) AS accuracy_pct FROM {p}_sc"
            for n, p in (("ngram_3", "a"), ("bag", "b"))
        ),
    ),
)
def model_scores(src):
    train, test = split_cases(src.orders(), 0.3)
    models = md.train_all(train, {"ngram_3": Miner(NGram(2)), "bag": Miner(Bag())})
    stats = reduce(
        lambda a, b: a.unionByName(b), [ev.evaluate(test, mo).withColumn("strategy", F.lit(n)) for n, mo in models.items()]
    )
    return rounded(ev.model_scores(stats), "accuracy", "accuracy_pct")


def seed_sql(seed):
    return [
        f"r{seed} AS (SELECT *, row_number() OVER (ORDER BY md5(case_id || '#{seed}')) AS r, count(*) OVER () AS n FROM cases)",
        f"evs{seed} AS (SELECT ev.*, r <= floor(n * 0.7) AS train FROM ev JOIN r{seed} USING (case_id))",
        f"tev{seed} AS (SELECT case_id, case_seq, pos, activity, ts FROM evs{seed} WHERE NOT train UNION ALL "
        f"SELECT DISTINCT case_id, case_seq, case_len, '__stop__', CAST(NULL AS TIMESTAMP) FROM evs{seed} WHERE NOT train)",
        *[
            x.replace("FROM evs ", f"FROM evs{seed} ").replace("FROM tev", f"FROM tev{seed}")
            for x in m.scored(("ngram", 2), f"s{seed}_")
        ],
    ]


@query(
    "results_summary",
    with_(
        ORDERS, POSITIONS, "cases AS (SELECT case_id, min(seq) AS case_seq FROM log GROUP BY case_id)",
        *seed_sql(0), *seed_sql(1),
        "it AS (" + " UNION ALL ".join(
            f"SELECT count(*) FILTER (a1 = activity) / count(*) AS acc, count(*) AS total FROM s{s}_sc" for s in (0, 1)
        ) + ")",
        "SELECT 'ngram_3' AS model, round(100 * avg(acc), 6) AS mean_accuracy_pct, round(100 * stddev_pop(acc), 6) AS std_pct, "
        "round(avg(total), 6) AS mean_total FROM it",
    ),
)
def results_summary(src):
    rows = []
    for seed in (0, 1):
        train, test = split_cases(src.orders(), 0.3, shuffle=True, seed=seed)
        got = ev.evaluate(test, md.train(train, Miner(NGram(2))))
        rows.append(got.select(F.lit("ngram_3").alias("model"), F.lit(seed).alias("iteration"), (F.col("correct") / F.col("total")).alias("accuracy"), "total"))
    return rounded(out.results_summary(rows[0].unionByName(rows[1])), "mean_accuracy_pct", "std_pct", "mean_total")


AUTOMATON = [*m.base(ORDERS), *m.model(("ngram", 2))]


@query(
    "automaton_edges",
    with_(
        *AUTOMATON,
        "SELECT f.s AS state, f.activity, f.n AS next_state, f.f AS occurrences, round(f.f / d.dep, 6) AS frequency FROM freq f JOIN dep d ON f.s = d.s",
    ),
)
def automaton_edges(src):
    return rounded(out.automaton_edges(md.train(src.orders(), Miner(NGram(2)))), "frequency")


@query(
    "automaton_nodes",
    with_(*AUTOMATON, m.access(("ngram", 2)), "SELECT a.s AS state, coalesce(d.visits, 0) AS total_visits FROM acc a LEFT JOIN dep d ON a.s = d.s"),
)
def automaton_nodes(src):
    return out.automaton_nodes(md.train(src.orders(), Miner(NGram(2))))


@query(
    "prediction_rows",
    with_(
        *m.base(EVENTS, split=True), *m.scored(("ngram", 3)),
        "SELECT row_number() OVER (ORDER BY case_seq, pos) AS step, case_id, ts AS \"timestamp\", activity AS actual, a1 AS predicted, "
        "CASE WHEN a1 IS NOT NULL THEN concat_ws('|', a1, a2, a3) END AS top_k, CAST(a1 = activity AS INTEGER) AS correct FROM sc",
    ),
)
def prediction_rows(src):
    model, test = trained(src.events(), NGram(3))
    rows = out.prediction_rows(evaluation_index(ev.score(test, model), "step"))
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query(
    "actual_rows",
    with_(EVENTS, "SELECT row_number() OVER (ORDER BY seq) AS step, case_id, ts AS \"timestamp\", activity AS actual FROM log"),
)
def actual_rows(src):
    rows = out.actual_rows(cp.number_steps(src.events(), ["seq"]))
    return rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
