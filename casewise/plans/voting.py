"""Queries on ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.config import Config
from casewise.operators import ensembles as en
from casewise.operators.models import Miner, train_all
from casewise.operators.prepare import split_cases
from casewise.operators.predict import prediction
from casewise.operators.structures import Bag, NGram, PrefixTree
from casewise.plans import model_sql as m
from casewise.plans.experiment import evaluate_strategies
from casewise.plans.registry import CONVERSATIONS, EVENTS, ORDERS, query, r6, rounded, with_

CONFIG = Config()
GATE = 10

#: member name -> (miner, state kind of the SQL counterpart, gate)
POOL = {
    "bag": (Miner(Bag()), ("bag",), 1),
    "fpt": (Miner(PrefixTree(), min_total_visits=GATE), ("fpt",), GATE),
    "w1": (Miner(NGram(1)), ("ngram", 1), 1),
    "w2": (Miner(NGram(2)), ("ngram", 2), 1),
    "w3": (Miner(NGram(3)), ("ngram", 3), 1),
    "w4": (Miner(NGram(4)), ("ngram", 4), 1),
    "w2g": (Miner(NGram(2), min_total_visits=GATE), ("ngram", 2), GATE),
    "w3g": (Miner(NGram(3), min_total_visits=GATE), ("ngram", 3), GATE),
    "w4g": (Miner(NGram(4), min_total_visits=GATE), ("ngram", 4), GATE),
}
FIVE = ("bag", "fpt", "w2", "w3", "w4")
STAR = ("bag", "fpt", "w2g", "w3g", "w4g")
GRAMS = ("w2", "w3", "w4")


def member_frame(log, names, **options):
    train, test = split_cases(log, 0.3)
    models = train_all(train, {n: POOL[n][0] for n in names}, CONFIG, with_delays=options.get("delays", False))
    return en.member_rows(test, models, **options)


def members_sql(log, names):
    """CTEs with, for every member, <m>_sc (position, state, own prediction) and <m>_probs, and ``gone``."""
    parts = m.base(log, split=True)
    for n in names:
        parts += m.scored(POOL[n][1], f"{n}_", POOL[n][2])
    joins = " ".join(f"JOIN {n}_look USING (case_id, pos)" for n in names[1:])
    lost = " AND ".join(f"{n}_look.s IS NULL" for n in names)
    parts.append(
        f"gone AS (SELECT case_id, pos, activity, case_seq, bool_or(lost) OVER (PARTITION BY case_id ORDER BY pos) AS gone FROM "
        f"(SELECT case_id, pos, {names[0]}_look.activity, {names[0]}_look.case_seq, {lost} AS lost FROM {names[0]}_look {joins}))"
    )
    return parts


def dist_sql(names, weights=None):
    """CTE ``dd``: member index, position, activity, probability of live positions."""
    weights = weights or [1] * len(names)
    return "dd AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, {w} AS w, g.case_id, g.pos, q.activity, q.p FROM gone g JOIN {n}_look l USING (case_id, pos) "
        f"JOIN {n}_probs q ON l.s = q.s WHERE NOT g.gone"
        for i, (n, w) in enumerate(zip(names, weights))
    ) + ")"


FINAL = (
    "SELECT g.case_id, g.pos, p.a1 AS predicted, round(p.p1, 6) AS probability FROM gone g LEFT JOIN pred p USING (case_id, pos)"
)


def ranked(source):
    return [
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, pos ORDER BY round(p, 12) DESC, activity) AS rk FROM {source})",
        "pred AS (SELECT case_id, pos, max(activity) FILTER (rk = 1) AS a1, max(activity) FILTER (rk = 2 AND p > 0) AS a2, "
        "max(activity) FILTER (rk = 3 AND p > 0) AS a3, max(p) FILTER (rk = 1) AS p1 FROM rk GROUP BY ALL)",
    ]


def voted(rows, names, dist):
    """Answers of a vote that depends on the member answers only."""
    rows = en.vote_once(rows, list(names), {"_p": prediction(dist, CONFIG)})
    return rows.select("case_id", "pos", F.col("_p.activity").alias("predicted"), r6(F.col("_p.probability")).alias("probability"))


SOFT = (
    "soft AS (SELECT case_id, pos, activity, sum(w * p) / sum(sum(w * p)) OVER (PARTITION BY case_id, pos) AS p FROM dd "
    "GROUP BY case_id, pos, activity)"
)

for _name, _names, _weights in (
    ("soft_voting", FIVE, None),
    ("soft_voting_weighted", FIVE, [3.0, 0.5, 1.0, 2.0, 1.0]),
    ("soft_voting_star", STAR, None),
):

    def _soft(src, names=_names, weights=_weights):
        rows = member_frame(src.orders(), names)
        return voted(rows, names, en.soft_voting([F.col(f"d_{n}") for n in names], weights))

    query(
        _name,
        with_(*members_sql(ORDERS, _names), dist_sql(_names, _weights), SOFT, *ranked("soft"), FINAL),
    )(_soft)


HARD = [
    "votes AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, g.case_id, g.pos, s.a1 AS activity FROM gone g JOIN {n}_sc s USING (case_id, pos) "
        "WHERE NOT g.gone AND s.a1 IS NOT NULL"
        for i, n in enumerate(FIVE)
    ) + ")",
    "tally AS (SELECT case_id, pos, activity, count(*) AS n, min(i) AS first FROM votes GROUP BY ALL)",
    "win AS (SELECT case_id, pos, activity AS a1, 1.0 AS p1 FROM tally QUALIFY row_number() OVER (PARTITION BY case_id, pos "
    "ORDER BY n DESC, first) = 1)",
]


@query(
    "hard_voting",
    with_(
        *members_sql(ORDERS, FIVE), *HARD,
        "SELECT g.case_id, g.pos, w.a1 AS predicted, CAST(w.p1 AS DOUBLE) AS probability FROM gone g LEFT JOIN win w USING (case_id, pos)",
    ),
)
def hard_voting(src):
    rows = member_frame(src.orders(), FIVE)
    return voted(rows, FIVE, en.hard_voting([F.col(f"p_{n}.activity") for n in FIVE], CONFIG.stop_symbol))


TRIO = ("bag", "w1", "w2")


@query(
    "hard_voting_likelihood",
    with_(
        *members_sql(ORDERS, TRIO),
        "st AS (SELECT g.case_id, g.pos, g.activity, a.s AS s0, b.s AS s1, c.s AS s2 FROM gone g JOIN bag_look a USING (case_id, pos) "
        "JOIN w1_look b USING (case_id, pos) JOIN w2_look c USING (case_id, pos) WHERE NOT g.gone)",
        "combo AS (SELECT DISTINCT s0, s1, s2 FROM st WHERE s0 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL)",
        "won AS (SELECT s0, s1, s2, CASE WHEN y.activity = z.activity AND x.activity <> y.activity THEN y.activity ELSE x.activity END AS activity, "
        "sum(x.p * y.p * z.p) AS p FROM combo JOIN bag_probs x ON x.s = s0 JOIN w1_probs y ON y.s = s1 JOIN w2_probs z ON z.s = s2 "
        "GROUP BY ALL)",
        "SELECT g.case_id, g.pos, round(coalesce(w.p, 0), 6) AS likelihood FROM gone g LEFT JOIN st USING (case_id, pos) "
        "LEFT JOIN won w ON w.s0 = st.s0 AND w.s1 = st.s1 AND w.s2 = st.s2 AND w.activity = g.activity",
    ),
)
def hard_voting_likelihood(src):
    rows = en.hard_voting_likelihood(member_frame(src.orders(), TRIO), list(TRIO))
    return rows.select("case_id", "pos", r6(F.col("likelihood")).alias("likelihood"))


def first_sql(names):
    choice = "coalesce(" + ", ".join(f"{n}_sc.a1" for n in names) + ")"
    prob = "coalesce(" + ", ".join(f"{n}_sc.p1" for n in names) + ")"
    joins = " ".join(f"JOIN {n}_sc USING (case_id, pos)" for n in names)
    return (
        f"SELECT g.case_id, g.pos, CASE WHEN NOT gone THEN {choice} END AS predicted, "
        f"round(CASE WHEN NOT gone THEN {prob} END, 6) AS probability FROM gone g {joins}"
    )


for _name, _names, _log in (("fallback", ("fpt", "w4"), "orders"), ("fallback_chain", ("w4g", "w3g", "w2g", "w1"), "events")):

    def _fallback(src, names=_names, log=_log):
        rows = member_frame(getattr(src, log)(), names)
        return voted(rows, names, en.fallback([F.col(f"d_{n}") for n in names]))

    query(_name, with_(*members_sql(ORDERS if _log == "orders" else EVENTS, _names), first_sql(_names)))(_fallback)


def like_sql(n):
    return (
        f"{n}_like AS (SELECT l.case_id, l.pos, CASE WHEN l.s IS NULL THEN 0 WHEN d.s IS NULL THEN "
        f"CASE WHEN l.activity = '__stop__' THEN 1 ELSE 0 END WHEN l.activity = '__stop__' THEN (d.visits - d.dep) / d.visits "
        f"ELSE coalesce(f.f, 0) / d.visits END AS p FROM {n}_look l LEFT JOIN {n}_dep d ON l.s = d.s "
        f"LEFT JOIN {n}_freq f ON l.s = f.s AND l.activity = f.activity)"
    )


@query(
    "fallback_likelihood",
    with_(
        *members_sql(ORDERS, ("fpt", "w4")), like_sql("fpt"), like_sql("w4"),
        "SELECT case_id, pos, round(CASE WHEN gone THEN 0 WHEN a.p > 0 THEN a.p ELSE b.p END, 6) AS likelihood FROM gone "
        "JOIN fpt_like a USING (case_id, pos) JOIN w4_like b USING (case_id, pos)",
    ),
)
def fallback_likelihood(src):
    rows = member_frame(src.orders(), ("fpt", "w4"), likelihood=True)
    chance = en.fallback_likelihood([F.coalesce(F.col(f"f_{n}"), F.array().cast(en.DIST)) for n in ("fpt", "w4")], F.col("activity"))
    return rows.select("case_id", "pos", r6(chance).alias("likelihood"))


@query(
    "relativize",
    with_(
        *members_sql(ORDERS, ("fpt", "w2")),
        "SELECT case_id, pos, CASE WHEN NOT gone AND a.a1 IS NOT NULL THEN b.a1 END AS predicted, "
        "round(CASE WHEN NOT gone AND a.a1 IS NOT NULL THEN b.p1 END, 6) AS probability FROM gone "
        "JOIN fpt_sc a USING (case_id, pos) JOIN w2_sc b USING (case_id, pos)",
    ),
)
def relativize(src):
    rows = member_frame(src.orders(), ("fpt", "w2"))
    return voted(rows, ("fpt", "w2"), en.relativize([F.col("d_fpt"), F.col("d_w2")]))


ORDERED = (
    "r0 AS (SELECT g.case_id, g.pos, g.activity, row_number() OVER (ORDER BY case_seq, g.pos) AS i, "
    + ", ".join(f"CASE WHEN NOT gone THEN {n}_sc.a1 END AS {n}a, CASE WHEN NOT gone THEN {n}_sc.p1 END AS {n}p" for n in GRAMS)
    + " FROM (SELECT *, case_seq AS cs FROM gone) g "
    + " ".join(f"JOIN (SELECT case_id, pos, a1, p1 FROM {n}_sc) {n}_sc USING (case_id, pos)" for n in GRAMS)
    + ")"
)
COUNTED = (
    "r1 AS (SELECT *, "
    + ", ".join(
        f"coalesce(sum(CASE WHEN {n}a = activity THEN 1 ELSE 0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {n}c"
        for n in GRAMS
    )
    + " FROM r0)"
)


def best_sql(scores):
    """First member with the largest score."""
    top = "greatest(" + ", ".join(scores) + ")"
    return "CASE " + " ".join(f"WHEN {s} = {top} THEN {i}" for i, s in enumerate(scores)) + " END"


def chosen_sql(index, source):
    a = "CASE " + index + " " + " ".join(f"WHEN {i} THEN {n}a" for i, n in enumerate(GRAMS)) + " END"
    p = "CASE " + index + " " + " ".join(f"WHEN {i} THEN {n}p" for i, n in enumerate(GRAMS)) + " END"
    return f"SELECT case_id, pos, {a} AS predicted, round({p}, 6) AS probability FROM {source}"


for _name, _best, _scores in (
    ("adaptive_acc", "acc", [f"{n}c" for n in GRAMS]),
    ("adaptive_prob", "prob", [f"round(coalesce({n}p, 0), 12)" for n in GRAMS]),
    ("adaptive_prob_acc", "prob x acc", [f"round(coalesce({n}p, 0) * {n}c, 12)" for n in GRAMS]),
):

    def _adaptive(src, best=_best):
        rows = en.adaptive_voting(member_frame(src.orders(), GRAMS), list(GRAMS), best, answer="p")
        return rows.select("case_id", "pos", F.col("dist.activity").alias("predicted"), r6(F.col("dist.probability")).alias("probability"))

    query(
        _name,
        with_(*members_sql(ORDERS, GRAMS), ORDERED, COUNTED, chosen_sql(f"({best_sql(_scores)})", "r1")),
    )(_adaptive)


THRESHOLD, VOTES = 0.001, 5
FLAGS = (
    "fl AS (SELECT *, "
    + ", ".join(f"CASE WHEN {n}a = activity THEN 1 ELSE 0 END AS {n}r" for n in GRAMS)
    + " FROM r0)"
)


def stage_sql(k, now, nxt, start):
    return [
        f"g{k} AS (SELECT i, sum(CASE WHEN {nxt}r > {now}r THEN 1 ELSE 0 END) OVER o AS votes, sum({nxt}r) OVER o AS cn, "
        f"sum({now}r) OVER o AS cc, count(*) OVER o AS n FROM fl WHERE i > {start} WINDOW o AS (ORDER BY i ROWS UNBOUNDED PRECEDING))",
        f"at{k} AS (SELECT coalesce(min(i), 1000000000000) AS i FROM g{k} WHERE votes >= {VOTES} AND round(cn / n - cc / n, 12) > {THRESHOLD})",
    ]


@query(
    "promotion_batch",
    with_(
        *members_sql(ORDERS, GRAMS), ORDERED, FLAGS,
        *stage_sql(1, "w2", "w3", "0"), *stage_sql(2, "w3", "w4", "(SELECT i FROM at1)"),
        "act AS (SELECT *, CASE WHEN i > (SELECT i FROM at2) THEN 2 WHEN i > (SELECT i FROM at1) THEN 1 ELSE 0 END AS active FROM fl)",
        "SELECT case_id, pos, CAST(active AS INTEGER) AS active, CASE active WHEN 0 THEN w2a WHEN 1 THEN w3a ELSE w4a END AS predicted FROM act",
    ),
)
def promotion_batch(src):
    rows = en.promotion(member_frame(src.orders(), GRAMS), list(GRAMS), THRESHOLD, VOTES, answer="p")
    return rows.select("case_id", "pos", "active", F.col("dist.activity").alias("predicted"))


def delay_sql(n):
    return [
        f"{n}_timed AS (SELECT *, lag(ts) OVER (PARTITION BY case_id ORDER BY pos) AS prev FROM {n}_tr)",
        f"{n}_dl AS (SELECT s, activity, (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS delay, "
        f"row_number() OVER (PARTITION BY s, activity ORDER BY seq DESC) AS r FROM {n}_timed WHERE prev IS NOT NULL)",
        f"{n}_delays AS (SELECT s, activity, avg(delay) AS d FROM {n}_dl WHERE r <= 50 GROUP BY ALL)",
    ]


PAIR = ("w1", "w3g")


@query(
    "voting_delays",
    with_(
        *members_sql(EVENTS, PAIR), *delay_sql("w1"), *delay_sql("w3g"),
        "de AS (SELECT l.case_id, l.pos, d.activity, 1.0 AS w, d.d FROM w1_sc l JOIN w1_delays d ON l.s = d.s WHERE l.a1 IS NOT NULL "
        "UNION ALL SELECT l.case_id, l.pos, d.activity, 3.0 AS w, d.d FROM w3g_sc l JOIN w3g_delays d ON l.s = d.s WHERE l.a1 IS NOT NULL)",
        "SELECT g.case_id, g.pos, de.activity, round(sum(w * d) / sum(w), 3) AS delay_s FROM gone g JOIN de USING (case_id, pos) "
        "WHERE NOT gone GROUP BY ALL",
    ),
)
def voting_delays(src):
    rows = member_frame(src.events(), PAIR, delays=True)
    merged = en.voting_delays([F.col("m_w1"), F.col("m_w3g")], [1.0, 3.0])
    return rows.select("case_id", "pos", F.explode(merged).alias("activity", "_d")).select(
        "case_id", "pos", "activity", F.round("_d", 3).alias("delay_s")
    )


@query(
    "model_usage",
    with_(
        *members_sql(ORDERS, FIVE), *HARD,
        "x AS (SELECT g.case_id, g.pos, g.activity, w.a1 FROM gone g LEFT JOIN win w USING (case_id, pos))",
        "y AS (" + " UNION ALL ".join(
            f"SELECT {i} AS model_index, x.*, CASE WHEN NOT gone THEN s.a1 END AS m FROM x JOIN {n}_sc s USING (case_id, pos) JOIN gone USING (case_id, pos)"
            for i, n in enumerate(FIVE)
        ) + ")",
        "z AS (SELECT *, bool_or(coalesce(m = a1, false)) OVER (PARTITION BY case_id, pos) AS anyone FROM "
        "(SELECT model_index, case_id, pos, y.activity, a1, m FROM y))",
        "c AS (SELECT model_index, count(*) FILTER (m = a1) AS \"count\", count(*) FILTER (m = a1 AND a1 = activity) AS correct_count, "
        "count(*) FILTER (anyone) AS total_events, count(m) AS prediction_count, count(*) FILTER (m = activity) AS prediction_correct "
        "FROM z GROUP BY model_index)",
        "SELECT *, round(100.0 * \"count\" / total_events, 6) AS usage_pct, round(100.0 * correct_count / total_events, 6) AS correct_usage_pct, "
        "round(correct_count / \"count\", 6) AS accuracy_when_used, round(100.0 * prediction_correct / prediction_count, 6) AS prediction_accuracy_pct FROM c",
    ),
)
def model_usage(src):
    rows = member_frame(src.orders(), FIVE)
    vote = prediction(en.hard_voting([F.col(f"p_{n}.activity") for n in FIVE], CONFIG.stop_symbol), CONFIG)
    rows = en.vote_once(rows, list(FIVE), {"prediction": vote})
    shares = ["usage_pct", "correct_usage_pct", "accuracy_when_used", "prediction_accuracy_pct"]
    return rounded(en.model_usage(rows, list(FIVE)), *shares)


def strategy_parts():
    """CTEs <strategy> index -> predicted, for a cut of the standard set, over conversations."""
    names = ("bag", "fpt", "w1", "w2", "w3", "w4", "w2g", "w3g", "w4g")
    full = [*m.model(("fpt",), "full_"), *m.lookup(("fpt",), "full_"),
            "full_sc AS (SELECT l.*, q.a1, q.a2, q.a3, q.p1 FROM full_look l LEFT JOIN full_pred q ON l.s = q.s)"]
    parts = [*members_sql(CONVERSATIONS, names), *full]
    return parts


def outcome_sql(label, source):
    return f"SELECT '{label}' AS strategy, {m.OUTCOMES} FROM {source}"


@query(
    "all_strategies",
    with_(
        *strategy_parts(),
        "ddp AS (" + " UNION ALL ".join(
            f"SELECT g.case_id, g.pos, q.activity, q.p FROM gone g JOIN {n}_look l USING (case_id, pos) JOIN {n}_probs q ON l.s = q.s"
            for n in FIVE
        ) + ")",
        "dds AS (" + " UNION ALL ".join(
            f"SELECT g.case_id, g.pos, q.activity, q.p FROM gone g JOIN {n}_look l USING (case_id, pos) JOIN {n}_probs q ON l.s = q.s"
            for n in STAR
        ) + ")",
        *[
            x
            for t in ("ddp", "dds")
            for x in (
                f"{t}s AS (SELECT case_id, pos, activity, sum(p) AS p FROM {t} GROUP BY ALL)",
                f"{t}r AS (SELECT *, row_number() OVER (PARTITION BY case_id, pos ORDER BY round(p, 12) DESC, activity) AS rk FROM {t}s WHERE p > 0)",
                f"{t}p AS (SELECT case_id, pos, max(activity) FILTER (rk = 1) AS a1, max(activity) FILTER (rk = 2) AS a2, "
                f"max(activity) FILTER (rk = 3) AS a3 FROM {t}r GROUP BY ALL)",
                f"{t}o AS (SELECT g.activity, p.a1, p.a2, p.a3 FROM gone g LEFT JOIN {t}p p USING (case_id, pos))",
            )
        ],
        *HARD,
        "hv AS (SELECT g.activity, w.a1, CAST(NULL AS VARCHAR) AS a2, CAST(NULL AS VARCHAR) AS a3 FROM gone g LEFT JOIN win w USING (case_id, pos))",
        "fb AS (SELECT g.activity, coalesce(f.a1, w.a1) AS a1, CASE WHEN f.a1 IS NULL THEN w.a2 ELSE f.a2 END AS a2, "
        "CASE WHEN f.a1 IS NULL THEN w.a3 ELSE f.a3 END AS a3 FROM gone g JOIN fpt_sc f USING (case_id, pos) JOIN w4_sc w USING (case_id, pos))",
        " UNION ALL ".join(
            [
                outcome_sql("fpt", "full_sc"), outcome_sql("bag", "bag_sc"),
                *[outcome_sql(f"ngram_{w + 1}", f"w{w}_sc") for w in (1, 2, 3, 4)],
                outcome_sql("fallback fpt->ngram", "fb"), outcome_sql("hard voting", "hv"),
                outcome_sql("soft voting (2, 3, 4)", "ddpo"), outcome_sql("soft voting (2, 3, 4)*", "ddso"),
            ]
        ),
    ),
)
def all_strategies(src):
    train, test = split_cases(src.conversations(), 0.3)
    return evaluate_strategies(train, test, CONFIG, adaptive=())


@query("all_strategies_adaptive")
def all_strategies_adaptive(src):
    """The adaptive, promotion and fall-back-chain part of the set (their SQL is covered one by one above)."""
    train, test = split_cases(src.orders(), 0.3)
    return evaluate_strategies(train, test, CONFIG, ngrams=(3,), voting=(), chains=((4, 3, 2, 1),))
