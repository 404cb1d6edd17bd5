"""Queries on models, lookup, prediction and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.values import joined
from casewise.operators import evaluate as ev
from casewise.operators import lookup as lk
from casewise.operators import models as md
from casewise.operators import predict as pr
from casewise.operators.models import Miner
from casewise.operators.prepare import split_cases
from casewise.operators.structures import Bag, NGram, Parikh, PrefixTree, annotate
from casewise.plans import model_sql as m
from casewise.plans.registry import CONVERSATIONS, EVENTS, LINEITEM, ORDERS, query, r6, rounded, with_


def halves(log):
    return split_cases(log, 0.3)


def trained(log, structure, config=None, **gate):
    """Model of the first 70 % of cases and the rest of the log."""
    train, test = halves(log)
    return md.train(train, Miner(structure, **gate), config), test


def labelled(df, structure, *columns):
    return df.withColumns({c: structure.label(F.col(c)) for c in columns or ("state",)})


# --------------------------------------------------------------------------------------------------------------
# models
# --------------------------------------------------------------------------------------------------------------

for _w in (0, 1, 2, 3):
    _k = ("ngram", _w)

    def _ngram_states(src, w=_w):
        s = NGram(w)
        rows = md.known_states(md.train(src.events(), Miner(s)))
        return labelled(rows, s).select("state", "total_visits", "active_visits")

    query(
        f"ngram_states_w{_w}",
        with_(
            *m.base(EVENTS), *m.model(_k), *([m.access(_k)] if _w else ["acc AS (SELECT '' AS s)"]),
            "SELECT a.s AS state, coalesce(d.visits, 0) AS total_visits, CAST(coalesce(d.visits - d.dep, 0) AS BIGINT) AS active_visits "
            "FROM acc a LEFT JOIN dep d ON a.s = d.s",
        ),
    )(_ngram_states)

TRANSITIONS = "SELECT s AS state, activity, n AS next_state, f AS freq FROM freq"


@query("ngram_transitions", with_(*m.base(ORDERS), *m.model(("ngram", 2)), TRANSITIONS))
def ngram_transitions(src):
    s = NGram(2)
    rows = md.train(src.orders(), Miner(s)).transitions
    return labelled(rows, s, "state", "next_state").select("state", "activity", "next_state", "freq")


@query("ngram_transitions_lineitem", with_(*m.base(LINEITEM), *m.model(("ngram", 3)), TRANSITIONS))
def ngram_transitions_lineitem(src):
    s = NGram(3)
    rows = md.train(src.lineitem(), Miner(s)).transitions
    return labelled(rows, s, "state", "next_state").select("state", "activity", "next_state", "freq")


@query(
    "ngram_access",
    with_(*m.base(CONVERSATIONS), *m.model(("ngram", 4)), m.access(("ngram", 4)), "SELECT s AS state FROM acc"),
)
def ngram_access(src):
    s = NGram(4)
    return labelled(md.access_states(md.train(src.conversations(), Miner(s))), s)


FPT_STATES = (
    "SELECT CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '|')) END AS level, visits AS total_visits, "
    "CAST(visits - dep AS BIGINT) AS active_visits FROM dep"
)


@query("fpt_states", with_(*m.base(EVENTS), *m.model(("fpt",)), FPT_STATES))
def fpt_states(src):
    s = PrefixTree()
    rows = md.train(src.events(), Miner(s)).states()
    return rows.select(F.col("state.level").alias("level"), "total_visits", "active_visits")


@query(
    "fpt_transitions",
    with_(
        *m.base(ORDERS), *m.model(("fpt",)),
        "SELECT CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '|')) END AS level, activity, f AS freq FROM freq",
    ),
)
def fpt_transitions(src):
    rows = md.train(src.orders(), Miner(PrefixTree())).transitions
    return rows.select(F.col("state.level").alias("level"), "activity", "freq")


STATES = "SELECT s AS state, visits AS total_visits, CAST(visits - dep AS BIGINT) AS active_visits FROM dep"


@query("bag_states", with_(*m.base(EVENTS), *m.model(("bag",)), STATES))
def bag_states(src):
    s = Bag()
    return labelled(md.train(src.events(), Miner(s)).states(), s).select("state", "total_visits", "active_visits")


@query("bag_transitions", with_(*m.base(EVENTS), *m.model(("bag",)), TRANSITIONS))
def bag_transitions(src):
    s = Bag()
    rows = md.train(src.events(), Miner(s)).transitions
    return labelled(rows, s, "state", "next_state").select("state", "activity", "next_state", "freq")


for _name, _cap in (("parikh_states", None), ("parikh_capped", 2)):

    def _parikh(src, cap=_cap):
        rows = md.train(src.orders(), Miner(Parikh(cap))).states()
        return rows.select("total_visits", "active_visits", F.size("freqs").alias("next_activities"))

    query(
        _name,
        with_(
            *m.base(ORDERS), *m.model(("parikh", _cap)),
            "SELECT d.visits AS total_visits, CAST(d.visits - d.dep AS BIGINT) AS active_visits, "
            "CAST((SELECT count(*) FROM freq f WHERE f.s = d.s) AS INTEGER) AS next_activities FROM dep d",
        ),
    )(_parikh)

STOPPED = (
    "st AS (SELECT case_id, case_seq, pos, activity, train FROM evs UNION ALL "
    "SELECT DISTINCT case_id, case_seq, case_len, '__stop__', train FROM evs)"
)
BAYES = [
    STOPPED,
    f"pre AS (SELECT *, {m.state(('fpt',))} AS s FROM st)",
    "freq AS (SELECT s, activity, count(*) AS f FROM pre WHERE train GROUP BY ALL)",
]


@query(
    "bayes_memory",
    with_(
        *m.base(CONVERSATIONS), *BAYES,
        "SELECT CASE WHEN s = '' THEN 0 ELSE len(string_split(s, '|')) END AS level, activity, f AS freq FROM freq",
    ),
)
def bayes_memory(src):
    rows = md.exact_prefix_counts(src.conversations())
    return rows.select(F.col("state.level").alias("level"), "activity", "freq")


@query(
    "state_probabilities",
    with_(
        *m.base(EVENTS), *m.model(("ngram", 2)),
        "SELECT d.s AS state, a.activity, round(coalesce(p.p, 0), 6) AS prob FROM dep d CROSS JOIN "
        "(SELECT DISTINCT activity FROM probs) a LEFT JOIN probs p ON p.s = d.s AND p.activity = a.activity",
    ),
)
def state_probabilities(src):
    s = NGram(2)
    return rounded(labelled(md.state_probabilities(md.train(src.events(), Miner(s))), s), "prob")


DELAYS = [
    "timed AS (SELECT *, lag(ts) OVER (PARTITION BY case_id ORDER BY pos) AS prev FROM tr)",
    "dl AS (SELECT s, activity, (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS delay, "
    "row_number() OVER (PARTITION BY s, activity ORDER BY seq DESC) AS r FROM timed WHERE prev IS NOT NULL)",
    "delays AS (SELECT s, activity, avg(delay) AS delay_s, count(*) AS n FROM dl WHERE r <= 50 GROUP BY ALL)",
]


@query(
    "transition_delays",
    with_(
        *m.base(EVENTS), *m.model(("ngram", 1)), *DELAYS,
        "SELECT s AS state, activity, round(delay_s, 4) AS delay_s, n AS delays FROM delays",
    ),
)
def transition_delays(src):
    s = NGram(1)
    model = md.train(src.events(), Miner(s), with_delays=True)
    return labelled(model.delays, s).withColumn("delay_s", F.round("delay_s", 4))


@query(
    "active_cases",
    with_(
        *m.base(ORDERS), *m.model(("ngram", 2)),
        "SELECT n AS state, count(*) AS active_cases FROM tr WHERE pos = case_len - 1 GROUP BY n",
    ),
)
def active_cases(src):
    s = NGram(2)
    return labelled(md.active_cases(annotate(src.orders(), {"state": s})), s)


@query(
    "modified_cases",
    with_(
        *m.base(EVENTS),
        *m.model(("ngram", 3)), *m.model(("bag",), "b_"),
        "SELECT DISTINCT case_id FROM (SELECT t.case_id FROM tr t JOIN tr e ON e.seq = (SELECT max(seq) FROM log) AND t.pos = t.case_len - 1 "
        "AND (t.n = e.s OR t.n = e.n) UNION ALL SELECT t.case_id FROM b_tr t JOIN b_tr e ON e.seq = (SELECT max(seq) FROM log) "
        "AND t.pos = t.case_len - 1 AND (t.n = e.s OR t.n = e.n))",
    ),
)
def modified_cases(src):
    return md.modified_cases(src.events(), {"a": NGram(3), "b": Bag()})


@query(
    "top_states",
    with_(
        *m.base(ORDERS), *m.model(("ngram", 3)),
        "SELECT s AS state, visits, round(visits / (SELECT sum(visits) FROM dep WHERE s <> ''), 6) AS visit_rate "
        "FROM dep WHERE s <> '' ORDER BY visits DESC, s LIMIT 3",
    ),
)
def top_states(src):
    return rounded(md.top_visited_states(md.train(src.orders(), Miner(NGram(3))), 3), "visit_rate")


@query(
    "num_states",
    with_(*m.base(EVENTS), *m.model(("ngram", 4)), m.access(("ngram", 4)), "SELECT count(*) AS states FROM acc"),
)
def num_states(src):
    return md.num_states(md.train(src.events(), Miner(NGram(4))))


@query(
    "automaton_graph",
    with_(
        *m.base(ORDERS), *m.model(("ngram", 2)),
        "SELECT s AS state, activity, n AS next_state, count(*) AS freq, max(seq) = (SELECT max(seq) FROM tr) AS is_last "
        "FROM tr GROUP BY ALL",
    ),
)
def automaton_graph(src):
    s = NGram(2)
    rows = annotate(src.orders(), {"state": s})
    model = md.Model(Miner(s), md.transitions(rows))
    return md.automaton_graph(rows, model)[1]


# --------------------------------------------------------------------------------------------------------------
# lookup
# --------------------------------------------------------------------------------------------------------------

LOOK = "SELECT case_id, pos, s AS state FROM look"

for _name, _kind, _structure, _log in (
    ("ngram_lookup", ("ngram", 5), NGram(5), "events"),
    ("ngram0_lookup", ("ngram", 0), NGram(0), "conversations"),
    ("bag_lookup", ("bag",), Bag(), "orders"),
):
    _base = {"events": EVENTS, "orders": ORDERS, "conversations": CONVERSATIONS}[_log]

    def _lookup(src, structure=_structure, log=_log):
        model, test = trained(getattr(src, log)(), structure)
        return labelled(lk.lookup(test, model), structure).select("case_id", "pos", "state")

    query(_name, with_(*m.base(_base, split=True), *m.model(_kind), *m.lookup(_kind), LOOK))(_lookup)

for _name, _kind, _structure in (
    ("fpt_lookup", ("fpt",), PrefixTree()),
    ("parikh_lookup", ("parikh", None), Parikh()),
    ("parikh_capped_lookup", ("parikh", 2), Parikh(2)),
):

    def _known(src, structure=_structure):
        model, test = trained(src.orders(), structure)
        rows = lk.lookup(test, model).join(model.states().select("state", "total_visits"), "state", "left")
        return rows.select("case_id", "pos", "total_visits")

    query(
        _name,
        with_(
            *m.base(ORDERS, split=True), *m.model(_kind), *m.lookup(_kind),
            "SELECT case_id, pos, visits AS total_visits FROM look LEFT JOIN vis USING (s)",
        ),
    )(_known)


@query(
    "parse_sequence",
    with_(
        *m.base(EVENTS, split=True), *m.model(("ngram", 2)),
        f"raw AS (SELECT *, {m.state(('ngram', 2))} AS rs FROM tev)",
        "hit AS (SELECT t.*, f.s IS NOT NULL AS ok FROM raw t LEFT JOIN freq f ON t.rs = f.s AND t.activity = f.activity)",
        "SELECT case_id, CASE WHEN bool_and(ok) FILTER (activity <> '__stop__') THEN max(rs) FILTER (activity = '__stop__') END AS state "
        "FROM hit GROUP BY case_id",
    ),
)
def parse_sequence(src):
    s = NGram(2)
    model, test = trained(src.events(), s)
    return labelled(lk.parse_sequences(test, model), s)


@query(
    "case_state",
    with_(
        *m.base(ORDERS, split=True), *m.model(("ngram", 2)),
        "now AS (SELECT case_id, n AS state FROM tr WHERE pos = case_len - 1)",
        "SELECT c.case_id, coalesce(state, '') AS state FROM cases c LEFT JOIN now USING (case_id)",
    ),
)
def case_state(src):
    s = NGram(2)
    train, _ = halves(src.orders())
    model = md.train(train, Miner(s))
    return labelled(lk.case_states(model, train, src.orders()), s)


@query(
    "composed_state",
    with_(
        *m.base(ORDERS, split=True),
        *m.model(("bag",), "b_"), *m.lookup(("bag",), "b_"), *m.model(("ngram", 3), "g_"), *m.lookup(("ngram", 3), "g_"),
        "pair AS (SELECT case_id, pos, b.s AS bag, g.s AS gram FROM b_look b JOIN g_look g USING (case_id, pos))",
        "live AS (SELECT *, bool_or(bag IS NULL AND gram IS NULL) OVER (PARTITION BY case_id ORDER BY pos) AS dead FROM pair)",
        "SELECT case_id, pos, CASE WHEN dead THEN NULL ELSE coalesce(bag, '-') || ' / ' || coalesce(gram, '-') END AS composed FROM live",
    ),
)
def composed_state(src):
    train, test = halves(src.orders())
    models = md.train_all(train, {"bag": Miner(Bag()), "gram": Miner(NGram(3))})
    rows = lk.test_rows(test, models)
    for name in ("bag", "gram"):
        rows = lk.resolve(rows.withColumnRenamed(name, "_raw"), models[name], "_raw", name).drop("_raw")
    rows = lk.composed_states(rows, ["bag", "gram"])
    text = F.concat_ws(
        " / ",
        F.coalesce(joined(F.col("composed.bag")), F.lit("-")),
        F.coalesce(joined(F.col("composed.gram")), F.lit("-")),
    )
    return rows.select("case_id", "pos", F.when(F.col("composed").isNotNull(), text).alias("composed"))


# --------------------------------------------------------------------------------------------------------------
# prediction
# --------------------------------------------------------------------------------------------------------------


@query(
    "gated_states",
    with_(
        *m.base(EVENTS), *m.model(("ngram", 3), gate=20),
        "SELECT s AS state, visits AS total_visits FROM probs GROUP BY ALL HAVING max(p) >= 0.25",
    ),
)
def gated_states(src):
    s = NGram(3)
    model = md.train(src.events(), Miner(s, min_total_visits=20, min_max_prob=0.25))
    return labelled(md.gated_states(model), s).select("state", "total_visits")


PRED = (
    "SELECT s AS state, a1 AS activity, concat_ws('|', a1, a2, a3) AS top_k, round(p1, 6) AS probability FROM pred"
)


def _predictions(rows, structure):
    return labelled(rows, structure).select(
        "state",
        F.col("prediction.activity").alias("activity"),
        joined(F.col("prediction.top_k")).alias("top_k"),
        r6(F.col("prediction.probability")).alias("probability"),
    )


@query("predict_topk", with_(*m.base(EVENTS), *m.model(("ngram", 2)), PRED))
def predict_topk(src):
    s = NGram(2)
    return _predictions(pr.predict_states(md.train(src.events(), Miner(s))), s)


NO_STOP = [
    "alpha AS (SELECT DISTINCT activity FROM freq)",
    "ns AS (SELECT d.s, a.activity, CASE WHEN d.dep = 0 THEN 1.0 / (SELECT count(*) FROM alpha) "
    "ELSE coalesce(f.f, 0) / d.dep END AS p FROM dep d CROSS JOIN alpha a LEFT JOIN freq f ON f.s = d.s AND f.activity = a.activity)",
]


@query(
    "predict_no_stop",
    with_(
        *m.base(ORDERS), *m.model(("ngram", 2))[:-2], *NO_STOP, *m.ranks(source="ns"), PRED,
    ),
)
def predict_no_stop(src):
    s = NGram(2)
    return _predictions(pr.predict_states(md.train(src.orders(), Miner(s), Config(include_stop=False))), s)


@query(
    "predict_uniform_rest",
    with_(
        *m.base(CONVERSATIONS), *m.model(("bag",))[:-2], *NO_STOP, *m.ranks(source="ns"),
        "SELECT s AS state, a1 AS activity, concat_ws('|', a1, a2, a3) AS top_k, round(p1, 6) AS probability FROM pred",
    ),
)
def predict_uniform_rest(src):
    """States where cases only end share the weight among all activities."""
    s = Bag()
    return _predictions(pr.predict_states(md.train(src.conversations(), Miner(s), Config(include_stop=False))), s)


UNIFORM = "CAST('0x' || substr(md5(case_id || '#' || pos || '#{seed}'), 1, 8) AS BIGINT) / 4294967296.0"


@query(
    "predict_randomized",
    with_(
        *m.base(ORDERS, split=True), *m.scored(("ngram", 2)),
        f"draws AS (SELECT case_id, pos, s, {UNIFORM.format(seed=9)} AS u FROM sc)",
        "cum AS (SELECT s, activity, sum(p) OVER w AS hi, coalesce(sum(p) OVER (PARTITION BY s ORDER BY round(p, 12) DESC, "
        "activity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM probs "
        "WINDOW w AS (PARTITION BY s ORDER BY round(p, 12) DESC, activity ROWS UNBOUNDED PRECEDING))",
        "SELECT d.case_id, d.pos, c.activity FROM draws d LEFT JOIN cum c ON d.s = c.s AND d.u >= c.lo AND d.u < c.hi",
    ),
)
def predict_randomized(src):
    config = Config(randomized=True)
    model, test = trained(src.orders(), NGram(2), config)
    rows = lk.lookup(test, model).join(md.gated_states(model), "state", "left")
    drawn = pr.prediction(F.col("dist"), config, draw=pr.row_draw(9))
    return rows.select("case_id", "pos", drawn["activity"].alias("activity"))


@query(
    "predict_delays",
    with_(
        *m.base(EVENTS), *m.model(("ngram", 1)), *DELAYS,
        "SELECT p.s AS state, p.a1 AS activity, round(d.delay_s, 4) AS delay_s FROM pred p LEFT JOIN delays d "
        "ON p.s = d.s AND p.a1 = d.activity",
    ),
)
def predict_delays(src):
    s = NGram(1)
    rows = pr.predict_with_delays(md.train(src.events(), Miner(s), with_delays=True))
    top = F.col("prediction.activity")
    return labelled(rows, s).select(
        "state", top.alias("activity"), F.round(F.try_element_at("delays", top), 4).alias("delay_s")
    )


LIKELIHOOD = [
    "full_ AS (SELECT l.*, CASE WHEN l.s IS NULL THEN 0 WHEN d.s IS NULL THEN CASE WHEN l.activity = '__stop__' THEN 1 ELSE 0 END "
    "ELSE coalesce(p.p, 0) END AS likelihood FROM look l LEFT JOIN dep d ON l.s = d.s "
    "LEFT JOIN probs p ON l.s = p.s AND l.activity = p.activity)"
]


@query(
    "activity_likelihood",
    with_(
        *m.base(EVENTS, split=True), *m.model(("ngram", 4)), *m.lookup(("ngram", 4)), *LIKELIHOOD,
        "SELECT case_id, pos, round(likelihood, 6) AS likelihood FROM full_",
    ),
)
def activity_likelihood(src):
    model, test = trained(src.events(), NGram(4))
    return rounded(ev.score(test, model, likelihood=True).select("case_id", "pos", "likelihood"), "likelihood")


def bayes_sql(minimum):
    return [
        *m.base(ORDERS, split=True), *BAYES,
        "tot AS (SELECT s, sum(f) AS t FROM freq GROUP BY s)",
        f"probs AS (SELECT s, activity, f / t AS p FROM freq JOIN tot USING (s) WHERE t >= {minimum})",
        *m.ranks(),
        "sc AS (SELECT pre.*, a1, a2, a3 FROM pre LEFT JOIN pred USING (s) WHERE NOT train)",
    ]


def _bayes_rows(src, nonsingle):
    train, test = halves(src.orders())
    counts = md.exact_prefix_counts(train)
    states = pr.bayes_states(counts, Config(), nonsingle=nonsingle)
    dummy = md.Model(Miner(PrefixTree()), counts)
    rows = lk.test_rows(test, {"state": dummy})
    return rows.join(states.select("state", "prediction"), "state", "left")


for _name, _flag in (("bayes_predict", False), ("bayes_nonsingle", True)):

    def _bayes(src, flag=_flag):
        return _bayes_rows(src, flag).select(
            "case_id", "pos", F.col("prediction.activity").alias("activity"), joined(F.col("prediction.top_k")).alias("top_k")
        )

    query(
        _name,
        with_(
            *bayes_sql(2 if _flag else 1),
            "SELECT case_id, pos, a1 AS activity, CASE WHEN a1 IS NOT NULL THEN concat_ws('|', a1, a2, a3) END AS top_k FROM sc",
        ),
    )(_bayes)


# --------------------------------------------------------------------------------------------------------------
# evaluation
# --------------------------------------------------------------------------------------------------------------

for _name, _kind, _structure, _log in (
    ("evaluate_ngram", ("ngram", 2), NGram(2), "events"),
    ("evaluate_fpt", ("fpt",), PrefixTree(), "orders"),
    ("evaluate_bag", ("bag",), Bag(), "orders"),
    ("evaluate_conversations", ("ngram", 4), NGram(4), "conversations"),
    ("evaluate_lineitem", ("ngram", 3), NGram(3), "lineitem"),
):
    _base = {"events": EVENTS, "orders": ORDERS, "conversations": CONVERSATIONS, "lineitem": LINEITEM}[_log]

    def _evaluate(src, structure=_structure, log=_log):
        model, test = trained(getattr(src, log)(), structure)
        return ev.evaluate(test, model)

    query(_name, with_(*m.base(_base, split=True), *m.scored(_kind), f"SELECT {m.OUTCOMES} FROM sc"))(_evaluate)


@query("evaluate_bayes", with_(*bayes_sql(1), f"SELECT {m.OUTCOMES} FROM sc"))
def evaluate_bayes(src):
    return ev.outcome_counts(_bayes_rows(src, False), 3)


@query(
    "prediction_vector",
    with_(
        *m.base(ORDERS, split=True), *m.scored(("ngram", 3)),
        "SELECT row_number() OVER (ORDER BY case_seq, pos) AS \"index\", coalesce(a1, '__empty__') AS predicted, activity AS actual FROM sc",
    ),
)
def prediction_vector(src):
    from casewise.operators.prepare import evaluation_index

    model, test = trained(src.orders(), NGram(3))
    return evaluation_index(ev.prediction_vector(ev.score(test, model))).select("index", "predicted", "actual")


def _vector_sql(n: str, model: str) -> str:
    return (
        f"SELECT '{model}' AS model, row_number() OVER (ORDER BY case_seq, pos) AS \"index\", coalesce(a1, '__empty__') AS predicted, activity AS actual FROM {n}sc"
    )


@query(
    "prediction_vectors",
    with_(
        *m.base(ORDERS, split=True), *m.scored(("ngram", 1), "a_"), *m.scored(("ngram", 3), "b_"),
        f"v AS ({_vector_sql('a_', 'ngram_2')} UNION ALL {_vector_sql('b_', 'ngram_4')})",
        "SELECT CAST(0 AS INTEGER) AS iteration, \"index\", max(actual) AS actual, max(predicted) FILTER (model = 'ngram_2') AS ngram_2, "
        "max(predicted) FILTER (model = 'ngram_4') AS ngram_4 FROM v GROUP BY \"index\"",
    ),
)
def prediction_vectors(src):
    """Vectors of two models written one by one and combined by position; the second is written twice."""
    from casewise.functions.scratch import scratch_dir
    from casewise.operators.prepare import evaluation_index
    from casewise.sinks import batches

    path = scratch_dir(src.spark, "prediction-vectors") + "/table"
    for name, window in (("ngram_2", 1), ("ngram_4", 3), ("ngram_4", 3)):
        model, test = trained(src.orders(), NGram(window))
        batches.write_prediction_vectors(evaluation_index(ev.prediction_vector(ev.score(test, model))), path, name, 0)
    return batches.combined_vectors(batches.prediction_vectors(src.spark, path), ["ngram_2", "ngram_4"])


PERPLEXITY = [
    *m.base(ORDERS, split=True), *m.model(("ngram", 3)), *m.lookup(("ngram", 3)), *LIKELIHOOD,
    "pp AS (SELECT case_id, CASE WHEN min(likelihood) <= 0 THEN CAST('inf' AS DOUBLE) "
    "ELSE exp(-avg(ln(CASE WHEN likelihood > 0 THEN likelihood END))) END AS perplexity FROM full_ GROUP BY case_id)",
]


def _perplexities(src):
    model, test = trained(src.orders(), NGram(3))
    return ev.case_perplexity(ev.score(test, model, likelihood=True))


@query("case_perplexity", with_(*PERPLEXITY, "SELECT case_id, round(perplexity, 6) AS perplexity FROM pp"))
def case_perplexity(src):
    return rounded(_perplexities(src), "perplexity")


@query(
    "perplexity_stats",
    with_(
        *PERPLEXITY,
        "o AS (SELECT perplexity AS p, row_number() OVER (ORDER BY perplexity) AS r, count(*) OVER () AS n FROM pp)",
        "SELECT count(*) AS cases, round(avg(p), 6) AS pp_arithmetic_mean, round(count(*) / sum(1.0 / p), 6) AS pp_harmonic_mean, "
        "round(max(p) FILTER (r = floor(0.25 * n) + 1), 6) AS pp_q1, round(max(p) FILTER (r = floor(0.5 * n) + 1), 6) AS pp_median, "
        "round(max(p) FILTER (r = floor(0.75 * n) + 1), 6) AS pp_q3 FROM o",
    ),
)
def perplexity_stats(src):
    names = ["pp_arithmetic_mean", "pp_harmonic_mean", "pp_q1", "pp_median", "pp_q3"]
    return rounded(ev.perplexity_stats(_perplexities(src)), *names)


STATS = [
    *m.base(EVENTS, split=True), *m.scored(("ngram", 3)),
    "stats AS (SELECT sc.s AS state, CAST(CASE WHEN sc.s = '' THEN 0 ELSE len(string_split(sc.s, '|')) END AS INTEGER) AS level, "
    "coalesce(max(v.visits), 0) AS visits, count(*) AS total, count(*) FILTER (a1 = activity) AS correct, "
    "count(*) FILTER (a1 <> activity) AS wrong, count(*) FILTER (a1 IS NULL) AS empty FROM sc LEFT JOIN vis v ON sc.s = v.s "
    "WHERE sc.s IS NOT NULL GROUP BY sc.s)",
]


def _stats(src):
    model, test = trained(src.events(), NGram(3))
    return ev.per_state_stats(ev.score(test, model), model)


@query("per_state_stats", with_(*STATS, "SELECT * FROM stats"))
def per_state_stats(src):
    return _stats(src)


@query(
    "state_rates",
    with_(
        *STATS,
        "SELECT state, round(correct / total, 6) AS correct_rate, round(wrong / total, 6) AS wrong_rate FROM stats",
    ),
)
def state_rates(src):
    return rounded(ev.state_rates(_stats(src)), "correct_rate", "wrong_rate").select("state", "correct_rate", "wrong_rate")


for _key in ("visits", "level"):

    def _rates(src, key=_key):
        return rounded(ev.rate_by_group(_stats(src), key), "correct_rate")

    query(
        f"rate_by_{_key}",
        with_(
            *STATS,
            f"SELECT {_key}, CAST(sum(total) AS BIGINT) AS total, round(sum(correct) / sum(total), 6) AS correct_rate FROM stats GROUP BY {_key}",
        ),
    )(_rates)


@query(
    "delay_errors",
    with_(
        *m.base(EVENTS, split=True), *m.scored(("ngram", 1)), *DELAYS,
        "x AS (SELECT sc.*, lag(ts) OVER (PARTITION BY case_id ORDER BY pos) AS prev FROM sc)",
        "y AS (SELECT (epoch_us(ts) - epoch_us(prev)) / 1000000.0 AS a, d.delay_s AS d FROM x JOIN delays d ON x.s = d.s "
        "AND x.activity = d.activity WHERE prev IS NOT NULL AND ts IS NOT NULL AND a1 IS NOT NULL)",
        "SELECT count(*) AS num_delays, round(avg(abs(d - a)), 4) AS mean_error, round(avg(a), 4) AS mean_delay, "
        "round(avg(CASE WHEN a + d = 0 THEN 0 ELSE abs(d - a) / (a + d) END), 6) AS mean_normalized FROM y",
    ),
)
def delay_errors(src):
    train, test = halves(src.events())
    model = md.train(train, Miner(NGram(1)), with_delays=True)
    out = ev.delay_errors(ev.score(test, model), model.delays)
    return out.withColumns(
        {
            "mean_error": F.round("mean_error", 4),
            "mean_delay": F.round("mean_delay", 4),
            "mean_normalized": r6(F.col("mean_normalized")),
        }
    )
