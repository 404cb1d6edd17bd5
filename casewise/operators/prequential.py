"""Predict, then learn: the exact result of a model that runs along a finite log, worked out in parallel.

Before an event a model knows what strictly earlier events taught it: arrivals into the state of the event and departures
from it.  Both are running counts per state.  States are cut along the chunks of the order key, so a state that every case
visits is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.ordering import UNBOUNDED, lookback, running, running_total
from casewise.functions.values import let, seconds_between
from casewise.operators.ensembles import beats, best_index, pick, promotion_points, right, top_prob
from casewise.operators.evaluate import rank_of_actual
from casewise.operators.models import Miner, distribution, max_prob, weights
from casewise.operators.positions import positioned, previous_ts
from casewise.operators.predict import DIGITS, prediction, prob_of
from casewise.operators.structures import Structure, annotate

#: alphabets up to this size are counted in one column per activity, larger ones by blocks of events
WIDE_ALPHABET = 64
#: alphabets up to this size, with STOP, are ranked entry by entry in columns, without arrays
NARROW_ALPHABET = 16
#: events of a state that are counted together at least, and how many such blocks a window may see
LEAST_BLOCK, BLOCK_SPAN = 32, 1 << 16
FREQS = "array<struct<activity:string,freq:bigint>>"


def _activities(log: DataFrame, limit: int) -> list[str] | None:
    """The sorted alphabet, or None if it has more than ``limit`` entries."""
    rows = log.select("activity").distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r["activity"] for r in rows)


def earlier_counts(annotated: DataFrame, structures: dict[str, Structure], activities: list[str] | None) -> DataFrame:
    """Add ``v_<name>`` (visits of the state before the event) and ``f_<name>`` (earlier departures by activity).

    With ``activities`` also ``n_<name>``, the departures in their order as plain numbers; only these are shuffled.

    All structures share one running pass, keyed by the structure and its packed state, so the plan has the same scans for any
    number of them.
    """
    states = {c for n in structures for c in (n, f"{n}_next")}
    keep = F.struct(*[c for c in annotated.columns if c not in ("seq", "chunk") and c not in states])
    nothing = F.when(F.lit(False), keep)
    visits = []
    for i, (name, structure) in enumerate(structures.items()):
        here = [structure.pack(F.col(name)), F.lit(0), (F.col("pos") == 0).cast("bigint"), F.col("activity"), nothing if i else keep]
        there = [structure.pack(F.col(f"{name}_next")), F.lit(1), F.lit(1).cast("bigint"), F.lit(None).cast("string"), nothing]
        for fields in (here, there):
            named = zip(("_s", "_kind", "_arrives", "_a", "_row"), fields, strict=True)
            visits.append(F.struct(F.lit(i).alias("_m"), *[c.alias(n) for n, c in named]))
    rows = annotated.select("seq", "chunk", F.explode(F.array(*visits)).alias("_e")).select("seq", "chunk", "_e.*")
    folds = {"_v": ("sum", F.col("_arrives"))}
    if activities is not None:
        folds |= {f"_n{i}": ("sum", F.coalesce((F.col("_a") == a).cast("bigint"), F.lit(0))) for i, a in enumerate(activities)}
    rows = running(rows, ["_m", "_s"], ["seq", "_kind"], folds, split="chunk").filter(F.col("_kind") == 0)
    if activities is not None:
        rows = rows.withColumn("_f", F.array(*[F.col(f"_n{i}") for i in range(len(activities))]).cast("array<bigint>"))
    else:
        rows = _counts_by_block(rows).withColumn("_f", F.col("_f").cast(FREQS))
    known = F.struct(F.col("_v").alias("v"), F.col("_f").alias("f"))
    gathered = rows.groupBy("seq").agg(
        F.first("chunk").alias("chunk"), F.first("_row", ignorenulls=True).alias("_row"),
        *[F.first(F.when(F.col("_m") == i, known), ignorenulls=True).alias(f"_k{i}") for i in range(len(structures))],
    )
    parts = {f"v_{n}": F.col(f"_k{i}.v") for i, n in enumerate(structures)}
    if activities is None:
        parts |= {f"f_{n}": F.col(f"_k{i}.f") for i, n in enumerate(structures)}
    else:
        parts |= {f"n_{n}": F.col(f"_k{i}.f") for i, n in enumerate(structures)}
        parts |= {f"f_{n}": _frequencies(F.col(f"_k{i}.f"), activities) for i, n in enumerate(structures)}
    return gathered.select("_row.*", "seq", "chunk", *[c.alias(n) for n, c in parts.items()])


def _frequencies(counts: Column, activities: list[str]) -> Column:
    """Counts in the order of ``activities`` as entries by activity, without those that are zero."""
    entries = F.array(*[F.struct(F.lit(a).alias("activity"), F.get(counts, i).alias("freq")) for i, a in enumerate(activities)])
    return F.filter(entries.cast(FREQS), lambda x: x["freq"] > 0)


def _ranked(rows: DataFrame, names: list[str], activities: list[str], config: Config) -> DataFrame:
    """Add ``p_<name>``: what :func:`~casewise.operators.predict.prediction` gives, for members that pass ``g_<name>``.

    The best entries are found one after another as the least (falling probability, name) after the one before, in plain columns.
    """

    def entry(name: Column, prob: Column) -> Column:
        return F.struct((-F.round(prob, DIGITS)).alias("order"), name.alias("activity"), prob.alias("prob"))

    found, size = {}, len(activities) + 1
    for n in names:
        counts, visits = [F.get(f"n_{n}", i) for i in range(len(activities))], F.col(f"v_{n}")
        seen = sum(counts, F.lit(0).cast("bigint"))
        for i, (a, c) in enumerate(zip(activities, counts, strict=True)):
            found[f"_e{i}_{n}"] = F.when(F.col(f"g_{n}") & (c > 0), entry(F.lit(a), c / visits))
        rest = F.when(visits > 0, F.greatest(F.lit(0.0), (visits - seen) / visits)).otherwise(F.lit(1.0))
        found[f"_e{size - 1}_{n}"] = F.when(F.col(f"g_{n}"), entry(F.lit(config.stop_symbol), rest))
    rows = rows.withColumns(found)
    best = min(config.top_k, size) or 1
    for k in range(best):
        step = {}
        for n in names:
            left = [F.col(f"_e{i}_{n}") for i in range(size)]
            left = [F.when(e > F.col(f"_b{k - 1}_{n}"), e) for e in left] if k else left
            step[f"_b{k}_{n}"] = F.least(*left) if size > 1 else left[0]
        rows = rows.withColumns(step)
    answers = {}
    for n in names:
        first = F.col(f"_b0_{n}")
        offered = [
            F.when((F.col(f"_b{k}_{n}.prob") > 0) | (first["prob"] <= 0), F.array(F.col(f"_b{k}_{n}.activity")))
            .otherwise(F.array().cast("array<string>")) for k in range(min(config.top_k, best))
        ]
        # a rank that nothing takes is null, and neither test holds
        offered = [F.when(F.col(f"_b{k}_{n}").isNotNull(), x).otherwise(F.array().cast("array<string>")) for k, x in enumerate(offered)]
        top = F.concat(*offered) if offered else F.array().cast("array<string>")
        whole = F.struct(first["activity"].alias("activity"), top.alias("top_k"), first["prob"].alias("probability"))
        answers[f"p_{n}"] = F.when(first.isNotNull(), whole)
    return rows.withColumns(answers).drop(*found, *[f"_b{k}_{n}" for k in range(best) for n in names])


def _counts_by_block(rows: DataFrame) -> DataFrame:
    """Departures so far for alphabets too large for columns.

    The events of a state are cut into blocks about as long as the state has activities. What was counted before a block
    (:func:`counts_before`) meets its events once, and inside a block the counts of earlier events replace it, so no more rows are
    shuffled than there are events.
    """
    state = ["_m", "_s"]
    sizes = rows.groupBy(*state, "_a").agg(F.count(F.lit(1)).alias("_n")).groupBy(*state)
    sizes = sizes.agg(F.greatest(F.count(F.lit(1)), F.lit(LEAST_BLOCK)).alias("_size"), F.sum("_n").alias("_all"))
    one = ("sum", F.lit(1).cast("bigint"))
    rows = running(rows.join(sizes, state), state, ["seq"], {"_i": one}, split="chunk")
    rows = running(rows, [*state, "_a"], ["seq"], {"_c": one}, inclusive=True, split="chunk")
    rows = rows.withColumns({"_b": F.floor(F.col("_i") / F.col("_size")).cast("bigint"), "_last": F.floor((F.col("_all") - 1) / F.col("_size")).cast("bigint")})
    counts = rows.groupBy(*state, "_a", "_b").agg(F.max("_c").alias("_n"), F.max("_last").alias("_last"))
    entry = F.struct(F.col("_a").alias("activity"), F.col("_n").alias("freq"))
    before = counts_before(counts, [*state, "_a"]).groupBy(*state, "_b").agg(F.collect_list(entry).cast(FREQS).alias("_before"))
    earlier = Window.partitionBy(*state, "_b").orderBy("seq").rowsBetween(UNBOUNDED, -1)
    since = F.collect_list(F.struct(F.col("_a").alias("activity"), F.col("_c").alias("freq"))).over(earlier).cast(FREQS)
    rows = rows.withColumn("_since", since).join(before, [*state, "_b"], "left")
    # the last entry of each activity has its newest count
    entries = F.sort_array(F.concat(F.coalesce("_before", F.array().cast(FREQS)), F.col("_since")))
    newest = let(entries, lambda r: F.filter(r, lambda x, i: ~F.get(r, i + 1)["activity"].eqNullSafe(x["activity"])))
    return rows.withColumn("_f", newest).drop("_size", "_all", "_i", "_c", "_b", "_last", "_since", "_before")


def counts_before(counts: DataFrame, keys: list[str], span: int = BLOCK_SPAN) -> DataFrame:
    """(keys, _b, _n): the last ``_n`` of earlier blocks, for every block up to ``_last`` after the first one a key is in.

    ``counts`` (keys, _b, _n, _last) has the blocks that a key is in, with counts that grow. A key's blocks are cut into spans.
    """

    def until_next(rows: DataFrame, parts: list[str], last: Column) -> DataFrame:
        follows = F.coalesce(F.lead("_b").over(Window.partitionBy(*parts).orderBy("_b")), last)
        rows = rows.withColumn("_to", follows).filter(F.col("_to") > F.col("_b"))
        return rows.withColumn("_b", F.explode(F.sequence(F.col("_b") + 1, F.col("_to")))).drop("_to")

    counts = counts.withColumn("_span", F.floor(F.col("_b") / span).cast("bigint"))
    spans = counts.groupBy(*keys, F.col("_span").alias("_b")).agg(F.max("_n").alias("_n"), F.max("_last").alias("_last"))
    inherited = until_next(spans, keys, F.floor(F.col("_last") / span).cast("bigint")).withColumnRenamed("_b", "_span")
    both = counts.unionByName(inherited.withColumn("_b", F.col("_span") * span - 1))
    end = F.least(F.col("_last"), (F.col("_span") + 1) * span - 1)
    return until_next(both, [*keys, "_span"], end).select(*keys, "_b", "_n")


def prequential(
    log: DataFrame, miners: dict[str, Miner], config: Config | None = None, *, likelihood: bool = False, wide: int = WIDE_ALPHABET
) -> DataFrame:
    """Every event with ``d_<member>`` (distribution before the event) and ``p_<member>`` (prediction) of each miner.

    ``l_<member>`` is the ungated likelihood of the event.  Only activities that a state has led to carry weight, so what
    is known so far needs no separate treatment unless STOP is left out, which shares weight among activities seen so far.
    """
    config = config or Config()
    rows = annotate(log, {n: m.structure for n, m in miners.items()})
    rows = rows.select(
        *[c for c in ("case_id", "activity", "ts", "seq", "chunk", "split", "pos", "case_len") if c in rows.columns],
        *[c for n in miners for c in (n, f"{n}_next")],
    )
    activities = _activities(log, wide)
    known = None
    if not config.include_stop:
        firsts = log.groupBy("activity").agg(F.min("seq").alias("first"))
        table = firsts.agg(F.sort_array(F.collect_list(F.struct("activity", "first")))).scalar()
        rows = rows.withColumn("_first", table)
    rows = earlier_counts(rows, {n: m.structure for n, m in miners.items()}, activities)
    narrow = activities is not None and len(activities) < NARROW_ALPHABET and config.include_stop and not config.randomized
    for name, miner in miners.items():
        visits = F.col(f"v_{name}")
        rows = rows.withColumn(f"d_{name}", distribution(F.col(f"f_{name}"), visits, config.stop_symbol))
        if likelihood:
            rows = rows.withColumn(f"l_{name}", prob_of(F.col(f"d_{name}"), F.col("activity")))
        passes = visits >= max(miner.min_total_visits, 1)
        if miner.min_max_prob > 0:
            passes = passes & (max_prob(F.col(f"d_{name}")) >= miner.min_max_prob)
        if narrow:
            rows = rows.withColumn(f"g_{name}", passes)
            rows = rows.withColumn(f"d_{name}", F.when(F.col(f"g_{name}"), F.col(f"d_{name}")))
            continue
        counts = F.when(passes, weights(F.col(f"f_{name}"), visits, config.stop_symbol))
        rows = rows.withColumns({f"d_{name}": F.when(passes, F.col(f"d_{name}")), f"w_{name}": counts})
        if not config.include_stop:
            seen = F.filter("_first", lambda x: x["first"] < F.col("seq"))
            known = F.transform(seen, lambda x: x["activity"])
        answer = prediction(F.col(f"d_{name}" if config.include_stop else f"w_{name}"), config, known)
        rows = rows.withColumn(f"p_{name}", answer).drop(f"w_{name}")
    if narrow:
        rows = _ranked(rows, list(miners), activities, config)
    return rows.drop("_first", *[f"{part}_{n}" for n in miners for part in "vfng"])


# --------------------------------------------------------------------------------------------------------------
# running evaluation in arrival order
# --------------------------------------------------------------------------------------------------------------


def live_counts(rows: DataFrame, names: list[str], *, inclusive: bool = True, prefix: str = "_c_") -> DataFrame:
    """Correct answers of each member up to (or before) every event, and the event number ``index``."""
    sums = {f"{prefix}{n}": right(n) for n in names} | {"index": F.lit(1).cast("bigint")}
    return running_total(rows, ["seq"], sums, inclusive=inclusive)


def live_accuracy(rows: DataFrame, names: list[str]) -> DataFrame:
    """Accuracy of each member so far, after every event, in long form."""
    counted = live_counts(rows, names)
    entries = F.array(
        *[F.struct(F.lit(n).alias("model"), (F.col(f"_c_{n}") / F.col("index")).alias("accuracy")) for n in names]
    )
    return counted.select("index", "seq", F.explode(entries).alias("_e")).select("index", "seq", "_e.*")


def adaptive_live(rows: DataFrame, names: list[str], select_best: str = "acc", out: str = "dist") -> DataFrame:
    """Adaptive voting in arrival order: counts cover strictly earlier events. ``p_<out>`` is the chosen member's own prediction."""
    if select_best not in ("acc", "prob", "prob x acc"):
        raise ValueError("select_best must be 'acc', 'prob' or 'prob x acc'")
    dists = [F.col(f"d_{n}") for n in names]
    counted = live_counts(rows, names, inclusive=False).drop("index")
    counts = [F.col(f"_c_{n}").cast("double") for n in names]
    sure = [top_prob(d) for d in dists]
    scores = {"acc": counts, "prob": sure, "prob x acc": [a * b for a, b in zip(sure, counts, strict=True)]}[select_best]
    counted = counted.withColumn("_best", best_index(scores))
    chosen = {out: pick(dists, F.col("_best")), f"p_{out}": pick([F.col(f"p_{n}") for n in names], F.col("_best"))}
    return counted.withColumns(chosen).drop("_best", *[f"_c_{n}" for n in names])


def promotion_live(
    log: DataFrame, miners: dict[str, Miner], config: Config | None = None, threshold: float = 0.003, min_votes: int = 20
) -> DataFrame:
    """Promotion in arrival order: only the current member and its candidate learn.

    A member learns from the event after its activation on, as if the log began there.  Each stage is one prequential
    pass over the rest of the log; there are at most ``members - 1`` of them, and each brings one row to the driver.
    """
    config = config or Config()
    names = list(miners)
    born = {names[0]: None, names[1]: None} if len(names) > 1 else {names[0]: None}
    since, out, stage = None, None, 0

    def after(rows: DataFrame, edge) -> DataFrame:
        return rows if edge is None else rows.filter(F.col("seq") > F.lit(edge))

    def member(name: str) -> DataFrame:
        rows = prequential(after(log, born[name]), {name: miners[name]}, config)
        return after(rows, since).select("case_id", "activity", "seq", "chunk", f"d_{name}", f"p_{name}")

    while True:
        now = names[stage]
        rows = member(now)
        hit = None
        if stage + 1 < len(names):
            nxt = names[stage + 1]
            pair = rows.join(member(nxt).select("seq", f"d_{nxt}", f"p_{nxt}"), "seq")
            sums = {
                f"_c_{now}": right(now), f"_c_{nxt}": right(nxt), f"_b_{now}_{nxt}": beats(now, nxt),
                "index": F.lit(1).cast("bigint"),
            }
            ordered = running_total(pair, ["seq"], sums).select("seq", *sums)
            points = promotion_points(ordered, [now, nxt], threshold, min_votes)
            if points:
                hit = ordered.filter(F.col("index") == points[0]).select("seq").first()["seq"]
        part = rows.select("case_id", "activity", "seq", F.lit(stage).alias("active"), F.col(f"p_{now}").alias("prediction"))
        if hit is not None:
            part = part.filter(F.col("seq") <= F.lit(hit))
        out = part if out is None else out.unionByName(part)
        if hit is None:
            return out
        since, stage = hit, stage + 1
        if stage + 1 < len(names):
            born[names[stage + 1]] = hit


def running_evaluation(
    rows: DataFrame, predicted: str = "prediction", *, top_activities: bool = False, delays: DataFrame | None = None
) -> DataFrame:
    """After every event: counts, accuracy and top-k accuracy in percent, and means of the delay errors so far.

    ``top_activities`` counts an event as right if it is anywhere in the top-k.
    """
    p = F.col(predicted)
    in_top = F.coalesce(rank_of_actual(p, F.col("activity")) > 0, F.lit(False))
    listed = F.coalesce(F.array_contains(p["top_k"], F.col("activity")), F.lit(False))
    hit = F.coalesce(p["activity"] == F.col("activity"), F.lit(False))
    correct = (hit | listed) if top_activities else hit
    sums: dict[str, Column] = {
        "total_predictions": F.lit(1).cast("bigint"),
        "correct_predictions": correct.cast("bigint"),
        "missing_predictions": p.isNull().cast("bigint"),
        "top_k_correct_preds": (in_top & listed).cast("bigint"),
    }
    if delays is not None:
        rows = rows.join(delays.select("seq", "delay_s", "actual_delay"), "seq", "left")
        error = F.abs(F.col("delay_s") - F.col("actual_delay"))
        both = F.col("delay_s") + F.col("actual_delay")
        sums |= {
            "delay_predictions": F.col("delay_s").isNotNull().cast("bigint"),
            "_error": F.coalesce(error, F.lit(0.0)),
            "_actual": F.coalesce(F.when(F.col("delay_s").isNotNull(), F.col("actual_delay")), F.lit(0.0)),
            "_normal": F.coalesce(F.when(both == 0, F.lit(0.0)).otherwise(error / both), F.lit(0.0)),
        }
    out = running_total(rows, ["seq"], sums)
    total = F.col("total_predictions")
    columns = {
        "accuracy": F.col("correct_predictions") * 100.0 / total,
        "top_k_accuracy": F.col("top_k_correct_preds") * 100.0 / total,
    }
    if delays is not None:
        n = F.col("delay_predictions")
        columns |= {
            "mean_delay_error": F.try_divide(F.col("_error"), n),
            "mean_actual_delay": F.try_divide(F.col("_actual"), n),
            "mean_normalized_error": F.try_divide(F.col("_normal"), n),
        }
    out = out.withColumns(columns).drop("_error", "_actual", "_normal", "delay_s", "actual_delay")
    return out.withColumnRenamed("total_predictions", "index").withColumn("total_predictions", F.col("index"))


def snapshot_every(rows: DataFrame, n: int, index: str = "index") -> DataFrame:
    """Every ``n``-th row and the last one."""
    last = rows.agg(F.max(index).alias("n")).scalar()
    return rows.filter((F.col(index) % n == 0) | (F.col(index) == last))


def wide_evaluation(rows: DataFrame, names: list[str]) -> DataFrame:
    """One row per event with columns ``<model>.<metric>`` for all models, from one running pass."""
    sums = {"index": F.lit(1).cast("bigint")}
    for n in names:
        p = F.col(f"p_{n}")
        sums[f"_c_{n}"] = right(n)
        sums[f"_m_{n}"] = p.isNull().cast("bigint")
        sums[f"_k_{n}"] = F.coalesce(F.array_contains(p["top_k"], F.col("activity")), F.lit(False)).cast("bigint")
    counted = running_total(rows, ["seq"], sums)
    columns = []
    for n in names:
        columns += [
            F.col(f"_c_{n}").alias(f"{n}.correct_predictions"),
            F.col(f"_m_{n}").alias(f"{n}.missing_predictions"),
            F.col("index").alias(f"{n}.total_predictions"),
            (F.col(f"_c_{n}") * 100.0 / F.col("index")).alias(f"{n}.accuracy"),
            (F.col(f"_k_{n}") * 100.0 / F.col("index")).alias(f"{n}.top_k_accuracy"),
        ]
    return counted.select("index", *columns)


def prequential_delays(log: DataFrame, miner: Miner, config: Config | None = None) -> DataFrame:
    """Events whose delay could be predicted: mean of the last ``maxlen_delays`` earlier delays of (state, activity)."""
    config = config or Config()
    rows = previous_ts(annotate(positioned(log), {"_s": miner.structure}))
    timed = rows.filter(F.col("ts").isNotNull() & F.col("prev_ts").isNotNull()).select(
        "case_id", "pos", "seq", "chunk", "_s", "activity", seconds_between(F.col("ts"), F.col("prev_ts")).alias("actual_delay")
    )
    seen = lookback(timed, ["_s", "activity"], ["seq"], "actual_delay", config.maxlen_delays, "_d", split="chunk")
    mean = F.aggregate("_d", F.lit(0.0), lambda acc, x: acc + x) / F.size("_d")
    return seen.filter(F.size("_d") > 0).select("case_id", "pos", "seq", "activity", mean.alias("delay_s"), "actual_delay")
