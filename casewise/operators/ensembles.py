"""Several models, one answer.

:func:`member_rows` puts the distributions of all members next to each other on the test positions: one shuffle by case
for every structure, then one join per member with a table that has one row per state.  Voting itself is column
arithmetic on those distributions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.ordering import running_total
from casewise.functions.scratch import written
from casewise.functions.values import let
from casewise.operators.lookup import path_matches, test_rows
from casewise.operators.models import DIST, ModelSet, alphabet, distribution, max_prob, state_table, weights
from casewise.operators.positions import case_running
from casewise.operators.predict import delay_map, prediction, prob_of, total
from casewise.operators.structures import NGram, Structure, packed_state


def answer_table(base: DataFrame, models: ModelSet, *, likelihood: bool = False, delays: bool = False) -> DataFrame:
    """(member, raw, dist, prediction, ...): what every member answers in every raw state that can come up.

    All members are worked out together: their states in one aggregation, the contexts of all n-gram members in one
    distinct and one join of suffixes.
    """
    config = next(iter(models.values())).config
    member, grams, gate, sure = F.col("member"), [], F.lit(None), F.lit(None)
    for i, (name, model) in enumerate(models.items()):
        if isinstance(model.structure, NGram) and not model.structure.sticky:
            grams.append((i, name))
        gate = F.when(member == i, F.lit(model.miner.min_total_visits)).otherwise(gate)
        sure = F.when(member == i, F.lit(model.miner.min_max_prob)).otherwise(sure)
    numbers = [i for i, _ in grams]

    states = state_table(models.table, ["member"]).withColumn(
        "full_dist", distribution(F.col("freqs"), F.col("total_visits"), config.stop_symbol)
    )
    states = states.withColumn(
        "dist", F.when((F.col("total_visits") >= gate) & (max_prob(F.col("full_dist")) >= sure), F.col("full_dist"))
    )
    if config.include_stop:
        states = states.withColumn("prediction", prediction(F.col("dist"), config))
    else:
        states = states.withColumn("_known", alphabet(models.table))
        counts = F.when(F.col("dist").isNotNull(), weights(F.col("freqs"), F.col("total_visits"), config.stop_symbol))
        states = states.withColumn("prediction", prediction(counts, config, F.col("_known")))
    raw = states.filter(~member.isin(numbers)).select("member", F.col("state").alias("raw"), "state") if grams else states.select(
        "member", F.col("state").alias("raw"), "state"
    )
    if grams:
        raw = raw.unionByName(_resolved_contexts(base, models, grams))
    columns = ["member", "raw", "dist", "prediction"]
    table = raw.join(states.drop("freqs", "active_visits"), ["member", "state"], "left")
    if likelihood:
        # a state that exists without visits can only stop
        certain = F.array(F.struct(F.lit(config.stop_symbol).alias("activity"), F.lit(1.0).alias("prob"))).cast(DIST)
        table = table.withColumn("full_dist", F.coalesce("full_dist", certain))
        columns.append("full_dist")
    if delays:
        maps = None
        for i, model in enumerate(models.values()):
            packed = delay_map(model.delays).select(
                F.lit(i).alias("member"), model.structure.pack(F.col("state")).alias("state"), "delays"
            )
            maps = packed if maps is None else maps.unionByName(packed)
        table = table.join(maps, ["member", "state"], "left").withColumn(
            "delays", F.when(F.col("dist").isNotNull(), F.col("delays"))
        )
        columns.append("delays")
    return written(table.select(F.monotonically_increasing_id().alias("id"), *columns), "answers", ["member"])


def _resolved_contexts(base: DataFrame, models: ModelSet, grams: list[tuple[int, str]]) -> DataFrame:
    """(member, raw, state) of the n-gram members: the longest known suffix of every distinct context."""
    distinct = base.select(*[n for _, n in grams]).distinct()  # few next to the events, so they are unfolded afterwards
    contexts = distinct.select(
        F.explode(F.array(*[F.struct(F.lit(i).alias("member"), F.col(n).alias("context")) for i, n in grams])).alias("_c")
    ).select("_c.*").distinct()
    n = F.size("context")
    suffixes = contexts.withColumn("n", F.explode(F.sequence(F.least(F.lit(1), n), n))).withColumn(
        "suffix", F.slice("context", F.size("context") - F.col("n") + 1, F.col("n"))
    )
    seen = models.table.filter(F.col("member").isin([i for i, _ in grams])).select("member", "next_state.items").distinct()
    prefixes = F.transform(F.sequence(F.lit(0), F.size("items")), lambda k: F.slice("items", F.lit(1), k))
    access = seen.select("member", F.explode(prefixes).alias("suffix")).distinct()
    best = suffixes.join(access, ["member", "suffix"]).groupBy("member", "context").agg(F.max_by("suffix", "n").alias("best"))
    return best.select(
        "member", packed_state(items=F.col("context")).alias("raw"), packed_state(items=F.col("best")).alias("state")
    )


def member_rows(
    log: DataFrame, models: ModelSet, *, likelihood: bool = False, delays: bool = False, stop: bool = True
) -> DataFrame:
    """Test positions with ``d_<member>`` (distribution) and ``p_<member>`` (own prediction) of every member.

    Both are null where the member has no answer.  They are worked out once per state, not per event.

    Once no member knows its state, the case is lost to the ensemble: all later distributions are null.
    ``i_<member>`` names the answer, so that equal combinations of answers can be voted on once (:func:`vote_once`).
    ``f_<member>`` (ungated distribution) and ``m_<member>`` (delays) are added on request.
    """
    base = test_rows(log, models, stop=stop)
    rows = base
    for name, model in models.items():
        if model.structure.sticky:
            rows = path_matches(rows, model, name)
            rows = rows.withColumn(name, F.when(F.col("_valid"), F.col(name))).drop("_valid")
    table = answer_table(base, models, likelihood=likelihood, delays=delays)
    short = {"dist": "d", "prediction": "p", "full_dist": "f", "delays": "m"}
    for name, model in models.items():
        own = table.filter(F.col("member") == models.number(name)).select(
            model.structure.unpack(F.col("raw")).alias(name),
            F.lit(True).alias(f"k_{name}"),
            F.when(F.col("dist").isNotNull(), F.col("id")).alias(f"i_{name}"),
            *[F.col(c).alias(f"{short[c]}_{name}") for c in table.columns if c in short],
        )
        rows = rows.join(own, name, "left")
    lost = F.lit(True)
    for name in models:
        lost = lost & F.col(f"k_{name}").isNull()
    rows = case_running(rows.withColumn("_lost", lost.cast("int")), {"_gone": ("max", F.col("_lost"))}, inclusive=True)
    gone = F.coalesce("_gone", F.lit(0)) == 1
    kept = [c for n in models for c in (f"i_{n}", f"d_{n}", f"p_{n}", f"f_{n}", f"m_{n}") if c in rows.columns]
    rows = rows.withColumns({c: F.when(~gone, F.col(c)) for c in kept})
    return rows.drop("_lost", "_gone", *models, *[f"k_{n}" for n in models])


def member_answers(log: DataFrame, models: ModelSet) -> tuple[DataFrame, DataFrame]:
    """Test positions with ``i_<member>``, the number of each member's answer (null without one), and the table of the answers.

    The rows carry numbers only, so distributions are never shuffled with them; :func:`with_answers` adds the answers to what is
    left after counting. Members of one structure are looked up together. Both tables are written, so nothing on top of them
    goes back to the log. The answers are those of :func:`member_rows`.
    """
    order = [c for c in ("case_id", "split", "case_seq", "case_chunk", "pos", "activity")]
    base = test_rows(log, models)
    order = [c for c in order if c in base.columns]
    twins: dict[Structure, list[str]] = {}
    for name, model in models.items():
        twins.setdefault(model.structure, []).append(name)
    firsts = [names[0] for names in twins.values()]
    base = written(base.select(*order, *models), "test-rows")
    rows = base.select(*order, *firsts)
    for structure, (name, *_) in twins.items():
        if structure.sticky:
            rows = path_matches(rows, models[name], name)
            rows = rows.withColumn(name, F.when(F.col("_valid"), F.col(name))).drop("_valid")
    table = answer_table(base, models)
    for structure, names in twins.items():
        first, numbers = names[0], [models.number(n) for n in names]
        ids = [F.max(F.when((F.col("member") == k) & F.col("dist").isNotNull(), F.col("id"))).alias(f"i_{n}") for n, k in zip(names, numbers, strict=True)]
        own = table.filter(F.col("member").isin(numbers)).groupBy("raw").agg(*ids)
        own = own.select(structure.unpack(F.col("raw")).alias(first), F.lit(True).alias(f"k_{first}"), *[f"i_{n}" for n in names])
        rows = rows.join(own, first, "left").drop(first)
    lost = F.lit(True)
    for name in firsts:
        lost = lost & F.col(f"k_{name}").isNull()
    rows = case_running(rows.withColumn("_lost", lost.cast("int")), {"_gone": ("max", F.col("_lost"))}, inclusive=True)
    gone = F.coalesce("_gone", F.lit(0)) == 1
    rows = rows.select(*order, *[F.when(~gone, F.col(f"i_{n}")).alias(f"i_{n}") for n in models])
    return written(rows, "member-answers"), table


def with_answers(rows: DataFrame, answers: DataFrame, models: ModelSet, names: list[str], columns: tuple[str, ...] = ("dist", "prediction")) -> DataFrame:
    """Add ``d_<member>`` and ``p_<member>`` to rows with ``i_<member>``."""
    short = {"dist": "d", "prediction": "p"}
    for name in names:
        own = answers.filter((F.col("member") == models.number(name)) & F.col("dist").isNotNull())
        own = own.select(F.col("id").alias(f"i_{name}"), *[F.col(c).alias(f"{short[c]}_{name}") for c in columns])
        rows = rows.join(own, f"i_{name}", "left")
    return rows


def counted_combinations(rows: DataFrame, answers: DataFrame, models: ModelSet, names: list[str], votes: dict[str, Column]) -> DataFrame:
    """Distinct combinations of member answers with the ``votes`` on them and, of every actual ``activity``, the number ``n`` of rows.

    Whatever is counted over the positions of a test log can be counted over these; the aggregation is map-side combined.
    """
    keys = [f"i_{n}" for n in names]
    counts = rows.groupBy(*keys, "activity").agg(F.count(F.lit(1)).alias("n"))
    combos = counts.groupBy(*keys).agg(F.collect_list(F.struct("activity", "n")).alias("_seen"))
    voted = with_answers(combos, answers, models, names).withColumns(votes)
    return voted.select(*[f"p_{n}" for n in names], *votes, F.explode("_seen").alias("_a")).select("*", "_a.*").drop("_a")


def vote_once(rows: DataFrame, names: list[str], votes: dict[str, Column]) -> DataFrame:
    """Add the ``votes`` columns, each worked out once per distinct combination of member answers.

    A combination is a tuple of answer numbers; there are few of them next to the events, and they are found by a
    map-side-combined aggregation.
    """
    keys = [f"i_{n}" for n in names]
    keyed = rows.withColumns({k: F.coalesce(F.col(k), F.lit(-1)) for k in keys})
    used = [c for n in names for c in (f"d_{n}", f"p_{n}") if c in rows.columns]
    combos = keyed.select(*keys, *used).dropDuplicates(keys)
    done = combos.select(*keys, *[c.alias(n) for n, c in votes.items()])
    return keyed.join(done, keys)


# --------------------------------------------------------------------------------------------------------------
# votes on one row
# --------------------------------------------------------------------------------------------------------------


def _empty() -> Column:
    return F.array().cast(DIST)


def check_weights(weights: list[float] | None, n: int) -> list[float]:
    if weights is None:
        return [1.0] * n
    if len(weights) != n or any(w < 0 for w in weights):
        raise ValueError(f"need {n} weights, none of them negative")
    return list(weights)


def soft_voting(dists: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted sum of the member distributions, normalised; members without an answer add nothing."""
    weights = check_weights(weights, len(dists))

    def weigh(dist: Column, weight: float) -> Column:
        return F.transform(F.coalesce(dist, _empty()), lambda x: _entry(x["activity"], x["prob"] * F.lit(float(weight))))

    def merge(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda x: x["activity"]))

        def share(weight: Column) -> Column:
            def one(k: Column) -> Column:
                mine = total(F.filter(entries, lambda x: x["activity"] == k))
                return _entry(k, F.when(weight > 0, mine / weight).otherwise(mine))

            return F.when(F.size(entries) > 0, F.transform(keys, one))

        return let(total(entries), share)

    return let(F.concat(*[weigh(d, w) for d, w in zip(dists, weights, strict=True)]), merge).cast(DIST)


def _entry(activity: Column, prob: Column) -> Column:
    return F.struct(activity.alias("activity"), prob.alias("prob"))


def hard_voting(choices: list[Column], stop: str) -> Column:
    """All weight on the activity most members chose; among equals, the one of the earliest member.

    ``choices`` are the members' own predicted activities, null where a member has none.
    """
    votes = [sum((F.coalesce(other.eqNullSafe(c).cast("int"), F.lit(0)) for other in choices), F.lit(0)) for c in choices]
    scores = [F.when(c.isNull(), F.lit(0)).otherwise(v) for c, v in zip(choices, votes, strict=True)]
    winner = pick(choices, first_largest(scores))
    return let(
        winner,
        lambda w: F.when(w == stop, F.array(_entry(w, F.lit(1.0)))).when(
            w.isNotNull(), F.array(_entry(F.lit(stop), F.lit(0.0)), _entry(w, F.lit(1.0)))
        ),
    ).cast(DIST)


def winning_chance(shares: np.ndarray, target: int) -> float:
    """Chance that ``target`` wins when member ``i`` votes for activity ``j`` with chance ``shares[i, j]``.

    For each group of members that votes for the target, the other members are dealt out to the other activities, one
    activity at a time, so that none of them beats the target; the work grows linearly with the activities.
    """
    members, activities = shares.shape
    full = (1 << members) - 1
    others = [j for j in range(activities) if j != target and shares[:, j].any()]
    product = np.ones((1 << members, activities))
    for mask in range(1, full + 1):
        low = mask & -mask
        product[mask] = product[mask ^ low] * shares[low.bit_length() - 1]
    chance = 0.0
    for voters in range(1, full + 1):
        weight = product[voters, target]
        if weight == 0.0:
            continue
        size, first = bin(voters).count("1"), (voters & -voters)
        rest = full ^ voters
        dealt = np.zeros(1 << members)
        dealt[0] = 1.0
        for j in others:
            nxt = dealt.copy()
            group = rest
            while group:
                n = bin(group).count("1")
                if (n < size or (n == size and (group & -group) > first)) and product[group, j] > 0.0:
                    free = rest ^ group
                    done = free
                    while True:
                        nxt[done | group] += dealt[done] * product[group, j]
                        if done == 0:
                            break
                        done = (done - 1) & free
                group = (group - 1) & rest
            dealt = nxt
        chance += weight * dealt[rest]
    return chance


def _winning_chances(batches):
    """Arrow batches of (key, member shares, target index) to (key, chance)."""
    for batch in batches:
        chances = [
            0.0 if t < 0 or len(m) == 0 else winning_chance(np.array([np.asarray(r, float) for r in m]), int(t))
            for m, t in zip(batch["shares"], batch["target"], strict=True)
        ]
        yield pd.DataFrame({"_ka": batch["_ka"], "_kb": batch["_kb"], "_chance": chances})


def hard_voting_likelihood(rows: DataFrame, names: list[str], out: str = "likelihood") -> DataFrame:
    """Chance that the actual activity wins when members vote at random by their distributions; 0 if one has none.

    Scored once per distinct (member distributions, activity), named by a 128-bit fingerprint, and joined back.
    """
    dists = [F.col(f"d_{n}") for n in names]
    everyone = F.lit(True)
    for d in dists:
        everyone = everyone & d.isNotNull()
    keyed = rows.withColumns(
        {
            "_ka": F.when(everyone, F.xxhash64(F.lit(1), *dists, "activity")),
            "_kb": F.when(everyone, F.xxhash64(F.lit(2), *dists, "activity")),
        }
    )

    def shares(keys: Column) -> Column:
        return F.array(*[_shares(d, keys) for d in dists])

    keys = F.array_distinct(F.flatten(F.array(*[F.transform(d, lambda x: x["activity"]) for d in dists])))
    combos = (
        keyed.filter(everyone)
        .dropDuplicates(["_ka", "_kb"])
        .select(
            "_ka",
            "_kb",
            let(keys, shares).alias("shares"),
            let(keys, lambda k: F.array_position(k, F.col("activity")).cast("int") - 1).alias("target"),
        )
        .mapInPandas(_winning_chances, "_ka long, _kb long, _chance double")
    )
    joined = keyed.join(combos, ["_ka", "_kb"], "left")
    return joined.withColumn(out, F.coalesce("_chance", F.lit(0.0))).drop("_ka", "_kb", "_chance")


def _shares(dist: Column, keys: Column) -> Column:
    return F.transform(keys, lambda k: prob_of(dist, k))


def fallback(dists: list[Column]) -> Column:
    """The first member with an answer."""
    return F.coalesce(*dists)


def fallback_likelihood(full: list[Column], activity: Column) -> Column:
    """The first positive likelihood."""
    return F.coalesce(*[F.nullif(prob_of(d, activity), F.lit(0.0)) for d in full], F.lit(0.0))


def relativize(dists: list[Column]) -> Column:
    """The second member's answer where the first has one."""
    if len(dists) != 2:
        raise ValueError("relativize needs exactly two models")
    return F.when(dists[0].isNotNull(), dists[1])


def first_largest(scores: list[Column]) -> Column:
    """Index of the largest score, the first among equals."""
    if len(scores) == 1:
        return F.lit(0)
    top = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == top, F.lit(i)).otherwise(out)
    return out


def best_index(scores: list[Column]) -> Column:
    return first_largest([F.round(s, 12) for s in scores])


def pick(columns: list[Column], index: Column) -> Column:
    out = F.lit(None)
    for i, c in enumerate(columns):
        out = F.when(index == i, c).otherwise(out)
    return out


def top_prob(dist: Column) -> Column:
    return F.coalesce(max_prob(dist), F.lit(0.0))


def voting_delays(delays: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean delay per activity over the members that have one, as a map."""
    weights = check_weights(weights, len(delays))
    empty = F.create_map().cast("map<string,double>")
    maps = [F.coalesce(d, empty) for d in delays]
    keys = F.array_distinct(F.flatten(F.array(*[F.map_keys(d) for d in maps])))

    def mean(k: Column) -> Column:
        value, weight = F.lit(0.0), F.lit(0.0)
        for d, w in zip(maps, weights, strict=True):
            delay = F.try_element_at(d, k)
            value = value + F.coalesce(delay * F.lit(float(w)), F.lit(0.0))
            weight = weight + F.when(delay.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.struct(k.alias("key"), F.try_divide(value, weight).alias("value"))

    entries = F.filter(F.transform(keys, mean), lambda e: e["value"].isNotNull())
    return F.map_from_entries(entries)


# --------------------------------------------------------------------------------------------------------------
# votes that learn along the evaluation
# --------------------------------------------------------------------------------------------------------------


def evaluation_running(
    frame: DataFrame, sums: dict[str, Column], *, index: str | None = None, inclusive: bool = True
) -> DataFrame:
    """Running sums in evaluation order: case after case, position by position.

    Inside a case the sum runs along the case; what earlier cases add is a running total over the table of cases.
    """
    if index:
        sums = {**sums, index: F.lit(1).cast("bigint")}
    frame = frame.withColumns({f"_v_{n}": c for n, c in sums.items()})
    rows = case_running(frame, {n: ("sum", F.col(f"_v_{n}")) for n in sums}, inclusive=inclusive)
    cases = frame.groupBy("case_id", "case_seq", "case_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    offsets = running_total(
        cases, ["case_seq"], {f"_o_{n}": F.col(f"_t_{n}") for n in sums}, inclusive=False, chunk="case_chunk"
    ).select("case_id", *[f"_o_{n}" for n in sums])
    return (
        rows.join(offsets, "case_id")
        .withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in sums})
        .drop(*[f"{t}_{n}" for n in sums for t in ("_o", "_v")])
    )


def right(name: str) -> Column:
    """1 where the member's own prediction is the actual activity."""
    return F.coalesce((F.col(f"p_{name}.activity") == F.col("activity")).cast("bigint"), F.lit(0).cast("bigint"))


def beats(now: str, nxt: str) -> Column:
    return ((right(nxt) == 1) & (right(now) == 0)).cast("bigint")


def running_scores(rows: DataFrame, ladders: list[list[str]]) -> DataFrame:
    """Add what adaptive voting and promotion need, in one running pass for any number of member ladders.

    ``index`` numbers the rows in evaluation order; ``_c_<member>`` counts its correct answers and ``_b_<a>_<b>`` the rows
    where ``b`` was right and ``a``, the member before it, was not, both up to and including the row.
    """
    sums = {f"_c_{n}": right(n) for names in ladders for n in names}
    sums |= {f"_b_{a}_{b}": beats(a, b) for names in ladders for a, b in zip(names, names[1:], strict=False)}
    return evaluation_running(rows, sums, index="index")


def _scored_columns(rows: DataFrame) -> list[str]:
    return ["index", *[c for c in rows.columns if c.startswith(("_c_", "_b_"))]]


def adaptive_voting(rows: DataFrame, names: list[str], select_best: str = "acc", out: str = "dist", answer: str = "d") -> DataFrame:
    """Add the answer (distribution ``d`` or prediction ``p``) of the member that is best so far.

    ``acc``: most correct answers before this row; ``prob``: highest best probability; ``prob x acc``: their product.
    """
    if select_best not in ("acc", "prob", "prob x acc"):
        raise ValueError("select_best must be 'acc', 'prob' or 'prob x acc'")
    dists = [F.col(f"d_{n}") for n in names]
    if select_best == "prob":
        return rows.withColumn(out, pick([F.col(f"{answer}_{n}") for n in names], best_index([top_prob(d) for d in dists])))
    scored = f"_c_{names[0]}" in rows.columns
    if not scored:
        rows = running_scores(rows, [names])
    counts = [(F.col(f"_c_{n}") - right(n)).cast("double") for n in names]
    sure = [F.coalesce(F.col(f"p_{n}.probability"), F.lit(0.0)) for n in names]
    scores = counts if select_best == "acc" else [p * c for p, c in zip(sure, counts, strict=True)]
    rows = rows.withColumn(out, pick([F.col(f"{answer}_{n}") for n in names], best_index(scores)))
    return rows if scored else rows.drop(*_scored_columns(rows))


def promotion_points(
    ordered: DataFrame, names: list[str], threshold: float = 0.003, min_votes: int = 20
) -> list[int]:
    """Indices at which the next member takes over.

    ``ordered`` has the columns of :func:`running_scores`.  Each of the at most ``members - 1`` rounds brings one row to
    the driver.
    """
    points: list[int] = []
    start = dict.fromkeys(ordered.columns, 0)
    for now, nxt in zip(names, names[1:], strict=False):
        n = (F.col("index") - start["index"]).cast("double")
        votes = F.col(f"_b_{now}_{nxt}") - start[f"_b_{now}_{nxt}"]
        lead = (F.col(f"_c_{nxt}") - start[f"_c_{nxt}"]) / n - (F.col(f"_c_{now}") - start[f"_c_{now}"]) / n
        hit = (
            ordered.filter((F.col("index") > start["index"]) & (votes >= min_votes))
            .filter(F.round(lead, 12) > threshold)
            .orderBy("index")
            .limit(1)
            .first()
        )
        if hit is None:
            break
        points.append(hit["index"])
        start = hit.asDict()
    return points


def promotion(
    rows: DataFrame, names: list[str], threshold: float = 0.003, min_votes: int = 20, out: str = "dist", active: str = "active", answer: str = "d"
) -> DataFrame:
    """Start with the first member; move to the next once it has outvoted the current one.

    The row that triggers a move is still answered by the old member.
    """
    scored = f"_c_{names[0]}" in rows.columns
    if not scored:
        rows = running_scores(rows, [names])
    small = rows.select(*_scored_columns(rows)).persist()
    try:
        points = promotion_points(small, names, threshold, min_votes)
    finally:
        small.unpersist()
    stage = F.lit(0)
    for p in points:
        stage = stage + (F.col("index") > p).cast("int")
    rows = rows.withColumn(active, stage).withColumn(out, pick([F.col(f"{answer}_{n}") for n in names], F.col(active)))
    return rows if scored else rows.drop(*_scored_columns(rows))


def model_usage(rows: DataFrame, names: list[str], ensemble: str = "prediction") -> DataFrame:
    """How each member contributed: answered, answered right, agreed with the ensemble, agreed and right.

    Rows with a column ``n`` stand for ``n`` positions each.
    """
    weight = F.col("n") if "n" in rows.columns else F.lit(1)
    chosen = F.col(f"{ensemble}.activity")
    agreed = {n: F.coalesce(F.col(f"p_{n}.activity") == chosen, F.lit(False)) for n in names}
    anyone = F.lit(False)
    for a in agreed.values():
        anyone = anyone | a
    good = chosen == F.col("activity")
    members = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("model_index"),
                    F.col(f"p_{n}").isNotNull().alias("answered"),
                    (right(n) == 1).alias("right"),
                    agreed[n].alias("agreed"),
                    (agreed[n] & good).alias("agreed_right"),
                    anyone.alias("any"),
                    weight.alias("n"),
                )
                for i, n in enumerate(names)
            ]
        )
    )

    def times(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0)))

    counts = rows.select(members.alias("m")).select("m.*").groupBy("model_index").agg(
        times("agreed").alias("count"),
        times("agreed_right").alias("correct_count"),
        times("any").alias("total_events"),
        times("answered").alias("prediction_count"),
        times("right").alias("prediction_correct"),
    )

    def share(a: str, b: str, scale: float = 100.0) -> Column:
        return F.coalesce(F.try_divide(F.col(a) * F.lit(scale), F.col(b)), F.lit(0.0))

    return counts.withColumns(
        {
            "usage_pct": share("count", "total_events"),
            "correct_usage_pct": share("correct_count", "total_events"),
            "accuracy_when_used": share("correct_count", "count", 1.0),
            "prediction_accuracy_pct": share("prediction_correct", "prediction_count"),
        }
    )


# --------------------------------------------------------------------------------------------------------------
# strategies
# --------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Strategy:
    """A named way to combine members."""

    members: tuple[str, ...]
    kind: str = "single"
    weights: tuple[float, ...] | None = None
    options: dict = field(default_factory=dict)

    def vote(self, config: Config) -> Column | None:
        """The prediction as a function of the member answers, or None if it depends on earlier rows."""
        dists = [F.col(f"d_{n}") for n in self.members]
        own = [F.col(f"p_{n}") for n in self.members]
        if self.kind == "single":
            return own[0]
        if self.kind == "soft":
            return prediction(soft_voting(dists, list(self.weights) if self.weights else None), config)
        if self.kind == "hard":
            return prediction(hard_voting([p["activity"] for p in own], config.stop_symbol), config)
        if self.kind == "fallback":
            return F.coalesce(*[F.when(d.isNotNull(), p) for d, p in zip(dists, own, strict=True)])
        if self.kind == "relativize":
            return F.when(dists[0].isNotNull(), own[1])
        if self.kind == "adaptive" and self.options.get("select_best") == "prob":
            return pick(own, best_index([top_prob(d) for d in dists]))
        return None

    def run(self, rows: DataFrame, out: str, answer: str = "p") -> DataFrame:
        """Add the prediction (or another ``answer``, such as its number ``i``) of a strategy that learns along the evaluation."""
        if self.kind == "adaptive":
            return adaptive_voting(rows, list(self.members), out=out, answer=answer, **self.options)
        if self.kind == "promotion":
            rows = promotion(rows, list(self.members), out=out, active="_active", answer=answer, **self.options)
            return rows.drop("_active")
        raise ValueError(f"unknown strategy kind {self.kind!r}")
