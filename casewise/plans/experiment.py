"""The batch experiment: learn a set of strategies on one part of a log and score all of them on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.config import Config
from casewise.functions.scratch import written
from casewise.operators.ensembles import Strategy, counted_combinations, member_answers, member_rows, running_scores, vote_once, with_answers
from casewise.operators.evaluate import weighted_outcomes
from casewise.operators.models import Miner, train_all
from casewise.operators.structures import Bag, NGram, PrefixTree

MIN_VISITS = 10


def build_strategies(
    ngrams: tuple[int, ...] = (2, 3, 4, 5),
    voting: tuple[tuple[int, ...], ...] = ((2, 3, 4),),
    adaptive: tuple[tuple[int, ...], ...] = ((2, 3, 4),),
    select_best: tuple[str, ...] = ("acc", "prob", "prob x acc"),
    chains: tuple[tuple[int, ...], ...] = (),
) -> tuple[dict[str, Miner], dict[str, Strategy]]:
    """Members and strategies of the standard experiment.

    ``ngrams`` are n-gram sizes (window + 1); the other tuples hold window lengths.  Members that several strategies
    share are trained and looked up once.  ``chains`` adds fall-back chains from long to short windows.
    """
    members: dict[str, Miner] = {"fpt": Miner(PrefixTree()), "bag": Miner(Bag())}
    strategies: dict[str, Strategy] = {"fpt": Strategy(("fpt",)), "bag": Strategy(("bag",))}

    def gram(window: int, gate: int = 1) -> str:
        name = f"w{window}" if gate == 1 else f"w{window}_{gate}"
        members[name] = Miner(NGram(window), min_total_visits=gate)
        return name

    members["fpt_gated"] = Miner(PrefixTree(), min_total_visits=MIN_VISITS)
    for n in ngrams:
        strategies[f"ngram_{n}"] = Strategy((gram(n - 1),))
    strategies["fallback fpt->ngram"] = Strategy(("fpt_gated", gram(4)), "fallback")
    strategies["hard voting"] = Strategy(("bag", "fpt_gated", gram(2), gram(3), gram(4)), "hard")
    for windows in voting:
        label = f"soft voting {windows}"
        strategies[label] = Strategy(("bag", "fpt_gated", *[gram(w) for w in windows]), "soft")
        strategies[f"{label}*"] = Strategy(("bag", "fpt_gated", *[gram(w, MIN_VISITS) for w in windows]), "soft")
    for windows in adaptive:
        names = tuple(gram(w) for w in windows)
        for best in select_best:
            strategies[f"adaptive {windows} {best}"] = Strategy(names, "adaptive", options={"select_best": best})
        strategies[f"promotion {windows}"] = Strategy(names, "promotion")
    for windows in chains:
        gated = [gram(w, MIN_VISITS) for w in windows[:-1]]
        strategies["fallback " + "->".join(map(str, windows))] = Strategy((*gated, gram(windows[-1])), "fallback")
    return members, strategies


def run_strategies(
    train: DataFrame, test: DataFrame, members: dict[str, Miner], strategies: dict[str, Strategy], config: Config | None = None
) -> DataFrame:
    """One row per (strategy, test position) with its prediction."""
    config = config or Config()
    rows = member_rows(test, train_all(train, members, config))
    slots = {name: f"_s{i}" for i, name in enumerate(strategies)}
    votes = {name: s.vote(config) for name, s in strategies.items()}
    rows = vote_once(rows, list(members), {slots[n]: v for n, v in votes.items() if v is not None})
    late = [n for n, v in votes.items() if v is None]
    if late:
        rows = running_scores(rows, [list(strategies[n].members) for n in late])
    for name in late:
        rows = strategies[name].run(rows, slots[name])
    tall = F.explode(
        F.array(*[F.struct(F.lit(name).alias("strategy"), F.col(slot).alias("prediction")) for name, slot in slots.items()])
    )
    return rows.select("case_id", "case_seq", "case_chunk", "pos", "activity", tall.alias("_t")).select(
        "case_id", "case_seq", "case_chunk", "pos", "activity", "_t.*"
    )


def evaluate_strategies(train: DataFrame, test: DataFrame, config: Config | None = None, **choices) -> DataFrame:
    """Outcome counts of every strategy from one pass over the test log.

    Strategies that depend on the member answers only are voted and counted once per distinct combination of answers. Those that learn
    along the evaluation choose an answer per row; only its number is carried, and equal choices are counted before they are scored.
    """
    config = config or Config()
    members, strategies = build_strategies(**choices)
    models = train_all(train, members, config)
    rows, answers = member_answers(test, models)
    votes = {name: s.vote(config) for name, s in strategies.items()}
    late = [n for n, v in votes.items() if v is None]
    slots = {name: f"_s{i}" for i, name in enumerate(strategies)}

    def tall(names: list[str], value: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(slots[n]).alias(value)) for n in names])).alias("_t")

    early = [n for n in votes if n not in late]
    used = [m for m in members if any(m in strategies[n].members for n in early)]
    combos = counted_combinations(rows, answers, models, used, {slots[n]: votes[n] for n in early})
    scored = combos.select("activity", "n", tall(early, "prediction")).select("activity", "n", "_t.*")
    if late:
        ladders = [list(strategies[n].members) for n in late]
        learners = [m for m in members if any(m in names for names in ladders)]
        others = [f"i_{m}" for m in members if m not in learners]
        chosen = with_answers(rows.drop(*others), answers, models, learners, ("prediction",))
        chosen = written(running_scores(chosen, ladders), "running-scores")
        for name in late:
            chosen = strategies[name].run(chosen, slots[name], answer="i")
        counts = chosen.select("activity", tall(late, "id")).groupBy("_t.strategy", "_t.id", "activity").agg(F.count(F.lit(1)).alias("n"))
        scored = scored.unionByName(counts.join(answers.select("id", "prediction"), "id", "left").drop("id"))
    return weighted_outcomes(scored, config.top_k, ["strategy"])
