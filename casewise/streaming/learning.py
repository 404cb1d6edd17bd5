"""Predicting and learning on a live stream, one micro-batch at a time.

Inside a micro-batch every event is answered by the models as they were when the batch began; then what the batch teaches
is added.  (For the exact event-by-event result on a finite log see :mod:`casewise.operators.prequential`.)

All members share one table keyed by state: how often a state was entered, and how often and after which delays each activity
followed.  A batch reads the buckets of its own states only, adds one version, and folds versions into a new base every
``compact_every`` batches; see :mod:`casewise.streaming.store`.  Everything that depends on earlier events, such as the correct answers of
each member and the stage of a promotion, is one row per combination, stored under the number of the batch like all else.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.config import Config
from casewise.functions.ordering import running_total
from casewise.functions.values import seconds_between
from casewise.operators.compare import pair_counts, ratios, vote_array
from casewise.operators.drift import alter_log, check_alteration, numbered
from casewise.operators.ensembles import Strategy, beats, best_index, pick, right, top_prob
from casewise.operators.models import Miner, distribution, max_prob, weights
from casewise.operators.predict import prediction
from casewise.sinks.batches import BatchStats
from casewise.streaming.cases import CaseStates
from casewise.streaming.store import BucketStore, at_once

SCORES = ("total_predictions", "correct_predictions", "missing_predictions", "top_k_correct_preds")
STATE = "struct<items:array<string>,level:bigint,a:bigint,b:bigint>"
RECENT = "array<struct<seq:bigint,delay:double>>"
PROGRESS = {"stage": ("int", "last"), "born": ("array<bigint>", "last"), "counts": ("map<string,bigint>", "last")}


@dataclass
class Progress:
    """Where a combination stands: correct answers of its members, and for promotions the active member and when members began to learn.

    ``counts`` of a promotion start anew with every move; ``born`` holds the order of the event after which a member learns.
    """

    stage: int
    born: list[int | None]
    counts: dict[str, int]


class StreamingModels:
    """Miners that predict and learn along a stream, and ensembles of them.

    Adaptive votes and promotions go by the answers of all earlier events, those of the same batch included.  In a promotion only the active
    member and its candidate learn: later members keep models of their own, which begin with the first event after the promotion that makes them
    candidates.  Cases keep their real history; a case that such a member meets for the first time counts as an arrival in the state it is in.
    ``with_delays`` keeps the last ``config.maxlen_delays`` delays per state and activity; ``with_stats`` writes the running evaluation after every batch
    to ``stats``.
    """

    def __init__(
        self, spark: SparkSession, path: str, miners: dict[str, Miner], config: Config | None = None, *, compact_every: int = 20,
        strategies: dict[str, Strategy] | None = None, with_delays: bool = False, with_stats: bool = False, buckets: int = 8, ttl_ms: int | None = None,
    ) -> None:
        self.spark, self.path, self.config = spark, path, config or Config()
        self.stats = BatchStats(spark, f"{path}/stats") if with_stats else None
        self.strategies, self.with_delays, self.compact_every = strategies or {}, with_delays, compact_every
        if self.config.randomized:
            raise ValueError("randomized predictions are not drawn on streams")
        #: model -> member whose structure and gate it has; members of promotions after the second have a model of their own
        self.models = {n: n for n in miners}
        #: model -> (promotion, place in its ladder), for models that do not learn from the start
        self.late: dict[str, tuple[str, int]] = {}
        for name, strategy in self.strategies.items():
            if strategy.kind == "promotion":
                for i, member in enumerate(strategy.members[2:], 2):
                    self.models[f"{name}:{member}"] = member
                    self.late[f"{name}:{member}"] = (name, i)
            elif strategy.kind != "adaptive" and strategy.vote(self.config) is None:
                raise ValueError(f"{name}: unknown combination")
        self.miners = miners
        self.cases = CaseStates(spark, f"{path}/cases", {n: m.structure for n, m in miners.items()}, buckets=buckets, ttl_ms=ttl_ms)
        values = {"n": ("bigint", "sum"), "next_state": (STATE, "any")} | ({"recent": (RECENT, "recent")} if with_delays else {})
        self.counts = BucketStore(
            spark, f"{path}/models", f"model string, state {STATE}, activity string", values, by=["model", "state"], buckets=buckets, recent=self.config.maxlen_delays
        )
        self.alphabet = BucketStore(spark, f"{path}/alphabet", "activity string", {"n": ("bigint", "sum")}, buckets=1)
        # scores by model, and by votes and actual activity how often they came together
        tally = "model string, votes array<struct<model:string,predicted:string>>, actual string"
        self.tallies = BucketStore(spark, f"{path}/tallies", tally, dict.fromkeys((*SCORES, "n"), ("bigint", "sum")), buckets=buckets)
        self.progress = BucketStore(spark, f"{path}/progress", "strategy string", PROGRESS, buckets=1)
        self.stores = [self.counts, self.tallies] + ([] if self.config.include_stop else [self.alphabet])
        if self._learned():
            self.stores.append(self.progress)

    def _learned(self) -> dict[str, Strategy]:
        """Combinations that depend on earlier events."""
        return {n: s for n, s in self.strategies.items() if s.vote(self.config) is None}

    def _ladder(self, name: str) -> list[str]:
        """Models of the members of a combination."""
        return [f"{name}:{m}" if f"{name}:{m}" in self.late else m for m in self.strategies[name].members]

    def _packed(self, model: str, after: bool = False) -> Column:
        member = self.models[model]
        return self.miners[member].structure.pack(F.col(f"{member}_next" if after else member)).cast(STATE)

    # ------------------------------------------------------------------------------------------------------------------
    # one batch
    # ------------------------------------------------------------------------------------------------------------------

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """Predict a batch of events, then learn from it."""
        for store in (self.cases, *self.stores):
            store.clean(batch_id)
        held = [batch.persist()]
        try:
            contexts = self.cases.contexts(batch, batch_id).persist()
            held.append(contexts)
            rows = self._answered(contexts, batch_id, held)
            for name, strategy in self.strategies.items():
                if name not in self._learned():
                    rows = rows.withColumn(f"p_{name}", strategy.vote(self.config))
            progress = self._progress(batch_id)
            if self._learned():
                rows = self._along(rows, progress, held)
            columns = ["case_id", "activity", "ts", "seq", "pos", "prev_ts"]
            columns += [c for c in rows.columns if c.startswith(("p_", "m_", "active_"))]
            done = rows.select(*columns)
            path = f"{self.path}/predictions/batch_id={batch_id}"
            jobs = [
                lambda: done.write.mode("overwrite").parquet(path),
                lambda: self.counts.add(self._lessons(contexts, progress), batch_id),
                lambda: self.cases.keep(contexts, batch_id),
            ]
            if self._learned():
                stands = self.spark.createDataFrame([(n, p.stage, p.born, p.counts) for n, p in progress.items()], self.progress.schema)
                jobs.append(lambda: self.progress.add(stands, batch_id))
            if not self.config.include_stop:
                jobs.append(lambda: self.alphabet.add(contexts.select("activity", F.lit(1).cast("bigint").alias("n")), batch_id))
            at_once(self.spark, *jobs)
            self.tallies.add(self._tallied(self.spark.read.schema(done.schema).parquet(path)), batch_id)
            if self.stats:
                self.stats.write(self.evaluation(batch_id + 1), batch_id)
            if batch_id and batch_id % self.compact_every == 0:
                at_once(self.spark, *[lambda s=store: s.compact(batch_id) for store in (self.cases, *self.stores)])
        finally:
            for df in held:
                df.unpersist()

    def _answered(self, contexts: DataFrame, batch_id: int, held: list[DataFrame]) -> DataFrame:
        """Events with d_<model>, p_<model> and, with delays, m_<model>; each is worked out once per state of the batch."""
        entries = F.array(*[F.struct(F.lit(n).alias("model"), self._packed(n).alias("state")) for n in self.models])
        needed = contexts.select(F.explode(entries).alias("e")).select("e.*").distinct().persist()
        held.append(needed)
        known = self.counts.read(batch_id, self.counts.touched(needed)).join(needed, ["model", "state"], "left_semi")
        leaves = F.col("activity").isNotNull() & (F.col("n") > 0)
        states = known.groupBy("model", "state").agg(
            F.coalesce(F.sum(F.when(F.col("activity").isNull(), F.col("n"))), F.lit(0)).alias("visits"),
            F.collect_list(F.when(leaves, F.struct("activity", F.col("n").alias("freq")))).alias("freqs"),
            *([F.collect_list(F.when(F.size("recent") > 0, F.struct("activity", "recent"))).alias("delays")] if self.with_delays else []),
        )
        gate, sure = F.lit(None), F.lit(None)
        for model, member in self.models.items():
            here = F.col("model") == model
            gate = F.when(here, F.lit(self.miners[member].min_total_visits)).otherwise(gate)
            sure = F.when(here, F.lit(self.miners[member].min_max_prob)).otherwise(sure)
        visits, stop = F.col("visits"), self.config.stop_symbol
        states = states.filter(visits >= F.greatest(gate, F.lit(1))).withColumn("dist", distribution(F.col("freqs"), visits, stop))
        states = states.filter(max_prob(F.col("dist")) >= sure)
        if self.config.include_stop:
            states = states.withColumn("prediction", prediction(F.col("dist"), self.config))
        else:
            everything = self.alphabet.read(batch_id).agg(F.sort_array(F.collect_set("activity")).alias("a")).scalar()
            states = states.withColumn("_all", everything)
            states = states.withColumn("prediction", prediction(weights(F.col("freqs"), visits, stop), self.config, F.col("_all")))
        mean = F.map_from_entries(F.transform("delays", lambda d: F.struct(d["activity"], _mean(d["recent"])))) if self.with_delays else None
        answers = states.select("model", "state", "dist", "prediction", *([mean.alias("delays")] if self.with_delays else [])).persist()
        held.append(answers)
        rows = contexts
        for model in self.models:
            own = answers.filter(F.col("model") == model).select(
                F.col("state").alias("_s"), F.col("dist").alias(f"d_{model}"), F.col("prediction").alias(f"p_{model}"),
                *([F.col("delays").alias(f"m_{model}")] if self.with_delays else []),
            )
            rows = rows.withColumn("_s", self._packed(model)).join(own, "_s", "left").drop("_s")
        return rows

    def _progress(self, batch_id: int) -> dict[str, Progress]:
        """Where the combinations stand before a batch: one row each."""
        found = {r["strategy"]: r for r in self.progress.read(batch_id).collect()} if self._learned() else {}
        out = {}
        for name in self._learned():
            r, members = found.get(name), len(self.strategies[name].members)
            born = [-1 if i < 2 else None for i in range(members)]
            out[name] = Progress(r["stage"], list(r["born"]), dict(r["counts"])) if r else Progress(0, born, {})
        return out

    def _along(self, rows: DataFrame, progress: dict[str, Progress], held: list[DataFrame]) -> DataFrame:
        """Adds p_<name> of the combinations that go by earlier answers, and brings ``progress`` up to the end of the batch."""
        sums = {"_index": F.lit(1).cast("bigint")}
        for name in self._learned():
            ladder = self._ladder(name)
            sums |= {f"_c_{m}": right(m) for m in ladder}
            if self.strategies[name].kind == "promotion":
                sums |= {f"_b_{a}_{b}": beats(a, b) for a, b in zip(ladder, ladder[1:], strict=False)}
        hits = rows.select("seq", "chunk", *[c.alias(n) for n, c in sums.items()])
        counted = running_total(hits, ["seq"], {f"{n}_upto": F.col(f"`{n}`") for n in sums}).drop("chunk").persist()
        held.append(counted)
        total = counted.orderBy(F.desc("seq")).limit(1).first()
        if total is None:
            return rows.withColumns({f"p_{n}": F.lit(None).cast(rows.schema[f"p_{self._ladder(n)[0]}"].dataType) for n in progress})
        total = {n: total[f"{n}_upto"] for n in sums}
        upto = lambda n: F.col(f"`{n}_upto`")
        choice = {}
        for name, at in progress.items():
            strategy, ladder = self.strategies[name], self._ladder(name)
            if strategy.kind == "promotion":
                choice[name] = self._promote(counted, ladder, at, total, upto, **strategy.options)
            else:
                choice[name] = [at.counts.get(m, 0) + upto(f"_c_{m}") - F.col(f"`_c_{m}`") for m in ladder]
                at.counts = {m: at.counts.get(m, 0) + total[f"_c_{m}"] for m in ladder}
        picked = {}
        for name, by in choice.items():
            strategy = self.strategies[name]
            if strategy.kind == "promotion":
                picked[f"active_{name}"] = by
            else:
                picked |= {f"_k{i}_{name}": c for i, c in enumerate(by)}
        rows = rows.join(counted.select("seq", *[c.alias(n) for n, c in picked.items()]), "seq")
        for name, by in choice.items():
            strategy, ladder = self.strategies[name], self._ladder(name)
            own = [F.col(f"p_{m}") for m in ladder]
            if strategy.kind == "promotion":
                rows = rows.withColumn(f"p_{name}", pick(own, F.col(f"active_{name}")))
                continue
            scores = [F.col(f"_k{i}_{name}").cast("double") for i in range(len(ladder))]
            if strategy.options.get("select_best", "acc") == "prob x acc":
                scores = [s * top_prob(F.col(f"d_{m}")) for s, m in zip(scores, ladder, strict=True)]
            rows = rows.withColumn(f"p_{name}", pick(own, best_index(scores))).drop(*[f"_k{i}_{name}" for i in range(len(ladder))])
        return rows

    def _promote(self, counted: DataFrame, ladder: list[str], at: Progress, total: dict, upto, threshold: float = 0.003, min_votes: int = 20) -> Column:
        """The active member of each event; ``at`` is moved to the end of the batch. Each promotion brings one row to the driver."""
        stage, start, since = F.lit(at.stage), {n: -v for n, v in at.counts.items()}, None
        while at.stage + 1 < len(ladder):
            now, nxt = ladder[at.stage], ladder[at.stage + 1]
            names = {"n": "_index", "now": f"_c_{now}", "nxt": f"_c_{nxt}", "votes": f"_b_{now}_{nxt}"}
            more = {k: upto(n) - start.get(k, 0) for k, n in names.items()}
            lead = more["nxt"].cast("double") / more["n"] - more["now"].cast("double") / more["n"]
            found = counted.filter((more["votes"] >= min_votes) & (F.round(lead, 12) > threshold))
            found = found if since is None else found.filter(F.col("seq") > since)
            hit = found.orderBy("seq").limit(1).first()
            if hit is None:
                at.counts = {k: total[n] - start.get(k, 0) for k, n in names.items()}
                break
            at.stage, since = at.stage + 1, hit["seq"]
            stage = stage + (F.col("seq") > since).cast("int")
            if at.stage + 1 < len(ladder):
                at.born[at.stage + 1] = since
                later = {"n": "_index", "now": f"_c_{nxt}", "nxt": f"_c_{ladder[at.stage + 1]}", "votes": f"_b_{nxt}_{ladder[at.stage + 1]}"}
                start = {k: hit[f"{n}_upto"] for k, n in later.items()}
        else:
            at.counts = {}
        return stage

    def _lessons(self, contexts: DataFrame, progress: dict[str, Progress]) -> DataFrame:
        """What a batch adds to the models: departures from and arrivals in states, and delays."""
        none, one = F.lit(None), F.lit(1).cast("bigint")
        learning = {}
        for model in self.models:
            born = -1
            if model in self.late:
                name, place = self.late[model]
                born = progress[name].born[place]
                if born is None:
                    continue
            since = F.lit(True) if model not in self.late else F.col("seq") > born
            first = F.col("prev_seq").isNull() if model not in self.late else F.col("prev_seq").isNull() | (F.col("prev_seq") <= born)
            learning[model] = (since, first)
        recent = [F.lit(None).cast(RECENT).alias("recent")] if self.with_delays else []
        steps = []
        for model, (since, first) in learning.items():
            here, there = self._packed(model), self._packed(model, after=True)
            for taken, state, activity, to in (
                (since, here, F.col("activity"), there), (since, there, none.cast("string"), none.cast(STATE)), (since & first, here, none.cast("string"), none.cast(STATE)),
            ):
                entry = F.struct(F.lit(model).alias("model"), state.alias("state"), activity.alias("activity"), one.alias("n"), to.alias("next_state"))
                steps.append(F.when(taken, entry))
        out = contexts.select(F.explode(F.array_compact(F.array(*steps))).alias("e")).select("e.*", *recent)
        if not self.with_delays:
            return out
        # the latest delays of a state and activity, cut before they are brought together
        entries = [F.when(since, F.struct(F.lit(m).alias("model"), self._packed(m).alias("state"))) for m, (since, _) in learning.items()]
        timed = contexts.filter("ts IS NOT NULL AND prev_ts IS NOT NULL").select(
            F.explode(F.array_compact(F.array(*entries))).alias("e"), "activity", "seq", seconds_between(F.col("ts"), F.col("prev_ts")).alias("delay")
        )
        timed = timed.select("e.*", "activity", "seq", "delay")
        latest = Window.partitionBy("model", "state", "activity").orderBy(F.desc("seq"))
        timed = timed.withColumn("r", F.row_number().over(latest)).filter(F.col("r") <= self.config.maxlen_delays)
        zero = F.lit(0).cast("bigint").alias("n")
        return out.unionByName(timed.select("model", "state", "activity", zero, none.cast(STATE).alias("next_state"), F.array(F.struct("seq", "delay")).cast(RECENT).alias("recent")))

    def _tallied(self, done: DataFrame) -> DataFrame:
        """What one batch adds to the running evaluation by model, and to the counts of votes."""
        zero = F.lit(0).cast("bigint")
        kinds = {"model": "string", "votes": "array<struct<model:string,predicted:string>>", "actual": "string"}
        votes = vote_array({n: F.col(f"p_{n}.activity") for n in self.miners})
        values = {"votes": votes, "actual": F.col("activity"), "n": F.lit(1).cast("bigint")}
        entries = [values]
        for name in (*self.miners, *self.strategies):
            p = F.col(f"p_{name}")
            hit = F.coalesce(p["activity"] == F.col("activity"), F.lit(False))
            listed = F.coalesce(F.array_contains(p["top_k"], F.col("activity")), F.lit(False))
            scores = dict(zip(SCORES, (F.lit(True), hit, p.isNull(), listed), strict=True))
            entries.append({"model": F.lit(name)} | {n: v.cast("bigint") for n, v in scores.items()})
        rows = [
            F.struct(*[e.get(n, F.lit(None)).cast(t).alias(n) for n, t in kinds.items()], *[e.get(n, zero).alias(n) for n in (*SCORES, "n")]) for e in entries
        ]
        return done.select(F.explode(F.array(*rows)).alias("_e")).select("_e.*")

    def start(self, stream: DataFrame, checkpoint: str, *, trigger: dict | None = None):
        """Run over a stream of events."""
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    # ------------------------------------------------------------------------------------------------------------------
    # results so far
    # ------------------------------------------------------------------------------------------------------------------

    def predictions(self) -> DataFrame:
        """Every event so far with p_<name> of members and combinations, active_<name> of promotions and, with delays, m_<member>."""
        return self.spark.read.parquet(f"{self.path}/predictions")

    def evaluation(self, before: int | None = None) -> DataFrame:
        """Running evaluation of every member and combination up to the last batch, or the last one before ``before``, in percent."""
        total = F.col("total_predictions")
        rates = {"accuracy": F.col("correct_predictions") * 100.0 / total, "top_k_accuracy": F.col("top_k_correct_preds") * 100.0 / total}
        return self.tallies.read(before).filter("model IS NOT NULL").select("model", *SCORES).withColumns(rates)

    def transition_counts(self, name: str) -> DataFrame:
        """(state, activity, next_state, freq) of a member so far."""
        unpack = self.miners[self.models[name]].structure.unpack
        rows = self.counts.read().filter((F.col("model") == name) & F.col("activity").isNotNull() & (F.col("n") > 0))
        return rows.select(unpack(F.col("state")).alias("state"), "activity", unpack(F.col("next_state")).alias("next_state"), F.col("n").alias("freq"))

    def transition_delays(self, name: str) -> DataFrame:
        """(state, activity, delay_s, delays): mean of the last delays, and how many there are."""
        unpack = self.miners[self.models[name]].structure.unpack
        rows = self.counts.read().filter((F.col("model") == name) & (F.size("recent") > 0))
        return rows.select(unpack(F.col("state")).alias("state"), "activity", _mean(F.col("recent")).alias("delay_s"), F.size("recent").alias("delays"))

    def delay_predictions(self, name: str) -> DataFrame:
        """Events whose delay could be predicted by a member: delay_s, and the actual_delay since the event before in its case."""
        actual = seconds_between(F.col("ts"), F.col("prev_ts"))
        rows = self.predictions().select("case_id", "pos", "seq", "activity", F.try_element_at(f"m_{name}", F.col("activity")).alias("delay_s"), actual.alias("actual_delay"))
        return rows.filter("delay_s IS NOT NULL AND actual_delay IS NOT NULL")

    def comparison(self) -> DataFrame:
        """All pairs of members so far, in percent."""
        return ratios(pair_counts(self.tallies.read().filter("model IS NULL").select("votes", "actual", "n")), 100.0)


def _mean(recent: Column) -> Column:
    return F.aggregate(recent, F.lit(0.0), lambda acc, x: acc + x["delay"]) / F.size(recent)


class StreamingDrift:
    """Artificial drift on a live stream; the running top activities continue from the stored counts."""

    def __init__(self, spark: SparkSession, path: str, kind: str, *, rate: float = 1.0, start: int = 5000, transition: int = 1, seed: int | str = 0, compact_every: int = 20, buckets: int = 4) -> None:
        check_alteration(kind, start, transition)
        self.spark, self.path, self.kind, self.compact_every = spark, path, kind, compact_every
        self.options = {"rate": rate, "start": start, "transition": transition, "seed": seed}
        values = {"n": ("bigint", "sum"), "first": ("bigint", "min"), "events": ("bigint", "sum")}
        self.counts = BucketStore(spark, f"{path}/counts", "activity string", values, buckets=buckets)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        self.counts.clean(batch_id)
        before = self.counts.read(batch_id)
        steps = before.agg(F.sum("events")).first()[0] or 0
        batch = batch.persist()
        try:
            out = alter_log(batch, self.kind, before=before, steps_before=steps, **self.options)
            out.write.mode("overwrite").parquet(f"{self.path}/log/batch_id={batch_id}")
            counting = F.col("step") >= self.options["start"]
            self.counts.add(
                numbered(batch, steps).select(
                    "activity", counting.cast("bigint").alias("n"), F.when(counting, F.col("step")).alias("first"),
                    F.lit(1).cast("bigint").alias("events"),
                ),
                batch_id,
            )
            if batch_id and batch_id % self.compact_every == 0:
                self.counts.compact(batch_id)
        finally:
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, *, trigger: dict | None = None):
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def log(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/log")
