"""What is known of every case between micro-batches, without Python workers.

A batch is annotated as a log of its own by the windows of :mod:`casewise.operators`, and what earlier batches left of a case is joined to its
events: its length, last activities, latest time and order, and as far as a structure needs them its activities, their counts and the
fingerprints of its path. Whatever a structure remembers can be put together from these two parts, so a batch costs one join by case, and a long
case is cut along its chunks as in a finite log. The state of the cases of a batch is stored under its number, so a retry finds what the first try found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.config import START
from casewise.functions.ordering import HOT_ROWS, running, setting
from casewise.operators.positions import case_lookback, case_running, positioned, previous_ts, split_of
from casewise.operators.structures import Bag, NGram, Parikh, PrefixTree, Structure
from casewise.streaming.store import BucketStore

STRINGS = "array<string>"
COUNTS = "map<string,bigint>"


class CaseStates:
    """States of cases for ``structures`` under ``path``; cases without an event for ``ttl_ms`` are forgotten."""

    def __init__(
        self, spark: SparkSession, path: str, structures: dict[str, Structure], *, buckets: int = 8, ttl_ms: int | None = None, seq_type: str = "bigint"
    ) -> None:
        for s in structures.values():
            if not isinstance(s, NGram | Bag | Parikh | PrefixTree):
                raise ValueError(f"{type(s).__name__} can't be continued from one batch to the next")
        self.spark, self.structures, self.ttl_ms = spark, structures, ttl_ms
        self.window = max([0, *(s.window for s in structures.values() if isinstance(s, NGram))])
        self.bags = any(isinstance(s, Bag) for s in structures.values())
        self.counted = any(isinstance(s, Parikh) for s in structures.values())
        #: structures that are fingerprints, with the names of their two columns
        self.prints = {s: f"_x{i}" for i, s in enumerate(dict.fromkeys(s for s in structures.values() if isinstance(s, Parikh | PrefixTree)))}
        values = {"n": "bigint", "tail": STRINGS, "ts": "timestamp", "seq": seq_type, "at": "timestamp"}
        values |= {"bag": STRINGS} if self.bags else {}
        values |= {"times": COUNTS} if self.counted else {}
        values |= {f"{x}{side}": "bigint" for x in self.prints.values() for side in "ab"}
        self.store = BucketStore(spark, path, "case_id string", {n: (kind, "last") for n, kind in values.items()}, buckets=buckets)

    def _alive(self, at: str = "at") -> Column | None:
        if self.ttl_ms is None:
            return None
        return F.unix_millis(F.current_timestamp()) - F.unix_millis(at) <= self.ttl_ms

    def contexts(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The events of a batch with ``pos``, ``prev_ts`` and ``prev_seq`` in their case and ``<name>``, ``<name>_next`` of each structure.

        More columns, all named with an underscore, are what :meth:`keep` needs.
        """
        # one small job tells the buckets to open and whether any case is long enough to be cut
        sizes = batch.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
        found = sizes.agg(F.max("n").alias("most"), F.collect_set(self.store.bucket()).alias("buckets")).first()
        cut = (found["most"] or 0) > setting(batch, "hotRows", HOT_ROWS)
        earlier = self.store.read(batch_id, sorted(found["buckets"]))
        alive = self._alive()
        earlier = earlier if alive is None else earlier.filter(alive)
        earlier = earlier.select("case_id", *[F.col(c).alias(f"_c_{c}") for c in self.store.folds])
        rows = previous_ts(positioned(batch.select("case_id", "activity", "ts", "seq", "chunk"), cut=cut))
        folds = {"_prev": ("max", F.col("seq"))} | ({"_own": ("set", F.col("activity"))} if self.bags else {})
        rows = case_running(case_lookback(rows, "activity", self.window, "_recent", inclusive=True), folds)
        if self.counted:
            rows = running(rows, ["case_id", "activity"], ["pos"], {"_nth": ("sum", F.lit(1).cast("bigint"))}, split=split_of(rows))
        none = F.array().cast(STRINGS)
        rows = rows.join(earlier, "case_id", "left").withColumns(
            {
                "_last": F.col("pos") == F.col("case_len") - 1,
                "pos": F.col("pos") + F.coalesce("_c_n", F.lit(0)),
                "prev_ts": F.coalesce("prev_ts", "_c_ts"),
                "prev_seq": F.coalesce("_prev", "_c_seq"),
                "_history": F.concat(F.coalesce("_c_tail", none), F.col("_recent")),
            }
        )
        kept = F.least(F.lit(self.window), F.size("_history"))
        rows = rows.withColumn("_tail", F.slice("_history", F.size("_history") - kept + 1, kept))
        if self.bags:
            rows = rows.withColumn("_own", F.array_union(F.coalesce("_c_bag", none), "_own"))
            rows = rows.withColumn("_bag", F.sort_array(F.array_union(F.col("_own"), F.array("activity"))))
        if self.counted:
            rows = rows.withColumn("_nth", F.col("_nth") + F.coalesce(F.try_element_at("_c_times", F.col("activity")), F.lit(0)))
        for structure, x in self.prints.items():
            rows = self._fingerprints(rows, structure, x)
        done: dict[Structure, str] = {}
        for name, structure in self.structures.items():
            if structure in done:
                rows = rows.withColumns({name: F.col(done[structure]), f"{name}_next": F.col(f"{done[structure]}_next")})
                continue
            if isinstance(structure, NGram):
                rows = structure.columns(rows, name, f"{name}_next")
            elif isinstance(structure, Bag):
                rows = rows.withColumns({name: F.sort_array("_own"), f"{name}_next": F.col("_bag")})
            else:
                x = self.prints[structure]
                level = {"level": "pos"} if isinstance(structure, PrefixTree) else {}
                before = F.struct(*[F.col(c).alias(n) for n, c in level.items()], F.col(f"{x}a_before").alias("a"), F.col(f"{x}b_before").alias("b"))
                after = F.struct(*[(F.col(c) + 1).alias(n) for n, c in level.items()], F.col(f"{x}a").alias("a"), F.col(f"{x}b").alias("b"))
                rows = rows.withColumns({name: before, f"{name}_next": after})
            done[structure] = name
        carried = ["_last", "_tail", *(["_bag"] if self.bags else []), *(["_c_times"] if self.counted else [])]
        carried += [f"{x}{side}" for x in self.prints.values() for side in "ab"]
        return rows.select(
            "case_id", "activity", "ts", "seq", "chunk", "pos", "prev_ts", "prev_seq", *carried, *[c for n in self.structures for c in (n, f"{n}_next")]
        )

    def _fingerprints(self, rows: DataFrame, structure: Structure, x: str) -> DataFrame:
        """Columns <x>a, <x>b (after the event) and <x>a_before, <x>b_before, with the hashes that the structure itself uses."""
        zero = F.lit(0).cast("bigint")
        if isinstance(structure, PrefixTree):
            one, two = F.xxhash64(F.lit(1), F.col("pos"), F.col("activity")), F.xxhash64(F.lit(2), F.col("activity"), F.col("pos"))
        else:
            counts = F.lit(True) if structure.upper_bound is None else F.col("_nth") < structure.upper_bound
            one = F.when(counts, F.xxhash64(F.lit(3), F.col("activity"), F.col("_nth"))).otherwise(zero)
            two = F.when(counts, F.xxhash64(F.lit(4), F.col("_nth"), F.col("activity"))).otherwise(zero)
        rows = rows.withColumns({f"{x}a_own": one, f"{x}b_own": two})
        rows = case_running(rows, {f"{x}{side}_local": ("xor", F.col(f"{x}{side}_own")) for side in "ab"})
        for side in "ab":
            before = F.col(f"{x}{side}_local").bitwiseXOR(F.coalesce(F.col(f"_c_{x}{side}"), zero))
            rows = rows.withColumns({f"{x}{side}_before": before, f"{x}{side}": before.bitwiseXOR(F.col(f"{x}{side}_own"))})
        return rows

    def keep(self, contexts: DataFrame, batch_id: int) -> None:
        """Stores how the cases of a batch stand after it."""
        prints = [F.col(f"{x}{side}") for x in self.prints.values() for side in "ab"]
        last = contexts.filter("_last").select(
            "case_id", (F.col("pos") + 1).alias("n"), F.col("_tail").alias("tail"), F.coalesce("ts", "prev_ts").alias("ts"), "seq",
            F.current_timestamp().alias("at"), *([F.col("_bag").alias("bag")] if self.bags else []), *(["_c_times"] if self.counted else []), *prints,
        )
        if self.counted:
            here = contexts.groupBy("case_id", "activity").agg(F.count(F.lit(1)).alias("k"))
            here = here.groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("activity", "k"))).alias("_here"))
            both = F.map_zip_with(
                F.coalesce("_c_times", F.create_map().cast(COUNTS)), "_here", lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            )
            last = last.join(here, "case_id").withColumn("times", both)
        self.store.add(last.select("case_id", *self.store.folds), batch_id)

    def compact(self, batch_id: int) -> None:
        self.store.compact(batch_id, self._alive())

    def clean(self, batch_id: int) -> None:
        self.store.clean(batch_id)


class StreamingContexts:
    """Contexts of a live stream, batch by batch: the last ``window`` activities before and after every event."""

    def __init__(
        self, spark: SparkSession, path: str, window: int, *, structures: dict[str, Structure] | None = None, buckets: int = 8, ttl_ms: int | None = None,
        compact_every: int = 20, seq_type: str = "bigint",
    ) -> None:
        self.spark, self.path, self.compact_every = spark, path, compact_every
        self.cases = CaseStates(spark, f"{path}/cases", {"state": NGram(window)} | (structures or {}), buckets=buckets, ttl_ms=ttl_ms, seq_type=seq_type)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        self.cases.clean(batch_id)
        batch = batch.persist()
        rows = self.cases.contexts(batch, batch_id).persist()
        try:
            rows.drop(*[c for c in rows.columns if c.startswith("_")]).write.mode("overwrite").parquet(f"{self.path}/contexts/batch_id={batch_id}")
            self.cases.keep(rows, batch_id)
            if batch_id and batch_id % self.compact_every == 0:
                self.cases.compact(batch_id)
        finally:
            rows.unpersist()
            batch.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, *, trigger: dict | None = None):
        writer = stream.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def contexts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/contexts")


def with_start(contexts: DataFrame, symbol: str = START) -> DataFrame:
    """START before the first event of every case; (seq, part) is the new order."""
    event = F.struct(F.lit(0).alias("part"), F.col("activity").alias("activity"), F.col("ts").alias("ts"))
    start = F.struct(F.lit(-1).alias("part"), F.lit(symbol).alias("activity"), F.lit(None).cast("timestamp").alias("ts"))
    out = F.when(F.col("pos") == 0, F.array(start, event)).otherwise(F.array(event))
    return contexts.select("case_id", "seq", F.explode(out).alias("_r")).select("case_id", "seq", "_r.*")
