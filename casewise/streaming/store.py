"""Keyed tables that grow batch by batch and are read by key.

A table is cut into buckets by a hash of some of its keys. Every batch adds one version with what it changes, in folders of the buckets it
touches. Now and then the versions since the last base are folded into a new base, again only in the buckets they touch. A reader that knows its
keys names their buckets, and nothing else is opened.

A batch reads versions before its own only, and trying it again overwrites its own version, so nothing is added twice. What a newer base
has made needless goes when the next batch begins, because only then can no retry ask for it; so the number of files is bounded by buckets and
``compact_every``. A version counts once its job has committed.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewise.functions.scratch import deleted, matching

#: how values of one key are put together
FOLDS = ("sum", "min", "max", "any", "last", "recent")
ALL = 1 << 62


def at_once(spark: SparkSession, *jobs: Callable[[], None]) -> None:
    """Runs writes that don't depend on each other side by side; small jobs leave most of a cluster idle. The first failure is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]:
            done.result()


class BucketStore:
    """Values by key under ``path``.

    ``values`` gives type and fold of each value: ``any`` is the same in all versions, ``last`` that of the latest one, and ``recent``
    the ``recent`` greatest entries of arrays. ``by`` are the keys that the bucket depends on.
    """

    def __init__(
        self, spark: SparkSession, path: str, keys: str, values: dict[str, tuple[str, str]], *, by: list[str] | None = None, buckets: int = 8, recent: int = 50
    ) -> None:
        if buckets < 1 or any(fold not in FOLDS for _, fold in values.values()):
            raise ValueError(f"need a bucket and folds out of {FOLDS}")
        self.spark, self.path, self.buckets, self.recent = spark, path, buckets, recent
        self.folds = {n: fold for n, (_, fold) in values.items()}
        self.schema = f"{keys}, " + ", ".join(f"{n} {kind}" for n, (kind, _) in values.items())
        self.keys = [c for c in spark.createDataFrame([], self.schema).columns if c not in values]
        self.by = by or self.keys

    def bucket(self, *columns: Column) -> Column:
        """The bucket of rows with these values of the ``by`` columns (by default, of columns of those names)."""
        return F.pmod(F.xxhash64(*(columns or map(F.col, self.by))), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of rows with the ``by`` columns; at most ``buckets`` numbers reach the driver."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    # ------------------------------------------------------------------------------------------------------------------

    def _versions(self, kind: str, before: int) -> list[int]:
        """Committed versions of base or delta, ascending."""
        found = matching(self.spark, f"{self.path}/kind={kind}/version=*/_SUCCESS")
        return sorted(v for v in (int(p.split("version=")[1].split("/")[0]) for p in found) if v < before)

    def _bases(self, before: int) -> dict[int, list[int]]:
        """Committed base versions of each bucket, ascending."""
        committed, out = set(self._versions("base", before)), {}
        for p in matching(self.spark, f"{self.path}/kind=base/version=*/bucket=*"):
            version, bucket = (int(part.split("=")[1]) for part in p.rstrip("/").split("/")[-2:])
            if version in committed:
                out.setdefault(bucket, []).append(version)
        return {b: sorted(v) for b, v in out.items()}

    def _fold(self, rows: DataFrame, *more: str) -> DataFrame:
        """One row per key; ``more`` columns are kept as further keys."""

        def fold(name: str, how: str) -> Column:
            c = F.col(name)
            if how == "recent":
                return F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, self.recent)
            if how == "any":
                return F.any_value(c, ignoreNulls=F.lit(True))
            if how == "last":
                return F.max_by(c, "version") if "version" in rows.columns else F.any_value(c)
            return {"sum": F.sum, "min": F.min, "max": F.max}[how](c)

        return rows.groupBy(*self.keys, *more).agg(*[fold(n, how).alias(n) for n, how in self.folds.items()])

    def _raw(self, before: int | None, buckets: list[int] | None) -> DataFrame:
        limit = ALL if before is None else before
        bases = self._bases(limit)
        upto = max((v[-1] for v in bases.values()), default=-1)
        paths = [f"{self.path}/kind=base/version={v[-1]}/bucket={b}" for b, v in sorted(bases.items()) if buckets is None or b in buckets]
        paths += [f"{self.path}/kind=delta/version={v}" for v in self._versions("delta", limit) if v > upto]
        schema = f"{self.schema}, kind string, version bigint, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*paths)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Keys and folded values of all versions, or of those before ``before``; only ``buckets`` are opened if given."""
        return self._fold(self._raw(before, buckets))

    def add(self, rows: DataFrame, version: int) -> None:
        """What one batch changes. ``last`` values come once per key."""
        folded = self._fold(rows).withColumn("bucket", self.bucket())
        if self.buckets > 1:
            folded = folded.repartition("bucket")
        folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/kind=delta/version={version}")

    def compact(self, version: int, alive: Column | None = None) -> None:
        """Folds everything up to a version into a new base, in the buckets changed since the last one.

        Rows that aren't ``alive`` go. Readers filter by the same condition, since a bucket without a living row keeps its old base.
        """
        upto = max(self._versions("base", version), default=-1)
        changed = set()
        for v in self._versions("delta", version + 1):
            if v > upto:
                changed |= {int(p.rstrip("/").rsplit("=", 1)[1]) for p in matching(self.spark, f"{self.path}/kind=delta/version={v}/bucket=*")}
        if not changed:
            return
        rows = self._fold(self._raw_for_base(version, sorted(changed)), "bucket")
        rows = rows if alive is None else rows.filter(alive)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/kind=base/version={version}")

    def _raw_for_base(self, version: int, buckets: list[int]) -> DataFrame:
        """As :meth:`_raw` up to ``version``, but never from the base of that version, which a retry replaces."""
        earlier = self._raw(version, buckets)
        own = f"{self.path}/kind=delta/version={version}"
        if version not in self._versions("delta", version + 1):
            return earlier
        rows = self.spark.read.schema(f"{self.schema}, kind string, version bigint, bucket int").option("basePath", self.path).parquet(own)
        return earlier.unionByName(rows.filter(F.col("bucket").isin(buckets)))

    def clean(self, version: int) -> None:
        """Deletes what no batch from ``version`` on can ask for. Call it when that batch begins: the one before is committed then."""
        bases = self._bases(version)
        upto = max((v[-1] for v in bases.values()), default=-1)
        gone = [f"{self.path}/kind=delta/version={v}" for v in self._versions("delta", version) if v <= upto]
        kept = {v[-1] for v in bases.values()}
        old = {v for versions in bases.values() for v in versions} - kept
        gone += [f"{self.path}/kind=base/version={v}" for v in sorted(old)]
        gone += [f"{self.path}/kind=base/version={v}/bucket={b}" for b, versions in bases.items() for v in versions[:-1] if v in kept]
        for path in gone:
            deleted(self.spark, path)
