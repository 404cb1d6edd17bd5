"""Near-duplicate embeddings by spherical-cap filters with random product codes.

A filter is a direction; a vector passes it if their product exceeds a height. Directions form a product code: each half of the
space has a few random unit words and a filter is a pair of words, so few products per vector decode the list of all filters it
passes. Vectors that pass a filter together meet, are compared in double precision, and link when the cosine reaches
the bound. Height and number of words follow from the number of vectors: a filter's bucket keeps its expected size, and a pair at the
bound shares ``meetings`` filters on average, so missing one is very unlikely (measured in the tests).

Equal vectors form one class beforehand, with their number as weight. Buckets above ``bucket_rows`` are cut into chunks
that meet in pairs of chunks. A pair counts in the least filter it shares only, so links are counted once; of the links in a bucket only
a spanning set is handed on. Vectors that are null, empty, zero or hold a null or non-finite component link with nothing. Only vectors of equal
length are compared. Rows with equal ids are rows of their own; ids that are null take part, with a null component if no
other id is reached. An empty table gives no rows. Columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.llm.common import components, schema_with, seed_of, settled, stored

BUCKET_ROWS = 2048


def code_size(count: int, bound: float, bucket: int, meetings: float, codes: int) -> tuple[float, int]:
    """Height in standard deviations, and words per half of each code, for ``count`` vectors."""
    normal = NormalDist()
    height = normal.inv_cdf(1 - min(0.05, bucket / max(count, 1)))
    x = np.linspace(height, height + 8, 4001)
    rest = np.array([1 - normal.cdf((height - bound * v) / np.sqrt(1 - bound**2)) for v in x])
    both = np.trapezoid(np.exp(-(x**2) / 2) / np.sqrt(2 * np.pi) * rest, x)  # that both of a pair at the bound pass
    return height, int(np.ceil(np.sqrt(meetings / codes / both)))


class Code:
    """The random words of one dimension: several product codes, each behind a rotation of its own."""

    def __init__(self, dimension: int, height: float, words: int, codes: int, seed: int) -> None:
        rng = np.random.default_rng(seed_of(seed, dimension))
        half = (dimension + 1) // 2
        # the normal curve overstates the reach of caps in few dimensions
        self.words, self.height, self.halves = words, min(height / np.sqrt(dimension), 0.5 if dimension < 16 else 0.75), []
        for _ in range(codes):
            rotation, _ = np.linalg.qr(rng.normal(size=(dimension, dimension)))
            sides = []
            for own in (rotation[:, :half], rotation[:, half:]):
                width = own.shape[1]
                w = rng.normal(size=(words, width))
                w *= np.sqrt(width / dimension) / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
                sides.append(own @ w.T)
            self.halves.append(sides)

    def decode(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Numbers of all filters that each unit vector passes, ascending."""
        found: list[list[np.ndarray]] = [[] for _ in vectors]
        for number, (one, two) in enumerate(self.halves):
            left, right = vectors @ one, vectors @ two
            order = np.argsort(-right, axis=1)
            for mine, a, b, o in zip(found, left, right, order, strict=True):
                falling = -b[o]  # ascending
                some = np.flatnonzero(a - falling[0] >= self.height)
                reach = np.searchsorted(falling, a[some] - self.height, side="right")
                base = number * self.words**2
                mine += [base + i * self.words + o[:r] for i, r in zip(some.tolist(), reach.tolist(), strict=True)]
        return [np.sort(np.concatenate(mine)) if mine else np.zeros(0, np.int64) for mine in found]


def unit(rows) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither run over nor under."""
    v = np.asarray(rows, np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_classes(vectors: DataFrame, column: str) -> DataFrame:
    """Usable vectors, equal ones together: k (a number), v, least (smallest id), weight (rows)."""
    # a null, NaN or infinite component makes the first condition false or null
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = vectors.select("vec_id", F.col(column).alias("v")).where(finite & F.exists("v", lambda x: x != 0))
    classes = named.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    return stored(classes.withColumn("k", F.monotonically_increasing_id()), "vector-classes")


def decoded(classes: DataFrame, height: float, words: int, codes: int, seed: int) -> DataFrame:
    """``classes`` (k, v, weight) with ``f``, the numbers of the filters that each vector passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Code] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                raw = batch.column("v").to_pylist()
                filters: list = [None] * len(raw)
                for d in {len(x) for x in raw}:
                    own = [i for i, x in enumerate(raw) if len(x) == d]
                    code = made[d] = made.get(d) or Code(d, height, words, codes, seed)
                    for i, f in zip(own, code.decode(unit([raw[i] for i in own])), strict=True):
                        filters[i] = f
                columns = [batch.column(n) for n in ("k", "v", "weight")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(filters, pa.list_(pa.int32()))], ["k", "v", "weight", "f"])

    rows = classes.select("k", "v", "weight")
    return rows.mapInArrow(run, schema_with(rows, "f", T.ArrayType(T.IntegerType())))


def earlier_meeting(filters: list[np.ndarray], others: list[np.ndarray], this: int) -> np.ndarray:
    """Which pairs share a filter below ``this``."""
    before = [f[f < this] for f in filters]
    behind = [f[f < this] for f in others]
    known, place = np.unique(np.concatenate([*before, *behind]) if before or behind else np.zeros(0, np.int32), return_inverse=True)
    sizes = [len(f) for f in (*before, *behind)]
    rows = np.repeat(np.arange(len(sizes)), sizes)
    hits = np.zeros((len(sizes), len(known)), np.float32)
    hits[rows, place] = 1
    # a filter that only one of the vectors passes can't be shared
    hits = hits[:, hits.sum(axis=0) > 1]
    return hits[: len(before)] @ hits[len(before) :].T > 0


def spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect names as the true cells of ``linked`` do."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        root.setdefault(a, a)
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for row, name in zip(linked, left.tolist(), strict=True):
        for other in right[row].tolist():
            p, q = find(name), find(other)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((name, other))
    return out


def meet(this: int, one: tuple, two: tuple | None, bound: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Links of one bucket, within a chunk or between two: how many each class gains here, and a spanning set of edges.

    A chunk is (names, unit vectors, filters, weights). Vectors of different length have no filter in common by construction.
    """
    k, v, f, w = one
    k2, v2, f2, w2 = two or one
    linked = v @ v2.T >= bound
    if two is None:
        linked &= np.triu(np.ones_like(linked), 1)
    some, other = linked.any(axis=1), linked.any(axis=0)
    if not some.any():
        return {}, []
    rows, columns = np.flatnonzero(some), np.flatnonzero(other)
    linked = linked[np.ix_(rows, columns)]
    edges = spanning(linked, k[rows], k2[columns])
    new = linked & ~earlier_meeting([f[i] for i in rows], [f2[i] for i in columns], this)
    gains: dict[int, int] = {}
    for names, more in ((k[rows], new @ w2[columns]), (k2[columns], new.T @ w[rows])):
        for name, n in zip(names.tolist(), more.tolist(), strict=True):
            gains[name] = gains.get(name, 0) + n
    return gains, edges


def met_links(passed: DataFrame, bound: float, bucket_rows: int) -> DataFrame:
    """Rows (a, b, n): b null and n links gained by class a, or an edge a-b."""
    rows = passed.select("k", "v", "weight", F.col("f").alias("filters"), F.explode("f").alias("f"), F.size("v").alias("d"))
    sizes = passed.select(F.explode("f").alias("f"), F.size("v").alias("d")).groupBy("f", "d").agg(F.count("*").alias("size"))
    sizes = stored(sizes.where("size > 1").withColumn("chunks", F.ceil(F.col("size") / bucket_rows)).drop("size"), "bucket-sizes")
    rows = rows.join(sizes, ["f", "d"]).withColumn("i", F.pmod(F.xxhash64("k"), F.col("chunks")))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("j")
    rows = rows.select("f", "d", "k", "v", "weight", "filters", "i", partner)
    rows = rows.select("f", "d", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("own"), "k", "v", "weight", "filters")

    def compare(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        this, _, lo, hi = key
        chunks = []
        for side in (lo, hi)[: 1 + (lo != hi)]:
            own = table[table["own"] == side].sort_values("k")
            if len(own):
                chunks.append((own["k"].to_numpy(), unit(np.stack(own["v"].to_numpy())), own["filters"].tolist(), own["weight"].to_numpy()))
        if not chunks or lo != hi and len(chunks) < 2:
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="Int64")
        gains, edges = meet(this, chunks[0], chunks[1] if lo != hi else None, bound)
        out = [(a, None, n) for a, n in gains.items() if n] + [(a, b, 0) for a, b in edges]
        return pd.DataFrame(out, columns=["a", "b", "n"], dtype="Int64")

    return rows.groupBy("f", "d", "lo", "hi").applyInPandas(compare, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, column: str = "embedding", bound: float = 0.9, bucket: int = 300, meetings: float = 14.0, codes: int = 6,
    bucket_rows: int = BUCKET_ROWS, seed: int = 5,
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row: links at a cosine of ``bound`` or more, and the least id they reach."""
    made = lambda: linked_classes(vectors, column, bound, bucket, meetings, codes, bucket_rows, seed)
    table = settled(vectors.sparkSession, "linked-classes", made)
    rows = vectors.select("vec_id", F.col(column).alias("_v"))
    rows = rows.join(table, rows["_v"] == table["v"], "left")
    return rows.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def linked_classes(vectors: DataFrame, column: str, bound: float, bucket: int, meetings: float, codes: int, bucket_rows: int, seed: int) -> DataFrame:
    """v, n_links and component_id of each distinct usable vector."""
    classes = vector_classes(vectors, column)
    height, words = code_size(classes.count(), bound, bucket, meetings, codes)
    passed = stored(decoded(classes, height, words, codes, seed), "passed-filters")
    found = stored(met_links(passed, bound, bucket_rows), "met-links")
    gained = found.where("b is null").groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("gained"))
    joined = components(found.where("b is not null").select("a", "b"), "vectors")
    known = classes.select("k", "v", "least", "weight").join(gained, "k", "left").join(joined.withColumnRenamed("id", "k"), "k", "left")
    known = known.withColumn("root", F.coalesce("component", "k"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    links = F.coalesce("gained", F.lit(0)) + F.col("weight") - 1
    return known.join(least, "root").select("v", links.alias("n_links"), "component_id")
