"""Nearest neighbours by largest inner product with vantage-point trees, one per shard.

**Index.** Distinct vectors are dealt to shards of a bounded size by hash, and every shard becomes one tree. Inner products turn into distances by one
more coordinate: with M the greatest norm of the shard, ``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)`` give ``|q' - x'|^2 = |q|^2 + M^2 - 2 q.x``. A node of
the tree has a vantage point and halves its vectors by their distance to it; both halves keep the range of these distances.

**Search.** All queries of a block walk a tree together. The triangle inequality bounds from below how near a query may be to anything in a leaf, from
its distances to the vantage points above. Leaves are visited from the least bound on, until ``relax`` times the bound exceeds the distance of the
``k``-th best vector so far. With ``relax`` 1 nothing can be missed and the search is exact; above 1 it stops earlier. All vectors are in
the index and every query meets every shard, block by block; scores are computed in double precision from the vectors as given.

Vectors that are null, empty, zero or hold a null or non-finite component take no part; vectors of different length never meet. Copies of a vector are one
entry of the index that keeps the ``k + 1`` smallest ids, as no more can be among ``k`` results. Ties go to the smaller id; rows without an id
come last and are no queries of a rule on ids. A query leaves out its own row only: another row with the same id is a candidate, and rows with equal
id and vector find each other. An empty table gives no rows. Only the id and vector columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import seed_of, setting, settled, stored

#: Bytes of double-precision vectors in a shard, and vectors in a leaf.
SHARD_BYTES, LEAF_ROWS = 4 << 20, 128
#: Queries of a block.
BLOCK_ROWS = 4096
#: How much the triangle inequality is relaxed by default; recall at this factor is measured in the tests.
RELAX = 4.0
LAST = np.iinfo(np.int64).max
TREE = "d int, shard long, names binary, least binary, points binary, ends binary, vantage binary, ranges binary, radius double"


@dataclass(frozen=True)
class Tree:
    """A complete binary tree over vectors: inner nodes as in a heap, leaves from left to right."""

    names: np.ndarray  # number of each vector, in leaf order
    least: np.ndarray  # its smallest id
    points: np.ndarray  # the vector
    ends: np.ndarray  # where each leaf ends
    vantage: np.ndarray  # vantage point of each inner node, with the further coordinate
    ranges: np.ndarray  # inner node x (left, right) x (least, greatest distance to the vantage point)
    radius: float

    def packed(self) -> tuple:
        return (*(a.tobytes() for a in (self.names, self.least, self.points, self.ends, self.vantage, self.ranges)), self.radius)

    @staticmethod
    def unpacked(d: int, names: bytes, least: bytes, points: bytes, ends: bytes, vantage: bytes, ranges: bytes, radius: float) -> Tree:
        whole = lambda raw: np.frombuffer(raw, np.int64)
        real = lambda raw, *shape: np.frombuffer(raw, np.float64).reshape(-1, *shape)
        return Tree(whole(names), whole(least), real(points, d), whole(ends), real(vantage, d + 1), real(ranges, 2, 2), radius)


def grow(names: np.ndarray, least: np.ndarray, points: np.ndarray, leaf_rows: int, seed: int) -> Tree:
    """The tree of a shard. Halves are equal in size, whatever the distances, so ties and clusters don't unbalance it."""
    rng = np.random.default_rng(seed)
    with np.errstate(all="ignore"):
        squares = (points * points).sum(axis=1)
        radius = float(np.sqrt(squares.max()))
        lifted = np.column_stack([points, np.sqrt(np.maximum(radius * radius - squares, 0.0))])
    depth = max(0, int(np.ceil(np.log2(len(points) / leaf_rows))))
    vantage, ranges = np.zeros((2**depth - 1, lifted.shape[1])), np.zeros((2**depth - 1, 2, 2))
    level = [np.arange(len(points))]
    for height in range(depth):
        below = []
        for place, own in enumerate(level):
            node = 2**height - 1 + place
            # of a few candidates the one whose distances spread most
            tries, probe = rng.choice(own, min(8, len(own)), replace=False), rng.choice(own, min(256, len(own)), replace=False)
            spread = [np.nan_to_num(np.linalg.norm(lifted[probe] - lifted[t], axis=1).std()) for t in tries]
            vantage[node] = lifted[tries[int(np.argmax(spread))]]
            away = np.linalg.norm(lifted[own] - vantage[node], axis=1)
            order = np.argsort(away, kind="stable")
            half = (len(own) + 1) // 2
            for side, part in enumerate((order[:half], order[half:])):
                if len(part):
                    ranges[node, side] = away[part].min(), away[part].max()
                below.append(own[part])
        level = below
    order = np.concatenate(level)
    return Tree(names[order], least[order], points[order], np.cumsum([len(x) for x in level]), vantage, ranges, radius)


def leaf_bounds(tree: Tree, queries: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Least possible distance of each query to what is in each leaf, by the triangle inequality."""
    bounds = np.zeros((len(queries), 1))
    count = len(tree.vantage)
    apart = squares[:, None] + (tree.vantage**2).sum(axis=1) - 2 * queries @ tree.vantage[:, :-1].T
    apart = np.sqrt(np.maximum(apart, 0.0))
    node = 0
    while node < count:
        here = apart[:, node : node + bounds.shape[1], None]
        low, high = tree.ranges[node : node + bounds.shape[1], :, 0], tree.ranges[node : node + bounds.shape[1], :, 1]
        node += bounds.shape[1]
        bounds = np.maximum(bounds[:, :, None], np.maximum(here - high, low - here)).reshape(len(queries), -1)
    return bounds


def search_tree(tree: Tree, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the places of its ``k`` best vectors in the tree (-1: none), their scores, and how many leaves it visited."""
    squares = (queries * queries).sum(axis=1)
    bounds = leaf_bounds(tree, queries, squares)
    order = np.argsort(bounds, axis=1, kind="stable")
    rows = np.arange(len(queries))
    slack = 1e-7 * (np.sqrt(squares) + tree.radius)  # rounding of bounds and distances
    score, place = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    ids = np.full((len(queries), k), LAST)
    visited, open_ = np.zeros(len(queries), np.int64), rows
    starts = np.concatenate([[0], tree.ends[:-1]])
    for turn in range(bounds.shape[1]):
        leaf = order[open_, turn]
        reach = np.sqrt(np.maximum(squares[open_] + tree.radius**2 - 2 * score[open_, -1], 0.0))
        stay = ~(relax * bounds[open_, leaf] > reach + slack[open_])
        open_, leaf = open_[stay], leaf[stay]
        if not len(open_):
            break
        visited[open_] += 1
        by_leaf = np.argsort(leaf, kind="stable")
        for group in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            own, at = open_[group], leaf[group[0]]
            span = np.arange(starts[at], tree.ends[at])
            found = queries[own] @ tree.points[span].T
            better = (found >= score[own, -1:]).any(axis=1)
            own, found = own[better], found[better]
            if not len(own):
                continue
            both = np.concatenate([score[own], found], axis=1)
            tied = np.concatenate([ids[own], np.broadcast_to(tree.least[span], found.shape)], axis=1)
            where = np.concatenate([place[own], np.broadcast_to(span, found.shape)], axis=1)
            first = np.lexsort((tied, -both), axis=-1)[:, :k]
            score[own], ids[own], place[own] = (np.take_along_axis(a, first, axis=1) for a in (both, tied, where))
    for at in range(0, len(queries), 256):  # the same sum whatever the block
        some = place[at : at + 256]
        exact = (queries[at : at + 256, None, :] * tree.points[some]).sum(axis=-1)
        score[at : at + 256] = np.where(some >= 0, exact, -np.inf)
    return place, score, visited


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """vec_id and v of the rows that take part."""
    # a null, NaN or infinite component makes the first condition false or null
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", F.col(column).alias("v")).where(finite & F.exists("v", lambda x: x != 0))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors as a table: c (a number), d (length), v, ids (the ``k + 1`` smallest, null last) and least."""
    # the row limit is applied before the rows of a vector are brought together, so copies are no burden
    first = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("vec_id")))
    few = rows.withColumn("nth", first).where(F.col("nth") <= k + 1)
    listed = few.groupBy("v").agg(F.array_sort(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id")))).alias("ids"))
    least = F.coalesce(F.col("ids")[0]["id"], F.lit(int(LAST)))
    made = listed.select(F.monotonically_increasing_id().alias("c"), F.size("v").alias("d"), F.col("v").cast("array<double>").alias("v"), F.col("v").alias("own"), F.col("ids")["id"].alias("ids"), least.alias("least"))
    return stored(made, "vector-classes")


@dataclass(frozen=True)
class Index:
    """Distinct vectors, the trees over them, and the number of shards by length of vector."""

    classes: DataFrame
    trees: DataFrame
    shards: DataFrame
    tasks: int
    k: int


def build_index(rows: DataFrame, k: int = 20, *, shard_bytes: int = SHARD_BYTES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Index:
    """Trees over all of rows (vec_id, v), for searches of up to ``k`` results."""
    named = classes(rows, k)
    shards = named.groupBy("d").agg(F.ceil(F.count("*") * F.col("d") * 8 / shard_bytes).alias("shards"))
    shards = stored(shards, "vector-shards")
    tasks = min(shards.agg(F.sum("shards")).first()[0] or 1, 10_000)

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("c")
        d, shard = int(table["d"].iloc[0]), int(table["shard"].iloc[0])
        tree = grow(table["c"].to_numpy(), table["least"].to_numpy(), np.stack(table["v"].to_numpy()), leaf_rows, seed_of(seed, d, shard))
        return pd.DataFrame([(d, shard, *tree.packed())], columns=[x.split()[0] for x in TREE.split(", ")])

    dealt = named.join(shards, "d").select("d", F.pmod(F.xxhash64("c"), F.col("shards")).alias("shard"), "c", "least", "v")
    trees = dealt.repartition(tasks, "d", "shard").groupBy("d", "shard").applyInPandas(run, TREE)
    return Index(named, stored(trees, "vector-trees"), shards, tasks, k)


def block_table(queries: DataFrame, index: Index, block_rows: int) -> DataFrame:
    """Queries (q, d, v) in blocks, each once for every shard of its length."""
    sizes = queries.groupBy("d").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    dealt = queries.join(sizes, "d").withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")))
    blocks = stored(dealt.groupBy("d", "block").agg(F.collect_list(F.struct("q", "v")).alias("queries")), "query-blocks")
    shard = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard")
    return blocks.join(index.shards, "d").select("d", shard, "queries")


def nearest_classes(queries: DataFrame, index: Index, relax: float, block_rows: int) -> DataFrame:
    """The ``k + 1`` best entries of the index for each query (q, d, v): q, c, least, score, leaves, as a table."""
    k = index.k + 1
    parts = [f.split()[0] for f in TREE.split(", ")]
    met = block_table(queries, index, block_rows).repartition(index.tasks, "d", "shard").join(index.trees.repartition(index.tasks, "d", "shard"), ["d", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = {p: batch.column(p)[i].as_py() for p in parts if p != "shard"}
                tree = Tree.unpacked(**raw)
                block = batch.column("queries").slice(i, 1).flatten()
                names = block.field("q").to_numpy(zero_copy_only=False)
                own = block.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, raw["d"])
                with np.errstate(all="ignore"):
                    place, score, leaves = search_tree(tree, own, k, relax)
                row, column = np.nonzero(place >= 0)
                at = place[row, column]
                made = (names[row], tree.names[at], tree.least[at], score[row, column], leaves[row])
                yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], ["q", "c", "least", "score", "leaves"])

    found = met.mapInArrow(run, "q long, c long, least long, score double, leaves long")
    with setting(queries.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "1"):  # a row is a whole tree and a block
        found = stored(found, "shard-results")
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("least")))
    return stored(found.withColumn("nth", best).where(F.col("nth") <= k).drop("nth"), "query-results")


def nearest(rows: DataFrame, queries: DataFrame, index: Index, relax: float, block_rows: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` best rows for each of ``queries``, which are rows (vec_id, v) of the index themselves."""
    k = index.k
    named = index.classes.select("c", "own")
    asked = stored(queries.join(named, queries["v"].eqNullSafe(named["own"])).select(F.col("vec_id").alias("query_id"), F.col("c").alias("q")), "query-rows")
    wanted = asked.select("q").distinct().join(index.classes, F.col("q") == F.col("c")).select("q", "d", "v")
    found = nearest_classes(wanted, index, relax, block_rows)
    # the ids of the entries found, cut to what the results of a query can hold before they meet its rows
    listed = found.join(index.classes.select("c", "ids"), "c").select("q", "c", "score", "ids", F.posexplode("ids").alias("at", "vec_id"))
    single = F.coalesce(F.array_position("ids", F.col("vec_id")) == F.col("at") + 1, F.lit(False))
    listed = listed.select("q", "score", "vec_id", ((F.col("q") == F.col("c")) & single).alias("maybe"))
    order = [F.desc("score"), F.asc_nulls_last("vec_id")]
    listed = listed.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("nth") <= k + 1)
    entry = F.struct("nth", "score", "vec_id", "maybe")
    lists = stored(listed.groupBy("q").agg(F.array_sort(F.collect_list(entry)).alias("best")), "query-lists")
    others = F.slice(F.filter("best", lambda e: ~(e["maybe"] & (e["vec_id"] == F.col("query_id")))), 1, k)
    out = asked.join(lists, "q").select("query_id", F.posexplode(others).alias("rank", "e"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def nearest_neighbours(
    vectors: DataFrame, asked: Column, column: str = "embedding", k: int = 20, *, relax: float = RELAX, shard_bytes: int = SHARD_BYTES,
    leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` (vec_id, ``column``) for each row for which ``asked`` holds."""
    if k < 1 or relax < 1:
        raise ValueError("k and relax are at least 1")

    def made() -> DataFrame:
        rows = usable(vectors, column)
        index = build_index(rows, k, shard_bytes=shard_bytes, leaf_rows=leaf_rows)
        return nearest(rows, rows.where(asked), index, relax, block_rows)

    return settled(vectors.sparkSession, "nearest", made)
