"""Merkle manifest of a table: one tree per group of rows and one over the groups, with a proof for every row.

A leaf hashes the fields of a row. Within a group leaves are ordered by id; every ``arity`` consecutive nodes (the last run may be shorter,
down to one) become their hash until one remains, the group's subroot. The subroots, in the order of their groups, become the root
the same way.

**Building.** A node number is the place in a range-partitioned order, so no task ranks a whole group. Trees are built in hops of ``hop``
levels: the ``arity ** hop`` nodes below one node come together as one row, which is hashed up to its top. All nodes at which a hop starts are
stored with a link to the node at which it ends and with the steps between: what is hashed before and after the own hash. Every hop divides the
number of nodes by ``arity ** hop``.

**Climbing.** A recursive query starts at the leaves and joins the stored nodes along their parent links until there is none. On the
way it appends the siblings of every step to the proof and folds the row's current hash, tampered or not, through the same steps. Nodes above very many
leaves are joined in several copies, among which the leaves below are dealt evenly, so no key of that join grows with the table.

Fields are written as ``-`` if null, else number of UTF-8 bytes, ``:``, value. Rows with a null id come first in their group, rows with a null
group form the first group; equal ids are ordered by leaf, and fully equal rows are interchangeable. A table of one row has its leaf as
root and an empty proof. An empty table gives no rows and has no root. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import setting, settled, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves below one copy of a stored node.
SPREAD = 1 << 18
#: Number of the tree over the groups.
TOP = -1
STEPS = "array<struct<before:binary,after:binary>>"
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    """The hash of the fields of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256))


def hexed(hash_: Column) -> Column:
    return F.lower(F.hex(hash_))


def one_in_seven(key: str = "doc_id") -> Column:
    """Whether 7 divides the crc32 of the id in decimal; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 0


def numbered(rows: DataFrame) -> DataFrame:
    """Adds to rows (g, o, leaf, ...) ``tree``, the place of group g, ``idx``, the place in the group by o and leaf, and ``width``, the group's size.

    Rows are ranged by group and order and numbered where they lie; what is joined to them is one row per partition and group.
    """
    by = [F.asc_nulls_first("g"), F.asc_nulls_first("o"), F.asc("leaf")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the number of the partition, and below bit 33 that of the row in it
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    pieces = stored(ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")), "merkle-pieces")
    # groups in the order in which they begin; both windows hold one row per partition, or the groups that begin in one
    groups = pieces.groupBy("g").agg(F.min("first").alias("first"), F.sum("n").alias("width")).withColumn("part", F.shiftright("first", 33))
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(behind), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1
    groups = groups.withColumn("place", place).join(starts, "part").select("g", (F.col("start") + F.col("place")).alias("tree"), "width")
    # a group's rows in earlier partitions
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.alias("p").join(groups.alias("t"), F.col("p.g").eqNullSafe(F.col("t.g"))).select("p.*", "tree", "width")
    pieces = stored(pieces.withColumn("lead", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")), "merkle-offsets")
    same = F.col("r.g").eqNullSafe(F.col("p.g")) & (F.col("r.part") == F.col("p.part"))
    return ranged.alias("r").join(pieces.alias("p"), same).select("r.*", "tree", "width", (F.col("r.at") + F.col("lead")).alias("idx")).drop("at", "part")


def ascend(hashes: list[bytes], width: int, arity: int, hop: int) -> tuple[list[list[tuple[bytes, bytes]]], bytes, int]:
    """Steps of each of neighbouring nodes towards the one above them, that one's hash, and the width of the tree at its level.

    A step is what is hashed before and after the own hash. ``width`` is the number of nodes of the whole tree at the level of ``hashes``.
    """
    steps: list[list[tuple[bytes, bytes]]] = [[] for _ in hashes]
    now, reach = hashes, 1
    for _ in range(hop):
        if width == 1:
            break
        sides, above = [], []
        for at in range(0, len(now), arity):
            run = now[at : at + arity]
            sides += [(b"".join(run[:i]), b"".join(run[i + 1 :])) for i in range(len(run))]
            above.append(hashlib.sha256(b"".join(run).hex().encode()).digest())
        for i, own in enumerate(steps):
            own.append(sides[i // reach])
        now, reach, width = above, reach * arity, -(-width // arity)
    return steps, now[0], width


def one_hop(nodes: DataFrame, level: int, arity: int, hop: int) -> DataFrame:
    """Stored nodes of a level from (tree, width, idx, hash, below, row): with steps, the link upwards and, for the next level, the hash there."""
    size = arity**hop
    member = F.struct("idx", "hash", "below", "row")
    runs = nodes.groupBy("tree", "width", F.floor(F.col("idx") / size).alias("run")).agg(F.array_sort(F.collect_list(member)).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                yield hashed(whole.slice(at, 64))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        members = batch.column("members")
        flat = members.flatten()
        idx, hashes, below, row = (pc.struct_field(flat, n) for n in ("idx", "hash", "below", "row"))
        names = {n: [] for n in ("tree", "steps", "up_tree", "up_level", "up_idx", "up_below", "up_hash", "up_width")}
        raw, sizes, start = hashes.to_pylist(), below.to_pylist(), 0
        for tree, width, run, n in zip(*(batch.column(c).to_pylist() for c in ("tree", "width", "run")), pc.list_value_length(members).to_pylist(), strict=True):
            steps, top, left = ascend(raw[start : start + n], width, arity, hop)
            if left > 1:
                up = (tree, level + 1, run)
            else:
                up = (None, None, None) if tree == TOP else (TOP, 0, tree)
            made = (tree, None, *up, sum(sizes[start : start + n]), top, left)
            for name, value in zip(names, made, strict=True):
                names[name] += steps if name == "steps" else [value] * n
            start += n
        kinds = (pa.int64(), pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())])), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        columns = [pa.array(v, k) for v, k in zip(names.values(), kinds, strict=True)]
        levels = pa.array([level] * len(flat), pa.int32())
        return pa.RecordBatch.from_arrays([levels, idx, hashes, below, row, *columns], ["level", "idx", "hash", "below", "row", *names])

    row = nodes.schema["row"].dataType.simpleString()
    made = f"level int, idx long, hash binary, below long, row {row}, tree long, steps {STEPS}, up_tree long, up_level int, up_idx long, up_below long, up_hash binary, up_width long"
    return stored(runs.mapInArrow(run, made), "merkle-nodes")


def hops(leaves: DataFrame, arity: int, hop: int) -> list[DataFrame]:
    """Stored nodes of all trees, level of hops by level, from leaves (tree, width, idx, hash, below, row)."""
    made = [one_hop(leaves, 0, arity, hop)]
    while True:
        on = made[-1].where((F.col("up_width") > 1) & (F.col("idx") % (arity**hop) == 0))
        if on.isEmpty():
            return made
        above = on.select("tree", F.col("up_width").alias("width"), F.col("up_idx").alias("idx"), F.col("up_hash").alias("hash"), F.col("up_below").alias("below"), F.lit(None).cast("boolean").alias("row"))
        made.append(one_hop(above, len(made), arity, hop))


@dataclass(frozen=True)
class Manifest:
    """Stored nodes of all trees: those of the rows, with ``row`` (doc_id, altered), and those above; and the root (None if there are no rows)."""

    leaves: DataFrame
    nodes: DataFrame
    root: bytes | None


def build(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", order: str = "doc_id", *, claims: Mapping[str, Column] | None = None,
    altered: Column | None = None, arity: int = 2, hop: int = 8,
) -> Manifest:
    """The manifest of ``docs``. Where ``altered`` holds, a row also keeps the hash of what is claimed: ``claims`` instead of its own fields."""
    if arity < 2 or hop < 1:
        raise ValueError("arity is at least 2 and hop at least 1")
    own = [F.col(f) for f in fields]
    false_ = [(claims or {}).get(f, F.col(f)) for f in fields]
    changed = F.lit(None).cast("binary") if altered is None else F.when(altered, leaf_hash(false_))
    rows = docs.select(F.col(group).alias("g"), F.col(order).alias("o"), leaf_hash(own).alias("leaf"), changed.alias("altered"))
    rows = numbered(rows).select("tree", "width", "idx", F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("below"), F.struct(F.col("o").alias("doc_id"), "altered").alias("row"))
    levels = hops(rows, arity, hop)
    ended = None
    for nodes in levels:
        here = nodes.where((F.col("up_width") == 1) & (F.col("idx") == 0))
        here = here.select(F.col("up_idx").alias("idx"), F.col("up_hash").alias("hash"), F.col("up_below").alias("below"))
        ended = here if ended is None else ended.unionByName(here)
    ended = stored(ended, "merkle-subroots")
    groups = ended.count()
    subroots = ended.select(F.lit(TOP).cast("long").alias("tree"), F.lit(groups).cast("long").alias("width"), "idx", "hash", "below", F.lit(None).cast("boolean").alias("row"))
    over = hops(subroots, arity, hop)
    top = over[-1].select("up_hash").first()
    above = over[0].drop("row")
    for nodes in (*levels[1:], *over[1:]):
        above = above.unionByName(nodes.drop("row"))
    return Manifest(levels[0], above, bytes(top[0]) if top else None)


HASHED = "unhex(sha2(CAST(concat(lower(hex(s.before)), lower(hex(h)), lower(hex(s.after))) AS BINARY), 256))"
CLIMB = f"""
WITH RECURSIVE climb(row, leaf, subroot, path, folded, nr, tree, level, idx, below) AS (
  SELECT row, hash, CAST(NULL AS BINARY), aggregate(steps, CAST('' AS BINARY), (p, s) -> concat(p, s.before, s.after)),
    aggregate(steps, coalesce(row.altered, hash), (h, s) -> {HASHED}), idx, up_tree, up_level, up_idx, up_below
  FROM {{leaves}}
  UNION ALL
  SELECT c.row, c.leaf, CASE WHEN n.tree = {TOP} AND n.level = 0 THEN n.hash ELSE c.subroot END,
    aggregate(n.steps, c.path, (p, s) -> concat(p, s.before, s.after)), aggregate(n.steps, c.folded, (h, s) -> {HASHED}), c.nr,
    n.up_tree, n.up_level, n.up_idx, n.up_below
  FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.level = c.level AND n.idx = c.idx AND n.copy = c.nr % (c.below DIV {SPREAD} + 1)
)
SELECT row, leaf, subroot, path, folded FROM climb WHERE tree IS NULL
"""


def proofs(manifest: Manifest) -> DataFrame:
    """row (doc_id, altered), leaf, subroot, path (all siblings) and folded (the root that the row's altered or own leaf leads to), as a table."""
    spark = manifest.leaves.sparkSession
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("below") / SPREAD))).alias("copy")
    climbed = spark.sql(CLIMB, leaves=manifest.leaves, nodes=manifest.nodes.select("*", copies))
    with setting(spark, ROW_LIMIT, "-1"):  # the depth is bounded by the height of the trees
        return stored(climbed, "merkle-proofs")


def verified(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    root = F.lit(None if manifest.root is None else manifest.root.hex()).cast("string")
    return proofs(manifest).select(
        "row.doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(hexed(F.col("path")).cast("binary"), 256).alias("proof_sha256"), hexed(F.col("folded")).alias("folded_root"),
        (hexed(F.col("folded")) == root).alias("verified"),
    )


def manifest_check(docs: DataFrame, **options) -> DataFrame:
    """Every row of ``docs`` proved against its manifest, with one more character claimed for one row in seven."""
    tampering = {"claims": {"n_chars": F.try_add("n_chars", F.lit(1))}, "altered": one_in_seven()}
    return settled(docs.sparkSession, "merkle-checked", lambda: verified(build(docs, **(tampering | options))))
