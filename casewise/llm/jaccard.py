"""Exact n-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when the Jaccard similarity of their sets reaches ``percent`` / 100.

1. Equal sets form one class. A class can only link if enough of its smallest shingles occur in another class too
   (a prefix filter that asks for several hits), then if enough of all its shingles do. Neither step loses a link.
2. Classes that share one of their rarest shingles, in one global order, form a supergroup: all links lie inside supergroups.
3. In a supergroup, signature trees hold the classes: a node has the OR of its members' shingle bitmaps and the range of their
   sizes. Two trees are walked together; a pair of nodes whose largest possible overlap is too small for a link is left out,
   and so is one whose members are already connected. What is left is compared shingle by shingle. Supergroups above a
   size are cut into chunks with a tree each, whose roots are compared first; only chunks that may link meet in a task.
4. Links found are joined into components; nothing is dropped and no group's pairs are listed.

A null or empty text has an empty set and links with nothing. Repeated rows are equal sets. Rows without id take part and may
get a null component. Shingles and classes are 64-bit hashes. An empty table gives no rows. Columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import blocks, components, settled, stored, text_of

#: Shingles in one chunk of a supergroup.
CHUNK_TOKENS = 500_000
BITS = 4096
#: log2 of the bits in the filter of wanted rows: 8 MB.
KEY_BITS = 26
LEAF = 8
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy(zero_copy_only=False)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    # an empty string is what is left of white space at either end
    names = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names] or [0], np.uint64)
    blank = np.array([w == "" for w in names] or [True])
    places = coded.indices.to_numpy(zero_copy_only=False)
    kept = ~blank[places] if len(places) else np.zeros(0, bool)
    words = hashes[places[kept]]
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        width = min(size, b - a)
        if width == 0:
            out.append(np.zeros(0, np.int64))
            continue
        n = b - a - width + 1
        rolled = words[a : a + n] + np.uint64(width)
        for k in range(1, width):
            rolled = rolled * MULTIPLIER + words[a + k : a + k + n]
        rolled ^= rolled >> np.uint64(29)
        rolled *= MULTIPLIER
        rolled ^= rolled >> np.uint64(32)
        out.append(np.unique(rolled.view(np.int64)))
    return out


def class_of(tokens: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def least_overlap(n: int, percent: int) -> int:
    """Fewest shingles that a set of ``n`` shares with any set it links to."""
    return (n * percent + 99) // 100


def hits_asked(n: int) -> int:
    """Shared shingles that the first filter's prefix is long enough for."""
    return max(1, n // 10)


def class_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, _h, n, c (class) and prefix: the smallest ``n - least overlap + hits`` shingles."""
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            sets = shingle_sets(batch.column("text"), size)
            heads = [s[: len(s) - least_overlap(len(s), percent) + hits_asked(len(s))] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), batch.column("_h"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([class_of(s) for s in sets], pa.int64()), pa.array(heads, pa.list_(pa.int64())),
                ],
                ["doc_id", "_h", "n", "c", "prefix"],
            )

    return rows.mapInArrow(run, "doc_id long, _h long, n long, c long, prefix array<long>")


def row_key() -> Column:
    return F.xxhash64("doc_id", "_h")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of ``2**KEY_BITS`` bits over ``keys`` (k), two bits a key, as 64-bit words.

    Its size is fixed: with very many keys more rows pass, and none is missed.
    """
    mask = (1 << KEY_BITS) - 1
    places = F.array(F.col("k").bitwiseAND(mask), F.shiftrightunsigned("k", KEY_BITS).bitwiseAND(mask))
    bits = keys.select(F.explode(places).alias("p"))
    bit = F.expr("shiftleft(1L, CAST(p & 63 AS INT))")
    words = bits.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("b")).toPandas()
    out = np.zeros(1 << (KEY_BITS - 6), np.int64)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter lets pass."""
    keys, mask = keys.view(np.uint64), np.uint64((1 << KEY_BITS) - 1)
    ok = np.ones(len(keys), bool)
    for p in (keys & mask, (keys >> np.uint64(KEY_BITS)) & mask):
        ok &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def class_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The whole sets (c, n, tokens) of the ``wanted`` rows (doc_id, _h, c), one row a class.

    Texts aren't moved: the tasks that read them skip the rows that a fixed-size filter of the wanted keys rules out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select(row_key().alias("k"))))
    rows = docs.select("doc_id", text_of().alias("text")).withColumn("_h", F.xxhash64("text")).select("text", row_key().alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            ok = in_bitmap(shared.value, whole.column("k").to_numpy())
            for batch in blocks([whole.filter(pa.array(ok))], "text", 4 << 20):
                sets = shingle_sets(batch.column("text"), size)
                columns = [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["c", "n", "tokens"])

    made = rows.mapInArrow(run, "c long, n long, tokens array<long>")
    return made.join(wanted.select("c"), "c", "left_semi").dropDuplicates(["c"])


def shared_in_prefix(classes: DataFrame, percent: int) -> DataFrame:
    """Classes (c) that have as many prefix shingles in common with others as a link needs."""
    rows = classes.where("n > 0").select("c", F.explode("prefix").alias("t"))
    shared = rows.groupBy("t").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("t")
    hits = rows.join(stored(shared, "shared-prefix"), "t").groupBy("c").agg(F.count("*").alias("hits"))
    rows_of = classes.where("n > 0").groupBy("c").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
    # a partner has at least percent of the size, and so asks for at least that share of the hits
    need = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 1000))
    return hits.join(rows_of, "c").where(F.col("hits") >= need * F.col("copies")).select("c")


def rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(c, t): for classes that share enough of all their shingles, the rarest ones, one of which every partner has too."""
    rows = sets.select("c", "n", F.explode("tokens").alias("t"))
    counts = stored(rows.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "shingle-counts")
    found = rows.join(counts, "t")
    own = Window.partitionBy("c")  # one document's shingles
    ranked = found.withColumns({"shared": F.count("*").over(own), "place": F.row_number().over(own.orderBy("df", "t"))})
    least = F.floor((F.col("n") * percent + 99) / 100)
    # shingles of this class alone come first in the order of rarity and take up part of the prefix
    reach = (F.col("n") - least + 1) - (F.col("n") - F.col("shared"))
    return ranked.where((F.col("shared") >= least) & (F.col("place") <= reach)).select("c", "t")


class Tree:
    """A signature tree over sets, in an order that keeps alike sets together."""

    def __init__(self, tokens: list[np.ndarray]) -> None:
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens])
        bits = np.zeros((len(tokens), BITS), bool)
        for row, t in zip(bits, tokens, strict=True):
            row[t & (BITS - 1)] = True
        self.excess = self.sizes - bits.sum(axis=1)
        signatures = np.packbits(bits, axis=1).view(np.uint64)
        self.levels = [(signatures, self.sizes, self.sizes, self.excess)]
        while len(self.levels[-1][0]) > 1:
            s, lo, hi, e = self.levels[-1]
            at = np.arange(0, len(s), LEAF)
            self.levels.append(
                (np.bitwise_or.reduceat(s, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at))
            )


def may_link(x: Tree, i: np.ndarray, y: Tree, j: np.ndarray, level: int, percent: int) -> np.ndarray:
    """Which pairs of nodes on a level could hold a link, by sizes and by the largest overlap their bitmaps allow.

    Shingles that fall on one bit of a set are at most its ``excess`` more than its bits, so common bits plus the smaller
    excess bound the overlap.
    """
    sx, lox, hix, ex = x.levels[level]
    sy, loy, hiy, ey = y.levels[level]
    sized = (hix[i] * 100 >= loy[j] * percent) & (hiy[j] * 100 >= lox[i] * percent)
    overlap = np.bitwise_count(sx[i] & sy[j]).sum(axis=1) + np.minimum(ex[i], ey[j])
    return sized & (overlap * 100 >= percent * np.maximum(lox[i], loy[j]))


def walk(x: Tree, y: Tree, same: bool, percent: int, root: np.ndarray, first: int, second: int) -> list[tuple[int, int]]:
    """Links that connect members of two trees not yet connected. ``root`` is a union-find over members of both, which start at ``first`` and ``second``."""

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    links = []
    stack = [(max(len(x.levels), len(y.levels)) - 1, np.zeros(1, int), np.zeros(1, int))]
    while stack:
        level, i, j = stack.pop()
        ok = may_link(x, i, y, j, level, percent) if level < min(len(x.levels), len(y.levels)) else np.ones(len(i), bool)
        i, j = i[ok], j[ok]
        if level == 0:
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                p, q = find(first + a), find(second + b)
                if p == q:
                    continue
                common = len(np.intersect1d(x.tokens[a], y.tokens[b], assume_unique=True))
                if common * 100 >= percent * (len(x.tokens[a]) + len(y.tokens[b]) - common):
                    root[max(p, q)] = min(p, q)
                    links.append((a, b))
            continue
        span = LEAF**level
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            ends = [range(first + a * span, first + min((a + 1) * span, len(x.sizes))), range(second + b * span, second + min((b + 1) * span, len(y.sizes)))]
            one = find(ends[0][0]) if len(ends[0]) else -1
            if level == 1 and all(find(m) == one for r in ends for m in r):
                continue
            n, m = child_count(x, level), child_count(y, level)
            left = np.arange(a * LEAF, min((a + 1) * LEAF, n)) if level < len(x.levels) else np.array([a])
            right = np.arange(b * LEAF, min((b + 1) * LEAF, m)) if level < len(y.levels) else np.array([b])
            pairs = np.array(np.meshgrid(left, right, indexing="ij")).reshape(2, -1)
            if same:
                pairs = pairs[:, pairs[0] < pairs[1]] if level == 1 else pairs[:, pairs[0] <= pairs[1]]
            if pairs.shape[1]:
                stack.append((level - 1, pairs[0], pairs[1]))
    return links


def child_count(tree: Tree, level: int) -> int:
    return len(tree.levels[level - 1][0]) if level <= len(tree.levels) else 1


def alike_order(tokens: list[np.ndarray]) -> list[int]:
    """Order by size band, then by the least shingles: copies with few edits mostly stay together."""
    return sorted(range(len(tokens)), key=lambda k: (int(np.log2(len(tokens[k]) + 1) * 2), *tokens[k][:3].tolist()))


def links_within(classes: list[int], tokens: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links among some sets."""
    order = alike_order(tokens)
    tree = Tree([tokens[k] for k in order])
    found = walk(tree, tree, True, percent, np.arange(len(order)), 0, 0)
    return [(classes[order[a]], classes[order[b]]) for a, b in found]


def links_between(one: tuple[list[int], list[np.ndarray]], two: tuple[list[int], list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """A spanning set of the links between two chunks."""
    trees, names = [], []
    for classes, tokens in (one, two):
        order = alike_order(tokens)
        trees.append(Tree([tokens[k] for k in order]))
        names.append([classes[k] for k in order])
    n, m = len(names[0]), len(names[1])
    found = walk(trees[0], trees[1], False, percent, np.arange(n + m), 0, n)
    return [(names[0][a], names[1][b]) for a, b in found]


def chunk_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(g, i, j): chunks of a supergroup that may hold a link, ``i = j`` for a chunk with itself. Roots are compared, not members."""

    def root(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BITS, bool)
        for t in rows["tokens"]:
            bits[np.asarray(t) & (BITS - 1)] = True
        sizes = rows["n"].to_numpy()
        excess = max(len(t) - len(np.unique(np.asarray(t) & (BITS - 1))) for t in rows["tokens"])
        return pd.DataFrame({"g": [key[0]], "k": [key[1]], "bits": [np.packbits(bits).tobytes()], "lo": [sizes.min()], "hi": [sizes.max()], "excess": [excess]})

    roots = members.groupBy("g", "k").applyInPandas(root, "g long, k long, bits binary, lo long, hi long, excess long")
    roots = stored(roots, "chunk-roots")
    other = roots.select(*[F.col(c).alias(c if c == "g" else f"{c}2") for c in roots.columns])
    sized = (F.col("hi") * 100 >= F.col("lo2") * percent) & (F.col("hi2") * 100 >= F.col("lo") * percent)
    met = roots.join(other, "g").where((F.col("k") <= F.col("k2")) & sized)

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([int(np.bitwise_count(np.frombuffer(x, np.uint8) & np.frombuffer(y, np.uint8)).sum()) for x, y in zip(a, b, strict=True)])

    overlap = common("bits", "bits2") + F.least("excess", "excess2")
    fits = (F.col("k") == F.col("k2")) | (overlap * 100 >= F.greatest("lo", "lo2") * percent)
    return met.where(fits).select("g", F.col("k").alias("i"), F.col("k2").alias("j"))


def set_links(sets: DataFrame, prefixes: DataFrame, percent: int, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Edges (a, b) that connect classes as all links among ``sets`` do."""
    centres = prefixes.groupBy("t").agg(F.min("c").alias("a"))
    near = prefixes.join(centres, "t").select("a", F.col("c").alias("b")).where("a <> b")
    groups = components(near, "supergroups").select(F.col("id").alias("c"), F.col("component").alias("g"))
    members = sets.join(groups, "c")
    # sets with few edits mostly agree in their least shingle; a part that is still too large is dealt out by class
    part = F.pmod(F.xxhash64(F.element_at("tokens", 1)), F.col("parts"))
    parts = members.groupBy("g").agg(F.ceil(F.sum("n") / chunk_tokens).alias("parts"))
    members = stored(members.join(parts, "g").withColumn("part", part).select("g", "part", "c", "n", "tokens"), "supergroups")
    pieces = members.groupBy("g", "part").agg(F.ceil(F.sum("n") / chunk_tokens).alias("pieces"))
    k = F.col("part") * F.lit(1 << 24) + F.pmod(F.xxhash64("c"), F.col("pieces"))
    members = stored(members.join(pieces, ["g", "part"]).select("g", k.cast("long").alias("k"), "c", "n", "tokens"), "chunks")
    pairs = stored(chunk_pairs(members, percent), "chunk-pairs")
    left = members.join(pairs.withColumnRenamed("i", "k"), ["g", "k"]).select("g", F.col("k").alias("i"), "j", F.lit(0).alias("side"), "c", "tokens")
    right = members.join(pairs.where("i < j").withColumnRenamed("j", "k"), ["g", "k"]).select("g", "i", F.col("k").alias("j"), F.lit(1).alias("side"), "c", "tokens")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in (0, 1):
            own = rows[rows["side"] == side].sort_values("c")
            sides.append((own["c"].tolist(), [np.asarray(t) for t in own["tokens"]]))
        found = links_between(*sides, percent) if sides[1][0] else links_within(*sides[0], percent)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return left.unionByName(right).groupBy("g", "i", "j").applyInPandas(compare, "a long, b long")


def component_rows(docs: DataFrame, size: int = 5, percent: int = 80, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """doc_id, _h (hash of the text), n_shingles and component_id of each row of ``docs``, as a table."""
    return settled(docs.sparkSession, "component-rows", lambda: joined_rows(docs, size, percent, chunk_tokens))


def joined_rows(docs: DataFrame, size: int, percent: int, chunk_tokens: int) -> DataFrame:
    classes = stored(class_rows(docs, size, percent), "classes")
    some = stored(shared_in_prefix(classes, percent), "first-filter")
    wanted = classes.join(some, "c").groupBy("c").agg(F.min(F.struct("doc_id", "_h")).alias("r")).select("c", "r.doc_id", "r._h")
    sets = stored(class_sets(docs, stored(wanted, "wanted"), size), "class-sets")
    prefixes = stored(rare_prefixes(sets, percent), "rare-prefixes")
    links = stored(set_links(sets, prefixes, percent, chunk_tokens), "links")
    linked = components(links, "near-duplicates").select(F.col("id").alias("c"), F.col("component").alias("root"))
    rooted = classes.select("doc_id", "_h", "n", "c").join(linked, "c", "left")
    rooted = stored(rooted.select("doc_id", "_h", "n", F.when(F.col("n") > 0, F.coalesce("root", "c")).alias("root")), "rooted")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    own = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rooted.join(least, "root", "left").select("doc_id", "_h", F.col("n").alias("n_shingles"), own.alias("component_id"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of each row of ``docs``."""
    return component_rows(docs, **options).drop("_h")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the one whose id is smallest. Rows without an id stay."""
    found = component_rows(docs.select("doc_id", "text"), **options)
    gone = stored(found.where("doc_id <> component_id").select("doc_id", "_h").distinct(), "near-copies")
    again = found.groupBy("doc_id", "_h").agg(F.count("*").alias("_rows")).where("_rows > 1 and doc_id is not null").select("doc_id", "_h")
    again = stored(again, "repeated-rows")
    key = ["doc_id", "_h"]
    # most rows are in neither table; a fixed-size filter tells so where they are read, and only the others are moved
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(gone.unionByName(again).select(row_key().alias("k"))))

    @F.pandas_udf("boolean")
    def named(keys: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, keys.to_numpy(np.int64)))

    marked = docs.drop("_h", "_named").withColumn("_h", F.xxhash64(text_of())).withColumn("_named", named(row_key()))
    rest = marked.where("_named").join(gone, key, "left_anti")
    once, more = rest.join(again, key, "left_anti"), rest.join(again, key, "left_semi").dropDuplicates(key)
    return marked.where("not _named").unionByName(once).unionByName(more).select(*docs.columns)
