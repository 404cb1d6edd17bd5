"""Katz backoff language model over words, with Good-Turing discounts and exactly normalised backoff weights.

``P(w | h) = d(c) * c / c(h)`` for a pair that training text holds ``c`` times, else ``a(h) * P(w)``; ``a(h)`` hands exactly the mass left
over to the words not seen after ``h``. Words have Good-Turing discounted probabilities themselves, and the mass left over there
goes to one unknown word. A text begins after a start mark and ends with an end token. A context whose pairs leave no mass gives up
one part in ``c(h) + 1``.

Training writes three tables: words, contexts, and pairs cut into buckets by context, one row of packed arrays a bucket. A text is read
once to be scored, in blocks of texts: the distinct pairs of a block are sent in packed rows to the buckets, where they meet the bucket's counts,
and one packed row a block and bucket comes back to the block, which sums up its texts; one share of the texts after another.
A bucket holds about ``BUCKET_TOKENS`` tokens of training; the pairs of a context with more than an eighth of that are spread over all buckets,
pairs above a fixed share of all tokens are scored where the texts are read, and where there is far more to score than was learned a bucket is
copied. Values of words above a fixed share are sent to every task; both lists are bounded by the inverse of the share.

A null or empty text is just an end token. Words are told apart by 64-bit hashes. Without
training rows every word is the unknown one, of probability 1. An empty table gives no rows. Columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import blocks, settled, stored, text_of
from casewise.llm.words import word_codes

START, END = np.uint64(0), np.uint64(1)
#: Counts up to this one are discounted, as Katz proposes.
DISCOUNTED = 5
#: Words and pairs of at least this share of all tokens are sent to every task: at most as many words, twice as many pairs, as its inverse.
COMMON_WORD, COMMON_PAIR = 2.0**-18, 2.0**-14
#: Training tokens of a bucket; bytes of text that are cut into words at a time.
BUCKET_TOKENS, BLOCK = 1 << 20, 2 << 20
#: Shares of the texts whose pairs meet the buckets one share after another, which bounds the disk that takes.
PASSES = 3
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def discounts(counts: dict[int, int]) -> list[float]:
    """Katz's factors for counts 1 to ``DISCOUNTED`` from the numbers of types with each count.

    Where Good-Turing estimates are undefined or outside (0, 1), an absolute discount is taken.
    """
    n = [0, *(counts.get(r, 0) for r in range(1, DISCOUNTED + 2))]
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    out = []
    top = (DISCOUNTED + 1) * n[DISCOUNTED + 1] / n[1] if n[1] else 1.0
    for r in range(1, DISCOUNTED + 1):
        ratio = (r + 1) * n[r + 1] / (r * n[r]) if n[r] else 0.0
        d = (ratio - top) / (1 - top) if top < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - min(max(flat, 0.1), 0.9)) / r)
    return out


def discounted(c: Column, d: list[float]) -> Column:
    return F.when(c <= DISCOUNTED, c * F.element_at(F.array(*map(F.lit, d)), F.least(c, F.lit(DISCOUNTED)).cast("int"))).otherwise(c.cast("double"))


def mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit name for two."""
    x = (h ^ (h >> np.uint64(32))) * A + (w ^ (w >> np.uint64(29))) * B
    x ^= x >> np.uint64(31)
    x *= A
    return x ^ (x >> np.uint64(30))


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one member of each group of equal keys, in order of the keys, and the groups' sizes."""
    order = np.argsort(key)
    ordered = key[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), ordered[1:] != ordered[:-1]]))
    return order[first], np.diff(np.append(first, len(key)))


@dataclass
class Pairs:
    """The tokens of a block of texts with what stands before each: hashes of the block's words, their places, text numbers, words of each text."""

    names: np.ndarray
    h: np.ndarray
    w: np.ndarray
    text: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Pairs:
        names, words, counts = word_codes(texts)
        names = np.append(np.maximum(names, np.uint64(2)), [START, END])  # two names are taken
        words, ends = words.astype(np.int64), np.cumsum(counts)
        h, w = np.insert(words, ends - counts, len(names) - 2), np.insert(words, ends, len(names) - 1)
        return cls(names, h, w, np.repeat(np.arange(len(counts)), counts + 1), counts)

    def distinct(self, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A token of each distinct pair, by bucket and context; the number of each pair's tokens; which of them every token is."""
        n = len(self.names)
        if buckets * n * n < 2**63:
            order = np.argsort((bucket * n + self.h) * n + self.w)
        else:
            order = np.lexsort((self.w, self.h, bucket))
        h, w = self.h[order], self.w[order]
        new = np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
        first, own = np.flatnonzero(new), np.empty(len(order), np.int64)
        own[order] = np.cumsum(new) - 1
        return order[first], np.diff(np.append(first, len(order))), own


@dataclass
class Lookup:
    """Values of common names in sorted order."""

    names: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, names: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(names)
        return cls(names[order], values[order])

    def index(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each name is known, and its place (0 if it isn't)."""
        if not len(self.names):
            return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        known = self.names[at] == names
        return known, np.where(known, at, 0)

    def pack(self, names: np.ndarray, known: np.ndarray, at: np.ndarray) -> bytes:
        """Places of known names, squeezed, and the other names in full."""
        ids = squeezed(np.where(known, at, RARE).astype("<u4"))
        return np.array([len(names), len(ids)], "<u4").tobytes() + ids + names[~known].astype("<u8").tobytes()

    def unpack(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The names, whether each is known, and its place (0 if it isn't)."""
        n, size = (int(x) for x in np.frombuffer(data, "<u4", 2))
        ids = spread_out(data[8 : 8 + size], n)
        known = ids != RARE
        names, at = np.empty(n, np.uint64), np.where(known, ids, 0).astype(np.int64)
        names[known] = self.names[at[known]]
        names[~known] = np.frombuffer(data, "<u8", offset=8 + size)
        return names, known, at

    def unpack_all(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self.unpack(x) for x in parts]
        return joined([x[0] for x in found], np.uint64), joined([x[1] for x in found], bool), joined([x[2] for x in found], np.int64)


def squeezed(ids: np.ndarray) -> bytes:
    """Four-byte numbers byte by byte, first bytes first: frequent words and small steps between sorted ones leave few bits in most of them."""
    return pa.Codec("zstd", 1).compress(ids.view("u1").reshape(-1, 4).T.tobytes(), asbytes=True)


def spread_out(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 4 * n, asbytes=True), "u1") if n else np.zeros(0, "u1")
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").reshape(n)


RARE = 2**32 - 1
#: Columns of the values of common words: log10(c + 0.5), log10 P, P, and as contexts log10 share, log10 backoff and whether pairs are spread.
BASE, LOG_P, P, SHARE, BACKOFF, SPREAD = range(6)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts in one byte; those of 255 and more follow in full."""
    return np.uint32(len(c)).tobytes() + np.minimum(c, 255).astype("u1").tobytes() + c[c >= 255].astype("<u8").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    c = np.frombuffer(data, "u1", n, 4).astype(np.int64)
    c[c == 255] = np.frombuffer(data, "<u8", offset=4 + n)
    return c


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


@dataclass
class Katz:
    words: DataFrame  # w, c
    tokens: int
    types: int
    buckets: int
    word_discounts: list[float]
    unknown: float = 1.0
    scale: float = 1.0
    pairs: DataFrame | None = None  # bucket, h, w and c packed, and what training needs of each bucket
    contexts: DataFrame | None = None  # h, bucket, total, backoff, share: log10 of a(h) and of the share that one counted token has
    pair_discounts: list[float] = field(default_factory=list)
    common: Lookup | None = None  # values of common words
    hot: DataFrame | None = None  # h, w of common pairs, at most 2 / COMMON_PAIR

    def word_probability(self, c: Column) -> Column:
        """P(w) of a word counted ``c`` times; the unknown word's for null."""
        return F.when(c.isNull(), F.lit(self.unknown)).otherwise(discounted(c, self.word_discounts) * F.lit(self.scale / max(self.tokens, 1)))

    def pair_rows(self) -> DataFrame:
        """The counted pairs as rows: h, w, c."""
        common = self.common

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    columns = [common.unpack(row["h"])[0].view(np.int64), common.unpack(row["w"])[0].view(np.int64), unpack_counts(row["c"])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "w", "c"])

        return self.pairs.select("h", "w", "c").mapInArrow(run, "h long, w long, c long")


def bucket_of(pairs: Pairs, common: Lookup, known: np.ndarray, at: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each token's context or, if its pairs are spread, of the pair; ``known`` and ``at`` are the places of the block's words."""
    spread = known & (common.values[at, SPREAD] > 0) if len(common.names) else known
    place = lambda x: ((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    bucket, wide = place(pairs.names * A)[pairs.h], np.flatnonzero(spread[pairs.h])
    bucket[wide] = place(mixed(pairs.names[pairs.h[wide]], pairs.names[pairs.w[wide]]))
    return bucket


def counted_words(docs: DataFrame) -> DataFrame:
    """Counts of words (h null), and of pairs that are common in some block, there; a common pair is so in at least one."""

    least = COMMON_PAIR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 2 * BLOCK):
            block = Pairs.of(batch.column("text"))
            counts = np.bincount(block.w, minlength=len(block.names))
            at, limit = np.flatnonzero(counts), max(DISCOUNTED + 1, least * len(block.w))
            names, counts, none = block.names[at], counts[at], len(at)
            # a common pair has common words
            often = np.bincount(block.h, minlength=len(block.names))[block.h] >= limit
            h, w = block.names[block.h[often]], block.names[block.w[often]]
            pair, times = grouped(mixed(h, w))
            pair, times = pair[times >= limit], times[times >= limit]
            context = pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(h[pair].view(np.int64))])
            columns = [context, pa.array(np.append(names, w[pair]).view(np.int64)), pa.array(np.append(counts, times))]
            yield pa.RecordBatch.from_arrays(columns, ["h", "w", "c"])

    return docs.select("text").mapInArrow(run, "h long, w long, c long").groupBy("h", "w").agg(F.sum("c").alias("c"))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets in ascending order and where each of them stands in sorted ``bucket``."""
    names, starts = np.unique(bucket, return_index=True)
    return ((int(b), slice(x, y)) for b, x, y in zip(names, starts, np.append(starts[1:], len(bucket)), strict=True))


def packed(block: Pairs, words: Lookup, known: np.ndarray, at: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """Contexts and words of some tokens of a block, packed."""
    return [words.pack(block.names[x], known[x], at[x]) for x in (block.h[tokens], block.w[tokens])]


def counted_pairs(docs: DataFrame, model: Katz, common) -> DataFrame:
    """One row a bucket: pairs and counts, packed; numbers of pairs with low counts; per context total, low counts and P of what it was seen with."""
    buckets = model.buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.value
        for batch in blocks(batches, "text", BLOCK):
            block = Pairs.of(batch.column("text"))
            known, at = words.index(block.names)
            bucket = bucket_of(block, words, known, at, buckets)
            first, c, _ = block.distinct(bucket, buckets)
            out = [(b, *packed(block, words, known, at, first[x]), pack_counts(c[x])) for b, x in by_bucket(bucket[first])]
            yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out)], ["bucket", "h", "w", "c"])

    def count(table: pa.Table) -> pa.Table:
        words = common.value
        bucket = table.column("bucket")[0].as_py()
        h, w = (words.unpack_all(table.column(n).to_pylist())[0] for n in "hw")
        c = joined([unpack_counts(x.as_py()) for x in table.column("c")], np.int64)
        order = np.lexsort((w, h))
        h, w, c = h[order], w[order], c[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        h, w, c = h[first], w[first], np.add.reduceat(c, first)
        del order, first
        known, at = words.index(w)
        contexts, own = np.unique(h, return_inverse=True)
        n = len(contexts)
        p = np.where(known, words.values[at, P], 0.0) if len(words.names) else np.zeros(len(w))
        one = [[bucket], [words.pack(h, *words.index(h))], [words.pack(w, known, at)], [pack_counts(c)]]
        lists = [
            np.array([(c == r).sum() for r in range(1, DISCOUNTED + 2)]), contexts.view(np.int64), np.bincount(own, c, n).astype(np.int64), np.bincount(own, p, n).astype(float),
            *(np.bincount(own, c == r, n).astype(np.int64) for r in range(1, DISCOUNTED + 1)), h[~known].view(np.int64), w[~known].view(np.int64),
        ]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists]
        return pa.Table.from_arrays([*(pa.array(x, f.type) for x, f in zip(one, COUNTED)), *lists], schema=COUNTED)

    sent = docs.select("text").mapInArrow(send, "bucket long, h binary, w binary, c binary")
    return sent.groupBy("bucket").applyInArrow(count, "bucket long, h binary, w binary, c binary, " + ", ".join(f"{n} array<{'double' if n == 'seen' else 'long'}>" for n in LISTS))


#: Numbers of pairs with low counts; per context its name, total, P of what it was seen with and its pairs with low counts; pairs with words that aren't common.
PER_CONTEXT = ["context", "total", "seen", *(f"low{r}" for r in range(1, DISCOUNTED + 1))]
LISTS = ["n", *PER_CONTEXT, "rare_h", "rare_w"]
COUNTED = pa.schema([("bucket", pa.int64()), *((n, pa.binary()) for n in "hwc"), *((n, pa.list_(pa.float64() if n == "seen" else pa.int64())) for n in LISTS)])


def low_counts(rows: DataFrame) -> tuple[dict[int, int], int, int]:
    """How many rows have each low count, the number of rows and the sum of counts."""
    row = rows.agg(*[F.sum(F.when(F.col("c") == r, 1).otherwise(0)).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)], F.count("*").alias("rows"), F.sum("c").alias("total")).first()
    return {r: row[f"n{r}"] or 0 for r in range(1, DISCOUNTED + 2)}, row["rows"], row["total"] or 0


def train(docs: DataFrame) -> Katz:
    """Learns from all rows of ``docs`` (text)."""
    docs = docs.select(text_of().alias("text"))
    counted = stored(counted_words(docs), "katz-words")
    words = counted.where("h is null").select("w", "c")
    low, types, tokens = low_counts(words)
    model = Katz(words, tokens, types, max(-(-tokens // BUCKET_TOKENS), 1), discounts(low))
    if tokens:
        mass = 1 - sum((1 - d) * r * low[r] for r, d in enumerate(model.word_discounts, start=1)) / tokens
        model.unknown = 1 - mass
        if model.unknown < 1e-12:  # no word is rare: the unknown one gets half a count
            model.unknown = 0.5 / (tokens + 0.5)
            model.scale = (1 - model.unknown) / mass
    model.common = common_words(model)
    model.hot = counted.where(F.col("h").isNotNull() & (F.col("c") >= COMMON_PAIR / 2 * tokens)).select("h", "w")
    spark = docs.sparkSession
    model.pairs = stored(counted_pairs(docs, model, spark.sparkContext.broadcast(model.common)), "katz-pairs")
    low = model.pairs.agg(*[F.sum(F.element_at("n", r)).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]).first()
    model.pair_discounts = discounts({r: low[f"n{r}"] or 0 for r in range(1, DISCOUNTED + 2)})
    model.contexts = stored(context_table(model), "katz-contexts")
    return model


def common_words(model: Katz) -> Lookup:
    """Common words, the end and the start mark; their values as contexts are filled in by :func:`with_contexts`."""
    probable = model.words.where((F.col("c") >= COMMON_WORD * model.tokens) | (F.col("w") == int(END))).select("w", "c", model.word_probability(F.col("c")).alias("p")).toPandas()
    names, c, p = probable["w"].to_numpy(np.int64), probable["c"].to_numpy(float), probable["p"].to_numpy(float)
    if END not in names.view(np.uint64):
        names, c, p = np.append(names, int(END)), np.append(c, 0.0), np.append(p, model.unknown)
    names, c, p = np.append(names, int(START)), np.append(c, 0.0), np.append(p, 1.0)
    spread = c >= BUCKET_TOKENS / 8
    spread[-1] = True  # every text has a start
    values = np.stack([np.log10(c + 0.5), np.log10(p), p, np.zeros(len(c)), np.zeros(len(c)), spread], axis=1)
    return Lookup.of(names.view(np.uint64), values)


def context_table(model: Katz) -> DataFrame:
    """Backoff weight, share and bucket of every context; the bucket of a spread one is any that holds it."""
    parts = model.pairs.select("bucket", F.explode(F.arrays_zip(*PER_CONTEXT)).alias("x"))
    low = sum((F.col(f"x.low{r}") * (r * (1 - d)) for r, d in enumerate(model.pair_discounts, start=1)), F.lit(0.0))
    parts = parts.select("bucket", F.col("x.context").alias("h"), F.col("x.total").alias("total"), low.alias("left"), F.col("x.seen").alias("seen"))
    rare = model.pairs.select(F.explode(F.arrays_zip("rare_h", "rare_w")).alias("x")).select(F.col("x.rare_h").alias("h"), F.col("x.rare_w").alias("w"))
    rare = rare.join(model.words, "w").select(F.lit(None).cast("long").alias("bucket"), "h", F.lit(0).cast("long").alias("total"), F.lit(0.0).alias("left"), model.word_probability(F.col("c")).alias("seen"))
    sums = parts.unionByName(rare).groupBy("h").agg(F.max("bucket").alias("bucket"), *[F.sum(n).alias(n) for n in ("total", "left", "seen")])
    open_ = F.greatest(1 - F.col("seen"), F.lit(model.unknown) * 1e-3)
    full = F.col("left") < 1e-9
    share = F.when(full, 1 / (F.col("total") + 1)).otherwise(1 / F.col("total"))
    spare = F.when(full, 1 / (F.col("total") + 1)).otherwise(F.col("left") / F.col("total"))
    return sums.select("h", "bucket", "total", F.log10(spare / open_).alias("backoff"), F.log10(share).alias("share"))


def common_values(model: Katz) -> tuple[Lookup, Lookup]:
    """Values of common words, those as contexts included, and log10 P of common pairs."""
    words = Lookup(model.common.names, model.common.values.copy())
    listed = model.words.sparkSession.createDataFrame([(int(x),) for x in words.names.view(np.int64)], "h long")
    found = model.contexts.join(F.broadcast(listed), "h").select("h", "share", "backoff").toPandas()  # at most 1 / COMMON_WORD rows
    _, at = words.index(found["h"].to_numpy(np.int64).view(np.uint64))
    words.values[at, SHARE], words.values[at, BACKOFF] = found["share"].to_numpy(float), found["backoff"].to_numpy(float)
    value = F.log10(discounted(F.col("c"), model.pair_discounts)).alias("v")
    hot = model.pair_rows().join(F.broadcast(model.hot), ["h", "w"]).select("h", "w", value).toPandas()  # at most 2 / COMMON_PAIR rows
    h, w = (hot[n].to_numpy(np.int64).view(np.uint64) for n in "hw")
    known, at = words.index(h)
    v = hot["v"].to_numpy(float) + words.values[at, SHARE]
    return words, Lookup.of(mixed(h, w)[known], v[known])


def sent_blocks(rows: DataFrame, lookups, buckets: int) -> DataFrame:
    """Blocks of texts. One row a block and bucket holds the block's distinct pairs there, packed; common pairs are left out. One row a block, without
    a bucket, holds what its texts got from common words and common pairs, and which sent pair each other token is.

    ``links`` names for every sent pair one whose context is the pair's word, plus one; 0 where that word is common.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = lookups.value
        number = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, "text", BLOCK):
            block = Pairs.of(batch.column("text"))
            n, text = len(block.counts), block.text
            known, at = words.index(block.names)
            base, learned = np.where(known, words.values[at, BASE], 0.0), known & (words.values[at, BASE] > 0)
            bucket = bucket_of(block, words, known, at, buckets)
            first, _, own = block.distinct(bucket, buckets)
            paired, place = pairs.index(mixed(block.names[block.h[first]], block.names[block.w[first]]))
            value = np.where(paired, pairs.values[place], 0.0) if len(pairs.names) else np.zeros(len(first))
            score = np.bincount(text, value[own], n)
            sent = first[~paired]
            out = [{"block": number, "bucket": b, **dict(zip("hw", packed(block, words, known, at, sent[x])))} for b, x in by_bucket(bucket[sent])]
            link = np.zeros(len(block.names), np.int64)
            link[block.h[sent]] = np.arange(1, len(sent) + 1)
            link[known] = 0
            numbers, left = np.cumsum(~paired) - 1, ~paired[own]
            tokens = pack_counts(np.bincount(text[left], minlength=n))
            whole = {"tokens": tokens, "which": numbers[own[left]], "links": link[block.w[sent]]}
            whole |= {k: np.array([len(v)], "<u4").tobytes() + squeezed(v.astype("<u4")) for k, v in whole.items() if k != "tokens"}
            lists = {"doc_id": batch.column("doc_id").to_pylist(), "learned": batch.column("learned").to_pylist(), "n_tokens": block.counts + 1}
            lists |= {"known": np.bincount(text, learned[block.w], n).astype(np.int64), "base": np.bincount(text, base[block.w], n).astype(float), "score": score.astype(float)}
            out.append({"block": number, "n": len(block.w), **whole, **lists})
            yield pa.RecordBatch.from_pylist(out, schema=SENT)
            number += 1

    return rows.select("doc_id", "text", "learned").mapInArrow(send, SENT_COLUMNS)


#: Results of a text, and the columns of what is sent, comes back from a bucket and belongs to a block.
RESULT = {"doc_id": "long", "learned": "boolean", "n_tokens": "long", "known": "long", "base": "double", "score": "double"}
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
WHOLE = ["tokens", "which", "links"]
SENT = pa.schema(
    [("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), *((n, pa.binary()) for n in ["h", "w", *WHOLE]), *((n, pa.list_(ARROW[t])) for n, t in RESULT.items())]
)
SENT_COLUMNS = "block long, bucket long, n long, h binary, w binary, " + ", ".join(f"{n} binary" for n in WHOLE) + ", " + ", ".join(f"{n} array<{t}>" for n, t in RESULT.items())
FOUND = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("seen", pa.binary()), ("value", pa.binary()), ("total", pa.binary())])


def bucket_answers(sent: DataFrame, model: Katz, lookups, copies: int) -> DataFrame:
    """One row for each row that was sent to a bucket, with, for its pairs in their order: whether training text holds the pair; log10 of its probability,
    or of the part of it that doesn't depend on a word that isn't common; and one more than the count of a context that isn't a common word, or 0."""
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy")
    texts = sent.where("bucket is not null").select("block", "bucket", "h", "w", F.pmod(F.xxhash64("block"), F.lit(copies).cast("long")).alias("copy"))
    counts = model.pairs.select("bucket", "h", "w", "c", spread)
    listed = F.broadcast(model.words.sparkSession.createDataFrame([(int(x),) for x in model.common.names.view(np.int64)], "h long"))
    contexts = model.contexts.join(listed, "h", "left_anti").select("bucket", F.col("h").alias("context"), "total", "share", "backoff", spread)
    d = np.array([0.0, *(r * x for r, x in enumerate(model.pair_discounts, start=1))])

    def answer(table: pa.Table) -> pa.Table:
        words, _ = lookups.value
        own = table.filter(pc.is_valid(table.column("c")))
        h, w = (words.unpack_all(own.column(n).to_pylist())[0] for n in "hw")
        c = joined([unpack_counts(x.as_py()) for x in own.column("c")], np.int64)
        pairs = Lookup.of(mixed(h, w), np.log10(np.where(c <= DISCOUNTED, d[np.minimum(c, DISCOUNTED)], c)))
        del own, h, w, c
        open_ = table.filter(pc.is_valid(table.column("context")))
        names = open_.column("context").to_numpy().view(np.uint64)
        contexts = Lookup.of(names, np.stack([open_.column(n).to_numpy() for n in ("share", "backoff", "total")], axis=1))
        out = []
        for batch in table.filter(pc.is_valid(table.column("block"))).select(["block", "bucket", "h", "w"]).to_batches(max_chunksize=8):
            part = batch.to_pydict()
            found = [words.unpack(x) for x in part["h"]]
            ends = np.cumsum([len(x[0]) for x in found])[:-1]
            (h, usual, at), (w, common, w_at) = (joined_parts(found), words.unpack_all(part["w"]))
            seen, place = pairs.index(mixed(h, w))
            share, backoff = words.values[at, SHARE], words.values[at, BACKOFF]
            total = np.where(usual, 0, 1)
            other = np.flatnonzero(~usual)
            mine, own_at = contexts.index(h[other])
            share[other], backoff[other] = (np.where(mine, contexts.values[own_at, i], 0.0) if len(contexts.names) else 0.0 for i in range(2))
            total[other] += np.where(mine, contexts.values[own_at, 2], 0).astype(np.int64) if len(contexts.names) else 0
            value = backoff + np.where(common, words.values[w_at, LOG_P], 0.0)
            value[seen] = (pairs.values[place[seen]] if len(pairs.names) else 0.0) + share[seen]
            codec = pa.Codec("zstd", 1)
            for block, bucket, s, v, t in zip(part["block"], part["bucket"], *(np.split(x, ends) for x in (seen, value, total)), strict=True):
                out.append({"block": block, "bucket": bucket, "seen": np.packbits(s).tobytes(), "value": codec.compress(v.tobytes(), asbytes=True), "total": pack_counts(t)})
        return pa.Table.from_pylist(out, schema=FOUND)

    parts = texts.unionByName(counts, allowMissingColumns=True).unionByName(contexts, allowMissingColumns=True)
    return parts.groupBy("bucket", "copy").applyInArrow(answer, "block long, bucket long, seen binary, value binary, total binary")


def joined_parts(found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def block_sums(sent: DataFrame, answers: DataFrame, model: Katz) -> DataFrame:
    """One row a text, from the answers to its block. Every word of a text is a context once, so the block knows the counts of all its words:
    a word's count is its total as a context."""
    d = np.array([0.0, *(r * x for r, x in enumerate(model.word_discounts, start=1))])
    unknown, scale = model.unknown, model.scale / max(model.tokens, 1)

    def close(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("bucket").fill_null(-1).to_numpy())
        table = table.take(pa.array(order))
        whole, parts = {n: table.column(n)[0].as_py() for n in [*WHOLE, *RESULT]}, table.slice(1).select(["seen", "value", "total"]).to_pylist()
        which, links = (spread_out(whole[n][4:], int(np.frombuffer(whole[n], "<u4", 1)[0])).astype(np.int64) for n in WHOLE[1:])
        total = joined([unpack_counts(x["total"]) for x in parts], np.int64)
        sizes = [int(np.frombuffer(x["total"], "<u4", 1)[0]) for x in parts]
        codec = pa.Codec("zstd")
        value = joined([np.frombuffer(codec.decompress(x["value"], 8 * n, asbytes=True), float) for x, n in zip(parts, sizes, strict=True)], float).copy()
        seen = joined([np.unpackbits(np.frombuffer(x["seen"], "u1"), count=n).astype(bool) for x, n in zip(parts, sizes, strict=True)], bool)
        rest = np.flatnonzero(~seen & (links > 0))
        c = total[links[rest] - 1] - 1
        p = np.where(c <= DISCOUNTED, d[np.clip(c, 0, DISCOUNTED)], c) * scale
        value[rest] += np.log10(np.where(c > 0, p, unknown))
        base = np.where(total > 0, np.log10(np.maximum(total, 1) - 0.5), 0.0)
        n = len(whole["doc_id"])
        text = np.repeat(np.arange(n), unpack_counts(whole["tokens"]))
        for name, x in (("known", total > 1), ("base", base), ("score", value)):
            whole[name] = (np.array(whole[name]) + np.bincount(text, x[which], n)).astype(np.int64 if name == "known" else float)
        return pa.Table.from_arrays([pa.array(whole[k], ARROW[t]) for k, t in RESULT.items()], list(RESULT))

    blocks_ = sent.where("bucket is null").select("block", "bucket", *WHOLE, *RESULT)
    return blocks_.unionByName(answers, allowMissingColumns=True).groupBy("block").applyInArrow(close, ", ".join(f"{n} {t}" for n, t in RESULT.items()))


def bucket_scores(rows: DataFrame, model: Katz, lookups) -> DataFrame:
    """One row a text of ``rows`` (doc_id, text, learned): doc_id, learned, n_tokens, known, base, score."""
    sent = stored(sent_blocks(rows, lookups, model.buckets), "katz-sent")
    copies = max((sent.agg(F.sum("n")).first()[0] or 0) // (2 * BUCKET_TOKENS * model.buckets), 1)
    answers = stored(bucket_answers(sent, model, lookups, copies), "katz-answers")
    return block_sums(sent, answers, model)


def score(docs: DataFrame, model: Katz, learned: Column) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, base_score and score of each row of ``docs`` (doc_id, text).

    ``learned`` marks rows that the model was trained on; it is handed on.
    """
    return settled(docs.sparkSession, "katz-scores", lambda: scored_rows(docs, model, learned))


def scored_rows(docs: DataFrame, model: Katz, learned: Column) -> DataFrame:
    spark = docs.sparkSession
    lookups = spark.sparkContext.broadcast(common_values(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), learned.alias("learned"))
    out = None
    for i in range(PASSES):  # what a pass shuffles and finds goes before the next one
        part = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(PASSES)) == i)
        share = settled(spark, "katz-sums", lambda part=part: bucket_scores(part, model, lookups))
        out = share if out is None else out.unionByName(share)
    floor = float(np.log10(model.tokens + 0.5 * (model.types + 1)))
    return out.select(
        "doc_id", "learned", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * floor).alias("base_score"), "score",
    )
