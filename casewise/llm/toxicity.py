"""Toxicity by a small convolutional text classifier.

Words are hashed to a fixed table of embeddings; filters of several widths slide over the whole text, each filter's maximum is
kept, and a logistic layer reads the maxima. All labelled rows are learned from: they are dealt into shards by a hash of their
ids, every epoch takes numpy steps over each shard in a task of its own, and the moves of all shards are averaged; only models, of fixed
size, reach the driver. Every step runs in Arrow tasks, which share Python workers, so an executor holds one worker per core. Scoring runs
in tasks over every text. Decision thresholds are set per language on all labelled rows left out of the gradient steps (a hash picks
them), counted by score; language, source and id never enter a score.

A null or empty text is scored as a text without words. Labels that are null, belong to no document, or have no class are not
learned from; repeated labels count as often as they occur. With one class only, or none, every score is the share of label 1 (0.5
without labels). Tables without rows give none. Columns of the input that bear the name of a result column are replaced.
"""

from __future__ import annotations

import copy
import math
import pickle
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.llm.common import blocks, released, schema_with, setting, stored, text_of

BUCKETS = 1 << 16
#: Pieces of the embedding table that are added in tasks of their own.
PIECES = 16
#: Labelled ids up to which they are sent to the texts; beyond that both are shuffled.
SENT_IDS = 1 << 20
#: Bucket of the padding after each text.
PAD = 0
PIECE_ROW = "piece int, parts binary"
COUNTED = pa.schema([("lang", pa.string()), ("toxic", pa.int32()), ("logit", pa.float64()), ("weight", pa.float64())])
BATCH_ROWS, FILE_COST = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.openCostInBytes"


@dataclass(frozen=True)
class Options:
    shard_rows: int = 12_000
    dimensions: int = 16
    filters: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    epochs: int = 6
    batch: int = 16
    rate: float = 0.05
    held: float = 0.2
    seed: int = 11


@dataclass
class Model:
    embeddings: np.ndarray
    kernels: list[np.ndarray]  # per width: (width, dimensions, filters)
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def tables(self) -> list[list[np.ndarray]]:
        """What each bucket adds to each filter at each place of the window: convolution becomes lookups and sums."""
        return [[self.embeddings @ k[j] for j in range(len(k))] for k in self.kernels]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased letter runs of all texts, one after another, and the number of words of each text."""
    split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}]+", " "))
    offsets = split.offsets.to_numpy(zero_copy_only=False)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    # an empty string is what is left of white space at either end
    buckets = np.array([1 + zlib.crc32(w.encode()) % (BUCKETS - 1) if w else PAD for w in coded.dictionary.to_pylist()] or [PAD], np.int64)
    words = buckets[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.int64)
    kept = words != PAD
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    return words[kept], np.diff(ends)


def padded(words: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with ``pad`` paddings after each text, and where each text starts."""
    ends = np.cumsum(counts)
    out = np.insert(words, np.repeat(ends, pad), PAD)
    return out, np.concatenate([[0], (ends + pad * np.arange(1, len(counts) + 1))[:-1]])


def features(model: Model, tables: list[list[np.ndarray]], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Maxima of all filters for each text."""
    widest = max(len(k) for k in model.kernels)
    ids, starts = padded(words, counts, widest)
    out = []
    for table, offset in zip(tables, model.offsets, strict=True):
        n = len(ids) - len(table) + 1
        total = table[0][ids[:n]]
        for j in range(1, len(table)):
            total += table[j][ids[j : n + j]]
            total[starts[1:] - j] = -np.inf  # such a window would reach into the next text
        out.append(np.maximum(np.maximum.reduceat(total, starts, axis=0) + offset, 0.0))
    return np.concatenate(out, axis=1)


def probabilities(model: Model, tables: list[list[np.ndarray]], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(counts), model.constant)
    logits = (features(model, tables, words, counts) @ model.weights + model.bias).astype(np.float64)
    return 1.0 / (1.0 + np.exp(-np.clip(model.slope * logits + model.shift, -40, 40)))


@dataclass
class Shard:
    """Hashed texts one after another, with the number of words, the label and the weight of each, and whether it is left out of the steps."""

    number: int
    words: np.ndarray
    counts: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    held: np.ndarray
    languages: list[str | None]

    def texts(self) -> list[np.ndarray]:
        return np.split(self.words, np.cumsum(self.counts)[:-1])


def constant(share: float, options: Options) -> Model:
    """A model that gives every text the same score."""
    model, _ = beginning(0.5, options)
    model.constant = share
    return model


def beginning(share: float, options: Options) -> tuple[Model, list[np.ndarray]]:
    """A model before its first step, and what its steps are divided by: squares of the gradients so far."""
    rng = np.random.default_rng(options.seed)
    d, f = options.dimensions, options.filters
    model = Model(
        embeddings=rng.normal(0, 0.1, (BUCKETS, d)).astype(np.float32),
        kernels=[rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)).astype(np.float32) for w in options.widths],
        offsets=[np.full(f, 0.05, np.float32) for _ in options.widths],
        weights=rng.normal(0, 0.3, f * len(options.widths)).astype(np.float32), bias=0.0,
    )
    model.bias = float(np.log(share / (1 - share)))
    return model, [np.full_like(x, 1e-6) for x in parts_of(model)]


def parts_of(model: Model) -> list[np.ndarray]:
    return [model.embeddings, *model.kernels, *model.offsets, model.weights, np.array([model.bias], np.float32)]


def moved(model: Model, parts: list[np.ndarray]) -> Model:
    """The model with other parts."""
    n = len(model.kernels)
    out = copy.copy(model)
    out.embeddings, out.kernels, out.offsets, out.weights, out.bias = parts[0], parts[1 : n + 1], parts[n + 1 : 2 * n + 1], parts[-2], float(parts[-1][0])
    return out


def epoch_moves(model: Model, squares: list[np.ndarray], shard: Shard, epoch: int, options: Options) -> list[np.ndarray] | None:
    """How one epoch over a shard moves the parts of a model and its squares; before them, how many shards saw each bucket, and 1."""
    used = np.flatnonzero(~shard.held)
    if not len(used):
        return None
    texts, toxic, weight = shard.texts(), shard.toxic, shard.weight
    start, f, d = parts_of(model), options.filters, options.dimensions
    squares_before, squares = squares, [x.copy() for x in squares]
    model = moved(model, [x.copy() for x in start])
    seen = np.zeros(BUCKETS, bool)
    for i in used:
        seen[texts[i]] = True
    seen[PAD] = False
    model.embeddings[~seen] = 0.0  # a word never seen says nothing
    bias_square = float(squares[-1][0])
    widest = max(options.widths)
    rate = options.rate * (1 - epoch / options.epochs)
    used = np.random.default_rng([options.seed, epoch, shard.number]).permutation(used)
    for at in range(0, len(used), options.batch):
        rows = used[at : at + options.batch]
        counts = np.array([len(texts[i]) for i in rows])
        ids, starts = padded(np.concatenate([texts[i] for i in rows]).astype(np.int64), counts, widest)
        stops = np.append(starts[1:], len(ids))
        vectors = model.embeddings[ids]
        best, peaks = [], []
        for k, o in zip(model.kernels, model.offsets, strict=True):
            n = len(ids) - len(k) + 1
            total = vectors[:n] @ k[0]
            for j in range(1, len(k)):
                total += vectors[j : n + j] @ k[j]
            place = np.stack([a + total[a : b - len(k) + 1].argmax(axis=0) for a, b in zip(starts, stops, strict=True)])
            best.append(place)
            peaks.append(total[place, np.arange(f)] + o)
        value = np.concatenate(peaks, axis=1)
        relu = np.maximum(value, 0)
        p = 1 / (1 + np.exp(-np.clip(relu @ model.weights + model.bias, -30, 30)))
        error = ((p - toxic[rows]) * weight[rows] / len(rows)).astype(np.float32)
        back = error[:, None] * model.weights * (value > 0)
        steps = {len(squares) - 2: relu.T @ error}
        touched, pulls = [], []
        for w, place in enumerate(best):
            own, k = back[:, w * f : (w + 1) * f], model.kernels[w]
            steps[1 + len(model.kernels) + w] = own.sum(axis=0)
            grad = np.zeros_like(k)
            for j in range(len(k)):
                under = ids[place + j]
                grad[j] = np.einsum("rfd,rf->df", model.embeddings[under], own)
                touched.append(under.ravel())
                pulls.append((own[:, :, None] * k[j].T[None]).reshape(-1, d))
            steps[1 + w] = grad
        at_rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        pull = np.zeros((len(at_rows), d), np.float32)
        np.add.at(pull, inverse, np.concatenate(pulls))
        pull[at_rows == PAD] = 0
        squares[0][at_rows] += pull**2
        model.embeddings[at_rows] -= rate * pull / np.sqrt(squares[0][at_rows])
        for name, x in enumerate((*model.kernels, *model.offsets, model.weights), start=1):
            squares[name] += steps[name] ** 2
            x -= rate * steps[name] / np.sqrt(squares[name])
        bias_square += float(error.sum()) ** 2
        model.bias -= rate * float(error.sum()) / np.sqrt(bias_square)
    squares[-1][0] = bias_square
    moves = [a - b for a, b in zip((*parts_of(model), *squares), (*start, *squares_before), strict=True)]
    for k in (0, len(start)):
        moves[k][~seen] = 0
    return [seen.astype(np.int64), np.ones(1, np.int64), *(x.astype(np.float64) for x in moves)]


def added(a: list[np.ndarray] | None, b: list[np.ndarray] | None) -> list[np.ndarray] | None:
    if a is None or b is None:
        return b if a is None else a
    return [x + y for x, y in zip(a, b, strict=True)]


def pieces_of(moves: list[np.ndarray] | None) -> list[tuple[int, list[np.ndarray]]]:
    """Moves cut along the buckets, and those of the small parts as a last piece."""
    if moves is None:
        return []
    seen, shards, *rest = moves
    table = len(rest) // 2
    wide = zip(*[np.array_split(x, PIECES) for x in (seen, rest[0], rest[table])], strict=True)
    small = [x for k, x in enumerate(rest) if k not in (0, table)]
    return [*enumerate(map(list, wide)), (PIECES, [shards, *small])]


def piece_row(number: int, parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"piece": pa.array([number], pa.int32()), "parts": pa.array([pickle.dumps(parts)], pa.binary())})


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pieces, added up one after another."""
    sums: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            sums[r["piece"]] = added(sums.get(r["piece"]), pickle.loads(r["parts"]))
    for number, parts in sums.items():
        yield piece_row(number, [x.astype(np.float32) for x in parts])


def whole_of(pieces: dict[int, list[np.ndarray]]) -> list[np.ndarray] | None:
    """What :func:`pieces_of` cut."""
    if not pieces:
        return None
    seen, embeddings, squares = (np.concatenate([pieces[i][k] for i in range(PIECES)]) for k in range(3))
    shards, *small = pieces[PIECES]
    half = len(small) // 2
    return [seen, shards, embeddings, *small[:half], squares, *small[half:]]


def averaged(model: Model, squares: list[np.ndarray], moves: list[np.ndarray], first: bool) -> tuple[Model, list[np.ndarray]]:
    """The model and its squares after the mean move of all shards; a bucket moves by the mean of the shards that saw it."""
    seen, shards, *moves = moves
    start = parts_of(model)
    out = []
    for k, (x, move) in enumerate(zip((*start, *squares), moves, strict=True)):
        by = np.maximum(seen, 1)[:, None] if k in (0, len(start)) else shards[0]
        out.append((x + move / by).astype(np.float32))
    if first:
        out[0][seen == 0] = 0.0  # no shard knows the word
    return moved(model, out[: len(start)]), out[len(start) :]


def held_logits(model: Model, shard: Shard, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Logits and rows of a shard that are left out of the steps, scored in pieces of about ``most`` words."""
    rows = np.flatnonzero(shard.held)
    texts, tables, out = shard.texts(), model.tables(), []
    sizes = np.cumsum(shard.counts[rows]) // most
    for piece in np.split(rows, np.flatnonzero(np.diff(sizes)) + 1) if len(rows) else []:
        p = probabilities(model, tables, np.concatenate([texts[i] for i in piece]).astype(np.int64), shard.counts[piece])
        out.append(np.log(np.clip(p, 1e-9, 1 - 1e-9) / np.clip(1 - p, 1e-9, 1)))
    return (np.concatenate(out) if out else np.zeros(0)), rows


def held_loss(model: Model, shard: Shard) -> float:
    """Weighted log loss."""
    logit, rows = held_logits(model, shard)
    p = np.clip(1 / (1 + np.exp(-logit)), 1e-6, 1 - 1e-6)
    return -float((shard.weight[rows] * np.where(shard.toxic[rows] == 1, np.log(p), np.log(1 - p))).sum())


def held_counts(model: Model, shard: Shard) -> list[tuple[tuple[str | None, int, float], float]]:
    """Weight of the left-out rows by language, label and logit, to two places."""
    logit, rows = held_logits(model, shard)
    return [((shard.languages[i], int(shard.toxic[i]), round(float(x), 2)), float(shard.weight[i])) for x, i in zip(logit, rows, strict=True)]


def learned(share: float, moves, loss, counts, options: Options) -> Model:
    """A trained model: ``moves(model, squares, epoch)``, ``loss(model)`` and ``counts(model)`` bring together what all shards give."""
    if not 0 < share < 1:
        return constant(share, options)
    model, squares = beginning(share, options)
    best_loss, kept = np.inf, None
    for epoch in range(options.epochs):
        found = moves(model, squares, epoch)
        if found is None:
            break
        model, squares = averaged(model, squares, found, epoch == 0)
        now = loss(model)
        if now < best_loss or kept is None:  # the best epoch stays, so steps that go astray do no harm
            best_loss, kept = now, model
    model = copy.copy(kept or model)
    model.by_language = {}
    found = counts(model)
    if found:
        keys, weight = zip(*sorted(found, key=repr), strict=True)
        calibrate(model, np.array([k[2] for k in keys]), np.array([k[1] for k in keys], float), np.array(weight), [k[0] for k in keys])
    return model


def fit(texts: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray, languages: list[str | None], options: Options = Options()) -> Model:
    """Trains on hashed texts here, as one shard."""
    if len(texts) == 0:
        return constant(0.5, options)
    order = np.random.default_rng(options.seed).permutation(len(texts))
    held = np.zeros(len(texts), bool)
    held[order[: int(len(order) * options.held)]] = True
    shard = Shard(0, np.concatenate(texts), np.array([len(t) for t in texts]), toxic, weight, held, languages)
    return learned(
        float((weight * toxic).sum() / weight.sum()), lambda m, s, e: epoch_moves(m, s, shard, e, options), lambda m: held_loss(m, shard),
        lambda m: held_counts(m, shard), options,
    )


def calibrate(model: Model, logit: np.ndarray, toxic: np.ndarray, weight: np.ndarray, languages: list[str | None], least: int = 20) -> None:
    """Fits a logistic curve to the scores of left-out rows, then sets a threshold for all and one for each language.

    A threshold makes F1 largest; a language with less than ``least`` rows of either label uses the one for all.
    """
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps with a little shrinkage towards the identity
        q = 1 / (1 + np.exp(-np.clip(slope * logit + shift, -30, 30)))
        e, h = (q - toxic) * weight, q * (1 - q) * weight + 1e-9
        g = np.array([(e * logit).sum() + (slope - 1), e.sum() + shift * 0.1])
        m = np.array([[(h * logit**2).sum() + 1, (h * logit).sum()], [(h * logit).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(m, g)
        slope, shift = slope - step[0], shift - step[1]
    if slope > 0:
        model.slope, model.shift = float(slope), float(shift)
    score = 1 / (1 + np.exp(-np.clip(model.slope * logit + model.shift, -40, 40)))
    model.threshold = best_threshold(score, toxic, weight)
    for language in sorted({x for x in languages if x is not None}):
        own = np.array([x == language for x in languages])
        if min((toxic * weight)[own].sum(), ((1 - toxic) * weight)[own].sum()) >= least:
            model.by_language[language] = best_threshold(score[own], toxic[own], weight[own])


def best_threshold(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the gap at which F1 is largest."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum((toxic * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (toxic * weight).sum())
    last = np.append(s[1:] < s[:-1], True)  # equal scores are cut together
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, options: Options = Options()) -> Model:
    """Learns ``labels`` (doc_id, toxic) over ``docs`` (doc_id, text, lang). ``usable`` limits the rows learned from.

    Every labelled row takes part. A shard holds about ``options.shard_rows`` rows, as two bytes a word; moves of models are added in tasks.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.select("doc_id", F.col("toxic").cast("int").alias("_toxic"))
    language = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    n_known = known.count()
    n_shards = max(1, -(-n_known // options.shard_rows))
    rows = docs.select("doc_id", language.alias("lang"), text_of().alias("text"))
    rows = rows.join(F.broadcast(known) if n_known <= SENT_IDS else known, "doc_id")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            words, counts = hashed_words(batch.column("text"))
            cuts = np.cumsum(counts)
            packed = [words[b - n : b].astype("<u2").tobytes() for b, n in zip(cuts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang"), batch.column("_toxic"), pa.array(packed, pa.binary())],
                ["doc_id", "lang", "toxic", "words"],
            )

    hashed = rows.mapInArrow(hashes, "doc_id long, lang string, toxic int, words binary").withColumns(
        {
            "shard": F.pmod(F.xxhash64("doc_id", F.lit(options.seed)), F.lit(n_shards)).cast("int"),
            "held": F.pmod(F.xxhash64(F.lit(options.seed), "doc_id"), F.lit(1000)) < int(options.held * 1000),
        }
    )

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["doc_id"], r["toxic"], r["words"]))
        out = {
            "shard": [rows[0]["shard"]], "words": [b"".join(r["words"] for r in rows)], "sizes": [[len(r["words"]) // 2 for r in rows]],
            "toxic": [[r["toxic"] for r in rows]], "held": [[r["held"] for r in rows]], "langs": [[r["lang"] for r in rows]],
        }
        return pa.table(out, schema=pa.schema(
            {"shard": pa.int32(), "words": pa.binary(), "sizes": pa.list_(pa.int32()), "toxic": pa.list_(pa.int32()), "held": pa.list_(pa.bool_()), "langs": pa.list_(pa.string())}
        ))

    packed = "shard int, words binary, sizes array<int>, toxic array<int>, held array<boolean>, langs array<string>"
    # one row a shard, in a file of its own, which every epoch reads again
    with setting(spark, "spark.sql.files.maxRecordsPerFile", "1"):
        shards = stored(hashed.groupBy("shard").applyInArrow(pack, packed), "toxicity-shards")
    totals = shards.select(F.explode("toxic").alias("t")).agg(F.count("t").alias("n"), F.sum("t").alias("hit")).first()
    if not totals["n"]:
        return constant(0.5, options)

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for batch in batches:
            for r in batch.to_pylist():
                yield Shard(r["shard"], np.frombuffer(r["words"], "<u2"), np.array(r["sizes"]), np.array(r["toxic"], float), np.ones(len(r["sizes"])), np.array(r["held"], bool), r["langs"])

    @contextmanager
    def sent(value) -> Iterator:
        """``value`` in every task, while a file is a task and a batch is one shard or piece."""
        shared = spark.sparkContext.broadcast(value)
        try:
            with setting(spark, BATCH_ROWS, "1"), setting(spark, FILE_COST, spark.conf.get("spark.sql.files.maxPartitionBytes")):
                yield shared
        finally:
            shared.destroy()
            released(spark)  # what was shuffled meanwhile

    def moves(model: Model, squares: list[np.ndarray], epoch: int) -> list[np.ndarray] | None:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for shard in shards_of(batches):
                total = added(total, epoch_moves(*shared.value, shard, epoch, options))
            for number, parts in pieces_of(total):
                yield piece_row(number, parts)

        with sent((model, squares)) as shared:
            cut = shards.mapInArrow(step, PIECE_ROW).repartition(PIECES, "piece").mapInArrow(summed, PIECE_ROW)
            return whole_of({r["piece"]: pickle.loads(r["parts"]) for r in cut.collect()})

    def loss(model: Model) -> float:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in shards_of(batches):
                yield pa.RecordBatch.from_pydict({"loss": [held_loss(shared.value, shard)]})

        with sent(model) as shared:
            return math.fsum(r["loss"] for r in shards.mapInArrow(run, "loss double").collect())

    def counts(model: Model) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in shards_of(batches):
                rows = [{"lang": k[0], "toxic": k[1], "logit": k[2], "weight": w} for k, w in held_counts(shared.value, shard)]
                yield pa.RecordBatch.from_pylist(rows, schema=COUNTED)

        with sent(model) as shared:
            found = shards.mapInArrow(run, "lang string, toxic int, logit double, weight double").groupBy("lang", "toxic", "logit").agg(F.sum("weight").alias("weight"))
            return [((r["lang"], r["toxic"], r["logit"]), r["weight"]) for r in found.collect()]

    return learned(totals["hit"] / totals["n"], moves, loss, counts, options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``threshold`` of the row's language and ``flagged`` (score >= threshold)."""
    docs = docs.drop("score", "threshold", "flagged", "_text")
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the embedding table
    schema = schema_with(docs, "score", T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = own.tables() if own.constant is None else []
        for batch in blocks(batches, "_text", 1 << 20):
            words, counts = hashed_words(batch.column("_text"))
            values = pa.array(probabilities(own, tables, words, counts).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, "score"])

    out = docs.withColumn("_text", text_of()).mapInArrow(run, schema)
    pairs = [x for k, v in model.by_language.items() for x in (F.lit(k), F.lit(v))]
    known = F.element_at(F.create_map(*pairs), F.col("lang")) if pairs and "lang" in names else F.lit(None)
    out = out.withColumn("threshold", F.coalesce(known, F.lit(model.threshold)))
    return out.withColumn("flagged", F.col("score") >= F.col("threshold"))


def remove_toxic(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> DataFrame:
    """The documents that stay below the threshold of their language."""
    return score(docs, train(docs, labels, options=options)).where(~F.col("flagged")).select(*docs.columns)
