"""Token ids as Parquet list columns, laid out for selective reads.

``write_tokens`` orders documents by id, encodes them, and writes one row per document: its id, the number of its tokens, their
offset in the part, and the ids as a list column. Parts are consecutive ranges of documents, so with the sum of each part the
position of every document among all ids is known without reading any list. Encoding (dictionary or delta), size of row
groups and size of pages are chosen by the caller; Parquet's column and page indexes let a reader fetch single documents or
only the small columns.

A null text counts as empty and holds just the end id. Documents with equal or null ids are kept, ordered by id (null
first), then by the hash of their text; equal rows are interchangeable. No documents give no rows. Other columns are not stored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from casewise.functions.scratch import scratch_dir
from casewise.llm.common import blocks, schema_with, text_of

VOCABULARY = "word_bpe_49k.json"
STORED = "doc_id long, n_tokens long, part int, part_offset long, ids array<int>"

#: An ASCII letter or digit, ASCII punctuation without apostrophes, white space: the tokenizer cuts before and after such punctuation anyway.
TAIL = r"([a-z0-9])([!-&(-/:-@\[-`{-~]+)(\s|$)"

_encoders: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Encodes texts word by word, each distinct word of a batch once.

    Fits tokenizers that never join across ASCII white space and ignore ASCII case, as the word-end BPE does; a test compares it with
    encoding whole texts. Two generations of words are remembered, ``keep`` in each, so frequent words stay and memory is bounded.
    Added tokens match raw text, so texts that may hold one, in any case of letters, are encoded whole and unchanged.
    """

    def __init__(self, vocabulary: str, end_id: int, keep: int = 300_000) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if os.sep not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end, self.keep = array("I", [end_id]).tobytes(), keep
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each of the distinct words."""
        out: list[bytes] = [b""] * len(words)
        missing = []
        for i, word in enumerate(words):
            found = self.young.get(word)
            if found is None:
                found = self.old.get(word)
                if found is None:
                    missing.append(i)
                    continue
                self.young[word] = found
            out[i] = found
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = self.young[words[i]] = array("I", e.ids).tobytes()
            if len(self.young) > self.keep:
                self.old, self.young = self.young, {}
        return out

    def marked(self, texts: pa.Array) -> np.ndarray:
        """Whether each text holds what all added tokens start with."""
        if not self.markers:
            return np.zeros(len(texts), bool)
        start = os.path.commonprefix([m.lower() for m in self.markers])
        found = pc.match_substring(texts, start, ignore_case=start != start.upper())
        return found.to_numpy(zero_copy_only=False).astype(bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each followed by the end id, and the number of ids of each text."""
        marked = self.marked(texts)
        whole = [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts.filter(pa.array(marked)).to_pylist()]
        if whole:
            texts = pc.if_else(pa.array(marked), "", texts)
        # punctuation at the end of a word becomes a word of its own, which leaves far fewer distinct words
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), TAIL, r"\1 \2\3"))
        offsets = split.offsets.to_numpy(zero_copy_only=False)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        blobs = [*self.word_ids(coded.dictionary.to_pylist()), *whole, self.end]
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(blobs), "<u4")
        # after the words of a text come its ids as a whole, if it is marked, and the end id
        extra = 1 + marked
        added = np.full(extra.sum(), len(blobs) - 1)
        added[(np.cumsum(extra) - 2)[marked]] = len(blobs) - 1 - len(whole) + np.arange(len(whole))
        order = np.insert(coded.indices.to_numpy(zero_copy_only=False), np.repeat(offsets[1:] - offsets[0], extra), added)
        n = lengths[order]
        ends = np.cumsum(n)
        take = np.arange(ends[-1]) + np.repeat(starts[order] - (ends - n), n)
        last = offsets[1:] - offsets[0] + np.cumsum(extra) - 1
        return ids[take], np.diff(ends[last], prepend=0)


def encoder(vocabulary: str, end_id: int) -> WordEncoder:
    """One per Python worker."""
    key = (vocabulary, end_id)
    if key not in _encoders:
        _encoders[key] = WordEncoder(vocabulary, end_id)
    return _encoders[key]


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = 1, encoding: str = "dictionary",
    row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000, partitions: int | None = None,
) -> None:
    """Writes the documents' ids below ``path``, in ascending order of ``doc_id``.

    ``vocabulary`` is a file, or the name of a public tokenizer. ``encoding`` is ``dictionary`` (falling back to delta in a column
    chunk whose dictionary grows too large) or ``delta``. Texts are moved, not ids: they are shorter than their ids.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    keys = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    rows = rows.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, offset = encoder(vocabulary, end_id), 0
        for batch in blocks(batches, "text", 8 << 20):
            ids, n = words.encode(batch.column("text"))
            ends = np.cumsum(n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.view("<i4")))
            before = pa.array(offset + ends - n)
            offset += int(ends[-1])
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n), batch.column("part"), before, lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "part", "part_offset", "ids"])

    options = {
        "compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows,
    }
    rows.mapInArrow(encode, STORED).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, part, part_offset, ids. Columns that aren't used aren't read."""
    stored = spark.read.schema(STORED).parquet(path)
    return stored.join(part_starts(stored), "part").withColumn("start", F.col("_before") + F.col("part_offset")).drop("_before")


def part_starts(stored: DataFrame) -> DataFrame:
    """Number of ids before each part: (part, _before)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_before"))


def token_slice(start: int, length: int) -> Column:
    """Part of the column ``ids``: ``length`` ids from the 0-based ``start``."""
    return F.slice("ids", start + 1, length)


def token_range(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """The ids from position ``start`` of the whole stream, as one row for each document they touch; lists of others stay unread."""
    rows = read_tokens(spark, path)
    end = start + length
    rows = rows.where((F.col("start") < end) & (F.col("start") + F.col("n_tokens") > start))
    first = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    last = F.least(F.lit(end) - F.col("start"), F.col("n_tokens")).cast("int")
    return rows.select("doc_id", (F.col("start") + first).alias("start"), F.slice("ids", first + 1, last - first).alias("ids"))


def checksums(tokens: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, the crc32 of the ids as little-endian 32-bit integers."""
    keep = [c for c in tokens.columns if c not in ("ids", "ids_crc32")]
    schema = schema_with(tokens.select(*keep), "ids_crc32", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy(zero_copy_only=False)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    return tokens.select(*keep, "ids").mapInArrow(run, schema)


def token_digest(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the token files, by default in the working folder, and describes each document from what they hold."""
    spark = docs.sparkSession
    path = path or scratch_dir(spark, "tokens") + "/table"
    write_tokens(docs, path, **options)
    stored = spark.read.schema(STORED).parquet(path)
    rows = checksums(stored).join(part_starts(stored), "part")
    return rows.select("doc_id", (F.col("_before") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32")
