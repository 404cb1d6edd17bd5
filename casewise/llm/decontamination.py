"""Benchmark decontamination by a positional inverted index. DataFrame operations only.

An index holds one posting (term, document, position) for each occurrence of an indexed term. A window is ``width`` consecutive
words of a benchmark item (the whole item if it is shorter). For each distinct window the two rarest of its terms in the corpus
are looked up; a posting's position less the term's offset in the window is where the window would start, and starts found
by both terms are candidates, which are then compared word by word. Only terms that some window needs are indexed.

A null text has no words. Rows with equal id and text share their postings and get equal results; a null id is kept. Items
without words have no windows; a null item id can hit words but is not listed. Empty tables give no hits or no rows. Columns of the
input with the name of a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casewise.llm.common import settled, stored

#: What separates words, after lower-casing A-Z; fixed value.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ("n_words", "n_hit", "n_items", "items", "contaminated")


def word_list(text: str = "text") -> Column:
    """The words of a text; an empty list for null. Letters beyond A-Z keep their case."""
    plain = F.char_length(text) == F.octet_length(text)  # then lower() changes A-Z only, and is much faster
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(F.col(text), UPPER, LOWER))
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), lambda w: w != "")


def keyed(docs: DataFrame) -> DataFrame:
    """Two columns that tell documents apart: ``_d`` from the id and ``_h`` from id and text."""
    return docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": F.xxhash64("doc_id", "text")})


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """Every window of every item: item_id, phrase (its words joined by spaces, which no word holds), words."""
    words = items.select("item_id", word_list().alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))).alias("at")
    cut = words.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("at"), F.lit(width)).alias("words"))
    return cut.select("item_id", F.array_join("words", " ").alias("phrase"), "words").distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of ``terms`` (term) occurs in all documents; terms that never occur are left out."""
    tokens = docs.select(F.explode(word_list()).alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The inverted index of ``terms`` (term): term, _d, _h, pos (from 0)."""
    tokens = keyed(docs).select("_d", "_h", F.posexplode(word_list()).alias("pos", "term"))
    return tokens.join(terms, "term", "left_semi").select("term", "_d", "_h", "pos")


def rarest_terms(windows: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """For each distinct window its ``most`` rarest words: phrase, n_words, term, offset, place (0 for the rarest).

    Windows with a word that the corpus lacks can't occur and are left out.
    """
    words = windows.select("phrase", "words").distinct().select("phrase", F.size("words").alias("n_words"), F.posexplode("words").alias("offset", "term"))
    counted = words.join(counts, "term")
    all_of = Window.partitionBy("phrase")  # a window has few words
    ranked = counted.withColumns(
        {"known": F.count("*").over(all_of), "place": F.row_number().over(all_of.orderBy("n", "term", "offset")) - 1}
    )
    return ranked.where((F.col("known") == F.col("n_words")) & (F.col("place") < most)).select("phrase", "n_words", "term", "offset", "place")


class PhraseIndex:
    """The corpus index for one benchmark; tables are written to the shared folder, so lost executors cost no rebuild."""

    def __init__(self, docs: DataFrame, items: DataFrame, width: int = 10, terms: int = 2) -> None:
        self.docs = docs.select("doc_id", "text")
        self.windows = stored(item_windows(items, width), "windows")
        vocabulary = stored(self.windows.select(F.explode("words").alias("term")).distinct(), "terms")
        counts = stored(term_counts(self.docs, vocabulary), "term-counts")
        self.anchors = stored(rarest_terms(self.windows, counts, terms), "anchors")
        needed = stored(self.anchors.select("term").distinct(), "anchor-terms")
        self.index = stored(postings(self.docs, needed), "postings")

    def starts(self, place: int) -> DataFrame:
        """Where each window would start by its word of that rarity."""
        own = self.anchors.where(F.col("place") == place)
        at = F.col("pos") - F.col("offset")
        return self.index.join(own, "term").select("_d", "_h", "phrase", "n_words", at.alias("start")).where("start >= 0")

    def matches(self) -> DataFrame:
        """Exact occurrences: _d, _h, phrase, start, n_words."""
        first, second = self.starts(0), self.starts(1).select("_d", "_h", "phrase", "start")
        both = first.where("n_words > 1").join(second, ["_d", "_h", "phrase", "start"], "left_semi")
        found = stored(both.unionByName(first.where("n_words = 1")).distinct(), "candidates")
        keys = stored(found.select("_d", "_h").distinct(), "candidate-documents")
        texts = keyed(self.docs).join(keys, ["_d", "_h"], "left_semi").select("_d", "_h", word_list().alias("_w")).distinct()
        same = F.array_join(F.slice("_w", F.col("start") + 1, F.col("n_words")), " ") == F.col("phrase")
        return found.join(texts, ["_d", "_h"]).where(same).select("_d", "_h", "phrase", "start", "n_words")

    def near(self, slop: int = 20) -> DataFrame:
        """Proximity matches: places where all indexed terms of a window occur within ``slop`` words of its rarest one.

        Rows: _d, _h, phrase, pos. Positions are joined by blocks of ``slop`` words, so only neighbours meet.
        """
        block = lambda c: F.floor(F.col(c) / slop)
        terms = self.anchors.groupBy("phrase").agg(F.count_distinct("term").alias("_terms"))
        rare = self.index.join(self.anchors.where("place = 0"), "term").select("_d", "_h", "phrase", F.col("pos").alias("at"))
        rare = rare.withColumn("_b", F.explode(F.array(block("at") - 1, block("at"), block("at") + 1)))
        others = self.index.join(self.anchors.select("phrase", "term").distinct(), "term").withColumn("_b", block("pos"))
        close = rare.join(others, ["_d", "_h", "phrase", "_b"]).where(F.abs(F.col("pos") - F.col("at")) <= slop)
        full = close.groupBy("_d", "_h", "phrase", "at").agg(F.count_distinct("term").alias("_n")).join(terms, "phrase")
        return full.where("_n = _terms").select("_d", "_h", "phrase", F.col("at").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence of a window), n_items, items (ids as strings, sorted), contaminated."""
    docs = docs.drop(*RESULTS, "_d", "_h")
    result = settled(docs.sparkSession, "contamination", lambda: hit_documents(docs, items, width))
    out = keyed(docs).withColumn("n_words", F.size(word_list()).cast("long")).join(result, ["_d", "_h"], "left").drop("_d", "_h")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", none),
            "n_items": F.size(F.coalesce("items", none)).cast("long"), "contaminated": F.coalesce("n_hit", F.lit(0)) > 0,
        }
    )


def hit_documents(docs: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """_d, _h, n_hit and items of the documents that hold a window."""
    index = PhraseIndex(docs, items, width)
    found = stored(index.matches(), "matches")
    covered = F.explode(F.sequence("start", F.col("start") + F.col("n_words") - 1)).alias("pos")
    hit = found.select("_d", "_h", covered).distinct().groupBy("_d", "_h").agg(F.count("*").alias("n_hit"))
    named = found.select("_d", "_h", "phrase").join(index.windows.select("phrase", F.col("item_id").cast("string")), "phrase")
    named = named.select("_d", "_h", "item_id").distinct().groupBy("_d", "_h").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return hit.join(named, ["_d", "_h"], "left")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents that hold no window of any item, with their own columns."""
    docs_only = docs.select("doc_id", "text")
    bad = settled(docs.sparkSession, "contaminated", lambda: hit_documents(docs_only, items, width).select("_d", "_h"))
    return keyed(docs.drop("_d", "_h")).join(bad, ["_d", "_h"], "left_anti").select(*docs.columns)
