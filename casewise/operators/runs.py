"""Contiguous runs of every length under fixed-size names.

The run of ``2^(k+1)`` activities that ends at an event is named by the names of its two halves of ``2^k``, and any other length by the names
of two such runs that overlap: one that ends with the run and one that begins with it. A name is a pair of 64-bit hashes, whatever the length, so
no name carries an array of its past. Names of powers take ``log2(longest)`` columns, looked up by position inside the case; runs of one length take one row per event, runs
of all lengths one small row each, which is as many as there are runs. These are made where the events of a case already lie, and first shuffled when they are counted.

Cases with equal activities have equal runs, so counts are taken on one case of each kind (:func:`variants`), weighted by their number.

What follows runs (:func:`next_counts`) is counted without naming every run: a run that nothing but its own longer forms contains is not told apart from them.

Equal runs have equal names; different ones share a name by chance only, at about the square of their number in 2^128.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewise.functions.scratch import written
from casewise.operators.describe import share_spread
from casewise.operators.positions import case_lookback, case_order, case_parts, positioned, split_of

NAME = "struct<a:bigint,b:bigint>"
#: activities up to which what follows a run is counted in one column each
NARROW_ALPHABET = 16
#: bits of the nearest activities by which the first round of counting what follows is parted
NEAR_BITS = 18
#: packed words that a later round compares at most
MOST_WORDS = 16


def _pair(*parts: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *reversed(parts)).alias("b"))


def _earlier(rows: DataFrame, name: str, back: int, of: DataFrame | None = None) -> DataFrame:
    """``_e``: the value of a column ``back`` positions earlier in the case (later, if negative), null outside the case.

    ``of``: rows of the same cases that hold the column too; with it several lookups in long cases don't join what earlier ones joined.
    """
    if not split_of(rows):
        return rows.withColumn("_e", F.lag(name, back).over(Window.partitionBy("case_id").orderBy(*case_order(rows))))
    # pieces of long cases: by position, so that no task holds a whole case
    there = (rows if of is None else of).select("case_id", (F.col("pos") + back).alias("pos"), F.col(name).alias("_e"))
    return rows.join(there, ["case_id", "pos"], "left")


def power_names(log: DataFrame, longest: int) -> tuple[DataFrame, int]:
    """Events with ``_p0, _p1, ...``: names of the runs of 1, 2, 4, ... up to ``longest`` activities that end there; and how many columns."""
    rows = positioned(log).withColumn("_p0", _pair(F.col("activity")))
    k = 0
    while 2 << k <= longest:
        rows = _earlier(rows, f"_p{k}", 1 << k).withColumn(f"_p{k + 1}", F.when(F.col("_e").isNotNull(), _pair(F.lit(k), F.col("_e"), F.col(f"_p{k}")))).drop("_e")
        k += 1
    return rows, k + 1


def longest_case(log: DataFrame) -> int:
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def runs_of(log: DataFrame, length: int) -> DataFrame:
    """(case_id, pos, activity, name) of the runs of one length, at their last event; one row per event that ends one."""
    if length < 1:
        raise ValueError("a run has at least one activity")
    k = length.bit_length() - 1
    rows, _ = power_names(log, length)
    rows = _earlier(rows, f"_p{k}", length - (1 << k)) if length > 1 << k else rows.withColumn("_e", F.col(f"_p{k}"))
    return rows.filter(F.col("_e").isNotNull() & (F.col("pos") >= length - 1)).select(
        "case_id", "pos", "activity", _pair(F.lit(length), F.col("_e"), F.col(f"_p{k}")).alias("name")
    )


def variants(log: DataFrame) -> DataFrame:
    """The positioned events of one case of each sequence of activities, with ``weight``: how many cases have that sequence.

    Sequences are told apart by their length and two 64-bit fingerprints, so cases of any length are compared in constant space.
    """
    rows = positioned(log)
    prints = {
        "_a": F.bit_xor(F.xxhash64(F.lit(3), F.col("pos"), F.col("activity"))),
        "_b": F.bit_xor(F.xxhash64(F.lit(4), F.col("activity"), F.col("pos"))),
    }
    cases = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(n) for n, c in prints.items()])
    kinds = cases.groupBy("_n", *prints).agg(F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("weight"))
    return rows.join(kinds.select("case_id", "weight"), "case_id")


def _dealt_variants(log: DataFrame) -> DataFrame:
    """:func:`variants`, written and dealt to as many tasks as shuffles have: few events make many runs, which their bytes don't show."""
    rows = written(variants(log), "variants")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *case_parts(rows))


def all_runs(log: DataFrame, max_len: int | None = None, min_len: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, pos, len, name) of the runs of ``min_len..max_len`` (by default all lengths), at their last event, with its columns ``keep``.

    An event sees the names of 2^k of the 2^k events up to it: they begin the runs of 2^k to 2^(k+1) - 1 activities, and its own one ends them.
    """
    longest = longest_case(log) if max_len is None else max_len
    rows, powers = power_names(log, max(longest, 1))
    for k in range(powers):
        rows = case_lookback(rows, f"_p{k}", max(min((1 << k) - 1, longest - (1 << k)), 0), f"_q{k}", inclusive=True)

    def ending(k: int) -> Column:
        begins = F.filter(f"_q{k}", lambda q: q.isNotNull())

        def one(q: Column, i: Column) -> Column:
            length = (F.size(f"_q{k}") - 1 - i + F.lit(1 << k)).cast("int")
            return F.struct(length.alias("len"), _pair(length, q, F.col(f"_p{k}")).alias("name"))

        # runs that would begin before the case have no name; they come first, so places are counted from the end
        missing = F.size(f"_q{k}") - F.size(begins)
        return F.transform(begins, lambda q, i: one(q, i + missing))

    found = rows.select("case_id", "pos", *keep, F.explode(F.concat(*[ending(k) for k in range(powers)])).alias("_run"))
    found = found.select("case_id", "pos", *keep, "_run.len", "_run.name")
    return found.filter(F.col("len").between(min_len, longest))


def run_counts(runs: DataFrame) -> DataFrame:
    """(len, name, frequency, example): how often each run occurs, and the case and position of one occurrence."""
    times = F.sum("weight") if "weight" in runs.columns else F.count(F.lit(1))
    return runs.groupBy("len", "name").agg(times.alias("frequency"), F.min(F.struct("case_id", "pos")).alias("example"))


def distinct_runs_by_length(log: DataFrame, max_len: int | None = None) -> DataFrame:
    """(len, runs, distinct, most): runs, different ones, and how often the most frequent occurs."""
    counts = run_counts(all_runs(_dealt_variants(log), max_len, keep=("weight",)))
    return counts.groupBy("len").agg(F.sum("frequency").alias("runs"), F.count(F.lit(1)).alias("distinct"), F.max("frequency").alias("most"))


def _packed(rows: DataFrame, bits: int, places: int) -> DataFrame:
    """``_w0``: the codes of the last ``places`` activities up to an event, ``bits`` each, the event's own one in the highest bits, 0 before the case."""
    if split_of(rows):
        # pieces of long cases: one carry instead of a join for each place
        rows = case_lookback(rows, "activity", places - 1, "_s", inclusive=True)
        code = lambda c: F.shiftleft(c.cast("bigint"), 63 - bits)
        word = F.aggregate("_s", F.lit(0).cast("bigint"), lambda w, c: F.shiftright(w, bits).bitwiseOR(code(c)))
        return rows.withColumn("_w0", _first_places(word, F.lit(places), bits)).drop("_s")
    step = math.isqrt(places - 1) + 1
    rows = rows.withColumn("_w0", F.shiftleft(F.col("activity").cast("bigint"), 63 - bits))
    for width, n in ((1, step), (step, -(-places // step))):
        for i in range(1, n):
            rows = _earlier(rows, "_w0", i * width).withColumnRenamed("_e", f"_s{i}")
        parts = [F.shiftright(F.coalesce(f"_s{i}", F.lit(0)), bits * i * width) for i in range(1, n)]
        rows = rows.withColumn("_w0", reduce(Column.bitwiseOR, parts, F.col("_w0"))).drop(*[f"_s{i}" for i in range(1, n)])
    return rows.withColumn("_w0", _first_places(F.col("_w0"), F.lit(places), bits))


def _first_places(word: Column, n: Column, bits: int) -> Column:
    """A packed word with 0 behind its first ``n`` places."""
    return word.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.lit(63) - n * bits).cast("int")))


def _with_shared(rows: DataFrame, words: list[str], along: Window, bits: int, places: int, least: int) -> DataFrame:
    """``_shared``: in how many first places the words of a row agree with those of the one before or after it; ``least``, if there is none."""
    sides = {"_p": 1, "_s": -1}
    rows = rows.withColumns({f"{s}{j}": F.col(w).bitwiseXOR(F.lag(w, n).over(along)) for s, n in sides.items() for j, w in enumerate(words)})
    last, steps = len(words) - 1, {}
    for s in sides:
        first, whole = F.col(f"{s}{last}"), F.lit(last)
        for j in reversed(range(last)):
            first, whole = F.when(F.col(f"{s}{j}") != 0, F.col(f"{s}{j}")).otherwise(first), F.when(F.col(f"{s}{j}") != 0, j).otherwise(whole)
        steps |= {f"{s}first": first, f"{s}whole": whole}
    rows = rows.withColumns(steps)
    both = []
    for s in sides:
        equal = F.floor((63 - F.length(F.bin(f"{s}first"))) / bits).cast("int")
        both.append(F.when(F.col(f"{s}first").isNotNull(), F.col(f"{s}whole") * places + F.when(F.col(f"{s}first") == 0, places).otherwise(equal)))
    made = [*steps, *[f"{s}{j}" for s in sides for j in range(len(words))]]
    return rows.withColumn("_shared", F.greatest(*both, F.lit(least))).drop(*made)


class _Followed:
    """What follows the runs of a log, worked out by rounds of growing length.

    Positions carry what precedes them as packed words, nearest activity first. In a round positions with equal words are one row, and rows are sorted:
    a run of more activities than a row shares with both neighbours occurs in this row only, with the same counts up to the end of its words, so one row stands
    for these lengths. Shorter runs are counted length by length. Positions alone in their row are done to the start of their case; those
    that share all words and have earlier activities go on to the next round, which looks further back, under the name of what they share.
    """

    def __init__(self, log: DataFrame, max_len: int | None, min_len: int) -> None:
        few = [r[0] for r in log.select("activity").distinct().limit(NARROW_ALPHABET + 1).collect()]
        self.narrow = 0 < len(few) <= NARROW_ALPHABET
        activity = F.col("activity")
        if self.narrow:
            code = reduce(lambda rest, i: F.when(activity.eqNullSafe(F.lit(few[i])), i + 1).otherwise(rest), range(len(few)), F.lit(0))
            coded, size = log.withColumn("activity", code), len(few)
            self.few, self.by, self.sums = few, [], [f"_n{i}" for i in range(size)]
        else:
            place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("activity"))
            self.codes = written(log.select("activity").distinct().select(F.col("activity").alias("_text"), place.alias("_code")), "codes")
            coded = log.join(self.codes, F.col("activity").eqNullSafe(F.col("_text"))).withColumn("activity", F.col("_code")).drop("_text", "_code")
            size, self.by, self.sums = self.codes.count(), ["_next"], ["_n0"]
        self.bits = max(size.bit_length(), 1)
        self.places = 63 // self.bits
        self.longest, self.shortest = max_len, min_len
        kept = [c for c in ("case_id", "activity", "seq", "chunk", "pos", "split") if c in coded.columns]
        rows = variants(coded.select(*kept))
        rows = written(rows, "variants") if split_of(rows) else rows
        rows = _earlier(_packed(rows, self.bits, self.places), "activity", -1, rows).withColumnRenamed("_e", "_next")
        self.events = written(rows.filter("_next is not null").select(*case_parts(rows), "pos", "weight", "_next", "_w0"), "followed")

    def rounds(self) -> DataFrame:
        """(len, upto, name, counts): the parts of all rounds, not yet added up."""
        rows, keys, below, many, found = self.events, [], 0, 1, []
        while True:
            words = [f"_w{j}" for j in range(many)]
            upto = below + many * self.places
            kinds = self._kinds(rows, keys, words, below, upto)
            found += self._parts(kinds, keys, words, below, upto)
            ongoing = kinds.filter("_more and _rows > 1").select(*keys, *words).distinct()
            if (self.longest is not None and upto >= self.longest) or ongoing.isEmpty():
                return reduce(DataFrame.unionByName, found)
            left = rows.filter(F.col("pos") >= upto).join(ongoing, [*keys, *words], "left_semi")
            name = _pair(F.lit(upto), *[F.col(c) for c in (*keys, *words)]).alias("_g")
            left = written(left.select("case_id", "pos", "weight", "_next", name), "ongoing")
            keys, below, many = ["_g"], upto, min(4 * many, MOST_WORDS)
            rows = written(left.join(self._further(left, below, many), ["case_id", "pos"]), "further")

    def _further(self, left: DataFrame, below: int, many: int) -> DataFrame:
        """The words that begin ``below`` activities before the positions of the cases of ``left``."""
        rows = words = self.events.drop("weight", "_next").join(left.select("case_id").distinct(), "case_id", "left_semi")
        for j in range(1, many):
            rows = _earlier(rows, "_w0", j * self.places, words).withColumn(f"_w{j}", F.coalesce("_e", F.lit(0).cast("bigint"))).drop("_e")
        return rows.select("case_id", (F.col("pos") + below).alias("pos"), *[f"_w{j}" for j in range(many)])

    def _near(self, below: int) -> int:
        """Lengths up to which the first round adds up before it compares neighbours: so many begin alike that they part the work evenly."""
        return 0 if below else max(NEAR_BITS // self.bits, 1)

    def _kinds(self, rows: DataFrame, keys: list[str], words: list[str], below: int, upto: int) -> DataFrame:
        """Positions with equal words, and how many places their row shares with a neighbour (``_shared``)."""
        same = [*keys, *words, "_more"]
        rows = rows.withColumns({"_more": F.col("pos") >= upto, "_len": F.col("pos") + 1})
        size = [F.count(F.lit(1)).alias("_rows"), F.max("_len").alias("_len")]
        if self.narrow:
            counted = [F.sum(F.when(F.col("_next") == i + 1, F.col("weight")).otherwise(0)).alias(n) for i, n in enumerate(self.sums)]
            counts = kinds = rows.groupBy(*same).agg(*counted, *size)
        else:
            counts = rows.groupBy(*same, "_next").agg(F.sum("weight").alias("_n0"))
            kinds = rows.groupBy(*same).agg(*size)
        near = self._near(below)
        alike = [*keys, _first_places(F.col("_w0"), F.lit(near), self.bits)] if near else keys
        along = Window.partitionBy(*alike).orderBy(*words, "_more")
        kinds = _with_shared(kinds, words, along, self.bits, self.places, near)
        return written(kinds if self.narrow else kinds.join(counts, same), "kinds")

    def _parts(self, kinds: DataFrame, keys: list[str], words: list[str], below: int, upto: int) -> list[DataFrame]:
        near = self._near(below)
        ends = F.when(F.col("_more") & (F.col("_rows") == 1), F.col("_len")).otherwise(F.least("_len", F.lit(upto)))
        kinds = kinds.withColumns({"_ends": ends.cast("int"), "_alone": (F.least(F.col("_shared") + below, "_len") + 1).cast("int")})
        longer = kinds.filter(F.col("_len") > near)

        def named(length: Column) -> Column:
            if not below:
                return F.struct(_first_places(F.col("_w0"), F.least(length, F.lit(self.places)), self.bits).alias("a"), F.lit(0).cast("bigint").alias("b"))
            there = [F.greatest(F.least(length - below - j * self.places, F.lit(self.places)), F.lit(0)) for j in range(len(words))]
            return _pair(*[F.col(k) for k in keys], *[_first_places(F.col(w), n, self.bits) for w, n in zip(words, there)])

        def part(rows: DataFrame, first: Column, last: Column) -> DataFrame:
            ended = last if self.longest is None else F.least(last, F.lit(self.longest))
            rows = rows.withColumns({"len": F.greatest(first, F.lit(self.shortest)), "upto": ended}).filter("len <= upto")
            return rows.select("len", "upto", named(F.col("len")).alias("name"), *self.by, *self.sums)

        def each(rows: DataFrame, first: int, last: Column) -> DataFrame:
            rows = rows.filter(last >= first).withColumn("_l", F.explode(F.sequence(F.lit(first), last)))
            return part(rows, F.col("_l"), F.col("_l")).filter(F.col("len") == F.col("upto"))

        parts = [part(longer, F.col("_alone"), F.col("_ends")), each(longer, below + near + 1, F.col("_alone") - 1)]
        if near:
            begin = kinds.withColumn("_w0", _first_places(F.col("_w0"), F.lit(near), self.bits)).groupBy("_w0", *self.by)
            begun = begin.agg(*[F.sum(n).alias(n) for n in self.sums], F.least(F.max("_len"), F.lit(near)).cast("int").alias("_ends"))
            parts.append(each(begun, 1, F.col("_ends")))
        return parts

    def counts(self) -> DataFrame:
        run = ["len", "upto", "name"]
        added = self.rounds().groupBy(*run, *self.by).agg(*[F.sum(n).alias(n) for n in self.sums])
        if not self.narrow:
            shares = added.withColumn("share", F.col("_n0") / F.sum("_n0").over(Window.partitionBy(*run)))
            texts = self.codes.withColumnsRenamed({"_text": "next_activity", "_code": "_next"})
            return shares.join(texts, "_next").select(*run, "next_activity", F.col("_n0").alias("n"), "share")
        # one shuffle: what follows a run is counted side by side
        entries = F.array(*[F.struct(F.lit(a).cast("string").alias("next_activity"), F.col(n).alias("n")) for a, n in zip(self.few, self.sums)])
        total = reduce(Column.__add__, [F.col(n) for n in self.sums])
        long = added.select(*run, total.alias("_all"), F.explode(entries).alias("_e")).filter("_e.n > 0")
        return long.select(*run, "_e.next_activity", "_e.n", (F.col("_e.n") / F.col("_all")).alias("share"))


def next_counts(log: DataFrame, max_len: int | None = None, min_len: int = 1, *, spans: bool = False) -> DataFrame:
    """(len, name, next_activity, n, share): what follows each run of the last ``min_len..max_len`` activities.

    With ``spans`` a row stands for one run of each length ``len..upto``, each the end of the next, that have the same counts: rows grow with events
    rather than with runs. Names tell runs of one length apart; they are not those of :func:`all_runs`.
    """
    counts = _Followed(log, max_len, max(min_len, 1)).counts()
    if spans:
        return counts
    each = counts.withColumn("len", F.explode(F.sequence("len", "upto")))
    return each.select("len", "name", "next_activity", "n", "share")


def suffix_shares(log: DataFrame, max_len: int | None = None) -> DataFrame:
    """(len, suffix_len, frequency, suffix_frequency, suffix_share) for each distinct run and each of its suffixes of two activities or more.

    A suffix ends where the run ends, so its name is the one of that length at the run's example.
    """
    runs = written(all_runs(_dealt_variants(log), max_len, keep=("weight",)), "runs")
    counts = written(run_counts(runs), "run-counts")
    distinct = counts.groupBy(F.col("len").alias("suffix_len")).agg(F.count(F.lit(1)).alias("of"))
    pairs = counts.select("len", "frequency", "example.case_id", "example.pos", F.explode(F.sequence(F.lit(2), F.col("len"))).alias("suffix_len"))
    named = pairs.join(runs.drop("weight").withColumnRenamed("len", "suffix_len"), ["case_id", "pos", "suffix_len"])
    known = counts.select(F.col("len").alias("suffix_len"), "name", F.col("frequency").alias("suffix_frequency"))
    out = named.join(known, ["suffix_len", "name"]).join(distinct, "suffix_len")
    return out.select("len", "suffix_len", "frequency", "suffix_frequency", (F.col("suffix_frequency") / F.col("of")).alias("suffix_share"))


def suffix_spread(log: DataFrame, max_len: int | None = None) -> DataFrame:
    """Spread of the suffix shares by run length and suffix length, for all lengths unless bounded."""
    return share_spread(suffix_shares(log, max_len))
