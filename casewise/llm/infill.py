"""Fill-in-the-middle transformation over a Roaring-style set of cut places.

A text is a sequence of units and may be cut where a unit ends. The offsets of all such places, 0 included, form a set that is kept in
containers of 2^16 offsets: a sorted array, a bitmap or a list of runs, whichever is smallest. Running cardinalities of the containers tell
which one holds the place after ``k`` units; a select inside it gives the offset. So a cut costs one search and one local select, and
the set stays far below the text's own size however long the text is.

The two cut numbers, the choice to transform at all and the order of the parts come from a seeded hash of the id, so a rerun agrees. A
transformed text is ``<P>prefix<S>suffix<M>middle`` (psm) or ``<S>suffix<P>prefix<M>middle`` (spm); :func:`restore` gives the text back.

A null text counts as empty; an empty text, and one that already holds a marker, stays plain. A null id hashes as the empty text. Rows with
equal ids get equal hashes and are rows of their own. An empty table gives no rows. Columns of the input that bear the name of a result are
replaced by it, all others are handed through by :func:`fill_in_middle`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewise.llm.common import blocks, text_of

#: Markers of the three parts; fixed values.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Offsets per container, and the largest number of them that a sorted array holds (both as in Roaring sets).
CONTAINER, ARRAY_MOST = 1 << 16, 4096
UNITS = ("token", "character", "line")


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.values[k])

    def nbytes(self) -> int:
        return self.values.nbytes


class BitmapContainer:
    """One bit per value, and the number of bits set before each of 1,024 words."""

    def __init__(self, values: np.ndarray) -> None:
        bits = np.zeros(CONTAINER, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").reshape(-1, 8)
        self.before = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1))[:-1]]).astype(np.uint16)

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.words[word], bitorder="little"))
        return word * 64 + int(inside[k - int(self.before[word])])

    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes


class RunContainer:
    """Stretches of consecutive values: the first of each, and how many values lie before it."""

    def __init__(self, values: np.ndarray) -> None:
        opens = np.flatnonzero(np.diff(values, prepend=-2) != 1)
        self.firsts, self.before = values[opens].astype(np.uint16), opens.astype(np.uint16)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.firsts[run]) + k - int(self.before[run])

    def nbytes(self) -> int:
        return self.firsts.nbytes + self.before.nbytes


def container(values: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container for sorted values below ``CONTAINER``."""
    runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
    if 4 * runs < min(2 * len(values), CONTAINER // 8):
        return RunContainer(values)
    return ArrayContainer(values) if len(values) <= ARRAY_MOST else BitmapContainer(values)


class BoundarySet:
    """A set of ascending offsets with select by rank."""

    def __init__(self, offsets: np.ndarray) -> None:
        high = offsets // CONTAINER
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts]
        self.before = starts  # cumulative cardinality below each container
        self.size = len(offsets)
        parts = np.split(offsets % CONTAINER, starts[1:]) if len(starts) else []
        self.containers = [container(p) for p in parts]

    def __len__(self) -> int:
        return self.size

    def select(self, k: int) -> int:
        """The offset with ``k`` smaller ones in the set."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.keys[at]) * CONTAINER + self.containers[at].select(k - int(self.before[at]))

    def nbytes(self) -> int:
        return self.keys.nbytes + self.before.nbytes + sum(c.nbytes() for c in self.containers)


def boundaries(text: str, unit: str = "token") -> np.ndarray:
    """Offsets in code points at which a text may be cut, 0 and the end included.

    A token is white space with the word after it, or white space at the end; white space is U+0020 and U+0009 to U+000D. A line ends behind its
    line feed.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if unit == "character":
        return np.arange(n + 1)
    if unit == "line":
        ends = np.flatnonzero(codes == 10) + 1
    else:
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.unique(np.concatenate([[0], ends, [n]]))


@dataclass(frozen=True)
class Rates:
    """Percentages: texts that are transformed, and those of them in the order suffix, prefix, middle."""

    transformed: int = 50
    suffix_first: int = 80


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the hash of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def plan(text: str, numbers: tuple[int, int, int, int], unit: str, rates: Rates) -> tuple[int, str, int, int]:
    """Number of units, form, and the two cut offsets of a text."""
    places = BoundarySet(boundaries(text, unit))
    n = len(places) - 1
    h1, h2, h3, h4 = numbers
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.transformed:
        return n, "plain", 0, 0
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < rates.suffix_first else "psm", places.select(one), places.select(two)


def transform(text: str, form: str, one: int, two: int) -> str:
    """The text in its form, cut at two offsets."""
    prefix, middle, suffix = text[:one], text[one:two], text[two:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restore(output: str, form: str) -> str:
    """The text that was transformed, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError(f"not in the form {form}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "token", seed: int = 42, rates: Rates = Rates(),
    output: bool = True,
) -> DataFrame:
    """``docs`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (null if plain), ``output_sha256``, ``restored_sha256`` and ``output``.

    One pass without a shuffle; ``output=False`` leaves the transformed text itself out.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    results = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output_sha256": "string", "restored_sha256": "string"}
    results |= {"output": "string"} if output else {}
    others = [F.col(f"`{c}`") for c in docs.columns if c not in results and (output or c != text)]
    rows = docs.select(F.struct(*others).alias("row"), F.col(doc_id).alias("id"), text_of(text).alias("text"))
    names = [f"{n} {t}" for n, t in results.items()]

    def one_row(key: int | None, source: str) -> tuple:
        n, form, one, two = plan(source, draws(key, seed), unit, rates)
        out = transform(source, form, one, two)
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in (out, restore(out, form))]
        cut = (None, None) if form == "plain" else (one, two - one)
        return (n, form, *cut, *hashes, *([out] if output else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4 << 20):
            made = [one_row(k, t) for k, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            kinds = [pa.string() if t == "string" else pa.int64() for t in results.values()]
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], ["row", *results])

    kept = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kept}, " + ", ".join(names)).select("row.*", *results)
