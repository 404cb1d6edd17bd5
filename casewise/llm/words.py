"""White-space separated words as 64-bit hashes, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of all texts, A-Z lower-cased, the place among them of every word, text after text, and each text's number of words.

    Words are runs of anything but ASCII white space. One of the distinct words may be empty; no word has its place.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = split.offsets.to_numpy(zero_copy_only=False)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    # an empty string is what is left of white space at either end
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in names] or [0], np.uint64)
    blank = names == "" if len(names) else np.ones(1, bool)
    places = coded.indices.to_numpy(zero_copy_only=False)
    kept = ~blank[places] if len(places) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    return hashes, places[kept], np.diff(ends)
