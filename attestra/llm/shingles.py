"""Word n-grams of a batch of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words (between white space) of all texts, and each text's bounds."""
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(pc.fill_null(texts, ""))))
    coded = lists.values.dictionary_encode()
    each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()),
                       dtype=np.uint64, count=len(coded.dictionary))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = coded.indices.to_numpy(zero_copy_only=False)
    words = each[flat] if len(each) else np.zeros(0, dtype=np.uint64)
    # A blank text splits into one empty word; it has none.
    empty = np.uint64(xxhash.xxh3_64_intdigest(""))
    keep = words != empty
    if not keep.all():
        count = np.concatenate([[0], np.cumsum(keep)])
        bounds, words = count[bounds], words[keep]
    return words, bounds


def shingle_hashes(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, in order, and each text's bounds.

    A text of 1 to n - 1 words has one, of all its words; a text without words has none.
    """
    words, bounds = word_hashes(texts)
    count = np.diff(bounds)
    size = np.minimum(count, n)
    grams = np.where(count > 0, count - size + 1, 0)
    out = np.concatenate([[0], np.cumsum(grams)])
    start = np.arange(out[-1]) + np.repeat(bounds[:-1] - out[:-1], grams)
    length = np.repeat(size, grams)
    total = length.astype(np.uint64)
    padded = np.append(words, np.zeros(n, dtype=np.uint64))
    for k in range(n):
        total = total * _MIX + np.where(k < length, padded[start + k], np.uint64(0))
        total ^= total >> np.uint64(29)
    return total * _MIX, out
