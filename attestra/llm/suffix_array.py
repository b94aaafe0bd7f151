"""Suffix arrays in numpy: Larsson-Sadakane refinement, up to the length that is asked for.

A shard holds byte strings one after the other. A suffix ends with its own string; an end counts as
smaller than any byte, and ends are ordered by string, so no two suffixes are equal. Suffixes that share
the first ``length`` bytes keep one rank, which says what their common prefixes would, without a walk.
"""

from __future__ import annotations

import numpy as np

#: Bytes by which suffixes are ordered at first.
FIRST = 5


def words_at(text: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number in the strings' order; zeros follow a string's end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray((len(text),), dtype=">u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    short = np.flatnonzero(left < 8)
    cut = ((8 - left[short]) * 8).astype(np.uint64)
    words[short] = words[short] >> cut << cut
    return words


def _group_firsts(changed: np.ndarray) -> np.ndarray:
    """For each row the place of the last row, up to it, that is marked."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed), dtype=np.int32), np.int32(0)))


def _marked(*ordered: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before in any of the arrays."""
    out = np.zeros(len(ordered[0]), dtype=bool)
    out[:1] = True
    for values in ordered:
        out[1:] |= values[1:] != values[:-1]
    return out


def sort_order(keys: np.ndarray) -> np.ndarray:
    """The order of numbers from 0 on; numpy sorts plain numbers faster than it finds their order."""
    if not len(keys):
        return np.zeros(0, dtype=np.int32)
    bits = (len(keys) - 1).bit_length()
    if int(keys.max()).bit_length() + bits > 64:
        return np.argsort(keys).astype(np.int32)
    packed = (keys.astype(np.uint64) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << bits) - 1)
    return packed.astype(np.int32)


def suffix_ranks(words: np.ndarray, left: np.ndarray, string: np.ndarray, most: int) -> np.ndarray:
    """Each suffix's place in their order by the first ``most`` bytes; suffixes alike so far share a rank.

    Ranks by the first h bytes give those by 2h: a group of equal ranks is sorted by the ranks h
    places on (in the last round by those that make up ``most`` bytes). A rank is the place of its
    group's first suffix; groups of one are done.
    """
    n, h = len(words), min(FIRST, most)
    keys = words >> np.uint64(64 - 8 * h)
    order = sort_order(keys)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = _group_firsts(_marked(keys[order]))
    del keys, order
    # Suffixes of under h bytes differ from others of their first bytes by where they end.
    ends = np.zeros(n, dtype=bool)
    ends[rank[left < h]] = True
    some = np.flatnonzero(ends[rank])
    length = np.minimum(left[some], h)
    which = np.where(length < h, string[some], 0)
    order = np.lexsort((which, length, rank[some]))
    base = rank[some][order]
    rank[some[order]] = base + (_group_firsts(_marked(base, length[order], which[order]))
                                - _group_firsts(_marked(base)))
    del order, ends, some, length, which, base
    strings = int(string[-1]) + 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1).astype(np.int32)
    while len(active) and h < most:
        step = min(h, most - h)
        ended = left[active] == step
        beyond = rank[np.where(ended, active, active + step)].astype(np.int64) + strings
        beyond[ended] = string[active[ended]]
        group = np.zeros(n, dtype=np.int32)
        group[rank[active]] = 1
        keys = (np.cumsum(group, dtype=np.int32) - 1)[rank[active]] * np.int64(n + strings) + beyond
        del beyond, ended, group
        order = sort_order(keys)
        active, keys = active[order], keys[order]
        base = rank[active]
        new = base + (_group_firsts(_marked(keys)) - _group_firsts(_marked(base)))
        del order, keys, base
        rank[active] = new
        single = np.ones(len(new), dtype=bool)
        single[1:] = new[1:] != new[:-1]
        alone = single.copy()
        alone[:-1] &= single[1:]
        active = active[~alone]
        h += step
    return rank


def repeated_starts(text: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts with ``length`` bytes in their string, whether those bytes occur again, and their class.

    Strings of ``sizes`` bytes stand one after the other in ``text``, at most 2^30 in all. Starts of
    one class have equal first ``length`` bytes; its number is a place in the suffix array.
    """
    n = len(text)
    string = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes).astype(np.int32), sizes) - np.arange(n, dtype=np.int32)
    starts = np.flatnonzero(left >= length).astype(np.int32)
    if not len(starts):
        return starts, np.zeros(0, dtype=bool), starts
    words = words_at(text, left)
    # Ranks go by ``length`` bytes and the ends, so neighbours share that many where they share a rank.
    rank = suffix_ranks(words, left, string, length)
    del words, left, string
    return starts, (np.bincount(rank, minlength=n) > 1)[rank[starts]], rank[starts]
