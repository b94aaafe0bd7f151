"""Fuzzy string scores as Arrow UDFs: ``ratio`` and ``partial_ratio``, both 0 to 100.

``ratio`` is the normalized Indel similarity ``200 * LCS / (len(a) + len(b))``.
``partial_ratio`` is the best ``ratio`` of the shorter string against every window of the
longer one that has the shorter string's length, plus the truncated windows at both ends.

A window-by-window LCS costs O(windows * needle^2). Here the semi-local LCS braid (A. Tiskin,
"Semi-local string comparison") gives the LCS of the needle with *all* windows in one
O(needle * text) sweep. The sweep walks anti-diagonals over many (needle, text piece) lanes
at once, so it runs as a few NumPy integer operations per step. Results are exact.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship these helpers inside the serialized UDF, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 3072  # text characters per lane; longer texts continue in the next lane
PAD_TEXT = 0  # letters are numbered from 1
LETTERS = 1 << 20  # letters of needles and texts scored at once
CELLS = 24576  # needle rows x lanes swept together, sized to stay in the CPU cache


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sweep(needles: list, pieces: list, rows: int) -> np.ndarray:
    """Braid sweep of a group of lanes; returns, per text column, where its strand started.

    ``pieces`` hold codes that share ids, from 1, with their lane's needle; ``PAD_TEXT``
    stands for other letters and pads texts, and a number above all ids pads needles, so that
    pads match nothing. The result has one column per lane, is indexed
    by text position, and is negative where the strand entered from the left.
    """
    width = max(len(p) for p in pieces)
    total = width + 2 * rows
    # Ids are at most the needle's length, so a type that holds the strands holds them too.
    kind, far = (np.int16, 0x4000) if total + rows < 0x4000 else (np.int32, 0x40000000)
    lanes = len(pieces)
    needle = np.full((rows, lanes), rows + 1, kind)
    text = np.full((total, lanes), PAD_TEXT, kind)  # last character first
    for lane, (a, b) in enumerate(zip(needles, pieces)):
        needle[: len(a), lane] = a
        text[total - rows - len(b): total - rows, lane] = b[::-1]
    across = np.repeat(np.arange(rows - 1, -1, -1, dtype=kind)[:, None], lanes, axis=1)
    down = np.repeat(np.arange(rows + total - 1, rows - 1, -1, dtype=kind)[:, None], lanes, axis=1)
    spare = np.empty_like(across)
    for step in range(rows - 1, total):
        low = total - 1 - step
        strands = down[low: low + rows]
        # A match (zero after xor) lifts `across` beyond every id, so the strands swap.
        np.bitwise_xor(text[low: low + rows], needle, out=spare)
        spare -= 1
        spare &= far
        spare |= across
        np.minimum(spare, strands, out=spare)
        strands ^= across
        strands ^= spare
        across, spare = spare, across
    return down[::-1][rows: rows + width].astype(np.int32) - 2 * rows


def _column_starts(pairs: list) -> list:
    """For each (needle codes, text codes): the strand start of every text position."""
    starts = [np.empty(len(b), np.int64) for _, b in pairs]
    lanes = []
    for index, (a, b) in enumerate(pairs):
        letters = np.unique(a)
        where = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
        coded = np.where(letters[where] == b, where + 1, PAD_TEXT)
        own = np.searchsorted(letters, a) + 1
        for begin in range(0, max(len(b), 1), PIECE):
            back = min(begin, len(a))  # a window reaches back at most one needle length
            lanes.append((len(a), index, begin, back, own,
                          coded[begin - back: begin + PIECE]))
    lanes.sort(key=lambda lane: (lane[0], len(lane[5])))
    position = 0
    while position < len(lanes):
        # Lanes of a group share the padded needle length; sorting keeps the padding small.
        size = max(1, CELLS // max(1, lanes[position][0]))
        group = lanes[position: position + size]
        rows = group[-1][0]
        swept = _sweep([g[4] for g in group], [g[5] for g in group], rows)
        for lane, (_, index, begin, back, _, piece) in enumerate(group):
            keep = swept[back: len(piece), lane].astype(np.int64) + (begin - back)
            starts[index][begin: begin + len(keep)] = keep
        position += size
    return starts


def _best_window(needle: int, start: np.ndarray) -> float:
    """Best ratio over full windows and the truncated windows at both ends of the text."""
    size = len(start)
    at = np.arange(size)
    # Column c adds one common character to every window start in (start[c], c].
    first = np.maximum(np.maximum(start, at - needle), -1) + 1
    change = np.bincount(first, minlength=size + 1) - np.bincount(at + 1, minlength=size + 1)
    common = np.cumsum(change)[:size]
    length = np.minimum(needle, size - at)
    best = float((common / (needle + length)).max())
    head = min(needle - 1, size)
    if head > 0:
        common = np.cumsum(start[:head] < 0)
        best = max(best, float((common / (needle + 1 + at[:head])).max()))
    return 200.0 * best


def _shares(work: list):
    """Successive parts of ``(slot, needle, text)`` rows with at most ``LETTERS`` or one row each."""
    part, letters = [], 0
    for row in work:
        size = len(row[1]) + len(row[2])
        if part and letters + size > LETTERS:
            yield part
            part, letters = [], 0
        part.append(row)
        letters += size
    if part:
        yield part


def partial_ratios(pairs: list) -> list:
    """Scores of (needle, text) string pairs; None where either side is None."""
    scores = [None] * len(pairs)
    work, owner = [], []
    seen = {}
    for index, pair in enumerate(pairs):
        a, b = pair
        if a is None or b is None:
            continue
        if a == b:
            scores[index] = 100.0
        elif not a or not b:
            scores[index] = 0.0
        elif pair in seen:
            scores[index] = seen[pair]  # copies within the batch are scored once
        else:
            slot = seen[pair] = len(owner)
            owner.append(0.0)
            scores[index] = slot
            short, long = (a, b) if len(a) <= len(b) else (b, a)
            work.append((slot, short, long))
            if len(a) == len(b):
                work.append((slot, long, short))
    # Codes and strands take some thirty bytes a letter, so only so many letters are scored at once,
    # those of like lengths together.
    work.sort(key=lambda row: (len(row[1]), len(row[2])))
    for group in _shares(work):
        for (slot, a, b), start in zip(group, _column_starts(
                [(_codes(a), _codes(b)) for _, a, b in group])):
            owner[slot] = max(owner[slot], _best_window(len(a), start))
    return [owner[s] if isinstance(s, int) else s for s in scores]


def ratios(pairs: list) -> list:
    """Scores of string pairs; None where either side is None. Copies are scored once."""
    scores = [None] * len(pairs)
    work, slots = [], {}
    for index, (a, b) in enumerate(pairs):
        if a is None or b is None:
            continue
        if a == b:
            scores[index] = 100.0
        elif not a or not b:
            scores[index] = 0.0
        else:
            # The score is symmetric: a pair and its mirror image share a slot.
            short, long = (a, b) if (len(a), a) <= (len(b), b) else (b, a)
            scores[index] = slots.setdefault((short, long), len(slots))
            if len(slots) > len(work):
                work.append((short, long))
    common = _common_lengths(work)
    return [200.0 * common[s] / sum(map(len, work[s])) if isinstance(s, int) else s for s in scores]


LANES = 4096  # pairs that are scored side by side
WORD = 64  # needle letters of a lane


def _common_lengths(pairs: list) -> list:
    """LCS lengths of (needle, text) string pairs: bit-parallel (H. Hyyro).

    Needles of up to 64 letters are one machine word each, and a step takes the next letter of
    thousands of texts at once. Longer needles are one long integer each.
    """
    lengths = [0] * len(pairs)
    short = sorted((k for k, (a, _) in enumerate(pairs) if len(a) <= WORD), key=lambda k: len(pairs[k][1]))
    for at in range(0, len(short), LANES):
        group = short[at:at + LANES]
        for k, n in zip(group, _lane_lengths([pairs[k] for k in group])):
            lengths[k] = n
    for k, (needle, text) in enumerate(pairs):
        if len(needle) > WORD:
            lengths[k] = _long_length(_codes(needle), _codes(text))
    return lengths


def _padded(codes: np.ndarray, sizes: np.ndarray, filler: int) -> np.ndarray:
    """Codes of many strings, a column each, so that a step reads one row."""
    table = np.full((len(sizes), int(sizes.max())), filler, np.int32)
    table[np.arange(table.shape[1]) < sizes[:, None]] = codes
    return np.ascontiguousarray(table.T)


def _lane_lengths(pairs: list) -> list:
    needles, texts = zip(*pairs)
    n, m = (np.fromiter(map(len, x), np.int64, len(pairs)) for x in (needles, texts))
    letters, coded = np.unique(_codes("".join(needles)), return_inverse=True)
    flat = _codes("".join(texts))
    where = np.minimum(np.searchsorted(letters, flat), len(letters) - 1)
    other = len(letters)  # a letter that no needle has
    text = _padded(np.where(letters[where] == flat, where, other), m, other)
    lanes = np.arange(len(pairs))
    masks = np.zeros((len(letters) + 2, len(pairs)), np.uint64)
    for place, row in enumerate(_padded(coded, n, other + 1)):
        masks[row, lanes] |= np.uint64(1 << place)
    masks[other] = masks[other + 1] = 0
    # All ones below the needle's length; the shift is in two steps, as one by 64 does nothing.
    bits = n.astype(np.uint64)
    own = ~(~np.uint64(0) << (bits // np.uint64(2)) << (bits - bits // np.uint64(2)))
    state = own.copy()
    for codes in text:
        hit = state & masks[codes, lanes]
        state = (state + hit) | (state ^ hit)
    return (n - np.bitwise_count(state & own)).tolist()


def _long_length(needle: np.ndarray, text: np.ndarray) -> int:
    masks = {}
    for bit, code in enumerate(needle.tolist()):
        masks[code] = masks.get(code, 0) | (1 << bit)
    full = (1 << len(needle)) - 1
    state = full
    for code in text.tolist():
        hit = state & masks.get(code, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(needle) - state.bit_count()


@F.pandas_udf(DoubleType())
def _partial_ratio_udf(needle: pd.Series, text: pd.Series) -> pd.Series:
    pairs = [(a if isinstance(a, str) else None, b if isinstance(b, str) else None)
             for a, b in zip(needle, text)]
    return pd.Series(partial_ratios(pairs), dtype="float64")


@F.pandas_udf(DoubleType())
def _ratio_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    pairs = [(a if isinstance(a, str) else None, b if isinstance(b, str) else None)
             for a, b in zip(left, right)]
    return pd.Series(ratios(pairs), dtype="float64")


# Catalyst may copy a deterministic UDF call into a pushed-down filter and so run it twice;
# plans that score long texts use this variant, which it leaves in place.
_partial_ratio_pinned = F.pandas_udf(_partial_ratio_udf.func, DoubleType()).asNondeterministic()


def partial_ratio(left: Column, right: Column) -> Column:
    """Exact partial ratio; rows where one side contains the other skip the UDF's work."""
    hit = (F.length(left) > 0) & (F.length(right) > 0) & (
        F.contains(right, left) | F.contains(left, right))
    return F.coalesce(F.when(hit, F.lit(100.0)),
                      _partial_ratio_udf(F.when(~hit, left), F.when(~hit, right)))


def partial_ratio_gated(needle: Column, text: Column) -> Column:
    """As ``partial_ratio`` with inputs the caller has already blanked to null."""
    return _partial_ratio_pinned(needle, text)


def ratio(left: Column, right: Column) -> Column:
    same = left == right
    return F.coalesce(F.when(same, F.lit(100.0)),
                      _ratio_udf(F.when(~same, left), F.when(~same, right)))
