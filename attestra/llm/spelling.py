"""Spelling variants: words one edit apart, found over an index of variable-length grams.

Grams of two to ``longest`` characters are counted over all words, and the dictionary keeps the
frequent ones. At every place of a word, between its end marks, the gram starts with two characters
and grows while the dictionary holds it, so a frequent beginning gives a longer, rarer gram, and what
a gram is depends on its own characters only. An edit therefore changes the grams over its place and
no others; the most grams that lie over one place is the word's bound, and a word one edit away
shares all others, at the same place or moved by the inserted character. Two such words must share a
gram among the ``bound + 1`` rarest of each, so only these lists are merged: by gram, place and
length. What they pair is compared by its sets of letters, many pairs at a time, and then by its
characters.

The dictionary has at most ``DICTIONARY`` grams of a length, whatever the number of words: a gram is
frequent if it has more than its share of all places. A list of over ``LIST_ROWS`` rows is dealt
into pairs of blocks, so no task gets a whole one.

Defined cases: a null or empty text has no words; null ids count as empty ones where an id matters;
texts of any length are split whole; repeated rows count again; ties between forms go to the smallest
word in code-point order; an empty table gives an empty result. Words are compared by code points.
Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import settle

#: Runs of Latin-1 letters (and what stands between them in the code table).
LETTER_RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks before and after a word.
BEGIN, END = "\x02", "\x03"
#: The shortest gram, and the longest; a word must have at least as many letters as that.
SHORTEST, LONGEST = 2, 4
#: Frequent grams of one length that the dictionary may hold, and the count a frequent one exceeds.
DICTIONARY, FREQUENT = 65_536, 32
#: Rows of a list that one task compares; longer lists are dealt into blocks.
LIST_ROWS = 20_000
#: Lists up to this length are compared side by side, longer ones in blocks of so many rows.
SIDE_BY_SIDE, BLOCK = 48, 256
#: Pairs whose characters are compared at a time.
PAIRS = 100_000
#: Large lists whose names are broadcast.
BROADCAST_LISTS = 500_000


def letter_runs(text: Column) -> Column:
    """All maximal runs of letters, as they are written."""
    return F.regexp_extract_all(text, F.lit(LETTER_RUN), F.lit(0))


def lower_ascii(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def frequent_grams(words: DataFrame, longest: int = LONGEST) -> dict[str, int]:
    """Counts of the grams that are frequent over all places of all words."""
    marked = words.select(F.concat(F.lit(BEGIN), "word", F.lit(END)).alias("word"))
    places = marked.agg(F.sum(F.length("word") - SHORTEST + 1)).first()[0] or 0
    least = max(FREQUENT, places // DICTIONARY)

    def of_length(n: int) -> Column:
        places = F.sequence(F.lit(1), F.length("word") - (n - 1))
        return F.transform(places, lambda p: F.substring("word", p, F.lit(n)))

    grams = marked.select(F.explode(F.flatten(F.array(*[
        of_length(n) for n in range(SHORTEST, longest + 1)]))).alias("gram"))
    # At most DICTIONARY rows of each length: their counts add up to the places.
    kept = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return {r["gram"]: r["n"] for r in kept.collect()}


def decompose(word: str, frequent: dict[str, int], longest: int = LONGEST) -> tuple[list[str], int]:
    """The gram at each place of a marked word, and the most grams that one edit can change."""
    marked = BEGIN + word + END
    grams, over = [], [0] * (len(marked) + longest)
    for p in range(len(marked) - SHORTEST + 1):
        n = SHORTEST
        while n < longest and marked[p + n - 1] != END and marked[p:p + n] in frequent:
            n += 1
        grams.append(marked[p:p + n])
        for i in range(p, p + n):
            over[i] += 1
    return grams, max(over[1:-1])


def rarest(grams: list[str], n: int, frequent: dict[str, int]) -> list[int]:
    """The places of the ``n`` rarest grams, in an order that is the same for every word."""
    return sorted(range(len(grams)), key=lambda p: (frequent.get(grams[p], 0), grams[p], p))[:n]


def gram_lists(words: DataFrame, frequent: dict[str, int], longest: int = LONGEST) -> DataFrame:
    """``gram, place, long, word, n, letters`` for each word's rarest grams.

    ``letters`` is a set of bits; ``long`` marks grams that may make a list of over ``LIST_ROWS`` rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, places, letters = [], [], [], []
            for i, word in enumerate(batch.column(0).to_pylist()):
                every, bound = decompose(word, frequent, longest)
                chosen = rarest(every, bound + 1, frequent)
                bits = 0
                for c in word:
                    bits |= 1 << (ord(c) & 63)
                rows += [i] * len(chosen)
                grams += [every[p] for p in chosen]
                places += chosen
                letters += [bits] * len(chosen)
            which = pa.array(rows, pa.int64())
            # A list has each word of the gram once, and the shorter ones at two places.
            many = pa.array([3 * frequent.get(g, 0) > LIST_ROWS for g in grams], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.string()), pa.array(places, pa.int32()), many, batch.column(0).take(which),
                 batch.column(1).take(which), pa.array(np.array(letters, dtype=np.uint64).view(np.int64))],
                names=["gram", "place", "long", "word", "n", "letters"])

    return words.select("word", "n").mapInArrow(
        run, "gram string, place int, long boolean, word string, n long, letters long")


def one_edit(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of strings, the left ones as long or one shorter, are one edit apart."""
    width = max(left.dtype.itemsize, right.dtype.itemsize) // 4 + 1
    a, b = (np.ascontiguousarray(x.astype(f"<U{width}")).view(np.uint32).reshape(len(x), width) for x in (left, right))
    unlike = a != b
    same = (a != 0).sum(axis=1) == (b != 0).sum(axis=1)
    # An inserted character: what follows the first difference is alike, one place on.
    moved = (a[:, :-1] != b[:, 1:])[:, ::-1]
    last = np.where(moved.any(axis=1), width - 2 - moved.argmax(axis=1), -1)
    return np.where(same, unlike.sum(axis=1) == 1, last < unlike.argmax(axis=1))


def alike_letters(letters: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """An edit changes two letters of a word's set at most."""
    return np.bitwise_count(letters[i] ^ letters[j]) <= 2


def list_pairs(group: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i < j of one list, ``group``'s equal neighbours, with alike letters: short lists side by side."""
    n = len(group)
    firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(firsts, n))
    i = np.repeat(sizes <= SIDE_BY_SIDE, sizes).nonzero()[0]
    for step in range(1, SIDE_BY_SIDE):
        i = i[i + step < n]
        i = i[group[i] == group[i + step]]
        if not len(i):
            break
        hit = i[alike_letters(letters, i, i + step)]
        yield hit, hit + step
    for first, size in zip(firsts[sizes > SIDE_BY_SIDE].tolist(), sizes[sizes > SIDE_BY_SIDE].tolist(), strict=True):
        own = letters[first:first + size]
        for at in range(0, size, BLOCK):
            x, y = np.nonzero(np.bitwise_count(own[at:at + BLOCK, None] ^ own[None, at:]) <= 2)
            later = y > x
            yield first + at + x[later], first + at + y[later]


def merge_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of words one edit apart of each list of ``key, low, high, own, longer, word, n, letters``.

    Rows come sorted by list; the last list of a batch waits for the next.
    """
    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, low, high, own, longer, n, letters = (table[c].to_numpy() for c in (
            "key", "low", "high", "own", "longer", "n", "letters"))
        begins = np.append(True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))
        words = np.array(table["word"].to_pylist(), dtype=object)
        for i, j in list_pairs(np.cumsum(begins), letters.view(np.uint64)):
            # Shorter words do not meet each other here, nor do the words of a block in two blocks.
            useful = (longer[i] | longer[j]) & ((low[i] == high[i]) | (own[i] != own[j]))
            i, j = i[useful], j[useful]
            swap = longer[i] & ~longer[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            for at in range(0, len(i), PAIRS):
                x, y = i[at:at + PAIRS], j[at:at + PAIRS]
                near = one_edit(words[x].astype(str), words[y].astype(str))
                x, y = x[near], y[near]
                later = (longer[x] == longer[y]) & (words[x] > words[y])
                x, y = np.where(later, y, x), np.where(later, x, y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[x], pa.string()), pa.array(words[y], pa.string()), pa.array(n[x]), pa.array(n[y])],
                    names=["a", "b", "n_a", "n_b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if held and (last or held[-1].column(0)[0].as_py() != key[-1]):
            yield from search(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif last:
            yield from search(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield from search(pa.Table.from_batches(held))


def near_pairs(words: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``a, b, n_a, n_b``: each two different words of ``word, n`` that are one edit apart, once.

    ``a`` is the shorter word, or the smaller one of equal length. A word is in the lists of its own
    length and, as a shorter one, in those of the next, where its gram may stand one place on.
    """
    grams = gram_lists(words, frequent_grams(words, longest), longest)
    length = F.length("word")
    lists = settle(grams.select("long", "word", "n", "letters", F.explode(F.array(*[
        F.struct(F.xxhash64("gram", F.col("place") + moved, length + longer).alias("key"), F.lit(not longer).alias("longer"))
        for longer, moved in ((0, 0), (1, 0), (1, 1))])).alias("at")).select(
        "at.key", "at.longer", "long", "word", "n", "letters"))
    large = settle(lists.where("long").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("rows") > LIST_ROWS).select("key", F.ceil(F.col("rows") / LIST_ROWS).cast("int").alias("blocks")))
    if large.count() <= BROADCAST_LISTS:
        large = F.broadcast(large)
    # A large list is dealt into blocks, and each block to all pairs with another one.
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = lists.join(large, "key", "left").withColumn("own", F.pmod(F.xxhash64("word"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "longer",
        "word", "n", "letters")
    return dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(
        merge_lists, "a string, b string, n_a long, n_b long").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """``word, root``: where ``word, form`` ends when forms are followed; each round doubles the way."""
    at = settle(forms.select("word", F.col("form").alias("root")))
    # A form has more occurrences than its word, so there are no circles and a way has an end.
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = settle(at.join(next_, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        at = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return at


def group_variants(words: DataFrame, ratio: int = 2, longest: int = LONGEST) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for a table ``word, n`` of different words.

    A word's form is its most frequent near word, if that is at least ``ratio`` times as frequent.
    Words need at least ``longest`` characters.
    """
    pairs = settle(near_pairs(words, longest))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionAll(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(
        (-F.col("n_other")).alias("n"), F.col("other").alias("word"))).alias("_best"))
    form_n = -F.col("_best.n")
    found = settle(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form_n >= ratio * F.col("n"), F.col("_best.word")).alias("form"),
        F.when(form_n >= ratio * F.col("n"), form_n).alias("form_n")))
    roots = follow(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
