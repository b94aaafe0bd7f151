"""Many phrases in many texts: which texts contain which phrases, without comparing all with all.

A phrase is found where its matching form is a substring of the text's. The words inside a phrase
then stand in the text as they are, only its first word may be the end of a longer one and its last
word the beginning.

Up to ``FEW`` phrases are handed to every task, and no row of a text or of its words moves: the eight
letters at each place of many texts are looked up, side by side, among the beginnings of the phrases.

More phrases meet texts through an inverted index, an equi-join on words. A phrase of three or more
words is anchored at the rarest of its inner words, one of two words at the longer of them (an ending or
a beginning), one of a single word at whatever vocabulary words hold it; only then is it looked up in a
text. Phrases of a text are handed to it in bounded lists, so the text is copied about once, and copies
of a text are searched once. Every word of a text and every candidate is shuffled there.

A null or blank text or phrase finds nothing. A phrase of marks alone has an empty matching form,
which every text contains that is not blank.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import blank, fold_ascii, match_folded

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Phrases, and letters of all of them, up to which they are handed to every task.
FEW, FEW_LETTERS = 1 << 18, 1 << 25
#: Letters by which phrases are listed, and those of them that a table of all beginnings has.
HEAD, SURE = 8, 3
#: Letters that are searched at once, and rows that leave at once (those of one text stay together).
LETTERS, ROWS = 1 << 18, 1 << 16
#: Phrases of a list that a text is searched for at once.
LIST = 256
#: Shares of the texts, each of which meets a phrase with an empty form by itself.
SHARES = 64


def _forms(table: DataFrame, id_column: str, text_column: str, name: str) -> DataFrame:
    """``id, name, form``: the matching form and its key, for texts that are not blank."""
    folded = table.where(F.length(blank(F.col(text_column))) > 0).select(
        F.col(id_column).alias("id"), fold_ascii(F.col(text_column), pinned=True).alias("folded"))
    form = folded.select("id", match_folded(F.col("folded")).alias("form"))
    # As bytes the key is half as long, and every word of a text is shuffled with it.
    return form.select("id", F.unhex(F.md5("form")).alias(name), "form")


def _pieces(phrases: DataFrame) -> DataFrame:
    """``phrase, kind, piece``: the words by which a phrase can be anchored, and how they stand in a text."""
    words = F.split("form", " ")
    n, first, last = F.size(words), F.element_at(words, 1), F.element_at(words, -1)
    ending = F.length(first) > F.length(last)
    def anchor(kind, piece):
        return F.struct(kind.alias("kind"), piece.alias("piece"))
    inner = F.transform(F.slice(words, 2, F.greatest(n - 2, F.lit(0))), lambda w: anchor(F.lit("whole"), w))
    edge = F.array(anchor(F.when(ending, "end").otherwise("start"), F.when(ending, first).otherwise(last)))
    return phrases.select("phrase", F.explode(
        F.when(n > 2, inner).when(n == 2, edge).otherwise(F.array(anchor(F.lit("within"), first)))).alias("a")).select(
        "phrase", "a.kind", "a.piece").distinct()


def _within(word: Column, length: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(word) - length + 1, F.lit(1)))
    parts = F.transform(places, lambda at: F.substring(word, at, F.lit(length)))
    return F.when(F.length(word) >= length, parts).otherwise(F.array().cast("array<string>"))


def _parts(word: Column, kind: str, lengths: list[int]) -> Column:
    """The parts of a word of the given lengths that can be a piece of that kind."""
    if kind == "start":
        return F.array_distinct(F.array(*[F.left(word, F.lit(n)) for n in lengths]))
    if kind == "end":
        return F.array_distinct(F.array(*[F.right(word, F.lit(n)) for n in lengths]))
    return F.array_distinct(F.flatten(F.array(*[_within(word, n) for n in lengths])))


def _anchors(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``phrase, word``: the vocabulary words of which a text with the phrase must hold one."""
    whole = pieces.where("kind = 'whole'").join(
        vocabulary, F.col("piece") == F.col("word"), "left").groupBy("phrase").agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "piece")).alias("rarest"))
    # A phrase with an inner word that no text has is nowhere.
    found = whole.where("rarest.texts > 0").select("phrase", F.col("rarest.piece").alias("word"))
    lengths: dict[str, list[int]] = {}
    for r in pieces.where("kind <> 'whole'").select("kind", F.length("piece").alias("n")).distinct().collect():
        lengths.setdefault(r["kind"], []).append(r["n"])
    for kind, some in sorted(lengths.items()):
        parts = vocabulary.where(F.length("word") >= min(some)).select(
            "word", F.explode(_parts(F.col("word"), kind, sorted(some))).alias("piece"))
        found = found.unionAll(pieces.where(F.col("kind") == kind).join(parts, "piece").select("phrase", "word"))
    return found


class Phrases:
    """Different matching forms, by number, listed by the letters they begin with.

    Codes hold eight letters and order like them. A listed beginning that begins a text's letters also
    begins the last listed one that is not after these, so each has a link to the next shorter.
    """

    def __init__(self, phrases: list[str]):
        forms = [p.encode("ascii") for p in phrases]
        self.anywhere = {number: 1 for number, p in enumerate(forms) if not p}
        self.short = [(number, p) for number, p in enumerate(forms) if 0 < len(p) < SURE]
        ends = {p: number for number, p in enumerate(forms) if SURE <= len(p) <= HEAD}
        longer: dict[bytes, list[tuple[bytes, int]]] = {}
        for number, p in enumerate(forms):
            if len(p) > HEAD:
                longer.setdefault(p[:HEAD], []).append((p, number))
        heads = sorted({*ends, *longer})
        self.codes = np.array([int.from_bytes(h.ljust(HEAD, b"\0"), "big") for h in heads], dtype=np.uint64)
        self.masks = np.array([(1 << 64) - (1 << 8 * (HEAD - len(h))) for h in heads], dtype=np.uint64)
        self.shorter = _shorter(heads)
        self.ends = np.array([ends.get(h, -1) for h in heads], dtype=np.int64)
        self.begun = np.zeros(1 << 8 * SURE, dtype=bool)
        self.begun[(self.codes >> np.uint64(8 * (HEAD - SURE))).astype(np.int64)] = True
        self.longer = {}
        for k, h in enumerate(heads):
            if h in longer:
                whole, numbers = zip(*sorted(longer[h]), strict=True)
                self.longer[k] = whole, numbers, _shorter(whole).tolist(), max(map(len, whole))
        self.is_long = np.array([h in longer for h in heads], dtype=bool)

    def beginnings(self, letters: bytes, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Places from ``low`` to ``high`` where listed beginnings stand, in order, and which ones."""
        codes = np.ndarray(high - low, dtype=">u8", buffer=letters, offset=low, strides=(1,)).astype(np.uint64)
        at = np.flatnonzero(self.begun[codes >> np.uint64(8 * (HEAD - SURE))])
        codes = codes[at]
        head = np.searchsorted(self.codes, codes, side="right") - 1
        found = []
        while len(at := at[ok := head >= 0]):
            codes, head = codes[ok], head[ok]
            same = codes & self.masks[head] == self.codes[head]
            found.append((at[same] + low, head[same]))
            head = self.shorter[head]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, head = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return at[order], head[order]

    def search(self, forms: list[str]) -> list[dict[int, int]]:
        """For each text's form its phrases and where they begin, from 1."""
        # No phrase has the mark that stands between texts.
        letters = "\n".join(forms).encode("ascii") + b"\n" * HEAD
        begin = np.cumsum([0, *(len(f) + 1 for f in forms)])
        starts = begin.tolist()
        found = [dict(self.anywhere) for _ in forms]
        for k, hits in enumerate(found):
            for number, p in self.short:
                if (at := letters.find(p, starts[k], starts[k + 1])) >= 0:
                    hits[number] = at - starts[k] + 1
        for low in range(0, starts[-1] if len(self.codes) else 0, LETTERS):
            at, head = self.beginnings(letters, low, min(low + LETTERS, starts[-1]))
            text = np.searchsorted(begin, at, side="right") - 1
            first = np.unique(text * len(self.codes) + head, return_index=True)[1]
            first = first[self.ends[head[first]] >= 0]
            for k, number, place in zip(text[first].tolist(), self.ends[head[first]].tolist(), at[first].tolist(), strict=True):
                found[k].setdefault(number, place - starts[k] + 1)
            long = self.is_long[head]
            for k, h, place in zip(text[long].tolist(), head[long].tolist(), at[long].tolist(), strict=True):
                whole, numbers, shorter, most = self.longer[h]
                last = bisect_right(whole, letters[place:place + most]) - 1
                while last >= 0:
                    if letters.startswith(whole[last], place):
                        found[k].setdefault(numbers[last], place - starts[k] + 1)
                    last = shorter[last]
        return found


def _shorter(sorted_forms: Sequence[bytes]) -> np.ndarray:
    """For each form the place of the longest other one that it begins with, or -1."""
    links, open_forms = [], []
    for k, form in enumerate(sorted_forms):
        while open_forms and not form.startswith(sorted_forms[open_forms[-1]]):
            open_forms.pop()
        links.append(open_forms[-1] if open_forms else -1)
        open_forms.append(k)
    return np.array(links, dtype=np.int64)


def _carried(given: DataFrame, asked: pa.Table, schema: str, names: list[str]) -> DataFrame:
    """Texts of ``id, form`` searched where they are for the phrases ``id, form``."""
    numbers: dict[str, int] = {}
    owned = np.array([numbers.setdefault(form, len(numbers)) for form in asked["form"].to_pylist()], dtype=np.int64)
    phrases = list(numbers)
    # The needles in the order of their phrases; a phrase has ``times`` of them from ``begin`` on.
    owners = asked["id"].combine_chunks().take(pa.array(np.argsort(owned, kind="stable")))
    times = np.bincount(owned, minlength=len(phrases))
    begin = np.cumsum(times) - times

    def rows(ids: pa.Array, hits: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        text = np.repeat([k for k, _, _ in hits], [len(numbers) for _, numbers, _ in hits])
        number, at = np.concatenate([h[1] for h in hits]), np.concatenate([h[2] for h in hits])
        copies = times[number]
        place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(text, copies))), owners.take(pa.array(np.repeat(begin[number], copies) + place)),
             pa.array(np.repeat(at, copies))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = Phrases(phrases)
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(ends // LETTERS)) + 1).tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                ids, forms = (c.slice(start, stop - start) for c in batch.columns)
                hits, size = [], 0
                for k, found in enumerate(listed.search(forms.to_pylist())):
                    if found:
                        number = np.fromiter(found, np.int64, len(found))
                        hits.append((k, number, np.fromiter(found.values(), np.int32, len(found))))
                        size += int(times[number].sum())
                    if size >= ROWS:
                        yield rows(ids, hits)
                        hits, size = [], 0
                if hits:
                    yield rows(ids, hits)

    return given.select("id", "form").mapInArrow(run, schema)


def find_needles(texts: DataFrame, needles: DataFrame, text_id: str, text_column: str, needle_id: str,
                 needle_column: str, store: str | None = None, few: int = FEW) -> DataFrame:
    """One row per text and phrase it contains: both ids and ``at``, where the matching form begins (from 1).

    Up to ``few`` phrases go to the texts; ``store`` is for more of them: it names a shared folder for
    the texts' matching forms, which without it are made anew for the index and for the lookup.
    """
    spark = texts.sparkSession
    given, asked = _forms(texts, text_id, text_column, "text"), _forms(needles, needle_id, needle_column, "phrase")
    count, letters = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("form")), F.lit(0))).first()
    if count <= few and letters <= FEW_LETTERS:
        kinds = [t.schema["id"].dataType.simpleString() for t in (given, asked)]
        return _carried(given, asked.select("id", "form").toArrow(),
                        f"`{text_id}` {kinds[0]}, `{needle_id}` {kinds[1]}, at int", [text_id, needle_id, "at"])
    if store is not None:
        given.write.mode("overwrite").parquet(f"{store}/forms")
        given = spark.read.parquet(f"{store}/forms")
    bodies = given.select("text", "form").dropDuplicates(["text"])
    phrases = asked.where("form <> ''").select("phrase", "form").dropDuplicates(["phrase"])

    words = bodies.select("text", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    vocabulary = words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("texts"))
    candidates = words.join(_anchors(_pieces(phrases), vocabulary), "word").select("text", "phrase").distinct()
    lists = max(1, phrases.count() // LIST)
    handed = candidates.join(phrases, "phrase").groupBy("text", F.pmod(F.xxhash64("phrase"), F.lit(lists)).alias("part")).agg(
        F.collect_list(F.struct("phrase", "form")).alias("phrases"))
    looked = bodies.join(handed, "text").select("text", F.explode(F.transform(
        "phrases", lambda p: F.struct(p["phrase"].alias("phrase"), F.position(p["form"], F.col("form")).alias("at")))
    ).alias("hit")).where("hit.at > 0").select("text", "hit.phrase", "hit.at")

    every = given.select(F.col("id").alias(text_id), "text")
    names = asked.select(F.col("id").alias(needle_id), "phrase", "form")
    found = every.join(looked, "text").join(names.drop("form"), "phrase").select(text_id, needle_id, "at")
    empty = names.where("form = ''").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    anywhere = every.withColumn("share", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SHARES)).cast("int")).join(
        empty, "share").select(text_id, needle_id, F.lit(1).alias("at"))
    return found.unionAll(anywhere)
