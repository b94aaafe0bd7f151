"""Pack tokenized documents into as few fixed-length sequences as can be, by bin completion.

Which pieces share a sequence depends on their lengths only, and a piece has one of ``capacity``
lengths. So pieces are counted by length, branch and bound runs over that histogram (bounded by the
capacity, whatever the input), and its fillings are dealt out to pieces by their place within their
length. A filling is used as often as its lengths last, so the search takes a few steps per length.

Defined cases: a null or empty text is its closing token alone, one piece of length 1; a document
longer than the capacity is cut into pieces; repeated rows are packed as documents of their own;
an empty table gives an empty result. Extra columns are ignored, so none can clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import ranked, settle
from attestra.llm.tokens import SLICE_BYTES, slices, word_encoder

#: Steps of branch and bound; the best packing met by then is used, and it is always complete.
SEARCH_STEPS = 4_000
#: Fillings that are tried around one largest piece, least waste first.
BRANCHES = 4
#: Largest pieces that are tried as the third of a filling.
THIRDS = 16

Pattern = tuple[tuple[int, ...], int]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
                 id_column: str = "doc_id", text_column: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` ids: ``doc_id, piece, start, length, ids_crc32``.

    A document is the ids of its whole text and then ``end_id``. ``ids`` follow on request.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (
        ", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(vocabulary)
        last = np.asarray([end_id], dtype="<u4")
        for batch in batches:
            sizes = batch.column(1).to_pandas().str.len().fillna(0).to_numpy(np.int64)
            for begin, stop in slices(sizes, SLICE_BYTES):
                rows, out = [], {k: [] for k in ("piece", "start", "length", "crc", "ids")}
                for i, ids in enumerate(encoder.encode(batch.column(1).slice(begin, stop - begin))):
                    ids = np.concatenate([ids, last])
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at:at + capacity]
                        rows.append(begin + i)
                        out["piece"].append(k)
                        out["start"].append(at)
                        out["length"].append(len(part))
                        out["crc"].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            out["ids"].append(part.astype(np.int32))
                columns = [batch.column(0).take(pa.array(rows, pa.int32())),
                           pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                           pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())]
                if with_ids:
                    columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_column, text_column).mapInArrow(cut, schema)


def completions(room: int, counts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from what is left, least waste first, large pieces first.

    A filling is dominated when one piece of it could be swapped for a larger one that still fits,
    so per number of pieces only the fullest fillings are listed: one, two and three pieces; a
    smaller remainder is filled by best fit. ``lengths`` are those with a count, ascending.
    """
    fit = lengths[lengths <= room]
    if not len(fit):
        return [()]
    found: dict[tuple[int, ...], int] = {(int(fit[-1]),): room - int(fit[-1])}
    if found[(int(fit[-1]),)] == 0:
        return [(int(fit[-1]),)]

    def pair(space: int, taken: tuple[int, ...]) -> tuple[int, ...] | None:
        """The fullest two pieces within ``space``, the larger as large as can be."""
        usable = lengths[lengths < space]
        if not len(usable):
            return None
        partner = np.searchsorted(lengths, space - usable, side="right") - 1
        ok = partner >= 0
        a, b = usable[ok], lengths[partner[ok]]
        left, also = counts[a], counts[b]
        for x in taken:
            left, also = left - (a == x), also - (b == x)
        ok = (left > 0) & (also > (a == b)) & (a >= b)
        if not ok.any():
            return None
        a, b = a[ok], b[ok]
        k = len(a) - 1 - int(np.argmax((a + b)[::-1]))
        return int(a[k]), int(b[k])

    if two := pair(room, ()):
        found[two] = room - sum(two)
    if min(found.values()) > 0:
        for third in fit[::-1][:THIRDS].tolist():
            if two := pair(room - third, (third,)):
                filled = tuple(sorted((third, *two), reverse=True))
                found[filled] = room - sum(filled)
                if found[filled] == 0:
                    break
    if min(found.values()) > 0:
        filled, space = [], room
        left = {}
        for n in fit[::-1].tolist():
            have = left.get(n, int(counts[n]))
            while have and n <= space:
                filled.append(n)
                space, have = space - n, have - 1
        found[tuple(filled)] = space
    return [f for f, _ in sorted(found.items(), key=lambda x: (x[1], len(x[0])))][:BRANCHES]


def often(filling: tuple[int, ...], counts: np.ndarray) -> int:
    """How often a filling can be used with what is left."""
    sizes, many = np.unique(np.asarray(filling), return_counts=True)
    return int((counts[sizes] // many).min())


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing over the histogram: the largest piece, then ever the largest that fits."""
    counts, out = counts.copy(), []
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            filling, room = [largest], capacity - largest
            counts[largest] -= 1
            for n in range(min(room, largest), 0, -1):
                while n <= room and counts[n] - filling.count(n) * (n != largest) - (
                        (filling.count(n) - 1) * (n == largest)) > 0:
                    filling.append(n)
                    room -= n
                if not room:
                    break
            counts[largest] += 1
            times = max(1, often(tuple(filling), counts))
            np.subtract.at(counts, np.asarray(filling), times)
            out.append((tuple(filling), times))
    return out


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    """Lower bound: for each a, pieces above capacity - a stand alone, those above half share only
    what they leave with pieces of a to half the capacity."""
    n = np.arange(len(counts))
    many, volume = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * n)])
    half = capacity // 2
    a = np.arange(half + 1)
    alone = many[capacity + 1] - many[capacity - a + 1]
    large = many[capacity - a + 1] - many[half + 1]
    room = large * capacity - (volume[capacity - a + 1] - volume[half + 1])
    small = volume[half + 1] - volume[a]
    return int((alone + large + np.maximum(0, -(-(small - room) // capacity))).max())


def bin_completion(counts: np.ndarray, capacity: int, steps: int = SEARCH_STEPS) -> list[Pattern]:
    """Fillings and how often each is used; every counted piece is in exactly one.

    Depth first: around the largest piece left, the undominated fillings are tried, least waste
    first. A branch is cut when its waste so far rules out fewer sequences than the incumbent has,
    which best fit gives at first. The search ends at the lower bound or after ``steps``.
    """
    volume = int((np.arange(len(counts)) * counts).sum())
    least = least_sequences(counts, capacity)
    incumbent = best_fit(counts, capacity)
    best = sum(t for _, t in incumbent)
    left, chosen = counts.copy(), []
    stack: list[tuple[list[tuple[tuple[int, ...], int]], int]] = []
    waste, used, taken = 0, 0, 0

    def branch() -> list[Pattern]:
        nonlocal taken
        taken += 1
        lengths = np.flatnonzero(left)
        largest = int(lengths[-1])
        left[largest] -= 1
        lengths = np.flatnonzero(left)
        tried = completions(capacity - largest, left, lengths)
        left[largest] += 1
        return [((largest, *f), often((largest, *f), left)) for f in reversed(tried)]

    def undo() -> None:
        nonlocal waste, used
        filling, times = chosen.pop()
        np.add.at(left, np.asarray(filling), times)
        waste -= (capacity - sum(filling)) * times
        used -= times

    def bound() -> int:
        return -(-(volume + waste) // capacity)

    if not volume:
        return []
    stack.append((branch(), 0))
    while stack and best > least and taken < steps:
        options, depth = stack[-1]
        while len(chosen) > depth:
            undo()
        if not options:
            stack.pop()
            continue
        filling, times = options.pop()
        np.subtract.at(left, np.asarray(filling), times)
        chosen.append((filling, times))
        waste += (capacity - sum(filling)) * times
        used += times
        if bound() >= best:
            continue
        if not left.any():
            incumbent, best = list(chosen), used
            continue
        stack.append((branch(), len(chosen)))
    return incumbent


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id, offset`` to settled pieces with a ``length`` of 1 to ``capacity``.

    The histogram has at most ``capacity`` rows; it alone reaches the driver, and the slots that
    come back are a few per length and filling. Their number is bounded by the search, so the join
    against them may be broadcast.
    """
    spark = pieces.sparkSession
    seeded = pieces.withColumn("_order", F.xxhash64("doc_id", "piece", "ids_crc32"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in seeded.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    slots, first, served = [], 0, np.zeros(capacity + 1, dtype=np.int64)
    for filling, times in bin_completion(counts, capacity):
        at = 0
        sizes, many = np.unique(np.asarray(filling), return_counts=True)
        for n, m in sorted(zip(sizes.tolist(), many.tolist(), strict=True), reverse=True):
            slots.append((n, int(served[n]), int(served[n]) + m * times, m, first, at))
            served[n] += m * times
            at += n * m
        first += times
    table = spark.createDataFrame(
        pd.DataFrame(slots, columns=["length", "low", "high", "many", "first", "base"]).astype("int64"),
        "length long, low long, high long, many long, first long, base long")
    placed = ranked(seeded, ["length"], "_order", "_rank").withColumn("_rank", F.col("_rank") - 1)
    s = table.alias("s")
    inside = ((F.col("p.length") == F.col("s.length")) & (F.col("p._rank") >= F.col("s.low"))
              & (F.col("p._rank") < F.col("s.high")))
    nth = F.col("p._rank") - F.col("s.low")
    return (placed.alias("p").join(F.broadcast(s), inside)
            .select(*[F.col(f"p.{c}") for c in pieces.columns],
                    (F.col("s.first") + F.floor(nth / F.col("s.many"))).cast("long").alias("sequence_id"),
                    (F.col("s.base") + nth % F.col("s.many") * F.col("p.length")).alias("offset")))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0,
         id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenize whole documents, cut the longer ones and pack all pieces."""
    pieces = settle(token_pieces(docs, vocabulary, capacity, end_id, id_column, text_column, with_ids))
    return pack_pieces(pieces, capacity)
