"""Remove byte strings of a given length that occur more than once, found by suffix arrays.

Every window of ``length`` bytes has an anchor, its smallest hashed 16-byte gram, so equal windows
have equal anchors. Windows of one anchor stay together as a piece of text, and an anchor that
occurs once cannot repeat. Pieces are dealt into shards by anchor; equal pieces are one. Each shard
refines its suffix array (Larsson-Sadakane) up to ``length`` bytes; windows that then share a rank with a
neighbour in suffix order repeat. The pieces of an anchor with
more text than a shard holds are texts of their own with anchors of longer grams, and so on up to whole
windows: each round keeps only what shares a longer string with another piece. What is left then (runs
of one character) is dealt over several shards; these are merged by fingerprints of their window
classes, each shard's sorted run searched in the others by binary search.

Equal texts enter once: of a text that occurs twice, everything repeats. Matches never cross
documents, strings are judged on the input, and a text is cut where memory asks for it only with
the overlap that keeps all windows.

Defined cases: null and empty texts have 0 bytes and nothing removed; texts under ``length`` bytes
keep all; runs of one character are covered like anything else; repeated rows are equal texts, so
they repeat; null ids are treated as any other; an empty table gives an empty result. Only the id
and the text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_row, content_key, discard, settle, settle_by, settle_last, text_or_empty
from attestra.llm.groups import map_groups
from attestra.llm.suffix_array import _marked, repeated_starts

#: Bytes of the grams that anchors come from.
GRAM = 16
#: Bytes of text that a task looks at together, and bytes of pieces in a shard.
SLICE_BYTES = 600_000
SHARD_BYTES = 800_000
#: Rows of a run of window fingerprints.
RUN_ROWS = 200_000


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of strings and where each begins and ends; nulls are empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, offsets if len(column) else np.zeros(1, dtype=np.int64)


def finer_gram(gram: int, length: int) -> int:
    """Bytes of the grams after those of ``gram`` bytes: a quarter of the rest of a window stays out."""
    return length - (length - gram) // 4


def gram_hashes(text: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes, 16 or more, from each place on."""
    padded = np.concatenate([text, np.zeros(GRAM, dtype=np.uint8)])
    word = np.ndarray((len(text) + 8,), dtype="<u8", buffer=padded.data, strides=(1,)).astype(np.uint64)
    h = word[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    size = GRAM
    while size < gram:  # two grams, which may overlap, make a longer one
        step = min(size, gram - size)
        ahead = np.zeros_like(h)
        ahead[:-step] = h[step:]
        h = h * np.uint64(0x9E3779B97F4A7C15) + ahead
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        size += step
    return h


def anchor_ranges(text: np.ndarray, last: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Ranges of window starts with one anchor: ``hash, first start, last start, several``.

    ``last`` has for each place the last start of its own text, so a place beyond it starts no
    window. The smallest gram is the first of those with equal hashes; ranges of equal hashes that
    follow each other are one, so a text of few different grams stays one range; ``several`` says
    that its anchor stands at several places, so that it may repeat in itself.
    """
    n, width = len(text), length - gram + 1
    hashes = gram_hashes(text, gram)
    # The upper hash bits and the place, so that the least number is the first of the smallest.
    packed = hashes >> np.uint64(24) << np.uint64(24) | np.arange(n, dtype=np.uint64)
    rows = -(-(n + width) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    grid[:n] = packed
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[width - 1:n + width - 1])
    starts = np.flatnonzero(np.arange(n) <= last)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, starts, np.zeros(0, dtype=bool)
    place = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    anchor = hashes[place]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (last[starts[1:]] != last[starts[:-1]])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(starts)) - 1
    return anchor[first], starts[first], starts[final], place[first] != place[final]


def _segments(offsets: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Batches of ``row, begin, end`` within their text, about ``SLICE_BYTES`` together."""
    held, total = [], 0
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        size, begin = b - a, 0
        while size - begin >= length:
            end = min(size, begin + SLICE_BYTES + length - 1)
            if held and total + end - begin > SLICE_BYTES + length:
                yield held
                held, total = [], 0
            held.append((row, begin, end))
            total += end - begin
            begin = end - length + 1
    if held:
        yield held


def find_anchors(texts: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``key, anchors`` of each row of ``key, text`` with a window: an anchor of a text once, with its places."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes_of(batch.column(1))
            for segments in _segments(offsets, length):
                text = np.concatenate([raw[offsets[r] + a:offsets[r] + b] for r, a, b in segments])
                sizes = np.array([b - a for _, a, b in segments])
                ends = np.cumsum(sizes)
                hashes, first, final, several = anchor_ranges(text, np.repeat(ends - length, sizes), length, gram)
                which = np.searchsorted(ends, first, side="right")
                shift = np.array([a for _, a, _ in segments]) - (ends - sizes)
                order = np.lexsort((first, hashes, which))
                hashes, which, several = hashes[order], which[order], several[order]
                first, final = first[order] + shift[which], final[order] + shift[which]
                begins = np.flatnonzero(_marked(hashes, which))
                bounds = np.append(begins, len(hashes)).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(
                    [pa.array(first), pa.array(final)], ["first", "last"]))
                again = np.logical_or.reduceat(several, begins) | (np.diff(bounds) > 1)
                found = pa.StructArray.from_arrays(
                    [pa.array(hashes[begins].view(np.int64)), pa.array(again), places], ["anchor", "several", "places"])
                owned = np.searchsorted(which[begins], np.arange(len(segments) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r for r, _, _ in segments])),
                     pa.ListArray.from_arrays(pa.array(owned), found)], names=["key", "anchors"])

    return texts.select("key", "text").mapInArrow(
        find, "key string, anchors array<struct<anchor: long, several: boolean, places: array<struct<first: long, "
        "last: long>>>>")


def cut_pieces(texts: DataFrame, length: int) -> DataFrame:
    """``key, anchor, bytes, piece_id, firsts`` for each piece of ``key, text, ranges``.

    64 bits tell the pieces of one anchor apart; with the anchor's own 64 they name a piece. A piece
    that a text has several times is one row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes_of(batch.column(1))
            ranges = batch.column(2)
            found: dict[tuple, list[int]] = {}
            for row in range(batch.num_rows):
                text = raw[offsets[row]:offsets[row + 1]].tobytes()
                for r in ranges[row].as_py():
                    for place in r["places"]:
                        piece = text[place["first"]:place["last"] + length]
                        found.setdefault((row, r["anchor"], len(piece), xxhash.xxh3_64_intdigest(piece)),
                                         []).append(place["first"])
                if found and (len(found) > RUN_ROWS or row == batch.num_rows - 1):
                    owner, anchor, size, digest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(owner)), pa.array(anchor, pa.int64()), pa.array(size, pa.int64()),
                         pa.array(np.array(digest, dtype=np.uint64).view(np.int64)),
                         pa.array(list(found.values()), pa.list_(pa.int64()))],
                        names=["key", "anchor", "bytes", "piece_id", "firsts"])
                    found = {}

    return texts.mapInArrow(run, "key string, anchor long, bytes long, piece_id long, firsts array<long>")


def piece_texts(texts: DataFrame, length: int) -> DataFrame:
    """``shard, anchor, piece_id, split, piece`` for each range of ``key, text, ranges``."""
    kinds = [pa.int64()] * 3 + [pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes_of(batch.column(1))
            ranges = batch.column(2)
            rows, pieces, total = [], [], 0
            for row in range(batch.num_rows):
                begin = int(offsets[row])
                for r in ranges[row].as_py():
                    rows.append((r["shard"], r["anchor"], r["piece_id"], r["split"]))
                    pieces.append(raw[begin + r["first"]:begin + r["last"] + length].tobytes())
                    total += len(pieces[-1])
                if rows and (total > SLICE_BYTES or row == batch.num_rows - 1):
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], names=[
                        "shard", "anchor", "piece_id", "split", "piece"])
                    rows, pieces, total = [], [], 0

    return texts.mapInArrow(run, "shard long, anchor long, piece_id long, split boolean, piece binary")


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of consecutive places: first and last."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(),
                    strict=True))


SHARD_ROWS = ("shard long, anchor long, piece_id long, low long, high long, classes array<struct<print: string, "
              "at: long, open: boolean>>")


def shard_repeats(length: int):
    """Ranges of repeated starts of each piece of a shard; class fingerprints of split anchors."""
    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pieces = table["piece"].to_pylist()
        split = table["split"].to_pylist()
        sizes = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts, again, classes = repeated_starts(text, sizes, length)
        del text
        begins = np.cumsum(sizes) - sizes
        which = np.searchsorted(begins, starts, side="right") - 1
        bounds = np.searchsorted(which, np.arange(len(pieces) + 1))
        seen: set[int] = set()
        out: dict[str, list] = {k: [] for k in ("anchor", "piece_id", "low", "high", "classes")}

        def row(k: int, low, high, prints) -> None:
            for name, value in zip(out, (table["anchor"][k].as_py(), table["piece_id"][k].as_py(), low, high, prints),
                                   strict=True):
                out[name].append(value)

        for k in range(len(pieces)):
            own, repeated = starts[bounds[k]:bounds[k + 1]] - begins[k], again[bounds[k]:bounds[k + 1]]
            for low, high in _ranges(own[repeated]):
                row(k, low, high, None)
            if split[k]:
                prints = []
                for at, c, r in zip(own.tolist(), classes[bounds[k]:bounds[k + 1]].tolist(), repeated.tolist(),
                                    strict=True):
                    if c not in seen:
                        seen.add(c)
                        prints.append({"print": xxhash.xxh3_128_hexdigest(pieces[k][at:at + length]),
                                       "at": at, "open": not r})
                if prints:
                    row(k, None, None, prints)
        shard = table["shard"][0].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(out["anchor"]), pa.int64()), pa.array(out["anchor"], pa.int64()), pa.array(out["piece_id"], pa.int64()),
             pa.array(out["low"], pa.int64()), pa.array(out["high"], pa.int64()),
             pa.array(out["classes"], pa.list_(pa.struct([("print", pa.string()), ("at", pa.int64()),
                                                          ("open", pa.bool_())])))],
            names=["shard", "anchor", "piece_id", "low", "high", "classes"])
        pa.default_memory_pool().release_unused()
    return search


def merge_shards(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Starts whose window class another shard has too: each shard's run is searched in the others."""
    prints = np.array([int(p, 16) % (1 << 63) for p in table["print"].to_pylist()], dtype=np.int64)
    shard = table["shard"].to_numpy()
    ordered = np.sort(prints)
    found = np.zeros(len(prints), dtype=bool)
    for s in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == s)
        run = np.sort(prints[mine])
        everywhere = (np.searchsorted(ordered, prints[mine], side="right")
                      - np.searchsorted(ordered, prints[mine], side="left"))
        here = np.searchsorted(run, prints[mine], side="right") - np.searchsorted(run, prints[mine], side="left")
        found[mine] = everywhere > here
    hit = pa.array(found & table["open"].to_numpy())
    part = table.filter(hit)
    if part.num_rows:
        yield pa.RecordBatch.from_arrays([part["anchor"].combine_chunks(), part["piece_id"].combine_chunks(),
                                          part["at"].combine_chunks(), part["at"].combine_chunks()],
                                         names=["anchor", "piece_id", "low", "high"])


def _used(ranges: list[dict], more: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each range of starts at each place of its piece, the end ``more`` bytes on."""
    for r in ranges:
        for first in r["firsts"]:
            yield first + r["low"], first + r["high"] + more


def merged_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, low, high``: the disjoint ranges of repeated starts of each text of ``key, ranges``."""
    for batch in batches:
        rows: list[list] = []
        for key, ranges in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            begin = len(rows)
            for low, high in sorted(_used(ranges.as_py(), 0)):
                if len(rows) > begin and low <= rows[-1][2] + 1:
                    rows[-1][2] = max(rows[-1][2], high)
                else:
                    rows.append([key, low, high])
        if rows:
            key, low, high = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["key", "low", "high"])


SPAN_ROWS = ("key string, n_removed long, spans array<struct<start: long, stop: long>>, kept binary, "
             "kept_text string")


def merged_spans(length: int):
    """One row per text: its disjoint removed spans, and what is left of it."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = _bytes_of(batch.column(1))
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                removed, spans, kept, decoded = [], [], [], []
                for i, ranges in enumerate(part.column(2)):
                    joined: list[list[int]] = []
                    for low, high in sorted(_used(ranges.as_py(), length)):
                        if joined and low <= joined[-1][1]:
                            joined[-1][1] = max(joined[-1][1], high)
                        else:
                            joined.append([low, high])
                    text = raw[offsets[at + i]:offsets[at + i + 1]]
                    edges = [0, *(x for span in joined for x in span), len(text)]
                    kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    decoded.append(kept[-1].decode("utf-8", "ignore"))
                    removed.append(sum(b - a for a, b in joined))
                    spans.append([{"start": a, "stop": b} for a, b in joined])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                     pa.array(kept, pa.binary()), pa.array(decoded, pa.string())],
                    names=["key", "n_removed", "spans", "kept", "kept_text"])

    return merge


def repeated_anchors(named: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``key, ranges`` of each text of ``key, text`` with anchors that stand at several places."""
    anchors = settle(find_anchors(named, length, gram))
    # Copies have the same anchors; a class needs them once, but a long text has several rows.
    # Keys travel as their 16 bytes.
    once = anchors.select(F.unhex("key").alias("key"), F.explode("anchors").alias("r")).select("key", "r.*")
    text, first = F.xxhash64("key"), F.col("places")[0]["first"]
    repeated = once.groupBy("anchor").agg(
        F.min(text).alias("a"), F.max(text).alias("b"), F.min(first).alias("c"), F.max(first).alias("d"),
        F.max("several").alias("e")).where("a <> b or c <> d or e").select("anchor")
    wanted = settle(once.join(repeated, "anchor").groupBy("key").agg(F.array_sort(F.collect_set(
        F.struct("places", "anchor"))).alias("ranges")).withColumn("key", F.lower(F.hex("key"))))
    discard(anchors)
    return wanted


def repeated_ranges(texts: DataFrame, length: int, gram: int = GRAM) -> DataFrame:
    """``key, ranges``: repeated starts of the texts of a settled table ``key, text, ranges``.

    A range is ``firsts, low, high``: from ``low`` to ``high`` bytes after each of ``firsts``.
    """
    uses = settle(cut_pieces(texts.select("key", "text", "ranges"), length))
    different = settle(uses.groupBy("anchor", "piece_id").agg(
        F.min(F.struct("key", F.col("firsts")[0].alias("first"))).alias("at"), F.first("bytes").alias("bytes"),
        F.sum(F.size("firsts")).alias("uses")))
    # A piece with several uses repeats as a whole; it is searched where its anchor has others too.
    by_anchor = different.groupBy("anchor").agg(
        F.sum("bytes").alias("total"), F.min("uses").alias("fewest")).where("fewest = 1").drop("fewest")
    whole, most = by_anchor.agg(F.sum("total"), F.max("total")).first()
    shards = max(1, (whole or 0) // SHARD_BYTES + 1)
    shares = F.ceil(F.col("total") * 2 / F.lit(SHARD_BYTES)).cast("int")
    name = F.lower(F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("anchor", "piece_id")]))
    dealt = (different.join(by_anchor, "anchor")
             .withColumn("split", shares > 1)
             .withColumn("share", F.when(shares > 1, F.pmod(F.xxhash64("piece_id"), shares)).otherwise(F.lit(0)))
             .withColumn("shard", F.pmod(F.xxhash64("anchor", "share"), F.lit(shards)))
             .select(F.col("at.key").alias("key"), F.col("at.first").alias("first"), "anchor", "piece_id", "bytes",
                     "split", "shard"))

    def texts_of(chosen: DataFrame) -> DataFrame:
        # A text's pieces bring their shard along, so their bytes move once.
        places = chosen.groupBy("key").agg(F.collect_list(F.struct(
            "first", (F.col("first") + F.col("bytes") - length).alias("last"), "anchor", "piece_id", "split",
            "shard")).alias("ranges"))
        return piece_texts(texts.select("key", "text").join(places, "key"), length)

    finer = None
    if most and most * 2 > SHARD_BYTES and gram < length:
        heavy = settle(texts_of(dealt.where("split")).select(name.alias("key"), F.col("piece").alias("text")))
        finer = finer_gram(gram, length)
        inner = settle(heavy.join(repeated_anchors(heavy, length, finer), "key"))
        discard(heavy)
        finer = repeated_ranges(inner, length, finer).mapInArrow(merged_starts, "key string, low long, high long")
        dealt = dealt.where("not split")
    found = settle(map_groups(texts_of(dealt).select("shard", "anchor", "piece_id", "split", "piece"), ["shard"],
                              shard_repeats(length), SHARD_ROWS))
    ranges = found.where(F.col("low").isNotNull()).select("anchor", "piece_id", "low", "high")
    if finer is None:
        classes_at = found.where(F.col("classes").isNotNull()).select(
            "shard", "anchor", "piece_id", F.explode("classes").alias("c")).select(
            "shard", "anchor", "piece_id", F.col("c.print").alias("print"), F.col("c.at").alias("at"),
            F.col("c.open").alias("open"))
        runs = max(1, (found.agg(F.sum(F.size("classes"))).first()[0] or 0) // RUN_ROWS)
        ranges = ranges.unionByName(map_groups(
            classes_at.withColumn("run", F.pmod(F.xxhash64("print"), F.lit(runs))).select(
                "run", "shard", "anchor", "piece_id", "print", "at", "open"),
            ["run"], merge_shards, "anchor long, piece_id long, low long, high long"))
    else:
        once = different.where("uses = 1").select(name.alias("key"), "anchor", "piece_id")
        ranges = ranges.unionByName(finer.join(once, "key").select("anchor", "piece_id", "low", "high"))
    # A piece that several places share repeats as a whole.
    shared = different.where("uses > 1").select(
        "anchor", "piece_id", F.lit(0).cast("long").alias("low"), (F.col("bytes") - length).cast("long").alias("high"))
    return uses.join(ranges.unionByName(shared), ["anchor", "piece_id"]).groupBy("key").agg(
        F.collect_list(F.struct("firsts", "low", "high")).alias("ranges"))


def repeated_text(named: DataFrame, length: int = 400) -> DataFrame:
    """``key, n_removed, spans, kept, kept_text`` of every text of ``doc_id, key, text`` that loses bytes.

    ``spans`` are byte ranges, ``kept`` the other bytes, ``kept_text`` those read as UTF-8 without
    the parts of characters that a removal has cut. Texts with copies lose
    everything.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = settle(named.select("doc_id", "key", size.alias("size")))
    classes = rows.where(F.col("size") >= length).groupBy("key").agg(
        F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
    chosen = repeated_anchors(named, length).join(classes, "key").select(
        F.col("key").alias("wanted"), "least", "copies", "ranges")
    texts = named.join(chosen, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("key") == F.col("wanted"))).select(
        "key", "text", "ranges", "copies")
    if rows.groupBy("key", "doc_id").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["key"])
    texts = settle_by(texts, "key")

    single = texts.where("copies = 1").select("key", "text").join(repeated_ranges(texts, length), "key")
    lost = single.select("key", "text", "ranges").mapInArrow(
        merged_spans(length), SPAN_ROWS)
    copies = classes.where("copies > 1").select(
        "key", F.col("size").cast("long").alias("n_removed"),
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("stop"))).alias("spans"),
        F.lit(b"").cast("binary").alias("kept"), F.lit("").alias("kept_text"))
    return lost.unionByName(copies)


def repeated_within(named: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """As ``repeated_text``, from the spans of a shorter length, a settled table ``key, spans``.

    Every shorter string within a repeated window repeats as well, so a window lies in one of the
    spans. Those of ``length`` bytes and more are searched as texts of their own; a span of a text
    that has copies is given twice, so that it is a copy too.
    """
    long = F.filter("spans", lambda s: s["stop"] - s["start"] >= length)
    first = named.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    chosen = shorter.select("key", long.alias("long")).where(F.size("long") > 0).join(first, "key").select(
        F.col("key").alias("wanted"), "least", "copies", "long")
    texts = settle(named.join(chosen, F.col("doc_id").eqNullSafe(F.col("least")) & (F.col("key") == F.col("wanted")))
                   .select("key", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "copies", "long")
                   .dropDuplicates(["key"]))
    spans = texts.select(F.col("key").alias("whole"), "text", "copies", F.explode("long").alias("s")).select(
        "whole", "copies", F.col("s.start").alias("start"), F.expr(
            "substring(text, cast(s.start + 1 as int), cast(s.stop - s.start as int))").alias("text"))
    spans = settle(spans.withColumn("key", F.md5("text")))
    given = spans.select(
        "key", "text", "whole", "start", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(2)).cast("int"))).alias("i"))
    found = repeated_text(given.select(F.concat_ws(":", "whole", "start", "i").alias("doc_id"), "key", "text"), length)
    ranges = spans.select("key", "whole", "start").join(found.select("key", F.explode("spans").alias("s")), "key").select(
        F.col("whole").alias("key"), F.struct(
            F.array("start").alias("firsts"), F.col("s.start").alias("low"),
            (F.col("s.stop") - length).alias("high")).alias("r")).groupBy("key").agg(F.collect_list("r").alias("ranges"))
    return texts.select("key", "text").join(ranges, "key").select("key", "text", "ranges").mapInArrow(
        merged_spans(length), SPAN_ROWS)


def remove_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id",
                   text_column: str = "text", passage: int | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256``.

    With ``passage``, a shorter length, also ``passage_bytes, n_passages``: what would go at that length.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn(
        "key", content_key(text_or_empty("text")))
    passages = None
    if passage is None:
        lost = repeated_text(named, length)
    else:
        # What the shorter windows needed is gone before the search for the longer ones begins.
        passages = settle_last(lambda: repeated_text(named, passage).select("key", "n_removed", "spans"))
        lost = repeated_within(named, passages, length)
    lost = lost.select("key", "n_removed", "spans", F.sha2("kept", 256).alias("sha"))
    if passages is not None:
        lost = passages.select("key", F.col("n_removed").alias("passage_bytes"),
                               F.size("spans").cast("long").alias("n_passages")).join(lost, "key", "left")
    whole = named.select("doc_id", "key", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"),
                         F.sha2(text_or_empty("text").cast("binary"), 256).alias("whole_sha"))
    nothing = F.array().cast("array<struct<start: bigint, stop: bigint>>")
    more = [] if passages is None else ["passage_bytes", "n_passages"]
    return whole.join(lost, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("spans", nothing).alias("spans"), F.coalesce("sha", "whole_sha").alias("kept_sha256"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in more])


def without_repeats(docs: DataFrame, length: int = 400, text_column: str = "text",
                    id_column: str = "doc_id") -> DataFrame:
    """The documents with their repeated bytes removed from the text; all columns stay.

    What is left is read as UTF-8, without the parts of characters that a removal has cut.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumn(
        "key", content_key(text_or_empty("text")))
    lost = repeated_text(named, length)
    left = lost.select("key", F.col("kept_text").alias("left"))
    joined = docs.select(as_row(docs), content_key(text_or_empty(text_column)).alias("key")).join(left, "key", "left")
    changed = F.coalesce("left", F.col("row").getField(text_column)).alias(text_column)
    return joined.select(*[changed if c == text_column else F.col("row").getField(c).alias(c) for c in docs.columns])
