"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Equal texts form one copy class and are compared once. Each class gets a MinHash signature in bands;
rows per band and bands are chosen for the target recall at the threshold. Classes meet in the
buckets of equal band hashes. A pair is verified in the first bucket it shares only, so a bucket
needs the texts of those members alone that have such a pair; large buckets are compared in pairs
of blocks. Tasks return each member's links and a spanning forest, never the pairs.

Words are what stands between white space, lower-cased; a text of fewer words than ``n`` has one
n-gram of all of them.

Defined cases: null, empty and blank texts have no n-grams and link with nothing, not even with
each other; repeated rows are copies; rows with a null id are compared as any other, and a class of
such rows only has a null class id; an empty table gives an empty result. Only the id and the text
are read, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import as_row, content_key, settle, text_or_empty
from attestra.llm.groups import block_pairs, components, local_roots, map_groups
from attestra.llm.shingles import shingle_hashes
from attestra.llm.tokens import slices

SLICE_CHARS = 2_000_000
#: Members of a block; two blocks are held by a task at a time.
BLOCK = 512


def choose_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """Bands and rows: the most rows per band (fewest false candidates) whose bands reach the recall.

    Up to ``most`` hashes; a threshold so low that not even bands of one row fit gets as many of
    those as the recall asks for.
    """
    def bands(rows: int) -> int:
        return int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold ** rows))))

    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall must lie between 0 and 1")
    rows = max((r for r in range(1, 33) if bands(r) * r <= most), default=1)
    return bands(rows), rows


def minhash_bands(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """One hash per text and band; texts without n-grams must not be passed."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1 << 62, size=(bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers((1 << 64) - 1, size=(bands, rows), dtype=np.uint64)
    out = np.empty((len(bounds) - 1, bands), dtype=np.uint64)
    starts = bounds[:-1]
    for b in range(bands):
        total = np.full(len(starts), np.uint64(b + 1))
        for r in range(rows):
            least = np.minimum.reduceat(grams * factors[b, r] + shifts[b, r], starts)
            total = (total ^ least) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
        out[:, b] = total
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int, id_type: str) -> DataFrame:
    """``doc_id, key`` and the band hashes (null without n-grams) of ``doc_id, key, text``."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_pandas().str.len().fillna(0).to_numpy(np.int64)
            for begin, stop in slices(sizes, SLICE_CHARS):
                part = batch.slice(begin, stop - begin)
                grams, bounds = shingle_hashes(part.column(2), n)
                some = np.diff(bounds) > 0
                lists: list = [None] * part.num_rows
                if some.any():
                    hashes = minhash_bands(grams, np.append(bounds[:-1][some], bounds[-1]), bands, rows, seed)
                    for i, row in zip(np.flatnonzero(some).tolist(), hashes.view(np.int64), strict=True):
                        lists[i] = row
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lists, pa.list_(pa.int64()))],
                    names=["doc_id", "key", "bands"])

    return docs.mapInArrow(sign, f"doc_id {id_type}, key string, bands array<long>")


def _band_matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.Array) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy().reshape(len(column), -1)


def first_meetings(bands: np.ndarray, band: int, across: np.ndarray | None) -> np.ndarray:
    """Which pairs of rows meet in no band before ``band``; ``across`` has each row's block."""
    n = len(bands)
    met = np.zeros((n, n), dtype=bool)
    for b in range(band):
        met |= bands[:, b][:, None] == bands[:, b][None, :]
    pairs = ~met
    if across is not None:
        pairs &= across[:, None] != across[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def needed(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The members of a bucket's pair of blocks that are to be compared here."""
    if table.num_rows < 2:
        return
    low, high = table["low"][0].as_py(), table["high"][0].as_py()
    across = table["block"].to_numpy() if low != high else None
    pairs = first_meetings(_band_matrix(table["bands"]), table["band"][0].as_py(), across)
    if (some := pairs.any(axis=1)).any():
        yield from table.filter(pa.array(some)).to_batches()


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the n-grams that two sets at least share."""
    n = len(grams)
    if n == 2:
        both = len(np.intersect1d(grams[0], grams[1], assume_unique=True))
        return np.array([[len(grams[0]), both], [both, len(grams[1])]], dtype=np.float32)
    row = np.repeat(np.arange(n), [len(g) for g in grams])
    _, column, count = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], column[keep]
    place = np.cumsum(count > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((n, n), dtype=np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [begin, begin + 4096])
        block = np.zeros((n, 4096), dtype=np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        out += block @ block.T
    return out


def verifier(n: int, threshold: float):
    """Links of each member of a group, weighted by copies, and its root in the local forest."""
    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        across = table["block"].to_numpy() if low != high else None
        pairs = first_meetings(_band_matrix(table["bands"]), table["band"][0].as_py(), across)
        flat, bounds = shingle_hashes(table["text"].combine_chunks(), n)
        grams = [np.unique(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        size = np.array([len(g) for g in grams], dtype=np.float64)
        both = overlaps(grams).astype(np.float64)
        # In whole numbers, so that a pair right at the threshold is a link.
        linked = pairs & (both * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-9)
        if not linked.any():
            return
        copies = table["copies"].to_numpy().astype(np.float64)
        links = (linked @ copies).astype(np.int64)
        left, right = np.nonzero(np.triu(linked))
        roots = local_roots(len(grams), left, right)
        some = links > 0
        yield pa.RecordBatch.from_arrays(
            [table["key"].combine_chunks().filter(pa.array(some)), pa.array(links[some]),
             table["key"].combine_chunks().take(pa.array(roots[some]))], names=["key", "links", "root"])
    return verify


def jaccard_classes(named: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995,
                    seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """All rows of ``doc_id, key, text`` as ``doc_id, key, blank``, and the copy classes.

    A class has ``key, copy_id`` (smallest id of its rows), ``copies, class_id, n_links`` and
    ``class_key``, the key of the class that gives ``class_id``.
    """
    kind = named.schema["doc_id"].dataType.simpleString()
    bands, rows = choose_bands(threshold, recall)
    signed = settle(signatures(named, n, bands, rows, seed, kind))
    classes = settle(signed.where(F.col("bands").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")))

    places = classes.select("key", F.posexplode("bands").alias("band", "bucket"))
    shared = places.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settle(places.join(shared.drop("n"), ["band", "bucket"]))
    here = block_pairs(
        members.join(classes.select("key", "copies", "bands"), "key")
        .withColumn("order", F.xxhash64("key", "bucket")), "bucket", "order", BLOCK)
    here = here.select("band", "bucket", "low", "high", "block", "key", "copies", "bands")
    schema = "band int, bucket long, low int, high int, block int, key string, copies long, bands array<long>"
    keys = ["band", "bucket", "low", "high"]
    asked = settle(map_groups(here, keys, needed, schema))

    wanted = asked.select("key").distinct().join(classes.select("key", "copy_id"), "key")
    texts = (named.join(wanted.withColumnRenamed("key", "wanted"),
                        F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("key") == F.col("wanted")))
             .select("key", "text").dropDuplicates(["key"]))
    found = settle(map_groups(asked.join(texts, "key"), keys, verifier(n, threshold),
                              "key string, links long, root string"))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    # Only linked classes are joined by component; the others have none to be dealt out by.
    tied = roots.withColumnRenamed("node", "key").join(classes.select("key", "copy_id"), "key")
    first = F.min(F.struct(F.col("copy_id").isNull().alias("none"), "copy_id", "key"))
    ids = tied.groupBy("component").agg(first.alias("first"))
    tied = tied.select("key", "component").join(ids, "component").select("key", "first")
    result = classes.select("key", "copy_id", "copies").join(tied, "key", "left").join(links, "key", "left").select(
        "key", "copy_id", "copies",
        F.when(F.col("first").isNull(), F.col("copy_id")).otherwise(F.col("first.copy_id")).alias("class_id"),
        F.coalesce("first.key", "key").alias("class_key"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return signed.select("doc_id", "key", F.col("bands").isNull().alias("blank")), result


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), content_key(text_or_empty(text_column)).alias("key"),
                       F.col(text_column).alias("text"))


def jaccard_join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995,
                 id_column: str = "doc_id", text_column: str = "text", seed: int = 29) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, copy_id, n_copies``.

    ``class_id`` is the smallest id of the documents reachable over links, ``n_links`` counts the
    documents linked directly (copies included), ``copy_id`` is the smallest id with the same text
    and ``n_copies`` how many rows have it.
    """
    signed, result = jaccard_classes(_named(docs, id_column, text_column), n, threshold, recall, seed)
    return signed.join(result, "key", "left").select(
        "doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995,
             id_column: str = "doc_id", text_column: str = "text", seed: int = 29) -> DataFrame:
    """The documents without near-duplicates: of each class the row with the smallest id stays.

    All columns stay. Blank texts are in no class and all stay; of equal rows with that id one does.
    """
    signed, result = jaccard_classes(_named(docs, id_column, text_column), n, threshold, recall, seed)
    kept = signed.join(result, "key", "left").where(
        F.col("blank") | (F.col("doc_id").eqNullSafe(F.col("copy_id")) & (F.col("key") == F.col("class_key"))))
    kept = settle(kept.groupBy("doc_id", "key", "blank").agg(F.count(F.lit(1)).alias("rows")))
    ours = docs.select(as_row(docs), F.col(id_column).alias("own_id"),
                       content_key(text_or_empty(text_column)).alias("own_key"))
    out = ours.join(kept, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key")))
    repeated = (F.col("rows") > 1) & ~F.col("blank")
    if kept.where(repeated).limit(1).count():
        out = out.where(~repeated).unionByName(out.where(repeated).dropDuplicates(["doc_id", "key"]))
    return out.select("row.*")
