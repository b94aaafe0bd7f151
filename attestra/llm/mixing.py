"""Mix sources to target weights by subset-sum budget fitting.

Documents are counted by exact size per source. A source's target is met by whole passes over the
source, then by a bounded knapsack over the size counts for what remains, so the sum is as near the
target as the sizes allow. Seeded documents fill each size's count; where that needs more than the
documents of a size, all of them come again first, never over ``cap`` times.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its
own and comes last; repeated rows count as documents of their own; ties in the seeded order are
equal rows, so either may be taken; an empty table gives an empty result. Only the named columns
are read, so extra columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attestra.llm.common import as_row, ranked, settle

#: The knapsack fills a budget of at most this many times the largest size; whole documents of
#: every size, in seeded order, go before it.
KNAPSACK_SIZES = 4


def word_count(column: Column) -> Column:
    """Number of runs of anything but ASCII white space, without an array of the words."""
    marked = F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``source_key, source_size`` with ``target``: shares by weight, none above cap times its size.

    The sources that reach the cap are those with the smallest cap per weight. With the first k of
    that order at their cap, the others share the rest at one rate; the first k whose rate the next
    source can bear is the answer. One row per source, so the windows order names, not documents.
    """
    everything = Window.partitionBy(F.lit(1))
    place = F.row_number().over(everything.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (place % len(weights) + 1).cast("int"))
    capped = (totals.withColumn("weight", weight)
              .withColumn("most", F.col("source_size") * float(cap))
              .withColumn("bears", F.col("most") / F.col("weight")))
    before = everything.orderBy("bears", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    rates = (capped
             .withColumn("left", F.sum("source_size").over(everything).cast("double")
                         - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             .withColumn("sharing", F.sum("weight").over(everything)
                         - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
             .withColumn("rate", F.col("left") / F.col("sharing")))
    rate = F.min(F.when(F.col("rate") <= F.col("bears"), F.struct("bears", "source_key", "rate")))
    return (rates.withColumn("fair", rate.over(everything)["rate"])
            .withColumn("target", F.least(F.col("most"), F.coalesce(
                F.col("fair") * F.col("weight"), F.col("most"))))
            .select("source_key", "source_size", "target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int, repeats: int = 1) -> np.ndarray:
    """How many documents of each size to take, up to ``repeats`` times each, to come near the budget.

    The budget is below the sum of all. First the same share of each size, rounded down; then one more of each size in seeded order
    while over ``KNAPSACK_SIZES`` of the largest size remain; the rest by knapsack.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return counts.copy()
    taken = np.minimum(counts, np.floor(counts * (budget / total)).astype(np.int64))
    left = budget - int((sizes * taken).sum())
    while left < 0:  # floating point only
        i = int(np.argmax(taken))
        taken[i] -= 1
        left += int(sizes[i])
    order = np.random.default_rng(seed).permutation(len(sizes))
    bound = KNAPSACK_SIZES * int(sizes.max())
    while left > bound:
        before = left
        for i in order:
            if left <= bound:
                break
            if sizes[i] and taken[i] < counts[i] and sizes[i] <= left:
                taken[i] += 1
                left -= int(sizes[i])
        if left == before:
            break
    return taken + knapsack(sizes, counts * repeats - taken, left, order)


def knapsack(sizes: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray) -> np.ndarray:
    """The bounded knapsack nearest to the budget: each reachable sum keeps the first item that reached it.

    An item is a power-of-two bundle of one size. A sum first reached by item i came from a sum
    reached by earlier items only, so walking back uses each item once.
    """
    out = np.zeros(len(sizes), dtype=np.int64)
    if budget <= 0:
        return out
    # Sums beyond twice the budget are farther from it than nothing is.
    most = budget + min(budget, int(sizes.max()))
    reach = np.zeros(most + 1, dtype=bool)
    reach[0] = True
    first = np.full(most + 1, -1, dtype=np.int32)
    items: list[tuple[int, int]] = []
    for i in order:
        size, more, bundle = int(sizes[i]), int(counts[i]), 1
        if not size or size > most:
            continue
        more = min(more, most // size)
        while more > 0 and not reach[budget]:
            take = min(bundle, more)
            step = size * take
            new = reach[:-step] & ~reach[step:]
            first[step:][new] = len(items)
            reach[step:] |= new
            items.append((int(i), take))
            more, bundle = more - take, bundle * 2
        if reach[budget]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - budget))])
    while at:
        i, take = items[first[at]]
        out[i] += take
        at -= int(sizes[i]) * take
    return out


def mix_sources(docs: DataFrame, size: Column, id_column: str = "doc_id",
                source_column: str = "source", weights: tuple[int, ...] = (5, 2, 1),
                cap: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix repeats the document, 0 to ``cap``; ``taken`` is copies times
    size. Sources are ordered by code point with null last and get ``weights`` in turn, repeating.
    """
    named = F.concat(F.lit("s"), F.col(source_column))
    sized = settle(docs.select(
        F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"),
        F.coalesce(named, F.lit("z")).alias("source_key"), size.alias("size")).withColumn(
        "order", F.xxhash64(F.lit(seed), "doc_id", "source_key", "size")))
    counts = settle(sized.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(totals, weights, cap)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        budget = int(np.floor(target + 0.5))
        passes = min(cap, budget // whole) if whole else 0
        extra = np.zeros(len(rows), dtype=np.int64)
        if passes < cap and whole:
            extra = fit_counts(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64),
                               budget - passes * whole, seed, cap - passes)
        return pd.DataFrame({"source_key": rows["source_key"], "size": rows["size"],
                             "source_size": rows["source_size"], "target": rows["target"],
                             "passes": passes + extra // rows["n"], "extra": extra % rows["n"]})

    plan = (counts.join(targets, "source_key").groupBy("source_key").applyInPandas(
        fill, "source_key string, size long, source_size long, target double, passes long, extra long"))
    placed = ranked(sized, ["source_key", "size"], "order")
    copies = F.col("passes") + (F.col("rank") <= F.col("extra")).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    return (placed.join(settle(plan), ["source_key", "size"]).withColumn("copies", copies)
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def apply_mix(docs: DataFrame, size: Column, id_column: str = "doc_id", source_column: str = "source",
              weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as ``mix_sources`` takes it; all columns stay.

    Rows of equal id, source and size are told apart by number, which any of them may get.
    """
    mixed = settle(mix_sources(docs, size, id_column, source_column, weights, cap, seed)
                   .select(F.col("doc_id").alias("id"), "source", "size", "copies"))
    ours = docs.select(as_row(docs), F.col(id_column).alias("own_id"), F.col(source_column).alias("own_source"),
                       size.alias("own_size"))
    same = F.col("own_id").eqNullSafe(F.col("id"))
    if mixed.groupBy("id").count().where("count > 1").limit(1).count():
        mixed = mixed.withColumn("nth", F.row_number().over(
            Window.partitionBy("id", "source", "size").orderBy("copies")))
        ours = ours.withColumn("own_nth", F.row_number().over(
            Window.partitionBy("own_id", "own_source", "own_size").orderBy("own_size")))
        same = (same & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_size") == F.col("size"))
                & (F.col("own_nth") == F.col("nth")))
    taken = ours.join(mixed.where("copies > 0"), same)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
