"""Bounded groups in Arrow batches, and connected components of large edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import RANK_BUCKETS, ranked, settle


def _changes(batch: pa.RecordBatch, keys: list[int]) -> np.ndarray:
    """Rows, from 1 on, whose key differs from the row before."""
    changed = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for k in keys:
        coded = batch.column(k).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        changed |= coded[1:] != coded[:-1]
    return np.flatnonzero(changed) + 1


def map_groups(df: DataFrame, keys: list[str],
               function: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Call ``function`` on the rows of each key, streaming sorted partitions.

    As applyInPandas, without its cost per group; for many small groups of bounded size.
    """
    places = [df.columns.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def value(batch, row):
            return [batch.column(k)[row].as_py() for k in places]

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and value(held[-1], held[-1].num_rows - 1) != value(batch, 0):
                yield from function(pa.Table.from_batches(held))
                held = []
            at = 0
            for stop in _changes(batch, places).tolist():
                yield from function(pa.Table.from_batches([*held, batch.slice(at, stop - at)]))
                held, at = [], stop
            held.append(batch.slice(at))
        if held:
            yield from function(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def block_pairs(members: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Deal each group's members into blocks of about ``size`` and each block to every pair of blocks.

    Adds ``low, high, block``: the pair of blocks a row goes to, and the row's own. Every two
    members of a group meet in one pair of blocks (members of one block where low = high). Groups
    of up to ``size`` members, nearly all, are one block and are not copied.
    """
    counts = members.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    large = counts.where(F.col("_size") > size)
    few = members.join(large, group, "left_anti").select(
        "*", F.lit(0).alias("low"), F.lit(0).alias("high"), F.lit(0).alias("block"))
    many = (ranked(settle(members.join(large, group)), [group], order, "_rank", RANK_BUCKETS)
            .withColumn("_blocks", F.ceil(F.col("_size") / size).cast("int"))
            .withColumn("block", ((F.col("_rank") - 1) % F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("low", F.least("block", "_other")).withColumn("high", F.greatest("block", "_other"))
            .select(*members.columns, "low", "high", "block"))
    return few.unionByName(many)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest node each of ``n`` nodes reaches over the given edges."""
    roots = np.arange(n)
    while len(left):
        low = np.minimum(roots[left], roots[right])
        new = roots.copy()
        np.minimum.at(new, roots[left], low)
        np.minimum.at(new, roots[right], low)
        new = np.minimum(new, new[new])
        new = np.minimum(new[roots], new)
        if (new == roots).all():
            break
        roots = new
    return roots


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component``: the smallest node reachable, for every node with an edge ``a, b``.

    Large and small stars in turn: each node's neighbours are tied to its smallest one, until every
    edge leads to a component's smallest node. A round's edges are written to the shared folder;
    only their count and checksum come to the driver.
    """
    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Large: ties a node's greater neighbours to its smallest one; small: itself and the lesser."""
        if large:
            both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        tied = both.join(least, "a")
        if large:
            tied = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            tied = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                least.select("a", F.col("m").alias("b")))
        return tied.where(F.col("a") != F.col("b")).distinct()

    pairs = settle(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen or not now[0]:
            break
        seen = tuple(now)
        pairs = settle(star(star(pairs, True), False))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
