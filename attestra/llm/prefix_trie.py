"""The trie of conversation prefixes, from sorted shards and a skeleton of the paths that divide them.

A conversation is a path: 20 bytes a turn, a digest of role and text and the text's length. Equal
paths are one row per 4,096 conversation numbers, so thousands of copies are few rows. A sample of
the paths gives the splitters; paths go to the shard between two splitters and are sorted there. A
node is a prefix, its members are neighbours in that order, so a node with members in two shards is
a prefix of the splitter between them. These prefixes are the skeleton, a small trie that every task
gets. A shard walks its sorted paths once and finishes every other node by itself; for a skeleton
node it gives a partial sum, and partial sums are added up and then along the skeleton.

No text is gathered: a row holds at most one conversation's path. A splitter has at most
``SPLITTER_TURNS`` turns, so the skeleton has at most that many nodes per shard. A shard keeps the
open nodes of one path and the finished children of those.

Defined cases: null turns come first, equal turns by role and then by digest; a null role or text is
empty; rows without ``conv_id`` belong to no conversation and are left out; repeated rows are turns
of their own; a conversation without turns ends at the root; texts of any length are one digest; an
empty table gives no node, not even a root. Only the named columns are read, so extra columns cannot
clash.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import settle, text_or_empty

#: Bytes of a turn within a path: an MD5 digest and the text's code points.
TURN_BYTES = 20
#: A chunk of a node's ending conversations spans two to this power numbers.
CHUNK_BITS = 12
#: Sampled paths per shard, and turns of a sampled path.
SAMPLED, SPLITTER_TURNS = 32, 512
#: Skeletons up to this many nodes are broadcast; their parents are joined by shuffle beyond.
BROADCAST_NODES = 500_000

NODE = ("skeleton int, above int, depth long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NAMES = [column.split()[0] for column in NODE.split(", ")]
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, path``: each conversation's turns in order, as bytes."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.md5(F.concat(F.char_length(role), F.lit(":"), role, text).cast("binary"))
    element = F.concat(digest, F.lpad(F.hex(F.char_length(text)), 8, "0"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(
            F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"),
            role.alias("role"), element.alias("element")).alias("turn"))
    ordered = F.array_sort(F.collect_list("turn"))
    return turns.groupBy("conv_id").agg(
        F.unhex(F.array_join(F.transform(ordered, lambda t: t["element"]), "")).alias("path"))


def first_turns(path: Column, n: Column) -> Column:
    return F.substring(path, F.lit(1), n * TURN_BYTES)


def after_turns(path: Column, n: Column) -> Column:
    return F.substring(path, n * TURN_BYTES + 1, F.length(path))


def shared_turns(left: bytes, right: bytes) -> int:
    """How many turns two paths have in common at their start."""
    n, most = 0, min(len(left), len(right)) // TURN_BYTES
    while n < most and left[n * TURN_BYTES:(n + 1) * TURN_BYTES] == right[n * TURN_BYTES:(n + 1) * TURN_BYTES]:
        n += 1
    return n


class Skeleton:
    """The trie of the splitters: every node whose members may lie in more than one shard."""

    def __init__(self, splitters: list[bytes]):
        self.splitters = splitters
        self.ids: dict[bytes, int] = {b"": 0}
        for path in splitters:
            for n in range(1, len(path) // TURN_BYTES + 1):
                self.ids.setdefault(path[:n * TURN_BYTES], len(self.ids))

    @classmethod
    def of_sample(cls, paths: list[bytes], shards: int) -> Skeleton:
        """Evenly spaced sampled paths, each cut after the turn that tells it from the one before."""
        ordered = sorted(set(paths))
        chosen = sorted({len(ordered) * k // shards for k in range(1, shards)} - {0})
        return cls(sorted({ordered[k][:(shared_turns(ordered[k - 1], ordered[k]) + 1) * TURN_BYTES]
                           for k in chosen if k < len(ordered)}))

    def shard(self, path: bytes) -> int:
        return bisect.bisect_right(self.splitters, path)

    def table(self) -> list[tuple]:
        """``skeleton, above, depth, chars, n_inner, line``: inner children, and the way from the root."""
        inner = [0] * len(self.ids)
        rows, lines = [], {}
        for prefix, i in self.ids.items():
            above = self.ids[prefix[:-TURN_BYTES]] if prefix else None
            lines[i] = [*lines[above], i] if prefix else [i]
            if prefix:
                inner[above] += 1
            rows.append((i, above, len(prefix) // TURN_BYTES, int.from_bytes(prefix[-4:])))
        return [(*row, inner[row[0]], lines[row[0]]) for row in rows]


class Walk:
    """One pass over sorted paths: open nodes from the root to the current path's end."""

    def __init__(self, ids: dict[bytes, int]):
        self.ids = ids
        self.path: bytes | None = None
        self.open: list[dict] = []
        self.digest = None
        self.rows: list[tuple] = []

    def add(self, path: bytes, conversations: str, n: int, least: int) -> None:
        """Conversations that end at ``path``: their numbers in order, count and smallest."""
        if path != self.path:
            keep = shared_turns(self.path, path) + 1 if self.path is not None else 0
            self.close(keep)
            for depth in range(keep, len(path) // TURN_BYTES + 1):
                # Prefixes of a node outside the skeleton lead to no skeleton node.
                inside = not depth or self.open[-1]["skeleton"] >= 0
                prefix = path[:depth * TURN_BYTES] if inside else b""
                self.open.append({
                    "skeleton": self.ids.get(prefix, -1) if inside else -1, "depth": depth, "n": 0,
                    "least": None, "children": 0, "leaves": 0, "saved": 0, "ends": EMPTY, "waiting": [],
                    "chars": int.from_bytes(path[depth * TURN_BYTES - 4:depth * TURN_BYTES]) if depth else 0})
            self.path, self.digest = path, hashlib.sha256(conversations.encode())
        else:
            self.digest.update(b"," + conversations.encode())
        node = self.open[-1]
        node["n"] += n
        node["least"] = least if node["least"] is None else min(node["least"], least)

    def close(self, keep: int) -> None:
        """Finish the open nodes from depth ``keep`` on."""
        if self.open and self.digest is not None:
            self.open[-1]["ends"], self.digest = self.digest.hexdigest(), None
        while len(self.open) > keep:
            node = self.open.pop()
            above = self.open[-1] if self.open else None
            self.rows += [(-1, -1, d, c, node["least"], *rest) for d, c, *rest in node["waiting"]]
            row = [node["depth"], node["least"], node["n"], node["children"], node["leaves"], node["saved"],
                   node["ends"]]
            if above is not None:
                above["n"] += node["n"]
                above["least"] = node["least"] if above["least"] is None else min(above["least"], node["least"])
            if node["skeleton"] >= 0:
                self.rows.append((node["skeleton"], -1, row[0], row[1], None, *row[2:]))
                continue
            row[4] = node["leaves"] or 1
            row[5] += (node["n"] - 1) * node["chars"]
            above["children"] += 1
            above["leaves"] += row[4]
            above["saved"] += row[5]
            if above["skeleton"] >= 0:
                self.rows.append((-1, above["skeleton"], row[0], row[1], None, *row[2:]))
            else:
                above["waiting"].append(row)

    def finished(self) -> pa.RecordBatch:
        types = [pa.int32()] * 2 + [pa.int64()] * 7 + [pa.string()]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(NAMES)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=NAMES)


def walk_shards(members: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The nodes of each shard: finished ones, and a partial sum of each skeleton node (``skeleton`` >= 0)."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [skeleton.shard(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = Walk(skeleton.ids), None
        for batch in batches:
            for to, path, _, conversations, n, least in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                if to != shard:
                    at.close(0)
                    at.path, shard = None, to
                at.add(path, conversations, n, least)
                if len(at.rows) >= 10_000:
                    yield at.finished()
        at.close(0)
        yield at.finished()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    dealt = members.mapInArrow(deal, f"shard int, {kinds}")
    return dealt.repartition(len(skeleton.splitters) + 1, "shard").sortWithinPartitions(
        "shard", "path", "chunk").mapInArrow(walk, NODE)


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """A row per different prefix of the paths of ``conv_id, path``; ``conv_id`` names one path.

    ``conv_id`` (the smallest member) and ``depth`` name a node; ``parent_conv_id`` and depth - 1 its
    parent. ``n_convs`` members, ``n_children``, ``n_leaves`` and ``saved_tokens`` of its subtree, and
    the digest of the conversations that end there.
    """
    spark = paths.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.array_sort(F.collect_list("conv_id"))
    members = settle(paths.groupBy("path", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(ids, ",").alias("conversations"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")))
    rows = members.count()
    sample = members.select(first_turns(F.col("path"), F.lit(SPLITTER_TURNS)).alias("path"))
    if rows > SAMPLED * shards:
        sample = sample.sample(SAMPLED * shards / rows, seed=1)
    skeleton = Skeleton.of_sample([bytes(r["path"]) for r in sample.collect()], shards)
    nodes = settle(walk_shards(members, skeleton))

    inner = spark.createDataFrame(
        skeleton.table(), "skeleton int, above int, depth long, chars long, n_inner long, line array<int>")
    partial = nodes.where(F.col("skeleton") >= 0).groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in (
            "n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends_sha256"))
    own = settle(partial.join(inner, "skeleton").withColumn("n_children", F.col("n_children") + F.col("n_inner")))
    sums = own.select(F.explode("line").alias("skeleton"), F.when(F.col("n_children") == 0, F.lit(1)).otherwise(
        F.col("n_leaves")).alias("n_leaves"), (
            F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")).groupBy(
        "skeleton").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    columns = NAMES[2:]
    whole = own.drop("n_leaves", "saved_tokens").join(sums, "skeleton")
    lowest = own.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("_parent"))
    if len(skeleton.ids) <= BROADCAST_NODES:
        lowest = F.broadcast(lowest)
    top = whole.join(lowest, "above", "left").withColumn("parent_conv_id", F.col("_parent"))
    rest = nodes.where(F.col("skeleton") < 0).join(lowest, "above", "left").withColumn(
        "parent_conv_id", F.coalesce("_parent", "parent_conv_id"))
    return top.select(columns).unionAll(rest.select(columns))
