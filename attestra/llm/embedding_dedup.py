"""Near-duplicate vectors by NN-descent, with exact links at the end.

Vectors are compared only within a block (equal label and dimension). Equal vectors are one node.
A first graph comes from sorting each block by sign codes of random planes and comparing runs of
neighbours; then rounds of NN-descent compare, around every node, its neighbours and those that
have it as a neighbour, and keep the best. Linked sets, the nodes reachable over links, are compared
in pairs of blocks in double precision, so within a set no link is lost or invented.

A list of which every entry is a link is saturated: links to another set may have been displaced
from it. Sets with such a list are therefore cut into cells around pivots, the pivots of a block are
compared in pairs of blocks, and cells that can touch by the angles of their pivots are compared
member by member; sets with a link between them become one.
Recall is audited against brute force on a sample that grows until it holds ``LINKED`` nodes with
links. While it is too low the lists are doubled and descent goes on. If recall has not been shown
when the rounds end, or the largest sample holds too few linked nodes to show it, all nodes of a
block are compared in pairs of blocks: exact, with time by the square of a block.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label, link with nothing; repeated rows are copies and link with each other; a null id
is compared as any other and is never kept; an empty table gives an empty result. Only the named
columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import content_key, ranked, settle
from attestra.llm.groups import block_pairs, components, local_roots, map_groups

#: Neighbours a node keeps, nodes of a run of the first graph, sorts it comes from.
NEIGHBOURS = 10
RUN = 32
SORTS = 6
#: Neighbours by reverse edges that one task compares around a node; more are dealt into several.
REVERSE = 24
#: Members of a block of a linked set; a task holds two blocks.
BLOCK = 1024
#: Nodes the audit asks at first and at most, nodes with links it must see, and the recall it must show.
AUDITED = 400
AUDITED_MOST = 25_600
LINKED = 200
RECALL = 0.99
#: Single precision may be off by so much; links are decided in double precision.
SLACK = 1e-4


def vector_nodes(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """``vec_id, key`` of all rows, and the block and vector of those that can link."""
    v = F.col("vector")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    named = vectors.select(F.col(id_column).alias("vec_id"), F.col(label_column).cast("string").alias("label"),
                           F.col(vector_column).cast("array<double>").alias("vector"))
    return named.withColumn("block", F.when(F.coalesce(usable, F.lit(False)), F.concat_ws(
        ":", "label", F.size("vector").cast("string")))).select(
        "vec_id", "block", F.when(F.col("block").isNotNull(), v).alias("vector")).withColumn(
        "key", content_key(F.col("block"), F.concat_ws(",", F.col("vector").cast("array<string>"))))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors as rows, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _best(nodes: np.ndarray, others: np.ndarray, sims: np.ndarray, worst: np.ndarray, most: int) -> pa.RecordBatch:
    """For each row of ``sims`` the up to ``most`` best columns above the row's worst."""
    most = min(most, sims.shape[1])
    top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(sims, top, axis=1)
    row, k = np.nonzero(value > worst[:, None])
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[row]), pa.array(others[top[row, k]]), pa.array(value[row, k].astype(np.float64))],
        names=["node", "other", "sim"])


LOG = logging.getLogger(__name__)
EDGE = "node long, other long, sim double"


def sign_codes(nodes: DataFrame, sorts: int, seed: int) -> DataFrame:
    """``node, block, sort, code``: 63 signs against the random planes of each sort."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2).value_lengths())
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                unit = _matrix(part.column(2))
                planes = np.random.default_rng([seed, size]).standard_normal((sorts, 64, size))
                for s in range(sorts):
                    bits = (unit @ planes[s].T > 0).astype(np.uint64) << np.arange(63, -1, -1, dtype=np.uint64)
                    codes = np.bitwise_or.reduce(bits, axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(np.full(len(codes), s, np.int32)),
                         pa.array(codes)], names=["node", "block", "sort", "code"])

    return nodes.select("node", "block", "vector").mapInArrow(
        code, "node long, block string, sort int, code long")


def compare_run(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """The best neighbours of each node within a run."""
    if table.num_rows < 2:
        return
    unit = _matrix(table["vector"]).astype(np.float32)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    nodes = table["node"].to_numpy()
    yield _best(nodes, nodes, sims, np.full(len(nodes), -2.0), NEIGHBOURS)


def compare_around(most: int):
    """Pairs of neighbours of one node that improve a list of up to ``most``."""
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        nodes, first = np.unique(table["node"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        unit = _matrix(table["vector"]).astype(np.float32)
        sims = unit @ unit.T
        np.fill_diagonal(sims, -2)
        yield _best(nodes, nodes, sims, table["worst"].to_numpy() + 1e-7, most)
    return compare


def keep_best(edges: DataFrame, most: int) -> DataFrame:
    """``node, near``: each node's best neighbours, best first. A node has few candidates."""
    found = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    return found.groupBy("node").agg(F.slice(F.sort_array(
        F.collect_list(F.struct("sim", "other")), asc=False), 1, most).alias("near"))


def first_graph(nodes: DataFrame, seed: int) -> DataFrame:
    """Lists from runs of each block's order by sign codes."""
    codes = settle(sign_codes(nodes, SORTS, seed))
    runs = ranked(codes, ["block", "sort"], "code").withColumn("run", F.floor((F.col("rank") - 1) / RUN)).select(
        "block", "sort", "run", "node").join(nodes.select("node", "vector"), "node")
    return keep_best(map_groups(runs, ["block", "sort", "run"], compare_run, EDGE), NEIGHBOURS)


def descend(lists: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Candidate edges of one round: all pairs among the neighbours of a node, both directions.

    A node that very many have as neighbour gets several parts of at most about ``REVERSE`` of
    them, each with the node's own neighbours.
    """
    forward = lists.select(F.col("node").alias("center"), F.explode("near.other").alias("node"))
    back = forward.select(F.col("node").alias("center"), F.col("center").alias("node"))
    parts = back.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / REVERSE).cast("int").alias("parts"))
    back = back.join(parts, "center").withColumn("part", F.pmod(F.xxhash64("node", "center"), F.col("parts")).cast("int"))
    ahead = forward.join(parts, "center", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    itself = lists.select(F.col("node").alias("center"), "node").join(parts, "center", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    around = (ahead.select("center", "part", "node").unionAll(back.select("center", "part", "node"))
              .unionAll(itself.select("center", "part", "node")))
    worst = lists.select("node", F.when(F.size("near") < most, F.lit(-2.0)).otherwise(
        F.element_at("near.sim", -1)).alias("worst"))
    members = around.join(nodes.select("node", "vector").join(worst, "node"), "node")
    return map_groups(members.select("center", "part", "node", "worst", "vector"), ["center", "part"],
                      compare_around(most), EDGE)


def exact_links(threshold: float):
    """Links of each member of a linked set's pair of blocks, and its root in the local forest."""
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        unit = _matrix(table["vector"])
        linked = unit @ unit.T >= threshold
        np.fill_diagonal(linked, False)
        if low != high:
            own = table["block"].to_numpy()
            linked &= own[:, None] != own[None, :]
        links = (linked @ table["copies"].to_numpy().astype(np.float64)).astype(np.int64)
        nodes = table["node"].to_numpy()
        left, right = np.nonzero(np.triu(linked))
        roots = local_roots(len(nodes), left, right)
        some = links > 0
        yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]),
                                          pa.array(nodes[roots[some]])], names=["node", "links", "root"])
    return compare


def cells_of(threshold: float):
    """Cells of a part of a set: each member goes to the first pivot it links with, else becomes one."""
    def cut(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit = _matrix(table["vector"])
        nodes = table["node"].to_numpy()
        pivot, cos = np.full(len(nodes), -1), np.ones(len(nodes))
        for k in range(len(nodes)):
            if pivot[k] < 0:
                left = np.flatnonzero(pivot < 0)
                sims = unit[left] @ unit[k]
                own = (sims >= threshold) | (left == k)
                pivot[left[own]], cos[left[own]] = k, sims[own]
        angle = np.where(pivot == np.arange(len(nodes)), 0.0, np.arccos(np.clip(cos, -1, 1)))
        yield pa.RecordBatch.from_arrays([table["component"].combine_chunks(), pa.array(nodes), pa.array(nodes[pivot]),
                                          pa.array(angle)], names=["component", "node", "cell", "angle"])
    return cut


def touching_cells(threshold: float):
    """Pairs of cells of different sets whose pivots are near enough for a link between members."""
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        unit = _matrix(table["vector"])
        radius, sets, cells = (table[c].to_numpy() for c in ("radius", "component", "cell"))
        bound = np.minimum(np.pi, np.arccos(threshold) + radius[:, None] + radius[None, :] + SLACK)
        near = (unit @ unit.T >= np.cos(bound)) & (sets[:, None] != sets[None, :])
        if low != high:
            own = table["block"].to_numpy()
            near &= own[:, None] != own[None, :]
        a, b = np.nonzero(np.triu(near))
        yield pa.RecordBatch.from_arrays([pa.array(cells[a]), pa.array(cells[b])], names=["one", "two"])
    return compare


def link_between(threshold: float):
    """The sets of two cells, if any of their members link."""
    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        unit, sets = _matrix(table["vector"]), table["component"].to_numpy()
        first = sets == sets.min()
        if (unit[first] @ unit[~first].T >= threshold).any():
            yield pa.RecordBatch.from_arrays([pa.array([sets.min()]), pa.array([sets.max()])], names=["a", "b"])
    return compare


def joined_sets(sets: DataFrame, lists: DataFrame, nodes: DataFrame, threshold: float, most: int) -> DataFrame:
    """``sets`` with those made one that hold saturated lists and have a link between them."""
    full = lists.where((F.size("near") >= most) & (F.element_at("near.sim", -1) >= threshold - SLACK))
    dense = sets.join(full.select("node"), "node").groupBy("component").agg(F.lit(True).alias("dense"))
    members = settle(sets.join(dense.select("component"), "component"))
    if members.select("component").distinct().limit(2).count() < 2:
        return sets
    parts = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    vectors = nodes.select("node", F.col("block").alias("kind"), "vector")
    dealt = members.join(parts, "component").withColumn(
        "part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(vectors, "node")
    cells = settle(map_groups(dealt.select("component", "part", "node", "vector"), ["component", "part"],
                              cells_of(threshold), "component long, node long, cell long, angle double"))
    pivots = settle(cells.groupBy("component", "cell").agg(F.max("angle").alias("radius")).join(
        vectors.withColumnRenamed("node", "cell"), "cell").withColumn("order", F.xxhash64("cell")))
    met = block_pairs(pivots, "kind", "order", BLOCK)
    touching = settle(map_groups(met.select("kind", "low", "high", "block", "component", "cell", "radius", "vector"),
                                 ["kind", "low", "high"], touching_cells(threshold), "one long, two long"))
    either = touching.select("one", "two", F.col("one").alias("cell")).unionAll(
        touching.select("one", "two", F.col("two").alias("cell")))
    faced = either.join(cells.select("component", "node", "cell"), "cell").join(nodes.select("node", "vector"), "node")
    links = settle(map_groups(faced.select("one", "two", "component", "vector"), ["one", "two"],
                              link_between(threshold), "a long, b long").distinct())
    if links.isEmpty():
        return sets
    one = components(links).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return sets.join(one, "component", "left").select("node", F.coalesce("whole", "component").alias("component"))


def linked_sets(lists: DataFrame, nodes: DataFrame, threshold: float, most: int) -> DataFrame:
    """``node, links, root`` parts: every link within the sets that the lists and dense sets' links connect."""
    near = lists.select("node", F.explode("near").alias("n")).where(F.col("n.sim") >= threshold - SLACK)
    sets = settle(components(near.select(F.col("node").alias("a"), F.col("n.other").alias("b"))))
    sets = joined_sets(sets, lists, nodes, threshold, most)
    return compare_sets(sets.join(nodes.select("node", "copies", "vector"), "node"), threshold)


def compare_sets(members: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root`` parts: every link between ``node, copies, vector`` of one ``component``."""
    members = members.select("component", "node", "copies", "vector").withColumn("order", F.xxhash64("node"))
    dealt = block_pairs(members, "component", "order", BLOCK)
    return map_groups(dealt.select("component", "low", "high", "block", "node", "copies", "vector"),
                      ["component", "low", "high"], exact_links(threshold), "node long, links long, root long")


def audit(nodes: DataFrame, found: DataFrame, threshold: float, seed: int, asked: int) -> tuple[float, int]:
    """Recall of a seeded sample of ``asked`` nodes, and how many of them have links.

    Recall is the share of all their links that were found, or the mean share per linked node if
    that is less, so that large sets do not hide small ones.
    """
    sample = nodes.orderBy(F.xxhash64(F.lit(seed), "node")).limit(asked).select("node", "block", "vector").toArrow()
    kinds = np.array(sample["block"].to_pylist())
    by_block = {}
    for kind in np.unique(kinds).tolist():
        part = sample.filter(pa.array(kinds == kind))
        by_block[kind] = part["node"].to_numpy(), _matrix(part["vector"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = np.array(batch.column(1).to_pylist())
            for block, (names, unit) in by_block.items():
                part = batch.filter(pa.array(blocks == block))
                for at in range(0, part.num_rows, BLOCK):
                    some = part.slice(at, BLOCK)
                    true = unit @ _matrix(some.column(3)).T >= threshold
                    true &= names[:, None] != some.column(0).to_numpy()[None, :]
                    links = (true @ some.column(2).to_numpy().astype(float)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names[links > 0]), pa.array(links[links > 0])],
                                                     names=["node", "true"])

    true = (nodes.select("node", "block", "copies", "vector").mapInArrow(count, "node long, true long")
            .groupBy("node").agg(F.sum("true").alias("true")))
    have = F.least("true", F.coalesce("links", F.lit(0)))
    linked, links, had, mean = true.join(
        found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").agg(
        F.count(F.lit(1)), F.sum("true"), F.sum(have), F.avg(have / F.col("true"))).first()
    return (min(had / links, mean) if linked else 1.0), linked


def shown(nodes: DataFrame, found: DataFrame, threshold: float, seed: int, total: int) -> bool | None:
    """Whether ``found`` has the recall; None if the largest sample has too few linked nodes to tell."""
    asked = AUDITED
    while True:
        recall, linked = audit(nodes, found, threshold, seed, asked)
        LOG.info("audit: asked %d of %d nodes, %d with links, recall %.4f", min(asked, total), total, linked, recall)
        if linked >= LINKED or asked >= total:
            return recall >= RECALL
        if asked >= AUDITED_MOST:
            return None
        asked = min(AUDITED_MOST, max(4 * asked, round(1.3 * asked * LINKED / max(1, linked)) if linked else 0))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id",
                    vector_column: str = "embedding", label_column: str = "label", rounds: int = 6,
                    least_new: float = 0.01, seed: int = 5) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Rounds of descent end when fewer than ``least_new`` of the list entries are new.
    """
    rows = settle(vector_nodes(vectors, id_column, vector_column, label_column))
    nodes = settle(rows.where(F.col("block").isNotNull()).groupBy("key").agg(
        F.first("block").alias("block"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"),
        F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()))
    total, most = nodes.count(), NEIGHBOURS
    lists = settle(first_graph(nodes, seed))
    enough = None
    for k in range(rounds):
        better = settle(descend(lists, nodes, most))
        new = better.select("node", "other").distinct().count()
        lists = settle(keep_best(lists.select("node", F.explode("near").alias("n")).select(
            "node", "n.other", "n.sim").unionByName(better), most))
        if new <= least_new * total * most or k == rounds - 1:
            found = settle(linked_sets(lists, nodes, threshold, most))
            enough = shown(nodes, found, threshold, seed, total)
            if enough or enough is None:
                break
            most *= 2
    if not enough:
        LOG.warning("recall of %.2f not shown: all nodes of a block are compared", RECALL)
        found = settle(compare_sets(nodes.withColumn("component", F.col("block")).drop("block"), threshold))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    sets = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # Only linked nodes are joined by component; the others have none to be dealt out by.
    tied = sets.join(nodes.select("node", "least"), "node")
    smallest = tied.groupBy("component").agg(F.min("least").alias("first"))
    tied = tied.select("node", "component").join(smallest, "component").select("node", "first")
    named = nodes.select("node", "key", "copies", "least").join(tied, "node", "left").join(links, "node", "left")
    result = named.select(
        "key", F.coalesce("first", "least").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return (rows.select("vec_id", F.when(F.col("block").isNotNull(), F.col("key")).alias("key"))
            .join(result, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
