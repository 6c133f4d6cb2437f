"""Nearest neighbours: a graph by NN-descent in Spark joins, searched greedily.

Equal vectors are one node.  Random-projection trees, fitted on a bounded sample,
put nodes into leaves; exact neighbours within leaves start the graph.  Then each
round joins every node's neighbours and reverse neighbours with their vectors and
compares them with each other, until a round changes hardly any list.  A query walks
the graph from the nodes of its leaves, a round of joins for all queries at once, until
its best nodes are all expanded.  The graph is made in single precision; distances of
a walk, and so scores, are those of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import discarded, written

#: Neighbours kept for each node, and nodes that a search keeps.
DEGREE, WIDTH = 24, 256
#: Descent ends with the round that changes at most this share of the kept neighbours.
SETTLED = 0.01
#: Trees, nodes of a leaf, and the bound of the fit: vectors that the trees are fitted on, at least LEAST of them in a leaf.
TREES, LEAF, FIT_ROWS, LEAST = 4, 256, 20_000, 8
_EDGES = "id long, near array<struct<d:float,id:long>>"


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _near_lists(ids: np.ndarray, d: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of the square matrix d the take least others: their distances and ids, nearest first."""
    np.fill_diagonal(d, np.inf)
    take = min(take, len(ids) - 1)
    at = np.argpartition(d, take - 1, axis=1)[:, :take]
    order = np.argsort(np.take_along_axis(d, at, 1), axis=1)
    at = np.take_along_axis(at, order, 1)
    return np.take_along_axis(d, at, 1), ids[at]


def _squares(x: np.ndarray) -> np.ndarray:
    n = np.einsum("ij,ij->i", x, x)
    return np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)


def _edge_batch(ids: np.ndarray, d: list[np.ndarray], near: list[np.ndarray]) -> pa.RecordBatch:
    lengths = np.array([len(x) for x in d])
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    items = pa.StructArray.from_arrays([pa.array(np.concatenate(d).astype(np.float32)), pa.array(np.concatenate(near).astype(np.int64))], ["d", "id"])
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, items)], ["id", "near"])


def fit_trees(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 3) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Per tree and level: the normals and thresholds of its 2^level nodes; medians of the sample."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        node, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            normals = rng.standard_normal((1 << level, sample.shape[1])).astype(np.float32)
            cut = np.zeros(1 << level, np.float32)
            side = np.zeros(len(sample), np.int64)
            for k in range(1 << level):
                own = np.flatnonzero(node == k)
                if len(own) > 1:  # the line between two sampled vectors
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    if (a != b).any():
                        normals[k] = a - b
                    value = sample[own] @ normals[k]
                    cut[k] = np.median(value)
                    side[own] = value > cut[k]
            node = node * 2 + side
            levels.append((normals, cut))
        out.append(levels)
    return out


def _leaves(trees: list) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"))
            for t, levels in enumerate(trees):
                node = np.zeros(len(x), np.int64)
                for normals, cut in levels:
                    node = node * 2 + (np.einsum("ij,ij->i", x, normals[node]) > cut[node])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(node), batch.column("id"), batch.column("vec")], ["tree", "leaf", "id", "vec"])

    return run


def _leaf_graph(table: pa.Table) -> pa.Table:
    ids = table.column("id").to_numpy()
    if len(ids) < 2:
        return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("d", pa.float32()), ("id", pa.int64())])))})
    d, near = _near_lists(ids, _squares(_matrix(table.column("vec"))), DEGREE)
    return pa.Table.from_batches([_edge_batch(ids, list(d), list(near))])


def _nearest_of_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row the DEGREE nearest distinct ids of near."""
    for batch in batches:
        near = batch.column("near")
        d, to = near.flatten().field("d").to_numpy(), near.flatten().field("id").to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(near.offsets.to_numpy()))
        order = np.lexsort((d, to, row))
        row, to, d = row[order], to[order], d[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (to[1:] != to[:-1])
        row, to, d = row[first], to[first], d[first]
        order = np.lexsort((to, d, row))
        row, to, d = row[order], to[order], d[order]
        start = np.searchsorted(row, np.arange(batch.num_rows))
        keep = np.arange(len(row)) - start[row] < DEGREE
        row, to, d = row[keep], to[keep], d[keep]
        offsets = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
        items = pa.StructArray.from_arrays([pa.array(d), pa.array(to)], ["d", "id"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, items)], ["id", "near"])


def _merged(edges: DataFrame) -> DataFrame:
    """The DEGREE nearest distinct neighbours of each node over all its lists."""
    return edges.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near")).mapInArrow(_nearest_of_lists, _EDGES)


def _both_ways(graph: DataFrame) -> DataFrame:
    """(v, u): each node's neighbours and at most DEGREE nodes that have it as neighbour, nearest first."""
    forward = graph.select(F.col("id").alias("v"), F.explode("near").alias("e")).select("v", F.col("e.id").alias("u"), F.col("e.d").alias("d"))
    order = Window.partitionBy("u").orderBy("d", "v")
    back = forward.withColumn("k", F.row_number().over(order)).where(F.col("k") <= DEGREE).select(F.col("u").alias("v"), F.col("v").alias("u"))
    return forward.select("v", "u").unionByName(back).distinct()


def _local_joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares the members of each neighbourhood; what is nearer than a member's worst goes to it."""
    for batch in batches:
        offsets = batch.column("members").offsets.to_numpy()
        items = batch.column("members").values
        ids, worst = items.field("u").to_numpy(), items.field("worst").to_numpy()
        x = _matrix(items.field("vec"))
        owner, far, near = [], [], []
        for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
            if hi - lo < 2:
                continue
            d = _squares(x[lo:hi])
            np.fill_diagonal(d, np.inf)
            better = d < worst[lo:hi, None]
            for i in np.flatnonzero(better.any(axis=1)):
                j = np.flatnonzero(better[i])
                owner.append(ids[lo + i])
                far.append(d[i, j])
                near.append(ids[lo + j])
        if owner:
            yield _edge_batch(np.array(owner), far, near)


def fitted_trees(nodes: DataFrame) -> list:
    """Trees for nodes (id, vec), from the FIT_ROWS of least hash; leaves hold about LEAF nodes as far as the sample allows."""
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vec").toArrow().column("vec")
    depth = int(min(np.ceil(np.log2(max(1, n / LEAF))), max(0, np.floor(np.log2(max(1, len(sample) / LEAST))))))
    return fit_trees(_matrix(sample), depth)


def in_leaves(nodes: DataFrame, trees: list) -> DataFrame:
    """tree, leaf, part, id, vec; a leaf that holds much more than its share (one that the sample cannot split) has parts."""
    placed = nodes.mapInArrow(_leaves(trees), f"tree int, leaf long, id long, vec {dict(nodes.dtypes)['vec']}")
    size = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * LEAF)).cast("long").alias("parts"))
    return placed.join(size, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))


def neighbour_graph(nodes: DataFrame, placed: DataFrame, *, settled: float = SETTLED) -> DataFrame:
    """id and near, the DEGREE nearest nodes found, for nodes (id, vec) placed in leaves.

    Lists only ever get nearer, so rounds end.
    """
    start = placed.select("tree", "leaf", "part", "id", "vec").groupBy("tree", "leaf", "part").applyInArrow(_leaf_graph, _EDGES)
    graph = written(_merged(start), "graph")
    while True:
        worst = F.when(F.size("near") >= DEGREE, F.element_at("near", -1)["d"]).otherwise(F.lit(float("inf"))).cast("float")
        known = nodes.join(graph.select("id", worst.alias("worst")), "id", "left").select(F.col("id").alias("u"), "vec", F.coalesce("worst", F.lit(float("inf")).cast("float")).alias("worst"))
        groups = _both_ways(graph).join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "vec", "worst")).alias("members"))
        found = written(groups.mapInArrow(_local_joins, _EDGES), "found")
        before, graph = graph, written(_merged(graph.unionByName(found)), "graph")
        old = before.select("id", F.col("near.id").alias("was"))
        fresh = graph.join(old, "id", "left").agg(F.sum(F.size(F.array_except("near.id", F.coalesce("was", F.array().cast("array<long>"))))), F.sum(F.size("near"))).first()
        discarded(before, found)
        if (fresh[0] or 0) <= settled * (fresh[1] or 0):
            return graph


def _distance(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x))")


def graph_search(nodes: DataFrame, placed: DataFrame, graph: DataFrame, targets: DataFrame, trees: list) -> DataFrame:
    """(q, id, d): the WIDTH nearest nodes found for each target (q, vec), itself not left out.

    The walk starts at the nodes of the target's leaves.  Each step expands all
    of the best that have not been, until none is left.
    """
    adjacent = written(_both_ways(graph).groupBy("v").agg(F.collect_list("u").alias("adjacent")), "adjacent")

    def best_of(pairs: DataFrame, state: DataFrame | None) -> DataFrame:
        near = pairs.join(nodes, "id").join(targets.select("q", F.col("vec").alias("qv")), "q").select("q", _distance("qv", "vec").alias("d"), "id", F.lit(False).alias("done"))
        if state is not None:
            # the expanded entry of a node comes after its fresh one and takes its place
            near = near.unionByName(state.select("q", F.explode("best").alias("b")).select("q", "b.d", "b.id", "b.done"))
        listed = near.groupBy("q").agg(F.array_sort(F.collect_set(F.struct("d", "id", "done"))).alias("all"))
        last = F.filter("all", lambda x, i: (i == F.size("all") - 1) | (F.get(F.col("all"), i + 1)["id"] != x["id"]))
        return written(listed.select("q", F.slice(last, 1, WIDTH).alias("best")), "state")

    at = targets.select(F.col("q").alias("id"), "vec").mapInArrow(_leaves(trees), f"tree int, leaf long, id long, vec {dict(targets.dtypes)['vec']}").select("tree", "leaf", F.col("id").alias("q"))
    # of a leaf in parts a target looks at one, as the others are as good a start
    start = at.join(placed.where("part = 0").select("tree", "leaf", "id"), ["tree", "leaf"]).select("q", "id").distinct()
    state = best_of(start, None)
    while True:  # a node is expanded once for a target and never comes back undone, so walks end
        open_ = state.select("q", F.explode(F.filter("best", lambda x: ~x["done"])).alias("b")).select("q", F.col("b.id").alias("v"))
        if open_.isEmpty():
            break
        # every open entry is expanded in this step
        expanded = state.select("q", F.transform("best", lambda x: F.struct(x["d"].alias("d"), x["id"].alias("id"), F.lit(True).alias("done"))).alias("best"))
        fresh = open_.join(adjacent, "v").select("q", F.explode("adjacent").alias("id")).distinct()
        before, state = state, best_of(fresh, expanded)
        discarded(before)
    return state.select("q", F.explode("best").alias("b")).select("q", "b.id", "b.d")


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for the rows that is_query holds for, their k nearest others found.

    score is the Euclidean distance in double precision; nearest first, ties to
    the smaller vec_id; fewer than k rows where there are fewer others.  Vectors
    null, all zero, with null or non-finite components, of another length than
    the commonest (ties: the longer), or with a null id take no part, as query or
    candidate.  Equal vectors are searched as one and come back as rows of their
    own.  Of rows that repeat an id the one of least vector counts; the id is a
    query if any of them is.  Other columns are ignored; an empty table, or one
    without queries, gives an empty result.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    valid = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vec"), is_query.alias("asked"))
    valid = valid.where("vec_id is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    lengths = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    length = lengths[0][0] if lengths else 0
    valid = valid.where(F.size("vec") == length).groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max(F.coalesce("asked", F.lit(False))).alias("asked"))
    valid = written(valid, "valid")
    nodes = written(valid.groupBy("vec").agg(F.min("vec_id").alias("id")).select("id", "vec"), "nodes")
    node_of = written(valid.join(nodes, "vec").select("vec_id", "id", "asked"), "members")
    trees = fitted_trees(nodes)
    placed = written(in_leaves(nodes, trees), "placed")
    graph = neighbour_graph(nodes, placed)
    asked = node_of.where("asked").select(F.col("vec_id").alias("query_id"), F.col("id").alias("q"))
    targets = written(asked.select(F.col("q").alias("id")).distinct().join(nodes, "id").select(F.col("id").alias("q"), "vec"), "targets")
    found = graph_search(nodes, placed, graph, targets, trees)
    found = found.unionByName(targets.select("q", F.col("q").alias("id"), F.lit(0.0).alias("d"))).groupBy("q", "id").agg(F.min("d").alias("d"))
    # of copies only the first k + 1 can be among the k nearest
    copies = node_of.withColumn("c", F.row_number().over(Window.partitionBy("id").orderBy("vec_id"))).where(F.col("c") <= k + 1).select("id", "vec_id")
    rows = asked.join(found, "q").join(copies, "id").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))


def op3_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
