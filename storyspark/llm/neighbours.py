"""Approximate nearest neighbours: a forest of random-projection trees and one queue for each query.

The trees are grown on a bounded sample of the vectors (``SAMPLE``, those with the smallest hash of
their id) and are broadcast; every vector is then sent to its leaf in each tree. A query walks all
trees through one shared priority queue: the branch whose worst margin so far is best comes next,
whatever its tree, until the leaves reached hold ``SEARCH`` of the sample. Candidates are the vectors in
those leaves; their distances are computed exactly.

Equal vectors are one candidate with its smallest ids, so a vector that a third of all rows share loads
no leaf. Leaves and the queries that reach them are cut into chunks of at most about ``CHUNK`` rows, and
each pair of chunks yields only the nearest few of each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, written

TREES = 6
SAMPLE = 20_000
#: Sample vectors in a leaf.
LEAF = 128
#: Share of the sample, summed over all trees, that a query's leaves hold. Vectors without structure
#: need a large one for a recall of 0.9; clustered ones would do with a small part of it.
SEARCH = 1.2
CHUNK = 4096


@dataclass
class Tree:
    normals: np.ndarray  # inner nodes x dimensions
    offsets: np.ndarray
    children: np.ndarray  # inner nodes x 2; a negative child -1-k is leaf k
    sizes: np.ndarray  # sample vectors in each leaf


def grow(sample: np.ndarray, draw: np.random.Generator, leaf: int = LEAF) -> Tree:
    """Split by the plane between two random vectors, at the median; equal halves keep the tree even."""
    normals, offsets, children, sizes = [], [], [], []
    todo = [(np.arange(len(sample)), -1, 0)]
    root = None
    while todo:
        rows, parent, side = todo.pop()
        cut = None
        for _ in range(3 if len(rows) > leaf else 0):
            a, b = sample[draw.choice(rows, 2, replace=False)]
            normal = (a - b).astype(np.float64)
            if size := np.linalg.norm(normal):
                along = sample[rows] @ (normal / size)
                middle = float(np.median(along))
                if 0 < (low := along <= middle).sum() < len(rows):
                    cut = (normal / size, middle, rows[low], rows[~low])
                    break
        if cut is None:
            name = -1 - len(sizes)
            sizes.append(len(rows))
        else:
            name = len(offsets)
            normals.append(cut[0])
            offsets.append(cut[1])
            children.append([0, 0])
            todo += [(cut[2], name, 0), (cut[3], name, 1)]
        if parent < 0:
            root = name
        else:
            children[parent][side] = name
    if root < 0:  # the sample fits in one leaf: one plane that sends all to it
        normals, offsets, children = [np.zeros(sample.shape[1])], [0.0], [[-1, -1]]
    return Tree(np.array(normals), np.array(offsets), np.array(children), np.array(sizes))


def leaves(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    node = np.zeros(len(vectors), np.int64)
    live = np.arange(len(vectors))
    while len(live):
        at = node[live]
        right = np.einsum("ij,ij->i", vectors[live], tree.normals[at]) > tree.offsets[at]
        node[live] = tree.children[at, right.astype(np.int64)]
        live = live[node[live] >= 0]
    return -1 - node


def probes(forest: list[Tree], vector: np.ndarray, search: float) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs of a query, best first, from one queue over all trees."""
    margins = [t.normals @ vector - t.offsets for t in forest]
    queue = [(-np.inf, t, 0) for t in range(len(forest))]
    want, found = search * forest[0].sizes.sum(), []
    while queue and want > 0:
        worst, t, node = heapq.heappop(queue)
        if node < 0:
            found.append((t, -1 - node))
            want -= max(1, forest[t].sizes[-1 - node])
            continue
        m = margins[t][node]
        left, right = forest[t].children[node]
        heapq.heappush(queue, (max(worst, m), t, left))  # lower is better: how far on the wrong side
        heapq.heappush(queue, (max(worst, -m), t, right))
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_of(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its place, and ids and exact distances of its ``k`` nearest vectors."""
    squares = (vectors**2).sum(axis=1)
    for a in range(0, len(queries), 256):
        part = queries[a : a + 256]
        rough = squares[None] - 2 * part @ vectors.T + (part**2).sum(axis=1)[:, None]
        for i in range(len(part)):
            near = rough[i]
            if len(near) > k:
                bound = np.partition(near, k - 1)[k - 1]
                at = np.flatnonzero(near <= bound + 1e-9 * (1 + abs(bound) + squares.max()))
            else:
                at = np.arange(len(near))
            exact = np.sqrt(((vectors[at] - part[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[at], exact))[:k]
            yield a + i, ids[at][best], exact[best]


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, vector)`` of rows with an id and a finite, non-zero vector; shorter ones end in zeros."""
    v = F.col("vector")
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    own = own.where(F.col("id").isNotNull() & v.isNotNull()).where(fine)
    size = own.agg(F.max(F.size(v))).first()[0] or 0
    return own.withColumn("vector", F.concat(v, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(v))))


def search(
    rows: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
    trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, share: float = SEARCH, chunk: int = CHUNK, seed: int = 11,
) -> DataFrame:
    """The ``k`` nearest found for each row whose id divides by ``every``: ``(query_id, rank, vec_id, score)``.

    Candidates are all rows but the query's own; the score is the Euclidean distance of the original
    vectors in double precision; ties go to the smaller id. Null, zero or non-finite vectors, and
    rows without an id, take no part; of vectors of several lengths the shorter count as ending in zeros. Rows that repeat both id and vector are one; an id with several
    vectors is searched by each, and its best results stand. Other columns are not read.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 10_000)
    own = usable(rows, id_col, vector_col)
    same = Window.partitionBy("vector").orderBy("id")
    ranked = own.withColumn("place", F.dense_rank().over(same)).where(F.col("place") <= k + 1)
    members = written(ranked.select("id", "vector").distinct(), "members")
    classes = written(members.groupBy("vector").agg(F.min("id").alias("rep")), "classes")
    members = written(members.join(classes.hint("merge"), "vector").select("rep", "id"), "member_ids")
    asked = own.where(F.col("id") % every == 0)
    asked = written(asked.join(classes.hint("merge"), "vector").select("rep", F.col("id").alias("query_id")).distinct(), "queries")
    got = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not got:
        return spark.createDataFrame([], schema)
    fit = np.array([r.vector for r in got])
    draw = np.random.default_rng(seed)
    forest = spark.sparkContext.broadcast([grow(fit, draw, leaf) for _ in range(trees)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(1))
            for t, tree in enumerate(forest.value):
                at = leaves(tree, vectors).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(at), batch.column(0), batch.column(1)], ["tree", "leaf", "rep", "vector"])

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                found = [(i, t, x) for i, v in enumerate(_matrix(part.column(1))) for t, x in probes(forest.value, v, share)]
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int32()), part.column(0).take(at), part.column(1).take(at)], ["tree", "leaf", "rep", "vector"])

    form = "tree int, leaf int, rep long, vector array<double>"
    index = classes.select("rep", "vector").mapInArrow(placed, form)
    reps = asked.select("rep").distinct()
    wanted = classes.join(reps.hint("merge"), "rep", "left_semi").select("rep", "vector").mapInArrow(asked_of, form)
    index, wanted = written(index, "index"), written(wanted, "probes")

    def chunks(side: DataFrame, name: str) -> DataFrame:  # as many rows as the forest has leaves, which the sample bounds
        return side.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))

    parts = written(chunks(index, "row_chunks").join(chunks(wanted, "query_chunks").hint("merge"), ["tree", "leaf"]), "chunks")
    part_of = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("row_chunk", part_of("row_chunks")).withColumn("query_chunk", all_of("query_chunks"))
    right = wanted.join(F.broadcast(parts), ["tree", "leaf"]).withColumn("query_chunk", part_of("query_chunks")).withColumn("row_chunk", all_of("row_chunks"))
    keys = ["tree", "leaf", "row_chunk", "query_chunk"]

    def compared(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query": [], "rep": [], "score": []})
        ids, mine = rows["rep"].to_numpy(np.int64), queries["rep"].to_numpy(np.int64)
        found = list(nearest_of(np.stack(queries["vector"].to_numpy()), ids, np.stack(rows["vector"].to_numpy()), k + 1, mine))
        return pd.DataFrame(
            {"query": np.repeat(mine[[f[0] for f in found]], [len(f[1]) for f in found]), "rep": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])}
        )

    pairs = left.select(*keys, "rep", "vector").groupBy(*keys).cogroup(right.select(*keys, "rep", "vector").groupBy(*keys))
    near = written(pairs.applyInPandas(compared, "query long, rep long, score double"), "near").distinct()
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("score", "rep"))).where(F.col("place") <= k + 1)
    best = written(best.select("query", "rep", "score"), "best")
    first = Window.partitionBy("query").orderBy("score", "vec_id")
    wide = best.join(members.withColumnRenamed("id", "vec_id").hint("merge"), "rep").withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    wide = written(wide.select(F.col("query").alias("rep"), "vec_id", "score"), "expanded")
    told = asked.join(wide.hint("merge"), "rep").where("vec_id != query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    told = told.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return told.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
