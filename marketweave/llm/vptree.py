"""Nearest neighbours by vantage-point trees (operator 9).

Vectors are dealt into cells by the nearest of at most PIVOTS pivots, and a cell into shards by a hash of id and vector, so that a large cell, or one vector that many ids have, is never one task's.
Each shard holds its different vectors in one vantage-point tree, stored as a row of a table in the shared folder, beside its pivot and the least and largest distance from it.
A query visits its home first, the nearest cells that hold more than k rows together. The worst of the k best found there is its limit: it is then sent only to cells that the triangle
inequality cannot exclude, by their ring of distances around the pivot or by the border to the nearest pivot's cell. Queries are stored by cell; a task holds a few trees of one cell, reads that cell's
queries block by block and walks its trees with all of a block at once, carrying the k best so far from tree to tree; Spark merges the best of all tasks per query.
A cell or subtree is left out if its distance bound, times the relaxation factor, exceeds the limit. By the triangle inequality factor 1 loses nothing; larger factors skip more.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: TREES bounds the trees that a task holds at once. Pivots are broadcast: at most PIVOTS of them and PIVOT_BYTES in all; fewer pivots make larger cells of more shards, not other results.
LEAF, SHARD_ROWS, QUERY_BLOCK, TREES, PIVOTS, PIVOT_BYTES = 128, 8192, 4096, 8, 1024, 32 << 20
#: Share of the distances by which a bound is lowered, so that rounding never excludes a tie.
SLACK = 1e-12
#: Stands for no neighbour.
NONE = np.iinfo(np.int64).max


@dataclass
class Node:
    """Inner: vantage point, radius, the vectors within it and beyond. Leaf: vectors first to last - 1 of the tree's order."""

    point: np.ndarray | None = None
    radius: float = 0.0
    near: Node | None = None
    far: Node | None = None
    first: int = 0
    last: int = 0


@dataclass
class Tree:
    vectors: np.ndarray  # different vectors, in leaf order
    ids: list[np.ndarray]  # of each vector, the different ids that have it, ascending
    root: Node
    several: bool  # whether an id has more than one vector


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and b in double precision, without the cancellation of the dot-product form."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(-1))
    return out


def build(ids: np.ndarray, vectors: np.ndarray, seed: int = 0) -> Tree:
    """One tree over all rows; equal vectors share an entry, so any number of copies costs one distance. Repeated rows count once."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order]
    different, number = np.unique(vectors, axis=0, return_inverse=True)
    by = np.argsort(number.ravel(), kind="stable")
    groups = [np.unique(g) for g in np.split(ids[by], np.cumsum(np.bincount(number.ravel(), minlength=len(different)))[:-1])]
    rng, placed = np.random.default_rng(seed), []

    def grow(rows: np.ndarray) -> Node:
        if len(rows) > LEAF:
            point = different[rows[rng.integers(len(rows))]]
            d = distances(point[None], different[rows])[0]
            radius = float(np.median(d))
            near, far = rows[d <= radius], rows[d > radius]
            if len(near) and len(far):
                return Node(point, radius, grow(near), grow(far))
        first = sum(map(len, placed))
        placed.append(rows)
        return Node(first=first, last=first + len(rows))

    root = grow(np.arange(len(different)))
    order = np.concatenate(placed) if placed else np.zeros(0, int)
    return Tree(different[order], [groups[k] for k in order], root, sum(map(len, groups)) > len(np.unique(ids)))


def search(tree: Tree, ids: np.ndarray, queries: np.ndarray, limit: np.ndarray, k: int, factor: float, best_d: np.ndarray, best_i: np.ndarray) -> None:
    """Puts the k nearest of each query among the tree's rows but itself into best_d and best_i, which hold the best so far (distance and id, nearest first; NONE where there is none).

    Rows beyond a query's limit, within which k others are known, need not be found.

    Ties go to smaller ids. An id with several vectors is as far as the nearest of them. Of equal vectors the k + 1 smallest ids are enough: one of them may be the query itself,
    later ones lose every tie, even if some have been found by a nearer vector.
    """

    def leaf(n: Node, at: np.ndarray) -> None:
        lists = [tree.ids[j][: k + 1] for j in range(n.first, n.last)]
        width = np.array([len(x) for x in lists])
        cand = np.concatenate(lists)
        d = np.repeat(distances(queries[at], tree.vectors[n.first : n.last]), width, axis=1)
        own = ids[at][:, None] == cand[None]
        all_d = np.concatenate([best_d[at], np.where(own, np.inf, d)], 1)
        all_i = np.concatenate([best_i[at], np.where(own, NONE, cand)], 1)
        if tree.several or np.isin(cand, best_i[at]).any():  # all but the nearest vector of an id go before the cut to k
            by_id = np.lexsort((all_d, all_i), axis=1)
            same = np.take_along_axis(all_i, by_id, 1)
            row, col = np.nonzero(same[:, 1:] == same[:, :-1])
            all_d[row, by_id[row, col + 1]], all_i[row, by_id[row, col + 1]] = np.inf, NONE
        if all_d.shape[1] > 4 * k:  # keep all that tie with the k-th
            edge = np.partition(all_d, k - 1, axis=1)[:, k - 1 : k]
            cols = np.flatnonzero((all_d <= edge).any(0))
            all_d, all_i = all_d[:, cols], all_i[:, cols]
        order = np.lexsort((all_i, all_d), axis=1)[:, :k]
        best_d[at], best_i[at] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)

    def walk(n: Node, at: np.ndarray) -> None:
        if not len(at):
            return
        if n.point is None:
            leaf(n, at)
            return
        d = distances(queries[at], n.point[None])[:, 0]
        inside = d <= n.radius
        walk(n.near, at[inside])
        walk(n.far, at[~inside])
        # What isn't a number, as two distances are infinite, cuts off nothing.
        beyond = (np.abs(d - n.radius) - SLACK * (d + n.radius)) * factor > np.minimum(best_d[at, k - 1], limit[at]) * (1 + 1e-9)
        walk(n.far, at[inside & ~beyond])
        walk(n.near, at[~inside & ~beyond])

    if len(tree.vectors):
        with np.errstate(over="ignore", invalid="ignore"):
            walk(tree.root, np.arange(len(queries)))


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _by_length(v: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length."""
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    return {int(n): (np.flatnonzero(sizes == n), v.filter(pa.array(sizes == n)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)) for n in np.unique(sizes)}


def _pivots(kept: DataFrame, shard_rows: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector: different vectors in the order of a hash, about one for each shard within the bounds."""
    rows, longest = kept.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    n = max(1, min(PIVOTS, PIVOT_BYTES // (8 * longest), -(-rows // shard_rows)))
    found = defaultdict(list)
    for r in kept.select("v", F.xxhash64("v").alias("h")).distinct().orderBy("h", "v").limit(n).collect():
        found[len(r["v"])].append(r["v"])
    return {dim: np.array(v) for dim, v in found.items()}


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stores and returns the trees of vectors (vec_id, embedding), each different row once: dim, cell, shard, pivot, rows, lo, hi (distances from the pivot), tree.

    Vectors of different length are kept in different trees. Those of a length that no pivot has are in cell -1, which every query of that length visits.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    kept = common.store(kept.distinct(), "vectors")
    pivots = spark.sparkContext.broadcast(_pivots(kept, shard_rows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cells, away = np.zeros(len(b), np.int32), np.full(len(b), -1, np.int32), np.zeros(len(b))
            for dim, (at, v) in _by_length(b.column("v")).items():
                dims[at] = dim
                if dim in pivots.value:
                    with np.errstate(over="ignore", invalid="ignore"):
                        d = distances(v, pivots.value[dim])
                    cells[at] = d.argmin(1)
                    away[at] = d.min(1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(dims), pa.array(cells), pa.array(away)], ["vec_id", "v", "dim", "cell", "away"])

    dealt = common.store(kept.mapInArrow(deal, "vec_id long, v array<double>, dim int, cell int, away double"), "cells")
    sizes = common.store(dealt.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("shards")), "cell-sizes")
    dealt = dealt.join(common.small(sizes, 100_000), ["dim", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("shards")).cast("int"))

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        dim, cell, shard = (x.as_py() for x in key)
        ids, away = table.column("vec_id").to_numpy(), table.column("away").to_numpy()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        pivot = pivots.value[dim][cell].tolist() if cell >= 0 else None
        row = {"dim": dim, "cell": cell, "shard": shard, "pivot": pivot, "rows": len(ids), "lo": float(away.min()), "hi": float(away.max()), "tree": pickle.dumps(build(ids, v, shard), 5)}
        return pa.Table.from_pylist([row], schema=PLANTED)

    trees = dealt.drop("shards").groupBy("dim", "cell", "shard").applyInArrow(plant, "dim int, cell int, shard int, pivot array<double>, rows long, lo double, hi double, tree binary")
    return common.store(trees, "trees")


PLANTED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("shard", pa.int32()), ("pivot", pa.list_(pa.float64())), ("rows", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()), ("tree", pa.binary())])


@dataclass
class Cells:
    """The cells of one length of vectors: at most PIVOTS."""

    number: np.ndarray
    pivot: np.ndarray
    rows: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector and cell, the distance to the pivot and one that no row of the cell is nearer than: by its ring around the pivot, or as its rows are nearer to this pivot than to others."""
        with np.errstate(over="ignore", invalid="ignore"):
            d = distances(v, self.pivot)
            ring = np.maximum(d - self.hi, self.lo - d) - SLACK * (d + self.hi)
            border = (d - d.min(1, keepdims=True)) / 2 - SLACK * d
            return d, np.maximum(ring, border)

    def home(self, d: np.ndarray, k: int) -> np.ndarray:
        """Whether a cell is one of the nearest that hold more than k rows together."""
        order = np.argsort(d, axis=1, kind="stable")
        rows = self.rows[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, np.cumsum(rows, 1) - rows <= k, 1)
        return out


def _directory(index: DataFrame) -> dict[int, Cells]:
    """The cells with a pivot, by length of vector."""
    found = defaultdict(list)
    for r in index.where("cell >= 0").groupBy("dim", "cell").agg(F.min("pivot").alias("pivot"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim", "cell").collect():
        found[r["dim"]].append(r)
    return {dim: Cells(*(np.array([r[c] for r in rs]) for c in ("cell", "pivot", "rows", "lo", "hi"))) for dim, rs in found.items()}


def _blocks(path: str, cell: int, block: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Ids, vectors and limits of the queries stored for a cell by length, a block at a time."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, where = common.arrow_fs(path)
    files = fs.get_file_info(pafs.FileSelector(f"{where}/cell={cell}", allow_not_found=True))
    for info in sorted((x for x in files if x.path.endswith(".parquet")), key=lambda x: x.path):
        with fs.open_input_file(info.path) as f:
            for b in pq.ParquetFile(f).iter_batches(block, columns=["query_id", "v", "far"]):
                ids, limit = b.column("query_id").to_numpy(), b.column("far").to_numpy()
                yield {n: (ids[at], v, limit[at]) for n, (at, v) in _by_length(b.column("v")).items()}


def _visits(queries: DataFrame, cells: dict[int, Cells], k: int, factor: float, home: bool) -> DataFrame:
    """query_id, v, far, cell: the home of each of queries (query_id, v, far), or all further cells that its limit far cannot exclude."""
    known = queries.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                b = whole.slice(start, 512)
                rows, to = [], []
                for dim, (at, v) in _by_length(b.column("v")).items():
                    here = known.value.get(dim)
                    if here is None:
                        rows.append(at if home else at[:0])
                        to.append(np.full(len(rows[-1]), -1, np.int32))
                        continue
                    d, bound = here.bounds(v)
                    mine = here.home(d, k)
                    if not home:
                        far = b.column("far").to_numpy()[at]
                        mine = ~mine & ~(bound * factor > far[:, None] * (1 + 1e-9))
                    q, c = np.nonzero(mine)
                    rows.append(at[q])
                    to.append(here.number[c].astype(np.int32))
                take = b.take(pa.array(np.concatenate(rows))) if rows else b.slice(0, 0)
                yield pa.RecordBatch.from_arrays([*(take.column(c) for c in ("query_id", "v", "far")), pa.array(np.concatenate(to) if to else np.zeros(0, np.int32))], ["query_id", "v", "far", "cell"])

    return queries.select("query_id", "v", "far").mapInArrow(run, "query_id long, v array<double>, far double, cell int")


def _visit(index: DataFrame, visits: DataFrame, k: int, factor: float, block: int) -> DataFrame:
    """query_id, vec_id, score: what each task finds for the queries sent to its cells."""
    spark = index.sparkSession
    path = common.scratch(spark, "query-blocks")
    visits.repartition("cell", F.pmod(F.xxhash64("query_id"), F.lit(spark.sparkContext.defaultParallelism))).write.partitionBy("cell").parquet(path)

    def walk(cell: int, held: list[tuple[int, Tree]]) -> Iterator[pa.RecordBatch]:
        for found in _blocks(path, cell, block):
            for dim, (ids, vectors, limit) in found.items():
                best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), NONE)
                for n, tree in held:
                    if n == dim:
                        search(tree, ids, vectors, limit, k, factor, best_d, best_i)
                q, place = np.nonzero(best_i < NONE)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(best_i[q, place]), pa.array(best_d[q, place])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for b in batches:
            for c, dim, blob in zip(b.column("cell").to_pylist(), b.column("dim").to_pylist(), b.column("tree")):
                if held and (c != cell or len(held) == TREES):
                    yield from walk(cell, held)
                    held = []
                cell = c
                held.append((dim, pickle.loads(blob.as_buffer())))
        if held:
            yield from walk(cell, held)

    n = index.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // TREES))))
    trees = index.select("dim", "cell", "shard", "tree").repartition(tasks, "dim", "cell", (F.col("shard") / TREES).cast("int")).sortWithinPartitions("cell", "dim", "shard")
    return trees.mapInArrow(run, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest different ids per query."""
    # An id with several vectors may come from several shards.
    found = found.repartition("query_id").withColumn("again", F.row_number().over(Window.partitionBy("query_id", "vec_id").orderBy("score"))).where("again = 1")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(index: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest ids to each of queries (vec_id, embedding) but itself, as far as there are so many.

    Unusable vectors and null ids take no part. Rows that repeat a query's id are its copies: the query has one result per different id, by the first of its vectors.
    Repeated rows of the index count once, and an id with several vectors by the nearest of them. block is the number of queries that a task works on at once.
    """
    v = F.col("embedding").cast("array<double>")
    kept = queries.select(F.col("vec_id").cast("long").alias("query_id"), v.alias("v")).where(F.col("query_id").isNotNull() & usable(F.col("v")))
    kept = common.store(kept.groupBy("query_id").agg(F.min("v").alias("v")), "queries")
    cells = _directory(index)
    open_ended = kept.withColumn("far", F.lit(float("inf")))
    near = _best(_visit(index, _visits(open_ended, cells, k, factor, True), k, factor, block), k)
    if all(len(c.number) == 1 for c in cells.values()):  # every query was at home in all cells of its length
        return near
    near = common.store(near.drop("rank"), "home")
    limit = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("far"))
    limited = kept.join(limit, "query_id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
    return _best(near.unionByName(_visit(index, _visits(limited, cells, k, factor, False), k, factor, block)), k)
