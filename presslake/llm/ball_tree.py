"""Exact top-k by integer inner product: ball-tree branch and bound in every shard.

A node is a ball around its vectors: no inner product with q is above q.centre + |q| * radius. Cells of
the table (vectors.py) are balls too, and a query goes only to those whose bound reaches its kth score
in the sample. In a shard a query's leaves are ordered by that bound, with subtrees below the current
kth score cut off at their root, and are visited until the bound falls below the kth score. The kth
score is shared: the sample gives every query a first one, and a task carries on what its earlier shards
gave. Queries of a packed row walk together, so that a leaf answers all queries that come to it at once.

Defined cases: components become floor(64 * x), x as double; vectors that are null or hold a null or
non-finite component take no part (a zero vector does); vectors of another dimension than the
query's are no candidates; a query id that comes more than once is asked once, while a repeated row
is a candidate each time; ties go to the smaller vec_id; an empty table gives no rows; other columns
are ignored. Scores are exact while they are below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.vectors import Cells, lay_out, search, valid
from presslake.session import read

K, SCALE = 20, 64
#: Vectors of a shard and of a leaf.
SHARD, LEAF = 4096, 64


class BallTree:
    """Balls over the rows of ``data``, split at the median of the widest direction between two far points."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, leaf: int = LEAF):
        self.ids, self.data = ids, data
        self.centres, self.radii, self.children, self.rows = [], [], [], []
        work: list[tuple[np.ndarray, int | None]] = [(np.arange(len(data)), None)]
        while work:
            rows, parent = work.pop()
            node, own = len(self.centres), data[rows]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            self.centres.append(centre)
            self.radii.append(float(away.max()) * (1 + 1e-12) + 1e-9)
            self.children.append([])
            self.rows.append([])
            if parent is not None:
                self.children[parent].append(node)
            if len(rows) <= leaf or not away.max():
                self.rows[node] = [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
                continue
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            order = np.argsort(own @ (other - one), kind="stable")
            half = len(rows) // 2
            work += [(rows[order[:half]], node), (rows[order[half:]], node)]
        self.centre, self.radius = np.array(self.centres), np.array(self.radii)

    def leaf_bounds(self, queries: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Upper bounds (query, leaf), -inf where a ball above it is below the query's kth score; and the leaves' rows."""
        bound = queries @ self.centre.T + np.sqrt((queries**2).sum(1))[:, None] * self.radius
        bound = bound + 1e-9 * (1 + np.abs(bound))
        bounds, leaves, stack = [], [], [(0, np.ones(len(queries), bool))]
        while stack:
            node, alive = stack.pop()
            alive = alive & (bound[:, node] >= kth)
            if not alive.any():
                continue
            if self.children[node]:
                stack += [(child, alive) for child in self.children[node]]
            else:
                leaves += self.rows[node]
                bounds += [np.where(alive, bound[:, node], -np.inf)] * len(self.rows[node])
        return np.array(bounds).T.reshape(len(queries), len(leaves)), leaves


def merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row by row the k best of two lists: by score, then smaller id."""
    scores, ids = np.concatenate([scores, more], 1), np.concatenate([ids, more_ids], 1)
    order = np.lexsort((ids, -scores), axis=-1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def branch_and_bound(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of shape (queries, k), padded with -inf: all that can be among the k best, given that k scores of ``kth`` or more exist."""
    bounds, leaves = tree.leaf_bounds(queries, kth)
    best, best_ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    order = np.argsort(-bounds, axis=1, kind="stable")
    active = np.arange(len(queries))
    for turn in range(len(leaves)):
        at = order[active, turn]
        go = bounds[active, at] >= np.maximum(kth, best[:, -1])[active]
        active, at = active[go], at[go]
        if not len(active):
            break
        for one in np.unique(at):
            who, rows = active[at == one], leaves[one]
            score = queries[who] @ tree.data[rows].T
            score[query_ids[who][:, None] == tree.ids[rows][None, :]] = -np.inf
            score[score < np.maximum(kth, best[:, -1])[who][:, None]] = -np.inf
            hit = (score > -np.inf).any(1)  # others stay as they are
            who, score = who[hit], score[hit]
            if not len(who):
                continue
            best[who], best_ids[who] = merge(best[who], best_ids[who], score, np.broadcast_to(tree.ids[rows], score.shape), k)
    return best, best_ids


def cell_balls(layout) -> None:
    """Gives every cell its ball: the sample's centre, and the largest distance of all the cell's rows from it (a row per cell comes back)."""
    for cells in layout.cells.values():
        route = cells.route(cells.data)
        cells.extra["centre"] = np.array([cells.data[route == c].mean(0) if (route == c).any() else np.zeros(cells.data.shape[1]) for c in range(cells.count)])
    centres = layout.packed.sparkSession.sparkContext.broadcast({dim: cells.extra["centre"] for dim, cells in layout.cells.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["dim"], r["cell"], float(np.sqrt(((np.frombuffer(r["data"], np.float64).reshape(-1, r["dim"]) - centres.value[r["dim"]][r["cell"]]) ** 2).sum(1).max()))) for r in batch.to_pylist()]
            if rows:
                dim, cell, radius = zip(*rows)
                yield pa.record_batch([pa.array(dim, pa.int32()), pa.array(cell, pa.int32()), pa.array(radius)], names=["dim", "cell", "radius"])

    found = layout.packed.mapInArrow(run, "dim int, cell int, radius double").groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect()
    for cells in layout.cells.values():
        cells.extra["radius"] = np.full(cells.count, -np.inf)  # a cell without rows
    for r in found:
        layout.cells[r["dim"]].extra["radius"][r["cell"]] = r["radius"] * (1 + 1e-12) + 1e-9


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """The k highest inner products of each query; both tables are (vec_id, vector) of whole numbers."""
    layout = lay_out(vectors, shard)
    cell_balls(layout)

    def choose(cells: Cells, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kth = np.full(len(ids), -np.inf)
        if len(cells.data) > k:
            score = data @ cells.data.T
            score[ids[:, None] == cells.ids] = -np.inf
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        bound = data @ cells.extra["centre"].T + np.sqrt((data**2).sum(1))[:, None] * cells.extra["radius"]
        return (bound + 1e-9 * (1 + np.abs(bound)) >= kth[:, None]) & np.isfinite(cells.extra["radius"]), -kth

    def answer(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, cost: np.ndarray):
        best, best_ids = branch_and_bound(tree, query_ids, queries, -cost, k)
        at, place = np.nonzero(best > -np.inf)
        score = best[at, place]
        return at, best_ids[at, place], score.astype(np.int64), -score

    return search(layout, queries, choose, BallTree, answer, k, "long", ascending=False)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero_too=True)
    whole = vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("double")))
    return top_k(whole, whole.filter(F.col("vec_id") % 20 == 0))
