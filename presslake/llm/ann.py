"""Approximate nearest neighbours: a forest of random-projection trees searched through a shared priority queue.

The table is laid out in shards by one tree over all rows (vectors.py); in each shard a forest of trees
splits the vectors by hyperplanes midway between two of them, drawn at random, down to small leaves. A
query goes to the cells whose margin (the distance to the farthest plane between) is not too large, and
in a shard puts the roots of all trees into one priority queue; the node with the least margin is popped,
its children go in with the larger of its own margin and theirs, and leaves hand over their vectors as
long as margins aren't too large. The candidates are reranked by their exact Euclidean distance in double
precision.

How large a margin may be is a share of the query's kth distance so far, first that to the sample, and
the share is measured: on the sample (vectors.SAMPLE rows) true neighbours are found by brute force, and
the shares are those within which RECALL of them lie, for cells and for leaves. So where the vectors have
structure a query sees few of them, and where they have none, as in noise of many dimensions, most.
Every row is indexed.

Defined cases: vectors that are null, zero or hold a null or non-finite component take no part;
vectors of another dimension than the query's are no candidates; a query without candidates has no
rows; a query id that comes more than once is asked once, while a repeated row is a candidate each
time; ties go to the smaller vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.vectors import Cells, lay_out, search, valid
from presslake.session import read

K = 10
#: Vectors of a shard and of a leaf, trees of a shard, queries of the measurement, and the share of true neighbours that cells and that leaves shall hold.
SHARD, LEAF, TREES, MEASURED, RECALL = 2048, 32, 8, 96, 0.975


class Forest:
    """Trees over the rows of ``data``; nodes of all trees share one array of hyperplanes."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, trees: int = TREES, leaf: int = LEAF):
        self.ids, self.data = ids, np.asfortranarray(data)
        self.rng = np.random.default_rng(len(ids))
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []
        self.roots = [self._grow(data, leaf) for _ in range(trees)]
        self.planes = np.array(self.normals).reshape(-1, data.shape[1])
        self.at = np.array(self.offsets)

    def _grow(self, data: np.ndarray, leaf: int) -> int:
        """Node number of a tree's root: an inner node is 0 or more, a leaf is below 0."""
        root, work = 0, [(np.arange(len(data)), None, 0)]
        while work:
            rows, parent, side = work.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                node = -len(self.leaves)
            else:
                a, b = data[self.rng.choice(rows, 2, replace=False)]
                normal = a - b
                length = np.linalg.norm(normal)
                normal = normal / length if length else normal
                offset = float(normal @ (a + b) / 2)
                right = data[rows] @ normal > offset
                if not 0.05 < right.mean() < 0.95:  # a plane that splits off next to nothing, as between equal vectors
                    right = self.rng.permutation(len(rows)) * 2 >= len(rows)
                    normal, offset = np.zeros_like(normal), 0.0
                node = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append((0, 0))
                work += [(rows[~right], node, 0), (rows[right], node, 1)]
            if parent is None:
                root = node
            else:
                own = list(self.children[parent])
                own[side] = node
                self.children[parent] = (own[0], own[1])
        return root

    def margins(self, queries: np.ndarray) -> np.ndarray:
        return queries @ self.planes.T - self.at

    def candidates(self, margins: list[float], queue: list[tuple[float, int]], limit: float, enough: int) -> np.ndarray:
        """Rows of the leaves that the shared queue comes to next, up to ``enough`` or a margin above ``limit``; the queue stays for more."""
        found: list[np.ndarray] = []
        seen = 0
        while queue and queue[0][0] <= limit and seen < enough:
            worst, node = heapq.heappop(queue)
            if node < 0:
                found.append(self.leaves[-node - 1])
                seen += len(found[-1])
                continue
            low, high = self.children[node]
            margin = margins[node]
            heapq.heappush(queue, (max(worst, margin), low))
            heapq.heappush(queue, (max(worst, -margin), high))
        return np.unique(np.concatenate(found)) if found else np.array([], np.int64)

    def leaf_margins(self, margins: np.ndarray) -> np.ndarray:
        """(queries, rows): the least margin, over the trees, of the leaves that hold a row."""
        out = np.full((len(margins), len(self.ids)), np.inf)
        work = [(root, np.zeros(len(margins))) for root in self.roots]
        while work:
            node, worst = work.pop()
            if node < 0:
                rows = self.leaves[-node - 1]
                out[:, rows] = np.minimum(out[:, rows], worst[:, None])
                continue
            low, high = self.children[node]
            work += [(low, np.maximum(worst, margins[:, node])), (high, np.maximum(worst, -margins[:, node]))]
        return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of ``a`` from every row of ``b``, components added one after another."""
    total = np.zeros(len(b))
    for j in range(b.shape[1]):
        d = b[:, j] - a[j]
        total += d * d
    return np.sqrt(total)


def kth_distances(cells: Cells, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Distance of the kth nearest of the sample: no kth of the whole table is farther."""
    if len(cells.data) <= k:
        return np.full(len(queries), np.inf)
    square = (queries**2).sum(1)[:, None] + (cells.data**2).sum(1) - 2 * queries @ cells.data.T
    square[ids[:, None] == cells.ids] = np.inf
    return np.sqrt(np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0)) * (1 + 1e-9) + 1e-9


def measure(cells: Cells, k: int) -> tuple[float, float]:
    """Shares of the kth distance within which the margins of RECALL of the true neighbours lie: cells', leaves'."""
    rows, n = len(cells.data), min(len(cells.data), MEASURED)
    if rows <= 4 * k:
        return np.inf, np.inf
    asked, own = cells.data[:n], Forest(cells.ids[:SHARD], cells.data[:SHARD])
    out = []
    for data, ids, margins in ((cells.data, cells.ids, cells.margins(asked)[:, cells.route(cells.data)]), (cells.data[:SHARD], cells.ids[:SHARD], own.leaf_margins(own.margins(asked)))):
        square = (asked**2).sum(1)[:, None] + (data**2).sum(1) - 2 * asked @ data.T
        square[cells.ids[:n, None] == ids] = np.inf
        near = np.argpartition(square, k - 1, axis=1)[:, :k]
        kth = np.sqrt(np.maximum(np.take_along_axis(square, near, 1).max(1), 0))
        share = np.take_along_axis(margins, near, 1) / np.maximum(kth, 1e-12)[:, None]
        out.append(float(np.quantile(share, RECALL)))
    return out[0], out[1]


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = K, shard: int = SHARD) -> DataFrame:
    """The nearest vectors found of each query; both tables are (vec_id, vector)."""
    layout = lay_out(vectors, shard)
    for cells in layout.cells.values():
        cells.extra["shares"] = measure(cells, k)
    leaf_share = {dim: cells.extra["shares"][1] for dim, cells in layout.cells.items()}

    def choose(cells: Cells, ids: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kth = kth_distances(cells, ids, data, k)
        share = cells.extra["shares"][0]
        return cells.margins(data) <= (share * kth[:, None] if np.isfinite(share) else np.inf), kth

    def answer(forest: Forest, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray):
        margins, share = forest.margins(queries), leaf_share[queries.shape[1]]
        at, found, score = [], [], []
        for i in range(len(query_ids)):
            own, queue = margins[i].tolist(), [(0.0, root) for root in forest.roots]
            limit, rows, near = kth[i], np.array([], np.int64), np.array([])
            for enough in (len(forest.ids) // 8, np.inf):  # the first leaves tell the kth distance for the others
                more = np.setdiff1d(forest.candidates(own, queue, share * limit if np.isfinite(share) else np.inf, enough), rows, assume_unique=True)
                more = more[forest.ids[more] != query_ids[i]]
                rows, near = np.concatenate([rows, more]), np.concatenate([near, distances(queries[i], forest.data[more])])
                if len(near) >= k:
                    limit = min(limit, float(np.partition(near, k - 1)[k - 1]))
            best = np.lexsort((forest.ids[rows], near))[:k]
            at.append(np.full(len(best), i))
            found.append(forest.ids[rows[best]])
            score.append(near[best])
        costs = np.concatenate(score)
        return np.concatenate(at), np.concatenate(found), costs, costs

    return search(layout, queries, choose, Forest, answer, k, "double", ascending=True)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero_too=False)
    return neighbours(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
