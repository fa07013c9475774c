"""Vectors laid out in shards of near ones, and a stated query set sent to the shards that it can need.

A bounded sample (SAMPLE rows, by a hash of their id, SAMPLE_VALUES components at most) is cut by a tree
of hyperplanes into cells, as many as the table needs for shards of a bounded size; more cells than a
quarter of the sample aren't made. Every vector is routed to its cell where it lies and packed there, so
that vectors are shuffled once, as packed rows. A cell of more vectors than a shard takes, as of equal
vectors, is several shards. Queries, a small part of the rows, go to the cells that a bound doesn't
rule out, packed too; a shard's index is built once, whatever number of queries it answers. What a task
found for a query so far is its bound for the shards that follow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presslake.llm.common import prepare
from presslake.session import checkpoint

#: Rows and components of the sample, and cells of one dimension.
SAMPLE, SAMPLE_VALUES = 4096, 1 << 20
#: Vectors or queries in a packed row, queries that a shard answers at a time, and queries whose best finds a task remembers.
PACK, ASKED, REMEMBERED = 256, 4096, 1 << 16
PACKED = "dim int, cell int, n int, ids binary, data binary, kth binary"


def valid(df: DataFrame, id_column: str, vector_column: str, zero_too: bool) -> DataFrame:
    """(vec_id, vector as array<double>) of the vectors that take part: no null, no null or non-finite component, and not zero unless ``zero_too``."""
    v = F.col("vector")
    some = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    some = some.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite)
    return some if zero_too else some.filter(F.exists(v, lambda x: x != 0))


@dataclass
class Cells:
    """A tree of hyperplanes over a sample; leaves are cells."""

    data: np.ndarray  # the sample
    ids: np.ndarray
    planes: list[np.ndarray] = field(default_factory=list)
    offsets: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)  # below 0: cell -1 - c
    count: int = 0
    extra: dict = field(default_factory=dict)  # what an operator knows of the cells

    def split(self, cells: int, rng: np.random.Generator) -> Cells:
        """Cuts the largest part at the middle between two of its rows, until there are so many."""
        parts: list[tuple[np.ndarray, int | None, int]] = [(np.arange(len(self.data)), None, 0)]
        while len(parts) < cells:
            rows, parent, side = parts.pop(max(range(len(parts)), key=lambda i: len(parts[i][0])))
            along = self.data[rows]
            for _ in range(8):
                a, b = rng.choice(len(rows), 2, replace=False) if len(rows) > 1 else (0, 0)
                if np.any(along[a] != along[b]):
                    break
            else:
                parts.append((rows, parent, side))
                break
            normal = along[a] - along[b]
            normal = normal / np.linalg.norm(normal)
            reach = along @ normal
            offset = float(np.median(reach))
            right = reach > offset
            if not right.any():
                offset = float((reach.min() + reach.max()) / 2)
                right = reach > offset
            node = len(self.planes)
            self.planes.append(normal)
            self.offsets.append(offset)
            self.children.append((0, 0))
            self._hang(parent, side, node)
            parts += [(rows[~right], node, 0), (rows[right], node, 1)]
        for rows, parent, side in parts:
            self._hang(parent, side, -1 - self.count)
            self.count += 1
        return self

    def _hang(self, parent: int | None, side: int, node: int) -> None:
        if parent is not None:
            own = list(self.children[parent])
            own[side] = node
            self.children[parent] = (own[0], own[1])

    def reach(self, x: np.ndarray) -> np.ndarray:
        return x @ np.array(self.planes).T - np.array(self.offsets)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        if not self.planes:
            return np.zeros(len(x), np.int64)
        reach, children = self.reach(x), np.array(self.children)
        node = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            node[inner] = children[node[inner], (reach[inner, node[inner]] > 0).astype(int)]
        return -1 - node

    def margins(self, x: np.ndarray) -> np.ndarray:
        """How far every row is from each cell at least: the largest distance to a plane that lies between."""
        out = np.zeros((len(x), self.count))
        if self.planes:
            reach = self.reach(x)
            work = [(0, np.zeros(len(x)))]
            while work:
                node, so_far = work.pop()
                if node < 0:
                    out[:, -1 - node] = so_far
                    continue
                low, high = self.children[node]
                work += [(low, np.maximum(so_far, reach[:, node])), (high, np.maximum(so_far, -reach[:, node]))]
        return out


@dataclass
class Layout:
    """The packed shards, the cells by dimension, and (dim, cell, base, shards) of the cells that hold vectors."""

    packed: DataFrame
    cells: dict[int, Cells]
    table: DataFrame
    groups: int


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, ids, vectors) of the rows (vec_id, vector), by dimension."""
    for batch in batches:
        ids, column = batch.column("vec_id").to_numpy(), batch.column("vector")
        size = np.diff(column.offsets.to_numpy())
        flat = column.flatten().to_numpy()
        first = np.cumsum(size) - size
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            yield dim, ids[rows], flat[(first[rows, None] + np.arange(dim))].reshape(len(rows), dim)


class Packer:
    """Packed rows of one cell each."""

    def __init__(self):
        self.held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, dim: int, cell: int, ids: np.ndarray, data: np.ndarray, kth: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = self.held.setdefault((dim, cell), [])
        own.append((ids, data, kth))
        if sum(len(i) for i, _, _ in own) >= PACK:
            yield from self.out(dim, cell)

    def out(self, dim: int, cell: int) -> Iterator[pa.RecordBatch]:
        ids, data, kth = (np.concatenate(x) for x in zip(*self.held.pop((dim, cell))))
        for a in range(0, len(ids), PACK):
            b = min(a + PACK, len(ids))
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([b - a], pa.int32()), *(pa.array([x[a:b].tobytes()], pa.binary()) for x in (ids, data, kth))], names=["dim", "cell", "n", "ids", "data", "kth"])

    def rest(self) -> Iterator[pa.RecordBatch]:
        for key in list(self.held):
            yield from self.out(*key)


def lay_out(vectors: DataFrame, shard: int, seed: int = 5) -> Layout:
    """Every vector of (vec_id, vector), packed by cell and written."""
    spark = vectors.sparkSession
    prepare(spark)
    known = {r["dim"]: r["n"] for r in vectors.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()}
    some = min(SAMPLE, max(1, SAMPLE_VALUES // max(known, default=1)))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(some).collect()
    cells = {}
    for dim, n in known.items():
        own = [r for r in rows if len(r["vector"]) == dim]
        data = np.array([r["vector"] for r in own], float).reshape(-1, dim)
        cells[dim] = Cells(data, np.array([r["vec_id"] for r in own], np.int64)).split(max(1, min(-(-n // shard), len(own) // 4)), np.random.default_rng(seed))
    sent = spark.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for dim, ids, data in _batches(batches):
            cell = sent.value[dim].route(data)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                yield from packer.add(dim, c, ids[at], data[at], np.zeros(0))
        yield from packer.rest()

    packed = checkpoint(vectors.select("vec_id", "vector").mapInArrow(run, PACKED))
    held = packed.groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()  # a row per cell
    table, base = [], 0
    for r in sorted(held):
        many = -(-r["n"] // shard)
        table.append((r["dim"], r["cell"], base, many))
        base += many
    return Layout(packed, cells, spark.createDataFrame(table, "dim int, cell int, base int, shards int"), base)


class Best:
    """The k least costs that a task found for a query; of REMEMBERED queries at most, as it only spares work."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def kth(self, ids: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.array([min(b, self.held[i][-1]) if i in self.held else b for i, b in zip(ids.tolist(), known.tolist())])

    def add(self, query: int, costs: np.ndarray) -> None:
        if len(self.held) >= REMEMBERED:
            self.held.clear()
        old = self.held.get(query, np.full(self.k, np.inf))
        self.held[query] = np.sort(np.concatenate([old, costs]))[: self.k]


#: (cells, query ids, queries) -> (cells to visit as a table of bools, cost that the kth find has at most)
Choose = Callable[[Cells, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: (index, query ids, queries, kth cost known) -> (rows of the queries, vec_id, score, cost)
Answer = Callable[[object, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def search(layout: Layout, queries: DataFrame, choose: Choose, build: Callable, answer: Answer, k: int, score_type: str, ascending: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best that shards answer; ties go to the smaller vec_id.

    ``queries`` are (vec_id, vector); a query id that comes more than once is asked once.
    """
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(layout.cells)
    kind = pa.int64() if score_type == "long" else pa.float64()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer()
        for dim, ids, data in _batches(batches):
            if (cells := sent.value.get(dim)) is None:
                continue
            visit, kth = choose(cells, ids, data)
            for c in np.flatnonzero(visit.any(0)).tolist():
                at = np.flatnonzero(visit[:, c])
                yield from packer.add(dim, c, ids[at], data[at], kth[at])
        yield from packer.rest()

    asked = queries.dropDuplicates(["vec_id"]).select("vec_id", "vector").mapInArrow(ask, PACKED)
    table = F.broadcast(layout.table)
    each = asked.join(table, ["dim", "cell"]).withColumn("group", F.explode(F.sequence("base", F.col("base") + F.col("shards") - 1))).withColumn("is_query", F.lit(True))
    own = layout.packed.join(table, ["dim", "cell"]).withColumn("group", F.col("base") + F.pmod(F.xxhash64("ids"), F.col("shards")).cast("int")).withColumn("is_query", F.lit(False))
    names = ["group", "is_query", "dim", "ids", "data", "kth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, group, index, held, asking = Best(k), None, None, [], []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal index
            if asking and held:
                if index is None:
                    index = build(*(np.concatenate(x) for x in zip(*held)))
                ids, data, kth = (np.concatenate(x) for x in zip(*asking))
                at, found, score, cost = answer(index, ids, data, best.kth(ids, kth))
                order = np.argsort(at, kind="stable")
                edges = np.flatnonzero(np.diff(at[order], prepend=-1, append=-1))
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    best.add(int(ids[at[order[a]]]), cost[order[a:b]])
                if len(at):
                    yield pa.record_batch([pa.array(ids[at]), pa.array(found), pa.array(score, kind)], names=["query_id", "vec_id", "score"])
            asking.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    yield from answers()
                    group, index, held = row["group"], None, []
                ids, data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.float64).reshape(-1, row["dim"])
                if not row["is_query"]:
                    held.append((ids, data))
                    continue
                asking.append((ids, data, np.frombuffer(row["kth"], np.float64)))
                if sum(len(i) for i, _, _ in asking) >= ASKED:
                    yield from answers()
        yield from answers()

    prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # groups are numbered through, so that each partition has as many shards as any other
    dealt = own.select(*names).unionByName(each.select(*names)).repartitionById(partitions, F.pmod("group", F.lit(partitions)))
    found = dealt.sortWithinPartitions("group", "is_query").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    rank = Window.partitionBy("query_id").orderBy(F.col("score") if ascending else F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
