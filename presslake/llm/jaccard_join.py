"""N-gram Jaccard self-join by index lists with set relations: exact links, as classes of linked documents.

1. Equal sets are one set: a text's shingle set has a number, and everything below is over numbers.
2. A bounded sketch counts how many sets hold each shingle. It only orders shingles, rare ones first
   (any order gives the same links): two sets that link share a shingle of both prefixes, of size
   n - ceil(t * n) + 1.
3. Index lists: prefix shingles are sorted by list, size and position. A list is cut into blocks where
   sizes are too far apart to link; blocks of one set, and blocks whose positions leave no link
   possible, are skipped. Lists with the same sets are one list.
4. Each set has a mark, a bitmap of its shingles that bounds overlaps from above. A list's first set,
   its pivot, is held against all others without gathering the list: each row meets the pivot's mark by
   a join. What can link with it joins its family and needs no comparison with the pivot's other
   answers; only lists in which some can't are gathered, and there sets of different families are
   compared further. So a list of near copies takes about as many comparisons as it has sets.
5. In a family every set's overlaps are derived from its pivot's: |S & T| = |P| + <P, dS> + <P, dT> +
   <dS, dT>, where dS is the small difference of S from P. Families of any size are cut into bounded
   blocks. First each block is compared with the family's pivot, its smallest set; sets that link with
   it are one class and aren't compared with each other. Then each block meets the blocks of those that
   don't. A unit gives no more links than join its sets; no pair of different classes is left out.
6. Connected components of the links are the classes.

Defined cases: a null text counts as empty; an empty set is linked with nothing and is its own
class; equal non-empty sets are linked; a null doc_id takes part, and a class's id is its smallest
non-null doc_id (null if it has none); repeated rows give a row each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import documents, map_batches, prepare, texts_of
from presslake.llm.graph import components
from presslake.llm.shingles import mix, pair_ids, set_id, shingle_sets
from presslake.session import checkpoint

#: Shingle words and percent of similarity that the query's contract asks for.
WORDS, PERCENT = 4, 85
#: Buckets of a sketch (a power of two) and of one of its slices. The sketch is 8 MB, whatever the table's size.
BUCKETS, SLICE = 1 << 21, 1 << 15
#: Sets of a family's block.
BLOCK = 384
#: Rows of an index list that a task holds; the sets of a longer list are one family, whatever their marks say.
LIST_ROWS = 1 << 17
#: Longs of the smallest mark and shingles that it is for; four times as many shingles have a mark four times as wide.
MARK_LONGS, MARK_SHINGLES = 16, 400
COLUMNS = 4096
#: A class that holds more than this part of all rows is common.
COMMON = 1000

ROWS = "doc_id long, text_hash long, set_id long, n int, mark binary, slice int, counts binary"


def bucket(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _slices(counts: np.ndarray) -> list[tuple[int, bytes]]:
    parts = counts.reshape(-1, SLICE)
    return [(i, p.astype(np.uint16).tobytes()) for i, p in enumerate(parts) if p.any()]


def total(slices: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches (slice, counts), slice by slice on the executors; BUCKETS numbers come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(counts, np.uint16).astype(np.uint32)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()])], names=["slice", "counts"])

    summed = slices.repartition(max(1, min(BUCKETS // SLICE, 16)), "slice").mapInArrow(run, "slice int, counts binary")
    out = np.zeros((BUCKETS // SLICE, SLICE), np.uint32)
    for i, counts in summed.collect():
        out[i] = np.frombuffer(counts, np.uint32)
    return out.reshape(-1)


def mark(s: np.ndarray) -> bytes:
    """The set's bitmap: 2.5 bits a shingle or more, the place of a shingle by its hash's first bits."""
    width = MARK_LONGS * 64
    while len(s) * MARK_LONGS * 64 > width * MARK_SHINGLES:
        width *= 4
    bits = np.zeros(width, bool)
    bits[(mix(s) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """A row per document (number, size and mark of its set) and, at a task's end, the slices of its sketch."""
    source = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_id", pa.int64()), ("n", pa.int32()), ("mark", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(BUCKETS, np.uint32), set()
        for batch in batches:
            rows = []
            for s in shingle_sets(texts_of(batch), words):
                number = set_id(s)
                new = len(s) and number not in seen  # the mark goes with the first text of a set only
                if new:
                    seen.add(number)
                    np.add.at(counts, bucket(s), 1)
                rows.append((number, len(s), mark(s) if new else None))
            columns = zip(*rows) if rows else [[]] * 3
            none = pa.nulls(len(rows))
            own = [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(list(c)) for c in columns), none, none]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(own, schema)], schema=schema)
        slices = _slices(np.minimum(counts, 65535))
        none = pa.nulls(len(slices))
        own = [none] * 5 + [pa.array([i for i, _ in slices]), pa.array([c for _, c in slices])]
        yield pa.record_batch([c.cast(f.type) for c, f in zip(own, schema)], schema=schema)

    return source.mapInArrow(run, ROWS)


def _prefixes(docs: DataFrame, words: int, percent: int, order) -> DataFrame:
    """(token, n, set_id, pos) of the prefix of every set; a set that a task meets again is left out."""

    def start():
        counts, seen = order.value, set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for s in shingle_sets(texts_of(batch), words):
                if not len(s) or (number := set_id(s)) in seen:
                    continue
                seen.add(number)
                n = len(s)
                size = n + (-percent * n // 100) + 1
                often = counts[bucket(s)]
                if size * 4 < n:  # only what can be in the prefix is sorted
                    near = often <= np.partition(often, size - 1)[size - 1]
                    s, often = s[near], often[near]
                out.append((s[np.lexsort((s, often))[:size]], number, n))
            if not out:
                return None
            length = [len(t) for t, _, _ in out]
            token = np.concatenate([t for t, _, _ in out]).view(np.int64)
            pos = np.concatenate([np.arange(k) for k in length]).astype(np.int32)
            return pa.record_batch([pa.array(token), pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), length)), pa.array(np.repeat(np.array([i for _, i, _ in out], np.int64), length)), pa.array(pos)], names=["token", "n", "set_id", "pos"])

        return step

    return map_batches(docs.select("text"), "token long, n int, set_id long, pos int", start)


def list_blocks(n: np.ndarray, number: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Blocks (rows) of one index list, sorted by size: cut where sizes are too far apart; repeated sets are one."""
    rows = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (n[1:] != n[:-1])]))
    far = np.flatnonzero(n[rows][:-1] * 100 < percent * n[rows][1:]) + 1
    for block in np.split(rows, far):
        if len(block) > 1:
            yield block


def _open(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether positions leave rows i and j a link: the largest overlap has shingles before the common one, and from it on."""
    at_i, at_j, n_i, n_j = (c.astype(np.int64) for c in (pos[i], pos[j], n[i], n[j]))
    most = np.minimum(at_i, at_j) + np.minimum(n_i - at_i, n_j - at_j)
    return most * (100 + percent) >= percent * (n_i + n_j)


def _pairs(first: np.ndarray, n: np.ndarray, number: np.ndarray, pos: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of the lists of two rows (at ``first``) in which a link is possible, sorted, and the lists' numbers."""
    near = (number[first] != number[first + 1]) & (n[first].astype(np.int64) * 100 >= percent * n[first + 1].astype(np.int64))
    first = first[near & _open(n, pos, first, first + 1, percent)]
    pairs = np.sort(np.stack([number[first], number[first + 1]], axis=1), axis=1)
    return pairs, pair_ids(pairs.view(np.uint64))


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of rows sorted by the first one, and the edges of its runs, no run in two parts unless it is longer than LIST_ROWS."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.array(batch.column(c).to_pylist(), object) if pa.types.is_binary(batch.column(c).type) else batch.column(c).to_numpy() for c in names]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        cut = int(np.searchsorted(held[0], held[0][-1]))
        cut = len(held[0]) if len(held[0]) - cut > LIST_ROWS else cut
        if cut:
            done, held = [c[:cut] for c in held], [c[cut:] for c in held] if cut < len(held[0]) else None
            yield done, np.flatnonzero(np.concatenate([[True], done[0][1:] != done[0][:-1], [True]]))
    if held is not None and len(held[0]):
        yield held, np.flatnonzero(np.concatenate([[True], held[0][1:] != held[0][:-1], [True]]))


def _lists(prefixes: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(list, set_id) of the blocks in which a link is possible; the same sets are the same list. A null list: set_id is chained to ``other``."""
    prepare(prefixes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: tuple[int, int] | None = None
        for (token, n, number, pos), edges in whole_runs(batches, ["token", "n", "set_id", "pos"]):
            size = np.diff(edges)
            goes_on = token[edges[:-1]] == chain[0] if chain else np.zeros(len(size), bool)
            pairs, lists = _pairs(edges[:-1][(size == 2) & ~goes_on], n, number, pos, percent)
            out: list[tuple[np.ndarray, np.ndarray]] = [(np.repeat(lists, 2), pairs.ravel())]
            chained: list[tuple[int, int]] = []
            rest = (size > 2) | goes_on
            for a, b in zip(edges[:-1][rest].tolist(), edges[1:][rest].tolist()):
                if chain and chain[0] == token[a] or b - a > LIST_ROWS:  # a part of a list too long to hold
                    first = chain[1] if chain and chain[0] == token[a] else int(number[a])
                    chained += [(int(x), first) for x in number[a:b] if x != first]
                    chain = int(token[a]), first
                    continue
                for block in list_blocks(n[a:b], number[a:b], percent):
                    rows = a + block
                    if len(rows) == 2 and not _open(n, pos, rows[:1], rows[1:], percent)[0]:
                        continue
                    own = np.sort(number[rows])
                    out.append((np.full(len(own), set_id(own.view(np.uint64))), own))
            if len(pairs) or len(out) > 1:
                lists, members = (np.concatenate(c) for c in zip(*out))
                table = pa.table({"list": lists, "set_id": members}).group_by(["list", "set_id"]).aggregate([])
                none = pa.nulls(table.num_rows, pa.int64())
                yield pa.record_batch([table.column("list").combine_chunks(), table.column("set_id").combine_chunks(), none], names=["list", "set_id", "other"])
            if chained:
                yield pa.record_batch([pa.nulls(len(chained), pa.int64()), pa.array([x for x, _ in chained]), pa.array([y for _, y in chained])], names=["list", "set_id", "other"])

    return prefixes.repartition(partitions, "token").sortWithinPartitions("token", "n", "set_id").mapInArrow(run, "list long, set_id long, other long")


class Marks:
    """Sizes and marks of a list's sets, held against each other."""

    def __init__(self, n: np.ndarray, marks: list[bytes], percent: int):
        self.n, self.percent = n.astype(np.int64), percent
        self.width = np.array([len(m) for m in marks])
        self.bits: dict[int, np.ndarray] = {}
        self.place = np.zeros(len(marks), np.int64)
        for width in np.unique(self.width):
            at = np.flatnonzero(self.width == width)
            self.place[at] = np.arange(len(at))
            self.bits[int(width)] = np.frombuffer(b"".join(marks[i] for i in at), np.uint8).reshape(len(at), width)

    def _wide(self, rows: np.ndarray, width: int, to: int) -> np.ndarray:
        """Bitmaps of rows of one width, folded to ``to`` bytes."""
        bits = self.bits[width][self.place[rows]]
        if width != to:
            bits = np.packbits(np.unpackbits(bits, axis=1).reshape(len(rows), to * 8, -1).any(2), axis=1)
        return bits.view(np.uint64)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether sets i and j can link by sizes and marks, pair by pair."""
        n_i, n_j = self.n[i], self.n[j]
        out = np.minimum(n_i, n_j) * 100 >= self.percent * np.maximum(n_i, n_j)
        for widths in np.unique(self.width[i][out] << 32 | self.width[j][out]).tolist():
            width_i, width_j = widths >> 32, widths & 0xFFFFFFFF
            to = min(width_i, width_j)
            here = np.flatnonzero(out & (self.width[i] == width_i) & (self.width[j] == width_j))
            for a in range(0, len(here), step := max(1, (1 << 22) // to)):
                at = here[a : a + step]
                x, y = self._wide(i[at], width_i, to), self._wide(j[at], width_j, to)
                # a shingle whose bit the other mark lacks is not in the other set
                most = np.minimum(n_i[at] - np.bitwise_count(x & ~y).sum(1), n_j[at] - np.bitwise_count(y & ~x).sum(1))
                out[at] = most * (100 + self.percent) >= self.percent * (n_i[at] + n_j[at])
        return out

    def families(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of rows that hang each family of the list together."""
        family = np.full(len(rows), -1)
        pivots, out = [], []
        for at in range(len(rows)):
            if family[at] >= 0:
                continue
            family[at] = at
            pivots.append(at)
            left = np.flatnonzero(family < 0)
            for x in left[self.may_link(np.full(len(left), rows[at]), rows[left])]:
                family[x] = at
                out.append((int(rows[at]), int(rows[x])))
        label, held = family.copy(), np.zeros(len(rows), bool)  # held: what earlier pivots answered; the pivots themselves know all later sets
        for p in pivots:
            mine = np.flatnonzero(family == p)
            for x in mine if held.any() else ():
                others = np.flatnonzero(held & (label != label[x]))
                hits = others[self.may_link(np.full(len(others), rows[x]), rows[others])]
                for y in hits[np.unique(label[hits], return_index=True)[1]]:
                    out.append((int(rows[x]), int(rows[y])))
                    label[label == label[y]] = label[x]
            held[mine] = True
            held[p] = False
        return out


def _family_edges(lists: DataFrame, marks: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b): sets of one list that can link, as few as hang the list's families together."""
    prepare(lists.sparkSession)
    known = checkpoint(lists.filter("list is not null").select("list", "set_id").distinct().join(marks, "set_id"))
    first = known.groupBy("list").agg(F.min_by(F.struct("set_id", "n", "mark"), "set_id").alias("pivot"))
    each = known.join(first, "list").filter(F.col("set_id") != F.col("pivot.set_id"))
    rows = each.select("list", "set_id", "n", "mark", F.col("pivot.set_id").alias("other"), F.col("pivot.n").alias("other_n"), F.col("pivot.mark").alias("other_mark"))

    def held_to_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            n = np.concatenate([batch.column(c).to_numpy() for c in ("n", "other_n")])
            own = Marks(n, batch.column("mark").to_pylist() + batch.column("other_mark").to_pylist(), percent)
            linked = own.may_link(np.arange(m), np.arange(m) + m)
            yield pa.record_batch([batch.column("list"), batch.column("set_id"), batch.column("other"), pa.array(linked)], names=["list", "a", "b", "linked"])

    answered = checkpoint(rows.mapInArrow(held_to_pivot, "list long, a long, b long, linked boolean"))
    mixed = answered.filter(~F.col("linked")).select("list").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, number, n, own), edges in whole_runs(batches, ["list", "set_id", "n", "mark"]):
            held = Marks(n, own, percent)
            out = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                out += held.families(np.arange(a, b))
            if out:
                i, j = np.array(out).T
                yield pa.record_batch([pa.array(number[i]), pa.array(number[j])], names=["a", "b"])

    gathered = known.join(mixed, "list", "left_semi").repartition(partitions, "list").sortWithinPartitions("list", "set_id")
    further = gathered.select("list", "set_id", "n", "mark").mapInArrow(run, "a long, b long")
    return answered.filter("linked").select("a", "b").unionByName(further)


def _needed_sets(docs: DataFrame, words: int, ids: DataFrame) -> DataFrame:
    """(set_id, shingles) of the sets in ``ids`` (set_id). A bounded sketch of the ids keeps other texts' sets in their task."""

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(BUCKETS, bool)
        for batch in batches:
            found[bucket(batch.column("set_id").to_numpy())] = True
        own = _slices(found)
        yield pa.record_batch([pa.array([i for i, _ in own], pa.int32()), pa.array([c for _, c in own], pa.binary())], names=["slice", "counts"])

    flags = docs.sparkSession.sparkContext.broadcast(total(ids.select("set_id").mapInArrow(flag, "slice int, counts binary")) > 0)

    def start():
        wanted, seen = flags.value, set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = {}
            for s in shingle_sets(texts_of(batch), words):
                number = set_id(s)
                if number not in seen and wanted[bucket(np.array([number]))[0]]:
                    seen.add(number)
                    out[number] = s.tobytes()
            return pa.record_batch([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["set_id", "shingles"])

        return step

    sets = map_batches(docs.select("text"), "set_id long, shingles binary", start)
    return sets.join(ids.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """|S & T| of all pairs, derived from the first set's overlaps and everyone's difference from it."""
    pivot = sets[0]
    differ = [np.setxor1d(pivot, s, assume_unique=True) for s in sets]
    token, column = np.unique(np.concatenate(differ), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(d) for d in differ])
    at = np.searchsorted(pivot, token)
    inside = np.zeros(len(token), bool) if not len(pivot) else pivot[np.minimum(at, len(pivot) - 1)] == token
    loss = np.bincount(row, weights=inside[column], minlength=len(sets))  # -<P, dS>
    product = np.zeros((len(sets), len(sets)), np.float32)
    often = np.bincount(column, minlength=len(token)) > 1
    used = np.cumsum(often) - 1
    sign = np.where(inside, -1, 1).astype(np.float32)
    keep = often[column]
    row, column = row[keep], column[keep]
    for first in range(0, int(often.sum()), COLUMNS):
        here = (used[column] >= first) & (used[column] < first + COLUMNS)
        d = np.zeros((len(sets), COLUMNS), np.float32)
        d[row[here], used[column[here]] - first] = sign[column[here]]
        product += d @ d.T
    out = len(pivot) - loss[:, None] - loss[None, :] + np.rint(product)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out.astype(np.int64)


def joining_links(sets: list[np.ndarray], percent: int, together: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs (rows) that link, as few as join all that are linked; rows of ``together`` are joined already."""
    parent = list(range(len(sets)))

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    if together is not None and together.any():
        same = np.flatnonzero(together).tolist()
        for c in same:
            parent[c] = same[0]
    size = np.array([len(s) for s in sets])
    both = overlaps(sets)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1)))):
        if (a := root(i)) != (b := root(j)):
            parent[a] = b
            out.append((i, j))
    return out


def _family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside families, as few as join all that are linked. members: (family, set_id)."""
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("set_id").alias("pivot"))
    blocked = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    known = checkpoint(blocked.join(sets, "set_id"))
    pivots = known.filter("set_id = pivot").select("family", F.col("shingles").alias("pivot_shingles"))
    rows = known.filter("set_id <> pivot").join(pivots, "family").select("family", "set_id", "pivot", "shingles", "pivot_shingles")

    def with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in batches:
            linked = []
            for family, s, p in zip(*(batch.column(c).to_pylist() for c in ("family", "shingles", "pivot_shingles"))):
                if family != last:
                    last, pivot = family, np.frombuffer(p, np.uint64)
                own = np.frombuffer(s, np.uint64)
                at = np.minimum(np.searchsorted(pivot, own), len(pivot) - 1)
                both = int((pivot[at] == own).sum())
                linked.append(100 * both >= percent * (len(own) + len(pivot) - both))
            if linked:
                yield pa.record_batch([batch.column("family"), batch.column("set_id"), batch.column("pivot"), pa.array(linked)], names=["family", "a", "b", "linked"])

    answered = checkpoint(rows.mapInArrow(with_pivot, "family long, a long, b long, linked boolean"))
    apart = answered.filter(~F.col("linked"))
    # only blocks of sets that don't link with the pivot meet all blocks
    home = apart.select("family", F.col("a").alias("set_id")).join(sizes, "family").select("family", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("asks")).distinct()
    joined = known.join(answered.filter("linked").select(F.col("a").alias("set_id"), F.lit(True).alias("linked")), "set_id", "left").withColumn("linked", F.coalesce("linked", F.col("set_id") == F.col("pivot")))
    unlinked = joined.filter(~F.col("linked")).select("family", F.col("block").alias("asks"), F.lit(-1).alias("block"), "set_id", "shingles", "linked")
    met = joined.join(home, "family").select("family", "asks", "block", "set_id", "shingles", "linked")
    # the unlinked sets of a block go to each unit of that block; a unit holds them and one block
    spread = unlinked.join(sizes, "family").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = met.unionByName(spread.filter("asks <> block").select("family", "asks", "block", "set_id", "shingles", "linked"))

    def run(table):
        numbers = table.column("set_id").to_pylist()
        links = joining_links([np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()], percent, np.array(table.column("linked").to_pylist(), bool))
        return pa.table({"a": pa.array([numbers[i] for i, _ in links], pa.int64()), "b": pa.array([numbers[j] for _, j in links], pa.int64())})

    return answered.filter("linked").select("a", "b").unionByName(units.groupBy("family", "asks", "block").applyInArrow(run, "a long, b long"))


def link(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, set_id, n_shingles, component_id and class (the class's number, never null) of every row."""
    spark = docs.sparkSession
    rows = checkpoint(_fingerprints(docs, words))
    order = spark.sparkContext.broadcast(total(rows.filter("slice is not null").select("slice", "counts")))
    labelled = rows.filter("slice is null")
    marks = rows.filter("mark is not null").select("set_id", "n", "mark").dropDuplicates(["set_id"])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = checkpoint(_lists(_prefixes(docs, words, percent, order), percent, partitions))
    edges = _family_edges(lists, marks, percent, partitions).unionByName(lists.filter("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    members = checkpoint(components(edges).select(F.col("id").alias("set_id"), F.col("component").alias("family")))
    sets = _needed_sets(docs, words, members)
    classes = components(_family_links(members, sets, percent)).select(F.col("id").alias("set_id"), F.col("component").alias("class"))
    joined = checkpoint(labelled.select("doc_id", "text_hash", "set_id", "n").join(classes, "set_id", "left").withColumn("class", F.coalesce("class", "set_id")))
    least = checkpoint(joined.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")))
    # fewer than COMMON classes hold more than their part of all rows: they are sent to the rows, not the rows to them
    common = F.broadcast(least.filter(F.col("rows") > joined.count() // COMMON))
    full = joined.filter("n > 0")
    rest = full.join(common, "class", "left_anti").join(least, "class")
    alone = joined.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "set_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "class"]
    return full.join(common, "class").select(*columns).unionAll(rest.select(*columns)).unionAll(alone.select(*columns))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; columns stay, whatever they are called.

    Rows that repeat both id and text are one document. A null text counts as empty, and documents without
    words are nobody's copies; a null id takes part and comes after all others. Texts are shuffled once,
    by a key of id and text, to keep one row of each and to meet the chosen keys; repeated rows are put
    together before that.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    key = lambda doc_id, hash_: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), hash_.cast("string"))
    linked = link(docs.select("doc_id", "text"), words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    winners = linked.filter("n_shingles > 0").groupBy("class").agg(first).select(key(F.col("first.doc_id"), F.col("first.text_hash")).alias("key"))
    alone = linked.filter("n_shingles = 0").select(key(F.col("doc_id"), F.col("text_hash")).alias("key")).distinct()
    rows = docs.select(key(F.col("doc_id"), text_hash).alias("key"), F.struct("*").alias("row")).dropDuplicates(["key"])
    return rows.join(winners.unionByName(alone), "key", "left_semi").select("row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
