"""Merkle manifest of a dataset: a tree per language, one over their roots, and a proof of every document.

A parent's place and number of children (its arity) follow from the size of its tree alone. So a combiner
needs no order of events: children come in with their place, a partial parent holds those that it has
seen, and once its arity is met it becomes its digest, which is a child of the next level: ancestors are
emitted as far as they can be. Leaves are range-sorted by language and id, so that a task completes all
parents but the few at its edges; children of parents that stay partial (the frontier) are shuffled by a
span of places, 64 times as long in every round, and combined again until nothing is open. A parent's
row lists its children, and these links are followed the other way for proofs: from the roots down in
strides of three levels, each step meeting the rows of one subtree, 512 leaves at most, in one task.

A proof is a text: for every level, from the leaf's, the place in the run and the siblings' digests.

Defined cases: null fields count as the contract's ``-``; null languages come first and are a tree of
their own; documents with a null id come first in theirs and are never tampered with; documents of one
id are ordered by their leaf, repeated rows stand side by side, each with its own place; an empty text
is a text of 0 bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import documents, prepare
from presslake.llm.ordering import SMALL, attached, numbered
from presslake.session import checkpoint

#: Children of a parent are 2 ** BITS; proofs go down STRIDE levels a step; a round's spans are 2 ** (BITS * WIDEN) times as long.
BITS, STRIDE, WIDEN = 3, 3, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a combiner emits.
RUN, ROOT, OPEN = range(3)
NODE = "kind int, grp long, n long, level int, idx long, digests array<string>"


def digest_of(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def nodes_at(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    return -(-n // (1 << BITS * level))


def depth_of(n: int) -> int:
    level = 0
    while nodes_at(n, level) > 1:
        level += 1
    return level


class Partial:
    """Partial parents: child digests by place, until the arity that the tree's size gives is met."""

    def __init__(self):
        self.open: dict[tuple, dict[int, str]] = {}

    def add(self, grp: int, n: int, level: int, idx: int, digest: str) -> Iterator[tuple]:
        """Takes a child in and gives the rows of all parents that it completes, and the root."""
        while (size := nodes_at(n, level)) > 1:
            parent, place = idx >> BITS, idx & ((1 << BITS) - 1)
            key = grp, n, level, parent
            children = self.open.setdefault(key, {})
            children[place] = digest
            if len(children) < min(1 << BITS, size - (parent << BITS)):
                return
            del self.open[key]
            run = [children[i] for i in range(len(children))]
            level, idx, digest = level + 1, parent, digest_of(run)
            yield RUN, grp, n, level, idx, run
        yield ROOT, grp, n, level, idx, [digest]

    def frontier(self) -> Iterator[tuple]:
        for (grp, n, level, parent), children in self.open.items():
            for place, digest in children.items():
                yield OPEN, grp, n, level, (parent << BITS) + place, [digest]


def batch_of(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


NODE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]
NODE_NAMES = ["kind", "grp", "n", "level", "idx", "digests"]


def combine(nodes: DataFrame) -> DataFrame:
    """NODE rows of what every partition of ``nodes`` (grp, n, level, idx, digest), sorted by place, completes or leaves open."""
    prepare(nodes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Partial()
        for batch in batches:
            out = [row for node in zip(*(c.to_pylist() for c in batch.columns)) for row in own.add(*node)]
            if out:
                yield batch_of(out, NODE_TYPES, NODE_NAMES)
        yield batch_of(list(own.frontier()), NODE_TYPES, NODE_NAMES)

    return nodes.select("grp", "n", "level", "idx", "digest").mapInArrow(run, NODE)


def tree(leaves: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(runs, roots) of the trees over ``leaves`` (grp, n, idx, digest), which are range-sorted by grp and idx and ``rows`` in number."""
    partitions = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = BITS
    while (1 << span) < 8 * rows // partitions:
        span += BITS
    found = checkpoint(combine(leaves.withColumn("level", F.lit(0))))
    done = [found.filter(F.col("kind") != OPEN)]
    while found.filter(F.col("kind") == OPEN).limit(1).count():
        place = F.expr(f"shiftleft(idx, {BITS} * level)")
        left = found.filter(F.col("kind") == OPEN).select("grp", "n", "level", "idx", F.col("digests")[0].alias("digest"))
        left = left.repartition(partitions, "grp", F.shiftright(place, span)).sortWithinPartitions("grp", place, "level")
        found = checkpoint(combine(left))
        done.append(found.filter(F.col("kind") != OPEN))
        span += BITS * WIDEN
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    runs = every.filter(F.col("kind") == RUN).select("grp", "level", "idx", "digests")
    return runs, every.filter(F.col("kind") == ROOT).select("grp", "level", F.col("digests")[0].alias("digest"))


def step_down(path: str, run: list[str], place: int) -> str:
    """The proof of a run's child from the one of its parent."""
    token = f"{place}{''.join(run[:place])}{''.join(run[place + 1:])}"
    return f"{token},{path}" if path else token


def siblings(path: str) -> str:
    """The digests of a proof, level by level."""
    return "".join(token[1:] for token in path.split(",")) if path else ""


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its proof give."""
    for token in path.split(",") if path else ():
        at = 64 * int(token[0]) + 1
        leaf = digest_of((token[1:at], leaf, token[at:]))
    return leaf


HEAD, LINK, LEAF = range(3)
MEMBER = ["grp", "subtree", "kind", "level", "idx", "path", "top", "digests", "key", "leaf", "altered"]
MEMBER_TYPES = ["long", "long", "int", "int", "long", "string", "string", "array<string>", "long", "string", "string"]


def _members(df: DataFrame, kind: int, high: int) -> DataFrame:
    """Rows of one shape for the steps down from level ``high``; a row's subtree is the node above it at that level."""
    df = df.withColumns({"kind": F.lit(kind), "subtree": F.expr(f"shiftright(idx, {BITS} * ({high} - level))")})
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in zip(MEMBER, MEMBER_TYPES)))


def _walk(partition: DataFrame, low: int, finish, schema: str) -> DataFrame:
    """Follows links in every subtree: gives the heads of the next step, or at level 0 what ``finish`` makes of the leaves."""
    prepare(partition.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, paths, top = None, {}, None
        for batch in batches:
            heads, leaves = [], []
            for grp, subtree, kind, level, idx, path, above, run_, key, leaf, altered in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, subtree) != at:
                    at, paths = (grp, subtree), {}
                if kind == HEAD:
                    paths[level, idx], top = path, above
                    if finish is None and level == low:
                        heads.append((grp, level, idx, path, above))
                elif kind == LINK:
                    own = paths[level, idx]
                    for place in range(len(run_)):
                        child = level - 1, (idx << BITS) + place
                        paths[child] = step_down(own, run_, place)
                        if finish is None and child[0] == low:
                            heads.append((grp, *child, paths[child], top))
                else:
                    leaves.append((key, leaf, altered, paths[0, idx], top))
            if finish is None:
                if heads:
                    yield batch_of(heads, [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()], ["grp", "level", "idx", "path", "top"])
            elif leaves:
                yield finish(leaves)

    return partition.mapInArrow(run, schema)


def descend(runs: DataFrame, heads: DataFrame, leaves: DataFrame, depth: int, finish, schema: str) -> DataFrame:
    """What ``finish`` makes of every leaf (key, leaf, altered) with its proof, from ``heads`` (grp, level, path, top), a row per tree's root."""
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = max(1, -(-depth // STRIDE))
    roots, above = heads.withColumn("idx", F.lit(0).cast("long")), None
    for step in reversed(range(steps)):
        low, high = STRIDE * step, STRIDE * (step + 1)
        inside = (F.col("level") > (low if step else -1)) & (F.col("level") <= high)
        own = _members(roots.filter(inside), HEAD, high).unionByName(_members(runs.filter(inside), LINK, high))
        own = own if above is None else own.unionByName(_members(above, HEAD, high))
        own = own if step else own.unionByName(_members(leaves.withColumn("level", F.lit(0)), LEAF, high))
        dealt = own.repartition(partitions, "grp", "subtree").sortWithinPartitions("grp", "subtree", "kind", F.col("level").desc(), "idx")
        if step:
            above = checkpoint(_walk(dealt, low, None, "grp long, level int, idx long, path string, top string"))
    return _walk(dealt, 0, finish, schema)


def lower_ascii(text: Column) -> Column:
    """A-Z, and nothing else, in lower case."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def leaf_digest(text: Column) -> Column:
    """The leaf of a document: every field with its length, so that no two documents read alike."""
    own = {"text": text}
    value = lambda c: own.get(c, F.col(c)).cast("string")
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in FIELDS)), 256)


class Manifest(NamedTuple):
    """leaves: key (doc_id), grp, n, idx, digest, altered; runs and roots of the languages' trees; the same of the tree over their roots, and its root."""

    leaves: DataFrame
    runs: DataFrame
    roots: DataFrame
    depth: int
    top_runs: DataFrame
    top_leaves: DataFrame
    top_depth: int
    root: str | None


def manifest(docs: DataFrame, altered: Column | None = None, small: int = SMALL) -> Manifest:
    """The trees over ``docs``; ``altered`` is a text to be proved in place of the document's own where it isn't null."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf_digest(altered))
    # a language as a key that is never null and sorts alike
    hashed = docs.select(F.col("doc_id").cast("long").alias("key"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("tree"), leaf_digest(F.col("text")).alias("digest"), other.alias("altered"))
    hashed = checkpoint(hashed.withColumn("row", F.monotonically_increasing_id()))
    placed = numbered(hashed, ["tree", "key", "digest", "row"], "place").drop("row")
    sizes = checkpoint(placed.groupBy("tree").agg(F.min("place").alias("grp"), F.count("*").alias("n"), F.count("*").alias("many")))
    rows, largest, trees = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1)), F.count("*")).first()
    joined, sorted_still = attached(placed, sizes, "tree", rows, small=small)
    leaves = joined.select("grp", "n", (F.col("place") - F.col("grp")).alias("idx"), "digest", "altered", "key")
    if not sorted_still:
        leaves = checkpoint(leaves).repartitionByRange(partitions, "grp", "idx").sortWithinPartitions("grp", "idx")
    runs, roots = tree(leaves, rows)
    top = numbered(checkpoint(roots), ["grp"], "idx").select(F.lit(0).cast("long").alias("grp"), F.lit(trees).cast("long").alias("n"), "idx", "digest", F.col("grp").alias("key"))
    top_runs, top_roots = tree(top, trees)
    whole = top_roots.first()
    return Manifest(leaves, runs, roots, depth_of(largest), top_runs, top, depth_of(max(trees, 1)), whole and whole.digest)


def paths_only(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of([(key, path) for key, _, _, path, _ in rows], [pa.int64(), pa.string()], ["grp", "path"])


def folded(rows: list[tuple]) -> pa.RecordBatch:
    out = [(key, leaf, top, hashlib.sha256(siblings(path).encode()).hexdigest(), fold(altered or leaf, path)) for key, leaf, altered, path, top in rows]
    return batch_of(out, [pa.int64(), *[pa.string()] * 4], ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])


def whole_proofs(rows: list[tuple]) -> pa.RecordBatch:
    return batch_of([(key, altered or leaf, path) for key, leaf, altered, path, _ in rows], [pa.int64(), pa.string(), pa.string()], ["doc_id", "leaf", "proof"])


def _down(own: Manifest, finish, schema: str) -> DataFrame:
    none = F.lit(None).cast("string")
    top = own.top_leaves.select("grp", "idx", "key", F.col("digest").alias("leaf"))
    start = own.top_leaves.limit(1).select(F.lit(0).cast("long").alias("grp"), F.lit(own.top_depth).alias("level"), F.lit("").alias("path"), none.alias("top"))
    paths = checkpoint(descend(own.top_runs, start, top, own.top_depth, paths_only, "grp long, path string"))
    heads = own.roots.join(paths, "grp").select("grp", "level", "path", F.col("digest").alias("top"))
    return descend(own.runs, heads, own.leaves.withColumnRenamed("digest", "leaf"), own.depth, finish, schema)


def proofs(own: Manifest) -> DataFrame:
    """doc_id, leaf (the altered one, if there is one) and proof of every document; fold() of the two is the root."""
    return _down(own, whole_proofs, "doc_id long, leaf string, proof string")


def verified(own: Manifest) -> DataFrame:
    """Every document's leaf, subroot, digest of its proof, the root that its altered (or own) leaf folds to, and whether it is the root."""
    out = _down(own, folded, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(own.root)
    return out.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tampered documents are those whose id's crc32 is divisible by 3."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verified(manifest(documents(spark, sf_dir), F.when(chosen, lower_ascii(F.col("text")))))


ORACLE_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, text, source, n_chars,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS INTEGER)])), 4294967295) AS crc
      FROM documents, crc_table),
h AS (SELECT r, doc_id, lang, crc % 3 = 0 AND text IS NOT NULL AS chosen,
             concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head,
             text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM d),
leaves AS (SELECT r, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
                  sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN chosen THEN sha256(head || strlen(low) || ':' || low) END AS altered FROM h),
up AS (SELECT g, 0 AS level, i, leaf AS digest, n FROM leaves
       UNION ALL SELECT g, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (max(n) + 7) // 8 FROM up WHERE n > 1 GROUP BY g, level, i // 8),
subroots AS (SELECT g, digest, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, g AS i, digest, n FROM subroots
        UNION ALL SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (max(n) + 7) // 8 FROM top WHERE n > 1 GROUP BY level, i // 8),
runs AS (SELECT g, level, i // 8 AS p, list(digest ORDER BY i) AS run FROM up WHERE n > 1 GROUP BY ALL UNION ALL SELECT -1, level, i // 8, list(digest ORDER BY i) FROM top WHERE n > 1 GROUP BY ALL),
walk AS (SELECT r, g, 0 AS level, i, coalesce(altered, leaf) AS cur, '' AS proof FROM leaves
         UNION ALL SELECT w.r, w.g, w.level + 1, w.i // 8, sha256(concat(array_to_string(run[:w.i % 8], ''), cur, array_to_string(run[w.i % 8 + 2:], ''))), concat(proof, array_to_string(run[:w.i % 8], ''), array_to_string(run[w.i % 8 + 2:], ''))
         FROM walk w JOIN runs u ON u.g = w.g AND u.level = w.level AND u.p = w.i // 8),
halfway AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1),
climb AS (SELECT r, 0 AS level, g AS i, cur, proof FROM halfway
          UNION ALL SELECT w.r, w.level + 1, w.i // 8, sha256(concat(array_to_string(run[:w.i % 8], ''), cur, array_to_string(run[w.i % 8 + 2:], ''))), concat(proof, array_to_string(run[:w.i % 8], ''), array_to_string(run[w.i % 8 + 2:], ''))
          FROM climb w JOIN runs u ON u.g = -1 AND u.level = w.level AND u.p = w.i // 8),
ends AS (SELECT * FROM climb QUALIFY row_number() OVER (PARTITION BY r ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = t.digest AS verified
FROM leaves JOIN ends USING (r) JOIN subroots s USING (g) JOIN (SELECT digest FROM top WHERE n = 1) t ON true"""
