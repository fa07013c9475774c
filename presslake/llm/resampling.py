"""Importance resampling towards a target: documents are drawn by how much likelier their words are in a benchmark.

Counts of hashed words and word pairs are inverted: a task turns its documents, block by block, into
postings, a row per bucket that holds the documents and their counts. The rows are shuffled by groups of
buckets and there meet the buckets' totals in both corpora: a bucket's gain is computed where its
postings are, and what goes on is its contribution to the documents of a block, summed over the group.
Contributions are shuffled by block and reduced by document.

A bucket of a very common word is a row in every block, no larger than the block; a group's rows are
dealt out over salts by block, SALT_BLOCKS of them at most to a salt, so that no task's part of a bucket
grows with the corpus. Totals are combined before their shuffle: BUCKETS rows.

Draws are Gumbel keys: the highest scores are numbered by a range sort, whatever their number.

Defined cases: a null or empty text, or one without words, has no features and weight 0; a null doc_id
counts as an empty one in its key and comes last of equal scores; repeated rows are drawn each for
itself; a benchmark without words leaves T and t at 0; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import documents, prepare
from presslake.llm.ordering import numbered
from presslake.session import checkpoint, read, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Words, on lower-cased bytes, and what parts them (fixed values).
WORD, GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: A text is read in pieces of about so many bytes; a block ends with so many postings or documents.
PIECE_BYTES, BLOCK_POSTINGS, BLOCK_DOCS = 1 << 20, 4 << 20, 1 << 16
#: Buckets of a group, and blocks of a salt.
GROUP, SALT_BLOCKS = 100, 16
POSTING = "block long, bucket int, total long, n int, docs binary, counts binary, doc_ids array<long>, features array<long>, words array<long>"


def bucket_counts(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets of a text's words and pairs, how often each occurs, and the number of words."""
    text = text.lower()
    parts, at, last, n = [], 0, None, 0
    while at < len(text):
        cut = GAP.search(text, at + PIECE_BYTES)
        end = cut.start() if cut else len(text)
        words = WORD.findall(text, at, end)
        at = end
        if not words:
            continue
        n += len(words)
        single = list(map(crc32, words))
        # the crc of a pair goes on from the one of its first word
        pairs = list(map(crc32, map(b" ".__add__, words[1:]), single))
        if last is not None:
            pairs.append(crc32(b" " + words[0], last))
        last = single[-1]
        parts.append(np.unique(np.array(single + pairs, np.uint32) % buckets, return_counts=True))
    if len(parts) == 1:
        return *parts[0], n
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    sums = np.zeros(buckets, np.int64)
    for own, counts in parts:
        sums[own] += counts
    found = np.flatnonzero(sums)
    return found, sums[found], n


def packed(values: np.ndarray, signed: bool = False) -> bytes:
    """Numbers as bytes, as few to each as all of them can do with."""
    for code in ("<i2", "<i4", "<i8") if signed else ("<u1", "<u2", "<u4", "<u8"):
        if values.min(initial=0) >= np.iinfo(code).min and values.max(initial=0) <= np.iinfo(code).max:
            return values.astype(code).tobytes()
    raise OverflowError


def unpacked(data: bytes, n: int, signed: bool = False) -> np.ndarray:
    return np.frombuffer(data, f"<{'i' if signed else 'u'}{len(data) // n}").astype(np.int64)


class Block:
    """Documents of a task until they are inverted."""

    def __init__(self, block: int):
        self.block, self.size, self.own, self.docs = block, 0, [], []

    def add(self, doc_id: int | None, text: bytes, buckets: int) -> None:
        found, counts, words = bucket_counts(text, buckets)
        found = found.astype(np.uint16 if buckets <= 1 << 16 else np.uint32)  # sorted by their digits
        self.own.append((found, counts))
        self.docs.append((doc_id, int(counts.sum()), words))
        self.size += len(found)

    def rows(self) -> pa.RecordBatch:
        """A row per bucket, and one (bucket -1) for the documents."""
        buckets, counts = (np.concatenate(c) for c in zip(*self.own))
        docs = np.repeat(np.arange(len(self.own)), [len(found) for found, _ in self.own])
        order = np.argsort(buckets, kind="stable")
        buckets, counts, docs = buckets[order], counts[order].astype(np.int64), docs[order]
        edges = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
        spans = list(zip(edges[:-1], edges[1:])) if len(buckets) else []
        longs, none = pa.list_(pa.int64()), [None] * len(spans)
        columns = [
            pa.array([self.block] * (len(spans) + 1), pa.int64()),
            pa.array([*(int(buckets[a]) for a, _ in spans), -1], pa.int32()),
            pa.array([*(int(counts[a:b].sum()) for a, b in spans), None], pa.int64()),
            pa.array([*(b - a for a, b in spans), None], pa.int32()),
            # places of documents as steps from one to the next: a common bucket's are small
            pa.array([*(packed(np.diff(docs[a:b], prepend=0)) for a, b in spans), None], pa.binary()),
            pa.array([*(packed(counts[a:b]) for a, b in spans), None], pa.binary()),
            *(pa.array([*none, list(c)], longs) for c in zip(*self.docs)),
        ]
        return pa.record_batch(columns, names=[f.split()[0] for f in POSTING.split(", ")])


def postings(docs: DataFrame, buckets: int = BUCKETS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """POSTING rows of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        own = Block(number)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own.add(doc_id, text or b"", buckets)
                if own.size >= block_postings or len(own.docs) == BLOCK_DOCS:
                    yield own.rows()
                    own = Block(own.block + 1)
        if own.docs:
            yield own.rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, POSTING)


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int = BUCKETS) -> int:
    """Thousand times the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    return math.floor(1000 * math.log(((t + 1.0) * (all_s + float(buckets))) / ((s + 1.0) * (all_t + float(buckets)))))


def contributions(inverted: DataFrame, totals: DataFrame, all_s: int, all_t: int, buckets: int) -> DataFrame:
    """(block, size, sums): what a group's buckets add to the documents of a block, from postings and totals (bucket, s, t) brought together by group and salt."""
    salts = -(-inverted.filter("bucket = -1").count() // SALT_BLOCKS) or 1
    group = F.floor(F.col("bucket") / GROUP).cast("int").alias("grp")
    left = inverted.filter("bucket >= 0").select(group, F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), "block", "bucket", "n", "docs", "counts")
    right = totals.select(group, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "bucket", "s", "t")

    def run(own: pa.Table, both: pa.Table) -> pa.Table:
        gains = {b: gain(s, t, all_s, all_t, buckets) for b, s, t in zip(*(both.column(c).to_pylist() for c in ("bucket", "s", "t")))}
        sums: dict[int, np.ndarray] = {}
        for block, bucket, n, docs, counts in zip(*(own.column(c).to_pylist() for c in ("block", "bucket", "n", "docs", "counts"))):
            at = np.cumsum(unpacked(docs, n))
            known = sums.get(block)
            if known is None or len(known) <= at[-1]:
                sums[block] = np.zeros(int(at[-1]) + 1, np.int64)
                if known is not None:
                    sums[block][: len(known)] = known
            sums[block][at] += gains[bucket] * unpacked(counts, n)
        return pa.table({"block": pa.array(list(sums), pa.int64()), "size": pa.array([len(v) for v in sums.values()], pa.int32()), "sums": pa.array([packed(v, True) for v in sums.values()], pa.binary())})

    return left.groupBy("grp", "salt").cogroup(right.groupBy("grp", "salt")).applyInArrow(run, "block long, size int, sums binary")


def reduced(added: DataFrame, inverted: DataFrame) -> DataFrame:
    """doc_id, n_features, n_words and weight of every document, its block's contributions added up."""
    none = lambda t: F.lit(None).cast(t)
    docs = inverted.filter("bucket = -1").select("block", none("int").alias("size"), none("binary").alias("sums"), "doc_ids", "features", "words")
    both = docs.unionByName(added.select("*", *(none("array<long>").alias(c) for c in ("doc_ids", "features", "words"))))

    def run(own: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        head = next(r for r in rows if r["doc_ids"] is not None)
        features, sums = np.array(head["features"], np.int64), np.zeros(len(head["features"]), np.int64)
        for r in rows:
            if r["size"]:
                sums[: r["size"]] += unpacked(r["sums"], r["size"], True)
        return pa.table({"doc_id": pa.array(head["doc_ids"], pa.int64()), "n_features": features, "n_words": pa.array(head["words"], pa.int64()), "weight": sums // np.maximum(features, 1)})

    return both.groupBy("block").applyInArrow(run, "doc_id long, n_features long, n_words long, weight long")


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """doc_id, n_features, n_words and weight (mean gain of its features, rounded down) of every document; ``target`` is a table with texts."""
    prepare(docs.sparkSession)
    inverted = written(postings(docs, buckets, block_postings))
    aimed = postings(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, block_postings)
    sums = lambda df, name: df.filter("bucket >= 0").groupBy("bucket").agg(F.sum("total").alias(name))
    totals = checkpoint(sums(inverted, "s").join(sums(aimed, "t"), "bucket", "full").na.fill(0))
    all_s, all_t = totals.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    return reduced(contributions(inverted, totals, all_s, all_t, buckets), inverted)


def gumbel(doc_id, seed: int):
    """A draw of its own for every id: floor(-1000 ln(-ln u))."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Every document's weight and score, and the rank of those drawn: the ``percent`` highest scores of the documents with ``least_words`` words or more."""
    weighed = weights(docs, target, buckets, block_postings)
    scored = checkpoint(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id()))
    eligible = scored.filter(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"]
    ranked = numbered(eligible, order, "rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))


#: crc32 byte by byte over a table that the first query makes; features of a text are distinct words and pairs, hashed once each.
ORACLE_SQL = r"""
WITH crc_table AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT row_number() OVER () AS r, doc_id, true AS own, text FROM documents UNION ALL SELECT -row_number() OVER () AS r, NULL, false, text FROM benchmark),
w AS (SELECT r, doc_id, own, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM texts),
f AS (SELECT r, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM w),
c AS (SELECT r, own, feature, count(*) AS n FROM f GROUP BY ALL),
k AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM c)),
b AS (SELECT feature, xor(list_reduce(list_concat([4294967295], list_transform(range(len(h) // 2), lambda i: CAST(16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT))), lambda a, x: xor(a // 256, t[CAST(xor(a % 256, x) + 1 AS INTEGER)])), 4294967295) % 10000 AS bucket FROM k, crc_table),
p AS (SELECT r, own, bucket, n FROM c JOIN b USING (feature)),
g AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT own), 0) AS DOUBLE) AS t FROM p GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM g),
gains AS (SELECT bucket, CAST(floor(1000 * ln((g.t + 1) * (a.s + 10000) / ((g.s + 1) * (a.t + 10000)))) AS BIGINT) AS gain FROM g, a),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM p JOIN gains USING (bucket) WHERE own GROUP BY r),
d AS (SELECT w.r, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
             CAST(('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM w LEFT JOIN m USING (r) WHERE own),
s AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM d),
e AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) OVER () AS n FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM s LEFT JOIN e USING (r)"""
