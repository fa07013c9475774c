"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous steps.

Documents are tokenised in one narrow pass; what goes on is one small row per piece. Pieces are packed
class by class, longest first (CLASSES). A step is a successor sweep over two tables at once: the pieces
of the class and the gaps of the open sequences are range-sorted by size, longest first, gaps before
pieces of their size. Read in this order a gap opens a bracket and a piece closes the last one that is
open, so that the longest pieces are first to take the smallest gap that holds them; a piece's rank
decides where several want the same gap. Brackets are matched without a driver or a single task: a
running sum over the range partitions gives every row its depth, and a piece's gap is the row before it
at the same depth. The rows of one depth are few however large the tables are, as depth rises and falls
once per size. Matched gaps shrink, and the sweep is repeated until no piece finds a gap. Pieces that
have no successor then open sequences together: as many as any pieces of the class fit, in the order of
their rank, or as many of one length as fit, what is left of the lengths by a running sum.

Where a class has more pieces than there are gaps, a gap takes part as several slots of the class's
length. Places in a sequence are dealt out at the end, longest piece first.

Defined cases: a null text counts as empty; an empty text is its end token alone; repeated rows are
packed each for itself; a null doc_id stays null; pieces of equal length are told apart by a row
number, so that ties have one result for one reading of the table; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.llm.common import documents, map_batches, prepare, texts_of
from presslake.llm.common import vocabulary as shipped
from presslake.session import checkpoint

CAPACITY, END_ID = 1024, 2
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Longest pieces of the classes, as parts of the capacity; the first class, of longer ones, opens sequences of one piece each.
CLASSES = (2, 3, 4, 8, 32)
#: Up to as many pieces to a sequence, any of a class fit; beyond, those of one length are put together.
SHORT = 4
#: Rows of a step to a partition: a step takes as many tasks as its rows need, and no more than the session's shuffle partitions.
ROWS = 20_000

_encoders: dict = {}


def encoder(vocabulary: str, pattern: str, tokenizer: str, special: str, special_id: int):
    """text -> ids of the vocabulary's ranks, as an array without a Python list of them; ``special`` inside a text is its own id, as the JSON form ``tokenizer`` of the same vocabulary has it.

    The pattern looks ahead behind white space, and its engine gives up with a ValueError on a run of about a
    million white-space characters; such a text is encoded by the JSON form, which cuts it without looking back.
    """
    if (vocabulary, special) not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[vocabulary, special] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})
    own = _encoders[vocabulary, special]

    def encode(text: str) -> np.ndarray:
        try:
            return own.encode_to_numpy(text, allowed_special={special}, disallowed_special=())
        except ValueError:
            if tokenizer not in _encoders:
                from tokenizers import Tokenizer

                _encoders[tokenizer] = Tokenizer.from_file(tokenizer)
            return np.array(_encoders[tokenizer].encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(docs: DataFrame, vocabulary: str, pattern: str, tokenizer: str, special: str = "<|endoftext|>", special_id: int = 50256, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and end token, cut into pieces of at most ``capacity``; only the first piece may be shorter."""
    place, json_place = shipped(docs.sparkSession, vocabulary), shipped(docs.sparkSession, tokenizer)

    def start():
        encode = encoder(place(), pattern, json_place(), special, special_id)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(edges))]
            columns = zip(*out)
            return pa.record_batch([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

        return step

    return map_batches(docs.select("doc_id", "text"), PIECE, start)


def spread(rows: int, most: int) -> int:
    """Partitions of a step over ``rows``."""
    return min(most, 1 + rows // ROWS)


def running(df: DataFrame, keys: list, value, partitions: int) -> DataFrame:
    """df, range-sorted by ``keys``, with the running sum of ``value`` (total) and the least that it, or 0, has been with the row (low) and before it (low_before)."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                sums = total + np.cumsum(batch.column("value").to_numpy())
                lows = np.minimum(low, np.minimum.accumulate(sums))
                own = np.full(len(sums), part, np.int32), sums, lows, np.concatenate([[low], lows[:-1]])
                yield pa.record_batch([*(batch.column(c) for c in names), *map(pa.array, own)], names=[*names, "part", "sums", "lows", "before"])
                total, low = int(sums[-1]), int(lows[-1])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    valued = df.coalesce(partitions).withColumn("value", value.cast("long"))
    ranged = valued.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)
    here = checkpoint(ranged.mapInArrow(run, f"{fields}, part int, sums long, lows long, before long"))
    # a row per partition: the sum of the partitions before it, and how low they went
    ends = here.groupBy("part").agg(F.sum(value).alias("sum"), F.min("lows").alias("low"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("shift", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    ends = ends.withColumn("floor", F.coalesce(F.min(F.col("shift") + F.col("low")).over(earlier), F.lit(0))).select("part", "shift", "floor")
    both = here.join(F.broadcast(ends), "part")
    least = lambda c: F.least(F.col("floor"), F.col("shift") + F.col(c))
    return both.select(*names, (F.col("shift") + F.col("sums")).alias("total"), least("lows").alias("low"), least("before").alias("low_before"))


ROW = ["is_piece", "size", "key", "slot", "doc_id", "piece", "start", "ids_crc32"]


def order() -> list:
    return [F.col("size").desc(), F.col("is_piece"), F.col("key"), F.col("slot")]


def sweep(gaps: DataFrame, left: DataFrame, partitions: int) -> DataFrame:
    """One step: rows of gaps (key is the sequence) and pieces, those that found each other with the other's size and key; ``missed`` ranks the pieces that found none."""
    both = gaps.unionByName(left)
    ranged = running(both, order(), F.when(F.col("is_piece"), -1).otherwise(1), partitions)
    missed = F.col("is_piece") & (F.col("low") < F.col("low_before"))
    depth = F.col("total") - F.col("low") + F.col("is_piece").cast("int")
    level = Window.partitionBy("depth").orderBy(*order())
    found = ranged.filter(~missed).withColumn("depth", depth)
    # along a depth gaps and pieces alternate, a gap first
    found = found.select(*ROW, *(F.when(F.col("is_piece"), F.lag(c).over(level)).otherwise(F.lead(c).over(level)).alias(f"other_{c}") for c in ("size", "key")), F.lit(None).cast("long").alias("missed"))
    none = F.lit(None)
    return checkpoint(found.unionByName(ranged.filter(missed).select(*ROW, none.cast("long").alias("other_size"), none.cast("long").alias("other_key"), (-F.col("low")).alias("missed"))))


def _gaps(sequences: DataFrame) -> DataFrame:
    """Rows of gaps from (key, size)."""
    none = F.lit(None)
    return sequences.select(F.lit(False).alias("is_piece"), "size", "key", F.lit(0).alias("slot"), none.cast("long").alias("doc_id"), none.cast("int").alias("piece"), none.cast("long").alias("start"), none.cast("long").alias("ids_crc32"))


def _placed(rows: DataFrame, sequence) -> DataFrame:
    return rows.select("doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", "key", sequence.alias("sequence_id"))


def grouped(left: DataFrame, number: int, fits: int, high: int, capacity: int, partitions: int) -> list[DataFrame]:
    """Pieces that found no gap (``missed`` ranks them), put together in new sequences (column sequence)."""
    base = number << 50
    if fits < SHORT:  # any so many of this class fit
        return [left.withColumn("sequence", -1 - base - F.floor((F.col("missed") - 1) / fits))]
    runs = left.groupBy("size").agg(F.min("missed").alias("first"), F.count("*").alias("many"))  # a row per length
    each = F.floor(F.lit(capacity) / F.col("size"))
    ranked = left.join(F.broadcast(runs), "size").withColumns({"rank": F.col("missed") - F.col("first"), "each": each})
    whole = F.col("rank") < F.col("many") - F.col("many") % F.col("each")
    equal = ranked.filter(whole).withColumn("sequence", -1 - base - F.col("size") * (1 << 39) - F.floor(F.col("rank") / F.col("each")))
    rest = running(ranked.filter(~whole).select(*ROW), order(), F.col("size"), partitions)  # fewer than ``each`` of every length
    mixed = rest.withColumn("sequence", -1 - base - F.floor((F.col("total") - F.col("size")) / (capacity - high + 1)))
    return [equal, mixed]


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the pieces."""
    spark = parts.sparkSession
    prepare(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = checkpoint(parts.withColumn("key", F.monotonically_increasing_id()))
    all_pieces = numbered.select(F.lit(True).alias("is_piece"), F.col("length").alias("size"), "key", F.lit(0).alias("slot"), "doc_id", "piece", "start", "ids_crc32")
    within = lambda low, high: (F.col("size") > low) & (F.col("size") <= high)
    edges = [capacity // c for c in CLASSES if capacity // c] + [0]
    total, *counts = all_pieces.agg(F.count("*"), *(F.count_if(within(low, high)) for high, low in itertools.pairwise(edges))).first()
    alone = all_pieces.filter(F.col("size") > edges[0])
    done = [_placed(alone, F.col("key"))]
    gaps = _gaps(alone.filter(F.col("size") < capacity).select((F.lit(capacity) - F.col("size")).alias("size"), "key"))
    for number, ((high, low), wanted) in enumerate(zip(itertools.pairwise(edges), counts)):
        if not wanted:
            continue
        left, idle = all_pieces.filter(within(low, high)), [gaps.filter(within(0, low))]
        gaps = gaps.filter(F.col("size") > low)
        n_gaps = gaps.count()
        while True:
            each = -(-wanted // n_gaps) if n_gaps else 1  # slots of a gap at most: slots are no more than gaps and pieces together
            if each > 1:
                slots = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / high), F.lit(each))).cast("int")
                last = F.col("slot") + 1 == F.col("slots")
                dealt = gaps.withColumn("slots", slots).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
                dealt = dealt.withColumn("size", F.when(last, F.col("size") - (F.col("slots") - 1) * high).otherwise(F.lit(high).cast("long"))).select(*ROW)
            else:
                dealt = gaps
            swept = sweep(dealt, left, spread(wanted + each * n_gaps, partitions))
            done.append(_placed(swept.filter("is_piece and missed is null"), F.col("other_key")))
            left = swept.filter("missed is not null")
            after = F.col("size") - F.coalesce("other_size", F.lit(0))
            own, taken = swept.filter(~F.col("is_piece")), F.col("other_size").isNotNull()
            if each > 1:
                gaps, again = _gaps(own.withColumn("size", after).groupBy("key").agg(F.sum("size").alias("size"))), F.col("slot") == 0
            else:
                # a piece that missed is longer than any gap that nothing took: those can't serve this class
                idle.append(own.filter(~taken).select(*ROW))
                gaps, again = own.filter(taken).withColumn("size", after).select(*ROW), taken & (after > low)
            idle.append(gaps.filter(within(0, low)))
            gaps = gaps.filter(F.col("size") > low)
            rest, n_gaps = swept.agg(F.count("missed"), F.count_if(~F.col("is_piece") & again)).first()
            if not rest or not n_gaps or rest == wanted:
                break
            left, wanted = left.select(*ROW), rest
        for group in grouped(left, number, capacity // high, high, capacity, spread(rest, partitions)) if rest else ():
            done.append(_placed(group, F.col("sequence")))
            idle.append(_gaps(group.groupBy(F.col("sequence").alias("key")).agg((F.lit(capacity) - F.sum("size")).alias("size"))))
        gaps = checkpoint(reduce(DataFrame.unionByName, idle, gaps).coalesce(spread(total, partitions))) if low else gaps
    together = reduce(DataFrame.unionByName, done).coalesce(spread(total, partitions))
    so_far = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "key")
    return together.withColumn("offset", F.sum("length").over(so_far) - F.col("length")).drop("key")


def best_fit(docs: DataFrame, vocabulary: str, pattern: str, tokenizer: str) -> DataFrame:
    return pack(pieces(docs, vocabulary, pattern, tokenizer))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))
