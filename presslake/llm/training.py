"""Bounded samples of labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.llm.common import crc_fold


def held_out(doc_id):
    return crc_fold(doc_id) == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y, text) of at most ``per_class`` labelled documents of each class, and each class's count over all labels.

    Only rows outside the held-out fold are looked at. An id whose labels contradict each other has none.
    The choice is by a hash of the id, so it is the same in every run; it bounds rows and is the one
    bounded step of training: texts are whole. An id that many rows repeat is one document, the one with
    the least text.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("other"))
    usable = own.filter("y = other").select("doc_id", "y")
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        one = usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # 2 * per_class ids at most: a proven bound for the broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")), counts
