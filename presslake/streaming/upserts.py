"""Tables kept up to date by a stream, a micro-batch at a time; a batch that is replayed changes nothing (STR-5, STR-6).

A table is a folder of committed batches: a batch writes, in a folder named by its id, the buckets of
keys that it touches, whole. Spark's _SUCCESS file, which a job writes last, is the record that the batch
is in; without it the folder is as if it weren't there and is written again. A bucket is read from the
last batch that wrote it. Only touched buckets are rewritten, and their keys met by a join on the bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.operators.runs import on_duplicate

#: Buckets of keys.
BUCKETS = 64


@dataclass
class Table:
    """A table of unique ``key``s under ``path``, with the columns of ``schema``."""

    spark: SparkSession
    path: str
    key: str
    schema: str
    buckets: int = BUCKETS

    def _folder(self, path: str):
        jvm = self.spark._jvm
        own = jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def committed(self) -> dict[int, set[int]]:
        """Batches that are in, with their buckets."""
        system, root = self._folder(self.path)
        found: dict[int, set[int]] = {}
        if not system.exists(root):
            return found
        for status in system.listStatus(root):
            name = status.getPath().getName()
            if name.startswith("batch=") and system.exists(self._folder(f"{self.path}/{name}/_SUCCESS")[1]):
                inside = (s.getPath().getName() for s in system.listStatus(status.getPath()))
                found[int(name[6:])] = {int(n.split("=")[1]) for n in inside if n.startswith("bucket_=")}
        return found

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The table's rows, or those of some buckets."""
        newest: dict[int, int] = {}
        for batch, buckets in sorted(self.committed().items()):
            newest |= dict.fromkeys(buckets, batch)
        paths = [f"{self.path}/batch={batch}/bucket_={bucket}" for bucket, batch in sorted(newest.items()) if only is None or bucket in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def apply(self, rows: DataFrame, batch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Merges a batch's rows with the table's: ``merge(old, new)`` gives the rows of all their keys. False if the batch is in already, or an older one comes after a newer."""
        done = self.committed()
        if done and batch <= max(done):
            return False
        kept = rows.persist()
        try:
            # as many numbers as the table has buckets at most
            touched = {r[0] for r in kept.select(self.bucket()).distinct().collect()}
            merged = merge(self.read(touched), kept).withColumn("bucket_", self.bucket())
            merged.repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{self.path}/batch={batch}")
        finally:
            kept.unpersist()
        return True

    def compact(self) -> None:
        """Deletes batches all of whose buckets later ones have written; what is being read must be read to its end first."""
        done, later = self.committed(), set()
        for batch, buckets in sorted(done.items(), reverse=True):
            if batch != max(done) and buckets <= later:
                system, own = self._folder(f"{self.path}/batch={batch}")
                system.delete(own, True)
            later |= buckets


ARTICLE = "story string, match string, hash string, title string, body string, modified timestamp, seen timestamp, version long, badge string"


def updated_articles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles after a batch of found items (STR-5): unknown stories are added; a known one is updated, its version one higher, only if ``match`` is one of the source's own keys and the text or its date is new.

    Items of one story in a batch are taken in the order of ``seen``: what counts is the last one that would update, and how many would.
    """
    given = new.select("story", "match", "hash", "title", "body", "modified", "seen").withColumn("version", F.lit(None).cast("long"))
    order = Window.partitionBy("story").orderBy(F.col("version").isNull(), "seen", "hash")
    both = old.select("story", "match", "hash", "title", "body", "modified", "seen", "version").unionByName(given)
    # what an item finds is the text and date of the last item before it that counted; an item that is skipped differs in neither, or doesn't count at all
    counts = both.withColumn("strong", F.col("version").isNotNull() | (F.row_number().over(order) == 1) | (on_duplicate(F.col("match"), F.lit("a"), F.lit("b"), F.col("modified"), F.col("modified")) == "update"))
    strong = Window.partitionBy("story", "strong").orderBy(F.col("version").isNull(), "seen", "hash")
    known = counts.withColumns({"known_hash": F.lag("hash").over(strong), "known_modified": F.max("modified").over(strong.rowsBetween(Window.unboundedPreceding, -1)), "first": F.row_number().over(order) == 1})
    applied = known.withColumn("applied", F.col("strong") & (F.col("first") | (on_duplicate(F.col("match"), F.col("hash"), F.col("known_hash"), F.col("modified"), F.col("known_modified")) == "update")))
    at = F.when(F.col("applied"), F.struct(F.col("version").isNull(), "seen", "hash"))
    value = {c: F.max_by(c, at).alias(c) for c in ("match", "hash", "title", "body", "modified", "seen")}
    changes = F.count_if(F.col("applied") & F.col("version").isNull())
    out = applied.groupBy("story").agg(*value.values(), (F.coalesce(F.max("version"), F.lit(0)) + changes).cast("long").alias("version"))
    return out.withColumn("badge", F.when(F.col("version") > 1, F.lit("updated")))


SOURCE = "source string, runs long, failures long, health string, last_success timestamp, last_run timestamp, last_item string, last_published timestamp"


def updated_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """States of sources after a batch of runs (source, at, status, item, published) (STR-6): the last run's health, newest names and times, and the failures since the last healthy run."""
    healthy = F.max(F.when(F.col("status") == "Healthy", F.col("at")))
    named = F.when(F.coalesce(F.col("item"), F.lit("")) != "", F.col("item"))
    runs = new.groupBy("source").agg(F.count("*").alias("n"), F.max_by("status", "at").alias("new_health"), healthy.alias("good"), F.max("at").alias("ran"), F.max_by(named, F.when(named.isNotNull(), F.col("at"))).alias("new_item"), F.max("published").alias("new_published"))
    failed = new.join(runs.select("source", "good"), "source").groupBy("source").agg(F.count_if((F.col("status") != "Healthy") & (F.col("good").isNull() | (F.col("at") > F.col("good")))).alias("failed"))
    both = old.join(runs.join(failed, "source"), "source", "full")
    later = F.col("ran").isNotNull() & (F.col("last_run").isNull() | (F.col("ran") >= F.col("last_run")))
    return both.select(
        "source",
        (F.coalesce("runs", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("runs"),
        F.when(F.col("n").isNull(), F.col("failures")).when(F.col("good").isNotNull(), F.col("failed")).otherwise(F.coalesce("failures", F.lit(0)) + F.col("failed")).cast("long").alias("failures"),
        F.when(later, F.col("new_health")).otherwise(F.col("health")).alias("health"),
        F.greatest("last_success", "good").alias("last_success"),
        F.greatest("last_run", "ran").alias("last_run"),
        F.coalesce(F.when(later, F.col("new_item")), F.col("last_item"), F.col("new_item")).alias("last_item"),
        F.greatest("last_published", "new_published").alias("last_published"),
    )


def keep_updated(stream: DataFrame, table: Table, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str):
    """A query that applies every micro-batch of ``stream`` to ``table``; started again with the same ``checkpoint``, it replays at most the last one, which changes nothing if it was in."""
    return stream.writeStream.foreachBatch(lambda rows, batch: table.apply(rows, batch, merge)).option("checkpointLocation", checkpoint)
