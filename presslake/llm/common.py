"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.session import read, ship

#: Bytes of an Arrow batch: a batch of very long texts stays small in a worker's memory.
BATCH_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def prepare(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def vocabulary(spark: SparkSession, path: str) -> Callable[[], str]:
    """Sends a vocabulary file to the workers; the function gives its place there."""
    name = os.path.basename(path)
    spark.sparkContext.addFile(path)
    return lambda: SparkFiles.get(name)


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with per-task set-up: ``start()`` runs once a task and returns the function for a batch."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or start()
            if (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def crc_fold(doc_id, folds: int = 5):
    """The fold of a document: crc32 of its id as text, modulo ``folds``; a null id has fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of docs whose judged row meets the condition, with docs' columns, whatever they are called."""
    names = docs.columns
    own = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(names)))
    return judge(own).filter(condition).select(*own.columns).toDF(*names)
