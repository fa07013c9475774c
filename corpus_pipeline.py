"""A training corpus from documents: filter, deduplicate, mask secrets and pack, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm import jaccard_join, packing, quality, secrets, toxicity
from presslake.llm.common import kept
from presslake.session import checkpoint, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network predicts as label 1, in their own columns."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return kept(docs, lambda own: quality.score(own, model), "predicted = 1")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity chain doesn't predict as toxic."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return kept(docs, lambda own: toxicity.score(own, model), "predicted = 0")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share 0.8 or more of their five-word shingles."""
    return jaccard_join.deduplicate(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; sources are owners, their languages repositories."""
    return secrets.mask(docs, F.col("lang"), F.col("source"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, placed in a sequence."""
    import public_tokenizers

    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("packing", pack)]
#: No SQL expresses the trained stages; tests check the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
