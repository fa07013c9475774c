"""Every query of the library by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "agg_latest_per_source"


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that gives the same rows."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return register


@query(
    "agg_latest_per_source",
    """SELECT source, count(*) AS n_docs, max(doc_id) AS newest_id, max_by(lang, doc_id) AS newest_lang, sum(n_chars) AS chars
       FROM documents GROUP BY source""",
)
def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("newest_id"), F.max_by("lang", "doc_id").alias("newest_lang"), F.sum("n_chars").alias("chars"))
