"""Signatures, dates and counts over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.functions import dates, signatures as S
from presslake.plans.catalog import query
from presslake.session import read

_SLOTS = " || ',' || ".join(f"min((h * {a} + {b}) % {S.PRIME})" for a, b in S.coefficients())


@query(
    "minhash_signatures",
    rf"""WITH w AS (SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), ' '), lambda x: len(x) > 1) AS w FROM documents),
        s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [NULL] WHEN len(w) = 1 THEN w ELSE list_transform(list_zip(w[1:len(w) - 1], w[2:]), lambda p: p[1] || ' ' || p[2]) END) AS s FROM w),
        u AS (SELECT doc_id, list_reduce(list_transform(string_split(s, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 33 + c) % 4294967296, CAST(5381 AS BIGINT)) AS u FROM s),
        h AS (SELECT doc_id, least(u, 4294967296 - u) AS h FROM u)
        SELECT doc_id, {_SLOTS} AS signature FROM h GROUP BY doc_id""",
)
def minhash_signatures(spark, sf_dir):
    found = S.signatures(read(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", F.array_join("signature", ",").alias("signature"))


@query(
    "source_dates",
    """SELECT event_id, epoch_ms(CASE event_id % 4 WHEN 2 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('day', ts) - INTERVAL 3 HOURS ELSE date_trunc('minute', ts) - INTERVAL 3 HOURS END) AS ms FROM events""",
)
def source_dates(spark, sf_dir):
    """Event times written in four ways: year first, day first, epoch seconds, digits of another script."""
    at = F.col("ts").cast("timestamp")
    way = F.col("event_id") % 4
    text = F.when(way == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 1, F.date_format(at, "d/M/yyyy")).when(way == 2, F.unix_seconds(at).cast("string"))
    text = text.otherwise(F.translate(F.date_format(at, "d-MM-yyyy HH:mm"), "0123456789", dates.DIGITS[:10]))
    return read(spark, sf_dir, "events").select("event_id", F.unix_millis(dates.source_date(text)).alias("ms"))


@query(
    "workflow_funnel",
    """SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS published, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS review,
              count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (WHERE o_totalprice IS NULL OR o_totalprice <= 0) AS failed, 0 AS scheduled FROM orders""",
)
def workflow_funnel(spark, sf_dir):
    """AG-8: all counts of a workflow's states in one pass."""
    status = F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").agg(
        F.count("*").alias("total"),
        F.count_if(status == "F").alias("published"),
        F.count_if(status == "O").alias("pending"),
        F.count_if(status == "P").alias("review"),
        F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"),
        F.count_if(F.col("o_totalprice").isNull() | (F.col("o_totalprice") <= 0)).alias("failed"),
        F.lit(0).alias("scheduled"),
    )
