"""Sinks by Spark's writers: XML as a folder of part files, each a whole document, and tables replaced by partition."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a news sitemap holds (fixed values).
NEWS_AGE, NEWS_MOST = timedelta(hours=48), 1000
NEWS_ROOT = 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"'


def write_sitemap(pages: DataFrame, path: str) -> None:
    """Pages (loc string, lastmod timestamp) as sitemap files (SNK-15)."""
    rows = pages.select("loc", F.date_format("lastmod", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastmod"))
    rows.write.format("xml").option("rootTag", "urlset").option("rowTag", "url").mode("overwrite").save(path)


def news_pages(pages: DataFrame, now: Column) -> DataFrame:
    """The newest pages (loc, title, published) of the last 48 hours, at most 1,000 (SNK-15)."""
    recent = (F.col("published") >= now - F.lit(NEWS_AGE)) & (F.col("published") <= now)
    return pages.filter(recent).orderBy(F.col("published").desc(), "loc").limit(NEWS_MOST)


def write_news_sitemap(pages: DataFrame, path: str, now: Column) -> None:
    """``news_pages`` as sitemap files with news elements (SNK-15)."""
    news = F.struct(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("news:publication_date"), F.col("title").alias("news:title"))
    news_pages(pages, now).select("loc", news.alias("news:news")).write.format("xml").option("rootTag", NEWS_ROOT).option("rowTag", "url").option("validateName", "false").mode("overwrite").save(path)


def write_rss(items: DataFrame, path: str) -> None:
    """Items (title, link, guid, pubDate, description) as RSS channels."""
    items.select("title", "link", "guid", "pubDate", "description").write.format("xml").option("rootTag", "channel").option("rowTag", "item").mode("overwrite").save(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Rows in place of all that their partitions held; other partitions stay (SNK-4, SNK-17)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_rows(df: DataFrame, path: str, defaults: dict | None = None) -> None:
    """Rows added to a Parquet table, missing columns by default (SNK-1, SNK-12)."""
    missing = {name: F.lit(value) for name, value in (defaults or {}).items() if name not in df.columns}
    df.withColumns(missing).write.mode("append").parquet(path)
