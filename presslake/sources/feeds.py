"""Feed and sitemap sources over captured files, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.functions import markup as M
from presslake.functions.dates import source_date
from presslake.operators.relations import newest

ITEM = "title string, link string, guid string, pubDate string, description string"
ENTRY = "title string, id string, updated string, summary string, link struct<_href: string>"


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files, one per file and guid or else link, the last one kept (SRC-3)."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    keyed = rows.withColumn("key", F.coalesce(F.nullif("guid", F.lit("")), "link")).withColumn("ordinal", F.monotonically_increasing_id())
    return newest(keyed, ["file", "key"], [F.col("ordinal").desc()]).select("key", "title", "link", "pubDate", "description")


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files (SRC-4)."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    return rows.select(F.col("id").alias("key"), "title", F.col("link._href").alias("link"), F.col("updated").alias("pubDate"), F.col("summary").alias("description"))


def sitemap(spark: SparkSession, path: str, listing: str | None = None, most: int = 500) -> DataFrame:
    """Pages of sitemap files, with a title from the last part of the path (SRC-5).

    With a ``listing`` URL: only stories of its site, and the last ``most`` of each file.
    """
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    rows = rows.select(F.trim("loc").alias("loc"), "lastmod", M.slug_title(F.trim("loc"), F.lit("")).alias("title"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ordinal"))
    if listing is not None:
        rows = rows.filter(M.same_site(F.col("loc"), F.lit(listing)) & M.article_like(F.col("loc"), F.col("title")))
        rows = newest(rows, ["file"], [F.col("ordinal").desc()], most)
    return rows.select("loc", "lastmod", "title")


def search_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items of a search, their source's name cut off the end of the title (SRC-22)."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(ITEM + ", source string").load(path)
    ending = F.concat(F.lit(" - "), F.col("source"))
    bare = F.when(F.coalesce(F.col("title").endswith(ending), F.lit(False)), F.substring("title", F.lit(1), F.length("title") - F.length(ending))).otherwise(F.col("title"))
    return rows.select(bare.alias("title"), "source", "link", source_date(F.col("pubDate")).alias("published"))
