"""Structured data inside captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.sources.trees import BUDGET, is_object, walk

BLOCK = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
#: Types that count as articles (fixed values).
ARTICLE = "^(Article|NewsArticle|ReportageNewsArticle|LiveBlogPosting|BlogPosting)$"


def json_ld(pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Articles in the JSON-LD blocks of pages (page_id, html): roots, members of arrays and of @graph, however deep, nearest first by ``ordinal`` (SRC-6).

    A block that isn't JSON gives no rows; a type list counts by its first member.
    """
    blocks = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1))).alias("place", "block"))
    trees = blocks.select("page_id", "place", F.try_parse_json("block").alias("tree"))
    nodes = walk(trees, ["page_id", "place"], "tree", ["@graph"], budget).filter(is_object("value"))
    text = lambda path: F.try_variant_get("value", path, "string")
    kind = F.coalesce(text("$['@type'][0]"), text("$['@type']"))
    ordinal = (F.col("place").cast("long") * (1 << 32) + F.col("number")).alias("ordinal")
    return nodes.filter(kind.rlike(ARTICLE)).select("page_id", kind.alias("kind"), text("$.headline").alias("title"), F.coalesce(text("$.url"), text("$.mainEntityOfPage['@id']"), text("$['@id']")).alias("link"), text("$.datePublished").alias("published"), ordinal)
