"""Items of JSON interfaces, listing pages and article pages, from captured bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.functions import markup as M
from presslake.functions import policy as P
from presslake.functions.dates import source_date
from presslake.operators.relations import newest
from presslake.sources.pages import json_ld
from presslake.sources.trees import BUDGET, is_object, is_text, member, walk

STATE = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
ANCHOR = r"""(?is)(<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>)"""
PARAGRAPH = r"(?is)(<p\b[^>]*>.*?</p>)"
#: Classes of an article's body (fixed values).
BODY = r"""(?is)<(?:main|div|section)\b[^>]*class=["'][^"']*(?:article-body|article-content|story-content|entry-content|post-content)[^"']*["'][^>]*>(.*?)</(?:main|div|section)>"""


def api_items(spark: SparkSession, path: str, base: str) -> DataFrame:
    """Items of JSON files: a root array, or else its ``items`` or ``articles``; the first name said of each field counts (SRC-9)."""
    return api_entries(spark.read.text(path, wholetext=True), "value", base)


def api_entries(bodies: DataFrame, body: str, base: str | Column, keep: list[str] | tuple = ()) -> DataFrame:
    """As ``api_items``, from a column of captured bodies, with the columns to ``keep``; one that isn't JSON gives no rows."""
    root = bodies.select(*keep, (base if isinstance(base, Column) else F.lit(base)).alias("base_"), F.try_parse_json(body).alias("v")).filter("v is not null")
    member = lambda at: F.try_variant_get("v", at, "array<variant>")
    entries = F.when(F.schema_of_variant("v").startswith("ARRAY"), member("$")).otherwise(F.coalesce(member("$.items"), member("$.articles")))
    rows = root.select(*keep, "base_", F.explode(entries).alias("v"))
    said = lambda *names: M.first_said(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    out = rows.select(*keep, said("id", "article_id").alias("item"), said("guid", "id").alias("guid"), M.absolute_url(said("url", "link"), F.col("base_")).alias("link"), said("title", "headline").alias("title"), F.nullif(said("published_at", "publishedAt", "date"), F.lit("")).alias("published"))
    return out.filter("link <> '' and title <> ''")


def app_state(pages: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Objects with a text title in the state that a page's script holds, at any depth, nearest first by ``ordinal`` (SRC-10); pages: (page_id, html).

    A state that isn't JSON gives no rows.
    """
    states = pages.select("page_id", F.regexp_extract("html", STATE, 1).alias("state")).filter("state <> ''")
    nodes = walk(states.select("page_id", F.try_parse_json("state").alias("tree")), ["page_id"], "tree", None, budget)
    said = lambda *names: member("value", *names)
    found = nodes.filter(is_object("value") & is_text("value", "title"))
    return found.select("page_id", said("uuid", "id").alias("item"), said("title").alias("title"), said("sharable_link", "url").alias("link"), said("published_at", "datePublished").alias("published"), said("content", "subtitle").alias("content"), F.col("number").cast("long").alias("ordinal"))


def listing_items(pages: DataFrame, most: int = 500) -> DataFrame:
    """Stories that listing pages (page_id, url, html) lead to: structured data, then the script's state, then links (SRC-7).

    One per page and link, the first one found; at most ``most`` of a page. Columns: page_id, link, title, published, origin.
    """
    own = pages.select("page_id", F.col("url").alias("base"))
    news = ~P.non_news_title(F.col("title")) & ~P.non_news_url(F.col("link"))
    structured = json_ld(pages).join(own, "page_id").withColumn("link", M.absolute_url("link", F.col("base")))
    structured = structured.filter((F.col("link") != "") & (F.col("title") != "") & news).select("page_id", "link", "title", source_date(F.col("published")).alias("published"), F.lit(0).alias("rank"), "ordinal")
    state = app_state(pages).filter("link <> '' and published <> ''").join(own, "page_id")
    with_scheme = F.when(F.col("link").rlike("(?i)^https?://"), F.col("link")).otherwise(F.concat(F.lit("https://"), F.regexp_replace("link", "^/+", "")))
    state = state.withColumn("link", M.absolute_url(with_scheme, F.col("base"))).filter((F.col("title") != "") & M.same_site(F.col("link"), F.col("base")) & news)
    state = state.select("page_id", "link", "title", source_date(F.col("published")).alias("published"), F.lit(1).alias("rank"), "ordinal")
    anchors = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))).alias("ordinal", "anchor"))
    links = anchors.select("page_id", "base", M.absolute_url(M.attribute(F.col("anchor"), "href"), F.col("base")).alias("link"), M.decode(F.col("anchor")).alias("title"), F.col("ordinal").cast("long").alias("ordinal"))
    links = links.filter(M.same_site(F.col("link"), F.col("base")) & M.article_like(F.col("link"), F.col("title")))
    links = links.select("page_id", "link", "title", F.lit(None).cast("timestamp").alias("published"), F.lit(2).alias("rank"), "ordinal")
    order = [F.col("rank"), F.col("ordinal")]
    first = newest(structured.unionByName(state).unionByName(links), ["page_id", "link"], order).drop("place")
    kept = newest(first, ["page_id"], order, most)
    origin = F.element_at(F.array(*map(F.lit, ("structured", "state", "link"))), F.col("rank") + 1)
    return kept.select("page_id", "link", "title", "published", origin.alias("origin"))


def hydrate(pages: DataFrame) -> DataFrame:
    """Title, body, canonical URL, dates and author of article pages (page_id, url, html), each from the first place that says it (SRC-11).

    Title: structured headline, social card, first h1. Body: structured text, the article's paragraphs. Published: structured
    data, meta elements, time element, values in scripts, visible date. A page's first structured article counts.
    """
    html = F.col("html")
    block = F.get(F.filter(F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)), F.try_parse_json), lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "string").rlike("(?i)(?:NewsArticle|Article)"), F.lit(False))), 0)
    rows = pages.select("page_id", "url", "html", block.alias("v"))
    said = lambda *names: M.first_said(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    scope = M.first_said(M.element(html, "article"), F.regexp_extract(html, BODY, 1))
    long = lambda n: lambda p: (F.length(p) > n) & ~P.source_boilerplate(p)
    own = F.filter(F.transform(F.split(said("articleBody", "content"), r"\n{2,}|(?<=[.!؟])\s+(?=\p{L})"), M.decode), long(30))
    marked = lambda text, n: F.filter(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(1)), M.decode), long(n))
    inside = marked(scope, 30)
    body = F.when(F.size(own) > 0, own).when(F.size(inside) > 0, inside).when(F.col("v").isNotNull(), marked(html, 45)).otherwise(inside)
    link = F.regexp_extract(html, r"""(?i)(<link\b[^>]*rel=["']canonical["'][^>]*>)""", 1)
    time = M.attribute(F.regexp_extract(html, r"""(?i)(<time\b[^>]*datetime=["'][^"']+["'][^>]*>)""", 1), "datetime")
    published = M.first_said(said("datePublished", "published_at"), M.meta(html, "article:published_time"), M.meta(html, "date"), time, M.raw_value(html, "datePublished", "publishedAt", "published_at", "publishDate", "publishedDate", "createdAt", "created_at"), M.visible_date(html))
    modified = M.first_said(said("dateModified", "updated_at"), M.meta(html, "article:modified_time"), M.raw_value(html, "dateModified", "updatedAt", "updated_at"))
    return rows.select(
        "page_id",
        M.first_said(said("headline"), M.meta(html, "og:title"), M.decode(M.element(html, "h1"))).alias("title"),
        body.alias("body"),
        M.absolute_url(M.first_said(M.attribute(link, "href"), F.col("url")), F.col("url")).alias("canonical"),
        source_date(published).alias("published"),
        source_date(modified).alias("modified"),
        M.first_said(said("author.name"), F.when(~said("author").startswith("{"), said("author")), M.meta(html, "author")).alias("author"),
    )
