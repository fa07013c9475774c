"""Walks of JSON trees held as VARIANT: every node a row, level by level, in the JVM (SRC-6, SRC-10, SRC-16, SRC-19, SC-J3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes of a tree that are visited unless said otherwise, and the deepest level.
BUDGET, LEVELS = 15_000, 500
#: Names of an image's address, in order (fixed values).
IMAGE = ("url", "path", "contentUrl", "['@id']")
#: Names of lists that hold posts in answers of social interfaces, and of a post's fields, in order (fixed values).
POST = {"post_id": ("id", "id_str", "shortcode"), "text": ("text", "full_text", "caption", "title", "message"), "at": ("created_at", "timestamp", "published_at", "taken_at"), "link": ("url", "permalink", "link"), "likes": ("like_count", "favorite_count", "likes")}


def walk(df: DataFrame, keys: list[str], tree: str, follow: list[str] | None = None, budget: int | None = BUDGET) -> DataFrame:
    """keys, depth, path (places from the root), name (of a member), value and number (from 1) of a tree's nodes, nearest first; the first ``budget`` of a tree.

    ``follow``: the only members to go into, besides all elements of arrays. Trees are told apart by ``keys``; a null
    tree has no nodes. A recursive query: a step per level over all trees at once, no tree on one task. The session's limit
    on the rows of such queries is lifted.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    named = ", ".join(f"`{k}`" for k in keys)
    of = ", ".join(f"t.`{k}`" for k in keys)
    inside = "" if follow is None else "WHERE e.key IS NULL OR e.key IN ({})".format(", ".join("'" + f.replace("'", "''") + "'" for f in follow))
    rows = df.select(*keys, F.col(tree).alias("value")).filter("value is not null")
    found = spark.sql(
        f"""WITH RECURSIVE nodes MAX RECURSION LEVEL {LEVELS} AS (
              SELECT {named}, 0 AS depth, CAST(array() AS ARRAY<INT>) AS path, CAST(NULL AS STRING) AS name, value FROM {{rows}}
              UNION ALL
              SELECT {of}, t.depth + 1, array_append(t.path, e.pos), e.key, e.value FROM nodes t, LATERAL variant_explode(t.value) e {inside})
            SELECT * FROM nodes""",
        rows=rows,
    )
    found = found.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("depth", "path")))
    return found if budget is None else found.filter(F.col("number") <= budget)


def is_object(value: str | Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def member(value: str | Column, *names: str) -> Column:
    """The first of an object's members that says something, as text."""
    return F.coalesce(*(F.nullif(F.try_variant_get(value, f"${n if n.startswith('[') else '.' + n}", "string"), F.lit("")) for n in names), F.lit(""))


def is_text(value: str | Column, name: str) -> Column:
    """Whether an object's member is a text."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) == "STRING", F.lit(False))


def image_value(value: Column, deep: int = 4) -> Column:
    """The address that an image's value says: a text, the first of a list, or an object's address; up to ``deep`` lists in each other (SC-J3)."""
    said = F.lit("")
    for level in reversed(range(deep + 1)):
        at = "$" + "[0]" * level
        kind = F.schema_of_variant(F.try_variant_get(value, at, "variant"))
        own = F.coalesce(*(F.nullif(F.try_variant_get(value, f"{at}{n if n.startswith('[') else '.' + n}", "string"), F.lit("")) for n in IMAGE), F.lit(""))
        said = F.when(kind == "STRING", F.try_variant_get(value, at, "string")).when(kind.startswith("OBJECT"), own).when(kind.startswith("ARRAY"), said).otherwise("")
    return said


def social_posts(answers: DataFrame, keys: list[str], body: str, budget: int = BUDGET) -> DataFrame:
    """keys and POST's fields of all objects in JSON answers that look like posts: an id, and a text; whatever shape the answer has (SRC-19).

    Of those with one id in an answer the nearest counts; a post's numbers are null where they aren't said.
    """
    trees = answers.select(*keys, F.try_parse_json(body).alias("tree"))
    nodes = walk(trees, keys, "tree", None, budget).filter(is_object("value"))
    fields = [member("value", *names).alias(name) for name, names in POST.items()]
    posts = nodes.select(*keys, "number", *fields).filter("post_id <> '' and text <> ''").withColumn("likes", F.col("likes").try_cast("long"))
    first = F.row_number().over(Window.partitionBy(*keys, "post_id").orderBy("number"))
    return posts.withColumn("place", first).filter("place = 1").drop("place")
