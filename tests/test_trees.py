"""Walks of JSON trees against plain Python."""

import json
from collections import deque

from pyspark.sql import functions as F

from presslake.sources import items, pages, trees


def breadth_first(value, follow=None):
    out, queue = [], deque([(0, None, value)])
    while queue:
        depth, name, own = queue.popleft()
        out.append((depth, name, own))
        members = sorted(own.items()) if isinstance(own, dict) else [(None, x) for x in own] if isinstance(own, list) else []
        queue.extend((depth + 1, k, v) for k, v in members if follow is None or k is None or k in follow)
    return out


def walked(spark, values, *rest):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k int, body string").select("k", F.try_parse_json("body").alias("tree"))
    rows = trees.walk(df, ["k"], "tree", *rest).withColumn("value", F.to_json("value")).orderBy("k", "number").collect()
    return {i: [(r.depth, r.name, json.loads(r.value)) for r in rows if r.k == i] for i in range(len(values))}


def test_nodes_come_nearest_first_up_to_the_budget(spark):
    deep = {"x": 1}
    for _ in range(12):
        deep = {"d": [deep]}
    values = [{"b": [1, {"c": "x"}], "a": {"e": [], "f": None}}, [1, [2, [3]]], "text", {}, deep]
    got = walked(spark, values)
    assert all(got[i] == breadth_first(v) for i, v in enumerate(values))
    few = walked(spark, values, None, 3)
    assert all(few[i] == breadth_first(v)[:3] for i, v in enumerate(values))
    some = walked(spark, [{"@graph": [{"@graph": {"n": 1}, "m": {"o": 2}}], "p": 3}], ["@graph"])
    assert some[0] == breadth_first({"@graph": [{"@graph": {"n": 1}, "m": {"o": 2}}], "p": 3}, ["@graph"])


def test_structured_data_and_state_at_any_depth(spark):
    article = {"@type": "NewsArticle", "headline": "Deep", "url": "/1", "datePublished": "2024"}
    ld = {"@graph": [{"@type": "WebPage", "@graph": [[article]], "mainEntity": {"@type": "Article", "headline": "not followed"}}]}
    state = {"a": [[{"b": {"title": "Found", "id": 7, "url": "x.org/1"}}]], "title": 5, "c": {"title": ""}}
    html = f'<script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">{{broken</script><script id="__NEXT_DATA__">{json.dumps(state)}</script>'
    df = spark.createDataFrame([(1, html), (2, ""), (None, None)], "page_id long, html string")
    assert [(r.page_id, r.title, r.link) for r in pages.json_ld(df).collect()] == [(1, "Deep", "/1")]
    assert [(r.page_id, r.title, r.item, r.link) for r in items.app_state(df).orderBy("ordinal").collect()] == [(1, "", "", ""), (1, "Found", "7", "x.org/1")]


def test_image_values(spark):
    values = ["u", ["v", "w"], [["x"]], {"url": "y"}, {"path": "", "contentUrl": "z"}, [{"@id": "i"}], [], {}, 5, None]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k int, body string").select("k", trees.image_value(F.try_parse_json("body")).alias("image"))
    assert [r.image for r in df.orderBy("k").collect()] == ["u", "v", "x", "y", "z", "i", "", "", "", ""]


def test_posts_of_answers_of_any_shape(spark):
    answers = [
        ("x", json.dumps({"data": {"timeline": [{"node": {"id_str": "1", "full_text": "hello", "favorite_count": 3}}, {"node": {"id_str": "1", "full_text": "again, further down", "x": {"id": "9"}}}]}})),
        ("y", json.dumps([{"id": 5, "caption": "picture", "permalink": "/p/5", "like_count": "many"}, {"id": 6}])),
        ("z", "not json"),
    ]
    found = trees.social_posts(spark.createDataFrame(answers, "platform string, body string"), ["platform"], "body").collect()
    assert sorted((r.platform, r.post_id, r.text, r.link, r.likes) for r in found) == [("x", "1", "hello", "", 3), ("y", "5", "picture", "/p/5", None)]
