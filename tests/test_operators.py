"""Operators that no query reaches: feeds, streams and edge cases."""

import functools
import math
import time
from datetime import datetime

from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import summaries as S
from presslake.operators import relations as R
from presslake.plans.queries import engagement
from presslake.sources import feeds, pages, sinks
from presslake.streaming import flows


def test_balanced_top_fills_up_beyond_the_cap(spark):
    rows = [("a", "x", 90), ("b", "x", 80), ("c", "x", 70), ("d", "y", 10), ("e", "z", 95)]
    df = spark.createDataFrame(rows, "id string, category string, score int")
    top = R.balanced_top(df, "category", [F.col("score").desc(), F.col("id")], 4, 2)
    assert [r.id for r in top.collect()] == ["e", "a", "b", "d"]
    assert [r.id for r in R.balanced_top(df, "category", [F.col("score").desc(), F.col("id")], 5, 1).collect()] == ["e", "a", "d", "b", "c"]


def test_text_columns(spark):
    df = spark.createDataFrame([("إلى  المدرسةُ!", "#one #two_2 #one"), ("", "")], "a string, b string")
    got = df.select(C.normalized(F.col("a")).alias("n"), C.hashtags(F.col("b")).alias("h"), C.jaccard(C.tokens(F.col("b")), C.tokens(F.col("b"))).alias("j")).collect()
    assert got[0].n == "الي المدرسه" and got[0].h == ["one", "two_2"] and got[1].n == "" and got[1].j == 1.0


def test_shingles_and_rounding(spark):
    df = spark.createDataFrame([(["aa", "b", "cc", "dd"], -2.5)], "w array<string>, x double")
    row = df.select(C.shingles(F.col("w")).alias("s"), C.half_up(F.col("x")).alias("r")).first()
    assert row.s == ["aa cc", "cc dd"] and row.r == -2


def test_upsert_keeps_first_and_overwrites(spark):
    old = spark.createDataFrame([(1, 1, "first", 5)], "k int, seq int, topic string, n int")
    new = spark.createDataFrame([(1, 2, "second", 9), (2, 2, "other", 1)], "k int, seq int, topic string, n int")
    got = R.upsert(old, new, ["k"], "seq", ["topic"], ["n"]).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, "first", 9), (2, "other", 1)]


def test_rss_keeps_the_last_item_of_a_guid(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>a</title><guid>g</guid><link>u</link></item><item><title>b</title><guid>g</guid><link>u</link></item><item><title>c</title><guid></guid><link>v</link></item></channel></rss>")
    assert sorted((r.key, r.title) for r in feeds.rss(spark, str(tmp_path)).collect()) == [("g", "b"), ("v", "c")]


def test_sitemap_titles(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://x.org/a/big-news_today/</loc></url></urlset>")
    assert feeds.sitemap(spark, str(tmp_path)).first().title == "big news today"


def test_stream_drops_repeated_keys(spark, tmp_path):
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(1, at), (1, at), (2, at)], "k int, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    run = flows.first_by_key(stream, "ts", ["k"], "1 hour").writeStream.format("memory").queryName("first_keys").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sorted(r.k for r in spark.table("first_keys").collect()) == [1, 2]


def test_json_ld_roots_arrays_and_graphs(spark):
    block = '<script type="application/ld+json">%s</script>'
    html = [
        block % '{"@type": "NewsArticle", "headline": "One", "url": "u1", "datePublished": "2024-01-02"}',
        block % '[{"@type": ["Article", "Thing"], "headline": "Two", "@id": "u2"}, {"@type": "Person"}]' + block % "not json",
        block % '{"@graph": [{"@type": "BlogPosting", "headline": "Three", "mainEntityOfPage": {"@id": "u3"}}, {"@type": "WebSite"}]}',
        None,
        "",
    ]
    rows = pages.json_ld(spark.createDataFrame(list(enumerate(html)), "page_id long, html string")).orderBy("page_id").collect()
    assert [(r.page_id, r.kind, r.title, r.link, r.published) for r in rows] == [(0, "NewsArticle", "One", "u1", "2024-01-02"), (1, "Article", "Two", "u2", None), (2, "BlogPosting", "Three", "u3", None)]


def test_written_feeds_and_sitemaps_read_back(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 4, 5)
    sinks.write_sitemap(spark.createDataFrame([("https://a.org/some-page", at), ("https://a.org/b?x=1&y=2", None)], "loc string, lastmod timestamp"), f"{tmp_path}/map")
    assert sorted((r["loc"], r.lastmod, r.title) for r in feeds.sitemap(spark, f"{tmp_path}/map").collect())[1] == ("https://a.org/some-page", "2024-01-02T03:04:05Z", "some page")
    sinks.write_rss(spark.createDataFrame([("A & B", "l", "g", "p", "<d>")], "title string, link string, guid string, pubDate string, description string"), f"{tmp_path}/rss")
    assert [tuple(r) for r in feeds.rss(spark, f"{tmp_path}/rss").collect()] == [("g", "A & B", "l", "p", "<d>")]


def test_domains_urls_and_arrays(spark):
    row = spark.range(1).select(
        C.domains_match(F.lit("WWW.a.org"), F.lit("news.a.org")).alias("sub"), C.domains_match(F.lit("ba.org"), F.lit("a.org")).alias("tail"), C.domains_match(F.lit(""), F.lit("a.org")).alias("none"),
        C.safe_external(F.lit("http://192.168.1.1/x")).alias("private"), C.safe_external(F.lit("HTTPS://Example.org:8080/")).alias("safe"), C.safe_external(F.lit(None).cast("string")).alias("null"),
        C.string_array(F.lit('["a, b", "c"]')).alias("json"), C.string_array(F.lit("[a، b")).alias("parts"), C.external_key(F.lit(""), F.lit("k")).alias("key"),
    ).first()
    assert (row.sub, row.tail, row.none, row.private, row.safe, row.null) == (True, False, False, False, True, False)
    assert row.json == ["a, b", "c"] and row.parts == ["[a", "b"] and len(row.key) == 64


def test_engagement_adds_in_the_order_of_events(spark, tmp_path):
    weights = {"view": 0.05, "click": 0.5, "signup": 1.0, "purchase": 2.0, None: 0.0}
    kinds = {user: [["view"] * (10 + 20 * (user % 40)), ["click", "view", "signup", "view", "purchase", None] * user][user % 2] for user in range(120)}
    rows = [(i, user, kind) for i, (user, kind) in enumerate((u, k) for u, own in kinds.items() for k in own)]
    want = {user: math.floor(functools.reduce(lambda total, kind: total + weights[kind], own, 0.0) + 0.5) for user, own in kinds.items() if own}
    # a user's events lie in several files, in no order
    spark.createDataFrame(sorted(rows, key=lambda r: r[0] * 7919 % 1009), "event_id long, user_id long, event_type string").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    assert {r.user_id: r.engagement for r in engagement(spark, str(tmp_path)).collect()} == want


def test_repeats_of_long_turns_take_time_by_their_length(spark):
    words = [f"w{i}x{i % 7}" for i in range(12_000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[3_000:])), ("", ""), (None, "aa bb")], "a string, b string")
    began = time.monotonic()
    rows = [r.d for r in df.select(S.shingle_duplicate(F.col("a"), F.col("b")).alias("d")).collect()]
    assert time.monotonic() - began < 20
    assert (rows[0].duplicate, rows[0].similarity) == (True, 0.75) and (rows[1].duplicate, rows[1].similarity) == (True, 1.0)
