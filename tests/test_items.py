"""Markup, summaries, items and runs on rows made for them."""

from datetime import datetime

from pyspark.sql import functions as F

from presslake.functions import markup as M
from presslake.functions import summaries as S
from presslake.operators import runs as R
from presslake.sources import feeds, items, sinks


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_absolute_urls(spark):
    base = "https://A.org/x/y/page?q=1#f"
    want = {"/n": "https://a.org/n", "n": "https://a.org/x/y/n", "../n": "https://a.org/x/n", "../../../n": "https://a.org/n", "./": "https://a.org/x/y/", "//B.org/k": "https://b.org/k", "?z=2": "https://a.org/x/y/page?z=2", "http://c.org": "http://c.org/", "mailto:a@b": "", "a&amp;b": "https://a.org/x/y/a&b"}
    got = values(spark, [(k,) for k in want], "v string", "v", M.absolute_url(F.col("v"), F.lit(base)))
    assert dict(got) == want
    assert values(spark, [("/a",)], "v string", M.absolute_url(F.col("v"), F.lit("not a url"))) == [("",)]


def test_markup_reads_elements_and_null(spark):
    html = """<META content='A &amp; B' property="og:title"><title class="x">T <b>1</b></title>{"imageUrl": "https://a.org/i.png"}"""
    row = values(spark, [(html,)], "h string", M.meta(F.col("h"), "og:title"), M.decode(M.element(F.col("h"), "title")), M.raw_value(F.col("h"), "thumbnail", "imageUrl"))
    assert row == [("A & B", "T 1", "https://a.org/i.png")]
    assert values(spark, [(None,), ("",)], "h string", M.decode(F.col("h")), M.element(F.col("h"), "p")) == [("", ""), ("", "")]


def test_pictures_and_videos(spark):
    sets = [("a.png 1x, b.png 2x",), ("a.png 300w,b.png 300w",), ("only.png",), ("",)]
    assert values(spark, sets, "s string", M.best_of_srcset(F.col("s"))) == [("b.png",), ("a.png",), ("only.png",), ("",)]
    videos = [("https://a.org/v.mp4", "video/mp4"), ("https://cdn.sabq.org/v", None), ("https://a.org/v.png", "video/mp4"), (None, "video/mp4"), ("https://a.org/v", "text/html")]
    assert [r[0] for r in values(spark, videos, "u string, m string", M.video_playable(F.col("u"), F.col("m")))] == [True, True, False, False, False]
    texts = [("/img/logo.png",), ("/author/x.png",), ("/logotype.png",)]
    assert values(spark, texts, "t string", M.not_editorial(F.col("t")), M.not_editorial(F.col("t"), True)) == [(True, True), (True, False), (False, False)]


def test_visible_dates_and_story_links(spark):
    assert values(spark, [("<p>on 5 يناير 2024 10:30 and 2023-01-02</p>",), ("<i>2023-01-02</i> then",), ("none",)], "h string", M.visible_date(F.col("h"))) == [("5 يناير 2024 10:30",), ("2023-01-02",), ("",)]
    links = [("https://a.org/news/1", "A title long enough"), ("https://a.org/news/1", "short"), ("https://a.org/news/privacy/", "A title long enough"), ("https://a.org/news/x.pdf", "A title long enough"), ("http://localhost/news/1", "A title long enough"), ("https://a.org/2024/", "A title long enough")]
    assert [r[0] for r in values(spark, links, "u string, t string", M.article_like(F.col("u"), F.col("t")))] == [True, False, False, False, False, True]


def test_best_sentences_skip_what_is_alike(spark):
    first = "The council approved a budget of 40 million for new roads and bridges in the north."
    other = "Work on the largest of the bridges is expected to begin after the summer break ends."
    rows = spark.createDataFrame([("Council budget", [first, first.replace("40", "41"), other]), ("Nothing", [])], "title string, s array<string>")
    out = S.summarize(rows, F.col("title"), F.col("s"))
    assert [tuple(r) for r in out.select("best", "summary").collect()] == [([first, other], f"{first} {other}"), ([], "")]


def test_capped_and_clean_texts(spark):
    (long, short), = values(spark, [("ab " * 200, "x" * 360)], "a string, b string", S.capped(F.col("a")), S.capped(F.col("b")))
    assert long == ("ab " * 119).strip() + "…" and short == "x" * 360
    texts = [('the news news "open ( quote ) ، end !!',), ("«one» «two",)]
    assert values(spark, texts, "t string", S.editorial_clean(F.col("t"))) == [("the news open (quote)، end!",), ("one two",)]


def test_near_and_verbatim_texts(spark):
    pairs = [("الملك يزور الرياض اليوم", "ملك يزور رياض في اليوم"), ("one two three four", "one two three five"), ("one two three four", "one two three four and"), ("", "x")]
    assert [r[0] for r in values(spark, pairs, "a string, b string", S.near_texts(F.col("a"), F.col("b")))] == [True, False, True, False]
    long = "a passage of words that is long enough to be seen as copied"
    rows = [([long, "short"], f"Before. {long.upper()}! After"), (["short"], "short"), ([], "x")]
    assert [r[0] for r in values(spark, rows, "v array<string>, s string", S.verbatim(F.col("v"), F.col("s")))] == [True, False, False]


def test_publishability_names_all_reasons(spark):
    rows = [("A headline of a fair length", "A summary that says quite other things than that", "c", "https://a.org/1", True, 3, True, []), ("short", None, "غير محدد", "http://localhost/", True, 2, None, ["x"])]
    check = S.publishability(*(F.col(c) for c in "title summary category url imported version verified errors".split()))
    good, bad = values(spark, rows, "title string, summary string, category string, url string, imported boolean, version int, verified boolean, errors array<string>", check)
    assert good == ([],) and len(bad[0]) == 5


def test_social_posts(spark):
    text = "خبر عن المدينة الكبيرة اليوم #وسم_جديد"
    rows = [("x", text, "video", ["https://a.org/v"], None, "video/mp4", None, 10, 2, 3, 100), ("instagram", text, "video", ["https://a.org/i.png"], "https://a.org/v", None, ["t"], 4, 9, 2, None), ("x", "خبر قصير هنا", "video", [], "https://a.org/v", None, None, 1, 1, 1, 1), ("x", "English only text", "text", [], None, None, None, 1, 1, 1, 1)]
    schema = "platform string, content string, media_type string, media_urls array<string>, video_url string, mime string, hashtags array<string>, likes int, reposts int, replies int, views int"
    got = S.social_posts(spark.createDataFrame(rows, schema)).select("media_type", "hashtags", "engagement").collect()
    assert [(r.media_type, r.hashtags, float(r.engagement)) for r in got] == [("video", ["وسم_جديد"], 17.0), ("image", ["t"], 6.0)]


def test_app_state_of_any_depth_and_broken_state(spark):
    html = lambda body: f'<script id="__NEXT_DATA__">{body}</script>'
    pages = [(1, html('{"a": [{"title": "deep", "id": 7, "url": "u"}], "title": "root"}')), (2, html("{not json")), (3, None), (4, html("[" * 100_000))]
    got = items.app_state(spark.createDataFrame(pages, "page_id long, html string")).select("page_id", "title", "item").collect()
    assert [tuple(r) for r in got] == [(1, "root", ""), (1, "deep", "7")]


def test_hydrate_falls_back_in_order(spark):
    full = """<script type="application/ld+json">{"@type": "NewsArticle", "headline": "H", "articleBody": "A first paragraph that is long enough.\\n\\nA second paragraph that is long enough.", "datePublished": "Tue, 02 Jan 2024 03:04:05 GMT", "author": {"name": "N"}}</script><link rel="canonical" href="/c">"""
    plain = """<meta property="og:title" content="Card"><meta name="author" content="M"><article><p>A paragraph of the article that is long enough.</p><p>short</p></article><time datetime="2024-01-02">"""
    rows = spark.createDataFrame([(1, "https://a.org/p", full), (2, "https://a.org/p", plain), (3, "https://a.org/p", "")], "page_id long, url string, html string")
    got = [tuple(r) for r in items.hydrate(rows).orderBy("page_id").select("title", F.size("body"), "canonical", "author", F.col("published").isNotNull()).collect()]
    assert got == [("H", 2, "https://a.org/c", "N", True), ("Card", 1, "https://a.org/p", "M", True), ("", 0, "https://a.org/p", "", False)]


def test_candidate_sources(spark):
    rows = [(1, "عاجل", "active", "Healthy", "a.org", ["x"], 5, 50), (2, "b", "active", "Failing", "b.org", ["y"], 1, 90), (3, "c", "active", "Paused", "c.org", ["x"], 1, 99), (4, "d", "active", None, "d.org", ["x"], 1, 95)]
    sources = spark.createDataFrame(rows, "id long, name string, status string, health string, domain string, main_categories array<string>, priority int, reliability int")
    ids = lambda *a: [r.id for r in R.candidate_sources(sources, *a).collect()]
    assert (ids("source", "2"), ids("category", "x"), ids("failing"), ids("breaking"), ids("all")) == ([2], [1, 4], [2], [1, 4, 2], [1, 2, 4])
    ends = [(None, "", "https://a.org/"), ("", None, ""), ("https://www.example.com/x", "r", "l")]
    assert [r[0] for r in values(spark, ends, "a string, b string, c string", R.misconfigured(F.col("a"), F.col("b"), F.col("c")))] == [False, True, True]


def test_next_run_skips_a_time_that_clocks_leave_out(spark):
    after = [(datetime(2024, 3, 30, 12, 0, 30),)]
    run = lambda minutes: R.next_run(F.col("a").cast("timestamp"), F.lit(True), F.lit("daily"), F.lit(1), F.lit(minutes), F.array(F.lit(0)), "Europe/Berlin").cast("timestamp_ntz")
    assert values(spark, after, "a timestamp_ntz", run(150), run(240)) == [(datetime(2024, 4, 1, 0, 30), datetime(2024, 3, 31, 2, 0))]
    assert values(spark, after, "a timestamp_ntz", R.next_run(F.col("a").cast("timestamp"), F.lit(False), F.lit("hourly"), F.lit(1), F.lit(0), F.array(F.lit(0)), "UTC")) == [(None,)]


def test_slugs_changes_and_enough(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, slug string")
    assert [r.id for r in R.by_slug(rows, "a%20b").collect()] == [1] and [r.id for r in R.by_slug(rows, "2").collect()] == [2]
    assert R.first_enough([rows, rows], 2).count() == 2 and R.first_enough([rows, rows], 3).count() == 4


def test_sitemaps_of_a_site_and_search_feeds(spark, tmp_path):
    (tmp_path / "map").mkdir()
    urls = "".join(f"<url><loc>https://a.org/news/the-long-story-{i}</loc></url>" for i in range(5)) + "<url><loc>https://b.org/news/the-long-story-9</loc></url>"
    (tmp_path / "map" / "s.xml").write_text(f"<urlset>{urls}</urlset>")
    got = feeds.sitemap(spark, f"{tmp_path}/map", "https://www.a.org/", 2).collect()
    assert sorted(r.title for r in got) == ["the long story 3", "the long story 4"]
    (tmp_path / "rss").mkdir()
    (tmp_path / "rss" / "f.xml").write_text("<rss><item><title>Story - Paper</title><source>Paper</source><link>l</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></rss>")
    assert feeds.search_feed(spark, f"{tmp_path}/rss").first().title == "Story"


def test_sinks_replace_partitions_and_news(spark, tmp_path):
    path, schema = str(tmp_path / "briefs"), "v long, day string"
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, "day")
    sinks.replace_partitions(spark.createDataFrame([(3, "b")], schema), path, "day")
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    rows = spark.createDataFrame([("https://a.org/1", "T", datetime(2024, 1, 30)), ("https://a.org/2", "old", datetime(2024, 1, 1))], "loc string, title string, published timestamp_ntz").withColumn("published", F.col("published").cast("timestamp"))
    sinks.write_news_sitemap(rows, f"{tmp_path}/news", now)
    back = spark.read.text(f"{tmp_path}/news", wholetext=True).first()[0]
    assert "<news:title>T</news:title>" in back and "old" not in back
