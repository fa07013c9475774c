"""Batch jobs, pictures and elements on rows made for them."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from presslake.functions import summaries as S
from presslake.operators import repairs as R
from presslake.sources import images


def test_first_seen_is_the_ordered_pass(spark):
    draw = random.Random(7)
    rows = [(i, draw.randrange(40), draw.choice(["", None, *"abcdefghijklm"]), draw.choice(["", None, *"nopqrstuvwxyz"])) for i in range(120)]
    rows += [(200 + i, 100 + i, f"chain{i // 2}", f"link{(i + 1) // 2}") for i in range(12)]
    titles, events, want = {}, {}, {}
    for key, _, title, event in sorted(rows, key=lambda r: (r[1], r[0])):
        want[key] = titles.get(title or None) if titles.get(title or None) is not None else events.get(event or None)
        if want[key] is None:
            if title:
                titles[title] = key
            if event:
                events[event] = key
    df = spark.createDataFrame(rows, "id long, at long, title string, event string")
    assert {r.id: r.original for r in R.first_seen(df, "id", ["at"], "title", "event").collect()} == want


def chain(n):
    """Row i shares its title with the one before it and its event with the one after: every other row stays."""
    return [(i, i, f"t{i // 2}", f"e{(i + 1) // 2}") for i in range(n)]


def test_a_chain_of_any_length_is_decided_in_few_rounds(spark):
    spark.sparkContext.setJobGroup("chain", "chain")
    rows = spark.range(100_000).selectExpr("id", "id AS at", "concat('t', id div 2) AS title", "concat('e', (id + 1) div 2) AS event")
    found = R.first_seen(rows, "id", ["at"], "title", "event")
    assert found.filter("(original IS NULL) <> (id % 2 = 0) OR original <> id - 1").count() == 0
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 20
    spark.sparkContext.setJobGroup("", "")


def test_blocks_are_decided_until_nothing_changes(spark):
    import random

    rng = random.Random(3)
    rows = chain(120) + [(200 + i, rng.randrange(120), f"t{rng.randrange(80)}" if i % 7 else "", f"e{rng.randrange(80)}" if i % 5 else None) for i in range(200)]
    titles, events, want = {}, {}, {}
    for i, _, t, e in sorted(rows, key=lambda r: (r[1], r[0])):
        hits = [seen[c] for seen, c in ((titles, t), (events, e)) if c and c in seen]
        want[i] = hits[0] if hits else None
        if not hits:
            titles |= {t: i} if t else {}
            events |= {e: i} if e else {}
    df = spark.createDataFrame(rows, "id int, at int, title string, event string")
    for size in (64, 1000):
        assert {r.id: r.original for r in R.first_seen(df, "id", ["at"], "title", "event", size).collect()} == want


def test_the_repair_pass(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    long, other = "A summary of the story that has enough characters", "Another paragraph of the story, with words of its own, long enough"
    row = lambda i, title, summary, url, at, content=(), event="", thumb="/t", life="current": (i, title, summary, url, at, list(content), "", event, "sport news", thumb, life, "published", "valid")
    rows = [
        row(1, "First", long, "https://a.org/1", day(20), [other, other + "!", "short", long + " too"]),
        row(2, "first!", long, "https://a.org/2", day(21)),
        row(3, "No summary", "", "https://a.org/3", day(19)),
        row(4, "Local", long, "http://localhost/4", day(19)),
        row(5, "Undated", long, "https://a.org/5", None),
        row(6, "Old", long, "https://a.org/6", day(2), thumb=""),
        row(7, "Other title", long, "https://a.org/7", day(22), event="x"),
        row(8, "Third title", long, "https://a.org/8", day(23), event="x"),
        row(9, "No summary", long, "https://a.org/9", day(24)),
    ]
    schema = "id int, title string, summary string, url string, published timestamp, content array<string>, normalized_title string, event string, category string, thumbnail string, lifecycle string, status string, validity string"
    found = {r.id: r for r in R.repair_pass(spark.createDataFrame(rows, schema), F.lit("2024-01-15").cast("timestamp")).collect()}
    assert {i: (r.status, r.validity, r.original) for i, r in found.items()} == {1: ("published", "valid", None), 2: ("rejected", "duplicate", 1), 3: ("review", "invalid", None), 4: ("review", "invalid", None), 5: ("review", "invalid", None), 6: ("published", "valid", None), 7: ("published", "valid", None), 8: ("rejected", "duplicate", 7), 9: ("published", "valid", None)}
    assert found[1].content == [other] and list(found[1].repairs) == ["repeated_content"]
    assert (found[6].lifecycle, found[6].thumbnail) == ("archived", "/api/media/fallback/sport+news") and list(found[6].repairs) == ["incorrect_age", "missing_image"]


def test_first_seen_of_nothing(spark):
    df = spark.createDataFrame([], "id long, at long, title string, event string")
    assert R.first_seen(df, "id", ["at"], "title", "event").collect() == []


PICTURES = {
    "png": (b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 640, 480) + b"\0", (640, 480)),
    "gif": (b"GIF89a" + struct.pack("<HH", 320, 200) + b"\0", (320, 200)),
    "vp8x": (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (799).to_bytes(3, "little") + (599).to_bytes(3, "little") + b"\0", (800, 600)),
    "vp8l": (b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + (299 | 149 << 14).to_bytes(4, "little") + b"\0" * 8, (300, 150)),
    "vp8": (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 7 + b"\x9d\x01\x2a" + struct.pack("<HH", 400, 300) + b"\0" * 4, (400, 300)),
    "avif": (b"\0\0\0\x14ftypavif" + b"\0" * 8 + b"ispe\0\0\0\0" + struct.pack(">II", 1200, 900) + b"\0", (1200, 900)),
    "jpeg": (b"\xff\xd8\xff\xe0\0\x04ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 90, 120) + b"\0" * 8, (120, 90)),
    "text": (b"no picture at all, only words", (None, None)),
    "empty": (b"", (None, None)),
    "null": (None, (None, None)),
}


def test_image_sizes(spark):
    df = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in PICTURES.items()], "name string, content binary")
    got = {r["name"]: (r.width, r.height) for r in df.select("name", images.image_size(F.col("content")).alias("s")).select("name", "s.*").collect()}
    assert got == {k: v[1] for k, v in PICTURES.items()}


def test_elements_end_at_their_own_tag(spark):
    html = ["<div class='x'>no</div><div class='post-content a'>one<div>two</div>three</div>four", "<div class='post-content'>never closed", None]
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    got = {r.page_id: r.scope for r in images.with_element(pages, "article-body|post-content").collect()}
    assert got == {0: "one<div>two</div>three", 1: "", 2: ""}


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: images.longest_body(F.lit("ab"), F.lit(None).cast("string"), F.lit("cd"), F.lit("c")), "ab"),
        (lambda: R.reclassified(F.lit("خبر"), F.lit("a"), F.lit("b"), F.lit(8), F.lit(False)), "moved"),
        (lambda: R.reclassified(F.lit("خبر"), F.lit("a"), F.lit("b"), F.lit(7), F.lit(False)), "kept"),
        (lambda: R.reclassified(F.lit("خبر"), F.lit("السيارات"), F.lit("b"), F.lit(1), F.lit(False)), "moved"),
        (lambda: R.reclassified(F.lit("news"), F.lit("a"), F.lit("b"), F.lit(9), F.lit(False)), "rejected"),
        (lambda: R.import_state(F.lit("منشور"), F.lit("الهيئة العامة للإحصاء"), F.lit("https://a.org/en/x"), F.lit("x"), F.lit(3)), R.ARCHIVED),
        (lambda: R.import_state(F.lit("منشور"), F.lit("الهيئة العامة للإحصاء"), F.lit("https://a.org/ar/news/1"), F.lit(R.IMPORTED), F.lit(2)), R.REVIEW),
        (lambda: R.import_state(F.lit("منشور"), F.lit("another"), F.lit("https://a.org/en/x"), F.lit(R.IMPORTED), F.lit(3)), "منشور"),
        (lambda: F.to_json(R.settings(F.lit('{"b": "3", "c": "4"}'), F.lit('{"a": "1", "b": "2"}'))), '{"a":"1","b":"3","c":"4"}'),
        (lambda: F.to_json(R.settings(F.lit("not json"), F.lit('{"a": "1"}'))), '{"a":"1"}'),
        (lambda: S.title_fits(F.lit("harbour bridge opens"), F.lit("the bridge of the harbour was opened")), True),
        (lambda: S.title_fits(F.lit("harbour bridge opens"), F.lit("nothing of that")), False),
        (lambda: S.clip(F.lit("one two three four"), 12), "one two…"),
    ],
)
def test_columns(spark, column, want):
    assert spark.range(1).select(column()).first()[0] == want


def test_weak_summaries(spark):
    long = "The harbour bridge opened on Monday after nine years of work and three delays, the port said in the morning. " * 2
    rows = spark.createDataFrame([(1, "Bridge", "short", [long]), (2, "Bridge", "short", ["tiny"])], "id long, title string, text string, body array<string>")
    got = {r.id: r.action for r in R.weak_summaries(rows, F.col("title"), F.col("text"), F.col("body")).collect()}
    assert got == {1: "regenerated", 2: "sent_to_review"}
