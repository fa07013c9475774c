"""Policy columns on rows made for them."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import dates, policy as P
from presslake.operators import relations as R

NOW = datetime(2024, 5, 1, 12)
PARAGRAPHS = [
    "تعمل الجهات المعنية على تنفيذ المشروع الجديد وفق الخطة المعتمدة خلال الفترة المقبلة في جميع المناطق",
    "واكد المسؤولون ان الخدمات ستصل الى السكان تدريجيا بعد انتهاء اعمال البنية التحتية في الاحياء السكنية",
    "ويشمل البرنامج تدريب العاملين وتحديث الانظمة وتوفير فرص كثيرة للشباب في قطاعات مختلفة من السوق المحلية",
]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("Tue, 02 Jan 2024 03:04:05 GMT", datetime(2024, 1, 2, 3, 4, 5)),
        ("02 Jan 2024 03:04:05 +0300", datetime(2024, 1, 2, 0, 4, 5)),
        ("January 5, 2024", datetime(2024, 1, 5)),
        ("Jan 5, 2024 10:30", datetime(2024, 1, 5, 10, 30)),
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 0, 4)),
        ("٢٠٢٤/١/٢ ٠٣:٠٤", datetime(2024, 1, 2, 0, 4)),
        ("1704164645", datetime(2024, 1, 2, 3, 4, 5)),
        ("12:30", None),
        ("soon", None),
        ("", None),
    ],
)
def test_source_dates(spark, text, want):
    assert one(spark, dates.source_date(F.lit(text))) == want


def test_urls(spark):
    same = {"https://A.org/": "https://a.org/", "https://a.org": "https://a.org/", " nota url ": "nota url", "http://a.org//b//?xfbclid=1&my_utm_source=b&fbclid&UTM_x=2&k=2#f": "http://a.org/b?xfbclid=1&my_utm_source=b&k=2"}
    for url, want in same.items():
        assert one(spark, C.canonical_url(F.lit(url))) == want
    for url in ("http://a@10.0.0.1/x", "http://u:p@localhost/", "http://[::1]/", "ftp://a.org", "http://172.31.0.1", "javascript:1", ""):
        assert not one(spark, C.safe_external(F.lit(url)))
    for url in ("https://u@a.org:80/x", "http://172.32.0.1/", "HTTP://A.org"):
        assert one(spark, C.safe_external(F.lit(url)))


def checked(spark, **given):
    own = {"title": "الجهات المعنية تنفذ المشروع الجديد", "url": "https://news.a.sa/story/1", "canonical": "https://a.sa/story/1", "published": NOW - timedelta(hours=1), "body": PARAGRAPHS, "domain": "a.sa", "approved": True, "language": "ar", "excluded": []} | given
    rows = spark.createDataFrame([tuple(own.values())], "title string, url string, canonical string, published timestamp, body array<string>, domain string, approved boolean, language string, excluded array<string>")
    codes = P.validate(F.col("title"), F.col("url"), F.col("canonical"), F.col("published"), F.col("body"), F.col("approved"), F.col("domain"), F.col("language"), F.col("excluded"), F.lit(NOW), 168)
    return rows.select(codes.alias("x")).first().x


def test_every_code_of_the_validator(spark):
    assert checked(spark) == []
    assert checked(spark, approved=False) == ["source_not_approved_or_active"]
    assert checked(spark, domain="b.sa") == ["source_domain_mismatch"]
    assert checked(spark, language="en") == ["non_arabic_source_language"]
    assert "headline_too_short" in checked(spark, title="خبر جديد")
    assert "institutional_or_service_page" in checked(spark, url="https://a.sa/about-us")
    assert checked(spark, url="http://localhost/x") == ["source_domain_mismatch", "invalid_source_url"]
    assert "non_arabic_content" in checked(spark, title="An English headline here")
    assert "insufficient_article_body" in checked(spark, body=PARAGRAPHS[:1])
    assert checked(spark, published=None) == ["publication_date_could_not_be_parsed"]
    assert checked(spark, published=NOW + timedelta(hours=1)) == ["publication_date_in_future"]
    assert checked(spark, published=NOW - timedelta(days=8)) == ["outside_freshness_window"]
    assert checked(spark, title="كلمات اخرى بعيدة تماما هنا") == ["headline_body_mismatch"]
    assert checked(spark, excluded=["المشروع", "غائب"]) == ["excluded_keyword"]


def test_paragraphs_and_summaries(spark):
    values = [PARAGRAPHS[0], "قصير", PARAGRAPHS[0] + " ", "الرئيسية / " + PARAGRAPHS[1], PARAGRAPHS[1], "an English paragraph of more than thirty five letters"]
    got = one(spark, P.clean_paragraphs(F.array(*map(F.lit, values)), F.lit("عنوان"), F.lit("")))
    assert got == [PARAGRAPHS[0], PARAGRAPHS[1]]
    assert one(spark, P.clean_summary(F.lit("خبر تابعونا على وتابعونا على"))) == "خبر وتابعونا على"
    assert one(spark, P.hashtag_text(F.lit("##السعودية_2030"))) == "السعودية 2030"
    assert one(spark, P.without_article(F.lit("الرياض"))) == "رياض" and one(spark, P.without_article(F.lit("الى"))) == "الى"


def test_windows_follow_the_zone(spark):
    row = one(spark, P.active_window(F.lit(datetime(2024, 4, 1, 1)), "Europe/Berlin"))
    assert row.start == datetime(2024, 3, 25, 23) and row.next_archive == datetime(2024, 4, 1, 22)  # summer time began between
    assert not one(spark, P.in_window(F.lit(None).cast("timestamp"), P.active_window(F.lit(NOW), "Asia/Riyadh")))


def test_duplicates_ignore_empty_keys_and_overlaps_repeat(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "", "c"), (4, "", "d"), (5, "u", "e"), (6, "u", "e"), (7, "u", "z")], "k int, url string, guid string")
    got = sorted(tuple(r) for r in R.exact_duplicates(df, "k", {"url": ["url"], "guid": ["guid"]}).collect())
    assert got == [(6, "url", 5), (7, "url", 5)]
    tags = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["x", "x", "q"]), (3, ["q"])], "k int, tags array<string>")
    assert [tuple(r) for r in R.overlap_counts(tags, "k", "tags", tags.filter("k = 1")).collect()] == [(2, 4)]


def test_pinned_rows_stay(spark):
    rows = [("a", "x", 90, True), ("b", "x", 80, True), ("c", "x", 70, True), ("d", "y", 10, False), ("e", "x", 95, False)]
    df = spark.createDataFrame(rows, "id string, category string, score int, pinned boolean")
    assert [r.id for r in R.balanced_top(df, "category", [F.col("score").desc()], 4, 1, F.col("pinned")).collect()] == ["a", "b", "c", "d"]
