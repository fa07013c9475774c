"""Text, URL and history functions over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.plans.catalog import query
from presslake.session import read

NOW = datetime(2024, 1, 30, 12)
HOST = r"lower(regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1))"


@query(
    "safe_urls",
    r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'http://a@10.0.0.1/x' WHEN 1 THEN 'http://u:p@localhost:80/' WHEN 2 THEN 'ftp://a.org/' WHEN 3 THEN 'https://172.20.1.1/' ELSE url END AS url FROM pages),
        a AS (SELECT page_id, regexp_matches(lower(url), '^https?://') AS web, split_part(split_part(split_part(string_split(url, '://')[2], '/', 1), '?', 1), '#', 1) AS authority FROM u),
        h AS (SELECT page_id, CASE WHEN web THEN lower(split_part(string_split(authority, '@')[-1], ':', 1)) ELSE '' END AS host FROM a)
        SELECT page_id, host, host <> '' AND host <> 'localhost' AND NOT starts_with(host, '127.') AND NOT starts_with(host, '10.') AND NOT starts_with(host, '192.168.')
        AND NOT coalesce(starts_with(host, '172.') AND TRY_CAST(split_part(host, '.', 2) AS INTEGER) BETWEEN 16 AND 31, false) AS safe FROM h""",
)
def safe_urls(spark, sf_dir):
    """FLT-13, with hosts behind user names and private networks among the pages' URLs."""
    page = F.col("page_id")
    odd = F.when(page % 6 == 0, "http://a@10.0.0.1/x").when(page % 6 == 1, "http://u:p@localhost:80/").when(page % 6 == 2, "ftp://a.org/").when(page % 6 == 3, "https://172.20.1.1/")
    url = odd.otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", C.host(url).alias("host"), C.safe_external(url).alias("safe"))


@query("domain_match", f"SELECT page_id, h LIKE '%.example.org' OR h = 'example.org' AS own FROM (SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS h FROM pages)")
def domain_match(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.domains_match(C.host(F.col("url")), F.lit("www.example.org")).alias("own"))


@query("sentence_counts", r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?؟…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')) AS INTEGER) AS sentences FROM documents")
def sentence_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(C.sentences(F.col("text"))).alias("sentences"))


@query(
    "string_arrays",
    r"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE list_filter(list_transform(string_split_regex(props, '[،,\n]+'), lambda s: trim(s)), lambda s: s <> '')[1] END AS first,
        CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE len(list_filter(list_transform(string_split_regex(props, '[،,\n]+'), lambda s: trim(s)), lambda s: s <> '')) END AS INTEGER) AS n FROM events""",
)
def string_arrays(spark, sf_dir):
    """SC-J1: every other row is a JSON array, the others are parts between commas."""
    value = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("event_type", F.lit("a, b")))).otherwise(F.col("props"))
    found = C.string_array(value)
    return read(spark, sf_dir, "events").select("event_id", F.get(found, 0).alias("first"), F.size(found).alias("n"))


@query("external_keys", "SELECT page_id, sha256(coalesce(nullif(url, ''), CAST(page_id AS VARCHAR))) AS key FROM pages")
def external_keys(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.external_key(F.col("url"), F.col("page_id")).alias("key"))


@query(
    "event_fingerprints",
    r"""WITH w AS (SELECT p_partkey, p_brand, p_type, string_split(lower(trim(regexp_replace(p_name, '[^\p{L}\p{N}]+', ' ', 'g'))), ' ') AS words FROM part),
        u AS (SELECT *, list_filter(words, lambda x, i: len(x) > 3 AND list_position(words, x) = i) AS kept FROM w)
        SELECT p_partkey, sha256(p_brand || '|' || array_to_string(list_sort(kept[1:10]), ' ') || '|' || substr(p_type, 1, 13)) AS fingerprint FROM u""",
)
def event_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", C.event_fingerprint(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("fingerprint"))


@query("body_fingerprints", r"SELECT page_id, sha256(substr(trim(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>', ' ', 'g'), '\s+', ' ', 'g')), 1, 500000)) AS fingerprint FROM pages")
def body_fingerprints(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.body_fingerprint(F.col("html")).alias("fingerprint"))


@query("freshness_labels", "SELECT CASE WHEN age > 168 THEN 'archive' WHEN age > 48 THEN 'older' ELSE 'fresh' END AS label, count(*) AS n FROM (SELECT greatest(1.0, epoch_us(TIMESTAMP '2024-01-30 12:00:00' - ts) / 3.6e9) AS age FROM events) GROUP BY ALL")
def freshness_labels(spark, sf_dir):
    age = C.age_hours(F.col("ts").cast("timestamp"), F.lit(NOW).cast("timestamp"), 1.0)
    return read(spark, sf_dir, "events").groupBy(C.freshness(age).alias("label")).agg(F.count("*").alias("n"))


@query("page_images", r"""SELECT page_id, CAST(len(list_distinct(u)) AS INTEGER) AS images, u[1] AS first FROM (SELECT page_id, list_concat(regexp_extract_all(html, '(?i)<meta[^>]*property="og:image"[^>]*content="([^"]+)"', 1), regexp_extract_all(html, '(?i)<img\b[^>]*\bsrc="([^"]+)"', 1)) AS u FROM pages)""")
def page_images(spark, sf_dir):
    found = C.image_candidates(F.col("html"), 1 << 30)
    return read(spark, sf_dir, "pages").select("page_id", F.size(found).alias("images"), F.get(found, 0).alias("first"))


@query("status_changes", "SELECT before, event_type AS after, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type GROUP BY ALL")
def status_changes(spark, sf_dir):
    """Changes of a key's state in its history of checks."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read(spark, sf_dir, "events").select("event_type", F.lag("event_type").over(order).alias("before"))
    return rows.filter("before <> event_type").groupBy("before", F.col("event_type").alias("after")).agg(F.count("*").alias("n"))


@query("incremental_candidates", "WITH s AS (SELECT user_id, max(ts) AS seen FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id) SELECT event_id, user_id FROM events LEFT JOIN s USING (user_id) WHERE seen IS NULL OR ts >= seen - INTERVAL 48 HOURS")
def incremental_candidates(spark, sf_dir):
    """FLT-31: rows newer than what was last seen of their key, with 48 hours of slack; unseen keys whole."""
    rows = read(spark, sf_dir, "events")
    seen = rows.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).groupBy("user_id").agg(F.max("ts").alias("seen"))
    return rows.join(seen, "user_id", "left").filter("seen is null or ts >= seen - interval 48 hours").select("event_id", "user_id")


@query("cache_versions", "SELECT event_type AS key, count(*) + 1 AS version, max(ts) AS changed FROM events GROUP BY event_type")
def cache_versions(spark, sf_dir):
    """SNK-6: a counter of each key's invalidations, from their log."""
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg((F.count("*") + 1).alias("version"), F.max("ts").alias("changed"))
