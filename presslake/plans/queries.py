"""The library's operators over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.operators import relations as R
from presslake.plans.catalog import query
from presslake.session import read

NOW = datetime(2024, 1, 30, 12)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


@query("list_page", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 20")
def list_page(spark, sf_dir):
    open_ = read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return R.page(open_, [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 2, 20).select("o_orderkey", "o_orderpriority")


@query("keyset_page", "SELECT event_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-15' OR (ts = TIMESTAMP '2024-01-15' AND event_id < 100) ORDER BY ts DESC, event_id DESC LIMIT 25")
def keyset_page(spark, sf_dir):
    return R.after_cursor(events(spark, sf_dir), "ts", "event_id", (datetime(2024, 1, 15), 100), 25).select("event_id", "event_type")


@query("search_like", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'src1')")
def search_like(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.filter(F.lower("text").contains("license") | F.lower("source").contains("src1")).select("doc_id", "source")


@query(
    "period_ladder",
    """WITH c AS (SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (ts >= TIMESTAMP '2024-01-23 12:00:00') AS week, count(*) FILTER (ts >= TIMESTAMP '2023-12-31 12:00:00') AS month
         FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY event_type)
       SELECT event_type, today, week, month, CASE WHEN today >= 3 THEN '48h' WHEN week >= 3 THEN '7d' WHEN month > 0 THEN '30d' ELSE 'all' END AS period FROM c""",
)
def period_ladder(spark, sf_dir):
    """FLT-8: one conditional aggregate decides how far back each category looks."""
    counts = events(spark, sf_dir).filter(F.col("ts") < F.lit(NOW)).groupBy("event_type").agg(F.count_if(F.col("ts") >= F.lit(datetime(2024, 1, 30))).alias("today"), F.count_if(F.col("ts") >= F.lit(NOW - timedelta(days=7))).alias("week"), F.count_if(F.col("ts") >= F.lit(NOW - timedelta(days=30))).alias("month"))
    return counts.withColumn("period", F.when(F.col("today") >= 3, "48h").when(F.col("week") >= 3, "7d").when(F.col("month") > 0, "30d").otherwise("all"))


@query("archive_week", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' GROUP BY event_type")
def archive_week(spark, sf_dir):
    """FLT-9: ISO week 3 of 2024 as a half-open range."""
    start = F.date_add(F.date_trunc("week", F.make_date(F.lit(2024), F.lit(1), F.lit(4))).cast("date"), 14)
    return events(spark, sf_dir).filter((F.col("ts") >= start) & (F.col("ts") < F.date_add(start, 7))).groupBy("event_type").agg(F.count("*").alias("n"))


@query("archive_facets", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, count(*) AS n FROM orders GROUP BY ALL")
def archive_facets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.day("o_orderdate").alias("d")).agg(F.count("*").alias("n"))


@query("category_counts", "SELECT o_orderpriority, count(*) AS n, max(o_orderkey) AS newest FROM orders GROUP BY o_orderpriority")
def category_counts(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("newest"))


@query("tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS tag FROM documents) GROUP BY tag HAVING count(*) >= 3")
def tag_counts(spark, sf_dir):
    tags = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    return read(spark, sf_dir, "documents").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).filter("n >= 3")


@query(
    "related_by_overlap",
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS tag FROM documents)
       SELECT a.doc_id, count(*) AS overlap FROM t a JOIN t b ON a.tag = b.tag AND b.doc_id = 1 AND a.doc_id <> 1 GROUP BY a.doc_id""",
)
def related_by_overlap(spark, sf_dir):
    """JN-10: words repeat, and every pair of equal ones counts; the target isn't related to itself."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)).alias("tags"))
    return R.overlap_counts(docs, "doc_id", "tags", docs.filter("doc_id = 1"))


@query("supporting_counts", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def supporting_counts(spark, sf_dir):
    """JN-6: the correlated count as a pre-aggregate and a left join."""
    counts = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("semi_active", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def semi_active(spark, sf_dir):
    open_ = read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(open_, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("anti_seen", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')")
def anti_seen(spark, sf_dir):
    seen = read(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("latest_join", "SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def latest_join(spark, sf_dir):
    """JN-5: every key with its latest row."""
    latest = R.newest(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    return read(spark, sf_dir, "customer").select("c_custkey").join(latest, "c_custkey", "left")


@query(
    "dup_exact_keys",
    """WITH a AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS by_text, min(doc_id) OVER (PARTITION BY source, n_chars) AS by_size FROM documents)
       SELECT doc_id, CASE WHEN by_text < doc_id THEN 'text' ELSE 'size' END AS tier, CASE WHEN by_text < doc_id THEN by_text ELSE by_size END AS original FROM a WHERE by_text < doc_id OR by_size < doc_id""",
)
def dup_exact_keys(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("digest"))
    return R.exact_duplicates(docs, "doc_id", {"text": ["digest"], "size": ["source", "n_chars"]})


@query(
    "dup_interval",
    """SELECT a.user_id, a.event_type, a.event_id AS earlier, b.event_id AS later FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type
       AND (a.ts < b.ts OR (a.ts = b.ts AND a.event_id < b.event_id)) AND b.ts - a.ts <= INTERVAL 1 HOUR""",
)
def dup_interval(spark, sf_dir):
    return R.interval_pairs(events(spark, sf_dir), "event_id", "ts", ["user_id", "event_type"], timedelta(hours=1))


@query("rolling_days", "SELECT CAST(CAST(ts + INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' AND CAST(ts + INTERVAL 3 HOUR AS DATE) > DATE '2024-01-23' GROUP BY ALL")
def rolling_days(spark, sf_dir):
    rows = R.rolling_days(events(spark, sf_dir), "ts", "Asia/Riyadh", NOW)
    return rows.groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query(
    "coverage_grid",
    """WITH g AS (SELECT event_type, CAST(d AS DATE) AS day FROM (SELECT DISTINCT event_type FROM events), (SELECT unnest(generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-03', INTERVAL 1 DAY)) AS d))
       SELECT g.event_type, CAST(g.day AS VARCHAR) AS day, count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND CAST(e.ts AS DATE) = g.day GROUP BY ALL""",
)
def coverage_grid(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return R.dense_grid(rows, "event_type", "day", "2024-01-25", 10).withColumn("day", F.col("day").cast("string"))


@query("dashboard_kpis", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS open_n, count(*) FILTER (o_orderstatus = 'F') AS done_n, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_totalprice > 100000) AS large, count(DISTINCT o_custkey) AS sources FROM orders")
def dashboard_kpis(spark, sf_dir):
    """AG-7: all counts in one pass."""
    return read(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open_n"), F.count_if(F.col("o_orderstatus") == "F").alias("done_n"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.countDistinct("o_custkey").alias("sources"))


@query("inventory", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def inventory(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("freshness", "SELECT event_type, max(ts) < TIMESTAMP '2024-01-30 00:00:00' AS needs_recovery, count(*) FILTER (ts >= TIMESTAMP '2024-01-28 12:00:00') AS recent FROM events WHERE ts <= TIMESTAMP '2024-01-30 12:00:00' GROUP BY event_type")
def freshness(spark, sf_dir):
    rows = events(spark, sf_dir).filter(F.col("ts") <= F.lit(NOW))
    return rows.groupBy("event_type").agg((F.max("ts") < F.lit(NOW - timedelta(hours=12))).alias("needs_recovery"), F.count_if(F.col("ts") >= F.lit(NOW - timedelta(hours=48))).alias("recent"))


@query("dominance", "SELECT source, count(*) AS n, floor(count(*) * 1000.0 / (SELECT count(*) FROM documents) + 0.5) AS per_mille FROM documents GROUP BY source")
def dominance(spark, sf_dir):
    """WN-6: each source's share of the total; the total is a one-row aggregate of the counts."""
    counts = read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    all_ = counts.agg(F.sum("n").alias("all_n"))
    return counts.join(F.broadcast(all_)).select("source", "n", C.half_up(F.col("n") * 1000.0 / F.col("all_n")).cast("double").alias("per_mille"))


@query("balanced_topk", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) ORDER BY place <= 3 DESC, o_totalprice DESC, o_orderkey LIMIT 20")
def balanced_topk(spark, sf_dir):
    return R.balanced_top(read(spark, sf_dir, "orders"), "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 3).select("o_orderkey", "o_orderpriority")


@query("newest_n", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS place FROM documents) WHERE place <= 5")
def newest_n(spark, sf_dir):
    return R.newest(read(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], [F.col("doc_id").desc()], 5)


@query(
    "trend_topics",
    """SELECT user_id AS topic, count(*) AS mentions, CAST(sum(CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) AS BIGINT) AS engagement, min(event_id) AS first_event, count(DISTINCT event_type) AS platforms
       FROM events WHERE ts >= TIMESTAMP '2024-01-28 12:00:00' AND ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY user_id""",
)
def trend_topics(spark, sf_dir):
    """AG-15: topics of the last 48 hours with their counters."""
    recent = events(spark, sf_dir).filter((F.col("ts") >= F.lit(NOW - timedelta(hours=48))) & (F.col("ts") < F.lit(NOW)))
    weight = F.when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "click", 1).otherwise(0)
    return recent.groupBy(F.col("user_id").alias("topic")).agg(F.count("*").alias("mentions"), F.sum(weight).alias("engagement"), F.min("event_id").alias("first_event"), F.countDistinct("event_type").alias("platforms"))


@query(
    "trend_score",
    """WITH t AS (SELECT event_type, count(*) AS c, CAST(count(*) FILTER (value > 50) AS DOUBLE) AS x, greatest(0.1, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(min(ts))) / 3.6e9) AS age FROM events WHERE ts < TIMESTAMP '2024-01-30 12:00:00' GROUP BY event_type),
       v AS (SELECT *, floor(c / greatest(1.0, age) * 10 + 0.5) / 10 AS velocity FROM t)
       SELECT event_type, c AS mentions, velocity, floor((25 * ln(1 + c) + 15 * ln(1 + x) + 12 * ln(1 + c) + 20 * velocity) / pow(age + 1.5, 1.6) * 0.9 * 10 + 0.5) / 10 AS score FROM v""",
)
def trend_score(spark, sf_dir):
    rows = events(spark, sf_dir).filter(F.col("ts") < F.lit(NOW)).groupBy("event_type").agg(F.count("*").alias("mentions"), F.count_if(F.col("value") > 50).cast("double").alias("x"), F.min("ts").cast("timestamp").alias("first"))
    aged = rows.withColumn("age", C.age_hours(F.col("first"), F.lit(NOW).cast("timestamp"), 0.1))
    moving = aged.withColumn("velocity", C.half_up(F.col("mentions") / F.greatest(F.lit(1.0), F.col("age")), 1))
    return moving.select("event_type", "mentions", "velocity", C.trend_score(F.col("mentions"), F.col("x"), F.col("mentions"), F.col("velocity"), F.col("age"), F.lit(0.9)).alias("score"))


@query("engagement", "SELECT user_id, CAST(floor(sum(CASE event_type WHEN 'purchase' THEN 2.0 WHEN 'click' THEN 0.5 WHEN 'signup' THEN 1.0 WHEN 'view' THEN 0.05 ELSE 0.0 END::DOUBLE) + 0.5) AS BIGINT) AS engagement FROM events GROUP BY user_id")
def engagement(spark, sf_dir):
    kind = F.col("event_type")
    weight = F.when(kind == "purchase", 2.0).when(kind == "click", 0.5).when(kind == "signup", 1.0).when(kind == "view", 0.05).otherwise(0.0)
    # 0.05 is no binary fraction: where a user's sum ends in a half, the order of the additions says how it is rounded. They
    # go by event, so that no partitioning changes them; weights aren't negative, so that the last running sum is the largest
    so_far = F.sum("weight").over(Window.partitionBy("user_id").orderBy("event_id", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    weighed = events(spark, sf_dir).select("user_id", "event_id", weight.alias("weight"))
    return weighed.select("user_id", so_far.alias("total")).groupBy("user_id").agg(C.half_up(F.max("total")).alias("engagement"))


@query(
    "classify_rules",
    """WITH r AS (SELECT * FROM (VALUES ('law', 'license', 9), ('law', 'rights', 4), ('code', 'token', 6), ('code', 'password', 6), ('insult', 'idiot', 9), ('insult', 'stupid', 9)) AS t(category, term, weight)),
       h AS (SELECT doc_id, category, sum(weight) AS score FROM (SELECT doc_id, lower(text) AS text FROM documents) d JOIN r ON contains(d.text, r.term) GROUP BY ALL)
       SELECT doc_id, category, CAST(score AS BIGINT) AS score FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) = 1""",
)
def classify_rules(spark, sf_dir):
    """MA-6: weighted terms per category, the best category per document; terms are one array, no join."""
    rules = {"law": {"license": 9, "rights": 4}, "code": {"token": 6, "password": 6}, "insult": {"idiot": 9, "stupid": 9}}
    text = F.lower("text")
    scores = F.array(*[F.struct(F.lit(c).alias("category"), sum((F.when(text.contains(t), w).otherwise(0) for t, w in terms.items()), F.lit(0)).cast("long").alias("score")) for c, terms in rules.items()])
    each = read(spark, sf_dir, "documents").select("doc_id", F.inline(scores)).filter("score > 0")
    return R.newest(each, ["doc_id"], [F.col("score").desc(), F.col("category")]).select("doc_id", "category", "score")


@query("lang_script", "SELECT doc_id, length(regexp_replace(text, '[^a-z]', '', 'g')) >= 6 AND length(regexp_replace(text, '[^a-z]', '', 'g')) >= length(regexp_replace(text, '[^0-9]', '', 'g')) AS latin FROM documents")
def lang_script(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.script_majority(F.col("text"), "[a-z]", "[0-9]").alias("latin"))


@query("content_hash", "SELECT doc_id, sha256(concat_ws('|', source, lang, text)) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", "source", "lang", "text"), 256).alias("digest"))


@query("token_similarity", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) SELECT a.item_id AS left_id, b.item_id AS right_id, floor(len(list_intersect(a.w, b.w)) * 1000.0 / greatest(len(a.w), len(b.w)) + 0.5)::BIGINT AS per_mille FROM t a JOIN t b ON b.item_id = a.item_id + 1")
def token_similarity(spark, sf_dir):
    words = read(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    after = words.select((F.col("item_id") - 1).alias("left_id"), F.col("item_id").alias("right_id"), F.col("w").alias("v"))
    pairs = words.withColumnRenamed("item_id", "left_id").join(after, "left_id")
    return pairs.select("left_id", "right_id", C.half_up(C.token_similarity(F.col("w"), F.col("v")) * 1000).alias("per_mille"))


@query(
    "url_canonical",
    r"""WITH u AS (SELECT page_id, trim(url) || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '?xfbclid=1&my_utm_source=b&fbclid&k=2' WHEN 2 THEN '//a//b/?utm_x=1#frag' WHEN 3 THEN '?gclid=7&a=1' ELSE '' END AS given FROM pages),
       v AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://A.org/' WHEN 1 THEN ' nota url ' ELSE given END AS given FROM u),
       w AS (SELECT page_id, trim(given) AS given, split_part(trim(given), '#', 1) AS bare FROM v),
       x AS (SELECT *, split_part(bare, '?', 1) AS front, list_filter(string_split(array_to_string(string_split(bare, '?')[2:], '?'), '&'),
             lambda p: p <> '' AND NOT lower(split_part(p, '=', 1)) IN ('fbclid', 'gclid') AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT starts_with(lower(split_part(p, '=', 1)), 'mc_')) AS kept FROM w),
       y AS (SELECT *, split_part(front, '://', 1) AS scheme, array_to_string(string_split(front, '://')[2:], '://') AS rest FROM x),
       z AS (SELECT *, split_part(rest, '/', 1) AS host, rtrim(regexp_replace(rest[length(split_part(rest, '/', 1)) + 1:], '/+', '/', 'g'), '/') AS path FROM y)
       SELECT page_id, CASE WHEN rest = '' THEN given ELSE lower(scheme) || '://' || lower(host) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url FROM z""",
)
def url_canonical(spark, sf_dir):
    """TX-36 over the pages' URLs with parameters and odd forms added."""
    page = F.col("page_id")
    added = F.when(page % 5 == 1, "?xfbclid=1&my_utm_source=b&fbclid&k=2").when(page % 5 == 2, "//a//b/?utm_x=1#frag").when(page % 5 == 3, "?gclid=7&a=1").otherwise("")
    given = F.when(page % 7 == 0, "https://A.org/").when(page % 7 == 1, " nota url ").otherwise(F.concat(F.trim("url"), added))
    return read(spark, sf_dir, "pages").select("page_id", C.canonical_url(given).alias("url"))


@query("html_title", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", C.html_tag(F.col("html"), "title").alias("title"))


@query("html_links", """SELECT link, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) GROUP BY link""")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select(F.explode(links).alias("link")).groupBy("link").agg(F.count("*").alias("n"))


@query("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS bucket, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return events(spark, sf_dir).groupBy("event_type", (k % 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("upsert_posts", "SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(event_type, event_id) AS last_type, count(*) AS versions FROM events GROUP BY user_id")
def upsert_posts(spark, sf_dir):
    """SNK-2/3: sticky and overwritten columns of two batches of the same keys."""
    rows = events(spark, sf_dir).select("user_id", F.col("event_type").alias("first_type"), F.col("event_type").alias("last_type"), "event_id")
    merged = R.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id"], "event_id", ["first_type"], ["last_type"])
    return merged.join(rows.groupBy("user_id").agg(F.count("*").alias("versions")), "user_id")


@query("status_case", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice < 50000 THEN 'review' WHEN o_orderstatus = 'F' THEN 'archived' ELSE 'published' END AS status FROM orders")
def status_case(spark, sf_dir):
    status = F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000), "review").when(F.col("o_orderstatus") == "F", "archived").otherwise("published")
    return read(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@query("thread_turns", "SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS first_role, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY conv_id")
def thread_turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by("role", "turn").alias("first_role"), F.max(F.length("text")).cast("long").alias("longest"))


@query("daily_brief", "SELECT o_orderpriority AS category, o_orderkey AS story, n FROM (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place = 1")
def daily_brief(spark, sf_dir):
    """AG-20: counts and the first story of each category, in one grouped pass."""
    open_ = read(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    return open_.groupBy(F.col("o_orderpriority").alias("category")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("story"), F.count("*").alias("n"))
