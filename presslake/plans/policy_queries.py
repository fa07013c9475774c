"""Editorial policy and listings over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import policy as P
from presslake.operators import relations as R
from presslake.plans.catalog import query
from presslake.session import read

NOW = "2024-01-30 12:00:00"
#: Headlines that the test tables' rows take in turn.
TITLES = ("وزاره الصحه تعلن دعم المستشفيات في الرياض", "ولي العهد يستقبل الوفد الرسمي اليوم", "مصر تستضيف مباراه الفريق الاول", "about us", "سياسة الخصوصية", "Media Centre", "عاجل: زلزال قوي يضرب السواحل", "Breaking news - markets fall", "تابعونا على قناه الصحيفه الجديده", "مجرد خبر عادي من مكان بعيد")


def titled(column: str):
    """The headline of a row, by its number."""
    return F.element_at(F.array(*map(F.lit, TITLES)), (F.col(column) % len(TITLES) + 1).cast("int"))


TITLE_SQL = "[" + ", ".join(f"'{t}'" for t in TITLES) + "]"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "page_status",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 11 AS r, o_orderkey % 3 AS e, o_orderkey % 5 AS m FROM orders),
       c AS (SELECT k, CASE r WHEN 0 THEN 404 WHEN 1 THEN 410 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 403 WHEN 5 THEN 302 WHEN 6 THEN NULL ELSE 200 END AS code, r = 10 AS gone, e = 0 AS changed, m = 0 AS moved, k % 13 = 0 AS broken FROM o)
       SELECT k AS o_orderkey,
         CASE WHEN broken THEN 'Temporarily Unreachable' WHEN code IN (404, 410) THEN 'Removed' WHEN code = 429 OR code >= 500 THEN 'Temporarily Unreachable' WHEN code BETWEEN 400 AND 499 THEN 'Unavailable'
              WHEN code IS NULL THEN 'Temporarily Unreachable' WHEN gone THEN 'Removed' WHEN changed THEN 'Updated' WHEN moved THEN 'Redirected' ELSE 'Active' END AS status,
         CASE WHEN broken THEN 'temporary_network_error: timeout' WHEN code IN (404, 410) THEN 'source_confirmed_removed_http_' || code WHEN code = 429 OR code >= 500 THEN 'temporary_http_' || code WHEN code BETWEEN 400 AND 499 THEN 'source_access_unavailable_http_' || code
              WHEN code IS NULL THEN 'unexpected_http_none' WHEN gone THEN 'source_page_explicitly_reports_removal' WHEN changed THEN 'source_content_changed' WHEN moved THEN 'source_redirect_followed' ELSE 'source_article_available' END AS reason FROM c""",
)
def page_status(spark, sf_dir):
    """MA-8: observations of pages, one per order."""
    k = F.col("o_orderkey")
    codes = [404, 410, 429, 503, 403, 302, None, 200, 200, 200, 200]
    code = F.element_at(F.array(*[F.lit(c).cast("int") for c in codes]), (k % 11 + 1).cast("int"))
    html = F.when(k % 11 == 10, "<title>Page not found</title><h1>Sorry</h1>").otherwise("<title>News</title><h1>Head</h1>")
    status = P.page_status(code, html, F.lit("u"), F.when(k % 5 == 0, "v").otherwise("u"), F.when(k % 3 == 0, "b").otherwise("a"), F.lit("a"), F.lit(None).cast("string"), F.lit("x"), F.when(k % 13 == 0, "timeout"))
    return read(spark, sf_dir, "orders").select("o_orderkey", status.alias("s")).select("o_orderkey", "s.status", "s.reason")


@query(
    "geography",
    f"""WITH t AS (SELECT doc_id, {TITLE_SQL}[doc_id % 10 + 1] AS title, CASE WHEN doc_id % 4 = 0 THEN 'SA' ELSE 'FR' END AS country, CASE WHEN doc_id % 7 = 0 THEN 'north' ELSE '' END AS region FROM documents)
        SELECT doc_id, CASE WHEN contains(title, 'الرياض') THEN 'saudi_region' WHEN contains(title, 'ولي العهد') THEN 'saudi_national' WHEN contains(title, 'مصر') THEN 'gulf_arab' WHEN region <> '' THEN 'saudi_region' WHEN country = 'SA' THEN 'saudi_national' ELSE 'international' END AS relevance,
               CASE WHEN contains(title, 'الرياض') THEN 'الرياض' WHEN contains(title, 'ولي العهد') OR contains(title, 'مصر') THEN '' ELSE region END AS region FROM t""",
)
def geography(spark, sf_dir):
    """MA-5."""
    k = F.col("doc_id")
    place = P.geography(titled("doc_id"), F.lit(""), F.when(k % 4 == 0, "SA").otherwise("FR"), F.when(k % 7 == 0, "north").otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", place.alias("p")).select("doc_id", "p.relevance", "p.region")


WEIGHTS = {"recency": 30, "saudi": 20, "breaking": 25, "source": 10, "impact": 15, "official": 8, "corroboration": 6}


@query(
    "editorial_priority",
    f"""WITH t AS (SELECT event_id, event_id % 10 AS r, greatest(0, epoch_us(TIMESTAMP '{NOW}' - ts) / 3.6e9) AS age, value AS reliability, CAST(user_id % 25 AS DOUBLE) AS place, event_id % 17 = 0 AS breaking, event_id % 5 AS supporting FROM events),
        s AS (SELECT *, 30 * greatest(0.0, 1 - age / 48) + 20 * CASE r WHEN 0 THEN 0.9 WHEN 1 THEN 1.0 WHEN 2 THEN 0.45 ELSE 0.15 END + 25 * CAST(breaking AS INTEGER)
              + 10 * (0.75 * least(1.0, greatest(0.0, reliability / 100)) + 0.25 * greatest(0.0, 1 - (place - 1) / 20)) + 15 * CASE r WHEN 0 THEN 1.0 WHEN 6 THEN 1.0 ELSE 0.3 END + 8 * CAST(r = 0 AS INTEGER) + 6 * least(1.0, supporting / 3.0) + 2 AS total FROM t),
        p AS (SELECT event_id, breaking, CAST(greatest(0, least(100, floor(total + 0.5))) AS INTEGER) AS score FROM s)
        SELECT event_id, score, CASE WHEN breaking THEN 'عاجل' WHEN score >= 82 THEN 'أولوية قصوى' WHEN score >= 62 THEN 'مهم' WHEN score >= 28 THEN 'عادي' ELSE 'منخفض الأولوية' END AS level FROM p""",
)
def editorial_priority(spark, sf_dir):
    """MA-4 over events as articles of the headlines."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(moment(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3.6e9))
    k = F.col("event_id")
    # folded text and nearness are used by many terms: each is computed once
    plain = R.held(read(spark, sf_dir, "events"), title=C.normalized(titled("event_id")))
    plain = R.held(plain, near=P.place_of(F.col("title"), F.lit("FR"), F.lit(""))["relevance"])
    score = P.priority(F.col("title"), F.col("near"), age, F.col("value"), F.col("user_id") % 25, F.lit("a.org"), k % 17 == 0, k % 5, F.lit(2.0), WEIGHTS, 48)
    return plain.select("event_id", score.alias("p")).select("event_id", "p.score", "p.level")


@query(
    "text_predicates",
    f"""WITH t AS (SELECT page_id, page_id % 10 AS r, CASE page_id % 4 WHEN 0 THEN 'https://a.org/about-us/' WHEN 1 THEN 'https://a.org/2024/events?x=1' WHEN 2 THEN 'not a url' ELSE 'https://a.org/news/12' END AS url FROM pages)
        SELECT page_id, r IN (3, 4, 5) AS service_title, page_id % 4 <> 3 AS service_url, r = 8 AS boilerplate, r = 6 AS breaking,
               CASE WHEN r = 6 THEN 'زلزال قوي يضرب السواحل' WHEN r = 7 THEN 'markets fall' ELSE trim({TITLE_SQL}[r + 1]) END AS title FROM t""",
)
def text_predicates(spark, sf_dir):
    """FLT-14, FLT-15, FLT-22, TX-27."""
    title, k = titled("page_id"), F.col("page_id")
    url = F.when(k % 4 == 0, "https://a.org/about-us/").when(k % 4 == 1, "https://a.org/2024/events?x=1").when(k % 4 == 2, "not a url").otherwise("https://a.org/news/12")
    label = P.breaking_label(F.when(k % 10 == 6, "<b> عاجل </b>").otherwise("عادي"))
    return read(spark, sf_dir, "pages").select("page_id", P.non_news_title(title).alias("service_title"), P.non_news_url(url).alias("service_url"), P.source_boilerplate(title).alias("boilerplate"), label.alias("breaking"), P.breaking_title(title, F.lit(True)).alias("title"))


@query(
    "summary_cleaner",
    """SELECT doc_id, trim(regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'خبر اول' WHEN 1 THEN 'خبر تابعونا على ثان' ELSE 'تابعونا على خبر تابعونا على' END || ' ' || source, 'تابعونا على', '')) AS raw,
              trim(regexp_replace(regexp_replace(CASE doc_id % 3 WHEN 0 THEN 'خبر اول' WHEN 1 THEN 'خبر تابعونا على ثان' ELSE 'تابعونا على خبر تابعونا على' END || ' ' || source, 'تابعونا على', ''), '\\s+', ' ', 'g')) AS summary FROM documents""".replace("\\\\", "\\"),
)
def summary_cleaner(spark, sf_dir):
    """TX-12: the first such passage goes, later ones stay."""
    k = F.col("doc_id")
    text = F.concat_ws(" ", F.when(k % 3 == 0, "خبر اول").when(k % 3 == 1, "خبر تابعونا على ثان").otherwise("تابعونا على خبر تابعونا على"), F.col("source"))
    at = F.instr(text, "تابعونا على")
    raw = F.trim(F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 11, F.length(text)))).otherwise(text))
    return read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"), P.clean_summary(text).alias("summary"))


@query("window_membership", f"SELECT event_id, ts >= TIMESTAMP '2024-01-23 21:00:00' AND ts <= TIMESTAMP '{NOW}' AS current FROM events")
def window_membership(spark, sf_dir):
    """DT-2, DT-4: seven days of a zone three hours ahead, up to now."""
    window = P.active_window(moment(NOW).cast("timestamp"), "Asia/Riyadh")
    return read(spark, sf_dir, "events").select("event_id", P.in_window(F.col("ts").cast("timestamp"), window).alias("current"))


@query("search_columns", """SELECT page_id FROM pages WHERE url LIKE '%50!%%' ESCAPE '!' OR lower(url) LIKE '%!_%' ESCAPE '!' OR lower(html) LIKE '%ref=x%' OR contains(CAST(page_id AS VARCHAR), '77')""")
def search_columns(spark, sf_dir):
    """FLT-3: a literal, whatever signs it has, in any of several columns."""
    found = F.lit(False)
    for column, text in (("url", "50%"), ("url", "_"), ("html", "ref=x"), ("page_id", "77")):
        found = found | F.lower(F.col(column).cast("string")).contains(text)
    return read(spark, sf_dir, "pages").filter(found).select("page_id")


@query("optional_predicates", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def optional_predicates(spark, sf_dir):
    """FLT-2, FLT-5: clauses that a request gives, and no others."""
    asked = {"status": "O", "least": 100000, "most": None, "priorities": ["1-URGENT", "2-HIGH"]}
    clauses = {"status": lambda v: F.col("o_orderstatus") == v, "least": lambda v: F.col("o_totalprice") >= v, "most": lambda v: F.col("o_totalprice") <= v, "priorities": lambda v: F.col("o_orderpriority").isin(*v)}
    out = read(spark, sf_dir, "orders")
    for name, value in asked.items():
        if value is not None:
            out = out.filter(clauses[name](value))
    return out.select("o_orderkey")


@query("tag_members", "SELECT doc_id FROM documents WHERE list_contains(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')), 'that') OR contains(lower(source), 'that')")
def tag_members(spark, sf_dir):
    """FLT-4, JN-8: a tag, with or without its sign, among a row's tags, or in its name."""
    tag = "#that".lstrip("#＃").lower()
    tags = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    return read(spark, sf_dir, "documents").filter(F.array_contains(tags, tag) | F.lower("source").contains(tag)).select("doc_id")


@query(
    "archive_periods",
    """SELECT p.period, count(o_orderkey) AS n FROM (VALUES ('year', TIMESTAMP '1995-01-01', TIMESTAMP '1996-01-01'), ('month', TIMESTAMP '1995-12-01', TIMESTAMP '1996-01-01'), ('day', TIMESTAMP '1995-12-31', TIMESTAMP '1996-01-01'), ('week', TIMESTAMP '1995-01-02', TIMESTAMP '1995-01-09')) p(period, a, b)
       LEFT JOIN orders ON o_orderdate >= a AND o_orderdate < b GROUP BY p.period""",
)
def archive_periods(spark, sf_dir):
    """FLT-9: half-open ranges of a year, a month, a day and an ISO week; a row counts in each by one pass."""
    week_one = F.date_trunc("week", F.make_date(F.lit(1995), F.lit(1), F.lit(4))).cast("timestamp_ntz")
    starts = {"year": (moment("1995-01-01"), "interval 1 year"), "month": (moment("1995-12-01"), "interval 1 month"), "day": (moment("1995-12-31"), "interval 1 day"), "week": (week_one, "interval 7 days")}
    at = F.col("o_orderdate")
    counts = read(spark, sf_dir, "orders").agg(*(F.count_if((at >= start) & (at < start + F.expr(width))).alias(name) for name, (start, width) in starts.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, starts)), F.array(*map(F.col, starts)))).alias("period", "n"))


@query("sorted_by_fallbacks", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY coalesce(nullif(o_orderpriority, '5-LOW'), '0') ASC, o_orderdate DESC, o_orderkey LIMIT 40")
def sorted_by_fallbacks(spark, sf_dir):
    """SO-2."""
    keys = F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("0")).asc(), F.col("o_orderdate").desc(), F.col("o_orderkey")
    return read(spark, sf_dir, "orders").orderBy(*keys).limit(40).select("o_orderkey", "o_orderpriority")


@query("most_engaged", "SELECT l_partkey, CAST(sum(l_quantity) + count(*) * 3 AS BIGINT) AS engaged FROM lineitem GROUP BY l_partkey ORDER BY engaged DESC, l_partkey LIMIT 24")
def most_engaged(spark, sf_dir):
    """SO-3, SO-4, SO-10: a chosen sort key, here views + 3 * shares, and a limit held between 1 and 24."""
    sums = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("views"), F.count("*").alias("shares"))
    sorts = {"views": F.col("views"), "shares": F.col("shares"), "engaged": F.col("views") + F.col("shares") * 3}
    chosen = sums.withColumn("engaged", sorts["engaged"].cast("long"))
    return chosen.orderBy(F.col("engaged").desc(), "l_partkey").limit(max(1, min(24, 100))).select("l_partkey", "engaged")


@query("look_ahead", "SELECT event_id, (SELECT count(*) FROM events) > 30 AS has_more FROM events ORDER BY ts DESC, event_id DESC LIMIT 30")
def look_ahead(spark, sf_dir):
    """SO-7: one row more than asked for tells whether there are more."""
    rows = read(spark, sf_dir, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(31)
    numbered = rows.withColumn("i", F.row_number().over(Window.orderBy(F.col("ts").desc(), F.col("event_id").desc())))  # 31 rows
    return numbered.select("event_id", (F.count("*").over(Window.partitionBy()) > 30).alias("has_more"), "i").filter("i <= 30").drop("i")


@query("page_totals", "SELECT o_orderstatus, count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM orders GROUP BY o_orderstatus")
def page_totals(spark, sf_dir):
    """AG-1, SO-1: totals and numbers of pages."""
    counts = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("total"))
    return counts.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / 20)).cast("long"))


@query("rolling_counts_latest", "SELECT event_type, CAST(ts AS DATE)::VARCHAR AS day, count(*) AS n, max(ts) AS latest FROM events GROUP BY ALL")
def rolling_counts_latest(spark, sf_dir):
    """AG-3: counts and latest times by two keys."""
    return read(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("term_top", "SELECT term, n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents) GROUP BY term ORDER BY count(*) DESC, term LIMIT 12".replace("SELECT term, n", "SELECT term, count(*) AS n"))
def term_top(spark, sf_dir):
    """AG-25: the twelve commonest terms; a top-k report."""
    terms = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(12)


@query(
    "three_way_checks",
    "SELECT l_orderkey, l_linenumber, o_orderstatus, s_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0 WHERE l_returnflag = 'R'",
)
def three_way_checks(spark, sf_dir):
    """JN-2, JN-3, JN-4: checks with their article and, where it is known, their source."""
    sources = read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    checks = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_suppkey")
    return checks.join(orders, "l_orderkey").join(sources, "l_suppkey", "left").select("l_orderkey", "l_linenumber", "o_orderstatus", "s_name")


@query(
    "category_supply",
    """WITH s AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS category FROM part), c AS (SELECT DISTINCT category FROM s)
       SELECT c.category, count(DISTINCT p_partkey) AS sources, count(DISTINCT p_partkey) < 50 AS short FROM c LEFT JOIN s USING (category) GROUP BY c.category""",
)
def category_supply(spark, sf_dir):
    """JN-14, JN-19, AG-24: categories that a source names in a list, and those with too few sources."""
    each = read(spark, sf_dir, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_type", " "))).alias("category"))
    return each.groupBy("category").agg(F.count("*").alias("sources")).withColumn("short", F.col("sources") < 50)


@query(
    "share_gate",
    """WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS total FROM c)
       SELECT source, lang, n, (total >= 8 AND n >= 0.35 * total) OR (total >= 4 AND n >= 0.5 * total) AS reserve FROM t""",
)
def share_gate(spark, sf_dir):
    """AG-26: sources whose share of a category is too large are held in reserve."""
    counts = read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    reserve = ((total >= 8) & (F.col("n") >= 0.35 * total)) | ((total >= 4) & (F.col("n") >= 0.5 * total))
    return counts.select("source", "lang", "n", reserve.alias("reserve"))


@query("insert_or_ignore", "SELECT p_partkey, 'old' AS origin FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_size > 20 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def insert_or_ignore(spark, sf_dir):
    """SNK-7: new keys are appended, known ones stay."""
    part = read(spark, sf_dir, "part")
    old, new = part.filter("p_size <= 25").select("p_partkey", F.lit("old").alias("origin")), part.filter("p_size > 20").select("p_partkey", F.lit("new").alias("origin"))
    return old.unionByName(new.join(old, "p_partkey", "left_anti"))


@query("update_by_sources", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) THEN 'review' ELSE o_orderstatus END AS status FROM orders")
def update_by_sources(spark, sf_dir):
    """SNK-9, JN-7: rows of some sources take another status."""
    some = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("review").alias("other"))
    return read(spark, sf_dir, "orders").join(some, "o_custkey", "left").select("o_orderkey", F.coalesce("other", "o_orderstatus").alias("status"))


@query("expired_rows", "SELECT event_id FROM events WHERE NOT (event_type = 'error' OR ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 20 DAY)")
def expired_rows(spark, sf_dir):
    """SNK-13: what is left after deletes by key and by age."""
    gone = (F.col("event_type") == "error") | (F.col("ts") < moment(NOW) - F.expr("interval 20 days"))
    return read(spark, sf_dir, "events").filter(~gone).select("event_id")


@query(
    "pinned_topk",
    """SELECT o_orderkey, o_orderpriority FROM (SELECT *, o_orderkey % 1000 = 7 AS pinned, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey % 1000 = 7 DESC, o_totalprice DESC, o_orderkey) AS place FROM orders)
       ORDER BY (pinned OR place <= 2) DESC, pinned DESC, o_totalprice DESC, o_orderkey LIMIT 20""",
)
def pinned_topk(spark, sf_dir):
    """WN-3: no cap holds pinned rows back."""
    orders = read(spark, sf_dir, "orders")
    return R.balanced_top(orders, "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 20, 2, F.col("o_orderkey") % 1000 == 7).select("o_orderkey", "o_orderpriority")
