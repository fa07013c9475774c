"""Lists, states and monitoring of stories over the driver's tables (an event is a story), each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from presslake.operators import duplicates as D
from presslake.operators import monitoring as M
from presslake.operators import relations as R
from presslake.operators import stories as S
from presslake.plans.catalog import query
from presslake.session import read
from presslake.streaming import expiry

NOW = "2024-01-30 12:00:00"
START = "2024-01-24 00:00:00"


def moment(text: str):
    return F.lit(text).cast("timestamp_ntz")


def stories(spark, sf_dir):
    return read(spark, sf_dir, "events")


TITLE = "concat(p_name, ' ', p_brand)"
TIMES = "TIMESTAMP '2024-01-01' + INTERVAL (p_partkey % 700) HOUR"


@query(
    "near_titles",
    f"""WITH t AS (SELECT p_partkey AS k, p_brand AS c, {TIMES} AS at, list_distinct(list_filter(string_split(trim(regexp_replace(lower({TITLE}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS words FROM part),
        j AS (SELECT a.k, b.k AS original, b.at AS before, len(list_intersect(a.words, b.words)) * 100.0 / greatest(len(a.words), len(b.words)) AS s, row_number() OVER (PARTITION BY a.k ORDER BY b.at DESC, b.k DESC) AS place
              FROM t a JOIN t b ON a.c = b.c AND (b.at < a.at OR b.at = a.at AND b.k < a.k) AND a.at - b.at <= INTERVAL 36 HOUR),
        s AS (SELECT k, original, before, CAST(floor(s + 0.5) AS INTEGER) AS score FROM j WHERE place <= 80)
        SELECT k AS p_partkey, original, score FROM s WHERE score >= 60 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, before DESC, original DESC) = 1""",
)
def near_titles(spark, sf_dir):
    """JN-12 with its title score: parts as stories of their brand; 60 percent, as their names are short."""
    at = moment("2024-01-01") + F.make_dt_interval(hours=(F.col("p_partkey") % 700).cast("int"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.concat_ws(" ", "p_name", "p_brand").alias("title"), at.alias("at"))
    return D.near_titles(parts, "p_partkey", "at", "p_brand", "title", timedelta(hours=36), least=60)


@query(
    "tiered_duplicates",
    f"""WITH t AS (SELECT p_partkey AS k, p_name, p_brand AS c, {TIMES} AS at, list_distinct(list_filter(string_split(trim(regexp_replace(lower({TITLE}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')) AS words FROM part),
        e AS (SELECT k, min(k) OVER (PARTITION BY p_name, c) AS original FROM t), x AS (SELECT k, 'name' AS tier, original FROM e WHERE original < k),
        j AS (SELECT a.k, b.k AS original, b.at AS before, CAST(floor(len(list_intersect(a.words, b.words)) * 100.0 / greatest(len(a.words), len(b.words)) + 0.5) AS INTEGER) AS score, row_number() OVER (PARTITION BY a.k ORDER BY b.at DESC, b.k DESC) AS place
              FROM t a JOIN t b ON a.c = b.c AND (b.at < a.at OR b.at = a.at AND b.k < a.k) AND a.at - b.at <= INTERVAL 36 HOUR),
        n AS (SELECT k, 'title' AS tier, original FROM j WHERE place <= 80 AND score >= 60 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, before DESC, original DESC) = 1)
        SELECT k AS p_partkey, tier, original FROM x UNION ALL SELECT k, tier, original FROM n WHERE k NOT IN (SELECT k FROM x)""",
)
def tiered_duplicates(spark, sf_dir):
    """STR-4: exact keys first, then titles."""
    exact = R.exact_duplicates(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey", {"name": ["p_name", "p_brand"]})
    return S.tiered_duplicates(exact, near_titles(spark, sf_dir), "p_partkey")


_WORDS = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(
    "first_writers",
    f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_brand AS c, {TIMES} AS at, p_name AS name, p_type || p_size AS event, {_WORDS.format(TITLE)} AS words, row_number() OVER (PARTITION BY p_brand ORDER BY {TIMES}, p_partkey) AS n FROM part),
        s AS (SELECT c, 0 AS n, CAST(NULL AS BIGINT) AS k, CAST([] AS STRUCT(seen TIMESTAMP, k BIGINT, name VARCHAR, event VARCHAR, words VARCHAR[])[]) AS kept, CAST(NULL AS STRUCT(tier INTEGER, score INTEGER, seen TIMESTAMP, k BIGINT)) AS hit FROM (SELECT DISTINCT p_brand AS c FROM part)
              UNION ALL
              SELECT c, n, k, CASE WHEN hit IS NULL THEN list_append(kept, own) ELSE kept END, hit FROM (
                SELECT t.c, t.n, t.k, s.kept, {{'seen': t.at, 'k': t.k, 'name': t.name, 'event': t.event, 'words': t.words}} AS own,
                       list_max(list_concat(
                         list_transform(list_filter(s.kept, lambda x: x.name = t.name AND t.at - x.seen <= INTERVAL 36 HOUR), lambda x: {{'tier': 2, 'score': 100, 'seen': x.seen, 'k': x.k}}),
                         list_transform(list_filter(s.kept, lambda x: x.event = t.event AND t.at - x.seen <= INTERVAL 36 HOUR), lambda x: {{'tier': 1, 'score': 90, 'seen': x.seen, 'k': x.k}}),
                         list_filter(list_transform(list_filter(s.kept[-80:], lambda x: t.at - x.seen <= INTERVAL 36 HOUR), lambda x: {{'tier': 0, 'score': CAST(floor(len(list_intersect(x.words, t.words)) * 100.0 / greatest(len(x.words), len(t.words)) + 0.5) AS INTEGER), 'seen': x.seen, 'k': x.k}}), lambda h: h.score >= 60))) AS hit
                FROM s JOIN t ON t.c = s.c AND t.n = s.n + 1))
        SELECT k AS p_partkey, ['title_similarity', 'event_similarity', 'normalized_title'][hit.tier + 1] AS tier, hit.k AS original, hit.score AS score FROM s WHERE n > 0""",
)
def first_writers(spark, sf_dir):
    """STR-4 as a fold in order: a story is a duplicate of one that stays by its name, its type and size, or 60 percent of its title's words."""
    at = moment("2024-01-01") + F.make_dt_interval(hours=(F.col("p_partkey") % 700).cast("int"))
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_size", F.concat_ws(" ", "p_name", "p_brand").alias("title"), at.alias("at"))
    return D.first_writers(parts, "p_partkey", "at", "p_brand", "title", {"normalized_title": F.col("p_name"), "event_similarity": F.concat("p_type", "p_size")}, least=60)


@query(
    "page_monitor",
    """WITH c AS (SELECT event_id, user_id, ts, ['Active', 'Updated', 'Removed', 'Unavailable', 'Redirected', 'Temporarily Unreachable'][CAST(event_id % 6 AS INTEGER) + 1] AS status, value >= 50 AS ok, ['published', 'review', 'draft'][CAST(user_id % 3 AS INTEGER) + 1] AS first FROM events),
       n AS (SELECT *, row_number() OVER w AS attempts, max(CASE WHEN status = 'Removed' THEN ts END) OVER w AS gone_at,
                    coalesce(max(CASE WHEN status NOT IN ('Unavailable', 'Temporarily Unreachable') THEN place END) OVER w, 0) AS answered, coalesce(max(CASE WHEN status = 'Removed' THEN place END) OVER w, 0) AS gone, min(CASE WHEN status = 'Removed' THEN place END) OVER w AS gone_first,
                    coalesce(max(CASE WHEN status IN ('Active', 'Updated', 'Redirected') AND ok THEN place END) OVER w, 0) AS seen
             FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM c) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
       b AS (SELECT *, coalesce(lag(gone) OVER w, 0) > coalesce(lag(seen) OVER w, 0) AS was_away FROM n WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
       SELECT event_id, user_id, status, attempts, attempts - answered AS failures, CASE WHEN gone > seen THEN 'review' WHEN first = 'published' OR gone_first IS NULL THEN first ELSE 'review' END AS publication,
              CASE WHEN gone > seen THEN CASE WHEN first = 'published' OR seen < gone_first THEN first ELSE 'review' END END AS previous, epoch_us(CASE WHEN gone > seen THEN gone_at END) AS removed_at,
              status = 'Removed' AND NOT was_away AND first = 'published' AS hidden, status IN ('Active', 'Updated', 'Redirected') AND ok AND was_away AND first = 'published' AS restored FROM b""",
)
def page_monitor(spark, sf_dir):
    """STR-11: events as checks of a user's page; a low value is a page that couldn't be read again."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    checks = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", pick(["Active", "Updated", "Removed", "Unavailable", "Redirected", "Temporarily Unreachable"], F.col("event_id") % 6).alias("status"))
    states = M.page_states(checks, "user_id", "ts", "event_id", "status", pick(["published", "review", "draft"], F.col("user_id") % 3), F.col("value") >= 50)
    return states.select("event_id", "user_id", "status", *M.STATE).withColumn("removed_at", F.unix_micros(F.col("removed_at").cast("timestamp")))


@query(
    "local_day_counts",
    """WITH d AS (SELECT event_type AS category, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day FROM events)
       SELECT category, day, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 5 HOUR) AS begins, epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 29 HOUR) AS ends, count(*) AS n FROM d GROUP BY category, day""",
)
def local_day_counts(spark, sf_dir):
    """STR-7: events by local day of New York, which is five hours behind in January."""
    return expiry.local_day_counts(stories(spark, sf_dir), "event_type", "ts", "America/New_York")


@query(
    "breaking_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'error'),
            s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
       SELECT CAST(user_id AS VARCHAR) AS story, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, epoch_us(max(ts) + INTERVAL 12 HOUR) AS until, count(*) AS sightings FROM s GROUP BY user_id, session""",
)
def breaking_sessions(spark, sf_dir):
    """STR-10: when breaking stories, a user's errors, end."""
    found = expiry.breaking_expiry(stories(spark, sf_dir).filter("event_type = 'error'"), "user_id", "ts", "1 hour")
    return found.withColumns({c: F.unix_micros(c) for c in ("first", "last", "until")})


@query("freshness_gate", f"SELECT CASE WHEN ts < TIMESTAMP '{START}' THEN 'outside_window' WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 15 MINUTE THEN 'in_future' ELSE 'in' END AS gate, count(*) AS n FROM events GROUP BY ALL")
def freshness_gate(spark, sf_dir):
    """STR-2, STR-3."""
    reason = S.freshness_gate(F.col("ts").cast("timestamp"), moment(START).cast("timestamp"), moment(NOW).cast("timestamp"))
    return stories(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("in")).alias("gate")).agg(F.count("*").alias("n"))


@query("lifecycle_states", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'rejected' WHEN ts >= TIMESTAMP '{START}' THEN 'current' ELSE 'archived' END AS state FROM events")
def lifecycle_states(spark, sf_dir):
    """STR-9, SNK-8."""
    state = F.when(F.col("event_id") % 3 == 0, "rejected").when(F.col("event_id") % 3 == 1, "current").otherwise("archived")
    return stories(spark, sf_dir).select("event_id", S.lifecycle(F.col("ts"), moment(START), state).alias("state"))


@query("breaking_list", f"SELECT event_id, ts + INTERVAL 12 HOUR AS until FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{NOW}' AND ts + INTERVAL 12 HOUR > TIMESTAMP '{NOW}'")
def breaking_list(spark, sf_dir):
    """CQ-2, CQ-3, STR-10: breaking stories that haven't expired."""
    until = S.breaking_until(F.col("ts"))
    return stories(spark, sf_dir).filter((F.col("event_type") == "error") & (F.col("ts") <= moment(NOW)) & (until > moment(NOW))).select("event_id", until.alias("until"))


@query(
    "page_visibility",
    """WITH c AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'error' THEN 'Removed' WHEN 'click' THEN 'Active' WHEN 'purchase' THEN 'Updated' ELSE 'Unavailable' END AS status FROM events),
       l AS (SELECT user_id, status FROM c WHERE status <> 'Unavailable' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
       SELECT c.user_id, any_value(coalesce(l.status, 'Active')) <> 'Removed' AS visible, count(*) FILTER (c.status = 'Removed') AS hidden_times FROM c LEFT JOIN l USING (user_id) GROUP BY c.user_id""",
)
def page_visibility(spark, sf_dir):
    """STR-11."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "Removed").when(kind == "click", "Active").when(kind == "purchase", "Updated").otherwise("Unavailable")
    return S.visible_after(stories(spark, sf_dir).withColumn("status", status), "user_id", ["ts", "event_id"], "status")


@query(
    "homepage",
    f"""WITH w AS (SELECT * FROM events WHERE ts >= TIMESTAMP '{START}' AND ts <= TIMESTAMP '{NOW}' AND event_type <> 'error'),
        f AS (SELECT event_id FROM w ORDER BY value DESC, event_id LIMIT 5)
        SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM f) THEN 'featured' ELSE 'news' END AS part FROM w""",
)
def homepage(spark, sf_dir):
    """CQ-1, CQ-4: the best stories of the window, and all others without them."""
    inside = (F.col("ts") >= moment(START)) & (F.col("ts") <= moment(NOW)) & (F.col("event_type") != "error")
    return S.composed(stories(spark, sf_dir).filter(inside).select("event_id", "value"), "event_id", [F.col("value").desc(), F.col("event_id")], 5).select("event_id", "part")


@query("snapshot_totals", "SELECT coalesce(event_type, 'total') AS category, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def snapshot_totals(spark, sf_dir):
    """CQ-5: the total and each category's count in one pass."""
    return stories(spark, sf_dir).rollup("event_type").agg(F.count("*").alias("n")).select(F.coalesce("event_type", F.lit("total")).alias("category"), "n")


@query(
    "publish_guard",
    """SELECT page_id, html <> '' AND url <> '' AND NOT contains(lower(html), 'page not found') AND length(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) >= 35 AS publishable FROM pages""",
)
def publish_guard(spark, sf_dir):
    """CQ-8: what a page needs to be shown."""
    from presslake.functions import columns as C

    html = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", ((html != "") & (F.col("url") != "") & ~F.lower(html).contains("page not found") & (F.length(C.html_tag(html, "title")) >= 35)).alias("publishable"))


@query("missing_images", "SELECT page_id FROM pages WHERE NOT regexp_matches(html, '(?i)<img\\b') AND page_id % 3 <> 0")
def missing_images(spark, sf_dir):
    """CQ-7: stories without a picture, but for those that are asked to be left out."""
    return read(spark, sf_dir, "pages").filter(~F.col("html").rlike(r"(?i)<img\b") & (F.col("page_id") % 3 != 0)).select("page_id")


@query("trend_split", "SELECT tag, CASE WHEN starts_with(tag, '#') THEN 'hashtag' ELSE 'topic' END AS kind, n FROM (SELECT CASE WHEN user_id % 4 = 0 THEN '#' || event_type ELSE event_type END AS tag, count(*) AS n FROM events GROUP BY ALL)")
def trend_split(spark, sf_dir):
    """CQ-10."""
    tag = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("#"), "event_type")).otherwise(F.col("event_type"))
    counts = stories(spark, sf_dir).groupBy(tag.alias("tag")).agg(F.count("*").alias("n"))
    return counts.select("tag", F.when(F.col("tag").startswith("#"), "hashtag").otherwise("topic").alias("kind"), "n")


@query("run_metrics", "SELECT user_id % 10 AS stage, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id % 10")
def run_metrics(spark, sf_dir):
    """AG-17, AG-18: a run's counters by stage and status."""
    return stories(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("stage")).agg(*(F.count_if(F.col("event_type") == name).alias(name) for name in ("view", "click", "error")))


@query("failure_reasons", "SELECT CASE WHEN value < 20 THEN 'too_small' WHEN value < 40 THEN 'bad_ratio' ELSE 'other' END AS reason, count(*) AS n, max(ts) AS latest FROM events WHERE event_type = 'error' GROUP BY 1")
def failure_reasons(spark, sf_dir):
    """AG-19."""
    reason = F.when(F.col("value") < 20, "too_small").when(F.col("value") < 40, "bad_ratio").otherwise("other")
    return stories(spark, sf_dir).filter("event_type = 'error'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


@query("archive_days", "SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, event_type FROM events WHERE ts < TIMESTAMP '2024-01-24'")
def archive_days(spark, sf_dir):
    """AG-10, AG-21: days and categories that the archive has."""
    return stories(spark, sf_dir).filter(F.col("ts") < moment(START)).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").distinct()


@query("category_monitor", "SELECT event_type, count(*) AS n, max(ts) AS latest, CASE WHEN count(*) = 0 THEN 'empty' WHEN max(ts) < TIMESTAMP '2024-01-30 00:00:00' THEN 'stale' ELSE 'ok' END AS status, count(DISTINCT CASE WHEN value < 10 THEN user_id END) AS failing FROM events GROUP BY event_type")
def category_monitor(spark, sf_dir):
    """AG-11, AG-14, STR-14: counts, latest story, state and failing sources of each category."""
    status = F.when(F.count("*") == 0, "empty").when(F.max("ts") < moment("2024-01-30"), "stale").otherwise("ok")
    return stories(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("latest"), status.alias("status"), F.count_distinct(F.when(F.col("value") < 10, F.col("user_id"))).alias("failing"))


@query("source_health", "SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-29 12:00:00') AS recent, CAST(floor(100.0 * count(*) FILTER (value >= 20) / count(*) + 0.5) AS INTEGER) AS success, CASE WHEN count(*) FILTER (value < 20) >= 3 THEN 'failing' WHEN count(*) FILTER (value < 20) >= 1 THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY user_id")
def source_health(spark, sf_dir):
    """AG-22, MA-11: recent stories, successes in percent, and health by failures (0, 1, 3)."""
    failures = F.count_if(F.col("value") < 20)
    health = F.when(failures >= 3, "failing").when(failures >= 1, "degraded").otherwise("healthy")
    success = F.floor(F.count_if(F.col("value") >= 20) * 100.0 / F.count("*") + 0.5).cast("int")
    return stories(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("ts") >= moment("2024-01-29 12:00:00")).alias("recent"), success.alias("success"), health.alias("health"))


@query("interrupted_runs", f"SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '{NOW}' - INTERVAL 3 HOUR THEN 'interrupted' ELSE event_type END AS status FROM events")
def interrupted_runs(spark, sf_dir):
    """BJ-14: runs that have been going for more than three hours."""
    old = (F.col("event_type") == "view") & (F.col("ts") < moment(NOW) - F.expr("interval 3 hours"))
    return stories(spark, sf_dir).select("event_id", F.when(old, "interrupted").otherwise(F.col("event_type")).alias("status"))


@query("cooled_down", f"SELECT user_id, max(ts) <= TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AS may_run FROM events GROUP BY user_id")
def cooled_down(spark, sf_dir):
    """BJ-17, FLT-26: keys whose last run is 15 minutes ago or more."""
    return stories(spark, sf_dir).groupBy("user_id").agg((F.max("ts") <= moment(NOW) - F.expr("interval 15 minutes")).alias("may_run"))


@query("reject_log", "SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 100 THEN 'content_too_short' WHEN lang <> 'en' THEN 'other_language' END AS reason FROM documents WHERE text IS NULL OR length(text) < 100 OR lang <> 'en'")
def reject_log(spark, sf_dir):
    """BJ-3, BJ-5: what an import leaves out, and why."""
    reason = F.when(F.col("text").isNull() | (F.length("text") < 100), "content_too_short").when(F.col("lang") != "en", "other_language")
    return read(spark, sf_dir, "documents").select("doc_id", reason.alias("reason")).filter("reason is not null")


@query("tag_backfill", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'kept' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(lower(url), '[a-z]{5,}')))[1:8], ',') END AS tags FROM pages")
def tag_backfill(spark, sf_dir):
    """BJ-1, BJ-9, SO-9: tags for stories that have none, eight at most."""
    found = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("url"), F.lit("[a-z]{5,}"), F.lit(0)))), 1, 8)
    return read(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, "kept").otherwise(F.array_join(found, ",")).alias("tags"))


@query("soft_deleted", "SELECT user_id, arg_max(event_type, event_id) = 'error' AS deleted, count(*) AS audit_rows FROM events GROUP BY user_id")
def soft_deleted(spark, sf_dir):
    """SNK-12, SNK-18: the last entry of an append-only log deletes or restores."""
    return stories(spark, sf_dir).groupBy("user_id").agg((F.max_by("event_type", "event_id") == "error").alias("deleted"), F.count("*").alias("audit_rows"))


@query("latency_seconds", "SELECT conv_id, CAST(greatest(0, max(length(text)) - min(length(text))) AS BIGINT) AS seconds FROM conversations GROUP BY conv_id")
def latency_seconds(spark, sf_dir):
    """DT-9: a difference that is never negative."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.greatest(F.lit(0), F.max(F.length("text")) - F.min(F.length("text"))).cast("long").alias("seconds"))


@query("relative_ages", f"SELECT event_id, CASE WHEN h < 1 THEN 'now' WHEN h < 24 THEN CAST(CAST(floor(h) AS BIGINT) AS VARCHAR) || ' h' ELSE CAST(CAST(floor(h / 24) AS BIGINT) AS VARCHAR) || ' d' END AS age FROM (SELECT event_id, epoch_us(TIMESTAMP '{NOW}' - ts) / 3.6e9 AS h FROM events)")
def relative_ages(spark, sf_dir):
    """DT-11."""
    hours = (F.unix_micros(moment(NOW).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(3.6e9)
    return stories(spark, sf_dir).select("event_id", S.relative_label(hours).alias("age"))


@query("queue_summary", "SELECT o_orderstatus, CAST(map_from_entries(list((o_orderpriority, n) ORDER BY o_orderpriority)) AS VARCHAR) AS counts FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def queue_summary(spark, sf_dir):
    """AG-28: a map of counts inside each state, as text."""
    counts = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("o_orderpriority", "n")))
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["o_orderpriority"], e["n"].cast("string"))), ", "), F.lit("}"))
    return counts.groupBy("o_orderstatus").agg(text.alias("counts"))
