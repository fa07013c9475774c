"""Batch jobs over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from presslake.functions import summaries as S
from presslake.operators import repairs as R
from presslake.plans.catalog import query
from presslake.session import read

NOW = "2024-01-30 12:00:00"
CLIPPED = r"(?s)^(.*)(?:\. |؟|\.\n|،| )"


@query(
    "rejected_articles",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'institutional_or_landing_page' WHEN length(trim(coalesce(text, ''))) < 100 THEN 'missing_substantive_content' END AS reason FROM documents""",
)
def rejected_articles(spark, sf_dir):
    """BJ-5: every fourth title and every fifth address is none of a story."""
    title = F.when(F.col("doc_id") % 4 == 0, "سياسة الخصوصية").otherwise("A long headline about something that happened")
    url = F.when(F.col("doc_id") % 5 == 0, "https://a.org/about-us").otherwise("https://a.org/news/2024/story-of-the-day")
    reason = R.non_article(title, url, F.array(F.coalesce("text", F.lit(""))))
    return read(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"))


@query(
    "moved_by_title",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN CASE p_size % 6 WHEN 0 THEN 'الاقتصاد' WHEN 1 THEN 'البيئة والمناخ' WHEN 2 THEN 'السفر' WHEN 3 THEN 'الطاقة والصناعة' WHEN 4 THEN 'الاقتصاد' ELSE 'السياسة' END ELSE 'السياسة' END AS category FROM part""",
)
def moved_by_title(spark, sf_dir):
    """BJ-7: of the titles, number 4 speaks of oil on markets, which the first list takes."""
    titles = ["سعر ذهب اليوم", "حريق كبير", "موسم سياحي", "إنتاج النفط", "النفط في أسواق اليوم", "لقاء سياسي"]
    title = F.element_at(F.array(*map(F.lit, titles)), (F.col("p_size") % 6 + 1).cast("int"))
    status = F.when(F.col("p_partkey") % 2 == 0, "review").otherwise("published")
    return read(spark, sf_dir, "part").select("p_partkey", R.moved_category(F.lit(R.POLITICS), status, title).alias("category"))


@query(
    "classification_audit",
    """SELECT outcome, CASE WHEN outcome = 'reassigned' THEN event_type || ' -> ' || new END AS move, count(*) AS n FROM
       (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'sent_to_review' WHEN new = event_type THEN 'unchanged' ELSE 'reassigned' END AS outcome FROM
       (SELECT *, CASE WHEN value > 50 THEN 'view' ELSE 'click' END AS new FROM events)) GROUP BY ALL""",
)
def classification_audit(spark, sf_dir):
    """BJ-10, AG-16."""
    out = R.audited(F.col("event_type"), F.when(F.col("value") > 50, "view").otherwise("click"), F.col("user_id") % 7 == 0)
    return read(spark, sf_dir, "events").select(out.alias("o")).groupBy("o.outcome", "o.move").agg(F.count("*").alias("n"))


@query(
    "recovery_sources",
    f"""SELECT user_id, last_checked FROM (SELECT user_id, max(ts) AS last_checked, max_by(event_type, ts) AS kind FROM events GROUP BY user_id)
        WHERE kind <> 'view' AND user_id % 3 <> 0 AND last_checked < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTES ORDER BY user_id LIMIT 2""",
)
def recovery_sources(spark, sf_dir):
    """BJ-16: the two that a run takes are the feature."""
    health = F.when(F.max_by("event_type", "ts") == "view", "Healthy").otherwise("Failing")
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_checked"), health.alias("health")).withColumn("social", F.col("user_id") % 3 == 0)
    return R.recovery_sources(rows, "user_id", F.lit(NOW).cast("timestamp_ntz")).select("user_id", "last_checked")


@query("story_search", "SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', text, lang, source)), 'src1') AND lang = 'en'")
def story_search(spark, sf_dir):
    """BJ-19."""
    return R.search(read(spark, sf_dir, "documents"), " SRC1 ", ["text", "lang", "source"], F.col("lang") == "en").select("doc_id")


@query(
    "new_records",
    """SELECT event_id FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_id % 2 = 1 AND (s.ts = e.ts OR (s.user_id = e.user_id AND s.user_id < 40)))""",
)
def new_records(spark, sf_dir):
    """BJ-12, JN-18: rows that no stored one agrees with in time or in a number; higher numbers are missing."""
    rows = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("ts"), F.when(F.col("user_id") < 40, F.col("user_id")).alias("number"))
    return R.unknown_records(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["ts", "number"]).select("event_id")


@query(
    "named_entities",
    rf"""WITH t AS (SELECT doc_id, '«' || source || '» and "' || lang || '" of شركة ' || source || '. «' || lang || '» ' || coalesce(text, '') AS t FROM documents),
        z AS (SELECT doc_id, list_zip(regexp_extract_all(t, '{S.ENTITY}', 1), regexp_extract_all(t, '{S.ENTITY}', 0)) AS z FROM t),
        n AS (SELECT doc_id, list_filter(list_transform(z, lambda x: trim(CASE WHEN x[1] <> '' THEN x[1] ELSE x[2] END)), lambda x: len(x) < 90) AS l FROM z)
        SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:15], '|') AS names FROM n""",
)
def named_entities(spark, sf_dir):
    """TX-37 over every whole text, with names put before it."""
    text = F.concat(F.lit("«"), "source", F.lit('» and "'), "lang", F.lit('" of شركة '), "source", F.lit(". «"), "lang", F.lit("» "), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(S.entities(text), "|").alias("names"))


@query(
    "clipped_texts",
    rf"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, substr(coalesce(text, ''), 1, 419) AS p FROM documents),
        c AS (SELECT doc_id, t, p, regexp_extract(p, '{CLIPPED}', 1) AS b FROM p)
        SELECT doc_id, sha256(CASE WHEN length(t) <= 420 THEN t ELSE regexp_replace(CASE WHEN length(b) > 231 THEN b ELSE p END, '^\s+|\s+$', '', 'g') || '…' END) AS clipped FROM c""",
)
def clipped_texts(spark, sf_dir):
    """TX-39: whole texts are read; the cut is the operator."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(S.clip(F.coalesce("text", F.lit("")), 420), 256).alias("clipped"))


@query(
    "article_rows",
    f"""SELECT event_id, event_type AS first, CASE WHEN user_id % 2 = 0 THEN 'local' WHEN user_id % 3 = 0 THEN 'original' ELSE '' END AS image,
        CASE WHEN ts + INTERVAL 12 HOURS > TIMESTAMP '{NOW}' THEN 'breaking' ELSE '' END AS badge, coalesce(CASE WHEN user_id % 5 = 0 THEN 1.0 END, value, 0) AS priority FROM events""",
)
def article_rows(spark, sf_dir):
    """PRJ-1 over events as stored stories."""
    user = F.col("user_id")
    rows = read(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.array("event_type")).alias("content"), F.lit("").alias("summary"), F.when(user % 2 == 0, "local").otherwise("").alias("image_local"),
        F.when(user % 3 == 0, "original").alias("image_original"), F.lit("").alias("image_thumbnail"), F.lit("breaking").alias("badge"),
        (F.col("ts") + F.expr("interval 12 hours")).alias("breaking_until"), F.when(user % 5 == 0, 1.0).alias("override"), F.col("value").cast("double").alias("score"),
    )
    return R.articles(rows, F.lit(NOW).cast("timestamp_ntz")).select("event_id", F.get("paragraphs", 0).alias("first"), "image", "badge", "priority")


@query("editor_queue", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 80")
def editor_queue(spark, sf_dir):
    """CQ-6: the newest 80 of a state; the limit is the listing's."""
    rows = read(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "P").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    return rows.limit(80).select("o_orderkey", "o_orderdate")


@query(
    "repair_pass",
    r"""WITH RECURSIVE d AS (SELECT doc_id, trim(lower(regexp_replace(substr(regexp_extract(coalesce(text, ''), '^[^.\n]*'), 1, 40), '[^\p{L}\p{N}]+', ' ', 'g'))) AS t, lang || ':' || n_chars AS e, length(substr(coalesce(text, ''), 1, 200)) AS size, regexp_extract(coalesce(text, ''), '^[^.\n]*') AS title FROM documents),
        s AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM d WHERE substr(title, 1, 40) <> '' AND size >= 35),
        w AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS doc_id, CAST([] AS STRUCT(t VARCHAR, e VARCHAR, k BIGINT)[]) AS kept, CAST(NULL AS BIGINT) AS original
              UNION ALL
              SELECT n, doc_id, CASE WHEN original IS NULL THEN list_append(kept, {'t': t, 'e': e, 'k': doc_id}) ELSE kept END, original FROM (
                SELECT s.n, s.doc_id, s.t, s.e, w.kept, coalesce(list_filter(w.kept, lambda x: x.t <> '' AND x.t = s.t)[1].k, list_filter(w.kept, lambda x: x.e = s.e)[1].k) AS original FROM w JOIN s ON s.n = w.n + 1))
        SELECT d.doc_id AS id, CASE WHEN s.doc_id IS NULL THEN 'review' WHEN w.original IS NOT NULL THEN 'rejected' ELSE 'published' END AS status,
               CASE WHEN s.doc_id IS NULL OR w.original IS NOT NULL THEN 'current' WHEN d.doc_id < 100 THEN 'archived' ELSE 'current' END AS lifecycle, w.original AS original FROM d LEFT JOIN s USING (doc_id) LEFT JOIN w ON w.doc_id = d.doc_id""",
)
def repair_pass(spark, sf_dir):
    """BJ-4: documents as stored stories in the order of their ids; their first words are the title, their language and length the event."""
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600)
    none = F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").alias("id"), F.substring(F.regexp_extract(text, r"^[^.\n]*", 0), 1, 40).alias("title"), F.substring(text, 1, 200).alias("summary"), F.concat(F.lit("https://a.org/"), F.col("doc_id").cast("string")).alias("url"), day.alias("published"),
        F.array().cast("array<string>").alias("content"), none.alias("normalized_title"), F.concat("lang", F.lit(":"), F.col("n_chars").cast("string")).alias("event"), F.col("source").alias("category"), F.lit("/t").alias("thumbnail"), F.lit("current").alias("lifecycle"), F.lit("published").alias("status"), F.lit("valid").alias("validity"),
    )
    found = R.repair_pass(rows, F.timestamp_seconds(F.lit(1_704_067_200 + 100 * 3600)))
    return found.select("id", "status", "lifecycle", "original")
