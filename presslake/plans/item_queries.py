"""Items, summaries and runs over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import markup as M
from presslake.functions import summaries as S
from presslake.operators import runs as R
from presslake.plans.catalog import query
from presslake.session import read
from presslake.sources import captures, items
from presslake.sources.trees import walk

NOW = "2024-01-30 12:00:00"
#: Plain SQL for the folded words of a text without Arabic letters.
WORDS = r"list_distinct(list_filter(string_split(lower(trim(regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), ' '), lambda w: w <> ''))"
NEAR = "(CASE WHEN len({0}) = 0 OR len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / greatest(len({0}), len({1}))::DOUBLE END)"


@query(
    "api_items",
    """SELECT CAST(doc_id AS VARCHAR) AS item, CAST(doc_id AS VARCHAR) AS guid, 'https://a.org/news/' || doc_id AS link, 'doc ' || doc_id AS title,
       CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '2024-01-0' || (1 + doc_id % 9) END AS published FROM documents WHERE doc_id % 5 <> 4""",
)
def api_items(spark, sf_dir):
    """SRC-9: captured JSON bodies in all three shapes, with other names for the same fields; some entries lack a title."""
    number = F.col("doc_id")
    title = F.when(number % 5 != 4, F.concat(F.lit("doc "), number.cast("string")))
    date = F.when(number % 3 != 0, F.concat(F.lit("2024-01-0"), (1 + number % 9).cast("string")))
    link = F.concat(F.when(number % 2 == 0, "/news/").otherwise("../x/../news/"), number.cast("string"))
    entry = F.to_json(F.struct(F.when(number % 2 == 0, number).alias("id"), F.when(number % 2 == 1, number).alias("article_id"), F.when(number % 2 == 1, number).alias("guid"), F.when(number % 2 == 0, link).alias("url"), F.when(number % 2 == 1, link).alias("link"), F.when(number % 2 == 0, title).alias("title"), F.when(number % 2 == 1, title).alias("headline"), date.alias("date")))
    body = F.when(number % 3 == 0, F.concat(F.lit("["), entry, F.lit("]"))).when(number % 3 == 1, F.concat(F.lit('{"items": ['), entry, F.lit("]}"))).otherwise(F.concat(F.lit('{"articles": ['), entry, F.lit("]}")))
    return items.api_entries(read(spark, sf_dir, "documents").select(body.alias("body")), "body", "https://a.org/feed/v1")


@query(
    "listing_items",
    """SELECT doc_id AS page_id, 'https://a.org/news/' || n AS link, CASE n WHEN 1 THEN 'A structured story ' WHEN 2 THEN 'A state story ' ELSE 'A linked story no ' END || doc_id AS title,
       CASE n WHEN 1 THEN TIMESTAMP '2024-01-05 07:00:00' WHEN 2 THEN TIMESTAMP '2024-01-06 07:30:00' END AS published, CASE n WHEN 1 THEN 'structured' WHEN 2 THEN 'state' ELSE 'link' END AS origin
       FROM documents, unnest([1, 2, 3]) AS t(n) WHERE n <> 2 OR doc_id % 2 = 0""",
)
def listing_items(spark, sf_dir):
    """SRC-7, SRC-10, FLT-19: pages that name a story in structured data, in their script's state and in links, some twice; other links don't count. A date with its year first is read in the fixed zone (DT-5)."""
    number = F.col("doc_id").cast("string")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "NewsArticle", "headline": "A structured story '), number, F.lit('", "url": "/news/1", "datePublished": "2024-01-05T10:00:00Z"}</script>'))
    state = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">{"props": {"list": [{"title": "A state story '), number, F.lit('", "url": "a.org/news/2", "published_at": "Sat, 06 Jan 2024 07:30:00 GMT"}, {"title": "elsewhere", "url": "b.org/news/9", "published_at": "2024"}]}}</script>'))
    links = F.concat(F.lit('<a href="/news/1">The structured story again</a><a href="https://www.a.org/login/news">Sign in to read the news</a><a class="x" href="/news/3"><b>A linked</b> story no '), number, F.lit('</a><a href="/news/3">A linked story once more</a><a href="/news/4">too short</a><a href="https://b.org/news/5">On another site altogether</a>'))
    html = F.concat(links, F.when(F.col("doc_id") % 2 == 0, state).otherwise(""), ld)
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("https://a.org/").alias("url"), html.alias("html"))
    return items.listing_items(pages).withColumn("published", F.col("published").cast("timestamp_ntz"))


@query(
    "json_nodes",
    """SELECT event_id, 0 AS depth, NULL AS name, CAST(json(props) AS VARCHAR) AS value, 1 AS number FROM events WHERE props IS NOT NULL
       UNION ALL SELECT event_id, 1, j.key, CAST(j.value AS VARCHAR), CAST(row_number() OVER (PARTITION BY event_id ORDER BY j.key) AS INTEGER) + 1 FROM events, json_each(props) j""",
)
def json_nodes(spark, sf_dir):
    """SRC-16: all nodes of the JSON that events carry."""
    trees = read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("tree"))
    return walk(trees, ["event_id"], "tree").select("event_id", "depth", "name", F.to_json("value").alias("value"), "number")


@query(
    "captured_items",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS source, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1 FROM pages)
        SELECT source, CASE WHEN len(source) % 2 = 0 THEN 'api' ELSE 'rss' END AS method, page_id // 100 AS sequence, CAST(page_id AS VARCHAR) AS guid, url AS link, page_id,
               trim(regexp_replace(replace(replace(replace(regexp_replace(h1, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS title FROM p""",
)
def captured_items(spark, sf_dir):
    """SRC-2, SRC-13, SRC-20: the pages' own URLs as feeds and interfaces of their hosts, 100 ids to a body; discovered, the best method chosen, and hydrated by their pages."""
    pages = read(spark, sf_dir, "pages")
    named = pages.select("page_id", "url", F.lower(F.parse_url("url", F.lit("HOST"))).alias("source"), F.floor(F.col("page_id") / 100).alias("sequence"))
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    entry = F.concat(F.lit("<item><title>untitled</title><link>"), link, F.lit("</link><guid>"), F.col("page_id").cast("string"), F.lit("</guid></item>"))
    feed = F.concat(F.lit("<rss>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</rss>"))
    api = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("page_id").alias("id"), "url", F.lit("untitled").alias("title")))))
    each = named.groupBy("source", "sequence").agg(feed.alias("rss"), api.alias("api"))
    # hosts of an even length have an interface and a feed, the others a feed only
    of = lambda method: each.select("source", F.lit(method).alias("method"), "sequence", F.concat(F.lit("https://"), "source").alias("url"), F.col(method).alias("body"), F.lit(None).cast("string").alias("error"))
    bodies = of("rss").unionByName(of("api").filter(F.length("source") % 2 == 0))
    chosen = captures.by_priority(captures.discover(bodies, ("api", "rss")), least=1)
    return captures.hydrated(chosen, pages).select("source", "method", "sequence", "guid", "link", "page_id", "title")


@query(
    "hydrated_pages",
    r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS h1, regexp_extract(html, '(?is)<article(?:\s[^>]*)?>(.*?)</article>', 1) AS scope FROM pages),
        p AS (SELECT *, list_filter(list_transform(regexp_extract_all(scope, '(?is)(<p\b[^>]*>.*?</p>)', 1), lambda x: trim(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g'))), lambda x: len(x) > 30) AS body FROM a)
        SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(h1, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '\s+', ' ', 'g')) AS title, CAST(len(body) AS INTEGER) AS paragraphs, sha256(array_to_string(body, chr(10))) AS body, url AS canonical FROM p""",
)
def hydrated_pages(spark, sf_dir):
    """SRC-11 on the whole pages."""
    return items.hydrate(read(spark, sf_dir, "pages")).select("page_id", "title", F.size("body").alias("paragraphs"), F.sha2(F.array_join("body", "\n"), 256).alias("body"), "canonical")


@query(
    "absolute_links",
    r"""SELECT page_id, count(*) AS links, min(regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href) AS first FROM
        (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref="(/[^"#?&< ]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
)
def absolute_links(spark, sf_dir):
    """TX-21: links of pages as seen from their page."""
    found = F.regexp_extract_all("html", F.lit(r'(?i)<a\b[^>]*\bhref="(/[^"#?&< ]*)"'), F.lit(1))
    rows = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(found).alias("href"))
    return rows.groupBy("page_id").agg(F.count("*").alias("links"), F.min(M.absolute_url(F.col("href"), F.col("url"))).alias("first"))


@query("slug_titles", r"SELECT page_id, replace(string_split(rtrim(split_part(split_part(url, '#', 1), '?', 1), '/'), '/')[-1], '-', ' ') AS title, 'story-' || replace(split_part(regexp_extract(url, '://([^/]+)', 1), ':', 1), ' ', '-') AS slug FROM pages")
def slug_titles(spark, sf_dir):
    """SRC-5, TX-24."""
    return read(spark, sf_dir, "pages").select("page_id", M.slug_title(F.col("url"), F.lit("")).alias("title"), M.slug(C.host(F.col("url")), "story-").alias("slug"))


@query(
    "image_checks",
    """SELECT p_partkey, coalesce(b >= 4000 AND b <= 12582912 AND w >= 240 AND h >= 180 AND w / h BETWEEN 0.22 AND 4.5, false) AS valid FROM
       (SELECT p_partkey, CAST(p_retailprice * 8 AS BIGINT) AS b, p_size * 25.0 AS w, (51 - p_size) * 20.0 AS h FROM part)""",
)
def image_checks(spark, sf_dir):
    """FLT-24."""
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", M.image_valid(F.round(F.col("p_retailprice") * 8).cast("long"), size * 25.0, (51 - size) * 20.0).alias("valid"))


@query(
    "summary_reasons",
    f"""WITH a AS (SELECT doc_id, trim(regexp_replace(substr(text, 1, 40 + doc_id % 450), '\\s+', ' ', 'g')) AS v, substr(text, 1, 60) AS t FROM documents),
        b AS (SELECT *, {WORDS.format("v")} AS x, {WORDS.format("t")} AS y, lower(trim(regexp_replace(v, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS pv, lower(trim(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS pt FROM a)
        SELECT doc_id, concat_ws(',', CASE WHEN len(v) < 70 THEN 'summary_too_short' END, CASE WHEN len(v) > 420 THEN 'summary_too_long' END, CASE WHEN len(x) < 10 THEN 'summary_lacks_information' END,
        CASE WHEN {NEAR.format("x", "y")} > 0.82 OR pv = pt THEN 'summary_repeats_headline' END) AS reasons FROM b""",
)
def summary_reasons(spark, sf_dir):
    """TX-16, with the documents' beginnings as titles and as summaries of many lengths."""
    summary = F.substring(F.col("text"), F.lit(1), (40 + F.col("doc_id") % 450).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(S.quality_reasons(summary, F.substring("text", 1, 60)), ",").alias("reasons"))


@query(
    "best_sentences",
    f"""WITH s AS (SELECT doc_id, substr(text, 1, 60) AS title, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?؟…])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: len(s) > 45) AS l FROM documents),
        u AS (SELECT doc_id, title, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM s),
        w AS (SELECT *, {WORDS.format("s")} AS x, {WORDS.format("title")} AS y FROM u), n AS (SELECT *, {NEAR.format("x", "y")} AS near FROM w),
        c AS (SELECT doc_id, i, s, x, CASE WHEN near > 0.82 THEN -50.0 ELSE greatest(0.0, 5.0 - i * 0.35::DOUBLE) + CASE WHEN len(s) BETWEEN 80 AND 220 THEN 4 WHEN len(s) >= 60 THEN 2 ELSE 0 END + CASE WHEN near BETWEEN 0.08 AND 0.7 THEN 4 ELSE 0 END + CASE WHEN regexp_matches(s, '[0-9]') THEN 1 ELSE 0 END END AS score FROM n),
        f AS (SELECT doc_id, i, s, x FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) = 1),
        g AS (SELECT c.doc_id, c.i, c.s FROM c JOIN f ON c.doc_id = f.doc_id AND c.i <> f.i WHERE c.score > 0 AND len(f.s) < 150 AND {NEAR.format("c.x", "f.x")} <= 0.68 QUALIFY row_number() OVER (PARTITION BY c.doc_id ORDER BY c.score DESC, c.i) = 1),
        b AS (SELECT doc_id, i, s FROM f UNION ALL SELECT * FROM g)
        SELECT doc_id, count(s) AS sentences, sha256(coalesce(string_agg(s, ' ' ORDER BY i), '')) AS summary FROM documents LEFT JOIN b USING (doc_id) GROUP BY doc_id""",
)
def best_sentences(spark, sf_dir):
    """TX-14, TX-15 over every whole document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 60).alias("title"), S.usable_sentences(F.array("text")).alias("sentences"))
    rows = S.best_sentences(docs, F.col("title"), F.col("sentences"))
    return rows.select("doc_id", F.size("best").cast("long").alias("sentences"), F.sha2(F.array_join("best", " "), 256).alias("summary"))


@query(
    "turn_repeats",
    r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split(lower(trim(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]+', ' ', 'g'))), ' '), lambda w: len(w) > 1) AS l FROM conversations),
        s AS (SELECT conv_id, turn, CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 2 THEN [array_to_string(l, ' ')] ELSE list_distinct([l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))]) END AS g FROM w),
        p AS (SELECT *, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM s),
        j AS (SELECT conv_id, turn, CASE WHEN len(g) = 0 AND len(h) = 0 THEN 1.0 WHEN len(g) = 0 OR len(h) = 0 THEN 0.0 ELSE len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h)))::DOUBLE END AS n FROM p WHERE h IS NOT NULL)
        SELECT conv_id, turn, n >= 0.7 AS duplicate, floor(n * 100 + 0.5) / 100 AS similarity FROM j""",
)
def turn_repeats(spark, sf_dir):
    """TX-8: whether a turn says what the one before it said."""
    before = F.lag(F.coalesce("text", F.lit(""))).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), before.alias("before")).filter("before is not null")
    return rows.select("conv_id", "turn", S.shingle_duplicate(F.col("text"), F.col("before")).alias("d")).select("conv_id", "turn", "d.*")


@query(
    "social_scores",
    """SELECT platform, user_id, floor(CASE WHEN platform = 'x' THEN p * 2.0 + c * 0.5 + s + v * 0.05 ELSE s * 2.0 + c * 0.5 + v * 0.1 END + 0.5) AS engagement FROM
       (SELECT CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'instagram' END AS platform, user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY user_id)""",
)
def social_scores(spark, sf_dir):
    """MA-3 with the platforms' own weights."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(n("purchase").alias("p"), n("click").alias("c"), n("signup").alias("s"), n("view").alias("v"))
    platform = F.when(F.col("user_id") % 2 == 0, "x").otherwise("instagram")
    return counts.select(platform.alias("platform"), "user_id", S.social_engagement(platform, F.col("p"), F.col("c"), F.col("s"), F.col("v")).cast("double").alias("engagement"))


@query(
    "home_ranks",
    f"""SELECT event_id, greatest(0.0, 100 - least(greatest(epoch_us(TIMESTAMP '{NOW}' - ts) / 8.64e10, 0.0), 100.0)) * 5 + least(greatest(value, 0), 100) * 3 + (user_id % 101) * 2
       + CASE WHEN event_type = 'purchase' THEN 25 ELSE 0 END + 2 * CASE event_type WHEN 'view' THEN 9 WHEN 'click' THEN 5 ELSE 1 END + 3 AS rank FROM events ORDER BY rank DESC, event_id LIMIT 50""",
)
def home_ranks(spark, sf_dir):
    """SO-11, SO-5: the 50 best stories by one number; limit and all are of the listing."""
    kind = F.col("event_type")
    category = F.when(kind == "view", "السياسة، محلي").when(kind == "click", "الرياضة").otherwise("")
    age = (F.unix_micros(F.lit(NOW).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 8.64e10
    rank = S.homepage_rank(age, F.col("value"), F.col("user_id") % 101, kind == "purchase", category, S.completeness(F.col("event_id"), kind, F.lit(""), F.col("value")))
    return read(spark, sf_dir, "events").select("event_id", rank.alias("rank")).orderBy(F.col("rank").desc(), "event_id").limit(50)


@query(
    "new_items",
    """WITH i AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN ts + INTERVAL 2 DAYS END AS modified FROM events),
       s AS (SELECT user_id, max(event_id) FILTER (ts < TIMESTAMP '2024-01-15') AS item, max(ts) FILTER (ts < TIMESTAMP '2024-01-12') AS published, max(modified) FILTER (ts < TIMESTAMP '2024-01-10') AS changed FROM i GROUP BY user_id)
       SELECT event_id FROM i JOIN s USING (user_id) WHERE coalesce(modified IS NOT NULL AND (changed IS NULL OR modified > changed), false) OR NOT (coalesce(event_id = item, false) OR coalesce(ts <= published, false))""",
)
def new_items(spark, sf_dir):
    """STR-1, WN-5: a source's cursor against all its items."""
    changed = F.when(F.col("event_id") % 7 == 0, F.col("ts") + F.expr("interval 2 days"))
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("item"), F.lit("").alias("guid"), F.lit(None).cast("string").alias("url"), F.col("ts").alias("published"), changed.alias("modified"))
    before = lambda day: F.col("published") < F.lit(day).cast("timestamp_ntz")
    state = rows.groupBy("user_id").agg(F.max(F.when(before("2024-01-15"), F.col("item"))).alias("last_item"), F.max(F.when(before("2024-01-12"), F.col("published"))).alias("last_published"), F.max(F.when(before("2024-01-10"), F.col("modified"))).alias("last_modified"))
    state = state.withColumns({"last_guid": F.lit(""), "last_url": F.lit(None).cast("string")})
    return R.incremental(rows, state, "user_id").select(F.col("item").alias("event_id"))


@query(
    "duplicate_decisions",
    """SELECT decision, count(*) AS n FROM (SELECT CASE WHEN event_type NOT IN ('view', 'click') AND (user_id % 2 = 0 OR (event_id % 3 <> 0 AND (event_id % 5 = 0 OR value > 50))) THEN 'update' ELSE 'skip' END AS decision FROM events) GROUP BY decision""",
)
def duplicate_decisions(spark, sf_dir):
    """STR-5: matches by title or content are skipped, others update if hash or date is new."""
    match = F.when(F.col("event_type") == "view", "title_similarity").when(F.col("event_type") == "click", "content_hash").otherwise("guid")
    modified = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    decision = R.on_duplicate(match, F.when(F.col("user_id") % 2 == 0, "new"), F.lit(None).cast("string"), modified, F.when(F.col("event_id") % 5 != 0, F.lit(50.0)))
    return read(spark, sf_dir, "events").groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query(
    "run_states",
    """WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value > 80) AS a, count(*) FILTER (event_type = 'error') AS f, count(*) FILTER (value > 99) AS n, count(*) FILTER (value > 97) AS b FROM events GROUP BY user_id),
       s AS (SELECT *, CASE WHEN a > 0 THEN CASE WHEN f > 8 THEN 'Degraded' ELSE 'Healthy' END WHEN n = 0 THEN 'Healthy' ELSE 'Degraded' END AS status FROM c)
       SELECT user_id, status, CASE WHEN b > 0 AND n = 0 THEN 'Out of Sync' WHEN status = 'Healthy' THEN 'Healthy' ELSE 'Delayed' END AS breaking FROM s""",
)
def run_states(spark, sf_dir):
    """MA-9: a source's run by what it accepted, failed and showed."""
    kind, value = F.col("event_type"), F.col("value")
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if((kind == "purchase") & (value > 80)).alias("a"), F.count_if(kind == "error").alias("f"), F.count_if(value > 99).alias("n"), F.count_if(value > 97).alias("b"))
    return counts.select("user_id", R.run_status(F.col("a"), F.greatest(F.col("f") - 8, F.lit(0)), F.col("n"), F.col("b"), F.col("n")).alias("s")).select("user_id", "s.*")


@query(
    "source_states",
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'Degraded' ELSE 'Healthy' END AS status FROM events),
       l AS (SELECT user_id, max(ts) FILTER (status = 'Healthy') AS ok FROM e GROUP BY user_id)
       SELECT user_id, max_by(status, ts) AS health, max_by(event_id, ts) AS last_item, max(ts) AS last_published, count(*) FILTER (status <> 'Healthy' AND (ok IS NULL OR ts > ok)) AS failures FROM e JOIN l USING (user_id) GROUP BY user_id""",
)
def source_states(spark, sf_dir):
    """STR-6."""
    nothing = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") == "error", "Degraded").otherwise("Healthy").alias("status"), F.col("event_id").alias("item"), nothing.alias("guid"), nothing.alias("url"), F.col("ts").alias("published"), F.lit(None).cast("timestamp_ntz").alias("modified"))
    return R.source_states(rows, "user_id", "ts").select("user_id", "health", "last_item", "last_published", "failures")


@query(
    "next_runs",
    """WITH a AS (SELECT event_id, ts, event_id % 3 AS kind, CAST(event_id * 37 % 1440 AS BIGINT) AS minute FROM events),
       d AS (SELECT event_id, ts, kind, date_trunc('day', ts + INTERVAL 3 HOURS) + to_days(CAST(i AS INTEGER)) + to_minutes(minute) - INTERVAL 3 HOURS AS run, dayofweek(date_trunc('day', ts + INTERVAL 3 HOURS) + to_days(CAST(i AS INTEGER))) AS dow FROM a, range(0, 9) AS r(i))
       SELECT event_id, CASE WHEN kind = 0 THEN min(ts + INTERVAL 6 HOURS) ELSE min(run) FILTER (run >= ts AND (kind = 1 OR dow IN (1, 4))) END AS next FROM d GROUP BY event_id, kind""",
)
def next_runs(spark, sf_dir):
    """DT-10: hourly, daily and weekly schedules in a zone three hours ahead."""
    number = F.col("event_id")
    kind = F.element_at(F.array(F.lit("hourly"), F.lit("daily"), F.lit("weekly")), (number % 3 + 1).cast("int"))
    at = F.col("ts").cast("timestamp")
    run = R.next_run(at, F.lit(True), kind, F.lit(6), number * 37 % 1440, F.array(F.lit(1), F.lit(4)), "Asia/Riyadh")
    return read(spark, sf_dir, "events").select("event_id", run.cast("timestamp_ntz").alias("next"))


@query(
    "keyword_classes",
    """SELECT p_partkey, CASE WHEN greatest(a, b, c) = 0 THEN NULL WHEN a >= b AND a >= c THEN 'first' WHEN b >= c THEN 'second' ELSE 'third' END AS class, b > 0 AND c = 0 AS wanted FROM
       (SELECT p_partkey, contains(t, 'a') ::INT + contains(t, 'promo')::INT AS a, contains(t, 'steel')::INT + contains(t, 'e')::INT AS b, contains(t, 'brass')::INT AS c FROM (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t FROM part))""",
)
def keyword_classes(spark, sf_dir):
    """MA-10 and FLT-30: keywords found, the first class of most; included and excluded terms."""
    text = F.concat_ws(" ", "p_name", "p_type")
    found = R.keyword_class(text, {"first": ["A", "promo"], "second": ["STEEL", "e"], "third": ["brass"]})
    return read(spark, sf_dir, "part").select("p_partkey", found.alias("class"), R.terms_filter(text, ["steel", "E"], ["Brass"]).alias("wanted"))


@query(
    "promotions",
    """SELECT promote, reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'view' THEN ts <= TIMESTAMP '2024-01-20' AND value > 50 WHEN event_type = 'click' AND value > 50 THEN true WHEN event_type = 'signup' AND value > 50 AND user_id % 4 <> 0 THEN user_id % 2 = 0 ELSE false END AS promote,
       CASE WHEN event_type = 'view' THEN CASE WHEN ts > TIMESTAMP '2024-01-20' THEN 'Scheduled post not activated: publication time has not arrived' END
            WHEN event_type = 'signup' AND value > 50 AND user_id % 4 <> 0 THEN CASE WHEN user_id % 2 <> 0 THEN 'Automatic publishing is not enabled for the source' END
            WHEN event_type = 'signup' THEN 'Invalid publication status: Imported' WHEN event_type = 'error' THEN 'Invalid publication status: gone' END AS reason FROM events) GROUP BY ALL""",
)
def promotions(spark, sf_dir):
    """STR-19: scheduled, approved, imported, unknown and public records."""
    kind, user = F.col("event_type"), F.col("user_id")
    status = F.when(kind == "view", "مجدول").when(kind == "click", "معتمد").when(kind == "signup", "Imported").when(kind == "error", "gone").otherwise("منشور")
    out = R.promotion(status, F.col("value") > 50, F.col("ts"), F.lit("2024-01-20").cast("timestamp_ntz"), F.lit(True), user % 4 == 0, user % 2 == 0)
    return read(spark, sf_dir, "events").select(out.alias("o")).groupBy("o.promote", "o.reason").agg(F.count("*").alias("n"))


@query("changed_columns", "SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'blocked' ELSE s_name END AS s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier")
def changed_columns(spark, sf_dir):
    """SNK-10."""
    return R.set_columns(read(spark, sf_dir, "supplier"), F.col("s_acctbal") < 0, {"s_name", "s_acctbal"}, s_name="blocked", s_acctbal=0.0).select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")


@query(
    "related_first",
    "SELECT doc_id, source = 'src1' AS same FROM documents ORDER BY CASE WHEN source = 'src1' THEN 0 ELSE 1 END, n_chars DESC, doc_id LIMIT 24",
)
def related_first(spark, sf_dir):
    """SO-8: a story's own category first, then the newest; a page of the listing."""
    same = F.col("source") == "src1"
    rows = read(spark, sf_dir, "documents").orderBy(F.when(same, 0).otherwise(1), F.col("n_chars").desc(), "doc_id").limit(24)
    return rows.select("doc_id", same.alias("same"))


@query(
    "trend_list",
    "SELECT user_id, event_type, score, velocity FROM (SELECT user_id, event_type, count(*) AS score, max(value) AS velocity FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL) ORDER BY score DESC, velocity DESC, user_id, event_type LIMIT 20",
)
def trend_list(spark, sf_dir):
    """SO-6: trends of one platform and of all, best first."""
    grouped = read(spark, sf_dir, "events").filter(F.col("event_type").isin("view", "click")).groupBy("user_id", "event_type").agg(F.count("*").alias("score"), F.max("value").alias("velocity"))
    return grouped.orderBy(F.col("score").desc(), F.col("velocity").desc(), "user_id", "event_type").limit(20)
