"""Batch jobs over stored stories: what is rejected, moved, written anew or fetched again, as columns and relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import policy as P
from presslake.functions import summaries as S
from presslake.operators.terms import Dictionaries, Policy, classify, semantic_tags
from presslake.session import checkpoint, release, ship

# Categories, words, paths and states that results must agree on.
POLITICS = "السياسة"
MOVES = {
    "الاقتصاد": "ذهب|تضخم|رسوم جمركية|أسواق|أسهم",
    "البيئة والمناخ": "حريق",
    "السفر": "سياحة|سياحي",
    "الطاقة والصناعة": "النفط",
}
SPECIAL = ("الذكاء الاصطناعي", "السيارات")
NEWS_PATHS = {"وزارة الخارجية السعودية": "/ar/ministry/news/Pages/", "وزارة المالية السعودية": "/mediacenter/news/Pages/", "الهيئة العامة للإحصاء": "/ar/news/"}
IMPORTED, REVIEW, ARCHIVED = "خبر مستورد", "بحاجة إلى مراجعة", "مؤرشف"


def non_article(title: Column, url: Column, paragraphs: Column) -> Column:
    """Why a stored story is none, or null (BJ-5): a landing page, or under 100 characters of text."""
    landing = P.non_news_title(title) | P.non_news_url(url)
    return F.when(landing, "institutional_or_landing_page").when(F.length(F.trim(F.array_join(paragraphs, " "))) < 100, "missing_substantive_content")


def moved_category(category: Column, status: Column, title: Column) -> Column:
    """Political stories in review go where their title's words say, the first list that holds one (BJ-7)."""
    out = F.lit(None).cast("string")
    for name, words in reversed(MOVES.items()):
        out = F.when(title.rlike(words), name).otherwise(out)
    return F.when((category == POLITICS) & (status == "review"), F.coalesce(out, category)).otherwise(category)


def weak_summaries(df: DataFrame, title: Column, summary: Column, paragraphs: Column) -> DataFrame:
    """df with ``action`` and ``new_summary``: a weak summary is written anew from 100 or more characters of best sentences, or the story goes to review (BJ-6); action is null for a sound one."""
    weak = F.size(S.quality_reasons(summary, title)) > 0
    rows = S.summarize(df, title, S.usable_sentences(paragraphs))
    enough = (F.col("summary") != "") & (F.length(F.array_join("best", " ")) >= 100)
    action = F.when(weak & enough, "regenerated").when(weak, "sent_to_review")
    return rows.withColumn("action", action).withColumn("new_summary", F.when(F.col("action") == "regenerated", F.col("summary"))).drop("best", "summary")


def audited(old: Column, new: Column, needs_review: Column) -> Column:
    """struct<outcome, move>: what a second classification does to a published story (BJ-8, BJ-10); the move is named only if it happens (AG-16)."""
    outcome = F.when(needs_review, "sent_to_review").when(new.eqNullSafe(old), "unchanged").otherwise("reassigned")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "reassigned", F.concat(old, F.lit(" -> "), new)).alias("move"))


def reclassified(title: Column, old: Column, new: Column, score: Column, needs_review: Column) -> Column:
    """rejected without an Arabic letter in the title; moved by a score of 8 or more, or out of a special category; else kept (BJ-11)."""
    move = (new != old) & ((score >= 8) | old.isin(*SPECIAL)) & ~needs_review
    return F.when(~title.rlike(r"[\x{0600}-\x{06FF}]"), "rejected").when(move, "moved").otherwise("kept")


def backfilled_tags(df: DataFrame, tags: str, title: Column, body: Column, own: Dictionaries, everything: bool = False, **known: Column) -> DataFrame:
    """df with ``tags`` found in the texts of stories that have none (BJ-1), or of all stories (BJ-9).

    Stories that have tags don't meet the dictionaries, unless all are asked for. known: as for terms.semantic_tags().
    """
    empty = F.lit(True) if everything else F.coalesce(F.size(F.filter(tags, lambda t: F.trim(t) != "")) == 0, F.lit(True))
    given = f"{tags}_given"
    rest = df.filter(~empty)
    found = semantic_tags(df.filter(empty).withColumnRenamed(tags, given), title, body, own, **known)
    return rest.unionByName(found.select(*(F.col("tags").alias(c) if c == tags else F.col(c) for c in df.columns)))


def reclassified_pending(df: DataFrame, category: str, status: Column, at: Column, window: Column, title: Column, body: Column, policies: dict[str, Policy], **known: Column) -> DataFrame:
    """Stories of the window with ``outcome`` and ``move`` of a second classification, and its ``classification`` (BJ-8, BJ-10): pending ones get its category, those that it isn't sure of go to review.

    Only published and pending stories in the window are read through the rules. known: as for terms.classify().
    """
    some = df.filter(P.in_window(at, window) & status.isin("published", "pending", "review"))
    found = classify(some, title, body, policies, **known)
    out = audited(F.col(category), F.col("classification.category"), F.col("classification.needs_review"))
    return found.withColumn("audit_", out).select(*df.columns, "classification", "audit_.outcome", "audit_.move")


def import_state(status: Column, source: Column, url: Column, kind: Column, version: Column) -> Column:
    """The state of an old import (BJ-15): archived off its publisher's news path, back to review if it was imported before version 3."""
    paths = F.create_map(*[F.lit(x) for pair in NEWS_PATHS.items() for x in pair])
    path = F.coalesce(F.regexp_extract(url, r"(?i)^https?://[^/?#]+(/[^?#]*)?", 1), F.lit(""))
    off = F.coalesce(~path.startswith(paths[source]), F.lit(False)) & status.isin("منشور", "معتمد", ARCHIVED)
    old = status.isin("منشور", "معتمد") & (kind == IMPORTED) & (F.coalesce(version, F.lit(0)) < 3)
    return F.when(off, ARCHIVED).when(old, REVIEW).otherwise(status)


def recovery_sources(sources: DataFrame, key: str, now: Column, most: int = 2) -> DataFrame:
    """At most ``most`` sources, by key, that are neither healthy nor paused nor social and weren't looked at for 30 minutes (BJ-16).

    Columns: key, health, social, last_checked.
    """
    idle = F.col("last_checked").isNull() | (F.col("last_checked") < now - F.expr("interval 30 minutes"))
    return sources.filter(~F.col("social") & ~F.col("health").isin("Paused", "Healthy") & idle).orderBy(key).limit(most)


def unknown_records(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` that agree with no stored row in any of the keys (BJ-12, JN-18); null and empty keys agree with nothing."""
    for k in keys:
        said = stored.select(k).filter(F.coalesce(F.col(k).cast("string"), F.lit("")) != "").distinct()
        new = new.join(said, k, "left_anti").select(*new.columns)
    return new


def search(df: DataFrame, needle: str, columns: list[str], category: Column | None = None) -> DataFrame:
    """Rows that hold the needle in their joined columns, in lower case, and fit the category (BJ-19); a blank needle is held by all."""
    wanted = F.lower(F.lit(needle.strip()))
    found = F.lower(F.concat_ws(" ", *columns)).contains(wanted)
    return df.filter(found if category is None else found & category)


def first_seen(df: DataFrame, key: str, order: list[str], title: str, event: str, block_rows: int = 500_000) -> DataFrame:
    """(key, original): original is null for a story that stays, else the earlier one that stays and has its title, or else its event (BJ-4).

    A story goes only for one that stays itself, however long the chain. The rows are range-sorted into blocks, and a task
    decides a block in order, knowing the titles and events of what stays in the blocks before it, at first of none; all
    blocks are decided at once, and again until nothing changes. Rounds grow with the blocks that a chain runs through,
    at most their number, not with its length; a task holds a block's titles. Empty titles and events agree with nothing;
    keys must be different.
    """
    ship(df.sparkSession)
    at = F.struct(*[F.col(c) for c in order], F.col(key))
    said = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    slim = checkpoint(df.select(F.col(key).alias("k"), at.alias("at"), said(title).alias("t"), said(event).alias("e")))
    blocks = max(1, -(-slim.count() // block_rows))
    # numbers in the order of ``at``; a block is what shares their upper part
    rows = checkpoint(slim.repartitionByRange(blocks, "at").sortWithinPartitions("at").withColumn("n", F.monotonically_increasing_id()).drop("at"))
    block = lambda c: F.shiftright(c, 33)
    names = ["k", "t", "e", "n"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, titles, events = None, set(), set()
        for batch in batches:
            stays = []
            for i, (t, e, n, barred) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("t", "e", "n", "barred")))):
                if n >> 33 != current:
                    current, titles, events = n >> 33, set(), set()
                if barred or t in titles or e in events:
                    continue
                stays.append(i)
                titles |= {t} - {None}
                events |= {e} - {None}
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(stays, pa.int64())) for c in names], names=names)

    schema = f"k {rows.schema['k'].dataType.simpleString()}, t string, e string, n long"
    kept, before = None, None
    while True:
        barred = rows.withColumn("barred", F.lit(False))
        if kept is not None:
            first = lambda c: kept.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("n").alias(f"first_{c}"))  # noqa: B023, E731
            earlier = lambda c: F.coalesce(block(f"first_{c}") < block("n"), F.lit(False))
            barred = rows.join(first("t"), "t", "left").join(first("e"), "e", "left").withColumn("barred", earlier("t") | earlier("e"))
        dealt = barred.select(*names, "barred").repartition(blocks, block("n")).sortWithinPartitions("n")
        old, kept = kept, checkpoint(dealt.mapInArrow(decide, schema))
        if old is not None:
            release(old)
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("n") % (1 << 31))).first()
        if blocks == 1 or now == before:
            break
        before = now
    by = lambda c: kept.filter(F.col(c).isNotNull()).select(c, F.col("k").alias(f"of_{c}"), F.col("n").alias(f"n_{c}"))
    original = F.coalesce(F.when(F.col("n_t") < F.col("n"), F.col("of_t")), F.when(F.col("n_e") < F.col("n"), F.col("of_e")))
    stays = kept.select(F.col("n").alias("n_stays"))
    found = rows.join(by("t"), "t", "left").join(by("e"), "e", "left").join(stays, F.col("n") == F.col("n_stays"), "left")
    return found.select(F.col("k").alias(key), F.when(F.col("n_stays").isNull(), original).alias("original"))


def own_paragraphs(content: Column, summary: Column, least: int = 35) -> Column:
    """Paragraphs of more than ``least`` characters that aren't like the summary or an earlier paragraph: more than 0.82 of the larger one's words shared."""
    words = lambda text: F.array_distinct(F.split(C.plain_title(text), " "))
    near = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)) > 0.82
    plain = F.transform(content, lambda p: F.struct(p.alias("text"), words(p).alias("words")))
    about = words(F.coalesce(summary, F.lit("")))
    stays = lambda p, i: (F.length(p["text"]) > least) & ~near(p["words"], about) & ~F.exists(F.slice(plain, F.lit(1), i), lambda q: near(q["words"], p["words"]))
    return F.transform(F.filter(plain, stays), lambda p: p["text"])


def repair_pass(df: DataFrame, window_start: Column, fallback: str = "/api/media/fallback/", block_rows: int = 500_000) -> DataFrame:
    """Stored stories after the ordered repair pass, with ``repairs``, what was done to each, and ``original`` of duplicates (BJ-4).

    Columns: id, title, summary, url, published, content (array), normalized_title, event, category, thumbnail, lifecycle, status,
    validity. Repeated paragraphs go; an incomplete story goes to review and takes no further part; a duplicate, by title or
    else event, of an earlier one that stays is rejected; of those that stay the lifecycle follows the window, and a
    missing picture becomes the category's.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    content = F.coalesce("content", F.array().cast("array<string>"))
    incomplete = (text("title") == "") | (F.length(text("summary")) < 35) | ~C.safe_external(text("url")) | F.col("published").isNull()
    agreed = F.when(text("normalized_title") == "", C.plain_title(F.col("title"))).otherwise(F.col("normalized_title"))
    rows = df.withColumns({"cleaned_": own_paragraphs(content, F.col("summary")), "incomplete_": incomplete, "agreed_": agreed})
    sound = rows.filter(~F.col("incomplete_")).select("id", "published", "agreed_", "event")
    seen = first_seen(sound, "id", ["published"], "agreed_", "event", block_rows)
    both = rows.join(seen, "id", "left")
    duplicate = F.col("original").isNotNull()
    stays = ~F.col("incomplete_") & ~duplicate
    state = F.when(F.col("published") >= window_start, "current").otherwise("archived")
    done = C.failing(
        repeated_content=F.size("cleaned_") != F.size(content),
        incomplete_or_invalid=F.col("incomplete_"),
        duplicate_or_near_duplicate=duplicate,
        incorrect_age=stays & ~state.eqNullSafe(F.col("lifecycle")),
        missing_image=stays & (text("thumbnail") == ""),
    )
    new = {
        "content": F.col("cleaned_"),
        "status": F.when(F.col("incomplete_"), "review").when(duplicate, "rejected").otherwise(F.col("status")),
        "validity": F.when(F.col("incomplete_"), "invalid").when(duplicate, "duplicate").otherwise(F.col("validity")),
        "lifecycle": F.when(stays, state).otherwise(F.col("lifecycle")),
        "thumbnail": F.when(stays & (text("thumbnail") == ""), F.concat(F.lit(fallback), F.url_encode(text("category")))).otherwise(F.col("thumbnail")),
    }
    return both.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns), done.alias("repairs"), "original")


def articles(df: DataFrame, now: Column) -> DataFrame:
    """df with stored fields as a reader sees them (PRJ-1): ``paragraphs`` decoded and without the publisher's own, ``summary`` cleaned, ``image`` the first one said, ``badge`` only while breaking, ``priority`` the editor's, the computed one or 0.

    Columns: content (JSON or plain), summary, image_local, image_original, image_thumbnail, badge, breaking_until, override, score.
    """
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.withColumns({
        "paragraphs": F.filter(C.string_array(F.col("content")), lambda p: ~P.source_boilerplate(p)),
        "summary": P.clean_summary(F.col("summary")),
        "image": F.coalesce(said("image_local"), said("image_original"), said("image_thumbnail"), F.lit("")),
        "badge": F.when(F.col("breaking_until").isNull() | (F.col("breaking_until") > now), F.col("badge")).otherwise(""),
        "priority": F.coalesce("override", "score", F.lit(0)),
    })


def settings(own: Column, defaults: Column) -> Column:
    """A map of texts over its defaults (SC-J2), from JSON objects; one that isn't JSON changes nothing."""
    mine, base = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (own, defaults))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(mine, k)), mine)
