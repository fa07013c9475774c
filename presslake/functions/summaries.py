"""Summaries, near texts and publishability, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import markup as M
from presslake.functions import policy as P

# Patterns, words and weights that results must agree on.
VAGUE = "^(?:في عالم|في كرة القدم|في أسبوع|نعيش على|لا يبدو أن|عندما يصير|لطالما كان|منذ فجر التاريخ)"
REPORTING = "(?:أعلن|أكد|أوضح|أفاد|كشف|سجل|ارتفع|انخفض|أطلق|دشن|قرر|وقع|حقق|حذر|توقع|أسفر|يشمل|يتضمن|بسبب|بعد|خلال)"
STOP_WORDS = ["في", "من", "إلى", "الى", "على", "عن", "مع", "أن", "ان", "إن", "ما", "هو", "هي", "هذا", "هذه", "ذلك", "تلك", "بعد", "قبل", "عبر", "لدى", "بين", "خلال", "ضمن", "كما", "قد"]
CATEGORY_RANK = {"رسمي": 10, "السياسة": 9, "الاقتصاد": 8, "المجتمع": 7, "التقنية": 7, "الذكاء الاصطناعي": 7, "الصحة والجمال": 6, "التعليم": 6, "الرياضة": 5, "الثقافة": 4, "السفر": 3}


def quality_reasons(summary: Column, title: Column) -> Column:
    """Why a summary is weak, in order; empty if it isn't (TX-16)."""
    value = P.joined(summary)
    plain, head = C.normalized(value), C.normalized(title)
    return C.failing(
        summary_too_short=F.length(value) < 70,
        summary_too_long=F.length(value) > 420,
        summary_lacks_information=F.size(C.tokens(plain)) < 10,
        summary_repeats_headline=(P.similarity(plain, head) > 0.82) | (plain == head),
        summary_contains_boilerplate=value.rlike(P.SUMMARY_BOILERPLATE),
        summary_is_vague=value.rlike(VAGUE) & (F.length(value) < 130),
    )


def sentence_score(sentence: Column, near: Column, index: Column) -> Column:
    """How well a sentence stands for its article, by place, length, nearness to the title, verbs and figures (TX-14)."""
    n = F.length(sentence)
    place = F.greatest(F.lit(0.0), F.lit(5.0) - index * 0.35)
    size = F.when(n.between(80, 220), 4).when(n >= 60, 2).otherwise(0)
    points = lambda holds, worth: F.when(holds, worth).otherwise(0)
    score = place + size + points(near.between(0.08, 0.7), 4) + points(sentence.rlike(REPORTING), 2) + points(sentence.rlike("[0-9٠-٩]"), 1) - points(sentence.rlike(VAGUE), 5)
    return F.when(sentence.rlike(P.SUMMARY_BOILERPLATE), -100.0).when(near > 0.82, -50.0).otherwise(score)


def capped(text: Column) -> Column:
    """A text of at most 360 characters, cut at its last space or comma if that is beyond the 220th (TX-15)."""
    head = F.substring(text, 1, 357)
    boundary = F.length(F.regexp_extract(head, "(?s)^(.*)[ ،]", 1))
    return F.when(F.length(text) <= 360, text).otherwise(F.concat(F.trim(F.when(boundary > 220, F.substring(head, F.lit(1), boundary)).otherwise(head)), F.lit("…")))


def best_sentences(df: DataFrame, title: Column, sentences: Column) -> DataFrame:
    """df with ``best``: the one or two best sentences in their own order (TX-15); none like a better one, the second only while the first has under 150 characters.

    Each step is a column of its own, so that sentences are split, folded and scored once.
    """
    names = ["step_title", "step_words", "step_ranked", "step_first"]
    if clash := {*names, "best"} & set(df.columns):
        raise ValueError(f"the table has columns {sorted(clash)}")
    words = lambda text: C.tokens(C.normalized(text))
    own = df.withColumn("step_title", words(title)).withColumn("step_words", F.transform(sentences, lambda s, i: F.struct(i.alias("i"), s.alias("s"), words(s).alias("words"))))
    near = lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"), x["words"].alias("words"), C.token_similarity(x["words"], F.col("step_title")).alias("near"))
    score = lambda x: F.struct((-sentence_score(x["s"], x["near"], x["i"])).alias("below"), x["i"].alias("i"), x["s"].alias("s"), x["words"].alias("words"))
    ranked = own.withColumn("step_ranked", F.array_sort(F.filter(F.transform(F.transform("step_words", near), score), lambda x: x["below"] < 0))).withColumn("step_first", F.get("step_ranked", 0))
    first = F.col("step_first")
    second = F.when(F.length(first["s"]) < 150, F.get(F.filter("step_ranked", lambda x: (x["i"] != first["i"]) & (C.token_similarity(x["words"], first["words"]) <= 0.68)), 0))
    both = F.filter(F.array(first, second), lambda x: x.isNotNull())
    return ranked.withColumn("best", F.transform(F.array_sort(F.transform(both, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"])).drop(*names)


def usable_sentences(paragraphs: Column) -> Column:
    """Sentences of more than 45 characters that don't speak about the publisher."""
    split = F.flatten(F.transform(paragraphs, lambda p: F.transform(C.sentences(p), P.joined)))
    return F.filter(split, lambda s: (F.length(s) > 45) & ~s.rlike(P.SUMMARY_BOILERPLATE) & ~P.source_boilerplate(s))


def summarize(df: DataFrame, title: Column, sentences: Column) -> DataFrame:
    """df with ``best`` and ``summary``, the best sentences as one text (TX-15)."""
    return best_sentences(df, title, sentences).withColumn("summary", capped(F.array_join("best", " ")))


def shingle_duplicate(a: Column, b: Column, least: float = 0.7) -> Column:
    """struct<duplicate, similarity>: by Jaccard of word pairs, which is rounded only for show (TX-8)."""
    near = C.jaccard(C.shingles(F.split(C.normalized(a), " ")), C.shingles(F.split(C.normalized(b), " ")))
    return C.once(near, lambda n: F.struct((n >= least).alias("duplicate"), C.half_up(n, 2).alias("similarity")))


def editorial_clean(text: Column) -> Column:
    """Repeated words, loose marks and quotes without a partner put right (TX-33), without the list of phrases."""
    out = F.regexp_replace(F.regexp_replace(text, r"<!\[CDATA\[|\]\]>", ""), "<[^>]+>", " ")
    out = F.regexp_replace(out, "(?i)&nbsp;|&#160;", " ")
    for name, sign in (("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        out = F.regexp_replace(out, f"(?i){name}", sign)
    out = F.regexp_replace(out, r"(?iu)(?<![\p{L}\p{N}])([\p{L}\p{N}]{3,})(?:\s+\1)+(?![\p{L}\p{N}])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"([(\[«“])\s+", "$1"), r"\s+([)\]»”])", "$1")
    out = P.joined(F.regexp_replace(F.regexp_replace(out, r"\s+([،؛:.!؟])", "$1"), r"([،؛:.!؟]){2,}", "$1"))
    for opened, closed in ("«»", "“”"):
        uneven = F.regexp_count(out, F.lit(opened)) != F.regexp_count(out, F.lit(closed))
        out = F.when(uneven, F.regexp_replace(out, f"[{opened}{closed}]", "")).otherwise(out)
    return F.when(F.regexp_count(out, F.lit('"')) % 2 == 1, F.replace(out, F.lit('"'), F.lit(""))).otherwise(out)


def comparison_words(text: Column) -> Column:
    """Words by which near texts are told: marks and articles dropped, no stop words (TX-32); compatibility forms aren't folded."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(editorial_clean(text)), C.ARABIC_MARKS, ""), r"[^\p{L}\p{N}\s]", " ")
    words = F.transform(F.split(F.trim(plain), r"\s+"), lambda w: F.regexp_replace(w, "^ال(?=.{3})", ""))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def near_texts(a: Column, b: Column) -> Column:
    """Equal, one within the other at 0.68 of its length or more, or 0.76 of the larger one's words shared (TX-32)."""
    x, y = comparison_words(a), comparison_words(b)
    p, q = F.array_join(x, " "), F.array_join(y, " ")
    ratio = F.least(F.length(p), F.length(q)) / F.greatest(F.length(p), F.length(q))
    shared = C.token_similarity(F.array_distinct(x), F.array_distinct(y))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((p == q) | ((ratio >= 0.68) & (p.contains(q) | q.contains(p))) | (shared >= 0.76))


def verbatim(values: Column, source: Column) -> Column:
    """Whether any value of 45 or more normalized characters stands in the source's text (FLT-29)."""
    own = C.normalized(source)
    return F.exists(F.transform(values, C.normalized), lambda v: (F.length(v) >= 45) & own.contains(v))


def publishability(title: Column, summary: Column, category: Column, url: Column, imported: Column, version: Column, verified: Column, errors: Column) -> Column:
    """Why a record can't be published, in order (FLT-27)."""
    text, head, own = (F.trim(F.coalesce(c, F.lit(""))) for c in (summary, title, category))
    unsound = (F.coalesce(version, F.lit(0)) < 3) | ~F.coalesce(verified, F.lit(False)) | (F.size(F.coalesce(errors, F.array().cast("array<string>"))) > 0)
    return C.failing(**{
        "Missing required content: headline": F.length(head) < 15,
        "Missing required content: meaningful non-duplicate summary": (F.length(text) < 35) | near_texts(head, text),
        "Missing category mapping": (own == "") | (own == "غير محدد"),
        "Missing required content: valid external source URL": ~C.safe_external(F.coalesce(url, F.lit(""))),
        "Retrieved item did not pass validation": F.coalesce(imported, F.lit(False)) & unsound,
    })


def completeness(*fields: Column) -> Column:
    """How many fields hold anything (FLT-27)."""
    out = F.lit(0)
    for f in fields:
        out = out + F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0)
    return out


def homepage_rank(age_days: Column, importance: Column, trust: Column, featured: Column, category: Column, complete: Column) -> Column:
    """A story's place on the home page, as one number (SO-11)."""
    bounded = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)), F.lit(100))
    ranks = F.create_map(*[F.lit(x) for pair in CATEGORY_RANK.items() for x in pair])
    own = F.coalesce(ranks[F.trim(F.split(F.coalesce(category, F.lit("")), "[،,]")[0])], F.lit(1))
    recency = F.greatest(F.lit(0.0), 100 - F.least(F.greatest(age_days, F.lit(0.0)), F.lit(100.0)))
    return recency * 5 + bounded(importance) * 3 + bounded(trust) * 2 + F.when(featured, 25).otherwise(0) + own * 2 + complete


def social_engagement(platform: Column, reposts: Column, likes: Column, replies: Column, views: Column) -> Column:
    """Weighted reactions of a post, rounded (MA-3): x counts reposts, the others replies."""
    on_x = reposts * 2.0 + likes * 0.5 + replies * 1.0 + views * 0.05
    return C.half_up(F.when(platform == "x", on_x).otherwise(replies * 2.0 + likes * 0.5 + views * 0.1))


def social_media(kind: Column, urls: Column, video: Column, content: Column, mime: Column) -> Column:
    """What a post is shown as: its video if it plays, else a picture, else its text of 25 characters or more, else null (CQ-11)."""
    target = M.first_said(video, F.get(urls, 0))
    fallback = F.when(F.exists(urls, M.is_image), F.lit("image")).when(F.length(F.trim(content)) >= 25, F.lit("text"))
    return F.when(F.coalesce(kind, F.lit("text")) != "video", F.coalesce(kind, F.lit("text"))).when(M.video_playable(target, mime), F.lit("video")).otherwise(fallback)


def social_posts(df: DataFrame) -> DataFrame:
    """Posts in Arabic that don't speak about their publisher, media downgraded, tags and score added (CQ-11).

    Columns: platform, content, media_type, media_urls, video_url, mime, hashtags, likes, reposts, replies, views;
    missing counts are 0, missing hashtags are read from the content.
    """
    count = lambda name: F.coalesce(F.col(name), F.lit(0))
    fit = df.filter(C.script_majority(F.col("content"), P.ARABIC, P.LATIN, 6) & ~P.source_boilerplate(F.col("content")))
    urls = F.coalesce(F.col("media_urls"), F.array().cast("array<string>"))
    shown = fit.withColumn("media_type", social_media(F.col("media_type"), urls, F.col("video_url"), F.col("content"), F.col("mime"))).filter("media_type is not null")
    tags = F.when(F.size(F.coalesce(F.col("hashtags"), F.array().cast("array<string>"))) > 0, F.col("hashtags")).otherwise(C.hashtags(F.col("content")))
    return shown.withColumn("hashtags", tags).withColumn("engagement", social_engagement(F.col("platform"), count("reposts"), count("likes"), count("replies"), count("views")))


#: Names in quotes or after a word for a body (fixed value).
ENTITY = r"""[«"]([^»"]{2,80})[»"]|(?:شركة|وزارة|هيئة|جامعة|مؤسسة|مركز|مدينة|محافظة|دولة)\s+[\p{L}\p{N}][\p{L}\p{N}\s-]{2,60}"""


def entities(text: Column, most: int = 15) -> Column:
    """The first different names of under 90 characters that a text quotes or introduces (TX-37)."""
    found = lambda group: F.regexp_extract_all(text, F.lit(ENTITY), F.lit(group))
    names = F.transform(F.arrays_zip(found(1).alias("a"), found(0).alias("b")), lambda x: F.trim(F.coalesce(F.nullif(x["a"], F.lit("")), x["b"])))
    return F.slice(F.array_distinct(F.filter(names, lambda n: F.length(n) < 90)), 1, most)


def clip(text: Column, limit: int) -> Column:
    """A text of at most ``limit`` characters, cut at the last sentence, comma or word if that leaves more than 0.55 of it (TX-39)."""
    part = F.substring(text, 1, limit - 1)
    before = F.regexp_extract(part, r"(?s)^(.*)(?:\. |؟|\.\n|،| )", 1)
    cut = F.when(F.length(before) > limit * 0.55, before).otherwise(part)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"^\s+|\s+$", ""), F.lit("…")))


def title_fits(title: Column, body: Column) -> Column:
    """Whether a body speaks of its title: two of the title's words, or all of fewer, or 0.45 of them (FLT-28)."""
    head = F.array_distinct(comparison_words(title))
    shared = F.size(F.array_intersect(head, comparison_words(body)))
    return (shared >= F.least(F.lit(2), F.size(head))) | (shared / F.greatest(F.size(head), F.lit(1)) >= 0.45)
