"""Editorial policy as column functions: what counts as news, where it belongs and how much it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslake.functions import columns as C

# Patterns, terms, weights and codes that results must agree on.
ARABIC, LATIN = "[\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF\uFB50-\uFDFF\uFE70-\uFEFF]", "[a-zA-Z]"
NON_NEWS = "(?:من نحن|عن الموقع|اتصل بنا|سياسة الخصوصية|الشروط والأحكام|الخدمات الإلكترونية|البرامج|دليل الخدمات|تسجيل الدخول)"
LANDING_TITLE = (
    r"(?iu)^(?:about(?: us| entrepreneurship)?|partnerships? with civil society organizations?|business accelerators?|rowad initiative"
    r"|(?:sdaia|saudi data\s*(?:&|and)\s*ai authority)?\s*(?:media cent(?:er|re)|news updates?|calendar\s*(?:&|and)\s*events?|pictures? library|video library|publications?|knowledge cent(?:er|re)|ai newsletter|initiatives?)"
    r"|popular topics in data and ai|sdaia role during (?:the )?covid-?19 pandemic|the year of ai"
    r"|من نحن|عن (?:الهيئة|الموقع|المركز)|المركز الإعلامي|مركز المعرفة|مكتبة (?:الصور|الفيديو)|النشرات?|المطبوعات|المنشورات|المبادرات|التقويم والفعاليات|الفعاليات|المواضيع الشائعة في البيانات والذكاء الاصطناعي)$"
)
LANDING_PATH = r"(?i)(?:^|/)(?:about(?:-us)?|contact(?:-us)?|initiatives?|publications?|newsletter|knowledge-cent(?:er|re)|pictures?-library|video-library|calendar|events?|partnerships?|accelerators?|entrepreneurship)/?$"
NAVIGATION = r"(?:الرئيسية\s*/|القائمة الرئيسية|جميع الحقوق محفوظة|تابعنا على|الأكثر قراءة)"
SUMMARY_BOILERPLATE = r"(?:صحيفة إلكترونية[^.؟!]{0,100}(?:تأسست|تم تأسيسها|تهتم بنشر)|لمشاهدة أجمل صور|زوروا\s+[«\"]?\s*إنستغرام|تابعونا على|اضغط هنا|اقرأ أيضا|اشترك في|جميع الحقوق محفوظة|سياسة الخصوصية|المزيد من الأخبار)"
SOURCE_BOILERPLATE = (
    r"(?:صحيفة إلكترونية[^.؟!]{0,120}(?:تأسست|تم تأسيسها|تهتم بنشر|تصدر|شاملة)"
    r"|(?:صحيفة|مجلة|جريدة|وكالة|منصة|شبكة)\s+(?:[^\s.،]{1,25}\s+){0,4}(?:إلكترونية|سعودية|عربية|إخبارية|شاملة|متخصصة|مستقلة|يومية)?\s*"
    r"(?:تم\s+تأسيسها|تأسست|تصدر\s+(?:عن|باللغة|يومي|أسبوعي|شهري)|تعنى\s+بـ|تعنى\s+بدعم|تهتم\s+بنشر|أسلوب\s+حياة|مرخصة|هي\s+مجلة|هي\s+صحيفة)"
    r"|مجلة الأسرة العصرية تعنى|صحيفة المرصد الكترونية|لمشاهدة أجمل صور المشاهير|زوروا\s+[«\"]?\s*(?:إنستغرام|تويتر|موقعنا|حسابنا)|تابعونا على|اشترك في\s+(?:قناة|خدمة|حساب)|حمل تطبيق|تطبيق صحيفة"
    r"|جميع الحقوق محفوظة|حقوق النشر محفوظة|للتواصل مع (?:إدارة التحرير|الصحيفة|الموقع)|رئيس التحرير\s*:|مدير التحرير\s*:)"
)
NOT_SOURCES = ("example.com", "news.google.com")
REGIONS = {
    "الرياض": ["الرياض", "الدرعيه", "الخرج", "الدوادمي", "المجمعه"],
    "مكة المكرمة": ["مكه", "جده", "الطايف", "القنفذه", "رابغ"],
    "المدينة المنورة": ["المدينه المنوره", "ينبع", "العلا"],
    "المنطقة الشرقية": ["الشرقيه", "الدمام", "الخبر", "الظهران", "الاحساء", "الجبيل", "القطيف"],
    "القصيم": ["القصيم", "بريده", "عنيزه"],
    "عسير": ["عسير", "ابها", "خميس مشيط", "بيشه"],
    "تبوك": ["تبوك", "ضباء", "املج"],
    "حائل": ["حايل"],
    "الحدود الشمالية": ["الحدود الشماليه", "عرعر", "رفحاء"],
    "جازان": ["جازان", "صبيا"],
    "نجران": ["نجران"],
    "الباحة": ["الباحه", "بلجرشي"],
    "الجوف": ["الجوف", "سكاكا", "دومه الجندل"],
}
NATIONAL = "(?:خادم الحرمين|ولي العهد|امر ملكي|اوامر ملكيه|مجلس الوزراء|رؤيه 2030|المملكه العربيه السعوديه|وزاره الداخليه|وزاره الخارجيه|الديوان الملكي|السعوديه|المملكه)"
GULF_ARAB = "(?:الامارات|الكويت|البحرين|قطر|عمان|الخليج|مصر|الاردن|العراق|لبنان|سوريا|فلسطين|المغرب|الجزائر|تونس|السودان|اليمن)"
HIGH_IMPACT = "(?:امر ملكي|قرار مجلس الوزراء|حاله طوارئ|كارثه|زلزال|سيول|حرب|هجوم|وقف اطلاق النار|وفاه|تعليق الدراسه|تغيير رسوم|رفع اسعار|خفض اسعار|وظايف|رواتب|معاشات|دعم|علاج|وباء)"
SOME_IMPACT = "(?:الصحه|التعليم|الامن|النقل|الاقتصاد|الطاقه|الرياضه)"
OFFICIAL = "(?:وزاره|هيئه|الديوان الملكي|مجلس الوزراء|اماره|محافظه|جامعه حكوميه|المركز الوطني|النيابه العامه)"
OFFICIAL_DOMAIN = r"(?i)(?:gov\.sa|spa\.gov\.sa)$"
NEARNESS = {"saudi_national": 1.0, "saudi_region": 0.9, "gulf_arab": 0.45, "international": 0.15}
LEVELS = [(82, "أولوية قصوى"), (62, "مهم"), (28, "عادي")]
LOWEST, BREAKING_LEVEL = "منخفض الأولوية", "عاجل"
REMOVED = r"(?iu)(?:404|410|page\s+not\s+found|content\s+(?:was\s+)?removed|article\s+(?:was\s+)?removed|الصفحة\s+غير\s+موجودة|الصفحة\s+المطلوبة\s+غير\s+موجودة|تم\s+حذف\s+(?:الخبر|المحتوى)|هذا\s+الخبر\s+غير\s+متاح)"
BREAKING = "(?iu)^(?:عاجل|أخبار عاجلة|الأخبار العاجلة|breaking|breaking news|urgent)$"
BREAKING_FLAG = "(?i)^(?:true|1|breaking|urgent)$"
BREAKING_PREFIX = r"(?iu)^\s*(?:عاجل|breaking(?:\s+news)?)\s*[:：|\-–—]\s*"


def joined(text: Column) -> Column:
    """White space joined and trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bare(text: Column) -> Column:
    """Markup dropped, white space joined."""
    return joined(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " "))


def source_boilerplate(text: Column) -> Column:
    """Whether a text of 15 characters or more speaks about its publisher (FLT-15)."""
    return (F.length(F.trim(text)) >= 15) & F.trim(text).rlike(SOURCE_BOILERPLATE)


def clean_summary(text: Column) -> Column:
    """The summary without the first passage about its publisher (TX-12)."""
    at, passage = F.regexp_instr(text, F.lit(SOURCE_BOILERPLATE)), F.regexp_extract(text, SOURCE_BOILERPLATE, 0)
    without = F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.length(passage), F.length(text)))
    return joined(F.when(at > 0, without).otherwise(text))


def non_news_title(title: Column) -> Column:
    """A title of a service page or a landing page (FLT-14)."""
    return title.rlike(NON_NEWS) | joined(title).rlike(LANDING_TITLE)


def non_news_url(url: Column) -> Column:
    """A landing page's path; what isn't a URL is no news either (FLT-14)."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")).isNull() | F.coalesce(path, F.lit("")).rlike(LANDING_PATH), F.lit(True))


def letters(text: Column, script: str) -> Column:
    return F.regexp_count(text, F.lit(script))


def arabic_article(title: Column, body: Column) -> Column:
    """Title and body (an array of paragraphs) are in Arabic: 6 letters, 35 letters, and more than Latin ones (FLT-17)."""
    text = F.array_join(body, " ")
    in_title, in_body = letters(title, ARABIC), letters(text, ARABIC)
    return (in_title >= 6) & (in_title >= letters(title, LATIN)) & (in_body >= 35) & (in_body >= letters(text, LATIN) * 1.2)


def similarity(a: Column, b: Column) -> Column:
    """Token similarity of two normalized texts."""
    return C.token_similarity(C.tokens(a), C.tokens(b))


def clean_paragraphs(values: Column, title: Column, summary: Column, most: int = 12) -> Column:
    """Paragraphs of more than 35 characters that are Arabic prose, don't repeat title or summary, and aren't like an earlier one (TX-11)."""
    prose = lambda x: (F.length(x) > 35) & ~x.rlike(NAVIGATION) & ~x.rlike(SUMMARY_BOILERPLATE) & ~source_boilerplate(x) & C.script_majority(x, ARABIC, LATIN, 10)
    pairs = F.transform(F.filter(F.transform(values, joined), prose), lambda x: F.struct(x.alias("text"), C.normalized(x).alias("plain")))
    references = F.filter(F.array(C.normalized(title), C.normalized(summary)), lambda r: r != "")

    def stays(x: Column, i: Column) -> Column:
        repeats = F.exists(references, lambda r: similarity(x["plain"], r) > 0.78)
        return ~repeats & ~F.exists(F.slice(pairs, 1, i), lambda y: similarity(y["plain"], x["plain"]) > 0.9)

    return F.slice(F.transform(F.filter(pairs, stays), lambda x: x["text"]), 1, most)


def first_domain(*names: Column) -> Column:
    """The first name that isn't empty, as a host without www."""
    own = F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names], F.lit(""))
    return F.regexp_replace(F.when(own.contains("://"), C.host(own)).otherwise(F.lower(own)), r"^www\.", "")


def approved_source(status: Column, health: Column, domain: Column) -> Column:
    """An active source that isn't paused and whose domain counts (FLT-11)."""
    return (status == "active") & (F.coalesce(health, F.lit("")) != "Paused") & (domain != "") & ~domain.isin(*NOT_SOURCES)


def owns_url(domain: Column, url: Column) -> Column:
    return C.safe_external(url) & C.domains_match(C.host(url), domain)


def validate(title: Column, url: Column, canonical: Column, published: Column, paragraphs: Column, approved: Column, domain: Column, language: Column, excluded: Column, now: Column, freshness_hours: int) -> Column:
    """Codes of all rules that an article fails, in order (FLT-18); an excluded keyword gives its code each time."""
    body = clean_paragraphs(paragraphs, title, F.lit(""))
    length = F.length(F.array_join(body, " "))
    plain_body, own_title = C.normalized(F.array_join(body, " ")), C.normalized(title)
    words = F.array_distinct(F.split(own_title, r"\s+"))
    found = F.size(F.filter(words, lambda w: plain_body.contains(w)))
    age = F.unix_micros(now) - F.unix_micros(published)
    rules = C.failing(
        source_not_approved_or_active=~approved,
        source_domain_mismatch=~owns_url(domain, url) | ~owns_url(domain, canonical),
        non_arabic_source_language=(F.coalesce(language, F.lit("")) != "") & ~F.lower(language).startswith("ar"),
        headline_too_short=F.length(F.trim(title)) < 12,
        institutional_or_service_page=non_news_title(title) | non_news_url(url) | url.rlike(NON_NEWS),
        invalid_source_url=~C.safe_external(url) | ~C.safe_external(canonical),
        non_arabic_content=~arabic_article(title, body),
        insufficient_article_body=(length < 220) | (F.size(body) < 2) & (length < 360),
        publication_date_could_not_be_parsed=published.isNull(),
        publication_date_in_future=age < -15 * 60_000_000,
        outside_freshness_window=age > freshness_hours * 3_600_000_000,
        headline_body_mismatch=(F.size(words) > 3) & (found < 2),
    )
    text = F.concat_ws(" ", own_title, plain_body)
    return F.concat(rules, F.transform(F.filter(excluded, lambda k: text.contains(C.normalized(k))), lambda k: F.lit("excluded_keyword")))


def geography(title: Column, body: Column, country: Column, region: Column) -> Column:
    """struct<relevance, region>: the first region named, else national, Gulf and Arab terms, else what the source says (MA-5)."""
    return place_of(C.normalized(F.concat_ws(" ", title, body)), country, region)


def place_of(text: Column, country: Column, region: Column) -> Column:
    """geography() of normalized text; every step reads ``text``, which is best held in a column."""
    place = lambda relevance, name: F.struct(F.lit(relevance).alias("relevance"), name.alias("region"))
    ladder = None
    for name, terms in REGIONS.items():
        named = text.rlike("(?:" + "|".join(terms) + ")")
        ladder = F.when(named, place("saudi_region", F.lit(name))) if ladder is None else ladder.when(named, place("saudi_region", F.lit(name)))
    own = F.coalesce(region, F.lit(""))
    saudi = F.trim(F.coalesce(country, F.lit(""))).rlike("(?iu)^(?:sa|saudi arabia|السعوديه)$")
    ladder = ladder.when(text.rlike(NATIONAL), place("saudi_national", F.lit(""))).when(text.rlike(GULF_ARAB), place("gulf_arab", F.lit("")))
    return ladder.when(own != "", place("saudi_region", own)).when(saudi, place("saudi_national", F.lit(""))).otherwise(place("international", F.lit("")))


def priority(text: Column, relevance: Column, age: Column, reliability: Column, rank: Column, domain: Column, breaking: Column, supporting: Column, category_weight: Column, weights: dict[str, float], homepage_hours: int) -> Column:
    """struct<score, level>: eight weighted terms, 0 to 100 (MA-4). ``text`` is normalized; ``age`` in hours, ``rank`` is the source's own priority.

    weights: recency, saudi, breaking, source, impact, official, corroboration.
    """
    recency = F.greatest(F.lit(0.0), 1 - age / max(24, homepage_hours))
    near = F.coalesce(F.create_map(*[F.lit(x) for pair in NEARNESS.items() for x in pair])[relevance], F.lit(NEARNESS["international"]))
    quality = F.least(F.lit(1.0), F.greatest(F.lit(0.0), reliability / 100)) * 0.75 + F.greatest(F.lit(0.0), 1 - (rank - 1) / 20) * 0.25
    official = (text.rlike(OFFICIAL) | domain.rlike(OFFICIAL_DOMAIN)).cast("double")
    impact = F.when(text.rlike(HIGH_IMPACT), 1.0).when(text.rlike(SOME_IMPACT), 0.6).otherwise(0.3)
    corroboration = F.least(F.lit(1.0), F.coalesce(supporting, F.lit(0)) / 3)
    terms = [(recency, "recency"), (near, "saudi"), (breaking.cast("double"), "breaking"), (quality, "source"), (impact, "impact"), (official, "official"), (corroboration, "corroboration")]
    total = F.coalesce(category_weight, F.lit(0.0))
    for value, name in terms:
        total = total + value * float(weights[name])
    score = F.greatest(F.lit(0), F.least(F.lit(100), C.half_up(total))).cast("int")
    level = F.when(breaking, BREAKING_LEVEL)
    for least, name in LEVELS:
        level = level.when(score >= least, name)
    return F.struct(score.alias("score"), level.otherwise(LOWEST).alias("level"))


def reports_removal(html: Column) -> Column:
    """Whether title, h1 or main say that the page is gone (TX-31)."""
    title = bare(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    marker = bare(F.regexp_extract(html, r"(?is)<(?:h1|main)[^>]*>(.{0,700}?)</(?:h1|main)>", 1))
    return F.concat_ws(" ", title, marker).rlike(REMOVED)


def page_status(code: Column, html: Column, original: Column, final: Column, etag: Column, before_etag: Column, modified: Column, before_modified: Column, network_error: Column) -> Column:
    """struct<status, reason, changed> of an observed page (MA-8)."""
    said = lambda c: F.coalesce(c, F.lit("")) != ""
    changed = (said(etag) & said(before_etag) & (etag != before_etag)) | (said(modified) & said(before_modified) & (modified != before_modified))
    changed = F.coalesce(changed, F.lit(False))
    moved = said(final) & said(original) & F.coalesce(final != original, F.lit(False))
    n = F.coalesce(code, F.lit(0))
    as_text = n.cast("string")
    out = lambda status, reason, flag=F.lit(False): F.struct(F.lit(status).alias("status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"), flag.alias("changed"))
    return (
        F.when(said(network_error), out("Temporarily Unreachable", F.concat(F.lit("temporary_network_error: "), network_error)))
        .when(n.isin(404, 410), out("Removed", F.concat(F.lit("source_confirmed_removed_http_"), as_text)))
        .when((n == 429) | (n >= 500), out("Temporarily Unreachable", F.concat(F.lit("temporary_http_"), as_text)))
        .when((n >= 400) & (n < 500), out("Unavailable", F.concat(F.lit("source_access_unavailable_http_"), as_text)))
        .when((n < 200) | (n >= 400), out("Temporarily Unreachable", F.concat(F.lit("unexpected_http_"), F.when(n == 0, "none").otherwise(as_text))))
        .when(reports_removal(F.coalesce(html, F.lit(""))), out("Removed", "source_page_explicitly_reports_removal"))
        .when(changed, out("Updated", "source_content_changed", F.lit(True)))
        .when(moved, out("Redirected", "source_redirect_followed"))
        .otherwise(out("Active", "source_article_available"))
    )


def breaking_label(value: Column) -> Column:
    """Whether a label, without markup, says breaking (FLT-22)."""
    return bare(value).rlike(BREAKING)


def breaking_flag(value: Column) -> Column:
    """Whether a flag's text says breaking (FLT-22)."""
    return bare(value.cast("string")).rlike(BREAKING_FLAG)


def breaking_title(title: Column, verified: Column) -> Column:
    """The title without its breaking prefix, if verified and if anything is left (TX-27)."""
    without = F.trim(F.regexp_replace(title, BREAKING_PREFIX, ""))
    return F.when(verified & (without != ""), without).otherwise(F.trim(title))


def active_window(now: Column, zone: str, days: int = 7) -> Column:
    """struct<start, end, next_archive>: from the local midnight days - 1 ago till now, and the next local midnight (DT-2). ``now`` is a timestamp in a UTC session."""
    today = F.to_date(F.from_utc_timestamp(now, zone))
    return F.struct(C.zoned_midnight(F.date_sub(today, days - 1), zone).alias("start"), now.alias("end"), C.zoned_midnight(F.date_add(today, 1), zone).alias("next_archive"))


def in_window(at: Column, window: Column) -> Column:
    """Inclusive at both ends (DT-4); a missing time is outside."""
    return F.coalesce((at >= window["start"]) & (at <= window["end"]), F.lit(False))


def hashtag_text(tag: Column) -> Column:
    """A hashtag as words: no sign, underscores as spaces (TX-23)."""
    return joined(F.replace(F.regexp_replace(tag, "^[#＃]+", ""), F.lit("_"), F.lit(" ")))


def without_article(word: Column) -> Column:
    """An Arabic word of more than three letters without its definite article (TX-26)."""
    return F.when((F.length(word) > 3) & word.startswith("ال"), F.substring(word, F.lit(3), F.length(word))).otherwise(word)
