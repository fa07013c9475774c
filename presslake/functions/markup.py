"""What markup says, as column functions: elements, attributes, links, pictures and dates of pages and feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.functions import policy as P

# Entities, extensions, paths and hosts that results must agree on.
ENTITIES = {"&amp;": "&", "&quot;": '"', "&#39;": "'"}
FILES = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|pdf|zip)(?:\?|$)"
SERVICE_PATH = r"(?i)(?:login|signin|privacy|terms|contact|about|services?|programs?|search|category|tags?|communicate-ministry|knowledge-centre/initiatives|page/(?:srpc|srmg))(?:/|$)"
STORY_PATH = r"(?i)(?:news|article|story|details?|press|media-center|الأخبار|خبر|/20\d{2}/|/\d{4,}/)"
IMAGE_FILE = r"(?i)\.(?:jpe?g|png|webp|gif|svg|avif)(?:\?.*)?$"
IMAGE_HOSTS = ("images.unsplash.com", "cdn-cgi/image")
VIDEO_HOSTS = ("vjs.zencdn.net", "interactive-examples.mdn.mozilla.net", "media.w3.org", "cdn.sabq.org", "video.twimg.com", "instagram.com")
VIDEO_TYPES = ("video/mp4", "video/webm", "video/ogg", "video/quicktime", "video/x-m4v", "application/x-mpegurl", "application/vnd.apple.mpegurl")
NOT_EDITORIAL = r"(?iu)(?:^|[/_.,?=&%\s-])(?:logo|favicon|icon|banner|advert|sprite|placeholder|default|social[ _-]?share|share[ _-]?image|no[ _-]?image|tracking|pixel|spacer|شعار|أيقونة|ايقونة|افتراضي|صورة افتراضية)(?:$|[/_.,?=&%\s-])"
PORTRAIT = r"(?iu)(?:^|[/_.,?=&%\s-])(?:avatar|author|authors|profile)(?:$|[/_.,?=&%\s-])"
VISIBLE_DATES = (
    r"(\d{1,2}[-/.\s](?:يناير|فبراير|مارس|أبريل|ابريل|مايو|يونيو|يوليو|أغسطس|اغسطس|سبتمبر|أكتوبر|اكتوبر|نوفمبر|ديسمبر|\d{1,2})[-/.\s]20\d{2}(?:[ T\s]+\d{1,2}:\d{2})?)",
    r"(20\d{2}[-/.]\d{1,2}[-/.]\d{1,2}(?:[ T\s–—-]+\d{1,2}:\d{2}(?::\d{2})?)?)",
)
DIRECTION_MARKS = r"[\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"


def first_said(*values: Column) -> Column:
    """The first value that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def decode(text: Column) -> Column:
    """Text without character-data marks and elements, common entities read, white space joined (TX-19); null is empty."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<!\[CDATA\[|\]\]>", ""), "<[^>]+>", " ")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return P.joined(out)


def element(markup: Column, name: str) -> Column:
    """Inside of the first element of this name, empty if there is none (TX-20)."""
    return F.coalesce(F.regexp_extract(markup, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1), F.lit(""))


def attribute(markup: Column, name: str) -> Column:
    """The first quoted value of an attribute that isn't empty (TX-20)."""
    return F.coalesce(F.regexp_extract(markup, rf"""(?i)\b{name}=["']([^"']+)["']""", 1), F.lit(""))


def meta(html: Column, key: str) -> Column:
    """Content of the first meta element whose property, name or itemprop is ``key`` (TX-20)."""
    named = lambda e: F.lower(first_said(attribute(e, "property"), attribute(e, "name"), attribute(e, "itemprop"))) == key.lower()
    return decode(attribute(F.get(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1)), named), 0), "content"))


def raw_value(html: Column, *keys: str) -> Column:
    """The first of these keys' quoted values in scripts, up to a quote or an escape (TX-20)."""
    return first_said(*[F.regexp_extract(html, rf"""(?i){key}\\?["']?\s*:\s*\\?["']([^"\\]+)""", 1) for key in keys])


def absolute_url(value: Column, base: Column) -> Column:
    """A reference as seen from a page: decoded, dot segments resolved, host in lower case; empty where it leads to no host (TX-21)."""
    given = decode(value)
    part = lambda text, i: F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", i)
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_extract(part(base, 3), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when(given.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), given)
        .when(given.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(""))
        .when(given.startswith("//"), F.concat(part(base, 1), F.lit(":"), given))
        .when(given.startswith("/"), F.concat(origin, given))
        .when(given == "", F.concat(origin, part(base, 3), part(base, 4)))
        .when(given.startswith("?"), F.concat(origin, part(base, 3), given))
        .when(given.startswith("#"), F.concat(origin, part(base, 3), part(base, 4), given))
        .otherwise(F.concat(origin, folder, given))
    )
    steps = F.slice(F.split(part(whole, 3), "/"), 2, 1 << 30)

    def step(done: Column, s: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(s == "..", shorter).when(s == ".", done).otherwise(F.array_append(done, s))

    last = F.element_at(F.split(part(whole, 3), "/"), -1)
    path = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), step), "/")
    path = F.concat(F.lit("/"), path, F.when(last.isin(".", "..") & (path != ""), "/").otherwise(""))
    out = F.concat(F.lower(part(whole, 1)), F.lit("://"), F.lower(part(whole, 2)), path, part(whole, 4), part(whole, 5))
    return F.when((part(whole, 2) != "") & F.coalesce(part(base, 2) != "", F.lit(False)), out).otherwise("")


def same_site(a: Column, b: Column) -> Column:
    """Equal hosts, a leading www. aside (TX-21)."""
    x, y = (F.regexp_replace(C.host(c), r"^www\.", "") for c in (a, b))
    return F.coalesce((x != "") & (x == y), F.lit(False))


def article_like(url: Column, title: Column) -> Column:
    """A link that leads to a story: a page, not a service, with a title of 12 characters or more (FLT-19)."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    news = ~P.non_news_title(title) & ~P.non_news_url(url) & ~path.rlike(SERVICE_PATH)
    return C.safe_external(url) & ~url.rlike(FILES) & news & path.rlike(STORY_PATH) & (F.length(title) >= 12)


def slug_title(url: Column, otherwise: Column) -> Column:
    """The last part of a URL's path as words (SRC-5)."""
    parts = F.filter(F.split(F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))), "/"), lambda p: p != "")
    return F.coalesce(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "[-_]+", " "), otherwise)


def slug(text: Column, prefix: str = "") -> Column:
    """A URL's last part from normalized words (TX-24)."""
    return F.concat(F.lit(prefix), F.url_encode(F.regexp_replace(F.trim(text), r"\s+", "-")))


def best_of_srcset(value: Column) -> Column:
    """The picture of the largest number in a srcset, the first of equal ones (TX-28)."""
    words = F.transform(F.split(value, ","), lambda p: F.split(F.trim(p), r"\s+"))
    number = lambda w: F.coalesce(F.regexp_extract(F.get(w, 1), r"^([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    choices = F.filter(F.transform(words, lambda w, i: F.struct(number(w).alias("weight"), (-i).alias("place"), F.get(w, 0).alias("url"))), lambda c: c["url"] != "")
    return F.coalesce(F.array_max(choices)["url"], F.lit(""))


def not_editorial(text: Column, portraits: bool = False) -> Column:
    """A picture's URL and captions that speak of decoration or, unless those are allowed, of a portrait (FLT-23)."""
    hard = text.rlike(NOT_EDITORIAL)
    return hard if portraits else hard | text.rlike(PORTRAIT)


def image_valid(n_bytes: Column, width: Column, height: Column) -> Column:
    """4,000 bytes to 12 MiB, 240 by 180 pixels or more, 0.22 to 4.5 times as wide as high (FLT-24)."""
    ratio = width / height
    return F.coalesce((n_bytes >= 4000) & (n_bytes <= 12 * 1024 * 1024) & (width >= 240) & (height >= 180) & (ratio >= 0.22) & (ratio <= 4.5), F.lit(False))


def is_image(url: Column) -> Column:
    """A picture by its extension or host (TX-40)."""
    hosted = F.lit(False)
    for name in IMAGE_HOSTS:
        hosted = hosted | url.contains(name)
    return F.coalesce(url.rlike(IMAGE_FILE) | hosted, F.lit(False))


def video_playable(url: Column, mime: Column) -> Column:
    """Not a picture, and of a known host or of a type that players take (FLT-25); nothing is fetched."""
    given, known = F.trim(F.coalesce(url, F.lit(""))), F.lit(False)
    for name in VIDEO_HOSTS:
        known = known | given.contains(name)
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    return (given != "") & ~is_image(given) & (known | kind.isin(*VIDEO_TYPES))


def visible_date(html: Column) -> Column:
    """The first date with its day first in a page's visible text, else the first with its year first (DT-6)."""
    text = F.regexp_replace(decode(html), DIRECTION_MARKS, "")
    return first_said(*[F.regexp_extract(text, pattern, 1) for pattern in VISIBLE_DATES])
