"""Column functions: text, sets, dates and scores. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic letter folding and the marks that are dropped (fixed values).
ARABIC_FROM, ARABIC_TO = "إأآىة", "ااايه"
ARABIC_MARKS = "[ً-ٰٟ]"
#: Names of query parameters that a canonical URL leaves out (fixed values).
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|mc_.*)$"


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of halves towards plus infinity: floor(x * 10^d + 0.5) / 10^d."""
    scale = 10**digits
    out = F.floor(x * F.lit(float(scale)) + F.lit(0.5))
    return out / F.lit(float(scale)) if digits else out


def normalized(text: Column) -> Column:
    """Folded text: marks dropped, letters folded, all but letters and digits a space, trimmed, lower case (TX-1 without compatibility forms)."""
    out = F.translate(F.regexp_replace(text, ARABIC_MARKS, ""), ARABIC_FROM, ARABIC_TO)
    return F.lower(F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")))


def plain_title(text: Column) -> Column:
    """A title without marks, all but letters and digits a space, in lower case; letters aren't folded (TX-2 without compatibility forms)."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, ARABIC_MARKS, ""), r"[^\p{L}\p{N}]+", " ")))


def tokens(text: Column) -> Column:
    """Distinct words of normalized text, in order of their first place; no empty one."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def token_similarity(a: Column, b: Column) -> Column:
    """Shared words over the larger set; 0 where either is empty (TX-4)."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / larger)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: what a lambda refers to from outside is otherwise computed again for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles(words: Column, k: int = 2) -> Column:
    """Distinct runs of k words of two letters or more; a shorter text is one shingle (TX-6)."""
    long = F.filter(words, lambda w: F.length(w) > 1)
    runs = lambda held: F.transform(F.sequence(F.lit(1), F.greatest(F.size(held) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(held, i, k), " "))
    return F.filter(F.array_distinct(once(long, runs)), lambda s: s != "")


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; 1 for two empty sets, 0 for one (TX-7)."""

    def near(both: Column) -> Column:
        one, other = both["a"], both["b"]
        share = F.size(F.array_intersect(one, other)) / F.size(F.array_union(one, other))
        return F.when((F.size(one) == 0) & (F.size(other) == 0), F.lit(1.0)).when((F.size(one) == 0) | (F.size(other) == 0), F.lit(0.0)).otherwise(share)

    return once(F.struct(a.alias("a"), b.alias("b")), near)


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)))


def script_majority(text: Column, own: str, other: str, least: int = 6) -> Column:
    """At least ``least`` letters of the script ``own``, and no fewer than of ``other`` (FLT-16)."""
    mine, theirs = F.regexp_count(text, F.lit(own)), F.regexp_count(text, F.lit(other))
    return (mine >= least) & (mine >= theirs)


def canonical_url(url: Column) -> Column:
    """Host in lower case, no fragment, no tracking parameters, no double or final slash but the root's (TX-36); what isn't a URL is trimmed."""
    given = F.trim(url)
    bare = F.regexp_replace(given, "#.*$", "")
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?]+)([^?]*)(?:\?(.*))?$"
    part = lambda i: F.regexp_extract(bare, pattern, i)
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^[^=]*", 0).rlike(TRACKING))
    path = F.regexp_replace(F.regexp_replace(part(3), "/+", "/"), "/$", "")
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    whole = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), query)
    return F.when(bare.rlike(pattern), whole).otherwise(given)


def html_tag(html: Column, tag: str) -> Column:
    """Text of the first element of this name, markup dropped and white space joined."""
    inside = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(inside, "<[^>]*>", " "), r"\s+", " "))


def failing(**rules: Column) -> Column:
    """Names of all rules that hold, in order: the reasons why a row is rejected (FLT-18)."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def age_hours(at: Column, now: Column, least: float) -> Column:
    return F.greatest(F.lit(least), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(3.6e9))


def trend_score(mentions: Column, engagement: Column, interactions: Column, velocity: Column, age: Column, reliability: Column) -> Column:
    """[25 ln(1+C) + 15 ln(1+X) + 12 ln(1+I) + 20 V] / (age + 1.5)^1.6 * R, to one decimal (MA-1)."""
    signal = 25 * F.log1p(mentions) + 15 * F.log1p(engagement) + 12 * F.log1p(interactions) + 20 * velocity
    return half_up(signal / F.pow(age + 1.5, F.lit(1.6)) * reliability, 1)


def zoned_midnight(day: Column, zone: str) -> Column:
    """The moment at which a local day begins (DT-1)."""
    return F.to_utc_timestamp(F.to_timestamp(day), zone)


def host(url: Column) -> Column:
    """Host of an http or https URL in lower case, without user and port; empty if there is none."""
    authority = F.regexp_replace(F.regexp_extract(F.trim(url), r"^(?i:https?)://([^/?#\\\\]*)", 1), "^.*@", "")
    return F.lower(F.regexp_extract(authority, r"^(\[[^\]]*\]|[^:]+)", 1))


def safe_external(url: Column) -> Column:
    """An http or https URL whose host is neither local nor in a private network (FLT-13)."""
    own = host(url)
    return F.coalesce((own != "") & ~own.rlike(r"^(localhost$|\[::1\]$|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), F.lit(False))


def domains_match(a: Column, b: Column) -> Column:
    """Equal domains, or one a subdomain of the other; a leading www. doesn't count (FLT-12)."""
    x, y = (F.regexp_replace(F.lower(c), r"^www\.", "") for c in (a, b))
    return (x != "") & (y != "") & ((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)))


def sentences(text: Column) -> Column:
    """Sentences that end in a mark and white space, or in a new line; no empty one (TX-13)."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?؟…])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def string_array(value: Column) -> Column:
    """A JSON array of strings, or else the parts between commas and new lines (SC-J1)."""
    parts = F.filter(F.transform(F.split(value, "[،,\n]+"), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), parts)).otherwise(parts)


def external_key(*names: Column) -> Column:
    """SHA-256 of the first name that isn't empty (TX-38)."""
    return F.sha2(F.coalesce(*[F.nullif(n.cast("string"), F.lit("")) for n in names]), 256)


def event_fingerprint(category: Column, title: Column, published: Column) -> Column:
    """SHA-256 of category, the first ten longer title words in order of the alphabet, and the hour (TX-17)."""
    words = F.array_sort(F.slice(F.filter(tokens(normalized(title)), lambda w: F.length(w) > 3), 1, 10))
    return F.sha2(F.concat_ws("|", category, F.array_join(words, " "), F.substring(published, 1, 13)), 256)


def body_fingerprint(html: Column) -> Column:
    """SHA-256 of a page without scripts and styles, white space joined (TX-30)."""
    bare = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " ")
    return F.sha2(F.substring(F.trim(F.regexp_replace(bare, r"\s+", " ")), 1, 500_000), 256)


def freshness(hours: Column) -> Column:
    """Label of an age (DT-8)."""
    return F.when(hours > 168, "archive").when(hours > 48, "older").otherwise("fresh")


def image_candidates(html: Column, most: int = 8) -> Column:
    """URLs of a page's pictures, its social card's first (TX-29)."""
    card = F.regexp_extract_all(html, F.lit(r"(?i)<meta[^>]*property=\"og:image\"[^>]*content=\"([^\"]+)\""), F.lit(1))
    body = F.regexp_extract_all(html, F.lit(r"(?i)<img\b[^>]*\bsrc=\"([^\"]+)\""), F.lit(1))
    return F.slice(F.array_distinct(F.concat(card, body)), 1, most)
