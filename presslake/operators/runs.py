"""Retrieval runs as relations: which sources and items count, what a copy changes, how a run went and when the next one is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions import policy as P

# Names of states and sources that results must agree on.
FAILING = ("Failing", "Degraded", "Misconfigured")
FIRST_FOR_BREAKING = "(?:الإخبارية|عاجل|سبق)"
NO_ENDPOINT = r"(?i)(?:^https?://)?(?:www\.)?example\.com(?:/|$)"
WEAK_MATCHES = ("event_similarity", "title_similarity", "normalized_title", "content_hash")
PUBLIC = ("منشور", "معتمد")
RECOVERABLE = ("مسودة", "بانتظار المراجعة", "بحاجة إلى مراجعة", "مستورد", "Imported", "Approved", "معتمد", "مجدول")
SCHEDULED, APPROVED = "مجدول", ("معتمد", "Approved")


def said(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("")) != ""


def misconfigured(*endpoints: Column) -> Column:
    """No endpoint, or the first one said is an example's (FLT-21)."""
    first = F.coalesce(*[F.nullif(e, F.lit("")) for e in endpoints], F.lit(""))
    return (first == "") | first.rlike(NO_ENDPOINT)


def candidate_sources(sources: DataFrame, kind: str, target: str | None = None) -> DataFrame:
    """Approved sources that a run takes, by ``kind``: source, category, failing or breaking (FLT-20); those known for breaking news first, if that is the kind.

    Columns: id, name, status, health, domain, main_categories, priority, reliability.
    """
    fit = sources.filter(P.approved_source(F.col("status"), F.col("health"), F.col("domain")))
    rules = {"source": F.col("id").cast("string") == F.lit(target), "category": F.array_contains("main_categories", F.lit(target)), "failing": F.col("health").isin(*FAILING)}
    if kind in rules:
        return fit.filter(rules[kind])
    if kind != "breaking":
        return fit
    return fit.orderBy(F.col("name").rlike(FIRST_FOR_BREAKING).desc(), F.col("priority"), F.col("reliability").desc())


def incremental(items: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Items that a source hasn't shown before (STR-1, WN-5); sources without a state give all theirs.

    items: key, item, guid, url, published, modified. state, one row a key: last_item, last_guid, last_url, last_published,
    last_modified. An item changed since then always counts. Names and times that are missing on either side say nothing.
    """
    both = items.join(state, key, "left")
    changed = F.coalesce(F.col("modified").isNotNull() & (F.col("last_modified").isNull() | (F.col("modified") > F.col("last_modified"))), F.lit(False))
    known = F.lit(False)
    for own, last in (("item", "last_item"), ("guid", "last_guid"), ("url", "last_url")):
        known = known | F.coalesce(said(F.col(own)) & (F.col(own) == F.col(last)), F.lit(False))
    old = F.coalesce(F.col("published") <= F.col("last_published"), F.lit(False))
    return both.filter(changed | ~(known | old)).select(*items.columns)


def on_duplicate(match: Column, hash_: Column, known_hash: Column, modified: Column, known_modified: Column) -> Column:
    """update or skip, for an item whose story is known (STR-5): only a match by the source's own keys updates, if the text or its date is new."""
    newer = F.coalesce(modified.isNotNull() & (known_modified.isNull() | (modified > known_modified)), F.lit(False))
    return F.when(~match.isin(*WEAK_MATCHES) & (~hash_.eqNullSafe(known_hash) | newer), "update").otherwise("skip")


def run_status(accepted: Column, failed: Column, fresh: Column, breaking_seen: Column, breaking_imported: Column) -> Column:
    """struct<status, breaking>: how a source's run went (MA-9)."""
    status = F.when(accepted > 0, F.when(failed > 0, "Degraded").otherwise("Healthy")).when(fresh == 0, "Healthy").otherwise("Degraded")
    breaking = F.when((breaking_seen > 0) & (breaking_imported == 0), "Out of Sync").when(status == "Healthy", "Healthy").when(status == "Degraded", "Delayed").otherwise("Failed")
    return F.struct(status.alias("status"), breaking.alias("breaking"))


def source_states(runs: DataFrame, key: str, at: str) -> DataFrame:
    """A row per source: the last run's state and newest names, and how many runs since the last healthy one failed (STR-6).

    runs: key, at, status, item, guid, url, published, modified.
    """
    healthy = F.max(F.when(F.col("status") == "Healthy", F.col(at)))
    last = [F.max_by(F.when(said(F.col(c)), F.col(c)), F.when(said(F.col(c)), F.col(at))).alias(f"last_{c}") for c in ("item", "guid", "url")]
    grouped = runs.groupBy(key).agg(F.max_by("status", at).alias("health"), healthy.alias("last_success"), F.max("published").alias("last_published"), F.max("modified").alias("last_modified"), *last)
    failures = runs.join(grouped.select(key, "last_success"), key).groupBy(key).agg(F.count_if((F.col("status") != "Healthy") & (F.col("last_success").isNull() | (F.col(at) > F.col("last_success")))).alias("failures"))
    return grouped.join(failures, key)


def next_run(after: Column, enabled: Column, frequency: Column, hours: Column, minutes: Column, weekdays: Column, zone: str) -> Column:
    """When a schedule runs next (DT-10): so many hours on, or at a local time (minutes after midnight) of a day or of given weekdays (0 is Sunday); null if there is none.

    ``after`` is a timestamp in a UTC session. The next eight local days are tried; a time that a change of clocks leaves out is not met on that day.
    """
    from_minute = F.timestamp_micros(F.ceil(F.unix_micros(after) / 60_000_000) * 60_000_000)
    today = F.to_date(F.from_utc_timestamp(from_minute, zone))

    def candidate(i: Column) -> Column:
        day = F.date_add(today, i)
        local = F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + minutes.cast("long") * 60_000_000)
        moment = F.to_utc_timestamp(local, zone)
        fits = (moment >= from_minute) & (F.from_utc_timestamp(moment, zone) == local)
        return F.when(fits & ((frequency == "daily") | F.array_contains(weekdays, F.dayofweek(day) - 1)), moment)

    timed = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(8)), candidate), lambda m: m.isNotNull()))
    hourly = F.timestamp_micros(F.unix_micros(after) + F.greatest(F.lit(1), hours).cast("long") * 3_600_000_000)
    return F.when(enabled & (frequency == "hourly"), hourly).when(enabled, timed)


def promotion(status: Column, valid: Column, due: Column, now: Column, imported: Column, review: Column, automatic: Column) -> Column:
    """struct<promote, reason>: whether a record goes public by itself, or why it doesn't (STR-19); the reason is null if nothing is wrong with its state."""
    waits = due.isNull() | (due > now)
    recoverable = status.isin(*RECOVERABLE) & imported & valid & ~review
    out = lambda promote, reason: F.struct(promote.alias("promote"), reason.alias("reason"))
    nothing = F.lit(None).cast("string")
    return (
        F.when((status == SCHEDULED) & waits, out(F.lit(False), F.lit("Scheduled post not activated: publication time has not arrived")))
        .when(status == SCHEDULED, out(valid, nothing))
        .when(status.isin(*APPROVED) & valid, out(F.lit(True), nothing))
        .when(recoverable, out(automatic, F.when(~automatic, "Automatic publishing is not enabled for the source")))
        .when(~status.isin(*PUBLIC), out(F.lit(False), F.concat(F.lit("Invalid publication status: "), status)))
        .otherwise(out(F.lit(False), nothing))
    )


def terms_filter(text: Column, included: list[str], excluded: list[str]) -> Column:
    """Any included term, if there are any, and no excluded one, in lower case (FLT-30)."""
    low = F.lower(text)
    holds = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda t: low.contains(F.lower(t)))
    return (holds(included) if included else F.lit(True)) & (~holds(excluded) if excluded else F.lit(True))


def keyword_class(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The first class that most of its keywords are found for, null if none is (MA-10)."""
    low = F.lower(text)
    counts = [F.struct(F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(F.lower(w)))).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, words) in enumerate(keywords.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, best["name"])


def set_columns(df: DataFrame, match: Column, allowed: set[str], **changes) -> DataFrame:
    """Rows that match with new values, the others as they are (SNK-8, SNK-10); only allowed columns change."""
    if wrong := set(changes) - allowed:
        raise ValueError(f"not to be changed: {sorted(wrong)}")
    chosen = F.coalesce(match, F.lit(False))
    return df.withColumns({name: F.when(chosen, value if isinstance(value, Column) else F.lit(value)).otherwise(F.col(name)).cast(df.schema[name].dataType) for name, value in changes.items()})


def by_slug(df: DataFrame, wanted: str, slug: str = "slug", key: str = "id") -> DataFrame:
    """Rows whose slug or key is the wanted text, as given or URL-decoded (FLT-10)."""
    names = F.array(F.lit(wanted), F.coalesce(F.try_url_decode(F.lit(wanted)), F.lit(wanted)))
    return df.filter(F.array_contains(names, F.col(slug).cast("string")) | F.array_contains(names, F.col(key).cast("string")))


def first_enough(found: list[DataFrame], least: int = 30) -> DataFrame:
    """Items of the methods in their order, up to the first one that brings the count to ``least`` (SRC-13); each method's items are counted up to that bound only."""
    out = found[0]
    n = out.limit(least).count()
    for more in found[1:]:
        if n >= least:
            break
        n += more.limit(least).count()
        out = out.unionByName(more)
    return out
