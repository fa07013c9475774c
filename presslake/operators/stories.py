"""Operators over stories: tiers of duplicates, states in time, and the lists a reader or an editor is shown."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiered_duplicates(exact: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """(key, tier, original) of ``exact`` (key, tier, original), then of ``near`` (key, original, score) for keys without an exact one (STR-4)."""
    rest = near.join(exact.select(key), key, "left_anti").select(key, F.lit("title").alias("tier"), "original")
    return exact.select(key, "tier", "original").unionByName(rest)


def freshness_gate(ts: Column, start: Column, now: Column, tolerance: timedelta = timedelta(minutes=15)) -> Column:
    """Why a story's time lets it not in, or null: late, or too far in the future (STR-2, STR-3)."""
    return F.when(ts.isNull(), "undated").when(ts < start, "outside_window").when(F.unix_micros(ts) > F.unix_micros(now) + int(tolerance.total_seconds()) * 1_000_000, "in_future")


def lifecycle(ts: Column, start: Column, state: Column) -> Column:
    """Current or archived by the window; other states stay (STR-9)."""
    return F.when(state.isin("current", "archived"), F.when(ts >= start, "current").otherwise("archived")).otherwise(state)


def breaking_until(ts: Column, hours: int = 12) -> Column:
    """When a breaking story stops being one (STR-10)."""
    return ts + F.make_dt_interval(hours=F.lit(hours))


def visible_after(checks: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """(key, visible, hidden_times) after a page's checks in order: Removed hides it, Active, Updated or Redirected restore it, the rest changes nothing (STR-11).

    Only the last deciding check counts, so that it is one grouped maximum and no sorted history.
    """
    deciding = F.col(status).isin("Removed", "Active", "Updated", "Redirected")
    at = F.struct(*order)
    last = F.max_by(F.when(deciding, F.col(status)), F.when(deciding, at))
    return checks.groupBy(key).agg((F.coalesce(last, F.lit("Active")) != "Removed").alias("visible"), F.count_if(F.col(status) == "Removed").alias("hidden_times"))


def composed(df: DataFrame, key: str, order: list[Column], featured: int) -> DataFrame:
    """Rows of ``df`` with the part of the page that they stand in: the first ``featured`` ones, and the rest without them (CQ-4)."""
    top = df.orderBy(*order).limit(featured).select(key)
    rest = df.join(top, key, "left_anti")
    return df.join(F.broadcast(top), key, "left_semi").withColumn("part", F.lit("featured")).unionByName(rest.withColumn("part", F.lit("news")))


def relative_label(hours: Column) -> Column:
    """An age in words (DT-11)."""
    days = F.floor(hours / 24).cast("string")
    return F.when(hours < 1, "now").when(hours < 24, F.concat(F.floor(hours).cast("string"), F.lit(" h"))).otherwise(F.concat(days, F.lit(" d")))
