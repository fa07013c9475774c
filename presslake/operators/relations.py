"""Relational operators over any DataFrame: pages, ranks, latest rows, duplicates, grids and upserts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered listing (SO-1); page numbers start at 1."""
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def after_cursor(df: DataFrame, ts: str, key: str, cursor: tuple[datetime, int], size: int) -> DataFrame:
    """The next rows, newest first, behind a (time, id) cursor (FLT-7): no offset is counted."""
    at, last = F.lit(cursor[0]), F.lit(cursor[1])
    behind = (F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last))
    return df.filter(behind).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(size)


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, place: str = "place") -> DataFrame:
    """The first n rows of each key, with their number in ``place`` (WN-2, JN-5); Spark cuts each task's rows to n before the shuffle."""
    if place in df.columns:
        raise ValueError(f"the table has a column {place}: name another")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(place, rank).filter(F.col(place) <= n)


def balanced_top(df: DataFrame, category: str, order: list[Column], limit: int, cap: int, pinned: Column | None = None) -> DataFrame:
    """At most ``limit`` rows: pinned ones, which no cap holds back, and the ``cap`` best of each category; then the best of the rest (WN-3)."""
    place = "place_in_category"
    if place in df.columns:
        raise ValueError(f"the table has a column {place}")
    first = F.lit(False) if pinned is None else pinned
    by = [first.desc(), *order]
    # beyond cap a category can still fill up the list, but never with more than limit rows
    some = df.withColumn(place, F.row_number().over(Window.partitionBy(category).orderBy(*by))).filter(F.col(place) <= limit)
    return some.orderBy((first | (F.col(place) <= cap)).desc(), *by).limit(limit).drop(place)


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once, however often they are used: an explode of one row, into which the optimiser doesn't fold its uses."""
    own = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("held_")
    return df.select("*", own).select(*df.columns, *(F.col(f"held_.{n}").alias(n) for n in columns))


def overlap_counts(df: DataFrame, key: str, items: str, target: DataFrame, own: str | None = None, most: int = 200_000) -> DataFrame:
    """(key, overlap), or with ``own`` (own, key, overlap): rows of df, but for the target's own, by how many pairs of equal items they make with a target's (JN-10); repeated items count each time.

    ``target`` holds rows (key, items). An equi-join on items with their counts, which are broadcast where they are ``most`` or fewer.
    """
    name = own or "own_key"
    wanted = target.select(F.col(key).alias(name), F.explode(items).alias("item")).groupBy(name, "item").agg(F.count("*").alias("times"))
    if wanted.limit(most + 1).count() <= most:
        wanted = F.broadcast(wanted)
    pairs = df.select(key, F.explode(items).alias("item")).join(wanted, "item").filter(F.col(key) != F.col(name))
    found = pairs.groupBy(name, key).agg(F.sum("times").alias("overlap"))
    return found if own else found.drop(name)


def exact_duplicates(df: DataFrame, key: str, tiers: dict[str, list[str]]) -> DataFrame:
    """Rows that an earlier row (smaller key) matches on any tier's columns, with the first such tier (JN-11); null and empty values match nothing.

    One grouped minimum per tier, combined before its shuffle, and an equi-join with it instead of a join on a disjunction.
    """
    found = None
    for order, (tier, columns) in enumerate(tiers.items()):
        full = F.lit(True)
        for c in columns:
            full = full & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        some = df.filter(full).select(key, *columns)
        first = some.groupBy(*columns).agg(F.min(key).alias("original"), F.count("*").alias("many")).filter("many > 1").drop("many")
        one = some.join(first, columns).filter(F.col("original") < F.col(key)).select(key, "original", F.lit(order).alias("tier_order"), F.lit(tier).alias("tier"))
        found = one if found is None else found.unionByName(one)
    best = found.groupBy(key).agg(F.min_by(F.struct("tier", "original"), "tier_order").alias("best"))
    return best.select(key, "best.tier", "best.original")


def interval_pairs(df: DataFrame, key: str, ts: str, equal: list[str], width: timedelta) -> DataFrame:
    """Pairs (earlier key, later key) with equal columns and times at most ``width`` apart (JN-12).

    Equi-join on time buckets of that width: a row looks into its own bucket and the one before.
    """
    seconds = int(width.total_seconds())
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    slim = df.select(key, *equal, micros.alias("at")).withColumn("bucket", F.floor(F.col("at") / (seconds * 1_000_000)))
    later = slim.select(F.col(key).alias("later"), *equal, F.col("at").alias("later_at"), F.explode(F.array("bucket", F.col("bucket") - 1)).alias("bucket"))
    earlier = slim.select(F.col(key).alias("earlier"), *equal, F.col("at").alias("earlier_at"), "bucket")
    ordered = (F.col("earlier_at") < F.col("later_at")) | ((F.col("earlier_at") == F.col("later_at")) & (F.col("earlier") < F.col("later")))
    return earlier.join(later, [*equal, "bucket"]).filter(ordered & (F.col("later_at") - F.col("earlier_at") <= seconds * 1_000_000)).select(*equal, "earlier", "later")


def rolling_days(df: DataFrame, ts: str, zone: str, now: datetime, days: int = 7) -> DataFrame:
    """Rows of the last local days with their local ``day``; today ends now (DT-3, JN-15)."""
    local = F.to_date(F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone))
    today = F.to_date(F.from_utc_timestamp(F.lit(now).cast("timestamp"), zone))
    inside = (F.col(ts).cast("timestamp") < F.lit(now).cast("timestamp")) & (local > F.date_sub(today, days))
    return df.filter(inside).withColumn("day", local)


def dense_grid(df: DataFrame, category: str, day: str, first: str, days: int) -> DataFrame:
    """Counts by category and day, zero where there are none (JN-16): each category spans its own days."""
    span = F.explode(F.sequence(F.to_date(F.lit(first)), F.date_add(F.to_date(F.lit(first)), days - 1))).alias(day)
    grid = df.select(category).distinct().select(category, span)
    return grid.join(df.groupBy(category, day).agg(F.count("*").alias("n")), [category, day], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, sticky: list[str], latest: list[str]) -> DataFrame:
    """One row per key: ``sticky`` columns as first written, ``latest`` ones as last written (SNK-2, SNK-3)."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*(F.min_by(c, order).alias(c) for c in sticky), *(F.max_by(c, order).alias(c) for c in latest))
