"""States that end by themselves: breaking stories expire, local days are closed, once event time has passed (STR-10, STR-7)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presslake.session import by_value

DAY = "category string, day date, begins long, ends long, n long"
CLOSED = Row(*(field.split()[0] for field in DAY.split(", ")))


def breaking_expiry(stream: DataFrame, story: str, ts: str, delay: str, width: str = "12 hours") -> DataFrame:
    """(story, first, last, until, sightings) when a breaking story ends: ``width`` after its newest sighting, once the watermark has passed that; one seen again later is a new one.

    Sightings less than ``width`` apart are a session, which Spark merges whatever their order. Works for tables, too.
    """
    at = F.col(ts).cast("timestamp")
    own = stream.select(F.col(story).cast("string").alias("story"), at.alias("seen")).filter("seen is not null").withWatermark("seen", delay)
    found = own.groupBy(F.session_window("seen", width).alias("span"), "story").agg(F.max("seen").alias("last"), F.count("*").alias("sightings"))
    return found.select("story", F.col("span.start").alias("first"), "last", F.col("span.end").alias("until"), "sightings")


class LocalDays(StatefulProcessor):
    """Counts a category's rows of a local day; a timer closes the day when the watermark has passed its end. Rows that come later are dropped by Spark, before they get here."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.count = handle, handle.getValueState("count", "n long, begins long, ends long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, begins, ends = self.count.get() if self.count.exists() else (0, None, None)
        new = ends is None
        for row in rows:
            n, begins, ends = n + 1, row.begins, row.ends
        self.count.update((n, begins, ends))
        if new:
            self.handle.registerTimer(ends // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, begins, ends = self.count.get()
        self.count.clear()
        yield CLOSED(*key, begins, ends, n)

    def close(self) -> None:
        pass


def with_local_day(df: DataFrame, ts: str, zone: str) -> DataFrame:
    """df with the local ``day`` of its times, and where it ``begins`` and ``ends`` in microseconds: 23 to 25 hours apart where clocks change."""
    at = F.col(ts).cast("timestamp")
    day = F.to_date(F.from_utc_timestamp(at, zone))
    edge = lambda d: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(d), zone))
    return df.withColumns({"day": day, "begins": edge(day), "ends": edge(F.date_add(day, 1))})


def local_days(stream: DataFrame, category: str, ts: str, zone: str, delay: str) -> DataFrame:
    """DAY rows of a stream: one for every category and local day when the day is over. The session's zone must be UTC."""
    by_value(__name__)
    own = with_local_day(stream.select(F.col(category).cast("string").alias("category"), F.col(ts).cast("timestamp").alias("seen")).filter("seen is not null"), "seen", zone)
    return own.withWatermark("seen", delay).groupBy("category", "day").transformWithState(LocalDays(), DAY, "Append", "EventTime")


def local_day_counts(df: DataFrame, category: str, ts: str, zone: str) -> DataFrame:
    """The counts of local_days() for a table: category, day, begins, ends, n."""
    own = with_local_day(df.select(F.col(category).cast("string").alias("category"), F.col(ts).cast("timestamp").alias("seen")).filter("seen is not null"), "seen", zone)
    return own.groupBy("category", "day").agg(F.min("begins").alias("begins"), F.min("ends").alias("ends"), F.count("*").alias("n"))
