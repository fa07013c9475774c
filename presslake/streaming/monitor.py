"""The change monitor of pages as a stream: a state machine per page that waits for the watermark (STR-11)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presslake.operators.monitoring import PUBLISHED, REMOVED, REVIEW, TEMPORARY
from presslake.session import by_value

TRANSITION = "page string, number long, at timestamp, status string, attempts long, failures long, publication string, previous string, removed_at timestamp, hidden boolean, restored boolean"
OUT = Row(*(field.split()[0] for field in TRANSITION.split(", ")))
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros_of(at: datetime) -> int:
    """Microseconds of a time that Spark gave to a worker, in the worker's zone."""
    return (at.astimezone(UTC) - EPOCH) // timedelta(microseconds=1)


def time_of(micros: int) -> datetime:
    return (EPOCH + timedelta(microseconds=micros)).astimezone()


class PageMonitor(StatefulProcessor):
    """Checks wait in a map until the watermark has passed their time and are then applied in order; one that comes later than that is dropped by Spark, before it gets here.

    State of a page: attempts, failures, publication, previous, removed_at; and the checks that wait, which the
    watermark's delay bounds.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "attempts long, failures long, publication string, previous string, removed_at long")
        self.waiting = handle.getMapState("waiting", "at long, number long", "status string, initial string, refreshed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            at = micros_of(row.at)
            self.waiting.updateValue((at, row.number), (row.status, row.initial, row.refreshed))
            self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] < passed), key=lambda item: item[0])
        if not ready:
            return
        attempts, failures, publication, previous, removed_at = self.page.get() if self.page.exists() else (0, 0, None, None, None)
        for (at, number), (status, initial, refreshed) in ready:
            self.waiting.removeKey((at, number))
            publication = initial if publication is None else publication
            temporary, removed = status in TEMPORARY, status == REMOVED
            restoring = previous is not None and not temporary and not removed and refreshed
            attempts, failures = attempts + 1, failures + 1 if temporary else 0
            hidden, restored = removed and publication == PUBLISHED, restoring and previous == PUBLISHED
            if removed:
                previous, publication, removed_at = previous or publication, REVIEW, at
            elif restoring:
                publication, previous, removed_at = PUBLISHED if restored else publication, None, None
            yield OUT(key[0], number, time_of(at), status, attempts, failures, publication, previous, None if removed_at is None else time_of(removed_at), hidden, restored)
        self.page.update((attempts, failures, publication, previous, removed_at))

    def close(self) -> None:
        pass


def monitored(checks: DataFrame, page: str, at: str, number: str, status: str, initial, refreshed=None, delay: str = "1 hour") -> DataFrame:
    """TRANSITION rows of a stream of checks: page_states() row by row, once the watermark has passed; needs the RocksDB state store."""
    by_value(__name__)
    yes = F.lit(True)
    own = checks.select(
        F.col(page).cast("string").alias("page"),
        F.col(at).cast("timestamp").alias("at"),
        F.col(number).cast("long").alias("number"),
        F.coalesce(F.col(status), F.lit("Active")).alias("status"),
        initial.alias("initial"),
        F.coalesce(yes if refreshed is None else refreshed, yes).alias("refreshed"),
    ).filter("at is not null")
    return own.withWatermark("at", delay).groupBy("page").transformWithState(PageMonitor(), TRANSITION, "Append", "EventTime")
