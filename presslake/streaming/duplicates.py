"""Tiered duplicates of a stream of stories: first writer wins, in the order of their time (STR-4)."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from presslake.functions import columns as C
from presslake.operators import duplicates
from presslake.operators.duplicates import CANDIDATES, HOURS, LEAST_SCORE, FirstWriters
from presslake.session import by_value

DECISION = "category string, number long, at long, tier string, original long, score int"
OUT = Row(*(field.split()[0] for field in DECISION.split(", ")))
HOUR = 3_600_000_000


class StoredWriters(FirstWriters):
    """FirstWriters whose values lie in a category's map state, listed by hour so that an hour is forgotten at once."""

    def __init__(self, own: DuplicateTiers):
        super().__init__(own.width, own.most, own.least)
        self.own = own

    def get(self, name: str) -> tuple[int, int] | None:
        hit = self.own.values_.getValue((name,))
        return None if hit is None else (hit[0], hit[1])

    def put(self, name: str, at: int, number: int) -> None:
        hour = at // HOUR
        self.own.values_.updateValue((name,), (at, number))
        known = self.own.hours.getValue((hour,)) if self.own.hours.containsKey((hour,)) else ([],)
        self.own.hours.updateValue((hour,), ([*known[0], name],))

    def forget(self, before: int) -> None:
        """Nothing here: timers forget."""


class DuplicateTiers(StatefulProcessor):
    """Stories of a category wait until the watermark has passed them, and are decided in order; those that come later are dropped by Spark, before they get here.

    State of a category: stories that wait (bounded by the delay), values of those that stay, by hour, for ``width``,
    and their newest titles, ``most`` at most. A timer an hour forgets the values that are too old to match.
    """

    def __init__(self, tiers: list[str], width: int, most: int, least: int):
        self.tiers, self.width, self.most, self.least = tiers, width, most, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, number long", "words array<string>, tiers array<string>")
        self.values_ = handle.getMapState("values", "name string", "at long, number long")
        self.hours = handle.getMapState("hours", "hour long", "names array<string>")
        self.recent = handle.getValueState("recent", "stories array<struct<at: long, number: long, words: array<string>>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.updateValue((row.at, row.number), (row.words, row.tiers))
            self.handle.registerTimer(row.at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] < passed), key=lambda item: item[0])
        if ready:
            writers = StoredWriters(self)
            writers.recent = tuple((s[0], s[1], tuple(s[2])) for s in self.recent.get()[0]) if self.recent.exists() else ()
            for (at, number), (words, tiers) in ready:
                self.waiting.removeKey((at, number))
                decision = writers.decide(at, number, dict(zip(self.tiers, tiers)), words)
                if decision[0] is None:
                    self.handle.registerTimer(((at // HOUR + 1) * HOUR + self.width) // 1000 + 1)
                yield OUT(key[0], number, at, *decision)
            self.recent.update(([(at, number, list(words)) for at, number, words in writers.recent],))
        for (hour,) in [tuple(k) for k in self.hours.keys() if (k[0] + 1) * HOUR + self.width < passed]:
            for name in self.hours.getValue((hour,))[0]:
                if self.values_.containsKey((name,)) and self.values_.getValue((name,))[0] // HOUR == hour:
                    self.values_.removeKey((name,))
            self.hours.removeKey((hour,))

    def close(self) -> None:
        pass


def first_writers(stream: DataFrame, key: str, ts: str, category: str, title: str, tiers: dict[str, Column], delay: str, width: timedelta = timedelta(hours=HOURS), most: int = CANDIDATES, least: int = LEAST_SCORE) -> DataFrame:
    """DECISION rows of a stream of stories (``at`` in microseconds), in batches of any size those that operators.duplicates.first_writers gives for all of them; needs the RocksDB state store."""
    by_value(__name__)
    by_value(duplicates.__name__)
    own = stream.select(
        F.col(category).cast("string").alias("category"),
        F.col(ts).cast("timestamp").alias("seen"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(key).cast("long").alias("number"),
        F.coalesce(C.tokens(C.normalized(F.col(title))), F.array()).alias("words"),
        F.array(*(c.cast("string") for c in tiers.values())).alias("tiers"),
    ).filter("seen is not null")
    micros = int(width.total_seconds()) * 1_000_000
    return own.withWatermark("seen", delay).groupBy("category").transformWithState(DuplicateTiers(list(tiers), micros, most, least), DECISION, "Append", "EventTime")
