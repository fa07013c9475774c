"""Duplicates of stories in the order of their time, where a story counts only if it isn't one itself (JN-12, STR-4)."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.functions import columns as C
from presslake.operators.scan import ordered_scan

#: Candidates of a story, and the least title score, in percent, of a duplicate (fixed values).
CANDIDATES, LEAST_SCORE = 80, 82
#: Tiers of equal values in the order in which they are asked, with their scores (fixed values).
TIERS = {"canonical_url": 100, "source_article_id": 100, "rss_guid": 100, "normalized_title": 100, "content_hash": 98, "event_similarity": 90}
HOURS = 36


def score(a: set[str], b: set[str]) -> int:
    """Shared words over the larger set, in percent."""
    return math.floor(len(a & b) * 100 / max(len(a), len(b)) + 0.5) if a and b else 0


def most_alike(words: set[str], at: int, recent: Iterable[tuple], width: int) -> tuple[int, int] | None:
    """(score, number) of the story that is most alike, of equals the newest; ``recent`` (at, number, words) is in order of time."""
    best = None
    for before, number, other in recent:
        if at - before <= width and ((own := score(words, set(other))), before, number) >= (best or (0, 0, 0)):
            best = own, before, number
    return best and (best[0], best[2])


class NearTitles:
    """Gives (number, original, score) of stories like one of the newest before them; the state is those."""

    def __init__(self, width: int, most: int, least: int):
        self.width, self.most, self.least, self.state = width, most, least, ()

    def step(self, row: tuple) -> Iterable[tuple]:
        _, at, number, words = row
        best = most_alike(set(words), at, self.state, self.width)
        self.state = (*(r for r in self.state if at - r[0] <= self.width), (at, number, tuple(words)))[-self.most :]
        return [(number, best[1], best[0])] if best and best[0] >= self.least else []


def _slim(df: DataFrame, category: str, ts: str, key: str, title: str) -> list[Column]:
    return [F.col(category).alias("category"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(key).cast("long").alias("number"), C.tokens(C.normalized(F.col(title))).alias("words")]


def near_titles(df: DataFrame, key: str, ts: str, category: str, title: str, width: timedelta = timedelta(hours=HOURS), most: int = CANDIDATES, least: int = LEAST_SCORE) -> DataFrame:
    """(key, original, score): stories whose title is like that of one of the ``most`` newest of their category, at most ``width`` before; the best score, of equals the newest (JN-12, TX-5).

    One ordered scan: a story meets ``most`` others however many share its category and hour. Keys are whole numbers;
    stories without a time take no part.
    """
    micros = int(width.total_seconds()) * 1_000_000
    slim = df.select(*_slim(df, category, ts, key, title)).filter("at is not null").withColumn("words", F.coalesce("words", F.array()))
    found = ordered_scan(slim, "category", ["at", "number"], lambda: NearTitles(micros, most, least), "number long, original long, score int")
    return found.select(F.col("number").alias(key), "original", "score")


class FirstWriters:
    """Decides story by story: a duplicate of one that stays, by the first tier of an equal value or by its title, or one that stays itself.

    What it knows is bounded by ``width``: values of stories that stay, by hour, and the newest of their titles.
    """

    def __init__(self, width: int, most: int = CANDIDATES, least: int = LEAST_SCORE):
        self.width, self.most, self.least = width, most, least
        self.values: dict[str, tuple[int, int]] = {}
        self.order: deque = deque()
        self.recent: tuple = ()

    @property
    def state(self):
        return self.values, self.order, self.recent

    @state.setter
    def state(self, value):
        self.values, self.order, self.recent = value

    def get(self, name: str) -> tuple[int, int] | None:
        return self.values.get(name)

    def put(self, name: str, at: int, number: int) -> None:
        self.values[name] = at, number
        self.order.append((at, number, name))

    def forget(self, before: int) -> None:
        while self.order and self.order[0][0] < before:
            at, number, name = self.order.popleft()
            if self.values.get(name) == (at, number):
                del self.values[name]

    def decide(self, at: int, number: int, values: dict[str, str | None], words: list[str]) -> tuple[str | None, int | None, int | None]:
        """(tier, original, score), of nulls for a story that stays and is remembered."""
        self.forget(at - self.width)
        names = {tier: f"{tier}|{value}" for tier, value in values.items() if value}
        for tier, name in names.items():
            hit = self.get(name)
            if hit and at - hit[0] <= self.width:
                return tier, hit[1], TIERS.get(tier, 100)
        best = most_alike(set(words), at, self.recent, self.width)
        if best and best[0] >= self.least:
            return "title_similarity", best[1], best[0]
        for name in names.values():
            self.put(name, at, number)
        self.recent = (*(r for r in self.recent if at - r[0] <= self.width), (at, number, tuple(words)))[-self.most :]
        return None, None, None

    def step(self, row: tuple) -> Iterable[tuple]:
        _, at, number, words, *values = row
        return [(number, *self.decide(at, number, dict(zip(self.tiers, values)), words or []))]


def first_writers(df: DataFrame, key: str, ts: str, category: str, title: str, tiers: dict[str, Column], width: timedelta = timedelta(hours=HOURS), most: int = CANDIDATES, least: int = LEAST_SCORE) -> DataFrame:
    """(key, tier, original, score) of every story with a time; tier is null for those that stay (STR-4): the batch twin of the stream of the same name.

    ``tiers`` names columns whose equal values make duplicates, in the order in which they are asked; null and empty ones
    match nothing. A story is a duplicate only of one that stays, of its category and at most ``width`` before.
    """
    micros = int(width.total_seconds()) * 1_000_000
    names = list(tiers)

    def start() -> FirstWriters:
        machine = FirstWriters(micros, most, least)
        machine.tiers = names
        return machine

    slim = df.select(*_slim(df, category, ts, key, title), *(c.cast("string").alias(f"tier_{i}") for i, c in enumerate(tiers.values()))).filter("at is not null")
    found = ordered_scan(slim, "category", ["at", "number"], start, "number long, tier string, original long, score int")
    return found.select(F.col("number").alias(key), "tier", "original", "score")
