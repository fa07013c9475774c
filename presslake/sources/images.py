"""Sizes of pictures from the first bytes of their files, and elements of pages by class."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of a JPEG frame that name its size (fixed values).
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC9, 0xCA}
OPENING = re.compile(r"""(?i)<(main|div|section)\b[^>]*class=["']([^"']*)["'][^>]*>""")


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    start = data.find(b"\x9d\x01\x2a", 20, 80)
    if start < 0 or len(data) < start + 7:
        return None
    return tuple(int.from_bytes(data[start + i : start + i + 2], "little") & 0x3FFF for i in (3, 5))


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        if data[at + 1] in FRAMES:
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        length = int.from_bytes(data[at + 2 : at + 4], "big")
        if length < 2:
            return None
        at += 2 + length
    return None


def size_of(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, WEBP, AVIF or JPEG, or None."""
    if not data:
        return None
    if data[:2] == b"\x89P" and len(data) > 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:3] == b"GIF" and len(data) > 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) > 30:
        return _webp(data)
    box = data.find(b"ispe", 4, 4096)
    if box >= 0 and len(data) >= box + 16:
        return int.from_bytes(data[box + 8 : box + 12], "big"), int.from_bytes(data[box + 12 : box + 16], "big")
    return _jpeg(data) if data[:2] == b"\xff\xd8" else None


def image_size(content: Column) -> Column:
    """struct<width, height> of a column of files' bytes, as the binaryFile source gives; nulls if they are no picture (SRC-21)."""

    @F.pandas_udf("width int, height int")
    def sizes(values: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in values:
            rows = [size_of(None if v is None else bytes(v)) or (None, None) for v in series]
            yield pd.DataFrame(rows, columns=["width", "height"]).astype("Int32")

    return sizes(content)


def inside(html: str | None, classes: str) -> str:
    """The markup within the first main, div or section whose class fits, to its own end tag; empty without one."""
    html = html or ""
    for found in OPENING.finditer(html):
        if not re.search(classes, found[2], re.I):
            continue
        depth = 1
        for tag in re.compile(rf"(?i)</?{found[1]}\b[^>]*>").finditer(html, found.end()):
            depth += -1 if tag[0].startswith("</") else 1
            if depth == 0:
                return html[found.end() : tag.start()]
    return ""


def with_element(pages: DataFrame, classes: str, name: str = "scope") -> DataFrame:
    """Pages with the markup within their first element of a class, nested ones of its name counted (SRC-17)."""

    @F.pandas_udf("string")
    def scopes(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in values:
            yield series.map(lambda h: inside(h, classes))

    return pages.withColumn(name, scopes("html"))


def longest_body(*bodies: Column) -> Column:
    """The longest of the texts that an article page gives, the first of equals (SRC-18)."""
    texts = [F.coalesce(b, F.lit("")) for b in bodies]
    return F.array_max(F.array(*[F.struct(F.length(t).alias("n"), F.lit(-i).alias("place"), t.alias("text")) for i, t in enumerate(texts)]))["text"]
