"""Compatibility forms of letters (NFKC), over Arrow columns: ligatures and presentation forms become the letters that they show (TX-1, TX-2, TX-9, TX-32)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from presslake.functions import columns as C


@F.arrow_udf(StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """The text in its compatibility form; null stays null. Python's own tables: pyarrow's function leaves letters and their marks apart."""
    return pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFKC", v) for v in text.to_pylist()], pa.string())


def normalized(text: Column) -> Column:
    """columns.normalized() of the compatibility form: the whole of TX-1. Slower, as texts go through a Python worker."""
    return C.normalized(nfkc(text))


def normalized_title(text: Column) -> Column:
    """A title's compatibility form without marks, all but letters and digits a space, in lower case; letters aren't folded (TX-2)."""
    bare = F.regexp_replace(nfkc(text), C.ARABIC_MARKS, "")
    return F.lower(F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " ")))
