"""Signatures and dates against plain Python."""

import random

from pyspark.sql import functions as F

from presslake.functions.dates import source_date
from presslake.functions.signatures import PRIME, coefficients, signature_similarity, signatures


def plain_signature(text):
    words = [w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split() if len(w) > 1]
    shingles = [" ".join(p) for p in zip(words, words[1:])] or words
    hashes = []
    for s in shingles:
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) & 0xFFFFFFFF
        hashes.append(abs(h - (1 << 32) if h >> 31 else h))
    return [min((a * h + b) % PRIME for h in hashes) for a, b in coefficients()] if hashes else None


def test_signatures(spark):
    words = random.Random(5)
    texts = [" ".join(words.choices("alpha beta, gamma! déjà x 42 zeta".split(), k=n)) for n in (1, 2, 7, 300)] + ["word", "a b c", "", None]
    found = signatures(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id")
    assert {r.id: r.signature for r in found.collect()} == {i: plain_signature(t or "") for i, t in enumerate(texts)}
    assert signatures(spark.createDataFrame([], "id int, text string"), "id").count() == 0


def test_signature_similarity(spark):
    rows = [([1, 2, 3, 4], [1, 2, 5, 4]), ([], []), ([1], [1, 2]), (None, [1])]
    found = spark.createDataFrame(rows, "a array<long>, b array<long>").select(signature_similarity(F.col("a"), F.col("b")))
    assert [r[0] for r in found.collect()] == [0.75, 0.0, 0.0, 0.0]


def test_source_dates(spark):
    want = {
        "1704067200": "2024-01-01 00:00:00",
        "1704067200123": "2024-01-01 00:00:00.123",
        "2024-01-02T03:04:05Z": "2024-01-02 00:04:00",
        "5/3/2024": "2024-03-04 21:00:00",
        "٥ مارس ٢٠٢٤ 10:30": "2024-03-05 07:30:00",
        "۲۰۲۴-۰۳-۰۵": "2024-03-04 21:00:00",
        "1999-05-06 07:08": "1999-05-06 04:08:00",
        "2024-13-40": None,
        "soon": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", source_date(F.col("v")).cast("string").alias("at")).collect()
    assert {r.v: r["at"] for r in rows} == want
