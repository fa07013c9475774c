"""Resampling against a sequential count of features."""

import hashlib
import math
import random
import re
import zlib

import pytest

from presslake.llm import resampling

DOC = "doc_id long, text string, block string, bucket int, weight double, rank int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def expected(rows, target, percent=25, least=20):
    counts = [[0] * 10_000, [0] * 10_000]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    for k, texts in enumerate(([t for _, t in rows], target)):
        for text in texts:
            for f in features(text)[1]:
                counts[k][bucket(f)] += 1
    s, t = counts
    gains = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    out = []
    for doc_id, text in rows:
        words, own = features(text)
        weight = sum(gains[bucket(f)] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(eligible[: len(eligible) * percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def table(n=300):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "The", "Ünï", "汉字", "a1", *[f"w{i}" for i in range(200)]])
    rows = [(1, None), (2, ""), (3, " ,. "), (4, "one"), (4, "one"), (None, "null id " * 15), (None, "null id " * 15), (5, "the " * 50_000), (6, "a_b\u0085c d é-É ZZ"), (7, "x" * 3_000_000), (8, ("word " * 500_000) + "end")]
    rows += [(10 + i, " ".join(word() for _ in range(rng.choice([3, 19, 20, 21, 80])))) for i in range(n)]
    rows += rows[-3:]
    rng.shuffle(rows)
    return rows, [" ".join(f"w{rng.randrange(30)}" for _ in range(40)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("block_postings", [resampling.BLOCK_POSTINGS, 300])
def test_equals_brute_force(spark, block_postings):
    rows, target = table()
    docs = spark.createDataFrame([(*r, "b", 1, 0.5, 2) for r in rows], DOC).repartition(4)
    aimed = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = [tuple(r) for r in resampling.resample(docs, aimed, block_postings=block_postings).collect()]
    assert sorted(got, key=repr) == expected(rows, target)


def test_pieces_of_a_text_count_as_the_whole(monkeypatch):
    text = b"one two  three four, five one two"
    whole = resampling.bucket_counts(text)
    monkeypatch.setattr(resampling, "PIECE_BYTES", 1)
    parts = resampling.bucket_counts(text)
    assert whole[2] == parts[2] == 7 and whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs, none).count() == 0
    rows = [(1, "a b c"), (2, "a " * 30)]
    got = resampling.resample(spark.createDataFrame([(*r, "b", 1, 0.5, 2) for r in rows], DOC), none).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows, [])
