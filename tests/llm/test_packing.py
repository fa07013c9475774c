"""Packing against the library's ids and sequential best fit."""

import random
import zlib

import numpy as np
import pytest

from presslake.llm import packing

P = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, length string, key string"


def best_fit_decreasing(lengths, capacity=1024):
    gaps, opened = [0] * (capacity + 1), 0
    for own in sorted(lengths, reverse=True):
        size = next((g for g in range(own, capacity + 1) if gaps[g]), None)
        if size is None:
            opened, size = opened + 1, capacity
        else:
            gaps[size] -= 1
        gaps[size - own] += 1
    return opened


def whole(rows):
    """Sequences, after a look at whether each is gapless and not too long."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    return len(by)


def test_pieces_are_the_librarys_ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [(1, None), (2, ""), (3, "one"), (4, "word " * 3000), (None, "null id"), (5, "Ünïcode 汉字 <|endoftext|> x"), (6, "same"), (6, "same"), (7, "a\u0085b ᠎ c  d﻿ e f\x1cg\x1d h"), (8, "x" * 20000)]
    texts += [(100 + i, "some words " * (7 * i)) for i in range(60)]
    want = []
    for doc_id, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = min(a + 1024, len(ids)) if k else first
            want.append((doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    rows = packing.best_fit(spark.createDataFrame([(*x, "other", "k") for x in texts], DOC), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")).collect()
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    assert whole(rows) <= best_fit_decreasing([w[3] for w in want]) + 1


@pytest.mark.parametrize("name", ["uniform", "one_length", "few_long_many_short", "ties"])
def test_as_few_sequences_as_sequential_best_fit(spark, name):
    rng = random.Random(4)
    lengths = {"uniform": [rng.randrange(1, 1025) for _ in range(3000)], "one_length": [300] * 700, "few_long_many_short": [600] * 20 + [rng.randrange(1, 12) for _ in range(900)], "ties": [512] * 40 + [256] * 81 + [1024] * 3 + [1] * 50}[name]
    df = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(lengths)], packing.PIECE).repartition(4)
    rows = packing.pack(df).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert whole(rows) <= 1.02 * best_fit_decreasing(lengths) + 2


def test_steps_take_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    rng, asked, running = random.Random(5), [], packing.running
    monkeypatch.setattr(packing, "running", lambda df, keys, value, partitions: asked.append(partitions) or running(df, keys, value, partitions))
    df = spark.createDataFrame([(i, 0, 0, rng.randrange(1, 1025), 7) for i in range(600)], packing.PIECE).repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        found = sorted(packing.pack(df).collect())
        assert set(asked) == {1}
        monkeypatch.setattr(packing, "ROWS", 100)
        assert sorted(packing.pack(df).collect()) == found and max(asked) > 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("text", [" " * 1_000_000, " " * 5_000_000, " " * 1_000_000 + "x", "\n" * 1_000_000 + " a", "a" + "\t" * 1_200_000, "x" * 5_000_000, "." * 1_000_000, "é" * 1_000_000], ids=lambda t: f"{t[0]!r}x{len(t)}{t[-1]!r}")
def test_very_long_runs_are_the_librarys_ids(text):
    from tokenizers import Tokenizer

    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json"), "<|endoftext|>", 50256)
    assert list(encode(text)) == Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_ids_come_as_arrays():
    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json"), "<|endoftext|>", 50256)
    for text in ("", "a word<|endoftext|>"):
        assert isinstance(encode(text), np.ndarray) and encode(text).dtype == np.uint32


def test_a_text_of_white_space_is_packed(spark):
    rows = packing.best_fit(spark.createDataFrame([(1, " " * 1_000_000 + "x", "", ""), (2, "short", "", "")], DOC), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1_000_001
    assert whole(rows) == 977  # 1,000,001 ids are 976 whole pieces and one of 577, and the short text's two ids have a place


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], DOC), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("byte_bpe_50k.json")).count() == 0
