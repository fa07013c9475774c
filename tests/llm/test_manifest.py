"""Manifest trees against a sequential build of the same trees."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from presslake.llm import merkle

DOC = "doc_id long, source string, lang string, n_chars long, text string, grp string, place int, tree string, row string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    """All levels of a tree, leaves first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def path(tree, i):
    """(place, siblings) by level."""
    out = []
    for level in tree[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((i % 8, [*run[: i % 8], *run[i % 8 + 1 :]]))
        i //= 8
    return out


def leaf_of(row, text):
    fields = [row[0], row[1], row[2], row[3], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def expected(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append((row, leaf_of(row, row[4])))
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append(levels([leaf for _, leaf in by[lang]]))
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, lang in enumerate(langs):
        for i, (row, leaf) in enumerate(by[lang]):
            steps = path(trees[k], i) + path(top, k)
            cur = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                cur = leaf_of(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            for place, own in steps:
                cur = h(*own[:place], cur, *own[place:])
            out.append((row[0], leaf, trees[k][-1][0], top[-1][0], h(*(d for _, own in steps for d in own)), cur, cur == top[-1][0]))
    return out


def table(seed, n, langs):
    rng = random.Random(seed)
    rows = [(None, None, None, None, None), (None, "s", "en", 1, "Null Id"), (1, "s", "en", 0, ""), (1, "s", "en", 0, ""), (2, "s", "en", 3, "ÀBC"), (3, None, "", 2, "Ab" * 100_000), (4, "s", None, 1, "X"), (5, "s", "zz", 2, "one leaf of its own")]
    rows += [(10 + i, rng.choice(["a", "b"]), rng.choice(langs), i, f"Text {rng.random()} É") for i in range(n)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, small=merkle.SMALL):
    docs = spark.createDataFrame([(*r, "g", 1, "t", "r") for r in rows], DOC).repartition(5)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    own = merkle.manifest(docs, F.when(chosen, merkle.lower_ascii(F.col("text"))), small)
    return [tuple(r) for r in merkle.verified(own).collect()]


@pytest.mark.parametrize("n,langs,small", [(0, [], merkle.SMALL), (700, ["en", "en", "en", "en", "de"], merkle.SMALL), (300, [f"l{i}" for i in range(80)], 0), (1500, ["en"], 3)])
def test_equals_sequential_trees(spark, n, langs, small):
    rows = table(n, n, langs)
    assert sorted(result(spark, rows, small), key=repr) == sorted(expected(rows), key=repr)


@pytest.mark.parametrize("n", [1, 9, 65, 513])
def test_sizes_of_one_tree(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    assert sorted(result(spark, rows)) == sorted(expected(rows))


def test_a_proof_is_whole(spark):
    rows = [(i, "s", "en" if i % 3 else "de", i, f"T{i}") for i in range(100)]
    own = merkle.manifest(spark.createDataFrame([(*r, "g", 1, "t", "r") for r in rows], DOC))
    for r in merkle.proofs(own).collect():
        assert merkle.fold(r.leaf, r.proof) == own.root
        assert merkle.fold(h("other"), r.proof) != own.root


def test_children_in_any_order_and_partition_complete_their_parents(spark):
    leaves = [h(str(i)) for i in range(600)]
    rows = [(0, 600, i, d) for i, d in enumerate(leaves)]
    random.Random(1).shuffle(rows)
    runs, roots = merkle.tree(spark.createDataFrame(rows, "grp long, n long, idx long, digest string").repartition(7), 600)
    want = levels(leaves)
    assert [tuple(r) for r in roots.collect()] == [(0, 4, want[-1][0])]
    assert sorted((r.level, r.idx, list(r.digests)) for r in runs.collect()) == sorted((k + 1, i // 8, level[i : i + 8]) for k, level in enumerate(want[:-1]) for i in range(0, len(level), 8))


def test_empty_table(spark):
    assert result(spark, []) == []
