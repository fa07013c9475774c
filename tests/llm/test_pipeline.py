"""Every stage of the pipeline by its own input, with odd rows, and the whole of it on a small table."""

import random

import pytest

import corpus_pipeline as C
from presslake.llm import quality, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A folder with documents and labels: clean, bad, toxic, copied and secret ones."""
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        bad, toxic = i % 4 == 0, i % 6 == 1
        text = words(60)
        text = text.replace(" ", "$$$ ") if bad else text
        rows.append((i, text + (" you idiot and stupid moron" if toxic else "")))
        labels.append((i, int(not bad), int(toxic)))
    base = words(80)
    rows += [(500 + i, base + f" end {i}") for i in range(5)] + [(600, words(50) + " password=hunter2secret")]
    rows += [(None, None), (None, words(40)), (700, ""), (701, "x y " * 20_000), (600, rows[-1][1])]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", len(t or ""), 0.5, 7) for i, t in rows], DOC)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages_on_their_own_input(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    labels = spark.read.parquet(f"{table}/labels.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, table)
        assert out.columns == docs.columns and out.schema["score"].dataType == docs.schema["score"].dataType
        assert stage(spark, docs.limit(0), table).count() == 0
        ids, all_ids = [r.doc_id for r in out.collect()], [r.doc_id for r in docs.collect()]
        if name == "quality":
            model = quality.train(docs, labels)
            want = [r.doc_id for r in quality.score(docs.select("doc_id", "text"), model).filter("predicted = 1").collect()]
            assert sorted(ids, key=repr) == sorted(want, key=repr) and 160 <= sum(i is not None and i < 240 and i % 4 != 0 for i in ids)
            assert sum(i is not None and i < 240 and i % 4 == 0 for i in ids) < 6
        elif name == "toxicity":
            model = toxicity.train(docs, labels)
            want = [r.doc_id for r in toxicity.score(docs.select("doc_id", "text"), model).filter("predicted = 0").collect()]
            assert sorted(ids, key=repr) == sorted(want, key=repr)
            assert not any(i is not None and i < 240 and i % 6 == 1 for i in ids) and {500, 600, 700, 701} <= set(ids)
        elif name == "near_copies":
            assert sorted(ids, key=repr) == sorted({i for i in all_ids if i not in (501, 502, 503, 504)} | set(), key=repr) + [None] * (all_ids.count(None) - 1)
        else:
            assert sorted(ids, key=repr) == sorted(all_ids, key=repr)
            got = {r.doc_id: r.text for r in out.collect()}
            assert "hunter2secret" not in got[600] and "[SECRET]" in got[600] and got[701] == "x y " * 20_000
    packed = C.STAGES[-1][1](spark, docs, table)
    assert packed.filter("piece = 0").count() == docs.count()


def test_the_whole_pipeline(spark, table):
    rows = C.run(spark, table).collect()
    ids = {r.doc_id for r in rows}
    assert 500 in ids and not ids & {501, 502, 503, 504} and 600 in ids
    assert all(i is None or i >= 240 or i % 6 != 1 for i in ids)
    assert [name for name, _ in C.STAGES] == ["quality", "toxicity", "near_copies", "secrets", "packing"]
