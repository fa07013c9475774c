"""Tables kept by streams and SQL dumps: replays, failures on the way, and what the merges make of a history."""

import re
import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presslake.sources import dumps
from presslake.streaming import upserts

T0 = datetime(2024, 1, 1)
ITEM = "story string, match string, hash string, title string, body string, modified timestamp, seen timestamp"
RUN = "source string, at timestamp, status string, item string, published timestamp"


def item(story, match, hash_, minute, modified=None):
    return story, match, hash_, f"t{hash_}", f"b{hash_}", modified and T0 + timedelta(days=modified), T0 + timedelta(minutes=minute)


HISTORY = [
    item("s1", "canonical_url", "a", 1, 1), item("s2", "rss_guid", "x", 2), item("s1", "canonical_url", "a", 3, 1), item("s1", "title_similarity", "c", 4, 9), item("s1", "canonical_url", "b", 5, 1),
    item("s2", "rss_guid", "x", 6, 2), item("s3", "content_hash", "q", 7), item("s3", "event_similarity", "r", 8), item("s1", "canonical_url", "b", 9, 3), item("s2", "rss_guid", "y", 10),
]


def by_hand(history):
    known = {}
    for story, match, hash_, _, _, modified, _ in history:
        if story not in known:
            known[story] = [hash_, modified, 1]
            continue
        own = known[story]
        newer = modified is not None and (own[1] is None or modified > own[1])
        if match not in ("event_similarity", "title_similarity", "normalized_title", "content_hash") and (hash_ != own[0] or newer):
            own[0], own[1], own[2] = hash_, max(filter(None, (modified, own[1])), default=None), own[2] + 1
    return {s: (h, v) for s, (h, _, v) in known.items()}


@pytest.mark.parametrize("size", [3, len(HISTORY)])
def test_batches_of_any_size_and_replays_give_one_table(spark, tmp_path, size):
    table = upserts.Table(spark, str(tmp_path / "t"), "story", upserts.ARTICLE, 4)
    for n, k in enumerate(range(0, len(HISTORY), size)):
        rows = spark.createDataFrame(HISTORY[k : k + size], ITEM)
        assert table.apply(rows, n, upserts.updated_articles)
        assert not table.apply(rows, n, upserts.updated_articles)
    found = {r.story: (r.hash, r.version) for r in table.read().collect()}
    assert found == by_hand(HISTORY)
    before = table.read().orderBy("story").collect()
    table.compact()
    assert table.read().orderBy("story").collect() == before


def test_a_batch_that_failed_is_as_if_it_were_not_there(spark, tmp_path):
    table = upserts.Table(spark, str(tmp_path / "t"), "story", upserts.ARTICLE, 4)
    table.apply(spark.createDataFrame(HISTORY[:2], ITEM), 0, upserts.updated_articles)
    table.apply(spark.createDataFrame(HISTORY[2:5], ITEM), 1, upserts.updated_articles)
    (tmp_path / "t" / "batch=1" / "_SUCCESS").unlink()
    assert {r.story: r.version for r in table.read().collect()} == {"s1": 1, "s2": 1}
    assert table.apply(spark.createDataFrame(HISTORY[2:5], ITEM), 1, upserts.updated_articles)
    assert {r.story: (r.hash, r.version) for r in table.read().collect()} == by_hand(HISTORY[:5])


def test_source_states_by_a_stream(spark, tmp_path):
    runs = [("a", T0, "Healthy", "i1", T0), ("a", T0 + timedelta(hours=1), "Failed", "", None), ("b", T0, "Degraded", None, None), ("a", T0 + timedelta(hours=2), "Degraded", "i2", T0 + timedelta(hours=1)), ("b", T0 + timedelta(hours=3), "Failed", "k", None), ("a", T0 + timedelta(hours=4), "Healthy", None, None)]
    source = str(tmp_path / "in")
    for r in runs:
        spark.createDataFrame([r], RUN).coalesce(1).write.mode("append").parquet(source)
    table = upserts.Table(spark, str(tmp_path / "t"), "source", upserts.SOURCE, 2)
    for _ in range(2):
        stream = spark.readStream.schema(RUN).option("maxFilesPerTrigger", 2).parquet(source)
        query = upserts.keep_updated(stream, table, upserts.updated_sources, str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    found = {r.source: r for r in table.read().collect()}
    assert (found["a"].runs, found["a"].failures, found["a"].health, found["a"].last_item) == (4, 0, "Healthy", "i2")
    assert (found["b"].runs, found["b"].failures, found["b"].health, found["b"].last_item, found["b"].last_success) == (2, 2, "Failed", "k", None)
    assert found["a"].last_success == T0 + timedelta(hours=4) and found["a"].last_published == T0 + timedelta(hours=1)


def test_a_dump_is_whole_batches_that_a_database_reads(spark, tmp_path):
    dumps.register(spark)
    rows = [(i, f"it's {i}" if i % 3 else None, i / 4, i % 2 == 0, [i]) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, title string, score double, live boolean, tags array<long>").repartition(3)
    df.write.format("sqldump").option("table", "articles").mode("append").save(str(tmp_path / "d"))
    files = sorted((tmp_path / "d").glob("*.sql"))
    assert len(files) == 3 and not list((tmp_path / "d").glob("_passing*"))
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE articles (id INTEGER PRIMARY KEY, title TEXT, score REAL, live INTEGER, tags TEXT)")
    for file in files:
        text = file.read_text()
        assert all(b.count("INSERT") <= 50 and b.rstrip().endswith("COMMIT;") for b in text.split("BEGIN;\n")[1:])
        con.executescript(text)
    assert con.execute("SELECT id, title, score, live FROM articles ORDER BY id").fetchall() == [(i, t, s, int(v)) for i, t, s, v, _ in rows]
    df.limit(10).coalesce(1).write.format("sqldump").option("table", "articles").mode("overwrite").save(str(tmp_path / "d"))
    [file] = (tmp_path / "d").glob("*.sql")
    assert len(re.findall("INSERT", file.read_text())) == 10


def test_a_task_that_fails_leaves_no_half_batch(spark, tmp_path):
    dumps.register(spark)
    bad = spark.range(400).repartition(4).select("id", F.when(F.col("id") == 399, F.raise_error(F.lit("broken row"))).otherwise("x").alias("title"))
    with pytest.raises(Exception, match="broken row"):
        bad.write.format("sqldump").option("table", "articles").mode("append").save(str(tmp_path / "d"))
    assert not list((tmp_path / "d").glob("*.sql"))
    with pytest.raises(Exception, match="plain SQL name"):
        spark.range(3).write.format("sqldump").option("table", "a; DROP").mode("append").save(str(tmp_path / "e"))
