"""Stateful streams against the same operators over tables, and against plain Python; micro-batches of several sizes, out of order and late rows."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from presslake.operators import duplicates, monitoring, scan
from presslake.streaming import duplicates as stream_duplicates
from presslake.streaming import expiry, monitor

T0 = datetime(2024, 1, 1)
STATUSES = ["Active", "Updated", "Removed", "Unavailable", "Redirected", "Temporarily Unreachable"]


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replayed(spark, tmp_path, rows, schema, size, flow):
    """Rows that ``flow`` gives for a stream of ``rows`` in micro-batches of ``size``."""
    source = str(tmp_path / f"in{size}")
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    name = f"out_{random.randrange(10**9)}"
    query = flow(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"state{size}")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.table(name)


def swapped(rows, width, seed):
    """Rows out of order, each at most ``width`` places from its own."""
    rng, rows = random.Random(seed), list(rows)
    for k in range(0, len(rows), width):
        part = rows[k : k + width]
        rng.shuffle(part)
        rows[k : k + width] = part
    return rows


CHECK = "page string, ts timestamp_ntz, number long, status string, initial string, ok boolean"


def history(n, pages, seed, step=20):
    rng = random.Random(seed)
    first = {p: rng.choice(["published", "review", "draft"]) for p in range(pages)}
    out = []
    for i in range(n):
        p = rng.choice([0, rng.randrange(pages)])
        out.append((f"p{p}", T0 + timedelta(minutes=step * i), i, rng.choice([*STATUSES, None]), first[p], rng.random() < 0.8))
    return out


def folded(rows):
    states, out = {}, []
    for page, at, number, status, initial, ok in sorted(rows, key=lambda r: (r[1] is not None, r[1] or T0, r[2])):
        s = states.setdefault(page, {"status": None, "attempts": 0, "failures": 0, "pub": initial, "prev": None, "gone": None})
        temporary, removed = status in ("Unavailable", "Temporarily Unreachable"), status == "Removed"
        restoring = (s["status"] == "Removed" or s["prev"]) and not removed and not temporary and ok
        previous = s["prev"] or s["pub"]
        following = "review" if removed else "published" if restoring and previous == "published" else s["pub"]
        hidden, restored = removed and s["pub"] == "published", bool(restoring and following == "published")
        s["prev"] = previous if removed else None if restoring else s["prev"]
        s["gone"] = at if removed else None if restoring else s["gone"]
        s.update(status=status, attempts=s["attempts"] + 1, failures=s["failures"] + 1 if temporary else 0, pub=following)
        out.append((page, number, s["attempts"], s["failures"], s["pub"], s["prev"], s["gone"], hidden, restored))
    return sorted(out)


COLUMNS = ["page", "number", *monitoring.STATE]


def test_page_states_equal_a_fold(spark):
    rows = history(400, 6, 1) + [("p0", None, 1000, "Removed", None, True)]
    rows = [(*r[:4], next(x[4] for x in rows if x[0] == r[0]), r[5]) for r in rows]
    for span in ("hour", "day", "year"):
        got = monitoring.page_states(spark.createDataFrame(rows, CHECK).repartition(3), "page", "ts", "number", "status", F.col("initial"), F.col("ok"), span)
        assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == folded(rows)
    with pytest.raises(ValueError, match="attempts"):
        monitoring.page_states(got, "page", "ts", "number", "status", F.col("initial"))


@pytest.mark.parametrize("size", [25, 121])
def test_page_monitor_equals_the_table_for_any_batches(spark, tmp_path, size):
    rows = history(120, 4, 2)
    sent = [*swapped(rows, 4, 3), ("end", T0 + timedelta(days=60), 0, "Active", "published", True)]
    flow = lambda s: monitor.monitored(s, "page", "ts", "number", "status", F.col("initial"), F.col("ok"), "2 hours")
    got = replayed(spark, tmp_path, sent, CHECK, size, flow).filter("page <> 'end'").withColumn("removed_at", F.col("removed_at").cast("timestamp_ntz"))
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == folded(rows)


def test_a_late_check_changes_nothing(spark, tmp_path):
    rows = [("p", T0, 0, "Active", "published", True), ("p", T0 + timedelta(days=2), 1, "Removed", "published", True), ("x", T0 + timedelta(days=3), 2, "Active", "published", True), ("p", T0 + timedelta(days=1), 3, "Active", "published", True), ("p", T0 + timedelta(days=4), 4, "Redirected", "published", True), ("x", T0 + timedelta(days=9), 5, "Active", "published", True)]
    got = replayed(spark, tmp_path, rows, CHECK, 1, lambda s: monitor.monitored(s, "page", "ts", "number", "status", F.col("initial"), F.col("ok"), "1 hour"))
    mine = {r.number: r for r in got.filter("page = 'p'").collect()}
    assert sorted(mine) == [0, 1, 4]
    assert (mine[1].publication, mine[1].previous, mine[1].hidden) == ("review", "published", True)
    assert (mine[4].publication, mine[4].previous, mine[4].restored) == ("published", None, True)


STORY = "number long, ts timestamp_ntz, category string, title string, url string, hash string"


def stories(n, seed, minutes=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    return [(i, T0 + timedelta(minutes=minutes * i), rng.choice(["a", "a", "b", None]), " ".join(rng.sample(words, 6)), rng.choice(["", None, f"u{rng.randrange(40)}"]), f"h{rng.randrange(60)}") for i in range(n)]


def decided(rows, hours=36, most=80, least=82):
    kept, out = {}, []
    for number, at, category, title, url, hash_ in sorted(rows, key=lambda r: (r[1], r[0])):
        mine, own = kept.setdefault(category, []), set(title.split())
        near = [k for k in mine if at - k[1] <= timedelta(hours=hours)]
        hit = None
        for tier, score, i, value in (("canonical_url", 100, 4, url), ("content_hash", 98, 5, hash_)):
            same = [k for k in near if value and k[i] == value]
            if same:
                hit = tier, same[-1][0], score
                break
        if hit is None:
            best = None
            for k in near[-most:]:
                other = set(k[3].split())
                one = math.floor(len(own & other) * 100 / max(len(own), len(other)) + 0.5), k[1], k[0]
                best = max(best or one, one)
            if best and best[0] >= least:
                hit = "title_similarity", best[2], best[0]
        if hit is None:
            mine.append((number, at, category, title, url, hash_))
        out.append((number, *(hit or (None, None, None))))
    return sorted(out)


def tiers():
    return {"canonical_url": F.col("url"), "content_hash": F.col("hash")}


@pytest.mark.parametrize("partitions", [1, 13])
def test_first_writers_equal_a_fold(spark, partitions):
    rows = stories(500, 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = duplicates.first_writers(spark.createDataFrame(swapped(rows, 500, 1), STORY), "number", "ts", "category", "title", tiers())
        assert sorted(tuple(r) for r in got.collect()) == decided(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("size", [40, 151])
def test_stream_of_first_writers_equals_the_table(spark, tmp_path, size):
    rows = [r for r in stories(150, 5, 70) if r[2]]
    sent = [*swapped(rows, 3, 1), (9999, T0 + timedelta(days=90), "z", "end", None, "end")]
    got = replayed(spark, tmp_path, sent, STORY, size, lambda s: stream_duplicates.first_writers(s, "number", "ts", "category", "title", tiers(), "4 hours"))
    rows_out = [tuple(r) for r in got.filter("category <> 'z'").select("number", "tier", "original", "score").collect()]
    assert sorted(rows_out) == decided(rows)


def test_near_titles_see_the_newest_only(spark):
    rows = [(i, T0 + timedelta(minutes=i), "a", "same six words in every title" if i in (0, 99) else f"x{i} y{i} z{i}", None, None) for i in range(100)]
    df = spark.createDataFrame(rows, STORY)
    assert duplicates.near_titles(df, "number", "ts", "category", "title").count() == 0
    assert [tuple(r) for r in duplicates.near_titles(df, "number", "ts", "category", "title", most=99).collect()] == [(99, 0, 100)]


def test_an_ordered_scan_is_right_even_where_the_state_never_forgets(spark):
    class Sum:
        state = 0

        def step(self, row):
            self.state += row[1]
            return [(row[0], row[2], self.state)]

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(100), i) for i in range(300)]
    got = scan.ordered_scan(spark.createDataFrame(rows, "grp string, value long, n long").repartition(5), "grp", ["n"], Sum, "grp string, n long, total long")
    sums, want = {}, []
    for grp, value, n in rows:
        sums[grp] = sums.get(grp, 0) + value
        want.append((grp, n, sums[grp]))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert scan.ordered_scan(spark.createDataFrame([], "grp string, value long, n long"), "grp", ["n"], Sum, "grp string, n long, total long").count() == 0


def test_breaking_stories_expire_and_a_later_sighting_moves_the_end(spark, tmp_path):
    rows = [("a", T0), ("b", T0 + timedelta(hours=1)), ("a", T0 + timedelta(hours=6)), ("b", T0), ("z", T0 + timedelta(hours=40)), ("a", T0 + timedelta(hours=41)), ("z", T0 + timedelta(hours=90)), ("z", T0 + timedelta(hours=91))]
    schema = "story string, ts timestamp_ntz"
    flow = lambda s: expiry.breaking_expiry(s, "story", "ts", "1 hour")
    hours = lambda at: round((at - T0).total_seconds() / 3600)
    ends = lambda df: sorted((r.story, hours(r.until), r.sightings) for r in df.filter("story <> 'z'").withColumn("until", F.col("until").cast("timestamp_ntz")).collect())
    assert ends(flow(spark.createDataFrame(rows, schema))) == [("a", 18, 2), ("a", 53, 1), ("b", 13, 2)]
    assert ends(replayed(spark, tmp_path, rows, schema, 3, flow)) == [("a", 18, 2), ("a", 53, 1), ("b", 13, 2)]


def test_local_days_of_23_and_25_hours_and_late_rows(spark, tmp_path):
    zone = "America/New_York"
    spring, autumn = datetime(2024, 3, 9, 12), datetime(2024, 11, 2, 12)
    rows = [("c", at + timedelta(minutes=30 * i)) for at in (spring, autumn) for i in range(3 * 48)]
    schema = "category string, ts timestamp_ntz"
    want = {(str(r.day)): ((r.ends - r.begins) / 3.6e9, r.n) for r in expiry.local_day_counts(spark.createDataFrame(rows, schema), "category", "ts", zone).collect()}
    assert want["2024-03-10"] == (23, 46) and want["2024-11-03"] == (25, 50) and want["2024-03-11"] == (24, 48)
    late = [*rows[:144], ("c", datetime(2024, 3, 11, 1)), ("c", datetime(2024, 3, 12, 11)), *rows[144:], ("z", datetime(2025, 1, 1))]
    got = replayed(spark, tmp_path, late, schema, 48, lambda s: expiry.local_days(s, "category", "ts", zone, "2 hours")).filter("category = 'c'")
    closed = {str(r.day): ((r.ends - r.begins) / 3.6e9, r.n) for r in got.collect()}
    # the first came after its day was closed, the second in time
    assert closed == want | {"2024-03-12": (24, want["2024-03-12"][1] + 1)}
