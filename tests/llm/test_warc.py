"""Archives against the pages they were made of, and their bytes against the format."""

import gzip
import hashlib
import random

import pytest

from presslake.llm import warc

PAGE = "page_id long, url string, html string, digest string, number long, file string, offset string"


def pages(spark, rows, parts=4):
    return spark.createDataFrame([(*r, "d", 1, "f", "o") for r in rows], PAGE).coalesce(parts)


def expected(rows):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in groups.items():
        data = html.encode()
        ids.sort(key=lambda v: (v is None, v or 0))
        for k, page_id in enumerate(ids):
            again = len(data) >= 100 and k > 0
            out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=repr)


def table():
    rng = random.Random(3)
    rows = [(None, None, None), (1, "http://a/ b\r\nX: y", ""), (2, None, "x" * 99), (3, "u", "x" * 99), (4, "u", "y" * 100), (5, "v", "y" * 100), (5, "v", "y" * 100), (None, "w", "y" * 100), (6, "u", "Ünï" * 30), (7, "u", "long " * 400_000), (8, "u", "a\r\n\r\nb" * 40), (None, "n", "z" * 200), (None, "n", "z" * 200)]
    rows += [(100 + i, f"http://h/{i}", rng.choice(["copy " * 50, "other " * 40, f"own {i} " * 30])) for i in range(200)]
    rng.shuffle(rows)
    return rows


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


@pytest.mark.parametrize("small,file_bytes", [(warc.SMALL, warc.FILE_BYTES), (0, 2000)])
def test_reads_back_what_was_written(spark, small, file_bytes):
    rows = table()
    archive = warc.write(pages(spark, rows), file_bytes=file_bytes, small=small)
    got = [tuple(r) for r in warc.fetch(archive, archive.index).select(*COLUMNS).collect()]
    assert sorted(got, key=repr) == expected(rows)
    if file_bytes < warc.FILE_BYTES:
        assert archive.index.select("file").distinct().count() > 4


def test_index_names_every_byte_of_the_files(spark):
    rows = table()
    archive = warc.write(pages(spark, rows))
    by = {}
    for r in archive.index.collect():
        by.setdefault(r.file, []).append(r)
    system, path = warc.place(archive.folder)
    for file, own in by.items():
        data, at = system.open_input_file(f"{path}/{file}").read(), 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
            text = gzip.decompress(data[r.offset : at])
            head, block = text.split(b"\r\n\r\n", 1)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
            assert len(block) - 4 == int(head.split(b"Content-Length: ")[1])
            assert b"X: y" not in head.split(b"\r\n")
        assert at == len(data)


def test_selected_records_and_payloads_of_revisits(spark):
    rows = [r for r in table() if r[0] is not None]
    archive = warc.write(pages(spark, rows))
    some = archive.index.filter("page_id % 2 = 0")
    got = sorted((r.asked_by, bytes(r.payload).decode()) for r in warc.payloads(archive, some).collect())
    assert got == sorted((i, html or "") for i, _, html in rows if i % 2 == 0)


def test_near_ranges_are_one_request():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 25, 5), ("a", 1000, 10), ("b", 1010, 10), ("b", 1020, 5000)]
    assert list(warc.requests(ranges, gap=8, most=100)) == [("a", 0, 30, [0, 1, 2, 3]), ("a", 1000, 1010, [4]), ("b", 1010, 1020, [5]), ("b", 1020, 6020, [6])]


def test_damage_is_an_error():
    member = warc.record(1, 0, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parsed(member)


def test_empty_table(spark):
    archive = warc.write(pages(spark, []))
    assert archive.index.count() == 0 and warc.fetch(archive, archive.index).count() == 0
