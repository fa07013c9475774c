"""WARC archives: an index of every record, written with the archives, and reads of selected records by byte range.

Pages become records of gzip members, one task's records in its own files. A payload that occurs several
times is stored once: the record with the smallest page_id is the response, others are revisits that
name it and keep the HTTP header (with the payload's length) and the digest only. Which one it is follows
from one grouped minimum over digests; texts are not shuffled unless the repeated digests are more than
a broadcast should hold, and then only with their common ones broadcast.

The index has a row per record: file, offset, length, URL and digest. It is the commit, too: a task that
is run again writes other files, and only the rows of the attempt that Spark keeps name any; files that
no row names may be deleted. A read sorts the selected rows by file and offset and joins ranges that lie
near each other into one request; the records are parsed from the bytes, and digests are checked.

Archives lie in the shared folder, which workers reach by pyarrow's file systems (local, HDFS, S3, ...).

Defined cases: a null html is an empty payload; a null url is left out of the record; control characters
and spaces in a url are percent-encoded in the record, and the index keeps the url as it is; null ids
come last, so that such a page is a response only where all pages of its payload have none, and revisits
of it refer to null; of pages with one id and payload the first in the table's order is the response; an
empty table gives an empty index; other columns are ignored.

``pages`` is read twice and must give its rows in the same order both times: a table, not a shuffle.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslake.llm.common import BATCH_BYTES, prepare
from presslake.llm.ordering import SMALL, attached
from presslake.session import checkpoint, read, shared_folder

#: Least bytes of a payload that is stored once only.
REPEATED_BYTES = 100
#: Bytes from which a task starts another file; gaps that a read takes along, and the most that it takes at once beyond a single record.
FILE_BYTES, GAP_BYTES, READ_BYTES = 1 << 30, 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_number long, number long"


class Archive(NamedTuple):
    folder: str
    index: DataFrame


def record_id(page_id: int | None, number: int) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{number}>"


def parsed_id(value: str | None) -> tuple[int | None, int | None]:
    if not value:
        return None, None
    page_id, number = value[len("<urn:x-page:") : -1].split(":")
    return int(page_id) if page_id else None, int(number)


def encoded(url: str) -> str:
    """A url that can't end its header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, number: int, url: str | None, payload: bytes, digest: str, refers: str | None, date: str = DATE, level: int = 6) -> bytes:
    """A gzip member with a response, or, if ``refers`` names one, a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, number)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {encoded(url)}"] if url is not None else []
    lines += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"] if refers else []
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + packer.flush()


def headers_of(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of a header and where what follows begins."""
    end = data.index(b"\r\n\r\n")
    fields = (line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    return {name.lower(): value for name, value in fields}, end + 4


def parsed(member: bytes) -> tuple[dict, bytes]:
    """A record's columns and its payload, empty for a revisit; a payload that isn't what its digest says is an error."""
    data = zlib.decompress(member, 31)
    fields, start = headers_of(data)
    http, body = headers_of(data[start:])
    payload = data[start + body : start + int(fields["content-length"])]
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    page_id, number = parsed_id(fields["warc-record-id"])
    if fields["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
        raise ValueError(f"record {fields['warc-record-id']}: the payload has another digest")
    refers_to, refers_number = parsed_id(fields.get("warc-refers-to"))
    own = {"page_id": page_id, "url": fields.get("warc-target-uri"), "payload_bytes": int(http["content-length"]), "payload_digest": digest, "record_type": fields["warc-type"], "refers_to": refers_to, "refers_number": refers_number, "number": number}
    return own, payload


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder or file, and its path there."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri) if ":" in uri else f"file://{uri}")


def write(pages: DataFrame, least: int = REPEATED_BYTES, file_bytes: int = FILE_BYTES, small: int = SMALL) -> Archive:
    """Archives of ``pages`` (page_id, url, html) in a new shared folder, with their index."""
    spark = pages.sparkSession
    prepare(spark)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    # the number tells pages of one id and payload apart
    keyed = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.monotonically_increasing_id().alias("number"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "number")).alias("first")
    repeated = keyed.filter(F.octet_length("payload") >= least).groupBy("digest").agg(first, F.count("*").alias("many")).filter("many > 1")
    repeated = checkpoint(repeated.select("digest", F.col("first.page_id").alias("first_id"), F.col("first.number").alias("first_number"), "many"))
    rows = repeated.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    chosen, _ = attached(keyed, repeated, "digest", rows, "left", small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, path = place(folder)
        stem, files, out, size = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0
        try:
            for batch in batches:
                found = []
                for page_id, url, data, digest, number, first_id, first_number in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "number", "first_id", "first_number"))):
                    if out is None or size >= file_bytes:
                        if out is not None:
                            out.close()
                        system.create_dir(path, recursive=True)
                        name, files, size = f"{stem}-{files}.warc.gz", files + 1, 0
                        out = system.open_output_stream(f"{path}/{name}", compression=None)
                    again = first_number is not None and first_number != number
                    member = record(page_id, number, url, data, digest, record_id(first_id, first_number) if again else None)
                    out.write(member)
                    found.append((page_id, url, digest, "revisit" if again else "response", first_id if again else None, name, size, len(member)))
                    size += len(member)
                yield table_of(found, INDEX)
        finally:
            if out is not None:
                out.close()

    columns = ["page_id", "url", "payload", "digest", "number", "first_id", "first_number"]
    chosen.select(*columns).mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return Archive(folder, spark.read.schema(INDEX).parquet(f"{folder}/index"))


TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(field.split() for field in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.record_batch([pa.array(list(c), TYPES[t]) for c, t in zip(columns, types)], names=list(names))


def requests(ranges: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, numbers of its ranges) of sorted (file, offset, length), near ones together."""
    own: list[int] = []
    for i, (file, offset, length) in enumerate(ranges):
        if own and file == at and offset <= end + gap and max(end, offset + length) - start <= most:
            own.append(i)
            end = max(end, offset + length)
            continue
        if own:
            yield at, start, end, own
        at, start, end, own = file, offset, offset + length, [i]
    if own:
        yield at, start, end, own


def fetch(archive: Archive, selected: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of ``selected`` rows of the index, parsed from the archives; with ``payloads`` their bytes, a revisit's none, and the asking page as asked_by."""
    spark, folder = selected.sparkSession, archive.folder
    prepare(spark)
    asks = "asked_by" in selected.columns
    schema = RECORD + (", asked_by long" if asks else "") + (", payload binary" if payloads else "")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = place(folder)
        name, file, last, member = None, None, None, None
        for batch in batches:
            ranges = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            asked = batch.column("asked_by").to_pylist() if asks else None
            out, size = [], 0
            for own, start, end, numbers in requests(ranges):
                if own != name:
                    if file:
                        file.close()
                    name, file = own, system.open_input_file(f"{path}/{own}")
                data = file.read_at(end - start, start)
                for i in numbers:
                    if ranges[i] != last:  # a record that many ask for is parsed once
                        last, member = ranges[i], parsed(data[ranges[i][1] - start : ranges[i][1] - start + ranges[i][2]])
                    row = (*member[0].values(), *((asked[i],) if asks else ()), *((member[1],) if payloads else ()))
                    out.append(row)
                    size += len(member[1]) if payloads else 0
                if size > BATCH_BYTES:
                    yield table_of(out, schema)
                    out, size = [], 0
            yield table_of(out, schema)
        if file:
            file.close()

    columns = ["file", "offset", "length", *(["asked_by"] if asks else [])]
    return selected.select(*columns).repartitionByRange(partitions, *columns).sortWithinPartitions(*columns).mapInArrow(run, schema)


def payloads(archive: Archive, selected: DataFrame, small: int = SMALL) -> DataFrame:
    """(asked_by, page_id, payload) of the selected index rows: a revisit's payload is read from the record that it refers to."""
    digests = checkpoint(selected.filter("record_type = 'revisit'").groupBy("digest").agg(F.count("*").alias("many")))
    rows = digests.agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    stored, _ = attached(archive.index.filter("record_type = 'response'").select("digest", "file", "offset", "length"), digests, "digest", rows, small=small)
    # small payloads can have several responses; any is the payload
    stored = stored.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("at")).join(digests, "digest")
    revisits = selected.filter("record_type = 'revisit'").select(F.col("page_id").alias("asked_by"), "digest")
    found, _ = attached(revisits, checkpoint(stored), "digest", rows, small=small)
    own = selected.filter("record_type = 'response'").select(F.col("page_id").alias("asked_by"), "file", "offset", "length")
    return fetch(archive, own.unionByName(found.select("asked_by", "at.*")), payloads=True).select("asked_by", "page_id", "payload")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = write(read(spark, sf_dir, "pages"))
    return fetch(archive, archive.index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT r, page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
g AS (SELECT *, payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r) > 1 AS again, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN least END AS refers_to FROM g"""
