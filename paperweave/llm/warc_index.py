"""Operator 6: WARC archives written with an index first, read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweave.llm.common import small_batches, table
from paperweave.session import Rounds

MIN_REVISIT_BYTES = 1000
GAP = 64 * 1024
READ = 4 * 1024 * 1024
TASK_BYTES = 16 * 1024 * 1024
LEVEL = 3
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = datetime(2024, 1, 1, tzinfo=timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
OUT_ROWS = 500

INDEX = "page_id long, url string, digest string, record_type string, file string, offset long, length long"
INDEX_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()),
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
RECORDS = ("page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long")
RECORD_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def _one_line(value: str) -> str:
    """A header value without line ends, which would end the header."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _from_line(value: str) -> str:
    """The value that `_one_line` wrote."""
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int, url: str, kind: str, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own."""
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    raw = "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=LEVEL, mtime=0) as member:
        member.write(raw)
    return out.getvalue()


def parse(member: bytes) -> dict:
    """Header fields, and the payload under its stated length."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != VERSION:
        raise ValueError(f"not a record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of another length than stated")
    return fields | {"payload": rest[:size]}


def _page(record_id: str) -> int | None:
    number = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Adds payload (null: empty), size, digest, kind and refers_to to pages (page_id, url, html).

    Of equal payloads of at least MIN_REVISIT_BYTES the one with the largest
    page_id is a response and the others refer to it. The largest is a partial
    aggregate over digests; a digest that many pages share is on the side of
    the join that Spark can split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns(
        {"size": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")}
    )
    large = F.col("size") >= MIN_REVISIT_BYTES
    last = (
        rows.where(large).groupBy("digest", "size").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where(F.col("n") > 1).select("digest", "size", "last")
    )
    marked = rows.join(last, ["digest", "size"], "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return marked.select(
        "page_id", "url", "size", "digest", F.when(again, F.lit("revisit")).otherwise("response").alias("kind"),
        F.when(again, F.col("last")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Writes one archive per task under `folder`; returns the index (page_id, url, digest, record_type, file, offset, length).

    A task names its archive by a new id, so an attempt that is lost or runs
    twice leaves a file that no index row names. Write the index before use:
    it is the list of the records that exist.
    """
    names = ["page_id", "url", "kind", "payload", "size", "digest", "refers_to"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        first = next(batches, None)
        if first is None:
            return
        fs.create_dir(root, recursive=True)
        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in _chained(first, batches):
                rows = []
                for page, url, kind, payload, size, digest, refers in zip(*(batch.column(c).to_pylist() for c in names)):
                    member = record(page, url, kind, payload or b"", size, digest, refers)
                    out.write(member)
                    rows.append({"page_id": page, "url": url, "digest": digest, "record_type": kind, "file": name,
                                 "offset": at, "length": len(member)})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX_SCHEMA)

    small_batches(marked.sparkSession)
    return marked.select(names).mapInArrow(write, INDEX)


def _chained(first, rest):
    yield first
    yield from rest


def coalesced(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, [(offset, length)]) of sorted ranges: near ones are read as one of at most READ bytes or one record."""
    file, start, end, parts = None, 0, 0, []
    for name, offset, length in rows:
        if parts and (name != file or offset - end > GAP or max(end, offset + length) - start > READ):
            yield file, start, end, parts
            parts = []
        if not parts:
            file, start, end = name, offset, offset
        parts.append((offset, length))
        end = max(end, offset + length)
    if parts:
        yield file, start, end, parts


def read_records(selected: DataFrame, folder: str) -> DataFrame:
    """The records that index rows name, parsed from the archives, with their payload.

    Rows are sorted by file and offset over as many tasks as there are TASK_BYTES
    of archives to read, so neighbours meet in one read and one archive may be
    read by many tasks; a task holds one read at a time.
    """
    names = ["file", "offset", "length"]
    size = selected.agg(F.sum("length")).first()[0] or 0
    ordered = selected.select(names).repartitionByRange(max(1, -(-size // TASK_BYTES)), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names)))
        name, source, held = None, None, []
        for file, start, end, parts in coalesced(rows):
            if file != name:
                if source:
                    source.close()
                name, source = file, fs.open_input_file(f"{root}/{file}")
            block = source.read_at(end - start, start)
            for offset, length in parts:
                r = parse(block[offset - start:offset - start + length])
                refers = r.get("WARC-Refers-To")
                held.append({
                    "page_id": _page(r["WARC-Record-ID"]), "url": _from_line(r["WARC-Target-URI"]), "payload": r["payload"],
                    "payload_bytes": int(r["WARC-Payload-Length"]),
                    "payload_digest": r["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": r["WARC-Type"],
                    "refers_to": _page(refers) if refers else None,
                })
                if len(held) == OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=RECORD_SCHEMA)
                    held = []
        if source:
            source.close()
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=RECORD_SCHEMA)

    return ordered.mapInArrow(read, RECORDS)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per row of pages (page_id, url, html) and returns the stored index.

    Null html is an empty payload, a null url empty, a null page_id nameless;
    repeated rows are records of their own; other columns are ignored.
    """
    return Rounds(pages.sparkSession, "warc-index").cut(write_archives(mark_revisits(pages), folder))


def verified(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), measured on the payloads of records read back.

    A revisit holds no payload: its figures are the stated ones, and there must be
    a response of the page that it names with just these; if one has none, an
    error tells how many.
    """
    is_response = F.col("record_type") == "response"
    rows = Rounds(records.sparkSession, "warc-records").cut(records.select(
        "page_id", F.when(is_response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(is_response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to"))
    held = rows.where(is_response).select(
        F.col("page_id").alias("of"), F.col("payload_bytes").alias("bytes"), F.col("payload_digest").alias("digest")).distinct()
    same = F.col("refers_to").eqNullSafe(F.col("of")) & (F.col("payload_bytes") == F.col("bytes")) & (F.col("payload_digest") == F.col("digest"))
    lost = rows.where(~is_response).join(held, same, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} revisit records name no response of their payload")
    return rows


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages, reads all records back, and tells what the archives hold."""
    folder = f"{Rounds(spark, 'warc').base}/archives"
    return verified(read_records(archive(table(spark, sf_dir, "pages"), folder), folder))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
"""
