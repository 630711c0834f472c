"""WARC archives: writing, normalising monolithic gzip, and reading by index (operator 7).

``write`` makes archives that are compressed as one gzip stream over the whole
file, as many tools leave them; no record of those can be reached without
inflating all before it.  ``normalise`` inflates each such stream once, front to
back, writes every record as a gzip member of its own, and beside the archives a
sidecar index with the offset and length of each member.  ``read`` fetches the
records through that index.

All files are written by Spark's text writer, so any store that Spark writes to
will do: a row is a member, and the separator between rows is the empty gzip
member, which inflates to nothing.  The archives are plain multi-member gzip.

Defined results: a null page text is an empty payload; a null URL gives a record
without target; line breaks in URLs are percent-encoded.  Among records of equal
payload the largest page id is the response (null ids are always responses and
never referred to); rows that repeat the largest id are responses too.  A stream
that ends early (be it in its trailer, or between two records) or breaks, and an
empty file, give their whole records and one index row of type ``damaged``
without member.  An archive's compressed bytes are read as one value
(up to 2 GB), its inflated bytes as a stream; so memory is bounded by the archive
size, which ``records_per_archive`` limits, and the largest record.  Further
columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import as_bytes, checkpoint, column, remove, scratch, ship_library, steps, table

#: Payloads of at least so many bytes are deduplicated.
MIN_REVISIT_BYTES = 0
RECORDS_PER_ARCHIVE = 2_000
#: The date of records whose table has none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
URN = "urn:x-page:"
#: An empty gzip member, as separator between rows.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 3, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
_CHUNK = 1 << 16
_ARCHIVE, _INDEX = 0, 1


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit that carries the HTTP header only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Header fields (lower-case names), HTTP header fields and payload of a record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return {"fields": fields, "http": _fields(http), "payload": payload}


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def records(content: bytes) -> Iterator[bytes]:
    """The records of a gzip file of one or many members, inflated once from front to back; ValueError at damage."""
    buffer, inflater, at = bytearray(), zlib.decompressobj(31), 0
    need = None  # bytes of the record that begins the buffer, once its header is known
    view, read_to, whole = memoryview(content), 0, False
    while True:
        while True:
            if need is None and (end := buffer.find(b"\r\n\r\n", at)) >= 0:
                length = _fields(bytes(buffer[:end])).get("content-length", "")
                if not buffer.startswith(b"WARC/") or not length.isdigit():
                    raise ValueError("not a WARC record")
                need = end + 4 + int(length) + 4
            elif need is None:
                at = max(0, len(buffer) - 3)
            if need is None or len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need, at = None, 0
        if inflater.eof:  # the next member begins where this one ended
            read_to -= len(inflater.unused_data)
            inflater, whole = zlib.decompressobj(31), True
        if read_to >= len(view):
            break
        try:
            buffer += inflater.decompress(view[read_to : read_to + _CHUNK])
        except zlib.error as e:
            raise ValueError(str(e)) from e
        read_to, whole = read_to + len(view[read_to : read_to + _CHUNK]), False
    if buffer:
        raise ValueError("the stream ends within a record")
    if not whole:  # also where all records came out: the checksum was never reached
        raise ValueError("the stream ends before its trailer" if content else "the file is empty")


def write(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives of pages (page_id, url, html), each one gzip stream over the whole file.

    The newest page of each payload is found among ids and SHA-256 digests alone;
    payloads are dealt by (id, digest), so pages of one common payload lie in all
    tasks, and those without an id are not dealt at all.
    """
    ship_library(pages.sparkSession)
    rows = pages.selectExpr("CAST(page_id AS LONG) AS page_id", "url", "CAST(coalesce(html, '') AS BINARY) AS payload").withColumn("same", F.sha2("payload", 256))
    named = rows.filter("page_id IS NOT NULL")
    ids = checkpoint(named.select("page_id", "same", (F.length("payload") >= min_revisit_bytes).alias("may")))
    newest = ids.filter("may").groupBy("same").agg(F.max("page_id").alias("newest"))
    older = ids.filter("may").join(newest, "same").filter("page_id < newest").groupBy("page_id", "same").agg(F.max("newest").alias("refers_to"))
    fields = ["page_id", "url", "payload", "refers_to"]
    nameless = rows.filter("page_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    marked = named.join(older, ["page_id", "same"], "left").select(fields).unionByName(nameless.select(fields))

    def run(batches):
        for b in steps(batches, "payload"):
            made = [record(*r) for r in zip(column(b, "page_id").to_pylist(), column(b, "url").to_pylist(), column(b, "payload").to_pylist(), column(b, "refers_to").to_pylist())]
            # the writer adds a line feed to each row: the last byte of a record
            yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], ["value"])

    lines = marked.mapInArrow(run, "value binary").selectExpr("CAST(value AS STRING) AS value")
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def normalise(spark: SparkSession, source: str, target: str, pattern: str = "*.gz") -> None:
    """Rewrites the gzip archives in a folder as archives of one member a record, with a sidecar index.

    One pass and one job: each stream is inflated once, and the task that does so
    writes the archive (``kind=0/archive=...``) and its index (``kind=1/archive=...``).
    """
    ship_library(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(source)
    files = files.select(F.xxhash64("path").alias("archive"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    # Spark's scans leave empty files out: they are those that are listed only
    listed = spark.createDataFrame([(unquote(f.rsplit("/", 1)[-1]),) for f in files.inputFiles()], "name string")
    empty = listed.join(files.select("name"), "name", "left_anti")
    files = files.unionByName(empty.select(F.xxhash64("name").alias("archive"), "name", F.lit(b"").alias("content")))

    def run(batches):
        for b in batches:
            for archive, name, content in zip(column(b, "archive").to_pylist(), column(b, "name").to_pylist(), as_bytes(b, "content")):
                out, held, offset, seq = [], 0, 0, 0
                found = records(content)
                while True:
                    entry = {"file": name, "record": seq, "offset": None, "length": None, "id": None, "type": "damaged"}
                    try:
                        raw = next(found)
                    except StopIteration:
                        break
                    except ValueError as e:
                        out.append((_INDEX, archive, seq, _line(entry | {"error": str(e)})))
                        break
                    fields = _fields(raw.partition(b"\r\n\r\n")[0])
                    member = gzip.compress(raw, mtime=0)
                    entry |= {"offset": offset, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}
                    out += [(_ARCHIVE, archive, seq, member), (_INDEX, archive, seq, _line(entry))]
                    offset, seq, held = offset + len(member) + len(EMPTY_MEMBER), seq + 1, held + len(member)
                    if held >= 4 << 20:
                        yield _rows(out)
                        out, held = [], 0
                if out:
                    yield _rows(out)

    members = files.mapInArrow(run, "kind long, archive long, seq long, member binary")
    ordered = members.sortWithinPartitions("kind", "archive", "seq").selectExpr("CAST(member AS STRING) AS value", "kind", "archive")
    writer = ordered.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.partitionBy("kind", "archive").text(target)


def _line(entry: dict) -> bytes:
    return gzip.compress(json.dumps(entry).encode() + b"\n", mtime=0)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "archive", "seq", "member"])


def _files(spark: SparkSession, target: str, kind: int) -> DataFrame:
    """(archive, content) of the files of a kind."""
    ship_library(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(target)
    found = found.filter(F.col("path").contains(f"/kind={kind}/"))
    return found.select(F.regexp_extract("path", r"/archive=(-?\d+)/", 1).cast("long").alias("archive"), "content")


def index(spark: SparkSession, target: str) -> DataFrame:
    """The sidecar index: archive, file, record, offset, length, id, type."""

    def run(batches):
        for b in batches:
            for archive, content in zip(column(b, "archive").to_pylist(), as_bytes(b, "content")):
                e = [json.loads(x) for x in gzip.decompress(content).splitlines()]
                if e:
                    cols = [[archive] * len(e), *([x[k] for x in e] for k in ("file", "record", "offset", "length", "id", "type"))]
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = ["archive", "file", "record", "offset", "length", "id", "type"]
    return _files(spark, target, _INDEX).mapInArrow(run, "archive long, file string, record long, offset long, length long, id string, type string")


def read(spark: SparkSession, target: str) -> DataFrame:
    """The records, each fetched by its index entry.

    record_id, url, record_type, refers_to, payload binary (null for revisits),
    payload_bytes, payload_digest (bare): of the payload itself for responses, as
    the headers say for revisits.  An entry whose member holds another record fails the job.
    """
    entries = index(spark, target).filter("length IS NOT NULL").groupBy("archive").agg(F.collect_list(F.struct("offset", "length", "id")).alias("entries"))
    joined = _files(spark, target, _ARCHIVE).join(entries, "archive").select("content", "entries")
    names = ["record_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string())

    def run(batches):
        for b in batches:
            for content, entries in zip(as_bytes(b, "content"), column(b, "entries").to_pylist()):
                out, held = [], 0
                for e in entries:
                    r = parse(zlib.decompress(content[e["offset"] : e["offset"] + e["length"]], 31))
                    f, payload = r["fields"], r["payload"]
                    if f.get("warc-record-id") != e["id"]:
                        raise ValueError(f"the index names {e['id']}, the member holds {f.get('warc-record-id')}")
                    revisit = f["warc-type"] == "revisit"
                    size = int(r["http"]["content-length"]) if revisit else len(payload)
                    digest = f["warc-payload-digest"].partition(":")[2] if revisit else payload_digest(payload)
                    out.append((e["id"], f.get("warc-target-uri"), f["warc-type"], f.get("warc-refers-to"), None if revisit else payload, size, digest))
                    held += len(payload)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return joined.mapInArrow(run, "record_id string, url string, record_type string, refers_to string, payload binary, payload_bytes long, payload_digest string")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams, archives = scratch(spark, "warc-streams"), scratch(spark, "warc")
    write(table(spark, sf_dir, "pages"), streams)
    normalise(spark, streams, archives)
    remove(spark, streams)
    page = lambda c: F.regexp_extract(c, rf"<{URN}(-?\d+)>", 1).try_cast("long")
    return read(spark, archives).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


QUERIES = {"op7_warc": op7_warc}
