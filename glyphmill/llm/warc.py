"""WARC archives: a writer with revisit records, and a splittable reader.

Each record is a gzip member of its own. The reader cuts archives into byte ranges; a task looks for
gzip magic in its range, takes a place for a record only if a member there decodes to a WARC header,
and owns the records that start inside, whose ends may lie beyond. No index is needed and an archive
of any size is read by many tasks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, lean, materialize, scratch_dir

MIN_REVISIT = 100
MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


def _headers(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _quoted(url: str | None) -> str:
    """A url on one header line: control characters, spaces and % as %-escapes of their UTF-8 bytes."""
    return re.sub(r"[\x00-\x20%\x7f-\x9f\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def _member(page: int | None, url: str | None, html: bytes, digest: str, refers: int | None) -> bytes:
    fields = [
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>" if page is None else f"<urn:page:{page}>"),
        *([] if url is None else [("WARC-Target-URI", _quoted(url))]),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(html))),
    ]
    if refers is None:
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        raw = _headers("response", [*fields, ("Content-Type", "application/http; msgtype=response")], http + html)
    else:
        raw = _headers("revisit", [*fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers}>")], b"")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``) below ``path``; returns (``path``, ``length``, ``records``).

    The payload is the html in UTF-8, empty for null. Of equal payloads of at least 100 bytes the one
    with the smallest page_id is a response and the others are revisits of it; smaller ones are all
    responses, and so is every row of that smallest page_id if it is repeated. A null page_id is
    written under a generated record id and read as null; it comes after all others, so such a page
    is a revisit of an equal payload's smallest page_id and a response if there is none. Each task
    writes one file under a name of its own and renames it when it is whole. The returned table is the
    manifest: it is committed with Spark's own rules and names one file for each task, so what a
    failed, lost or speculative attempt has left below ``path`` is in no row of it and is not read.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    seen = rows.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size")).where(F.col("size") >= MIN_REVISIT)
    shared = seen.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"), F.bool_or(F.col("page_id").isNull()).alias("unnamed")).where("last > refers_to or (unnamed and refers_to is not null)").select("digest", "refers_to")
    revisits = seen.join(shared, "digest").where("not (page_id <=> refers_to)").select(F.col("page_id").alias("later"), F.col("digest").alias("equal"), "refers_to").distinct()
    digested = rows.withColumn("digest", F.sha2("html", 256)).join(revisits, F.col("page_id").eqNullSafe(F.col("later")) & (F.col("digest") == F.col("equal")), "left").select("page_id", "url", "html", "digest", "refers_to")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, n = None, f"{path}/part-{uuid.uuid4().hex}.warc.gz", 0
        files, inner = _filesystem(name)
        for batch in it:
            for at in range(0, batch.num_rows, 64):
                for r in batch.slice(at, 64).to_pylist():
                    if out is None:
                        files.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        out = files.open_output_stream(inner + ".part")
                    out.write(_member(r["page_id"], r["url"], r["html"], r["digest"], r["refers_to"]))
                    n += 1
        if out is not None:
            out.close()
            files.move(inner + ".part", inner)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([files.get_file_info(inner).size], pa.int64()), pa.array([n], pa.int64())], names=["path", "length", "records"])

    return materialize(digested.mapInArrow(lean(run), "path string, length long, records long"))


class _Member:
    """One gzip member, decoded as far as asked for."""

    def __init__(self, source, offset: int, size: int) -> None:
        self.source, self.next, self.size = source, offset, size
        self.gzip = zlib.decompressobj(31)
        self.data = bytearray()

    def more(self, wanted: int) -> bool:
        """Decode until ``wanted`` bytes are there or the member ends; false if it is broken or cut off."""
        while len(self.data) < wanted and not self.gzip.eof:
            raw = self.gzip.unconsumed_tail
            if not raw:
                if self.next >= self.size:
                    return False
                raw = self.source.read_at(min(1 << 16, self.size - self.next), self.next)
                self.next += len(raw)
            try:
                self.data += self.gzip.decompress(raw, max(1, wanted - len(self.data)))
            except zlib.error:
                return False
        return True


def _record(source, offset: int, size: int) -> dict | None:
    """The record that starts at ``offset``; None if no whole record does."""
    member = _Member(source, offset, size)
    if not member.more(7) or not member.data.startswith(b"WARC/1."):
        return None
    wanted = 1024
    while (end := member.data.find(b"\r\n\r\n")) < 0:  # a header is as long as its url
        if member.gzip.eof or not member.more(wanted):
            return None
        wanted *= 2
    fields = dict(line.split(": ", 1) for line in member.data[:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    try:
        length = int(fields["Content-Length"])
    except (KeyError, ValueError):
        return None
    if not member.more(end + 4 + length + 5) or len(member.data) < end + 4 + length:
        return None
    return fields | {"block": bytes(member.data[end + 4 : end + 4 + length])}


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(found[1]) if found else None


def _unquoted(url: str | None) -> str | None:
    return None if url is None else re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url.encode()).decode("utf-8", "replace")


def read_archives(spark: SparkSession, archives: DataFrame | str, split_bytes: int = 16 << 20) -> DataFrame:
    """Records (``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``url``, ``payload``) of ``archives``.

    ``archives`` is a manifest (``path``, ``length``), or a folder all of whose ``*.warc.gz`` are read.
    Bytes and digest of a response are those of its payload as read; a revisit has no payload and
    they are those its header states. Ranges of ``split_bytes`` are dealt evenly, a task for each up
    to 100,000, whatever the sizes of the files. Bytes that look like a member but don't decode to a
    whole record are passed over.
    """
    if isinstance(archives, str):
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(archives)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = archives.select("path", "length", F.explode(starts).alias("start"))
    tasks = archives.select(F.sum(F.size(starts))).first()[0] or 1
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                files_, inner = _filesystem(r["path"])
                end = min(r["length"], r["start"] + split_bytes)
                with files_.open_input_file(inner) as source:
                    data = source.read_at(min(r["length"], end + len(MAGIC) - 1) - r["start"], r["start"])
                    rows, size, at = [], 0, data.find(MAGIC)
                    while 0 <= at < end - r["start"]:
                        found = _record(source, r["start"] + at, r["length"])
                        if found:
                            rows.append(_row(found))
                            size += len(rows[-1]["payload"] or b"")
                            if size > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, size = [], 0
                        at = data.find(MAGIC, at + 1)
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.repartition(min(int(tasks), 100_000)).mapInArrow(lean(run), RECORD)


def _row(fields: dict) -> dict:
    payload = None
    if fields["WARC-Type"] == "response":
        payload = fields["block"].split(b"\r\n\r\n", 1)[1]
    return {
        "page_id": _page(fields.get("WARC-Record-ID")),
        "payload_bytes": int(fields["WARC-Payload-Length"]) if payload is None else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if payload is None else hashlib.sha256(payload).hexdigest(),
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "url": _unquoted(fields.get("WARC-Target-URI")),
        "payload": payload,
    }


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared scratch folder and read them back; fails unless as many records are read as were written."""
    manifest = write_archives(pages, scratch_dir(pages.sparkSession) + "-warc")
    records = manifest.agg(F.sum("records")).first()[0]
    if not records:
        return pages.sparkSession.createDataFrame([], RECORD)
    rows = materialize(read_archives(pages.sparkSession, manifest))
    if (found := rows.count()) != records:
        raise RuntimeError(f"{records} records were written and {found} were read")
    return rows
