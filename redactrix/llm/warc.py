"""WARC archives: a writer with revisit records, and a splittable reader that finds records by gzip magic."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactrix.llm.common import Scratch

MAGIC = b"\x1f\x8b\x08"
MIN_PAYLOAD = 100
SPLIT = 16 << 20
DATE = "2026-01-01T00:00:00Z"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a plain local path; executors and driver must both reach it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def plan_records(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and refers_to: null for responses, else the smallest page_id of equal payloads.

    Only ids, digests and lengths meet by digest (map-side combined, splittable join); html moves once, by page_id.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    small = pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).alias("n"))
    first = small.filter(F.col("n") >= min_payload).groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).filter("c > 1").drop("c")
    again = small.filter(F.col("n") >= min_payload).join(first, "payload_digest").filter("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    full = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    return full.join(again, ["page_id", "payload_digest"], "left")


def _record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _record(page_id, url, html: bytes, digest: str, refers_to) -> bytes:
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if refers_to is not None else http + html
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {'' if page_id is None else page_id}", f"Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_warc(planned: DataFrame, folder: str) -> DataFrame:
    """Writes one archive a partition, a gzip member a record; (path, size, records) of each.

    A task writes under a name of its own attempt and renames when whole, so a lost executor leaves nothing
    that counts: only archives in the returned rows are read.
    """

    def work(batches):
        system, base = open_fs(folder)
        system.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        part, n, size = f"{base}/_{name}", 0, 0
        with system.open_output_stream(part, compression=None) as out:
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_digest", "refers_to")), strict=True):
                    page_id, url, html, digest, refers_to = row
                    size += out.write(_record(page_id, url, html.encode(), digest, refers_to))
                    n += 1
        if n:
            system.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})
        else:
            system.delete_file(part)

    return planned.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(work, "path string, size long, records long")


class _Tail:
    """A byte range that is read on past its end when a record needs it."""

    def __init__(self, source, begin: int, end: int):
        self.source, self.begin, self.size = source, begin, source.size()
        source.seek(begin)
        self.data = bytearray(source.read(max(0, min(end, self.size) - begin)))

    def more(self, n: int = 1 << 18) -> bool:
        got = self.source.read(n)
        self.data += got
        return bool(got)


def members(tail: _Tail, length: int):
    """Contents of the gzip members that begin inside the first ``length`` bytes and hold a WARC record.

    Every magic is a candidate; it counts if it decodes and what comes out begins with a WARC version. A record that
    the file's end cuts raises ValueError, as does a member cut where a record must begin (behind another, or at 0).
    """
    at, due = 0, 0 if tail.begin == 0 else None
    while True:
        at = tail.data.find(MAGIC, at)
        while at < 0 or at + 18 > len(tail.data):
            if at < 0 and len(tail.data) >= length + len(MAGIC) or not tail.more():
                if at == due:
                    raise ValueError("the archive ends inside a record")
                break
            at = tail.data.find(MAGIC, max(0, length - len(MAGIC)) if at < 0 else at)
        if at < 0 or at >= length:
            return
        z, out, pos = zlib.decompressobj(31), bytearray(), at
        try:
            while not z.eof:
                if pos >= len(tail.data) and not tail.more():
                    raise EOFError("a member is cut short")
                step = bytes(tail.data[pos : pos + (1 << 16)])
                pos += len(step)
                out += z.decompress(step)
                if len(out) >= 7 and not out.startswith(b"WARC/1."):
                    raise zlib.error("not a record")
        except EOFError:
            if at == due or out.startswith(b"WARC/1."):
                raise ValueError("the archive ends inside a record") from None
            at += 1
            continue
        except zlib.error:
            at += 1
            continue
        if not out.startswith(b"WARC/1."):
            at += 1
            continue
        yield bytes(out)
        at = due = pos - len(z.unused_data)


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def parse_record(raw: bytes) -> dict:
    """One record. Its type is as stated ("" if it is not); a response's payload is what follows the HTTP header.

    Other types with content (warcinfo, request, metadata, resource ...) have their whole block as the payload, and
    revisits none: their length and digest are those that their headers state, null if they do not. A missing or odd
    Content-Length: the block is all that follows, without the line ends that close a record. Missing fields: null.
    """
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.strip().decode("utf-8", "replace")
    size, kind = _whole(fields.get("content-length")), fields.get("warc-type", "").lower()
    block = block[:size] if size is not None else block.removesuffix(b"\r\n\r\n")
    out = {"page_id": _whole(fields.get("page-id", "").removeprefix("-")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _whole(fields.get("refers-to-page-id", "").removeprefix("-"))}
    for name, field in (("page_id", "page-id"), ("refers_to", "refers-to-page-id")):
        if fields.get(field, "").startswith("-") and out[name] is not None:
            out[name] = -out[name]
    if kind == "revisit":
        stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d{1,18})\s", block)
        algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
        return out | {"payload_bytes": int(stated[1]) if stated else None, "payload_digest": digest.lower() if algorithm.lower() == "sha256" else None, "payload": None}
    http = kind == "response" and block.startswith(b"HTTP/")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def read_warc(archives: DataFrame, split: int = SPLIT, payload: bool = True) -> DataFrame:
    """Records of archives (path, size): page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Each byte range is a task's row; a record belongs to the range that its first byte lies in. Responses'
    lengths and digests are worked out from the payload; revisits' are those that their headers state. Records of
    other types come out as well, with the type that they state. ``payload`` False leaves the payload column null.
    An archive that ends inside a record ends the job: its path is in the message. Empty archives: no rows.
    """
    ranges = archives.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("begin"))
    n = int(archives.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1)
    # a task takes one range while that keeps tasks few, and up to 64 of them beyond
    tasks = max(min(n, 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-n // 64))

    def work(batches):
        for b in batches:
            for path, size, begin in zip(*(b.column(c).to_pylist() for c in ("path", "size", "begin")), strict=True):
                system, name = open_fs(path)
                with system.open_input_file(name) as source:
                    rows, held, found = [], 0, members(_Tail(source, begin, min(size, begin + split)), min(size, begin + split) - begin)
                    while True:
                        try:
                            raw = next(found, None)
                        except ValueError as e:
                            raise ValueError(f"{path}: {e}") from e
                        if raw is None:
                            break
                        rows.append(parse_record(raw))
                        held += len(raw)
                        if not payload:
                            rows[-1]["payload"] = None
                        if held > 8 << 20 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)

    return ranges.repartition(tasks).mapInArrow(work, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, split: int = SPLIT, payload: bool = False) -> DataFrame:
    """Writes pages (page_id, url, html) to archives in the shared folder and reads them back, one row a page.

    Null html: empty payload. Null page_id: read back as null. Repeated page_ids: a record for each row; rows
    equal in id and payload to the first are responses like it. Empty table: no archives, no rows.
    """
    scratch = Scratch(spark, "warc")
    archives = scratch.write(write_warc(plan_records(pages), scratch.path("archives")), "manifest")
    return read_warc(archives, split, payload)
