"""WARC archives: a de-duplicating writer and a salvage reader (operator 4).

The reader walks an archive member by member (gzip) or record by record
(plain).  A record is accepted only if the member's CRC and length, the
record's shape (version line, headers, ``Content-Length``, closing CRLFs) and
its block digest hold.  After a failed check it searches for the next offset
at which a whole valid record starts, goes on from there and logs the bytes
between as one quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetframe.llm.common import materialize, scratch_path, slices, table

# Fixed values of the formats.
GZIP_MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
_VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")
_EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writer

def _field(text: str) -> str:
    """A header value: control characters and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def render_record(record_id: str, uri: str | None, payload: bytes, digest: str,
                  refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed.  With ``refers_to`` it is a revisit:
    its block ends after the HTTP header, which still states the length."""
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{ID_PREFIX}{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_field(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response",
              f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """One gzip member ending in a zero byte.  That byte is the top of the
    length field; a record of 16 MiB or more is followed by an empty member,
    which holds no data and ends in zeros."""
    c = zlib.compressobj(level, wbits=31)
    out = c.compress(record) + c.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _render(archive_bytes: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, filled = TaskContext.get().partitionId(), 0, 0
        for b in slices(batches):
            names, members, held = [], [], 0
            for pid, uri, payload, sha, ref, copy in zip(*(c.to_pylist() for c in b.columns)):
                payload = payload.encode() if payload is not None else b""
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                m = gzip_member(render_record("null" if pid is None else str(pid), uri, payload, digest,
                                              ("null" if ref is None else str(ref)) if copy else None, date),
                                level)
                if filled and filled + len(m) > archive_bytes:
                    number, filled = number + 1, 0
                filled += len(m)
                names.append(f"a{part:06d}-{number:05d}")
                members.append(m[:-1])  # the writer's separator is the zero byte
                held += len(m)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(members, pa.binary())],
                                                     names=["archive", "member"])
                    names, members, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(members, pa.binary())],
                                             names=["archive", "member"])
    return run


def write_warc(df: DataFrame, path: str, key: str, uri: str, payload: str, min_bytes: int = 0,
               archive_bytes: int = 16 << 20, level: int = 6, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write one gzip WARC record per row under ``path`` and return nothing.

    Of rows whose payloads (UTF-8 of the ``payload`` string, null: empty) are
    equal and at least ``min_bytes`` long, the one with the largest ``key``
    becomes a response; the others become revisits of it that carry no
    payload.  Files are ``archive=*/part-*.txt``: plain concatenated gzip
    members, at most ``archive_bytes`` each unless a single record is larger,
    written by Spark's own committer to any file system Spark can write.

    The files go through Spark's text sink, which writes the bytes of a
    string as they are: the member without its last byte (always zero) plus a
    zero byte as line separator.

    Defined cases: a null key ranks below all others and is written as
    ``null``; a null ``uri`` leaves the field out; rows that share payload
    and the largest key are all responses; an empty table writes no archive.
    """
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = df.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"),
                     F.col(payload).cast("string").alias("payload"),
                     F.sha1(text.cast("binary")).alias("sha"), F.octet_length(text).alias("bytes"))
    # digests that occur more than once, with the key that keeps the payload:
    # one row each, pre-aggregated before the shuffle
    copies = materialize(
        rows.filter(F.col("bytes") >= min_bytes).groupBy("sha")
        .agg(F.max("key").alias("keep"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("sha").alias("copy_sha"), "keep"), "warc-copies")
    # both sides are scans, so a digest shared by many rows is split by the
    # skew-join rule; Spark broadcasts ``copies`` only by its measured size
    marked = rows.join(copies, (F.col("sha") == F.col("copy_sha")) & (F.col("bytes") >= min_bytes), "left").select(
        "key", "uri", "payload", "sha", "keep",
        (F.col("copy_sha").isNotNull() & ~F.col("key").eqNullSafe(F.col("keep"))).alias("copy"))
    members = marked.mapInArrow(_render(archive_bytes, level, date), "archive string, member binary")
    (members.select("archive", F.col("member").cast("string").alias("member"))
     .write.mode("overwrite").partitionBy("archive").option("lineSep", "\x00").text(path))


# ---------------------------------------------------------------- reader

class Damaged(Exception):
    """Why no valid record starts at an offset."""


def _member(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at ``at`` and the offset after it."""
    d, out, pos, step = zlib.decompressobj(wbits=31), [], at, 1 << 14
    try:
        while not d.eof:
            if pos >= len(data):
                raise Damaged("truncated member")
            out.append(d.decompress(data[pos:pos + step]))
            pos = min(pos + step, len(data))
            step = min(step * 2, 1 << 18)  # unused_data stays small
    except zlib.error as ex:
        raise Damaged(f"bad member: {str(ex).split(':')[-1].strip()}") from None
    return b"".join(out), pos - len(d.unused_data)


def _parse(data: bytes | memoryview, at: int, whole: bool) -> tuple[dict, int]:
    """The WARC record at ``at`` and the offset after it; with ``whole`` the
    record must end where ``data`` ends."""
    size = 4096
    head = bytes(data[at:at + size])
    if not _VERSION.match(head):
        raise Damaged("no version line")
    while (end := head.find(b"\r\n\r\n")) < 0:
        if at + size >= len(data):
            raise Damaged("headers do not end")
        if any(b":" not in line for line in head.split(b"\r\n")[1:-1]):
            raise Damaged("bad header line")  # what is no header is not read to its end
        size *= 4
        head = bytes(data[at:at + size])
    fields = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"[0-9]{1,15}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise Damaged("missing field")
    start = at + end + 4
    stop = start + int(fields["content-length"])
    if stop + 4 > len(data) or bytes(data[stop:stop + 4]) != b"\r\n\r\n":
        raise Damaged("record does not end at its length")
    if whole and stop + 4 != len(data):
        raise Damaged("more than one record in a member")
    block = bytes(data[start:stop])
    if (d := fields.get("warc-block-digest", "")).startswith("sha1:") and d[5:] != base32_sha1(block):
        raise Damaged("block digest differs")
    fields["block"] = block
    return fields, stop + 4


def _one(data: memoryview, at: int) -> tuple[dict | None, int]:
    """The record at ``at`` (None for a gzip member without content)."""
    if data[at:at + 3] == GZIP_MAGIC:
        content, end = _member(data, at)
        return (_parse(content, 0, True)[0] if content else None), end
    return _parse(data, at, False)


def salvage(content: bytes) -> Iterator[tuple[int, int, dict | str | None]]:
    """``(start, end, fields)`` for each record of an archive, and
    ``(start, end, reason)`` for each quarantined gap, in order."""
    data, at = memoryview(content), 0
    while at < len(content):
        try:
            fields, end = _one(data, at)
            if fields is not None:
                yield at, end, fields
            at = end
            continue
        except Damaged as ex:
            reason = str(ex)
        resume = len(content)
        for m in _START.finditer(content, at + 1):
            try:
                if _one(data, m.start())[0] is None:
                    continue  # an empty member proves nothing
            except Damaged:
                continue
            resume = m.start()
            break
        yield at, resume, reason
        at = resume


def _http(block: bytes) -> tuple[int | None, bytes | None]:
    """Stated length and payload of an HTTP response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return None, block
    m = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,15})", head)
    return int(m[1]) if m else None, body


READ_SCHEMA = ("archive string, start long, end long, gap boolean, reason string, record_type string, "
               "record_id string, target_uri string, refers_to string, payload_digest string, "
               "payload_bytes long, payload binary")
_NAMES = [f.split()[0] for f in READ_SCHEMA.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t])
                    for n, t in (f.split() for f in READ_SCHEMA.split(", "))])


def _bare(uri: str | None) -> str | None:
    return uri[1:-1] if uri and uri.startswith("<") and uri.endswith(">") else uri


def _row(path: str, start: int, end: int, found, keep_payload: bool) -> tuple:
    if isinstance(found, str):
        return (path, start, end, True, found, *[None] * 7)
    stated, body = _http(found["block"])
    revisit = found["warc-type"] == "revisit"
    digest = found.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(body)
    if not revisit and digest != base32_sha1(body):
        return (path, start, end, True, "payload digest differs", *[None] * 7)
    size = stated if revisit else len(body)
    return (path, start, end, False, None, found["warc-type"], _bare(found.get("warc-record-id")),
            found.get("warc-target-uri"), _bare(found.get("warc-refers-to")), digest, size,
            body if keep_payload and not revisit else None)


def _read(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for path, content in zip(b.column(0), b.column(1)):
                rows, held, name = [], 0, path.as_py()
                for start, end, found in salvage(content.as_py()):
                    rows.append(_row(name, start, end, found, keep_payload))
                    held += 200 + len(rows[-1][-1] or b"")
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
    return run


def read_warc(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under ``path``.

    One row per record (``gap`` false) or gap (``gap`` true, with ``reason``);
    ``start`` and ``end`` are byte offsets in the archive.  Gaps hold the only
    bytes that no row describes as a record, so bytes are never lost silently.
    Archives may be gzip (a record per member), plain, or a mixture.  Each is
    read whole by one task: Spark's binary reader sets the limit (2 GiB); keep
    archives to tens of MB, as :func:`write_warc` does, and their number free.

    Defined cases: an empty archive gives no row; a record whose payload
    digest fails becomes a gap; revisits have a null payload; no archive at
    all gives no rows.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.{txt,warc,gz}").load(path).select("path", "content"))
    return files.mapInArrow(_read(keep_payload), READ_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives, read them back and report each."""
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages", "page_id", "url", "html"), path, "page_id", "url", "html")
    back = read_warc(spark, path, keep_payload=False).filter(~F.col("gap"))
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID_PREFIX) + 1}) AS BIGINT)")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"))


OP4_SQL = """
WITH h AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS s FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY p) AS keep FROM h)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(s, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM r
"""

__all__ = ["write_warc", "read_warc", "salvage", "render_record", "gzip_member", "op4_warc", "OP4_SQL"]
