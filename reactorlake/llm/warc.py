"""WARC archives: a writer with revisit records and a salvage reader.

The writer stores every page as a record of one gzip member; of equal payloads
the largest page id is the response and the others are revisits of it. Tasks
write archives of about ``ARCHIVE_BYTES`` into the shared folder and return their
paths; only files named by finished tasks are read, so a lost or repeated task
leaves no doubled record.

The salvage reader walks an archive record by record. When a check fails (gzip
checksum, version line, lengths, closing blank lines, digests) it searches for
the next position at which a gzip member, or an uncompressed record
that begins with a version line, can be read, goes on there, and reports the
skipped bytes as a quarantined gap (path, start, end, reason). Inside a member the search goes on at the next
version line, so one damaged record costs itself only; of a member that is cut or fails its checksum the
records that a digest vouches for are kept.

Defined cases: null html is an empty payload. Null page ids lose against any id; equal
payloads of null ids only are all responses. Rows that repeat the largest id are all responses. A null
address writes no target; bytes of an address that aren't printable ASCII are percent-encoded. Empty input writes no archive. Extra columns are
ignored.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reactorlake.llm.common import fresh_folder, map_arrow, slices, stage, table, text_of
from reactorlake.llm.linking import with_best

ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
MEMBER, VERSION = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "path string, start long, stop long, reason string, record_type string, page_id long, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record. A revisit keeps the payload's digest and length, not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1_32(payload)}')}>", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode()).decode())
    head.append(f"WARC-Payload-Digest: sha1:{sha1_32(payload)}")
    head.append(f"WARC-Block-Digest: sha1:{sha1_32(block)}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Damaged(Exception):
    """A check failed at this place."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    size: int

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def vouched(self) -> bool:
        """A digest that ``parse_record`` has checked stands for the block or the payload."""
        h = self.headers
        return "warc-block-digest" in h or ("warc-payload-digest" in h and h.get("warc-type") == "response")


def parse_record(read, at: int) -> Record:
    """The record at ``at``; ``read(at, n)`` gives up to n bytes. Raises ``Damaged``."""
    head, seen = read(at, 4096), 0
    if not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Damaged("version line")
    # up to the end of the member or file, but no further than a byte that no header holds
    while (end := head.find(b"\r\n\r\n", max(seen - 3, 0))) < 0:
        if re.search(rb"[\x00-\x08\x0b\x0c\x0e-\x1f]", head[seen:]):
            raise Damaged("header line")
        if len(more := read(at, 2 * len(head))) <= len(head):
            raise Damaged("no end of header")
        head, seen = more, len(head)
    try:
        _, *lines = head[:end].decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise Damaged("header line") from e
    if not all(re.fullmatch(r"[!-9;-~]+:[^\x00-\x08\x0a-\x1f]*|[ \t][^\x00-\x08\x0a-\x1f]*", x) for x in lines):
        raise Damaged("header line")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not re.fullmatch("[0-9]{1,15}", headers.get("content-length", "")):
        raise Damaged("content length")
    n = int(headers["content-length"])
    body = read(at + end + 4, n + 4)
    if len(body) < n + 4 or body[n:] != b"\r\n\r\n":
        raise Damaged("end of record")
    record = Record(headers, body[:n], end + 4 + n + 4)
    want = headers.get("warc-block-digest")
    if want and want != f"sha1:{sha1_32(record.block)}":
        raise Damaged("block digest")
    want = headers.get("warc-payload-digest")
    if want and headers.get("warc-type") == "response" and want != f"sha1:{sha1_32(record.payload())}":
        raise Damaged("payload digest")
    return record


def _unpack(read, at: int) -> tuple[bytes, int, str | None]:
    """What can be unpacked of the gzip member at ``at``, the position behind it, and what is wrong with it."""
    unzip, out, pos = zlib.decompressobj(31), [], at
    while not unzip.eof:
        chunk = read(pos, 1 << 16)
        if not chunk:
            return b"".join(out), pos, "cut gzip member"
        pos += len(chunk)
        before = unzip.copy()
        try:
            out.append(unzip.decompress(chunk))
        except zlib.error:  # what was unpacked together with the error is lost: again, byte by byte
            with contextlib.suppress(zlib.error):
                out.extend(before.decompress(chunk[i : i + 1]) for i in range(len(chunk)))
            return b"".join(out), pos, "gzip member"
    return b"".join(out), pos - len(unzip.unused_data), None


def _records_in(data: bytes, whole: bool) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The valid records of an unpacked member, and the gaps (from, to, reason) between them. Of a
    member that isn't ``whole`` only records that a digest vouches for count."""
    records, gaps, at = [], [], 0

    def valid(place: int) -> Record:
        record = parse_record(lambda a, n: data[a : a + n], place)
        if not whole and not record.vouched():
            raise Damaged("no digest in a damaged member")
        return record

    while at < len(data):
        try:
            records.append(valid(at))
            at += records[-1].size
            continue
        except Damaged as e:
            reason, after = str(e), at
        while (after := data.find(VERSION, after + 1)) >= 0:
            try:
                valid(after)
                break
            except Damaged:
                continue
        after = len(data) if after < 0 else after
        gaps.append((at, after, reason))
        at = after
    return records, gaps


def _at(read, pos: int) -> tuple[list[Record], list[tuple[int, int, str]], int, str | None]:
    """The valid records that begin at ``pos``, the gaps between them inside a member, the position
    behind, and what is wrong with the member that holds them. Raises ``Damaged`` without any record."""
    start = read(pos, len(VERSION))
    if start.startswith(MEMBER):
        data, stop, fault = _unpack(read, pos)
        records, gaps = _records_in(data, fault is None)
        if not records:
            raise Damaged(fault or (gaps[0][2] if gaps else "empty member"))
        return records, gaps, stop, fault
    if start.startswith(VERSION):
        record = parse_record(read, pos)
        return [record], [], pos + record.size, None
    raise Damaged("no member or version line")


def _next(read, pos: int, size: int) -> Iterator[int]:
    """Positions from ``pos`` on at which a member or a version line could begin."""
    while pos < size:
        chunk = read(pos, CHUNK)
        if not chunk:
            return
        yield from (pos + m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.", chunk))
        if pos + len(chunk) >= size:
            return
        pos += len(chunk) - len(VERSION) + 1


def salvage(file, size: int) -> Iterator[tuple[int, int, str | None, list[Record]]]:
    """(start, stop, None, records) for what is valid, (start, stop, reason, []) for quarantined gaps. A gap
    inside a member has the member's place, and its own bytes in the reason."""

    held = [0, b""]

    def read(at: int, n: int) -> bytes:
        if at < held[0] or at + n > held[0] + len(held[1]):
            file.seek(at)
            held[:] = [at, file.read(max(n, CHUNK))]
        return held[1][at - held[0] : at - held[0] + n]

    def following(pos: int) -> int:
        """The next position behind ``pos`` at which something valid begins."""
        for seen in _next(read, pos + 1, size):
            try:
                _at(read, seen)
                return seen
            except Damaged:
                continue
        return size

    pos = 0
    while pos < size:
        try:
            records, gaps, stop, fault = _at(read, pos)
        except Damaged as e:
            stop = following(pos)
            yield pos, stop, str(e), []
            pos = stop
            continue
        if fault is not None:  # its end is unknown: the next member tells
            stop = following(pos)
        yield pos, stop, None, records
        for a, b, reason in gaps:
            yield pos, stop, f"{reason} (bytes {a} to {b} of the member)", []
        if fault is not None:
            yield pos, stop, f"{fault} (its rest)", []
        pos = stop


def _number(text: str | None) -> int | None:
    m = re.search(r"-?[0-9]+(?=>?$)", text or "")
    return int(m[0]) if m else None


def read_archives(paths: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows of ``FIELDS`` of the archives in column ``path``: records (reason null) and gaps."""

    def row(path: str, start: int, stop: int, reason: str | None, r: Record | None) -> tuple:
        if r is None:
            return path, start, stop, reason, *[None] * 7
        h, payload = r.headers, r.payload()
        kind = h.get("warc-type")
        size = len(payload) if kind != "revisit" else _number((re.search(rb"(?im)^content-length:\s*([0-9]+)", r.block) or [b"", b""])[1].decode())
        digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or sha1_32(payload)
        return path, start, stop, None, kind, _number(h.get("x-page-id")), h.get("warc-target-uri"), size, digest, _number(h.get("warc-refers-to")), payload if with_payload else None

    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = open_fs(path)
                with store.open_input_file(inner) as f:
                    held, size = [], 0
                    for start, stop, reason, records in salvage(f, f.size()):
                        held += [row(path, start, stop, reason, r) for r in records or [None]]
                        size += sum(len(r.block) for r in records) if with_payload else 200
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    spread = paths.select("path").repartition(max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "path")
    return map_arrow(spread, run, FIELDS)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives into ``folder``; one row per archive: path, records, bytes."""
    payload = text_of(html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("same"))
    best = with_best(rows, "same", "id", "keep", F.max)
    first = (F.octet_length("payload") < min_bytes) | F.col("keep").isNull() | F.col("id").eqNullSafe(F.col("keep"))
    best = best.select("id", "payload", "url", F.when(~first, F.col("keep")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = open_fs(folder)
        out, done = None, []

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", count, size))

        store.create_dir(inner, recursive=True)
        for batch in slices(batches):
            for page, text, url, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name, count, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{inner}/{name}", compression=None)
                zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = zipper.compress(build_record(page, url, text.encode(), refers, date)) + zipper.flush()
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    return stage(map_arrow(best, run, "path string, records long, bytes long"), "warc-archives")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), fresh_folder(spark, "warc"))
    rows = stage(read_archives(archives), "warc-read").filter("reason IS NULL")
    written, read = archives.agg(F.sum("records")).first()[0] or 0, rows.count()
    if read != written:
        raise RuntimeError(f"{written} records were written, {read} can be read back")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
