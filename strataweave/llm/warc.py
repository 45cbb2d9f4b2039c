r"""WARC archives: a writer that deduplicates payloads, and a salvage reader.

Every record is a gzip member of its own (WARC/1.1). Equal payloads are stored
once; the others are revisit records, which keep the HTTP header and so the
payload's length. The reader checks each member; after a failure it looks for the
next gzip member or version line that parses, goes on there, and logs the bytes
in between as a quarantined gap. Within a member, also of one that is damaged or cut
short, it goes on at the next version line of what inflates; such gaps have the member's place.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.llm.textblocks import trimmed
from strataweave.session import materialize, shared_dir

#: fixed, so that equal input gives equal archives
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 32 << 20
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_GZIP = b"\x1f\x8b\x08"
_SEARCHED = {"gzip": re.compile(re.escape(_GZIP)), "version": _VERSION, "line": re.compile(rb"(?<=\n)WARC/\d\.\d\r?\n"), "head end": re.compile(rb"\r\n\r\n")}


class _Places:
    """Next places of what a reader looks for. A search is repeated only where its last result is passed, so reading on from failure to failure stays linear."""

    def __init__(self, data: bytes):
        self.data = data
        self.found: dict[str, tuple[int, int]] = {}

    def next(self, what: str, at: int) -> int:
        """The first place from ``at`` on, or the end of the data."""
        since, place = self.found.get(what, (0, -1))
        if not since <= at <= place:
            m = _SEARCHED[what].search(self.data, at)
            place = m.start() if m else len(self.data)
            self.found[what] = (at, place)
        return place


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value: line breaks would end it."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, compressed as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null' if page is None else page}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    block: bytes
    payload: bytes | None = None
    http: dict[str, str] = field(default_factory=dict)


@dataclass
class Gap:
    """Quarantined bytes [offset, end) of a file."""

    offset: int
    end: int
    reason: str


class _Bad(ValueError):
    """What can't be read; ``end``: where it ends, if that is certain."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _parse(data: bytes, at: int, places: _Places) -> tuple[Record, int]:
    """The record whose version line begins at ``at``, and where it ends.

    Where header, length and terminator agree and a digest alone differs, the whole record is bad: what lies in it is payload, not a record.
    """
    if not _VERSION.match(data, at):
        raise _Bad("no version line")
    end = places.next("head end", at)
    if places.next("line", at + 1) < end:
        raise _Bad("another version line within the header")
    if end == len(data):
        raise _Bad("the header does not end")
    headers = _fields(data[at:end])
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise _Bad("no content length")
    stop = end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise _Bad("the block does not end where it should")
    r = Record(at, headers, data[end + 4 : stop])
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{digest32(r.block)}":
        raise _Bad("block digest differs", stop + 4)
    if "msgtype=response" in headers.get("content-type", ""):
        http, _, body = r.block.partition(b"\r\n\r\n")
        r.http = _fields(http)
        if headers.get("warc-type") == "response":
            r.payload = body
            if (want := headers.get("warc-payload-digest")) and want != f"sha1:{digest32(body)}":
                raise _Bad("payload digest differs", stop + 4)
    return r, stop + 4


CHUNK = 65_536


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """What inflates of the member at ``at``, where it ends, and why it ends too soon (empty: it does not)."""
    z = zlib.decompressobj(31)
    out, i = [], at
    try:
        while not z.eof:
            if i >= len(data):
                return b"".join(out), i, "the member is cut short"
            out.append(z.decompress(data[i : i + CHUNK]))
            i = min(i + CHUNK, len(data))
    except zlib.error as e:
        return b"".join(out) + _until_error(data, at, i), i, f"gzip: {e}"
    return b"".join(out), i - len(z.unused_data), ""


def _until_error(data: memoryview, at: int, chunk: int) -> bytes:
    """What the chunk of the member at ``at`` gives, byte by byte, before it fails."""
    z = zlib.decompressobj(31)
    for i in range(at, chunk, CHUNK):
        z.decompress(data[i : i + CHUNK])
    out = []
    try:
        for i in range(chunk, min(chunk + CHUNK, len(data))):
            out.append(z.decompress(data[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _inflated_to(data: memoryview, at: int, size: int) -> int:
    """Where the bytes end from which the member at ``at`` gives its first ``size``."""
    z, done, i = zlib.decompressobj(31), 0, at
    while i < len(data):
        before = z.copy()
        try:
            n = len(z.decompress(data[i : i + CHUNK]))
        except zlib.error:
            n = size
        if done + n >= size:
            while done < size:
                done += len(before.decompress(data[i : i + 1]))
                i += 1
            return i
        done, i = done + n, min(i + CHUNK, len(data))
    return i


def _inside(plain: bytes, at: int, end: int) -> tuple[list[Record | Gap], int]:
    """Records and gaps of the inflated member [at, end) of a file, and where the last record ends in ``plain``."""
    found: list[Record | Gap] = []
    i, lost, why, last = 0, -1, "", 0
    places = _Places(plain)
    gap = lambda stop: Gap(at, end, f"{why} (bytes {lost} to {stop} inflated)")
    while i < len(plain):
        try:
            r, stop = _parse(plain, i, places)
        except _Bad as e:
            if lost < 0:
                lost, why = i, str(e)
            i = e.end or places.next("version", i + 1)
            continue
        if lost >= 0:
            found.append(gap(i))
            lost = -1
        r.offset = at
        found.append(r)
        i = last = stop
    if lost >= 0:
        found.append(gap(len(plain)))
    return found, last


def _member(data: bytes, view: memoryview, at: int, places: _Places) -> tuple[list[Record | Gap], int, str]:
    """Records and gaps of the member or record at ``at``, where to go on, and why the rest of the member can't be read (empty: all is read)."""
    if data.startswith(_GZIP, at):
        plain, end, error = _inflate(view, at)
        found, last = _inside(plain, at, end)
        if not last:
            raise _Bad(error or (found[0].reason if found else "an empty member"))
        if error:
            if isinstance(found[-1], Gap):  # part of the gap that follows
                found.pop()
            return found, _inflated_to(view, at, last), error
        return found, end, ""
    r, end = _parse(data, at, places)
    return [r], end, ""


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that can be read, and the gaps between them, in file order."""
    view, at, lost, why = memoryview(data), 0, -1, ""
    places = _Places(data)
    following = lambda first: min(places.next("gzip", first), places.next("version", first))

    while at < len(data):
        try:
            found, end, error = _member(data, view, at, places)
        except _Bad as e:
            if lost < 0:
                lost, why = at, str(e)
            at = e.end or following(at + 1)
            continue
        if lost >= 0:
            yield Gap(lost, at, why)
            lost = -1
        yield from found
        if error:  # what is left of the member is a gap
            lost, why = at, error
            end = following(end)
        at = end
    if lost >= 0:
        yield Gap(lost, len(data), why)


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page, url, payload, refers_to): refers_to is null for responses.

    Of equal payloads (by SHA-1) of at least ``least_bytes``, the smallest key is the
    response; rows that repeat that key are responses too, a null key counts as largest.
    Only digests that occur twice reach the join, which AQE can split.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), body.alias("payload")).withColumn("_digest", F.unhex(F.sha1("payload")))
    firsts = pages.select(F.col(key).cast("long").alias("page"), body.alias("payload")).where(F.octet_length("payload") >= least_bytes)
    firsts = firsts.groupBy(F.unhex(F.sha1("payload")).alias("_digest")).agg(F.min("page").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(firsts, "_digest", "left")
    refers = F.when((F.octet_length("payload") >= least_bytes) & ~F.col("page").eqNullSafe(F.col("_first")), F.col("_first"))
    return joined.select("page", "url", "payload", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write gzip WARC files of about ``file_bytes`` to a shared folder; returns the manifest (path, records, bytes).

    records: as of ``plan_records``. A null page has ``null`` in its id, a null url no target; payloads are never null. Repeated
    rows are written again, and rows that repeat a page share its record id; an empty table gives no file.
    Urls and payloads may have any length; further columns are not read.
    """
    from strataweave.llm.storage import attempt_name, fresh_folder, open_output

    where = folder or fresh_folder(shared_dir(records.sparkSession), "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, path, n, size = TaskContext.get().partitionId(), None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            columns = [batch.column(c) for c in ("page", "url", "payload", "refers_to")]
            for page, url, payload, refers in zip(*columns, strict=True):
                if out is None:
                    path, n, size = attempt_name(where, part, ".warc.gz"), 0, 0
                    out = open_output(path)
                refers = refers.as_py()
                data = record("response" if refers is None else "revisit", page.as_py(), url.as_py(), payload.as_py(), refers)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    out = None
                    done.append((path, n, size))
        if out is not None:
            out.close()
            done.append((path, n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "bytes"])

    return materialize(records.mapInArrow(trimmed(write), "path string, records long, bytes long"), "warc-manifest")


_READ = "path string, offset long, end long, gap_reason string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps of the files in ``path``; gap rows have gap_reason, offset and end, and no record_type.

    A file is read whole, and a member inflated whole. Files named twice are read twice; an empty file or manifest gives no rows;
    further columns of the manifest are not read.
    """
    from strataweave.llm.storage import open_input

    def page(uri: str) -> int | None:
        value = uri.strip("<>").removeprefix("urn:x-page:")
        return int(value) if re.fullmatch(r"-?\d+", value) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _READ.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with open_input(path) as f:
                    data = f.read()
                rows = []
                for r in salvage(data):
                    if isinstance(r, Gap):
                        rows.append((path, r.offset, r.end, r.reason, None, None, None, None, None, None, None))
                    else:
                        h = r.headers
                        size = len(r.payload) if r.payload is not None else int(r.http["content-length"]) if r.http.get("content-length", "").isdigit() else None
                        digest = digest32(r.payload) if r.payload is not None else h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        rows.append((path, r.offset, None, None, h.get("warc-type"), page(h.get("warc-record-id", "")), page(h["warc-refers-to"]) if "warc-refers-to" in h else None, h.get("warc-target-uri"), size, digest, r.payload if with_payload else None))
                    if len(rows) >= 500:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(width, F.xxhash64("path")).mapInArrow(trimmed(read), _READ)
