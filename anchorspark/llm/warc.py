"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The reader checks each record (version line, header block, length, trailing
blank lines, payload digest).  When a check fails it searches for the next gzip
member or version line that passes, goes on from there, and reports the bytes
between as a gap; inside a gzip member it does the same over the plain bytes,
so one bad record or a member cut short costs no other record.  Files are read
in chunks: a task holds a chunk and one record, whatever the file's size.

Defined results: null html is an empty payload; rows that repeat a page are
all written; of rows with equal payloads those with the smallest page_id are
responses (a null page_id never is the smallest while another is there); ids
may be of any type that has a text form, others are refused before anything is
written; archives that others wrote give the ids that they hold as text; a
payload of any length is one record; a header over 64 KB or a block over 1 GB
(more than a row can hold) counts as damage; an empty table gives no archive
and no record; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import pieces, utf8
from .scratch import Scratch

VERSION = b"WARC/1.1"
_GZIP = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
_END = b"\r\n\r\n"
_CHUNK, _READ = 1 << 16, 4 << 20
_MOST_HEADER, _MOST_BLOCK = 1 << 16, 1 << 30
_SCHEMA = "kind string, page_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, file string, start long, length long, inner_start long, inner_length long, reason string"


def _urn(page_id: str | int | None) -> str:
    """An id's name in a record; percent-encoded, so ids of any characters and null stay apart."""
    return "urn:no-page" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def _page_id(urn: str | None) -> str | None:
    m = re.fullmatch(r"<urn:page:([^<>]*)>", urn or "")
    return unquote(m[1]) if m else None


def record(page_id: str | int | None, url: str | None, payload: bytes, digest: str, refers_to: str | int | None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One record's bytes; a revisit holds no payload, only its digest and length."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = [
        VERSION.decode(),
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_urn(page_id)}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean}"] if clean is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload) if refers_to is None else 0}",
    ]
    return "\r\n".join(head).encode() + _END + (payload if refers_to is None else b"") + _END


class Damaged(Exception):
    pass


class _Bytes:
    """A part of a byte source that is read on as asked for; offsets are the source's own."""

    def __init__(self, read: Callable[[int], bytes], base: int = 0):
        self.read, self.base, self.data, self.ended = read, base, bytearray(), False

    def fill(self, end: int) -> int:
        """Hold the bytes up to an offset, if there are so many; the offset after the last held."""
        while not self.ended and self.base + len(self.data) < end:
            got = self.read(max(_CHUNK, end - self.base - len(self.data)))
            self.data += got
            self.ended = not got
        return self.base + len(self.data)

    def drop(self, at: int) -> None:
        del self.data[: at - self.base]
        self.base = at

    def get(self, start: int, end: int) -> bytes:
        return bytes(memoryview(self.data)[max(0, start - self.base) : max(0, end - self.base)])

    def find(self, marks: tuple[bytes, ...], at: int) -> int | None:
        """The next offset from at on where one of the marks is; what lies before is dropped."""
        while True:
            self.drop(at)
            held = self.fill(at + _CHUNK)
            spots = [x for x in (self.data.find(m) for m in marks) if x >= 0]
            if spots:
                return self.base + min(spots)
            if self.ended:
                return None
            at = max(at, held - max(map(len, marks)) + 1)


def _parse(source: _Bytes, at: int, least_end: int | None = None) -> tuple[dict[str, str], bytes, int]:
    """The record at an offset: its header, its block and the offset after it; least_end: where the source is known to end."""
    source.fill(at + _MOST_HEADER)
    if source.get(at, at + 7) != b"WARC/1.":
        raise Damaged("no version line")
    cut = source.data.find(_END, at - source.base, at - source.base + _MOST_HEADER)
    if cut < 0:
        raise Damaged("header not ended")
    start = source.base + cut + len(_END)
    try:
        lines = source.get(at, start - len(_END)).decode().split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(head["content-length"])
    except (ValueError, KeyError) as e:
        raise Damaged("bad header") from e
    if not _NEEDED <= head.keys() or not all(re.fullmatch(r"[!-9;-~]+", k) for k in head):
        raise Damaged("bad header")
    after = start + size + len(_END)
    if not 0 <= size <= _MOST_BLOCK or least_end is not None and after > least_end or source.fill(after) < after or source.get(after - len(_END), after) != _END:
        raise Damaged("bad length")
    block = source.get(start, start + size)
    digest = head.get("warc-payload-digest", "")
    if head.get("warc-type") == "response" and digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:]:
        raise Damaged("digest differs")
    return head, block, after


class _Member:
    """The plain bytes of the gzip member at an offset, and how it ended."""

    def __init__(self, read_at: Callable[[int, int], bytes], at: int):
        self.read_at, self.start, self.fed, self.engine, self.rest, self.given, self.fault = read_at, at, at, zlib.decompressobj(31), b"", 0, ""

    def read(self, n: int) -> bytes:
        while not (self.engine.eof or self.fault):
            if not self.rest:
                self.rest = self.read_at(self.fed, _CHUNK // 4)
                self.fed += len(self.rest)
                if not self.rest:
                    self.fault = "gzip member cut off"
                    break
            try:
                got = self.engine.decompress(self.rest, max(n, _CHUNK))
            except zlib.error:
                self.fault = "bad gzip member"
                return self._up_to_fault(self.fed - len(self.rest))
            self.rest = self.engine.unconsumed_tail
            self.given += len(got)
            if got:
                return got
        return b""

    def _up_to_fault(self, last: int) -> bytes:
        """What the call that failed would have given: zlib keeps nothing of it, so go again, and by single bytes from the last good offset on."""
        engine, at, seen, out = zlib.decompressobj(31), self.start, 0, bytearray()
        try:
            while part := self.read_at(at, min(_CHUNK // 4, last - at) if at < last else 1):
                got = engine.decompress(part)
                out += got[max(0, self.given - seen) :]
                seen += len(got)
                at += len(part)
        except zlib.error:
            pass
        return bytes(out)

    @property
    def end(self) -> int:
        return self.fed - len(self.engine.unused_data)


@dataclass(frozen=True)
class Found:
    """A record (header and block) or a gap (reason) and the file's bytes it takes; inner: its place in the plain bytes of a gzip member."""

    kind: str
    start: int
    end: int | None  # of a record that shares its member with others: None
    reason: str = ""
    head: dict[str, str] | None = None
    block: bytes = b""
    inner: tuple[int, int] | None = None


def _scan_member(member: _Member, start: int) -> Iterator[Found]:
    """The records of a gzip member and the gaps between them."""
    plain, at, broken, reason = _Bytes(member.read), 0, None, ""
    while plain.fill(at + 1) > at:
        try:
            head, block, after = _parse(plain, at)
        except Damaged as e:
            if broken is None:
                broken, reason = at, str(e)
            found = plain.find((b"WARC/1.",), at + 1)
            if found is None:
                at = plain.base + len(plain.data)
                break
            at = found
            continue
        if broken is not None:
            yield Found("gap", start, None, reason, inner=(broken, at))
            broken = None
        yield Found("record", start, None, "", head, block, (at, after))
        at = after
        plain.drop(at)
    if broken is not None and not member.fault:  # else the gap that the member itself leaves is logged
        yield Found("gap", start, None, reason, inner=(broken, at))


def salvage(read_file: Callable[[int, int], bytes], size: int) -> Iterator[Found]:
    """Every record that passes the checks, and the gaps; read_file(offset, n) gives n bytes, fewer only at the end."""
    raw_at, block_at, block = 0, 0, b""
    given: set[str] = set()  # records of the last damaged member: a stored part of it may show them again

    def read_at(at: int, n: int) -> bytes:
        nonlocal block_at, block
        n = min(n, size - at)
        if not block_at <= at or at + n > block_at + len(block):
            block_at, block = at, read_file(at, max(n, _READ))
        return block[at - block_at : at - block_at + n]

    def read(n: int) -> bytes:
        nonlocal raw_at
        got = read_at(raw_at, n)
        raw_at += len(got)
        return got

    source, at, broken, reason = _Bytes(read), 0, None, ""
    while at < size:
        source.fill(at + len(_GZIP))
        if source.get(at, at + len(_GZIP)) == _GZIP:
            member = _Member(read_at, at)
            held, several = None, False  # one is held back until it's known whether it is alone
            for x in _scan_member(member, at):
                if broken is not None and x.kind == "record":
                    yield Found("gap", broken, at, reason)
                    broken = None
                if held is not None:
                    several = True
                    yield held
                held = x
                if x.kind == "record":
                    given.add(x.head["warc-record-id"])
            if held is not None:
                whole = not several and held.kind == "record" and not member.fault
                yield replace(held, end=member.end) if whole else held
            if not member.fault and (held is not None or broken is None):
                if held is None:
                    yield Found("gap", at, member.end, "empty gzip member")
                at = raw_at = member.end
                source = _Bytes(read, at)
                given.clear()
                continue
            fault = member.fault or "no record in the gzip member"
        else:
            try:
                head, payload, after = _parse(source, at, size)
                if broken is not None and head["warc-record-id"] in given:
                    raise Damaged("read before")
                if broken is not None:
                    yield Found("gap", broken, at, reason)
                    broken = None
                yield Found("record", at, after, "", head, payload)
                at = after
                source.drop(at)
                given.clear()
                continue
            except Damaged as e:
                fault = str(e)
        if broken is None:
            broken, reason = at, fault
        found = source.find((_GZIP, b"WARC/1."), at + 1)
        at = size if found is None else found
    if broken is not None:
        yield Found("gap", broken, size, reason)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of every archive under path; kind is "record" or "gap".

    Spark lists the files and deals them out; each task reads its own through
    Arrow's file system of the path's scheme, so no archive is ever one row.
    """
    names, kinds = zip(*(x.split() for x in _SCHEMA.split(", ")), strict=True)
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    def row_of(x: Found, file: str) -> tuple:
        length, inner = None if x.end is None else x.end - x.start, (x.inner[0], x.inner[1] - x.inner[0]) if x.inner else (None, None)
        if x.kind == "gap":
            return (x.kind, None, None, None, None, None, None, None, file, x.start, length, *inner, x.reason)
        full = x.head.get("warc-payload-length")
        digest = x.head.get("warc-payload-digest", "").removeprefix("sha256:") or hashlib.sha256(x.block).hexdigest()
        return (x.kind, _page_id(x.head.get("warc-record-id")), x.head.get("warc-target-uri"), x.head.get("warc-type"), x.block, int(full) if full and full.isdigit() else len(x.block), digest, _page_id(x.head.get("warc-refers-to")), file, x.start, length, *inner, None)

    def parse(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(file)
                rows, held = [], 0
                with fs.open_input_file(name) as f:
                    for x in salvage(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        rows.append(row_of(x, file))
                        held += len(x.block) + 500
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", "^file:/+", "file:///")).mapInArrow(parse, _SCHEMA)


def write_archives(pages: DataFrame, path: str, compress: bool = True, most_bytes: int = 24 << 20) -> int:
    """Write pages (page_id, url, payload, digest, refers_to), ids of any type that strings can hold, as archives under path; the number of records.

    A task's files are named by its partition and its rows are ordered, so a
    task that runs again writes the same files again; each appears whole, by a
    rename.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        task, n, part, buffer = TaskContext.get(), 0, 0, bytearray()

        def flush():
            nonlocal part
            name = f"{root}/part-{task.partitionId():06d}-{part:05d}.warc{'.gz' if compress else ''}"
            hidden = f"{root}/_{task.partitionId()}-{part}-{task.taskAttemptId()}.tmp"  # no reader takes it
            with fs.open_output_stream(hidden, compression=None) as out:
                out.write(bytes(buffer))
            fs.move(hidden, name)
            part += 1
            buffer.clear()

        for batch in pieces(batches):
            for page_id, url, payload, digest, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                data = record(page_id, url, payload or b"", digest, refers_to)
                if compress:
                    engine = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = engine.compress(data) + engine.flush()
                buffer += data
                n += 1
                if len(buffer) >= most_bytes:
                    flush()
        if buffer:
            flush()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return pages.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def plan_revisits(pages: DataFrame, scratch: Scratch, least_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload another page with a smaller page_id has."""
    payload = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    keys = scratch.table(pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= least_bytes).select("page_id", "digest"), "keys")
    shared = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1 and refers_to is not null").drop("copies")
    # Both sides are stored tables, so adaptive execution can split a digest that many pages share.
    shared = scratch.table(shared, "shared")
    return keys.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def archive_round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write pages (page_id, url, html) as archives, then read the archives back, one row per record; fails if one is lost.

    Ids travel as text and come back in their own type.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    pages = pages.select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    if isinstance(kind, T.BinaryType | T.ArrayType | T.MapType | T.StructType | T.VariantType):
        raise TypeError(f"page_id can't be written as text: {kind.simpleString()}")
    revisits = scratch.table(plan_revisits(pages, scratch, least_bytes), "revisits").select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    full = pages.withColumn("digest", F.sha2(F.coalesce(F.encode("html", "utf-8"), F.lit(b"")), 256))
    joined = full.join(revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left")
    archives = scratch.folder("archives")
    as_text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
    written = write_archives(joined.select(*as_text).sortWithinPartitions("page_id", "digest", "url", "refers_to"), archives)
    read = scratch.table(read_archives(spark, archives).drop("payload"), "records")
    found = dict(read.groupBy("kind").count().collect())
    if found.get("gap") or found.get("record", 0) != written:
        raise RuntimeError(f"{written} records were written, but read were: {found}; gaps are in {scratch.path}/records")
    return read.where("kind = 'record'").withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
