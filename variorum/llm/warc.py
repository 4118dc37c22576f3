"""WARC (2): reader of ZIP-packaged web archives.

A package is a ZIP file with WARC files stored (not compressed by ZIP) under ``archive/`` and CDXJ indexes under
``indexes/``. The reader parses the end record, its ZIP64 form and the central directory by range reads of the file's
end, finds each member's data behind its local header, streams the index members for the records' places and then reads
the records themselves, neighbouring ones in one read. No member is ever extracted. The unit of work is a byte range,
so one package of any size is read by many tasks, and only paths and ranges are shuffled.

What no index line covers - a whole member, or gaps between the places named - is cut into pieces of ``PIECE_BYTES``.
One task a piece looks for the first place in it where a record may begin and walks from there, record by record, to
the first border in the next piece; nothing is kept but the borders. Then the pieces of a gap are chained: each must
begin where the one before it ended, and where one doesn't (what looked like a record lay inside another) the walk is
taken from the proven border. So the pieces that are read in the end consist of whole records, whatever these contain.

Edge cases. A member that isn't stored (or is encrypted) can't be range-read: archives of that kind are listed by
``members`` and have no records; indexes are inflated. Bytes of an archive that no index line covers are read like an
archive without an index. An index line that is broken, or names no member of the package or a place outside it,
raises, as does a path that holds no ZIP, a directory or record that is cut short, or a place where no record begins,
each with its place: data are never dropped silently. Blank lines, comments (``!``, ``#``) and the header of a CDX file are
no lines. A null path is ignored. HTTP 204 has a null payload, an empty body an empty one. Repeated paths give repeated
records; an empty table of paths gives no rows. Columns other than the path are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variorum.llm.common import map_arrow, new_path, written

READ_BYTES = 8 << 20
#: Archive bytes that one reading task takes.
TASK_BYTES = 64 << 20
PACKAGE_BYTES = 64 << 20
#: Bytes of a piece of an archive part without an index.
PIECE_BYTES = 32 << 20
RANGE = "path string, member string, offset bigint, length bigint"
RECORD = "path string, member string, offset bigint, length bigint, warc_type string, record_id string, target_uri string, warc_date string, status int, content_type string, payload binary, digest_ok boolean"


class Member(NamedTuple):
    name: str
    method: int
    flags: int
    offset: int  # of its data in the package
    packed: int
    size: int


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def read_at(f, offset: int, n: int, what: str) -> bytes:
    f.seek(offset)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{what}: {n} bytes expected at {offset}, {len(data)} there")
    return data


def directory(f, size: int, what: str) -> list[Member]:
    """The members of a package, in the order of its central directory."""
    tail_n = min(size, 22 + 65_535 + 20)
    tail = read_at(f, size - tail_n, tail_n, what)
    at = len(tail)
    while True:
        at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError(f"{what}: no end record, so no ZIP file")
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    end = size - tail_n + at
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        big = read_at(f, where, 56, what)
        if big[:4] != b"PK\6\6":
            # something stands before the package; the record is right before its locator
            where = end - 20 - 56
            big = read_at(f, where, 56, what)
            if big[:4] != b"PK\6\6":
                raise ValueError(f"{what}: no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", big, 32)
        end = where
    shift = end - length - start  # bytes that stand before the package
    if shift < 0:
        raise ValueError(f"{what}: the central directory doesn't fit")
    data, out, p = read_at(f, start + shift, length, what), [], 0
    for _ in range(count):
        if data[p : p + 4] != b"PK\1\2":
            raise ValueError(f"{what}: broken central directory")
        flags, method = struct.unpack_from("<HH", data, p + 8)
        packed, plain, n, m, k = struct.unpack_from("<IIHHH", data, p + 20)
        local = struct.unpack_from("<I", data, p + 42)[0]
        name = data[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = data[p + 46 + n : p + 46 + n + m], 0
        while q + 4 <= len(extra):
            kind, n_extra = struct.unpack_from("<HH", extra, q)
            if kind == 1:
                body, r = extra[q + 4 : q + 4 + n_extra], 0
                if plain == 0xFFFFFFFF:
                    plain, r = struct.unpack_from("<Q", body, r)[0], r + 8
                if packed == 0xFFFFFFFF:
                    packed, r = struct.unpack_from("<Q", body, r)[0], r + 8
                if local == 0xFFFFFFFF:
                    local, r = struct.unpack_from("<Q", body, r)[0], r + 8
            q += 4 + n_extra
        head = read_at(f, local + shift, 30, what)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{what}: no local header of {name}")
        a, b = struct.unpack_from("<HH", head, 26)
        out.append(Member(name, method, flags, local + shift + 30 + a + b, packed, plain))
        p += 46 + n + m + k
    return out


def is_archive(name: str) -> bool:
    return name.endswith((".warc", ".warc.gz"))


def inflated(f, m: Member, what: str) -> Iterator[bytes]:
    """The member's bytes, inflated where ZIP or gzip (of any number of parts) packed them, a block at a time."""
    blocks: Iterator[bytes] = (read_at(f, m.offset + p, min(READ_BYTES, m.packed - p), what) for p in range(0, m.packed, READ_BYTES))
    if m.method == 8:
        blocks = _inflate(blocks, -15, what)
    return _inflate(blocks, 31, what) if m.name.endswith(".gz") else blocks


def _inflate(blocks: Iterator[bytes], bits: int, what: str) -> Iterator[bytes]:
    d = zlib.decompressobj(bits)
    for data in blocks:
        while data:
            if d.eof:
                d = zlib.decompressobj(bits)
            yield d.decompress(data, READ_BYTES)
            data = d.unconsumed_tail or d.unused_data
    yield d.flush()
    if not d.eof:
        raise ValueError(f"{what}: compressed data are cut short")


def index_lines(f, m: Member, what: str) -> Iterator[tuple[str, int, int]]:
    """(file name, offset, length) of each line of an index."""
    rest, number = b"", 0
    for block in chain(inflated(f, m, what), [b"\n"]):
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            number += 1
            text = line.decode("utf-8", "replace").strip()
            if not text or text[0] in "!#" or text.startswith("CDX "):
                continue
            try:
                if (at := text.find("{")) >= 0:
                    x = json.loads(text[at:])
                    yield str(x["filename"]), int(x["offset"]), int(x["length"])
                else:  # CDX of eleven fields, the last three of which are length, offset and file
                    *_, length, offset, name = text.split(" ")
                    yield name, int(offset), int(length)
            except (KeyError, TypeError, ValueError) as e:
                raise ValueError(f"{what}: broken line {number} of {m.name}: {text[:200]}") from e


def places(path: str) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Members, offsets in the package and lengths of the records that the indexes name, and of the gaps between (length < 0)."""
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        found = directory(f, f.size(), path)
        archives = {m.name: m for m in found if is_archive(m.name)}
        stores = {n: m for n, m in archives.items() if m.method == 0 and not m.flags & 1}
        by_name = {n.rpartition("/")[2]: m for n, m in archives.items()} | archives
        named: dict[str, tuple[array, array]] = {n: (array("q"), array("q")) for n in stores}
        for m in found:
            if m.name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")) and m.method in (0, 8) and not m.flags & 1:
                for name, offset, length in index_lines(f, m, path):
                    s = by_name.get(name)
                    if s is None or offset < 0 or length <= 0 or s.name in stores and offset + length > s.size:
                        raise ValueError(f"{path}: {m.name} names {name} at {offset}, {length} bytes, which aren't there")
                    if s.name in named:
                        named[s.name][0].append(offset)
                        named[s.name][1].append(length)
        for name, s in stores.items():
            at, n = (np.frombuffer(x, np.int64) if len(x) else np.zeros(0, np.int64) for x in named[name])
            order = np.lexsort((n, at))
            at, n = at[order], n[order]
            new = np.append(at[1:] != at[:-1], True)[: len(at)]  # of lines with one offset the longest
            at, n = at[new], n[new]
            a, z = np.concatenate([[0], np.maximum.accumulate(at + n)]), np.append(at, s.size)
            gap = np.flatnonzero(z > a)
            at, n = np.concatenate([at, a[gap]]) + s.offset, np.concatenate([n, (a - z)[gap]])
            order = np.argsort(at, kind="stable")
            for x in range(0, len(at), 100_000):
                part = order[x : x + 100_000]
                yield [name] * len(part), at[part], n[part]


class Tape:
    """A stretch of a package, read in blocks as it is walked."""

    def __init__(self, f, end: int, what: str) -> None:
        self.f, self.end, self.what, self.base, self.data = f, end, what, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes from there on, fewer at the end."""
        n = min(n, self.end - at)
        if n <= 0:
            return b""
        if at < self.base or at + n > self.base + len(self.data):
            self.base, self.data = at, read_at(self.f, at, min(max(n, READ_BYTES >> 3), self.end - at), self.what)
        return self.data[at - self.base : at - self.base + n]

    def next(self, at: int) -> int:
        """The end of the record that begins there, and of the line ends behind it."""
        if self.bytes(at, 2) == b"\x1f\x8b":
            d, p, head = zlib.decompressobj(31), at, b""
            while not d.eof:
                block = self.bytes(p, 1 << 16)
                if not block:
                    raise ValueError(f"{self.what}: the record at {at} is cut short")
                plain = d.decompress(block)
                head = (head + plain)[:5] if len(head) < 5 else head
                p += len(block)
            if head != b"WARC/":
                raise ValueError(f"{self.what}: no WARC record at {at}")
            return p - len(d.unused_data)
        n = 1 << 12
        while (e := (head := self.bytes(at, n)).find(b"\r\n\r\n")) < 0:
            if len(head) < n:
                raise ValueError(f"{self.what}: no WARC record at {at}")
            n *= 4
        version, h = headers(head[:e])
        if not version.startswith("WARC/") or not h.get("content-length", "").isdigit():
            raise ValueError(f"{self.what}: no WARC record at {at}")
        p = at + e + 4 + int(h["content-length"])
        if p > self.end:
            raise ValueError(f"{self.what}: the record at {at} is cut short")
        return self.skip(p)

    def skip(self, at: int) -> int:
        while self.bytes(at, 2) == b"\r\n":
            at += 2
        return at

    def first(self, at: int, end: int) -> int | None:
        """The first place from there on, before the end, where a record may begin."""
        while at < end:
            block = self.bytes(at, 1 << 20)
            for m in _MAYBE.finditer(block):
                p = at + (m.end() if m[0] == b"\r\n\r\n" else m.start())
                if p < end and (p == at + m.end() or self.begins(p)):
                    return p
            if len(block) < 1 << 20:
                return None
            at += len(block) - 9
        return None

    def begins(self, at: int) -> bool:
        try:
            return zlib.decompressobj(31).decompress(self.bytes(at, 1 << 12), 5) == b"WARC/"
        except zlib.error:
            return False

    def walk(self, at: int, least: int) -> int:
        """The first border at or behind ``least``, from a border."""
        while at < min(least, self.end):
            at = self.next(at)
        return at


_MAYBE = re.compile(rb"\r\n\r\n(?=WARC/)|\x1f\x8b\x08", re.S)
_PIECE = pa.schema([("path", pa.string()), ("member", pa.string()), ("gap", pa.int64()), ("size", pa.int64()), ("piece", pa.int32()), ("first", pa.int64()), ("last", pa.int64())])


def chained(gaps: DataFrame, piece_bytes: int) -> DataFrame:
    """Ranges of whole records (``path``, ``member``, ``offset``, ``length`` < 0) that make up the gaps."""
    last = F.expr(f"cast((-length - 1) div {piece_bytes} as int)")
    pieces = gaps.select("path", "member", F.col("offset").alias("gap"), (-F.col("length")).alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    pieces = pieces.repartition(pieces.sparkSession.sparkContext.defaultParallelism * 4, "path", "gap", "piece")

    def tape(f, t: pa.RecordBatch | pa.Table, k: int) -> Tape:
        gap, size = t.column("gap")[k].as_py(), t.column("size")[k].as_py()
        return Tape(f, gap + size, f"{t.column('path')[k].as_py()}, {t.column('member')[k].as_py()}")

    def look(b: pa.RecordBatch) -> pa.RecordBatch:
        ends = []
        for k in range(b.num_rows):
            fs, name = open_fs(b.column("path")[k].as_py())
            with fs.open_input_file(name) as f:
                t, gap, i = tape(f, b, k), b.column("gap")[k].as_py(), b.column("piece")[k].as_py()
                at, end = gap + i * piece_bytes, min(gap + (i + 1) * piece_bytes, t.end)
                first = t.first(at, end) if i else t.skip(at)
                try:
                    ends.append((first, t.walk(first, end) if first is not None else None))
                except ValueError:
                    if not i:
                        raise
                    ends.append((None, None))  # no border after all; the chain walks over it
        return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.int64()) for c in zip(*ends))], schema=_PIECE)

    def proven(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        fs, name = open_fs(t.column("path")[0].as_py())
        out, at, gap = [], t.column("first")[0].as_py(), t.column("gap")[0].as_py()
        with fs.open_input_file(name) as f:
            walker = tape(f, t, 0)
            for i, first, last in zip(*(t.column(c).to_pylist() for c in ("piece", "first", "last"))):
                end = min(gap + (i + 1) * piece_bytes, walker.end)
                if at < end:
                    border = last if first == at else walker.walk(at, end)
                    out.append((at, at - border))
                    at = border
        both = t.slice(0, 1).select(["path", "member"]).take(pa.array([0] * len(out), pa.int64()))
        return both.append_column("offset", pa.array([x for x, _ in out], pa.int64())).append_column("length", pa.array([n for _, n in out], pa.int64()))

    found = map_arrow(pieces, look, "path string, member string, gap bigint, size bigint, piece int, first bigint, last bigint")
    return found.groupBy("path", "member", "gap").applyInArrow(proven, RANGE)


def dechunked(body: bytes) -> bytes:
    out, p = [], 0
    while (e := body.find(b"\r\n", p)) >= 0:
        n = int(body[p:e].split(b";")[0] or b"0", 16)
        if not n:
            break
        out.append(body[e + 2 : e + 2 + n])
        p = e + 2 + n + 2
    return b"".join(out)


def headers(data: bytes) -> tuple[str, dict[str, str]]:
    first, _, rest = data.decode("utf-8", "replace").partition("\r\n")
    pairs = (line.partition(":") for line in rest.split("\r\n") if ":" in line)
    return first, {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(record: bytes, what: str) -> tuple[tuple, int]:
    """The fields of one uncompressed record from ``warc_type`` on, and the record's length."""
    head, mark, _ = record.partition(b"\r\n\r\n")
    version, h = headers(head)
    if not mark or not version.startswith("WARC/") or not h.get("content-length", "").isdigit():
        raise ValueError(f"{what}: no WARC record")
    begin = len(head) + 4
    end = begin + int(h["content-length"])
    if end > len(record):
        raise ValueError(f"{what}: the record is cut short")
    block, status, kind, payload, ok = record[begin:end], None, h.get("content-type"), None, None
    if h.get("warc-type") == "response" and block.startswith(b"HTTP/"):
        http, _, payload = block.partition(b"\r\n\r\n")
        line, hh = headers(http)
        status = int(line.split(" ")[1]) if line.split(" ")[1:2] and line.split(" ")[1].isdigit() else None
        kind = hh.get("content-type")
        if (told := h.get("warc-payload-digest", "")).startswith("sha1:"):
            ok = base64.b32encode(hashlib.sha1(payload).digest()).decode() == told[5:]
        if hh.get("transfer-encoding", "").lower() == "chunked":
            payload = dechunked(payload)
        if hh.get("content-encoding", "").lower() == "gzip":
            payload = gzip.decompress(payload)
        if status == 204:
            payload = None
    elif block:
        payload = block
    return (h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri") or None, h.get("warc-date"), status, kind, payload, ok), end + 4


def records(data: bytes, what: str) -> Iterator[tuple[int, int, tuple]]:
    """(offset, length, fields) of the records that follow each other in the bytes, each gzipped or plain."""
    view, p = memoryview(data), 0
    while True:
        while data[p : p + 2] == b"\r\n":
            p += 2
        if p >= len(data):
            return
        if data[p : p + 2] == b"\x1f\x8b":
            d, q, plain = zlib.decompressobj(31), p, []
            while not d.eof:
                if q >= len(data):
                    raise ValueError(f"{what}: the record at {p} is cut short")
                plain.append(d.decompress(view[q : q + 65_536]))
                q = min(q + 65_536, len(data))
            n = q - len(d.unused_data) - p
            fields, _ = parse(b"".join(plain), what)
        else:
            e = data.find(b"\r\n\r\n", p)
            told = headers(data[p:e])[1].get("content-length", "") if e >= 0 else ""
            n = e + 4 + int(told) - p if told.isdigit() else len(data) - p
            fields, _ = parse(data[p : p + n], what)
        yield p, n, fields
        p += n


def members(paths: DataFrame, path: str = "path") -> DataFrame:
    """The members of each package: ``path``, ``member``, ``method``, ``offset``, ``packed``, ``size``, ``kind``
    ('archive', 'index' or 'other')."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                fs, name = open_fs(p)
                with fs.open_input_file(name) as f:
                    found = directory(f, f.size(), p)
                kind = lambda n: "archive" if is_archive(n) else "index" if ".cdx" in n else "other"
                rows = [(p, m.name, m.method, m.offset, m.packed, m.size, kind(m.name)) for m in found]
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "member", "method", "offset", "packed", "size", "kind"), r)) for r in rows], pa.schema([("path", pa.string()), ("member", pa.string()), ("method", pa.int32()), ("offset", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("kind", pa.string())]))

    return paths.select(F.col(f"`{path}`").alias("path")).where("path is not null").mapInArrow(run, "path string, member string, method int, offset bigint, packed bigint, size bigint, kind string")


_ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])


def read(paths: DataFrame, path: str = "path", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """All records of the packages; ``offset`` is that in the package."""

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                for m, o, n in places(p):
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(m), pa.string()), pa.array(m, pa.string()), pa.array(o, pa.int64()), pa.array(n, pa.int64())], names=["path", "member", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None

        def flush(span: list[tuple[str, str, int, int]]) -> Iterator[pa.RecordBatch]:
            nonlocal opened, f
            p, a = span[0][0], span[0][2]
            if opened != p:
                fs, name = open_fs(p)
                f, opened = fs.open_input_file(name), p
            data = read_at(f, a, max(o + abs(n) for _, _, o, n in span) - a, p)
            rows = []
            for _, m, o, n in span:
                part = data[o - a : o - a + abs(n)]
                for q, length, fields in records(part, f"{p} at {o}"):
                    rows.append((p, m, o + q, length, *fields))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

        span: list[tuple[str, str, int, int]] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if span and (row[0] != span[0][0] or row[2] + abs(row[3]) - span[0][2] > READ_BYTES or row[2] > span[-1][2] + abs(span[-1][3]) + (1 << 16)):
                    yield from flush(span)
                    span = []
                span.append(row)
        if span:
            yield from flush(span)

    listed = paths.select(F.col(f"`{path}`").alias("path")).where("path is not null")
    # a repeated path is planned once; its ranges are given as often as it occurs
    times = listed.groupBy("path").agg(F.count("*").cast("int").alias("times"))
    ranges = written(listed.distinct().mapInArrow(plan, RANGE), "ranges")
    if not ranges.where("length < 0").isEmpty():
        ranges = written(ranges.where("length > 0").unionByName(chained(ranges.where("length < 0"), piece_bytes)), "chained")
    ranges = ranges.join(times, "path").select("path", "member", "offset", "length", F.explode(F.sequence(F.lit(1), "times"))).drop("col")
    # the ranges are small and what they name is large: a counted number of partitions, which isn't coalesced by size
    total = ranges.agg(F.coalesce(F.sum(F.abs("length")), F.lit(0))).first()[0]
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    ranges = ranges.repartition(tasks, "path", F.expr(f"offset div {READ_BYTES}")).sortWithinPartitions("path", "offset")
    return ranges.mapInArrow(fetch, RECORD)


def record(page_id, url: str | None, html: str | None) -> bytes:
    """A response record of a page; its id carries the page's."""
    body = b"" if html is None else html.encode()
    http = (b"HTTP/1.1 204 No Content\r\n" if html is None else b"HTTP/1.1 200 OK\r\n") + b"Content-Type: text/html; charset=utf-8\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return gzip.compress(head.encode() + http + b"\r\n\r\n", 6, mtime=0)


def package(rows: list[tuple]) -> bytes:
    """A package of the (page_id, url, html) rows. Equal rows give equal bytes."""
    warc, index = io.BytesIO(), []
    for page_id, url, html in rows:
        r = record(page_id, url, html)
        index.append(f"{url or ''} 20240101000000 " + json.dumps({"url": url, "filename": "data.warc.gz", "offset": str(warc.tell()), "length": str(len(r))}))
        warc.write(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data, method in (("archive/data.warc.gz", warc.getvalue(), zipfile.ZIP_STORED), ("indexes/index.cdxj", "\n".join(index).encode(), zipfile.ZIP_STORED), ("datapackage.json", b'{"profile": "data-package"}', zipfile.ZIP_DEFLATED)):
            info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
            info.compress_type = method
            z.writestr(info, data)
    return out.getvalue()


def write(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the pages as packages in the shared folder and returns their ``path``s. A file's name and bytes follow from
    its task's rows and it appears by a rename, so a task that runs again does no harm."""
    folder = new_path(pages.sparkSession, "packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        rows, size, number = [], 0, 0

        def put() -> pa.RecordBatch:
            nonlocal rows, size, number
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}.wacz"
            temp = f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(temp) as f:
                f.write(package(rows))
            fs.move(temp, f"{base}/{name}")
            rows, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows.append(row)
                size += len(row[2] or "") + 500
                if size >= package_bytes:
                    yield put()
        if rows:
            yield put()

    return written(pages.select("page_id", "url", "html").mapInArrow(run, "path string"), "package-list")


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, url, html) of the records that ``record`` wrote."""
    return found.where("warc_type = 'response'").select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).try_cast(T.LongType()).alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "UTF-8").alias("html"))
