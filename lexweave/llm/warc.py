"""A WARC reader that salvages damaged archives, and a writer of its own.

A record is accepted if all its checks hold: the gzip member's header and CRC-32 (in compressed
files), the version line, header lines, Content-Length against what is there, the closing blank
lines, and the block digest where one is given (SHA-1). After a failed check the reader
searches for the next place where a whole record passes - a member's magic in compressed files, a
version line in plain ones - goes on from there, and logs the bytes between as a gap with the first reason. A member may hold several records;
within it the same search goes by version lines, and records and gaps have their place in the inflated bytes as inner.

Compressed files are read in splits of SPLIT_BYTES by many tasks. A split owns the members that begin in
it; its reader passes over what a member of the split before left, follows its last member or gap beyond
the end, and logs a gap at its end, so that every byte of a file is in one record or one gap (of a member's rows, the first has all its bytes). Plain files are not split, as a
record in a record's payload looks like any other. Of a file only a window is held: a header block grows as long as its lines
are header lines, and a claimed length is read once its closing lines are seen to be in place.

Defined cases: an empty file gives nothing; a file without a valid record is one gap; bytes after the last record are
a gap; in the writer a null page is an empty one, a null URL leaves the header out, line breaks in URLs are escaped;
repeated rows are written each; pages may be of any length that fits a row; other columns, whatever their names, play no part; records with equal ids are each given.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, scratch

SPLIT_BYTES = 16 << 20
READ = 1 << 20
#: Longest version line.
VERSION = 32

SCHEMA = (
    "kind string, file string, offset long, length long, inner long, reason string, type string, record_id string, "
    "target_uri string, date string, http_status int, payload binary"
)


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


class Bad(Exception):
    """A failed check."""


class Window:
    """Bytes of a file by position; what lies before the last forget() is let go."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.base, self.data = file, file.size(), 0, bytearray()

    def forget(self, at: int) -> None:
        if at - self.base > READ:
            if at >= self.base + len(self.data):
                self.base, self.data = at, bytearray()
            else:
                del self.data[: at - self.base]
                self.base = at

    def upto(self, to: int) -> bool:
        """Holds the bytes before to, or before the end of the file; whether there were so many."""
        end = self.base + len(self.data)
        if to > end and end < self.size:
            self.file.seek(end)
            self.data += self.file.read(min(max(to - end, READ), self.size - end))
        return to <= self.base + len(self.data)

    def get(self, at: int, to: int) -> bytes:
        self.upto(to)
        return bytes(self.data[at - self.base : to - self.base])

    def peek(self, at: int, to: int) -> bytes:
        """As get() for a few bytes far ahead, without what lies between."""
        if to <= self.base + len(self.data):
            return self.get(at, to)
        self.file.seek(at)
        return self.file.read(to - at)

    def find(self, what: bytes, at: int) -> int:
        """First place of what from at on, or -1."""
        while True:
            here = self.data.find(what, at - self.base)
            if here >= 0:
                return self.base + here
            at = max(at, self.base + len(self.data) - len(what) + 1)
            self.forget(at)
            if not self.upto(self.base + len(self.data) + 1):
                return -1


class Held:
    """Bytes in memory, read as a Window is."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def forget(self, at: int) -> None:
        pass

    def upto(self, to: int) -> bool:
        return to <= self.size

    def get(self, at: int, to: int) -> bytes:
        return self.data[at:to]

    peek = get

    def find(self, what: bytes, at: int) -> int:
        return self.data.find(what, at)


def parse(head: bytes) -> dict[str, str]:
    """Names in lower case and values of a header block with its version line."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/") or not lines[0][5:].replace(b".", b"", 1).isdigit():
        raise Bad("version line")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and last:
            out[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Bad("header line")
        last = name.strip().decode("utf-8", "replace").lower()
        out[last] = value.strip().decode("utf-8", "replace")
    if not out.get("content-length", "").isdigit():
        raise Bad("content length")
    return out


def verify(headers: dict[str, str], block: bytes) -> Record:
    digest = headers.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:].upper():
        raise Bad("digest")
    return Record(headers, block)


def header_block(w: Window | Held, at: int) -> bytes:
    """The header block at a place, without its blank line. It is read on only while every line may belong to one."""
    if w.get(at, at + 5) != b"WARC/" or b"\r\n" not in w.get(at, at + VERSION):
        raise Bad("version line")
    size, seen = 1024, w.get(at, at + VERSION).find(b"\r\n") + 2
    while True:
        data = w.get(at, at + size)
        stop = data.find(b"\r\n\r\n", max(0, seen - 2))
        lines = data[seen : stop if stop >= 0 else None].split(b"\r\n")
        for line in lines if stop >= 0 else lines[:-1]:
            if line[:1] not in (b" ", b"\t") and b":" not in line:
                raise Bad("header line")
        if stop >= 0:
            return data[:stop]
        if len(data) < size:
            raise Bad("header block")
        seen = len(data) - len(lines[-1])
        size *= 4


def plain_record(w: Window | Held, at: int) -> tuple[Record, int]:
    """The record at a place of a plain file, and its end."""
    head = header_block(w, at)
    headers = parse(head)
    begin = at + len(head) + 4
    end = begin + int(headers["content-length"])
    if end + 4 > w.size:
        raise Bad("truncated")
    if w.peek(end, end + 4) != b"\r\n\r\n":
        raise Bad("record end")
    return verify(headers, w.get(begin, end)), end + 4


def member(w: Window, at: int) -> tuple[list[tuple[int, Record | str]], int]:
    """(place in the inflated bytes, record or reason of a gap) of all in the gzip member at a place, and the member's end."""
    if w.get(at, at + 3) != b"\x1f\x8b\x08":
        raise Bad("member magic")
    inflate = zlib.decompressobj(31)
    parts, p, size = [], at, 1 << 14
    while not inflate.eof:
        data = w.get(p, p + size)
        if not data:
            raise Bad("truncated")
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            raise Bad("member data") from None
        if p == at and len(parts[0]) >= READ and b"WARC/" not in parts[0]:
            raise Bad("version line")
        p += len(data)
        size = min(size * 4, READ)
    inside = [(begin, got) for begin, _, got in salvage(Held(b"".join(parts)), 0, 1 << 62, False)]
    if not any(isinstance(got, Record) for _, got in inside):
        raise Bad(inside[0][1] if inside else "empty member")
    return inside, p - len(inflate.unused_data)


def salvage(w: Window | Held, begin: int, end: int, zipped: bool) -> Iterator[tuple[int, int, Record | str | list]]:
    """(begin, end, what is there) of what begins in [begin, end): a record, or a member's contents; the reason of a gap."""
    read, mark = (member, b"\x1f\x8b\x08") if zipped else (plain_record, b"WARC/")

    def search(at: int) -> tuple[int, tuple | None]:
        """The next place where a record passes its checks, or the end of the file."""
        while (at := w.find(mark, at)) >= 0:
            try:
                return at, read(w, at)
            except Bad:
                at += 1
        return w.size, None

    at, found = begin, None
    if begin:
        w.base = begin
        at, found = search(begin)
        if at >= end:
            return
    while at < w.size:
        w.forget(at)
        reason = ""
        if found is None:
            try:
                found = read(w, at)
            except Bad as bad:
                reason = str(bad)
        if found is None:
            there, found = search(at + 1)
            yield at, there, reason
            at = there
            w.forget(at)
        if at >= end or found is None:
            return
        record, to = found
        yield at, to, record
        at, found = to, None


def _rows(file: str, at: int, to: int, got: Record | str | list) -> list[tuple]:
    if isinstance(got, list):
        return [_row(file, at, to if k == 0 else at, inner, x) for k, (inner, x) in enumerate(got)]
    return [_row(file, at, to, None, got)]


def _row(file: str, at: int, to: int, inner: int | None, got: Record | str) -> tuple:
    if isinstance(got, str):
        return "gap", file, at, to - at, inner, got, None, None, None, None, None, None
    h, body, status = got.headers, got.block, None
    if h.get("content-type", "").startswith("application/http"):
        head, gap, rest = body.partition(b"\r\n\r\n")
        first = head.split(b"\r\n")[0].split(b" ")
        if gap and len(first) > 1 and first[1].isdigit():
            status, body = int(first[1][:9]), rest
    return "record", file, at, to - at, inner, None, h.get("warc-type"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), status, body


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records and gaps of every .warc and .warc.gz file in a folder (a URI that all executors can reach)."""
    fs, path = filesystem(folder)
    splits = []
    for f in sorted(fs.get_file_info(pafs.FileSelector(path, recursive=True)), key=lambda f: f.path):
        if f.is_file and f.path.endswith((".warc", ".warc.gz")):
            step = split_bytes if f.path.endswith(".gz") else max(f.size, 1)
            splits += [(f.path, at, min(at + step, f.size)) for at in range(0, f.size, step)]
    names = [name.split()[0] for name in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        for batch in batches:
            for s in batch.to_pylist():
                with fs.open_input_file(s["path"]) as file:
                    rows, held = [], 0
                    for at, to, got in salvage(Window(file), s["begin"], s["end"], s["path"].endswith(".gz")):
                        new = _rows(os.path.basename(s["path"]), at, to, got)
                        rows += new
                        held += sum(len(r[-1] or b"") for r in new)
                        if held > 4 * READ:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    yield _batch(rows, names)

    parts = spark.createDataFrame(splits, "path string, begin long, `end` long")
    return parts.repartition(max(1, len(splits))).mapInArrow(run, SCHEMA)


_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=names)


def record(page_id: object, url: str | None, html: str | None) -> bytes:
    """A response record of one page."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    lines = ["WARC/1.0", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2020-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += ["Content-Type: application/http; msgtype=response", "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


LAYOUTS = ("members", "shared", "plain")


def write(pages: DataFrame, folder: str, layout: Callable[[object], str] | str = "members", harm: Callable[[object, bytes, bool], bytes] | None = None, key: str = "page_id", url: str = "url", html: str = "html", together: int = 8) -> None:
    """Archives for every partition, one of each layout that has a page: a gzip member a record, members of several records, or plain.

    harm changes a record's bytes, to make archives with known damage; in a layout of members the stored ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, path = filesystem(folder)
        fs.create_dir(path)
        files: dict[str, tuple[str, str, pa.NativeFile]] = {}
        waiting: list[bytes] = []
        n = 0

        def squeezed(data: bytes) -> bytes:
            squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
            return squeeze.compress(data) + squeeze.flush()

        for batch in batches:
            for page_id, u, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                how = layout if isinstance(layout, str) else layout(page_id)
                if how not in files:
                    name = f"{path}/{how}-{task.partitionId():06d}.warc" + ".gz" * (how != "plain")
                    # Each attempt has a file of its own; a finished one takes the name.
                    own = f"{name}.{task.taskAttemptId()}"
                    files[how] = name, own, fs.open_output_stream(own)
                data = record(page_id, u, h)
                if how == "members":
                    data = squeezed(data)
                data = harm(page_id, data, how == "members") if harm else data
                n += 1
                if how == "shared":
                    waiting.append(data)
                    if len(waiting) < together:
                        continue
                    data = squeezed(b"".join(waiting))
                    waiting.clear()
                files[how][2].write(data)
        if waiting:
            files["shared"][2].write(squeezed(b"".join(waiting)))
        for name, own, out in files.values():
            out.close()
            fs.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    pages.select(key, url, html).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def harmed(page_id: object, data: bytes, zipped: bool = True) -> bytes:
    """Damage of about one record in sixteen, by a hash of its id: a changed byte, a lost end, a lost beginning, bytes in between."""
    h = hashlib.md5(str(page_id).encode()).digest()
    if h[0] >= 16:
        return data
    if h[1] % 4 == 0:
        at = len(data) // 2
        return data[:at] + bytes([data[at] ^ 0x5A]) + data[at + 1 :]
    if h[1] % 4 == 1:
        return data[:-9]
    if h[1] % 4 == 2:
        return data[12:]
    return (b"\x1f\x8b\x08\x00 not a member" if zipped else b"WARC/1.0 not a record\r\n") + data


def laid_out(page_id: object) -> str:
    """Half of the pages in members of their own, a quarter in shared ones, a quarter in plain files."""
    return ("members", "members", "shared", "plain")[hashlib.md5(f"layout {page_id}".encode()).digest()[0] % 4]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is salvaged of archives of all pages with known damage: records, and gaps."""
    folder = scratch(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder, laid_out, harmed)
    got = read(spark, folder)
    return got.select(
        "kind", F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') AS BIGINT)").alias("page_id"),
        "file", "offset", "length", "inner", "reason", F.col("target_uri").alias("url"), F.md5("payload").alias("html_md5"),
    )
