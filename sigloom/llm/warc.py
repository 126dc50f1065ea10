"""Normaliser for monolithic gzip WARC files.

A WARC file compressed as one gzip stream cannot be read at a record's offset.
Each such file is inflated once, as a stream; every record is written again as
a gzip member of its own, and a sidecar lists the members' offsets, so that any
record is one seek and one inflate away.  Input that already has several
members (or mixes both) gives the same output.

A stream cannot be split, so the unit of work is a file, one to a task; records
are copied in chunks and only one record's compressed bytes are in memory.
Output is written under a name of its own and renamed when whole, over what an
earlier attempt has left; its bytes depend on the input alone, so a task that is
repeated after a lost executor leaves the same files.  Paths may be on any file
system that pyarrow opens.

Defined results: an empty file gives an empty file and sidecar; where a stream breaks
off, is damaged or shows no proper header, the record that it broke is lost, an index
row of type "damaged" and length 0 stands for it, and work goes on at the next gzip
member, or at the next line that begins a record, so all whole records that can still
be found are kept (nothing after the damage of a single stream can); a record without
a URI has a null one.  For ``from_pages``: null HTML is an empty payload, a null URL is left
out of the header, repeated rows are records each, line ends in a URL are
percent-escaped (the URI of such a record is the escaped one), extra columns are
ignored, and an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

CHUNK = 1 << 18
#: A header without an end within so many bytes is damage.
MAX_HEADER = 1 << 26
_MAGIC = b"\x1f\x8b\x08"
INDEX = "file string, record long, offset long, length long, type string, record_id string, uri string, payload_bytes long, sha1 string"
_INDEX = pa.schema([("file", pa.string()), ("record", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("payload_bytes", pa.int64()), ("sha1", pa.string())])


class Damaged(Exception):
    pass


def inflated(stream: BinaryIO) -> Iterator[bytes | None]:
    """Content of a gzip file of one or more members; None stands for what damage hides, up to the next member that inflates."""
    z, fresh, lost, tried = zlib.decompressobj(31), True, False, False
    data = b""
    while data or (data := stream.read(CHUNK)):
        try:
            if lost:  # look for a member's first bytes, also where a read divides them
                at = data.find(_MAGIC)
                if at < 0:
                    more = stream.read(CHUNK)
                    data = data[-2:] + more if more else b""
                    continue
                data, z, lost, tried = data[at:], zlib.decompressobj(31), False, True
            out = z.decompress(data, 4 * CHUNK)
        except zlib.error:
            if not (fresh and tried):  # else these bytes only look like a member's first, in a gap already told of
                yield None
            fresh, lost, data = True, True, data[1:]
            continue
        fresh = tried = False
        if out:
            yield out
        if z.eof:
            data, z, fresh = z.unused_data, zlib.decompressobj(31), True
            if not data.strip(b"\0"):  # padding
                data = b""
        else:
            data = z.unconsumed_tail
    if not fresh:
        yield None


class _Reader:
    def __init__(self, chunks: Iterator[bytes | None]):
        self.chunks, self.held, self.gap = chunks, b"", False

    def more(self) -> bool:
        """Whether there is more; a gap is no more until seek() has passed it."""
        if self.gap:
            return False
        for chunk in self.chunks:
            if chunk is None:
                self.gap = True
                return False
            self.held += chunk
            return True
        return False

    def seek(self) -> bool:
        """Go to the next line that begins a record; whether there is one."""
        start = False
        while True:
            if self.gap:
                self.held, self.gap, start = b"", False, True
            if start and self.held.startswith(b"WARC/"):
                return True
            at = self.held.find(b"\nWARC/")
            if at >= 0:
                self.held = self.held[at + 1 :]
                return True
            start = start and len(self.held) < 5
            if not start:
                self.held = self.held[-5:]
            if not self.more() and not self.gap:
                return False

    def skip_blank(self) -> bool:
        """Whether a record follows."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                return True
            if not self.more():
                return False

    def header(self) -> bytes:
        seen = 0
        while (end := self.held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.held)
            if seen > MAX_HEADER or not self.more():
                raise Damaged("no end of header")
        head, self.held = self.held[: end + 4], self.held[end + 4 :]
        return head

    def payload(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise Damaged("a record breaks off")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged("not a WARC header")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    if not out.get("content-length", "").isdigit():
        raise Damaged("no content length")
    return out


def normalise(source: BinaryIO, target: BinaryIO, name: str) -> list[dict]:
    """Rewrite one file; its index rows."""
    reader, rows, offset = _Reader(inflated(source)), [], 0
    row = lambda **x: dict.fromkeys(_INDEX.names) | {"file": name, "record": len(rows), "offset": offset} | x
    while True:
        try:
            if not reader.skip_blank():
                if reader.gap:
                    raise Damaged("the stream breaks off")
                return rows
            head = reader.header()
            fields = _fields(head)
            size, sha = int(fields["content-length"]), hashlib.sha1()
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            parts = [z.compress(head)]
            for part in reader.payload(size):
                sha.update(part)
                parts.append(z.compress(part))
            parts += [z.compress(b"\r\n\r\n"), z.flush()]
            member = b"".join(parts)
            target.write(member)
            rows.append(row(length=len(member), type=fields.get("warc-type"), record_id=fields.get("warc-record-id"), uri=fields.get("warc-target-uri"), payload_bytes=size, sha1=sha.hexdigest()))
            offset += len(member)
        except Damaged:
            rows.append(row(length=0, type="damaged"))
            if not reader.seek():
                return rows


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inner = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return fs, inner


def _plain(uri: str) -> str:
    """Hadoop writes file:/x; pyarrow reads file:///x."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _commit(fs: pafs.FileSystem, files: dict[str, str]) -> None:
    for temporary, final in files.items():
        try:
            fs.move(temporary, final)
        except OSError:  # some file systems do not move onto a file, which a former attempt has left
            if fs.get_file_info(final).type == pafs.FileType.NotFound:
                raise
            fs.delete_file(final)
            fs.move(temporary, final)


def normalise_files(spark: SparkSession, paths: list[str], out_dir: str) -> DataFrame:
    """Rewrite each file into out_dir with a sidecar ``<name>.idx``; the index rows of all, from a table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in (held.value[i] for i in batch.column(0).to_pylist()):
                source_fs, source = _fs(_plain(path))
                fs, folder = _fs(_plain(out_dir))
                fs.create_dir(folder, recursive=True)
                own = f"{folder}/.{base}-{uuid.uuid4().hex}"
                with source_fs.open_input_stream(source, compression=None) as a, fs.open_output_stream(own, compression=None) as b:
                    rows = normalise(a, b, base)
                with fs.open_output_stream(f"{own}.idx", compression=None) as f:
                    for r in rows:
                        f.write(json.dumps(r).encode() + b"\n")
                _commit(fs, {own: f"{folder}/{base}", f"{own}.idx": f"{folder}/{base}.idx"})
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(set(names)) < len(names):
        names = [f"{i:06d}-{n}" for i, n in enumerate(names)]
    if not paths:
        return spark.createDataFrame([], INDEX)
    held = spark.sparkContext.broadcast(list(zip(paths, names, strict=True)))  # names only, as they were given
    return written(spark.range(0, len(paths), 1, len(paths)).mapInArrow(work, INDEX), "warc-index")


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def from_pages(pages: DataFrame, out_dir: str) -> list[str]:
    """Write pages(page_id, url, html) as monolithic WARC files, one to a task; their paths."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(_plain(out_dir))
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, z, any_rows = f"{folder}/.{name}-{uuid.uuid4().hex}", zlib.compressobj(6, zlib.DEFLATED, 31), False
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(own, compression=None) as f:
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    f.write(z.compress(record(*row)))
                    any_rows = True
            f.write(z.flush())
        if any_rows:
            _commit(fs, {own: f"{folder}/{name}"})
            yield pa.RecordBatch.from_pydict({"name": [name]})
        else:
            fs.delete_file(own)

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return sorted(f"{_plain(out_dir)}/{r[0]}" for r in rows.mapInArrow(work, "name string").collect())


def read_at(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of the record at an offset of a normalised file."""
    fs, inner = _fs(_plain(path))
    with fs.open_input_file(inner) as f:
        f.seek(offset)
        reader = _Reader(iter([zlib.decompress(f.read(length), 31)]))
    fields = _fields(reader.header())
    return fields, b"".join(reader.payload(int(fields["content-length"])))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as monolithic WARC files, normalised: where each page's record is."""
    raw, out = new_path(spark, "warc-raw"), new_path(spark, "warc")
    index = normalise_files(spark, from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), raw), out)
    return index.select(F.regexp_extract("record_id", r"<urn:page:(-?\d+)>", 1).try_cast("long").alias("page_id"), *[c.split()[0] for c in INDEX.split(", ")])
