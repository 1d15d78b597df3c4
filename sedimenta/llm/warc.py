"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

The reader follows the public ``.warc.zst`` layout: the file may begin with a skippable frame
(magic ``0x184D2A5D``) that holds a dictionary, plain or itself compressed; every further
frame is one record. A frame is decoded by itself, its header lines are parsed and its length is
held against ``Content-Length``. What is wrong with a record is a column of its row, and one
bad record doesn't hide those after it: a frame's end is found from the sizes of its blocks, without
decoding it, and where those are damaged too the next frame is searched for. A file is read in
chunks, so a task holds one frame at a time, whatever the file's size; time grows with its bytes.

The writer makes such archives from a table, one file per task.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table

DICT_MAGIC, FRAME_MAGIC, DICT_CONTENT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Bytes of a dictionary, of the sample it is made from, and of an archive before the next is begun.
DICT_SIZE, SAMPLE_SIZE, ARCHIVE_SIZE = 32 << 10, 4 << 20, 64 << 20
#: Bytes that fit into a column of one row: a larger record has its headers, an error and no content.
RECORD_LIMIT = (1 << 31) - (1 << 16)
#: Bytes of an archive that are read at once.
CHUNK = 4 << 20
REQUIRED = ("warc-record-id", "warc-date", "warc-type", "content-length")
SCHEMA = "archive string, offset long, record_id string, warc_type string, uri string, date string, content_length long, content binary, error string"
_RECORD_ID = re.compile(r"<[A-Za-z][A-Za-z0-9+.\-]*:[^<>\s]+>")
_DATE = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?Z")


class ArchiveError(ValueError):
    """The bytes aren't a Zstandard archive, or its dictionary can't be read."""


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there; works on drivers and executors alike."""
    if re.match(r"[a-z][a-z0-9+]*:", uri):
        return pafs.FileSystem.from_uri("file://" + urllib.parse.urlparse(uri).path if uri.startswith("file:") else uri)
    return pafs.LocalFileSystem(), uri


# writing


def record_bytes(record_id: str, uri: str | bytes | None, content: bytes, date: str = "2024-01-01T00:00:00Z", kind: str = "resource") -> bytes:
    """One record: version line, headers, a blank line, the content and two line ends."""
    lines = [x.encode() for x in ("WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}", f"Content-Length: {len(content)}", "Content-Type: text/html")]
    if uri is not None:
        lines.insert(2, b"WARC-Target-URI: " + re.sub(rb"[\r\n]+", b" ", uri.encode() if isinstance(uri, str) else uri))
    return b"\r\n".join(lines) + b"\r\n\r\n" + content + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes, compress: bool = True) -> bytes:
    """The leading skippable frame."""
    body = zstandard.ZstdCompressor(level=3).compress(dictionary) if compress else dictionary
    return struct.pack("<II", DICT_MAGIC, len(body)) + body


def archive_bytes(records: list[bytes], dictionary: bytes | None, level: int = 3) -> bytes:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    c = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
    return (dictionary_frame(dictionary) if dictionary else b"") + b"".join(map(c.compress, records))


def make_dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary from sample records; None where there are too few to make one."""
    if len(samples) < 16 or sum(map(len, samples)) < 4096:
        return None
    try:
        return zstandard.train_dictionary(DICT_SIZE, samples).as_bytes()
    except zstandard.ZstdError:
        return None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", content_col: str = "html") -> DataFrame:
    """Writes every row as a record and returns (archive, records) of the files, written once.

    The record's id is made from the row's own id, so the same table gives the same records. A file
    is written under a draft name and renamed: a task that is lost and run again leaves no half
    file, and the list names only the files of the tasks that counted.

    A row without id gets one from its content; without a URI it has no such header; without content
    it is a record of type ``metadata``, and with an empty one a plain record of no bytes. Line ends in a URI become
    a blank. Texts of any length and bytes that aren't UTF-8 are kept as they are; repeated
    rows are repeated records; extra columns are ignored; an empty table gives no file and no row.
    """
    d = pages.select(*(F.col(f"`{c}`").cast("string").cast("binary").alias(name) for c, name in ((id_col, "id"), (uri_col, "uri"), (content_col, "content"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            samples, size = [], 0
            for r in records:
                samples.append(r)
                size += len(r)
                if size > SAMPLE_SIZE:
                    break
            name = f"{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(archive_bytes(records, make_dictionary(samples)))
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(records)], pa.int64())], ["archive", "records"])

        held, size = [], 0
        for batch in batches:
            for i, uri, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                # a row without an id still is a record; its id is of its content
                name = i.decode("utf-8", "replace") if i is not None else "none:" + hashlib.sha256(content or b"").hexdigest()
                body = content or b""
                kind = "metadata" if content is None else "resource"
                held.append(record_bytes(f"row-{urllib.parse.quote(name, safe='-:')}", uri, body, kind=kind))
                size += len(body)
                if size > ARCHIVE_SIZE:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    from .common import cut

    return cut(d.mapInArrow(run, "archive string, records long"))


# reading


def read_dictionary(data: memoryview) -> tuple[bytes | None, int]:
    """(dictionary, bytes before the first record's frame)."""
    if len(data) < 4:
        raise ArchiveError("shorter than a frame")
    magic = struct.unpack_from("<I", data)[0]
    if magic != DICT_MAGIC:
        return None, 0
    if len(data) < 8:
        raise ArchiveError("the dictionary frame is cut off")
    size = struct.unpack_from("<I", data, 4)[0]
    body = bytes(data[8 : 8 + size])
    if len(body) < size or size < 4:
        raise ArchiveError("the dictionary frame is cut off")
    first = struct.unpack_from("<I", body)[0]
    if first == FRAME_MAGIC:
        try:
            body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the dictionary can't be decoded: {e}") from e
    elif first != DICT_CONTENT:
        raise ArchiveError("the dictionary is neither plain nor compressed")
    return body, 8 + size


def parse_record(raw: bytes) -> dict:
    """Columns of one decoded record; ``error`` says what is wrong, else it is None."""
    out = dict.fromkeys(("record_id", "warc_type", "uri", "date", "content_length", "content", "error"))

    def bad(why: str) -> dict:
        out["error"] = why
        return out

    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        return bad("no end of headers")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return bad("not a version line")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return bad("a header line without a name")
        last = name.lower()
        if last in fields and last != "warc-concurrent-to":
            return bad(f"header {last} occurs twice")
        fields[last] = value.strip()
    out |= {"record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date")}
    if missing := [x for x in REQUIRED if not fields.get(x)]:
        return bad("missing " + ", ".join(missing))
    if not _RECORD_ID.fullmatch(fields["warc-record-id"]):
        return bad("the record id isn't a URI in angle brackets")
    if not _DATE.fullmatch(fields["warc-date"]):
        return bad("the date isn't in UTC form")
    if not re.fullmatch(r"[0-9]{1,18}", fields["content-length"]):
        return bad("the content length isn't a number")
    length = out["content_length"] = int(fields["content-length"])
    if len(rest) != length + 4:
        return bad(f"content of {max(0, len(rest) - 4)} bytes where {length} are announced")
    if rest[length:] != b"\r\n\r\n":
        return bad("the record doesn't end in two line ends")
    out["content"] = rest[:length]
    return out


class Window:
    """The part of a file that is in memory: from the frame at hand on, as far as was needed."""

    def __init__(self, f: BinaryIO):
        self.f, self.lo, self.buf, self.ended = f, 0, bytearray(), False

    def has(self, at: int, n: int) -> bool:
        """Whether the file has ``n`` bytes from place ``at`` on; they are in memory then."""
        while not self.ended and at + n > self.lo + len(self.buf):
            got = self.f.read(max(CHUNK, at + n - self.lo - len(self.buf)))
            self.buf += got
            self.ended = not got
        return at + n <= self.lo + len(self.buf)

    def bytes(self, at: int, n: int) -> bytes:
        self.has(at, n)
        return bytes(memoryview(self.buf)[at - self.lo : at - self.lo + n])

    def forget(self, at: int) -> None:
        """What lies before ``at`` isn't asked for again; memory is moved once a chunk, not once a record."""
        if at - self.lo >= CHUNK:
            del self.buf[: at - self.lo]
            self.lo = at

    def find_magic(self, at: int) -> int | None:
        """The next place that looks like the start of a frame."""
        while True:
            found = _MAGICS.search(self.buf, at - self.lo)
            if found:
                return self.lo + found.start()
            at = max(at, self.lo + len(self.buf) - 3)
            self.forget(at)
            if not self.has(at, len(self.buf) - (at - self.lo) + 1):
                return None


_MAGICS = re.compile(rb"\x28\xb5\x2f\xfd|[\x50-\x5f]\x2a\x4d\x18")


def frame_end(w: Window, at: int) -> int | None:
    """Where the frame at ``at`` ends, by its header and the sizes of its blocks; None if it isn't a whole frame."""
    head = w.bytes(at, 18)
    if len(head) < 8:
        return None
    magic, size = struct.unpack_from("<II", head)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + size if w.has(at, 8 + size) else None
    if magic != FRAME_MAGIC:
        return None
    flags = head[4]
    if flags & 8:  # reserved
        return None
    single = flags >> 5 & 1
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        if not w.has(pos, 3):
            return None
        block = int.from_bytes(w.bytes(pos, 3), "little")
        kind = block >> 1 & 3
        if kind == 3 or block >> 3 > 128 << 10 and kind != 1:
            return None
        pos += 3 + (1 if kind == 1 else block >> 3)
        if block & 1:
            pos += 4 * (flags >> 2 & 1)
            return pos if w.has(at, pos - at) else None


def _decode(d: zstandard.ZstdDecompressor, frame: bytes) -> tuple[bytes, bool]:
    """(the frame's bytes, whether that is all): no more than its beginning where a row can't hold them."""
    size = zstandard.frame_content_size(frame)
    if 0 <= size <= RECORD_LIMIT:
        return d.decompress(frame) if size else d.decompressobj().decompress(frame), True
    out = bytearray()
    for piece in d.read_to_iter(frame):
        out += piece
        if size > RECORD_LIMIT and len(out) > 1 << 20 or len(out) > RECORD_LIMIT:
            return bytes(out[: 1 << 20]), False
    return bytes(out), True


def records(data: bytes | BinaryIO) -> Iterator[dict]:
    """The records of an archive, in order, each with its frame's ``offset``.

    A frame that can't be decoded gives a row that says so, and the next follows it. Where not even its end can be
    found, or no frame follows there, one row stands for all up to the next whole frame. Skippable frames between
    records are passed over. An empty file has no records; one whose dictionary can't be read has one row.
    """
    w = Window(io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data)
    if not w.has(0, 1):
        return
    wrong = lambda at, why: parse_record(b"") | {"offset": at, "error": why}
    try:
        head = w.bytes(0, 8)
        size = struct.unpack_from("<I", head, 4)[0] if len(head) == 8 and head[:4] == struct.pack("<I", DICT_MAGIC) else 0
        dictionary, at = read_dictionary(memoryview(w.bytes(0, 8 + size)))
    except ArchiveError as e:
        yield wrong(0, str(e))
        return
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def follows(end: int | None) -> bool:
        """A whole frame ends at ``end``: the file does too, or another begins there."""
        return end is not None and (not w.has(end, 1) or _MAGICS.match(w.bytes(end, 4)) is not None)

    while w.has(at, 1):
        w.forget(at)
        end = frame_end(w, at)
        if not follows(end):
            # the next frame that is whole; a chance match inside the damage isn't
            nxt = w.find_magic(at + 1)
            while nxt is not None and not follows(frame_end(w, nxt)):
                nxt = w.find_magic(nxt + 1)
            whole = end is not None and w.bytes(at, 4) == struct.pack("<I", FRAME_MAGIC)
            raw = None
            if whole:
                try:
                    raw = _decode(d, w.bytes(at, end - at))
                except zstandard.ZstdError:
                    pass
            if raw is None:
                yield wrong(at, "frame: damaged or cut off; its end can't be found")
                if nxt is None:
                    return
                at = nxt
                continue
            # a good frame with rubbish behind it
            yield (parse_record(raw[0]) if raw[1] else _too_large(raw[0])) | {"offset": at}
            at = end
            continue
        frame = w.bytes(at, end - at)
        if frame[:4] == struct.pack("<I", FRAME_MAGIC):
            try:
                raw, whole = _decode(d, frame)
                yield (parse_record(raw) if whole else _too_large(raw)) | {"offset": at}
            except zstandard.ZstdError as e:
                yield wrong(at, f"frame: {e}")
        at = end


def _too_large(beginning: bytes) -> dict:
    return parse_record(beginning) | {"content": None, "error": f"a record of over {RECORD_LIMIT} bytes"}


def read_archives(archives: DataFrame, column: str = "archive") -> DataFrame:
    """(archive, offset, record_id, ..., content, error): a row for each record of the named files.

    Files are spread over tasks, and a task holds one frame at a time. A null name has no records;
    a file named twice is read twice; one that can't be opened gives a row with the error. Contents may be
    empty, of any bytes and of up to ``RECORD_LIMIT`` bytes. Extra columns are ignored; an empty table gives no rows.
    """
    names = ("archive", "offset", "record_id", "warc_type", "uri", "date", "content_length", "content", "error")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path is None:
                    continue
                rows, size = [], 0
                try:
                    fs, at = open_fs(path)
                    with fs.open_input_stream(at, compression=None) as f:
                        for r in records(f):
                            rows.append(r | {"archive": path})
                            size += len(r["content"] or b"")
                            if size > 4 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)], names)
                                rows, size = [], 0
                except OSError as e:
                    rows.append(parse_record(b"") | {"archive": path, "offset": 0, "error": f"file: {os.strerror(e.errno) if e.errno else e}"})
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds)], names)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select(F.col(f"`{column}`").alias("archive")).repartition(n).mapInArrow(run, SCHEMA)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``pages``, written as archives and read back: (page_id, url, html, error)."""
    written = write_archives(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    got = read_archives(written)
    page = F.regexp_extract("record_id", r"^<urn:uuid:row-(-?\d+)>$", 1)
    html = F.when(F.col("warc_type") != "metadata", F.col("content").cast("string"))
    return got.select(F.when(page != "", page.cast("long")).alias("page_id"), F.col("uri").alias("url"), html.alias("html"), "error")


ORACLE_SQL = "SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS error FROM pages"
