"""Legacy ARC archives and their conversion to WARC.

``write_arc`` turns pages into ARC files (version 1 or 2: five or ten header
fields), a gzip member for each record.  ``index_arc`` parses such files, or any
others: the file header says the version, each record line, read from the right,
its fields and declared length; the url is what is left, spaces included.
``convert`` reads the files again and writes WARC files: a warcinfo record from
the file header, then one record for each ARC record, with an identifier derived
from the payload's digest and the record's place, the date of the ARC line, the
address, the type and SHA-256 digests.  ``read_warc`` reads those.

A record of HTTP is a response, or a revisit of an equal payload; one without an
HTTP head (such as ``dns:``) is a resource and is its own payload.  Dates of fewer
than 14 digits are filled up to the start of what they name.  Bytes of a url that
are not UTF-8 are percent-encoded, nothing is decoded.  A record that cannot be
read (no length, shorter than declared, no date, a damaged gzip member) is left
out of the conversion and is a row of ``rejects``; the records beside it stay.

Of responses with equal payloads of at least ``least`` bytes, the one of the
smallest page id (null last; then by url, file and place) is the response, and
the others revisit it.  Shorter payloads are always responses.

Files go to a folder that driver and executors share.  A file has a name of
its own for every attempt and is known only through the committed list of its
task, so lost executors and repeated attempts leave no half-read file behind.
A file holds at most ``FILE_BYTES`` of payload (or one record) and
``FILE_RECORDS`` records, which bounds what a task holds in memory.

Null html is an empty payload; null urls are written as ``-``, empty ones as two quotes; null page ids
are written empty and read back as null.  A page's url that cannot stand in a header line (line breaks, spaces
at its ends) is percent-encoded there and kept in the HTTP head.  Repeated rows are records of
their own; an empty table gives no file.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir
from .shared import quoted

FILE_BYTES = 4 << 20
FILE_RECORDS = 1024
LEAST = 100
#: The archive date of records whose source tells none.
DATE = "20000101000000"
_LEVEL = 4
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the name space of URLs


#: Names that Spark has for stores that Arrow knows by another.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _open(path: str):
    scheme, mark, rest = path.partition("://")
    path = f"{_SCHEMES.get(scheme, scheme)}{mark}{rest}" if mark else path
    files, inner = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return files, inner


def _store(folder: str, name: str, data: bytes) -> str:
    path = posixpath.join(folder, name)
    files, inner = _open(path)
    files.create_dir(posixpath.dirname(inner), recursive=True)
    with files.open_output_stream(inner, compression=None) as out:
        out.write(data)
    return path


def _load(path: str) -> bytes:
    files, inner = _open(path)
    with files.open_input_stream(inner, compression=None) as f:
        return f.read()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: Bytes of a file that a decompressor is given at once.
_WINDOW = 1 << 16


def members(data: bytes) -> Iterator[bytes]:
    """The content of each gzip member of a file; each byte is read once."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, parts = zlib.decompressobj(31), []
        while at < len(view) and not reader.eof:
            window = view[at:at + _WINDOW]
            parts.append(reader.decompress(window))
            at += len(window)
        at -= len(reader.unused_data)
        yield b"".join(parts)


# --- ARC

_FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def arc_header(name: str, version: int) -> bytes:
    """The record that opens an ARC file."""
    block = b"%d 0 plumbline\n%s\n" % (version, _FIELDS[version])
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain" + (" 200 - - 0 " + name if version == 2 else "") + f" {len(block)}\n"
    return line.encode() + block + b"\n"


def arc_record(url: str | None, page_id: int | None, payload: bytes, version: int, offset: int, name: str) -> bytes:
    told, fits = _line_url(url)
    kept = b"" if fits else b"X-Page-Url: %s\r\n" % quote(url, safe="").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Page-Id: %s\r\n%sContent-Length: %d\r\n\r\n" % (b"" if page_id is None else str(page_id).encode(), kept, len(payload)) + payload
    line = f"{told} 0.0.0.0 {DATE} text/html"
    if version == 2:
        line += f" 200 {zlib.crc32(payload):08x} - {offset} {name}"
    return f"{line} {len(block)}\n".encode() + block + b"\n"


def _line_url(url: str | None) -> tuple[str, bool]:
    """A url at the head of a line (``-`` for null, two quotes for an empty one), and whether it says all."""
    if not url:
        return "-" if url is None else '""', True
    fits = url == url.strip() and not re.search(r"[\x00-\x1f\x7f\x85\u2028\u2029]", url) and url not in ("-", '""')
    return (url, True) if fits else (quote(url, safe="") if url != "-" else "%2D", False)


def _whole_date(date: bytes) -> str:
    """14 digits of an archive date: what it leaves out is the start of what it names."""
    digits = date.decode("latin-1")
    if not digits.isdecimal() or not digits.isascii() or len(digits) < 4:
        raise ValueError("an archive date of no digits")
    whole = (digits + "00000101000000"[len(digits):])[:14]
    try:
        dt.datetime.strptime(whole, "%Y%m%d%H%M%S")
    except ValueError:
        raise ValueError("an archive date that is none") from None
    return whole


class ArcRecord:
    """One parsed record: url as it stands in the line, address, date, type, HTTP head (empty if there is none) and payload."""

    def __init__(self, line: bytes, block: bytes, version: int):
        fields = line.rsplit(b" ", len(_FIELDS[version].split(b" ")) - 1)
        if len(fields) != len(_FIELDS[version].split(b" ")):
            raise ValueError(f"an ARC {version} line of {len(fields)} fields")
        try:
            told = fields[0].decode()
        except UnicodeDecodeError:
            told = "".join(chr(c) if c < 128 else f"%{c:02X}" for c in fields[0])
        self.target = None if told == "-" else "" if told == '""' else told
        self.address, self.mime = fields[1].decode("latin-1"), fields[3].decode("latin-1")
        self.date = _whole_date(fields[2])
        self.http, self.payload = b"", block
        if block.startswith(b"HTTP/"):
            end = re.search(rb"\r?\n\r?\n", block)
            cut = end.end() if end else len(block)
            self.http, self.payload = block[:cut], block[cut:]
        page = re.search(rb"(?mi)^X-Page-Id: *(-?\d+)\r?$", self.http)
        self.page_id = int(page[1]) if page else None
        self.url = _page_url(self.http, self.target)


def _page_url(http: bytes, target: str | None) -> str | None:
    kept = re.search(rb"(?mi)^X-Page-Url: *(\S+)\r?$", http)
    return unquote(kept[1].decode("latin-1")) if kept else target


class Reject:
    """What could not be read as a record, and its size."""

    def __init__(self, reason: str, size: int):
        self.reason, self.size = reason, size


def parse_arc(data: bytes, strict: bool = True) -> Iterator[ArcRecord | Reject]:
    """The records of an ARC file, one gzip member each or none at all; unless ``strict``, what is damaged comes as ``Reject``."""
    def refuse(reason: str, size: int) -> Reject:
        if strict:
            raise ValueError(reason)
        return Reject(reason, size)

    version = None
    try:
        for chunk in members(data) if data[:2] == b"\x1f\x8b" else iter([data]):
            at = 0
            while at < len(chunk):
                if chunk[at:at + 1] in (b"\n", b"\r"):  # records are set apart by line ends
                    at += 1
                    continue
                stop = chunk.find(b"\n", at)
                line = chunk[at:stop].rstrip(b"\r") if stop >= 0 else b""
                size = line.rpartition(b" ")[2]
                if not size.isdigit():
                    yield refuse("an ARC line without a length", len(chunk) - at)
                    break
                end = stop + 1 + int(size)
                if end > len(chunk):
                    yield refuse("an ARC record is shorter than its declared length", len(chunk) - at)
                    break
                block, at = chunk[stop + 1:end], end
                if version is None:
                    first = block.split(b" ", 1)[0]
                    if not line.startswith(b"filedesc:") or first not in (b"1", b"2"):
                        yield refuse("not an ARC file", len(data))
                        return
                    version = int(first)
                    continue
                try:
                    record = ArcRecord(line, block, version)
                except ValueError as e:
                    yield refuse(str(e), len(block))
                    continue
                yield record
    except zlib.error as e:
        yield refuse(f"a damaged gzip member: {e}", len(data))


def arc_info(data: bytes) -> tuple[str, str, bytes]:
    """(name, date, block) of the record that opens an ARC file."""
    chunk = next(members(data)) if data[:2] == b"\x1f\x8b" else data
    stop = chunk.index(b"\n")
    line = chunk[:stop].rstrip(b"\r")
    name, _, _ = line.partition(b" ")
    fields = line.split(b" ")
    try:
        date = _whole_date(fields[2])
    except (ValueError, IndexError):
        date = DATE
    return name.decode("latin-1").removeprefix("filedesc://"), date, chunk[stop + 1:stop + 1 + int(line.rpartition(b" ")[2])]


def write_arc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages as ARC files, versions in turn; (path, records) of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[str, int]] = []
        held: list[bytes] = []
        size = places = at = 0
        name, version = "", 2

        def close():
            nonlocal held, size, places
            if places:
                made.append((_store(folder, name, b"".join(held)), places))
            held, size, places = [], 0, 0

        for batch in batches:
            for page_id, address, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = page.as_buffer().to_pybytes() if page.is_valid else b""
                if not places or size + len(payload) > FILE_BYTES or places >= FILE_RECORDS:
                    close()
                    name, version = f"{uuid.uuid4().hex}.arc.gz", 3 - version
                    held = [_gzip(arc_header(name, version))]
                    at = len(held[0])
                held.append(_gzip(arc_record(address, page_id, payload, version, at, name)))
                at += len(held[-1])
                size += len(payload)
                places += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int32())], names=["path", "records"])

    rows = pages.select(quoted(key).cast("long").alias("k"), quoted(url).alias("u"), quoted(html).alias("h"))
    return cut_lineage(rows.mapInArrow(run, "path string, records int"))


def _spread(files: DataFrame) -> DataFrame:
    """A few files to a task."""
    tasks = max(1, files.count() // 4)
    return files.repartition(tasks)


def index_arc(files: DataFrame) -> DataFrame:
    """(path, place, page_id, bytes, digest, url, http, reason) of every record of the ARC files (path); a reason if it is rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = [(path, i, None, r.size, None, None, None, r.reason) if isinstance(r, Reject)
                        else (path, i, r.page_id, len(r.payload), hashlib.sha256(r.payload).hexdigest(), r.url, bool(r.http), None) for i, r in enumerate(parse_arc(_load(path), False))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "place", "page_id", "bytes", "digest", "url", "http", "reason"])

    return cut_lineage(_spread(files.select("path")).mapInArrow(run, "path string, place int, page_id long, bytes long, digest string, url string, http boolean, reason string"))


def rejects(files: DataFrame) -> DataFrame:
    """(path, place, bytes, reason) of what cannot be read as a record."""
    return index_arc(files).where("reason is not null").select("path", "place", "bytes", "reason")


def revisits(index: DataFrame, least: int = LEAST) -> DataFrame:
    """(path, place, of_page, of_path, of_place): the records that revisit another, and which."""
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "path", "place")
    long = index.where((F.col("bytes") >= least) & F.col("http"))
    shared = cut_lineage(long.groupBy("digest").agg(F.min(key).alias("of"), F.count("*").alias("n")).where("n > 1")
                         .select("digest", F.col("of.page_id").alias("of_page"), F.col("of.path").alias("of_path"), F.col("of.place").alias("of_place")))
    return long.join(shared, "digest").where("path <> of_path or place <> of_place").select("path", "place", "of_page", "of_path", "of_place")


# --- WARC

def record_id(digest: str, path: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{digest}/{posixpath.basename(path)}/{place}')}>"


def _warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _lines(head: list[str], block: bytes) -> bytes:
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_info(data: bytes, path: str) -> tuple[str, bytes]:
    """(identifier, record) of the warcinfo that an ARC file's header becomes."""
    name, date, header = arc_info(data)
    own = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'warcinfo/{posixpath.basename(path)}')}>"
    block = f"format: WARC File Format 1.1\r\nconverted-from: {quote(name, safe='/:.-_')}\r\narc-header: ".encode() + b" / ".join(header.split(b"\n")).strip(b" /") + b"\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {own}", f"WARC-Date: {_warc_date(date)}", f"WARC-Filename: {posixpath.basename(path)}", "Content-Type: application/warc-fields"]
    return own, _lines(head, block)


def warc_record(r: ArcRecord, path: str, place: int, refers: dict | None, info: str | None = None) -> bytes:
    """The WARC record of an ARC record; ``refers`` says which record it revisits."""
    digest = hashlib.sha256(r.payload).hexdigest()
    block = r.http if refers else r.http + r.payload
    kind = "revisit" if refers else "response" if r.http else "resource"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(digest, path, place)}",
            f"WARC-Date: {_warc_date(r.date)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
            f"X-Payload-Length: {len(r.payload)}"]
    if info:
        head.append(f"WARC-Warcinfo-ID: {info}")
    if r.target is not None:
        head.append(f"WARC-Target-URI: {r.target}")
    if r.address not in ("0.0.0.0", "-"):
        head.append(f"WARC-IP-Address: {r.address}")
    if refers:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(digest, refers['of_path'], refers['of_place'])}",
                 f"X-Refers-To-Page: {'' if refers['of_page'] is None else refers['of_page']}"]
    return _lines([*head, f"Content-Type: {'application/http; msgtype=response' if r.http else r.mime}"], block)


def convert(files: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes a WARC file for each ARC file (path) that holds a record; (path) of those."""
    index = index_arc(files)
    of = revisits(index, least).groupBy("path").agg(F.collect_list(F.struct("place", "of_page", "of_path", "of_place")).alias("refers"))
    work = cut_lineage(files.select("path").join(of, "path", "left"))  # a list is no longer than its file's records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                refers, data, path = {x["place"]: x for x in row["refers"] or ()}, _load(row["path"]), row["path"]
                found = [(i, r) for i, r in enumerate(parse_arc(data, False)) if not isinstance(r, Reject)]
                if found:
                    info, head = warc_info(data, path)
                    body = _gzip(head) + b"".join(_gzip(warc_record(r, path, i, refers.get(i), info)) for i, r in found)
                    out.append(_store(folder, f"{uuid.uuid4().hex}.warc.gz", body))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["path"])

    return cut_lineage(_spread(work).mapInArrow(run, "path string"))


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file."""
    for chunk in members(data) if data[:2] == b"\x1f\x8b" else iter([data]):
        at = 0
        while at < len(chunk):
            stop = chunk.index(b"\r\n\r\n", at)
            lines = chunk[at:stop].decode(errors="replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("not a WARC record")
            head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
            size = int(head["Content-Length"])
            yield head, chunk[stop + 4:stop + 4 + size]
            at = stop + 4 + size + 4


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, url string, warc_date string"


def read_warc(files: DataFrame) -> DataFrame:
    """One row per record of the WARC files (path); a response's payload is held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for head, block in parse_warc(_load(path)):
                    if head["WARC-Type"] == "warcinfo":
                        continue
                    end = re.search(rb"\r?\n\r?\n", block) if head["WARC-Type"] != "resource" else None
                    http, payload = (block[:end.end()], block[end.end():]) if end else (b"", block) if head["WARC-Type"] == "resource" else (block, b"")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    size = int(head["X-Payload-Length"])
                    if head["WARC-Type"] != "revisit" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
                    page = re.search(rb"(?mi)^X-Page-Id: *(-?\d+)\r?$", http)
                    of = head.get("X-Refers-To-Page")
                    rows.append((int(page[1]) if page else None, size, digest, head["WARC-Type"], int(of) if of else None, head["WARC-Record-ID"], _page_url(http, head.get("WARC-Target-URI")), head["WARC-Date"]))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split(" ")[0] for c in _READ.split(", ")])

    return _spread(files.select("path")).mapInArrow(run, _READ)


def through_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back."""
    spark = pages.sparkSession
    arcs = write_arc(pages, shared_dir(spark, "arc"))
    return read_warc(convert(arcs, shared_dir(spark, "warc"), least))
