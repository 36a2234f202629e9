"""Legacy ARC archives, their conversion to WARC, and reading both.

An ARC file begins with a record that names its version and fields. Version 1 headers
have five fields, version 2 ten; the last is the length of what follows. A record
becomes a WARC record with an id made from its place, the date in ISO form, a type,
and digests of block and payload. Of records with one payload one stays a response, the
others become revisits of it, without the payload.

Files are written and read in streams by tasks, one record at a time, each record a
gzip member. A task that is run again writes files of new names; only names
in the returned table count. What is grouped over all records is their index, never payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import work_dir
from .common import written

# Field names of the two ARC versions, WARC terms.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: (
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

#: An archive file ends after so many records or bytes.
FILE_RECORDS, FILE_BYTES = 20_000, 256 << 20
LEVEL = 4
#: Tasks that read or write archives in one stage; with more files than that a task takes several.
MOST_TASKS = 100_000
#: HTTP header that carries the record's own id through the archives.
ID_HEADER = "X-Record-Id"
NO_DATE = "19700101000000"

FILES = "file string, records long"
INDEX = "file string, place long, id long, url string, date string, payload_bytes long, payload_digest string"
RECORDS = (
    "record_id string, record_type string, id long, url string, date string, payload_bytes long,"
    " payload_digest string, refers_to_id string"
)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


class Stream:
    """Bytes of a file of gzip members, or of a plain file."""

    def __init__(self, raw: BinaryIO, chunk: int = 1 << 18) -> None:
        self.raw, self.chunk, self.held, self.at = raw, chunk, b"", 0
        self.packed = raw.read(chunk)
        self.inflate = zlib.decompressobj(31) if self.packed[:2] == b"\x1f\x8b" else None

    def _more(self) -> bytes:
        while self.packed:
            if self.inflate is None:
                out, self.packed = self.packed, self.raw.read(self.chunk)
                return out
            out = self.inflate.decompress(self.packed)
            self.packed = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            self.packed = self.packed or self.raw.read(self.chunk)
            if out:
                return out
        return b""

    def read(self, n: int) -> bytes:
        parts, have = [self.held[self.at :]], len(self.held) - self.at
        while have < n and (more := self._more()):
            parts.append(more)
            have += len(more)
        self.held, self.at = b"".join(parts), min(n, have)
        return self.held[: self.at]

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            more = self._more()
            if not more:
                rest = self.held[self.at :]
                self.held, self.at = b"", 0
                return rest or None
            self.held, self.at = self.held[self.at :] + more, 0
        out, self.at = self.held[self.at : end], end + 1
        return out.rstrip(b"\r")


class Writer:
    """Archive files of one task: a new one whenever the last is full."""

    def __init__(self, folder: str, suffix: str, head) -> None:
        self.fs, self.folder = open_folder(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.suffix, self.head, self.out, self.done = suffix, head, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name, self.records = f"{uuid.uuid4().hex}{self.suffix}", 0
            self.out = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self._put(self.head(self.name))
        self._put(data)
        self.records += 1
        if self.records >= FILE_RECORDS or self.out.tell() >= FILE_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.out.write(pack.compress(data) + pack.flush())

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records))
            self.out = None

    def files(self) -> pa.RecordBatch:
        self.close()
        done, self.done = self.done, []
        return pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["file", "records"]
        )


def clean_url(url: str | None, id_: int | None) -> str:
    """An address without blanks or control characters, as header fields need it."""
    if not url:
        return f"urn:record:{id_}" if id_ is not None else "urn:record:none"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def http_block(id_: int | None, payload: bytes) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head += f"{ID_HEADER}: {id_}\r\n" if id_ is not None else ""
    return f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_record(version: int, values: dict[str, str], block: bytes) -> bytes:
    values = values | {"Archive-length": str(len(block))}
    line = " ".join(values.get(name) or "-" for name in ARC_FIELDS[version])
    return line.encode() + b"\n" + block + b"\n"


def arc_head(version: int, name: str) -> bytes:
    block = f"{version} 0 archive\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": NO_DATE, "Content-type": "text/plain"}
    return arc_record(version, values | {"Result-code": "200", "Filename": name}, block)


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """ARC files of all pages (page_id, url, html); a task takes the versions in turn. Returns (file, records).

    A null html is an empty payload, a null url an address made from the id.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers = {v: Writer(folder, f".v{v}.arc.gz", lambda name, v=v: arc_head(v, name)) for v in versions}
        count = 0
        for batch in batches:
            for id_, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                version = versions[count % len(versions)]
                count += 1
                block = http_block(id_, (html or "").encode("utf-8", "surrogatepass"))
                values = {
                    "URL": clean_url(url, id_), "IP-address": "0.0.0.0", "Archive-date": NO_DATE, "Content-type": "text/html",
                    "Result-code": "200",
                }
                writers[version].add(arc_record(version, values, block))
        for writer in writers.values():
            yield writer.files()

    return written(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, FILES), "arc-files")


def arc_fields(line: bytes, names: tuple[str, ...]) -> dict[str, str]:
    """A header line by field name. Only an address may hold blanks, so the other fields count from the end."""
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header of {len(names)} fields: {line[:200]!r}")
    return dict(zip(names, parts, strict=True))


def arc_records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record after the first, which tells the version."""
    line = stream.line()
    if line is None:
        return
    length = int(line.rsplit(b" ", 1)[-1])
    about = stream.read(length).split(b"\n")
    version = int(about[0].split()[0])
    names = tuple(about[1].decode().split()) if len(about) > 1 and about[1].strip() else ARC_FIELDS[version]
    if len(names) != len(ARC_FIELDS.get(version, names)):
        raise ValueError(f"fields do not fit ARC version {version}")
    while (line := stream.line()) is not None:
        if not line:  # records may be set apart by empty lines
            continue
        values = arc_fields(line, names)
        block = stream.read(length := int(values[names[-1]]))
        if len(block) < length:
            raise ValueError("the file ends inside a record")
        yield values, block


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head, with the empty line, and payload. Without HTTP head all is payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def head_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """Fourteen digits as an instant; missing digits are the least, others the epoch's."""
    d = date if date.isdigit() and 4 <= len(date) <= 14 else NO_DATE
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_uri(file: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}/{place}')}>"


def _own_id(head: bytes) -> int | None:
    value = head_value(head, ID_HEADER)
    return int(value) if value and re.fullmatch(r"-?[0-9]+", value) else None


def arc_index(files: DataFrame, folder: str) -> DataFrame:
    """A narrow row for every record of the ARC files."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{file}", compression=None) as raw:
                    for place, (values, block) in enumerate(arc_records(Stream(raw))):
                        head, payload = split_http(block)
                        rows.append((file, place, _own_id(head), values["URL"], values["Archive-date"], len(payload), digest(payload)))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("file", "place", "id", "url", "date", "payload_bytes", "payload_digest"), r, strict=True)) for r in rows],
                    pa.schema(
                        [("file", pa.string()), ("place", pa.int64()), ("id", pa.int64()), ("url", pa.string()),
                         ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
                    ),
                )

    return _one_a_task(files.select("file"), files).mapInArrow(index, INDEX)


def _one_a_task(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows dealt by file, about one file a task: a file is the unit of reading, however small its rows are."""
    return rows.repartition(max(1, min(files.count(), MOST_TASKS)), "file")


def decide(index: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Adds refers_file, refers_place, refers_url, refers_date: the record that has the payload, null if it is this one.

    Of equal payloads of at least ``least_bytes`` the record with the largest id has it; ties go to the later place.
    """
    place = F.struct("id", "file", "place", "url", "date")
    best = (
        index.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.max(place).alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", "best")
    )
    # Only payloads that occur more than once stand in ``best``.
    both = index.join(best, "payload_digest", "left")
    other = (F.col("best.file") != F.col("file")) | (F.col("best.place") != F.col("place"))
    return both.select(
        *index.columns, *(F.when(other, F.col(f"best.{c}")).alias(f"refers_{c}") for c in ("file", "place", "url", "date"))
    )


def warc_head(name: str) -> bytes:
    block = b"software: mediasift\r\nformat: WARC File Format 1.1\r\n"
    head = {
        "WARC-Type": "warcinfo", "WARC-Record-ID": record_uri(name, -1), "WARC-Date": iso_date(NO_DATE), "WARC-Filename": name,
        "Content-Type": "application/warc-fields",
    }
    return warc_record(head, block)


def warc_record(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def to_warc(file: str, place: int, values: dict[str, str], block: bytes, refers: dict | None) -> bytes:
    """The WARC record of an ARC record. ``refers``: the record that keeps the payload, if another does."""
    head, payload = split_http(block)
    names = {
        "WARC-Type": "revisit" if refers else "response" if head else "resource",
        "WARC-Record-ID": record_uri(file, place),
        "WARC-Date": iso_date(values["Archive-date"]),
        "WARC-Target-URI": values["URL"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Payload-Length": str(len(payload)),
        "Content-Type": HTTP_TYPE if head else values["Content-type"],
    }
    if values["IP-address"] not in ("-", "0.0.0.0"):
        names["WARC-IP-Address"] = values["IP-address"]
    if refers:
        block = head
        names |= {
            "WARC-Profile": REVISIT, "WARC-Truncated": "length",
            "WARC-Refers-To": record_uri(refers["refers_file"], refers["refers_place"]),
            "WARC-Refers-To-Target-URI": refers["refers_url"], "WARC-Refers-To-Date": iso_date(refers["refers_date"]),
        }
    return warc_record(names | {"WARC-Block-Digest": f"sha1:{digest(block)}"}, block)


def convert(files: DataFrame, arc_folder: str, warc_folder: str, least_bytes: int = 0) -> DataFrame:
    """WARC files of all records of the ARC files; returns (file, records).

    A group is the index of one ARC file, which a task reads along with the file itself.
    """
    decisions = decide(written(arc_index(files, arc_folder), "arc-index"), least_bytes)

    def rewrite(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        file = rows[0]["file"]
        fs, base = open_folder(arc_folder)
        writer = Writer(warc_folder, ".warc.gz", warc_head)
        with fs.open_input_stream(f"{base}/{file}", compression=None) as raw:
            for row, (values, block) in zip(rows, arc_records(Stream(raw)), strict=True):
                writer.add(to_warc(file, row["place"], values, block, row if row["refers_file"] is not None else None))
        return pa.Table.from_batches([writer.files()])

    narrow = decisions.select("file", "place", *(f"refers_{c}" for c in ("file", "place", "url", "date")))
    # A number of tasks that adaptive execution keeps: by the size of the index alone all files would meet in one.
    return written(_one_a_task(narrow, files).groupBy("file").applyInArrow(rewrite, FILES), "warc-files")


def warc_records(stream: Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:100]!r}")
        head = {}
        while line := stream.line():
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode("utf-8", "replace")
        block = stream.read(length := int(head["content-length"]))
        if len(block) < length:
            raise ValueError("the file ends inside a record")
        yield head, block


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """A row for each response and revisit; digest and length of a response are those of what it holds."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_folder(folder)
        schema = pa.schema(
            [("record_id", pa.string()), ("record_type", pa.string()), ("id", pa.int64()), ("url", pa.string()), ("date", pa.string()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string())]
        )
        for batch in batches:
            for file in batch["file"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{file}", compression=None) as raw:
                    for head, block in warc_records(Stream(raw)):
                        kind = head["warc-type"]
                        if kind not in ("response", "resource", "revisit"):
                            continue
                        http, payload = split_http(block)
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        size = int(head.get("payload-length", len(payload)))
                        if kind != "revisit" and (declared, size) != (digest(payload), len(payload)):
                            raise ValueError(f"payload and digest differ in {file}: {head['warc-record-id']}")
                        rows.append(
                            {
                                "record_id": head["warc-record-id"], "record_type": kind, "id": _own_id(http),
                                "url": head.get("warc-target-uri"), "date": head["warc-date"], "payload_bytes": size,
                                "payload_digest": declared, "refers_to_id": head.get("warc-refers-to"),
                            }
                        )
                yield pa.RecordBatch.from_pylist(rows, schema)

    return _one_a_task(files.select("file"), files).mapInArrow(read, RECORDS)


def page_records(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages through ARC files, the converter and WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null page_id stays null. Repeated rows are records of their own. Further
    columns are ignored. An empty table gives no records.
    """
    arcs, warcs = work_dir(spark, "arc"), work_dir(spark, "warc")
    records = written(read_warc(convert(write_arc(pages, arcs), arcs, warcs), warcs), "warc-records")
    kept = records.filter("refers_to_id is null").select(F.col("record_id").alias("refers_to_id"), F.col("id").alias("refers_to"))
    out = ("id", "payload_bytes", "payload_digest", "record_type")
    revisits = records.filter("refers_to_id is not null").join(kept, "refers_to_id", "left").select(*out, "refers_to")
    responses = records.filter("refers_to_id is null").select(*out, F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits).withColumnRenamed("id", "page_id")
