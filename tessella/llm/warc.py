"""WARC archives: a writer and a Python data source that reads them back.

The writer makes one gzip member for each record and notes its compressed
length in the gzip header (the ``sl`` extra field of the WARC annex). The
source plans one partition for each file, takes over predicates on the record
type and on other headers, decodes the headers of a record first, and steps
over the rest of a record that the predicates reject, by that length, without
inflating it.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tessella.llm.common import NULL_ID, text_id, written

SCHEMA = (
    "record_id string, warc_type string, target_uri string, content_length long, refers_to string, payload_digest string, "
    "payload_length long, headers map<string,string>, payload_sha1 string, payload binary"
)
#: Headers that have a column of their own, and predicates on these are taken over.
COLUMNS = {
    "record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A file ends after the record with which it reaches this size.
FILE_BYTES = 256 << 20
#: Payloads below this many bytes are never revisited.
MIN_REVISIT = 1000


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)


def member(record: bytes, level: int) -> bytes:
    """One gzip member whose header notes its own length and the record's."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def member_length(head: bytes) -> int:
    """The length noted in a gzip header, 0 if there is none."""
    if len(head) >= 24 and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl":
        return struct.unpack("<I", head[16:20])[0]
    return 0


def record(fields: dict[str, str], block: bytes) -> bytes:
    """A WARC record; line breaks in header values become spaces."""
    lines = [f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in fields.items()]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (record_id, warc_type, target_uri, refers_to, payload_digest, payload_length, payload) below a path.

    Tasks write files of their own below ``_attempts``; the commit moves those
    of the attempts that count, so that a lost executor leaves nothing behind
    that a reader sees.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.level, self.date = options["path"], int(options.get("level", "4")), options.get("date", "1970-01-01T00:00:00Z")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, path = store(self.path)
        fs.create_dir(posixpath.join(path, "_attempts"), recursive=True)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                cols = {n: batch.column(n) for n in batch.schema.names}
                for i in range(batch.num_rows):
                    row = {n: c[i].as_py() for n, c in cols.items()}
                    if out is None:
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(posixpath.join(path, "_attempts", files[-1]), compression=None), 0
                    data = member(self.build(row), self.level)
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return _Written(tuple(files))

    def build(self, row: dict) -> bytes:
        revisit = row["warc_type"] == "revisit"
        fields = {"WARC-Type": row["warc_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": self.date}
        if row.get("target_uri") is not None:
            fields["WARC-Target-URI"] = row["target_uri"]
        fields["WARC-Payload-Digest"] = row["payload_digest"]
        fields["X-Payload-Length"] = str(row["payload_length"])
        if revisit:
            fields |= {"WARC-Profile": REVISIT, "WARC-Refers-To": row["refers_to"]}
        fields["Content-Type"] = "application/http; msgtype=response"
        return record(fields, HTTP + (b"" if revisit else row["payload"] or b""))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = store(self.path)
        fs.create_dir(path, recursive=True)
        for m in messages:
            for name in m.files if m else ():
                fs.move(posixpath.join(path, "_attempts", name), posixpath.join(path, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = store(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.delete_file(posixpath.join(path, "_attempts", name))


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, set[str]] = {}
        if "warc_type" in options:
            self.wanted["warc-type"] = {x.strip() for x in options["warc_type"].split(",")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name in COLUMNS and isinstance(f.value, str):
                self.need(COLUMNS[name], {f.value})
            elif isinstance(f, In) and name in COLUMNS and all(isinstance(v, str) for v in f.value):
                self.need(COLUMNS[name], set(f.value))
            elif not (isinstance(f, IsNotNull) and name in ("record_id", "warc_type")):
                yield f

    def need(self, header: str, values: set[str]) -> None:
        self.wanted[header] = self.wanted[header] & values if header in self.wanted else values

    def partitions(self) -> list[InputPartition]:
        fs, path = store(self.path)
        found = fs.get_file_info(pafs.FileSelector(path, recursive=False, allow_not_found=True))
        return [_File(f.path) for f in found if f.is_file and f.size and re.search(r"\.warc(\.gz)?$", f.path)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition:
            return
        rows: list[dict] = []
        held = 0
        fs, _ = store(self.path)
        for fields, block in records(fs, partition.path, self.wanted):
            rows.append(self.row(fields, block))
            held += len(block)
            if len(rows) >= 4096 or held > 16 << 20:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def row(self, fields: dict[str, str], block: bytes) -> dict:
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        whole = fields.get("warc-type") != "revisit"
        return {
            **{column: fields.get(header) for column, header in COLUMNS.items()}, "content_length": len(block),
            "payload_length": len(payload) if whole else int(fields.get("x-payload-length", 0)), "headers": list(fields.items()),
            "payload_sha1": hashlib.sha1(payload).hexdigest() if whole else None, "payload": payload if self.payload and whole else None,
        }

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"content_length": pa.int64(), "payload_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the block starts; (…, -1) while the head is incomplete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    fields: dict[str, str] = {}
    for line in data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def records(fs: pafs.FileSystem, path: str, wanted: dict[str, set[str]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the records in a file whose headers have one of the wanted values each; other blocks are not decoded."""
    with fs.open_input_file(path) as raw:
        size, at = raw.size(), 0
        while at < size:
            raw.seek(at)
            data = raw.read(min(1 << 16, size - at))
            if data[:2] != b"\x1f\x8b":
                yield from _plain(raw, at, size, wanted)
                return
            unpack, length = zlib.decompressobj(31), member_length(data)
            out, read = unpack.decompress(data, 4096), len(data)
            fields, start = parse_head(out)
            while start < 0 and not unpack.eof:
                more = unpack.unconsumed_tail or raw.read(1 << 16)
                read += 0 if unpack.unconsumed_tail else len(more)
                if not more:
                    raise ValueError(f"{path}: a record ends inside its header")
                out += unpack.decompress(more, 1 << 16)
                fields, start = parse_head(out)
            keep = all(fields.get(h) in v for h, v in wanted.items())
            if not keep and length:
                at += length
                continue
            parts = [out]
            while not unpack.eof:
                more = unpack.unconsumed_tail or raw.read(1 << 20)
                read += 0 if unpack.unconsumed_tail else len(more)
                if not more:
                    raise ValueError(f"{path}: a record ends early")
                piece = unpack.decompress(more)
                if keep:
                    parts.append(piece)
            at += read - len(unpack.unused_data)
            if keep:
                yield fields, b"".join(parts)[start : start + int(fields.get("content-length", 0))]


def _plain(raw, at: int, size: int, wanted: dict[str, set[str]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive that is not compressed."""
    while at < size:
        raw.seek(at)
        head = b""
        while (found := parse_head(head))[1] < 0:
            more = raw.read(4096)
            if not more:
                return
            head += more
        fields, start = found
        length = int(fields.get("content-length", 0))
        if all(fields.get(h) in v for h, v in wanted.items()):
            raw.seek(at + start)
            yield fields, raw.read(length)
        at += start + length + 4


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``. Options: path; payload (false: headers, lengths and digests only); warc_type; level; date; file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def digest_header(sha1_hex):
    """The labelled digest that goes into the header."""
    return F.concat(F.lit("sha1:"), sha1_hex)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """The rows that ``WarcWriter`` takes, one for each page.

    Of pages with equal payloads (UTF-8 of the html, null as empty) of at
    least ``min_revisit`` bytes, the one with the largest id is the response
    and those with smaller ids revisit it; null ids are the smallest. Rows
    that share the largest id are all responses. Only payloads that occur more
    than once are looked up; that table is broadcast if Spark finds it below
    its limit, and else joined by a shuffle.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(text_id(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.select("id", "url", "payload", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"))
    again = base.where(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(F.max("id").alias("first"), F.count("*").alias("n"))
    again = written(again.where("n > 1").select("sha1", "size", "first"), "repeated")
    joined = base.join(again, ["sha1", "size"], "left")
    revisit = F.coalesce(F.col("id") < F.col("first"), F.lit(False))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.when(c == NULL_ID, "null").otherwise(c.cast("string")), F.lit(">"))
    return joined.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"), digest_header(F.col("sha1")).alias("payload_digest"), F.col("size").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archives(records_df: DataFrame, path: str, **options: str) -> None:
    register(records_df.sparkSession)
    records_df.write.format("warc").options(**options).mode("append").save(path)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("warc").options(**options).load(path)


def page_of(urn):
    """The page id in a record id."""
    return F.regexp_extract(urn, r"<urn:page:(-?\d+)>", 1).try_cast("long")
