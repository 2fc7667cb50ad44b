"""WARC archives as a PySpark data source, and pages stored without repeated payloads.

Reading: the driver plans byte ranges of the files; a task finds the first record that begins in its range, inflates
only as much of a record as its headers need, tests the pushed predicates (record type, record id, target URI, payload
digest) on them and skips the rest of an unwanted record by the skip-length field of its gzip member, or by its content
length in a plain archive. ``payload=false`` skips the payloads of wanted records as well.

Writing: one gzip member per record with the skip-length field; every task attempt writes files of its own into
``_temporary``, and the commit moves those of the successful attempts to their places.

Defined results: a null payload is empty; a null id gives a record without a number, read back as null; a null URL gives
no target URI; line breaks in a URL are percent-encoded; rows that repeat the id of a response are responses too;
an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from chatterlens.llm.base import BATCH_BYTES, shared_folder, small_batches, written

READ = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, http_length long, payload binary"
HEADER = {
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
FIRST_READ = 1 << 12


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def member(data: bytes) -> bytes:
    """One gzip member with the skip-length extra field: its compressed and its plain size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return MAGIC + b"\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    if row["record_type"] == "revisit":
        payload = b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {row['http_length']}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {date}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + row["target_uri"].replace("\r", "%0D").replace("\n", "%0A"))
    if row["payload_digest"] is not None:
        lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode())
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + http + payload + b"\r\n\r\n"


def parse_headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    pairs = (line.split(":", 1) for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, value in pairs}


def hex_digest(value: str | None) -> str | None:
    if value is None or not value.lower().startswith("sha1:"):
        return value
    digits = value[5:]
    return base64.b32decode(digits).hex() if len(digits) == 32 else digits.lower()


def field(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADER[column])
    if column == "payload_digest":
        return hex_digest(value)
    return value.strip("<>") if value is not None and column in ("record_id", "refers_to") else value


class Inflated:
    """The plain bytes of the gzip member at ``at``, inflated as far as asked for."""

    def __init__(self, file, at: int):
        self.file, self.at = file, at
        self.plain, self.unpack = bytearray(), zlib.decompressobj(31)
        head = self._read(FIRST_READ)
        self.size = None
        if len(head) > 12 and head[3] & 4:
            extra = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]]
            while len(extra) >= 4:
                kind, length = extra[:2], struct.unpack_from("<H", extra, 2)[0]
                if kind == b"sl" and length == 8:
                    self.size = struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + length :]
        self.plain += self.unpack.decompress(head)

    def _read(self, n: int) -> bytes:
        self.file.seek(self.at)
        data = self.file.read(n)
        self.at += len(data)
        return data

    def more(self) -> bool:
        if self.unpack.eof:
            return False
        data = self._read(STEP)
        if not data:
            raise ValueError("a gzip member breaks off")
        self.plain += self.unpack.decompress(data)
        return True

    def headers(self) -> tuple[dict[str, str], int]:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self.more():
                raise ValueError("a record has no end of headers")
        return parse_headers(bytes(self.plain[:end])), end + 4

    def upto(self, n: int) -> bytes:
        while len(self.plain) < n and self.more():
            pass
        return bytes(self.plain[:n])

    def next(self, start: int) -> int:
        """Where the member behind this one begins."""
        if self.size:
            return start + self.size
        while self.more():
            self.plain.clear()
        return self.at - len(self.unpack.unused_data)


class Plain:
    """A record of an archive that isn't compressed."""

    def __init__(self, file, at: int):
        self.file, self.start, self.plain = file, at, b""
        self.total = None

    def headers(self) -> tuple[dict[str, str], int]:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            self.file.seek(self.start + len(self.plain))
            data = self.file.read(FIRST_READ)
            if not data:
                raise ValueError("a record has no end of headers")
            self.plain += data
        found = parse_headers(self.plain[:end])
        self.total = end + 4 + int(found["content-length"]) + 4
        return found, end + 4

    def upto(self, n: int) -> bytes:
        self.file.seek(self.start)
        return self.file.read(n)

    def next(self, start: int) -> int:
        return start + self.total


def begins(file, start: int, end: int, packed: bool) -> int | None:
    """The first place from ``start`` on, before ``end``, where a record begins."""
    if start == 0:
        return 0
    mark, at, carry = (MAGIC if packed else b"WARC/1."), start, b""
    while at < end:
        file.seek(at)
        data = carry + file.read(min(STEP, end - at) + len(mark) - 1)
        for hit in re.finditer(re.escape(mark), data):
            place = at - len(carry) + hit.start()
            if place >= end:
                break
            try:
                (Inflated if packed else Plain)(file, place).headers()
                return place
            except (ValueError, KeyError, zlib.error, struct.error):
                continue
        at, carry = at + STEP, b""
    return None


def records(file, start: int, end: int, packed: bool, wanted, with_payload: bool) -> Iterator[tuple]:
    """The rows of the records that begin in the range and satisfy ``wanted(headers)``."""
    at, size = begins(file, start, end, packed), file.size()
    while at is not None and at < min(end, size):
        here = (Inflated if packed else Plain)(file, at)
        headers, body = here.headers()
        if wanted(headers):
            length, payload, http_length = int(headers["content-length"]), None, None
            if headers.get("content-type", "").startswith("application/http"):
                # The HTTP headers are short; the payload behind them is inflated only when asked for.
                n = min(length, FIRST_READ)
                while (split := here.upto(body + n)[body:].find(b"\r\n\r\n")) < 0 and n < length:
                    n = min(length, 2 * n)
                http = here.upto(body + n)[body : body + max(split, 0)].decode("latin-1").lower()
                found = re.search(r"^content-length:\s*(\d+)", http, re.M)
                http_length = int(found[1]) if found else None
                skip = split + 4 if split >= 0 else 0
            else:
                skip = 0
            if with_payload:
                payload = here.upto(body + length)[body + skip : body + length]
            yield (*(field(headers, c) for c in HEADER), http_length, payload)
        at = here.next(at)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.split = options["path"], int(options.get("split_bytes", 64 << 20))
        self.with_payload = options.get("payload", "true").lower() != "false"
        self.tests: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADER:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tests[name] = self.tests.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, folder = open_folder(self.uri)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        files = [i for i in found if i.is_file and i.base_name.endswith((".warc", ".warc.gz")) and "/_" not in i.path[len(folder):]]
        # A payload in a plain archive may hold whole records, so only the members of packed ones tell where to cut.
        step = {i.path: self.split if i.base_name.endswith(".gz") else max(1, i.size) for i in files}
        ranges = [Range(i.path, s, min(s + step[i.path], i.size)) for i in files for s in range(0, i.size, step[i.path])]
        return ranges or [Range("", 0, 0)]

    def wanted(self, headers: dict[str, str]) -> bool:
        return all(field(headers, name) in values for name, values in self.tests.items())

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = open_folder(self.uri)
        kinds = [*[pa.string()] * 5, pa.int64(), pa.binary()]
        names = [f.split()[0] for f in READ.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        with system.open_input_file(partition.path) as file:
            rows, size = [], 0
            for row in records(file, partition.start, partition.end, partition.path.endswith(".gz"), self.wanted, self.with_payload):
                rows.append(row)
                size += 300 + len(row[-1] or b"")
                if size > BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.roll = options["path"], int(options.get("file_bytes", 256 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = open_folder(self.uri)
        names, file, size = [], None, 0
        system.create_dir(posixpath.join(folder, "_temporary"), recursive=True)
        for batch in iterator:
            for i in range(batch.num_rows):
                if file is None:
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    file, size = system.open_output_stream(posixpath.join(folder, "_temporary", names[-1]), compression=None), 0
                data = member(record({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}, self.date))
                file.write(data)
                size += len(data)
                if size > self.roll:
                    file.close()
                    file = None
        if file is not None:
            file.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, folder = open_folder(self.uri)
        for message in messages:
            for name in message.names if message else ():
                system.move(posixpath.join(folder, "_temporary", name), posixpath.join(folder, name))

    def abort(self, messages: list) -> None:
        system, folder = open_folder(self.uri)
        for message in messages:
            for name in message.names if message else ():
                system.delete_file(posixpath.join(folder, "_temporary", name))


class WarcDataSource(DataSource):
    """Options: path; when reading payload (true or false) and split_bytes; when writing date and file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def page_records(pages: DataFrame, least_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per page: of equal payloads of at least ``least_bytes`` that with the largest id is the response.

    Only payload digests are grouped, and the groups of several pages written, so that the join on them can be split
    where one payload fills a third of the table.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("http_length", F.octet_length("payload").cast("long"))
    best = (
        rows.filter(F.col("http_length") >= least_bytes).groupBy(F.col("payload_digest").alias("same"), F.col("http_length").alias("same_length"))
        .agg(F.max("page").alias("best"), F.count("*").alias("n")).filter("n > 1")
    )
    best = written(best, "repeated-payloads")
    joined = rows.join(best, (F.col("payload_digest") == F.col("same")) & (F.col("http_length") == F.col("same_length")), "left")
    again = F.col("best").isNotNull() & ~F.col("page").eqNullSafe(F.col("best"))
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), urn(F.col("page")).alias("record_id"),
        "target_uri", "payload_digest", F.when(again, urn(F.col("best"))).alias("refers_to"), "http_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def store_pages(pages: DataFrame, path: str, **columns) -> None:
    """Write the records of the pages as WARC files below ``path``."""
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").option("path", path).save()


def stored_pages(spark: SparkSession, path: str) -> DataFrame:
    """What the archives hold per page: sizes and digests of responses from their payloads, those of revisits from their headers."""
    number = lambda c: F.regexp_extract(c, "^urn:x-page:(-?[0-9]+)$", 1)
    responses = read_warc(spark, path).filter("record_type = 'response'").select(
        "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    revisits = read_warc(spark, path, payload=False).filter("record_type = 'revisit'").select(
        "record_id", F.col("http_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    both = responses.unionByName(revisits)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return both.select(as_long(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_long(F.col("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    path = path or shared_folder(spark, "warc")
    store_pages(pages, path)
    return stored_pages(spark, path)
