"""WARC files as a Python data source: format "veilspark-warc".

Reading plans file partitions on the driver, takes filters on record type and header columns, and parses a
record's headers before anything else: the payload of a record that no filter wants, or of any record under
payload=false, is passed over undecoded. Files are gzipped record by record; each gzip header holds the lengths
of its member ("sl" field), so a reader steps over a member it doesn't want. Members without it are inflated.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds

FORMAT = "veilspark-warc"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"

#: Columns read, and the header that each is taken from.
HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", http_length long, payload binary, file string, position long"
#: Columns written; digest is in base32, refers_to the record it revisits.
WRITTEN = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload binary"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """data as one gzip member whose extra field "sl" holds its compressed and plain lengths."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
    size = len(head) + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(r: dict) -> bytes:
    """One WARC record, not compressed. A revisit has the HTTP header of the payload it stands for, but no payload."""
    payload = r["payload"] or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = r["record_type"] == "revisit"
    block = http if revisit else http + payload
    uri = r["target_uri"]
    lines = {
        "WARC-Type": r["record_type"],
        "WARC-Record-ID": r["record_id"],
        "WARC-Date": r.get("date") or "1970-01-01T00:00:00Z",
        "WARC-Target-URI": None if uri is None else uri.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
        "WARC-Refers-To": r["refers_to"],
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


class Members:
    """The gzip members of a file in turn: (position, the first bytes plain, a function for the rest)."""

    CHUNK = 1 << 16

    def __init__(self, f):
        self.f, self.size, self.at = f, f.size(), 0

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while self.at < self.size:
            start = self.at
            self.f.seek(start)
            raw = self.f.read(self.CHUNK)
            z = zlib.decompressobj(31)
            first, left = z.decompress(raw, self.CHUNK), z.unconsumed_tail
            length = struct.unpack("<I", raw[16:20])[0] if raw[3] & 4 and raw[12:14] == b"sl" else 0
            done = False

            def rest(z=z, left=left, first=first) -> bytes:
                nonlocal done
                out, data = [first], left
                while not z.eof:
                    data = data or self.f.read(self.CHUNK)
                    if not data:
                        raise ValueError("a WARC file ends within a record")
                    out.append(z.decompress(data))
                    data = b""
                self.at = self.f.tell() - len(z.unused_data)
                done = True
                return b"".join(out)

            yield start, first, rest
            if length and not done:
                self.at = start + length
            elif not done:
                rest()


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """The headers of a record and where its block starts; -1 if data ends before."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    lines = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, end + 4


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    """Options: path; maxPartitionBytes, to which small files are gathered (a file is read by one task); payload
    (false: null); verify (true: a payload whose SHA-1 isn't the header's raises)."""

    def __init__(self, options: dict):
        options = ds.CaseInsensitiveDict(options)
        self.path = options["path"]
        self.most = int(options.get("maxPartitionBytes", 128 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "true").lower() == "true"
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, (ds.EqualTo, ds.In, ds.IsNotNull, ds.StringStartsWith)) and column and len(column) == 1 and column[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            v = row[f.attribute[0]]
            if v is None or isinstance(f, ds.EqualTo) and v != f.value or isinstance(f, ds.In) and v not in f.value or isinstance(f, ds.StringStartsWith) and not v.startswith(f.value):
                return False
        return True

    def partitions(self) -> list[Files]:
        where, root = filesystem(self.path)
        listed = root.rstrip("/") + "/" + MANIFEST
        if where.get_file_info(listed).type == fs.FileType.File:
            with where.open_input_stream(listed) as f:
                found = [(root.rstrip("/") + "/" + n, s) for n, s in json.loads(f.read())]
        else:
            info = where.get_file_info(root)
            infos = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(root, recursive=True))
            found = [(i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.endswith((".warc", ".warc.gz"))]
        out, size = [], self.most
        for path, n in sorted(found):
            if size + n > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = filesystem(self.path)
        columns = [*HEADERS, "http_length", "payload", "file", "position"]
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            with where.open_input_file(path) as f:
                for row in self.records(f, path):
                    rows.append(tuple(row[c] for c in columns))
                    size += len(row["payload"] or b"")
                    if len(rows) >= 2000 or size > 16 << 20:
                        yield self.batch(rows, columns)
                        rows, size = [], 0
        if rows:
            yield self.batch(rows, columns)

    @staticmethod
    def batch(rows: list[tuple], columns: list[str]) -> pa.RecordBatch:
        kinds = {"http_length": pa.int64(), "position": pa.int64(), "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(list(v), kinds.get(c, pa.string())) for c, v in zip(columns, zip(*rows))], names=columns)

    def records(self, f, path: str) -> Iterator[dict]:
        for position, first, rest in Members(f) if path.endswith(".gz") else plain(f):
            head, start = parse_head(first)
            if start < 0:
                first = rest()
                head, start = parse_head(first)
                rest = lambda first=first: first
            row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
            row |= {"payload_digest": row["payload_digest"] and row["payload_digest"].removeprefix("sha1:"), "file": path, "position": position, "http_length": None, "payload": None}
            if not self.wanted(row):
                continue
            length, block = int(head.get("content-length", 0)), first[start:]
            http = head.get("content-type", "").startswith("application/http")
            decoded = self.payload and row["record_type"] != "revisit"
            if decoded or http and b"\r\n\r\n" not in block and len(block) < length:
                block = rest()[start : start + length]
                if len(block) < length:
                    raise ValueError(f"{path}: the record at {position} is cut short")
            body = block
            if http:
                top, _, body = block.partition(b"\r\n\r\n")
                sizes = [x.split(b":", 1)[1] for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                row["http_length"] = int(sizes[0]) if sizes else None
            if decoded:
                row["payload"] = body
                if self.verify and row["payload_digest"] and digest(body) != row["payload_digest"]:
                    raise ValueError(f"{path}: the payload at {position} doesn't match its digest")
            yield row


def plain(f) -> Iterator[tuple[int, bytes, object]]:
    """The records of an uncompressed file; a record not wanted is stepped over by its length."""
    at, size = 0, f.size()
    while at < size:
        f.seek(at)
        first = f.read(1 << 16)
        while (end := first.find(b"\r\n\r\n")) < 0 and (more := f.read(1 << 16)):
            first += more
        head, start = parse_head(first)
        length = start + int(head.get("content-length", 0))

        def rest(at=at, length=length) -> bytes:
            f.seek(at)
            return f.read(length)

        yield at, first[:length], rest
        at += length + 4


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(ds.DataSourceArrowWriter):
    """Each task writes files of its own names, of at most about fileBytes; those of tasks that committed are listed in the
    manifest, which is written last. So a task that is lost or run twice leaves nothing that is read."""

    def __init__(self, options: dict, overwrite: bool):
        options = ds.CaseInsensitiveDict(options)
        self.path, self.most, self.overwrite = options["path"], int(options.get("fileBytes", 256 << 20)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, size, name = None, 0, ""
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = where.open_output_stream(f"{root}/{name}", compression=None), 0
                data = member(record(r))
                out.write(data)
                size += len(data)
                if size >= self.most:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, root = filesystem(self.path)
        where.create_dir(root, recursive=True)
        listed, files = f"{root}/{MANIFEST}", [tuple(x) for m in messages if m for x in m.files]
        if not self.overwrite and where.get_file_info(listed).type == fs.FileType.File:
            with where.open_input_stream(listed) as f:
                files += [tuple(x) for x in json.loads(f.read())]
        with where.open_output_stream(listed) as f:
            f.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        where, root = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                where.delete_file(f"{root}/{name}")


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def record_id(key, sha1):
    """<urn:x-page:KEY:SHA1>, from which the key can be read again; a null key is empty."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), sha1, F.lit(">"))


def with_revisits(pages: DataFrame, id_col: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """pages with sha1 (hex) and first: of payloads of least_bytes or more that are equal, the least id; null on that row itself.

    Equal rows of the least id are all without `first`. A null id is never the least unless all are, and then
    none is a revisit. Groups are found on ids and digests alone, with partial sums, so a hot payload costs no
    more than its rows' ids; pages are joined by id and digest.
    """
    pages = pages.withColumn("sha1", F.sha1(payload))
    narrow = pages.filter(F.length(payload) >= least_bytes).select(F.col(id_col).alias("k"), F.col("sha1").alias("s"))
    firsts = narrow.groupBy("s").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    later = narrow.join(firsts, "s").filter(~F.col("k").eqNullSafe(F.col("first"))).select("k", "s", "first").distinct()
    return pages.join(later, F.col(id_col).eqNullSafe(F.col("k")) & (F.col("sha1") == F.col("s")), "left").drop("k", "s")


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0, date_col: str | None = None) -> None:
    """Writes one record for each row: response, or revisit of the record that holds the same payload. Null text is an empty payload.

    date_col gives WARC-Date (a timestamp); without it, and where it is null, that is the start of 1970. Null ids and rows of one
    id have records of their own; an empty table writes no record. Other columns are not read.
    """
    spark = pages.sparkSession
    register(spark)
    date = F.date_format(F.to_utc_timestamp(F.col(f"`{date_col}`"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("payload"), date.alias("date"))
    rows = with_revisits(rows, "id", "payload", least_bytes)

    @F.pandas_udf("string")
    def base32(values):
        return values.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    rows.select(
        record_id(F.col("id"), F.col("sha1")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("url").alias("target_uri"),
        base32("sha1").alias("payload_digest"),
        F.when(F.col("first").isNotNull(), record_id(F.col("first"), F.col("sha1"))).alias("refers_to"),
        "payload",
        "date",
    ).write.format(FORMAT).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return spark.read.format(FORMAT).options(**{"maxPartitionBytes": most} | options).load(path)
