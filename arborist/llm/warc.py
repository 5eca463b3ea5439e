"""WARC archives as a Spark data source, ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Reading plans partitions of whole files up to a size. In a partition each record's headers are
parsed first; filters on the record's type and headers, pushed down by Spark, are applied to them,
and the body of a record that fails them, or whose payload isn't in the schema asked for, is
skipped by its length without being read or decoded. Writing goes to a temporary name in each
task; the files of the tasks that Spark accepts are renamed at the commit, so a lost or repeated
task leaves nothing behind. Paths are opened through Arrow's file systems.

A response record holds an HTTP header and the payload; a revisit record holds the HTTP header
alone, whose Content-Length still tells the payload's size, and names the record it repeats.

Defined cases: a null payload is empty; null ids and addresses are left out of the headers and
read back as null; line breaks in addresses are percent-encoded; repeated rows are records like
any other; a very long payload is one record, held by the task that reads or writes it; a file is
one partition however large, as a payload may hold the text of a header, and what is written here
is cut at FILE_BYTES; an empty table makes no archive file and reads back as no record; extra
columns of the table written are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import io
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import saved, shared_path, text_of

SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "refers_to string, content_type string, payload_bytes long, payload binary"
)
PARTITION_BYTES = 64 << 20
FILE_BYTES = 256 << 20
BATCH_BYTES = 16 << 20
#: A header name for each column, as the WARC format has them.
HEADERS = {
    "record_type": b"warc-type",
    "record_id": b"warc-record-id",
    "target_uri": b"warc-target-uri",
    "warc_date": b"warc-date",
    "payload_digest": b"warc-payload-digest",
    "refers_to": b"warc-refers-to",
    "content_type": b"content-type",
}
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _head(lines: Iterable[tuple[bytes, str | bytes | None]], first: bytes) -> bytes:
    out = [first]
    for name, value in lines:
        if value is not None:
            value = value.encode() if isinstance(value, str) else value
            out.append(name + b": " + value.replace(b"\r", b"%0D").replace(b"\n", b"%0A"))
    return b"\r\n".join(out) + b"\r\n\r\n"


def _record(row: Row) -> bytes:
    """One record: row has record_type, record_id, target_uri, warc_date, payload_digest (hex), refers_to, payload."""
    payload = bytes(row.payload or b"")
    block = _head([(b"Content-Type", b"text/html; charset=utf-8"), (b"Content-Length", b"%d" % len(payload))], b"HTTP/1.1 200 OK")
    if row.record_type != "revisit":
        block += payload
    digest = row.payload_digest and "sha1:" + base64.b32encode(bytes.fromhex(row.payload_digest)).decode()
    head = [
        (b"WARC-Type", row.record_type),
        (b"WARC-Record-ID", row.record_id),
        (b"WARC-Date", row.warc_date),
        (b"WARC-Target-URI", row.target_uri),
        (b"WARC-Payload-Digest", digest),
        (b"WARC-Refers-To", row.refers_to),
        (b"WARC-Profile", _PROFILE if row.record_type == "revisit" else None),
        (b"Content-Type", b"application/http; msgtype=response"),
        (b"Content-Length", b"%d" % len(block)),
    ]
    return _head(head, b"WARC/1.1") + block + b"\r\n\r\n"


def _headers(stream: io.BufferedIOBase) -> tuple[dict[bytes, bytes], int]:
    """Headers up to the empty line, by lower-case name, and the bytes read."""
    out, size = {}, 0
    while line := stream.readline():
        size += len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            break
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out, size


def _skip(stream: io.BufferedIOBase, n: int, seekable: bool) -> None:
    if seekable:
        stream.seek(n, io.SEEK_CUR)
    else:
        while n > 0 and (got := stream.read(min(n, 1 << 20))):
            n -= len(got)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, partition_bytes: int):
        self.path, self.columns, self.partition_bytes = path, schema.names, partition_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take the filters on type and headers; leave the rest to Spark."""
        kinds = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringContains: "contains"}
        for x in filters:
            attribute = getattr(x, "attribute", ())
            if type(x) in kinds and len(attribute) == 1 and attribute[0] in HEADERS:
                self.tests.append((attribute[0], kinds[type(x)], x.value))
            else:
                yield x

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        found = sorted((x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))
        out: list[list[str]] = []
        size = 0
        for path, n in found:
            if not out or size + n > self.partition_bytes:
                out.append([])
                size = 0
            out[-1].append(path)
            size += n
        return [Files(x) for x in out] or [Files([])]

    def _passes(self, values: dict[str, str | None]) -> bool:
        for column, kind, wanted in self.tests:
            value = values[column]
            if value is None or not (
                value == wanted if kind == "equal" else value in wanted if kind == "in" else value.startswith(wanted) if kind == "starts" else wanted in value
            ):
                return False
        return True

    def _records(self, stream: io.BufferedIOBase, seekable: bool) -> Iterator[dict]:
        body = {"payload", "payload_bytes"} & set(self.columns)
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue  # the empty lines between records
            head, _ = _headers(stream)
            length = int(head[b"content-length"])
            values = {c: (v.decode("utf-8", "replace") if (v := head.get(name)) is not None else None) for c, name in HEADERS.items()}
            if values["payload_digest"]:
                kind, _, digest = values["payload_digest"].partition(":")
                values["payload_digest"] = base64.b32decode(digest).hex() if kind == "sha1" and len(digest) == 32 else digest
            if not self._passes(values) or not body:
                _skip(stream, length, seekable)
                if self._passes(values):
                    yield values
                continue
            http, used = _headers(stream) if (values["content_type"] or "").startswith("application/http") else ({}, 0)
            values["payload_bytes"] = int(http.get(b"content-length", length - used))
            if "payload" in self.columns and values["record_type"] != "revisit":
                values["payload"] = stream.read(length - used)
            else:
                _skip(stream, length - used, seekable)
            yield values

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        store = fs.FileSystem.from_uri(self.path)[0]
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                zipped = path.endswith(".gz")
                stream = gzip.open(file) if zipped else io.BufferedReader(file, 1 << 20)
                for values in self._records(stream, not zipped):
                    rows.append(values)
                    size += 500 + len(values.get("payload") or b"")
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, zipped: bool):
        self.zipped = zipped
        self.path, self.temporary = path, f"_temporary-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """One or more files of bounded size under temporary names; gzip makes each record a member of its own."""
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/{self.temporary}")
        out, size, paths = None, 0, []
        try:
            for row in rows:
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    paths.append(f"{root}/{self.temporary}/{uuid.uuid4().hex}.warc{".gz" if self.zipped else ""}")
                    out, size = store.open_output_stream(paths[-1], compression=None), 0
                record = gzip.compress(_record(row)) if self.zipped else _record(row)
                out.write(record)
                size += len(record)
        finally:
            if out:
                out.close()
        return Written(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        for message in messages:
            for path in message.paths if message else []:
                store.move(path, f"{root}/{path.rsplit('/', 1)[1]}")
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        store.create_dir(f"{root}/{self.temporary}")
        store.delete_dir(f"{root}/{self.temporary}")  # what lost tasks have left goes too

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*fs.FileSystem.from_uri(self.path))


class WarcDataSource(DataSource):
    """Options: path; partition_bytes; compression (none or gzip). A schema given by the reader chooses the columns."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("archives are only added to")
        return WarcWriter(self.options["path"], self.options.get("compression", "none") == "gzip")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def archived(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """The records of pages (page_id, url, html): copies of a payload revisit that of the largest page_id.

    Copies are found by SHA-1 and size; only payloads of min_bytes or more count. Pages meet the
    groups of copies by digest in a plain join: payloads are shuffled once, and a payload with a
    third of all pages is split at run time.
    """
    payload = F.encode(text_of("html"), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.length("payload")})
    copies = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    copies = saved(copies.where("copies > 1").select("digest", "n", "first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(copies, ["digest", "n"], "left").select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        F.col("digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload",
    )


def op5(pages: DataFrame) -> DataFrame:
    """Archives written and read back: type, size, digest and reference of every page's record.

    Of responses, size and digest are those of the payload that was read; of revisits, those of
    the record's headers.
    """
    spark = pages.sparkSession
    register(spark)
    path = shared_path(spark, "warc")
    archived(pages).write.format("warc").mode("append").option("compression", "gzip").save(path)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    records = spark.read.format("warc").load(path)
    whole = F.col("record_type") == "response"
    return records.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(whole, F.length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN g ON d.payload_digest = g.payload_digest AND d.payload_bytes = g.payload_bytes
"""
