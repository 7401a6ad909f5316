"""WARC archives as a Python data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Records are gzip members that carry their own length in the skip-lengths field (`sl`) of the gzip header, as the WARC
standard's annex on compression proposes, so a reader steps from record to record without inflating payloads.
Archives without that field, and uncompressed ones, are read too.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage

from . import common

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_bytes long, refers_to string, payload binary"
ROW = "record_id string, record_type string, target_uri string, date string, refers_to string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How names of manifests begin, and names of archives that are written here.
MANIFEST, OWN = "_manifest", re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
#: Bytes after which a new split begins, bytes read at first from a record, and payload bytes of an Arrow batch.
SPLIT_BYTES, PEEK, BATCH_BYTES = 64 << 20, 4096, 4 << 20
_GZIP = struct.Struct("<4sIBBHccHII")  # magic and flags, time, two bytes, length of the field, s, l, its size, member and record lengths


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(row: dict) -> bytes:
    """A record's bytes, uncompressed. A revisit has its HTTP header but no payload."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id'] or ''}>", f"WARC-Date: {row['date'] or '1970-01-01T00:00:00Z'}"]
    if row["target_uri"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["target_uri"], safe="%/:?#[]@!$&'()*+,;=~-._"))
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    if revisit:
        lines += [f"WARC-Refers-To: <{row['refers_to'] or ''}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    """A gzip member that states its own length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    head = _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"s", b"l", 8, _GZIP.size + len(body) + 8, len(raw))
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class _Body:
    """The uncompressed bytes of one record, inflated or read only as far as asked."""

    def __init__(self, f, at: int, peek: bytes):
        self.f, self.at, self.got = f, at, b""
        self.gzip = peek[:2] == b"\x1f\x8b"
        self.end: int | None = None
        if self.gzip:
            flags, skip = peek[3], 10
            if flags & 4:
                extra = peek[12 : 12 + struct.unpack_from("<H", peek, 10)[0]]
                skip += 2 + len(extra)
                while len(extra) >= 4:
                    n = struct.unpack_from("<H", extra, 2)[0]
                    if extra[:2] == b"sl" and n == 8:
                        self.end = at + struct.unpack_from("<I", extra, 4)[0]
                    extra = extra[4 + n :]
            for bit in (8, 16):
                if flags & bit:
                    skip = peek.index(b"\0", skip) + 1
            skip += 2 * bool(flags & 2)
            self.z, self.rest = zlib.decompressobj(-15), peek[skip:]
            self.read_to = at + len(peek)
        else:
            self.got, self.read_to = peek, at + len(peek)

    def more(self, want: int) -> bool:
        """Get bytes until `want` of them are there; whether any came."""
        had = len(self.got)
        parts = [self.got]
        while had < want:
            if self.gzip:
                if self.z.eof:
                    break
                if not self.rest:
                    self.f.seek(self.read_to)
                    self.rest = self.f.read(max(PEEK, min(1 << 20, want - had)))
                    self.read_to += len(self.rest)
                    if not self.rest:
                        raise ValueError("archive ends inside a record")
                new = self.z.decompress(self.rest, want - had)
                self.rest = self.z.unconsumed_tail or (self.z.unused_data if self.z.eof else b"")
            else:
                self.f.seek(self.read_to)
                new = self.f.read(want - had)
                self.read_to += len(new)
                if not new:
                    break
            parts.append(new)
            had += len(new)
        grown = had > len(self.got)
        self.got = b"".join(parts)
        return grown

    def head(self, start: int) -> int:
        """Where the header that begins at start ends, its blank line included."""
        while (at := self.got.find(b"\r\n\r\n", start)) < 0:
            if not self.more(len(self.got) + PEEK):
                raise ValueError("record without an end of its header")
        return at + 4

    def next_record(self, length: int) -> int:
        """Where the next record begins; without a stated length a compressed record is inflated to its end."""
        if not self.gzip:
            return self.at + length
        if self.end is None:
            while not self.z.eof and self.more(len(self.got) + (1 << 20)):
                self.got = b""
            self.end = self.read_to - len(self.rest) + 8
        return self.end


def _fields(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _bare(value: str | None) -> str | None:
    return value.strip("<>") or None if value is not None else None


class WarcReader(DataSourceReader):
    """Plans splits of files; headers are parsed first, and payloads decoded only of wanted records, and only if asked for."""

    def __init__(self, schema, options):
        self.names = [f.name for f in schema.fields]
        self.schema, self.folder, self.tests = schema, options["path"].rstrip("/"), []

    def pushFilters(self, filters: list[Filter]):
        plain = {"record_id", "record_type", "target_uri", "date", "payload_digest", "payload_bytes", "refers_to"}
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "some", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le", StringStartsWith: "starts"}
        for f in filters:
            if type(f) in kinds and len(f.attribute) == 1 and f.attribute[0] in plain:
                self.tests.append((f.attribute[0], kinds[type(f)], getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        manifests, files = _manifests(self.folder), []
        for name in manifests:
            with common.uri_open(f"{self.folder}/{name}", "rb") as f:
                files += json.load(f)
        # where there are manifests, files of this writer's that none of them names are left from failed attempts
        files += [{"file": name, "splits": [0, size]} for name, size in _listed(self.folder, (".warc", ".warc.gz")) if not manifests or not OWN.fullmatch(name)]
        return [InputPartition((f"{self.folder}/{x['file']}", a, b)) for x in files for a, b in zip(x["splits"][:-1], x["splits"][1:])] or [InputPartition(None)]

    def wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            x = row[name]
            if x is None:
                return False
            if not {"eq": lambda: x == value, "in": lambda: x in value, "some": lambda: True, "gt": lambda: x > value, "ge": lambda: x >= value, "lt": lambda: x < value, "le": lambda: x <= value, "starts": lambda: x.startswith(value)}[kind]():
                return False
        return True

    def records(self, f, start: int, stop: int) -> Iterator[dict]:
        at, with_payload = start, "payload" in self.names
        while at < stop:
            f.seek(at)
            body = _Body(f, at, f.read(PEEK))
            if not body.gzip and not body.got.strip(b"\r\n"):
                break
            if body.gzip:
                body.more(PEEK)
            head_end = body.head(0)
            head = _fields(body.got[:head_end])
            length = head_end + int(head.get("content-length", 0)) + 4
            row = {"record_id": _bare(head.get("warc-record-id")), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to": _bare(head.get("warc-refers-to"))}
            row["payload_digest"] = (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None
            begin = head_end
            row["payload_bytes"] = int(head.get("content-length", 0))
            if head.get("content-type", "").startswith("application/http"):
                begin = body.head(head_end)
                row["payload_bytes"] = int(_fields(body.got[head_end:begin]).get("content-length", length - 4 - begin))
            if self.wanted(row):
                row["payload"] = None
                if with_payload and row["record_type"] != "revisit":
                    body.more(length - 4)
                    row["payload"] = body.got[begin : length - 4]
                    if row["payload_digest"] and payload_digest(row["payload"]) != row["payload_digest"]:
                        raise ValueError(f"payload of {row['record_id']} is not what its digest says")
                yield row
            at = body.next_record(length)

    def read(self, partition):
        if partition.value is None:
            return
        path, start, stop = partition.value
        kind = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "binary": pa.binary()}.get(f.dataType.simpleString(), pa.string())) for f in self.schema.fields])
        rows, held = [], 0
        with common.uri_open(path, "rb") as f:
            for row in self.records(f, start, stop):
                rows.append({n: row[n] for n in self.names})
                held += 200 + len(row["payload"] or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)


def _listed(folder: str, ends: tuple[str, ...]) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder if "://" in folder else "file:///" + folder.removeprefix("file:").lstrip("/"))
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name.endswith(ends))


def _manifests(folder: str) -> list[str]:
    return [name for name, _ in _listed(folder, (".json",)) if name.startswith(MANIFEST)]


class WarcWritten(WriterCommitMessage):
    def __init__(self, file: str | None, splits: list[int]):
        self.file, self.splits = file, splits


class WarcWriter(DataSourceArrowWriter):
    """A file for each task; the write's own manifest, written last, names those of the attempts that count.

    Appending leaves earlier manifests alone; overwriting removes them once the new one is there, and then their files.
    """

    def __init__(self, options, overwrite: bool = False):
        self.folder, self.level, self.overwrite = options["path"].rstrip("/"), int(options.get("level", 4)), overwrite

    def write(self, iterator):
        name, out, splits, at = f"part-{uuid.uuid4().hex}.warc.gz", None, [0], 0
        for batch in iterator:
            for i in range(batch.num_rows):
                out = out or common.uri_open(f"{self.folder}/{name}", "wb")
                raw = member(record({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}), self.level)
                out.write(raw)
                at += len(raw)
                if at - splits[-1] >= SPLIT_BYTES:
                    splits.append(at)
        if out:
            out.close()
        return WarcWritten(name if out else None, splits if splits[-1] == at else [*splits, at])

    def commit(self, messages):
        files = [{"file": m.file, "splits": m.splits} for m in messages if m is not None and m.file]
        before = _manifests(self.folder) if self.overwrite else []
        with common.uri_open(f"{self.folder}/{MANIFEST}-{uuid.uuid4().hex}.json", "wb") as f:
            f.write(json.dumps(files).encode())
        for name in before:
            with common.uri_open(f"{self.folder}/{name}", "rb") as f:
                gone = [x["file"] for x in json.load(f)]
            for old in (name, *gone):
                common.uri_delete(f"{self.folder}/{old}")

    def abort(self, messages):
        """Files of a failed write are named in no manifest."""


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """The record (columns of ROW) of each page, in order of id within each task.

    Of pages with equal payloads (equal SHA-256) of at least least_bytes, that with the smallest id is the response and
    the others revisit it; smaller payloads are all responses. Null html counts as empty; null ids come last and are
    written as empty record ids; of repeated rows, equal in id and payload, one is written first and the others revisit
    it. Ids are integers. Payloads are shuffled once, by id; digests alone find the copies.
    """
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    last = 2**63 - 1
    of = lambda df: df.select(F.coalesce(F.col(id_col), F.lit(last)).cast("long").alias("id"), F.unhex(F.sha2(html, 256)).alias("sha"), F.length(html).alias("n"))
    keys = common.stored(of(pages), "payloads")
    groups = keys.where(F.col("n") >= least_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = common.stored(groups, "copies")
    revisits = common.join_hot(keys.select("id", "sha"), groups, "sha", "copies", keys.count()).select("id", "sha", "first").distinct()
    rows = pages.select(F.coalesce(F.col(id_col), F.lit(last)).cast("long").alias("id"), F.unhex(F.sha2(html, 256)).alias("sha"), F.col(uri_col).alias("target_uri"), html.alias("payload"))
    joined = rows.join(revisits, ["id", "sha"], "left").sortWithinPartitions("id", "sha")
    return joined.select("id", "first", "target_uri", "payload").mapInArrow(common.releasing(_records(last)), ROW)


def _records(last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = lambda i: "urn:page:" + ("" if i == last else str(i))
        before = None
        for b in batches:
            types, refers = [], []
            digests = [hashlib.sha256(x.as_py()).digest() for x in b.column(3)] if b.num_rows else []
            for i, first, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), digests):
                again = first is not None and (i != first or before == (i, d))
                types.append("revisit" if again else "response")
                refers.append(name(first) if again else None)
                before = i, d
            ids = pa.array([name(i) for i in b.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([ids, pa.array(types), b.column(2), pa.nulls(b.num_rows, pa.string()), pa.array(refers, pa.string()), b.column(3)], ["record_id", "record_type", "target_uri", "date", "refers_to", "payload"])

    return run


def write(pages: DataFrame, folder: str, least_bytes: int = 0, overwrite: bool = False) -> None:
    """Writes the records of plan_records() as gzip archives, one or none for each task, beside those that are in the folder, or in their place.

    Copies are found among these pages, not among what the folder holds. A reader sees a write whole once its manifest is
    there, and nothing of a failed one. An empty table adds no archive.
    """
    register(spark := pages.sparkSession)
    common.make_folder(spark, folder)
    plan_records(pages, least_bytes).write.format("warc").mode("overwrite" if overwrite else "append").save(folder)


def read(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives; without `payload` among the columns no payload is inflated."""
    register(spark)
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("warc").schema(", ".join(fields)).load(folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    names = ["record_id", "record_type", "payload_digest", "payload_bytes", "refers_to"]
    whole = read(spark, folder).where("record_type = 'response'").withColumn("payload_bytes", F.length("payload").cast("long")).select(*names)
    heads = read(spark, folder, names).where("record_type = 'revisit'").select(*names)
    number = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    return whole.unionByName(heads).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


_FIVE = ", ".join(f"upper(to_base(CAST('0x' || substr(h, {1 + 10 * k}, 10) AS BIGINT), 32, 8))" for k in range(4))
OP5_SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT page_id, strlen(p) AS payload_bytes, translate(concat({_FIVE}), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest, min(page_id) OVER (PARTITION BY p) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM g
"""
QUERIES = {"op5_warc": op5_warc}
ORACLES = {"op5_warc": OP5_SQL}
