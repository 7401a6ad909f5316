"""Index records of files of any size: written piece by piece in tasks, read as a data source by ranges of blocks.

A record is a file `name.fsbx`, or parts `name.fsbx.000000` and so on that follow one another. All blocks of a record take
as many bytes, so where a block begins is known from the record's head: a reader splits large records, and reads no more of
one than the blocks that are asked for. CRC-32s of pieces are combined along a tree: no task reads a whole record for it.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type

from .. import config as c
from ..functions import vectors
from ..operators.segment import metadata, segment
from ..storage import make_folder, open_uri
from . import codec

SCHEMA = "file_id string, block_id long, block_size long, total_len long, bytes_present array<int>, words array<long>, pairs array<int>"
#: Bytes of a piece and of the data it is made of, pieces whose checksums are combined at once, and bytes of a partition.
PIECE_BYTES, PIECE_DATA, COMBINED, SPLIT_BYTES = 4 << 20, 16 << 20, 1024, 64 << 20
ENDING, BATCH_BLOCKS = ".fsbx", 1024
#: Records in one part that a task verifies.
RECORDS_OF_TASK = 20_000
#: CRC-32's polynomial, bits reflected: fixed value.
POLYNOMIAL = 0xEDB88320


# --- checksums


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo CRC-32's; bit 31 is the constant."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def combined(first: int, second: int, size: int) -> int:
    """The CRC-32 of two stretches, from theirs and the second one's size."""
    power, shift = 1 << 23, 1 << 31  # x ** 8, and 1
    while size:
        if size & 1:
            shift = _times(shift, power)
        power, size = _times(power, power), size >> 1
    return _times(shift, first) ^ second


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows that come in order, by their first columns; nothing is held but a batch."""
    return itertools.groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[:keys])


def sorted_by(rows: DataFrame, *keys: str, then: str) -> DataFrame:
    """Equal keys in one task, in order of `then`."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, then)


def combined_checksums(pieces: DataFrame) -> DataFrame:
    """file_id, crc, size of pieces (file_id, piece, crc, size) in order, COMBINED at a time and then these."""
    kind = pieces.schema["file_id"].dataType.simpleString()

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (name, at), rows in in_groups(batches, 2):
            crc, size = 0, 0
            for _, _, _, c_, n in rows:
                crc, size = combined(crc, c_, n), size + n
            out.append((name, at, crc, size))
            if len(out) >= BATCH_BLOCKS:
                yield table(out)
                out = []
        if out:
            yield table(out)

    file_type = to_arrow_type(pieces.schema["file_id"].dataType)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (file_type, *[pa.int64()] * 3))], ["file_id", "piece", "crc", "size"])

    def level(rows: DataFrame) -> DataFrame:
        return sorted_by(rows, "file_id", "at", then="piece").select("file_id", "at", "piece", "crc", "size").mapInArrow(unite, f"file_id {kind}, piece long, crc long, size long")

    some = level(pieces.select("file_id", "piece", "crc", "size", F.floor(F.col("piece") / COMBINED).alias("at")))
    return level(some.withColumn("at", F.lit(0).cast("long"))).select("file_id", "crc", "size")


# --- writing


def stride(config: c.IndexConfig) -> int:
    """Bytes of a block in a record."""
    return 1024 + 16 + config.bits // 8 + (8200 if config.exact else 0)


def blocks_of_piece(config: c.IndexConfig) -> int:
    return max(1, min(PIECE_BYTES // stride(config), PIECE_DATA // config.block_size))


def pieces(files: DataFrame, config: c.IndexConfig, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, piece, data: each file's record, cut between blocks; together, in order, the bytes of codec.encode().

    The first piece begins with the head and the last one ends with the checksum. A file whose record is one piece is encoded
    where it is; of others blocks are shuffled by piece and encoded there, so no value and no task holds a large record. Null
    and empty files have a record without blocks. Ids name files.
    """
    config.validate()
    k = blocks_of_piece(config)
    rows = files.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data"))
    small = F.coalesce(F.length("data"), F.lit(0)) <= k * config.block_size
    whole = codec.encode_files(rows.where(small), config).select("file_id", F.lit(0).cast("long").alias("piece"), F.col("record").alias("data"), F.lit(True).alias("alone"))
    return whole.unionByName(_large_pieces(rows.where(~small), config, k))


def _large_pieces(files: DataFrame, config: c.IndexConfig, k: int, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """The same of files with more than k blocks."""
    kind = files.schema[id_col].dataType.simpleString()
    raw = segment(files, config.block_size, id_col, data_col).select("file_id", F.floor(F.col("block_id") / k).alias("piece"), "block_id", "own", F.when(F.length("ext") > F.length("own"), F.substring("ext", 1, 1)).alias("before"))

    file_type = to_arrow_type(raw.schema["file_id"].dataType)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for (name, piece), rows in in_groups(batches, 2):
            own = [r[3:] for r in rows]
            before = own[0][1]
            data = b"".join(codec.encoded_blocks(b"".join(x for x, _ in own), config.block_size, config.bits, config.exact, before[0] if before else None))
            out.append((name, piece, data, zlib.crc32(data), len(data)))
            held += len(data)
            if held >= PIECE_BYTES:
                yield table(out)
                out, held = [], 0
        if out:
            yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (file_type, pa.int64(), pa.binary(), pa.int64(), pa.int64()))], ["file_id", "piece", "data", "crc", "size"])

    body = sorted_by(raw, "file_id", "piece", then="block_id").mapInArrow(encoded, f"file_id {kind}, piece long, data binary, crc long, size long")
    meta = metadata(files, config.block_size, id_col, data_col)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [codec.MAGIC + struct.pack("<IQQQB", codec.VERSION, config.block_size, n, m, last[0] if last else 0xFF) for n, m, last in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.binary()), pa.array([zlib.crc32(h) for h in found], pa.int64())], ["file_id", "n_blocks", "head", "head_crc"])

    head = meta.select("file_id", "total_len", "n_blocks", "last_byte").mapInArrow(heads, f"file_id {kind}, n_blocks long, head binary, head_crc long")
    sums = combined_checksums(body.select("file_id", "piece", "crc", "size"))
    ends = head.join(sums.withColumnRenamed("crc", "body_crc").withColumnRenamed("size", "body_size"), "file_id", "left")

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = [combined(h, crc or 0, size or 0) for h, crc, size in zip(*(b.column(i).to_pylist() for i in (3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([struct.pack("<I", s) for s in sums], pa.binary())], ["file_id", "n_blocks", "head", "tail"])

    ends = ends.mapInArrow(closed, f"file_id {kind}, n_blocks long, head binary, tail binary")
    last = F.greatest(F.floor((F.col("n_blocks") - 1) / k), F.lit(0))
    whole = ends.join(body.select(F.col("file_id").alias("f"), "piece", "data"), F.col("file_id") == F.col("f"), "left").withColumn("piece", F.coalesce("piece", F.lit(0).cast("long")))
    nothing = F.lit(b"")
    return whole.select("file_id", "piece", F.concat(F.when(F.col("piece") == 0, F.col("head")).otherwise(nothing), F.coalesce("data", nothing), F.when(F.col("piece") == last, F.col("tail")).otherwise(nothing)).alias("data"), (last == 0).alias("alone"))


def write(files: DataFrame, folder: str, config: c.IndexConfig, id_col: str = "file_id", data_col: str = "data") -> int:
    """Writes the records below folder, a file for each piece; how many. A repeated attempt writes the same files again."""
    make_folder(files.sparkSession, folder)
    named = pieces(files, config, id_col, data_col).select(F.col("file_id").cast("string").alias("name"), "piece", "alone", "data")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for name, piece, alone, data in zip(*(col.to_pylist() for col in b.columns)):
                with open_uri(f"{folder}/{quote(name, safe='')}{ENDING}" + ("" if alone else f".{piece:06d}"), "wb") as f:
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return named.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


# --- reading


class _Parts:
    """A record's parts as one file of known size."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.parts, self.ends = parts, np.cumsum([n for _, n in parts])
        self.size = int(self.ends[-1])

    def read(self, at: int, n: int) -> bytes:
        out = []
        k = int(np.searchsorted(self.ends, at, "right"))
        while n > 0 and k < len(self.parts):
            path, size = self.parts[k]
            inside = at - (int(self.ends[k]) - size)
            with open_uri(path, "rb") as f:
                f.seek(inside)
                out.append(f.read(min(n, size - inside)))
            n, at, k = n - len(out[-1]), at + len(out[-1]), k + 1
        return b"".join(out)


class _Record:
    """Head and layout of a record, checked in the same order as codec.decode(), but for the checksum."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.file = _Parts(parts)
        head = self.file.read(0, codec.HEAD3 + codec.SMALLEST_BLOCK)
        self.version, self.block_size, self.total, self.n, self.start = codec.read_head(head, self.file.size)
        end = self.file.size - 4 * (self.version >= 2)
        if self.n > (end - self.start) // codec.SMALLEST_BLOCK:
            raise c.BlockCountOverflow(f"{self.n} blocks in {end - self.start} bytes")
        self.stride, self.bits, self.exact = 0, 0, False
        if self.n:
            flagged, words = struct.unpack_from("<QQ", head, self.start + 1024)
            self.exact, self.bits = bool(flagged & codec.FLAG), flagged & ~codec.FLAG
            self.stride = codec.SMALLEST_BLOCK + 8 * words + 8200 * self.exact
            codec.check_bloom(0, self.bits, words)
            if self.start + self.n * self.stride > end:
                raise c.TruncatedBlock(f"{self.n} blocks of {self.stride} bytes in {end - self.start} bytes")

    def blocks(self, first: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
        """Consecutive blocks as rows of bytes, BATCH_BLOCKS at most."""
        for at in range(first, min(stop, self.n), BATCH_BLOCKS):
            k = min(BATCH_BLOCKS, stop - at, self.n - at)
            raw = self.file.read(self.start + at * self.stride, k * self.stride)
            if len(raw) != k * self.stride:
                raise c.TruncatedBlock(f"block {at + len(raw) // self.stride}")
            rows = np.frombuffer(raw, np.uint8).reshape(k, self.stride)
            same = (rows[:, 1024:1040] == np.frombuffer(struct.pack("<QQ", self.bits | codec.FLAG * self.exact, (self.stride - 8200 * self.exact - codec.SMALLEST_BLOCK) // 8), np.uint8)).all(axis=1)
            if self.exact:
                same &= (rows[:, -8200:-8192] == np.frombuffer(struct.pack("<Q", codec.MARKER), np.uint8)).all(axis=1)
            if not same.all():
                raise c.TruncatedBlock(f"block {at + int(np.argmin(same))}")
            yield at, rows


class RecordReader(DataSourceReader):
    """Filters on file_id and block_id are taken: records that aren't asked for aren't opened, and of others only the blocks asked for are read."""

    def __init__(self, schema, options):
        self.schema, self.names = schema, [f.name for f in schema.fields]
        self.folder, self.split = options["path"].rstrip("/"), int(options.get("splitBytes", SPLIT_BYTES))
        self.files: set[str] | None = None
        self.low, self.high, self.some = 0, 1 << 62, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            kind, name = type(f), getattr(f, "attribute", ())
            if name == ("file_id",) and kind in (EqualTo, In):
                own = set(f.value) if kind is In else {f.value}
                self.files = own if self.files is None else self.files & own
            elif name == ("block_id",) and kind in (EqualTo, In):
                own = set(f.value) if kind is In else {f.value}
                self.some = own if self.some is None else self.some & own
            elif name == ("block_id",) and kind in (GreaterThan, GreaterThanOrEqual):
                self.low = max(self.low, f.value + (kind is GreaterThan))
            elif name == ("block_id",) and kind in (LessThan, LessThanOrEqual):
                self.high = min(self.high, f.value + (kind is LessThanOrEqual))
            elif not (kind is IsNotNull and name in (("file_id",), ("block_id",))):
                yield f

    def partitions(self):
        records: dict[str, list[tuple[str, int]]] = {}
        for name, size in listed(self.folder):
            file = unquote(name[: name.index(ENDING)])
            if self.files is None or file in self.files:
                records.setdefault(file, []).append((f"{self.folder}/{name}", size))
        out, held, size = [], [], 0
        for file, parts in records.items():
            if (whole := sum(n for _, n in parts)) > self.split:  # its head is read here; of others only the size is known
                record = _Record(parts)
                step = max(1, self.split // max(1, record.stride))
                out += [InputPartition([(file, parts, lo, lo + step)]) for lo in range(0, record.n, step) if self._ranges(lo, min(record.n, lo + step))]
                continue
            held.append((file, parts, 0, 1 << 62))
            size += whole + 4096
            if size >= self.split:
                out.append(InputPartition(held))
                held, size = [], 0
        return [*out, InputPartition(held)]

    def _ranges(self, first: int, stop: int) -> list[tuple[int, int]]:
        """What is wanted of some blocks."""
        first, stop = max(first, self.low), min(stop, self.high)
        if self.some is None:
            return [(first, stop)] if first < stop else []
        return [(k, k + 1) for k in sorted(self.some) if k is not None and first <= k < stop]

    def read(self, partition):
        for file, parts, first, stop in partition.value:
            record = _Record(parts)
            for lo, hi in self._ranges(first, min(stop, record.n)):
                for at, rows in record.blocks(lo, hi):
                    yield self._batch(record, file, at, rows)

    def _batch(self, record: _Record, file: str, at: int, rows: np.ndarray) -> pa.RecordBatch:
        n, words = len(rows), record.bits // 64 or 1
        make = {
            "file_id": lambda: pa.array([file] * n, pa.string()), "block_id": lambda: pa.array(np.arange(at, at + n)), "block_size": lambda: pa.array([record.block_size] * n, pa.int64()), "total_len": lambda: pa.array([record.total] * n, pa.int64()),
            "bytes_present": lambda: vectors.lists(*np.nonzero(np.ascontiguousarray(rows[:, :1024]).view("<u4")), n, pa.int32()),
            "words": lambda: vectors.word_lists(np.ascontiguousarray(rows[:, 1040 : 1040 + 8 * words]).view("<i8")),
            "pairs": lambda: vectors.lists(*np.nonzero(np.unpackbits(np.ascontiguousarray(rows[:, -8192:]), axis=1, bitorder="little")), n, pa.int32()) if record.exact else pa.nulls(n, pa.list_(pa.int32())),
        }
        return pa.RecordBatch.from_arrays([make[name]() for name in self.names], self.names)


def listed(folder: str) -> list[tuple[str, int]]:
    """Names and sizes of records and their parts, in order."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
    return sorted((x.base_name, x.size) for x in system.get_file_info(fs.FileSelector(inner)) if x.is_file and ENDING in x.base_name)


class RecordSource(DataSource):
    @classmethod
    def name(cls):
        return "blockrecords"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RecordReader(schema, self.options)


def read(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Blocks of all records below folder; columns: those of SCHEMA to decode (all). Checksums are verify()'s work."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordSource)
    fields = [f for f in SCHEMA.split(", ") if columns is None or f.split()[0] in columns]
    return spark.read.format("blockrecords").schema(", ".join(fields)).load(folder)


def verify(spark: SparkSession, folder: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """file_id, ok: whether each record's checksum is that of its bytes, read piece by piece in tasks. Records before version 2 have none: ok is null."""
    records: dict[str, list[tuple[str, int]]] = {}
    for name, size in listed(folder):
        records.setdefault(unquote(name[: name.index(ENDING)]), []).append((f"{folder}/{name}", size))
    single = [(file, *parts[0]) for file, parts in records.items() if len(parts) == 1]
    rows = [(file, k, *part) for file, parts in records.items() if len(parts) > 1 for k, part in enumerate(parts)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [_sum_of(path, size, True, True, piece_bytes) for path, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([crc == tail if version >= 2 else None for crc, tail, version in said], pa.bool_())], ["file_id", "ok"])

    names = pa.table(list(zip(*single)) or [[]] * 3, pa.schema([("file_id", pa.string()), ("path", pa.string()), ("size", pa.int64())]))
    alone = spark.createDataFrame(names).repartition(max(1, -(-len(single) // RECORDS_OF_TASK), min(len(single), spark.sparkContext.defaultParallelism))).mapInArrow(whole, "file_id string, ok boolean")
    return alone.unionByName(_verified(spark, rows, piece_bytes)) if rows else alone


def _sum_of(path: str, size: int, first: bool, last: bool, piece_bytes: int) -> tuple[int, int | None, int | None]:
    """CRC-32 of a part of a record but for its checksum, this checksum if the part is the last, the version if it is the first."""
    with open_uri(path, "rb") as f:
        version = struct.unpack("<4sI", f.read(8))[1] if first else None
        f.seek(0)
        left, crc = size - 4 * last, 0
        while left > 0 and (got := f.read(min(left, piece_bytes))):
            crc, left = zlib.crc32(got, crc), left - len(got)
        return crc, struct.unpack("<I", f.read(4))[0] if last else None, version


def _verified(spark: SparkSession, rows: list[tuple], piece_bytes: int) -> DataFrame:
    """The same of records in several parts (file_id, part, path, size): their sums are combined."""
    parts = spark.createDataFrame(rows, "file_id string, part long, path string, size long").repartition("path")
    last = parts.groupBy("file_id").agg(F.max("part").alias("last"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                crc, said, version = _sum_of(r["path"], r["size"], r["part"] == 0, r["part"] == r["last"], piece_bytes)
                size = r["size"] - 4 * (r["part"] == r["last"])
                yield pa.RecordBatch.from_pylist([{"file_id": r["file_id"], "piece": r["part"], "crc": crc, "size": size, "said": said, "version": version}], schema=kind)

    kind = pa.schema([("file_id", pa.string()), ("piece", pa.int64()), ("crc", pa.int64()), ("size", pa.int64()), ("said", pa.int64()), ("version", pa.int64())])
    found = parts.join(last, "file_id").mapInArrow(sums, "file_id string, piece long, crc long, size long, said long, version long")
    told = found.groupBy("file_id").agg(F.max("said").alias("said"), F.max("version").alias("version"))
    return combined_checksums(found).join(told, "file_id").select("file_id", F.when(F.col("version") >= 2, F.col("crc") == F.col("said")).alias("ok"))
