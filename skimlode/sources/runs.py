"""The envelope's run-length coding of payloads that are cut into pieces: each piece is coded in a task, and what crosses a cut is stitched.

Coding: a run of equal bytes belongs to the piece in which it begins; how far it goes on is a sum over edge runs of pieces.
Decoding: a piece may begin inside a code of four bytes. What each of the four possible states at its start makes of the
state at its end is a small table; tables are composed in order, and then every piece is decoded from its true state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import TransportError
from . import codec
from .records import in_groups, sorted_by

#: Bytes of a code after its first (high and low byte of the length, and the byte), and rows that are given back at once.
AFTER, BATCH_ROWS = 3, 4096


def cut(files: DataFrame, piece_bytes: int, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, piece, data: each value in pieces of so many bytes, the last one shorter; an empty one has an empty piece."""
    data = F.coalesce(F.col(data_col).cast("binary"), F.lit(b""))
    rows = files.select(F.col(id_col).alias("file_id"), data.alias("data"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.length("data") - 1) / piece_bytes)).cast("long")))
    return rows.select("file_id", "data", at.alias("piece")).select("file_id", "piece", F.substring(F.col("data"), (F.col("piece") * piece_bytes + 1).cast("int"), F.lit(piece_bytes)).alias("data"))


def _edges(data: bytes) -> tuple[int, int]:
    """Lengths of the runs at a piece's start and end."""
    return len(data) - len(data.lstrip(data[:1])), len(data) - len(data.rstrip(data[-1:]))


def compress(pieces: DataFrame) -> DataFrame:
    """file_id, piece, data of pieces (file_id, piece, data): joined in order, codec.compress() of the joined pieces.

    Two narrow rows for each piece are put in order by file; payloads are shuffled once, to meet what was found for their edges.
    """
    kind = pieces.schema["file_id"].dataType.simpleString()
    schema = f"file_id {kind}, piece long, first int, lead long, last int, tail long, inner binary"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                if not data:
                    rows.append((None, 0, None, 0, b""))
                    continue
                lead, tail = _edges(data)
                alone = lead == len(data)
                rows.append((data[0], lead, data[-1], 0 if alone else tail, b"" if alone else codec.compress(data[lead : len(data) - tail])))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["file_id", "piece", "first", "lead", "last", "tail", "inner"])

    seen = pieces.select("file_id", F.col("piece").cast("long").alias("piece"), F.col("data").cast("binary").alias("data")).mapInArrow(look, schema)
    ends = F.array(F.struct(F.lit(0).alias("at"), F.col("first").alias("byte"), F.col("lead").alias("n")), F.struct(F.lit(1).alias("at"), F.col("last").alias("byte"), F.col("tail").alias("n")))
    runs = seen.select("file_id", "piece", F.inline(ends)).where("n > 0")
    order = Window.partitionBy("file_id").orderBy("piece", "at")
    opens = F.when((F.col("at") == 1) | F.lag("byte").over(order).isNull() | (F.lag("byte").over(order) != F.col("byte")), 1).otherwise(0)
    runs = runs.withColumn("opens", opens).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    total = runs.groupBy("file_id", "run").agg(F.sum("n").alias("total"), F.min(F.struct("piece", "at")).alias("begin"), F.first("byte").alias("byte"))
    whole = total.groupBy("file_id", F.col("begin.piece").alias("piece")).agg(*[F.max(F.when(F.col("begin.at") == k, F.struct("byte", "total"))).alias(n) for k, n in enumerate(("before", "after"))])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_coded(x) + (inner or b"") + _coded(y) for x, inner, y in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["file_id", "piece", "data"])

    found = seen.select("file_id", "piece", "inner").join(whole, ["file_id", "piece"], "left").select("file_id", "piece", "before", "inner", "after")
    return found.mapInArrow(joined, f"file_id {kind}, piece long, data binary")


def _coded(run: dict | None) -> bytes:
    """A run of any length, without making it."""
    if run is None:
        return b""
    value, left, out = run["byte"], run["total"], []
    if left >= 65_535:
        out.append(bytes([0xFF, 0xFF, 0xFF, value]) * (left // 65_535))
        left %= 65_535
    return b"".join([*out, codec.compress(bytes([value]) * left)])


def _states(data: bytes) -> list[int]:
    """For each number of bytes of a code that are still to come at a piece's start: how many are at its end."""
    out = []
    for missing in range(AFTER + 1):
        at = missing
        while at < len(data) and (at := data.find(b"\xff", at)) >= 0:
            at += 1 + AFTER
        out.append(max(0, at - len(data)))
    return out


def decompress(pieces: DataFrame, most: int) -> DataFrame:
    """file_id, piece, data of coded pieces: joined in order, codec.decompress() of the joined pieces. most: bytes that a file may have.

    A code that is cut belongs to the piece in which it ends: its first bytes come with that piece's start state. A code cut
    off at the end of a file, or more than `most` bytes, is an error when the rows are read.
    """
    kind = pieces.schema["file_id"].dataType.simpleString()
    rows = pieces.select("file_id", F.col("piece").cast("long").alias("piece"), F.col("data").cast("binary").alias("data"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([_states(x) for x in data], pa.list_(pa.int32())), pa.array([x[-AFTER:] for x in data], pa.binary())], ["file_id", "piece", "states", "ends"])

    file_type = to_arrow_type(rows.schema["file_id"].dataType)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (name,), found in in_groups(batches, 1):
            missing, before = 0, b""
            for _, piece, states, ends in found:
                out.append((name, piece, before[len(before) - (1 + AFTER - missing) :] if missing else b""))
                missing, before = states[missing], (before + ends)[-AFTER:]
                if len(out) >= BATCH_ROWS:
                    yield table(out)
                    out = []
            if missing:
                raise TransportError("a run is cut off")
        if out:
            yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (file_type, pa.int64(), pa.binary()))], ["file_id", "piece", "start"])

    looked = rows.mapInArrow(look, f"file_id {kind}, piece long, states array<int>, ends binary")
    starts = sorted_by(looked, "file_id", then="piece").mapInArrow(compose, f"file_id {kind}, piece long, start binary")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for data, start in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                left = _states(start + (data or b""))[0]  # of a code that the next piece ends
                whole = start + (data or b"")
                out.append(codec.decompress(whole[: len(whole) - (1 + AFTER - left)] if left else whole, most))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["file_id", "piece", "data"])

    out = rows.join(starts, ["file_id", "piece"]).select("file_id", "piece", "data", "start").mapInArrow(decoded, f"file_id {kind}, piece long, data binary")
    size = F.sum(F.length("data")).over(Window.partitionBy("file_id"))
    return out.withColumn("size", size).select("file_id", "piece", F.when(F.col("size") <= most, F.col("data")).otherwise(F.raise_error(F.lit(f"{TransportError.__name__}: more than {most} bytes"))).alias("data"))
