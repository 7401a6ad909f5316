"""Binary exchange of a file's index: a record of all blocks, and an envelope with run-length compression.

Layout, little-endian (fixed): b"FSBX", version, block size, bytes, blocks, last byte (0xFF: none or 0xFF); for each
block 256 counts, bloom bits (top bit: exact pairs follow), words, and with exact pairs a marker and 65 536 bits; CRC-32.
Envelope: b"FSTR", version 1, compression (0 none, 1 run lengths), size, payload, CRC-32.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import config as c
from ..functions import vectors

MAGIC, VERSION, MARKER, FLAG = b"FSBX", 3, 0x455850414952535F, 1 << 63
ENVELOPE, ENVELOPE_VERSION = b"FSTR", 1
HEAD, HEAD3, SMALLEST_BLOCK = 32, 33, 256 * 4 + 16
#: Cells of a table while blocks are encoded (few enough for a processor's cache), bytes coded at once, bytes of records that are given back at once, and blocks decoded at once.
CELLS, PART_BYTES, BATCH_BYTES, BATCH_BLOCKS = 1 << 20, 1 << 18, 8 << 20, 1024
#: Bytes of a batch that Spark hands to a task: records are many times larger than their data.
HANDED_BYTES = 16 << 20
LONGEST_RUN = 65_535


@dataclass
class Decoded:
    block_size: int
    total_len: int
    last_byte: int | None
    histograms: np.ndarray
    bits: int
    words: list[np.ndarray]
    exact: list[np.ndarray | None]

    @property
    def n(self) -> int:
        return len(self.words)


@dataclass
class Layout:
    """A record that was checked: where its blocks are.

    rows: a row of bytes for each block if all are alike, else null; blocks: else where each one's counts begin, its bits,
    words and whether it has exact pairs. bits, exact: the first block's.
    """

    block_size: int
    total_len: int
    last_byte: int | None
    n: int
    start: int
    end: int
    bits: int
    exact: bool
    rows: np.ndarray | None
    blocks: list[tuple[int, int, int, bool]]


def encode(data: bytes, config: c.IndexConfig) -> bytes:
    """The record of all blocks of the data."""
    return next(encode_each([data], config))


def encode_each(values: Sequence[bytes], config: c.IndexConfig) -> Iterator[bytes]:
    """The record of each value."""
    config.validate()
    size = config.block_size
    for data, parts in zip(values, _blocks_of(values, [None] * len(values), size, config.bits, config.exact)):
        yield _closed(_head(size, len(data), -(-len(data) // size), data[-1] if data else 0xFF), parts)


def _head(size: int, total: int, blocks: int, last_byte: int) -> bytes:
    return MAGIC + struct.pack("<IQQQB", VERSION, size, total, blocks, last_byte)


def _closed(head: bytes, parts: Sequence) -> bytes:
    """A record from its head and what follows, with the checksum."""
    crc = zlib.crc32(head)
    for part in parts:
        crc = zlib.crc32(part, crc)
    return b"".join([head, *parts, struct.pack("<I", crc)])


def encoded_blocks(data: bytes, size: int, bits: int, exact: bool, before: int | None) -> list[np.ndarray]:
    """The blocks' parts of a record, many in one piece; before: the byte ahead of the data, if any."""
    return next(_blocks_of([data], [before], size, bits, exact))


def _blocks_of(values: Sequence[bytes], before: Sequence[int | None], size: int, bits: int, exact: bool) -> Iterator[list[np.ndarray]]:
    """The same of each value; small ones are encoded together."""
    stride = SMALLEST_BLOCK + bits // 8 + 8200 * exact
    most = max(1, CELLS // max(bits, stride, 16 * size))  # below 65 536, as blocks of many bits are fewer

    def together(lo: int, hi: int) -> Iterator[list[np.ndarray]]:
        some = [k for k in range(lo, hi) if values[k]]
        sizes = np.array([len(values[k]) for k in some], np.int64)
        blocks, starts = -(-sizes // size), np.cumsum(sizes) - sizes
        ends = np.cumsum(blocks)
        lengths = np.full(int(blocks.sum()), size)
        lengths[ends - 1] = sizes - (blocks - 1) * size
        table = _encoded(np.frombuffer(b"".join(values[lo:hi]), np.uint8), lengths, starts, [before[k] for k in some], bits, exact, stride) if some else None
        stop = dict(zip(some, zip((ends - blocks).tolist(), ends.tolist())))
        return ([table[slice(*stop[k])].reshape(-1)] if k in stop else [] for k in range(lo, hi))

    lo = held = 0
    for k, value in enumerate(values):
        n = -(-len(value) // size)
        if held + n > most:
            yield from together(lo, k)
            lo, held = k, 0
        held += n
        if n > most:
            raw, out, step = np.frombuffer(value, np.uint8), [], most * size
            for at in range(0, len(raw), step):
                part = raw[at : at + step]
                lengths = np.diff(np.append(np.arange(0, len(part), size), len(part)))
                out.append(_encoded(part, lengths, np.zeros(1, np.int64), [int(raw[at - 1]) if at else before[k]], bits, exact, stride).reshape(-1))
            yield out
            lo, held = k + 1, 0
    yield from together(lo, len(values))


@cache
def _positions(bits: int) -> list[np.ndarray]:
    """vectors.positions() by hash, in as few bytes as may be."""
    return list(np.ascontiguousarray(vectors.positions(bits).T.astype(np.uint16 if bits <= 1 << 16 else np.uint32)))


def _encoded(raw: np.ndarray, lengths: np.ndarray, starts: np.ndarray, before: Sequence[int | None], bits: int, exact: bool, stride: int) -> np.ndarray:
    """A row of `stride` bytes for each block of `lengths`; before: the byte ahead of the data that begins at each of `starts`."""
    n = len(lengths)
    out = np.zeros((n, stride), np.uint8)
    rows = np.repeat(np.arange(n, dtype=np.uint32), lengths)
    out[:, :1024] = np.bincount(rows << np.uint32(8) | raw, minlength=n << 8).astype("<u4").view(np.uint8).reshape(n, 1024)
    out[:, 1024:1040] = np.frombuffer(struct.pack("<QQ", bits | FLAG * exact, bits // 64), np.uint8)
    ahead = np.zeros(len(raw), np.uint32)
    ahead[1:] = raw[:-1]
    ahead[starts] = [x or 0 for x in before]
    key = rows << np.uint32(16) | ahead << np.uint32(8) | raw  # a pair is the block's in which it ends
    key = np.delete(key, starts[[x is None for x in before]])
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    at, codes = (key >> np.uint32(16)).astype(np.int64), (key & np.uint32(0xFFFF)).astype(np.int64)
    flags, row = np.zeros(n * bits, bool), at * bits
    for places in _positions(bits):
        flags[row + places[codes]] = True
    out[:, 1040 : 1040 + bits // 8] = np.packbits(flags, bitorder="little").reshape(n, bits // 8)
    if exact:
        out[:, -8200:-8192] = np.frombuffer(struct.pack("<Q", MARKER), np.uint8)
        if len(codes):
            cell = key >> np.uint32(3)
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            out.reshape(-1)[at[first] * stride + (stride - 8192) + (codes[first] >> 3)] = np.bitwise_or.reduceat(np.left_shift(1, codes & 7).astype(np.uint8), first)
    return out


def read_head(raw: bytes, whole: int, checksum: bool = False) -> tuple[int, int, int, int, int]:
    """Version, block size, bytes, blocks and the head's size of a record of `whole` bytes that begins with raw; checked.

    checksum: raw is all of it, and its checksum is looked at before the block size.
    """
    if whole < HEAD:
        raise c.TruncatedHeader(f"{whole} of {HEAD} bytes")
    if raw[:4] != MAGIC:
        raise c.InvalidMagic(repr(raw[:4]))
    version, size, total, blocks = struct.unpack_from("<IQQQ", raw, 4)
    if not 1 <= version <= VERSION:
        raise c.UnsupportedVersion(f"version {version}; {VERSION} is the latest")
    head = HEAD3 if version >= 3 else HEAD
    if whole < head + 4 * (version >= 2):
        raise c.TruncatedHeader(f"{whole} of {head + 4 * (version >= 2)} bytes")
    if checksum and version >= 2 and zlib.crc32(memoryview(raw)[:-4]) != struct.unpack_from("<I", raw, whole - 4)[0]:
        raise c.ChecksumMismatch("the record's checksum is another")
    if size < c.MIN_BLOCK or size & (size - 1):
        raise c.InvalidBlockSize(str(size))
    return version, size, total, blocks, head


def layout(raw: bytes) -> Layout:
    """Checks in this order: length, magic, version, length, checksum, block size, number of blocks, each block."""
    version, size, total, blocks, head = read_head(raw, len(raw), checksum=True)
    end = len(raw) - 4 if version >= 2 else len(raw)
    if blocks > (end - head) // SMALLEST_BLOCK:
        raise c.BlockCountOverflow(f"{blocks} blocks in {end - head} bytes")
    out = Layout(size, total, None if version < 3 or raw[32] == 0xFF else raw[32], blocks, head, end, 0, False, None, [])
    if blocks:
        flagged, words = struct.unpack_from("<QQ", raw, head + 1024)
        out.exact, out.bits = bool(flagged & FLAG), flagged & ~FLAG
        out.rows = _alike(raw, head, end, blocks, words, out.exact)
    if out.rows is not None:
        check_bloom(0, out.bits, words)
        return out
    at = head

    def take(n: int, k: int) -> int:
        nonlocal at
        if at + n > end:
            raise c.TruncatedBlock(f"block {k}")
        at += n
        return at - n

    for k in range(blocks):
        begin = take(1024, k)
        bits, n = struct.unpack_from("<QQ", raw, take(16, k))
        exact, bits = bool(bits & FLAG), bits & ~FLAG
        take(8 * n, k)
        check_bloom(k, bits, n)
        if exact:
            if struct.unpack_from("<Q", raw, take(8, k))[0] != MARKER:
                raise c.TruncatedBlock(f"block {k}")
            take(8192, k)
        out.blocks.append((begin, bits, n, exact))
    return out


def _alike(raw: bytes, start: int, end: int, n: int, words: int, exact: bool) -> np.ndarray | None:
    """n blocks as rows of bytes, if all begin as the first one does."""
    stride = SMALLEST_BLOCK + 8 * words + 8200 * exact
    if start + n * stride > end:
        return None
    rows = np.frombuffer(raw, np.uint8, n * stride, start).reshape(n, stride)
    same = (rows[:, 1024:1040] == rows[0, 1024:1040]).all() and (not exact or (rows[:, -8200:-8192] == np.frombuffer(struct.pack("<Q", MARKER), np.uint8)).all())
    return rows if same else None


def decode(raw: bytes) -> Decoded:
    """What a record holds, checked by layout()."""
    has = layout(raw)
    if has.rows is not None:
        counts, words = (np.ascontiguousarray(has.rows[:, lo:hi]) for lo, hi in ((0, 1024), (SMALLEST_BLOCK, has.rows.shape[1] - 8200 * has.exact)))
        tables = list(np.ascontiguousarray(has.rows[:, -8192:]).view("<u8")) if has.exact else [None] * has.n
        return Decoded(has.block_size, has.total_len, has.last_byte, counts.view("<u4").astype(np.int64), has.bits, list(words.view("<u8")), tables)
    out = Decoded(has.block_size, has.total_len, has.last_byte, np.empty((has.n, 256), np.int64), has.bits, [], [])
    for k, (at, _, n, exact) in enumerate(has.blocks):
        out.histograms[k] = np.frombuffer(raw, "<u4", 256, at)
        out.words.append(np.frombuffer(raw, "<u8", n, at + SMALLEST_BLOCK))
        out.exact.append(np.frombuffer(raw, "<u8", 1024, at + SMALLEST_BLOCK + 8 * n + 8) if exact else None)
    return out


def check_bloom(k: int, bits: int, n_words: int) -> None:
    """bloom_from_parts() of a block of a record, whose faults are all told alike."""
    try:
        bloom_from_parts(bits, range(n_words))
    except c.SkipIndexError as e:
        raise c.TruncatedBlock(f"block {k}: {e}") from None


def bloom_from_parts(bits: int, words: Sequence | np.ndarray) -> Sequence | np.ndarray:
    """The words of a bloom of `bits`, checked: some bits, a power of two, and enough words."""
    if bits == 0:
        raise c.ZeroBloomBits("a bloom needs at least one bit")
    if bits & (bits - 1):
        raise c.InvalidBlockSize(f"{bits} bits are no power of two")
    if len(words) < -(-bits // 64):
        raise c.TruncatedBlock(f"{len(words)} words for {bits} bits")
    return words


def append_record(raw: bytes, more: bytes, last_byte: int | None = None) -> bytes:
    """The record with further full blocks, without the bytes that it was built from.

    last_byte: the byte that the indexed data ended with, for the pair across the seam; by default the record's own.
    """
    return next(append_each([raw], [more], last_byte))


def append_each(records: Sequence[bytes], more: Sequence[bytes], last_byte: int | None = None) -> Iterator[bytes]:
    """The same of each record."""

    def checked() -> Iterator[tuple[bytes, bytes, Layout]]:
        for raw, data in zip(records, more):
            old = layout(raw)
            if old.total_len % old.block_size:
                raise c.TrailingPartialBlock("the last block isn't full: nothing can follow it")
            if len(data) % old.block_size:
                raise c.UnalignedData(f"{len(data)} bytes are no blocks of {old.block_size}")
            if not old.n:
                raise c.ZeroBloomBits("a record without blocks doesn't say how large blooms are")
            yield raw, data, old

    for kind, some in itertools.groupby(checked(), lambda x: (x[2].block_size, x[2].bits, x[2].exact)):
        rows = list(some)
        parts = _blocks_of([data for _, data, _ in rows], [old.last_byte if last_byte is None else last_byte for *_, old in rows], *kind)
        for (raw, data, old), new in zip(rows, parts):
            last = data[-1] if data else 0xFF if old.last_byte is None else old.last_byte
            yield _closed(_head(old.block_size, old.total_len + len(data), old.n + len(data) // old.block_size, last), [memoryview(raw)[old.start : old.end], *new])


def compress(raw: bytes) -> bytes:
    """Runs of four or more of a byte, and every 0xFE and 0xFF, become 0xFF, length (16 bits, high first), byte."""
    return b"".join(_compressed(part) for part in _between_runs(raw))


def _between_runs(raw: bytes) -> Iterator[np.ndarray]:
    """The bytes in parts of PART_BYTES or more, none of which ends inside a run."""
    data, at = np.frombuffer(raw, np.uint8), 0
    while at < len(data):
        to = at + PART_BYTES
        while to < len(data):
            part = data[to - 1 : to + PART_BYTES]
            other = np.flatnonzero(part[1:] != part[:-1])
            if len(other):
                to += int(other[0])
                break
            to += len(part) - 1
        yield data[at:to]
        at = to


def _compressed(data: np.ndarray) -> bytes:
    starts = np.concatenate(([0], 1 + np.flatnonzero(data[1:] != data[:-1])))
    n, value = np.diff(np.concatenate((starts, [len(data)]))), data[starts]
    if n.max() > LONGEST_RUN:  # whole codes of it, then what is left
        times = -(-n // LONGEST_RUN)
        last = np.cumsum(times) - 1
        left = n - (times - 1) * LONGEST_RUN
        value, n = np.repeat(value, times), np.full(last[-1] + 1, LONGEST_RUN)
        n[last] = left
    coded = (n >= 4) | (value >= 0xFE)
    size = np.where(coded, 4, n)
    at = np.cumsum(size) - size
    out = np.empty(int(at[-1] + size[-1]), np.uint8)
    code, plain = at[coded], ~coded
    out[code], out[code + 1], out[code + 2], out[code + 3] = 0xFF, n[coded] >> 8, n[coded] & 255, value[coded]
    for k in range(3):
        some = plain & (n > k)
        out[at[some] + k] = value[some]
    return out.tobytes()


def decompress(packed: bytes, most: int) -> bytes:
    data = np.frombuffer(packed, np.uint8)
    codes, after = [], 0
    for p in np.flatnonzero(data == 0xFF).tolist():
        if p >= after:
            codes.append(p)
            after = p + 4
    if not codes:
        return packed
    whole = np.array(codes if after <= len(data) else codes[:-1], np.int64)
    n = data[whole + 1].astype(np.int64) << 8 | data[whole + 2]
    if len(whole) and (whole + np.cumsum(n - 4) + 4).max() > most:
        raise c.TransportError("more than the stated size")
    if after > len(data):
        raise c.TransportError("a run is cut off")
    times = np.ones(len(data), np.uint16)
    for k in range(3):
        times[whole + k] = 0
    times[whole + 3] = n
    return b"".join(np.repeat(data[a : a + PART_BYTES], times[a : a + PART_BYTES]).tobytes() for a in range(0, len(data), PART_BYTES))


def to_transport(record: bytes, run_length: bool = True) -> bytes:
    body = ENVELOPE + struct.pack("<IBQ", ENVELOPE_VERSION, int(run_length), len(record)) + (compress(record) if run_length else record)
    return body + struct.pack("<I", zlib.crc32(body))


def from_transport(raw: bytes) -> bytes:
    if len(raw) < 21:
        raise c.TransportError("too short")
    if raw[:4] != ENVELOPE:
        raise c.TransportError(f"magic {raw[:4]!r}")
    version, kind, size = struct.unpack_from("<IBQ", raw, 4)
    if version != ENVELOPE_VERSION:
        raise c.TransportError(f"version {version}")
    if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise c.TransportError("the envelope's checksum is another")
    if size > c.MAX_TRANSPORT:
        raise c.TransportError(f"{size} bytes")
    if kind not in (0, 1):
        raise c.TransportError(f"compression {kind}")
    record = decompress(raw[17:-4], size) if kind else raw[17:-4]
    if len(record) != size:
        raise c.TransportError(f"{len(record)} of {size} bytes")
    return record


def _handed(rows: DataFrame) -> DataFrame:
    """The rows, of which Spark hands a task HANDED_BYTES at once (for the session, as tasks run when the caller asks)."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = str(rows.sparkSession.conf.get(name)).removesuffix("b")
    if not said.isdigit() or int(said) > HANDED_BYTES:
        rows.sparkSession.conf.set(name, str(HANDED_BYTES))
    return rows


#: Columns of some rows by name: Arrow's, or Python's values as long as nobody but the next step reads them.
Columns = dict[str, pa.Array | list]


@dataclass(frozen=True)
class Step:
    """Something done with rows in a task; made: the columns that it adds, as in a schema."""

    run: Callable[[Iterator[Columns]], Iterator[Columns]]
    made: str


def chained(rows: DataFrame, *steps: Step, select: Sequence[str]) -> DataFrame:
    """Columns of the rows after the steps, all of them in the tasks that have the rows.

    Records are many times larger than their data: what only a next step reads doesn't leave the task.
    """
    rows = _handed(rows)
    fields = {f.name: f for f in rows.schema.fields} | {f.name: f for step in steps for f in T.StructType.fromDDL(step.made).fields}
    kinds = {name: to_arrow_type(fields[name].dataType) for step in steps for name in T.StructType.fromDDL(step.made).names}
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Iterator[Columns] = (dict(zip(names, b.columns)) for b in batches)
        for step in steps:
            found = step.run(found)
        for columns in found:
            yield pa.RecordBatch.from_arrays([x if isinstance(x := columns[name], pa.Array) else pa.array(x, kinds[name]) for name in select], list(select))

    return rows.mapInArrow(run, T.StructType([fields[name] for name in select]))


def _bounded(columns: Columns, to: str, made: Iterable[bytes]) -> Iterator[Columns]:
    """The columns with a record for each row, BATCH_BYTES at once, however many rows these are."""
    out, size, first = [], 0, 0
    for record in made:
        out.append(record)
        size += len(record)
        if size >= BATCH_BYTES:
            yield {k: x[first : first + len(out)] for k, x in columns.items() if k != to} | {to: out}
            first, out, size = first + len(out), [], 0
    if out:
        yield {k: x[first : first + len(out)] for k, x in columns.items() if k != to} | {to: out}


def _values(column: pa.Array | list) -> list:
    return column.to_pylist() if isinstance(column, pa.Array) else column


def encoding(config: c.IndexConfig, transport: bool = False, data: str = "data", to: str = "record") -> Step:
    """Each row's record, in the envelope if asked; no data is no bytes."""

    def run(rows: Iterator[Columns]) -> Iterator[Columns]:
        for columns in rows:
            made = encode_each([x or b"" for x in _values(columns[data])], config)
            yield from _bounded(columns, to, (to_transport(r) for r in made) if transport else made)

    return Step(run, f"`{to}` binary")


def appending(record: str = "record", data: str = "data") -> Step:
    """Records with the further full blocks beside them, if any (null: none)."""

    def run(rows: Iterator[Columns]) -> Iterator[Columns]:
        for columns in rows:
            old, more = _values(columns[record]), _values(columns[data])
            some = [k for k, x in enumerate(more) if x]
            grown = append_each([old[k] for k in some], [more[k] for k in some])
            yield from _bounded(columns, record, (next(grown) if x else r for r, x in zip(old, more)))

    return Step(run, f"`{record}` binary")


def matching(first: str, second: str) -> Step:
    """The rows whose values of both columns are the same bytes; null is like nothing."""

    def run(rows: Iterator[Columns]) -> Iterator[Columns]:
        for columns in rows:
            same = [a is not None and a == b for a, b in zip(_values(columns[first]), _values(columns[second]))]
            if all(same):
                yield columns
            elif any(same):
                yield {k: x.filter(pa.array(same)) if isinstance(x, pa.Array) else list(itertools.compress(x, same)) for k, x in columns.items()}

    return Step(run, "")


DECODED = "block_id long, block_size long, total_len long, bytes_present array<int>, words array<long>, pairs array<int>"
#: Columns whose lists take most of the time of decoding.
LISTS = ("bytes_present", "words", "pairs")


def decoding(transport: bool = False, record: str = "record", keep: Sequence[str] = ("file_id",), lists: Sequence[str] = LISTS) -> Step:
    """A row for each block of a record, all of which are checked, with the columns to keep; lists: those of LISTS that are wanted."""

    def run(rows: Iterator[Columns]) -> Iterator[Columns]:
        held, n = [], 0
        for columns in rows:
            for k, x in enumerate(columns[record]):
                raw = x.as_py() if isinstance(x, pa.Scalar) else x
                d = (decode if lists else layout)(from_transport(raw) if transport else raw)
                some = {name: columns[name][k : k + 1] for name in keep}
                for lo in range(0, d.n, BATCH_BLOCKS):
                    held.append((some, d, lo, min(lo + BATCH_BLOCKS, d.n)))
                    n += held[-1][3] - lo
                    if n >= BATCH_BLOCKS:
                        yield _decoded_batch(held, keep, lists)
                        held, n = [], 0
        if held:
            yield _decoded_batch(held, keep, lists)

    return Step(run, DECODED)


def _with_records(kept: Sequence[pa.Array], made: Iterable[bytes], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Columns of a batch with a record for each row, BATCH_BYTES at once, however many rows these are."""
    for columns in _bounded(dict(zip(names, kept)), names[-1], made):
        yield pa.RecordBatch.from_arrays([*(columns[k] for k in names[:-1]), pa.array(columns[names[-1]], pa.binary())], names)


def encode_files(files: DataFrame, config: c.IndexConfig, transport: bool = False, id_col: str = "file_id", data_col: str = "data", keep: Sequence[str] = ()) -> DataFrame:
    """file_id, columns to keep, record: each file's index, in the envelope if asked."""
    rows = files.select(F.col(id_col).alias("file_id"), *keep, F.col(data_col).cast("binary").alias("_data"))
    return chained(rows, encoding(config, transport, "_data"), select=["file_id", *keep, "record"])


def append_rows(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """file_id, columns to keep, record of rows with a record and, beside it, the further full blocks (`data`, null for none). No shuffle."""
    rows = rows.select("file_id", *keep, "record", F.col("data").cast("binary").alias("_data"))
    return chained(rows, appending(data="_data"), select=["file_id", *keep, "record"])


def append_files(records: DataFrame, more: DataFrame, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, record: each record with the further full blocks that `more` has for it, if any."""
    return append_rows(records.select("file_id", "record").join(more.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data")), "file_id", "left"))


def decode_files(records: DataFrame, transport: bool = False) -> DataFrame:
    """file_id, block_id, block_size, total_len, bytes_present, words, pairs (null without exact ones) of each block."""
    return chained(records.select("file_id", "record"), decoding(transport), select=["file_id", *T.StructType.fromDDL(DECODED).names])


def _decoded_batch(held: list[tuple], keep: Sequence[str], lists: Sequence[str]) -> Columns:
    """Blocks lo to hi of some records."""
    blocks = [hi - lo for _, _, lo, hi in held]
    n = sum(blocks)
    of = lambda values: values.take(pa.array(np.repeat(np.arange(len(held)), blocks)))
    out: Columns = {}
    for name in keep:
        values = [some[name] for some, *_ in held]
        out[name] = of(pa.concat_arrays(values)) if isinstance(values[0], pa.Array) else [x for v, k in zip(values, blocks) for x in v * k]
    out["block_id"] = pa.array(np.concatenate([np.arange(lo, hi) for _, _, lo, hi in held]))
    out |= {name: of(pa.array([getattr(d, name) for _, d, _, _ in held], pa.int64())) for name in ("block_size", "total_len")}
    if "bytes_present" in lists:
        out["bytes_present"] = vectors.lists(*np.nonzero(np.concatenate([d.histograms[lo:hi] for _, d, lo, hi in held])), n, pa.int32())
    if "words" in lists:
        words = [w for _, d, lo, hi in held for w in d.words[lo:hi]]
        ends = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        out["words"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(words).view(np.int64), pa.int64()))
    if "pairs" in lists:
        tables = [x for _, d, lo, hi in held for x in d.exact[lo:hi]]
        have = np.array([k for k, x in enumerate(tables) if x is not None], np.int64)
        codes = vectors.set_bits(np.stack([tables[k] for k in have]).view(np.uint8)) if len(have) else (have, have)
        out["pairs"] = vectors.lists(have[codes[0]], codes[1], n, pa.int32(), None if len(have) == n else np.isin(np.arange(n), have))
    return out
