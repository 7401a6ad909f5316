"""An index the other way round: for each element (byte or pair) the blocks that have it, as 64-bit masks.

It is stored as Parquet in bands of elements, sorted by element within each, so a query reads the rows of its own elements
and nothing else of the index or of the data. Candidates are then found 64 blocks at a time by shifts and masks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IncompatibleIndexConfiguration, IndexConfig
from ..functions import vectors
from ..operators.filters import ByteFilter, NgramFilter
from ..operators.ranges import merge_adjacent
from ..operators.segment import metadata, segment
from . import candidates as plan

#: Blocks of a mask, elements of a band, and elements of one scan: longer lists reach Parquet as their least and largest only.
WORD, BAND, SCAN = 64, 4096, 10
#: Scans of a query at most; with more elements each scan has more of them.
SCANS = 32
BLOCKS_OF_STRETCH = plan.STRETCH
#: Bytes that one row brings to Python, and bytes whose postings are put into lists together.
PIECE_BYTES, PACKED_BYTES = 4096, 4 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def element_number(element: plan.Element) -> int:
    """Bytes by themselves, pairs (first << 8 | second) from 256 on."""
    return element[1] + 256 * (element[0] == "pair")


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes, whatever size they come in."""
    held, size = [], 0
    for b in batches:
        ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(b.column("ext"))), dtype=np.int64)))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most - size, "right")) - 1)
            held.append(b.slice(at, to - at))
            size += int(ends[to] - ends[at])
            at = to
            if size >= most or at < b.num_rows:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def packed(files: DataFrame, block_size: int, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """band, element and lists file_ids, chunks, masks: bit k of a mask says that block 64 * chunk + k of the file has the element.

    A row for each element of a batch, so that what is shuffled and sorted is few rows. Masks are made without a shuffle; a
    chunk that two batches share has a mask of each. Spark cuts files into pieces of some blocks, so that long ones aren't
    whole in a batch; blocks are told apart within them.
    """
    fewer = max(1, min(WORD, PIECE_BYTES // block_size))
    together = 1 << fewer.bit_length() - 1  # blocks of a piece, which never crosses a word
    rows, most = segment(files, block_size * together, id_col, data_col).select("file_id", "block_id", "ext"), PACKED_BYTES
    kind = rows.schema["file_id"].dataType
    schema = T.StructType([T.StructField("band", T.IntegerType()), T.StructField("element", T.IntegerType()), *(T.StructField(n, T.ArrayType(t)) for n, t in (("file_ids", kind), ("chunks", T.LongType()), ("masks", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _stretches(batches, most):
            ids, piece, (data, starts) = b.column(0), np.asarray(b.column(1)), vectors.raw_bytes(b.column(2))
            lead = (piece > 0).astype(np.int64)  # the byte before the piece
            own = np.diff(starts) - lead
            n_blocks = -(-own // block_size)
            row = np.repeat(np.arange(len(own)), n_blocks)
            inside = np.arange(len(row)) - (np.cumsum(n_blocks) - n_blocks)[row]
            block = np.repeat(np.arange(len(row), dtype=np.uint32), np.minimum(block_size, own[row] - inside * block_size) + lead[row] * (inside == 0))
            chunk, bit = piece * together // WORD, (piece * together % WORD)[row] + inside
            new_file = np.asarray(pc.not_equal(ids[1:], ids[:-1]).fill_null(True), bool)
            heads = np.concatenate(([0], 1 + np.flatnonzero(new_file | (chunk[1:] != chunk[:-1]))))
            run_of = np.repeat(np.arange(len(heads)), np.diff(np.concatenate((heads, [b.num_rows]))))[row]
            flags = np.zeros(len(row) << 8, bool)
            flags[np.delete(block << 8 | data, starts[:-1][lead > 0])] = True
            at_byte = np.flatnonzero(flags)
            across = starts[1:-1] - 1  # the last byte of a piece and the first of the next are no pair
            pair_at, pair = vectors.distinct(np.delete(block[1:], across), np.delete(data[:-1].astype(np.uint32) << np.uint32(8) | data[1:], across))
            at = np.concatenate((at_byte >> 8, pair_at))
            width = len(heads).bit_length()
            key = np.sort((np.concatenate((at_byte & 255, pair + 256)) << width | run_of[at]) * WORD + bit[at])
            place = key // WORD
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            masks = np.bitwise_or.reduceat(np.uint64(1) << (key % WORD).astype(np.uint64), first).view(np.int64)
            element, head = place[first] >> width, heads[place[first] & (1 << width) - 1]
            begins = np.flatnonzero(np.concatenate(([True], element[1:] != element[:-1])))
            to = pa.array(np.concatenate((begins, [len(element)])), pa.int32())
            lists = [pa.ListArray.from_arrays(to, values) for values in (ids.take(pa.array(head)), pa.array(chunk[head]), pa.array(masks))]
            yield pa.RecordBatch.from_arrays([pa.array((element[begins] // BAND).astype(np.int32)), pa.array(element[begins].astype(np.int32)), *lists], schema.names)

    return rows.mapInArrow(run, schema)


def unpacked(lists: DataFrame) -> DataFrame:
    """file_id, chunk, element, mask, band: a row for each entry of packed()'s lists."""
    rows = lists.select("band", "element", F.inline(F.arrays_zip("file_ids", "chunks", "masks")).alias("file_id", "chunk", "mask"))
    return rows.select("file_id", "chunk", "element", "mask", "band")


@dataclass(frozen=True)
class InvertedIndex:
    """postings (band, element, file_id, chunk, mask) and a row for each file: file_id, total_len, n_blocks."""

    block_size: int
    postings: DataFrame
    files: DataFrame
    lists: DataFrame | None = None  # the same postings as packed() gives them, of an index that isn't stored yet

    @classmethod
    def build(cls, files: DataFrame, block_size: int, id_col: str = "file_id", data_col: str = "data") -> InvertedIndex:
        IndexConfig(block_size).validate()
        lists = packed(files, block_size, id_col, data_col)
        return cls(block_size, unpacked(lists), metadata(files, block_size, id_col, data_col).select("file_id", "total_len", "n_blocks"), lists)

    def save(self, path: str) -> None:
        """One shuffle, by band, whose large partitions adaptive execution splits and whose small ones it joins; `about` is written last.

        Lists are sorted, by element and first file, and unpacked as they are written. A task's bands follow each other, so
        their writers are opened side by side instead of sorting rows once more.
        """
        spark = self.files.sparkSession
        lists = self.lists if self.lists is not None else self.postings.select("band", "element", *(F.array(n).alias(f"{n}s") for n in ("file_id", "chunk", "mask")))
        order = ["band", "element", F.element_at("file_ids", 1), F.element_at("chunks", 1)]
        before = spark.conf.get(_WRITERS)
        spark.conf.set(_WRITERS, str((256 + 65_536) // BAND + 1))
        try:
            unpacked(lists.hint("rebalance", "band").sortWithinPartitions(*order)).write.partitionBy("band").parquet(f"{path}/postings")
        finally:
            spark.conf.set(_WRITERS, before)
        self.files.write.parquet(f"{path}/files")
        spark.range(1).select(F.lit(self.block_size).alias("block_size")).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedIndex:
        """Reads one number; postings and files are read as far as queries need them."""
        about = spark.read.parquet(f"{path}/about").first()
        found = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/files")
        for df, names in zip(found, (("band", "element", "file_id", "chunk", "mask"), ("file_id", "total_len", "n_blocks"))):
            if lacking := [c for c in names if c not in df.columns]:
                raise IncompatibleIndexConfiguration(f"no column {', '.join(lacking)}")
        return cls(about.block_size, *found)

    def rows_of(self, elements: Sequence[int]) -> DataFrame:
        """The postings of some elements: scans of few elements each, so that every scan's list of them reaches Parquet."""
        wanted = sorted(set(elements))
        step = max(SCAN, -(-len(wanted) // SCANS))
        out = None
        for lo in range(0, max(1, len(wanted)), step):
            some = wanted[lo : lo + step]
            scan = self.postings.where(F.col("band").isin(sorted({e // BAND for e in some})) & F.col("element").isin(some)).select("file_id", "chunk", "element", "mask")
            out = scan if out is None else out.unionByName(scan)
        return out

    def element_blocks(self) -> DataFrame:
        """element, blocks: how many blocks have it."""
        return self.postings.groupBy("element").agg(F.sum(F.bit_count("mask")).cast("long").alias("blocks"))


def _in_stretch():
    return Window.partitionBy("file_id", "stretch").orderBy("chunk")


def _at(name: str, away: int) -> Column:
    """The word of the chunk so many after this one; none is 0."""
    if not away:
        return F.col(name)
    return F.coalesce(F.max(name).over(_in_stretch().rangeBetween(away, away)), F.lit(0).cast("long"))


def _later(name: str, k: int) -> Column:
    """Each block has what the block k before it had."""
    q, r = divmod(k, WORD)
    return _at(name, -q) if not r else F.shiftleft(_at(name, -q), r).bitwiseOR(F.shiftrightunsigned(_at(name, -q - 1), WORD - r))


def _earlier(name: str, k: int) -> Column:
    """Each block has what the block k after it had."""
    q, r = divmod(k, WORD)
    return _at(name, q) if not r else F.shiftrightunsigned(_at(name, q), r).bitwiseOR(F.shiftleft(_at(name, q + 1), WORD - r))


def _steps(wide: int) -> Iterator[int]:
    """By how much to shift a union of so many neighbours, until there are `wide`."""
    have = 1
    while have < wide:
        yield (step := min(have, wide - have))
        have += step


def _all(columns: list[Column]) -> Column:
    out = F.lit(-1).cast("long")
    for c in columns:
        out = out.bitwiseAND(c)
    return out


def _any(columns: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for c in columns:
        out = out.bitwiseOR(c)
    return out


def _chunks_in_reach(wide: int) -> Column:
    """How far chunks are away (0 included) whose blocks a match can cover that ends or begins in column `some`."""
    reach = -(-wide // WORD)
    if reach > 1:
        return F.array(*map(F.lit, range(-reach, reach + 1)))
    after = F.when(F.shiftrightunsigned("some", WORD - wide + 1) != 0, 1)
    before = F.when(F.col("some").bitwiseAND(F.lit((1 << (wide - 1)) - 1).cast("long")) != 0, -1)
    return F.array_compact(F.array(F.lit(0), after, before if wide >= 3 else F.lit(None).cast("int")))


def candidate_blocks(index: InvertedIndex, byte: ByteFilter | None = None, ngram: NgramFilter | None = None) -> DataFrame:
    """file_id, block_id, offset, length: the same blocks as plans.candidates.candidate_blocks() finds, from postings alone.

    The postings read meet their files' sizes, then are shuffled once, by file and stretch of chunks; all windows are over
    that. A file that has no wanted element isn't met at all. Ids of files aren't null.
    """
    wanted = plan.clauses(byte, ngram)
    numbered = [[[element_number(e) for e in elements] for elements in patterns] for patterns in wanted]
    if any(not patterns for patterns in numbered):
        return _placed(index.files.withColumn("block_id", F.lit(0).cast("long")).where("false"), index.block_size)
    narrowing = [patterns for patterns in numbered if all(patterns)]  # a pattern without elements is in every block
    if not narrowing:
        every = index.files.where("n_blocks > 0").withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        return _placed(every, index.block_size)
    elements = sorted({e for patterns in numbered for p in patterns for e in p})
    wide = plan.span(ngram.max_pattern_bytes, index.block_size) if ngram is not None else 2
    near = -(-wide // WORD) + 1
    size = max(BLOCKS_OF_STRETCH // WORD, 8 * near)
    read = index.rows_of(elements).join(index.files.select("file_id", "total_len", "n_blocks"), "file_id")
    rows = plan.stretched(read, near, near, "chunk", size).repartition("file_id", "stretch")
    file, names = ["file_id", "stretch", "total_len", "n_blocks"], [f"e{e}" for e in elements]
    words = rows.groupBy(*file, "chunk").agg(*[F.coalesce(F.bit_or(F.when(F.col("element") == e, F.col("mask"))), F.lit(0).cast("long")).alias(n) for e, n in zip(elements, names)])
    words = words.withColumn("some", _any([F.col(n) for n in names]))
    # what these blocks have counts for blocks without any element too: chunks that hold only such blocks need a row
    beside = words.withColumn("to", F.explode(_chunks_in_reach(wide))).withColumn("chunk", F.col("chunk") + F.col("to")).where(F.col("chunk").between(0, F.floor((F.col("n_blocks") - 1) / WORD)))
    words = beside.groupBy(*file, "chunk").agg(*[F.bit_or(F.when(F.col("to") == 0, F.col(n)).otherwise(F.lit(0).cast("long"))).alias(n) for n in [*names, "some"]])

    def full() -> Column:
        return _all([_any([_all([F.col(f"e{e}") for e in p]) for p in patterns]) for patterns in narrowing])

    words = words.withColumn("s", full())
    for k, step in enumerate(_steps(wide)):
        words = words.withColumns({n: F.col(n).bitwiseOR(_later(n, step)) for n in names})
        if k == 0:
            words = words.withColumn("p", full())
    there = F.col("n_blocks") - F.col("chunk") * WORD  # blocks that the file doesn't have are nothing's end
    real = F.when(there >= WORD, F.lit(-1).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (WORD - there).cast("int")))
    from_block = lambda k: F.when(F.col("chunk") == 0, F.lit(~((1 << k) - 1)).cast("long")).otherwise(F.lit(-1).cast("long"))
    words = words.withColumn("alone", F.bitwise_not("s").bitwiseAND(real)).withColumn("p", _all([F.col("p"), F.col("alone"), from_block(1)]))
    words = words.withColumn("m", _all([F.bitwise_not("p"), F.col("alone"), full(), from_block(2)]) if wide >= 3 else F.lit(0).cast("long"))
    words = words.select(*file, "chunk", "some", "s", "p", "m")
    if wide >= 3:
        for step in _steps(wide):
            words = words.withColumn("m", F.col("m").bitwiseOR(_earlier("m", step)))
    words = words.withColumn("base", _any([F.col("s"), F.col("p"), _earlier("p", 1), F.col("m")]))
    words = words.withColumn("found", F.col("base").bitwiseOR(_earlier("base", 1).bitwiseAND(F.col("some"))))
    hits = words.where((F.col("found") != 0) & (F.floor(F.col("chunk") / size) == F.col("stretch")))
    bits = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("found"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return _placed(hits.select(*file, "chunk", F.explode(bits).alias("bit")).withColumn("block_id", F.col("chunk") * WORD + F.col("bit")), index.block_size)


def _placed(rows: DataFrame, block_size: int) -> DataFrame:
    offset = F.col("block_id") * block_size
    rows = rows.where(F.col("block_id") < F.col("n_blocks"))
    return rows.select("file_id", "block_id", offset.alias("offset"), F.least(F.lit(block_size).cast("long"), F.col("total_len") - offset).alias("length"))


def candidate_ranges(index: InvertedIndex, byte: ByteFilter | None = None, ngram: NgramFilter | None = None) -> DataFrame:
    """candidate_blocks(), with adjacent ranges merged."""
    return merge_adjacent(candidate_blocks(index, byte, ngram))
