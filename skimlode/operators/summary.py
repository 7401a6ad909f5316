"""Block summaries: histograms, pairs, blooms. Batches of blocks are summarized at once, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import IndexConfig, L1_BYTES, line_count
from ..functions import vectors

KEY = ["file_id", "block_id"]
Batches = Iterator[pa.RecordBatch]


def _narrow(blocks: DataFrame, keep: list[str], column: str, added: str, run: Callable[[pa.RecordBatch, pa.Array], Iterator[tuple[np.ndarray, list[pa.Array]]]]) -> DataFrame:
    """Columns `keep`, then what `run` makes of each batch's `column`: the rows that it takes, and arrays for these."""
    rows = blocks.select(*keep, column)
    schema = T.StructType([rows.schema[c] for c in keep] + T._parse_datatype_string(added).fields)
    names = schema.fieldNames()

    def mapped(batches: Batches) -> Batches:
        for b in batches:
            for taken, arrays in run(b, b.column(len(keep))):
                at = pa.array(taken)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns[: len(keep)]), *arrays], names)

    return rows.mapInArrow(mapped, schema)


def _exploded(rows: DataFrame, *columns: Column) -> DataFrame:
    """A row for each element `one` of column `some`: Spark's own explode, so that keys aren't repeated between Python and Spark."""
    return rows.select(*KEY, F.explode("some").alias("one")).select(*KEY, *columns)


def histogram(blocks: DataFrame) -> DataFrame:
    """file_id, block_id, byte, cnt: how often each byte that occurs does."""

    def run(b, own):
        rows, byte, n = vectors.byte_counts(own)
        yield np.arange(len(own)), [vectors.lists(rows, byte << 48 | n, len(own), pa.int64())]

    return _exploded(_narrow(blocks, KEY, "own", "some array<long>", run), F.shiftright("one", 48).cast("int").alias("byte"), F.col("one").bitwiseAND(F.lit((1 << 48) - 1)).alias("cnt"))


def required_counts(patterns: DataFrame, id_col: str = "pattern_id", pattern_col: str = "pattern") -> DataFrame:
    """pattern_id, required: how many bytes a byte filter of the pattern asks for; 0 for an empty or null one."""
    rows = patterns.select(F.col(id_col).alias("pattern_id"), F.coalesce(F.col(pattern_col).cast("binary"), F.lit(b"")).alias("pattern"))

    def run(b, pattern):
        yield np.arange(len(pattern)), [pa.array(vectors.distinct_bytes(pattern), pa.int64())]

    return _narrow(rows, ["pattern_id"], "pattern", "required long", run)


def pairs(blocks: DataFrame) -> DataFrame:
    """file_id, block_id, pair: distinct pairs of each block, that across its start included."""

    def run(b, ext):
        yield np.arange(len(ext)), [vectors.lists(*vectors.pairs(ext), len(ext), pa.int32())]

    return _exploded(_narrow(blocks, KEY, "ext", "some array<int>", run), F.col("one").alias("pair"))


def summarize(blocks: DataFrame, config: IndexConfig) -> DataFrame:
    """A row for each block: file_id, block_id, offset, length, bytes_present, pairs (null unless exact), words of the bloom."""
    bits, exact, keep = config.bits, config.exact, [*KEY, "offset", "length", "own"]

    def run(b, ext):
        n = len(ext)
        byte_rows, byte, _ = vectors.byte_counts(b.column(4))
        present = vectors.lists(byte_rows, byte, n, pa.int32())
        found = vectors.lists(*vectors.pairs(ext), n, pa.int32()) if exact else pa.nulls(n, pa.list_(pa.int32()))
        for lo, hi, flags in vectors.flags(ext, vectors.positions(bits), bits):
            yield np.arange(lo, hi), [present[lo:hi], found[lo:hi], vectors.word_lists(vectors.words(flags))]

    return _narrow(blocks, keep, "ext", "bytes_present array<int>, pairs array<int>, words array<long>", run).drop("own")


def bloom_bits(blocks: DataFrame, bits: int) -> DataFrame:
    """file_id, block_id, bit: set bits of each block's bloom."""

    def run(b, ext):
        for lo, hi, rows, at in vectors.bits_set(ext, vectors.positions(bits), bits):
            yield np.arange(lo, hi), [vectors.lists(rows, at, hi - lo, pa.int32())]

    return _exploded(_narrow(blocks, KEY, "ext", "some array<int>", run), F.col("one").cast("long").alias("bit"))


def bloom_words(blocks: DataFrame, bits: int) -> DataFrame:
    """file_id, block_id, word, value: the words (as signed longs) of each block's bloom that aren't 0."""

    def run(b, ext):
        for lo, _, flags in vectors.flags(ext, vectors.positions(bits), bits):
            table = vectors.words(flags)
            rows, at = np.nonzero(table)
            yield rows + lo, [pa.array(at, pa.int64()), pa.array(table[rows, at], pa.int64())]

    return _narrow(blocks, KEY, "ext", "word long, value long", run)


def block_words(blocks: DataFrame, bits: int) -> DataFrame:
    """file_id, block_id, words: all words of each block's bloom in order."""

    def run(b, ext):
        for lo, hi, flags in vectors.flags(ext, vectors.positions(bits), bits):
            yield np.arange(lo, hi), [vectors.word_lists(vectors.words(flags))]

    return _narrow(blocks, KEY, "ext", "words array<long>", run)


def blocked_words(blocks: DataFrame, bits: int) -> DataFrame:
    """file_id, block_id, words: each block's line-blocked bloom, eight words to a line."""
    lines, _ = line_count(bits)

    def run(b, ext):
        for lo, hi, flags in vectors.flags(ext, vectors.line_positions(lines), lines * 512):
            yield np.arange(lo, hi), [vectors.word_lists(vectors.words(flags))]

    return _narrow(blocks, KEY, "ext", "words array<long>", run)


def blocked_bits(blocks: DataFrame, bits: int) -> DataFrame:
    """file_id, block_id, line, bit: set bits of each block's line-blocked bloom."""
    lines, _ = line_count(bits)

    def run(b, ext):
        for lo, hi, rows, at in vectors.bits_set(ext, vectors.line_positions(lines), lines * 512):
            yield np.arange(lo, hi), [vectors.lists(rows, at, hi - lo, pa.int32())]

    one = F.col("one")
    return _exploded(_narrow(blocks, KEY, "ext", "some array<int>", run), F.shiftright(one, 9).cast("long").alias("line"), one.bitwiseAND(511).cast("long").alias("bit"))


def file_words(blocks: DataFrame, bits: int) -> DataFrame:
    """file_id, words: the union of a file's blooms. A task unites what it has of a file in a row, so few rows are shuffled."""
    rows = blocks.select("file_id", "ext")
    schema = T.StructType([rows.schema["file_id"]]).add("words", T.ArrayType(T.LongType()))

    def run(batches: Batches) -> Batches:
        last, held = None, None
        for b in batches:
            ids = b.column(0)
            for lo, hi, flags in vectors.flags(b.column(1), vectors.positions(bits), bits):
                table, own = vectors.words(flags), ids[lo:hi]
                heads = np.concatenate(([0], 1 + np.flatnonzero(np.asarray(pc.not_equal(own[1:], own[:-1]).fill_null(True)))))
                united = np.bitwise_or.reduceat(table, heads, axis=0)
                names = own.take(pa.array(heads))
                if last is not None and names[0].equals(last[0]):
                    united[0] |= held[0]
                elif last is not None:
                    yield pa.RecordBatch.from_arrays([last, vectors.word_lists(held)], ["file_id", "words"])
                if len(names) > 1:
                    yield pa.RecordBatch.from_arrays([names[:-1], vectors.word_lists(united[:-1])], ["file_id", "words"])
                last, held = names[-1:], united[-1:]
        if last is not None:
            yield pa.RecordBatch.from_arrays([last, vectors.word_lists(held)], ["file_id", "words"])

    parts = rows.mapInArrow(run, schema).groupBy("file_id").agg(F.collect_list("words").alias("parts"))  # as many as tasks have of the file
    either = lambda x, y: F.zip_with(x, y, lambda a, b: a.bitwiseOR(b))
    first = F.col("parts")[0]
    return parts.select("file_id", F.when(F.size("parts") == 1, first).otherwise(F.aggregate("parts", first, either)).alias("words"))


def stats(blocks: DataFrame, config: IndexConfig) -> DataFrame:
    """file_id, total_bytes_used, exact_bytes, avg_fpr_per_block, cache_efficiency. The first leaves exact tables out."""
    bits = config.bits

    def run(b, ext):
        for lo, hi, flags in vectors.flags(ext, vectors.positions(bits), bits):
            fill = flags.sum(axis=1) / bits
            yield np.arange(lo, hi), [pa.array(fill * fill * fill, pa.float64())]

    rate = _narrow(blocks, ["file_id"], "ext", "rate double", run)
    return rate.groupBy("file_id").agg((F.count("*") * (bits // 8 + 1024)).alias("total_bytes_used"), (F.count("*") * (8192 if config.exact else 0)).alias("exact_bytes"), F.avg("rate").alias("avg_fpr_per_block"), F.lit(L1_BYTES / (bits / 8)).alias("cache_efficiency"))


def point(summary: DataFrame, file_id, block_id: int) -> DataFrame:
    """One block's row; an error when read if there is none. The filter reaches the scan."""
    from ..config import InvalidBlockId

    found = summary.where((F.col("file_id") == F.lit(file_id)) & (F.col("block_id") == block_id))
    if not found.limit(1).count():
        raise InvalidBlockId(f"no block {block_id} in file {file_id}")
    return found
