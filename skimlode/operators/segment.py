"""Byte columns cut into blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import IndexConfig, UnalignedData


def segment(files: DataFrame, block_size: int, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, block_id, offset, length, own, ext: a row for each block; empty and null data have none.

    ext is the block with the byte before it (if there is one), so that its pairs hold the one across the boundary.
    Narrow: no shuffle.
    """
    IndexConfig(block_size).validate()
    data = F.col("data")
    rows = files.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data")).where(F.length("data") > 0)
    blocks = rows.select("file_id", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length(data) - 1) / block_size))).alias("block_id"))
    offset = F.col("block_id") * block_size
    return blocks.select(
        "file_id", "block_id", offset.alias("offset"), F.least(F.lit(block_size).cast("long"), F.length(data) - offset).alias("length"),
        F.substring(data, (offset + 1).cast("int"), F.lit(block_size)).alias("own"),
        F.substring(data, F.greatest(offset, F.lit(1)).cast("int"), F.lit(block_size) + F.when(F.col("block_id") > 0, 1).otherwise(0)).alias("ext"),
    )


def from_blocks(blocks: DataFrame, block_size: int, strict: bool = True) -> DataFrame:
    """The same from blocks that come as rows (file_id, block_id, own): the byte before comes from the row before.

    strict: every block must have exactly block_size bytes; one that hasn't is an error when the row is read.
    """
    IndexConfig(block_size).validate()
    w = Window.partitionBy("file_id").orderBy("block_id")
    own = F.col("own")
    if strict:
        own = F.when(F.length("own") == block_size, own).otherwise(F.raise_error(F.lit(f"{UnalignedData.__name__}: a block has not {block_size} bytes")))
    last = F.lag(F.substring("own", -1, 1)).over(w)
    rows = blocks.select("file_id", "block_id", own.alias("own"))
    return rows.select("file_id", "block_id", (F.col("block_id") * block_size).alias("offset"), F.length("own").cast("long").alias("length"), "own", F.concat(F.coalesce(last, F.lit(b"")), "own").alias("ext"))


def candidate_of(block_id, total_len, block_size: int):
    """A block's range as a struct, null if it lies beyond the data."""
    offset = block_id * block_size
    length = F.least(F.lit(block_size), total_len - offset)
    return F.when(length > 0, F.struct(offset.alias("offset"), length.alias("length")))


def metadata(files: DataFrame, block_size: int, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    data = F.coalesce(F.col(data_col).cast("binary"), F.lit(b""))
    return files.select(F.col(id_col).alias("file_id"), F.length(data).cast("long").alias("total_len"), F.ceil(F.length(data) / block_size).alias("n_blocks"), F.when(F.length(data) > 0, F.substring(data, 1, 1)).alias("first_byte"), F.when(F.length(data) > 0, F.substring(data, -1, 1)).alias("last_byte"))
