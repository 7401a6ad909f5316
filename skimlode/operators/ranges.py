"""Candidate ranges: merging and selectivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_adjacent(ranges: DataFrame) -> DataFrame:
    """file_id, offset, length: ranges that begin where the one before ends are one; so are equal ones in a row.

    Overlapping ranges stay apart. Ranges are taken in order of offset.
    """
    w = Window.partitionBy("file_id").orderBy("offset", "length")
    before = F.lag(F.struct((F.col("offset") + F.col("length")).alias("end"), "offset", "length")).over(w)
    joins = (F.col("offset") == before["end"]) | ((F.col("offset") == before["offset"]) & (F.col("length") == before["length"]))
    rows = ranges.select("file_id", "offset", "length").withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w))
    return rows.groupBy("file_id", "island").agg(F.min("offset").alias("offset"), (F.max(F.col("offset") + F.col("length")) - F.min("offset")).alias("length")).select("file_id", "offset", "length")


def selectivity(ranges: DataFrame, meta: DataFrame) -> DataFrame:
    """file_id, selectivity: the candidates' share of each file, 0 for files without any or without bytes."""
    found = ranges.groupBy("file_id").agg(F.sum("length").alias("found"))
    joined = meta.select("file_id", "total_len").join(found, "file_id", "left")
    return joined.select("file_id", F.when(F.col("total_len") > 0, F.coalesce("found", F.lit(0)) / F.col("total_len")).otherwise(F.lit(0.0)).alias("selectivity"))
