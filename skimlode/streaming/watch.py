"""Directories watched: what changed between two listings, and an index that grows with a stream of files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataTooLarge, IndexConfig
from ..operators.maintain import BlockIndex, build
from ..operators.segment import segment
from ..operators.summary import summarize


#: Bytes of changed files that are indexed at once: fixed value.
MAX_CHANGED = 16 << 30


@dataclass(frozen=True)
class WatchConfig:
    """Defaults are fixed values of the directory watcher."""

    index: IndexConfig = IndexConfig(4096, 1024)
    interval_seconds: int = 5
    max_file_bytes: int = 256 << 20


def listing(spark: SparkSession, root: str, config: WatchConfig = WatchConfig()) -> DataFrame:
    """path, modified, length of all files below root up to the largest size; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= config.max_file_bytes).select("path", F.col("modificationTime").alias("modified"), "length")


def changes(before: DataFrame, after: DataFrame, edits: bool = True) -> DataFrame:
    """path, change: added and removed paths, and (edits) those with another time or length."""
    old, new = before.select("path", *[F.col(c).alias(f"old_{c}") for c in before.columns if c != "path"]), after
    parts = new.join(old, "path", "left_anti").select("path", F.lit("added").alias("change")).unionByName(old.join(new, "path", "left_anti").select("path", F.lit("removed").alias("change")))
    if edits and {"modified", "length"} <= set(before.columns):
        both = new.join(old, "path").where((F.col("modified") != F.col("old_modified")) | (F.col("length") != F.col("old_length")))
        parts = parts.unionByName(both.select("path", F.lit("edited").alias("change")))
    return parts


@dataclass(frozen=True)
class Watcher:
    """A directory and the listings of it that are kept, numbered from 1; a poll compares a new one with the last.

    A listing counts once it is written whole, so after a stop the next poll tells all that has happened since the last whole one.
    """

    spark: SparkSession
    root: str
    kept: str
    config: WatchConfig = WatchConfig()

    def _path(self, number: int) -> str:
        return f"{self.kept}/{number:012d}"

    @property
    def last(self) -> int:
        """The number of the latest listing; 0 before the first poll."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        where = fs.Path(self.kept)
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return 0
        names = [s.getPath().getName() for s in system.listStatus(where) if system.exists(fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def listed(self, number: int) -> DataFrame:
        """path, modified, length as of a poll; nothing as of poll 0."""
        schema = "path string, modified timestamp, length long"
        return self.spark.read.schema(schema).parquet(self._path(number)) if number else self.spark.createDataFrame([], schema)

    def changed(self, number: int) -> DataFrame:
        """number, path, change: what a poll has found."""
        return changes(self.listed(number - 1), self.listed(number)).select(F.lit(number).cast("long").alias("number"), "path", "change")

    def poll(self) -> tuple[int, DataFrame]:
        """Keeps a new listing: its number, and changed() of it. Files are listed, not read."""
        number = self.last + 1
        listing(self.spark, self.root, self.config).write.mode("overwrite").parquet(self._path(number))
        return number, self.changed(number)


def read_files(spark: SparkSession, paths: DataFrame, config: WatchConfig = WatchConfig(), most: int = MAX_CHANGED) -> DataFrame:
    """file_id (the path) and data of the files named in `paths`; too many bytes together are an error. Absent files are left out.

    Spark plans scans of files by a list of them on the driver, so the changed paths come there (not the files).
    """
    names = [r.path for r in paths.select("path").distinct().toLocalIterator()]
    if not names:
        return spark.createDataFrame([], "file_id string, data binary")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(names).where(F.col("length") <= config.max_file_bytes)
    if (files.agg(F.sum("length")).first()[0] or 0) > most:
        raise DataTooLarge(f"more than {most} bytes have changed")
    return files.select(F.col("path").alias("file_id"), F.col("content").alias("data"))


def apply_changes(index: BlockIndex, changed: DataFrame, files: DataFrame) -> BlockIndex:
    """The index after a change set: removed and edited files go, added and edited ones come as `files` has them."""
    gone = changed.where(F.col("change").isin("removed", "edited")).select(F.col("path").alias("file_id"))
    come = changed.where(F.col("change").isin("added", "edited")).select(F.col("path").alias("file_id"))
    new = build(files.join(come, "file_id", "left_semi"), index.config)
    keep = lambda df: df.join(gone, "file_id", "left_anti")
    return BlockIndex(index.config, keep(index.blocks).unionByName(new.blocks), keep(index.files).unionByName(new.files))


def index_stream(spark: SparkSession, root: str, out: str, checkpoint: str, config: WatchConfig = WatchConfig(), once: bool = True):
    """A query that appends the summaries of new files below root to Parquet at out; each file is read once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= config.max_file_bytes)
    blocks = summarize(segment(files.select(F.col("path").alias("file_id"), F.col("content").alias("data")), config.index.block_size), config.index)
    writer = blocks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{config.interval_seconds} seconds")).start()
