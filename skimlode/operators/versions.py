"""An index in versions: changes come as new data folders and lists of files gone, and a log entry makes them seen at once.

Folder: data/<name> (summaries of blocks), gone/<name> (file_id), log/<version>.json. A reader takes the entries up to one
version; a block stays unless its file is gone by a later entry than its own. Entries are made by renaming a finished file to
a name that mustn't exist, so of two writers one comes after the other, and a failed write leaves nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EmptyBlockIndex, IndexConfig
from ..storage import make_folder, open_uri
from .segment import segment
from .summary import summarize


@dataclass(frozen=True)
class VersionedIndex:
    spark: SparkSession
    folder: str
    config: IndexConfig

    def _names(self) -> list[str]:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        system = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(where):
            return []
        return sorted(name for s in system.listStatus(where) if (name := s.getPath().getName()).endswith(".json") and not name.startswith((".", "_")))

    def entries(self, version: int | None = None) -> list[dict]:
        """Log entries up to a version (None: the latest), in order. Their number is that of changes, not of files or blocks."""
        out = []
        for name in self._names():
            if version is None or int(name[:-5]) <= version:
                with open_uri(f"{self.folder}/log/{name}", "rb") as f:
                    out.append(json.loads(f.read()))
        return out

    @property
    def version(self) -> int:
        """The latest one; 0 before the first change."""
        return int(names[-1][:-5]) if (names := self._names()) else 0

    def _log(self, entry: dict, after: int | None = None) -> int:
        """Appends an entry; where another writer was faster, after that one's, or (after: the only version it may follow) not at all: 0."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        make_folder(self.spark, f"{self.folder}/log")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(self.folder).toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        while True:
            version = (self.version if after is None else after) + 1
            new = f"{self.folder}/log/_{uuid.uuid4().hex}"
            with open_uri(new, "wb") as f:
                f.write(json.dumps(entry | {"version": version}).encode())
            try:
                context.rename(jvm.org.apache.hadoop.fs.Path(new), jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log/{version:012d}.json"), options)
                return version
            except Exception as e:
                if "FileAlreadyExists" not in str(e):
                    raise
                if after is not None:
                    return 0

    def change(self, files: DataFrame | None = None, gone: DataFrame | None = None, batch: str | None = None) -> int:
        """A new version: files (file_id, data) come, in place of what was there by their ids, and files of `gone` (file_id) go.

        batch: a name of this change; one that the log has already isn't made again, so a repeated attempt changes nothing.
        """
        if batch is not None and (done := [e["version"] for e in self.entries() if e.get("batch") == batch]):
            return done[0]
        entry = {"data": None, "gone": None, "batch": batch}
        if files is not None:
            entry["data"] = f"data/{uuid.uuid4().hex}"
            summarize(segment(files, self.config.block_size), self.config).write.parquet(f"{self.folder}/{entry['data']}")
            come = files.select("file_id")
            gone = come if gone is None else gone.select("file_id").unionByName(come)
        if gone is not None:
            entry["gone"] = f"gone/{uuid.uuid4().hex}"
            gone.select("file_id").distinct().write.parquet(f"{self.folder}/{entry['gone']}")
        return self._log(entry)

    def blocks(self, version: int | None = None) -> DataFrame:
        """Summaries of the blocks of one version, whatever is written meanwhile."""
        entries = self.entries(version)
        parts = [(e["version"], e["data"]) for e in entries if e["data"]]
        if not parts:
            raise EmptyBlockIndex("no version has blocks")

        def united(found: list[tuple[int, str]]) -> DataFrame:
            out = None
            for v, path in found:
                part = self.spark.read.parquet(f"{self.folder}/{path}").withColumn("_version", F.lit(v))
                out = part if out is None else out.unionByName(part)
            return out

        rows = united(parts)
        if not (lists := [(e["version"], e["gone"]) for e in entries if e["gone"]]):
            return rows.drop("_version")
        last = united(lists).groupBy("file_id").agg(F.max("_version").alias("_gone"))
        return rows.join(last, "file_id", "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_version"))).drop("_version", "_gone")

    def compact(self) -> int:
        """A version whose blocks are in one folder, equal to the one before; earlier ones stay readable. Done again where a change came between."""
        while True:
            before = self.version
            entry = {"data": f"data/{uuid.uuid4().hex}", "gone": f"gone/{uuid.uuid4().hex}", "batch": None}
            rows = self.blocks(before)
            rows.write.parquet(f"{self.folder}/{entry['data']}")
            rows.select("file_id").distinct().write.parquet(f"{self.folder}/{entry['gone']}")
            if version := self._log(entry, before):
                return version


def follow(index: VersionedIndex, changed: DataFrame, checkpoint: str, once: bool = True):
    """A query that makes a version of each batch of a stream of changes (file_id, change, data): added, edited or removed.

    Of a file's changes in one batch the last by seq counts. A batch that is repeated after a restart makes no second version.
    """

    def apply(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("file_id").agg(F.max_by(F.struct("change", "data"), "seq").alias("x")).select("file_id", "x.*").persist()
        index.change(latest.where("change IN ('added', 'edited')").select("file_id", "data"), latest.where("change = 'removed'").select("file_id"), batch=f"{checkpoint}#{number}")
        latest.unpersist()

    writer = changed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
