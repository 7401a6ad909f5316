"""Folders that all executors see; what is put there goes when the driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is the whole cluster, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="skimlode-")
    return _own_folders[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A name of its own in the shared folder, not made yet."""
    return delete_on_exit(spark, f"{shared_folder(spark)}/skimlode/{label}-{uuid.uuid4().hex}")


def delete_on_exit(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def open_uri(path: str, mode: str):
    """A binary stream to write ("wb") or a seekable file to read ("rb"), for file: and any address that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if mode == "wb" else system.open_input_file(inner)
