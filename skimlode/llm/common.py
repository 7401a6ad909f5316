"""What the operators share: intermediate tables, Arrow helpers and a join that survives hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key that holds at least one row in HOT_SHARE is joined by broadcast; at most HOT_SHARE keys can.
HOT_SHARE = 1000
#: Bits of a filter of ids: 4 MB.
ID_BITS = 1 << 25
#: Groups of more bytes make their worker release what it holds free.
RELEASED_BYTES = 1 << 20

_WRITING = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Of a write to file: paths only: no checksum file beside each part. Without Hadoop's native library each of the two would
#: have its permissions set by processes that the executor starts, and such a child counts as large as its parent for a moment.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see (spark.checkpoint.dir); one of this machine only where that is the whole cluster, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", ""):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="skimlode-")
    return _own_folders[app]


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/skimlode/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextlib.contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """Settings of one write: small Arrow batches, and its shuffle files go when it has ended. Then the session's own hold again."""
    held = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str, files: int | None = None) -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends, and lost executors lose nothing. files: the most there are, for few rows."""
    path = new_folder(spark := df.sparkSession, label)
    with _writing(spark):
        (df.coalesce(files) if files else df).write.options(**_PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, label: str, column: str, buckets: int) -> Iterator[DataFrame]:
    """The same, dealt out to buckets by a column, so that joins on it don't shuffle these rows again; to be used inside `with`."""
    path, name = new_folder(spark := df.sparkSession, label), f"skimlode_{label}_{uuid.uuid4().hex}"
    with _writing(spark):
        df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its name only: the files stay until the driver ends


def texts(df: DataFrame, text_col: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows, for this session: texts are long, and batches are held on both sides of each worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def _release() -> None:
    """What this worker holds free goes back to the system: workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def releasing(run):
    """The same map function; when a task ends, its worker's free memory is released."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _release()

    return wrapped


def releasing_group(run):
    """The same for a function of a key and a group; small groups leave nothing worth releasing."""

    def wrapped(key, table):
        out = run(key, table)
        if table.nbytes > RELEASED_BYTES:
            _release()
        return out

    return wrapped


def id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter of ID_BITS bits, whatever the number of ids: tasks' filters are united along a tree."""

    def own(batches):
        from pyspark import TaskContext

        flags = np.zeros(ID_BITS, bool)
        for b in batches:
            for at in _id_places(np.asarray(b.column(0))):
                flags[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([zlib.compress(np.packbits(flags).tobytes(), 1)], pa.binary())], ["node", "bits"])

    def unite(key, table):
        out = np.zeros(ID_BITS // 8, np.uint8)
        for x in table.column("bits").to_pylist():
            out |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    ids = ids.select(F.col(column).cast("long"))
    parts, left = ids.mapInArrow(releasing(own), "node long, bits binary"), ids.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // 16)
        parts = parts.withColumn("node", F.lit(0).cast("long") if left <= 1 else F.floor(F.col("node") / 16)).groupBy("node").applyInArrow(releasing_group(unite), "node long, bits binary")
    found = parts.collect()  # one row, or none
    return np.frombuffer(zlib.decompress(bytes(found[0].bits)), np.uint8) if found else np.zeros(ID_BITS // 8, np.uint8)


def _id_places(ids: np.ndarray) -> list[np.ndarray]:
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - ID_BITS.bit_length() + 1)
    return [(mixed >> shift).astype(np.int64), ((mixed << np.uint64(27)) >> shift).astype(np.int64)]


def in_bits(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be among those of the filter; those that are surely may."""
    out = np.ones(len(ids), bool)
    for at in _id_places(ids):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return out


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_field(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def pieces(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive rows that hold about `most` bytes together, one row at least."""
    ends = np.cumsum(np.asarray(pc.binary_length(values).fill_null(0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join on a key that is unique in `right`, where column `size` of `right` counts the key's rows in `left`.

    Keys with total / HOT_SHARE rows or more number HOT_SHARE at most, so they are broadcast;
    the rest is an ordinary shuffled join without any hot key.
    """
    is_hot = F.col(size) * HOT_SHARE >= total
    hot, cold = right.where(is_hot), right.where(~is_hot)
    few = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return few.unionByName(rest)


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    """Whether ids name rows: none is null or repeated. Only the ids are read."""
    ids = docs.select(F.col(id_col).alias("id"))
    repeated = ids.groupBy("id").count().where("count > 1 OR id IS NULL")
    return not repeated.limit(1).count()


def uri_open(path: str, mode: str):
    """A binary stream to write ("wb") or a seekable file to read ("rb"), for file: and any URI that pyarrow knows."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if mode == "wb" else system.open_input_file(inner)


def uri_delete(path: str) -> None:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else "file:///" + path.removeprefix("file:").lstrip("/"))
    system.delete_file(inner)


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
