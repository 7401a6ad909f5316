"""Exact dedup: sorted runs of digests, merged along a binomial tree, one verified entry for each text at every level."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: White space that equality ignores: fixed by the contract.
BLANK = b" \t\n\v\f\r"
#: Binomial rounds that one exchange does at once: 2 ** ROUND_BITS runs meet in each node.
ROUND_BITS = 3
#: Rows of a digest range at most, on average.
RANGE_ROWS = 400_000
_NO_ID = np.iinfo(np.int64).max
ENTRY = np.dtype([("digest", ">u8", 4), ("chars", "<i8"), ("doc_id", "<i8"), ("row", "<i8"), ("rows", "<i8")])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row number, doc_id, text -> row number, doc_id, code points of the text, SHA-256 of the text without white space."""
    for b in batches:
        out, chars = [], pc.utf8_length(b.column(2)).fill_null(0)
        for t in b.column(2).cast(pa.binary()):
            out.append(hashlib.sha256((t.as_py() or b"").translate(None, BLANK)).digest())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), chars.cast(pa.int64()), pa.array(out, pa.binary())], ["_row", "doc_id", "chars", "digest"])


def sorted_run(parts: list[np.ndarray]) -> np.ndarray:
    """Entries in any order as a sorted run: of those whose whole digests agree, that with most characters, then the smallest id, then row, stays and counts all rows."""
    all_ = np.concatenate(parts).astype(ENTRY, copy=False)  # joining makes the byte order the machine's
    d = all_["digest"].astype(np.uint64)
    order = np.lexsort((all_["row"], all_["doc_id"], -all_["chars"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))
    all_, d = all_[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]).any(axis=1))))
    out = all_[first].copy()
    out["rows"] = np.add.reduceat(all_["rows"], first)
    return out


def _merged_two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted runs as one: the places of b's entries are searched in a, and where whole digests agree the better one stays."""
    left, right = (np.ascontiguousarray(x["digest"]).view("S32").ravel() for x in (a, b))
    at = np.searchsorted(left, right)
    same = at < len(a)
    same[same] = left[at[same]] == right[same]
    out, i, y = a.copy(), at[same], b[same]
    x = a[i]
    better = (y["chars"] > x["chars"]) | (y["chars"] == x["chars"]) & ((y["doc_id"] < x["doc_id"]) | (y["doc_id"] == x["doc_id"]) & (y["row"] < x["row"]))
    out[i[better]] = y[better]
    out["rows"][i] = x["rows"] + y["rows"]
    return np.insert(out, at[~same], b[~same]).astype(ENTRY, copy=False)


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Multiway merge of sorted runs, without sorting them again: neighbours meet in rounds until one is left."""
    while len(runs) > 1:
        runs = [_merged_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def _first_runs(ranges: int):
    """Each partition's sorted run, cut at the bounds of the digest ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, parts, held = TaskContext.get().partitionId(), [], 0
        for b in batches:
            e = np.zeros(b.num_rows, ENTRY)
            e["digest"] = np.frombuffer(b"".join(b.column(3).to_pylist()), ">u8").reshape(-1, 4)
            e["chars"], e["doc_id"], e["row"], e["rows"] = b.column(2), b.column(1).fill_null(_NO_ID), b.column(0), 1
            parts.append(e)
            held += len(e)
            if held > 2_000_000:  # bounded memory whatever the partition holds: a run ends here
                yield from _cut(sorted_run(parts), ranges, node)
                parts, held = [], 0
        if held:
            yield from _cut(sorted_run(parts), ranges, node)

    return run


def _cut(run: np.ndarray, ranges: int, node: int) -> Iterator[pa.RecordBatch]:
    at = (run["digest"][:, 0].astype(np.uint64) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1, [len(run)]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(at[edges[:-1]].astype(np.int64)), pa.array([node] * (len(edges) - 1), pa.int64()), pa.array([run[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["range", "node", "run"]
    )


def _meet(key, table):
    run = merged([np.frombuffer(x, ENTRY) for x in table.column("run").to_pylist()])
    return pa.table({"range": [key[0].as_py()], "node": pa.array([key[1].as_py()], pa.int64()), "run": pa.array([run.tobytes()], pa.binary())})


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column("run"):
            e = np.frombuffer(x.as_py(), ENTRY)
            raw = np.ascontiguousarray(e["digest"]).tobytes()
            ids = pa.array(e["doc_id"], mask=e["doc_id"] == _NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()), ids, pa.array(e["row"]), pa.array(e["rows"])], ["digest", "keep_id", "keep_row", "group_size"])


def classes(keys: DataFrame, total: int) -> DataFrame:
    """One row for each digest of keys (_row, doc_id, chars, digest): digest, keep_id, keep_row, group_size.

    A hot text is one entry of each run from the first level on, so no task ever gathers its copies.
    """
    ranges = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    runs, left = keys.mapInArrow(common.releasing(_first_runs(ranges)), "range long, node long, run binary"), keys.rdd.getNumPartitions()
    while True:
        left = -(-left // (1 << ROUND_BITS))
        last = left <= 1
        runs = runs.withColumn("node", F.lit(0).cast("long") if last else F.shiftright("node", ROUND_BITS)).groupBy("range", "node").applyInArrow(common.releasing_group(_meet), "range long, node long, run binary")
        if last:
            return runs.mapInArrow(common.releasing(_entries), "digest binary, keep_id long, keep_row long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: _row, doc_id, digest, keep_id, keep_row, group_size, kept.

    Texts are equal if they are after all white space of BLANK is taken out; null counts as empty, so nulls and blank
    texts form one group. The row with the most code points stays, then that with the smallest id (null ids last;
    the largest 64-bit id counts as null), then the first of repeated rows: exactly one row of each group stays.
    An empty table gives no rows; other columns of docs aren't read. Ids are integers.
    """
    raw = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = common.stored(raw.mapInArrow(common.releasing(digests), "_row long, doc_id long, chars long, digest binary"), "digests")
    total = keys.count()
    groups = common.stored(classes(keys, total), "classes")
    return common.join_hot(keys.drop("chars"), groups, "digest", "group_size", total).withColumn("kept", F.col("_row") == F.col("keep_row"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called; see exact_groups() for which stay.

    Rows are named by their ids if these are unique, else (null or repeated ids) numbered and written, so that just one
    of repeated rows stays. Null, empty and blank texts are one group, of which one row stays; an empty table stays empty.
    """
    if common.unique_ids(docs, id_col):
        raw = docs.select(F.lit(0).cast("long").alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        keys = common.stored(raw.mapInArrow(common.releasing(digests), "_row long, doc_id long, chars long, digest binary"), "digests")
        return docs.join(classes(keys, keys.count()).select(F.col("keep_id").alias(id_col)), id_col, "left_semi").select(*docs.columns)
    row = common.fresh(docs, "_row_of_dedup")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    raw = numbered.select(F.col(row).alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keys = common.stored(raw.mapInArrow(common.releasing(digests), "_row long, doc_id long, chars long, digest binary"), "digests")
    stay = classes(keys, keys.count()).select(F.col("keep_row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": OP2_SQL}
