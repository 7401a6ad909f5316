"""Candidates looked at: where patterns truly are, by an Aho-Corasick automaton over candidate ranges only."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DataTooLarge, EmptyPatterns

#: Bytes of all patterns together: an automaton takes some fifty times as much, in every worker.
PATTERN_BYTES = 8 << 20
#: Bytes of a range that are searched at once; the next piece begins where a match could still be going on.
PIECE = 4 << 20


def _automaton(patterns: list[tuple[object, bytes]]) -> tuple[ahocorasick.Automaton, int]:
    """Bytes as characters of the same codes; patterns of equal bytes share an entry."""
    found = ahocorasick.Automaton()
    ids: dict[bytes, list] = {}
    for pattern_id, p in patterns:
        ids.setdefault(p, []).append(pattern_id)
    for p, names in ids.items():
        found.add_word(p.decode("latin-1"), (len(p), names))
    found.make_automaton()
    return found, max(map(len, ids))


def matches(files: DataFrame, ranges: DataFrame, patterns: DataFrame, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, pattern_id, offset: every place in the ranges (file_id, offset, length) at which a pattern (pattern_id, pattern) begins and ends.

    With ranges of strict candidates, merged, these are all places in the files: a true match is in one range. Overlapping
    matches all count; empty and null patterns have none, and no pattern at all is an error. A file's ranges are searched
    where its bytes are, piece by piece; files without a range aren't met. Patterns are broadcast: PATTERN_BYTES at most.
    """
    rows = patterns.where(F.length("pattern") > 0).select("pattern_id", F.col("pattern").cast("binary").alias("pattern"))
    if (size := rows.agg(F.sum(F.length("pattern"))).first()[0] or 0) > PATTERN_BYTES:
        raise DataTooLarge(f"patterns of {size} bytes; {PATTERN_BYTES} are the most")
    if not size:
        raise EmptyPatterns("nothing to look for")
    shared = files.sparkSession.sparkContext.broadcast([(r.pattern_id, bytes(r.pattern)) for r in rows.collect()])
    held: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not held:  # once for each worker
            held.append(_automaton(shared.value))
        automaton, longest = held[0]
        for b in batches:
            at, names, offsets = [], [], []
            for i in range(b.num_rows):
                data = memoryview(b.column(1)[i].as_buffer())
                for r in b.column(2)[i].as_py():
                    start, stop = r["offset"], min(len(data), r["offset"] + r["length"])
                    for lo in range(start, stop, PIECE):
                        # a piece goes on by what a match that begins in it can need; those that begin later are the next one's
                        text = bytes(data[lo : min(stop, lo + PIECE + longest - 1)]).decode("latin-1")
                        for end, (n, ids) in automaton.iter(text):
                            if (begin := end - n + 1) < PIECE:
                                at += [i] * len(ids)
                                names += ids
                                offsets += [lo + begin] * len(ids)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pattern_type), pa.array(offsets, pa.int64())], ["file_id", "pattern_id", "offset"])

    data = files.select(F.col(id_col).alias("file_id"), F.col(data_col).cast("binary").alias("data"))
    listed = ranges.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((data, "file_id"), (rows, "pattern_id"))]
    pattern_type = pa.int64() if kinds[1] in ("bigint", "int") else pa.string()
    return data.join(listed, "file_id").mapInArrow(run, f"file_id {kinds[0]}, pattern_id {'bigint' if pattern_type == pa.int64() else 'string'}, offset long")
