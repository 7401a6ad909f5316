"""Sharding by a minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARDS = 40
#: Bytes that count for each row besides its text.
ROW_BYTES = 16
#: Prefix sums that the driver learns in one round.
KNOTS = 40_000


@dataclass
class Ends:
    """What the driver knows of the groups' ends, which are prefix sums of their sizes: a bounded number of them.

    The stretch before end i is solid if no other group ends inside it. Where it isn't, a greedy cut may lie anywhere
    from the end before it (pessimistic) to the very position asked for (optimistic).
    """

    ends: list[int]
    solid: list[bool]
    asked: set[int] = field(default_factory=set)

    def cut(self, position: int, hopeful: bool) -> int:
        """The last end at or before position, as far as known."""
        k = bisect.bisect_right(self.ends, position)
        low = self.ends[k - 1] if k else 0
        if k == len(self.ends) or self.solid[k] or position == low:
            return low
        self.asked.add(k)
        return position if hopeful else low

    def greedy(self, cap: int, shards: int, hopeful: bool) -> bool:
        """Whether shards of at most cap hold everything, each filled as far as it goes."""
        at, total = 0, self.ends[-1]
        for _ in range(shards):
            if at >= total:
                break
            to = self.cut(at + cap, hopeful)
            if to <= at:
                return False
            at = to
        return at >= total

    def smallest(self, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest feasible capacity."""
        lo, hi = -(-self.ends[-1] // shards), self.ends[-1]
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.greedy(mid, shards, hopeful) else (mid + 1, hi)
        return lo

    def learn(self, found: dict[int, list[tuple[int, int]]]) -> None:
        """found: for stretches asked for, ends in order, each with the number of groups since the one before."""
        ends, solid = [], []
        for k, (e, s) in enumerate(zip(self.ends, self.solid)):
            for x, n in found.get(k, ()):
                if x < e:
                    ends.append(x)
                    solid.append(n == 1)
                else:  # the stretch's own end, which is always a group's
                    s = n == 1
            ends.append(e)
            solid.append(s)
        self.ends, self.solid = ends, solid
        self.asked = set()


def minimax(total: int, shards: int, fetch: Callable[[list[tuple[int, int]], int], Iterator[tuple[int, int, int, int, int]]], knots: int = KNOTS) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the cuts of shards under it.

    fetch(stretches, buckets) looks at groups whose ends lie in a stretch (low, high]: it cuts each stretch into
    buckets of equal width and gives, of each bucket with groups, its stretch, bucket, first and last end and number of groups.
    Each round looks more closely at those stretches only in which the search still depends on unknown ends.
    """
    known = Ends([total], [False])

    def look() -> None:
        asked = sorted(known.asked)
        stretches = [(known.ends[k - 1] if k else 0, known.ends[k]) for k in asked]
        found: dict[int, list[tuple[int, int]]] = {}
        for s, _, low, high, n in sorted(fetch(stretches, max(2, knots // len(stretches)))):
            own = found.setdefault(asked[s], [])
            own.append((low, 1))
            if n > 1:
                own.append((high, n - 1))
        known.learn(found)

    while True:
        known.asked = set()
        cap = known.smallest(shards, hopeful=False)
        low = known.smallest(shards, hopeful=True)
        if low == cap:
            break
        known.asked = set()
        for c in (low, cap):  # what the true capacity's greedy cuts can touch
            known.greedy(c, shards, True)
            known.greedy(c, shards, False)
        between = _between(known, low, cap, shards)
        known.asked |= between if len(between) <= knots else set()
        look()
    while True:
        known.asked = set()
        cuts = _balanced(known, cap, shards)
        if not known.asked:
            return cap, cuts
        look()


def _between(known: Ends, low: int, cap: int, shards: int) -> set[int]:
    """Open stretches between the k-th cut of the smaller and that of the larger capacity."""
    out: set[int] = set()
    a = b = 0
    for _ in range(shards):
        a, b = known.cut(a + low, False), known.cut(b + cap, True)
        for k in range(bisect.bisect_left(known.ends, a), min(len(known.ends), bisect.bisect_left(known.ends, b) + 1)):
            if not known.solid[k]:
                out.add(k)
    return out


def _balanced(known: Ends, cap: int, shards: int) -> list[int]:
    """Ends at which to cut: as near to equal shares of what is left as the capacity allows, no shard over it.

    A share leaves out groups that are larger than it by themselves (fewer than shards), as these take a shard each.
    """
    total, cuts, at = known.ends[-1], [], 0
    backward = _latest_needed(known, cap, shards)
    for k in range(shards - 1):
        left = shards - k
        share = _share(known, at, left)
        low = max(at, backward[k])  # the rest must fit into the shards after this one
        target = max(low, min(at + cap, at + share))
        before = known.cut(target, False)
        after_at = bisect.bisect_right(known.ends, target)
        after = known.ends[after_at] if after_at < len(known.ends) else total
        near = [e for e in (before, after) if low <= e <= at + cap and e >= at]
        at = min(near, key=lambda e: (abs(e - (at + share)), e)) if near else known.cut(at + cap, False)
        cuts.append(at)
    return [*cuts, total]


def _share(known: Ends, at: int, left: int) -> int:
    """An equal share of what follows, large groups and their shards left out."""
    ends, solid = known.ends, known.solid
    first = bisect.bisect_right(ends, at)
    sizes = sorted((ends[k] - max(at, ends[k - 1] if k else 0) for k in range(first, len(ends)) if solid[k]), reverse=True)[:left]
    rest = ends[-1] - at
    for size in sizes:
        if left > 1 and size * left > rest:
            rest, left = rest - size, left - 1
        else:
            break
    return -(-rest // left)


def _latest_needed(known: Ends, cap: int, shards: int) -> list[int]:
    """For each cut, the smallest end from which the shards after it can hold the rest."""
    out, at = [0] * shards, known.ends[-1]
    for k in range(shards - 2, -1, -1):
        if at > 0:
            need = max(0, at - cap)
            i = bisect.bisect_left(known.ends, need)
            low = known.ends[i - 1] if i else 0
            if need > low and not known.solid[i]:
                known.asked.add(i)
            at = 0 if need == 0 else known.ends[i]
        out[k] = at
    return out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and bytes and rows up to and with each row in it."""
    from pyspark import TaskContext

    part, size, rows = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        sizes = np.cumsum(np.asarray(b.column(2))) + size
        n = b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * n, pa.int64()), pa.array(sizes), pa.array(np.arange(rows + 1, rows + n + 1))], [*b.schema.names, "part", "bytes_in", "rows_in"])
            size, rows = int(sizes[-1]), rows + n


def shard(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES, id_col: str = "doc_id", text_col: str = "text", knots: int = KNOTS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs.

    Rows of equal texts (equal SHA-256) are a group and stay together, however large. Groups are ordered by their
    smallest id (ids are integers), rows in a group by id (null ids first, each null or repeated id as it comes). Cuts between groups make
    the largest shard as small as it can be; below that, sizes are as equal as cuts allow. Null texts count as empty.
    Shards are numbered from 0 and may be empty if there are fewer groups than shards. slot counts a shard's rows from 0.

    Hot groups: a group's rows are sorted over several partitions. The driver gets one row for each partition and
    `knots` prefix sums a round, never sizes of all groups.
    """
    text = common.texts(docs, text_col)
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + row_bytes).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("sha"))
    keys = common.stored(keys, "sizes")
    least = -(2**63)
    groups = common.stored(keys.groupBy("sha").agg(F.min(F.coalesce("doc_id", F.lit(least))).alias("first"), F.count("*").alias("rows")), "groups")
    joined = common.join_hot(keys, groups, "sha", "rows", keys.count())
    order = ["first", "sha", "doc_id"]
    rows = joined.select("doc_id", "text_crc32", "size", "first", "sha").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = common.stored(rows.mapInArrow(common.releasing(_running), "doc_id long, text_crc32 long, size long, first long, sha binary, part long, bytes_in long, rows_in long"), "ordered")
    bytes_before, rows_before, total = {}, {}, 0
    n_rows = 0
    for r in rows.groupBy("part").agg(F.max("bytes_in").alias("b"), F.max("rows_in").alias("r")).orderBy("part").collect():
        bytes_before[r.part], rows_before[r.part] = total, n_rows
        total, n_rows = total + r.b, n_rows + r.r
    spark = docs.sparkSession
    if not n_rows:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    offsets = spark.createDataFrame([(p, bytes_before[p], rows_before[p]) for p in bytes_before], "part long, bytes_before long, rows_before long")
    rows = rows.join(F.broadcast(offsets), "part").select("*", (F.col("bytes_in") + F.col("bytes_before")).alias("end"), (F.col("rows_in") + F.col("rows_before")).alias("row"))
    ends = common.stored(rows.groupBy("first", "sha").agg(F.max("end").alias("end"), F.max("row").alias("last_row")).select("end", "last_row"), "ends")

    def fetch(stretches: list[tuple[int, int]], buckets: int) -> list[tuple[int, int, int, int, int]]:
        inside = _placed(ends, stretches)
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("end") - F.col("lo") - 1) / F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo")) / F.lit(float(buckets)))))
        return [tuple(r) for r in inside.groupBy("k", bucket.alias("bucket")).agg(F.min("end"), F.max("end"), F.count("*")).collect()]

    _, cuts = minimax(total, shards, fetch, knots)
    inner = sorted(set(cuts[:-1]))
    first_rows = {0: 0, total: n_rows} | {r.end: r.last_row for r in ends.where(F.col("end").isin(inner)).collect()}
    at = F.array(*map(F.lit, cuts))
    number = F.aggregate(at, F.lit(0), lambda n, c: n + F.when(F.col("end") > c, 1).otherwise(0))
    starts = F.array(*[F.lit(first_rows[c]).cast("long") for c in [0, *cuts[:-1]]])
    # a row's own end may lie before its group's, but never at or before the cut that the group follows
    return rows.withColumn("shard", number.cast("int")).select("doc_id", "size", "text_crc32", "shard", (F.col("row") - 1 - F.element_at(starts, F.col("shard") + 1)).alias("slot"))


def _placed(ends: DataFrame, stretches: list[tuple[int, int]]) -> DataFrame:
    """Each end with its stretch, found by binary search in a broadcast list of bounded length."""
    lows, highs = np.array([s[0] for s in stretches]), np.array([s[1] for s in stretches])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(0))
            k = np.searchsorted(lows, x, "left") - 1
            ok = (k >= 0) & (x <= highs[k])
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(k[ok]), pa.array(lows[k[ok]]), pa.array(highs[k[ok]])], ["end", "k", "lo", "hi"])

    return ends.select("end").mapInArrow(common.releasing(place), "end long, k long, lo long, hi long")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_sharding": op3_sharding}
ORACLES: dict[str, str] = {}
