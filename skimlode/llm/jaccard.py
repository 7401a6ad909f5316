"""Similarity join of documents by word shingles: rare-first prefix filtering, with length, positional and suffix filters.

Documents with equal shingle sets are one class, and classes are joined. First all texts are screened: of each text a
part of the shingles, those with the smallest hashes, is looked up in all other texts' parts, and a text with too few
of them there can't be similar to any. Shingles of the classes that are left are counted exactly, and their rarest ones
propose partners: a prefix shingle that few classes share proposes their pairs, each verified once. One that many share
proposes no pairs: its classes are cut into chunks, the links inside each chunk are found exactly, and then only classes
that are still apart from the bulk meet the rest of it, chunk by chunk. So all links between components are found
without a bucket's pairs ever being listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .brown import FOLD
from .components import components

WORDS, PERCENT = 4, 85
#: Entries that a range of hashes holds on average at most, and those of a run that a task sends at once.
RANGE_ENTRIES, RUN_ENTRIES = 2_000_000, 1_000_000
#: Shingles of a block of sets.
BLOCK_SHINGLES = 1 << 20
#: Bytes of text whose sets a bucket holds on average at most.
BUCKET_BYTES = 256 << 20
#: An owner that stands for several.
MANY = np.uint32(0xFFFFFFFF)
#: Classes of a bucket whose pairs are listed; beyond, the bucket is cut into chunks of so many shingles.
FEW, CHUNK_SHINGLES, CHUNK_CLASSES = 32, 150_000, 512
#: Classes with a shingle above which its bucket is salted.
HOT = 200_000
BATCH_BYTES = 4 << 20
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)
ENTRY = np.dtype([("shingle", "<u8"), ("cls", "V16"), ("size", "<u4"), ("place", "<u4"), ("parts", "u1", 4)])
_LAST = 2**63 - 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


def shingles(text: bytes, n_words: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; with fewer words, of all words as one; none without words."""
    words = text.translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(n_words, len(h))
    count = len(h) - k + 1
    out = np.full(count, k, np.uint64)
    for j in range(k):
        out += h[j : j + count] * _P[j % len(_P)]
        out ^= out >> np.uint64(32)
        out *= _P[-1]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _class(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else b"\0" * 16


def missing(n: int, percent: int) -> int:
    """Of a set of n shingles, how many a similar set may lack at most."""
    return n - -(-percent * n // 100)


def sought(n: int, percent: int) -> int:
    """How many common shingles the screened parts of two similar sets are sure to have, if the smaller set has n."""
    return min(missing(n, percent) + 1, n - missing(n, percent))


def _keys(values: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash in the upper half, and its place there in the lower."""
    mixed = values * _P[0]
    return ((mixed >> np.uint64(32)) * np.uint64(ranges) & ~np.uint64(0xFFFFFFFF)) | (mixed & np.uint64(0xFFFFFFFF))


def _planes(x: np.ndarray) -> bytes:
    """Little-endian 32-bit numbers, byte by byte of all: what is 0 in most of them shrinks when it is compressed."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _cut(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Sorted keys with a value each, as one packed run for each range: the gaps between keys, and the values."""
    place = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)])) if len(place) else np.zeros(1, np.int64)
    low = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return place[edges[:-1]], [_planes(np.diff(low[i:j], prepend=0)) + _planes(values[i:j]) for i, j in zip(edges[:-1], edges[1:])]


def _opened(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(raw) // 2
    return np.cumsum(_numbers(raw[:half]), dtype=np.int64), _numbers(raw[half:])


def _scan(n_words: int, percent: int, ranges: int):
    """Each row's class and size; of runs of rows the classes (as range -1), and what is to be looked up.

    A run sends each hash once, with its owner in the run; one with several owners there is found already (range -2).
    """
    names = ["_row", "doc_id", "cls", "size", "node", "range", "data"]

    def packed(node: int, ranges_, blobs) -> pa.RecordBatch:
        n = len(blobs)
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(n, pa.binary()), none, pa.array([node] * n, pa.int64()), pa.array(ranges_, pa.int64()), pa.array(blobs, pa.binary())], names)

    def ended(node: int, seen: dict, sizes: list, parts: list) -> Iterator[pa.RecordBatch]:
        yield packed(node, [-1], [b"".join(seen) + np.array(list(seen.values()), "<i8").tobytes() + np.array(sizes, "<u4").tobytes()])
        keys = np.concatenate(parts)
        owners = np.repeat(np.arange(len(parts), dtype=np.uint32), [len(p) for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, owners = keys[order], owners[order]
        same = keys[1:] == keys[:-1]
        again = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if again.any():
            yield packed(node, [-2], [_planes(owners[again])])
        first = np.concatenate(([True], ~same))
        where, blobs = _cut(keys[first], np.where(again, MANY, owners)[first])
        for at in range(0, len(blobs), 256):
            yield packed(node, where[at : at + 256], blobs[at : at + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, node, held = _WordHashes(), TaskContext.get().partitionId() << 32, 0
        seen, sizes, parts = {}, [], []
        for b in batches:
            for lo, hi in common.pieces(b.column(2), BATCH_BYTES):
                own_classes, own_sizes = [], []
                for t, doc in zip(b.column(2)[lo:hi], b.column(1)[lo:hi].to_pylist()):
                    own = shingles(t.as_py(), n_words, hashes)
                    own_classes.append(cls := _class(own))
                    own_sizes.append(n := len(own))
                    if n and cls not in seen:
                        seen[cls] = doc
                        sizes.append(n)
                        parts.append(_keys(own[: missing(n, percent) + sought(n, percent)], ranges))
                        held += len(parts[-1])
                n = hi - lo
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(own_classes, pa.binary()), pa.array(own_sizes, pa.int64()), none, none, pa.nulls(n, pa.binary())], names)
                if held > RUN_ENTRIES:
                    yield from ended(node, seen, sizes, parts)
                    seen, sizes, parts, held, node = {}, [], [], 0, node + 1
        if parts:
            yield from ended(node, seen, sizes, parts)

    return common.releasing(run)


def _found_again(key, table):
    """Of a range: for each run the owners whose hashes other runs hold too."""
    nodes = table.column("node").to_pylist()
    opened = [_opened(x) for x in table.column("data").to_pylist()]
    keys = np.concatenate([k for k, _ in opened])
    every, inverse = np.unique(keys, return_inverse=True)
    times = np.bincount(inverse, minlength=len(every))
    shared, blobs, at = times[inverse] > 1, [], 0
    for k, owners in opened:
        hit = owners[shared[at : at + len(k)] & (owners != MANY)]
        at += len(k)
        blobs.append(_planes(hit) if len(hit) else None)
    return pa.table({"node": pa.array(nodes, pa.int64()), "range": pa.array([-2] * len(nodes), pa.int64()), "data": pa.array(blobs, pa.binary())})


def _screened(percent: int):
    """Classes of a run of whose parts enough is found again."""

    def run(key, table):
        heads = [x for r, x in zip(table.column("range").to_pylist(), table.column("data").to_pylist()) if r == -1]
        raw = heads[0]
        n = len(raw) // 28
        docs, sizes = np.frombuffer(raw, "<i8", n, 16 * n), np.frombuffer(raw, "<u4", n, 24 * n)
        hits = np.zeros(n, np.int64)
        for r, x in zip(table.column("range").to_pylist(), table.column("data").to_pylist()):
            if r == -2:
                hits += np.bincount(_numbers(x), minlength=n)
        need = np.array([sought(-(-percent * int(s) // 100), percent) for s in sizes])
        keep = np.flatnonzero(hits >= need).tolist()
        return pa.table({"cls": pa.array([raw[16 * k : 16 * k + 16] for k in keep], pa.binary()), "doc_id": pa.array(docs[keep], pa.int64())})

    return run


def _chosen(shared, n_words: int):
    """doc_id, class and shingles of the rows whose ids may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            wanted = pa.array(np.flatnonzero(common.in_bits(shared.value, np.asarray(b.column(0)))))
            ids, text = b.column(0).take(wanted), b.column(1).take(wanted)
            for lo, hi in common.pieces(text, BATCH_BYTES):
                sets = [shingles(t.as_py(), n_words, hashes) for t in text[lo:hi]]
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(map(_class, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "cls", "shingles"])

    return common.releasing(run)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets, many in a row: their classes, sizes and shingles; a block is named by its classes."""
    names, sets, held = [], [], 0

    def block():
        all_names, sizes = b"".join(names), np.array([len(s) // 8 for s in sets], "<u4").tobytes()
        node = xxhash.xxh3_64_intdigest(all_names) >> 1
        return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([all_names], pa.binary()), pa.array([sizes], pa.binary()), pa.array([b"".join(sets)], pa.binary())], ["node", "names", "sizes", "shingles"])

    for b in batches:
        for cls, own in zip(b.column(0), b.column(1)):
            names.append(cls.as_py())
            sets.append(own.as_py())
            held += len(sets[-1]) // 8
            if held >= BLOCK_SHINGLES:
                yield block()
                names, sets, held = [], [], 0
    if names:
        yield block()


def _block_counts(ranges: int):
    """A block's distinct hashes, each with the number of its sets that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, raw in zip(b.column(0).to_pylist(), b.column(1)):
                where, blobs = _cut(*np.unique(_keys(np.frombuffer(raw.as_py(), np.uint64), ranges), return_counts=True))
                yield pa.RecordBatch.from_arrays([pa.array([node] * len(blobs), pa.int64()), pa.array(where, pa.int64()), pa.array(blobs, pa.binary())], ["node", "range", "data"])

    return common.releasing(run)


def _frequencies(key, table):
    """Of a range: for each block, and each of its hashes in order, the number of all sets that hold it."""
    opened = [_opened(x) for x in table.column("data").to_pylist()]
    every, inverse = np.unique(np.concatenate([k for k, _ in opened]), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([n for _, n in opened]), minlength=len(every))
    ends = np.cumsum([len(k) for k, _ in opened])
    blobs = [_planes(np.minimum(x, 2**32 - 1)) for x in np.split(total[inverse], ends[:-1])]
    return pa.table({"node": table.column("node"), "range": table.column("range"), "data": pa.array(blobs, pa.binary())})


def prefix(own: np.ndarray, often: np.ndarray, percent: int) -> np.ndarray:
    """Places of the shingles of which similar sets share one at least: the rarest ones, rarest first."""
    order = np.lexsort((own, often))
    return order[: missing(len(own), percent) + 1]


def _parts(own: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of four parts, modulo 256: differences bound the sets' difference from below."""
    return np.bincount((own >> np.uint64(62)).astype(np.int64), minlength=4).astype(np.uint8)


def _indexer(ranges: int, percent: int):
    """Prefix entries of each block, as packed runs sorted by shingle, cut by ranges of shingles; hot shingles are salted.

    A prefix shingle that no other set holds proposes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for names, sizes, raw, counts in zip(*(c.to_pylist() for c in b.columns)):
                values = np.frombuffer(raw, np.uint64)
                if counts is None:
                    raise RuntimeError("the sets were read in other blocks than they were counted in")
                counted = np.concatenate([_numbers(x["data"]) for x in sorted(counts, key=lambda x: x["range"])])
                often = counted[np.unique(_keys(values, ranges), return_inverse=True)[1]]
                parts, heat = [], []
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)))
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
                    own, of = values[i:j], often[i:j]
                    first = prefix(own, of, percent)
                    place = np.flatnonzero(of[first] > 1)
                    first = first[place]
                    e = np.empty(len(first), ENTRY)
                    e["shingle"], e["cls"], e["size"], e["place"], e["parts"] = own[first], np.void(names[16 * k : 16 * k + 16]), len(own), place, _parts(own)
                    parts.append(e)
                    heat.append(of[first].astype(np.int64))
                e, heat = np.concatenate(parts), np.concatenate(heat)
                if not len(e):
                    continue
                at = ((e["shingle"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                salt = np.zeros(len(e), np.int64)
                if len(hot := np.flatnonzero(heat > HOT)):
                    spread = np.frombuffer(e["cls"][hot].tobytes(), "<u4").reshape(-1, 4)[:, 0].astype(np.int64)
                    salt[hot] = 1 + spread % (1 + heat[hot] // HOT)
                order = np.lexsort((e["shingle"], salt, at))
                e, at, salt = e[order], at[order], salt[order]
                edges = np.concatenate(([0], np.flatnonzero((np.diff(at) != 0) | (np.diff(salt) != 0)) + 1, [len(e)]))
                yield pa.RecordBatch.from_arrays([pa.array(at[edges[:-1]]), pa.array(salt[edges[:-1]]), pa.array([e[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])], pa.binary())], ["range", "salt", "run"])

    return common.releasing(run)


def _buckets(percent: int):
    """Of a range of shingles: filtered pairs of small buckets, and large buckets' classes by chunk."""

    def run(key, table):
        salt = key[1].as_py()
        e = np.concatenate([np.frombuffer(x, ENTRY) for x in table.column("run").to_pylist()])
        words = np.frombuffer(e["cls"].tobytes(), ">u8").reshape(-1, 2)
        order = np.lexsort((words[:, 1], words[:, 0], e["shingle"]))
        e, words = e[order], words[order]
        new = np.concatenate(([True], (e["shingle"][1:] != e["shingle"][:-1]) | (words[1:] != words[:-1]).any(axis=1)))
        e = e[new]
        heads = np.flatnonzero(np.concatenate(([True], e["shingle"][1:] != e["shingle"][:-1])))
        sizes = np.diff(np.append(heads, len(e)))
        a, b, buckets, chunks, classes, counts, members = [], [], [], [], [], [], []
        for size in np.unique(sizes[sizes > 1]):
            if salt or size > FEW:
                continue
            i, j = np.triu_indices(size, 1)
            at = heads[sizes == size]
            left, right = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            ok = passes(e[left], e[right], percent)
            a.append(e["cls"][left[ok]])
            b.append(e["cls"][right[ok]])
        for at, size in zip(heads, sizes):
            if salt or size > FEW:
                own = e[at : at + size]
                own = own[np.argsort(own["size"], kind="stable")]
                chunk = np.maximum(np.cumsum(own["size"], dtype=np.int64) // CHUNK_SHINGLES, np.arange(size) // CHUNK_CLASSES)
                buckets.append(own["shingle"].view(np.int64))
                chunks.append(chunk + (salt << 32))
                classes.append(own["cls"])
                edges = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [size]))
                marks = [xxhash.xxh3_64_intdigest(np.sort(np.frombuffer(own["cls"][i:j].tobytes(), "S16")).tobytes()) for i, j in zip(edges[:-1], edges[1:])]
                members.append(np.repeat(np.array(marks, np.uint64).view(np.int64), np.diff(edges)))
                counts.append(own["size"].astype(np.int64))
        pairs = np.unique(np.concatenate((np.frombuffer(np.concatenate(a).tobytes(), ">u8").reshape(-1, 2), np.frombuffer(np.concatenate(b).tobytes(), ">u8").reshape(-1, 2)), axis=1), axis=0) if a else np.empty((0, 4), ">u8")
        raw = pairs.astype(">u8").tobytes()
        n_pairs, n_rows = len(pairs), sum(map(len, buckets))
        join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        cls = join(classes).tobytes() if classes else b""
        return pa.table(
            {
                "a": pa.array([raw[32 * k : 32 * k + 16] for k in range(n_pairs)] + [cls[16 * k : 16 * k + 16] for k in range(n_rows)], pa.binary()),
                "b": pa.array([raw[32 * k + 16 : 32 * k + 32] for k in range(n_pairs)] + [None] * n_rows, pa.binary()),
                "bucket": pa.concat_arrays([pa.nulls(n_pairs, pa.int64()), pa.array(join(buckets), pa.int64())]),
                "chunk": pa.concat_arrays([pa.nulls(n_pairs, pa.int64()), pa.array(join(chunks), pa.int64())]),
                "size": pa.concat_arrays([pa.nulls(n_pairs, pa.int64()), pa.array(join(counts), pa.int64())]),
                "members": pa.concat_arrays([pa.nulls(n_pairs, pa.int64()), pa.array(join(members), pa.int64())]),
            }
        )

    return run


def passes(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Length, positional and suffix filter of entries that share a shingle; no similar pair fails at its first common one."""
    nx, ny = x["size"].astype(np.int64), y["size"].astype(np.int64)
    ok = 100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)
    need = -(-percent * (nx + ny) // (100 + percent))
    ok &= 1 + np.minimum(nx - x["place"] - 1, ny - y["place"] - 1) >= need
    apart = (x["parts"] - y["parts"]).view(np.int8).astype(np.int64)
    return ok & (np.abs(apart).sum(axis=1) <= nx + ny - 2 * need)


def _linked(n_x, n_y, common_, percent: int):
    return 100 * common_ >= percent * (n_x + n_y - common_)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for k in range(t.num_rows):
                x, y = np.frombuffer(t.column(2)[k].as_py(), np.uint64), np.frombuffer(t.column(3)[k].as_py(), np.uint64)
                both = np.sort(np.concatenate((x, y)))
                if _linked(len(x), len(y), int(np.count_nonzero(both[1:] == both[:-1])), percent):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(keep, pa.int64())), t.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    return common.releasing(run)


class _Sets:
    """Union-find over a block's classes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def block_links(sets: list[np.ndarray], asking: np.ndarray, percent: int, known: list | None = None) -> list[tuple[int, int]]:
    """Links that join the block's components: every set that asks is held against all others by their common shingles.

    Sets that are already joined, here or by `known` components, need no link.
    """
    n = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    head = np.concatenate(([True], values[1:] != values[:-1]))
    starts = np.flatnonzero(head)
    ends = np.append(starts[1:], len(values))
    run = np.cumsum(head) - 1
    of_set = np.argsort(owner, kind="stable")
    own_runs = np.split(run[of_set], np.cumsum(n)[:-1])
    joined, out = _Sets(len(sets)), []
    if known is not None:
        first: dict = {}
        for i, c in enumerate(known):
            if c is not None and first.setdefault(c, i) != i:
                joined.join(first[c], i)
    for i in asking:
        runs = own_runs[i]
        lengths = ends[runs] - starts[runs]
        at = np.repeat(starts[runs] - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
        common_ = np.bincount(owner[at], minlength=len(sets))
        common_[i] = 0
        for j in np.flatnonzero((common_ > 0) & _linked(n[i], n, common_, percent)):
            if joined.join(int(i), int(j)):
                out.append((int(i), int(j)))
    return out


def _block(percent: int, rounds: int):
    def run(key, table):
        names, blobs = table.column("cls").to_pylist(), table.column("shingles").to_pylist()
        first = {c: k for k, c in reversed(list(enumerate(names)))}
        at = sorted(first.values())
        sets = [np.frombuffer(blobs[k], np.uint64) for k in at]
        known = [table.column("root")[k].as_py() for k in at] if rounds else None
        asks = np.flatnonzero([table.column("minor")[k].as_py() for k in at]) if rounds else np.arange(len(at))
        found = block_links(sets, asks, percent, known)
        return pa.table({"a": pa.array([names[at[i]] for i, _ in found], pa.binary()), "b": pa.array([names[at[j]] for _, j in found], pa.binary())})

    return run


def _apart(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """Blocks in which classes that aren't in their bucket's largest component meet all others of the bucket.

    The largest component's members go, in chunks, to each chunk of the others; these go to all chunks.
    """
    members = common.stored(chunks.join(roots, F.col("cls") == F.col("node"), "left").select("bucket", "cls", "size", F.coalesce("root", "cls").alias("root")), "members")
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("n", "s", "root")).alias("top"), F.sum("n").alias("n"), F.sum("s").alias("s")).where(F.col("n") > F.col("top.n"))
    split = lambda n, s: F.greatest(F.ceil(n / CHUNK_CLASSES), F.ceil(s / CHUNK_SHINGLES), F.lit(1))
    whole = whole.select("bucket", F.col("n").alias("rows"), F.col("top.root").alias("bulk"), split(F.col("top.n"), F.col("top.s")).alias("bulks"), split(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("minors"))
    open_ = common.join_hot(members, common.stored(whole, "open"), "bucket", "rows", members.count())
    minor = F.col("root") != F.col("bulk")
    own = F.pmod(F.xxhash64("cls"), F.when(minor, F.col("minors")).otherwise(F.col("bulks")))
    lines = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_bulk = F.transform(lines(F.col("bulks")), lambda k: F.struct(F.lit(True).alias("bulk"), k.alias("x"), F.col("own").alias("y")))
    with_minor = F.transform(lines(F.col("minors")), lambda k: F.struct(F.lit(False).alias("bulk"), F.least(k, "own").alias("x"), F.greatest(k, "own").alias("y")))
    of_bulk = F.transform(lines(F.col("minors")), lambda k: F.struct(F.lit(True).alias("bulk"), F.col("own").alias("x"), k.alias("y")))
    return open_.withColumn("own", own).withColumn("minor", minor).select("bucket", "cls", "root", "minor", F.explode(F.when(minor, F.concat(with_bulk, with_minor)).otherwise(of_bulk)).alias("block"))


def _links(sets: DataFrame, least_ranges: int, percent: int) -> DataFrame:
    """a, b: links that join the components of the sets (cls, shingles), which are bucketed by cls."""
    blocks = sets.mapInArrow(common.releasing(_blocked), "node long, names binary, sizes binary, shingles binary")
    held = sets.agg(F.sum(F.length("shingles"))).first()[0] or 0
    ranges = max(least_ranges, -(-held // (8 * RANGE_ENTRIES)))
    counts = blocks.select("node", "shingles").mapInArrow(_block_counts(ranges), "node long, range long, data binary").groupBy("range").applyInArrow(common.releasing_group(_frequencies), "node long, range long, data binary")
    counts = counts.groupBy("node").agg(F.collect_list(F.struct("range", "data")).alias("counts"))  # of one block, so as bounded as blocks are
    entries = blocks.join(counts, "node", "left").select("names", "sizes", "shingles", "counts").mapInArrow(_indexer(ranges, percent), "range long, salt long, run binary")
    found = common.stored(entries.groupBy("range", "salt").applyInArrow(common.releasing_group(_buckets(percent)), "a binary, b binary, bucket long, chunk long, size long, members long"), "candidates")
    pairs = found.where("b IS NOT NULL").select("a", "b").distinct()
    chunks = found.where("b IS NULL").select(F.col("a").alias("cls"), "bucket", "chunk", "size", "members")
    of = lambda side: sets.select(F.col("cls").alias(side), F.col("shingles").alias(f"of_{side}"))
    links = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(_verify(percent), "a binary, b binary")
    if not chunks.limit(1).count():
        return links
    # chunks of the same classes, of shingles that go together, are looked at once
    inside = chunks.select("members", "cls").distinct().join(sets, "cls").select("members", "cls", "shingles").groupBy("members").applyInArrow(common.releasing_group(_block(percent, 0)), "a binary, b binary")
    links = common.stored(links.unionByName(inside), "links")
    apart = _apart(chunks, components(links, "first-roots"))
    across = apart.join(sets, "cls").groupBy("bucket", "block").applyInArrow(common.releasing_group(_block(percent, 1)), "a binary, b binary")
    return links.unionByName(across)


def similar(docs: DataFrame, *, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", unique: bool | None = None) -> DataFrame:
    """_row, doc_id, n_shingles, component_id and first_row of each row of docs.

    Words are runs of other than blanks, A-Z lower-cased. A text's set holds its distinct shingles of `words` words;
    with fewer, all words as one. Null, empty and blank texts have empty sets and are linked with nothing: they are
    their own component. Two rows are linked if their sets' intersection is percent % of the union or more; equal sets
    are. component_id: the smallest doc_id that can be reached by links (null ids only if there is no other);
    first_row: that row's number, the smallest of repeated ones. Sets are compared by 64-bit hashes of shingles.
    Repeated rows have the same set; an empty table gives no rows. Ids are integers. unique: whether ids are known to name rows (None: it
    is looked up).
    """
    spark = docs.sparkSession
    unique = common.unique_ids(docs, id_col) if unique is None else unique
    text = common.texts(docs, text_col).alias("text")
    least_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = docs.select(text).agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(least_ranges, -(-held // (10 * RANGE_ENTRIES)))  # about six bytes a word, and of these shingles a third or so
    raw = docs.select(F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), text)
    scanned = common.stored(raw.mapInArrow(_scan(words, percent, ranges), "_row long, doc_id long, cls binary, size long, node long, range long, data binary"), "shingled")
    rows = scanned.where("node IS NULL").select("_row", "doc_id", "cls", "size")
    found = scanned.where("range >= 0").select("node", "range", "data").groupBy("range").applyInArrow(common.releasing_group(_found_again), "node long, range long, data binary").where("data IS NOT NULL")
    runs = scanned.where("range < 0").select("node", "range", "data").unionByName(found)
    screened = runs.groupBy("node").applyInArrow(common.releasing_group(_screened(percent)), "cls binary, doc_id long")
    wanted = common.stored(screened.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "wanted")
    # shingle sets of these classes, from the text of one document of each; some more do no harm
    bits = common.id_bits(wanted, "doc_id")
    shared = spark.sparkContext.broadcast(bits)
    sets = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), text).mapInArrow(_chosen(shared, words), "doc_id long, cls binary, shingles binary")
    if not unique or np.unpackbits(bits).mean() > 0.5:  # an id may be repeated with other texts; a full filter leaves out too little
        sets = sets.join(wanted, ["cls", "doc_id"], "left_semi").dropDuplicates(["cls"])
    with common.bucketed(sets.select("cls", "shingles"), "sets", "cls", max(least_ranges, held // BUCKET_BYTES)) as sets:
        links = common.stored(_links(sets, least_ranges, percent), "links")
    roots = components(links)
    classes = rows.where("size > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "_row")).alias("least"), F.count("*").alias("copies"))
    named = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "least", "copies", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("members"))
    named = common.stored(named.join(least.where("members > 1"), "root", "left").select("cls", "copies", F.coalesce("first", "least").alias("first")), "classes")
    full = common.join_hot(rows.where("size > 0"), named, "cls", "copies", rows.count())
    empty = rows.where("size = 0").withColumn("first", F.struct("doc_id", "_row"))
    out = full.select("_row", "doc_id", "size", "first").unionByName(empty.select("_row", "doc_id", "size", "first"))
    true_id = lambda c: F.when(c != _LAST, c)
    return out.select("_row", true_id(F.col("doc_id")).alias("doc_id"), F.col("size").alias("n_shingles"), true_id(F.col("first.doc_id")).alias("component_id"), F.col("first._row").alias("first_row"))


def dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps the first: the smallest id (null ids last).

    Null, empty and blank texts are linked with nothing, so they all stay; of repeated rows and of rows with the same id
    and similar texts one stays. An empty table stays empty. Columns may have any names.

    Rows are named by their ids if these are unique, else numbered and written. Rows that go are mostly fewer than those that
    stay; Spark broadcasts them while their size is below its threshold, so that texts aren't shuffled, and else joins by id.
    """
    id_col = options.get("id_col", "doc_id")
    if common.unique_ids(docs, id_col):
        go = similar(docs, unique=True, **options).where("_row <> first_row").select(F.coalesce("doc_id", F.lit(_LAST)).alias(id_col))
        return docs.join(common.stored(go, "go"), id_col, "left_anti").select(*docs.columns)
    row = common.fresh(docs, "_row_of_join")
    numbered = common.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _on_numbers(numbered, row, **options)
    stay = found.where(F.col("_row") == F.col("first_row")).select(F.col("_row").alias(row))
    return numbered.join(stay, row, "left_semi").select(*docs.columns)


def _on_numbers(numbered: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """similar(), whose rows are named by the written numbers: these stand in for ids, in the ids' order."""
    found = similar(numbered.select(F.col(row).alias("id"), F.col(text_col).alias("text")), id_col="id", unique=True, **options)
    ids = numbered.select(F.col(row).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("true_id"))
    named = found.join(ids, "doc_id")
    first = named.groupBy("component_id").agg(F.min(F.struct("true_id", "doc_id")).alias("first"))
    return named.join(first, "component_id").select(F.col("doc_id").alias("_row"), F.col("first.doc_id").alias("first_row"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh AS x JOIN sh AS y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (SELECT a, b FROM met JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM t UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, min(r) AS component_id FROM t LEFT JOIN n USING (doc_id) JOIN reach ON d = t.doc_id GROUP BY t.doc_id, n.n
"""
QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES = {"op8_jaccard_join": OP8_SQL}
