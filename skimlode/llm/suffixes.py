"""Removal of repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A passage of LENGTH bytes that occurs twice holds the same anchor at the same place both times: anchors are positions
whose hash is least among the places at which a window's seed may start. So suffixes are sorted at anchors only, and
of these only at anchors whose seed occurs again. Tasks sort their suffixes, exchange them as front-coded runs, and
merge them with loser trees whose nodes keep how much of the last winner each loser shares; known prefixes are never
compared again. Neighbours' common prefixes and the bytes before the anchors then tell exactly what occurs twice.

Anchors are chosen for strings of SHORT bytes, so that besides what is removed (strings of LENGTH bytes) the same pass
reports repeated passages that are shorter: sixty words of prose are often less than LENGTH bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a string that is removed if it starts anywhere else too, and of one that is reported.
LENGTH, SHORT, SEED = 400, 256, 160
#: How far a window may begin before its anchor.
REACH = SHORT - SEED
#: Bytes of text in whose seeds a range of seeds has its share, and suffixes of a range, on average at most.
RANGE_BYTES, RANGE_SUFFIXES = 64 << 20, 50_000
SEGMENT = 1 << 18
BATCH_BYTES = 8 << 20
#: Runs that one task merges at once, and suffixes of a run at most.
FAN_IN, RUN = 64, 150_000
#: Suffixes of equal seeds that are compared pair by pair; larger groups by classes of equal prefixes.
PAIRWISE = 6
#: Runs of so many bytes with a period of PERIOD at most are known to repeat (LOOK bytes tell the period); anchors stay in the first and last EDGE bytes.
PERIODIC, PERIOD, LOOK = 2048, 32, 64
EDGE = LENGTH + PERIOD
SEED_ENTRY = np.dtype([("seed", "<u8"), ("cls", "V16"), ("at", "<u4")])
DONE = np.dtype([("cls", "V16"), ("lo", "<u4"), ("hi", "<u4")])
META = np.dtype([("lcp", "<u2"), ("tail", "<u2"), ("left", "<u2"), ("at", "<u4"), ("cls", "V16")])
_LAST = 2**63 - 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: bytes) -> np.ndarray:
    """A well-mixed hash of the eight bytes at each position."""
    x = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)) * _MULTIPLIER
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window of `width` positions."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def periodic(text: bytes) -> list[tuple[int, int]]:
    """Start and end of the maximal runs of PERIODIC bytes or more that have a period of PERIOD or less.

    Every string of LENGTH bytes in one starts again a period earlier or later in it, so no search is needed for these.
    """
    if len(text) < PERIODIC:
        return []
    periods = set()
    for at in range(0, len(text) - LOOK - PERIOD, PERIODIC // 2):  # a run holds such a stretch whole
        if (again := text.find(text[at : at + LOOK], at + 1, at + LOOK + PERIOD)) >= 0:
            periods.add(again - at)
    data, found = np.frombuffer(text, np.uint8), []
    for q in sorted(periods):
        differs = np.concatenate(([-1], np.flatnonzero(data[q:] != data[:-q]), [len(data) - q]))
        long = np.flatnonzero(np.diff(differs) - 1 + q >= PERIODIC)
        for lo, hi in zip((differs[long] + 1).tolist(), (differs[long + 1] + q).tolist()):
            if not any(a <= lo and hi <= b for a, b in found):  # by a period that divides this one
                found.append((lo, hi))
    return sorted(found)


def anchors(text: bytes) -> np.ndarray:
    """Of each window of SHORT bytes, the place with the least hash (the first of equal ones) at which its seed may start.

    Where bytes repeat with a short period, every period has such a place. Those deep in a long run are left out: a string
    that is not all in the run, and a string of each phase, still find the ones in its first and last EDGE bytes.
    """
    found = []
    windows = len(text) - SHORT + 1
    for at in range(0, max(0, windows), SEGMENT):
        part = text[at : min(len(text), at + SEGMENT + SHORT - 1)]
        places = len(part) - SEED + 1
        keys = (_grams(part)[:places] & ~np.uint64(0xFFFFF)) | np.arange(places, dtype=np.uint64)
        least = _least(keys, REACH + 1)
        first = least[np.concatenate(([True], least[1:] != least[:-1]))]
        found.append((first & np.uint64(0xFFFFF)).astype(np.int64) + at)
    out = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    for lo, hi in periodic(text):
        out = out[(out < lo + EDGE) | (out >= hi - EDGE)]
    return out


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256(t.as_py()).digest() for t in b.column(1)]
        sizes = [len(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([d[:16] for d in digests], pa.binary()), pa.array([d.hex() for d in digests], pa.string()), pa.array(sizes, pa.int64())], ["doc_id", "cls", "sha", "n_bytes"])


def _seeds(ranges: int):
    """One entry for each seed of a batch, packed by ranges of seeds; a seed that the batch holds again needs no other proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in common.pieces(b.column(0), BATCH_BYTES):
                parts, done = [], set()
                for t in b.column(0)[lo:hi]:
                    text = t.as_py()
                    if len(text) < SHORT or (cls := hashlib.sha256(text).digest()[:16]) in done:
                        continue
                    done.add(cls)
                    at = anchors(text)
                    view = memoryview(text)
                    e = np.empty(len(at), SEED_ENTRY)
                    e["seed"], e["cls"], e["at"] = [xxhash.xxh3_64_intdigest(view[a : a + SEED]) for a in at.tolist()], np.void(cls), at
                    parts.append(e)
                if not parts:
                    continue
                e = np.concatenate(parts)
                e = e[np.argsort(e["seed"], kind="stable")]
                again = np.zeros(len(e), bool)
                same = e["seed"][1:] == e["seed"][:-1]
                again[1:] |= same
                again[:-1] |= same
                first = e[np.concatenate(([True], ~same))]
                place = ((first["seed"] >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
                edges = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(first)]))
                sure = e[again]
                blobs = [first[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:])]
                where = place[edges[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], ["range", "seeds", "sure"])
                if len(sure):
                    yield pa.RecordBatch.from_arrays([pa.array([int(sure["seed"][0] % np.uint64(ranges))], pa.int64()), pa.nulls(1, pa.binary()), pa.array([sure.tobytes()], pa.binary())], ["range", "seeds", "sure"])

    return run


def _repeated(key, table):
    """Anchors whose seed is met again in another batch, and those that are known to be."""
    seeds = [np.frombuffer(x, SEED_ENTRY) for x in table.column("seeds").to_pylist() if x is not None]
    out = [np.frombuffer(x, SEED_ENTRY) for x in table.column("sure").to_pylist() if x is not None]
    if seeds:
        e = np.concatenate(seeds)
        e = e[np.argsort(e["seed"], kind="stable")]
        cls = np.frombuffer(e["cls"].tobytes(), "<u8").reshape(-1, 2)
        same = e["seed"][1:] == e["seed"][:-1]
        other = same & ((cls[1:] != cls[:-1]).any(axis=1) | (e["at"][1:] != e["at"][:-1]))
        group = np.cumsum(np.concatenate(([True], ~same))) - 1
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[1:][other]] = True
        out.append(e[mixed[group]])
    e = np.concatenate(out)
    raw = e["cls"].tobytes()
    return pa.table({"cls": pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary()), "at": pa.array(e["at"].astype(np.int64), pa.int64())})


# A suffix is a tuple: its bytes up to LENGTH, bytes before it up to REACH, class, position.


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which `known` bytes are known."""
    n = min(len(x), len(y))
    a, b = x[known:n], y[known:n]
    if a == b:
        return n
    differ = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return known + (8 * (n - known) - differ.bit_length()) // 8


def pack(entries: list[tuple], lcps: list[int], done: np.ndarray) -> bytes:
    """A front-coded run: of each suffix only what it doesn't share with the one before."""
    meta = np.zeros(len(entries), META)
    meta["lcp"], meta["at"] = lcps, [e[3] for e in entries]
    tails = [e[0][n:] for e, n in zip(entries, lcps)]
    meta["tail"], meta["left"] = list(map(len, tails)), [len(e[1]) for e in entries]
    meta["cls"] = np.frombuffer(b"".join(e[2] for e in entries), "V16") if entries else []
    return b"".join([len(entries).to_bytes(4, "little"), len(done).to_bytes(4, "little"), meta.tobytes(), done.tobytes(), *tails, *(e[1] for e in entries)])


def unpack(raw: bytes) -> tuple[Iterator[tuple[int, tuple]], np.ndarray]:
    """The run's suffixes in order, each with what it shares with the one before, and its finished spans."""
    n, n_done = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little")
    meta = np.frombuffer(raw, META, n, 8)
    done = np.frombuffer(raw, DONE, n_done, 8 + meta.nbytes)
    at = 8 + meta.nbytes + done.nbytes

    def suffixes():
        tail_at, left_at, before = at, at + int(meta["tail"].sum()), b""
        names = meta["cls"].tobytes()
        for k, (lcp, tail, left, where) in enumerate(zip(meta["lcp"].tolist(), meta["tail"].tolist(), meta["left"].tolist(), meta["at"].tolist())):
            before = before[:lcp] + raw[tail_at : tail_at + tail]
            yield lcp, (before, raw[left_at : left_at + left], names[16 * k : 16 * k + 16], where)
            tail_at, left_at = tail_at + tail, left_at + left

    return suffixes(), done


def merge(runs: list[Iterator[tuple[int, tuple]]]) -> Iterator[tuple[int, tuple]]:
    """Loser tree over sorted runs: suffixes in order, each with what it shares with the one before.

    A loser keeps what it shares with the winner that passed it. Of two suffixes that share different lengths with the
    last winner the one that shares more is smaller; only at equal lengths are bytes compared, from there on.
    """
    k = len(runs)
    if k == 1:
        yield from runs[0]
        return
    heads: list[tuple | None] = []
    shared = [0] * k
    for run in runs:
        item = next(run, None)
        heads.append(item[1] if item else None)
    tree = [-1] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser; the loser keeps what it shares with the winner."""
        x, y = heads[i], heads[j]
        if x is None or y is None:
            return (j, i) if x is None else (i, j)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        n = common_prefix(x[0], y[0], shared[i])
        first = (i, j) if len(x[0]) == n or (len(y[0]) > n and x[0][n] < y[0][n]) else (j, i)
        shared[first[1]] = n
        return first

    for i in range(k):
        node, at = i, (i + k) // 2
        while at > 0 and tree[at] >= 0:
            node, tree[at] = play(node, tree[at])
            at //= 2
        if at > 0:
            tree[at] = node
        else:
            winner = node
    while heads[winner] is not None:
        yield shared[winner], heads[winner]
        item = next(runs[winner], None)
        shared[winner], heads[winner] = item if item else (0, None)
        node, at = winner, (winner + k) // 2
        while at > 0:
            node, tree[at] = play(node, tree[at])
            at //= 2
        winner = node


def collapse(ordered: Iterator[tuple[int, tuple]]) -> tuple[list[tuple], list[int], np.ndarray]:
    """Of suffixes with the same bytes before and after, one stays; all of them are finished, as both sides repeat whole.

    So a passage that many texts share is one suffix of each run, whatever the number of texts.
    """
    entries: list[tuple] = []
    lcps: list[int] = []
    done: list[tuple[bytes, int, int]] = []
    alike: dict[bytes, tuple] = {}
    carried, told = LENGTH, set()
    for lcp, e in ordered:
        carried = min(carried, lcp)
        if not entries or carried < len(e[0]) or len(entries[-1][0]) != len(e[0]):
            alike, told = {}, set()
        if (twin := alike.get(e[1])) is not None:
            if (twin[2], twin[3]) != (e[2], e[3]) and len(e[0]) + len(e[1]) >= SHORT:
                for one in (e,) if e[1] in told else (twin, e):
                    done.append((one[2], one[3] - len(e[1]), one[3] + len(e[0])))
                told.add(e[1])
            continue
        alike[e[1]] = e
        entries.append(e)
        lcps.append(carried if len(entries) > 1 else 0)
        carried = LENGTH
    return entries, lcps, _spans(done)


def _spans(done: list[tuple[bytes, int, int]]) -> np.ndarray:
    out = np.zeros(len(done), DONE)
    if done:
        out["cls"] = np.frombuffer(b"".join(d[0] for d in done), "V16")
        out["lo"], out["hi"] = [d[1] for d in done], [d[2] for d in done]
    return out


def _common_end(x: bytes, y: bytes) -> int:
    return common_prefix(x[::-1], y[::-1], 0)


def repeats(entries: list[tuple], lcps: list[int]) -> list[tuple[bytes, int, int]]:
    """Spans that occur twice, of SHORT bytes or more, of distinct suffixes in order."""
    out: list[tuple[bytes, int, int]] = []
    at = 0
    while at < len(entries):
        to = at + 1
        while to < len(entries) and lcps[to] >= SEED:
            to += 1
        if to - at > PAIRWISE:
            for length in (LENGTH, SHORT):
                out += _by_classes(entries[at:to], lcps[at:to], length)
        else:
            for i in range(at, to):
                right = LENGTH
                for j in range(i + 1, to):
                    right = min(right, lcps[j])
                    left = _common_end(entries[i][1], entries[j][1])
                    if left + right >= SHORT:
                        out += [(e[2], e[3] - left, e[3] + right) for e in (entries[i], entries[j])]
        at = to
    return out


def _by_classes(entries: list[tuple], lcps: list[int], length: int) -> list[tuple[bytes, int, int]]:
    """The same for many suffixes and windows of `length`: for each way to place a window, those that agree on both of its sides.

    The spans of shorter windows are all shorter than a longer window. Classes of equal sides change only where some neighbours' common length is passed, so few placements are looked at.
    """
    n = len(entries)
    right = np.array(lcps)
    right[0] = 0
    backward = [e[1][::-1] for e in entries]
    order = np.array(sorted(range(n), key=backward.__getitem__))
    left = np.array([0, *(common_prefix(backward[i], backward[j], 0) for i, j in zip(order[:-1], order[1:]))])
    left_size, right_size = np.array([len(b) for b in backward]), np.array([len(e[0]) for e in entries])
    # before = bytes of the window before the anchor; classes are constant for before in (low, high]
    marks = np.unique(np.concatenate(([-1, REACH], left, left_size, length - 1 - right, length - 1 - right_size)))
    marks = marks[(marks >= -1) & (marks <= REACH)]
    out = []
    for low, high in zip(marks[:-1].tolist(), marks[1:].tolist()):
        before = low + 1
        of_right = np.cumsum(right < length - before)
        of_left = np.empty(n, np.int64)
        of_left[order] = np.cumsum(left < before)
        fits = np.flatnonzero((left_size >= before) & (right_size >= length - before))
        code = of_right[fits] * (n + 1) + of_left[fits]
        _, inverse, count = np.unique(code, return_inverse=True, return_counts=True)
        for k in fits[count[inverse] > 1].tolist():
            out.append((entries[k][2], entries[k][3] - high, entries[k][3] - before + length))
    return out


def _runs(ranges: int):
    """A task's suffixes at its repeated anchors, sorted and front-coded, by hash of the seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node, held, known = TaskContext.get().partitionId(), [], []
        for b in batches:
            for cls, text, places in zip(b.column(0), b.column(1), b.column(2)):
                c, t = cls.as_py(), text.as_py()
                known += [(c, lo, hi) for lo, hi in periodic(t)]
                for a in places.values.to_numpy().tolist():
                    held.append((t[a : a + LENGTH], t[max(0, a - REACH) : a], c, a))
                    if len(held) >= RUN:
                        yield from _sorted_runs(held, known, ranges, node)
                        held, known = [], []
        if held or known:
            yield from _sorted_runs(held, known, ranges, node)

    return run


def _sorted_runs(held: list[tuple], known: list[tuple[bytes, int, int]], ranges: int, node: int) -> Iterator[pa.RecordBatch]:
    """known: spans that repeat by themselves."""
    by_range: dict[int, list[tuple]] = {}
    for e in held:
        by_range.setdefault(xxhash.xxh3_64_intdigest(e[0][:SEED]) % ranges, []).append(e)
    loose: list[np.ndarray] = [_spans(known)]
    names, blobs = [], []
    for r, own in by_range.items():
        own.sort()
        lcps = [0, *(common_prefix(x[0], y[0], 0) for x, y in zip(own[:-1], own[1:]))]
        entries, shared, done = collapse(zip(lcps, own))
        names.append(r)
        blobs.append(pack(entries, shared, done[:0]))
        loose.append(done)
    done = np.concatenate(loose)
    if len(done):  # finished spans need no merging: any range may take them
        names.append(node % ranges)
        blobs.append(pack([], [], done))
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([node] * len(names), pa.int64()), pa.array(blobs, pa.binary())], ["range", "node", "run"])


def _merged(table) -> tuple[list[tuple], list[int], np.ndarray]:
    opened = [unpack(x) for x in table.column("run").to_pylist()]
    entries, lcps, done = collapse(merge([r for r, _ in opened]))
    return entries, lcps, np.concatenate([done, *(d for _, d in opened)])


def _meet(key, table):
    return pa.table({"range": pa.array([key[0].as_py()], pa.int64()), "node": pa.array([key[1].as_py()], pa.int64()), "run": pa.array([pack(*_merged(table))], pa.binary())})


def _resolved(key, table):
    entries, lcps, done = _merged(table)
    found = repeats(entries, lcps)
    raw = done["cls"].tobytes()
    cls = [raw[i : i + 16] for i in range(0, len(raw), 16)] + [f[0] for f in found]
    lo, hi = done["lo"].tolist() + [f[1] for f in found], done["hi"].tolist() + [f[2] for f in found]
    spans: dict[bytes, list[tuple[int, int]]] = {}
    for c, a, b in zip(cls, lo, hi):
        spans.setdefault(c, []).append((a, b))
    kind = pa.list_(pa.int64())
    removed, every = ([_flat(union([x for x in s if x[1] - x[0] >= least])) for s in spans.values()] for least in (LENGTH, SHORT))
    return pa.table({"cls": pa.array(list(spans), pa.binary()), "spans": pa.array(removed, kind), "every": pa.array(every, kind)})


def _flat(spans: list[tuple[int, int]]) -> list[int]:
    return [x for s in spans for x in s]


def _joined(lists: list[list[int]]) -> list[tuple[int, int]]:
    return union([(x[k], x[k + 1]) for x in lists for k in range(0, len(x), 2)])


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the spans cover; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each class with its text and lists of spans: the runs removed, the hash of what is left, and all bytes that are repeated."""
    for b in batches:
        spans_out, sha, removed, every = [], [], [], []
        for text, lists, all_lists in zip(b.column(1), b.column(2), b.column(3)):
            t = text.as_py()
            spans = _joined(lists.as_py())
            every.append(sum(j - i for i, j in _joined(all_lists.as_py())))
            keep = zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(t)])
            sha.append(hashlib.sha256(b"".join(t[i:j] for i, j in keep)).hexdigest())
            removed.append(sum(j - i for i, j in spans))
            spans_out.append(_flat(spans))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(removed, pa.int64()), pa.array(every, pa.int64()), pa.array(spans_out, pa.list_(pa.int64())), pa.array(sha, pa.string())], ["cls", "removed", "every", "spans", "kept_sha"])


def _picked(shared):
    """The rows whose ids may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.in_bits(shared.value, np.asarray(b.column(0)))))

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_repeated, spans and kept_sha256 of each row of docs.

    spans: start and end in turn of the maximal runs of bytes that are covered by strings of LENGTH bytes which start
    anywhere else too, in the same text or another; matches never cross texts. n_repeated: the bytes that are covered by
    such strings of SHORT bytes; those beyond n_removed are only reported. Null counts as empty; shorter texts keep all.
    Rows of equal texts (repeated rows too) are removed whole if they have LENGTH bytes. What is removed depends on the
    texts alone, never on ids. Ids are integers. An empty table gives no rows. Of a very long text that repeats with a
    short period few suffixes are sorted; a task holds RUN suffixes at once, whatever the text.
    """
    spark = docs.sparkSession
    text = common.texts(docs, text_col).alias("text")
    least_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id")
    rows = common.stored(docs.select(ids, text).mapInArrow(common.releasing(_classes), "doc_id long, cls binary, sha string, n_bytes long"), "texts")
    n_rows, held = rows.agg(F.count("*"), F.sum("n_bytes")).first()
    seeds = docs.select(text).mapInArrow(common.releasing(_seeds(max(least_ranges, (held or 0) // RANGE_BYTES))), "range long, seeds binary, sure binary")
    places = seeds.groupBy("range").applyInArrow(common.releasing_group(_repeated), "cls binary, at long").groupBy("cls").agg(F.array_sort(F.collect_set("at")).alias("places"))
    wanted = common.stored(places.join(rows.groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "cls"), "places")
    # the text of one document of each class in question; an id may be repeated with other texts
    shared = spark.sparkContext.broadcast(common.id_bits(wanted, "doc_id"))
    sources = docs.select(ids, text).mapInArrow(common.releasing(_picked(shared)), "doc_id long, text binary")
    sources = sources.join(wanted, "doc_id").where(F.substring(F.unhex(F.sha2("text", 256)), 1, 16) == F.col("cls"))
    sources = common.stored(sources.select("cls", "text", "places").dropDuplicates(["cls"]), "sources")
    ranges = max(least_ranges, (wanted.agg(F.sum(F.size("places"))).first()[0] or 0) // RANGE_SUFFIXES)
    kind = "range long, node long, run binary"
    runs, left = sources.mapInArrow(common.releasing(_runs(ranges)), kind), sources.rdd.getNumPartitions()
    while (left := -(-left // FAN_IN)) > 1:
        runs = runs.withColumn("node", F.floor(F.col("node") / FAN_IN)).groupBy("range", "node").applyInArrow(common.releasing_group(_meet), kind)
    found = runs.groupBy("range").applyInArrow(common.releasing_group(_resolved), "cls binary, spans array<long>, every array<long>")
    lists = found.groupBy("cls").agg(F.collect_list("spans").alias("lists"), F.collect_list("every").alias("all_lists"))
    cut = sources.select("cls", "text").join(lists, "cls").select("cls", "text", "lists", "all_lists").mapInArrow(common.releasing(_kept), "cls binary, removed long, every long, spans array<long>, kept_sha string")
    classes = rows.groupBy("cls").agg(F.count("*").alias("copies"), F.min("sha").alias("sha"), F.min("n_bytes").alias("n_bytes")).join(cut, "cls", "left")
    copied = lambda least: (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    whole = copied(LENGTH)
    result = common.stored(
        classes.select(
            "cls", "copies", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(copied(SHORT), F.col("n_bytes")).otherwise(F.coalesce("every", F.lit(0))).alias("n_repeated"),
            F.when(whole, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(F.coalesce("spans", F.array().cast("array<long>"))).alias("spans"),
            F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
        ), "spans"
    )
    out = common.join_hot(rows.drop("sha"), result, "cls", "copies", n_rows)
    return out.select(F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_repeated", "spans", "kept_sha256")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256", "n_repeated")


def _sql_spans(name: str, length: int) -> str:
    """Maximal runs of bytes that are covered by strings of so many bytes which start twice."""
    return f"""{name}_at AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, {2 * length})) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) AS i FROM d WHERE length(h) >= {2 * length})),
{name}_hit AS (SELECT doc_id, i FROM {name}_at WHERE k IN (SELECT k FROM {name}_at GROUP BY k HAVING count(*) > 1)),
{name}_run AS (SELECT *, sum(CASE WHEN i <= before + {length} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM {name}_hit)),
{name} AS (SELECT doc_id, run, min(i) AS a, max(i) + {length} AS b FROM {name}_run GROUP BY doc_id, run)"""


OP10_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
{_sql_spans("cut", LENGTH)},
{_sql_spans("near", SHORT)},
gaps AS (SELECT doc_id, coalesce(lag(b) OVER w, 0) AS lo, a AS hi FROM cut WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(b), NULL FROM cut GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h)) - lo)), '' ORDER BY lo) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS spans FROM cut GROUP BY doc_id),
repeated AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n FROM near GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(r.n, 0) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256, coalesce(s.n, 0) AS n_repeated
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN removed AS r USING (doc_id) LEFT JOIN repeated AS s USING (doc_id)
"""
QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLES = {"op10_suffix_dedup": OP10_SQL}
