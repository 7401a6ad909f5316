"""Brown class bigrams: exchange clustering puts words into classes; class transitions and word emissions score texts.

The model is a distribution over V + 1 words, the last standing for all unseen ones:
P(word | previous) = P(class | previous class) * P(word | class).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A-Z lower-cased, the blanks that part words made spaces.
FOLD = bytes(32 if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A word is in the lexicon, which is broadcast, if it is one token in so many or more often, whatever the size of the
#: corpus. So there are no more such words than that, and all together they have no more bytes than as many tokens of mean
#: length. All other words choose their classes in tasks, and these and their counts are joined.
LEAST_SHARE = 1 << 20
#: The most frequent words are clustered first, by exchange one after the other; then all words choose again, so many times.
FIRST, CLASSES, SWEEPS, ROUNDS = 2048, 96, 4, 2
#: Cells of a table of counts that is held densely, of a block of one that is added up, and entries held before they are merged.
DENSE, BLOCK_CELLS, HELD = 1 << 23, 1 << 21, 3_000_000
#: Weight of the class's overall share in transitions.
PRIOR = 50.0
PIECE = 1 << 20
#: Neighbours of rarer words that are looked at together.
NEAR_HELD = 1 << 15
FAN_IN = 16
BLOCKS = 16
END = b""


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words, piece by piece; long texts are cut at blanks."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        to = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        to = len(folded) if to < 0 else to
        yield list(filter(None, folded[at:to].split(b" ")))
        at = to


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flush():
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        seen.clear()

    for b in batches:
        for t in b.column(0):
            for part in words(t.as_py()):
                seen.update(part)
        seen[END] += b.num_rows
        if len(seen) > 600_000:
            yield from flush()
    if seen:
        yield from flush()


def _coder(shared):
    """All columns but the text, its last; then its word numbers, those of its words out of the lexicon after the lexicon's; and these words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        other, end = len(lexicon), np.zeros(1, "<i4").tobytes()
        for b in batches:
            column = b.column(b.num_columns - 1)
            for lo, hi in common.pieces(column, 4 * PIECE):
                coded, rest = [], []
                for t in column[lo:hi].to_pylist():
                    own: dict[bytes, int] = {}
                    raw = []
                    for part in words(t):
                        ids = np.fromiter(map(lexicon.get, part, repeat(-1)), "<i4", len(part))
                        out = np.flatnonzero(ids < 0)
                        ids[out] = [other + own.setdefault(part[i], len(own)) for i in out.tolist()]
                        raw.append(ids.tobytes())
                    coded.append(b"".join((*raw, end)))
                    rest.append(list(own))
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:-1]), pa.array(coded, pa.binary()), pa.array(rest, pa.list_(pa.binary()))], [*b.schema.names[:-1], "ids", "rest"])

    return common.releasing(run)


def _coded(docs: DataFrame, lexicon: dict[bytes, int]) -> DataFrame:
    """docs, their last column a text, as word numbers: they are read once, all that follows goes by numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = T.StructType([*docs.schema.fields[:-1]]).add("ids", "binary").add("rest", T.ArrayType(T.BinaryType()))
    return common.stored(docs.mapInArrow(_coder(shared), kind).withColumn("row", F.monotonically_increasing_id()), "coded")


def _ids(texts: list[bytes], most: int) -> np.ndarray:
    """Word numbers of all texts, an end before the first; most stands for all words out of the lexicon."""
    return np.minimum(np.frombuffer(b"".join((bytes(4), *texts)), "<i4"), most)


class _Tally:
    """Counts of codes: a dense table if that is small, else sorted codes, merged whenever many new ones are there."""

    def __init__(self, cells: int):
        self.table = np.zeros(cells, np.int64) if cells <= DENSE else None
        self.at, self.n = np.empty(0, np.int64), np.empty(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, code: np.ndarray) -> None:
        if self.table is not None and len(code) * 8 > len(self.table):
            self.table += np.bincount(code, minlength=len(self.table))
            return
        at, n = np.unique(code, return_counts=True)
        if self.table is not None:
            self.table[at] += n
            return
        self.new.append((at, n))
        self.held += len(at)
        if self.held > HELD:
            self.merge()

    def merge(self) -> None:
        at = np.concatenate([self.at, *(a for a, _ in self.new)])
        order = np.argsort(at, kind="stable")
        at, n = at[order], np.concatenate([self.n, *(n for _, n in self.new)])[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
        self.at, self.n = at[first], np.add.reduceat(n, first) if len(at) else n
        self.new, self.held = [], 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        if self.table is not None:
            at = np.flatnonzero(self.table)
            return at, self.table[at]
        self.merge()
        return self.at, self.n


def _pair_counter(shared, rows: int, columns: int, pairs):
    """A task's counts of pairs, sent as packed sparse blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, tally = shared.value, _Tally(rows * columns)
        for b in batches:
            for lo, hi in common.pieces(b.column(0), 4 * PIECE):
                for code in pairs(model, b.column(0)[lo:hi].to_pylist(), columns):
                    tally.add(code)
        part = TaskContext.get().partitionId()
        at, n = tally.counts()
        for k, span in enumerate(_spans(rows, columns)):
            i, j = np.searchsorted(at, (span.start, span.stop))
            if j > i:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([part], pa.int64()), pa.array([_pack(at[i:j] - span.start, n[i:j])], pa.binary())], ["block", "node", "counts"])

    return run


def _spans(rows: int, columns: int) -> list[slice]:
    step = -(-rows // max(BLOCKS, rows * columns // BLOCK_CELLS))
    return [slice(a * columns, min(rows, a + step) * columns) for a in range(0, rows, step)]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Gaps between places and the counts there, each in as few bytes as the largest needs, deflated."""
    gaps, n = _narrow(np.diff(at, prepend=0)), _narrow(n)
    return zlib.compress(bytes((gaps.itemsize, n.itemsize)) + gaps.tobytes() + n.tobytes(), 1)


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    many = (len(raw) - 2) // (raw[0] + raw[1])
    gaps, n = np.frombuffer(raw, f"<u{raw[0]}", many, 2), np.frombuffer(raw, f"<u{raw[1]}", many, 2 + many * raw[0])
    return np.cumsum(gaps, dtype=np.int64), n.astype(np.int64)


def _add_up(key, table):
    parts = [_unpack(x) for x in table.column("counts").to_pylist()]
    total = np.zeros(max(int(at[-1]) for at, _ in parts) + 1, np.int64)
    for at, n in parts:
        total[at] += n
    at = np.flatnonzero(total)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "node": pa.array([key[1].as_py()], pa.int64()), "counts": pa.array([_pack(at, total[at])], pa.binary())})


def _added_up(train: DataFrame, model, rows: int, columns: int, pairs) -> DataFrame:
    """The whole corpus's table of pairs, as packed blocks of rows: tasks' counts are added up along a tree."""
    shared = train.sparkSession.sparkContext.broadcast(model)
    kind = "block long, node long, counts binary"
    out, left = train.mapInArrow(common.releasing(_pair_counter(shared, rows, columns, pairs)), kind), train.rdd.getNumPartitions()
    while True:
        left = -(-left // FAN_IN)
        out = out.withColumn("node", F.lit(0).cast("long") if left <= 1 else F.floor(F.col("node") / FAN_IN)).groupBy("block", "node").applyInArrow(common.releasing_group(_add_up), kind)
        if left <= 1:
            return out


def _count_pairs(train: DataFrame, model, rows: int, columns: int, pairs) -> np.ndarray:
    """The same as one table; for tables of fixed size, which the driver may have."""
    table, spans = np.zeros(rows * columns, np.int64), _spans(rows, columns)
    for r in _added_up(train, model, rows, columns, pairs).toLocalIterator():
        at, n = _unpack(bytes(r.counts))
        table[spans[r.block].start + at] += n
    return table.reshape(rows, columns)


def _word_pairs(model, texts, columns):
    ids = _ids(texts, columns - 1)
    yield ids[:-1].astype(np.int64) * columns + ids[1:]


def _neighbours(classes, texts, columns):
    """(word, class of the next) and (word, class of the one before) of all words; the classes are those so far."""
    ids = _ids(texts, len(classes) - 1)
    known = classes[ids]
    half = columns // 2
    for own, near, shift in ((ids[:-1], known[1:], 0), (ids[1:], known[:-1], half)):
        yield own.astype(np.int64) * columns + near + shift


def _class_pairs(classes, texts, columns):
    known = classes[_ids(texts, len(classes) - 1)].astype(np.int64)
    yield known[:-1] * columns + known[1:]


def _listed_pairs(kind, texts, columns):
    """The same of texts that are lists of classes already."""
    known = np.concatenate(([columns - 2], np.frombuffer(b"".join(texts), kind).astype(np.int64)))
    yield known[:-1] * columns + known[1:]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


def _gain(table: np.ndarray, left: np.ndarray, right: np.ndarray, after: np.ndarray, before: np.ndarray, own: float, count_left: float, count_right: float) -> np.ndarray:
    """Of a word that is in no class: what the log-likelihood gains in each class. after, before: its pairs with each class."""
    base = _xlogx(table)
    rows = _xlogx(table + after) - base
    columns = _xlogx(table + before[:, None]) - base
    diagonal = np.diagonal
    both = _xlogx(diagonal(table) + after + before + own) - diagonal(base)
    out = rows.sum(axis=1) - diagonal(rows) + columns.sum(axis=0) - diagonal(columns) + both
    return out - (_xlogx(left + count_left) - _xlogx(left)) - (_xlogx(right + count_right) - _xlogx(right))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering of words 1 .. n-2 by their pair counts: each in turn moves to the class that fits best.

    Words 0 (the end) and n-1 (all others) keep classes of their own, `classes` and `classes` + 1.
    """
    n = len(pairs)
    of = np.arange(-1, n - 1) % classes
    of[0], of[n - 1] = classes, classes + 1
    k = classes + 2
    table = np.zeros((k, k))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    left, right = table.sum(axis=1), table.sum(axis=0)
    out_of, into = pairs.sum(axis=1), pairs.sum(axis=0)
    for _ in range(sweeps):
        moved = 0
        for w in range(1, n - 1):
            own = float(pairs[w, w])
            after = np.bincount(of, weights=pairs[w], minlength=k)
            before = np.bincount(of, weights=pairs[:, w], minlength=k)
            a = of[w]
            after[a] -= own
            before[a] -= own
            for sign in (-1, 1):
                if sign > 0:
                    gain = _gain(table, left, right, after, before, own, out_of[w], into[w])[:classes]
                    b = int(gain.argmax())
                    b = a if gain[b] <= gain[a] + 1e-9 else b
                else:
                    b = a
                table[b] += sign * after
                table[:, b] += sign * before
                table[b, b] += sign * own
                left[b] += sign * out_of[w]
                right[b] += sign * into[w]
            moved += b != a
            of[w] = b
        if not moved:
            break
    return of


@dataclass
class Model:
    lexicon: dict[bytes, int]
    classes: np.ndarray  # of each lexicon word, and last of all other words
    log_next: np.ndarray  # log10 P(class | previous class)
    log_word: np.ndarray  # log10 P(word | its class) of lexicon words
    rest: float  # what is taken off log10(count + 1) of another word, unseen ones too
    log_size: np.ndarray  # log10 of each class's tokens and words: what is taken off log10(count + 1) of its words
    log_base: np.ndarray  # log10(count + 1) of lexicon words
    tokens: int  # N
    types: int  # V


def _tables(columns: int, spans: list[slice], classes: np.ndarray):
    """Of each block of words: pairs of classes, summed over its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                near, own = _words_of(raw, spans[block], columns), classes[spans[block].start // columns :]
                table = np.zeros((columns // 2, columns // 2))
                np.add.at(table, own[: len(near)], near[:, : columns // 2])
                yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["pairs"])

    return common.releasing(run)


def _words_of(raw: bytes, span: slice, columns: int) -> np.ndarray:
    at, n = _unpack(raw)
    out = np.zeros(span.stop - span.start)
    out[at] = n
    return out.reshape(-1, columns)


def _choosing(columns: int, spans: list[slice], classes: np.ndarray, table: np.ndarray):
    """Of each block of words: the classes that fit them best, all by the same table of pairs of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = columns // 2
        left, right = table.sum(axis=1), table.sum(axis=0)
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                near, first = _words_of(raw, spans[block], columns), spans[block].start // columns
                best = [_choose(table, left, right, w[:k], w[k:], int(c))[: k - 2].argmax() for w, c in zip(near, classes[first:])]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.array(best, "<i4").tobytes()], pa.binary())], ["block", "best"])

    return common.releasing(run)


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=0)).sum() - _xlogx(table.sum(axis=1)).sum())


def _lexicon(counts: DataFrame, least_share: int) -> tuple[list[bytes], np.ndarray, int, int]:
    """The end and all words that are one token in least_share or more often, the most frequent first; their counts; N and V."""
    total, types = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    top = counts.where((F.col("n") >= -(-total // least_share)) & (F.length("word") > 0)).orderBy(F.desc("n"), "word").collect()
    n_end = counts.where(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0
    return [END, *(bytes(r.word) for r in top)], np.array([n_end, *(r.n for r in top)], np.float64), total, types or 0


def fit(train: DataFrame, counts: DataFrame, *, least_share: int = LEAST_SHARE, first: int = FIRST, classes: int = CLASSES, sweeps: int = SWEEPS, rounds: int = ROUNDS) -> Model:
    """The model of `train` (one column of text bytes); counts: its words, with the end as the empty word.

    The lexicon holds the words that are one token in least_share or more often. The `first` most frequent of them are
    clustered by exchange, to begin with; then all choose a class by the words around them, in `rounds` rounds: each by
    the same table of the classes so far, so that blocks of words choose side by side. Of the clusterings met the most
    likely one stays. All words count, in or out of the lexicon; those out of it share a class here, and score() gives
    them classes of their own. The driver gets the lexicon, its classes, and tables of fixed sizes: `first` squared, and
    classes squared for each block of words (a hundred blocks at most).
    """
    found = _lexicon(counts, least_share)
    return _fitted(_coded(train, {w: i for i, w in enumerate(found[0])}), *found, first, classes, sweeps, rounds)[0]


def _fitted(coded: DataFrame, names: list[bytes], n: np.ndarray, total: int, types: int, first: int, classes: int, sweeps: int, rounds: int) -> tuple[Model, np.ndarray]:
    """fit() of texts as word numbers, and the table of pairs of classes."""
    train, first = coded.select("ids"), min(first, len(names))
    k, rows = classes + 2, len(names) + 1
    pairs = _count_pairs(train, None, first + 1, first + 1, _word_pairs)
    of = np.full(rows, classes + 1, np.int32)
    of[:first] = exchange(pairs, classes, sweeps)[:-1]
    likely, spans = (-np.inf, of, np.zeros((k, k))), _spans(rows, 2 * k)
    for _ in range(rounds):
        near = common.stored(_added_up(train, of, rows, 2 * k, _neighbours), "neighbours").repartition(len(spans), "block")
        table = sum((np.frombuffer(bytes(r.pairs)).reshape(k, k) for r in near.mapInArrow(_tables(2 * k, spans, of), "pairs binary").collect()), np.zeros((k, k)))
        likely = max(likely, (_likelihood(table), of, table), key=lambda x: x[0])
        chosen = of.copy()
        for r in near.mapInArrow(_choosing(2 * k, spans, of, table), "block long, best binary").collect():
            best = np.frombuffer(bytes(r.best), "<i4")
            chosen[spans[r.block].start // (2 * k) :][: len(best)] = best
        chosen[0], chosen[-1] = classes, classes + 1
        of = chosen
    table = _count_pairs(train, of, k, k, _class_pairs).astype(np.float64)
    _, of, table = max(likely, (_likelihood(table), of, table), key=lambda x: x[0])
    size = np.bincount(of[:-1], weights=n, minlength=k)
    members = np.bincount(of[:-1], minlength=k).astype(np.float64)
    size[classes + 1], members[classes + 1] = total - n.sum(), types - np.count_nonzero(n) + 1
    log_next, log_size = _estimated(table, size, members)
    log_base = np.log10(n + 1)
    return Model({w: i for i, w in enumerate(names)}, of, log_next, log_base - log_size[of[:-1]], float(log_size[-1]), log_size, log_base, total, types), table


def _estimated(table: np.ndarray, size: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class | previous class), and of each class's tokens and words.

    Where the last class has unseen words only, it gets its share after every class: nothing tells where they follow.
    """
    share = (size + members) / (size + members).sum()
    unseen = 0.0 if size[-1] else share[-1]
    if unseen:
        share = np.append(share[:-1] / max(share[:-1].sum(), 1e-300), 0.0)
    following = (1 - unseen) * (table + PRIOR * share) / (table.sum(axis=1, keepdims=True) + PRIOR)
    following[:, -1] += unseen
    return np.log10(np.maximum(following, 1e-300)), np.log10(np.maximum(size + members, 1))  # 0 only for classes without words


def _around(shared):
    """Of each word out of the lexicon in each text: the classes before and after it, as pairs of 16-bit codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, k = shared.value
        other = len(classes) - 1
        for b in batches:
            for lo, hi in common.pieces(b.column(0), 4 * PIECE):
                column, rest = b.column(0)[lo:hi], b.column(1)[lo:hi]
                ids = np.frombuffer(b"".join((bytes(4), *column.to_pylist())), "<i4")
                of = classes[np.minimum(ids, other)]
                many = np.asarray(pc.list_value_length(rest), np.int64)
                at = np.flatnonzero(ids >= other)
                owner = np.searchsorted(np.cumsum(np.asarray(pc.binary_length(column), np.int64) // 4), at - 1, "right")
                word = (np.cumsum(many) - many)[owner] + ids[at] - other
                order = np.argsort(word, kind="stable")
                at = at[order]
                near = np.stack((of[at - 1], k + of[at + 1]), axis=1).astype("<u2")
                ends = np.cumsum(np.bincount(word, minlength=int(many.sum())))
                offsets = np.concatenate(([0], ends * 4)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rest.flatten(), pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(near.tobytes())])], ["word", "near"])

    return common.releasing(run)


def _best(table: np.ndarray, near: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The classes that fit words best, all by the same table. near: their neighbours' codes, in a row; counts: how many are each word's."""
    k = len(table)
    owner = np.repeat(np.arange(len(counts)), counts)
    key, times = np.unique(owner * (2 * k) + near, return_counts=True)
    owner, code = np.divmod(key, 2 * k)
    kinds, which = np.unique(code * (1 << 40) + times, return_inverse=True)
    code, times = np.divmod(kinds, 1 << 40)
    cells = np.where(code[:, None] < k, table[np.minimum(code, k - 1)], table.T[np.maximum(code, k) - k])
    gains = _xlogx(cells + times[:, None]) - _xlogx(cells)
    first, n = np.searchsorted(owner, np.arange(len(counts))), counts[:, None] / 2
    out = np.empty(len(counts), np.int64)
    left, right = table.sum(axis=1), table.sum(axis=0)
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(first, first[a] + NEAR_HELD)))
        own = np.add.reduceat(gains[which[first[a] : first[b] if b < len(first) else None]], first[a:b] - first[a])
        for side in (left, right):
            own -= _xlogx(side + n[a:b]) - _xlogx(side)
        out[a:b] = own[:, : k - 2].argmax(axis=1)
        a = b
    return out


def _placing(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            parts = lists.flatten()
            near = np.frombuffer(b"".join(parts.to_pylist()), "<u2").astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.binary_length(parts), np.int64) // 2)))
            counts = np.diff(ends[np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(lists), np.int64))))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts // 2), pa.array(_best(table, near, counts))], ["word", "n", "cls"])

    return common.releasing(run)


def _placed(coded: DataFrame, model: Model, table: np.ndarray) -> DataFrame:
    """word, n and cls of every training word out of the lexicon: the class that fits the words around it best.

    The table is that of the lexicon's classes, with all of these words in the last. None of them is frequent, so that
    a word's neighbours are few enough for a row.
    """
    shared = coded.sparkSession.sparkContext.broadcast((model.classes, len(table)))
    near = coded.where(F.size("rest") > 0).select("ids", "rest").mapInArrow(_around(shared), "word binary, near binary")
    return common.stored(near.groupBy("word").agg(F.collect_list("near").alias("near")).mapInArrow(_placing(table), "word binary, n long, cls long"), "rare")


def _choose(table, left, right, after, before, own: int) -> np.ndarray:
    """What a word gains in each class, from the cells that it has a part in only; it is taken out of its own class first."""
    a, b = np.flatnonzero(after), np.flatnonzero(before)
    rows, columns = table[:, a], table[b, :]
    rows[own] -= after[a]
    columns[:, own] -= before[b]
    rows[:, a == own] -= before[:, None]
    columns[b == own] -= after
    np.maximum(rows, 0, out=rows)
    np.maximum(columns, 0, out=columns)
    out_of, into = np.zeros(len(left)), np.zeros(len(left))
    out_of[own], into[own] = after.sum(), before.sum()
    left, right = np.maximum(left - out_of, 0), np.maximum(right - into, 0)
    gain = (_xlogx(rows + after[a]) - _xlogx(rows)).sum(axis=1) + (_xlogx(columns + before[b, None]) - _xlogx(columns)).sum(axis=0)
    return gain - (_xlogx(left + after.sum()) - _xlogx(left)) - (_xlogx(right + before.sum()) - _xlogx(right))


def _classer(shared):
    """Each text's tokens, those known, the sum of their log10(count + 1), and their classes; unseen words are in the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, log_base, k, kind = shared.value
        other = len(classes) - 1
        for b in batches:
            for lo, hi in common.pieces(b.column(2), 4 * PIECE):
                column, found = b.column(2)[lo:hi], b.column(3)[lo:hi]
                ids = np.frombuffer(b"".join(column.to_pylist()), "<i4")
                lengths = np.asarray(pc.binary_length(column), np.int64) // 4
                at = np.cumsum(lengths) - lengths
                many = np.maximum(np.maximum.reduceat(ids, at) - other + 1, 0).astype(np.int64)
                before = np.cumsum(many) - many
                rare_n, rare_of = np.zeros(many.sum(), np.int64), np.full(many.sum(), k - 1)
                x = found.flatten()
                where = np.repeat(before, np.asarray(pc.list_value_length(found).fill_null(0), np.int64)) + np.asarray(x.field("j"))
                rare_n[where], rare_of[where] = np.asarray(x.field("n")), np.asarray(x.field("cls"))
                inside = np.minimum(ids, other)
                of, log_n = classes[inside].astype(np.int64), np.append(log_base, 0.0)[inside]
                rare = np.flatnonzero(ids >= other)
                word = np.repeat(before, lengths)[rare] + ids[rare] - other
                of[rare], log_n[rare] = rare_of[word], np.log10(rare_n + 1.0)[word]
                raw, width = of.astype(kind).tobytes(), np.dtype(kind).itemsize
                own = [raw[s:e] for s, e in zip((at * width).tolist(), ((at + lengths) * width).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(lengths), pa.array(np.add.reduceat((log_n > 0).astype(np.int64), at)), pa.array(np.add.reduceat(log_n, at)), pa.array(own, pa.binary())],
                    ["doc_id", "train", "n_tokens", "n_known", "base", "classes"],
                )

    return common.releasing(run)


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_next, log_size, kind = shared.value
        for b in batches:
            for lo, hi in common.pieces(b.column(4), 2 * PIECE):
                lengths = np.asarray(b.column(1)[lo:hi], np.int64)
                of = np.concatenate(([len(log_size) - 2], np.frombuffer(b"".join(b.column(4)[lo:hi].to_pylist()), kind).astype(np.int64)))
                sums = np.add.reduceat(log_next[of[:-1], of[1:]] - log_size[of[1:]], np.cumsum(lengths) - lengths)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:4]), pa.array(sums + np.asarray(b.column(3)[lo:hi]))], ["doc_id", "n_tokens", "n_known", "base", "score"])

    return common.releasing(run)


def score(docs: DataFrame, is_training, *, id_col: str = "doc_id", text_col: str = "text", least_share: int | None = None, first: int = FIRST, classes: int = CLASSES, sweeps: int = SWEEPS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    is_training: a condition on docs that tells which rows the model learns from; a null counts as false. Words are
    runs of other than blanks, A-Z lower-cased; each text ends with a token of its own, so null and empty texts have
    one token. Repeated rows each count and are each scored. Without training rows all words are unseen.

    Every training word has one of the classes: after fit(), the words out of its lexicon choose by the words around
    them too, in tasks, and the table of classes is counted anew. Only where least_share is given, words rarer than
    one token in so many share one class, as in fit().
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(is_training, F.lit(False)).alias("train"), common.texts(docs, text_col).alias("text"))
    counts = common.stored(raw.where("train").select("text").mapInArrow(common.releasing(_counted), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    names, n, total, types = _lexicon(counts, least_share or LEAST_SHARE)
    coded = _coded(raw, {w: i for i, w in enumerate(names)})
    train = coded.where("train")
    model, table = _fitted(train, names, n, total, types, first, classes, sweeps, rounds)
    k = classes + 2
    if least_share is None:
        rare = _placed(train, model, table)
    else:
        rare = counts.where((F.col("n") < -(-total // least_share)) & (F.length("word") > 0)).withColumn("cls", F.lit(k - 1).cast("long"))
    kind = f"<u{np.min_scalar_type(k).itemsize}"
    context = docs.sparkSession.sparkContext
    found = coded.select("row", F.posexplode("rest").alias("j", "word")).join(rare, "word").groupBy("row").agg(F.collect_list(F.struct("j", "n", "cls")).alias("found"))
    columns = T.StructType([raw.schema["doc_id"]]).add("train", "boolean").add("n_tokens", "long").add("n_known", "long").add("base", "double").add("classes", "binary")
    classed = coded.drop("rest").join(found, "row", "left").select("doc_id", "train", "ids", "found")
    classed = common.stored(classed.mapInArrow(_classer(context.broadcast((model.classes, model.log_base, k, kind))), columns), "classed")
    log_next, log_size = model.log_next, model.log_size
    if least_share is None:
        size, members = np.bincount(model.classes[:-1], weights=n, minlength=k), np.bincount(model.classes[:-1], minlength=k).astype(np.float64)
        for r in rare.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            size[r.cls] += r.n
            members[r.cls] += r.words
        members[k - 1] += 1
        pairs = _count_pairs(classed.where("train").select("classes"), kind, k, k, _listed_pairs).astype(np.float64)
        log_next, log_size = _estimated(pairs, size, members)
    scored = classed.select("doc_id", "n_tokens", "n_known", "base", "classes").mapInArrow(_scorer(context.broadcast((log_next, log_size, kind))), T.StructType([raw.schema["doc_id"]]).add("n_tokens", "long").add("n_known", "long").add("base", "double").add("score", "double"))
    unit = float(np.log10(max(1, total + types + 1)))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score")


def op1_brown_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = common.crc_bucket(F.col("doc_id"), 7) == 2
    out = score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op1_brown_score": op1_brown_score}
ORACLES: dict[str, str] = {}
