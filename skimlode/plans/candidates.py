"""Which blocks might hold a pattern: masks of elements per block, and windows over a file's blocks.

A block's mask says which elements (bytes and pairs) of a pattern it has; the rest is window functions of one
partitioning, so one shuffle of narrow rows, whatever the number of patterns or the block size. Files are cut into
stretches of blocks, with a few of the neighbours' blocks at either end, so that a large file isn't one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import blooms, vectors
from ..operators.filters import ByteFilter, NgramFilter, byte_in, pair_in
from ..operators.ranges import merge_adjacent

#: Elements of a mask, bytes of patterns that are broadcast at once, and blocks of a stretch.
MASK_BITS, PATTERN_BYTES, STRETCH = 62, 8 << 20, 4096
#: Cells of a table of flags that is held at once.
CELLS = 1 << 25
Element = tuple[str, int]


def _in_file():
    return Window.partitionBy("file_id", "stretch").orderBy("block_id")


def stretched(rows: DataFrame, before: int, after: int, place: str = "block_id", least: int | None = None) -> DataFrame:
    """rows with their stretch, and again in stretches that need them: `before` places ahead of a stretch and `after` behind it."""
    size = max(STRETCH if least is None else least, 4 * (before + after))
    own, inside = F.floor(F.col(place) / size), F.pmod(place, F.lit(size))
    earlier = F.when((inside < after) & (own > 0), F.array(own - 1)).otherwise(F.array().cast("array<long>"))
    later = F.when(inside >= size - before, F.array(own + 1)).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("stretch", F.explode(F.concat(F.array(own), earlier, later))).withColumn("whole", F.col("stretch") == F.floor(F.col(place) / size))


def data_tests(element: Element) -> Column:
    """Tests against the block's own bytes: the same as exact pairs, without building them."""
    return byte_in(F.col("own"), element[1]) if element[0] == "byte" else pair_in(F.col("ext"), element[1])


def index_tests(bits: int | None = None):
    """Tests against a stored summary: exact pairs, or bloom bits if `bits` is given."""

    def test(element: Element) -> Column:
        if element[0] == "byte":
            return F.array_contains("bytes_present", element[1])
        if bits is None:
            return F.array_contains("pairs", element[1])
        return blooms.bloom_has(F.col("words"), element[1], bits)

    return test


def clauses(byte: ByteFilter | None, ngram: NgramFilter | None) -> list[list[list[Element]]]:
    """Clauses that must all hold; of a clause any pattern; of a pattern all elements.

    Both filters with as many patterns are paired one by one; else each is a clause of its own.
    """
    bytes_ = [[("byte", b) for b in r] for r in byte.requirements] if byte is not None else None
    pairs = [[("pair", p) for p in r] for r in ngram.requirements] if ngram is not None else None
    if bytes_ is None or pairs is None:
        return [bytes_ if pairs is None else pairs]
    return [[b + p for b, p in zip(bytes_, pairs)]] if len(bytes_) == len(pairs) else [bytes_, pairs]


def span(longest: int, block_size: int) -> int:
    """Blocks that a match can touch."""
    return max(-(-longest // block_size), 1) + 1


class _Masks:
    """Mask columns of each pattern, and what their union over some blocks says."""

    def __init__(self, wanted: list[list[list[Element]]], test):
        self.columns: dict[str, Column] = {}
        self.shape: list[list[list[tuple[str, int]]]] = []
        for c, patterns in enumerate(wanted):
            self.shape.append([])
            for r, elements in enumerate(patterns):
                own = []
                for k in range(0, len(elements), MASK_BITS):
                    name = f"_m{c}_{r}_{k}"
                    part = elements[k : k + MASK_BITS]
                    mask = F.lit(0).cast("long")
                    for i, e in enumerate(part):
                        mask = mask + F.when(test(e), F.lit(1 << i)).otherwise(F.lit(0).cast("long"))
                    self.columns[name] = mask
                    own.append((name, (1 << len(part)) - 1))
                self.shape[-1].append(own)

    def full(self, union) -> Column:
        """union: of a mask's name, its union over the blocks in question."""
        out = F.lit(True)
        for patterns in self.shape:
            one = F.lit(False)
            for own in patterns:
                all_ = F.lit(True)
                for name, want in own:
                    all_ = all_ & (union(name) == F.lit(want))
                one = one | all_
            out = out & one
        return out

    def any(self) -> Column:
        out = F.lit(False)
        for name in self.columns:
            out = out | (F.col(name) != 0)
        return out


def candidate_blocks(blocks: DataFrame, block_size: int, byte: ByteFilter | None = None, ngram: NgramFilter | None = None, test=data_tests) -> DataFrame:
    """file_id, block_id, offset, length of all candidate blocks, before merging.

    blocks: rows with file_id, block_id, offset, length and what `test` looks at. Matches inside a block, across two,
    and (with an n-gram filter) across more are found; a match inside a block keeps wider ones that end there from
    being looked for.
    """
    wanted = clauses(byte, ngram)
    masks = _Masks(wanted, test)
    wide = span(ngram.max_pattern_bytes, block_size) if ngram is not None else 2
    rows = stretched(blocks.select("file_id", "block_id", "offset", "length", *[c.alias(n) for n, c in masks.columns.items()]), wide - 1, wide)
    before = lambda name: F.col(name).bitwiseOR(F.coalesce(F.lag(name).over(_in_file()), F.lit(0).cast("long")))
    window = _in_file().rowsBetween(-(wide - 1), 0)
    many = masks.full(lambda name: F.bit_or(F.col(name)).over(window)) if wide >= 3 else F.lit(False)
    return resolve(rows.select("file_id", "stretch", "whole", "block_id", "offset", "length", masks.full(F.col).alias("s"), masks.full(before).alias("p"), many.alias("m"), masks.any().alias("some")), wide)


def resolve(rows: DataFrame, wide: int) -> DataFrame:
    """Candidates from what each block is: s a match inside it, p with the one before, m over `wide` blocks that end in it."""
    alone = ~F.col("s")
    pair = alone & F.col("p") & (F.col("block_id") >= 1)
    rows = rows.withColumn("p2", pair).withColumn("m2", alone & ~pair & F.col("m") & (F.col("block_id") >= 2))
    base = F.col("s") | F.col("p2") | F.coalesce(F.lead("p2").over(_in_file()), F.lit(False))
    if wide >= 3:
        base = base | F.max("m2").over(_in_file().rowsBetween(0, wide - 1))
    rows = rows.withColumn("base", base)
    found = F.col("base") | (F.coalesce(F.lead("base").over(_in_file()), F.lit(False)) & F.col("some"))
    return rows.withColumn("found", found).where("found AND whole").select("file_id", "block_id", "offset", "length")


def strict_blocks(blocks: DataFrame, block_size: int, patterns: Sequence[bytes], test=data_tests) -> DataFrame:
    """Candidates that cover every block of every true match, whatever else matches nearby.

    For each pattern and each number of blocks that it can span: the first block has the pattern's first byte, the last
    one its last byte, and together they have all elements.
    """
    patterns = [p for p in dict.fromkeys(patterns) if p]
    elements = [[("byte", b) for b in sorted(set(p))] + [("pair", a << 8 | b) for a, b in sorted(set(zip(p[:-1], p[1:])))] for p in patterns]
    masks = _Masks([elements], test)
    ends = {f"_f{k}": test(("byte", p[0])) for k, p in enumerate(patterns)} | {f"_l{k}": test(("byte", p[-1])) for k, p in enumerate(patterns)}
    widths = sorted({w for p in patterns for w in range(1, span(len(p), block_size) + 1)})
    most = max(widths, default=1)
    rows = stretched(blocks.select("file_id", "block_id", "offset", "length", *[c.alias(n) for n, c in (masks.columns | ends).items()]), most - 1, most)
    for w in widths:
        match = F.lit(False)
        for k, p in enumerate(patterns):
            if w <= span(len(p), block_size):
                first = F.col(f"_f{k}") if w == 1 else F.lag(f"_f{k}", w - 1).over(_in_file())
                all_ = F.coalesce(first, F.lit(False)) & F.col(f"_l{k}")
                for name, want in masks.shape[0][k]:
                    all_ = all_ & (F.bit_or(F.col(name)).over(_in_file().rowsBetween(-(w - 1), 0)) == F.lit(want))
                match = match | all_
        rows = rows.withColumn(f"_w{w}", match)
    found = F.lit(False)
    for w in widths:
        found = found | F.max(f"_w{w}").over(_in_file().rowsBetween(0, w - 1))
    return rows.withColumn("found", found).where("found AND whole").select("file_id", "block_id", "offset", "length")


class _Patterns:
    """Some patterns' elements, numbered: bytes by themselves, pairs by their code and 256."""

    def __init__(self, patterns: Sequence[bytes]):
        needs = [sorted(set(p) | {256 + q for q in blooms.pattern_pairs(p)}) for p in dict.fromkeys(patterns)]
        self.elements = np.array(sorted({e for n in needs for e in n}), np.int64)
        self.number = np.full(256 + 65_536, -1, np.int64)
        self.number[self.elements] = np.arange(len(self.elements))
        self.needs = [self.number[n] for n in needs]

    def present(self, ext: pa.Array, length: np.ndarray) -> np.ndarray:
        """Elements by blocks: what each block has. ext: its bytes after the one before it, if there is one."""
        data, starts = vectors.raw_bytes(ext)
        rows = np.repeat(np.arange(len(ext)), np.diff(starts))
        own = np.ones(len(data), bool)
        own[starts[:-1][np.diff(starts) > length]] = False
        out = np.zeros((len(self.elements), len(ext)), bool)
        inside = rows[1:] == rows[:-1]
        for codes, at in ((data[own].astype(np.int64), rows[own]), (256 + (data[:-1].astype(np.int64) << 8 | data[1:])[inside], rows[:-1][inside])):
            number = self.number[codes]
            out[number[number >= 0], at[number >= 0]] = True
        return out

    def flags(self, present: np.ndarray, known: np.ndarray, wide: int) -> tuple[np.ndarray, ...]:
        """Of each block: whether a pattern is all in it, in it and the one before, in `wide` blocks that end in it; and any element.

        known: how many blocks before each are of its stretch. Only blocks with a pattern's rarest element are looked at.
        Three tables of flags are held, however wide the longest pattern is.
        """
        two = _united(present, known, min(2, wide))
        many = two if wide <= 2 else _united(present, known, wide)
        often = many.sum(axis=1)
        found = [np.zeros(present.shape[1], bool) for _ in range(3)]
        for need in self.needs:
            at = np.flatnonzero(many[need[often[need].argmin()]])
            for out, union in zip(found[::-1], (many, two, present)):
                at = at[union[np.ix_(need, at)].all(axis=0)]
                out[at] = True
        return (*found, present.any(axis=0))


def _united(present: np.ndarray, known: np.ndarray, wide: int) -> np.ndarray:
    """Of each block, what it and the wide - 1 blocks before it have, as far as they are of its stretch: unions of doubled width, one table at a time."""
    out, have = present, 1
    while have < wide:
        step = min(have, wide - have)
        n = out.shape[1] - step
        more = out.copy()
        if n > 0:
            np.logical_or(more[:, step:], out[:, :n], out=more[:, step:], where=known[step:] >= step)
        out, have = more, have + step
    return out


def _flagger(shared, wide: int):
    """Rows in order of file, stretch and block: s, p, m and some, besides those of earlier patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: _Patterns = shared.value
        step = max(64, CELLS // max(1, len(patterns.elements)))
        held: pa.Table | None = None
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = pa.Table.from_batches([batch.slice(lo, step)])
                old = 0 if held is None else held.num_rows
                both = (part if held is None else pa.concat_tables([held, part])).combine_chunks()
                group = both.column("group").to_numpy()
                heads = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), np.arange(len(group)), 0))
                ext = both.column("ext").combine_chunks()
                ext = ext.chunk(0) if isinstance(ext, pa.ChunkedArray) else ext
                present = patterns.present(ext, both.column("length").to_numpy())
                found = patterns.flags(present, np.arange(len(group)) - heads, wide)
                out = part
                for name, f in zip(("s", "p", "m", "some"), found):
                    before = part.column(name).to_numpy(zero_copy_only=False)
                    out = out.set_column(out.schema.get_field_index(name), name, pa.array(f[old:] | before))
                yield from out.combine_chunks().to_batches()
                held = both.slice(max(0, both.num_rows - wide + 1))

    return run


def _parts_of(patterns: DataFrame, most: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for r in patterns.toLocalIterator():
        if held and size + len(r.pattern) > most:
            yield held
            held, size = [], 0
        held.append(bytes(r.pattern))
        size += len(r.pattern)
    if held:
        yield held


def candidate_blocks_long(blocks: DataFrame, block_size: int, patterns: DataFrame, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The paired query for many patterns, given as rows (pattern_id, pattern).

    Blocks are shuffled once, by file and stretch, and each batch of them is held against all patterns: a pattern's
    rarest element in the batch says which blocks can have it, and only these are tested for the rest. Patterns are
    broadcast in parts of pattern_bytes, one pass after the other. No row is made for an element or a pattern.
    """
    rows = patterns.where(F.length("pattern") > 0).select(F.col("pattern").cast("binary").alias("pattern")).distinct()
    longest = rows.agg(F.max(F.length("pattern"))).first()[0] or 0
    wide = span(longest, block_size)
    no = [F.lit(False).alias(c) for c in ("s", "p", "m", "some")]
    out = stretched(blocks.select("file_id", "block_id", "offset", F.col("length").cast("long").alias("length"), "ext", *no), wide - 1, wide)
    out = out.withColumn("group", F.xxhash64("file_id", "stretch")).repartition("file_id", "stretch").sortWithinPartitions("file_id", "stretch", "block_id")
    spark, schema = blocks.sparkSession, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for part in _parts_of(rows, pattern_bytes):
        out = out.mapInArrow(_flagger(spark.sparkContext.broadcast(_Patterns(part)), wide), schema)
    return resolve(out.select("file_id", "stretch", "whole", "block_id", "offset", "length", "s", "p", (F.col("m") & F.lit(wide >= 3)).alias("m"), "some"), wide)


def candidate_ranges(*args, **options) -> DataFrame:
    """candidate_blocks(), with adjacent ranges merged."""
    return merge_adjacent(candidate_blocks(*args, **options))
