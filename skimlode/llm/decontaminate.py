"""Benchmark decontamination: a broadcast hash set of the test windows, scanned over every document's words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words: A-Z lower-cased, then runs of digits, a-z and anything beyond ASCII.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^ ]+")
WINDOW = 13
#: Bytes of benchmark text that one broadcast may hold; a larger benchmark is scanned in so many blocks.
BLOCK_BYTES = 8 << 20
PIECE = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The id of each word, -1 for one that no benchmark item has. Long texts are split piece by piece, at spaces."""
    folded, at, parts = text.translate(FOLD), 0, []
    while at < len(folded):
        to = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        to = len(folded) if to < 0 else to
        words = folded[at:to].split()
        parts.append(np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int32, len(words)))
        at = to
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


class Windows:
    """The windows of a bounded block of items: by length, their sorted distinct hashes, where one with each hash is, and its items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        parts, by_length, at = [np.empty(0, np.int32)], {}, 0
        for name, text in items:
            words = text.translate(FOLD).split()
            parts.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32))
            if n := min(window, len(words)):
                by_length.setdefault(n, []).append((at, len(words) - n + 1, number[name]))
            at += len(words)
        self.ids = np.concatenate(parts)
        self.by_length = {n: self._indexed(own, n) for n, own in by_length.items()}

    def _indexed(self, own: list[tuple[int, int, int]], n: int) -> tuple:
        starts = np.concatenate([np.arange(at, at + k) for at, k, _ in own])
        owner = np.repeat(np.array([x for _, _, x in own], np.int32), [k for _, k, _ in own])
        for seed in range(1 << 30):  # the first one does, but for a chance of two windows with the same hash
            hashes = _hashes(self.ids, starts, n, seed)
            order = np.lexsort((owner, hashes))
            hashes, at, of = hashes[order], starts[order], owner[order]
            head = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            place = np.cumsum(head) - 1
            one = at[head]
            if all((self.ids[at + j] == self.ids[one[place] + j]).all() for j in range(n)):
                break
        keep = head | np.concatenate(([True], of[1:] != of[:-1]))
        return seed, hashes[head], one, np.concatenate((np.flatnonzero(head[keep]), [np.count_nonzero(keep)])), of[keep]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """Start, length and items of each window that occurs; ids may hold many documents, -1 between them."""
        known = np.concatenate(([0], np.cumsum(ids >= 0)))
        for n, (seed, hashes, one, bounds, owners) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            found = _hashes(ids, at, n, seed)
            place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            met = np.flatnonzero(hashes[place] == found)
            for j in range(n):
                met = met[self.ids[one[place[met]] + j] == ids[at[met] + j]]
            for k in met:
                own = owners[bounds[place[k]] : bounds[place[k] + 1]]
                yield int(at[k]), n, {self.names[x] for x in own}


def _hashes(ids: np.ndarray, at: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    out = np.full(len(at), seed, np.uint64)
    for j in range(n):
        out = (out ^ (ids[at + j].astype(np.uint64) + np.uint64(1))) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> list[Windows]:
    """The benchmark, in blocks of bounded size: one unless it is large."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), common.texts(benchmark, text_col).alias("text"))
    size = items.agg(F.sum(F.length("text") + F.length("name") + 16)).first()[0] or 0
    n = -(-size // block_bytes)
    part = F.pmod(F.xxhash64("name", "text"), F.lit(max(1, n)))
    return [Windows([(r.name, bytes(r.text)) for r in items.where(part == k).toLocalIterator()], window) for k in range(n)]


def _word_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The bytes of runs of words: from a run's first word to its last."""
    bounds = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [(bounds[a][0], bounds[b - 1][1]) for a, b in zip(starts, ends)]


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, leak_col: str = "_leak") -> DataFrame:
    """All rows and columns of docs, and a struct column `leak_col`.

    Its fields: n_words, n_hit (words inside any occurrence of a benchmark window), items (ids of the items whose
    windows occur, as sorted strings) and spans (byte runs of the hit words, as start and end in turn).
    A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window.
    Null and empty texts have no words and no hits; so has any text if the benchmark is empty. Repeated rows are
    scanned each for itself. A null item id counts as the empty string. A column of docs with that name is replaced.
    No shuffle. A benchmark over block_bytes is scanned in several broadcast blocks, one after the other.
    """
    common.bound_batches(spark := docs.sparkSession)
    kept = docs.drop(leak_col)
    leak = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.LongType()))
    schema = T.StructType(kept.schema.fields + [T.StructField(leak_col, leak)])
    out = kept.withColumn(leak_col, F.lit(None).cast(leak))
    for block in _blocks(benchmark, item_id_col, item_text_col, window, block_bytes) or [Windows([], window)]:
        out = out.mapInArrow(common.releasing(_scanner(spark.sparkContext.broadcast(block), text_col)), schema)
    return out


def _scanner(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            before = batch.column(batch.num_columns - 1)
            for lo, hi in common.pieces(column, 4 * PIECE):
                rows = _scan_rows([x or b"" for x in column[lo:hi].to_pylist()], before[lo:hi].to_pylist(), block)
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), pa.array(rows, batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    return run


def _scan_rows(texts: list[bytes], before: list[dict | None], block: Windows) -> list[dict]:
    each = [word_ids(t, block.vocabulary) for t in texts]
    gap = np.array([-1], np.int32)
    ids = np.concatenate([x for y in each for x in (y, gap)])
    starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in each])))
    found: dict[int, list[tuple[int, int, set[str]]]] = {}
    for at, n, names in block.hits(ids):
        doc = int(np.searchsorted(starts, at, "right")) - 1
        found.setdefault(doc, []).append((at - int(starts[doc]), n, names))
    rows = []
    for k, text in enumerate(texts):
        old = before[k] or {"n_hit": 0, "items": [], "spans": []}
        row = {"n_words": len(each[k]), "n_hit": old["n_hit"], "items": old["items"], "spans": old["spans"]}
        if k in found:
            row |= _merged(text, found[k], old, len(each[k]))
        rows.append(row)
    return rows


def _merged(text: bytes, hits: list, old: dict, n_words: int) -> dict:
    cover = np.zeros(n_words + 1, np.int64)
    for at, n, _ in hits:
        cover[at] += 1
        cover[at + n] -= 1
    hit = np.cumsum(cover[:-1]) > 0
    if old["spans"]:  # of an earlier block
        for i, (a, b) in enumerate(m.span() for m in WORD.finditer(text.translate(FOLD))):
            hit[i] |= any(lo <= a and b <= hi for lo, hi in zip(old["spans"][::2], old["spans"][1::2]))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    spans = _word_bytes(text, edges[::2], edges[1::2])
    return {"n_hit": int(hit.sum()), "items": sorted({x for h in hits for x in h[2]} | set(old["items"])), "spans": [x for s in spans for x in s]}


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, most_share: float = 0.05, text_col: str = "text", **options) -> DataFrame:
    """The columns of docs, without what the benchmark holds.

    A document of whose words most_share or more are hit goes; of others, the hit spans are cut out of the text.
    Documents without a hit stay as they are, null and empty texts too. Options: those of scan().
    """
    name = common.fresh(docs, "_leak")
    found = scan(docs, benchmark, text_col=text_col, leak_col=name, **options)
    leak = F.col(name)
    stays = (leak.n_hit == 0) | (leak.n_hit < leak.n_words * F.lit(float(most_share)))
    return cut_spans(found.where(stays), text_col).select(*docs.columns)


def cut_spans(found: DataFrame, text_col: str) -> DataFrame:
    """The text without the spans of the last column; texts without spans don't leave the JVM's rows unchanged."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            spans = batch.column(batch.num_columns - 1).field("spans").to_pylist()
            if any(spans):
                values = batch.column(i).cast(pa.binary()).to_pylist()
                for k, s in enumerate(spans):
                    if s:
                        keep = zip([0, *s[1::2]], [*s[::2], len(values[k])])
                        values[k] = b"".join(values[k][a:b] for a, b in keep)
                new = pa.array(values, pa.binary()).cast(batch.column(i).type)
                batch = batch.set_column(i, batch.schema.field(i), new)
            yield batch

    return found.mapInArrow(common.releasing(cut), found.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leak = F.col("_leak")
    return found.select(
        "doc_id", leak.n_words.alias("n_words"), leak.n_hit.alias("n_hit"), F.size(leak.items).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak.items, ",").cast("binary"), 256).alias("items_sha256"), ((leak.n_hit > 0) & (leak.n_hit * 20 >= leak.n_words)).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(13, len(w)) AS n FROM items WHERE len(w) > 0),
at_item AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM at_item),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
at_doc AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) AS lengths WHERE len(w) >= n),
found AS (SELECT d.doc_id, d.i, d.n, x.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM at_doc) AS d JOIN windows AS x USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) AS t GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) AS t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(m.n_items, 0) AS n_items,
       sha256(coalesce(m.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs AS d LEFT JOIN hit AS h USING (doc_id) LEFT JOIN named AS m USING (doc_id)
"""
QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES = {"op9_decontaminate": OP9_SQL}
