"""Language identification by bit-sliced Bloom filters of character n-grams.

A slot of the filter holds a bit for each language, so that the slots of an n-gram, and-ed, are the mask of all
languages for which it is typical. A document's n-grams are counted for each language, false positives taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZES = (2, 3, 4)
PROBES = 3
SLOTS = 1 << 20
#: N-grams of a language that its filter holds at most, how often one must occur, and its share of the highest rate in any language.
GRAMS, LEAST, SHARE = 20_000, 3, 0.5
#: The bounded sample of labelled rows that the filters are fitted to: documents and bytes of a language at most.
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 6 << 20
PIECE_CHARS = 1 << 20
UNKNOWN = "und"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, 0 for what is no letter, with a 0 at either end."""
    points = np.frombuffer(("\0" + text.lower() + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(letters()[points], points, 0)


def _grams(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams and where they start: within a word, or with one of its ends."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = codes > 0
    ok = np.ones(count, bool)
    for j in range(1, n - 1):
        ok &= word[j : j + count]
    if n == 2:
        ok &= word[:count] | word[1 : count + 1]
    at = np.flatnonzero(ok)
    key = np.full(len(at), n, np.uint64)
    for j in range(n):
        key = (key + codes[at + j]) * _MULTIPLIER
        key ^= key >> np.uint64(31)
    return key, at


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # SLOTS masks of 64 languages each, as many columns as the languages need
    false: np.ndarray  # the rate of false positives of each language

    def masks(self, keys: np.ndarray) -> np.ndarray:
        out = None
        for p in range(PROBES):
            mixed = (keys ^ np.uint64(p * 0x51ED27)) * np.uint64(0xD6E8FEB86659FD93 + 2 * p)
            found = self.slots[(mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)]
            out = found if out is None else out & found
        return out

    def add(self, keys: np.ndarray, language: int) -> None:
        for p in range(PROBES):
            mixed = (keys ^ np.uint64(p * 0x51ED27)) * np.uint64(0xD6E8FEB86659FD93 + 2 * p)
            self.slots[(mixed >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64), language // 64] |= np.uint64(1 << language % 64)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        n, k = len(texts), len(self.languages)
        hits, grams, any_letter = np.zeros((n, k)), np.zeros(n), np.zeros(n, bool)
        for owner, starts, codes in _pieces(texts):
            any_letter[owner] |= np.logical_or.reduceat(codes > 0, starts)
            for size in SIZES:
                keys, at = _grams(codes, size)
                if not len(keys):
                    continue
                bounds = np.searchsorted(at, np.append(starts, len(codes)))
                np.add.at(grams, owner, np.diff(bounds))
                masks = self.masks(keys)
                for i in range(k):
                    total = np.concatenate(([0], np.cumsum((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1), dtype=np.int64)))
                    np.add.at(hits[:, i], owner, total[bounds[1:]] - total[bounds[:-1]])
        if not k:
            return [UNKNOWN] * n, [0.0] * n
        fixed = np.maximum(0, (hits - grams[:, None] * self.false) / (1 - self.false))
        best = fixed.argmax(axis=1)
        total = fixed.sum(axis=1)
        score = np.where(any_letter & (total > 0), fixed[np.arange(n), best] / np.maximum(total, 1e-300), 0.0)
        return [self.languages[b] if a else UNKNOWN for a, b in zip(any_letter, best)], score.tolist()


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of many texts in a row, with the owner and start of each; long texts in pieces that overlap by less than an n-gram."""
    owner, parts, held = [], [], 0
    most = max(SIZES) - 1
    for i, text in enumerate(texts):
        whole = _codes(text)
        for at in range(0, max(1, len(whole) - most), PIECE_CHARS):
            part = whole[at : at + PIECE_CHARS + most]
            owner.append(i)
            parts.append(part)
            held += len(part)
            if held >= PIECE_CHARS:
                yield _joined(owner, parts)
                owner, parts, held = [], [], 0
    if parts:
        yield _joined(owner, parts)


def _joined(owner, parts):
    return np.array(owner), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])), np.concatenate(parts)


class _Counts:
    """Distinct keys and their counts, merged whenever enough new ones are there."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.new: list[np.ndarray] = []
        self.held = 0

    def add(self, text: str) -> None:
        codes = _codes(text)
        for n in SIZES:
            self.new.append(_grams(codes, n)[0])
            self.held += len(self.new[-1])
        if self.held > 1 << 19:
            self.merge()

    def merge(self) -> _Counts:
        if self.new:
            keys, counts = np.unique(np.concatenate(self.new), return_counts=True)
            both, at = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate((self.counts, counts)))
            self.keys, self.counts, self.new, self.held = both, total, [], 0
        return self


def fit_texts(samples: dict[str, list[str]]) -> Filters:
    counts = {name: _Counts() for name in samples}
    for name, texts in samples.items():
        for t in texts:
            counts[name].add(t)
    return _filters(counts)


def _filters(counts: dict[str, _Counts]) -> Filters:
    """Filters of the n-grams that are typical of each language: often there, and not much rarer than anywhere else."""
    names = sorted(counts)
    counted = [(c.keys, c.counts) for c in (counts[name].merge() for name in names)]
    every = np.unique(np.concatenate([k for k, _ in counted])) if names else np.empty(0, np.uint64)
    highest = np.zeros(len(every))
    for keys, n in counted:
        at = np.searchsorted(every, keys)
        highest[at] = np.maximum(highest[at], n / max(1, n.sum()))
    out = Filters(names, np.zeros((SLOTS, max(1, -(-len(names) // 64))), np.uint64), np.zeros(len(names)))
    for i, (keys, n) in enumerate(counted):
        typical = np.flatnonzero((n >= LEAST) & (n / max(1, n.sum()) >= SHARE * highest[np.searchsorted(every, keys)]))
        typical = typical[np.lexsort((keys[typical], -n[typical]))][:GRAMS]
        out.add(keys[typical], i)
        out.false[i] = (np.count_nonzero(out.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / SLOTS) ** PROBES
    return out


def fit(labelled: DataFrame, *, lang_col: str = "lang", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Filters:
    """Filters from a sample of the labelled rows: of each language the documents with the smallest hashes of their texts.

    Each distinct text counts once. Rows without a label or text teach nothing, nor do texts over an eighth of sample_bytes. The driver counts the
    sample text by text, and keeps its distinct n-grams only. A language's filter holds its GRAMS most frequent typical n-grams
    at most, LEAST times there or more: rarer ones are not learned.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col) <= sample_bytes // 8)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["count"] for r in usable.select("lang", F.xxhash64("text").alias("hash")).distinct().groupBy("lang").count().collect()}
    if not counts:
        return fit_texts({})
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 1.3 * sample_docs / n)))])
    place = (F.xxhash64("text") / F.lit(2.0**64)) + 0.5
    sample = usable.where(place <= share[F.col("lang")]).distinct().withColumn("place", place).orderBy("place", "lang", "text")
    taken = {lang: _Counts() for lang in counts}
    docs, held = dict.fromkeys(counts, 0), dict.fromkeys(counts, 0)
    for r in sample.select("lang", "text").toLocalIterator():
        size = len(r.text.encode())
        if docs[r.lang] < sample_docs and held[r.lang] + size <= sample_bytes:
            taken[r.lang].add(r.text)
            docs[r.lang] += 1
            held[r.lang] += size
    return _filters(taken)


def predict(docs: DataFrame, filters: Filters, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns of docs, with lang_pred and score, by the names given; columns of docs with these names are replaced.

    lang_pred is `und`, with score 0, for null texts, texts without a letter and if nothing was learned; a text whose
    letters are in no filter gets the first language, with score 0. score: the best language's share of all
    corrected counts. Only the text is looked at. No shuffle; pieces of bounded size whatever a text's length.
    """
    common.bound_batches(docs.sparkSession)
    kept = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            for lo, hi in common.pieces(column, 4 * PIECE_CHARS):
                langs, scores = shared.value.predict([t or "" for t in column[lo:hi].to_pylist()])
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, pred_col, score_col])

    return kept.mapInArrow(common.releasing(run), common.with_field(common.with_field(kept.schema, pred_col, T.StringType()), score_col, T.DoubleType()))


def lettered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter; needs no filters."""
    common.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index(text_col))
            for lo, hi in common.pieces(column, 4 * PIECE_CHARS):
                kept = np.zeros(hi - lo, bool)
                for owner, starts, codes in _pieces([t or "" for t in column[lo:hi].to_pylist()]):
                    kept[owner] |= np.logical_or.reduceat(codes > 0, starts)
                yield b.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(common.releasing(run), docs.schema)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = common.crc_bucket(F.col("doc_id"), 4) == 2
    filters = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
