"""BPE encoding and decoding by speculation: greedy longest matches, a vectorised check of each adjacent pair, exact merging of the rest."""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .pieces import PieceTable

#: The pre-tokenizer's pattern in the vocabulary file: fixed.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
BATCH_BYTES = 2 << 20
NEVER = np.int64(1) << 40
#: Words of more letters are merged with a heap.
SHORT = 32
#: Signs that a word may end with, each a word of its own.
STOPS = frozenset(".,;:!?")
#: Distinct pieces that a worker remembers.
REMEMBERED = 500_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """The vocabulary file's encoder: words one by one, each the library's ids for it."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        letters = byte_letters()
        self.to_letters = {b: letters[b] for b in range(256)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        codes = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.rank_of = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.codes, self.ranks = codes[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self._derive()

    def _derive(self) -> None:
        """Of each token: is it what its own text is merged to, and by which merge: rank, left part, right part (-1: a letter)."""
        n = max(self.names) + 1
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.proposed: dict[str, int] = {}
        for text, i in self.vocab.items():
            steps: list[tuple[int, int, int]] = []
            if self._merge(self._letters(text), steps) == [i]:
                self.proposed[text] = i
                if steps:
                    self.rank[i], self.left[i], self.right[i] = steps[-1]
        self.longest = max(len(t.removesuffix(END)) for t in self.proposed)
        self.reach: dict[str, int] = {}  # by four letters: the longest proposed token that begins with them
        for text in self.proposed:
            self.reach[text[:4]] = max(self.reach.get(text[:4], 0), len(text))

    def _letters(self, text: str) -> list[int]:
        body = text.removesuffix(END) if text.endswith(END) and text != END else text
        ids = [self.vocab.get(c, -1) for c in body]
        if body is not text and body != text:
            ids[-1] = self.vocab.get(body[-1] + END, -1)
        return ids

    def _merge(self, ids: list[int], steps: list | None = None) -> list[int]:
        """Exact merging: always the lowest rank, of equal ranks the leftmost."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b, new = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            if steps is not None:
                steps.append((rank, a, b))
            ids[i], ids[j], after[i] = new, -2, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := self.merges.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [x for x in ids if x >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The same for few letters, by the ranks of all pairs."""
        get, never = self.rank_of.get, int(NEVER)
        ranks = [get(pair, never) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != never:
            i = ranks.index(best)
            ids[i : i + 2] = (self.made[best],)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def _greedy(self, word: str) -> list[int]:
        """Longest token that fits, again and again; none where a letter has no token."""
        out, at, n, get, reach = [], 0, len(word), self.proposed.get, self.reach.get
        ending = word + END
        while at < n:
            if n - at <= self.longest and (i := get(ending[at:])) is not None:
                out.append(i)
                break
            for to in range(min(n - 1, at + reach(word[at : at + 4], 3)), at, -1):
                if (i := get(word[at:to])) is not None:
                    out.append(i)
                    at = to
                    break
            else:
                return []
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of each a and b side by side never joins them.

        Going back in time from the finished pair, the last part of a and the first part of b face each other until
        one of them was itself merged. If two parts that face each other have a merge of their own that comes before
        the next merge of either (of equal ranks the left one comes first), the pair is not what merging gives.
        """
        x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            p, q = x[live], y[live]
            code = p << 32 | q
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            rank = np.where(self.codes[at] == code, self.ranks[at], NEVER)
            bad = (rank < until_x[live]) & (rank <= until_y[live]) & (rank < NEVER)
            good[live[bad]] = False
            back_y = self.rank[q] >= self.rank[p]
            done = bad | ((self.rank[p] < 0) & (self.rank[q] < 0))
            to_y, to_x = live[back_y & ~done], live[~back_y & ~done]
            until_y[to_y], until_x[to_x] = self.rank[y[to_y]], self.rank[x[to_x]]
            y[to_y], x[to_x] = self.left[y[to_y]], self.right[x[to_x]]
            live = live[~done]
        return good

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of words (letters that stand for bytes): proposed, checked pair by pair, and only where that fails merged."""
        out = [self._greedy(w) for w in words]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter(chain.from_iterable(out), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(out)), counts)
        near = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.empty(0, np.int64)
        pairs, inverse = np.unique(flat[near] << 32 | flat[near + 1], return_inverse=True)
        fails = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[inverse]
        again = np.zeros(len(out), bool)
        again[owner[near[fails]]] = True
        again[counts == 0] = True
        for k in np.flatnonzero(again):
            ids = [i for c in words[k][:-1] if (i := self.vocab.get(c)) is not None]
            if words[k] and (last := self.vocab.get(words[k][-1] + END)) is not None:
                ids.append(last)
            out[k] = self._merge_short(ids) if len(ids) <= SHORT else self._merge(ids)
        return out

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces of text that have no cut inside a word at either end: all in a row, where each piece's begin, and their numbers."""
        number: dict[str | int, int] = {}  # a special token is its id
        plan: list[int] = []
        parts = np.empty(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            at, before = 0, len(plan)
            for m in self.special_pattern.finditer(piece) if "<|" in piece else ():
                plan += [number.setdefault(w, len(number)) for w in (*self._split(piece[at : m.start()]), self.special[m.group()])]
                at = m.end()
            plan += [number.setdefault(w, len(number)) for w in self._split(piece[at:] if at else piece)]
            parts[k] = len(plan) - before
        words = [w for w in number if isinstance(w, str)]
        got = self.words(words)
        if len(words) < len(number):
            found = iter(got)
            got = [next(found) if isinstance(w, str) else [w] for w in number]
        counts = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.uint32, int(counts.sum()))
        which = np.array(plan, np.int64)
        many = counts[which]
        ends = np.concatenate(([0], np.cumsum(many)))
        where = np.repeat((np.cumsum(counts) - counts)[which] - ends[:-1], many) + np.arange(ends[-1])
        bounds = ends[np.concatenate(([0], np.cumsum(parts)))]
        return flat[where], bounds[:-1], np.diff(bounds)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[-1:] in STOPS and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
        else:
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower-cased letter by letter, without regard to a word's end
                text = text.replace("Σ", "σ")
        return [w if w.isascii() and w.isalnum() else "".join(map(self.to_letters.__getitem__, w.encode())) for w in PATTERN.findall(text.lower())]

    def token_bytes(self) -> list[bytes]:
        return [self.names.get(i, "").encode() for i in range(max(self.names) + 1)]


_loaded: dict[str, tuple[WordBpe, PieceTable, list[bytes]]] = {}
_BLANKS = str.maketrans("\t\n\r\v\f", "     ")


def spaced(text: str) -> str:
    """What translate(_BLANKS) gives, faster where there are few of them."""
    for blank in "\t\n\r\v\f":
        if blank in text:
            text = text.replace(blank, " ")
    return text


def _model(file: str) -> tuple[WordBpe, PieceTable, list[bytes]]:
    """Loaded once in each worker."""
    if file not in _loaded:
        bpe = WordBpe(file)
        _loaded[file] = bpe, PieceTable(bpe.encode, REMEMBERED), bpe.token_bytes()
    return _loaded[file]


def _encoder(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, _ = _model(file)
        table.clear()  # what an earlier task has left
        for b in batches:
            column = b.column(b.num_columns - 1)
            for lo, hi in common.pieces(column, BATCH_BYTES):
                flat, counts = table.documents([spaced(t or "") for t in column[lo:hi].to_pylist()], spaced=False)
                ends = np.concatenate(([0], np.cumsum(counts))) * 4
                raw = flat.astype("<u4").tobytes()
                ids = [raw[s:e] for s, e in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns[:-1]), pa.array(ids, pa.binary())], [*b.schema.names[:-1], "ids"])
        table.clear()

    return common.releasing(run)


def _decoder(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, names = _model(file)
        for b in batches:
            column = b.column(b.num_columns - 1)
            for lo, hi in common.pieces(column, 2 * BATCH_BYTES):
                texts = [b" ".join(map(names.__getitem__, np.frombuffer(x.as_py() or b"", "<u4").tolist())) for x in column[lo:hi]]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in b.columns), pa.array(texts, pa.binary()).cast(pa.string())], [*b.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, file: str, text_col: str = "text") -> DataFrame:
    """All columns of docs and `ids`: the text's token ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; an empty table gives no rows. A column `ids` of docs is replaced.
    No shuffle; a batch holds about BATCH_BYTES of text, one text at least.
    """
    common.bound_batches(docs.sparkSession)
    kept = docs.drop("ids")
    raw = kept.withColumn(common.fresh(docs, "_text"), docs[text_col])
    return raw.mapInArrow(_encoder(file), common.with_field(kept.schema, "ids", T.BinaryType()))


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """All columns and `decoded`: the tokens of `ids` (null: none), a space between them, as the vocabulary without a decoder gives them."""
    kept = encoded.select(*[c for c in encoded.columns if c not in ("ids", "decoded")], "ids")
    return kept.mapInArrow(_decoder(file), common.with_field(kept.schema, "decoded", T.StringType()))


def _digester(file: str):
    """Encode, decode and digest, a batch at a time: neither ids nor decoded texts leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _decoder(file)(_encoder(file)(batches)):
            ids, text = b.column(1), b.column(2).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x.as_py()) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x.as_py()).hexdigest() for x in text])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens and decoded_sha256 (SHA-256 of the decoded text) of each row: encoded and decoded in one pass."""
    common.bound_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _decoder(file)(_encoder(file)(batches)):
            sha = [hashlib.sha256(x.as_py()).hexdigest() for x in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x.as_py()) // 4 for x in b.column(1)], pa.int64()), pa.array(sha, pa.string())], ["doc_id", "ids", "n_tokens", "decoded_sha256"])

    return raw.mapInArrow(run, f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, ids binary, n_tokens long, decoded_sha256 string")


def token_digests(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row, by encode() and decode()."""
    common.bound_batches(docs.sparkSession)
    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return raw.mapInArrow(_digester(file), f"doc_id {raw.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op6_word_bpe": op6_word_bpe}
ORACLES: dict[str, str] = {}
