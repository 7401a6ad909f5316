"""Token ids in binary files, compressed by a Re-Pair grammar for each shard.

A file holds shards one after the other, then a footer that lists where they begin. A shard holds whole documents,
about SHARD_IDS ids. Its rules give, for each nonterminal, the two symbols that it stands for and how many ids they
expand to; the documents' symbols follow, packed to as many bits as the largest needs. As every document begins at a
symbol of its own, and expansions have known lengths, any id can be reached without decoding what lies before it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import BEGINS_SPACE, LINE_END, PieceTable, code_points, kinds
from .wordbpe import vocabulary

MAGIC = b"SKLRPAIR"
HEADER = struct.Struct("<8sIIQQQ")  # magic, first nonterminal, bits of a symbol, documents, rules, symbols
SHARD_IDS = 1_000_000
#: Most pairs replaced in a round, and how often a pair must occur at least; rounds go on until no pair does.
ROUND_PAIRS, LEAST = 8192, 8
#: Slots in which a round looks up its chosen pairs; of pairs that fall into one slot the most frequent stays, the others wait.
SLOT_BITS = 18
BATCH_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).min


def _slot(code: np.ndarray) -> np.ndarray:
    return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def compress(ids: np.ndarray, last: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: symbols, whether each ends a document, rules (pairs) and their expansion lengths.

    Each round counts all adjacent pairs and gives the most frequent a nonterminal each; occurrences are replaced from
    left to right, overlapping ones left out, until no pair is left that occurs LEAST times. A pair never crosses the
    end of a document. Only pairs with a new symbol, or of those that occurred LEAST times before, are counted anew:
    no others can be frequent.
    """
    symbols, rules = ids.astype(np.int64), [np.empty((0, 2), np.int64)]
    fresh = first
    live = np.flatnonzero(~last[:-1])  # where pairs begin that may be frequent
    while len(live):
        code = symbols[live] << 32 | symbols[live + 1]
        ordered = np.sort(code)
        heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.concatenate((heads, [len(ordered)])))
        often = np.flatnonzero(counts >= LEAST)
        if not len(often):
            break
        frequent = np.zeros(1 << SLOT_BITS, bool)
        frequent[_slot(ordered[heads[often]])] = True
        often = often[np.lexsort((heads[often], -counts[often]))][:ROUND_PAIRS]
        chosen = ordered[heads[often]]
        slots = np.full(1 << SLOT_BITS, -1, np.int32)
        slots[_slot(chosen[::-1])] = np.arange(len(chosen) - 1, -1, -1)
        chosen = chosen[np.sort(slots[slots >= 0])]
        slots[_slot(chosen)] = np.arange(len(chosen))
        slot = _slot(code)
        at = slots[slot]
        found = np.flatnonzero(at >= 0)
        found = found[chosen[at[found]] == code[found]]
        hit, at = live[found], at[found]
        run = np.concatenate(([0], np.flatnonzero(np.diff(hit) != 1) + 1))
        begin = np.repeat(hit[run], np.diff(np.concatenate((run, [len(hit)]))))
        own = (hit - begin) % 2 == 0
        hit, at = hit[own], at[own]
        again = np.zeros(len(symbols), bool)
        again[live[frequent[slot]]] = True
        again[hit] = True
        again[hit[hit > 0] - 1] = True
        symbols[hit] = fresh + at
        last[hit] |= last[hit + 1]
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        symbols, last, again = symbols[keep], last[keep], again[keep]
        live = np.flatnonzero(again[:-1] & ~last[:-1])
        rules.append(np.stack((chosen >> 32, chosen & 0xFFFFFFFF), axis=1))
        fresh += len(chosen)
    table = np.concatenate(rules)
    lengths = np.ones(first + len(table), np.int64)
    at = first
    for part in rules:  # a round's rules stand for symbols of earlier rounds only
        lengths[at : at + len(part)] = lengths[part[:, 0]] + lengths[part[:, 1]]
        at += len(part)
    return symbols, last, table, lengths[first:]


def _packed(symbols: np.ndarray, bits: int) -> bytes:
    out = []
    for i in range(0, len(symbols), 1 << 18):  # a multiple of eight: parts join at whole bytes
        raw = np.unpackbits(symbols[i : i + (1 << 18)].astype(">u4").view(np.uint8)).reshape(-1, 32)
        out.append(np.packbits(raw[:, 32 - bits :]).tobytes())
    return b"".join(out)


def _unpacked(raw: bytes, bits: int, count: int, at: int = 0) -> np.ndarray:
    """Symbols at, at + 1, ... (count of them)."""
    if not count:
        return np.empty(0, np.int64)
    padded = raw + bytes(8)
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    where = np.arange(at, at + count, dtype=np.int64) * bits
    out = words[where >> 3].astype(np.uint64) >> (64 - bits - (where & 7)).view(np.uint64)
    return (out & np.uint64((1 << bits) - 1)).view(np.int64)


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """One shard: header, expansion lengths, rules, documents, packed symbols. Every document has an id at least."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, last, rules, lengths = compress(ids, last, first)
    bits = max(1, int(symbols.max(initial=1)).bit_length())
    docs = np.zeros(len(counts), np.dtype([("doc_id", "<i8"), ("symbols", "<u4"), ("ids", "<u4")]))
    docs["doc_id"] = [NO_ID if d is None else d for d in doc_ids]
    docs["symbols"] = np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))
    docs["ids"] = counts
    return HEADER.pack(MAGIC, first, bits, len(docs), len(rules), len(symbols)) + lengths.astype("<u4").tobytes() + rules.astype("<u4").tobytes() + docs.tobytes() + _packed(symbols, bits)


class Shard:
    """A shard as read; ids of any document, or any stretch of its ids, are decoded by themselves."""

    def __init__(self, raw: bytes):
        magic, self.first, self.bits, n_docs, n_rules, self.n_symbols = HEADER.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a shard of grammar-compressed ids")
        at = HEADER.size
        self.lengths = np.concatenate((np.ones(self.first, np.int64), np.frombuffer(raw, "<u4", n_rules, at).astype(np.int64)))
        at += 4 * n_rules
        self.rules = np.frombuffer(raw, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * n_rules
        self.docs = np.frombuffer(raw, np.dtype([("doc_id", "<i8"), ("symbols", "<u4"), ("ids", "<u4")]), n_docs, at)
        self.body = raw[at + self.docs.nbytes :]
        self.begins = np.concatenate(([0], np.cumsum(self.docs["symbols"], dtype=np.int64)))

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols: each round replaces every nonterminal by its pair."""
        while (inner := symbols >= self.first).any():
            ends = np.cumsum(inner + 1)
            out = np.empty(ends[-1], np.int64)
            out[ends - 1 - inner] = np.where(inner, self.rules[np.where(inner, symbols - self.first, 0), 0], symbols)
            out[(ends - 1)[inner]] = self.rules[symbols[inner] - self.first, 1]
            symbols = out
        return symbols

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of the shard's k-th document: only symbols that reach into them are expanded."""
        symbols = _unpacked(self.body, self.bits, int(self.docs["symbols"][k]), int(self.begins[k]))
        ends = np.cumsum(self.lengths[symbols])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        if start >= stop:
            return np.empty(0, np.int64)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left"))
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a : b + 1])[start - skipped : stop - skipped]

    def all_ids(self) -> np.ndarray:
        """Every id: each rule is expanded once, symbols then copy their expansions."""
        symbols = _unpacked(self.body, self.bits, self.n_symbols)
        flat = self.expand(np.arange(self.first, len(self.lengths)))
        flat = np.concatenate((np.arange(self.first), flat))
        ends = np.cumsum(self.lengths)
        counts = self.lengths[symbols]
        where = np.repeat((ends - self.lengths)[symbols] - np.cumsum(counts) + counts, counts)
        where += np.arange(len(where))
        return flat[where]


_tables: dict[str, PieceTable] = {}
#: Bytes of one text that the library gets.
CALL_BYTES = 20_000


def _library(file: str) -> PieceTable:
    if file not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(file)
        sizes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())], np.int64)
        line = tokenizer.encode("\n", add_special_tokens=False).ids
        _tables[file] = PieceTable(lambda pieces: _encoded(tokenizer, sizes, line, pieces))
    return _tables[file]


def _encoded(tokenizer, sizes: np.ndarray, line: list[int], pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The library's ids of distinct pieces, many in one call: all ids in a row, and each piece's first and number.

    Plain pieces (they begin with at most one space, end with none and hold no "<") are encoded side by side, a line end
    before those without a space: none of these places is inside a token. How many bytes each token stands for (a letter
    of the byte-level alphabet each) tells where a piece ends.
    """
    codes, last = code_points(pieces)
    kind = kinds(codes, last)
    plain = kind < LINE_END
    plain[np.searchsorted(last, np.flatnonzero(codes == ord("<")), "right")] = False
    starts, counts, parts, used = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64), [], 0
    odd = np.flatnonzero(~plain).tolist()
    for k, found in zip(odd, tokenizer.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False)):
        starts[k], counts[k] = used, len(found.ids)
        parts.append(np.array(found.ids, np.uint32))
        used += len(found.ids)
    owner = np.flatnonzero(plain)
    lines = kind[owner] & BEGINS_SPACE == 0
    text = ["\n" + p if alone else p for p, alone in zip(map(pieces.__getitem__, owner.tolist()), lines.tolist())]
    past = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)))[last]  # bytes of pieces
    size = np.diff(past, prepend=0)[owner] + lines
    bounds = np.unique(np.concatenate((np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), CALL_BYTES)), [len(text)])))
    calls = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    for (a, b), found in zip(calls, tokenizer.encode_batch_fast(["".join(text[a:b]) for a, b in calls], add_special_tokens=False)):
        flat = np.array(found.ids, np.uint32)
        ends, wanted = np.cumsum(sizes[flat]), np.cumsum(size[a:b])
        at = np.searchsorted(ends, wanted)
        if (ends[at] != wanted).any():
            raise ValueError("a token crosses from one piece to the next")
        first = np.concatenate(([0], at[:-1] + 1)) + len(line) * lines[a:b]
        starts[owner[a:b]], counts[owner[a:b]] = first + used, at + 1 - first
        parts.append(flat)
        used += len(flat)
    return np.concatenate(parts), starts, counts


def _writer(file: str, folder: str, end_id: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part = _library(file), TaskContext.get().partitionId()
        out, offsets, total, n_docs = None, [], 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}"  # of this attempt; the manifest says which ones count

        def flush() -> None:
            nonlocal out, total, n_docs
            if docs:
                out = out or common.uri_open(path, "wb")
                raw = shard_bytes(docs, np.concatenate(held), np.concatenate(counts), first)
                offsets.append(out.tell())
                out.write(raw)
                total, n_docs = total + int(sum(c.sum() for c in counts)), n_docs + len(docs)
                docs.clear(), held.clear(), counts.clear()

        for b in batches:
            texts = b.column(1)
            for lo, hi in common.pieces(texts, BATCH_BYTES):
                flat, n = table.documents(texts[lo:hi].fill_null(""), spaced=True)
                ends = np.cumsum(n)
                docs += b.column(0)[lo:hi].to_pylist()
                held.append(np.insert(flat, ends, end_id))
                counts.append(n + 1)
                if sum(map(len, held)) >= SHARD_IDS:
                    flush()
        flush()
        if out:
            offsets.append(out.tell())
            out.write(np.array(offsets, "<i8").tobytes() + struct.pack("<q", len(offsets)))
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [n_docs], "n_ids": [total]})

    return run


def write(docs: DataFrame, folder: str, file: str, *, end_id: int = 0, first: int = 50257, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Encode all texts in ascending order of id and write them, a file for each range of ids; returns the manifest.

    Null and empty texts have the end id only. Null ids come first; rows with equal ids follow each other by text.
    An empty table writes no file. The manifest (part, path, n_docs, n_ids, start) has a row for each file, so it is
    bounded by the number of partitions; files of lost or repeated attempts aren't in it. first: the first id that no
    token has. Memory: a shard's ids, and the longest text.
    """
    common.bound_batches(docs.sparkSession)
    common.make_folder(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = sorted(rows.mapInArrow(common.releasing(_writer(file, folder, end_id, first)), "part long, path string, n_docs long, n_ids long").collect())
    start, manifest = 0, []
    for r in found:
        manifest.append((r.part, r.path, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return manifest


def shards(path: str) -> Iterator[Shard]:
    with common.uri_open(path, "rb") as f:
        f.seek(-8, 2)
        (n,) = struct.unpack("<q", f.read(8))
        f.seek(-8 - 8 * n, 2)
        offsets = np.frombuffer(f.read(8 * n), "<i8").tolist()
        for a, b in zip(offsets[:-1], offsets[1:]):
            f.seek(a)
            yield Shard(f.read(b - a))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for shard in shards(path):
                n = shard.docs["ids"].astype(np.int64)
                ends = np.cumsum(n)
                raw = memoryview(shard.all_ids().astype("<u4").tobytes())
                ids = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                doc_ids = pa.array(shard.docs["doc_id"], mask=shard.docs["doc_id"] == NO_ID)
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                start += int(ends[-1])


def read(spark: SparkSession, manifest: list) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone; one task for each file."""
    files = spark.createDataFrame([(path, start) for _, path, _, _, start in manifest], "path string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "ids")
    return read(spark, write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, vocabulary("byte_bpe_50k.json")))


QUERIES = {"op7_grammar_ids": op7_grammar_ids}
ORACLES: dict[str, str] = {}
