"""Re-Pair files: exact round trips, random access, and ids as the library's."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from skimlode.llm import common, grammar, pieces
from skimlode.llm.wordbpe import vocabulary

FILE = vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  two  spaces ", "a\n\nb \n c", "it's <|endoftext|> here<|endoftext|>", "été 日本 123 ٣", "x" * 5000, "\x1c \x85 　 a", " lead", "trail ", "tab\t\tx", None]


def test_compress_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n, alphabet in ((1, 3), (50, 2), (5000, 3), (30000, 40), (3000, 50000)):
        ids = rng.integers(0, alphabet, n)
        cuts = np.unique(np.concatenate((rng.integers(1, n + 1, n // 50 + 1), [n])))
        counts = np.diff(np.concatenate(([0], cuts)))
        shard = grammar.Shard(grammar.shard_bytes(list(range(len(counts))), ids, counts, 50257))
        assert (shard.all_ids() == ids).all()
        for k in range(0, len(counts), 7):
            own = ids[cuts[k] - counts[k] : cuts[k]]
            a = int(rng.integers(0, len(own)))
            assert (shard.document(k) == own).all() and (shard.document(k, a, a + 9) == own[a : a + 9]).all()


def test_repetition_is_compressed():
    ids = np.tile(np.arange(10), 1000)
    raw = grammar.shard_bytes([1], ids, np.array([len(ids)]), 50257)
    assert len(raw) < len(ids)


def test_files_hold_the_librarys_ids(spark, tmp_path):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices(" \n\tabAB'st.1é ", k=rng.randrange(60))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (7, "again"), (7, "again")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = grammar.read(spark, grammar.write(docs, f"file://{tmp_path}/ids", FILE)).collect()
    library = Tokenizer.from_file(FILE)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    key = lambda r: (r[1],)
    assert sorted(map(tuple, got), key=key) == want
    assert grammar.read(spark, grammar.write(docs.limit(0), common.new_folder(spark, "none"), FILE)).count() == 0


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50000, 500)
    copies = [np.concatenate((passage, rng.integers(0, 50000, 20))) for _ in range(300)]
    for ids, counts in ((np.concatenate(copies), np.full(300, 520)), (rng.integers(0, 40, 30000), np.full(300, 100)), (np.zeros(5000, np.int64), np.array([5000]))):
        shard = grammar.Shard(grammar.shard_bytes(list(range(len(counts))), ids, counts, 50257))
        symbols = [grammar._unpacked(shard.body, shard.bits, int(n), int(at)).tolist() for n, at in zip(shard.docs["symbols"], shard.begins)]
        pairs = Counter()
        for own in symbols:
            pairs.update(zip(own, own[1:]))
        assert max(pairs.values(), default=0) < grammar.LEAST and (shard.all_ids() == ids).all()
    assert grammar.Shard(grammar.shard_bytes([0] * 300, np.concatenate(copies), np.full(300, 520), 50257)).lengths.max() == 500


def test_query_against_the_library(spark):
    sf, library, at = "/root/testdata/sf0.001", Tokenizer.from_file(FILE), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in grammar.op7_grammar_ids(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id] = at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        at += len(ids)
    assert got == want


def _kind(piece):
    """What kinds() says, in one piece's words."""
    if piece == "\n":
        return pieces.LINE_END | pieces.ENDS_OTHER
    core = piece[1:] if piece[:1] == " " else piece
    if not core or core != core.strip():
        return pieces.BAD
    return pieces.ENDS_OTHER * (not core[-1].isalnum()) | pieces.BEGINS_STOP * (core[0] in ",." and core is piece) | pieces.BEGINS_SPACE * (core is not piece)


def test_only_distinct_pieces_are_looked_up():
    rng = random.Random(5)
    texts = ["".join(rng.choices([" ", "\n", "\t", ",", ".", "<", "a", "B1", "é", "日", "　", "\x1c", "𝒳", "'s", "\0"], weights=[9, 2, 1, 3, 3, 1, 9, 5, 2, 2, 1, 1, 1, 2, 1 / 9], k=rng.randrange(40))) for _ in range(3000)]
    table, library = grammar._library(FILE), Tokenizer.from_file(FILE)
    looked, numbers = [], table.numbers
    table.numbers = lambda own: looked.append(own) or numbers(own)
    try:
        plain = ["one two, three.\nfour"] * 5000
        for own in (texts, plain, [""], []):
            looked.clear()
            ids, counts = table.documents(pa.array(own, pa.string()), spaced=True)
            want = [library.encode(t, add_special_tokens=False).ids for t in own]
            assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]
            if own is plain:
                assert sum(map(len, looked)) == 7
    finally:
        del table.numbers
    some = list(table.index) + ["", " ", "\n", " \n", "\n ", ",", " ,", ".5", "<a", " <"]
    assert pieces.kinds(*pieces.code_points(some)).tolist() == list(map(_kind, some))
