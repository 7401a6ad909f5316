"""Speculative BPE against the tokenizers library, on corpus texts and on random ones."""

import random

import pytest
from tokenizers import Tokenizer

from skimlode.llm import wordbpe

FILE = wordbpe.vocabulary("word_bpe_49k.json")
ODD = ["", " ", " x ", "áb é", "ΣΑΣ ΟΔΟΣ", "don't we'll I'D", "x\x1cy \x85z", "<|endoftext|>a <|startoftext|><|endoftext|>", "<|endof", "日本語テキスト 123٣", "İstanbul", "a" * 3000, "ab" * 700 + "!" * 500, "</w> a</w>b", "\U0001f600‍\U0001f468 x", "ﬁ Å K", "ẞ ß", "tab\tnew\nline\r\n", "﻿bom", " sep　wide"]


@pytest.fixture(scope="module")
def model():
    return wordbpe.WordBpe(FILE), Tokenizer.from_file(FILE)


def _same(model, texts):
    bpe, library = model
    table = wordbpe.PieceTable(bpe.encode, remembered=50)
    for t in texts:
        ids = table.documents([t.translate(wordbpe._BLANKS)], spaced=False)[0].tolist()
        want = library.encode(t, add_special_tokens=False)
        assert ids == want.ids, t[:80]
        assert " ".join(bpe.names[i] for i in ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_texts(model):
    _same(model, ODD)


def test_random_texts(model):
    rng = random.Random(5)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "abc", "aA'sdtremvl ", "éèüßabc ́", "".join(map(chr, range(32, 0x250))), "αβΣς аяЯ 中文0123"]
    _same(model, ["".join(rng.choices(rng.choice(alphabets), k=rng.randrange(1, 40))) for _ in range(6000)])


def test_every_adjacent_pair_check_agrees_with_merging(model):
    bpe, _ = model
    rng = random.Random(6)
    tokens = [t for t in bpe.proposed if not t.endswith(wordbpe.END) and len(t) < 6]
    import numpy as np

    a = [rng.choice(tokens) for _ in range(20000)]
    b = [rng.choice(tokens) for _ in range(20000)]
    got = bpe.compatible(np.array([bpe.proposed[x] for x in a]), np.array([bpe.proposed[x] for x in b]))
    for x, y, g in zip(a, b, got):
        assert g == (bpe._merge([bpe.vocab[c] for c in x + y]) == [bpe.proposed[x], bpe.proposed[y]])


def test_query_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None])] + [(None, "null id", "x"), (3, "repeated", "x"), (3, "repeated", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    library = Tokenizer.from_file(FILE)
    out = wordbpe.decode(wordbpe.encode(docs, FILE), FILE).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert wordbpe.token_digests(docs.limit(0), FILE).count() == 0
    assert {r.n_tokens for r in wordbpe.token_digests(docs, FILE).collect() if r.doc_id == 3} >= {1}


def test_query_against_the_library(spark, model):
    import hashlib

    sf, library = "/root/testdata/sf0.001", model[1]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in wordbpe.op6_word_bpe(spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        raw, back = b"".join(i.to_bytes(4, "little") for i in ids), library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
    assert got == want


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "some text", "mine", "old"), (1, None, "too", None)], "doc_id long, text string, _text string, ids string")
    out = wordbpe.encode(docs, FILE)
    assert out.columns == ["doc_id", "text", "_text", "ids"] and [(r.doc_id, r["_text"], len(r.ids) > 0) for r in out.collect()] == [(1, "mine", True), (1, "too", False)]
    assert [r.n_tokens for r in wordbpe.round_trip(docs, FILE).collect()] == [2, 0] and wordbpe.round_trip(docs.limit(0), FILE).count() == 0


def test_short_merging_is_merging(model):
    bpe, _ = model
    rng = random.Random(7)
    for _ in range(5000):
        ids = [bpe.vocab[c] for c in rng.choices(rng.choice(["abcdefghij", "ab", "estinr"]), k=rng.randrange(1, wordbpe.SHORT + 8))]
        assert bpe._merge_short(ids[:]) == bpe._merge(ids[:])


def test_known_ends_need_no_pattern(model):
    """Words of letters, with a stop after them or not, are split without the pattern; odd and special pieces side by side."""
    bpe, library = model
    pieces = ["Word", "word.", "X,", ".", ",,", "a.b", "a1.", "don't", "é.", "ﬁn!", "<|endoftext|>Word.", "a<|startoftext|>,", "", "Word", "q" * 70]
    flat, starts, counts = bpe.encode(pieces)
    for p, s, n in zip(pieces, starts, counts):
        assert flat[s : s + n].tolist() == library.encode(p, add_special_tokens=False).ids
    assert wordbpe.spaced("a\tb\n\vc\f\r") == "a b  c  " and wordbpe.spaced("a b") == "a b"
