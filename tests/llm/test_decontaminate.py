"""Decontamination against every window in Python; several blocks, odd rows and names."""

import random
import re

import pytest

from skimlode.llm import decontaminate as d

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _expected(text, items):
    w, hit, names = _words(text), set(), set()
    for name, item in items:
        own = _words(item)
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add("" if name is None else str(name))
    return len(w), len(hit), sorted(names)


def _data(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 13, 14, 40])))) for i in range(12)] + [(None, "null id " + " ".join(words[:20])), (99, ""), (98, None), (5, "again another text of item five " * 3)]
    texts = [None, "", "...", "X" * 50_000]
    for _ in range(60):
        parts = rng.choices(words, k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            own = _words(rng.choice(items)[1])
            at = rng.randrange(max(1, len(own)))
            parts[len(parts) // 2 : len(parts) // 2] = [x.upper() if rng.random() < 0.3 else x for x in own[at // 2 :]]
        texts.append("; ".join(parts))
    return items, texts + texts[5:8]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_scan_against_every_window(spark, block_bytes):
    items, texts = _data(block_bytes)
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert (len(d._blocks(benchmark, "item_id", "text", 13, block_bytes)) > 3) == (block_bytes == 300)
    out = d.scan(docs, benchmark, block_bytes=block_bytes)
    got = {r.doc_id: (r._leak.n_words, r._leak.n_hit, r._leak["items"]) for r in out.collect()}
    assert got == {i: _expected(t, items) for i, t in enumerate(texts)}


def test_empty_tables_and_clashing_names(spark):
    items, texts = _data(1)
    docs = spark.createDataFrame([(i, t, f"mine {i}") for i, t in enumerate(texts)], "doc_id long, text string, _LEAK string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    clean = d.decontaminate(docs, benchmark.limit(0))
    assert clean.columns == docs.columns and sorted(map(tuple, clean.collect())) == sorted(map(tuple, docs.collect()), key=lambda r: r[0])
    assert d.decontaminate(docs.limit(0), benchmark).count() == 0
    kept = {r.doc_id: r for r in d.decontaminate(docs, benchmark).collect()}
    for i, t in enumerate(texts):
        n, hit, _ = _expected(t, items)
        assert (i in kept) == (hit == 0 or hit < 0.05 * n)
        if i in kept:
            assert kept[i]["_LEAK"] == f"mine {i}" and (hit > 0 or kept[i].text == t)
