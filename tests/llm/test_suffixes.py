"""Repeated passages against counting every string of 400 and of 256 bytes; the merge against sorting."""

import hashlib
import random
from collections import Counter

from skimlode.llm import suffixes


def _covered(raw, n):
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    for r in raw:
        hit = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        yield hit


def _expected(texts):
    raw = [(t or "").encode() for t in texts]
    out = []
    for r, hit, short in zip(raw, _covered(raw, 400), _covered(raw, 256)):
        spans = sum(1 for i in range(len(r)) if hit[i] and not (i and hit[i - 1]))
        out.append((len(r), sum(hit), sum(short), spans, hashlib.sha256(bytes(c for c, h in zip(r, hit) if not h)).hexdigest()))
    return out


def _texts(seed):
    rng = random.Random(seed)
    words = [f"{chr(97 + i % 26)}é{i}" for i in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    passages = [make(n) for n in (60, 75, 85, 100, 200, 700)]
    texts = []
    for _ in range(150):
        parts = [make(rng.randrange(1, 120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(3)
            parts += [p if cut == 0 else p[rng.randrange(40) :] if cut == 1 else p[: len(p) - rng.randrange(60)], make(rng.randrange(30))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], None, "", "short", "short", "x" * 3000, "x" * 400, "y" * 400, "y" * 400, "ab" * 500, passages[3] * 3, "z" * 399, "z" * 399, "w" * 256, "w" * 255, "v" * 256, "v" * 256]
    return texts


def test_rows_against_counting(spark):
    texts = _texts(1)
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, "null id " * 60, "old"), (5, "same id, another text " * 30, "old")], "doc_id long, text string, spans string").repartition(4)
    all_texts = [*texts, "null id " * 60, "same id, another text " * 30]
    out = suffixes.repeated_spans(docs).collect()
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_repeated, len(r.spans) // 2, r.kept_sha256) for r in out)
    ids = [*range(len(texts)), None, 5]
    assert got == Counter((i, *e) for i, e in zip(ids, _expected(all_texts)))
    assert suffixes.repeated_spans(docs.limit(0)).count() == 0


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_repeated, r.n_spans, r.kept_sha256) for r in suffixes.op10_suffix_dedup(spark, sf).collect()}
    assert out == {r.doc_id: e for r, e in zip(rows, _expected([r.text for r in rows]))}


def test_many_merge_levels(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FAN_IN", 2)
    texts = _texts(2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    stored = suffixes.common.stored
    monkeypatch.setattr(suffixes.common, "stored", lambda df, label: stored(df, label).repartition(7) if label == "sources" else stored(df, label))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_repeated, len(r.spans) // 2, r.kept_sha256) for r in suffixes.repeated_spans(docs).collect()}
    assert got == dict(enumerate(_expected(texts)))


def test_loser_tree_and_front_coding():
    rng = random.Random(3)
    for k in range(1, 9):
        runs, every = [], []
        for r in range(k):
            own = sorted((bytes(rng.choices(b"ab", k=rng.randrange(0, 9))), b"l", bytes(16), rng.randrange(99)) for _ in range(rng.randrange(12)))
            lcps = [0, *(suffixes.common_prefix(x[0], y[0], 0) for x, y in zip(own[:-1], own[1:]))]
            runs.append(suffixes.unpack(suffixes.pack(own, lcps, suffixes.np.zeros(0, suffixes.DONE)))[0])
            every += own
        merged = list(suffixes.merge(runs))
        assert [e[0] for _, e in merged] == sorted(e[0] for e in every)
        assert [n for n, _ in merged[1:]] == [suffixes.common_prefix(x[1][0], y[1][0], 0) for x, y in zip(merged[:-1], merged[1:])]


def test_large_groups_agree_with_pairs(monkeypatch):
    rng = random.Random(4)
    base = bytes(rng.choices(b"abcdefgh", k=700))
    entries = set()
    for i in range(40):
        t = bytearray(base)
        for _ in range(rng.randrange(3)):
            t[rng.choice([*range(0, 140), *range(410, 560)])] = 120
        entries.add((bytes(t[150 : 150 + rng.choice([400, 400, 300])]), bytes(t[rng.choice([54, 54, 110]) : 150]), i.to_bytes(16, "big"), 144 + rng.randrange(5)))
    ordered = sorted(entries)
    lcps = [0, *(suffixes.common_prefix(x[0], y[0], 0) for x, y in zip(ordered[:-1], ordered[1:]))]

    places = {e[2]: e[3] for e in ordered}

    def covered(found):
        out = {}
        for c, a, b in found:
            for least in (256, 400):
                if b - a >= least:  # strings that begin after an anchor are found at others
                    out.setdefault((c, least), []).append((a, min(b, places[c] + least)))
        return {c: suffixes.union(s) for c, s in out.items()}

    many = covered(suffixes.repeats(ordered, lcps))
    monkeypatch.setattr(suffixes, "PAIRWISE", 1000)
    assert many == covered(suffixes.repeats(ordered, lcps)) and many


def _periodic_texts():
    rng = random.Random(8)
    unit = lambda q: "".join(rng.choices("abcdefgh", k=q))
    head, tail = ("".join(rng.choices("klmnop qrst", k=n)) for n in (300, 350))
    u5, u31, u32, u33 = unit(5), unit(31), unit(32), unit(33)
    return [
        head + "x" * 5000 + tail, "x" * 401, "y" + "x" * 399 + "y", head[-200:] + "x" * 390, "x" * 380 + tail[:30],
        u5 * 900, (u5 * 90)[3:406], (u5 * 81)[1:404] + tail, head + u31 * 70, (u31 * 14)[7:410], u32 * 64, u32 * 80 + tail, (u32 * 20)[11:420], u33 * 80, (u33 * 13)[5:415],
        u5 * 600 + u31 * 90 + u5 * 600, "z" * 2047, "q" * 2048, "z" * 400 + "-", "q" * 400 + "-", "é" * 1500 + "x" * 3000 + "é" * 1500, tail + head,
    ]


def test_texts_that_repeat_with_a_short_period(spark):
    texts = _periodic_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_repeated, len(r.spans) // 2, r.kept_sha256) for r in suffixes.repeated_spans(docs).collect()}
    assert got == dict(enumerate(_expected(texts)))


def test_long_periodic_texts_have_few_anchors():
    for unit in (b"x", b"in the ", bytes(range(32))):
        text = b"before" * 200 + unit * (20_000_000 // len(unit)) + b"after" * 300
        assert len(suffixes.anchors(text)) < 4000
        lo, hi = max(suffixes.periodic(text), key=lambda r: r[1] - r[0])
        assert abs(lo - 1200) < 40 and abs(hi - (len(text) - 1500)) < 40
    plain = random.Random(2).randbytes(300_000)
    assert suffixes.periodic(plain) == [] and suffixes.periodic(b"") == []


def test_a_task_holds_a_bounded_number_of_suffixes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffixes, "RUN", 50)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    sizes, inner = [], suffixes._sorted_runs
    monkeypatch.setattr(suffixes, "_sorted_runs", lambda held, *rest: (sizes.append(len(held)), inner(held, *rest))[1])
    text = random.Random(4).randbytes(20_000)
    at = suffixes.anchors(text).tolist()
    batch = pa.RecordBatch.from_arrays([pa.array([b"c" * 16], pa.binary()), pa.array([text], pa.binary()), pa.array([at], pa.list_(pa.int64()))], ["cls", "text", "places"])
    found = list(suffixes._runs(4)(iter([batch])))
    assert found and max(sizes) == 50 and sum(sizes) == len(at)
