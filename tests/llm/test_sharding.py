"""Minimax cuts against brute force; whole groups, gapless slots, odd rows."""

import random
import zlib
from collections import defaultdict

from skimlode.llm import sharding


def _optimum(sizes, shards):
    def fits(cap):
        n, held = 1, 0
        for s in sizes:
            if s > cap:
                return False
            if held + s > cap:
                n, held = n + 1, 0
            held += s
        return n <= shards

    cap = 1
    while not fits(cap):
        cap += 1
    return cap


def test_search_is_exact_with_few_knots():
    rng = random.Random(3)
    for _ in range(300):
        sizes = [rng.choice([1, 2, 3, rng.randrange(1, 60)]) for _ in range(rng.randrange(1, 80))]
        shards = rng.randrange(1, 9)
        ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]

        def fetch(stretches, buckets):
            found = defaultdict(list)
            for k, (lo, hi) in enumerate(stretches):
                for e in ends:
                    if lo < e <= hi:
                        found[k, min(buckets - 1, int((e - lo - 1) / max(1.0, (hi - lo) / buckets)))].append(e)
            return [(k, b, min(v), max(v), len(v)) for (k, b), v in found.items()]

        cap, cuts = sharding.minimax(ends[-1], shards, fetch, knots=rng.choice([4, 10, 1000]))
        assert cap == _optimum(sizes, shards)
        assert len(cuts) == shards and cuts == sorted(cuts) and cuts[-1] == ends[-1] and set(cuts) <= {0, *ends}
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= cap


def _checked(rows, out, shards):
    assert len(out) == len(rows)
    by_shard, by_text = defaultdict(list), defaultdict(set)
    want = sorted(((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.size, r.text_crc32) for r in out) == want
    for r in out:
        by_shard[r.shard].append(r)
        by_text[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for members in by_shard.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
    groups = defaultdict(lambda: [1 << 62, 0])
    for i, t in rows:
        g = groups[t or ""]
        g[0], g[1] = min(g[0], -(1 << 62) if i is None else i), g[1] + len((t or "").encode()) + 16
    sizes = [g[1] for g in sorted(groups.values())]
    assert max(sum(r.size for r in m) for m in by_shard.values()) == _optimum(sizes, shards)
    return [sum(r.size for r in by_shard[k]) for k in range(shards)]


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", None, "", "x" * rng.randrange(300), "y" * rng.randrange(9)])) for i in rng.sample(range(10000), 700)] + [(None, "hot"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, shard string").repartition(5)
    sizes = _checked(rows, sharding.shard(docs, shards=7, knots=20).collect(), 7)
    assert min(sizes) > 0
    assert sharding.shard(docs.limit(0)).count() == 0
    few = [(1, "a"), (2, "b")]
    _checked(few, sharding.shard(spark.createDataFrame(few, "doc_id long, text string"), shards=5).collect(), 5)


def test_near_equal_without_large_groups(spark):
    out = sharding.op3_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 40 and max(sizes) < 1.6 * sum(sizes) / 40
