"""Connected components against union-find: chains, stars, cliques, loops and repeated links."""

import random

from skimlode.llm.components import components


def _expected(links):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


def test_components(spark):
    rng = random.Random(1)
    names = rng.sample(range(10_000), 400)
    links = [*zip(names[:60], names[1:60]), *((names[100], x) for x in names[101:220]), *((a, b) for a in names[300:308] for b in names[300:308] if a != b)]
    links += [(b, a) for a, b in links[::3]] + links[::5] + [(names[390], names[391])]
    rng.shuffle(links)
    rows = spark.createDataFrame(links, "a long, b long").repartition(3)
    out = components(rows).collect()
    assert {r.node: r.root for r in out} == _expected(links) and len(out) == len(_expected(links))
    loops = spark.createDataFrame([(5, 5)], "a long, b long")
    assert components(loops).count() == 0 and components(rows.limit(0)).count() == 0
    binary = spark.createDataFrame([(b"b", b"a"), (b"c", b"b")], "a binary, b binary")
    assert {bytes(r.node): bytes(r.root) for r in components(binary).collect()} == {b"a": b"a", b"b": b"a", b"c": b"a"}


def test_few_edges_need_few_files(spark, monkeypatch):
    """However many partitions a shuffle has; and no checksum files, for which executors would start processes."""
    from pathlib import Path

    from skimlode.llm import common
    from skimlode.llm.components import LEAST_FILES

    written = []
    new_folder = common.new_folder
    monkeypatch.setattr(common, "new_folder", lambda s, label: written.append(new_folder(s, label)) or written[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
        assert {r.root for r in components(links).collect()} == {0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [[f.name for f in Path(p.removeprefix("file://")).iterdir()] for p in written]
    assert len(files) > 2 and all(sum(f.endswith(".parquet") for f in own) <= LEAST_FILES for own in files[1:])
    assert not any(f.endswith(".crc") for own in files for f in own)
