import re

import numpy as np
import xxhash

from doclathe.llm import simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(rows):
    """doc_id, fingerprint -> smallest doc_id reachable, by brute force."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d, _ in rows}


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, fp string, bucket string")
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    fps = [(d[0], plain(d[1])) for d in docs]
    want = classes(fps)
    assert got == {(d, f"{x:016x}", want[d]) for d, x in fps}


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [(r.doc_id, r.text, "x", None) for r in rows])


def test_defined_cases(spark):
    base = " ".join(f"Word{i}" for i in range(300))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, base), (8, base + "\nx"), (9, base), (10, base[:-3]), (11, "é" * 100000)]
    check(spark, [(*d, "c", None) for d in docs])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    kept = simhash.dedup(spark.createDataFrame([(7, base, "a"), (9, base, "b"), (5, "other", None)], "doc_id long, text string, fp string"))
    assert kept.columns == ["doc_id", "text", "fp"] and {r.doc_id for r in kept.collect()} == {5, 7}


def test_bit_sliced_matrix():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    b = np.concatenate([a ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), a[:50] ^ np.uint64(7), a[:20] ^ np.uint64(3)])
    want = np.array([[(int(x) ^ int(y)).bit_count() <= 2 for y in b] for x in a])
    assert (simhash.close_pairs(a, b) == want).all()


def test_blocks_are_abandoned_and_unused_lanes_are_dead():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 641, 1000):
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        x[: n // 100] = np.uint64(5)  # a few near ones keep their block only
        planes, read = simhash.planes_of(x), []

        def mismatch(b, blocks):
            read.append(len(blocks))
            return planes[b][blocks]

        got = simhash._lanes(simhash.near(mismatch, simhash._unused(n, planes.shape[1])), n)
        assert got.tolist() == [int(v).bit_count() <= 2 for v in x]
        if n == 641:
            assert len(read) == 64 and read[40] == 1  # the block of the near ones
        if n == 65:
            assert len(read) < 40


def cloud(rng, n, bits):
    """Different fingerprints, connected by single bits, around one."""
    fps = {int(rng.integers(0, 1 << 62))}
    known = list(fps)
    while len(fps) < n:
        x = known[int(rng.integers(len(known)))] ^ (1 << int(rng.integers(0, bits)))
        if x not in fps:
            fps.add(x)
            known.append(x)
    return known


def linked(spark, fps, n):
    from doclathe.llm.components import components

    rows = [(x - (x >> 63 << 64), i) for i, x in enumerate(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long, node long"), n)
    return {r.node: r.root for r in components(edges).collect()}, edges


def test_every_block_plan_is_exact(spark):
    rng = np.random.default_rng(4)
    fps = []
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63)) << 1
        fps += {x, *(x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 2, 3, 3, 4))}
    want = classes(list(enumerate(fps)))
    for n in (1, 1 << 22, 1 << 30):
        assert len(simhash.block_plan(n)) == {1: 3, 1 << 22: 6, 1 << 30: 10}[n]
        got, _ = linked(spark, fps, n)
        assert {i: got.get(i, i) for i in want} == want


def test_hot_buckets_are_split_by_further_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 64)
    rng = np.random.default_rng(2)
    fps = cloud(rng, 400, 40) + cloud(rng, 300, 20) + [int(x) for x in rng.integers(0, 1 << 62, 300)]
    want = classes(list(enumerate(fps)))
    for n in (1, 1 << 30):
        got, edges = linked(spark, fps, n)
        assert {i: got.get(i, i) for i in want} == want
        assert edges.count() < 60 * len(fps)
