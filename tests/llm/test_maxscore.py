import math

import duckdb
import numpy as np

from doclathe.llm import maxscore

SF = "/root/testdata/sf0.001"


def brute(rows, every):
    able = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in able]
    out = []
    hold = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    for n, (q, u) in enumerate(whole):
        if q is not None and q % every == 0:
            s = sorted((-hold(sum(a * b for a, b in zip(u, v))), i is None, i or 0) for m, (i, v) in enumerate(whole) if m != n)
            out += [(q, r + 1, None if none else i, -x) for r, (x, none, i) in enumerate(s[:10])]
    return sorted(out, key=str)


def got(df, every):
    return sorted((tuple(r) for r in maxscore.top_k(df, every).collect()), key=str)


def test_whole_table_and_sql(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    have = got(df, 100)
    assert have == brute([(r.vec_id, list(r.embedding)) for r in df.collect()], 100)
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted((tuple(r) for r in c.sql(maxscore.SQL).fetchall()), key=str) == have


def test_many_shards_signs_ties_and_repeated_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    for name, n in (("SHARD", 150), ("QUERIES", 20), ("CHUNK", 7), ("HEAD", 12), ("BLOCK", 31), ("PAIRS", 50)):
        monkeypatch.setattr(maxscore, name, n)
    for scale in (0.01, 3.0):
        rows = [(int(i), [float(x) for x in np.round(rng.normal(size=6) * scale + (i % 3) * scale, 2)]) for i in range(700)]
        rows += [(1000 + i, rows[7][1]) for i in range(40)] + [(i % 40, [float(x) for x in rng.normal(size=6)]) for i in range(60)] + [(None, rows[9][1])] * 3
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert got(df, 10) == brute(rows, 10)


def test_blocks_against_all_products():
    rng = np.random.default_rng(6)
    for low, high, skew in ((-1000, -1, 0.0), (-1000, 1000, 0.0), (-300, 1000, 1.5), (0, 5, 0.0)):
        m = (rng.integers(low, high, (3000, 24)) * rng.pareto(3, 24).clip(0, 9) ** skew).round()
        q = (rng.integers(-50, 50, (300, 24)) * rng.pareto(3, 24).clip(0, 9) ** skew).round()
        for kind in (float, object):
            a, b = m.astype(int).astype(kind), q[:: 1 if kind is float else 30].astype(int).astype(kind)
            query, place, score = maxscore.search(b, np.full(len(b), -1), a, np.arange(len(a)))
            want = b.astype(np.int64) @ a.astype(np.int64).T
            for i in range(len(b)):
                order = np.lexsort((np.arange(len(a)), -want[i]))[:10]
                assert place[query == i].tolist() == order.tolist() and score[query == i].tolist() == want[i][order].tolist()


def test_cases(spark):
    rows = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (1, None, "a"), (2, [1.0, None], "a"), (3, [float("nan"), 1.0], "a"), (100, [float("inf"), 1.0], None), (5, [-1.0, 0.5], "a"), (200, [1e30, 0.0], "b"), (None, [1.0, 1.0], "b"), (7, [], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    have = got(df, 100)
    want = [(0, 1, 200, (1 << 63) - 1), (0, 2, 0, 5 << 20), (0, 3, None, 3 << 20), (0, 4, 5, 0), (0, 5, 7, 0)]
    assert [x for x in have if x[0] == 0] == sorted([*want, *want], key=str)
    assert [x[1:3] for x in have if x[0] == 200] == [(1, 0), (2, 0), (3, None), (4, 7), (5, 5)]
    assert {s for q, _, i, s in have if q == 200} == {(1 << 63) - 1, 0, -(1 << 63)}
    assert got(df.limit(0), 100) == []
