import zlib
from collections import Counter

from doclathe.llm import common, mixing, ranking, sharding

SF = "/root/testdata/sf0.001"


def test_shards_are_equal_gapless_and_mixed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    rows = sharding.assign(docs, shards=8).collect()
    assert sorted(r.doc_id for r in rows) == sorted(text)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    for r in rows:
        b = (text[r.doc_id][0] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 16, zlib.crc32(b), "rows", None)
    total = Counter(s for _, s in text.values())
    for (shard, source), n in Counter((r.shard, r.source) for r in rows).items():
        assert abs(n - total[source] / 8) < 2


def test_same_order_by_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    keys = docs.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), "text").alias("h"), F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("i")).collect()
    by = {}
    for r in keys:
        by.setdefault(r.source, []).append((r.h, r.i, r.doc_id))
    order = sorted(((2 * k + 1) / (2 * len(v)), s, x[2]) for s, v in by.items() for k, x in enumerate(sorted(v)))
    want = {d: (p * 8 // len(order)) for p, (_, _, d) in enumerate(order)}
    assert {r.doc_id: r.shard for r in sharding.assign(docs, shards=8).collect()} == want


CASES = [(1, None, None, "x"), (2, "", "a", None), (2, "", "a", None), (3, "same", "a", "x"), (4, "same", None, "x"), (None, "y" * 200000, "b", "x")]


def test_shard_cases(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string, source string, shard string")
    rows = sharding.assign(df, shards=4).collect()
    assert len(rows) == 6 and sorted(Counter(r.shard for r in rows).values()) == [1, 1, 2, 2]
    assert sharding.assign(df.limit(0)).collect() == []


def test_equal_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    """A third of all rows with one text and no id: ranked by several tasks, each row once."""
    from pyspark.sql import functions as F

    sizes = []

    def counted(df):
        sizes.append([r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()])
        return common.scratch(df)

    monkeypatch.setattr(ranking, "scratch", counted)
    rows = [(i, f"text {i}", "a") for i in range(4000)] + [(None, "same", "a")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = sharding.assign(df).collect()
        mixed = mixing.mix(df).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 3 and all(sum(s) == 6000 and max(s) < 1500 for s in sizes)
    assert len(placed) == 6000 and set(Counter(r.shard for r in placed).values()) == {150}
    assert sorted(r.position for r in mixed) == list(range(6000))


def test_edf_meets_deadlines_and_shares():
    for k in ({"a": 1, "b": 2, "c": 5}, {"x": 7, "y": 11, "z": 13, "w": 69}, mixing.whole_slots({str(i): 1 / (i + 1) for i in range(30)}, 1000)):
        size = sum(k.values())
        slots = mixing.edf_period(k)
        assert sorted(t for v in slots.values() for t in v) == list(range(size))
        for s, v in slots.items():
            for t in range(size + 1):
                assert abs(sum(x < t for x in v) - t * k[s] / size) < 1


def test_mix_places_every_row_once_within_a_block(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {f"src{i}": i + 1.0 for i in range(6)}
    rows = mixing.mix(docs, weights, block_rows=2, period=100).collect()
    n = Counter(r.source for r in rows)
    assert sorted(r.position for r in rows) == list(range(docs.count())) and n == Counter(r.source for r in docs.collect())
    assert all(r.release <= r.slot < r.deadline for r in rows)
    order = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in order)
    # In phase 0 every weighted source is within one block of its share at each slot.
    k = mixing.whole_slots({s: w for s, w in weights.items() if n[s]}, 100)
    first = {(r.slot, r.source) for r in rows if r.phase == 0}
    end = max(t for t, _ in first) + 1
    for s in k:
        for t in range(end + 1):
            assert abs(sum(1 for x, y in first if y == s and x < t) - t * k[s] / 100) < 1
    assert not any(r.phase == 0 and r.source not in weights for r in rows)


def test_schedule_against_a_slow_simulation():
    rows, weights = {"a": 37, "b": 101, "c": 8, "d": 1}, {"a": 1.0, "b": 2.0, "c": 4.0}
    import numpy as np

    s = mixing.Schedule(rows, weights, block_rows=4, period=20)
    got = sorted((p, name, r) for name, n in rows.items() for r, p in enumerate(s.place(name, np.arange(n))["position"]))
    assert [p for p, _, _ in got] == list(range(sum(rows.values())))
    left, want = {x: -(-n // 4) for x, n in rows.items()}, []
    seen = dict.fromkeys(rows, 0)
    while any(left.values()):
        active = {x: weights[x] for x in left if left[x] and weights.get(x)} or {x: 1.0 for x in left if left[x]}
        k = mixing.whole_slots(active, max(20, 8 * len(active)))
        by = {t: x for x, v in mixing.edf_period(k).items() for t in v}
        t = 0
        while all(left[x] for x in active):
            x = by[t % sum(k.values())]
            left[x] -= 1
            take = min(4, rows[x] - seen[x])
            want += [(x, seen[x] + i) for i in range(take)]
            seen[x] += take
            t += 1
    assert [(x, r) for _, x, r in got] == want


def test_mix_cases(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string, source string, _position string")
    assert sorted(r.position for r in mixing.mix(df).collect()) == list(range(6))
    assert mixing.mix(df.limit(0)).collect() == []
    out = mixing.mixed(df)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))


def test_shares_hold_for_the_unrounded_weights():
    from fractions import Fraction

    import numpy as np

    rows = {"big": 40000} | {f"s{i:02}": 7000 + 13 * i for i in range(11)}
    for weights in ({s: n**mixing.TEMPER for s, n in rows.items()}, {s: 1.0 for s in rows} | {"s03": 0.0001 * 11}):
        schedule = mixing.Schedule(rows, weights, block_rows=4)
        whole = sum(map(Fraction, weights.values()))
        got = {s: schedule.place(s, np.arange(0, n, 4)) for s, n in rows.items()}
        end = max(p["slot"][p["phase"] == 0].max() for p in got.values()) + 1
        assert sum((p["phase"] == 0).sum() for p in got.values()) == end > 5000
        for s, p in got.items():
            w = Fraction(weights[s]) / whole
            slots = p["slot"][p["phase"] == 0]
            # The count changes at the slots only: it is furthest off just before and just after one.
            for j, t in enumerate(slots.tolist()):
                assert abs(j - t * w) < 1 and abs(j + 1 - (t + 1) * w) < 1
                assert p["release"][j] == j // w <= t < p["deadline"][j] == -(-(j + 1) // w)
            assert abs(len(slots) - end * w) < 1
        order = sorted(x for s, n in rows.items() for x in schedule.place(s, np.arange(n))["position"])
        assert order == list(range(sum(rows.values())))
