import zlib
from collections import Counter

import pytest

from tests.llm.test_contamination import plain as contained
from tests.llm.test_simhash import classes
from tests.llm.test_simhash import plain as fingerprint

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_plain_python(spark):
    from doclathe.llm import langid, mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = langid.train(docs)
    said = model.predict([r["text"] for r in rows])
    rows = [r for r, (lang, _, bits, known) in zip(rows, said) if lang != "und" and known == (bits * (n := len(langid.normal(r["text"]))) <= langid.NONE_BITS * n + langid.NONE_PRIOR) and known]
    root = classes([(r["doc_id"], fingerprint(r["text"])) for r in rows])
    rows = [r for r in rows if root[r["doc_id"]] == r["doc_id"]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, *_ in contained([(r["doc_id"], r["text"]) for r in rows], items)}
    rows = [r for r in rows if r["doc_id"] not in bad]

    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.text for r in out} == {r["doc_id"]: r["text"] for r in rows} and len(out) == len(rows) < docs.count()
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert all(r["size"] == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode()) and r.law == "rows" for r in out)

    kept = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    order = {r.doc_id: r.position for r in mixing.mix(kept).collect()}
    mixed = corpus_pipeline.mix_sources(spark, kept, SF)
    assert mixed.columns == docs.columns
    assert [order[r.doc_id] for r in mixed.collect()] == list(range(len(rows)))


def test_mixing_decides_the_slots(spark, monkeypatch):
    from doclathe.llm import mixing
    from doclathe.llm.common import scratch

    docs = spark.createDataFrame([(i, f"text {i}", "big" if i % 4 else "small") for i in range(4000)], "doc_id long, text string, source string")

    def placed(stages):
        now = docs
        for stage in stages:
            now = scratch(stage(spark, now, SF))
        return {r.doc_id: (r.shard, r.slot) for r in now.collect()}

    def heads(at):
        """Rows of the small source in the first 20 slots of all shards."""
        return sum(i % 4 == 0 for i, (_, slot) in at.items() if slot < 20)

    last = [s for _, s in corpus_pipeline.STAGES[3:]]
    order = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    default = placed(last)
    assert sorted(default.values()) == [(k, i) for k in range(40) for i in range(100)]
    for k in range(40):
        inside = sorted((slot, i) for i, (shard, slot) in default.items() if shard == k)
        assert sum(i % 4 == 0 for _, i in inside) == 25
        assert [order[i] for _, i in inside] == sorted(order[i] for _, i in inside)
    assert default != placed(last[1:])  # without mixing
    weighted = mixing.mixed
    for weights in ({"big": 9.0, "small": 1.0}, {"big": 1.0, "small": 1.0}):
        monkeypatch.setattr(mixing, "mixed", lambda d, w=weights: weighted(d, weights=w))
        share = weights["small"] / sum(weights.values())
        assert abs(heads(placed(last)) - 800 * share) < 16 + 40


def test_repeated_rows_and_null_ids_stay_once_and_keep_their_rows(spark):
    from doclathe.llm.common import scratch

    texts = [" ".join(f"w{i}x{j * j}" for j in range(30)) for i in range(40)]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (1, texts[0], "a"), (2, texts[0], None), (None, texts[0], "b")]
    rows += [(None, texts[1], "a")] * 3 + [(None, t, None) for t in texts[2:20]] + [(7, t, "b") for t in texts[20:]]
    now = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for _, stage in [corpus_pipeline.STAGES[i] for i in (1, 3, 4)]:
        now = scratch(stage(spark, now, SF))
    out = now.collect()
    assert sorted(r.text for r in out) == sorted(texts)
    assert {(r.doc_id, r.text, r.source) for r in out} == {(1, texts[0], "a"), (None, texts[1], "a"), *rows[8:]}
    assert len({(r.shard, r.slot) for r in out}) == len(texts)
    assert all(r["size"] == len(r.text) + 16 and r.text_crc32 == zlib.crc32(r.text.encode()) for r in out)


def test_last_stage_shards_by_fractional_ranks(spark):
    from pyspark.sql import functions as F

    from doclathe.llm import sharding

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    by = {}
    for r in docs.select("doc_id", "source", F.xxhash64(F.lit(sharding.SEED), F.coalesce("text", F.lit(""))).alias("h"), F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("i")).collect():
        by.setdefault(r.source, []).append((r.h, r.i, r.doc_id))
    order = sorted(((2 * k + 1) / (2 * len(v)), s, x[2]) for s, v in by.items() for k, x in enumerate(sorted(v)))
    want = {d: p * 40 // len(order) for p, (_, _, d) in enumerate(order)}
    out = corpus_pipeline.assign_shards(spark, docs, SF).collect()
    assert {r.doc_id: r.shard for r in out} == want == {r.doc_id: r.shard for r in sharding.assign(docs).collect()}
    place = {r.doc_id: i for i, r in enumerate(docs.collect())}
    for k in range(40):
        inside = sorted((r.slot, place[r.doc_id]) for r in out if r.shard == k)
        assert [s for s, _ in inside] == list(range(len(inside))) and [p for _, p in inside] == sorted(p for _, p in inside)
