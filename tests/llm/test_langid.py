import functools
import math
import random
import zlib
from collections import Counter

import numpy as np

from doclathe.llm import langid

SF = "/root/testdata/sf0.01"


def slow_bits(texts, data):
    """Code length by the definition: recursive, with dictionaries."""
    s = b"   ".join([b"", *texts, b""])
    counts = {}
    for i, x in enumerate(s):
        for k in range(4):
            if i >= k:
                counts.setdefault(s[i - k : i], Counter())[x] += 1

    @functools.cache
    def left(context):
        return sum(p(context[1:], y) if context else 1 / 256 for y in range(256) if y not in counts[context])

    @functools.cache
    def p(context, x):
        c = counts.get(context)
        if c and x in c:
            return c[x] / (sum(c.values()) + (len(c) if left(context) else 0))
        below = p(context[1:], x) if context else 1 / 256
        return len(c) / (sum(c.values()) + len(c)) * below / left(context) if c else below

    for context in list(counts)[:9]:
        assert abs(sum(p(context, y) for y in range(256)) - 1) < 1e-9
    line = b"   " + data
    return sum(-math.log2(p(line[i - 3 : i], line[i])) for i in range(3, len(line)))


def test_code_lengths_against_the_definition():
    sample = {"x": [b"the cat sat", b"a cat"], "y": ["le chat était là".encode(), b"un chat"], "z": ["漢字かな交じり文".encode()]}
    m = langid.Model(sample)
    texts = [b"the chat", "là été q".encode(), b"zzz", b"t", "漢字 cat".encode(), bytes(range(128, 256))]
    for _ in range(2):  # the second time from memory
        for data, got in zip(texts, m.code_lengths(texts)):
            for i, x in enumerate(m.langs):
                assert abs(got[i] - slow_bits(sample[x], data)) < 1e-3
    long = b"the cat sat on " * 200000  # over one part
    half, whole = m.code_lengths([long[: len(long) // 2], long])
    assert abs(whole[0] / half[0] - 2) < 1e-3
    assert np.allclose(m.code_lengths([long[:1000]]), m.code_lengths([b"a", long[:1000]])[1:])


def test_many_languages_and_a_small_memory(monkeypatch):
    rng = random.Random(3)
    sample = {f"l{i:02}": [bytes(rng.choices(range(97 + i % 20, 104 + i % 20), k=80)) + "αβγδεζηθ"[i % 8].encode() * 3 for _ in range(3)] for i in range(64)}
    texts = [bytes(rng.choices(range(97, 123), k=30)) for _ in range(40)] + ["γγ x".encode()]
    m = langid.Model(sample)
    for x in (0, 17, 63):
        got = m.code_lengths(texts)[:, x]
        assert np.allclose(got, [slow_bits(sample[m.langs[x]], d) for d in texts], atol=1e-3)
    monkeypatch.setattr(langid, "MEMO_BYTES", 1)
    assert np.allclose(langid.Model(sample).code_lengths(texts), m.code_lengths(texts))


def test_query_against_the_definition(spark):
    """Every document's language and score, from the query's own sample and the recursive definition."""
    docs = spark.createDataFrame([(i, f"{w} {i}", x) for i in range(24) for w, x in ((("the cat sat", "en"), ("le chat était", "fr"), ("der hund läuft", "de"))[i % 3],)], "doc_id long, text string, lang string")
    text, sample = {r.doc_id: r.text for r in docs.collect()}, {}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            sample.setdefault(r.lang, []).append(langid.normal(r.text))
    for r in langid.identify(docs).collect():
        data = langid.normal(text[r.doc_id])
        bits = {x: slow_bits(sorted(t), data) for x, t in sample.items()}
        best = min(sorted(bits), key=bits.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(2 ** (bits[best] - b) for b in bits.values())) < 1e-3
        assert abs(r.bits_per_byte - bits[best] / len(data)) < 1e-3


def test_the_sample_is_bounded_by_bytes_and_not_by_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "Model", seen.append)
    rows = [(None if i % 2 else 7, f"word{i} " * 10, "en") for i in range(3000)] + [(None, "le même texte", "fr")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.train(df)
    assert 300 < len(seen[0]["en"]) < 500 and seen[0].get("fr", []) in ([], [langid.normal("le même texte")])
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 9000)
    langid.train(df)
    assert 20 < len(seen[1]["en"]) < 90


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)
    assert langid.known_language(docs).count() >= 0.995 * len(rows)


def test_cases(spark):
    docs = [(1, "The cat and the dog", "en", "x"), (2, None, "en", "x"), (3, "1 2 3 ?!", None, None), (3, "1 2 3 ?!", None, None), (4, "", "fr", "x"), (5, "le chat et le chien", "fr", "x"), (6, "été 漢字 " * 50000, None, "x"), (None, "the dog", None, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, chance string")
    rows = langid.identify(df).collect()
    assert len(rows) == 8 and {(r.doc_id, r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 4)} == {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0)}
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    kept = langid.known_language(df)
    assert kept.columns == df.columns and kept.filter("doc_id in (2, 3, 4)").count() == 0 and kept.filter("doc_id in (1, 5)").count() == 2
    assert langid.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", df.lang.substr(9, 1)).na.replace("", None, ["lang"])).collect()} == {"und"}
