import itertools
import math
import re
import zlib

import duckdb
import numpy as np

from doclathe.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_marginals_against_all_paths():
    rng = np.random.default_rng(1)
    chain = toxicity.Chain(np.array([0.0, -1.0]), np.array([[0.0, -2.0], [0.3, 0.7]]))
    sizes = [1, 5, 2, 7, 1, 1, 9]
    emission = rng.normal(size=sum(sizes)) * 3
    first = np.zeros(len(emission), bool)
    first[np.cumsum([0, *sizes[:-1]])] = True
    got = chain.marginals(emission, first)
    at = 0
    for n in sizes:
        e, total, on = emission[at : at + n], 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(chain.start[path[0]] + sum(chain.step[a, b] for a, b in zip(path, path[1:])) + sum(x for x, s in zip(e, path) if s))
            total += w
            on += w * np.array(path)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_whole_query_against_all_paths(spark):
    """Scores and spans of a table, by summing over all taggings of each document."""
    chain = toxicity.Chain(np.array([0.0, -1.0]), np.array([[0.0, -2.0], [0.0, 0.7]]))
    weights = {"bad": 3.0, "awfu*": 2.0, "*fulish": 1.5, "fine": -2.0}
    model = toxicity.Model(weights, -1.5, chain, np.array([-1.0, 0.5, 0.2, 1.5, 3.0]))
    rng = np.random.default_rng(2)
    words = ["bad", "awfully", "Awfulish", "fine", "other", "x" * 80, "é"]
    docs = [(i, ", ".join(rng.choice(words, int(rng.integers(0, 11))))) for i in range(60)] + [(None, "Bad bad"), (60, None)]
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    for r in rows:
        tokens = [(m[0].lower(), m.span()) for m in re.finditer(r"\w+", text[r.doc_id] or "")]
        e = [-1.5 + sum(w for f, w in weights.items() if f == x or (f[-1] == "*" and len(x) > 4 and x[:4] == f[:-1]) or (f[0] == "*" and len(x) > 6 and x[-6:] == f[1:])) for x, _ in tokens]
        total = clean = 0.0
        on = np.zeros(len(e))
        for path in itertools.product((0, 1), repeat=len(e)):
            w = np.exp(chain.start[path[0]] + sum(chain.step[a, b] for a, b in zip(path, path[1:])) + sum(x for x, s in zip(e, path) if s)) if path else 1.0
            total, clean, on = total + w, clean + w * (not any(path)), on + w * np.array(path)
        p, a = on / total, clean / total
        sure = (p * p).sum()
        z = [1.0, math.log1p(sure), math.log((sure + 0.05) / (len(p) + 10)), max([0.0, *p]), math.log(max((1 - a) / a, 1e-12)) / 10] @ model.fit
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == (r.score >= 0.5)
        marked = {i for s in r.spans for i in range(s.start, s.end)}
        assert {i for (_, (x, y)), q in zip(tokens, p) if q >= 0.5 for i in range(x, y)} <= marked
        assert not marked & {i for (_, (x, y)), q in zip(tokens, p) if q < 0.5 for i in range(x, y)}


def test_held_out_documents():
    c = duckdb.connect()
    text = dict(c.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall())
    label = dict(c.sql(f"select doc_id, toxic from '{SF}/labels.parquet' order by doc_id").fetchall())
    able = [i for i in label if zlib.crc32(str(i).encode()) % 5 and len(text[i].encode()) <= toxicity.TRAIN_BYTES]
    clean = [i for i in able if not label[i]]
    ids = [i for i in able if label[i]] + clean[:800]
    toxic = np.array([bool(label[i]) for i in ids])
    weight = np.where(toxic, 1.0, len(clean) / 800)
    m = toxicity.fit_model([text[i] for i in ids], toxic, weight / weight.mean())
    held = [i for i in label if zlib.crc32(str(i).encode()) % 5 == 0]
    found = m.score_batch([text[i] for i in held])
    hit = {i for i, (s, _) in zip(held, found) if s >= 0.5}
    want = {i for i in held if label[i]}
    assert len(hit & want) >= 0.9 * len(want) and len(hit - want) <= 0.02 * len(held)
    words = {text[i][a:b].lower() for i, (_, spans) in zip(held, found) for a, b in spans}
    assert {"idiot", "trash"} <= {w for x in words for w in x.split()}


def test_spans_where_lower_case_is_longer():
    assert toxicity._spans("İx y") == [(0, 1), (1, 2), (3, 4)] or toxicity._spans("İx y") == [(0, 2), (3, 4)]


def test_cases(spark, monkeypatch):
    bad, good = "you idiot trash moron", "the quiet river runs past"
    docs = [(i, " ".join(f"{w} {i * 7 + k}" for k, w in enumerate((bad if i % 3 == 0 else good).split())), "x") for i in range(60)] + [(100, None, "x"), (101, "", None), (101, "", None), (None, "a " * 100000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, _id string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), "y") for i in range(60)] + [(None, 1, "y"), (0, 1, "y"), (5, None, "y")], "doc_id long, toxic int, text string")
    rows = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(rows) == 64 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.predicted == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert {r.predicted for r in rows if r.doc_id in (100, 101, None)} == {0}
    assert toxicity.train(df, labels.filter("toxic = 0")) is None
    learned = []
    monkeypatch.setattr(toxicity, "fit_model", lambda texts, *_: learned.extend(texts))
    hot = spark.createDataFrame([(3, f"hot {i:04}", None) for i in range(2000)], df.schema)
    toxicity.train(df.filter("doc_id <> 3").unionByName(hot), labels)
    assert sum(t.startswith("hot") for t in learned) == 1 and "hot 0000" in learned
    assert {r.score for r in toxicity.score(df, None).collect()} == {0.0}
    assert toxicity.score(df.limit(0), None).collect() == []
