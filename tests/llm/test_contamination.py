import re

import duckdb

from doclathe.llm import contamination

SF = "/root/testdata/sf0.001"


def plain(docs, items):
    def sh(text):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    have = {}
    for d, t in docs:
        if d is not None:
            have.setdefault(d, set()).update(sh(t))
    out = set()
    for i, t in items:
        s = sh(t)
        for d, h in have.items():
            if i is not None and s and len(s & h) >= 0.8 * len(s) - 1e-9:
                out.add((d, i, len(s & h), len(s)))
    return out


def rows(docs, items):
    return {tuple(r)[:4] for r in contamination.contained(docs, items).collect()}


def test_whole_tables_and_sql(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and rows(docs, items) == want
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert {tuple(r)[:4] for r in c.sql(contamination.SQL).fetchall()} == want


def test_cases_and_shuffled_lookup(spark, monkeypatch):
    item = " ".join(f"word{i}" for i in range(40))
    edited = item.replace("word20", "other")
    docs = [(1, f"Before, {item.upper()}; after", "x"), (2, f"x {edited} y", "x"), (3, item[:100], "x"), (4, None, None), (5, "", "x"), (6, "Two words", "x"), (6, "Two words", "x"), (7, ("z " * 100000) + item, "x"), (None, item, "x"), (8, "more than two words", "x")]
    items = [(1, item, "y"), (2, item, "y"), (2, item, "y"), (3, "two  words!", "y"), (4, None, "y"), (None, item, "y"), (5, "...", "y")]
    d = spark.createDataFrame(docs, "doc_id long, text string, doc string")
    b = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    want = plain([x[:2] for x in docs], [x[:2] for x in items])
    assert {(x[0], x[1]) for x in want} >= {(1, 1), (1, 2), (2, 1), (6, 3), (7, 2)}
    assert rows(d, b) == want
    assert sorted(str(r.doc_id) for r in contamination.clean(d, b).collect()) == ["3", "4", "5", "8"]
    assert contamination.clean(d, b).columns == d.columns
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert rows(d, b) == want
    assert rows(d.limit(0), b) == set() and rows(d, b.limit(0)) == set()
    assert contamination.clean(d, b.limit(0)).count() == len(docs)
    # Row by row: rows that share an id or have none are told apart.
    mixed = spark.createDataFrame([(9, "quite clean"), (9, item), (None, "clean too"), (None, item), (None, edited)], "doc_id long, text string")
    assert sorted(r.text for r in contamination.clean(mixed, b).collect()) == ["clean too", "quite clean"]


def test_every_contained_item_is_a_candidate(spark):
    import random

    rng = random.Random(8)
    items, docs = [], []
    for i in range(60):
        w = [f"t{i}x{k}" for k in range(rng.randint(5, 90))]
        items.append((i, " ".join(w)))
        for j in range(4):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                v[rng.randrange(len(v))] = "changed"
            docs.append((i * 10 + j, "lead in " + " ".join(v) + " end"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(d, b) == plain(docs, items)
