import datetime
import re

import pytest

import doclathe as dl
from doclathe import SpecError
from doclathe.functions.text import deburr, parse_search, stem

DOCS = [
    {"_id": 1, "a": 5, "tags": ["x", "y"], "o": {"n": "p", "q": 1}, "items": [{"k": "u", "v": 3}, {"k": "w", "v": 9}], "when": datetime.datetime(2024, 1, 1), "raw": b"ab"},
    {"_id": 2, "a": None, "tags": [], "o": {"n": "r", "q": None}, "items": [], "when": datetime.datetime(2024, 6, 1), "raw": b"cd"},
    {"_id": 3, "tags": ["y"], "o": {"n": "p", "q": 2}, "items": [{"k": "u", "v": 8}], "when": None},
    {"_id": 4, "a": -2, "o": None, "items": None, "raw": b"ab"},
    {"_id": 5, "a": 10, "tags": ["z", "x"], "o": {"n": "s"}, "items": [{"k": "w", "v": 1}]},
]


@pytest.fixture(scope="module")
def df(spark):
    return dl.from_dicts(spark, DOCS, presence=True).cache()


CASES = [
    ({}, [1, 2, 3, 4, 5]),
    ({"a": 5}, [1]),
    ({"a": None}, [2]),
    ({"a": {"$ne": None}}, [1, 3, 4, 5]),
    ({"a": {"$exists": True}}, [1, 2, 4, 5]),
    ({"a": {"$exists": False}}, [3]),
    ({"a": {"$gt": 0}}, [1, 5]),
    ({"a": {"$lt": 6}}, [1, 4]),
    ({"a": {"$not": {"$gt": 0}}}, [2, 3, 4]),
    ({"a": {"$nin": [5, 10]}}, [2, 3, 4]),
    ({"a": {"$in": [5, None]}}, [1, 2]),
    ({"a": {"$gt": "x"}}, []),
    ({"a": {"$mod": [5, 0]}}, [1, 5]),
    ({"a": {"$mod": [0, 0]}}, []),
    ({"a": {"$type": "number"}}, [1, 4, 5]),
    ({"a": {"$type": "null"}}, [2]),
    ({"a": {"$type": "undefined"}}, [3]),
    ({"o": {"$type": "object"}}, [1, 2, 3, 4, 5]),
    ({"tags": "x"}, [1, 5]),
    ({"tags": ["x", "y"]}, [1]),
    ({"tags": {"$all": ["x"]}}, [1, 5]),
    ({"tags": {"$all": []}}, [1, 2, 3, 5]),
    ({"tags": {"$size": 0}}, [2]),
    ({"tags": {"$ne": "x"}}, [1, 2, 3, 4, 5]),
    ({"tags": {"$in": ["z", re.compile("^Y", re.I)]}}, [1, 3, 5]),
    ({"tags.1": "x"}, [5]),
    ({"o.n": "p"}, [1, 3]),
    ({"o": {"n": "p"}}, [1, 3]),
    ({"o": {"$eq": {"n": "p", "q": 1}}}, [1]),
    ({"o": {"n": "p", "q": {"$gt": 1}}}, [3]),
    ({"items": {"$elemMatch": {"k": "u", "v": {"$gt": 5}}}}, [3]),
    ({"items": {"$elemMatch": {"$or": [{"v": 1}, {"v": 9}]}}}, [1, 5]),
    ({"items": {"$all": [{"k": "w"}]}}, [1, 5]),
    ({"items": {"$eq": {"k": "u", "v": 8}}}, [3]),
    ({"items.0.v": {"$gte": 3}}, [1, 3]),
    ({"$or": [{"a": 5}, {"tags": "z"}]}, [1, 5]),
    ({"$or": []}, []),
    ({"$nor": [{"a": {"$gt": 0}}]}, [2, 3, 4]),
    ({"$and": [{"a": {"$gt": 0}}, {"tags": "y"}]}, [1]),
    ({"$expr": {"$gt": ["$a", "$o.q"]}}, [1]),
    ({"$where": "a > 4"}, [1, 5]),
    ("a > 4", [1, 5]),
    ({"$where": lambda d: d["o.q"] == 2}, [3]),
    ({"$where": lambda d: bool(d["a"]) and d["a"] < 0}, [4]),
    ({"$comment": "hello", "a": 5}, [1]),
    ({"when": datetime.datetime(2024, 1, 1)}, [1]),
    ({"when": {"$gt": datetime.datetime(2024, 2, 1)}}, [2]),
    ({"raw": b"ab"}, [1, 4]),
    ({"o.n": {"$regex": "^P$", "$options": "i"}}, [1, 3]),
    ({"o.n": re.compile("[rs]")}, [2, 5]),
    ({"a": {"$bitsAllSet": 5}}, [1]),
    ({"a": {"$bitsAnyClear": [0]}}, [4, 5]),
    ({"nothing.at.all": None}, []),
    ({"nothing": {"$exists": False}}, [1, 2, 3, 4, 5]),
]


@pytest.mark.parametrize(("query", "want"), CASES, ids=[str(i) for i in range(len(CASES))])
def test_filter(df, query, want):
    assert sorted(r["_id"] for r in dl.find(df, query).collect()) == want


@pytest.mark.parametrize("query", [{"$bad": 1}, {"a": {"$bad": 1}}, {"a": {"$in": 3}}, {"a": {"$exists": 1}}, {"a": {"$size": "2"}}, {"a": {"$bitsAllSet": [-1]}}, {"$and": {"a": 1}}, [1]])
def test_errors(df, query):
    with pytest.raises(SpecError):
        dl.find(df, query)


def test_without_presence_null_is_missing(spark):
    df = dl.from_dicts(spark, DOCS)
    assert sorted(r["_id"] for r in dl.find(df, {"a": None}).collect()) == [2, 3]
    assert sorted(r["_id"] for r in dl.find(df, {"a": {"$exists": False}}).collect()) == [2, 3]


def test_variants_hold_values_of_any_type(spark):
    df = dl.from_variants(spark, [{"_id": 1, "r": 5}, {"_id": 2, "r": "5"}, {"_id": 3, "r": [5]}, {"_id": 4}, {"_id": 5, "r": 7.5}, {"_id": 6, "r": True}], ["_id", "r"])
    ids = lambda q: [r[0] for r in df.filter(dl.operators.predicate.compile_filter(q, dl.functions.paths.Scope.of(df))).selectExpr("try_variant_get(_id, '$', 'int')").collect()]
    assert ids({"r": 5}) == [1] and ids({"r": "5"}) == [2] and ids({"r": {"$gt": 5}}) == [5]
    assert ids({"r": {"$type": "string"}}) == [2] and ids({"r": {"$type": "array"}}) == [3] and ids({"r": {"$exists": False}}) == [4]
    assert ids({"r": {"$in": [True, "5"]}}) == [2, 6]


def test_matches_one_document(spark):
    assert dl.functional.matches({"a": {"b": [1, 2]}}, {"a.b": 2}) and not dl.functional.matches({"a": 1}, {"a": 2})


def test_pushed_filters_and_pruned_columns(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = dl.find(df, {"l_quantity": {"$gt": 5}, "l_returnflag": "R", "$and": [{"l_tax": {"$lte": 0.05}}]}, {"l_orderkey": 1})._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("GreaterThan(l_quantity,5", "EqualTo(l_returnflag,R)", "LessThanOrEqual(l_tax,0.05)"))
    assert "l_comment" not in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]


TEXTS = [
    {"_id": 1, "subject": "Coffee shopping", "author": "xyz"},
    {"_id": 2, "subject": "coffee and coffee cakes", "author": "efg"},
    {"_id": 3, "subject": "Baking a cake", "author": "abc", "more": ["Café, Öl", "shop"]},
    {"_id": 4, "subject": "the coffee-cake recipes", "author": "xyz"},
]


@pytest.mark.parametrize(
    ("mode", "search", "want"),
    [
        ("lightweight", "coffee", {1: 1.0, 2: 2.0, 4: 1.0}),
        ("lightweight", "coffee -cake", {1: 1.0, 2: 2.0}),
        ("lightweight", '"coffee cake"', {4: 1.0}),
        ("lightweight", 'coffee "coffee cake"', {4: 2.0}),
        ("lightweight", "bak cake", {3: 1.0, 4: 1.0}),
        ("lightweight", "-coffee", {}),
        ("lightweight", "", {}),
        ("lightweight", "shop", {3: 1.0}),
        ("stemming", "shop cafe", {1: 1.0, 3: 2.0}),
        ("stemming", "cakes bake", {2: 1.0, 3: 2.0, 4: 1.0}),
        ("exact", "coffee cakes", {1: (0.5 * 1 / 3 + 0.5) * 1, 2: (0.5 * 3 / 4 + 0.5) * 2, 3: (0.5 * 1 / 6 + 0.5) * 1, 4: (0.5 * 2 / 4 + 0.5) * 2}),
    ],
)
def test_text(spark, mode, search, want):
    dl.configure(text_search=mode)
    try:
        df = dl.from_dicts(spark, TEXTS)
        rows = dl.find(df, {"$text": {"$search": search}}, {"score": {"$meta": "textScore"}}).collect()
        assert {r["_id"]: pytest.approx(r["score"]) for r in rows} == want
    finally:
        dl.reset()


def test_text_parts():
    assert stem("relational") == "relat" and stem("hopping") == "hop" and stem("sky") == "sky" and stem("electrical") == "electr"
    assert deburr("Œuvré straße") == "OEuvre strasse" or deburr("Œuvré straße") == "Oeuvre strasse"
    assert parse_search('a "b c" -d', "lightweight") == (["a"], [["b", "c"]], ["d"])


def test_geo_forms(spark):
    docs = [{"_id": i, "p": {"type": "Point", "coordinates": [x, y]}, "q": [x, y], "r": {"lng": x, "lat": y}} for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 1.0), (5.0, 5.0), (-3.0, 2.0)])]
    df = dl.from_dicts(spark, docs)
    ring = [[-4, -1], [2, -1], [2, 3], [-4, 3]]
    far = [[-4 + 6 * i / 300, -1] for i in range(300)] + [[2, 3], [-4, 3]]
    for f in "pqr":
        ids = lambda q: [r["_id"] for r in dl.find(df, {f: q}).collect()]  # noqa: B023, E731
        assert ids({"$geoWithin": {"$polygon": ring}}) == [0, 1, 3] == ids({"$geoWithin": {"$polygon": far}})
        assert ids({"$geoWithin": {"$box": [[2, 3], [-1, -1]]}}) == [0, 1]
        assert ids({"$near": [0, 0], "$maxDistance": 2, "$minDistance": 1}) == [1]
        assert ids({"$near": {"$geometry": {"type": "Point", "coordinates": [0, 0]}, "$maxDistance": 160000}}) == [0, 1]
    near = dl.aggregate(df, [{"$geoNear": {"near": [0, 0], "distanceField": "d.v", "key": "q"}}]).collect()
    assert [r["_id"] for r in near] == [0, 1, 3, 2] and near[1]["d"]["v"] == pytest.approx(2**0.5)
    sphere = dl.aggregate(df, [{"$geoNear": {"near": {"type": "Point", "coordinates": [0, 0]}, "distanceField": "d", "key": "p", "spherical": True, "maxDistance": 0.03}}]).collect()
    assert [r["_id"] for r in sphere] == [0, 1] and sphere[1]["d"] == pytest.approx(0.02468, abs=1e-4)
