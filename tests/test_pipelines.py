import pytest

import doclathe as dl
from doclathe import Collection, SpecError

DOCS = [{"_id": i, "g": "abc"[i % 3], "n": i * 2, "t": ["p", "q", "p"][: i % 4], "s": {"x": i, "y": {"z": -i}}, "m": None if i % 4 == 0 else i} for i in range(12)]


@pytest.fixture(scope="module")
def df(spark):
    return dl.from_dicts(spark, DOCS).cache()


def run(df, *stages):
    return dl.to_dicts(dl.aggregate(df, list(stages)))


def test_project_forms(df):
    assert run(df, {"$match": {"_id": 3}}, {"$project": {"s.y.z": 1, "k": {"$add": ["$n", 1]}}}) == [{"_id": 3, "s": {"y": {"z": -3}}, "k": 7}]
    assert run(df, {"$match": {"_id": 3}}, {"$project": {"_id": 0, "s": 0, "t": 0, "m": 0}}) == [{"g": "a", "n": 6}]
    assert run(df, {"$match": {"_id": 3}}, {"$project": {"s": {"x": 1}}}) == [{"_id": 3, "s": {"x": 3}}]
    assert run(df, {"$match": {"_id": 3}}, {"$unset": "s.y.z"}, {"$project": {"s": 1}}) == [{"_id": 3, "s": {"x": 3}}]
    assert run(df, {"$match": {"_id": 3}}, {"$addFields": {"s.w": "$n", "n": "$g"}}, {"$project": {"s.w": 1, "n": 1}}) == [{"_id": 3, "s": {"w": 6}, "n": "a"}]


def test_group_orders_and_nulls(df):
    rows = run(df, {"$group": {"_id": "$g", "all": {"$push": "$m"}, "kinds": {"$addToSet": "$m"}, "f": {"$first": "$m"}, "l": {"$last": "$n"}, "s": {"$sum": "$m"}, "a": {"$avg": "$m"}}}, {"$sort": {"_id": 1}})
    assert rows[0] == {"_id": "a", "all": [None, 3, 6, 9], "kinds": [None, 3, 6, 9], "f": None, "l": 18, "s": 18, "a": 6.0}
    rows = run(df, {"$sort": {"g": -1, "_id": 1}}, {"$group": {"_id": None, "first": {"$first": "$_id"}, "ids": {"$push": "$_id"}}})
    assert rows == [{"_id": None, "first": 2, "ids": [2, 5, 8, 11, 1, 4, 7, 10, 0, 3, 6, 9]}]
    assert run(df, {"$match": {"_id": 99}}, {"$group": {"_id": None, "n": {"$sum": 1}}}) == []
    assert run(df, {"$match": {"_id": 99}}, {"$count": "n"}) == [{"n": 0}]
    assert {r["_id"]["k"]: r["n"] for r in run(df, {"$group": {"_id": {"k": "$m"}, "n": {"$sum": 1}}})}[None] == 3


def test_unwind(df):
    rows = run(df, {"$match": {"_id": {"$lt": 4}}}, {"$unwind": {"path": "$t", "includeArrayIndex": "i"}}, {"$project": {"t": 1, "i": 1}})
    assert [(r["_id"], r["t"], r["i"]) for r in rows] == [(1, "p", 0), (2, "p", 0), (2, "q", 1), (3, "p", 0), (3, "q", 1), (3, "p", 2)]
    rows = run(df, {"$match": {"_id": {"$lt": 2}}}, {"$unwind": {"path": "$t", "preserveNullAndEmptyArrays": True}}, {"$group": {"_id": None, "p": {"$push": "$t"}}})
    assert rows[0]["p"] == [None, "p"]
    with pytest.raises(SpecError):
        dl.aggregate(df, [{"$unwind": "$n"}])


def test_lookup_forms(spark, df):
    other = dl.from_dicts(spark, [{"k": 0, "v": "z"}, {"k": 4, "v": "w"}, {"k": 4, "v": "w2"}, {"k": None, "v": "none"}])
    rows = {r["_id"]: r["o"] for r in run(df, {"$lookup": {"from": other, "localField": "m", "foreignField": "k", "as": "o"}})}
    assert rows[0] == [{"k": None, "v": "none"}] and rows[1] == [] and rows[4] == [{"k": None, "v": "none"}]
    rows = {r["_id"]: [o["v"] for o in r["o"]] for r in run(df, {"$project": {"ks": ["$n", 4, "$n", 0]}}, {"$lookup": {"from": other, "localField": "ks", "foreignField": "k", "as": "o"}})}
    assert rows[2] == ["z", "w", "w2"] and len(rows) == 12
    dl.collection("others", other)
    assert run(df, {"$lookup": {"from": "others", "localField": "g", "foreignField": "k", "as": "o.p"}}, {"$limit": 1})[0]["o"] == {"p": []}
    with pytest.raises(SpecError):
        dl.aggregate(df, [{"$lookup": {"from": "unknown", "localField": "g", "foreignField": "k", "as": "o"}}])


def test_redact_levels(spark):
    doc = {"_id": 1, "level": 1, "cc": {"level": 5, "num": 0, "bill": {"level": 5, "a": "x"}, "ship": [{"level": 3, "a": "s1"}, {"level": 1, "a": "s2"}]}, "open": {"level": 1, "deep": {"level": 9}}}
    df = dl.from_dicts(spark, [doc])
    rows = run(df, {"$redact": {"$cond": {"if": {"$eq": ["$level", 5]}, "then": "$$PRUNE", "else": "$$DESCEND"}}})
    assert rows == [{"_id": 1, "level": 1, "cc": None, "open": {"level": 1, "deep": {"level": 9}}}]
    rows = run(df, {"$redact": {"$cond": [{"$lte": ["$level", 1]}, "$$KEEP", "$$PRUNE"]}})
    assert rows == [doc]
    rows = run(df, {"$redact": {"$cond": [{"$eq": ["$level", 3]}, "$$PRUNE", "$$DESCEND"]}})
    assert rows[0]["cc"]["ship"] == [{"level": 1, "a": "s2"}]


def test_reshape_sample_out(spark, df):
    assert run(df, {"$match": {"_id": 2}}, {"$replaceRoot": {"newRoot": {"$mergeObjects": [{"x": 0, "q": 1}, "$s"]}}}) == [{"x": 2, "q": 1, "y": {"z": -2}}]
    with pytest.raises(Exception, match="not an object"):
        dl.aggregate(dl.from_dicts(spark, [{"a": {"b": 1}}, {"a": None}]), [{"$replaceWith": "$a"}]).collect()
    assert len(run(df, {"$sample": {"size": 5}})) == 5 and len(run(df, {"$sample": {"size": 50}})) == 12
    target = Collection([{"old": 1}], spark)
    assert len(run(df, {"$match": {"g": "a"}}, {"$out": target})) == 4 and target.count() == 4
    run(df, {"$limit": 2}, {"$out": "made"})
    assert dl.collection("made").count() == 2
    assert run(df, {"$sortByCount": "$g"}) == [{"_id": "a", "count": 4}, {"_id": "b", "count": 4}, {"_id": "c", "count": 4}]
    assert [r["_id"] for r in run(df, {"$sort": {"m": 1, "_id": -1}}, {"$skip": 2}, {"$limit": 2})] == [0, 1]


@pytest.mark.parametrize("stages", [[{"$bad": 1}], [{"$match": {}, "$limit": 1}], [{"$out": "x"}, {"$limit": 1}], [{"$limit": -1}], [{"$sort": {"a": 2}}], [{"$group": {"x": {"$sum": 1}}}], [{"$group": {"_id": None, "x": {"$bad": 1}}}], [{"$project": {"a": 1, "n": 0}}], [{"$count": "$n"}]])
def test_errors(df, stages):
    with pytest.raises(SpecError):
        dl.aggregate(df, stages)


def one(spark, spec, doc=None):
    df = dl.from_dicts(spark, [doc or {"_id": 1, "a": 7, "b": 0, "h": 2.5, "neg": -2.5, "s": "Ab c", "l": [3, 1, 2], "u": None, "f": False, "big": 1e20}])
    return dl.to_dicts(dl.aggregate(df, [{"$project": {"_id": 0, "v": spec}}]))[0]["v"]


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ({"$add": []}, 0), ({"$multiply": []}, 1), ({"$add": ["$a", "$u"]}, None), ({"$add": ["$a", 0.5]}, 7.5), ({"$divide": ["$a", "$b"]}, float("inf")),
        ({"$divide": [-1, 0]}, float("-inf")), ({"$mod": [-7, 3]}, -1), ({"$round": ["$neg", 0]}, -2.0), ({"$round": ["$h"]}, 3.0), ({"$round": [1.25, 1]}, 1.3),
        ({"$concat": ["x", "$u", "$a", "-", "$h"]}, "x7-2.5"), ({"$concat": ["$missing"]}, ""), ({"$toUpper": "$u"}, ""), ({"$split": ["a.b.c", "."]}, ["a", "b", "c"]),
        ({"$split": ["ab", ""]}, ["a", "b"]), ({"$substrCP": ["$s", 1, 2]}, "b "), ({"$substr": ["$s", -2, 2]}, " c"), ({"$trim": {"input": "\t x \n"}}, "x"),
        ({"$cmp": ["$a", "$b"]}, 1), ({"$cond": ["$s", 1, 2]}, 1), ({"$cond": [0, 1, 2]}, 2), ({"$cond": ["", "yes", "no"]}, "yes"), ({"$ifNull": ["$u", "$missing", "four"]}, "four"), ({"$ifNull": ["$missing", 4]}, 4), ({"$cond": [True, "$a", "x"]}, "7"),
        ({"$and": [1, "a", True]}, True), ({"$or": [0, None, False]}, False), ({"$not": [0]}, True), ({"$size": "$l"}, 3), ({"$arrayElemAt": ["$l", -1]}, 2),
        ({"$arrayElemAt": ["$l", 5]}, None), ({"$in": [1, "$l"]}, True), ({"$in": [1, "$s"]}, False), ({"$concatArrays": ["$l", [9]]}, [3, 1, 2, 9]), ({"$concatArrays": ["$l", "$u"]}, ["3", "1", "2", None]), ({"$concatArrays": ["$l", None, 4]}, [3, 1, 2, None, 4]),
        ({"$reverseArray": "$l"}, [2, 1, 3]), ({"$map": {"input": "$l", "in": {"$multiply": ["$$this", 2]}}}, [6, 2, 4]),
        ({"$filter": {"input": "$l", "as": "e", "cond": {"$gte": ["$$e", 2]}}}, [3, 2]), ({"$mergeObjects": [{"a": 1}, None, {"b": "$a", "a": "$missing"}]}, {"a": None, "b": 7}), ({"$mergeObjects": [{"a": 1, "c": 2}, {"a": "$u"}, {"$ifNull": ["$missing", None]}]}, {"a": None, "c": 2}),
        ({"$literal": {"$add": [1]}}, {"$add": [1]}), ({"$eq": [{"a": [1]}, {"a": [1]}]}, True), ({"$eq": ["$u", "$missing"]}, True), ({"$gt": ["$s", 1]}, False),
        ({"$switch": {"branches": [{"case": "$f", "then": 1}], "default": 2}}, 2), ({"$strLenCP": "héé"}, 3), ({"x": "$a", "y": ["$b"]}, {"x": 7, "y": [0]}), ({"$pow": ["$a", 2]}, 49.0), ({"$sqrt": 9}, 3.0),
        ({"$abs": -3}, 3), ({"$ceil": 1.2}, 2.0), ({"$floor": -1.2}, -2.0), ({"$ne": [1, 1.0]}, False), ({"$toLower": "ÀB"}, "àb"),
    ],
)
def test_expressions(spark, spec, want):
    assert one(spark, spec) == want


def test_expression_errors(spark):
    for spec in ({"$bad": 1}, {"$add": 1, "$abs": 1}, "$$nope"):
        with pytest.raises(SpecError):
            one(spark, spec)
    with pytest.raises(Exception, match="no branch"):
        one(spark, {"$switch": {"branches": [{"case": False, "then": 1}]}})
    assert 0 <= one(spark, {"$rand": {}}) < 1


def test_extensions(spark, df):
    from pyspark.sql import functions as F

    dl.register_operator("post", "$even", lambda c, on: (c % 2 == 0) == on)
    dl.register_operator("pre", "$bigger", lambda f, names: f[names[0]] > f[names[1]])
    seen = []
    dl.register_operator("preprocess", "$note", seen.append)
    dl.register_expression("$double", lambda c: c * 2, "bigint")
    dl.register_accumulator("$spread", lambda c: F.max(c) - F.min(c))
    dl.register_stage("$tail", lambda d, n: d.orderBy(F.desc("_id")).limit(n))
    try:
        assert dl.count(df, {"_id": {"$even": True}, "$note": "x"}) == 6 and seen == ["x"]
        assert dl.count(df, {"$bigger": ["n", "_id"]}) == 11
        assert run(df, {"$tail": 1}, {"$project": {"d": {"$double": "$n"}}}) == [{"_id": 11, "d": 44}]
        assert run(df, {"$group": {"_id": None, "w": {"$spread": "$n"}}}) == [{"_id": None, "w": 22}]
    finally:
        for n in ("$even", "$bigger", "$note"):
            dl.extend.unregister_operator(n)
    with pytest.raises(SpecError):
        dl.count(df, {"_id": {"$even": True}})


def test_streams(spark, tmp_path):
    from doclathe.streaming import stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, [1, 2], "a"), (2, [3], "b"), (3, [], "a")], "id long, xs array<long>, g string").write.parquet(source)
    df = stream.read_stream(spark, source, "id long, xs array<long>, g string")
    q = stream.run(df, [{"$match": {"id": {"$lt": 3}}}, {"$unwind": "$xs"}, {"$project": {"y": {"$multiply": ["$xs", 10]}}}], name="flat")
    q.processAllAvailable()
    assert sorted(r.y for r in spark.sql("select * from flat").collect()) == [10, 20, 30]
    q.stop()
    q = stream.run(df, [{"$group": {"_id": "$g", "n": {"$sum": 1}}}], name="grouped")
    q.processAllAvailable()
    assert {r["_id"]: r.n for r in spark.sql("select * from grouped").collect()} == {"a": 2, "b": 1}
    q.stop()
    for stages in ([{"$sort": {"id": 1}}], [{"$group": {"_id": None, "x": {"$push": "$id"}}}], [{"$skip": 1}]):
        with pytest.raises(SpecError):
            stream.run(df, stages)
