import io
import json

import pytest

import doclathe as dl
from doclathe import Collection, ObjectId, SpecError
from doclathe.client import DocumentClient
from doclathe.sources import catalog

DOCS = [{"_id": i, "g": "ab"[i % 2], "n": i, "t": [i, i + 1], "d": [{"k": "x", "v": i}, {"k": "y", "v": 9}], "o": {"p": i}} for i in range(6)]


@pytest.fixture
def c(spark):
    return Collection(DOCS, spark, presence=True)


def docs(c):
    return {d["_id"]: d for d in c.to_list()}


def test_reads(c):
    assert c.count() == 6 and c.count({"g": "a"}) == 3 and c.estimated_document_count() == 6
    assert c.find_one({"n": {"$gt": 2}})["_id"] == 3 and c.find_one({"n": 99}) is None
    assert sorted(c.distinct("t")) == [0, 1, 2, 3, 4, 5, 6] and sorted(c.distinct("g", {"n": {"$gt": 4}})) == ["b"]
    cur = c.find({"n": {"$gte": 1}}, {"n": 1}).sort({"g": -1, "n": 1}).skip(1).limit(3)
    assert cur.to_list() == [{"_id": 3, "n": 3}, {"_id": 5, "n": 5}, {"_id": 2, "n": 2}] == list(cur)
    assert cur.count() == 3 and cur.map(lambda d: d["n"]) == [3, 5, 2]
    assert cur.has_next() and cur.next()["_id"] == 3 and cur.next()["_id"] == 5 and cur.next()["_id"] == 2 and cur.next() is None
    assert cur.explain()["limit"] == 3 and c.find().sort("n").limit(2).explain()["topK"]
    assert c.find({}, {"o.p": 0, "d": 0}).limit(1).to_list() == [{"_id": 0, "g": "a", "n": 0, "t": [0, 1]}]
    assert c.find({"d": {"$elemMatch": {"v": 9}}}, {"d.$": 1}).limit(1).to_list() == [{"_id": 0, "d": [{"k": "y", "v": 9}]}]
    for bad in ({"n": 1, "g": 0}, {"n": 5}, {"n": {"$bad": 1}}):
        with pytest.raises(SpecError):
            c.find({}, bad).to_list()


def test_id_setting(c):
    dl.configure(id_projection=False)
    try:
        assert c.find({"n": 1}, {"g": 1}).to_list() == [{"g": "b"}] and c.find({"n": 1}, {"_id": 1}).to_list() == [{"_id": 1}]
        with pytest.raises(SpecError):
            c.find({}, {"_id": 0, "g": 1}).to_list()
    finally:
        dl.reset()
    with pytest.raises(SpecError):
        dl.configure(nonsense=1)


def test_cursor_pages_equal_lists(spark):
    rows = [{"_id": i, "a": (i * 7) % 8, "b": (i * 5) % 4} for i in range(30)]
    c = Collection(rows, spark)
    for skip, limit, sort in ((0, 0, {"a": 1}), (3, 5, {"a": -1, "b": 1}), (28, 10, {"b": 1}), (0, 4, None), (2, 0, None)):
        want = sorted(rows, key=lambda r: [r[k] * d for k, d in (sort or {}).items()])
        want = want[skip:][: limit or None]
        cur = c.find().skip(skip).limit(limit)
        assert (cur.sort(sort) if sort else cur).to_list() == want


@pytest.mark.parametrize(
    ("update", "path", "want"),
    [
        ({"$set": {"o.q": "z"}}, "o", {"p": 2, "q": "z"}), ({"$inc": {"n": 1.5}}, "n", 3.5), ({"$inc": {"fresh": 2}}, "fresh", 2), ({"$mul": {"n": 4}}, "n", 8), ({"$mul": {"none": 4}}, "none", 0),
        ({"$min": {"n": 1}}, "n", 1), ({"$min": {"n": 9}}, "n", 2), ({"$max": {"n": 9}}, "n", 9), ({"$max": {"made": 3}}, "made", 3), ({"$rename": {"n": "m"}}, "m", 2), ({"$unset": {"o.p": 1}}, "o", {"p": None}),
        ({"$bit": {"n": {"or": 5}}}, "n", 7), ({"$push": {"t": 7}}, "t", [2, 3, 7]), ({"$push": {"t": {"$each": [9, 1], "$sort": 1}}}, "t", [1, 2, 3, 9]), ({"$push": {"t": {"$each": [9, 8], "$position": 1, "$slice": -3}}}, "t", [9, 8, 3]),
        ({"$push": {"d": {"$each": [{"k": "a", "v": 1}], "$sort": {"v": -1, "k": 1}}}}, "d", [{"k": "y", "v": 9}, {"k": "x", "v": 2}, {"k": "a", "v": 1}]), ({"$push": {"w": "a"}}, "w", ["a"]),
        ({"$addToSet": {"t": 2}}, "t", [2, 3]), ({"$addToSet": {"t": {"$each": [2, 5, 5]}}}, "t", [2, 3, 5]), ({"$addToSet": {"d": {"k": "y", "v": 9}}}, "d", [{"k": "x", "v": 2}, {"k": "y", "v": 9}]),
        ({"$pop": {"t": 1}}, "t", [2]), ({"$pop": {"t": -1}}, "t", [3]), ({"$pull": {"t": 3}}, "t", [2]), ({"$pull": {"d": {"v": {"$gt": 5}}}}, "d", [{"k": "x", "v": 2}]), ({"$pullAll": {"t": [2, 3]}}, "t", []),
        ({"$set": {"t.$[]": 0}}, "t", [0, 0]), ({"$inc": {"d.$[].v": 1}}, "d", [{"k": "x", "v": 3}, {"k": "y", "v": 10}]), ({"$set": {"t.1": 8}}, "t", [2, 8]), ({"$set": {"t.3": 8}}, "t", [2, 3, None, 8]),
    ],
)
def test_update_operators(c, update, path, want):
    r = c.update_one({"_id": 2}, update)
    got = docs(c)
    assert got[2].get(path) == want and r["matchedCount"] == 1
    same = {k: v for k, v in got[3].items() if k in DOCS[3]}
    assert same == DOCS[3] or path in ("o", "m")


def test_positional_and_filtered_elements(c):
    assert c.update_many({"d.v": 9, "d": {"$elemMatch": {"k": "y"}}}, {"$set": {"d.$.v": 100}})["matchedCount"] == 0
    r = c.update_many({"d": {"$elemMatch": {"v": {"$gte": 4}}}}, {"$set": {"d.$.v": 100}})
    assert r["modifiedCount"] == 6 and docs(c)[5]["d"] == [{"k": "x", "v": 100}, {"k": "y", "v": 9}] and docs(c)[1]["d"][1]["v"] == 100
    c.update_many({}, {"$inc": {"t.$[e]": 10}}, array_filters=[{"e": {"$gte": 5}}])
    assert docs(c)[4]["t"] == [4, 15] and docs(c)[0]["t"] == [0, 1]
    c.update_many({}, {"$set": {"d.$[e].k": "hit"}}, array_filters=[{"e.v": 100}])
    assert docs(c)[5]["d"][0]["k"] == "hit"
    with pytest.raises(SpecError):
        c.update_many({}, {"$set": {"t.$[q]": 1}})


def test_reports_and_presence(c):
    assert c.update_many({"g": "a"}, {"$set": {"n": 2}}) == {"acknowledged": True, "matchedCount": 3, "modifiedCount": 2, "upsertedCount": 0, "upsertedId": None}
    assert c.update_one({"n": 77}, {"$set": {"x": 1}})["matchedCount"] == 0
    c.update_one({"_id": 1}, {"$unset": {"n": 1}, "$set": {"fresh.deep": 1}})
    assert c.count({"n": {"$exists": False}}) == 1 and c.count({"fresh.deep": {"$exists": True}}) == 1 and c.count({"n": None}) == 0
    for bad in ({"n": 1}, {"$set": {"n": 1}, "g": 2}, {"$bad": {"n": 1}}, {"$inc": {"g": 1}}, {"$pop": {"t": 2}}):
        with pytest.raises(SpecError):
            c.update_one({"_id": 0}, bad)


def test_upsert_replace_find_and_modify(c):
    r = c.update_one({"_id": 50, "g": {"$eq": "z"}, "n": {"$gt": 100}}, {"$inc": {"k": 2}, "$push": {"t": 1}, "$setOnInsert": {"o.p": 7}}, upsert=True)
    assert r["upsertedId"] == 50 and r["upsertedCount"] == 1
    assert {k: v for k, v in docs(c)[50].items() if v is not None} == {"_id": 50, "g": "z", "k": 2, "t": [1], "o": {"p": 7}}
    assert c.replace_one({"_id": 1}, {"n": 5})["modifiedCount"] == 1
    assert {k: v for k, v in docs(c)[1].items() if v is not None} == {"_id": 1, "n": 5} and c.count({"g": {"$exists": False}}) == 1
    with pytest.raises(SpecError):
        c.replace_one({"_id": 1}, {"_id": 2, "n": 5})
    assert c.find_one_and_update({"_id": 3}, {"$set": {"n": 30}})["n"] == 3 and docs(c)[3]["n"] == 30
    assert c.find_one_and_delete({"_id": 3})["n"] == 30 and c.count({"_id": 3}) == 0 and c.find_one_and_delete({"_id": 3}) is None
    assert c.find_one_and_replace({"_id": 4}, {"_id": 40, "n": 1})["_id"] == 4 and 40 in docs(c)


def test_inserts_deletes_bulk(spark, c):
    assert c.insert_one({"_id": 9, "z": 1})["insertedId"] == 9 and c.insert([{"_id": 10}, {"x": 1}])["insertedIds"] == {0: 10, 1: None}
    assert [d["_id"] for d in c.to_list()] == [0, 1, 2, 3, 4, 5, 9, 10, None]
    assert c.delete_one({"g": "a"}) == {"acknowledged": True, "deletedCount": 1} and 0 not in docs(c)
    assert c.delete_many({"n": {"$lt": 4}})["deletedCount"] == 3 and c.remove({"g": "b"}, just_one=True) == {"nRemoved": 1}
    r = c.bulk_write([{"insertOne": {"document": {"_id": 20, "n": 1}}}, {"updateMany": {"filter": {"n": 1}, "update": {"$set": {"n": 2}}}}, {"replaceOne": {"filter": {"_id": 77}, "replacement": {"n": 3}, "upsert": True}}, {"deleteOne": {"filter": {"_id": 20}}}])
    assert (r["insertedCount"], r["modifiedCount"], r["upsertedIds"], r["deletedCount"]) == (1, 1, {2: 77}, 1)
    r = c.bulk_write([{"updateOne": {"filter": {}, "update": {"n": 1}}}, {"insertOne": {"document": {"_id": 30}}}], ordered=False)
    assert r["insertedCount"] == 1 and r["writeErrors"][0]["index"] == 0
    with pytest.raises(SpecError):
        c.bulk_write([{"updateOne": {"filter": {}, "update": {"n": 1}}}, {"insertOne": {"document": {"_id": 31}}}])
    assert c.count({"_id": 31}) == 0
    empty = Collection([], spark)
    assert empty.count() == 0 and empty.insert_one({"a": 1})["insertedCount"] == 1 and empty.to_list() == [{"a": 1}]
    assert c.copy_to(empty) == c.count() and empty.count() == c.count() + 1
    assert c.drop() and c.count() == 0
    dl.configure(auto_id=True)
    try:
        fresh = Collection([], spark)
        assert str(fresh.insert_one({"a": 2})["insertedId"]).startswith("doc_") and fresh.find_one()["_id"].startswith("doc_")
    finally:
        dl.reset()


def test_many_writes_are_checkpointed(spark):
    c = Collection([{"_id": 0, "n": 0}], spark)
    for _ in range(45):
        c.update_many({}, {"$inc": {"n": 1}})
    assert c.find_one()["n"] == 45 and len(c.hidden_frame._jdf.queryExecution().analyzed().toString().splitlines()) < 60


def test_indexes_are_metadata(c):
    assert c.create_index({"g": 1, "n": -1}) == "g_1_n_-1" and c.create_indexes(["n", {"key": {"o.p": 1}}]) == ["n_1", "o.p_1"]
    assert c.index_information()["g_1_n_-1"] == [["g", 1], ["n", -1]] and c.index_exists(["n_1"]) and c.indexes()[1]["key"] == {"n": 1}
    assert "g_1_n_-1" in c.find({"g": "a"}).explain()["access"] and c.find({"t": 1}).explain()["access"] == "scan"
    assert c.index_stats()[0]["accesses"]["ops"] == 1 and c.aggregate([{"$indexStats": {}}]).count() == 3
    assert c.drop_index("n") == {"ok": 1} and len(c.get_indexes()) == 2 and c.drop_indexes() and c.reindex() is c and c.get_indexes() == []


def test_functional_surface_and_registry(spark, c):
    assert dl.count(DOCS, {"g": "a"}) == 3 and dl.find_one(DOCS, {"_id": 2})["n"] == 2 and dl.estimated_document_count(c) == 6
    assert dl.functional.insert_one(c, {"_id": 60})["insertedId"] == 60
    with pytest.raises(TypeError):
        dl.functional.delete_many(c.frame, {})
    catalog.reset()
    assert dl.collection("new", DOCS).count() == 6 and dl.collection("new").count() == 6 and catalog.names() == ["new"] and catalog.drop("new") and not catalog.has("new")


def test_files(spark, c, tmp_path):
    path = str(tmp_path / "a.json")
    assert dl.save_json(c.find({}, {"_id": 1, "n": 1}).frame, path) == 6 and len(json.load(open(path))) == 6
    assert dl.count(dl.read(spark, path), {"n": {"$gt": 2}}) == 3
    dl.write(c.frame, str(tmp_path / "p"))
    assert dl.read(spark, str(tmp_path / "p")).count() == 6


def test_shell(spark, tmp_path):
    from doclathe.cli import Shell

    path = tmp_path / "orders.json"
    path.write_text(json.dumps([{"_id": 1, "status": "A", "qty": 3}, {"_id": 2, "status": "B", "qty": 5}, {"_id": 3, "status": "A", "qty": 8}]))
    s = Shell(spark, io.StringIO())
    assert s.load(str(path)) == 3
    assert s.run('find orders {"status": "A"} {"qty": 1}') == [{"_id": 1, "qty": 3}, {"_id": 3, "qty": 8}]
    assert s.run('aggregate orders [{"$group": {"_id": "$status", "t": {"$sum": "$qty"}}}, {"$sort": {"_id": 1}}]') == [{"_id": "A", "t": 11}, {"_id": "B", "t": 5}]
    assert s.run('count orders {"qty": {"$gt": 4}}') == 2 and "orders" in s.run("show collections")
    s.loop(['insert orders {"_id": 4, "status": "C", "qty": 1}', 'update orders {"_id": 4} {"$inc": {"qty": 5}}', "bad", "distinct orders status", "exit", "never"])
    out = s.out.getvalue()
    assert '"insertedId": 4' in out and "unknown command" in out and '"C"' in out
    assert s.run(f"save orders {tmp_path / 'out.json'}") == 4


def test_client(spark):
    catalog.reset()
    db = DocumentClient("local://host/shop").connect().db()
    c = db.collection("items")
    r = c.insert_many([{"n": 3}, {"n": 1}, {"n": 2}])
    assert r["insertedCount"] == 3 and ObjectId.is_valid(r["insertedIds"][0])
    cur = c.find({"n": {"$gt": 0}}, {"_id": 0, "n": 1}).sort("n").map(lambda d: d["n"])
    assert cur.to_list() == [1, 2, 3] and cur.to_list() == [] and cur.clone().to_list() == [1, 2, 3] and cur.rewind().hint("x").to_list() == [1, 2, 3]
    assert c.aggregate([{"$group": {"_id": None, "s": {"$sum": "$n"}}}]).to_list() == [{"_id": None, "s": 6}]
    b = c.initialize_ordered_bulk_op()
    b.insert({"n": 9}).find({"n": 1}).update_one({"$set": {"n": 10}}).find({"n": 77}).upsert().replace_one({"n": 78})
    assert b.execute()["insertedCount"] == 1
    assert sorted(d["n"] for d in c.find()) == [2, 3, 9, 10, 78]
    assert db.command({"ping": 1})["ok"] == 1 and db.command({"count": "items"})["n"] == 5 and db.stats()["objects"] == 5
    assert c.rename("goods").count_documents({}) == 5 and db.list_collections() == [{"name": "goods", "type": "collection"}]
    assert db.admin().list_databases()["databases"] == [{"name": "shop"}] and db.drop_database() and db.collections() == []
    with pytest.raises(NotImplementedError):
        c.watch()


def test_object_ids():
    a, b = ObjectId(), ObjectId()
    assert a != b and len(str(a)) == 24 and ObjectId(str(a)) == a and not ObjectId.is_valid("zz")
    assert ObjectId.from_time(100).generation_time.timestamp() == 100
    with pytest.raises(ValueError):
        ObjectId("short")
