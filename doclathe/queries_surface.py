"""Queries with SQL for what is not one filter, stage or expression: collections, cursors, writes of one document,
text modes, indexes, settings, extensions, fields of any type, the facade and the shell.

Single values and reports are small frames made on the driver."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import doclathe as dl
from doclathe import extend
from doclathe import functional as fn
from doclathe.cli import Shell
from doclathe.client import DocumentClient
from doclathe.collection import Collection
from doclathe.context import SpecError, settings
from doclathe.functions.text import stem
from doclathe.object_id import ObjectId
from doclathe.queries import put, table
from doclathe.sources import catalog, documents
from doclathe.sources.scratch import shared_dir


def small(name: str, schema: str, run: Callable, sql: str) -> None:
    """run(spark, sf_dir) -> rows."""
    put(name, lambda spark, d: spark.createDataFrame([tuple(r) for r in run(spark, d)], schema), sql)


def of(source: str, run: Callable[[Collection], object]) -> Callable:
    return lambda spark, d: run(Collection(table(spark, d, source)))


def refused(f: Callable) -> bool:
    try:
        f()
    except SpecError:
        return True
    return False


def name_of() -> str:
    return f"q{uuid.uuid4().hex}"


# Sources, sinks and names.
put("source_documents", lambda spark, d: documents.from_dicts(spark, documents.to_dicts(table(spark, d, "nation"))), "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")


def _by_name(spark, d) -> DataFrame:
    name = name_of()
    dl.collection(name, table(spark, d, "customer"))
    found = dl.collection(name).find({"c_acctbal": {"$lt": 0}}, {"c_custkey": 1}).frame
    catalog.drop(name)
    return found


put("collection_by_name", _by_name, "SELECT c_custkey FROM customer WHERE c_acctbal < 0")


def _registry(spark, d):
    a, b = name_of(), name_of()
    catalog.put(a, Collection(table(spark, d, "region")))
    yield "has", catalog.has(a) and not catalog.has(b)
    yield "names", a in catalog.names()
    yield "made", dl.collection(b).count() == 0 and catalog.has(b)
    yield "drop", catalog.drop(a) and not catalog.drop(a) and catalog.get(a) is None
    catalog.drop(b)


small("collection_registry", "step string, ok boolean", _registry, "SELECT * FROM (VALUES ('has', true), ('names', true), ('made', true), ('drop', true)) t(step, ok)")


def _saved(spark, d) -> tuple[str, int]:
    path = f"{shared_dir(spark).removeprefix('file://')}/{name_of()}.json"
    return path, dl.save_json(table(spark, d, "supplier"), path)


def _json_saved(spark, d):
    path, n = _saved(spark, d)
    with open(path) as f:
        yield n, len(json.load(f))


put("json_array_load", lambda spark, d: dl.read(spark, _saved(spark, d)[0]), "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier")
small("json_array_save", "saved long, parsed long", _json_saved, "SELECT count(*) AS saved, count(*) AS parsed FROM supplier")

# Filters.
put("filter_where_document", lambda spark, d: fn.find(table(spark, d, "part"), {"$where": lambda doc: len(doc["p_name"]) > 12}, {"p_partkey": 1}), "SELECT p_partkey FROM part WHERE length(p_name) > 12")
put("filter_in_objects", lambda spark, d: fn.find(table(spark, d, "nation").select("n_nationkey", F.struct("n_name", "n_regionkey").alias("o")), {"o": {"$in": [{"n_name": "NATION_3", "n_regionkey": 3}, 7]}}, {"n_nationkey": 1}), "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3' AND n_regionkey = 3")
small(
    "match_document", "r_regionkey long, ok boolean",
    lambda spark, d: [(r["r_regionkey"], fn.matches(r, {"r_regionkey": {"$gte": 2}})) for r in documents.to_dicts(table(spark, d, "region"))],
    "SELECT r_regionkey::BIGINT AS r_regionkey, r_regionkey >= 2 AS ok FROM region",
)


def _own_operator(spark, d) -> DataFrame:
    extend.register_operator("post", "$endsIn", lambda column, x: column.endswith(x))
    try:
        return fn.find(table(spark, d, "part"), {"p_brand": {"$endsIn": "1"}}, {"p_partkey": 1})
    finally:
        extend.unregister_operator("$endsIn")


put("extend_operator", _own_operator, "SELECT p_partkey FROM part WHERE p_brand LIKE '%1'")
put(
    "filter_unique_docs",
    lambda spark, d: fn.find(table(spark, d, "customer").select("c_custkey", F.array(F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double")).alias("loc")), {"loc": {"$near": [10, 10], "$maxDistance": 20, "$uniqueDocs": True}}, {"c_custkey": 1}),
    "SELECT c_custkey FROM customer WHERE sqrt(pow(c_acctbal / 100 - 10, 2) + pow(c_nationkey - 10, 2)) <= 20",
)

# Projections.
_WITH_ID = lambda spark, d: table(spark, d, "nation").select(F.col("n_nationkey").alias("_id"), "n_name", "n_regionkey")
small("projection_modes", "refused boolean", lambda spark, d: [(all(refused(lambda p=p: fn.find(table(spark, d, "nation"), {}, p)) for p in ({"n_name": 1, "n_regionkey": 0}, {"n_name": 5})),)], "SELECT true AS refused")
put("projection_id_default", lambda spark, d: fn.find(_WITH_ID(spark, d), {}, {"n_name": 1}), "SELECT n_nationkey AS _id, n_name FROM nation")
put("projection_id_off", lambda spark, d: fn.find(_WITH_ID(spark, d), {}, {"n_name": 1, "_id": 0}), "SELECT n_name FROM nation")
put(
    "projection_text_score",
    lambda spark, d: fn.find(table(spark, d, "part").select("p_partkey", "p_name"), {"$text": {"$search": "red small red"}}, {"p_partkey": 1, "score": {"$meta": "textScore"}}),
    """SELECT p_partkey, CAST(len(list_filter(w, lambda x: x = 'red')) * 2 + len(list_filter(w, lambda x: x = 'small')) AS DOUBLE) AS score
       FROM (SELECT p_partkey, regexp_split_to_array(lower(p_name), '[^a-z0-9]+') AS w FROM part) WHERE list_has_any(w, ['red', 'small'])""",
)


# Text modes.
def _in_mode(mode: str, search: str, keep: dict):
    def run(spark, d) -> DataFrame:
        dl.configure(text_search=mode)
        try:
            return fn.find(table(spark, d, "part").select("p_partkey", "p_name"), {"$text": {"$search": search}}, keep)
        finally:
            dl.configure(text_search="lightweight")

    return run


_SCORED = {"p_partkey": 1, "score": {"$meta": "textScore"}}
_TOKENS = "(SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part)"
_HITS = "len(list_filter(w, lambda x: x IN ('red', 'small')))"
put("text_stemming", _in_mode("stemming", "smalls the reds", _SCORED), f"SELECT p_partkey, CAST({_HITS} AS DOUBLE) AS score FROM {_TOKENS} WHERE {_HITS} > 0")
put("text_exact", lambda spark, d: _in_mode("exact", "red small", _SCORED)(spark, d).withColumn("score", F.round("score", 9)), f"SELECT p_partkey, round((0.5 * {_HITS} / len(w) + 0.5) * len(list_filter(['red', 'small'], lambda x: list_contains(w, x))), 9) AS score FROM {_TOKENS} WHERE {_HITS} > 0")
put("text_stop_words", _in_mode("stemming", "the of and", {"p_partkey": 1}), "SELECT p_partkey FROM part WHERE false")
put("text_empty", _in_mode("lightweight", " ", {"p_partkey": 1}), "SELECT p_partkey FROM part WHERE false")
_STEMS = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "falling": "fall", "relational": "relat", "conditional": "condit", "possibly": "possibl", "possible": "possibl", "psychology": "psycholog", "generalizations": "gener", "adoption": "adopt", "sky": "sky", "happy": "happi"}
small("text_stemmer", "word string, stem string", lambda spark, d: [(w, stem(w)) for w in _STEMS], "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in _STEMS.items()) + ") t(word, stem)")


def _modes(spark, d):
    for mode in ("stemming", "exact", "lightweight"):
        dl.configure(text_search=mode)
        yield mode, settings().text_search == mode
    yield "nonsense", refused(lambda: dl.configure(text_search="nonsense"))


small("text_mode", "mode string, ok boolean", _modes, "SELECT * FROM (VALUES ('stemming', true), ('exact', true), ('lightweight', true), ('nonsense', true)) t(mode, ok)")

# Reads and cursors.
small("find_one", "n_name string", lambda spark, d: [(fn.find_one(table(spark, d, "nation"), {"n_nationkey": 7})["n_name"],)], "SELECT n_name FROM nation WHERE n_nationkey = 7")
small("count", "n long", lambda spark, d: [(fn.count(table(spark, d, "orders"), {"o_orderstatus": "F"}),)], "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
small("count_documents", "n long", lambda spark, d: [(fn.count_documents(table(spark, d, "lineitem"), {"l_quantity": {"$gt": 20}}),)], "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 20")
small("estimated_document_count", "n long", lambda spark, d: [(fn.estimated_document_count(table(spark, d, "lineitem")),)], "SELECT count(*) AS n FROM lineitem")
small("collection_reads", "one string, n long, kinds long", of("orders", lambda c: [(c.find_one({"o_orderkey": 1}, {"o_orderstatus": 1})["o_orderstatus"], c.count({"o_totalprice": {"$gt": 1000}}), len(c.distinct("o_orderstatus")))]), "SELECT (SELECT o_orderstatus FROM orders WHERE o_orderkey = 1) AS one, (SELECT count(*) FROM orders WHERE o_totalprice > 1000) AS n, (SELECT count(DISTINCT o_orderstatus) FROM orders) AS kinds")
small("collection_to_list", "n_nationkey long, n_name string", of("nation", lambda c: [(r["n_nationkey"], r["n_name"]) for r in c.to_list()]), "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
_TOP = lambda c: c.find({"c_acctbal": {"$gt": 0}}).sort({"c_acctbal": -1, "c_custkey": 1})
_TOP_SQL = "SELECT c_custkey::BIGINT AS k, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS place FROM customer WHERE c_acctbal > 0"
small("cursor_to_list", "k long, place long", of("customer", lambda c: [(r["c_custkey"], i) for i, r in enumerate(_TOP(c).to_list())]), _TOP_SQL)
small("cursor_iterator", "k long, place long", of("customer", lambda c: [(r["c_custkey"], i) for i, r in enumerate(_TOP(c))]), _TOP_SQL)
small("cursor_stream", "k long, place long", of("customer", lambda c: [(r["c_custkey"], i) for i, r in enumerate(_TOP(c).stream())]), _TOP_SQL)
small("cursor_map", "k long", of("customer", lambda c: [(k,) for k in _TOP(c).limit(9).map(lambda r: r["c_custkey"])]), f"SELECT k FROM ({_TOP_SQL}) WHERE place < 9")


def _each(c: Collection):
    out: list = []
    _TOP(c).skip(3).limit(6).for_each(lambda r: out.append((r["c_custkey"],)))
    return out


def _walked(c: Collection):
    cursor, place = _TOP(c), 0
    while cursor.has_next():
        yield cursor.next()["c_custkey"], place
        place += 1


small("cursor_for_each", "k long", of("customer", _each), f"SELECT k FROM ({_TOP_SQL}) WHERE place BETWEEN 3 AND 8")
small("cursor_has_next", "k long, place long", of("customer", lambda c: list(_walked(c))), _TOP_SQL)
small("cursor_count", "n long, page long", of("customer", lambda c: [(_TOP(c).count(), _TOP(c).skip(5).limit(7).count())]), "SELECT count(*) AS n, least(7, greatest(0, count(*) - 5)) AS page FROM customer WHERE c_acctbal > 0")
put("cursor_skip", lambda spark, d: Collection(table(spark, d, "customer")).find({}, {"c_custkey": 1}).sort({"c_acctbal": -1, "c_custkey": 1}).skip(40).frame, "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey OFFSET 40")
put("stage_skip", lambda spark, d: fn.aggregate(table(spark, d, "orders"), [{"$sort": {"o_totalprice": 1, "o_orderkey": 1}}, {"$skip": 100}, {"$project": {"o_orderkey": 1}}]), "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey OFFSET 100")
put(
    "stage_sort_order",
    lambda spark, d: fn.aggregate(table(spark, d, "supplier"), [{"$sort": {"s_nationkey": -1, "s_suppkey": 1}}, {"$group": {"_id": None, "keys": {"$push": "$s_suppkey"}}}]).select(F.array_join("keys", ",").alias("keys")),
    "SELECT string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_nationkey DESC, s_suppkey) AS keys FROM supplier",
)
small("cursor_explain", "top_k boolean, n long", of("customer", lambda c: [((e := _TOP(c).limit(5).explain())["topK"], e["limit"])]), "SELECT true AS top_k, 5::BIGINT AS n")


# Writes of one document, to a frame that was shuffled.
def _shuffled(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_custkey").alias("o_custkey"), F.max("o_orderstatus").alias("status"))


def _one_write(write: Callable[[Collection, int], object]):
    """How many documents inside and outside the filter changed or went; the filter: keys above a number."""

    def run(spark, d) -> DataFrame:
        before = _shuffled(spark, d)
        c = Collection(before)
        line = 300
        write(c, line)
        after = c.frame.select("o_orderkey", F.col("status").alias("now"))
        both = before.join(after, "o_orderkey", "left").withColumn("changed", ~F.col("status").eqNullSafe(F.col("now")))
        return both.agg(F.count_if(F.col("changed") & (F.col("o_orderkey") >= line)).alias("inside"), F.count_if(F.col("changed") & (F.col("o_orderkey") < line)).alias("outside"))

    return run


_ONE = "SELECT 1::BIGINT AS inside, 0::BIGINT AS outside"
_SET = {"$set": {"status": "hit"}}
put("update_one", _one_write(lambda c, n: c.update_one({"o_orderkey": {"$gte": n}}, _SET)), _ONE)
put("delete_one", _one_write(lambda c, n: c.delete_one({"o_orderkey": {"$gte": n}})), _ONE)
put("remove", _one_write(lambda c, n: c.remove({"o_orderkey": {"$gte": n}}, just_one=True)), _ONE)
put("replace_one_of_many", _one_write(lambda c, n: c.replace_one({"o_orderkey": {"$gte": n}}, {"status": "hit"})), _ONE)
put("bulk_write_one", _one_write(lambda c, n: c.bulk_write([{"updateOne": {"filter": {"o_orderkey": {"$gte": n}}, "update": _SET}}])), _ONE)


def _found_and(write: Callable[[Collection, int], dict]):
    """Whether the document that came back is the one that changed, and only it."""

    def run(spark, d):
        before = _shuffled(spark, d)
        c = Collection(before)
        got = write(c, 300)
        left = c.frame.filter(F.col("o_orderkey") == got["o_orderkey"]).filter(F.col("status") != "hit").count()
        same = before.join(c.frame, ["o_orderkey", "o_custkey", "status"], "left_semi").count()
        yield got["o_orderkey"] >= 300, left == 0, before.count() - same

    return run


_FOUND = "SELECT true AS inside, true AS changed, 1::BIGINT AS others"
_FOUND_SCHEMA = "inside boolean, changed boolean, others long"
small("find_one_and_update", _FOUND_SCHEMA, _found_and(lambda c, n: c.find_one_and_update({"o_orderkey": {"$gte": n}}, _SET)), _FOUND)
small("find_one_and_delete", _FOUND_SCHEMA, _found_and(lambda c, n: c.find_one_and_delete({"o_orderkey": {"$gte": n}})), _FOUND)
small("find_one_and_replace", _FOUND_SCHEMA, _found_and(lambda c, n: c.find_one_and_replace({"o_orderkey": {"$gte": n}}, {"o_orderkey": -1, "status": "hit"})), _FOUND)


def _written(source: str, write: Callable[[Collection], object]):
    def run(spark, d) -> DataFrame:
        c = Collection(table(spark, d, source))
        write(c)
        return c.frame

    return run


_REGION = "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region"
put("insert_one", _written("region", lambda c: c.insert_one({"r_regionkey": 7, "r_name": "A"})), f"{_REGION} UNION ALL SELECT 7, 'A'")
put("insert", _written("region", lambda c: (c.insert({"r_regionkey": 7, "r_name": "A"}), c.insert([{"r_regionkey": 8}]))), f"{_REGION} UNION ALL VALUES (7, 'A'), (8, NULL)")
put("delete_many_of_shuffled", lambda spark, d: _delete_shuffled(spark, d), "SELECT o_orderkey FROM orders WHERE o_orderkey < 300")


def _delete_shuffled(spark, d) -> DataFrame:
    c = Collection(_shuffled(spark, d))
    c.delete_many({"o_orderkey": {"$gte": 300}})
    return c.frame.select("o_orderkey")


def _auto_id(spark, d):
    dl.configure(auto_id=True)
    try:
        c = Collection([], spark)
        given = [c.insert_one({"a": i})["insertedId"] for i in range(3)]
        yield len(set(given)), c.count({"_id": given[1], "a": 1})
    finally:
        dl.configure(auto_id=False)


small("auto_id", "different long, found long", _auto_id, "SELECT 3::BIGINT AS different, 1::BIGINT AS found")
small("collection_drop", "dropped boolean, n long, indexes long", of("region", lambda c: [(c.create_index("r_name") == "r_name_1" and c.drop(), c.count(), len(c.get_indexes()))]), "SELECT true AS dropped, 0::BIGINT AS n, 0::BIGINT AS indexes")
small("functional_drop", "dropped boolean, n long", of("region", lambda c: [(fn.drop(c), c.count())]), "SELECT true AS dropped, 0::BIGINT AS n")
small("update_needs_operators", "refused boolean", of("region", lambda c: [(all(refused(lambda u=u: c.update_one({}, u)) for u in ({"r_name": "x"}, {"$set": {"r_name": "x"}, "r_name": 1}, {"$none": {"r_name": 1}})) and refused(lambda: c.replace_one({}, _SET)),)]), "SELECT true AS refused")
put(
    "bulk_write_inserts",
    _written("region", lambda c: c.bulk_write([{"insertOne": {"document": {"r_regionkey": 50 + i, "r_name": "N"}}} for i in range(30)] + [{"deleteMany": {"filter": {"r_regionkey": {"$gte": 70}}}}])),
    f"{_REGION} UNION ALL SELECT 50 + i, 'N' FROM range(20) t(i)",
)


# Indexes: names, statistics, and the choice for a filter.
def _indexed(run: Callable[[Collection], list]):
    def start(c: Collection):
        c.create_index({"n_regionkey": 1, "n_name": -1})
        c.create_indexes(["n_nationkey", {"key": {"n_name": 1}}])
        return run(c)

    return of("nation", start)


def _names(name: str, run: Callable[[Collection], list], want: list[str]) -> None:
    small(name, "name string", _indexed(lambda c: [(x,) for x in run(c)]), "SELECT * FROM (VALUES " + ", ".join(f"('{w}')" for w in want) + ") t(name)")


_ALL = ["n_regionkey_1_n_name_-1", "n_nationkey_1", "n_name_1"]
_names("index_create", lambda c: [c.create_index("n_comment")], ["n_comment_1"])
_names("index_create_many", lambda c: c.create_indexes([{"key": {"a": 1, "b": -1}}, "c"]), ["a_1_b_-1", "c_1"])
_names("index_names", lambda c: c.get_indexes(), _ALL)
_names("index_drop", lambda c: (c.drop_index("n_name"), c.drop_index({"n_regionkey": 1, "n_name": -1}), c.get_indexes())[2], ["n_nationkey_1"])
_names("index_list", lambda c: [i["name"] for i in c.list_indexes()], _ALL)
_names("index_information", lambda c: [f"{n}:{k}" for n, i in c.index_information().items() for k, _ in i], ["n_regionkey_1_n_name_-1:n_regionkey", "n_regionkey_1_n_name_-1:n_name", "n_nationkey_1:n_nationkey", "n_name_1:n_name"])
small("index_drop_all", "dropped boolean, n long", _indexed(lambda c: [(c.drop_indexes(), len(c.get_indexes()))]), "SELECT true AS dropped, 0::BIGINT AS n")
small("index_exists", "one boolean, other boolean", _indexed(lambda c: [(c.index_exists(["n_name_1"]), c.index_exists(["n_name_1", "none"]))]), "SELECT true AS one, false AS other")
small("index_reindex", "same boolean, n long", _indexed(lambda c: [(c.reindex() is c, len(c.get_indexes()))]), "SELECT true AS same, 3::BIGINT AS n")
small("index_accesses", "name string, ops long", _indexed(lambda c: (c.count({"n_nationkey": 3}), c.count({"n_name": {"$gt": "N"}}), c.count({"n_name": "x"}), [(i["name"], i["accesses"]["ops"]) for i in c.index_stats()])[-1]), "SELECT * FROM (VALUES ('n_regionkey_1_n_name_-1', 0::BIGINT), ('n_nationkey_1', 1), ('n_name_1', 2)) t(name, ops)")
_PLANS = {
    "equality": ({"n_nationkey": 3}, "n_nationkey_1"),
    "range": ({"n_nationkey": {"$gte": 3, "$lt": 9}}, "n_nationkey_1"),
    "in": ({"n_name": {"$in": ["a", "b"]}}, "n_name_1"),
    "prefix": ({"n_name": "a", "n_regionkey": 1}, "n_regionkey_1_n_name_-1"),
    "or": ({"$or": [{"n_nationkey": 1}, {"n_name": "a"}]}, "n_nationkey_1, n_name_1"),
    "or with a scan": ({"$or": [{"n_nationkey": 1}, {"n_comment": "a"}]}, None),
    "other operator": ({"n_name": {"$regex": "a"}}, None),
}
small(
    "index_planner", "shape string, plan string", _indexed(lambda c: [(k, c.find(q).explain()["access"]) for k, (q, _) in _PLANS.items()]),
    "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{f'index {n}, by scan with pushed filters' if n else 'scan'}')" for k, (_, n) in _PLANS.items()) + ") t(shape, plan)",
)


# Settings and extensions.
def _configured(spark, d):
    dl.configure(id_projection=False, where_timeout=5)
    yield "configured", settings().id_projection is False and settings().where_timeout == 5
    dl.reset()
    yield "reset", settings().id_projection is True and settings().where_timeout == 1000
    yield "unknown", refused(lambda: dl.configure(nonsense=1))


small("configure_reset", "step string, ok boolean", _configured, "SELECT * FROM (VALUES ('configured', true), ('reset', true), ('unknown', true)) t(step, ok)")


def _extended(spark, d) -> DataFrame:
    extend.register_expression("$double", lambda c: c * 2, "long")
    extend.register_accumulator("$spread", lambda c: F.max(c) - F.min(c), "long")
    extend.register_stage("$only", lambda df, n: df.filter(F.col("n") > n))
    try:
        return fn.aggregate(table(spark, d, "nation"), [{"$addFields": {"twice": {"$double": "$n_nationkey"}}}, {"$group": {"_id": "$n_regionkey", "spread": {"$spread": "$twice"}, "n": {"$sum": 1}}}, {"$only": 3}])
    finally:
        from doclathe.functions import expression
        from doclathe.operators import accumulators, stages

        del expression.OPERATORS["$double"], accumulators.ACCUMULATORS["$spread"], stages.STAGES["$only"]


put("extend_pipeline", _extended, "SELECT n_regionkey AS _id, CAST(2 * (max(n_nationkey) - min(n_nationkey)) AS BIGINT) AS spread, count(*) AS n FROM nation GROUP BY 1 HAVING count(*) > 3")

# Fields of any type: a number, text, a truth value or null by the key.
_MIXED_SQL = "(SELECT s_suppkey AS k, s_nationkey % 3 AS g, s_suppkey % 4 AS kind FROM supplier)"


def _mixed(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, F.concat(F.lit('"s'), k.cast("string"), F.lit('"'))).when(k % 4 == 2, F.when(k % 8 == 2, "true").otherwise("false")).otherwise("null")
    return table(spark, d, "supplier").select(k.alias("k"), (F.col("s_nationkey") % 3).alias("g"), F.parse_json(text).alias("v"))


put(
    "variant_accumulators",
    lambda spark, d: fn.aggregate(_mixed(spark, d), [{"$group": {"_id": "$g", "total": {"$sum": "$v"}, "mean": {"$avg": "$v"}, "least": {"$min": "$v"}, "most": {"$max": "$v"}}}]).select("_id", "total", F.round("mean", 6).alias("mean"), F.to_json("least").alias("least"), F.to_json("most").alias("most")),
    f"""SELECT g AS _id, CAST(coalesce(sum(k) FILTER (kind = 0), 0) AS DOUBLE) AS total, round(avg(k) FILTER (kind = 0), 6) AS mean,
        coalesce(CAST(min(k) FILTER (kind = 0) AS VARCHAR), '"' || min('s' || k) FILTER (kind = 1) || '"', CASE WHEN bool_and(k % 8 = 2) FILTER (kind = 2) THEN 'true' ELSE 'false' END) AS least,
        coalesce(CASE WHEN count(*) FILTER (kind = 2) > 0 THEN CASE WHEN bool_or(k % 8 = 2) FILTER (kind = 2) THEN 'true' ELSE 'false' END END, '"' || max('s' || k) FILTER (kind = 1) || '"', CAST(max(k) FILTER (kind = 0) AS VARCHAR)) AS most
        FROM {_MIXED_SQL} GROUP BY 1""",
)
_MIXED_ORDER = "ORDER BY CASE kind WHEN 3 THEN 0 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END, CASE WHEN kind = 0 THEN k WHEN kind = 2 THEN CASE WHEN k % 8 = 2 THEN 1 ELSE 0 END END, CASE WHEN kind = 1 THEN 's' || k END, k"
put(
    "variant_sort",
    lambda spark, d: fn.aggregate(_mixed(spark, d), [{"$sort": {"v": 1, "k": 1}}, {"$group": {"_id": None, "keys": {"$push": "$k"}}}]).select(F.array_join("keys", ",").alias("keys")),
    f"SELECT string_agg(k::VARCHAR, ',' {_MIXED_ORDER}) AS keys FROM {_MIXED_SQL}",
)
put(
    "variant_group",
    lambda spark, d: fn.aggregate(_mixed(spark, d), [{"$group": {"_id": "$v", "n": {"$sum": 1}}}]).select(F.to_json("_id").alias("_id"), "n"),
    f"""SELECT CASE kind WHEN 0 THEN k::VARCHAR WHEN 1 THEN '"s' || k || '"' WHEN 2 THEN CASE WHEN k % 8 = 2 THEN 'true' ELSE 'false' END END AS _id, count(*) AS n FROM {_MIXED_SQL} GROUP BY 1""",
)


# The facade, object ids and the shell.
def _client(spark, d):
    client = DocumentClient(f"local://host/{name_of()}").connect()
    db = client.db()
    items = db.create_collection("items")
    items.insert_many([{"n": r["n_nationkey"], "r": r["n_regionkey"]} for r in documents.to_dicts(table(spark, d, "nation"))])
    yield "count", items.count_documents({"r": 1})
    yield "find cursor", sum(x["n"] for x in items.find({"r": {"$gte": 3}}).sort("n", -1).limit(3))
    yield "aggregation cursor", items.aggregate([{"$match": {"r": 2}}]).group({"_id": "$r", "s": {"$sum": "$n"}}).next()["s"]
    yield "ids", len({x["_id"] for x in items.find()})
    yield "command", db.command({"count": "items"})["n"]
    yield "collections", len(db.list_collections())
    yield "databases", int(db.name in [x["name"] for x in db.admin().list_databases()["databases"]])
    db.drop_database()
    yield "dropped", len(db.collections())


small(
    "client", "step string, n long", _client,
    """SELECT * FROM (VALUES ('count', (SELECT count(*) FROM nation WHERE n_regionkey = 1)),
       ('find cursor', (SELECT sum(n_nationkey)::BIGINT FROM (SELECT n_nationkey FROM nation WHERE n_regionkey >= 3 ORDER BY 1 DESC LIMIT 3))),
       ('aggregation cursor', (SELECT sum(n_nationkey)::BIGINT FROM nation WHERE n_regionkey = 2)), ('ids', (SELECT count(*) FROM nation)), ('command', (SELECT count(*) FROM nation)),
       ('collections', 1), ('databases', 1), ('dropped', 0)) t(step, n)""",
)


def _ids(spark, d):
    a = ObjectId()
    yield len(str(a)), ObjectId(str(a)) == a, ObjectId.is_valid("zz"), int(ObjectId.from_time(100).generation_time.timestamp())


small("object_id", "n long, same boolean, valid boolean, at long", _ids, "SELECT 24::BIGINT AS n, true AS same, false AS valid, 100::BIGINT AS at")


def _shell(spark, d):
    shell, name = Shell(spark, io.StringIO()), name_of()
    catalog.put(name, Collection(table(spark, d, "nation")))
    yield "find", len(shell.run(f'find {name} {{"n_regionkey": 1}} {{"n_name": 1}}'))
    yield "count", shell.run(f"count {name}")
    yield "distinct", len(shell.run(f"distinct {name} n_regionkey"))
    yield "aggregate", shell.run(f'aggregate {name} [{{"$group": {{"_id": null, "s": {{"$sum": "$n_nationkey"}}}}}}]')[0]["s"]
    shell.loop([f'update {name} {{"n_regionkey": 2}} {{"$inc": {{"n_regionkey": 50}}}}', "nonsense", "exit"])
    yield "update", shell.run(f'count {name} {{"n_regionkey": 52}}')
    yield "drop", int(shell.run(f"drop {name}"))


small(
    "shell", "command string, n long", _shell,
    """SELECT * FROM (VALUES ('find', (SELECT count(*) FROM nation WHERE n_regionkey = 1)), ('count', (SELECT count(*) FROM nation)), ('distinct', (SELECT count(DISTINCT n_regionkey) FROM nation)),
       ('aggregate', (SELECT sum(n_nationkey)::BIGINT FROM nation)), ('update', (SELECT count(*) FROM nation WHERE n_regionkey = 2)), ('drop', 1)) t(command, n)""",
)
small(
    "package_entry", "name string", lambda spark, d: [(n,) for n in ("Collection", "Cursor", "ObjectId", "aggregate", "collection", "configure", "find", "register_stage") if callable(getattr(dl, n))],
    "SELECT * FROM (VALUES ('Collection'), ('Cursor'), ('ObjectId'), ('aggregate'), ('collection'), ('configure'), ('find'), ('register_stage')) t(name)",
)
