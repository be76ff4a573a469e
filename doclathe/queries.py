"""One query for each operator over the test tables, with the same result in SQL.

Nested results are flattened before they are compared, and sums of doubles are rounded."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclathe import functional as fn
from doclathe.collection import Collection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def put(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        SQL[name] = sql


def pipeline(name: str, source: str, stages: list[dict], sql: str | None) -> None:
    put(name, lambda spark, d: fn.aggregate(table(spark, d, source), stages), sql)


def found(name: str, source: str, query, sql: str, columns: str) -> None:
    """A filter with an inclusion of columns; sql: the condition."""
    keep = dict.fromkeys(columns.split(), 1)
    put(name, lambda spark, d: fn.find(table(spark, d, source), query, keep), f"SELECT {', '.join(columns.split())} FROM {source} WHERE {sql}")


# Flagship: filter, group, sort.
REVENUE = [
    {"$match": {"l_quantity": {"$gt": 5, "$lte": 45}, "l_discount": {"$gte": 0.02}}},
    {"$addFields": {"net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}}},
    {"$group": {"_id": {"flag": "$l_returnflag", "status": "$l_linestatus"}, "qty": {"$sum": "$l_quantity"}, "net": {"$sum": "$net"}, "n": {"$sum": 1}, "most": {"$max": "$l_extendedprice"}}},
    {"$project": {"_id": 0, "flag": "$_id.flag", "status": "$_id.status", "qty": {"$round": ["$qty", 2]}, "net": {"$round": ["$net", 2]}, "n": 1, "most": 1}},
    {"$sort": {"flag": 1, "status": 1}},
]
pipeline(
    "revenue_by_status", "lineitem", REVENUE,
    """SELECT l_returnflag AS flag, l_linestatus AS status, floor(sum(l_quantity) * 100 + 0.5) / 100 AS qty,
       floor(sum(l_extendedprice * (1 - l_discount)) * 100 + 0.5) / 100 AS net, count(*) AS n, max(l_extendedprice) AS most
       FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 45 AND l_discount >= 0.02 GROUP BY 1, 2 ORDER BY 1, 2""",
)

# Filters.
ORDER = "o_orderkey o_custkey o_orderstatus o_totalprice"
found("filter_eq", "orders", {"o_orderstatus": "F"}, "o_orderstatus = 'F'", ORDER)
found("filter_eq_operator", "orders", {"o_orderstatus": {"$eq": "P"}}, "o_orderstatus = 'P'", ORDER)
found("filter_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, "o_orderstatus <> 'F'", ORDER)
found("filter_range", "lineitem", {"l_quantity": {"$gte": 10, "$lt": 20}, "l_tax": {"$gt": 0.02, "$lte": 0.06}}, "l_quantity >= 10 AND l_quantity < 20 AND l_tax > 0.02 AND l_tax <= 0.06", "l_orderkey l_linenumber l_quantity l_tax")
found("filter_in", "orders", {"o_orderpriority": {"$in": ["1-URGENT", "2-HIGH", None]}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')", ORDER)
found("filter_nin", "orders", {"o_orderstatus": {"$nin": ["F", "O"]}}, "o_orderstatus NOT IN ('F', 'O')", ORDER)
found("filter_and", "customer", {"$and": [{"c_acctbal": {"$gt": 0}}, {"c_mktsegment": "BUILDING"}]}, "c_acctbal > 0 AND c_mktsegment = 'BUILDING'", "c_custkey c_acctbal")
found("filter_or", "customer", {"$or": [{"c_acctbal": {"$lt": 0}}, {"c_nationkey": {"$in": [1, 2]}}]}, "c_acctbal < 0 OR c_nationkey IN (1, 2)", "c_custkey c_acctbal c_nationkey")
found("filter_nor", "customer", {"$nor": [{"c_acctbal": {"$lt": 0}}, {"c_nationkey": 3}]}, "NOT (c_acctbal < 0 OR c_nationkey = 3)", "c_custkey c_nationkey")
found("filter_not", "customer", {"c_acctbal": {"$not": {"$gte": 500}}}, "NOT (c_acctbal >= 500)", "c_custkey c_acctbal")
found("filter_mod", "events", {"user_id": {"$mod": [7, 3]}}, "user_id % 7 = 3", "event_id user_id")
found("filter_regex", "part", {"p_name": {"$regex": "^[a-m].*e", "$options": "i"}}, "regexp_matches(p_name, '(?i)^[a-m].*e')", "p_partkey p_name")
found("filter_regex_pattern", "part", {"p_type": re.compile("steel|brass", re.IGNORECASE)}, "regexp_matches(p_type, '(?i)steel|brass')", "p_partkey p_type")
found("filter_where_sql", "lineitem", {"$where": "l_extendedprice > 1000 * l_quantity"}, "l_extendedprice > 1000 * l_quantity", "l_orderkey l_linenumber l_extendedprice")
found("filter_where_callable", "lineitem", {"$where": lambda d: d.l_discount > d.l_tax}, "l_discount > l_tax", "l_orderkey l_linenumber l_discount l_tax")
found("filter_expr", "lineitem", {"$expr": {"$gt": ["$l_discount", "$l_tax"]}}, "l_discount > l_tax", "l_orderkey l_linenumber l_discount l_tax")
found("filter_comment", "nation", {"$comment": "all of one region", "n_regionkey": 2}, "n_regionkey = 2", "n_nationkey n_name")
found("filter_bits_all_set", "events", {"user_id": {"$bitsAllSet": [0, 2]}}, "user_id & 5 = 5", "event_id user_id")
found("filter_bits_any_set", "events", {"user_id": {"$bitsAnySet": 6}}, "user_id & 6 <> 0", "event_id user_id")
found("filter_bits_all_clear", "events", {"user_id": {"$bitsAllClear": 3}}, "user_id & 3 = 0", "event_id user_id")
found("filter_bits_any_clear", "events", {"user_id": {"$bitsAnyClear": [0, 1]}}, "user_id & 3 <> 3", "event_id user_id")
found("filter_other_class", "part", {"p_name": {"$gt": 5}}, "false", "p_partkey p_name")


def _nulls(spark, d, query):
    df = table(spark, d, "customer").withColumn("c_nationkey", F.nullif("c_nationkey", F.lit(3)))
    return fn.find(df, query, {"c_custkey": 1, "c_nationkey": 1})


_NULLED = "FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer)"
for _name, _query, _cond in (
    ("exists", {"c_nationkey": {"$exists": True}}, "c_nationkey IS NOT NULL"),
    ("not_exists", {"c_nationkey": {"$exists": False}}, "c_nationkey IS NULL"),
    ("eq_null", {"c_nationkey": None}, "c_nationkey IS NULL"),
    ("ne_keeps_null", {"c_nationkey": {"$ne": 5}}, "c_nationkey IS DISTINCT FROM 5"),
    ("nin_keeps_null", {"c_nationkey": {"$nin": [1, 2]}}, "c_nationkey IS NULL OR c_nationkey NOT IN (1, 2)"),
    ("nor_two_valued", {"$nor": [{"c_nationkey": {"$gt": 5}}]}, "NOT coalesce(c_nationkey > 5, false)"),
    ("not_two_valued", {"c_nationkey": {"$not": {"$lte": 5}}}, "NOT coalesce(c_nationkey <= 5, false)"),
    ("type", {"c_nationkey": {"$type": "number"}}, "c_nationkey IS NOT NULL"),
    ("in_null", {"c_nationkey": {"$in": [1, None]}}, "c_nationkey IS NULL OR c_nationkey = 1"),
):
    put(f"filter_{_name}", lambda spark, d, q=_query: _nulls(spark, d, q), f"SELECT c_custkey, c_nationkey {_NULLED} WHERE {_cond}")


def _words(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("words"))


_WORDS = "(SELECT p_partkey, string_split(p_name, ' ') AS words FROM part)"
for _name, _query, _cond in (
    ("array_contains", {"words": "red"}, "list_contains(words, 'red')"),
    ("array_equal", {"words": {"$eq": ["blue", "red"]}}, "words = ['blue', 'red']"),
    ("array_any_greater", {"words": {"$gte": "s"}}, "len(list_filter(words, lambda x: x >= 's')) > 0"),
    ("array_in", {"words": {"$in": ["red", re.compile("^bl")]}}, "list_contains(words, 'red') OR len(list_filter(words, lambda x: starts_with(x, 'bl'))) > 0"),
    ("all", {"words": {"$all": ["red", "small"]}}, "list_contains(words, 'red') AND list_contains(words, 'small')"),
    ("elem_match", {"words": {"$elemMatch": {"$gt": "b", "$lt": "h"}}}, "len(list_filter(words, lambda x: x > 'b' AND x < 'h')) > 0"),
    ("size", {"words": {"$size": 2}}, "len(words) = 2"),
    ("numeric_path", {"words.1": {"$lt": "m"}}, "words[2] < 'm'"),
):
    put(f"filter_{_name}", lambda spark, d, q=_query: fn.find(_words(spark, d), q, {"p_partkey": 1}), f"SELECT p_partkey FROM {_WORDS} WHERE {_cond}")


# Places: the first two components of the vectors.
def _places(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 2).alias("loc"))


_PLACES = "(SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"
_SPHERE = "2 * asin(least(1.0, sqrt(pow(sin(radians(y - 0.05) / 2), 2) + cos(radians(y)) * cos(radians(0.05)) * pow(sin(radians(x - 0.1) / 2), 2))))"
_AREA = [[-0.1, -0.1], [0.2, -0.1], [0.2, 0.15], [-0.1, 0.15]]
for _name, _cond_spec, _cond in (
    ("geo_within_box", {"$geoWithin": {"$box": [[-0.1, -0.1], [0.1, 0.1]]}}, "x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1"),
    ("geo_within_center", {"$geoWithin": {"$center": [[0.05, 0.0], 0.1]}}, "sqrt((x - 0.05) * (x - 0.05) + y * y) <= 0.1"),
    ("geo_within_center_sphere", {"$geoWithin": {"$centerSphere": [[0.1, 0.05], 0.0021]}}, f"{_SPHERE} <= 0.0021"),
    ("geo_within_polygon", {"$geoWithin": {"$polygon": _AREA}}, "x >= -0.1 AND x < 0.2 AND y >= -0.1 AND y < 0.15"),
    ("geo_within_geometry", {"$geoWithin": {"$geometry": {"type": "Polygon", "coordinates": [[*_AREA, _AREA[0]]]}}}, "x >= -0.1 AND x < 0.2 AND y >= -0.1 AND y < 0.15"),
    ("geo_intersects", {"$geoIntersects": {"$geometry": {"type": "MultiPolygon", "coordinates": [[[*_AREA, _AREA[0]]]]}}}, "x >= -0.1 AND x < 0.2 AND y >= -0.1 AND y < 0.15"),
    ("near", {"$near": [0.05, 0.0], "$minDistance": 0.02, "$maxDistance": 0.12}, "sqrt((x - 0.05) * (x - 0.05) + y * y) BETWEEN 0.02 AND 0.12"),
    ("near_meters", {"$near": {"$geometry": {"type": "Point", "coordinates": [0.1, 0.05]}, "$maxDistance": 12000}}, f"{_SPHERE} * 6378137 <= 12000"),
    ("near_sphere", {"$nearSphere": [0.1, 0.05], "$maxDistance": 0.002}, f"{_SPHERE} <= 0.002"),
):
    put(f"filter_{_name}", lambda spark, d, q=_cond_spec: fn.find(_places(spark, d), {"loc": q}, {"vec_id": 1}), f"SELECT vec_id FROM {_PLACES} WHERE {_cond}")
put(
    "stage_geo_near",
    lambda spark, d: fn.aggregate(_places(spark, d), [{"$geoNear": {"near": [0.05, 0.0], "distanceField": "dist", "maxDistance": 0.1, "distanceMultiplier": 10, "query": {"vec_id": {"$gt": 10}}}}, {"$match": {"dist": {"$lte": 1}}}, {"$project": {"vec_id": 1, "dist": {"$round": ["$dist", 6]}}}]),
    f"SELECT vec_id, floor(sqrt((x - 0.05) * (x - 0.05) + y * y) * 10 * 1e6 + 0.5) / 1e6 AS dist FROM {_PLACES} WHERE vec_id > 10 AND sqrt((x - 0.05) * (x - 0.05) + y * y) * 10 <= 0.1",
)

# Text.
put(
    "text_search",
    lambda spark, d: fn.aggregate(table(spark, d, "documents").select("doc_id", "text"), [{"$match": {"$text": {"$search": 'license mit -apache'}}}, {"$project": {"_id": 0, "doc_id": 1, "score": {"$meta": "textScore"}}}]),
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)
       SELECT doc_id, CAST(len(list_filter(w, lambda x: x IN ('license', 'mit'))) AS DOUBLE) AS score FROM t
       WHERE len(list_filter(w, lambda x: x IN ('license', 'mit'))) > 0 AND NOT list_contains(w, 'apache')""",
)
put(
    "text_phrase",
    lambda spark, d: fn.find(table(spark, d, "documents").select("doc_id", "text"), {"$text": {"$search": '"general public license"'}}, {"doc_id": 1}),
    """SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' ', ' general public license ')""",
)

# Projections of find.
put("find_exclude", lambda spark, d: fn.find(table(spark, d, "nation"), {}, {"n_regionkey": 0}), "SELECT n_nationkey, n_name FROM nation")
put(
    "find_slice",
    lambda spark, d: fn.find(_words(spark, d), {}, {"words": {"$slice": -1}}).select("p_partkey", F.array_join("words", ",").alias("words")),
    f"SELECT p_partkey, words[-1] AS words FROM {_WORDS}",
)
put(
    "find_slice_skip",
    lambda spark, d: fn.find(_words(spark, d), {}, {"words": {"$slice": [1, 1]}}).select("p_partkey", F.array_join("words", ",").alias("words")),
    f"SELECT p_partkey, coalesce(words[2], '') AS words FROM {_WORDS}",
)
put(
    "find_elem_match_projection",
    lambda spark, d: fn.find(_words(spark, d), {}, {"p_partkey": 1, "words": {"$elemMatch": {"$gt": "m"}}}).select("p_partkey", F.array_join("words", ",").alias("words")),
    f"SELECT p_partkey, list_filter(words, lambda x: x > 'm')[1] AS words FROM {_WORDS}",
)
put(
    "find_positional",
    lambda spark, d: fn.find(_words(spark, d), {"words": {"$gte": "r"}}, {"p_partkey": 1, "words.$": 1}).select("p_partkey", F.array_join("words", ",").alias("words")),
    f"SELECT p_partkey, list_filter(words, lambda x: x >= 'r')[1] AS words FROM {_WORDS} WHERE len(list_filter(words, lambda x: x >= 'r')) > 0",
)
put(
    "cursor_sort_skip_limit",
    lambda spark, d: Collection(table(spark, d, "customer")).find({"c_acctbal": {"$gt": 0}}, {"c_custkey": 1, "c_acctbal": 1}).sort({"c_acctbal": -1, "c_custkey": 1}).skip(5).limit(20).frame,
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5",
)
put("distinct_values", lambda spark, d: fn.distinct(table(spark, d, "events"), "event_type", {"value": {"$gt": 1}}), "SELECT DISTINCT event_type AS value FROM events WHERE value > 1")
put("distinct_array", lambda spark, d: fn.distinct(_words(spark, d), "words"), f"SELECT DISTINCT unnest(words) AS value FROM {_WORDS}")

# Stages.
pipeline("stage_project_exclude", "region", [{"$project": {"r_name": 0}}], "SELECT r_regionkey FROM region")
pipeline("stage_project_computed", "lineitem", [{"$project": {"l_orderkey": 1, "cost": {"$round": [{"$multiply": ["$l_extendedprice", "$l_discount"]}, 2]}, "flag": "$l_returnflag"}}], "SELECT l_orderkey, floor(l_extendedprice * l_discount * 100 + 0.5) / 100 AS cost, l_returnflag AS flag FROM lineitem")
pipeline("stage_add_fields", "nation", [{"$addFields": {"n_regionkey": {"$add": ["$n_regionkey", 10]}, "old": "$n_regionkey"}}], "SELECT n_nationkey, n_name, CAST(n_regionkey + 10 AS BIGINT) AS n_regionkey, n_regionkey AS old FROM nation")
pipeline("stage_set_nested", "nation", [{"$set": {"at.region": "$n_regionkey", "at.key": "$n_nationkey"}}, {"$project": {"n_name": 1, "r": "$at.region", "k": "$at.key"}}], "SELECT n_name, n_regionkey AS r, n_nationkey AS k FROM nation")
pipeline("stage_unset", "supplier", [{"$unset": ["s_acctbal", "s_nationkey"]}], "SELECT s_suppkey, s_name FROM supplier")
pipeline("stage_count", "lineitem", [{"$match": {"l_returnflag": "R"}}, {"$count": "n"}], "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
pipeline("stage_replace_root", "nation", [{"$replaceRoot": {"newRoot": {"key": "$n_nationkey", "name": {"$toLower": "$n_name"}}}}], "SELECT n_nationkey AS key, lower(n_name) AS name FROM nation")
pipeline("stage_replace_with", "nation", [{"$replaceWith": {"$mergeObjects": [{"a": 1, "b": "$n_name"}, {"a": "$n_regionkey"}]}}], "SELECT CAST(n_regionkey AS BIGINT) AS a, n_name AS b FROM nation")
pipeline("stage_sort_by_count", "events", [{"$sortByCount": "$event_type"}], "SELECT event_type AS _id, count(*) AS count FROM events GROUP BY 1")
pipeline("stage_sort_limit", "orders", [{"$sort": {"o_totalprice": -1, "o_orderkey": 1}}, {"$skip": 3}, {"$limit": 50}, {"$project": {"o_orderkey": 1, "o_totalprice": 1}}], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 3")
put(
    "stage_unwind",
    lambda spark, d: fn.aggregate(_words(spark, d), [{"$unwind": {"path": "$words", "includeArrayIndex": "i"}}]),
    f"SELECT p_partkey, unnest(words) AS words, CAST(unnest(range(len(words))) AS BIGINT) AS i FROM {_WORDS}",
)
put(
    "stage_unwind_preserve",
    lambda spark, d: fn.aggregate(_words(spark, d), [{"$addFields": {"words": {"$filter": {"input": "$words", "cond": {"$gt": ["$$this", "m"]}}}}}, {"$unwind": {"path": "$words", "preserveNullAndEmptyArrays": True}}]),
    f"""SELECT p_partkey, unnest(CASE WHEN len(f) = 0 THEN [NULL] ELSE f END) AS words
        FROM (SELECT p_partkey, list_filter(words, lambda x: x > 'm') AS f FROM {_WORDS})""",
)
pipeline(
    "group_accumulators", "lineitem",
    [
        {"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "mean": {"$avg": "$l_discount"}, "low": {"$min": "$l_extendedprice"}, "high": {"$max": "$l_extendedprice"}, "n": {"$count": {}}, "none": {"$sum": "$l_linestatus"}}},
        {"$addFields": {"mean": {"$round": ["$mean", 6]}, "qty": {"$round": ["$qty", 2]}}},
    ],
    """SELECT l_returnflag AS _id, floor(sum(l_quantity) * 100 + 0.5) / 100 AS qty, floor(avg(l_discount) * 1e6 + 0.5) / 1e6 AS mean, min(l_extendedprice) AS low,
       max(l_extendedprice) AS high, count(*) AS n, CAST(0 AS DOUBLE) AS none FROM lineitem GROUP BY 1""",
)
pipeline("group_all", "orders", [{"$group": {"_id": None, "n": {"$sum": 1}, "top": {"$max": "$o_totalprice"}}}, {"$project": {"_id": 0}}], "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders")
pipeline("group_all_of_nothing", "orders", [{"$match": {"o_orderkey": {"$lt": 0}}}, {"$group": {"_id": None, "n": {"$sum": 1}}}, {"$project": {"_id": 0, "n": 1}}], "SELECT 1::BIGINT AS n WHERE false")
put(
    "group_ordered",
    lambda spark, d: fn.aggregate(
        table(spark, d, "events"),
        [
            {"$sort": {"event_id": -1}},
            {"$group": {"_id": "$user_id", "types": {"$push": "$event_type"}, "kinds": {"$addToSet": "$event_type"}, "newest": {"$first": "$event_id"}, "oldest": {"$last": "$event_id"}}},
        ],
    ).select("_id", F.array_join("types", ",").alias("types"), F.array_join(F.sort_array("kinds"), ",").alias("kinds"), "newest", "oldest"),
    """SELECT user_id AS _id, string_agg(event_type, ',' ORDER BY event_id DESC) AS types, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds,
       max(event_id) AS newest, min(event_id) AS oldest FROM events GROUP BY 1""",
)
put(
    "stage_lookup",
    lambda spark, d: fn.aggregate(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        # By a doubled key, so that orders of odd customers find none.
        [{"$lookup": {"from": table(spark, d, "customer").withColumn("c_twice", F.col("c_custkey") * 2), "localField": "o_custkey", "foreignField": "c_twice", "as": "who"}}, {"$project": {"o_orderkey": 1, "n": {"$size": "$who"}, "seg": {"$arrayElemAt": ["$who.c_mktsegment", 0]}, "first": {"$arrayElemAt": ["$who", 0]}}}, {"$project": {"o_orderkey": 1, "n": 1, "name": "$first.c_name"}}],
    ),
    "SELECT o_orderkey, CAST(CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey * 2",
)
put(
    "stage_lookup_array",
    lambda spark, d: fn.aggregate(
        table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 5000)).alias("keys")),
        [{"$lookup": {"from": table(spark, d, "part").select("p_partkey", "p_size"), "localField": "keys", "foreignField": "p_partkey", "as": "parts"}}],
    ).select("o_custkey", F.size("parts").cast("long").alias("n"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["p_size"]).alias("size")),
    """WITH k AS (SELECT DISTINCT o_custkey, o_orderkey % 5000 AS k FROM orders)
       SELECT o_custkey, count(p_partkey) AS n, CAST(coalesce(sum(p_size), 0) AS BIGINT) AS size
       FROM k LEFT JOIN part ON k = p_partkey GROUP BY 1""",
)
put(
    "stage_redact",
    lambda spark, d: fn.aggregate(
        table(spark, d, "part").select("p_partkey", F.lit(1).alias("level"), F.struct(F.col("p_size").alias("level"), "p_name").alias("a"), F.struct(F.lit(9).alias("level"), F.col("p_brand")).alias("b")),
        [{"$redact": {"$cond": [{"$lte": ["$level", 20]}, "$$DESCEND", "$$PRUNE"]}}, {"$project": {"p_partkey": 1, "name": "$a.p_name", "brand": "$b.p_brand"}}],
    ),
    "SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_name END AS name, p_brand AS brand FROM part",
)
put(
    "stage_sample",
    lambda spark, d: fn.aggregate(table(spark, d, "orders"), [{"$sample": {"size": 25}}, {"$count": "n"}]),
    "SELECT least(25, count(*)) AS n FROM orders",
)


def _out(spark, d) -> DataFrame:
    target = Collection(table(spark, d, "region"))
    fn.aggregate(table(spark, d, "nation"), [{"$match": {"n_regionkey": 1}}, {"$out": target}])
    return target.frame


put("stage_out", _out, "SELECT * FROM nation WHERE n_regionkey = 1")


def _index_stats(spark, d) -> DataFrame:
    c = Collection(table(spark, d, "nation"))
    c.create_index({"n_regionkey": 1, "n_name": -1})
    c.find({"n_regionkey": 1})
    return c.aggregate([{"$indexStats": {}}]).select("name", F.col("accesses.ops").alias("ops"))


put("stage_index_stats", _index_stats, "SELECT 'n_regionkey_1_n_name_-1' AS name, 1::BIGINT AS ops")

# Expressions: one row each of the table in the operator's own terms.
_PART = "FROM part"
_EXPRESSIONS = {
    "add": ({"$add": ["$p_size", 5, "$p_partkey"]}, "CAST(p_size + 5 + p_partkey AS BIGINT)"),
    "subtract": ({"$subtract": ["$p_partkey", "$p_size"]}, "CAST(p_partkey - p_size AS BIGINT)"),
    "multiply": ({"$multiply": ["$p_size", 3]}, "CAST(p_size * 3 AS BIGINT)"),
    "divide": ({"$divide": ["$p_size", 4]}, "CAST(p_size AS DOUBLE) / 4"),
    "divide_by_zero": ({"$divide": ["$p_size", 0]}, "CAST('inf' AS DOUBLE)"),
    "mod": ({"$mod": [{"$subtract": ["$p_size", 25]}, 7]}, "CAST((p_size - 25) % 7 AS BIGINT)"),
    "abs": ({"$abs": {"$subtract": ["$p_size", 25]}}, "CAST(abs(p_size - 25) AS BIGINT)"),
    "ceil": ({"$ceil": "$p_retailprice"}, "CAST(ceil(p_retailprice) AS DOUBLE)"),
    "floor": ({"$floor": "$p_retailprice"}, "CAST(floor(p_retailprice) AS DOUBLE)"),
    "round": ({"$round": ["$p_retailprice", 1]}, "floor(p_retailprice * 10 + 0.5) / 10"),
    "sqrt": ({"$round": [{"$sqrt": "$p_size"}, 6]}, "floor(sqrt(p_size) * 1e6 + 0.5) / 1e6"),
    "pow": ({"$pow": ["$p_size", 2]}, "pow(CAST(p_size AS DOUBLE), 2)"),
    "concat": ({"$concat": ["$p_brand", "/", {"$literal": None}, "$p_name"]}, "p_brand || '/' || p_name"),
    "to_upper": ({"$toUpper": "$p_name"}, "upper(p_name)"),
    "to_lower": ({"$toLower": "$p_brand"}, "lower(p_brand)"),
    "split": ({"$size": {"$split": ["$p_name", " "]}}, "CAST(len(string_split(p_name, ' ')) AS BIGINT)"),
    "str_len": ({"$strLenCP": "$p_name"}, "CAST(length(p_name) AS BIGINT)"),
    "substr": ({"$substrCP": ["$p_name", 2, 4]}, "substring(p_name, 3, 4)"),
    "substr_old": ({"$substr": ["$p_name", 0, 3]}, "substring(p_name, 1, 3)"),
    "trim": ({"$trim": {"input": {"$concat": [" \t", "$p_name", "  "]}}}, "p_name"),
    "eq": ({"$eq": ["$p_size", 7]}, "p_size = 7"),
    "ne": ({"$ne": ["$p_brand", "Brand#11"]}, "p_brand <> 'Brand#11'"),
    "gt": ({"$gt": ["$p_size", 20]}, "p_size > 20"),
    "gte": ({"$gte": ["$p_size", 20]}, "p_size >= 20"),
    "lt": ({"$lt": ["$p_size", 20]}, "p_size < 20"),
    "lte": ({"$lte": ["$p_size", 20]}, "p_size <= 20"),
    "cmp": ({"$cmp": ["$p_size", 20]}, "CAST(sign(p_size - 20) AS BIGINT)"),
    "cond": ({"$cond": {"if": {"$gt": ["$p_size", 20]}, "then": "big", "else": "small"}}, "CASE WHEN p_size > 20 THEN 'big' ELSE 'small' END"),
    "if_null": ({"$ifNull": ["$nothing", {"$cond": [{"$lt": ["$p_size", 9]}, "$p_name", None]}, "none"]}, "CASE WHEN p_size < 9 THEN p_name ELSE 'none' END"),
    "switch": ({"$switch": {"branches": [{"case": {"$lt": ["$p_size", 10]}, "then": "s"}, {"case": {"$lt": ["$p_size", 30]}, "then": "m"}], "default": "l"}}, "CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END"),
    "and": ({"$and": [{"$gt": ["$p_size", 10]}, "$p_name"]}, "p_size > 10"),
    "or": ({"$or": [{"$gt": ["$p_size", 40]}, {"$eq": ["$p_brand", "Brand#11"]}]}, "p_size > 40 OR p_brand = 'Brand#11'"),
    "not": ({"$not": [{"$gt": ["$p_size", 10]}]}, "NOT p_size > 10"),
    "size": ({"$size": "$p_name"}, "0::BIGINT"),
    "array_elem_at": ({"$arrayElemAt": [{"$split": ["$p_name", " "]}, -1]}, "string_split(p_name, ' ')[-1]"),
    "array_elem_past_end": ({"$arrayElemAt": [{"$split": ["$p_name", " "]}, 9]}, "CAST(NULL AS VARCHAR)"),
    "in": ({"$in": ["$p_size", [1, 2, 3, 5, 8]]}, "p_size IN (1, 2, 3, 5, 8)"),
    "concat_arrays": ({"$arrayElemAt": [{"$concatArrays": [["$p_brand"], {"$split": ["$p_name", " "]}]}, 1]}, "string_split(p_name, ' ')[1]"),
    "reverse_array": ({"$arrayElemAt": [{"$reverseArray": {"$split": ["$p_name", " "]}}, 0]}, "string_split(p_name, ' ')[-1]"),
    "map": ({"$arrayElemAt": [{"$map": {"input": {"$split": ["$p_name", " "]}, "as": "w", "in": {"$concat": ["$$w", "!"]}}}, 0]}, "string_split(p_name, ' ')[1] || '!'"),
    "filter": ({"$size": {"$filter": {"input": {"$split": ["$p_name", " "]}, "as": "w", "cond": {"$gt": ["$$w", "m"]}}}}, "CAST(len(list_filter(string_split(p_name, ' '), lambda x: x > 'm')) AS BIGINT)"),
    "literal": ({"$literal": "$p_name"}, "'$p_name'"),
    "rand": ({"$and": [{"$gte": [{"$rand": {}}, 0]}, {"$lt": [{"$rand": {}}, 1]}]}, "true"),
}
for _name, (_spec, _sql) in _EXPRESSIONS.items():
    pipeline(f"expr_{_name}", "part", [{"$project": {"p_partkey": 1, "v": _spec}}], f"SELECT p_partkey, {_sql} AS v {_PART}")
put(
    "expr_merge_objects",
    lambda spark, d: fn.aggregate(table(spark, d, "part"), [{"$project": {"p_partkey": 1, "m": {"$mergeObjects": [{"a": "$p_size", "b": 2}, {"b": "$p_partkey", "c": "$p_name"}]}}}, {"$project": {"p_partkey": 1, "a": "$m.a", "b": "$m.b", "c": "$m.c"}}]),
    "SELECT p_partkey, p_size AS a, p_partkey AS b, p_name AS c FROM part",
)


# Updates: a collection after a write.
def _after(source: str, write: Callable[[Collection], object], prepare=None):
    def run(spark, d):
        df = table(spark, d, source)
        c = Collection(prepare(df) if prepare else df)
        write(c)
        return c.frame

    return run


put("update_set", _after("nation", lambda c: c.update_many({"n_regionkey": 1}, {"$set": {"n_name": "X", "flag": True}})), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name, n_regionkey, CASE WHEN n_regionkey = 1 THEN true END AS flag FROM nation")
put("update_unset", _after("nation", lambda c: c.update_many({"n_regionkey": 1}, {"$unset": {"n_name": ""}})), "SELECT n_nationkey, CASE WHEN n_regionkey <> 1 THEN n_name END AS n_name, n_regionkey FROM nation")
put("update_inc", _after("customer", lambda c: c.update_many({"c_nationkey": {"$lt": 10}}, {"$inc": {"c_nationkey": 100}})), "SELECT c_custkey, c_name, CAST(CASE WHEN c_nationkey < 10 THEN c_nationkey + 100 ELSE c_nationkey END AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
put("update_mul", _after("supplier", lambda c: c.update_many({}, {"$mul": {"s_nationkey": 2, "made": 3}})), "SELECT s_suppkey, s_name, CAST(s_nationkey * 2 AS BIGINT) AS s_nationkey, s_acctbal, 0::BIGINT AS made FROM supplier")
put("update_min_max", _after("supplier", lambda c: c.update_many({}, {"$min": {"s_nationkey": 5}, "$max": {"s_acctbal": 100.0}})), "SELECT s_suppkey, s_name, CAST(least(s_nationkey, 5) AS BIGINT) AS s_nationkey, greatest(s_acctbal, 100.0) AS s_acctbal FROM supplier")
put("update_rename", _after("region", lambda c: c.update_many({"r_regionkey": {"$gt": 1}}, {"$rename": {"r_name": "title"}})), "SELECT r_regionkey, CASE WHEN r_regionkey <= 1 THEN r_name END AS r_name, CASE WHEN r_regionkey > 1 THEN r_name END AS title FROM region")
put("update_current_date", lambda spark, d: _after("region", lambda c: c.update_many({}, {"$currentDate": {"at": True}}))(spark, d).select("r_regionkey", F.col("at").isNotNull().alias("dated")), "SELECT r_regionkey, true AS dated FROM region")
put("update_bit", _after("nation", lambda c: c.update_many({}, {"$bit": {"n_nationkey": {"and": 13, "or": 2, "xor": 1}}})), "SELECT CAST(xor((n_nationkey & 13) | 2, 1) AS BIGINT) AS n_nationkey, n_name, n_regionkey FROM nation")


def _word_rows(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.split("p_name", " ").alias("words"))


def _joined(write):
    run = _after("part", write, _word_rows)
    return lambda spark, d: run(spark, d).select("p_partkey", F.array_join("words", ",").alias("words"))


_UPDATES = {
    "push": ({"$push": {"words": "new"}}, "list_append(words, 'new')"),
    "push_each": ({"$push": {"words": {"$each": ["a", "zz"], "$position": 1, "$sort": -1, "$slice": 3}}}, "list_sort(list_concat(words, ['a', 'zz']), 'DESC')[1:3]"),
    "add_to_set": ({"$addToSet": {"words": {"$each": ["red", "unseen"]}}}, "list_append(CASE WHEN list_contains(words, 'red') THEN words ELSE list_append(words, 'red') END, 'unseen')"),
    "pop": ({"$pop": {"words": 1}}, "words[1:len(words) - 1]"),
    "pop_first": ({"$pop": {"words": -1}}, "words[2:]"),
    "pull": ({"$pull": {"words": {"$gt": "m"}}}, "list_filter(words, lambda x: x <= 'm')"),
    "pull_all": ({"$pullAll": {"words": ["red", "small"]}}, "list_filter(words, lambda x: x NOT IN ('red', 'small'))"),
    "each_element": ({"$set": {"words.$[]": "x"}}, "list_transform(words, lambda x: 'x')"),
}
for _name, (_spec, _sql) in _UPDATES.items():
    put(f"update_{_name}", _joined(lambda c, u=_spec: c.update_many({}, u)), f"SELECT p_partkey, array_to_string({_sql}, ',') AS words FROM {_WORDS}")
put("update_filtered_element", _joined(lambda c: c.update_many({}, {"$set": {"words.$[w]": "big"}}, array_filters=[{"w": {"$gt": "m"}}])), f"SELECT p_partkey, array_to_string(list_transform(words, lambda x: CASE WHEN x > 'm' THEN 'big' ELSE x END), ',') AS words FROM {_WORDS}")
put(
    "update_positional", _joined(lambda c: c.update_many({"words": {"$gt": "m"}}, {"$set": {"words.$": "hit"}})),
    f"""SELECT p_partkey, array_to_string(CASE WHEN p IS NULL THEN words ELSE list_concat(words[1:p - 1], ['hit'], words[p + 1:]) END, ',') AS words
        FROM (SELECT *, list_position(words, list_filter(words, lambda x: x > 'm')[1]) AS p FROM {_WORDS})""",
)
put("upsert", _after("region", lambda c: c.update_one({"r_regionkey": 99}, {"$set": {"r_name": "NEW"}, "$setOnInsert": {"extra": 1}}, upsert=True)), "SELECT r_regionkey::BIGINT AS r_regionkey, r_name, NULL::BIGINT AS extra FROM region UNION ALL SELECT 99, 'NEW', 1")
put("replace_one", _after("region", lambda c: c.replace_one({"r_regionkey": 2}, {"r_regionkey": 2, "note": "gone"})), "SELECT r_regionkey, CASE WHEN r_regionkey <> 2 THEN r_name END AS r_name, CASE WHEN r_regionkey = 2 THEN 'gone' END AS note FROM region")
put("insert_many", _after("region", lambda c: c.insert_many([{"r_regionkey": 7, "r_name": "A"}, {"r_regionkey": 8, "r_name": None}])), "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region UNION ALL VALUES (7, 'A'), (8, NULL)")
put("delete_many", _after("orders", lambda c: c.delete_many({"o_orderstatus": "F"})), "SELECT * FROM orders WHERE o_orderstatus <> 'F'")
put(
    "bulk_write",
    _after("nation", lambda c: c.bulk_write([{"insertOne": {"document": {"n_nationkey": 90, "n_name": "N", "n_regionkey": 9}}}, {"updateMany": {"filter": {"n_regionkey": 1}, "update": {"$inc": {"n_regionkey": 50}}}}, {"deleteMany": {"filter": {"n_regionkey": 2}}}])),
    "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, (CASE WHEN n_regionkey = 1 THEN 51 ELSE n_regionkey END)::BIGINT AS n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 90, 'N', 9",
)


def _copied(spark, d) -> DataFrame:
    c = Collection(table(spark, d, "region"))
    fn.copy_to(table(spark, d, "region"), c)
    return c.frame


put("copy_to", _copied, "SELECT * FROM region UNION ALL SELECT * FROM region")


def _report(spark, d) -> DataFrame:
    r = Collection(table(spark, d, "nation")).update_many({"n_regionkey": {"$gte": 3}}, {"$max": {"n_regionkey": 4}})
    return spark.createDataFrame([(r["matchedCount"], r["modifiedCount"])], "matched long, modified long")


put("write_report", _report, "SELECT count(*) AS matched, count(*) FILTER (n_regionkey < 4) AS modified FROM nation WHERE n_regionkey >= 3")

# The rest registers itself on import, once everything above is there.
from doclathe import queries_surface  # noqa: E402, F401
