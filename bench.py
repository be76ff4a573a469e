"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR: one JSON line, medians of warm runs in seconds.

of about 1 %, group by, and a left outer lookup; then the operators that cost most."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import time
from statistics import median

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    import doclathe as dl
    from doclathe import queries

    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    drain = lambda df: df.write.format("noop").mode("overwrite").save()
    items, orders, customer = read("lineitem"), read("orders"), read("customer")
    two_ranges = {"l_quantity": {"$gt": 10, "$lt": 40}, "l_discount": {"$gt": 0.02, "$lt": 0.08}}
    edge = items.approxQuantile("l_extendedprice", [0.99], 0.001)[0]
    runs = {
        "count_two_ranges": lambda: dl.count(items, two_ranges),
        "find_two_ranges": lambda: drain(dl.find(items, two_ranges)),
        "find_one_percent": lambda: drain(dl.find(items, {"l_extendedprice": {"$gte": edge}})),
        "find_one_by_key": lambda: dl.find_one(orders, {"o_orderkey": 77777}),
        "sort_two_keys": lambda: drain(dl.aggregate(items, [{"$sort": {"l_returnflag": 1, "l_extendedprice": -1}}])),
        "sort_two_keys_limit": lambda: dl.aggregate(items, [{"$sort": {"l_returnflag": 1, "l_extendedprice": -1}}, {"$limit": 100}]).collect(),
        "where_sql": lambda: dl.count(items, {"$where": "l_extendedprice > 1000 * l_quantity"}),
        "group_by": lambda: dl.aggregate(items, [{"$group": {"_id": "$l_suppkey", "n": {"$sum": 1}, "q": {"$sum": "$l_quantity"}, "m": {"$avg": "$l_discount"}}}]).collect(),
        "lookup": lambda: drain(dl.aggregate(orders, [{"$lookup": {"from": customer, "localField": "o_custkey", "foreignField": "c_custkey", "as": "who"}}])),
        "distinct": lambda: dl.distinct(items, "l_partkey").count(),
        "update_many": lambda: dl.Collection(items).update_many({"l_quantity": {"$lt": 5}}, {"$inc": {"l_quantity": 1}}),
        "revenue_by_status": lambda: queries.QUERIES["revenue_by_status"](spark, SF).collect(),
        "group_ordered": lambda: drain(queries.QUERIES["group_ordered"](spark, SF)),
        "text_search": lambda: drain(queries.QUERIES["text_search"](spark, SF)),
    }
    took = {}
    for name, run in runs.items():
        times = []
        for i in range(RUNS + 1):
            began = time.perf_counter()
            run()
            if i:
                times.append(time.perf_counter() - began)
        took[name] = round(median(times), 4)
    print(json.dumps({"metric": "sum of medians, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": int(CPUS), "runs": RUNS}), file=out)


if __name__ == "__main__":
    out = sys.stdout
    with contextlib.redirect_stdout(io.StringIO()):
        main()
