"""Operators on small literal rows: boundaries, nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import times, words
from tidewater.operators import cdc, stats, visits
from tidewater.operators.logs import repair_new_visitors
from tidewater.operators.neighbours import with_neighbour

LOG = "common struct<mid:string,is_new:string>, page struct<page_id:string,last_page_id:string>, ts long"


def logs(spark, rows):
    """rows: mid, is_new, page_id, last_page_id, ts."""
    return spark.createDataFrame([((m, n), (p, last), ts) for m, n, p, last, ts in rows], LOG)


def bounced(spark, rows):
    return sorted((r.mid, r.ts) for r in visits.bounces(logs(spark, rows)).select("common.mid", "ts").collect())


def test_bounces(spark):
    four = [("101", "1", "home", None, 10_000), ("102", "1", "home", None, 12_000), ("102", "1", "list", "home", 150_000), ("102", "1", "list", "home", 300_000)]
    assert bounced(spark, four) == [("101", 10_000), ("102", 12_000)]
    assert bounced(spark, [("a", "1", "h", "", 0), ("a", "1", "p", "h", 9_999)]) == []
    assert bounced(spark, [("a", "1", "h", "", 0), ("a", "1", "p", "h", 10_000)]) == [("a", 0)]
    assert bounced(spark, [("a", "1", "h", None, 1_000), ("a", "1", "h", None, 6_000)]) == [("a", 6_000)]
    assert bounced(spark, [("a", "1", "h", None, 1_000), ("a", "1", "", "h", 2_000)]) == []


def test_neighbours_without_key_or_time(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 5)], "k string, t long")
    found = with_neighbour(rows, "k", "t", 10, tie=[])
    assert found.count() == 4 and found.where("near is not null").count() == 0
    assert with_neighbour(rows.where("false"), "k", "t", 10, tie=[]).count() == 0


def test_new_visitors(spark):
    day = 86_400_000
    rows = [("a", "1", "h", None, 0), ("a", "1", "h", None, day), ("b", "0", "h", None, 0), ("b", "1", "h", None, day)]
    found = repair_new_visitors(logs(spark, rows)).select("common.mid", "ts", "common.is_new").collect()
    assert sorted(map(tuple, found)) == [("a", 0, "1"), ("a", day, "0"), ("b", 0, "0"), ("b", day, "1")]


def test_unique_visits_by_arrival(spark):
    day = 86_400_000
    rows = logs(spark, [("a", "1", "h", None, t) for t in (0, 5, day, 7)]).withColumn("n", F.expr("case ts when 0 then 0 when 5 then 1 when 86400000 then 2 else 3 end"))
    assert sorted(r.n for r in visits.unique_visits(rows, order=["n"]).collect()) == [0, 2, 3]
    assert sorted(r.n for r in visits.unique_visits(rows).collect()) == [0, 2]


def test_changes(spark):
    texts = ['{"table":"t","type":"bootstrap-insert","data":{"id":"1","a":"x"}}', '{"table":"t","type":"insert","data":{}}', '{"table":"t","type":"insert"}', '{"type":"insert","data":{"id":"1"}}', "no json", None]
    valid = cdc.valid_changes(cdc.parse_changes(spark.createDataFrame([(t,) for t in texts], "value string")))
    routes = spark.createDataFrame([("t", "insert", "hbase", "DIM_T", "id, a", None, None)], schemas.ROUTES)
    (row,) = cdc.dimensions(cdc.routed(valid, routes)).collect()
    assert (row.type, row.sink_table, row.sink_pk, row.data) == ("insert", "DIM_T", "id", {"id": "1"})
    with pytest.raises(ValueError):
        cdc.routed(valid, routes.where("false"))


def test_latest_with_maps(spark):
    rows = spark.createDataFrame([("1", 1, "insert", {"a": "x"}), ("1", 2, "delete", {"a": "y"}), ("2", 1, "insert", None)], "id string, n int, type string, data map<string,string>")
    found = {r.id: r.data for r in cdc.latest(rows, ["id"], ["n"]).collect()}
    assert found == {"1": {"a": "y"}, "2": None}
    kept = cdc.latest(rows, ["id"], ["n"], apply_deletes=True)
    assert [r.id for r in kept.collect()] == ["2"]
    assert sorted(r.id for r in cdc.upserted(kept, rows.where("n = 2"), ["id"]).collect()) == ["1", "2"]


def test_words_and_times(spark):
    assert words.tokenize("Été 小米手机x", frozenset(["小米", "手机"])) == ["été", "小米", "手机", "x"]
    row = spark.range(1).select(words.action_rows(F.lit(2), F.lit(0), F.lit(5)).alias("a"), times.text_millis(F.lit("x")).alias("t"), times.epoch_date(F.lit(0)).alias("d")).first()
    assert [tuple(x) for x in row.a] == [(2, "CLICK"), (5, "ORDER")] and row.t is None and row.d == "19700101"


def test_products_are_summed_in_the_clusters_number_of_partitions(spark):
    """Facts are dealt by product and order before they are summed; put together, a task's groups took most memory (F9)."""
    lines = spark.range(0, 4000, 1, 2).selectExpr("id % 100 as sku_id", "id % 1000 as order_id", "1 as sku_num", "2.5 as split_total_amount", "concat('2024-01-0', 1 + id % 5, ' 00:00:00') as create_time")
    sums = stats.product_sums(stats.product_facts(orders=lines))
    rows = sums.withColumn("part", F.spark_partition_id()).collect()
    assert {r.part for r in rows} == set(range(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    assert [(r.order_ct, r.order_sku_num, float(r.order_amount), r.paid_order_ct) for r in rows] == [(10, 40, 100.0, 0)] * 100
