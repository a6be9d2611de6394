"""Sinks and streams in several batches: repeated batches, missing versions, refreshed routes, late rows, databases."""

import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import words
from tidewater.operators import cdc
from tidewater.sources import tables
from tidewater.sources.topics import read_topic
from tidewater.streaming.processors import bounce_stream, new_visitor_stream, unique_visit_stream
from tidewater.streaming.runs import finish_batches
from tidewater.streaming.windows import finish_windows

ROWS = "id string, n int, type string, name string"
DAY = 86_400_000


def test_snapshots(spark, tmp_path):
    root = f"{tmp_path}/dim"
    sink = tables.snapshot_sink(root, ["id"], ["n"])
    batch = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    held = lambda v: sorted((r.id, r.name) for r in tables.read_snapshot(spark, root, v).collect())
    sink(batch(("1", 1, "insert", "a"), ("1", 2, "update", "b"), ("2", 1, "insert", "c")), 0)
    for _ in range(2):  # a batch that is repeated gives the same version
        sink(batch(("2", 3, "update", "d"), ("3", 1, "insert", "e")), 1)
        assert held(1) == [("1", "b"), ("2", "d"), ("3", "e")]
    assert held(0) == [("1", "b"), ("2", "c")]
    with pytest.raises(AnalysisException):
        sink(batch(("9", 1, "insert", "x")), 7)
    with pytest.raises(AnalysisException):
        tables.read_snapshot(spark, root, 7)


def test_database(spark):
    url = "jdbc:derby:memory:tidewater;create=true"
    sink = tables.table_sink("stats", ["keyword", "ct"], url=url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    rows = spark.createDataFrame([(3, "x", "ring"), (4, "y", "blue")], "ct long, other string, keyword string")
    sink(rows, 0)
    sink(rows.where("ct = 4"), 1)
    got = tables.read_table(spark, "stats", url=url, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert [c.lower() for c in got.columns] == ["keyword", "ct"] and sorted(map(tuple, got.collect())) == [("blue", 4), ("blue", 4), ("ring", 3)]


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
    os.utime(folder / name, (1_700_000_000 + int(name),) * 2)  # read in this order


def worked(spark, stream, name):
    """Rows of every batch, one input file a batch."""
    out = []
    finish_batches(stream, lambda batch, n: out.append(sorted(map(tuple, batch.collect()))), name)
    return [rows for rows in out if rows]


def files(spark, folder, schema):
    raw = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
    return raw.select(F.from_json("value", schema).alias("r")).select("r.*")


def test_routes_are_read_for_every_batch(spark, tmp_path):
    folder, routes = tmp_path / "changes", f"{tmp_path}/routes"
    change = lambda i: {"table": "t", "type": "insert", "data": {"id": str(i), "a": "x"}}
    lines(folder, "1", [change(1)])
    lines(folder, "2", [change(2)])
    spark.createDataFrame([("t", "insert", "hbase", "DIM_A", "id", None, None)], schemas.ROUTES).write.parquet(routes)
    seen = []

    def write(batch, n):
        rows = cdc.dimensions(cdc.routed(cdc.valid_changes(cdc.parse_changes(batch)), tables.read_routes(spark, routes)))
        seen.extend((r.sink_table, r.data) for r in rows.collect())
        spark.createDataFrame([("t", "insert", "hbase", "DIM_B", "id,a", None, None)], schemas.ROUTES).write.mode("overwrite").parquet(routes)

    finish_batches(spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder)), write, "routes")
    assert seen == [("DIM_A", {"id": "1"}), ("DIM_B", {"id": "2", "a": "x"})]


LOG = "common struct<mid:string,is_new:string>, page struct<page_id:string,last_page_id:string>, ts long"


def page(mid, ts, last=None, new="1"):
    return {"common": {"mid": mid, "is_new": new}, "page": {"page_id": "p", "last_page_id": last}, "ts": ts}


def test_keyed_streams_over_batches(spark, tmp_path):
    folder = tmp_path / "pages"
    lines(folder, "1", [page("a", 10_000), page("b", 12_000), page("c", 13_000)])
    lines(folder, "2", [page("b", 15_000, "p"), page("a", DAY), page("d", 5 * DAY)])
    lines(folder, "3", [page("late", 1_000), page("a", 5 * DAY + 20_000), page("a", 5 * DAY + 60_000)])
    flags = [(r[0], r[1], r[2]) for rows in worked(spark, new_visitor_stream(files(spark, folder, LOG)), "new") for r in rows]
    assert [x for x in flags if x[0] == "a"] == [("a", 10_000, "1"), ("a", DAY, "0"), ("a", 5 * DAY + 20_000, "0"), ("a", 5 * DAY + 60_000, "0")]
    visits = [(r[0], r[1]) for rows in worked(spark, unique_visit_stream(files(spark, folder, LOG)), "unique") for r in rows]
    assert sorted(visits) == [("a", 10_000), ("a", DAY), ("a", 5 * DAY + 20_000), ("b", 12_000), ("c", 13_000), ("d", 5 * DAY)]  # the late row is dropped
    jumps = [(r[0], r[1]) for rows in worked(spark, bounce_stream(files(spark, folder, LOG)), "jumps") for r in rows]
    assert sorted(jumps) == [("a", 10_000), ("a", DAY), ("a", 5 * DAY + 20_000), ("c", 13_000), ("d", 5 * DAY)]  # b went on; the last one of a is open


def test_late_rows_of_windows_are_dropped(spark, tmp_path):
    folder = tmp_path / "late"
    lines(folder, "1", [{"ts": 1_000}, {"ts": 65_000}])
    lines(folder, "2", [{"ts": 66_000}])
    lines(folder, "3", [{"ts": 2_000}, {"ts": 200_000}])
    rows = files(spark, folder, "ts long").withColumn("at", F.timestamp_millis("ts")).withWatermark("at", "3 seconds")
    counts = rows.groupBy(F.window("at", "10 seconds")).count().select(F.unix_millis("window.start"), "count")
    assert [r for rows in worked(spark, counts, "late") for r in rows] == [(0, 1), (60_000, 2)]


def test_topic_without_schema_and_dictionary_words(spark, tmp_path):
    lines(tmp_path / "t", "1", [{"a": 1}])
    assert [r.value for r in read_topic(spark, f"{tmp_path}/t", stream=False).collect()] == ['{"a": 1}']
    rows = spark.createDataFrame([("小米手机 Red",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(words.dictionary_tokens(F.col("t"), ["小米", "手机"])).collect()] == [["小米", "手机", "red"], [], []]


def test_keyed_streams_deal_visitors_into_buckets(spark, tmp_path):
    """One call a bucket and batch: visitors that share a bucket keep their own days and waiting pages."""
    folder, many = tmp_path / "many", 3000
    lines(folder, "1", [page(f"m{i}", 10_000 + i) for i in range(many)])
    lines(folder, "2", [page(f"m{i}", DAY + i) for i in range(0, many, 2)] + [page("end", 9 * DAY)])
    keys = unique_visit_stream(files(spark, folder, LOG))._jdf.queryExecution().analyzed().toString()
    assert "bucket" in keys
    visits = [r[0] for rows in worked(spark, unique_visit_stream(files(spark, folder, LOG)), "unique") for r in rows]
    assert len(visits) == many + many // 2 + 1 and len(set(visits)) == many + 1
    jumps = [r[0] for rows in worked(spark, bounce_stream(files(spark, folder, LOG)), "jumps") for r in rows]
    assert len(jumps) == many + many // 2  # the last page is open


def test_windows_of_batches(spark, tmp_path):
    """Rows of open windows wait, late ones are dropped, windows come once; no state store is written."""
    folder, state, out = tmp_path / "rows", f"{tmp_path}/state", f"{tmp_path}/out"
    sums = lambda rows: rows.groupBy(F.window("at", "10 seconds")["start"].alias("start")).agg(F.sum("n").alias("n"))
    for name, rows in {"1": [(1_000, 1), (12_000, 2), (None, 9)], "2": [(2_000, 4), (13_000, 8), (25_000, 16)], "3": [(9_000, 32), (21_000, 64), (50_000, 128)]}.items():
        lines(folder, name, [{"ts": ts, "n": n} for ts, n in rows])
        stream = files(spark, folder, "ts long, n long").select(F.timestamp_millis("ts").alias("at"), "n")
        got = finish_windows(stream, sums, "windows", window="10 seconds", delay_ms=3_000, state=state, out=out)
    # the watermark is 9, 22 and 47 seconds: the first late row still finds its window open, the second does not
    assert sorted((r[0].timestamp(), r[1]) for r in got.collect()) == [(0.0, 5), (10.0, 10), (20.0, 80)]
    assert not os.path.exists(f"{state}/state")
