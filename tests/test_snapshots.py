"""Ordered upserts into buckets, topics written once, lookups per batch, state by the clock, ranges of arrival, tables by configuration."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.compare import differences
from tidewater import schemas
from tidewater.operators import cdc, stats, visits, wide
from tidewater.plans import catalog
from tidewater.sources import configured, files, snapshots, topics
from tidewater.sources.topics import read_topic, write_topic, write_topics
from tidewater.streaming.joins import join_batches
from tidewater.streaming.lookups import looked_up, put_dimension, read_dimension
from tidewater.streaming.patterns import known_days, last_days, unique_visits_by_clock
from tidewater.streaming.runs import READ_BYTES, STORE, finish, finish_batches

CHANGES = "id string, type string, data map<string,string>, position int"
DAY = 86_400_000


def held(spark, root, version=None):
    return {r.id: r.data for r in snapshots.read_merged(spark, root, version).collect()}


def test_changes_of_one_key_count_in_order(spark, tmp_path):
    root = f"{tmp_path}/dim"
    sink = snapshots.merge_sink(root, ["id"], buckets=8, apply_deletes=True)
    batch = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    sink(batch(("1", "update", {"n": "zoe"}, 1), ("1", "update", {"n": "amy"}, 2), ("2", "insert", {"n": "b", "m": "x"}, 3), ("3", "insert", {"n": "c"}, 4), ("3", "delete", {"n": "c"}, 5)), 0)
    assert held(spark, root) == {"1": {"n": "amy"}, "2": {"n": "b", "m": "x"}}
    later = batch(("2", "delete", {}, 2), ("2", "insert", {"n": "d"}, 3), ("1", "update", {"m": "y"}, -9), ("4", "delete", {}, 1), (None, "insert", {"n": "?"}, 1))
    for _ in range(2):  # repeated after a failure
        sink(later, 1)
        assert held(spark, root) == {"1": {"n": "amy", "m": "y"}, "2": {"n": "d"}, None: {"n": "?"}}
    assert held(spark, root, 0) == {"1": {"n": "amy"}, "2": {"n": "b", "m": "x"}}
    sink(batch((None, "delete", {}, 1), ("1", "delete", None, 2)), 2)
    assert held(spark, root) == {"2": {"n": "d"}}
    for version in (4, 9):
        with pytest.raises(FileNotFoundError):
            sink(batch(), version)
        with pytest.raises(FileNotFoundError):
            snapshots.read_merged(spark, root, version)
    with pytest.raises(FileNotFoundError):
        snapshots.read_merged(spark, f"{tmp_path}/none")
    plain = snapshots.merge_sink(f"{tmp_path}/kept", ["id"])
    plain(batch(("1", "insert", {"n": "a"}, 1), ("1", "delete", {"m": "b"}, 2)), 0)
    assert held(spark, f"{tmp_path}/kept") == {"1": {"n": "a", "m": "b"}}  # a delete is a change like any other


def test_a_batch_rewrites_the_buckets_that_it_touches(spark, tmp_path):
    root = f"{tmp_path}/dim"
    sink = snapshots.merge_sink(root, ["id"], buckets=32)
    sink(spark.range(2000).selectExpr("string(id) id", "'insert' type", "map('n', repeat('x', 50)) data", "0 position"), 0)
    size = lambda v: sum(f.stat().st_size for f in Path(f"{root}/data/version={v}").rglob("*.parquet"))
    one = spark.createDataFrame([("7", "update", {"n": "new"}, 1)], CHANGES)
    sink(one, 1)
    assert files.names(spark, f"{root}/data/version=1") != [] and len([n for n in os.listdir(f"{root}/data/version=1") if n.startswith("bucket=")]) == 1
    assert size(1) < size(0) / 16 and snapshots.read_merged(spark, root).count() == 2000 and held(spark, root)["7"] == {"n": "new"}
    for n in (2, 3):
        sink(one, n)
    snapshots.vacuum(spark, root, keep=1)
    assert snapshots.versions(spark, root) == [3] and held(spark, root)["8"] == {"n": "x" * 50} and not os.path.exists(f"{root}/data/version=2")


def test_a_hot_key_is_spread(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 'hot', string(id)) id", "'update' type", "map('n', string(id), concat('c', id % 3), string(id)) data", "id position")
    net = {r.id: r.data for r in cdc.net_changes(rows, ["id"]).collect()}
    assert net["hot"] == {"n": "19998", "c0": "19998"} and net["19999"] == {"n": "19999", "c1": "19999"} and len(net) == 20_000 - 6667 + 1


def test_a_task_of_a_stream_reads_a_bounded_part_of_a_topic(spark, tmp_path):
    write_topic(spark.range(0, 1_100_000, 1, 1), f"{tmp_path}/topic")
    before, most = spark.conf.get(READ_BYTES), []
    finish_batches(read_topic(spark, f"{tmp_path}/topic"), lambda batch, _: most.extend(batch.groupBy(F.spark_partition_id()).count().collect()), "bounded")
    assert sum(r["count"] for r in most) == 1_100_000 and max(r["count"] for r in most) <= 500_000 and spark.conf.get(READ_BYTES) == before


def test_a_change_carries_its_other_columns_once(spark):
    rows = spark.createDataFrame([("1", "insert", {"a": "x", "b": "y"}, 1), ("1", "update", {"b": "z"}, 2), ("1", "delete", None, 2)], CHANGES).withColumn("place", F.lit("p"))
    net = cdc.net_changes(rows, ["id"])
    assert [tuple(r) for r in net.select("id", "data", "type", "place", "position", "anew").collect()] == [("1", {"a": "x", "b": "z"}, "update", "p", 2, False)]
    assert "max_by" not in net._jdf.queryExecution().executedPlan().toString()  # the columns and their order were held twice more by each cell


def test_positions_follow_files_lines_and_transactions(spark, tmp_path):
    change = lambda name, **more: json.dumps({"table": "t", "type": "update", "data": {"id": "1", "n": name}} | more)
    for i, lines in enumerate([[change("a"), change("z")], [change("m"), change("b")]]):
        (tmp_path / str(i)).write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / str(i), (1_700_000_000 - i,) * 2)  # the second file is the older one
    rows = cdc.with_data(cdc.valid_changes(cdc.parse_changes(read_topic(spark, str(tmp_path), stream=False, place=True))))
    keyed = rows.withColumn("id", F.col("data")["id"])
    assert cdc.net_changes(keyed, ["id"]).first().data["n"] == "z"
    (tmp_path / "1").write_text(change("first", xid=1, xoffset=2) + "\n" + change("last", xid=1, xoffset=3) + "\n" + change("early", xid=1) + "\n")
    again = cdc.with_data(cdc.valid_changes(cdc.parse_changes(read_topic(spark, str(tmp_path), stream=False, place=True))))
    assert cdc.net_changes(again.withColumn("id", F.col("data")["id"]), ["id"]).first().data["n"] == "last"


def test_numbers_stay_exact(spark):
    text = '{"table":"t","type":"insert","data":{"p":12345678.90,"d":123456789012345678.12,"l":12345678901234567890,"e":1e-7,"o":{"a":[1.10]},"z":null,"s":"1.50"}}'
    row = cdc.with_data(cdc.valid_changes(cdc.parse_changes(spark.createDataFrame([(text,), ('{"table":"t","table":"u","data":{"a":1}}',)], "value string")))).first()
    assert row.data == {"p": "12345678.9", "d": "123456789012345678.12", "l": "12345678901234567890", "e": "1.0E-7", "o": '{"a":[1.1]}', "z": None, "s": "1.50"}


def test_repeated_batches_are_there_once(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/topic"
    rows = spark.range(5).selectExpr("id a", "if(id < 2, 'x', 'y') sink_table", "map('id', string(id)) data")
    count = lambda path: spark.read.option("recursiveFileLookup", "true").text(path).count()
    for _ in range(2):
        write_topic(rows, root, batch=("s", 0))
    write_topic(rows, root, batch=("s", 1))
    write_topic(rows, root, batch=("other", 0))
    assert count(root) == read_topic(spark, root, stream=False).count() == 15
    # fails after the first of two topics; the repeated batch adds the other one only
    parts, real = f"{tmp_path}/parts", files.move
    monkeypatch.setattr(topics.files, "move", lambda s, a, b: real(s, a, b) if "topic=x" in b else (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        write_topics(rows, parts, batch=("s", 0))
    monkeypatch.setattr(topics.files, "move", real)
    assert count(parts) == 2
    for _ in range(2):
        write_topics(rows, parts, batch=("s", 0))
    assert sorted((r.topic, r.value) for r in spark.read.text(parts).collect()) == [("x" if i < 2 else "y", f'{{"id":"{i}"}}') for i in range(5)]
    for name in ("a=b", "a/b", "_a"):
        with pytest.raises(ValueError):
            write_topic(rows, root, batch=(name, 0))
    # readers pass over what is being written
    files.write_text(spark, f"{root}/_open/s-9/part-0.txt", "{}\n")
    assert count(root) == 15


def test_streams_into_topics_go_on_where_they_stopped(spark, tmp_path):
    source, out, state = (f"{tmp_path}/{n}" for n in ("in", "out", "state"))
    for n in range(2):
        write_topic(spark.range(3 * n, 3 * n + 3), source, batch=("s", n))
        write_topic(read_topic(spark, source, schema="id long"), out, checkpoint=state).awaitTermination()
    # the last batch was written, but the stream failed before it noted that: it is repeated
    last = max(os.listdir(f"{state}/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for name in (last, f".{last}.crc"):
        os.remove(f"{state}/commits/{name}")
    write_topic(read_topic(spark, source, schema="id long"), out, checkpoint=state).awaitTermination()
    assert sorted(r.id for r in read_topic(spark, out, schema="id long", stream=False).collect()) == list(range(6))


def test_a_change_of_a_dimension_shows_in_the_next_batch(spark, tmp_path):
    root, topic, seen = f"{tmp_path}/dim", f"{tmp_path}/topic", []
    put_dimension(root, spark.createDataFrame([("1", "old"), ("2", "two")], "id string, NAME string"))
    sink = looked_up(
        lambda s: {"d": read_dimension(s, root, ["NAME"])}, lambda rows, dims: wide.lookup(rows, dims["d"], "k", {"NAME": "name"}),
        lambda rows, n: seen.append(sorted((r.k, r.name) for r in rows.collect())),
    )
    for n in range(2):
        write_topic(spark.createDataFrame([(1,), (2,), (3,)], "k long"), topic, batch=("s", n))
        finish_batches(read_topic(spark, topic, schema="k long"), sink, "lookups", state=f"{tmp_path}/state")
        put_dimension(root, spark.createDataFrame([("1", "new")], "id string, NAME string"), kind="update")
    assert seen == [[(1, "old"), (2, "two"), (3, None)], [(1, "new"), (2, "two"), (3, None)]]


LOG = "common struct<mid:string>, page struct<last_page_id:string>, ts long"


def logs(spark, *rows):
    return spark.createDataFrame([((m,), (last,), ts) for m, last, ts in rows], LOG)


def test_days_by_the_clock(spark, tmp_path):
    before = logs(spark, ("a", None, DAY), ("a", "p", 3 * DAY), ("b", "", DAY))
    topic, state = f"{tmp_path}/topic", f"{tmp_path}/state"
    hour = 3_600_000
    for n, rows in enumerate([(("a", None, DAY + 1), ("a", None, DAY + 17 * hour), ("c", "", 5)), (("a", None, 2 * DAY - hour), ("c", "", 6), ("b", None, 0), (None, None, 1))]):
        write_topic(logs(spark, *rows), topic, batch=("s", n))
    stream = read_topic(spark, topic, schema=LOG)
    rows = unique_visits_by_clock(stream, zone="+08:00", initial=last_days(before, zone="+08:00"))
    got = sorted((r.common.mid, r.ts) for r in finish(rows, "clock", clock=True, state=state).collect())
    # in that zone, 17 hours after the beginning of a day is the day after
    assert got == [("a", DAY + 17 * hour), ("b", 0), ("c", 5)]
    days = {r.mid: (r.day, r.forgotten) for r in known_days(spark, state).collect()}
    assert {k: v[0] for k, v in days.items()} == {"a": "19700103", "b": "19700101", "c": "19700101"} and all(v[1] > 1_700_000_000_000 for v in days.values())


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("ranges", [1, 8, 200])
def test_arrivals_in_any_number_of_ranges(spark, ranges, adaptive):
    """Under small partitions, which adaptive execution merges as it likes."""
    names = {"spark.sql.adaptive.enabled": adaptive, "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)

    def query(session, sf):
        arrived = catalog._pages(session, sf).withColumn("n", F.expr("(event_id * 7919) % 1000"))
        return catalog._flat(visits.unique_visits(arrived, order=["n", "event_id"], ranges=None if ranges == 8 and adaptive == "true" else ranges))

    try:
        more, less, n = differences(spark, "/root/testdata/sf0.01", query, catalog.oracle_sql()["unique_visit_by_arrival"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert not more and not less and n


def test_state_of_chained_windows_is_bounded(spark, tmp_path):
    """Orders of closed windows leave the state, and lines that come twice count once."""
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    orders, lines = f"{tmp_path}/orders", f"{tmp_path}/lines"
    for n in range(4):
        ids = spark.range(n * 500, n * 500 + 500)
        at = F.col("id") * 100 + 10_000
        write_topic(ids.select("id", F.lit(1).alias("province_id"), at.alias("create_ts")), orders, batch=("s", n))
        line = ids.select("id", F.col("id").alias("order_id"), F.lit("1.50").cast("decimal(16,2)").alias("split_total_amount"), (at + 3).alias("create_ts"))
        write_topic(line.unionByName(line), lines, batch=("s", n))
    raw = lambda topic, schema: read_topic(spark, topic, schema=schema, files_per_batch=4)
    wides = wide.order_lines(raw(orders, schemas.ORDER_INFO), raw(lines, schemas.ORDER_DETAIL), low_ms=0, high_ms=5, delay="1 second")
    query = stats.province_sums_chained(wides, window="10 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r.stt[-8:], float(r.order_amount), r.order_count) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(f"00:0{s // 60}:{s % 60:02}"[-8:], 150.0, 100) for s in range(10, 200, 10)]
    kept = [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert len(kept) > 3 and kept[-1] < 400 and max(kept) < 3000  # 2000 orders and 4000 lines passed


def test_tables_by_configuration(spark, tmp_path):
    spark.sql(f"create database routed location 'file://{tmp_path}/routed'")
    try:
        rows = "sink_table string, sink_columns string, sink_pk string, sink_extend string, type string, data map<string,string>, position int"
        sink = configured.route_sink("routed", apply_deletes=True)
        batch = lambda *r: spark.createDataFrame(list(r), rows)
        sink(batch(("dim_x", "key,name", "key", "SALT_BUCKETS=3", "insert", {"key": "1", "name": "a"}, 1), ("dim_x", "key,name", "key", "SALT_BUCKETS=3", "insert", {"key": "2", "name": "b"}, 2)), 0)
        assert sorted(map(tuple, spark.sql("select KEY, NAME from routed.DIM_X").collect())) == [("1", "a"), ("2", "b")]
        sink(batch(("Dim_X", "key,name,more", "key", None, "update", {"key": "1", "more": "m"}, 1), ("dim_x", "key,name,more", "key", None, "delete", {"key": "2"}, 2), ("dim_x", None, "key", None, "insert", {"key": "3", "other": "?"}, 3), ("dim_y", "id", None, None, "insert", {"id": "9"}, 4)), 1)
        assert sorted(map(tuple, spark.sql("select * from routed.DIM_X").collect())) == [("1", "a", "m"), ("3", None, None)]
        assert spark.table("routed.DIM_X").columns == ["KEY", "NAME", "MORE"] and [r[0] for r in spark.sql("select ID from routed.dim_y").collect()] == ["9"]
        known = {r["key"]: r["value"] for r in spark.sql("show tblproperties routed.DIM_X_ROWS").collect()}
        assert known["buckets"] == known["SALT_BUCKETS"] == "3"
        sink(batch(("dim_x", "key", "key", None, "delete", {"key": "1"}, 1), ("dim_x", "key", "key", None, "delete", {"key": "3"}, 2)), 2)
        assert spark.table("routed.DIM_X").count() == 0
        with pytest.raises(ValueError):
            sink(batch(("dim_z", "a b", None, None, "insert", {"id": "1"}, 1)), 3)
    finally:
        spark.sql("drop database routed cascade")


def test_first_known_and_console(spark):
    rows = spark.createDataFrame([(None, 2), (1, 2), (None, None)], "a int, b int")
    assert [r[0] for r in rows.select(wide.first_known(F.col("a"), F.col("b"))).collect()] == [2, 1, None]
    from tidewater.sources.tables import console

    query = console(spark.readStream.format("rate").load()).start()
    assert query.isActive
    query.stop()


def test_interval_join_of_two_streams_by_batches(spark, tmp_path):
    """Rows wait for later batches, late rows are dropped, a repeated batch ends the same, and no row is kept that nothing can match."""
    left, right, state, out = (f"{tmp_path}/{n}" for n in ("left", "right", "state", "out"))
    pairs = lambda a, b: a.join(b, (a.id == b.of) & (b.at - a.at).between(0, 10)).select("id", "n")
    seen = []

    def sink(rows, batch_id, reached):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        seen.append(reached)

    def run():
        sides = (read_topic(spark, left), "id long, at long"), (read_topic(spark, right), "of long, n long, at long")
        join_batches(*sides, pairs, sink, "pairs", low_ms=0, high_ms=10, delay_ms=5, at=("at", "at"), state=state)

    def put(n, lefts, rights):
        write_topic(spark.createDataFrame(lefts, "id long, at long"), left, batch=("s", n))
        write_topic(spark.createDataFrame(rights, "of long, n long, at long"), right, batch=("s", n))
        run()

    put(0, [(1, 100), (2, 100), (3, 80), (None, 90)], [(1, 10, 105), (9, 11, 100), (3, 12, None), (3, 13, 91)])  # reached 100, watermark 95
    put(1, [(4, 111)], [(2, 20, 110), (2, 21, 111), (1, 22, 95), (9, 23, 108)])  # the third is late; reached 111, watermark 106
    waiting = spark.read.parquet(f"{state}-waiting/1").collect()
    assert sorted(json.loads(r.value)["at"] for r in waiting) == [100, 100, 108, 110, 111, 111]
    for commit in ("1", ".1.crc"):
        os.remove(f"{state}/commits/{commit}")
    run()  # batch 1 once more
    put(2, [(9, 107)], [(4, 30, 121), (4, 31, 122)])
    got = sorted((r.id, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(1, 10), (2, 20), (4, 30), (9, 23)] and seen == [100, 111, 111, 111]
