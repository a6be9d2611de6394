"""Every query over the provided tables, with the SQL that it is held against.

Windows are a day wide where ten seconds would hold hardly a row, and bounds of interval joins are days, since the
tables' times are days apart. Money is summed in decimal and given as double.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import schemas
from tidewater.functions import times, words
from tidewater.operators import cdc, logs, stats, visits, wide
from tidewater.plans import adapters as data
from tidewater.plans import oracle
from tidewater.plans.adapters import DAY_MS, SESSION_MS
from tidewater.plans.registered import FOUND, plain, query
from tidewater.session import shared_folder, written
from tidewater.sources.snapshots import merge_sink, read_merged
from tidewater.sources.tables import read_routes, split_sink, table_sink
from tidewater.sources.topics import PACKED, read_topic, topic_table, write_topic, write_topics
from tidewater.streaming.joins import finish_join
from tidewater.streaming.patterns import finish_bounces
from tidewater.streaming.processors import bounce_stream, new_visitor_stream, unique_visit_stream
from tidewater.streaming.runs import finish, finish_batches
from tidewater.streaming.windows import finish_windows

DAY = "1 day"
#: The day on which ages are taken.
NOW = "2026-01-01 00:00:00"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return logs.pages(data.page_log(spark, sf))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "common.mid", "common.is_new", "page.page_id", "page.last_page_id", "ts")


FLAT = "event_id, mid, is_new, page_id, last_page_id, ts"


def _lines(spark: SparkSession, sf: str, low: int = 0, high: int = 365 * DAY_MS) -> DataFrame:
    return wide.order_lines(data.order_info(spark, sf), data.order_detail(spark, sf), low_ms=low, high_ms=high)


def _now():
    return times.text_millis(F.lit(NOW))


# logs


@query("select event_id, mid, ts from logs where is_start")
def log_split_start(spark, sf):
    return logs.starts(data.page_log(spark, sf)).select("event_id", "common.mid", "ts")


@query(f"select {FLAT} from pages")
def log_split_page(spark, sf):
    return _flat(_pages(spark, sf))


@query("select item, item_type, page_id from shown")
def log_split_display(spark, sf):
    return logs.displays(data.page_log(spark, sf))


@query("""select event_id, mid, case when is_new = '1' and ts // 86400000 <> arg_min(ts // 86400000, struct_pack(ts := ts, event_id := event_id)) filter (is_new = '1') over (partition by mid) then '0' else is_new end as is_new,
    page_id, last_page_id, ts from logs""")
def new_visitor_repair(spark, sf):
    return _flat(logs.repair_new_visitors(data.page_log(spark, sf), order=("ts", "event_id")))


@query(f"select {FLAT} from visits")
def unique_visit(spark, sf):
    return _flat(visits.unique_visits(_pages(spark, sf), tie=["event_id"]))


@query("""select event_id, mid, is_new, page_id, last_page_id, ts from (select *, lag(ts // 86400000) over (partition by mid order by n, event_id) as before from (select *, (event_id * 7919) % 1000 as n from pages where coalesce(last_page_id, '') = ''))
    where ts // 86400000 is distinct from before""")
def unique_visit_by_arrival(spark, sf):
    arrived = _pages(spark, sf).withColumn("n", F.expr("(event_id * 7919) % 1000"))
    return _flat(visits.unique_visits(arrived, order=["n", "event_id"]))


@query(f"select {FLAT} from bounced")
def user_jump(spark, sf):
    return _flat(visits.bounces(_pages(spark, sf), timeout_ms=SESSION_MS, tie=["event_id"]))


def _visitor_facts(spark, sf, window=stats.WINDOW):
    return stats.visitor_facts_of(_pages(spark, sf), window=window, timeout_ms=SESSION_MS, tie=["event_id"])


@query(oracle.visitor(DAY_MS))
def visitor_stats(spark, sf):
    return stats.visitor_stats(_visitor_facts(spark, sf, DAY), window=DAY)


@query(oracle.visitor(10_000))
def visitor_stats_10s(spark, sf):
    return stats.visitor_stats(_visitor_facts(spark, sf))


# changes


def _changes(spark, sf):
    return cdc.valid_changes(cdc.parse_changes(data.changes(spark, sf)))


def _routed(spark, sf):
    return cdc.routed(_changes(spark, sf), spark.createDataFrame(data.ROUTES, schemas.ROUTES))


def _in_columns(rows: DataFrame) -> DataFrame:
    """Changes with data in the order of the source table's columns; a variant has no order of names."""
    columns = F.create_map(*[x for t, names in data.CHANGED.items() for x in (F.lit(t), F.array(*map(F.lit, names)))])[F.col("table")]
    entries = F.transform(F.filter(columns, lambda c: F.map_contains_key("data", c)), lambda c: F.struct(c.alias("key"), F.col("data")[c].alias("value")))
    return rows.withColumn("data", F.map_from_entries(entries))


def _as_text(rows: DataFrame) -> DataFrame:
    return _in_columns(rows).select("table", "type", "sink_table", "sink_pk", F.to_json("data").alias("data"))


@query("""select "table", case when boot then 'bootstrap-insert' else type end as type, id from valid""")
def cdc_filter(spark, sf):
    return cdc.with_data(_changes(spark, sf)).select("table", "type", F.col("data")["id"].alias("id"))


@query(oracle.routes("kafka"))
def cdc_route_fact(spark, sf):
    return _as_text(cdc.facts(_routed(spark, sf)))


@query(oracle.routes("hbase"))
def cdc_route_dim(spark, sf):
    return _as_text(cdc.dimensions(_routed(spark, sf)))


@query("""select id, '{"b":"' || b || '"}' as data from valid where "table" = 'part'""")
def cdc_prune(spark, sf):
    parts = cdc.with_data(_changes(spark, sf).where("table = 'part'"))
    kept = cdc.pruned(F.col("data"), F.lit("p_brand, p_name"))
    return parts.select(F.col("data")["id"].alias("id"), F.to_json(F.create_map(F.lit("b"), kept["p_brand"])).alias("data"))


@query("select mid, event_id, type, page_id from (select mid, event_id, 'update' as type, page_id, row_number() over (partition by mid order by ts desc, event_id desc) as nth from logs) where nth = 1")
def dim_upsert_latest(spark, sf):
    rows = data.page_log(spark, sf).select("common.mid", "ts", "event_id", F.lit("update").alias("type"), "page.page_id")
    return cdc.latest(rows, ["mid"], ["ts", "event_id"]).select("mid", "event_id", "type", "page_id")


# orders and payments


ORDER_FIELDS = """detail_id, order_id, sku_id, order_price, sku_num, province_id, order_status, user_id, total_amount, activity_reduce_amount, coupon_reduce_amount, original_total_amount, feight_fee,
split_activity_amount, split_coupon_amount, split_total_amount, create_time, create_date"""
MONEY_FIELDS = {f.strip() for f in ORDER_FIELDS.split(",") if f.strip().endswith(("price", "amount", "fee"))}


def _doubles(fields: str, prefix: str = "") -> str:
    return ", ".join(f"cast({prefix}{f} as double) as {f}" if f in MONEY_FIELDS else f"{prefix}{f}" for f in map(str.strip, fields.split(",")))


@query(f"select {_doubles(ORDER_FIELDS)} from near")
def order_interval_join(spark, sf):
    return plain(_lines(spark, sf, -5 * DAY_MS, 5 * DAY_MS).select(*map(str.strip, ORDER_FIELDS.split(","))))


PAID = "payment_id, subject, payment_type, payment_create_time, callback_time, detail_id, order_id, sku_id, user_id, total_amount, split_total_amount, order_create_time"


@query(f"select {_doubles(PAID)} from paid")
def payment_interval_join(spark, sf):
    return plain(_paid(spark, sf).select(*map(str.strip, PAID.split(","))))


def _paid(spark, sf):
    return wide.payment_wide(data.payment_info(spark, sf), _lines(spark, sf), low_ms=-30 * DAY_MS)


AGE = f"cast((epoch_ms(timestamp '{NOW}') - epoch_ms(cast(u.birthday as timestamp))) // {times.YEAR_MS} as integer)"


PAYMENT_FIELDS = ", ".join(f.strip() for f in ORDER_FIELDS.split(",") if f.strip() not in ("create_time", "create_date"))


@query(f"""select payment_id, subject, payment_type, payment_create_time, callback_time, order_create_time, {_doubles(PAYMENT_FIELDS, "w.")}, s.sku_name,
    {AGE} as user_age, u.gender as user_gender, n_name as province_name, r_name as province_area_code, iso as province_iso_code, iso2 as province_3166_2_code,
    spu_id, category3_id, tm_id, spu_name, category3_name, tm_name, cast(null as double) as split_feight_fee
    from paid w left join users u on cast(user_id as varchar) = u.id left join provinces p on cast(province_id as varchar) = p.id
    left join skus s using (sku_id) left join spus using (spu_id) left join categories using (category3_id) left join trademarks using (tm_id)""")
def payment_wide(spark, sf):
    """Payments with every column of the wide order, its six lookups included."""
    wides = wide.order_wide(_lines(spark, sf), data.dimensions(spark, sf), _now())
    paid = wide.payment_wide(data.payment_info(spark, sf), wides, low_ms=-30 * DAY_MS)
    return plain(paid.drop("payment_ts", "wide_ts", "order_ts", "detail_ts"))




@query(f"select order_id, user_id, {AGE} as user_age, u.gender as user_gender from oi left join users u on cast(user_id as varchar) = u.id")
def lookup_user(spark, sf):
    orders = data.order_info(spark, sf).select(F.col("id").alias("order_id"), "user_id")
    return wide.with_user(orders, data.dimension(spark, sf, "user"), _now())


@query("select order_id, province_id, n_name as province_name, r_name as province_area_code, iso as province_iso_code, iso2 as province_3166_2_code from oi left join provinces p on cast(province_id as varchar) = p.id")
def lookup_province(spark, sf):
    orders = data.order_info(spark, sf).select(F.col("id").alias("order_id"), "province_id")
    return wide.with_province(orders, data.dimension(spark, sf, "province"))


def _sku_lines(spark, sf):
    return wide.with_sku(data.order_detail(spark, sf).select(F.col("id").alias("detail_id"), "sku_id"), data.dimension(spark, sf, "sku"), price=True)


@query("select detail_id, sku_id, s.sku_name, spu_id, category3_id, tm_id, cast(sku_price as double) as sku_price from od left join skus s using (sku_id)")
def lookup_sku(spark, sf):
    return plain(_sku_lines(spark, sf))


@query("select detail_id, spu_id, spu_name from od left join skus using (sku_id) left join spus using (spu_id)")
def lookup_spu(spark, sf):
    return wide.with_spu(_sku_lines(spark, sf).select("detail_id", "spu_id"), data.dimension(spark, sf, "spu"))


@query("select detail_id, category3_id, category3_name from od left join skus using (sku_id) left join categories using (category3_id)")
def lookup_category3(spark, sf):
    return wide.with_category(_sku_lines(spark, sf).select("detail_id", "category3_id"), data.dimension(spark, sf, "category"))


@query("select detail_id, tm_id, tm_name from od left join skus using (sku_id) left join trademarks using (tm_id)")
def lookup_trademark(spark, sf):
    return wide.with_trademark(_sku_lines(spark, sf).select("detail_id", "tm_id"), data.dimension(spark, sf, "trademark"))


@query(f"""select {_doubles(ORDER_FIELDS, "w.")}, s.sku_name, {AGE} as user_age, u.gender as user_gender, n_name as province_name, r_name as province_area_code, iso as province_iso_code, iso2 as province_3166_2_code,
    spu_id, category3_id, tm_id, spu_name, category3_name, tm_name, cast(null as varchar) as expire_time, cast(null as varchar) as operate_time, cast(null as varchar) as create_hour, cast(null as double) as split_feight_fee
    from wide w left join users u on cast(user_id as varchar) = u.id left join provinces p on cast(province_id as varchar) = p.id
    left join skus s using (sku_id) left join spus using (spu_id) left join categories using (category3_id) left join trademarks using (tm_id)""")
def order_wide(spark, sf):
    return plain(wide.order_wide(_lines(spark, sf), data.dimensions(spark, sf), _now()).drop("order_ts", "detail_ts"))


@query(f"select user_id, {AGE} as user_age from (select cast(id as bigint) as user_id, birthday from users) u")
def user_age(spark, sf):
    users = data.dimension(spark, sf, "user")
    born = times.text_millis(F.concat("BIRTHDAY", F.lit(" 00:00:00")))
    return users.select(F.col("id").cast("long").alias("user_id"), times.age(born, _now()).alias("user_age"))


@query("select n_nationkey, n_regionkey, n_name as name from nation where n_nationkey % 5 <> 3 union all select n_nationkey, n_regionkey, null from nation where n_nationkey % 5 = 3")
def lookup_two_columns(spark, sf):
    nation = data.table(spark, sf, "nation")
    dimension = nation.where("n_nationkey % 5 <> 3").selectExpr("cast(n_nationkey as string) as id", "cast(n_regionkey as string) as region", "n_name as NAME")
    return wide.lookup(nation.select("n_nationkey", "n_regionkey"), dimension, ["n_nationkey", "n_regionkey"], {"NAME": "name"}, on=["id", "region"])


# statistics


def _province_rows(spark, sf):
    o = data.order_info(spark, sf).select(F.col("id").alias("order_id"), "province_id", F.timestamp_millis("create_ts").alias("at"))
    rows = o.join(data.order_detail(spark, sf).select("order_id", "split_total_amount"), "order_id")
    return wide.with_province(rows, data.dimension(spark, sf, "province"))


@query(oracle.province(DAY_MS))
def province_stats(spark, sf):
    return plain(stats.province_stats(_province_rows(spark, sf), window=DAY))


@query(oracle.province(10_000))
def province_stats_10s(spark, sf):
    return plain(stats.province_stats(_province_rows(spark, sf)))


STAMP = 1_767_225_600_000


@query(f"select *, {STAMP} as ts from ({oracle.province(DAY_MS)})")
def province_stats_stamped(spark, sf):
    return times.stamped(province_stats(spark, sf), F.lit(STAMP))


def _product_facts(spark, sf):
    pages = _pages(spark, sf)
    # order lines are written once, with what both statistics and payments read of them
    lines = written(_lines(spark, sf).select("order_id", "create_time", "order_ts", "sku_id", "sku_num", "split_total_amount"), "order-lines")
    return stats.product_facts(
        clicks=pages, displays=pages, orders=lines, favors=data.actions(spark, sf, "signup"), carts=data.actions(spark, sf, "purchase"),
        payments=wide.payment_wide(data.payment_info(spark, sf), lines, low_ms=-30 * DAY_MS), refunds=data.refunds(spark, sf), comments=data.actions(spark, sf, "error"),
    )


@query("""select p.*, s.sku_name, s.spu_id, s.category3_id, s.tm_id, cast(s.sku_price as double) as sku_price, spu_name, category3_name, tm_name
    from product p left join skus s using (sku_id) left join spus using (spu_id) left join categories using (category3_id) left join trademarks using (tm_id)""")
def product_stats(spark, sf):
    return plain(stats.product_stats(_product_facts(spark, sf), data.dimensions(spark, sf, "sku", "spu", "category", "trademark"), window=DAY))


@query("select * from product", 10_000)
def product_stats_10s(spark, sf):
    return plain(stats.product_sums(_product_facts(spark, sf)))


TOKENS = r"unnest(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'))"


@query(f"select doc_id, word, count(*) as n from (select doc_id, {TOKENS.format('text')} as word from documents) group by all")
def keyword_tokens(spark, sf):
    docs = data.table(spark, sf, "documents").select("doc_id", F.explode(words.tokens(F.col("text"))).alias("word"))
    return docs.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(f"""select keyword, count(*) as ct, 'SEARCH' as source, {oracle.bucket("ts", DAY_MS)[0]} as stt, {oracle.bucket("ts", DAY_MS)[1]} as edt
    from (select {TOKENS.format("item")} as keyword, ts from pages where page_id = 'good_list' and item is not null) group by all""")
def keyword_stats(spark, sf):
    return stats.keyword_stats(stats.search_words(_pages(spark, sf)), window=DAY)


@query(f"""select stt, edt, {TOKENS.format("spu_name")} as keyword, ct, source from (
    select stt, edt, sku_id, click_ct as ct, 'CLICK' as source from product union all select stt, edt, sku_id, cart_ct, 'CART' from product union all select stt, edt, sku_id, order_ct, 'ORDER' from product)
    join skus using (sku_id) join spus using (spu_id) where ct > 0""")
def keyword_product_c2r(spark, sf):
    """Reads the three counts that it turns into rows, and the names of products and standard products."""
    dims = data.dimensions(spark, sf, "sku", "spu")
    facts = stats.product_facts(clicks=_pages(spark, sf), orders=_lines(spark, sf), carts=data.actions(spark, sf, "purchase"))
    named = wide.with_spu(wide.with_sku(stats.product_sums(facts, window=DAY), dims["sku"]), dims["spu"])
    return stats.product_keywords(named)


@query(f"""select n_nationkey, {TOKENS.format("n_name")} as word, ct, source from (select n_nationkey, n_name, n_regionkey as ct, 'CLICK' as source from nation
    union all select n_nationkey, n_name, 1, 'CART' from nation) where ct > 0""")
def table_functions(spark, sf):
    words.register_functions(spark)
    data.table(spark, sf, "nation").createOrReplaceTempView("tidewater_nation")
    return spark.sql("""select n_nationkey, t.word, a.ct, a.source from tidewater_nation, lateral ik_analyze(replace(n_name, '_', ' ')) t,
        lateral keywordProductC2R(cast(n_regionkey as bigint), 1L, null) a""")


# functions


@query("select event_id, page_id, item from pages where page_id = 'good_list' and item is not null")
def map_access(spark, sf):
    page = F.create_map(F.lit("page_id"), F.col("page.page_id"), F.lit("item"), F.col("page.item"))
    rows = _pages(spark, sf).select("event_id", page.alias("page"))
    return rows.where("page['page_id'] = 'good_list' and page['item'] is not null").selectExpr("event_id", "page['page_id'] as page_id", "page['item'] as item")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.none') as missing from events")
def json_extract(spark, sf):
    return data.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.get_json_object("props", "$.none").alias("missing"))


@query("select event_id, strftime(ts, '%Y%m%d') as day, strftime(ts + interval 8 hours, '%Y%m%d') as day_east from events")
def epoch_to_date(spark, sf):
    ts = F.col("ts")
    return data.events(spark, sf).select("event_id", times.epoch_date(ts).alias("day"), times.epoch_date(ts, "+08:00").alias("day_east"))


@query("select event_id, ts // 1000 * 1000 as ms, ts // 1000 * 1000 - 28800000 as ms_east from ev")
def str_to_millis(spark, sf):
    text = F.col("create_time")
    return data.events(spark, sf).select("event_id", times.text_millis(text).alias("ms"), times.text_millis(text, "+08:00").alias("ms_east"))


# streams


def _topic(spark, rows: DataFrame, name: str) -> str:
    """A batch as a topic of JSON lines."""
    path = shared_folder(spark, name)
    write_topic(rows, path)
    return path


def _finished(spark, name: str, build: Callable[..., DataFrame], run: Callable[..., DataFrame] = finish, **topics: DataFrame) -> DataFrame:
    """Writes batches as topics, works off the stream that ``build`` makes of them (as streams, by name) with ``run``, and deletes them."""
    paths = {n: _topic(spark, rows, n.replace("_", "-")) for n, rows in topics.items()}
    schema = {n: ", ".join(f"{c} {t}" for c, t in rows.dtypes) for n, rows in topics.items()}
    return run(build(**{n: read_topic(spark, paths[n], schema=schema[n]) for n in paths}), name, spent=tuple(paths.values()))


def _joined(spark, name: str, join: Callable[[DataFrame, DataFrame], DataFrame], how: dict, **topics: DataFrame) -> DataFrame:
    """Writes two batches as topics, joins them as streams, and deletes them."""
    paths = {n: _topic(spark, rows, n) for n, rows in topics.items()}
    sides = [(read_topic(spark, paths[n]), ", ".join(f"{c} {t}" for c, t in rows.dtypes)) for n, rows in topics.items()]
    return finish_join(*sides, join, name, spent=tuple(paths.values()), **how)


def _by_day(sums: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    return lambda facts, name, spent: finish_windows(facts, lambda rows: sums(rows, window=DAY), name, window=DAY, delay_ms=13_000, spent=spent)


#: Bounces that the end of the stream leaves open are none yet.
SETTLED = f"select * from bounced where ts + {SESSION_MS} < (select max(ts) from pages)"


def _unlogged(rows: DataFrame) -> DataFrame:
    """The page logs that a keyed stream passed on as text."""
    return rows.select(F.from_json("log", f"{schemas.PAGE_LOG}, event_id bigint").alias("l")).select("l.*")


def _uniques(spark, sf) -> DataFrame:
    return _unlogged(_finished(spark, "unique-visit", lambda pages: unique_visit_stream(pages), pages=_pages(spark, sf)))


def _jumps(spark, sf) -> DataFrame:
    return _unlogged(_finished(spark, "user-jump", lambda pages: bounce_stream(pages, timeout_ms=SESSION_MS), pages=_pages(spark, sf)))


@query(f"select mid, ts from ({SETTLED})")
def stream_user_jump(spark, sf):
    """The timeouts of the bounce pattern."""
    run = lambda pages, name, spent: finish_bounces(pages, name, timeout_ms=SESSION_MS, spent=spent)
    return _finished(spark, "user-jump", lambda pages: pages, run, pages=_pages(spark, sf)).select("common.mid", "ts")


@query("""select mid, ts, case when is_new = '1' and ts // 86400000 <> min(ts // 86400000) filter (is_new = '1') over (partition by mid) then '0' else is_new end as is_new from pages""")
def stream_new_visitors(spark, sf):
    return _finished(spark, "new-visitors", lambda pages: new_visitor_stream(pages), pages=_pages(spark, sf)).select("mid", "ts", F.col("flag").alias("is_new"))


@query("select mid, ts from visits")
def stream_unique_visit(spark, sf):
    return _uniques(spark, sf).select("common.mid", "ts")


#: Windows that the watermark, 13 seconds behind the latest of ``rows``, has closed.
def _closed(query: str, at: str, rows: str) -> str:
    return f"select * from ({query}) where edt <= (select strftime(make_timestamp((max({at}) - 13000) * 1000), {oracle.FORMAT}) from {rows})"


@query(_closed(oracle.visitor(DAY_MS).replace("from bounced", f"from ({SETTLED})"), "ts", "pages"))
def stream_visitor_stats(spark, sf):
    """The whole job: pages, and the topics of unique visits and bounces that two other streams have written."""

    def build(pages, uniques, jumps):
        return stats.visitor_facts(pages, uniques, jumps)

    return _finished(spark, "visitor-stats", build, _by_day(stats.visitor_stats), pages=_pages(spark, sf), uniques=_uniques(spark, sf), jumps=_jumps(spark, sf))


@query(_closed("select * from product", "tms", "facts"))
def stream_product_stats(spark, sf):
    """Facts of seven topics; orders of closed windows are summed first, and windows from these sums."""

    def build(pages, **others):
        return stats.product_facts(clicks=pages, displays=pages, **others)

    return plain(_finished(
        spark, "product-stats", build, _by_day(stats.product_sums), pages=_pages(spark, sf), orders=_lines(spark, sf), favors=data.actions(spark, sf, "signup"), carts=data.actions(spark, sf, "purchase"),
        payments=_paid(spark, sf), refunds=data.refunds(spark, sf), comments=data.actions(spark, sf, "error"),
    ))


@query(_closed(oracle.province(DAY_MS), "order_ts", "oi join od using (order_id)"))
def stream_province_stats(spark, sf):
    """A table over the topic of wide orders, with its event time and watermark, asked in SQL."""
    rows = _province_rows(spark, sf).withColumn("create_ts", F.unix_millis("at")).drop("at")
    path = _topic(spark, rows, "province-orders")
    wides = topic_table(spark, "tidewater_order_wide", path, ", ".join(f"{c} {t}" for c, t in rows.dtypes), "timestamp_millis(create_ts)", "13 seconds")
    assert wides.isStreaming
    asked = stats.province_stats(spark.sql("select *, rowtime as at from tidewater_order_wide").drop("rowtime"), window=DAY)
    return plain(finish(asked, "province-stats", spent=(path,)))


@query(f"select {_doubles(PAID)} from paid")
def stream_payment_join(spark, sf):
    low = -30 * DAY_MS
    join = lambda paid, wides: wide.payment_wide(paid, wides, low_ms=low).select(*map(str.strip, PAID.split(",")))
    how = {"low_ms": low, "high_ms": 0, "delay_ms": 3000, "at": ("create_ts", "order_ts")}
    return plain(_joined(spark, "payment-join", join, how, paid=data.payment_info(spark, sf), wides=_lines(spark, sf)))


@query(f"select {_doubles(ORDER_FIELDS)} from near")
def stream_order_join(spark, sf):
    reach = {"low_ms": -5 * DAY_MS, "high_ms": 5 * DAY_MS}
    join = lambda orders, lines: wide.order_lines(orders, lines, **reach).select(*map(str.strip, ORDER_FIELDS.split(",")))
    return plain(_joined(spark, "order-join", join, reach | {"delay_ms": 3000}, orders=data.order_info(spark, sf), lines=data.order_detail(spark, sf)))


# sinks


@query(oracle.routes("hbase"))
def sink_dimensions(spark, sf):
    """A stream of changes, split by routes that every batch reads anew, into the last version of a snapshot."""
    routes, root = shared_folder(spark, "routes"), shared_folder(spark, "dimensions")
    spark.createDataFrame(data.ROUTES, schemas.ROUTES).write.parquet(routes)
    upsert = merge_sink(root, ["sink_table", "id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        known = cdc.dimensions(cdc.routed(cdc.valid_changes(cdc.parse_changes(batch)), read_routes(batch.sparkSession, routes)))
        upsert(known.select("sink_table", F.col("data")["id"].alias("id"), "type", "table", "sink_pk", "data", "position"), batch_id)

    finish_batches(_change_stream(spark, sf), write, "dimensions")
    return _as_text(read_merged(spark, root))


def _change_stream(spark, sf) -> DataFrame:
    path = shared_folder(spark, "changes")
    data.changes(spark, sf).write.options(**PACKED).text(path)
    return read_topic(spark, path, place=True)


@query(f"""select sink_table as topic, data as value from ({oracle.routes("kafka")})""")
def sink_topics(spark, sf):
    """Every fact in the topic that its route names."""
    routes, root = spark.createDataFrame(data.ROUTES, schemas.ROUTES), shared_folder(spark, "topics")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_topics(_in_columns(cdc.facts(cdc.routed(cdc.valid_changes(cdc.parse_changes(batch)), routes))), root, batch=("changes", batch_id))

    finish_batches(_change_stream(spark, sf), write, "topics")
    return spark.read.text(root).select(F.col("topic").cast("string").alias("topic"), "value")


@query(oracle.province(DAY_MS))
def sink_table(spark, sf):
    """Statistics by way of a table that takes its columns in order."""
    root = shared_folder(spark, "province-table")
    rows = province_stats(spark, sf)
    table_sink(root, rows.columns)(rows, 0)
    return spark.read.parquet(root).select(*rows.columns)


@query("""select 'start' as part, count(*) as n from logs where is_start union all select 'page', count(*) from pages union all select 'display', count(*) from shown""")
def sink_split(spark, sf):
    """One stream of logs in three outputs."""
    root = shared_folder(spark, "split")
    stream = read_topic(spark, _topic(spark, data.page_log(spark, sf), "logs"), schema=f"{schemas.PAGE_LOG}, event_id bigint")
    parts = {"start": logs.starts, "page": logs.pages, "display": logs.displays}
    finish_batches(stream, split_sink({n: (f, lambda rows, batch_id, n=n: write_topic(rows, f"{root}/part={n}", batch=("logs", batch_id))) for n, f in parts.items()}), "split")
    return spark.read.text(root).groupBy(F.col("part").cast("string").alias("part")).agg(F.count("*").alias("n"))


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from tidewater.plans import flows  # registers more, with what is above

    assert flows
    return FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql is not None}
