"""The provided tables as the jobs' records, and the queries over them, in SQL of another engine."""

from __future__ import annotations

from tidewater.plans.adapters import DAY_MS, ROUTES, SESSION_MS

FORMAT = "'%Y-%m-%d %H:%M:%S'"
_zero = "cast(0 as decimal(16,2))"
_money = lambda c: f"cast({c} as decimal(16,2))"
_text = lambda c: f"strftime({c}, {FORMAT})"

RECORDS = {
    "ev": f"""select event_id, user_id, event_type, cast(json_extract_string(props, '$.k') as bigint) as k, epoch_ns(cast(ts as timestamp_ns)) // 1000000 as ts,
        cast(floor(value) as bigint) as during_time, {_text("ts")} as create_time,
        case event_type when 'click' then 'good_detail' when 'view' then 'good_list' else event_type end as page_id from events""",
    "logs": f"""select event_id, cast(user_id as varchar) as mid, 'v' || user_id % 3 as vc, 'c' || k % 2 as ch, 'a' || user_id % 5 as ar,
        case when event_id % 3 = 0 then '1' else '0' end as is_new, page_id,
        case when ts - lag(ts) over w < {SESSION_MS} then lag(page_id) over w end as last_page_id,
        case event_type when 'view' then 'Blue-' || k % 10 || ' RING' when 'click' then cast(k as varchar) end as item,
        during_time, event_type = 'signup' as is_start, event_type = 'view' as shows, k, ts from ev window w as (partition by user_id order by ts, event_id)""",
    "pages": "select * from logs where not is_start",
    "shown": "select page_id, cast(k + i as varchar) as item, case when i < 2 then 'sku_id' else 'activity_id' end as item_type, ts from pages, (values (0), (1), (2)) n(i) where shows",
    "visits": """select * from (select *, row_number() over (partition by mid, ts // 86400000 order by ts, event_id) as nth from pages where coalesce(last_page_id, '') = '') where nth = 1""",
    "bounced": f"""select * from (select *, lead(ts) over (partition by mid order by ts, event_id) - ts as gap from pages) where coalesce(last_page_id, '') = '' and (gap is null or gap >= {SESSION_MS})""",
    "oi": f"""select o_orderkey as order_id, cast(c_nationkey as bigint) as province_id, o_orderstatus as order_status, o_custkey as user_id, {_money("o_totalprice")} as total_amount,
        {_zero} as activity_reduce_amount, {_zero} as coupon_reduce_amount, {_money("o_totalprice")} as original_total_amount, {_zero} as feight_fee, {_text("o_orderdate")} as create_time,
        strftime(o_orderdate, '%Y-%m-%d') as create_date, epoch_ms(o_orderdate) as order_ts, o_orderdate from orders left join customer on o_custkey = c_custkey""",
    "od": f"""select l_orderkey * 10 + l_linenumber as detail_id, l_orderkey as order_id, l_partkey as sku_id, cast(null as varchar) as sku_name, {_money("l_extendedprice")} as order_price,
        cast(l_quantity as bigint) as sku_num, {_zero} as split_activity_amount, {_zero} as split_coupon_amount, {_money("l_extendedprice")} as split_total_amount, epoch_ms(l_shipdate) as detail_ts from lineitem""",
    "wide": f"select * from oi join od using (order_id) where detail_ts between order_ts and order_ts + {365 * DAY_MS}",
    "near": f"select * from oi join od using (order_id) where detail_ts between order_ts - {5 * DAY_MS} and order_ts + {5 * DAY_MS}",
    "pay": f"""select o_orderkey + 1000000000 as payment_id, o_orderkey as order_id, o_custkey as user_id, {_money("o_totalprice")} as total_amount, 'order ' || o_orderkey as subject,
        o_orderpriority as payment_type, {_text("o_orderdate + interval 2 days")} as payment_create_time, cast(null as varchar) as callback_time, epoch_ms(o_orderdate) + {2 * DAY_MS} as payment_ts
        from orders where o_orderstatus = 'F'""",
    "paid": f"""select p.*, w.* exclude (order_id, user_id, total_amount, create_time, create_date, order_ts, detail_ts, o_orderdate), w.create_time as order_create_time, w.order_ts as wide_ts
        from pay p join wide w using (order_id) where w.order_ts between payment_ts - {30 * DAY_MS} and payment_ts""",
    "users": "select cast(c_custkey as varchar) as id, date '1950-01-01' + cast(c_custkey % 18000 as integer) as birthday, case when c_custkey % 2 = 0 then 'F' else 'M' end as gender from customer where c_custkey % 50 <> 7",
    "provinces": "select cast(n_nationkey as varchar) as id, n_name, r_name, 'CN-' || n_nationkey as iso, 'R' || n_regionkey as iso2 from nation join region on n_regionkey = r_regionkey",
    "skus": "select p_partkey as sku_id, p_name as sku_name, p_partkey % 64 as spu_id, cast(p_size % 6 as bigint) as category3_id, p_partkey % 25 as tm_id, cast(p_retailprice as decimal(16,2)) as sku_price from part",
    "spus": "select p_partkey % 64 as spu_id, min(p_name) as spu_name from part group by 1 having p_partkey % 64 < 60",
    "categories": "select cast(p_size % 6 as bigint) as category3_id, min(p_type) as category3_name from part group by 1",
    "trademarks": "select p_partkey % 25 as tm_id, min(p_brand) as tm_name from part group by 1",
    "facts": f"""select cast(item as bigint) as sku_id, ts as tms, 1 as click_ct, 0 as display_ct, 0 as order_sku_num, 0.00 as order_amount, 0 as favor_ct, 0 as cart_ct, 0.00 as payment_amount, 0.00 as refund_amount,
          0 as comment_ct, 0 as good_comment_ct, null as order_id, null as paid_order_id, null as refund_order_id from pages where page_id = 'good_detail'
        union all select cast(item as bigint), ts, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, null, null, null from shown where item_type = 'sku_id'
        union all select sku_id, order_ts, 0, 0, sku_num, split_total_amount, 0, 0, 0, 0, 0, 0, order_id, null, null from wide
        union all select k, ts // 1000 * 1000, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, null, null, null from ev where event_type = 'signup'
        union all select k, ts // 1000 * 1000, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, null, null, null from ev where event_type = 'purchase'
        union all select sku_id, payment_ts, 0, 0, 0, 0, 0, 0, split_total_amount, 0, 0, 0, null, order_id, null from paid
        union all select l_partkey, epoch_ms(l_shipdate), 0, 0, 0, 0, 0, 0, 0, {_money("l_extendedprice")}, 0, 0, null, null, l_orderkey from lineitem where l_returnflag = 'R'
        union all select k, ts // 1000 * 1000, 0, 0, 0, 0, 0, 0, 0, 0, 1, case when event_id % 2 = 0 then 1 else 0 end, null, null, null from ev where event_type = 'error'""",
    "product": f"""select {{stt}} as stt, {{edt}} as edt, sku_id, cast(sum(display_ct) as bigint) as display_ct, cast(sum(click_ct) as bigint) as click_ct, cast(sum(favor_ct) as bigint) as favor_ct,
        cast(sum(cart_ct) as bigint) as cart_ct, cast(sum(order_sku_num) as bigint) as order_sku_num, cast(sum(order_amount) as double) as order_amount, cast(sum(payment_amount) as double) as payment_amount,
        cast(sum(refund_amount) as double) as refund_amount, cast(sum(comment_ct) as bigint) as comment_ct, cast(sum(good_comment_ct) as bigint) as good_comment_ct, count(distinct order_id) as order_ct,
        count(distinct paid_order_id) as paid_order_ct, count(distinct refund_order_id) as refund_order_ct from facts group by 1, 2, 3""",
    "cdc": """select case when c_custkey % 13 <> 6 then 'customer' end as "table", case c_custkey % 4 when 0 then 'insert' when 1 then 'update' when 2 then 'insert' else 'delete' end as type, cast(c_custkey as varchar) as id,
          case when c_custkey % 11 <> 5 then {'id': cast(c_custkey as varchar), 'c_name': c_name, 'c_mktsegment': c_mktsegment} end is null as empty, c_name as a, c_mktsegment as b, c_custkey % 4 = 0 as boot from customer
        union all select case when o_orderkey % 13 <> 6 then 'orders' end, 'insert', cast(o_orderkey as varchar), o_orderkey % 11 = 5, o_orderstatus, o_orderpriority, false from orders
        union all select case when p_partkey % 13 <> 6 then 'part' end, case when p_partkey % 2 = 0 then 'delete' else 'insert' end, cast(p_partkey as varchar), p_partkey % 11 = 5, p_name, p_brand, false from part""",
    "valid": 'select * from cdc where "table" is not null and not empty',
}


def bucket(at: str, ms: int) -> tuple[str, str]:
    """Start and end, as texts, of the window that epoch milliseconds fall into."""
    return tuple(f"strftime(make_timestamp(({at} // {ms} + {n}) * {ms} * 1000), {FORMAT})" for n in (0, 1))


def sql(query: str, window_ms: int = DAY_MS) -> str:
    stt, edt = bucket("tms", window_ms)
    records = {name: text.replace("{stt}", stt).replace("{edt}", edt) for name, text in RECORDS.items()}
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in records.items()) + f"\n{query}"


def visitor(window_ms: int) -> str:
    stt, edt = bucket("ts", window_ms)
    fact = lambda uv, pv, sv, uj, dur, rows: f"select ts, vc, ch, ar, is_new, {uv} as uv, {pv} as pv, {sv} as sv, {uj} as uj, {dur} as dur from {rows}"
    facts = " union all ".join([
        fact(0, 1, 0, 0, "coalesce(during_time, 0)", "pages"), fact(1, 0, 0, 0, 0, "visits"),
        fact(0, 0, 1, 0, 0, "pages where coalesce(last_page_id, '') = ''"), fact(0, 0, 0, 1, 0, "bounced"),
    ])
    sums = ", ".join(f"cast(sum({a}) as bigint) as {b}" for a, b in (("uv", "uv_ct"), ("pv", "pv_ct"), ("sv", "sv_ct"), ("uj", "uj_ct"), ("dur", "dur_sum")))
    return f"select {stt} as stt, {edt} as edt, vc, ch, ar, is_new, {sums} from ({facts}) group by all"


def province(window_ms: int) -> str:
    stt, edt = bucket("order_ts", window_ms)
    return f"""select {stt} as stt, {edt} as edt, province_id, n_name as province_name, r_name as area_code, iso as iso_code, iso2 as iso_3166_2,
        cast(sum(split_total_amount) as double) as order_amount, count(distinct order_id) as order_count
        from oi join od using (order_id) left join provinces p on cast(province_id as varchar) = p.id group by all"""


def routes(sink: str) -> str:
    """Routed changes as table, type, sink_table, sink_pk and data, a JSON text with its keys in order."""
    rows = []
    names = {"customer": ("c_name", "c_mktsegment"), "orders": ("o_orderstatus", "o_orderpriority"), "part": ("p_name", "p_brand")}
    for source, kind, to, target, columns, pk, _ in ROUTES:
        if to != sink:
            continue
        keys = {k: v for k, v in zip(("id", *names[source]), ("id", "a", "b"), strict=True) if not columns or k in columns.split(",")}
        data = " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in keys.items())
        rows.append(f"""select "table", type, '{target}' as sink_table, '{pk or "id"}' as sink_pk, '{{' || {data} || '}}' as data from valid where "table" = '{source}' and type = '{kind}'""")
    return " union all ".join(rows)
