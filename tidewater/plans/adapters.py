"""The provided tables as the records that the jobs work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.neighbours import with_neighbour

MONEY = "decimal(16,2)"
DAY_MS = 86_400_000
#: A visitor's pages less than so far apart belong to one session.
SESSION_MS = 21_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def _text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), _millis("ts").alias("ts"),
        F.floor("value").cast("long").alias("during_time"), _text("ts").alias("create_time"),
    )


def page_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per event, with event_id; sign-ups are starts, views show two products, clicks open one."""
    page_id = F.expr("case event_type when 'click' then 'good_detail' when 'view' then 'good_list' else event_type end")
    rows = with_neighbour(events(spark, sf_dir).withColumn("page_id", page_id), "user_id", "ts", SESSION_MS, tie=["event_id"], take=["page_id"], after=False, name="last")
    item = F.expr("case event_type when 'view' then concat('Blue-', k % 10, ' RING') when 'click' then cast(k as string) end")
    shown = F.array(*[F.struct((F.col("k") + i).cast("string").alias("item"), F.lit(kind).alias("item_type")) for i, kind in ((0, "sku_id"), (1, "sku_id"), (2, "activity_id"))])
    return rows.select(
        F.struct(
            F.col("user_id").cast("string").alias("mid"), F.expr("concat('v', user_id % 3)").alias("vc"), F.expr("concat('c', k % 2)").alias("ch"),
            F.expr("concat('a', user_id % 5)").alias("ar"), F.expr("if(event_id % 3 = 0, '1', '0')").alias("is_new"),
        ).alias("common"),
        F.struct("page_id", F.col("last.page_id").alias("last_page_id"), item.alias("item"), "during_time").alias("page"),
        F.expr("if(event_type = 'signup', map('entry', 'icon'), null)").alias("start"),
        F.when(F.col("event_type") == "view", shown).alias("displays"),
        "ts", "event_id",
    )


def order_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("province_id"))
    zero = F.lit(0).cast(MONEY)
    return table(spark, sf_dir, "orders").join(home, "o_custkey", "left").select(
        F.col("o_orderkey").alias("id"), "province_id", F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"), zero.alias("activity_reduce_amount"), zero.alias("coupon_reduce_amount"),
        F.col("o_totalprice").cast(MONEY).alias("original_total_amount"), zero.alias("feight_fee"), _text("o_orderdate").alias("create_time"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("create_date"), _millis("o_orderdate").alias("create_ts"),
    )


def order_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"),
        price.alias("order_price"), F.col("l_quantity").cast("long").alias("sku_num"), F.lit(None).cast("string").alias("sku_name"),
        price.alias("split_total_amount"), zero.alias("split_activity_amount"), zero.alias("split_coupon_amount"), _millis("l_shipdate").alias("create_ts"),
    )


def payment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are paid two days after they were placed."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"), F.concat(F.lit("order "), "o_orderkey").alias("subject"), F.col("o_orderpriority").alias("payment_type"),
        F.date_format(F.expr("o_orderdate + interval 2 days"), "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.lit(None).cast("string").alias("callback_time"),
        (_millis("o_orderdate") + 2 * DAY_MS).alias("create_ts"),
    )


def refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"), F.col("l_extendedprice").cast(MONEY).alias("refund_amount"), _text("l_shipdate").alias("create_time")
    )


def actions(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Favourites, carts or comments: events of one kind about product k."""
    appraise = F.expr("if(event_id % 2 = 0, '1201', '1202')")
    return events(spark, sf_dir).where(F.col("event_type") == kind).select(F.col("k").alias("sku_id"), "create_time", appraise.alias("appraise"))


def dimension(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """user, province, sku, spu, category or trademark; all columns are texts. Some standard products and users are missing, as in life."""
    text = lambda e, name: F.expr(f"cast({e} as string)").alias(name)
    if name == "user":
        return table(spark, sf_dir, "customer").where("c_custkey % 50 <> 7").select(
            text("c_custkey", "id"), F.expr("cast(date_add(date'1950-01-01', cast(c_custkey % 18000 as int)) as string)").alias("BIRTHDAY"), F.expr("if(c_custkey % 2 = 0, 'F', 'M')").alias("GENDER")
        )
    if name == "province":
        nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return nation.select(
            text("n_nationkey", "id"), F.col("n_name").alias("NAME"), F.col("r_name").alias("AREA_CODE"), F.concat(F.lit("CN-"), "n_nationkey").alias("ISO_CODE"),
            F.concat(F.lit("R"), "n_regionkey").alias("ISO_3166_2"),
        )
    part = table(spark, sf_dir, "part")
    if name == "sku":
        return part.select(
            text("p_partkey", "id"), F.col("p_name").alias("SKU_NAME"), text("p_partkey % 64", "SPU_ID"), text("p_size % 6", "CATEGORY3_ID"), text("p_partkey % 25", "TM_ID"),
            F.col("p_retailprice").cast(MONEY).cast("string").alias("PRICE"),
        )
    key, column, named = {"spu": ("p_partkey % 64", "p_name", "SPU_NAME"), "category": ("p_size % 6", "p_type", "NAME"), "trademark": ("p_partkey % 25", "p_brand", "TM_NAME")}[name]
    groups = part.groupBy(text(key, "id")).agg(F.min(column).alias(named))
    return groups.where("cast(id as int) < 60") if name == "spu" else groups


def dimensions(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The named dimensions, or all six; what isn't named isn't opened."""
    return {n: dimension(spark, sf_dir, n) for n in names or ("user", "province", "sku", "spu", "category", "trademark")}


#: Columns of the tables that changes are recorded of, after their ids.
CHANGED = {"customer": ["id", "c_name", "c_mktsegment"], "orders": ["id", "o_orderstatus", "o_orderpriority"], "part": ["id", "p_name", "p_brand"]}


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records as JSON text: customers inserted and updated, orders inserted, parts deleted; some are broken."""
    kinds = {
        "customer": ("c_custkey", "case c_custkey % 4 when 0 then 'bootstrap-insert' when 1 then 'update' when 2 then 'insert' else 'delete' end"),
        "orders": ("o_orderkey", "'insert'"),
        "part": ("p_partkey", "if(p_partkey % 2 = 0, 'delete', 'insert')"),
    }
    parts = []
    for name, (key, kind) in kinds.items():
        data = F.when(F.col(key) % 11 != 5, F.struct(F.col(key).cast("string").alias("id"), *CHANGED[name][1:]))
        envelope = F.struct(F.when(F.col(key) % 13 != 6, F.lit(name)).alias("table"), F.expr(kind).alias("type"), data.alias("data"))
        parts.append(table(spark, sf_dir, name).select(F.to_json(envelope).alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: source_table, operate_type, sink_type, sink_table, sink_columns, sink_pk, sink_extend
ROUTES = [
    ("customer", "insert", "hbase", "DIM_USER", "id,c_name", None, None),
    ("customer", "update", "hbase", "DIM_USER", "id,c_mktsegment", "id", None),
    ("orders", "insert", "kafka", "dwd_order", "id,o_orderstatus, o_orderpriority", None, None),
    ("part", "insert", "clickhouse", "stats", "", None, None),
    ("part", "delete", "kafka", "dwd_part", None, None, None),
]
