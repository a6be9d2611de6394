"""Wide orders and payments: interval joins and dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.times import age, text_millis

#: An order and its lines stand at most so many milliseconds apart, a payment at most so many after its order.
ORDER_MS = 5
PAYMENT_MS = 1_800_000

ORDER_COLUMNS = [
    "order_status", "create_time", "create_date", "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount",
    "feight_fee", "total_amount", "province_id", "user_id",
]
LINE_COLUMNS = ["sku_id", "sku_name", "order_price", "sku_num", "split_activity_amount", "split_coupon_amount", "split_total_amount"]
#: Columns of a wide order that nothing sets.
UNSET = {"expire_time": "string", "operate_time": "string", "create_hour": "string", "split_feight_fee": "decimal(16,2)"}
LOOKED_UP = [
    "user_age", "user_gender", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code",
    "spu_id", "category3_id", "tm_id", "spu_name", "category3_name", "tm_name",
]


def interval_join(left: DataFrame, right: DataFrame, key: Column, left_at: str, right_at: str, low_ms: int, high_ms: int, times: tuple[str, str] | None = None) -> DataFrame:
    """Pairs of rows that ``key`` matches and where right_at lies in [left_at + low_ms, left_at + high_ms].

    On streams, ``times`` names the event times of both sides that watermarks are set on; the join then forgets rows that
    nothing can match any more, and says how far it is to what follows it.

    All columns of both sides, whose names must differ. On batches, times also fall into buckets as wide as the
    interval, which join the equality: each left row meets two buckets at most, and a hot key is spread over time.
    """
    within = F.col(right_at).between(F.col(left_at) + low_ms, F.col(left_at) + high_ms)
    if left.isStreaming or right.isStreaming:
        if times is not None:
            first, second = times
            within = F.expr(f"`{second}` between `{first}` + interval '{low_ms}' milliseconds and `{first}` + interval '{high_ms}' milliseconds")
        return left.join(right, key & within)
    width = max(high_ms - low_ms, 1)
    bucket = lambda at: F.floor(at / F.lit(width))
    met = left.withColumn("_left_bucket", F.explode(F.sequence(bucket(F.col(left_at) + low_ms), bucket(F.col(left_at) + high_ms))))
    dealt = right.withColumn("_right_bucket", bucket(F.col(right_at)))
    return met.join(dealt, key & (F.col("_left_bucket") == F.col("_right_bucket")) & within).drop("_left_bucket", "_right_bucket")


def order_lines(orders: DataFrame, lines: DataFrame, *, low_ms: int = -ORDER_MS, high_ms: int = ORDER_MS, delay: str | None = None) -> DataFrame:
    """Wide orders without dimensions: every line with its order, where create_ts of both are close enough.

    Streams with a ``delay`` get watermarks so far behind; then order_at, the order's time, is the event time of the result.
    """
    o = orders.select(F.col("id").alias("order_id"), *ORDER_COLUMNS, F.col("create_ts").alias("order_ts"))
    d = lines.select(F.col("id").alias("detail_id"), F.col("order_id").alias("_order_id"), *LINE_COLUMNS, F.col("create_ts").alias("detail_ts"))
    times = None
    if delay is not None:
        o = o.withColumn("order_at", F.timestamp_millis("order_ts")).withWatermark("order_at", delay)
        d = d.withColumn("_detail_at", F.timestamp_millis("detail_ts")).withWatermark("_detail_at", delay)
        times = ("order_at", "_detail_at")
    joined = interval_join(o, d, F.col("order_id") == F.col("_order_id"), "order_ts", "detail_ts", low_ms, high_ms, times).drop("_detail_at")
    return joined.drop("_order_id").withColumns({c: F.lit(None).cast(t) for c, t in UNSET.items()})


def lookup(rows: DataFrame, dimension: DataFrame, key: str | list[str], mapping: dict[str, str], *, on: str | list[str] = "id") -> DataFrame:
    """rows with columns of a dimension under the names in mapping; rows that it lacks, or without key, keep nulls.

    ``key`` and ``on`` name one column each, or as many. Dimensions hold texts, so keys meet as texts. How it joins is
    left to the optimizer, which knows the sizes.
    """
    keys, ons = ([x] if isinstance(x, str) else x for x in (key, on))
    names = [f"_dim_key_{n}" for n in range(len(ons))]
    named = dimension.select(*[F.col(c).cast("string").alias(n) for c, n in zip(ons, names, strict=True)], *[F.col(c).alias(name) for c, name in mapping.items()])
    same = [F.col(k).cast("string") == F.col(n) for k, n in zip(keys, names, strict=True)]
    return rows.join(named, same, "left").drop(*names)


def with_user(rows: DataFrame, users: DataFrame, now_ms: Column) -> DataFrame:
    """Adds user_age, in whole years of 365 days, and user_gender."""
    found = lookup(rows, users, "user_id", {"BIRTHDAY": "_birthday", "GENDER": "user_gender"})
    born = text_millis(F.concat(F.substring("_birthday", 1, 10), F.lit(" 00:00:00")))
    return found.withColumn("user_age", age(born, now_ms)).drop("_birthday")


def with_province(rows: DataFrame, provinces: DataFrame) -> DataFrame:
    names = {"NAME": "province_name", "AREA_CODE": "province_area_code", "ISO_CODE": "province_iso_code", "ISO_3166_2": "province_3166_2_code"}
    return lookup(rows, provinces, "province_id", names)


def with_sku(rows: DataFrame, skus: DataFrame, *, price: bool = False) -> DataFrame:
    """Adds or replaces sku_name, spu_id, category3_id and tm_id, and with ``price`` sku_price."""
    names = {"SKU_NAME": "sku_name", "SPU_ID": "spu_id", "CATEGORY3_ID": "category3_id", "TM_ID": "tm_id"} | ({"PRICE": "sku_price"} if price else {})
    found = lookup(rows.drop(*names.values()), skus, "sku_id", names)
    ids = {c: F.col(c).try_cast("long") for c in ("spu_id", "category3_id", "tm_id")}
    return found.withColumns(ids | ({"sku_price": F.col("sku_price").try_cast("decimal(16,2)")} if price else {}))


def with_spu(rows: DataFrame, spus: DataFrame) -> DataFrame:
    return lookup(rows, spus, "spu_id", {"SPU_NAME": "spu_name"})


def with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    return lookup(rows, categories, "category3_id", {"NAME": "category3_name"})


def with_trademark(rows: DataFrame, trademarks: DataFrame) -> DataFrame:
    return lookup(rows, trademarks, "tm_id", {"TM_NAME": "tm_name"})


def order_wide(lines: DataFrame, dims: dict[str, DataFrame], now_ms: Column) -> DataFrame:
    """order_lines() with all six dimensions: user, province, sku, spu, category and trademark."""
    rows = with_province(with_user(lines, dims["user"], now_ms), dims["province"])
    rows = with_spu(with_sku(rows, dims["sku"]), dims["spu"])
    return with_trademark(with_category(rows, dims["category"]), dims["trademark"])


def payment_wide(payments: DataFrame, wides: DataFrame, *, low_ms: int = -PAYMENT_MS, high_ms: int = 0) -> DataFrame:
    """Every wide order line with its payment, at most half an hour after the order.

    Columns that both have (order_id, user_id, total_amount) are the payment's, also where they are null; the
    order's create_time becomes order_create_time.
    """
    shared = ["order_id", "user_id", "total_amount", "create_time"]
    dropped = [*shared, "expire_time", "operate_time", "create_date", "create_hour", "order_ts", "detail_ts"]
    p = payments.select(
        F.col("id").alias("payment_id"), "subject", "payment_type", F.col("create_time").alias("payment_create_time"), "callback_time",
        "order_id", "user_id", "total_amount", F.col("create_ts").alias("payment_ts"),
    )
    w = wides.select(
        F.col("order_id").alias("_order_id"), F.col("create_time").alias("order_create_time"), F.col("order_ts").alias("wide_ts"),
        *[c for c in wides.columns if c not in dropped],
    )
    joined = interval_join(p, w, F.col("order_id") == F.col("_order_id"), "payment_ts", "wide_ts", low_ms, high_ms)
    return joined.drop("_order_id")


def first_known(left: Column, right: Column) -> Column:
    """The first that is not null."""
    return F.coalesce(left, right)
