"""Windowed statistics of visitors, products, provinces and keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.times import bounds, epoch_date, text_millis, timestamp, whole_second
from tidewater.functions.words import action_rows, tokens
from tidewater.operators.logs import entry_page
from tidewater.operators.visits import BOUNCE_MS, with_bounces
from tidewater.operators.wide import with_category, with_sku, with_spu, with_trademark

WINDOW = "10 seconds"
GOOD = "1201"
MONEY = "decimal(16,2)"

VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]
VISITOR_SUMS = ["uv_ct", "pv_ct", "sv_ct", "uj_ct", "dur_sum"]
#: Measures of a product fact and their types; the three ids are counted, not summed.
PRODUCT_SUMS = {
    "display_ct": "long", "click_ct": "long", "favor_ct": "long", "cart_ct": "long", "order_sku_num": "long", "order_amount": MONEY,
    "payment_amount": MONEY, "refund_amount": MONEY, "comment_ct": "long", "good_comment_ct": "long",
}
PRODUCT_IDS = {"order_id": "order_ct", "paid_order_id": "paid_order_ct", "refund_order_id": "refund_order_ct"}


def _page_measures() -> dict[str, Column]:
    return {"pv_ct": F.lit(1), "dur_sum": F.coalesce("page.during_time", F.lit(0)), "sv_ct": entry_page().cast("long")}


def _visitor_fact(rows: DataFrame, **measures: Column) -> DataFrame:
    return rows.select(*[F.col(f"common.{k}").alias(k) for k in VISITOR_KEYS], *[measures.get(m, F.lit(0)).cast("long").alias(m) for m in VISITOR_SUMS], timestamp(F.col("ts")).alias("at"))


def visitor_facts(pages: DataFrame, uniques: DataFrame, jumps: DataFrame) -> DataFrame:
    """One row per page view, with its session start, and per unique visit and bounce; null durations count 0."""
    return reduce(DataFrame.unionByName, [_visitor_fact(pages, **_page_measures()), _visitor_fact(uniques, uv_ct=F.lit(1)), _visitor_fact(jumps, uj_ct=F.lit(1))])


def visitor_facts_of(pages: DataFrame, *, window: str = WINDOW, timeout_ms: int = BOUNCE_MS, tie: list[str] = (), zone: str | None = None) -> DataFrame:
    """visitor_facts() of a batch, summed by visitor, day and window; unique visits and bounces are found here, in one pass.

    A visitor's first entry page of a day is the least of the group's least ones: what meets in one task is a visitor's groups
    of a day, whose number the windows bound, not the visitor's pages. ``at`` is the window's start.
    """
    marked = with_bounces(pages, timeout_ms=timeout_ms, tie=tie)
    entry = F.when(entry_page(), F.struct(F.col("ts"), *tie))
    rows = marked.select(
        F.col("common.mid").alias("_mid"), epoch_date(F.col("ts"), zone).alias("_day"), F.window(timestamp(F.col("ts")), window)["start"].alias("at"), *[F.col(f"common.{k}").alias(k) for k in VISITOR_KEYS],
        entry.alias("_entry"), *[m.cast("long").alias(n) for n, m in (_page_measures() | {"uj_ct": F.col("bounced")}).items()],
    )
    summed = [m for m in VISITOR_SUMS if m != "uv_ct"]
    groups = rows.groupBy("_mid", "_day", "at", *VISITOR_KEYS).agg(F.min("_entry").alias("_entry"), *[F.sum(m).alias(m) for m in summed])
    nth = F.row_number().over(Window.partitionBy("_mid", "_day").orderBy(F.col("_entry").asc_nulls_last(), "at", *VISITOR_KEYS))
    first = ((nth == 1) & F.col("_entry").isNotNull()).cast("long")
    return groups.select(*VISITOR_KEYS, first.alias("uv_ct"), *summed, "at")


def visitor_stats(facts: DataFrame, *, window: str = WINDOW) -> DataFrame:
    """stt, edt, the four keys and five sums of every window. A stream's facts need a watermark on ``at``."""
    sums = facts.groupBy(F.window("at", window), *VISITOR_KEYS).agg(*[F.sum(m).alias(m) for m in VISITOR_SUMS])
    return sums.select(*bounds(), *VISITOR_KEYS, *VISITOR_SUMS)


def product_facts(
    clicks: DataFrame | None = None, displays: DataFrame | None = None, orders: DataFrame | None = None, favors: DataFrame | None = None, carts: DataFrame | None = None,
    payments: DataFrame | None = None, refunds: DataFrame | None = None, comments: DataFrame | None = None, *, zone: str | None = None,
) -> DataFrame:
    """One row per click, display, order line, favourite, cart, paid line, refund and comment of a product.

    clicks and displays are pages; where both are the same, they are read once. What is left out is not read: its
    measures are zero.
    """

    def fact(rows: DataFrame, at: Column, **measures: Column) -> DataFrame:
        return rows.select(
            F.col("sku_id").cast("long").alias("sku_id"), timestamp(at).alias("at"),
            *[F.coalesce(measures.get(m, F.lit(0)), F.lit(0)).cast(t).alias(m) for m, t in PRODUCT_SUMS.items()],
            *[measures.get(i, F.lit(None)).cast("long").alias(i) for i in PRODUCT_IDS],
        )

    one, created = F.lit(1), text_millis(F.col("create_time"), zone)
    facts = []
    if clicks is not None and clicks is displays:
        item = lambda name, click: F.struct(name.try_cast("long").alias("sku_id"), F.lit(click).alias("click"))
        clicked = F.when(F.col("page.page_id") == "good_detail", F.array(item(F.col("page.item"), 1))).otherwise(F.array())
        shown = F.transform(F.filter(F.coalesce("displays", F.array()), lambda d: d["item_type"] == "sku_id"), lambda d: item(d["item"], 0))
        seen = clicks.select(F.explode(F.concat(clicked, shown)).alias("i"), "ts").select("i.*", "ts")
        facts.append(fact(seen, F.col("ts"), click_ct=F.col("click"), display_ct=1 - F.col("click")))
        clicks = displays = None
    if clicks is not None:
        clicked = clicks.where("page.page_id = 'good_detail'").select(F.col("page.item").try_cast("long").alias("sku_id"), "ts")
        facts.append(fact(clicked, F.col("ts"), click_ct=one))
    if displays is not None:
        shown = displays.select(F.explode("displays").alias("d"), "ts").where("d.item_type = 'sku_id'").select(F.col("d.item").try_cast("long").alias("sku_id"), "ts")
        facts.append(fact(shown, F.col("ts"), display_ct=one))
    if orders is not None:
        facts.append(fact(orders, created, order_sku_num=F.col("sku_num"), order_amount=F.col("split_total_amount"), order_id=F.col("order_id")))
    if favors is not None:
        facts.append(fact(favors, created, favor_ct=one))
    if carts is not None:
        facts.append(fact(carts, created, cart_ct=one))
    if payments is not None:
        facts.append(fact(payments, text_millis(F.col("payment_create_time"), zone), payment_amount=F.col("split_total_amount"), paid_order_id=F.col("order_id")))
    if refunds is not None:
        facts.append(fact(refunds, created, refund_amount=F.col("refund_amount"), refund_order_id=F.col("order_id")))
    if comments is not None:
        facts.append(fact(comments, created, comment_ct=one, good_comment_ct=(F.col("appraise") == GOOD).cast("long")))
    return reduce(DataFrame.unionByName, facts)


def _same_window(sums: DataFrame, window: str) -> Column:
    """The key by which sums of a window are summed once more; on a stream it has to be an event time again."""
    return F.window(F.window_time("window"), window).alias("window") if sums.isStreaming else F.col("window")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """A batch's rows dealt by keys into the cluster's number of shuffle partitions, which then aren't put together.

    Where nearly every row is a group of its own, sums taken before a shuffle hold a whole split in memory for nothing, and those
    after it as much as fits the advisory size of a partition, which packed rows exceed by far once they are groups.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def product_sums(facts: DataFrame, *, window: str = WINDOW) -> DataFrame:
    """stt, edt, sku_id, sums and distinct order counts of every window.

    A fact carries one id at most. Sums are first taken per id, so that distinct ids are counted by adding up ones: no
    row is multiplied for three distinct counts, a hot product is spread over its orders, and a stream's state holds a row
    per order of an open window. A batch's facts are dealt before they are summed.
    """
    at, ids = F.window("at", window).alias("window"), ["sku_id", *PRODUCT_IDS]
    rows = facts if facts.isStreaming else _dealt(facts.select(at, *ids, *PRODUCT_SUMS), "window", *ids)
    each = rows.groupBy(at if facts.isStreaming else "window", *ids).agg(*[F.sum(m).alias(m) for m in PRODUCT_SUMS])
    each = each if facts.isStreaming else _dealt(each, "window", "sku_id")
    sums = each.groupBy(_same_window(each, window), "sku_id").agg(
        *[F.sum(m).cast("decimal(26,2)" if t == MONEY else t).alias(m) for m, t in PRODUCT_SUMS.items()],
        *[F.count(i).alias(n) for i, n in PRODUCT_IDS.items()],
    )
    return sums.select(*bounds(), "sku_id", *PRODUCT_SUMS, *PRODUCT_IDS.values())


def product_stats(facts: DataFrame, dims: dict[str, DataFrame], *, window: str = WINDOW) -> DataFrame:
    """product_sums() with the names of product, standard product, category and trademark, looked up after summing."""
    named = with_spu(with_sku(product_sums(facts, window=window), dims["sku"], price=True), dims["spu"])
    return with_trademark(with_category(named, dims["category"]), dims["trademark"])


def province_stats(wides: DataFrame, *, window: str = WINDOW) -> DataFrame:
    """Orders and amounts of every window and province. wides has order_id, split_total_amount, at and the province."""
    names = {"province_id": "province_id", "province_name": "province_name", "area_code": "province_area_code", "iso_code": "province_iso_code", "iso_3166_2": "province_3166_2_code"}
    keys = [F.window("at", window).alias("window"), *[F.col(c).alias(n) for n, c in names.items()]]
    each = wides.groupBy(*keys, "order_id").agg(F.sum("split_total_amount").alias("order_amount"))
    sums = each.groupBy(_same_window(each, window), *names).agg(F.sum("order_amount").alias("order_amount"), F.count("order_id").alias("order_count"))
    return sums.select(*bounds(), *names, F.col("order_amount").cast("decimal(26,2)").alias("order_amount"), "order_count")


def province_sums_chained(wides: DataFrame, *, window: str = WINDOW, line: tuple[str, ...] = ("detail_id",)) -> DataFrame:
    """stt, edt, province_id, order_amount and order_count of a stream of wide orders with event time order_at.

    Lines that came twice within the watermark, as the columns in ``line`` tell, count once. Orders are summed per window first, and windows from these
    sums, so that state holds a row per order of an open window instead of one set of all its orders.
    """
    once = wides.dropDuplicatesWithinWatermark(list(line))
    each = once.groupBy(F.window("order_at", window).alias("window"), "province_id", "order_id").agg(F.sum("split_total_amount").alias("order_amount"))
    sums = each.groupBy(_same_window(each, window), "province_id").agg(F.sum("order_amount").alias("order_amount"), F.count("order_id").alias("order_count"))
    return sums.select(*bounds(), "province_id", F.col("order_amount").cast("decimal(26,2)").alias("order_amount"), "order_count")


def search_words(pages: DataFrame) -> DataFrame:
    """keyword and at (whole seconds) of every token that a page of search results was asked for."""
    asked = pages.where("page.page_id = 'good_list' and page.item is not null")
    return asked.select(F.explode(tokens(F.col("page.item"))).alias("keyword"), whole_second(F.col("ts")).alias("at"))


def keyword_stats(words: DataFrame, *, window: str = WINDOW, source: str = "SEARCH") -> DataFrame:
    sums = words.groupBy(F.window("at", window), "keyword").agg(F.count("*").alias("ct"))
    return sums.select("keyword", "ct", F.lit(source).alias("source"), *bounds())


def product_keywords(stats: DataFrame) -> DataFrame:
    """Every token of a product's name with each of its positive counts of clicks, carts and orders."""
    words = stats.select("stt", "edt", "spu_name", F.explode(action_rows(F.col("click_ct"), F.col("cart_ct"), F.col("order_ct"))).alias("a"))
    return words.select(F.explode(tokens(F.col("spu_name"))).alias("keyword"), "a.ct", "a.source", "stt", "edt")
