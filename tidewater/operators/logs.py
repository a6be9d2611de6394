"""Behaviour logs: repair of the new-visitor flag, and the split into starts, pages and displays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.times import epoch_date


def entry_page() -> Column:
    """A page that no other page led to."""
    return F.coalesce(F.col("page.last_page_id"), F.lit("")) == ""


def repair_new_visitors(logs: DataFrame, *, order: tuple[str, ...] = ("ts",), zone: str | None = None) -> DataFrame:
    """logs with common.is_new set to 0 where a visitor's first claim to be new is of another day.

    Only rows with is_new = 1 count as claims, in the order given; other rows pass untouched. The first claim of a
    visitor is one aggregated row, so a visitor with very many rows is joined, not gathered.
    """
    day = epoch_date(F.col("ts"), zone)
    claims = logs.where("common.is_new = '1' and common.mid is not null")
    first = claims.groupBy(F.col("common.mid").alias("_mid")).agg(F.min_by(day, F.struct(*order)).alias("_first"))
    joined = logs.join(first, F.col("common.mid") == F.col("_mid"), "left")
    late = (F.col("common.is_new") == "1") & (F.col("_first") != day)
    flag = F.when(late, F.lit("0")).otherwise(F.col("common.is_new"))
    return joined.withColumn("common", F.col("common").withField("is_new", flag)).drop("_mid", "_first")


def is_start() -> Column:
    return F.col("start").isNotNull() & (F.size("start") > 0)


def starts(logs: DataFrame) -> DataFrame:
    """Logs of an application's start: those whose map ``start`` is not empty."""
    return logs.where(is_start())


def pages(logs: DataFrame) -> DataFrame:
    """All logs but starts, those with displays included."""
    return logs.where(~is_start())


def displays(logs: DataFrame) -> DataFrame:
    """One row per display of a page log, with the page's id; nothing else of the page comes along."""
    shown = pages(logs).select(F.col("page.page_id").alias("page_id"), F.explode("displays").alias("d"))
    return shown.select("d.*", "page_id")
