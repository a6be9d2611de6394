"""Unique visitors of a day, and bounces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.times import epoch_date
from tidewater.operators.logs import entry_page
from tidewater.operators.neighbours import with_neighbour
from tidewater.operators.patterns import Pattern
from tidewater.session import written

#: Milliseconds after which an entry page without a further page counts as a bounce.
BOUNCE_MS = 10_000


def unique_visits(pages: DataFrame, *, order: list[str] | None = None, tie: list[str] = (), zone: str | None = None, ranges: int | None = None) -> DataFrame:
    """Entry pages whose day differs from that of the visitor's entry page before it.

    In order of ts and ``tie`` (the default) that is the first entry page of every visitor and day, a minimum that
    needs no visitor's rows in one task. ``order`` names columns of another order, say of arrival, in which a day may
    come again and its page with it; entry pages are then written once, in ``ranges`` of that order.
    """
    entries = pages.where(entry_page()).withColumn("_day", epoch_date(F.col("ts"), zone))
    if order is None:
        row = F.struct(*[F.col(c) for c in pages.columns])
        first = entries.groupBy(F.col("common.mid").alias("_mid"), "_day").agg(F.min_by(row, F.struct("ts", *tie)).alias("_row"))
        return first.select("_row.*")
    return _changes_of_day(entries, order, ranges).select(*pages.columns)


def _changes_of_day(entries: DataFrame, order: list[str], ranges: int | None) -> DataFrame:
    """Entries whose _day differs from that of the visitor's entry before, in any order; a first entry differs.

    Rows of all visitors are dealt into ranges of the order, so that one with a third of all rows is spread over
    them. Inside a range the row before is a neighbour; the first row of a visitor in a range looks up the visitor's
    last day in an earlier range, from a table of one row per visitor and range.

    The bounds of ranges come from a sample, and small ranges may be put together while a query runs. Both readers have
    to see the same ranges, so rows are written with the number of the range that they fell into.
    """
    dealt = entries.repartitionByRange(*order) if ranges is None else entries.repartitionByRange(ranges, *order)
    ranged = written(dealt.withColumn("_range", F.spark_partition_id()), "arrivals")
    inside = Window.partitionBy("common.mid", "_range").orderBy(*order)
    dealt = ranged.withColumn("_before", F.lag("_day").over(inside)).withColumn("_nth", F.row_number().over(inside))
    lasts = ranged.groupBy(F.col("common.mid").alias("_mid"), F.col("_range").alias("_end")).agg(F.max_by("_day", F.struct(*order)).alias("_last"))
    earlier = lasts.select("_mid", F.col("_end").alias("_in"), F.lag("_last").over(Window.partitionBy("_mid").orderBy("_end")).alias("_carried"))
    met = dealt.join(earlier, F.col("common.mid").eqNullSafe(F.col("_mid")) & (F.col("_range") == F.col("_in")), "left")
    before = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return met.where(~F.col("_day").eqNullSafe(before))


def bounce_pattern(timeout_ms: int = BOUNCE_MS) -> Pattern:
    """Bounces are the timeouts of an entry page and any page right after it."""
    return Pattern("entry", "coalesce(page.last_page_id, '') = ''").next("second", "true").within(timeout_ms)


def with_bounces(pages: DataFrame, *, timeout_ms: int = BOUNCE_MS, tie: list[str] = ()) -> DataFrame:
    """pages with ``bounced``: an entry page that no other page of the visitor follows in under ``timeout_ms``."""
    rows = with_neighbour(pages.withColumn("_mid", F.col("common.mid")), "_mid", "ts", timeout_ms, tie=list(tie))
    return rows.select(*pages.columns, (entry_page() & F.col("near").isNull()).alias("bounced"))


def bounces(pages: DataFrame, *, timeout_ms: int = BOUNCE_MS, tie: list[str] = ()) -> DataFrame:
    """Entry pages that no other page of the visitor follows in under ``timeout_ms``; exactly that late is too late.

    Any page that follows in time prevents a bounce, also one without page_id.
    """
    return with_bounces(pages, timeout_ms=timeout_ms, tie=tie).where("bounced").select(*pages.columns)
