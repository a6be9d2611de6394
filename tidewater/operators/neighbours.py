"""The row before or after another one of the same key, if it is near enough in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_neighbour(rows: DataFrame, key: str, at: str, within: int, *, tie: list[str], take: list[str] = (), after: bool = True, name: str = "near") -> DataFrame:
    """rows and ``name``: the adjacent row (a struct of at, tie and take) of the same key in order of at and tie, less
    than ``within`` away; else null. Rows without key or time have no neighbour and are none.

    Time falls into buckets as wide as ``within``, so that the neighbour stands in a row's own bucket or is the
    outermost row of the next. Rows are dealt by key and bucket: a key with a third of all rows meets in no one task.
    """
    step = 1 if after else -1
    item = F.struct(*[F.col(c) for c in (at, *tie, *take)])
    dealt = rows.withColumn("_key", F.when(F.col(at).isNotNull(), F.col(key))).withColumn("_bucket", F.floor(F.col(at) / F.lit(within)))
    known = F.col("_key").isNotNull()
    order = [F.col(c).asc() if after else F.col(c).desc() for c in (at, *tie)]
    inside = F.lead(item).over(Window.partitionBy("_key", "_bucket").orderBy(*order))
    outermost = (F.min if after else F.max)(item)
    ends = dealt.where(known).groupBy(F.col("_key").alias("_end_key"), (F.col("_bucket") - step).alias("_end_bucket")).agg(outermost.alias("_end"))
    paired = dealt.withColumn("_inside", F.when(known, inside)).join(
        ends, (F.col("_key") == F.col("_end_key")) & (F.col("_bucket") == F.col("_end_bucket")), "left"
    )
    found = F.coalesce("_inside", "_end")
    gap = F.abs(found[at] - F.col(at))
    return paired.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(gap < within, found).alias(name))
