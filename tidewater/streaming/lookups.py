"""Dimension lookups on streams: snapshots are resolved anew for every batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.snapshots import merge_sink, read_merged, versions

Dimensions = dict[str, DataFrame]


def put_dimension(root: str, rows: DataFrame, *, kind: str = "insert", key: str = "id", at: Column | None = None) -> int:
    """Merges whole rows, keyed by ``key``, into the dimension in ``root``; gives the new version."""
    known = versions(rows.sparkSession, root)
    entries = [x for c in rows.columns if c != key for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    changes = rows.select(F.col(key).cast("string").alias("id"), F.lit(kind).alias("type"), F.create_map(*entries).alias("data"), (F.lit(0) if at is None else at).alias("position"))
    version = known[-1] + 1 if known else 0
    merge_sink(root, ["id"], apply_deletes=True)(changes, version)
    return version


def read_dimension(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """id and the named columns, as texts, of the dimension's last version."""
    return read_merged(spark, root).select("id", *[F.col("data")[c].alias(c) for c in columns])


def looked_up(resolve: Callable[[SparkSession], Dimensions], join: Callable[[DataFrame, Dimensions], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: joins every batch with the dimensions as they are when it begins, and passes it on.

    A join in the stream's own plan would keep the files that it found when the stream was started.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sink(join(batch, resolve(batch.sparkSession)), batch_id)

    return write
