"""Tables: routing configuration, dimensions, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tidewater import schemas
from tidewater.operators.cdc import latest, upserted


def read_table(spark: SparkSession, location: str, *, url: str | None = None, **options: str) -> DataFrame:
    """A table of a database, if it has a url, or of Parquet files. Credentials come from the caller's options."""
    return spark.read.jdbc(url, location, properties=options) if url else spark.read.parquet(location)


def read_routes(spark: SparkSession, location: str, **options: str) -> DataFrame:
    """The routing configuration; read anew for every batch, so that changes take effect."""
    names = [c.split()[0] for c in schemas.ROUTES.split(",")]
    return read_table(spark, location, **options).select(*names)


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def read_snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    """A dimension as a batch left it; a version that there isn't is an error."""
    return spark.read.parquet(f"{root}/version={version}")


def snapshot_sink(root: str, keys: list[str], order: list[str], *, apply_deletes: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: writes the dimension with a batch's last changes as version batch_id of the snapshot.

    A batch that is repeated after a failure writes the same version again. The first batch creates the dimension; at
    any other, the version before has to be there, or else the batch fails and leaves what there is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = latest(batch, keys, order, apply_deletes=apply_deletes)
        before = read_snapshot(batch.sparkSession, root, batch_id - 1) if batch_id else None
        upserted(before, rows, keys).write.mode("overwrite").parquet(f"{root}/version={batch_id}")

    return write


def table_sink(location: str, columns: list[str], *, url: str | None = None, batch_rows: int = 1000, **options: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends the named columns, in that order, to a database table, or to Parquet files by batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*columns)
        if url:
            rows.write.option("batchsize", batch_rows).jdbc(url, location, mode="append", properties=options)
        else:
            rows.write.mode("overwrite").parquet(f"{location}/batch={batch_id}")

    return write


def split_sink(parts: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[DataFrame, int], None]]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: several outputs of one input, each by a transformation and a sink; the input is computed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for transform, sink in parts.values():
                sink(transform(batch), batch_id)
        finally:
            batch.unpersist()

    return write


def console(rows: DataFrame) -> DataStreamWriter:
    return rows.writeStream.format("console").option("truncate", "false")
