"""Runs of streams over what their source holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tidewater.session import SETTINGS, shared_folder
from tidewater.sources import files

STORE = "spark.sql.streaming.stateStore.providerClass"
#: RocksDB would look every key up before it is put, only to count keys.
COUNT_KEYS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
#: Topics are packed: what a task reads takes many times its bytes where it is sorted.
READ_BYTES, MOST_BYTES = "spark.sql.files.maxPartitionBytes", 8 << 20


def _run(spark: SparkSession, writer: DataStreamWriter, **settings: str) -> None:
    """Works a stream off under settings of its own, no task reading more than MOST_BYTES of files or one packed file."""
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(READ_BYTES))
    settings |= {READ_BYTES: str(min(MOST_BYTES, given))}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        writer.start().awaitTermination()  # sources plan their files in the session itself, at every batch
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def finish(rows: DataFrame, name: str, *, spent: tuple[str, ...] = (), clock: bool = False, state: str | None = None) -> DataFrame:
    """Works off a stream's input into Parquet files in the shared folder, and gives them back as a batch.

    Then the folders in ``spent``, say topics that nothing else reads, are deleted, and so is the stream's state, unless
    the caller names a folder for it. With ``clock`` the stream has state that lives by the clock: it would look for
    expired state for ever, and so gets no batches without input.
    """
    spark = rows.sparkSession
    spark.conf.set(STORE, SETTINGS[STORE])
    spark.conf.set(COUNT_KEYS, "false")
    out = shared_folder(spark, name)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state or f"{out}-state").trigger(availableNow=True)
    _run(spark, writer, **({EMPTY_BATCHES: "false"} if clock else {}))
    files.remove(spark, *spent, *([] if state else [f"{out}-state"]))
    return spark.read.schema(rows.schema).parquet(out)


def finish_batches(rows: DataFrame, sink: Callable[[DataFrame, int], None], name: str, *, state: str | None = None) -> None:
    """Works off a stream's input through a foreachBatch sink; its state is deleted, unless the caller names a folder for it."""
    spark = rows.sparkSession
    spark.conf.set(STORE, SETTINGS[STORE])
    spark.conf.set(COUNT_KEYS, "false")
    folder = state or shared_folder(spark, f"{name}-state")
    _run(spark, rows.writeStream.foreachBatch(sink).option("checkpointLocation", folder).trigger(availableNow=True))
    if state is None:
        files.remove(spark, folder)
