"""Topics of JSON records: a message broker, or a folder of JSON lines that stands in for one.

A folder holds a folder for each batch that was written to it, named after its source and number. A batch is written
aside and renamed as a whole, so that readers see it entirely or not at all, and a batch that is repeated after a
failure finds its folder and adds nothing. A stream that is written keeps its own list of finished files beside them,
which readers follow.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.sources import files

#: Where a record stands in its topic; the records of one place follow each other in one partition.
PLACE = "struct<at:timestamp,source:string,start:bigint>"
#: Records are packed; a packed file is read, and perhaps sorted, by one task, so files are kept small.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": "250000"}


def read_topic(
    spark: SparkSession, topic: str, *, schema: str | None = None, servers: str | None = None, stream: bool = True, start: str = "latest", place: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """Records of a topic: one text column ``value``, or the fields of a schema (records that don't parse are null).

    With ``servers`` the topic is one of a broker; else it is a folder of text files with a record on each line. With
    ``place`` a column of that name says where a record stands (PLACE): a broker's partition and offset, or the time and
    path of the file and where the part of it begins that a task reads.
    """
    reader = spark.readStream if stream else spark.read
    if servers:
        raw = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        raw = raw.option("startingOffsets", start if stream else "earliest").load()
        where = F.struct(F.lit(None).cast("timestamp").alias("at"), F.col("partition").cast("string").alias("source"), F.col("offset").alias("start"))
        values = raw.select(F.col("value").cast("string").alias("value"), *([where.alias("place")] if place else []))
    else:
        if files_per_batch and stream:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        where = F.struct(
            F.col("_metadata.file_modification_time").cast("timestamp").alias("at"), F.col("_metadata.file_path").alias("source"),
            F.col("_metadata.file_block_start").alias("start"),
        )
        values = reader.option("recursiveFileLookup", "true").text(topic).select("value", *([where.alias("place")] if place else []))
    if schema is None:
        return values
    return values.select(F.from_json("value", schema).alias("r"), *(["place"] if place else [])).select("r.*", *(["place"] if place else []))


def topic_table(spark: SparkSession, name: str, topic: str, schema: str, at: str, delay: str, **options) -> DataFrame:
    """A temporary view over a topic with the event time ``rowtime``, an SQL expression, and its watermark."""
    rows = read_topic(spark, topic, schema=schema, **options).withColumn("rowtime", F.expr(at))
    rows = rows.withWatermark("rowtime", delay) if rows.isStreaming else rows
    rows.createOrReplaceTempView(name)
    return rows


def records(rows: DataFrame) -> DataFrame:
    """Rows as JSON texts in ``value``."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def batch_folder(source: str, batch_id: int) -> str:
    """The name of a batch's folder; names sort as the batches of a source follow each other."""
    if "=" in source or "/" in source or source.startswith(("_", ".")):
        raise ValueError(f"{source!r} can't name a source")
    return f"{source}-{batch_id:012d}"


def write_topic(rows: DataFrame, topic: str, *, servers: str | None = None, checkpoint: str | None = None, batch: tuple[str, int] | None = None) -> StreamingQuery | None:
    """Rows to one topic, as a batch or, for a stream, as a query with a checkpoint that works off what is there.

    ``batch`` names the source and number of a batch: in a folder, a batch that is repeated is there once. Without it
    every call adds its rows. A broker gets repeated batches again, with the same key for readers to tell them by.
    """
    values = records(rows)
    if rows.isStreaming:
        form, options = ("kafka", {"kafka.bootstrap.servers": servers, "topic": topic}) if servers else ("text", {"path": topic} | PACKED)
        return values.writeStream.format(form).options(**options).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if servers:
        keyed = values if batch is None else values.withColumn("key", F.lit(batch_folder(*batch)))
        keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
        return None
    spark, name = rows.sparkSession, batch_folder(*batch) if batch else f"rows-{uuid.uuid4().hex}"
    if not files.exists(spark, f"{topic}/{name}"):
        aside = f"{topic}/_open/{name}-{uuid.uuid4().hex}"
        values.write.options(**PACKED).text(aside)
        _publish(spark, aside, f"{topic}/{name}")
    return None


def _publish(spark: SparkSession, aside: str, target: str) -> None:
    if not files.move(spark, aside, target):
        files.remove(spark, aside)  # another attempt was first


def write_topics(rows: DataFrame, root: str, *, topic: str = "sink_table", payload: str = "data", servers: str | None = None, batch: tuple[str, int] | None = None) -> None:
    """A batch to the topics that a column names; the payload alone is written. Folders are root/topic=name.

    As write_topic(), topic by topic: if a repeated batch finds some of its topics written, it adds the others.
    """
    values = rows.select(F.col(topic).alias("topic"), F.to_json(payload).alias("value"))
    if servers:
        keyed = values if batch is None else values.withColumn("key", F.lit(batch_folder(*batch)))
        keyed.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
        return
    spark, name = rows.sparkSession, batch_folder(*batch) if batch else f"rows-{uuid.uuid4().hex}"
    aside = f"{root}/_open/{name}-{uuid.uuid4().hex}"
    values.write.options(**PACKED).partitionBy("topic").text(aside)
    for part in files.names(spark, aside):
        if part.startswith("topic="):
            _publish(spark, f"{aside}/{part}", f"{root}/{part}/{name}")
    files.remove(spark, aside)
