"""Interval joins of two streams, a batch at a time.

A join in the stream's own plan puts every row into a state store by itself, and takes it out by itself. Here the new rows
of a batch are joined as tables, with each other and with the rows that wait. What a later row may still match waits in
Parquet files of the batch's number beside the watermark, so a batch that is repeated starts from the same rows. Rows stay
records in JSON until they are joined: a pass that asks for times alone reads only these of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import shared_folder
from tidewater.sources import files
from tidewater.streaming.runs import finish_batches

Join = Callable[[DataFrame, DataFrame], DataFrame]


def _manifest(root: str, batch_id: int) -> str:
    return f"{root}/{batch_id:012d}.json"


def _before(spark: SparkSession, root: str, batch_id: int) -> dict:
    if not batch_id:
        return {"watermark": None, "reached": {}}
    return json.loads(files.read_text(spark, _manifest(root, batch_id - 1)))


def join_batches(
    left: tuple[DataFrame, str], right: tuple[DataFrame, str], join: Join, sink: Callable[[DataFrame, int, int | None], None], name: str, *,
    low_ms: int, high_ms: int, delay_ms: int = 0, at: tuple[str, str] = ("create_ts", "create_ts"), state: str | None = None,
) -> None:
    """Works off two topics through ``join``, a join of tables by a key whose right time is in [left + low_ms, left + high_ms].

    A side is the stream of a topic's records (read_topic() without a schema) and the schema that its tables have.
    ``sink`` gets the pairs of every batch, its number, and how far both streams have come (the lesser of their latest times).
    The watermark is ``delay_ms`` behind that; rows that come later than it are dropped, and rows that only those could
    match are forgotten. ``at`` names the times (epoch milliseconds). State is deleted, unless the caller names a folder.
    """
    spark = left[0].sparkSession
    kept = state or shared_folder(spark, f"{name}-state")
    root, schemas = f"{kept}-waiting", {"left": left[1], "right": right[1]}
    both = reduce(DataFrame.unionByName, [rows.select("value", F.lit(s).alias("side")) for s, (rows, _) in zip(schemas, (left, right), strict=True)])
    times = dict(zip(("left", "right"), at, strict=True))
    #: how much later than a waiting row the other side's row may be
    reach = {"left": high_ms, "right": -low_ms}

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = _before(session, root, batch_id)
        mark = before["watermark"]
        at = {s: F.from_json("value", schemas[s])[times[s]] for s in times}
        rows = lambda texts, s: texts.select(F.from_json("value", schemas[s]).alias("r")).select("r.*")
        new = {s: batch.where(F.col("side") == s).select("value") for s in times}
        if mark is not None:
            new = {s: texts.where(at[s] > mark) for s, texts in new.items()}
        table = {s: rows(texts, s) for s, texts in new.items()}
        pairs = join(table["left"], table["right"])
        held = session.read.schema("value string, side string").parquet(f"{root}/{batch_id - 1}") if batch_id else None
        if held is not None:
            waited = {s: rows(held.where(F.col("side") == s).select("value"), s) for s in times}
            pairs = pairs.unionByName(join(table["left"], waited["right"])).unionByName(join(waited["left"], table["right"]))
        latest = batch.agg(*[F.max(F.when(F.col("side") == s, at[s])).alias(s) for s in times]).first()
        reached = {s: max((t for t in (latest[s], before["reached"].get(s)) if t is not None), default=None) for s in times}
        common = None if None in reached.values() else min(reached.values())
        sink(pairs, batch_id, common)
        after = None if common is None else max(common - delay_ms, mark if mark is not None else common - delay_ms)
        fresh = batch if mark is None else batch.where(reduce(lambda a, b: a | b, [(F.col("side") == s) & (at[s] > mark) for s in times]))
        until = F.when(F.col("side") == "left", at["left"] + reach["left"]).otherwise(at["right"] + reach["right"])
        waiting = (fresh if held is None else fresh.unionByName(held)).where(until.isNotNull() if after is None else until > after)
        waiting.write.mode("overwrite").parquet(f"{root}/{batch_id}")
        files.write_text(session, _manifest(root, batch_id), json.dumps({"watermark": after, "reached": reached}))
        # the batch before may be needed for this one's repetition, those before it are not
        files.remove(session, f"{root}/{batch_id - 2}", *([_manifest(root, batch_id - 2)] if batch_id > 1 else []))

    finish_batches(both, write, name, state=kept)
    if state is None:
        files.remove(spark, kept, root)


def finish_join(left: tuple[DataFrame, str], right: tuple[DataFrame, str], join: Join, name: str, *, spent: tuple[str, ...] = (), marks: str | None = None, out: str | None = None, **how) -> DataFrame:
    """join_batches() into Parquet files in ``out`` (a new shared folder, if none), given back as a batch; the folders in ``spent`` are deleted then.

    With ``marks`` every batch gets a row that is null but for the time column of that name: how far both streams have come.
    A stream that reads the files needs it for its watermark, as the pairs alone don't tell.
    """
    spark = left[0].sparkSession
    out, schema = out or shared_folder(spark, name), []

    def sink(pairs: DataFrame, batch_id: int, reached: int | None) -> None:
        schema[:] = [pairs.schema]
        if marks is not None and reached is not None:
            empty = {f.name: F.lit(None).cast(f.dataType) for f in pairs.schema if f.name != marks}
            mark = pairs.sparkSession.range(1).select(F.timestamp_millis(F.lit(reached)).alias(marks), *[v.alias(n) for n, v in empty.items()])
            pairs = pairs.unionByName(mark)
        pairs.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    join_batches(left, right, join, sink, name, **how)
    files.remove(spark, *spent)
    if not schema:  # no input, no batch
        pairs = join(*[spark.createDataFrame([], s) for _, s in (left, right)])
        pairs.write.parquet(out)
        schema = [pairs.schema]
    return spark.read.schema(schema[0]).option("recursiveFileLookup", "true").parquet(out)
