"""Statistics of tumbling windows on streams, a batch at a time.

An aggregation in the stream's own plan puts every key of an open window into a state store and takes it out again. Where
nearly every row is a key of its own, as with distinct orders, that is most of the work. Here the rows of a batch are written
once, windows that the watermark closes are summed as a table, and rows of open windows wait in Parquet files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.session import shared_folder
from tidewater.sources import files
from tidewater.streaming.runs import finish_batches


def finish_windows(
    rows: DataFrame, sums: Callable[[DataFrame], DataFrame], name: str, *, window: str, delay_ms: int, at: str = "at", spent: tuple[str, ...] = (), state: str | None = None, out: str | None = None,
) -> DataFrame:
    """Works off a stream without state; gives ``sums`` of the rows of every window that is closed, from files in ``out``.

    The watermark is ``delay_ms`` behind the latest time ``at``. A window is closed when the watermark has reached its end; rows
    that come for it later are dropped. Windows still open at the stream's end are not given. The folders in ``spent`` are
    deleted then, and so is the state, unless the caller names a folder for it (and for the results, which add up).
    """
    spark = rows.sparkSession
    kept, target = state or shared_folder(spark, f"{name}-state"), out or shared_folder(spark, name)
    root, end = f"{kept}-open", F.window(at, window)["end"]
    millis = lambda ms: F.timestamp_millis(F.lit(ms))

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        mark = json.loads(files.read_text(session, f"{root}/{batch_id - 1:012d}.json"))["watermark"] if batch_id else None
        fresh = batch.where(F.col(at).isNotNull() if mark is None else end > millis(mark))
        folder = f"{root}/{batch_id}"
        fresh.write.mode("overwrite").parquet(f"{folder}/new")
        read = lambda path: session.read.schema(rows.schema).parquet(path)
        known = read(f"{folder}/new")
        latest = known.agg(F.unix_millis(F.max(at))).first()[0]
        after = max((t for t in (mark, None if latest is None else latest - delay_ms) if t is not None), default=None)
        known = known.unionByName(read(f"{root}/{batch_id - 1}/open")) if batch_id else known
        closed = F.lit(False) if after is None else end <= millis(after)
        sums(known.where(closed)).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        known.where(~closed).write.mode("overwrite").parquet(f"{folder}/open")
        files.remove(session, f"{folder}/new", f"{root}/{batch_id - 2}")
        files.write_text(session, f"{root}/{batch_id:012d}.json", json.dumps({"watermark": after}))

    finish_batches(rows, write, name, state=kept)
    files.remove(spark, *spent, *([] if state else [kept, root]))
    shown = sums(spark.createDataFrame([], rows.schema)).schema
    return spark.read.schema(shown).option("recursiveFileLookup", "true").parquet(target) if files.exists(spark, target) else spark.createDataFrame([], shown)
