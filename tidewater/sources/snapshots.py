"""Dimension snapshots in buckets: a batch of changes rewrites the buckets that it touches, and no others.

Rows fall into a fixed number of buckets by a hash of their key. Version n of a snapshot is a small manifest: for every
bucket, the version whose folder holds it (root/data/version=v/bucket=b). Merging batch n reads the touched buckets of the
version before, writes them anew, and then writes the manifest. Until that is there, nobody sees the version; a batch that
is repeated after a failure starts from the same version and ends the same.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.cdc import merged, net_changes
from tidewater.sources import files


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/{version:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    return [int(n[:-5]) for n in files.names(spark, f"{root}/manifest") if n[:-5].isdigit()]


def _held(spark: SparkSession, root: str, version: int) -> dict:
    if not files.exists(spark, _manifest(root, version)):
        raise FileNotFoundError(f"{root} has no version {version}")
    return json.loads(files.read_text(spark, _manifest(root, version)))


def _read(spark: SparkSession, root: str, held: dict, buckets: set[int] | None = None) -> DataFrame:
    """Rows of all or some buckets, with the column ``bucket``."""
    paths = [f"{root}/data/version={v}/bucket={b}" for b, v in held["buckets"].items() if buckets is None or int(b) in buckets]
    if not paths:
        return spark.createDataFrame([], held["schema"])
    return spark.read.schema(held["schema"]).option("basePath", f"{root}/data").parquet(*paths).drop("version")


def read_merged(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A dimension as a batch left it, or as the last one did; a version that there isn't is an error."""
    known = versions(spark, root)
    if version is None and not known:
        raise FileNotFoundError(f"{root} has no version")
    return _read(spark, root, _held(spark, root, known[-1] if version is None else version)).drop("bucket")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def merge_sink(root: str, keys: list[str], *, order: str = "position", data: str = "data", buckets: int = 64, apply_deletes: bool = False) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges a batch of changes into version batch_id of the snapshot in ``root``.

    Changes of one key count in order of ``order`` inside a batch, and batches in order of their numbers: what arrives
    later holds, also over a change that was made later. A change sets the columns that its map ``data`` has; others stay
    as they were. A delete counts as any change, or with apply_deletes takes the row away, so that what follows begins
    anew. The first batch creates the snapshot; any other needs the one before, or fails and leaves what there is.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _held(spark, root, batch_id - 1) if batch_id else None
        new = net_changes(batch, keys, order=order, data=data, apply_deletes=apply_deletes)
        count = before["count"] if before else buckets
        new = new.withColumn("bucket", _bucket(keys, count)).persist()
        try:
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # a bounded number
            held = _read(spark, root, before, touched) if before else None
            rows = merged(held, new, [*keys, "bucket"], data=data, apply_deletes=apply_deletes)
            folder = f"{root}/data/version={batch_id}"
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        finally:
            new.unpersist()
        now = {b: v for b, v in (before["buckets"] if before else {}).items() if int(b) not in touched}
        now |= {n.partition("=")[2]: batch_id for n in files.names(spark, folder) if n.startswith("bucket=")}
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        files.write_text(spark, _manifest(root, batch_id), json.dumps({"count": count, "buckets": now, "schema": schema}))

    return write


def vacuum(spark: SparkSession, root: str, *, keep: int = 2) -> None:
    """Forgets all but the last ``keep`` versions, and deletes the buckets that none of these holds."""
    known = versions(spark, root)
    kept, gone = known[-keep:], known[:-keep]
    needed = defaultdict(set)
    for version in kept:
        for bucket, at in _held(spark, root, version)["buckets"].items():
            needed[at].add(bucket)
    files.remove(spark, *[_manifest(root, v) for v in gone])
    for version in gone:
        folder = f"{root}/data/version={version}"
        spent = [n for n in files.names(spark, folder) if n.startswith("bucket=") and n.partition("=")[2] not in needed[version]]
        files.remove(spark, *([f"{folder}/{n}" for n in spent] if needed[version] else [folder]))
