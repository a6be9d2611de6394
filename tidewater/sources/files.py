"""Folders and small files of the shared store, through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _at(spark, path)
    return store.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    place, store = _at(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(place)) if store.exists(place) else []


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders or files; what isn't there is no error."""
    for path in paths:
        place, store = _at(spark, path)
        store.delete(place, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Renames a folder in one step, unless the target is there already; says whether it moved."""
    place, store = _at(spark, source)
    to, _ = _at(spark, target)
    if store.exists(to):
        return False
    store.mkdirs(to.getParent())
    return store.rename(place, to)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that readers see whole or not at all; one that is there is replaced."""
    place, store = _at(spark, path)
    part, _ = _at(spark, f"{path.rpartition('/')[0]}/_{path.rpartition('/')[2]}.part")
    out = store.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    store.delete(place, False)
    store.rename(part, place)


def read_text(spark: SparkSession, path: str) -> str:
    place, store = _at(spark, path)
    got = store.open(place)
    try:
        return bytes(got.readAllBytes()).decode()
    finally:
        got.close()
