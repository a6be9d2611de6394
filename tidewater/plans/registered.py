"""Queries by name, with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.plans import oracle
from tidewater.plans.adapters import DAY_MS

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None, window_ms: int = DAY_MS):
    """Registers a function under its name, with SQL over the records of plans.oracle."""

    def keep(f):
        FOUND[f.__name__] = (f, None if sql is None else oracle.sql(sql, window_ms))
        return f

    return keep


def plain(rows: DataFrame) -> DataFrame:
    """Money as double."""
    return rows.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in rows.dtypes])
