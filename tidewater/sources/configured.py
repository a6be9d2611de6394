"""Dimension tables that the routing configuration describes: created, widened and merged in the catalog.

A route names a table (kept in upper case), its columns, its key and options. The table's rows lie in buckets, as the
partitions of NAME_ROWS; the view NAME shows the columns alone. A merge rewrites the buckets that a batch touches.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.cdc import net_changes, table_name
from tidewater.session import written
from tidewater.sources import files

BUCKETS = 16
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*$")


def listed(columns: str | None) -> list[str]:
    return [c.strip().upper() for c in (columns or "").split(",") if c.strip()]


def options(extend: str | None) -> dict[str, str]:
    """``key=value`` pairs, separated by commas, with their keys in upper case."""
    pairs = (p.split("=", 1) for p in (extend or "").split(",") if "=" in p)
    return {k.strip().upper(): v.strip().strip("'\"") for k, v in pairs}


def _checked(*names: str) -> None:
    for name in names:
        if not NAME.match(name):
            raise ValueError(f"{name!r} can't name a table or column")


def ensure_table(spark: SparkSession, database: str, name: str, columns: list[str], *, key: str = "ID", properties: dict[str, str] | None = None) -> list[str]:
    """Creates the table, or adds the columns that it lacks; gives all its columns, the key first. Columns are texts.

    Of ``properties``, SALT_BUCKETS is the number of buckets, when the table is created; all are kept as its properties.
    """
    _checked(database, name, key, *columns)
    wanted = [key, *[c for c in columns if c != key]]
    rows = f"`{database}`.`{name}_ROWS`"
    if not spark.catalog.tableExists(f"{database}.{name}_ROWS"):
        kept = {"buckets": (properties or {}).get("SALT_BUCKETS", str(BUCKETS)), "key": key} | (properties or {})
        if not kept["buckets"].isdigit() or not int(kept["buckets"]):
            raise ValueError(f"{kept['buckets']!r} is no number of buckets")
        shown = ", ".join("'{}' = '{}'".format(k.replace("'", ""), v.replace("'", "")) for k, v in kept.items())
        spark.sql(f"create table {rows} ({', '.join(f'`{c}` string' for c in wanted)}, _bucket int) using parquet partitioned by (_bucket) tblproperties ({shown})")
        held: list[str] = []
    else:
        held = [c for c in spark.table(rows).columns if c != "_bucket"]
        if missing := [c for c in wanted if c not in held]:
            spark.sql(f"alter table {rows} add columns ({', '.join(f'`{c}` string' for c in missing)})")
    whole = held + [c for c in wanted if c not in held]
    spark.sql(f"create or replace view `{database}`.`{name}` as select {', '.join(f'`{c}`' for c in whole)} from {rows}")
    return whole


def merge_table(spark: SparkSession, database: str, name: str, columns: list[str], changes: DataFrame, *, apply_deletes: bool = False) -> None:
    """Merges changes (type, data, position) into a table that there is, by its key; a change sets the columns that it has."""
    rows = f"`{database}`.`{name}_ROWS`"
    kept = {r["key"]: r["value"] for r in spark.sql(f"show tblproperties {rows}").collect()}
    key = kept["key"]
    upper = F.transform_keys("data", lambda k, _: F.upper(k))
    keyed = changes.select(upper.alias("data"), "type", "position").where(F.col("data")[key].isNotNull()).withColumn("id", F.col("data")[key])
    new = net_changes(keyed, ["id"], apply_deletes=apply_deletes).withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(int(kept["buckets"]))).cast("int"))
    new = written(new.drop("position"), "changes")
    touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]
    if touched:
        old = spark.table(rows).where(F.col("_bucket").isin(touched))
        both = old.alias("o").join(new.alias("n"), (F.col("o._bucket") == F.col("n._bucket")) & (F.col(f"o.`{key}`") == F.col("n.id")), "full_outer")
        value = lambda c: F.when(F.map_contains_key("n.data", F.lit(c)), F.col("n.data")[c]).when(F.col("n.anew"), F.lit(None)).otherwise(F.col(f"o.`{c}`"))
        made = both.where(~F.col("n.type").eqNullSafe("delete") if apply_deletes else F.lit(True))
        made = made.select(*[F.when(F.col("n.id").isNull(), F.col(f"o.`{c}`")).otherwise(value(c)).alias(c) for c in columns], F.coalesce("n._bucket", "o._bucket").alias("_bucket"))
        made = written(made, "merged")
        _overwrite(spark, rows, made, touched)
        files.remove(spark, *{f.rsplit("/", 1)[0] for f in made.inputFiles()})
    files.remove(spark, *{f.rsplit("/", 1)[0] for f in new.inputFiles()})


def _overwrite(spark: SparkSession, rows: str, made: DataFrame, touched: list[int]) -> None:
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        made.repartition("_bucket").write.mode("overwrite").insertInto(rows.replace("`", ""))
    finally:
        spark.conf.set(mode, before)
    # buckets in which nothing is left aren't written
    full = {r["_bucket"] for r in made.select("_bucket").distinct().collect()}
    for bucket in set(touched) - full:
        spark.sql(f"alter table {rows} drop if exists partition (_bucket = {bucket})")


def route_sink(database: str, *, apply_deletes: bool = False):
    """For foreachBatch: routed changes (sink_table, sink_columns, sink_pk, sink_extend, type, data, position) into their tables.

    Tables are made when the first of their changes comes, and get new columns when a route names more. A route without
    columns sets those that its changes have, as far as the table has them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("sink_table", table_name(F.col("sink_table"))).persist()
        try:
            described = batch.groupBy("sink_table").agg(
                F.collect_set("sink_columns").alias("columns"), F.max("sink_pk").alias("pk"), F.max("sink_extend").alias("extend")
            )
            for route in described.collect():  # one row a table of the configuration
                names = sorted({c for text in route["columns"] for c in listed(text)})
                columns = ensure_table(batch.sparkSession, database, route["sink_table"], names, key=(route["pk"] or "id").upper(), properties=options(route["extend"]))
                merge_table(batch.sparkSession, database, route["sink_table"], columns, batch.where(F.col("sink_table") == route["sink_table"]), apply_deletes=apply_deletes)
        finally:
            batch.unpersist()

    return write
