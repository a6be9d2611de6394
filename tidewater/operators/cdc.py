"""Change records of a database: cleaning, routing by configuration, and dimension snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A routing table of up to so many rows is broadcast; a longer one is joined like any other.
BROADCAST_ROUTES = 10_000
DIMENSION, TOPIC = "hbase", "kafka"
#: As sources.topics gives it.
PLACE = "struct<at:timestamp,source:string,start:bigint>"


def parse_changes(values: DataFrame, column: str = "value") -> DataFrame:
    """table, type, data (a variant) and position of change records as JSON text; null fields where it is none.

    A variant keeps numbers as they are, up to 38 digits; only those written with an exponent are doubles. Records with a
    name twice in one object count as no JSON. position orders the changes of a batch: by transaction and place in it (xid
    and xoffset, where records have them), then by ``place`` where read_topic() gave one, then by the rows of a partition,
    which follow each other as they were read. Streams have no such rows before their batches. Other columns stay.

    Every text is parsed once: filters stay above a generator, whereas they would be moved below a plain column and parse
    each text anew.
    """
    rest = [F.col(c) for c in values.columns if c not in (column, "place")]
    place = F.col("place") if "place" in values.columns else F.lit(None).cast(PLACE)
    line = F.lit(None).cast("long") if values.isStreaming else F.monotonically_increasing_id()
    placed = values.select(column, place.alias("_place"), line.alias("_line"), *rest)
    parsed = placed.select(F.explode(F.array(F.try_parse_json(F.col(column)))).alias("_record"), "_place", "_line", *rest)
    field = lambda name, kind: F.try_variant_get("_record", f"$.{name}", kind)
    position = F.struct(field("xid", "long").alias("xid"), field("xoffset", "long").alias("xoffset"), F.col("_place").alias("place"), F.col("_line").alias("line"))
    return parsed.select(field("table", "string").alias("table"), field("type", "string").alias("type"), field("data", "variant").alias("data"), position.alias("position"), *rest)


def valid_changes(changes: DataFrame) -> DataFrame:
    """Changes with a table and with an object as data that is not empty."""
    return changes.where(F.col("table").isNotNull() & (F.size(F.try_variant_get("data", "$", "map<string,variant>")) > 0))


def with_data(changes: DataFrame) -> DataFrame:
    """changes with data as a map of texts; objects and lists in it are their JSON text."""
    return changes.withColumn("data", F.try_variant_get("data", "$", "map<string,string>"))


def pruned(data: Column, columns: Column) -> Column:
    """The entries of a map whose keys a comma-separated list names exactly; all if the list is null or empty."""
    listed = F.split(columns, ",")
    return F.when(F.coalesce(columns, F.lit("")) == "", data).otherwise(F.map_filter(data, lambda k, v: F.array_contains(listed, k)))


def routed(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Changes with sink_type, sink_table, sink_pk and pruned data; those that no route names are dropped, unparsed.

    sink_columns and sink_extend come along for tables that are made by the configuration.

    bootstrap-insert counts as insert. routes has source_table, operate_type, sink_type, sink_table, sink_columns
    sink_pk and sink_extend; of routes for one table and type the last in order of their columns holds. Without routes it fails.
    """
    chosen = routes.groupBy("source_table", "operate_type").agg(F.max(F.struct("sink_type", "sink_table", "sink_columns", "sink_pk", "sink_extend")).alias("to"))
    known = chosen.limit(BROADCAST_ROUTES + 1).count()
    if not known:
        raise ValueError("the routing table is empty")
    kind = F.when(F.col("type") == "bootstrap-insert", F.lit("insert")).otherwise(F.col("type"))
    joined = changes.withColumn("type", kind).join(
        F.broadcast(chosen) if known <= BROADCAST_ROUTES else chosen,
        (F.col("table") == F.col("source_table")) & (F.col("type") == F.col("operate_type")),
    )
    return with_data(joined).select(
        "table", "type", pruned(F.col("data"), F.col("to.sink_columns")).alias("data"), "to.sink_type", "to.sink_table",
        F.coalesce("to.sink_pk", F.lit("id")).alias("sink_pk"), "to.sink_columns", "to.sink_extend", *[c for c in changes.columns if c not in ("table", "type", "data")],
    )


def table_name(sink_table: Column) -> Column:
    """The name under which a store that knows upper case only keeps a dimension."""
    return F.upper(sink_table)


def facts(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("sink_type") == TOPIC)


def dimensions(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("sink_type") == DIMENSION)


def latest(changes: DataFrame, keys: list[str], order: list[str], *, apply_deletes: bool = False) -> DataFrame:
    """The last change of every key, in order of ``order`` and then of the whole row, as a snapshot.

    A delete keeps the row as it was written, unless apply_deletes. The last change is a maximum, which every task
    takes of its own rows first: a key with very many changes is no hot spot.
    """
    rest = [c for c in changes.columns if c not in (*keys, *order)]
    flat = [F.to_json(c).alias(f"_{c}") if dict(changes.dtypes)[c].startswith("map") else F.col(c).alias(f"_{c}") for c in rest]
    named = changes.select(*keys, F.struct(*order, *flat, *[c for c in rest if not dict(changes.dtypes)[c].startswith("map")]).alias("_row"), *[c for c in rest if dict(changes.dtypes)[c].startswith("map")])
    maps = [c for c in rest if dict(changes.dtypes)[c].startswith("map")]
    last = named.groupBy(*keys).agg(F.max_by(F.struct("_row", *maps), "_row").alias("_last"))
    out = last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) if c in maps else F.col(f"_last._row.{c}").alias(c) for c in changes.columns])
    return out.where(~F.col("type").eqNullSafe("delete")) if apply_deletes else out


def net_changes(changes: DataFrame, keys: list[str], *, order: str = "position", data: str = "data", apply_deletes: bool = False) -> DataFrame:
    """One row per key: what a batch of changes amounts to, in order of ``order`` (ties: the larger value).

    ``data`` has the last value of each column that a change set, and the other columns are the last change's. With
    apply_deletes only what follows a key's last delete counts, and ``anew`` says that there was one.

    Values are maxima per key and column, which every task takes of its own rows first: a key with very many changes is no
    hot spot, and what meets in the end is a row per column.
    """
    rest = [c for c in changes.columns if c not in (*keys, order, data)]
    gone = F.col("type").eqNullSafe("delete") if apply_deletes else F.lit(False)
    # one entry without column for each change, which alone carries the rest
    entries = F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.struct(*rest).alias("rest"))),
        F.when(gone, F.array()).otherwise(F.transform(
            F.map_entries(F.coalesce(data, F.create_map().cast("map<string,string>"))),
            lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.when(F.lit(False), F.struct(*rest)).alias("rest")),
        )),
    )
    cells = changes.select(*keys, F.col(order).alias("_order"), gone.alias("_gone"), F.explode(entries).alias("_cell"))
    delete = F.max(F.when(F.col("_gone"), F.col("_order"))) if apply_deletes else F.max(F.lit(None).cast("boolean"))
    last = cells.groupBy(*keys, F.col("_cell.key").alias("_column")).agg(F.max(F.struct("_order", "_cell.value", "_cell.rest")).alias("_last"), delete.alias("_delete"))
    row = lambda value: F.when(F.col("_column").isNull(), value)
    at = [F.col("_last._order").alias("at")] if apply_deletes else []
    by_key = last.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_column").isNotNull(), F.struct(F.col("_column").alias("key"), F.col("_last.value").alias("value"), *at))).alias("_cells"),
        F.max(row(F.col("_delete"))).alias("_delete"), F.first(row(F.struct(F.col("_last._order").alias("order"), F.col("_last.rest").alias("rest"))), ignorenulls=True).alias("_row"),
    )
    kept = F.filter("_cells", lambda c: F.col("_delete").isNull() | (c["at"] > F.col("_delete"))) if apply_deletes else F.col("_cells")
    made = F.map_from_entries(F.array_sort(F.transform(kept, lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))))
    return by_key.select(*keys, made.alias(data), *[F.col(f"_row.rest.`{c}`").alias(c) for c in rest], F.col("_row.order").alias(order), F.col("_delete").isNotNull().alias("anew"))


def merged(snapshot: DataFrame | None, changes: DataFrame, keys: list[str], *, data: str = "data", apply_deletes: bool = False) -> DataFrame:
    """A snapshot after net_changes(): values that a change set replace those of the row, others stay.

    With apply_deletes a row whose last change is a delete is left out. Both sides hold a key once; null keys are equal.
    """
    rest = [c for c in changes.columns if c not in (*keys, data, "anew")]
    if snapshot is None:
        rows = changes.drop("anew")
    else:
        same = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
        both = snapshot.withColumn("_old", F.lit(True)).alias("o").join(changes.withColumn("_new", F.lit(True)).alias("n"), same, "full_outer")
        new, old = F.col("n._new").isNotNull(), F.col(f"o.`{data}`")
        fresh = F.col(f"n.`{data}`")
        over = F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
        value = F.when(~new, old).when(F.col("n.anew") | F.col("o._old").isNull(), fresh).otherwise(over)
        pick = lambda c: F.when(new, F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c)
        rows = both.select(*[pick(k) for k in keys], value.alias(data), *[pick(c) for c in rest])
    return rows.where(~F.col("type").eqNullSafe("delete")) if apply_deletes else rows


def upserted(snapshot: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A snapshot in which rows replace those of the same keys; rows hold each key once."""
    if snapshot is None:
        return rows
    return snapshot.join(rows.select(*keys), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
