"""Entities with ids of their own over the snapshots of a warehouse, and those ids on the tables that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTITY = "entity_id long, entity_type string, object_name string, first_seen long, last_seen long, is_active boolean"
_DEALS = 1024


def numbered(rows: DataFrame, key: list[str], name: str, after: Column) -> DataFrame:
    """rows with a number from after + 1 on, without gaps, in an order told by the key alone. Rows are dealt by a hash of their key; each deal begins where
    those before it end, so no task holds more than one deal."""
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64(*key), F.lit(_DEALS)))
    size = dealt.groupBy("_deal").agg(F.count("*").alias("_n"))
    before = size.withColumn("_before", F.sum("_n").over(Window.orderBy("_deal")) - F.col("_n")).drop("_n")  # at most _DEALS rows
    at = F.row_number().over(Window.partitionBy("_deal").orderBy(*key))
    return dealt.join(before, "_deal").withColumn(name, (after + F.col("_before") + at).cast("long")).drop("_deal", "_before")


def merge_entities(known: DataFrame, tables: DataFrame, snapshot_id: int, is_baseline: bool = False) -> DataFrame:
    """Entities after a snapshot's tables(schema_name, table_name, object_type) have been met: those of `known` (see ENTITY) keep their ids, new pairs of
    type and name get the next ones. What the snapshot holds was last seen there and is active; after a baseline entities whose name it
    doesn't hold are not, unless it is empty. Meeting a snapshot twice changes nothing."""
    name = F.concat_ws(".", "schema_name", "table_name")
    met = tables.select(F.upper(F.coalesce("object_type", F.lit("TABLE"))).alias("entity_type"), name.alias("object_name")).distinct().withColumn("_met", F.lit(True))
    both = known.join(met, ["entity_type", "object_name"], "full_outer")
    here = F.coalesce("_met", F.lit(False))
    at = F.lit(snapshot_id).cast("long")
    both = both.withColumns({"first_seen": F.coalesce("first_seen", at), "last_seen": F.when(here, F.greatest(F.coalesce("last_seen", at), at)).otherwise(F.col("last_seen"))})
    if is_baseline:
        names = met.select("object_name").distinct().withColumn("_named", F.lit(True))
        some = F.broadcast(names.limit(1).select(F.col("_named").alias("_some")))
        both = both.join(names, "object_name", "left").join(some, F.lit(True), "left")
        active = here | (F.col("is_active") & (F.col("_named").isNotNull() | F.col("_some").isNull()))
    else:
        active = here | F.col("is_active")
    both = both.withColumn("is_active", F.coalesce(active, F.lit(False)))
    columns = [c.split()[0] for c in ENTITY.split(", ")]
    last = known.agg(F.coalesce(F.max("entity_id"), F.lit(0)).alias("_last"))
    new = numbered(both.where("entity_id is null").drop("entity_id").join(F.broadcast(last)), ["entity_type", "object_name"], "entity_id", F.col("_last"))
    return both.where("entity_id is not null").select(columns).unionByName(new.select(columns))


def back_fill(child: DataFrame, entities: DataFrame, name: Column, kind: Column | None = None) -> DataFrame:
    """child with the entity_id of the entity of that name and type, or, without a type, of the first one of that name. Rows that have an id keep it, so this
    may be run again; names without a schema, and names of nothing known, have none."""
    keys = ["_name"] + ["_kind"] * (kind is not None)
    found = entities.select(F.col("object_name").alias("_name"), F.col("entity_type").alias("_kind"), "entity_id").groupBy(keys).agg(F.min("entity_id").alias("_entity"))
    named = child.withColumn("_name", F.when(F.contains(name, F.lit(".")), name))
    if kind is not None:
        named = named.withColumn("_kind", F.upper(F.coalesce(kind, F.lit("TABLE"))))
    own = F.col("entity_id") if "entity_id" in child.columns else F.lit(None).cast("long")
    return named.join(found, keys, "left").withColumn("entity_id", F.coalesce(own, "_entity")).drop("_name", "_kind", "_entity")


def back_fill_all(entities: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """The children tables, nodes, usage, changes and criticality, those that are given, with their entity ids."""
    qualified = lambda name: F.when(F.contains(F.coalesce(name, F.lit("")), F.lit(".")), F.col(name)).otherwise(F.concat("schema_name", F.lit("."), F.coalesce(name, F.lit(""))))
    names = {"tables": F.concat_ws(".", "schema_name", "table_name"), "nodes": qualified("object_name"), "usage": qualified("object_name"), "changes": F.col("object_identifier"), "criticality": F.col("object_name")}
    return {child: back_fill(df, entities, names[child], None if child == "criticality" else F.col("object_type")) for child, df in children.items()}
