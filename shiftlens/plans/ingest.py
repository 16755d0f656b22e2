"""Compositions: building snapshots from extracts, ingesting lineage, usage and people, and what follows an ingest."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.functions.exprs import USAGE_TYPES, format_type, is_nullable, lookup, map_dataset_type, object_type_from_kind
from shiftlens.operators import diff, graph, metrics, org, quality
from shiftlens.sources import readers
from shiftlens.sources.shared import stored

log = logging.getLogger(__name__)


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their `position`; where they have none, in the order in which the frame lists them."""
    return rows if "position" in rows.columns else rows.withColumn("position", F.monotonically_increasing_id())


def build_snapshot(snapshot_id: int, databases: DataFrame, tables: DataFrame, columns: DataFrame, indices: DataFrame | None = None, partitioning: DataFrame | None = None, tabletext: DataFrame | None = None) -> dict[str, DataFrame]:
    """schemas, tables and columns of a snapshot from extract rows, and `counts` (kind, seen, created); with their extracts also indices,
    partitioning and ddl (one text an object, from its fragments). Of tables listed twice the last altered counts, of equal ones the first by `position`, as
    readers give it (without one, as the frame lists them); what belongs to unknown tables is dropped and counted; types are named; a missing ordinal is 0."""
    at = F.lit(snapshot_id).cast("long").alias("snapshot_id")
    t = metrics.dedup_latest(_placed(tables).where("database_name is not null and table_name is not null"), ["database_name", "table_name"], "last_alter_timestamp", "position")
    t = t.select(at, F.col("database_name").alias("schema_name"), "table_name", object_type_from_kind("table_kind").alias("object_type"), F.col("last_alter_timestamp").cast("string").alias("ddl_alter_timestamp"))
    s = databases.select("database_name").unionByName(tables.select("database_name")).where("database_name is not null").distinct().select(at, F.col("database_name").alias("schema_name"))
    known = lambda df, *fields: df.select(at, F.col("database_name").alias("schema_name"), "table_name", *fields).join(t.select("schema_name", "table_name"), ["schema_name", "table_name"], "left_semi")
    c = known(
        columns, "column_name", format_type("column_type", "column_length", "decimal_total_digits", "decimal_fractional_digits").alias("data_type"), is_nullable("nullable").alias("nullable"),
        F.coalesce("column_id", F.lit(0)).alias("ordinal_position"),
    )
    out, seen = {"schemas": s, "tables": t, "columns": c}, {"tables": tables, "columns": columns}
    if indices is not None:
        out["indices"], seen["indices"] = known(indices, "index_name", "index_number", "index_type", "unique_flag", "column_name", "column_position"), indices
    if partitioning is not None:
        out["partitioning"], seen["partitioning"] = known(partitioning, "constraint_type", "constraint_text"), partitioning
    if tabletext is not None:
        texts = metrics.assemble_ddl(tabletext.select("database_name", "table_name", F.col("request_text_seq").alias("seq"), F.col("request_text").alias("text")))
        out["ddl"], seen["ddl"] = known(texts, "ddl", "fragments"), texts
    count = lambda kind: seen[kind].agg(F.count("*").alias("seen")).join(F.broadcast(out[kind].agg(F.count("*").alias("created")))).select(F.lit(kind).alias("kind"), "seen", "created")
    counts = count("tables")
    for kind in list(seen)[1:]:
        counts = counts.unionByName(count(kind))
    return out | {"counts": counts}


def incremental_backfill(new: DataFrame, baseline: DataFrame, mode: str = "object") -> DataFrame:
    """new tables with those of the baseline that it lacks: single objects, or with mode="schema" only whole schemas."""
    keys = ["schema_name"] if mode == "schema" else ["schema_name", "table_name"]
    return new.unionByName(baseline.join(new.select(keys).distinct(), keys, "left_anti").select(new.columns))


def ingest_lineage(frames: dict[str, DataFrame], snapshot_id: int, baseline: DataFrame | None = None, full: bool = True, attach_to: DataFrame | None = None, names: DataFrame | None = None) -> dict[str, DataFrame]:
    """Frames of a lineage document without noise, as tables, columns, nodes, dataset edges, processes, steps and attribute lineage of a snapshot.

    attach_to are tables that the snapshot has already; they are not made again. names(object_name) are names by which ends that are UNKNOWN.<name>
    are repaired. `orphans` counts what refers to nothing: edges without a dataset, steps without a process."""
    kept = quality.noise_filter(frames["containers"], frames["datasets"], frames["attributes"], frames["attribute_edges"])
    split = lambda k: (F.substring_index(k, ".", 1).alias("schema_name"), F.substring_index(k, ".", -1).alias("table_name"))
    at = F.lit(snapshot_id).cast("long").alias("snapshot_id")
    tables = kept["datasets"].select(at, *split("datasetNaturalKey"), map_dataset_type("datasetType").alias("object_type")).distinct()
    if not full and baseline is not None:
        tables = incremental_backfill(tables, baseline.withColumn("snapshot_id", at).select("snapshot_id", "schema_name", "table_name", "object_type"))
    if attach_to is not None:
        here = attach_to.select(F.upper("schema_name").alias("_s"), F.upper("table_name").alias("_t")).distinct()
        tables = tables.join(here, (F.upper("schema_name") == F.col("_s")) & (F.upper("table_name") == F.col("_t")), "left_anti")
    nodes = tables.groupBy(F.upper(F.concat_ws(".", "schema_name", "table_name")).alias("object_name")).agg(F.min("object_type").alias("object_type"))
    numbered = metrics.ordinal_backfill(kept["attributes"].select(F.col("datasetNaturalKey").alias("dataset"), F.col("attributeNaturalKey").alias("pos"), F.col("ordinalPosition").alias("ordinal"), "dataType", "nullable"))
    columns = numbered.select(at, *split("dataset"), F.substring_index("pos", "|", -1).alias("column_name"), F.coalesce("dataType", F.lit("UNKNOWN")).alias("data_type"), F.coalesce("nullable", F.lit(True)).alias("nullable"), F.col("ordinal").alias("ordinal_position"))
    told = frames["tier3DatasetLineage"].select(F.col("sourceDatasetNaturalKey").alias("src_name"), F.col("targetDatasetNaturalKey").alias("dst_name"), F.col("stepNaturalKey").alias("step_key"))
    if names is not None:
        told = graph.repair_unknown(told, names.select("object_name"))
    known = kept["datasets"].select(F.upper("datasetNaturalKey").alias("k"))
    for more in ([] if attach_to is None else [attach_to.select(F.upper(F.concat_ws(".", "schema_name", "table_name")).alias("k"))]) + ([] if names is None else [names.select(F.upper("object_name").alias("k"))]):
        known = known.unionByName(more)
    known = known.distinct()
    edges = told.join(known.toDF("_s"), F.upper("src_name") == F.col("_s"), "left_semi").join(known.toDF("_d"), F.upper("dst_name") == F.col("_d"), "left_semi").groupBy("src_name", "dst_name").agg(F.min("step_key").alias("step_key"))
    attribute = kept["edges"].select(at, F.col("sourceAttributeNaturalKey").alias("source_key"), F.col("targetAttributeNaturalKey").alias("target_key"), "tier", "transformationType", "expression", "stepNaturalKey")
    out = {"tables": tables, "columns": columns, "nodes": nodes, "edges": edges, "attribute_lineage": attribute, "stats": kept["stats"]}
    lost = told.join(edges.select("src_name", "dst_name"), ["src_name", "dst_name"], "left_anti").agg(F.count("*").alias("n")).select(F.lit("dataset edges").alias("kind"), "n")
    if "processes" in frames and "steps" in frames:
        out["processes"] = frames["processes"].select(at, F.col("processNaturalKey").alias("process_key"), F.col("processType").alias("process_type"), F.col("processGroupNaturalKey").alias("group_key")).distinct()
        steps = frames["steps"].select(at, F.col("stepNaturalKey").alias("step_key"), F.col("processNaturalKey").alias("process_key"), F.col("stepLevel").alias("step_level"), F.col("stepType").alias("step_type"), F.col("parentStepNaturalKey").alias("parent_step_key")).distinct()
        out["steps"] = steps.join(out["processes"].select("process_key").distinct(), "process_key", "left_semi").select(steps.columns)
        lost = lost.unionByName(steps.join(out["processes"].select("process_key").distinct(), "process_key", "left_anti").agg(F.count("*").alias("n")).select(F.lit("steps").alias("kind"), "n"))
    return out | {"orphans": lost}


def resolve_entities(tables: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(source_system, object_name, entity_type, first_seen, last_seen, is_active) over the tables of all snapshots(snapshot_id, source_system,
    is_baseline): active if seen at or after the source's last baseline."""
    seen = tables.join(F.broadcast(snapshots.select("snapshot_id", "source_system")), "snapshot_id")
    per = seen.groupBy("source_system", F.upper(F.concat_ws(".", "schema_name", "table_name")).alias("object_name")).agg(F.min("snapshot_id").alias("first_seen"), F.max("snapshot_id").alias("last_seen"), F.max_by("object_type", "snapshot_id").alias("entity_type"))
    last = snapshots.where("is_baseline").groupBy("source_system").agg(F.max("snapshot_id").alias("_b"))
    return per.join(F.broadcast(last), "source_system", "left").withColumn("is_active", F.col("last_seen") >= F.coalesce("_b", F.lit(0))).drop("_b")


def told_usage(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """records(database_name, table_name, column_name, object_type, query_count, distinct_user_count, last_accessed) with node_id and outcome. Rows of
    columns go by the column's name, others by the table's."""
    column = F.col("object_type") == "Col"
    name = F.when(column, F.coalesce("column_name", "table_name")).otherwise(F.col("table_name"))
    rows = records.withColumns({"schema_name": F.col("database_name"), "object_name": name})
    told = metrics.usage_outcomes(metrics.resolve_usage(rows, nodes), USAGE_TYPES)
    return told.select("node_id", "schema_name", "object_name", "object_type", "query_count", "distinct_user_count", "last_accessed", "outcome")


def kept_usage(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage events that resolve to a node, and outcome counts, from told_usage()."""
    kept = told.where("outcome = 'inserted'").select("node_id", "schema_name", "object_name", lookup(USAGE_TYPES, F.col("object_type")).alias("object_type"), "query_count", F.col("distinct_user_count").alias("user_count"), "last_accessed")
    return kept, told.groupBy("outcome", "object_type").agg(F.count("*").alias("n"))


def ingest_usage(records: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usage events that resolve to a node, and outcome counts, from records as told_usage() takes them."""
    return kept_usage(told_usage(records, nodes))


def ingest_people(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """People by user name: the first row by `position` wins, filled in only where nothing is known."""
    return org.merge_first(existing, _placed(incoming), "username", "position")


def ingest_applications(existing: DataFrame, incoming: DataFrame, teams: DataFrame) -> dict[str, DataFrame]:
    """applications(application, description, owner_team), schema_map and table_map after incoming(application_name, description, schema_name,
    table_name, owner_team, position). Of a new application the first row counts; a known one only gets an owner that it lacks. Owners must be known teams.
    Every schema named is mapped, a table only together with its schema; names are upper-cased."""
    rows = _placed(incoming).where("application_name is not null").join(teams.select(F.col("team").alias("owner_team"), F.lit(True).alias("_known")).distinct(), "owner_team", "left")
    rows = rows.withColumn("owner_team", F.when(F.col("_known"), F.col("owner_team")))
    first = rows.groupBy(F.col("application_name").alias("application")).agg(F.min_by(F.struct("description", "owner_team"), "position").alias("new"))
    both = existing.withColumn("_old", F.lit(True)).join(first, "application", "full_outer")
    apps = both.select("application", F.when(F.col("_old"), F.col("description")).otherwise(F.col("new.description")).alias("description"), F.coalesce("owner_team", "new.owner_team").alias("owner_team"))
    mapped = rows.where("schema_name is not null").select(F.upper("schema_name").alias("schema_name"), F.upper("table_name").alias("table_name"), F.col("application_name").alias("application"))
    return {"applications": apps, "schema_map": mapped.select("schema_name", "application").distinct(), "table_map": mapped.where("table_name is not null").distinct()}


def post_ingest(tables: DataFrame, columns: DataFrame, snapshots: DataFrame, baseline: int, snapshot_id: int, usage: DataFrame | None = None) -> dict[str, DataFrame]:
    """What follows an ingest, in order: hash, metrics, graph, node metrics, criticality, changes since the baseline, alerts, impacts, validation,
    entities, cumulative count. Frames are lazy: a step that can't be planned, or that lacks an earlier one, is logged and left out and the others go
    on; what fails while a frame is computed fails in the action that reads it. Changes are numbered by a hash of the pair, the object and the change."""
    now_t, now_c = tables.where(F.col("snapshot_id") == snapshot_id), columns.where(F.col("snapshot_id") == snapshot_id)
    out: dict[str, DataFrame] = {}

    def step(name, make):
        try:
            out[name] = make()
        except Exception:
            log.exception("post-ingest step %s failed", name)

    def build():
        nodes, edges = graph.build_graph(now_t, now_c)
        nodes = nodes.withColumn("node_id", F.xxhash64("object_type", "object_name")).withColumn("schema_name", F.substring_index("object_name", ".", 1))
        ids = nodes.groupBy("object_name").agg(F.min("node_id").alias("id"))
        out["edges"] = edges.join(ids.toDF("src_name", "src"), "src_name").join(ids.toDF("dst_name", "dst"), "dst_name").select("src", "dst", "relationship_type")
        return nodes

    step("hash", lambda: metrics.structural_hash(now_t, now_c))
    step("metrics", lambda: metrics.snapshot_metrics(now_t, now_c))
    step("nodes", build)
    step("node_metrics", lambda: graph.node_metrics(out["nodes"], out["edges"]))
    step("criticality", lambda: metrics.criticality(out["node_metrics"], usage))
    step("changes", lambda: diff.compute_diff(tables, columns, baseline, snapshot_id).withColumn("change_id", F.xxhash64(F.lit(baseline), F.lit(snapshot_id), "object_identifier", "change_type")).withColumn("detected_at", F.current_timestamp()))
    step("alerts", lambda: graph.proactive_alerts(out["nodes"], out["edges"], out["changes"]))
    step("impacts", lambda: graph.impact_summaries(out["changes"], out["nodes"], out["edges"].where("relationship_type = 'FEEDS'")))
    step("validation", lambda: quality.validate_snapshot(now_t, now_c))
    step("entities", lambda: resolve_entities(tables, snapshots))
    step("cumulative", lambda: metrics.cumulative_count(tables, baseline, snapshot_id))
    return out


def _some(spark: SparkSession, pattern: str) -> list[str]:
    """The files that match, if any: a listing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return [str(f.getPath()) for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []]


def unified_import(spark: SparkSession, landing: str, snapshot_id: int) -> dict[str, DataFrame]:
    """A landing folder with catalog, usage and lineage files as one snapshot: the catalog's frames, then usage resolved to its nodes, then
    lineage documents (lineage*.json) attached to the same snapshot. Files that are not there give empty frames; without lineage there are no
    lineage_* frames. Criticality counts usage if there are any usage rows. Tables, nodes, edges and resolved usage are stored when this is called, as
    other frames come from them, and usage files are read once; a record of a wrong arity in the files behind them makes the call fail, one in others the
    frame it belongs to."""
    view = lambda pattern, name, **more: readers.read_view(spark, _some(spark, f"{landing}/{pattern}"), name, **more)
    made = build_snapshot(
        snapshot_id, view("databasesv_*.dat", "databases"), view("tablesv_*.dat", "tables", position=True), view("columnsv_*.dat", "columns"), view("indicesv_*.dat", "indices"), view("partitioningconstraintsv_*.dat", "partitioning"),
        view("tabletextv_*.dat", "tabletext"),
    )
    made["tables"] = stored(made["tables"])
    nodes, edges = graph.build_graph(made["tables"], made["columns"])
    documents = _some(spark, f"{landing}/lineage*.json")
    if documents:
        attached = ingest_lineage(readers.read_lineage(spark, documents), snapshot_id, attach_to=made["tables"], names=nodes.select("object_name"))
        made |= {f"lineage_{name}": df for name, df in attached.items()}
        nodes = nodes.unionByName(attached["nodes"].select(nodes.columns)).distinct()
        fed = attached["edges"].select(F.upper("src_name").alias("src_name"), F.upper("dst_name").alias("dst_name"), F.lit("FEEDS").alias("relationship_type"))
        edges = edges.unionByName(fed).distinct()
    nodes = stored(nodes.withColumn("node_id", F.xxhash64("object_type", "object_name")).withColumn("schema_name", F.substring_index("object_name", ".", 1)))
    ids = nodes.groupBy("object_name").agg(F.min("node_id").alias("id"))
    edges = stored(edges.join(ids.toDF("src_name", "src"), "src_name").join(ids.toDF("dst_name", "dst"), "dst_name").select("src", "dst", "relationship_type"))
    usage, outcomes = kept_usage(stored(told_usage(view("pdcr_object_usage_*.dat", "object_usage"), nodes)))
    return made | {"nodes": nodes, "edges": edges, "usage": usage, "outcomes": outcomes, "criticality": metrics.criticality(graph.node_metrics(nodes, edges), None if usage.isEmpty() else usage)}
