"""Counts, rates and scores over snapshots, changes, usage and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.exprs import leaf, parent_object, schema_of, share
from shiftlens.operators.diff import consecutive_pairs, severity_rank
from shiftlens.operators.rollups import is_rollup, sums


def snapshot_metrics(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per snapshot_id: schemas, tables (all that isn't a view), views, columns and their total without columns."""
    t = tables.groupBy("snapshot_id").agg(F.count_distinct("schema_name").alias("schemas"), F.count_if(F.col("object_type") != "VIEW").alias("tables"), F.count_if(F.col("object_type") == "VIEW").alias("views"))
    c = columns.groupBy("snapshot_id").agg(F.count("*").alias("columns"))
    return t.join(c, "snapshot_id", "left").na.fill(0, ["columns"]).withColumn("total", F.col("schemas") + F.col("tables") + F.col("views"))


def growth_rate(changes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per (snapshot_from, snapshot_to): added, removed, net, and net as a percentage of the first snapshot's total."""
    has = lambda *parts: F.count_if(F.col("change_type").like("%" + "%".join(parts) + "%"))
    per = changes.groupBy("snapshot_from", "snapshot_to").agg(
        has("ADDED").alias("added"), has("REMOVED").alias("removed"), has("SCHEMA", "ADDED").alias("schemas_added"), has("SCHEMA", "REMOVED").alias("schemas_removed"), has("TABLE", "ADDED").alias("tables_added"), has("TABLE", "REMOVED").alias("tables_removed")
    )
    first = metrics.select(F.col("snapshot_id").alias("snapshot_from"), F.col("total").alias("_t"))
    net = F.col("added") - F.col("removed")
    return per.join(F.broadcast(first), "snapshot_from", "left").withColumns({"net": net, "growth_pct": F.round(net / F.greatest(F.coalesce("_t", F.lit(0)), F.lit(1)) * 100, 2)}).drop("_t")


def change_density(changes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per pair: changes over the second snapshot's total objects."""
    n = changes.groupBy("snapshot_from", "snapshot_to").agg(F.count("*").alias("n_changes"))
    return n.join(F.broadcast(metrics.select(F.col("snapshot_id").alias("snapshot_to"), F.col("total").alias("_t"))), "snapshot_to", "left").withColumn("density", share("n_changes", F.coalesce("_t", F.lit(0)))).drop("_t")


def volatility_index(changes: DataFrame, snapshots: DataFrame, metrics: DataFrame) -> DataFrame:
    """Mean over neighbouring snapshots of changes per object of the later one; 0 with fewer than two snapshots."""
    pairs = consecutive_pairs(snapshots)
    n = sums(changes, "snapshot_from", "snapshot_to").select("snapshot_from", "snapshot_to", F.col("n_changes").alias("n"))
    both = pairs.join(n, ["snapshot_from", "snapshot_to"], "left").join(metrics.select(F.col("snapshot_id").alias("snapshot_to"), "total"), "snapshot_to", "left")
    return both.agg(F.round(F.coalesce(F.avg(F.coalesce("n", F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))), F.lit(0.0)), 6).alias("volatility"), F.count("*").alias("pairs"))


def criticality(nodes: DataFrame, usage: DataFrame | None, w_usage: float = 0.6, w_graph: float = 0.4, high: float = 0.6, medium: float = 0.3) -> DataFrame:
    """nodes(object_name, fragility) with usage_score, graph_score, combined and level. Usage is the share of the greatest
    sum of queries; names without any take the sum over their bare name. Without usage the graph decides alone."""
    nodes = nodes.withColumn("graph_score", F.col("fragility"))
    if usage is None:
        out = nodes.withColumns({"usage_score": F.lit(0.0), "combined": F.round("graph_score", 4)})
    else:
        exact = usage.groupBy(F.upper("object_name").alias("_k")).agg(F.sum("query_count").alias("_q"))
        bare = usage.groupBy(F.upper(leaf("object_name")).alias("_b")).agg(F.sum("query_count").alias("_qb"))
        most = exact.agg(F.greatest(F.lit(1), F.max("_q")).alias("_m"))
        both = nodes.join(exact, F.upper("object_name") == F.col("_k"), "left").join(bare, F.upper(leaf("object_name")) == F.col("_b"), "left").join(F.broadcast(most))
        queries = F.when(F.coalesce("_q", F.lit(0)) > 0, F.col("_q")).otherwise(F.coalesce("_qb", F.lit(0)))
        both = both.withColumn("usage_score", F.round(queries / F.coalesce("_m", F.lit(1)), 4))
        out = both.withColumn("combined", F.round(w_usage * F.col("usage_score") + w_graph * F.col("graph_score"), 4)).drop("_k", "_q", "_b", "_qb", "_m")
    return out.withColumn("level", F.when(F.col("combined") >= high, "HIGH").when(F.col("combined") >= medium, "MEDIUM").otherwise("LOW"))


def criticality_counts(scores: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """(level, n, total): `total` is the number of scores, or the objects of a snapshot's one row of snapshot_metrics()."""
    total = scores.agg(F.count("*").alias("total")) if metrics is None else metrics.select((F.col("tables") + F.col("views")).alias("total"))
    return scores.groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(total))


def top_scores(scores: DataFrame, n: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("combined"), "object_name").limit(n)


def usage_summary(usage: DataFrame, n: int = 50, within: DataFrame | None = None) -> DataFrame:
    """Greatest sums of queries by object, type and schema; within(object_name) limits them to a snapshot's names."""
    if within is not None:
        usage = usage.join(within.select("object_name").distinct(), "object_name", "left_semi")
    per = usage.groupBy("object_name", "object_type", "schema_name").agg(F.sum("query_count").alias("total_queries"), F.max("user_count").alias("max_users"))
    return per.orderBy(F.desc("total_queries"), "object_name", "object_type").limit(n)


def object_usage_profile(usage: DataFrame, name: str, scores: DataFrame | None = None, schema: str | None = None) -> DataFrame:
    """Sum of queries, most users and last access of one object: by full name, or by the leaf alone, in a schema if one is given; case doesn't matter."""
    low = F.lower("object_name")
    hit = (low == name.lower()) if "." in name else (F.lower(leaf("object_name")) == name.lower())
    if schema is not None:
        hit &= F.lower("schema_name") == schema.lower()
    out = usage.where(hit).agg(F.coalesce(F.sum("query_count"), F.lit(0)).alias("total_queries"), F.max("user_count").alias("max_users"), F.max("last_accessed").alias("last_accessed")).withColumn("object_name", F.lit(name))
    if scores is None:
        return out
    level = scores.select(F.lower("object_name").alias("_k"), "level").groupBy("_k").agg(F.min("level").alias("level"))
    return out.join(level, F.lower("object_name") == F.col("_k"), "left").drop("_k")


def resolve_usage(usage: DataFrame, nodes: DataFrame) -> DataFrame:
    """usage with node_id by (schema, bare name) without case; null for orphans. The catalog's nodes are joined as Spark sees fit."""
    ids = nodes.groupBy(F.lower("schema_name").alias("_s"), F.lower(leaf("object_name")).alias("_n")).agg(F.max("node_id").alias("node_id"))
    return usage.join(ids, (F.lower("schema_name") == F.col("_s")) & (F.lower(leaf("object_name")) == F.col("_n")), "left").drop("_s", "_n")


def attach_usage(changes: DataFrame, usage: DataFrame) -> DataFrame:
    """changes with query_count of the object: by its full name, else its table's, else its short table name. The latest usage row
    of a name counts; of names that share a short one, the smallest."""
    last = usage.groupBy(F.lower("object_name").alias("k")).agg(F.max_by("query_count", F.struct("last_accessed", "object_type", "query_count")).alias("q"))
    short = last.groupBy(leaf("k").alias("k")).agg(F.min_by("q", "k").alias("q"))
    low = F.lower("object_identifier")
    parts = F.size(F.split(low, r"\."))
    keyed = changes.withColumns({"_f": low, "_t": F.when(parts >= 3, F.substring_index(low, ".", 2)), "_s": F.when(parts >= 2, F.get(F.split(low, r"\."), F.lit(1))).otherwise(low)})
    for key, table in (("_f", last), ("_t", last), ("_s", short)):
        keyed = keyed.join(table.select(F.col("k").alias(key), F.col("q").alias(f"q{key}")), key, "left")
    return keyed.withColumn("query_count", F.coalesce("q_f", "q_t", "q_s")).drop("_f", "_t", "_s", "q_f", "q_t", "q_s")


def domain_risk(schemas: DataFrame, changes: DataFrame, impacts: DataFrame | None, scores: DataFrame) -> DataFrame:
    """Per schema: changes, breaking ones, impacts and HIGH objects; their weighted score and level. A rollup with n_impacts stands for changes and impacts."""
    dom = lambda c: schema_of(c).alias("schema_name")
    c = sums(changes, "schema_name", impacts=impacts).toDF("schema_name", "changes", "breaking", "impacts")
    h = scores.where("level = 'HIGH'").groupBy(dom("object_name")).agg(F.count("*").alias("high_objects"))
    both = schemas.select("schema_name").distinct().join(c, "schema_name", "left").join(h, "schema_name", "left").na.fill(0)
    both = both.join(F.broadcast(both.agg(F.greatest(F.sum("changes"), F.lit(1)).alias("_total"))))
    total = F.col("_total")
    score = 0.3 * F.col("changes") / total + 0.3 * F.col("breaking") / F.greatest("changes", F.lit(1)) + 0.2 * F.least(F.col("impacts") / 10, F.lit(1.0)) + 0.2 * F.least(F.col("high_objects") / 3, F.lit(1.0))
    out = both.withColumn("score", F.round(score, 4)).drop("_total")
    return out.withColumn("level", F.when(F.col("score") >= 0.5, "HIGH").when(F.col("score") >= 0.2, "MEDIUM").otherwise("LOW"))


def governance_scorecard(volatility: DataFrame, changes: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: health = 1 less capped penalties for volatility, breaking changes and HIGH objects, with its level."""
    one = volatility.select("volatility").join(F.broadcast(sums(changes).select(F.coalesce("n_breaking", F.lit(0)).alias("breaking")))).join(F.broadcast(scores.agg(F.count_if(F.col("level") == "HIGH").alias("high_objects"))))
    health = F.greatest(F.lit(0.0), 1 - F.least(2 * F.col("volatility"), F.lit(0.3)) - F.least(0.1 * F.col("breaking"), F.lit(0.3)) - F.least(0.05 * F.col("high_objects"), F.lit(0.2)))
    one = one.withColumn("health", F.round(health, 4))
    return one.withColumn("status", F.when(F.col("health") >= 0.7, "HEALTHY").when(F.col("health") >= 0.4, "AT_RISK").otherwise("CRITICAL"))


def stability(changes: DataFrame, snapshots: DataFrame, name: str) -> DataFrame:
    """Neighbouring pairs checked, those with a change whose identifier holds the name, and the share without; 1 with no pairs."""
    hit = changes.where(F.contains("object_identifier", F.lit(name))).select("snapshot_from", "snapshot_to").distinct().withColumn("_h", F.lit(True))
    out = consecutive_pairs(snapshots).join(hit, ["snapshot_from", "snapshot_to"], "left").agg(F.count("*").alias("pairs"), F.count_if("_h").alias("changed"))
    score = F.when(F.col("pairs") == 0, 1.0).otherwise(F.round(1 - F.col("changed") / F.greatest("pairs", F.lit(1)), 4))
    return out.withColumn("stability", score).withColumn("is_stable", F.col("stability") >= 0.7)


def batch_impact(changes: DataFrame, impacts: DataFrame, usage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blast radius of many changes: one row of totals with the overall risk, and buckets (dimension, value, n) from one
    pass of grouping sets."""
    both = attach_usage(changes, usage).join(impacts, "change_id", "left")
    table = F.when(F.col("object_type") != "SCHEMA", F.upper(parent_object("object_identifier", "object_type")))
    domain = F.upper(schema_of("object_identifier"))
    risky = (F.col("severity") == "HIGH") & F.col("is_breaking")
    total = both.agg(
        F.count("*").alias("changes"), F.coalesce(F.sum("direct"), F.lit(0)).alias("direct"), F.coalesce(F.sum("indirect"), F.lit(0)).alias("indirect"), F.max("max_depth").alias("max_depth"), F.round(F.sum("score"), 2).alias("score"),
        F.count_distinct(domain).alias("schemas"), F.count_distinct(table).alias("tables"), F.coalesce(F.sum("query_count"), F.lit(0)).alias("total_queries"),
        F.when((F.count_if("is_breaking") >= 3) | (F.count_if(risky) > 0), "HIGH").when((F.count_if("is_breaking") > 0) | (F.count_if(F.col("severity") == "HIGH") > 0), "MEDIUM").otherwise("LOW").alias("risk"),
    )
    keyed = both.select("severity", "change_type", domain.alias("domain"), F.col("is_breaking").cast("string").alias("breaking"))
    dims = ["severity", "change_type", "domain", "breaking"]
    sets = keyed.groupingSets([[F.col(x)] for x in dims], *dims).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"))
    named = F.element_at(F.create_map(*(F.lit(x) for k, v in ((7, "severity"), (11, "change_type"), (13, "domain"), (14, "breaking")) for x in (k, v))), F.col("_g").cast("int"))
    return total, sets.select(named.alias("dimension"), F.coalesce(*dims).alias("value"), "n").orderBy("dimension", severity_rank("value"), F.desc("n"), "value")


def landscape(nodes: DataFrame, scores: DataFrame, changes: DataFrame, snapshots: DataFrame, entities: DataFrame | None = None, teams: DataFrame | None = None, apps: DataFrame | None = None) -> DataFrame:
    """One row: the latest snapshot, objects, HIGH objects, and changes into that snapshot; with them given also entities and those that are
    active, teams and applications."""
    latest = snapshots.agg(F.max_by("snapshot_id", F.struct("snapshot_date", "snapshot_id")).alias("snapshot_id"))
    n = changes.join(F.broadcast(latest), changes.snapshot_to == latest.snapshot_id, "left_semi").agg(F.count("*").alias("changes"))
    out = latest.join(F.broadcast(nodes.agg(F.count("*").alias("objects")))).join(F.broadcast(scores.agg(F.count_if(F.col("level") == "HIGH").alias("high_objects")))).join(F.broadcast(n))
    if entities is not None:
        out = out.join(F.broadcast(entities.agg(F.count("*").alias("entities"), F.count_if("is_active").alias("active_entities"))))
    for name, df in (("teams", teams), ("applications", apps)):
        if df is not None:
            out = out.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return out


def changed_high_risk(scores: DataFrame, changes: DataFrame) -> DataFrame:
    """HIGH objects that have a change."""
    return scores.where("level = 'HIGH'").join(changes.select(F.lower("object_identifier").alias("_k")).distinct(), F.lower("object_name") == F.col("_k"), "left_semi")


def risk_overview(scores: DataFrame, changes: DataFrame, n: int = 10) -> DataFrame:
    """(section, name, value): how many objects each level has, the n highest scores, and the changed HIGH objects."""
    level = scores.groupBy(F.col("level").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("level").alias("section"), "name", "value")
    top = top_scores(scores, n).select(F.lit("top").alias("section"), F.col("object_name").alias("name"), F.col("combined").alias("value"))
    changed = changed_high_risk(scores, changes).select(F.lit("changed").alias("section"), F.col("object_name").alias("name"), F.col("combined").alias("value"))
    return level.unionByName(top).unionByName(changed)


def schema_risk_rollup(scores: DataFrame) -> DataFrame:
    per = scores.groupBy(schema_of("object_name").alias("schema_name")).agg(F.count("*").alias("total"), *(F.count_if(F.col("level") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")), F.round(F.avg("combined"), 4).alias("avg_score"))
    return per.orderBy(F.desc("high"), F.desc("avg_score"), "schema_name")


def schema_drill(scores: DataFrame, schema: str, n: int = 100) -> DataFrame:
    """A schema's objects, the riskiest first."""
    return scores.where(F.startswith(F.upper("object_name"), F.lit(f"{schema.upper()}."))).orderBy(F.desc("combined"), "object_name").limit(n)


def snapshot_detail(**children: DataFrame) -> DataFrame:
    """Rows per snapshot_id of each child table, in one column each."""
    out = None
    for name, df in children.items():
        n = df.groupBy("snapshot_id").agg(F.count("*").alias(name))
        out = n if out is None else out.join(n, "snapshot_id", "full_outer")
    return out.na.fill(0)


def cumulative_count(tables: DataFrame, baseline: int, snapshot: int) -> DataFrame:
    """Distinct tables over the baseline and the snapshot."""
    return tables.where(F.col("snapshot_id").isin(baseline, snapshot)).select("schema_name", "table_name").distinct().agg(F.count("*").alias("n"))


def inventory(tables: DataFrame, n: int = 30) -> DataFrame:
    """The n schemas with most tables, and the rest in one row."""
    per = tables.groupBy("schema_name").agg(F.count("*").alias("n_tables"))
    order = Window.orderBy(F.desc("n_tables"), "schema_name")
    ranked = per.withColumn("_r", F.row_number().over(order))  # one row a schema
    return ranked.groupBy(F.when(F.col("_r") <= n, F.col("schema_name")).otherwise("(rest)").alias("schema_name")).agg(F.count("*").alias("n_schemas"), F.sum("n_tables").alias("n_tables"))


def assemble_ddl(fragments: DataFrame) -> DataFrame:
    """Texts of (database_name, table_name) joined in order of seq, a null seq counting as 0, with the number of fragments."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(0)).alias("seq"), F.col("text"))))
    return fragments.groupBy("database_name", "table_name").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("ddl"), F.count("*").alias("fragments"))


def reassemble_queries(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row a query (query_id, collect_ts): its text from the fragments in order of sql_row_no, nulls last, and the first
    fragment's metadata. Fragments without a query id or time are invalid; queries in known(query_id, collect_ts) are left out."""
    good = log.where("query_id is not null and collect_ts is not null")
    order = F.struct(F.col("sql_row_no").isNull().alias("x"), F.col("sql_row_no").alias("n"), F.col("sql_text").alias("t"))
    out = good.groupBy("query_id", "collect_ts").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["t"]), "").alias("sql_text"), F.count("*").alias("fragments"), F.min_by("default_database", order).alias("default_database"))
    return out if known is None else out.join(known.select("query_id", "collect_ts"), ["query_id", "collect_ts"], "left_anti")


def usage_outcomes(usage: DataFrame, types: dict[str, str]) -> DataFrame:
    """usage(object_type, last_accessed, node_id) with its outcome: unmapped_type, invalid, orphan or inserted, whichever comes first."""
    known = F.col("object_type").isin(list(types))
    return usage.withColumn("outcome", F.when(~F.coalesce(known, F.lit(False)), "unmapped_type").when(F.col("last_accessed").isNull(), "invalid").when(F.col("node_id").isNull(), "orphan").otherwise("inserted"))


def structural_hash(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One digest a snapshot_id over sorted lines of tables and columns, in two levels: tables within schemas, schemas within
    the snapshot. Equal structures have equal digests; no level gathers more than one object's parts."""
    key = ["snapshot_id", "schema_name", "table_name"]
    line = F.concat_ws("|", F.lit("C:"), "column_name", "data_type", F.col("nullable").cast("string"), F.col("ordinal_position").cast("string"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), "\n")
    per_table = columns.groupBy(key).agg(joined(line).alias("_c"))
    t = tables.join(per_table, key, "left").select("snapshot_id", "schema_name", F.sha2(F.concat_ws("\n", F.concat_ws("|", F.lit("T:"), "table_name", "object_type"), F.coalesce("_c", F.lit(""))), 256).alias("_t"))
    s = t.groupBy("snapshot_id", "schema_name").agg(F.sha2(F.concat_ws("\n", F.concat(F.lit("S:"), F.col("schema_name")), joined("_t")), 256).alias("_s"))
    return s.groupBy("snapshot_id").agg(F.sha2(joined("_s"), 256).alias("structural_hash"))


def duplicate_records(records: DataFrame, n: int = 20) -> DataFrame:
    """The first n signatures of (collection, signature) that occur more than once."""
    return records.groupBy("collection", "signature").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "collection", "signature").limit(n)


def volatility_trend(changes: DataFrame, tables: DataFrame, snapshots: DataFrame, window: int = 3, history: int = 20) -> DataFrame:
    """Per schema over the last snapshots: rolling sums of distinct changed objects per table, the latest against the one before."""
    kept = snapshots.orderBy(F.desc("snapshot_date"), F.desc("snapshot_id")).limit(history).select("snapshot_id", "snapshot_date")
    schemas = tables.select("schema_name").distinct()
    changed = objects_changed(changes).withColumnRenamed("snapshot_to", "snapshot_id")
    sizes = tables.groupBy("snapshot_id", "schema_name").agg(F.count("*").alias("n_tables"))
    grid = schemas.crossJoin(F.broadcast(kept))  # a schema's row for each of at most `history` snapshots
    cells = grid.join(changed, ["schema_name", "snapshot_id"], "left").join(sizes, ["schema_name", "snapshot_id"], "left").na.fill(0, ["n_objects", "n_tables"])
    by = Window.partitionBy("schema_name").orderBy("snapshot_date", "snapshot_id")
    rolled = cells.withColumn("value", F.round(F.sum("n_objects").over(by.rowsBetween(1 - window, 0)) / F.greatest("n_tables", F.lit(1)), 4)).withColumn("prior", F.lag("value").over(by)).withColumn("_last", F.lead("snapshot_id").over(by).isNull())
    delta = F.when(F.col("prior") > 0, F.round((F.col("value") - F.col("prior")) / F.col("prior") * 100, 2)).when(F.col("value") > 0, 100.0).otherwise(0.0)
    out = rolled.where("_last").select("schema_name", F.col("value").alias("current"), F.coalesce("prior", F.lit(0.0)).alias("previous"), F.when(F.col("prior").isNull(), F.when(F.col("value") > 0, 100.0).otherwise(0.0)).otherwise(delta).alias("delta_pct"))
    trend = F.when(F.col("delta_pct") > 5, "worsening").when(F.col("delta_pct") < -5, "improving").otherwise("stable")
    rank = F.when(F.col("trend") == "worsening", 0).when(F.col("trend") == "stable", 1).otherwise(2)
    return out.withColumn("trend", trend).orderBy(rank, F.desc("current"), "schema_name")


def objects_changed(changes: DataFrame) -> DataFrame:
    """Distinct objects with changes per schema and snapshot_to; columns count as their table."""
    if is_rollup(changes):
        return changes.groupBy("schema_name", "snapshot_to").agg(F.count_distinct("object_name").alias("n_objects"))
    return changes.groupBy(schema_of("object_identifier").alias("schema_name"), "snapshot_to").agg(F.count_distinct(parent_object("object_identifier", "object_type")).alias("n_objects"))


def assign_baselines(snapshots: DataFrame, gap_days: int = 7) -> DataFrame:
    """Per source by time: is_baseline, is_gap (more than gap_days after the one before) and the baseline that is active."""
    by = Window.partitionBy("source_system").orderBy("snapshot_date", "snapshot_id")
    gap = F.date_diff("snapshot_date", F.lag("snapshot_date").over(by))
    out = snapshots.withColumns({"is_gap": F.coalesce(gap > gap_days, F.lit(False)), "is_baseline": gap.isNull() | (gap > gap_days)})
    return out.withColumn("baseline_id", F.last(F.when(F.col("is_baseline"), F.col("snapshot_id")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def latest_full(snapshots: DataFrame) -> DataFrame:
    """Per source: the latest full snapshot, and the one before it."""
    by = Window.partitionBy("source_system").orderBy(F.desc("snapshot_date"), F.desc("snapshot_id"))
    ranked = snapshots.where("is_full").withColumn("_r", F.row_number().over(by)).where("_r <= 2")
    return ranked.groupBy("source_system").agg(F.max(F.when(F.col("_r") == 1, F.col("snapshot_id"))).alias("latest"), F.max(F.when(F.col("_r") == 2, F.col("snapshot_id"))).alias("second"))


def dedup_latest(tables: DataFrame, key: list[str], ts: str, pos: str) -> DataFrame:
    """The row of greatest ts for each key; nulls lose, ties keep the first by pos."""
    by = Window.partitionBy(*key).orderBy(F.desc_nulls_last(ts), pos)
    return tables.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def ordinal_backfill(attributes: DataFrame) -> DataFrame:
    """attributes(dataset, pos, ordinal) with missing ordinals numbered in order of pos."""
    by = Window.partitionBy("dataset", F.col("ordinal").isNull()).orderBy("pos")
    return attributes.withColumn("ordinal", F.coalesce("ordinal", F.row_number().over(by).cast("long")))


def entity_history(changes: DataFrame, usage: DataFrame, name: str, scores: DataFrame | None = None) -> DataFrame:
    """One row: the number of changes and of snapshots they led to, and the queries by day as a series; with scores(snapshot_id, object_name,
    combined, level) also the criticality by snapshot as a series."""
    c = changes.where(F.lower("object_identifier") == name.lower()).agg(F.count("*").alias("changes"), F.count_distinct("snapshot_to").alias("snapshots"))
    day = usage.where(F.lower("object_name") == name.lower()).groupBy(F.to_date("last_accessed").cast("string").alias("day")).agg(F.sum("query_count").alias("q"))
    series = day.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "q"))), lambda x: F.concat(x["day"], F.lit("="), x["q"].cast("string"))), ",").alias("series"))
    out = c.join(F.broadcast(series)).withColumn("object_name", F.lit(name))
    if scores is None:
        return out
    point = lambda x: F.concat(x["snapshot_id"].cast("string"), F.lit("="), F.format_string("%.4f", x["combined"]), F.lit(" "), x["level"])
    own = scores.where(F.lower("object_name") == name.lower())
    return out.join(F.broadcast(own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("snapshot_id", "combined", "level"))), point), ",").alias("criticality"))))

