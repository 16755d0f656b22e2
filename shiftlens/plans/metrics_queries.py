"""Queries of metrics over snapshots, changes and usage, and of mined patterns."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shiftlens.functions import exprs
from shiftlens.operators import diff, graph, metrics, mining, rollups
from shiftlens.plans import ingest
from shiftlens.plans.graph_queries import SUMMARIES as _SUMMARIES
from shiftlens.plans.registry import SQL, query
from shiftlens.sources import writers
from shiftlens.sources.shared import shared_folder

_SM = """sm AS (SELECT snapshot_id, schemas, tables, views, coalesce(columns, 0) AS columns, schemas + tables + views AS total FROM (SELECT snapshot_id, count(DISTINCT schema_name) AS schemas, count(*) FILTER (WHERE object_type <> 'VIEW') AS tables, count(*) FILTER (WHERE object_type = 'VIEW') AS views FROM tabs GROUP BY 1)
LEFT JOIN (SELECT snapshot_id, count(*) AS columns FROM cols GROUP BY 1) USING (snapshot_id))"""
_NM = """nm AS (SELECT node_id, object_name, object_type, schema_name, round(o / greatest(max(o) OVER (), 1), 4) AS fragility FROM (SELECT node.*, coalesce(n, 0) AS o FROM node LEFT JOIN (SELECT src, count(*) AS n FROM edge GROUP BY 1) ON src = node_id))"""
_CR = (
    _NM
    + """, ue AS (SELECT upper(object_name) AS k, sum(query_count) AS q FROM usage GROUP BY 1), ub AS (SELECT upper(split_part(object_name, '.', 2)) AS k, sum(query_count) AS q FROM usage GROUP BY 1),
cs AS (SELECT node_id, object_name, object_type, schema_name, fragility AS graph_score, round(CASE WHEN coalesce(ue.q, 0) > 0 THEN ue.q ELSE coalesce(ub.q, 0) END / (SELECT greatest(1, max(q)) FROM ue), 4) AS usage_score FROM nm LEFT JOIN ue ON ue.k = upper(object_name) LEFT JOIN ub ON ub.k = upper(split_part(object_name, '.', 2))),
cr AS (SELECT *, round(0.6 * usage_score + 0.4 * graph_score, 4) AS combined, CASE WHEN round(0.6 * usage_score + 0.4 * graph_score, 4) >= 0.6 THEN 'HIGH' WHEN round(0.6 * usage_score + 0.4 * graph_score, 4) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM cs)"""
)


def _metrics(d):
    return metrics.snapshot_metrics(d.tabs, d.cols)


def _scores(d):
    return metrics.criticality(graph.node_metrics(d.node, d.edge), d.usage)


@query(f"WITH {_SM} SELECT * FROM sm")
def agg1_snapshot_metrics(d):
    return _metrics(d)


@query(
    f"""WITH {_SM}, g AS (SELECT snapshot_from, snapshot_to, count(*) FILTER (WHERE change_type LIKE '%ADDED%') AS added, count(*) FILTER (WHERE change_type LIKE '%REMOVED%') AS removed, count(*) FILTER (WHERE change_type = 'SCHEMA_ADDED') AS schemas_added, count(*) FILTER (WHERE change_type = 'SCHEMA_REMOVED') AS schemas_removed,
count(*) FILTER (WHERE change_type = 'TABLE_ADDED') AS tables_added, count(*) FILTER (WHERE change_type = 'TABLE_REMOVED') AS tables_removed FROM chg GROUP BY 1, 2) SELECT g.*, added - removed AS net, round((added - removed) / greatest(coalesce(total, 0), 1) * 100, 2) AS growth_pct FROM g LEFT JOIN sm ON snapshot_id = snapshot_from"""
)
def agg2_growth_rate(d):
    return metrics.growth_rate(d.chg, _metrics(d))


@query(
    f"""WITH {_SM}, p AS (SELECT snapshot_id AS snapshot_from, lead(snapshot_id) OVER (ORDER BY snapshot_date, snapshot_id) AS snapshot_to FROM snap QUALIFY snapshot_to IS NOT NULL), c AS (SELECT snapshot_from, snapshot_to, count(*) AS n FROM chg GROUP BY 1, 2)
SELECT round(coalesce(avg(coalesce(n, 0) / greatest(total, 1)), 0), 6) AS volatility, count(*) AS pairs FROM p LEFT JOIN c USING (snapshot_from, snapshot_to) LEFT JOIN sm ON snapshot_id = p.snapshot_to"""
)
def agg3_volatility_index(d):
    return metrics.volatility_index(d.chg, d.snap, _metrics(d))


@query(f"WITH {_SM}, c AS (SELECT snapshot_from, snapshot_to, count(*) AS n_changes FROM chg GROUP BY 1, 2) SELECT c.*, round(n_changes / greatest(coalesce(total, 0), 1), 4) AS density FROM c LEFT JOIN sm ON snapshot_id = snapshot_to")
def agg4_change_density(d):
    return metrics.change_density(d.chg, _metrics(d))


@query(f"WITH {_CR} SELECT node_id, graph_score, usage_score, combined, level FROM cr")
def agg6_criticality(d):
    return _scores(d).select("node_id", "graph_score", "usage_score", "combined", "level")


@query(f"WITH {_CR} SELECT level, count(*) AS n, (SELECT count(*) FROM cr) AS total FROM cr GROUP BY 1")
def agg7_criticality_counts(d):
    return metrics.criticality_counts(_scores(d))


@query(f"WITH {_CR} SELECT level, count(*) AS n, (SELECT count(*) FROM tabs WHERE snapshot_id = 3) AS total FROM cr GROUP BY 1")
def agg7_counts_of_snapshot(d):
    """Levels next to the number of objects that the snapshot's metrics give."""
    return metrics.criticality_counts(_scores(d), metrics.snapshot_metrics(d.tabs.where("snapshot_id = 3"), d.cols.where("snapshot_id = 3")))


@query(f"WITH {_CR} SELECT object_name, combined FROM cr ORDER BY combined DESC, object_name LIMIT 10")
def srt1_top_scores(d):
    return metrics.top_scores(_scores(d)).select("object_name", "combined")


@query("SELECT object_name, object_type, schema_name, CAST(sum(query_count) AS BIGINT) AS total_queries, max(user_count) AS max_users FROM usage WHERE object_name IN (SELECT object_name FROM node) GROUP BY 1, 2, 3 ORDER BY total_queries DESC, object_name, object_type LIMIT 50")
def agg8_usage_summary(d):
    return metrics.usage_summary(d.usage, 50, d.node)


@query(f"WITH {_CR} SELECT 's3.t3' AS object_name, CAST(sum(query_count) AS BIGINT) AS total_queries, max(user_count) AS max_users, max(last_accessed) AS last_accessed, (SELECT min(level) FROM cr WHERE lower(object_name) = 's3.t3') AS level FROM usage WHERE lower(object_name) = 's3.t3'")
def agg9_object_usage_profile(d):
    return metrics.object_usage_profile(d.usage, "s3.t3", _scores(d))


@query("SELECT 'T3' AS object_name, CAST(sum(query_count) AS BIGINT) AS total_queries, max(user_count) AS max_users, max(last_accessed) AS last_accessed FROM usage WHERE lower(split_part(object_name, '.', 2)) = 't3' AND schema_name = 'S3'")
def agg9_leaf_in_schema(d):
    return metrics.object_usage_profile(d.usage, "T3", schema="s3")


_IMPACTS = """im AS (SELECT change_id, change_id % 5 AS direct, change_id % 3 AS indirect, change_id % 4 AS max_depth, round(change_id % 7 / 4, 4) AS score FROM chg)"""


def _impacts(d):
    return d.chg.select("change_id", (F.col("change_id") % 5).alias("direct"), (F.col("change_id") % 3).alias("indirect"), (F.col("change_id") % 4).alias("max_depth"), F.round(F.col("change_id") % 7 / 4, 4).alias("score"))


@query(
    f"""WITH {_CR}, {_IMPACTS}, c AS (SELECT split_part(object_identifier, '.', 1) AS schema_name, count(*) AS changes, count(*) FILTER (WHERE is_breaking) AS breaking, CAST(sum(direct + indirect) AS BIGINT) AS impacts FROM chg JOIN im USING (change_id) GROUP BY 1),
h AS (SELECT split_part(object_name, '.', 1) AS schema_name, count(*) AS high_objects FROM cr WHERE level = 'HIGH' GROUP BY 1), b AS (SELECT s.schema_name, coalesce(changes, 0) AS changes, coalesce(breaking, 0) AS breaking, coalesce(impacts, 0) AS impacts, coalesce(high_objects, 0) AS high_objects FROM (SELECT DISTINCT schema_name FROM node) s LEFT JOIN c USING (schema_name) LEFT JOIN h USING (schema_name)),
x AS (SELECT *, round(0.3 * changes / greatest((SELECT sum(changes) FROM b), 1) + 0.3 * breaking / greatest(changes, 1) + 0.2 * least(impacts / 10, 1.0) + 0.2 * least(high_objects / 3, 1.0), 4) AS score FROM b)
SELECT *, CASE WHEN score >= 0.5 THEN 'HIGH' WHEN score >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM x"""
)
def agg10_domain_risk(d):
    return metrics.domain_risk(d.node, d.chg, _impacts(d), _scores(d))


@query(
    f"""WITH {_CR}, {_SM}, pr AS (SELECT snapshot_id AS snapshot_from, lead(snapshot_id) OVER (ORDER BY snapshot_date, snapshot_id) AS snapshot_to FROM snap QUALIFY snapshot_to IS NOT NULL), vc AS (SELECT snapshot_from, snapshot_to, count(*) AS n FROM chg GROUP BY 1, 2),
v AS (SELECT round(coalesce(avg(coalesce(n, 0) / greatest(total, 1)), 0), 6) AS volatility FROM pr LEFT JOIN vc USING (snapshot_from, snapshot_to) LEFT JOIN sm ON snapshot_id = pr.snapshot_to), o AS (SELECT volatility, (SELECT count(*) FROM chg WHERE is_breaking) AS breaking, (SELECT count(*) FROM cr WHERE level = 'HIGH') AS high_objects FROM v)
SELECT CAST(volatility AS DOUBLE) AS volatility, breaking, high_objects, CAST(round(greatest(0, 1 - least(2 * volatility, 0.3) - least(0.1 * breaking, 0.3) - least(0.05 * high_objects, 0.2)), 4) AS DOUBLE) AS health,
CASE WHEN greatest(0, 1 - least(2 * volatility, 0.3) - least(0.1 * breaking, 0.3) - least(0.05 * high_objects, 0.2)) >= 0.7 THEN 'HEALTHY' WHEN greatest(0, 1 - least(2 * volatility, 0.3) - least(0.1 * breaking, 0.3) - least(0.05 * high_objects, 0.2)) >= 0.4 THEN 'AT_RISK' ELSE 'CRITICAL' END AS status FROM o"""
)
def agg11_governance_scorecard(d):
    return metrics.governance_scorecard(metrics.volatility_index(d.chg, d.snap, _metrics(d)), d.chg, _scores(d))


@query(
    """WITH p AS (SELECT snapshot_id AS snapshot_from, lead(snapshot_id) OVER (ORDER BY snapshot_date, snapshot_id) AS snapshot_to FROM months QUALIFY snapshot_to IS NOT NULL), h AS (SELECT DISTINCT snapshot_from, snapshot_to FROM chg WHERE contains(object_identifier, 'S3.T27.C4'))
SELECT count(*) AS pairs, count(h.snapshot_from) AS changed, round(1 - count(h.snapshot_from) / count(*), 4) AS stability, round(1 - count(h.snapshot_from) / count(*), 4) >= 0.7 AS is_stable FROM p LEFT JOIN h USING (snapshot_from, snapshot_to)"""
)
def agg12_stability(d):
    return metrics.stability(d.chg, d.months, "S3.T27.C4")


_AU = """ul AS (SELECT lower(object_name) AS k, arg_max(query_count, {'a': last_accessed, 'b': object_type, 'c': query_count}) AS q FROM usage GROUP BY 1), us AS (SELECT split_part(k, '.', 2) AS k, arg_min(q, k) AS q FROM ul GROUP BY 1),
au AS (SELECT c.*, coalesce(f.q, t.q, s.q) AS query_count FROM chg c LEFT JOIN ul f ON f.k = lower(object_identifier) LEFT JOIN ul t ON object_type = 'COLUMN' AND t.k = lower(split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2)) LEFT JOIN us s ON s.k = lower(CASE WHEN object_type = 'SCHEMA' THEN object_identifier ELSE split_part(object_identifier, '.', 2) END))"""


@query(f"WITH {_AU} SELECT change_id, query_count FROM au")
def jn5_attach_usage(d):
    return metrics.attach_usage(d.chg, d.usage).select("change_id", "query_count")


@query(
    f"""WITH RECURSIVE {_SUMMARIES}, {_AU}, im AS (SELECT change_id, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, coalesce(max_depth, 0) AS max_depth, coalesce(score, 0) AS score FROM l LEFT JOIN s ON start = node_id) SELECT count(*) AS changes, CAST(sum(direct) AS BIGINT) AS direct, CAST(sum(indirect) AS BIGINT) AS indirect, max(max_depth) AS max_depth, round(sum(score), 2) AS score, count(DISTINCT upper(split_part(object_identifier, '.', 1))) AS schemas,
count(DISTINCT CASE WHEN object_type <> 'SCHEMA' THEN upper(split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2)) END) AS tables, CAST(coalesce(sum(query_count), 0) AS BIGINT) AS total_queries,
CASE WHEN count(*) FILTER (WHERE is_breaking) >= 3 OR bool_or(severity = 'HIGH' AND is_breaking) THEN 'HIGH' WHEN bool_or(is_breaking) OR bool_or(severity = 'HIGH') THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM au JOIN im USING (change_id)"""
)
def agg14_batch_impact(d):
    return metrics.batch_impact(d.chg, graph.impact_summaries(d.chg, d.node, d.edge), d.usage)[0]


@query(
    """SELECT CASE WHEN g = 7 THEN 'severity' WHEN g = 11 THEN 'change_type' WHEN g = 13 THEN 'domain' ELSE 'breaking' END AS dimension, coalesce(severity, change_type, dom, brk) AS value, n FROM (SELECT severity, change_type, dom, brk, grouping(severity, change_type, dom, brk) AS g, count(*) AS n
FROM (SELECT severity, change_type, upper(split_part(object_identifier, '.', 1)) AS dom, CAST(is_breaking AS VARCHAR) AS brk FROM chg) GROUP BY GROUPING SETS ((severity), (change_type), (dom), (brk)))"""
)
def agg14_impact_buckets(d):
    return metrics.batch_impact(d.chg, _impacts(d), d.usage)[1]


@query(f"WITH {_CR}, l AS (SELECT snapshot_id FROM months ORDER BY snapshot_date DESC LIMIT 1) SELECT (FROM l) AS snapshot_id, (SELECT count(*) FROM node) AS objects, (SELECT count(*) FROM cr WHERE level = 'HIGH') AS high_objects, (SELECT count(*) FROM chg WHERE snapshot_to = (FROM l)) AS changes")
def agg15_landscape(d):
    return metrics.landscape(d.node, _scores(d), d.chg, d.months)


_ACTIVE = """se AS (SELECT source_system, upper(schema_name || '.' || table_name) AS k, max(snapshot_id) AS last_seen FROM tabs JOIN snap USING (snapshot_id) WHERE NOT (snapshot_id > 3 AND table_name LIKE 'T1%') GROUP BY 1, 2), ba AS (SELECT source_system, max(snapshot_id) AS b FROM snap WHERE snapshot_id IN (1, 4, 6) GROUP BY 1)"""


@query(f"WITH {_CR}, {_ACTIVE}, l AS (SELECT snapshot_id FROM months ORDER BY snapshot_date DESC LIMIT 1) SELECT (FROM l) AS snapshot_id, (SELECT count(*) FROM node) AS objects, (SELECT count(*) FROM cr WHERE level = 'HIGH') AS high_objects, (SELECT count(*) FROM chg WHERE snapshot_to = (FROM l)) AS changes, (SELECT count(*) FROM se) AS entities, (SELECT count(*) FROM se LEFT JOIN ba USING (source_system) WHERE last_seen >= coalesce(b, 0)) AS active_entities, (SELECT count(*) FROM team) AS teams, (SELECT count(*) FROM app) AS applications")
def agg15_landscape_whole(d):
    entities = ingest.resolve_entities(d.tabs.where("not (snapshot_id > 3 and table_name like 'T1%')"), d.snap.withColumn("is_baseline", F.col("snapshot_id").isin(1, 4, 6)))
    return metrics.landscape(d.node, _scores(d), d.chg, d.months, entities, d.team, d.app)


@query(
    f"""WITH {_CR}, t AS (SELECT object_name, combined FROM cr ORDER BY combined DESC, object_name LIMIT 10) SELECT 'level' AS section, level AS name, CAST(count(*) AS DOUBLE) AS value FROM cr GROUP BY 2 UNION ALL SELECT 'top', object_name, combined FROM t
UNION ALL SELECT 'changed', object_name, combined FROM cr WHERE level = 'HIGH' AND lower(object_name) IN (SELECT lower(object_identifier) FROM chg)"""
)
def agg15_risk_overview(d):
    return metrics.risk_overview(_scores(d), d.chg)


@query(f"WITH {_CR} SELECT object_name, combined FROM cr WHERE level = 'HIGH' AND lower(object_name) IN (SELECT lower(object_identifier) FROM chg)")
def jn9_changed_high_risk(d):
    return metrics.changed_high_risk(_scores(d), d.chg).select("object_name", "combined")


@query(f"WITH {_CR} SELECT schema_name, count(*) AS total, count(*) FILTER (WHERE level = 'HIGH') AS high, count(*) FILTER (WHERE level = 'MEDIUM') AS medium, count(*) FILTER (WHERE level = 'LOW') AS low, round(avg(combined), 4) AS avg_score FROM cr GROUP BY 1")
def agg16_schema_risk_rollup(d):
    return metrics.schema_risk_rollup(_scores(d))


@query(f"WITH {_CR} SELECT object_name, combined, level FROM cr WHERE schema_name = 'S3' ORDER BY combined DESC, object_name LIMIT 100")
def agg16_schema_drill(d):
    return metrics.schema_drill(_scores(d), "s3").select("object_name", "combined", "level")


@query("SELECT snapshot_id, (SELECT count(*) FROM tabs t WHERE t.snapshot_id = s.snapshot_id) AS tables, (SELECT count(*) FROM cols c WHERE c.snapshot_id = s.snapshot_id) AS columns, (SELECT count(*) FROM chg c WHERE c.snapshot_to = s.snapshot_id) AS changes FROM snap s UNION ALL SELECT snapshot_to, 0, 0, count(*) FROM chg WHERE snapshot_to NOT IN (SELECT snapshot_id FROM snap) GROUP BY 1")
def agg18_snapshot_detail(d):
    return metrics.snapshot_detail(tables=d.tabs, columns=d.cols, changes=d.chg.withColumnRenamed("snapshot_to", "snapshot_id"))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT schema_name, table_name FROM tabs WHERE snapshot_id IN (1, 5))")
def agg19_cumulative_count(d):
    return metrics.cumulative_count(d.tabs, 1, 5)


@query("WITH p AS (SELECT schema_name, count(*) AS n FROM tabs WHERE snapshot_id = 3 GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, schema_name) AS r FROM p) SELECT CASE WHEN r <= 7 THEN schema_name ELSE '(rest)' END AS schema_name, count(*) AS n_schemas, CAST(sum(n) AS BIGINT) AS n_tables FROM r GROUP BY 1")
def agg20_inventory(d):
    return metrics.inventory(d.tabs.where("snapshot_id = 3"), 7)


@query("SELECT 'db' || (conv_id % 7) AS database_name, 't' || conv_id AS table_name, string_agg(text, '' ORDER BY CASE WHEN turn = 1 THEN 0 ELSE turn END, text) AS ddl, count(*) AS fragments FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2")
def agg21_assemble_ddl(d):
    parts = d.conversations.where("text is not null").select(F.expr("'db' || (conv_id % 7)").alias("database_name"), F.expr("'t' || conv_id").alias("table_name"), F.expr("nullif(turn, 1)").alias("seq"), "text")
    return metrics.assemble_ddl(parts)


_LOG = "SELECT conv_id AS query_id, CAST('2024-05-01' AS DATE) AS collect_ts, nullif(turn, 2) AS sql_row_no, text AS sql_text, role AS default_database FROM {conversations} WHERE text IS NOT NULL"


@query(
    "WITH log AS (" + _LOG.replace("{conversations}", "conversations") + """) SELECT query_id, string_agg(sql_text, '' ORDER BY sql_row_no NULLS LAST, sql_text) AS sql_text, count(*) AS fragments, arg_min(default_database, {'x': sql_row_no IS NULL, 'n': coalesce(sql_row_no, -1), 't': sql_text}) AS default_database FROM log WHERE query_id % 10 <> 3 GROUP BY 1"""
)
def agg22_reassemble_queries(d):
    log = d.spark.sql(_LOG, conversations=d.conversations)
    known = log.where("query_id % 10 = 3").select("query_id", "collect_ts").distinct()
    return metrics.reassemble_queries(log, known).drop("collect_ts")


_USE = "SELECT CASE event_id % 6 WHEN 0 THEN 'Tab' WHEN 1 THEN 'Viw' WHEN 2 THEN 'UDF' WHEN 3 THEN 'Col' WHEN 4 THEN NULL ELSE 'SP' END AS object_type, CASE WHEN event_id % 13 = 0 THEN NULL ELSE last_accessed END AS last_accessed, 's' || (username % 14) AS schema_name, 's' || (username % 14) || '.t' || (username % 61) AS object_name FROM {usage}"


@query(
    "WITH u AS (" + _USE.replace("{usage}", "usage") + "), n AS (SELECT lower(schema_name) AS s, lower(split_part(object_name, '.', 2)) AS b, max(node_id) AS node_id FROM node GROUP BY 1, 2) SELECT CASE WHEN object_type IS NULL OR object_type NOT IN ('Col', 'Tab', 'Viw', 'Idx', 'Mac', 'Vol') THEN 'unmapped_type' WHEN last_accessed IS NULL THEN 'invalid' WHEN node_id IS NULL THEN 'orphan' ELSE 'inserted' END AS outcome, object_type, count(*) AS n FROM u LEFT JOIN n ON s = schema_name AND b = split_part(u.object_name, '.', 2) GROUP BY 1, 2"
)
def agg23_usage_outcomes(d):
    use = metrics.resolve_usage(d.spark.sql(_USE, usage=d.usage), d.node)
    return metrics.usage_outcomes(use, exprs.USAGE_TYPES).groupBy("outcome", "object_type").agg(F.count("*").alias("n"))


@query("SELECT event_id, node_id FROM usage u LEFT JOIN (SELECT lower(schema_name) AS s, lower(split_part(object_name, '.', 2)) AS b, max(node_id) AS node_id FROM node WHERE node_id % 4 <> 1 GROUP BY 1, 2) ON s = lower(u.schema_name) AND b = lower(split_part(u.object_name, '.', 2))")
def jn4_resolve_usage(d):
    return metrics.resolve_usage(d.usage, d.node.where("node_id % 4 <> 1")).select("event_id", "node_id")


@query(
    r"""WITH c AS (SELECT snapshot_id, schema_name, table_name, string_agg('C:|' || column_name || '|' || data_type || '|' || nullable || '|' || ordinal_position, chr(10) ORDER BY 'C:|' || column_name || '|' || data_type || '|' || nullable || '|' || ordinal_position) AS c FROM cols GROUP BY 1, 2, 3),
t AS (SELECT snapshot_id, schema_name, sha256('T:|' || table_name || '|' || object_type || chr(10) || coalesce(c, '')) AS t FROM tabs LEFT JOIN c USING (snapshot_id, schema_name, table_name)), s AS (SELECT snapshot_id, sha256('S:' || schema_name || chr(10) || string_agg(t, chr(10) ORDER BY t)) AS s FROM t GROUP BY snapshot_id, schema_name)
SELECT snapshot_id, sha256(string_agg(s, chr(10) ORDER BY s)) AS structural_hash FROM s GROUP BY 1"""
)
def agg24_structural_hash(d):
    return metrics.structural_hash(d.tabs, d.cols)


@query("SELECT tier AS collection, source_key || target_key AS signature, count(*) AS n FROM lineage GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, collection, signature LIMIT 20")
def agg25_duplicate_records(d):
    return metrics.duplicate_records(d.lineage.select(F.col("tier").alias("collection"), F.concat("source_key", "target_key").alias("signature")))


@query(
    """WITH o AS (SELECT split_part(object_identifier, '.', 1) AS schema_name, snapshot_to AS snapshot_id, count(DISTINCT CASE WHEN object_type = 'COLUMN' THEN split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2) ELSE object_identifier END) AS n FROM chg GROUP BY 1, 2),
z AS (SELECT node_id % 9 + 1 AS snapshot_id, schema_name, count(*) AS t FROM node GROUP BY 1, 2), k AS (SELECT * FROM months ORDER BY snapshot_date DESC LIMIT 6),
g AS (SELECT s.schema_name, k.snapshot_id, snapshot_date, coalesce(n, 0) AS n, coalesce(t, 0) AS t FROM (SELECT DISTINCT schema_name FROM node) s CROSS JOIN k LEFT JOIN o USING (schema_name, snapshot_id) LEFT JOIN z USING (schema_name, snapshot_id)),
v AS (SELECT *, round(sum(n) OVER (PARTITION BY schema_name ORDER BY snapshot_date, snapshot_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / greatest(t, 1), 4) AS value FROM g), w AS (SELECT *, lag(value) OVER (PARTITION BY schema_name ORDER BY snapshot_date, snapshot_id) AS prior, row_number() OVER (PARTITION BY schema_name ORDER BY snapshot_date DESC, snapshot_id DESC) AS r FROM v),
x AS (SELECT schema_name, value AS "current", coalesce(prior, 0) AS previous, CASE WHEN prior > 0 THEN round((value - prior) / prior * 100, 2) WHEN value > 0 THEN 100.0 ELSE 0.0 END AS delta_pct FROM w WHERE r = 1)
SELECT *, CASE WHEN delta_pct > 5 THEN 'worsening' WHEN delta_pct < -5 THEN 'improving' ELSE 'stable' END AS trend FROM x"""
)
def win1_volatility_trend(d):
    tables = d.node.select((F.col("node_id") % 9 + 1).alias("snapshot_id"), "schema_name")
    return metrics.volatility_trend(d.chg, tables, d.months, 3, 6)


@query("SELECT split_part(object_identifier, '.', 1) AS schema_name, snapshot_to, count(DISTINCT CASE WHEN object_type = 'COLUMN' THEN split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2) ELSE object_identifier END) AS n_objects FROM chg GROUP BY 1, 2")
def min3_objects_changed(d):
    return metrics.objects_changed(d.chg)


@query(
    """WITH g AS (SELECT *, snapshot_date - lag(snapshot_date) OVER (PARTITION BY source_system ORDER BY snapshot_date, snapshot_id) AS gap FROM snap), b AS (SELECT *, coalesce(gap > 14, false) AS is_gap, gap IS NULL OR gap > 14 AS is_baseline FROM g)
SELECT snapshot_id, is_gap, is_baseline, last_value(CASE WHEN is_baseline THEN snapshot_id END IGNORE NULLS) OVER (PARTITION BY source_system ORDER BY snapshot_date, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS baseline_id FROM b"""
)
def win2_assign_baselines(d):
    return metrics.assign_baselines(d.snap, 14).select("snapshot_id", "is_gap", "is_baseline", "baseline_id")


@query("WITH r AS (SELECT source_system, snapshot_id, row_number() OVER (PARTITION BY source_system ORDER BY snapshot_date DESC, snapshot_id DESC) AS r FROM snap WHERE is_full) SELECT source_system, max(snapshot_id) FILTER (WHERE r = 1) AS latest, max(snapshot_id) FILTER (WHERE r = 2) AS second FROM r GROUP BY 1")
def win3_latest_full(d):
    return metrics.latest_full(d.snap)


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) = 1")
def win4_dedup_latest(d):
    rows = d.orders.select("o_custkey", "o_orderkey", F.expr("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END").alias("ts"))
    return metrics.dedup_latest(rows, ["o_custkey"], "ts", "o_orderkey").drop("ts")


@query("SELECT l_orderkey AS dataset, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10 ELSE row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 = 0 ORDER BY l_linenumber) END AS ordinal FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)")
def win5_ordinal_backfill(d):
    rows = d.lineitem.select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("dataset"), F.col("l_linenumber").alias("pos"), F.expr("CASE WHEN l_linenumber % 2 = 0 THEN cast(l_linenumber * 10 as bigint) END").alias("ordinal"))
    return metrics.ordinal_backfill(rows)


@query("SELECT 's5.t5' AS object_name, (SELECT count(*) FROM chg WHERE lower(object_identifier) = 's5.t5') AS changes, (SELECT count(DISTINCT snapshot_to) FROM chg WHERE lower(object_identifier) = 's5.t5') AS snapshots, (SELECT string_agg(d || '=' || q, ',' ORDER BY d) FROM (SELECT CAST(CAST(last_accessed AS DATE) AS VARCHAR) AS d, sum(query_count) AS q FROM usage WHERE lower(object_name) = 's5.t5' GROUP BY 1)) AS series")
def win6_entity_history(d):
    return metrics.entity_history(d.chg, d.usage, "s5.t5")


@query("SELECT 's5.t5' AS object_name, (SELECT count(*) FROM chg WHERE lower(object_identifier) = 's5.t5') AS changes, (SELECT string_agg(snapshot_id || '=' || printf('%.4f', combined) || ' ' || level, ',' ORDER BY snapshot_id) FROM (SELECT month(last_accessed) AS snapshot_id, round(avg(query_count), 4) AS combined, CASE WHEN avg(query_count) > 48 THEN 'HIGH' ELSE 'LOW' END AS level FROM usage WHERE lower(object_name) = 's5.t5' GROUP BY 1)) AS criticality")
def win6_criticality_series(d):
    """Criticality by month, here the mean of the queries."""
    scores = d.usage.groupBy(F.month("last_accessed").alias("snapshot_id"), "object_name").agg(F.avg("query_count").alias("m")).select("snapshot_id", "object_name", F.round("m", 4).alias("combined"), F.when(F.col("m") > 48, "HIGH").otherwise("LOW").alias("level"))
    return metrics.entity_history(d.chg, d.usage, "s5.t5", scores).select("object_name", "changes", "criticality")


@query(
    """WITH c AS (SELECT split_part(object_identifier, '.', 1) AS schema_name, snapshot_to, count(*) AS n FROM chg GROUP BY 1, 2),
g AS (SELECT s.schema_name, m.snapshot_id AS snapshot_to, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT schema_name FROM c) s CROSS JOIN months m LEFT JOIN c ON c.schema_name = s.schema_name AND c.snapshot_to = m.snapshot_id),
l AS (SELECT a.schema_name, a.snapshot_to, a.n, avg(b.n) AS mean, stddev_pop(b.n) AS sd, count(b.n) AS m FROM g a JOIN g b ON a.schema_name = b.schema_name AND a.snapshot_to <> b.snapshot_to GROUP BY 1, 2, 3),
z AS (SELECT *, round(CASE WHEN sd > 0 THEN (n - mean) / sd WHEN n > mean THEN 3.0 WHEN n < mean THEN -3.0 END, 4) AS z FROM l WHERE m >= 3)
SELECT schema_name, snapshot_to, n, z, CASE WHEN abs(z) >= 3 THEN 'HIGH' WHEN abs(z) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM z WHERE abs(z) >= 1.5"""
)
def min1_change_anomalies(d):
    return mining.change_anomalies(d.chg, d.months, 1.5)


#: Snapshots of twenty orders each: their number grows with the orders, not their size.
_RULES = "SELECT change_id, change_id // 20 - 1 AS snapshot_from, change_id // 20 AS snapshot_to, object_type, object_identifier FROM chg"


_COCHANGE = f"""WITH r AS ({_RULES}), p AS (SELECT snapshot_from, snapshot_to FROM r GROUP BY 1, 2 HAVING count(*) <= 500 ORDER BY snapshot_to DESC LIMIT 20), i AS (SELECT DISTINCT snapshot_to, CASE WHEN object_type = 'COLUMN' THEN split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2) ELSE object_identifier END AS item FROM r SEMI JOIN p USING (snapshot_from, snapshot_to)),
b AS (SELECT snapshot_to FROM i GROUP BY 1 HAVING count(*) >= 2), j AS (SELECT * FROM i SEMI JOIN b USING (snapshot_to)), n AS (SELECT item, count(*) AS n FROM j GROUP BY 1), q AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM j x JOIN j y ON x.snapshot_to = y.snapshot_to AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT CASE WHEN na.n <= nb.n THEN a ELSE b END AS antecedent, CASE WHEN na.n <= nb.n THEN b ELSE a END AS consequent, support, round(support / least(na.n, nb.n), 4) AS confidence, round(support * (SELECT count(*) FROM b) / (na.n * nb.n), 4) AS lift FROM q JOIN n na ON na.item = a JOIN n nb ON nb.item = b)
SELECT * FROM s WHERE lift >= 1.5 ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 50"""


@query(_COCHANGE)
def min2_cochange_rules(d):
    pair = F.expr("change_id div 20")
    return mining.cochange_rules(d.chg.withColumns({"snapshot_from": pair - 1, "snapshot_to": pair}))


#: Snapshots of 480 orders each, whose customers stand for tables: large baskets of many different objects.
_WIDE = "SELECT o_orderkey // 480 - 1 AS snapshot_from, o_orderkey // 480 AS snapshot_to, 'TABLE' AS object_type, 'S' || (o_custkey % 12) || '.T' || o_custkey AS object_identifier FROM orders"


@query(_COCHANGE.replace(_RULES, _WIDE))
def min2_large_baskets(d):
    """Baskets just below the rule's greatest."""
    pair = F.expr("o_orderkey div 480")
    name = F.expr("concat('S', o_custkey % 12, '.T', o_custkey)")
    return mining.cochange_rules(d.orders.select((pair - 1).alias("snapshot_from"), pair.alias("snapshot_to"), F.lit("TABLE").alias("object_type"), name.alias("object_identifier")))


_NAMES = "SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'email_addr' WHEN 1 THEN 'ssn' WHEN 2 THEN 'birth_dt' WHEN 3 THEN 'phone_no' WHEN 4 THEN 'zip_code' WHEN 5 THEN 'cust_name' WHEN 6 THEN 'iban' WHEN 7 THEN 'user_id' ELSE replace(p_name, ' ', '_') END || '_' || p_size AS column_name FROM {part}"


@query(
    "WITH c AS (" + _NAMES.replace("{part}", "part") + """) SELECT id, CASE WHEN column_name LIKE 'email%' THEN 'EMAIL' WHEN column_name LIKE 'ssn%' THEN 'SSN' WHEN column_name LIKE 'birth_dt%' THEN 'DOB' WHEN column_name LIKE 'phone%' THEN 'PHONE' WHEN column_name LIKE 'zip_code%' THEN 'ADDRESS' WHEN column_name LIKE 'cust_name%' THEN 'NAME' WHEN column_name LIKE 'iban%' THEN 'FINANCIAL' WHEN column_name LIKE 'user_id%' THEN 'ID_NUMBER' ELSE 'NONE' END AS pii_label,
CAST(CASE WHEN column_name LIKE 'email%' THEN 0.95 WHEN column_name LIKE 'ssn%' OR column_name LIKE 'birth_dt%' THEN 0.97 WHEN column_name LIKE 'phone%' THEN 0.9 WHEN column_name LIKE 'cust_name%' THEN 0.92 WHEN column_name LIKE 'iban%' THEN 0.88 ELSE 0.85 END AS DOUBLE) AS pii_confidence FROM c"""
)
def min4_pii_classify(d):
    return mining.pii_classify(d.spark.sql(_NAMES, part=d.part)).drop("column_name")


@query("WITH c AS (" + _NAMES.replace("{part}", "part") + ") SELECT id, CASE WHEN id % 2 = 0 THEN 'KEPT' WHEN r <= 25 THEN CASE WHEN id % 11 = 1 THEN 'SSN' ELSE 'other' END END AS pii_label FROM (SELECT *, row_number() OVER (PARTITION BY id % 2 ORDER BY id) AS r FROM c)")
def min4_budget(d):
    """Labels on all even columns, and a budget for 25 of the others."""
    named = d.spark.sql(_NAMES, part=d.part).withColumns({"pii_label": F.expr("if(id % 2 = 0, 'KEPT', null)"), "pii_confidence": F.expr("if(id % 2 = 0, 1.0D, null)")})
    done = mining.pii_classify(named, budget=25, key=("id",))
    return done.select("id", F.expr("if(pii_label in ('KEPT', 'SSN') or pii_label is null, pii_label, 'other')").alias("pii_label"))


@query("SELECT change_type, change_id % 5 AS n_impacts, CASE WHEN is_breaking AND change_id % 5 > 2 THEN 'HIGH' WHEN is_breaking THEN 'MEDIUM' ELSE 'LOW' END AS risk, count(*) AS n FROM chg GROUP BY ALL")
def min5_change_risk(d):
    return mining.change_risk(d.chg.withColumn("n_impacts", F.col("change_id") % 5)).groupBy("change_type", "n_impacts", "risk").agg(F.count("*").alias("n"))


@query("(SELECT CASE WHEN is_breaking THEN 'BREAKING_CHANGE' ELSE 'HIGH_SEVERITY' END AS alert_type, 'HIGH' AS severity, CAST(change_id AS VARCHAR) AS subject FROM chg WHERE is_breaking OR severity = 'HIGH' ORDER BY detected_at DESC, change_id DESC LIMIT 50) UNION ALL (SELECT 'ORPHAN_NODE', 'MEDIUM', object_name FROM node WHERE node_id NOT IN (SELECT src FROM edge WHERE src % 3 = 0 UNION SELECT dst FROM edge WHERE src % 3 = 0) ORDER BY object_name LIMIT 10)")
def min6_alerts_feed(d):
    structural = graph.proactive_alerts(d.node, d.edge.where("src % 3 = 0"), d.chg)
    return mining.alerts_feed(d.chg, structural.where("alert_type = 'ORPHAN_NODE'"))


@query("SELECT change_id, count(*) OVER () AS total FROM chg WHERE is_breaking ORDER BY change_id LIMIT 20 OFFSET 40")
def srt2_page(d):
    hit = d.chg.where("is_breaking")
    return hit.select("change_id").orderBy("change_id").offset(40).limit(20).join(F.broadcast(hit.agg(F.count("*").alias("total"))))


@query("SELECT change_id, severity FROM chg ORDER BY CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, change_id LIMIT 100")
def srt3_severity_order(d):
    return d.chg.select("change_id", "severity").orderBy(diff.severity_rank(), "change_id").limit(100)


@query("SELECT change_type, change_id FROM chg QUALIFY row_number() OVER (PARTITION BY change_type ORDER BY detected_at DESC, change_id DESC) <= 5")
def srt4_per_group_cap(d):
    by = Window.partitionBy("change_type").orderBy(F.desc("detected_at"), F.desc("change_id"))
    return d.chg.withColumn("_r", F.row_number().over(by)).where("_r <= 5").select("change_type", "change_id")


@query("SELECT CAST(snapshot_from AS BIGINT) AS snapshot_from, CAST(snapshot_to AS BIGINT) AS snapshot_to, split_part(object_identifier, '.', 1) AS schema_name, CASE WHEN object_type = 'COLUMN' THEN split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2) ELSE object_identifier END AS object_name, count(*) AS n_changes, count(*) FILTER (WHERE is_breaking) AS n_breaking FROM chg GROUP BY 1, 2, 3, 4")
def snk2_change_rollup(d):
    """The rollup that two appends leave, the second of which finds some pairs stored."""
    return _rollup(d).select(F.col("snapshot_from").cast("long").alias("snapshot_from"), F.col("snapshot_to").cast("long").alias("snapshot_to"), "schema_name", "object_name", "n_changes", "n_breaking")


def _rollup(d):
    root = f"{shared_folder(d.spark)}/files-{uuid.uuid4().hex}"
    writers.append_changes(d.chg.where("snapshot_to < 6"), root)
    writers.append_changes(d.chg, root)
    return d.spark.read.parquet(f"{root}/change_rollup")


@query(SQL["win1_volatility_trend"])
def win1_from_rollup(d):
    tables = d.node.select((F.col("node_id") % 9 + 1).alias("snapshot_id"), "schema_name")
    return metrics.volatility_trend(_rollup(d), tables, d.months, 3, 6)


@query(SQL["min1_change_anomalies"])
def min1_from_rollup(d):
    return mining.change_anomalies(_rollup(d), d.months, 1.5)


@query(SQL["agg11_governance_scorecard"])
def agg11_from_rollup(d):
    rolled = _rollup(d)
    return metrics.governance_scorecard(metrics.volatility_index(rolled, d.snap, _metrics(d)), rolled, _scores(d))


@query(SQL["agg10_domain_risk"])
def agg10_from_rollup(d):
    return metrics.domain_risk(d.node, rollups.change_rollup(d.chg, _impacts(d)), None, _scores(d))
