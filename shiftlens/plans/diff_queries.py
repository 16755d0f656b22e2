"""Queries of differences between snapshots and of stored changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.operators import diff
from shiftlens.plans.registry import query

_PAIR = """
WITH ta AS (SELECT * FROM tabs WHERE snapshot_id = 3), tb AS (SELECT * FROM tabs WHERE snapshot_id = 4),
ca AS (SELECT * FROM cols WHERE snapshot_id = 3), cb AS (SELECT * FROM cols WHERE snapshot_id = 4),
both_t AS (SELECT schema_name, table_name FROM ta INTERSECT SELECT schema_name, table_name FROM tb),
ds AS (SELECT CASE WHEN a.schema_name IS NULL THEN 'SCHEMA_ADDED' ELSE 'SCHEMA_REMOVED' END AS change_type, 'SCHEMA' AS object_type, coalesce(a.schema_name, b.schema_name) AS object_identifier,
              CASE WHEN a.schema_name IS NULL THEN NULL ELSE '{"schema_name":"' || a.schema_name || '"}' END AS before_state, CASE WHEN b.schema_name IS NULL THEN NULL ELSE '{"schema_name":"' || b.schema_name || '"}' END AS after_state
       FROM (SELECT DISTINCT schema_name FROM ta) a FULL JOIN (SELECT DISTINCT schema_name FROM tb) b ON a.schema_name = b.schema_name WHERE a.schema_name IS NULL OR b.schema_name IS NULL),
jt AS (SELECT coalesce(a.schema_name, b.schema_name) || '.' || coalesce(a.table_name, b.table_name) AS object_identifier, a.object_type AS a_type, b.object_type AS b_type, a.ddl_alter_timestamp AS ad, b.ddl_alter_timestamp AS bd,
              a.table_name IS NULL AS added, b.table_name IS NULL AS removed
       FROM ta a FULL JOIN tb b ON a.schema_name = b.schema_name AND a.table_name = b.table_name),
dt AS (SELECT 'TABLE_ADDED' AS change_type, 'TABLE' AS object_type, object_identifier, NULL AS before_state, '{"object_type":"' || b_type || '"}' AS after_state FROM jt WHERE added
       UNION ALL SELECT 'TABLE_REMOVED', 'TABLE', object_identifier, '{"object_type":"' || a_type || '"}', NULL FROM jt WHERE removed
       UNION ALL SELECT 'TABLE_TYPE_CHANGED', 'TABLE', object_identifier, '{"object_type":"' || a_type || '"}', '{"object_type":"' || b_type || '"}' FROM jt WHERE a_type <> b_type
       UNION ALL SELECT 'TABLE_DDL_CHANGED', 'TABLE', object_identifier, '{"ddl_alter_timestamp":"' || ad || '"}', '{"ddl_alter_timestamp":"' || bd || '"}' FROM jt WHERE a_type = b_type AND ad <> bd),
jc AS (SELECT coalesce(a.schema_name, b.schema_name) || '.' || coalesce(a.table_name, b.table_name) || '.' || coalesce(a.column_name, b.column_name) AS object_identifier,
              a.column_name IS NULL AS added, b.column_name IS NULL AS removed, a.data_type AS ad, b.data_type AS bd, a.nullable AS an, b.nullable AS bn, a.ordinal_position AS ap, b.ordinal_position AS bp,
              '{"data_type":"' || a.data_type || '","nullable":' || a.nullable || ',"ordinal_position":' || a.ordinal_position || '}' AS av, '{"data_type":"' || b.data_type || '","nullable":' || b.nullable || ',"ordinal_position":' || b.ordinal_position || '}' AS bv
       FROM (SELECT * FROM ca SEMI JOIN both_t USING (schema_name, table_name)) a FULL JOIN (SELECT * FROM cb SEMI JOIN both_t USING (schema_name, table_name)) b
         ON a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.column_name = b.column_name),
dc AS (SELECT 'COLUMN_ADDED' AS change_type, 'COLUMN' AS object_type, object_identifier, NULL AS before_state, bv AS after_state FROM jc WHERE added
       UNION ALL SELECT 'COLUMN_REMOVED', 'COLUMN', object_identifier, av, NULL FROM jc WHERE removed
       UNION ALL SELECT 'COLUMN_TYPE_CHANGED', 'COLUMN', object_identifier, '{"data_type":"' || ad || '"}', '{"data_type":"' || bd || '"}' FROM jc WHERE ad <> bd
       UNION ALL SELECT 'COLUMN_NULLABILITY_CHANGED', 'COLUMN', object_identifier, '{"nullable":' || an || '}', '{"nullable":' || bn || '}' FROM jc WHERE an <> bn
       UNION ALL SELECT 'COLUMN_POSITION_CHANGED', 'COLUMN', object_identifier, '{"ordinal_position":' || ap || '}', '{"ordinal_position":' || bp || '}' FROM jc WHERE ap <> bp),
changes AS (SELECT *, CASE WHEN change_type IN ('TABLE_REMOVED', 'SCHEMA_REMOVED', 'COLUMN_REMOVED', 'TABLE_TYPE_CHANGED') THEN 'HIGH' WHEN change_type IN ('COLUMN_TYPE_CHANGED', 'COLUMN_NULLABILITY_CHANGED', 'TABLE_DDL_CHANGED') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
              change_type IN ('TABLE_REMOVED', 'COLUMN_REMOVED', 'COLUMN_TYPE_CHANGED', 'SCHEMA_REMOVED', 'TABLE_TYPE_CHANGED') AS is_breaking
            FROM (SELECT * FROM ds UNION ALL SELECT * FROM dt UNION ALL SELECT * FROM dc))
"""
_COLUMNS = "change_type, object_type, object_identifier, before_state, after_state"


def _at(df, k):
    return df.where(F.col("snapshot_id") == k).drop("snapshot_id")


@query(_PAIR + f"SELECT {_COLUMNS} FROM ds")
def dif1_diff_schemas(d):
    return diff.diff_schemas(_at(d.tabs, 3), _at(d.tabs, 4))


@query(_PAIR + f"SELECT {_COLUMNS} FROM dt")
def dif2_diff_tables(d):
    return diff.diff_tables(_at(d.tabs, 3), _at(d.tabs, 4))


@query(_PAIR + f"SELECT {_COLUMNS} FROM dc")
def dif3_diff_columns(d):
    return diff.diff_columns(_at(d.cols, 3), _at(d.cols, 4))


@query("SELECT change_type, severity, is_breaking, count(*) AS n FROM chg GROUP BY ALL")
def dif4_classify(d):
    return diff.classify(d.chg.drop("severity", "is_breaking")).groupBy("change_type", "severity", "is_breaking").agg(F.count("*").alias("n"))


@query(_PAIR + f"SELECT {_COLUMNS}, severity, is_breaking, CAST(3 AS BIGINT) AS snapshot_from, CAST(4 AS BIGINT) AS snapshot_to FROM changes")
def dif5_compute_diff(d):
    return diff.compute_diff(d.tabs, d.cols, 3, 4)


@query(
    _PAIR
    + """, turned AS (SELECT CASE WHEN change_type LIKE '%ADDED' THEN replace(change_type, 'ADDED', 'REMOVED') WHEN change_type LIKE '%REMOVED' THEN replace(change_type, 'REMOVED', 'ADDED') ELSE change_type END AS change_type,
    object_type, object_identifier, after_state AS before_state, before_state AS after_state FROM changes)
SELECT change_type, object_type, count(*) AS n, count(before_state) AS n_before, count(after_state) AS n_after FROM turned GROUP BY ALL"""
)
def dif5_reverse(d):
    return diff.compute_diff(d.tabs, d.cols, 4, 3).groupBy("change_type", "object_type").agg(F.count("*").alias("n"), F.count("before_state").alias("n_before"), F.count("after_state").alias("n_after"))


@query(
    """WITH p AS (SELECT snapshot_id AS snapshot_from, lead(snapshot_id) OVER (ORDER BY snapshot_date, snapshot_id) AS snapshot_to FROM months WHERE snapshot_id BETWEEN 2 AND 6)
SELECT change_id, object_identifier, snapshot_from, snapshot_to FROM chg SEMI JOIN p USING (snapshot_from, snapshot_to)"""
)
def dif6_cumulative_changes(d):
    return diff.cumulative_changes(d.chg, d.months, 2, 6).select("change_id", "object_identifier", "snapshot_from", "snapshot_to")


@query(
    """SELECT change_id, object_identifier, snapshot_to, CAST(snapshot_date AS VARCHAR) AS snapshot_date, count(*) OVER () AS total, count(*) OVER () > 30 AS has_more FROM chg LEFT JOIN months ON snapshot_id = snapshot_to
WHERE object_identifier ILIKE '%s3.t%' ORDER BY snapshot_to, detected_at, change_id LIMIT 20 OFFSET 10"""
)
def dif7_timeline(d):
    return diff.timeline(d.chg, d.months, "s3.t", 10, 20).select("change_id", "object_identifier", "snapshot_to", F.col("snapshot_date").cast("string").alias("snapshot_date"), "total", "has_more")


@query("SELECT change_id, change_type, detected_at FROM chg ORDER BY detected_at DESC, change_id DESC LIMIT 20")
def dif8_recent_changes(d):
    return diff.recent_changes(d.chg).select("change_id", "change_type", "detected_at")


@query("SELECT change_id, severity, is_breaking FROM chg ORDER BY is_breaking DESC, CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, change_id LIMIT 50 OFFSET 25")
def dif9_diff_page(d):
    return diff.diff_page(d.chg, 25, 50).select("change_id", "severity", "is_breaking")


@query(
    _PAIR
    + r""", p AS (SELECT *, split_part(object_identifier, '.', 1) AS s, CASE WHEN object_type = 'SCHEMA' THEN object_identifier ELSE split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2) END AS t, split_part(object_identifier, '.', 3) AS c FROM changes)
SELECT object_identifier, change_type, CASE change_type
  WHEN 'TABLE_ADDED' THEN CASE WHEN after_state LIKE '%VIEW%' THEN 'CREATE VIEW ' || t || ' AS' || chr(10) || '    SELECT * FROM <source>;  -- TODO: define view query' ELSE 'CREATE TABLE ' || t || ' (' || chr(10) || '    -- columns to be defined' || chr(10) || ');' END
  WHEN 'TABLE_REMOVED' THEN 'DROP ' || json_extract_string(before_state, '$.object_type') || ' IF EXISTS ' || t || ';'
  WHEN 'TABLE_TYPE_CHANGED' THEN '-- Object type changed from ' || json_extract_string(before_state, '$.object_type') || ' to ' || json_extract_string(after_state, '$.object_type') || chr(10) || 'DROP ' || json_extract_string(before_state, '$.object_type') || ' IF EXISTS ' || t || ';' || chr(10)
       || CASE WHEN after_state LIKE '%VIEW%' THEN 'CREATE VIEW ' || t || ' AS' || chr(10) || '    SELECT * FROM <source>;  -- TODO: define view query' ELSE 'CREATE TABLE ' || t || ' (' || chr(10) || '    -- recreate with appropriate columns' || chr(10) || ');' END
  WHEN 'COLUMN_ADDED' THEN 'ALTER TABLE ' || t || ' ADD ' || c || ' ' || json_extract_string(after_state, '$.data_type') || CASE WHEN after_state LIKE '%"nullable":false%' THEN ' NOT NULL' ELSE '' END || ';'
  WHEN 'COLUMN_REMOVED' THEN 'ALTER TABLE ' || t || ' DROP COLUMN ' || c || ';'
  WHEN 'COLUMN_TYPE_CHANGED' THEN '-- Column type change: ' || json_extract_string(before_state, '$.data_type') || ' -> ' || json_extract_string(after_state, '$.data_type') || chr(10) || 'ALTER TABLE ' || t || ' ALTER COLUMN ' || c || ' SET DATA TYPE ' || json_extract_string(after_state, '$.data_type') || ';'
  WHEN 'COLUMN_NULLABILITY_CHANGED' THEN 'ALTER TABLE ' || t || ' ALTER COLUMN ' || c || CASE WHEN after_state LIKE '%false%' THEN ' SET' ELSE ' DROP' END || ' NOT NULL;'
  WHEN 'COLUMN_POSITION_CHANGED' THEN '-- Column position changed to ' || json_extract_string(after_state, '$.ordinal_position') || ' (requires table rebuild in most RDBMS)' || chr(10) || '-- ALTER TABLE ' || t || ' MODIFY ' || c || ' ... AFTER <preceding_column>;'
  WHEN 'SCHEMA_ADDED' THEN 'CREATE SCHEMA IF NOT EXISTS ' || s || ';' WHEN 'SCHEMA_REMOVED' THEN 'DROP SCHEMA IF EXISTS ' || s || ' CASCADE;'
  ELSE '-- Unsupported change type: ' || change_type || ' on ' || object_identifier END AS ddl_combined FROM p"""
)
def dif10_generate_ddl(d):
    return diff.generate_ddl(diff.compute_diff(d.tabs, d.cols, 3, 4)).select("object_identifier", "change_type", "ddl_combined")


@query(
    """WITH c AS (SELECT schema_name || '.' || table_name AS object_identifier, string_agg('    ' || column_name || ' ' || data_type || CASE WHEN nullable THEN '' ELSE ' NOT NULL' END, ',' || chr(10) ORDER BY ordinal_position, column_name) AS x FROM cols WHERE snapshot_id = 4 GROUP BY 1),
a AS (SELECT schema_name || '.' || table_name AS object_identifier FROM tabs WHERE snapshot_id = 4 AND object_type = 'TABLE')
SELECT object_identifier, 'CREATE TABLE ' || object_identifier || ' (' || chr(10) || coalesce(x, '    -- columns to be defined') || chr(10) || ');' AS ddl_combined FROM a LEFT JOIN c USING (object_identifier)"""
)
def dif10_create_tables(d):
    """All tables of a snapshot as if they were new, with their columns."""
    tables = _at(d.tabs, 4).where("object_type = 'TABLE'")
    new = tables.select(F.concat_ws(".", "schema_name", "table_name").alias("object_identifier"), F.lit("TABLE_ADDED").alias("change_type"), F.lit(None).cast("string").alias("before_state"), F.lit('{"object_type":"TABLE"}').alias("after_state"))
    return diff.generate_ddl(new, _at(d.cols, 4)).select("object_identifier", "ddl_combined")


_SIGNS = "SELECT tier AS collection, source_key || '>' || target_key AS signature FROM lineage WHERE step_key {} 'step9'"


@query(
    f"""WITH e AS ({_SIGNS.format('<=')}), a AS ({_SIGNS.format('>=')}), x AS (SELECT * FROM e EXCEPT ALL SELECT * FROM a), y AS (SELECT * FROM a EXCEPT ALL SELECT * FROM e)
SELECT 'missing' AS side, collection, signature, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT 'unexpected', collection, signature, count(*) FROM y GROUP BY ALL"""
)
def dif11_payload_diff(d):
    signs = d.lineage.select(F.col("tier").alias("collection"), F.concat("source_key", F.lit(">"), "target_key").alias("signature"), "step_key")
    return diff.payload_diff(signs.where("step_key <= 'step9'").drop("step_key"), signs.where("step_key >= 'step9'").drop("step_key"))


@query(
    """WITH o AS (SELECT change_type, object_identifier = 'S5.T5' AS exact FROM chg WHERE object_identifier = 'S5.T5' OR object_identifier LIKE 'S5.T5.%')
SELECT 'S5.T5' AS object_identifier, CASE WHEN count(*) FILTER (WHERE exact AND change_type LIKE '%ADDED') > 0 THEN 'added' WHEN count(*) FILTER (WHERE exact AND change_type LIKE '%REMOVED') > 0 THEN 'dropped' WHEN count(*) > 0 THEN 'changed' ELSE 'unchanged' END AS outcome, count(*) AS n_changes FROM o"""
)
def dif12_change_outcome(d):
    return diff.change_outcome(d.chg, "S5.T5")


@query(
    """WITH t AS (SELECT DISTINCT schema_name || '.' || table_name AS object_identifier FROM tabs WHERE snapshot_id = 2),
c AS (SELECT 'Brand#' || (11 + change_id % 15) || '.T' || (change_id % 45) AS object_identifier, object_type, change_type FROM chg WHERE object_type <> 'SCHEMA'),
o AS (SELECT object_identifier, min(CASE WHEN change_type = 'TABLE_ADDED' THEN 0 WHEN change_type = 'TABLE_REMOVED' THEN 1 ELSE 2 END) AS s, bool_or(object_type = 'COLUMN') AS has_column_changes FROM c GROUP BY 1)
SELECT 'TABLE' AS level, coalesce(t.object_identifier, o.object_identifier) AS object_identifier, CASE s WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS status, coalesce(has_column_changes, false) AS has_column_changes
FROM t FULL JOIN o ON t.object_identifier = o.object_identifier WHERE t.object_identifier IS NOT NULL OR s = 1"""
)
def dif13_status_overlay(d):
    ident = F.expr("'Brand#' || (11 + change_id % 15) || '.T' || (change_id % 45)")
    changes = d.chg.where("object_type <> 'SCHEMA'").withColumn("object_identifier", F.when(F.col("object_type") == "COLUMN", F.concat(ident, F.lit(".C"))).otherwise(ident))
    return diff.status_overlay(_at(d.tabs, 2), changes).where("level = 'TABLE'")


_OVER = """ch AS (SELECT CASE object_type WHEN 'SCHEMA' THEN 'Brand#' || (11 + change_id % 15) WHEN 'TABLE' THEN 'Brand#' || (11 + change_id % 15) || '.T' || (change_id % 45) ELSE 'Brand#' || (11 + change_id % 15) || '.T' || (change_id % 45) || '.C' || (change_id % 300) END AS k, object_type, change_type FROM {chg}),
o AS (SELECT 'SCHEMA' AS level, split_part(k, '.', 1) AS k, min(CASE change_type WHEN 'SCHEMA_ADDED' THEN 0 WHEN 'SCHEMA_REMOVED' THEN 1 ELSE 2 END) AS s FROM ch GROUP BY 2
UNION ALL SELECT 'TABLE', split_part(k, '.', 1) || '.' || split_part(k, '.', 2), min(CASE change_type WHEN 'TABLE_ADDED' THEN 0 WHEN 'TABLE_REMOVED' THEN 1 ELSE 2 END) FROM ch WHERE object_type <> 'SCHEMA' GROUP BY 2
UNION ALL SELECT 'COLUMN', k, min(CASE change_type WHEN 'COLUMN_ADDED' THEN 0 WHEN 'COLUMN_REMOVED' THEN 1 ELSE 2 END) FROM ch WHERE object_type = 'COLUMN' GROUP BY 2),
h AS (SELECT DISTINCT 'SCHEMA' AS level, schema_name AS k FROM tabs WHERE snapshot_id = 2 UNION ALL SELECT DISTINCT 'TABLE', schema_name || '.' || table_name FROM tabs WHERE snapshot_id = 2 UNION ALL SELECT DISTINCT 'COLUMN', schema_name || '.' || table_name || '.' || column_name FROM cols WHERE snapshot_id = 2)"""


@query("WITH " + _OVER.replace("{chg}", "chg") + " SELECT level, CASE s WHEN 0 THEN 'added' WHEN 1 THEN 'removed' WHEN 2 THEN 'modified' ELSE 'unchanged' END AS status, count(*) AS n FROM h FULL JOIN o USING (level, k) WHERE h.k IS NOT NULL OR s = 1 GROUP BY 1, 2")
def dif13_status_counts(d):
    """Schemas, tables and columns."""
    own = F.expr("'Brand#' || (11 + change_id % 15)")
    table = F.concat(own, F.expr("'.T' || (change_id % 45)"))
    ident = F.when(F.col("object_type") == "SCHEMA", own).when(F.col("object_type") == "TABLE", table).otherwise(F.concat(table, F.expr("'.C' || (change_id % 300)")))
    return diff.status_counts(diff.status_overlay(_at(d.tabs, 2), d.chg.withColumn("object_identifier", ident), _at(d.cols, 2)))


@query(
    """WITH a AS (SELECT schema_name, table_name FROM tabs JOIN snap USING (snapshot_id) WHERE source_system = 'A' AND snapshot_id = 7), b AS (SELECT schema_name, table_name FROM tabs JOIN snap USING (snapshot_id) WHERE source_system = 'B' AND snapshot_id = 8)
SELECT 'TABLE_ADDED' AS change_type, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) HAVING count(*) > 0 UNION ALL SELECT 'TABLE_REMOVED', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) HAVING count(*) > 0"""
)
def dif14_env_sync(d):
    drift = diff.compute_diff(d.tabs, d.cols, 7, 8)
    return drift.where(F.col("change_type").isin("TABLE_ADDED", "TABLE_REMOVED")).groupBy("change_type").agg(F.count("*").alias("n"))


@query(_PAIR + "SELECT count(*) AS total, count(*) FILTER (WHERE is_breaking) AS breaking, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM changes")
def agg13_diff_summary(d):
    return diff.summary(diff.compute_diff(d.tabs, d.cols, 3, 4))


@query("SELECT change_id, object_identifier, severity FROM chg WHERE severity = 'HIGH' AND is_breaking AND (object_identifier ILIKE '%11%' OR change_id = 11)")
def flt3_filter_changes(d):
    return diff.filter_changes(d.chg, "high", True, "11").select("change_id", "object_identifier", "severity")


@query(
    """SELECT coalesce(a.schema_name, b.schema_name) AS schema_name, count(*) AS keys, count(*) FILTER (WHERE a.column_name IS NULL) AS only_b, count(*) FILTER (WHERE b.column_name IS NULL) AS only_a
FROM (SELECT * FROM cols WHERE snapshot_id = 1) a FULL JOIN (SELECT * FROM cols WHERE snapshot_id = 6) b ON a.schema_name = b.schema_name AND a.table_name = b.table_name AND a.column_name = b.column_name GROUP BY 1"""
)
def jn1_full_outer_compare(d):
    both = diff.compare(_at(d.cols, 1), _at(d.cols, 6), diff.COLUMN_KEY)
    return both.groupBy("schema_name").agg(F.count("*").alias("keys"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("b").isNull()).alias("only_a"))


@query("SELECT snapshot_id AS snapshot_from, lead(snapshot_id) OVER (ORDER BY snapshot_date, snapshot_id) AS snapshot_to FROM snap QUALIFY snapshot_to IS NOT NULL")
def win7_consecutive_pairs(d):
    return diff.consecutive_pairs(d.snap)


@query("SELECT schema_name, table_name FROM tabs WHERE snapshot_id = 1 UNION SELECT schema_name, table_name FROM tabs WHERE snapshot_id = 2")
def set1_union(d):
    return _at(d.tabs, 1).select(diff.TABLE_KEY).unionByName(_at(d.tabs, 2).select(diff.TABLE_KEY)).distinct()


@query("SELECT 'only' AS side, column_name FROM (SELECT column_name FROM cols WHERE snapshot_id = 1 EXCEPT SELECT column_name FROM cols WHERE snapshot_id = 2) UNION ALL SELECT 'both', column_name FROM (SELECT column_name FROM cols WHERE snapshot_id = 1 INTERSECT SELECT column_name FROM cols WHERE snapshot_id = 2)")
def set2_difference_intersection(d):
    a, b = _at(d.cols, 1).select("column_name"), _at(d.cols, 2).select("column_name")
    return a.subtract(b).select(F.lit("only").alias("side"), "column_name").unionByName(a.intersect(b).select(F.lit("both").alias("side"), "column_name"))


@query("SELECT source_key, count(*) AS n FROM (SELECT source_key FROM lineage EXCEPT ALL SELECT source_key FROM lineage WHERE tier = 'TIER1') GROUP BY 1")
def set3_multiset_difference(d):
    keys = d.lineage.select("source_key")
    return keys.exceptAll(d.lineage.where("tier = 'TIER1'").select("source_key")).groupBy("source_key").agg(F.count("*").alias("n"))
