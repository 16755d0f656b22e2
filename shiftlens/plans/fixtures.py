"""Projections of the given tables onto the domain's tables: snapshots, columns, tables, changes, graph, usage, lineage, people.

Each is one SELECT that Spark and DuckDB read alike. They stand in for a catalog that the given tables don't have, and
grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES = {
    "snap": """
        SELECT snapshot_id, CAST('2024-01-01' AS DATE) + CAST(7 * snapshot_id + CASE WHEN snapshot_id > 5 THEN 20 ELSE 0 END AS INT) AS snapshot_date,
               CASE WHEN snapshot_id % 4 = 0 THEN 'B' ELSE 'A' END AS source_system, snapshot_id % 3 <> 0 AS is_full
        FROM (SELECT DISTINCT CAST(p_partkey % 8 + 1 AS BIGINT) AS snapshot_id FROM {part})""",
    "cols": """
        SELECT snapshot_id, p_brand AS schema_name, 'T' || (p_partkey % 40) AS table_name, 'C' || p_partkey AS column_name,
               CASE WHEN (p_partkey + snapshot_id) % 7 = 0 THEN 'DECIMAL(18,2)' ELSE 'INTEGER' END AS data_type, (p_size + snapshot_id) % 3 = 0 AS nullable,
               CAST(p_partkey % 11 + snapshot_id % 2 AS BIGINT) AS ordinal_position
        FROM {part} JOIN {snap} ON p_partkey % (snapshot_id + 5) <> 0""",
    "tabs": """
        SELECT DISTINCT snapshot_id, schema_name, table_name,
               CASE WHEN (CAST(substr(table_name, 2) AS INT) + snapshot_id // 3) % 5 = 0 THEN 'VIEW' ELSE 'TABLE' END AS object_type,
               CASE WHEN CAST(substr(table_name, 2) AS INT) % 3 = 0 THEN NULL ELSE CAST(CAST('2024-01-01' AS DATE) + CAST(snapshot_id * CAST(substr(table_name, 2) AS INT) % 4 AS INT) AS VARCHAR(10)) END AS ddl_alter_timestamp
        FROM {cols}""",
    "chg": """
        SELECT change_id, snapshot_to - 1 AS snapshot_from, snapshot_to, change_type, object_type, detected_at,
               CASE object_type WHEN 'SCHEMA' THEN s WHEN 'TABLE' THEN s || '.' || t ELSE s || '.' || t || '.' || c END AS object_identifier,
               CASE WHEN change_type IN ('TABLE_REMOVED', 'SCHEMA_REMOVED', 'COLUMN_REMOVED', 'TABLE_TYPE_CHANGED') THEN 'HIGH'
                    WHEN change_type IN ('COLUMN_TYPE_CHANGED', 'COLUMN_NULLABILITY_CHANGED', 'TABLE_DDL_CHANGED') THEN 'MEDIUM' ELSE 'LOW' END AS severity,
               change_type IN ('TABLE_REMOVED', 'COLUMN_REMOVED', 'COLUMN_TYPE_CHANGED', 'SCHEMA_REMOVED', 'TABLE_TYPE_CHANGED') AS is_breaking
        FROM (SELECT *, CASE WHEN change_type LIKE 'SCHEMA%' THEN 'SCHEMA' WHEN change_type LIKE 'TABLE%' THEN 'TABLE' ELSE 'COLUMN' END AS object_type
              FROM (SELECT o_orderkey AS change_id, CAST(month(o_orderdate) AS BIGINT) AS snapshot_to, o_orderdate AS detected_at,
                           'S' || (o_custkey % 12) AS s, 'T' || (o_custkey % 60) AS t, 'C' || (o_custkey % 7) AS c,
                           CASE o_orderkey % 11 WHEN 0 THEN 'TABLE_ADDED' WHEN 1 THEN 'TABLE_REMOVED' WHEN 2 THEN 'TABLE_TYPE_CHANGED' WHEN 3 THEN 'TABLE_DDL_CHANGED' WHEN 4 THEN 'COLUMN_ADDED'
                                WHEN 5 THEN 'COLUMN_REMOVED' WHEN 6 THEN 'COLUMN_TYPE_CHANGED' WHEN 7 THEN 'COLUMN_NULLABILITY_CHANGED' WHEN 8 THEN 'COLUMN_POSITION_CHANGED' WHEN 9 THEN 'SCHEMA_ADDED' ELSE 'SCHEMA_REMOVED' END AS change_type
                    FROM {orders}) AS o1) AS o2""",
    "months": "SELECT DISTINCT CAST(month(o_orderdate) AS BIGINT) AS snapshot_id, CAST('2024-01-01' AS DATE) + CAST(7 * month(o_orderdate) AS INT) AS snapshot_date FROM {orders}",
    "node": """
        SELECT CAST(p_partkey AS BIGINT) AS node_id, 'S' || (p_partkey % 12) || '.T' || p_partkey AS object_name, 'S' || (p_partkey % 12) AS schema_name,
               CASE WHEN p_partkey % 17 = 16 THEN 'UNKNOWN' WHEN p_partkey % 5 = 0 THEN 'VIEW' ELSE 'TABLE' END AS object_type
        FROM {part}""",
    "edge": """
        SELECT DISTINCT src, dst, CASE WHEN (src + dst) % 4 = 0 THEN 'DEPENDS_ON' ELSE 'FEEDS' END AS relationship_type
        FROM (SELECT p_partkey AS src, (p_partkey * 2 + 1) % n AS dst FROM {part}, (SELECT count(*) AS n FROM {part}) AS n1
              UNION ALL SELECT p_partkey AS src, (p_partkey * 3 + 1) % n AS dst FROM {part}, (SELECT count(*) AS n FROM {part}) AS n2 WHERE p_partkey % 3 = 0) AS e""",
    "usage": """
        SELECT event_id, 'S' || (user_id % 12) AS schema_name, 'S' || (user_id % 12) || '.T' || (user_id % 60) AS object_name, CASE WHEN user_id % 5 = 0 THEN 'VIEW' ELSE 'TABLE' END AS object_type,
               CAST(event_id % 97 AS BIGINT) AS query_count, CAST(user_id % 5 + 1 AS BIGINT) AS user_count, user_id AS username, ts AS last_accessed
        FROM {events}""",
    "lineage": """
        SELECT 'P' || (l_partkey % 50) || '.A|C' || l_linenumber AS source_key,
               CASE WHEN (l_partkey + l_suppkey) % 9 = 0 THEN 'NOT APPLICABLE' ELSE 'Q' || (l_suppkey % 40) || '.B|C' || (l_linenumber % 5) END AS target_key,
               CASE WHEN l_linenumber % 2 = 0 THEN 'TIER1' ELSE 'TIER2' END AS tier, l_returnflag AS transformation_type, l_linestatus AS expression, 'step' || (l_orderkey % 20) AS step_key
        FROM {lineitem}""",
    "team": "SELECT CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS department_id FROM {nation}",
    "dept": "SELECT CAST(r_regionkey AS BIGINT) AS department_id, r_name AS department FROM {region}",
    "person": "SELECT c_custkey AS username, CAST(c_nationkey AS BIGINT) AS team_id FROM {customer} WHERE c_custkey % 10 <> 9",
    "app": "SELECT s_suppkey AS app_id, s_name AS application, CAST(s_nationkey AS BIGINT) AS owner_team_id FROM {supplier}",
    "schema_app": "SELECT s_suppkey AS mapping_id, 'S' || (s_suppkey % 9) AS schema_name, s_suppkey AS app_id FROM {supplier} WHERE s_suppkey % 4 = 0",
    "table_app": "SELECT s_suppkey AS mapping_id, 'S' || (s_suppkey % 12) || '.T' || (s_suppkey % 24) AS object_name, s_suppkey AS app_id FROM {supplier} WHERE s_suppkey % 4 = 1",
}
_NAME = re.compile(r"\{(\w+)\}")


def needed(sql: str, of: re.Pattern) -> list[str]:
    """Fixtures that sql names, and those that they name, dependencies first."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in FIXTURES and name not in out:
            for other in _NAME.findall(FIXTURES[name]):
                visit(other)
            out.append(name)

    for name in of.findall(sql):
        visit(name)
    return out


def with_fixtures(sql: str) -> str:
    """sql for DuckDB, with the fixtures that it names in front of its own WITH."""
    parts = [f"{name} AS ({_NAME.sub(lambda m: m[1], FIXTURES[name])})" for name in needed(sql, re.compile(r"\b(\w+)\b"))]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?(.*)", sql, re.S)
    if own:
        return f"WITH RECURSIVE {', '.join([*parts, own[2]])}"
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


class Domain:
    """The given tables and the fixtures, as frames read where they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in FIXTURES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        sql = FIXTURES[name].replace("//", "DIV").replace("VARCHAR(10)", "STRING")
        return self.spark.sql(sql, **{other: getattr(self, other) for other in set(_NAME.findall(sql))})
