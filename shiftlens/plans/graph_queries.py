"""Queries of the dependency graph and of column lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from shiftlens.operators import graph
from shiftlens.plans.registry import query



def _catalog(d):
    """Tables whose names end in their schema's number, so that a name is found in one schema, and columns that refer to tables by name."""
    name = F.concat("table_name", F.lit("B"), F.right("schema_name", F.lit(2)))
    tables = d.tabs.where("snapshot_id = 2").select("schema_name", name.alias("table_name"), "object_type")
    column = F.expr("CASE WHEN ordinal_position % 3 = 0 THEN table_name || 'B' || right(schema_name, 2) || '_id' WHEN ordinal_position % 3 = 1 THEN 'T' || (ordinal_position * 4 - 3) || 'B' || right(schema_name, 2) || '_id' ELSE column_name END")
    return tables, d.cols.where("snapshot_id = 2").select("schema_name", name.alias("table_name"), column.alias("column_name"))


_CATALOG = """WITH t AS (SELECT schema_name, table_name || 'B' || right(schema_name, 2) AS table_name, object_type FROM tabs WHERE snapshot_id = 2),
c AS (SELECT schema_name, table_name || 'B' || right(schema_name, 2) AS table_name, CASE WHEN ordinal_position % 3 = 0 THEN table_name || 'B' || right(schema_name, 2) || '_id' WHEN ordinal_position % 3 = 1 THEN 'T' || (ordinal_position * 4 - 3) || 'B' || right(schema_name, 2) || '_id' ELSE column_name END AS column_name FROM cols WHERE snapshot_id = 2),
alone AS (SELECT lower(table_name) AS name, min(schema_name || '.' || table_name) AS referenced FROM t GROUP BY 1 HAVING count(*) = 1),
w AS (SELECT schema_name || '.' || table_name AS holder, column_name, unnest([0, 1, 2]) AS rank, lower(regexp_replace(column_name, '_id$', '')) || unnest(['', 's', 'es']) AS name FROM c WHERE lower(column_name) LIKE '_%\\_id' ESCAPE '\\'),
fk AS (SELECT holder, column_name, arg_min(referenced, rank) AS referenced FROM w JOIN alone USING (name) WHERE holder <> referenced GROUP BY 1, 2)"""


@query(
    _CATALOG
    + """SELECT 'node' AS kind, upper(schema_name || '.' || table_name) AS a, min(object_type) AS b FROM t GROUP BY 2 UNION ALL SELECT DISTINCT 'node', upper(schema_name), 'SCHEMA' FROM t
UNION ALL SELECT DISTINCT 'DEPENDS_ON', upper(schema_name || '.' || table_name), upper(schema_name) FROM t UNION ALL SELECT DISTINCT 'FEEDS', upper(referenced), upper(holder) FROM fk"""
)
def gra1_build_graph(d):
    nodes, edges = graph.build_graph(*_catalog(d))
    return nodes.select(F.lit("node").alias("kind"), F.col("object_name").alias("a"), F.col("object_type").alias("b")).unionByName(edges.select(F.col("relationship_type").alias("kind"), F.col("src_name").alias("a"), F.col("dst_name").alias("b")))


@query(
    _CATALOG
    + """ SELECT * FROM (SELECT DISTINCT 'DEPENDS_ON' AS kind, upper(schema_name || '.' || table_name) AS a, upper(schema_name) AS b FROM t UNION ALL SELECT DISTINCT 'FEEDS', upper(referenced), upper(holder) FROM fk) WHERE NOT (kind = 'DEPENDS_ON' AND a LIKE '%3')"""
)
def gra1_existing_edges(d):
    """The edges that a graph doesn't have yet, when some are stored in lower case."""
    stored = graph.build_graph(*_catalog(d))[1].where("relationship_type = 'DEPENDS_ON' and src_name like '%3'").withColumn("src_name", F.lower("src_name"))
    edges = graph.build_graph(*_catalog(d), existing_edges=stored)[1]
    return edges.select(F.col("relationship_type").alias("kind"), F.col("src_name").alias("a"), F.col("dst_name").alias("b"))


@query(_CATALOG + "SELECT * FROM fk")
def jn11_fk_name_match(d):
    tables, columns = _catalog(d)
    return graph.fk_name_match(columns, tables)


_DATASETS = """WITH ds AS (SELECT 'S' || (l_partkey % 12) || '.T' || l_partkey AS src_name, lower('S' || (l_suppkey % 12) || '.T' || (l_suppkey * 7)) AS dst_name, 'step' || (l_orderkey % 20) AS step_key FROM lineitem),
e AS (SELECT src_name, dst_name, min(step_key) AS step_key FROM ds GROUP BY 1, 2), n AS (SELECT upper(object_name) AS k, min(node_id) AS id FROM node GROUP BY 1)"""


def _datasets(d):
    return d.lineitem.select(F.expr("'S' || (l_partkey % 12) || '.T' || l_partkey").alias("src_name"), F.expr("lower('S' || (l_suppkey % 12) || '.T' || (l_suppkey * 7))").alias("dst_name"), F.expr("'step' || (l_orderkey % 20)").alias("step_key"))


@query(_DATASETS + "SELECT a.id AS src, b.id AS dst, step_key, 'FEEDS' AS relationship_type FROM e JOIN n a ON a.k = upper(src_name) JOIN n b ON b.k = upper(dst_name)")
def gra2_edges_from_lineage(d):
    return graph.edges_from_lineage(_datasets(d), d.node)[0]


@query(_DATASETS + "SELECT e.* FROM e LEFT JOIN n a ON a.k = upper(src_name) LEFT JOIN n b ON b.k = upper(dst_name) WHERE a.id IS NULL OR b.id IS NULL")
def gra2_missing_endpoints(d):
    return graph.edges_from_lineage(_datasets(d), d.node)[1]


_ENDS = "CASE WHEN l_linenumber = 1 THEN 'UNKNOWN.T' || l_partkey ELSE 'S' || (l_partkey % 12) || '.T' || l_partkey END"
_ENDS2 = "'S' || (l_suppkey % 12) || '.T' || l_suppkey"


@query(
    f"""WITH e AS (SELECT DISTINCT {_ENDS} AS s, {_ENDS2} AS t FROM lineitem), u AS (SELECT upper(split_part(object_name, '.', 2)) AS bare, min(object_name) AS full_name FROM node GROUP BY 1 HAVING count(DISTINCT object_name) = 1)
SELECT DISTINCT coalesce(u.full_name, s) AS src_name, t AS dst_name FROM e LEFT JOIN u ON s LIKE 'UNKNOWN.%' AND bare = upper(split_part(s, '.', 2)) WHERE coalesce(u.full_name, s) <> t"""
)
def jn12_repair_unknown(d):
    return graph.repair_unknown(d.lineitem.select(F.expr(_ENDS).alias("src_name"), F.expr(_ENDS2).alias("dst_name")), d.node.select("object_name"))


_DOWN = """WITH RECURSIVE w(start, node, depth, path) AS (SELECT src, dst, 1, [src, dst] FROM edge WHERE src IN ({starts})
UNION ALL SELECT start, dst, depth + 1, list_append(path, dst) FROM w JOIN edge ON src = node WHERE depth < {depth} AND NOT list_contains(path, dst)),
u(start, node, depth, path) AS (SELECT dst, src, 1, [src, dst] FROM edge WHERE dst IN ({starts})
UNION ALL SELECT start, src, depth + 1, list_prepend(src, path) FROM u JOIN edge ON dst = node WHERE depth < {depth} AND NOT list_contains(path, src))"""
_ROW = "SELECT start, node, depth, array_to_string(path, '>') AS path, round(1 / depth, 4) AS score FROM "


def _starts(d):
    return d.node.where("node_id % 100 = 0").select(F.col("node_id").alias("start"))


def _paths(df):
    return df.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query(_DOWN.format(starts="SELECT node_id FROM node WHERE node_id % 100 = 0", depth=4) + _ROW + "w")
def gra3_downstream(d):
    return _paths(graph.walk(d.edge, _starts(d), 4))


@query(_DOWN.format(starts="SELECT node_id FROM node WHERE node_id % 100 = 0", depth=3) + _ROW + "u")
def gra4_upstream(d):
    return _paths(graph.walk(d.edge, _starts(d), 3, upstream=True))


_LINK = """l AS (SELECT c.*, coalesce(x.id, p.id, y.id) AS node_id FROM chg c
 LEFT JOIN (SELECT object_type, lower(object_name) AS n, max(node_id) AS id FROM node GROUP BY 1, 2) x ON x.object_type = c.object_type AND x.n = lower(object_identifier)
 LEFT JOIN (SELECT lower(object_name) AS n, max(node_id) AS id FROM node GROUP BY 1) p ON c.object_type = 'COLUMN' AND p.n = lower(regexp_replace(object_identifier, '\\.[^.]*$', ''))
 LEFT JOIN (SELECT lower(object_name) AS n, max(node_id) AS id FROM node GROUP BY 1) y ON y.n = lower(object_identifier))"""


@query("WITH " + _LINK + " SELECT change_id, node_id FROM l WHERE node_id IS NOT NULL")
def jn3_link_changes(d):
    return graph.link_changes(d.chg, d.node).select("change_id", "node_id")


@query("SELECT object_type, lower(schema_name) AS name, count(*) AS n FROM node GROUP BY 1, 2 HAVING count(*) > 1")
def jn3_duplicate_nodes(d):
    return graph.duplicate_nodes(d.node.withColumn("object_name", F.col("schema_name")))


SUMMARIES = (
    _LINK + ", " + _DOWN.format(starts="SELECT node_id FROM l WHERE node_id IS NOT NULL", depth=3).replace("WITH RECURSIVE ", "")
    + """, b AS (SELECT start, depth, 'd' AS way FROM w UNION ALL SELECT start, depth, 'u' FROM u),
s AS (SELECT start, count(*) FILTER (WHERE way = 'd' AND depth = 1) AS direct, count(*) FILTER (WHERE way = 'd' AND depth > 1) AS indirect, round(sum(round(1 / depth, 4)), 4) AS score, max(depth) AS max_depth FROM b GROUP BY 1)"""
)


@query(f"WITH RECURSIVE {SUMMARIES} SELECT change_id, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, coalesce(score, 0) AS score, coalesce(max_depth, 0) AS max_depth FROM l LEFT JOIN s ON start = node_id")
def gra5_impact_summaries(d):
    return graph.impact_summaries(d.chg, d.node, d.edge)


@query(f"WITH RECURSIVE {SUMMARIES} SELECT change_id, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect FROM l LEFT JOIN s ON start = node_id WHERE change_id % 3 <> 0")
def gra5_new_impacts(d):
    """Changes that have their impacts already are left out."""
    return graph.impact_summaries(d.chg, d.node, d.edge, d.chg.where("change_id % 3 = 0")).select("change_id", "direct", "indirect")


@query(
    _DOWN.format(starts="7", depth=5)
    + """SELECT x.node, x.depth, x.way, x.score, object_name FROM (SELECT 7 AS node, 0 AS depth, 'root' AS way, 1.0 AS score UNION ALL SELECT node, depth, 'down', round(1 / depth, 4) FROM w UNION ALL SELECT node, depth, 'up', round(1 / depth, 4) FROM u) x LEFT JOIN node ON node_id = x.node"""
)
def gra6_impact_of_change(d):
    return graph.impact_of(7, d.node, d.edge, 5).select("node", "depth", "way", "score", "object_name")


_NEAR = """WITH RECURSIVE both_e AS (SELECT src AS a, dst AS b FROM edge UNION SELECT dst, src FROM edge), h(node, hop) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT b, hop + 1 FROM h JOIN both_e ON a = node WHERE hop < 2),
near AS (SELECT node, min(hop) AS hop FROM h GROUP BY 1)"""


@query(_NEAR + "SELECT DISTINCT src, dst, relationship_type FROM edge WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)")
def gra7_focus_subgraph(d):
    return graph.focus_subgraph(d.edge, 3, 2)[1]


@query("SELECT node_count, edge_count, node_count > 500 AS truncated FROM (SELECT count(*) AS node_count FROM node), (SELECT count(*) AS edge_count FROM edge)")
def gra8_graph_meta(d):
    return graph.graph_meta(d.node, d.edge, 500)


@query("WITH m AS (SELECT count(*) AS n FROM node) SELECT 'whole' AS cap, (FROM m) AS nodes, (SELECT count(*) FROM edge) AS edges, false AS truncated UNION ALL SELECT 'small', 0, 0, true")
def gra8_full_graph(d):
    """A cap above the number of nodes, and one below it."""
    out = None
    for name, cap in (("whole", 1 << 40), ("small", 10)):
        nodes, edges, meta = graph.full_graph(d.node, d.edge, cap)
        one = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).join(F.broadcast(meta.select("truncated"))).select(F.lit(name).alias("cap"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(_NEAR + ", b AS (SELECT * FROM near ORDER BY hop, node LIMIT 12) SELECT node, hop, (SELECT count(*) > 12 FROM near) AS capped FROM b")
def gra7_capped_subgraph(d):
    near, _, capped = graph.focus_subgraph(d.edge, 3, 2, max_nodes=12)
    return near.join(F.broadcast(capped))


_OWN = "SELECT *, row_number() OVER (ORDER BY source_key, target_key, tier) AS r FROM lineage WHERE source_key LIKE 'P7.A|%' OR target_key LIKE 'P7.A|%'"
_COLUMN_LINEAGE = f"""WITH l AS (SELECT * FROM ({_OWN}) WHERE r <= 5000), d AS (SELECT split_part(source_key, '|', 2) AS column_name, 'downstream' AS direction, target_key AS partner, min(tier) AS tier FROM l WHERE source_key LIKE 'P7.A|%' AND target_key <> 'NOT APPLICABLE' GROUP BY 1, 2, 3
UNION ALL SELECT split_part(target_key, '|', 2), 'upstream', source_key, min(tier) FROM l WHERE target_key LIKE 'P7.A|%' GROUP BY 1, 2, 3)
SELECT *, (SELECT count(*) FROM d) AS total FROM (FROM d UNION ALL SELECT split_part(source_key, '|', 2), 'indirect', target_key, tier FROM l WHERE source_key LIKE 'P7.A|%' AND target_key = 'NOT APPLICABLE')"""


@query(_COLUMN_LINEAGE)
def gra9_column_lineage(d):
    return graph.column_lineage(d.lineage, "p7.a")


@query(_COLUMN_LINEAGE.replace("r <= 5000", "r <= 40"), name="gra9_first_rows")
def _gra9_first(d):
    return graph.column_lineage(d.lineage, "p7.a", most=40)


_CHAIN = "SELECT 'N' || (l_partkey % 90) AS source_key, CASE WHEN l_suppkey % 9 = 0 THEN 'NOT APPLICABLE' ELSE 'N' || (l_partkey % 90 + l_linenumber) END AS target_key FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_CHAIN}) WHERE target_key <> 'NOT APPLICABLE'), t(k, depth, path) AS (SELECT 'N4', 0, ['N4'] UNION ALL SELECT target_key, depth + 1, list_append(path, target_key) FROM t JOIN e ON source_key = k WHERE depth < 5)
SELECT k AS column_key, depth, array_to_string(min(path), '>') AS path FROM t JOIN (SELECT k, min(depth) AS depth FROM t GROUP BY 1) USING (k, depth) WHERE depth > 0 GROUP BY 1, 2"""
)
def gra10_traverse_columns(d):
    edges = d.lineitem.select(F.expr("'N' || (l_partkey % 90)").alias("source_key"), F.expr("CASE WHEN l_suppkey % 9 = 0 THEN 'NOT APPLICABLE' ELSE 'N' || (l_partkey % 90 + l_linenumber) END").alias("target_key"))
    return graph.traverse_columns(edges, "N4", max_depth=5).withColumn("path", F.array_join("path", ">"))


@query(
    f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({_CHAIN}) WHERE target_key <> 'NOT APPLICABLE'), t(k, depth, path) AS (SELECT 'N4', 0, ['N4'] UNION ALL SELECT target_key, depth + 1, list_append(path, target_key) FROM t JOIN e ON source_key = k WHERE depth < 5),
f AS (SELECT k, depth, min(path) AS path FROM t JOIN (SELECT k, min(depth) AS depth FROM t GROUP BY 1) USING (k, depth) WHERE depth > 0 GROUP BY 1, 2), n AS (SELECT depth, (SELECT count(*) FROM f g WHERE g.depth < d.depth) AS before FROM (SELECT DISTINCT depth FROM f) d)
SELECT k AS column_key, depth, array_to_string(path, '>') AS path FROM f JOIN n USING (depth) WHERE before < 10"""
)
def gra10_capped(d):
    """Steps are taken until ten columns are found."""
    edges = d.lineitem.select(F.expr("'N' || (l_partkey % 90)").alias("source_key"), F.expr("CASE WHEN l_suppkey % 9 = 0 THEN 'NOT APPLICABLE' ELSE 'N' || (l_partkey % 90 + l_linenumber) END").alias("target_key"))
    return graph.traverse_columns(edges, "N4", max_depth=5, max_nodes=10).withColumn("path", F.array_join("path", ">"))


_DEEP = "SELECT p_partkey AS src, CASE WHEN p_partkey % 10 < 7 THEN p_partkey - p_partkey % 10 + (p_partkey % 10 + 1) % 7 ELSE p_partkey + 1 END AS dst FROM part UNION ALL SELECT p_partkey, p_partkey + 10 FROM part WHERE p_partkey % 30 = 5 UNION ALL SELECT p_partkey, p_partkey - 10 FROM part WHERE p_partkey % 60 = 12"


@query(
    f"""WITH RECURSIVE e AS ({_DEEP}), r(a, b) AS (SELECT src, dst FROM e UNION SELECT a, dst FROM r JOIN e ON b = src), m AS (SELECT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b)
SELECT a AS node, greatest(a, max(b)) AS component FROM m GROUP BY a"""
)
def gra11_strong_components(d):
    """Rings of seven, chains that hang on them, and bridges of which some join two rings into one component."""
    return graph.strong_components(d.spark.sql(_DEEP.replace("FROM part", "FROM {part}"), part=d.part))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM edge), c(first, last, path) AS (SELECT src, dst, CASE WHEN src = dst THEN [src] ELSE [src, dst] END FROM e
UNION ALL SELECT first, dst, CASE WHEN dst = first THEN path ELSE list_append(path, dst) END FROM c JOIN e ON src = last WHERE last > first AND dst >= first AND len(path) <= 4 AND (dst = first OR (NOT list_contains(path, dst) AND len(path) < 4)))
SELECT DISTINCT array_to_string(path, '>') AS cycle, len(path) AS length FROM c WHERE first = last"""
)
def gra11_detect_cycles(d):
    found = graph.detect_cycles(d.edge)
    return found.select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"), F.col("length").cast("long").alias("length"))




@query(f"SELECT src, dst, CASE WHEN src % 50 = 3 THEN 'source' ELSE 'target' END AS missing FROM edge WHERE src % 50 = 3 OR dst % 50 = 3")
def gra12_broken_edges(d):
    return graph.broken_edges(d.edge, d.node.where("node_id % 50 <> 3"))


@query("SELECT node_id, object_name FROM node WHERE node_id NOT IN (SELECT src FROM edge WHERE src % 3 = 0 UNION SELECT dst FROM edge WHERE src % 3 = 0)")
def gra12_orphan_nodes(d):
    return graph.orphan_nodes(d.node, d.edge.where("src % 3 = 0")).select("node_id", "object_name")


_METRICS = """m AS (SELECT node_id, object_name, in_degree, out_degree, round(out_degree / greatest(max(out_degree) OVER (), 1), 4) AS fragility, in_degree * count(*) OVER () > 2 * sum(in_degree) OVER () AS is_hub
FROM (SELECT node.*, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree FROM node LEFT JOIN (SELECT dst, count(*) AS i FROM edge GROUP BY 1) ON dst = node_id LEFT JOIN (SELECT src, count(*) AS o FROM edge GROUP BY 1) ON src = node_id))"""


@query("WITH " + _METRICS + " SELECT change_id FROM chg WHERE lower(object_identifier) IN (SELECT lower(object_name) FROM m WHERE is_hub)")
def gra12_hub_changes(d):
    return graph.hub_changes(d.chg, graph.node_metrics(d.node, d.edge)).select("change_id")


@query(
    "WITH " + _METRICS + """, a AS (SELECT 'BROKEN_EDGE' AS alert_type, 'HIGH' AS severity, src || '->' || dst AS subject FROM edge WHERE src % 50 = 3 OR dst % 50 = 3 ORDER BY subject LIMIT 15),
o AS (SELECT 'ORPHAN_NODE', 'MEDIUM', object_name FROM node WHERE node_id % 50 <> 3 AND node_id NOT IN (SELECT src FROM edge UNION SELECT dst FROM edge) ORDER BY object_name LIMIT 10)
SELECT * FROM a UNION ALL SELECT * FROM o"""
)
def gra12_proactive_alerts(d):
    return graph.proactive_alerts(d.node.where("node_id % 50 <> 3"), d.edge, d.chg).where("alert_type <> 'HUB_CHANGE'")


@query("WITH " + _METRICS + " SELECT node_id, in_degree, out_degree, fragility, is_hub FROM m")
def agg5_node_metrics(d):
    return graph.node_metrics(d.node, d.edge).select("node_id", "in_degree", "out_degree", "fragility", "is_hub")


_HYP = "SELECT c_custkey AS hyp_id, CASE c_custkey % 5 WHEN 0 THEN 'TABLE_REMOVED' WHEN 1 THEN 'TABLE_TYPE_CHANGED' WHEN 2 THEN 'COLUMN_REMOVED' WHEN 3 THEN 'COLUMN_TYPE_CHANGED' ELSE 'COLUMN_NULLABILITY_CHANGED' END AS change_type, CASE WHEN c_custkey % 5 < 2 THEN 'S' || (c_custkey % 60 % 12) || '.T' || (c_custkey % 60) ELSE 'S' || (c_custkey % 60 % 12) || '.T' || (c_custkey % 60) || '.C1' END AS object_name FROM {customer}"


@query(
    "WITH RECURSIVE hyp AS (" + _HYP.replace("{customer}", "customer") + """), a AS (SELECT hyp.*, node_id AS start FROM hyp LEFT JOIN node n ON lower(n.object_name) = lower(split_part(hyp.object_name, '.', 1) || '.' || split_part(hyp.object_name, '.', 2))),
w(start, node, depth, path) AS (SELECT src, dst, 1, [src, dst] FROM edge WHERE src IN (SELECT start FROM a) UNION ALL SELECT start, dst, depth + 1, list_append(path, dst) FROM w JOIN edge ON src = node WHERE depth < 4 AND NOT list_contains(path, dst)),
u(start, node, depth, path) AS (SELECT dst, src, 1, [src, dst] FROM edge WHERE dst IN (SELECT start FROM a) UNION ALL SELECT start, src, depth + 1, list_prepend(src, path) FROM u JOIN edge ON dst = node WHERE depth < 4 AND NOT list_contains(path, src)),
p AS (SELECT start, count(*) FILTER (WHERE depth = 1) AS direct, count(*) FILTER (WHERE depth > 1) AS indirect FROM w GROUP BY 1), u10 AS (SELECT start, node FROM u QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, node, path) <= 10), q AS (SELECT start, count(*) AS upstream FROM u10 GROUP BY 1),
fu AS (SELECT lower(object_name) AS nm, sum(query_count) AS q, sum(user_count) AS us FROM usage GROUP BY 1), sh AS (SELECT split_part(nm, '.', -1) AS leaf, arg_min({'q': q, 'us': us}, nm) AS x FROM fu GROUP BY 1),
t AS (SELECT start, sum(coalesce(fu.q, sh.x.q)) AS total, sum(coalesce(fu.us, sh.x.us)) AS users FROM (SELECT start, node FROM w UNION SELECT start, node FROM u10 UNION SELECT start, start FROM a) JOIN node ON node_id = node LEFT JOIN fu ON nm = lower(object_name) LEFT JOIN sh ON leaf = split_part(lower(object_name), '.', -1) GROUP BY 1),
r AS (SELECT hyp_id, change_type, object_name, change_type <> 'COLUMN_NULLABILITY_CHANGED' AS is_breaking, coalesce(direct, 0) AS direct, coalesce(indirect, 0) AS indirect, coalesce(upstream, 0) AS upstream, CAST(coalesce(total, 0) AS BIGINT) AS total_queries, CAST(coalesce(users, 0) AS BIGINT) AS total_users FROM a LEFT JOIN p USING (start) LEFT JOIN q USING (start) LEFT JOIN t USING (start))
SELECT *, CASE WHEN is_breaking AND (direct + indirect + upstream >= 3 OR total_queries >= 5000) THEN 'HIGH' WHEN is_breaking OR direct + indirect + upstream >= 5 OR total_queries >= 1000 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM r"""
)
def gra13_what_if(d):
    hyp = d.spark.sql(_HYP, customer=d.customer)
    return graph.what_if(hyp, d.node, d.edge, d.usage, depth=4)


@query(
    """WITH c AS (SELECT p_partkey AS pos, 'S' || (p_partkey % 12) || '.T' || (CASE WHEN p_partkey % 9 = 8 THEN -1 ELSE p_partkey END) AS object_name FROM part), s AS (SELECT *, lead(object_name) OVER (ORDER BY pos) AS next_name FROM c)
SELECT pos, s.object_name, next_name, a.node_id IS NOT NULL AS found, EXISTS (SELECT 1 FROM edge WHERE src = a.node_id AND dst = b.node_id) AS linked FROM s LEFT JOIN node a ON lower(a.object_name) = lower(s.object_name) LEFT JOIN node b ON lower(b.object_name) = lower(next_name)"""
)
def gra14_chain_check(d):
    chain = d.part.select(F.col("p_partkey").alias("pos"), F.expr("'S' || (p_partkey % 12) || '.T' || (CASE WHEN p_partkey % 9 = 8 THEN -1 ELSE p_partkey END)").alias("object_name"))
    return graph.chain_check(chain, d.node, d.edge)


_TIERS = "SELECT source_key, target_key, CASE WHEN transformation_type = 'A' AND expression = 'O' THEN 'FACT' ELSE tier END AS tier, step_key FROM {lineage}"


@query(
    "WITH l AS (" + _TIERS.replace("{lineage}", "lineage") + """), t3 AS (SELECT DISTINCT split_part(source_key, '|', 1) AS s, split_part(target_key, '|', 1) AS t FROM l WHERE step_key < 'step15')
SELECT 'tier2_without_tier1' AS "check", * FROM (SELECT source_key, target_key FROM l WHERE tier = 'TIER2' EXCEPT SELECT source_key, target_key FROM l WHERE tier = 'TIER1')
UNION ALL SELECT 'fact_without_tiers', * FROM (SELECT source_key, target_key FROM l WHERE tier = 'FACT' EXCEPT SELECT source_key, target_key FROM l WHERE tier <> 'FACT')
UNION ALL SELECT 'missing_tier3', * FROM (SELECT split_part(source_key, '|', 1), split_part(target_key, '|', 1) FROM l WHERE tier <> 'FACT' EXCEPT SELECT s, t FROM t3)"""
)
def gra15_tier_support(d):
    lineage = d.spark.sql(_TIERS, lineage=d.lineage)
    t3 = lineage.where("step_key < 'step15'").select(F.substring_index("source_key", "|", 1).alias("s"), F.substring_index("target_key", "|", 1).alias("t")).distinct()
    return graph.tier_support(lineage, t3)


@query(
    """WITH RECURSIVE f AS (SELECT src, dst FROM edge WHERE relationship_type = 'FEEDS' AND src <> dst), u(node, hop) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT src, hop + 1 FROM u JOIN f ON dst = node WHERE hop < 3), w(node, hop) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT dst, hop + 1 FROM w JOIN f ON src = node WHERE hop < 3),
x AS (SELECT node, 0 AS r, 0 AS hop, 'center' AS role FROM u WHERE hop = 0 UNION ALL SELECT node, 1, min(hop), 'upstream' FROM u GROUP BY node HAVING min(hop) > 0 UNION ALL SELECT node, 2, min(hop), 'downstream' FROM w GROUP BY node HAVING min(hop) > 0)
SELECT node, arg_min(role, r) AS role, arg_min(hop, r) AS hop, node IN (SELECT src FROM edge WHERE src = dst AND relationship_type = 'FEEDS') AS self_loop FROM x GROUP BY node"""
)
def gra16_neighbourhood_roles(d):
    return graph.neighbourhood_roles(d.edge, 5, 3)


@query(
    """WITH r AS (SELECT split_part(source_key, '|', 1) AS src_table, split_part(target_key, '|', 1) AS tgt_table, split_part(source_key, '|', 2) AS sc, split_part(target_key, '|', 2) AS tc, * FROM lineage WHERE target_key <> 'NOT APPLICABLE')
SELECT src_table, tgt_table, string_agg(DISTINCT sc || '>' || tc || ':' || transformation_type, ',' ORDER BY sc || '>' || tc || ':' || transformation_type) AS labels, count(DISTINCT step_key) AS n_steps, count(DISTINCT sc) AS n_source_columns, count(DISTINCT tc) AS n_target_columns FROM r WHERE src_table <> tgt_table GROUP BY 1, 2"""
)
def gra17_column_edge_rollup(d):
    return graph.column_edge_rollup(d.lineage)


@query("SELECT split_part(source_key, '|', 1) AS table_key, transformation_type, expression, count(*) AS n FROM lineage WHERE target_key = 'NOT APPLICABLE' GROUP BY 1, 2, 3")
def gra18_indirect_rollup(d):
    return graph.indirect_rollup(d.lineage)


@query(
    """WITH n AS (SELECT node_id, node_id % 7 AS snapshot_id FROM node WHERE node_id % 50 <> 3)
SELECT s.snapshot_id, src, dst, CASE WHEN a.node_id IS NULL OR b.node_id IS NULL THEN 'missing endpoint' ELSE 'other snapshot' END AS problem FROM (SELECT *, src % 7 AS snapshot_id FROM edge) s LEFT JOIN n a ON a.node_id = src LEFT JOIN n b ON b.node_id = dst
WHERE a.node_id IS NULL OR b.node_id IS NULL OR a.snapshot_id <> s.snapshot_id OR b.snapshot_id <> s.snapshot_id"""
)
def jn14_isolation_check(d):
    return graph.isolation_check(d.edge.withColumn("snapshot_id", F.col("src") % 7), d.node.where("node_id % 50 <> 3").withColumn("snapshot_id", F.col("node_id") % 7))


@query(
    """WITH i AS (SELECT change_id, change_id % 400 AS node_id, snapshot_to + CASE WHEN change_id % 7 = 0 THEN 1 ELSE 0 END AS snapshot_id FROM chg), c AS (SELECT * FROM chg WHERE change_id % 5 <> 0), n AS (SELECT node_id, node_id % 12 + 1 AS snap FROM node WHERE node_id % 50 <> 3)
SELECT * FROM (SELECT change_id, node_id, i.snapshot_id, CASE WHEN c.snapshot_to IS NULL THEN 'missing change' WHEN c.snapshot_to <> i.snapshot_id THEN 'change of another snapshot' WHEN snap IS NULL THEN 'missing node' WHEN snap <> i.snapshot_id THEN 'node of another snapshot' END AS problem FROM i LEFT JOIN c USING (change_id) LEFT JOIN n USING (node_id)) WHERE problem IS NOT NULL"""
)
def jn14_alignment_check(d):
    impacts = d.chg.select("change_id", (F.col("change_id") % 400).alias("node_id"), (F.col("snapshot_to") + F.when(F.col("change_id") % 7 == 0, 1).otherwise(0)).alias("snapshot_id"))
    return graph.alignment_check(impacts, d.chg.where("change_id % 5 <> 0"), d.node.where("node_id % 50 <> 3").withColumn("snapshot_id", F.col("node_id") % 12 + 1))


@query("SELECT src, dst, relationship_type FROM edge WHERE src <> dst")
def flt2_drop_self_loops(d):
    return graph.drop_self_loops(d.edge)


@query(
    """WITH c AS (SELECT upper(schema_name || '.' || table_name) AS k, min(object_type) AS t FROM tabs WHERE snapshot_id = 2 GROUP BY 1), n AS (SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'Brand#' || (11 + node_id % 15) || '.T' || (node_id % 45) ELSE object_name END AS object_name, object_type, CASE WHEN node_id % 3 = 0 THEN 'X_VW' ELSE schema_name END AS schema_name FROM node)
SELECT node_id, coalesce(CASE WHEN object_type <> 'UNKNOWN' THEN object_type END, t, CASE WHEN schema_name = 'X_VW' THEN 'VIEW' ELSE 'TABLE' END) AS display_type FROM n LEFT JOIN c ON k = upper(object_name)"""
)
def flt9_resolve_display_type(d):
    nodes = d.node.withColumns({"object_name": F.expr("CASE WHEN node_id % 2 = 0 THEN 'Brand#' || (11 + node_id % 15) || '.T' || (node_id % 45) ELSE object_name END"), "schema_name": F.expr("CASE WHEN node_id % 3 = 0 THEN 'X_VW' ELSE schema_name END")})
    return graph.resolve_display_type(nodes, d.tabs.where("snapshot_id = 2")).select("node_id", "display_type")
