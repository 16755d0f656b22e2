"""The dependency graph: building it, linking changes to it, walking it, checking it.

Nodes have node_id, object_type, object_name and schema_name; edges src, dst and relationship_type. Names are matched
without case. Walks from many starts run as joins from all of them at once; only bounded loops over hops are on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.exprs import leaf
from shiftlens.operators.components import strong_components
from shiftlens.sources.shared import cut


def build_graph(tables: DataFrame, columns: DataFrame, existing: DataFrame | None = None, existing_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (object_type, object_name) of a snapshot's schemas and objects, upper-cased and distinct, and edges
    (src_name, dst_name, relationship_type): DEPENDS_ON from each object to its schema, FEEDS from what a column's name
    refers to. Nodes that `existing` has under their key are left out; its UNKNOWN ones take their real type. Edges that
    `existing_edges` has (names in any case, and type) are left out."""
    name = F.upper(F.concat_ws(".", "schema_name", "table_name"))
    objects = tables.groupBy(name.alias("object_name")).agg(F.min("object_type").alias("object_type"))
    schemas = tables.select(F.upper("schema_name").alias("object_name")).distinct().withColumn("object_type", F.lit("SCHEMA"))
    nodes = objects.unionByName(schemas)
    if existing is not None:
        known = existing.select(F.upper("object_name").alias("object_name"), F.col("object_type").alias("known"))
        nodes = nodes.join(known, "object_name", "left").where("known is null or known = 'UNKNOWN'").drop("known")
    depends = tables.select(name.alias("src_name"), F.upper("schema_name").alias("dst_name"), F.lit("DEPENDS_ON").alias("relationship_type")).distinct()
    feeds = fk_name_match(columns, tables).select(F.upper("referenced").alias("src_name"), F.upper("holder").alias("dst_name"), F.lit("FEEDS").alias("relationship_type")).distinct()
    edges = depends.unionByName(feeds)
    if existing_edges is not None:
        stored_ = existing_edges.select(F.upper("src_name").alias("src_name"), F.upper("dst_name").alias("dst_name"), "relationship_type")
        edges = edges.join(stored_, ["src_name", "dst_name", "relationship_type"], "left_anti")
    return nodes, edges


def fk_name_match(columns: DataFrame, tables: DataFrame) -> DataFrame:
    """(holder, column_name, referenced): a column <x>_id refers to the table x, xs or xes, in this order, if just one table of
    all schemas has that name and it isn't the holder itself."""
    low = F.lower("column_name")
    base = F.regexp_replace(low, "_id$", "")
    wanted = columns.where(low.rlike("._id$")).select(
        F.concat_ws(".", "schema_name", "table_name").alias("holder"), "column_name", F.posexplode(F.array(base, F.concat(base, F.lit("s")), F.concat(base, F.lit("es")))).alias("rank", "name")
    )
    alone = tables.select("schema_name", "table_name").distinct().groupBy(F.lower("table_name").alias("name")).agg(F.count("*").alias("n"), F.first(F.concat_ws(".", "schema_name", "table_name")).alias("referenced")).where("n = 1")
    found = wanted.join(alone, "name").where("holder <> referenced")
    return found.groupBy("holder", "column_name").agg(F.min_by("referenced", "rank").alias("referenced"))


def edges_from_lineage(datasets: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FEEDS edges (src, dst) from dataset edges (src_name, dst_name, step_key), the first step of each pair; and those with an
    endpoint that no node has."""
    key = nodes.groupBy(F.upper("object_name").alias("k")).agg(F.min("node_id").alias("id"))
    first = datasets.groupBy("src_name", "dst_name").agg(F.min("step_key").alias("step_key"))
    both = first.join(key.select(F.col("k").alias("ks"), F.col("id").alias("src")), F.upper("src_name") == F.col("ks"), "left").join(key.select(F.col("k").alias("kd"), F.col("id").alias("dst")), F.upper("dst_name") == F.col("kd"), "left")
    return both.where("src is not null and dst is not null").select("src", "dst", "step_key", F.lit("FEEDS").alias("relationship_type")), both.where("src is null or dst is null").select("src_name", "dst_name", "step_key")


def repair_unknown(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (src_name, dst_name) with UNKNOWN.<name> ends replaced by the one qualified name that ends in <name>, if there
    is just one; edges that become loops or repeat an edge go."""
    unique = names.distinct().groupBy(F.upper(leaf("object_name")).alias("bare")).agg(F.count("*").alias("n"), F.first("object_name").alias("full")).where("n = 1")

    def resolve(df: DataFrame, c: str) -> DataFrame:
        bare = F.when(F.upper(F.col(c)).startswith("UNKNOWN."), F.upper(leaf(c)))
        return df.withColumn("_b", bare).join(unique.select(F.col("bare").alias("_b"), F.col("full").alias("_f")), "_b", "left").withColumn(c, F.coalesce("_f", c)).drop("_b", "_f")

    return resolve(resolve(edges, "src_name"), "dst_name").where("src_name <> dst_name").distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def resolve_display_type(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """display_type: the stored type if known, or for names with a colon; else the catalog's; else VIEW for schemas that end in
    _VW or _VIEW; else TABLE."""
    catalog = tables.groupBy(F.upper(F.concat_ws(".", "schema_name", "table_name")).alias("_k")).agg(F.min("object_type").alias("_t"))
    guess = F.when(F.upper("schema_name").rlike("_(VW|VIEW)$"), "VIEW").otherwise("TABLE")
    kept = F.when((F.col("object_type") != "UNKNOWN") | F.contains("object_name", F.lit(":")), F.col("object_type"))
    return nodes.join(catalog, F.upper("object_name") == F.col("_k"), "left").withColumn("display_type", F.coalesce(kept, "_t", guess)).drop("_k", "_t")


def _resolved(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(_type, _name, node_id) of the distinct names(object_type, object_identifier) that a node stands for. Names that are no column's look up their own
    name as the parent's, which says the same as the name alone: no nulls meet in one task."""
    low = F.lower("object_identifier")
    typed = nodes.groupBy(F.upper("object_type").alias("_t"), F.lower("object_name").alias("_n")).agg(F.max("node_id").alias("_exact"))
    named = nodes.groupBy(F.lower("object_name").alias("_n")).agg(F.max("node_id").alias("_id"))
    parent = F.when(F.col("object_type") == "COLUMN", F.regexp_replace(low, r"\.[^.]*$", "")).otherwise(low)
    found = names.select(F.col("object_type").alias("_type"), F.col("object_identifier").alias("_name"), F.upper("object_type").alias("_t"), low.alias("_n"), parent.alias("_p")).distinct()
    found = found.join(typed, ["_t", "_n"], "left").join(named.select(F.col("_n").alias("_p"), F.col("_id").alias("_parent")), "_p", "left").join(named.select("_n", F.col("_id").alias("_any")), "_n", "left")
    return found.select("_type", "_name", F.coalesce("_exact", "_parent", "_any").alias("node_id")).where("node_id is not null")


_BY_NAME = "object_type <=> _type and object_identifier = _name"


def link_changes(changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """changes with node_id: by type and name; for columns, else by the parent's name; else by name alone. Unresolved go. A name is looked up
    once, however many changes bear it."""
    return changes.join(_resolved(changes, nodes), F.expr(_BY_NAME)).drop("_type", "_name")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    """Natural keys (type, name) that more than one node has; linking expects none."""
    return nodes.groupBy("object_type", F.lower("object_name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def walk(edges: DataFrame, starts: DataFrame, max_depth: int, edge_types: list[str] | None = None, upstream: bool = False) -> DataFrame:
    """(start, node, depth, path, score): one row for each simple path from starts(start), over parallel edges each; score is
    1 / depth. A loop on the start itself is a path of depth 1. Upstream paths end at the start."""
    if edge_types:
        edges = edges.where(F.col("relationship_type").isin(edge_types))
    step = edges.select(F.col("dst").alias("_a"), F.col("src").alias("_b")) if upstream else edges.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    grown = lambda node, path: F.array_insert(path, F.lit(1), node) if upstream else F.array_append(path, node)
    now = starts.select("start").distinct().join(step, F.col("start") == F.col("_a")).select("start", F.col("_b").alias("node"))
    now = now.withColumn("path", F.array("node", "start") if upstream else F.array("start", "node"))
    # Each level but the last is written once and read by the next, so that a plan has one join a level.
    now = cut(now) if max_depth > 1 else now
    out = now.withColumn("depth", F.lit(1))
    for depth in range(2, max_depth + 1):
        if now.isEmpty():
            break
        now = now.join(step, F.col("node") == F.col("_a")).where(~F.array_contains("path", F.col("_b"))).select("start", F.col("_b").alias("node"), grown(F.col("_b"), F.col("path")).alias("path"))
        if depth < max_depth:
            now = cut(now)
        out = out.unionByName(now.withColumn("depth", F.lit(depth)))
    return out.select("start", "node", "depth", "path", F.round(1 / F.col("depth"), 4).alias("score"))


def path_counts(edges: DataFrame) -> DataFrame:
    """(node, d1, d2, d3): how many simple paths of one, two and three steps start at each node, as walk() has them, without making the paths.

    Paths of two steps are the targets' out-degrees less the way back; those of three steps are sums of that over neighbours, less the ways back and the
    closed triangles. A triangle is found from its corner of least degree, which keeps hubs from being multiplied out. Paths that begin with a
    loop on the start go on from it as from a new start."""
    parallel = edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
    loops = parallel.where("src = dst").select(F.col("src").alias("node"), F.col("m").alias("loops"))
    e = cut(parallel.where("src <> dst"))
    out = e.groupBy(F.col("src").alias("dst")).agg(F.sum("m").alias("o"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("m").alias("back"))
    both = e.join(back, ["src", "dst"], "left").join(out, "dst", "left").na.fill(0, ["back", "o"])
    w = cut(both.withColumn("w", F.col("m") * (F.col("o") - F.col("back"))))
    two = w.groupBy(F.col("src").alias("dst")).agg(F.sum("w").alias("two"))
    there = w.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("w_back"))
    three = w.join(there, ["src", "dst"], "left").join(two, "dst", "left").na.fill(0, ["w_back", "two"])
    three = three.groupBy(F.col("src").alias("node")).agg(F.sum("m").alias("o"), F.sum("w").alias("two"), F.sum(F.col("m") * (F.col("two") - F.col("w_back"))).alias("three"))
    degree = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    rank = lambda c: degree.select(F.col("node").alias(c), F.struct("n", "node").alias(f"rank_{c}"))
    ranked = e.join(rank("src"), "src").join(rank("dst"), "dst")
    first = ranked.where("rank_src < rank_dst").select(F.col("src").alias("p"), F.col("dst").alias("a"), F.col("m").alias("m1"))
    last = ranked.where("rank_dst < rank_src").select(F.col("dst").alias("p"), F.col("src").alias("b"), F.col("m").alias("m3"))
    closed = first.join(last, "p").join(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("m").alias("m2")), ["a", "b"])
    triangles = closed.select(F.explode(F.array("p", "a", "b")).alias("node"), (F.col("m1") * F.col("m2") * F.col("m3")).alias("t")).groupBy("node").agg(F.sum("t").alias("t"))
    all_ = three.join(loops, "node", "full_outer").join(triangles, "node", "left").na.fill(0, ["o", "two", "three", "loops", "t"])
    return all_.select("node", (F.col("o") + F.col("loops")).alias("d1"), (F.col("two") + F.col("loops") * F.col("o")).alias("d2"), (F.col("three") - F.col("t") + F.col("loops") * F.col("two")).alias("d3"))


def impact_summaries(changes: DataFrame, nodes: DataFrame, edges: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(change_id, direct, indirect, score, max_depth) of every change: its node's paths of up to three steps down, and up for score and depth. They are
    counted for all nodes at once. Changes that no node stands for get zeros; those in done(change_id) are left out."""
    if done is not None:
        changes = changes.join(done.select("change_id").distinct(), "change_id", "left_anti")
    up = path_counts(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).toDF("node", "u1", "u2", "u3")
    # Paths are looked up for names, which are few next to changes or spread like them; a join of changes by node would send those of no node to one task.
    linked = _resolved(changes, nodes).withColumnRenamed("node_id", "node").join(path_counts(edges), "node", "left").join(up, "node", "left")
    out = changes.select("change_id", "object_type", "object_identifier").join(linked, F.expr(_BY_NAME), "left").na.fill(0, ["d1", "d2", "d3", "u1", "u2", "u3"])
    score = F.round((F.col("d1") + F.col("u1")) * 1.0 + (F.col("d2") + F.col("u2")) * 0.5 + (F.col("d3") + F.col("u3")) * 0.3333, 4)
    depth = F.when(F.col("d3") + F.col("u3") > 0, 3).when(F.col("d2") + F.col("u2") > 0, 2).when(F.col("d1") + F.col("u1") > 0, 1).otherwise(0)
    return out.select("change_id", F.col("d1").alias("direct"), (F.col("d2") + F.col("d3")).alias("indirect"), score.alias("score"), depth.alias("max_depth"))


def impact_of(start: int, nodes: DataFrame, edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """The start itself (depth 0, score 1) and all paths down and up from it, with names."""
    starts = nodes.where(F.col("node_id") == start).select(F.col("node_id").alias("start"))
    root = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"), F.lit(1.0).alias("score"), F.lit("root").alias("way"))
    down, up = walk(edges, starts, max_depth).withColumn("way", F.lit("down")), walk(edges, starts, max_depth, upstream=True).withColumn("way", F.lit("up"))
    return root.unionByName(down).unionByName(up).join(nodes.select(F.col("node_id").alias("node"), "object_name", "object_type"), "node", "left")


def hops(edges: DataFrame, start: int, most: int, direction: str = "both", max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(node, hop): shortest distances from start, by frontiers; each hop keeps at most max_nodes nodes in all, the smallest first, out of its first
    max_edges edges a direction."""
    spark = edges.sparkSession
    down, up = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    steps = {"downstream": [down], "upstream": [up], "both": [down, up]}[direction]
    first = lambda df: df.orderBy("a", "b").limit(max_edges) if max_edges else df
    seen = frontier = spark.range(1).select(F.lit(start).cast("long").alias("node"), F.lit(0).alias("hop"))
    for hop in range(1, most + 1):
        found = [first(step.join(frontier.select(F.col("node").alias("a")), "a")).select(F.col("b").alias("node")) for step in steps]
        frontier = (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct().join(seen, "node", "left_anti").withColumn("hop", F.lit(hop))
        if max_nodes:
            frontier = frontier.orderBy("node").limit(max_nodes)
        seen = seen.unionByName(frontier)
        if hop % 3 == 0:  # cut the plan; also tells whether there is anything left to walk
            seen = cut(seen)
            frontier = seen.where(F.col("hop") == hop)
            if frontier.isEmpty():
                break
    if max_nodes:
        seen = seen.orderBy("hop", "node").limit(max_nodes)
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes(node)."""
    ids = nodes.select("node")
    return edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "relationship_type").distinct()


def focus_subgraph(edges: DataFrame, start: int, most: int = 2, max_nodes: int = 1000, edge_types: list[str] | None = None, direction: str = "both") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, hop) around start, the distinct edges between them, and whether they were capped, as one row (capped). A hop looks at its first
    10 * max_nodes edges a direction, in order."""
    if edge_types:
        edges = edges.where(F.col("relationship_type").isin(edge_types))
    wide = hops(edges, start, most, direction, max_nodes + 1, 10 * max_nodes)
    near = wide.orderBy("hop", "node").limit(max_nodes)
    return near, induced(edges, near), wide.agg((F.count("*") > max_nodes).alias("capped"))


def graph_meta(nodes: DataFrame, edges: DataFrame, cap: int = 5000) -> DataFrame:
    n, m = nodes.agg(F.count("*").alias("node_count")), edges.agg(F.count("*").alias("edge_count"))
    return n.join(F.broadcast(m)).withColumn("truncated", F.col("node_count") > cap)


def full_graph(nodes: DataFrame, edges: DataFrame, cap: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All nodes and edges, or none of either if there are more nodes than the cap, and graph_meta. Its one row decides while the frames are read."""
    meta = graph_meta(nodes, edges, cap)
    whole = F.broadcast(meta.where("not truncated").select(F.lit(True).alias("_whole")))
    return nodes.join(whole).drop("_whole"), edges.join(whole).drop("_whole"), meta


def column_lineage(lineage: DataFrame, table: str, tier: str | None = None, most: int = 5000) -> DataFrame:
    """(column_name, direction, partner, tier, total): direct edges of a table's columns, one for each partner, and its predicates (targets
    NOT APPLICABLE) as direction indirect, all of them. `total` counts the direct ones. A table's first `most` lineage rows by their keys are read."""
    own = F.upper(F.substring_index("source_key", "|", 1)) == table.upper()
    into = F.upper(F.substring_index("target_key", "|", 1)) == table.upper()
    if tier is not None:
        lineage = lineage.where(F.col("tier") == tier.upper())
    lineage = lineage.where(own | into).orderBy("source_key", "target_key", "tier").limit(most)
    row = lambda df, side, other, way: df.select(F.substring_index(side, "|", -1).alias("column_name"), F.lit(way).alias("direction"), F.col(other).alias("partner"), "tier")
    down = row(lineage.where(own & (F.col("target_key") != "NOT APPLICABLE")), "source_key", "target_key", "downstream")
    up = row(lineage.where(into), "target_key", "source_key", "upstream")
    direct = down.unionByName(up).groupBy("column_name", "direction", "partner").agg(F.min("tier").alias("tier"))
    both = direct.unionByName(row(lineage.where(own & (F.col("target_key") == "NOT APPLICABLE")), "source_key", "target_key", "indirect"))
    return both.join(F.broadcast(direct.agg(F.count("*").alias("total"))))


def traverse_columns(lineage: DataFrame, key: str, direction: str = "downstream", max_depth: int = 20, max_nodes: int = 2000) -> DataFrame:
    """(column_key, depth, path): columns by shortest distance, with the first path in order; predicates are skipped. Once max_nodes columns are found
    no further step is taken; the step that finds them is given whole. Each step is written once."""
    real = lineage.where("source_key <> 'NOT APPLICABLE' and target_key <> 'NOT APPLICABLE'").select("source_key", "target_key").distinct()
    step = real.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")) if direction == "downstream" else real.select(F.col("target_key").alias("a"), F.col("source_key").alias("b"))
    seen = frontier = lineage.sparkSession.range(1).select(F.lit(key).alias("column_key"), F.lit(0).alias("depth"), F.array(F.lit(key)).alias("path"))
    found = 0
    for depth in range(1, max_depth + 1):
        grown = frontier.join(step, F.col("column_key") == F.col("a")).select(F.col("b").alias("column_key"), F.array_append("path", F.col("b")).alias("path"))
        frontier = cut(grown.groupBy("column_key").agg(F.min("path").alias("path")).join(seen, "column_key", "left_anti").select("column_key", F.lit(depth).alias("depth"), "path"))
        seen = seen.unionByName(frontier)
        new = frontier.count()
        found += new
        if not new or found >= max_nodes:
            break
    return seen.where("depth > 0")


#: Up to so many walks an edge are made without looking for components first: the rounds of these cost more than the walks.
_WALKS = 16


def _walks(edges: DataFrame, length: int) -> float:
    """How many walks of `length` of edges(src, dst) there are, by sums along the edges."""
    ahead = edges.groupBy("src").agg(F.count("*").cast("double").alias("n"))
    for _ in range(length - 1):
        ahead = edges.join(ahead.toDF("dst", "n"), "dst").groupBy("src").agg(F.sum("n").alias("n"))
    return ahead.agg(F.sum("n")).first()[0] or 0.0


def detect_cycles(edges: DataFrame, max_length: int = 4) -> DataFrame:
    """(cycle, length): simple cycles up to max_length, each once, from its smallest node on; loops are cycles of length 1. If an edge begins many walks of that length,
    less one, cycles are looked for within strong components only, so that paths between them are never made. The last edge of a cycle is met by both its ends."""
    step = cut(edges.select("src", "dst").distinct())
    if max_length > 2 and _walks(step, max_length - 1) > _WALKS * step.count():
        own = strong_components(step)
        within = step.join(own.toDF("src", "_s"), "src", "left").join(own.toDF("dst", "_d"), "dst", "left")
        step = cut(within.where("_s = _d or src = dst").select("src", "dst"))
    hop = step.where("src <> dst").select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    out = step.where("src = dst").select(F.array("src").alias("cycle"))
    now = step.where("dst > src").select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    for length in range(2, max_length + 1):
        out = out.unionByName(now.join(hop, (F.col("last") == F.col("_a")) & (F.col("first") == F.col("_b"))).select(F.col("path").alias("cycle")))
        if length < max_length:
            nxt = now.join(hop, F.col("last") == F.col("_a"))
            now = nxt.where((F.col("_b") > F.col("first")) & ~F.array_contains("path", F.col("_b"))).select("first", F.col("_b").alias("last"), F.array_append("path", F.col("_b")).alias("path"))
    return out.distinct().withColumn("length", F.size("cycle"))


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """in_degree, out_degree, fragility = out / greatest out, is_hub = in above twice the mean in-degree of all nodes."""
    ins, outs = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("in_degree")), edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    both = nodes.join(ins, "node_id", "left").join(outs, "node_id", "left").na.fill(0, ["in_degree", "out_degree"])
    whole = both.agg(F.max("out_degree").alias("_most"), F.sum("in_degree").alias("_in"), F.count("*").alias("_n"))
    out = both.join(F.broadcast(whole))
    return out.withColumns({"fragility": F.round(F.col("out_degree") / F.greatest("_most", F.lit(1)), 4), "is_hub": F.col("in_degree") * F.col("_n") > 2 * F.col("_in")}).drop("_most", "_in", "_n")


def broken_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without a source or, if that is there, without a target node."""
    ids = nodes.select(F.col("node_id").alias("_id"), F.lit(True).alias("_ok"))
    both = edges.join(ids.toDF("src", "_s"), "src", "left").join(ids.toDF("dst", "_d"), "dst", "left")
    return both.where("_s is null or _d is null").select("src", "dst", F.when(F.col("_s").isNull(), "source").otherwise("target").alias("missing"))


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("node_id")).unionByName(edges.select(F.col("dst").alias("node_id")))
    return nodes.where(~F.col("object_type").isin("SCHEMA", "DATABASE")).join(ends, "node_id", "left_anti")


def hub_changes(changes: DataFrame, metrics: DataFrame) -> DataFrame:
    hubs = metrics.where("is_hub").select(F.lower("object_name").alias("_h")).distinct()
    return changes.join(hubs, F.lower("object_identifier") == F.col("_h"), "left_semi")


def proactive_alerts(nodes: DataFrame, edges: DataFrame, changes: DataFrame, caps: tuple[int, int, int] = (15, 10, 10)) -> DataFrame:
    """(alert_type, severity, subject): the first broken edges, orphans and changes on hubs, each kind up to its cap."""
    broken = broken_edges(edges, nodes).select(F.lit("BROKEN_EDGE").alias("alert_type"), F.lit("HIGH").alias("severity"), F.concat_ws("->", "src", "dst").alias("subject")).orderBy("subject").limit(caps[0])
    orphan = orphan_nodes(nodes, edges).select(F.lit("ORPHAN_NODE").alias("alert_type"), F.lit("MEDIUM").alias("severity"), F.col("object_name").alias("subject")).orderBy("subject").limit(caps[1])
    hub = hub_changes(changes, node_metrics(nodes, edges)).orderBy(F.desc("detected_at"), F.desc("change_id")).limit(caps[2])
    return broken.unionByName(orphan).unionByName(hub.select(F.lit("HUB_CHANGE").alias("alert_type"), F.lit("HIGH").alias("severity"), F.concat_ws(":", F.col("change_id").cast("string"), "object_identifier").alias("subject")))


def what_if(hypothetical: DataFrame, nodes: DataFrame, edges: DataFrame, usage: DataFrame, depth: int = 8, context: int = 10) -> DataFrame:
    """Impact of hypothetical changes (hyp_id, change_type, object_name): direct and indirect paths down, the first upstream paths as context, queries and
    users over the affected names, and the risk. Column changes are anchored at their table. Names without usage of their own take that of the first
    name with the same last part."""
    anchor = F.when(F.col("change_type").startswith("COLUMN"), F.substring_index("object_name", ".", 2)).otherwise(F.col("object_name"))
    breaking = F.col("change_type").isin("TABLE_REMOVED", "TABLE_TYPE_CHANGED", "COLUMN_REMOVED", "COLUMN_TYPE_CHANGED")
    ids = nodes.groupBy(F.lower("object_name").alias("_n")).agg(F.max("node_id").alias("start"))
    base = hypothetical.withColumns({"_n": F.lower(anchor), "is_breaking": breaking}).join(ids, "_n", "left")
    starts = base.where("start is not null").select("start").distinct()
    down = walk(edges, starts, depth)
    up = walk(edges, starts, depth, upstream=True).withColumn("_r", F.row_number().over(Window.partitionBy("start").orderBy("depth", "node", "path"))).where(F.col("_r") <= context)
    names = nodes.select(F.col("node_id").alias("node"), F.lower("object_name").alias("name"))
    full = usage.groupBy(F.lower("object_name").alias("name")).agg(F.sum("query_count").alias("q"), F.sum("user_count").alias("u"))
    short = full.groupBy(leaf("name").alias("short")).agg(F.min_by(F.struct("q", "u"), "name").alias("s"))
    affected = down.select("start", "node").unionByName(up.select("start", "node")).unionByName(starts.select("start", F.col("start").alias("node"))).distinct()
    used = affected.join(names, "node").join(full, "name", "left").join(short, leaf("name") == F.col("short"), "left")
    touched = used.groupBy("start").agg(F.sum(F.coalesce("q", "s.q")).alias("total_queries"), F.sum(F.coalesce("u", "s.u")).alias("total_users"))
    paths = down.groupBy("start").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"))
    out = base.join(paths, "start", "left").join(up.groupBy("start").agg(F.count("*").alias("upstream")), "start", "left").join(touched, "start", "left").na.fill(0, ["direct", "indirect", "upstream", "total_queries", "total_users"])
    n, q = F.col("direct") + F.col("indirect") + F.col("upstream"), F.col("total_queries")
    risk = F.when(F.col("is_breaking") & ((n >= 3) | (q >= 5000)), "HIGH").when(F.col("is_breaking") | (n >= 5) | (q >= 1000), "MEDIUM").otherwise("LOW")
    return out.select("hyp_id", "change_type", "object_name", "is_breaking", "direct", "indirect", "upstream", "total_queries", "total_users", risk.alias("risk"))


def chain_check(chain: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pos, object_name, next_name, found, linked) for an expected chain(pos, object_name): are the node and the edge to the next there?"""
    ids = nodes.groupBy(F.lower("object_name").alias("_n")).agg(F.max("node_id").alias("id"))
    step = chain.withColumn("next_name", F.lead("object_name").over(Window.partitionBy(F.lit(0)).orderBy("pos")))
    step = step.join(ids, F.lower("object_name") == F.col("_n"), "left").drop("_n").join(ids.toDF("_m", "next_id"), F.lower("next_name") == F.col("_m"), "left")
    return step.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("next_id"), F.lit(True).alias("_e")).distinct(), ["id", "next_id"], "left").select("pos", "object_name", "next_name", F.col("id").isNotNull().alias("found"), F.coalesce("_e", F.lit(False)).alias("linked"))


def tier_support(lineage: DataFrame, tier3: DataFrame) -> DataFrame:
    """(check, source_key, target_key): tier-2 edges without tier 1, facts without either, and dataset pairs of tier 1 or 2 without a tier-3
    edge(source_table, target_table)."""
    pair = ["source_key", "target_key"]
    at = lambda *tiers: lineage.where(F.col("tier").isin(*tiers)).select(pair)
    named = lambda df, check: df.withColumn("check", F.lit(check))
    rolled = at("TIER1", "TIER2").select(F.substring_index("source_key", "|", 1).alias("source_key"), F.substring_index("target_key", "|", 1).alias("target_key"))
    missing = named(rolled.subtract(tier3.toDF(*pair)), "missing_tier3")
    return named(at("TIER2").subtract(at("TIER1")), "tier2_without_tier1").unionByName(named(at("FACT").subtract(at("TIER1", "TIER2")), "fact_without_tiers")).unionByName(missing)


def neighbourhood_roles(edges: DataFrame, root: int, most: int) -> DataFrame:
    """(node, role, hop, self_loop) around root over FEEDS edges: upstream first, then downstream; the first role holds."""
    feeds = edges.where("relationship_type = 'FEEDS'")
    clean = drop_self_loops(feeds)
    up, down = hops(clean, root, most, "upstream").where("hop > 0").withColumns({"role": F.lit("upstream"), "r": F.lit(1)}), hops(clean, root, most, "downstream").where("hop > 0").withColumns({"role": F.lit("downstream"), "r": F.lit(2)})
    centre = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("node"), F.lit(0).alias("hop"), F.lit("center").alias("role"), F.lit(0).alias("r"))
    first = centre.unionByName(up).unionByName(down).groupBy("node").agg(F.min(F.struct("r", "hop", "role")).alias("x"))
    loops = feeds.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("self_loop")).distinct()
    return first.join(loops, "node", "left").select("node", "x.role", "x.hop", F.coalesce("self_loop", F.lit(False)).alias("self_loop"))


def column_edge_rollup(lineage: DataFrame) -> DataFrame:
    """Per pair of different tables: distinct column pairs with their transformation, steps, source and target columns."""
    side = lambda c, k: F.substring_index(c, "|", k)
    rows = lineage.where("target_key <> 'NOT APPLICABLE'").select(side("source_key", 1).alias("src_table"), side("target_key", 1).alias("tgt_table"), side("source_key", -1).alias("sc"), side("target_key", -1).alias("tc"), "transformation_type", "step_key").where("src_table <> tgt_table")
    return rows.groupBy("src_table", "tgt_table").agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("sc", F.lit(">"), "tc", F.lit(":"), F.coalesce("transformation_type", F.lit(""))))), ",").alias("labels"),
        F.count_distinct("step_key").alias("n_steps"), F.count_distinct("sc").alias("n_source_columns"), F.count_distinct("tc").alias("n_target_columns"),
    )


def indirect_rollup(lineage: DataFrame) -> DataFrame:
    return lineage.where("target_key = 'NOT APPLICABLE'").groupBy(F.substring_index("source_key", "|", 1).alias("table_key"), F.coalesce("transformation_type", F.lit("")).alias("transformation_type"), F.coalesce("expression", F.lit("")).alias("expression")).agg(F.count("*").alias("n"))


def isolation_check(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, problem) for edges(snapshot_id, src, dst) whose endpoints are missing or of another snapshot than their own."""
    at = nodes.select(F.col("node_id").alias("_id"), F.col("snapshot_id").alias("_snap"))
    both = edges.join(at.toDF("src", "_s"), "src", "left").join(at.toDF("dst", "_d"), "dst", "left")
    problem = F.when(F.col("_s").isNull() | F.col("_d").isNull(), "missing endpoint").when((F.col("_s") != F.col("snapshot_id")) | (F.col("_d") != F.col("snapshot_id")), "other snapshot")
    return both.withColumn("problem", problem).where("problem is not null").select("snapshot_id", "src", "dst", "problem")



def alignment_check(impacts: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(change_id, node_id, snapshot_id, problem) for impacts whose change is missing or led to another snapshot, or whose node is missing or of another."""
    both = impacts.join(changes.select("change_id", F.col("snapshot_to").alias("_to")), "change_id", "left").join(nodes.select("node_id", F.col("snapshot_id").alias("_at")), "node_id", "left")
    problem = F.when(F.col("_to").isNull(), "missing change").when(F.col("_to") != F.col("snapshot_id"), "change of another snapshot").when(F.col("_at").isNull(), "missing node").when(F.col("_at") != F.col("snapshot_id"), "node of another snapshot")
    return both.withColumn("problem", problem).where("problem is not null").select("change_id", "node_id", "snapshot_id", "problem")
