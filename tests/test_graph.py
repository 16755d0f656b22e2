import random

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import graph


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(1, 2, "FEEDS"), (2, 3, "FEEDS"), (3, 4, "FEEDS")], "src long, dst long, relationship_type string")


def _starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start long")


def _reach(df):
    return {r.node: r.depth for r in df.collect()}


def test_chain(spark, chain):
    assert _reach(graph.walk(chain, _starts(spark, 1), 8)) == {2: 1, 3: 2, 4: 3}
    assert _reach(graph.walk(chain, _starts(spark, 1), 2)) == {2: 1, 3: 2}
    up = graph.walk(chain, _starts(spark, 4), 8, upstream=True)
    assert _reach(up) == {3: 1, 2: 2, 1: 3}
    assert sorted(up.where("depth = 3").first().path) == [1, 2, 3, 4] and up.where("depth = 3").first().path[-1] == 4


def test_cycle_and_loop(spark):
    two = spark.createDataFrame([(1, 2, "FEEDS"), (2, 1, "FEEDS"), (5, 5, "FEEDS")], "src long, dst long, relationship_type string")
    assert _reach(graph.walk(two, _starts(spark, 1), 8)) == {2: 1}
    assert _reach(graph.walk(two, _starts(spark, 5), 8)) == {5: 1}
    assert [r.cycle for r in graph.detect_cycles(two).orderBy("cycle").collect()] == [[1, 2], [5]]


def test_paths_are_counted_as_walked(spark):
    import random

    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(14), rng.randrange(14), rng.choice("FD")) for _ in range(60)] + [(3, 3, "F")], "src long, dst long, relationship_type string")
    walked = {(r.start, r.depth): r["count"] for r in graph.walk(edges, _starts(spark, *range(14)), 3).groupBy("start", "depth").count().collect()}
    counted = {r.node: (r.d1, r.d2, r.d3) for r in graph.path_counts(edges).collect()}
    assert {k: counted.get(k, (0, 0, 0)) for k in range(14)} == {k: tuple(walked.get((k, d), 0) for d in (1, 2, 3)) for k in range(14)}


def test_plan_has_one_join_a_level(spark, chain):
    plan = graph.walk(chain, _starts(spark, 1), 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 8


def test_isolated_node(spark, chain):
    assert graph.walk(chain, _starts(spark, 9), 3).count() == 0


def test_paths_count_each(spark):
    diamond = spark.createDataFrame([(1, 2, "F"), (1, 3, "F"), (2, 4, "F"), (3, 4, "F")], "src long, dst long, relationship_type string")
    assert graph.walk(diamond, _starts(spark, 1), 3).where("node = 4").count() == 2


def test_link_falls_back_to_parent(spark):
    nodes = spark.createDataFrame([(1, "TABLE", "S.T"), (2, "SCHEMA", "S")], "node_id long, object_type string, object_name string")
    changes = spark.createDataFrame([(1, "COLUMN", "s.t.c"), (2, "TABLE", "s"), (3, "TABLE", "q.q")], "change_id long, object_type string, object_identifier string")
    assert {r.change_id: r.node_id for r in graph.link_changes(changes, nodes).collect()} == {1: 1, 2: 2}


def test_fk_names(spark):
    tables = spark.createDataFrame([("s", "users", "TABLE"), ("s", "box", "TABLE"), ("s", "boxes", "TABLE"), ("s", "orders", "TABLE"), ("r", "dup", "TABLE"), ("s", "dup", "TABLE")], "schema_name string, table_name string, object_type string")
    columns = spark.createDataFrame([("s", "orders", "user_id"), ("s", "orders", "box_id"), ("s", "orders", "dup_id"), ("s", "orders", "order_id")], "schema_name string, table_name string, column_name string")
    got = {r.column_name: r.referenced for r in graph.fk_name_match(columns, tables).collect()}
    assert got == {"user_id": "s.users", "box_id": "s.box"}


def _plain_components(edges):
    """Node: greatest node of its strong component, where that has others."""
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[b] <= reach[a]:
                reach[a] |= reach[b]
                changed = True
    own = {n: {m for m in reach[n] if n in reach[m]} for n in nodes}
    return {n: max(c) for n, c in own.items() if len(c) > 1}


def test_strong_components_and_cycles(spark):
    rng = random.Random(11)
    for n, m in ((1, 1), (12, 15), (40, 60)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)} | {(k + 100, k + 101) for k in range(5)} | {(200 + k, 200 + (k + 1) % 7) for k in range(7)}
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        assert {r.node: r.component for r in graph.strong_components(df).collect()} == _plain_components(edges)
        out = {}
        for a, b in edges:
            out.setdefault(a, []).append(b)
        cycles = set()

        def walk(path):
            for b in out.get(path[-1], []):  # noqa: B023
                if b == path[0]:
                    cycles.add(tuple(path))  # noqa: B023
                elif b > path[0] and b not in path and len(path) < 4:
                    walk([*path, b])

        for a in out:
            walk([a])
        assert {tuple(r.cycle) for r in graph.detect_cycles(df).collect()} == cycles
    assert graph.strong_components(df.limit(0)).count() == 0 and graph.detect_cycles(df.limit(0)).count() == 0


def test_a_walk_writes_each_level_once(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or df.cache())
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)], "src long, dst long").withColumn("relationship_type", F.lit("FEEDS"))
    found = graph.walk(edges, spark.createDataFrame([(0,)], "start long"), 4)
    assert sorted(r.depth for r in found.collect()) == [1, 2, 3, 4] and len(cuts) == 3


def test_traversal_stops_at_its_cap(spark):
    lineage = spark.createDataFrame([("r", f"a{k}") for k in range(5)] + [(f"a{k}", f"b{k}{j}") for k in range(5) for j in range(5)] + [("b00", "c")], "source_key string, target_key string")
    depths = lambda cap: sorted(r.depth for r in graph.traverse_columns(lineage, "r", max_nodes=cap).collect())
    assert depths(5) == [1] * 5 and depths(6) == [1] * 5 + [2] * 25 and depths(2000) == [1] * 5 + [2] * 25 + [3]


def test_long_rings_and_ways_take_few_rounds(spark, monkeypatch):
    """Rings, ways that hang on them, and ways between nodes of one component and of several."""
    from shiftlens.operators import components

    rounds = []
    monkeypatch.setattr(components.Steps, "stored", lambda self, df: rounds.append(1) or df.localCheckpoint())
    ring = lambda first, n: [(first + k, first + (k + 1) % n) for k in range(n)]
    edges = {*ring(0, 90), *ring(100, 60), (100, 130), (89, 200), *((200 + k, 201 + k) for k in range(40)), (240, 100), *ring(300, 2), (300, 320), (320, 321), (321, 300), (400, 401), (401, 402), (402, 400), (401, 0)}
    got = {r.node: r.component for r in components.strong_components(spark.createDataFrame(sorted(edges), "src long, dst long")).collect()}
    assert got == _plain_components(edges) and len(rounds) < 60


def test_changes_that_share_an_id_are_each_summed_once(spark):
    """Names are looked up once: null types, names of no node, and changes with the same id are rows of their own."""
    nodes = spark.createDataFrame([(1, "S.A", "TABLE", "S"), (2, "S.B", "TABLE", "S")], "node_id long, object_name string, object_type string, schema_name string")
    edges = spark.createDataFrame([(1, 2, "FEEDS")], "src long, dst long, relationship_type string")
    changes = spark.createDataFrame([(7, "TABLE", "s.a"), (7, "COLUMN", "S.A.C"), (8, None, "S.A"), (9, "SCHEMA", "S"), (10, "TABLE", None)], "change_id long, object_type string, object_identifier string")
    got = sorted((r.change_id, r.direct, r.max_depth) for r in graph.impact_summaries(changes, nodes, edges).collect())
    assert got == [(7, 1, 1), (7, 1, 1), (8, 1, 1), (9, 0, 0), (10, 0, 0)]
    assert sorted((r.change_id, r.node_id) for r in graph.link_changes(changes, nodes).collect()) == [(7, 1), (7, 1), (8, 1)]


def test_cycles_with_and_without_components(spark, monkeypatch):
    """Components are looked for where edges begin many walks, and only there; cycles are the same."""
    called, plain = [], graph.strong_components
    monkeypatch.setattr(graph, "strong_components", lambda e: called.append(1) or plain(e))
    maps = {(k, (2 * k + 1) % 60) for k in range(60)} | {(k, (3 * k + 1) % 60) for k in range(0, 60, 3)}
    hubs = {(a, 100 + b) for a in range(30) for b in range(3)} | {(100 + a, 200 + b) for a in range(3) for b in range(3)} | {(200 + a, 300 + b) for a in range(3) for b in range(300)} | {(300, 0), (0, 0), (7, None)}
    found = lambda edges, n: sorted((*r.cycle, r.length) for r in graph.detect_cycles(spark.createDataFrame(list(edges), "src long, dst long"), n).collect())
    few = found(maps, 4)
    assert few and not called
    many = found(hubs, 4)
    assert len(called) == 1 and len(many) == 10 and (0, 100, 200, 300, 4) in many and (0, 1) in many
    monkeypatch.setattr(graph, "_WALKS", 0)
    assert found(maps, 4) == few and len(called) == 2
    monkeypatch.setattr(graph, "_WALKS", 1e9)
    assert found(hubs, 4) == many and found(hubs, 3) == found(hubs, 1) == [(0, 1)] and len(called) == 2
