import datetime

from shiftlens.operators import metrics, mining


def _changes(spark, rows):
    return spark.createDataFrame([(k, f - 1, f, t, o, i) for k, (f, t, o, i) in enumerate(rows)], "change_id long, snapshot_from long, snapshot_to long, change_type string, object_type string, object_identifier string")


def test_anomaly_needs_spread_or_a_jump(spark):
    snaps = spark.createDataFrame([(k,) for k in range(1, 6)], "snapshot_id long")
    rows = [(k, "TABLE_ADDED", "TABLE", "s.t") for k in range(1, 6)] + [(3, "TABLE_ADDED", "TABLE", "s.u")] * 4
    got = mining.change_anomalies(_changes(spark, rows), snaps).collect()
    assert [(r.snapshot_to, r.n, r.z, r.severity) for r in got] == [(3, 5, 3.0, "HIGH")]
    assert mining.change_anomalies(_changes(spark, rows), snaps.where("snapshot_id < 4")).count() == 0  # too short a baseline


def test_rules(spark):
    rows = [(k, "COLUMN_ADDED", "COLUMN", i) for k in (2, 3) for i in ("s.a.x", "s.a.y", "s.b.x")] + [(k, "TABLE_ADDED", "TABLE", i) for k in (4, 5) for i in ("s.c", "s.d")]
    got = mining.cochange_rules(_changes(spark, rows)).collect()
    assert [(r.antecedent, r.consequent, r.support, r.lift) for r in got] == [("s.a", "s.b", 2, 2.0), ("s.c", "s.d", 2, 2.0)]


def test_criticality_falls_back_to_bare_names(spark):
    nodes = spark.createDataFrame([("S.A", 1.0), ("S.B", 0.0)], "object_name string, fragility double")
    usage = spark.createDataFrame([("s.a", 10), ("x.b", 5)], "object_name string, query_count long")
    got = {r.object_name: (r.usage_score, r.combined, r.level) for r in metrics.criticality(nodes, usage).collect()}
    assert got == {"S.A": (1.0, 1.0, "HIGH"), "S.B": (0.5, 0.3, "MEDIUM")}
    assert {r.object_name: r.level for r in metrics.criticality(nodes, None).collect()} == {"S.A": "HIGH", "S.B": "LOW"}


def test_baselines(spark):
    day = datetime.date(2024, 1, 1)
    snaps = spark.createDataFrame([(k, day + datetime.timedelta(d), "A") for k, d in ((1, 0), (2, 7), (3, 15), (4, 16))], "snapshot_id long, snapshot_date date, source_system string")
    got = {r.snapshot_id: (r.is_gap, r.baseline_id) for r in metrics.assign_baselines(snaps).collect()}
    assert got == {1: (False, 1), 2: (False, 1), 3: (True, 3), 4: (False, 3)}


def test_pii(spark):
    names = spark.createDataFrame([("CustEmail",), ("dob_x",), ("amount",)], "column_name string")
    assert [r.pii_label for r in mining.pii_classify(names).collect()] == ["EMAIL", "DOB", "NONE"]


def test_hash_sees_structure_only(spark):
    t = spark.createDataFrame([(1, "s", "a", "TABLE"), (2, "s", "a", "TABLE"), (3, "s", "a", "VIEW")], "snapshot_id long, schema_name string, table_name string, object_type string")
    c = spark.createDataFrame([(k, "s", "a", x, "INT", True, 1) for k in (1, 2, 3) for x in ("p", "q")], "snapshot_id long, schema_name string, table_name string, column_name string, data_type string, nullable boolean, ordinal_position int")
    got = {r.snapshot_id: r.structural_hash for r in metrics.structural_hash(t, c).collect()}
    assert got[1] == got[2] != got[3]
