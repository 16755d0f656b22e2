"""Entity ids, document findings and rollups against plain versions."""

import json

from pyspark.sql import functions as F

from shiftlens.operators import contract, entities, metrics, mining, rollups
from shiftlens.sources import writers


def _tables(spark, *rows):
    return spark.createDataFrame(list(rows), "schema_name string, table_name string, object_type string")


def test_ids_are_kept_and_handed_out_without_gaps(spark):
    known = spark.createDataFrame([], entities.ENTITY)
    first = _tables(spark, *[("s", f"t{k}", "TABLE") for k in range(500)])
    known = entities.merge_entities(known, first, 1).cache()
    assert sorted(r.entity_id for r in known.collect()) == list(range(1, 501))
    then = entities.merge_entities(known, _tables(spark, ("s", "t7", "table"), ("s", "t7", "VIEW"), ("s", "new", None)), 2, is_baseline=True).cache()
    before = {(r.entity_type, r.object_name): r.entity_id for r in known.collect()}
    rows = {(r.entity_type, r.object_name): r for r in then.collect()}
    assert all(rows[k].entity_id == v for k, v in before.items())
    assert sorted(rows[k].entity_id for k in (("VIEW", "s.t7"), ("TABLE", "s.new"))) == [501, 502]
    assert {k for k, r in rows.items() if r.is_active} == {("TABLE", "s.t7"), ("VIEW", "s.t7"), ("TABLE", "s.new")}
    assert (rows["TABLE", "s.t7"].first_seen, rows["TABLE", "s.t7"].last_seen, rows["TABLE", "s.t8"].last_seen) == (1, 2, 1)
    again = entities.merge_entities(then, _tables(spark, ("s", "t7", "table"), ("s", "t7", "VIEW"), ("s", "new", None)), 2, is_baseline=True)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, then.collect()))
    # A name is active after a baseline, whatever its type; an empty baseline says nothing.
    assert entities.merge_entities(then, first.limit(0), 3, is_baseline=True).where("is_active").count() == 3
    assert entities.merge_entities(then, _tables(spark, ("s", "t7", "VIEW")), 3, is_baseline=True).where("is_active").count() == 2


def test_back_fill_may_be_run_again(spark):
    known = entities.merge_entities(spark.createDataFrame([], entities.ENTITY), _tables(spark, ("s", "t", "TABLE"), ("s", "t", "VIEW"), ("s", "u", "TABLE")), 1)
    ids = {(r.entity_type, r.object_name): r.entity_id for r in known.collect()}
    usage = spark.createDataFrame([("s.t", "s", "view"), ("u", "s", None), ("u", None, "TABLE"), ("x", "s", "TABLE"), (None, "s", "TABLE")], "object_name string, schema_name string, object_type string")
    filled = entities.back_fill_all(known, usage=usage, criticality=usage.select("object_name"))
    want = {("s.t", ids["VIEW", "s.t"]), ("u", ids["TABLE", "s.u"]), ("u", None), ("x", None), (None, None)}
    for _ in range(2):
        assert {(r.object_name, r.entity_id) for r in filled["usage"].collect()} == want
        assert {(r.object_name, r.entity_id) for r in filled["criticality"].collect()} == {("s.t", min(ids["TABLE", "s.t"], ids["VIEW", "s.t"])), ("u", None), ("x", None), (None, None)}
        filled = entities.back_fill_all(known, **filled)


def test_findings_of_a_document(spark, tmp_path):
    edge = {"sourceAttributeNaturalKey": "d|a", "sourceDatasetNaturalKey": "d", "targetAttributeNaturalKey": "NOT APPLICABLE", "targetDatasetNaturalKey": "e", "stepNaturalKey": "s1"}
    document = dict.fromkeys(contract.COLLECTIONS[:5], []) | {
        "datasets": [{"datasetNaturalKey": "d"}, "no object"], "attributes": [{"attributeNaturalKey": "d|a"}], "steps": "none", "tier1QueryBlockAttributeLineage": [7, edge, edge | {"sourceAttributeNaturalKey": "", "stepNaturalKey": None}],
        "tier3DatasetLineage": [{"sourceDatasetNaturalKey": 5, "targetDatasetNaturalKey": "d"}], "processes": None,
    }
    (tmp_path / "a.json").write_text(json.dumps(document))
    (tmp_path / "b.json").write_text("[1]")
    (tmp_path / "c.json").write_text("{broken")
    got = contract.document_findings(contract.documents(spark, str(tmp_path)))
    rows = {(r.path[-6:-5], r.level, r.finding, r.collection, r["index"], r.subject) for r in got.collect()}
    one, three = "tier1QueryBlockAttributeLineage", "tier3DatasetLineage"
    assert rows == {
        ("b", "FAIL", "invalid document", None, None, None), ("c", "FAIL", "invalid document", None, None, None), ("a", "WARN", "missing collection", "tier2StatementAttributeLineage", None, None),
        ("a", "WARN", "missing collection", "lineageFactAttribute", None, None), ("a", "FAIL", "invalid collection", "steps", None, "STRING"), ("a", "FAIL", "invalid collection", "processes", None, "VOID"),
        ("a", "FAIL", "missing required field", one, 1, "sourceAttributeNaturalKey,stepNaturalKey"), ("a", "FAIL", "missing required field", three, 0, "stepNaturalKey"),
        ("a", "WARN", "attribute sentinel", one, 0, "NOT APPLICABLE"), ("a", "WARN", "attribute sentinel", one, 1, "NOT APPLICABLE"), ("a", "FAIL", "undeclared dataset", one, 0, "e"), ("a", "FAIL", "undeclared dataset", one, 1, "e"),
        ("a", "FAIL", "undeclared dataset", three, 0, "5"),
    }


def test_reports_from_rollups_are_those_from_changes(spark, tmp_path):
    changes = spark.range(400).select(
        F.col("id").alias("change_id"), (F.col("id") % 6).alias("snapshot_from"), (F.col("id") % 6 + 1).alias("snapshot_to"), F.expr("if(id % 3 = 0, 'COLUMN', 'TABLE')").alias("object_type"),
        F.expr("concat('S', id * id % 5, '.T', id % 7, if(id % 3 = 0, '.c', ''))").alias("object_identifier"), (F.col("id") % 4 == 0).alias("is_breaking"),
    )
    impacts = changes.select("change_id", F.lit(1).alias("direct"), (F.col("change_id") % 3).alias("indirect")).where("change_id % 5 > 0")
    snapshots = spark.range(1, 8).select(F.col("id").alias("snapshot_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("snapshot_date"))
    scores = spark.createDataFrame([("S1.T1", "HIGH"), ("S2.T1", "LOW")], "object_name string, level string")
    schemas = changes.select(F.substring_index("object_identifier", ".", 1).alias("schema_name"))
    for part in ("change_id % 6 < 2", "change_id % 6 < 4", "true"):
        writers.append_changes(changes.where(part), str(tmp_path))
    rolled = spark.read.parquet(f"{tmp_path}/change_rollup")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(rolled.select(rollups.change_rollup(changes).columns)) == rows(rollups.change_rollup(changes))
    assert rows(mining.change_anomalies(rolled, snapshots, 0.5)) == rows(mining.change_anomalies(changes, snapshots, 0.5))
    assert rows(metrics.objects_changed(rolled)) == rows(metrics.objects_changed(changes))
    assert rows(metrics.domain_risk(schemas, rollups.change_rollup(changes, impacts), None, scores)) == rows(metrics.domain_risk(schemas, changes, impacts, scores))
    volatility = spark.range(1).select(F.lit(0.1).alias("volatility"))
    assert rows(metrics.governance_scorecard(volatility, rolled, scores)) == rows(metrics.governance_scorecard(volatility, changes, scores))
