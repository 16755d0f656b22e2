from pyspark.sql import functions as F

from shiftlens.operators import diff

T = "snapshot_id long, schema_name string, table_name string, object_type string, ddl_alter_timestamp string"
C = "snapshot_id long, schema_name string, table_name string, column_name string, data_type string, nullable boolean, ordinal_position long"


def _case(spark):
    tables = spark.createDataFrame([(1, "s", "a", "TABLE", "t1"), (1, "s", "b", "TABLE", None), (1, "gone", "x", "VIEW", None), (2, "s", "a", "TABLE", "t2"), (2, "s", "b", "VIEW", "t9"), (2, "s", "c", "TABLE", None)], T)
    columns = spark.createDataFrame([(1, "s", "a", "k", "INTEGER", False, 1), (1, "s", "a", "v", "DATE", True, 2), (2, "s", "a", "k", "BIGINT", True, 3), (2, "s", "a", "w", "DATE", True, 2), (2, "s", "c", "z", "DATE", True, 1)], C)
    return tables, columns


def _kinds(df):
    return sorted((r.change_type, r.object_identifier) for r in df.collect())


def test_all_levels(spark):
    got = _kinds(diff.compute_diff(*_case(spark), 1, 2))
    assert got == sorted([
        ("SCHEMA_REMOVED", "gone"), ("TABLE_REMOVED", "gone.x"), ("TABLE_ADDED", "s.c"), ("TABLE_TYPE_CHANGED", "s.b"), ("TABLE_DDL_CHANGED", "s.a"),
        ("COLUMN_TYPE_CHANGED", "s.a.k"), ("COLUMN_NULLABILITY_CHANGED", "s.a.k"), ("COLUMN_POSITION_CHANGED", "s.a.k"), ("COLUMN_REMOVED", "s.a.v"), ("COLUMN_ADDED", "s.a.w"),
    ])


def test_reverse_swaps_sides(spark):
    there, back = diff.compute_diff(*_case(spark), 1, 2), diff.compute_diff(*_case(spark), 2, 1)
    swap = {"ADDED": "REMOVED", "REMOVED": "ADDED"}
    turned = sorted(("_".join([*k.split("_")[:-1], swap.get(k.split("_")[-1], k.split("_")[-1])]), i) for k, i in _kinds(there))
    assert turned == _kinds(back)
    row = back.where("change_type = 'COLUMN_TYPE_CHANGED'").first()
    assert "BIGINT" in row.before_state and "INTEGER" in row.after_state and row.severity == "MEDIUM" and row.is_breaking


def test_unknown_type_is_low(spark):
    row = diff.classify(spark.createDataFrame([("ODD",)], "change_type string")).first()
    assert (row.severity, row.is_breaking) == ("LOW", False)


def test_ddl_of_missing_state(spark):
    rows = spark.createDataFrame([("COLUMN_ADDED", "COLUMN", "s.t.c", None, None), ("ODD", "TABLE", "s.t", None, None)], "change_type string, object_type string, object_identifier string, before_state string, after_state string")
    got = [r.ddl_combined for r in diff.generate_ddl(rows).orderBy(F.desc("change_type")).collect()]
    assert got == ["-- Unsupported change type: ODD on s.t", "ALTER TABLE s.t ADD c VARCHAR(255);"]


def test_empty_tables(spark):
    tables, columns = _case(spark)
    assert diff.compute_diff(tables.limit(0), columns.limit(0), 1, 2).count() == 0


def test_table_that_loses_all_columns(spark):
    tables, columns = _case(spark)
    got = _kinds(diff.compute_diff(tables, columns.where("snapshot_id = 1"), 1, 2))
    assert ("COLUMN_REMOVED", "s.a.k") in got and ("COLUMN_REMOVED", "s.a.v") in got
