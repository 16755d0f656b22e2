"""Differences between two catalog snapshots, and what is read from stored differences.

A change has change_type, object_type, object_identifier, before_state and after_state (JSON or null). Names are compared
as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.sources.shared import cut

# The severity of change types, the rest being LOW, and those that break.
HIGH = ["TABLE_REMOVED", "SCHEMA_REMOVED", "COLUMN_REMOVED", "TABLE_TYPE_CHANGED"]
MEDIUM = ["COLUMN_TYPE_CHANGED", "COLUMN_NULLABILITY_CHANGED", "TABLE_DDL_CHANGED"]
BREAKING = ["TABLE_REMOVED", "COLUMN_REMOVED", "COLUMN_TYPE_CHANGED", "SCHEMA_REMOVED", "TABLE_TYPE_CHANGED"]
TABLE_KEY, COLUMN_KEY = ["schema_name", "table_name"], ["schema_name", "table_name", "column_name"]


def severity(change_type: Column) -> Column:
    return F.when(change_type.isin(HIGH), "HIGH").when(change_type.isin(MEDIUM), "MEDIUM").otherwise("LOW")


def classify(changes: DataFrame) -> DataFrame:
    """Severity and breaking flag by change type; unknown types are LOW and not breaking."""
    kind = F.col("change_type")
    return changes.withColumns({"severity": severity(kind), "is_breaking": F.coalesce(kind.isin(BREAKING), F.lit(False))})


def severity_rank(c: Column | str = "severity") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "HIGH", 0).when(c == "MEDIUM", 1).when(c == "LOW", 2).otherwise(3)


def compare(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two keyed frames: the keys, and structs a and b, null where the key is absent."""
    pack = lambda df, name: df.select(*(F.col(k).alias(f"{name}_{k}") for k in keys), F.struct(*[c for c in df.columns]).alias(name))
    on = [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys]
    both = pack(a, "a").join(pack(b, "b"), on, "full_outer")
    return both.select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys), "a", "b")


def _exploded(both: DataFrame, object_type: str, ident: Column, cases: list[tuple[str, Column, Column | None, Column | None]]) -> DataFrame:
    """One row for each case that holds: (change_type, condition, before, after)."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    rows = [F.when(holds, F.struct(F.lit(kind).alias("change_type"), text(before).alias("before_state"), text(after).alias("after_state"))) for kind, holds, before, after in cases]
    found = both.select(ident.alias("object_identifier"), F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c"))
    return found.select("c.change_type", F.lit(object_type).alias("object_type"), "object_identifier", "c.before_state", "c.after_state")


def _json(*fields: str) -> Column:
    side = fields[0].split(".")[0]
    return F.when(F.col(side).isNotNull(), F.to_json(F.struct(*(F.col(f).alias(f.split(".")[1]) for f in fields)), {"ignoreNullFields": "false"}))


def diff_schemas(a: DataFrame, b: DataFrame) -> DataFrame:
    """SCHEMA_ADDED and SCHEMA_REMOVED from frames with schema_name."""
    both = compare(a.select("schema_name").distinct(), b.select("schema_name").distinct(), ["schema_name"])
    return _exploded(both, "SCHEMA", F.col("schema_name"), [("SCHEMA_ADDED", F.col("a").isNull(), None, _json("b.schema_name")), ("SCHEMA_REMOVED", F.col("b").isNull(), _json("a.schema_name"), None)])


def diff_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables added, removed, of another type, or, with the type unchanged, of another DDL time (both times known)."""
    both = compare(a, b, TABLE_KEY)
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    retyped = here & ~F.col("a.object_type").eqNullSafe(F.col("b.object_type"))
    return _exploded(
        both,
        "TABLE",
        F.concat_ws(".", *TABLE_KEY),
        [
            ("TABLE_ADDED", F.col("a").isNull(), None, _json("b.object_type")),
            ("TABLE_REMOVED", F.col("b").isNull(), _json("a.object_type"), None),
            ("TABLE_TYPE_CHANGED", retyped, _json("a.object_type"), _json("b.object_type")),
            ("TABLE_DDL_CHANGED", here & ~retyped & (F.col("a.ddl_alter_timestamp") != F.col("b.ddl_alter_timestamp")), _json("a.ddl_alter_timestamp"), _json("b.ddl_alter_timestamp")),
        ],
    )


def diff_columns(a: DataFrame, b: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Columns of tables that both sides have: added, removed, and one row for each attribute that differs. `shared` lists
    those tables; without it they are those with columns on both sides."""
    if shared is None:
        shared = a.select(TABLE_KEY).intersect(b.select(TABLE_KEY))
    both = compare(a.join(shared, TABLE_KEY, "left_semi"), b.join(shared, TABLE_KEY, "left_semi"), COLUMN_KEY)
    here = F.col("a").isNotNull() & F.col("b").isNotNull()
    differs = lambda f: here & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    every = ["data_type", "nullable", "ordinal_position"]
    return _exploded(
        both,
        "COLUMN",
        F.concat_ws(".", *COLUMN_KEY),
        [
            ("COLUMN_ADDED", F.col("a").isNull(), None, _json(*(f"b.{f}" for f in every))),
            ("COLUMN_REMOVED", F.col("b").isNull(), _json(*(f"a.{f}" for f in every)), None),
            ("COLUMN_TYPE_CHANGED", differs("data_type"), _json("a.data_type"), _json("b.data_type")),
            ("COLUMN_NULLABILITY_CHANGED", differs("nullable"), _json("a.nullable"), _json("b.nullable")),
            ("COLUMN_POSITION_CHANGED", differs("ordinal_position"), _json("a.ordinal_position"), _json("b.ordinal_position")),
        ],
    )


def reverse(changes: DataFrame) -> DataFrame:
    """The same changes seen from the other side: added and removed, before and after change places."""
    kind = F.col("change_type")
    turned = F.when(F.endswith(kind, F.lit("_ADDED")), F.regexp_replace(kind, "_ADDED$", "_REMOVED")).when(F.endswith(kind, F.lit("_REMOVED")), F.regexp_replace(kind, "_REMOVED$", "_ADDED")).otherwise(kind)
    return changes.select(turned.alias("change_type"), "object_type", "object_identifier", F.col("after_state").alias("before_state"), F.col("before_state").alias("after_state"))


def compute_diff(tables: DataFrame, columns: DataFrame, first: int, second: int) -> DataFrame:
    """Classified changes from snapshot `first` to `second`, of frames that hold snapshot_id. The pair is compared from the
    lower to the higher id and turned around if asked the other way. The pair's rows are written once and read by every comparison; the
    result has no order (`diff_page` gives one)."""
    if first == second:
        raise ValueError("a diff needs two snapshots")
    lo, hi = sorted((first, second))
    at = lambda df, k: df.where(F.col("snapshot_id") == k).drop("snapshot_id")
    pair = lambda df: cut(df.where(F.col("snapshot_id").isin(lo, hi)))
    tables, columns = pair(tables), pair(columns)
    ta, tb, ca, cb = at(tables, lo), at(tables, hi), at(columns, lo), at(columns, hi)
    inside = ta.select(TABLE_KEY).intersect(tb.select(TABLE_KEY))
    changes = diff_schemas(ta, tb).unionByName(diff_tables(ta, tb)).unionByName(diff_columns(ca, cb, inside))
    if first > second:
        changes = reverse(changes)
    return classify(changes).withColumns({"snapshot_from": F.lit(first).cast("long"), "snapshot_to": F.lit(second).cast("long")})


def consecutive_pairs(snapshots: DataFrame) -> DataFrame:
    """(snapshot_from, snapshot_to) of neighbours in time, from (snapshot_id, snapshot_date). Snapshots are versions of a
    catalog, a few rows a year, so the unpartitioned window is over a list of dates."""
    order = Window.partitionBy(F.lit(0)).orderBy("snapshot_date", "snapshot_id")
    return snapshots.select(F.col("snapshot_id").alias("snapshot_from"), F.lead("snapshot_id").over(order).alias("snapshot_to")).where("snapshot_to is not null")


def cumulative_changes(changes: DataFrame, snapshots: DataFrame, first: int, second: int) -> DataFrame:
    """Stored changes of all neighbouring pairs between two snapshots; with fewer than two there, of the literal pair."""
    within = consecutive_pairs(snapshots.where(F.col("snapshot_id").between(min(first, second), max(first, second))))
    spark = changes.sparkSession
    literal = spark.range(1).select(F.lit(first).cast("long").alias("snapshot_from"), F.lit(second).cast("long").alias("snapshot_to"))
    pairs = within.unionByName(literal.join(within.limit(1), F.lit(True), "left_anti"))
    return changes.join(F.broadcast(pairs), ["snapshot_from", "snapshot_to"], "left_semi")


def filter_changes(changes: DataFrame, severity: str | None = None, is_breaking: bool | None = None, query: str | None = None) -> DataFrame:
    if severity and severity.upper() != "ALL":
        changes = changes.where(F.upper("severity") == severity.upper())
    if is_breaking is not None:
        changes = changes.where(F.col("is_breaking") == is_breaking)
    if query:
        hit = F.col("object_identifier").ilike(f"%{query}%")
        changes = changes.where(hit | (F.col("change_id") == int(query)) if query.isdigit() else hit)
    return changes


def diff_page(changes: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    return changes.orderBy(F.desc("is_breaking"), severity_rank(), "change_id").offset(offset).limit(limit)


def timeline(changes: DataFrame, snapshots: DataFrame, name: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Changes of objects whose identifier holds `name`, with the snapshot's date, total and has_more."""
    hit = changes.where(F.col("object_identifier").ilike(f"%{name}%"))
    dated = hit.join(snapshots.selectExpr("snapshot_id as snapshot_to", "snapshot_date"), "snapshot_to", "left")
    page = dated.orderBy("snapshot_to", "detected_at", "change_id").offset(offset).limit(limit)
    total = hit.agg(F.count("*").alias("total"))
    return page.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def recent_changes(changes: DataFrame, n: int = 20) -> DataFrame:
    return changes.orderBy(F.desc("detected_at"), F.desc("change_id")).limit(n)


def summary(changes: DataFrame) -> DataFrame:
    """Total, breaking and severities in one pass; a null or other severity counts as low."""
    level = F.upper("severity")
    return changes.agg(
        F.count("*").alias("total"), F.count_if("is_breaking").alias("breaking"), F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "MEDIUM").alias("medium"), F.count_if(~F.coalesce(level, F.lit("")).isin("HIGH", "MEDIUM")).alias("low"),
    )


# Fixed values below: the texts of the statements, with their comments.
def generate_ddl(changes: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """Advisory statements for each change, as an array and joined. What the states don't say is left open in comments. With columns(schema_name,
    table_name, column_name, data_type, nullable, ordinal_position) of the later snapshot new tables are created with their columns."""
    if columns is not None:
        line = F.concat(F.lit("    "), "column_name", F.lit(" "), "data_type", F.when(F.col("nullable"), "").otherwise(" NOT NULL"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal_position", "column_name", line.alias("line")))), lambda x: x["line"]), ",\n")
        new = columns.groupBy(F.concat_ws(".", *TABLE_KEY).alias("object_identifier"), F.lit("TABLE_ADDED").alias("change_type")).agg(listed.alias("_columns"))
        changes = changes.join(new, ["object_identifier", "change_type"], "left")
    else:
        changes = changes.withColumn("_columns", F.lit(None).cast("string"))
    ident, kind = F.col("object_identifier"), F.col("change_type")
    part = lambda k: F.get(F.split(ident, r"\."), F.lit(k))
    schema, table = part(0), F.concat_ws(".", part(0), part(1))
    field = lambda side, name, other: F.coalesce(F.get_json_object(side, f"$.{name}"), F.lit(other))
    before, after = (lambda n, o: field("before_state", n, o)), (lambda n, o: field("after_state", n, o))
    column = F.coalesce(part(2), F.when(kind == "COLUMN_ADDED", "new_column").otherwise("unknown_column"))
    text = lambda template, *args: F.format_string(template, *args)
    view = text("CREATE VIEW %s AS\n    SELECT * FROM <source>;  -- TODO: define view query", table)
    null_of = F.when(after("nullable", "true") == "false", " NOT NULL").otherwise("")
    new_type = after("object_type", "VIEW")
    statements = (
        F.when(kind == "TABLE_ADDED", F.array(F.when(after("object_type", "TABLE") == "VIEW", view).otherwise(text("CREATE TABLE %s (\n%s\n);", table, F.coalesce("_columns", F.lit("    -- columns to be defined"))))))
        .when(kind == "TABLE_REMOVED", F.array(text("DROP %s IF EXISTS %s;", before("object_type", "TABLE"), table)))
        .when(
            kind == "TABLE_TYPE_CHANGED",
            F.array(
                text("-- Object type changed from %s to %s", before("object_type", "TABLE"), new_type),
                text("DROP %s IF EXISTS %s;", before("object_type", "TABLE"), table),
                F.when(new_type == "VIEW", view).otherwise(text("CREATE TABLE %s (\n    -- recreate with appropriate columns\n);", table)),
            ),
        )
        .when(kind == "COLUMN_ADDED", F.array(text("ALTER TABLE %s ADD %s %s%s;", table, column, after("data_type", "VARCHAR(255)"), null_of)))
        .when(kind == "COLUMN_REMOVED", F.array(text("ALTER TABLE %s DROP COLUMN %s;", table, column)))
        .when(
            kind == "COLUMN_TYPE_CHANGED",
            F.array(text("-- Column type change: %s -> %s", before("data_type", "?"), after("data_type", "?")), text("ALTER TABLE %s ALTER COLUMN %s SET DATA TYPE %s;", table, column, after("data_type", "?"))),
        )
        .when(kind == "COLUMN_NULLABILITY_CHANGED", F.array(text("ALTER TABLE %s ALTER COLUMN %s %s NOT NULL;", table, column, F.when(after("nullable", "true") == "false", "SET").otherwise("DROP"))))
        .when(
            kind == "COLUMN_POSITION_CHANGED",
            F.array(
                text("-- Column position changed to %s (requires table rebuild in most RDBMS)", after("ordinal_position", "?")), text("-- ALTER TABLE %s MODIFY %s ... AFTER <preceding_column>;", table, column)
            ),
        )
        .when(kind == "SCHEMA_ADDED", F.array(text("CREATE SCHEMA IF NOT EXISTS %s;", schema)))
        .when(kind == "SCHEMA_REMOVED", F.array(text("DROP SCHEMA IF EXISTS %s CASCADE;", schema)))
        .otherwise(F.array(text("-- Unsupported change type: %s on %s", kind, ident)))
    )
    return changes.withColumn("ddl_statements", statements).withColumn("ddl_combined", F.array_join("ddl_statements", "\n")).drop("_columns")


def payload_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of either payload (collection, signature) that the other lacks, as multisets: side, collection, signature, n."""
    missing, extra = expected.exceptAll(actual), actual.exceptAll(expected)
    return missing.withColumn("side", F.lit("missing")).unionByName(extra.withColumn("side", F.lit("unexpected"))).groupBy("side", "collection", "signature").agg(F.count("*").alias("n"))


def change_outcome(changes: DataFrame, ident: str) -> DataFrame:
    """What happened to one object, its columns included: added, dropped, changed or unchanged."""
    own = changes.where((F.col("object_identifier") == ident) | F.startswith("object_identifier", F.lit(ident + ".")))
    exact = F.col("object_identifier") == ident
    return own.agg(
        F.when(F.count_if(exact & F.endswith("change_type", F.lit("_ADDED"))) > 0, "added").when(F.count_if(exact & F.endswith("change_type", F.lit("_REMOVED"))) > 0, "dropped").when(F.count("*") > 0, "changed").otherwise("unchanged").alias("outcome"),
        F.count("*").alias("n_changes"),
    ).withColumn("object_identifier", F.lit(ident))


def status_overlay(tables: DataFrame, changes: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(level, object_identifier, status, has_column_changes) for schemas, tables and, if given, columns of a snapshot and those that changes removed:
    added, removed, modified or unchanged. A table with column changes alone is modified, and so is a schema with changes below it alone."""
    kind, deep = F.col("change_type"), {"SCHEMA": 1, "TABLE": 2, "COLUMN": 3}
    here = {"SCHEMA": tables.select(F.col("schema_name").alias("object_identifier")), "TABLE": tables.select(F.concat_ws(".", *TABLE_KEY).alias("object_identifier"))}
    if columns is not None:
        here["COLUMN"] = columns.select(F.concat_ws(".", *TABLE_KEY, "column_name").alias("object_identifier"))
    out = None
    for level, names in here.items():
        own = F.col("object_type") == level
        strength = F.when(own & (kind == f"{level}_ADDED"), 0).when(own & (kind == f"{level}_REMOVED"), 1).otherwise(2)
        below = changes.where(F.col("object_type").isin([k for k, n in deep.items() if n >= deep[level]]))
        told = below.groupBy(F.substring_index("object_identifier", ".", deep[level]).alias("object_identifier")).agg(F.min(strength).alias("s"), F.bool_or(F.col("object_type") == "COLUMN").alias("has_column_changes"))
        both = names.distinct().withColumn("here", F.lit(True)).join(told, "object_identifier", "full_outer")
        status = F.when(F.col("s") == 0, "added").when(F.col("s") == 1, "removed").when(F.col("s") == 2, "modified").otherwise("unchanged")
        rows = both.where("here or s = 1").select(F.lit(level).alias("level"), "object_identifier", status.alias("status"), F.coalesce("has_column_changes", F.lit(False)).alias("has_column_changes"))
        out = rows if out is None else out.unionByName(rows)
    return out


def status_counts(overlay: DataFrame) -> DataFrame:
    return overlay.groupBy("level", "status").agg(F.count("*").alias("n"))
