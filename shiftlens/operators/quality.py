"""Noise, contracts and consistency of incoming batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.functions.exprs import known_type

PLACEHOLDERS = ["not applicable", "unknown"]
# Patterns of temporary datasets and of attributes that are literals.
TEMPORARY = r"(?i)^(unknown\.temptable\d+|.*\.tmp_\w+)$"
LITERAL = r"\|'[^']*'$|(?i:\|NULL$)|\|\d+$|\|NOT[_ ]APPLICABLE"


def _placeholder(c: str):
    return F.coalesce(F.lower(F.trim(F.col(c))).isin(PLACEHOLDERS), F.lit(False))


def noise_filter(containers: DataFrame, datasets: DataFrame, attributes: DataFrame, edges: DataFrame, self_loops: bool = False) -> dict[str, DataFrame]:
    """The frames of a lineage payload without noise, and `stats` (kind, reason, n), `samples` (kind, reason, key), ten a reason.
    Dropped: placeholder containers; datasets in them or temporary; literals and attributes of placeholder or dropped datasets; edges
    with a dropped end, and, unless kept, loops."""
    c = containers.withColumn("reason", F.when(_placeholder("containerNaturalKey"), "placeholder"))
    d = datasets.withColumn("reason", F.when(_placeholder("containerNaturalKey"), "placeholder").when(F.col("datasetNaturalKey").rlike(TEMPORARY), "temporary"))
    bad = d.where("reason is not null").select("datasetNaturalKey").distinct().withColumn("_bad", F.lit(True))
    literal = F.when(F.col("attributeClass").isNotNull(), F.lower("attributeClass") != "column").otherwise(F.col("attributeNaturalKey").rlike(LITERAL) | _placeholder("containerNaturalKey"))
    a = attributes.join(bad, "datasetNaturalKey", "left").withColumn("reason", F.when(literal, "literal").when(F.col("_bad"), "dropped dataset")).drop("_bad")
    gone = a.where("reason is not null").select("attributeNaturalKey").distinct()
    ends = lambda side: gone.select(F.col("attributeNaturalKey").alias(side), F.lit(True).alias(f"_{side}"))
    src, dst = "sourceAttributeNaturalKey", "targetAttributeNaturalKey"
    e = edges.join(ends(src), src, "left").join(ends(dst), dst, "left")
    loop = F.lit(False) if self_loops else F.col(src) == F.col(dst)
    e = e.withColumn("reason", F.when(F.col(f"_{src}") | F.col(f"_{dst}"), "dropped end").when(loop, "self loop")).drop(f"_{src}", f"_{dst}")
    keyed = {"container": (c, F.col("containerNaturalKey")), "dataset": (d, F.col("datasetNaturalKey")), "attribute": (a, F.col("attributeNaturalKey")), "edge": (e, F.concat_ws(">", src, dst))}
    dropped = None
    for kind, (df, key) in keyed.items():
        rows = df.where("reason is not null").select(F.lit(kind).alias("kind"), "reason", key.alias("key"))
        dropped = rows if dropped is None else dropped.unionByName(rows)
    by = Window.partitionBy("kind", "reason").orderBy("key")
    kept = {f"{kind}s": df.where("reason is null").drop("reason") for kind, (df, _) in keyed.items()}
    return kept | {"stats": dropped.groupBy("kind", "reason").agg(F.count("*").alias("n")), "samples": dropped.withColumn("_r", F.row_number().over(by)).where("_r <= 10").drop("_r")}


def batch_identity(headers: DataFrame) -> DataFrame:
    """Violations (file, problem) of headers(file, source_system_name, extract_run_id): more than one identity in a file, files that differ, or no records at all,
    which has no file."""
    identity = F.struct("source_system_name", "extract_run_id")
    per = headers.groupBy("file").agg(F.count_distinct("source_system_name", "extract_run_id").alias("n"), F.min(identity).alias("own"))
    whole = per.agg(F.min("own").alias("lead"), F.count("*").alias("files"))
    told = per.join(F.broadcast(whole)).select("file", F.when(F.col("n") != 1, "several identities").when(F.col("own") != F.col("lead"), "differs from the batch").alias("problem")).where("problem is not null")
    return told.unionByName(whole.where("files = 0").select(F.lit(None).cast("string").alias("file"), F.lit("empty batch").alias("problem")))


def temporal_coherence(headers: DataFrame, most_hours: float = 2.0) -> DataFrame:
    """One row on the first records of headers(file, pos, extracted_at, snapshot_date): distinct dates, hours between extracts, and whether
    the batch is coherent. Times that can't be read don't count; fewer than two files are."""
    first = headers.groupBy("file").agg(F.min_by(F.struct("extracted_at", "snapshot_date"), "pos").alias("h"))
    out = first.agg(F.count("*").alias("files"), F.count_distinct("h.snapshot_date").alias("dates"), ((F.unix_timestamp(F.max("h.extracted_at")) - F.unix_timestamp(F.min("h.extracted_at"))) / 3600).alias("hours"))
    return out.withColumn("coherent", (F.col("files") < 2) | ((F.col("dates") <= 1) & (F.coalesce("hours", F.lit(0.0)) <= most_hours)))


def validate_snapshot(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Issues (level, issue, subject, n): duplicate tables are errors; missing schemas and unknown types are warnings."""
    twice = tables.groupBy("schema_name", "table_name").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("error").alias("level"), F.lit("DUPLICATE_TABLE").alias("issue"), F.concat_ws(".", "schema_name", "table_name").alias("subject"), "n")
    bare = tables.where("schema_name is null").groupBy("table_name").agg(F.count("*").alias("n")).select(F.lit("warning").alias("level"), F.lit("NULL_SCHEMA").alias("issue"), F.col("table_name").alias("subject"), "n")
    odd = columns.groupBy("data_type").agg(F.count("*").alias("n")).where(~known_type("data_type")).select(F.lit("warning").alias("level"), F.lit("UNKNOWN_TYPE").alias("issue"), F.col("data_type").alias("subject"), "n")
    return twice.unionByName(bare).unionByName(odd)


def staged(tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged rows of tables with row_status and its reason: all rows of a table that is there twice are rejected, the others accepted. And
    one row (import_status, accepted, rejected): a snapshot with rejected rows has failed."""
    twice = tables.groupBy(F.col("schema_name").alias("_s"), F.col("table_name").alias("_t")).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.col("schema_name").eqNullSafe(F.col("_s")) & F.col("table_name").eqNullSafe(F.col("_t"))
    rows = tables.join(twice, same, "left").select(*tables.columns, F.when(F.col("_n").isNull(), "accepted").otherwise("rejected").alias("row_status"), F.when(F.col("_n").isNotNull(), "DUPLICATE_TABLE").alias("reason"))
    ended = rows.agg(F.count_if(F.col("row_status") == "accepted").alias("accepted"), F.count_if(F.col("row_status") == "rejected").alias("rejected"))
    return rows, ended.select(F.when(F.col("rejected") > 0, "failed").otherwise("committed").alias("import_status"), "accepted", "rejected")


def snapshot_integrity(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """One row: schemas, tables, columns without their table, columns without a position, and whether all is well."""
    t = tables.agg(F.count_distinct("schema_name").alias("schemas"), F.count("*").alias("tables"))
    lost = columns.join(tables.select("schema_name", "table_name").distinct(), ["schema_name", "table_name"], "left_anti").agg(F.count("*").alias("orphan_columns"))
    flat = columns.agg(F.count_if(F.col("ordinal_position").isNull()).alias("no_position"))
    out = t.join(F.broadcast(lost)).join(F.broadcast(flat))
    return out.withColumn("valid", F.expr("schemas > 0 and tables > 0 and orphan_columns = 0 and no_position = 0"))


def snapshot_policy(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(snapshot_id, problem): a second baseline of a source, or a description that exists."""
    base = new.where("is_baseline").join(existing.where("is_baseline").select("source_system").distinct(), "source_system", "left_semi").select("snapshot_id", F.lit("second baseline").alias("problem"))
    same = new.join(existing.select("description").distinct(), "description", "left_semi").select("snapshot_id", F.lit("duplicate description").alias("problem"))
    return base.unionByName(same)


def orphan_check(relations: list[tuple[str, DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """(relation, n, samples): rows whose parent is missing, with the first three keys; relations are (name, children, parents, keys)."""
    out = None
    for name, child, parent, keys in relations:
        lost = child.join(parent.select(keys).distinct(), keys, "left_anti").select(F.concat_ws(".", *keys).alias("key"))
        few = lost.distinct().orderBy("key").limit(3).agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("samples"))
        one = lost.agg(F.count("*").alias("n")).join(F.broadcast(few)).select(F.lit(name).alias("relation"), "n", "samples")
        out = one if out is None else out.unionByName(one)
    return out


def ingest_preview(counts: dict[str, DataFrame], relations: list[tuple[str, DataFrame, DataFrame, list[str]]], stubs: dict[str, tuple[DataFrame, str]] | None = None, samples: int = 5) -> DataFrame:
    """A dry run: (item, n, samples) with the rows that would be stored and the first of them, the orphans that would be dropped, and rows of
    stubs (name: frame and field) whose field says nothing and would be stored as UNKNOWN."""
    out = orphan_check(relations).withColumn("item", F.concat(F.lit("orphans: "), F.col("relation"))).select("item", "n", "samples")
    for name, df in counts.items():
        few = df.select(F.concat_ws(".", *(F.col(c).cast("string") for c in df.columns[:3])).alias("key")).distinct().orderBy("key").limit(samples)
        first = few.agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("samples"))
        out = out.unionByName(df.agg(F.count("*").alias("n")).join(F.broadcast(first)).select(F.lit(name).alias("item"), "n", "samples"))
    for name, (df, field) in (stubs or {}).items():
        out = out.unionByName(df.agg(F.count_if(F.coalesce(F.trim(field), F.lit("")) == "").alias("n")).select(F.lit(f"stub types: {name}").alias("item"), "n", F.lit("").alias("samples")))
    return out


def lineage_contract(datasets: DataFrame, attributes: DataFrame, steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings (level, finding, key): missing keys, references to undeclared steps, datasets and attributes, sentinels (WARN), duplicates."""
    keyed = lambda df, key, name: df.where(F.col(key).isNull()).select(F.lit("FAIL").alias("level"), F.lit(f"missing {name}").alias("finding"), F.lit("").alias("key"))
    twice = lambda df, key, name: df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null").select(F.lit("FAIL").alias("level"), F.lit(f"duplicate {name}").alias("finding"), "key")

    def undeclared(df, key, parent, parent_key, name):
        lost = df.select(F.col(key).alias("key")).where("key is not null").distinct().join(parent.select(F.col(parent_key).alias("key")).distinct(), "key", "left_anti")
        sentinel = F.upper("key").rlike("NOT[_ ]APPLICABLE|^UNKNOWN")
        return lost.select(F.when(sentinel, "WARN").otherwise("FAIL").alias("level"), F.lit(f"undeclared {name}").alias("finding"), "key")

    parts = [
        keyed(datasets, "datasetNaturalKey", "dataset"), keyed(attributes, "attributeNaturalKey", "attribute"), twice(datasets, "datasetNaturalKey", "dataset"), twice(attributes, "attributeNaturalKey", "attribute"),
        undeclared(attributes, "datasetNaturalKey", datasets, "datasetNaturalKey", "dataset"), undeclared(edges, "stepNaturalKey", steps, "stepNaturalKey", "step"),
        undeclared(edges, "sourceAttributeNaturalKey", attributes, "attributeNaturalKey", "source"), undeclared(edges, "targetAttributeNaturalKey", attributes, "attributeNaturalKey", "target"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contract_status(findings: DataFrame) -> DataFrame:
    return findings.agg(F.when(F.coalesce(F.bool_or(F.col("level") == "FAIL"), F.lit(False)), "FAIL").when(F.count("*") > 0, "REVIEW").otherwise("PASS").alias("status"), F.count("*").alias("findings"))


def arity_profile(records: DataFrame, within: int = 1000) -> DataFrame:
    """Per file of records(file, pos, n_fields): records, the first record's fields, and the first of the leading records that differs."""
    first = records.groupBy("file").agg(F.min_by("n_fields", "pos").alias("expected"), F.count("*").alias("n"))
    drift = records.where(F.col("pos") < within).join(first.select("file", "expected"), "file").where("n_fields <> expected").groupBy("file").agg(F.min("pos").alias("first_drift"))
    return first.join(drift, "file", "left")


def health_checks(**checks: tuple[DataFrame, int]) -> DataFrame:
    """(check, n, passed) for named frames that need at least so many rows."""
    out = None
    for name, (df, least) in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") >= least).alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out
