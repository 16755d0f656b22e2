"""Readers of catalog extracts (.dat), usage logs, lineage and usage JSON, organisation CSV, landing folders and live catalogs.

Flat files have fields between § (escaped \\§). A record of a 16-field catalog file ends with the line that brings its sixteenth field, so it may run
over lines, and a file may hold several runs; the others end records with ENDREC. A record of another arity is an error, or comes out of `violations`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.functions.exprs import DELIMITER, blank_to_null, parse_catalog_ts, parse_int_lenient, parse_log_date, parse_usage_ts, split_escaped
from shiftlens.sources import documents

# The fields of each layout, in order; a colon names the type.
_HEADER = ["source_system_name", "extract_run_id", "extracted_at_utc", "snapshot_date"]
FIXED16 = {
    "databases": _HEADER + ["database_name", "owner_name", "creator_name", "create_timestamp:ts", "last_alter_name", "last_alter_timestamp:ts", "comment_string", "perm_space:int", "spool_space:int", "temp_space:int"],
    "tables": _HEADER + ["database_name", "table_name", "table_kind", "creator_name", "create_timestamp:ts", "last_alter_name", "last_alter_timestamp:ts", "comment_string", "protection_type", "journal_flag", "check_opt"],
    "columns": _HEADER + ["database_name", "table_name", "column_name", "column_id:int", "column_type", "column_length:int", "decimal_total_digits:int", "decimal_fractional_digits:int", "nullable", "default_value", "char_type:int", "uppercase_flag"],
    "indices": _HEADER + ["database_name", "table_name", "index_name", "index_number:int", "index_type", "unique_flag", "column_name", "column_position:int"],
}
ENDREC = {
    "partitioning": _HEADER + ["database_name", "table_name", "constraint_type", "constraint_text", "create_timestamp:ts"],
    "tabletext": _HEADER + ["database_name", "table_name", "table_kind", "request_text_seq:int", "request_text"],
    "query_log": ["platform_name", "log_date:date", "proc_id:int", "collect_timestamp:uts", "query_id:int", "sql_row_no:int", "sql_text_info", "default_database", "qb_job_name", "qb_proc_name"],
    "object_usage": ["platform_name", "database_name", "table_name", "column_name", "object_num", "object_type", "freq_of_use:int", "type_of_use:int", "target_indicator", "query_count:int", "distinct_user_count:int", "last_accessed:uts"],
}
ARITY = dict.fromkeys(FIXED16, 16) | {"partitioning": 9, "tabletext": 9, "query_log": 10, "object_usage": 12}
_KINDS = {"ts": parse_catalog_ts, "uts": parse_usage_ts, "date": parse_log_date, "int": parse_int_lenient, "": blank_to_null}


def _pieces(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(value, file, block, n): pieces of text files, numbered in the order of each block."""
    raw = spark.read.options(**options).text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def _line_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(record, file, block, n, number): records that end with the line of their sixteenth field. Blank lines before a record don't belong to it.

    A file in which every line is blank or a record is read as it is. In others a line's record is told by the delimiters that come before it: they are
    summed within the file's blocks, each block starts from the sum of those before it, and 15 make a record. A task sorts one block; a record's lines
    meet in one task."""
    lines = _pieces(spark, path)
    here = F.length("value") - F.length(F.replace("value", F.lit(DELIMITER), F.lit("")))
    escaped = (F.length("value") - F.length(F.replace("value", F.lit(f"\\{DELIMITER}"), F.lit("")))) / 2
    lines = lines.withColumn("delimiters", (here - escaped).cast("long")).withColumn("blank", F.trim(F.col("value"), F.lit("\t ")) == "")
    odd = [r["file"] for r in lines.where("not blank and delimiters <> 15").select("file").distinct().collect()]  # of a listing of files
    whole = lines.where(~F.col("file").isin(odd) & ~F.col("blank")) if odd else lines.where("not blank")
    out = whole.select("value", "file", "block", "n", F.lit(None).cast("long").alias("number"))
    if odd:
        runs = lines.where(F.col("file").isin(odd))
        by_block = Window.partitionBy("file", "block").orderBy("n")
        by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        before = runs.groupBy("file", "block").agg(F.sum("delimiters").alias("total")).select("file", "block", F.coalesce(F.sum("total").over(by_file), F.lit(0)).alias("before"))
        runs = runs.withColumn("own", F.sum("delimiters").over(by_block) - F.col("delimiters")).join(before, ["file", "block"])
        runs = runs.withColumn("number", F.floor((F.col("before") + F.col("own")) / 15))
        parts = runs.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "n", "blank", "value"))).alias("lines"))
        first = F.expr("filter(lines, x -> not x.blank)[0]")  # null where all are blank
        text = F.array_join(F.transform("lines", lambda x: x["value"]), "\n")
        out = out.unionByName(parts.select(text.alias("value"), "file", first["block"].alias("block"), first["n"].alias("n"), (F.col("number") + 1).alias("number")).where("n is not null"))
    return out.withColumn("value", F.trim("value", F.lit("\r\n\t ")))


def _records(spark: SparkSession, path: str | list[str], view: str) -> DataFrame:
    """(record, fields, position, number): raw records, split. number: of the record in its file, where records run over lines."""
    if view in FIXED16:
        raw = _line_records(spark, path)
    else:
        raw = _pieces(spark, path, lineSep="ENDREC").withColumns({"value": F.trim("value", F.lit("\r\n")), "number": F.lit(None).cast("long")}).where(F.trim("value") != "")
    raw = raw.select(F.make_valid_utf8("value").alias("record"), F.struct("file", "block", "n").alias("position"), "number")
    return raw.withColumn("fields", split_escaped("record"))


def typed(records: DataFrame, view: str, *more: str) -> DataFrame:
    """Rows of a view from records(fields), with more of its columns."""
    out = []
    for k, spec in enumerate((FIXED16 | ENDREC)[view]):
        name, _, kind = spec.partition(":")
        field = F.get("fields", F.lit(k))
        out.append((field if name in ("request_text", "sql_text_info", "constraint_text") else _KINDS[kind](field)).alias(name))
    return records.select(*out, *more)


def read_view(spark: SparkSession, path: str | list[str], view: str, strict: bool = True, position: bool = False) -> DataFrame:
    """Typed rows of one of the views in FIXED16 and ENDREC; blanks are null, bad bytes are replaced, unreadable numbers and times are null.
    A record of another arity is an error when it is read; with strict=False it is left out, for `violations` to list. Files of several runs may
    lie side by side, and runs one after the other in a file. With position=True rows carry (file, block, n), which sorts a file's rows in its order.
    No files give no rows. Of 16-field views the lines are counted when this is called."""
    more = ["position"] * position
    if isinstance(path, list) and not path:
        return typed(spark.createDataFrame([], "fields array<string>, position struct<file:string,block:long,n:long>"), view, *more)
    fits = F.size("fields") == ARITY[view]
    where = F.concat(F.substring_index("position.file", "/", -1), F.coalesce(F.concat(F.lit(", record "), F.col("number").cast("string")), F.lit("")))
    wrong = F.raise_error(F.format_string(f"{view}: %s: a record of %d fields instead of {ARITY[view]}: %s", where, F.size("fields"), F.left("record", F.lit(200))))
    return typed(_records(spark, path, view).where(F.when(fits, F.lit(True)).otherwise(wrong) if strict else fits), view, *more)


def violations(spark: SparkSession, path: str | list[str], view: str) -> DataFrame:
    """(view, file, number, n_fields, record) of records whose arity is not the view's."""
    bad = _records(spark, path, view).where(F.size("fields") != ARITY[view])
    return bad.select(F.lit(view).alias("view"), "position.file", "number", F.size("fields").alias("n_fields"), "record")


def headers(spark: SparkSession, path: str | list[str], view: str) -> DataFrame:
    """(file, pos, source_system_name, extract_run_id, extracted_at, snapshot_date) of all records of a view's files, for the checks of a batch."""
    rows = read_view(spark, path, view, strict=False, position=True)
    return rows.select("position.file", F.struct("position.block", "position.n").alias("pos"), "source_system_name", "extract_run_id", F.to_timestamp("extracted_at_utc").alias("extracted_at"), "snapshot_date")


_EDGE = "array<struct<sourceAttributeNaturalKey:string,sourceDatasetNaturalKey:string,targetAttributeNaturalKey:string,targetDatasetNaturalKey:string,stepNaturalKey:string,expression:string,transformationType:string>>"
LINEAGE_SCHEMA = (
    "parseRunId string, parseTimestamp string, platform struct<platformNaturalKey:string,technology:string>, containers array<struct<containerNaturalKey:string>>,"
    "datasets array<struct<datasetNaturalKey:string,containerNaturalKey:string,datasetType:string>>,"
    "attributes array<struct<attributeNaturalKey:string,datasetNaturalKey:string,containerNaturalKey:string,dataType:string,nullable:boolean,ordinalPosition:bigint,attributeClass:string>>,"
    "processGroups array<struct<processGroupNaturalKey:string>>, processes array<struct<processNaturalKey:string,processType:string,processGroupNaturalKey:string>>,"
    "steps array<struct<stepNaturalKey:string,processNaturalKey:string,stepLevel:string,stepType:string,parentStepNaturalKey:string>>,"
    f"tier1QueryBlockAttributeLineage {_EDGE}, tier2StatementAttributeLineage {_EDGE}, lineageFactAttribute {_EDGE},"
    "tier3DatasetLineage array<struct<sourceDatasetNaturalKey:string,targetDatasetNaturalKey:string,stepNaturalKey:string,impactType:string>>"
)


def lineage_frames(documents: DataFrame) -> dict[str, DataFrame]:
    """One frame for each collection of lineage documents. Attribute edges are the facts if there are any, else tiers 1 and 2."""
    out = {c: documents.select(F.explode(c).alias("r")).select("r.*") for c in ("containers", "datasets", "attributes", "processGroups", "processes", "steps", "tier3DatasetLineage")}
    tagged = lambda c, tier: F.transform(F.coalesce(c, F.array()), lambda e: F.struct(e.alias("edge"), F.lit(tier).alias("tier")))
    edges = F.when(F.size("lineageFactAttribute") > 0, tagged("lineageFactAttribute", "FACT")).otherwise(F.concat(tagged("tier1QueryBlockAttributeLineage", "TIER1"), tagged("tier2StatementAttributeLineage", "TIER2")))
    out["attribute_edges"] = documents.select(F.explode(edges).alias("r")).select("r.edge.*", "r.tier")
    return out


_NAMED = "parseRunId is not null and parseTimestamp is not null and platform is not null"


def read_lineage(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Frames of lineage documents that say their run, time and platform. Large files are taken apart when this is called; lists of documents are read whole, whatever their size."""
    docs = spark.read.schema(LINEAGE_SCHEMA).option("multiLine", True).json(path)
    small = F.col("_metadata.file_size") <= documents.LARGE
    if not documents.any_large(spark, path):
        return lineage_frames(docs.where(_NAMED))
    apart = documents.take_apart(spark, path)
    lists = F.coalesce(F.col("text").rlike(r"^\s*\["), F.lit(False))
    whole = [r["file"] for r in apart.rest.where(lists).select("file").collect()]  # of a listing of files
    out = lineage_frames(docs.where(small | F.col("_metadata.file_path").isin(whole) if whole else small).where(_NAMED))
    rest = apart.rest.where(~lists).select("file", "marked", F.from_json("text", LINEAGE_SCHEMA).alias("doc")).select("file", "marked", "doc.*").where(_NAMED)
    # Which collection a run of records belongs to is told by its mark. Every collection has its first record in the rest, so the rest also tells whether there are facts.
    facts = F.size("lineageFactAttribute") > 0
    tiers = {"tier1QueryBlockAttributeLineage": ("TIER1", ~facts), "tier2StatementAttributeLineage": ("TIER2", ~facts), "lineageFactAttribute": ("FACT", facts)}
    for name, first in lineage_frames(rest).items():
        of = list(tiers) if name == "attribute_edges" else [name]
        for collection in of:
            run = F.from_json("marked", f"struct<{collection}:array<struct<{documents.RUN}:bigint>>>")[collection]
            wanted = rest.where(tiers[collection][1]) if name == "attribute_edges" else rest
            marks = wanted.select("file", F.explode(run[documents.RUN]).alias("run")).where("run is not null")
            schema = next(f.dataType.elementType for f in docs.schema.fields if f.name == collection)
            rows = apart.records.join(marks, ["file", "run"]).select(F.from_json("text", schema).alias("r")).select("r.*")
            first = first.unionByName(rows.withColumn("tier", F.lit(tiers[collection][0])) if name == "attribute_edges" else rows)
        out[name] = out[name].unionByName(first)
    return out


def read_usage_json(spark: SparkSession, path: str) -> DataFrame:
    """Usage items with a name; the whole item is kept as JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<variant>")).alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    rows = raw.select(
        get("object_name", "string").alias("object_name"), get("object_type", "string").alias("object_type"), get("schema_name", "string").alias("schema_name"), F.coalesce(get("query_count", "bigint"), F.lit(0)).alias("query_count"),
        F.coalesce(get("user_count", "bigint"), F.lit(0)).alias("user_count"), F.try_to_timestamp(get("last_accessed", "string")).cast("timestamp_ntz").alias("last_accessed"), F.to_json("v").alias("source_json"),
    )
    return rows.where("object_name is not null and object_name <> ''")


# Header names that mean the same.
ALIASES = {
    "username": ["username", "user", "user_name", "logon_name"], "display_name": ["display_name", "name", "full_name", "user_display_name"], "email": ["email", "email_address", "mail"],
    "team": ["team", "team_name", "group"], "department": ["department", "dept", "lob", "department_name", "line_of_business"], "application_name": ["application_name", "application", "app", "app_name"],
    "description": ["description", "desc", "notes"], "schema_name": ["schema_name", "schema", "database", "database_name", "db"], "table_name": ["table_name", "table", "object_name"], "owner_team": ["owner_team", "owner", "owning_team"],
}


def read_org_csv(spark: SparkSession, path: str, key: str, wanted: list[str], position: bool = False) -> DataFrame:
    """Columns under their canonical names, the first header that fits each; rows with a blank key are left out. With position=True rows
    carry (file, block, n), which sorts a file's rows in its order."""
    raw = spark.read.csv(path, header=True)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("position")
    canonical = {alias: name for name, aliases in reversed(ALIASES.items()) for alias in aliases}
    named = {header: canonical.get(re.sub(" ", "_", header.strip().lower())) for header in raw.columns}
    found = {name: header for header, name in reversed(named.items()) if name}
    out = raw.select(*(blank_to_null(F.col(f"`{found[w]}`")).alias(w) if w in found else F.lit(None).cast("string").alias(w) for w in wanted), *[at] * position)
    return out.where(F.col(key).isNotNull())


# How files of each view are named.
PREFIXES = {"databasesv_": "databases", "tablesv_": "tables", "columnsv_": "columns", "indicesv_": "indices", "partitioningconstraintsv_": "partitioning", "tabletextv_": "tabletext", "pdcr_log_": "query_log", "pdcr_object_usage_": "object_usage"}


def detect_content(files: DataFrame) -> DataFrame:
    """(path, format, content_type, confidence) from files(path, content): what the first bytes and the name say."""
    # The cut after so many bytes may part a sign.
    head = F.regexp_replace(F.make_valid_utf8(F.substring("content", 1, 16384).cast("string")), "^[\ufeff\\s]+", "")
    name = F.lower(F.substring_index("path", "/", -1))
    flat = F.contains(F.substring(head, 1, 1024), F.lit(DELIMITER))
    kind = F.when(F.substring(head, 1, 1).isin("{", "["), "json").when(flat, "flat").otherwise("unknown")
    by_name = F
    for prefix, view in PREFIXES.items():
        by_name = by_name.when(F.startswith(name, F.lit(prefix)), view)
    endrec = F.contains(head, F.lit("ENDREC"))
    record = F.when(endrec, F.substring_index(head, "ENDREC", 1)).otherwise(F.substring_index(head, "\n", 1))
    arity = F.size(split_escaped(record))
    lineage = F.contains(head, F.lit('"parseRunId"')) | (F.contains(head, F.lit('"objects"')) & F.contains(head, F.lit('"lineage"')))
    usage = F.contains(head, F.lit('"object_name"')) & F.contains(head, F.lit('"query_count"'))
    content = (
        F.when(F.col("format") == "json", F.when(lineage, "lineage").when(usage, "usage").otherwise("unknown"))
        .when(F.col("format") == "flat", F.coalesce(F.col("_named"), F.when(arity == 10, "query_log").when(arity == 12, "object_usage").otherwise("ambiguous")))
        .otherwise("unknown")
    )
    sure = F.when(F.col("content_type").isin("unknown", "ambiguous"), "low").when((F.col("format") == "json") | F.col("_named").isNotNull(), "high").otherwise("medium")
    return files.withColumns({"format": kind, "_named": by_name}).withColumn("content_type", content).withColumn("confidence", sure).select("path", "format", "content_type", "confidence")


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def list_landing(spark: SparkSession, root: str, imported: DataFrame | None = None) -> DataFrame:
    """Importable files below root without reading them: path, whether archived, run folder, time and size, newest first;
    imported(path) marks those that are done."""
    files = read_files(spark, root, "*.{dat,json,DAT,JSON}").select("path", "modificationTime", "length")
    out = files.withColumns({"archived": F.lower("path").contains("/archive/"), "folder": F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)})
    if imported is None:
        out = out.withColumn("imported", F.lit(False))
    else:
        out = out.join(imported.select("path").distinct().withColumn("_i", F.lit(True)), "path", "left").withColumn("imported", F.coalesce("_i", F.lit(False))).drop("_i")
    return out.orderBy(F.desc("modificationTime"), "path")


def read_snapshot(spark: SparkSession, root: str, table: str, snapshot_id: int) -> DataFrame:
    """One snapshot's rows of a table partitioned by snapshot_id: other partitions are not read."""
    return spark.read.parquet(f"{root}/{table}").where(F.col("snapshot_id") == snapshot_id)


def capture_catalog(spark: SparkSession, databases: list[str] | None = None) -> DataFrame:
    """(schema_name, table_name, object_type, column_name, data_type, nullable, ordinal_position) of the session's live catalog.
    The catalog's listing is metadata that the driver holds anyway."""
    rows = []
    for db in sorted(databases or [d.name for d in spark.catalog.listDatabases()]):
        for t in spark.catalog.listTables(db):
            if not t.isTemporary:
                for k, c in enumerate(spark.catalog.listColumns(f"{db}.{t.name}")):
                    rows.append((db, t.name, "VIEW" if t.tableType == "VIEW" else "TABLE", c.name, c.dataType, c.nullable, k + 1))
    return spark.createDataFrame(rows, "schema_name string, table_name string, object_type string, column_name string, data_type string, nullable boolean, ordinal_position int").distinct()
