"""Queries of readers and writers, batch quality, people, search, ingest compositions and streams.

File formats are exercised by writing rows of the given tables in the format, into the shared folder, and reading them back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.functions import exprs
from shiftlens.operators import contract, entities, org, quality
from shiftlens.plans import ingest
from shiftlens.plans.registry import query
from shiftlens.sources import documents, readers, writers
from shiftlens.sources.shared import cut, shared_folder
from shiftlens.streaming import jobs


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _written(df: DataFrame, record: str, folder: str, name: str) -> str:
    """Write records (a string expression) as text files below folder/name; the path."""
    path = f"{folder}/{name}"
    df.select(F.expr(record).alias("value")).write.text(path)
    return path


_HEAD = "'td§20240131T120000Z§2024-01-31T12:00:00§2024-01-31'"


def _fixed16(*fields: str) -> str:
    padded = [*fields, *["''"] * (12 - len(fields))]
    return f"concat_ws('§', {_HEAD}, {', '.join(padded)})"


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'run two' ELSE '20240131T120000Z' END AS extract_run_id, 'db' || (s_nationkey % 3) AS database_name, 'own§er' || s_suppkey AS owner_name, CAST(s_suppkey * 1000 AS BIGINT) AS perm_space, 'line one' || chr(10) || s_name AS comment_string FROM supplier")
def src1_read_fixed16(d):
    """Files of two runs side by side."""
    record = _fixed16("concat('db', s_nationkey % 3)", "concat('own\\\\§er', s_suppkey)", "''", "'2024-01-01 00:00:00'", "''", "''", "concat('line one\n', s_name)", "format_number(s_suppkey * 1000, 0)")
    folder = _folder(d.spark)
    _written(d.supplier.where("s_suppkey % 3 <> 0").repartition(2), record, folder, "a")
    _written(d.supplier.where("s_suppkey % 3 = 0").repartition(2), record.replace("20240131T120000Z", "run two"), folder, "b")
    return readers.read_view(d.spark, [f"{folder}/a", f"{folder}/b"], "databases").select("extract_run_id", "database_name", "owner_name", "perm_space", "comment_string")


@query(
    """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'run two' ELSE '20240131T120000Z' END AS extract_run_id, 'db' || s_suppkey AS database_name, CASE WHEN s_suppkey % 2 = 0 THEN 'line one' || chr(10) || chr(10) || 'td§20240131T120000Z§' || s_name END AS comment_string FROM supplier"""
)
def src1_mixed_runs(d):
    """Files of two runs in turn, with blank lines before records, comments over several lines, and lines in them that begin as records do."""
    record = _fixed16("concat('db', s_suppkey)", "''", "''", "''", "''", "''", "if(s_suppkey % 2 = 0, concat('line one\n\ntd\\\\§20240131T120000Z\\\\§', s_name), '')")
    record = f"concat(if(s_suppkey % 5 = 0, ' \n\n', ''), if(s_suppkey % 3 = 0, replace({record}, 'td§20240131T120000Z', 'td§run two'), {record}))"
    path = _written(d.supplier.repartition(3, "s_nationkey").sortWithinPartitions("s_suppkey"), record, _folder(d.spark), "mixed")
    return readers.read_view(d.spark, path, "databases").select("extract_run_id", "database_name", "comment_string")


@query(
    """WITH o AS (SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r, s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)
SELECT 'databases' AS view, CAST(max(r) AS BIGINT) AS number, 6 AS n_fields, 'td§20240131T120000Z§2024-01-31T12:00:00§2024-01-31§db' || max(s_suppkey) || '§cut' AS record FROM o WHERE r = n GROUP BY s_nationkey HAVING max(n) > 0"""
)
def src1_violations(d):
    """Files that end in the midst of a record, by number."""
    whole, cut_ = _fixed16("concat('db', s_suppkey)", "''", "''", "''", "''", "''", "'a\nb'"), f"concat_ws('§', {_HEAD}, concat('db', s_suppkey), 'cut')"
    rows = d.supplier.withColumn("_last", F.expr("row_number() over (partition by s_nationkey order by s_suppkey desc) = 1"))
    folder = _folder(d.spark)
    lines = rows.select("s_nationkey", "s_suppkey", F.when(F.col("_last"), F.expr(cut_)).otherwise(F.expr(whole)).alias("value"))
    lines.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey").select("s_nationkey", "value").write.partitionBy("s_nationkey").text(f"{folder}/cut")
    return readers.violations(d.spark, f"{folder}/cut", "databases").select("view", "number", "n_fields", "record")


_COLUMN_FILE = _fixed16("concat('S', l_suppkey % 12)", "concat('T', l_partkey)", "concat('C', l_orderkey, '_', l_linenumber)", "format_number(l_linenumber, 0)", "if(l_returnflag = 'A', 'CV', 'D')", "format_number(cast(l_quantity as bigint) * 100, 0)", "'18'", "'2'", "if(l_linestatus = 'O', 'N', 'Y')")


@query("SELECT 'S' || (l_suppkey % 12) AS database_name, CASE WHEN l_returnflag = 'A' THEN 'CV' ELSE 'D' END AS column_type, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'Y' END AS nullable, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT) * 100) AS BIGINT) AS lengths, CAST(sum(l_linenumber) AS BIGINT) AS ids, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1, 2, 3")
def src1_parse_columns(d):
    """A columns extract with a row for every line of the orders."""
    path = _written(d.lineitem, _COLUMN_FILE, _folder(d.spark), "columns")
    rows = readers.read_view(d.spark, path, "columns")
    name = F.substring_index(F.substring("column_name", 2, 100), "_", 1)
    return rows.groupBy("database_name", "column_type", "nullable").agg(F.count("*").alias("n"), F.sum("column_length").alias("lengths"), F.sum("column_id").alias("ids"), F.count_distinct(name).alias("orders"))


@query("SELECT count(*) AS stored, count(DISTINCT l_partkey) AS tables FROM lineitem")
def snk1_persist_columns(d):
    """A columns extract parsed, typed and written as a snapshot's columns."""
    root = _folder(d.spark)
    rows = readers.read_view(d.spark, _written(d.lineitem, _COLUMN_FILE, root, "extract"), "columns")
    typed = rows.select(F.col("source_system_name").alias("source_system"), "extract_run_id", F.lit(1).alias("snapshot_id"), "database_name", "table_name", "column_name", exprs.format_type("column_type", "column_length", "decimal_total_digits", "decimal_fractional_digits").alias("data_type"), "column_id")
    writers.persist_run({"snapshot_rows": typed}, root, "td", "20240131T120000Z")
    return d.spark.read.parquet(f"{root}/snapshot_rows").agg(F.count("*").alias("stored"), F.count_distinct("table_name").alias("tables"))


@query("SELECT 't' || conv_id AS table_name, turn AS request_text_seq, text AS request_text FROM conversations WHERE text IS NOT NULL AND text <> ''")
def src2_read_endrec(d):
    rows = d.conversations.where("text is not null and text <> ''")
    record = "concat(concat_ws('§', 'td', 'r1', 't', 'd', 'db', concat('t', conv_id), 'T', turn, replace(text, '§', '\\\\§')), 'ENDREC')"
    return readers.read_view(d.spark, _written(rows, record, _folder(d.spark), "tabletext"), "tabletext").select("table_name", "request_text_seq", "request_text")


_QUERY_LOG = "concat(concat_ws('§', 'td', '2024/05/12', '7', '2024-05-12 17:47:57.646670', format_number(conv_id, 0), turn, text, 'db', '', ''), 'ENDREC')"


@query("SELECT conv_id AS query_id, turn AS sql_row_no, text AS sql_text_info, CAST(TIMESTAMP '2024-05-12 17:47:57.646670' AS VARCHAR) AS collect_timestamp FROM conversations WHERE text IS NOT NULL AND text <> ''")
def src3_read_query_log(d):
    path = _written(d.conversations.where("text is not null and text <> ''"), _QUERY_LOG, _folder(d.spark), "log")
    return readers.read_view(d.spark, path, "query_log").select("query_id", "sql_row_no", "sql_text_info", F.col("collect_timestamp").cast("string").alias("collect_timestamp"))


_OBJECT_USAGE = "concat(concat_ws('§', 'td', schema_name, substring_index(object_name, '.', -1), '', event_id, element_at(array('Tab', 'Viw', 'UDF', 'Col'), cast(event_id % 4 + 1 as int)), '1', '2', 'Y', query_count, user_count, date_format(last_accessed, 'yyyy-MM-dd HH:mm:ss')), 'ENDREC')"


@query("SELECT schema_name AS database_name, split_part(object_name, '.', 2) AS table_name, CAST(event_id AS VARCHAR) AS object_num, query_count, user_count AS distinct_user_count, strftime(last_accessed, '%Y-%m-%d %H:%M:%S') AS last_accessed FROM usage")
def src4_read_object_usage(d):
    path = _written(d.usage, _OBJECT_USAGE, _folder(d.spark), "usage")
    return readers.read_view(d.spark, path, "object_usage").select("database_name", "table_name", "object_num", "query_count", "distinct_user_count", F.date_format("last_accessed", "yyyy-MM-dd HH:mm:ss").alias("last_accessed"))


_EDGE = "to_json(named_struct('sourceAttributeNaturalKey', source_key, 'sourceDatasetNaturalKey', substring_index(source_key, '|', 1), 'targetAttributeNaturalKey', target_key, 'targetDatasetNaturalKey', substring_index(target_key, '|', 1), 'stepNaturalKey', step_key, 'expression', expression, 'transformationType', transformation_type))"


def _document(d, unnamed: bool = False) -> DataFrame:
    """(file, k, line): the lines of lineage documents, one an order key's step, from attribute lineage. unnamed: with one document, a copy of another, that names no run."""
    rows = d.lineage.select("step_key", "tier", F.expr("transformation_type = 'A' and step_key >= 'step5'").alias("fact"), F.expr(_EDGE).alias("line"))
    edges = rows.select(F.col("step_key").alias("file"), F.explode(F.expr("array_compact(array(case tier when 'TIER1' then 1 when 'TIER2' then 2 end, if(fact, 3, null)))")).alias("k"), "line")
    steps = d.lineage.select(F.col("step_key").alias("file")).distinct()
    if unnamed:
        first = steps.agg(F.min("file").alias("file"))
        edges = edges.unionByName(edges.join(F.broadcast(first), "file").withColumn("file", F.lit("none")))
        steps = steps.unionByName(first.where("file is not null").select(F.lit("none").alias("file")))
    run = F.when(F.col("file") != "none", F.concat(F.lit('"parseRunId":"'), "file", F.lit('",'))).otherwise("")
    opened = F.concat(F.lit("{"), run, F.lit('"parseTimestamp":"2024-05-01","platform":{"platformNaturalKey":"p","technology":"t"},"tier1QueryBlockAttributeLineage":['))
    frame = {0: opened, 1.5: F.lit('],"tier2StatementAttributeLineage":['), 2.5: F.lit('],"lineageFactAttribute":['), 4: F.lit("]}")}
    return _lines(edges, steps, frame)


def _lines(records: DataFrame, files: DataFrame, frame: dict) -> DataFrame:
    """(file, k, line): records(file, k, line) and, for each of files, the lines of the frame by their k, which no record has."""
    around = files.select("*", F.explode(F.array(*(F.struct(F.lit(float(k)).alias("k"), line.alias("line")) for k, line in frame.items()))).alias("f")).select("file", "f.k", "f.line")
    return records.select("file", F.col("k").cast("double").alias("k"), "line").unionByName(around)


@query(
    """WITH f AS (SELECT step_key FROM lineage WHERE transformation_type = 'A' AND step_key >= 'step5' GROUP BY 1)
SELECT step_key, tier, count(*) AS n FROM (SELECT step_key, 'FACT' AS tier FROM lineage WHERE transformation_type = 'A' AND step_key >= 'step5' UNION ALL SELECT step_key, tier FROM lineage WHERE step_key NOT IN (FROM f)) GROUP BY ALL"""
)
def src5_read_lineage_json(d):
    path = _document_files(_document(d, unnamed=True), f"{_folder(d.spark)}/lineage")  # the unnamed one is left out by the reader
    return readers.read_lineage(d.spark, path)["attribute_edges"].groupBy(F.col("stepNaturalKey").alias("step_key"), "tier").agg(F.count("*").alias("n"))


def _document_files(lines: DataFrame, path: str, by: str = "file") -> str:
    """Each document in a file of its own, from (file, k, line): its lines by k, with commas between those of one k. A task sorts a document's lines, and holds none whole."""
    at = Window.partitionBy("file").orderBy("k", "line")
    comma = F.when(F.lag("k").over(at) == F.col("k"), F.lit(",")).otherwise(F.lit(""))
    # The writer sorts by file alone what it doesn't see in order, and a sort that spills mixes the lines of a file: the order that the window leaves has to be said.
    placed = lines.select("file", "k", "line", comma.alias("comma")).sortWithinPartitions("file", "k", "line")
    placed.select(F.col("file").alias(by), F.concat("comma", "line").alias("value")).write.partitionBy(by).text(path)
    return path


@query("SELECT object_name, query_count, user_count, CAST(last_accessed AS VARCHAR) AS last_accessed FROM (SELECT object_name, sum(query_count)::BIGINT AS query_count, count(*) AS user_count, TIMESTAMP '2024-05-01 10:00:00' AS last_accessed FROM usage GROUP BY 1)")
def src6_read_usage_json(d):
    items = d.usage.groupBy("object_name").agg(F.sum("query_count").alias("query_count"), F.count("*").alias("user_count")).withColumn("last_accessed", F.lit("2024-05-01T10:00:00"))
    path = f"{_folder(d.spark)}/usage_json"
    shard = items.groupBy(F.pmod(F.hash("object_name"), F.lit(4)).alias("k")).agg(F.to_json(F.collect_list(F.struct("object_name", "query_count", "user_count", "last_accessed"))).alias("value"))
    shard.write.partitionBy("k").text(path)  # one list a file
    return readers.read_usage_json(d.spark, path).select("object_name", "query_count", "user_count", F.col("last_accessed").cast("string").alias("last_accessed"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS username, c_name AS display_name, CAST(c_nationkey AS VARCHAR) AS team, CAST(NULL AS VARCHAR) AS email FROM customer WHERE c_custkey % 7 <> 0")
def src7_read_org_csv(d):
    path = f"{_folder(d.spark)}/people"
    d.customer.select(F.expr("if(c_custkey % 7 = 0, ' ', cast(c_custkey as string))").alias("User Name"), F.col("c_name").alias("Full Name"), F.col("c_nationkey").alias("Group")).write.option("header", True).csv(path)
    return readers.read_org_csv(d.spark, path, "username", ["username", "display_name", "team", "email"])


@query("SELECT DISTINCT 'flat' AS format, 'object_usage' AS content_type, 'medium' AS confidence FROM usage UNION SELECT DISTINCT 'json', 'lineage', 'high' FROM lineage UNION SELECT DISTINCT 'flat', 'tables', 'high' FROM supplier")
def src8_detect_content(d):
    folder = _folder(d.spark)
    _written(d.usage.repartition(3), _OBJECT_USAGE, folder, "x")
    _document_files(_document(d), f"{folder}/y")
    _written(d.supplier.repartition(2), _fixed16("'db'", "concat('T', s_suppkey)", "'T'"), folder, "z")
    _rename(d.spark, f"{folder}/z", folder, "tablesv_full")
    return readers.detect_content(documents.heads(d.spark, folder, "{part-*,tablesv_*}")).select("format", "content_type", "confidence").distinct()


@query("SELECT 'k=' || k AS folder, k <> 2 AS archived, k = 1 AS imported, true AS filled, count(*) AS n FROM (SELECT DISTINCT event_id % 3 AS k FROM usage) GROUP BY ALL")
def src9_list_landing(d):
    """Three folders with a file each, two of them archived and one of those imported before."""
    folder = _folder(d.spark)
    rows = d.usage.select((F.col("event_id") % 3).alias("k"), "object_name").repartition("k")
    rows.where("k <> 2").write.partitionBy("k").json(f"{folder}/Archive")
    rows.where("k = 2").write.partitionBy("k").json(f"{folder}/usage")
    done = readers.list_landing(d.spark, folder).where(F.contains("path", F.lit("k=1"))).select("path")
    listed = readers.list_landing(d.spark, folder, done)
    return listed.groupBy("folder", "archived", "imported", (F.col("length") > 0).alias("filled")).agg(F.count("*").alias("n"))


@query("SELECT schema_name, table_name, object_type FROM tabs WHERE snapshot_id = 4")
def src10_read_snapshot(d):
    root = _folder(d.spark)
    d.tabs.write.partitionBy("snapshot_id").parquet(f"{root}/tables")
    return readers.read_snapshot(d.spark, root, "tables", 4).select("schema_name", "table_name", "object_type")


@query("SELECT 'TABLE' AS object_type, column_name, data_type, ordinal_position FROM (VALUES ('n_nationkey', 'int', 1), ('n_name', 'string', 2), ('n_regionkey', 'int', 3)) AS t(column_name, data_type, ordinal_position)")
def src11_capture_catalog(d):
    name = f"capture_{uuid.uuid4().hex}"
    d.spark.sql(f"CREATE DATABASE {name}")
    try:
        d.nation.write.saveAsTable(f"{name}.nation")
        found = readers.capture_catalog(d.spark, [name])
        return found.select("object_type", "column_name", "data_type", "ordinal_position")
    finally:
        d.spark.sql(f"DROP DATABASE {name} CASCADE")


@query("SELECT CASE WHEN k = 3 THEN 'A r1' ELSE 'A r' || k END AS run, CAST(k AS BIGINT) AS snapshot_id, count(*) AS n FROM tabs JOIN (SELECT unnest([1, 2, 3]) AS k) ON snapshot_id = CASE WHEN k = 3 THEN 1 ELSE k END GROUP BY 1, 2")
def snk1_write_snapshot(d):
    """Two runs, the first of them once more, which does nothing, and once more by force, which gives a third snapshot."""
    root = _folder(d.spark)
    for k, force in ((1, False), (2, False), (1, False), (1, True)):
        writers.persist_run({"snapshot_rows": d.tabs.where(F.col("snapshot_id") == k)}, root, "A", f"r{k}", force)
    runs = writers.ledger(d.spark, root).select(F.concat_ws(" ", "source_system", "extract_run_id").alias("run"), "snapshot_id")
    rows = d.spark.read.parquet(f"{root}/snapshot_rows").groupBy(F.col("snapshot_id").cast("long").alias("snapshot_id")).agg(F.count("*").alias("n"))
    return runs.join(rows, "snapshot_id").select("run", "snapshot_id", "n")


@query("SELECT CAST(1 AS BIGINT) AS snapshot_id, count(*) AS n FROM tabs WHERE snapshot_id = 2")
def snk1_after_a_killed_run(d):
    """A run that died before its line in the ledger: its rows go, and the next one takes its id."""
    root = _folder(d.spark)
    d.tabs.where("snapshot_id = 1").drop("snapshot_id").write.parquet(f"{root}/snapshot_rows/snapshot_id=1")
    writers.persist_run({"snapshot_rows": d.tabs.where("snapshot_id = 2")}, root, "A", "r1")
    return d.spark.read.parquet(f"{root}/snapshot_rows").groupBy(F.col("snapshot_id").cast("long").alias("snapshot_id")).agg(F.count("*").alias("n"))


@query("SELECT CAST(snapshot_from AS BIGINT) AS snapshot_from, CAST(snapshot_to AS BIGINT) AS snapshot_to, change_id, change_type, CAST(change_id % 2 AS BIGINT) AS version FROM chg WHERE snapshot_from = 2 AND change_id % 2 = 0")
def snk2_stored_pair(d):
    """A pair's changes, asked for twice: what the second call would make is never made."""
    root = _folder(d.spark)
    own = d.chg.where("snapshot_from = 2")
    pair = own.select("snapshot_from", "snapshot_to").first()
    for odd in (0, 1):
        found = writers.changes_between(d.spark, root, *pair, lambda odd=odd: own.where(F.col("change_id") % 2 == odd).withColumn("version", F.lit(odd).cast("long")))
    return found.select(F.col("snapshot_from").cast("long").alias("snapshot_from"), F.col("snapshot_to").cast("long").alias("snapshot_to"), "change_id", "change_type", "version")


@query("SELECT CAST(snapshot_from AS BIGINT) AS snapshot_from, count(*) AS n FROM chg WHERE snapshot_from < 4 GROUP BY 1")
def snk2_append_changes(d):
    root = _folder(d.spark)
    writers.append_changes(d.chg.where("snapshot_from < 3"), root)
    writers.append_changes(d.chg.where("snapshot_from < 4"), root)
    return d.spark.read.parquet(f"{root}/change_event").groupBy(F.col("snapshot_from").cast("long").alias("snapshot_from")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN change_id % 3 = 0 THEN 'DIRECT' ELSE 'INDIRECT' END AS impact_type, count(*) AS n FROM chg GROUP BY 1")
def snk3_write_impact_events(d):
    root = _folder(d.spark)
    paths = d.chg.select("change_id", F.col("snapshot_to").alias("snapshot_id"), (F.col("change_id") % 3 + 1).alias("depth"))
    writers.write_impacts(paths, root)
    writers.write_impacts(paths, root)
    return d.spark.read.parquet(f"{root}/impact_event").groupBy("impact_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(change_id AS VARCHAR) AS change_id, object_identifier, change_type, severity, CASE WHEN is_breaking THEN 'YES' ELSE 'NO' END AS is_breaking FROM chg")
def snk4_export_csv(d):
    path = f"{_folder(d.spark)}/export"
    writers.export_csv(d.chg, path, "changes")
    return d.spark.read.csv(path, header=True)


@query("SELECT snapshot_id, count(*) AS n FROM tabs WHERE snapshot_id < (SELECT max(snapshot_id) FROM tabs) GROUP BY 1")
def snk5_delete_snapshot(d):
    root = _folder(d.spark)
    d.tabs.write.partitionBy("snapshot_id").parquet(f"{root}/tables")
    latest = d.tabs.agg(F.max("snapshot_id")).first()[0]
    writers.delete_snapshot(d.spark, root, ["tables"], latest, latest)
    return d.spark.read.parquet(f"{root}/tables").groupBy(F.col("snapshot_id").cast("long").alias("snapshot_id")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS stored, count(*) AS duplicates FROM usage")
def snk6_write_usage(d):
    root = _folder(d.spark)
    writers.write_usage(d.usage, root, 5)
    skipped = writers.write_usage(d.usage, root, 5)
    return d.spark.read.parquet(f"{root}/usage_event").agg(F.count("*").alias("stored")).withColumn("duplicates", F.lit(skipped).cast("long"))


# Lineage payloads with noise: containers from brands, datasets and attributes from lineitem keys.
_CONT = "SELECT DISTINCT CASE WHEN p_partkey % 10 = 0 THEN ' Unknown' ELSE p_brand END AS container FROM {part}"
_DATA = "SELECT DISTINCT CASE p_partkey % 9 WHEN 0 THEN 'UNKNOWN.TEMPTABLE' || p_partkey WHEN 1 THEN 'S.tmp_' || p_partkey ELSE 'S.T' || p_partkey END AS ds, CASE WHEN p_partkey % 10 = 0 THEN 'unknown' ELSE p_brand END AS container FROM {part}"
_ATTR = "SELECT DISTINCT CASE p_partkey % 9 WHEN 0 THEN 'UNKNOWN.TEMPTABLE' || p_partkey WHEN 1 THEN 'S.tmp_' || p_partkey ELSE 'S.T' || p_partkey END AS ds, CASE WHEN p_partkey % 10 = 0 THEN 'unknown' ELSE p_brand END AS container, 'A' || p_partkey || CASE p_size % 6 WHEN 0 THEN '|NULL' WHEN 1 THEN '|12' WHEN 2 THEN '|''x''' ELSE '|c' END AS attr, CASE p_size % 7 WHEN 0 THEN 'LITERAL' WHEN 1 THEN 'Column' ELSE NULL END AS cls FROM {part}"
_EDGES = "SELECT a.attr AS s, b.attr AS t FROM (SELECT 'A' || p_partkey || CASE p_size % 6 WHEN 0 THEN '|NULL' WHEN 1 THEN '|12' WHEN 2 THEN '|''x''' ELSE '|c' END AS attr, p_partkey AS k FROM {part}) a JOIN (SELECT 'A' || p_partkey || CASE p_size % 6 WHEN 0 THEN '|NULL' WHEN 1 THEN '|12' WHEN 2 THEN '|''x''' ELSE '|c' END AS attr, p_partkey AS k FROM {part}) b ON b.k = a.k * 2"
_NOISE = f"""WITH c AS ({_CONT}), ds AS ({_DATA}), att AS ({_ATTR}), e AS ({_EDGES}),
dd AS (SELECT *, CASE WHEN container = 'unknown' THEN 'placeholder' WHEN regexp_matches(lower(ds), '^unknown\\.temptable\\d+$') OR regexp_matches(lower(ds), '\\.tmp_\\w+$') THEN 'temporary' END AS reason FROM ds),
aa AS (SELECT att.*, CASE WHEN CASE WHEN cls IS NOT NULL THEN lower(cls) <> 'column' ELSE attr LIKE '%|NULL' OR attr LIKE '%|12' OR attr LIKE '%|''x''' OR att.container = 'unknown' END THEN 'literal' WHEN dd.reason IS NOT NULL THEN 'dropped dataset' END AS reason FROM att LEFT JOIN dd USING (ds)),
ee AS (SELECT s, t, CASE WHEN s IN (SELECT attr FROM aa WHERE reason IS NOT NULL) OR t IN (SELECT attr FROM aa WHERE reason IS NOT NULL) THEN 'dropped end' WHEN s = t THEN 'self loop' END AS reason FROM e)""".replace("{part}", "part")


def _payload(d):
    sql = lambda text: d.spark.sql(text, part=d.part)
    return (
        sql(_CONT).withColumnRenamed("container", "containerNaturalKey"), sql(_DATA).toDF("datasetNaturalKey", "containerNaturalKey"),
        sql(_ATTR).toDF("datasetNaturalKey", "containerNaturalKey", "attributeNaturalKey", "attributeClass"), sql(_EDGES).toDF("sourceAttributeNaturalKey", "targetAttributeNaturalKey"),
    )


@query(_NOISE + "SELECT 'container' AS kind, 'placeholder' AS reason, count(*) AS n FROM c WHERE trim(lower(container)) = 'unknown' UNION ALL SELECT 'dataset', reason, count(*) FROM dd WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'attribute', reason, count(*) FROM aa WHERE reason IS NOT NULL GROUP BY 2 UNION ALL SELECT 'edge', reason, count(*) FROM ee WHERE reason IS NOT NULL GROUP BY 2")
def flt1_noise_filter(d):
    return quality.noise_filter(*_payload(d))["stats"]


@query(_NOISE + "SELECT s AS source_key, t AS target_key FROM ee WHERE reason IS NULL")
def flt1_kept_edges(d):
    kept = quality.noise_filter(*_payload(d))["edges"]
    return kept.select(F.col("sourceAttributeNaturalKey").alias("source_key"), F.col("targetAttributeNaturalKey").alias("target_key"))


@query("SELECT object_name, object_type FROM node WHERE object_name ILIKE '%s1.t1%' AND object_type = 'TABLE' ORDER BY lower(object_name), object_name LIMIT 21", name="flt4_object_search")
def _flt4(d):
    return org.object_search(d.node, "s1.T1", ["TABLE"]).join(d.node.select("object_name", "object_type"), "object_name")


@query(
    """WITH n AS (SELECT DISTINCT 'node' AS kind, object_name AS name FROM node WHERE object_name ILIKE '%s3.t5%' OR schema_name ILIKE '%s3.t5%' ORDER BY name LIMIT 50), c AS (SELECT DISTINCT 'change' AS kind, object_identifier AS name FROM chg WHERE object_identifier ILIKE '%s3.t5%' ORDER BY name LIMIT 50)
SELECT *, CASE WHEN lower(name) = 's3.t5' THEN 0 WHEN starts_with(lower(name), 's3.t5') THEN 1 ELSE 2 END AS rank FROM (SELECT * FROM n UNION ALL SELECT * FROM c) ORDER BY rank, name, kind LIMIT 30"""
)
def flt5_global_search(d):
    return org.global_search(d.node, d.chg, "s3.t5")


_ENT = """snapb AS (SELECT snapshot_id, source_system, snapshot_id IN (1, 4, 6) AS is_baseline FROM snap), ent AS (SELECT source_system, upper(schema_name || '.' || table_name) AS object_name, min(snapshot_id) AS first_seen, max(snapshot_id) AS last_seen, arg_max(object_type, snapshot_id) AS entity_type FROM tabs JOIN snapb USING (snapshot_id) WHERE NOT (snapshot_id > 3 AND table_name LIKE 'T1%') GROUP BY 1, 2),
ents AS (SELECT ent.*, last_seen >= coalesce(b, 0) AS is_active FROM ent LEFT JOIN (SELECT source_system, max(snapshot_id) AS b FROM snapb WHERE is_baseline GROUP BY 1) USING (source_system))"""


def _entities(d):
    tables = d.tabs.where("not (snapshot_id > 3 and table_name like 'T1%')")
    return ingest.resolve_entities(tables, d.snap.withColumn("is_baseline", F.col("snapshot_id").isin(1, 4, 6)))


@query(f"WITH {_ENT} SELECT * FROM ents")
def ing5_resolve_entities(d):
    return _entities(d)


_ENTITY_TABLES = "t AS (SELECT DISTINCT snapshot_id, upper(object_type) AS entity_type, schema_name || '.' || table_name AS object_name FROM tabs WHERE snapshot_id IN (1, 2, 3) AND NOT (snapshot_id > 1 AND table_name LIKE 'T1%'))"


def _merged(d):
    """Entities after three snapshots, the last of them a baseline, and those before it. The second snapshot is met twice."""
    known = d.spark.createDataFrame([], entities.ENTITY)
    tables = d.tabs.where("not (snapshot_id > 1 and table_name like 'T1%')")
    before = known
    for k in (1, 2, 2, 3):
        before, known = known, cut(entities.merge_entities(known, tables.where(F.col("snapshot_id") == k), k, is_baseline=k == 3))
    return known, before


@query(
    f"""WITH {_ENTITY_TABLES} SELECT entity_type, object_name, min(snapshot_id) AS first_seen, max(snapshot_id) AS last_seen, object_name IN (SELECT object_name FROM t WHERE snapshot_id = 3) AS is_active,
min(snapshot_id) < 3 AS kept_id, (SELECT count(DISTINCT (entity_type, object_name)) FROM t) AS ids FROM t GROUP BY 1, 2"""
)
def ing5_entity_ids(d):
    """Ids stay what they were, and number the entities without a gap."""
    now, before = _merged(d)
    same = now.join(before.select("entity_type", "object_name", F.col("entity_id").alias("_before")), ["entity_type", "object_name"], "left")
    ids = now.agg(F.when((F.count_distinct("entity_id") == F.max("entity_id")) & (F.min("entity_id") == 1), F.count("*")).alias("ids"))
    return same.select("entity_type", "object_name", "first_seen", "last_seen", "is_active", F.coalesce(F.col("_before") == F.col("entity_id"), F.lit(False)).alias("kept_id")).join(F.broadcast(ids))


_CHILDREN = """c AS (SELECT 'tables' AS child, upper(object_type) AS k, schema_name || '.' || table_name AS name FROM tabs WHERE snapshot_id = 3 UNION ALL SELECT 'nodes', upper(object_type), schema_name || '.' || split_part(object_name, '.', 2) FROM node
UNION ALL SELECT 'usage', upper(object_type), object_name FROM usage UNION ALL SELECT 'changes', upper(object_type), object_identifier FROM chg UNION ALL SELECT 'criticality', NULL, object_name FROM node)"""
_ENTITY_NODES = """e AS (SELECT DISTINCT upper(object_type) AS k, object_name AS name FROM node UNION SELECT DISTINCT upper(object_type), schema_name || '.' || table_name FROM tabs WHERE snapshot_id = 3)"""


@query(
    f"""WITH {_CHILDREN}, {_ENTITY_NODES} SELECT child, count(*) AS n, count(*) FILTER (WHERE CASE WHEN c.k IS NULL THEN c.name IN (SELECT name FROM e) ELSE (c.k, c.name) IN (SELECT (k, name) FROM e) END) AS filled FROM c GROUP BY 1"""
)
def ing5_back_fill(d):
    """Ids on the five tables that name entities, filled in twice; each must be that of the entity of its own name."""
    tables = d.tabs.where("snapshot_id = 3")
    own = tables.select("schema_name", "table_name", "object_type").unionByName(d.node.select("schema_name", F.substring_index("object_name", ".", -1).alias("table_name"), "object_type"))
    known = cut(entities.merge_entities(d.spark.createDataFrame([], entities.ENTITY), own, 1))
    nodes = d.node.withColumn("object_name", F.substring_index("object_name", ".", -1))
    children = {"tables": tables, "nodes": nodes, "usage": d.usage, "changes": d.chg, "criticality": d.node.select("object_name")}
    filled = entities.back_fill_all(known, **entities.back_fill_all(known, **children))
    names = {"tables": "concat_ws('.', schema_name, table_name)", "nodes": "concat_ws('.', schema_name, object_name)", "changes": "object_identifier"}
    out = None
    for child, df in filled.items():
        told = df.select("entity_id", F.expr(names.get(child, "object_name")).alias("_name")).join(known.select("entity_id", F.col("object_name").alias("_own")), "entity_id", "left")
        one = told.agg(F.count("*").alias("n"), F.count_if(F.col("_name") == F.col("_own")).alias("filled")).select(F.lit(child).alias("child"), "n", "filled")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_ENT} SELECT object_name, entity_type, count(*) OVER () AS total FROM ents WHERE source_system = 'A' AND split_part(object_name, '.', 1) = 'BRAND#12' AND is_active ORDER BY object_name, entity_type LIMIT 10 OFFSET 5")
def flt6_list_entities(d):
    return org.list_entities(_entities(d).where("source_system = 'A'"), "brand#12", active_only=True, offset=5, limit=10).select("object_name", "entity_type", "total")


@query(f"WITH {_ENT} SELECT object_name, entity_type, first_seen, last_seen FROM ents WHERE source_system = 'A' AND lower(object_name) = 'brand#12.t7' ORDER BY object_name, entity_type LIMIT 1")
def flt7_resolve_entity(d):
    return org.resolve_entity(_entities(d).where("source_system = 'A'"), "Brand#12.t7").select("object_name", "entity_type", "first_seen", "last_seen")


@query("WITH t AS (SELECT * FROM tabs WHERE snapshot_id = 3 AND coalesce(ddl_alter_timestamp, '2024-01-02') >= '2024-01-03') SELECT schema_name, table_name, (SELECT count(*) FROM cols c WHERE c.snapshot_id = 3 AND c.schema_name = t.schema_name AND c.table_name = t.table_name) AS n_columns FROM t")
def flt8_watermark_filter(d):
    tables = org.changed_since(d.tabs.where("snapshot_id = 3").withColumn("created", F.lit("2024-01-02")), F.lit("2024-01-03"), "ddl_alter_timestamp", "created")
    children = d.cols.where("snapshot_id = 3").join(tables, ["schema_name", "table_name"], "left_semi").groupBy("schema_name", "table_name").agg(F.count("*").alias("n_columns"))
    return tables.join(children, ["schema_name", "table_name"], "left").select("schema_name", "table_name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"))


@query("SELECT schema_name, table_name, column_name, data_type, nullable, object_type FROM cols JOIN tabs USING (snapshot_id, schema_name, table_name) WHERE snapshot_id = 5")
def jn2_snapshot_columns(d):
    keys = ["snapshot_id", "schema_name", "table_name"]
    return d.cols.where("snapshot_id = 5").join(d.tabs, keys).select("schema_name", "table_name", "column_name", "data_type", "nullable", "object_type")


_TEAMS = "usage JOIN person USING (username) JOIN team USING (team_id)"


@query(f"SELECT team, department, CAST(sum(query_count) AS BIGINT) AS total_queries, count(*) AS usage_row_count, count(DISTINCT username) AS user_count FROM {_TEAMS} LEFT JOIN dept USING (department_id) GROUP BY 1, 2")
def jn6_usage_by_team(d):
    return org.usage_by_team(d.usage, d.person, d.team, d.dept)


@query(
    """WITH u AS (SELECT object_name, sum(query_count)::BIGINT AS q FROM usage GROUP BY 1), t AS (SELECT DISTINCT object_name, app_id FROM table_app), s AS (SELECT DISTINCT schema_name, app_id FROM schema_app),
m AS (SELECT u.object_name, q, t.app_id FROM u JOIN t USING (object_name) UNION ALL SELECT u.object_name, q, s.app_id FROM u LEFT JOIN s ON s.schema_name = split_part(u.object_name, '.', 1) WHERE u.object_name NOT IN (SELECT object_name FROM t))
SELECT coalesce(application, '(unmapped)') AS application, CAST(sum(q) AS BIGINT) AS total_queries FROM m LEFT JOIN app USING (app_id) GROUP BY 1"""
)
def jn7_usage_by_app(d):
    return org.usage_by_app(d.usage, d.table_app, d.schema_app, d.app)


@query(f"SELECT DISTINCT 'owner' AS role, application AS name, NULL AS department FROM table_app JOIN app USING (app_id) WHERE object_name = 'S1.T1' UNION ALL SELECT DISTINCT 'user', team, department FROM {_TEAMS} LEFT JOIN dept USING (department_id) WHERE object_name = 'S1.T1'")
def jn8_entity_context(d):
    return org.entity_context("s1.t1", d.usage, d.table_app, d.app, d.person, d.team, d.dept)


@query("SELECT change_id FROM chg ANTI JOIN (SELECT change_id FROM chg WHERE change_id % 5 < 3) USING (change_id)")
def jn10_anti_join(d):
    return d.chg.join(d.chg.where("change_id % 5 < 3").select("change_id"), "change_id", "left_anti").select("change_id")


_LOST = """lost AS (SELECT schema_name || '.' || table_name AS k FROM cols WHERE snapshot_id = 2 AND table_name LIKE 'T2%'), lk AS (SELECT k, count(*) AS n FROM lost GROUP BY 1)"""


@query(f"WITH {_LOST} SELECT 'columns->tables' AS relation, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM lk ORDER BY k LIMIT 3)) AS samples FROM lk")
def jn13_orphan_check(d):
    tables = d.tabs.where("snapshot_id = 2 and table_name not like 'T2%'")
    return quality.orphan_check([("columns->tables", d.cols.where("snapshot_id = 2"), tables, ["schema_name", "table_name"])])


@query(
    f"""WITH {_LOST}, five AS (SELECT DISTINCT schema_name || '.' || table_name || '.' || column_name AS k FROM cols WHERE snapshot_id = 2 ORDER BY k LIMIT 5)
SELECT 'orphans: columns->tables' AS item, CAST(sum(n) AS BIGINT) AS n, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM lk ORDER BY k LIMIT 3)) AS samples FROM lk UNION ALL SELECT 'columns', count(*), (SELECT string_agg(k, ',' ORDER BY k) FROM five) FROM cols WHERE snapshot_id = 2
UNION ALL SELECT 'stub types: columns', count(*), '' FROM cols WHERE snapshot_id = 2 AND data_type LIKE 'DEC%'"""
)
def val6_ingest_preview(d):
    tables, columns = d.tabs.where("snapshot_id = 2 and table_name not like 'T2%'"), d.cols.where("snapshot_id = 2").select("schema_name", "table_name", "column_name", "data_type")
    untyped = columns.withColumn("data_type", F.when(~F.startswith("data_type", F.lit("DEC")), F.col("data_type")))
    return quality.ingest_preview({"columns": columns}, [("columns->tables", columns, tables, ["schema_name", "table_name"])], {"columns": (untyped, "data_type")})


_HEADERS = "SELECT 'f' || (p_partkey % 20) AS file, p_partkey AS pos, CASE WHEN p_partkey % 20 = 7 THEN 'B' ELSE 'A' END AS source_system_name, CASE WHEN p_partkey % 20 = 3 AND p_partkey % 3 = 0 THEN 'r2' ELSE 'r1' END AS extract_run_id, CAST(CAST('2024-01-31' AS DATE) AS TIMESTAMP) AS extracted_at, '2024-01-31' AS snapshot_date FROM {part}"


@query("WITH h AS (" + _HEADERS.replace("{part}", "part") + ") SELECT file, CASE WHEN n <> 1 THEN 'several identities' ELSE 'differs from the batch' END AS problem FROM (SELECT file, count(DISTINCT (source_system_name, extract_run_id)) AS n, min(source_system_name) AS s FROM h GROUP BY 1) WHERE n <> 1 OR s <> 'A'")
def val1_batch_identity(d):
    return quality.batch_identity(d.spark.sql(_HEADERS, part=d.part))


@query("SELECT CASE WHEN s_nationkey % 5 = 1 THEN 'several identities' ELSE 'differs from the batch' END AS problem, count(DISTINCT s_nationkey) AS files FROM supplier WHERE s_nationkey % 5 IN (1, 2) GROUP BY 1 HAVING count(*) > 0 UNION ALL SELECT 'empty batch', 1")
def val1_files(d):
    """Identities of files as they lie there, one of whose kinds holds two runs; and a batch without records."""
    record = f"replace({_fixed16('s_suppkey')}, '20240131T120000Z', case when s_nationkey % 5 = 2 or (s_nationkey % 5 = 1 and first) then 'r2' else 'r1' end)"
    rows = d.supplier.withColumn("first", F.expr("row_number() over (partition by s_nationkey order by s_suppkey) = 1"))
    own = rows.where("s_nationkey % 5 <> 1").unionByName(rows.where("s_nationkey % 5 = 1")).unionByName(rows.where("s_nationkey % 5 = 1 and first").withColumn("first", F.lit(False)))
    path = f"{_folder(d.spark)}/batch"
    own.select("s_nationkey", F.expr(record).alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
    told = quality.batch_identity(readers.headers(d.spark, path, "databases"))
    empty = quality.batch_identity(readers.headers(d.spark, [], "databases"))
    return told.unionByName(empty).groupBy("problem").agg(F.count("*").alias("files"))


@query("SELECT count(*) AS files, count(DISTINCT d) AS dates, CAST(date_diff('minute', min(ts), max(ts)) / 60 AS DOUBLE) AS hours, date_diff('minute', min(ts), max(ts)) <= 120 AND count(DISTINCT d) = 1 AS coherent FROM (SELECT event_id % 30 AS f, arg_min(date_trunc('minute', ts), event_id) AS ts, '2024' AS d FROM events GROUP BY 1)")
def val2_temporal_coherence(d):
    headers = d.events.select((F.col("event_id") % 30).alias("file"), F.col("event_id").alias("pos"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("extracted_at"), F.lit("2024").alias("snapshot_date"))
    return quality.temporal_coherence(headers)


@query(
    """WITH t AS (SELECT CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END AS s, 'T' || (p_partkey % 700) AS t FROM part)
SELECT 'error' AS level, 'DUPLICATE_TABLE' AS issue, coalesce(s || '.', '') || t AS subject, count(*) AS n FROM t GROUP BY s, t HAVING count(*) > 1 UNION ALL SELECT 'warning', 'NULL_SCHEMA', t, count(*) FROM t WHERE s IS NULL GROUP BY t
UNION ALL SELECT 'warning', 'UNKNOWN_TYPE', p_type, count(*) FROM part GROUP BY p_type"""
)
def val3_validate_snapshot(d):
    tables = d.part.select(F.expr("CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END").alias("schema_name"), F.expr("'T' || (p_partkey % 700)").alias("table_name"))
    return quality.validate_snapshot(tables, d.part.select(F.col("p_type").alias("data_type")))


@query(
    """WITH t AS (SELECT CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END AS s, 'T' || (p_partkey % 700) AS t FROM part), x AS (SELECT s, t, count(*) AS n FROM t GROUP BY 1, 2)
SELECT 'accepted' AS row_status, coalesce(sum(n) FILTER (WHERE n = 1), 0)::BIGINT AS n, CASE WHEN max(n) > 1 THEN 'failed' ELSE 'committed' END AS import_status FROM x UNION ALL SELECT 'rejected', coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT, CASE WHEN max(n) > 1 THEN 'failed' ELSE 'committed' END FROM x"""
)
def val3_staged_rows(d):
    tables = d.part.select(F.expr("CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE p_brand END").alias("schema_name"), F.expr("'T' || (p_partkey % 700)").alias("table_name"))
    rows, ended = quality.staged(tables)
    kinds = ended.select("import_status", F.expr("stack(2, 'accepted', accepted, 'rejected', rejected) as (row_status, n)"))
    return kinds.join(rows.groupBy("row_status").agg(F.count("*").alias("_rows")), "row_status", "left").where("n = coalesce(_rows, 0)").select("row_status", "n", "import_status")


@query("SELECT count(DISTINCT schema_name) AS schemas, count(*) AS tables, (SELECT count(*) FROM cols WHERE snapshot_id = 2 AND table_name LIKE 'T2%') AS orphan_columns, CAST(0 AS BIGINT) AS no_position, false AS valid FROM tabs WHERE snapshot_id = 2 AND table_name NOT LIKE 'T2%'")
def val4_snapshot_integrity(d):
    return quality.snapshot_integrity(d.tabs.where("snapshot_id = 2 and table_name not like 'T2%'"), d.cols.where("snapshot_id = 2"))


@query("SELECT snapshot_id, 'second baseline' AS problem FROM snap WHERE snapshot_id > 4 AND snapshot_id % 2 = 1 AND source_system IN (SELECT source_system FROM snap WHERE snapshot_id <= 4 AND snapshot_id % 2 = 1) UNION ALL SELECT snapshot_id, 'duplicate description' FROM snap WHERE snapshot_id > 4 AND snapshot_id % 3 IN (SELECT snapshot_id % 3 FROM snap WHERE snapshot_id <= 4)")
def val5_snapshot_policy(d):
    snaps = d.snap.withColumns({"is_baseline": F.col("snapshot_id") % 2 == 1, "description": F.concat(F.lit("d"), (F.col("snapshot_id") % 3).cast("string"))})
    return quality.snapshot_policy(snaps.where("snapshot_id > 4"), snaps.where("snapshot_id <= 4"))


@query(
    _NOISE
    + """SELECT 'FAIL' AS level, 'duplicate dataset' AS finding, ds AS "key" FROM ds GROUP BY ds HAVING count(*) > 1 UNION ALL SELECT 'FAIL', 'duplicate attribute', attr FROM att GROUP BY attr HAVING count(*) > 1
UNION ALL SELECT 'FAIL', 'undeclared step', s FROM (SELECT DISTINCT 'st' || length(s) AS s FROM e WHERE length(s) > 5) UNION ALL SELECT DISTINCT 'FAIL', 'undeclared target', t FROM e WHERE t NOT IN (SELECT attr FROM att WHERE ds LIKE 'S.T%')
UNION ALL SELECT DISTINCT 'FAIL', 'undeclared source', s FROM e WHERE s NOT IN (SELECT attr FROM att WHERE ds LIKE 'S.T%')"""
)
def val7_lineage_contract(d):
    _, datasets, attributes, edges = _payload(d)
    edges = edges.withColumn("stepNaturalKey", F.concat(F.lit("st"), F.length("sourceAttributeNaturalKey").cast("string")))
    steps = edges.where(F.length("sourceAttributeNaturalKey") <= 5).select("stepNaturalKey").distinct()
    named = quality.lineage_contract(datasets, attributes, steps, edges).where("finding not like 'undeclared source' and finding not like 'undeclared target' and finding not like 'undeclared dataset'")
    ends = quality.lineage_contract(datasets, attributes.where("datasetNaturalKey like 'S.T%'"), steps, edges).where("finding like 'undeclared source' or finding like 'undeclared target'")
    return named.unionByName(ends)


_DOCS = "SELECT step_key || ' ' || length(split_part(source_key, '|', 1)) AS document, length(split_part(source_key, '|', 1)) % 2 = 0 AS listed, step_key LIKE 'step1_' AS wrong, * FROM lineage WHERE tier = 'TIER1'"


@query(
    f"""WITH r AS ({_DOCS}), d AS (SELECT DISTINCT document, listed, wrong FROM r), f AS (
SELECT document, 'WARN' AS level, 'missing collection' AS finding FROM d, (SELECT unnest(range(6))) UNION ALL SELECT document, 'WARN', 'missing collection' FROM d WHERE NOT listed UNION ALL SELECT document, 'FAIL', 'invalid collection' FROM d WHERE wrong
UNION ALL SELECT document, 'FAIL', 'missing required field' FROM r WHERE transformation_type = 'R'
UNION ALL SELECT document, 'FAIL', 'undeclared step' FROM r WHERE expression = 'O' UNION ALL SELECT document, 'WARN', 'attribute sentinel' FROM r WHERE listed AND target_key = 'NOT APPLICABLE'
UNION ALL SELECT document, 'FAIL', 'undeclared attribute' FROM r WHERE listed AND target_key <> 'NOT APPLICABLE')
SELECT document, level, finding, count(*) AS n FROM f GROUP BY 1, 2, 3"""
)
def val7_documents(d):
    """Documents of a step: some list no attributes, some have a name in place of their datasets, records lack fields and name steps
    that are not declared."""
    edge = """to_json(named_struct('sourceAttributeNaturalKey', source_key, 'sourceDatasetNaturalKey', substring_index(source_key, '|', 1), 'targetAttributeNaturalKey', target_key,
    'targetDatasetNaturalKey', if(transformation_type = 'R', null, 't'), 'stepNaturalKey', if(expression = 'O', 'ghost', step_key)))"""
    rows = d.lineage.where("tier = 'TIER1'").withColumn("table", F.length(F.substring_index("source_key", "|", 1))).withColumn("file", F.concat_ws(" ", "step_key", "table"))
    attributes = rows.where("table % 2 = 0").select("file", "source_key").distinct()
    lines = rows.select("file", F.lit(1).alias("k"), F.expr(edge).alias("line")).unionByName(attributes.select("file", F.lit(3).alias("k"), F.expr("to_json(named_struct('attributeNaturalKey', source_key))").alias("line")))
    files = rows.select("file", "step_key", "table").distinct()
    wrong = F.when(F.col("step_key").like("step1_"), F.lit('"none"')).otherwise(F.lit("[]"))
    steps = F.concat(F.lit('],"steps":['), F.to_json(F.struct(F.col("step_key").alias("stepNaturalKey"))), F.when(F.col("table") % 2 == 0, F.lit('],"attributes":[')).otherwise(F.lit("")))
    frame = {0: F.concat(F.lit('{"datasets": '), wrong, F.lit(',"tier1QueryBlockAttributeLineage":[')), 2: steps, 4: F.lit("]}")}
    path = _document_files(_lines(lines, files, frame), f"{_folder(d.spark)}/documents", "document")
    found = contract.document_findings(contract.documents(d.spark, path))
    return found.groupBy(F.url_decode(F.regexp_extract("path", "document=([^/]*)/", 1)).alias("document"), "level", "finding").agg(F.count("*").alias("n"))


@query("SELECT 'FAIL' AS status, count(*) AS findings FROM (SELECT ds FROM (" + _DATA.replace("{part}", "part") + ") GROUP BY ds HAVING count(*) > 1) HAVING count(*) > 0 UNION ALL SELECT 'PASS', 0 WHERE NOT EXISTS (SELECT 1 FROM (" + _DATA.replace("{part}", "part") + ") GROUP BY ds HAVING count(*) > 1)")
def val7_contract_status(d):
    _, datasets, attributes, edges = _payload(d)
    findings = quality.lineage_contract(datasets, attributes, edges.select(F.lit("s").alias("stepNaturalKey")).distinct(), edges.withColumn("stepNaturalKey", F.lit("s")))
    return quality.contract_status(findings.where("finding = 'duplicate dataset'"))


@query("WITH r AS (SELECT l_orderkey % 50 AS file, l_partkey * 10 + l_linenumber AS pos, 16 + CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE 0 END AS n FROM lineitem), f AS (SELECT file, arg_min(n, pos) AS expected, count(*) AS n FROM (SELECT file, pos, min(n) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT f.file, expected, f.n, (SELECT min(pos) FROM (SELECT file, pos, min(n) AS n FROM r GROUP BY 1, 2) q WHERE q.file = f.file AND pos < 1000 AND q.n <> expected) AS first_drift FROM f")
def val8_arity_profile(d):
    records = d.lineitem.select((F.col("l_orderkey") % 50).alias("file"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), F.expr("16 + CASE WHEN l_suppkey % 40 = 0 THEN 1 ELSE 0 END").alias("n_fields")).groupBy("file", "pos").agg(F.min("n_fields").alias("n_fields"))
    return quality.arity_profile(records)


@query("SELECT 'tables' AS \"check\", count(*) AS n, count(*) >= 100 AS passed FROM tabs UNION ALL SELECT 'changes', count(*), count(*) >= 1000000 FROM chg")
def val9_health_checks(d):
    return quality.health_checks(tables=(d.tabs, 100), changes=(d.chg, 1000000))


@query("SELECT team.*, coalesce(people, 0) AS people, coalesce(apps, 0) AS apps FROM team LEFT JOIN (SELECT team_id, count(*) AS people FROM person GROUP BY 1) USING (team_id) LEFT JOIN (SELECT owner_team_id AS team_id, count(*) AS apps FROM app GROUP BY 1) USING (team_id)")
def agg17_teams_overview(d):
    return org.teams_overview(d.team, d.person, d.app)


@query("SELECT app.*, coalesce(tables, 0) AS tables, coalesce(schemas, 0) AS schemas FROM app LEFT JOIN (SELECT app_id, count(DISTINCT mapping_id) AS tables FROM table_app GROUP BY 1) USING (app_id) LEFT JOIN (SELECT app_id, count(DISTINCT mapping_id) AS schemas FROM schema_app GROUP BY 1) USING (app_id)")
def agg17_apps_overview(d):
    return org.apps_overview(d.app, d.table_app, d.schema_app)


@query(f"SELECT team, CAST(sum(query_count) AS BIGINT) AS total_queries, count(DISTINCT username) AS users FROM {_TEAMS} GROUP BY 1 ORDER BY total_queries DESC, team LIMIT 5")
def agg26_top_teams(d):
    return org.top_teams(d.usage, d.person, d.team)


@query(
    """WITH u AS (SELECT object_name, sum(query_count)::BIGINT AS q FROM usage GROUP BY 1), t AS (SELECT DISTINCT object_name, app_id FROM table_app), s AS (SELECT DISTINCT schema_name, app_id FROM schema_app),
m AS (SELECT q, t.app_id FROM u JOIN t USING (object_name) UNION ALL SELECT q, s.app_id FROM u JOIN s ON s.schema_name = split_part(u.object_name, '.', 1) WHERE u.object_name NOT IN (SELECT object_name FROM t))
SELECT application, CAST(sum(q) AS BIGINT) AS total_queries FROM m JOIN app USING (app_id) GROUP BY 1 ORDER BY total_queries DESC, application LIMIT 5"""
)
def agg26_top_applications(d):
    return org.top_applications(d.usage, d.table_app, d.schema_app, d.app)


def _extracts(d):
    """Extract rows as read from the flat files: tables listed twice, columns of unknown tables."""
    ts = F.expr("cast('2024-01-01' as timestamp_ntz)")
    tables = d.part.select(F.col("p_brand").alias("database_name"), F.expr("'T' || (p_partkey % 100)").alias("table_name"), F.expr("element_at(array('T', 'V', 'M', 'zz'), cast(p_size % 4 + 1 as int))").alias("table_kind"), F.when(F.col("p_partkey") % 3 == 0, ts).alias("last_alter_timestamp"))
    columns = d.part.select(
        F.col("p_brand").alias("database_name"), F.expr("'T' || (p_partkey % 110)").alias("table_name"), F.expr("'C' || p_partkey").alias("column_name"), F.expr("nullif(p_partkey % 5, 0)").alias("column_id"),
        F.expr("element_at(array('CV', 'D', 'TS', 'SZ', 'PS', 'XX', 'I', ''), cast(p_size % 8 + 1 as int))").alias("column_type"), F.expr("nullif(cast(p_size as bigint), 3)").alias("column_length"), F.expr("nullif(cast(p_size as bigint), 9)").alias("decimal_total_digits"), F.lit(2).cast("bigint").alias("decimal_fractional_digits"), F.expr("if(p_partkey % 2 = 0, 'N', 'Y')").alias("nullable"),
    )
    return d.part.select(F.col("p_brand").alias("database_name")), tables, columns


_COLS_SQL = """WITH t AS (SELECT DISTINCT p_brand AS s, 'T' || (p_partkey % 100) AS t FROM part), c AS (SELECT p_brand AS s, 'T' || (p_partkey % 110) AS t, 'C' || p_partkey AS column_name, p_size AS z, coalesce(nullif(p_partkey % 5, 0), 0) AS ordinal_position, p_partkey % 2 = 1 AS nullable FROM part)
SELECT s AS schema_name, t AS table_name, column_name, nullable, ordinal_position, CASE z % 8 WHEN 0 THEN 'VARCHAR' || CASE WHEN z = 3 THEN '' ELSE '(' || z || ')' END WHEN 1 THEN CASE WHEN z = 9 THEN 'DECIMAL' ELSE 'DECIMAL(' || z || ',2)' END WHEN 2 THEN 'TIMESTAMP(' || z || ')' WHEN 3 THEN CASE WHEN z = 3 THEN 'TIMESTAMP WITH TIME ZONE' ELSE 'TIMESTAMP(' || z || ') WITH TIME ZONE' END
WHEN 4 THEN 'PERIOD(TIMESTAMP(' || z || '))' WHEN 5 THEN 'UNKNOWN(XX)' WHEN 6 THEN 'INTEGER' ELSE 'UNKNOWN(?)' END AS data_type FROM c SEMI JOIN t USING (s, t)"""


@query(_COLS_SQL)
def ing1_build_snapshot(d):
    return ingest.build_snapshot(1, *_extracts(d))["columns"].drop("snapshot_id")


@query("SELECT 'tables' AS kind, count(*) AS seen, count(DISTINCT (p_brand, p_partkey % 100)) AS created FROM part UNION ALL SELECT 'columns', count(*), count(*) FILTER (WHERE (p_brand, p_partkey % 110) IN (SELECT (p_brand, p_partkey % 100) FROM part)) FROM part")
def ing1_counts(d):
    return ingest.build_snapshot(1, *_extracts(d))["counts"]


@query(
    """WITH t AS (SELECT p_brand AS schema_name, 'T' || (p_partkey % 100) AS table_name, p_partkey AS pos, p_size % 4 AS kind, p_partkey % 3 = 0 AS stamped FROM part)
SELECT schema_name, table_name, CASE arg_min(kind, CASE WHEN stamped THEN pos ELSE 1000000000 + pos END) WHEN 0 THEN 'VIEW' WHEN 1 THEN 'TABLE' WHEN 2 THEN 'MACRO' ELSE 'UNKNOWN' END AS object_type FROM t GROUP BY 1, 2"""
)
def ing1_first_of_ties(d):
    """Tables listed several times, read from files: of equal times the first one in its file counts."""
    record = _fixed16("p_brand", "concat('T', p_partkey % 100)", "element_at(array('V', 'T', 'M', 'zz'), cast(p_size % 4 + 1 as int))", "''", "''", "''", "if(p_partkey % 3 = 0, '2024-01-01 00:00:00', '')", "if(p_size % 3 = 0, 'two\nlines', '')")
    path = _written(d.part.repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey"), record, _folder(d.spark), "tables")
    tables = readers.read_view(d.spark, path, "tables", position=True)
    none = readers.read_view(d.spark, [], "columns")
    return ingest.build_snapshot(1, readers.read_view(d.spark, [], "databases"), tables, none)["tables"].select("schema_name", "table_name", "object_type")


def _more_extracts(d):
    """Indices, partitioning and DDL fragments, some of them of unknown tables."""
    own = (F.col("p_brand").alias("database_name"), F.expr("'T' || (p_partkey % 120)").alias("table_name"))
    indices = d.part.select(*own, F.expr("'I' || p_partkey").alias("index_name"), F.col("p_size").cast("bigint").alias("index_number"), F.lit("P").alias("index_type"), F.lit("Y").alias("unique_flag"), F.expr("'C' || p_partkey").alias("column_name"), F.lit(1).cast("bigint").alias("column_position"))
    partitioning = d.part.where("p_size % 5 = 0").select(*own, F.lit("Q").alias("constraint_type"), F.concat(F.lit("RANGE_N("), "p_name", F.lit(")")).alias("constraint_text"))
    texts = d.part.select(*own, F.expr("nullif(p_partkey, 7)").alias("request_text_seq"), F.concat("p_name", F.lit(";")).alias("request_text"))
    return indices, partitioning, texts


_MORE = """t AS (SELECT DISTINCT p_brand AS s, 'T' || (p_partkey % 100) AS t FROM part), x AS (SELECT p_brand AS s, 'T' || (p_partkey % 120) AS t, * FROM part)"""


@query(
    f"""WITH {_MORE} SELECT 'indices' AS kind, s AS schema_name, t AS table_name, 'I' || p_partkey AS item, CAST(p_size AS BIGINT) AS n FROM x SEMI JOIN t USING (s, t)
UNION ALL SELECT 'partitioning', s, t, 'RANGE_N(' || p_name || ')', 1 FROM x SEMI JOIN t USING (s, t) WHERE p_size % 5 = 0
UNION ALL SELECT 'ddl', s, t, string_agg(p_name || ';', '' ORDER BY coalesce(nullif(p_partkey, 7), 0), p_name), count(*) FROM x SEMI JOIN t USING (s, t) GROUP BY ALL"""
)
def ing1_details(d):
    made = ingest.build_snapshot(1, *_extracts(d), *_more_extracts(d))
    row = lambda kind, item, n: made[kind].select(F.lit(kind).alias("kind"), "schema_name", "table_name", F.col(item).alias("item"), n.cast("long").alias("n"))
    return row("indices", "index_name", F.col("index_number")).unionByName(row("partitioning", "constraint_text", F.lit(1))).unionByName(row("ddl", "ddl", F.col("fragments")))


def _lineage_payload(d):
    ds = d.lineitem.select(F.expr("'Q' || (l_suppkey % 40) || '.B'").alias("datasetNaturalKey")).union(d.lineitem.select(F.expr("'P' || (l_partkey % 50) || '.A'"))).distinct().withColumns({"containerNaturalKey": F.lit("c"), "datasetType": F.lit(" table")})
    attributes = ds.select("datasetNaturalKey", "containerNaturalKey", F.concat("datasetNaturalKey", F.lit("|c1")).alias("attributeNaturalKey"), F.lit("string").alias("dataType"), F.lit(True).alias("nullable"), F.lit(None).cast("long").alias("ordinalPosition"), F.lit(None).cast("string").alias("attributeClass"))
    edges = d.lineage.select(F.col("source_key").alias("sourceAttributeNaturalKey"), F.col("target_key").alias("targetAttributeNaturalKey"), "tier", F.col("transformation_type").alias("transformationType"), "expression", F.col("step_key").alias("stepNaturalKey"))
    tier3 = d.lineage.select(F.expr("if(tier = 'TIER1', substring_index(source_key, '|', 1), concat('UNKNOWN.', substring_index(source_key, '|', 1)))").alias("sourceDatasetNaturalKey"), F.substring_index("target_key", "|", 1).alias("targetDatasetNaturalKey"), F.col("step_key").alias("stepNaturalKey"))
    processes = d.lineage.select(F.concat(F.lit("p"), F.substring("step_key", 5, 1)).alias("processNaturalKey"), F.lit("SQL").alias("processType"), F.lit("g").alias("processGroupNaturalKey")).distinct()
    steps = d.lineage.select(F.col("step_key").alias("stepNaturalKey"), F.concat(F.lit("p"), F.right("step_key", F.lit(1))).alias("processNaturalKey"), F.lit("1").alias("stepLevel"), F.lit("INSERT").alias("stepType"), F.lit(None).cast("string").alias("parentStepNaturalKey")).distinct()
    return {"containers": ds.select("containerNaturalKey").distinct(), "datasets": ds, "attributes": attributes, "attribute_edges": edges, "tier3DatasetLineage": tier3, "processes": processes, "steps": steps}


_PAYLOAD = """ds AS (SELECT DISTINCT 'Q' || (l_suppkey % 40) || '.B' AS k FROM lineitem UNION SELECT 'P' || (l_partkey % 50) || '.A' FROM lineitem), old AS (SELECT * FROM ds WHERE k < 'P3'),
told AS (SELECT DISTINCT CASE WHEN tier = 'TIER1' THEN split_part(source_key, '|', 1) ELSE 'UNKNOWN.' || split_part(source_key, '|', 1) END AS s, split_part(target_key, '|', 1) AS t, step_key FROM lineage),
st AS (SELECT DISTINCT step_key, 'p' || right(step_key, 1) AS p FROM lineage), pr AS (SELECT DISTINCT 'p' || substr(step_key, 5, 1) AS p FROM lineage)"""


@query(
    f"""WITH {_PAYLOAD} SELECT 'table' AS kind, k AS a, '' AS b FROM ds ANTI JOIN old USING (k) UNION ALL SELECT 'node', upper(k), '' FROM ds ANTI JOIN old USING (k) UNION ALL SELECT 'edge', s, t FROM (SELECT DISTINCT s, t FROM told) WHERE s IN (FROM ds) AND t IN (FROM ds)
UNION ALL SELECT 'process', p, '' FROM pr UNION ALL SELECT 'step', step_key, p FROM st SEMI JOIN pr USING (p) UNION ALL SELECT 'lost edges', CAST(count(*) AS VARCHAR), '' FROM told WHERE s NOT IN (FROM ds) OR t NOT IN (FROM ds) UNION ALL SELECT 'lost steps', CAST(count(*) AS VARCHAR), '' FROM st ANTI JOIN pr USING (p)"""
)
def ing2_ingest_lineage(d):
    """A payload attached to a snapshot that has some of its tables already."""
    frames = _lineage_payload(d)
    frames["tier3DatasetLineage"] = frames["tier3DatasetLineage"].distinct()
    old = frames["datasets"].where("datasetNaturalKey < 'P3'").select(F.substring_index("datasetNaturalKey", ".", 1).alias("schema_name"), F.substring_index("datasetNaturalKey", ".", -1).alias("table_name"))
    made = ingest.ingest_lineage(frames, 9, attach_to=old)
    row = lambda kind, df, a, b=None: df.select(F.lit(kind).alias("kind"), a.alias("a"), (F.lit("") if b is None else F.col(b)).alias("b"))
    lost = made["orphans"].select(F.when(F.col("kind") == "steps", "lost steps").otherwise("lost edges").alias("kind"), F.col("n").cast("string").alias("a"), F.lit("").alias("b"))
    parts = [row("table", made["tables"], F.concat_ws(".", "schema_name", "table_name")), row("node", made["nodes"], F.col("object_name")), row("edge", made["edges"], F.col("src_name"), "dst_name"), row("process", made["processes"], F.col("process_key")), row("step", made["steps"], F.col("step_key"), "process_key")]
    for part in parts:
        lost = lost.unionByName(part)
    return lost


_REPAIR = "n AS (SELECT upper(split_part(k, '.', 2)) AS bare, min(k) AS full_name FROM ds GROUP BY 1 HAVING count(*) = 1)"


@query(
    f"""WITH ds AS (SELECT DISTINCT 'Q' || (l_suppkey % 40) || '.B' || (l_suppkey % 40) AS k FROM lineitem), {_REPAIR}, told AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'UNKNOWN.B' || (l_suppkey % 40) ELSE 'Q' || (l_suppkey % 40) || '.B' || (l_suppkey % 40) END AS s, 'Q' || (l_partkey % 40) || '.B' || (l_partkey % 40) AS t FROM lineitem),
r AS (SELECT DISTINCT coalesce(full_name, s) AS s, t FROM told LEFT JOIN n ON s LIKE 'UNKNOWN.%' AND bare = upper(split_part(s, '.', 2)))
SELECT s AS src_name, t AS dst_name FROM r WHERE s <> t AND s IN (FROM ds) AND t IN (FROM ds)"""
)
def ing2_repaired_edges(d):
    """Ends that are UNKNOWN.<name> get the one name they can stand for."""
    key = lambda c: F.expr(f"'Q' || ({c} % 40) || '.B' || ({c} % 40)")
    frames = _lineage_payload(d)
    ds = d.lineitem.select(key("l_suppkey").alias("datasetNaturalKey")).distinct()
    frames["datasets"] = ds.withColumns({"containerNaturalKey": F.lit("c"), "datasetType": F.lit("table")})
    frames["tier3DatasetLineage"] = d.lineitem.select(F.when(F.col("l_linenumber") == 1, F.expr("'UNKNOWN.B' || (l_suppkey % 40)")).otherwise(key("l_suppkey")).alias("sourceDatasetNaturalKey"), key("l_partkey").alias("targetDatasetNaturalKey"), F.lit("s").alias("stepNaturalKey")).distinct()
    return ingest.ingest_lineage(frames, 9, names=ds.select(F.col("datasetNaturalKey").alias("object_name")))["edges"].select("src_name", "dst_name")


@query("SELECT 'object' AS mode, schema_name, table_name FROM tabs WHERE snapshot_id = 1 AND (schema_name < 'Brand#3' OR table_name LIKE 'T1%') OR (snapshot_id = 2 AND (schema_name, table_name) NOT IN (SELECT (schema_name, table_name) FROM tabs WHERE snapshot_id = 1 AND (schema_name < 'Brand#3' OR table_name LIKE 'T1%')))")
def ing3_incremental_backfill(d):
    new = d.tabs.where("snapshot_id = 1 and (schema_name < 'Brand#3' or table_name like 'T1%')").select("schema_name", "table_name")
    return ingest.incremental_backfill(new, d.tabs.where("snapshot_id = 2")).withColumn("mode", F.lit("object"))


@query("SELECT schema_name, table_name FROM tabs WHERE snapshot_id = 1 AND schema_name < 'Brand#3' UNION ALL SELECT schema_name, table_name FROM tabs WHERE snapshot_id = 2 AND schema_name NOT IN (SELECT schema_name FROM tabs WHERE snapshot_id = 1 AND schema_name < 'Brand#3')")
def ing3_backfill_schemas(d):
    return ingest.incremental_backfill(d.tabs.where("snapshot_id = 1 and schema_name < 'Brand#3'").select("schema_name", "table_name"), d.tabs.where("snapshot_id = 2"), "schema")


@query(
    """WITH t AS (SELECT * FROM tabs WHERE snapshot_id = 3), cum AS (SELECT count(*) AS n FROM (SELECT DISTINCT schema_name, table_name FROM tabs WHERE snapshot_id BETWEEN 2 AND 3))
SELECT 'schemas' AS what, count(DISTINCT schema_name) AS n FROM t UNION ALL SELECT 'views', count(*) FROM t WHERE object_type = 'VIEW' UNION ALL SELECT 'columns', count(*) FROM cols WHERE snapshot_id = 3
UNION ALL SELECT 'nodes', (SELECT count(DISTINCT upper(schema_name || '.' || table_name)) FROM t) + (SELECT count(DISTINCT upper(schema_name)) FROM t)
UNION ALL SELECT 'duplicates', count(*) FROM (SELECT 1 FROM t GROUP BY schema_name, table_name HAVING count(*) > 1)"""
)
def ing4_post_ingest(d):
    done = ingest.post_ingest(d.tabs, d.cols, d.snap.withColumn("is_baseline", F.col("snapshot_id") == 2), 2, 3)
    m = done["metrics"].select(F.expr("stack(3, 'schemas', schemas, 'views', views, 'columns', columns) as (what, n)"))
    nodes = done["nodes"].agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n")
    twice = done["validation"].where("issue = 'DUPLICATE_TABLE'").agg(F.count("*").alias("n")).select(F.lit("duplicates").alias("what"), "n")
    return m.unionByName(nodes).unionByName(twice)


@query(
    """WITH i AS (SELECT c_custkey % 500 AS k, c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS display_name, c_mktsegment AS team FROM customer), f AS (SELECT 'U' || k AS username, arg_min(display_name, pos) FILTER (WHERE display_name IS NOT NULL) AS display_name, arg_min(team, pos) AS team FROM i GROUP BY 1),
e AS (SELECT 'U' || s_suppkey AS username, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END AS display_name, NULL AS team FROM supplier)
SELECT coalesce(e.username, f.username) AS username, coalesce(e.display_name, f.display_name) AS display_name, coalesce(e.team, f.team) AS team FROM e FULL JOIN f ON e.username = f.username"""
)
def ing6_ingest_people(d):
    existing = d.supplier.select(F.expr("'u' || s_suppkey").alias("username"), F.expr("CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_name END").alias("display_name"), F.lit(None).cast("string").alias("team"))
    incoming = d.customer.select(F.expr("'u' || (c_custkey % 500)").alias("username"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END").alias("display_name"), F.col("c_mktsegment").alias("team"), F.col("c_custkey").alias("position"))
    return ingest.ingest_people(existing, incoming)


@query(
    """WITH i AS (SELECT 'A' || (c_custkey % 300) AS a, c_name AS ds, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 's' || (c_custkey % 11) END AS s, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 't' || (c_custkey % 70) END AS t, n_name AS o, c_custkey AS pos FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0 WHERE c_custkey % 13 <> 0),
f AS (SELECT a, arg_min({'ds': ds, 'o': o}, pos) AS x FROM i GROUP BY 1), e AS (SELECT 'A' || s_suppkey AS a, s_name AS ds, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'BRAZIL' END AS o FROM supplier)
SELECT 'application' AS kind, coalesce(e.a, f.a) AS a, CASE WHEN e.a IS NOT NULL THEN e.ds ELSE f.x.ds END AS b, coalesce(e.o, f.x.o) AS c FROM e FULL JOIN f USING (a)
UNION ALL SELECT DISTINCT 'schema', upper(s), a, NULL FROM i WHERE s IS NOT NULL UNION ALL SELECT DISTINCT 'table', upper(s), upper(t), a FROM i WHERE s IS NOT NULL AND t IS NOT NULL"""
)
def ing6_ingest_applications(d):
    existing = d.supplier.select(F.expr("'A' || s_suppkey").alias("application"), F.col("s_name").alias("description"), F.expr("if(s_suppkey % 2 = 0, null, 'BRAZIL')").alias("owner_team"))
    named = d.customer.join(F.broadcast(d.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    incoming = named.select(
        F.expr("if(c_custkey % 13 = 0, null, 'A' || (c_custkey % 300))").alias("application_name"), F.col("c_name").alias("description"), F.expr("if(c_custkey % 4 = 0, null, 's' || (c_custkey % 11))").alias("schema_name"),
        F.expr("if(c_custkey % 3 = 0, null, 't' || (c_custkey % 70))").alias("table_name"), F.col("n_name").alias("owner_team"), F.col("c_custkey").alias("position"),
    )
    made = ingest.ingest_applications(existing, incoming, d.team.where("team_id % 2 = 0"))
    none = F.lit(None).cast("string")
    out = made["applications"].select(F.lit("application").alias("kind"), F.col("application").alias("a"), F.col("description").alias("b"), F.col("owner_team").alias("c"))
    out = out.unionByName(made["schema_map"].select(F.lit("schema").alias("kind"), F.col("schema_name").alias("a"), F.col("application").alias("b"), none.alias("c")))
    return out.unionByName(made["table_map"].select(F.lit("table").alias("kind"), F.col("schema_name").alias("a"), F.col("table_name").alias("b"), F.col("application").alias("c")))


_REC = "SELECT schema_name AS database_name, split_part(object_name, '.', 2) AS table_name, CAST(NULL AS STRING) AS column_name, CASE event_id % 4 WHEN 0 THEN 'Tab' WHEN 1 THEN 'Viw' WHEN 2 THEN 'UDF' ELSE 'SP' END AS object_type, query_count, user_count AS distinct_user_count, CASE WHEN event_id % 13 = 0 THEN NULL ELSE last_accessed END AS last_accessed FROM {usage}"


@query(
    "WITH u AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' END AS t FROM usage WHERE event_id % 13 <> 0 AND event_id % 4 < 2) SELECT u.schema_name, split_part(u.object_name, '.', 2) AS object_name, t AS object_type, CAST(sum(query_count) AS BIGINT) AS total, count(*) AS n FROM u JOIN (SELECT object_name FROM node WHERE node_id % 4 <> 1) n ON n.object_name = u.object_name GROUP BY 1, 2, 3"
)
def ing7_ingest_usage(d):
    kept, _ = ingest.ingest_usage(d.spark.sql(_REC, usage=d.usage), d.node.where("node_id % 4 <> 1"))
    return kept.groupBy("schema_name", "object_name", "object_type").agg(F.sum("query_count").alias("total"), F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT DISTINCT 'S' || (s_suppkey % 12) || '.T' || s_suppkey AS name FROM supplier), l AS (SELECT DISTINCT k FROM (SELECT 'P' || (l_partkey % 50) || '.A' AS k FROM lineitem UNION SELECT 'Q' || (l_suppkey % 40) || '.B' FROM lineitem)),
e AS (SELECT DISTINCT 'P' || (l_partkey % 50) || '.A' AS s, 'Q' || (l_suppkey % 40) || '.B' AS t FROM lineitem)
SELECT 'tables' AS what, count(*) AS n FROM t UNION ALL SELECT 'queries', CAST(sum(query_count) AS BIGINT) FROM usage WHERE event_id % 4 <> 2 AND object_name IN (SELECT name FROM t) UNION ALL SELECT 'indices', count(*) FROM supplier UNION ALL SELECT 'lineage tables', count(*) FROM l
UNION ALL SELECT 'nodes', (SELECT count(*) FROM t) + (SELECT count(DISTINCT s_suppkey % 12) FROM supplier) + (SELECT count(*) FROM l) UNION ALL SELECT 'feeds', count(*) FROM e UNION ALL SELECT 'scored', (SELECT count(*) FROM t) + (SELECT count(DISTINCT s_suppkey % 12) FROM supplier) + (SELECT count(*) FROM l)"""
)
def ing8_unified_import(d):
    """A landing folder with catalog, usage and lineage files, each kind in several files."""
    folder = _folder(d.spark)
    own = ("concat('S', s_suppkey % 12)", "concat('T', s_suppkey)")
    _written(d.supplier, _fixed16(own[0], "''", "''", "'2024-01-01 00:00:00'"), folder, "a")
    _written(d.supplier.repartition(3), _fixed16(*own, "'T'"), folder, "b")
    _written(d.supplier, _fixed16(*own, "concat('C', s_suppkey)", "'1'", "'I'", "''", "''", "''", "'Y'"), folder, "c")
    _written(d.supplier, _fixed16(*own, "'ix'", "'1'", "'P'", "'Y'", "concat('C', s_suppkey)", "'1'"), folder, "i")
    _written(d.usage, _OBJECT_USAGE, folder, "e")
    for files, new in (("a", "databasesv_full"), ("b", "tablesv_full"), ("c", "columnsv_full"), ("i", "indicesv_full"), ("e", "pdcr_object_usage_1")):
        _rename(d.spark, f"{folder}/{files}", folder, new)
    keys = d.lineitem.select(F.expr("l_partkey % 50").alias("p"), F.expr("l_suppkey % 40").alias("q")).distinct()  # named only when they are few
    pairs = keys.select(F.expr("'P' || p || '.A'").alias("s"), F.expr("'Q' || q || '.B'").alias("t"))
    ends = pairs.select(F.col("s").alias("k")).union(pairs.select("t")).distinct()
    edge = F.collect_list(F.struct(F.col("s").alias("sourceDatasetNaturalKey"), F.col("t").alias("targetDatasetNaturalKey"), F.lit("s1").alias("stepNaturalKey"), F.lit("D").alias("impactType")))
    dataset = F.collect_list(F.struct(F.col("k").alias("datasetNaturalKey"), F.lit("c").alias("containerNaturalKey"), F.lit("table").alias("datasetType")))
    document = pairs.agg(edge.alias("tier3DatasetLineage")).join(F.broadcast(ends.agg(dataset.alias("datasets"))))  # at most 50 * 40 pairs
    head = {"parseRunId": F.lit("r"), "parseTimestamp": F.lit("t"), "platform": F.expr("named_struct('platformNaturalKey', 'p', 'technology', 't')"), "containers": F.expr("array(named_struct('containerNaturalKey', 'c'))")}
    document.withColumns(head).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{folder}/l")
    _rename(d.spark, f"{folder}/l", folder, "lineage", "json")
    made = ingest.unified_import(d.spark, folder, 1)
    one = lambda name, df: df.select(F.lit(name).alias("what"), F.col("n").cast("long").alias("n"))
    count = lambda name, df: one(name, df.agg(F.count("*").alias("n")))
    out = count("tables", made["tables"]).unionByName(one("queries", made["usage"].agg(F.sum("query_count").alias("n"))))
    for name, df in (("indices", made["indices"]), ("lineage tables", made["lineage_tables"]), ("nodes", made["nodes"]), ("feeds", made["edges"].where("relationship_type = 'FEEDS'")), ("scored", made["criticality"])):
        out = out.unionByName(count(name, df))
    return out


def _rename(spark: SparkSession, files: str, folder: str, name: str, kind: str = "dat") -> None:
    """Move the part files below `files` to folder/name_<k>.<kind>."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(files).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, status in enumerate(fs.globStatus(path(f"{files}/part-*"))):
        fs.rename(status.getPath(), path(f"{folder}/{name}_{k}.{kind}"))


@query(
    """WITH s AS (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 1 END AS snapshot_id FROM supplier)
SELECT snapshot_id, count(DISTINCT s_suppkey % 12) AS schemas, count(*) AS tables, count(*) AS columns, count(*) AS indices, count(*) AS partitioning, CAST(sum(length(s_name)) AS BIGINT) AS ddl FROM s GROUP BY 1"""
)
def str1_stream_landing(d):
    """Two landings, each of which becomes a snapshot with all its views; a third run finds nothing new, and a fourth a run that is stored already."""
    folder = _folder(d.spark)
    own = ("concat('S', s_suppkey % 12)", "concat('T', s_suppkey)")
    head = f"{_HEAD}, {', '.join(own)}"
    views = {
        "databases": _fixed16(own[0]), "tables": _fixed16(*own, "'T'"), "columns": _fixed16(*own, "'C'", "'1'", "'I'", "''", "''", "''", "'Y'"), "indices": _fixed16(*own, "'I'", "'1'", "'P'", "'Y'", "'C'", "'1'"),
        "partitioningconstraints": f"concat(concat_ws('§', {head}, 'Q', 'RANGE_N(a)', ''), 'ENDREC')", "tabletext": f"concat(concat_ws('§', {head}, 'T', '1', s_name), 'ENDREC')",
    }
    for k, rows in ((1, d.supplier.where("s_suppkey % 4 <> 0")), (2, d.supplier.where("s_suppkey % 4 = 0")), (3, None), (4, d.supplier)):
        if rows is not None:
            for name, record in views.items():
                _written(rows, record.replace("20240131T", f"2024013{min(k, 2)}T"), folder, f"{name}{k}")
                _rename_all(d.spark, f"{folder}/{name}{k}", f"{folder}/landing", f"{name}v_{k}")
        jobs.stream_snapshots(d.spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    per = lambda name, of=None: d.spark.read.parquet(f"{folder}/out/{name}").groupBy("snapshot_id").agg((F.count("*") if of is None else F.sum(of)).alias(name))
    out = per("schemas").join(per("tables"), "snapshot_id").join(per("columns"), "snapshot_id")
    return out.join(per("indices"), "snapshot_id").join(per("partitioning"), "snapshot_id").join(per("ddl", F.length("ddl")), "snapshot_id")


@query("SELECT CASE WHEN event_id % 4 = 2 THEN 'unmapped_type' WHEN node_id IS NULL OR event_id % 4 = 3 THEN 'orphan' ELSE 'inserted' END AS outcome, count(*) AS n FROM usage u LEFT JOIN (SELECT object_name, max(node_id) AS node_id FROM node WHERE node_id % 4 <> 1 GROUP BY 1) USING (object_name) GROUP BY 1")
def str2_stream_usage(d):
    folder = _folder(d.spark)
    _written(d.usage, _OBJECT_USAGE.replace("'', event_id", "'no column', event_id"), folder, "in")
    _rename_all(d.spark, f"{folder}/in", f"{folder}/landing")
    jobs.stream_usage(d.spark, f"{folder}/landing", d.node.where("node_id % 4 <> 1"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return d.spark.read.parquet(f"{folder}/out").groupBy("outcome").agg(F.count("*").alias("n"))


def _rename_all(spark: SparkSession, files: str, folder: str, name: str = "part") -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path(folder))
    _rename(spark, files, folder, name)


@query("SELECT conv_id AS query_id, CAST(sum(length(text)) AS BIGINT) AS length, count(*) AS fragments FROM (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
def str3_stream_query_log(d):
    """Fragments of all queries in two landings, odd turns first, and the first landing once more under other names."""
    folder = _folder(d.spark)
    record = "concat(concat_ws('§', 'td', '2024/05/12', '7', date_format(timestamp_seconds(1700000000 + conv_id), 'yyyy-MM-dd HH:mm:ss'), conv_id, turn, text, 'db', '', ''), 'ENDREC')"
    for k, own in enumerate(("turn % 2 = 1", "turn % 2 = 0", "turn % 2 = 1")):
        _written(d.conversations.where("text is not null").where(own).repartition("conv_id"), record, folder, f"in{k}")
        _rename_all(d.spark, f"{folder}/in{k}", f"{folder}/landing", f"log{k}")
        jobs.stream_query_log(d.spark, f"{folder}/landing", f"{folder}/out", f"{folder}/checkpoint", open_for="30 days").awaitTermination()
    return jobs.query_log(d.spark, f"{folder}/out").select("query_id", F.length("sql_text").cast("long").alias("length"), "fragments")


@query("SELECT p_partkey AS id, 'a§b' || p_size AS first, p_name AS second, 2 AS n FROM part")
def fn1_split_escaped(d):
    fields = exprs.split_escaped(F.expr("concat('a\\\\§b', p_size, '§', p_name)"))
    return d.part.select(F.col("p_partkey").alias("id"), F.get(fields, F.lit(0)).alias("first"), F.get(fields, F.lit(1)).alias("second"), F.size(fields).alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey * 1000 END AS v FROM part")
def fn2_parse_int_lenient(d):
    return d.part.select(F.col("p_partkey").alias("id"), exprs.parse_int_lenient(F.expr("if(p_size % 4 = 0, 'x1', concat(' ', format_number(p_partkey * 1000, 0)))")).alias("v"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS v FROM part")
def fn3_blank_to_null(d):
    return d.part.select(F.col("p_partkey").alias("id"), exprs.blank_to_null(F.expr("if(p_size % 3 = 0, '   ', concat(p_name, ' '))")).alias("v"))


@query("SELECT data_type, count(*) AS n FROM (" + _COLS_SQL.replace("FROM c SEMI JOIN t USING (s, t)", "FROM c") + ") GROUP BY 1")
def fn4_format_type(d):
    columns = _extracts(d)[2]
    return columns.select(exprs.format_type("column_type", "column_length", "decimal_total_digits", "decimal_fractional_digits").alias("data_type")).groupBy("data_type").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'VIEW' WHEN 2 THEN 'STORED_PROCEDURE' WHEN 3 THEN 'INDEX' ELSE 'UNKNOWN' END AS object_type FROM part")
def fn5_object_type_from_kind(d):
    return d.part.select(F.col("p_partkey").alias("id"), exprs.object_type_from_kind(F.expr("element_at(array('o', 'V ', 'P', 'X', '?'), cast(p_size % 5 + 1 as int))")).alias("object_type"))


@query("SELECT p_partkey AS id, p_size % 3 <> 1 AS nullable FROM part")
def fn6_is_nullable(d):
    return d.part.select(F.col("p_partkey").alias("id"), exprs.is_nullable(F.expr("element_at(array('y ', 'N', null), cast(p_size % 3 + 1 as int))")).alias("nullable"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ts, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def fn7_parse_times(d):
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss.SSSSSS') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 3 THEN date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") ELSE 'soon' END")
    day = F.expr("CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') WHEN 1 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE '' END")
    return d.orders.select(F.col("o_orderkey").alias("id"), F.date_format(exprs.parse_catalog_ts(text), "yyyy-MM-dd HH:mm:ss").alias("ts"), exprs.parse_log_date(day).cast("string").alias("day"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') END AS ts FROM orders")
def fn8_run_id_timestamp(d):
    run = F.expr("if(o_orderkey % 4 = 0, 'manual', concat(date_format(o_orderdate, 'yyyyMMdd'), 'T000000Z_x'))")
    return d.orders.select(F.col("o_orderkey").alias("id"), F.date_format(exprs.run_id_timestamp(run), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT change_id, split_part(object_identifier, '.', 1) AS schema_name, CASE WHEN object_type = 'COLUMN' THEN split_part(object_identifier, '.', 1) || '.' || split_part(object_identifier, '.', 2) ELSE object_identifier END AS parent FROM chg")
def fn9_ident_parts(d):
    return d.chg.select("change_id", exprs.schema_of("object_identifier").alias("schema_name"), exprs.parent_object("object_identifier", "object_type").alias("parent"))


@query("SELECT split_part(source_key, '|', 1) AS t, split_part(source_key, '|', 2) AS c, count(*) AS n FROM lineage GROUP BY 1, 2")
def fn10_column_key_parts(d):
    t, c = exprs.column_key_parts("source_key")
    return d.lineage.groupBy(t.alias("t"), c.alias("c")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'WIDGET' WHEN 2 THEN 'UNKNOWN' ELSE 'UDF' END AS t FROM part")
def fn11_map_dataset_type(d):
    return d.part.select(F.col("p_partkey").alias("id"), exprs.map_dataset_type(F.expr("element_at(array(' table', 'widget', null, 'udf'), cast(p_size % 4 + 1 as int))")).alias("t"))


@query("SELECT p_partkey AS id, p_size % 4 < 2 AS known FROM part")
def fn12_known_type(d):
    return d.part.select(F.col("p_partkey").alias("id"), exprs.known_type(F.expr("element_at(array('decimal(18,2)', 'VARCHAR(10) CHARACTER SET LATIN', 'widget', 'UNKNOWN(XX)'), cast(p_size % 4 + 1 as int))")).alias("known"))


@query("SELECT p_partkey AS id, round(least(1.0, greatest(0.0, (p_size - 10) / 20)), 4) AS clamped, round(p_size / greatest(p_partkey % 7, 1), 4) AS share FROM part")
def fn13_score_math(d):
    return d.part.select(F.col("p_partkey").alias("id"), F.round(exprs.clamp((F.col("p_size") - 10) / 20), 4).alias("clamped"), exprs.share("p_size", F.col("p_partkey") % 7).alias("share"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"a\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS merged FROM events WHERE props IS NOT NULL")
def fn14_json(d):
    k = exprs.json_field("props", "k", "long")
    return d.events.where("props is not null").select("event_id", k.alias("k"), exprs.state_json(a=F.col("event_type"), k=k).alias("merged"))


@query("SELECT o_orderkey AS id, strftime(CASE WHEN o_orderkey % 2 = 0 THEN DATE '2024-03-09' ELSE CAST(o_orderdate AS DATE) END, '%Y-%m-%d') AS day FROM orders")
def fn15_file_date(d):
    return d.orders.select(F.col("o_orderkey").alias("id"), exprs.file_date(F.expr("if(o_orderkey % 2 = 0, '/in/tables_20240309.dat', '/in/tables.dat')"), "o_orderdate").cast("string").alias("day"))
