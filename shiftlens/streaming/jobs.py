"""Structured Streaming over landing folders: new files, usage rows, query-log fragments. All run to the end of what is there
(availableNow) and go on from their checkpoint the next time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shiftlens.functions.exprs import USAGE_TYPES, parse_int_lenient, parse_usage_ts, split_escaped
from shiftlens.operators import metrics
from shiftlens.plans import ingest
from shiftlens.sources import readers, writers
from shiftlens.sources.shared import Steps

_FRAGMENT = ["query_id", "collect_ts", "sql_row_no"]


def _records(spark: SparkSession, root: str, arity: int, glob: str = "*.dat") -> DataFrame:
    raw = spark.readStream.option("lineSep", "ENDREC").option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(root)
    return _split(raw, arity)


def _split(raw: DataFrame, arity: int) -> DataFrame:
    raw = raw.withColumn("value", F.regexp_replace("value", r"^[\r\n]+|[\r\n]+$", "")).where(F.trim("value") != "")
    return raw.withColumn("fields", split_escaped("value")).where(F.size("fields") == arity)


_FILES = "path string, modificationTime timestamp, length long, content binary"
_VIEWS = ("databases", "tables", "columns", "indices", "partitioning", "tabletext")


def stream_landing(spark: SparkSession, root: str, checkpoint: str, ingest: Callable[[DataFrame, int], None], glob: str = "*.dat") -> StreamingQuery:
    """Call ingest(files(path, modificationTime, length), batch_id) for files that are new since the last run; a file is handed over once. Files are
    listed, not read."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(ingest).start()


def stream_snapshots(spark: SparkSession, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Every batch of new catalog files becomes a snapshot in the tables schemas, tables, columns, indices, partitioning and ddl below `out`, and a line of
    its ledger. Files of a view that are not there give an empty table. A batch is left alone if none of its files is newer than the last import, or if the ledger
    knows its run; so one that is run again stores nothing twice. All tables of a batch must be of one run."""

    def ingest_batch(listed: DataFrame, batch: int) -> None:
        files = {r["path"]: r["modificationTime"] for r in listed.collect()}  # the new files of the landing folder
        last = writers.ledger(spark, out).agg(F.max("imported_at")).first()[0]
        if not files or (last is not None and max(files.values()) <= last):
            return
        prefix = {view: name for name, view in readers.PREFIXES.items()}
        view = lambda name, **more: readers.read_view(spark, [f for f in files if f.rsplit("/", 1)[-1].lower().startswith(prefix[name])], name, **more)
        tables = view("tables", position=True)
        runs = tables.select("source_system_name", "extract_run_id").distinct().limit(2).collect()
        if len(runs) != 1:
            raise ValueError(f"{len(runs)} runs in one batch of tables" if runs else "a batch without tables")
        made = ingest.build_snapshot(0, view("databases"), tables, *(view(name) for name in _VIEWS[2:]))
        made.pop("counts")
        writers.persist_run(made, out, *runs[0])

    return stream_landing(spark, root, checkpoint, ingest_batch)


def usage_events(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Usage records of 12 fields with their node and outcome; nodes are a static side."""
    at = lambda k: F.get("fields", F.lit(k))
    rows = records.select(at(1).alias("schema_name"), F.when(at(5) == "Col", at(3)).otherwise(at(2)).alias("object_name"), at(5).alias("object_type"), parse_int_lenient(at(9)).alias("query_count"), parse_int_lenient(at(10)).alias("user_count"), parse_usage_ts(at(11)).alias("last_accessed"))
    return metrics.usage_outcomes(metrics.resolve_usage(rows, nodes), USAGE_TYPES)


def stream_usage(spark: SparkSession, root: str, nodes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return usage_events(_records(spark, root, 12), nodes).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def query_fragments(records: DataFrame) -> DataFrame:
    at = lambda k: F.get("fields", F.lit(k))
    return records.select(parse_usage_ts(at(3)).cast("timestamp").alias("collect_ts"), parse_int_lenient(at(4)).alias("query_id"), parse_int_lenient(at(5)).alias("sql_row_no"), at(6).alias("sql_text"), at(7).alias("default_database")).where("collect_ts is not null and query_id is not null")


def reassembled(fragments: DataFrame) -> DataFrame:
    """One row a query; fragments are told apart already."""
    parts = F.array_sort(F.collect_list(F.struct(F.col("sql_row_no").isNull().alias("x"), F.col("sql_row_no").alias("n"), F.col("sql_text").alias("t"))))
    return fragments.groupBy("query_id", "collect_ts").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("sql_text"), F.count("*").alias("fragments"))


def stream_query_log(spark: SparkSession, root: str, out: str, checkpoint: str, open_for: str = "10 minutes") -> StreamingQuery:
    """Put queries together from fragments, each counted once, and write them to out/queries as soon as they are older than the latest fragment by
    `open_for`. Those that may still grow stay as fragments in out/open, which every batch reads and writes anew: the landing folder is read once, and
    the table of open fragments is bounded by that time. Fragments of a query that is written already change nothing, also days later."""

    def merge(new: DataFrame, batch: int) -> None:
        before = _open_fragments(spark, out, batch)
        with Steps(spark) as step:
            both = step.stored((new if before is None else before.unionByName(new)).dropDuplicates(_FRAGMENT))
            first, last = both.agg(F.min("collect_ts"), F.max("collect_ts")).first()
            due = F.coalesce(F.col("collect_ts") < F.lit(last) - F.expr(f"interval {open_for}"), F.lit(False))
            closed = _written_queries(spark, out, batch)
            if closed is not None:
                both = both.join(closed.where(F.col("collect_ts").between(F.lit(first), F.lit(last))), ["query_id", "collect_ts"], "left_anti")
            reassembled(both.where(due)).write.mode("overwrite").parquet(f"{out}/queries/batch={batch}")
            both.where(~due).write.mode("overwrite").parquet(f"{out}/open/batch={batch}")
        for k in sorted(k for (k,) in writers.partitions(spark, f"{out}/open", "batch"))[:-2]:
            writers.remove(spark, f"{out}/open/batch={k}")

    return query_fragments(_records(spark, root, 10)).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def _open_fragments(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """The fragments that the last batch before `batch` left open."""
    done = [k for (k,) in writers.partitions(spark, f"{out}/open", "batch") if k < batch]
    return spark.read.parquet(f"{out}/open/batch={max(done)}") if done else None


def _written_queries(spark: SparkSession, out: str, batch: int) -> DataFrame | None:
    """The keys of queries that batches before `batch` wrote."""
    done = [f"{out}/queries/batch={k}" for (k,) in writers.partitions(spark, f"{out}/queries", "batch") if k < batch]
    return spark.read.parquet(*done).select("query_id", "collect_ts") if done else None


def query_log(spark: SparkSession, out: str) -> DataFrame:
    """All queries that stream_query_log has met: those it has written, and those still open, which may grow."""
    queries = spark.read.parquet(f"{out}/queries").drop("batch")
    left = _open_fragments(spark, out, 1 << 62)
    return queries if left is None else queries.unionByName(reassembled(left))
