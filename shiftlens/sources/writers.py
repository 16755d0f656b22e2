"""Writers that may run again without doing their work twice, a ledger of imported runs, exports, and removal of a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.operators.rollups import change_rollup
from shiftlens.sources.shared import cut

LEDGER = "run_ledger"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def partitions(spark: SparkSession, path: str, *keys: str) -> set[tuple[int, ...]]:
    """The partitions of a table by keys of whole numbers: a listing of its folders."""
    fs, place = _files(spark, "/".join([path, *(f"{k}=*" for k in keys)]))
    names = [str(f.getPath()).split("/")[-len(keys) :] for f in fs.globStatus(place) or []]
    return {tuple(int(x.split("=")[1]) for x in parts) for parts in names}


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _files(spark, path)
    fs.delete(place, True)


def _read(df: DataFrame, path: str) -> DataFrame | None:
    fs, place = _files(df.sparkSession, path)
    if not fs.exists(place):
        return None
    try:
        return df.sparkSession.read.parquet(path)
    except Exception as e:  # a folder without files
        if "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> bool:
    """Append the rows whose keys no stored row has; False if there were none. Keys of a batch are few next to its rows. The rows are computed once. Runs
    that append to one path must come one after the other; a run that fails while its files are committed has to be cleared by hand."""
    before = _read(df, path)
    if before is not None:
        df = df.join(before.select(keys).distinct(), keys, "left_anti")
    df = cut(df)
    if df.isEmpty():
        return False
    df.write.partitionBy(*partition_by).mode("append").parquet(path)
    return True


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """(source_system, extract_run_id, imported_at, snapshot_id): one line for each run that was stored whole."""
    schema = "source_system string, extract_run_id string, imported_at timestamp, snapshot_id long"
    if not partitions(spark, f"{root}/{LEDGER}", "snapshot_id"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{LEDGER}")


def clear_unfinished(spark: SparkSession, root: str, tables: list[str]) -> list[int]:
    """Remove the snapshots in these tables that have no line in the ledger: what runs that died have left. Their ids."""
    done, gone = partitions(spark, f"{root}/{LEDGER}", "snapshot_id"), set()
    for table in tables:
        for (snapshot,) in partitions(spark, f"{root}/{table}", "snapshot_id") - done:
            remove(spark, f"{root}/{table}/snapshot_id={snapshot}")
            gone.add(snapshot)
    return sorted(gone)


def persist_run(frames: dict[str, DataFrame], root: str, source_system: str, extract_run_id: str, force: bool = False) -> tuple[int, bool]:
    """Store a run's frames, each in the table of its name, as a snapshot with the next id; (id, True). A run that the ledger knows is not stored again
    and its frames are not computed: (its id, False), unless forced, which stores it once more under a new id.

    The ledger's line is written last. A run that dies before has no line; whoever comes next clears what it left, so it can be run again.
    Imports into one root come one after the other."""
    spark = next(iter(frames.values())).sparkSession
    clear_unfinished(spark, root, list(frames))
    if not force:
        known = ledger(spark, root).where((F.col("source_system") == source_system) & (F.col("extract_run_id") == extract_run_id)).agg(F.min("snapshot_id")).first()[0]
        if known is not None:
            return known, False
    snapshot = max([0, *(k for (k,) in partitions(spark, f"{root}/{LEDGER}", "snapshot_id"))]) + 1
    for name, df in frames.items():
        df.drop("snapshot_id").write.mode("overwrite").parquet(f"{root}/{name}/snapshot_id={snapshot}")
    line = spark.range(1).select(F.lit(source_system).alias("source_system"), F.lit(extract_run_id).alias("extract_run_id"), F.current_timestamp().alias("imported_at"))
    line.coalesce(1).write.mode("overwrite").parquet(f"{root}/{LEDGER}/snapshot_id={snapshot}")
    return snapshot, True


def _write_pairs(df: DataFrame, path: str) -> None:
    """Changes by pair of snapshots: each pair in df replaces what is stored of it, so that writing it again changes nothing."""
    df.write.partitionBy("snapshot_from", "snapshot_to").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_changes(df: DataFrame, root: str) -> bool:
    """Changes of a pair of snapshots are stored once; False if all pairs of df are stored already."""
    path, spark = f"{root}/change_event", df.sparkSession
    before = partitions(spark, path, "snapshot_from", "snapshot_to")
    if before:
        stored = spark.createDataFrame(sorted(before), "snapshot_from long, snapshot_to long")
        df = df.join(stored, ["snapshot_from", "snapshot_to"], "left_anti").select(df.columns)
    _write_pairs(df, path)
    roll_up(spark, root)
    return len(partitions(spark, path, "snapshot_from", "snapshot_to")) > len(before)


def roll_up(spark: SparkSession, root: str) -> None:
    """Keep the table change_rollup up to date: the stored changes of pairs that it lacks are summed by object, those of others are not read. Changes that name
    no objects have no rollup."""
    missing = partitions(spark, f"{root}/change_event", "snapshot_from", "snapshot_to") - partitions(spark, f"{root}/change_rollup", "snapshot_from", "snapshot_to")
    if missing:
        paths = [f"{root}/change_event/snapshot_from={a}/snapshot_to={b}" for a, b in sorted(missing)]
        changes = spark.read.option("basePath", f"{root}/change_event").parquet(*paths)
        if {"object_identifier", "object_type"} <= set(changes.columns):
            _write_pairs(change_rollup(changes), f"{root}/change_rollup")


def changes_between(spark: SparkSession, root: str, snapshot_from: int, snapshot_to: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The stored changes of a pair. make() gives them where there are none yet, and isn't called otherwise; a pair without changes stores nothing."""
    path, own = f"{root}/change_event", (F.col("snapshot_from") == snapshot_from) & (F.col("snapshot_to") == snapshot_to)
    here = (snapshot_from, snapshot_to) in partitions(spark, path, "snapshot_from", "snapshot_to")
    if not here:
        made = make().where(own)
        _write_pairs(made, path)
        roll_up(spark, root)
        if (snapshot_from, snapshot_to) not in partitions(spark, path, "snapshot_from", "snapshot_to"):
            return spark.createDataFrame([], made.schema)
    return spark.read.parquet(path).where(own)


def impact_events(paths: DataFrame) -> DataFrame:
    """DIRECT for depth 1, INDIRECT beyond; a depth below 1 is an error."""
    kind = F.when(F.col("depth") == 1, "DIRECT").when(F.col("depth") > 1, "INDIRECT").otherwise(F.raise_error(F.lit("an impact needs a depth of 1 or more")).cast("string"))
    return paths.withColumn("impact_type", kind)


def write_impacts(paths: DataFrame, root: str) -> bool:
    return append_new(impact_events(paths), f"{root}/impact_event", ["change_id", "snapshot_id"], ["snapshot_id"])


def write_usage(df: DataFrame, root: str, snapshot_id: int) -> int:
    """Store a snapshot's usage, or none of it if there is some already; how many rows were skipped as duplicates."""
    before = _read(df, f"{root}/usage_event")
    if before is not None and before.where(F.col("snapshot_id") == snapshot_id).limit(1).count():
        return df.count()
    df.withColumn("snapshot_id", F.lit(snapshot_id).cast("long")).write.partitionBy("snapshot_id").mode("append").parquet(f"{root}/usage_event")
    return 0


_EXPORTS = {
    "changes": ["change_id", "object_identifier", "change_type", "severity", "is_breaking"],
    "impact": ["change_id", "direct", "indirect", "score", "max_depth"],
    "usage": ["object_name", "object_type", "total_queries", "max_users"],
    "criticality": ["object_name", "usage_score", "graph_score", "combined", "level"],
}


def export_rows(df: DataFrame, kind: str) -> DataFrame:
    """Fixed columns as text: YES and NO for flags, two decimals for scores."""
    types = dict(df.dtypes)

    def text(c: str):
        if types[c] == "boolean":
            return F.when(F.col(c), "YES").otherwise("NO").alias(c)
        if types[c] in ("double", "float"):
            return F.format_string("%.2f", F.round(c, 2)).alias(c)
        return F.col(c).cast("string").alias(c)

    return df.select(*(text(c) for c in _EXPORTS[kind]))


def export_csv(df: DataFrame, path: str, kind: str) -> None:
    export_rows(df, kind).write.option("header", True).mode("overwrite").csv(path)


def delete_snapshot(spark: SparkSession, root: str, tables: list[str], snapshot_id: int, confirm: int) -> dict[str, int]:
    """Remove the latest snapshot's partition of each table; the counts of what went. Only the latest may go, and its id must be said twice. Its line in
    the ledger goes first, so that an import clears what a removal that died has left."""
    if snapshot_id != confirm:
        raise ValueError("the confirmed id differs")
    latest = max((k for t in tables for (k,) in partitions(spark, f"{root}/{t}", "snapshot_id")), default=0)
    if snapshot_id != latest:
        raise ValueError(f"only the latest snapshot, {latest}, can be deleted")
    remove(spark, f"{root}/{LEDGER}/snapshot_id={snapshot_id}")
    gone = {}
    for t in tables:
        gone[t] = spark.read.parquet(f"{root}/{t}").where(F.col("snapshot_id") == snapshot_id).count()
        remove(spark, f"{root}/{t}/snapshot_id={snapshot_id}")
    return gone
