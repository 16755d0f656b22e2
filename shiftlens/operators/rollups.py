"""Changes summed by pair of snapshots and object, which the reports read instead of the changes themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.functions.exprs import parent_object, schema_of

KEY = ["snapshot_from", "snapshot_to", "schema_name", "object_name"]


def is_rollup(changes: DataFrame) -> bool:
    return "n_changes" in changes.columns


def sums(changes: DataFrame, *by: str, impacts: DataFrame | None = None) -> DataFrame:
    """n_changes, n_breaking and, with impacts(change_id, direct, indirect) or where a rollup has them, n_impacts by some of KEY, of changes or of their
    rollup. Columns count as their table."""
    if is_rollup(changes):
        return changes.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n_changes", "n_breaking", "n_impacts") if c in changes.columns))
    counts = {"n_changes": F.count("*"), "n_breaking": F.count_if("is_breaking") if "is_breaking" in changes.columns else F.lit(0).cast("long")}
    if impacts is not None:
        changes = changes.join(impacts.select("change_id", (F.col("direct") + F.col("indirect")).alias("_i")), "change_id", "left")
        counts["n_impacts"] = F.coalesce(F.sum("_i"), F.lit(0)).cast("long")
    names = {"schema_name": lambda: schema_of("object_identifier"), "object_name": lambda: parent_object("object_identifier", "object_type")}
    return changes.withColumns({c: names[c]() for c in by if c in names}).groupBy(*by).agg(*(of.alias(name) for name, of in counts.items()))


def change_rollup(changes: DataFrame, impacts: DataFrame | None = None) -> DataFrame:
    """One row for each object that changed between two snapshots."""
    return sums(changes, *KEY, impacts=impacts)
