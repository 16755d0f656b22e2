"""Intermediate tables of the corpus operators, written where every executor can read them again, and names for rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftlens.sources.shared import Steps, shared_folder, stored

__all__ = ["Steps", "row_name", "shared_folder", "stored"]


def row_name(*columns: str) -> list[Column]:
    """r0, r1: the 128-bit name of a row by its doc_id and text. Equal rows share it, other rows that share a doc_id, or have none, don't."""
    return [F.xxhash64(*columns).alias("r0"), F.xxhash64(F.lit(1), *columns).alias("r1")]
