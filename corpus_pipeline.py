"""A training corpus from documents: five stages, each written as Parquet and read again as the next one's documents.

1. quality: rejects what the quality classifier marks 0.
2. lines: takes boilerplate lines out of the texts.
3. near_duplicates: keeps one document of each group of near duplicates.
4. decontaminate: rejects documents that hold a window of a benchmark item.
5. mix: fits drawing rates to the target shares of the domains. Every document stays, with its fractional rate: how often it
   is to be drawn. The target shares hold for rate * n_tokens; copies is only the rate's nearest whole number, and meets no target.

Every stage works on all rows that the one before it kept; rows with null or empty text pass those stages that have
nothing to say of them. All stages but the last return the columns of documents.

Stages 3 and 4 decide by row, that is by doc_id and text. Rows with a null doc_id are judged like others. Of rows that are alike in doc_id and
text near_duplicates keeps one, unless they have no words; of rows that share a doc_id but not the text each stands for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.llm import boilerplate, decontaminate, mixing, near_duplicates, quality
from shiftlens.llm.stored import Steps, row_name, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weights = quality.fit(quality.training_rows(docs, _table(spark, sf_dir, "labels")))
    return quality.score(docs.select(COLUMNS), weights).where(F.col("score") >= quality.THRESHOLD).select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = boilerplate.remove_lines(docs.select(COLUMNS))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = [F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1")]
    named = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), *text)
    gone = near_duplicates.near_duplicates(docs, copies=False).where("not kept").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "h0", "h1").distinct()
    left = named.join(gone, ["_id", "_none", "h0", "h1"], "left_anti")
    # Rows that are alike stand for one document. Aggregation combines them in the map tasks; rows without words stay as they are.
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    once = left.where(worded).groupBy("_id", "_none", "h0", "h1").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return once.unionByName(left.where(~worded).select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hit = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")).where("contaminated").select("r0", "r1").distinct()
    return docs.select(*COLUMNS, *row_name("doc_id", "text")).join(hit, ["r0", "r1"], "left_anti").select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs.select(COLUMNS), mixing.label_domains(_table(spark, sf_dir, "labels")), mixing.TARGETS)
    return mixed.withColumn("copies", F.round("rate").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]

#: No stage but the line dedup and the decontamination can be said in SQL; the tests hold every stage against a plain version, and run() against the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus. What the stages before the last write is removed when the last has written its own."""
    docs = _table(spark, sf_dir, "documents")
    with Steps(spark) as step:
        for _, stage in STAGES[:-1]:
            docs = step.stored(stage(spark, docs, sf_dir))
        return stored(STAGES[-1][1](spark, docs, sf_dir))
