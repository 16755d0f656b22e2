"""Line dedup by distinct-site spread, with DataFrame functions only.

A line is what stands between newlines, compared without spaces around it, by a name of 128 bits. Its spread is the number of distinct sites
(`source`) whose documents hold it. Lines that are blank are never boilerplate. HyperLogLog sketches of the sites are
built per line in each map task and merged by the aggregation; a line whose estimate is near the threshold gets an exact distinct count,
and lines spread over at least `min_sites` sites are removed everywhere.

Lists of lines are stored before documents are joined to them: their size is then known, Spark broadcasts them only below its own limit, and
beyond it both sides of the join are dealt by line, where a line that stands everywhere can be split.

Null text: no lines, text stays null. Null sources count as one site of their own. Repeated lines within a document or
site count once for the spread, and all of their copies are removed. Every row gives one row: rows are told apart by a hash of doc_id and text, and rows that are alike in
both lose the same lines. An empty table gives an empty result. Columns of other names are carried along; columns called n_lines or
n_removed_lines are replaced. A task holds one whole text and its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.stored import Steps, row_name, stored

MIN_SITES = 6
#: A sketch of 2**10 registers has a standard error of about 3 %; from half to twice the threshold counts are exact.
LG_REGISTERS = 10
NEAR = 2.0

_LINES = "split(coalesce(text, ''), '\n')"
_BARE = "trim(BOTH ' \t\r' FROM x)"
_NAME = f"named_struct('a', xxhash64({_BARE}), 'b', xxhash64(1, {_BARE}))"


def line_sites(docs: DataFrame) -> DataFrame:
    """(line, site): the name of every nonblank line with the site of its document, distinct within a document."""
    named = F.expr(f"array_distinct(transform(filter({_LINES}, x -> {_BARE} <> ''), x -> {_NAME}))")
    return docs.select(F.coalesce("source", F.lit("\0")).alias("site"), F.explode(named).alias("line"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites) of the lines spread over at least min_sites sites. Finding them runs jobs when called."""
    seen = line_sites(docs)
    with Steps(docs.sparkSession) as step:
        # Every map task merges its own sites of a line into one sketch, so a line that stands everywhere is dealt as one row a task.
        sketched = seen.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_REGISTERS))).alias("estimate"))
        likely = step.stored(sketched.where(F.col("estimate") >= min_sites / NEAR))
        near = step.stored(likely.where(F.col("estimate") <= min_sites * NEAR).select("line"))
        exact = seen.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites"))
        clear = likely.where(F.col("estimate") > min_sites * NEAR).select("line", F.col("estimate").alias("sites"))
        return stored(clear.unionByName(exact.where(F.col("sites") >= min_sites)))


def remove_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs with boilerplate lines taken out of `text`, and n_lines, n_removed_lines.
    The lines that are kept stay in order, unchanged; a text that loses every line becomes empty."""
    found = boilerplate(docs, min_sites).select("line")
    r0, r1 = row_name("doc_id", "text")
    held = docs.select(r0.alias("_r0"), r1.alias("_r1"), F.explode(F.expr(f"array_distinct(transform({_LINES}, x -> {_NAME}))")).alias("line"))
    # One list a row, no longer than its lines.
    marked = held.join(found, "line").groupBy("_r0", "_r1").agg(F.collect_set("line").alias("_drop"))
    keep = f"filter({_LINES}, x -> {_BARE} = '' OR NOT array_contains(_drop, {_NAME}))"
    kept = F.expr(f"CASE WHEN _drop IS NULL THEN text ELSE array_join({keep}, '\n') END")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.expr(_LINES)))
    n_kept = F.when(F.col("_drop").isNull(), n_lines).otherwise(F.size(F.expr(keep)))
    carried = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed_lines")]
    row = F.struct(F.lit(0).alias("_"), *(F.col(c).alias(f"_{c}") for c in carried)).alias("_row")  # whatever their names are
    joined = docs.select(row, "text", r0.alias("_r0"), r1.alias("_r1")).join(marked, ["_r0", "_r1"], "left")
    own = [F.col("_row").getField(f"_{c}").alias(c) for c in carried]
    return joined.select(*own, kept.alias("text"), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_removed_lines"))
