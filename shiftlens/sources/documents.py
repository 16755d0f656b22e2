"""JSON documents that are too large for one row, taken apart where their records end.

A file is read in pieces that end with a brace. Whether a piece begins within a text, and how deep, is told by the quotes and brackets before it: they are summed
within the file's sections, which are blocks cut after so many pieces, and each section starts from the sum of those before it. A record is what lies between two commas of an array in the document's
object. All but an array's first records are taken out, and a run of them leaves a mark, so that what remains is a small document
of the same form. A task sorts sections, some megabytes each; a row holds one record, or what a document has beside them.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftlens.sources.shared import stored

#: Bytes beyond which a file is not read as one row.
LARGE = 16 << 20
#: Pieces in a section, as a power of two: several windows of a task hold one at a time, and memory that they hold is not given back to each other.
_SECTION_BITS = 15
#: What stands in a document for a run of records: an object with the run, how many they are, and the rank of the first of them in the file.
RUN, COUNT, FIRST = "shiftlens_run", "shiftlens_count", "shiftlens_first"


class Apart(NamedTuple):
    """rest(file, marked, text): a document without its runs of records, with and without their marks; null if a record is no JSON or the file is cut off.
    records(file, run, rank, text): the records of the runs, by rank in the file."""

    rest: DataFrame
    records: DataFrame


def pieces(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """(value, file, block, n, size): pieces of text files, numbered in the order of each block."""
    raw = spark.read.options(**options).text(path)
    meta = lambda name: F.col(f"_metadata.{name}")
    return raw.where(meta("file_size") > LARGE).select("value", meta("file_path").alias("file"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), meta("file_size").alias("size"))


def any_large(spark: SparkSession, path: str | list[str]) -> bool:
    return not spark.read.format("binaryFile").load(path).where(F.col("length") > LARGE).select("length").isEmpty()


def _count(c: Column, signs: str) -> Column:
    counts = [F.octet_length(c) - F.octet_length(F.replace(c, F.lit(sign), F.lit(""))) for sign in signs]
    return sum(counts[1:], counts[0])


def _measured(raw: DataFrame) -> DataFrame:
    """raw with quotes, and how much deeper its end is than its begin if that is outside of texts (out) or inside (within)."""
    clean = raw.withColumn("_c", F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value")))
    clean = clean.withColumn("quotes", _count(F.col("_c"), '"'))

    net = lambda c: _count(c, "{[") - _count(c, "]")
    c, even = F.col("_c"), F.col("quotes") % 2 == 0
    first, last = F.substring_index(c, '"', 1), F.substring_index(c, '"', -1)
    # Most pieces have no brackets between their first and last quote; only in others all texts are taken out.
    ends = _count(c, "{[]") == _count(first, "{[]") + _count(last, "{[]")
    bare = lambda c: F.regexp_replace(c, '"[^"]*("|$)', "")
    out = F.when(F.col("quotes") == 0, net(c)).when(ends, net(first) + F.when(even, net(last)).otherwise(0)).otherwise(net(bare(c)))
    within = F.when(F.col("quotes") == 0, 0).when(ends, F.when(even, 0).otherwise(net(last))).otherwise(net(bare(F.concat(F.lit('"'), c))))
    return clean.withColumns({"out": out - F.when(even, 1).otherwise(0), "within": within - F.when(even, 0).otherwise(1)}).drop("_c")


def take_apart(spark: SparkSession, path: str | list[str]) -> Apart:
    """The files above LARGE bytes. Their pieces are stored when this is called, with their measures and again with their places."""
    raw = stored(_measured(pieces(spark, path, lineSep="}")))
    raw = raw.withColumn("section", F.shiftright("n", _SECTION_BITS))
    here = Window.partitionBy("file", "block", "section").orderBy("n")
    past, till = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("file").orderBy("block", "section").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    own = raw.withColumn("own", before("quotes", past) % 2)
    deeper = lambda odd: F.when(F.col("own") == odd, F.col("out")).otherwise(F.col("within"))
    sections = own.groupBy("file", "block", "section").agg(F.sum("quotes").alias("quotes"), F.sum(deeper(0)).alias("d0"), F.sum(deeper(1)).alias("d1"))
    sections = sections.withColumn("quoted", before("quotes", earlier) % 2).withColumn("d", F.when(F.col("quoted") == 0, F.col("d0")).otherwise(F.col("d1")))
    sections = sections.select("file", "block", "section", "quoted", before("d", earlier).alias("base"))
    at = own.join(sections, ["file", "block", "section"]).withColumn("state", (F.col("quoted") + F.col("own")) % 2).withColumn("d", F.when(F.col("state") == 0, F.col("out")).otherwise(F.col("within")))
    at = at.withColumn("depth", F.col("base") + before("d", past))
    at = at.withColumn("starts", (F.col("depth") <= 2) & (F.col("state") == 0))
    at = at.withColumn("ends", (F.col("depth") + F.col("d") <= 2) & ((F.col("state") + F.col("quotes")) % 2 == 0))
    at = at.withColumn("plain", F.col("starts") & (F.col("depth") == 2) & F.col("value").rlike(r"^\s*,\s*\{"))
    other = F.col("starts") & ~F.col("plain")
    last = lambda cond: F.last(F.when(cond, F.col("n")), ignorenulls=True).over(till)
    at = at.withColumns({"group": last(F.col("starts")), "run": last(other), "rank": F.count_if(F.col("plain")).over(till)})
    at = stored(at.select("file", "block", "section", "n", "size", "value", "starts", "ends", "plain", "group", "run", "rank"))
    carried = at.groupBy("file", "block", "section").agg(F.max(F.when(F.col("starts"), F.col("n"))).alias("g"), F.max(F.when(other, F.col("n"))).alias("o"), F.count_if("plain").alias("p"))
    carry = lambda c: F.last(c, ignorenulls=True).over(earlier)
    carried = carried.select("file", "block", "section", carry("g").alias("g"), carry("o").alias("o"), before("p", earlier).alias("p"))
    placed = at.join(carried, ["file", "block", "section"]).withColumns({"group": F.coalesce("group", "g"), "run": F.coalesce("run", "o"), "rank": F.col("rank") + F.col("p")}).drop("g", "o", "p")
    alone = F.col("plain") & F.col("ends")
    parts = placed.where(~alone).groupBy("file", "group").agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("parts"), F.max("plain").alias("plain"), F.max("run").alias("run"), F.max("rank").alias("rank"),
    )
    text = F.concat(F.array_join(F.transform("parts", lambda x: x["value"]), "}"), F.lit("}"))
    parts = stored(parts.select("file", F.col("parts")[0]["block"].alias("block"), F.col("group").alias("n"), text.alias("text"), "plain", "run", "rank"))
    several = parts.where("plain").select("file", "run", "rank", "text")
    records = placed.where(alone).select("file", "run", "rank", F.concat("value", F.lit("}")).alias("text")).unionByName(several)
    records = records.withColumn("text", F.regexp_replace("text", r"^\s*,\s*", ""))
    runs = placed.where("plain").groupBy("file", F.col("run").alias("n")).agg(F.count("*").alias("count"), F.min("rank").alias("first"))
    mark = F.format_string(f',{{"{RUN}":%d,"{COUNT}":%d,"{FIRST}":%d}}', "n", "count", "first")
    rest = parts.where("not plain").join(runs, ["file", "n"], "left").withColumn("mark", F.when(F.col("count") > 0, mark).otherwise(""))
    rest = rest.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "n", "text", "mark"))).alias("x"))
    # A piece at the file's end lacks its brace; a mark of byte order is not part of a piece.
    ended = at.groupBy("file").agg((F.sum(F.octet_length("value") + 1) - F.max("size")).isin(1, -2).alias("open"))
    joined = lambda *names: F.array_join(F.transform("x", lambda x: F.concat(*(x[c] for c in names))), "")
    trimmed = lambda c: F.when(F.col("open"), F.regexp_replace(c, r"\}$", "")).otherwise(c)
    broken = records.where(F.try_parse_json("text").isNull()).select("file").distinct().withColumn("broken", F.lit(True))
    rest = rest.join(ended, "file").join(broken, "file", "left")
    whole = F.col("broken").isNull()
    return Apart(stored(rest.select("file", F.when(whole, trimmed(joined("text", "mark"))).alias("marked"), F.when(whole, trimmed(joined("text"))).alias("text"))), records)


#: Large files of which heads are read before they are written to the shared folder.
_LOT = 1000


def heads(spark: SparkSession, root: str, glob: str = "*", most: int = 16384) -> DataFrame:
    """(path, content): the first bytes of the files below root. Small files are read by tasks. Of large ones no task or row holds more than these bytes, whatever
    signs they are made of: Spark's readers know lines only, so the driver opens those files through Hadoop, one after the other, when this is called."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).format("binaryFile").load(root)
    out = files.where(F.col("length") <= LARGE).select("path", F.substring("content", 1, most).alias("content"))
    large = files.where(F.col("length") > LARGE).select("path").toLocalIterator()
    while lot := list(itertools.islice(large, _LOT)):
        first = spark.createDataFrame([(r.path, _first_bytes(spark, r.path, most)) for r in lot], "path string, content binary")
        out = out.unionByName(stored(first))
    return out


def _first_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()
