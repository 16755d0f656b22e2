"""The contract of lineage documents, checked before a schema turns what is missing or of a wrong type into nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.sources import documents as large
from shiftlens.sources.shared import stored

# The collections of a document, the fields that its lineage records need, and attribute names that stand for none.
COLLECTIONS = [
    "containers", "datasets", "attributes", "processGroups", "processes", "steps", "tier1QueryBlockAttributeLineage", "tier2StatementAttributeLineage", "tier3DatasetLineage", "lineageFactAttribute",
]
_ATTRIBUTE_EDGE = ["sourceAttributeNaturalKey", "sourceDatasetNaturalKey", "targetAttributeNaturalKey", "targetDatasetNaturalKey", "stepNaturalKey"]
REQUIRED = {
    "tier1QueryBlockAttributeLineage": _ATTRIBUTE_EDGE, "tier2StatementAttributeLineage": _ATTRIBUTE_EDGE, "tier3DatasetLineage": ["sourceDatasetNaturalKey", "targetDatasetNaturalKey", "stepNaturalKey"],
    "lineageFactAttribute": _ATTRIBUTE_EDGE,
}
SENTINELS = ["<*>", "NOT APPLICABLE"]
_DECLARED = {"dataset": ("datasets", "datasetNaturalKey"), "attribute": ("attributes", "attributeNaturalKey"), "step": ("steps", "stepNaturalKey")}
_NOTHING = ["null", '""', "0", "0.0", "false", "[]", "{}"]


def documents(spark, path) -> DataFrame:
    """(path, doc, part): JSON documents, one a file, as they are. Of a large file doc is what is left without its runs of records, whose rows follow without doc: `part` has
    their run, rank and record. It is null where a file is read whole."""
    raw = spark.read.text(path, wholetext=True).where(F.col("_metadata.file_size") <= large.LARGE)
    part = "struct<run:bigint,rank:bigint,record:variant>"
    whole = raw.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"), F.lit(None).cast(part).alias("part"))
    if not large.any_large(spark, path):
        return whole
    apart = large.take_apart(spark, path)
    none = F.struct(F.lit(None).cast("bigint").alias("run"), F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("variant").alias("record"))
    rest = apart.rest.select(F.col("file").alias("path"), F.try_parse_json("marked").alias("doc"), none.alias("part"))
    runs = apart.records.select(F.col("file").alias("path"), F.lit(None).cast("variant").alias("doc"), F.struct("run", "rank", F.try_parse_json("text").alias("record")).alias("part"))
    return whole.unionByName(rest).unionByName(runs)


_json = lambda x, f: F.to_json(F.variant_get(x, f"$.{f}", "variant"))
_DECLARES = {c: f for c, f in _DECLARED.values()}


def _key(x, collection: str):
    declared = _DECLARES.get(collection)
    return _json(x, declared) if declared else F.lit(None).cast("string")


def _fields(x, collection: str):
    fields = [F.struct(F.lit(f).alias("field"), _json(x, f).alias("key"), F.coalesce(F.try_variant_get(x, f"$.{f}", "string"), _json(x, f)).alias("subject")) for f in REQUIRED.get(collection, [])]
    return F.array(*fields) if fields else F.lit(None).cast("array<struct<field:string,key:string,subject:string>>")


def _records(docs: DataFrame) -> DataFrame:
    """(path, collection, kind, index, key, fields): the records of all collections that are objects, by place; one row with a null index where a collection has
    none. kind: what the collection is. key: what a record declares. fields: those that it needs, as JSON and as text."""

    def taken(docs: DataFrame, *marks: str) -> DataFrame:
        def of(collection: str):
            record = lambda x: F.struct(_key(x, collection).alias("key"), _fields(x, collection).alias("fields"), *(F.try_variant_get(x, f"$.{m}", "bigint").alias(m) for m in marks))
            objects = F.filter(F.try_variant_get("doc", f"$.{collection}", "array<variant>"), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
            return F.struct(F.lit(collection).alias("collection"), F.schema_of_variant(F.variant_get("doc", f"$.{collection}", "variant")).alias("kind"), F.transform(objects, record).alias("records"))

        each = docs.select("path", F.explode(F.array(*map(of, COLLECTIONS))).alias("c"))
        return each.select("path", "c.collection", "c.kind", F.posexplode_outer("c.records").alias("index", "r")).select("path", "collection", "kind", "index", "r.key", "r.fields", *(f"r.{m}" for m in marks))

    if "part" not in docs.columns:
        return taken(docs)
    # In what is left of a large document a mark stands for a run: what comes after it moves on by the run's length.
    before = Window.partitionBy("path", "collection").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.when(F.col(large.RUN).isNotNull(), F.col(large.COUNT) - 1)).over(before), F.lit(0))
    rest = taken(docs.where("part is not null and part.run is null"), large.RUN, large.COUNT, large.FIRST).withColumn("index", F.col("index") + moved)
    marks = rest.where(F.col(large.RUN).isNotNull()).select("path", "collection", "kind", "index", F.col(large.RUN).alias("run"), F.col(large.FIRST).alias("first"))
    runs = docs.where("part.run is not null").select("path", "part.run", "part.rank", F.col("part.record").alias("x")).join(marks, ["path", "run"])
    by = lambda make, only: F.coalesce(*(F.when(F.col("collection") == c, make(F.col("x"), c)) for c in only))
    runs = runs.select("path", "collection", "kind", (F.col("index") + F.col("rank") - F.col("first")).alias("index"), by(_key, _DECLARES).alias("key"), by(_fields, REQUIRED).alias("fields"))
    out = taken(docs.where("part is null"))
    return out.unionByName(rest.where(F.col(large.RUN).isNull()).select(out.columns)).unionByName(runs)


def document_findings(docs: DataFrame) -> DataFrame:
    """(path, level, finding, collection, index, subject) of docs(path, doc), with the parts of large ones as documents() gives them: documents that are no JSON object, collections that are missing (WARN) or no lists,
    lineage records without required fields, and references to steps, datasets and attributes that the document doesn't declare; names that
    stand for no attribute are a WARN. References are looked for only where a document declares any of their kind. Indices count a collection's objects. Documents
    are taken apart once, when this is called."""
    whole = F.coalesce(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT")), F.lit(False))
    finding = lambda level, name, collection, index, subject: [F.lit(level).alias("level") if isinstance(level, str) else level.alias("level"), F.lit(name).alias("finding") if isinstance(name, str) else name.alias("finding"), collection.alias("collection"), index.cast("int").alias("index"), subject.alias("subject")]
    none, no_text = F.lit(None), F.lit(None).cast("string")
    runs = docs.limit(0)
    if "part" in docs.columns:
        docs, runs = docs.where("part.run is null"), docs.where("part.run is not null")
    out = docs.where(~whole).select("path", *finding("FAIL", "invalid document", no_text, none, no_text))
    records = stored(_records(docs.where(whole).unionByName(runs)))
    listed = records.where("index is null or index = 0")
    out = out.unionByName(listed.where("kind is null").select("path", *finding("WARN", "missing collection", F.col("collection"), none, no_text)))
    out = out.unionByName(listed.where("kind not like 'ARRAY%'").select("path", *finding("FAIL", "invalid collection", F.col("collection"), none, F.col("kind"))))
    kind_of = F.when(F.col("collection") == "datasets", "dataset").when(F.col("collection") == "attributes", "attribute").when(F.col("collection") == "steps", "step")
    declared = records.where("index is not null").select("path", kind_of.alias("kind"), "key").where("kind is not null").distinct()
    rows = records.where("fields is not null")
    empty = lambda key: key.isNull() | key.isin(_NOTHING)
    missing = rows.withColumn("lost", F.array_join(F.transform(F.filter("fields", lambda f: empty(f["key"])), lambda f: f["field"]), ",")).where("lost <> ''")
    out = out.unionByName(missing.select("path", *finding("FAIL", "missing required field", F.col("collection"), F.col("index"), F.col("lost"))))
    told = rows.select("path", "collection", "index", F.explode("fields").alias("f")).where(~empty(F.col("f.key")))
    kind = F.when(F.contains("f.field", F.lit("Attribute")), "attribute").when(F.contains("f.field", F.lit("Dataset")), "dataset").otherwise("step")
    told = told.select("path", "collection", "index", kind.alias("kind"), F.col("f.key").alias("key"), F.col("f.subject").alias("subject"))
    told = told.join(declared.select("path", "kind").distinct(), ["path", "kind"], "left_semi")
    stands_for_none = (F.col("kind") == "attribute") & (F.col("subject").isin(SENTINELS) | F.endswith("subject", F.lit("|<*>")))
    out = out.unionByName(told.where(stands_for_none).select("path", *finding("WARN", "attribute sentinel", F.col("collection"), F.col("index"), F.col("subject"))))
    lost = told.where(~stands_for_none).join(declared, ["path", "kind", "key"], "left_anti")
    return out.unionByName(lost.select("path", *finding("FAIL", F.concat(F.lit("undeclared "), F.col("kind")), F.col("collection"), F.col("index"), F.col("subject"))))
