import json
import random

import pytest
from pyspark.sql import functions as F

from shiftlens.operators import contract
from shiftlens.plans import ingest_queries
from shiftlens.sources import documents, readers


def _files(folder):
    rng = random.Random(5)
    odd = ["a", "{", "}", '"', "\\", "[", "]", ",{", "é", '\\"}']
    name = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(6)))
    edge = lambda: {f: rng.choice([name(), "NOT APPLICABLE", None]) for f in contract.REQUIRED["lineageFactAttribute"]} | {"more": rng.choice([1, {"x": [{}, {"y": "}"}]}, [[{"z": 1}]]])}
    for k in range(7):
        doc = {"parseRunId": f"r{k}", "parseTimestamp": "t", "platform": {"platformNaturalKey": name(), "technology": "t"}, "steps": [{"stepNaturalKey": name()} for _ in range(4)]}
        doc |= {c: [rng.choice([edge(), edge(), edge(), 7, [edge()], name()]) if k % 2 else edge() for _ in range(rng.randrange(9))] for c in ("tier1QueryBlockAttributeLineage", "tier2StatementAttributeLineage", "tier3DatasetLineage") if rng.random() < 0.8}
        doc |= {"lineageFactAttribute": [edge() for _ in range(k % 3)], "containers": rng.choice([None, "x", {"a": {"b": 1}, "c": {}}, []])}
        if k == 3:
            del doc["parseRunId"]
        (folder / f"d{k:02}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=False) + rng.choice(["", "\n"]), encoding="utf-8")
    whole = (folder / "d04.json").read_text(encoding="utf-8").strip()
    for name_, text in {"cut": whole[:-1], "shut": whole + "}", "list": f"[{whole}, {whole}]", "half": whole[: len(whole) // 2], "bad": whole.replace('"stepNaturalKey"', "stepNaturalKey", 1), "none": " ", "number": "5"}.items():
        (folder / f"{name_}.json").write_text(text, encoding="utf-8")


@pytest.mark.parametrize("block", [256, 1 << 20])
def test_documents_taken_apart_are_those_read_whole(spark, tmp_path, monkeypatch, block):
    _files(tmp_path)

    def found():
        rows = contract.document_findings(contract.documents(spark, str(tmp_path))).select(F.substring_index("path", "/", -1), "level", "finding", "collection", "index", "subject").collect()
        frames = readers.read_lineage(spark, str(tmp_path / "d*.json")) if block == 256 else readers.read_lineage(spark, str(tmp_path / "[dl]*.json"))
        return sorted(map(str, rows)), {name: sorted(str(r) for r in df.collect()) for name, df in frames.items()}

    whole = found()
    monkeypatch.setattr(documents, "LARGE", 0)
    for key, value in (("spark.sql.files.maxPartitionBytes", block), ("spark.sql.files.openCostInBytes", 1)):
        spark.conf.set(key, value)
    try:
        apart = found()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert whole[0] == apart[0] and len(whole[0]) > 100
    assert whole[1] == apart[1] and whole[1]["attribute_edges"]


def test_no_row_holds_a_large_document(spark, sf, tmp_path, monkeypatch):
    """Lines of a document are written as they come, and records are taken out one by one."""
    monkeypatch.setattr(documents, "LARGE", 0)
    edge = {f: "x" for f in contract.REQUIRED["lineageFactAttribute"]}
    (tmp_path / "a.json").write_text(json.dumps({"tier1QueryBlockAttributeLineage": [edge] * 500, "steps": [{"stepNaturalKey": "x"}]}))
    apart = documents.take_apart(spark, str(tmp_path))
    assert apart.records.count() == 499 and apart.records.agg(F.max(F.length("text"))).first()[0] < 300 and apart.rest.agg(F.max(F.length("marked"))).first()[0] < 500
    for name in ("val7_documents", "src5_read_lineage_json"):
        assert "collect_list" not in ingest_queries.query.__globals__["QUERIES"][name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_a_head_that_parts_a_sign(spark, tmp_path, monkeypatch):
    (tmp_path / "x.dat").write_bytes(("§".join("abcdefghij") + "ENDREC" + "a" * 16358 + "§").encode())
    (tmp_path / "l.json").write_text('{"parseRunId": "' + "é" * 20000 + '"}')
    for size in (documents.LARGE, 0):
        monkeypatch.setattr(documents, "LARGE", size)
        heads = documents.heads(spark, str(tmp_path))
        assert [len(r.content) for r in heads.collect()] == [16384] * 2
        got = {r.path.rsplit("/", 1)[1]: (r.format, r.content_type) for r in readers.detect_content(heads).collect()}
        assert got == {"x.dat": ("flat", "query_log"), "l.json": ("json", "lineage")}


def test_a_sort_that_spills_leaves_documents_whole(spark, tmp_path):
    """Sorters that write themselves out after 50 rows, as with documents of hundreds of MB."""
    conf, key = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf(), "spark.shuffle.spill.numElementsForceSpillThreshold"
    edges = spark.range(3000).select((F.col("id") % 2).cast("string").alias("file"), (F.col("id") % 3).alias("k"), F.format_string('{"x":%d}', "id").alias("line"))
    frame = {-1: F.lit('{"a":['), 0.5: F.lit('],"b":['), 1.5: F.lit('],"c":['), 4: F.lit("]}")}
    conf.set(key, "50")
    try:
        path = ingest_queries._document_files(ingest_queries._lines(edges, edges.select("file").distinct(), frame), f"{tmp_path}/out", "document")
    finally:
        conf.remove(key)
    for k in range(2):
        (file,) = (tmp_path / f"out/document={k}").glob("part-*")
        doc = json.loads(file.read_text())
        assert {c: sorted(r["x"] for r in doc[c]) for c in "abc"} == {c: [x for x in range(3000) if x % 2 == k and x % 3 == j] for j, c in enumerate("abc")}


def test_heads_of_files_without_quotes_or_lines(spark, tmp_path, monkeypatch):
    """No row holds more of a large file than its head, whatever signs it is made of."""
    (tmp_path / "a.dat").write_text("x" * 3_000_000)
    (tmp_path / "b c%20é.json").write_text("{" + '"k": 1, ' * 300_000)
    monkeypatch.setattr(documents, "LARGE", 100)
    heads = documents.heads(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in heads.collect()} == {f.name: f.read_bytes()[:16384] for f in tmp_path.iterdir()}
    assert "Window" not in heads._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(documents, "_LOT", 1)
    assert documents.heads(spark, str(tmp_path), "*.dat").count() == 1 and documents.heads(spark, str(tmp_path)).count() == 2


def test_sections_of_a_block(spark, tmp_path, monkeypatch):
    """No window holds a block whole, and documents are taken apart alike wherever a section ends."""
    _files(tmp_path)
    monkeypatch.setattr(documents, "LARGE", 0)

    def found(bits):
        monkeypatch.setattr(documents, "_SECTION_BITS", bits)
        apart = documents.take_apart(spark, str(tmp_path))
        return sorted((r.file, r.text or "") for r in apart.rest.collect()), sorted((r.file, r.rank, r.text) for r in apart.records.collect())

    whole = found(40)
    assert whole[0] and len(whole[1]) > 20 and found(1) == whole
