import random
import re

import pytest
from pyspark.sql import functions as F

from shiftlens.functions import exprs
from shiftlens.operators import quality
from shiftlens.plans import ingest
from shiftlens.sources import readers, writers
from shiftlens.streaming import jobs


def test_records_run_over_lines(spark, tmp_path):
    head = "td§r1§2024-01-01§2024-01-01§"
    lines = [head + "db§o§§§§§line one\nline two§1,027§§§§", head + "d\\§b§o§§§§§x§§§§§", head + "short§y"]
    (tmp_path / "databasesv_1.dat").write_bytes("\n".join(lines).encode() + b"\n")
    got = readers.read_view(spark, str(tmp_path), "databases", strict=False).orderBy("perm_space").collect()
    assert [(r.database_name, r.comment_string, r.perm_space) for r in got] == [("d§b", "x", None), ("db", "line one\nline two", 1027)]
    assert readers.violations(spark, str(tmp_path), "databases").first().n_fields == 6
    with pytest.raises(Exception, match="a record of 6 fields instead of 16"):
        readers.read_view(spark, str(tmp_path), "databases").collect()


def test_runs_lie_side_by_side(spark, tmp_path):
    for run in ("r1", "r 2"):
        (tmp_path / f"databasesv_{run}.dat").write_text("".join(f"td§{run}§2024-01-01§2024-01-01§db{k}§o§§§§§line one\nline two§{k}§§§§\n" for k in range(3)))
    got = readers.read_view(spark, str(tmp_path), "databases").collect()
    assert sorted((r.extract_run_id, r.database_name, r.comment_string) for r in got) == [(run, f"db{k}", "line one\nline two") for run in ("r 2", "r1") for k in range(3)]
    assert readers.violations(spark, str(tmp_path), "databases").count() == 0 and readers.read_view(spark, [], "databases").count() == 0


def test_bad_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "t.dat").write_bytes("td§r§t§d§db§t1§T§1§a".encode() + b"\xff" + "bENDREC".encode())
    assert readers.read_view(spark, str(tmp_path), "tabletext").first().request_text == "a�b"


def test_type_names(spark):
    rows = [("CV", 255, None, None, "VARCHAR(255)"), ("D", None, 18, 2, "DECIMAL(18,2)"), ("D", None, 18, None, "DECIMAL(18)"), ("TS", None, None, None, "TIMESTAMP"), ("SZ", 6, None, None, "TIMESTAMP(6) WITH TIME ZONE"), ("PM", 3, None, None, "PERIOD(TIMESTAMP(3) WITH TIME ZONE)"), ("XX", 1, None, None, "UNKNOWN(XX)"), (None, 1, None, None, "UNKNOWN(?)")]
    df = spark.createDataFrame(rows, "c string, l int, d int, f int, want string")
    assert [r.got for r in df.select(exprs.format_type("c", "l", "d", "f").alias("got")).collect()] == [r[4] for r in rows]


def test_two_hours_are_coherent(spark):
    rows = [("a", 0, "2024-01-01 00:00:00"), ("b", 0, "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "file string, pos int, t string").select("file", "pos", F.to_timestamp("t").alias("extracted_at"), F.lit("d").alias("snapshot_date"))
    assert quality.temporal_coherence(df).first().coherent
    late = df.withColumn("extracted_at", F.when(F.col("file") == "b", F.to_timestamp(F.lit("2024-01-01 02:00:01"))).otherwise(F.col("extracted_at")))
    assert not quality.temporal_coherence(late).first().coherent
    assert quality.temporal_coherence(late.where("file = 'b'")).first().coherent


def test_detect(spark, tmp_path):
    (tmp_path / "columnsv_full.dat").write_text("a§b")
    (tmp_path / "x.dat").write_text("§".join("abcdefghij") + "ENDREC")
    (tmp_path / "l.json").write_text('﻿ {"parseRunId": 1}')
    (tmp_path / "t.txt").write_text("hello")
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.content_type, r.confidence) for r in readers.detect_content(readers.read_files(spark, str(tmp_path)).select("path", "content")).collect()}
    assert got == {"columnsv_full.dat": ("flat", "columns", "high"), "x.dat": ("flat", "query_log", "medium"), "l.json": ("json", "lineage", "high"), "t.txt": ("unknown", "unknown", "low")}


def test_writers_do_work_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "x")], "snapshot_from long, snapshot_to long, c string")
    assert writers.append_changes(rows, str(tmp_path)) and not writers.append_changes(rows, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/change_event").count() == 1


def test_depth_below_one_fails(spark):
    with pytest.raises(Exception, match="depth of 1"):
        writers.impact_events(spark.createDataFrame([(0,)], "depth int")).collect()


def test_literals_and_temporary_datasets_go(spark):
    c = spark.createDataFrame([("NOT APPLICABLE",), ("c",)], "containerNaturalKey string")
    d = spark.createDataFrame([("S.T", "c"), ("UNKNOWN.TEMPTABLE5", "c")], "datasetNaturalKey string, containerNaturalKey string")
    a = spark.createDataFrame([("S.T|c", "S.T", "c", None), ("S.T|'D'", "S.T", "c", None), ("S.T|NULL", "S.T", "c", None), ("U|x", "UNKNOWN.TEMPTABLE5", "c", None)], "attributeNaturalKey string, datasetNaturalKey string, containerNaturalKey string, attributeClass string")
    e = spark.createDataFrame([("S.T|c", "S.T|c"), ("S.T|c", "S.T|NULL")], "sourceAttributeNaturalKey string, targetAttributeNaturalKey string")
    kept = quality.noise_filter(c, d, a, e)
    assert [r.attributeNaturalKey for r in kept["attributes"].collect()] == ["S.T|c"]
    assert kept["edges"].count() == 0 and quality.noise_filter(c, d, a, e, self_loops=True)["edges"].count() == 1


def _plain_records(text):
    """Records by field count, line after line; what is left at the end, or has too many fields, is None."""
    out, held = [], ""
    for line in text.splitlines(keepends=True):
        held += line
        if not held.strip("\r\n\t "):
            held = ""
        elif (n := len(fields := re.split(r"(?<!\\)§", held.strip("\r\n\t ")))) >= 16:
            out.append([f.replace("\\§", "§") for f in fields] if n == 16 else None)
            held = ""
            if n > 16:
                return out
    return out + [None] * bool(held.strip("\r\n\t "))


def test_records_by_field_count_over_blocks(spark, tmp_path):
    rng = random.Random(21)
    texts = {}
    for k in range(8):
        fields = lambda: [rng.choice(["td", "r\\§1", "", "x\ny", "td§r1"[:2], " z\n\nmore", "é"]) for _ in range(16)]
        lines = [rng.choice(["\n", " \n\n", ""]) + "§".join(x if k % 2 else x.replace("\n", " ") for x in fields()) + "\n" for _ in range(rng.randint(1, 30))]
        texts[f"f{k}.dat"] = "".join(lines) + ("cut§short" if k == 5 else "")
        (tmp_path / f"f{k}.dat").write_text(texts[f"f{k}.dat"])
    small = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = {}
        for r in readers._records(spark, str(tmp_path), "columns").collect():
            got.setdefault(r.position.file.rsplit("/", 1)[1], []).append((r.position.block, r.position.n, r.fields if len(r.fields) == 16 else None))
        bad = readers.violations(spark, str(tmp_path), "columns").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(b for rows in got.values() for b, _, _ in rows) > 200
    broken = set()
    for name, text in texts.items():
        rows, want = [f for _, _, f in sorted(got[name], key=lambda r: r[:2])], _plain_records(text)
        if None in want:
            broken.add(name)
            want = want[: want.index(None)]
        assert rows[: len(want)] == want and (name in broken or len(rows) == len(want))
    assert {b.file.rsplit("/", 1)[1] for b in bad} == broken and all(b.number >= 1 for b in bad)


def test_errors_name_file_and_record(spark, tmp_path):
    whole = "td§r1§a§b§db§o§§§§§line one\nline two§1§§§§\n"
    (tmp_path / "databasesv_7.dat").write_text("\n" + whole * 3 + whole.replace("§o§", "§o§x§") + whole)
    with pytest.raises(Exception, match=r"databasesv_7.dat, record 4: a record of 17 fields instead of 16"):
        readers.read_view(spark, str(tmp_path), "databases").collect()


def test_a_killed_import_is_run_again(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([("a",), ("b",)], "c string")
    broken = spark.createDataFrame([("a",)], "c string").select(F.raise_error(F.lit("killed")).cast("string").alias("c"))
    assert writers.persist_run({"tables": rows, "columns": rows}, root, "A", "r1") == (1, True)
    with pytest.raises(Exception, match="killed"):
        writers.persist_run({"tables": rows, "columns": broken}, root, "A", "r2")
    assert spark.read.parquet(f"{root}/tables").where("snapshot_id = 2").count() == 2 and writers.ledger(spark, root).count() == 1
    assert writers.clear_unfinished(spark, root, ["tables", "columns"]) == [2]
    assert writers.persist_run({"tables": rows, "columns": rows}, root, "A", "r2") == (2, True)
    # A stored run's frames are not even computed; by force it gets a new id.
    assert writers.persist_run({"tables": broken, "columns": broken}, root, "A", "r1") == (1, False)
    assert writers.persist_run({"tables": rows, "columns": rows}, root, "A", "r1", force=True) == (3, True)
    assert {r.snapshot_id: r.extract_run_id for r in writers.ledger(spark, root).collect()} == {1: "r1", 2: "r2", 3: "r1"}
    assert sorted(r.snapshot_id for r in spark.read.parquet(f"{root}/columns").collect()) == [1, 1, 2, 2, 3, 3]
    assert writers.delete_snapshot(spark, root, ["tables", "columns"], 3, 3) == {"tables": 2, "columns": 2}
    assert writers.ledger(spark, root).count() == 2


def test_a_pair_is_made_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "snapshot_from long, snapshot_to long, c string")
    asked = []
    make = lambda: asked.append(1) or rows
    for _ in range(2):
        assert [r.c for r in writers.changes_between(spark, str(tmp_path), 1, 2, make).collect()] == ["x"]
    assert len(asked) == 1
    assert writers.append_changes(rows, str(tmp_path)) and not writers.append_changes(rows, str(tmp_path))
    assert sorted(r.c for r in spark.read.parquet(f"{tmp_path}/change_event").collect()) == ["x", "y"]
    assert writers.changes_between(spark, str(tmp_path), 8, 9, make).count() == 0


def test_first_of_equal_times(spark):
    tables = spark.createDataFrame([("d", "t", "V", 2), ("d", "t", "T", 1), ("d", "u", "T", 3), ("d", "u", "V", 4)], "database_name string, table_name string, table_kind string, position long")
    tables = tables.withColumn("last_alter_timestamp", F.lit(None).cast("timestamp_ntz"))
    none = readers.read_view(spark, [], "columns")
    made = lambda rows: {r.table_name: r.object_type for r in ingest.build_snapshot(1, readers.read_view(spark, [], "databases"), rows, none)["tables"].collect()}
    assert made(tables) == {"t": "TABLE", "u": "TABLE"}
    assert made(tables.drop("position").coalesce(1)) == {"t": "VIEW", "u": "TABLE"}


def test_query_log_over_days(spark, tmp_path):
    def land(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.dat").write_text("".join(f"td§2024/05/12§7§2024-05-{day:02d} 10:00:00§{q}§{n}§{text}§db§§ENDREC" for day, q, n, text in rows))
        jobs.stream_query_log(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {(r.query_id, r.sql_text, r.fragments) for r in jobs.query_log(spark, str(tmp_path / "out")).collect()}

    assert land("a", [(1, 1, 1, "select "), (1, 2, 1, "one")]) == {(1, "select ", 1), (2, "one", 1)}
    assert land("b", [(1, 1, 2, "x"), (3, 3, 1, "late")]) == {(1, "select x", 2), (2, "one", 1), (3, "late", 1)}
    # Days later: queries that are written stay as they are, open ones grow.
    assert land("c", [(1, 1, 1, "select "), (1, 1, 3, "!"), (3, 3, 2, "r")]) == {(1, "select x", 2), (2, "one", 1), (3, "later", 2)}


def test_an_import_reads_its_files_once(spark, tmp_path):
    head = "td§20240131T120000Z§2024-01-31T12:00:00§2024-01-31§"
    table = lambda name: head + f"s§{name}§T§§§§2024-01-01 00:00:00§§§§§\n"
    event = lambda name, kind, n: f"td§s§{name}§§1§{kind}§1§2§Y§{n}§1§2024-01-01 00:00:00ENDREC"
    for name, text in {
        "tablesv_full.dat": table("t1") + table("t2"), "columnsv_full.dat": head + "s§t2§t1_id§1§I§§§§Y§§§\n",
        "pdcr_object_usage_1.dat": event("t1", "Tab", 5) + event("T1", "Tab", 2) + event("gone", "Tab", 1) + event("t2", "UDF", 1),
    }.items():
        (tmp_path / name).write_text(text)
    made = ingest.unified_import(spark, str(tmp_path), 1)
    for name in ("tables", "nodes", "edges", "usage", "outcomes", "criticality"):
        assert not [f for f in made[name].inputFiles() if f.endswith(".dat")], name
    assert sorted((r.object_name, r.query_count) for r in made["usage"].collect()) == [("T1", 2), ("t1", 5)]
    assert sorted((r.outcome, r.n) for r in made["outcomes"].collect()) == [("inserted", 2), ("orphan", 1), ("unmapped_type", 1)]
    assert {r.relationship_type: r.n for r in made["edges"].groupBy("relationship_type").agg(F.count("*").alias("n")).collect()} == {"DEPENDS_ON": 2, "FEEDS": 1}
    assert sorted((r.object_name, r.usage_score) for r in made["criticality"].collect()) == [("S", 0.0), ("S.T1", 1.0), ("S.T2", 0.0)]


def test_an_import_without_files(spark, tmp_path):
    made = ingest.unified_import(spark, str(tmp_path), 1)
    assert not any(df.count() for name, df in made.items() if name != "counts") and not any(r.seen or r.created for r in made["counts"].collect())


def test_times_by_their_signs(spark):
    forms = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss"]
    good = ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02 03:04:05.123456", "2024-01-02T03:04:05.123456", " 2024-01-02 03:04:05 "]
    bad = ["", " ", ".", "T", "2024-01-02 03:04:05.", "2024-01-02", "2024-13-02 03:04:05", "2024-01-02 03:04:05T", "T2024-01-02 03:04:05.1", "2024-01-02 03:04:05.1", "2024-01-02 03:04:05.1234567", "soon", None]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    every = F.coalesce(*(F.try_to_timestamp(F.trim("t"), F.lit(f)).cast("timestamp_ntz") for f in forms))
    got = df.select("t", exprs.parse_catalog_ts("t").alias("got"), every.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and all(r.got for r in got if r.t in good)
