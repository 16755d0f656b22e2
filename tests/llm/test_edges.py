"""Odd rows for every operator and stage: null, empty and long texts, repeated rows, shared and missing ids, clashing columns, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shiftlens.llm import boilerplate, decontaminate, embeddings, language, mixing, near_duplicates, quality, secrets, substrings, suffixes

CLASH = ["score", "line", "words", "key", "r0", "r1", "h0", "h1", "spans", "from", "to", "node", "name", "class_id", "kept", "items", "tokens", "found", "p", "n", "x", "base", "open", "label", "order", "rate", "n_tokens", "_row", "_drop", "_r0", "span", "band", "text_b", "body"]
D = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark):
    rng = random.Random(30)
    words = lambda n: " ".join("".join(rng.choices("abcdefg", k=rng.randint(2, 7))) for _ in range(n))
    a, b = words(120), words(90)
    long = " ".join([words(4000)] * 6)
    rows = [(1, a, "en", "s1"), (1, a, "en", "s1"), (2, a, "en", None), (2, b, "de", "s2"), (3, None, None, None), (4, "", "en", "s"), (5, " \n\t\n", None, "s3"), (None, a + " end", "en", "s4"), (None, None, None, "s5"), (None, b, "de", "s6"), (None, b, "de", "s6"), (6, long, "en", "s7"), (7, "x", "en", "s8"), (8, "é𝄞 token=AbCdEf012345678901", "fr", "s9")]
    rows += [(100 + k, f"{words(30)}\nshared line\n{words(10)}", "en" if k % 2 else "de", f"t{k % 9}") for k in range(40)]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], D).repartition(5).cache()


def _labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(100, 140)] + [(1, 1, 0), (1, 1, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda spark, docs: suffixes.suffix_dedup(docs).drop("kept"),
    "op2": lambda spark, docs: near_duplicates.near_duplicates(docs),
    "op3": lambda spark, docs: substrings.substring_dedup(docs).drop("kept"),
    "op4": lambda spark, docs: secrets.digest(secrets.scan(docs)),
    "op5": lambda spark, docs: decontaminate.contamination(docs, spark.createDataFrame([(1, "shared line"), (None, None), (2, "")], "item_id long, text string")).drop("items"),
    "op6": lambda spark, docs: mixing.mix(docs, mixing.label_domains(_labels(spark)), mixing.TARGETS).select("doc_id", "p_good", "rate", "text"),
    "op7": lambda spark, docs: quality.classify(docs, _labels(spark)),
    "op9": lambda spark, docs: language.language_id(docs),
    "op10": lambda spark, docs: boilerplate.remove_lines(docs).select("doc_id", "text", "source", "n_lines", "n_removed_lines"),
}


def _rows(df):
    return sorted("|".join(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df.collect())


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    docs, run = _docs(spark), OPERATORS[name]
    plain = _rows(run(spark, docs))
    clashing = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    assert len(plain) == docs.count()
    assert _rows(run(spark, clashing)) == plain
    assert run(spark, clashing.limit(0)).count() == 0
    repeated = [r for r in plain if r.startswith("1|")]
    assert len(repeated) == 2 and repeated[0] == repeated[1]


def test_odd_vectors(spark):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e), (1, e), (2, [1.0, 2.0, 3.0001]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (10, [1e300, 2e300, 3e300]), (11, [-1.0, -2.0, -3.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(0).alias(c) for c in ("node", "h0", "weight", "names", "own", "task", "component")))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(vectors).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), *((k, 0, k) for k in range(3, 10)), (10, 3, 1), (11, 0, 11)]
    assert embeddings.near_vectors(vectors.limit(0)).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    docs = _docs(spark)
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clashing = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASH)))
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert _rows(stage(spark, clashing, str(tmp_path))) == _rows(stage(spark, docs, str(tmp_path)))
        assert stage(spark, clashing.limit(0), str(tmp_path)).count() == 0
    kept = stages["near_duplicates"](spark, docs, str(tmp_path))
    assert kept.columns == corpus_pipeline.COLUMNS
    named = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in kept.where("doc_id is null or doc_id < 9").collect())
    a, b, long = (docs.where(f"doc_id = {k}").collect() for k in (1, 2, 6))
    first = {r.text[:2] for r in a}.pop()
    second = next(r.text[:2] for r in b if r.text[:2] != first or len(r.text) != len(a[0].text))
    # One row of text a (id 1), one of text b (id 2), and every row without words.
    assert named == sorted([(1, first), (2, second), (3, ""), (0, ""), (4, ""), (5, " \n"), (6, long[0].text[:2]), (7, "x"), (8, "é𝄞")])
    clean = stages["decontaminate"](spark, docs, str(tmp_path))
    assert clean.count() == docs.count() - 1 and clean.where("doc_id = 7").count() == 0
