"""Registered corpus queries against SQL, and the pipeline against its stages said otherwise."""

import os
import random

import duckdb
import numpy as np
import pytest
from plain import classes, tfidf

import corpus_pipeline
from shiftlens.llm import mixing, near_duplicates, quality, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(queries.ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert got.astype(str).equals(want.astype(str))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages, before = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs
        docs = stages[name] = stage(spark, docs, sf).cache()
        docs.count()
    assert all(d.columns == corpus_pipeline.COLUMNS for d in list(stages.values())[:-1])
    ids = lambda name: {r.doc_id for r in stages[name].collect()}

    # Quality: the score of each document by hand.
    weights = quality.fit(quality.training_rows(before["quality"], spark.read.parquet(f"{sf}/labels.parquet")))
    good = set()
    for r in before["quality"].collect():
        raw = (r.text or "").encode()
        at, _ = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        score = 1 / (1 + np.exp(-sum(weights[k] for k in at) / max(1, len(at)) - weights[quality.BIAS]))
        if score >= quality.THRESHOLD:
            good.add(r.doc_id)
    assert ids("quality") == good and 0 < len(good) < before["quality"].count()

    con = duckdb.connect()
    lines = stages["quality"].toPandas()  # noqa: F841  read by the SQL below
    boiler = {r[0] for r in con.execute("SELECT k FROM (SELECT source, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS k FROM lines) WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 6").fetchall()}
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if x.strip(" \t\r") not in boiler) for r in lines.itertuples()}
    got = {r.doc_id: (r.text, r.n_chars) for r in stages["lines"].collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}

    # Near duplicates: one document of each class that all pairs give.
    rows = sorted(stages["lines"].select("doc_id", "text").collect())
    _, top = classes(tfidf([r.text for r in rows], near_duplicates.COMMON))
    firsts = {rows[k].doc_id for k in set(top.values())}
    assert firsts <= ids("near_duplicates") and len(ids("near_duplicates") - firsts) <= 2 and len(firsts) < len(rows)

    sql = queries.ORACLES["op5_decontaminate"].replace("FROM documents)", "FROM near)")
    near = stages["near_duplicates"].toPandas()  # noqa: F841
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    clean = {r[0] for r in con.execute(f"SELECT doc_id FROM ({sql}) WHERE NOT contaminated").fetchall()}
    assert ids("decontaminate") == clean

    # Mixing: every document stays, and the fitted shares are the targets'.
    mixed = stages["mix"].toPandas()
    assert set(mixed.doc_id) == clean and (mixed.rate >= 0).all() and (mixed.copies == mixed.rate.round()).mean() > 0.99
    drawn = {d: (mixed.rate * mixed.n_tokens * mixed[f"p_{d}"]).sum() / mixed.n_tokens.sum() for d in mixing.TARGETS}
    assert all(abs(drawn[d] - t) < 2e-3 for d, t in mixing.TARGETS.items()), drawn

    whole = corpus_pipeline.run(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    mixed = mixed.sort_values("doc_id").reset_index(drop=True)
    assert list(whole.doc_id) == list(mixed.doc_id) and np.allclose(whole.rate, mixed.rate, atol=1e-6) and list(whole.text) == list(mixed.text)


def test_mix_output_meets_targets(spark, tmp_path):
    rng = random.Random(3)
    kinds = ["toxic" if k % 20 == 0 else "low" if k % 20 < 3 else "good" for k in range(300)]
    signs = {"toxic": "abcd", "low": "klmn", "good": "wxyz"}
    texts = [" ".join("".join(rng.choices(signs[kind], k=rng.randint(2, 5))) for _ in range(40)) for kind in kinds]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, int(kind != "low"), int(kind == "toxic")) for k, kind in enumerate(kinds)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mix(spark, docs, str(tmp_path)).toPandas()
    drawn, kind = out.rate * out.n_tokens, out.doc_id.map(dict(enumerate(kinds)))
    shares = {domain: drawn[kind == domain].sum() / drawn.sum() for domain in mixing.TARGETS}
    assert all(abs(shares[domain] - share) < 5e-3 for domain, share in mixing.TARGETS.items()), shares
    assert sorted(out.doc_id) == list(range(300)) and (out.rate[kind == "toxic"] < 0.5).any()
