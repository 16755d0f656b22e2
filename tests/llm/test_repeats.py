"""Suffix-array dedup and recompression against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from shiftlens.llm import decontaminate, substrings, suffixes

D = "doc_id long, text string, extra string"


def _bytes_brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, b in enumerate(raw):
        for i in range(len(b) - window + 1):
            seen.setdefault(b[i : i + window], []).append((k, i))
    gone = [np.zeros(len(b), bool) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + window] = True
    out = []
    for b, g in zip(raw, gone, strict=True):
        starts = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if len(g) else 0
        kept = bytes(x for x, dead in zip(b, g, strict=True) if not dead)
        out.append((len(b), int(g.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out


def _words_brute(rows, window):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in rows}
    least = {}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            least[s] = min(k, least.get(s, k))
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone.update(range(i, i + window))
        out[k] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def _texts(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "a", *("".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(60))]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [words(rng.randint(20, 60)) for _ in range(6)]
    texts = []
    for k in range(n):
        w = words(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, 8)
            w += s[a : len(s) - rng.randint(0, 8)] + words(rng.randint(0, 5))
        if k % 9 == 0:
            w += ["run"] * rng.randint(5, 40)
        if k % 11 == 0:
            w += ["x", "y"] * 15
        texts.append(rng.choice([" ", "\n"]).join(w))
    base = " ".join(words(120))
    for k in range(40):  # near copies, in which every gram has many contexts
        w = base.split(" ")
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = "e" + str(rng.randrange(1000))
        texts.append(" ".join(w))
    return [*texts, texts[0], texts[0], "", None, " ", "short"]


@pytest.mark.parametrize(("group", "passage", "piece"), [(2, 60, 1 << 20), (4096, 60, 1 << 20), (3, 40, 100)])
def test_bytes(spark, monkeypatch, group, passage, piece):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    monkeypatch.setattr(suffixes, "STEP", 8)
    texts = _texts(1)
    docs = spark.createDataFrame([(k, t, "e") for k, t in enumerate(texts)], D)
    rows = {r.doc_id: r for r in suffixes.suffix_dedup(docs.repartition(3), window=60, gram=12, group=group, passage=passage).collect()}
    want = _bytes_brute(texts, 60)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (rows[k] for k in range(len(texts)))] == want
    assert [rows[k].n_passage for k in range(len(texts))] == [w[1] for w in _bytes_brute(texts, passage)]
    assert sum(w[1] for w in want) > 0


@pytest.mark.parametrize("seed", [2, 3])
def test_words(spark, seed):
    texts = _texts(seed)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(k, t, "e") for k, t in rows], D)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_dedup(docs.repartition(4)).collect()}
    assert got == _words_brute(rows, 13)


def test_repeated_rows_and_null_ids(spark):
    text = "w " * 400
    docs = spark.createDataFrame([(1, text, ""), (1, text, ""), (None, text, ""), (2, text, "")], D)
    rows = substrings.substring_dedup(docs).collect()
    assert sorted((r.doc_id or 99, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 400), (99, 400)]
    assert [r.n_removed for r in suffixes.suffix_dedup(docs).collect()] == [800] * 4


def test_rows_lose_only_their_own_words(spark):
    rng = random.Random(7)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage, long = words(13), words(300)
    texts = [(1, f"{passage} {long}"), (None, f"{passage} {words(20)}"), (None, words(40)), (None, f"{words(5)} {passage}"), (None, long), (None, long), (7, words(30)), (7, f"{words(3)} {passage}"), (7, f"{words(3)} {passage}")]
    docs = spark.createDataFrame([(k, t, "") for k, t in texts], D)
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substrings.substring_dedup(docs.repartition(3)).collect())
    assert got == sorted([(1, 313, 0), (99, 33, 13), (99, 40, 0), (99, 18, 13), (99, 300, 300), (99, 300, 300), (7, 30, 0), (7, 16, 13), (7, 16, 13)])


def test_empty_tables(spark):
    docs = spark.createDataFrame([], D)
    assert suffixes.suffix_dedup(docs).count() == 0 and substrings.substring_dedup(docs).count() == 0


def test_deep_shallow_order():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 30))).encode() for _ in range(200)] + [b"ab" * 100 + bytes([x]) for x in range(20)] * 2
    order, shared = suffixes.sorted_groups(texts, np.array([0, len(texts)]))
    ordered = [texts[k] for k in order]
    assert ordered == sorted(texts) and sorted(order.tolist()) == list(range(len(texts)))
    assert shared[0] == -1 and all(suffixes.common(a, b) == s for a, b, s in zip(ordered, ordered[1:], shared[1:], strict=False))


def test_symbols_agree_inside_equal_substrings():
    rng = np.random.default_rng(3)
    core = rng.integers(1, 2**62, 40).astype(np.uint64)
    found = []
    for _ in range(2):
        names = np.concatenate([rng.integers(1, 2**62, 9).astype(np.uint64), core, rng.integers(1, 2**62, 7).astype(np.uint64)])
        symbols, lo, hi = substrings.recompress(names, np.zeros(len(names), np.int64))
        found.append({(int(s), int(a - 9), int(b - 9)) for s, a, b in zip(symbols, lo, hi, strict=True) if a >= 9 and b <= 49})
    assert found[0] == found[1] and found[0]


def test_words_made_to_collide(spark):
    """Complementary sequences that no sum of powers modulo 2**64 tells apart, as words."""
    for k in (10, 11, 12):
        bits = [bin(i).count("1") % 2 for i in range(1 << k)]
        a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
        docs = spark.createDataFrame([(1, " ".join([a] * 12 + [b])), (2, " ".join([a] * 13)), (3, " ".join([b] * 13))], "doc_id long, text string")
        assert [r.n_removed for r in substrings.substring_dedup(docs).orderBy("doc_id").collect()] == [0, 0, 0]
        items = spark.createDataFrame([(1, " ".join([a] * 10)), (2, " ".join([b] * 10))], "item_id long, text string")
        found = decontaminate.contamination(docs, items).orderBy("doc_id").collect()
        assert [(r.n_hit, r["items"]) for r in found] == [(12, ["1"]), (13, ["1"]), (13, ["2"])]
