"""Encoding against the tokenizers library; the transducer against a dictionary."""

import hashlib
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftlens.llm import automaton, encoding, queries


def _library(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(encoding.vocabulary_path())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    return ids, [tokenizer.decode(x, skip_special_tokens=False) for x in ids]


def _texts():
    rng = random.Random(12)
    signs = "abzAZ09'’ \t\n\r\x0b\x0c\x1c\x85\xa0 　#!<|>_-é́ßİıΣσςǅ漢字かな한각𝄞٣̈́\x00﻿‍😀"
    some = ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(400)]
    some += ["".join(rng.choice(["don't ", "WE'LL", "'s", "<|endoftext|>", "<|startoftext|>x", "<|ENDOFTEXT|>", "the cat", "12345", "ὈΔΥΣΣΕΎΣ ", "a" * rng.randint(1, 40)]) for _ in range(9)) for _ in range(60)]
    letters = "".join(rng.choices("abcdefghij", k=40_000))
    return some + [None, "", " \n", "the " * 3, "é" * 900, letters, "=" * 3000, "".join(rng.choices("ab", k=700)), "x" * 257, " ".join(unicodedata.normalize("NFD", "été") for _ in range(9)), " ".join(["very long text"] * 120_000)]


@pytest.mark.parametrize("words", [0, 40, encoding.WORDS])
def test_encode_as_the_library_does(spark, words):
    texts = _texts()
    docs = spark.createDataFrame([(k if k % 7 else None, t) for k, t in enumerate(texts + texts[:30])], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("ids", "n", "word", "class", "decoded")}).repartition(3)
    ids, said = _library(texts + texts[:30])
    want = sorted((str(k if k % 7 else None), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for k, (x, t) in enumerate(zip(ids, said, strict=True)))
    lexicon = encoding.build_lexicon(docs, most=words)
    coded = encoding.encode(docs, lexicon)
    both = encoding.decode(coded)
    got = both.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2("decoded", 256)).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert encoding.encode(docs.limit(0), lexicon, decoded=True).count() == 0
    assert encoding.encode(docs, encoding.build_lexicon(docs.limit(0))).count() == len(want)
    assert sorted(map(tuple, encoding.encode(docs, lexicon, decoded=True).collect()), key=str) == sorted(map(tuple, both.collect()), key=str)


def test_query_and_arrays(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids, said = _library(docs.values())
    want = {d: (len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for d, x, t in zip(docs, ids, said, strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_bpe_encode"](spark, sf).collect()} == want
    table = spark.read.parquet(f"{sf}/documents.parquet")
    arrays = encoding.encode(table, encoding.build_lexicon(table, most=1000)).select("doc_id", encoding.id_array().alias("ids")).collect()
    assert {r.doc_id: r.ids for r in arrays} == dict(zip(docs, ids, strict=True))


def test_frequent_words_are_counted_over_all_rows(spark):
    docs = spark.createDataFrame([("b a a " * 50,), ("A c c, " * 20,), ("once",), ("d" * 65 + " " + "d" * 65,)], "text string").repartition(3)
    assert sorted(encoding.frequent_words(docs, encoding.vocabulary_path())) == [b",", b"a", b"b", b"c"]
    assert encoding.frequent_words(docs, encoding.vocabulary_path(), 1) == [b"a"]
    # Two words share a class of frequency; both or none.
    assert sorted(encoding.frequent_words(docs, encoding.vocabulary_path(), 2)) == [b"a", b"b"]


def test_transducer(tmp_path):
    rng = random.Random(3)
    words = {bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 7))): tuple(rng.choices(range(3), k=rng.randint(0, 4))) for _ in range(2000)}
    (tmp_path / "t").write_bytes(automaton.compile_words(words.items()))
    lexicon = automaton.Lexicon.mapped(str(tmp_path / "t"))
    asked = list(words)[::2] + [bytes(rng.choices(b"abc\xff", k=rng.randint(1, 9))) for _ in range(500)] + [b""]
    known, ids, at = lexicon.look_up(asked)
    for k, word in enumerate(asked):
        assert known[k] == (word in words)
        assert tuple(ids[at[k] : at[k + 1]].tolist()) == words.get(word, ())
    # Shared suffixes: a stem's endings are stored once, and outputs of stems don't keep them apart.
    stems, ends = [f"{a}{b}{c}".encode() for a in "pqrs" for b in "ae" for c in "lmn"], [b"", b"s", b"ing", b"ings", b"ed"]
    regular = automaton.compile_words((s + e, (k, 100 + len(e))) for k, s in enumerate(stems) for e in ends)
    lexicon = automaton.Lexicon(np.frombuffer(regular, np.uint8))
    known, ids, _ = lexicon.look_up([s + e for s in stems for e in ends])
    assert known.all() and ids.tolist() == [x for k in range(len(stems)) for e in ends for x in (k, 100 + len(e))]
    assert lexicon.states() < 1 + 4 + 8 + 10
    empty = automaton.Lexicon(np.frombuffer(automaton.compile_words([]), np.uint8))
    assert not empty.look_up([b"a", b""])[0].any()
