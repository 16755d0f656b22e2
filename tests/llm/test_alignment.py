"""Alignment against both tokenizers run on whole texts, their tokens compared byte by byte."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from shiftlens.llm import alignment, queries
from shiftlens.llm.encoding import byte_signs


def _spans(tokens):
    end, out = 0, []
    for t in tokens:
        out.append((end, end + len(t)))
        end += len(t)
    return out


def _plain(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of all texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = alignment.tokenizer_paths()
    one, two = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    one.encode_special_tokens = True
    byte = {s: b for b, s in enumerate(byte_signs())}
    spell_a = lambda k: bytes(byte[s] for s in one.id_to_token(k))
    spell_b = lambda k: bytes([int(two.id_to_piece(k)[3:-1], 16)]) if two.is_byte(k) else two.id_to_piece(k).replace("▁", " ").encode()
    rows = []
    for text in texts:
        if not text:
            rows.append(([], [], [], []))
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        said_a, said_b, want = [spell_a(k) for k in a], [spell_b(k) for k in b], (" " + text).encode()
        if b"".join(said_a) != want or b"".join(said_b) != want:
            rows.append(([], [], [], []))
            continue
        at_a, at_b = _spans(said_a), _spans(said_b)
        shared = sorted({e for _, e in at_a} & {e for _, e in at_b})
        links, j = [], 0
        for i, (s, e) in enumerate(at_a):
            while at_b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and at_b[k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for end in shared:
            p, q = i, j
            while i < len(a) and at_a[i][1] <= end:
                i += 1
            while j < len(b) and at_b[j][1] <= end:
                j += 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
        rows.append((a, b, groups, links))
    count = Counter(x for r in rows for x in r[3])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (len(a), len(b), len(g), len(x), sum(count[y] == most[y[1]] for y in x), sum(count[y] for y in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for a, b, g, x in rows
    ], count


def _rows(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def _texts():
    rng = random.Random(13)
    signs = "abzAZ09'  ..,!\t\n\r\x0b\x1c\x85\xa0 　▁é́ß漢字한𝄞\x00﻿‍😀<>|_-=/"
    some = ["".join(rng.choices(signs, k=rng.randint(1, 50))) for _ in range(300)]
    some += ["".join(rng.choice([" the", " don't", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "  two", " été", " 12345", " Ünïcode", "\n\n", " a\xa0 b", "x " * 3, " antidisestablishmentarianism"]) for _ in range(12)) for _ in range(80)]
    return some + [None, "", " ", "  ", "\n", "▁", "a ▁ b", "word", " word", "word ", "e" * 900, "".join(rng.choices("abcde", k=9000)), "== " * 500, "a b " * 20_000, *(["copies of one text, many of them"] * 40)]


def test_alignment_byte_by_byte(spark):
    texts = _texts()
    docs = spark.createDataFrame([(k if k % 9 else None, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "pair", "pairs", "n", "best", "windows", "place")}).repartition(3)
    plain, count = _plain(texts)
    want = sorted((str(k if k % 9 else None), *r) for k, r in enumerate(plain))
    for block_bytes in (1, 5000, alignment.BLOCK):
        assert _rows(alignment.align(docs, block_bytes=block_bytes)) == want
    assert alignment.align(docs.limit(0)).count() == 0
    assert _rows(alignment.align(docs.where("text is null or text = ''")))[0][1:] == (0,) * 6 + ("",)
    pairs = alignment.id_pairs(alignment.pair_counts(alignment.aligned_blocks(docs, alignment.tokenizer_paths()).where("pairs is not null")))
    assert {(r.id_a, r.id_b): r.n for r in pairs.collect()} == dict(count)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    plain, _ = _plain([r.text for r in docs])
    assert _rows(queries.QUERIES["op13_token_alignment"](spark, sf)) == sorted((str(d.doc_id), *r) for d, r in zip(docs, plain, strict=True))


def test_pieces_are_cut_only_where_neither_side_joins():
    texts = ["a b  c\xa0 d e", " f g", "h　 i j\tk l "]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    data, offsets = alignment.with_spaces(data, offsets)
    said = [x.tobytes().decode() for x in np.split(data, alignment.piece_starts(data, offsets, True)[1:])]
    assert said == [" a", " b  c\xa0 d", " e", "  f", " g", " h　 i", " j\tk", " l "]
    assert len(alignment.piece_starts(data, offsets, False)) == 3
