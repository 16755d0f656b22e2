"""The filter audit against filters applied one after the other, and its Shapley values against all orders of arbitrary games."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from shiftlens.llm import filters


def _plain(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}

    def fails(row):
        text = row[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        twins = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
        repeat = bool(twins) and (row[0] is None or min(twins) < row[0])
        return [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text), repeat]

    failed = [(r[2] or "", r[0], dict(zip("ABCDE", fails(r), strict=True))) for r in rows]
    out = {}
    for part in {p for p, _, _ in failed}:
        own = [(d, f) for p, d, f in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone, stay = [y for y in left if y[1][x]], [y for y in left if not y[1][x]]
                total[x] += len(gone)
                out[part, "".join(order), step + 1] = [
                    len(stay), len(gone), sum(f[x] for _, f in own) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in own), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
                left = stay
        for order in permutations("ABCDE"):
            for step, x in enumerate(order):
                out[part, "".join(order), step + 1].append(total[x])
    return out


def _rows():
    rng = random.Random(11)
    words = lambda n, few: " ".join(f"w{rng.randrange(few)}" for _ in range(n))
    texts = [words(120, 5000), words(120, 20), words(30, 5000), "ABC DEF", "a #b", "", None, words(100, 10**9), " \x0b\t", "É|é 𝄞", "A" * 1 + "b" * 9, "A" * 2 + "b" * 17, words(60000, 10**6)]
    rows = [(rng.choice([*range(20), None]), rng.choice(texts), rng.choice(["en", "", None, "de"])) for _ in range(150)]
    return rows + rows[:20] + [(7, texts[0], "en")] * 40 + [(None, texts[1], "de")] * 40


def test_audit_against_filters_in_order(spark):
    rows, labels = _rows(), [(k, k % 2, int(k % 3 == 0)) for k in range(15)] + [(1, 0, 1), (1, 1, 0), (None, 1, 1), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    clash = [F.lit(1).alias(c) for c in ("part", "words", "digest", "own", "n", "key", "none", "is_first", "failed", "good", "toxic", "step", "quality")]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filters.audit(docs.select("*", *clash), marks.withColumns({"lang": F.lit("x"), "key": F.lit(0), "none": F.lit(1)}))
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got.collect()} == _plain(rows, labels)
    assert filters.audit(docs.limit(0), marks).count() == 0
    none = filters.audit(docs, marks.limit(0)).agg(F.count("*"), F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (1800, 0, 0)


def test_least_squares_gives_sums_over_orders():
    rng = random.Random(5)
    for n in (1, 2, 3, 5):
        value = [0] + [rng.randint(-9, 99) for _ in range((1 << n) - 1)]
        want = [0] * n
        for order in permutations(range(n)):
            held = 0
            for k in order:
                want[k] += value[held | 1 << k] - value[held]
                held |= 1 << k
        assert [sum(f * v for f, v in zip(row, value, strict=True)) for row in filters.shapley_sums(n)] == want
