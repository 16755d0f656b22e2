"""Near duplicates against weights whose document frequencies are exact for every shingle: what one weight for rare shingles changes."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from shiftlens.llm import near_duplicates

LARGER = "/root/testdata/sf0.1"


def _bag(text):
    words = ["".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = min(5, len(words))
    return Counter(" ".join(words[k : k + n]) for k in range(len(words) - n + 1)) if words else Counter()


def _links(texts, queries):
    """(query, other, similarity of 0.8 or more) by TF-IDF with exact frequencies, over all texts."""
    df = Counter()
    for t in texts.values():
        df.update(_bag(t).keys())
    idf = {s: math.log((1 + len(texts)) / (1 + n)) + 1 for s, n in df.items()}
    weigh = lambda t: {s: n * idf[s] for s, n in _bag(t).items()}
    asked, holders = {q: weigh(texts[q]) for q in queries}, defaultdict(list)
    for q, bag in asked.items():
        for s in bag:
            holders[s].append(q)
    total = {q: sum(bag.values()) for q, bag in asked.items()}
    found = set()
    for d, text in texts.items():
        bag, least = weigh(text), defaultdict(float)
        for s, w in bag.items():
            for q in holders.get(s, ()):
                least[q] += min(w, asked[q][s])
        own = sum(bag.values())
        found |= {(q, d) for q, m in least.items() if q != d and m / (own + total[q] - m) >= near_duplicates.SIMILARITY}
    return found


@pytest.mark.parametrize("folder, every", [(None, 1), (LARGER, 100)])
def test_recall_against_exact_frequencies(spark, sf, folder, every):
    docs = spark.read.parquet(f"{folder or sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    links = _links(texts, [d for d in texts if d % every == 0])
    own = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert len(links) > 20
    caught = sum(own[q] == own[d] for q, d in links)
    assert caught >= 0.99 * len(links)
    # Classes hold nothing that exact links don't reach.
    if every == 1:
        reach = {}

        def top(x):
            while reach.setdefault(x, x) != x:
                x = reach[x]
            return x

        for q, d in links:
            a, b = top(q), top(d)
            reach[max(a, b)] = min(a, b)
        apart = sum(own[d] != d and top(d) != top(own[d]) for d in own)
        assert apart <= 0.01 * len(links)


def test_rare_shingles_have_their_own_frequencies(spark):
    """Shingles of 1, 2 and 9 of 1000 documents weigh differently, which links one pair and parts another."""
    w = lambda name, n: [f"{name}{k}" for k in range(n)]
    near, far = w("near", 82), w("far", 86)
    texts = [near + w("u", 10), near + w("v", 10)] + [near[-4:] + w("u", 10)] * 8 + [near[-4:] + w("v", 10)] * 8
    texts += [far + w("x", 10), far + w("y", 10)]
    texts += [w(f"other{k}_", 20) for k in range(1000 - len(texts))]
    lines = {k: " ".join(t) for k, t in enumerate(texts)}
    exact = _links(lines, [0, 18])
    assert (0, 1) in exact and (18, 19) not in exact
    docs = spark.createDataFrame(list(lines.items()), "doc_id long, text string").repartition(3)
    own = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert own[0] == own[1] == 0 and (own[18], own[19]) == (18, 19)


def test_copies_of_a_large_group_do_not_make_it_common(spark):
    """Near copies by frequencies that count one document of their group; texts that share a notice of many others stay apart."""
    rng = random.Random(7)
    w = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    base, notice, texts = w(100), w(45), []
    for k in range(120):
        own = list(base)
        for p in rng.sample(range(100), 1 + k % 3):
            own[p] = w(1)[0]
        texts.append(own)
    texts += [texts[3]] * 30 + [notice + w(10) for _ in range(60)] + [w(60) for _ in range(900)]
    lines = {k: " ".join(t) for k, t in enumerate(texts)}
    bags, df = [_bag(lines[k]) for k in range(150)], Counter()
    for t in lines.values():
        df.update(_bag(t).keys())
    grouped = Counter(s for b in bags for s in b)
    total = len(lines) - 149
    idf = {s: math.log((1 + total) / (1 + max(1, df[s] - max(0, grouped[s] - (s in bags[0]))))) + 1 for b in bags for s in b}
    top = list(range(150))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    weights = [{s: n * idf[s] for s, n in b.items()} for b in bags]
    whole = [sum(x.values()) for x in weights]
    for i in range(150):
        for j in range(i):
            least = sum(min(x, weights[j][s]) for s, x in weights[i].items() if s in weights[j])
            if least >= 0.8 * (whole[i] + whole[j] - least):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(lines.items()), "doc_id long, text string").repartition(3)
    own = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs, copies=False).collect()}
    want = [find(k) for k in range(150)]
    assert len(set(want)) < 90 and sum(own[k] != want[k] for k in range(150)) <= 1
    assert all(own[k] == k for k in range(150, len(lines)))
    plain = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert len({plain[k] for k in range(150)}) > len(set(want)) + 20


def test_groups_of_odd_rows(spark):
    """No rows, no words, and rows that share an id or have none, with frequencies that count one document of each group."""
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, text), (1, text + " x"), (None, text), (2, ""), (3, None), (4, "one two")], "doc_id long, text string")
    assert near_duplicates.near_duplicates(docs.limit(0), copies=False).count() == 0
    got = sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in near_duplicates.near_duplicates(docs, copies=False).collect())
    assert got == [(0, 1, False), (1, 1, False), (1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True)]
