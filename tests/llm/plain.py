"""Near duplicates said without the library."""

import math
import re
from collections import Counter


def tfidf(texts, common):
    """Weights of each text's shingles, said without the library."""
    bags = []
    for t in texts:
        w = ["".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        n = min(5, len(w))
        bags.append(Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else Counter())
    df = Counter(s for bag in bags for s in bag)
    idf = {s: math.log((1 + len(texts)) / (1 + max(n, common * len(texts)))) + 1 for s, n in df.items()}
    return [{s: n * idf[s] for s, n in bag.items()} for bag in bags]


def linked(weights, i, j):
    a, b = weights[i], weights[j]
    least = sum(min(x, b[s]) for s, x in a.items() if s in b)
    return least > 0 and least / (sum(a.values()) + sum(b.values()) - least) >= 0.8 - 1e-9


def classes(weights):
    top = list(range(len(weights)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    pairs = [(i, j) for i in range(len(weights)) for j in range(i) if linked(weights, i, j)]
    for i, j in pairs:
        x, y = find(i), find(j)
        top[max(x, y)] = min(x, y)
    return pairs, {k: find(k) for k in range(len(weights))}
