"""Language ID: a linear-chain conditional random field labels every word, so code-switched text is followed.

A word is a run of ASCII letters (A-Z lower-cased) and non-ASCII bytes. Its score for a language sums the weights of its
prefixes and suffixes, of its lexicon entry, and the mean weight of its byte trigrams; learned transitions join it to the word
before. Chains are lines. They run side by side in pieces of CHAIN words; what a piece passes on to its neighbours is found first, by
products of its matrices or, with over PRODUCTS languages, by carrying vectors along the line, so that the result is that of the whole line. Forward-backward gives each word's posterior; a text's language is
the one of greatest mean posterior over all its words, and that mean is its score. `label_words` gives the words' own labels.

Null text and text without any letter: `und`, score 0. With no labelled rows to learn from every text is `und`. Ties go to
the language first in order. Every row is labelled for itself and gives one row, also where rows repeat or share a doc_id; an empty table gives an
empty result; other columns are left out, whatever their names. A task holds one whole text with, for each of its words, some 40 fields of 8 bytes and five for each language; at most
PRODUCTS languages add their square for every CHAIN words of long lines.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftlens.llm.quality import held_out
from shiftlens.llm.sampling import likely_sampled, sample_order
from shiftlens.llm.tokens import map_text, mix, owners, prefix_sums, runs, slices, span_names

CHAIN = 64
#: Up to so many languages a long line's pieces are joined by products of matrices; beyond, vectors are carried along it.
PRODUCTS = 16
BITS = 16
_TEMPLATES = 8  # prefixes of 1-3 bytes, suffixes of 1-4, lexicon entry
_WORD = np.zeros(256, bool)
_WORD[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a slice: their distinct kinds with features, and the chains that they form."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = _LOWER[data]
        starts, ends = runs(_WORD[low], offsets)
        sums = prefix_sums(low)
        names = span_names(sums, starts, ends)
        self.row = owners(starts, offsets)
        self.names, at, self.kind = np.unique(names, return_index=True, return_inverse=True)
        s, e = starts[at], ends[at]
        fixed = [span_names(sums, s, np.minimum(s + k, e)) for k in (1, 2, 3)] + [span_names(sums, np.maximum(e - k, s), e) for k in (1, 2, 3, 4)]
        salted = [mix(x + np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1))) for k, x in enumerate(fixed)]
        self.fixed = (np.stack(salted, axis=1) >> np.uint64(64 - BITS)).astype(np.int64) if len(s) else np.zeros((0, 7), np.int64)
        n = np.maximum(e - s - 2, 0)
        self.tri_from = np.concatenate([[0], np.cumsum(n)])
        first = np.arange(n.sum()) - np.repeat(self.tri_from[:-1], n) + np.repeat(s, n)
        self.tri = (mix(span_names(sums, first, first + 3) + np.uint64(11)) >> np.uint64(64 - BITS)).astype(np.int64)
        # Chains: a new one at a new row, after a newline, and after CHAIN words.
        lines = np.concatenate([[0], np.cumsum(low == 10)])[starts] if len(low) else np.zeros(0, np.int64)
        fresh = np.concatenate([[True], (self.row[1:] != self.row[:-1]) | (lines[1:] != lines[:-1])]) if len(s) else np.zeros(0, bool)
        begin = np.flatnonzero(fresh)
        place = np.arange(len(starts)) - np.repeat(begin, np.diff(np.append(begin, len(starts))))
        begin = np.flatnonzero(place % CHAIN == 0)
        long = np.diff(np.append(begin, len(starts)))
        self.order = np.argsort(-long, kind="stable")
        self.begin, self.long = begin[self.order], long[self.order]
        #: How many pieces of the same chain stand before each piece, in the order of the text.
        self.rank = place[begin] // CHAIN
        self.starts, self.ends = starts, ends
        self.inside = np.flatnonzero(place)  # words with a word before them in the chain


def entries(words: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Slot of each kind's lexicon entry."""
    known, slot = lexicon
    if not len(known):
        return np.zeros(len(words.names), np.int64)
    at = np.minimum(np.searchsorted(known, words.names), len(known) - 1)
    return np.where(known[at] == words.names, slot[at], 0)


def emissions(words: Words, entry: np.ndarray, theta: np.ndarray, lexical: np.ndarray) -> np.ndarray:
    """Score of each kind of word for each language."""
    out = theta[words.fixed].sum(axis=1) + lexical[entry]
    n = np.diff(words.tri_from)
    some = np.flatnonzero(n)
    if len(some):
        out[some] += np.add.reduceat(theta[words.tri], words.tri_from[:-1][some], axis=0) / n[some, None]
    return out


def passed_on(words: Words, psi: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each piece of a chain from the words before it and from those after it."""
    k, n = psi.shape[1], len(words.begin)
    before, after = np.ones((n, k)), np.ones((n, k))
    several = np.flatnonzero((words.rank > 0) | (np.append(words.rank[1:], 0) > 0))
    if len(several):
        begin, long = np.empty(n, np.int64), np.empty(n, np.int64)
        begin[words.order], long[words.order] = words.begin, words.long
        (_by_products if k <= PRODUCTS else _by_steps)(words, psi, step, begin, long, several, before, after)
    return before[words.order], after[words.order]


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def _by_products(words: Words, psi: np.ndarray, step: np.ndarray, begin: np.ndarray, long: np.ndarray, several: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """All pieces' matrices side by side, then their products along the chains: k ** 3 a word, in few steps."""
    k, n = psi.shape[1], len(begin)
    through = np.zeros((n, k, k))
    through[several] = psi[begin[several]][:, :, None] * np.eye(k)
    for t in range(1, int(long[several].max())):
        live = several[long[several] > t]
        now = (through[live] @ step) * psi[begin[live] + t][:, None, :]
        through[live] = now / now.max(axis=(1, 2), keepdims=True)
    by_rank = np.argsort(words.rank, kind="stable")
    bounds = np.searchsorted(words.rank[by_rank], np.arange(int(words.rank.max()) + 2))
    ranks = [by_rank[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)][1:]
    for at in ranks:
        before[at] = _scaled((before[at - 1][:, None, :] @ through[at - 1])[:, 0] @ step)
    for at in reversed(ranks):
        after[at - 1] = _scaled((through[at] @ after[at][:, :, None])[:, :, 0] @ step.T)


def _by_steps(words: Words, psi: np.ndarray, step: np.ndarray, begin: np.ndarray, long: np.ndarray, several: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
    """Vectors carried along the long chains, all of them side by side: k ** 2 a word, one step for each word of the longest."""
    first = several[words.rank[several] == 0]
    pieces = np.diff(np.append(np.searchsorted(several, first), len(several)))
    order = np.argsort(-pieces, kind="stable")
    first, pieces = first[order], pieces[order]  # the chains with most pieces first
    vector = np.ones((len(first), psi.shape[1]))
    for r in range(int(pieces[0]) - 1):
        at = first[: int(np.searchsorted(-pieces, -(r + 1), "left"))] + r  # their pieces of rank r, all CHAIN long, as others follow
        now = vector[: len(at)]
        for t in range(CHAIN):
            now = _scaled((now @ step if t else now) * psi[begin[at] + t])
        vector[: len(at)] = before[at + 1] = _scaled(now @ step)
    vector = np.ones((len(first), psi.shape[1]))
    for r in range(int(pieces[0]) - 1, 0, -1):
        at = first[: int(np.searchsorted(-pieces, -r, "left"))] + r
        now = vector[: len(at)]
        for t in range(int(long[at].max()) - 1, -1, -1):
            live = t < long[at]
            moved = _scaled((now * psi[begin[at] + np.minimum(t, long[at] - 1)]) @ step.T)
            now = np.where(live[:, None], moved, now)
        vector[: len(at)] = after[at - 1] = now


def forward_backward(words: Words, emission: np.ndarray, transition: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of every word, and expected transitions if asked for. Pieces of chains run side by side, the longest first."""
    k = emission.shape[1]
    psi = np.exp(emission - emission.max(axis=1, keepdims=True))[words.kind] if len(words.kind) else np.zeros((0, k))
    step = np.exp(transition)
    ahead, behind = np.empty_like(psi), np.ones_like(psi)
    before_piece, after_piece = passed_on(words, psi, step)
    behind[words.begin + words.long - 1] = after_piece
    top = int(words.long.max(initial=0))
    live = [int(np.searchsorted(-words.long, -t, "left")) for t in range(top + 1)]  # chains longer than t
    for t in range(top):
        at = words.begin[: live[t]] + t
        now = psi[at] * (before_piece[: live[t]] if t == 0 else ahead[at - 1] @ step)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    moved = np.zeros((k, k))
    for t in range(top - 1, 0, -1):
        at = words.begin[: live[t]] + t
        back = behind[at] * psi[at]
        if expect:
            before = ahead[at - 1] / np.maximum((ahead[at - 1] @ step * back).sum(axis=1, keepdims=True), 1e-30)
            moved += before.T @ back * step
        now = back @ step.T
        behind[at - 1] = now / now.sum(axis=1, keepdims=True)
    if expect:
        at = words.begin[words.rank[words.order] > 0]
        back = behind[at] * psi[at]
        moved += (ahead[at - 1] / np.maximum((ahead[at - 1] @ step * back).sum(axis=1, keepdims=True), 1e-30)).T @ back * step
    post = ahead * behind
    return post / post.sum(axis=1, keepdims=True), moved


class Model:
    """Weights, bounded by the number of languages and not by the text they were fitted on (but for the lexicon, bounded by the sample)."""

    def __init__(self, **parts: np.ndarray):
        self.parts = parts
        self.theta, self.lexical, self.transition = parts["theta"], parts["lexical"], parts["transition"]
        self.lexicon = parts["known"], parts["slot"]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.parts)
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Model:
        return Model(**np.load(io.BytesIO(data)))

    def posteriors(self, words: Words) -> np.ndarray:
        return forward_backward(words, emissions(words, entries(words, self.lexicon), self.theta, self.lexical), self.transition)[0]


def learn(words: Words, label: np.ndarray, k: int, rounds: int, rate: float, decay: float) -> Model:
    """Gradient ascent on the labels' log-likelihood with per-weight step sizes. Words seen twice or more enter the lexicon
    under the language that uses them most and how exclusively it does."""
    count = np.zeros((len(words.names), k))
    np.add.at(count, (words.kind, label), 1)
    total = count.sum(axis=1)
    share = count.max(axis=1) / np.maximum(total, 1)
    slot = 1 + count.argmax(axis=1) * 3 + (share > 0.6) + (share > 0.95)
    known = total >= 2
    lexicon = words.names[known], slot[known]
    theta, lexical, transition = np.zeros((1 << BITS, k)), np.zeros((1 + 3 * k, k)), np.zeros((k, k))
    weights = [theta, lexical, transition]
    grown = [np.full_like(w, 1e-6) for w in weights]
    entry, n = entries(words, lexicon), len(words.kind)
    seen = np.zeros((k, k))
    np.add.at(seen, (label[words.inside - 1], label[words.inside]), 1)
    tri_n = np.diff(words.tri_from)
    tri_of = np.repeat(np.arange(len(tri_n)), tri_n)
    for _ in range(rounds):
        post, moved = forward_backward(words, emissions(words, entry, theta, lexical), transition, expect=True)
        kinds = count - np.stack([np.bincount(words.kind, post[:, c], len(words.names)) for c in range(k)], axis=1)
        up_theta = np.empty_like(theta)
        for c in range(k):
            up_theta[:, c] = np.bincount(words.fixed.ravel(), np.repeat(kinds[:, c], words.fixed.shape[1]), 1 << BITS) + np.bincount(words.tri, (kinds[:, c] / np.maximum(tri_n, 1))[tri_of], 1 << BITS)
        up_lexical = np.stack([np.bincount(entry, kinds[:, c], len(lexical)) for c in range(k)], axis=1)
        for w, g, up in zip(weights, grown, (up_theta, up_lexical, seen - moved), strict=True):
            up = up / max(1, n) - decay * w
            g += up * up
            w += rate * up / np.sqrt(g)
    return Model(theta=theta.astype(np.float32), lexical=lexical, transition=transition, known=lexicon[0], slot=lexicon[1])


def fit(labelled: DataFrame, rows_per_language: int = 250, most_languages: int = 64, rounds: int = 25, rate: float = 0.3, decay: float = 1e-7) -> tuple[list[str], bytes | None]:
    """Languages and packed model from (doc_id, text, lang): the `most_languages` most frequent ones (the first by name of equals), and of each the
    `rows_per_language` rows of smallest hash, a bounded sample that one task fits."""
    good = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    order = Window.partitionBy("lang").orderBy(sample_order(9, "doc_id"), "doc_id", "text")
    totals = {r["lang"]: r["n"] for r in good.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not totals:
        return [], None
    total = F.create_map(*(F.lit(x) for kv in totals.items() for x in kv))[F.col("lang")]
    some = good.where(F.col("lang").isin(list(totals))).where(likely_sampled(9, rows_per_language, total, "doc_id"))
    rows = some.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language)
    languages = sorted(totals)

    def train(batches):
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        label_of = np.array([languages.index(x) for x in table.column("lang").to_pylist()])
        data, offsets = None, None
        for _, data, offsets in slices(table.to_batches(), most=1 << 40):
            words = Words(data, offsets)
        yield pa.RecordBatch.from_pydict({"model": [learn(words, label_of[words.row], len(languages), rounds, rate, decay).pack()]})

    # The sample goes from the executors to the one task that fits it; only the model comes to the driver.
    one = rows.repartition(1).sortWithinPartitions("lang", "n").select("text", "lang")
    return languages, one.mapInArrow(train, "model binary").first()[0]


def identify(docs: DataFrame, languages: list[str], packed: bytes | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("letter"))
    if not languages:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    models: list[Model] = []

    def run(batch, data, offsets):
        if not models:
            models.append(Model.unpack(shared.value))
        words = Words(data, offsets)
        post = models[0].posteriors(words)
        n = np.bincount(words.row, minlength=batch.num_rows)
        mean = np.stack([np.bincount(words.row, post[:, c], batch.num_rows) for c in range(len(languages))], axis=1) / np.maximum(n, 1)[:, None]
        letter = batch.column("letter").to_numpy(zero_copy_only=False) & (n > 0)
        best = mean.argmax(axis=1)
        pred = [languages[b] if x else "und" for b, x in zip(best, letter, strict=True)]
        score = np.where(letter, np.clip(mean.max(axis=1), 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_text(docs, run, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, languages: list[str], packed: bytes) -> DataFrame:
    """(doc_id, words) of every row of docs(doc_id, text): for each word its bytes in the text from start to end, its language and the posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)
    models: list[Model] = []

    def run(batch, data, offsets):
        if not models:
            models.append(Model.unpack(shared.value))
        words = Words(data, offsets)
        post = models[0].posteriors(words)
        best = post.argmax(axis=1)
        at = [(x - offsets[words.row]).astype(np.int32) for x in (words.starts, words.ends)]
        told = pa.StructArray.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array([languages[b] for b in best], pa.string()), pa.array(post.max(axis=1, initial=0))], ["start", "end", "lang", "score"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(words.row, np.arange(batch.num_rows + 1)).astype(np.int32)), told)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "words"])

    return map_text(docs.select("doc_id", "text"), run, "doc_id long, words array<struct<start:int,end:int,lang:string,score:double>>")


def language_id(docs: DataFrame, rows_per_language: int = 250) -> DataFrame:
    """Learn from documents outside the held-out fold (crc32(doc_id) mod 3 = 1), then label all: (doc_id, held_out, lang_pred, score)."""
    languages, packed = fit(docs.select("doc_id", "text", "lang").where(~held_out(1, 3)), rows_per_language)
    return identify(docs, languages, packed).select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score")
