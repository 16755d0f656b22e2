"""Quality classifier: hashed word n-grams, logistic regression fitted by follow-the-regularised-leader.

A token is a maximal run of letters and digits, or of other non-space signs. Unigrams, bigrams and repetitions are hashed
into 2**BITS weights; a text's score is the logistic of the mean weight of its n-grams plus a bias, that is a
sparse dot product. Empty and null texts score the bias alone, or what the fit learned from empty ones.

Every row is scored for itself and gives one row, also where rows repeat or share a doc_id; rows of the training sample that share a doc_id all take
its label. An empty table gives an empty result. `score` carries all columns of other names; `classify` leaves other columns out. A task holds one whole
text with some 40 times its tokens' number in 8-byte fields.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.llm.sampling import likely_sampled, sample_order
from shiftlens.llm.tokens import SPACE, map_text, mix, owners, prefix_sums, runs, slices, span_names

BITS = 18
THRESHOLD = 0.7
BIAS = 1 << BITS
_AGAIN = np.array([0x5BF03635F0935AD1], np.uint64)[0]
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACE] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all rows, and the row of each."""
    starts, ends = runs(_KIND[data], offsets)
    row = owners(starts, offsets)
    names = span_names(prefix_sums(data), starts, ends)
    pairs = np.flatnonzero(row[1:] == row[:-1])
    both = mix(names[pairs] * np.uint64(0xC2B2AE3D27D4EB4F) + names[pairs + 1])
    # A word that comes again next, or after one other token, is one and the same n-gram whatever the word.
    word = _KIND[data[starts]] == 1
    both[(names[pairs] == names[pairs + 1]) & word[pairs]] = _AGAIN
    again = np.flatnonzero((row[2:] == row[:-2]) & (names[2:] == names[:-2]) & word[2:]) if len(names) > 2 else np.zeros(0, np.int64)
    grams = np.concatenate([names, both, np.full(len(again), _AGAIN + np.uint64(1 << 63))])
    return (grams >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([row, row[pairs], row[again]])


def _follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    z, n, w = np.zeros(BIAS + 1), np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    for _ in range(epochs):
        for at, x, label in rows:
            step = x * (1 / (1 + np.exp(-np.dot(w[at], x))) - label)
            grown = n[at] + step * step
            z[at] += step - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w[at]
            n[at] = grown
            w[at] = np.where(np.abs(z[at]) > l1, (np.sign(z[at]) * l1 - z[at]) / ((beta + np.sqrt(grown)) / alpha + l2), 0)
    return w


def fit(labelled: DataFrame, sample_rows: int = 8000, shards: int = 4, epochs: int = 4, alpha: float = 2.0, beta: float = 0.01, l1: float = 0.002, l2: float = 0.001) -> np.ndarray:
    """Weights from (doc_id, text, label): a bounded sample of `sample_rows`, the rows of smallest hash, is dealt to
    shards, each is fitted in a task by follow-the-regularised-leader, and the shards' weights are averaged.
    Rows without a label are left out; with no rows at all the weights are zero and every score is 0.5."""
    order = sample_order(7, "doc_id")
    rows = labelled.where("label is not null").select("doc_id", "text", F.col("label").cast("int").alias("label"), order.alias("order"))
    sample = rows.orderBy("order", "doc_id", "text", "label").limit(sample_rows)

    def train(batches):
        rows = []
        for batch, data, offsets in slices(batches):
            at, row = features(data, offsets)
            by_row = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[by_row], np.arange(batch.num_rows + 1))
            for k, label in enumerate(batch.column("label").to_pylist()):
                got, count = np.unique(at[by_row[cuts[k] : cuts[k + 1]]], return_counts=True)
                rows.append((np.append(got, BIAS), np.append(count / max(1, count.sum()), 1.0), label))
        w = _follow_leader(rows, epochs, alpha, beta, l1, l2)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "w": w[at]})

    dealt = sample.repartition(shards, F.pmod("order", F.lit(shards))).sortWithinPartitions("order", "doc_id", "text", "label")
    got = dealt.mapInArrow(train, "at int, w double").groupBy("at").agg((F.sum("w") / shards).alias("w")).toPandas()
    weights = np.zeros(BIAS + 1)
    weights[got["at"].to_numpy()] = got["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """docs with `score` for every row; they need a column text. The weights are 2**BITS + 1 numbers, whatever the input."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch, data, offsets):
        w = shared.value
        at, row = features(data, offsets)
        total = np.bincount(row, w[at], batch.num_rows) / np.maximum(1, np.bincount(row, minlength=batch.num_rows))
        return batch.append_column("score", pa.array(1 / (1 + np.exp(-total - w[BIAS]))))

    return map_text(docs, run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(fold: int, of: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % of == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold (crc32(doc_id) mod 4 = 2). The label rows
    are cut to the bounded sample before the join, so they alone are broadcast and no text is shuffled. A document
    labelled more than once takes its mean label, rounded."""
    # Twice the sample: some labelled ids may not be in docs. 16 bytes a row.
    some = labels.where("quality is not null").where(~held_out(2, 4)).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    some = some.where(likely_sampled(7, 2 * sample_rows, some.count(), "doc_id")).orderBy(sample_order(7, "doc_id"), "doc_id").limit(2 * sample_rows)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = 8000) -> DataFrame:
    """Fit on labels.quality, then score all of docs: (doc_id, held_out, score, predicted)."""
    scored = score(docs.select("doc_id", "text"), fit(training_rows(docs, labels, sample_rows), sample_rows))
    return scored.select("doc_id", held_out(2, 4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
