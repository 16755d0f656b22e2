"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Text is lower-cased (A-Z) and split into words of digits, letters and non-ASCII signs. Every window of
`WINDOW` consecutive words of a benchmark item (the whole item if it is shorter) is a pattern. Patterns of one length
are searched together: a shift table over blocks of two words says how far a window may jump, a zero shift leads to
the bucket of patterns that end in that block and begin with the window's first block, and all their words are compared there, byte by byte.

Null and empty texts have no words and are never contaminated; items without words, and an empty benchmark, give no pattern. An item_id may
have any type and is listed as a string, once a document, however many rows of the benchmark hold it; items with a null item_id mark words but
are not listed. Every input row gives one output row, also where rows share a doc_id or have none. An empty table gives an empty result;
other columns are left out, whatever their names. A task holds one whole text with some 25 times its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.stored import Steps, row_name, stored
from shiftlens.llm.tokens import distinct_words, map_text, mix, owners, prefix_sums, runs, span_names, text_bytes

WINDOW = 10
#: Benchmark text that one search holds in memory; larger benchmarks are searched in several passes, one after the other.
BLOCK_CHARS = 8 << 20
_LANE = 256
_TABLE_BITS = 20
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Text:
    """The lower-cased words of a slice: their bytes, names and rows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.low = _LOWER[data]
        self.starts, self.ends = runs(_WORD[self.low], offsets)
        self.names, self.row = span_names(prefix_sums(self.low), self.starts, self.ends), owners(self.starts, offsets)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))

    def pair(self, second: np.ndarray) -> np.ndarray:
        """Names of the blocks of two words that end at the words `second`."""
        return mix(self.names[second] + self.names[second - 1] * np.uint64(3))

    def spelled(self, word: int, length: int) -> list[bytes]:
        return [self.low[a:b].tobytes() for a, b in zip(self.starts[word : word + length], self.ends[word : word + length], strict=True)]


class Patterns:
    """Windows of one length in a benchmark text, with their shift table and their buckets."""

    def __init__(self, text: Text, at: np.ndarray, length: int, ids: list[str | None]):
        self.text, self.length = text, length
        codes, _ = distinct_words(text.low, text.starts, text.ends)
        windows = np.ascontiguousarray(codes[at[:, None] + np.arange(length)])
        order = np.argsort(windows.view(np.dtype((np.void, windows.itemsize * length))).ravel(), kind="stable")
        at, windows = at[order], windows[order]
        edge = np.flatnonzero(np.append(np.ones(min(len(at), 1), bool), (windows[1:] != windows[:-1]).any(axis=1)))
        #: Each window once, by its first word, and the ids of the items that hold it.
        self.at = at[edge]
        rows = np.split(text.row[at], edge[1:])
        self.items = [frozenset(ids[k] for k in set(own.tolist()) if ids[k] is not None) for own in rows]
        self.block = min(2, length)
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.int32)
        for end in range(self.block - 1, length):
            np.minimum.at(self.shift, self._slot(text, self.at + end), length - 1 - end)
        key = self._bucket(text, self.at)
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def _slot(self, text: Text, end: np.ndarray) -> np.ndarray:
        name = text.pair(end) if self.block == 2 else mix(text.names[end])
        return (name >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _bucket(self, text: Text, first: np.ndarray) -> np.ndarray:
        """Names of a window's last and first block together."""
        if self.block == 1:
            return mix(text.names[first])
        return mix(text.pair(first + self.length - 1) * np.uint64(5) + text.pair(first + 1))

    def search(self, text: Text) -> tuple[list[int], list[int]]:
        """(first word, pattern) of every occurrence within a row. Lanes of the word sequence are searched side by side."""
        cursor = np.arange(0, len(text.names), _LANE)
        stop = np.minimum(cursor + _LANE, len(text.names))
        cursor = np.maximum(cursor, self.length - 1)
        at, pattern = [], []
        while len(cursor):
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
            jump = self.shift[self._slot(text, cursor)]
            end = cursor[jump == 0]
            first = end - self.length + 1
            first = first[text.row[first] == text.row[end]]
            if len(first):
                key = self._bucket(text, first)
                lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
                for k in np.flatnonzero(hi > lo):
                    for p in self.order[lo[k] : hi[k]]:
                        if text.spelled(first[k], self.length) == self.text.spelled(self.at[p], self.length):
                            at.append(int(first[k]))
                            pattern.append(int(p))
            cursor = cursor + np.maximum(jump, 1)
        return at, pattern


def compile_patterns(items: pa.Table, window: int) -> list[Patterns]:
    """Patterns by length, from items(item_id, text)."""
    data, offsets = text_bytes(items.column("text").combine_chunks())
    text, ids = Text(data, offsets), items.column("item_id").to_pylist()
    size = np.diff(text.first)
    long = np.minimum(size, window)[text.row]  # of the row's patterns
    at = np.arange(len(text.names))
    whole = at + long <= text.first[1:][text.row]
    return [Patterns(text, at[whole & (long == n)], int(n), ids) for n in np.unique(long)]


def find(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, r0, r1, n_words, spans, items): word spans of docs(doc_id, r0, r1, text) that the shared patterns cover."""
    schema = "doc_id long, r0 long, r1 long, n_words long, spans array<struct<from:long,to:long>>, items array<string>"

    def run(batch, data, offsets):
        text = Text(data, offsets)
        spans, items = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
        for group in shared.value:
            for at, p in zip(*group.search(text), strict=True):
                doc = text.row[at]
                from_ = int(at - text.first[doc])
                spans[doc].append({"from": from_, "to": from_ + group.length})
                items[doc] |= group.items[p]
        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        columns = [pa.array(np.diff(text.first)), pa.array(spans, span), pa.array([sorted(own) for own in items], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "r0", "r1")), *columns], [x.split()[0] for x in schema.replace("from:long,to", "").split(", ")])

    return map_text(docs, run, schema)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, r0, r1, n_words, spans, items) of every row of docs(doc_id, text).

    The benchmark's size is read first. Up to `block_chars` it is searched in one pass without a shuffle; beyond that it is dealt by
    hash into blocks of about that size. Their passes run when this is called, one after the other; only one block's table is shared at a
    time, and what the later passes find is merged by row."""
    spark = docs.sparkSession
    docs, tests = docs.select("doc_id", *row_name("doc_id", "text"), "text"), benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_chars))
    dealt = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))

    def block(k: int):
        return spark.sparkContext.broadcast(compile_patterns(dealt.where(F.col("block") == k).select("item_id", "text").toArrow(), window))

    if n == 1:
        return find(docs, block(0))
    with Steps(spark) as step:
        passes = []
        for k in range(n):
            shared = block(k)
            found = find(docs, shared)
            passes.append(step.stored(found if k == 0 else found.where("size(spans) > 0").drop("doc_id", "n_words")))
            shared.destroy()
        more = passes[1]
        for other in passes[2:]:
            more = more.unionByName(other)
        more = more.groupBy("r0", "r1").agg(F.flatten(F.collect_set("spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
        both = lambda a: F.array_distinct(F.concat(a, F.coalesce(f"more_{a}", F.slice(a, 1, 0)))).alias(a)
        return stored(passes[0].join(more, ["r0", "r1"], "left").select("doc_id", "r0", "r1", "n_words", both("spans"), both("items")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, and the row's name r0, r1."""
    found = occurrences(docs, benchmark, window, block_chars)
    hit = F.expr("aggregate(array_sort(spans), struct(0L as n, 0L as reach), (a, s) -> struct(a.n + greatest(0L, s.to - greatest(s.from, a.reach)) as n, greatest(a.reach, s.to) as reach)).n")
    listed = F.array_sort("items")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), listed.alias("items"), "r0", "r1")
