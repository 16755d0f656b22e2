"""Substring dedup over words by recompression.

A word is a maximal run of bytes other than space and \\t-\\r. A word is removed if a window of WINDOW consecutive words
that covers it also starts in a document with a smaller doc_id.

Recompression: runs of one word get a symbol, then two rounds pair neighbouring symbols: in each round the symbol's own
name says whether it may stand left or right in a pair. A symbol's name is a 64-bit fingerprint of its parts, so all
tasks give it the same one before they have met. What decides are two independent names of 64 bits, made from two halves of each word's
cryptographic digest: one of a symbol's context and one of the span filed with it, or both of a window. Whether a symbol arises depends on its own words and its nearest neighbours only
(its context), so equal substrings have equal symbols inside. Every window is filed under the least-named symbol whose
context it holds; consecutive windows share one, so about one row for five words reaches Spark. There

1. one aggregation collects the names of all symbols of the corpus with the least and the greatest document that hold each.
   Symbols of a single document hold no repeat and go;
2. a second one names what the shared symbols carry, the whole span of windows filed with each, with its least document: all other
   documents' rows of that span are repeats at once. Rows that are first in their span, but whose symbol carries other
   spans too, stay open;
3. a third one names the single windows of open rows, with the least document of each, and verifies them against it.

Names are aggregated in the map tasks first and joined back to the rows that hold them; no symbol's rows are gathered in one task.

Null text has no words; documents of under WINDOW words lose nothing. Spans belong to rows, named by a hash of id and text:
of rows that share a doc_id each loses the words of its own repeated windows, and they don't remove each other. A null
doc_id is larger than any other, and such rows don't remove each other either. An empty table gives an empty result; other columns
are left out, whatever their names. A task holds one whole text with some 60 times its words' number in 8-byte fields.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.stored import Steps, row_name, stored
from shiftlens.llm.tokens import SPACE, map_text, mix, owners, prefix_sums, runs, signed, span_names, word_names

WINDOW = 13
_ROUNDS = 2
_LAST = np.iinfo(np.int64).max
#: What names a row: a hash of doc_id and text, and the doc_id, or a second hash where there is none.
_ROW = ["r0", "doc", "none"]
_SCHEMA = "r0 long, doc long, none boolean"
_ORDER = f"if(none, {_LAST}L, doc)"
_NOT_SPACE = ~SPACE


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row."""
    starts, ends = runs(_NOT_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def recompress(names: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the symbols after all rounds, and the word span [lo, hi) of each one's context."""
    n = len(names)
    edge = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (row[1:] != row[:-1])]))
    long = np.diff(np.append(edge, n)).astype(np.uint64)
    symbols = np.where(long > 1, mix(names[edge] + long * np.uint64(0xA24BAED4963EE407)), names[edge])
    lo, hi, row = edge - 1, np.append(edge[1:], n) + 1, row[edge]
    for k in range(_ROUNDS):
        left = (mix(symbols ^ np.uint64(0x9FB21C651E98DF25 + k)) >> np.uint64(40)) & np.uint64(1) == 1
        joined = np.append(left[:-1] & ~left[1:] & (row[1:] == row[:-1]), False)
        taken = np.append(False, joined[:-1])
        # A symbol stays single because of the neighbour that it could have paired with: its context takes that one in.
        lo_, hi_ = lo.copy(), hi.copy()
        alone = ~joined & ~taken
        right = np.flatnonzero(alone & ~left)
        right = right[right > 0]
        lo_[right] = lo[right - 1]
        rest = np.flatnonzero(alone & left)
        rest = rest[rest < len(symbols) - 1]
        hi_[rest] = hi[rest + 1]
        at = np.flatnonzero(joined)
        hi_[at] = hi[at + 1]
        symbols = symbols.copy()
        symbols[at] = mix(symbols[at] * np.uint64(0xE7037ED1A0B428DB) + symbols[at + 1])
        symbols, lo, hi, row = (x[~taken] for x in (symbols, lo_, hi_, row))
    return symbols, lo, hi


def choose(first: np.ndarray, window: int, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For windows that start at the words `first`: the least-named symbol whose context they hold, the leftmost of equals, or -1."""
    order = mix(symbols ^ np.uint64(0x8EBC6AF09C88C6E3))
    a, b = np.searchsorted(lo, first, "left"), np.searchsorted(hi, first + window, "right") - 1
    best = np.full(len(first), -1, np.int64)
    least, width = np.arange(len(symbols)), 1
    while width <= window:
        mine = np.flatnonzero((b - a + 1 >= width) & (b - a + 1 < 2 * width))
        x, y = least[a[mine]], least[b[mine] - width + 1]
        best[mine] = np.where(order[y] < order[x], y, x)
        if len(least) <= width:
            break
        x, y = least[:-width], least[width:]
        least, width = np.where(order[y] < order[x], y, x), 2 * width
    return best


def filed(data: np.ndarray, offsets: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Rows (doc row, first window, number of windows, key, span): consecutive windows that are filed together."""
    starts, ends, before = words(data, offsets)
    names, others = word_names(data, starts, ends)
    row = owners(starts, offsets)
    first = np.arange(len(names))
    first = first[first + window <= before[1:][row]]
    if not len(first):
        return {k: np.zeros(0, np.int64) for k in ("row", "first", "count", "key", "span")} | {"names": names, "before": before}
    symbols, lo, hi = recompress(names, row)
    best = choose(first, window, symbols, lo, hi)
    edge = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (best[1:] < 0) | (first[1:] != first[:-1] + 1)]))
    p, count, best = first[edge], np.diff(np.append(edge, len(first))), best[edge]
    sums, found = prefix_sums(names), best >= 0
    whole = span_names(prefix_sums(others), p, p + count + window - 1)
    lo, hi = np.where(found, lo[best], p), np.where(found, hi[best], p + window)
    key = span_names(sums, lo, hi)
    offset = (p - lo).astype(np.uint64)
    return {"row": row[p], "first": p - before[row[p]], "count": count, "key": key, "span": mix(whole + offset * np.uint64(0x9E6C63D0876A9A35)), "names": names, "before": before}


def combined(doc: np.ndarray, *names: np.ndarray) -> np.ndarray:
    """Which rows are settled here: their class (equal names) also stands in a smaller document of this slice.
    Only the others need to go on, so a class that fills the slice leaves one document's rows."""
    if not len(doc):
        return np.zeros(0, bool)
    order = np.argsort(mix(names[0] * np.uint64(3) + names[1]), kind="stable")
    edge = np.zeros(len(doc), bool)
    edge[0] = True
    for name in names:
        edge[1:] |= name[order][1:] != name[order][:-1]
    edge = np.flatnonzero(edge)
    least = np.repeat(np.minimum.reduceat(doc[order], edge), np.diff(np.append(edge, len(doc))))
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > least
    return out


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.where(batch.column("none").to_numpy(zero_copy_only=False), _LAST, batch.column("doc").to_numpy())


def _batch(schema: str, batch: pa.RecordBatch, of: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns, preceded by the names of the rows `of` that they belong to."""
    rows = [batch.column(c).take(pa.array(of)) for c in _ROW]
    return pa.RecordBatch.from_arrays([*rows, *(pa.array(signed(c) if c.dtype == np.uint64 else c) for c in columns)], [x.split()[0] for x in schema.split(", ")])


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(r0, doc, none, from, to): word spans of docs(r0, doc, none, text) that windows repeated from smaller documents cover. Runs its jobs when called."""
    docs, order = docs.select(*_ROW, "text"), F.expr(_ORDER)
    filed_schema = f"{_SCHEMA}, key long, span long, at int, count int, done boolean"

    def file(batch, data, offsets):
        f = filed(data, offsets, window)
        doc = _ids(batch)[f["row"]]
        done = combined(doc, f["key"].view(np.uint64), f["span"].view(np.uint64))
        return _batch(filed_schema, batch, f["row"], f["key"], f["span"], f["first"].astype(np.int32), f["count"].astype(np.int32), done)

    window_schema = f"{_SCHEMA}, w0 long, w1 long, at int, done boolean"

    def single(batch, data, offsets):
        starts, ends, before = words(data, offsets)
        names = word_names(data, starts, ends)
        open_ = batch.column("open")
        spans, of = open_.flatten(), np.repeat(np.arange(batch.num_rows), open_.value_lengths().to_numpy())
        count = spans.field("count").to_numpy().astype(np.int64)
        at = np.repeat(spans.field("at").to_numpy() - np.cumsum(count) + count, count) + np.arange(count.sum())
        of = np.repeat(of, count)
        p = at + before[of]
        w0, w1 = (span_names(prefix_sums(x), p, p + window) for x in names)
        return _batch(window_schema, batch, of, w0, w1, at.astype(np.int32), combined(_ids(batch)[of], w0, w1))

    with Steps(docs.sparkSession) as step:
        rows = step.stored(map_text(docs, file, filed_schema))
        # Names are stored before they are joined: both sides of the join are then dealt for it, and a frequent name can be split.
        symbols = step.stored(rows.where("not done").groupBy("key").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("key"))
        shared = step.stored(rows.where("not done").join(symbols, "key"))
        carried = step.stored(shared.groupBy("key", "span").agg(F.min(order).alias("least")))
        judged = step.stored(shared.join(carried, ["key", "span"]).select("key", *_ROW, "at", "count", (F.col("least") < order).alias("settled")))
        several = step.stored(carried.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
        # Equal rows have one name and equal spans: a set of them is bounded by one text.
        opened = judged.where("not settled").join(several, "key").groupBy(_ROW).agg(F.collect_set(F.struct("at", "count")).alias("open"))
        windows = step.stored(map_text(docs.join(opened, _ROW), single, window_schema))
        least = step.stored(windows.groupBy("w0", "w1").agg(F.min(order).alias("least"), F.max(order).alias("most")).where("least < most").drop("most"))
        late = windows.where("not done").join(least, ["w0", "w1"]).where(F.col("least") < order)
        hits = windows.where("done").select(*_ROW, "at").unionByName(late.select(*_ROW, "at"))
        whole = rows.where("done").select(*_ROW, "at", "count").unionByName(judged.where("settled").select(*_ROW, "at", "count"))
        spans = whole.selectExpr(*_ROW, "at as from", f"at + count + {window - 1} as to").unionByName(hits.selectExpr(*_ROW, "at as from", f"at + {window} as to"))
        return stored(spans)


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): docs(doc_id, r0, doc, none, text) without the words in spans(r0, doc, none, from, to)."""
    lists = spans.groupBy(_ROW).agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    joined = docs.join(lists, _ROW, "left").select("doc_id", "text", "spans")

    def run(batch, data, offsets):
        starts, ends, before = words(data, offsets)
        listed = batch.column("spans")
        flat, of = listed.flatten(), np.repeat(np.arange(batch.num_rows), listed.value_lengths().fill_null(0).to_numpy())
        n = np.diff(before)
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, before[of] + np.minimum(flat.field("from").to_numpy(), n[of]), 1)
        np.add.at(edges, before[of] + np.minimum(flat.field("to").to_numpy(), n[of]), -1)
        gone = np.cumsum(edges)[:-1] > 0
        row = owners(starts, offsets)
        kept = np.flatnonzero(~gone)
        cover = np.zeros(len(data) + 1, np.int8)
        cover[starts[kept]] += 1
        cover[ends[kept]] -= 1
        mask = np.cumsum(cover, dtype=np.int8)[:-1] > 0
        later = kept[1:][row[kept][1:] == row[kept][:-1]]
        text = data.copy()
        text[starts[later] - 1] = 0x20
        mask[starts[later] - 1] = True
        out = text[mask].tobytes()
        cut = np.concatenate([[0], np.cumsum(mask)])[offsets]
        pieces = [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        removed = np.bincount(row[gone], minlength=batch.num_rows)
        columns = [batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(x).hexdigest() for x in pieces])]
        return pa.RecordBatch.from_arrays([*columns, pa.array([x.decode() for x in pieces])], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return map_text(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document, with the words that are left joined by spaces in `kept`."""
    r0, r1 = row_name("doc_id", "text")
    docs = docs.select("doc_id", r0.alias("r0"), F.coalesce("doc_id", r1).alias("doc"), F.col("doc_id").isNull().alias("none"), "text")
    return remove_spans(docs, repeated_spans(docs, window))
