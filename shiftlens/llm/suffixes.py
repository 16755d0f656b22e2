"""Suffix-array dedup over bytes: repeated strings of WINDOW bytes, found by deep-shallow sorting of sampled suffixes.

Every string of WINDOW bytes picks one of its positions, its anchor: the one whose next GRAM bytes have the least name.
Equal strings pick the same anchor, so it is enough to sort the suffixes at anchors and to look from each anchor to both
sides. Consecutive strings share an anchor; their whole extent is the anchor's context.

1. Anchors are named by their gram. Grams that stand at one anchor only are done with: an aggregation by gram finds the others. Of
   those, anchors with equal contexts form a class, again by aggregation; a class of two or more is repeated as a whole.
   One of each class goes on if other classes share its gram.
2. The contexts of those are sorted, to the right of the anchor and to the left: multikey quicksort down to a shallow
   depth, then a blind trie for each group that still agrees. The common prefixes of neighbours in the two orders tell
   which strings occur twice.
3. A gram with more classes than one task should sort is split into pieces that tasks sort side by side: strings whose start
   lies from j * STEP to j * STEP + STEP - 1 bytes before the anchor all hold the same WINDOW - STEP + 1 bytes, their core, and only those
   that share it can be equal. Pieces become classes and are sorted as in 1 and 2. Cores that still have too many classes are
   split once more with a step of one, where a core is the whole string.

No key is gathered in one task on the way: aggregations combine in the map tasks, and they are joined back to rows, where
adaptive execution splits a frequent key.

Strings of PASSAGE bytes are searched first, in all texts; strings of WINDOW bytes then only inside what those cover, as each
holds some of them. The shorter ones are reported, not removed.

Null text is empty. Texts of under WINDOW bytes lose nothing. Identical rows repeat each other like any two texts. An empty table gives
an empty result; other columns are left out, whatever their names. Long texts are searched in overlapping pieces of PIECE bytes;
a task that cuts or cleans a text holds that one text and its spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.stored import Steps, row_name, stored
from shiftlens.llm.tokens import map_text, mix, owners, prefix_sums, signed, slices, span_names

WINDOW = 400
PASSAGE = 240
GRAM = 48
SHALLOW = 64
#: Classes of one gram that one task sorts; a context has at most 2 * WINDOW bytes.
GROUP = 1024
STEP = 32
PIECE = 3 << 20
_SORTED_AT_ONCE = 16384
_SPAN = "r0 long, r1 long, from long, to long"
_PLACE = "r0 long, r1 long, at long, count int, anchor int"


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first, count, anchor): strings first .. first + count - 1 of the row share the anchor; positions in `data`."""
    reach = window - gram + 1
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    order = (mix(span_names(sums, at, at + gram)) >> np.uint64(31) << np.uint64(31)) | at.astype(np.uint64)
    padded = np.concatenate([order, np.full(-len(order) % reach, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    first = np.arange(len(data) - window + 1)
    row = owners(first, offsets)
    inside = first + window <= offsets[row + 1]
    first, row = first[inside], row[inside]
    chosen = (np.minimum(behind[first], ahead[first + reach - 1]) & np.uint64((1 << 31) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])])) if len(first) else empty
    return row[edge], first[edge], np.diff(np.append(edge, len(first))), chosen[edge]


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def deep_shallow(texts: list[bytes], rows: list[int], out: list[tuple[int, int]], depth: int = 0, shallow: int = SHALLOW) -> None:
    """Append (row, common prefix with the previous row) in sorted order for rows that agree up to `depth`.
    The first row of the call gets -1, for its caller to set."""
    stack = [(rows, depth, -1)]
    while stack:
        rows, depth, shared = stack.pop()
        if len(rows) == 1:
            out.append((rows[0], shared))
        elif depth >= shallow:
            _blind_trie(texts, rows, out, shared)
        else:
            pivot = texts[rows[len(rows) // 2]][depth : depth + 4]
            less, same, more = [], [], []
            for r in rows:
                part = texts[r][depth : depth + 4]
                (same if part == pivot else less if part < pivot else more).append(r)
            # Neighbours from different parts: their common prefix is read off when both are in place.
            parts = [(less, depth), (same, shallow if len(pivot) < 4 else depth + 4), (more, depth)]
            live = [p for p in parts if p[0]]
            for k in range(len(live) - 1, -1, -1):
                stack.append((live[k][0], live[k][1], shared if k == 0 else -2))


def _blind_trie(texts: list[bytes], rows: list[int], out: list[tuple[int, int]], shared: int) -> None:
    """Sort rows by a blind trie: inner nodes know only a depth and the byte there (-1 past the end); a new text follows
    its own bytes at those depths to some leaf, is compared with that leaf once, and is hung in where they part."""
    root: list = [len(texts[rows[0]]), None, [rows[0]]]  # leaf: depth, None, equal rows; inner: depth, {byte: node}
    sign = lambda text, depth: text[depth] if depth < len(text) else -1
    for r in rows[1:]:
        text, node = texts[r], root
        while node[1] is not None:
            node = node[1].get(sign(text, node[0])) or next(iter(node[1].values()))
        other = texts[node[2][0]]
        parts = common(text, other)
        if parts == len(text) == len(other):
            node[2].append(r)
            continue
        above, node = None, root
        while node[1] is not None and node[0] < parts:
            above, node = (node, sign(text, node[0])), node[1][sign(text, node[0])]
        leaf = [len(text), None, [r]]
        if node[1] is not None and node[0] == parts:
            node[1][sign(text, parts)] = leaf
            continue
        inner = [parts, {sign(other, parts): node, sign(text, parts): leaf}]
        if above is None:
            root = inner
        else:
            above[0][1][above[1]] = inner
    stack = [(root, shared)]
    while stack:
        node, shared = stack.pop()
        if node[1] is None:
            out.append((node[2][0], shared))
            out.extend((r, node[0]) for r in node[2][1:])
        else:
            children = sorted(node[1].items())
            stack.extend((child, node[0] if k else shared) for k, (_, child) in reversed(list(enumerate(children))))


def sorted_groups(texts: list[bytes], cuts: np.ndarray, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each group in sorted order, and the common prefix of each with the row before it (-1 at a group's first)."""
    order, shared = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out: list[tuple[int, int]] = []
        deep_shallow(texts, list(range(a, b)), out, depth)
        for k, (r, s) in enumerate(out):
            order[a + k] = r
            shared[a + k] = common(texts[out[k - 1][0]], texts[r]) if s == -2 else s
    return order, shared


def repeated(contexts: list[bytes], anchor: np.ndarray, count: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context of the groups: the least and greatest distance from string start to anchor among its strings
    that also occur in another context of the group; the least is greater than the greatest if there are none."""
    n = len(contexts)
    right = [c[a:] for c, a in zip(contexts, anchor.tolist(), strict=True)]
    left = [c[:a][::-1] for c, a in zip(contexts, anchor.tolist(), strict=True)]
    (by_right, shared_right), (by_left, shared_left) = sorted_groups(right, cuts), sorted_groups(left, cuts)
    least, most = np.full(n, window), np.full(n, -1)
    far, near = anchor, anchor - count + 1
    in_left, in_right = np.empty(n, np.int64), np.empty(n, np.int64)
    for distance in range(int(near.min()), int(far.max()) + 1):
        live = np.flatnonzero((near <= distance) & (distance <= far))
        if len(live) < 2:
            continue
        in_left[by_left] = np.cumsum(shared_left < distance)
        in_right[by_right] = np.cumsum(shared_right < window - distance)
        both = in_left[live] * (n + 1) + in_right[live]
        order = np.argsort(both, kind="stable")
        equal = both[order][1:] == both[order][:-1]
        hit = live[order[np.append(equal, False) | np.append(False, equal)]]
        least[hit] = np.minimum(least[hit], distance)
        most[hit] = np.maximum(most[hit], distance)
    return least, most


def pieces(batches: Iterator[pa.RecordBatch], window: int, piece: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices (batch, base, data, offsets); a row of more than `piece` bytes comes in pieces, each with the first window - 1 bytes
    of the next one, and base says where in the row it starts."""
    for batch, data, offsets in slices(batches):
        if batch.num_rows > 1 or len(data) <= piece:
            yield batch, batch.column("base").to_numpy(), data, offsets
        else:
            base = batch.column("base").to_numpy()
            for a in range(0, max(1, len(data) - window + 1), piece):
                part = data[a : a + piece + window - 1]
                yield batch, base + a, part, np.array([0, len(part)])


def combine(*names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct combination of names, and for every place how many share it there (0 at the others)."""
    order = np.argsort(mix(names[0] * np.uint64(3) + names[1]), kind="stable")
    edge = np.zeros(len(order), bool)
    edge[:1] = True
    for name in names:
        edge[1:] |= name[order][1:] != name[order][:-1]
    edge = np.flatnonzero(edge)
    n = np.zeros(len(order), np.int32)
    n[order[edge]] = np.diff(np.append(edge, len(order)))
    return order[edge], n


def sampled(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """The anchors of docs(r0, r1, base, text): gram name, context name, place, and n: 2 where other members of the class, which then
    have n = 0 and are settled, stand in the same slice, else 1."""
    schema, piece = f"key long, span long, {_PLACE}, n int", PIECE

    def run(batches):
        for batch, base, data, offsets in pieces(batches, window, piece):
            row, first, count, at = anchors(data, offsets, window, gram)
            if not len(at):
                continue
            sums = prefix_sums(data)
            key = span_names(sums, at, at + gram)
            span = mix(span_names(sums, first, first + count + window - 1) + (at - first).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A35))
            n = np.minimum(combine(key, span)[1], 2)
            columns = [signed(key), signed(span), *(batch.column(c).to_numpy()[row] for c in ("r0", "r1")), base[row] + first - offsets[row], count.astype(np.int32), (at - first).astype(np.int32), n]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def settle(step: Steps, rows: DataFrame, window: int, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """From rows(key, span, place, n): the spans of classes with several members, and one member of every class that shares its
    key with others, with the number of classes there."""
    place = ["r0", "r1", "at", "count", "anchor", *carried]
    rows = step.stored(rows)
    # Tables of keys are stored before they are joined: both sides of the join are then dealt for it, and a frequent key can be split.
    several = step.stored(rows.where("n > 0").groupBy("key").agg(F.sum("n").alias("members")).where("members > 1").select("key"))
    met = step.stored(rows.where("n > 0").join(several, "key"))
    classes = step.stored(met.groupBy("key", "span").agg(F.sum("n").alias("members"), F.min(F.struct(*place)).alias("one")))
    shared = step.stored(classes.groupBy("key").agg(F.count("*").alias("classes")).where("classes > 1"))
    open_ = classes.join(shared, "key").select("key", "classes", *(F.col("one").getField(c).alias(c) for c in place))
    twice = met.join(classes.where("members > 1").select("key", "span"), ["key", "span"])
    spans = rows.where("n = 0").select("r0", "r1", "at", "count").unionByName(twice.select("r0", "r1", "at", "count"))
    return spans.selectExpr("r0", "r1", "at as from", f"at + count + {window - 1} as to"), open_


def with_contexts(docs: DataFrame, open_: DataFrame, window: int) -> DataFrame:
    """open_ with the bytes of each context, cut from docs(r0, r1, base, text). One list a text, no longer than the text has anchors."""
    fields = ["key", "classes", "at", "count", "anchor"]
    lists = open_.groupBy("r0", "r1").agg(F.collect_set(F.struct(*fields)).alias("open"))
    schema = f"key long, classes long, {_PLACE}, context binary"

    def run(batch, data, offsets):
        opened = batch.column("open")
        flat, of = opened.flatten(), np.repeat(np.arange(batch.num_rows), opened.value_lengths().to_numpy())
        start = flat.field("at").to_numpy() - batch.column("base").to_numpy()[of]
        end = start + flat.field("count").to_numpy() + window - 1
        inside = np.flatnonzero((start >= 0) & (end <= np.diff(offsets)[of]))
        flat, of = flat.take(pa.array(inside)), of[inside]
        cut = [data[a:b].tobytes() for a, b in zip((start[inside] + offsets[of]).tolist(), (end[inside] + offsets[of]).tolist(), strict=True)]
        rows = [batch.column(c).take(pa.array(of)) for c in ("r0", "r1")]
        return pa.RecordBatch.from_arrays([flat.field("key"), flat.field("classes"), *rows, *(flat.field(c) for c in fields[2:]), pa.array(cut, pa.binary())], [x.split()[0] for x in schema.split(", ")])

    own = F.expr("filter(open, x -> x.at >= base and x.at < base + octet_length(text))")  # a text may come in several stretches
    return map_text(docs.join(lists, ["r0", "r1"]).withColumn("open", own), run, schema)


def sorted_spans(contexts: DataFrame, window: int) -> DataFrame:
    """The repeated strings among contexts that share a key, by sorting them."""

    def sort(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _SORTED_AT_ONCE:
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                whole = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
                if whole:
                    yield found(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield found(pa.Table.from_batches(held))

    def found(table: pa.Table) -> pa.RecordBatch:
        key, at, count, anchor = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "at", "count", "anchor"))
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        least, most = repeated(table.column("context").to_pylist(), anchor, count, cuts, window)
        hit = np.flatnonzero(least <= most)
        q = at[hit] + anchor[hit]
        return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks().take(pa.array(hit)) for c in ("r0", "r1")), pa.array(q - most[hit]), pa.array(q - least[hit] + window)], ["r0", "r1", "from", "to"])

    return contexts.select("key", "r0", "r1", "at", "count", "anchor", "context").repartition("key").sortWithinPartitions("key").mapInArrow(sort, _SPAN)


def split(contexts: DataFrame, window: int, step: int) -> DataFrame:
    """Contexts cut into pieces by the distance from string start to anchor, keyed by what all strings of a piece hold."""
    schema = f"key long, span long, {_PLACE}, n int, context binary"

    def named(text: bytes, *where: int) -> int:
        return int.from_bytes(hashlib.blake2b(text, digest_size=8, key=repr(where).encode()).digest(), "little", signed=True)

    def run(batches):
        for batch in batches:
            out = []
            for key, r0, r1, at, count, anchor, text in zip(*(batch.column(c).to_pylist() for c in ("key", "r0", "r1", "at", "count", "anchor", "context")), strict=True):
                for j in range((anchor - count + 1) // step, anchor // step + 1):
                    far, near = min(anchor, j * step + step - 1), max(anchor - count + 1, j * step)
                    core = text[anchor - j * step : anchor - j * step + window - step + 1]
                    own = text[anchor - far : anchor - near + window]
                    out.append((named(core, key, j), named(own, key, j, far), r0, r1, at + anchor - far, far - near + 1, far, 1, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 5 + [pa.int32()] * 3 + [pa.binary()], strict=True)], [x.split()[0] for x in schema.split(", ")])

    return contexts.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(r0, r1, from, to): spans of docs(r0, r1, base, text), counted from base, that repeated strings cover. Runs its jobs when called."""
    with Steps(docs.sparkSession) as step:
        spans, open_ = settle(step, sampled(docs, window, gram), window)
        contexts = step.stored(with_contexts(docs, open_, window))
        spans = spans.unionByName(sorted_spans(contexts.where(F.col("classes") <= group), window))
        for long in (STEP, 1):
            crowded = contexts.where(F.col("classes") > group)
            if crowded.isEmpty():
                break
            more, open_ = settle(step, split(crowded, window, long), window, ("context",))
            contexts = step.stored(open_)
            spans = spans.unionByName(more).unionByName(sorted_spans(contexts.where(F.col("classes") <= group), window))
        return stored(spans)


def covered(docs: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """(r0, r1, base, text): the stretches of docs(r0, r1, text) of at least `window` bytes that spans cover without a gap."""
    lists = spans.groupBy("r0", "r1").agg(F.collect_set(F.struct("from", "to")).alias("spans"))

    def run(batch, data, offsets):
        row, a, b = unions(batch.column("spans"), offsets)
        long = np.flatnonzero(b - a >= window)
        row, a, b = row[long], a[long], b[long]
        rows = [batch.column(c).take(pa.array(row)) for c in ("r0", "r1")]
        return pa.RecordBatch.from_arrays([*rows, pa.array(a - offsets[row]), pa.array([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], ["r0", "r1", "base", "text"])

    return map_text(docs.join(lists, ["r0", "r1"]).select("r0", "r1", "text", "spans"), run, "r0 long, r1 long, base long, text binary")


def unions(spans: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end in the slice of the maximal runs that each row's list of spans (from, to) covers."""
    flat, row = spans.flatten(), np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy())
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    # A gap of one between rows keeps their runs apart.
    a, b = (flat.field(c).to_numpy() + offsets[row] + row for c in ("from", "to"))
    order = np.argsort(a, kind="stable")
    a, b, row = a[order], np.maximum.accumulate(b[order]), row[order]
    edge = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    row = row[edge]
    return row, a[edge] - row, b[np.append(edge[1:], len(b)) - 1] - row


def remove_spans(docs: DataFrame, spans: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage, kept): docs(doc_id, r0, r1, text) without the bytes in spans."""
    both = spans.withColumn("gone", F.lit(True)).unionByName(passages.withColumn("gone", F.lit(False)))
    which = lambda gone: F.collect_set(F.when(F.col("gone") == gone, F.struct("from", "to"))).alias("spans" if gone else "passages")
    lists = both.groupBy("r0", "r1").agg(which(True), which(False))

    def run(batch, data, offsets):
        size, n = np.diff(offsets), batch.num_rows
        row, a, b = unions(batch.column("spans"), offsets)
        removed = np.bincount(row, b - a, n).astype(np.int64)
        inside, x, y = unions(batch.column("passages"), offsets)
        first = np.searchsorted(row, np.arange(n + 1))
        kept = []
        for k in range(n):
            own = slice(first[k], first[k + 1])
            starts, ends = np.append(offsets[k], b[own]), np.append(a[own], offsets[k + 1])
            kept.append(b"".join(data[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)))
        columns = [size, removed, np.diff(first), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), np.bincount(inside, y - x, n).astype(np.int64), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage", "kept"])

    joined = docs.join(lists, ["r0", "r1"], "left").select("doc_id", "text", "spans", "passages")
    return map_text(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long, kept binary")


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, group: int = GROUP, passage: int = PASSAGE) -> DataFrame:
    """One row per document; `kept` has the bytes that are left, and n_passage says how many bytes strings of `passage` bytes
    cover that also start anywhere else. Rows are told apart by a hash of doc_id and text. Finding the spans runs jobs when called."""
    docs = docs.select("doc_id", *row_name("doc_id", "text"), "text")
    passages = repeated_spans(docs.select("r0", "r1", F.lit(0).cast("long").alias("base"), "text"), min(passage, window), gram, group)
    with Steps(docs.sparkSession) as step:
        stretches = step.stored(covered(docs, passages, window))
        spans = repeated_spans(stretches, window, gram, group)
    return remove_spans(docs, spans, passages)
