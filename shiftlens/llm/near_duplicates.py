"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A shingle is SHINGLE consecutive words (all words of a shorter text); words are what stands between white space, with A-Z
lower-cased. A shingle's weight is its count in the text times its inverse document frequency, ln((1 + N) / (1 + df)) + 1, with df
the number of the N documents that hold it, counted over all of them for every shingle, however rare.

Frequencies are counted by units of UNIT documents: a unit sends each of its distinct shingles once, with the number of its documents that hold it, to
the part of all names in which it lies; the part adds up, and sends back only what two or more documents hold, so that whatever a unit doesn't get
back is its own. No table of shingles is shared, and a shingle of all documents costs one entry a unit.

In a large group of copies every shingle that they share is frequent by the copies alone, and weighs little beside what each has of its own: the larger the group, the fewer
of its links reach the threshold. With `copies=False` links are verified by frequencies that count one document of each group, which is what buckets hold
together: from each shingle's frequency the other documents of groups that hold it are taken off. Where these are half of it or more, it counts as held by one
document: what is left are mostly copies that share no bucket. Samples are drawn by all documents in either case.

Each of ROWS * BANDS samples draws a shingle and a quantised weight with the probability that two texts share; texts that
agree on all samples of a band meet in a bucket. Similarity is the weighted Jaccard of two texts: sum of minima over sum of maxima.

Identical texts are one class. In a bucket every class is verified against the bucket's least. If more than CROWD classes of a bucket are then
outside its largest component, they are verified against their own least too. Classes that are still outside are compared with all the rest
of their bucket, block against block within tasks, of which only links that join components come out. So no link between
components is lost among classes that share a bucket, pairs are never listed, and a large bucket is work for many tasks.

Null and empty texts have no shingles and no links. Rows with the same doc_id and text count as one document; rows that share a doc_id only are
told apart. A null doc_id is larger than any other; a class of such rows alone has a null class_id, and keeps its rows of one text. An empty table
gives an empty result; other columns are left out, whatever their names. A task holds one whole text with some 40 times its words' number in
8-byte fields, and the frequencies of those shingles of one unit that others hold too. Building the result runs many jobs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.components import components
from shiftlens.llm.stored import Steps, stored
from shiftlens.llm.tokens import SPACE, mix, prefix_sums, runs, signed, slices, span_names

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: The share of documents below which frequencies are not told apart: none.
COMMON = 0.0
_SLOT_BITS = 14
_AT_ONCE = 4096
#: Classes in a block of the last round: a task holds the texts of two blocks.
BLOCK = 256
#: Below so many classes outside, each text of a bucket goes to 16 blocks at most, and another round of stars would save little.
CROWD = 16 * BLOCK
#: Documents in a unit, and how many shingles of one are sent at once.
UNIT, _SENT = 512, 2_000_000
#: Bytes of text for each part of all names: some four million of them.
_PART_BYTES = 24_000_000
_SEED = 20240301
_LAST = np.iinfo(np.int64).max
_NOT_SPACE = ~SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_draws: list[np.ndarray] = []


class Idf(NamedTuple):
    """Names of the common shingles in order, their inverse document frequencies, and the one of all others."""

    names: np.ndarray
    common: np.ndarray
    rare: float

    def of(self, names: np.ndarray) -> np.ndarray:
        out = np.full(len(names), self.rare)
        if len(self.names) and len(names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hit = self.names[at] == names
            out[hit] = self.common[at[hit]]
        return out


def draws() -> list[np.ndarray]:
    """Random variates r ~ Gamma(2, 1), beta ~ U(0, 1) and ln c, c ~ Gamma(2, 1), for each slot and sample. Different bits of a
    shingle's name lead to its slots in the three tables, so hardly two shingles draw all three alike, and every task draws the same."""
    if not _draws:
        rng = np.random.default_rng(_SEED)
        shape = (1 << _SLOT_BITS, BANDS * ROWS)
        r = rng.gamma(2.0, size=shape).astype(np.float32)
        _draws.extend([r, rng.random(shape, np.float32), np.log(rng.gamma(2.0, size=shape)).astype(np.float32)])
    return _draws


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word names of all rows, and the number of words before each row."""
    low = _LOWER[data]
    starts, ends = runs(_NOT_SPACE[low], offsets)
    return span_names(prefix_sums(low), starts, ends), np.searchsorted(starts, offsets)


def shingle_names(data: np.ndarray, offsets: np.ndarray):
    """For each row: its distinct shingles' names in order, and how often each occurs."""
    names, before = words(data, offsets)
    sums = prefix_sums(names)
    n = np.diff(before)
    size = np.minimum(SHINGLE, n)
    count = np.where(n > 0, n - size + 1, 0)
    row = np.repeat(np.arange(len(n)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + before[row]
    name = span_names(sums, first, first + size[row])
    cut = np.concatenate([[0], np.cumsum(count)])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield np.unique(name[a:b], return_counts=True)


def shingles(data: np.ndarray, offsets: np.ndarray, idf: Idf):
    """For each row: its distinct shingles' names in order, and their weights."""
    for name, count in shingle_names(data, offsets):
        yield name, count * idf.of(name)


def sample(name: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sampled shingle and quantised log-weight for each of BANDS * ROWS samples of one text."""
    r, beta, log_c = draws()
    columns = np.arange(BANDS * ROWS)
    best, shingle, level = np.full(len(columns), np.inf, np.float32), np.zeros(len(columns), np.uint64), np.zeros(len(columns), np.int64)
    for k in range(0, len(name), _AT_ONCE):
        own = name[k : k + _AT_ONCE]
        slot, slot_b, slot_c = ((own >> np.uint64(64 - k * _SLOT_BITS)).astype(np.int64) & ((1 << _SLOT_BITS) - 1) for k in (1, 2, 3))
        log_w = np.log(weight[k : k + _AT_ONCE]).astype(np.float32)[:, None]
        own_r = r[slot]
        t = log_w / own_r + beta[slot_b]
        floor = np.floor(t)
        log_a = log_c[slot_c] - log_w - own_r * (1 - (t - floor))
        at = log_a.argmin(axis=0)
        least = log_a[at, columns]
        won = least < best
        best = np.where(won, least, best)
        shingle = np.where(won, own[at], shingle)
        level = np.where(won, floor[at, columns].astype(np.int64), level)
    return shingle, level


def held(docs: DataFrame, parts: int, each: str | None = None) -> DataFrame:
    """(unit, part, names, n): for each unit of docs(unit, text) its distinct shingles in the order of their names, by part, and how many of
    its documents hold each (8 and 2 bytes a shingle). A unit of many shingles, or one that two tasks read, comes in several pieces.
    each: the column that says for how many documents a row counts; n then has 8 bytes."""
    bounds = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)

    def run(batches):
        unit, names, times, size = None, [], [], 0
        for batch, data, offsets in slices(batches):
            units = batch.column("unit").to_pylist()
            counts = batch.column(each).to_pylist() if each else [1] * len(units)
            for own, n, (name, _) in zip(units, counts, shingle_names(data, offsets), strict=True):
                if names and (own != unit or size >= _SENT):
                    yield out(unit, names, times)
                    names, times, size = [], [], 0
                unit = own
                names.append(name)
                times.append(n)
                size += len(name)
        if names:
            yield out(unit, names, times)

    def out(unit, names, times):
        if each:
            name, at = np.unique(np.concatenate(names), return_inverse=True)
            n = np.zeros(len(name), np.int64)
            np.add.at(n, at, np.repeat(np.array(times, np.int64), [len(x) for x in names]))
        else:
            name, n = np.unique(np.concatenate(names), return_counts=True)
        cut = np.concatenate([[0], np.searchsorted(name, bounds), [len(name)]])
        some = np.flatnonzero(np.diff(cut))
        raw, few = name.astype("<u8"), n.astype("<i8" if each else "<u2")
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(some), unit, np.int64)), pa.array(some.astype(np.int32)), pa.array([raw[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary()), pa.array([few[cut[p] : cut[p + 1]].tobytes() for p in some], pa.binary())],
            ["unit", "part", "names", "n"],
        )

    return docs.select("unit", "text", *[each] * bool(each)).mapInArrow(run, "unit long, part int, names binary, n binary")


def counted(pieces: DataFrame, least: int = 2, kind: str = "<u2") -> DataFrame:
    """(unit, names, df): for each piece of held() those of its shingles that `least` or more documents hold, and how many do (8 and 4 bytes a
    shingle). A task holds the names of one part. kind: of the counts in n."""

    def run(batches):
        rows, part = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("part", "unit", "names", "n")), strict=True):
                if rows and row[0] != part:
                    yield from out(rows)
                    rows = []
                part = row[0]
                rows.append(row)
        if rows:
            yield from out(rows)

    def out(rows):
        names = np.frombuffer(b"".join([r[2] for r in rows]), "<u8")
        n = np.frombuffer(b"".join([r[3] for r in rows]), kind)
        order = np.argsort(names)
        ranked = names[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        df = np.empty(len(names), np.int32)
        df[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), first), np.diff(np.append(first, len(names))))
        at = 0
        for lot in range(0, len(rows), 1000):
            units, own, of = [], [], []
            for row in rows[lot : lot + 1000]:
                to = at + len(row[2]) // 8
                some = np.flatnonzero(df[at:to] >= least) + at
                if len(some):
                    units.append(row[1])
                    own.append(names[some].tobytes())
                    of.append(df[some].tobytes())
                at = to
            if units:
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(own, pa.binary()), pa.array(of, pa.binary())], ["unit", "names", "df"])

    return pieces.repartition("part").sortWithinPartitions("part").mapInArrow(run, "unit long, names binary, df binary")


def in_units(docs: DataFrame) -> DataFrame:
    """docs with the unit of each row. The numbers hold for one computation of docs: what needs them twice has to store them."""
    return docs.withColumn("unit", F.expr(f"monotonically_increasing_id() div {UNIT}"))


def part_count(text_bytes: int | None) -> int:
    return max(1, -(-(text_bytes or 0) // _PART_BYTES))


def inverse_frequencies(docs: DataFrame, common: float) -> Idf:
    """Inverse document frequencies of the shingles that `common` of all docs(text) hold, as a table: of as many rows as the mean text has shingles,
    divided by `common`, at most. All others count as held by so many. near_duplicates() needs no such table."""
    docs = docs.select("text")
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    pieces = counted(held(in_units(docs), part_count(size)))

    def run(batches):
        for batch in batches:
            names, df = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind) for c, kind in (("names", "<u8"), ("df", "<i4")))
            name, at = np.unique(names[df >= common * total], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(name)), pa.array(df[df >= common * total][at].astype(np.int64))], ["name", "df"])

    got = pieces.mapInArrow(run, "name long, df long").distinct().toPandas().sort_values("name", key=lambda x: x.astype("uint64"))
    names = got["name"].to_numpy(np.int64).view(np.uint64)
    return Idf(names, np.log((1 + total) / (1 + got["df"].to_numpy(np.float64))) + 1, float(np.log((1 + total) / (1 + common * total)) + 1))


def weights(count: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    return count * (np.log((1 + total) / (1 + df.astype(np.float64))) + 1)


def weighted(data: np.ndarray, offsets: np.ndarray, df: list[bytes], total: int):
    """As shingles(), with the document frequencies that signatures() gives for each row."""
    for k, (name, count) in enumerate(shingle_names(data, offsets)):
        yield name, weights(count, np.frombuffer(df[k], "<i4"), total)


def signatures(units: DataFrame, frequencies: DataFrame, total: int) -> DataFrame:
    """(doc_id, h0, h1, bands, df) of units(unit, doc_id, text): a text's 128-bit name, the names of its samples in each band (none without words),
    and the document frequencies of its distinct shingles in the order of their names (4 bytes each), by frequencies(unit, names, df)."""
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    texts = units.select("unit", F.lit(1).alias("kind"), none("names", "binary"), none("df", "binary"), "doc_id", F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1"), "text")
    told = frequencies.select("unit", F.lit(0).alias("kind"), "names", "df", none("doc_id", "long"), none("h0", "long"), none("h1", "long"), none("text", "string"))

    def run(batches):
        unit, names, df, ready = None, [], [], True
        for batch, data, offsets in slices(batches):
            own, kind = batch.column("unit").to_numpy(), batch.column("kind").to_numpy()
            edges = np.flatnonzero((own[1:] != own[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, len(own)], strict=True):
                if own[a] != unit:
                    unit, names, df, ready = own[a], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], False
                if kind[a] == 0:
                    names += [np.frombuffer(x, "<u8") for x in batch.column("names").slice(a, b - a).to_pylist()]
                    df += [np.frombuffer(x, "<i4") for x in batch.column("df").slice(a, b - a).to_pylist()]
                    continue
                if not ready:
                    known, at = np.unique(np.concatenate(names), return_index=True)
                    of, names, df, ready = np.append(np.concatenate(df)[at], np.int32(1)), [], [], True
                    known = np.append(known, np.uint64(0))  # never found: one past the last name
                yield out(batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], known, of)

    def out(batch, data, offsets, known, of):
        got, frequency = [], []
        for name, count in shingle_names(data, offsets):
            at = np.searchsorted(known[:-1], name)
            df = np.where(known[at] == name, of[at], np.int32(1))
            frequency.append(df.astype("<i4").tobytes())
            got.append(sample(name, weights(count, df, total)) if len(name) else None)
        full = np.array([g is not None for g in got])
        bands = np.zeros(0, np.int64)
        if full.any():
            drawn = mix(np.stack([g[0] for g in got if g]) + np.stack([g[1] for g in got if g]).astype(np.uint64) * np.uint64(0xC6A4A7935BD1E995))
            name = np.zeros((len(drawn), BANDS), np.uint64)
            for k in range(ROWS):
                name = mix(name * np.uint64(3) + drawn[:, k::ROWS])
            bands = signed(name).ravel()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(bands))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h0", "h1")), lists, pa.array(frequency, pa.binary())], ["doc_id", "h0", "h1", "bands", "df"])

    return texts.unionByName(told).repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(run, "doc_id long, h0 long, h1 long, bands array<long>, df binary")


def without_copies(step: Steps, texts: DataFrame, classes: DataFrame, met: DataFrame, total: int) -> tuple[DataFrame, int]:
    """texts(node, text, df) and the number of documents, both counting one document of each group: of classes(node, n) that buckets met(node, pivot) hold together.
    A class has n documents."""
    group = components(met.where("node <> pivot").selectExpr("pivot as a", "node as b"))
    others = classes.join(group, "node").select("node", (F.col("n") - (F.col("node") == F.col("component")).cast("long")).alias("others"))
    marked = step.stored(in_units(texts.join(others, "node")))
    off, size = marked.agg(F.coalesce(F.sum("others"), F.lit(0)), F.sum(F.octet_length("text"))).first()
    told = counted(held(marked, part_count(size), "others"), 1, "<i8").select("unit", F.lit(0).alias("kind"), "names", "df", F.lit(None).cast("long").alias("node"), F.lit(None).cast("string").alias("text"))
    rows = marked.select("unit", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("names"), "df", "node", "text")

    def run(batches):
        unit, names, counts, known, of = None, [], [], None, None
        for batch, data, offsets in slices(batches):
            units, kind, df = batch.column("unit").to_pylist(), batch.column("kind").to_pylist(), batch.column("df").to_pylist()
            told, rows, left = batch.column("names").to_pylist(), [], []
            for k, (name, _) in enumerate(shingle_names(data, offsets)):
                if units[k] != unit:
                    unit, names, counts, known = units[k], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], None
                if kind[k] == 0:
                    names.append(np.frombuffer(told[k], "<u8"))
                    counts.append(np.frombuffer(df[k], "<i4"))
                    continue
                if known is None:
                    known, at = np.unique(np.concatenate(names), return_index=True)
                    of, names, counts = np.append(np.concatenate(counts)[at], np.int32(0)), [], []
                at = np.searchsorted(known, name)
                found = np.zeros(len(name), bool)
                inside = at < len(known)
                found[inside] = known[at[inside]] == name[inside]
                rows.append(k)
                all_, off = np.frombuffer(df[k], "<i4"), np.where(found, of[at], np.int32(0))
                left.append(np.where(off >= all_ - off, np.int32(1), all_ - off).astype("<i4").tobytes())
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), batch.column("text").take(pa.array(rows)), pa.array(left, pa.binary())], ["node", "text", "df"])

    both = rows.unionByName(told).repartition("unit").sortWithinPartitions("unit", "kind")
    return step.stored(both.mapInArrow(run, "node long, text string, df binary")), total - off


def distances(pairs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """(a, b, d) for pairs(a, b), one minus weighted Jaccard of texts(node, text, df). The join on a comes last: rows of one a
    are then mostly neighbours, and its shingles are made once."""
    joined = pairs.join(texts.selectExpr("node as b", "text as text_b", "df as df_b"), "b").join(texts.selectExpr("node as a", "text as text_a", "df as df_a"), "a")

    def run(batches):
        last: tuple = (None, None)
        for batch, data, offsets in slices(batches, "text_b"):
            a, d = batch.column("a").to_pylist(), np.empty(batch.num_rows)
            for k, (name, weight) in enumerate(weighted(data, offsets, batch.column("df_b").to_pylist(), total)):
                if a[k] != last[0]:
                    raw = np.frombuffer(batch.column("text_a")[k].as_py().encode(), np.uint8)
                    last = (a[k], next(weighted(raw, np.array([0, len(raw)]), [batch.column("df_a")[k].as_py()], total)))
                other, heavy = last[1]
                _, i, j = np.intersect1d(name, other, assume_unique=True, return_indices=True)
                least = np.minimum(weight[i], heavy[j]).sum()
                d[k] = 1 - least / (weight.sum() + heavy.sum() - least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(d)], ["a", "b", "d"])

    return joined.select("a", "b", "text_a", "text_b", "df_a", "df_b").mapInArrow(run, "a long, b long, d double")


def compare(texts: list[str], df: list[bytes], side: np.ndarray, own: list, total: int, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that join components `own`, between texts on this side and on the other. Only shingles that two of the texts share
    count for similarities; they are held as one list, text after text."""
    raw = [t.encode() for t in texts]
    got = list(weighted(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), df, total))
    whole = np.array([w.sum() for _, w in got])
    row = np.repeat(np.arange(len(got)), [len(n) for n, _ in got])
    names, at, seen = np.unique(np.concatenate([n for n, _ in got]), return_inverse=True, return_counts=True)
    keep = seen[at] > 1
    row, at, weight = row[keep], at[keep], np.concatenate([w for _, w in got])[keep]
    first = np.searchsorted(row, np.arange(len(got) + 1))
    links, top = [], {c: c for c in own}

    def find(c):
        while top[c] != c:
            c = top[c]
        return c

    mine = np.zeros(len(names))
    for i in np.flatnonzero(side):
        of = slice(first[i], first[i + 1])
        mine[at[of]] = weight[of]
        least = np.bincount(row, np.minimum(mine[at], weight), len(got))
        mine[at[of]] = 0
        for j in np.flatnonzero((least >= similarity * (whole[i] + whole - least) - 1e-9) & ~side):
            a, b = find(own[i]), find(own[j])
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((int(i), int(j)))
    return links


def cross_links(step: Steps, members: DataFrame, texts: DataFrame, total: int, similarity: float) -> DataFrame:
    """(a, b): links between components, of members(band, name, node, own, outside): `own` is the component of a bucket's
    class, and those marked outside are compared with the whole bucket."""
    sizes = step.stored(members.groupBy("band", "name").agg(F.ceil(F.count_if("outside") / BLOCK).alias("o_blocks"), F.ceil(F.count("*") / BLOCK).alias("m_blocks")).where("o_blocks > 0"))
    placed = members.join(sizes, ["band", "name"])
    block = lambda of: F.pmod(F.xxhash64("node"), of)
    each = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    one = placed.withColumns({"o": each("o_blocks"), "m": block("m_blocks"), "side": F.lit(False)})
    other = placed.where("outside").withColumns({"o": block("o_blocks"), "m": each("m_blocks"), "side": F.lit(True)})
    dealt = one.unionByName(other).select(F.xxhash64("band", "name", "o", "m").alias("task"), "side", "node", "own").join(texts, "node")

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "side", "node", "own", "text", "df")), strict=True):
                if held and held[0][0] != row[0]:
                    yield out(held)
                    held = []
                held.append(row)
        if held:
            yield out(held)

    def out(rows):
        links = compare([r[4] for r in rows], [r[5] for r in rows], np.array([r[1] for r in rows]), [r[3] for r in rows], total, similarity)
        return pa.RecordBatch.from_arrays([pa.array([rows[link[k]][2] for link in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return dealt.select("task", "side", "node", "own", "text", "df").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, copies: bool = True) -> DataFrame:
    """(doc_id, class_id, kept, h0, h1) of every row of docs(doc_id, text): class_id is the least doc_id that links reach, kept says
    whether the row stands for its class, and h0, h1 name its text. copies: whether all documents of a group count in the frequencies by which links are
    verified, or one."""
    docs = docs.select("doc_id", "text")
    spark, apart = docs.sparkSession, 1 - similarity + 1e-9
    order = F.coalesce("doc_id", F.lit(int(_LAST)))
    with Steps(spark) as step:
        units = step.stored(in_units(docs))
        total, size = units.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
        frequencies = step.stored(counted(held(units, part_count(size))))
        told = step.stored(signatures(units, frequencies, total))
        signed_ = told.select("doc_id", "h0", "h1", "bands")
        made = signed_.where("size(bands) > 0").groupBy("h0", "h1").agg(F.min(order).alias("o"), F.first("bands").alias("bands"), F.count("*").alias("n"))
        classes = step.stored(made.withColumn("node", F.monotonically_increasing_id()))  # numbered as they are written
        members = classes.select("node", F.posexplode("bands").alias("band", "name"))
        # Tables of buckets are stored before classes are joined to them: Spark then knows their size, and can split a large bucket in the join.
        least = step.stored(members.groupBy("band", "name").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n"))
        met = step.stored(members.join(least, ["band", "name"]))
        wanted = classes.select("node", "o", "h0", "h1").join(met.select("node").distinct(), "node", "left_semi")
        key = ["o", "h0", "h1"]
        # Rows that are alike have one text and one list of frequencies.
        keyed = units.select(order.alias("o"), F.xxhash64("text").alias("h0"), F.xxhash64(F.lit(1), "text").alias("h1"), "text").join(wanted, key).dropDuplicates(key)
        listed = told.select(order.alias("o"), "h0", "h1", "df").join(wanted.select(key), key).dropDuplicates(key)
        texts = step.stored(keyed.join(listed, key).select("node", "text", "df"))
        if not copies:
            texts, total = without_copies(step, texts, classes.select("node", "n"), met, total)

        def verified(stars: DataFrame) -> DataFrame:
            return step.stored(distances(stars.distinct(), texts, total).where(F.col("d") <= apart).select("a", "b"))

        links = verified(met.where("node <> pivot").selectExpr("pivot as a", "node as b"))
        for again in (True, False):
            reached = components(links)
            own = step.stored(met.join(reached, "node", "left").select("band", "name", "node", F.coalesce("component", "node").alias("own")))
            parts = own.groupBy("band", "name", "own").agg(F.count("*").alias("n")).groupBy("band", "name").agg(F.max(F.struct("n", "own")).alias("most"), F.sum("n").alias("all"))
            apart_in = step.stored(parts.where("all > most.n").select("band", "name", F.col("most.own").alias("main"), (F.col("all") - F.col("most.n")).alias("outsiders")))
            own = step.stored(own.join(apart_in, ["band", "name"]).withColumn("outside", F.col("own") != F.col("main")).drop("main"))
            crowd = own.where(F.col("outside") & (F.col("outsiders") > CROWD))
            if not again or crowd.isEmpty():
                break
            first = crowd.groupBy("band", "name").agg(F.min("node").alias("pivot"))
            links = links.unionByName(verified(crowd.join(first, ["band", "name"]).where("node <> pivot").selectExpr("pivot as a", "node as b")))
        second = step.stored(cross_links(step, own.drop("outsiders"), texts, total, similarity))
        if not second.isEmpty():
            reached = components(links.unionByName(second))
        linked = step.stored(classes.select("node", "o", "h0", "h1").join(reached, "node", "left"))
        tops = step.stored(linked.where("component is not null").groupBy("component").agg(F.min(F.struct("o", "h0", "h1")).alias("top")))
        of = linked.join(tops, "component", "left").select("h0", "h1", F.col("o").alias("own"), F.coalesce("top", F.struct("o", "h0", "h1")).alias("top"))
        rows = signed_.select("doc_id", "h0", "h1").join(of, ["h0", "h1"], "left")
        kept = F.coalesce((order == F.col("own")) & (F.col("top.h0") == F.col("h0")) & (F.col("top.h1") == F.col("h1")), F.lit(True))
        class_id = F.coalesce(F.when(F.col("top.o") != int(_LAST), F.col("top.o")), F.when(F.col("top").isNull(), F.col("doc_id")))
        return stored(rows.select("doc_id", class_id.alias("class_id"), kept.alias("kept"), "h0", "h1"))
