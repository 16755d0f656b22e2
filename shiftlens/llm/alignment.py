"""Alignment of the tokens that two tokenizers make of the same texts, and how often their ids stand for the same bytes.

A is a byte-level BPE vocabulary, B a sentence-piece model with byte fallback; their files are those of public tokenizers. Both tokenise space + text. Where the
tokens of both end at the same byte a group of tokens ends. Each pair of tokens of A and B with a byte in common is a link.

1. Every text is tokenised in full by both. A shared end before tokens that begin with a space on both sides is an anchor; anchors split
   a text into windows of ids. A window's alignment depends on its ids alone and is remembered by them: a block of texts keeps one list of
   distinct windows with their links, and each text the numbers of its windows.
2. Spark sums the links of each id pair over all blocks, finds the highest sum of each id of B, and brings both back to the blocks that hold the pair.
3. Every block sums them by window, and its texts by their windows.

Texts are handed to the tokenizers in pieces that neither joins: before a single space between other signs no word of A ends later, and B has no
piece with a space behind another sign (where a model has one, whole texts are handed over). Each distinct piece of a block is tokenised once.

Texts that are null, empty, or whose tokens don't spell space + text have no tokens. Every input row gives one row; rows that share a doc_id or have
none are like others. An empty table gives an empty result; other columns are left out, whatever their names. A block ends with the text that
fills it with `BLOCK` bytes, so a task holds one block, or one whole text if that is longer, with some 60 times its bytes.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftlens.llm.encoding import byte_signs, distinct_chunks
from shiftlens.llm.stored import Steps, stored
from shiftlens.llm.tokens import slices

BLOCK = 8 << 20
_SLICE = 1 << 20
#: Ids of B follow those of A in a window's key; an id pair is one number.
_SHIFT = 24
_SPACE_MARK = "▁"
#: Bytes of pieces that are handed over as one text, and how many texts at once.
_JOINED, _AT_ONCE = 1 << 15, 4


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """Ids of pieces of text, and the bytes that each id stands for."""

    ends = ""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.spaced = np.array([x[:1] == b" " for x in spelled])
        #: Ids as they are written within a group, and at the end of a group's side.
        self.written = np.array([f"{k}," for k in range(len(spelled))], object), np.array([f"{k}{self.ends}" for k in range(len(spelled))], object)
        self.digits = np.array([len(x) for x in self.written[0]], np.int64)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join([self.spelled[k] for k in ids.tolist()])


class ByteLevel(Side):
    ends = "|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would wait on the others'
        self._of = Tokenizer.from_file(path)
        self._of.encode_special_tokens = True
        byte = {s: b for b, s in enumerate(byte_signs())}
        special = {k: t.content for k, t in self._of.get_added_tokens_decoder().items()}
        tokens = [self._of.id_to_token(k) or "" for k in range(self._of.get_vocab_size())]
        super().__init__([special[k].encode() if k in special else bytes(byte[s] for s in t) for k, t in enumerate(tokens)])

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has. Pieces between which a word must end are one text; where they end the bytes tell."""
        alone = np.array([len(p) < 2 or not (0x20 < p[1] < 0x7F and 0x20 < p[-1] < 0x7F) for p in pieces], bool)
        joined, rest = [p for p, x in zip(pieces, alone.tolist(), strict=True) if not x], [p for p, x in zip(pieces, alone.tolist(), strict=True) if x]
        to = np.cumsum([len(p) for p in joined])
        cuts = np.searchsorted(to, np.arange(_JOINED, int(to[-1]) if len(to) else 0, _JOINED)).tolist()
        runs = [b"".join(joined[a:b]) for a, b in zip([0, *cuts], [*cuts, len(joined)], strict=True)]
        said = self._encoded(rest)
        first, others = (np.concatenate([np.zeros(0, np.int32), *own]) for own in (self._encoded(runs), said))
        held = np.searchsorted(np.cumsum(self.size[first]), to, "right")
        counts, starts = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        counts[~alone], counts[alone] = np.diff(held, prepend=0), [len(x) for x in said]
        starts[~alone], starts[alone] = held - counts[~alone], len(first) + np.cumsum(counts[alone]) - counts[alone]
        return np.concatenate([first, others])[_ragged(starts, counts)], counts

    def _encoded(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts. The library's own records of a text are many times its size, so few are held at a time."""
        out = []
        for k in range(0, len(texts), _AT_ONCE):
            out += [np.array(e.ids, np.int32) for e in self._of.encode_batch_fast([t.decode() for t in texts[k : k + _AT_ONCE]], add_special_tokens=False)]
        return out


class Pieces(Side):
    ends = ";"

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._of = SentencePieceProcessor(model_file=path)
        named = [self._of.id_to_piece(k) for k in range(self._of.get_piece_size())]
        super().__init__([bytes([int(t[3:-1], 16)]) if self._of.is_byte(k) else t.replace(_SPACE_MARK, " ").encode() for k, t in enumerate(named)])
        #: Whether the model never joins a space to a sign before it.
        self.parted = not any(_SPACE_MARK in t.lstrip(_SPACE_MARK) for t in named)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As the other side's. The pieces begin with a space, which the model adds itself."""
        said = self._of.encode([p[1:].decode() for p in pieces], num_threads=1)
        return np.array([k for own in said for k in own], np.int32), np.array([len(x) for x in said], np.int64)


@cache
def sides(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """One of each file a process."""
    return ByteLevel(a), Pieces(b)


def with_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """space + text of all rows that aren't empty."""
    some = np.diff(offsets) > 0
    return np.insert(data, offsets[:-1][some], 0x20), offsets + np.concatenate([[0], np.cumsum(some)])


def piece_starts(data: np.ndarray, offsets: np.ndarray, parted: bool) -> np.ndarray:
    """Where the rows' pieces begin: at single spaces between signs that aren't white space. Signs of 2 and 3 bytes among which there is white space, or the
    mark for a space, don't count as others."""
    cut = np.zeros(len(data), bool)
    if parted and len(data) > 2:
        near = np.array([k in (0xC2, 0xE1, 0xE2, 0xE3) for k in range(256)])[data]
        cut[1:-1] = (data[1:-1] == 0x20) & (data[:-2] > 0x20) & (data[2:] > 0x20) & ~near[2:]
        cut[2:] &= data[:-2] != 0xC2
        cut[3:] &= ~near[:-3]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Aligned:
    """Alignment of id sequences of A and B that spell the same bytes, all in a row."""

    def __init__(self, a: np.ndarray, b: np.ndarray, side_a: Side, side_b: Side):
        self.a, self.b = a, b
        size_a, size_b = side_a.size[a], side_b.size[b]
        self.end_a, self.end_b = np.cumsum(size_a), np.cumsum(size_b)
        self.start_a, self.start_b = self.end_a - size_a, self.end_b - size_b
        to = np.searchsorted(self.end_b, self.end_a)
        same = self.end_b[np.minimum(to, len(b) - 1)] == self.end_a if len(b) else np.zeros(len(a), bool)
        #: The last tokens of all groups.
        self.last_a, self.last_b = np.flatnonzero(same), to[same]

    def anchors(self, side_a: Side, side_b: Side) -> tuple[np.ndarray, np.ndarray]:
        """The first tokens of all windows, and the numbers of tokens at the end."""
        a, b = self.last_a + 1, self.last_b + 1
        inner = a < len(self.a)
        inner[inner] = side_a.spaced[self.a[a[inner]]] & side_b.spaced[self.b[b[inner]]]
        return np.concatenate([[0], a[inner], [len(self.a)]]), np.concatenate([[0], b[inner], [len(self.b)]])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(token of A, token of B) of all links, by token of A."""
        first = np.searchsorted(self.end_b, self.start_a, "right")
        count = np.searchsorted(self.start_b, self.end_a, "left") - first
        return np.repeat(np.arange(len(self.a)), count), _ragged(first, count)


class Held:
    """Ids of pieces, by the pieces' numbers."""

    def __init__(self):
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has."""
        counts = self.at[numbers + 1] - self.at[numbers]
        return self.flat[_ragged(self.at[numbers], counts)], counts


class Block:
    """Windows met in a block of texts, by their ids: their groups as text, and their links."""

    def __init__(self, side_a: Side, side_b: Side):
        self.a, self.b = side_a, side_b
        self.piece: dict[bytes, int] = {}
        self.ids = Held(), Held()
        self.wrong = np.zeros(0, bool)
        self.number: dict[bytes, int] = {}
        self.text: list[str] = []
        self.n_groups, self.n_links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs: list[np.ndarray] = []
        self.seen = np.zeros(0, np.int64)
        self.bytes = 0

    def tokenise(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of the pieces; those that are new are tokenised and held against their bytes."""
        new = [p for p in pieces if p not in self.piece]
        if new:
            wrong = np.zeros(len(new), bool)
            size = np.array([len(p) for p in new])
            for side, held in zip((self.a, self.b), self.ids, strict=True):
                flat, counts = side.ids(new)
                held.add(flat, counts)
                to = np.cumsum(counts)
                spelled = np.diff(np.concatenate([[0], np.cumsum(side.size[flat])])[to], prepend=0)
                if (spelled != size).any() or side.joined(flat) != b"".join(new):
                    wrong |= [side.joined(flat[x:y]) != p for p, x, y in zip(new, (to - counts).tolist(), to.tolist(), strict=True)]
            self.piece.update(zip(new, range(len(self.piece), len(self.piece) + len(new)), strict=True))
            self.wrong = np.concatenate([self.wrong, wrong])
        return np.array([self.piece[p] for p in pieces], np.int64)

    def file(self, keys: list[bytes]) -> np.ndarray:
        """Numbers of windows; those that are new are aligned, all at once."""
        new = [k for k in keys if k not in self.number]
        if new:
            flat = np.frombuffer(b"".join(new), np.int32)
            of = np.repeat(np.arange(len(new)), [len(k) // 4 for k in new])
            is_b = flat >> _SHIFT > 0
            both = Aligned(flat[~is_b], flat[is_b] - (1 << _SHIFT), self.a, self.b)
            i, j = both.links()
            self.pairs.append(both.a[i].astype(np.int64) << _SHIFT | both.b[j])
            self.n_links = np.append(self.n_links, np.bincount(of[~is_b][i], minlength=len(new)))
            self.n_groups = np.append(self.n_groups, np.bincount(of[~is_b][both.last_a], minlength=len(new)))
            # Groups as text: every group's ids of A, then those of B, each with the sign that follows it.
            to_a, to_b = both.last_a + 1, both.last_b + 1
            size_a, size_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
            at_a = np.arange(len(both.a)) + np.repeat(to_b - size_b, size_a)
            at_b = np.arange(len(both.b)) + np.repeat(to_a, size_b)
            signs, long = np.empty(len(flat), object), np.empty(len(flat), np.int64)
            for side, ids, at, last in ((self.a, both.a, at_a, both.last_a), (self.b, both.b, at_b, both.last_b)):
                signs[at], long[at] = side.written[0][ids], side.digits[ids]
                signs[at[last]] = side.written[1][ids[last]]
            said = "".join(signs.tolist())
            to = np.cumsum(long)[np.cumsum([len(k) // 4 for k in new]) - 1].tolist()
            self.number.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
            self.text += [said[x:y] for x, y in zip([0, *to], to)]  # noqa: B905
        return np.array([self.number[k] for k in keys], np.int64)

    def count(self, numbers: np.ndarray) -> None:
        more = np.bincount(numbers, minlength=len(self.text))
        more[: len(self.seen)] += self.seen
        self.seen = more


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ALIGNED = f"block long, {_DOC}, windows array<int>, pairs array<long>, counts array<long>, n_pairs array<int>, pair_numbers array<int>"
_COLUMNS = [x.split()[0] for x in _ALIGNED.split(", ")]
_LISTS = {"windows": pa.int32(), "pairs": pa.int64(), "counts": pa.int64(), "n_pairs": pa.int32(), "pair_numbers": pa.int32()}


def _texts(block: Block, number: int, batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """One row a text: counts, digest and the windows' numbers."""
    rows = batch.num_rows
    data, offsets = with_spaces(data, offsets)
    cuts = piece_starts(data, offsets, block.b.parted)
    codes, pieces = distinct_chunks(data, cuts)
    numbers = block.tokenise(pieces)[codes]
    of = np.searchsorted(offsets, cuts, "right") - 1
    bad = np.zeros(rows, bool)
    for row in np.unique(of[block.wrong[numbers]]).tolist():
        spelled = data[offsets[row] : offsets[row + 1]].tobytes()
        bad[row] = any(side.joined(held.of(numbers[of == row])[0]) != spelled for side, held in zip((block.a, block.b), block.ids, strict=True))
    numbers, of = numbers[~bad[of]], of[~bad[of]]
    (a, in_a), (b, in_b) = (held.of(numbers) for held in block.ids)
    n_a, n_b = (np.bincount(of, x, rows).astype(np.int64) for x in (in_a, in_b))
    both = Aligned(a, b, block.a, block.b)
    at_a, at_b = both.anchors(block.a, block.b)
    # Every text begins with a space on both sides, so texts begin with anchors. A window's key: its ids of A, then those of B.
    size_a, size_b = np.diff(at_a), np.diff(at_b)
    window = len(size_a) if len(a) else 0
    keys = np.empty(len(a) + len(b), np.int32)
    keys[np.arange(len(a)) + np.repeat(at_b[:-1], size_a)] = a
    keys[np.arange(len(b)) + np.repeat(at_a[1:], size_b)] = b + (1 << _SHIFT)
    local, distinct = distinct_chunks(keys.view(np.uint8), 4 * (at_a + at_b)[:window])
    numbers = block.file(distinct)[local]
    block.count(numbers)
    first = np.concatenate([[0], np.cumsum(n_a)])
    bounds = np.searchsorted(at_a[:-1][:window], first)
    listed = numbers.tolist()
    sums = [np.concatenate([[0], np.cumsum(x[numbers])])[bounds] for x in (block.n_groups, block.n_links)]
    said = ["".join([block.text[k] for k in listed[x:y]])[:-1] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in said]
    block.bytes += len(data)
    columns = [pa.array(np.full(rows, number)), batch.column("doc_id"), *map(pa.array, (n_a, n_b, np.diff(sums[0]), np.diff(sums[1]))), pa.array(digests)]
    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(numbers, pa.int32())))
    return pa.RecordBatch.from_arrays(columns + [pa.nulls(rows, pa.list_(_LISTS[c])) for c in _COLUMNS[-4:]], _COLUMNS)


def _windows(block: Block, number: int) -> pa.RecordBatch:
    """A block's one row of windows: its distinct pairs, with the links that its texts hold of each, and every window's pairs by number."""
    pairs, numbers = np.unique(np.concatenate(block.pairs), return_inverse=True)
    counts = np.bincount(numbers, np.repeat(block.seen, block.n_links), len(pairs)).astype(np.int64)
    kind = dict(zip(_COLUMNS, (pa.int64(), *[pa.int64()] * 5, pa.string()), strict=False))
    row = {"block": pa.array([number])} | {"pairs": pairs, "counts": counts, "n_pairs": block.n_links, "pair_numbers": numbers}
    lists = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, _LISTS[c])) for c, x in row.items() if c != "block"}
    return pa.RecordBatch.from_arrays([row["block"] if c == "block" else lists[c] if c in lists else pa.nulls(1, kind.get(c) or pa.list_(_LISTS[c])) for c in _COLUMNS], _COLUMNS)


def aligned_blocks(docs: DataFrame, paths: tuple[str, str], block_bytes: int = BLOCK) -> DataFrame:
    """Rows of texts (pairs is null) and rows of windows, one a block."""

    def run(batches):
        task, k, block = TaskContext.get().partitionId() << 32, 0, Block(*sides(*paths))
        for batch, data, offsets in slices(batches, most=_SLICE):
            yield _texts(block, task + k, batch, data, offsets)
            if block.bytes >= block_bytes:
                if block.text:
                    yield _windows(block, task + k)
                k, block = k + 1, Block(block.a, block.b)
        if block.text:
            yield _windows(block, task + k)

    return docs.select("doc_id", "text").mapInArrow(run, _ALIGNED)


def _sums(mine: pa.Table, scored: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's texts, from its rows of aligned_blocks() and scored(place, n, best)."""
    mine = mine.combine_chunks()
    windows = mine.filter(pa.compute.is_valid(mine.column("n_pairs")))
    texts = mine.filter(pa.compute.is_null(mine.column("n_pairs")))
    value = np.zeros((2, len(scored)), np.int64)
    place = scored.column("place").to_numpy()
    value[0, place], value[1, place] = scored.column("best").to_numpy(), scored.column("n").to_numpy()
    listed = texts.column("windows").combine_chunks()
    of = np.repeat(np.arange(len(texts)), listed.value_lengths().to_numpy())
    numbers, sums = listed.flatten().to_numpy(), []
    if len(windows):
        pairs, held = (windows.column(c).combine_chunks().flatten().to_numpy() for c in ("pair_numbers", "n_pairs"))
        to = np.cumsum(held)
        for v in value:
            running = np.concatenate([[0], np.cumsum(v[pairs])])
            sums.append((running[to] - running[to - held])[numbers])
    out = texts.select([x.split()[0] for x in _DOC.split(", ")])
    for name, own in zip(("n_best", "count_sum"), sums or [np.zeros(0, np.int64)] * 2, strict=True):
        running = np.concatenate([[0], np.cumsum(own)])
        to = np.cumsum(np.bincount(of, minlength=len(texts)))
        out = out.append_column(name, pa.array(np.diff(running[to], prepend=0)))
    return out


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n): the links of all texts by id pair."""
    return blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))


def id_pairs(counts: DataFrame) -> DataFrame:
    """(id_a, id_b, n, best) of pair_counts(): how many links each id pair has, and whether no pair of its id of B has more."""
    named = counts.select(F.shiftright("pair", _SHIFT).cast("int").alias("id_a"), (F.col("pair") % (1 << _SHIFT)).cast("int").alias("id_b"), "n", "pair")
    most = named.groupBy("id_b").agg(F.max("n").alias("most"))
    return named.join(most, "id_b").select("id_a", "id_b", "n", (F.col("n") == F.col("most")).alias("best"), "pair")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """One row of every row of docs(doc_id, text): doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum. Runs its jobs when called."""
    with Steps(docs.sparkSession) as step:
        blocks = step.stored(aligned_blocks(docs, paths or tokenizer_paths(), block_bytes))
        counts = step.stored(pair_counts(blocks))
        ranked = step.stored(id_pairs(counts).select("pair", "n", F.col("best").cast("long").alias("best")))
        held = step.stored(blocks.where("pairs is not null").select("block", F.posexplode("pairs").alias("place", "pair")))
        scored = held.join(ranked, "pair").select("block", "place", "n", "best")
        mine = blocks.drop("pairs", "counts")
        schema = f"{_DOC}, n_best long, count_sum long"
        return stored(mine.groupBy("block").cogroup(scored.groupBy("block")).applyInArrow(_sums, schema))
