"""Encoding of whole texts by a byte-level BPE vocabulary with word ends, and decoding of the ids.

The vocabulary's file is that of a public tokenizer; nothing is trained. Texts give the ids that the tokenizers library gives without
adding special tokens: special tokens in a text are cut out, what lies between is normalised and split into words, and a word's bytes are merged by rank.

1. Words are counted over all documents. The most frequent ones, at most `WORDS`, are merged and compiled into a minimal transducer from a word
   to its ids (automaton.py). How many there are changes the speed, never an id.
2. Every task memory-maps that file and looks its distinct words up in it. A word that it doesn't hold is merged then, exactly.

Texts are taken apart at white space first, as no word holds any; what stands between, a chunk, is normalised and split once for each of its forms in a
slice. Chunks of printable ASCII and Latin-1 letters are split by a pattern; others by the library's own normaliser and splitter, so that both follow one Unicode version.

Null text is empty: no ids. Every input row gives one row; rows that share a doc_id or have none are like others. An empty table gives an empty result;
other columns are left out, whatever their names. A task holds a slice of 4 MB or one whole text with some 30 times its bytes, and up to some 600,000
chunks that it has met. A word of any length is merged in n log n steps. What goes through the driver are the sizes of at most 1024 classes
of frequency and at most `WORDS` words of at most 64 bytes.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shiftlens.llm.automaton import Lexicon, compile_words
from shiftlens.llm.stored import Steps, shared_folder
from shiftlens.llm.tokens import SPACE, slices

#: How many words the lexicon may hold, and the longest of them in bytes.
WORDS, LONGEST = 1 << 17, 64
_SLICE = 4 << 20
_MEMO = 300_000
_CLASSES = 16
#: Signs that are composed already and whose kinds and lower cases are the same in all versions of Unicode: printable ASCII, and U+00C0 to U+00FF.
_PLAIN = re.compile(rb"(?:[\x21-\x7E]|\xC3[\x80-\xBF])*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_WHITE = b" \t\n\v\f\r"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself if it is printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        signs.setdefault(b, chr(0x100 + len(signs) - len(plain)))
    return [signs[b] for b in range(256)]


class Vocabulary:
    """Merges by rank, the tokens by id, and words of chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, ids = held["model"], dict(held["model"]["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        signs = byte_signs()
        self.first = [ids[s] for s in signs]
        self.last = [ids[s + self.end] for s in signs]
        #: By both ids in one number.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(ids[a] << 32 | ids[b], rank)
            self.made.append(ids[a + b])
        self.special = {t["content"].encode(): t["id"] for t in held["added_tokens"]}
        self.cut = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")") if self.special else None
        tokens = {k: t.encode() for t, k in ids.items()} | {k: t for t, k in self.special.items()}
        self.tokens = [tokens.get(k) for k in range(max(tokens) + 1)]
        self.byte = {s: b for b, s in enumerate(signs)}
        library = Tokenizer.from_file(path)
        self.normalise, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def words(self, chunk: bytes) -> list[bytes | int]:
        """The words of a chunk, as bytes, and the ids of its special tokens."""
        if self.cut and b"<" in chunk and self.cut.search(chunk):
            parts = self.cut.split(chunk)
            return [w for p in parts for w in ([self.special[p]] if p in self.special else self.words(p) if p else [])]
        if _PLAIN.fullmatch(chunk):
            return [w.encode() for w in _SPLIT.findall(chunk.decode().lower())]
        return [bytes(map(self.byte.__getitem__, piece)) for piece, _ in self.pieces(self.normalise(chunk.decode()))]

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word: again and again the pair of lowest rank, the leftmost of equals, becomes one symbol."""
        symbols = [self.first[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        return self._merge_short(symbols) if len(symbols) <= 256 else self._merge_long(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        rank, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            symbols[k] = new = made[least]
            del symbols[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(symbols[k - 1] << 32 | new, none)
            if k < len(ranks):
                ranks[k] = rank(new << 32 | symbols[k + 1], none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        n, rank = len(symbols), self.ranks.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(symbols[k] << 32 | symbols[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            after = right[k]
            if symbols[k] < 0 or after >= n or rank(symbols[k] << 32 | symbols[after]) != r:
                continue
            symbols[k], symbols[after], right[k] = self.made[r], -1, right[after]
            if right[k] < n:
                left[right[k]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < n and (new := rank(symbols[a] << 32 | symbols[b])) is not None:
                    heapq.heappush(heap, (new, a))
        return [s for s in symbols if s >= 0]


@cache
def vocabulary(path: str) -> Vocabulary:
    """One of each file a process."""
    return Vocabulary(path)


@cache
def _mapped(path: str) -> Lexicon:
    return Lexicon.mapped(path)


def distinct_chunks(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of the pieces of data that begin at `cuts`, and the distinct pieces by code."""
    if not len(cuts):
        return np.zeros(0, np.int32), []
    big = len(data) >= 1 << 31
    bounds = np.append(cuts, len(data)).astype(np.int64 if big else np.int32)
    pieces = pa.Array.from_buffers(pa.large_binary() if big else pa.binary(), len(cuts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of the chunks in order, how many stand before each row, and the distinct chunks, which white space may surround."""
    begins = ~SPACE[data]
    begins[1:] &= SPACE[data[:-1]]
    at = offsets[:-1][np.diff(offsets) > 0]
    begins[at] = True
    cuts = np.flatnonzero(begins)
    return *distinct_chunks(data, cuts), np.searchsorted(cuts, offsets)


def count_words(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): the words of all docs(text), as bytes, with how often they stand there."""

    def run(batches):
        voc, held = vocabulary(path), {}

        def rows():
            counts: dict[bytes, int] = {}
            for chunk, n in held.items():
                for word in voc.words(chunk):
                    counts[word] = counts.get(word, 0) + n
            words = [w for w in counts if isinstance(w, bytes)]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

        for _, data, offsets in slices(batches, most=_SLICE):
            codes, chunks, _ = _chunks(data, offsets)
            for chunk, n in zip(chunks, np.bincount(codes, minlength=len(chunks)).tolist(), strict=True):
                chunk = chunk.strip(_WHITE)
                held[chunk] = held.get(chunk, 0) + n
            if len(held) > 2 * _MEMO:
                yield rows()
                held = {}
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str, most: int = WORDS) -> list[bytes]:
    """At most `most` words of up to 64 bytes that stand in docs more than once, the most frequent ones. Words are taken by classes of frequency, of which the last that doesn't
    fit is left out whole."""
    with Steps(docs.sparkSession) as step:
        counted = count_words(docs, path).where((F.col("n") > 1) & (F.length("word") <= LONGEST))
        counted = step.stored(counted.select("word", F.floor(F.log2("n") * _CLASSES).cast("int").alias("class")))
        least, total = None, 0
        for row in sorted(counted.groupBy("class").count().collect(), reverse=True):
            total += row["count"]
            if total > most:
                break
            least = row["class"]
        return [] if least is None else counted.where(F.col("class") >= least).select("word").toArrow().column("word").to_pylist()


def build_lexicon(docs: DataFrame, path: str | None = None, most: int = WORDS) -> str:
    """Compile the frequent words of docs(text) and hand the file out to all executors; the name under which they hold it."""
    path = path or vocabulary_path()
    spark, voc = docs.sparkSession, vocabulary(path)
    block = compile_words((w, tuple(voc.merge(w))) for w in frequent_words(docs, path, most))
    name = f"lexicon-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(block))
    out.close()
    spark.sparkContext.addFile(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString())
    return name


class _Encoder:
    """Ids of distinct chunks, as little-endian bytes; those that were met lately are remembered."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.voc, self.lexicon, self.memo = vocabulary(path), lexicon, {}

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        new = [c for c in chunks if c not in memo]
        if new:
            number: dict[bytes | int, int] = {}
            split = [[number.setdefault(w, len(number)) for w in self.voc.words(c.strip(_WHITE))] for c in new]
            flat, at = self._words(list(number))
            blob = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            memo.update(zip(new, [blob[k[0]] if len(k) == 1 else b"".join([blob[x] for x in k]) for k in split], strict=True))
        return [memo[c] for c in chunks]

    def _words(self, words: list[bytes | int]) -> tuple[bytes, list[int]]:
        """Ids of distinct words in a row, and where each one's begin: out of the lexicon, else by merging; a special token is its own id."""
        known, flat, at = self.lexicon.look_up([w if isinstance(w, bytes) else b"" for w in words])
        if known.all():
            return flat.astype("<u4").tobytes(), (4 * at).tolist()
        missing = np.flatnonzero(~known).tolist()
        made = [self.voc.merge(w) if isinstance(w := words[k], bytes) else [w] for k in missing]
        sizes = np.diff(at)
        sizes[missing] = [len(x) for x in made]
        to = np.cumsum(sizes)
        out, merged = np.empty(int(to[-1]), "<u4"), np.repeat(~known, sizes)
        out[~merged], out[merged] = flat, [k for own in made for k in own]
        return out.tobytes(), [0, *(4 * to).tolist()]


def _decoded(voc: Vocabulary, ids: bytes) -> str:
    tokens = voc.tokens
    return b" ".join([tokens[k] for k in np.frombuffer(ids, "<u4").tolist()]).decode()


def encode(docs: DataFrame, lexicon: str, path: str | None = None, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs(doc_id, text), by a lexicon of build_lexicon(). `ids` are little-endian unsigned
    32-bit integers in a row; id_array() makes an array of them. decoded=True adds what decode() makes of them."""
    path = path or vocabulary_path()
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded

    def run(batches):
        encoder = _Encoder(path, _mapped(SparkFiles.get(lexicon)))
        for batch, data, offsets in slices(batches, most=_SLICE):
            codes, chunks, before = _chunks(data, offsets)
            by_code, codes, before = encoder.ids(chunks), codes.tolist(), before.tolist()
            ids = [b"".join([by_code[c] for c in codes[a:b]]) for a, b in zip(before[:-1], before[1:], strict=True)]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array([_decoded(encoder.voc, x) for x in ids], pa.string())] * decoded, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(..., ids) with the column `decoded`: the tokens of its ids as the vocabulary spells them, joined by spaces, as the library does for a vocabulary
    without a decoder. Null ids give null."""
    path = path or vocabulary_path()
    columns = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        voc = vocabulary(path)
        for batch in batches:
            text = pa.array([None if x is None else _decoded(voc, x) for x in batch.column("ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*columns, "decoded"])

    kept = encoded.select(columns)
    return kept.mapInArrow(run, StructType([*kept.schema, StructField("decoded", StringType())]))


def id_array(ids: str = "ids"):
    """An array of the ids in a column of encode()."""
    byte = lambda k: f"substring({ids}, i + {k}, 1)"
    one = f"cast(conv(hex(concat({byte(4)}, {byte(3)}, {byte(2)}, {byte(1)})), 16, 10) as int)"
    return F.expr(f"if(length({ids}) = 0, array(), transform(sequence(0, length({ids}) - 4, 4), i -> {one}))")
