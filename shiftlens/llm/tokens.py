"""Vectorised views of Arrow text columns: bytes, runs of bytes (words), and 64-bit names for them.

Helpers for code that runs inside tasks. Everything works on whole texts; a text is never cut, only grouped
with its neighbours into slices of a bounded number of bytes (a longer text makes a slice of its own).
Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 3 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (binary rows: their bytes), and the n + 1 offsets of the rows in them."""
    raw = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if raw else "")
    column = column.cast(pa.large_binary() if raw else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches in pieces of about `most` bytes of text, each with its bytes and offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
            yield batch.slice(row, to - row), data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
            row = to


def map_text(df: DataFrame, fn: Callable, schema) -> DataFrame:
    """Map slices of df, which has a column text, through fn(batch, data, offsets) -> RecordBatch."""

    def run(batches):
        for batch, data, offsets in slices(batches):
            yield fn(batch, data, offsets)

    return df.mapInArrow(run, schema)


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of one nonzero kind that stay within a row."""
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.empty(len(kind) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] != 0
    return at[:-1][keep], at[1:][keep]


def owners(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each start lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_names() reads the name of any span."""
    up, _ = powers(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums


def span_names(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit names of spans: equal contents have equal names wherever they lie. Sums modulo a power of two tell spans of over 1000 symbols
    apart only if nobody chose them to collide; where names decide, symbols are named by word_names() and spans are shorter."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes of words in order, and the distinct words by code: words are compared byte by byte."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    held = data[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit names of each word, the halves of a cryptographic digest: no choice of words makes them collide."""
    codes, words = distinct_words(data, starts, ends)
    names = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=16).digest() for w in words]), "<u8").reshape(-1, 2)
    return names[codes, 0], names[codes, 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
