"""Shared helpers: words and hashes of whole Arrow text columns, checkpoints, held-out folds.

Texts are handled as flat UTF-8 buffers. A batch is worked through in slices of a few MB, so a task's memory
follows its longest document and not the batch. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import shared_dir

SLICE_BYTES = 1 << 20
NO_ID = (1 << 63) - 1  #: stands for a null doc_id where ids are ordered: after all others

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}


def byte_class(pattern_bytes: list[range | int]) -> np.ndarray:
    """A boolean table over bytes: True for the bytes named."""
    table = np.zeros(256, bool)
    for x in pattern_bytes:
        table[x if isinstance(x, int) else list(x)] = True
    return table


#: Bytes of words `[^\x20\x09-\x0D]+`
NOT_SPACE = ~byte_class([0x20, range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
ALNUM = byte_class([range(0x30, 0x3A), range(0x61, 0x7B), range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder of spark.checkpoint.dir."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


checkpoint_dir = shared_dir


def fold(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id falls into fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % mod, F.lit(0))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of rows in bytes) for runs of rows of about `limit` bytes."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of member bytes inside rows, and each row's first word (one more at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = member[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], w[:-1])) & ~edge[:-1]
    after = np.concatenate((w[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


@lru_cache(maxsize=4)
def _powers(kind: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[kind]
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        x = np.full(size, b, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x))
    return out[0], out[1]


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of them."""
    return _powers(kind, 1 << max(16, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    up, down = powers("byte", len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes (rows' ends are the caller's business)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers("word", len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of word hashes."""
    up, down = powers("word", len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def sliding_min(g: np.ndarray, w: int) -> np.ndarray:
    """min(g[i:i+w]) for each i, by doubling."""
    out, have = g, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes, the position of its first least one."""
    least = sliding_min(g, w)
    n = len(least)
    at = np.zeros(n, np.int64)
    for o in range(w - 1, -1, -1):
        at[g[o : o + n] == least] = o
    return at + np.arange(n)


def rows_left(first: np.ndarray) -> np.ndarray:
    """For each word, how many words its row has from it on."""
    counts = np.diff(first)
    return np.repeat(first[1:], counts) - np.arange(first[-1] if len(first) else 0)


def stored(df: DataFrame) -> DataFrame:
    """Like checkpoint, but as compressed Parquet columns: for intermediate tables that are large and read in parts."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written out, with a number for each row that no rereading changes, and the name of that column."""
    name = "_row"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return stored(df.withColumn(name, F.monotonically_increasing_id())), name


class Table:
    """An open-addressed map of distinct 64-bit keys to their indices, for lookups of whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(keys) * 1.4).bit_length())) - 1)
        size = int(self.mask) + 1
        self.at = np.full(size, -1, np.int32)
        self.keys = np.zeros(size, np.uint64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.at[slot] < 0
            self.at[slot[free]] = todo[free]  # of several for one slot the last stays
            placed = self.at[slot] == todo
            self.keys[slot[placed]] = keys[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & int(self.mask)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        x = keys * np.uint64(0x9E3779B97F4A7C15)
        return ((x ^ (x >> np.uint64(32))) & self.mask).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        slot = self._slot(keys)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & int(self.mask)
            got = self.at[slot]
            out[todo] = got
            on = (got >= 0) & (self.keys[slot] != keys[todo])
            todo, slot = todo[on], slot[on]
        return out


def raw(value: pa.Scalar) -> bytes:
    """A string's UTF-8 bytes; none for a null."""
    return value.as_buffer().to_pybytes() if value.is_valid else b""
