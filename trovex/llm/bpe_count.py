"""Token counts by heap-and-linked-list byte-pair merging (operator 4).

Texts are split as the vocabulary's byte-level pre-tokenizer splits them. A piece starts as a linked list of byte
symbols; the adjacent pair of lowest rank is popped from a heap and merged, until none is left. The piece's count is
its bytes less its merges; no identifiers are emitted. Pieces repeat, so a worker keeps the counts of those it has seen.

Edge cases: null and empty texts have no tokens; very long texts, and pieces as long as they are, are merged whole; pairs of
equal rank are merged from the left; a special token's string inside a text is one token, as by the library's default; repeated
rows are counted each; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of byte-level pre-tokenization: a fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT = 400_000  #: pieces whose counts a worker keeps before it starts anew
LIMIT = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Merges(dict):
    """piece -> tokens, counted when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.rank = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(pairs)}
        self.first = [vocab[s] for s in byte_symbols()]
        self.split = regex.compile(PIECES.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        added = spec.get("added_tokens", [])
        if odd := [t["content"] for t in added if any(t.get(f) for f in ("lstrip", "rstrip", "single_word", "normalized"))]:
            raise ValueError(f"added tokens that take in their surroundings are not supported: {odd}")
        special = [t["content"] for t in added]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.hints = special
        self.spaced = _Spaced(self)

    def __missing__(self, piece: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        n = self[piece] = self.merge(piece.encode())
        return n

    def merge(self, piece: bytes) -> int:
        """Tokens of one piece."""
        n = count = len(piece)
        if n == 1:
            return 1
        rank, sym = self.rank, [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, r[1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1])))]
        heapify(heap)
        while heap:
            _, i, new = heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= n or (r := rank.get((sym[i], sym[j]))) is None or r[1] != new:
                continue  # one of the two has been merged meanwhile
            sym[i], sym[j] = new, -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if r := rank.get((new, sym[k])):
                    heappush(heap, (r[0], i, r[1]))
            p = before[i]
            if p >= 0 and (r := rank.get((sym[p], new))):
                heappush(heap, (r[0], p, r[1]))
        return count

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special and any(s in text for s in self.hints):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        # no piece reaches over a lone space: it starts the next one. So a word between two such spaces counts alike anywhere.
        first, *rest = text.split(" ")
        try:
            return self.spaced.pieces(first) + sum(map(self.spaced.__getitem__, rest))
        except _Run:
            return sum(map(self.__getitem__, self.split(text)))


class _Run(Exception):
    """White space meets white space, so the text has to be split as a whole."""


class _Spaced(dict):
    """word -> tokens of the word with a space before it."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def pieces(self, s: str) -> int:
        if s[-1:].isspace():
            raise _Run
        return sum(map(self.merges.__getitem__, self.merges.split(s)))

    def __missing__(self, word: str) -> int:
        if not word or word[0].isspace():
            raise _Run
        if len(self) >= KEPT:
            self.clear()
        n = self[word] = self.pieces(" " + word)
        return n


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, path: str | Callable[[], str], limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. path: a byte-level BPE file that executors have too, or what finds it on each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = merges(path() if callable(path) else path).count
        for b in batches:
            n = [count(s) if (s := t.as_py()) else 0 for t in b.column(2)]  # one text at a time
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), _vocabulary)
