"""Toxicity by compression distance (operator 9).

Two zstandard dictionaries are trained on labelled documents, one on toxic and one on ordinary text. A dictionary's content
is made of the substrings that its texts share: grams of GRAM bytes over all characters, spaces and digits included. The
ordinary dictionary has the grams of most ordinary documents; the toxic one has before these the grams that occur, or
recur, in more toxic documents than chance allows (log-likelihood ratio, at 5 % over all grams together). Grams are chained
where they overlap, the weightiest last, where references to them are shortest.

A document is cut into windows of WINDOW bytes. Each is compressed with either dictionary, and the bytes that the toxic one
saves are the window's distance. As both dictionaries end alike, ordinary text saves nothing. The document's score comes from
how many of its windows save how much, by thresholds calibrated on the labelled documents (boosted trees of depth 3). A fixed
tail that both dictionaries know ends each window, since the compressor looks for no match in a block's last bytes.

Training takes a bounded sample of labelled rows (`max_rows`, those of least id hash) and, of near copies in it, one. A
dictionary has at most `size` bytes for each of its two kinds of grams.

Edge cases: null and empty texts are one empty window and get the score of such a text; very long texts are windows like any
other and held one at a time; labels that are null, or whose document is missing, teach nothing; of several labels for one
id the highest counts; a null doc_id is never trained on and counts as remainder 0; repeated rows are scored each; equal texts
get equal scores, and ties between grams go by their bytes; without usable labels the score is 0.5; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import fold, raw, slices, stored
from .near_copies import distinct_runs
from .quality import sample_labels

MAX_ROWS = 20_000
THRESHOLD = 0.3
GRAM, WINDOW, OVERLAP = 7, 32, 8
SIZE = 1 << 15  #: bytes of toxic, and of ordinary grams, in a dictionary at most
ERROR = 0.05  #: chance of one gram or more being marked where toxic and ordinary texts are alike
MATCH, LEVEL, STEPS = 6, 9, 8
TAIL = b"~" + bytes(range(33, 73)) + b"~"


class Distance:
    """Bytes that the toxic dictionary saves, window by window."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        def lengths(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            return zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress

        self.toxic, self.ordinary = lengths(toxic + b"\n" + ordinary + TAIL), lengths(ordinary + TAIL)

    def saved(self, text: bytes) -> np.ndarray:
        windows = (text[max(lo - OVERLAP, 0) : lo + WINDOW] + TAIL for lo in range(0, max(len(text), 1), WINDOW))
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows])

    def features(self, text: bytes) -> list[float]:
        v = self.saved(text)
        counts = np.cumsum(np.bincount(np.clip(v, 0, STEPS), minlength=STEPS + 1)[::-1])[::-1][1:]
        return [v.max(), v.sum(), v.mean(), *counts, *(counts[:6] / len(v)), np.log1p(len(v))]


WIDTH = 3 + STEPS + 6 + 1


@lru_cache(maxsize=2)
def distance(toxic: bytes, ordinary: bytes) -> Distance:
    return Distance(toxic, ordinary)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of each text's five-word runs, by which near copies are told."""
    for b in batches:
        for lo, hi, runs, at in distinct_runs(b.column(2), 5):
            some = np.flatnonzero(np.diff(at))
            sig = np.zeros((2, hi - lo), np.uint64)
            for i, odd in enumerate((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)):
                sig[i, some] = np.minimum.reduceat(runs * np.uint64(odd), at[some]) if len(some) else 0
            yield pa.RecordBatch.from_arrays([b.column(i).slice(lo, hi - lo) for i in (0, 1)] + [pa.array(s.view(np.int64)) for s in sig], ["doc_id", "label", "one", "two"])


def _without_copies(rows: DataFrame) -> DataFrame:
    """rows (doc_id, label, text) less near copies under the same label."""
    signed = rows.mapInArrow(_signed, "doc_id long, label double, one long, two long")
    for sig in ("one", "two"):
        best = F.min_by(F.struct("doc_id", "two"), "doc_id").alias("best")
        signed = signed.groupBy("label", sig).agg(best).select("label", "best.*")
    return rows.join(F.broadcast(signed.select("doc_id")), "doc_id", "left_semi")  # at most as many as the sample has


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each gram the toxic and ordinary texts that have it, and those that have it again, partly summed. Its bytes make up its number, the first highest."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def flush():
        keys, n = (np.concatenate(x) for x in zip(*parts))
        u, at = np.unique(keys, return_inverse=True)
        n = np.bincount(at, n, len(u)).astype(np.int64)
        kind = (u & np.uint64(3)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array((u >> np.uint64(2)).view(np.int64)), *(pa.array(np.where(kind == i, n, 0)) for i in range(4))], ["gram", *_COUNTS])

    size = 0
    for b in batches:
        label = (b.column(0).to_numpy(zero_copy_only=False) > 0).astype(int)
        for lo, hi, buf, off in slices(b.column(1)):
            if len(buf) < GRAM:
                continue
            g = np.zeros(len(buf) - GRAM + 1, np.uint64)
            for i in range(GRAM):
                g = (g << np.uint64(8)) | buf[i : len(g) + i]
            for row in range(hi - lo):
                once, n = np.unique(g[off[row] : max(off[row], off[row + 1] - GRAM + 1)], return_counts=True)
                key = (once << np.uint64(2)) | np.uint64(1 - label[lo + row])
                parts += [(key, np.ones(len(key), np.int64)), (key[n > 1] | np.uint64(2), np.ones(int((n > 1).sum()), np.int64))]
                size += len(parts[-1][0]) + len(key)
            if size > 1 << 20:
                yield flush()
                parts, size = [], 0
    if parts:
        yield flush()


_COUNTS = ("t", "o", "t2", "o2")


def _term(seen: Column, expected: Column) -> Column:
    return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)


def _ratio(t: Column, o: Column, toxic: int, ordinary: int) -> Column:
    """Log-likelihood ratio of t of the toxic and o of the ordinary texts having a gram; 0 where it is no commoner in toxic ones."""
    every, found = toxic + ordinary, t + o
    cells = [(t, toxic * found), (o, ordinary * found), (toxic - t, toxic * (every - found)), (ordinary - o, ordinary * (every - found))]
    return F.when(t * ordinary > o * toxic, 2 * sum((_term(seen, part / max(every, 1)) for seen, part in cells), F.lit(0.0))).otherwise(0.0)


def chain(grams: dict[bytes, float], size: int) -> bytes:
    """Grams joined where one's end is another's start, the weightiest first to be joined and last in the result; at most about `size` bytes."""
    after, before = defaultdict(list), defaultdict(list)
    for k in sorted(grams, key=lambda k: (-grams[k], k)):
        after[k[:-1]].append(k)
        before[k[1:]].append(k)
    used: set[bytes] = set()
    out, total = [], 0

    def walk(links, end, at: bytes) -> Iterator[bytes]:
        while at := next((k for k in links[end(at)] if k not in used), b""):
            used.add(at)
            yield at

    for k in sorted(grams, key=lambda k: (-grams[k], k)):
        if k in used:
            continue
        if total >= size:
            break
        used.add(k)
        right = b"".join(x[-1:] for x in walk(after, lambda x: x[1:], k))
        left = b"".join([x[:1] for x in walk(before, lambda x: x[:-1], k)][::-1])
        out.append(left + k + right)
        total += len(out[-1]) + 1
    return b"\n".join(reversed(out))


def dictionaries(rows: DataFrame, size: int = SIZE) -> tuple[bytes, bytes]:
    """The toxic grams and the ordinary ones, chained, from rows (doc_id, label, text lower-cased)."""
    rows = _without_copies(rows)
    counted = rows.select("label", "text").mapInArrow(_counted, "gram long, t long, o long, t2 long, o2 long")
    grams = stored(counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in _COUNTS]))
    docs = dict(rows.groupBy("label").count().collect())
    toxic, ordinary = docs.get(1.0, 0), docs.get(0.0, 0)
    # of one degree of freedom: chi-square's tail at x is below exp(-x / 2); two tests a gram
    bound = 2 * log(2 * max(grams.count(), 1) / ERROR)
    weight = F.greatest(*[_ratio(F.col(t), F.col(o), toxic, ordinary) for t, o in (("t", "o"), ("t2", "o2"))])
    grams = grams.withColumn("weight", weight).withColumn("marked", weight > bound)

    def best(which: Column, weight: str) -> dict[bytes, float]:
        return {g.to_bytes(GRAM, "big"): w for g, w in grams.where(which).orderBy(F.desc(weight), "gram").select("gram", weight).limit(size).collect()}

    return chain(best(F.col("marked"), "weight"), size), chain(best(~F.col("marked") & (F.col("o") > 0), "o"), size)


def _measured(pair):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = distance(*pair.value)
        for b in batches:
            x = [d.features(raw(t)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    return run


def _lowered() -> Column:
    return F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))


def train(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2, max_rows: int = MAX_ROWS, size: int = SIZE):
    """Broadcasts: the dictionaries' contents, and the forest with the thresholds."""
    sc = docs.sparkSession.sparkContext
    sample = sample_labels(labels, "toxic", mod, held_out, max_rows)
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lowered().alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text"))
    pair = sc.broadcast(dictionaries(rows, size))
    got = rows.select("label", "text").mapInArrow(_measured(pair), "label double, x array<double>").toArrow()  # max_rows of a few numbers
    x = np.array(got.column(1).to_pylist(), float).reshape(-1, WIDTH)
    order = np.lexsort(x.T)
    return pair, sc.broadcast(gbdt.fit(x[order], got.column(0).to_numpy()[order], trees=60, depth=3))


def score(docs: DataFrame, labels: DataFrame, mod: int = 4, held_out: int = 2, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, size: int = SIZE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    pair, forest = train(docs, labels, mod, held_out, max_rows, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = distance(*pair.value)
        for b in batches:
            x = np.array([d.features(raw(t)) for t in b.column(2)], float).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forest.value.predict(x))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", mod) == held_out).alias("held_out"), _lowered().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)
