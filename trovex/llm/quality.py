"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

The forest is fitted on statistics of a bounded sample of labelled rows (`max_rows`, those of least id hash) and
broadcast as flat arrays; every document is scored from its whole text with numpy, a batch at a time.

Edge cases: null and empty texts have all statistics 0 and get the score of such a text; labels that are null, or whose
document is missing, teach nothing; of several labels for one id the highest counts; a null doc_id is never trained on and
counts as remainder 0; repeated rows are scored each, equal texts alike; very long texts are scored whole, one at a time; a score
equal to the threshold is good; without usable labels the score is 0.5; an empty table gives no rows; other columns, whatever
their names, are ignored, and `keep_good` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .common import NOT_SPACE, fold, gram_hashes, rows_left, slices, word_hashes, words

MAX_ROWS = 20_000
THRESHOLD = 0.3

_CLASSES = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), [0x20], [0x0A], [0x2E], [0x2C], [0x21], [0x7C], [0x23, 0x24, 0x25, 0x26, 0x2A], [0x2F, 0x3A, 0x40], range(0x80, 0x100)]
_CLASS = np.full(256, len(_CLASSES), np.int64)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
FEATURES = len(_CLASSES) + 1 + 12


def _repeated(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row: how many of its values occurred before in it; the count of its commonest value."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    key = np.sort((h >> np.uint64(24)) | (row.astype(np.uint64) << np.uint64(40)))  # rows of a slice fit 24 bits
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(key)))
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, owner, count)
    return np.bincount(owner, count - 1, n), most


def statistics(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers for each text of a slice."""
    n, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(n), size)
    width = len(_CLASSES) + 1
    kinds = np.bincount(row * width + _CLASS[buf], minlength=n * width).reshape(n, width)
    starts, ends, first = words(buf, off, NOT_SPACE)
    count = np.diff(first)
    owner = np.repeat(np.arange(n), count)
    length = (ends - starts).astype(float)
    h = word_hashes(buf, starts, ends)
    some = np.maximum(count, 1)
    mean = np.bincount(owner, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some - mean**2, 0))
    again, most = _repeated(owner, h, n)
    three = gram_hashes(h, 3)
    ok = rows_left(first)[: len(three)] >= 3
    again3, _ = _repeated(owner[: len(three)][ok], three[ok], n)
    l0, l1, lf = words(buf, off, _LINE)
    lines = np.diff(lf)
    again_l, _ = _repeated(np.repeat(np.arange(n), lines), word_hashes(buf, l0, l1), n)
    capital = (buf[starts] >= 0x41) & (buf[starts] <= 0x5A) if len(starts) else np.zeros(0, bool)
    letter = (_CLASS[buf[ends - 1]] <= 2) | (buf[ends - 1] >= 0x80) if len(ends) else np.zeros(0, bool)
    return np.column_stack(
        [
            kinds / np.maximum(size, 1)[:, None],
            np.log1p(size), np.log1p(count), mean, spread, again / some, most / some, again3 / some,
            lines, size / np.maximum(lines, 1), again_l / np.maximum(lines, 1),
            np.bincount(owner, capital, n) / some, np.bincount(owner, letter, n) / some,
        ]
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, off in slices(b.column(1)):
            x = statistics(buf, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(x.tolist(), pa.list_(pa.float64()))], ["label", "x"])


def sample_labels(labels: DataFrame, label: str, mod: int, held_out: int, max_rows: int) -> DataFrame:
    """(doc_id, label double) of at most max_rows ids outside the held-out fold, those of least hash: few enough to broadcast."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", mod) != held_out))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS) -> gbdt.Forest:
    sample = sample_labels(labels, "quality", mod, held_out, max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    got = rows.select("label", "text").mapInArrow(_features, "label double, x array<double>").toArrow()  # max_rows of a few numbers
    x = np.array(got.column(1).to_pylist(), float).reshape(-1, FEATURES)
    order = np.lexsort(x.T)  # so that the fit doesn't depend on the order in which rows arrive
    return gbdt.fit(x[order], got.column(0).to_numpy()[order])


def score(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, mod, held_out, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [forest.value.predict(statistics(buf, off)) for _, _, buf, off in slices(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(p) if p else np.zeros(0))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", mod) == held_out).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs that are predicted good, with their columns as they were; scored where they stand, without a join."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [forest.value.predict(statistics(buf, off)) for _, _, buf, off in slices(b.column(at))]
            keep = pa.array(np.concatenate(p) >= threshold if p else np.zeros(0, bool))
            yield b.select(range(width)).filter(keep)

    width = len(docs.columns)
    # a text that is a string already crosses to Python once
    at = docs.dtypes.index(("text", "string")) if ("text", "string") in docs.dtypes else width
    columns = [F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    kinds = ", ".join(f"_c{i} {t}" for i, (_, t) in enumerate(docs.dtypes))
    if at == width:
        columns.append(F.col("text").cast("string").alias("_text"))
    out = docs.select(*columns).mapInArrow(run, kinds)
    return out.toDF(*docs.columns)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)
