"""Benchmark decontamination by winnowing (operator 5).

Of each window of benchmark words only one gram is kept, the one with the least hash among those inside the window;
documents keep theirs by the same rule, so every shared window shares a kept gram at one place in it. Both sides'
fingerprints are joined, and a hit is extended word by word to both sides, as far as a window around the gram can
reach; it counts if a whole window agrees. An item shorter than a window is one gram of its own length.

Before the join, documents' fingerprints pass a bitmap of the benchmark's, of fixed size. However large the benchmark
is, that only lets more of them through.

Edge cases: null and empty texts have no words and are clean; items without words match nothing; a null item_id counts
as no item but still makes hits; repeated items and rows are each reported; an empty benchmark hits nothing; rows are kept
apart even under one doc_id; of equal least hashes in a window the first counts; very long texts are worked through whole, one at
a time; other columns, whatever their names, are ignored by `contamination` and passed on by `drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, checkpoint, gram_hashes, mix, numbered, rows_left, slices, winnow, word_hashes, words

WINDOW, GRAM = 10, 5
SLOTS = 1 << 22  #: of the bitmap: 4 MB of booleans
#: Words of a document `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, in either case
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _prints(column: pa.Array, window: int, gram: int, shorts: list[int], item: bool):
    """For each slice: first row, word counts, then row, key, word position, length class and context of each fingerprint.

    Class 0 is a winnowed gram; class n > 0 a gram of n words, the whole of an item that short. A context is the words
    around a gram as far as its windows reach: window - gram before, window from it on; 0 (1 in items) where there is none.
    """
    before = window - gram
    pad = np.zeros(before, np.uint64), np.zeros(window, np.uint64)
    for lo, _, buf, off in slices(column):
        buf = LOWER[buf]
        starts, ends, first = words(buf, off, ALNUM)
        count = np.diff(first)
        h = word_hashes(buf, starts, ends)
        row = np.repeat(np.arange(len(count)), count)
        left = rows_left(first)
        at, kind, key = [], [], []
        if len(h) >= window:
            g = gram_hashes(h, gram)
            pos = np.unique(winnow(g, before + 1)[left[: len(h) - window + 1] >= window])
            at.append(pos)
            kind.append(np.zeros(len(pos), np.int64))
            key.append(g[pos])
        for n in sorted(set(count[(count > 0) & (count < window)].tolist())) if item else shorts:
            g = gram_hashes(h, n)
            pos = first[:-1][count == n] if item else np.flatnonzero(left[: len(g)] >= n)
            at.append(pos)
            kind.append(np.full(len(pos), n))
            key.append(mix(g[pos] + np.uint64(n)))
        z = np.zeros(0, np.int64)
        at, kind, key = (np.concatenate(x) if x else z for x in (at, kind, key))

        def contexts(pick, at=at, h=h, row=row):
            padded = np.concatenate((pad[0], h, pad[1]))
            around = at[pick][:, None] + np.arange(before + window)
            rows = np.concatenate((np.full(before, -1), row, np.full(window, -1)))
            return np.where(rows[around] == row[at[pick]][:, None], padded[around], np.uint64(item))

        yield lo, count, row[at] if len(at) else z, key.astype(np.uint64), at - first[row[at]] if len(at) else z, kind, contexts


def _items(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, _, row, key, _, kind, contexts in _prints(b.column(1), window, gram, [], True):
                ctx = [x.tobytes() for x in contexts(slice(None))]
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.uint64).view(np.int64)), ids.take(pa.array(row + lo)), pa.array(kind.astype(np.int32)), pa.array(ctx, pa.binary())], ["key", "item", "kind", "ctx"])

    return run


_FOUND = pa.struct([("key", pa.int64()), ("pos", pa.int32()), ("kind", pa.int32()), ("ctx", pa.binary())])


def _documents(window: int, gram: int, shorts: list[int], bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).view(bool)
        for b in batches:
            ids = b.column(0)
            for lo, count, row, key, pos, kind, contexts in _prints(b.column(1), window, gram, shorts, False):
                pick = np.flatnonzero(full[(key & np.uint64(SLOTS - 1)).astype(np.int64)]) if len(key) else np.zeros(0, np.int64)
                pick = pick[np.argsort(row[pick], kind="stable")]
                fields = [pa.array(key[pick].view(np.int64)), pa.array(pos[pick].astype(np.int32)), pa.array(kind[pick].astype(np.int32)), pa.array([x.tobytes() for x in contexts(pick)] if len(pick) else [], pa.binary())]
                at = np.searchsorted(row[pick], np.arange(len(count) + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, fields=list(_FOUND)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(count)), pa.array(count.astype(np.int64)), found], ["doc_id", "n_words", "found"])

    return run


def _extend(window: int, gram: int):
    """Keeps the joined rows in which a whole window agrees, with the words it covers."""
    before = window - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(b.num_rows, -1) for i in (3, 4))
            pos, kind = (b.column(i).to_numpy().astype(np.int64) for i in (1, 2))
            same = one == two
            left = np.minimum.accumulate(same[:, :before][:, ::-1], axis=1).sum(axis=1)
            right = np.minimum.accumulate(same[:, before:], axis=1).sum(axis=1)
            good = np.where(kind == 0, left + right >= window, right >= kind)
            start, end = np.where(kind == 0, pos - left, pos), pos + np.where(kind == 0, right, kind)
            pick = np.flatnonzero(good)
            take = pa.array(pick)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(start[pick].astype(np.int32)), pa.array(end[pick].astype(np.int32)), b.column(5).take(take)], ["rid", "start", "end", "items"])

    return run


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items: sorted array of item ids as strings, spans: sorted array<struct<start,end>>) for each row of docs."""
    spark = docs.sparkSession
    items = checkpoint(
        bench.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(_items(window, gram), "key long, item string, kind int, ctx binary").groupBy("key", "kind", "ctx").agg(F.collect_set("item").alias("items"))
    )
    shorts = [r[0] for r in items.where("kind > 0").select("kind").distinct().collect()]  # fewer than window
    bits = np.zeros(SLOTS, bool)
    slots = items.select(F.col("key").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot")).distinct()  # SLOTS ints at most
    bits[[r[0] for r in slots.toLocalIterator()]] = True
    bitmap = spark.sparkContext.broadcast(np.packbits(bits).tobytes())
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_documents(window, gram, sorted(shorts), bitmap), "doc_id long, n_words long, found array<struct<key:long,pos:int,kind:int,ctx:binary>>")
    found = checkpoint(found).withColumn("rid", F.monotonically_increasing_id())  # rows of a checkpoint stay where they are
    each = found.select("rid", F.inline("found"))
    joined = each.join(items.withColumnRenamed("ctx", "item_ctx"), ["key", "kind"]).select("rid", "pos", "kind", "ctx", "item_ctx", "items")
    hits = joined.mapInArrow(_extend(window, gram), "rid long, start int, end int, items array<string>")
    merged = F.expr("aggregate(spans, named_struct('n', 0L, 'upto', 0), (a, s) -> named_struct('n', a.n + greatest(s.end - greatest(s.start, a.upto), 0), 'upto', greatest(a.upto, s.end)), a -> a.n)")
    per = (
        hits.groupBy("rid")
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        .withColumn("n_hit", merged)
    )
    return found.select("rid", "doc_id", "n_words").join(per, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans")
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """The rows of docs without hits, with their columns as they were. Rows are told apart by their own number, not by doc_id."""
    rows, row = numbered(docs)
    hit = contamination(rows.select(F.col(row).alias("doc_id"), "text"), bench, **how).where("n_hit > 0").select(F.col("doc_id").alias("_hit"))
    return rows.join(hit, rows[row] == hit["_hit"], "left_anti").drop(row)


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, bench).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
