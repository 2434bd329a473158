"""Substring dedup by prefix-partitioned suffix trees (operator 2).

Suffixes are word sequences, cut off at `window` words, which is the depth that counts. Which suffixes can share a
deep node is settled first: winnowing picks an anchor (a gram of a third of the window) in each window, by content alone,
so equal windows have equal anchors; suffixes whose anchor occurs once cannot repeat and are dropped. Of texts that are
equal as a whole only the first is looked at: the others repeat it from end to end. The rest are
split by a variable-length prefix: the suffix's words up to the end of its anchor. Prefixes that end in one anchor make
up one group, whose size is known from the anchors' counts. Groups within `group_rows` are sorted in a task, by suffix;
neighbours that agree to the full depth hang from one deep node. No shallower node is built, as none counts. Larger groups
(a passage that a third of all documents share) are not sorted: they are split by longer prefixes, first all that an anchor's
windows cover, then, where such a span is the first of its kind, each window down to the full depth. There a node's leaves are
all alike and only the first counts, so its leaves are pre-aggregated by a minimum and never gathered. This is another method
for such groups, with the same result.

Every leaf of a deep node but the first, by (doc_id, start), is a repeat; its words go.

Edge cases: null and empty texts have no words; rows with the same doc_id and text count as one document (and are
returned as often as they occur); rows with one doc_id and different texts are ordered as if each were that document;
a null doc_id comes after all others; very long texts are worked through whole, one at a time; an empty table gives no rows;
other columns, whatever their names, pass through `strip_repeats` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, NOT_SPACE, gram_hashes, mix, raw, rows_left, slices, span_hashes, winnow, word_hashes, words

WINDOW = 20
GROUP_ROWS = 2000  #: anchors in one suffix group
_ROW = np.uint64(0xD1342543DE82EF95)
CHUNK = 20_000  #: contexts that a subtree task sorts at once, groups kept whole

_KEY = f"coalesce(cast(doc_id as bigint), {NO_ID})"
_TEXT = "cast(text as string)"
#: A document is told by `d`, so that rows without an id don't meet in one place; th guards against collisions of d.
_ROWS = [f"xxhash64({_KEY}, xxhash64({_TEXT})) as d", f"{_KEY} as k", f"xxhash64({_TEXT}) as th", f"{_TEXT} as text"]


def _runs(buf: np.ndarray, off: np.ndarray, window: int):
    """Words of a slice and, for each run of windows with one anchor: document, first and last window, anchor, anchor's hash."""
    starts, ends, first = words(buf, off, NOT_SPACE)
    h = word_hashes(buf, starts, ends)
    k = min(window, window // 3 + 1)
    z = np.zeros(0, np.int64)
    if len(h) < window:
        return h, first, z, z, z, z, z.astype(np.uint64)
    g = gram_hashes(h, k)
    at = winnow(g, window - k + 1)
    n = len(at)
    ok = np.flatnonzero(rows_left(first)[:n] >= window)
    at = at[ok]
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))[ok]
    new = np.ones(len(ok), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(ok))
    return h, first, doc[lo], ok[lo], ok[hi - 1] if len(lo) else z, at[lo], g[at[lo]]


def _anchors(window: int):
    """Each document's distinct anchors, with how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, buf, off in slices(b.column(1)):
                _, _, doc, _, _, _, anchor = _runs(buf, off, window)
                order = np.lexsort((anchor, doc))
                d, a = doc[order], anchor[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(d))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(ids[lo:hi][d[at]]), pa.array(times)], ["anchor", "d", "times"])

    return run


def _suffixes(window: int):
    """For each run whose anchor repeats: its context (the words that its windows cover), under its anchor or, in a large group, its own hash; salts: parts of a large group, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, prints = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            lists = b.column(3)
            chosen = lists.flatten()
            seen, sizes = (chosen.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            for lo, hi, buf, off in slices(b.column(1)):
                h, first, doc, w0, w1, _, anchor = _runs(buf, off, window)
                rows = np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1]))
                known = mix(seen[at[lo] : at[hi]].view(np.uint64) + rows.astype(np.uint64) * _ROW)
                order = np.argsort(known)
                mine = mix(anchor + doc.astype(np.uint64) * _ROW)
                place = np.minimum(np.searchsorted(known[order], mine), max(len(known) - 1, 0))
                own = np.flatnonzero(known[order][place] == mine) if len(known) else np.zeros(0, np.int64)
                salts = sizes[at[lo] : at[hi]][order[place[own]]] if len(own) else np.zeros(0, np.int64)
                sym = (h >> np.uint64(32)).astype(">u4")
                symbols = sym.tobytes()
                rel = (w0 - first[doc])[own]
                whole = salts > 0
                ctx = [symbols[4 * a : 4 * (z + window)] for a, z in zip(w0[own].tolist(), w1[own].tolist())]
                key = np.where(whole, span_hashes(h, w0[own], w1[own] + window), anchor[own])
                other = span_hashes(mix(h + np.uint64(77)), w0[own], w1[own] + window)
                who = doc[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(other.view(np.int64)), pa.array(ids[lo:hi][who]), pa.array(prints[lo:hi][who]), pa.array(rel.astype(np.int32)), pa.array(ctx, pa.binary()), pa.array(salts.astype(np.int64))],
                    ["key", "other", "k", "th", "start", "ctx", "salts"],
                )

    return run


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and its values' lengths."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8), np.diff(off)


def _windows(window: int):
    """Each window of each context, by two hashes of its full depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            buf, length = _binary(b.column(3))
            sym = buf.view(">u4").astype(np.uint64)
            size = length // 4
            count = size - window + 1
            row = np.repeat(np.arange(len(size)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(size) - size, count) + within
            one, two = gram_hashes(mix(sym + np.uint64(1)), window)[at], gram_hashes(mix(sym + np.uint64(99)), window)[at]
            k, th, start, salts = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(k[row]), pa.array(th[row]), pa.array((start[row] + within).astype(np.int32)), pa.array(salts[row])], ["key", "other", "k", "th", "start", "salts"])

    return run


def _repeats(key, k, start, length, buf, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Subtrees of whole groups: (context, window within it) of each leaf of a deep node that is not its first."""
    count = length // 4 - window + 1
    ctx = np.repeat(np.arange(len(key)), count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(np.cumsum(length) - length, count) + 4 * within
    leaves = np.empty((len(ctx), 8 + 4 * window), np.uint8)
    leaves[:, :8] = key.astype(">u8").view(np.uint8).reshape(-1, 8)[ctx]
    leaves[:, 8:] = np.lib.stride_tricks.sliding_window_view(buf, 4 * window)[begin]
    where = start[ctx] + within
    early = np.lexsort((where, k[ctx]))  # then the stable sort by suffix keeps each node's leaves in their order
    order = early[np.argsort(leaves[early].view(f"S{8 + 4 * window}").ravel(), kind="stable")]
    suffix = leaves[order]
    common = (suffix[1:] == suffix[:-1]).all(axis=1)  # the common prefix has full depth: both leaves hang from one deep node
    inside = np.concatenate(([False], common))
    head = np.maximum.accumulate(np.where(inside, 0, np.arange(len(order))))
    first = order[head]
    later = inside & ((k[ctx[order]] != k[ctx[first]]) | (where[order] != where[first]))
    hit = np.sort(order[later])
    return ctx[hit], within[hit]


def _subtrees(window: int):
    """Input sorted by key. Groups are kept whole; what a task holds is CHUNK contexts and one group more."""
    def work(t: pa.Table) -> pa.RecordBatch:
        key, k, th, start = (t.column(i).to_numpy() for i in range(4))
        ctx = t.column(4).combine_chunks()
        ctx = ctx.chunk(0) if isinstance(ctx, pa.ChunkedArray) else ctx
        buf, length = _binary(ctx)
        row, within = _repeats(key, k, start.astype(np.int64), length, buf, window)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (within[1:] != within[:-1] + 1)
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(row))[: len(a)] - 1
        lo = start[row[a]] + within[a]
        size = within[z] - within[a] + window
        return pa.RecordBatch.from_arrays([pa.array(k[row[a]]), pa.array(th[row[a]]), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32))], ["k", "th", "start", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                key = t.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield work(t.slice(0, cut))
                rest = t.slice(cut)
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield work(pa.Table.from_batches(held).combine_chunks())

    return run


def _later(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves: (key, other, k, th, start, salts, ..) of nodes at full depth; any other columns are alike in a node. Those that are not their node's first, and the firsts.

    A node's leaves may be a third of all rows: they are salted, by as many salts as its group has times `group_rows`, each
    salt has a minimum, and a node the least of those. A salt's leaves, some `group_rows`, become one row before its minimum meets
    the node's, so that join gives as many rows as there are salts and none for each leaf.
    One exchange serves the minima and the join; that all columns are read on both ways keeps it one.
    """
    alike = [c for c in leaves.columns if c not in ("key", "other", "k", "th", "start", "salts")]
    every = F.max(F.xxhash64(*leaves.columns)).alias("every")
    salted = leaves.where("key is not null and other is not null and k is not null and start is not null").withColumn("salt", F.pmod(F.xxhash64("k", "start"), F.col("salts"))).repartition("key", "other", "salt")
    parts = salted.groupBy("key", "other", "salt").agg(
        F.min(F.struct("k", "start")).alias("least"), every, F.collect_list(F.struct("k", "start", "th")).alias("leaves"), F.max("salts").alias("salts"), *[F.first(c).alias(c) for c in alike]
    )
    parts = parts.where("every is not null")
    firsts = parts.groupBy("key", "other").agg(F.min("least").alias("first"))
    firsts = parts.select("key", "other", "salt").join(firsts.select("key", "other", "first"), ["key", "other"])  # a row for each salt
    marked = parts.join(firsts, ["key", "other", "salt"])
    each = marked.select(F.explode("leaves").alias("leaf"), "first", "salts", *alike).select("leaf.*", "first", "salts", *alike)
    return each.where(F.struct("k", "start") > F.col("first")), each.where(F.struct("k", "start") == F.col("first"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(k, th, spans array<struct<th,start,size>>) for each document that has the first copy of its text; all others repeat one from end to end.

    k is doc_id (NO_ID for null), th the text's xxhash64; spans are its repeated word spans (start counts words from 0).
    """
    rows = docs.selectExpr(*_ROWS)
    return rows.select("d", "k", "th").distinct().join(_spans(rows, window, group_rows), "d").drop("d")


def _spans(rows: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(d, own, spans) of documents that have the first copy. rows: (d, k, th, text, ..); columns beyond these are passed along unused, so that all reads of the texts share one exchange."""
    more = rows.columns[4:]
    copies = rows.select("k", "d", F.md5("text").alias("md5")).where("md5 is not null").groupBy("md5").agg(F.min(F.struct("k", "d")).alias("first"))
    own = copies.select("first.d").distinct().withColumn("own", F.lit(True))
    firsts = rows.join(own, "d").select("d", "text", "k", "th", *more)
    # one exchange by anchor serves the counts and the join with them, as both read all of its columns; none is ever null,
    # but said so before it, no branch puts a check of its own below it
    anchors = firsts.mapInArrow(_anchors(window), "anchor long, d long, times int").where("anchor is not null and d is not null and times is not null").repartition("anchor")
    counts = anchors.groupBy("anchor").agg(F.sum("times").alias("n"), F.max("d").alias("last")).where("n > 1")
    salts = F.when(F.col("n") > group_rows, F.ceil(F.col("n") / group_rows)).otherwise(0).cast("long").alias("salts")
    runs = anchors.join(counts, "anchor").where("coalesce(d, 0) <= coalesce(last, 0) and times <= n").groupBy("d").agg(F.collect_set(F.struct("anchor", salts)).alias("runs"))
    chosen = rows.join(runs, "d").select("k", "text", "th", "runs", "d", *more)
    suffixes = chosen.mapInArrow(_suffixes(window), "key long, other long, k long, th long, start int, ctx binary, salts long")
    grouped = suffixes.where("salts = 0").select("key", "k", "th", "start", "ctx")
    spans = grouped.repartition("key").sortWithinPartitions("key").mapInArrow(_subtrees(window), "k long, th long, start int, size int")
    later, first = _later(suffixes.where("salts > 0").select("key", "other", "k", "th", "start", "ctx", "salts"))
    spans = spans.unionByName(later.select("k", "th", "start", F.expr("cast(octet_length(ctx) / 4 as int)").alias("size")))
    each = first.select("k", "th", "start", "ctx", "salts").mapInArrow(_windows(window), "key long, other long, k long, th long, start int, salts long")
    spans = spans.unionByName(_later(each)[0].select("k", "th", "start", F.lit(window).alias("size")))
    spans = spans.groupBy(F.xxhash64("k", "th").alias("d")).agg(F.sort_array(F.collect_list(F.struct("th", "start", "size"))).alias("spans"))
    return own.join(spans, "d", "left")


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _stripped(b, window)

    return run


def _stripped(b: pa.RecordBatch, window: int) -> pa.RecordBatch:
    kept, totals, gone = [], [], []
    for t, th, spans, copy in zip(b.column(0), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
        w = raw(t).split()
        totals.append(len(w))
        if copy and len(w) >= window:
            w = []
        elif spans.is_valid:
            parts, end = [], 0
            for s in spans.as_py():
                if s["th"] == th:
                    parts += w[end : s["start"]] if s["start"] > end else ()
                    end = max(end, s["start"] + s["size"])
            w = parts + w[end:]
        gone.append(totals[-1] - len(w))
        kept.append(b" ".join(w).decode())
    new = [pa.array(kept, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())]
    return pa.RecordBatch.from_arrays([*b.columns[4:], *new], [*b.schema.names[4:], "kept_text", "n_words", "n_removed"])


def strip_repeats(docs: DataFrame, window: int = WINDOW, group_rows: int = GROUP_ROWS, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (doc_id if None), kept_text (the kept words, joined by one space), n_words, n_removed."""
    columns = ["doc_id"] if columns is None else columns
    more = [c for c in columns if c != "doc_id"]  # doc_id comes back from k, so the rows are the same for every read
    rows = docs.select(*map(F.expr, _ROWS), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(more)])
    joined = rows.join(_spans(rows, window, group_rows), "d", "left")
    copy = F.col("text").isNotNull() & F.col("own").isNull()
    joined = joined.select("text", "th", "spans", copy.alias("copy"), F.expr(f"nullif(k, {NO_ID})").alias("_id"), *[f"_c{i}" for i in range(len(more))])
    kinds = ["_id long", *[f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(more)]]
    out = joined.mapInArrow(_strip(window), ", ".join([*kinds, "kept_text string", "n_words long", "n_removed long"]))
    names = {"doc_id": "_id"} | {c: f"_c{i}" for i, c in enumerate(more)}
    return out.select(*[F.col(names[c]).alias(c) for c in columns], "kept_text", "n_words", "n_removed")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return strip_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
