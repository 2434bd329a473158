"""Language-model scoring by prediction by partial matching (operator 3).

The model codes the lower-cased text byte by byte: words, each followed by one space, then an end. Its contexts are the
last 0 to `order` bytes; the longest that the trie knows predicts, with escape estimate C and full symbol exclusion:
n / (total + distinct) for a symbol that followed, else an escape to the next shorter context, where the symbols that
were possible before are left out of the sums. Below order 0 all remaining bytes are alike.

The model is pretrained, static and uncut: counts cover all contexts of all training texts, so they grow with the corpus.
A position's probability depends on the symbol and `order` bytes before it alone (its key), so it is computed once for each
distinct key of the texts: keys are partitioned by the context's last SHARED + 1 bytes, where all of their longer contexts
meet, and each group makes a trie of its own; orders 0 to SHARED (2**24 edges at most, as many as there are distinct three
bytes) are broadcast. A document is then reduced to its positions' keys: the commonest, at most `nodes`, are looked up in a
broadcast table, all others are joined as (document, key, times), so that bound changes no score. Words of the base score
likewise: the commonest, at most `head`, are broadcast; all others are joined.

Edge cases: null and empty texts are the end token alone; very long texts are worked through like any other, whole; a null
doc_id counts as remainder 0, so it is held out; repeated rows are scored each and all train; equal texts get equal scores, as
nothing depends on the order of rows or ties; an empty table gives no rows; without training rows (N = V = 0) the base is
log10(0.1 / 0.1) = 0 for each token; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Table, fold, slices, stored, word_hashes, words

ORDER = 5
SHARED = 2  #: orders up to this one are broadcast
NODES = 1 << 21  #: keys in the broadcast part of the model at most
HEAD = 1 << 20  #: words in the broadcast part of the counts at most
STEP = 1 << 19  #: bytes of text worked on at once
END = 0x0A
END_WORD = np.uint64(0x0E0D0E0D0E0D0E0D)
GROUP = 1 << 18  #: keys of a trie at least, if there are more groups
GRAM, WORD, OTHER = 0, 1, 2  #: of training texts; OTHER: keys of held-out texts


def _stream(buf: np.ndarray, off: np.ndarray, order: int):
    """The coded bytes of a slice, `order` ends before each text; where each text's own bytes begin and end; its words' hashes and bounds."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, off, NOT_SPACE)
    size = ends - starts
    row = np.repeat(np.arange(len(off) - 1), np.diff(first))
    before = np.concatenate(([0], np.cumsum(size)))
    stop = before[first[1:]] + first[1:] + (order + 1) * np.arange(1, len(off))
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    start = np.concatenate(([0], stop[:-1]))
    for j in range(order):
        out[start + j] = END
    out[stop - 1] = END
    put = np.arange(before[-1]) + np.repeat(np.arange(len(size)) + order * (row + 1) + row, size)
    take = np.arange(before[-1]) + np.repeat(starts - before[:-1], size)
    out[put] = buf[take]
    return out, start + order, stop, word_hashes(buf, starts, ends), first


def _grams(stream: np.ndarray, order: int) -> np.ndarray:
    """At each position the byte with those before it, the byte lowest."""
    key = stream.astype(np.uint64)
    for j in range(1, order + 1):
        key[j:] |= stream[:-j].astype(np.uint64) << np.uint64(8 * j)
    return key


def _own(start: np.ndarray, stop: np.ndarray, order: int) -> np.ndarray:
    size = stop - start
    return np.arange(size.sum()) + np.repeat(np.arange(1, len(size) + 1) * order, size)


def _count(order: int, hold: int = 1 << 21):
    """Keys and words of training texts; of rows whose second column (held_out) is true, keys alone."""

    def flush(kind: int, parts: list):
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        u, inv = np.unique(keys, return_inverse=True)
        n = np.bincount(inv, counts, len(u)).astype(np.int64)
        return u, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {GRAM: [], WORD: [], OTHER: []}

        def emit(kind):
            u, n = flush(kind, held[kind])
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int8)), pa.array(u.view(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for b in batches:
            out_of = b.column(1).to_numpy(zero_copy_only=False).astype(bool) if b.num_columns > 1 else np.zeros(b.num_rows, bool)
            for kept, texts in ((True, b.column(0).filter(pa.array(~out_of))), (False, b.column(0).filter(pa.array(out_of)))):
                for _, _, buf, off in slices(texts, STEP):
                    out, start, stop, h, _ = _stream(buf, off, order)
                    held[GRAM if kept else OTHER].append(np.unique(_grams(out, order)[_own(start, stop, order)], return_counts=True))
                    if kept:
                        held[WORD].append(np.unique(np.concatenate((h, np.full(len(start), END_WORD))), return_counts=True))
                    for kind in held:
                        if sum(len(k) for k, _ in held[kind]) > hold:
                            held[kind] = [flush(kind, held[kind])]
                            if len(held[kind][0][0]) > hold // 2:
                                yield emit(kind)
        for kind in held:
            if held[kind]:
                yield emit(kind)

    return run


class Trie:
    """The model. levels: for each order, keys of edges (context and symbol, the symbol lowest) and their counts."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.edges, self.nodes = [], []
        logn, kept, seen, at = [], [], [], []
        for key, n in levels:
            order = np.argsort(key)
            key, n = key[order], n[order].astype(float)
            ctx, each, count = np.unique(key >> np.uint64(8), return_inverse=True, return_counts=True)
            self.edges.append(Table(key))
            self.nodes.append(Table(ctx))
            logn.append(n)
            kept.append(np.bincount(each, n, len(ctx)))
            seen.append(count.astype(float))
            at.append((key, each, ctx))
        self.log, self.direct, self.escape, self.less, self.pass_on = [], [], [], [], []
        for d, (key, each, ctx) in enumerate(at):
            whole = kept[d] + seen[d]
            n = logn[d]
            self.log.append(np.log10(n).astype(np.float32))
            self.direct.append(np.log10(n / whole[each]).astype(np.float32) if len(n) else np.zeros(0, np.float32))
            self.escape.append(np.log10(seen[d] / whole).astype(np.float32))
            if d == 0:
                free = max(1, 256 - len(key))
                self.less.append(np.full(len(ctx), np.log10(free), np.float32))
                self.pass_on.append(np.zeros(len(ctx), np.float32))
                continue
            # the shorter context without the symbols that this one knows
            up = self.nodes[d - 1].find(ctx & np.uint64((1 << 8 * (d - 1)) - 1))
            same = self.edges[d - 1].find(key & np.uint64((1 << 8 * d) - 1))
            shared = np.bincount(each, logn[d - 1][same], len(ctx)) if len(key) else np.zeros(0)
            rest = np.maximum(kept[d - 1][up] - shared, 0)
            new = seen[d - 1][up] - seen[d]
            new = np.where(rest > 0, new, 1.0)
            rest = np.where(seen[d - 1][up] > seen[d], rest, 0.0)
            new = np.where(rest > 0, new, 1.0)
            self.less.append(np.log10(rest + new).astype(np.float32))
            self.pass_on.append(np.log10(new / (rest + new)).astype(np.float32))

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 of each symbol's probability after its context."""
        top = len(self.edges) - 1
        edge = self.edges[top].find(key)
        out = self.direct[top][edge].astype(float) if len(self.direct[top]) else np.zeros(len(key))
        todo = np.flatnonzero(edge < 0)
        out[todo] = 0
        key = key[todo]
        below = np.full(len(todo), -1, np.int64)  # the node left by an escape, or -1 where no context was known so far
        for d in range(top, -1, -1):
            if not len(todo):
                break
            part = key & np.uint64((1 << 8 * (d + 1)) - 1)
            node = self.nodes[d].find(part >> np.uint64(8))
            if d < top:
                edge = self.edges[d].find(part)
                hit = edge >= 0
                fresh = hit & (below < 0)
                later = hit & (below >= 0)
                out[todo[fresh]] += self.direct[d][edge[fresh]]
                out[todo[later]] += self.log[d][edge[later]] - self.less[d + 1][below[later]]
                on = ~hit & (below >= 0)
                out[todo[on]] += self.pass_on[d + 1][below[on]]
                start = ~hit & (below < 0) & (node >= 0)
                out[todo[start]] += self.escape[d][node[start]]
                stay = ~hit
                todo, key, below = todo[stay], key[stay], node[stay].astype(np.int64)
            else:
                start = node >= 0
                out[todo[start]] += self.escape[d][node[start]]
                below = node.astype(np.int64)
        if len(todo):
            free = self.less[0][0] if len(self.less[0]) else np.log10(256)
            out[todo] -= free
        return out


def _level(key: np.ndarray, n: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of order d and their counts, from keys of longer contexts."""
    edge, at = np.unique(key & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
    return edge, np.bincount(at, n, len(edge))


def _model(order: int, low):
    """The probability of each key; rows come by group, a group in one run."""

    def solve(parts):
        kind, key, n = (np.concatenate(x) for x in zip(*parts))
        mine = kind == GRAM
        upper = [_level(key[mine], n[mine], d) for d in range(min(order, SHARED) + 1, order + 1)]
        keys, at = np.unique(key, return_inverse=True)
        logp = Trie([*low.value, *upper]).score(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, n, len(keys)).astype(np.int64)), pa.array(logp)], ["key", "n", "logp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            kind, key, n, group = (b.column(i).to_numpy() for i in range(4))
            cut = np.flatnonzero(np.diff(group, prepend=group[0] if last is None else last))
            lo = 0
            for c in cut.tolist():
                if size + c - lo >= GROUP:
                    held.append((kind[lo:c], key[lo:c].astype(np.uint64), n[lo:c]))
                    yield solve(held)
                    held, size, lo = [], 0, c
            held.append((kind[lo:], key[lo:].astype(np.uint64), n[lo:]))
            size, last = size + len(key) - lo, group[-1]
        if held:
            yield solve(held)

    return run


def model(counts: DataFrame, order: int) -> DataFrame:
    """(key, n, logp) for each key of all texts, n its positions; written out."""
    grams = counts.where(F.col("kind") != WORD)
    mask = F.lit((1 << 8 * (SHARED + 1)) - 1).cast("long")
    got = grams.where(F.col("kind") == GRAM).groupBy(F.col("key").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    key, n = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()
    low = counts.sparkSession.sparkContext.broadcast([_level(key, n, d) for d in range(min(order, SHARED) + 1)])
    group = F.shiftright("key", 8).bitwiseAND(mask)
    rows = grams.select("kind", "key", "n", group.alias("group")).repartition("group").sortWithinPartitions("group")
    return stored(rows.mapInArrow(_model(order, low), "key long, n long, logp double"))


def commonest(keys: DataFrame, most: int) -> int:
    """The least n such that at most `most` keys have it or more."""
    top = 1 << 16
    least, below = top, 0
    seen = dict(keys.groupBy(F.least("n", F.lit(top)).alias("n")).count().collect())  # so many rows at most
    for n in sorted(seen, reverse=True):
        below += seen[n]
        if below > most:
            break
        least = n
    if seen.get(top, 0) > most:
        return max(top, -(-(keys.agg(F.sum("n")).first()[0]) // most))
    return least if below > most else 1


def _lists(row: np.ndarray, key: np.ndarray, n: int) -> pa.ListArray:
    """For each of n rows its distinct keys and how often each occurs."""
    by = np.lexsort((key, row))
    row, key = row[by], key[by]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    i = np.flatnonzero(new)
    tf = np.diff(np.append(i, len(row)))
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(row[i], np.arange(n + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(key[i].view(np.int64)), pa.array(tf.astype(np.int32))], ["key", "tf"]),
    )


def _score(order: int, trie, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (grams, logp), (table, logc) = trie.value, head.value
        for b in batches:
            for lo, hi, buf, off in slices(b.column(2), STEP):
                out, start, stop, h, first = _stream(buf, off, order)
                key = _grams(out, order)[_own(start, stop, order)]
                edge = grams.find(key)
                bits = np.concatenate(([0.0], np.cumsum(logp[edge])))  # the last, for -1, is 0
                rare = np.flatnonzero(edge < 0)
                rare = _lists(np.repeat(np.arange(hi - lo), stop - start)[rare], key[rare], hi - lo)
                at = np.concatenate(([0], np.cumsum(stop - start)))
                score = bits[at[1:]] - bits[at[:-1]]
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                seen = table.find(h)
                miss = np.flatnonzero(seen < 0)
                ends = table.find(np.full(1, END_WORD, np.uint64))[0]
                base = np.bincount(row, np.where(seen >= 0, logc[seen], 0.0), hi - lo) + (logc[ends] if ends >= 0 else 0.0)
                n_known = np.bincount(row, seen >= 0, hi - lo).astype(np.int64) + (ends >= 0)
                # words beyond the head, once for each document
                r, w = row[miss], h[miss]
                if ends < 0:  # so few documents that their end is no common token
                    r, w = np.append(r, np.arange(hi - lo)), np.append(w, np.full(hi - lo, END_WORD))
                lists = _lists(r, w, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(base), pa.array(score), lists, rare],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail", "rare"],
                )

    return run


def score(docs: DataFrame, mod: int = 10, order: int = ORDER, nodes: int = NODES, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", fold("doc_id", mod) == 0)
    counts = stored(docs.select("text", "held_out").mapInArrow(_count(order), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    tokens = counts.where(F.col("kind") == WORD).select("key", "n")
    total, distinct = tokens.agg(F.sum("n"), F.count("*")).first()
    total, denominator = total or 0, (total or 0) + 0.1 * (distinct + 1)
    least = max(1, -(-total // head))
    top = tokens.where(F.col("n") >= least).toArrow()
    key, n = top.column(0).to_numpy(), top.column(1).to_numpy()
    common = spark.sparkContext.broadcast((Table(key.astype(np.uint64)), np.append(np.log10((n + 0.1) / denominator), 0.0)))
    keys = model(counts, order)
    often = commonest(keys, nodes)
    got = keys.where(F.col("n") >= often).select("key", "logp").toArrow()
    trie = spark.sparkContext.broadcast((Table(got.column(0).to_numpy().astype(np.uint64)), np.append(got.column(1).to_numpy(), 0.0)))
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(
        _score(order, trie, common), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<struct<key:long,tf:int>>, rare array<struct<key:long,tf:int>>"
    )
    rows = stored(rows.withColumn("rid", F.monotonically_increasing_id()))
    tail = rows.select("rid", F.inline("tail")).join(tokens.where(F.col("n") < least), "key", "left")
    c = F.coalesce("n", F.lit(0))
    tail = tail.groupBy("rid").agg(F.sum(F.col("tf") * F.log10((c + 0.1) / denominator)).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"))
    rare = rows.select("rid", F.inline("rare")).join(keys.where(F.col("n") < often).select("key", "logp"), "key")
    rare = rare.groupBy("rid").agg(F.sum(F.col("tf") * F.col("logp")).alias("rarely"))
    return rows.drop("tail", "rare").join(tail, "rid", "left").join(rare, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("rarely", F.lit(0.0))).alias("score"),
    )


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
