"""Near copies by Jaccard similarity of word runs: SimHash fingerprints propose pairs by multi-index hashing, exact similarity decides.

A text is the set of its runs of `size` words, lower-cased. Texts of equal sets are one node. A node's fingerprint has BITS bits, each the
majority of its runs' hashes. Two sets of similarity s have a cosine of 2 s / (1 + s), so a bit differs with probability
acos(2 s / (1 + s)) / pi: 0.15 at 0.8, 10 of 64 bits, where fingerprints of other texts differ in 64 / 2. A ball of that width has too many members to be
probed on 64 bits. So the fingerprint is wider: its first CHECK bits are what is verified, within a radius six deviations wide; the others are
cut into as many segments (`index_shape`) as a pair at the bound needs to share one but for a probability of MISS. Segments lengthen with the logarithm of the
nodes, so that a bucket holds about LOAD of them at any size, and all members of a bucket are verified one with another.
Texts of at most SHORT runs, whose few votes tie often, are also filed under each run. What is left is linked if its exact similarity reaches the bound.

In buckets of more than `small` members (near copies by the thousand) each member first meets
the bucket's first node, so pairs stay linear in the members. That
settles each large bucket whose members are then one class: no further pair could change it. The members of all other
large buckets are joined exactly: in any one order of all runs, two linked texts share one of the first
n - ceil(0.8 n) + 1 of the longer one's n runs, and of the first n - ceil(2 * 0.8 / 1.8 n) + 1 of the shorter one's. The order
here is the rarest first, so passages that many texts share come last and propose next to nothing. Only
pairs of different classes are compared. Each text also has the parities of its runs in 64 * WORDS slots: two texts differ in at
least as many runs as parities, so a pair that differs in too many is no link and is dropped as it meets. So the bound `small`
changes the work and no class.

Edge cases: a text of fewer words is one run; null and empty texts are one class; repeated rows share a class; the least id names
a class, and ids must not be null (`simhash.keep_one` numbers the rows first, so its callers' may be); a similarity of exactly the
bound is a link; very long texts are read whole, one at a time; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, checkpoint, gram_hashes, mix, rows_left, slices, stored, word_hashes, words
from .simhash import components

SIZE, SIMILARITY = 5, 0.8
BITS, CHECK = 2048, 128  #: of a fingerprint, and of its part that is verified
MISS = 2e-4  #: probability that a pair at the bound shares no segment
LOAD = 32  #: nodes in a bucket at most, on average, where texts have nothing in common
SHORT = 8  #: runs of a text that is filed under each of them, too
SMALL = 64  #: members of a bucket that are verified one with another
SLOTS = 1 << 22  #: of the bitmap
RARITY = 1 << 18  #: counts of runs by hash, which order them: collisions change the order, not what is found
BLOCK = 512  #: rows of a shared run that meet in one task
WORDS = 16  #: of 64 bits, of a text's parities
_rng = np.random.default_rng(20240611)
_XOR = _rng.integers(0, 1 << 63, BITS // 64, dtype=np.uint64)


def distinct_runs(column: pa.Array, size: int):
    """For each slice: first row, end row, hashes of each row's distinct runs, and where each row's begin (one more at the end)."""
    for lo, hi, buf, off in slices(column):
        buf = LOWER[buf]
        starts, ends, first = words(buf, off, NOT_SPACE)
        h, count = word_hashes(buf, starts, ends), np.diff(first)
        left, row = rows_left(first), np.repeat(np.arange(hi - lo), count)
        runs, rows = [], []
        for n in [size, *sorted(set(count[(count > 0) & (count < size)].tolist()))]:
            g = gram_hashes(h, n)
            pick = np.flatnonzero((left[: len(g)] >= n) & ((count[row[: len(g)]] == n) | (n == size)))
            runs.append(mix(g[pick] + np.uint64(n)))
            rows.append(row[pick])
        runs, rows = np.concatenate(runs), np.concatenate(rows)
        by = np.lexsort((runs, rows))
        runs, rows = runs[by], rows[by]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (rows[1:] != rows[:-1])
        runs, rows = runs[new], rows[new]
        yield lo, hi, runs, np.searchsorted(rows, np.arange(hi - lo + 1))


def prints(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, a row of BITS / 8 bytes: the majority of its runs' hashes in each bit; half of them is none. Texts have runs, one at least."""
    n = np.diff(at)
    blocks = -(-n // 255)  # bits are added up in bytes
    own = np.concatenate(([0], np.cumsum(blocks)))
    starts = np.repeat(at[:-1], blocks) + (np.arange(own[-1]) - np.repeat(own[:-1], blocks)) * 255
    out = np.empty((len(n), BITS // 64, 8), np.uint8)
    for i, x in enumerate(_XOR):
        h, votes = mix(runs ^ x), np.empty((len(n), 8, 8), np.int64)
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
            votes[:, k] = np.add.reduceat(lanes, own[:-1], axis=0, dtype=np.int64)
        out[:, i] = np.packbits((votes * 2 > n[:, None, None]).reshape(len(n), 64), axis=1)
    return out.reshape(len(n), BITS // 8)


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, runs, at in distinct_runs(b.column(1), size):
                n = np.diff(at)
                some = np.flatnonzero(n)
                node, print_, short = np.zeros(hi - lo, np.uint64), np.zeros((hi - lo, BITS // 8), np.uint8), n * (n <= SHORT)
                if len(some):
                    node[some] = mix(np.add.reduceat(mix(runs ^ _XOR[0]), at[some]))
                    print_[some] = prints(runs, np.append(at[some], at[-1]))
                few = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(short))).astype(np.int32)), pa.array(runs[np.repeat(short > 0, n)].view(np.int64)))
                flat = pa.array(print_.ravel())
                held = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (BITS // 8)).buffers()[1], flat.buffers()[1]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(node.view(np.int64)), pa.array(n.astype(np.int32)), held, few], ["doc_id", "node", "n", "print", "few"])

    return run


def index_shape(nodes: int, similarity: float) -> tuple[int, int, int]:
    """Bits of a segment, segments, and the radius of CHECK bits, for so many nodes."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    width = min(48, max(12, math.ceil(math.log2(max(nodes, 1) / LOAD))))
    share = (1 - p) ** width
    return width, 1 if share == 1 else math.ceil(math.log(MISS) / math.log1p(-share)), math.floor(CHECK * p + 6 * math.sqrt(CHECK * p * (1 - p)))


def segments(width: int, count: int) -> np.ndarray:
    """The bits of each segment, none of the first CHECK: disjoint until all are used, then drawn anew."""
    draw, free = np.random.default_rng(20240705), BITS - CHECK
    each = free // width
    return CHECK + np.concatenate([draw.permutation(free)[: each * width].reshape(each, width) for _ in range(-(-count // each))])[:count]


def _keys(width: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of = segments(width, count)
        weights = (1 << np.arange(width)).astype(np.float64)
        for whole in batches:
            for b in (whole.slice(lo, 1024) for lo in range(0, whole.num_rows, 1024)):
                node, few = b.column(0).to_numpy(), b.column(2)
                raw = np.frombuffer(b.column(1).buffers()[2], np.uint8)
                first = b.column(1).offset * (BITS // 8)
                raw = raw[first : first + len(node) * (BITS // 8)].reshape(len(node), BITS // 8)
                check = np.ascontiguousarray(raw[:, : CHECK // 8]).view(np.int64)
                bits = np.unpackbits(raw, axis=1)
                keys = np.empty((count, len(node)), np.int64)
                for i, own in enumerate(bits_of):
                    value = (bits[:, own] @ weights).astype(np.uint64)
                    keys[i] = mix(value + np.uint64((i + 1) << 48)).view(np.int64) >> 32
                runs = few.flatten().to_numpy()
                row = np.concatenate((np.tile(np.arange(len(node)), count), np.repeat(np.arange(len(node)), np.diff(few.offsets.to_numpy()))))
                key = np.concatenate((keys.ravel(), mix(runs.view(np.uint64)).view(np.int64) >> 32)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, node[row], check[row, 0], check[row, 1])], ["key", "node", "c0", "c1"])

    return run


def _near(c: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(c[i] ^ c[j]).sum(axis=1, dtype=np.int64) <= radius


def _meet(small: int, radius: int):
    """Rows come by key and node. Yields (a, b, false) for pairs within the radius, (key, node, true) for members of large buckets."""

    def out(*parts):
        parts = [(x, y, m) for x, y, m in parts if len(x)]
        if parts:
            x, y = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(np.repeat([p[2] for p in parts], [len(p[0]) for p in parts]))], ["a", "b", "many"])

    def large(key, node, c, first):
        """Members of one large bucket, whose first row is given."""
        near = (np.bitwise_count(c ^ first[1]).sum(axis=1, dtype=np.int64) <= radius) & (node != first[0])
        yield from out((np.full(near.sum(), first[0]), node[near], False), (np.full(len(node), key, np.int64), node, True))

    def whole(key, node, c):
        """Buckets that are complete."""
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(new, len(key)))
        for at, n in zip(new[size > small], size[size > small]):
            yield from large(key[at], node[at : at + n], c[at : at + n], (node[at], c[at]))
        few = np.repeat(size <= small, size)
        left = np.repeat(new + size, size) - np.arange(len(key))  # rows of the bucket from this one on
        i = np.flatnonzero(few & (left > 1))
        step = 1
        while len(i):
            near = i[_near(c, i, i + step, radius)]
            a, b = node[near], node[near + step]
            yield from out((np.minimum(a, b)[a != b], np.maximum(a, b)[a != b], False))
            step += 1
            i = i[left[i] > step]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None  # rows of the last bucket, or the first row of a large one whose rows are no longer held
        for b in batches:
            if not b.num_rows:
                continue
            key, node, c = b.column(0).to_numpy(), b.column(1).to_numpy(), np.column_stack([b.column(i).to_numpy() for i in (2, 3)]).view(np.uint64)
            if first is not None:
                same = int(np.searchsorted(key, first[2], "right"))
                if same:
                    yield from large(first[2], node[:same], c[:same], first)
                if same == len(key):
                    continue
                key, node, c, first = key[same:], node[same:], c[same:], None
            if held is not None:
                key, node, c = (np.concatenate(x) for x in zip(held, (key, node, c)))
            last = int(np.searchsorted(key, key[-1], "left"))
            if last:
                yield from whole(key[:last], node[:last], c[:last])
            held = key[last:], node[last:], c[last:]
            if len(held[0]) > small:
                first = held[1][0], held[2][0], held[0][0]
                yield from large(held[0][0], held[1], held[2], first)
                held = None
        if held is not None:
            yield from whole(*held)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, runs, at in distinct_runs(b.column(1), size):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(runs.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), lists], ["node", "runs"])

    return run


PARITY = [f"w{i}" for i in range(WORDS)]


def parities(runs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, the parity of the number of its runs in each slot, as WORDS longs."""
    out, slot = np.empty((len(at) - 1, WORDS), np.int64), (mix(runs.view(np.uint64)) % np.uint64(64 * WORDS)).astype(np.int64)
    for i in range(len(at) - 1):
        odd = np.bincount(slot[at[i] : at[i + 1]], minlength=64 * WORDS) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return out


def _prefixes(counts, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(counts.value, np.int64)
        for b in batches:
            node, root, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            runs = lists.values.to_numpy()[at[0] : at[-1]]
            at -= at[0]
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            by = np.lexsort((runs, often[runs & (RARITY - 1)], row))
            first = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            pick = np.arange(len(runs)) - np.repeat(at[:-1], n) < np.repeat(first, n)
            at_most = n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1
            rank = (np.arange(len(runs)) - np.repeat(at[:-1], n))[pick]
            row = row[pick]
            own = parities(runs, at)
            columns = node[row], root[row], n[row].astype(np.int32), runs[by][pick], rank.astype(np.int32), rank < at_most[row], *(own[row, i] for i in range(WORDS))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["node", "root", "n", "run", "rank", "leads", *PARITY])

    return run


def proposals(nodes: DataFrame, similarity: float, small: int = SMALL) -> DataFrame:
    """(a, b, many): distinct pairs within the radius, and (key, node, true) for members of large buckets, written out. nodes: distinct (node, n, print, few)."""
    some = nodes.where("n > 0")
    width, count, radius = index_shape(some.count(), similarity)
    keys = some.select("node", "print", "few").mapInArrow(_keys(width, count), "key int, node long, c0 long, c1 long")
    met = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_meet(small, radius), "a long, b long, many boolean")
    return stored(met.distinct())


def unsettled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): members (key, node) of large buckets that hold more than one class."""
    many = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = many.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return many.join(mixed, "key").select("node", "root").distinct()


def across(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) with a < b: all pairs of different classes that can reach the similarity. sets: (node, root, runs)."""
    slot = F.col("run").bitwiseAND(F.lit(RARITY - 1).cast("long"))
    found = sets.select(F.explode("runs").alias("run")).groupBy(slot.alias("slot")).count().toArrow()
    counts = np.zeros(RARITY, np.int64)
    counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
    counts = sets.sparkSession.sparkContext.broadcast(counts.tobytes())
    first = stored(sets.select("node", "root", "runs").mapInArrow(_prefixes(counts, similarity), ", ".join(["node long, root long, n int, run long, rank int, leads boolean", *(f"{w} long" for w in PARITY)])))
    groups = first.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("leads").alias("leads"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = first.join(groups.where("lo < hi and leads").select("run", "blocks"), "run")
    fields = "node", "root", "n", "rank", *PARITY
    one = held.where("leads").select("run", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), *(F.col(x).alias(f"{x}_a") for x in fields))
    two = held.select("run", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *(F.col(x).alias(f"{x}_b") for x in fields))
    # the shorter text leads; what follows a shared run bounds all that two texts share from it on
    reach = F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) + F.least("rank_a", "rank_b")
    met = (F.struct("n_a", "node_a") < F.struct("n_b", "node_b")) & (F.col("root_a") != F.col("root_b")) & (F.col("n_a") >= similarity * F.col("n_b"))
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in PARITY), F.lit(0))
    both = F.col("n_a") + F.col("n_b")
    close = (reach * (1 + similarity) >= similarity * both - 1e-6) & (apart * (1 + similarity) <= (1 - similarity) * both + 1e-6)
    pairs = one.join(two, ["run", "block"]).where(met & close)
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def run_sets(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, runs) of the nodes (node, rep), written out: each one's distinct runs, read from the text of its representative."""
    # before the join, rows pass a bitmap of fixed size, 64 slots a row: however many are wanted, that only lets more through
    slot = lambda name: F.pmod(F.xxhash64(name), F.lit(SLOTS))
    bitmap = nodes.select(slot("rep").alias("slot")).groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits"))
    some = docs.withColumn("slot", slot("doc_id")).join(F.broadcast(bitmap), F.shiftright("slot", 6) == F.col("at")).where("shiftright(bits, cast(slot & 63 as int)) & 1 = 1").select("doc_id", "text")
    return stored(some.join(nodes, some["doc_id"] == nodes["rep"]).select("node", "text").mapInArrow(_sets(size), "node long, runs array<long>"))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs whose sets reach the similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("runs").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("runs").alias("two")), "b")
    shared = F.size(F.array_intersect("one", "two"))
    return both.where(shared >= F.lit(similarity) * (F.size("one") + F.size("two") - shared)).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(doc_id, component_id) for each row of docs (doc_id, text): classes of texts linked at the similarity. doc_id names one row each and is not null."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = stored(docs.mapInArrow(_prints(size), "doc_id long, node long, n int, print binary, few array<long>"))
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), *(F.first(x).alias(x) for x in ("n", "print", "few"))))
    met = proposals(nodes, similarity, small)
    pairs, members = met.where("not many").select("a", "b"), met.where("many").select(F.col("a").alias("key"), F.col("b").alias("node"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members.select("node"))
    wanted = stored(wanted.distinct().join(nodes.select("node", "rep"), "node"))
    sets = run_sets(docs, wanted, size)
    roots = stored(components(alike(pairs, sets, similarity)))
    rest = stored(unsettled(members, roots))
    if not rest.isEmpty():
        held = sets.join(rest, "node")
        more = alike(across(held, similarity), held, similarity)
        # classes that these links join: the least of them names all
        for x in "ab":
            more = more.join(rest.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x)
        joined = components(more.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct())
        # roots has no row for a root itself
        joined = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = roots.unionByName(rest.select(F.col("root").alias("node"), "root").distinct()).join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    named = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = named.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")
