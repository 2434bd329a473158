"""Approximate maximum inner product search over stored indexes: an inverted file with product quantization, and hash tables.

Both are built once, over every vector, and passed in; both give out exact scores, as what they find is reranked by the vectors.
Cells and buckets of any size are cut into blocks, which are rows of the index, so a hot one is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import stored
from . import search
from .search import _matrix, _with_own, dot, grid, named, ranked

BLOCK = 4096  #: vectors of a cell or bucket in one row of an index
QUERIES = 256  #: queries that are scored at once
SHARE = 1024  #: queries of a task that searches an inverted file
FILE_BYTES, ROW_BYTES = 64 << 20, 16  #: of an inverted file that a task reads, and of each of its rows beside the code
SPAN = 1 << 16  #: vectors of a block of hash tables
CODES = 256  #: of a codebook
FULL = 5  #: times a budget: rows in all the buckets that a query probes, counted in each table
HELD = 1 << 20  #: pairs found that a task holds before it drops those that can't be among its best


def exact_scores(cands: DataFrame, q: DataFrame, p: DataFrame, k: int) -> DataFrame:
    """(qid, docid, score, rank): the best k of each query's candidates (qid, docid) by their vectors."""
    full = cands.join(q.select("qid", F.col("embedding").alias("qe")), "qid").join(p.select("docid", F.col("embedding").alias("pe")), "docid")
    return ranked(full.select("qid", "docid", F.round(dot("qe", "pe"), 6).alias("score")), k=k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _packed(rows: DataFrame, *keys: str) -> DataFrame:
    """rows (keys.., docid, ..) as one row for each block of a key: keys.., docids, and each other column as an array in the same order."""
    others = [c for c in rows.columns if c not in (*keys, "docid")]
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = rows.join(sizes, [*keys]).withColumn("_block", F.pmod(F.xxhash64("docid"), F.ceil(F.col("_n") / BLOCK)))
    out = cut.groupBy(*keys, "_block").agg(F.collect_list(F.struct("docid", *others)).alias("_all"))
    return out.select(*keys, F.col("_all.docid").alias("docids"), *[F.col(f"_all.{c}").alias(c) for c in others])


# inverted file


@dataclass
class Ivf:
    """blocks (cell, docids, codes): the stored file; centres and the codebooks of residuals, by part of the vector."""

    blocks: DataFrame
    centres: np.ndarray
    books: list[np.ndarray]


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[lo : lo + 4096] @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1) for lo in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _parts(width: int, size: int) -> list[slice]:
    return [slice(lo, min(lo + size, width)) for lo in range(0, width, size)]


def ivf_index(p: DataFrame, nlist: int | None = None, spill: int = 3, part: int = 4, seed: int = 7, sample: int = 50_000) -> Ivf:
    """The index of `knn_ivf` over every row of p (docid, embedding).

    Cells (twice the square root of the rows, unless given) come from k-means, codebooks for each `part` dimensions of the residuals from
    their own tasks, both fitted on at most `sample` vectors of least id hash. A vector is filed in its `spill` nearest cells, as the code of its residual there.
    """
    rows = named(p).select("docid", "embedding")
    chosen = stored(rows.orderBy(F.xxhash64("docid"), "docid").limit(sample))
    n, width = rows.count(), chosen.agg(F.max(F.size("embedding"))).first()[0]
    if not n:
        return Ivf(rows.selectExpr("0 as cell", "array(docid) as docids", "array(cast('' as binary)) as codes").limit(0), np.zeros((1, 1)), [])
    usable = chosen.where(F.exists("embedding", lambda v: v != 0))
    nlist = max(1, min(math.ceil(2 * math.sqrt(n)) if nlist is None else nlist, usable.count()))
    if nlist == 1:
        centres = np.zeros((1, width))
    else:
        fitted = KMeans(k=nlist, seed=seed, maxIter=12, distanceMeasure="cosine", initMode="random").fit(usable.select(array_to_vector("embedding").alias("features")))
        centres = _unit(np.array(fitted.clusterCenters()))
    spill = min(spill, len(centres))
    cuts = _parts(width, part)

    def filed(x: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and cell numbers: each row's nearest cells. QUERIES rows at once, as cells grow with the rows."""
        near = lambda part: np.argpartition(-(part @ centres.T), times - 1, axis=1)[:, :times] if times < len(centres) else np.tile(np.arange(len(centres)), (len(part), 1))
        cells = np.concatenate([near(x[lo : lo + QUERIES]) for lo in range(0, max(len(x), 1), QUERIES)])
        return np.repeat(np.arange(len(x)), times), cells.reshape(-1)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0))
            row, cell = filed(x, 1)
            r = x[row] - centres[cell]
            for i, c in enumerate(cuts):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), i, np.int32)), pa.array(list(r[:, c]))], ["part", "x"])

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        i = int(pdf["part"].iloc[0])
        return pd.DataFrame({"part": [i], "book": [_lloyd(np.array(pdf["x"].tolist()), CODES, seed + i).reshape(-1)]})

    found = chosen.select("embedding").mapInArrow(residuals, "part int, x array<double>").groupBy("part").applyInPandas(book, "part int, book array<double>").collect()  # a codebook for each part
    books = [np.array(r.book).reshape(-1, c.stop - c.start) for r, c in zip(sorted(found, key=lambda r: r.part), cuts)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            row, cell = filed(x, spill)
            r = x[row] - centres[cell]
            codes = np.stack([(r[:, c] @ k.T - (k * k).sum(axis=1) / 2).argmax(axis=1) for c, k in zip(cuts, books)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32)), pa.array([v.tobytes() for v in codes], pa.binary())], ["docid", "cell", "code"])

    coded = stored(rows.mapInArrow(encode, "docid string, cell int, code binary"))
    return Ivf(stored(_packed(coded, "cell").withColumnRenamed("code", "codes")), centres, books)


def _foremost(t: pa.Table, k: int) -> pa.Table:
    """The k rows of largest score of each qid (of several alike those of least docid), each docid once, with its largest score."""
    t = t.group_by(["qid", "docid"]).aggregate([("score", "max")]).rename_columns(["qid", "docid", "score"])
    t = t.sort_by([("qid", "ascending"), ("score", "descending"), ("docid", "ascending")])
    q = t["qid"].combine_chunks().dictionary_encode()
    code = (q if not isinstance(q, pa.ChunkedArray) else q.combine_chunks()).indices.to_numpy()
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(code)), 0))
    return t.filter(pa.array(np.arange(len(code)) - first < k))


def knn_ivf(q: DataFrame, p: DataFrame, k: int, index: Ivf | None = None, nprobe: int | None = None, refine: int | None = None, exclude_self: bool = False) -> DataFrame:
    """The best k of what nprobe cells (a quarter of all, unless given) hold: the best `refine` (20 k) by their codes, ranked by their vectors.

    Queries and the file meet in a grid: a task has up to SHARE queries and as much of the file as FILE_BYTES, so a query's candidates leave one task for each such share.
    """
    index = ivf_index(p) if index is None else index
    refine = max(k, 20 * k if refine is None else refine)
    centres, books = index.centres, index.books
    nprobe = max(1, min(len(centres), len(centres) // 4 if nprobe is None else nprobe))
    queries = _with_own(q, exclude_self).where("qid is not null and embedding is not null").select("qid", "own", F.col("embedding").cast("array<double>").alias("embedding"))
    cuts = _parts(centres.shape[1], books[0].shape[1]) if books else []

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.StructArray] = []
        held: list[pa.Table] = []
        n, limit, probed = 0, HELD, None
        for side, rows in _sides(batches):
            if side == "q":
                asked.append(rows)
                continue
            if not asked:
                continue
            if probed is None:
                mine = pa.concat_arrays(asked)
                own, x = np.array(mine.field("own").to_pylist(), object), _matrix(mine.field("embedding"))
                base = x @ centres.T
                probed = np.zeros(base.shape, bool)
                for lo in range(0, len(x), QUERIES):
                    near = np.argsort(-base[lo : lo + QUERIES], axis=1, kind="stable")[:, :nprobe]
                    np.put_along_axis(probed[lo : lo + QUERIES], near, True, 1)
                adds = [x[:, c] @ table.T for c, table in zip(cuts, books)]
                least = np.full(len(x), -np.inf)  # what a query's candidate must reach
            for i in range(len(rows)):
                cell, ids = rows.field("list")[i].as_py(), rows.field("docids")[i].values
                docs = np.array(ids.to_pylist(), object)
                codes = np.frombuffer(b"".join(rows.field("codes")[i].as_py()), np.uint8).reshape(len(docs), -1)
                at_doc = {d: c for c, d in enumerate(docs)} if exclude_self else {}
                who = np.flatnonzero(probed[:, cell])
                for lo in range(0, len(who), QUERIES):
                    some = who[lo : lo + QUERIES]
                    s = np.repeat(base[some, cell][:, None], len(docs), axis=1)
                    for m, table in enumerate(adds):
                        s += table[some][:, codes[:, m]]
                    for r, o in enumerate(own[some] if at_doc else ()):
                        if (c := at_doc.get(o)) is not None:
                            s[r, c] = -np.inf
                    ok = np.isfinite(s) & (s >= least[some][:, None])
                    if len(docs) > refine:
                        ok &= s >= np.partition(s, len(docs) - refine, axis=1)[:, len(docs) - refine, None]
                    r, c = np.nonzero(ok)
                    held.append(pa.table({"qid": pa.array(some[r].astype(np.int32)), "docid": ids.take(pa.array(c)), "score": s[r, c]}))
                    n += len(r)
                    if n > limit:
                        held = [_foremost(pa.concat_tables(held), refine)]
                        n = held[0].num_rows
                        limit = max(HELD, 2 * n)  # what stays is at most refine rows a query
                        number, scores = held[0]["qid"].to_numpy(), held[0]["score"].to_numpy()
                        full = np.flatnonzero(np.bincount(number, minlength=len(least)) >= refine)
                        least[full] = scores[np.searchsorted(number, full, side="right") - 1]
        if held:
            best = _foremost(pa.concat_tables(held), refine)
            names = mine.field("qid").take(best["qid"].combine_chunks())
            yield from pa.table({"qid": names, "docid": best["docid"], "score": best["score"]}).to_batches(max_chunksize=1 << 16)

    asked, size = queries.count(), index.blocks.agg(F.sum(F.size("docids"))).first()[0] or 0
    columns = max(1, -(-size * (ROW_BYTES + len(books)) // FILE_BYTES))
    rows = max(-(-asked // SHARE), min(-(-q.sparkSession.sparkContext.defaultParallelism // columns), -(-asked // 64)), 1)
    near = grid(queries, index.blocks.withColumnRenamed("cell", "list"), rows, columns, "qid", "docids").mapInArrow(search, "qid string, docid string, score double")
    best = ranked(near.groupBy("qid", "docid").agg(F.max("score").alias("score")), k=refine).select("qid", "docid")
    return exact_scores(best, q, p, k)


def _sides(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.StructArray]]:
    """The batches of a grid's cell by side: queries first."""
    for b in batches:
        first = int(pc.sum(pc.equal(b.column("side"), 0)).as_py() or 0)
        if first:
            yield "q", b.column("q").slice(0, first)
        if first < b.num_rows:
            yield "p", b.column("p").slice(first)


# hash tables


@dataclass
class Tables:
    """blocks (block, docids, keys, vectors): the stored tables, a row for each block of vectors, in the order of their ids: each one's bucket in every table, and the vectors.

    planes: the bits of each table are the signs along them.
    """

    blocks: DataFrame
    planes: np.ndarray
    rows: int


def hash_tables(p: DataFrame, tables: int = 32, bits: int | None = None, seed: int = 7) -> Tables:
    """The index of `knn_approx`: every vector (docid, embedding) is in one bucket of each table. Bits grow with the logarithm of the rows, so buckets don't."""
    rows = named(p).select("docid", "embedding")
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = width or 1
    bits = max(2, min(20, width, round(math.log2(max(n, 1) / 8)) if bits is None else bits))
    rng = np.random.default_rng(seed)
    planes = np.stack([np.linalg.qr(rng.standard_normal((width, bits)))[0] for _ in range(tables)])
    kind = np.float32 if dict(rows.dtypes)["embedding"] == "array<float>" else np.float64

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        ids, x = t["docid"].combine_chunks(), _matrix(t["embedding"].combine_chunks())
        keys = np.stack([(x @ planes[i] > 0) @ (1 << np.arange(bits)) for i in range(tables)]).astype(np.int32)
        columns = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([keys.tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *columns], ["block", "docids", "keys", "vectors"])

    # a block is a range of ids, and all rows of an id are in one
    blocks = max(1, -(-n // SPAN), min(p.sparkSession.sparkContext.defaultParallelism, n // 1024))
    dealt = rows.repartitionByRange(blocks, "docid").sortWithinPartitions("docid")
    return Tables(stored(dealt.mapInArrow(put, "block int, docids array<string>, keys binary, vectors binary")), planes, n)


class _Places:
    """A block of the tables: its different ids, and how many probed buckets each shares with queries."""

    def __init__(self, row: dict, planes: np.ndarray, kind: type) -> None:
        self.number, ids = row["block"].as_py(), row["docids"].values
        docs = np.array(ids.to_pylist(), object)
        self.starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
        self.upto = np.append(self.starts, len(docs))
        self.ids = ids.take(pa.array(self.starts))
        self.at = {d: i for i, d in enumerate(docs[self.starts])}
        self.rows = len(docs)
        self.keys = np.frombuffer(row["keys"].as_py(), np.int32).reshape(len(planes), -1).astype(np.int64)
        self.planes = planes
        if "vectors" in row:
            self.vectors = np.frombuffer(row["vectors"].as_py(), kind).reshape(self.rows, -1)
            self.longest = float(np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors, dtype=np.float64).max()))

    def counts(self, x: np.ndarray, own: list, probes: int) -> np.ndarray:
        """For each query how many of the buckets that it probes hold each id: in each table those nearest by the margins of the bits that differ."""
        bits = self.planes.shape[2]
        loose = min(bits, max(10, math.ceil(math.log2(max(probes, 1)))))  # bits of least margin that may differ
        flips = (np.arange(1 << loose)[:, None] >> np.arange(loose) & 1).astype(float).T
        out = np.zeros((len(x), self.rows), np.uint8)
        mark = np.zeros(1 << bits, np.uint8)
        for t, plane in enumerate(self.planes):
            margin = x @ plane
            key = (margin > 0) @ (1 << np.arange(bits))
            weak = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :loose]
            cost = np.take_along_axis(np.abs(margin), weak, 1) @ flips
            buckets = key[:, None] ^ ((1 << weak).astype(float) @ flips).astype(np.int64)
            if probes < cost.shape[1]:
                last = np.partition(cost, probes - 1, axis=1)[:, probes - 1, None]
                take = cost < last
                # of equal costs the first
                same = cost == last
                take |= same & (np.cumsum(same, axis=1) <= probes - take.sum(axis=1, keepdims=True))
            else:
                take = np.ones(cost.shape, bool)
            for i in range(len(x)):
                asked = buckets[i, take[i]]
                mark[asked] = 1
                out[i] += mark[self.keys[t]]
                mark[asked] = 0
        if len(self.starts) < self.rows:
            out = np.add.reduceat(out, self.starts, axis=1, dtype=np.int64)
        for i, o in enumerate(own):
            if (c := self.at.get(o)) is not None:
                out[i, c] = 0
        return out

    def chosen(self, counts: np.ndarray, least: int, ties: int) -> np.ndarray:
        """The ids that share more than least buckets, and the first `ties` of those that share least."""
        take = counts > least
        take[np.flatnonzero(counts == least)[:ties]] = True
        return np.flatnonzero(take)

    def best(self, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of some ids, and their scores: added up in the order of dimensions, as by expressions."""
        rows = ids if len(self.starts) == self.rows else np.concatenate([np.arange(self.upto[i], self.upto[i + 1]) for i in ids] or [ids])
        if len(rows) > k:
            # scores are rounded to six places; products in single precision are off by so much
            about = self.vectors[rows] @ x.astype(self.vectors.dtype)
            error = 0.0 if self.vectors.dtype == np.float64 else (len(x) + 16) * 2.0**-23 * np.linalg.norm(x) * self.longest
            rows = rows[about >= np.partition(about, len(rows) - k)[len(rows) - k] - 2 * (error + 1e-6)]
        score = np.cumsum(self.vectors[rows].astype(np.float64) * x, axis=1)[:, -1] if len(rows) else np.zeros(0)
        order = np.lexsort((rows, -np.round(score, 6)))[:k]
        return np.searchsorted(self.starts, rows[order], side="right") - 1, score[order]


def enough_probes(index: Tables, budget: int) -> int:
    """Buckets to probe in each table: 12 at least, and so many that all tables' together hold FULL times the budget.

    Buckets don't grow with the rows, so a fixed number of them would hold an ever smaller share of a budget that does.
    """
    tables, _, bits = index.planes.shape
    return max(12, math.ceil(FULL * budget / max(index.rows, 1) * (1 << bits) / tables))


@dataclass
class Chosen:
    """rows (at, qid, own, embedding, least, ties, found): a row for each query, stored. Its candidates share more than `least` of the buckets it probes,
    or just as many and are among the first ties[b] of those in block b; found is how many they are. None of them is a row."""

    rows: DataFrame
    index: Tables
    probes: int


def _met(asked: DataFrame, index: Tables, columns: list[str], work: Callable[[_Places, pa.StructArray, np.ndarray, list], Iterator[pa.RecordBatch]], out: str) -> DataFrame:
    """work(block, queries, their vectors, what each leaves out) for each block and QUERIES of the queries at a time.

    Queries of up to MATRIX_BYTES are sent to the tasks that read the blocks; more of them meet the blocks in a grid.
    """
    planes, names = index.planes, ["block", "docids", "keys", *columns]
    size = asked.agg(F.sum(F.size("embedding") * 8 + 64 + (F.size("ties") * 4 if "ties" in asked.columns else 0))).first()[0] or 0
    # rows of a block: one dtype for all
    width = planes.shape[1]

    def each(queries: pa.StructArray, rows: pa.StructArray) -> Iterator[pa.RecordBatch]:
        for i in range(len(rows)):
            row = {c: rows.field(c)[i] for c in names}
            kind = np.float64 if "vectors" in row and len(row["vectors"].as_py()) == 8 * width * len(row["docids"].values) else np.float32
            block = _Places(row, planes, kind)
            for lo in range(0, len(queries), QUERIES):
                some = queries.slice(lo, QUERIES)
                yield from work(block, some, _matrix(some.field("embedding")), some.field("own").to_pylist())

    if size <= search.MATRIX_BYTES:
        t = asked.orderBy("at").select(F.struct(*asked.columns).alias("q")).toArrow().column(0)
        sent = asked.sparkSession.sparkContext.broadcast(pa.concat_arrays(t.chunks) if len(t) else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if sent.value is not None and b.num_rows:
                    yield from each(sent.value, b.to_struct_array())

        return index.blocks.select(*names).mapInArrow(run, out)
    down = -(-size // search.MATRIX_BYTES)
    across = max(1, min(index.blocks.count(), -(-4 * asked.sparkSession.sparkContext.defaultParallelism // down)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, queries = [], None
        for side, rows in _sides(batches):
            if side == "q":
                held.append(rows)
            elif held:
                if queries is None:
                    queries = pa.concat_arrays(held)
                    # both meetings take the same queries at once, so products are the same to the last bit
                    queries = queries.take(pc.sort_indices(queries.field("at")))
                yield from each(queries, rows)

    return grid(asked, index.blocks.select(*names), down, across, "at", "block").mapInArrow(meet, out)


def chosen(q: DataFrame, index: Tables, budget: int, probes: int | None = None, exclude_self: bool = False) -> Chosen:
    """At most `budget` rows a query, those that share the most probed buckets; of several the least docid.

    A block gives out how many of its ids share 0, 1, .. buckets with a query; the sums over blocks tell how many a candidate must share.
    """
    probes = enough_probes(index, budget) if probes is None else probes
    asked = _with_own(q, exclude_self).where("qid is not null and embedding is not null").select("qid", "own", F.col("embedding").cast("array<double>").alias("embedding"))
    asked = stored(asked.withColumn("at", F.monotonically_increasing_id()))

    def count(block: _Places, queries: pa.StructArray, x: np.ndarray, own: list) -> Iterator[pa.RecordBatch]:
        many = [np.bincount(c) for c in block.counts(x, own, probes)]
        yield pa.RecordBatch.from_arrays([queries.field("at"), pa.array(np.full(len(x), block.number, np.int32)), pa.array(many, pa.list_(pa.int32()))], ["at", "block", "many"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for blocks, many in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                most = max(map(len, many))
                all_ = np.zeros((max(blocks) + 1, most), np.int64)
                for n, m in zip(blocks, many):
                    all_[n, : len(m)] = m
                all_[:, 0] = 0
                reached = np.cumsum(all_.sum(axis=0)[::-1])[::-1]  # ids that share as many or more
                least = max(1, int(np.flatnonzero(reached >= budget).max(initial=0)))
                same = all_[:, least] if least < most else np.zeros(len(all_), np.int64)
                left = budget - (reached[least + 1] if least + 1 < most else 0)
                ties = np.clip(left - (np.cumsum(same) - same), 0, same)
                made.append((least, ties.tolist(), min(budget, int(reached[1]) if most > 1 else 0)))
            columns = zip(*made) if made else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(v), t) for v, t in zip(columns, (pa.int32(), pa.list_(pa.int32()), pa.int64()))]], ["at", "least", "ties", "found"])

    many = _met(asked, index, [], count, "at long, block int, many array<int>").groupBy("at").agg(F.collect_list(F.struct("block", "many")).alias("_all"))
    cuts = many.select("at", F.col("_all.block").alias("block"), F.col("_all.many").alias("many")).mapInArrow(cut, "at long, least int, ties array<int>, found long")
    return Chosen(stored(asked.join(cuts, "at")), index, probes)


def _candidates(made: Chosen, columns: list[str], each: Callable[[_Places, np.ndarray, np.ndarray], tuple[np.ndarray, list]], out: str, names: list[str]) -> DataFrame:
    """each(block, candidates, the query's vector): numbers of ids and a list of further columns, for each query's candidates in each block."""
    probes = made.probes

    def work(block: _Places, queries: pa.StructArray, x: np.ndarray, own: list) -> Iterator[pa.RecordBatch]:
        counts = block.counts(x, own, probes)
        for i, (least, ties) in enumerate(zip(queries.field("least").to_pylist(), queries.field("ties").to_pylist())):
            at, more = each(block, block.chosen(counts[i], least, ties[block.number] if block.number < len(ties) else 0), x[i])
            if len(at):
                qid = queries.field("qid").take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([qid, block.ids.take(pa.array(at)), *map(pa.array, more)], names)

    return _met(made.rows, made.index, columns, work, out)


def candidates(q: DataFrame, index: Tables, budget: int, probes: int | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, docid): `chosen` rows as pairs."""
    made = chosen(q, index, budget, probes, exclude_self)
    return _candidates(made, [], lambda block, ids, x: (ids, []), "qid string, docid string", ["qid", "docid"])


def best_chosen(made: Chosen, k: int) -> DataFrame:
    """(qid, docid, score, rank): the best k of each query's candidates by their vectors. They are scored where they are found, and only a block's best k leave its task."""

    def best(block: _Places, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, list]:
        at, score = block.best(ids, x, k)
        return at, [score]

    found = _candidates(made, ["vectors"], best, "qid string, docid string, score double", ["qid", "docid", "score"])
    return ranked(found.withColumn("score", F.round("score", 6)), k=k)


def knn_approx(q: DataFrame, p: DataFrame, k: int, complexity: int | None = None, exclude_self: bool = False, index: Tables | None = None, probes: int | None = None) -> DataFrame:
    """Approximate search with a candidate budget (default 5 k, at least k): that many rows are found by hash tables and scored by their vectors.

    A larger budget keeps all of a smaller one's candidates, so recall rises with it.
    """
    index = hash_tables(p) if index is None else index
    budget = max(k, 5 * k if complexity is None else complexity)
    return best_chosen(chosen(q, index, budget, probes, exclude_self), k)
