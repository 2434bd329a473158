"""Maximum inner product search, run merging and ranking.

Vectors are ARRAY<FLOAT>. Scores are rounded to 6 places before ranking, ties go to the lesser docid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

MATRIX_BYTES = 64 << 20  #: of a query matrix: that is broadcast, or that a cell of the grid holds


PLAIN_PAIRS = 1 << 20  #: that are scored one by one, by expressions


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ranked(run: DataFrame, *by: str, k: int | None = None, tie: str = "docid") -> DataFrame:
    """rank 1.. within each query (or other columns), score descending; the first k if given."""
    w = Window.partitionBy(*(by or ("qid",))).orderBy(F.desc("score"), tie)
    out = run.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


rank_by_score = ranked


def depth_cut(run: DataFrame, n: int) -> DataFrame:
    return run.where(F.col("rank") <= n)


def all_pairs_scores(q: DataFrame, p: DataFrame) -> DataFrame:
    """q: (qid, embedding), a stated query set; p: (docid, embedding). Every pair's score, in blocks of the query matrix."""
    return _blocked(q, p, None)


def knn_exact(q: DataFrame, p: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The plain form: DataFrame expressions alone, for up to PLAIN_PAIRS pairs; beyond that in blocks, with the same scores and order."""
    if _matrix_bytes(q) > MATRIX_BYTES or q.count() * p.count() > PLAIN_PAIRS:
        return knn_blocked(q, p, k, exclude_self)
    rows = named(p).select("docid", F.col("embedding").alias("pe")).crossJoin(F.broadcast(_with_own(q, exclude_self).select("qid", "own", F.col("embedding").alias("qe"))))
    return ranked(rows.where("own is null or own <> docid").select("qid", "docid", F.round(dot("qe", "pe"), 6).alias("score")), k=k)


def named(p: DataFrame) -> DataFrame:
    """The rows that can be found: those with a docid and a vector."""
    return p.where("docid is not null and embedding is not null")


def _with_own(q: DataFrame, exclude_self: bool) -> DataFrame:
    """q with `own`, the docid that isn't a result for it: its column of that name, or else its qid; null to leave nothing out."""
    own = F.lit(None).cast("string") if not exclude_self else F.col("own" if "own" in q.columns else "qid").cast("string")
    return q.withColumn("own", own)


def _matrix_bytes(q: DataFrame) -> int:
    width, n = q.agg(F.max(F.size("embedding")), F.count("*")).first()
    return n * (width or 1) * 8


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of numbers as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(q: np.ndarray, g: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query and group."""
    order = np.lexsort((doc, -score, g, q))
    q, g, doc, score = q[order], g[order], doc[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (g[1:] != g[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = np.arange(len(q)) - first < k
    return q[keep], g[keep], doc[keep], score[keep]


QUERY_ROWS = 256  #: queries whose scores are held at once


class _Block:
    """Some queries, and the best k found so far for each of them (and each group), by QUERY_ROWS of them; all pairs where k is None.

    What is held beside that is one batch's scores for QUERY_ROWS queries, however many there are.
    """

    def __init__(self, ids: list, own: list, matrix: np.ndarray, k: int | None, group: pa.DataType | None) -> None:
        self.ids, self.own, self.matrix, self.k, self.group = np.array(ids, object), own, matrix, k, group
        self.held: dict[int, tuple[np.ndarray, ...]] = {}
        self.owns = any(o is not None for o in own)

    def add(self, docid: pa.Array, embedding: pa.Array, group: pa.Array | None) -> Iterator[pa.RecordBatch]:
        if not len(docid) or not len(self.ids):
            return
        docs, x = np.array(docid.to_pylist(), str), _matrix(embedding)
        at_doc = {d: c for c, d in enumerate(docs.tolist())} if self.owns else {}
        groups = group.to_numpy(zero_copy_only=False) if group is not None else np.zeros(len(docs), np.int64)
        members = [(g, np.flatnonzero(groups == g)) for g in np.unique(groups)]
        for lo in range(0, len(self.ids), QUERY_ROWS):
            s = np.round(self.matrix[lo : lo + QUERY_ROWS] @ x.T, 6)
            for r, own in enumerate(self.own[lo : lo + QUERY_ROWS] if at_doc else ()):
                if (c := at_doc.get(own)) is not None:
                    s[r, c] = -np.inf
            found = [self.held[lo]] if lo in self.held else []
            for _, at in members:
                sub = s if len(at) == len(docs) else s[:, at]
                ok = np.isfinite(sub)
                if self.k is not None and len(at) > self.k:
                    ok &= sub >= np.partition(sub, len(at) - self.k, axis=1)[:, len(at) - self.k, None]
                r, c = np.nonzero(ok)
                part = lo + r, groups[at[c]], docs[at[c]], sub[r, c]
                if self.k is None:
                    yield self._batch(*part)
                else:
                    found.append(part)
            if found:
                self.held[lo] = _best(*(np.concatenate(v) for v in zip(*found)), self.k)

    def end(self) -> Iterator[pa.RecordBatch]:
        for lo in list(self.held):
            yield self._batch(*self.held.pop(lo))

    def _batch(self, q, g, doc, score) -> pa.RecordBatch:
        columns, names = [pa.array(self.ids[q], pa.string()), pa.array(doc.tolist(), pa.string()), pa.array(score)], ["qid", "docid", "score"]
        if self.group is not None:
            columns.append(pa.array(g.tolist(), self.group))
            names.append("group")
        return pa.RecordBatch.from_arrays(columns, names)


def grid(q: DataFrame, p: DataFrame, rows: int, columns: int, qkey: str, pkey: str) -> DataFrame:
    """Both sides in one frame (cell, side, q struct, p struct): each of the rows * columns cells gets a share of q, first, and then a share of p.

    Each side is read once and copied along the other's direction, so neither goes through the driver, and a cell is a task of its own.
    """

    def placed(df: DataFrame, key: str, own: int, other: int, at: Column) -> DataFrame:
        return df.withColumn("_own", F.pmod(F.xxhash64(key), F.lit(own)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).withColumn("cell", at.cast("int"))

    qs, ps = F.struct(*q.columns), F.struct(*p.columns)
    left = placed(q, qkey, rows, columns, F.col("_own") * columns + F.col("_other")).select("cell", F.lit(0).alias("side"), qs.alias("q"))
    right = placed(p, pkey, columns, rows, F.col("_other") * columns + F.col("_own")).select("cell", F.lit(1).alias("side"), ps.alias("p"))
    return left.unionByName(right, allowMissingColumns=True).repartitionById(rows * columns, F.col("cell")).sortWithinPartitions("side")


def _blocked(q: DataFrame, p: DataFrame, k: int | None, exclude_self: bool = False, group: str | None = None) -> DataFrame:
    """Block products. With k, only a task's best k of each query (and group) leave it.

    Queries of up to MATRIX_BYTES are sent to the tasks that scan p; more of them meet p in a grid of cells, one read of each side.
    """
    spark, size = p.sparkSession, _matrix_bytes(q)
    kind = dict(p.dtypes).get(group)
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), None: None}[kind]
    queries = _with_own(q, exclude_self).select("qid", "own", F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = named(p).select("docid", "embedding", *([F.col(group).alias("group")] if group else []))
    out = "qid string, docid string, score double" + (f", group {kind}" if group else "")
    if size <= MATRIX_BYTES:
        rows = queries.orderBy("qid").toArrow().combine_chunks()
        sent = spark.sparkContext.broadcast((rows.column(0).to_pylist(), rows.column(1).to_pylist(), _matrix(rows.column(2).combine_chunks()) if rows.num_rows else np.zeros((0, 1))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _Block(*sent.value, k, arrow)
            for b in batches:
                yield from block.add(b.column(0), b.column(1), b.column(2) if group else None)
            yield from block.end()

        found = vectors.mapInArrow(run, out)
    else:
        down = -(-size // MATRIX_BYTES)
        across = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // down))

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, own, parts, block = [], [], [], None
            for b in batches:
                first = int(pc.sum(pc.equal(b.column("side"), 0)).as_py() or 0)
                if first:
                    mine = b.column("q").slice(0, first)
                    ids += mine.field("qid").to_pylist()
                    own += mine.field("own").to_pylist()
                    parts.append(_matrix(mine.field("embedding")))
                if first < b.num_rows and parts:
                    block = block or _Block(ids, own, np.concatenate(parts), k, arrow)
                    theirs = b.column("p").slice(first)
                    yield from block.add(theirs.field("docid"), theirs.field("embedding"), theirs.field("group") if group else None)
            if block:
                yield from block.end()

        found = grid(queries, vectors, down, across, "qid", "docid").mapInArrow(meet, out)
    return found.withColumnRenamed("group", group) if group else found


def nearest_blocks(p: DataFrame, q: DataFrame) -> list[DataFrame]:
    """(docid, qid, score) for each row of p, once for each block of q (qid number, embedding): the qid of largest score, of several the least."""
    width, n = q.agg(F.max(F.size("embedding")), F.count("*")).first()
    passes = max(1, -(-n * (width or 1) * 8 // MATRIX_BYTES))
    out = []
    for i in range(passes):
        rows = q.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).select(F.col("qid").cast("long"), "embedding").orderBy("qid").toArrow()
        if passes > 1 and not rows.num_rows:
            continue
        matrix = np.array(rows.column(1).to_pylist(), np.float64).reshape(rows.num_rows, width or 1)
        sent = p.sparkSession.sparkContext.broadcast((rows.column(0).to_numpy(), matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix = sent.value
            for b in batches:
                if b.num_rows and len(ids):
                    s = np.round(_matrix(b.column(1)) @ matrix.T, 6)
                    at = s.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[at]), pa.array(s[np.arange(len(at)), at])], ["docid", "qid", "score"])

        out.append(p.select("docid", "embedding").mapInArrow(run, "docid string, qid long, score double"))
    return out


def knn_blocked(q: DataFrame, p: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """The form for scale: one scan of p, block products in tasks, k rows a query and task to the shuffle. Rows without a docid or vector are no results."""
    return ranked(_blocked(q, p, k, exclude_self), k=k)


def knn_sharded(q: DataFrame, p: DataFrame, k: int, shards: list[int] | None = None, exclude_self: bool = False) -> DataFrame:
    """Best k of each shard, then of their union. p has a shard column; shards prunes it before the scan."""
    part = p if shards is None else p.where(F.col("shard").isin(shards))
    local = ranked(_blocked(q, part, k, exclude_self, "shard"), "qid", "shard", k=k).drop("rank")
    return ranked(local, k=k)


def ground_truth(q: DataFrame, p: DataFrame, k: int = 100, per_shard: bool = False, exclude_self: bool = False) -> DataFrame:
    if not per_shard:
        return knn_blocked(q, p, k, exclude_self)
    return ranked(_blocked(q, p, k, exclude_self, "shard"), "qid", "shard", k=k)


def merge_runs(runs: list[DataFrame], depth: int = 100) -> DataFrame:
    """Union of runs (qid, docid, score), the best depth of each query; a document found twice counts once, with its best score."""
    out = runs[0].select("qid", "docid", "score")
    for r in runs[1:]:
        out = out.unionByName(r.select("qid", "docid", "score"))
    return ranked(out.groupBy("qid", "docid").agg(F.max("score").alias("score")), k=depth)


Scorer = Callable[[list[tuple[str, str]]], "list[float] | np.ndarray"]

_SCORERS: dict[str, Scorer] = {}


def score_pairs(results: DataFrame, make: Callable[[], Scorer], query: str = "query", text: str = "text", batch: int = 32) -> DataFrame:
    """results (.., query, text) with new_score: pairs go through the scorer in batches of about equal length.

    `make` builds the scorer (loads its model), once in each worker process, whatever the tasks and batches there.
    """
    key = uuid4().hex

    @pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            if key not in _SCORERS:
                _SCORERS.clear()
                _SCORERS[key] = make()
            pairs = [(a or "", b or "") for a, b in zip(queries, texts)]
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
            out = np.empty(len(pairs))
            for lo in range(0, len(order), batch):
                chosen = order[lo : lo + batch]
                found = _SCORERS[key]([pairs[i] for i in chosen])
                if len(found) != len(chosen):
                    raise ValueError(f"the scorer gave {len(found)} scores for {len(chosen)} pairs")
                out[chosen] = found
            yield pd.Series(out)

    return results.withColumn("new_score", scored(query, text))


def overlap_scorer() -> Scorer:
    """The offline default: how many different words of the query stand in the text."""
    return lambda pairs: [len({*a.split()} & {*b.split()}) for a, b in pairs]


def rerank(results: DataFrame, scorer: Callable[[DataFrame], DataFrame] | Column) -> DataFrame:
    """results (qid, docid, rank, ..): new_rank by the scorer's score, old_rank as it was. The scorer is a column or a function that adds new_score, like `score_pairs`."""
    scored = scorer(results) if callable(scorer) and not isinstance(scorer, Column) else results.withColumn("new_score", scorer)
    w = Window.partitionBy("qid").orderBy(F.desc("new_score"), "docid")
    return scored.withColumnRenamed("rank", "old_rank").withColumn("new_rank", F.row_number().over(w))
