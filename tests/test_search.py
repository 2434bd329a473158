"""Search in grids, over inverted files, hash tables and postings, against plain recounts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.operators import ann, inverted, search
from trovex.operators import evaluation as E
from trovex.plans import fixtures as fx


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def sides(spark, sf):
    return fx.queries(spark, sf), fx.vectors(spark, sf)


def test_a_grid_of_eight_query_blocks_gives_equal_rows_from_one_scan(sides, monkeypatch):
    q, p = sides
    want = [rows(search.knn_blocked(q, p, 5, True)), rows(search.knn_sharded(q, p, 5, [0, 2], True)), rows(search.all_pairs_scores(q, p))]
    monkeypatch.setattr(search, "MATRIX_BYTES", -(-search._matrix_bytes(q) // 8))
    found = search.knn_blocked(q, p, 5, True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2  # one for each side
    assert "Broadcast" not in plan
    assert [rows(found), rows(search.knn_sharded(q, p, 5, [0, 2], True)), rows(search.all_pairs_scores(q, p))] == want
    assert rows(search.knn_exact(q, p, 5, True)) == want[0]


@pytest.mark.parametrize("limit", [1 << 20, 1])
def test_whole_ids_are_compared_and_rows_without_id_or_vector_are_no_results(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "MATRIX_BYTES", limit)
    q = spark.createDataFrame([("x12", [1.0, 0.0]), ("d1", [0.0, 1.0])], "qid string, embedding array<float>")
    p = spark.createDataFrame([("y12", [1.0, 0.0]), ("x12", [1.0, 0.0]), ("d1", [0.0, 2.0]), (None, [9.0, 9.0]), ("d2", None)], "docid string, embedding array<float>")
    assert [(r.qid, r.docid) for r in search.knn_blocked(q, p, 1, True).orderBy("qid").collect()] == [("d1", "x12"), ("x12", "y12")]
    assert {r.docid for r in search.knn_blocked(q, p, 9).collect()} == {"y12", "x12", "d1"}
    own = q.withColumn("own", F.lit("y12"))
    assert {(r.qid, r.docid) for r in search.knn_exact(own, p, 9, True).collect()} == {(a, b) for a in ("x12", "d1") for b in ("x12", "d1")}


def recall(found, truth):
    return E.anns_recall_at_k(found, truth, 10).first().value


def test_inverted_file_finds_nine_of_ten_in_a_quarter_of_its_cells(spark, sf, sides, monkeypatch):
    q, p = sides
    truth = fx.run(spark, sf)
    index = ann.ivf_index(p)
    cells = len(index.centres)
    at = [ann.knn_ivf(q, p, 10, index, nprobe=n, exclude_self=True) for n in (1, cells // 8, cells // 4)]
    found = [recall(r, truth) for r in at]
    assert found[0] < found[1] < found[2] and found[2] >= 0.9
    exact = {(r.qid, r.docid): r.score for r in search.all_pairs_scores(q, p).collect()}
    assert all(exact[r.qid, r.docid] == pytest.approx(r.score, abs=1e-6) for r in at[2].collect())
    monkeypatch.setattr(ann, "BLOCK", 5)
    monkeypatch.setattr(ann, "QUERIES", 2)
    blocks = ann._packed(index.blocks.select("cell", F.explode(F.arrays_zip("docids", "codes")).alias("z")).select("cell", "z.docids", "z.codes").withColumnRenamed("docids", "docid"), "cell")
    assert blocks.count() > index.blocks.count() and blocks.agg(F.max(F.size("docids"))).first()[0] < 20
    small = ann.Ivf(blocks, index.centres, index.books)
    assert rows(ann.knn_ivf(q, p, 10, small, exclude_self=True)) == rows(ann.knn_ivf(q, p, 10, index, exclude_self=True))


def test_hash_tables_score_less_than_a_third(spark, sf, sides):
    q, p = sides
    truth = fx.run(spark, sf)
    index = ann.hash_tables(p)
    budgets = [10, index.rows // 10, int(0.28 * index.rows)]
    found = [recall(ann.knn_approx(q, p, 10, n, True, index), truth) for n in budgets]
    assert found[0] < found[1] < found[2] and found[2] >= 0.9
    small, large = ({(r.qid, r.docid) for r in ann.candidates(q, index, n).collect()} for n in budgets[1:])
    assert small < large and len(large) < 0.3 * index.rows * q.count()


def test_small_and_empty_indexes(spark, sides):
    q, p = sides
    few = p.limit(3)
    for find, build in ((ann.knn_ivf, ann.ivf_index), (ann.knn_approx, ann.hash_tables)):
        assert find(q, p.limit(0), 5, index=build(p.limit(0))).count() == 0
        assert find(q.limit(0), few, 5, index=build(few)).count() == 0
        assert set(r.docid for r in find(q, few, 5, index=build(few)).collect()) <= set(r.docid for r in few.collect())
    same = spark.createDataFrame([(f"d{i}", [1.0, 0.0]) for i in range(40)] + [("z", [0.0, 0.0])], "docid string, embedding array<float>")
    one = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<float>")
    for find in (ann.knn_ivf, ann.knn_approx):
        assert [r.docid for r in find(one, same, 3).orderBy("rank").collect()] == ["d0", "d1", "d10"]


# postings


def joined(qw, dw, k):
    hits = dw.withColumnRenamed("weight", "dw").join(qw.withColumnRenamed("weight", "qw"), "token")
    return search.ranked(hits.groupBy("qid", "docid").agg(F.round(F.sum(F.col("qw") * F.col("dw")), 6).alias("score")), k=k)


def close(got, want):
    key = lambda r: (r.qid, r["rank"])
    got, want = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert [(r.qid, r.docid, r["rank"]) for r in got] == [(r.qid, r.docid, r["rank"]) for r in want]
    assert np.allclose([r.score for r in got], [r.score for r in want], atol=2e-6)


@pytest.fixture(scope="module")
def weighted(spark):
    """Integer weights (many ties), a token that all documents have, documents of very different sizes, odd rows."""
    r = random.Random(5)
    made = []
    for d in range(400):
        tokens = r.sample(range(120), min(119, int(r.paretovariate(0.7)) + 1))
        made += [(f"d{d}", f"t{t}", float(r.randint(1, 1 + t % 9))) for t in tokens] + [(f"d{d}", "all", float(1 + d % 5))]
    asked = [(f"q{i}", f"t{t}", float(r.randint(1, 4))) for i in range(30) for t in r.sample(range(130), r.randint(1, 25))] + [(f"q{i}", "all", 1.0) for i in range(0, 30, 2)]
    return spark.createDataFrame(asked, "qid string, token string, weight double"), spark.createDataFrame(made, "docid string, token string, weight double").repartition(4)


@pytest.mark.parametrize("k", [1, 7, 1000])
@pytest.mark.parametrize("part", [16, 100, 4096])
def test_skipping_blocks_changes_no_row(weighted, monkeypatch, k, part):
    qw, dw = weighted
    monkeypatch.setattr(inverted, "RANGE", 8)
    index = inverted.build(dw, part)
    assert index.n == -(-400 // part)
    close(inverted.sparse_retrieve(qw, None, k, index), joined(qw, dw, k))


def test_postings_in_a_grid_and_odd_rows(spark, weighted, monkeypatch):
    qw, dw = weighted
    odd = spark.createDataFrame([(None, "t1", 9.0), ("d0", None, 9.0), ("dx", "t1", None), ("dy", "t1", 0.0)], dw.schema)
    index = inverted.build(dw.unionByName(odd), 64)
    monkeypatch.setattr(inverted, "QUERY_BYTES", 2000)
    close(inverted.sparse_retrieve(qw, None, 5, index), joined(qw, dw, 5))
    assert inverted.sparse_retrieve(qw, dw.limit(0), 5).count() == 0 == inverted.sparse_retrieve(qw.limit(0), None, 5, index).count()


def test_postings_that_are_read(spark, sf):
    """At sf0.1 a fifth of the join's pairs is read; few documents leave less to skip."""
    dw = fx.weights(spark, sf.replace("0.001", "0.01")).persist()
    qw = dw.where("cast(substring(docid, 2) as bigint) % 50 = 0").select(F.expr("concat('q', substring(docid, 2))").alias("qid"), "token", "weight")
    index = inverted.build(dw, 128)
    hot = index.parts.where("part = 0").select(F.posexplode("tokens").alias("at", "token"), "first").select("token", F.expr("first[at + 1] - first[at]").alias("n"))
    assert hot.agg(F.max("n")).first()[0] == 128 // inverted.RANGE  # a hot token has a block in each range
    reads = inverted.sparse_retrieve(qw, None, 20, index, reads=True).persist()
    assert reads.agg(F.sum("postings")).first()[0] < 0.7 * dw.select("token").join(qw, "token").count()
    late = [reads.where(F.col("part") == n).agg(F.coalesce(F.sum("postings"), F.lit(0))).first()[0] for n in (0, index.n - 1)]
    assert late[1] < late[0] / 10
    for df in (dw, reads):
        df.unpersist()


@pytest.mark.parametrize("part", [32, 400])
def test_index_of_one_row_a_document_has_a_file_for_each_part(spark, weighted, part):
    """So a reader never holds two parts; words counted text by text have the weights of words counted as rows."""
    qw, dw = weighted
    whole = dw.groupBy("docid").agg(F.collect_list(F.struct("token", "weight")).alias("p")).select("docid", F.col("p.token").alias("tokens"), F.col("p.weight").alias("weights"))
    index = inverted.build(whole, part)
    assert len(index.parts.inputFiles()) == index.n == -(-400 // part)
    close(inverted.sparse_retrieve(qw, None, 7, index), joined(qw, dw, 7))
    read = [r.n for r in inverted.sparse_retrieve(qw, None, 3, index, reads=True).groupBy("part").agg(F.count("*").alias("n")).collect()]
    assert part == 400 or len(read) < index.n or min(read) < 30  # parts of short documents are skipped by length alone


def test_words_counted_text_by_text(spark):
    texts = [("d1", "A b  a B\u00c9 "), ("d1", "a z"), ("d2", None), ("d3", " "), ("d4", "x")]
    got = fx.counted_words(spark.createDataFrame(texts, "docid string, text string")).collect()
    assert {r.docid: dict(zip(r.tokens, r.counts)) for r in got} == {"d1": {"a": 3, "b": 1, "b\u00e9": 1, "z": 1}, "d4": {"x": 1}}
