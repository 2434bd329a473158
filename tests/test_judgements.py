"""Judgements by class equal their pairs, whatever the rows, and no pair of them is made."""

import random

import pytest
from pyspark.sql import functions as F

from trovex.operators import evaluation as E
from trovex.operators import joins, search, training
from trovex.operators import judgements as J


@pytest.fixture(scope="module")
def odd(spark):
    """Ids that come twice or in two classes, null classes, own documents in and out of the class."""
    rng = random.Random(5)
    q = [(f"q{i}", rng.choice("abc"), f"d{i}") for i in range(12)] + [("q1", "a", "d1"), ("q2", "b", "d2"), ("q2", "c", "d2"), ("q3", "a", "d3"), ("q20", None, "d4"), ("q21", "z", None), ("q22", "a", None)]
    d = [(f"d{i}", rng.choice("abc"), rng.choice([1, 2, 3])) for i in range(0, 40, 2)] + [("d4", "a", 2), ("d4", "b", 1), ("d6", "c", 1), ("d6", "c", 1), ("d50", None, 1)]
    judged = J.ByClass(spark.createDataFrame(q, "qid string, class string, own string"), spark.createDataFrame(d, "docid string, class string, rel int"))
    run = [(f"q{i}", f"d{j}", n + 1, 1.0 / (n + 1)) for i in [*range(13), 20, 21, 22] for n, j in enumerate(rng.sample(range(42), 15))]
    return judged, judged.pairs(), spark.createDataFrame(run, "qid string, docid string, rank int, score double")


def rows(df):
    return sorted(map(str, df.collect()))


def test_measures_by_class_equal_those_by_pairs(odd):
    judged, pairs, run = odd
    assert rows(J.sizes(judged)) == rows(J.sizes(pairs))
    assert rows(J.best(judged, 4)) == rows(J.best(pairs, 4))
    assert rows(E.judged(run, judged)) == rows(E.judged(run, pairs))
    assert rows(E.evaluate_all(run, judged)) == rows(E.evaluate_all(run, pairs))
    assert rows(E.rank_histogram(run, judged, 5)) == rows(E.rank_histogram(run, pairs, 5))
    assert rows(E.eval_mrr(run, judged, 5)) == rows(E.eval_mrr(run, pairs, 5))
    measures = ["recip_rank", "map", "P_5", "recall_30", "ndcg_cut_3", "ndcg_cut_10"]
    assert rows(E.trec_measures(run, judged, measures)) == rows(E.trec_measures(run, pairs, measures))
    assert rows(joins.drop_positives(run, judged).select("qid", "docid")) == rows(joins.drop_positives(run, pairs).select("qid", "docid"))


def test_training_rows_by_class_equal_those_by_pairs(spark, odd):
    judged, pairs, run = odd
    corpus = spark.createDataFrame([(f"d{i}", f"t{i}", f"one {i}\ntwo") for i in range(0, 42) if i % 5] + [("d6", "t6", "again")], "docid string, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"query {i}") for i in range(23) if i != 7], "qid string, query string")
    neg = run.select("qid", F.col("rank").alias("pos"), "docid")
    for of in (None, lambda texts: F.md5(F.array_join(texts, "|"))):
        assert rows(joins.train_join(judged, neg, queries, corpus, of)) == rows(joins.train_join(pairs, neg, queries, corpus, of))
    g = queries.select(F.col("qid").alias("query_id"), "query", F.array().cast("array<struct<docid:string,title:string,text:string>>").alias("negative_passages"))
    assert rows(training.mine_hard_negatives(g, run, corpus, 5, J.within(judged, corpus))) == rows(training.mine_hard_negatives(g, run, corpus, 5, J.within(pairs, corpus)))
    text = queries.withColumnRenamed("query", "text")
    token = [training.pretokenize(text, j, joins.drop_positives(run, j), corpus, training.hash_tokens(), split="\n", max_len=4, n_sample=3) for j in (judged, pairs)]
    assert rows(token[0]) == rows(token[1])


def most_rows(df):
    """Of the nodes of a plan that has run, the largest number of rows that one gave out."""

    def walk(p):
        yield from (p.metrics().apply(m).value() for m in ("numOutputRows",) if p.metrics().contains(m))
        kids = p.children()
        for i in range(kids.size()):
            yield from walk(kids.apply(i))
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            yield from walk(p.executedPlan())
        if "QueryStage" in p.getClass().getSimpleName():
            yield from walk(p.plan())

    return max(walk(df._jdf.queryExecution().executedPlan()))


def test_no_pair_of_a_large_class_is_made(spark):
    """2,000 queries and 2,000 documents of one class are four million pairs; no operator of the plan made more than a few rows for each of the input."""
    n = 2000
    judged = J.ByClass(spark.range(n).selectExpr("concat('q', id) as qid", "'a' as class", "concat('d', id) as own"), spark.range(n).selectExpr("concat('d', id) as docid", "'a' as class", "1 as rel"))
    run = spark.range(n).selectExpr("concat('q', id) as qid", "concat('d', (id + 1) % 2000) as docid", "1 as rank")
    j = E.judged(run, judged)
    total = j.agg(F.sum("rel"), F.min("n_rel"), F.max("n_rel"), F.count("*"))
    assert tuple(total.collect()[0]) == (n, n - 1, n - 1, n)
    assert most_rows(total) <= 4 * n


def test_a_block_holds_the_best_alone(spark, monkeypatch):
    """Many batches and groups of queries: results as by expressions, and no more than k a query are held."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((300, 4)), 1)
    p = spark.createDataFrame([(f"d{i}", v.tolist()) for i, v in enumerate(x)], "docid string, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", f"d{i}", v.tolist()) for i, v in enumerate(x[:40])], "qid string, own string, embedding array<float>")
    want = rows(search.knn_exact(q, p, 5, exclude_self=True).select("qid", "docid", "score", "rank"))
    monkeypatch.setattr(search, "PLAIN_PAIRS", 100)
    got = search.knn_exact(q, p, 5, exclude_self=True)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows(got.select("qid", "docid", "score", "rank")) == want
    import pyarrow as pa

    block = search._Block([f"q{i}" for i in range(600)], [None] * 600, rng.standard_normal((600, 4)), 5, None)
    for lo in range(0, 300, 50):
        list(block.add(pa.array([f"d{i}" for i in range(lo, lo + 50)]), pa.array(x[lo : lo + 50].tolist(), pa.list_(pa.float64())), None))
    assert len(block.held) == 3 and all(len(h[0]) <= 5 * search.QUERY_ROWS for h in block.held.values())
    assert sum(b.num_rows for b in block.end()) == 3000 and not block.held


def test_weights_are_dealt_by_document_once(spark, sf):
    """Words are counted and gathered by document without a further exchange, and the placeholder takes no second read."""
    from trovex.plans import fixtures as fx
    from trovex.sources import writers

    impacts = E.quantize_impacts(fx.weights(spark, sf).select("docid", "token", (F.col("weight") - 0.95).alias("weight")))
    for df in (impacts, writers.sparse_docs(impacts), writers.sparse_queries(impacts.withColumnRenamed("docid", "qid"))):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    w = spark.createDataFrame([("a", "x", 0.004), ("a", "y", -1.0), ("b", "x", 0.5), ("b", "y", -0.2), ("c", "z", None)], "docid string, token string, weight double")
    assert rows(E.quantize_impacts(w)) == sorted(map(str, spark.createDataFrame([("a", "[NONE]", 1), ("b", "x", 50), ("c", "[NONE]", 1)], "docid string, token string, weight int").collect()))


def test_probes_keep_up_with_the_budget():
    """Tables of more bits are probed in more buckets, so a share of the rows stays within reach."""
    import numpy as np

    from trovex.operators import ann

    for bits, n in ((8, 2000), (10, 10_000), (13, 60_000)):
        index = ann.Tables(None, np.zeros((32, 64, bits)), n)
        share = ann.enough_probes(index, int(0.28 * n)) * 32 / (1 << bits)
        assert share >= 0.28 * 5 * 0.99
    assert ann.enough_probes(ann.Tables(None, np.zeros((32, 64, 10)), 10_000), 10) == 12


def test_a_task_drops_what_cannot_be_among_its_best():
    """Equal to a plain count, with documents found in several cells."""
    import numpy as np
    import pyarrow as pa

    from trovex.operators import ann

    rng = np.random.default_rng(2)
    found = [(f"q{rng.integers(5)}", f"d{rng.integers(30)}", float(rng.integers(20))) for _ in range(600)]
    best = {}
    for q, d, s in found:
        best[q, d] = max(s, best.get((q, d), -1))
    want = [(q, d, s) for one in sorted({q for q, *_ in found}) for q, d, s in sorted(((q, d, s) for (q, d), s in best.items() if q == one), key=lambda r: (-r[2], r[1]))[:7]]
    t = pa.table(dict(zip(("qid", "docid", "score"), map(list, zip(*found)))))
    halves = pa.concat_tables([ann._foremost(t.slice(0, 300), 7), t.slice(300)])
    for got in (ann._foremost(t, 7), ann._foremost(halves, 7)):
        assert list(zip(*got.to_pydict().values())) == want
