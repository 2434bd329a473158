"""Answers, pair scores, token rows and encodings beyond what the registered queries show."""

import random
from uuid import uuid4

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.operators import evaluation as E
from trovex.operators import filters, search
from trovex.operators import training as T
from trovex.plans import fixtures as fx


def test_a_text_is_scanned_once_for_ten_thousand_answers():
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(40)]
    answers = [" ".join(r.choice(words) for _ in range(r.randint(1, 3))) for _ in range(10_000)]
    few, many = filters.Scanner(), filters.Scanner()
    rows = texts * 3
    assert few.hits(rows, [answers[:10]] * len(rows)) == [any(f" {a} " in f" {t} " for a in answers[:10]) for t in rows]
    each = [answers[i::40] for i in range(40)] * 3
    assert many.hits(rows, each) == [any(f" {a} " in f" {t} " for a in own) for t, own in zip(rows, each)]
    assert few.scans == many.scans == len(texts)


def test_answers_are_token_sequences(spark):
    rows = [
        (1, "The Cat sat.", ["cat SAT"]), (2, "concatenate", ["cat"]), (3, "a b c", ["a c", "b c"]), (4, "x", []), (5, "x", None), (6, None, ["x"]), (7, "x", [None, "", " \t"]),
        (8, "l’été", ["été"]), (9, "3.5 !", ["3 . 5"]), (10, "a \x01 b", ["a b"]),
    ]
    df = spark.createDataFrame(rows, "id int, text string, answers array<string>")
    hits = {r.id for r in filters.has_answer(df).where("hit").collect()}
    assert hits == {1, 3, 8, 9, 10}
    assert {r.id for r in filters.has_answer(df, normalize=False).where("hit").collect()} == {1, 3, 9, 10}


def test_the_automaton_starts_anew_beyond_its_bound():
    s = filters.Scanner(most=5)
    for i in range(20):
        assert s.hits([f"t{i} x"], [[f"t{i}", "nothing"]]) == [True] and len(s.forms) <= 5
        assert s.hits([f"t{i} x"], [[f"t{i + 1}"]]) == [False]
    assert s.hits(["a b"], [[str(i) for i in range(10)] + ["b"]]) == [True]  # more than the bound in one row


def test_one_scorer_a_process_and_batches_of_like_lengths(spark, tmp_path):
    log = str(tmp_path)

    def make():
        import os
        import uuid

        open(f"{log}/made-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def score(pairs):
            size = [len(a) + len(b) for a, b in pairs]
            with open(f"{log}/batches-{os.getpid()}", "a") as f:
                f.write(f"{len(pairs)} {max(size) - min(size)}\n")
            return [float(len(b)) for _, b in pairs]

        return score

    rows = [("q", f"d{i}", i, "ask", "x" * (i * 37 % 101)) for i in range(200)] + [("q2", "d", 1, None, None)]
    df = spark.createDataFrame(rows, "qid string, docid string, rank int, query string, text string").repartition(8)
    got = search.rerank(df, lambda r: search.score_pairs(r, make, batch=8)).collect()
    want = sorted((r for r in rows if r[0] == "q"), key=lambda r: (-len(r[4]), r[1]))
    assert [r.docid for r in sorted(got, key=lambda r: (r.qid, r.new_rank)) if r.qid == "q"] == [r[1] for r in want]
    assert {(r.docid, r.old_rank) for r in got if r.qid == "q"} == {(r[1], r[2]) for r in rows[:-1]}
    made = [f.name.split("-")[1] for f in tmp_path.glob("made-*")]
    assert 0 < len(made) == len(set(made))
    batches = [tuple(map(int, line.split())) for f in tmp_path.glob("batches-*") for line in f.read_text().splitlines()]
    assert sum(n for n, _ in batches) == len(rows) and max(n for n, _ in batches) == 8 and np.median([d for _, d in batches]) < 40

    with pytest.raises(Exception, match="scores for"):
        search.score_pairs(df, lambda: lambda pairs: [1.0]).collect()


def test_pretokenized_rows(spark):
    q = spark.createDataFrame([("q1", "ask one"), ("q2", "two"), ("q3", "no positive")], "qid string, text string")
    good = spark.createDataFrame([("q1", "b"), ("q1", "a"), ("q2", "gone"), ("q1", "a")], "qid string, docid string")
    bad = spark.createDataFrame([("q1", f"n{i}") for i in range(9)] + [("q2", "a"), ("q3", "a")], "qid string, docid string")
    corpus = spark.createDataFrame([("a", None, "t1|t2"), ("b", "T", None)] + [(f"n{i}", "", f"n{i}") for i in range(9)], "docid string, title string, text string")
    tokens = T.of_strings(lambda t: [len(w) for w in t.split()])
    got = {r.qid: r for r in T.pretokenize(q, good, bad, corpus, tokens, None, "<title> xx <text>", "|", 3, 1, 4).collect()}
    assert set(got) == {"q1", "q2"} and got["q1"].query == [3]
    assert got["q1"].positives == [[[2, 2], [2, 2]], [[1, 2]]] and len(got["q1"].negatives) == 4
    assert got["q2"].positives == [] and got["q2"].negatives == [[[2, 2], [2, 2]]]
    flat = {r.qid: r for r in T.pretokenize(q, good, bad, corpus, tokens, sep=" - ").collect()}
    assert flat["q1"].positives == [[1, 5], [1, 1]] and len(flat["q1"].negatives) == 9


def test_incomplete_encodings_are_errors(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), (None, None)], "docid string, text string")
    assert T.encode_to(df, T.hashing_encoder(), str(tmp_path / "ok")).count() == 3
    with pytest.raises(Exception, match="vectors for"):
        T.encode_to(df, lambda texts: np.zeros((len(texts) - 1, 2)), str(tmp_path / "short"))
    lost = df.withColumn("docid", F.udf(lambda: uuid4().hex).asNondeterministic()())  # ids that differ in each reading
    with pytest.raises(ValueError, match="other ids"):
        T.encode_to(lost, T.hashing_encoder(), str(tmp_path / "other"))


def test_member_lists_in_blocks_and_rounds_from_given_centroids(spark, sf):
    v = fx.vectors(spark, sf)
    start = v.where("vec_id < 4").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid"))
    found = E.lloyd_spherical(v, start, 3)
    blocks = E.cluster_members(found, 20)
    assert blocks.agg(F.max("n")).first()[0] < 45 and blocks.count() > 8
    listed = {(m, r.cluster) for r in blocks.collect() for m in r.members}
    assert listed == {(r.docid, r.cluster) for r in found.collect()}
    x = {r.docid: np.array(r.embedding, float) for r in v.collect()}
    unit = {d: e / np.linalg.norm(e) for d, e in x.items()}
    c = {r.cluster: np.array(r.centroid, float) for r in start.collect()}
    for _ in range(4):
        own = {d: min(c, key=lambda k: (-round(float(e @ c[k]), 6), k)) for d, e in x.items()}
        c = {k: (m := np.mean([unit[d] for d in own if own[d] == k], axis=0)) / np.linalg.norm(m) for k in set(own.values())}
    assert sum(own[d] != k for d, k in listed) <= 1


def test_few_vectors_score_minus_one(spark, sf):
    v = fx.vectors(spark, sf).limit(3)
    assert {(r.k, r.score, r.best, r.band) for r in E.select_k(v, [1, 3, 9]).collect()} == {(1, -1.0, True, "none"), (3, -1.0, False, "none"), (9, -1.0, False, "none")}
