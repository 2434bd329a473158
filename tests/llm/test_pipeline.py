"""The pipeline against each stage's brute-force or single-step result."""

from pyspark.sql import functions as F

import corpus_pipeline as P
from trovex.llm import mixing, quality

from .test_dedup import brute_repeats, runs_of
from .test_models import number, raked
from .test_scores import brute_hits


def near_classes(texts):
    """id -> least id reachable by five-word runs of Jaccard similarity 0.8 or more, by comparing all pairs."""
    sets, root = {i: runs_of(t) for i, t in texts.items()}, {i: i for i in texts}
    for b in sets:
        for a in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def test_rows_without_or_under_one_id_stay_apart(spark, sf):
    """Distinct clean texts pass every filtering stage, whatever their ids; copies among them go."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step = docs
    for _, stage in P.STAGES[:4]:
        step = stage(spark, step, sf)
    clean = [r.asDict() for r in step.where("length(text) > 300").orderBy("doc_id").limit(12).collect()]
    ids = [None] * 5 + [7] * 4 + [50, 51, None]
    rows = [{**r, "doc_id": i} for r, i in zip(clean, ids)]
    copies = [{**clean[0], "doc_id": 60}, {**clean[5], "doc_id": None}, {**clean[9], "doc_id": 7}]
    want = sorted(r["text"] for r in clean)
    step = spark.createDataFrame([*rows, *copies], docs.schema).repartition(3)
    for _, stage in P.STAGES[:4]:
        step = stage(spark, step, sf)
        assert sorted(set(r.text for r in step.collect())) == want
    assert sorted(r.text for r in step.collect()) == want and {r.doc_id for r in step.collect() if r.text == clean[0]["text"]} == {60}


def test_stages_in_order_and_on_what_is_left(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "mixture"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    left = {i: t for i, t in texts.items() if i in good}
    roots = near_classes(left)
    left = {i: t for i, t in left.items() if roots[i] == i}
    repeats = brute_repeats(list(left.items()), 20)

    step = docs
    for name, stage in P.STAGES[:4]:
        step = stage(spark, step, sf)
        assert step.columns == docs.columns
        rows = {r.doc_id: r for r in step.collect()}
        step = spark.createDataFrame(list(rows.values()), docs.schema)
        if name == "quality":
            assert set(rows) == good
        if name == "near_dedup":
            assert set(rows) == set(left)
        if name == "substring_dedup":
            assert set(rows) == {i for i in left if not 0 < repeats[i][0] == repeats[i][1]}
            for i, r in rows.items():
                assert len(r.text.split()) == repeats[i][0] - repeats[i][1]
                assert (r.text == left[i]) == (repeats[i][1] == 0) and r.n_chars == len(r.text)
        if name == "decontamination":
            hits = brute_hits([(i, t) for i, t in before.items()], bench, 10)
            assert set(rows) == {i for i in before if hits[i][1] == 0}
        before = {i: r.text for i, r in rows.items()}
    drawn = mixing.mix(step).collect()
    chance = raked(drawn)
    hashes = {r.doc_id: r.h for r in step.select("doc_id", F.xxhash64("doc_id", "text").alias("h")).collect()}
    want = {r.doc_id for r in drawn if number(r.doc_id, hashes[r.doc_id], 0) < chance[r.source, r.lang, r.topic]}
    final = P.run(spark, sf)
    assert final.columns == [*docs.columns, "topic", "n_tokens", "weight", "probability"]
    assert {r.doc_id for r in final.collect()} == want


def test_empty_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_columns_with_clashing_names(spark, sf):
    names = ["k", "th", "spans", "own", "fp", "rep", "key", "_kept", "_hit", "rid", "items", "n_words", "kept_text", "score", "label", "weight", "kept", "topic", "_c0", "page"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).withColumns({n: F.lit(n) for n in names})
    for _, stage in P.STAGES[:4]:
        docs = stage(spark, docs, sf)
        assert docs.columns[5:] == names
    out = P.mixture(spark, docs, sf)
    assert out.columns == [*docs.columns, "topic_", "n_tokens", "weight_", "probability"]
    assert all(r[n] == n for r in out.collect() for n in names) and all(r.weight_ > 0 for r in out.collect())
