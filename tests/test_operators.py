"""Properties and edge cases that the registered queries don't show."""

import pytest
from pyspark.sql import functions as F

from trovex.operators import evaluation as E
from trovex.operators import filters, layout, projections, search
from trovex.plans import fixtures as fx
from trovex.sources import binary, readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_truth_as_run_is_perfect(spark, sf):
    run = fx.run(spark, sf)
    truth = run.where("rank <= 10").select("qid", "docid", F.lit(1).alias("rel"))
    assert E.recall_at_k(run, truth, 10).first().value == 1.0
    assert E.anns_recall_at_k(run, run, 10).first().value == 1.0
    assert E.ndcg_at_k(run, truth, 10).first().value == 1.0


def test_more_queries_than_one_matrix_holds(spark, sf, monkeypatch):
    q, p = fx.queries(spark, sf), fx.vectors(spark, sf)
    want = rows(search.knn_blocked(q, p, 5))
    monkeypatch.setattr(search, "MATRIX_BYTES", 64 * 4 * 7)
    assert rows(search.knn_blocked(q, p, 5)) == want


def test_k_beyond_the_corpus_gives_fewer_rows(spark, sf):
    p = fx.vectors(spark, sf).limit(3)
    assert search.knn_blocked(fx.queries(spark, sf).limit(2), p, 10).count() == 6


def test_empty_sides(spark, sf):
    q, p = fx.queries(spark, sf), fx.vectors(spark, sf)
    assert search.knn_blocked(q.limit(0), p, 5).count() == 0
    assert search.knn_blocked(q, p.limit(0), 5).count() == 0
    assert E.mrr_at_k(fx.run(spark, sf).limit(0), fx.qrels(spark, sf), 10).first().value is None


def test_shards_are_parsed_and_checked():
    assert filters.parse_shards("3,1,3", 4) == [3, 1]
    assert filters.parse_shards(None, 3) == [0, 1, 2]
    with pytest.raises(ValueError):
        filters.parse_shards("4", 4)


def test_invalid_docids_go_and_accents_are_decomposed(spark):
    ids = spark.createDataFrame([("clueweb22-en0035-22-03042",), ("clueweb22-en35-22-3",), (None,)], "docid string")
    assert rows(projections.parse_docid(ids).select("lang", "file_seq", "doc_seq")) == [("en", "22", 3042)]
    df = spark.createDataFrame([(1, "Où l'été, 3!")], "id int, t string")
    assert projections.answer_tokens(df, "t").first().tokens == ["où", "l", "'", "été", ",", "3", "!"]


def test_missing_template_values(spark):
    df = spark.createDataFrame([(1, None)], "id int, a string")
    assert projections.fill_template(df, "x<a>y").first().text == "xy"
    with pytest.raises(Exception, match="no value"):
        projections.fill_template(df, "x<a>y", allow_missing=False).collect()


def test_fewer_negatives_than_asked_are_drawn_again(spark):
    df = spark.createDataFrame([("q", 0, ["a", "b"]), ("r", 1, [])], "qid string, row int, negatives array<string>")
    got = {r.qid: r.chosen for r in layout.rotate_negatives(df, 1, 4, 3).collect()}
    assert len(got["q"]) == 4 and set(got["q"]) <= {"a", "b"} and got["r"] == []
    assert all(r.chosen == [] for r in layout.rotate_negatives(df, 1, 0, 3).collect())


def test_run_lines_of_other_lengths_go(spark, tmp_path):
    (tmp_path / "run.txt").write_text("q1 d1 0.5\nq1 Q0 d2 1 0.25 tag\nq1 d3 _ 0.125\nq1 d4\n\nq1 a b c d\n")
    assert rows(readers.read_run(spark, str(tmp_path)).drop("line_no")) == [("q1", "d1", 0.5), ("q1", "d2", 0.25), ("q1", "d3", 0.125)]


def test_files_as_others_write_them(spark, tmp_path):
    """Two-field truth in file order, four-field judgements and URL maps whose last line wins, over splits of one file."""
    for name, text in {
        "truth": "q2\td9\nq1\td3\nq2\td1\n\nq1\td7\nq1\td2\n",
        "qrels": "q1 0 d1 1\nq2 0 d5 0\nq1 0 d2 0\nq2 0 d4 1\n",
        "urls": "d1,http://a\nd2,http://b\nd3,http://a\n",
    }.items():
        (tmp_path / f"{name}.tsv").write_text(text)
    at = lambda name: str(tmp_path / f"{name}.tsv")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for limit in (size, "16"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            assert rows(readers.read_anns_truth(spark, at("truth"))) == [("q1", "d2", 3), ("q1", "d3", 1), ("q1", "d7", 2), ("q2", "d1", 2), ("q2", "d9", 1)]
            assert rows(readers.read_qrels4(spark, at("qrels"), last_wins=True)) == [("q1", "d2", 0), ("q2", "d4", 1)]
            assert rows(readers.read_qrels4(spark, at("qrels"))) == [("q1", "d1", 1), ("q2", "d4", 1)]
            assert rows(readers.read_url_map(spark, at("urls"))) == [("http://a", "d3"), ("http://b", "d2")]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_all_languages_of_web_ids(spark):
    langs = ["de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "zh_chs", "other"]
    df = spark.createDataFrame([(f"clueweb22-{x}0102-03-00004", x) for x in langs] + [("clueweb22-xx0102-03-00004", "xx")], "docid string, lang string")
    got = projections.parse_docid(df).collect()
    assert sorted(r.lang for r in got) == sorted(langs)
    assert {r.path for r in got if r.lang == "zh_chs"} == {"zh_chs/zh_chs01/zh_chs0102/zh_chs0102-03.json.gz"}
    assert filters.filter_lang(df, langs).count() == 11
    with pytest.raises(ValueError):
        filters.filter_lang(df, ["po"])


def test_patterns_of_each_row(spark):
    df = spark.createDataFrame([(1, "A\nThe end", ["^the"]), (2, "The end", ["(", "x"]), (3, None, ["a"]), (4, "b", None), (5, "b", [None, "B"])], "id int, text string, answers array<string>")
    assert rows(filters.has_answer_regex(df).select("id", "hit")) == [(1, True), (2, False), (3, False), (4, False), (5, True)]


def test_percentiles_of_few_and_equal_values(spark):
    def stats(values):
        return {r.stat: r.value for r in E.latency_stats(spark.createDataFrame([(v,) for v in values], "value double")).collect()}

    assert stats([3.0, 1.0, None, 2.0])["p25"] == 1.5 and stats([5.0] * 100)["p95"] == 5.0
    assert stats([])["p50"] is None and stats([None])["total"] is None


def test_nearest_centroid_in_blocks(spark, sf, monkeypatch):
    v = fx.vectors(spark, sf)
    c = v.where("vec_id < 5").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid"))
    want = rows(E.assign_nearest(v, c))
    monkeypatch.setattr(search, "MATRIX_BYTES", 64 * 8 * 2)
    assert rows(E.assign_nearest(v, c)) == want


def test_truth_file_of_a_wrong_size_is_an_error(spark, tmp_path):
    import numpy as np

    (tmp_path / "part-00000.bin").write_bytes(np.array([2, 3], "<u4").tobytes() + bytes(20))
    with pytest.raises(Exception, match="does not fit"):
        binary.read_truth_bin(spark, str(tmp_path)).collect()


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 15
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace as N

    from trovex.model import shared_dir

    def session(master, named=None):
        kept = []
        conf = N(get=lambda key: named)
        return N(sparkContext=N(master=master, getConf=lambda: conf, getCheckpointDir=lambda: kept[0] if kept else None, setCheckpointDir=kept.append))

    assert shared_dir(session("local[4]")).startswith("/")
    assert shared_dir(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError, match="share"):
            shared_dir(session(master))


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 div 3 as k", "id").repartition(7)
    got = [r.row for r in layout.dense_index(df, ["k", "id"]).orderBy("k", "id").collect()]
    assert got == list(range(1000))
    assert layout.dense_index(df.limit(0), "k").count() == 0
