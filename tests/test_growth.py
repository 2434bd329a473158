"""What grows with the pairs of queries and rows is neither written nor held."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.operators import ann, inverted, search, training
from trovex.operators import judgements as J

from .test_judgements import most_rows, odd  # noqa: F401


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def many(spark):
    """120 queries, 3,000 vectors, some alike, and two ids that come twice."""
    x = np.round(np.random.default_rng(4).standard_normal((3000, 8)), 1)
    x[100:140] = x[100]
    ids = [f"d{i}" for i in range(3000)]
    ids[7], ids[2000] = ids[1500], ids[30]
    p = spark.createDataFrame([(d, v.tolist()) for d, v in zip(ids, x)], "docid string, embedding array<float>").repartition(4).persist()
    q = spark.createDataFrame([(f"q{i}", f"d{i}", x[i].tolist()) for i in range(0, 3000, 25)], "qid string, own string, embedding array<float>").persist()
    p.count(), q.count()
    yield q, p
    p.unpersist(), q.unpersist()


def shared_buckets(q, p, index, probes):
    """{qid: {docid: buckets shared}}, one by one."""
    bits = index.planes.shape[2]
    asked, placed = q.collect(), p.collect()
    out = {r.qid: {} for r in asked}
    flips = np.array([[f >> j & 1 for j in range(bits)] for f in range(1 << bits)], float)
    for plane in index.planes:
        key = lambda v: int((np.array(v) @ plane > 0) @ (1 << np.arange(bits)))
        keys = [(r.docid, key(r.embedding)) for r in placed]
        for r in asked:
            margin = np.array(r.embedding) @ plane
            weak = np.argsort(abs(margin), kind="stable")
            near = np.argsort(flips @ abs(margin)[weak], kind="stable")[:probes]
            probed = {key(r.embedding) ^ sum(1 << int(weak[j]) for j in range(bits) if f >> j & 1) for f in near}
            for d, k in keys:
                if k in probed and d != r.own:
                    out[r.qid][d] = out[r.qid].get(d, 0) + 1
    return out


def test_candidates_by_counts_of_blocks_are_those_of_a_plain_count(spark, many, monkeypatch):
    q, p = many
    q, p = q.limit(12).persist(), p.where("substring(docid, -1) in ('0', '7')").persist()
    monkeypatch.setattr(ann, "SPAN", 100)
    index = ann.hash_tables(p, tables=6, bits=5)
    assert index.blocks.count() > 4
    plain = shared_buckets(q, p, index, 12)
    for budget in (1, 40, 5000):
        want = sorted((i, d) for i, found in plain.items() for d in sorted(found, key=lambda d: (-found[d], d))[:budget])
        for limit in (64 << 20, 600):  # queries are sent, or meet the blocks in a grid
            monkeypatch.setattr(search, "MATRIX_BYTES", limit)
            assert rows(ann.candidates(q, index, budget, 12, True)) == want
            made = ann.chosen(q, index, budget, 12, True)
            assert made.rows.agg(F.sum("found")).first()[0] == len(want)
            pairs = spark.createDataFrame(want, "qid string, docid string")
            assert rows(ann.best_chosen(made, 4).select("qid", "docid", "score", "rank")) == rows(ann.exact_scores(pairs, q, p, 4).select("qid", "docid", "score", "rank"))


def test_probes_beyond_those_of_ten_bits():
    """As many buckets are probed as are asked for, however many the bits."""
    block = object.__new__(ann._Places)
    block.planes, block.rows, block.starts, block.at = np.eye(12)[None], 1 << 12, np.arange(1 << 12), {}
    block.keys = np.arange(1 << 12)[None]
    x = np.random.default_rng(1).standard_normal((2, 12))
    for probes in (12, 1024, 3000):
        assert (block.counts(x, [None, None], probes).sum(axis=1) == probes).all()


def test_no_row_for_each_candidate(spark, many):
    """A budget of 840 rows for each of 120 queries is 100,800 candidates; no step has as many rows."""
    q, p = many
    index = ann.hash_tables(p)
    found = ann.knn_approx(q, p, 10, int(0.28 * index.rows), True, index)
    found.collect()
    assert most_rows(found) <= 10 * (3000 + 120)


def test_candidates_of_a_query_leave_one_task(spark, many, monkeypatch):
    """However many partitions a shuffle has; shares of the file and of the queries change no row."""
    q, p = many
    index = ann.ivf_index(p, nlist=30)
    want = rows(ann.knn_ivf(q, p, 5, index, nprobe=20, refine=50, exclude_self=True))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(kept, ("24", "false")):
            spark.conf.set(c, v)
        found = ann.knn_ivf(q, p, 5, index, nprobe=20, refine=50, exclude_self=True)
        assert rows(found) == want
        assert most_rows(found) <= 120 * 50 + 3 * 3000
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    for name, size in (("FILE_BYTES", 20_000), ("SHARE", 16), ("HELD", 500), ("QUERIES", 7)):
        monkeypatch.setattr(ann, name, size)
        assert rows(ann.knn_ivf(q, p, 5, index, nprobe=20, refine=50, exclude_self=True)) == want


def test_queries_in_passes_copy_no_part(spark, monkeypatch):
    """However many queries there are, the index is read where it lies, and a document is dealt once while it is built."""
    rng = np.random.default_rng(9)
    made = [(f"d{d}", [f"t{t}" for t in sorted(set(rng.integers(0, 60, 12)))]) for d in range(300)]
    dw = spark.createDataFrame([(d, t, [float(1 + (len(d) + int(w[1:])) % 5) for w in t]) for d, t in made], "docid string, tokens array<string>, weights array<double>")
    qw = dw.where("substring(docid, -1) = '3'").select(F.concat(F.lit("q"), "docid").alias("qid"), F.explode(F.arrays_zip("tokens", "weights")).alias("p")).select("qid", F.col("p.tokens").alias("token"), F.col("p.weights").alias("weight"))
    built = []
    keep = inverted.stored
    monkeypatch.setattr(inverted, "stored", lambda df, *name: built.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df, *name))
    index = inverted.build(dw, 16)
    assert sum(plan.count("Join") for plan in built) == 0
    want = rows(inverted.sparse_retrieve(qw, None, 6, index).select("qid", "docid", "score", "rank"))
    built.clear()
    monkeypatch.setattr(inverted, "QUERY_BYTES", 2500)
    got = inverted.sparse_retrieve(qw, None, 6, index)
    assert rows(got.select("qid", "docid", "score", "rank")) == want
    searched = [plan for plan in [*built, got._jdf.queryExecution().executedPlan().toString()] if "MapInArrow" in plan]
    assert len(searched) > 3 and not any("side#" in plan or "Generate" in plan for plan in searched)


def long_form(lists):
    side = lambda name, c: F.transform(c, lambda x, i: F.struct(F.lit(name).alias("side"), i.alias("place"), x.alias("doc")))
    docs = lists.select("qid", "query", F.inline(F.concat(side("p", F.col("positives")), side("n", F.col("negatives")))))
    return docs.select("qid", "query", "side", "place", F.posexplode("doc").alias("part", "ids"))


@pytest.mark.parametrize("form", [0, 1])
def test_passages_that_meet_queries_equal_those_of_lists(spark, odd, monkeypatch, form):  # noqa: F811
    """Ids that come twice or in two classes, null classes, own documents in and out of the class, documents without text."""
    judged, run = odd[form], odd[2]
    monkeypatch.setattr(training, "LISTED", 2)
    monkeypatch.setattr(training, "SALTS", 3)
    corpus = spark.createDataFrame([(f"d{i}", f"t{i}", f"one {i}\ntwo\n") for i in range(0, 42) if i % 5], "docid string, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"query {i}") for i in range(23) if i != 7], "qid string, text string")
    for split in ("\n", None):
        some = dict(split=split, max_len=4, n_sample=3)
        lists = training.pretokenize(queries, judged, run.select("qid", "docid"), corpus, training.hash_tokens(), **some)
        if split is None:
            lists = lists.withColumns({c: F.transform(c, lambda x: F.array(x)) for c in ("positives", "negatives")})
        got = training.pretokenized_passages(queries, judged, run.select("qid", "docid"), corpus, training.hash_tokens(), lambda x: x, **some)
        assert got.columns == ["qid", "query", "side", "place", "part", "ids"]
        assert rows(got) == rows(long_form(lists)) != []


def test_rows_of_a_passage_stand_together(spark, tmp_path):
    """As many rows as pairs, but written in a fraction of the bytes: lists by query take five times as many or more."""
    n = 60
    judged = J.ByClass(spark.range(n).selectExpr("concat('q', id) as qid", "'a' as class", "concat('d', id) as own"), spark.range(5 * n).selectExpr("concat('d', id) as docid", "'a' as class", "1 as rel"))
    line = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.md5(F.concat_ws("-", "id", k, i))), " ")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), line), "\n")
    corpus = spark.range(5 * n).select(F.expr("concat('d', id) as docid"), F.lit("").alias("title"), text.alias("text"))
    queries = spark.range(n).selectExpr("concat('q', id) as qid", "concat('query ', id) as text")
    run = spark.range(n).selectExpr("concat('q', id) as qid", "concat('d', id + 1) as docid")
    ids = lambda c: F.array_join(c, ",")
    lists = training.pretokenize(queries, judged, run, corpus, training.hash_tokens(), split="\n")
    forms = {
        "lists": long_form(lists).withColumns({"query": ids("query"), "ids": ids("ids")}),
        "met": training.pretokenized_passages(queries, judged, run, corpus, training.hash_tokens(), lambda x: ids(x), split="\n"),
    }
    size = {}
    for name, df in forms.items():
        df.write.parquet(str(tmp_path / name))
        size[name] = sum(f.stat().st_size for f in (tmp_path / name).glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "met")).count() == (n * (5 * n - 1) + n) * 60
    assert size["met"] * 5 < size["lists"]


def test_written_rows_are_packed(spark, tmp_path):
    """Every row is in its file, in files of at most five rows, in less than a third of the bytes of the text."""
    lists = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.array(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda j: (F.col("id") * 31 + F.floor(i / 4) * j * 977).cast("int") % 30000)))
    made = spark.range(23).select(F.array(F.col("id").cast("int")).alias("query"), lists.alias("positives"), F.slice(lists, 1, 2).alias("negatives"))
    training.write_pretokenized(made, str(tmp_path / "out"), 5)
    files = list((tmp_path / "out").glob("part-*"))
    back = spark.read.schema(made.schema).json(str(tmp_path / "out"))
    assert rows(back) == rows(made)
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 5
    assert sum(f.stat().st_size for f in files) * 3 < made.agg(F.sum(F.length(F.to_json(F.struct(*made.columns))))).first()[0]
