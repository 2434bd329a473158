"""Streaming jobs over several batches, late rows and restarts; merged sketches against exact ranks."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.model import scratch
from trovex.operators.training import hashing_encoder
from trovex.plans import streams
from trovex.streaming import jobs

T0 = datetime(2024, 5, 1)


def written(spark, path, schema, *files):
    """One file after the other."""
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_one_id_in_three_files_and_a_restart_is_one_row(spark, tmp_path):
    schema, src = "docid string, text string", tmp_path / "src"

    def run():
        jobs.drain(jobs.incremental_encode(jobs.file_stream(spark, str(src), schema, 1), hashing_encoder(), str(tmp_path / "sink"), str(tmp_path / "checkpoint")))
        return sorted((r.docid or "", r.n) for r in spark.read.parquet(str(tmp_path / "sink")).groupBy("docid").agg(F.count("*").alias("n")).collect())

    written(spark, src, schema, [("a", "one"), ("a", "one"), (None, "x")], [("a", "two"), ("b", None), (None, "y")])
    assert run() == [("", 2), ("a", 1), ("b", 1)]
    written(spark, src, schema, [("a", "three"), ("b", "b"), ("c", "c"), (None, "x")])
    assert run() == run() == [("", 2), ("a", 1), ("b", 1), ("c", 1)]


SCHEMA = "ts timestamp, session_key string, query string, iteration long"


def sessions(spark, path, files):
    written(spark, path / "src", SCHEMA, *files)
    src = jobs.file_stream(spark, str(path / "src"), SCHEMA, 1)
    jobs.run_append(jobs.session_stream(src, "30 minutes", "10 minutes"), str(path / "sink"), str(path / "checkpoint"))
    return sorted(tuple(r) for r in spark.read.schema(jobs.SESSION).parquet(str(path / "sink")).collect())


def test_sessions_do_not_depend_on_batches(spark, tmp_path):
    r = random.Random(8)
    rows = [(T0 + timedelta(minutes=r.randint(0, 600)), f"k{r.randint(0, 3)}", f"q{r.randint(0, 9)}", r.randint(0, 5)) for _ in range(120)]
    rows.append((T0 + timedelta(minutes=900), "k0", "end", 0))
    want = [tuple(x) for x in jobs.session_trace(spark.createDataFrame(rows, SCHEMA)).collect() if x.start < T0 + timedelta(minutes=850)]
    # a row comes up to nine minutes after its time
    come = sorted(rows, key=lambda x: x[0] + timedelta(minutes=r.randint(0, 9)))
    for i, cuts in enumerate([(len(come),), (40, 41, 80, len(come))]):
        files = [come[a:b] for a, b in zip((0, *cuts), cuts)]
        assert sessions(spark, tmp_path / str(i), files) == sorted(want)


def test_a_trace_is_in_the_order_of_iterations_and_a_late_row_is_left_out(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    first = [(at(0), "k", "third", 3), (at(1), "k", "first", 1), (at(20), "k", "second", 2), (at(100), "k", "next", 1)]
    late = [(at(5), "k", "late", 9), (at(95), "k", "in time", 0), (at(200), "k", "last", 1)]
    assert sessions(spark, tmp_path, [first, late]) == [("k", at(0), 3, "first", 3, ["first", "second", "third"]), ("k", at(95), 2, "in time", 1, ["in time", "next"])]


def test_percentiles_of_merged_windows_are_near_the_exact_ranks(spark):
    r = np.random.default_rng(6)
    values = np.concatenate([r.lognormal(3, 1, 30_000), np.full(10_000, 20.0)])
    rows = spark.createDataFrame([(T0 + timedelta(seconds=int(s)), "c", float(v)) for s, v in zip(r.integers(0, 3600, len(values)), values)], "ts timestamp, component string, value double")
    minutes = jobs.latency_sketches(rows, late=None)
    assert minutes.count() == 60
    shares = (0.01, 0.25, 0.5, 0.75, 0.95, 0.99)
    got = jobs.report(jobs.merged(minutes, "1 hour"), shares).first()
    assert got.n == len(values) and got.worst == pytest.approx(values.max(), abs=1e-6) and got["mean"] == pytest.approx(values.mean(), abs=1e-5)
    ordered = np.sort(values)
    for p in shares:
        x = got[f"p{round(100 * p)}"]
        low, high = np.searchsorted(ordered, x - 1e-5) / len(values), np.searchsorted(ordered, x + 1e-5, "right") / len(values)
        assert low - jobs.RANK_ERROR <= p <= high + jobs.RANK_ERROR


def test_batches_have_as_many_files_whatever_their_rows(spark, monkeypatch):
    """A batch of many rows is read by several tasks; one of few or none has as many files, so that no batch takes another's."""
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    minutes = [0] * 350 + [20] * 7 + [99]
    log = spark.createDataFrame([(i, T0 + timedelta(minutes=m, milliseconds=i)) for i, m in enumerate(minutes)], "id long, ts timestamp")
    src = streams._batches(spark, log, "id long, ts timestamp")
    sizes = []

    def step(batch, number):
        files = {r[0] for r in batch.select(F.input_file_name()).collect()}
        sizes.append((batch.count(), len(files)))

    src.writeStream.foreachBatch(step).trigger(availableNow=True).option("checkpointLocation", scratch(spark, "checkpoint")).start().awaitTermination()
    assert [n for n, _ in sizes if n] == [350, 7, 1] and sizes[0][1] > 1
