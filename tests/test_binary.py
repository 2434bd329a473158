"""Vector and neighbour files: row ranges, gaps, commits."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.sources import binary


@pytest.fixture(scope="module")
def vectors(spark):
    x = np.random.default_rng(1).standard_normal((1000, 8)).astype("f4")
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_idx long, embedding array<float>").repartition(5)


def back(df):
    return {r.row_idx: r.embedding for r in df.collect()}


def test_round_trip_row_by_row(spark, vectors, tmp_path):
    x, df = vectors
    counts = {r.part: r.n for r in binary.write_vectors(df, str(tmp_path), 300).collect()}
    assert counts == {0: 300, 1: 300, 2: 300, 3: 100}
    assert sorted(os.path.basename(f) for f in glob.glob(f"{tmp_path}/*")) == [f"part-0000{i}.bin" for i in range(4)]
    assert np.fromfile(f"{tmp_path}/part-00003.bin", "<i4", 2).tolist() == [100, 8]
    got = back(binary.read_vectors(spark, str(tmp_path), rows=77))
    assert sorted(got) == list(range(1000)) and all(np.float32(v).tolist() == x[i].tolist() for i, v in got.items())
    assert sorted(back(binary.read_vectors(spark, f"file://{tmp_path}/part-00001.bin"))) == list(range(300))


@pytest.mark.parametrize("start, count", [(100, 250), (299, 2), (0, 0), (990, None), (2000, 5), (0, None)])
def test_a_range_reads_its_own_bytes_alone(spark, vectors, tmp_path, monkeypatch, start, count):
    x, df = vectors
    binary.write_vectors(df, str(tmp_path), 300)
    assert sorted(back(binary.read_vectors(spark, str(tmp_path), start, count, rows=64))) == list(range(1000))[start : None if count is None else start + count]
    read = []
    opened = binary.opened

    class Counted:
        def __init__(self, uri):
            self.f = opened(uri)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    monkeypatch.setattr(binary, "opened", Counted)
    reader = binary.VectorReader({"path": f"file://{tmp_path}", "start": str(start), "rows": "64"} | ({} if count is None else {"count": str(count)}))
    n = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
    assert sum(read) == n * 8 * 4


@pytest.mark.parametrize("change", ["row_idx <> 500", "row_idx <> 0", "twice"])
def test_missing_and_doubled_rows_are_errors_and_leave_no_file(spark, vectors, tmp_path, change):
    _, df = vectors
    rows = df.unionByName(df.where("row_idx = 7")) if change == "twice" else df.where(change)
    with pytest.raises(Exception, match="missing"):
        binary.write_vectors(rows, str(tmp_path), 300)
    assert not glob.glob(f"{tmp_path}/**/*.bin", recursive=True)


def test_other_widths_fail_and_files_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "row_idx long, embedding array<float>")
    with pytest.raises(Exception, match="widths"):
        binary.write_vectors(df, str(tmp_path))
    assert not glob.glob(f"{tmp_path}/**/*.bin", recursive=True)
    binary.write_vectors(df.limit(1), str(tmp_path))
    with pytest.raises(FileExistsError):
        binary.write_vectors(df.limit(1), str(tmp_path))


def test_a_failed_task_is_retried_under_another_name(tmp_path):
    """What an earlier attempt left is not committed."""
    import pyarrow as pa

    writer = binary.VectorWriter({"path": f"file://{tmp_path}", "per_part": "2", "total": "3", "run": "r"})
    batch = lambda *n: pa.RecordBatch.from_arrays([pa.array(n), pa.array([[float(i)] for i in n], pa.list_(pa.float32()))], ["row_idx", "embedding"])

    def breaks():
        yield batch(0, 1, 2)
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        writer.write(breaks())
    assert len(glob.glob(f"{tmp_path}/_staging-r/*")) == 2
    writer.commit([writer.write(iter([batch(0, 1), batch(2)])), None])
    assert sorted(os.listdir(tmp_path)) == ["part-00000.bin", "part-00001.bin"]
    with pytest.raises(ValueError, match="missing"):
        writer.commit([])


def test_neighbours_keep_their_query(spark, tmp_path):
    rows = [(q, r, 10 * q + r, float(q + r)) for q in range(7) for r in range(1, 4)]
    df = spark.createDataFrame(rows, "query_idx int, rank int, doc_idx int, distance float").repartition(4)
    for e2e in (False, True):
        at = str(tmp_path / str(e2e))
        binary.write_truth_bin(df, at, e2e, per_part=3)
        got = binary.read_truth_bin(spark, at, e2e, rows=2)
        assert sorted(map(tuple, got.collect())) == [(*r[:3], None if e2e else r[3]) for r in rows]
        assert os.path.getsize(f"{at}/part-00000.bin") == 8 + 9 * (4 if e2e else 8)
    with pytest.raises(Exception, match="missing"):
        binary.write_truth_bin(df.where("query_idx <> 4"), str(tmp_path / "gap"), per_part=3)
    with pytest.raises(Exception, match="neighbours"):
        binary.write_truth_bin(df.where("query_idx <> 4 or rank < 3"), str(tmp_path / "short"), per_part=30)


def test_qrels_raise_where_a_query_has_no_document(spark, tmp_path):
    ids = spark.createDataFrame([("a", 1), ("b", 5)], "docid string, raw_id long")
    qrels = spark.createDataFrame([(0, "b"), (1, "a")], "query_idx int, docid string")
    binary.write_qrels_bin(qrels, ids, str(tmp_path / "ok"), one_index=True)
    assert [tuple(r) for r in binary.read_truth_bin(spark, str(tmp_path / "ok"), True).select("query_idx", "doc_idx").orderBy("query_idx").collect()] == [(0, 4), (1, 0)]
    with pytest.raises(Exception, match="missing"):
        binary.write_qrels_bin(qrels.withColumn("query_idx", F.expr("query_idx * 2")), ids, str(tmp_path / "gap"))


def test_no_rows(spark, vectors, tmp_path):
    _, df = vectors
    assert binary.write_vectors(df.limit(0), str(tmp_path)).count() == 0
    assert binary.read_vectors(spark, str(tmp_path)).count() == 0
