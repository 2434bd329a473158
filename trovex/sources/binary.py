"""Dense vector and neighbour files as data sources: readers of row ranges, writers that commit whole files or none.

A vector file is n int32, d int32, then n*d float32; a truth file n uint32, k uint32, n*k int32 ids, then n*k float32
distances unless it is of the e2e form. Parts of a folder are numbered in their names, and row numbers go on from part to part.

Readers look at the headers alone to plan; a task seeks to its rows and reads no others, some at a time, whatever the part's size.
Writers get rows numbered from 0 without gaps; a number that is missing or doubled is an error, so an index never shifts. Tasks
write to a folder of their own, with a new name for each attempt; the parts move to their places when all have been written and
counted, and are removed if a task fails for good.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CHUNK = 4096  #: rows that are held at once
ROWS = 100_000  #: rows of a part that a task reads
VECTORS, TRUTH = "trovex_vectors", "trovex_truth"
VECTOR_SCHEMA = "row_idx long, embedding array<float>"
TRUTH_SCHEMA = "query_idx int, rank int, doc_idx int, distance float"


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's writers would take it: on the default file system, unless it names another."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    return str(at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at))


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def opened(uri: str):
    system, path = located(uri)
    return system.open_input_file(path)


@dataclass
class Range(InputPartition):
    """Rows lo to hi of a file with n rows of `width` entries, the first of which is row `base` of the folder."""

    uri: str
    n: int
    width: int
    lo: int
    hi: int
    base: int


def headers(uri: str) -> list[tuple[str, int, int, int]]:
    """(file, n, width, bytes) of each part, in the order of their numbers."""
    system, path = located(uri)
    info = system.get_file_info(path)
    files = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(path)) if f.is_file and re.search(r"part-\d+\.bin$", f.path)]
    number = lambda f: int(re.search(r"part-(\d+)", f.path)[1]) if not info.is_file else 0
    scheme = uri.split("://")[0] + "://" if "://" in uri and not uri.startswith("file:") else ""
    out = []
    for f in sorted(files, key=number):
        own = f.path if not scheme else scheme + f.path
        with system.open_input_file(f.path) as stream:
            n, width = (int(v) for v in np.frombuffer(stream.read(8), "<u4"))
        out.append((own if scheme else f"file://{f.path}", n, width, f.size))
    return out


class _Reader(DataSourceReader):
    entry = 4  #: bytes of an entry of a row

    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.start, self.count = int(options.get("start", 0)), int(options["count"]) if "count" in options else None
        self.rows = int(options.get("rows", ROWS))

    def partitions(self) -> list[Range]:
        out, base = [], 0
        last = self.start + self.count if self.count is not None else None
        for uri, n, width, size in headers(self.uri):
            if size != 8 + n * width * self.entry:
                raise ValueError(f"file size does not fit its header: {uri}")
            lo, hi = max(0, self.start - base), n if last is None else min(n, last - base)
            out += [Range(uri, n, width, a, min(a + self.rows, hi), base) for a in range(lo, hi, self.rows)]
            base += n
        return out or [Range("", 0, 0, 0, 0, 0)]


class VectorReader(_Reader):
    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.lo == part.hi:
            return
        with opened(part.uri) as f:
            for lo in range(part.lo, part.hi, CHUNK):
                n = min(CHUNK, part.hi - lo)
                f.seek(8 + 4 * part.width * lo)
                x = np.frombuffer(f.read(4 * part.width * n), "<f4")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * part.width, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(part.base + lo + np.arange(n)), lists], ["row_idx", "embedding"])


class TruthReader(_Reader):
    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.e2e = options.get("e2e", "false").lower() == "true"
        self.entry = 4 if self.e2e else 8

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.lo == part.hi:
            return
        k = part.width
        with opened(part.uri) as f:
            for lo in range(part.lo, part.hi, CHUNK):
                n = min(CHUNK, part.hi - lo)
                f.seek(8 + 4 * k * lo)
                ids = np.frombuffer(f.read(4 * k * n), "<i4")
                far = pa.nulls(n * k, pa.float32())
                if not self.e2e:
                    f.seek(8 + 4 * k * (part.n + lo))
                    far = pa.array(np.frombuffer(f.read(4 * k * n), "<f4"))
                query = np.repeat(part.base + lo + np.arange(n), k).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(ids), far], ["query_idx", "rank", "doc_idx", "distance"])


@dataclass
class Written(WriterCommitMessage):
    """(part, rows, file) that a task has written."""

    parts: list[tuple[int, int, str]]


class _Writer(DataSourceArrowWriter):
    """Rows come sorted by their numbers, those of a part in one task."""

    def __init__(self, options: dict) -> None:
        self.uri, self.per, self.total, self.run = options["path"], int(options["per_part"]), int(options["total"]), options["run"]

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        system, path = located(self.uri)
        return system, f"{path.rstrip('/')}/{name}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done = Written([])
        stream, part, n = None, None, 0
        try:
            for number, content in self.rows(batches):
                if number // self.per != part:
                    if stream:
                        self.end(stream, done, part, n)
                    part, n = number // self.per, 0
                    system, name = self._at(f"_staging-{self.run}/part-{part:05d}-{uuid4().hex}.bin")
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(name)
                    self.file = name
                    self.begin(stream, min(self.per, self.total - part * self.per), content)
                if number != part * self.per + n:
                    raise ValueError(f"row {part * self.per + n} is missing or doubled")
                self.put(stream, content)
                n += 1
            if stream:
                self.end(stream, done, part, n)
                stream = None
        finally:
            if stream:
                stream.close()
        return done

    def end(self, stream, done: Written, part: int, n: int) -> None:
        if n != min(self.per, self.total - part * self.per):
            raise ValueError(f"row {part * self.per + n} is missing or doubled")
        stream.close()
        done.parts.append((part, n, self.file))

    def commit(self, messages: list[Written | None]) -> None:
        parts = {part: (n, name) for m in messages if m for part, n, name in m.parts}
        if sum(n for n, _ in parts.values()) != self.total:
            self.abort(messages)
            raise ValueError("rows are missing or doubled")
        for part, (_, name) in sorted(parts.items()):
            system, to = self._at(f"part-{part:05d}.bin")
            system.move(name, to)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, staging = self._at(f"_staging-{self.run}")
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class VectorWriter(_Writer):
    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        for b in batches:
            flat, upto = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f4"), b.column("embedding").offsets.to_numpy()
            for i, number in enumerate(b.column("row_idx").to_pylist()):
                yield number, flat[upto[i] - upto[0] : upto[i + 1] - upto[0]]

    def begin(self, stream, n: int, first: np.ndarray) -> None:
        self.width = len(first)
        stream.write(np.array([n, self.width], "<i4").tobytes())

    def put(self, stream, x: np.ndarray) -> None:
        if len(x) != self.width:
            raise ValueError("vectors have different widths")
        stream.write(x.tobytes())


class TruthWriter(_Writer):
    """A row is a query with its neighbours by rank; a part's distances are held until its ids are written."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.e2e = options.get("e2e", "false").lower() == "true"

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for b in batches:
            yield from zip(b.column("query_idx").to_pylist(), zip(b.column("ids").to_pylist(), b.column("distances").to_pylist()))

    def begin(self, stream, n: int, first: tuple) -> None:
        self.width, self.held = len(first[0]), []
        stream.write(np.array([n, self.width], "<u4").tobytes())

    def put(self, stream, x: tuple) -> None:
        if len(x[0]) != self.width:
            raise ValueError("queries have different numbers of neighbours")
        stream.write(np.array(x[0], "<i4").tobytes())
        if not self.e2e:
            self.held.append(np.array(x[1], "<f4").tobytes())

    def end(self, stream, done: Written, part: int, n: int) -> None:
        stream.write(b"".join(self.held))
        super().end(stream, done, part, n)


class VectorFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return VECTORS

    def schema(self) -> str:
        return VECTOR_SCHEMA

    def reader(self, schema) -> VectorReader:
        return VectorReader(self.options)

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(self.options)


class TruthFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return TRUTH

    def schema(self) -> str:
        return TRUTH_SCHEMA

    def reader(self, schema) -> TruthReader:
        return TruthReader(self.options)

    def writer(self, schema, overwrite: bool) -> TruthWriter:
        return TruthWriter(self.options)


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(VectorFiles)
    spark.dataSource.register(TruthFiles)
    return spark


def read_vectors(spark: SparkSession, path: str, start: int = 0, count: int | None = None, rows: int = ROWS) -> DataFrame:
    """(row_idx, embedding) of a row range of a file or folder, `rows` of a part to a task; no other rows are read."""
    options = {"start": start, "rows": rows} | ({} if count is None else {"count": count})
    return _registered(spark).read.format(VECTORS).options(**options).load(qualified(spark, path))


def read_truth_bin(spark: SparkSession, path: str, e2e: bool = False, rows: int = ROWS) -> DataFrame:
    """(query_idx, rank, doc_idx, distance); a part's size must be 8 + n*k*4, or 8 + n*k*8 with distances. Without, the distance is null."""
    return _registered(spark).read.format(TRUTH).options(e2e=e2e, rows=rows).load(qualified(spark, path))


def _write(df: DataFrame, kind: str, number: str, path: str, per_part: int, **options) -> DataFrame:
    """Parts of per_part rows; returns (part, n)."""
    spark = _registered(df.sparkSession)
    uri = qualified(spark, path)
    system, at = located(uri)
    system.create_dir(at, recursive=True)
    if any(re.search(r"part-\d+\.bin$", f.path) for f in system.get_file_info(fs.FileSelector(at))):
        raise FileExistsError(f"{path} has parts already")
    least, most = df.agg(F.min(number), F.max(number)).first()
    if least not in (0, None):
        raise ValueError("row 0 is missing")
    total = 0 if most is None else int(most) + 1
    parts = max(1, -(-total // per_part))
    rows = df.where(F.col(number).isNotNull()).repartitionByRange(parts, F.floor(F.col(number) / per_part)).sortWithinPartitions(number)
    rows.write.format(kind).mode("append").options(per_part=per_part, total=total, run=uuid4().hex, **options).save(uri)
    counts = [(i, min(per_part, total - i * per_part)) for i in range(parts if total else 0)]
    return spark.createDataFrame(counts, "part int, n long")


def write_vectors(df: DataFrame, path: str, per_part: int = 100_000) -> DataFrame:
    """df: (row_idx, embedding), numbered from 0 without gaps. Writes part-NNNNN.bin files, all or none; returns (part, n)."""
    return _write(df.select(F.col("row_idx").cast("long").alias("row_idx"), F.col("embedding").cast("array<float>").alias("embedding")), VECTORS, "row_idx", path, per_part)


def write_truth_bin(df: DataFrame, path: str, e2e: bool = False, per_part: int = 20_000) -> DataFrame:
    """df: (query_idx, rank, doc_idx[, distance]), as many ranks for each query, queries numbered from 0 without gaps: a part for each `per_part` queries."""
    distance = F.lit(None).cast("float") if e2e else F.col("distance").cast("float")
    near = F.array_sort(F.collect_list(F.struct("rank", F.col("doc_idx").cast("int").alias("doc"), distance.alias("distance"))))
    rows = df.groupBy(F.col("query_idx").cast("long").alias("query_idx")).agg(near.alias("near"))
    return _write(rows.select("query_idx", F.col("near.doc").alias("ids"), F.col("near.distance").alias("distances")), TRUTH, "query_idx", path, per_part, e2e=e2e)


def write_qrels_bin(qrels: DataFrame, id_map: DataFrame, path: str, one_index: bool = False, per_part: int = 20_000) -> DataFrame:
    """One document index for each query, header n, 1; 1-based input is shifted. qrels: (query_idx, docid); id_map: (docid, raw_id). A query whose docid isn't in the map is an error."""
    rows = qrels.join(id_map, "docid").select("query_idx", F.lit(1).alias("rank"), (F.col("raw_id") - (1 if one_index else 0)).cast("int").alias("doc_idx"))
    return write_truth_bin(rows, path, True, per_part)
