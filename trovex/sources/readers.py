"""Readers of retrieval files. Schemas are always given, never inferred; order in a file is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model


def _trim(c: str | Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def read_corpus(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    rows = spark.read.schema(model.CORPUS).format(fmt).load(path)
    return rows.select(F.coalesce("docid", "text_id").alias("docid"), "title", "text")


def read_queries(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(model.QUERY)
    rows = reader.json(path) if fmt == "json" else reader.csv(path, sep="\t", quote="")
    return rows.select(_trim("query_id").alias("query_id"), _trim("query").alias("query"))


def _place() -> list[Column]:
    """The row's file, and a number that grows along it: where the row's part of the file begins, and its place in the task that reads it."""
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    return [F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + within).alias("line_no")]


def _fields(spark: SparkSession, path: str, pattern: str = r"\s+") -> DataFrame:
    """(f, file, line_no) of lines that aren't blank."""
    rows = spark.read.text(path).select("value", *_place())
    return rows.where(F.trim("value") != "").select(F.split(_trim("value"), pattern).alias("f"), "file", "line_no")


def read_qrels2(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (qid, docid); shorter lines go."""
    rows = _fields(spark, path, "\t").where(F.size("f") >= 2)
    return rows.select(_trim(F.col("f")[0]).alias("qid"), _trim(F.col("f")[1]).alias("docid")).distinct()


def read_qrels4(spark: SparkSession, path: str, last_wins: bool = False) -> DataFrame:
    """(qid, docid, rel) from lines `qid _ docid rel`. last_wins keeps the last line of each query, in order of files and lines; else all with rel 1."""
    f = F.col("f")
    rows = _fields(spark, path).where(F.size("f") >= 4).select(f[0].alias("qid"), f[2].alias("docid"), f[3].cast("int").alias("rel"), "file", "line_no")
    if last_wins:
        return rows.groupBy("qid").agg(F.max_by(F.struct("docid", "rel"), F.struct("file", "line_no")).alias("x")).select("qid", "x.docid", "x.rel")
    return rows.where("rel = 1").select("qid", "docid", "rel")


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, score, line_no) from lines of 3 fields (qid docid score), 4 (qid docid _ score) or 6 (TREC); others go. line_no grows along a file."""
    f, n = F.col("f"), F.size("f")
    score = F.when(n == 3, F.get(f, F.lit(2))).when(n == 4, F.get(f, F.lit(3))).when(n == 6, F.get(f, F.lit(4)))
    docid = F.when(n == 6, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1)))
    return _fields(spark, path).where(n.isin(3, 4, 6)).select(f[0].alias("qid"), docid.alias("docid"), score.cast("double").alias("score"), "line_no")


def read_anns_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, docid, rank) from lines `qid TAB docid`; rank is the line's place among its query's, in order of files and lines."""
    rows = _fields(spark, path, "\t").where(F.size("f") >= 2).select(_trim(F.col("f")[0]).alias("qid"), _trim(F.col("f")[1]).alias("docid"), "file", "line_no")
    return rows.select("qid", "docid", F.row_number().over(Window.partitionBy("qid").orderBy("file", "line_no")).alias("rank"))


def read_embedding_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, raw_id, docid, embedding) of shard=N folders; asking for some shards reads those alone."""
    return spark.read.schema("raw_id long, docid string, embedding array<float>, shard int").parquet(path)


def scan_web_records(spark: SparkSession, root: str, kind: str = "txt") -> DataFrame:
    """(docid, record) of all .json.gz files of a kind; members joined in one file are all read."""
    if kind not in ("txt", "inlink", "outlink"):
        raise ValueError(f"unknown kind {kind}")
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json.gz").text(f"{root}/{kind}")
    return lines.select(F.get_json_object("value", "$['ClueWeb22-ID']").alias("docid"), F.col("value").alias("record"))


def enumerate_docids(files: DataFrame) -> DataFrame:
    """files (subdir, file_seq, n_bytes): offsets of 11 bytes, one more than documents. Sizes that 11 doesn't divide are skipped."""
    n = (F.col("n_bytes") / 11 - 1).cast("int")
    some = files.where("n_bytes % 11 = 0 and n_bytes > 11")
    return some.select(F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "subdir", "file_seq").select(F.format_string("clueweb22-%s-%02d-%05d", "subdir", "file_seq", "i").alias("docid"))


def html_body(raw: DataFrame) -> DataFrame:
    """(page_id, html): what follows the first blank line of a raw record."""
    text = F.replace("raw", F.lit("\r\n"), F.lit("\n"))
    at = F.instr(text, "\n\n")
    return raw.select("page_id", F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text).alias("html"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, categories, title); rows without id or title go."""
    rows = spark.read.schema("item_id string, categories string, title string").csv(path, sep="\t", header=True, enforceSchema=True, quote="")
    return rows.dropna(subset=["item_id", "title"])


def read_url_map(spark: SparkSession, path: str) -> DataFrame:
    """(url, docid) from lines `doc_id,url`; of a URL's lines the last wins, in order of files and lines."""
    rows = spark.read.schema("docid string, url string").csv(path).select("docid", "url", *_place())
    return rows.groupBy("url").agg(F.max_by("docid", F.struct("file", "line_no")).alias("docid"))


def read_negatives(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("qid string, ids string").csv(path, sep="\t", quote="")
    return rows.select("qid", F.posexplode(F.split("ids", ",")).alias("pos", "docid"))


def read_dpr(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(model.DPR).json(path, multiLine=True)


def read_access_keys(spark: SparkSession, path: str) -> DataFrame:
    """(api_key, enabled_time, user_info) of active keys in a JSON object of keys."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", model.KEYS)).alias("api_key", "v"))
    return rows.where("v.is_active").select("api_key", "v.enabled_time", "v.user_info")
