"""Schemas, table access and scratch folders."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CORPUS = "docid string, text_id string, title string, text string"
QUERY = "query_id string, query string"
RUN = "qid string, docid string, score double"
QRELS = "qid string, docid string, rel int"
PASSAGES = "array<struct<docid:string,title:string,text:string>>"
GROUPS = f"query_id string, query string, positive_passages {PASSAGES}, negative_passages {PASSAGES}"
DPR = "question string, positive_ctxs array<struct<title:string,text:string>>, hard_negative_ctxs array<struct<title:string,text:string>>"
LOG = "id long, ip_address string, query_text string, k int, complexity int, num_of_shards int, with_distance boolean, with_outlink boolean, search_type string, timestamp timestamp, api_key string, verify_result boolean"
#: Bytes of an Arrow batch between Spark and Python, unless the session says otherwise: texts come by many megabytes else, in each task
BATCHES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"
KEYS = "map<string,struct<enabled_time:timestamp,user_info:string,is_active:boolean>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, a temporary one, but only if there is no other machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        top = sc.getConf().get("spark.checkpoint.dir")
        if top is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(top or tempfile.mkdtemp(prefix="trovex-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Written once as Parquet and reread, for frames that several branches read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, so that their Python workers can import it wherever they run; bounds Arrow batches."""
    if spark.conf.get(BATCHES, None) is None:
        spark.conf.set(BATCHES, BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_trovex_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="trovex-code-")) / "trovex_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._trovex_shipped = True
    return spark
