"""Queries of the streaming jobs, each drained over files with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import scratch, stored
from ..operators.training import hashing_encoder
from ..streaming import jobs
from . import fixtures as fx
from .registry import query
from .training import ENCODED


FILE_ROWS = 50_000  #: of a batch's file: larger tables come in more files a batch
BATCHES = 5  #: of a stream whose rows come in about the order of their times


def _stream(spark, df, schema, parts=4, per_batch=4):
    path = scratch(spark, "stream")
    df.repartition(parts).write.parquet(path)
    return jobs.file_stream(spark, path, schema, per_batch)


LOG = "id long, ts timestamp, api_key string, search_type string, value double"


def _log(spark, sf):
    return _stream(spark, fx.log(spark, sf), LOG)


@query("SELECT event_id AS id, 5 * (event_id % 20 + 1)::INT AS complexity FROM events")
def str1_stream_search_log(spark, sf):
    sink = scratch(spark, "sink")
    e = fx.log(spark, sf).select("id", F.expr("cast(id % 20 + 1 as int)").alias("k"), F.lit(None).cast("int").alias("complexity"))
    jobs.drain(jobs.stream_search_log(_stream(spark, e, "id long, k int, complexity int"), sink, scratch(spark, "checkpoint")))
    return spark.read.schema("id long, complexity int").parquet(sink)


def _batches(spark, df, schema, parts=BATCHES):
    """A stream of several batches. A row comes up to eight minutes after its time, by its id, so batches overlap; no row is later than the jobs allow."""
    path = scratch(spark, "stream")
    first, last = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    comes = F.unix_micros("ts") + F.pmod(F.xxhash64("id"), F.lit(480_000_000))
    part = F.least(F.floor((comes - (first or 0)) * parts / ((last or 0) - (first or 0) + 1)), F.lit(parts - 1)).cast("int")
    rows = stored(df.withColumn("_part", part))
    most = rows.groupBy("_part").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-most // FILE_ROWS))
    for i in range(parts):  # files are taken in the order in which they were written, so each batch must have as many
        rows.where(F.col("_part") == i).drop("_part").repartition(files).write.mode("append").parquet(path)
        for _ in range((i + 1) * files - len(spark.read.schema(schema).parquet(path).inputFiles())):
            rows.limit(0).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return jobs.file_stream(spark, path, schema, files)


WINDOWS = ", w AS (SELECT time_bucket(INTERVAL {width}, ts) AS start, search_type AS component, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS worst, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM log GROUP BY 1, 2)"


@query(fx.sql("log", WINDOWS.format(width="60 seconds") + " SELECT * FROM w WHERE start + INTERVAL 60 seconds <= (SELECT max(ts) - INTERVAL 10 minutes FROM log)"))
def str2_latency_windows(spark, sf):
    """Closed windows, over several batches."""
    sink = scratch(spark, "sink")
    src = _batches(spark, fx.log(spark, sf), LOG).withColumnRenamed("search_type", "component")
    jobs.run_append(jobs.latency_sketches(src), sink, scratch(spark, "checkpoint"))
    out = spark.read.schema("start timestamp, component string, n long, total double, worst double, sketch binary").parquet(sink)
    return jobs.report(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(fx.sql("log", WINDOWS.format(width="1 hour") + " SELECT start, component, n, mean, worst FROM w"))
def str2b_merged_windows(spark, sf):
    """Hours, merged from the sketches of minutes."""
    log = fx.log(spark, sf).withColumnRenamed("search_type", "component")
    hours = jobs.merged(jobs.latency_sketches(log, late=None), "1 hour")
    return jobs.report(hours).select(F.col("start").cast("timestamp_ntz").alias("start"), "component", "n", "mean", "worst")


@query(fx.sql("log", " SELECT id, value FROM log WHERE value > 60"))
def str3_slow_requests(spark, sf):
    sink = scratch(spark, "sink")
    jobs.run_append(jobs.slow_requests(_log(spark, sf)), sink, scratch(spark, "checkpoint"))
    return spark.read.schema("id long, value double").parquet(sink)


@query(fx.sql("log keys", " SELECT id, api_key IN (SELECT api_key FROM keys) AS verify_result FROM log"))
def str4_active_keys(spark, sf):
    sink = scratch(spark, "sink")
    jobs.drain(jobs.active_keys_stream(_log(spark, sf), lambda: fx.keys(spark, sf), sink, scratch(spark, "checkpoint")))
    return spark.read.schema(LOG + ", verify_result boolean").parquet(sink).select("id", "verify_result")


@query(ENCODED.format(id="doc_id", text="text", table="documents"))
def str5_incremental_encode(spark, sf):
    """Every document comes three times, in several batches; a second run takes up from the first one's checkpoint."""
    sink, checkpoint, path = (scratch(spark, name) for name in ("sink", "checkpoint", "stream"))
    docs = fx.corpus(spark, sf).select("docid", "text")
    files = 3 * max(1, -(-docs.count() // FILE_ROWS))  # so that a task's share stays as the table grows
    for again in (1, 2):
        docs.unionByName(docs.limit(0) if again == 1 else docs).repartition(files).write.mode("append").parquet(path)
        src = jobs.file_stream(spark, path, "docid string, text string", 2 * files // 3)
        jobs.drain(jobs.incremental_encode(src, hashing_encoder(), sink, checkpoint))
    e = spark.read.schema("docid string, embedding array<double>").parquet(sink)
    return e.select("docid", F.posexplode("embedding").alias("dim", "x")).select("docid", "dim", F.round("x", 6).alias("value")).where("value <> 0")


SESSIONS = ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY api_key ORDER BY ts) <= INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM log), s AS (SELECT *, sum(new) OVER (PARTITION BY api_key ORDER BY ts, id) AS s FROM g) SELECT api_key AS session_key, min(ts) AS start, count(*) AS n, first(search_type ORDER BY id % 5, ts, search_type) AS original_query, max(id % 5) AS iterations, string_agg(search_type, ' ' ORDER BY id % 5, ts, search_type) AS trace FROM s GROUP BY api_key, s"

def _requests(log):
    return log.select("ts", F.col("api_key").alias("session_key"), F.col("search_type").alias("query"), F.expr("id % 5").alias("iteration"))


def _told(sessions):
    return sessions.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("trace", F.array_join("trace", " "))


@query(fx.sql("log", SESSIONS))
def str6_session_trace(spark, sf):
    """The batch form of the job: all sessions, the last ones too."""
    return _told(jobs.session_trace(_requests(fx.log(spark, sf))))


@query(fx.sql("log", SESSIONS + " HAVING max(ts) + INTERVAL 30 minutes <= (SELECT max(ts) - INTERVAL 10 minutes FROM log)"))
def str6b_session_stream(spark, sf):
    """The job drained over several batches: sessions that the watermark has passed."""
    sink = scratch(spark, "sink")
    src = _requests(_batches(spark, fx.log(spark, sf), LOG))
    jobs.run_append(jobs.session_stream(src), sink, scratch(spark, "checkpoint"))
    return _told(spark.read.schema(jobs.SESSION).parquet(sink))
