"""Structured Streaming jobs: request log, latency windows, alerts, keys, incremental encoding, sessions.

Late rows: 10 minutes by default. Each job takes a streaming DataFrame; `drain` runs one to the end of what is there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"
STORE = "spark.sql.streaming.stateStore.providerClass"
CHAINS = "spark.sql.streaming.statefulOperator.allowMultiple"
SKETCH = 800  #: size of a quantile sketch: up to so many values are held as they are
RANK_ERROR = 0.01  #: of a percentile's rank, as a share of all values, in merged sketches of that size
SESSION = "session_key string, start timestamp, n long, original_query string, iterations long, trace array<string>"


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()


def _append(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_search_log(src: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    return _append(src.withColumn("complexity", F.coalesce("complexity", 5 * F.col("k")).cast("int")), sink, checkpoint)


def latency_sketches(src: DataFrame, width: str = "60 seconds", late: str | None = LATE) -> DataFrame:
    """src: (ts timestamp, component, value). (start, component, n, total, worst, sketch): a window's values as a mergeable quantile sketch.

    A stream gives out a window when the watermark has passed it; late is None for a table.
    """
    rows = src if late is None else src.withWatermark("ts", late)
    g = rows.groupBy(F.window("ts", width), "component")
    out = g.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("worst"), F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(SKETCH)).alias("sketch"))
    return out.select(F.col("window.start").alias("start"), "component", "n", "total", "worst", "sketch")


def merged(sketches: DataFrame, width: str) -> DataFrame:
    """Sketches of longer windows from those of shorter ones, without the values."""
    g = sketches.groupBy(F.window("start", width), "component")
    out = g.agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("worst").alias("worst"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    return out.select(F.col("window.start").alias("start"), "component", "n", "total", "worst", "sketch")


def report(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(start, component, n, mean, worst, p50, p95, ..): a percentile's rank is within RANK_ERROR of all values of what it should be, and exact where a sketch holds all values."""
    points = [F.round(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))), 6).alias(f"p{round(100 * p)}") for p in shares]
    return sketches.select("start", "component", "n", F.round(F.col("total") / F.col("n"), 6).alias("mean"), F.round("worst", 6).alias("worst"), *points)


def latency_windows(src: DataFrame, width: str = "60 seconds", late: str | None = LATE) -> DataFrame:
    """The report of each window of a stream (ts timestamp, component, value) that the watermark has passed."""
    return report(latency_sketches(src, width, late))


def slow_requests(src: DataFrame, threshold: float = 60.0) -> DataFrame:
    return src.where(F.col("value") > threshold)


def active_keys_stream(src: DataFrame, keys: Callable[[], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Each batch reads the key table anew and flags its rows. A batch that is run again overwrites its own folder."""
    from ..operators.joins import verify_keys

    def step(batch: DataFrame, number: int) -> None:
        verify_keys(batch, keys()).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return src.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_store(spark: SparkSession) -> None:
    """State on the executors' disks with changes in the checkpoint, unless the session says otherwise."""
    if spark.conf.get(STORE, None) is None:
        spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def incremental_encode(src: DataFrame, encoder, sink: str, checkpoint: str) -> StreamingQuery:
    """Encodes new files only, and a docid once, whatever batches and restarts it comes in: the ids seen are state in the checkpoint.

    The first text of an id counts (of several in one batch, any). Rows without an id are told apart by their texts. A batch that is run again overwrites its own folder.
    """
    from ..operators.training import encode_job

    state_store(src.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), F.col("docid").cast("string")), F.sha2(F.coalesce("text", F.lit("")), 256))
    new = src.withColumn("_key", key).dropDuplicates(["_key"]).drop("_key")

    def step(batch: DataFrame, number: int) -> None:
        encode_job(batch, encoder).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return new.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_trace(src: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """The batch form, over a table src (ts, session_key, query, iteration): all sessions, the last ones too.

    (session_key, start, n, original_query, iterations, trace): requests of one key with at most gap between them. trace has their
    queries by iteration (then time, then query), the original query is its first, and iterations is the largest number.
    """
    g = src.groupBy(F.session_window("ts", gap).alias("w"), "session_key")
    out = g.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("iteration", "ts", "query"))).alias("all"))
    return out.select("session_key", F.col("w.start").alias("start"), "n", F.col("all.query")[0].alias("original_query"), F.element_at("all.iteration", -1).alias("iterations"), F.col("all.query").alias("trace"))


def session_stream(src: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """The rows of `session_trace` for a stream: a session is given out when the watermark has passed its end, whatever batches its requests came in.

    The watermark is `late` behind the latest request of earlier batches. A request that comes later than it and a gap is left out; one
    that comes later than it, but not by a gap, still counts: in its session if that is open, else in one of its own.
    """
    state_store(src.sparkSession)
    return session_trace(src.withColumn("iteration", F.col("iteration").cast("long")).withWatermark("ts", late), gap)


def run_append(df: DataFrame, sink: str, checkpoint: str) -> None:
    """Runs df, which has one operator with state at most: so a row is late by the watermark of its own batch and not by that of the one before, which chains of them need."""
    conf = df.sparkSession.conf
    was = conf.get(CHAINS, None)
    conf.set(CHAINS, "false")
    try:
        drain(_append(df, sink, checkpoint))
    finally:
        conf.unset(CHAINS) if was is None else conf.set(CHAINS, was)
