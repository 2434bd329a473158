"""Ranks in file order, shards, splits and seeded rotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import drop_positives
from .judgements import Judgements
from .projections import hashed


def dense_index(df: DataFrame, key: str | list[str], name: str = "row") -> DataFrame:
    """0, 1, .. in the order of key (a column or several), without one task for all rows: sorted by range, counted by partition, offset by the counts."""
    from ..model import stored

    key = [key] if isinstance(key, str) else key
    # the id has the task in its upper bits and the place in its sorted rows in the lower 33
    parts = stored(df.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", F.monotonically_increasing_id()), "index")
    parts = parts.withColumn("_part", F.shiftright("_at", 33))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each partition
    return parts.join(F.broadcast(before), "_part").withColumn(name, (place + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_before", "_at")


def rank_in_file_order(run: DataFrame) -> DataFrame:
    return run.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")))


def contiguous_shards(df: DataFrame, n: int, key: str = "docid") -> DataFrame:
    """shard = row // (rows // n), the last takes the rest."""
    total = max(df.count() // n, 1)
    return dense_index(df, key).withColumn("shard", F.least(F.floor(F.col("row") / total), F.lit(n - 1)).cast("int")).drop("row")


def ceil_splits(df: DataFrame, n: int, key: str = "docid") -> DataFrame:
    size = max(-(-df.count() // n), 1)
    return dense_index(df, key).withColumn("split", F.floor(F.col("row") / size).cast("int")).drop("row")


def hash_shards(df: DataFrame, n: int, key: str = "docid") -> DataFrame:
    """A stable shard from md5 of the id."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")
    return df.withColumn("shard", F.pmod(h, F.lit(n)).cast("int"))


def rotate_positive(groups: DataFrame, epoch: int, seed: int) -> DataFrame:
    """groups: (row, positives): positive number (row + seed + epoch) mod size."""
    at = F.pmod(F.col("row") + seed + epoch, F.size("positives")).cast("int")
    return groups.withColumn("positive", F.when(F.size("positives") > 0, F.get("positives", at)))


def shuffled(items: str, seed: int, key: str):
    """The array in the order of md5(seed, key, item)."""
    pairs = F.transform(items, lambda x: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), x.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(pairs), lambda s: s["x"])


def rotate_negatives(groups: DataFrame, epoch: int, size: int, seed: int, key: str = "qid") -> DataFrame:
    """size negatives from the seeded order, doubled, from epoch * size mod n on; with fewer than size, drawn with replacement; none for size 0."""
    if size == 0:
        return groups.withColumn("chosen", F.slice("negatives", 1, 0))
    n = F.size("negatives")
    mixed = groups.withColumn("_m", shuffled("negatives", seed, key))
    draw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get("_m", F.floor(hashed(str(seed), F.col(key).cast("string"), F.lit(str(epoch)), i.cast("string")) * n).cast("int")))
    cut = F.slice(F.concat("_m", "_m"), F.pmod(F.lit(epoch * size), F.greatest(n, F.lit(1))).cast("int") + 1, size)
    return mixed.withColumn("chosen", F.when(n == 0, F.slice("negatives", 1, 0)).when(n < size, draw).otherwise(cut)).drop("_m")


def sample_negatives(cands: DataFrame, qrels: Judgements, n: int = 30, depth: int = 200, order: str = "filter_first", seed: int = 1) -> DataFrame:
    """(qid, docid): n of the first depth candidates in md5 order, positives removed before or after the cut."""
    w = Window.partitionBy("qid")
    if order == "filter_first":
        rows = drop_positives(cands, qrels)
        rows = rows.withColumn("_r", F.row_number().over(w.orderBy("rank"))).where(F.col("_r") <= depth)
    else:
        rows = drop_positives(cands.where(F.col("rank") <= depth), qrels)
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), "qid", "docid"))
    return rows.withColumn("_d", F.row_number().over(w.orderBy(draw, "docid"))).where(F.col("_d") <= n).select("qid", "docid")
