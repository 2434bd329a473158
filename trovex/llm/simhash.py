"""SimHash near-duplicates by multi-index hashing (operator 10).

A 64-bit fingerprint is cut into two halves. Two fingerprints within 2 bits either agree in one half, or differ by
exactly one bit in each. So the index of a half is probed with the half itself, and the first half's index with its
ball of radius 1 too; fetched matches are verified on all 64 bits. Buckets with few members are verified pair by
pair. In larger ones (near copies by the thousand, which share a half) each member enumerates its ball in the other
half instead, and meets the others on the whole key, so work stays linear in the members and no link is lost.

Edge cases: null and empty texts have no words and fingerprint 0; repeated rows share a class; a null doc_id takes
part, but never names a class unless all its members are null; a bit set in exactly half of the hashes is 0; very long texts are
hashed whole, in runs; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, numbered, raw

SMALL = 64  #: members of a bucket that are compared pair by pair


def fingerprint(text: bytes, size: int = 3) -> bytes:
    """The fingerprint's 8 bytes, most significant first."""
    w = text.lower().split()
    if not w:
        return bytes(8)
    size = min(size, len(w))
    digest, join = xxhash.xxh64_digest, b" ".join
    votes, n = np.zeros(64, np.int64), len(w) - size + 1
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        joined = b"".join([digest(join(t), 42) for t in zip(*(w[lo + i : hi + i] for i in range(size)))])
        votes += np.unpackbits(np.frombuffer(joined, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > n).tobytes()


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = b"".join(fingerprint(raw(t), size) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(prints, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _half(fp: Column, seg: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if seg == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def _bits(n: int) -> Column:
    return F.array(*[F.lit(1 << i).cast("long") for i in range(n)])


def links(fps: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b) with a < b: enough pairs within 2 bits to connect all that are reachable. fps: distinct (fp)."""
    fps = fps.select("fp")
    parts, large_hi = [], None
    for seg in (0, 1):
        halves = fps.select("fp", _half(F.col("fp"), seg).alias("half"))
        sizes = halves.groupBy("half").agg(F.count("*").alias("n"))
        shared = halves.join(sizes.where("n > 1"), "half")
        few = shared.where(F.col("n") <= small)
        parts.append(
            few.select("half", F.col("fp").alias("a")).join(few.select("half", F.col("fp").alias("b")), "half").where((F.col("a") < F.col("b")) & _near("a", "b")).select("a", "b")
        )
        # members of a large bucket meet on the key with up to two bits of the other half cleared: all of them are within 2 bits
        shift = 0 if seg == 0 else 32
        masks = F.array(*[F.lit(((1 << i | 1 << j) << shift) - (1 << 64 if ((1 << i | 1 << j) << shift) >> 63 else 0)).cast("long") for i in range(32) for j in range(i)])
        many = shared.where(F.col("n") > small).select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("key"))
        least = many.groupBy("mask", "key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mask", "key", "a")
        parts.append(many.join(least, ["mask", "key"]).where("a < fp").select("a", F.col("fp").alias("b")).distinct())
        if seg == 0:
            large_hi = sizes.where(F.col("n") > small).select("half")
    index = fps.select(F.col("fp").alias("b"), _half(F.col("fp"), 0).alias("half"))
    # one bit differs in the first half: the side where that bit is set looks up the other
    probes = (
        fps.select("fp", _half(F.col("fp"), 0).alias("hi"))
        .select("fp", "hi", F.explode(_bits(32)).alias("bit"))
        .where(F.col("hi").bitwiseAND(F.col("bit")) != 0)
        .select(F.col("fp").alias("a"), F.col("hi").bitwiseXOR(F.col("bit")).alias("half"))
    )
    parts.append(index.join(large_hi, "half", "left_anti").join(probes, "half").where(_near("a", "b")).select("a", "b"))
    ball = probes.join(large_hi, "half", "left_semi").select("a", F.shiftleft("half", 32).bitwiseOR(_half(F.col("a"), 1)).alias("key"), F.explode(_bits(32)).alias("bit"))
    parts.append(ball.select("a", F.col("key").bitwiseXOR(F.col("bit")).alias("fp")).join(fps, "fp").select("a", F.col("fp").alias("b")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) with root the least node reachable: alternating large and small stars, checkpointed each round.

    edges: (a, b) longs, a != b. A round's joins and minima are pre-aggregated, so a hub is no single task's burden.
    """
    edges = checkpoint(edges.select("a", "b"))
    was = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b")
        # each (a, b) has a < b: b keeps its least neighbour and passes it on to the rest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b").distinct()
        edges = checkpoint(small)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")


def near_duplicates(docs: DataFrame, size: int = 3, small: int = SMALL) -> DataFrame:
    """(doc_id, fp long, component_id) for each row of docs (doc_id, text)."""
    prints = checkpoint(fingerprints(docs, size))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(nodes, small))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.where("root != fp").groupBy("root").agg(F.min("rep").alias("least"))
    reps = nodes.select(F.col("fp").alias("root"), F.col("rep").alias("root_rep"))
    classes = named.join(least, "root", "left").join(reps, "root").select("fp", F.least("least", "root_rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, method=near_duplicates, **how) -> DataFrame:
    """One row of each class, the one of least doc_id, with its columns as they were; null ids come last.

    method gives (doc_id, component_id), here or in near_copies. Classes are of rows, so neither rows without an id nor different texts under one id stand for each other.
    """
    rows, row = numbered(docs)
    found = method(rows.select(F.col(row).alias("doc_id"), "text"), **how).select(F.col("doc_id").alias("_of"), "component_id")
    named = found.join(rows.select(F.col(row).alias("_of"), F.col("doc_id").alias("_id")), "_of")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_of")).alias("first")).select(F.col("first._of").alias("_kept"))
    return rows.join(kept, rows[row] == kept["_kept"], "left_semi").drop(row)


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
