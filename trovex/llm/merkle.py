"""Merkle dataset manifest with incremental witnesses (operator 11).

A leaf is the SHA-256 of a row's fields. Leaves get their place within a group by a range sort and the counts of its parts, so
a group that holds a third of all rows is spread over many tasks. Aligned blocks of 2^BITS places are then appended as streams:
a task keeps the roots of open subtrees, each with the partial witnesses of what lies below; a node that completes its left
sibling's subtree extends the witnesses of both sides by the other's root. A block's root is a further append: the roots of a
group's blocks are the nodes of the next round, until each group has one root, and the groups' roots are appended the same way
to one tree. A witness is put together from the rounds by joins on the block, from the top down.

Where several nodes of a run remain, two consecutive ones become their digest, and a last one alone becomes its own; a single
node is the root as it is. A witness is the list of steps from a node to the root: the sibling's digest (null for a node that is
alone) and whether the sibling stands on the left. `folded` recomputes a root from a node and its witness.

Edge cases: a null field is `-`; an empty text is `0:`; a null doc_id comes before all others and is never tampered with; rows of
one doc_id are ordered by their leaves, so repeated rows have equal leaves and one witness each; a null language is a group of its
own, before all others; very long texts are hashed whole; an empty table gives no rows; other columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

BITS = 10  #: a block has 2^BITS places
WITNESS = "array<struct<left:boolean,sibling:string>>"
STEP = pa.list_(pa.struct([("left", pa.bool_()), ("sibling", pa.string())]))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def places(nodes: DataFrame, *order: str | Column) -> DataFrame:
    """nodes (group, ..) with `pos` 0, 1, .. in their group by `order`, and `n`, the group's size.

    Tasks number the rows of their range, part by part; a range's first place in a group follows from the counts of those before it.
    """
    rows, row = numbered(nodes)
    name = ["_part", "group", *[c for c in rows.columns if c != "group"]]
    ranged = rows.repartitionByRange("group", *order, row).sortWithinPartitions("group", *order, row).withColumn("_part", F.spark_partition_id()).select(*name)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, 0
        for b in batches:
            own = []
            for g in b.column(1).to_pylist():
                at = at + 1 if g == last else 0
                last = g
                own.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], [*name, "pos"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)
    parts = stored(ranged.mapInArrow(number, f"{kinds}, pos long"))
    counts = parts.groupBy("group", "_part").agg(F.count("*").alias("_own"))
    w = Window.partitionBy("group")  # a row for each range that has rows of the group
    before = counts.select("group", "_part", F.coalesce(F.sum("_own").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_own").over(w).alias("n"))
    return parts.join(before, ["group", "_part"]).withColumn("pos", F.col("pos") + F.col("_before")).drop("_before", "_part", row)


class Appender:
    """A tree that grows by appends: roots of open subtrees, from the left, each with the witnesses of the nodes below it."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, list[list[tuple]]]] = []

    def append(self, node: str) -> None:
        self.open.append((0, node, [[]]))
        while len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
            self._join()

    def _join(self) -> None:
        (height, left, own), (_, right, others) = self.open[-2:]
        for witness in own:
            witness.append((False, right))
        for witness in others:
            witness.append((True, left))
        self.open[-2:] = [(height + 1, sha256((left + right).encode()).hexdigest(), own + others)]

    def close(self, height: int) -> tuple[str, list[list[tuple]]]:
        """The root at a height, as nothing follows: what stays open on the right goes up alone."""
        while len(self.open) > 1 or self.open[0][0] < height:
            if len(self.open) > 1 and self.open[-2][0] == self.open[-1][0]:
                self._join()
                continue
            at, node, own = self.open.pop()
            for witness in own:
                witness.append((False, None))
            self.open.append((at + 1, sha256(node.encode()).hexdigest(), own))
        return self.open[0][1:]


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes (group, pos, n, node, ..) and block, witness (within the block), top: the block's root, on its first row."""
    rows = nodes.withColumn("block", F.shiftright("pos", bits))
    rows = rows.repartition("group", "block").sortWithinPartitions("group", "block", "pos")
    name = rows.columns
    at = {c: name.index(c) for c in ("group", "block", "n", "node")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the block that is open
        key, size, tree = None, 0, Appender()

        def finish() -> pa.RecordBatch:
            height = bits if size > 1 << bits else max(size - 1, 0).bit_length()
            root, witnesses = tree.close(height)
            table = pa.Table.from_batches(held).combine_chunks()
            steps = pa.array([[{"left": a, "sibling": s} for a, s in w] for w in witnesses], STEP)
            tops = pa.array([root] + [None] * (len(witnesses) - 1), pa.string())
            return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in table.columns], steps, tops], [*name, "witness", "top"])

        for b in batches:
            groups, blocks, nodes, n = (b.column(at[c]).to_pylist() for c in ("group", "block", "node", "n"))
            lo = 0
            for i, now in enumerate(zip(groups, blocks)):
                if now != key:
                    if i > lo:
                        held.append(b.slice(lo, i - lo))
                    if key is not None:
                        yield finish()
                    held, tree, key, size, lo = [], Appender(), now, n[i], i
                tree.append(nodes[i])
            if b.num_rows > lo:
                held.append(b.slice(lo))
        if key is not None:
            yield finish()

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, witness {WITNESS}, top string")


def grow(nodes: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """nodes (group, pos, n, node, ..) with `steps`, the witness of each up to its group's root; and the roots (group, root)."""
    rounds = []
    rows = nodes
    while True:
        level = stored(_blocks(rows, bits))
        rounds.append(level)
        rows = level.where("top is not null").select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << bits)).cast("long").alias("n"), F.col("top").alias("node"))
        if not rows.where("n > 1").head(1):
            break
    roots = rows.select("group", F.col("node").alias("root"))
    steps = None
    for level in reversed(rounds):
        if steps is None:
            out = level.withColumn("steps", F.col("witness"))
        else:
            upper = steps.select("group", F.col("pos").alias("block"), F.col("steps").alias("_upper"))
            out = level.join(upper, ["group", "block"]).withColumn("steps", F.concat("witness", "_upper")).drop("_upper")
        steps = out.drop("witness", "top", "block", "n")
    return steps, roots


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def folded(node: str, steps: str) -> Column:
    """The root that a node and its witness give."""
    both = lambda s, up: F.when(s["sibling"].isNull(), up).when(s["left"], F.concat(s["sibling"], up)).otherwise(F.concat(up, s["sibling"]))
    return F.aggregate(steps, F.col(node), lambda up, s: digest(both(s, up)))


def manifest(leaves: DataFrame, group: Column, *order: str, bits: int = BITS) -> DataFrame:
    """leaves (leaf string, ..) with subroot (its group's root), root (of all groups' roots, in the order of group, null first) and steps (up to root)."""
    keyed = leaves.withColumn("node", F.col("leaf")).withColumn("group", F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")))
    steps, roots = grow(places(keyed, *order), bits)
    roots = stored(roots)
    tops = places(roots.select(F.lit("").alias("group"), F.col("group").alias("of"), F.col("root").alias("node")), "of")
    upper, root = grow(tops, bits)
    upper = upper.join(root, "group").select(F.col("of").alias("group"), F.col("node").alias("subroot"), F.col("steps").alias("_top"), "root")
    return steps.join(upper, "group").withColumn("steps", F.concat("steps", "_top")).drop("_top", "group", "node", "pos")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = [F.col("n_chars") + 1 if i == 3 else c for i, c in enumerate(columns)]
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    leaves = d.select("doc_id", "lang", leaf(*columns).alias("leaf"), F.when(chosen, leaf(*tampered)).alias("changed"))
    out = manifest(leaves, F.col("lang"), "doc_id", "leaf").withColumn("shown", F.coalesce("changed", "leaf"))
    proof = digest(F.array_join(F.transform(F.filter("steps", lambda s: s["sibling"].isNotNull()), lambda s: s["sibling"]), ""))
    out = out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded("shown", "steps").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
