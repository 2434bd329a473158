"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns them less what it rejects.

Edge cases: a null text has no words: the classifier scores it like an empty one, and what it keeps of them are near-duplicates of
each other; null ids and several texts under one id are rows of their own in every stage; of repeated rows near_dedup keeps one;
a tie (equal ids, equal scores, equal spans) is settled as the stage's operator says; an empty table gives none; very long texts are
worked through whole; other columns pass through all stages under their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovex.llm import common, decontaminate, mixing, near_copies, quality, simhash, substring_dedup
from trovex.model import ship

#: Trees, hashes and sampling have no SQL: tests compare the stages, one by one and in a row, with brute-force versions.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash of five-word runs, verified by Jaccard similarity from 0.8 on) the document of least id stays."""
    ship(spark)
    return simhash.keep_one(docs, near_copies.near_duplicates, size=5, similarity=0.8)


def substring_strip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans go from the texts, n_chars follows; a text without any stays as it is, and one that loses all its words goes."""
    ship(spark)
    aside = {c: f"_aside_{c}" for c in ("kept_text", "n_words", "n_removed") if c in docs.columns}
    docs = docs.withColumnsRenamed(aside)
    columns = docs.columns
    out = substring_dedup.strip_repeats(docs, columns=columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("n_chars")))
    return out.select(*columns).withColumnsRenamed({v: k for k, v in aside.items()})


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of sources, languages and topics; adds each document's topic, tokens, weight and probability, under free names."""
    ship(spark)
    drawn = mixing.mix(docs, columns=docs.columns)
    *_, gap, kept = drawn.columns
    return drawn.where(F.col(kept)).drop(kept, gap)


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_strip),
    ("decontamination", benchmark_filter),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written once and reread, as several of them read their input more than once."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.stored(docs)
    return docs
