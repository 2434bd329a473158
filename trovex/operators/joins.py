"""Lookups and joins of rankings with id maps, texts, links, URLs, keys and judgements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .judgements import ByClass, Judgements, listed, marked


def translate_ids(hits: DataFrame, id_map: DataFrame) -> DataFrame:
    """(qid, shard, raw_id, score) -> (qid, docid, score)."""
    return hits.join(id_map, ["shard", "raw_id"]).select("qid", "docid", "score")


def attach_texts(run: DataFrame, corpus: DataFrame) -> DataFrame:
    """Texts of ranked ids; missing ones are empty and keep their rank."""
    return run.select("qid", "rank", "docid").join(corpus.select("docid", "text"), "docid", "left").select("qid", "rank", "docid", F.coalesce("text", F.lit("")).alias("text"))


def attach_outlinks(run: DataFrame, links: DataFrame) -> DataFrame:
    """links: (docid, outlinks array); missing ones are empty."""
    return run.select("qid", "rank", "docid").join(links, "docid", "left").select("qid", "rank", "docid", F.coalesce("outlinks", F.array().cast("array<string>")).alias("outlinks"))


def fetch_by_url(urls: DataFrame, url_map: DataFrame, corpus: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(url, docid, text, found[, outlinks]): a trailing newline of a URL is ignored; unmatched ones have found = false."""
    asked = urls.select(F.regexp_replace("url", r"\n+$", "").alias("url"))
    out = asked.join(url_map, "url", "left").join(corpus.select("docid", "text"), "docid", "left")
    if links is not None:
        out = out.join(links, "docid", "left")
    return out.select("url", "docid", F.coalesce("text", F.lit("")).alias("text"), F.col("docid").isNotNull().alias("found"), *(["outlinks"] if links is not None else []))


def unmatched_urls(urls: DataFrame, url_map: DataFrame) -> DataFrame:
    return urls.select(F.regexp_replace("url", r"\n+$", "").alias("url")).join(url_map, "url", "left_anti")


def tiered_lookup(ids: DataFrame, hot: DataFrame, cold: DataFrame, fallback: bool = False, prefix: str = "clueweb22-en00") -> DataFrame:
    """Ids with the prefix are looked up in the hot tier, others in the cold one; fallback asks the cold tier for what the hot one lacks."""
    h, c = hot.select("docid", F.col("text").alias("hot_text")), cold.select("docid", F.col("text").alias("cold_text"))
    is_hot = F.col("docid").startswith(prefix)
    from_cold = F.when(~is_hot | F.lit(fallback), F.col("cold_text"))
    return ids.join(h, "docid", "left").join(c, "docid", "left").select("docid", F.coalesce(F.when(is_hot, F.col("hot_text")), from_cold).alias("text"))


def batch_get(ids: DataFrame, store: DataFrame) -> DataFrame:
    """(docid, text) of the ids that the store has."""
    return ids.select("docid").join(store.select("docid", "text"), "docid")


def drop_positives(run: DataFrame, qrels: Judgements) -> DataFrame:
    if isinstance(qrels, ByClass):
        return marked(run, qrels, "_rel").where("_rel is null").drop("_rel")
    return run.join(qrels.select("qid", "docid"), ["qid", "docid"], "left_anti")


def rerank_input(run: DataFrame, queries: DataFrame, corpus: DataFrame, depth: int = 1000) -> DataFrame:
    """(qid, query, docid, title, text, score) for the first depth rows of each query; unknown queries and documents go."""
    top = run.where(F.col("rank") <= depth).select("qid", "docid", "score")
    return top.join(queries, "qid").join(corpus, "docid").select("qid", "query", "docid", "title", "text", "score")


def judged_overlap(run: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, n): distinct ids of a query that are in its truth too."""
    both = run.select("qid", "docid").distinct().join(truth.select("qid", "docid").distinct().withColumn("hit", F.lit(1)), ["qid", "docid"], "left")
    return both.groupBy("qid").agg(F.count("hit").alias("n"))


def verify_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    """keys: active (api_key). Adds verify_result; an empty or null key is invalid."""
    active = keys.select("api_key").distinct().withColumn("_ok", F.lit(True))
    out = log.join(active, "api_key", "left")
    return out.select(*log.columns, (F.coalesce("_ok", F.lit(False)) & (F.coalesce("api_key", F.lit("")) != "")).alias("verify_result"))


def train_join(qrels: Judgements, negatives: DataFrame, queries: DataFrame, corpus: DataFrame, of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(qid, query, positives, negatives): texts of judged and of negative documents, each list in the order of its ids and positions.

    of: what is kept of a list of texts, if not the list; positives are attached last, so it is all that moves.
    """
    text = corpus.select("docid", "text")
    neg = negatives.select("qid", "pos", "docid").join(text, "docid").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("n"))
    rows = neg.join(queries, "qid").select("qid", "query", (of or (lambda x: x))(F.col("n.text")).alias("negatives"))
    return listed(rows, qrels, text.withColumnRenamed("text", "value"), "positives", of).select("qid", "query", "positives", "negatives")


def is_relevant(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """results (qid, rank, docid, url, url_hash): rel if any of the three ids is judged. An equi-join on exploded ids, not an OR join."""
    ids = results.select("qid", "rank", F.explode(F.array("docid", "url", "url_hash")).alias("any_id"))
    good = ids.join(qrels.select("qid", F.col("docid").alias("any_id")).distinct(), ["qid", "any_id"], "left_semi").select("qid", "rank").distinct().withColumn("rel", F.lit(True))
    return results.join(good, ["qid", "rank"], "left").select(*results.columns, F.coalesce("rel", F.lit(False)).alias("rel"))


def known_queries_only(run: DataFrame, queries: DataFrame) -> DataFrame:
    return run.join(queries.select("qid").distinct(), "qid", "left_semi")


def resolve_image_ref(refs: DataFrame, corpus: DataFrame) -> DataFrame:
    """docid `row_index` -> that element (from 0) of the row's list. corpus: (row, images array)."""
    parts = refs.select("docid", F.split_part("docid", F.lit("_"), F.lit(1)).cast("long").alias("row"), F.split_part("docid", F.lit("_"), F.lit(2)).cast("int").alias("idx"))
    return parts.join(corpus, "row", "left").select("docid", F.get("images", "idx").alias("image_ref"))


def rerank_cap(results: DataFrame, max_docs: int = 100) -> DataFrame:
    """eligible is false for queries with more results than max_docs: they keep their order."""
    return results.withColumn("eligible", F.count("*").over(Window.partitionBy("qid")) <= max_docs)
