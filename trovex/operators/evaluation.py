"""Rank metrics, answer accuracy, clustering quality, losses, pooling and operational statistics.

A run is (qid, docid, rank); judgements are (qid, docid[, rel]). Means over all queries of a run count those without
judgements as 0, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, floor

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .judgements import ByClass, Judgements, best, marked, sizes
from .layout import dense_index
from .search import dot, nearest_blocks


def judged(run: DataFrame, qrels: Judgements) -> DataFrame:
    """The frame that all measures share: (qid, docid, rank, rel 0/1, n_rel of the query, n_run rows of the query)."""
    own = Window.partitionBy("qid")
    hit = F.col("_rel").isNotNull().cast("int").alias("rel")
    out = marked(run.select("qid", "docid", "rank"), qrels, "_rel").select("qid", "docid", "rank", hit).join(sizes(qrels).withColumnRenamed("n", "n_rel"), "qid", "left")
    return out.select("qid", "docid", "rank", "rel", F.coalesce("n_rel", F.lit(0)).alias("n_rel"), F.count("*").over(own).alias("n_run"))


def _sum(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _ideal(n: Column) -> Column:
    """Sum of the gains of ranks 1..n."""
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, r: s + _gain(r))


def per_query(j: DataFrame, ks: list[int]) -> DataFrame:
    """(qid, k, mrr, precision, recall, map, ndcg) from one judged frame: one window, one grouping for all k."""
    before = F.sum("rel").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = j.withColumn("so_far", before).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    hit = (F.col("rel") == 1) & (F.col("rank") <= F.col("k"))
    g = rows.groupBy("qid", "k").agg(
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        _sum(F.when(hit, 1)).alias("hits"),
        F.first("n_rel").alias("n_rel"),
        F.first("n_run").alias("n_run"),
        _sum(F.when(hit, F.col("so_far") / F.col("rank"))).alias("ap"),
        _sum(F.when(hit, _gain(F.col("rank")))).alias("dcg"),
    )
    some = F.col("n_rel") > 0
    return g.select(
        "qid", "k", F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_run") > 0, F.col("hits") / F.least("k", "n_run")).otherwise(0.0).alias("precision"),
        F.when(some, F.col("hits") / F.col("n_rel")).otherwise(0.0).alias("recall"),
        F.when(some, F.col("ap") / F.col("n_rel")).otherwise(0.0).alias("map"),
        F.when(some, F.col("dcg") / _ideal(F.least("n_rel", "k"))).otherwise(0.0).alias("ndcg"),
    )


def positive(qrels: Judgements) -> Judgements:
    """The judgements with rel > 0."""
    return ByClass(qrels.queries, qrels.docs.where("rel > 0")) if isinstance(qrels, ByClass) else qrels.where("rel > 0")


METRICS = ("mrr", "precision", "recall", "map", "ndcg")


def evaluate_all(run: DataFrame, qrels: Judgements, ks: list[int] = [10, 30, 100]) -> DataFrame:
    q = per_query(judged(run, qrels), ks)
    means = q.groupBy("k").agg(*[F.round(F.avg(m), 6).alias(m) for m in METRICS])
    return means.unpivot("k", list(METRICS), "metric", "value")


def _mean(metric: str):
    def measure(run: DataFrame, qrels: Judgements, k: int) -> DataFrame:
        return per_query(judged(run, qrels), [k]).agg(F.round(F.avg(metric), 6).alias("value"))

    return measure


mrr_at_k, precision_at_k, recall_at_k, map_at_k, ndcg_at_k = map(_mean, METRICS)


def rank_histogram(run: DataFrame, qrels: Judgements, k: int) -> DataFrame:
    """(rank, n): queries whose first hit is at rank 1..k; rank 0: with hits in all; rank -1: without judgements."""
    j = judged(run, qrels)
    first = j.groupBy("qid").agg(F.min(F.when((F.col("rel") == 1) & (F.col("rank") <= k), F.col("rank"))).alias("rank"), F.max("n_rel").alias("n_rel"))
    counts = first.where("rank is not null").groupBy("rank").agg(F.count("*").alias("n"))
    every = run.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    rows = every.join(counts.withColumn("rank", F.col("rank").cast("int")), "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))
    rest = first.agg(F.count("rank").alias("hit"), _sum(F.when(F.col("n_rel") == 0, 1)).alias("none"))
    return rows.unionByName(rest.select(F.inline(F.array(F.struct(F.lit(0).alias("rank"), F.col("hit").alias("n")), F.struct(F.lit(-1).alias("rank"), F.col("none").alias("n"))))))


def anns_recall_at_k(run: DataFrame, truth: DataFrame, k: int, anns_k: int | None = None) -> DataFrame:
    """Mean overlap of run[:k] with truth[:anns_k]; only queries that are in truth count."""
    t = truth.where(F.col("rank") <= (anns_k or k)).select("qid", "docid").distinct()
    got = run.where(F.col("rank") <= k).select("qid", "docid").distinct().withColumn("hit", F.lit(1))
    queries = run.select("qid").distinct()
    per = t.join(got, ["qid", "docid"], "left").join(queries, "qid", "left_semi").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("r"))
    return per.agg(F.round(F.avg("r"), 6).alias("value"))


def eval_mrr(run: DataFrame, qrels: Judgements, cutoff: int | None = None) -> DataFrame:
    """(qid, rr) of queries that are both judged (rel > 0) and ranked; rank by score."""
    good = positive(qrels)
    ranked = run.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid")))
    ranked = ranked if cutoff is None else ranked.where(F.col("r") <= cutoff)
    first = marked(ranked, good, "_rel").groupBy("qid").agg(F.min(F.when(F.col("_rel").isNotNull(), F.col("r"))).alias("r"))
    return first.join(sizes(good).select("qid"), "qid").select("qid", F.round(F.coalesce(1 / F.col("r"), F.lit(0.0)), 6).alias("rr"))


def trec_measures(run: DataFrame, qrels: Judgements, measures: list[str]) -> DataFrame:
    """(qid, measure, value) for recip_rank, map, P_k, recall_k and ndcg_cut_k with graded gain; qid 'all' is the mean over judged queries of the run."""
    q = positive(qrels)
    deepest = max((int(m.rpartition("_")[2]) for m in measures if m.startswith("ndcg_cut_")), default=1)
    n = sizes(q).withColumnRenamed("n", "n_rel").join(best(q, deepest), "qid")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    rows = run.select("qid", "docid", "score").withColumn("rank", F.row_number().over(w))
    rows = marked(rows, q).join(n, "qid")
    rows = rows.withColumn("hit", F.when(F.col("rel") > 0, 1).otherwise(0))
    rows = rows.withColumn("so_far", F.sum("hit").over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    out = {}
    for m in measures:
        name, _, k = m.rpartition("_") if m[-1].isdigit() else (m, "", "1000000")
        inside = (F.col("hit") == 1) & (F.col("rank") <= int(k))
        hits = _sum(F.when(inside, 1))
        if m == "recip_rank":
            out[m] = F.coalesce(1 / F.min(F.when(inside, F.col("rank"))), F.lit(0.0))
        elif m == "map":
            out[m] = _sum(F.when(inside, F.col("so_far") / F.col("rank"))) / F.first("n_rel")
        elif name == "P":
            out[m] = hits / int(k)
        elif name == "recall":
            out[m] = hits / F.first("n_rel")
        elif name == "ndcg_cut":
            ideal = F.aggregate(F.slice(F.first("best"), 1, int(k)), F.struct(F.lit(0.0).alias("s"), F.lit(1).alias("r")), lambda a, x: F.struct((a["s"] + x / F.log2(a["r"] + 1)).alias("s"), (a["r"] + 1).alias("r")), lambda a: a["s"])
            out[m] = _sum(F.when(inside, F.col("rel") / F.log2(F.col("rank") + 1))) / ideal
        else:
            raise ValueError(f"unknown measure {m}")
    per = rows.groupBy("qid").agg(*[F.round(c, 6).alias(m) for m, c in out.items()]).unpivot("qid", list(out), "measure", "value")
    mean = per.groupBy("measure").agg(F.round(F.avg("value"), 5).alias("value")).select(F.lit("all").alias("qid"), "measure", "value")
    return per.unionByName(mean)


def answer_accuracy_at_k(run: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """Share of the run's queries with an answer in their first k texts. hits: (qid, docid, hit)."""
    per = run.where(F.col("rank") <= k).join(hits, ["qid", "docid"], "left").groupBy("qid").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("ok"))
    every = run.select("qid").distinct().join(per, "qid", "left")
    return every.agg(F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("value"))


def shard_distribution(hits: DataFrame) -> DataFrame:
    return hits.groupBy("shard").agg(F.count("*").alias("n"))


PERCENTILES = [i * 5 for i in range(21)]


def latency_stats(timings: DataFrame, exact: bool = True) -> DataFrame:
    """(stat, value): total, avg, min, max and 21 percentiles of the values that aren't null, by linear interpolation.

    Exact ones are read at their ranks from values sorted by range, so no task sees all of them; else approximate ones.
    """
    v = F.col("value")
    timings = timings.where(v.isNotNull())
    fixed = timings.agg(F.sum(v).alias("total"), F.avg(v).alias("avg"), F.min(v).alias("min"), F.max(v).alias("max"), F.count("*").alias("n"), F.percentile_approx(v, [p / 100 for p in PERCENTILES]).alias("p")).first()
    if not exact or not fixed.n:
        points = list(fixed.p or [None] * len(PERCENTILES))
    else:
        at = [p * (fixed.n - 1) / 100 for p in PERCENTILES]
        ranks = sorted({f(x) for x in at for f in (floor, ceil)})
        # equal values are told apart by a number of their own, so a common one doesn't fall to one task
        rows = dense_index(timings.select("value", F.monotonically_increasing_id().alias("_id")), ["value", "_id"])
        found = {r.row: r.value for r in rows.where(F.col("row").isin(ranks)).select("row", "value").collect()}  # two for each percentile at most
        points = [found[floor(x)] + (x - floor(x)) * (found[ceil(x)] - found[floor(x)]) for x in at]
    named = [(s, fixed[s]) for s in ("total", "avg", "min", "max")] + [(f"p{p}", x) for p, x in zip(PERCENTILES, points)]
    out = timings.sparkSession.createDataFrame([(s, None if x is None else float(x)) for s, x in named], "stat string, value double")
    return out.withColumn("value", F.round("value", 6))


def store_stats(lookups: DataFrame) -> DataFrame:
    """lookups: (text or null) per asked id."""
    g = lookups.agg(F.count("*").alias("access"), F.count("text").alias("hit"))
    return g.select("access", "hit", (F.col("access") - F.col("hit")).alias("miss"), F.round(F.when(F.col("access") > 0, F.col("hit") / F.col("access")).otherwise(0.0), 6).alias("hit_rate"))


def unit(c: str) -> Column:
    x = F.transform(c, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(norm > 0, v / norm).otherwise(v))


def silhouette_cosine(vectors: DataFrame) -> DataFrame:
    """vectors: (embedding, label). Cosine distance to a cluster's members follows from its sum of unit vectors: rows x clusters work."""
    v = vectors.select(array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("prediction"))
    value = ClusteringEvaluator(distanceMeasure="cosine").evaluate(v)
    return vectors.sparkSession.createDataFrame([(round(value, 6),)], "value double")


def kmeans_spherical(vectors: DataFrame, k: int, iters: int = 20, seed: int = 7) -> DataFrame:
    """(docid, cluster) by cosine k-means."""
    v = vectors.select("docid", array_to_vector("embedding").alias("features"))
    model = KMeans(k=k, maxIter=iters, seed=seed, distanceMeasure="cosine").fit(v)
    return model.transform(v).select("docid", F.col("prediction").alias("cluster"))


def cluster_members(assigned: DataFrame, block: int = 10_000) -> DataFrame:
    """(cluster, block, n, members): each cluster's docids, in blocks, as one may be as long as the table."""
    sizes = assigned.groupBy("cluster").agg(F.count("*").alias("_n"))
    cut = assigned.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("docid"), F.ceil(F.col("_n") / block)).cast("int"))
    return cut.groupBy("cluster", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("docid")).alias("members"))


def lloyd_spherical(vectors: DataFrame, centroids: DataFrame, iters: int = 20) -> DataFrame:
    """(docid, cluster) after iters rounds of cosine k-means from given centroids (cluster, centroid): each round takes the mean directions of the vectors nearest to each.

    A cluster without vectors goes. Only the centroids come to the driver.
    """
    found = assign_nearest(vectors, centroids)
    kind = dict(centroids.dtypes)["cluster"]
    for _ in range(iters):
        means = mean_direction(vectors.join(found.withColumnRenamed("cluster", "_at"), "docid"), "_at")
        rows = means.groupBy("_at").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("all")).select(F.col("_at").alias("cluster"), F.col("all.value").alias("centroid"))
        sent = vectors.sparkSession.createDataFrame(rows.collect(), f"cluster {kind}, centroid array<double>")
        found = assign_nearest(vectors, sent)
    return found


def assign_nearest(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(docid, cluster): each vector's centroid of largest inner product, ties to the lesser cluster. centroids: (cluster, centroid).

    Vectors stay where they are; centroids are sent to them in blocks of MATRIX_BYTES at most, and blocks meet by docid.
    """
    parts = [p.withColumnRenamed("qid", "cluster") for p in nearest_blocks(vectors, centroids.select(F.col("cluster").alias("qid"), F.col("centroid").alias("embedding")))]
    kind = dict(centroids.dtypes)["cluster"]
    if len(parts) == 1:
        return parts[0].select("docid", F.col("cluster").cast(kind).alias("cluster"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = F.max_by("cluster", F.struct("score", -F.col("cluster")))
    return every.groupBy("docid").agg(best.cast(kind).alias("cluster"))


def select_k(vectors: DataFrame, ks: list[int], seed: int = 7, clusters: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """(k, score, best, band): cosine silhouette for each k; k <= 1 or k >= n scores -1, and so does a single cluster; the first maximum is best.

    clusters: from (docid, embedding) and k to (docid, cluster); k-means unless given.
    """
    v = vectors.select("docid", "embedding").cache()
    n, rows = v.count(), []
    for k in ks:
        score = -1.0
        if 1 < k < n:
            out = v.join((clusters or (lambda x, k: kmeans_spherical(x, k, seed=seed)))(v, k), "docid").select("embedding", F.col("cluster").alias("label")).cache()
            if out.select("label").distinct().limit(2).count() > 1:
                score = silhouette_cosine(out).first().value
            out.unpersist()
        rows.append((k, float(score)))
    v.unpersist()
    best = max(rows, key=lambda r: r[1])[0]
    df = vectors.sparkSession.createDataFrame([(k, s, k == best) for k, s in rows], "k int, score double, best boolean")
    s = F.col("score")
    return df.withColumn("band", F.when(s > 0.75, "strong").when(s > 0.5, "reasonable").when(s > 0.25, "weak").when(s > 0, "slight").otherwise("none"))


def contrastive_scores(pairs: DataFrame, temperature: float) -> DataFrame:
    """pairs: (qid, score, is_target), all passages of the batch for each query. Cross-entropy of the target."""
    z = F.col("score") / temperature
    top = pairs.groupBy("qid").agg(F.max(z).alias("top"))
    g = pairs.join(top, "qid").groupBy("qid").agg(F.sum(F.exp(z - F.col("top"))).alias("s"), F.max("top").alias("top"), F.max(F.when(F.col("is_target"), z)).alias("t"))
    return g.select("qid", F.round(F.log("s") + F.col("top") - F.col("t"), 5).alias("loss"))


def cached_negative_scores(pairs: DataFrame, pool: DataFrame, temperature: float) -> DataFrame:
    """The same with a pool of further negatives (qid, score) in every denominator; the target stays the query's own positive."""
    return contrastive_scores(pairs.unionByName(pool.select("qid", "score", F.lit(False).alias("is_target"))), temperature)


def group_cross_entropy(pair_scores: DataFrame) -> DataFrame:
    """pair_scores: (qid, pos, score); the first of a group is its positive."""
    return contrastive_scores(pair_scores.select("qid", "score", (F.col("pos") == 0).alias("is_target")), 1.0)


def mean_direction(vectors: DataFrame, group: str) -> DataFrame:
    """(group, pos, value): the mean of unit vectors, of length 1 again, one row for each position."""
    each = vectors.select(group, F.posexplode(unit("embedding")).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(group)))
    return each.select(group, "pos", F.round(F.when(norm > 0, F.col("m") / norm).otherwise(F.col("m")), 6).alias("value"))


def pool_vectors(tokens: DataFrame, mode: str, normalize: bool = True) -> DataFrame:
    """tokens: (docid, pos, embedding, mask). (docid, dim, value) by first, last, mean or weighted_mean (weight: position from 1)."""
    live = tokens.where("mask = 1")
    if mode in ("first", "last"):
        pick = F.min_by if mode == "first" else F.max_by
        v = live.groupBy("docid").agg(pick("embedding", "pos").alias("e")).select("docid", F.posexplode("e").alias("dim", "x")).select("docid", "dim", F.col("x").cast("double").alias("m"))
    else:
        weight = F.lit(1.0) if mode == "mean" else (F.col("pos") + 1).cast("double")
        each = live.select("docid", weight.alias("w"), F.posexplode("embedding").alias("dim", "x"))
        v = each.groupBy("docid", "dim").agg((F.sum(F.col("w") * F.col("x").cast("double")) / F.sum("w")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("docid"))) if normalize else F.lit(1.0)
    return v.select("docid", "dim", F.round(F.when(norm > 0, F.col("m") / norm).otherwise(F.col("m")), 6).alias("value"))


def pool_sparse_max(logits: DataFrame) -> DataFrame:
    """logits: (docid, pos, term, x, mask) -> (docid, term, weight): the largest log(1 + relu(x)) over positions."""
    w = F.log1p(F.greatest(F.col("x"), F.lit(0.0))) * F.col("mask")
    return logits.groupBy("docid", "term").agg(F.round(F.max(w), 6).alias("weight"))


def pool_token_max(weights: DataFrame, disabled: list[int] = [0, 101, 102, 103]) -> DataFrame:
    """weights: (docid, token, weight) -> the largest weight of each token; special tokens weigh nothing and go."""
    return weights.where(~F.col("token").isin(disabled)).groupBy("docid", "token").agg(F.max("weight").alias("weight"))


def quantize_impacts(weights: DataFrame, mode: str = "rint", placeholder: str = "[NONE]") -> DataFrame:
    """weights: (docid, token, weight) -> hundredths as ints. rint: half to even, positive ones kept, a placeholder for documents left empty; ceil: rounded up."""
    x = F.col("weight") * 100
    if mode == "ceil":
        return weights.select("docid", "token", F.ceil(x).cast("int").alias("weight"))
    # one read of the weights: a document without positive ones keeps its first row, as the placeholder
    own = Window.partitionBy("docid")
    rows = weights.select("docid", "token", F.rint(x).cast("int").alias("weight"))
    rows = rows.withColumn("_most", F.coalesce(F.max("weight").over(own), F.lit(0))).withColumn("_r", F.row_number().over(own.orderBy("token")))
    kept = rows.where("weight > 0 or (_most <= 0 and _r = 1)")
    some = F.col("_most") > 0
    return kept.select("docid", F.when(some, F.col("token")).otherwise(placeholder).alias("token"), F.when(some, F.col("weight")).otherwise(1).alias("weight"))
