"""Queries of search, merging, ranking, clusters and sparse retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import stored
from ..operators import evaluation as E
from ..operators import ann, inverted, layout, search
from ..operators.filters import prune_shards
from . import fixtures as fx
from .registry import query

RUN10 = " SELECT qid, docid, rank::BIGINT AS rank, score FROM allrun WHERE rank <= 10"


def _out(df):
    return df.select("qid", "docid", F.col("rank").cast("long").alias("rank"), "score")


@query(fx.sql("allrun", RUN10))
def sim1_knn_exact(spark, sf):
    return _out(search.knn_exact(fx.queries(spark, sf), fx.vectors(spark, sf), 10, exclude_self=True))


@query(fx.sql("allrun", RUN10))
def sim2_knn_blocked(spark, sf):
    return _out(search.knn_blocked(fx.queries(spark, sf), fx.vectors(spark, sf), 10, exclude_self=True))


@query(fx.sql("pairs", ", r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM pairs WHERE shard IN (0, 2)) SELECT qid, docid, rank::BIGINT AS rank, score FROM r WHERE rank <= 10"))
def sim3_knn_sharded(spark, sf):
    return _out(search.knn_sharded(fx.queries(spark, sf), fx.vectors(spark, sf), 10, [0, 2], exclude_self=True))


@query(fx.sql("allrun", RUN10))
def sim4_merge_runs(spark, sf):
    each = stored(search.ground_truth(fx.queries(spark, sf), fx.vectors(spark, sf), 10, per_shard=True, exclude_self=True))
    runs = [each.where(F.col("shard") == n) for n in range(4)]
    return _out(search.merge_runs(runs, 10))


@query(fx.sql("pairs", ", r AS (SELECT *, row_number() OVER (PARTITION BY qid, shard ORDER BY score DESC, docid) AS rank FROM pairs) SELECT qid, docid, shard, rank::BIGINT AS rank, score FROM r WHERE rank <= 20"))
def sim5_ground_truth(spark, sf):
    g = search.ground_truth(fx.queries(spark, sf), fx.vectors(spark, sf), 20, per_shard=True, exclude_self=True)
    return g.select("qid", "docid", "shard", F.col("rank").cast("long").alias("rank"), "score")


def _checked(spark, sf, found, share):
    """(qid, n, exact, recalled, pruned): rows found, whether all their scores are the vectors' own, whether 0.9 of all queries' exact best ten are among them, and whether the share of work done is within its bound."""
    q = fx.queries(spark, sf).select("qid", F.col("embedding").alias("qe"))
    both = found.join(q, "qid").join(fx.vectors(spark, sf).select("docid", F.col("embedding").alias("pe")), "docid")
    truth = fx.run(spark, sf).where("rank <= 10").select("qid", "docid", F.lit(1).alias("hit"))
    per = stored(both.join(truth, ["qid", "docid"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.bool_and(F.col("score") == F.round(search.dot("qe", "pe"), 6)).alias("exact"), F.count("hit").alias("hits")))
    hits, queries = per.agg(F.sum("hits"), F.count("*")).first()
    return per.select("qid", "n", "exact", F.lit((hits or 0) >= 0.9 * 10 * queries).alias("recalled"), F.lit(share).alias("pruned"))


PROP = fx.sql("vq", " SELECT qid, 10::BIGINT AS n, true AS exact, true AS recalled, true AS pruned FROM vq")


@query(PROP)
def sim6_knn_ivf(spark, sf):
    """A quarter of the cells is probed."""
    q, p = fx.queries(spark, sf), fx.vectors(spark, sf)
    index = ann.ivf_index(p)
    return _checked(spark, sf, ann.knn_ivf(q, p, 10, index, nprobe=len(index.centres) // 4, exclude_self=True), True)


@query(PROP)
def sim7_knn_approx(spark, sf):
    """At most 0.28 of all pairs of a query and a row are scored."""
    q, p = fx.queries(spark, sf), fx.vectors(spark, sf)
    index = ann.hash_tables(p)
    budget = int(0.28 * index.rows)
    made = ann.chosen(q, index, budget, exclude_self=True)
    return _checked(spark, sf, ann.best_chosen(made, 10), (made.rows.agg(F.sum("found")).first()[0] or 0) < 0.3 * index.rows * q.count())


SPARSE = fx.sql("weights", ", qw AS (SELECT 'q' || substring(docid, 2) AS qid, token, weight FROM weights WHERE substring(docid, 2)::BIGINT % 50 = 0), s AS (SELECT qid, docid, round(sum(q.weight * d.weight), 6) AS score FROM qw q JOIN weights d USING (token) GROUP BY qid, docid), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM s) SELECT qid, docid, rank::BIGINT AS rank, round(score, 3) AS score FROM r WHERE rank <= 20")


@query(SPARSE)
def sim8_sparse_retrieve(spark, sf):
    dw = stored(fx.packed_weights(spark, sf))
    qw = dw.where("cast(substring(docid, 2) as bigint) % 50 = 0").select(F.expr("concat('q', substring(docid, 2))").alias("qid"), F.explode(F.arrays_zip("tokens", "weights")).alias("_p"))
    qw = qw.select("qid", F.col("_p.tokens").alias("token"), F.col("_p.weights").alias("weight"))
    return inverted.sparse_retrieve(qw, dw, 20).select("qid", "docid", F.col("rank").cast("long").alias("rank"), F.round("score", 3).alias("score"))


@query(fx.sql("run", " SELECT qid, docid, rank::BIGINT AS old_rank, row_number() OVER (PARTITION BY qid ORDER BY md5(qid || docid) DESC, docid) AS new_rank FROM run"))
def sim9_rerank(spark, sf):
    r = search.rerank(fx.run(spark, sf), F.md5(F.concat("qid", "docid")))
    return r.select("qid", "docid", F.col("old_rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"))


@query(fx.sql("run corpus query_texts", ", s AS (SELECT qid, docid, rank, len(list_intersect(list_distinct(regexp_extract_all(query, '\\S+')), list_distinct(regexp_extract_all(text, '\\S+')))) AS s FROM run JOIN corpus USING (docid) JOIN query_texts USING (qid)) SELECT qid, docid, rank::BIGINT AS old_rank, row_number() OVER (PARTITION BY qid ORDER BY s DESC, docid) AS new_rank FROM s"))
def sim9b_rerank_texts(spark, sf):
    """Pairs of texts through a scorer in batches."""
    texts = fx.run(spark, sf).join(fx.corpus(spark, sf).select("docid", "text"), "docid").join(fx.query_texts(spark, sf), "qid")
    r = search.rerank(texts, lambda df: search.score_pairs(df, search.overlap_scorer))
    return r.select("qid", "docid", F.col("old_rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"))


@query(fx.sql("run", ", r AS (SELECT qid, docid, round(score, 1) AS score FROM run) SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM r"))
def sim10_rank_by_score(spark, sf):
    r = search.rank_by_score(fx.run(spark, sf).select("qid", "docid", F.round("score", 1).alias("score")))
    return r.select("qid", "docid", "score", F.col("rank").cast("long").alias("rank"))


@query(fx.sql("allrun", " SELECT qid, docid, rank::BIGINT AS rank, score FROM allrun WHERE rank <= 5"))
def sim11_depth_cut(spark, sf):
    return _out(search.depth_cut(fx.run(spark, sf), 5))


@query(fx.sql("pairs", " SELECT qid, count(*) AS n, round(sum(score), 3) AS total, max(score) AS best FROM pairs GROUP BY qid"))
def jn9_all_pairs_scores(spark, sf):
    p = search.all_pairs_scores(fx.queries(spark, sf), fx.vectors(spark, sf)).where("substring(qid, 2) <> substring(docid, 2)")
    return p.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"), F.max("score").alias("best"))


@query(fx.sql("vp", " SELECT docid, shard FROM vp WHERE shard IN (1, 3)"))
def flt5_prune_shards(spark, sf):
    return prune_shards(fx.vectors(spark, sf), "3,1,3", 4).select("docid", "shard")


# shards and splits


@query(fx.sql("corpus", ", r AS (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS row, count(*) OVER () AS n FROM corpus) SELECT docid, least(row // (n // 7), 6)::INT AS shard FROM r"))
def win2_contiguous_shards(spark, sf):
    return layout.contiguous_shards(fx.corpus(spark, sf).select("docid"), 7)


@query(fx.sql("corpus", ", r AS (SELECT docid, row_number() OVER (ORDER BY docid) - 1 AS row, count(*) OVER () AS n FROM corpus) SELECT docid, (row // ((n + 6) // 7))::INT AS split FROM r"))
def win3_ceil_splits(spark, sf):
    return layout.ceil_splits(fx.corpus(spark, sf).select("docid"), 7)


@query(fx.sql("corpus", " SELECT docid, (('0x' || substring(md5(docid), 1, 8))::BIGINT % 8)::INT AS shard FROM corpus"))
def win4_hash_shards(spark, sf):
    return layout.hash_shards(fx.corpus(spark, sf).select("docid"), 8)


# vectors


@query(fx.sql("vp", ", u AS (SELECT docid, label, list_transform(embedding, x -> x / sqrt(list_inner_product(embedding, embedding))) AS e FROM vp), s AS (SELECT label, i, sum(e[i]) AS s, count(*) AS n FROM u, range(1, 65) t(i) GROUP BY label, i), c AS (SELECT label, list(s ORDER BY i) AS s, any_value(n) AS n FROM s GROUP BY label), d AS (SELECT u.docid, u.label AS own, c.label, c.n, CASE WHEN u.label = c.label THEN (c.n - list_inner_product(u.e, c.s)) / greatest(c.n - 1, 1) ELSE 1 - list_inner_product(u.e, c.s) / c.n END AS d FROM u, c), ab AS (SELECT docid, min(d) FILTER (own = label) AS a, min(d) FILTER (own <> label) AS b, max(n) FILTER (own = label) AS n FROM d GROUP BY docid) SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS value FROM ab"))
def ev15_silhouette_cosine(spark, sf):
    return E.silhouette_cosine(fx.vectors(spark, sf))


def _lloyd_sql(ks: str, rounds: int) -> str:
    """CTEs u (unit vectors) and a0, a1, ..: (k, docid, cluster) before the first round and after each, from the vectors of ids below k."""
    near = "a{n} AS (SELECT k, docid, cluster FROM (SELECT k, docid, cluster, row_number() OVER (PARTITION BY k, docid ORDER BY round(list_inner_product(embedding, c), 6) DESC, cluster) AS r FROM vp, c{n}) WHERE r = 1)"
    mean = "c{n} AS (SELECT k, cluster, list(round(m / norm, 6) ORDER BY i) AS c FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY k, cluster)) AS norm FROM (SELECT k, cluster, i, avg(e[i]) AS m FROM a{p} JOIN u USING (docid), range(1, 65) t(i) GROUP BY k, cluster, i)) GROUP BY k, cluster)"
    out = [", u AS (SELECT docid, list_transform(embedding, x -> x / sqrt(list_inner_product(embedding, embedding))) AS e FROM vp)", f"c0 AS (SELECT k, vec_id AS cluster, embedding AS c FROM vp, (SELECT unnest([{ks}]) AS k) WHERE vec_id < k)", near.format(n=0)]
    for n in range(1, rounds + 1):
        out += [mean.format(n=n, p=n - 1), near.format(n=n)]
    return ", ".join(out)


def _lloyd(v, k, rounds):
    start = v.where("vec_id < " + str(k)).select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid"))
    return E.lloyd_spherical(v.select("docid", "embedding"), start, rounds)


@query(fx.sql("vp", _lloyd_sql("5", 2) + " SELECT docid, cluster FROM a2"))
def ev16_kmeans_spherical(spark, sf):
    """The members of each cluster, after two rounds from given centroids."""
    members = E.cluster_members(_lloyd(fx.vectors(spark, sf), 5, 2), 50)
    return members.select(F.explode("members").alias("docid"), "cluster")


@query("SELECT count(*) AS n_vectors, 10::BIGINT AS n_clusters FROM embeddings")
def ev16b_kmeans_fitted(spark, sf):
    members = E.cluster_members(E.kmeans_spherical(fx.vectors(spark, sf), 10))
    return members.agg(F.sum("n").alias("n_vectors"), F.count_distinct("cluster").alias("n_clusters"))


@query(fx.sql("vp", ", c AS (SELECT vec_id AS cluster, embedding AS centroid FROM vp WHERE vec_id < 5), s AS (SELECT docid, cluster, round(list_inner_product(embedding, centroid), 6) AS s FROM vp, c), r AS (SELECT *, row_number() OVER (PARTITION BY docid ORDER BY s DESC, cluster) AS r FROM s) SELECT docid, cluster FROM r WHERE r = 1"))
def ev17_assign_nearest(spark, sf):
    v = fx.vectors(spark, sf)
    return E.assign_nearest(v, v.where("vec_id < 5").select(F.col("vec_id").alias("cluster"), F.col("embedding").alias("centroid")))


SCORED = _lloyd_sql("2, 3, 4", 1) + """, s AS (SELECT k, cluster, list(s ORDER BY i) AS s, any_value(n) AS n FROM (SELECT k, cluster, i, sum(e[i]) AS s, count(*) AS n FROM a1 JOIN u USING (docid), range(1, 65) t(i) GROUP BY k, cluster, i) GROUP BY k, cluster),
d AS (SELECT a1.k, docid, a1.cluster AS own, s.cluster, s.n, CASE WHEN a1.cluster = s.cluster THEN (s.n - list_inner_product(e, s)) / greatest(s.n - 1, 1) ELSE 1 - list_inner_product(e, s) / s.n END AS d FROM a1 JOIN u USING (docid) JOIN s ON s.k = a1.k),
ab AS (SELECT k, docid, min(d) FILTER (own = cluster) AS a, min(d) FILTER (own <> cluster) AS b, max(n) FILTER (own = cluster) AS n FROM d GROUP BY k, docid),
v AS (SELECT k, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS score FROM ab GROUP BY k UNION ALL SELECT 1, -1.0)
SELECT k::INT AS k, score, k = (SELECT arg_max(k, (score, -k)) FROM v) AS best, CASE WHEN score > 0.75 THEN 'strong' WHEN score > 0.5 THEN 'reasonable' WHEN score > 0.25 THEN 'weak' WHEN score > 0 THEN 'slight' ELSE 'none' END AS band FROM v"""


@query(fx.sql("vp", SCORED))
def ev18_select_k(spark, sf):
    v = fx.vectors(spark, sf)
    return E.select_k(v, [1, 2, 3, 4], clusters=lambda _, k: _lloyd(v, k, 1))


@query(fx.sql("vp", ", u AS (SELECT label, list_transform(embedding, x -> x / sqrt(list_inner_product(embedding, embedding))) AS e FROM vp), m AS (SELECT label, i, avg(e[i]) AS m FROM u, range(1, 65) t(i) GROUP BY label, i), n AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS n FROM m) SELECT label, (i - 1)::INT AS pos, round(m / n, 6) AS value FROM n"))
def ev22_mean_direction(spark, sf):
    return E.mean_direction(fx.vectors(spark, sf), "label")


#: Token vectors: eight consecutive vectors make up a document
TOK = ", t AS (SELECT 'g' || (vec_id // 8) AS docid, vec_id % 8 AS pos, embedding, (vec_id % 5 <> 0)::INT AS mask FROM vp)"


def _tokens(spark, sf):
    return fx.vectors(spark, sf).select(F.expr("concat('g', vec_id div 8)").alias("docid"), F.expr("vec_id % 8").alias("pos"), "embedding", F.expr("if(vec_id % 5 <> 0, 1, 0)").alias("mask"))


@query(fx.sql("vp", TOK + ", x AS (SELECT docid, i, sum((pos + 1) * embedding[i]) / sum(pos + 1) AS m FROM t, range(1, 65) r(i) WHERE mask = 1 GROUP BY docid, i), n AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY docid)) AS n FROM x) SELECT docid, (i - 1)::INT AS dim, round(m / n, 6) AS value FROM n"))
def ev23_pool_vectors(spark, sf):
    return E.pool_vectors(_tokens(spark, sf), "weighted_mean")


@query(fx.sql("vp", TOK + ", f AS (SELECT docid, arg_max(embedding, pos) AS e FROM t WHERE mask = 1 GROUP BY docid), x AS (SELECT docid, i, e[i] AS m FROM f, range(1, 65) r(i)), n AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY docid)) AS n FROM x) SELECT docid, (i - 1)::INT AS dim, round(m / n, 6) AS value FROM n"))
def ev23b_pool_last(spark, sf):
    return E.pool_vectors(_tokens(spark, sf), "last")


@query(fx.sql("vp", TOK + " SELECT docid, (i - 1)::INT AS term, round(max(ln(1 + greatest(embedding[i], 0)) * mask), 6) AS weight FROM t, range(1, 65) r(i) GROUP BY docid, i"))
def ev24_pool_sparse_max(spark, sf):
    logits = _tokens(spark, sf).select("docid", "pos", F.posexplode("embedding").alias("term", "x"), "mask").withColumn("x", F.col("x").cast("double"))
    return E.pool_sparse_max(logits)


@query("SELECT 'd' || l_orderkey AS docid, (l_partkey % 105)::BIGINT AS token, max(l_quantity) AS weight FROM lineitem WHERE l_partkey % 105 NOT IN (0, 101, 102, 103) GROUP BY 1, 2")
def ev25_pool_token_max(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.expr("concat('d', l_orderkey)").alias("docid"), F.expr("l_partkey % 105").alias("token"), F.col("l_quantity").alias("weight"))
    return E.pool_token_max(li)


@query(fx.sql("weights", ", x AS (SELECT docid, token, weight - 0.95 AS weight FROM weights), k AS (SELECT docid, token, round_even(weight * 100, 0)::INT AS weight FROM x WHERE round_even(weight * 100, 0) > 0) SELECT * FROM k UNION ALL SELECT DISTINCT docid, '[NONE]', 1 FROM x WHERE docid NOT IN (SELECT docid FROM k)"))
def ev26_quantize_impacts(spark, sf):
    return E.quantize_impacts(fx.weights(spark, sf).select("docid", "token", (F.col("weight") - 0.95).alias("weight")))


@query(fx.sql("weights", " SELECT docid, token, ceil(weight * 100)::INT AS weight FROM weights"))
def ev26b_quantize_ceil(spark, sf):
    return E.quantize_impacts(fx.weights(spark, sf), "ceil")


def _scored(spark, sf, offset):
    """(qid, score, is_target): each query against the vectors of its batch of 20 that come `offset` after a query; its target is its own next one."""
    q = fx.queries(spark, sf).select("qid", F.col("embedding").alias("qe"), F.col("vec_id").alias("qv"), F.expr("vec_id div 500").alias("batch"))
    p = fx.vectors(spark, sf).where(F.col("vec_id") % 25 == offset).select(F.col("embedding").alias("pe"), F.col("vec_id").alias("pv"), F.expr("vec_id div 500").alias("batch"))
    return q.join(p, "batch").select("qid", F.round(search.dot("qe", "pe"), 6).alias("score"), (F.col("qv") + 1 == F.col("pv")).alias("is_target"))


BATCH = ", b AS (SELECT q.qid, round(list_inner_product(q.embedding, p.embedding), 6) AS score, q.vec_id + 1 = p.vec_id AS is_target, p.vec_id % 25 AS o FROM vq q JOIN vp p ON q.vec_id // 500 = p.vec_id // 500 WHERE p.vec_id % 25 IN (1, 2))"
LOSS = "round(ln(sum(exp(score / 0.5))) - max(score / 0.5) FILTER (is_target), 5) AS loss"


@query(fx.sql("vq vp", BATCH + f" SELECT qid, {LOSS} FROM b WHERE o = 1 GROUP BY qid"))
def ev19_contrastive_scores(spark, sf):
    return E.contrastive_scores(_scored(spark, sf, 1), 0.5)


@query(fx.sql("vq vp", BATCH + f" SELECT qid, {LOSS} FROM b GROUP BY qid"))
def ev20_cached_negative_scores(spark, sf):
    return E.cached_negative_scores(_scored(spark, sf, 1), _scored(spark, sf, 2), 0.5)


@query(fx.sql("run", " SELECT qid, round(ln(sum(exp(score))) - max(score) FILTER (rank = 1), 5) AS loss FROM run WHERE rank <= 8 GROUP BY qid"))
def ev21_group_cross_entropy(spark, sf):
    return E.group_cross_entropy(fx.run(spark, sf).where("rank <= 8").select("qid", (F.col("rank") - 1).alias("pos"), "score"))
