"""Queries of readers and writers: each writes derived rows to a scratch folder and reads them back through the operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import scratch, table
from ..operators.evaluation import store_stats
from ..sources import binary, readers, writers
from . import fixtures as fx
from .registry import query


def _lines(df, *columns, sep="\t"):
    return df.select(F.concat_ws(sep, *columns).alias("value"))


def _text(spark, df, name):
    path = scratch(spark, name)
    df.write.text(path)
    return path


@query("SELECT 'd' || doc_id AS docid, '' AS title, text FROM documents")
def src1_read_corpus(spark, sf):
    d = table(spark, sf, "documents")
    own = F.expr("if(doc_id % 2 = 0, concat('d', doc_id), null)").alias("docid")
    path = scratch(spark, "corpus")
    d.select(own, F.expr("concat('d', doc_id)").alias("text_id"), F.lit("").alias("title"), "text").write.json(path)
    return readers.read_corpus(spark, path)


@query("SELECT 'p' || p_partkey AS query_id, trim(p_name) AS query FROM part")
def src2_read_queries(spark, sf):
    p = table(spark, sf, "part")
    return readers.read_queries(spark, _text(spark, _lines(p, F.expr("concat(' p', p_partkey)"), F.concat("p_name", F.lit("  "))), "queries"), "tsv")


@query("SELECT DISTINCT 'q' || l_suppkey AS qid, 'd' || l_partkey AS docid FROM lineitem")
def src3_read_qrels2(spark, sf):
    li = table(spark, sf, "lineitem").select(F.expr("concat('q', l_suppkey)").alias("a"), F.expr("concat(' d', l_partkey)").alias("b"))
    rows = _lines(li, "a", "b").unionByName(li.select(F.col("a").alias("value")))
    return readers.read_qrels2(spark, _text(spark, rows, "qrels2"))


@query(fx.sql("qrels", " SELECT qid, docid, rel FROM qrels WHERE rel = 1"))
def src4_read_qrels4(spark, sf):
    q = fx.qrels(spark, sf)
    return readers.read_qrels4(spark, _text(spark, _lines(q, "qid", F.lit("0"), "docid", F.col("rel").cast("string"), sep=" "), "qrels4"))


@query(fx.sql("qrels", " SELECT qid, arg_max(docid, substring(docid, 2)::BIGINT) AS docid, arg_max(rel, substring(docid, 2)::BIGINT) AS rel FROM qrels GROUP BY qid"))
def src4b_read_qrels4_last(spark, sf):
    q = fx.qrels(spark, sf).repartition("qid").sortWithinPartitions("qid", F.expr("cast(substring(docid, 2) as bigint)"))
    return readers.read_qrels4(spark, _text(spark, _lines(q, "qid", F.lit("0"), "docid", F.col("rel").cast("string"), sep=" "), "qrels4"), last_wins=True)


@query(fx.sql("run", " SELECT qid, docid, score, rank::INT AS place FROM run"))
def src5_read_run(spark, sf):
    """Each query's lines stand in order of rank, so their places among its line numbers are their ranks."""
    s = F.col("score").cast("string")
    forms = [F.concat_ws("\t", "qid", "docid", s), F.concat_ws(" ", "qid", "docid", F.lit("0"), s), F.concat_ws(" ", "qid", F.lit("Q0"), "docid", F.col("rank").cast("string"), s, F.lit("tag"))]
    n = F.col("rank") % 3
    rows = _in_order(fx.run(spark, sf)).select(F.when(n == 0, forms[0]).when(n == 1, forms[1]).otherwise(forms[2]).alias("value"))
    back = readers.read_run(spark, _text(spark, rows, "run"))
    return back.select("qid", "docid", "score", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")).alias("place"))


def _in_order(run):
    """A query's rows in one file, by rank."""
    return run.repartition("qid").sortWithinPartitions("qid", "rank")


@query(fx.sql("run", " SELECT qid, docid, rank::INT AS rank FROM run"))
def src6_read_anns_truth(spark, sf):
    return readers.read_anns_truth(spark, _text(spark, _lines(_in_order(fx.run(spark, sf)), "qid", "docid"), "truth"))


EACH = "round(embedding[i], 6) AS value FROM vp, range(1, 65) t(i)"


def _each(v):
    """(row_idx, dim, value) of vectors."""
    return v.select("row_idx", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def _vector_files(spark, sf):
    path = scratch(spark, "vectors")
    return path, binary.write_vectors(fx.vectors(spark, sf).select(F.col("vec_id").alias("row_idx"), "embedding"), path, 128)


@query(fx.sql("vp", f" SELECT vec_id AS row_idx, (i - 1)::INT AS dim, {EACH} WHERE vec_id BETWEEN 100 AND 349"))
def src7_read_vectors(spark, sf):
    return _each(binary.read_vectors(spark, _vector_files(spark, sf)[0], 100, 250, rows=100))


@query(fx.sql("run", " SELECT substring(qid, 2)::INT // 25 AS query_idx, rank::INT AS rank, substring(docid, 2)::INT AS doc_idx, round(score::FLOAT::DOUBLE, 4) AS distance FROM run"))
def src8_read_truth_bin(spark, sf):
    path = scratch(spark, "truth")
    r = fx.run(spark, sf).select(F.expr("cast(substring(qid, 2) as int) div 25").cast("int").alias("query_idx"), "rank", F.expr("cast(substring(docid, 2) as int)").alias("doc_idx"), F.col("score").alias("distance"))
    binary.write_truth_bin(r, path, per_part=8)
    return binary.read_truth_bin(spark, path, rows=3).withColumn("distance", F.round(F.col("distance").cast("double"), 4))


def _shards(spark, sf):
    from .lookups import _id_map

    return _id_map(spark, sf).join(fx.vectors(spark, sf).select("docid", "embedding"), "docid")


SHARDED = ", s AS (SELECT shard, row_number() OVER (PARTITION BY shard ORDER BY vec_id) - 1 AS raw_id, docid, embedding FROM vp)"


@query(fx.sql("vp", SHARDED + " SELECT shard, raw_id, docid, len(embedding)::INT AS dim FROM s WHERE shard <> 3"))
def src9_read_embedding_shards(spark, sf):
    path = scratch(spark, "shards")
    _shards(spark, sf).write.partitionBy("shard").parquet(path)
    return readers.read_embedding_shards(spark, path).where("shard <> 3").select("shard", F.col("raw_id").cast("long").alias("raw_id"), "docid", F.size("embedding").alias("dim"))


@query("SELECT 'd' || page_id AS docid, length(html)::INT AS n FROM pages")
def src10_scan_web_records(spark, sf):
    root = scratch(spark, "web")
    body = F.to_json(F.struct(F.expr("concat('d', page_id)").alias("ClueWeb22-ID"), F.col("html").alias("Clean-Text")))
    table(spark, sf, "pages").select(body.alias("value")).repartition(3).write.option("compression", "gzip").text(f"{root}/raw")
    # Spark names its parts .txt.gz; the store's own names end in .json.gz
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{root}/raw")
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(f"{root}/txt/en00"))
    for i, f in enumerate(s.getPath() for s in system.listStatus(top)):
        if f.getName().endswith(".gz"):
            system.rename(f, hadoop.Path(f"{root}/txt/en00/en0000-{i:02d}.json.gz"))
    r = readers.scan_web_records(spark, root)
    return r.select("docid", F.length(F.get_json_object("record", "$['Clean-Text']")).alias("n"))


FILES = "SELECT lang || '00' || (doc_id % 3) AS subdir, (doc_id % 5)::INT AS file_seq, (11 * (count(*) + 1) + CASE WHEN doc_id % 3 = 2 AND doc_id % 5 = 4 THEN 1 ELSE 0 END)::BIGINT AS n_bytes FROM documents GROUP BY lang, doc_id % 3, doc_id % 5"


@query(f"WITH f AS ({FILES}) SELECT format('clueweb22-{{}}-{{:02d}}-{{:05d}}', subdir, file_seq, i) AS docid FROM f, unnest(range(0, n_bytes // 11 - 1)) u(i) WHERE n_bytes % 11 = 0")
def src11_enumerate_docids(spark, sf):
    d = table(spark, sf, "documents").groupBy("lang", F.expr("doc_id % 3").alias("a"), F.expr("doc_id % 5").alias("b")).agg(F.count("*").alias("n"))
    files = d.select(F.expr("concat(lang, '00', a)").alias("subdir"), F.col("b").cast("int").alias("file_seq"), F.expr("11 * (n + 1) + if(a = 2 and b = 4, 1, 0)").alias("n_bytes"))
    return readers.enumerate_docids(files)


@query("SELECT page_id, html FROM pages")
def src12_html_body(spark, sf):
    p = table(spark, sf, "pages")
    raw = F.concat(F.lit("WARC/1.0\r\nURL: "), "url", F.lit("\r\n\r\n"), F.replace("html", F.lit("\n"), F.lit("\n")))
    return readers.html_body(p.select("page_id", raw.alias("raw")))


@query("SELECT 'i' || p_partkey AS item_id, p_brand AS categories, p_name AS title FROM part WHERE p_partkey % 4 <> 0")
def src13_read_items(spark, sf):
    path = scratch(spark, "items")
    p = table(spark, sf, "part").select(F.expr("concat('i', p_partkey)").alias("item_id:token"), F.col("p_brand").alias("categories:token"), F.expr("if(p_partkey % 4 = 0, null, p_name)").alias("title:token"))
    p.write.csv(path, sep="\t", header=True, quote="")
    return readers.read_items(spark, path)


@query("SELECT url, arg_max('d' || page_id, page_id) AS docid FROM pages GROUP BY url")
def src14_read_url_map(spark, sf):
    path = scratch(spark, "urls")
    p = table(spark, sf, "pages")
    early = p.select(F.lit("d-1").alias("docid"), "url", F.lit(-1).cast("long").alias("n"))
    rows = early.unionByName(p.select(F.expr("concat('d', page_id)").alias("docid"), "url", F.col("page_id").alias("n")))
    rows.repartition("url").sortWithinPartitions("n").select("docid", "url").write.csv(path)
    return readers.read_url_map(spark, path)


@query(fx.sql("run", " SELECT qid, (rank - 1)::INT AS pos, docid FROM run WHERE rank <= 10"))
def src15_read_negatives(spark, sf):
    r = fx.run(spark, sf).where("rank <= 10").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "docid"))).alias("x"))
    return readers.read_negatives(spark, _text(spark, _lines(r, "qid", F.array_join("x.docid", ",")), "negatives"))


@query("SELECT o_custkey::VARCHAR AS question, count(*) FILTER (o_orderstatus = 'F')::INT AS n_pos, count(*) FILTER (o_orderstatus <> 'F')::INT AS n_neg FROM orders GROUP BY o_custkey")
def src16_read_dpr(spark, sf):
    def ctx(ok):
        return F.array_compact(F.collect_list(F.when(ok, F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderkey").cast("string").alias("text")))))

    done = F.col("o_orderstatus") == "F"
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("question")).agg(ctx(done).alias("positive_ctxs"), ctx(~done).alias("hard_negative_ctxs"))
    # one array for each file, of up to a thousand questions
    rows = o.withColumn("f", F.expr("cast(question as bigint) div 1000")).groupBy("f").agg(F.to_json(F.collect_list(F.struct("question", "positive_ctxs", "hard_negative_ctxs"))).alias("value"))
    path = scratch(spark, "dpr")
    rows.select("value", "f").write.partitionBy("f").text(path)
    return readers.read_dpr(spark, path).select("question", F.size("positive_ctxs").alias("n_pos"), F.size("hard_negative_ctxs").alias("n_neg"))


@query("SELECT 'k' || c_custkey AS api_key, TIMESTAMP '2024-01-01' AS enabled_time, c_name AS user_info FROM customer WHERE c_custkey % 5 <> 0")
def src17_read_access_keys(spark, sf):
    c = table(spark, sf, "customer").select(F.expr("concat('k', c_custkey)").alias("k"), F.struct(F.lit("2024-01-01T00:00:00Z").alias("enabled_time"), F.col("c_name").alias("user_info"), F.expr("c_custkey % 5 <> 0").alias("is_active")).alias("v"), F.expr("c_custkey div 1000").alias("f"))
    rows = c.groupBy("f").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "v")))).alias("value"))
    path = scratch(spark, "keys")
    rows.select("value", "f").write.partitionBy("f").text(path)
    return readers.read_access_keys(spark, path).withColumn("enabled_time", F.col("enabled_time").cast("timestamp_ntz"))


# sinks


@query(fx.sql("run", " SELECT qid, docid, score FROM run"))
def snk1_write_run(spark, sf):
    path = scratch(spark, "run")
    writers.write_run(fx.run(spark, sf), path)
    return readers.read_run(spark, path).drop("line_no")


@query(fx.sql("run", " SELECT qid, docid, rank::BIGINT AS rank FROM run"))
def snk2_to_marco(spark, sf):
    r = writers.to_marco(fx.run(spark, sf).drop("rank"))
    return r.withColumn("rank", F.col("rank").cast("long"))


@query(fx.sql("run", " SELECT qid, docid, rank::BIGINT AS rank FROM run"))
def snk2b_to_marco_file(spark, sf):
    r = writers.to_marco(fx.run(spark, sf).select("qid", "docid", (F.col("rank") * 2).alias("line_no")), "file")
    return r.withColumn("rank", F.col("rank").cast("long"))


@query(fx.sql("run", " SELECT substring(qid, 2) || ' Q0 ' || substring(docid, 2) || ' ' || rank || ' ' || round(score * 1000)::BIGINT || ' dense' AS line FROM (SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY round(score * 1000)::BIGINT DESC, substring(docid, 2)) AS rank FROM run)"))
def snk3_to_trec(spark, sf):
    r = fx.run(spark, sf).select(F.substring("qid", 2, 12).alias("qid"), F.substring("docid", 2, 12).alias("docid"), F.round(F.col("score") * 1000).cast("long").alias("score"))
    own = r.select("qid", F.col("qid").alias("docid"), F.lit(2000).cast("long").alias("score")).distinct()
    return writers.to_trec(r.unionByName(own), remove_query=True)


@query(fx.sql("vp", f" SELECT vec_id AS row_idx, (i - 1)::INT AS dim, {EACH}"))
def snk4_write_vectors(spark, sf):
    """The written files, read back row by row."""
    return _each(binary.read_vectors(spark, _vector_files(spark, sf)[0]))


@query("SELECT (vec_id // 128)::INT AS part, count(*) AS n FROM embeddings GROUP BY 1")
def snk4b_written_parts(spark, sf):
    return _vector_files(spark, sf)[1]


@query(fx.sql("qrels vp", SHARDED + ", f AS (SELECT qid, min(substring(docid, 2)::INT) AS v FROM qrels GROUP BY qid) SELECT substring(qid, 2)::INT // 25 - 1 AS query_idx, 1 AS rank, v::INT AS doc_idx FROM f"))
def snk5_write_qrels_bin(spark, sf):
    path = scratch(spark, "qrels")
    q = fx.qrels(spark, sf).groupBy("qid").agg(F.min(F.expr("cast(substring(docid, 2) as int)")).alias("v"))
    q = q.select(F.expr("cast(cast(substring(qid, 2) as int) div 25 - 1 as int)").alias("query_idx"), F.expr("concat('d', v)").alias("docid"))
    ids = fx.vectors(spark, sf).select("docid", (F.col("vec_id") + 1).alias("raw_id"))
    binary.write_qrels_bin(q, ids, path, one_index=True, per_part=8)
    return binary.read_truth_bin(spark, path, e2e=True).select("query_idx", "rank", "doc_idx")


@query(fx.sql("vp", SHARDED + " SELECT shard, raw_id, docid FROM s"))
def snk6_write_id_map(spark, sf):
    from .lookups import _id_map

    path = scratch(spark, "id-map")
    writers.write_id_map(_id_map(spark, sf), path)
    return spark.read.schema("raw_id int, docid string, shard int").parquet(path).select("shard", F.col("raw_id").cast("long").alias("raw_id"), "docid")


@query("SELECT doc_id, md5(text) AS text_md5, lang, source, true AS small FROM documents")
def snk7_write_rotated(spark, sf):
    """Whole documents come back as they were, and no file has more rows than it may."""
    path = scratch(spark, "rotated")
    docs = table(spark, sf, "documents")
    writers.write_rotated(docs, path, 100)
    back = spark.read.schema(docs.schema).json(path).select("*", F.col("_metadata.file_path").alias("f"))
    large = back.groupBy("f").agg(F.count("*").alias("n")).where("n > 100").select("f", F.lit(False).alias("small"))
    return back.join(large, "f", "left").select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", F.coalesce("small", F.lit(True)).alias("small"))


IMPACTS = ", i AS (SELECT docid, token, ceil(weight)::INT AS weight FROM weights)"


def _impacts(spark, sf):
    return fx.weights(spark, sf).select("docid", "token", F.ceil("weight").cast("int").alias("weight"))


@query(fx.sql("weights", IMPACTS + " SELECT docid AS id, count(*) AS n, sum(weight)::BIGINT AS total FROM i GROUP BY docid"))
def snk8_write_sparse_docs(spark, sf):
    path = scratch(spark, "sparse")
    writers.write_sparse_docs(_impacts(spark, sf), path)
    d = spark.read.schema("id string, content string, vector map<string,int>").json(path)
    return d.select("id", F.size("vector").cast("long").alias("n"), F.aggregate(F.map_values("vector"), F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(fx.sql("weights", IMPACTS + ", r AS (SELECT docid AS qid, token, unnest(range(0, weight)) FROM i) SELECT qid, md5(string_agg(token, ' ' ORDER BY token)) AS text FROM r GROUP BY qid"))
def snk9_write_sparse_queries(spark, sf):
    return writers.sparse_queries(_impacts(spark, sf).withColumnRenamed("docid", "qid")).withColumn("text", F.md5("text"))


@query("SELECT event_id AS id, (event_id % 20 + 1)::INT AS k, (CASE WHEN event_id % 3 = 0 THEN 7 ELSE 5 * (event_id % 20 + 1) END)::INT AS complexity FROM events")
def snk10_append_search_log(spark, sf):
    path = scratch(spark, "log")
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr("cast(event_id % 20 + 1 as int)").alias("k"), F.expr("if(event_id % 3 = 0, 7, null)").alias("complexity"))
    for i in range(2):
        writers.append_search_log(e.where(F.col("id") % 2 == i), path)
    return spark.read.schema("id long, k int, complexity int").parquet(path)


@query("SELECT count(*) AS access, count(*) AS hit, 0::BIGINT AS miss, 1.0::DOUBLE AS hit_rate FROM documents")
def src1b_corpus_round_trip(spark, sf):
    """Every text comes back from JSON lines as it was."""
    path = scratch(spark, "corpus")
    c = fx.corpus(spark, sf)
    c.select("docid", "title", "text").write.json(path)
    back = readers.read_corpus(spark, path).select("docid", F.col("text").alias("again"))
    same = c.join(back, "docid").select(F.when(F.col("text") == F.col("again"), F.col("text")).alias("text"))
    return store_stats(same)
