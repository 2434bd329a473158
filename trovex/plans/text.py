"""Queries of text preparation and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import table
from ..operators import filters, joins
from ..operators import projections as P
from ..operators.judgements import met
from . import fixtures as fx
from .fixtures import TOKENS
from .registry import query

STRIP = r"regexp_replace({}, '^[\p{{Z}}\s\x0b]+|[\p{{Z}}\s\x0b]+$', '', 'g')"


@query("SELECT doc_id AS query_id, " + STRIP.format("'query: ' || " + STRIP.format("text")) + " AS text FROM documents")
def prj1_prepare_queries(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return P.prepare_queries(q, "query:")


@query(fx.sql("corpus", " SELECT docid, " + STRIP.format("'passage: Title: ' || title || ' Text: ' || text") + " AS text FROM corpus"))
def prj2_prepare_passages(spark, sf):
    return P.prepare_passages(fx.corpus(spark, sf), "passage:", markers=True)


@query(fx.sql("run query_texts corpus", " SELECT r.qid, r.docid, 'query: ' || q.query || ' document: ' || " + STRIP.format("replace(c.title, '-', ' ')") + " || ' ' || c.text AS text FROM run r JOIN query_texts q USING (qid) JOIN corpus c USING (docid) WHERE r.rank <= 5"))
def prj3_prepare_pairs(spark, sf):
    c = joins.rerank_input(fx.run(spark, sf), fx.query_texts(spark, sf), fx.corpus(spark, sf), 5)
    return P.prepare_pairs(c, "query:", "document:")


@query(fx.sql("corpus", " SELECT docid, CASE WHEN doc_id % 3 <> 0 AND title <> '' THEN title || ' | ' || text ELSE text END AS text FROM corpus"))
def prj4_prepare_dual(spark, sf):
    c = fx.corpus(spark, sf).withColumn("title", F.when(F.col("doc_id") % 3 != 0, F.col("title")))
    return P.prepare_dual(c, " | ")


QUOTES = "chr(9) || chr(13) || chr(34) || chr(39)"


@query(fx.sql("corpus", " SELECT docid, " + STRIP.format(f"translate(title, {QUOTES}, '')") + " AS title, " + STRIP.format(f"translate(text, chr(10) || {QUOTES}, '')") + " AS text FROM corpus"))
def prj5_clean_web_text(spark, sf):
    return P.clean_web_text(fx.corpus(spark, sf))


WEB = r"'^clueweb22-([a-z]+)(\d{2})(\d{2})-(\d{2})-(\d{5})$'"


@query(fx.sql("web_ids", f", p AS (SELECT docid, regexp_extract(docid, {WEB}, ['lang', 'stream', 'subdir', 'file_seq', 'doc_seq']) AS x FROM web_ids WHERE regexp_matches(docid, {WEB})) SELECT docid, x.lang, x.stream, x.subdir, x.file_seq, x.doc_seq::INT AS doc_seq, x.lang || '/' || x.lang || x.stream || '/' || x.lang || x.stream || x.subdir || '/' || x.lang || x.stream || x.subdir || '-' || x.file_seq || '.json.gz' AS path FROM p"))
def prj6_parse_docid(spark, sf):
    return P.parse_docid(fx.web_ids(spark, sf))


@query("SELECT 'q' || (page_id % 20) AS qid, page_id AS rank, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'd' || page_id END AS docid, CASE WHEN page_id % 7 = 0 THEN '' ELSE url END AS url, CASE WHEN page_id % 7 = 0 THEN '' ELSE md5(url) END AS url_hash, CASE WHEN page_id % 7 = 0 THEN '' ELSE html END AS text FROM pages")
def prj7_extract_fields(spark, sf):
    p = table(spark, sf, "pages")
    good = F.to_json(F.struct(F.expr("concat('d', page_id)").alias("ClueWeb22-ID"), F.col("url").alias("URL"), F.md5("url").alias("URL-hash"), F.col("html").alias("Clean-Text")))
    body = F.when(F.col("page_id") % 7 == 0, F.lit("not json")).otherwise(good)
    return P.extract_fields(p.select(F.expr("concat('q', page_id % 20)").alias("qid"), F.col("page_id").alias("rank"), body.alias("body")))


@query("SELECT doc_id AS id, 'From ' || source || ' (' || lang || '): ' || text || '.' AS text FROM documents")
def prj8_fill_template(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.struct("source", "lang").alias("meta"), F.col("text").alias("body"))
    return P.fill_template(d, "From <meta.source> (<meta.lang>): <body>.")


@query(fx.sql("corpus", ", p AS (SELECT docid, title, string_split(text, '. ') AS t FROM corpus) SELECT docid, (i - 1)::INT AS part, title, t[i] AS text FROM p, unnest(range(1, len(t) + 1)) u(i)"))
def prj9_split_passages(spark, sf):
    return P.split_passages(fx.corpus(spark, sf), ". ")


def _h(*parts: str) -> str:
    return "('0x' || substring(md5(" + " || ':' || ".join(parts) + "), 1, 8))::BIGINT / 4294967296.0"


def _crop(name: str) -> str:
    size = f"greatest(floor(len(w) * (0.1 + 0.4 * {_h(repr('crop'), repr(name), repr('ratio'), 'docid')})), 1)::INT"
    return f"array_to_string(w[floor({_h(repr('crop'), repr(name), repr('start'), 'docid')} * (len(w) - {size} + 1))::INT + 1 : floor({_h(repr('crop'), repr(name), repr('start'), 'docid')} * (len(w) - {size} + 1))::INT + {size}], ' ')"


@query(fx.sql("corpus", r", t AS (SELECT docid, regexp_split_to_array(" + STRIP.format("title || ' ' || text") + rf", '\s+') AS w FROM corpus) SELECT docid, {_crop('a')} AS query, {_crop('b')} AS passage FROM t"))
def prj10_crop_pairs(spark, sf):
    return P.crop_pairs(fx.corpus(spark, sf))


IDS = "SELECT l_orderkey AS id, list(l_partkey::INT ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey"


def _ids(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_partkey").cast("int").alias("p")))).alias("x"))
    return rows.select("id", F.col("x.p").alias("input_ids"))


def _text(c: str):
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c)


@query(f"WITH x AS ({IDS}) SELECT id, array_to_string(ids[1:3] || [2], ',') AS input_ids FROM x")
def prj11_truncate_tokens(spark, sf):
    return P.truncate_tokens(_ids(spark, sf), 4, eos=2).select("id", _text("input_ids"))


@query(f"WITH x AS ({IDS}), n AS (SELECT *, (ceil(max(len(ids)) OVER (PARTITION BY id // 100) / 4) * 4)::INT AS n FROM x) SELECT id, array_to_string(ids || list_transform(range(len(ids), n), i -> 0), ',') AS input_ids, array_to_string(list_transform(range(0, n), i -> (i < len(ids))::INT), ',') AS mask FROM n")
def prj12_pad_tokens(spark, sf):
    df = _ids(spark, sf).withColumn("batch", F.expr("id div 100"))
    return P.pad_tokens(df, 4).select("id", _text("input_ids"), _text("mask"))


@query("SELECT doc_id AS id, array_to_string(" + TOKENS.format("text") + ", ' ') AS tokens FROM documents")
def prj13_answer_tokens(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return P.answer_tokens(d, "text", normalize=False).select("id", F.array_join("tokens", " ").alias("tokens"))


@query("WITH t AS (SELECT item_id AS id, " + TOKENS.format("text") + " AS t FROM benchmark) SELECT id, array_to_string(t[i:i + n - 1], ' ') AS ngram FROM t, range(1, 4) r(n), unnest(range(1, len(t) - n + 2)) u(i)")
def prj14_token_ngrams(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text")
    return P.token_ngrams(P.answer_tokens(b, "text", normalize=False), 3)


CONV = "SELECT conv_id AS id, list(text ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id"


@query(f"WITH c AS ({CONV}) SELECT id, t[2] AS query, array_to_string(t[2:2], '|') AS positives, array_to_string(t[2:], '|') AS negatives FROM c")
def prj15_adapt_pair_lists(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    c = c.select("id", F.col("x.text").alias("query"), F.col("x.text").alias("pos"), F.col("x.text").alias("neg"))
    return P.adapt_pair_lists(c).select("id", "query", F.array_join("positives", "|").alias("positives"), F.array_join("negatives", "|").alias("negatives"))


@query("SELECT doc_id AS id, base64(encode(text)) AS payload FROM documents")
def prj16_payload_base64(spark, sf):
    return P.payload_base64(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "text")


@query(f"WITH c AS ({CONV}), r AS (SELECT id || '_' || (id % 3) AS docid, id, (id % 3)::INT AS i FROM c) SELECT docid, t[i + 1] AS image_ref FROM r JOIN c USING (id)")
def prj17_resolve_image_ref(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("row")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x")).select("row", F.col("x.text").alias("images"))
    return joins.resolve_image_ref(c.select(F.expr("concat(row, '_', row % 3)").alias("docid")), c)


@query("SELECT conv_id || ':' || turn AS id, 'Retrieve: ' || text AS text FROM conversations WHERE role = 'user'")
def prj18_prefix_encode_input(spark, sf):
    q = table(spark, sf, "conversations").where("role = 'user'").select(F.expr("concat(conv_id, ':', turn)").alias("id"), F.col("text").alias("query"))
    return P.prefix_encode_input(q, "Retrieve: ")


# filters

GROUPS = "SELECT o_custkey AS id, count(*) FILTER (o_orderstatus = 'F') AS p, count(*) FILTER (o_orderstatus = 'O') AS n FROM orders GROUP BY o_custkey"


@query(f"WITH g AS ({GROUPS}) SELECT id, p AS n_pos, n AS n_neg FROM g WHERE p >= 1 AND n >= 3")
def flt1_filter_trainable(spark, sf):
    pick = lambda s: F.array_compact(F.collect_list(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey"))))
    g = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(pick("F").alias("positive_passages"), pick("O").alias("negative_passages"))
    return filters.filter_trainable(g, 1, 3).select("id", F.size("positive_passages").cast("long").alias("n_pos"), F.size("negative_passages").cast("long").alias("n_neg"))


@query(fx.sql("run", " SELECT substring(qid, 2) AS qid, substring(docid, 2) AS docid, score FROM run"))
def flt2_drop_self_match(spark, sf):
    from ..operators.search import knn_blocked

    r = knn_blocked(fx.queries(spark, sf), fx.vectors(spark, sf), fx.DEPTH + 1)
    return filters.drop_self_match(r.select(F.substring("qid", 2, 12).alias("qid"), F.substring("docid", 2, 12).alias("docid"), "score"))


@query(fx.sql("cands", " SELECT qid, docid, hit FROM cands"))
def flt3_has_answer(spark, sf):
    return filters.has_answer(fx.candidates(spark, sf)).select("qid", "docid", "hit")


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN regexp_matches(text, '(?im)^the [a-z]+ing') WHEN 1 THEN regexp_matches(text, '(?im)[0-9]{4}-[0-9]{2}') OR regexp_matches(text, '(?im)der$') ELSE false END AS hit FROM documents")
def flt4_has_answer_regex(spark, sf):
    """Each row has its own patterns; some are invalid."""
    own = "case doc_id % 3 when 0 then array('^the [a-z]+ing', '(unclosed') when 1 then array('[0-9]{4}-[0-9]{2}', 'DER$') else array('[z-a]') end"
    return filters.has_answer_regex(table(spark, sf, "documents").withColumn("answers", F.expr(own))).select("doc_id", "hit")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'pl' WHEN doc_id % 7 = 1 THEN 'zh_chs' ELSE lang END AS lang FROM documents WHERE doc_id % 7 < 2 OR lang IN ('de', 'fr')")
def flt6_filter_lang(spark, sf):
    own = F.expr("case doc_id % 7 when 0 then 'pl' when 1 then 'zh_chs' else lang end")
    return filters.filter_lang(table(spark, sf, "documents").withColumn("lang", own), ["de", "fr", "pl", "zh_chs"]).select("doc_id", "lang")


@query(fx.sql("vq", ", r AS (SELECT 'q' || (page_id % 20 * 25) AS qid, page_id AS rank, 'd' || page_id AS docid, url, md5(url) AS url_hash FROM pages), j AS (SELECT 'q' || (page_id % 20 * 25) AS qid, CASE WHEN page_id % 3 = 0 THEN 'd' || page_id WHEN page_id % 3 = 1 THEN url ELSE md5(url) END AS docid FROM pages WHERE page_id % 4 = 0) SELECT qid, rank, docid, EXISTS (SELECT 1 FROM j WHERE j.qid = r.qid AND j.docid IN (r.docid, r.url, r.url_hash)) AS rel FROM r"))
def flt7_is_relevant(spark, sf):
    p = table(spark, sf, "pages").select(F.expr("concat('q', page_id % 20 * 25)").alias("qid"), F.col("page_id").alias("rank"), F.expr("concat('d', page_id)").alias("docid"), "url", F.md5("url").alias("url_hash"))
    j = p.where("rank % 4 = 0").select("qid", F.expr("case rank % 3 when 0 then docid when 1 then url else url_hash end").alias("docid"))
    return joins.is_relevant(p, j).select("qid", "rank", "docid", "rel")


@query(fx.sql("run query_texts", " SELECT qid, docid, rank::BIGINT AS rank FROM run WHERE qid IN (SELECT qid FROM query_texts WHERE substring(qid, 2)::BIGINT % 50 = 0)"))
def flt8_known_queries_only(spark, sf):
    known = fx.query_texts(spark, sf).where("cast(substring(qid, 2) as bigint) % 50 = 0")
    return joins.known_queries_only(fx.run(spark, sf), known).select("qid", "docid", F.col("rank").cast("long").alias("rank"))


@query(fx.sql("run qrels", ", r AS (SELECT r.qid, r.docid FROM run r JOIN qrels USING (qid, docid)) SELECT qid, docid, count(*) OVER (PARTITION BY qid) <= 3 AS eligible FROM r"))
def flt9_rerank_cap(spark, sf):
    r = met(fx.run(spark, sf).select("qid", "docid"), fx.judgements(spark, sf)).select("qid", "docid")
    return joins.rerank_cap(r, 3)
