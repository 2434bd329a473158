"""The registered queries themselves: names, order and types of their columns, and their rows against SQL or plain Python, over whole small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from trovex.llm import media, queries

from .test_dedup import WORD, LOWER, classes, fingerprint

COLUMNS = {
    "op1_url_filters": "page_id bigint host string path string rule string verdict string",
    "op2_substring_dedup": "doc_id bigint n_words bigint n_removed bigint kept_sha256 string",
    "op3_lm_scoring": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint base_score double score double",
    "op4_token_counts": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean",
    "op5_benchmark_decontamination": "doc_id bigint n_words bigint n_hit bigint n_items bigint items_sha256 string contaminated boolean",
    "op6_quality_classifier": "doc_id bigint held_out boolean score double predicted int",
    "op7_media_columns": "doc_id bigint n_bytes bigint payload_bytes bigint payload_sha256 string tail_crc32 bigint media_bytes bigint media_sha256 string feature string",
    "op9_toxicity": "doc_id bigint held_out boolean score double predicted int",
    "op10_simhash_near_dedup": "doc_id bigint fingerprint string component_id bigint",
    "op11_merkle_manifest": "doc_id bigint leaf string subroot string root string proof_sha256 string folded_root string verified boolean",
    "op12_embedding_whitening": "vec_id bigint component int n bigint deviation bigint whitened double explained double identity_error double",
    "op13_language_id": "doc_id bigint held_out boolean lang_pred string score double",
}


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def result(spark, sf, name):
    return {r[0]: r for r in queries.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, sf, name):
    want = COLUMNS[name].split()
    got = [(c, t) for c, t in queries.QUERIES[name](spark, sf).dtypes]
    assert got[: len(want) // 2] == list(zip(want[::2], want[1::2]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.ORACLE_SQL[name])
    assert sorted(d[0] for d in cur.description) == sorted(df.columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r[d[0]] for d in cur.description)) for r in df.collect())


def test_op1_rows(spark, sf):
    rows = result(spark, sf, "op1_url_filters")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        _, sep, rest = (p.url or "").partition("://")
        host = re.split(r"[/?#]", rest, maxsplit=1)[0] if sep else ""
        path, host = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0], host.translate(LOWER)
        fits = [(len(h + s), h + s, v) for v, h, s in rules if (host == h or host.endswith("." + h)) and path.startswith(s)]
        r = rows[p.page_id]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            assert r.rule is None


def test_op3_base_rows(spark, sf, texts):
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, x in tokens.items() if not out[i] for w in x)
    n, v = sum(c.values()), len(c)
    rows = result(spark, sf, "op3_lm_scoring")
    assert set(rows) == set(texts)
    for i, x in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(x), sum(c[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel=1e-9) and r.score < 0


def test_op4_rows(spark, sf, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), n := len(lib.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in texts.items()}
    assert {i: tuple(r)[1:] for i, r in result(spark, sf, "op4_token_counts").items()} == want


def test_op6_and_op9_rows(spark, sf, texts):
    for name, mod, out in (("op6_quality_classifier", 5, 0), ("op9_toxicity", 4, 2)):
        rows = result(spark, sf, name)
        assert set(rows) == set(texts)
        assert all(r.held_out == (zlib.crc32(str(i).encode()) % mod == out) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())


def test_op7_rows(spark, sf, texts):
    rows = result(spark, sf, "op7_media_columns")
    assert set(rows) == set(texts)
    for i, t in texts.items():
        x = t.encode()
        payload = x + bytes(-len(x) % 64 if x else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(x), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = media.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and media.decode(stored) == payload


def test_op10_rows(spark, sf, texts):
    prints = [(i, fingerprint(t)) for i, t in texts.items()]
    want = classes(sorted(prints))
    assert {i: (r.fingerprint, r.component_id) for i, r in result(spark, sf, "op10_simhash_near_dedup").items()} == {i: (f"{p:016x}", want[i]) for i, p in prints}


def test_every_page_is_parsed_in_order(spark):
    """All pages of the given table: positions go on without gaps, no text is empty, and references stand in the order of the page."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    html = {r.page_id: r.html or "" for r in pages.collect()}
    rows = media.interleave(pages).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert [s.position for s in r.segments] == list(range(len(r.segments)))
        assert all((s.text is None) == (s.kind == "media") and (s.kind == "media" or s.text.strip()) for s in r.segments)
        at = [html[r.page_id].find(s.text.split()[0]) for s in r.segments if s.kind == "text" and s.text.split()[0] in html[r.page_id]]
        assert all(a >= 0 for a in at)


def test_sequences_with_several_references(spark):
    """Text, two media with captions, one of them missing, in the page's order, for each of two pages that share a medium."""
    stored = {f"{n}": media.encode(media.pad(n.encode())) for n in ("one", "two")}
    digest = {n: hashlib.sha256(media.pad(n.encode())).hexdigest() for n in ("one", "two", "gone")}
    fig = lambda n: f'<figure><img src="sha256:{digest[n]}" alt="a"><figcaption>cap {n}</figcaption></figure>'
    html = {1: f"<p>first</p>{fig('one')}<p>second</p>{fig('gone')}<p>third</p>{fig('two')}", 2: f"{fig('two')}<p>x</p>", 3: None}
    pages = spark.createDataFrame(list(html.items()), "page_id long, html string")
    store = spark.createDataFrame([(digest[n], m) for n, m in stored.items()] * 2, "digest string, media binary")
    sequences = media.interleave(pages)
    assert {r.page_id: [s.text or s.caption for s in r.segments] for r in sequences.collect()} == {1: ["first", "cap one", "second", "cap gone", "third", "cap two"], 2: ["cap two", "x"], 3: []}
    got = sorted((r.page_id, r.position, r.caption, r.payload_sha256) for r in media.resolve(sequences, media.describe(store)).collect())
    assert got == [(1, 1, "cap one", digest["one"]), (1, 3, "cap gone", None), (1, 5, "cap two", digest["two"]), (2, 0, "cap two", digest["two"])]
