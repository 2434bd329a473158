"""Language model, token counts, decontamination, media."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.llm import bpe_count, common, decontaminate, media, ppm

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_ppm(texts, order, mod=10):
    """Static PPM with escape C and full exclusion, symbol by symbol."""
    stream = lambda t: b"\n" * order + "".join(w + " " for w in SPACE.findall((t or "").translate(LOWER))).encode() + b"\n"
    trie = {}
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % mod:
            s = stream(t)
            for p in range(order, len(s)):
                for d in range(order + 1):
                    trie.setdefault(s[p - d : p], Counter())[s[p]] += 1
    def score(t):
        s, total = stream(t), 0.0
        for p in range(order, len(s)):
            out = set()
            for d in range(order, -1, -1):
                seen = trie.get(s[p - d : p])
                if not seen:
                    continue
                live = {x: n for x, n in seen.items() if x not in out}
                novel = len(seen) - len([x for x in out if x in seen]) if live else 1
                whole = sum(live.values()) + novel
                if s[p] in live:
                    total += math.log10(live[s[p]] / whole)
                    break
                total += math.log10(novel / whole)
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total
    return {i: score(t) for i, t in texts}


@pytest.mark.parametrize("head", [1 << 20, 20])
def test_lm_equals_brute_force(docs, texts, head):
    used = [*texts, texts[5]]
    tokens = lambda t: [*SPACE.findall((t or "").translate(LOWER)), None]
    c = Counter(w for i, t in used if zlib.crc32(str(i).encode()) % 10 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = brute_ppm(used, 3)
    got = ppm.score(docs, order=3, nodes=1 << 40, head=head).collect()
    assert len(got) == len(used)
    by_id = dict(texts)
    for r in got:
        w = tokens(by_id[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-4, abs=1e-4)


def test_lm_equals_brute_force_whatever_is_broadcast(docs, texts):
    """At the query's own order and settings, and with hardly anything broadcast."""
    want = brute_ppm([*texts, texts[5]], ppm.ORDER)
    for how in ({}, {"nodes": 5, "head": 20}, {"nodes": 300, "head": 3}):
        got = ppm.score(docs, **how).collect()
        assert len(got) == len(texts) + 1 and all(r.score == pytest.approx(want[r.doc_id], rel=1e-4, abs=1e-4) for r in got)


def test_lm_probabilities_sum_to_one(docs):
    """Whatever the context."""
    counts = docs.select("text").mapInArrow(ppm._count(3), "kind byte, key long, n long").where(F.col("kind") == ppm.GRAM).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = counts.column(0).to_numpy().astype(np.uint64), counts.column(1).to_numpy()
    trie = ppm.Trie([ppm._level(key, n, d) for d in range(4)])
    r = random.Random(1)
    for ctx in [b"the", b"riv", b"\n\n\n", b"zzz", b" of", bytes(r.randrange(256) for _ in range(3))]:
        high = sum(c << 8 * (3 - i) for i, c in enumerate(ctx))
        keys = np.array([high + s for s in range(256)], np.uint64)
        assert np.power(10.0, trie.score(keys)).sum() == pytest.approx(1, abs=1e-4)


def test_lm_without_training_rows_and_empty(spark, empty):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    df = spark.createDataFrame([(ids[0], "a b"), (ids[1], None), (None, "c")], "doc_id long, text string")
    got = ppm.score(df).collect()
    assert all(r.held_out and r.base_score == 0 and r.train_tokens == 0 and r.score < 0 for r in got) and len(got) == 3
    assert ppm.score(empty).count() == 0


def test_token_counts_equal_the_library(docs, texts, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in bpe_count.token_counts(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), n := count(t), n > 1024) for i, t in texts}
    assert bpe_count.token_counts(empty, path).count() == 0
    r, merges = random.Random(3), bpe_count.merges(path)
    alphabet = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "1", "½", "é", "漢", "🙂", "!", " ", "　", "<|endoftext|>", "the ", "é"]
    for _ in range(3000):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(12)))
        assert merges.count(t) == count(t), repr(t)
    long = "ab" * 30_000
    assert merges.count(long) == count(long)


def test_every_code_point_counts_as_in_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, count = Tokenizer.from_file(path), bpe_count.merges(path).count
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for around in ("a{}a", "1{}1"):
        texts = [around.format(c) for c in points]
        assert [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)] == [count(t) for t in texts]


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(texts, items, window):
    wins = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[a : a + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = {}
    for i, t in texts:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if k := wins.get(tuple(w[a : a + n])):
                    found |= k
                    hit[a : a + n] = [True] * n
        out[i] = (len(w), sum(hit), sorted(str(x) for x in found if x is not None))
    return out


@pytest.mark.parametrize(("window", "gram"), [(10, 5), (6, 2), (4, 4)])
def test_contamination_equals_brute_force(spark, docs, texts, empty, window, gram):
    t = dict(texts)
    items = [(1, " ".join(t[2].split()[5:30])), (2, t[8].upper()[:120]), (3, "lantern meadow, nowhere else at all in this corpus indeed"), (4, None), (5, "..."), (6, "CAFÉ naïve"), (7, "copper"), (8, t[23][-200:]), (8, t[24][:90]), (None, t[9][:100]), (12, t[2])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, window, gram).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute_hits(texts, items, window)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_contaminated_rows_go(spark, docs, texts):
    bench = spark.createDataFrame([(1, dict(texts)[2])], "item_id long, text string")
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - {2}


def test_clean_rows_stay_beside_a_contaminated_one_of_their_id(spark, texts):
    bad, good, other = (dict(texts)[i] for i in (2, 5, 6))
    bench = spark.createDataFrame([(1, bad)], "item_id long, text string")
    df = spark.createDataFrame([(None, bad), (None, good), (8, bad), (8, other)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in decontaminate.drop_contaminated(df, bench).collect()), key=str)
    assert got == sorted([(None, good), (8, other)], key=str)


def test_media_round_trip(docs, texts, empty):
    pages = media.interleave(media.text_pages(docs), "page")
    got = media.resolve(pages, media.describe(media.store_texts(docs)), "page").select("page.doc_id", "page.n_bytes", "*").collect()
    assert len(got) == len(texts) + 1
    seen = {}
    for r in got:
        raw = (dict(texts)[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        stored = media.encode(payload)
        assert media.decode(stored) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(payload, r.feature) == r.feature
    assert media.resolve(media.interleave(media.text_pages(empty), "page"), media.describe(media.store_texts(empty)), "page").count() == 0


def test_interleaving_keeps_order_and_captions(spark):
    html = "<p>One <b>two</b></p><script>var x='<p>no</p>'</script><figure><img src='sha256:ab' alt='alt'><figcaption>A &amp; B</figcaption></figure>three<img src='http://x/y.png' alt='why'><p>four"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    got = {r.page_id: [tuple(s) for s in r.segments] for r in media.interleave(df).collect()}
    other = hashlib.sha256(b"http://x/y.png").hexdigest()
    assert got[1] == [(0, "text", "One two", None, None), (1, "media", None, "ab", "A & B"), (2, "text", "three", None, None), (3, "media", None, other, "why"), (4, "text", "four", None, None)]
    assert got[2] == got[3] == []
    store = spark.createDataFrame([("ab", bytearray(media.encode(bytes(64)))), ("ab", bytearray(media.encode(bytes(64)))), (None, None)], "digest string, media binary")
    joined = media.resolve(media.interleave(df), media.describe(store)).orderBy("position").collect()
    assert [(r.position, r.payload_bytes) for r in joined] == [(1, 64), (3, None)]
