"""Trees, quality, toxicity, URL rules, mixing: fixtures with known answers, held-out accuracy and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trovex.llm import gbdt, mixing, quality, toxicity, url_filter

from .conftest import prose

INSULTS = ["vermin", "dimwit", "lowlife"]


@pytest.fixture(scope="module")
def labelled(spark):
    """300 documents: every 4th is shouted noise, every 5th has insults."""
    rows, labels = [], []
    for i in range(300):
        t = prose(1000 + i, 60 + i % 50)
        good, toxic = int(i % 4 != 0), int(i % 5 == 0)
        if not good:
            t = " ".join(w.upper() + "!!" for w in t.split())
        if toxic:
            w = t.split()
            r = random.Random(i)
            for _ in range(4):
                w.insert(r.randrange(len(w)), r.choice(INSULTS))
            t = " ".join(w)
        rows.append((i, t, "en"))
        labels.append((i, good, toxic))
    docs = spark.createDataFrame([*rows, (None, "some text here", "en"), (900, None, "en"), (901, "", "en"), (2, rows[2][1], "en")], "doc_id long, text string, label string").repartition(3)
    return docs, spark.createDataFrame([*labels, (2, None, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int"), dict((i, (g, t)) for i, g, t in labels)


def test_forest_learns_and_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    f = gbdt.fit(x[:1500], y[:1500])
    p = f.predict(x[1500:])
    assert ((p > 0.5) == y[1500:]).mean() > 0.97 and p.min() >= 0 and p.max() <= 1
    assert gbdt.fit(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert gbdt.fit(x[:9], np.ones(9)).predict(x[:3]).min() > 0.9


@pytest.mark.parametrize(("module", "which", "mod", "out"), [(quality, 0, 5, 0), (toxicity, 1, 4, 2)])
def test_classifiers_on_held_out_rows(labelled, module, which, mod, out):
    docs, labels, truth = labelled
    rows = module.score(docs, labels).collect()
    assert len(rows) == 304
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out) for r in rows if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id][which] for r in held]) >= 0.95
    assert len({r.score for r in rows if r.doc_id == 2}) == 1
    assert len({r.score for r in rows if r.doc_id in (900, 901)}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels_or_rows(labelled, module):
    docs, labels, _ = labelled
    assert {r.score for r in module.score(docs, labels.limit(0)).collect()} == {0.5}
    assert module.score(docs.limit(0), labels).count() == 0


def test_scores_dont_see_ids_or_labels_of_held_out_rows(labelled):
    docs, labels, _ = labelled
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    a = {r.doc_id: r.score for r in quality.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in quality.score(docs, flipped).collect()}


def test_quality_filter_keeps_columns(labelled):
    docs, labels, truth = labelled
    kept = quality.keep_good(docs, labels)
    good = {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good


def test_toxic_dictionary_holds_the_insults(labelled):
    docs, labels, _ = labelled
    rows = docs.select("doc_id", "text").join(labels.selectExpr("doc_id", "cast(toxic as double) label"), "doc_id").where("label is not null").selectExpr("doc_id", "label", "lower(coalesce(text, '')) text")
    toxic, ordinary = toxicity.dictionaries(rows)
    assert all(w.encode() in toxic and w.encode() not in ordinary for w in INSULTS) and b"river" in ordinary
    d = toxicity.distance(toxic, ordinary)
    assert all(d.saved(f"a stone {w} in winter".encode()).max() >= 2 for w in INSULTS)
    assert d.saved(b"").tolist() == [0] and len(d.saved(b"river " * 1000)) == -(-6000 // toxicity.WINDOW)


def test_grams_are_counted_once_for_each_document(spark):
    texts = [(0, 1.0, "abcdefgh abcdefgh"), (1, 0.0, "xbcdefgh"), (2, 1.0, ""), (3, 0.0, "short"), (4, 1.0, "é abcdefgh")]
    rows = spark.createDataFrame(texts, "doc_id long, label double, text string").repartition(2)
    got = rows.select("label", "text").mapInArrow(toxicity._counted, "gram long, t long, o long, t2 long, o2 long").groupBy("gram").sum("t", "o", "t2", "o2").collect()
    want = {}
    for _, label, text in texts:
        x = text.encode()
        grams = [x[i : i + 7] for i in range(len(x) - 6)]
        for k in set(grams):
            row = want.setdefault(k, [0, 0, 0, 0])
            row[int(label == 0)] += 1
            row[2 + int(label == 0)] += grams.count(k) > 1
    assert {r[0].to_bytes(7, "big"): list(r[1:]) for r in got} == want


def test_chains_cover_the_weightiest_grams():
    grams = {b"abc": 3.0, b"bcd": 2.0, b"cdx": 1.0, b"pqr": 5.0, b"zzz": 0.5}
    assert toxicity.chain(grams, 100) == b"zzz\nabcdx\npqr"
    assert toxicity.chain(grams, 3) == b"pqr" and toxicity.chain({}, 10) == b""


@pytest.mark.parametrize("lang", ["de", "en", "es", "fr"])
def test_toxicity_in_each_language_of_the_given_tables(given_toxicity, lang):
    """Held-out recall, and false alarms, of the query itself."""
    mine = [r for r in given_toxicity if r.lang == lang]
    caught = [r.predicted for r in mine if r.toxic == 1]
    alarms = [r.predicted for r in mine if r.toxic == 0]
    assert len(caught) > 5 and np.mean(caught) >= 0.5 and np.mean(alarms) <= 0.15


@pytest.fixture(scope="module")
def given_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    scores = toxicity.op9_toxicity(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null")
    return scores.join(labels, "doc_id").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()


URLS = [
    ("http://a.net", "a.net", "", None),
    ("http://a.net/", "a.net", "/", ("net/", "block")),
    ("HTTP://Shop.Example.NET/en/x?q=/en/", "shop.example.net", "/en/x", ("example.net/en/", "allow")),
    ("https://example.net/de/#top", "example.net", "/de/", ("net/", "block")),
    ("https://m.example.com/de/1", "m.example.com", "/de/1", ("example.com/de/", "block")),
    ("https://notexample.com/de/1", "notexample.com", "/de/1", None),
    ("http://x.org/fr/", "x.org", "/fr/", ("org/fr/", "allow")),
    ("http://org/fr/a", "org", "/fr/a", ("org/fr/", "allow")),
    ("http://x.org?/fr/", "x.org", "", None),
    ("mailto:x@y.net", "", "", None),
    ("http://a.net/p://b.org/fr/", "a.net", "/p://b.org/fr/", ("net/", "block")),
    ("", "", "", None),
    (None, "", "", None),
]


def test_url_rules(spark):
    rows = [(i, u) for i, (u, *_) in enumerate(URLS)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([*rows, (1, URLS[1][0])], "page_id long, url string")).collect()}
    for i, (_, host, path, ruled) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, ruled and ruled[0]) and r.verdict == (ruled[1] if ruled else ("block" if r.score > 0.5 else "allow"))


def test_urls_learn_from_labels(spark):
    r = random.Random(2)
    rows = [(i, f"http://{'cheap-pills' if i % 2 else 'library'}{r.randrange(99)}.example.com/{'x' * r.randrange(9)}", i % 2) for i in range(400)]
    known = spark.createDataFrame([(u, y) for _, u, y in rows[:300]], "url string, label int")
    got = url_filter.judge(spark.createDataFrame([x[:2] for x in rows[300:]], "page_id long, url string"), rules=[], labelled=known).collect()
    assert np.mean([(r.verdict == "block") == r.page_id % 2 for r in got]) > 0.97
    none = url_filter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules=[]).collect()
    assert [(r.score, r.verdict) for r in none] == [(0.5, "allow")]


def test_raking_meets_targets():
    rng = np.random.default_rng(4)
    sums = rng.integers(1000, 5000, 24).astype(float)
    codes = [np.arange(24) // 6, np.arange(24) % 6 // 3, np.arange(24) % 3]
    targets = [np.array([0.3, 0.3, 0.2, 0.2]), np.array([0.6, 0.4]), np.array([0.25, 0.35, 0.4])]
    p = mixing.rake(sums, codes, targets, budget=0.2)
    kept = sums * p
    assert p.max() <= 1 and kept.sum() == pytest.approx(0.2 * sums.sum(), rel=1e-6)
    for c, t in zip(codes, targets):
        assert np.bincount(c, kept) / kept.sum() == pytest.approx(t, rel=1e-5)
    capped = mixing.rake(np.array([10.0, 1000.0]), [np.array([0, 1])], [np.array([0.5, 0.5])], budget=0.4)
    assert capped[0] == 1 and 0 < capped[1] < 1


def raked(rows, budget=0.4, power=0.7):
    """Each cell's probability, by scaling one margin after the other in plain dicts."""
    have, keep = {}, {}
    for r in rows:
        key = (r.source, r.lang, r.topic)
        have[key] = have.get(key, 0) + r.n_tokens
    total = sum(have.values())
    shares = []
    for m in range(3):
        seen = {}
        for k, n in have.items():
            seen[k[m]] = seen.get(k[m], 0) + n
        flat = {v: n**power for v, n in seen.items()}
        shares.append({v: n / sum(flat.values()) for v, n in flat.items()})
    keep = {k: n * budget for k, n in have.items()}
    for _ in range(200):
        for m in range(3):
            now = {}
            for k, n in keep.items():
                now[k[m]] = now.get(k[m], 0) + n
            keep = {k: min(have[k], n * shares[m][k[m]] * budget * total / now[k[m]]) if now[k[m]] else n for k, n in keep.items()}
    return {k: keep[k] / n if n else budget for k, n in have.items()}


def number(doc_id, text_hash, nth):
    """The draw of a row, in [0, 1)."""
    return int(hashlib.md5(f"mix:{'' if doc_id is None else doc_id}:{text_hash}:{nth}".encode()).hexdigest()[:12], 16) / 2**48


def test_mixing_equals_a_plain_recount(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts) + 1
    by_id = dict(texts)
    for r in rows:
        assert r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id] or ""))
    chance = raked(rows)
    for r in rows:
        assert r.probability == pytest.approx(chance[r.source, r.lang, r.topic], rel=1e-6)
    drawn = mixing.sample(docs)
    assert drawn.columns == docs.columns and sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_the_query_draws_by_raked_probabilities(spark, sf):
    from trovex.llm.queries import QUERIES

    rows = QUERIES["op8_source_mixing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hashes = {r.doc_id: (r.h, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    assert len(rows) == len(hashes)
    chance = raked(rows)
    for r in rows:
        p = chance[r.source, r.lang, r.topic]
        assert r.n_tokens == hashes[r.doc_id][1] and r.probability == pytest.approx(p, rel=1e-5)
        assert r.kept == (number(r.doc_id, hashes[r.doc_id][0], 0) < r.probability)


def test_rows_without_an_id_and_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(None, f"word{i} here", "s", "en") for i in range(400)] + [(7, f"other{i} text", "s", "en") for i in range(400)] + [(8, "the same row", "s", "en")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1)
    got = mixing.mix(docs, topic_of=F.lit("t"), columns=["doc_id", "text"]).collect()
    for group in (None, 7, 8):
        own = [r for r in got if r.doc_id == group]
        kept, p = sum(r.kept for r in own), own[0].probability
        assert len(own) == 400 and abs(kept - 400 * p) < 3 * (400 * p * (1 - p)) ** 0.5
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, topic_of=F.lit("t"), columns=["doc_id", "text"]).collect()))


def test_topics_are_not_languages(spark, sf):
    """Mutual information of topic and language, as a share of what there is to know of the language, with two languages' own vocabularies and at sf0.01."""

    def shared(rows):
        joint, n = {}, len(rows)
        for t, lang in rows:
            joint[t, lang] = joint.get((t, lang), 0) + 1 / n
        of = lambda i: {v: sum(p for k, p in joint.items() if k[i] == v) for v in {k[i] for k in joint}}
        a, b = of(0), of(1)
        return sum(p * math.log(p / a[t] / b[lang]) for (t, lang), p in joint.items()) / -sum(p * math.log(p) for p in b.values())

    got = mixing.mix(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")).select("topic", "lang").collect()
    assert len({t for t, _ in got}) == mixing.TOPICS and shared(got) < 0.15


def test_topics_are_found_and_hold_for_all_texts(spark):
    """Three vocabularies make three topics, whatever the sample; the count of words is the plain one."""
    r = random.Random(8)
    rows = [(i, " ".join(f"w{i % 3}x{r.randrange(30)}" for _ in range(40)) + " the") for i in range(90)] + [(90, None), (91, ""), (92, "w0x1 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for fit_rows in (30, 1000):
        model = spark.sparkContext.broadcast(mixing.fit_topics(docs.select("text"), 3, fit_rows))
        got = {x.doc_id: x for x in mixing.with_topics(docs.select("doc_id", "text"), model).collect()}
        kinds = [{got[i].topic for i in range(90) if i % 3 == k} for k in range(3)]
        assert all(len(k) == 1 for k in kinds) and len(set.union(*kinds)) == 3 and {got[92].topic} == kinds[0]
        assert all(got[i].n_tokens == len((t or "").split()) for i, t in rows)


def test_topics_are_fitted_on_all_texts(spark):
    """Weights are counts over all rows and centres the means of all their rows, however few texts the start is sought among and however rows are dealt."""
    r = random.Random(9)
    rows = [(" ".join(f"w{i % 3}x{r.randrange(30)}" for _ in range(30)) + (" rare" if i == 5 else ""),) for i in range(120)]
    docs = spark.createDataFrame(rows, "text string")
    weight, centres, _ = mixing.fit_topics(docs.repartition(5), 3, 12)
    x = np.concatenate([v for _, v in mixing._vectors(pa.array([t for (t,) in rows]))])
    assert np.allclose(weight, np.log(121 / ((x > 0).sum(axis=0) + 1)))
    x = mixing._unit(x * weight)
    near = (x @ centres.T).argmax(axis=1)
    assert np.allclose(centres, mixing._unit(np.stack([x[near == i].sum(axis=0) for i in range(3)])), atol=1e-6)
    again = mixing.fit_topics(docs.repartition(2), 3, 12)
    assert (again[0] == weight).all() and np.allclose(again[1], centres, atol=1e-12)


def test_unmet_margins_are_told(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "x", "t", 1000)], "source string, lang string, topic string, n_tokens long")
    with pytest.warns(UserWarning, match="from its target"):
        got = mixing.factors(cells, {"source": {"a": 0.5, "b": 0.5}}, budget=0.4).collect()
    assert {r.margin_gap > 0.4 for r in got} == {True}
    assert {r.margin_gap < 1e-6 for r in mixing.factors(cells, {"source": {"a": 0.01, "b": 0.99}}, budget=0.4).collect()} == {True}


def test_urls_of_suffixes_left_out(spark):
    """Suffix rates of a row's own fold don't reach its training features; lexical signs carry over to new suffixes."""
    r = random.Random(3)
    rows = [(f"http://{'a' * r.randrange(3, 9)}{r.randrange(10**9) if i % 2 else ''}.site{i % 12}.t{i % 12}/x", i % 2) for i in range(600)]
    known = spark.createDataFrame(rows, "url string, label int").select("url", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"), "label")
    folds = url_filter.held_out_accuracy(known)
    assert len(folds) > 1 and all(share > 0.95 for _, _, share, _ in folds)
    rates = url_filter.Rates(["a.b.c", "x.b.c", "q.z"], [1, 1, 0])
    assert rates.of("a.b.c", url_filter.fold_of("a.b.c"))[2:] == [rates.share, 0.0] and rates.of("a.b.c")[2] > rates.share


def test_urls_of_an_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://a.net/", "x", 0.1, "h"), (2, None, None, None, None)], "page_id long, url string, rule string, score double, host string")
    assert url_filter.judge(pages.limit(0)).count() == 0
    got = {x.page_id: (x.host, x.rule) for x in url_filter.judge(pages).collect()}
    assert got == {1: ("a.net", "net/"), 2: ("", None)}


def test_mixing_edge_cases(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    df = spark.createDataFrame([(1, "a b", None, "s"), (2, None, "en", None), (None, "", None, None), (3, "c", "en", "s")], "doc_id long, text string, lang string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 4 and all(0 <= r.probability <= 1 and r.kept is not None for r in got)
    with pytest.raises(ValueError, match="more than 1 cells"):
        mixing.factors(df.selectExpr("source", "lang", "'t' topic", "1L n_tokens"), max_cells=1)
