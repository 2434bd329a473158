"""Merkle manifest, whitening and language identification against plain recounts, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.llm import langid, merkle, queries, whitening


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else None, i % 2 == 1))
        i //= 2
    return out


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> what the query returns."""
    show = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        own = h("".join(map(show, r)))
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
        shown = h("".join(show(v + 1 if k == 3 and v is not None else v) for k, v in enumerate(r))) if bad else own
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, own, shown, r[0]))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k])]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    root, out = top[-1][0], []
    for a, k in enumerate(names):
        for i, x in enumerate(sorted(groups[k])):
            steps, up = path(trees[k], i) + path(top, a), x[3]
            for s, left in steps:
                up = h(up if s is None else s + up if left else up + s)
            out.append((x[4], x[2], trees[k][-1][0], root, h("".join(s for s, _ in steps if s)), up, up == root))
    return out


def key(rows):
    return sorted(map(str, rows))


@pytest.fixture(scope="module")
def odd_docs(spark, tmp_path_factory):
    """Documents with nulls in every column, repeated rows, one id with several texts, languages of one row, and a very long text."""
    r = random.Random(3)
    rows = [(i, f"s{i % 3}", ["en", "de", None, "", "ü"][min(i % 9, 4)], i, f"text {i} é") for i in range(300)]
    rows += [(None, None, None, None, None), (None, "a", "en", 5, "x"), (7, "b", "en", None, "same id"), (7, "b", "en", 2, "same id too"), rows[10], rows[10], (400, "s", "lone", 1, ""), (401, "s", "en", 3, "long " * 50_000)]
    r.shuffle(rows)
    at = str(tmp_path_factory.mktemp("odd"))
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    frame.withColumns({c: F.lit(1) for c in ("node", "pos", "group", "steps")}).repartition(5).write.parquet(f"{at}/documents.parquet")
    return at, rows


def test_manifest_of_odd_rows(spark, odd_docs):
    at, rows = odd_docs
    got = [tuple(r) for r in queries.QUERIES["op11_merkle_manifest"](spark, at).collect()]
    assert key(got) == key(brute(rows))
    assert any(not r[-1] for r in got)


@pytest.mark.parametrize("bits", [1, 3])
def test_rounds_of_blocks_change_nothing(spark, odd_docs, bits):
    at, rows = odd_docs
    d = spark.read.parquet(f"{at}/documents.parquet")
    leaves = d.select("doc_id", "lang", merkle.leaf(*[F.col(c) for c in queries.FIELDS]).alias("leaf"))
    out = merkle.manifest(leaves, F.col("lang"), "doc_id", "leaf", bits=bits)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, h("".join(s.sibling for s in r.steps if s.sibling))) for r in out.collect()]
    assert key(got) == key(r[:5] for r in brute(rows))
    assert out.where(merkle.folded("leaf", "steps") != F.col("root")).count() == 0


def test_an_appender_never_closed_early_equals_all_levels():
    for n in range(1, 40):
        nodes = [h(str(i)) for i in range(n)]
        tree = merkle.Appender()
        for x in nodes:
            tree.append(x)
        assert [t[0] for t in tree.open] == [i for i in range(8, -1, -1) if n >> i & 1]  # one open subtree for each bit
        root, witnesses = tree.close(max(n - 1, 0).bit_length())
        want = levels(nodes)
        assert root == want[-1][0]
        assert [[(s, left) if s else (None, False) for left, s in w] for w in witnesses] == [[(s, left) if s else (None, False) for s, left in path(want, i)] for i in range(n)]


def test_no_rows(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_merkle_manifest", "op12_embedding_whitening", "op13_language_id"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# whitening


def plain(x, k):
    """whitened (up to signs), eigenvalues and trace, by a dense solver."""
    c = x - x.mean(axis=0)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return c @ u / np.sqrt(e), e, np.trace(v)


def written(spark, path, rows, kind="float"):
    spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component int, n string").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def check_whitening(spark, at, vectors, k):
    pdf = queries.QUERIES["op12_embedding_whitening"](spark, at).toPandas()
    x = np.floor(64 * np.array([v for _, v in vectors], np.float64)) + 1_000_000
    want, e, trace = plain(x, k)
    assert len(pdf) == len(x) * k and set(pdf["n"]) == {len(x)}
    got = pdf.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in vectors]].to_numpy()
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-6
    assert pdf["identity_error"].nunique() == 1 and pdf["identity_error"].max() < 1e-9
    shares = pdf.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(shares, e / trace, rtol=1e-10) and (np.diff(shares) <= 0).all()
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*whole)]
    dev = {i: sum((len(x) * v - s) ** 2 for v, s in zip(row, sums)) for (i, _), row in zip(vectors, whole)}
    assert all(dev[r.vec_id] == r.deviation for r in pdf.itertuples())


def test_whitening_equals_a_dense_solver(spark, sf):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check_whitening(spark, sf, vectors, 32)


def test_whitening_skips_bad_vectors(spark, tmp_path):
    r = np.random.default_rng(1)
    good = [(i, (r.standard_normal(6) * [9, 5, 3, 2, 1.5, 1] + 40).astype("f4").tolist()) for i in range(200)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [0.0] * 5 + [float("-inf")])]
    at = written(spark, tmp_path, [(i, v, 1, "x") for i, v in good + bad])
    check_whitening(spark, at, good, 6)


def test_directions_without_variance_and_repeated_rows(spark, tmp_path):
    r = np.random.default_rng(2)
    base = r.standard_normal((3, 8))
    rows = [(None if i == 4 else i, ((r.standard_normal(3) @ base) * 64).round().tolist(), 1, "x") for i in range(20)]
    rows = [(i, [float(round(a * 4) // 4) for a in v], c, n) for i, v, c, n in rows] + [(1, [1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1, "x")] * 2
    at = written(spark, tmp_path, [(i, v[:2] + [v[0] + v[1]] * 2 + [3.0] * 4, c, n) for i, v, c, n in rows], "double")
    pdf = queries.QUERIES["op12_embedding_whitening"](spark, at).toPandas()
    assert set(pdf["component"]) == {1, 2} and len(pdf) == 2 * len(rows) and pdf["identity_error"].max() < 1e-9
    assert pdf["vec_id"].isna().sum() == 2 and pdf["explained"].drop_duplicates().sum() == pytest.approx(1)


def test_equal_vectors_have_no_component_and_odd_widths_are_an_error(spark, tmp_path):
    at = written(spark, tmp_path / "a", [(i, [1.0, 2.0], 1, "x") for i in range(5)])
    assert queries.QUERIES["op12_embedding_whitening"](spark, at).count() == 0
    at = written(spark, tmp_path / "b", [(1, [1.0, 2.0], 1, "x"), (2, [1.0], 1, "x")])
    with pytest.raises(ValueError, match="widths"):
        queries.QUERIES["op12_embedding_whitening"](spark, at)


@pytest.mark.parametrize("values", [[5.0, 5.0, 5.0, 1.0], [1e-9, 1.0, 1.0 + 1e-7, 2.0], list(np.linspace(0.1, 9, 40)), [7.0] * 12 + [3.0] * 3 + [0.0] * 5])
def test_counts_and_contours_find_all_eigenvalues(spark, values):
    q, _ = np.linalg.qr(np.random.default_rng(len(values)).standard_normal((len(values),) * 2))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    shifts = [-1.0, 0.5, 4.0, 6.0]
    assert whitening.above(whitening.tridiagonal(v), shifts).tolist() == [sum(x > s for x in values) for s in shifts]
    k = min(10, sum(x > 1e-12 for x in values))
    got, vectors = whitening.eigenpairs(spark, v, k)
    assert np.allclose(got, sorted(values, reverse=True)[:k], atol=1e-9) and np.abs(v @ vectors - vectors * got).max() < 1e-8
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12


# language


def phrases(text: bytes, learned: bytes) -> int:
    n = i = 0
    while i < len(text):
        k = i + 1
        while k < len(text) and text[i : k + 1] in learned:
            k += 1
        n, i = n + 1, k
    return n


def flat(texts):
    raw = b"".join(texts)
    return np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))


def test_parses_equal_plain_longest_matches(monkeypatch):
    r = random.Random(4)
    learned = [bytes(r.choice(b"ab c\xc3\xa9") for _ in range(300)), bytes(r.choice(b"abx ") for _ in range(200)), b"q"]
    made = []
    for i, t in enumerate(learned):
        a = langid.Automaton(t)
        made.append((f"l{i}", len(t), a.states, a.moves))
    parser = langid.Parser(made)
    texts = [bytes(r.choice(b"abcx \xc3\xa9?") for _ in range(n)) for n in (0, 1, 2, 50, 700, 64, 65)]
    buf, off = flat(texts)
    assert parser.phrases(buf, off).tolist() == [[phrases(t, x) for x in learned] for t in texts]
    monkeypatch.setattr(langid, "PIECE", 64)
    monkeypatch.setattr(langid, "LANES", 1)
    want = [[sum(phrases(t[k : k + 64], x) for k in range(0, len(t), 64)) for x in learned] for t in texts]
    assert parser.phrases(buf, off).tolist() == want


def test_symbols_of_texts():
    buf, off = flat([b"  ab1c..", b"", b"!", "é x".encode()])
    sym, first = langid.symbols(buf, off)
    parts = [sym[first[i] : first[i + 1]].tobytes() for i in range(4)]
    assert parts == [b"\0ab\0c\0", b"", b"\0", "é\0x".encode()]


def test_languages_held_out(spark, sf):
    sf = sf.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.QUERIES["op13_language_id"](spark, sf).collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows.keys() == true.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    for lang in set(true.values()):
        own = [r for i, r in rows.items() if true[i] == lang and r.held_out]
        assert sum(r.lang_pred == lang for r in own) >= 0.97 * len(own) > 20


def test_language_of_odd_rows(spark, tmp_path):
    en = [(i, f"the river and the stone of winter number {i} with copper lanterns", "en") for i in range(30)]
    de = [(100 + i, f"der Fluss und die Steine im Winter Nummer {i} mit kupfernen Laternen", "de") for i in range(30)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 !? 3\n", "de"), (503, "der Fluss und die Steine", None), (None, "the river and the stone", "en"), (505, "the river and the stone " * 20_000, None), (506, "中文", None), en[3], en[3]]
    frame = spark.createDataFrame([(*r, "x") for r in en + de + odd], "doc_id long, text string, lang string, score string")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_language_id"](spark, str(tmp_path)).collect()]
    assert len(got) == len(en + de + odd)
    by = {r[0]: r for r in got}
    assert [by[i][2:] for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert by[503][2] == "de" and by[None][1:3] == (False, "en") and by[505][2] == "en" and by[506][2] in ("de", "en")
    assert all(by[i][2] == lang for i, _, lang in en + de)
    none = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(none, langid.learn(none)).collect()} == {"und"}


def test_more_languages_than_the_automata_may_take(spark, monkeypatch):
    rows = spark.createDataFrame([(f"l{i}", f"text of {i}") for i in range(5)], "lang string, text string")
    assert [x[0] for x in langid.learn(rows)] == [f"l{i}" for i in range(5)]
    monkeypatch.setattr(langid, "TOTAL", 4 * langid.WINDOW)
    with pytest.raises(ValueError, match="more than 4 languages"):
        langid.learn(rows)
