"""SimHash near-duplicates and substring dedup against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from trovex.llm import near_copies, simhash, substring_dedup
from pyspark.sql import functions as F

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints):
    """doc_id -> least reachable id, by comparing all pairs."""
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if i < j and bin(a ^ b).count("1") <= 2:
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i, _ in prints}


def test_simhash_equals_brute_force(docs, texts):
    prints = [(i, fingerprint(t)) for i, t in texts]
    want = classes(prints)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == dict(prints)
    assert {r.doc_id: r.component_id for r in got} == want
    assert want[21] == want[20] == 3 and want[28] == want[29] == 27


@pytest.mark.parametrize("small", [0, 2, 64])
def test_links_connect_what_brute_force_connects(spark, small):
    """Clusters of near fingerprints, dense enough for large buckets, with every split of the differing bits over the halves."""
    r = random.Random(5)
    values = set()
    for _ in range(6):
        base = r.getrandbits(64)
        for _ in range(30):
            values.add(base ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3]))))
    values = sorted(values)
    want = classes(list(enumerate(values)))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.links(df, small)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {}
    for i, v in enumerate(signed):
        got.setdefault(roots.get(v, v), []).append(i)
    assert {i: min(c) for c in got.values() for i in c} == want
    for e in edges.collect():
        assert bin((e.a ^ e.b) & ((1 << 64) - 1)).count("1") <= 2


def test_components_of_a_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    assert {r.node: r.root for r in simhash.components(chain).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}
    assert simhash.components(chain.limit(0)).count() == 0


def test_keep_one_keeps_columns_and_clean_rows(docs, texts, empty):
    kept = simhash.keep_one(docs)
    want = {i for i, c in classes([(i, fingerprint(t)) for i, t in texts]).items() if i == c}
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert simhash.keep_one(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, "q w e r t y u")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (None, 4), (4, 4), (None, None)], key=str)
    assert simhash.keep_one(df).count() == 2


def brute_repeats(texts, window):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("window", "group_rows"), [(20, 2000), (20, 1), (7, 2000), (7, 2), (3, 3)])
def test_substrings_equal_brute_force(docs, texts, window, group_rows):
    got = substring_dedup.strip_repeats(docs, window, group_rows).withColumn("sha", F.sha2("kept_text", 256)).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got} == brute_repeats(texts, window)


def test_substrings_edge_cases(spark, empty):
    assert substring_dedup.strip_repeats(empty).count() == 0
    words = " ".join(map(str, range(25)))
    df = spark.createDataFrame([(None, words), (5, words), (5, words + " x"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.strip_repeats(df).collect()), key=str)
    assert (5, 25, 0) in got and (None, 25, 25) in got and (None, 0, 0) in got


def test_columns_come_back_as_they_were(docs):
    got = substring_dedup.strip_repeats(docs, columns=docs.columns)
    assert got.columns == [*docs.columns, "kept_text", "n_words", "n_removed"]
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, docs.collect()))


def test_keep_one_tells_rows_apart_without_or_under_one_id(spark):
    near, other = prose(1, 60), prose(2, 60)
    df = spark.createDataFrame([(None, near), (None, other), (7, prose(3, 60)), (7, near), (5, near), (None, prose(4, 60)), (None, prose(4, 60))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(df).collect()), key=str)
    assert got == sorted([(5, near), (None, other), (7, prose(3, 60)), (None, prose(4, 60))], key=str)


def runs_of(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}


@pytest.mark.parametrize("small", [near_copies.SMALL, 2])
def test_near_copies_equal_brute_force(spark, texts, small):
    """Copies with some words changed or cut, on both sides of 0.8, many of one text, and short ones."""
    r = random.Random(5)
    rows = [t for _, t in texts]
    for k in range(12):
        base = " ".join(f"w{k}x{r.randrange(10**6)}" for _ in range(200)).split()
        rows += [" ".join("new" if i in cut else w for i, w in enumerate(base)) for cut in ([], [9], r.sample(range(200), 3), r.sample(range(200), 12), range(0, 20), range(0, 60))]
    rows += [rows[-6].replace(" ", f" {i} ", 1) for i in range(40)]
    long = [f"v{i}" for i in range(700)]  # a chain: the ends share no run, so no one centre links all members
    rows += [" ".join(long[12 * i : 12 * i + 250]) for i in range(36)]
    passage = " ".join(f"p{i}" for i in range(90))  # held by texts that differ otherwise
    rows += [f"{passage} {' '.join(f'q{k // 2}z{i}' for i in range(60 if k % 2 else 64))}" for k in range(60)]
    sets = [runs_of(t) for t in rows]
    roots = list(range(len(rows)))
    for b in range(len(rows)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and roots[a] != roots[b]:
                low, high = sorted((roots[a], roots[b]))
                roots = [low if x == high else x for x in roots]
    got = near_copies.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), small=small)
    assert {x.doc_id: x.component_id for x in got.collect()} == dict(enumerate(roots))


def test_pipeline_drops_copies_beyond_two_bits(spark, sf):
    base = [f"w{i}" for i in range(200)]
    near = [" ".join("new" if i in cut else w for i, w in enumerate(base)) for cut in ([], (20, 90, 150))]
    assert 0.8 <= len(runs_of(near[0]) & runs_of(near[1])) / len(runs_of(near[0]) | runs_of(near[1])) and bin(fingerprint(near[0]) ^ fingerprint(near[1])).count("1") > 2
    df = spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect()] == [0]


def test_fingerprints_are_majorities_of_run_hashes():
    """Texts of one run, of an even number (ties) and of more than the bytes hold that votes are added up in."""
    texts = ["one", " ".join(f"a{i}" for i in range(8)), " ".join(f"b{i}" for i in range(9000))]
    ((_, _, runs, at),) = near_copies.distinct_runs(pa.array(texts), 5)
    got = np.unpackbits(near_copies.prints(runs, at), axis=1)
    for t in range(3):
        own = runs[at[t] : at[t + 1]]
        for i in (0, 31):
            h = near_copies.mix(own ^ near_copies._XOR[i])
            votes = [int(((h >> np.uint64(8 * lane + k)) & np.uint64(1)).sum()) for k in range(8) for lane in range(8)]
            assert got[t, 64 * i : 64 * i + 64].tolist() == [int(2 * v > len(own)) for v in votes]


def test_segments_meet_texts_at_the_bound(spark):
    """Pairs of similarity 0.8 and little above, long and short, share a segment; the fingerprints propose them and hardly others."""
    r, rows = random.Random(11), []
    for k in range(400):
        n = r.choice([4, 5, 9, 12, 40, 300, 2000])
        rows.append((np.array([r.getrandbits(63) for _ in range(n)], np.uint64)))
        rows.append(np.concatenate((rows[-1], np.array([r.getrandbits(63) for _ in range(n // 4)], np.uint64))))
    at = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    found = near_copies.prints(np.concatenate(rows), at)
    fields = [(i, len(x), bytearray(found[i]), [int(v) for v in x] if len(x) <= near_copies.SHORT else []) for i, x in enumerate(rows)]
    nodes = spark.createDataFrame(fields, "node long, n int, print binary, few array<long>")
    met = {(x.a, x.b) for x in near_copies.proposals(nodes, 0.8).where("not many").collect()}
    assert {(i, i + 1) for i in range(0, 800, 2)} <= met and len(met) < 500


def test_meeting_is_the_same_in_batches_of_any_size():
    r = np.random.default_rng(3)
    key = np.sort(np.concatenate([np.repeat(7, 90), r.integers(0, 60, 200)])).astype(np.int32)
    c = r.integers(0, 3, (len(key), 2)) - 1
    rows = pa.table({"key": key, "node": np.arange(len(key)), "c0": c[:, 0], "c1": c[:, 1]})
    met = []
    for size in (1, 7, 10_000):
        out = [x for b in near_copies._meet(20, 43)(iter(rows.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        met.append(sorted((x["a"], x["b"], x["many"]) for x in out))
    small = [n for n in range(len(key)) if (key == key[n]).sum() <= 20]
    first = int(np.flatnonzero(key == 7)[0])
    differ = lambda i, j: sum(bin((int(x) ^ int(y)) & (2**64 - 1)).count("1") for x, y in zip(c[i], c[j]))
    want = [(i, j, False) for i in small for j in small if i < j and key[i] == key[j] and differ(i, j) <= 43]
    want += [x for j in np.flatnonzero(key == 7).tolist() for x in [(7, j, True)] + [(first, j, False)] * (j != first and differ(first, j) <= 43)]
    assert met[0] == met[1] == met[2] == sorted(want)


def test_near_dedup_runs_no_job_for_each_partition(spark, sf):
    """What the driver gathers (bitmap, counts of runs) comes in one job each, however many partitions a shuffle has."""
    rows = [f"{' '.join(f'w{i}' for i in range(100))} {' '.join(f'{k // 3}x{i}' for i in range(k % 3, 12))}" for k in range(120)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    spark.sparkContext.setJobGroup("near_dedup", "near_dedup")
    try:
        near_copies.near_duplicates(df, small=2).count()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near_dedup")) < 150
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_parities_never_exceed_what_two_texts_differ_in():
    r = np.random.default_rng(9)
    sets = [r.choice(5000, r.integers(1, 900), replace=False) * 7919 for _ in range(30)]
    sets += [np.concatenate((s[: len(s) - 3], [11, 13])) for s in sets[:10]]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    w = near_copies.parities(np.concatenate(sets).astype(np.int64), at).view(np.uint64)
    for i in range(len(sets)):
        for j in range(i):
            apart = len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
            assert sum(int(a ^ b).bit_count() for a, b in zip(w[i], w[j])) <= apart


def join_rows(df) -> list[int]:
    """Runs df and gives the rows that each of its joins made."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    made, plans = [], [plan]
    while plans:
        plan = plans.pop()
        if "Join" in plan.nodeName():
            made.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return made


def test_leaves_of_a_large_node_meet_their_first_by_salts(spark):
    """A node of 3,000 leaves in 6 salts and one of 1: each leaf but the first is a repeat, ties are all firsts, and no join makes a row for each leaf."""
    rows = [(1, 2, i, 7 + i % 2, i % 3, bytearray(b"c"), 6) for i in range(3000)] + [(1, 2, 0, 9, 0, bytearray(b"c"), 6), (5, 5, 4, 4, 4, bytearray(b"d"), 2)]
    leaves = spark.createDataFrame(rows, "key long, other long, k long, th long, start int, ctx binary, salts long")
    was = {name: spark.conf.get(name) for name in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for name, value in zip(was, ("false", "-1")):
            spark.conf.set(name, value)
        later, first = substring_dedup._later(leaves)
        assert sorted(tuple(r) for r in later.select("k", "th", "start").collect()) == [(i, 7 + i % 2, i % 3) for i in range(1, 3000)]
        assert sorted(tuple(r) for r in first.select("k", "th", "start", "salts").collect()) == [(0, 7, 0, 6), (0, 9, 0, 6), (4, 4, 4, 2)]
        for part in substring_dedup._later(leaves):
            made = join_rows(part.select("k", "th", "start"))
            assert made and max(made) <= 7
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
