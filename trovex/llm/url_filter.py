"""URL filters: gradient-boosted trees on lexical features, with allow and block rules above them (operator 1).

Features: lengths, depth, ratios of digits and other characters, entropy, parameters, and for each host suffix (last
label, last two) how often labelled URLs with it were blocked, shrunk to the share of all. A labelled URL's own suffix
doesn't decide its features: hosts fall into FOLDS by their last two labels, and for the forest's training the rates come from
the other folds. Training takes a bounded sample of labelled URLs (`max_rows` distinct ones of least hash). The query's
labelled URLs are those of the table that a rule judges, since the table has no other labels: the forest learns what the
rules block and judges the URLs that no rule reaches. `held_out_accuracy` tells how well, on suffixes left out.

Edge cases: a null URL, or one without `://`, has empty host and path, fits no rule and is judged by its features; an
empty URL likewise; repeated rows are judged each; of several labels for one URL the highest counts; without labelled
URLs the score is 0.5 and the verdict allow; of rules of one length that fit, the later in order of letters decides; very
long URLs are judged whole; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbdt

MAX_ROWS = 20_000
THRESHOLD = 0.5
WIDTH = 22  #: features of a URL
FOLDS = 5
WEIGHT = 20.0  #: URLs that the share of all counts for in a suffix's rate
#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct<rule,verdict>, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # the longest decides last
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _suffixes(host: str) -> tuple[str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:])


class Rates:
    """How often labelled URLs with a suffix were blocked, by folds of hosts."""

    def __init__(self, hosts: list[str], labels: list[int]):
        self.share = (sum(labels) + 0.5) / (len(labels) + 1)
        self.seen: dict[str, np.ndarray] = {}  # suffix -> for each fold: blocked, seen
        for host, label in zip(hosts, labels):
            for s in _suffixes(host):
                self.seen.setdefault(s, np.zeros((FOLDS, 2)))[fold_of(host)] += label, 1

    def of(self, host: str, without: int | None = None) -> list[float]:
        out = []
        for s in _suffixes(host):
            every = self.seen.get(s)
            blocked, n = (0.0, 0.0) if every is None else every.sum(axis=0) - (0 if without is None else every[without])
            out += [(blocked + WEIGHT * self.share) / (n + WEIGHT), np.log1p(n)]
        return out


def fold_of(host: str) -> int:
    return zlib.crc32(_suffixes(host)[1].encode()) % FOLDS


def features(url: str | None, host: str, path: str, rates: Rates, without: int | None = None) -> list[float]:
    """without: the fold that suffix rates leave out."""
    url = url or ""
    n = max(len(url), 1)
    count = Counter(url)
    query = url.partition("#")[0].partition("?")[2]
    labels = host.split(".")
    out = [
        len(url), len(host), len(path), path.count("/"), len(labels), max(map(len, labels)),
        sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host) / max(len(host), 1), sum(not c.isalnum() for c in url) / n,
        host.count("-"), -sum(c / n * log2(c / n) for c in count.values()), query.count("&") + (query != ""), len(query),
        url.startswith("https"), "#" in url, url.endswith("/"), len(path.rpartition(".")[2]) if "." in path else 0,
        len(set(host)) / max(len(host), 1),
    ]
    return [float(x) for x in [*out, *rates.of(host, without)]]


def _sample(labelled: DataFrame, max_rows: int) -> list:
    """labelled: (url, host, path, label)."""
    rows = labelled.where("url is not null and label is not null").groupBy("url", "host", "path").agg(F.max("label").cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("url"), "url").limit(max_rows).collect()


def _fit(sample: list) -> tuple[gbdt.Forest, Rates]:
    rates = Rates([r.host for r in sample], [r.label for r in sample])
    x = np.array([features(r.url, r.host, r.path, rates, fold_of(r.host)) for r in sample], float).reshape(len(sample), WIDTH)
    return gbdt.fit(x, np.array([float(r.label) for r in sample]), trees=40), rates


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> tuple[gbdt.Forest, Rates]:
    """labelled: (url, host, path, label)."""
    return _fit(_sample(labelled, max_rows))


def held_out_accuracy(labelled: DataFrame, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> list[tuple[int, int, float, float]]:
    """(fold, URLs, share judged as labelled, share of the commoner label) for each fold of suffixes, by a forest of the others."""
    sample, out = _sample(labelled, max_rows), []
    for f in range(FOLDS):
        rest, own = ([r for r in sample if (fold_of(r.host) == f) == mine] for mine in (False, True))
        if own and rest:
            forest, rates = _fit(rest)
            p = forest.predict(np.array([features(r.url, r.host, r.path, rates) for r in own]))
            y = np.array([r.label for r in own])
            out.append((f, len(own), float(((p > threshold) == y).mean()), float(max(y.mean(), 1 - y.mean()))))
    return out


def _known(rows: DataFrame) -> DataFrame:
    return rows.where("ruled is not null").select("url", "host", "path", (F.col("ruled.verdict") == "block").cast("int").alias("label"))


def _read(pages: DataFrame, rules) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row. labelled: (url, label 1 to block), else what the rules judge."""
    rows = _read(pages, rules)
    if labelled is None:
        known = _known(rows)
    else:
        known = labelled.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label")
    model = pages.sparkSession.sparkContext.broadcast(train(known, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rates = model.value
        for b in batches:
            if b.num_rows:
                x = [features(*r, rates) for r in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
                p = pa.array(forest.predict(np.array(x)))
                yield pa.RecordBatch.from_arrays([b.column(i) for i in (0, 2, 3, 4, 5)] + [p], ["page_id", "host", "path", "rule", "by_rule", "score"])

    kind = dict(pages.dtypes)["page_id"]
    flat = rows.select("page_id", "url", "host", "path", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("by_rule"))
    out = flat.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, by_rule string, score double")
    learnt = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", learnt).alias("verdict"), "score")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
