"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Topics are derived: texts are vectors of hashed terms (log counts, weighted by how few texts have the term), clustered by
spherical k-means: term weights, languages and centres are those of all rows, whose vectors are stored once and read once a round, and a
few texts (`FIT_ROWS` of least hash) only say where the centres start; every text takes its nearest centre's topic. What
tells languages apart is taken out first, by projecting off the span of the mean vectors of each language: else topics
would be languages again, and their margin no news.
Tokens (words) are summed for each cell of source, language and topic. Starting from an equal share of each cell, the
tokens to keep are raked: multiplied, margin by margin, until every source, language and topic has its target share of
`budget` times all tokens. No cell gives more than it has; what it lacks the others of its margin make up as far as
targets allow; `margin_gap` tells how far the worst margin stays from its target, and a gap over TOLERANCE is warned of. A document is kept with its cell's probability, tokens to keep over tokens there. The draw is a hash of
the id and the text, so rows are drawn one by one, with or without an id, and alike on every run; rows that are equal in both are
told apart by their number within their task.

Only sums over all rows and the few texts' vectors come to the driver; of cells `max_cells` at most, beyond which the call fails rather than drop any.
Default targets flatten the observed shares by a power, so they need no numbers from outside.

Edge cases: a null source, language or topic is a value of its own; null and empty texts have 0 tokens and take their
cell's probability, which is the budget where the cell has no tokens; null ids are drawn like the id ''; repeated rows are drawn each on its own; an
empty table gives no rows; very long texts count whole; a text equally near to several centres takes the first; targets for values
that don't occur are spread over those that do; columns of docs stay, and a new column whose name is taken gets underscores.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, slices, stored, word_hashes, words

MARGINS = ("source", "lang", "topic")
POWER = 0.7
BUDGET = 0.4
MAX_CELLS = 1_000_000
ROUNDS = 200

TOPICS, DIM = 8, 1024
FIT_ROWS = 2000  #: texts among which the centres' first places are sought
STARTS = 5  #: of that search; the best is kept
FIT_ROUNDS = 4  #: over all rows, at most; fewer where no row changes its topic
BLOCK = 512  #: rows whose vectors are held at once
TOLERANCE = 0.01


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For blocks of rows: their numbers of words, and log counts of their hashed words."""
    for _, _, buf, off in slices(column):
        buf = LOWER[buf]
        starts, ends, first = words(buf, off, NOT_SPACE)
        slot = (word_hashes(buf, starts, ends) % np.uint64(DIM)).astype(np.int64)
        count = np.diff(first)
        for lo in range(0, len(count), BLOCK):
            n = count[lo : lo + BLOCK]
            row = np.repeat(np.arange(len(n)), n)
            x = np.bincount(row * DIM + slot[first[lo] : first[lo + len(n)]], minlength=len(n) * DIM).reshape(len(n), DIM)
            yield n, np.log1p(x)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


SPARSE = "slots array<int>, counts array<int>, lang string, h long"
FIXED = float(1 << 30)  #: entries of unit vectors are summed as whole numbers, so that sums don't depend on how rows are dealt


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of hashed words of each text that has any."""
    for b in batches:
        at = 0
        for n, x in _vectors(b.column(0)):
            some = np.flatnonzero(n)
            row, slot = np.nonzero(x[some])
            off = pa.array(np.searchsorted(row, np.arange(len(some) + 1)), pa.int32())
            count = np.rint(np.expm1(x[some][row, slot])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(off, pa.array(v, pa.int32())) for v in (slot, count)]
            yield pa.RecordBatch.from_arrays([*lists, *(b.column(i).slice(at, len(n)).take(pa.array(some)) for i in (1, 2))], ["slots", "counts", "lang", "h"])
            at += len(n)


def _dense(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Log counts and languages of a stored batch, by blocks."""
    for lo in range(0, b.num_rows, BLOCK):
        part = b.slice(lo, BLOCK)
        x = np.zeros((part.num_rows, DIM))
        slots, counts = part.column(0), part.column(1)
        row = np.repeat(np.arange(part.num_rows), np.diff(slots.offsets.to_numpy()))
        x[row, slots.flatten().to_numpy()] = np.log1p(counts.flatten().to_numpy())
        yield x, part.column(2)


def _summed(vectors: DataFrame, of) -> DataFrame:
    """(key, sums array<long>), ordered by key. of gives pairs of a key and whole numbers, DIM columns, for a block; sums end with the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            keys = pa.array([k for k in held for _ in range(DIM + 1)], pa.string())
            values = np.concatenate(list(held.values())) if held else np.zeros(0, np.int64)
            slot = np.tile(np.arange(DIM + 1, dtype=np.int32), len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([keys, pa.array(slot), pa.array(values)], ["key", "slot", "value"])

        for b in batches:
            for x, lang in _dense(b):
                for key, rows in of(x, lang):
                    held[key] = held.get(key, 0) + np.append(rows.sum(axis=0), len(rows)).astype(np.int64)
                if len(held) > 64:
                    yield out()
        yield out()

    each = vectors.mapInArrow(run, "key string, slot int, value long").groupBy("key", "slot").agg(F.sum("value").alias("value"))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("all")).select("key", F.col("all.value").alias("sums")).orderBy("key")


def _seeds(x: np.ndarray, topics: int) -> np.ndarray:
    """Centres to start from: the best of STARTS clusterings of a few vectors."""
    rng, best = np.random.default_rng(7), (-1.0, x[:1])
    for _ in range(STARTS):
        centres = x[[rng.integers(len(x))]]
        while len(centres) < min(topics, len(x)):  # texts far from all centres so far are likelier to be the next
            far = np.clip(1 - (x @ centres.T).max(axis=1), 0, None) ** 2
            centres = np.concatenate((centres, x[[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0]]))
        for _ in range(20):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.stack([x[near == i].sum(axis=0) for i in range(len(centres))])
            centres = np.where((np.bincount(near, minlength=len(centres)) > 0)[:, None], _unit(sums), centres)
        best = max(best, (float((x @ centres.T).max(axis=1).sum()), centres), key=lambda p: p[0])
    return best[1]


def fit_topics(texts: DataFrame, topics: int = TOPICS, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term weights, centres and the directions that are taken out, all from every row of texts (text, and lang if there is one).

    Only the centres' first places come from a few rows, the fit_rows texts of least hash; then all rows move them.
    """
    lang = F.col("lang").cast("string") if "lang" in texts.columns else F.lit(None).cast("string")
    hashed = texts.where("text is not null").select("text", lang.alias("lang"), F.xxhash64("text").alias("h"))
    vectors = stored(hashed.mapInArrow(_sparse, SPARSE))
    got = _summed(vectors, lambda x, _: [("", (x > 0).astype(np.int64))]).collect()
    if not got or not got[0].sums[-1]:
        return np.ones(DIM), np.zeros((1, DIM)), np.zeros((DIM, 0))
    *often, n = got[0].sums
    weight = np.log((n + 1) / (np.array(often) + 1))

    def by_lang(x: np.ndarray, langs: pa.Array):
        names = np.array(langs.to_pylist(), object)
        fixed = np.rint(_unit(x * weight) * FIXED).astype(np.int64)
        for v in {v for v in names if v is not None}:
            yield v, fixed[names == v]

    # the span of the languages' means, of very many the directions of most length: a language's row is added up and let go
    gram, named = np.zeros((DIM, DIM)), 0
    for r in _summed(vectors, by_lang).toLocalIterator():
        mean = np.array(r.sums[:-1]) / FIXED / r.sums[-1]
        gram += np.outer(mean, mean)
        named += 1
    out = np.zeros((DIM, 0))
    if named > 1:
        size, left = np.linalg.eigh(gram)
        out = left[:, ::-1][:, size[::-1] > 1e-10 * size[-1]][:, : DIM // 4]

    def placed(x: np.ndarray) -> np.ndarray:
        x = _unit(x * weight)
        return _unit(x - (x @ out) @ out.T)

    first = vectors.groupBy("h").agg(F.min(F.struct("slots", "counts")).alias("v")).orderBy("h").limit(fit_rows).select("v.slots", "v.counts", F.lit(None).cast("string").alias("lang")).toArrow()
    few = placed(np.concatenate([x for b in first.combine_chunks().to_batches() for x, _ in _dense(b)]))
    few = few[few.any(axis=1)]
    if not len(few):
        return weight, np.zeros((1, DIM)), out
    centres, before = _seeds(few, topics), None
    for _ in range(FIT_ROUNDS):

        def by_topic(x: np.ndarray, _, centres=centres):
            x = placed(x)
            near, fixed = np.round(x @ centres.T, 9).argmax(axis=1), np.rint(x * FIXED).astype(np.int64)
            return [(str(i), fixed[near == i]) for i in range(len(centres))]

        sums = {int(r.key): r.sums for r in _summed(vectors, by_topic).collect()}
        if sums == before:
            break
        before = sums
        moved = np.array([sums[i][:-1] for i in range(len(centres))], float) / FIXED
        centres = np.where(moved.any(axis=1)[:, None], _unit(moved), centres)
    return weight, centres, out


def _numbers(keys: pa.Array, seen: dict) -> pa.Array:
    """How often each key has come before."""
    out = []
    for k in keys.to_pylist():
        out.append(seen.get(k, 0))
        seen[k] = out[-1] + 1
    return pa.array(out, pa.int64())


def with_numbers(rows: DataFrame) -> DataFrame:
    """rows with _nth, each one's number among those of its task with its _key."""
    name = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _numbers(b.column(name.index("_key")), seen)], [*name, "_nth"])

    return rows.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "_nth long"]))


def with_topics(rows: DataFrame, model, text: str | None = None) -> DataFrame:
    """rows with topic and n_tokens for the column text, or for the last column, which then goes; and with _nth, if they have a _key. model: the broadcast of fit_topics."""
    kept = rows.columns if text else rows.columns[:-1]
    key = kept.index("_key") if "_key" in kept else None
    at = rows.columns.index(text) if text else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, centres, out = model.value
        seen: dict = {}
        for b in batches:
            n, topic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for count, x in _vectors(b.column(at)):
                n.append(count)
                x = _unit(x * weight)
                topic.append(np.round(_unit(x - (x @ out) @ out.T) @ centres.T, 9).argmax(axis=1))
            names = pa.array([f"topic-{i}" for i in range(len(centres))])
            new = [names.take(pa.array(np.concatenate(topic))), pa.array(np.concatenate(n)), *([] if key is None else [_numbers(b.column(key), seen)])]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *new], [*kept, "topic", "n_tokens", "_nth"][: len(kept) + len(new)])

    kinds = [f"{c} {t}" for c, t in rows.dtypes[: len(kept)]]
    return rows.mapInArrow(run, ", ".join([*kinds, "topic string", "n_tokens long", *([] if key is None else ["_nth long"])]))


def tokens(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rake(sums: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], budget: float = BUDGET, rounds: int = ROUNDS, close: float = 1e-10) -> np.ndarray:
    """The probability of each cell. sums: tokens; codes: for each margin the cell's value; targets: for each margin the values' shares."""
    have = sums / max(sums.sum(), 1e-300)
    keep = have * budget
    for _ in range(rounds):
        before = keep
        for code, target in zip(codes, targets):
            now = np.bincount(code, keep, len(target))
            step = np.divide(target * budget, now, out=np.ones(len(target)), where=now > 0)
            keep = np.minimum(keep * step[code], have)
        if np.abs(keep - before).max(initial=0) < close:
            break
    return np.divide(keep, have, out=np.full(len(have), budget), where=have > 0)


def factors(cells: DataFrame, targets: dict[str, dict] | None = None, power: float = POWER, budget: float = BUDGET, max_cells: int = MAX_CELLS) -> DataFrame:
    """cells: (source, lang, topic, n_tokens summed). Adds probability, weight (that over budget, the raked factor) and margin_gap."""
    rows = cells.limit(max_cells + 1).collect()
    if len(rows) > max_cells:
        raise ValueError(f"more than {max_cells} cells of {MARGINS}: merge rare sources or raise max_cells")
    rows.sort(key=lambda r: [(r[m] is None, str(r[m])) for m in MARGINS])
    sums = np.array([r.n_tokens for r in rows], float)
    codes, shares = [], []
    for m in MARGINS:
        values = sorted({r[m] for r in rows if sums.any()}, key=lambda v: (v is None, str(v)))
        place = {v: i for i, v in enumerate(values)}
        code = np.array([place.get(r[m], 0) for r in rows], np.int64)
        seen = np.bincount(code, sums, len(values))
        want = np.array([float(targets[m].get(v, 0)) for v in values]) if targets and m in targets else seen**power
        want = np.where(seen > 0, want, 0.0)
        codes.append(code)
        shares.append(want / max(want.sum(), 1e-300))
    chance = rake(sums, codes, shares, budget) if sums.any() else np.full(len(rows), budget)
    kept = sums * chance
    gap = max((float(np.abs(np.bincount(c, kept, len(t)) / max(kept.sum(), 1e-300) - t).max(initial=0)) for c, t in zip(codes, shares) if sums.any()), default=0.0)
    if gap > TOLERANCE:
        warnings.warn(f"a margin's share stays {gap:.4f} from its target: some cells have too few tokens", stacklevel=2)
    out = [(*(r[m] for m in MARGINS), float(p / budget), float(p), gap) for r, p in zip(rows, chance)]
    kinds = dict(cells.dtypes)
    return cells.sparkSession.createDataFrame(out, ", ".join([*(f"{m} {kinds[m]}" for m in MARGINS), "weight double", "probability double", "margin_gap double"]))


def draw(doc_id: Column, text_hash: Column, nth: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from the id, the text and the row's number among those equal in both."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash.cast("string"), nth.cast("string")))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / float(1 << 48)


def free_names(columns: list[str], new: list[str]) -> list[str]:
    """The new names, with underscores as long as one is taken."""
    taken, out = {c.lower() for c in columns}, []
    for n in new:
        while n in taken:
            n += "_"
        out.append(n)
    return out


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, power: float = POWER, budget: float = BUDGET, topic_of: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """columns of docs (doc_id, source, lang if None), topic, n_tokens, weight, probability, margin_gap and kept (or `free_names` for them), for each row.

    topic_of: a column of docs in place of the derived topics.
    """
    text = F.col("text").cast("string")
    new = ["topic", "n_tokens", "weight", "probability", "margin_gap", "kept"]
    columns = ["doc_id", "source", "lang"] if columns is None else columns
    named = [F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]
    margins = [F.col("source").alias("source"), F.col("lang").alias("lang")]
    own_key = [F.col("doc_id").alias("_id"), F.xxhash64("doc_id", text).alias("_key")]
    if topic_of is None:
        model = docs.sparkSession.sparkContext.broadcast(fit_topics(docs.select(text.alias("text"), margins[1])))
        # a text that is a string already crosses to Python once
        own = f"_c{columns.index('text')}" if "text" in columns and ("text", "string") in docs.dtypes else None
        extra = [] if own else [text.alias("_text")]
        rows = with_topics(docs.select(*named, *own_key, *margins, *extra), model, own)
        cells = with_topics(docs.select(*margins, text.alias("_text")), model)
    else:
        rows = with_numbers(docs.select(*named, *own_key, *margins, topic_of.alias("topic"), tokens(text).alias("n_tokens")))
        cells = docs.select(*margins, topic_of.alias("topic"), tokens(text).alias("n_tokens"))
    cells = cells.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("n_tokens"))
    factor = factors(cells, targets, power, budget).select(*[F.col(m).alias(f"_{m}") for m in MARGINS], "weight", "probability", "margin_gap")
    same = [rows[m].eqNullSafe(factor[f"_{m}"]) for m in MARGINS]
    # one row for each cell: MAX_CELLS at most
    joined = rows.join(F.broadcast(factor), same, "left")
    joined = joined.withColumn("kept", draw(F.col("_id"), F.col("_key"), F.col("_nth")) < F.col("probability"))
    return joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)], *[F.col(n).alias(f) for n, f in zip(new, free_names(columns, new))])


def sample(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are drawn, with their columns as they were."""
    drawn = mix(docs.withColumn("_row", F.struct(*docs.columns)), columns=["_row"], **how)
    return drawn.where("kept").select("_row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs)
