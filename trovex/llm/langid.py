"""Language identification by cross-parsing entropy (operator 13).

A text is parsed from left to right into phrases, each the longest match with the learned text of a language (or one symbol
that never occurs there). A language whose text has long pieces of it in common needs few phrases. With c phrases for z symbols
and n learned symbols, c log2(n) / z estimates the cross entropy; the language of least estimate wins. Longest matches come from
a suffix automaton of the learned text, which has a path for each of its substrings: the parse follows transitions and starts
anew where there is none.

What is learned: of each language, windows of WINDOW symbols, those of least hash out of the ROWS texts of least hash, up to
SYMBOLS (or less, so that all languages together have TOTAL at most). So the sample is bounded, depends on contents only, and
takes in texts from end to end. Automata are built in one task a language and sent to the tasks as arrays. Every text is parsed
whole: pieces of PIECE symbols are parsed side by side as lanes of one array operation a symbol, for all languages at once; a
new piece starts a new phrase.

Symbols are the bytes of letters in lower case; everything else in ASCII is one separator, however long.

Edge cases: a text that is null or has no letter is `und`, with score 0, and so is every text where no language was learned; the
score is the lead over the second estimate, as a share of that (1 where one language alone was learned); ties go to the lesser
name; equal texts have equal results; repeated rows are returned as often as they occur, but count once in the sample; a null
doc_id isn't held out; very long texts are parsed whole, in pieces; an empty table gives no rows; other columns, whatever their
names, are ignored by `identify`, whose rows are (doc_id, lang_pred, score); more than TOTAL / WINDOW languages are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_class, fold, slices, stored

ROWS = 512  #: labelled texts of a language that are looked at
WINDOW = 256
SENT = 1 << 16  #: sampled texts' hashes that are sent to all tasks; more are joined
SYMBOLS = 1 << 16  #: learned from a language
TOTAL = 1 << 18  #: learned from all languages
PIECE = 1024
SLICE = 8 << 20  #: bytes of texts that are parsed at once
LANES = 1 << 18  #: pieces times languages that are parsed at once

LETTER = byte_class([range(0x61, 0x7B), range(0x80, 0x100)])


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of letters as they are and 0 for each run of others, for all texts, and the texts' offsets."""
    sym = np.where(LETTER[buf], buf, 0).astype(np.uint8)
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0)
    starts = off[:-1][off[:-1] < len(sym)]
    keep[starts] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    return sym[keep], before[off]


class Automaton:
    """The suffix automaton of a text: its transitions, by state and symbol."""

    def __init__(self, text: bytes) -> None:
        length, link, moves = [0], [-1], [{}]
        last = 0
        for c in text:
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = now
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    copy = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        self.states = len(moves)
        self.moves = np.array([(s, c, t) for s, m in enumerate(moves) for c, t in m.items()], np.int32).reshape(-1, 3)


class Parser:
    """Automata of several languages as one dense table. A missing transition holds the complement of the state in which a new phrase stands."""

    def __init__(self, languages: list[tuple[str, int, int, np.ndarray]]) -> None:
        self.names = [name for name, *_ in languages]
        self.logs = np.log2(np.array([max(n, 2) for _, n, *_ in languages], float))
        known = np.unique(np.concatenate([moves[:, 1] for *_, moves in languages]))
        self.code = np.full(256, len(known), np.int32)  # the last one: unknown everywhere
        self.code[known] = np.arange(len(known))
        self.width = len(known) + 1
        tables, self.start, base = [], [], 0
        for _, _, states, moves in languages:
            # one more state, which nothing leads on from: before the first phrase, and after a symbol that is unknown
            table = np.full((states + 1, self.width), -1, np.int32)
            table[moves[:, 0], self.code[moves[:, 1]]] = (moves[:, 2] + base) * self.width
            first = np.where(table[0] >= 0, table[0], (states + base) * self.width)
            tables.append(np.where(table >= 0, table, ~first[None, :]).astype(np.int32).reshape(-1))
            self.start.append((states + base) * self.width)
            base += states + 1
        self.table = np.concatenate(tables)

    def phrases(self, sym: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) for each language (columns)."""
        size = np.diff(first)
        pieces = -(-size // PIECE)
        row = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[row] + nth * PIECE
        length = np.minimum(PIECE, first[row + 1] - start)
        order = np.argsort(-length, kind="stable")
        row, start, length = row[order], start[order], length[order]
        code = self.code[sym]
        out = np.zeros((len(size), len(self.names)), np.int64)
        lanes = max(1024, LANES // len(self.names))
        for lo in range(0, len(row), lanes):
            np.add.at(out, row[lo : lo + lanes], self._parse(code, start[lo : lo + lanes], length[lo : lo + lanes]))
        return out

    def _parse(self, code: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Phrases of each lane, the longest lanes first, for each language."""
        state = np.tile(np.array(self.start, np.int32), (len(start), 1))
        count = np.zeros_like(state)
        at = np.empty(state.shape, np.int64)
        active = np.searchsorted(-length, -np.arange(PIECE), "left")  # lanes longer than each step
        for step in range(int(length[0])):
            n = active[step]
            index = np.add(state[:n], code[start[:n] + step][:, None], out=at[:n])
            to = self.table.take(index, mode="clip")
            new = to >> 31  # all ones where a phrase starts
            count[:n] -= new
            np.bitwise_xor(to, new, out=state[:n])
        return count


def windows(labelled: DataFrame) -> DataFrame:
    """(lang, part binary): windows of symbols of each language's sample. labelled: (lang, text)."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.lower("text").alias("text"), F.xxhash64("text").alias("h"))
    least = rows.select("lang", "h").distinct()
    for by in (["lang", F.pmod("h", F.lit(256))], ["lang"]):  # in shares first, so that a common language isn't one task's work
        least = least.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= ROWS).select("lang", "h")
    chosen = stored(least)
    few = chosen.count() <= SENT
    texts = rows.join(F.broadcast(chosen) if few else chosen, ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, off in slices(b.column(1)):
                sym, first = symbols(buf, off)
                for i in range(hi - lo):
                    own = sym[first[i] : first[i + 1]].tobytes()
                    parts = [own[k : k + WINDOW] for k in range(0, len(own), WINDOW)]
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[lo + i].as_py()] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["lang", "part"])

    parts = texts.mapInArrow(cut, "lang string, part binary").distinct().withColumn("h", F.xxhash64("part"))
    return parts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))).where(F.col("r") <= SYMBOLS // WINDOW).select("lang", "part", "r")


def learn(labelled: DataFrame) -> list[tuple[str, int, int, np.ndarray]]:
    """(name, learned symbols, states, transitions) of each language, in the order of names. labelled: (lang, text)."""
    parts = stored(windows(labelled))
    languages = parts.select("lang").distinct().count()
    if languages > TOTAL // WINDOW:
        raise ValueError(f"more than {TOTAL // WINDOW} languages: their automata would outgrow what is sent to tasks")
    most = min(SYMBOLS, TOTAL // max(languages, 1)) // WINDOW

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        text = b"\0".join(pdf.sort_values("r")["part"])
        a = Automaton(text)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [len(text)], "states": [a.states], "moves": [a.moves.tobytes()]})

    rows = parts.where(F.col("r") <= most).groupBy("lang").applyInPandas(build, "lang string, n long, states long, moves binary").collect()  # at most 3 TOTAL transitions
    return [(r.lang, r.n, r.states, np.frombuffer(r.moves, np.int32).reshape(-1, 3)) for r in sorted(rows, key=lambda r: r.lang.encode())]


@lru_cache(maxsize=1)
def _parser(sent) -> Parser:
    return Parser(sent.value)


def identify(docs: DataFrame, languages: list[tuple[str, int, int, np.ndarray]]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs (doc_id, text)."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", F.when(letters, F.lower("text")).alias("text"))
    if not languages:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sent)
        names = np.array([*parser.names, "und"], object)
        for b in batches:
            known = b.column(1).is_valid().to_numpy(zero_copy_only=False)
            best, score = np.full(b.num_rows, len(parser.names)), np.zeros(b.num_rows)
            for lo, hi, buf, off in slices(b.column(1), SLICE):
                sym, first = symbols(buf, off)
                rate = parser.phrases(sym, first) * parser.logs / np.maximum(np.diff(first), 1)[:, None]
                two = np.sort(rate, axis=1)[:, :2]
                best[lo:hi] = rate.argmin(axis=1)
                score[lo:hi] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-300) if two.shape[1] > 1 else 1.0
            best[~known], score[~known] = len(parser.names), 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = fold("doc_id", 3) == 1
    languages = learn(docs.where(~held).select("lang", "text"))
    out = identify(docs.select("doc_id", "text"), languages)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
