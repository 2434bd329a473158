"""Filters and predicates."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from .projections import LANGS, TOKEN

TOKENS = regex.compile(TOKEN)


def filter_trainable(groups: DataFrame, min_pos: int = 1, min_neg: int = 1) -> DataFrame:
    return groups.where((F.size("positive_passages") >= min_pos) & (F.size("negative_passages") >= min_neg))


def drop_self_match(run: DataFrame) -> DataFrame:
    return run.where("qid <> docid")


class Scanner:
    """One automaton for all answers seen so far, each a sequence of tokens; a text is scanned once for all of them."""

    SEPARATOR = "\x01"

    def __init__(self, normalize: bool = True, most: int = 1 << 18) -> None:
        self.normalize, self.most, self.scans = normalize, most, 0
        self.clear()

    def clear(self) -> None:
        self.automaton, self.forms, self.stale, self.found = ahocorasick.Automaton(), {}, False, {}

    def form(self, text: str) -> str:
        """Lower-case tokens with a separator around each; nothing where there is no token."""
        text = unicodedata.normalize("NFD", text) if self.normalize and not text.isascii() else text
        tokens = TOKENS.findall(text)
        return f"{self.SEPARATOR}{self.SEPARATOR.join(tokens)}{self.SEPARATOR}".lower() if tokens else ""

    def know(self, answers: Iterable[str]) -> None:
        """Adds answers to the automaton; it starts anew where that would be more than `most`."""
        new = {a for a in answers if a not in self.forms}
        if len(self.forms) + len(new) > self.most:
            self.clear()
            new = set(answers)
        for a in new:
            self.forms[a] = self.form(a)
            if self.forms[a]:
                self.automaton.add_word(self.forms[a], self.forms[a])
        if new:
            self.stale, self.found = True, {}

    def scan(self, text: str) -> set[str]:
        """The forms of all answers that stand in a text."""
        if text not in self.found:
            if self.stale and len(self.automaton):
                self.automaton.make_automaton()
            self.stale = False
            if len(self.found) > 4096:
                self.found = {}
            self.scans += 1
            self.found[text] = {w for _, w in self.automaton.iter(self.form(text))} if len(self.automaton) else set()
        return self.found[text]

    def hits(self, texts: list[str | None], answers: list) -> list[bool]:
        asked = [[a for a in row if a is not None] if row is not None else [] for row in answers]
        self.know(set().union(*asked) if asked else ())
        return [t is not None and bool(row) and not self.scan(t).isdisjoint(f for a in row if (f := self.forms[a])) for t, row in zip(texts, asked)]


def has_answer(cands: DataFrame, normalize: bool = True) -> DataFrame:
    """cands: (.., text, answers array). hit: some answer's tokens stand in the text's tokens, one after the other.

    Tokens are compared in lower case and, with normalize, decomposed. However many answers there are, a text is scanned once a batch for all.
    """

    @pandas_udf(BooleanType())
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scanner = Scanner(normalize)
        for texts, answers in parts:
            yield pd.Series(scanner.hits(texts.tolist(), answers.tolist()), dtype=bool)

    return cands.withColumn("hit", found("text", "answers"))


@lru_cache(maxsize=4096)
def _pattern(p: str) -> regex.Pattern | None:
    """The compiled pattern; None, which matches nothing, for an invalid one."""
    try:
        return regex.compile(p, regex.IGNORECASE | regex.MULTILINE)
    except regex.error:
        return None


@pandas_udf(BooleanType())
def _any_found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    # patterns differ from row to row and may be invalid, which the built-in matchers don't allow
    for texts, patterns in parts:
        yield pd.Series([t is not None and ps is not None and any(p is not None and (c := _pattern(p)) is not None and c.search(t) is not None for p in ps) for t, ps in zip(texts, patterns)], dtype=bool)


def has_answer_regex(cands: DataFrame) -> DataFrame:
    """cands: (.., text, answers array). hit: one of the row's answers, as a regular expression, is found, in either case and on any line."""
    return cands.withColumn("hit", _any_found("text", "answers"))


def parse_shards(ids: str | None, max_shards: int) -> list[int]:
    """A comma list without repeats, in order; None is all shards; anything out of range is an error."""
    if ids is None:
        return list(range(max_shards))
    out = list(dict.fromkeys(int(x) for x in ids.split(",") if x.strip()))
    if bad := [x for x in out if not 0 <= x < max_shards]:
        raise ValueError(f"shards out of range: {bad}")
    return out


def prune_shards(df: DataFrame, ids: str | None, max_shards: int) -> DataFrame:
    return df.where(F.col("shard").isin(parse_shards(ids, max_shards)))


def filter_lang(corpus: DataFrame, langs: list[str]) -> DataFrame:
    if bad := set(langs) - set(LANGS):
        raise ValueError(f"unknown languages: {sorted(bad)}")
    return corpus.where(F.col("lang").isin(list(langs)))
