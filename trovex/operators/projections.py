"""Text preparation and scalar work on tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Languages of web documents: fixed values.
LANGS = ("de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "zh_chs", "other")
DOCID = rf"^clueweb22-({'|'.join(LANGS)})([0-9]{{2}})([0-9]{{2}})-([0-9]{{2}})-([0-9]{{5}})$"


def _strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^[\p{Z}\s\x0b]+|[\p{Z}\s\x0b]+$", "")


def prepare_queries(queries: DataFrame, prefix: str) -> DataFrame:
    return queries.select("query_id", _strip(F.concat(F.lit(prefix + " "), _strip(F.col("query")))).alias("text"))


def prepare_passages(corpus: DataFrame, prefix: str, markers: bool = False) -> DataFrame:
    title = F.coalesce("title", F.lit(""))
    if markers:
        text = F.concat(F.lit(f"{prefix} Title: "), title, F.lit(" Text: "), F.col("text"))
    else:
        text = F.concat(F.lit(prefix + " "), title, F.lit(" "), F.col("text"))
    return corpus.select("docid", _strip(text).alias("text"))


def prepare_pairs(cands: DataFrame, qprefix: str, pprefix: str) -> DataFrame:
    """cands: (qid, query, docid, title, text). Hyphens of titles become spaces."""
    title = _strip(F.replace("title", F.lit("-"), F.lit(" ")))
    return cands.select("qid", "docid", F.concat(F.lit(qprefix + " "), "query", F.lit(f" {pprefix} "), title, F.lit(" "), "text").alias("text"))


def prepare_dual(corpus: DataFrame, sep: str = " ") -> DataFrame:
    has = F.coalesce("title", F.lit("")) != ""
    return corpus.select("docid", F.when(has, F.concat("title", F.lit(sep), "text")).otherwise(F.col("text")).alias("text"))


def clean_web_text(docs: DataFrame) -> DataFrame:
    """title is the first line; line breaks, tabs and quotes go without a space in their place."""
    gone = F.translate(F.col("text"), "\n\t\r'\"", "")
    title = F.translate(F.split_part("text", F.lit("\n"), F.lit(1)), "\t\r'\"", "")
    return docs.select("docid", _strip(title).alias("title"), _strip(gone).alias("text"))


def parse_docid(df: DataFrame) -> DataFrame:
    """The parts of a web document id and its store path; invalid ids go."""
    part = lambda i: F.regexp_extract("docid", DOCID, i)
    rows = df.where(F.col("docid").rlike(DOCID)).select("docid", part(1).alias("lang"), part(2).alias("stream"), part(3).alias("subdir"), part(4).alias("file_seq"), part(5).cast("int").alias("doc_seq"))
    stream = F.concat("lang", "stream")
    folder = F.concat(stream, "subdir")
    return rows.withColumn("path", F.concat_ws("/", "lang", stream, folder, F.concat(folder, F.lit("-"), F.col("file_seq"), F.lit(".json.gz"))))


RESULT = "`ClueWeb22-ID` string, URL string, `URL-hash` string, `Clean-Text` string"


def extract_fields(results: DataFrame) -> DataFrame:
    """(qid, rank, body) -> id, URL, hash and text; malformed JSON keeps its rank with empty fields."""
    r = F.from_json("body", RESULT, {"mode": "PERMISSIVE"})
    field = lambda n: F.coalesce(r[n], F.lit(""))
    return results.select("qid", "rank", field("ClueWeb22-ID").alias("docid"), field("URL").alias("url"), field("URL-hash").alias("url_hash"), field("Clean-Text").alias("text"))


def fill_template(df: DataFrame, template: str, allow_missing: bool = True) -> DataFrame:
    """Replaces <a.b> by the (nested) column; missing values are empty, or an error when not allowed. The template is parsed once."""
    parts = re.split(r"<([A-Za-z_][\w.]*)>", template)
    columns = [F.lit(p) if i % 2 == 0 else F.coalesce(F.col(p).cast("string"), F.lit("") if allow_missing else F.raise_error(F.lit(f"no value for <{p}>"))) for i, p in enumerate(parts)]
    return df.select("id", F.concat(*columns).alias("text"))


def split_passages(corpus: DataFrame, token: str) -> DataFrame:
    """(docid, part, title, text): one row for each passage, the title on each."""
    return corpus.select("docid", "title", F.posexplode(F.split("text", re.escape(token))).alias("part", "text")).select("docid", "part", "title", "text")


def hashed(*parts: Column | str) -> Column:
    """A number in [0, 1) from md5 of the parts: the same everywhere, without state."""
    key = F.md5(F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(1 << 32)


def crop_pairs(corpus: DataFrame, low: float = 0.1, high: float = 0.5, seed: str = "crop") -> DataFrame:
    """Two independent crops of title and text: length floor(words * ratio), ratio uniform, start uniform over what fits."""
    w = F.split(_strip(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "text")), r"\s+")
    rows = corpus.select("docid", w.alias("w"))

    def crop(name: str) -> Column:
        ratio = F.lit(low) + (high - low) * hashed(seed, name, "ratio", F.col("docid"))
        size = F.greatest(F.floor(F.size("w") * ratio), F.lit(1)).cast("int")
        start = F.floor(hashed(seed, name, "start", F.col("docid")) * (F.size("w") - size + 1)).cast("int")
        return F.array_join(F.slice("w", start + 1, size), " ")

    return rows.select("docid", crop("a").alias("query"), crop("b").alias("passage"))


def truncate_tokens(df: DataFrame, max_len: int, eos: int | None = None) -> DataFrame:
    if eos is None:
        return df.select("id", F.slice("input_ids", 1, max_len).alias("input_ids"))
    return df.select("id", F.concat(F.slice("input_ids", 1, max_len - 1), F.array(F.lit(eos))).alias("input_ids"))


def pad_tokens(df: DataFrame, multiple: int = 16, pad: int = 0) -> DataFrame:
    """df: (batch, id, input_ids). Pads to the batch's longest, rounded up to a multiple; adds the attention mask."""
    n = F.size("input_ids")
    to = (F.ceil(F.max(n).over(Window.partitionBy("batch")) / multiple) * multiple).cast("int")
    rows = df.withColumn("to", to)
    fill = lambda v: F.array_repeat(F.lit(v), F.col("to") - n)
    return rows.select("id", F.concat("input_ids", fill(pad)).alias("input_ids"), F.concat(F.array_repeat(F.lit(1), n), fill(0)).alias("mask"))


@pandas_udf(StringType())
def nfd(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical decomposition, which Spark has no function for."""
    for s in parts:
        yield s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFD", t))


#: Fixed value: the tokens that answers are compared by
TOKEN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"


def answer_tokens(df: DataFrame, col: str, normalize: bool = True) -> DataFrame:
    """Lower-case tokens: runs of letters, digits and marks, or one other visible character."""
    text = nfd(F.col(col)) if normalize else F.col(col)
    return df.select("id", F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower).alias("tokens"))


def token_ngrams(df: DataFrame, n: int) -> DataFrame:
    """(id, ngram): all runs of 1..n tokens, joined by a space."""
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.when(F.size("tokens") >= k, F.transform(F.sequence(F.lit(1), F.size("tokens") - k + 1), lambda i: F.array_join(F.slice("tokens", i, k), " "))).otherwise(F.array().cast("array<string>"))))
    return df.select("id", F.explode(runs).alias("ngram"))


def adapt_pair_lists(df: DataFrame) -> DataFrame:
    """query[1], pos[1] and neg[1:] of the alternate layout, counted from 0."""
    return df.select("id", F.get("query", F.lit(1)).alias("query"), F.slice("pos", 2, 1).alias("positives"), F.slice("neg", 2, 1 << 30).alias("negatives"))


def payload_base64(df: DataFrame, col: str) -> DataFrame:
    """base64 without the line breaks that Spark puts in."""
    return df.select("id", F.replace(F.base64(F.encode(col, "UTF-8")), F.lit("\r\n"), F.lit("")).alias("payload"))


def prefix_encode_input(df: DataFrame, instruction: str) -> DataFrame:
    return df.select("id", F.concat(F.lit(instruction), "query").alias("text"))
