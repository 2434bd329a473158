"""Media columns: interleaved document sequences (operator 7).

`interleave` parses HTML into an ordered array of text and media-reference structs; `describe` reads stored media back
and computes their features, once for each distinct digest; `resolve` joins the references with them by digest, so that
positions and captions stay aligned with the resolved columns. Media are 8-bit grey images, 64 samples a row, in the
portable graymap format, which stores samples as they are.

The query stores each document's text as such an image, writes a page that shows it, and reads the page's one reference
back through these steps.

Edge cases: null and empty texts give one row of zeros; equal texts give equal values; a null page parses to no segments;
a reference without stored media keeps its place with null columns; of several stored copies of a digest any one is read, as they
are equal; very long texts and pages are worked through whole, one at a time; repeated rows come back each; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw

ROW = 64
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_SEGMENT = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
_MEDIA = {"img", "video", "audio", "source", "embed"}
_SILENT = {"script", "style", "template", "noscript"}
_BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "section", "article", "header", "footer", "nav", "figure", "blockquote", "pre", "br", "hr", "title", "main", "aside"}


def encode(payload: bytes) -> bytes:
    """The stored form: a graymap whose samples are the payload's bytes."""
    return b"P5\n%d %d\n255\n" % (ROW, len(payload) // ROW) + payload


def decode(media: bytes) -> bytes:
    """The payload of a graymap made by `encode`."""
    magic, size, depth, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or len(payload) != width * height:
        raise ValueError("not an 8-bit graymap of its stated size")
    return payload


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW if text else ROW)


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.silent = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figcaption" and self.figure:
            self.caption = []
        elif tag in _MEDIA and not self.silent:
            named = dict(attrs)
            ref = named.get("src") or ""
            self.end_text()
            if self.figure:
                self.figure.append(len(self.out))
            digest = ref.removeprefix("sha256:") if ref.startswith("sha256:") else hashlib.sha256(ref.encode()).hexdigest()
            self.out.append({"position": len(self.out), "kind": "media", "text": None, "digest": digest, "caption": named.get("alt")})
        elif tag in _BLOCKS:
            self.end_text()
            if tag == "figure":
                self.figure = [-1]

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for i in self.figure:
                if i >= 0:
                    self.out[i]["caption"] = text
            self.caption = None
        elif tag in _BLOCKS:
            self.end_text()
            if tag == "figure":
                self.figure = []

    def handle_data(self, data):
        if not self.silent:
            (self.words if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    p = _Parser()
    p.feed(html or "")
    p.close()
    p.end_text()
    return p.out


def interleave(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, segments) for each row of pages (key, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([parse(h) for h in b.column(1).to_pylist()], _SEGMENT)], [key, "segments"])

    return pages.select(key, F.col("html").cast("string")).mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, segments {SEGMENTS}")


_DESCRIBED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(store: DataFrame) -> DataFrame:
    """One row of features for each digest of store (digest, media); a digest stands for one content, whichever copy is read."""

    def one(digest: str, media: bytes) -> tuple:
        payload = decode(media)
        x = np.frombuffer(payload, np.uint8)
        steps = np.abs(np.diff(x.reshape(-1, ROW).astype(np.int16), axis=1)).mean()
        feature = f"{ROW}x{len(x) // ROW} mean={x.mean():.3f} std={x.std():.3f} step={steps:.3f} distinct={len(np.unique(x))}"
        return digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DESCRIBED.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DESCRIBED.split(", ")]
        for b in batches:
            rows = [one(d, m.as_buffer().to_pybytes()) for d, m in zip(b.column(0).to_pylist(), b.column(1))]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    once = store.where("digest is not null and media is not null").groupBy("digest").agg(F.first("media").alias("media"))
    return once.mapInArrow(run, _DESCRIBED)


def resolve(sequences: DataFrame, described: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, position, caption, digest and the columns of described) for each media reference of each sequence."""
    refs = sequences.select(key, F.inline("segments")).where("kind = 'media'").select(key, "position", "caption", "digest")
    return refs.join(described, "digest", "left")


def _payload(text: Column) -> Column:
    """The text's bytes, padded with zeros to a positive multiple of ROW."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(raw) / ROW), F.lit(1)) * ROW
    return F.rpad(raw, size.cast("int"), F.lit(b"\0"))


def store_texts(docs: DataFrame) -> DataFrame:
    """(digest, media) for each row of docs (text): a media store with one entry for each copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [pad(raw(t)) for t in b.column(0)]
            for lo in range(0, max(len(payloads), 1), 256):
                part = payloads[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(p).hexdigest() for p in part], pa.string()), pa.array([encode(p) for p in part], pa.binary())], ["digest", "media"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "digest string, media binary")


def text_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html) for each row of docs (doc_id, text): a page that shows the document's image."""
    text = F.col("text").cast("string")
    n = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    digest = F.sha2(_payload(text), 256)
    html = F.concat(F.lit('<article><figure><img src="sha256:'), digest, F.lit('" alt="text"><figcaption>'), n.cast("string"), F.lit(" bytes of text</figcaption></figure></article>"))
    return docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_bytes")).alias("page"), html.alias("html"))


def op7_media_columns(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    resolved = resolve(interleave(text_pages(docs), "page"), describe(store_texts(docs)), "page")
    return resolved.select("page.doc_id", "page.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
