"""Media columns: interleaved documents of text and media references, with a digest-addressed store of payloads.

:func:`interleave` parses HTML into an ordered array of structs, text or media reference (digest, caption), positions
counted from 0. :func:`store` keeps each payload once, under its SHA-256, as a greyscale PNG of 576 samples a row, which is
lossless and self-checking. :func:`resolve` joins references and store on the digest, so position and caption stay beside
what the store gives.

Copies of a payload are put together by a partial aggregation on the digest before any shuffle of images, features are taken
in the store, once a payload, and only they and the digest meet the references: a payload that a third of all documents
hold moves once per task.

A caption goes to a media reference of its own figure: the last before it, else the first after it, that has none yet. Where
there is none, and outside of figures, it is text at its place. It ends with its figure at the latest, and a figure with
the element around it.

Edge cases: null text is an empty payload (one row of padding); equal texts give equal values; a reference whose digest is
not in the store keeps null features; malformed HTML is read as far as the parser goes, null HTML gives an empty array;
repeated rows and null ids pass through; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fields, released
from millrace.session import ship

ROW = 576
SCHEME = "media:sha256:"
_PNG = b"\x89PNG\r\n\x1a\n"
SEGMENT = "array<struct<position:int,kind:string,text:string,digest:string>>"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of ``ROW``."""
    return data + b"\xff" * (max(1, -(-len(data) // ROW)) * ROW - len(data))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A greyscale 8-bit PNG, ``ROW`` wide, every row unfiltered."""
    rows = len(payload) // ROW
    raw = np.zeros((rows, ROW + 1), np.uint8)
    raw[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> bytes:
    """The samples of an image of :func:`to_png`; a damaged one raises ValueError."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return raw[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Size, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = counts.sum()
    values = np.arange(256)
    mean = float((counts * values).sum() / n)
    dev = float(np.sqrt((counts * (values - mean) ** 2).sum() / n))
    p = counts[counts > 0] / n
    return f"{ROW}x{n // ROW};mean={mean:.3f};dev={dev:.3f};bits={float(-(p * np.log2(p)).sum()):.3f}"


_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "article", "figure", "section"}
#: Elements whose end also ends the figures within.
_AROUND = {"div", "li", "ul", "ol", "td", "th", "tr", "table", "article", "figure", "section", "main", "aside", "header", "footer", "blockquote", "body"}


class _Figure:
    def __init__(self) -> None:
        self.free: list[dict] = []  # media without a caption
        self.early: list[dict] = []  # captions, as text, that wait for a medium


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict | None] = []
        self.text: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.before = 0  # media without a caption when the open caption began
        self.figures: list[_Figure] = []
        self.around: list[str] = []
        self.n_around: Counter[str] = Counter()

    def _segment(self, kind: str, text: str | None, digest: str | None = None) -> dict:
        self.found.append({"position": len(self.found), "kind": kind, "text": text, "digest": digest})
        return self.found[-1]

    def _flush(self) -> None:
        if self.caption is not None:
            self.caption.append(" ")
            return
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:
            self._segment("text", text)

    def _end_caption(self) -> None:
        if self.caption is None:
            return
        text = " ".join("".join(self.caption).split())
        self.caption = None
        figure = self.figures[-1] if self.figures else None
        if not text:
            return
        if figure and figure.free:
            figure.free.pop(self.before - 1 if self.before else 0)["text"] = text
        else:
            s = self._segment("text", text)
            if figure:
                figure.early.append(s)

    def _end_around(self, tag: str) -> None:
        while self.n_around[tag]:
            last = self.around.pop()
            self.n_around[last] -= 1
            if last == "figure":
                self._end_caption()
                self._flush()
                self.figures.pop()
            if last == tag:
                break

    def finish(self) -> list[dict]:
        """The segments, once the input has ended."""
        self._end_caption()
        self._flush()
        found = [s for s in self.found if s is not None]
        for i, s in enumerate(found):
            s["position"] = i
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in ("img", "audio", "video", "source"):
            self._flush()
            a = dict(attrs)
            src = a.get("src") or ""
            digest = src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode("utf-8", "replace")).hexdigest()
            s = self._segment("media", a.get("alt"), digest)
            if self.figures:
                figure = self.figures[-1]
                if figure.early:
                    early = figure.early.pop(0)
                    s["text"] = early["text"]
                    self.found[early["position"]] = None
                else:
                    figure.free.append(s)
        elif tag == "figcaption":
            self._end_caption()
            self._flush()
            self.caption = []
            self.before = len(self.figures[-1].free) if self.figures else 0
        elif tag in _BLOCKS or tag == "br":
            if tag == "figure":
                self._end_caption()
                self.figures.append(_Figure())
            self._flush()
        if tag in _AROUND:
            self.around.append(tag)
            self.n_around[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption":
            self._end_caption()
        elif tag in _BLOCKS:
            self._flush()
        if tag in _AROUND:
            self._end_around(tag)

    def handle_data(self, data: str) -> None:
        if not self.skip:
            (self.text if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """The ordered segments of a page; a figure's caption goes with its media reference."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    return r.finish()


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id, segments array<struct<position, kind, text, digest>>."""
    ship(pages.sparkSession)
    d = fields(pages, id=id_col, html=html_col)
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([parse(x.as_py()) for x in part.column(1)], kind)], ["id", "segments"])

    return d.mapInArrow(released(run), f"id {d.schema['id'].dataType.simpleString()}, segments {SEGMENT}")


def references(interleaved: DataFrame) -> DataFrame:
    """One row per media segment: id, position, caption, digest."""
    s = interleaved.select("id", F.explode("segments").alias("s")).where("s.kind = 'media'")
    return s.select("id", F.col("s.position").alias("position"), F.col("s.text").alias("caption"), F.col("s.digest").alias("digest"))


def store(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """digest, media (PNG), n_bytes: each distinct payload once."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                data = {}
                for t in b.column(0).slice(i, 512):
                    raw = (t.as_py() or "").encode()
                    data.setdefault(hashlib.sha256(raw).hexdigest(), raw)
                yield pa.RecordBatch.from_arrays([pa.array(list(data), pa.string()), pa.array([to_png(padded(x)) for x in data.values()], pa.binary()), pa.array([len(x) for x in data.values()], pa.int64())], ["digest", "media", "n_bytes"])

    encoded = fields(texts, text=text_col).mapInArrow(released(run), "digest string, media binary, n_bytes long")
    return encoded.groupBy("digest").agg(F.first("media").alias("media"), F.first("n_bytes").alias("n_bytes"))


def described(stored: DataFrame) -> DataFrame:
    """What the stored bytes read back give: digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for m in b.column(1):
                image = m.as_py()
                p = from_png(image)
                for column, x in zip(out, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(p))):
                    column.append(x)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, k) for x, k in zip(out, kinds))], names)

    names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return stored.select("digest", "media", "n_bytes").mapInArrow(released(run), "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def resolve(refs: DataFrame, described_: DataFrame) -> DataFrame:
    """References with what the store says of their digest, positions and captions as they were."""
    return refs.join(described_, "digest", "left")


def page_of(caption: Column, digest: Column) -> Column:
    """A page that shows one media payload, as HTML."""
    return F.concat(F.lit('<article><figure><img src="' + SCHEME), digest, F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))


def op4_media(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    pages = docs.select(F.col("doc_id"), page_of(F.concat(F.lit("document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))), digest).alias("html"))
    r = resolve(references(interleave(pages, "doc_id")), described(store(docs)))
    return r.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")


