"""License scans by ordered signature rules.

A text becomes its lower-case words with one space between, in bytes. Rules stand in ``license_rules.txt`` in order of
priority: label, confidence, a keyword, a regex. A rule's regex runs only on texts that hold its keyword. A detection is an
interval of words; one that lies within a kept detection of higher priority, or equals it, is suppressed.

The base phrases are counted in full (overlaps and suppressed places too), and their labels always stay.

Edge cases: null text is empty: no words, no labels, score 0; words are whole (no phrase begins or ends within one); repeated
rows and null ids pass through; ties go to the rule that stands first; other columns are not read; an empty table gives no
rows. A text of any length is scanned whole; suppression sorts, so many detections cost little more than a few.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import fields
from millrace.session import ship

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@lru_cache(maxsize=1)
def rules() -> dict[bytes, list[tuple[int, str, float, re.Pattern]]]:
    """Keyword to its rules: priority (0 first), label, confidence, regex over whole words."""
    found: dict[bytes, list] = defaultdict(list)
    lines = resources.files("millrace.llm").joinpath("license_rules.txt").read_text().splitlines()
    for n, line in enumerate(x for x in lines if x and x[0] != "#"):
        label, confidence, keyword, pattern = line.split("|", 3)
        found[keyword.replace("-", " ").encode()].append((n, label, float(confidence), re.compile(f"(?<= )(?:{pattern})(?= )".encode())))
    return dict(found)


def words_of(text: str) -> tuple[bytes, int]:
    """The words with a space around each, and their number."""
    words = text.encode().translate(_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def base_places(words: bytes) -> dict[str, list[int]]:
    """Label to the words at which its phrase begins."""
    found = {}
    for phrase, label in BASE.items():
        needle, places, at, done, n = f" {phrase} ".encode(), [], words.find(f" {phrase} ".encode()), 0, 0
        while at >= 0:
            n += words.count(b" ", done, at)
            done = at
            places.append(n)
            at = words.find(needle, at + 1)
        if places:
            found[label] = places
    return found


def detections(words: bytes) -> list[tuple[int, int, str, float]]:
    """Kept detections by place: first word, word after the last, label, confidence."""
    got = []
    for keyword, own in rules().items():
        if keyword in words:
            for priority, label, confidence, regex in own:
                places = [m.span() for m in regex.finditer(words)]
                if places:
                    got.append((priority, label, confidence, np.array(places)))
    if not got:
        return []
    # kept so far: sorted starts, and the furthest end of an interval that begins there or before; what lies within one that
    # was suppressed lies within the one that suppressed it, and places of one rule don't overlap
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept: list[tuple[int, int, str, float]] = []
    for _, label, confidence, places in sorted(got, key=lambda x: x[0]):
        at = np.searchsorted(starts, places[:, 0], "right")
        free = np.append(0, reach)[at] < places[:, 1]
        places = places[free]
        kept += [(a, b, label, confidence) for a, b in places.tolist()]
        starts = np.concatenate([starts, places[:, 0]])
        order = np.argsort(starts, kind="stable")
        starts, reach = starts[order], np.maximum.accumulate(np.concatenate([reach, places[:, 1]])[order])
    kept.sort()
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    first, end = (np.searchsorted(spaces, [k[i] for k in kept]) for i in (0, 1))
    return [(a - 1, b, label, c) for a, b, (_, _, label, c) in zip(first.tolist(), end.tolist(), kept)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the surest detection's confidence), detections array<struct<first,end,label>>."""
    ship(docs.sparkSession)
    d = fields(docs, doc_id=id_col, text=text_col)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                rows: list[list] = [[] for _ in names]
                for t in part.column(1):
                    words, n = words_of(t.as_py() or "")
                    base = base_places(words)
                    places = [p for x in base.values() for p in x]
                    found = detections(words)
                    labels = sorted({*base, *(d[2] for d in found)})
                    score = max([1.0 if base else 0.0, *(d[3] for d in found)])
                    row = (n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(labels), score, [{"first": x, "end": y, "label": z} for x, y, z, _ in found])
                    for column, x in zip(rows, row):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], ["doc_id", *names])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<first:long,end:long,label:string>>")


def op7_license(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
