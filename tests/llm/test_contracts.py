"""Queries against their SQL, hot keys, repeated ids and rows, very long texts."""

import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, langid, license, media, mixing, neardup, substring, warc
from millrace.llm.bpe_query import vocabulary
from millrace.llm.queries import ORACLES, QUERIES
from tests.llm.data import corpus, docs, empty, text
from tests.llm.test_text_operators import linked, removed
from tests.test_queries import plain

DATA = Path("/root/testdata/sf0.001")
tables = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@tables
@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(ORACLES[name])
    rows = [r.asDict() for r in QUERIES[name](spark, str(DATA)).collect()]
    columns = sorted(want.columns)
    key = lambda found: sorted(repr([plain(r[k]) for k in columns]) for r in found)
    assert rows and columns == sorted(rows[0]) and key(rows) == key([dict(zip(want.columns, r)) for r in want.fetchall()])


@tables
def test_license_base_over_the_table(spark):
    """Base columns of whole documents, by brute force over words."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    got = {r.doc_id: r for r in QUERIES["op7_license"](spark, str(DATA)).collect()}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for r in spark.read.parquet(str(DATA / "documents.parquet")).collect():
        words = word.findall((r.text or "").translate(low))
        places = {label: [i for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()] for phrase, label in license.BASE.items()}
        every = [p for x in places.values() for p in x]
        labels = sorted(k for k, x in places.items() if x)
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(labels))
        assert set(labels) <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_license_suppression_equals_brute_force():
    r = np.random.default_rng(5)
    pieces = [b"under the mit license", b"mit license", b"apache license version 2 0", b"apache license 2", b"cc by nc", b"cc by nc sa 4 0", b"licensed under the mit license", b"gnu general public license version 2 or later", b"gpl v2", b"word", b"other"]
    for _ in range(40):
        words = b" " + b" ".join(pieces[i] for i in r.integers(0, len(pieces), 30)) + b" "
        every = sorted((p, m.start(), m.end(), label, c) for keyword, own in license.rules().items() if keyword in words for p, label, c, regex in own for m in regex.finditer(words))
        kept: list = []
        for _, a, b, label, c in every:
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, label, c))
        assert license.detections(words) == [(words.count(b" ", 0, a) - 1, words.count(b" ", 0, b), label, c) for a, b, label, c in sorted(kept)]


def test_license_many_detections():
    words = b" " + b"under the mit license and " * 100_000
    began = time.process_time()
    assert len(license.detections(words)) == 100_000 and time.process_time() - began < 8


def test_neardup_hot_keys(spark, monkeypatch):
    """Boilerplate that shares most keys, in documents of different groups; buckets, bins, tiles and comparisons are all cut small."""
    for name, n in (("BUCKET_KEYS", 40), ("FLUSH_KEYS", 900), ("BIN_MEMBERS", 50), ("TILE", 24), ("GROUP_SHINGLES", 3000), ("HOT", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(neardup, name, n)
    shared = text(7, 90)
    rows = [(i, shared + " " + text(1000 + i // 3, 14 + i % 3)) for i in range(120)] + [(200 + i, text(8, 150)) for i in range(9)]
    rows += [(300 + i, " ".join(w if j % 29 != i else f"x{i}" for j, w in enumerate(text(9, 200).split()))) for i in range(25)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(d, 3, 85).collect()}
    assert got == linked(rows, 3, 85)


def test_neardup_leaves_two_tables(spark, monkeypatch, tmp_path):
    made: list[str] = []
    monkeypatch.setattr(neardup, "shared_dir", lambda _: made.append(f"file://{tmp_path}/{len(made)}") or made[-1])
    assert neardup.near_duplicates(docs(spark)).count() == len(corpus())
    assert len(list(tmp_path.iterdir())) == 2


def test_neardup_repeated_ids_with_different_texts(spark):
    a, b, near = text(61, 120), text(62, 120), text(62, 120).replace(" ", " ", 1) + " tail"
    d = spark.createDataFrame([(1, a), (1, b), (2, near), (3, text(63, 120))], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(d, 3, 85).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


def test_repeated_rows(spark):
    """Whole repeated rows give repeated results."""
    rows = spark.createDataFrame([(1, text(5, 60), "en", "s0"), (1, text(5, 60), "en", "s0"), (2, "a b", "en", "s0"), (None, None, None, None), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    path, pattern = vocabulary()
    codes = bpe.encode(rows, path, pattern).collect()
    assert len(codes) == 5 and len({bytes(r.ids) for r in codes if r.doc_id == 1}) == 1
    cut = substring.remove_repeats(rows, 35).collect()
    assert sorted(r.n_removed for r in cut) == [0, 0, 0, 60, 60]
    assert mixing.mix(rows).count() == 5
    stored = media.described(media.store(rows)).collect()
    assert len(stored) == 3
    clash = bpe.decode(bpe.encode(rows, path, pattern).withColumn("decoded", F.lit("own")).withColumn("text", F.lit(1)), path, pattern)
    assert clash.columns == ["doc_id", "n_tokens", "ids", "text", "decoded"] and clash.count() == 5


def test_very_long_texts(spark):
    long = " ".join(f"{w} under the mit license" for w in text(3, 30_000).split())
    d = spark.createDataFrame([(1, long, "aa"), (2, "kurz und gut", "zz")] + [(i, text(i, 20), "aa") for i in range(3, 30)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_base for r in license.scan(d).collect()}[1] == 30_000
    net = langid.fit(d, F.lit(True))
    assert {r.doc_id: r.lang_pred for r in langid.predict(d, net).collect()}[1] in ("aa", "zz")
    path, pattern = vocabulary()
    turns = d.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), "text")
    assert {r.conv_id: r.loss_chars for r in chat.summaries(turns, path, pattern).collect()}[1] == len(long)
    pages = d.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/").alias("url"), F.col("text").alias("html"))
    assert sorted(r["size"] for r in warc.plan(pages).collect())[-1] == len(long)


def test_language_stage_fills_and_keeps(spark):
    rows = [(i, " ".join(w[::1] if i % 2 else w.upper() for w in text(i, 30).split()), ("aa", "zz")[i % 2] if i < 60 else None) for i in range(80)] + [(99, "12 !", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in langid.keep_identified(d, langid.fit(d, F.lit(True))).collect()}
    assert set(got) == set(range(80)) and all(got[i] == ("aa", "zz")[i % 2] for i in range(60))
    assert np.mean([got[i] == ("aa", "zz")[i % 2] for i in range(60, 80)]) >= 0.9
    nothing = langid.fit(empty(spark), F.lit(True))
    kept = langid.keep_identified(d.withColumn("lang", F.lit(None).cast("string")), nothing).collect()
    assert {r.doc_id for r in kept} == set(range(80)) and {r.lang for r in kept} == {None}


def test_windows_are_judged_alike_in_any_block(spark, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 300)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(docs(spark), 5, joiner=" ").collect()}
    assert got == removed(corpus(), 5)
