"""Substring dedup, near-dedup and mixing against brute force."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing, neardup, substring
from tests.llm.data import corpus, docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, window):
    words = {r[0]: WORD.findall(r[1] or "") for r in rows}
    n = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for k, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [3, 35])
def test_substring(spark, window, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(substring, "BUCKET_HASHES", 700)  # several blocks and buckets
    got = {r.doc_id: r for r in substring.remove_repeats(docs(spark), window, joiner=" ").collect()}
    want = removed(corpus(), window)
    assert {k: (r.n_words, r.n_removed, r.kept_text) for k, r in got.items()} == want
    for r in got.values():
        assert sum(s["last"] - s["first"] + 1 for s in r.removed) == r.n_removed
        assert all(a["last"] + 1 < b["first"] for a, b in zip(r.removed, r.removed[1:]))  # maximal intervals


def test_substring_keeps_white_space_and_columns(spark):
    r = substring.remove_repeats(docs(spark), 35, keep=("source", "block")).collect()
    by = {x.doc_id: x for x in r}
    assert by[2].kept_text == "   \n\t" and by[15].kept_text == "naïve café ☃ 日本語 MIT" and by[5].kept_text == ""
    assert by[11].kept_text.split() == WORD.findall(corpus()[11][1])[:100] and by[5].source == "s1" and by[5].block == 5
    assert substring.remove_repeats(empty(spark), 35).count() == 0


def sets(rows, size):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    out = {}
    for r in rows:
        w = WORD.findall((r[1] or "").translate(low))
        out[r[0]] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def linked(rows, size, percent):
    s = sets(rows, size)
    group = {k: k for k in s}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in combinations(s, 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = find(a), find(b)
            group[max(x, y)] = min(x, y)
    return {k: (len(s[k]), find(k)) for k in s}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_neardup(spark, size, percent):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs(spark), size, percent).collect()}
    want = linked(corpus(), size, percent)
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_neardup_chain(spark):
    """A chain of texts, each near the next: one component though its ends are far apart; runs are split across tiles."""
    words = [f"c{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 160])) for i in range(18)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, 3, 85).collect()}
    assert got == {k: c for k, (_, c) in linked(rows, 3, 85).items()} and set(got.values()) == {0}


def test_neardup_empty_and_null_ids(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(str, neardup.near_duplicates(d).select("doc_id", "component_id", "kept").collect()))
    assert len(got) == 3 and all("kept=True" in x for x in got)


def test_plan_guarantees_the_distance():
    for similarity in (0.8, 0.85, 0.9):
        distance, m = neardup.plan(similarity)
        assert distance == 2 * m - 1
        r = np.random.default_rng(1)
        for _ in range(200):
            a = r.integers(0, 65536, neardup.K).astype(np.uint16)
            b = a.copy()
            at = r.choice(neardup.K, distance, replace=False)
            b[at] ^= 1
            ka, kb = neardup.keys(np.stack([a, b]), m)
            assert (ka == kb).any()  # pigeonhole: they meet under a key


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    d = spark.createDataFrame(edges, "rep long, hub long")
    got = {r.node: r.component for r in neardup.components(d).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def test_mix(spark):
    m = mixing.mix(docs(spark)).collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in corpus()}
    assert {r.doc_id: r["size"] for r in m} == size
    assert all(0 <= r.copies <= 3 for r in m)
    weights = dict(zip(["s0", "s1", None], (5, 2, 1)))
    total = sum(size.values())
    own = {s: sum(n for k, n in size.items() if corpus()[k][3] == s) for s in weights}
    target, capped = {}, set()
    while True:
        free = [s for s in weights if s not in capped]
        level = (total - sum(3 * own[s] for s in capped)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * own[s]}
        target = {s: 3 * own[s] if s in capped else weights[s] * level for s in weights}
        if not over:
            break
        capped |= over
    assert {(r.source, r.source_size) for r in m} == set(own.items())
    for r in m:
        assert r.target == pytest.approx(target[r.source])
    assert sorted(map(str, m)) == sorted(map(str, mixing.mix(docs(spark).repartition(3)).collect()))  # reruns agree


def test_mix_comes_near_targets_and_emits(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    by = mixing.mix(d).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect()
    assert all(abs(r.n - r.t) <= 0.02 * r.t + 60 for r in by), by
    taken = mixing.mix(d).agg(F.sum("copies")).first()[0]
    out = mixing.emitted(d)
    assert out.columns == d.columns and out.count() == taken
    assert mixing.emitted(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0


def test_mix_is_native(spark):
    plan = mixing.mix(docs(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
