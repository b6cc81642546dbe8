"""The pipeline against a brute-force version of its stages, over the small corpus."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from millrace.llm import bpe
from millrace.llm.bpe_query import vocabulary
from tests.llm.data import corpus, docs, empty, text
from tests.llm.test_text_operators import WORD, linked


def cut(rows, window=35):
    words = {r[0]: list(re.finditer(WORD.pattern, r[1] or "")) for r in rows}
    grams = lambda w: [tuple(m.group() for m in w[i : i + window]) for i in range(len(w) - window + 1)]
    n = Counter(g for w in words.values() for g in grams(w))
    out = {}
    for k, text, *_ in rows:
        w = words[k]
        gone = set()
        for i, g in enumerate(grams(w)):
            if n[g] > 1:
                gone |= set(range(i, i + window))
        text = text or ""
        ends = [m.start() for m in w[1:]] + [len(text)]
        out[k] = (text[: w[0].start()] if w else text) + "".join(text[m.start() : e] for i, (m, e) in enumerate(zip(w, ends)) if i not in gone)
    return out


def mixed(texts, sources):
    size = {k: len(WORD.findall(t)) for k, t in texts.items()}
    names = sorted({s for s in sources.values() if s is not None}) + [None] * (None in sources.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    own = {s: sum(n for k, n in size.items() if sources[k] == s) for s in names}
    capped: set = set()
    while True:
        level = (sum(own.values()) - sum(3 * own[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and weight[s] * level > 3 * own[s]}
        if not over:
            break
        capped |= over
    out = {}
    for s in names:
        target = 3.0 * own[s] if s in capped else weight[s] * level
        rate = target / own[s] if own[s] else 0.0
        u = int(hashlib.md5(f"mix|{chr(0) + 'null' if s is None else s}".encode()).hexdigest()[:8], 16) / 2**32
        bits = lambda n: max(1, n.bit_length())
        order = sorted((bits(size[k]) * 32 + (size[k] >> max(bits(size[k]) - 5, 0)), hashlib.md5(str(k).encode()).hexdigest(), k) for k in size if sources[k] == s)
        for rank, (_, _, k) in enumerate(order, 1):
            out[k] = math.floor(rank * rate + u) - math.floor((rank - 1) * rate + u)
    return out


def test_pipeline(spark, tmp_path):
    docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [r for r in corpus() if any(map(str.isalpha, r[1] or ""))]
    kept = [r for r in rows if linked(rows, 5, 80)[r[0]][1] == r[0]]
    texts = cut(kept)
    copies = mixed(texts, {r[0]: r[3] for r in kept})
    path, pattern = vocabulary()
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    want = Counter()
    for k, n in copies.items():
        if n:
            ids = np.array(reference.encode_ordinary(texts[k]), "<u4").tobytes()
            want[k, len(ids) // 4, ids, hashlib.sha256(texts[k].encode()).hexdigest()] += n
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in got) == want


def test_pipeline_keeps_one_of_repeated_and_null_ids(spark, tmp_path):
    """Clean documents ingested twice, or once more without an id, stay whole; other texts under one id are documents of their own."""
    a, b, c, d, e = (text(i, 80) for i in range(70, 75))
    near = c.replace(c.split()[40], "changed", 1)
    rows = [(1, a), (1, a), (2, b), (None, b), (None, near), (3, c), (None, d), (None, d), (4, e), (4, text(75, 80)), (1, a)]
    spark.createDataFrame([(k, t, "en", "s0", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, df, str(tmp_path)).collect()), key=str)
    assert left == sorted([(1, a), (2, b), (3, c), (None, d), (4, e), (4, text(75, 80))], key=str)
    got = Counter((r.doc_id, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert set(got) == {(k, hashlib.sha256(t.encode()).hexdigest()) for k, t in left} and len(set(got.values())) == 1


def test_pipeline_of_an_empty_table_and_of_clashing_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([(i, text(80 + i, 60), None, "s", 1, i, "c", 7, "k", 3.0, "g") for i in range(6)], kind + ", row long, component string, block long, set_key string, size double, kept string")
    own = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = stage(spark, own, str(tmp_path))
        assert own.columns == rows.columns
    assert {r.doc_id for r in own.collect()} <= set(range(6)) and own.where("component <> 'c' OR block <> 7 OR set_key <> 'k' OR size <> 3.0 OR kept <> 'g' OR row <> doc_id").count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "substring dedup", "mixing to target weights", "byte-level BPE"] and corpus_pipeline.ORACLE_SQL is None
