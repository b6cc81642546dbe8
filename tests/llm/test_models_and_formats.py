"""Language ID, chat, BPE, media, top-k, licenses and WARC: exact round trips, brute force, held-out accuracy."""

import base64
import hashlib
import zlib
from re._parser import parse as parse_regex

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, langid, license, media, topk, warc
from millrace.llm.bpe_query import vocabulary
from millrace.session import shared_dir
from tests.llm.data import corpus, docs, empty

PATH, PATTERN = vocabulary()


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(codec, reference, s):
    s = s.encode("utf-8", "replace").decode()
    ids = codec.packed(s)
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(s) and codec.decode(ids) == s.encode()


@pytest.mark.parametrize("s", ["a" * 30000, "ab" * 9000, "é" * 5000, "日本" * 3000, "!" * 4096, " " * 3000 + "x", "\n\n \t x", "the" * 7000])
def test_bpe_very_long_pretokens(codec, reference, s):
    assert np.frombuffer(codec.packed(s), "<u4").tolist() == reference.encode_ordinary(s)


def test_rank_queue_order():
    q = bpe.RankQueue()
    for rank, at in [(50000, 1), (3, 9), (3, 2), (255, 0), (256, 0), (3, 5)]:
        q.push(rank, at)
    assert [q.pop() for _ in range(7)] == [(3, 2), (3, 5), (3, 9), (255, 0), (256, 0), (50000, 1), None]


def test_bpe_table(spark, reference):
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs(spark), PATH, PATTERN), PATH, PATTERN).collect()}
    for r in corpus():
        t = r[1] or ""
        assert np.frombuffer(bytes(got[r[0]].ids), "<u4").tolist() == reference.encode_ordinary(t) and bytes(got[r[0]].decoded) == t.encode()
    both = {r.doc_id: bytes(r.decoded) for r in bpe.encode(docs(spark), PATH, PATTERN, decoded=True).collect()}
    assert both == {k: bytes(r.decoded) for k, r in got.items()}
    assert bpe.encode(empty(spark), PATH, PATTERN).count() == 0


# chat

SAID = r"\### Assistant: </turn> ok"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("\\</>turn sayA#:ssitant é\n"), max_size=40))
def test_escapes_are_reversible(s):
    e = chat.escape(s)
    assert chat.unescape(e) == s
    bare = e.replace("\\\\", "")
    assert not any(bare.find(c) >= 0 and bare[bare.find(c) - 1] != "\\" for c in chat.CONTROL)


def test_chat(spark, codec):
    rows = [(1, 1, "assistant", SAID), (1, 0, "user", None), (1, 2, "assistant", "é</turn>"), (2, 0, "user", "x"), (None, 0, None, "n"), (3, None, "assistant", "late"), (3, None, "assistant", "late")]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, ids long")
    got = {r.conv_id: r for r in chat.summaries(d, PATH, PATTERN).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert got[1].turns_sha256 == sha(f"user\n\nassistant\n{SAID}\nassistant\né</turn>\n") and got[1].n_turns == 3
    assert got[1].loss_sha256 == sha(SAID + "é</turn>") and got[1].loss_chars == len(SAID) + 8
    assert got[2].loss_chars == 0 and got[2].loss_sha256 == sha("") and got[3].n_turns == 2 and got[3].loss_sha256 == sha("latelate")
    t = {(r.conv_id, r.turn): r for r in chat.turns(d, PATH, PATTERN).where("conv_id = 1").collect()}
    r = t[1, 1]
    assert r.rendered.startswith("<turn>assistant<says>") and r.rendered.endswith("</turn>") and r.rendered.count("</turn>") == 2 and "\\</turn>" in r.rendered
    assert len(r.ids) == len(r.loss_mask) and sum(r.loss_mask) == len(codec.packed(chat.escape(SAID))) // 4
    assert chat.summaries(d.limit(0), PATH, PATTERN).count() == 0


# language ID


def test_gradients_by_differences():
    r = np.random.default_rng(0)
    net = langid.Network.fresh(["a", "b"], hidden=3)
    for p in net.parameters():
        p[...] = r.standard_normal(p.shape) * 0.4
    x = r.integers(0, 5, (6, 4)).astype(np.int16)
    gold, mask = np.array([0, 1, 1, 0]), np.ones((6, 4), np.float32)
    _, grads = net.step(x, gold, mask)
    for p, g in zip(net.parameters(), grads):
        for _ in range(6):
            at = tuple(r.integers(0, n) for n in p.shape)
            old = p[at]
            p[at] = old + 1e-2
            up = net.step(x, gold, mask)[0]
            p[at] = old - 1e-2
            down = net.step(x, gold, mask)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_step_and_positions_agree():
    net = langid.Network.fresh(["a", "b", "c"], hidden=4)
    x = np.random.default_rng(1).integers(0, 256, (10, 7)).astype(np.int16)
    p = net.positions(x)
    loss, _ = net.step(x, np.zeros(7, int), np.ones((10, 7), np.float32))
    assert loss == pytest.approx(-np.log(p[:, 0, :] + 1e-9).mean(), abs=1e-4)
    raw = np.ascontiguousarray(x.T).astype(np.uint8).ravel()
    assert np.allclose(net.pooled(raw, np.arange(8) * 10), p.mean(0).T, atol=1e-5)


def test_langid(spark):
    vowels = {"aa": "aeiou", "zz": "zxqjk"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list(vowels[lang] + "nrst"), 5)) for _ in range(30)), lang) for i in range(120) for lang in [("aa", "zz")[i % 2]]]
    rows += [(500, None, "aa"), (501, "12 !", "aa"), (502, "", None), (503, rows[0][1], None)]
    d = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    net = langid.fit(d, ~langid.held_out(F.col("doc_id")))
    got = {r.doc_id: r for r in langid.predict(d, net).collect()}
    held = [r for r in rows if r[0] < 500 and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) >= 0.95
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and got[500].score == 0 and got[503].lang_pred == got[0].lang_pred
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in langid.keep_identified(d, net).collect()} == {r[0] for r in rows} - {500, 501, 502}
    none = langid.fit(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs(spark), none).collect()} == {"und"} and langid.predict(empty(spark), none).count() == 0


# media


def test_png_round_trip():
    for n in (0, 1, 575, 576, 577, 5000):
        p = media.padded(bytes(range(256)) * (n // 256) + b"x" * (n % 256))
        assert len(p) % 576 == 0 and p and media.from_png(media.to_png(p)) == p
    bad = bytearray(media.to_png(p))
    bad[60] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(bad))


def test_interleaving():
    got = media.parse('<article><p>a<img src="x.png" alt="alt">b</p><script>no</script><figure><img src="media:sha256:dd"><figcaption>c &amp; d</figcaption></figure>end')
    assert [(s["position"], s["kind"], s["text"]) for s in got] == [(0, "text", "a"), (1, "media", "alt"), (2, "text", "b"), (3, "media", "c & d"), (4, "text", "end")]
    assert got[3]["digest"] == "dd" and media.parse(None) == [] and media.parse("<p><b>x") != []


def test_captions_stay_with_their_figures(spark):
    figure = lambda *x: "<figure>" + "".join(x) + "</figure>"
    img = lambda k: f'<img src="media:sha256:{k}" alt="alt {k}">'
    cap = lambda x: f"<figcaption>{x}</figcaption>"
    page = "one" + figure(img(1), cap("first")) + "two" + figure(cap("second"), img(2)) + figure(cap("<p>no</p><p>image</p>")) + "three" + figure(img(3)) + cap("loose") + figure(img(4), img(5), cap("of 5"), cap("of 4"), cap("more"))
    want = [("text", "one"), ("media", "first"), ("text", "two"), ("media", "second"), ("text", "no image"), ("text", "three"), ("media", "alt 3"), ("text", "loose"), ("media", "of 4"), ("media", "of 5"), ("text", "more")]
    pages = {
        1: (page, want),
        2: ("<figure>" + img(1) + "<figcaption>open</figure><p>after</p>" + img(2), [("media", "open"), ("text", "after"), ("media", "alt 2")]),
        3: ("<article><figure>" + img(1) + "<figcaption>open</article><p>after</p>", [("media", "open"), ("text", "after")]),
        4: (img(1) + "<figcaption>never closed <b>but kept", [("media", "alt 1"), ("text", "never closed but kept")]),
        5: (figure(figure(img(1), cap("inner")), img(2), cap("outer"), "tail"), [("media", "inner"), ("media", "outer"), ("text", "tail")]),
        6: (figure(img(1), cap("a" + img(2) + "b")), [("media", "a b"), ("media", "alt 2")]),
    }
    d = spark.createDataFrame([(k, h) for k, (h, _) in pages.items()], "page_id long, html string")
    got = media.interleave(d)
    for r in got.collect():
        assert [(s.kind, s.text) for s in r.segments] == pages[r.id][1] and [s.position for s in r.segments] == list(range(len(r.segments))), r.id
    texts = spark.createDataFrame([("x",), ("y",)], "text string")
    x = hashlib.sha256(b"x").hexdigest()
    one = spark.createDataFrame([(1, "t" + figure(cap("of x"), img(x)) + "u" + figure(img("none"), cap("of none")))], "page_id long, html string")
    r = media.resolve(media.references(media.interleave(one)), media.described(media.store(texts))).collect()
    assert sorted((a.id, a.position, a.caption, a.digest, a.n_bytes) for a in r) == [(1, 1, "of x", x, 1), (1, 3, "of none", "none", None)]


def test_media_table(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in media.op4_media(spark, str(tmp_path)).collect()}
    assert len(got) == len(corpus())
    for r in corpus():
        raw = (r[1] or "").encode()
        p, g = media.padded(raw), got[r[0]]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert g.media_bytes == len(media.to_png(p)) and g.feature == media.features(p)
        # the stored form and the feature, written out without the operator
        samples = np.frombuffer(p, np.uint8)
        share = np.bincount(samples, minlength=256) / len(samples)
        size, mean, dev, bits = (x.partition("=")[2] or x for x in g.feature.split(";"))
        assert size == f"576x{len(p) // 576}" and float(mean) == pytest.approx(samples.mean(), abs=6e-4) and float(dev) == pytest.approx(samples.std(), abs=6e-4)
        assert float(bits) == pytest.approx(-sum(x * np.log2(x) for x in share if x), abs=6e-4)
        image = media.to_png(p)
        assert g.media_bytes == len(image) and g.media_sha256 == hashlib.sha256(image).hexdigest() and png_samples(image) == p
    values = [c for c in media.op4_media(spark, str(tmp_path)).columns if c != "doc_id"]
    assert [got[5][c] for c in values] == [got[6][c] for c in values]  # equal texts, equal values
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    pages = docs(spark).select("doc_id", media.page_of(F.concat(F.lit("document "), F.col("doc_id").cast("string")), digest).alias("html"))
    found = media.resolve(media.references(media.interleave(pages, "doc_id")), media.described(media.store(docs(spark)))).collect()
    assert {(r.id, r.position, r.caption, r.n_bytes) for r in found} == {(r[0], 0, f"document {r[0]}", len((r[1] or "").encode())) for r in corpus()}
    empty(spark).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert media.op4_media(spark, str(tmp_path / "none")).count() == 0


def png_samples(image: bytes) -> bytes:
    """The samples of an 8-bit grey PNG whose lines use filter 0, read without the operator."""
    assert image[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, width = 8, b"", 0
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(image[at + 8 + n : at + 12 + n], "big")
        width = int.from_bytes(body[:4], "big") if kind == b"IHDR" else width
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    raw = zlib.decompress(data)
    lines = [raw[i : i + width + 1] for i in range(0, len(raw), width + 1)]
    assert all(x[0] == 0 for x in lines)
    return b"".join(x[1:] for x in lines)


# top-k


def brute(rows, k, scale=256):
    ok = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 64)
    monkeypatch.setattr(topk, "GROUP_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    r = np.random.default_rng(0)
    rows = [(i, (r.integers(-3, 4, 16) / 256).tolist() if i % 7 else r.standard_normal(16).tolist()) for i in range(400)]
    rows += [(1000, None), (1001, [None] * 16), (1050, [float("nan")] * 16), (1051, [float("inf")] * 16), (None, [1.0] * 16), (50, rows[3][1]), (1100, [])]
    d = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<double>, score int")
    assert topk.search(d, F.col("vec_id") % 50 == 0).count() > 0  # an id that stands twice doesn't break it
    clean = [x for x in rows if x[0] != 50 or x[1] is not rows[3][1]]
    d = spark.createDataFrame(clean, "vec_id long, embedding array<double>")
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk.search(d, F.col("vec_id") % 50 == 0).collect()) == brute(clean, 5)
    assert topk.search(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(d.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0  # no other row


def test_topk_large_numbers_and_pruning():
    r = np.random.default_rng(1)
    q = r.integers(-(2**40), 2**40, (3, 8)).astype(float)
    x = r.integers(-(2**40), 2**40, (50, 8)).astype(float)
    i, ids, s, _ = topk.best(q, np.arange(100, 103), x, np.arange(50), 2)
    assert len(i) == 6
    for a in range(3):
        best = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(int(u) * int(v) for u, v in zip(q[a], x[b])))), b) for b in range(50))[:2]
        assert [(-n, b) for n, b in best] == [(int(n), int(b)) for k, b, n in zip(i, ids, s) if k == a]
    # clustered vectors: coarse bounds leave few pairs
    centres = np.repeat(np.linspace(-200, 200, 40), 64)[:, None] * np.ones((1, 64))
    data = np.floor(centres + r.standard_normal(centres.shape))
    data = data[np.argsort(-data.mean(1))]
    _, _, _, exact = topk.best(data[:2], np.array([0, 1]), data, np.arange(len(data)), 5)
    assert exact < 2 * len(data)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_bounds_hold(dims, seed):
    r = np.random.default_rng(seed)
    a, b = r.standard_normal((4, dims)) * 50, r.standard_normal((5, dims)) * 50
    for level in topk.LEVELS:
        assert (topk.statistics(a, level) @ topk.statistics(b, level).T >= a @ b.T - 1e-6).all()


# licenses


def test_license_rules():
    assert sum(map(len, license.rules().values())) >= 200
    w, n = license.words_of("Under the MIT License; CC-BY-NC 4.0. cc by nc sa, Apache License, Version 2.0 (x)")
    assert license.base_places(w) == {"mit": [0], "cc-by-nc": [4, 9], "apache-2": [13]} and n == 19
    found = [(x, y, z) for x, y, z, _ in license.detections(w)]
    assert (9, 13, "cc-by-nc-sa") in found  # it holds the shorter cc by nc, which is suppressed
    assert not any(z == "cc-by-nc" and x == 9 for x, _, z in found)
    assert license.detections(license.words_of("summit license committee")[0]) == []


def matches(tree) -> list[str]:
    """Texts that a parsed regex matches: every branch, one of each class, repeats at their least and once more."""
    out = [""]
    for op, v in tree:
        op = str(op)
        if op == "LITERAL":
            part = [chr(v)]
        elif op == "IN":
            part = [chr(x) if str(o) == "LITERAL" else chr(x[0]) if str(o) == "RANGE" else "q" for o, x in v]
        elif op == "BRANCH":
            part = [x for branch in v[1] for x in matches(branch)]
        elif op == "SUBPATTERN":
            part = matches(v[3])
        elif op == "MAX_REPEAT":
            part = [x * n for n in {v[0], min(v[0] + 1, int(v[1]))} for x in matches(v[2])]
        else:
            assert op in ("ASSERT", "ASSERT_NOT"), op
            part = [""]
        out = [a + b for a in out for b in dict.fromkeys(part)]
    return out


def test_license_keywords_are_in_every_match():
    for keyword, own in license.rules().items():
        for _, label, _, regex in own:
            for text in matches(parse_regex(regex.pattern.decode())):
                w, _ = license.words_of(text)
                assert keyword in w and any(m.group() == text.encode() for m in regex.finditer(w)), (label, text)
    for text, label in [("Expat License", "mit"), ("Sun Industry Standards Source License", "sun-sissl"), ("SISSL", "sun-sissl"), ("OpenRAIL", "openrail"), ("openrail license", "openrail"), ("CreativeML Open RAIL-M", "openrail"), ("open rail m license", "openrail")]:
        assert [x[2:] for x in license.detections(license.words_of(f"see {text} here")[0])] == [(label, 0.9 if label == "openrail" else 0.85)], text


def test_license_table(spark):
    rows = [(1, "x under the mit license under the MIT license"), (2, None), (3, "under the mit licensed"), (4, "Éunder the mit license"), (5, "GPL version 2 or later"), (1, "again")]
    d = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, text string, labels string")
    got = sorted(license.scan(d).collect(), key=lambda r: (r.doc_id, r.n_words))
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [(1, 1, 0, None, None, ""), (1, 9, 2, 1, 5, "mit"), (2, 0, 0, None, None, ""), (3, 4, 0, None, None, ""), (4, 4, 0, None, None, ""), (5, 5, 0, None, None, "")]
    assert got[1].labels == "mit" and got[1].score == 1.0 and got[2].score == 0.0
    assert license.scan(d.limit(0)).count() == 0


# WARC


def pages(spark):
    big, other = "<p>é" + "x" * 2000, "y" * 1000
    rows = [(1, "http://a.org/x?q=1", big), (2, "https://b.a.org:8080/", big), (3, None, big), (4, "http://a.org/x?q=1", "s"), (5, "http://a.org/z", "s"), (6, "not a url [", None), (7, "http://c.org/", other), (8, "http://c.org/", other), (9, "http://[bad", "")]
    return rows, spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, record_type string")


def test_warc(spark):
    rows, d = pages(spark)
    folder = shared_dir(spark)
    captures = warc.archive(d, folder)
    got = {r.page_id: r for r in warc.read(captures, f"{folder}/archive").collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw = (html or "").encode()
        same = [k for k, _, h in rows if h == html and len(raw) >= 1000]
        want = ("revisit", max(same)) if same and i != max(same) else ("response", None)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to, got[i].url) == (len(raw), hashlib.sha1(raw).hexdigest(), *want, url or "")
        assert got[i].payload is None if want[0] == "revisit" else bytes(got[i].payload) == raw
    directory = sorted((r.first_key, r.file, r.start, r.length) for r in spark.read.parquet(f"{folder}/directory").collect())
    found = warc.lookup(directory, f"{folder}/index", f"{folder}/archive", "http://a.org/x?q=1")
    assert sorted(h["WARC-Page-ID"] for h, _ in found) == ["1", "4"]
    assert warc.lookup(directory, f"{folder}/index", f"{folder}/archive", "http://a.org/none") == []
    assert all(base64.b32decode(h["WARC-Payload-Digest"][5:]).hex() for h, _ in found)


def test_warc_index_blocks(spark):
    d = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i // 6}", "t") for i in range(60)], "page_id long, url string, html string")
    folder = shared_dir(spark)
    c = warc.write(warc.plan(d), f"{folder}/archive")
    c.write.parquet(f"{folder}/captures")
    c = spark.read.parquet(f"{folder}/captures")
    directory = sorted((r.first_key, r.file, r.start, r.length) for r in warc.build_index(c, f"{folder}/index", block=4).collect())
    assert len(directory) >= 15
    for i in range(0, 60, 7):
        found = warc.lookup(directory, f"{folder}/index", f"{folder}/archive", f"http://h{i % 3}.org/{i // 6}")
        assert sorted(int(h["WARC-Page-ID"]) for h, _ in found) == [j for j in range(60) if (j % 3, j // 6) == (i % 3, i // 6)]


def test_warc_index_of_odd_urls(spark):
    """Keys beyond ASCII, quotes and backslashes are sorted as they are sought; the blocks give every place that was written."""
    tails = ["a", "b", "z", "é", "éa", '"q"', "[", "\\", "\\a", "~", "A", "日本", "zé", "\U0001f600", "￿"]
    urls = [f"http://h.org/{x}" for x in tails] + ["http://é.org/", "http://z.org/", "http://[bad\n\té", None]
    d = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls * 2)], "page_id long, url string, html string")
    folder = shared_dir(spark)
    c = warc.write(warc.plan(d), f"{folder}/archive")
    c.write.parquet(f"{folder}/captures")
    c = spark.read.parquet(f"{folder}/captures")
    for block in (4, 100):
        index = f"{folder}/index{block}"
        warc.build_index(c, index, block=block).write.parquet(f"{folder}/directory{block}")
        written = spark.read.parquet(f"{folder}/directory{block}")
        directory = sorted((r.first_key, r.file, r.start, r.length) for r in written.collect())
        for i, u in enumerate(urls):
            assert sorted(int(h["WARC-Page-ID"]) for h, _ in warc.lookup(directory, index, f"{folder}/archive", u)) == [i, i + len(urls)], u
        assert warc.lookup(directory, index, f"{folder}/archive", "http://h.org/è") == []
        assert sorted(map(tuple, warc.places(written, index).collect())) == sorted(map(tuple, c.select("url_key", "file", "start", "length").collect()))


def test_op8_reads_by_the_index(spark, tmp_path, monkeypatch):
    _, d = pages(spark)
    d.write.parquet(str(tmp_path / "pages.parquet"))
    assert warc.op8_warc(spark, str(tmp_path)).count() == 9
    whole = warc.build_index
    monkeypatch.setattr(warc, "build_index", lambda c, folder: whole(c.where("page_id <> 5"), folder))
    assert {r.page_id for r in warc.op8_warc(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 6, 7, 8, 9}


def test_warc_empty(spark):
    _, d = pages(spark)
    folder = shared_dir(spark)
    assert warc.read(warc.archive(d.limit(0), folder), f"{folder}/archive").count() == 0


def test_url_keys():
    assert warc.url_key("https://B.a.org:8080/p?q") == "org,a,b:8080)/p?q" and warc.url_key(None) == ")/"
