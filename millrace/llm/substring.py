"""Substring dedup: hashes of every window of words, counted across the corpus, and the words that repeated windows cover.

Plan. Documents are hashed into blocks of some megabytes; the one shuffle of the text puts a block together, and both passes
read it. Pass 1 takes the Rabin-Karp hash of every window of a block (prefix sums of a polynomial over 64-bit word hashes,
mod 2**64), keeps each distinct one once (the map-side combine: a window that a third of all documents share leaves a
block once) and sends them, packed, to buckets by a second, independent hash. A bucket finds the hashes that come from two
blocks or more and sends those back to the blocks that hold them. Pass 2 joins them with the block, marks every window whose
hash repeats in the block or was sent back, and merges marked windows into maximal intervals of words.

Two windows are taken as equal if the 64-bit hash and the bucket, together 64 + log2(buckets) bits, agree. For n distinct
windows the expected number of windows wrongly so is about n**2 / 2**(65 + log2(buckets)): 1e-5 for 1.4e8 windows.

Edge cases: null and empty texts have no words; a text of fewer words than a window keeps all; repeated rows are documents
of their own, so all their windows repeat; a null id is an id; ties don't occur; other columns are not read; an empty
table gives no rows. A text of any length is read whole, by one task, in a chunk of its own.

At scale: blocks and buckets keep their sizes, so memory doesn't grow with the corpus. A block's hashes thin out over the
buckets, down to a hash a row at some 10 TB, which costs about three times the bytes of a packed hash.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, fields, mixed, powers, release, word_hashes, words
from millrace.session import ship

BLOCK_BYTES = 8 << 20
#: Blocks that a partition of the text's shuffle holds at most, about: they are worked on one after another.
BLOCKS_A_PARTITION = 32
#: Hashes that a bucket holds, about.
BUCKET_HASHES = 1_000_000

_C1, _C2 = 0xA24BAED4963EE407, 0x9FB21C651E98DF25


def window_hashes(raw: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of every window in rows of UTF-8: its first word's number, its hash, its second hash; then the words as in :func:`words`."""
    starts, ends, at = words(raw, off)
    n = len(starts)
    row_end = np.repeat(at[1:], np.diff(at))
    first = np.flatnonzero(np.arange(n) + window <= row_end)
    if not len(first):
        z = np.zeros(0, np.uint64)
        return first, z, z, at, (starts, ends, at)
    h = word_hashes(raw, starts, ends)
    out = []
    for c in (_C1, _C2):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((h if c == _C1 else mixed(h ^ np.uint64(0x5851F42D4C957F2D))) * powers(n, c), out=sums[1:])
        out.append(mixed((sums[first + window] - sums[first]) * powers(n, pow(c, -1, 1 << 64))[first]))
    return first, out[0], out[1], at, (starts, ends, at)


def _blocks(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, int, int]:
    d = fields(docs, doc_id=id_col, text=text_col, **{f"keep_{i}": c for i, c in enumerate(keep)})
    total = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // (6 * BUCKET_HASHES)))
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // BLOCKS_A_PARTITION))
    # pmod of a hash of id and length: copies under one id do not all meet unless they are the same row
    d = d.withColumn("block", F.expr(f"pmod(xxhash64(doc_id, octet_length(text)), {blocks})"))
    return d.repartition(min(blocks, partitions), "block"), blocks, buckets


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", joiner: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words long, n_removed long, kept_text string, removed array<struct<first,last>> of words.

    kept_text is the words left joined by ``joiner``; without one, the text with the removed words and the white space after
    each cut out. ``keep`` columns of the input follow under their names.
    """
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    d, _, buckets = _blocks(docs, id_col, text_col, keep)

    def spread(table: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        second: list[np.ndarray] = []
        for _, raw, off in chunks(table.combine_chunks(), "text"):
            _, h, g, _, _ = window_hashes(raw, off, window)
            found.append(h)
            second.append((g % np.uint64(buckets)).astype(np.int32))
        h, g = np.concatenate(found), np.concatenate(second)
        order = np.lexsort((h, g))
        h, g = h[order], g[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        h, g = h[new], g[new]
        cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
        ends = np.append(cut[1:], len(g))
        block = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array(g[cut].astype(np.int32)), "block": pa.array(np.full(len(cut), block, np.int64)), "hashes": pa.array([h[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})

    def meet(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
        sizes = np.array([len(p) for p in parts])
        h = np.concatenate(parts)
        ordered = np.sort(h)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            hit = again[at] == h
        else:
            hit = np.zeros(len(h), bool)
        bounds = np.append(0, np.cumsum(sizes))
        release()
        got = [(int(k), h[a:b][hit[a:b]].tobytes()) for k, a, b in zip(blocks, bounds, bounds[1:]) if hit[a:b].any()]
        return pa.table({"block": pa.array([k for k, _ in got], pa.int64()), "bucket": pa.array([table.column("bucket")[0].as_py()] * len(got), pa.int32()), "hashes": pa.array([x for _, x in got], pa.binary())})

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        more = [f"keep_{i}" for i in range(len(keep))]
        names = ["doc_id", "n_words", "n_removed", "kept_text", "removed", *more]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        if not left.num_rows:
            none = [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), kind)]
            return pa.table([left.column("doc_id"), *none, *(left.column(c) for c in more)], names=names)
        sent = [np.frombuffer(x.as_py(), np.uint64) for x in right.column("hashes")]
        # a bucket's hashes are told from another's by the bucket number, mixed into the key
        known = [mixed(p ^ mixed(np.full(1, b, np.uint64))) for p, b in zip(sent, right.column("bucket").to_pylist())]
        got = [(part, *window_hashes(raw, off, window), raw) for part, raw, off in chunks(left.combine_chunks(), "text")]
        keys = [mixed(h ^ mixed(g % np.uint64(buckets))) for _, _, h, g, _, _, _ in got]
        ordered = np.sort(np.concatenate(keys))
        repeated = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], *known]))
        out = []
        for (part, first, _, _, at, (starts, ends, _), raw), key in zip(got, keys):
            n = len(starts)
            cover = np.zeros(n + 1, np.int64)
            if len(repeated) and len(first):
                hit = repeated[np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)] == key
                np.add.at(cover, first[hit], 1)
                np.add.at(cover, first[hit] + window, -1)
            gone = np.cumsum(cover)[:n] > 0
            total = np.append(0, np.cumsum(gone))
            n_words, n_removed = np.diff(at), total[at[1:]] - total[at[:-1]]
            texts, spans = [], []
            whole = part.column("text").combine_chunks() if isinstance(part.column("text"), pa.ChunkedArray) else part.column("text")
            for i in range(part.num_rows):
                text = (whole[i].as_py() or "").encode()
                a, b = at[i], at[i + 1]
                if not n_removed[i]:
                    texts.append(text if joiner is None else joiner.encode().join(text.split()))
                    spans.append([])
                    continue
                mask = gone[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])])
                if joiner is None:
                    base = starts[a]
                    lead = len(text) - len(text.lstrip(b" \t\n\r\x0b\x0c"))
                    limits = np.append(starts[a:b] - base + lead, len(text))
                    pieces = [text[:lead]]
                    last = 0
                    for x, y in zip(edge[::2], edge[1::2]):
                        pieces.append(text[limits[last] : limits[x]])
                        last = y
                    pieces.append(text[limits[last] :])
                    texts.append(b"".join(pieces))
                else:
                    texts.append(joiner.encode().join(compress(text.split(), ~mask)))
            out.append(pa.table([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, kind), *(part.column(c) for c in more)], names=names))
        release()
        return pa.concat_tables(out)

    hashes = d.groupBy("block").applyInArrow(spread, "bucket int, block long, hashes binary")
    back = hashes.groupBy("bucket").applyInArrow(meet, "block long, bucket int, hashes binary")
    kept = "".join(f", keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    r = d.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_text string, removed array<struct<first:long,last:long>>{kept}")
    return r.withColumnsRenamed({f"keep_{i}": c for i, c in enumerate(keep)})


OP5_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT r, unnest(range(1, len(words) - 33)) AS i, unnest(list_transform(range(1, len(words) - 33), lambda i: md5(array_to_string(words[i:i + 34], ' ')))) AS h FROM w WHERE len(words) >= 35),
again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
hits AS (SELECT g.r, g.i FROM g JOIN again USING (h)),
p AS (SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
c AS (SELECT p.r, p.i, p.word, max(CASE WHEN hits.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
      FROM p LEFT JOIN hits ON p.r = hits.r AND p.i = hits.i),
s AS (SELECT r, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s USING (r)
"""


def op5_substring(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 35, joiner=" ")
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
