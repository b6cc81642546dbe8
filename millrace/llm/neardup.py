"""MinHash near-dedup by a multi-index Hamming join.

Signatures: k minima of hashed word shingles, b = 16 bits kept of each. Documents of Jaccard similarity s differ at a symbol
with probability 1 - s, so their Hamming distance is binomial; :func:`plan` finds the distance that a pair at the threshold
stays under but for a chance below ``MISS``. The signature is split into m chunks and, by pigeonhole, two signatures at
most m * (r + 1) - 1 apart have a chunk with r errors or fewer; with r = 1 each chunk is indexed with every one of its
symbols left out in turn, so such a pair always meets under a key. All pairs under the distance are therefore found.

Plan. (1) One pass over the texts, without a shuffle of them: shingle count, 128-bit digest of the set, signature.
(2) Equal sets are one class, of which one document goes on; groups of copies vanish here by a partial aggregation.
(3) The keys, packed, meet in buckets; a key held by two or more gives a run. What shares a key within a task is joined there,
and one of them goes on, so a key that a third of all documents hold sends a bucket one entry of each task. (4) Each member of
a run is compared with the run's smallest: signatures first, full shingle sets of what is left; links give components.
(5) Runs that still hold members of different components give the pairs across components that lie under the distance and
whose sizes allow the similarity, each pair in one of its runs only; they are compared as well. Pairs within a component need
no comparison, since they can't change it. No run is capped and no run gives all its pairs. (6) Components by alternating
large-star and small-star rounds, each written out. Full sets go to a comparison once for each group of pairs, not once a pair.
What was written is deleted when its last reader is done; the result itself reads two tables, which stay.

Edge cases: a document without words or text has no shingles and is linked with nothing; with fewer words than a shingle,
its whole sequence is one shingle; a text of any length is read whole, in a chunk of its own; repeated rows are one class;
rows of one id with different texts are one document, linked with what any of them is linked with; ids are whole numbers
(text that reads as one is taken as it, other text raises); a null id takes no part and comes back as its own (null)
component, kept; other columns are not read; an empty table gives no rows; ties go to the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import chunks, fields, looked_up, lowered, mixed, release, released, word_hashes, words
from millrace.session import remove, shared_dir, ship

K = 96
MISS = 1e-5
#: Keys that a bucket holds, about.
BUCKET_KEYS = 500_000
#: Members of runs whose signatures meet in a bin, about.
BIN_MEMBERS = 60_000
#: Keys that a task packs at once.
FLUSH_KEYS = 500_000
#: Rows of two or three longs that are broadcast, some 40 MB as a hash table; more are joined by a shuffle, with the same result.
BROADCAST_ROWS = 500_000
#: Members of a run whose signatures are compared in one piece.
TILE = 16_384
#: Shingles of full sets that a comparison holds, about.
GROUP_SHINGLES = 4_000_000
#: Documents of a class from which on its label is broadcast: of n documents, n / HOT such classes at most.
HOT = 1_000_000

_RNG = np.random.default_rng(77)
_MUL = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 256, dtype=np.uint64)


def plan(similarity: float, k: int = K, miss: float = MISS) -> tuple[int, int]:
    """The distance that a pair of the given similarity exceeds with a chance below ``miss``, and the number of chunks that guarantees it with one error each."""
    p, tail, d = 1 - similarity, 1.0, -1
    while tail > miss:
        d += 1
        tail -= comb(k, d) * p**d * (1 - p) ** (k - d)
    m = -(-(d + 1) // 2)
    return 2 * m - 1, m


def shingles(raw: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, sorted within it, and their n + 1 offsets."""
    starts, ends, at = words(raw, off)
    h = word_hashes(raw, starts, ends)
    n_words = np.diff(at)
    n_out = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.append(0, np.cumsum(n_out))
    row = np.repeat(np.arange(len(n_words)), n_out)
    first = at[:-1][row] + np.arange(bounds[-1]) - bounds[:-1][row]
    out = np.full(len(row), 0x8BADF00D5CA1AB1E, np.uint64)
    length = np.minimum(n_words, size)[row]
    for i in range(size):
        has = i < length
        step = h[np.minimum(first + i, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(has, mixed(out * np.uint64(0xF1357AEA2E62A9C5) + step), out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(len(n_words) + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray, k: int = K) -> np.ndarray:
    """Of every row that has shingles: k 16-bit symbols; zeros for the others."""
    out = np.zeros((len(bounds) - 1, k), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i in range(k):
            least = np.minimum.reduceat((sets ^ _ADD[i]) * _MUL[i], bounds[:-1][full])
            out[full, i] = (mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def keys(signature: np.ndarray, m: int) -> np.ndarray:
    """Per signature, a key for each symbol: its chunk with that symbol left out. (One error allowed in every chunk.)"""
    n, k = signature.shape
    out = np.empty((n, k), np.uint64)
    cuts = np.linspace(0, k, m + 1).astype(int)
    wide = signature.astype(np.uint64)
    for a, b in zip(cuts, cuts[1:]):
        for hole in range(a, b):
            h = np.full(n, hole + 1, np.uint64)
            for i in range(a, b):
                if i != hole:
                    h = mixed(h * np.uint64(0xF1357AEA2E62A9C5) + wide[:, i] + np.uint64(1))
            out[:, hole] = h
    return out


def profiles(docs: DataFrame, size: int, k: int = K) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key (128 bits; null without shingles), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in chunks(batch, "text"):
                sets, bounds = shingles(lowered(raw), off, size)
                sig, n = signatures(sets, bounds, k), np.diff(bounds)
                digest = np.zeros((len(n), 2), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    for i, c in enumerate((0x2545F4914F6CDD1D, 0xD1342543DE82EF95)):
                        digest[full, i] = mixed(np.add.reduceat(mixed(sets * np.uint64(c)), bounds[:-1][full]) + n[full].astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array([d.tobytes() if x else None for d, x in zip(digest, n)], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    ["doc_id", "n_shingles", "set_key", "signature"],
                )

    return docs.mapInArrow(released(run), "doc_id long, n_shingles long, set_key binary, signature binary")


def _runs(key: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by key and rep, the run's smallest rep of each, and whether a key has two entries or more."""
    order = np.lexsort((rep, key))
    key, rep = key[order], rep[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(at, len(key)))
    return np.stack([key, rep.view(np.uint64)]), np.repeat(rep[at], sizes), np.repeat(sizes > 1, sizes)


def runs_of(reps: DataFrame, n: int, m: int, k: int = K) -> DataFrame:
    """Key runs of two members or more: hole int, key long, rep long, hub long (a smaller member, itself for the smallest). A run's rows may hold a member twice."""
    each = max(1, -(-n // BUCKET_KEYS))  # a bucket holds keys of one hole

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        names = ["bucket", "keys", "reps", "hubs"]

        def packed() -> Iterator[pa.RecordBatch]:
            sig, ids = (np.concatenate([x[i] for x in waiting]) for i in (0, 1))
            waiting.clear()
            all_keys = keys(sig, m)
            for hole in range(k):
                (key, rep), hub, many = _runs(all_keys[:, hole], ids)
                rep = rep.view(np.int64)
                if many.any():  # settled here; salted, so that no bucket gets all of a hot key
                    own = key[many]
                    salt = -1 - (hole + k * int(mixed(own[:1] ^ rep[many][:1].view(np.uint64))[0] % np.uint64(each)))
                    yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (own, rep[many], hub[many]))], names)
                first = rep == hub
                key, rep = key[first], rep[first]
                bucket = (mixed(key) % np.uint64(each)).astype(np.int64) * k + hole
                order = np.argsort(bucket, kind="stable")
                key, rep, bucket = key[order], rep[order], bucket[order]
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(cut[1:], len(bucket))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for x in (key, rep)), pa.nulls(len(cut), pa.binary())], names)

        for batch in batches:
            waiting.append((np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint16).reshape(-1, k), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            if sum(len(x) for _, x in waiting) * k > FLUSH_KEYS:
                yield from packed()
        if waiting:
            yield from packed()

    def meet(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        key, rep = (np.concatenate([np.frombuffer(x.as_py(), t) for x in table.column(c)]) for c, t in (("keys", np.uint64), ("reps", np.int64)))
        if bucket < 0:
            hub = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("hubs")])
        else:
            (key, rep), hub, many = _runs(key, rep)
            key, rep, hub = key[many], rep[many].view(np.int64), hub[many]
        release()
        hole = (bucket if bucket >= 0 else -1 - bucket) % k
        return pa.table({"hole": pa.array(np.full(len(key), hole, np.int32)), "key": pa.array(key.view(np.int64)), "rep": pa.array(rep), "hub": pa.array(hub)})

    packed = reps.select("rep", "signature").mapInArrow(released(spread), "bucket long, keys binary, reps binary, hubs binary")
    return packed.groupBy("bucket").applyInArrow(meet, "hole int, key long, rep long, hub long")


def _symbols(column: pa.ChunkedArray, k: int = K) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), np.uint16).reshape(-1, k)


def _possible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _near(pairs: DataFrame, reps: DataFrame, distance: int, percent: int) -> DataFrame:
    """The pairs (rep, hub) at most ``distance`` apart, of sizes that allow the similarity."""
    a = reps.select("rep", F.col("signature").alias("s1"), F.col("n_shingles").alias("n1"))
    b = reps.select(F.col("rep").alias("hub"), F.col("signature").alias("s2"), F.col("n_shingles").alias("n2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            c = {n: t.column(i) for i, n in enumerate(t.schema.names)}
            near = ((_symbols(c["s1"]) != _symbols(c["s2"])).sum(1) <= distance) & _possible(c["n1"].to_numpy(), c["n2"].to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([c["rep"], c["hub"]], ["rep", "hub"]).filter(pa.array(near))

    return pairs.join(a, "rep").join(b, "hub").select("rep", "hub", "s1", "n1", "s2", "n2").mapInArrow(run, "rep long, hub long").distinct()


def _links(docs: DataFrame, pairs: DataFrame, reps: DataFrame, size: int, percent: int, kept) -> DataFrame:
    """The pairs (rep, hub; distinct) whose full sets reach the similarity, with n_shingles of both.

    Pairs are grouped by the smallest partner that their members have; a group gets each of its members' sets once, whatever
    the number of its pairs. A group of more than ``GROUP_SHINGLES`` is cut into tiles of its members that meet in twos.
    """
    both = pairs.select(F.col("rep").alias("u"), F.col("hub").alias("v")).union(pairs.select("hub", "rep"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("l"))
    p = pairs.join(least.select(F.col("u").alias("rep"), F.col("l").alias("l1")), "rep").join(least.select(F.col("u").alias("hub"), F.col("l").alias("l2")), "hub")
    p = kept(p.select("rep", "hub", F.least("l1", "l2").alias("label")))
    sizes = reps.groupBy("rep").agg(F.sum("n_shingles").alias("n"))
    nodes = p.select("label", F.col("rep").alias("node")).union(p.select("label", "hub")).distinct()
    weight = kept(nodes.join(sizes, nodes["node"] == sizes["rep"]).groupBy("label").agg(F.sum("n").alias("weight")))
    bins = max(1, -(-(weight.agg(F.sum("weight")).first()[0] or 0) // GROUP_SHINGLES))
    tiles = F.ceil(F.col("weight") / GROUP_SHINGLES).cast("int")
    at = lambda c: F.when(F.col("tiles") > 1, F.expr(f"cast(pmod(xxhash64({c}), tiles) as int)")).otherwise(0)
    small = F.struct(F.lit(0).cast("long").alias("a"), F.expr(f"pmod(xxhash64(label), {bins})").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"))
    large = F.struct(F.lit(1).cast("long").alias("a"), F.col("label").alias("b"), at("rep").alias("c"), at("hub").alias("d"))
    p = kept(p.join(weight, "label").withColumn("tiles", tiles).select("rep", "hub", F.when(F.col("tiles") > 1, large).otherwise(small).alias("g")))
    where = kept(p.select(F.col("rep").alias("node"), "g").union(p.select("hub", "g")).distinct())

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in chunks(batch, 2):
                sets, bounds = shingles(lowered(raw), off, size)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([sets[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())], ["g", "node", "shingles"])

    few = where.count() <= BROADCAST_ROWS
    picked = docs.join(F.broadcast(where) if few else where, docs["doc_id"] == where["node"]).select("g", "node", "text")
    kind = "g struct<a:long,b:long,c:int,d:int>, node long, shingles binary"
    sets = picked.mapInArrow(released(full), kind)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        node = right.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        node, packed = node[order], right.column("shingles").combine_chunks()
        rep, hub = left.column("rep").to_numpy(), left.column("hub").to_numpy()
        by_hub = np.lexsort((rep, hub))
        rep, hub = rep[by_hub], hub[by_hub]
        good = np.zeros(len(rep), bool)
        starts = np.flatnonzero(np.concatenate([[True], hub[1:] != hub[:-1]]))
        for a, b in zip(starts, np.append(starts[1:], len(hub))):
            # an id whose rows hold different texts has more than one set: any of them may link
            lo, hi = np.searchsorted(node, rep[a:b]), np.searchsorted(node, rep[a:b], "right")
            pair = np.repeat(np.arange(a, b), hi - lo)
            row = np.repeat(lo - np.append(0, np.cumsum(hi - lo))[:-1], hi - lo) + np.arange(len(pair))
            for h in range(*np.searchsorted(node, [hub[a], hub[a] + 1])):
                own = np.frombuffer(packed[int(order[h])].as_buffer(), np.uint64)
                i = 0
                while i < len(row):
                    others, held = [], 0
                    while i + len(others) < len(row) and held < GROUP_SHINGLES // 8:
                        others.append(np.frombuffer(packed[int(order[row[i + len(others)]])].as_buffer(), np.uint64))
                        held += len(others[-1])
                    counts = np.array([len(x) for x in others])
                    every = np.concatenate(others)
                    hit = np.append(0, np.cumsum(own[np.minimum(np.searchsorted(own, every), max(len(own) - 1, 0))] == every if len(own) else np.zeros(len(every), bool)))
                    ends = np.cumsum(counts)
                    both = hit[ends] - hit[ends - counts]
                    np.logical_or.at(good, pair[i : i + len(others)], (both > 0) & (100 * both >= percent * (len(own) + counts - both)))
                    i += len(others)
        release()
        return pa.table({"rep": pa.array(rep[good]), "hub": pa.array(hub[good])})

    return p.groupBy("g").cogroup(sets.groupBy("g")).applyInArrow(compare, "rep long, hub long")


def components(links: DataFrame, a: str = "rep", b: str = "hub", paths: list[str] | None = None) -> DataFrame:
    """node, component (smallest node reachable) of every node of the links, by alternating stars. ``paths`` gets the path that the result reads."""
    spark = links.sparkSession
    last: list[str] = []

    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        path = shared_dir(spark)
        df.write.parquet(path)
        last.append(path)
        df = spark.read.schema("u long, v long").parquet(path)
        return df, tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    edges, before = keep(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = keep(small.union(small_min.select("u", F.col("m").alias("v"))).distinct())
        remove(spark, last.pop(0))  # read by this round only
        if after == before:
            break
        before = after
    if paths is not None:
        paths += last
    labels = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return labels.union(labels.select(F.col("component").alias("node"), "component").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles long, component_id long, kept boolean (doc_id = component_id)."""
    return _labelled(docs, size, percent, id_col, text_col)[0]


def _labelled(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """:func:`near_duplicates`, and the paths that its result reads."""
    spark = docs.sparkSession
    ship(spark)
    d = fields(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    _, m = plan(percent / 100)
    paths: list[str] = []
    used: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(shared_dir(spark))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        p = kept(profiles(d, size))
        classes = p.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
        reps = kept(classes)
        runs = kept(runs_of(reps, reps.count(), m))
        first = kept(_near(runs.where("rep <> hub").select("rep", "hub").distinct(), reps, 2 * m - 1, percent))
        part = kept(components(kept(_links(d, first, reps, size, percent, kept)), paths=paths))
        # what the stars left apart: members of one run in different components
        of = runs.select("hole", "key", "rep").join(part, F.col("rep") == F.col("node"), "left").select("hole", "key", "rep", F.coalesce("component", "rep").alias("component"))
        mixed_runs = of.groupBy("hole", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("hole", "key", "n")
        apart = kept(of.join(mixed_runs, ["hole", "key"]))
        more = kept(_across(apart, reps, m, percent).distinct().join(first, ["rep", "hub"], "left_anti"))
        second = kept(_links(d, more, reps, size, percent, kept))
        final = components(part.select(F.col("node").alias("rep"), F.col("component").alias("hub")).union(second), paths=paths)
        # classes of one document without links keep their own id
        labels = reps.select("set_key", "n", "rep").join(final, F.col("rep") == F.col("node"), "left").where("n > 1 OR component IS NOT NULL")
        labels = kept(labels.select("set_key", "n", F.coalesce("component", "rep").alias("component")))
        used += [paths[0], paths[-1]]
    finally:
        for path in paths:
            if path not in used:
                remove(spark, path)
    r = looked_up(p.select("doc_id", "n_shingles", "set_key"), labels, "set_key", "n", "component", HOT, F.xxhash64("doc_id").cast("string").cast("binary"))
    r = r.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return r.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), used


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns unchanged, of which one of each group of linked documents stays: that of the smallest id.

    Rows count, not ids: repeated rows and rows with a null id belong to groups by their texts. Where there are any, rows are
    numbered and written out, and numbers stand for ids; of equal ids the row with the least digest of its columns stays, and
    a null id stays only in a group without others. Of rows without words, those of one id are one group, others are none.
    """
    spark = docs.sparkSession
    ids = fields(docs, doc_id=id_col).select(F.col("doc_id").cast("long").alias("doc_id"))
    unique = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    path = shared_dir(spark)
    if unique:
        near, used = _labelled(docs, size, percent, id_col, text_col)
        near.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).write.parquet(path)
        rows, row = docs, docs[id_col].cast("long")
    else:
        name = "row"
        while name in {c.lower() for c in docs.columns}:
            name += "_"
        numbered = shared_dir(spark)
        docs.withColumn(name, F.monotonically_increasing_id()).write.parquet(numbered)  # written, so that numbers stay
        rows = spark.read.parquet(numbered)
        row = rows[name]
        near, used = _labelled(rows, size, percent, name, text_col)
        near = near.select(F.col("doc_id").alias("near_row"), "n_shingles", "component_id")
        own = rows.select(row.alias("near_row"), rows[id_col].cast("long").alias("own_id"), F.md5(F.to_json(F.struct(*[rows[c] for c in docs.columns]))).alias("tie"))
        wordless = F.expr("n_shingles = 0 AND own_id IS NOT NULL")
        rank = F.struct(F.col("own_id").isNull().alias("no_id"), "own_id", "tie", "near_row")
        m = near.join(own, "near_row").select("near_row", F.when(wordless, F.col("own_id")).alias("own_group"), F.when(~wordless, F.col("component_id")).alias("component"), rank.alias("rank"))
        first = m.groupBy("own_group", "component").agg(F.min("rank").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        first = first.select(F.col("own_group").alias("g"), F.col("component").alias("c"), F.col("least.near_row").alias("stays"))
        gone = m.join(first, F.col("own_group").eqNullSafe(F.col("g")) & F.col("component").eqNullSafe(F.col("c"))).where("near_row <> stays")
        gone.select(F.col("near_row").alias("gone")).write.parquet(path)
    for old in used:
        remove(spark, old)
    gone = spark.read.schema("gone long").parquet(path)
    few = gone.count() <= BROADCAST_ROWS  # a checked bound; beyond it the same join shuffles
    return rows.join(F.broadcast(gone) if few else gone, row == gone["gone"], "left_anti").select(*[rows[c] for c in docs.columns])


def _across(members: DataFrame, reps: DataFrame, m: int, percent: int, k: int = K) -> DataFrame:
    """Pairs (rep, hub) of a run's members in different components that are under the distance and whose sizes allow the similarity.

    A pair is given by the first chunk in which it has one error or none, so by one run only. Runs of over ``TILE`` members are
    cut into tiles that meet in twos, so a task holds two tiles at most.
    """
    cuts = np.linspace(0, k, m + 1).astype(int)

    def pairs(table: pa.Table) -> pa.Table:
        hole, key, t1, t2, tile, rep, comp, size = (table.column(c).to_numpy() for c in ("hole", "key", "t1", "t2", "tile", "rep", "component", "n_shingles"))
        order = np.lexsort((rep, t2, t1, key, hole))
        same = [x[order][1:] == x[order][:-1] for x in (hole, key, t1, t2, rep)]
        order = order[np.concatenate([[True], ~np.logical_and.reduce(same)])]  # a member may stand in a run twice
        hole, key, t1, t2, tile, rep, comp, size = (x[order] for x in (hole, key, t1, t2, tile, rep, comp, size))
        sig = _symbols(table.column("signature"), k)[order]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def compare() -> None:
            i, j = (np.concatenate([x[n] for x in waiting]) for n in (0, 1))
            waiting.clear()
            ok = (comp[i] != comp[j]) & _possible(size[i], size[j], percent)
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                off = sig[x] != sig[y]
                near = off.sum(1) <= 2 * m - 1
                x, y, off = x[near], y[near], off[near]
                if not len(x):
                    continue
                errors = np.add.reduceat(off, cuts[:-1], axis=1, dtype=np.int64)
                chunk = np.argmax(errors <= 1, axis=1)
                wrong = off & (np.arange(k) >= cuts[chunk][:, None]) & (np.arange(k) < cuts[chunk + 1][:, None])
                met = np.where(wrong.any(1), wrong.argmax(1), cuts[chunk]) == hole[x]
                found.append((np.maximum(rep[x], rep[y])[met], np.minimum(rep[x], rep[y])[met]))

        starts = np.flatnonzero(np.concatenate([[True], (hole[1:] != hole[:-1]) | (key[1:] != key[:-1]) | (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])]))
        held = 0
        for a, b in zip(starts, np.append(starts[1:], len(rep))):
            if t1[a] != t2[a]:
                rows, others = a + np.flatnonzero(tile[a:b] == t1[a]), a + np.flatnonzero(tile[a:b] == t2[a])
                parts = ((np.full(len(others), r), others) for r in rows)
            elif b - a <= 64:
                x, y = np.triu_indices(b - a, 1)
                parts = [(a + x, a + y)]
            else:
                parts = ((np.full(b - r - 1, r), np.arange(r + 1, b)) for r in range(a, b - 1))
            for part in parts:
                waiting.append(part)
                held += len(part[0])
                if held > 1 << 18:
                    compare()
                    held = 0
        if waiting:
            compare()
        release()
        return pa.table({"rep": pa.array(np.concatenate([x for x, _ in found])), "hub": pa.array(np.concatenate([y for _, y in found]))})

    bins = max(1, -(-(members.agg(F.count(F.lit(1))).first()[0]) // BIN_MEMBERS))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    t = members.join(reps.select("rep", "signature", "n_shingles"), "rep").withColumn("tiles", tiles).withColumn("tile", F.expr("cast(pmod(xxhash64(rep), tiles) as int)"))
    t = t.withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumns({"t1": F.least("tile", "with"), "t2": F.greatest("tile", "with")})
    bin_ = F.when(F.col("tiles") > 1, F.xxhash64("hole", "key", "t1", "t2")).otherwise(F.expr(f"pmod(xxhash64(hole, key), {bins})"))
    t = t.select(bin_.alias("bin"), "hole", "key", "rep", "component", "n_shingles", "signature", "tile", "t1", "t2")
    return t.groupBy("bin").applyInArrow(pairs, "rep long, hub long")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
             ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, shingles FROM s),
classes AS (SELECT min(doc_id) AS rep, any_value(n_shingles) AS size, list_sort(shingles) AS k FROM n WHERE n_shingles > 0 GROUP BY list_sort(shingles)),
e AS (SELECT rep, size, unnest(k) AS shingle FROM classes),
pairs AS (SELECT a.rep AS x, b.rep AS y, count(*) AS met, any_value(a.size) AS na, any_value(b.size) AS nb
          FROM e a JOIN e b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * least(a.size, b.size) >= 85 * greatest(a.size, b.size) GROUP BY a.rep, b.rep),
links AS (SELECT x, y FROM pairs WHERE 100 * met >= 85 * (na + nb - met)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(node, c) AS (SELECT x, x FROM ways UNION SELECT ways.y, reach.c FROM reach JOIN ways ON reach.node = ways.x WHERE reach.c < ways.y),
label AS (SELECT node, min(c) AS c FROM reach GROUP BY node),
own AS (SELECT n.doc_id, n_shingles, CASE WHEN n_shingles > 0 THEN classes.rep END AS rep FROM n LEFT JOIN classes ON n_shingles > 0 AND list_sort(n.shingles) = classes.k)
SELECT doc_id, n_shingles, coalesce(label.c, own.rep, doc_id) AS component_id, coalesce(label.c, own.rep, doc_id) = doc_id AS kept
FROM own LEFT JOIN label ON own.rep = label.node
"""


def op9_neardup(spark, sf_dir: str) -> DataFrame:
    r = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
    return r.select("doc_id", "n_shingles", "component_id", "kept")
