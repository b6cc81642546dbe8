"""Byte-level BPE by a hierarchical-bitmap rank queue.

Each pre-token is a linked list of byte symbols. Every adjacent pair that the vocabulary can merge waits in the bucket of
its rank; a two-level bitmap says which buckets hold anything, so find-first-set gives the next rank in constant time.
A bucket holds list positions; a popped position whose pair has changed since is stale and skipped. A pre-token of n bytes
takes O(n log n) for its buckets' order at most, however long it is.

Results, as those of the tiktoken library without special tokens: null and "" give no ids; every text is encoded whole;
lone pre-tokens found in the vocabulary are taken as they are. Repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from struct import pack

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millrace.llm.common import fields, released
from millrace.session import ship

#: Pre-tokens of one generation of what a worker remembers; when full, it becomes the old one, and words met again move on.
CACHE = 400_000
GROUP = 8  # ranks of one low bitmap word, as a power of two


class RankQueue:
    """Buckets of positions by rank under a two-level bitmap."""

    __slots__ = ("top", "low", "buckets")

    def __init__(self) -> None:
        self.top, self.low, self.buckets = 0, {}, {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        group = rank >> GROUP
        word = self.low.get(group, 0)
        if not word:
            self.top |= 1 << group
        self.low[group] = word | 1 << (rank & 255)

    def pop(self) -> tuple[int, int] | None:
        """The lowest rank's leftmost position, or None."""
        top = self.top
        if not top:
            return None
        group = (top & -top).bit_length() - 1
        word = self.low[group]
        rank = (group << GROUP) + (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            word &= word - 1
            self.low[group] = word
            if not word:
                self.top = top & (top - 1)
        return rank, at


class Codec:
    """A vocabulary of byte-string ranks with its splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(self.ranks.values(), default=0) >= 1 << 16:
            raise ValueError("ranks of 2**16 and more aren't packed here")
        self.split = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.pairs: dict[int, int] = {}  # left << 16 | right: ids are below 2**16
        ranks = self.ranks
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 16 | right] = rank
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs = self.pairs.get
        ids = [self.single[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list[int | None] = [pairs(a << 16 | b) for a, b in zip(ids, ids[1:])]
        waiting.append(None)
        queue = RankQueue()
        for i, rank in enumerate(waiting):
            if rank is not None:
                queue.push(rank, i)
        while (got := queue.pop()) is not None:
            rank, i = got
            if waiting[i] != rank:
                continue  # stale: the pair has changed or gone
            j = after[i]
            ids[i], ids[j], waiting[j] = rank, -1, None
            k = after[i] = after[j]
            waiting[i] = None
            if k < n:
                before[k] = i
                new = waiting[i] = pairs(rank << 16 | ids[k])
                if new is not None:
                    queue.push(new, i)
            if (p := before[i]) >= 0:
                new = waiting[p] = pairs(ids[p] << 16 | rank)
                if new is not None:
                    queue.push(new, p)
        return [x for x in ids if x >= 0]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.split.findall(text)
        if len(self.cache) > CACHE:
            self.cache, self.old = {}, self.cache
        cache, old = self.cache, self.old.get
        for piece in set(pieces).difference(cache):
            known = old(piece)
            if known is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                known = pack(f"<{len(ids)}I", *ids)
            cache[piece] = known
        return b"".join(map(cache.__getitem__, pieces))

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for; an id outside the vocabulary raises KeyError."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(_here(path), pattern)


def sent(spark, path: str) -> None:
    """Sends the vocabulary to the executors, which need not have it under the driver's path."""
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def _here(path: str) -> str:
    from pyspark import SparkFiles

    if SparkFiles._is_running_on_worker and os.path.exists(own := SparkFiles.get(os.path.basename(path))):
        return own
    return path


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit); with ``decoded``, also decoded binary, which the ids stand for, made in the same worker."""
    ship(docs.sparkSession)
    sent(docs.sparkSession, path)
    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                ids = [c.packed(t.as_py() or "") for t in part.column(1)]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([c.decode(x) for x in ids], pa.binary())] if decoded else []), names)

    d = fields(docs, doc_id=id_col, text=text_col)
    return d.mapInArrow(released(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary{', decoded binary' * decoded}")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds decoded binary to rows of :func:`encode`; null ids decode to nothing."""
    ship(encoded.sparkSession)
    sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = [c.decode(x.as_py() or b"") for x in part.column(part.schema.get_field_index("ids"))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded"]
    return encoded.select(*[f"`{f.name}`" for f in encoded.schema if f.name != "decoded"]).mapInArrow(released(run), ", ".join([*kept, "decoded binary"]))
