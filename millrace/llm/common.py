"""Whole-batch views of text columns: UTF-8 buffers, word boundaries and 64-bit word hashes in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20_240_501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def chunks(batch: pa.RecordBatch | pa.Table, name: str | int = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch | pa.Table, np.ndarray, np.ndarray]]:
    """Slices of a batch of at most ``most`` text bytes, each with its :func:`utf8`."""
    raw, off = utf8(batch.column(name))
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else unchanged."""
    return _LOWER[raw]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and n + 1 offsets of each row's words."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    space = _SPACE[raw]
    before, after = np.empty_like(space), np.empty_like(space)
    before[1:], after[:-1] = space[:-1], space[1:]
    before[off[:-1][off[:-1] < len(raw)]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) mod 2 ** 64, kept from call to call up to the size of a chunk."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 2 * CHUNK_BYTES:
            _POWERS[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans by one prefix sum of a polynomial."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers(len(raw)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(len(raw), _BASE_INV)[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def release() -> None:
    """Gives free memory back to the system: idle workers of one stage stand beside those of the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def released(run: Callable) -> Callable:
    """A function over batches that ends with :func:`release`, however it ends."""

    @wraps(run)
    def wrapper(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapper


def fields(df, **names: str):
    """Only the columns asked for, under the operator's own names: others can't clash with what it adds."""
    from pyspark.sql import functions as F

    return df.select(*[F.col(f"`{c}`").alias(own) for own, c in names.items()])


def looked_up(rows, labels, key: str, count: str, label: str, hot: int, spread):
    """``rows`` with the label of their key (null without one), rows of hot keys not gathered.

    ``labels`` has unique keys and the number of rows that hold each. Keys of more than ``hot`` rows go by broadcast: of n rows
    there are n / ``hot`` such keys at most. Their rows, and those without a key, take ``spread``, which is never a key, into
    the join of the others.
    """
    from pyspark.sql import functions as F

    top = labels.where(F.col(count) > hot).select(key, F.col(label).alias("__hot"))
    r = rows.join(F.broadcast(top), key, "left")
    r = r.withColumn("__key", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(spread))
    rest = labels.where(F.col(count) <= hot).select(F.col(key).alias("__key"), F.col(label).alias("__rest"))
    return r.join(rest, "__key", "left").withColumn(label, F.coalesce("__hot", "__rest")).drop("__hot", "__rest", "__key")
