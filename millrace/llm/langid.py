"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes; each position's two hidden states give probabilities of the languages, so every position is
labelled, and a document's probabilities are the means over its positions. A document is read whole, in consecutive windows
of ``WINDOW`` bytes with a fresh state each, which makes long and short texts alike and lets numpy run thousands of
windows in step. Weights are trained on the driver in numpy by backpropagation through time over a bounded sample of
labelled rows: at most ``PER_LABEL`` rows of a label (those of least hash of the id) and ``WINDOWS`` windows of each, spread
evenly over the text and cut out before anything is collected.

Edge cases: a text that is null, empty or without a letter gives ``und`` with score 0; ties go to the label that sorts
first; repeated rows get equal answers; without one labelled row every document is ``und``; ids pass through unchanged, null
too; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import chunks, fields, released
from millrace.session import ship

HIDDEN = 8
WINDOW = 128
#: The sample that the network is fitted on.
PER_LABEL, WINDOWS, EPOCHS, BATCH, TRAIN_WINDOW = 200, 6, 6, 128, 64
UND = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class Network:
    """Two GRUs (forward, backward) and a linear layer over both states. Arrays lead with the direction."""

    labels: list[str]
    table: np.ndarray  # 2, 257, 3H: byte (256: padding) to gate inputs
    inner: np.ndarray  # 2, H, 3H
    bias: np.ndarray  # 2, 1, H: of the candidate's inner part
    out: np.ndarray  # 2H, L
    out_bias: np.ndarray  # L

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(labels, f(2, 257, 3 * hidden, scale=0.3), f(2, hidden, 3 * hidden, scale=hidden**-0.5), np.zeros((2, 1, hidden), np.float32), f(2 * hidden, len(labels), scale=0.3), np.zeros(len(labels), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.inner, self.bias, self.out, self.out_bias]

    def states(self, bytes_: np.ndarray) -> np.ndarray:
        """2, T, H, B states of windows given as T, B bytes; the backward ones in the order of the text."""
        t, b = bytes_.shape
        h = self.inner.shape[1]
        # windows run along the last axis, so that each gate is one contiguous piece
        fwd, bwd = np.ascontiguousarray(self.table.transpose(0, 2, 1))
        inner, bias = np.ascontiguousarray(self.inner.transpose(0, 2, 1)), self.bias.transpose(0, 2, 1)
        state = np.zeros((2, h, b), np.float32)
        all_ = np.empty((2, t, h, b), np.float32)
        x, u = np.empty((2, 3 * h, b), np.float32), np.empty((2, 3 * h, b), np.float32)
        for i in range(t):
            np.take(fwd, bytes_[i], axis=1, out=x[0], mode="clip")
            np.take(bwd, bytes_[t - 1 - i], axis=1, out=x[1], mode="clip")
            np.matmul(inner, state, out=u)
            gates, c = u[:, : 2 * h], u[:, 2 * h :]
            gates += x[:, : 2 * h]
            _sigmoid(gates)
            c += bias
            c *= gates[:, h:]
            c += x[:, 2 * h :]
            np.tanh(c, out=c)
            state -= c
            state *= gates[:, :h]
            state += c
            all_[0, i], all_[1, t - 1 - i] = state
        return all_

    def positions(self, bytes_: np.ndarray) -> np.ndarray:
        """T, L, B probabilities: the label of every position is the largest."""
        s = self.states(bytes_)
        h = self.inner.shape[1]
        z = np.matmul(self.out[:h].T, s[0])
        z += np.matmul(self.out[h:].T, s[1])
        z += self.out_bias[:, None]
        z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        return z

    def step(self, bytes_: np.ndarray, gold: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss over all positions of T, B windows and its gradients, by backpropagation through time."""
        t, b = bytes_.shape
        h = self.inner.shape[1]
        order = [bytes_, bytes_[::-1]]
        state = np.zeros((2, b, h), np.float32)
        kept = []
        states = np.empty((2, t, b, h), np.float32)
        for i in range(t):
            x = np.stack([self.table[d][order[d][i]] for d in (0, 1)])
            u = state @ self.inner
            gates = _sigmoid(x[:, :, : 2 * h] + u[:, :, : 2 * h])
            inner = u[:, :, 2 * h :] + self.bias
            z, r = gates[:, :, :h], gates[:, :, h:]
            n = np.tanh(x[:, :, 2 * h :] + r * inner)
            kept.append((state, z, r, inner, n))
            state = n + z * (state - n)
            states[0, i], states[1, t - 1 - i] = state
        both = np.concatenate([states[0], states[1]], -1)
        logits = both @ self.out + self.out_bias
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        weight = mask / max(1.0, mask.sum())
        loss = -float((np.log(np.take_along_axis(p, np.broadcast_to(gold[None, :, None], (t, b, 1)), -1)[..., 0] + 1e-9) * weight).sum())
        d = p
        d[:, np.arange(b), gold] -= 1
        d *= weight[..., None]
        g_out, g_bias = both.reshape(-1, 2 * h).T @ d.reshape(-1, d.shape[-1]), d.sum((0, 1))
        d_states = d @ self.out.T
        g_table, g_inner, g_in_bias = np.zeros_like(self.table), np.zeros_like(self.inner), np.zeros_like(self.bias)
        carry = np.zeros((2, b, h), np.float32)
        steps = np.empty((2, t, b, 3 * h), np.float32)
        for i in range(t - 1, -1, -1):
            carry = carry + np.stack([d_states[i, :, :h], d_states[t - 1 - i, :, h:]])
            prev, z, r, inner, n = kept[i]
            dz = carry * (prev - n) * z * (1 - z)
            dn = carry * (1 - z) * (1 - n * n)
            dr = dn * inner * r * (1 - r)
            d_inner = dn * r
            du = np.concatenate([dz, dr, d_inner], -1)
            steps[:, i] = np.concatenate([dz, dr, dn], -1)
            g_inner += prev.transpose(0, 2, 1) @ du
            g_in_bias += d_inner.sum(1, keepdims=True)
            carry = carry * z + du @ self.inner.transpose(0, 2, 1)
        for k in (0, 1):
            flat = np.ascontiguousarray(order[k]).ravel()
            one_hot = np.argsort(flat, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], np.diff(flat[one_hot]) > 0]))
            g_table[k][flat[one_hot][at]] = np.add.reduceat(steps[k].reshape(-1, 3 * h)[one_hot], at, axis=0)
        return loss, [g_table, g_inner, g_in_bias, g_out, g_bias]

    def pooled(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """n, L mean probabilities of rows of UTF-8; zeros for empty rows."""
        sizes = np.diff(off)
        per = -(-sizes // WINDOW)
        row = np.repeat(np.arange(len(sizes)), per)
        first = np.append(0, np.cumsum(per))
        start = off[:-1][row] + (np.arange(len(row)) - first[:-1][row]) * WINDOW
        sums = np.zeros((len(row), len(self.labels)), np.float64)
        for a in range(0, len(row), 2048):
            s, end = start[a : a + 2048], off[1:][row[a : a + 2048]]
            at = s[None, :] + np.arange(min(WINDOW, int((end - s).max())))[:, None]
            real = at < end[None, :]
            bytes_ = np.where(real, raw[np.minimum(at, len(raw) - 1)].astype(np.int16), 256)
            p = self.positions(bytes_)
            p *= real[:, None, :]
            sums[a : a + 2048] = p.sum(0).T
        out = np.zeros((len(sizes), len(self.labels)))
        full = np.flatnonzero(per)
        if len(full):
            out[full] = np.add.reduceat(sums, first[:-1][full], axis=0) / sizes[full, None]
        return out


def train(rows: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """A network fitted to (window, label) rows; a window has ``TRAIN_WINDOW`` bytes at most."""
    labels = sorted({label for _, label in rows})
    net = Network.fresh(labels)
    windows, gold = [], []
    for window, label in rows:
        piece = np.full(TRAIN_WINDOW, 256, np.int16)
        piece[: len(window)] = np.frombuffer(window, np.uint8)
        windows.append(piece)
        gold.append(labels.index(label))
    if not windows:
        return net
    x, y = np.stack(windows), np.array(gold)
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    n = 0
    steps = epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            pick = order[a : a + BATCH]
            bytes_ = np.ascontiguousarray(x[pick].T)
            _, grads = net.step(bytes_, y[pick], (bytes_ < 256).astype(np.float32))
            n += 1
            rate = 0.02 * (1 - 0.9 * n / steps)
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            for p, g, m, v in zip(net.parameters(), grads, first, second):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    return net


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL) -> Network:
    """Trains on rows of ``docs`` for which ``learn`` (over the columns doc_id, text, lang) holds and text and lang aren't null."""
    d = fields(docs, doc_id=id_col, text=text_col, lang=lang_col).where(learn).where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    raw = F.col("text").cast("binary")
    room = F.greatest(F.octet_length("text") - TRAIN_WINDOW, F.lit(0))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(WINDOWS - 1)), lambda i: F.floor(i * room / (WINDOWS - 1)).cast("int")))
    d = d.select("doc_id", "lang", F.transform(starts, lambda at: F.substring(raw, at + 1, F.lit(TRAIN_WINDOW))).alias("windows"))
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "windows")
    # row_number() <= n becomes a group limit before the shuffle: each task sends n rows of a label at most, of their texts the windows
    rows = d.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_label).select("lang", "n", "windows").collect()  # bounded: per_label times labels
    return train([(bytes(window), r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.n)) for window in r.windows])


def named_rows(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each row of UTF-8 has a letter."""
    letters = np.append(0, np.cumsum(_LETTER[raw]))
    named = letters[off[1:]] > letters[off[:-1]]
    for i in np.flatnonzero(~named):
        named[i] = any(map(str.isalpha, raw[off[i] : off[i + 1]].tobytes().decode()))
    return named


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred string, score double (the pooled probability of the label)."""
    ship(docs.sparkSession)
    kept = pickle.dumps(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = pickle.loads(kept)
        for batch in batches:
            for part, raw, off in chunks(batch, "text", 1 << 20):
                named = named_rows(raw, off)
                p = n.pooled(raw, off) if n.labels else np.zeros((len(named), 1))
                best = p.argmax(1)
                score = np.clip(p[np.arange(len(best)), best], 0, 1)
                ok = named & bool(n.labels)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n.labels[k] if o else UND for k, o in zip(best, ok)], pa.string()), pa.array(np.where(ok, score, 0.0))], ["doc_id", "lang_pred", "score"])

    d = fields(docs, doc_id=id_col, text=text_col)
    return d.mapInArrow(released(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language, that is a letter; where ``lang_col`` is null it takes the language found.

    The rest of each row is unchanged. A network without labels (nothing to learn from) still keeps every text with a letter.
    """
    ship(docs.sparkSession)
    kept, at, lang = pickle.dumps(net), docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = pickle.loads(kept)
        for batch in batches:
            for part, raw, off in chunks(batch, at, 1 << 20):
                named = named_rows(raw, off)
                if n.labels and named.any():
                    best = n.pooled(raw, off).argmax(1)
                    found = pa.array([n.labels[k] for k in best], pa.string()).cast(part.column(lang).type)
                    part = part.set_column(lang, part.schema.field(lang), pc.if_else(pc.is_null(part.column(lang)), found, part.column(lang)))
                yield part.filter(pa.array(named))

    return docs.mapInArrow(released(run), docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
