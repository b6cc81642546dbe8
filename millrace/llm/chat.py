"""Chat formatting at token level.

A conversation becomes ids: for each turn ``TURN``, the role's tokens, ``SAYS``, the text's tokens, ``END``. Segments are
encoded separately and the reserved ids are spliced between them, so no merge crosses a border and no content can make a
reserved id. The loss mask is the prefix sum of +1 and -1 marks at the borders of assistant texts. For readers of the
rendered string, where reserved ids show as control strings, content is escaped: a backslash before every backslash and
before every control string; taking the first backslash of each pair off undoes it.

Plan: rows are partitioned by conversation, sorted by turn within the partition, and streamed, so a conversation of any
length needs the memory of one turn; digests are kept running.

Edge cases: null text and null role count as empty; null turns come first; rows of equal turn are taken in the order of
role and text; repeated rows are turns of their own; rows with a null conv_id are one conversation; a text of any length is
one segment; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import Codec, codec, sent
from millrace.llm.bpe_query import vocabulary
from millrace.llm.common import fields
from millrace.session import ship

CONTROL = ("<turn>", "<says>", "</turn>")
#: Headings that other templates use; escaped too, so that rendered text can be moved between them.
FOREIGN = ("### System:", "### User:", "### Assistant:")
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROL, *FOREIGN))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
TRAINED_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


class Template:
    """The reserved ids follow the vocabulary's own."""

    def __init__(self, c: Codec) -> None:
        self.codec = c
        self.turn, self.says, self.end = (len(c.ranks) + i for i in range(3))
        self.shown = dict(zip((self.turn, self.says, self.end), CONTROL))

    def assemble(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and loss mask of one turn."""
        segments = [np.array([self.turn], np.uint32), self._ids(role), np.array([self.says], np.uint32), self._ids(text), np.array([self.end], np.uint32)]
        starts = list(accumulate(map(len, segments), initial=0))
        marks = np.zeros(starts[-1] + 1, np.int8)
        if role == TRAINED_ROLE:
            marks[starts[3]] += 1
            marks[starts[4]] -= 1
        return np.concatenate(segments), np.cumsum(marks)[:-1].astype(bool)

    def _ids(self, content: str) -> np.ndarray:
        return np.frombuffer(self.codec.packed(escape(content)), np.dtype("<u4"))

    def segments(self, ids: np.ndarray) -> list[tuple[int, int, int | None, str]]:
        """The pieces between reserved ids, each decoded once: first and end of its ids, the reserved id before it, its (escaped) text."""
        cut = np.flatnonzero(ids >= self.turn).tolist()
        bounds = zip([0, *(c + 1 for c in cut)], [*cut, len(ids)], [None, *(int(ids[c]) for c in cut)])
        return [(a, b, mark, self._text(ids[a:b])) for a, b, mark in bounds]

    def rendered(self, segments: list[tuple[int, int, int | None, str]]) -> str:
        return "".join(x for _, _, mark, text in segments for x in ("" if mark is None else self.shown[mark], text))

    def render(self, ids: np.ndarray) -> str:
        """The ids as a string, reserved ones as their control strings."""
        return self.rendered(self.segments(ids))

    def trained(self, ids: np.ndarray, mask: np.ndarray, segments: list[tuple[int, int, int | None, str]]) -> str:
        """All text under the mask, unescaped."""
        edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
        known = {(a, b): text for a, b, _, text in segments}
        return "".join(unescape(known[a, b] if (a, b) in known else self._text(ids[a:b])) for a, b in zip(edges[::2], edges[1::2]))

    def _text(self, ids: np.ndarray) -> str:
        return self.codec.decode(np.ascontiguousarray(ids, np.dtype("<u4")).tobytes()).decode()

    def read(self, segments: list[tuple[int, int, int | None, str]]) -> Iterator[tuple[str, str]]:
        """The (role, text) turns that decoded ids hold."""
        role = ""
        for _, _, mark, text in segments:
            if mark == self.turn:
                role = unescape(text)
            elif mark == self.says:
                yield role, unescape(text)


def turns(rows: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every row formatted: conv_id, turn, ids array<int>, loss_mask array<boolean>, rendered string."""
    ship(rows.sparkSession)
    sent(rows.sparkSession, path)
    d = fields(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(codec(path, pattern))
        for b in batches:
            got = [t.assemble(r.as_py() or "", x.as_py() or "") for r, x in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([m for _, m in got], pa.list_(pa.bool_())), pa.array([t.render(i) for i, _ in got])], ["conv_id", "turn", "ids", "loss_mask", "rendered"])

    kinds = {f.name: f.dataType.simpleString() for f in d.schema}
    return d.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, loss_mask array<boolean>, rendered string")


def summaries(rows: DataFrame, path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation, read back from its formatted ids: counts and digests of turns and of the text under the loss mask."""
    ship(rows.sparkSession)
    sent(rows.sparkSession, path)
    d = fields(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    conv_type = d.schema["conv_id"].dataType.simpleString()
    d = d.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Template(codec(path, pattern))
        done: list[tuple] = []
        kind = None
        now: list | None = None  # conv_id, turns, digest, loss chars, loss digest, chars, tokens, loss tokens

        def close() -> None:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:]))

        def flush() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in done], kind)] + [pa.array([r[i] for r in done], pa.string() if "sha" in n else pa.int64()) for i, n in enumerate(names) if i]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            kind = b.column(0).type
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                if now is None or now[0] != conv:
                    if now is not None:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                ids, mask = t.assemble(role.as_py(), text.as_py())
                segments = t.segments(ids)
                for r, x in t.read(segments):
                    now[1] += 1
                    now[2].update(f"{r}\n{x}\n".encode())
                trained = t.trained(ids, mask, segments)
                now[3] += len(trained)
                now[4].update(trained.encode())
                now[5] += len(t.rendered(segments))
                now[6] += len(ids)
                now[7] += int(mask.sum())
                if len(done) >= 1000:
                    yield flush()
        if now is not None:
            close()
        if done:
            yield flush()

    return d.mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def op2_chat(spark, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return summaries(rows.unionByName(more), *vocabulary()).drop("n_tokens", "loss_tokens")


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '\\|<turn>|<says>|</turn>|### System:|### User:|### Assistant:' AS control FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(19 + length(role) + length(text) + len(regexp_extract_all(role, control)) + len(regexp_extract_all(text, control))) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
