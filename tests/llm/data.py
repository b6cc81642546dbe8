"""Small tables with the odd cases: null, empty, very long, repeated, tied; and columns whose names clash."""

from __future__ import annotations

import random

WORDS = [f"w{i}" for i in range(400)]


def text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars, block, rep, key): the last three clash with operators' own names."""
    base, passage = text(1, 200), text(99, 60)
    near = base.split()
    near[100] = "changed"
    texts = [None, "", "   \n\t", "one", "one two", base, base, " ".join(near), base.upper(), text(2, 5000), "x" * 20000, text(3, 100) + " " + passage, passage + "\n" + text(4, 100), text(5, 40), text(5, 40) + " tail", "naïve café ☃ 日本語 MIT", "a b " * 60, None, "1234 5678 !!", text(6, 300), "1234 5678 !!"]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("s0", "s1", None, "s0")[i % 4], len(t or ""), i, "r", "k") for i, t in enumerate(texts)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, rep string, key string"


def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
