"""Branching: log paths over one table. Every row is tested once; branches are filters of a flag and a union."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.filters import true

Step = Callable[[DataFrame], DataFrame]


def union(*parts: DataFrame) -> DataFrame:
    """UNION ALL by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def same(df: DataFrame) -> DataFrame:
    return df


def conditional(df: DataFrame, branches: list[tuple[Column, Step]], otherwise: Step = same) -> DataFrame:
    """if / elif / else: a row takes the first branch whose test holds; what the branch then drops is not an else."""
    taken = F.coalesce(*[F.when(true(c), F.lit(i)) for i, (c, _) in enumerate(branches)], F.lit(-1))
    d = df.withColumn("__branch", taken)
    parts = [step(d.where(F.col("__branch") == i).drop("__branch")) for i, (_, step) in enumerate(branches)]
    return union(*parts, otherwise(d.where(F.col("__branch") == -1).drop("__branch")))


def unconditional(df: DataFrame, block: Callable[[DataFrame], tuple[DataFrame, Column]], otherwise: Step = same) -> DataFrame:
    """``if { ... }`` without a test: ``block`` gives the changed table and the flag of rows that it keeps; the others take else, as they came."""
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    d, kept = block(df.withColumn("__before", whole))
    d = d.withColumn("__kept", true(kept))
    back = d.where("NOT __kept").select("__before.*")
    return union(d.where("__kept").drop("__kept", "__before"), otherwise(back))


def junction(df: DataFrame, *channels: Step) -> DataFrame:
    """Every channel gets its own copy of every row; what they keep is put together."""
    return union(*[c(df) for c in channels])


def route(df: DataFrame, paths: list[tuple[str, Column, tuple[str, ...]]]) -> DataFrame:
    """Deliveries of log paths: the rows with ``destinations`` array. A path is (name, filter, flags): ``final`` stops rows that matched, ``fallback`` takes rows that no other path did, ``catchall`` takes all."""
    stopped, delivered = F.lit(False), F.lit(False)
    out = []
    for name, test, flags in paths:
        if "fallback" in flags:
            continue
        hit = F.lit(True) if "catchall" in flags else true(test) & ~stopped
        out.append((name, hit))
        delivered = delivered | hit
        if "final" in flags:
            stopped = stopped | hit
    for name, test, flags in paths:
        if "fallback" in flags:
            hit = true(test) & ~delivered
            out.append((name, hit))
            delivered = delivered | hit if "final" in flags else delivered
    order = {n: i for i, (n, _, _) in enumerate(paths)}
    out.sort(key=lambda p: order[p[0]])
    return df.withColumn("destinations", F.filter(F.array(*[F.when(h, F.lit(n)) for n, h in out]), lambda x: x.isNotNull()))


def delivered(df: DataFrame, paths: list[tuple[str, Column, tuple[str, ...]]]) -> DataFrame:
    """One row per delivery, with its ``destination``."""
    return route(df, paths).withColumn("destination", F.explode("destinations")).drop("destinations")
