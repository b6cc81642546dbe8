"""Enrichment: lookups that give a row more fields and never more rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.strings import glob_to_regex, ipv4_to_int
from millrace.functions.typed import TYPED, merged
from millrace.session import ship

#: Values of a task whose lookup is remembered.
LOOKUPS = 65_536
#: Selectors that are broadcast; a longer table is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if a count, which stops past the bound, allows it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def add_contextual_data(df: DataFrame, selector: Column, database: DataFrame, default_selector: str | None = None, prefix: str = "", ignore_case: bool = False, into: str = "nv") -> DataFrame:
    """Left lookup in records (selector, name, value): every record of the key becomes a field, the last of a name winning; the default's are taken where the key has none."""
    key = F.lower(F.col("selector")) if ignore_case else F.col("selector")
    ranked = database.select(key.alias("__key"), F.concat(F.lit(prefix), F.col("name")).alias("name"), F.col("value"), *( ["ord"] if "ord" in database.columns else [F.monotonically_increasing_id().alias("ord")]))
    last = ranked.groupBy("__key", "name").agg(F.max_by("value", "ord").alias("value"))
    side = small(last.groupBy("__key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("__pairs")))
    d = df.withColumn("__key", F.lower(selector) if ignore_case else selector).join(side, "__key", "left")
    pairs = F.col("__pairs")
    if default_selector is not None:
        wanted = default_selector.lower() if ignore_case else default_selector
        one = side.where(F.col("__key") == wanted).select(F.col("__pairs").alias("__default"), F.lit(True).alias("__one"))
        d = d.withColumn("__one", F.lit(True)).join(F.broadcast(one), "__one", "left")
        pairs = F.coalesce(pairs, F.col("__default"))
    none = F.create_map().cast("map<string,string>")
    base = F.col(into) if into in df.columns else none
    return d.withColumn(into, merged(base, F.coalesce(pairs, none))).drop("__key", "__pairs", "__default", "__one")


def glob_selector(value: Column, globs: list[str]) -> Column:
    """The first glob, in file order, that fits; null if none does. Globs are configuration, so they are compiled into the plan."""
    return F.coalesce(*[F.when(value.rlike(glob_to_regex(g)), F.lit(g)) for g in globs], F.lit(None).cast("string"))


def filter_selector(filters: list[tuple[Column, str]]) -> Column:
    """The key of the first filter that holds."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for c, k in filters], F.lit(None).cast("string"))


def disjoint(ranges: DataFrame, columns: list[str]) -> DataFrame:
    """Ranges that may overlap or nest, as ranges that don't: each keeps what the innermost (shortest, then first) of those over it holds.

    Borders cut the line into pieces; a piece takes the shortest range that covers it. Ranges meet pieces by the same bins of
    the address that :func:`ip_range_join` uses, so no range meets every piece.
    """
    borders = ranges.select(F.explode(F.array(F.col("start"), F.col("end") + 1)).alias("start")).distinct()
    bin_ = F.shiftright("start", 16)
    pieces = borders.withColumn("bin", bin_).union(ranges.select(F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("end", 16))).alias("bin")).distinct().select(F.shiftleft("bin", 16).cast("bigint").alias("start"), "bin")).distinct()
    pieces = pieces.withColumn("end", F.lead("start").over(W.partitionBy("bin").orderBy("start")) - 1).withColumn("end", F.coalesce("end", F.shiftleft(F.col("bin") + 1, 16).cast("bigint") - 1))
    r = ranges.select(F.struct(*columns).alias("found"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(F.shiftright("start", 16), F.shiftright("end", 16))).alias("bin"))
    j = pieces.join(r, "bin").where((F.col("s") <= F.col("start")) & (F.col("end") <= F.col("e")))
    best = j.groupBy("bin", "start", "end").agg(F.min_by("found", F.struct((F.col("e") - F.col("s")).alias("n"), "s")).alias("found"))
    return best.select("bin", "start", "end", "found")


def ip_range_join(df: DataFrame, ip: Column, ranges: DataFrame, columns: list[str]) -> DataFrame:
    """IPv4 range lookup, innermost range first: ``ranges`` has start and end as whole numbers and the columns to add (null without a range).

    The ranges are made disjoint first, so a row meets one piece at most and the rows are not regrouped: pieces of a checked
    number are broadcast, more are joined on the upper 16 bits of the address.
    """
    pieces = small(disjoint(ranges, columns).select(F.col("bin").alias("__bin"), F.col("start").alias("__start"), F.col("end").alias("__end"), F.col("found").alias("__found")))
    d = df.withColumn("__ip", ipv4_to_int(ip)).withColumn("__own", F.shiftright("__ip", 16))
    j = d.join(pieces, (F.col("__own") == F.col("__bin")) & F.col("__ip").between(F.col("__start"), F.col("__end")), "left")
    return j.select(*[d[f"`{c}`"] for c in df.columns], *[F.col("__found")[c].alias(c) for c in columns])


def cached_json(spark, path: str) -> Column:
    """A JSON object in a file as a map literal of its members; the driver reads it when the plan is built."""
    import json

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    items = [x for k, v in sorted(data.items()) for x in (F.lit(k), F.lit(v if isinstance(v, str) else TYPED + json.dumps(v, separators=(",", ":"))))]
    return F.create_map(*items) if items else F.create_map().cast("map<string,string>")


def read_contexts(spark, path: str) -> DataFrame:
    """Records of a CSV file of selector, name, value, in file order."""
    d = spark.read.csv(path, schema="selector string, name string, value string")
    return d.withColumn("ord", F.monotonically_increasing_id())


def remembered(one: Callable[[str], str | None], batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """``one`` of every value, null for null, asked once for each of a batch and not again while it is remembered."""
    from functools import lru_cache

    one = lru_cache(LOOKUPS)(one)
    for x in batches:
        at, values = pd.factorize(x)
        found = [*map(one, values), None]  # a null's place is -1
        yield pd.Series([found[i] for i in at], dtype="object")


def lookup(kind: str, value: Column) -> Column:
    """Operating system and DNS lookups in Arrow batches: passwd, group, services, protocols (by name or number), dns. What isn't found gives null.

    A task asks once for each value of a batch and remembers the last :data:`LOOKUPS` of them.
    """
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import grp
        import pwd
        import socket

        def one(v: str | None) -> str | None:
            try:
                if kind == "passwd":
                    return pwd.getpwuid(int(v)).pw_name if v.isdigit() else str(pwd.getpwnam(v).pw_uid)
                if kind == "group":
                    return grp.getgrgid(int(v)).gr_name if v.isdigit() else str(grp.getgrnam(v).gr_gid)
                if kind == "services":
                    return socket.getservbyport(int(v)) if v.isdigit() else str(socket.getservbyname(v))
                if kind == "protocols":
                    return str(socket.getprotobyname(v))
                return socket.gethostbyaddr(v)[0]
            except (KeyError, OSError, AttributeError, ValueError):
                return None

        yield from remembered(one, batches)

    return run(value)
