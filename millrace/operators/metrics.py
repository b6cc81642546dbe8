"""Labelled metrics as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import glob_to_regex


def counter(df: DataFrame, key: str, labels: dict[str, Column], increment: Column | int = 1, where: Column | None = None) -> DataFrame:
    """name, labels (a sorted map) and value of one counter; aggregated in part before the shuffle."""
    d = df if where is None else df.where(where)
    inc = F.lit(increment) if isinstance(increment, int) else increment
    d = d.select(*[c.cast("string").alias(f"l{i}") for i, (_, c) in enumerate(sorted(labels.items()))], inc.cast("bigint").alias("inc"))
    names = [f"l{i}" for i in range(len(labels))]
    g = d.groupBy(*names).agg(F.sum("inc").alias("value"))
    m = F.create_map(*[x for n, (k, _) in zip(names, sorted(labels.items())) for x in (F.lit(k), F.col(n))]) if names else F.create_map().cast("map<string,string>")
    return g.select(F.lit(key).alias("name"), F.map_filter(m, lambda _, v: v.isNotNull()).alias("labels"), "value")


def dedup_labels(labels: Column) -> Column:
    """Entries (array of key and value structs) as a map, sorted, the last of a key winning."""
    keys = F.transform(labels, lambda e: e["key"])
    last = F.filter(labels, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.array_sort(last))


def label_text(labels: Column) -> Column:
    """``k=v,...`` in order: a key that can be grouped."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def maximum(df: DataFrame, labels: list[str], value: Column) -> DataFrame:
    return df.groupBy(*labels).agg(F.max(value).alias("value"))


def average(df: DataFrame, labels: list[str], value: Column) -> DataFrame:
    return df.groupBy(*labels).agg(F.avg(value).alias("value"))


def log2_bucket(value: Column, low: int, high: int) -> Column:
    """floor(log2), kept within the bounds; values below 1 go to the lowest. By the number's binary digits, so exactly."""
    n = F.floor(value).cast("bigint")
    return F.when(n < 1, low).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.length(F.bin(n)) - 1)))


def histogram(df: DataFrame, labels: list[str], value: Column, low: int = 0, high: int = 10) -> DataFrame:
    return df.groupBy(*labels, log2_bucket(value, low, high).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def change_per_second(df: DataFrame, labels: list[str], ts: str, now: Column) -> DataFrame:
    """Rows a second over the last hour, the last day and since the first row."""
    t = F.unix_timestamp(ts)
    n = F.unix_timestamp(now)
    since = F.greatest(F.max(n) - F.min(t), F.lit(1))
    hour, day = (F.sum(F.when(n - t < s, 1).otherwise(0)) for s in (3600, 86400))
    return df.where(t <= n).groupBy(*labels).agg((hour / 3600).alias("last_1h"), (day / 86400).alias("last_24h"), (F.count(F.lit(1)) / since).alias("since_start"))


def query(counters: DataFrame, pattern: str, total: bool = False) -> DataFrame:
    """Counters whose name (or ``name.labels``) fits a glob; their sum with ``total``."""
    full = F.concat_ws(".", F.col("name"), F.nullif(label_text(F.col("labels")), F.lit("")))
    hits = counters.withColumn("counter", full).where(full.rlike(glob_to_regex(pattern)))
    return hits.agg(F.coalesce(F.sum("value"), F.lit(0)).alias("value")) if total else hits.select("counter", "value")


def message_statistics(df: DataFrame) -> DataFrame:
    """Counts by host, program and severity in one pass over the rows."""
    e = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("key")) for d, c in (("host", F.col("host")), ("program", F.col("program")), ("severity", F.col("pri") % 8))])).alias("s"))
    return e.groupBy("s.dimension", "s.key").agg(F.count(F.lit(1)).alias("n"))


def counted(df: DataFrame, column: str) -> DataFrame:
    """Counters of what a program's update_metric() statements left in ``column``: name, labels, value."""
    m = df.select(F.explode(column).alias("m")).select("m.*").withColumn("entries", F.array_sort(F.map_entries("labels")))
    return m.groupBy("name", "entries").agg(F.sum("value").alias("value")).select("name", F.map_from_entries("entries").alias("labels"), "value")
