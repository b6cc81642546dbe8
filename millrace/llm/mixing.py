"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Targets: the sources, by code point with null last, weigh as ``weights`` says, repeating, and share the words of the whole
corpus; a target stops at ``most`` times its source's size and the excess is shared again by weight. That fixed point is
found at once, without rounds: with the sources ordered by most * size / weight, the full ones are a prefix.

Sampling: within a source, documents stand in a fixed order (size class, 16 to a doubling, then md5 of the id); each expects
target / source size copies; the prefix sums of these expectations, moved by one offset drawn from the seed and the source,
cross as many integers at a document as it is emitted. No copy count is above ceil(most).

The prefix sum is two-level: counts for cells of (source, size class, md5 prefix), offsets over the small table of cells,
then ranks within a cell. A hot source is therefore cut into many cells, whose number grows with the rows.

Edge cases: null text has size 0; a source of size 0 takes nothing (target 0); a null source is a source of its own; a
null id is ordered as ""; an empty table gives no rows; repeated rows are rows of their own; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import fields
from millrace.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a cell, about, if the whole table were one source and size class.
CELL_ROWS = 200_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Adds target double to one row per source (source, source_size long)."""
    # one row per source: a table that doesn't grow with the documents
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.cast("long").alias("weight")).withColumn("cap", F.lit(most) * F.col("source_size"))
    s = s.withColumns({"total": F.sum("source_size").over(everything), "weights": F.sum("weight").over(everything), "fill": F.col("cap") / F.col("weight")})
    before = W.partitionBy(F.lit(0)).orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
    # the level rises while sources before it are full and falls after: its largest value is the fixed point
    s = s.withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies long, and ``keep`` columns of the input as they are."""
    own = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    d = fields(docs, doc_id=id_col, text=text_col, source=source_col, **{f"keep_{i}": c for i, c in enumerate(keep)})
    d = d.select("doc_id", "source", own.alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("order_key"), *[f"keep_{i}" for i in range(len(keep))])
    digits = max(1, math.ceil(math.log(max(1, docs.count() / CELL_ROWS), 16)))
    d = d.withColumns({"size_class": F.expr("length(bin(size)) * 32L + shiftright(size, greatest(length(bin(size)) - 5, 0))"), "part": F.substring("order_key", 1, digits), "is_null": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))})
    cell = ["is_null", "source_key", "size_class", "part"]
    cells = written(d.groupBy(*cell).agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    source = W.partitionBy("is_null", "source_key")
    cells = cells.select(*cell, F.coalesce(F.sum("n").over(source.orderBy("size_class", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    t = targets(sizes, weights, most).withColumns({"is_null": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))}).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce("source", F.lit("\0null")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    r = d.join(cells.join(t, ["is_null", "source_key"]), cell)
    r = r.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*cell).orderBy("order_key", "doc_id", "size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = r.withColumns({"rate": rate, "offset": offset})
    copies = F.floor(F.col("rank") * F.col("rate") + F.col("offset")) - F.floor((F.col("rank") - 1) * F.col("rate") + F.col("offset"))
    return r.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)])


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns unchanged, each as often as it is taken. Columns must have distinct names."""
    names = docs.columns
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    at = {c: f"c{i}" for i, c in enumerate(names)}
    m = mix(numbered, keep=tuple(at.values()), **{"id_col": at[options.pop("id_col", "doc_id")], "text_col": at[options.pop("text_col", "text")], "source_col": at[options.pop("source_col", "source")]} | options)
    m = m.where("copies > 0").withColumn("copy_number", F.explode(F.expr("sequence(1L, copies)")))
    return m.select(*[F.col(own).alias(c) for c, own in at.items()])


def op10_mix(spark, sf_dir: str) -> DataFrame:
    m = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS order_key FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS weight
  FROM d GROUP BY source),
f AS (
  SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / weight AS fill,
         sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM s),
g AS (
  SELECT *, CAST(total - coalesce(sum(cap) OVER o, 0) AS DOUBLE) / CAST(weights - coalesce(sum(weight) OVER o, 0) AS DOUBLE) AS lvl
  FROM f WINDOW o AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * (max(lvl) OVER ())) AS target,
         list_reduce(list_transform(string_split(substr(md5('mix|' || coalesce(source, chr(0) || 'null')), 1, 8), ''),
           lambda c: CAST(instr('0123456789abcdef', c) - 1 AS BIGINT)), lambda a, b: a * 16 + b) / 4294967296.0 AS u
  FROM g),
r AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)), order_key, doc_id, size) AS rk
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(rk * rate + CAST(u AS DOUBLE)) - floor((rk - 1) * rate + CAST(u AS DOUBLE)) AS BIGINT) * size AS taken FROM r
"""
