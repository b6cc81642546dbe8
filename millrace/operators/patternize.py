"""Mining line patterns: words that are frequent at their place, and the clusters of lines that they spell."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import quoted
from millrace.session import written

DELIMITERS = " :&~?![]=,;()'\""


def frequent_words(lines: DataFrame, line: str, support: int, delimiters: str = DELIMITERS) -> DataFrame:
    """pos, word, n of words that stand at a place in so many lines; counted in part before the shuffle."""
    words = lines.select(F.posexplode(F.split(F.col(line), "[" + "".join(map(quoted, delimiters)) + "]")).alias("pos", "word"))
    return words.groupBy("pos", "word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)


def clusters(lines: DataFrame, line: str, support: int, delimiters: str = DELIMITERS, wildcard: str = "\x1a") -> tuple[DataFrame, DataFrame]:
    """(pattern, n) of the clusters with support, and the lines with their ``__pattern``. The delimiters are part of the pattern; a word that isn't frequent at its place is a wildcard."""
    d = lines.withColumn("__id", F.xxhash64(line))
    cls = "[" + "".join(map(quoted, delimiters)) + "]"
    texts = d.groupBy("__id", line).agg(F.count(F.lit(1)).alias("__n"))  # equal lines are worked on once
    words = texts.select("__id", F.col(line).alias("__line"), "__n", F.posexplode(F.split(F.col(line), cls)).alias("pos", "word"))
    often = words.groupBy("pos", "word").agg(F.sum("__n").alias("n")).where(F.col("n") >= support).select("pos", "word", F.lit(True).alias("__often"))
    j = words.join(often, ["pos", "word"], "left")
    spelled = j.groupBy("__id", "__line", "__n").agg(F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("__often"), F.col("word")).otherwise(F.lit(wildcard)).alias("w")))).alias("ws"), F.max(F.coalesce("__often", F.lit(False))).alias("any"))
    marks = F.concat(F.regexp_extract_all(F.col("__line"), F.lit(f"({cls})"), F.lit(1)), F.array(F.lit("")))
    pattern = F.array_join(F.zip_with(F.transform("ws", lambda x: x["w"]), marks, lambda w, m: F.concat(w, F.coalesce(m, F.lit("")))), "")
    out = spelled.where("any").select("__id", "__line", "__n", pattern.alias("__pattern"))
    counted = out.groupBy("__pattern").agg(F.sum("__n").alias("n")).where(F.col("n") >= support)
    return counted.select(F.col("__pattern").alias("pattern"), "n"), out.join(counted.select("__pattern"), "__pattern", "left_semi")


def patternize(lines: DataFrame, line: str, support: float = 4.0, delimiters: str = DELIMITERS, iterate_outliers: bool = False) -> DataFrame:
    """pattern, n. ``support`` is a percentage of the lines; with ``iterate_outliers``, lines of no cluster are mined again, with the percentage of what is left, until a round finds no cluster or no line is left."""
    rest = lines.select(line).where(F.col(line).isNotNull())
    found = None
    while n := rest.count():
        made, members = clusters(rest, line, max(1, math.floor(n * support / 100)), delimiters)
        made = written(made)
        found = made if found is None else found.union(made)
        if not iterate_outliers or made.isEmpty():
            break
        rest = written(rest.join(members.select(F.col("__line").alias(line)).distinct(), line, "left_anti"))
    out = found if found is not None else lines.sparkSession.createDataFrame([], "pattern string, n long")
    return out.groupBy("pattern").agg(F.sum("n").alias("n"))


def as_rule_pattern(pattern: str, wildcard: str = "\x1a") -> str:
    """A mined pattern with tokens for its wildcards, for a pattern database."""
    out, i, n = "", 0, 0
    while i < len(pattern):
        if pattern[i] == wildcard:
            end = pattern[i + 1] if i + 1 < len(pattern) else ""
            out += f"@ESTRING:.dict.string{n}:{end}@" if end else f"@ANYSTRING:.dict.string{n}@"
            n += 1
            i += 2 if end else 1
        else:
            out += "@@" if pattern[i] == "@" else pattern[i]
            i += 1
    return out
