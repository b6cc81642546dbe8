"""Classic filters: boolean Columns over one event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.strings import glob_to_regex, in_subnet, java_regex
from millrace.functions.templates import FACILITIES, SEVERITIES


def true(c: Column) -> Column:
    """Null counts as false, so that a negation keeps it."""
    return F.coalesce(c, F.lit(False))


def severity(low: str, high: str | None = None) -> Column:
    """A level, or all from one to another."""
    a, b = SEVERITIES.index(low), SEVERITIES.index(high or low)
    return true((F.col("pri") % 8).between(min(a, b), max(a, b)))


def facility(*wanted: str | int) -> Column:
    return true(F.floor(F.col("pri") / 8).isin([w if isinstance(w, int) else FACILITIES.index(w) for w in wanted]))


def match(column: Column, pattern: str, kind: str = "pcre", flags: tuple[str, ...] = ()) -> Column:
    """By regex, literal (whole, or by prefix or substring) or glob."""
    if kind in ("pcre", "posix"):
        return true(column.rlike(java_regex(pattern, flags)))
    if kind == "glob":
        return true(column.rlike(glob_to_regex(pattern)))
    if "ignore-case" in flags:
        column, pattern = F.lower(column), pattern.lower()
    if "substring" in flags:
        return true(column.contains(pattern))
    return true(column.startswith(pattern)) if "prefix" in flags else true(column == pattern)


def program(pattern: str, kind: str = "pcre", flags: tuple[str, ...] = ()) -> Column:
    return match(F.col("program"), pattern, kind, flags)


def host(pattern: str, kind: str = "pcre", flags: tuple[str, ...] = ()) -> Column:
    return match(F.col("host"), pattern, kind, flags)


def message(pattern: str, kind: str = "pcre", flags: tuple[str, ...] = ()) -> Column:
    return match(F.col("message"), pattern, kind, flags)


def source(name: str) -> Column:
    return true(F.col("source") == name)


def netmask(cidr: str, column: str = "peer_ip") -> Column:
    """IPv4; an event without a peer counts as from this machine."""
    return in_subnet(F.coalesce(F.col(column), F.lit("127.0.0.1")), cidr)


def netmask6(cidr: str, column: str = "peer_ip") -> Column:
    return in_subnet(F.coalesce(F.col(column), F.lit("::1")), cidr if ":" in cidr else cidr)


def tags(*wanted: str) -> Column:
    """Any of them."""
    return true(F.arrays_overlap(F.col("tags"), F.array(*map(F.lit, wanted))))


def in_list(df: DataFrame, column: str, values: DataFrame, negate: bool = False, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows whose value stands (or doesn't) in a one-column list. A list of a checked size is broadcast; a longer one is joined by a shuffle."""
    name = values.columns[0]
    side = values.select(F.col(name).alias("__listed")).where("__listed IS NOT NULL").distinct()
    if side.limit(broadcast_rows + 1).count() <= broadcast_rows:
        side = F.broadcast(side)
    return df.join(side, df[column] == side["__listed"], "left_anti" if negate else "left_semi")


def legacy_number(s: Column) -> Column:
    """What C's atoi makes of text."""
    return F.coalesce(F.regexp_extract(s, r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


