"""Rewrites: events in, events out. ``condition`` limits one to the rows where it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.functions.strings import glob_to_regex, regexp_subst
from millrace.functions.templates import CORE, FACILITIES, SEVERITIES, Scope, render
from millrace.functions.typed import disjunction, merged, with_member
from millrace.operators.filters import true


def get(df: DataFrame, name: str) -> Column:
    own = CORE.get(name, name)
    return F.col(f"`{own}`") if own in df.columns else F.col("nv")[name]


def put(df: DataFrame, name: str, value: Column, condition: Column | None = None, kind: str | None = None) -> DataFrame:
    """Sets a core column or a field; its type too, if given."""
    own = CORE.get(name, name)
    if own in df.columns:
        value = value.cast(df.schema[own].dataType)
        return df.withColumn(own, value if condition is None else F.when(true(condition), value).otherwise(F.col(f"`{own}`")))
    set_ = with_member(F.col("nv"), F.lit(name), value.cast("string"))
    df = df.withColumn("nv", set_ if condition is None else F.when(true(condition), set_).otherwise(F.col("nv")))
    if kind and "nv_types" in df.columns:
        typed = merged(F.col("nv_types"), F.create_map(F.lit(name), F.lit(kind)))
        df = df.withColumn("nv_types", typed if condition is None else F.when(true(condition), typed).otherwise(F.col("nv_types")))
    return df


def set_(df: DataFrame, template: str, name: str, condition: Column | None = None, kind: str | None = None) -> DataFrame:
    return put(df, name, render(template, Scope.of(df)), condition, kind)


def unset(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    own = CORE.get(name, name)
    if own in df.columns:
        return put(df, name, F.lit(None), condition)
    cut = F.map_filter("nv", lambda k, _: k != name)
    return df.withColumn("nv", cut if condition is None else F.when(true(condition), cut).otherwise(F.col("nv")))


def subst(df: DataFrame, pattern: str, replacement: str, name: str, global_: bool = False, condition: Column | None = None, ignore_case: bool = False) -> DataFrame:
    return put(df, name, regexp_subst(get(df, name), pattern, replacement, global_, ignore_case), condition)


def rename(df: DataFrame, old: str, new: str, condition: Column | None = None) -> DataFrame:
    has = get(df, old).isNotNull()
    c = has if condition is None else has & true(condition)
    return unset(put(df, new, get(df, old), c), old, c)


def _globs(names: list[str] | tuple[str, ...]):
    return lambda k: disjunction([k.rlike(glob_to_regex(n)) for n in names])


def groupset(df: DataFrame, template: str, names: tuple[str, ...], condition: Column | None = None) -> DataFrame:
    """Sets every field whose name fits a glob; ``$_`` is its old value."""
    fits, scope = _globs(names), Scope.of(df)
    new = F.transform_values("nv", lambda k, v: F.when(fits(k), render(template, Scope(scope.columns, {"_": v}))).otherwise(v))
    return df.withColumn("nv", new if condition is None else F.when(true(condition), new).otherwise(F.col("nv")))


def groupunset(df: DataFrame, names: tuple[str, ...], condition: Column | None = None) -> DataFrame:
    fits = _globs(names)
    new = F.map_filter("nv", lambda k, _: ~fits(k))
    return df.withColumn("nv", new if condition is None else F.when(true(condition), new).otherwise(F.col("nv")))


def set_tag(df: DataFrame, tag: str, condition: Column | None = None) -> DataFrame:
    return put(df, "tags", F.array_union("tags", F.array(F.lit(tag))), condition)


def clear_tag(df: DataFrame, tag: str, condition: Column | None = None) -> DataFrame:
    return put(df, "tags", F.array_remove("tags", tag), condition)


def set_matches(df: DataFrame, values: Column, condition: Column | None = None) -> DataFrame:
    """``$1``, ``$2``, ... from an array."""
    cut = F.map_filter("nv", lambda k, _: ~k.rlike(r"^\d+$"))
    new = merged(cut, F.map_from_arrays(F.transform(values, lambda _, i: (i + 1).cast("string")), values))
    return df.withColumn("nv", new if condition is None else F.when(true(condition), new).otherwise(F.col("nv")))


def unset_matches(df: DataFrame) -> DataFrame:
    return df.withColumn("nv", F.map_filter("nv", lambda k, _: ~k.rlike(r"^\d+$")))


def set_pri(df: DataFrame, value: Column, condition: Column | None = None) -> DataFrame:
    """0 to 1023; anything else leaves it."""
    n = value.try_cast("int")
    return put(df, "pri", F.when(n.between(0, 1023), n).otherwise(F.col("pri")), condition)


def set_severity(df: DataFrame, value: Column, condition: Column | None = None) -> DataFrame:
    """A name or number."""
    n = F.coalesce(value.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(value)), F.lit(0)).cast("int") - 1)
    return put(df, "pri", F.when(n.between(0, 7), F.floor(F.col("pri") / 8) * 8 + n).otherwise(F.col("pri")), condition)


def set_facility(df: DataFrame, value: Column, condition: Column | None = None) -> DataFrame:
    n = F.coalesce(value.try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, FACILITIES)), F.lower(value)), F.lit(0)).cast("int") - 1)
    return put(df, "pri", F.when(n.between(0, 127), n * 8 + F.col("pri") % 8).otherwise(F.col("pri")), condition)


def fix_time_zone(df: DataFrame, zone: str, stamp: str = "stamp") -> DataFrame:
    """The wall time belongs to ``zone``: the instant moves."""
    fixed = dates.fix_timezone(F.timestamp_micros(F.unix_micros(stamp) + F.col("tz_offset").cast("bigint") * 1000000), zone)
    return df.withColumn(stamp, fixed).withColumn("tz_offset", dates.zone_offset(F.col(stamp), zone))


def set_time_zone(df: DataFrame, zone: str, stamp: str = "stamp") -> DataFrame:
    """The same instant, shown in ``zone``."""
    return df.withColumn("tz_offset", dates.zone_offset(F.col(stamp), zone))


def guess_time_zone(df: DataFrame, stamp: str = "stamp", received: str = "recvd") -> DataFrame:
    moved = dates.guess_timezone(F.col(stamp), F.col(received))
    return df.withColumn("tz_offset", (F.col("tz_offset") - (F.unix_micros(moved) - F.unix_micros(stamp)) / 1000000).cast("int")).withColumn(stamp, moved)


_CARD = r"(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2(?:2(?:2[1-9]|[3-9][0-9])|[3-6][0-9]{2}|7(?:[01][0-9]|20))[0-9]{12}|6(?:011|5[0-9]{2})[0-9]{12}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|(?:2131|1800|35[0-9]{3})[0-9]{11})"


def credit_card_mask(s: Column, mask: str = "*") -> Column:
    """Card numbers keep their first six and last four digits."""
    return F.regexp_replace(s, rf"(?<![0-9])(?={_CARD}(?![0-9]))([0-9]{{6}})[0-9]+([0-9]{{4}})(?![0-9])", f"$1{mask * 6}$2")


def credit_card_hash(s: Column, length: int = 16) -> Column:
    """The first card number becomes the start of its SHA-1."""
    card = F.regexp_extract(s, rf"(?<![0-9])({_CARD})(?![0-9])", 1)
    return F.when(card != "", F.replace(s, card, F.substring(F.sha1(card.cast("binary")), 1, length))).otherwise(s)


def map_value_pairs(df: DataFrame, keys: tuple[str, ...] = (), pairs: dict[str, str] | None = None, rekey: tuple = ()) -> DataFrame:
    """Copies fields under new names; the old stay."""
    scope = Scope.of(df)
    chosen = value_pairs(scope, keys=list(keys), pairs=[(k, render(t, scope)) for k, t in (pairs or {}).items()], rekey=rekey)
    return df.withColumn("nv", merged(F.col("nv"), chosen))


#: What a value-pairs scope adds to the field map, by name and template.
_RFC3164 = ("FACILITY", "PRIORITY", "HOST", "PROGRAM", "PID", "MESSAGE", "DATE")
SCOPES = {"rfc3164": _RFC3164, "core": _RFC3164, "base": _RFC3164, "rfc5424": (*_RFC3164, "MSGID"), "syslog-proto": (*_RFC3164, "MSGID"), "selected-macros": (*_RFC3164, "TAGS", "SOURCEIP", "SEQNUM"), "all-macros": (*_RFC3164, "MSGID", "TAGS", "ISODATE", "UNIXTIME", "PRI")}


def _keyed(change):
    return lambda k, _: change(k)


def value_pairs(scope: Scope, scopes: list[str] | tuple = (), keys: list[str] | tuple = (), exclude: list[str] | tuple = (), pairs: list[tuple[str, Column]] | tuple = (), rekey: tuple = ()) -> Column:
    """A map of the chosen fields: by scopes and name globs, less the excluded, plus computed pairs, with names changed by ``rekey`` functions."""
    nv = F.col("nv") if "nv" in scope.columns else scope.pairs()
    out = F.create_map().cast("map<string,string>")
    every = set(scopes)
    if every & {"nv-pairs", "all-nv-pairs", "everything"}:
        out = merged(out, nv if every & {"all-nv-pairs", "everything"} else F.map_filter(nv, lambda k, _: ~k.startswith(".")))
    elif "dot-nv-pairs" in every:
        out = merged(out, F.map_filter(nv, lambda k, _: k.startswith(".")))
    if keys:
        fits = _globs(keys)
        out = merged(out, F.map_filter(nv, lambda k, _: fits(k)))
    macros = list(dict.fromkeys(m for s in scopes for m in (SCOPES["all-macros"] if s == "everything" else SCOPES.get(s, ()))))
    macros += [k for k in keys if "*" not in k and "?" not in k and k in CORE]
    if macros:
        made = F.create_map(*[x for m in macros for x in (F.lit(m), scope.get(m))])
        out = merged(out, F.map_filter(made, lambda _, v: v.isNotNull() & (v != "")))
    if every & {"sdata", "everything"} and "sdata" in scope.columns:
        flat = F.flatten(F.transform(F.map_entries("sdata"), lambda e: F.transform(F.map_entries(e["value"]), lambda p: F.struct(F.concat(F.lit(".SDATA."), e["key"], F.lit("."), p["key"]).alias("key"), p["value"].alias("value")))))
        out = merged(out, F.map_from_entries(flat))
    if exclude:
        bad = _globs(exclude)
        out = F.map_filter(out, lambda k, _: ~bad(k))
    if pairs:
        out = merged(out, F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]))
    for change in rekey:
        out = F.transform_keys(out, _keyed(change))
    return out


def add_prefix(prefix: str):
    return lambda k: F.concat(F.lit(prefix), k)


def shift(n: int):
    """Cuts so many characters off the front."""
    return lambda k: F.substring(k, F.lit(n + 1), F.length(k))


def shift_levels(n: int):
    """Cuts so many dotted levels off the front."""
    return lambda k: F.array_join(F.slice(F.split(k, r"\."), F.lit(n + 1), F.greatest(F.size(F.split(k, r"\.")) - n, F.lit(0))), ".")


def replace_prefix(old: str, new: str):
    return lambda k: F.when(k.startswith(old), F.concat(F.lit(new), F.substring(k, F.lit(len(old) + 1), F.length(k)))).otherwise(k)


def upper(k: Column) -> Column:
    return F.upper(k)


def lower(k: Column) -> Column:
    return F.lower(k)
