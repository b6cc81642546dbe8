"""The event schema and how tables become events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("stamp", T.TimestampType()), T.StructField("recvd", T.TimestampType()), T.StructField("processed", T.TimestampType()), T.StructField("tz_offset", T.IntegerType()),
    T.StructField("host", T.StringType()), T.StructField("host_from", T.StringType()), T.StructField("program", T.StringType()), T.StructField("pid", T.StringType()), T.StructField("msgid", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("source", T.StringType()), T.StructField("legacy_msghdr", T.StringType()), T.StructField("pri", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("sdata", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))), T.StructField("nv", T.MapType(T.StringType(), T.StringType())), T.StructField("nv_types", T.MapType(T.StringType(), T.StringType())),
])


def to_events(df: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """``df`` under the event schema: the given columns, and empty ones for the rest."""
    empty = {"tags": F.array().cast("array<string>"), "sdata": F.create_map().cast("map<string,map<string,string>>"), "nv": F.create_map().cast("map<string,string>"), "nv_types": F.create_map().cast("map<string,string>"), "pri": F.lit(13), "tz_offset": F.lit(0)}
    out = []
    for f in SCHEMA:
        c = columns.get(f.name, columns["stamp"] if f.name in ("recvd", "processed") and "stamp" in columns else empty.get(f.name, F.lit(None)))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out, *[F.col(f"`{k}`") for k in keep])


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however many fields are read of them later: a projection of their parts isn't merged into them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_nv(df: DataFrame, pairs: Column, types: Column | None = None) -> DataFrame:
    """Sets name-value pairs; a later one wins."""
    from millrace.functions.typed import merged

    out = df.withColumn("nv", merged(F.col("nv"), F.coalesce(pairs, F.create_map().cast("map<string,string>"))))
    return out if types is None else out.withColumn("nv_types", merged(F.col("nv_types"), types))
