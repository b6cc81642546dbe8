"""Sinks: templated files, batched requests, tables, and the message formats of services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.templates import Scope, render

DEFAULT = "$ISODATE $HOST ${MSGHDR}$MSG"


def file(df: DataFrame, folder: str, path_template: str | None = None, template: str = DEFAULT, mode: str = "append") -> None:
    """Lines by template; a templated path is dynamic partitioning below the folder."""
    scope = Scope.of(df)
    d = df.select(render(template, scope).alias("value"), *([render(path_template, scope).alias("path")] if path_template else []))
    w = d.write.mode(mode)
    (w.partitionBy("path") if path_template else w).text(folder)


def spool(df: DataFrame, path: str, mode: str = "append") -> None:
    """Keeps events on disk for :func:`millrace.sources.readers.replay`."""
    df.write.mode(mode).parquet(path)


def table(df: DataFrame, columns: dict[str, tuple[str, str]], null: str | None = None) -> DataFrame:
    """The rows of an SQL destination: column to (template, type); text equal to ``null`` is null."""
    scope = Scope.of(df)
    value = lambda t: F.nullif(render(t, scope), F.lit(null)) if null is not None else render(t, scope)
    return df.select(*[value(t).try_cast(kind).alias(c) for c, (t, kind) in columns.items()])


def jdbc(df: DataFrame, url: str, name: str, columns: dict[str, tuple[str, str]], null: str | None = None, **properties: str) -> None:
    """Appends; the driver's jar must be on the class path."""
    table(df, columns, null).write.jdbc(url, name, mode="append", properties=properties)


def kafka(df: DataFrame, servers: str, topic: str, message: str = "$MSG", key: str | None = None) -> None:
    """Templated topic and key; needs the Kafka connector on the class path."""
    scope = Scope.of(df)
    d = df.select(render(topic, scope).alias("topic"), render(message, scope).alias("value"), *([render(key, scope).alias("key")] if key else []))
    d.write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def batches(rows: Iterator[str], lines: int, size: int) -> Iterator[list[str]]:
    """Cuts by number and bytes, whichever comes first."""
    now: list[str] = []
    n = 0
    for r in rows:
        b = len(r.encode())
        if now and (len(now) >= lines or n + b > size):
            yield now
            now, n = [], 0
        now.append(r)
        n += b
    if now:
        yield now


def request(df: DataFrame, body: Column, send: Callable[[str], int], prefix: str = "", delimiter: str = "\n", suffix: str = "", lines: int = 1000, size: int = 1 << 20, retries: int = 3) -> DataFrame:
    """Sends batched bodies from the executors: per batch, rows, bytes and the last status. ``send`` (picklable) gives an HTTP status; 5xx and 429 are tried again. Delivery is at least once."""
    from millrace.session import ship

    ship(df.sparkSession)

    def run(it):
        import pyarrow as pa

        texts = (x.as_py() for b in it for x in b.column(0))
        for group in batches(texts, lines, size):
            text = prefix + delimiter.join(group) + suffix
            status = 0
            for _ in range(retries):
                status = send(text)
                if status < 500 and status != 429:
                    break
            yield pa.RecordBatch.from_pydict({"rows": pa.array([len(group)], pa.int64()), "bytes": pa.array([len(text.encode())], pa.int64()), "status": pa.array([status], pa.int32())})

    return df.select(body.alias("body")).mapInArrow(run, "rows long, bytes long, status int")


def http(url: str, headers: dict[str, str] | None = None, method: str = "POST") -> Callable[[str], int]:
    """A ``send`` over urllib."""

    def send(text: str) -> int:
        import urllib.error
        import urllib.request

        q = urllib.request.Request(url, text.encode(), headers or {}, method=method)  # noqa: S310
        try:
            with urllib.request.urlopen(q, timeout=30) as r:  # noqa: S310
                return r.status
        except urllib.error.HTTPError as e:
            return e.code
        except OSError:
            return 503

    return send


def foreach(stream: DataFrame, write: Callable[[DataFrame], object], checkpoint: str, trigger: str | None = None):
    """A streaming query that gives every micro-batch to a batch writer."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda d, _: write(d) and None)
    return (w.trigger(processingTime=trigger) if trigger else w.trigger(availableNow=True)).start()


# formats of services, one Column each


def json_object(df: DataFrame, pairs: dict[str, str]) -> Column:
    scope = Scope.of(df)
    return F.to_json(F.struct(*[render(t, scope).alias(k) for k, t in pairs.items()]))


def elasticsearch_bulk(df: DataFrame, index: str, document: Column, kind: str = "index", id_: Column | None = None) -> Column:
    head = F.to_json(F.struct(F.struct(render(index, Scope.of(df)).alias("_index"), *([id_.alias("_id")] if id_ is not None else [])).alias(kind)))
    return F.concat(head, F.lit("\n"), document, F.lit("\n"))


def splunk_hec_event(df: DataFrame, event: Column, index: str = "main", source_type: str = "syslog") -> Column:
    return F.to_json(F.struct((F.unix_micros("stamp") / 1e6).alias("time"), F.col("host"), F.col("program").alias("source"), F.lit(source_type).alias("sourcetype"), F.lit(index).alias("index"), event.alias("event")))


def loki_stream(labels: Column, message: Column, stamp: Column) -> Column:
    return F.to_json(F.struct(F.array(F.struct(labels.alias("stream"), F.array(F.array((F.unix_micros(stamp) * 1000).cast("string"), message)).alias("values"))).alias("streams")))


def gelf(df: DataFrame) -> Column:
    return F.to_json(F.struct(F.lit("1.1").alias("version"), F.col("host"), F.col("message").alias("short_message"), (F.unix_micros("stamp") / 1e6).alias("timestamp"), (F.col("pri") % 8).alias("level"), F.col("program").alias("_program")))


def slack(message: Column) -> Column:
    return F.to_json(F.struct(message.alias("text")))


def graphite(name: Column, value: Column, stamp: Column) -> Column:
    return F.concat_ws(" ", name, value.cast("string"), F.unix_timestamp(stamp).cast("string"))


def pubsub(message: Column, attributes: Column) -> Column:
    return F.to_json(F.struct(F.array(F.struct(F.base64(message.cast("binary")).alias("data"), attributes.alias("attributes"))).alias("messages")))


def failed_rows(response: Column) -> Column:
    """Places in a bulk response that should be sent again: items whose status is 429 or 5xx."""
    items = F.from_json(F.get_json_object(response, "$.items"), "array<map<string,struct<status:int>>>")
    return F.filter(F.transform(items, lambda m, i: F.when(F.exists(F.map_values(m), lambda v: (v["status"] == 429) | (v["status"] >= 500)), i)), lambda x: x.isNotNull())
