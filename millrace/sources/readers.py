"""Sources, batch and streaming."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from millrace.functions.templates import Scope, render
from millrace.operators.model import to_events


def file(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Lines of a file or folder as events; streaming picks up new files."""
    reader = (spark.readStream if stream else spark.read).options(**options)
    d = reader.text(path)
    return to_events(d.withColumn("__f", F.input_file_name()), message=F.col("value"), source=F.lit("file"), nv=F.create_map(F.lit("FILE_NAME"), F.col("__f")), stamp=F.current_timestamp())


def wildcard_file(spark: SparkSession, base: str, pattern: str = "*", recursive: bool = False, exclude: str | None = None, max_files: int | None = None, stream: bool = False) -> DataFrame:
    """Files of a tree by glob; ``max_files`` bounds what a micro-batch takes."""
    o = {"pathGlobFilter": pattern, "recursiveFileLookup": str(recursive).lower()}
    if stream and max_files:
        o["maxFilesPerTrigger"] = str(max_files)
    d = file(spark, base, stream, **o)
    if exclude:
        from millrace.functions.strings import glob_to_regex

        d = d.where(~F.element_at(F.split(F.col("nv")["FILE_NAME"], "/"), -1).rlike(glob_to_regex(exclude)))
    return d


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP connection: for trials, as Spark keeps no offsets for it."""
    d = spark.readStream.format("socket").options(host=host, port=port).load()
    return to_events(d, message=F.col("value"), source=F.lit("network"), stamp=F.current_timestamp())


def kafka(spark: SparkSession, servers: str, topics: str, stream: bool = True, **options) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    d = (spark.readStream if stream else spark.read).format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topics} | options).load()
    return to_events(d, message=F.col("value").cast("string"), source=F.col("topic"), stamp=F.col("timestamp"))


def generator(spark: SparkSession, num: int | None = None, freq: int = 1, template: str = "-- Generated message. --", values: dict[str, str] | None = None) -> DataFrame:
    """Synthetic rows: ``num`` at once, or ``freq`` a second as a stream."""
    nv = F.create_map(*[x for k, v in (values or {}).items() for x in (F.lit(k), F.lit(v))]) if values else F.create_map().cast("map<string,string>")
    if num is None:
        d = spark.readStream.format("rate").option("rowsPerSecond", freq).load()
        d = to_events(d, stamp=F.col("timestamp"), source=F.lit("generator"), nv=nv)
        return d.withColumn("message", render(template, Scope.of(d)))
    d = to_events(spark.range(num), stamp=F.current_timestamp(), source=F.lit("generator"), nv=nv)
    return d.withColumn("message", render(template, Scope.of(d)))


def random_choice(spark: SparkSession, num: int, choices: list[str], seed: int = 0) -> DataFrame:
    pick = F.element_at(F.array(*map(F.lit, choices)), (F.floor(F.rand(seed) * len(choices)) + 1).cast("int"))
    return to_events(spark.range(num), stamp=F.current_timestamp(), message=pick, source=F.lit("random-choice"))


def journal(spark: SparkSession, path: str, prefix: str = ".journald.") -> DataFrame:
    """An export of the journal in JSON lines."""
    d = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("m"))
    m = F.col("m")
    return to_events(d, stamp=F.timestamp_micros(m["__REALTIME_TIMESTAMP"].try_cast("bigint")), host=m["_HOSTNAME"], program=F.coalesce(m["SYSLOG_IDENTIFIER"], m["_COMM"]), pid=F.coalesce(m["SYSLOG_PID"], m["_PID"]), message=m["MESSAGE"], pri=F.coalesce(m["SYSLOG_FACILITY"].try_cast("int"), F.lit(1)) * 8 + F.coalesce(m["PRIORITY"].try_cast("int"), F.lit(5)), source=F.lit("journal"), nv=F.transform_keys(m, lambda k, _: F.concat(F.lit(prefix), k)))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Events that :func:`millrace.sources.writers.spool` kept."""
    from millrace.operators.model import SCHEMA

    return spark.read.schema(SCHEMA).parquet(path)


#: Binary process accounting, version 3, little-endian.
_ACCT = "<BBHIIIIIIfHHHHHHHH16s"


def pacct(spark: SparkSession, path: str) -> DataFrame:
    """Records of process accounting files: command, user, group, pid, exit code, times, begin."""

    def run(batches):
        import struct

        import pyarrow as pa

        size = struct.calcsize(_ACCT)
        for b in batches:
            rows = []
            for content in b.column(0).to_pylist():
                for i in range(0, len(content) - size + 1, size):
                    f = struct.unpack(_ACCT, content[i : i + size])
                    expand = lambda c: (c & 0x1FFF) << (3 * (c >> 13))
                    rows.append({"flags": f[0], "tty": f[2], "exitcode": f[3], "uid": f[4], "gid": f[5], "pid": f[6], "ppid": f[7], "begin": f[8], "etime": f[9], "utime": expand(f[10]), "stime": expand(f[11]), "command": f[18].split(b"\0")[0].decode("latin-1")})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(k, pa.string() if k == "command" else pa.float64() if k == "etime" else pa.int64()) for k in rows[0]]))

    d = spark.read.format("binaryFile").load(path).select("content")
    return d.mapInArrow(run, "flags long, tty long, exitcode long, uid long, gid long, pid long, ppid long, begin long, etime double, utime long, stime long, command string")


class ProgramSource(DataSource):
    """``spark.read.format("millrace-program").option("command", ...)``: lines of a child process."""

    @classmethod
    def name(cls) -> str:
        return "millrace-program"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _ProgramReader(self.options["command"])


class _ProgramReader(DataSourceReader):
    def __init__(self, command: str) -> None:
        self.command = command

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        import subprocess

        with subprocess.Popen(self.command, shell=True, stdout=subprocess.PIPE, text=True) as p:  # noqa: S602
            for line in p.stdout:
                yield (line.rstrip("\n"),)


def program(spark: SparkSession, command: str) -> DataFrame:
    """Standard output of a command of the user's own configuration."""
    spark.dataSource.register(ProgramSource)
    return to_events(spark.read.format("millrace-program").option("command", command).load(), message=F.col("value"), source=F.lit("program"), stamp=F.current_timestamp())


class FetcherSource(DataSource):
    """A user's fetcher class with ``open``, ``fetch`` (a text or None) and ``close``, by its pickled form."""

    @classmethod
    def name(cls) -> str:
        return "millrace-fetcher"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _FetcherReader(self.options["fetcher"], json.loads(self.options.get("settings", "{}")))


class _FetcherReader(DataSourceReader):
    def __init__(self, fetcher: str, settings: dict) -> None:
        self.fetcher, self.settings = fetcher, settings

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        import base64

        from pyspark import cloudpickle

        f = cloudpickle.loads(base64.b64decode(self.fetcher))(**self.settings)
        f.open()
        try:
            while (text := f.fetch()) is not None:
                yield (text,)
        finally:
            f.close()


def fetcher(spark: SparkSession, cls: type, **settings) -> DataFrame:
    import base64

    from pyspark import cloudpickle

    spark.dataSource.register(FetcherSource)
    d = spark.read.format("millrace-fetcher").options(fetcher=base64.b64encode(cloudpickle.dumps(cls)).decode(), settings=json.dumps(settings)).load()
    return to_events(d, message=F.col("value"), source=F.lit("python"), stamp=F.current_timestamp())


class InternalLog:
    """The library's own log as a source: progress of streaming queries, kept by a listener for :meth:`events`."""

    def __init__(self, spark: SparkSession, most: int = 10_000) -> None:
        from collections import deque

        from pyspark.sql.streaming import StreamingQueryListener

        self.spark, self.lines = spark, deque(maxlen=most)
        kept = self.lines

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):  # noqa: N802
                kept.append(f"query started; id='{event.id}'")

            def onQueryProgress(self, event):  # noqa: N802
                kept.append(f"query progress; id='{event.progress.id}', rows='{event.progress.numInputRows}'")

            def onQueryIdle(self, event):  # noqa: N802
                pass

            def onQueryTerminated(self, event):  # noqa: N802
                kept.append(f"query ended; id='{event.id}', error='{event.exception or ''}'")

        self.listener = Listener()
        spark.streams.addListener(self.listener)

    def events(self) -> DataFrame:
        d = self.spark.createDataFrame([(x,) for x in self.lines], "value string")
        return to_events(d, message=F.col("value"), source=F.lit("internal"), program=F.lit("millrace"), stamp=F.current_timestamp())

    def close(self) -> None:
        self.spark.streams.removeListener(self.listener)
