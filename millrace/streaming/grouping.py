"""Stateful streaming: sessions under a watermark, triggered groups and rate limits with keyed state.

Late rows are never dropped by the triggered path: it keeps its state by processing time, so a late row joins the open
group or begins one. The session path follows the watermark; give it a generous delay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import remove, shared_dir, ship


def sessions(df: DataFrame, keys: list[str], timeout: int, aggregates: dict[str, Column], ts: str = "stamp", delay: str = "10 minutes", having: Column | None = None) -> DataFrame:
    """As the batch function of the same sessions; emitted when the watermark passes their end (append mode)."""
    d = df.withColumn("__second", F.date_trunc("second", F.least(F.col(ts), F.current_timestamp()))).withWatermark("__second", delay)
    g = d.groupBy(F.session_window("__second", f"{timeout} seconds").alias("__w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    out = g.select(*keys, F.col("__w.start").alias("session_start"), (F.col("__w.end") - F.expr(f"interval {timeout} seconds")).alias("session_end"), *aggregates)
    return out if having is None else out.where(having)


def triggered(df: DataFrame, keys: list[str], columns: list[str], timeout: int, aggregate: Callable[[list[tuple]], tuple], schema: str, trigger: Callable[[list[tuple]], bool], having: Callable[[list[tuple]], bool] | None = None, order: list[str] | None = None) -> DataFrame:
    """Groups that end at a trigger or after ``timeout`` seconds without a row (of processing time). ``columns`` are what a row tuple holds; output rows are the keys and what ``aggregate`` gives. Rows of a micro-batch come in the order of the columns ``order``, which by default are all of ``columns``."""
    ship(df.sparkSession)
    state = "rows string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        import base64
        import pickle

        rows: list[tuple] = pickle.loads(base64.b64decode(s.get[0])) if s.exists else []
        out: list[tuple] = []

        def emit() -> None:
            if rows and (having is None or having(rows)):
                out.append((*key, *aggregate(rows)))
            rows.clear()

        if s.hasTimedOut:
            emit()
            s.remove()
        else:
            # a key's frames come unsorted against each other
            f = pd.concat(list(frames)).sort_values(order or columns, kind="stable")
            for r in f[columns].itertuples(index=False, name=None):
                rows.append(r)
                if trigger(rows):
                    emit()
            if rows:
                s.update((base64.b64encode(pickle.dumps(rows)).decode(),))
                s.setTimeoutDuration(timeout * 1000)
            elif s.exists:
                s.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [p.strip().split(" ")[0] for p in schema.split(",")]
    return df.groupBy(*keys).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_limited(df: DataFrame, keys: list[str], rate: int, ts: str) -> DataFrame:
    """Rows that a token bucket per key lets through; the bucket lives in the state."""
    ship(df.sparkSession)
    names = df.columns

    def step(key: tuple, frames: Iterator[pd.DataFrame], s: GroupState) -> Iterator[pd.DataFrame]:
        tokens, filled = s.get if s.exists else (rate, -1)
        f = pd.concat(list(frames)).sort_values(ts, kind="stable")  # a key's frames come unsorted against each other
        keep = []
        for t in f[ts].astype("int64") // (1 if f[ts].dtype == "datetime64[us]" else 1000):
            filled = int(t) if filled < 0 else filled
            new = (int(t) - filled) * rate // 1_000_000
            if new > 0:
                tokens, filled = min(rate, tokens + new), int(t)
            keep.append(tokens >= 1)
            tokens -= tokens >= 1
        s.update((int(tokens), int(filled)))
        yield f[keep][names]

    return df.groupBy(*keys).applyInPandasWithState(step, df.schema, "tokens long, filled long", "append", GroupStateTimeout.NoTimeout)


def counters(df: DataFrame, labels: list[str], ts: str, window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Labelled counts per window."""
    d = df.withWatermark(ts, delay).groupBy(F.window(ts, window), *labels).agg(F.count(F.lit(1)).alias("value"))
    return d.select(*labels, F.col("window.start").alias("window_start"), "value")


def written(df: DataFrame, mode: str = "append") -> DataFrame:
    """Drains what a source holds into Parquet in the shared folder, with its checkpoint beside it, and reads that."""
    spark = df.sparkSession
    path, state = shared_dir(spark), shared_dir(spark)
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    remove(spark, state)
    return spark.read.schema(df.schema).parquet(path)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drains what a source holds into a table in memory, for trials and tests. Not for state with processing-time timeouts: that runs until they have fired."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)
