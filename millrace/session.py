"""Session helpers: shipping the package to executors and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Rows of an Arrow batch, unless the session says otherwise: rows here hold whole texts, and a batch stands in memory several times.
BATCH_ROWS = 2000
_DEFAULT_ROWS = "10000"
#: Bytes of an Arrow batch, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_DEFAULT_BYTES = 64 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of :data:`BATCH_BYTES`: a Python worker's memory follows the batch, not the table, however long the texts are."""
    at = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(at).removesuffix("b") == str(_DEFAULT_BYTES):
        spark.conf.set(at, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, once per application."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == _DEFAULT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((x for x in root.rglob("*") if x.suffix in (".py", ".txt"))):
            z.write(p, os.path.join(root.name, p.relative_to(root)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset, a local folder if the session is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/millrace-shared"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet in the shared folder and reads it back."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of :func:`shared_dir`."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
