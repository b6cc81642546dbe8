"""The query over byte-level BPE: encodes and decodes whole texts, with digests of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import encode


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the public 50k vocabulary that is installed beside this library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    path, pattern = vocabulary()
    r = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, pattern, decoded=True)
    return r.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
