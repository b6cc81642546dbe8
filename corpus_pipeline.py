"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

1. Language ID: documents in which no language is found (no letter) go; a null lang takes the language that the network finds.
2. MinHash near-dedup: of documents whose sets of five-word shingles are linked at a similarity of 0.8, one stays.
3. Substring dedup: words covered by a window of 35 words that stands elsewhere too are cut out of the text.
4. Mixing: documents are taken as often as the target weights of their sources ask for; a copy is a row.
5. Byte-level BPE: token ids of every row that is left, checked by decoding.

Edge cases: a null, empty or letterless text goes in stage 1; of repeated rows, and of rows with a null id that share their
text with others, one stays (stage 2: the smallest id, then the least digest of the row), so what is left of a document is
not cut as a repeat of itself; texts of any length are read whole; a null source is a source of its own, last in order; ties
are broken by id; an empty table gives an empty result; columns beyond those of documents pass through all stages but the
last, whatever their names; ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, bpe_query, langid, mixing, neardup, substring
from millrace.session import remove, shared_dir

#: No SQL: a trained network, full-set similarity and a merge queue.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.fit(docs, ~langid.held_out(F.col("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.without_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    r = substring.remove_repeats(docs, 35, keep=others).withColumnRenamed("kept_text", "text")
    return r.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emitted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = bpe_query.vocabulary()
    r = bpe.encode(docs, path, pattern, decoded=True)
    return r.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing to target weights", mixture),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
