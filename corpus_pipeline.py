"""From raw documents to token ids: five stages, each written and read again as Parquet."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import bpe, decontam, langid, minhash, pii
from tessera.llm.queries import surrogate_key
from tessera.session import read_table, stored


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return langid.accepted(docs, langid.fit(docs))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have in any case, for Spark tells names apart without it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (five-word shingles, 0.8) one row stays, that of the smallest id.

    Rows are numbered, so that those without an id, and those that share one, are judged by themselves.
    Rows without a word are in no component and stay.
    """
    row = _free(docs, "row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    found = minhash.near_duplicates(rows, minhash.Params(), id_col=row).withColumnRenamed(row, "row")
    ids = rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row)).alias("place"))
    away = found.join(ids, "row").groupBy("component_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    away = found.join(ids, "row").join(away.where("n > 1"), "component_id").where("place <> first").select(F.col("row").alias(row))
    return rows.join(away, row, "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, told by their text, so that documents without an id are judged too."""
    texts = docs.select(F.sha2("text", 256).alias("doc_id"), "text")
    key = _free(docs, "away")
    away = decontam.contaminated(texts, read_table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(key))
    return docs.withColumn(key, F.sha2("text", 256)).join(away, key, "left_anti").select(docs.columns)


def replace_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the new text."""
    columns = docs.columns
    count = _free(docs, "n_entities")
    return pii.replace_entities(docs, surrogate_key(spark), count_col=count).withColumn("n_chars", F.length("text").cast("long")).select(columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, checked by decoding them."""
    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("pii_surrogates", replace_private_data),
    ("byte_bpe", encode),
]
#: SQL can express neither the language model nor the merges: tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
