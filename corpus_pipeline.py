"""The corpus pipeline: documents through language ID, line dedup, near duplicates, mixing and packing.

Each stage's rows are written as Parquet in the shared folder and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import language, line_dedup, mixing, ngram_join, packing
from evalframe.llm.common import small_batches, written

#: No stage but the second can be told in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def apart(docs: DataFrame, *made: str) -> tuple[DataFrame, list]:
    """The documents with columns named as those that an operator makes put under other names, and the selection that gives all back."""
    own = {c: f"__own_{i}_{c}" if c.lower() in made else c for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(own), [F.col(n).alias(c) for c, n in own.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows; it learns from the labels of those given. Rejected ones go, and so do null and empty
    texts and those without a letter. Repeated rows fare alike; other columns stay as they are, whatever their names."""
    small_batches(spark)
    rows, back = apart(docs, "lang_pred", "score", "rejected")
    found = language.identify(rows, language.fit(rows, F.lit(True)))
    return found.where("not rejected").select(back)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those with nothing left go, an empty or null text stays.
    n_chars follows the text; other columns stay as they are."""
    small_batches(spark)
    rows, back = apart(docs, "n_lines", "n_removed")
    kept = line_dedup.dedup_lines(rows).where("n_removed = 0 or text <> ''")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; texts without words stay. A repeated row
    stays once; other columns stay as they are."""
    small_batches(spark)
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them; rows that share doc_id, source and text count as one with the sum
    of their copies. Null and empty texts have size 0 and stay once. Other columns stay as they are."""
    small_batches(spark)
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two pieces of the documents' tokens, row by row: repeated rows are packed each; a null or empty text has the end
    token alone; columns other than doc_id and text take no part."""
    small_batches(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
