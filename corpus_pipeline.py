"""From raw documents to packed training sequences, in five stages.

Every stage but the last takes and returns rows of `documents`; run() writes each stage's rows as Parquet in the shared
folder and reads them again, so a lost executor costs no more than the tasks it ran.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawl.llm import decontaminate, packing, pii, quality, shingles
from trawl.llm.common import shared_checkpoints, table


def new_name() -> str:
    """A column name that no table has."""
    return f"__{uuid.uuid4().hex}"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; of rows of one id, one. Rows of null id stay."""
    own, number = new_name(), new_name()
    kept = shingles.link_classes(docs).filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    turn = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    rows = docs.join(kept, F.col("doc_id") == F.col(own), "left_semi")
    first = rows.withColumn(number, F.row_number().over(turn)).filter(F.col(number) == 1).drop(number)
    return first.unionAll(docs.filter("doc_id is null"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    own = new_name()
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col(own), "left_anti")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked and n_chars brought up to date."""
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", size)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in the training sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
