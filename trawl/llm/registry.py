"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from trawl.llm import decontaminate, infill, language, lattice, merkle, neardup, packing, pii, quality, secrets, shingles, suffixes, tokenfiles
from trawl.llm.common import table


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut)


def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.link_classes(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digested(infill.fill_in_middle(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice": op1_lattice,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_embedding": op4_embedding,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard": op7_jaccard,
    "op8_pii": op8_pii,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_tokens": op11_tokens,
    "op12_merkle": op12_merkle,
    "op13_infill": op13_infill,
    "pipeline": corpus_pipeline.run,
}

#: Models, tokenizers and sketches cannot be said in SQL on whole tables; tests/llm holds the others against brute force.
ORACLES: dict[str, str] = {"op12_merkle": merkle.oracle(), "op13_infill": infill.ORACLE}
