"""Searches of the occurrence table. Every search returns every match; word lists, scopes and listings are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators.extract import KEY


def find(occ: DataFrame, *, word: str | None = None, kind: str | None = None, is_super: bool | None = None, path: str | None = None, project: str | None = None) -> DataFrame:
    """Rows that meet all given conditions; they are plain equalities, which reach the scan of a stored table."""
    for name, value in (("word", word), ("kind", kind), ("is_super", is_super), ("path", path), ("project", project)):
        if value is not None:
            occ = occ.filter(F.col(name) == value)
    return occ


def find_any(occ: DataFrame, words: DataFrame) -> DataFrame:
    """Rows whose word is in words(word), each once; an empty list gives nothing."""
    return occ.join(words.select("word").distinct(), "word", "left_semi")


def restrict_scope(occ: DataFrame, scope: DataFrame) -> DataFrame:
    return occ.join(scope.select("project").distinct(), "project", "left_semi")


def live_files_only(occ: DataFrame, files: DataFrame) -> DataFrame:
    return occ.join(files.select("project", "path").distinct(), ["project", "path"], "left_semi")


def batch_search(occ: DataFrame, queries: DataFrame) -> DataFrame:
    """queries(query_id, word, mode): every query's rows in one join on the word; mode is any, declaration or super."""
    wanted = queries.select("query_id", "word", "mode")
    meets = (F.col("mode") == "any") | ((F.col("mode") == "declaration") & (F.col("kind") == "Declaration")) | ((F.col("mode") == "super") & F.col("is_super"))
    return occ.join(wanted, "word").filter(meets)


def search_with_failures(occ: DataFrame, scope: DataFrame, **conditions) -> tuple[DataFrame, DataFrame]:
    """The hits of the projects in scope, and a row for each project of the scope that the table does not hold."""
    there = occ.select("project").distinct()
    failures = scope.select("project").distinct().join(there, "project", "left_anti")
    return restrict_scope(find(occ, **conditions), scope), failures.select("project", F.lit("no index").alias("reason"))


def dedup_occurrences(occ: DataFrame) -> DataFrame:
    """One row for each key; line numbers follow from the key."""
    return occ.dropDuplicates(list(KEY))
