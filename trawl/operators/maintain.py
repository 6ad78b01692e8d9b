"""Maintenance of the occurrence table: old state and changes in, new state out. Where it is stored is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawl.operators.extract import KEY, extract_occurrences

FILE = ["project", "path"]
RECORD = ("word", "path", "offset", "kind", "project", "is_super")


def delete_file_occurrences(occ: DataFrame, files: DataFrame) -> DataFrame:
    return occ.join(files.select(*FILE).distinct(), FILE, "left_anti")


def upsert_files(occ: DataFrame, changed: DataFrame, *, gone: DataFrame | None = None, by_project: bool = False) -> DataFrame:
    """Replaces the rows of the changed files; applied twice it is as if applied once. gone: the names of the changed files,
    where they are at hand."""
    return delete_file_occurrences(occ, changed if gone is None else gone).unionByName(extract_occurrences(changed, by_project=by_project))


def rebuild_projects(occ: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """All files of the projects extracted anew, whatever was recorded for them."""
    own = projects.select("project").distinct()
    return occ.join(own, "project", "left_anti").unionByName(extract_occurrences(sources.join(own, "project", "left_semi")))


def drop_projects(occ: DataFrame, projects: DataFrame) -> DataFrame:
    return occ.join(projects.select("project").distinct(), "project", "left_anti")


def audit_occurrences(occ: DataFrame, lines: DataFrame) -> DataFrame:
    """Per project: rows, rows with a null or an unknown kind or a negative offset, repeated keys, words not at their
    place in their line, and whether none of that was found."""
    # a file's lines are one row, so that words meet them by file, as they are dealt, and are neither shuffled nor sorted
    per_line = lines.groupBy(*FILE, "line_no").agg(F.collect_list(F.struct("line")).alias("texts"))
    per_file = per_line.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("line_no", "texts"))).alias("lines"))
    met = occ.join(per_file.hint("shuffle_hash"), FILE, "left")
    place = F.get("lines", (F.col("line_no") - F.get("lines", F.lit(0))["line_no"]).cast("int"))
    other = F.get(F.filter("lines", lambda n: n["line_no"] == F.col("line_no")), F.lit(0))  # where numbers leave some out
    texts = F.when(place["line_no"] == F.col("line_no"), place["texts"]).otherwise(other["texts"])
    seen = met.withColumn("texts", texts)
    wrong = F.col("word").isNull() | F.col("offset").isNull() | (F.col("offset") < 0) | ~F.col("kind").isin("Declaration", "Reference")
    misses = lambda line: F.substring(line, (F.col("offset") - F.col("line_start") + 1).cast("int"), F.length("word")) != F.col("word")
    astray = F.when(F.size("texts") == 1, misses(F.get("texts", F.lit(0))["line"])).otherwise(F.exists("texts", lambda t: misses(t["line"])))
    times = F.greatest(F.size("texts"), F.lit(1)).cast("long")  # a row counts once for each line of its number
    per_key = seen.groupBy(*KEY).agg(F.sum(times).alias("n"), F.max(wrong.cast("int")).alias("wrong"), F.max(F.coalesce(astray, F.lit(True)).cast("int")).alias("astray"))
    sums = per_key.groupBy("project").agg(
        F.sum("n").cast("long").alias("n_rows"),
        F.sum(F.col("n") * F.col("wrong")).cast("long").alias("n_wrong"),
        F.sum(F.col("n") - 1).cast("long").alias("n_repeated"),
        F.sum(F.col("n") * F.col("astray")).cast("long").alias("n_astray"),
    )
    return sums.withColumn("is_clean", (F.col("n_wrong") + F.col("n_repeated") + F.col("n_astray")) == 0)


def projects_to_rebuild(projects: DataFrame, audit: DataFrame) -> DataFrame:
    """Projects without a clean record; a project that was never audited has none."""
    return projects.select("project").distinct().join(audit.select("project", "is_clean"), "project", "left").filter(~F.coalesce("is_clean", F.lit(False))).select("project")


def export_records(occ: DataFrame) -> DataFrame:
    """The all-string form."""
    return occ.select(*(F.col(c).cast("string").alias(c) for c in RECORD))


def _judged(records: DataFrame, files: DataFrame) -> DataFrame:
    """Each record with its offset as a number and its outcome. Records are read once; the listed files, one row each, meet
    them by a hash join, for which records are not sorted."""
    number = F.expr("try_cast(offset as bigint)")
    whole = F.lit(True)
    for c in RECORD:
        whole = whole & F.col(c).isNotNull()
    whole = whole & number.isNotNull() & F.col("kind").isin("Declaration", "Reference")
    listed = files.select(*FILE).distinct().withColumn("listed", F.lit(True))
    outcome = F.when(~whole, "invalid").when(F.col("listed"), "good").otherwise("missing")
    return records.join(listed.hint("shuffle_hash"), FILE, "left").withColumn("number", number).withColumn("outcome", outcome).drop("listed")


def ingest_records(records: DataFrame, files: DataFrame, *, apart: bool = True) -> tuple[DataFrame, DataFrame, DataFrame] | DataFrame:
    """Typed rows, records with a missing or unreadable field, and records whose file is gone.

    A truth value other than true reads as false. If not apart, all records in one pass, with `number`, their offset, and
    `outcome`: good, invalid or missing. Each of the three frames reads the records again.
    """
    judged = _judged(records, files)
    if not apart:
        return judged
    rows = lambda outcome: judged.filter(F.col("outcome") == outcome)
    good = rows("good").select("project", "path", "word", F.col("number").alias("offset"), "kind", (F.col("is_super") == "true").alias("is_super"))
    return good, rows("invalid").select(*records.columns), rows("missing").select(*records.columns)
