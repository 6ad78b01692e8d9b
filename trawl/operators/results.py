"""Grouping, counting and labelling of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_hit(occ: DataFrame) -> DataFrame:
    return occ.select("project", "path", "word", "offset", (F.col("offset") + F.length("word")).alias("end"), "line_no")


def group_hits(hits: DataFrame) -> DataFrame:
    """Hit counts by project (path null) and by file."""
    counts = hits.rollup("project", "path").agg(F.count(F.lit(1)).cast("long").alias("n_hits"), F.grouping("path").alias("g"))
    return counts.filter("project is not null").select("project", "path", "n_hits")


def group_lines(hits: DataFrame) -> DataFrame:
    """A row per file: its number of hits, and its lines with hits in order, each with the offsets in it. Hits are first
    gathered by line and then by file, so no row holds more than the hits of one file."""
    per_line = hits.groupBy("project", "path", "line_no").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    lines = F.sort_array(F.collect_list(F.struct("line_no", "offsets"))).alias("lines")
    return per_line.groupBy("project", "path").agg(F.sum(F.size("offsets")).cast("long").alias("n_hits"), lines)


def search_summary(hits: DataFrame, by: str) -> DataFrame:
    """Certain, uncertain and all matches of each search; hits have confidence and a number n of equal mentions."""
    part = lambda c: F.coalesce(F.sum(F.when(F.col("confidence") == c, F.col("n"))), F.lit(0)).cast("long")
    return hits.groupBy(by).agg(part("Certain").alias("n_certain"), part("Uncertain").alias("n_uncertain"), F.sum("n").cast("long").alias("n_all"))


def first_per_qualified_name(hits: DataFrame) -> DataFrame:
    """Of each root's hits with one qualified name the first: certain ones first, then by path and offset."""
    first = F.min(F.struct("confidence", "path", "offset")).alias("first")
    return hits.groupBy("root", "qualified_name").agg(first).select("root", "qualified_name", "first.confidence", "first.path", "first.offset")


def matches_in_file(hits: DataFrame, files: DataFrame, open_projects: DataFrame) -> DataFrame:
    """Hits in files that exist and whose project is open."""
    return hits.join(files.select("project", "path").distinct(), ["project", "path"], "left_semi").join(open_projects.select("project").distinct(), "project", "left_semi")


def snippet(hits: DataFrame) -> DataFrame:
    """The trimmed line, the word's first place in it (-1 if absent), its length, the hit's own column, and a label."""
    text = F.trim("line")
    suffix = F.when(F.col("confidence") == "Uncertain", F.lit(" - Potential match")).otherwise(F.lit(""))
    return hits.select(
        "project",
        "path",
        "offset",
        F.concat(text, suffix).alias("label"),
        (F.instr(text, F.col("word")) - 1).cast("long").alias("highlight_start"),
        F.length("word").cast("long").alias("highlight_length"),
        (F.col("offset") - F.col("line_start")).cast("long").alias("hit_col"),
    )


def count_label(counts: DataFrame) -> DataFrame:
    name = F.coalesce("path", "project")
    return counts.select("project", "path", F.concat(name, F.lit(" ("), F.col("n_hits").cast("string"), F.lit(")")).alias("label"))


def hierarchy_label(nodes: DataFrame) -> DataFrame:
    """nodes(id, display_name, path, confidence): the name, with what is not known about it."""
    away = F.when(F.col("path").isNull(), F.lit(" - Not defined in project")).otherwise(F.lit(""))
    unsure = F.when(F.col("confidence") == "Uncertain", F.lit(" - Potential match")).otherwise(F.lit(""))
    return nodes.select("id", F.concat("display_name", away, unsure).alias("label"))


def occurrence_string(occ: DataFrame, files: DataFrame) -> DataFrame:
    """word in path at char offset kind; the path of a file that is gone is told as deleted."""
    listed = files.select("project", "path", F.lit(True).alias("there")).distinct()
    seen = occ.join(listed, ["project", "path"], "left")
    where = F.when(F.col("there"), F.col("path")).otherwise(F.lit("File is deleted"))
    return seen.select("project", "path", "offset", F.format_string("%s in %s at char %s %s", "word", where, F.col("offset").cast("string"), "kind").alias("shown"))
