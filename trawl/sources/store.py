"""The occurrence table in storage: Parquet, a partition for each project.

Besides occurrences each partition holds a mark, a row without a word whose kind is `built` or `dropped`. A project is replaced
by dynamic partition overwrite, which leaves partitions without new rows as they are; the mark sees to it that a project
that lost all its words is replaced too, and tells an indexed project without words from one without an index. No list of
projects comes to the driver. Writes replace project by project: a reader may see some projects old and some new.

The empty project name and null are one partition, read as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.operators.extract import extract_occurrences
from trawl.operators.maintain import upsert_files
from trawl.sources.tables import cut_lineage

ROW = "path string, word string, offset long, kind string, is_super boolean, line_no long, line_start long"
COLUMNS = [c.split()[0] for c in ROW.split(", ")]
#: Projects that a task writes at once without sorting its rows.
WRITERS = 32
#: A file's rows stand in the order of their places, so offsets are kept as differences; small row groups spare the memory of
#: tasks that write many projects.
FILES = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#offset": "false", "parquet.block.size": str(16 << 20)}
#: Bytes of keys that are sent to all executors; with more, words and keys meet in a shuffle.
LISTED = 128 << 20


def _marks(projects: DataFrame, kind: str) -> DataFrame:
    own = projects.select("project").distinct()
    return own.selectExpr("project", *(f"cast({repr(kind) if c.split()[0] == 'kind' else 'null'} as {c.split()[1]}) as {c.split()[0]}" for c in ROW.split(", ")))


@contextmanager
def _settings(session: SparkSession, **new: str) -> Iterator[None]:
    before = {key: session.conf.get(key, None) for key in new}
    try:
        for key, value in new.items():
            session.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            session.conf.unset(key) if value is None else session.conf.set(key, value)


def _write(rows: DataFrame, path: str, mode: str, *, by_project: bool = False) -> None:
    """Rows that tasks hold by project go from where they are to a file a task and project, neither shuffled nor sorted;
    projects beyond WRITERS in one task are sorted. Other rows are dealt by project before. What was shuffled for a write is
    deleted when it ends."""
    dealt = rows.select("project", *COLUMNS)
    if not by_project:
        # rebalance: a small project is one file, a large one is split by size (adaptive execution)
        dealt = dealt.hint("rebalance", "project")
    with _settings(rows.sparkSession, **{"spark.sql.maxConcurrentOutputFileWriters": str(WRITERS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        dealt.write.mode(mode).options(**FILES).option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROW}, project string").parquet(path).select("project", *COLUMNS)


def read_occurrences(spark: SparkSession, path: str) -> DataFrame:
    """The occurrences. A filter on project reads the partitions of those projects alone."""
    return _stored(spark, path).filter("word is not null")


def indexed_projects(spark: SparkSession, path: str) -> DataFrame:
    """Projects that were written and not dropped since, those without words among them."""
    return _stored(spark, path).filter("word is null and kind = 'built'").select("project").distinct()


def listed(keys: DataFrame) -> tuple[DataFrame, bool]:
    """The different keys, made once, as rows to join with, and whether they go to all executors, so that what they are joined
    to stays where it is. How much they are is only known once they are there."""
    own = cut_lineage(keys.distinct())  # not cached: of plans over a cache Spark does not share shuffles
    size = F.lit(64)  # a row's own
    for c in own.columns:
        size = size + F.coalesce(F.octet_length(c), F.lit(0))
    few = (own.agg(F.sum(size.cast("long"))).first()[0] or 0) <= LISTED
    return (F.broadcast(own), True) if few else (own.hint("shuffle_hash"), False)


def append_occurrences(occ: DataFrame, path: str, *, by_project: bool = False) -> None:
    """Adds rows; rows that are appended twice stand twice (see upsert_stored). What is stored tells which projects have
    words but no mark yet, so the rows are made once; a project is not indexed before that second write. by_project: the rows come from extract_occurrences(by_project=True) and are not shuffled."""
    _write(occ, path, "append", by_project=by_project)
    held = _stored(occ.sparkSession, path).groupBy("project").agg(F.max(F.col("word").isNotNull()).alias("has_words"), F.max(F.col("word").isNull() & (F.col("kind") == "built")).alias("is_built"))
    _write(_marks(held.filter("has_words and not coalesce(is_built, false)"), "built"), path, "append")


def rebuild_stored(sources: DataFrame, projects: DataFrame, path: str) -> None:
    """All files of the projects extracted anew in place of what was stored for them; other projects are not read."""
    own, _ = listed(projects.select("project"))
    fresh = extract_occurrences(sources.join(own, "project", "left_semi"), by_project=True)
    _write(fresh.unionByName(_marks(own, "built")), path, "overwrite", by_project=True)


def upsert_stored(spark: SparkSession, changed: DataFrame, path: str) -> None:
    """Replaces the rows of the changed files; their projects' partitions are read and written, no other. Stored rows stay in
    the tasks that read them, unless the names of the changed files are more than LISTED bytes."""
    files = changed.select("project", "path", "content")
    own, _ = listed(files.select("project"))
    gone, few = listed(files.select("project", "path"))
    old = read_occurrences(spark, path).join(own, "project", "left_semi")
    now = upsert_files(old, files, gone=gone, by_project=True)
    _write(now.unionByName(_marks(own, "built")), path, "overwrite", by_project=few)


def drop_stored(spark: SparkSession, projects: DataFrame, path: str) -> None:
    """Empties the partitions of those projects that are indexed; others stay without one."""
    _write(_marks(projects.join(indexed_projects(spark, path), "project", "left_semi"), "dropped"), path, "overwrite")
