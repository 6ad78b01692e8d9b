"""Reading of tables and of source files, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks that take texts apart for each task of a shuffle: rows of words are many times the text and stay where they are
#: made, so that a task's share of them, not of the text, has to fit its memory.
SHARES = 4


def dealt_by_file(sources: DataFrame) -> DataFrame:
    """Files dealt to a number of tasks that follows from that of a shuffle here. The number is given so that it stays: texts
    are small next to what is made of them, and adaptive execution would join their partitions by the size of the texts."""
    return sources.repartition(SHARES * int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "path")


def dealt_by_project(sources: DataFrame) -> DataFrame:
    """As dealt_by_file, but by ranges of project and path: a task has few projects, a large project many tasks, and a
    file's texts are in one task all the same. What tasks make of them can be written project by project as it is."""
    return sources.repartitionByRange(SHARES * int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project", "path")


def scan_sources(spark: SparkSession, root: str, project: str, extension: str = "scala") -> DataFrame:
    """Files under root with the extension, a row each: project, path, content. Spark's file sources skip empty files."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    return files.select(F.lit(project).alias("project"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def unreadable_files(spark: SparkSession, root: str, project: str, extension: str = "scala") -> DataFrame:
    """project, path, reason of the files under root whose bytes are not UTF-8: scan_sources reads them with replacement
    characters, so they are to be set aside before."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(root)
    broken = files.filter(~F.is_valid_utf8(F.col("content").cast("string")))
    return broken.select(F.lit(project).alias("project"), "path", F.lit("not UTF-8").alias("reason"))


def shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder the cluster names. Where none is named, a local session takes a folder of this machine,
    and any other fails: its executors would not see that folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "trawl-checkpoints"))


def shared_folder(spark: SparkSession, what: str) -> str:
    """The name of a new folder that driver and executors share."""
    shared_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: reads of it survive lost executors."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)
