"""Change events: what they mean, what is left of them, and what they do to the occurrence table.

The functions work on a batch; `maintain_stream` runs the same ones on each micro-batch of a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trawl.operators.maintain import delete_file_occurrences, upsert_files

FILE_KINDS = {"signup": "ADDED", "click": "CHANGED", "view": "CHANGED", "error": "REMOVED"}
PROJECT_KINDS = {"signup": "OPEN", "error": "CLOSE", "purchase": "DELETE"}


def _mapped(column: str, kinds: dict[str, str]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col(column))


def file_change_stream(events: DataFrame) -> DataFrame:
    """seq, ts, file_id, kind of the events that are about files."""
    return events.select(F.col("event_id").alias("seq"), "ts", F.col("user_id").alias("file_id"), _mapped("event_type", FILE_KINDS).alias("kind")).filter("kind is not null")


def gate_indexable(changes: DataFrame, indexable: DataFrame) -> DataFrame:
    """Additions and changes of indexable files, and every removal."""
    known = indexable.select("file_id", F.lit(True).alias("there")).distinct()
    seen = changes.join(known, "file_id", "left")
    return seen.filter((F.col("kind") == "REMOVED") | F.col("there")).select("seq", "ts", "file_id", "kind")


def collapse_events(changes: DataFrame) -> DataFrame:
    """The last event of each file by time and number: an update reads the current text, so earlier ones don't matter."""
    return changes.groupBy("file_id").agg(F.max_by("kind", F.struct("ts", "seq")).alias("kind"))


def project_state(events: DataFrame) -> DataFrame:
    """Per project the last event that opens, closes or deletes it, and whether it is being indexed."""
    kinds = events.select("event_id", "ts", F.col("user_id").alias("project"), _mapped("event_type", PROJECT_KINDS).alias("kind")).filter("kind is not null")
    last = kinds.groupBy("project").agg(F.max_by("kind", F.struct("ts", "event_id")).alias("last_kind"))
    return last.select("project", "last_kind", (F.col("last_kind") == "OPEN").alias("is_indexed"))


def maintain(occ: DataFrame, changes: DataFrame, sources: DataFrame) -> DataFrame:
    """The table after the changes: removed files without rows, added and changed ones with those of their current text.

    sources(file_id, project, path, content) are the current files. A change to a file that is gone removes its rows.
    Changes that were applied already change nothing when they come again.
    """
    last = collapse_events(changes)
    touched = sources.join(last.select("file_id", "kind"), "file_id")
    current = touched.filter("kind <> 'REMOVED'").select("project", "path", "content")
    return upsert_files(delete_file_occurrences(occ, touched.filter("kind = 'REMOVED'").select("project", "path")), current)


def maintain_stream(changes: DataFrame, load: Callable[[], DataFrame], sources: Callable[[], DataFrame], store: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Applies each micro-batch of changes to the table that load() gives and hands the new state to store()."""

    def apply(batch: DataFrame, number: int) -> None:
        store(maintain(load(), batch, sources()), number)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
