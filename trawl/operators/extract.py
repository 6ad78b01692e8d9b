"""From texts to occurrences: one row per word with its offset, line, kind and position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trawl.operators.code import code_occurrences
from trawl.sources.tables import dealt_by_file, dealt_by_project

#: Words and gaps alternate and together cover every character.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
WORD = r"^[\p{L}\p{N}_]"
KEY = ("project", "path", "word", "offset", "kind", "is_super")


#: Stretches of a text: up to 16 words of one line with the gaps before them, to the line's end if only a gap is left there.
#: Together they cover every character, and a line break is only ever the last one.
STRETCH = r"(?:[^\p{L}\p{N}_\n]*+[\p{L}\p{N}_]++){1,16}+(?:[^\p{L}\p{N}_\n]*+\n)?|[^\p{L}\p{N}_\n]*+\n|[^\p{L}\p{N}_\n]++"


def _dealt(sources: DataFrame, by_project: bool = False) -> DataFrame:
    """Texts dealt by file before they are taken apart, so only they are shuffled, with the number of texts of their file."""
    own = Window.partitionBy("project", "path")
    deal = dealt_by_project if by_project else dealt_by_file
    return deal(sources.filter("content is not null")).withColumn("texts", F.count(F.lit(1)).over(own))


def _words(dealt: DataFrame) -> DataFrame:
    """Words with their place and the word before, in lower case. Only stretches are sorted; within one, a word's place
    follows from the few before it."""
    cut = dealt.select("project", "path", F.posexplode(F.regexp_extract_all("content", F.lit(STRETCH), F.lit(0))).alias("pos", "stretch"))
    words = F.regexp_extract_all("stretch", F.lit(r"[\p{L}\p{N}_]++"), F.lit(0))
    order = Window.partitionBy("project", "path").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.col("stretch").endswith("\n")
    sized = cut.select("*", F.length("stretch").alias("size"), F.lower(F.get(words, F.size(words) - 1)).alias("tail"))
    placed = sized.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))
    lined = placed.select(
        "project",
        "path",
        "stretch",
        "at",
        "tail",
        F.last("tail", ignorenulls=True).over(before).alias("led"),
        (1 + F.coalesce(F.sum(breaks.cast("int")).over(before), F.lit(0))).cast("long").alias("line_no"),
        F.coalesce(F.max(F.when(breaks, F.col("at") + F.col("size"))).over(before), F.lit(0)).cast("long").alias("line_start"),
    )
    upto = F.regexp_extract_all("stretch", F.lit(r"[^\p{L}\p{N}_]*+[\p{L}\p{N}_]++"), F.lit(0))
    told = lined.filter("tail is not null").select("project", "path", "at", "led", "line_no", "line_start", words.alias("words"), upto.alias("upto"))
    rows = told.select("*", F.posexplode_outer("words").alias("i", "word"))  # outer: none is empty, and no size is tested
    shift = F.length(F.array_join(F.slice("upto", F.lit(1), F.col("i") + 1), "")) - F.length("word")
    previous = F.when(F.col("i") > 0, F.lower(F.get("words", F.col("i") - 1))).otherwise(F.col("led"))
    return rows.select("project", "path", "word", (F.col("at") + shift).alias("offset"), previous.alias("previous"), "line_no", "line_start")


def _mixed_words(dealt: DataFrame) -> DataFrame:
    """As _words where several texts have one project and path: they are one file, their pieces in the order of their
    places, text by text. The window over a file is as large as that file."""
    cut = dealt.select("project", "path", F.posexplode(F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))).alias("pos", "piece"))
    order = Window.partitionBy("project", "path").orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("offset", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("long"))
    breaks = F.length("piece") - F.length(F.replace("piece", F.lit("\n"), F.lit("")))
    opens = F.when(breaks > 0, F.col("offset") + F.length("piece") - F.length(F.substring_index("piece", "\n", -1)))
    rows = placed.select(
        "project",
        "path",
        F.col("piece").alias("word"),
        "offset",
        F.lower(F.lag("piece", 2).over(order)).alias("previous"),
        (1 + F.coalesce(F.sum(breaks).over(before), F.lit(0))).cast("long").alias("line_no"),
        F.coalesce(F.max(opens).over(before), F.lit(0)).cast("long").alias("line_start"),
    )
    return rows.filter(F.col("word").rlike(WORD))


def extract_occurrences(sources: DataFrame, declares: tuple[str, ...] = ("the",), extends: tuple[str, ...] = ("of",), *, profile: str = "prose", by_project: bool = False) -> DataFrame:
    """project, path, word, offset (code points, from 0), kind, is_super, line_no (from 1), line_start.

    The profile `scala` reads source code (see code.code_occurrences). In prose a word declares if the word before it is one of `declares`, and stands in a super position if that is one of
    `extends`, in lower case. Null contents give no rows (see quarantine_failures). With by_project (prose only) a task's
    rows are of few projects, as store.append_occurrences asks for; the rows are the same.
    """
    if profile == "scala":
        return code_occurrences(sources)
    if profile != "prose":
        raise ValueError(f"no such profile: {profile}")
    dealt = _dealt(sources, by_project)
    rows = _words(dealt.filter("texts = 1")).unionByName(_mixed_words(dealt.filter("texts > 1")))
    previous = F.col("previous")
    return rows.select(
        "project",
        "path",
        "word",
        "offset",
        F.when(previous.isin(*declares), "Declaration").otherwise("Reference").alias("kind"),
        F.coalesce(previous.isin(*extends), F.lit(False)).alias("is_super"),
        "line_no",
        "line_start",
    )


def line_table(sources: DataFrame) -> DataFrame:
    """project, path, line_no, line_start, line: joined to hits when they are shown, never carried by every word."""
    cut = dealt_by_file(sources).select("project", "path", F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    before = Window.partitionBy("project", "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return cut.select("project", "path", (F.col("pos") + 1).cast("long").alias("line_no"), start.alias("line_start"), "line")


def with_lines(hits: DataFrame, lines: DataFrame) -> DataFrame:
    return hits.join(lines.select("project", "path", "line_no", "line"), ["project", "path", "line_no"])


def quarantine_failures(sources: DataFrame) -> DataFrame:
    """A row per file: characters, characters covered by pieces, words, and a reason where the file is set aside."""
    cut = F.regexp_extract_all("content", F.lit(PIECE), F.lit(0))
    covered = F.aggregate(cut, F.lit(0), lambda n, p: n + F.length(p))
    rows = sources.select("project", "path", F.length("content").alias("n"), covered.alias("c"), F.size(F.filter(cut, lambda p: p.rlike(WORD))).alias("w"))
    reason = F.when(F.col("n").isNull(), "missing").when(F.col("n") != F.col("c"), "not covered").otherwise("")
    return rows.select("project", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n_chars"), F.coalesce("c", F.lit(0)).cast("long").alias("n_covered"), F.greatest("w", F.lit(0)).cast("long").alias("n_words"), reason.alias("reason"))
