"""A Merkle manifest of a dataset: a digest of every row, a tree over each branch, one root over all branches.

Slot pivot: the FANOUT children of a parent are spread into columns by conditional aggregates on their place modulo
FANOUT. The columns in a row are what the parent hashes; the same without one's own column are that child's siblings.
Trees are built upwards one grouping a level, siblings come down one join a level, and every level is a table of its own
in the shared folder. A branch of one node passes through the levels above unhashed, so all branches share one depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.llm.common import cut_lineage, remainder

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """H: lowercase hex sha256 of the parts in a row."""
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def leaf(text: Column | None = None) -> Column:
    """The digest of a row's fields, each as byte count, colon and value, null as a dash; text may be another column."""
    fields = []
    for name in FIELDS:
        value = (text if name == "text" and text is not None else F.col(name)).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest(*fields)


def tampered(docs: DataFrame) -> Column:
    """The text in lower case (A-Z only) where 3 divides the crc32 of doc_id; null where nothing is changed."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(remainder(F.col("doc_id"), 3) == 0, leaf(lowered))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds place, from 0 in the given order within each branch, and size, the number of the branch's rows.

    Rows are dealt by ranges, so a branch of any size spreads; a row's place is its place in its range and the number of
    its branch's rows in the ranges before, of which there is one line a range and branch.
    """
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    ranges = dealt.repartitionByRange("branch", *order, "tie").sortWithinPartitions("branch", *order, "tie").drop("tie")
    numbered = cut_lineage(ranges.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    counts = numbered.groupBy("branch", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("branch").orderBy("range")
    heads = counts.select(
        "branch",
        "range",
        (F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(Window.partitionBy("branch")).alias("size"),
    )
    return numbered.join(heads, ["branch", "range"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _slots() -> list[str]:
    return [f"s{i}" for i in range(FANOUT)]


def _pivot(nodes: DataFrame) -> DataFrame:
    """A row a parent: branch, place and size one level up, children in the columns s0, s1, ..., and the parent's node."""
    slot = F.col("place") % FANOUT
    child = F.col("node")
    spread = [F.max(F.when(slot == i, child)).alias(s) for i, s in enumerate(_slots())]
    up = nodes.groupBy("branch", F.floor(F.col("place") / FANOUT).alias("parent")).agg(*spread, F.max("size").alias("size"))
    held = digest(*[F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in _slots()])
    alone = F.col("size") == 1
    return up.select(
        "branch",
        F.col("parent").alias("place"),
        *_slots(),
        alone.alias("alone"),
        F.ceil(F.col("size") / FANOUT).alias("size"),
        F.struct(F.when(alone, F.col("s0.digest")).otherwise(held).alias("digest")).alias("node"),
    )


def _children(parents: DataFrame) -> DataFrame:
    """A row a child: branch, place, node, path and whatever else the parents carry in `top`.

    path has, level by level upwards, the siblings left and right of the way; a node alone in its branch adds none.
    """
    texts = [F.coalesce(F.col(f"{s}.digest"), F.lit("")) for s in _slots()]
    options = []
    for i, s in enumerate(_slots()):
        step = F.struct(F.concat(F.lit(""), *texts[:i]).alias("left"), F.concat(F.lit(""), *texts[i + 1 :]).alias("right"))
        path = F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(step), F.col("path")))
        options.append(F.struct((F.col("place") * FANOUT + i).alias("place"), F.col(s).alias("node"), path.alias("path")))
    return parents.select("branch", "top", F.explode(F.array(*options)).alias("child")).select("branch", "top", "child.*").filter("node is not null")


def _grow(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The top nodes of all branches, and the tables of parents from the leaves upwards, one at least."""
    levels, most = [], 2
    while most > 1:
        levels.append(cut_lineage(_pivot(nodes)))
        nodes = levels[-1].select("branch", "place", "size", "node")
        most = nodes.agg(F.max("size")).first()[0] or 1
    return nodes, levels


def _descend(tops: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """From tops(branch, place, top, path) down to the leaves: branch, place, node, top, path."""
    ways = tops
    for level in reversed(levels):
        ways = _children(level.join(ways.select("branch", "place", "top", "path"), ["branch", "place"]))
    return ways


NO_PATH = "cast(array() as array<struct<left: string, right: string>>)"


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, place, leaf, changed, subroot, root and path of every row; branches are the values of lang.

    path holds the siblings left and right at every level up to the root. Null lang is a branch of its own and comes
    first; rows of one doc_id, and of null doc_id (first), go by their leaf; repeated rows are leaves each. changed is
    the leaf of the tampered text, null where the row is not tampered with. Texts of any length are read once; an empty
    table gives no rows; only the named columns are read, others may have any name.
    """
    branch = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = cut_lineage(docs.select("doc_id", branch.alias("branch"), leaf().alias("digest"), tampered(docs).alias("changed")))
    leaves = placed(rows, ["doc_id", "digest"]).select("branch", "place", "size", F.struct("digest", "doc_id", "changed").alias("node"))
    tops, levels = _grow(leaves)
    subroots = tops.select(F.lit("").alias("branch"), F.col("branch").alias("name"), F.col("node.digest").alias("digest"))
    root, above = _grow(placed(subroots, ["name"]).select("branch", "place", "size", F.struct("digest", "name").alias("node")))
    whole = root.select("branch", "place", F.struct(F.col("node.digest").alias("root")).alias("top"), F.expr(NO_PATH).alias("path"))
    ends = _descend(whole, above).select(
        F.col("node.name").alias("branch"), F.lit(0).cast("long").alias("place"), F.struct("top.root", F.col("node.digest").alias("subroot")).alias("top"), "path"
    )
    found = _descend(ends, levels)
    return found.select("node.doc_id", F.when(F.col("branch") != "", F.substring("branch", 2, 1 << 30)).alias("lang"), "place", F.col("node.digest").alias("leaf"), "node.changed", "top.subroot", "top.root", "path")


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, start, lambda held, step: digest(step["left"], held, step["right"]))


def verify(rows: DataFrame) -> DataFrame:
    """Rows of a manifest with proof_sha256, folded_root (of the changed leaf where there is one) and verified."""
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    shown = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle_level(n: int, source: str) -> str:
    """A level up: parents of the nodes of `source`, and every node's siblings."""
    return f"""
{source}up{n} AS (SELECT branch, place // 8 AS place, any_value(ceil(size / 8.0)::BIGINT) AS size,
  CASE WHEN any_value(size) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest FROM {source}at{n} GROUP BY branch, place // 8),
{source}side{n} AS (SELECT a.branch, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS lft,
  coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS rgt, any_value(a.size) = 1 AS alone
  FROM {source}at{n} a JOIN {source}at{n} b ON a.branch = b.branch AND a.place // 8 = b.place // 8 GROUP BY a.branch, a.place),
{source}at{n + 1} AS (SELECT * FROM {source}up{n}),"""


def oracle(levels: int = 7, over: int = 3) -> str:
    """DuckDB SQL for verify(manifest(documents)); good for 8 ** levels rows a branch and 8 ** over branches."""
    crc = "[4294967295::BIGINT] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)"
    bit = "list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, o: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)"
    field = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"
    fields = lambda text: "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""WITH own AS (SELECT doc_id, coalesce('=' || lang, '') AS branch, {fields("text")} AS digest,
  CASE WHEN xor(list_reduce({crc}, lambda c, b: {bit}), 4294967295::BIGINT) % 3 = 0 THEN {fields(lower)} END AS changed FROM documents),
leafs AS (SELECT *, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY branch) AS size FROM own),
at0 AS (SELECT branch, place, size, digest FROM leafs),"""
    sql += "".join(_oracle_level(n, "") for n in range(levels))
    sql += f"subroots AS (SELECT branch, digest AS subroot, row_number() OVER (ORDER BY branch) - 1 AS place FROM at{levels}),"
    sql += "topat0 AS (SELECT 0 AS branch, place, count(*) OVER () AS size, subroot AS digest FROM subroots),"
    sql += "".join(_oracle_level(n, "top") for n in range(over))
    steps = [("", n, f"l.place // {8**n}", "l.branch") for n in range(levels)] + [("top", n, f"s.place // {8**n}", "0") for n in range(over)]
    joins = "\n".join(f"JOIN {t}side{n} {t or 'own'}{n} ON {t or 'own'}{n}.branch = {b} AND {t or 'own'}{n}.place = {p}" for t, n, p, b in steps)
    names = [f"{t or 'own'}{n}" for t, n, _, _ in steps]
    path = ", ".join(f"{{'l': {x}.lft, 'r': {x}.rgt, 'alone': {x}.alone}}" for x in names)
    sql += f"""found AS (SELECT l.doc_id, l.digest AS leaf, l.changed, s.subroot, r.digest AS root, list_filter([{path}], lambda x: NOT x.alone) AS path
  FROM leafs l JOIN subroots s ON s.branch = l.branch JOIN topat{over} r ON true {joins})
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM (SELECT *, list_reduce([{{'l': '', 'h': coalesce(changed, leaf), 'r': ''}}] || list_transform(path, lambda x: {{'l': x.l, 'h': '', 'r': x.r}}),
  lambda a, x: {{'l': '', 'h': sha256(x.l || a.h || x.r), 'r': ''}}).h AS folded_root FROM found)"""
    return sql
