"""What keeps the work of occurrence queries in proportion to the input: no word is sorted or shuffled by itself."""

import io
import re
from contextlib import contextmanager, redirect_stdout

from pyspark.sql import functions as F

from trawl.operators import extract, maintain
from trawl.sources import store, tables

ROWS = [
    ("p", "long", "The " + "one, of  two " * 40 + "\n\n  \nOF x" + " y" * 16 + "\n" + "z " * 17 + "\n, the\nÜber_3 of  it"),
    ("p", "gap", " ... "),
    ("p", "none", ""),
    ("p", "null", None),
    ("q", "breaks", "\n\na\n"),
    (None, "long", "the one of two"),
]


def sources(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, content string")


@contextmanager
def without_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    yield
    for key in keys:
        spark.conf.unset(key)


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_words_of_stretches_are_those_of_pieces(spark):
    """only stretches of a text are sorted."""
    got = extract._words(extract._dealt(sources(spark, ROWS)))
    want = extract._mixed_words(extract._dealt(sources(spark, ROWS)))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    text = ROWS[0][2]
    found = [(r.offset, r.word) for r in got.filter("project = 'p' and path = 'long'").orderBy("offset").collect()]
    assert found == [(m.start(), m.group()) for m in re.finditer(r"\w+", text)]


def test_several_texts_of_one_file_are_mixed_as_before(spark):
    rows = extract.extract_occurrences(sources(spark, [("p", "a", "of x\ny")] * 2 + [("p", "b", "of x")])).collect()
    assert sorted((r.path, r.word, r.offset, r.is_super, r.line_no, r.line_start) for r in rows) == [
        ("a", "of", 0, False, 1, 0),
        ("a", "of", 2, False, 1, 0),
        ("a", "x", 6, False, 1, 0),
        ("a", "x", 7, False, 1, 0),
        ("a", "y", 10, False, 3, 10),
        ("a", "y", 11, False, 3, 10),
        ("b", "of", 0, False, 1, 0),
        ("b", "x", 3, True, 1, 0),
    ]


def test_texts_are_dealt_to_more_tasks_than_a_shuffle_has(spark):
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert extract.extract_occurrences(sources(spark, ROWS)).rdd.getNumPartitions() == tables.SHARES * shuffle > shuffle


def test_audit_joins_lines_where_the_words_are(spark):
    """neither words nor keys are dealt anew."""
    src = sources(spark, ROWS)
    with without_broadcast(spark):
        audit = maintain.audit_occurrences(extract.extract_occurrences(src), extract.line_table(src))
        told = plan(audit)
    assert "line_no" not in "".join(re.findall(r"hashpartitioning\([^)]*\)", told)) and "SortMergeJoin" not in told
    assert {(r.project, r.n_rows, r.n_astray, r.is_clean) for r in audit.collect()} == {("p", 160, 0, True), ("q", 1, 0, True), (None, 4, 4, False)}


def test_audit_counts_a_word_for_each_line_of_its_number(spark):
    occ = extract.extract_occurrences(sources(spark, [("p", "a", "x\ny")]))
    lines = spark.createDataFrame([("p", "a", 5, "far"), ("p", "a", 2, "y"), ("p", "a", 2, "no"), ("p", "a", 1, "x"), ("q", "a", 1, "x")], "project string, path string, line_no long, line string")
    assert maintain.audit_occurrences(occ, lines).collect() == [("p", 3, 0, 1, 2, False)]
    assert maintain.audit_occurrences(occ, lines.filter("line_no <> 1")).collect() == [("p", 3, 0, 1, 3, False)]
    assert maintain.audit_occurrences(occ, lines.filter("line_no <> 2")).collect() == [("p", 2, 0, 0, 1, False)]


def test_appended_rows_are_made_once(spark, tmp_path):
    """F1, F6, F7."""
    made = spark.sparkContext.accumulator(0)

    def seen(word):
        made.add(1)
        return True

    rows = [("p", "a", "w", i, "Reference", False, 1, 0) for i in range(10)] + [("q", "b", "w", 0, "Reference", False, 1, 0)]
    occ = spark.createDataFrame(rows, "project string, path string, word string, offset long, kind string, is_super boolean, line_no long, line_start long")
    path = str(tmp_path / "occ")
    for turn in (1, 2):
        store.append_occurrences(occ.filter(F.udf(seen, "boolean")("word")), path)
        assert made.value == 11 * turn
        assert {r.project for r in store.indexed_projects(spark, path).collect()} == {"p", "q"}
        assert store.read_occurrences(spark, path).count() == 11 * turn


def test_records_are_judged_in_one_pass(spark):
    """F8: one frame with the outcomes that the three frames tell apart, from one reading of the records."""
    schema = "word string, path string, offset string, kind string, project string, is_super string"
    good, gone, bad = ("w", "a", "3", "Reference", "p", "true"), ("w", "z", "3", "Reference", "p", "false"), ("w", "a", "x3", "Reference", "p", "true")
    records = spark.createDataFrame([good, good, gone, bad, ("w", None, "3", "Reference", "p", "true"), ("w", "z", "3", "Other", "p", "true")], schema)
    files = spark.createDataFrame([("p", "a")] * 2, "project string, path string")
    judged = maintain.ingest_records(records, files, apart=False)
    assert sorted((r.outcome, r.path or "", r.number or -1) for r in judged.collect()) == [("good", "a", 3)] * 2 + [("invalid", "", 3), ("invalid", "a", -1), ("invalid", "z", 3), ("missing", "z", 3)]
    apart = dict(zip(("good", "invalid", "missing"), maintain.ingest_records(records, files), strict=True))
    assert {k: x.count() for k, x in apart.items()} == {"good": 2, "invalid": 3, "missing": 1}
    assert apart["invalid"].columns == apart["missing"].columns == records.columns
