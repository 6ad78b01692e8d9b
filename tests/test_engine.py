"""Cases that the given tables do not hold: long chains, cycles, branches of the naming rules, streams, plans."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trawl.functions import names
from trawl.operators import extract, graph, maintain, resolve, results, search
from trawl.plans import bindings
from trawl.streaming import events as ev

DATA = "/root/testdata/sf0.001"


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "project string, path string, content string")


def test_words_stand_at_their_offsets(spark):
    text = "The one\nof the two, and\n\nthe Übergröße of_x 3"
    rows = extract.extract_occurrences(sources(spark, ("p", "a", text), ("p", "b", None), ("p", "c", ""))).toPandas()
    assert all(text[r.offset : r.offset + len(r.word)] == r.word for r in rows.itertuples())
    assert all(text[r.line_start :].split("\n")[0] == text.split("\n")[r.line_no - 1] for r in rows.itertuples())
    assert set(rows[rows.kind == "Declaration"].word) == {"one", "two", "Übergröße"}
    assert set(rows[rows.is_super].word) == {"the"}


def test_missing_files_are_set_aside(spark):
    rows = {r.path: r for r in extract.quarantine_failures(sources(spark, ("p", "a", "x y"), ("p", "b", None))).collect()}
    assert (rows["a"].reason, rows["a"].n_words) == ("", 2)
    assert (rows["b"].reason, rows["b"].n_words) == ("missing", 0)


def test_decode_name(spark):
    got = spark.createDataFrame([("$colon$colon",), ("a_$eq",), ("plain",)], "n string").select(names.decode_name(F.col("n")).alias("n"))
    assert [r.n for r in got.collect()] == ["::", "a_=", "plain"]


def test_empty_word_list_finds_nothing(spark):
    occ = extract.extract_occurrences(sources(spark, ("p", "a", "one two")))
    assert search.find_any(occ, spark.createDataFrame([], "word string")).count() == 0


def test_failures_name_projects_without_an_index(spark):
    occ = extract.extract_occurrences(sources(spark, ("p", "a", "one two one")))
    scope = spark.createDataFrame([("p",), ("q",)], "project string")
    hits, failures = search.search_with_failures(occ, scope, word="one")
    assert hits.count() == 2
    assert [r.project for r in failures.collect()] == ["q"]


def test_upsert_twice_is_upsert_once(spark):
    old = extract.extract_occurrences(sources(spark, ("p", "a", "one"), ("p", "b", "two")))
    new = sources(spark, ("p", "a", "three four"))
    once = maintain.upsert_files(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, maintain.upsert_files(once, new).collect()))
    assert {r.word for r in once.collect()} == {"two", "three", "four"}


def test_records_round_trip(spark):
    occ = extract.extract_occurrences(sources(spark, ("p", "a", "the one of two")))
    records = maintain.export_records(occ)
    files = spark.createDataFrame([("p", "a")], "project string, path string")
    good, invalid, missing = maintain.ingest_records(records, files)
    key = list(extract.KEY)
    assert sorted(map(tuple, good.select(*key).collect())) == sorted(map(tuple, occ.select(*key).collect()))
    assert invalid.count() == missing.count() == 0
    bad = records.withColumn("offset", F.lit("x"))
    assert [x.count() for x in maintain.ingest_records(bad, files)] == [0, 4, 0]
    assert [x.count() for x in maintain.ingest_records(records, files.limit(0))] == [0, 0, 4]


def test_long_chain_and_closed_project(spark):
    n = 1000
    projects = spark.createDataFrame([(i, i != 400) for i in range(n)], "project long, is_open boolean")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    got = {r.project: r.component for r in graph.project_closure(projects, edges).collect()}
    assert got == {i: 0 if i < 400 else 401 for i in range(n) if i != 400}


def test_hierarchy_with_a_cycle_ends(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r.id, r.depth, r.is_leaf) for r in graph.type_hierarchy(spark.createDataFrame([(1,)], "id long"), edges).collect()}
    assert got == {(1, 0, False), (2, 1, False), (3, 2, False), (4, 3, True)}


def test_every_kind_and_name_form_occurs(spark):
    kinds = {r.kind for r in bindings.symbols(spark, DATA).select("kind").distinct().collect()}
    assert kinds == {"interface", "trait", "abstract class", "class", "module", "type", "method", "val", "var", "unknown"}


@pytest.mark.parametrize(
    ("qualified", "display", "long"),
    [("a.b.C", "C", "a.b.C"), ("a.B.type", "B", "a.B"), ("a.Map[x.Y,z.W]", "Map[x.Y,z.W]", "a.Map[x.Y,z.W]"), ("Alone", "Alone", "Alone"), ("a.F[b.G.type]", "F[b.G.type]", "a.F[b.G.type]")],
)
def test_display_names(spark, qualified, display, long):
    row = spark.createDataFrame([(qualified,)], "q string").select(names.display_name(F.col("q")).alias("d"), names.long_display_name(F.col("q")).alias("l")).first()
    assert (row.d, row.l) == (display, long)


def symbol(name="x", owner="A", signature="Int", kind="method", accessor="", is_local=False, getter=None, setter=None):
    return (name, owner, signature, kind, accessor, is_local, getter, setter)


COLUMNS = "name string, owner string, signature string, kind string, accessor string, is_local boolean, getter string, setter string"
SET = "(Int)Unit"
VAR = {"kind": "var", "getter": "Int", "setter": SET}
GETTER = {"accessor": "getter", "getter": "Int", "setter": SET}
SETTER = {"name": "x_=", "signature": SET, "accessor": "setter", "getter": "Int", "setter": SET}


@pytest.mark.parametrize(
    ("entity", "mention", "resolved", "verdict"),
    [
        (symbol(), symbol(), True, "Same"),
        (symbol(), symbol(), False, "PossiblySame"),
        (symbol(), symbol(owner="B"), True, "Same"),  # B is kin of A
        (symbol(), symbol(owner="C"), True, "NotSame"),
        (symbol(), symbol(signature="String"), True, "NotSame"),
        (symbol(is_local=True), symbol(owner="B"), True, "NotSame"),
        (symbol(is_local=True), symbol(is_local=True), True, "Same"),
        (symbol(kind="val", name="x ", getter="Int"), symbol(kind="class"), True, "NotSame"),
        (symbol(kind="class"), symbol(kind="class"), True, "Same"),
        # a value, its getter and its setter in all pairings
        *((symbol(**a), symbol(**b), True, "Same") for a in (VAR, GETTER, SETTER) for b in (VAR, GETTER, SETTER)),
        # a value and methods of its hierarchy: the setter by a setter's name, else the getter
        (symbol(**VAR), symbol(name="x_=", owner="B", signature=SET), True, "Same"),
        (symbol(**VAR), symbol(name="x_=", owner="B", signature="(String)Unit"), True, "NotSame"),
        (symbol(**VAR), symbol(owner="B"), True, "Same"),
        (symbol(**VAR), symbol(owner="B", signature=SET), True, "NotSame"),
        (symbol(name="x_=", signature=SET), symbol(owner="B", **VAR), True, "Same"),
        (symbol(), symbol(owner="B", **VAR), True, "Same"),
        (symbol(), symbol(kind="val", owner="B", getter="Int"), True, "Same"),
        (symbol(name="x_=", signature=SET), symbol(kind="val", owner="B", getter="Int"), True, "NotSame"),  # a val has no setter
        # methods of different names are not the same, whatever their signatures
        (symbol(name="x_=", signature=SET), symbol(name="x", signature=SET), True, "NotSame"),
        # this.type: signatures differ, but one overrides the other
        (symbol(signature="A.this.type"), symbol(owner="B", signature="B.this.type"), True, "Same"),
        (symbol(signature="A.this.type"), symbol(owner="C", signature="B.this.type"), True, "NotSame"),
        (symbol(signature="B.this.type"), symbol(owner="B", signature="A.this.type"), True, "NotSame"),
    ],
)
def test_comparison_rules(spark, entity, mention, resolved, verdict):
    kin = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A"), ("B", "B"), ("C", "C")], "a string, b string")
    pairs = [("x", "A", "A.this.type", "B", "B.this.type"), ("x", "B", "B.this.type", "A", "A.this.type")]
    overrides = spark.createDataFrame(pairs, "name string, a_owner string, a_signature string, b_owner string, b_signature string")
    e = spark.createDataFrame([(*entity, 1)], COLUMNS + ", n_symbols long")
    m = spark.createDataFrame([(*mention, resolved, 1)], COLUMNS + ", resolved boolean, n long")
    assert [r.verdict for r in resolve.compare_symbols(e, m, kin, overrides).collect()] == [verdict]


def test_accessors_are_paired_by_field(spark):
    rows = [("f1", "", "Int", "var"), ("f1", "getter", "=> Int", "method"), ("f1", "setter", "(x: Int)Unit", "method"), ("f2", "", "Int", "var"), ("f3", "", "Int", "val"), (None, "", "Int", "method")]
    got = resolve.with_accessors(spark.createDataFrame(rows, "field_id string, accessor string, signature string, kind string"))
    assert {(r.field_id, r.getter, r.setter) for r in got.collect()} == {("f1", "=> Int", "(x: Int)Unit"), ("f2", "Int", SET), ("f3", "Int", None), (None, None, None)}


def references(spark, symbols, asked, occ, refs):
    known = spark.createDataFrame([(i, *s) for i, s in symbols.items()], "symbol_id string, " + COLUMNS)
    entities = known.filter(F.col("symbol_id").isin(*asked)).withColumnRenamed("symbol_id", "entity")
    owners = spark.createDataFrame([("A", "A"), ("ObjectA", "ObjectA"), ("B", "B")], "a string, b string")
    occ = spark.createDataFrame(occ, "project string, path string, word string, offset long")
    refs = spark.createDataFrame(refs, "project string, path string, offset long, symbol_id string")
    return sorted((r.entity, r.path, r.offset, r.confidence) for r in resolve.find_references(entities, occ, refs, known, owners).collect())


def test_references_of_apply(spark):
    symbols = {"a": symbol("apply", "ObjectA"), "o": symbol("apply", "B")}
    occ = [("p", "A", "apply", 9), ("p", "B", "ObjectA", 3), ("p", "B", "ObjectA", 30), ("p", "B", "apply", 38), ("q", "C", "apply", 1), ("q", "C", "other", 7)]
    refs = [("p", "A", 9, "a"), ("p", "B", 3, "a"), ("p", "B", 38, "a"), ("q", "C", 1, "o")]
    # the name before .apply stands for the object itself: not resolved here, so it is told as uncertain
    assert references(spark, symbols, ["a"], occ, refs) == [("a", "A", 9, "Certain"), ("a", "B", 3, "Certain"), ("a", "B", 30, "Uncertain"), ("a", "B", 38, "Certain")]


def test_references_of_a_variable_by_its_setter(spark):
    symbols = {"v": symbol("variable", **VAR), "s": symbol(**{**SETTER, "name": "variable_="}), "l": symbol("variable", "B", kind="val", getter="Int")}
    occ = [("p", "A", "variable", 4), ("p", "B", "variable_=", 8), ("q", "C", "variable", 2), ("q", "C", "variable", 20)]
    refs = [("p", "A", 4, "v"), ("p", "B", 8, "s"), ("q", "C", 2, "l")]
    hits = [("A", 4, "Certain"), ("B", 8, "Certain"), ("C", 20, "Uncertain")]
    assert references(spark, symbols, ["v", "l"], occ, refs) == [("l", "C", 2, "Certain"), ("l", "C", 20, "Uncertain"), *(("v", *h) for h in hits)]


def test_an_untyped_mention_is_uncertain(spark):
    occ = [("p", "A", "foo", 4), ("p", "A", "foo", 28), ("p", "A", "foo ", 40)]
    assert references(spark, {"f": symbol("foo")}, ["f"], occ, [("p", "A", 4, "f")]) == [("f", "A", 4, "Certain"), ("f", "A", 28, "Uncertain")]


def test_anonymous_innermost_gives_none(spark):
    spans = spark.createDataFrame([("p", "a", 0, 100, "outer", False), ("p", "a", 10, 50, "mid", False), ("p", "a", 20, 30, "anon", True), ("p", "a", 30, 40, "next", False)], "project string, path string, start long, end long, symbol_id string, is_anonymous boolean")
    spots = spark.createDataFrame([("p", "a", i, str(i)) for i in (0, 10, 19, 20, 29, 30, 40, 50, 99, 100)], "project string, path string, offset long, loc_id string")
    got = {r.offset: r.symbol_id for r in resolve.enclosing_declaration(spots, spans).collect()}
    assert got == {0: "outer", 10: "mid", 19: "mid", 20: None, 29: None, 30: "next", 40: "mid", 50: "outer", 99: "outer", 100: None}


def test_location_joins_have_no_nested_loop(spark):
    refs = bindings.location_refs(spark, DATA)
    plan = resolve.entity_at(refs.select("project", "path", "offset", F.lit("x").alias("loc_id")), refs)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_location_keys_are_unique(spark):
    refs = bindings.location_refs(spark, "/root/testdata/sf0.01")
    assert refs.count() == refs.select("project", "path", "offset").distinct().count()


def test_word_filter_reaches_the_scan(spark, tmp_path):
    extract.extract_occurrences(sources(spark, ("p", "a", "one two"))).write.partitionBy("project").parquet(str(tmp_path / "occ"))
    plan = search.find(spark.read.parquet(str(tmp_path / "occ")), word="one", project="p")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(word,one)" in plan and "PartitionFilters: [isnotnull(project" in plan


def test_stream_and_batch_agree(spark, tmp_path):
    files = spark.createDataFrame([(1, "p", "a", "one new"), (2, "p", "b", "two"), (3, "q", "c", "three")], "file_id long, project string, path string, content string")
    old = extract.extract_occurrences(sources(spark, ("p", "a", "one"), ("p", "b", "two")))
    rows = [(1, 10, 1, "click"), (2, 11, 2, "error"), (3, 12, 3, "signup"), (4, 13, 2, "view"), (5, 14, 2, "error"), (6, 15, 1, "purchase")]
    schema = "event_id long, t int, user_id long, event_type string"
    events = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    for n, part in enumerate(([1, 2, 3], [4, 5, 6], [4, 5, 6])):  # the last batch comes twice
        events.filter(F.col("event_id").isin(part)).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    whole = ev.maintain(old, ev.file_change_stream(events), files)
    state = {"at": str(tmp_path / "state-0")}
    old.write.parquet(state["at"])

    def store(new, number):
        at = str(tmp_path / f"state-{number + 1}")
        new.write.mode("overwrite").parquet(at)
        state["at"] = at

    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = ev.maintain_stream(ev.file_change_stream(stream), lambda: spark.read.parquet(state["at"]), lambda: files, store, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination()
    key = list(extract.KEY)
    assert sorted(map(tuple, spark.read.parquet(state["at"]).select(*key).collect())) == sorted(map(tuple, whole.select(*key).collect()))
    assert {r.word for r in whole.collect()} == {"one", "new", "three"}


def test_hits_of_gone_files_are_told(spark):
    occ = extract.extract_occurrences(sources(spark, ("p", "a", "one"), ("p", "b", "one")))
    files = spark.createDataFrame([("p", "a")], "project string, path string")
    shown = {r.path: r.shown for r in results.occurrence_string(occ, files).collect()}
    assert shown == {"a": "one in a at char 0 Reference", "b": "one in File is deleted at char 0 Reference"}
