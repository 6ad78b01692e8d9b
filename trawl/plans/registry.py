"""The registered queries; their SQL is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions import names
from trawl.operators import extract, graph, maintain, resolve, results, search
from trawl.plans import bindings as b
from trawl.plans.oracles import ORACLES
from trawl.sources import store
from trawl.sources.tables import cut_lineage, shared_folder, table
from trawl.streaming import events as ev

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORD, COMMON = "that", "and"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hits of the benchmark's first words in all documents, counted by project and file."""
    return results.group_hits(search.find_any(b.occurrences(spark, d), b.benchmark_words(spark, d)))


def _per_file(occ: DataFrame) -> DataFrame:
    return occ.groupBy("project", "path").agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum("offset").cast("long").alias("sum_offset"))


# extraction


@query
def extract_words(spark, d):
    return b.occurrences(spark, d).select("project", "path", "word", "offset", "line_no", "line_start")


@query
def extract_kinds(spark, d):
    return search.find(b.occurrences(spark, d), kind="Declaration").select("project", "path", "word", "offset")


@query
def extract_super(spark, d):
    return search.find(b.occurrences(spark, d), is_super=True).select("project", "path", "word", "offset")


@query
def extract_code(spark, d):
    return b.code_occurrences(spark, d).select("project", "path", "word", "offset", "line_no", "line_start")


@query
def extract_code_kinds(spark, d):
    return b.code_occurrences(spark, d).select("project", "path", "word", "offset", "kind")


@query
def extract_code_super(spark, d):
    return search.find(b.code_occurrences(spark, d), is_super=True).select("project", "path", "word", "offset")


@query
def extract_lines(spark, d):
    return extract.line_table(b.sources(spark, d))


@query
def quarantine_failures(spark, d):
    return extract.quarantine_failures(b.sources(spark, d))


# search


@query
def find_word(spark, d):
    return search.find(b.occurrences(spark, d), word=WORD).select("project", "path", "word", "offset", "kind")


@query
def find_any_word(spark, d):
    return search.find_any(b.occurrences(spark, d), b.benchmark_words(spark, d)).select("project", "path", "word", "offset", "kind")


@query
def find_declarations(spark, d):
    return search.find(b.occurrences(spark, d), word=COMMON, kind="Declaration").select("project", "path", "offset")


@query
def find_in_super_position(spark, d):
    return search.find(b.occurrences(spark, d), word="the", is_super=True).select("project", "path", "offset")


@query
def occurrences_in_file(spark, d):
    return search.find(b.occurrences(spark, d), path="doc_7", project="src7").select("word", "offset", "kind")


def _scope(spark, d):
    return b.labelled_files(spark, d, "toxic = 1 and quality = 0").select("project").distinct()


@query
def restrict_scope(spark, d):
    return search.restrict_scope(search.find(b.occurrences(spark, d), word=COMMON), _scope(spark, d)).select("project", "path", "offset")


@query
def live_files_only(spark, d):
    return search.live_files_only(search.find(b.occurrences(spark, d), word=COMMON), b.labelled_files(spark, d)).select("project", "path", "offset")


@query
def batch_search(spark, d):
    return search.batch_search(b.occurrences(spark, d), b.benchmark_words(spark, d)).select("query_id", "mode", "word", "project", "path", "offset")


def _wide_scope(spark, d):
    return b.sources(spark, d).select("project").unionAll(table(spark, d, "supplier").select(F.col("s_name").alias("project"))).distinct()


@query
def search_results(spark, d):
    return search.search_with_failures(b.occurrences(spark, d), _wide_scope(spark, d), word=WORD)[0].select("project", "path", "offset")


@query
def search_failures(spark, d):
    return search.search_with_failures(b.sources(spark, d), _wide_scope(spark, d))[1]


@query
def dedup_occurrences(spark, d):
    twice = b.occurrences(spark, d).unionByName(extract.extract_occurrences(b.labelled_files(spark, d)))
    return _per_file(search.dedup_occurrences(twice))


# results


@query
def to_hit(spark, d):
    return results.to_hit(search.find(b.occurrences(spark, d), word=WORD))


@query
def group_hits(spark, d):
    return results.group_hits(search.find(b.occurrences(spark, d), word=COMMON))


@query
def group_lines(spark, d):
    tree = results.group_lines(search.find(b.occurrences(spark, d), word=COMMON))
    shown = F.transform("lines", lambda n: F.concat(n.line_no.cast("string"), F.lit(":"), F.array_join(n.offsets.cast("array<string>"), ",")))
    return tree.select("project", "path", "n_hits", F.array_join(shown, ";").alias("lines"))


@query
def count_label(spark, d):
    return results.count_label(results.group_hits(search.find(b.occurrences(spark, d), word=COMMON)))


@query
def matches_in_file(spark, d):
    return results.matches_in_file(search.find(b.occurrences(spark, d), word=COMMON), b.labelled_files(spark, d, "quality = 1"), _scope(spark, d)).select("project", "path", "offset")


def _shown(spark, d):
    hits = search.find(b.occurrences(spark, d), word=WORD)
    return extract.with_lines(hits, extract.line_table(b.sources(spark, d))).withColumn("confidence", F.when(F.col("kind") == "Declaration", "Certain").otherwise("Uncertain"))


@query
def snippet(spark, d):
    return results.snippet(_shown(spark, d))


@query
def occurrence_string(spark, d):
    return results.occurrence_string(search.find(b.occurrences(spark, d), word=WORD), b.labelled_files(spark, d))


# names and kinds


@query
def alternative_names(spark, d):
    forms = names.alternative_names(F.col("name"), F.col("owner"), F.col("kind"))
    return b.symbols(spark, d).select("symbol_id", F.array_join(forms, ",").alias("names"))


@query
def canonical_name(spark, d):
    return b.symbols(spark, d).select("symbol_id", names.canonical_name(F.col("name")).alias("canonical"))


@query
def display_name(spark, d):
    return b.symbols(spark, d).select("symbol_id", names.display_name(F.col("qualified_name")).alias("display"))


@query
def long_display_name(spark, d):
    return b.symbols(spark, d).select("symbol_id", names.long_display_name(F.col("qualified_name")).alias("long_display"))


@query
def entity_kind(spark, d):
    return b.symbols(spark, d).select("symbol_id", "kind")


@query
def searchable_entities(spark, d):
    return resolve.searchable_entities(b.symbols(spark, d)).select("symbol_id", "kind")


@query
def hierarchy_label(spark, d):
    rows = b.symbols(spark, d).select(
        F.col("symbol_id").alias("id"),
        names.display_name(F.col("qualified_name")).alias("display_name"),
        F.when(F.col("accessor") == "", F.col("owner")).alias("path"),
        F.when(F.col("is_local"), "Uncertain").otherwise("Certain").alias("confidence"),
    )
    return results.hierarchy_label(rows)


@query
def declaration_location(spark, d):
    declared = b.symbols(spark, d).filter("kind <> 'unknown'").select("symbol_id", F.col("owner").alias("path"), F.col("symbol_id").alias("offset"))
    return resolve.declaration_location(b.symbols(spark, d), declared)


# references of entities


def _kinship(spark, d):
    up = graph.closure(b.brands(spark, d), b.brand_parents(spark, d)).select(F.concat(F.lit("Brand"), F.col("root").cast("string")).alias("a"), F.concat(F.lit("Brand"), F.col("id").cast("string")).alias("b"))
    return up.unionAll(up.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _classes(spark, d):
    return resolve.symbol_classes(b.symbols(spark, d)), resolve.mention_classes(b.mentions(spark, d)), _kinship(spark, d), b.overrides(spark, d)


@query
def compare_symbols(spark, d):
    compared = resolve.compare_symbols(*_classes(spark, d))
    return compared.groupBy("e_name", "e_owner", "e_signature", "e_kind", "e_accessor", "e_is_local", "verdict").agg(F.count(F.lit(1)).cast("long").alias("n_classes"), F.sum("n").cast("long").alias("n_mentions"))


@query
def occurrences_of_entity(spark, d):
    return resolve.occurrences_of_entity(*_classes(spark, d)).drop("e_getter", "e_setter")


@query
def find_references(spark, d):
    """Of the first searchable entity of each owner."""
    first = resolve.searchable_entities(b.symbols(spark, d)).groupBy("owner").agg(F.min("symbol_id").alias("symbol_id")).drop("owner")
    asked = b.symbols(spark, d).join(first, "symbol_id").withColumnRenamed("symbol_id", "entity")
    written = b.written_mentions(spark, d)
    return resolve.find_references(asked, written, written.filter("resolved"), b.symbols(spark, d), _kinship(spark, d), b.overrides(spark, d))


@query
def with_confidence(spark, d):
    return resolve.with_confidence(resolve.compare_symbols(*_classes(spark, d))).groupBy("e_kind", "m_kind", "confidence").agg(F.sum("n").cast("long").alias("n_mentions"))


@query
def search_summary(spark, d):
    return results.search_summary(resolve.occurrences_of_entity(*_classes(spark, d)), "e_owner")


@query
def entity_at(spark, d):
    refs = b.location_refs(spark, d)
    asked = refs.select("project", "path", (F.col("offset") + F.col("ahead")).alias("offset"), F.concat_ws("/", "project", "path", F.col("offset").cast("string")).alias("loc_id"))
    return resolve.entity_at(asked, refs)


def _spans(spark, d):
    src = b.sources(spark, d)
    whole = src.select("project", "path", F.lit(0).cast("long").alias("start"), F.length("content").cast("long").alias("end"), F.lit("document").alias("symbol_id"), F.lit(False).alias("is_anonymous"))
    lines = extract.line_table(src)
    line = lines.select("project", "path", F.col("line_start").alias("start"), (F.col("line_start") + F.length("line")).alias("end"), F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("symbol_id"), F.lit(False).alias("is_anonymous"))
    cut = lines.select("project", "path", "line_no", "line_start", F.split("line", r"\. ").alias("parts"))
    steps = F.transform("parts", lambda p, i: F.struct(p.alias("part"), F.length(F.array_join(F.slice("parts", F.lit(1), i), ". ")).alias("before"), i.alias("i")))
    part = cut.select("project", "path", "line_no", "line_start", F.explode(steps).alias("s"))
    start = F.col("line_start") + F.col("s.before") + F.when(F.col("s.i") > 0, 2).otherwise(0)
    sentence = part.select(
        "project",
        "path",
        start.cast("long").alias("start"),
        (start + F.length("s.part")).cast("long").alias("end"),
        F.concat(F.lit("sentence "), F.col("line_no").cast("string"), F.lit("."), F.col("s.i").cast("string")).alias("symbol_id"),
        (F.col("s.i") % 2 == 1).alias("is_anonymous"),
    )
    return whole.unionAll(line).unionAll(sentence).filter("start < end")


@query
def enclosing_declaration(spark, d):
    asked = search.find(b.occurrences(spark, d), is_super=True).select("project", "path", "offset", F.concat_ws("/", "path", F.col("offset").cast("string")).alias("loc_id"))
    return resolve.enclosing_declaration(asked, _spans(spark, d))


# graphs


@query
def ancestors(spark, d):
    return graph.closure(b.brands(spark, d), b.brand_parents(spark, d)).select("root", "id", F.col("depth").cast("long").alias("depth"))


@query
def direct_supertypes(spark, d):
    ids = b.brands(spark, d)
    types = ids.select("id", (F.col("id") % 3 != 0).alias("is_class"))
    parents = ids.filter("id >= 2").select(F.col("id").alias("child_id"), F.floor(F.col("id") / 2).alias("parent_id"), F.lit(0).alias("ord"))
    parents = parents.unionAll(ids.filter("id >= 6").select(F.col("id").alias("child_id"), F.floor(F.col("id") / 3).alias("parent_id"), F.lit(1).alias("ord")))
    return graph.direct_supertypes(types, parents).select("id", F.array_join("supertypes", ",").alias("supertypes"))


def _type_hits(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_name", "p_type"), "l_partkey")
    return lines.select(
        F.floor(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long") / 2).cast("string").alias("root"),
        F.regexp_extract("p_brand", "[0-9]+", 0).alias("qualified_name"),
        F.when(F.col("l_returnflag") == "N", "Uncertain").otherwise("Certain").alias("confidence"),
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("path"),
        F.col("l_linenumber").cast("long").alias("offset"),
        "p_type",
        "p_name",
    )


@query
def direct_subtypes(spark, d):
    return resolve.direct_subtypes(_type_hits(spark, d))


@query
def find_subtypes(spark, d):
    occ = cut_lineage(search.find(b.code_occurrences(spark, d), is_super=True))  # read for types, for refs and for hits
    symbols, refs = b.code_types(occ)
    kin = symbols.select(F.col("owner").alias("a"), F.col("owner").alias("b")).distinct()
    spans = b.code_spans(extract.line_table(b.code_sources(spark, d)))
    types = symbols.filter("owner = 'lib'").withColumnRenamed("symbol_id", "entity")
    return resolve.find_subtypes(types, occ, refs, symbols, kin, spans, spans)


@query
def first_per_qualified_name(spark, d):
    hits = _type_hits(spark, d).select(F.col("p_type").alias("root"), F.col("p_name").alias("qualified_name"), "confidence", "path", "offset")
    return results.first_per_qualified_name(hits)


@query
def type_hierarchy(spark, d):
    down = b.brand_parents(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.type_hierarchy(b.brands(spark, d), down).select("root", "id", F.col("depth").cast("long").alias("depth"), "is_leaf")


def _customers(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    projects = people.select(F.col("c_custkey").alias("project"), (F.col("c_acctbal") >= 0).alias("is_open"))
    under = people.select(F.floor(F.col("c_custkey") / 4).alias("dst"), F.col("c_custkey").alias("src"), "c_mktsegment")
    edges = under.join(people.select(F.col("c_custkey").alias("dst"), "c_mktsegment"), ["dst", "c_mktsegment"]).filter("src <> dst").select("src", "dst")
    return projects, edges


@query
def project_closure(spark, d):
    return graph.project_closure(*_customers(spark, d))


@query
def scope_for(spark, d):
    orders = table(spark, d, "orders")
    seeds = orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project")).distinct()
    indexed = orders.select(F.col("o_custkey").alias("project"))
    return graph.scope_for(seeds, graph.project_closure(*_customers(spark, d)), indexed)


# maintenance


@query
def delete_file_occurrences(spark, d):
    return _per_file(maintain.delete_file_occurrences(b.occurrences(spark, d), b.labelled_files(spark, d, "quality = 0")))


def _changed(spark, d):
    return b.labelled_files(spark, d, "toxic = 1").withColumn("content", F.concat(F.lit("of the new "), F.col("content")))


@query
def upsert_files(spark, d):
    return _per_file(maintain.upsert_files(b.occurrences(spark, d), _changed(spark, d)))


@query
def rebuild_projects(spark, d):
    old = b.occurrences(spark, d)
    stale = maintain.delete_file_occurrences(old, b.labelled_files(spark, d, "quality = 1"))
    return _per_file(maintain.rebuild_projects(stale, b.sources(spark, d), _scope(spark, d)))


@query
def drop_projects(spark, d):
    return _per_file(maintain.drop_projects(b.occurrences(spark, d), _scope(spark, d)))


def _stored(spark, occ, by_project=True):
    path = shared_folder(spark, "occurrences")
    store.append_occurrences(occ, path, by_project=by_project)
    return path


def _stored_without_good(spark, d):
    good, few = store.listed(b.labelled_files(spark, d, "quality = 1").select("project", "path"))
    return _stored(spark, maintain.delete_file_occurrences(b.occurrences(spark, d, by_project=True), good), few)


@query
def stored_rebuild(spark, d):
    path = _stored_without_good(spark, d)
    store.rebuild_stored(b.sources(spark, d), _scope(spark, d), path)
    return _per_file(store.read_occurrences(spark, path))


@query
def stored_upsert(spark, d):
    path = _stored_without_good(spark, d)
    store.upsert_stored(spark, b.labelled_files(spark, d, "toxic = 1"), path)
    return _per_file(store.read_occurrences(spark, path))


@query
def stored_drop(spark, d):
    path = _stored(spark, b.occurrences(spark, d, by_project=True))
    store.drop_stored(spark, _scope(spark, d), path)
    return _per_file(store.read_occurrences(spark, path))


def _audit(spark, d):
    # rows of toxic files stand twice, so that some projects are not clean
    occ = b.occurrences(spark, d).unionByName(extract.extract_occurrences(b.labelled_files(spark, d, "toxic = 1 and quality = 0")))
    return maintain.audit_occurrences(occ, extract.line_table(b.sources(spark, d)))


@query
def audit_occurrences(spark, d):
    return _audit(spark, d)


@query
def projects_to_rebuild(spark, d):
    return maintain.projects_to_rebuild(_wide_scope(spark, d), _audit(spark, d))


@query
def ingest_records(spark, d):
    records = maintain.export_records(b.occurrences(spark, d))
    bad = b.labelled_files(spark, d, "quality = 0").select("project", "path", F.lit(True).alias("bad"))
    spoilt = records.join(bad.hint("shuffle_hash"), ["project", "path"], "left").withColumn("offset", F.when(F.col("bad"), F.concat(F.lit("x"), F.col("offset"))).otherwise(F.col("offset"))).drop("bad")
    judged = maintain.ingest_records(spoilt, b.labelled_files(spark, d), apart=False)
    return judged.groupBy("project", "outcome").agg(F.count(F.lit(1)).cast("long").alias("n_rows")).select("project", "n_rows", "outcome")


# streams


@query
def file_change_stream(spark, d):
    return ev.file_change_stream(table(spark, d, "events")).select("seq", "file_id", "kind")


@query
def gate_indexable(spark, d):
    return ev.gate_indexable(ev.file_change_stream(table(spark, d, "events")), _indexable(spark, d)).select("seq", "file_id", "kind")


def _indexable(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("file_id"))


@query
def collapse_events(spark, d):
    return ev.collapse_events(ev.file_change_stream(table(spark, d, "events")))


@query
def maintain_index(spark, d):
    old = maintain.delete_file_occurrences(b.occurrences(spark, d), b.labelled_files(spark, d, "quality = 1"))
    changes = ev.gate_indexable(ev.file_change_stream(table(spark, d, "events")), _indexable(spark, d))
    return _per_file(ev.maintain(old, changes, b.file_sources(spark, d)))


@query
def project_state(spark, d):
    return ev.project_state(table(spark, d, "events"))
