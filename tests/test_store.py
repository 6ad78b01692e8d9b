"""The stored occurrence table: replaced projects, emptied ones, pruning. Source files that are not text."""

from trawl.operators.extract import extract_occurrences
from trawl.sources import store, tables


def sources(spark, *rows):
    return spark.createDataFrame(list(rows), "project string, path string, content string")


def words(spark, path):
    return sorted((r.project, r.path, r.word) for r in store.read_occurrences(spark, path).collect())


def projects(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "project string")


def built(spark, tmp_path):
    path = str(tmp_path / "occ")
    store.append_occurrences(extract_occurrences(sources(spark, ("007", "a", "x y"), ("007", "b", "z"), ("q", "a", "x"), ("r", "c", "w"))), path)
    return path


def test_appended_rows_come_back(spark, tmp_path):
    path = built(spark, tmp_path)
    assert words(spark, path) == [("007", "a", "x"), ("007", "a", "y"), ("007", "b", "z"), ("q", "a", "x"), ("r", "c", "w")]
    assert {r.project for r in store.indexed_projects(spark, path).collect()} == {"007", "q", "r"}


def test_rebuilt_projects_replace_what_was_stored(spark, tmp_path):
    path = built(spark, tmp_path)
    now = sources(spark, ("007", "a", "new"), ("r", "c", "not asked for"))
    for _ in range(2):
        store.rebuild_stored(now, projects(spark, "007", "q", "q"), path)
        assert words(spark, path) == [("007", "a", "new"), ("r", "c", "w")]
    assert {r.project for r in store.indexed_projects(spark, path).collect()} == {"007", "q", "r"}


def test_changed_files_and_dropped_projects(spark, tmp_path):
    path = built(spark, tmp_path)
    changed = sources(spark, ("007", "a", "n"), ("007", "b", None), ("s", "d", "v"))
    for _ in range(2):
        store.upsert_stored(spark, changed, path)
        assert words(spark, path) == [("007", "a", "n"), ("q", "a", "x"), ("r", "c", "w"), ("s", "d", "v")]
    store.drop_stored(spark, projects(spark, "007", "absent"), path)
    assert words(spark, path) == [("q", "a", "x"), ("r", "c", "w"), ("s", "d", "v")]
    assert {r.project for r in store.indexed_projects(spark, path).collect()} == {"q", "r", "s"}


def test_only_the_projects_asked_for_are_read(spark, tmp_path):
    path = built(spark, tmp_path)
    asked = store.read_occurrences(spark, path).filter("project = '007' and word = 'x'")
    plan = asked._jdf.queryExecution().executedPlan()
    assert asked._jdf.collectToPython() and "PartitionFilters: [isnotnull(project" in plan.toString() and "EqualTo(word,x)" in plan.toString()
    scan = plan.collectLeaves().apply(0)
    assert scan.metrics().apply("numPartitions").value() == 1


def test_files_that_are_not_text(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in (("good.scala", "Übergröße".encode()), ("empty.scala", b""), ("deep/bad.scala", b"val \xff\xfe x"), ("cut.scala", "ü".encode()[:1]), ("bad.txt", b"\xff")):
        (tmp_path / name).write_bytes(content)
    broken = tables.unreadable_files(spark, str(tmp_path), "p").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in broken) == ["bad.scala", "cut.scala"]
    read = tables.scan_sources(spark, str(tmp_path), "p")
    assert read.count() == 3  # Spark skips the empty file
    assert read.filter("path like '%good.scala'").first().content == "Übergröße"


def shuffled(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "word#" in line]


def test_words_are_not_shuffled_to_be_written(spark, tmp_path, monkeypatch):
    written = []
    write = store._write
    monkeypatch.setattr(store, "_write", lambda rows, *a, **k: (written.append((rows, k.get("by_project"))), write(rows, *a, **k)))
    path = str(tmp_path / "occ")
    texts = sources(spark, *((f"p{i % 5}", f"f{i}", f"the word of {i}\nx y") for i in range(60)), (None, "n", "a"), ("", "e", "b"), ("p1", "f1", "twice"))
    store.append_occurrences(extract_occurrences(texts, by_project=True), path, by_project=True)
    assert sorted(map(str, store.read_occurrences(spark, path).drop("project").collect())) == sorted(map(str, extract_occurrences(texts).select(*store.COLUMNS).collect()))
    store.rebuild_stored(texts.filter("path <> 'f5'"), projects(spark, "p0", "p1"), path)
    store.upsert_stored(spark, sources(spark, ("p2", "f2", "now"), ("p3", "f3", None)), path)
    assert len(written) == 4 and written[0][1] and written[2][1] and written[3][1]
    for rows, by_project in written:
        if by_project:
            assert not shuffled(rows.select("project", *store.COLUMNS))
    got = [(r.project, r.path, r.word) for r in store.read_occurrences(spark, path).collect()]
    assert ("p2", "f2", "now") in got and (None, "n", "a") in got and not [w for w in got if w[1] in ("f3", "f5")] and len([w for w in got if w[1] == "f1"]) == 7


def test_many_projects_and_long_lists(spark, tmp_path, monkeypatch):
    """More projects in a task than it writes at once; more changed files than are sent as a list."""
    path = str(tmp_path / "occ")
    before = [spark.conf.get(k, None) for k in ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
    monkeypatch.setattr(store, "WRITERS", 2)
    monkeypatch.setattr(store, "LISTED", 0)
    texts = sources(spark, *((f"p{i % 30}", f"f{i}", f"a{i} b") for i in range(90)))
    store.append_occurrences(extract_occurrences(texts, by_project=True), path, by_project=True)
    store.upsert_stored(spark, sources(spark, *((f"p{i % 30}", f"f{i}", f"c{i}") for i in range(30))), path)
    want = [(f"p{i % 30}", f"f{i}", w) for i in range(90) for w in ([f"c{i}"] if i < 30 else [f"a{i}", "b"])]
    assert words(spark, path) == sorted(want)
    assert {r.project for r in store.indexed_projects(spark, path).collect()} == {f"p{i}" for i in range(30)}
    assert before == [spark.conf.get(k, None) for k in ("spark.sql.maxConcurrentOutputFileWriters", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")]
