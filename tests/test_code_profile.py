"""The code profile of extraction: the fixtures of FIXTURES.md section 2, and further cases of its rules."""

import re

import pytest

from trawl.operators import code, extract, resolve

CASES = {
    "x-methods": ("""
      class ScalaClass {
        def method: String = {
          val s1 = methodOne
          val s2 = methodTwo(s1)
          methodThree(s1)(s2)
        }
      }
      object ScalaClass {
        def methodOne = "Test"
        def methodTwo(s: String) = s
        def methodThree(s: String)(s2: String) = s + s2
      }
    """, lambda r: r.word in ("methodOne", "methodTwo", "methodThree"), 6),
    "x-chain": ("""
      class MethodChaining {
        def foo() = this
        def bar() = this
      }
      object MethodChaining {
        def method() = {
          val x new MethodChaining()
          x.foo().bar()
        }
      }
    """, lambda r: r.word in ("foo", "bar"), 4),
    "x-arg": ("""
      class ScalaClass {
        def method: String = {
          val s2 = methodTwo(methodOne)
          methodThree(s1)(methodTwo(s2))
        }
      }
      object ScalaClass {
        def methodTwo(s: String) = s
      }
    """, lambda r: r.word == "methodTwo", 3),
    "x-select-arg": ("""
      class Bar {
        def x = "test"
      }
      object ScalaClass {
        val foo = new Foo
        val bar = new Bar
        foo.bar(bar.x)
      }
    """, lambda r: r.word == "x", 2),
    "x-interp": ("""
      object StringInterpolation {
        def foo(x: String) = s"Hi there, ${x}"
      }
    """, lambda r: r.word == "x", 2),
    "x-annot": ("""
      import java.io.IOException

      object Test {
        @throws(classOf[IOException]) def test() = {}
      }
    """, lambda r: r.word == "IOException", 1),
    "x-init-empty": ("class C {}", lambda r: r.word == "<init>" and r.kind == "Declaration", 1),
    "x-init-args": ("class C(x: String) {}", lambda r: r.word == "<init>" and r.kind == "Declaration", 1),
    "x-init-two": ("class C {\n  def this(s: String) = this\n}", lambda r: r.word == "<init>" and r.kind == "Declaration", 2),
    "x-new": ("class C\nobject C {\n  def apply() = new C\n}", lambda r: (r.word, r.kind, r.offset) == ("<init>", "Reference", 35), 1),
    "x-super": ("class A\nclass B extends A with Object", lambda r: r.is_super and r.word in ("A", "Object"), 2),
    "x-selftype": ("class A\ntrait B { this: A => }", lambda r: not r.is_super and r.word == "A", 2),
    "x-object-super": ("trait A\nobject B extends A", lambda r: r.is_super and r.word == "A", 1),
    "x-typearg": ("class A\nabstract class B extends Fucntion1[A, Unit]", lambda r: r.is_super and r.word == "A", 0),
}


@pytest.fixture(scope="module")
def rows_of(spark):
    def run(texts):
        src = spark.createDataFrame([("p", k, v) for k, v in texts.items()], "project string, path string, content string")
        found = {k: [] for k in texts}
        for r in extract.extract_occurrences(src, profile="scala").collect():
            found[r.path].append(r)
        return {k: sorted(v, key=lambda r: (r.offset, r.word)) for k, v in found.items()}

    return run


def test_fixtures(rows_of):
    got = rows_of({k: c[0] for k, c in CASES.items()})
    assert {k: sum(map(c[1], got[k])) for k, c in CASES.items()} == {k: c[2] for k, c in CASES.items()}


SHAPES = {
    # content: what is told, D for declarations, R for references, S for those in a super position
    "def f[A <: B[C]](x: A, y: Map[K, V])(implicit z: Z): Ret[Q, W] = body(x)": "D f, D x, R A, D y, R Map, R K, R V, D z, R Z, R body, R x",
    "def f: Int\ng(h)": "D f, R g, R h",
    "def f(x: Int): Long\n  def g = f(1)": "D f, D x, R Int, D g, R f",
    "class A[T](val x: T, y: Int = z) extends B[T](y) with p.C { self: D with E => }": "D A, D <init>, D x, R T, D y, R Int, R z, S B, R T, R y, S p, S C, R D, R E",
    "trait T extends Foo[Foo[String]]\nval u = v": "D T, S Foo, R Foo, R String, D u, R v",
    "class A extends B\n  with C\nclass D": "D A, D <init>, S B, S C, D D, D <init>",
    "class A extends B\ncall(x)": "D A, D <init>, S B, R call, R x",
    "val a, b: Foo[Bar] = c": "D a, D b, R Foo, R Bar, R c",
    "val x = new Foo(1) with Bar { def y = 2 }": "D x, R <init>, S Foo, S Bar, D y",
    "f(new Foo, new Bar(x))": "R f, R <init>, R Foo, R <init>, R Bar, R x",
    "import a.b.{C, D => E}, f.G\nH": "R a, R b, R f, R H",
    "import a.B": "R a",
    "package a.b\nclass C": "R a, R b, D C, D <init>",
    "type X = Y[Z]": "R Y, R Z",
    "@ann(arg) class A\n@ok(that) def f = 1\n@no val x = 2": "D A, D <init>, R ok, R that, D f, D x",
    "x.y_=(3); `my type` + a :: b": "R x, R y_=, R my type, R +, R a, R ::, R b",
    '/* class X */ val s = "def y" // new Z\nval c = \'"\'; val d = "a\\"b c"': "D s, D c, D d",
    'f"$a and ${b.c + 1} $$no }d" + raw"""x ${y}\n z"""': "R f, R a, R b, R c, R +, R raw, R y",
    "object O { def apply(x: Int) = xs.map(y => y + x) }": "D O, D apply, D x, R Int, R xs, R map, D y, R y, R +, R x",
    "class P(private val x: A,\n  @no(w) var y: B = q(z), u: D)": "D P, D <init>, D x, R A, D y, R B, R q, R z, D u, R D",
    "def +(o: V) = 1": "D +, D o, R V",
    "/* never ended class A": "",
    'val x = """def y': "D x",
    "": "",
}


def test_shapes(rows_of):
    got = rows_of({k: k for k in SHAPES})
    told = {k: ", ".join(f"{'S' if r.is_super else r.kind[0]} {r.word}" for r in sorted(v, key=lambda r: (r.offset, r.word == "<init>"))) for k, v in got.items()}
    assert told == SHAPES


def test_words_stand_at_their_offsets(rows_of):
    texts = {k: c[0] for k, c in CASES.items()} | {str(i): k for i, k in enumerate(SHAPES)}
    for key, rows in rows_of(texts).items():
        for r in rows:
            text = texts[key][r.offset :].replace("`", "")
            assert r.word == "<init>" or text.startswith(r.word)
            assert texts[key][: r.offset].count("\n") + 1 == r.line_no and texts[key][: r.offset].rfind("\n") + 1 == r.line_start


def test_null_contents_and_long_files(rows_of):
    long = "class A extends B { def f(x: Int): Int = g(x) }\n" * 3000
    got = rows_of({"null": None, "long": long, "string": 'val x = "' + "y" * 300000 + '"', "comment": "/*" + "z " * 200000 + "*/ w"})
    assert got["null"] == [] and len(got["long"]) == 3000 * 8
    assert [r.word for r in got["string"]] == ["x"] and [r.word for r in got["comment"]] == ["w"]


def test_what_follows_needs_no_sort_of_its_own(spark):
    src = spark.createDataFrame([("p", "f", "@a(b) @c def x = new A.B { new C }\n@d class Y extends Z")], "project string, path string, content string")
    seen = code._with_context(code.tokens(src))
    assert "DESC" not in seen._jdf.queryExecution().executedPlan().toString()
    told = {(r.token, r.pos): (r.declares, r.follows) for r in seen.collect()}
    by_token = {t: v for (t, _), v in sorted(told.items(), key=lambda x: -x[0][1])}
    assert by_token["@"] == ("def", "@") and by_token["A"] == ("class", "{") and by_token["C"] == (None, None)
    assert by_token["class"] == (None, "extends") and by_token["extends"] == (None, None)


def test_a_file_is_dealt_once(spark):
    src = spark.createDataFrame([("p", "a", "class A")], "project string, path string, content string")
    plan = extract.extract_occurrences(src, profile="scala")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2  # the texts, once for each cut


SUBTYPES = {
    "g-sub": ("trait Foo\nclass Bar extends Foo", ["Bar"]),
    "g-sub-self": ("trait Foo\ntrait Bar { this: Foo => }", []),
    "g-sub-arg": ("trait Bar[T]\ntrait Foo extends Bar[Foo]", []),
    "g-sub-nested": ("trait Foo[T]\ntrait Bar extends Foo[Foo[String]]", ["Bar"]),
    "g-sub-collide": ("trait Foo\ntrait B extends Foo\nobject B extends Foo\ntrait C extends B", ["B", "B.type"]),
    "g-sub-twice": ("trait Foo\nclass B extends Foo with Foo", ["B"]),
    "r-anon": ("object O {\n val x = new Foo with Foo {}\n}", []),
    "untyped": ("trait B extends Foo(?)", ["B"]),
}


def test_subtypes(spark):
    src = spark.createDataFrame([(case, "f", text) for case, (text, _) in SUBTYPES.items()], "project string, path string, content string")
    occ = extract.extract_occurrences(src, profile="scala").persist()
    columns = "symbol_id string, name string, owner string, signature string, kind string, accessor string, is_local boolean, getter string, setter string, qualified_name string"
    symbols = spark.createDataFrame([("Foo", "Foo", "lib", "", "trait", "", False, None, None, "lib.Foo")], columns)
    refs = occ.filter("word = 'Foo' and project <> 'untyped'").selectExpr("project", "path", "offset", "'Foo' symbol_id")
    spans = []
    for case, (text, _) in SUBTYPES.items():
        at = 0
        for line in text.split("\n"):
            name = re.search(r"(class|trait|object) (\w+)", line)
            if name or "new" in line:
                shown = (name[2] + (".type" if name[1] == "object" else "")) if name else "anon"
                spans.append((case, "f", at, at + len(line) + 1, f"{case}/{at}", name is None, "lib.Foo" if shown == "Foo" else f"{case}:{shown}"))
            at += len(line) + 1
    spans = spark.createDataFrame(spans, "project string, path string, start long, end long, symbol_id string, is_anonymous boolean, qualified_name string")
    kin = spark.createDataFrame([("lib", "lib")], "a string, b string")
    got = resolve.find_subtypes(symbols.withColumnRenamed("symbol_id", "entity"), occ, refs, symbols, kin, spans, spans).collect()
    found = {case: sorted(r.qualified_name.split(":")[1] for r in got if r.qualified_name.startswith(case + ":")) for case in SUBTYPES}
    assert found == {case: want for case, (_, want) in SUBTYPES.items()}
    assert all((r.confidence == "Uncertain") == r.qualified_name.startswith("untyped:") for r in got)
