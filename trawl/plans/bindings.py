"""How the given tables stand for sources, symbols, mentions, projects and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.names import alternative_names, entity_kind
from trawl.operators.extract import extract_occurrences
from trawl.sources.tables import table


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("source").alias("project"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


#: Code made of a word of a line, @; a line's number modulo five chooses.
CODE = (
    "class @[T](arg: @, val more: T) extends Base[@](arg) with Other { self: Req => }",
    '  def @[A](a: Int, b: List[A])(c: String): Map[A, @] = s"got ${@.size} of $a" // @ here',
    "  val @, other: Foo = new Part(@) with Rest { }",
    "import @.{inner, Other => _}, lib.@",
    '/* class @ { */ object @ extends Root.Leaf; "def @"; @ + 1',
)


def code_sources(spark: SparkSession, d: str) -> DataFrame:
    """A source file for every document, a statement for every line, named after the line's first word."""
    word = lambda line: F.concat(F.lit("w_"), F.regexp_extract(line, "[a-z]+", 0))
    shapes = F.array(*map(F.lit, CODE))
    code = F.transform(F.split("content", "\n"), lambda line, i: F.replace(F.element_at(shapes, i % len(CODE) + 1), F.lit("@"), word(line)))
    return sources(spark, d).select("project", "path", F.array_join(code, "\n").alias("content"))


def code_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return extract_occurrences(code_sources(spark, d), profile="scala")


def code_types(occ: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols of the types in super positions, each with a homonym in another library, and where mentions are resolved:
    in every third line to the homonym, else in every second line to the type."""
    words = occ.filter("is_super").select("word").distinct()
    told = words.withColumn("owner", F.explode(F.array(F.lit("lib"), F.lit("elsewhere"))))
    none = F.lit(None).cast("string")
    symbols = told.select(
        F.concat_ws(".", "owner", "word").alias("symbol_id"), F.col("word").alias("name"), "owner", F.lit("").alias("signature"), F.lit("class").alias("kind"),
        F.lit("").alias("accessor"), F.lit(False).alias("is_local"), none.alias("getter"), none.alias("setter"), F.concat_ws(".", "owner", "word").alias("qualified_name"),
    )
    owner = F.when(F.col("line_no") % 3 == 0, "elsewhere").when(F.col("line_no") % 2 == 0, "lib")
    refs = occ.filter("is_super").select("project", "path", "offset", F.concat(owner, F.lit("."), "word").alias("symbol_id")).filter("symbol_id is not null")
    return symbols, refs


def code_spans(lines: DataFrame) -> DataFrame:
    """The line of each class, object and anonymous class as its span, with the qualified name of what it declares."""
    turn = (F.col("line_no") - 1) % len(CODE)
    own = lines.filter(turn.isin(0, 2, 4))
    return own.select(
        "project",
        "path",
        F.col("line_start").alias("start"),
        (F.col("line_start") + F.length("line")).alias("end"),
        F.concat_ws("/", "project", "path", F.col("line_no").cast("string")).alias("symbol_id"),
        (turn == 2).alias("is_anonymous"),
        F.concat_ws(".", "project", F.regexp_extract("line", "w_[a-z]*", 0)).alias("qualified_name"),
    )


def occurrences(spark: SparkSession, d: str, *, by_project: bool = False) -> DataFrame:
    return extract_occurrences(sources(spark, d), by_project=by_project)


def labelled_files(spark: SparkSession, d: str, condition: str = "true") -> DataFrame:
    """Files that `labels` marks, by a condition on the labels."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("project"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return docs.join(table(spark, d, "labels").filter(condition).select("doc_id"), "doc_id", "left_semi").drop("doc_id")


def benchmark_words(spark: SparkSession, d: str) -> DataFrame:
    """query_id, the first word of each benchmark item, and a mode in turn."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"[\p{L}\p{N}_]+", 0).alias("word"))
    mode = F.when(F.col("query_id") % 3 == 0, "any").when(F.col("query_id") % 3 == 1, "declaration").otherwise("super")
    return rows.withColumn("mode", mode)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols from `part`: the size modulo 12 decides what a symbol is, so that every form occurs."""
    t = F.col("p_size") % 12
    base = F.replace("p_name", F.lit(" "), F.lit("_"))
    is_ = {"interface": t == 0, "trait": t == 1, "abstract class": t == 3, "class": t == 2, "module": t == 4, "type": t == 5, "method": t.isin(6, 7, 10), "val": t == 8, "var": t == 9}
    name = F.when(t == 7, F.concat(base, F.lit("_="))).when(t == 10, "apply").when(t == 8, F.concat(base, F.lit(" "))).otherwise(base)
    owner = F.replace("p_brand", F.lit("#"), F.lit(""))
    tail = F.when(t == 4, ".type").when(t == 5, "[core.Elem.type]").when(t == 2, "[a.B]").otherwise("")
    setter, getter = (t == 7) & (F.col("p_size") >= 31), (t == 6) & (F.col("p_size") >= 40)
    taken = F.concat(F.lit("("), F.col("p_type"), F.lit(")Unit"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("symbol_id"),
        name.alias("name"),
        owner.alias("owner"),
        F.when(t == 7, taken).otherwise(F.col("p_type")).alias("signature"),
        entity_kind(lambda k: is_[k]).alias("kind"),
        F.when(setter, "setter").when(getter, "getter").otherwise("").alias("accessor"),
        ((t == 9) & (F.col("p_size") >= 33)).alias("is_local"),
        F.concat(F.lit("lib."), owner, F.lit("."), base, tail).alias("qualified_name"),
        F.when(t.isin(8, 9) | setter | getter, F.col("p_type")).alias("getter"),
        F.when((t == 9) | setter, taken).alias("setter"),
    )


def overrides(spark: SparkSession, d: str) -> DataFrame:
    """Members of a brand and of the brand that it lies under, of one name, override each other where their types end alike."""
    own = symbols(spark, d).select("name", "owner", "signature", F.regexp_extract("owner", "[0-9]+", 0).cast("long").alias("id"), F.regexp_extract("signature", "[A-Z]+[)A-Za-z]*$", 0).alias("end")).distinct()
    lower = own.select(F.trim("name").alias("name"), F.col("owner").alias("a_owner"), F.col("signature").alias("a_signature"), F.floor(F.col("id") / 2).alias("id"), "end")
    pairs = lower.join(own.select(F.trim("name").alias("name"), F.col("owner").alias("b_owner"), F.col("signature").alias("b_signature"), "id", "end"), ["name", "id", "end"]).drop("id", "end")
    return pairs.unionByName(pairs.select("name", F.col("b_owner").alias("a_owner"), F.col("b_signature").alias("a_signature"), F.col("a_owner").alias("b_owner"), F.col("a_signature").alias("b_signature")))


def written_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences from `lineitem`: at each place one of the names of the part's symbol, by the quantity."""
    forms = alternative_names(F.col("name"), F.col("owner"), F.col("kind"))
    told = symbols(spark, d).select(F.col("symbol_id").alias("l_partkey"), forms.alias("forms"))
    lines = table(spark, d, "lineitem").join(told, "l_partkey")
    return lines.select(
        F.col("l_suppkey").cast("string").alias("project"),
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("path"),
        F.element_at("forms", (F.col("l_quantity").cast("int") % F.size("forms") + 1)).alias("word"),
        (F.col("l_linenumber") * 64).cast("long").alias("offset"),
        F.col("l_partkey").alias("symbol_id"),
        (F.col("l_returnflag") != "N").alias("resolved"),
    )


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions from `lineitem`, each of the symbol of its part, resolved unless the return flag is N."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("symbol_id"), (F.col("l_returnflag") != "N").alias("resolved"))
    return lines.join(symbols(spark, d), "symbol_id")


def brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("id")).distinct()


def brand_parents(spark: SparkSession, d: str) -> DataFrame:
    """Brand k lies under brand k div 2."""
    return brands(spark, d).filter("id >= 2").select(F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))


def file_sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("project"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def location_refs(spark: SparkSession, d: str) -> DataFrame:
    """References of known length, one for each line item, 64 characters apart so that they cannot overlap."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.length("p_name").alias("length")), "l_partkey")
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    return lines.select(
        F.col("l_suppkey").cast("string").alias("project"),
        path.alias("path"),
        (F.col("l_linenumber") * 64).cast("long").alias("offset"),
        F.col("length").cast("long").alias("length"),
        F.col("l_partkey").alias("symbol_id"),
        (F.col("l_quantity").cast("int") % 24).cast("long").alias("ahead"),
    )
