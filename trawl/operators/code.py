"""Occurrences in source code: the profile `scala` of extraction.

Files are cut into tokens by one ordered pattern that covers every character, so comments, strings and numbers are tokens
whose inside is no code. What a name is follows from windows over a file's tokens: the tokens beside it, the depth of
brackets, and states carried forward by last(..., ignorenulls): the header that a token stands in, kept for each depth,
and stretches whose names are not told. A file is dealt to one task and sorted by place and by depth, never shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.sources.tables import dealt_by_file

NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
SIGNS = r"[!#%&*+\-/:<=>?@\\^|~]"
#: Comments, strings (interpolated ones with their prefix), characters, names in backquotes, names, numbers, signs, breaks,
#: blanks, and any other character.
TOKEN = "|".join(
    [
        r"/\*[\s\S]*?(?:\*/|\z)",
        r"//[^\n]*",
        rf'(?:{NAME})?"""[\s\S]*?(?:"""|\z)',
        rf'(?:{NAME})?"[^"\n]*"',
        r"'[^'\n]{1,2}'",
        r"`[^`\n]+`",
        rf"[\p{{L}}_$][\p{{L}}\p{{N}}_$]*_{SIGNS}+",
        NAME,
        r"[0-9][\p{L}\p{N}_]*",
        rf"{SIGNS}+",
        r"\n",
        r"[^\S\n]+",
        r"[\s\S]",
    ]
)
#: Inside an interpolated string: a name after a sign, an opened or closed expression, a name, and what is left.
INNER = rf"\$\$|\$\{{|\}}|\${NAME}|{NAME}|[^\p{{L}}_$}}]+|[\s\S]"

#: The words and signs of the language that name nothing.
KEYWORDS = """abstract case catch class def do else extends false final finally for forSome if implicit import lazy macro match
new null object override package private protected return sealed super this throw trait try true type val var while with yield _""".split()
RESERVED = [":", "=", "=>", "<-", "<:", "<%", ">:", "#", "@"]

HEADERS = {"def": "def", "class": "class", "trait": "class", "object": "object", "val": "val", "var": "val", "new": "new", "extends": "super", "import": "import", "type": "type"}
DECLARES = ["def", "class", "trait", "object", "val", "var", "type"]
#: What ends a header: a body, the end of a statement, or an expression.
ENDS = ["=", "{", ";", "=>", "<-", "package", *"case catch do else finally for if match return throw try while yield".split()]
#: A line that begins with one of these goes on with the one before, and so does one after such a token.
GOES_ON = ["with", "extends", "{", ")", "]", "(", "[", ".", ",", "=", ":", "=>"]
OPEN_AFTER = ["with", "extends", ",", ".", "=", ":", "=>", "<-", "new", "def", "class", "trait", "object", "val", "var", "(", "[", "{"]
FILE = ["project", "path"]


def _at(prior: bool = True) -> Window:
    order = Window.partitionBy(*FILE).orderBy("pos")
    return order.rowsBetween(Window.unboundedPreceding, -1) if prior else order


def tokens(sources: DataFrame) -> DataFrame:
    """project, path, pos, token, offset (code points), line_no and line_start of every token that is not blank or comment."""
    masked = F.replace(F.replace("content", F.lit("\\\\"), F.lit("\x01\x01")), F.lit('\\"'), F.lit("\x01\x01"))
    masked = F.replace(masked, F.lit("\\'"), F.lit("\x01\x01"))
    dealt = dealt_by_file(sources.filter("content is not null")).select(*FILE, masked.alias("content"))
    cut = dealt.select(*FILE, F.posexplode(F.regexp_extract_all("content", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    last = F.length("token") - F.length(F.substring_index("token", "\n", -1))
    offset = F.coalesce(F.sum(F.length("token")).over(_at()), F.lit(0)).cast("long")
    placed = cut.withColumn("offset", offset).withColumn("breaks", breaks)
    lined = placed.select(
        *FILE,
        "pos",
        "token",
        "offset",
        (1 + F.coalesce(F.sum("breaks").over(_at()), F.lit(0))).cast("long").alias("line_no"),
        F.coalesce(F.max(F.when(F.col("breaks") > 0, F.col("offset") + last)).over(_at()), F.lit(0)).cast("long").alias("line_start"),
    )
    return lined.filter(~F.col("token").rlike(r"^(\s|//|/\*)"))


def _named() -> Column:
    """Whether the token is a name: a word or signs with no other meaning, or a name in backquotes."""
    t = F.col("token")
    word = t.rlike(rf"^({NAME}|[\p{{L}}_$][\p{{L}}\p{{N}}_$]*_{SIGNS}+|`[^`]+`)$") & ~t.isin(*KEYWORDS)
    return word | (t.rlike(rf"^{SIGNS}+$") & ~t.isin(*RESERVED))


def _with_context(found: DataFrame) -> DataFrame:
    """Adds the tokens before and after, the depth of brackets around, and the states that names are judged by."""
    t, order = F.col("token"), _at(False)
    opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    near = found.select(
        "*",
        F.lag("token", 1, "").over(order).alias("before"),
        F.lead("token", 1, "").over(order).alias("after"),
        F.coalesce(F.col("line_no") > F.lag("line_no").over(order), F.lit(True)).alias("fresh"),
        (F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.when(opens, 1).otherwise(0)).alias("depth"),
        F.when(t.isin(*DECLARES), t).alias("declaring"),
        F.when(~_named() & ~t.isin("[", "]", "(", ")", "."), t).alias("other"),
    )
    level = Window.partitionBy(*FILE, "depth").orderBy("pos")
    prior = level.rowsBetween(Window.unboundedPreceding, -1)
    # what comes next is looked up in the same order: no sort from the other end, and no frame summed anew for every row
    upcoming = lambda name: F.expr(f"lead({name}, 1) ignore nulls").over(level)
    header = F.element_at(F.create_map(*[F.lit(x) for pair in HEADERS.items() for x in pair]), t)
    begins = F.col("before").isin("(", "[", "{") | (F.col("fresh") & ~t.isin(*GOES_ON) & ~F.col("before").isin(*OPEN_AFTER))
    selectors = (t == "{") & (F.col("before") == ".")  # of an import
    event = F.coalesce(header, F.when((begins | t.isin(*ENDS)) & ~selectors, "none"))
    # a name that begins a block or a line stands in no header; a bracket there is judged by the header before it
    plain = begins & header.isNull() & ~closes
    kind = F.when(plain, F.lit("none")).otherwise(F.last(F.when(event.isNotNull(), F.struct(event.alias("kind"), "pos")), ignorenulls=True).over(prior)["kind"])
    since = F.last(F.when(event.isNotNull(), F.col("pos")), ignorenulls=True).over(prior)
    colon = F.last(F.when(t == ":", F.col("pos")), ignorenulls=True).over(prior)
    ahead = near.select(
        *(c for c in near.columns if c not in ("declaring", "other")),
        F.coalesce(kind, F.lit("none")).alias("header"),
        F.coalesce(F.last(F.when(event.isNotNull(), event), ignorenulls=True).over(prior), F.lit("none")).alias("was"),
        F.coalesce(colon > since, F.lit(False)).alias("typed"),
        upcoming("declaring").alias("declares"),
        upcoming("other").alias("follows"),
    )
    own = F.col("was").isin("def", "class")
    type_ends = (F.col("was") == "def") & F.col("typed") & (t.isin("=", "{", "}", ";") | t.isin(*DECLARES) | (F.col("header") == "none"))
    stretch = (
        F.when((t == "[") & own & ~F.col("typed"), "untold")
        .when((t == "]") & own & ~F.col("typed"), "told")
        .when((t == ":") & (F.col("was") == "def") & ~F.col("typed"), "untold")
        .when(type_ends, "told")
        .when((t == "{") & (F.col("was") == "import"), "untold")
        .when((t == "}") & (F.col("was") == "import"), "told")
        .when((t == "@") & (F.col("declares") != "def"), "untold")
        .when(t.isin(*DECLARES), "told")
    )
    list_ = F.when(own & ~F.col("typed") & t.isin("(", ")"), F.struct((t == "(").alias("open"), "depth"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return ahead.select("*", F.last(stretch, ignorenulls=True).over(upto).alias("state"), F.last(list_, ignorenulls=True).over(upto).alias("list"))


def code_occurrences(sources: DataFrame) -> DataFrame:
    """project, path, word, offset, kind, is_super, line_no, line_start of the mentions of names in source code.

    Declarations are the names after def, val, var, class, trait and object, parameters, and `<init>` at a class's name
    and at `def this`; all other names are references, with `<init>` at every `new`. A reference is in a super position
    in the parent list of a class, trait, object or anonymous class, but not in type or other arguments there. Not told
    are type parameters, a method's declared type, annotations of classes and values, what an import selects, the name of
    a type alias or of a self type, and whatever stands in comments and strings but for the expressions of interpolated
    ones. A list of parameters ends with the next list inside a default value. Broken code gives the rows of the tokens it has; null contents give none.
    """
    found = tokens(sources)
    t, before, after = F.col("token"), F.col("before"), F.col("after")
    seen = _with_context(found)
    state, listed = F.coalesce("state", F.lit("told")), F.coalesce("list.open", F.lit(False))
    parameter = listed & (F.col("depth") == F.col("list.depth") + 1) & (after == ":") & (before != ":")
    value = (F.col("header") == "val") & ~F.col("typed") & (before == ",")
    declared = before.isin("def", "val", "var", "class", "trait", "object") | parameter | value
    self_name = (before == "{") & after.isin(":", "=>")
    lambda_name = (after == "=>") & before.isin("{", "(") & ~listed
    skipped = (state == "untold") | (before == "type") | ((F.col("header") == "import") & (after != ".")) | (self_name & (after == ":"))
    anonymous = (F.col("header") == "new") & ((before == "with") | (before.isin("new", ".") & F.col("follows").isin("{", "with")))
    parent = ((F.col("header") == "super") & ~declared) | (anonymous & ~declared)
    word = F.replace(t, F.lit("`"), F.lit(""))
    told = lambda w, kind, sup: F.struct(w.alias("word"), F.lit(0).alias("shift"), F.lit(kind).alias("kind"), sup.alias("is_super"))
    init = F.lit("<init>")
    no = F.lit(False)
    rows = (
        F.when((t == "new") & (state != "untold"), F.array(told(init, "Reference", no)))
        .when((t == "this") & (before == "def"), F.array(told(init, "Declaration", no)))
        .when(t.rlike(rf'^{NAME}"') & (state != "untold"), F.array(told(F.regexp_extract(t, rf"^({NAME})", 1), "Reference", no)))
        .when(~_named() | F.coalesce(skipped, no), F.lit(None))
        .when((before == "class"), F.array(told(word, "Declaration", no), told(init, "Declaration", no)))
        .when(F.coalesce(declared | lambda_name, no), F.array(told(word, "Declaration", no)))
        .otherwise(F.array(told(word, "Reference", F.coalesce(parent, no))))
    )
    place = ["line_no", "line_start"]
    main = seen.select(*FILE, "offset", *place, F.explode(rows).alias("r")).select(*FILE, "r.word", "offset", "r.kind", "r.is_super", *place)
    return main.unionByName(_interpolated(sources.filter(F.col("content").contains('"') & F.col("content").contains("$")), place))


def _interpolated(sources: DataFrame, place: list[str]) -> DataFrame:
    """References in interpolated strings: a second cut of these tokens alone, offsets carried on from the token's."""
    texts = tokens(sources).filter(F.col("token").rlike(rf'^{NAME}"') & F.col("token").contains("$"))
    parts = texts.select(*FILE, "pos", "offset", *place, F.posexplode(F.regexp_extract_all("token", F.lit(INNER), F.lit(0))).alias("i", "part"))
    order = Window.partitionBy(*FILE, "pos").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    p = F.col("part")
    inside = F.coalesce(F.last(F.when(p == "${", True).when(p == "}", False), ignorenulls=True).over(order), F.lit(False))
    at = F.col("offset") + F.coalesce(F.sum(F.length("part")).over(order), F.lit(0))
    placed = parts.select(*FILE, *place, "part", at.alias("at"), inside.alias("inside"))
    short = p.rlike(rf"^\${NAME}$") & ~p.startswith("$$")
    name = F.when(short, F.substr(p, F.lit(2))).when(F.col("inside") & p.rlike(rf"^{NAME}$"), p)
    rows = placed.select(*FILE, name.alias("word"), (F.col("at") + F.when(short, 1).otherwise(0)).cast("long").alias("offset"), F.lit("Reference").alias("kind"), F.lit(False).alias("is_super"), *place)
    return rows.filter(F.col("word").isNotNull() & ~F.col("word").isin(*KEYWORDS))
