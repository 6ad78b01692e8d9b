"""Secret scanning with a random forest that removes false findings.

Patterns find candidates, with what stands before and after them. Each candidate is described by its length, its
character transitions, how much of it a dictionary of the surrounding prose covers, its path and its neighbouring words,
and a random forest, trained from labelled findings, scores it. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.llm.common import remainder

TREES = 24
DEPTH = 6
#: The forest is fitted on at most so many labelled findings, taken by a hash.
LABELLED = 50_000
#: Characters that a finding's neighbourhood reaches.
NEAR = 60
#: A word of the neighbourhoods belongs to the dictionary from so many of them on.
DICTIONARY = 5
THRESHOLD = 0.5
SEED = 7

#: Names that a credential is assigned to, and words beside findings that speak for or against one.
NAMES = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "auth", "key")
DUMMY = ("example", "dummy", "sample", "placeholder", "your", "changeme", "xxxx", "test", "fake")
DIGESTS = ("commit", "sha", "md5", "checksum", "digest", "hash", "etag", "uuid", "guid", "revision")
CONTACT = ("mail", "phone", "call", "card", "account", "iban", "invoice", "order", "isbn", "tel")

#: How tokens of well-known services begin; one after `bearer` counts as well.
KNOWN = r"^(gh[pousr]_|github_pat_|glpat-|AKIA|ASIA|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|ya29|npm_|eyJ)[A-Za-z0-9_.+/=-]{12,}$"

_NAME = f"(?i:{'|'.join(NAMES)})"
_TO = r"""["']?\s{0,2}[:=]\s{0,2}["']?"""
_VALUE = r"""[^\s"',;]{6,}"""
_KEYED = rf"""(?<=[:=\s"'])(?<=[:=]\s{{0,2}}["']?)(?<={_NAME}{_TO}){_VALUE}"""
_LONG = rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?![A-Za-z0-9_-]*+(?<={_NAME})={_VALUE})[A-Za-z0-9+/_=-]{{16,}}"
#: A match is the value assigned to a name that ends in a credential's (dbPassword, API_KEY), or a long run with a digit
#: that does not begin with such a name and its `=`. What stands before a value is looked at nearest first, so that few places of a text are tried.
CANDIDATE = f"{_KEYED}|{_LONG}"
#: A text without this holds no candidate.
_HINT = r"[0-9]|[:=]"


def _any(words: tuple[str, ...]) -> str:
    return "(?i)(" + "|".join(words) + ")"


def candidates(docs: DataFrame) -> DataFrame:
    """A row for each candidate: doc_id, path, ordinal (in its text), start, found, before, after.

    Null and empty texts have none; repeated rows give theirs each. `source` is the path, empty where there is none.
    """
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike(_HINT)).filter(F.col("text").rlike(CANDIDATE))
    cut = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE).alias("gaps"))
    steps = F.zip_with("found", "gaps", lambda f, g: F.coalesce(F.length(f), F.lit(0)) + F.length(g))
    starts = F.aggregate(steps, F.array(F.lit(0)), lambda seen, n: F.array_append(seen, F.element_at(seen, -1) + n))
    one = F.transform(
        "found",
        lambda f, i: F.struct(
            f.alias("found"),
            F.substring(F.get("gaps", i), -NEAR, NEAR).alias("before"),
            F.substring(F.get("gaps", i + 1), 1, NEAR).alias("after"),
            (F.get("starts", i) + F.length(F.get("gaps", i))).alias("start"),
        ),
    )
    return (
        cut.withColumn("starts", starts)
        .select("doc_id", "path", one.alias("all"))
        .select("doc_id", "path", F.posexplode("all").alias("ordinal", "one"))
        .select("doc_id", "path", "ordinal", "one.start", "one.found", "one.before", "one.after")
    )


def _share(text: str, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _covered(found: DataFrame) -> DataFrame:
    """Adds `covered`: the share of the finding's characters in words of three letters or more of the dictionary.

    The dictionary is the words that stand beside findings anywhere in the corpus at least DICTIONARY times.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
    beside = found.select(F.explode(words(F.concat_ws(" ", "before", "after"))).alias("word"))
    dictionary = beside.groupBy("word").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= DICTIONARY).select("word")
    kinds = found.select("found").distinct()
    parts = kinds.select("found", F.explode(words(F.col("found"))).alias("word"))
    sums = parts.join(dictionary, "word").groupBy("found").agg(F.sum(F.length("word")).alias("letters"))
    return found.join(sums, "found", "left").withColumn("covered", F.coalesce(F.col("letters") / F.length("found"), F.lit(0.0))).drop("letters")


FEATURES = (
    "log_length", "transitions", "alternations", "digits", "upper", "hex", "symbols", "distinct", "entropy", "covered",
    "known", "named", "assigned", "quoted", "dummy", "dummy_near", "digest", "contact", "near_digits", "path_depth", "path_test", "path_findings",
)


def described(found: DataFrame) -> DataFrame:
    """Adds FEATURES, all doubles, to candidates."""
    n = F.length("found")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("found", "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0"), "[^aB0]", "-")
    runs = F.length(F.regexp_replace(classes, r"(.)\1*", "x"))
    sounds = F.regexp_replace(F.regexp_replace(F.lower("found"), "[^a-z]", ""), "[aeiouy]", "1")
    turns = F.length(F.regexp_replace(F.regexp_replace(sounds, "[a-z]", "0"), r"(.)\1*", "x"))
    letters = F.split("found", "")
    different = F.array_distinct("letters")
    bits = F.aggregate(different, F.lit(0.0), lambda total, c: total - F.size(F.filter("letters", lambda x: x == c)) / n * F.log2(F.size(F.filter("letters", lambda x: x == c)) / n))
    per_path = found.groupBy("path").agg(F.count(F.lit(1)).alias("per_path"))
    rows = _covered(found).join(per_path, "path", "left").withColumn("letters", F.filter(letters, lambda x: x != ""))
    flag = lambda c: c.cast("double")
    near = F.concat_ws(" ", F.substring("before", -NEAR, NEAR), "after")
    values = {
        "log_length": F.log1p(n),
        "transitions": runs / n,
        "alternations": turns / n,
        "digits": _share("found", "[0-9]"),
        "upper": _share("found", "[A-Z]"),
        "hex": _share("found", "[0-9a-f]"),
        "symbols": _share("found", "[^A-Za-z0-9]"),
        "distinct": F.size(different) / n,
        "entropy": bits,
        "known": flag(F.col("found").rlike(KNOWN) | (F.col("before").rlike(r"(?i)\bbearer\s{1,2}$") & F.col("found").rlike("[0-9]"))),
        "named": flag(F.col("before").rlike(_any(NAMES) + r"\W{0,6}$")),
        "assigned": flag(F.col("before").rlike(r"""[:=]\s*["']?$""")),
        "quoted": flag(F.col("before").rlike("""["']$""") & F.col("after").rlike("""^["']""")),
        "dummy": flag(F.col("found").rlike(_any(DUMMY))),
        "dummy_near": flag(near.rlike(_any(DUMMY))),
        "digest": flag(near.rlike(_any(DIGESTS))),
        "contact": flag(near.rlike(_any(CONTACT))),
        "near_digits": F.length(F.regexp_replace(near, "[^0-9]", "")) / (1 + F.length(near)),
        "path_depth": F.length(F.regexp_replace("path", "[^/]", "")),
        "path_test": flag(F.col("path").rlike(_any((*DUMMY, "doc", "spec")))),
        "path_findings": F.log1p(F.coalesce("per_path", F.lit(0))),
    }
    return rows.select(*found.columns, "covered", *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in values.items()))


def labelled_by_rule(rows: DataFrame) -> DataFrame:
    """Candidates with a label where no reviewed ones are at hand; null where the rule cannot judge.

    1: a known token, or a value of high entropy assigned to a credential's name, which unquoted must mix letters and
    other characters, if no dummy word is in it or, for assigned ones, beside it. 0: a value with a dummy word in it, an
    assigned one of low entropy, and what has neither a name nor a known form and is without letters, mostly words of the
    dictionary, or beside words of digests and contacts.
    """
    mixed = (F.col("quoted") > 0) | ((F.col("digits") + F.col("symbols") > 0) & F.col("found").rlike("[A-Za-z]"))
    given = (F.col("named") > 0) & (F.col("assigned") > 0)
    real = (F.col("known") > 0) | given & (F.col("entropy") >= 2.5) & mixed & (F.col("dummy_near") == 0)
    bare = (F.col("known") == 0) & (F.col("named") == 0)
    other = bare & (~F.col("found").rlike("[A-Za-z]") | (F.col("covered") >= 0.5) | (F.col("digest") > 0) | (F.col("contact") > 0))
    false = (F.col("dummy") > 0) | given & (F.col("known") == 0) & (F.col("entropy") < 2.5) | other
    return rows.withColumn("label", F.when(false, 0.0).when(real, 1.0))


#: The rule says nothing of quotes or of dummy words around a value, so a forest taught by it does not look at them.
UNTAUGHT = ("quoted", "dummy_near")


def scan(docs: DataFrame, labelled: DataFrame | None = None, *, trees: int = TREES, depth: int = DEPTH, most: int = LABELLED, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """A row for each candidate: doc_id, ordinal, start, length, shown, sha256, held_out, score, is_secret.

    `labelled` has reviewed findings as doc_id, ordinal and label (0 or 1; null labels are left out); without it a rule
    gives the labels of those it can judge, and known tokens without a dummy word are secrets whatever their score. The forest learns from documents whose crc32(doc_id as text) mod 5 is not 0. Where the labels are
    all alike or there are none, the score is their share of 1, or 0; findings
    that the rule cannot judge then have 0. The finding itself is shown by four characters and
    its digest only. Ties of position cannot occur: candidates of a text do not overlap.
    """
    rows = described(candidates(docs).persist(StorageLevel.MEMORY_AND_DISK)).withColumn("held_out", remainder(F.col("doc_id"), 5) == 0).persist(StorageLevel.MEMORY_AND_DISK)
    if labelled is None:
        rows = labelled_by_rule(rows)
        learning = rows.filter("label is not null")
        used = [f for f in FEATURES if f not in UNTAUGHT]
        sure, unjudged = (F.col("known") > 0) & (F.col("dummy") == 0), F.col("label").isNull()
    else:
        used = list(FEATURES)
        sure, unjudged = F.lit(False), F.lit(False)
        marks = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ordinal").cast("int").alias("ordinal"), F.col("label").cast("double").alias("label"))
        learning = rows.join(marks.filter("label is not null").dropDuplicates(["doc_id", "ordinal"]), ["doc_id", "ordinal"])
    learning = learning.filter("not held_out")
    fitted = learning.orderBy(F.xxhash64("doc_id", "ordinal", "found", F.lit(seed)), "doc_id", "ordinal").limit(most).select("label", *FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    seen = fitted.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    if not seen["n"] or seen["share"] in (0.0, 1.0):
        scored = rows.withColumn("score", F.when(unjudged, 0.0).otherwise(F.lit(float(seen["share"] or 0.0))))
    else:
        gather = VectorAssembler(inputCols=used, outputCol="features")
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=64)
        model = forest.fit(gather.transform(fitted).select("label", "features"))
        scored = model.transform(gather.transform(rows)).withColumn("score", F.element_at(vector_to_array("probability"), 2))
    return scored.select(
        "doc_id",
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("start").cast("long").alias("start"),
        F.length("found").alias("length"),
        F.substring("found", 1, 4).alias("shown"),
        F.sha2(F.col("found").cast("binary"), 256).alias("sha256"),
        "held_out",
        "score",
        ((F.col("score") >= threshold) | sure).alias("is_secret"),
    )
