"""Capability linking: selectors against facts, and the status that follows.

Facts: modules (name, ord), classes and tests (name, package, ord), docs (path, ord), evidence (type, path, ord).
A join on an expanded selector is an equi-join; only globs need a nested loop, and there the seeds are the small side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

NONE = "array()"
#: The keyword capabilities that are inferred when no seed names any.
KEYWORDS = "equality-saturation e-graph macro-rule-learning replay counterexample-search proof-bridge benchmark-report search-strategies assumption-handling rule-inventory".split()


def listed(column: str) -> Column:
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def globs(column: str) -> Column:
    """The selectors' globs as regular expressions, by the same rules as glob_regex."""

    def regex(glob: Column) -> Column:
        quoted = F.regexp_replace(glob, r"([^0-9A-Za-z_/ *-])", r"\\$1")
        marked = F.regexp_replace(F.regexp_replace(quoted, r"\*\*/?", "\u0001"), r"\*", "[^/]*")
        return F.concat(F.lit("^(?s:"), F.replace(marked, F.lit("\u0001"), F.lit(".*")), F.lit(r")\z"))

    return F.transform(listed(column), regex)


def _joined(capabilities: DataFrame, column: str, facts: DataFrame, key: str, value: str) -> DataFrame:
    """(id, value, ord) by equality of a selector and the fact's key."""
    wanted = capabilities.select("id", F.explode(listed(column)).alias("selector")).distinct()
    return facts.join(wanted, F.col(key) == F.col("selector")).select("id", F.col(value).alias("value"), "ord")


def globbed(capabilities: DataFrame, column: str, facts: DataFrame, subject: Column, value: str) -> DataFrame:
    """(id, value, ord) by a glob that matches the whole subject."""
    wanted = capabilities.select("id", F.explode(globs(column)).alias("glob")).distinct()
    wide = facts.select(F.col(value).alias("value"), "ord", subject.alias("subject"))
    return wide.join(F.broadcast(wanted), F.expr("subject rlike glob")).select("id", "value", "ord")


def matches(capabilities: DataFrame, modules: DataFrame, classes: DataFrame, tests: DataFrame, docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, list, value, ord): the rows that each matched list of a capability has, with repetitions."""
    packaged = classes.filter("package is not null")
    place = evidence.withColumn("value", F.when(F.coalesce("path", F.lit("")) == "", F.col("type")).otherwise(F.col("path")))
    parts = {
        "matchedModules": _joined(capabilities, "modules", modules, "name", "name"),
        "matchedPackages": _joined(capabilities, "packages", packaged, "package", "package"),
        "matchedTypes": _joined(capabilities, "packages", packaged, "package", "name").union(globbed(capabilities, "typePatterns", classes, X.simple_name(F.col("name")), "name")),
        "matchedTests": _joined(capabilities, "packages", tests.filter("package is not null"), "package", "name").union(globbed(capabilities, "testPatterns", tests, X.simple_name(F.col("name")), "name")),
        "matchedDocs": globbed(capabilities, "docPatterns", docs, F.col("path"), "path"),
        "matchedEvidence": _joined(capabilities, "evidenceTypes", place, "type", "value"),
    }
    out = None
    for name, df in parts.items():
        one = df.select("id", F.lit(name).alias("list"), "value", "ord")
        out = one if out is None else out.union(one)
    return out


LISTS = ("matchedModules", "matchedPackages", "matchedTypes", "matchedTests", "matchedDocs", "matchedEvidence")


def linked(capabilities: DataFrame, found: DataFrame) -> DataFrame:
    """The capabilities with their matched lists, status and warnings."""
    own = found.groupBy("id").agg(*[X.ordered_distinct(F.when(F.col("list") == k, F.col("value")), F.col("ord")).alias(k) for k in LISTS])
    rows = capabilities.drop(*LISTS, "status").join(own, "id", "left").withColumns({k: listed(k) for k in LISTS})
    some = lambda k: F.size(k) > 0
    rows = rows.withColumn("status", X.status(some("matchedEvidence"), some("matchedTypes"), some("matchedTests"), some("matchedDocs")))
    return rows.withColumn("warnings", F.when(F.col("status") == "unknown", F.concat(listed("warnings"), F.array(F.lit("no-evidence-found")))).otherwise(F.col("warnings")))


def keyword_capabilities(classes: DataFrame, tests: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, status, classes, tests, docs, ord) of keywords (id, ord) found anywhere in a fact's text; facts are (name, text, ord)."""
    out = ids
    for name, df in (("classes", classes), ("tests", tests), ("docs", docs)):
        hit = df.select("name", "ord", X.keyword_key(F.col("text")).alias("key")).join(F.broadcast(ids.select("id", X.keyword_key(F.col("id")).alias("word"))), F.expr("contains(key, word)"))
        rows = hit.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias(name))
        out = out.join(rows, "id", "left").withColumn(name, listed(name))
    return out.withColumn("status", X.keyword_status(*[F.size(k) > 0 for k in ("classes", "tests", "docs")]))


def merged(rows: DataFrame) -> DataFrame:
    """(id, key, is_list, values) of seed rows (id, key, is_list, values, ord), later rows merged into earlier ones.

    A list after a list adds the values that are not there yet (the first list is kept as it is); otherwise the later
    replaces the earlier. Rows without an id are dropped.
    """
    steps = F.array_sort(F.collect_list(F.struct("ord", "is_list", "values")))
    start = F.struct(F.lit(False).alias("l"), F.array().cast("array<string>").alias("v"), F.lit(True).alias("first"))
    both = lambda a, s: ~a["first"] & a["l"] & s["is_list"]
    new = lambda a, s: F.array_distinct(F.filter(s["values"], lambda x: ~F.array_contains(a["v"], x)))
    fold = lambda a, s: F.struct(s["is_list"].alias("l"), F.when(both(a, s), F.concat(a["v"], new(a, s))).otherwise(s["values"]).alias("v"), F.lit(False).alias("first"))
    done = rows.filter("id is not null and id <> ''").groupBy("id", "key").agg(F.aggregate(steps, start, fold).alias("a"))
    return done.select("id", "key", F.col("a.l").alias("is_list"), F.col("a.v").alias("values"))
