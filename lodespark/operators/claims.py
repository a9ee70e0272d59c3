"""Claim verification: each rule is a query that yields rows (id, rule, ord, text) of violations, or of evidence.

Claims have an id, an ord and the rules' lists (schemas.CLAIM_LISTS); a null allowedDependencies or
allowedTargetModules is no rule, an empty one allows nothing. Facts: modules (name, mainPackages, projectDependencies,
externalDependencies, ord), classes (name, path, package, imports, ord), tests (name), docs (path, ord), evidence (type).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import graphs, lineage, sizes
from .links import globs, listed

ROW = ["id", "rule", "ord", "text"]


def _place(*parts: str) -> Column:
    """Nested positions as one sortable array."""
    return F.array(*[F.col(p).cast("long") for p in parts])


def _rules(claims: DataFrame, column: str) -> DataFrame:
    return claims.select("id", F.posexplode(listed(column)).alias("at", "wanted"))


def scoped_modules(claims: DataFrame, modules: DataFrame) -> DataFrame:
    """(id, module columns): the modules of a claim's scope, all of them for an empty one."""
    scope = claims.select("id", F.explode(F.array_distinct(listed("scopeModules"))).alias("name"))
    everywhere = claims.filter(F.size(listed("scopeModules")) == 0).select("id")
    columns = ["id", *[c for c in modules.columns]]
    return modules.join(scope, "name").select(*columns).union(everywhere.crossJoin(modules).select(*columns))


def scoped_classes(claims: DataFrame, modules: DataFrame, classes: DataFrame) -> DataFrame:
    """(class columns, ids): the classes in a main package of some claim's modules, and the ids of those claims; all classes for a claim with an empty scope."""
    named = claims.filter(F.size(listed("scopeModules")) > 0)
    packages = scoped_modules(named, modules).select("id", F.explode("mainPackages").alias("package")).groupBy("package").agg(F.collect_set("id").alias("named"))
    everywhere = claims.filter(F.size(listed("scopeModules")) == 0).agg(F.collect_set("id").alias("everywhere"))
    both = classes.join(sizes.small(packages), "package", "left").crossJoin(F.broadcast(everywhere))
    return both.select(*[classes[c] for c in classes.columns], F.concat(listed("named"), "everywhere").alias("ids")).filter("size(ids) > 0")


#: The lists of forbidden prefixes, with the labels of their violations, in order.
PREFIXES = {"forbiddenReferences": "forbidden-reference", "forbiddenImports": "forbidden-import"}


def with_prefixes(claims: DataFrame, *columns: str) -> DataFrame:
    return claims.filter(X.any_of([F.size(listed(c)) > 0 for c in columns]))


def forbidden_references(claims: DataFrame, modules: DataFrame, classes: DataFrame, *columns: str) -> DataFrame:
    """Imports that start with a forbidden prefix of one of the columns. The imports are read once, and only prefixes that match are set against the scopes."""
    wanted = None
    for n, column in enumerate(columns):
        one = _rules(claims, column).withColumns({"label": F.lit(PREFIXES[column]), "last": F.array(*[F.lit(i).cast("long") for i in range(1, n + 1)]).cast("array<bigint>")})
        wanted = one if wanted is None else wanted.union(one)
    imports = scoped_classes(with_prefixes(claims, *columns), modules, classes).select("ids", "name", "path", F.col("ord").alias("fact"), F.posexplode(listed("imports")).alias("nth", "import"))
    hits = imports.join(sizes.small(wanted), F.expr("startswith(import, wanted) and array_contains(ids, id)"))
    text = F.concat("label", F.lit(":"), "wanted", F.lit(" in "), "name", F.lit(" ("), "path", F.lit(")"))
    return hits.select("id", F.lit(1).alias("rule"), F.concat(_place("fact", "nth", "at"), "last").alias("ord"), text.alias("text"))


def _dependencies(scoped: DataFrame, column: str) -> DataFrame:
    return scoped.select("id", "name", F.col("ord").alias("fact"), F.posexplode(listed(column)).alias("nth", "dep"))


def forbidden_dependencies(claims: DataFrame, scoped: DataFrame) -> DataFrame:
    both = scoped.withColumn("deps", F.concat(listed("externalDependencies"), listed("projectDependencies")))
    hits = _dependencies(both, "deps").join(_rules(claims, "forbiddenDependencies"), "id").filter("contains(dep, wanted)")
    text = F.concat(F.lit("forbidden-dependency:"), "wanted", F.lit(" in module:"), "name", F.lit(" ("), "dep", F.lit(")"))
    return hits.select("id", F.lit(3).alias("rule"), _place("fact", "nth", "at").alias("ord"), text.alias("text"))


def disallowed_dependencies(claims: DataFrame, scoped: DataFrame) -> DataFrame:
    """External dependencies that contain none of the allowed strings."""
    allowed = claims.filter("allowedDependencies is not null").select("id", "allowedDependencies")
    bad = _dependencies(scoped, "externalDependencies").join(allowed, "id").filter(~F.exists("allowedDependencies", lambda a: F.contains(F.col("dep"), a)))
    text = F.concat(F.lit("disallowed-dependency:"), "dep", F.lit(" in module:"), "name")
    return bad.select("id", F.lit(4).alias("rule"), _place("fact", "nth").alias("ord"), text.alias("text"))


def project_name(notation: Column) -> Column:
    single, double = (F.regexp_extract(notation, rf"project\({q}:([^{q}]*){q}\)", 1) for q in ("'", '"'))
    return F.coalesce(F.nullif(single, F.lit("")), F.nullif(double, F.lit("")))


def disallowed_targets(claims: DataFrame, scoped: DataFrame) -> DataFrame:
    allowed = claims.filter("allowedTargetModules is not null").select("id", "allowedTargetModules")
    deps = _dependencies(scoped, "projectDependencies").withColumn("target", project_name(F.col("dep"))).filter("target is not null")
    bad = deps.join(allowed, "id").filter("not array_contains(allowedTargetModules, target)")
    text = F.concat(F.lit("disallowed-target-module:"), "target", F.lit(" from module:"), "name")
    return bad.select("id", F.lit(5).alias("rule"), _place("fact", "nth").alias("ord"), text.alias("text"))


def required(claims: DataFrame, column: str, known: DataFrame, rule: int, missing: str, found: str) -> tuple[DataFrame, DataFrame]:
    """(violations, evidence): a wanted value is there if it is a row of known (value)."""
    rows = _rules(claims, column).join(known.distinct().withColumn("there", F.lit(True)), F.col("wanted") == F.col("value"), "left")
    row = lambda df, label: df.select("id", F.lit(rule).alias("rule"), _place("at").alias("ord"), F.concat(F.lit(f"{label}:"), "wanted").alias("text"))
    return row(rows.filter("there is null"), missing), row(rows.filter("there"), found)


def required_docs(claims: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A glob is satisfied by its first matching path, which is the evidence."""
    rows = claims.select("id", F.posexplode(F.arrays_zip(listed("requiredDocs").alias("wanted"), globs("requiredDocs").alias("glob"))).alias("at", "z")).select("id", "at", "z.wanted", "z.glob")
    hits = docs.select("path", F.col("ord").alias("fact")).join(F.broadcast(rows), F.expr("path rlike glob")).groupBy("id", "at").agg(F.min_by("path", "fact").alias("path"))
    rows = rows.join(hits, ["id", "at"], "left")
    row = lambda df, text: df.select("id", F.lit(9).alias("rule"), _place("at").alias("ord"), text.alias("text"))
    return row(rows.filter("path is null"), F.concat(F.lit("missing-required-doc:"), "wanted")), row(rows.filter("path is not null"), F.concat(F.lit("doc:"), "path"))


def import_cycles(claims: DataFrame, modules: DataFrame, classes: DataFrame) -> DataFrame:
    rows = scoped_classes(claims.filter("mustBeAcyclic"), modules, classes).select(F.explode("ids").alias("group"), "ord", F.col("name").alias("node"), listed("imports").alias("targets"))
    return graphs.back_edges(rows).select(F.col("group").alias("id"), F.lit(10).alias("rule"), F.array("ord").alias("ord"), F.concat(F.lit("import-cycle:"), "cycle").alias("text"))


def has_rules() -> Column:
    lists = ("forbiddenReferences", "forbiddenImports", "forbiddenDependencies", "requiredTests", "requiredEvidenceTypes", "requiredDocs", "verifiedBy")
    return X.any_of([F.size(listed(c)) > 0 for c in lists]) | F.col("allowedDependencies").isNotNull() | F.col("allowedTargetModules").isNotNull() | F.coalesce("mustBeAcyclic", F.lit(False))


def test_names(tests: DataFrame) -> DataFrame:
    """(value): full and simple names."""
    names = tests.filter("trim(name) <> ''")
    return names.select(F.col("name").alias("value")).union(names.select(X.simple_name(F.col("name")))).distinct()


def _found(ruled: DataFrame, modules: DataFrame, classes: DataFrame, tests: DataFrame, docs: DataFrame, evidence: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame]:
    """(violations, evidence, verifiers), rows as ROW. Rules about imports that no claim has don't read the classes."""
    in_modules = lineage.cut(scoped_modules(ruled, modules))  # every rule reads the scopes
    names = test_names(tests)
    missing_verifiers, verifiers = required(ruled, "verifiedBy", names, 6, "missing-verifier-test", "test")
    missing_tests, found_tests = required(ruled, "requiredTests", names, 7, "missing-required-test", "test")
    missing_types, found_types = required(ruled, "requiredEvidenceTypes", evidence.select(F.col("type").alias("value")), 8, "missing-evidence-type", "evidence-type")
    missing_docs, found_docs = required_docs(ruled, docs)
    bad = [forbidden_dependencies(ruled, in_modules), disallowed_dependencies(ruled, in_modules), disallowed_targets(ruled, in_modules), missing_verifiers, missing_tests, missing_types, missing_docs]
    if not with_prefixes(ruled, *PREFIXES).isEmpty():
        bad.append(forbidden_references(ruled, modules, classes, *PREFIXES))
    if not ruled.filter("mustBeAcyclic").isEmpty():
        bad.append(import_cycles(ruled, modules, classes))
    scope = in_modules.filter("trim(name) <> ''").select("id", F.lit(0).alias("rule"), F.array(F.col("ord").cast("long")).alias("ord"), F.concat(F.lit("module:"), "name").alias("text"))
    return bad, [scope, verifiers, found_tests, found_types, found_docs], verifiers


def _every(rows: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [r.select(*ROW) for r in rows])


def _status(violated: Column) -> Column:
    return F.when(~has_rules(), F.coalesce("status", F.lit("unverified"))).when(violated, "failed").otherwise("passed")


def verified(claims: DataFrame, modules: DataFrame, classes: DataFrame, tests: DataFrame, docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims with status, violations, verificationEvidence and matchedVerifiedBy. Without rules a claim keeps its status, or is unverified. A claim's lists are one row; see judged."""
    bad, good, verifiers = _found(claims.filter(has_rules()), modules, classes, tests, docs, evidence)

    def lists(rows: list[DataFrame], name: str) -> DataFrame:
        return _every(rows).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "ord", "text"))), lambda x: x["text"]).alias(name))

    by = verifiers.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: F.substring(x["text"], 6, 1 << 30)).alias("matchedVerifiedBy"))
    rows = claims.drop("violations", "verificationEvidence", "matchedVerifiedBy")
    for part in (lists(bad, "violations"), lists(good, "verificationEvidence"), by):
        rows = rows.join(part, "id", "left")
    return rows.withColumn("status", _status(F.col("violations").isNotNull()))


def judged(claims: DataFrame, modules: DataFrame, classes: DataFrame, tests: DataFrame, docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """The claims with status, as verified gives it, and violations, how many there are. They are counted where they are found; no list of them is made."""
    bad, _, _ = _found(claims.filter(has_rules()), modules, classes, tests, docs, evidence)
    rows = claims.drop("violations").join(_every(bad).groupBy("id").agg(F.count("*").alias("violations")), "id", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return rows.withColumn("status", _status(F.col("violations") > 0))


def error_failures(claims: DataFrame) -> DataFrame:
    """One row (claimFailureCount): failed claims of severity error, which is also what a claim without severity has."""
    return claims.agg(F.count_if((F.col("status") == "failed") & (F.coalesce("severity", F.lit("error")) == "error")).alias("claimFailureCount"))
