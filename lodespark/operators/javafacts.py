"""Facts that span Java files: names resolved over the whole project, implementations, references both ways, relations.

Each file is parsed once (scan.java_trees); everything that needs other files is a join on the parsed rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import graphs, scan
from .links import listed

_TEXTS = "array<string>"


def _bare(name: Column) -> Column:
    """A type's name without type arguments, array brackets and dots of variable arity."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?s)<.*$", ""), r"(\[\]|\.\.\.)", ""))


def _types(trees: DataFrame) -> DataFrame:
    return trees.select(F.col("name").alias("fqn"), "simple", "package")


def resolve(rows: DataFrame, written: str, types: DataFrame) -> DataFrame:
    """rows (package, ...) with resolved: the project's type that the written name means, or null. A full name means itself."""
    bare = rows.withColumn("__bare", _bare(F.col(written)))
    wanted = bare.select(X.simple_name(F.col("__bare")).alias("name"), "package", F.col("__bare").alias("whole")).distinct()
    exact = types.select(F.col("fqn").alias("whole"), F.col("fqn").alias("exact")).distinct()
    near = graphs.resolved(wanted, types).join(exact, "whole", "left")
    named = near.select(F.col("package").alias("__p"), F.col("whole").alias("__w"), F.coalesce("exact", F.when(~F.contains("whole", F.lit(".")), F.col("resolved"))).alias("resolved"))
    return bare.join(named, (F.col("__bare") == F.col("__w")) & (F.col("package") == F.col("__p")), "left").drop("__bare", "__p", "__w")


def tests_by_tree(trees: DataFrame) -> Column:
    return F.contains("path", F.lit("/src/test/")) | F.startswith("path", F.lit("src/test/")) | F.endswith("simple", F.lit("Test"))


def references(trees: DataFrame) -> DataFrame:
    """(name, at, target): the project's types that each type refers to, itself left out."""
    rows = trees.select("name", "package", F.posexplode("references").alias("at", "written"))
    found = resolve(rows, "written", _types(trees)).filter("resolved is not null and resolved <> name")
    return found.groupBy("name", F.col("resolved").alias("target")).agg(F.min("at").alias("at"))


def implementations(trees: DataFrame) -> DataFrame:
    """(name, implementations): the classes and records that implement an interface."""
    rows = trees.filter(F.col("kind").isin("class", "record")).select("name", "package", "ord", F.explode("interfaces").alias("written"))
    found = resolve(rows, "written", _types(trees)).filter("resolved is not null")
    return found.groupBy(F.col("resolved").alias("name")).agg(X.ordered_distinct(F.col("name"), F.col("ord")).alias("implementations"))


def _placed(trees: DataFrame, modules: DataFrame) -> DataFrame:
    """With module (the path of the first module, by ord, that a file lies in, else '') and sourceFolder."""
    own = modules.select(X.normal_path(F.col("path")).alias("module"), F.col("ord").alias("__o")).filter("module <> ''").distinct()
    keys = trees.select("path", F.explode(X.ancestors(F.col("path"), "/")).alias("module")).join(own, "module").groupBy("path").agg(F.min_by("module", "__o").alias("module"))
    folder = F.regexp_extract("path", r"^(.*?src/[^/]+/java)/", 1)
    return trees.join(keys, "path", "left").withColumns({"module": F.coalesce("module", F.lit("")), "sourceFolder": folder})


def project(files: DataFrame, modules: DataFrame) -> DataFrame:
    """One row per Java file's first type, with what the rest of the project says about it."""
    trees = scan.java_trees(files)
    to = references(trees)
    types = trees.select("name", "ord", tests_by_tree(trees).alias("test"))
    tested = to.join(types.select(F.col("name").alias("target"), F.col("test").alias("is_test")), "target").filter("not is_test")
    out = to.groupBy("name").agg(X.ordered_distinct(F.col("target"), F.col("at")).alias("referencedProjectClasses"))
    back = to.join(types.select("name", "ord"), "name").groupBy(F.col("target").alias("name")).agg(X.ordered_distinct(F.col("name"), F.col("ord")).alias("referencedBy"))
    production = tested.groupBy("name").agg(X.ordered_distinct(F.col("target"), F.col("at")).alias("referencedProductionTypes"))
    rows = _placed(trees, modules)
    for part in (out, back, production, implementations(trees)):
        rows = rows.join(part, "name", "left")
    lists = ("referencedProjectClasses", "referencedBy", "referencedProductionTypes", "implementations")
    rows = rows.withColumns({c: listed(c) for c in lists} | {"test": tests_by_tree(trees)})
    suffix = F.when(F.endswith("simple", F.lit("Test")) & (F.length("simple") > 4), F.regexp_replace("name", "Test$", "")).otherwise("")
    tested_class = F.when(F.col("test"), F.coalesce(F.get("referencedProductionTypes", F.lit(0)), suffix)).otherwise("")
    warnings = F.concat(F.array(F.lit("jdt-classpath-incomplete")), F.when(F.col("broken"), F.array(F.lit("jdt-bindings-incomplete"))).otherwise(F.array().cast(_TEXTS)))
    return rows.withColumns({"testedClass": tested_class, "warnings": warnings, "methodCount": F.size("methods")})


def relations(files: DataFrame) -> DataFrame:
    """(kind, source, target, sourceFile, offset, length, line, provider, confidence, ord): targets in the project by their full name, others as written."""
    trees = scan.java_trees(files)
    types = _types(trees)
    own = resolve(trees.select("package", "ord", F.explode("relations").alias("r")).select("package", "ord", "r.*"), "target", types)
    own = own.withColumn("target", F.when(F.col("kind") == "PACKAGE_CONTAINS_TYPE", F.col("target")).otherwise(F.coalesce("resolved", "target")))
    span = ["kind", "source", "target", "sourceFile", "offset", "length", "line", "ord"]
    place = trees.select("name", F.col("path").alias("sourceFile"), "ord", tests_by_tree(trees).alias("test"))
    to = references(trees).join(place, "name")
    missing = [F.lit(None).cast("int").alias(c) for c in ("offset", "length", "line")]
    refer = lambda kind, rows: rows.select(F.lit(kind).alias("kind"), F.col("name").alias("source"), "target", "sourceFile", *missing, "ord")
    production = place.filter("not test").select(F.col("name").alias("target"))
    every = own.select(*span).union(refer("TYPE_REFERENCES_TYPE", to)).union(refer("TEST_REFERENCES_PRODUCTION_TYPE", to.filter("test").join(production, "target", "left_semi")))
    return every.withColumns({"provider": F.lit("syntax-tree"), "confidence": F.lit("source")})


def fields(files: DataFrame) -> DataFrame:
    return scan.java_trees(files).select("ord", F.explode("fields").alias("f")).select("f.*", "ord")


def with_modules(modules: DataFrame, classes: DataFrame, dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """The modules with mainPackages, sourceSets, projectDependencies and externalDependencies. A module without a path has every package."""
    at = X.normal_path(F.col("path"))
    keys = classes.filter("trim(package) <> ''").select(F.explode(F.concat(F.array(F.lit("")), X.ancestors(F.col("path"), "/"))).alias("at"), "package", "ord")
    packages = modules.select("buildFile", at.alias("at")).join(keys, "at").groupBy("buildFile").agg(X.ordered_distinct(F.col("package"), F.col("ord")).alias("mainPackages"))
    inner = dependencies.select(F.col("source").alias("buildFile"), "notation", F.struct("ord", "at").alias("o"), F.contains("notation", F.lit("project(")).alias("own"))
    deps = inner.groupBy("buildFile").agg(X.ordered_distinct(F.when(F.col("own"), F.col("notation")), F.col("o")).alias("projectDependencies"), X.ordered_distinct(F.when(~F.col("own"), F.col("notation")), F.col("o")).alias("externalDependencies"))
    sets = files.select(F.explode(X.ancestors(F.col("path"), "/")).alias("folder")).distinct()
    wanted = modules.select("buildFile", F.posexplode(F.array(F.lit("main/java"), F.lit("test/java"))).alias("k", "set"), at.alias("at")).withColumn("folder", F.concat(F.when(F.col("at") == "", "").otherwise(F.concat("at", F.lit("/"))), F.lit("src/"), "set"))
    sets = wanted.join(sets, "folder", "left_semi").groupBy("buildFile").agg(X.ordered_distinct(F.col("set"), F.col("k")).alias("sourceSets"))
    rows = modules
    for part in (packages, deps, sets):
        rows = rows.join(part, "buildFile", "left")
    return rows.withColumns({c: listed(c) for c in ("mainPackages", "projectDependencies", "externalDependencies", "sourceSets")}).select(*modules.columns, "sourceSets", "mainPackages", "projectDependencies", "externalDependencies")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The last row, by ord, of each key."""
    order = Window.partitionBy(key).orderBy(F.desc("ord"))
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
