"""A snapshot of a repository: eight tables of facts as DataFrames, from files and seeds."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims as C
from ..operators import javafacts, lineage, links, scan
from ..options import Options
from . import files as disk
from . import seeds

TABLES = ("modules", "classes", "tests", "docs", "dependencies", "capabilities", "claims", "evidence")
CAPABILITY_LISTS = ("modules", "packages", "typePatterns", "testPatterns", "docPatterns", "evidenceTypes", "ownerModules", "classes", "tests", "docs", "warnings")
CLAIM_LISTS = (
    "scopeModules", "forbiddenReferences", "forbiddenImports", "forbiddenDependencies", "allowedDependencies", "allowedTargetModules", "verifiedBy", "requiredTests", "requiredEvidenceTypes", "requiredDocs", "implementedBy", "documentedBy",
)


@dataclass
class Snapshot:
    repository: str
    modules: DataFrame
    classes: DataFrame
    tests: DataFrame
    docs: DataFrame
    dependencies: DataFrame
    capabilities: DataFrame
    claims: DataFrame
    evidence: DataFrame
    methods: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}


def seeded(spark: SparkSession, folder: str, name: str, lists: tuple[str, ...], scalars: tuple[str, ...]) -> DataFrame:
    """One row per id, with its lists and scalars, the keys beyond them as extras, and ord; a list that no seed names is null."""
    rows, order = [], {}
    for i, record in enumerate(seeds.seed_records(folder, name)):
        ident = seeds.as_list(record.get("id"))
        if not ident:
            continue
        order.setdefault(ident[0], i)
        for key, value in record.items():
            if key != "id":
                rows.append((ident[0], key, isinstance(value, list), seeds.as_list(value), i))
    merged = links.merged(spark.createDataFrame(rows, "id string, key string, is_list boolean, values array<string>, ord long"))
    one = lambda k: F.max(F.when(F.col("key") == k, F.col("values")))
    known = [one(k).alias(k) for k in lists] + [F.get(one(k), F.lit(0)).alias(k) for k in scalars]
    rest = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("key").isin(*lists, *scalars), F.struct("key", F.array_join("values", ",").alias("value"))))))
    ids = spark.createDataFrame(list(order.items()), "id string, ord long")
    return ids.join(merged.groupBy("id").agg(*known, rest.alias("extras")), "id", "left")


def java(spark: SparkSession, files: DataFrame, modules: DataFrame, provider: str) -> DataFrame:
    rows = scan.java_basic(files) if provider == "basic" else javafacts.project(files, modules)
    rows = rows.withColumnRenamed("methods", "publicApiMethods").drop("fields", "relations", "constructors", "references", "broken")
    return rows if "warnings" in rows.columns else rows.withColumn("warnings", F.array(F.lit("heuristic-line-parser")))


def read(spark: SparkSession, options: Options) -> Snapshot:
    """Each table is cut as soon as it is there: every report reads it, and plans stay small."""
    files = lineage.cut(disk.read_files(spark, options.root, suffixes=".java,.md,.gradle,.gradle.kts,pom.xml,.json,.yml,.yaml"))
    name = os.path.basename(options.root)
    found = scan.modules(files, name)
    dependencies = lineage.cut(scan.gradle_dependencies(files).union(scan.maven_dependencies(files)))
    types = lineage.cut(java(spark, files, found, options.provider))
    methods = scan.java_methods(files)
    listed = types.select(F.col("name").alias("type"), "ord", F.posexplode("publicApiMethods").alias("at", "signature")).select("type", "signature", "ord", "at")
    methods = lineage.cut(scan.merged_methods(listed, methods).filter("cognitiveComplexity is not null"))
    nested = methods.groupBy(F.col("sourceFile").alias("path")).agg(F.array_sort(F.collect_list(F.struct("startLine", "type", "signature", "cyclomaticComplexity", "cognitiveComplexity", "maxNestingDepth", "decisionPointCount"))).alias("methodFacts"))
    types = lineage.cut(types.join(nested, "path", "left"))
    classes, tests = types.filter("not test"), types.filter("test")
    docs, evidence = lineage.cut(scan.documents(files)), lineage.cut(scan.evidence(files))
    modules = lineage.cut(javafacts.with_modules(found, types, dependencies, files))
    capabilities = seeded(spark, options.seeds, "capabilities", CAPABILITY_LISTS, ("label", "status"))
    claims = seeded(spark, options.seeds, "claims", CLAIM_LISTS, ("category", "description", "severity", "status", "mustBeAcyclic"))
    if capabilities.isEmpty():
        capabilities, more = _keywords(spark, classes, tests, docs)
        claims = claims.unionByName(more, allowMissingColumns=True)
    else:
        capabilities = links.linked(capabilities, links.matches(capabilities, modules, classes, tests, docs, evidence))
    capabilities = lineage.cut(capabilities)
    claims = claims.withColumn("mustBeAcyclic", F.coalesce(F.lower("mustBeAcyclic") == "true", F.lit(False)))
    claims = lineage.cut(C.verified(lineage.cut(claims), modules, classes, tests, docs, evidence))
    return Snapshot(name, modules, classes, tests, docs, dependencies, capabilities, claims, evidence, methods)


def _keywords(spark: SparkSession, classes: DataFrame, tests: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The capabilities that are inferred by keyword where no seed names any, and their claims."""
    ids = spark.createDataFrame([(k, i) for i, k in enumerate(links.KEYWORDS)], "id string, ord long")
    whole = lambda df, name: df.select(F.col(name).alias("name"), "ord", F.to_json(F.struct(*[c for c in df.columns if c != "ord"])).alias("text"))
    rows = links.keyword_capabilities(whole(classes, "name"), whole(tests, "name"), whole(docs, "path"), ids)
    none = F.array().cast("array<string>")
    lists = [k for k in CAPABILITY_LISTS if k not in rows.columns]
    capabilities = rows.withColumns({k: none for k in (*lists, *links.LISTS)} | {"label": F.lit(None).cast("string"), "extras": F.lit(None).cast("map<string,string>")})
    claims = rows.select("id", (F.col("ord") + (1 << 40)).alias("ord"), "status", F.col("classes").alias("implementedBy"), F.col("tests").alias("verifiedBy"), F.col("docs").alias("documentedBy"))
    return capabilities, claims
