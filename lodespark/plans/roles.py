"""The driver's tables in the roles of facts, as DataFrames and as SQL, and literal tables in both forms.

part plays the classes, supplier the tests, documents the docs, events the evidence, and lineitem the method metrics and
imports. Seeds, claims, profiles and source files are literals.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from ..operators import sizes


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _sql(value: Any, kind: T.DataType) -> str:
    if value is None:
        return "null"
    if isinstance(kind, T.ArrayType):
        return "[" + ", ".join(_sql(x, kind.elementType) for x in value) + "]"
    if isinstance(kind, T.StringType):
        return "'" + value.replace("'", "''") + "'"
    return str(value).lower() if isinstance(value, bool) else repr(value)


_TYPES = {T.StringType: "varchar", T.LongType: "bigint", T.IntegerType: "integer", T.DoubleType: "double", T.BooleanType: "boolean"}


def _type(kind: T.DataType) -> str:
    return _type(kind.elementType) + "[]" if isinstance(kind, T.ArrayType) else _TYPES[type(kind)]


def _parsed(kind: str) -> T.DataType:
    """The type of a schema's word, without the session that Spark's own parser needs."""
    if kind.startswith("array<"):
        return T.ArrayType(_parsed(kind[6:-1]))
    return {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}[kind]


class Literal:
    """A small table that is written down: df() for Spark, sql as a common table expression."""

    def __init__(self, name: str, schema: str, *rows: tuple) -> None:
        self.name, self.rows = name, rows
        self.schema = T.StructType([T.StructField(n, _parsed(k)) for n, k in (c.split() for c in schema.split(", "))])

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        names = ", ".join(f.name for f in self.schema)
        casts = ", ".join(f"cast({f.name} as {_type(f.dataType)}) as {f.name}" for f in self.schema)
        rows = ", ".join("(" + ", ".join(_sql(v, f.dataType) for v, f in zip(r, self.schema, strict=True)) + ")" for r in self.rows)
        return f"{self.name} as (select {casts} from (values {rows}) v({names}))"


MODULES = Literal("modules", "name string, path string, ord long", ("root", "", 1), ("ECONOMY", "economy", 2), ("SMALL", "small", 3), ("LARGE", "./large/", 4), ("PROMO", "promo", 5))
CAPABILITIES = Literal(
    "capabilities",
    "id string, ord long, modules array<string>, packages array<string>, typePatterns array<string>, testPatterns array<string>, docPatterns array<string>, evidenceTypes array<string>, classes array<string>, ownerModules array<string>",
    ("economy", 1, ["ECONOMY"], ["economy.brand2", "economy.brand17"], [], [], ["docs/src1/*"], [], ["economy.brand2.Part0", "economy.none.Missing"], []),
    ("promotions", 2, ["PROMO", "GONE"], [], ["Part1*"], ["Supplier*Test"], [], [], [], ["PROMO"]),
    ("large", 3, ["LARGE"], [], [], [], ["docs/**"], ["purchase", "refund"], [], []),
    ("everything-else", 4, ["root"], [], [], ["*9Test"], [], [], [], []),
    ("small-things", 5, [], ["small"], ["Part?"], [], ["docs/src*/1.md"], [], [], []),
    ("ghost", 6, ["NOWHERE"], ["no.such"], ["Nothing*"], [], ["notes/*"], ["never"], [], []),
    ("blank", 7, [], [], [], [], [], [], [], []),
)
CLAIMS = Literal(
    "claims",
    "id string, ord long, category string, status string, severity string, scopeModules array<string>, forbiddenReferences array<string>, forbiddenDependencies array<string>, allowedDependencies array<string>, "
    "allowedTargetModules array<string>, verifiedBy array<string>, requiredTests array<string>, requiredEvidenceTypes array<string>, requiredDocs array<string>, implementedBy array<string>",
    ("no-first-suppliers", 1, "layers", None, "error", ["ECONOMY", "SMALL"], ["supply.Supplier1"], [], None, None, [], [], [], [], []),
    ("own-suppliers", 2, "layers", None, None, ["LARGE"], [], ["guava"], ["jackson", "junit"], ["core"], [], [], [], [], []),
    ("tested", 3, "tests", None, "warning", [], [], [], None, None, ["supply.Supplier1Test", "Supplier2Test", "NoSuchTest"], ["Supplier3Test"], [], [], ["economy.brand2.Part0"]),
    ("documented", 4, "docs", None, "error", [], [], [], None, None, [], [], ["purchase", "view"], ["docs/src3/*.md", "docs/**"], []),
    ("undocumented", 5, "docs", None, None, [], [], [], None, None, [], [], ["never"], ["notes/*"], []),
    ("nothing-allowed", 6, "layers", None, "error", ["SMALL"], [], [], [], None, [], [], [], [], []),
    ("unruled", 7, "other", None, None, [], [], [], None, None, [], [], [], [], []),
    ("trusted", 8, "other", "accepted", None, [], [], [], None, None, [], [], [], [], []),
)
DEPENDENCIES = Literal(
    "dependencies", "name string, projectDependencies array<string>, externalDependencies array<string>",
    ("root", [], ["api junit:junit:4"]), ("ECONOMY", ["implementation project(':core')"], ["implementation com.google:guava:33"]), ("SMALL", ["api project(\":core\")", "api project(':util')"], ["implementation org.jackson:jackson:2", "api log:log:1"]),
    ("LARGE", ["implementation project(':core')", "implementation project(':ui')"], ["implementation com.google:guava:33", "testImplementation junit:junit:4"]), ("PROMO", [], []),
)


def classes(spark: SparkSession, d: str) -> DataFrame:
    """(name, simple, package, module, path, lines, ord)."""
    package = F.concat_ws(".", F.lower("p_type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    simple = F.concat(F.lit("Part"), F.col("p_partkey").cast("string"))
    rows = table(spark, d, "part").select(package.alias("package"), simple.alias("simple"), F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).otherwise("").alias("module"), F.col("p_size").alias("lines"), F.col("p_partkey").alias("ord"))
    return rows.select(F.concat_ws(".", "package", "simple").alias("name"), "simple", "package", "module", F.concat(F.replace("package", F.lit("."), F.lit("/")), F.lit("/"), "simple", F.lit(".java")).alias("path"), "lines", "ord")


CLASSES = """classes as (select package || '.' || simple as name, simple, package, module, replace(package, '.', '/') || '/' || simple || '.java' as path, lines, ord from
  (select lower(p_type) || '.' || lower(replace(p_brand, '#', '')) as package, 'Part' || p_partkey as simple, case when p_type = 'ECONOMY' then p_type else '' end as module, p_size as lines, p_partkey as ord from part))"""


def tests(spark: SparkSession, d: str) -> DataFrame:
    """(name, simple, package, path, lines, ord); lines is the account balance in thousands."""
    simple = F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string"), F.lit("Test"))
    return table(spark, d, "supplier").select(
        F.concat(F.lit("supply."), simple).alias("name"), simple.alias("simple"), F.lit("supply").alias("package"), F.concat(F.lit("supply/src/test/java/supply/"), simple, F.lit(".java")).alias("path"),
        F.floor(F.col("s_acctbal") / 1000).cast("int").alias("lines"), F.col("s_suppkey").alias("ord"),
    )


TESTS = """tests as (select 'supply.' || simple as name, simple, 'supply' as package, 'supply/src/test/java/supply/' || simple || '.java' as path, lines, ord from
  (select 'Supplier' || s_suppkey || 'Test' as simple, cast(floor(s_acctbal / 1000) as integer) as lines, s_suppkey as ord from supplier))"""


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(path, name, title, text, lines, ord); the title is the first line."""
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, d, "documents").select(path.alias("path"), path.alias("name"), F.get(F.split("text", X.NEWLINE), F.lit(0)).alias("title"), "text", X.line_count(F.col("text")).alias("lines"), F.col("doc_id").alias("ord"))


_LINES = r"string_split_regex(text, '\r\n|\n|\r')"
DOCS = f"docs as (select 'docs/' || source || '/' || doc_id || '.md' as path, path as name, {_LINES}[1] as title, text, len({_LINES}) as lines, doc_id as ord from documents)"


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """(type, path, ord): the users' kinds of events."""
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("type"), "user_id").agg(F.min("event_id").alias("ord"))
    return rows.select("type", F.concat(F.lit("events/"), "type", F.lit("/"), F.col("user_id").cast("string")).alias("path"), "ord")


EVIDENCE = "evidence as (select type, 'events/' || type || '/' || user_id as path, ord from (select event_type as type, user_id, min(event_id) as ord from events group by 1, 2))"


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """(l_partkey, l_suppkey) of the line items, a part's in one partition; as keys they move once."""
    pairs = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    return pairs.repartition(sizes.partitions(pairs), "l_partkey")


_SUPPLIER = lambda key: F.concat(F.lit("supply.Supplier"), key.cast("string"))


def references(spark: SparkSession, d: str) -> DataFrame:
    """(name, target): a part refers to the suppliers that it was ordered from."""
    named = classes(spark, d).select(F.col("ord").alias("l_partkey"), "name")
    return _ordered(spark, d).distinct().join(named.hint("merge"), "l_partkey").select("name", _SUPPLIER(F.col("l_suppkey")).alias("target"))


REFERENCES = "refs as (select c.name, 'supply.Supplier' || l_suppkey as target from (select distinct l_partkey, l_suppkey from lineitem) join classes c on c.ord = l_partkey)"


def importing_classes(spark: SparkSession, d: str) -> DataFrame:
    """The classes with imports, sorted."""
    keys = _ordered(spark, d).groupBy(F.col("l_partkey").alias("ord")).agg(F.collect_set("l_suppkey").alias("keys"))
    rows = classes(spark, d).join(keys.hint("merge"), "ord", "left").withColumn("rows", F.count("*").over(Window.partitionBy("ord", "name")).cast("int"))
    imports = F.flatten(F.array_repeat(F.transform("keys", _SUPPLIER), F.col("rows")))  # as the join of a repeated part with its references has them
    return rows.select("name", "simple", "package", "module", "path", "lines", "ord", F.sort_array(imports).alias("imports"))


def claim_modules(spark: SparkSession, d: str) -> DataFrame:
    """(name, ord, mainPackages, projectDependencies, externalDependencies); the packages are those with a class below the module's path."""
    modules = MODULES.df(spark).withColumn("at", X.normal_path(F.col("path")))
    folders = classes(spark, d).select("package", F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).distinct()
    packages = folders.select(F.explode(F.array_union(F.array(F.lit("")), X.ancestors(F.col("folder"), "/"))).alias("at"), "package").distinct()
    own = packages.join(sizes.small(modules.select("name", "at")), "at").groupBy("name").agg(F.array_sort(F.collect_set("package")).alias("mainPackages"))
    return modules.join(own, "name", "left").join(DEPENDENCIES.df(spark), "name", "left").select("name", "ord", F.coalesce("mainPackages", F.array().cast("array<string>")).alias("mainPackages"), "projectDependencies", "externalDependencies")


_PATH = r"regexp_replace(regexp_replace(m.path, '^(\./)+', ''), '/+$', '')"
SCOPES = f"scopes as (select distinct m.name, c.package from modules m join classes c on {_PATH} = '' or starts_with(c.path, {_PATH} || '/'))"


def methods(spark: SparkSession, d: str) -> DataFrame:
    """(type, signature, cyclomatic, cognitive)."""
    signature = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), signature.alias("signature"), F.col("l_quantity").cast("long").alias("cyclomatic"), (F.col("l_linenumber") * 3).cast("long").alias("cognitive"))


METHODS = "methods as (select l_returnflag as type, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as signature, cast(l_quantity as bigint) as cyclomatic, cast(l_linenumber * 3 as bigint) as cognitive from lineitem)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst): nations of customers, and of the suppliers that delivered to them."""
    t = lambda name: table(spark, d, name)
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").select("o_custkey", "l_suppkey")
    pairs = pairs.join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    nation = t("nation")
    named = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name))
    return pairs.select("c_nationkey", "s_nationkey").distinct().join(named("c_nationkey", "src"), "c_nationkey").join(named("s_nationkey", "dst"), "s_nationkey").select("src", "dst")


EDGES = """edges as (select distinct a.n_name as src, b.n_name as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join supplier on l_suppkey = s_suppkey join nation a on a.n_nationkey = c_nationkey join nation b on b.n_nationkey = s_nationkey)"""
