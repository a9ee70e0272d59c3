"""Fact extraction from files (path, content, ord), as expressions; only links and Java syntax trees need Python."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import java

SIGNATURE = r"(?=(\b(?:public|protected)\b[^(]*)\()"
GRADLE = r"^(implementation|api|compileOnly|testImplementation) "
IDENTIFIER = r"^([\p{javaJavaIdentifierPart}.]*)"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def lines(text: Column) -> Column:
    return F.split(text, X.NEWLINE)


def kept(path: Column) -> Column:
    """Not in a version-control or build folder."""
    return ~X.any_of([F.startswith(path, F.lit(p)) for p in (".git/", ".gradle/", "build/", "target/")] + [F.contains(path, F.lit(p)) for p in ("/build/", "/target/")])


def modules(files: DataFrame, root: str) -> DataFrame:
    build = file_name(F.col("path")).isin("build.gradle", "build.gradle.kts", "pom.xml")
    folder = parent(F.col("path"))
    system = F.when(file_name(F.col("path")) == "pom.xml", "maven").otherwise("gradle")
    return files.filter(build).select(F.when(folder == "", F.lit(root)).otherwise(file_name(folder)).alias("name"), folder.alias("path"), F.col("path").alias("buildFile"), system.alias("buildSystem"), "ord")


def gradle_dependencies(files: DataFrame) -> DataFrame:
    """(source, notation, scope, buildSystem, ord, at): whole trimmed lines that begin with a configuration."""
    rows = files.filter(file_name(F.col("path")).isin("build.gradle", "build.gradle.kts")).select("path", "ord", F.posexplode(lines(F.col("content"))).alias("at", "line"))
    rows = rows.withColumn("line", F.trim("line")).filter(F.col("line").rlike(GRADLE))
    return rows.select(F.col("path").alias("source"), F.col("line").alias("notation"), F.regexp_extract("line", GRADLE, 1).alias("scope"), F.lit("gradle").alias("buildSystem"), "ord", "at")


def _tag(name: str) -> Column:
    return F.trim(F.regexp_extract("block", f"(?s)<{name}>(.*?)</{name}>", 1))


def maven_dependencies(files: DataFrame) -> DataFrame:
    blocks = F.regexp_extract_all("content", F.lit("(?s)<dependency>(.*?)</dependency>"), F.lit(1))
    rows = files.filter(file_name(F.col("path")) == "pom.xml").select("path", "ord", F.posexplode(blocks).alias("at", "block"))
    rows = rows.select("path", "ord", "at", _tag("groupId").alias("g"), _tag("artifactId").alias("a"), _tag("version").alias("v"), _tag("scope").alias("s")).filter("g <> '' and a <> ''")
    notation = F.concat("g", F.lit(":"), "a", F.when(F.col("v") == "", "").otherwise(F.concat(F.lit(":"), "v")))
    return rows.select(F.col("path").alias("source"), notation.alias("notation"), F.when(F.col("s") == "", "compile").otherwise(F.col("s")).alias("scope"), F.lit("maven").alias("buildSystem"), "ord", "at")


def headings(text: Column) -> Column:
    return F.transform(F.filter(lines(text), lambda x: F.startswith(x, F.lit("#"))), lambda x: F.trim(F.regexp_replace(x, r"^#+\s*", "")))


def _links(text: str) -> list[tuple[str, str]]:
    """Of each "](" the nearest "[" before it and the next ")"; a link's end is where the search goes on."""
    found, at = [], text.find("](")
    while at >= 0:
        left, right = text.rfind("[", 0, at + 1), text.find(")", at + 2)
        if left >= 0 and right > at:
            found.append((text[left + 1 : at], text[at + 2 : right]))
        at = text.find("](", right + 1 if left >= 0 and right > at else at + 2)
    return found


def _all_links(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"text": a, "target": b} for a, b in _links(t or "")])


def links(text: Column | str) -> Column:
    """Made at the call, since a worker that imports this module has no session."""
    return F.pandas_udf(_all_links, "array<struct<text:string,target:string>>")(text)


def documents(files: DataFrame) -> DataFrame:
    rows = files.filter(F.endswith("path", F.lit(".md"))).withColumn("headings", headings(F.col("content")))
    title = F.when(F.size("headings") > 0, F.get("headings", F.lit(0))).otherwise(file_name(F.col("path")))
    return rows.select("path", title.alias("title"), "headings", links("content").alias("links"), "ord")


def json_text(text: Column, key: str) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(f'"{key}"\\s*:\\s*"([^"]*)"'), F.lit(1)), F.lit(0))


def json_number(text: Column, key: str) -> Column:
    return F.get(F.regexp_extract_all(text, F.lit(f'"{key}"\\s*:\\s*([0-9]+)'), F.lit(1)), F.lit(0)).cast("long")


def json_flag(text: Column, key: str) -> Column:
    return F.lower(F.get(F.regexp_extract_all(text, F.lit(f'"{key}"\\s*:\\s*((?i:true|false))'), F.lit(1)), F.lit(0))).cast("boolean")


def json_items(text: Column, key: str) -> Column:
    """Elements of an array without nested arrays: commas outside quotes, and one."""
    body = F.trim(F.coalesce(F.get(F.regexp_extract_all(text, F.lit(f'(?s)"{key}"\\s*:\\s*\\[(.*?)\\]'), F.lit(1)), F.lit(0)), F.lit("")))
    return F.when(body == "", 0).otherwise(1 + F.length(F.regexp_replace(F.regexp_replace(body, '(?s)"[^"]*"', ""), "[^,]", ""))).cast("int")


def job_count(text: Column) -> Column:
    """Keys that are indented by two spaces and have nothing after them, below the line jobs: and up to the next line at the margin."""
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("n"))

    def step(a: Column, line: Column) -> Column:
        trimmed = F.trim(line)
        begins = trimmed.rlike(r"^jobs:\s*(#.*)?$") & (a["state"] < 2)
        state = F.when(begins, 1).when((a["state"] == 1) & ~F.startswith(line, F.lit("  ")) & (trimmed != ""), 2).otherwise(a["state"])
        counts = ~begins & (state == 1) & line.rlike(r"^  (?!  )") & trimmed.rlike(r"^[^:]+:\s*(#.*)?$")
        return F.struct(state.alias("state"), (a["n"] + counts.cast("int")).alias("n"))

    return F.aggregate(lines(text), start, step)["n"]


def workflow_name(text: Column, otherwise: Column) -> Column:
    named = F.get(F.filter(F.transform(lines(text), F.trim), lambda x: F.startswith(x, F.lit("name:"))), F.lit(0))
    return F.coalesce(F.regexp_replace(F.trim(F.substring(named, 6, 1 << 30)), "[\"']", ""), otherwise)


EVIDENCE = (
    "type string, path string, name string, hasWorkflowDispatch boolean, jobCount int, scenarioId string, inputExpression string, targetExpression string, oracleStatus string, success boolean, "
    "promotionEligible boolean, nodeCount bigint, edgeCount bigint, bridgeRuleCount int, learnedMacroCount int, reusedMacroCount int, ord bigint"
)


def evidence(files: DataFrame) -> DataFrame:
    path, text = F.col("path"), F.col("content")
    found = files.filter(F.startswith(path, F.lit("docs/generated/discovery/")) & F.endswith(path, F.lit("/evidence.json"))).select(
        F.lit("discovery-evidence").alias("type"), "path", *[json_text(text, k).alias(k) for k in ("scenarioId", "inputExpression", "targetExpression", "oracleStatus")], *[json_flag(text, k).alias(k) for k in ("success", "promotionEligible")],
        *[json_number(text, k).alias(k) for k in ("nodeCount", "edgeCount")], *[json_items(text, k).alias(n) for n, k in (("bridgeRuleCount", "bridgeRulesUsed"), ("learnedMacroCount", "learnedMacros"), ("reusedMacroCount", "reusedMacros"))], "ord",
    )
    bench = files.filter(F.contains(path, F.lit("/src/jmh/java/")) & F.endswith(path, F.lit(".java"))).select(F.lit("benchmark-source").alias("type"), "path", F.replace(file_name(path), F.lit(".java"), F.lit("")).alias("name"), "ord")
    flows = files.filter(path.rlike(r"^\.github/workflows/[^/]*\.ya?ml$")).select(
        F.lit("github-workflow").alias("type"), "path", workflow_name(text, file_name(path)).alias("name"), F.contains(text, F.lit("workflow_dispatch")).alias("hasWorkflowDispatch"), job_count(text).alias("jobCount"), "ord"
    )
    every = found.unionByName(bench, allowMissingColumns=True).unionByName(flows, allowMissingColumns=True)
    return every.to(files.sparkSession.createDataFrame([], EVIDENCE).schema)


def java_basic(files: DataFrame) -> DataFrame:
    """One row per Java file by line patterns: name, package, kind, imports, signatures and the rest of the header."""
    source = F.col("content")
    rows = files.filter(F.endswith("path", F.lit(".java"))).withColumn("trimmed", F.transform(lines(source), F.trim))
    flat = F.regexp_replace(source, "[\n\r]", " ")
    after = lambda word: F.regexp_extract(flat, f"(?s) {word} (.*)$", 1)
    package = F.element_at(F.filter("trimmed", lambda x: F.startswith(x, F.lit("package "))), -1)
    package = F.coalesce(F.trim(F.regexp_extract(package, "^package ([^;]*)", 1)), F.lit(""))
    imports = F.transform(F.filter("trimmed", lambda x: F.startswith(x, F.lit("import "))), lambda x: F.trim(F.regexp_replace(F.substring(x, 8, 1 << 30), "static |;", "")))
    signature = F.transform(F.flatten(F.transform("trimmed", lambda x: F.regexp_extract_all(x, F.lit(SIGNATURE), F.lit(1)))), F.trim)
    signature = F.filter(signature, lambda s: (s != "") & ~s.rlike("[{=]") & ~F.concat(F.lit(" "), s, F.lit(" ")).rlike(" (class|interface|enum|record) "))
    padded = F.concat(F.lit(" "), flat, F.lit(" "))
    kind = F.when(F.contains(padded, F.lit(" interface ")), "interface").when(F.contains(padded, F.lit(" record ")), "record").when(F.contains(padded, F.lit(" enum ")), "enum").otherwise("class")
    listed = F.regexp_replace(after("implements"), r"(?s)\{.*$", "")
    interfaces = F.filter(F.transform(F.split(listed, ","), lambda x: F.regexp_extract(F.trim(x), IDENTIFIER, 1)), lambda x: x != "")
    tags = F.filter(F.transform(F.filter("trimmed", lambda x: x.rlike(r"^@Tag\([^)]+\)")), lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^@Tag\(([^)]*)\)", 1), "[\"']", ""))), lambda x: x != "")
    simple = F.replace(file_name(F.col("path")), F.lit(".java"), F.lit(""))
    rows = rows.withColumns({"simple": simple, "package": package, "imports": imports, "methods": signature})
    test = X.is_test_path(F.col("path")) | F.endswith("simple", F.lit("Test")) | F.contains(source, F.lit("@Test"))
    tested = F.when(F.endswith("simple", F.lit("Test")) & (F.length("simple") > 4), F.concat_ws(".", F.nullif("package", F.lit("")), F.regexp_replace("simple", "Test$", ""))).otherwise("")
    return rows.select(
        F.concat_ws(".", F.nullif("package", F.lit("")), "simple").alias("name"), "path", "package", "simple", X.line_count(source).cast("int").alias("lineCount"), F.size("methods").alias("methodCount"), "methods", kind.alias("kind"), "imports",
        F.regexp_extract(F.ltrim(after("extends")), IDENTIFIER, 1).alias("superclass"), interfaces.alias("interfaces"), F.coalesce(test, F.lit(False)).alias("test"), tested.alias("testedClass"), tags.alias("tags"),
        F.array_distinct(F.filter("imports", lambda x: ~F.startswith(x, F.lit("java.")) & ~F.startswith(x, F.lit("javax.")))).alias("referencedProjectClasses"), "ord",
    )


METHODS = (
    "type string, signature string, constructor boolean, sourceFile string, startLine int, endLine int, lineCount int, cyclomaticComplexity int, cognitiveComplexity int, maxNestingDepth int, "
    "decisionPointCount int, decisionPointsByKind map<string,int>, complexityProvider string, complexityAccuracy string, ord bigint, at int"
)


def java_methods(files: DataFrame) -> DataFrame:
    """A row per method of every top-level type, with its complexity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                unit = java.parse(f.content or "")
                found = [(t, m) for t in unit.types for m in t.methods]
                for at, (t, m) in enumerate(found):
                    name = f"{unit.package}.{t.name}" if unit.package else t.name
                    rows.append(
                        {"type": name, "signature": m.signature, "constructor": True if m.constructor else None, "sourceFile": f.path, "startLine": m.start_line, "endLine": m.end_line, "lineCount": m.end_line - m.start_line + 1}
                        | java.complexity(unit, m) | {"complexityProvider": "syntax-tree", "complexityAccuracy": "ast", "ord": f.ord, "at": at}
                    )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in METHODS.replace("map<string,int>", "map").split(", ")])

    return files.filter(F.endswith("path", F.lit(".java"))).select("path", "content", "ord").mapInPandas(run, METHODS)


SPAN = "kind string, source string, target string, sourceFile string, offset int, length int, line int"
FIELD = "declaringType string, name string, fieldType string, modifiers array<string>, sourceFile string, offset int, length int, line int"
TREE = (
    "path string, name string, simple string, package string, kind string, superclass string, interfaces array<string>, methods array<string>, constructors array<string>, imports array<string>, references array<string>, "
    f"lineCount int, tags array<string>, broken boolean, fields array<struct<{FIELD.replace(' ', ':').replace(',:', ',')}>>, relations array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>, ord bigint"
)


def _tree(path: str, text: str, ord_: int) -> dict | None:
    unit = java.parse(text)
    if not unit.types:
        return None
    t = unit.types[0]
    name = f"{unit.package}.{t.name}" if unit.package else t.name
    rel = lambda kind, source, target, s=None: {"kind": kind, "source": source, "target": target, "sourceFile": path, "offset": s and s.offset, "length": s and s.length, "line": s and s.line}
    relations = [rel("PACKAGE_CONTAINS_TYPE", unit.package, name)] if unit.package else []
    if t.superclass:
        relations.append(rel("TYPE_EXTENDS_TYPE", name, t.superclass.text, t.superclass))
    relations += [rel("TYPE_IMPLEMENTS_TYPE", name, s.text, s) for s in t.interfaces if t.kind != "enum"]
    relations += [rel("FIELD_HAS_TYPE", f"{name}.{f.name}", f.type.text, f.type) for f in t.fields]
    for m in t.methods:
        if m.returns:
            relations.append(rel("METHOD_RETURNS_TYPE", f"{name}#{m.signature}", m.returns.text, m.returns))
        relations += [rel("METHOD_PARAMETER_HAS_TYPE", f"{name}#{m.signature}", s.text, s) for s, _ in m.parameters]
    fields = [{"declaringType": name, "name": f.name, "fieldType": f.type.text, "modifiers": f.modifiers or None, "sourceFile": path, "offset": f.offset, "length": f.length, "line": f.line} for f in t.fields]
    references = list(dict.fromkeys([*unit.imports, *java.type_references(unit)]))
    return {
        "path": path, "name": name, "simple": t.name, "package": unit.package, "kind": t.kind, "superclass": t.superclass.text if t.superclass else "", "interfaces": [s.text for s in t.interfaces if t.kind != "enum"],
        "methods": [m.signature for m in t.methods if not m.constructor], "constructors": [m.signature for m in t.methods if m.constructor], "imports": unit.imports, "references": references, "broken": unit.broken, "fields": fields, "relations": relations, "ord": ord_,
    }


def java_trees(files: DataFrame) -> DataFrame:
    """The first top-level type of each Java file, parsed once; what spans files is joined afterwards."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = files.sparkSession.createDataFrame([], TREE).drop("lineCount", "tags").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [r for f in batch.to_pylist() if (r := _tree(f["path"], f["content"] or "", f["ord"]))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    trees = files.filter(F.endswith("path", F.lit(".java"))).select("path", "content", "ord").mapInArrow(run, schema)
    tags = F.filter(F.transform(lines(F.col("content")), F.trim), lambda x: x.rlike(r"^@Tag\([^)]*\)"))
    tags = F.filter(F.transform(tags, lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, r"^@Tag\(([^)]*)\)", 1), "[\"']", ""))), lambda x: x != "")
    more = files.filter(F.endswith("path", F.lit(".java"))).select("path", X.line_count(F.col("content")).cast("int").alias("lineCount"), tags.alias("tags"))
    return trees.join(more, "path")


def synthetic_relations(relations: DataFrame) -> DataFrame:
    """Relations with a place, as a search would report them: kinds that only name a type become references."""
    kinds = {"FIELD_HAS_TYPE": "TYPE_REFERENCES_TYPE", "METHOD_RETURNS_TYPE": "TYPE_REFERENCES_TYPE", "METHOD_PARAMETER_HAS_TYPE": "TYPE_REFERENCES_TYPE"} | {k: k for k in ("TYPE_EXTENDS_TYPE", "TYPE_IMPLEMENTS_TYPE", "TYPE_REFERENCES_TYPE")}
    rows = relations.filter("offset is not null and length is not null").withColumn("kind", F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), "kind"))
    return rows.filter("kind is not null").dropDuplicates(["kind", "source", "target", "sourceFile", "offset"])


def merged_methods(listed: DataFrame, analysed: DataFrame) -> DataFrame:
    """Method facts by type and name, listed ones (type, signature, ord, at) first; what the analysis knows overwrites, so overloads become one."""
    key = F.concat("type", F.lit("#"), F.trim(F.regexp_replace("signature", r"(?s)\(.*$", ""))).alias("key")
    last = lambda df: df.withColumn("key", key).groupBy("key").agg(F.max_by(F.struct(*df.columns), F.struct("ord", "at")).alias("m"), F.min(F.struct("ord", "at")).alias("first"))
    a, b = last(listed).toDF("key", "a", "oa"), last(analysed).toDF("key", "b", "ob")
    both = a.join(b, "key", "full")
    rest = [f"b.{c}" for c in analysed.columns if c not in ("type", "signature", "ord", "at")]
    return both.select(F.coalesce("b.type", "a.type").alias("type"), F.coalesce("b.signature", "a.signature").alias("signature"), *rest, F.coalesce("oa", "ob").alias("ord"))
