"""Context footprint: sizes of facts, working sets of capabilities, and the debt that follows from them.

Facts are rows (name, lines) and, for classes, (package, module, path); selectors are rows (capability, tier, kind,
selector) with kind type, package or module and tier 1 for types and packages, 2 for owner modules, 3 for modules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import sizes


def sized(facts: DataFrame, kind: str) -> DataFrame:
    lines = F.coalesce(F.col("lines").cast("long"), F.lit(0))
    return facts.withColumns({"kind": F.lit(kind), "tokens": X.fact_tokens(kind, lines), "lines": F.greatest(lines, F.lit(0))})


def selectors(capabilities: DataFrame) -> DataFrame:
    """Distinct (capability, tier, kind, selector) from the seed and matched columns, blank ones dropped."""
    parts = []
    for tier, kind, columns in ((1, "type", ("matchedTypes", "classes")), (1, "package", ("matchedPackages", "packages")), (2, "module", ("ownerModules",)), (3, "module", ("matchedModules", "modules"))):
        both = F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])
        parts.append(capabilities.select(F.col("id").alias("capability"), F.lit(tier).alias("tier"), F.lit(kind).alias("kind"), F.explode(both).alias("selector")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("trim(selector) <> ''").distinct()


def outside(classes: DataFrame, modules: DataFrame) -> DataFrame:
    """The classes that lie in no module but the root; modules without a name or path don't count."""
    nested = modules.filter("name <> ''").select(X.normal_path(F.col("path")).alias("nested")).filter("nested <> ''").distinct()
    paths = classes.select("path", F.explode(X.ancestors(F.col("path"), "/")).alias("key"))
    inside = paths.join(sizes.small(nested), F.col("key") == F.col("nested"), "left_semi").select("path")
    return classes.join(inside.hint("merge"), "path", "left_anti")  # files of facts are small, their rows are not: no broadcast


def matches(classes: DataFrame, wanted: DataFrame, modules: DataFrame) -> DataFrame:
    """(capability, tier, kind, selector, name, tokens): every class that a selector matches. Prefix rules are equi-joins on the ancestors of a class's package and path."""
    facts = classes.select("name", "package", "module", "path", "tokens")
    pick = ["capability", "tier", "kind", "selector", "name", "tokens"]
    by_type = sizes.small(wanted.filter("kind = 'type'"))
    latest = Window.partitionBy("capability", "tier", "selector").orderBy(F.desc("ord"))
    types = classes.select("name", "tokens", "ord").join(by_type, F.col("selector") == F.col("name")).withColumn("__last", F.row_number().over(latest)).filter("__last = 1").select(*pick)

    packages = facts.filter("package <> ''").select("name", "tokens", F.explode(X.ancestors(F.col("package"), ".")).alias("key"))
    packages = packages.join(sizes.small(wanted.filter("kind = 'package'")), F.trim("selector") == F.col("key")).select(*pick)

    known = modules.filter("name <> ''").groupBy(F.col("name").alias("module_name")).agg(F.max_by(X.normal_path(F.col("path")), "ord").alias("module_path"))
    by_module = wanted.filter("kind = 'module'").withColumn("trimmed", F.trim("selector"))
    named = facts.join(sizes.small(by_module), F.col("trimmed") == F.col("module")).select(*pick)
    placed = by_module.join(known, F.col("trimmed") == F.col("module_name"), "left").withColumn("at", F.when(F.col("module_name").isNull(), X.normal_path(F.col("trimmed"))).otherwise(F.col("module_path")))
    paths = facts.select("name", "tokens", "path", F.explode(X.ancestors(F.col("path"), "/")).alias("key"))
    below = paths.join(sizes.small(placed.filter("at <> ''")), F.col("at") == F.col("key")).select(*pick)
    root = outside(facts, modules).select("name", "tokens").crossJoin(sizes.small(placed.filter("at = '' and module_name is not null"))).select(*pick)
    return types.unionByName(packages).unionByName(named).unionByName(below).unionByName(root)


def working_sets(found: DataFrame) -> DataFrame:
    """(capability, tier, tokens, classes): the classes of the first tier that matches any, each counted once."""
    once = found.groupBy("capability", "tier", "name").agg(F.max("tokens").alias("tokens"))
    tiers = once.groupBy("capability", "tier").agg(F.sum("tokens").cast("long").alias("tokens"), F.count("*").alias("classes"))
    return tiers.withColumn("first", F.min("tier").over(Window.partitionBy("capability"))).filter("tier = first").drop("first")


def unresolved(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(kind, unresolved): selectors that match nothing, of the tiers that were tried: a tier is tried while none before it matches."""
    hits = found.groupBy("capability").agg(F.min("tier").alias("stop"))
    tried = wanted.join(hits, "capability", "left").filter("tier <= coalesce(stop, 3)")
    missing = tried.join(found.select("capability", "tier", "kind", "selector").distinct(), ["capability", "tier", "kind", "selector"], "left_anti")
    return missing.groupBy("kind").agg(F.count("*").alias("unresolved"))


def nearest_rank(p: float, column: str) -> Column:
    return F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {column})"), F.lit(0)).cast("long")


def debt(totals: DataFrame) -> DataFrame:
    """Adds the footprint's figures to a row (production_tokens, test_tokens, doc_tokens, production_lines, total_lines, median_tokens, p90_tokens, samples)."""
    rows = totals.withColumn("repository_tokens", F.col("production_tokens") + F.col("test_tokens") + F.col("doc_tokens"))
    measured = F.col("samples") > 0
    share = F.when(measured, X.ratio(F.col("p90_tokens"), F.col("repository_tokens"))).otherwise(0.0)
    evidence = X.ratio(F.col("test_tokens") + F.col("doc_tokens"), F.col("production_tokens"))
    rows = rows.withColumns({"share": share, "evidence": evidence})
    penalty = F.when(F.col("production_tokens") <= 0, 0.0).otherwise(15.0 * F.greatest(F.lit(0.0), 0.25 - F.least(F.lit(0.25), F.col("evidence"))) / 0.25)
    rows = rows.withColumn("debt", F.when(measured, X.half_up(F.least(F.lit(100.0), 100.0 * F.col("share") + penalty), 2)).otherwise(100.0))
    return rows.select(
        F.when(measured, "MEASURED").otherwise("NO_CAPABILITY_SAMPLES").alias("measurement_status"),
        "repository_tokens", "production_tokens", "test_tokens", "doc_tokens", "production_lines", "total_lines",
        X.half_up(F.when(F.col("total_lines") == 0, 0.0).otherwise(F.col("repository_tokens") * 1000.0 / F.col("total_lines")), 2).alias("tokens_per_kloc"),
        "median_tokens", "p90_tokens",
        X.half_up(F.col("share"), 4).alias("p90_share"),
        X.half_up(F.col("evidence"), 4).alias("evidence_ratio"),
        "debt",
        X.half_up(F.greatest(F.lit(0.0), 100.0 - F.col("debt")), 2).alias("efficiency"),
        "samples",
    )


def footprint(classes: DataFrame, tests: DataFrame, docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row: totals of the facts (sized) and the percentiles of the working sets."""
    size = lambda df, name: df.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias(f"{name}_tokens"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias(f"{name}_lines"))
    sets = working_sets(found).agg(nearest_rank(0.5, "tokens").alias("median_tokens"), nearest_rank(0.9, "tokens").alias("p90_tokens"), F.count("*").alias("samples"))
    totals = size(classes, "production").crossJoin(size(tests, "test")).crossJoin(size(docs, "doc")).crossJoin(sets)
    return debt(totals.withColumn("total_lines", F.col("production_lines") + F.col("test_lines") + F.col("doc_lines")))
