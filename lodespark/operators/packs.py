"""Context packs: what a reviewer of one capability needs, and the claims that bear on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .links import listed


def either(matched: str, seeded: str) -> Column:
    """The matched list, or the seed's own if nothing matched."""
    return F.when(F.size(listed(matched)) > 0, listed(matched)).otherwise(listed(seeded))


def relevant(capabilities: DataFrame, claims: DataFrame) -> DataFrame:
    """(capability, claim): the ids are equal, or scope and modules, verifiers and tests, or implementers and types overlap.

    capabilities: (id, modules, types, tests). Each way is an equi-join on the exploded lists.
    """
    pair = [F.col("k.id").alias("capability"), F.col("c.id").alias("claim")]
    out = capabilities.alias("k").join(claims.alias("c"), F.col("k.id") == F.col("c.id")).select(*pair)
    for own, wanted in (("modules", "scopeModules"), ("tests", "verifiedBy"), ("types", "implementedBy")):
        k = capabilities.select("id", F.explode(listed(own)).alias("v")).distinct().alias("k")
        c = claims.select("id", F.explode(listed(wanted)).alias("v")).distinct().alias("c")
        out = out.union(k.join(c, F.col("k.v") == F.col("c.v")).select(*pair))
    return out.distinct()


def source_files(types: DataFrame, classes: DataFrame, tests: DataFrame) -> DataFrame:
    """types (type, ...) with path: of the last test of that name, else of the last class."""
    known = classes.select("name", "path", F.struct(F.lit(0).alias("t"), F.col("ord")).alias("o")).union(tests.select("name", "path", F.struct(F.lit(1).alias("t"), F.col("ord")).alias("o")))
    known = known.filter("trim(name) <> '' and trim(path) <> ''").groupBy("name").agg(F.max_by("path", "o").alias("path"))
    return types.join(known, types["type"] == known["name"], "left").drop("name")


def packs(capabilities: DataFrame, claims: DataFrame, classes: DataFrame, tests: DataFrame) -> DataFrame:
    """(id, label, status, ord, pack, json, tokenEstimate, file, intendedUse), one row per capability with an id."""
    caps = capabilities.filter("trim(id) <> ''").select(
        "id", "ord", F.coalesce("label", "id").alias("label"), F.coalesce("status", F.lit("unknown")).alias("status"), F.filter(listed("warnings"), lambda x: F.trim(x) != "").alias("warnings"),
        listed("matchedModules").alias("modules"), either("matchedTypes", "classes").alias("types"), either("matchedTests", "tests").alias("tests"), either("matchedDocs", "docs").alias("docs"), listed("matchedEvidence").alias("evidence"),
    )
    summary = F.struct(F.col("id"), F.col("category"), F.coalesce("status", F.lit("unverified")).alias("status"), F.when(F.size(listed("violations")) > 0, F.col("violations")).alias("violations"))
    about = relevant(caps, claims).join(claims.select(F.col("id").alias("claim"), F.col("ord").alias("at"), summary.alias("summary")), "claim")
    about = about.groupBy(F.col("capability").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "summary"))), lambda x: x["summary"]).alias("claims"))
    files = source_files(caps.select("id", F.posexplode("types").alias("at", "type")), classes, tests).filter("path is not null").groupBy("id").agg(X.ordered_distinct(F.col("path"), F.col("at")).alias("files"))
    rows = caps.join(about, "id", "left").join(files, "id", "left")
    rows = rows.withColumn("claims", F.coalesce("claims", F.array().cast(about.schema["claims"].dataType))).withColumn("suggestedFiles", F.array_distinct(F.concat(listed("files"), "docs")))
    pack = F.struct("id", "label", "status", F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"), *"modules types tests docs evidence claims suggestedFiles".split())
    rows = rows.withColumn("json", F.concat(F.to_json(pack), F.lit("\n")))
    return rows.select(
        "id", "label", "status", "ord", pack.alias("pack"), "json", X.token_estimate(F.col("json")).alias("tokenEstimate"), F.concat(F.lit("context-packs/"), "id", F.lit(".json")).alias("file"),
        X.lookup(F.col("status"), X.INTENDED_USE, X.GENERAL_USE).alias("intendedUse"),
    )
