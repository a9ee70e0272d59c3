"""Gates: assertions with lists of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def capability_evidence(capabilities: DataFrame) -> DataFrame:
    """(gate, violation, ord)."""
    bad = capabilities.filter("trim(id) <> '' and status = 'unknown'")
    text = F.concat(F.lit("capability:"), "id", F.lit(" ("), F.coalesce("label", "id"), F.lit(") has no matched module/type/doc/evidence"))
    return bad.select(F.lit("requireCapabilityEvidence").alias("gate"), text.alias("violation"), "ord")


def claim_verification(claims: DataFrame) -> DataFrame:
    return claims.filter("status = 'unverified'").select(F.lit("requireClaimVerification").alias("gate"), F.concat(F.lit("claim:"), "id", F.lit(" has status=unverified")).alias("violation"), "ord")


def pack_count(packs: DataFrame, least: int) -> DataFrame:
    n = packs.agg(F.count("*").alias("n")).filter(F.col("n") < least)
    text = F.concat(F.lit("context pack count "), F.col("n").cast("string"), F.lit(f" is below required minimum {least}"))
    return n.select(F.lit("minContextPackCount").alias("gate"), text.alias("violation"), F.lit(0).cast("long").alias("ord"))


def pack_tokens(packs: DataFrame, most: int) -> DataFrame:
    text = F.concat(F.lit("context-pack:"), "id", F.lit(" token estimate "), F.col("tokenEstimate").cast("string"), F.lit(f" exceeds maximum {most}"))
    return packs.filter(F.col("tokenEstimate") > most).select(F.lit("maxContextPackTokens").alias("gate"), text.alias("violation"), "ord")


def results(gates: DataFrame, violations: DataFrame) -> DataFrame:
    """(gate, passed, violations) for each row of gates (gate)."""
    own = violations.groupBy("gate").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "violation"))), lambda x: x["violation"]).alias("violations"))
    rows = gates.join(own, "gate", "left").withColumn("violations", F.coalesce("violations", F.array().cast("array<string>")))
    return rows.select("gate", (F.size("violations") == 0).alias("passed"), "violations")


def exceeded(row: DataFrame, limits: dict[str, tuple[str, float | None]]) -> DataFrame:
    """(metric, actual, limit, most, ord): the metrics of a one-row table that are above their limit; a limit of None is off."""
    on: list[Column] = [
        F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("actual"), F.lit(name).alias("limit"), F.lit(float(most)).alias("most"), F.lit(i).alias("ord")) for i, (k, (name, most)) in enumerate(limits.items()) if most is not None
    ]
    if not on:
        return row.select(F.lit("").alias("metric"), F.lit(0.0).alias("actual"), F.lit("").alias("limit"), F.lit(0.0).alias("most"), F.lit(0).alias("ord")).limit(0)
    return row.select(F.explode(F.array(*on)).alias("g")).select("g.*").filter("actual > most")
