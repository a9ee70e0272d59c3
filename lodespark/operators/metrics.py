"""Metrics by counts, method complexity, cost drivers, smells, budget profiles, empirical results and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

TREND_KEYS = ("estimatedContextTokens", "conceptRadius", "dependencyRadius", "knowledgeDensity", "contextLocality", "compressionRatio", "aiCognitiveComplexity", "aiCognitiveDebt")
TREND_GATES = {
    "aiCognitiveDebt": "AI cognitive debt increased beyond the configured threshold.",
    "conceptRadius": "Concept radius increased beyond the configured threshold.",
    "estimatedContextTokens": "Estimated context size increased beyond the configured threshold.",
}


def counts(**tables: DataFrame) -> DataFrame:
    """(fact, rows) for each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("fact"), "rows")
        out = row if out is None else out.union(row)
    return out


def complexity(row: DataFrame) -> DataFrame:
    """From a row of the counts classes, tests, docs, dependencies and capabilities the metrics that follow from them."""
    tokens = sum((F.col(k).cast("long") * w for k, w in X.WEIGHTS.items()), F.lit(0).cast("long"))
    row = row.withColumn("estimatedContextTokens", tokens)
    density = F.when(F.col("capabilities") == 0, 0.0).otherwise((F.col("classes") + F.col("tests") + F.col("docs")).cast("double") / F.col("capabilities"))
    row = row.withColumn("knowledgeDensity", density)
    t = F.col("estimatedContextTokens")
    debt = F.greatest(F.lit(0.0), t / 1000.0 + F.col("knowledgeDensity") - F.col("tests") / 10.0)
    return row.select(
        "estimatedContextTokens",
        F.greatest(F.lit(1), F.expr("classes div greatest(1, capabilities)")).cast("long").alias("conceptRadius"),
        F.col("dependencies").cast("long").alias("dependencyRadius"),
        "knowledgeDensity",
        F.greatest(F.lit(0.0), 1.0 - F.col("knowledgeDensity") / 100.0).alias("contextLocality"),
        F.when(t == 0, 1.0).otherwise(F.least(F.lit(1.0), 12000.0 / t)).alias("compressionRatio"),
        (t / 1000.0 + F.col("dependencies") * 0.5).alias("aiCognitiveComplexity"),
        debt.alias("aiCognitiveDebt"),
        (F.col("knowledgeDensity") > 20.0).alias("densityWarning"),
        (F.col("tests") < F.greatest(F.lit(1), F.expr("classes div 4"))).alias("testWarning"),
    )


def method_summary(methods: DataFrame) -> DataFrame:
    """One row over methods (cyclomatic, cognitive)."""
    out = [F.count("*").alias("methodCount")]
    for name, most in (("Cyclomatic", 10), ("Cognitive", 15)):
        c = F.col(name.lower())
        total = F.coalesce(F.sum(c), F.lit(0)).cast("long")
        out += [
            total.alias(f"total{name}Complexity"),
            F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"maxMethod{name}Complexity"),
            F.when(F.count("*") == 0, 0.0).otherwise(X.half_up(total.cast("double") / F.count("*"), 2)).alias(f"averageMethod{name}Complexity"),
            F.count_if(c > most).alias(f"methodsAbove{name}Threshold"),
        ]
    return methods.agg(*out)


def top_methods(methods: DataFrame, metric: str, n: int = 10) -> DataFrame:
    return methods.orderBy(F.desc(metric), "type", "signature").limit(n)


def contributors(classes: DataFrame, tests: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, name, path, tokens) of all facts (name, path, lines)."""
    out = None
    for kind, key, df in (("class", "classes", classes), ("test", "tests", tests), ("doc", "docs", docs)):
        lines = F.coalesce(F.col("lines").cast("long"), F.lit(0))
        one = df.select(F.lit(kind).alias("kind"), "name", "path", F.when(lines > 0, lines * 12).otherwise(F.lit(X.WEIGHTS[key]).cast("long")).alias("tokens"))
        out = one if out is None else out.unionByName(one)
    return out


def cost_drivers(row: DataFrame) -> DataFrame:
    """(driver, count, token_weight, tokens) of a row of counts."""
    items = [F.struct(F.lit(k).alias("driver"), F.col(k).cast("long").alias("count"), F.lit(w).cast("long").alias("token_weight"), (F.col(k).cast("long") * w).alias("tokens")) for k, w in X.WEIGHTS.items()]
    return row.select(F.explode(F.array(*items)).alias("d")).select("d.*")


COST_ADVICE = {
    "tokens": "The estimated context is above a working set of 12k tokens: review with smaller packs, one per capability.",
    "cognitive": "Before behavior is added, split the methods of the highest cognitive complexity; they cost the most reasoning.",
    "cyclomatic": "Methods of high cyclomatic complexity need focused tests or fewer branches.",
    "classes": "Narrow the capability selectors or split large clusters, so that fewer unrelated classes are sent.",
    "docs": "Merge duplicate and stale documents; redundant ones use up context.",
    "none": "No cost driver stands out; keep the packs focused and watch the trend.",
}


def cost_advice(tokens: Column, cognitive: Column, cyclomatic: Column, classes: Column, docs: Column) -> Column:
    tests = {"tokens": tokens > 12000, "cognitive": cognitive > 15, "cyclomatic": cyclomatic > 10, "classes": classes > 80, "docs": docs > 40}
    given = F.filter(F.array(*[F.when(c, F.lit(COST_ADVICE[k])) for k, c in tests.items()]), lambda x: x.isNotNull())
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(COST_ADVICE["none"])))


def duplicate_titles(docs: DataFrame) -> DataFrame:
    """(title_key, count) of normalised titles that occur more than once."""
    return docs.select(X.title_key(F.coalesce("title", F.lit(""))).alias("title_key"), *[c for c in ("ord",) if c in docs.columns]).filter("title_key <> ''").groupBy("title_key").agg(
        F.count("*").alias("count"), *([F.min("ord").alias("ord")] if "ord" in docs.columns else [])
    ).filter("count > 1")


def scattered(capabilities: DataFrame) -> DataFrame:
    """(id, packages): how many packages a capability's classes lie in."""
    rows = capabilities.select("id", F.explode("classes").alias("class")).select("id", X.package_of(F.col("class")).alias("package")).filter("trim(package) <> ''")
    return rows.groupBy("id").agg(F.count_distinct("package").alias("packages"))


def smells(capabilities: DataFrame, mutual: DataFrame, duplicates: DataFrame, classes: Column | int, one: DataFrame) -> DataFrame:
    """(type, subject, savings, ord): capabilities (id, status, classes, ord), mutual (a, b, ord), duplicates (title_key, count, ord); one is a one-row table that has the column classes."""
    n = F.size(F.coalesce("classes", F.array().cast("array<string>")))
    row = lambda df, rank, type_, subject, savings: df.select(
        F.lit(type_).alias("type"), subject.cast("string").alias("subject"), savings.cast("long").alias("savings"), F.struct(F.lit(rank).alias("r"), F.col("ord").cast("long").alias("o")).alias("ord")
    )
    wide = scattered(capabilities).join(capabilities.select("id", "ord"), "id").filter("packages >= 3")
    parts = [
        row(capabilities.filter("status = 'unknown'"), 1, "Hidden Concept", F.col("id"), F.lit(300)),
        row(capabilities.filter("status = 'partial'"), 2, "Weak Evidence", F.col("id"), F.lit(200)),
        row(capabilities.filter(n > 5), 3, "Large Concept", F.col("id"), (n - 5) * 200),
        row(wide, 4, "Scattered Capability", F.col("id"), F.col("packages") * 150),
        row(mutual, 5, "Concept Cycle", F.concat("a", F.lit(" <-> "), "b"), F.lit(400)),
        row(duplicates, 6, "Duplicate Knowledge", F.col("title_key"), (F.col("count") - 1) * 100),
        row(one.withColumn("ord", F.lit(0)).filter(classes > 80), 7, "Oversized Context Cluster", F.lit("repository"), F.lit(20) * classes),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def recommendations(found: DataFrame) -> DataFrame:
    """(title, action, savings, ord), to be ordered by savings descending, then ord."""
    return found.select(
        F.concat(F.lit("Reduce "), "type", F.lit(" around "), "subject").alias("title"), X.lookup(F.col("type"), X.ACTIONS, X.ANY_ACTION).alias("action"), "savings", "ord"
    )


PROFILES = (
    ("raw", 128000, 256000, 1.0, "minimal compaction for maximal context retention"),
    ("compact", 32000, 64000, 0.35, "aggressive compaction for constrained model budgets"),
    ("review", 128000, 256000, 0.6, "balanced context for code review tasks"),
    ("architecture", 192000, 384000, 0.75, "broader architecture-level context"),
    ("deep-research", 256000, 1000000, 0.85, "maximum breadth for deep repository exploration"),
)


def profile_metrics(profiles: DataFrame, tokens: DataFrame) -> DataFrame:
    """profiles (id, practical, hard, ratio, preference, ord) against a one-row table (tokens)."""
    rows = profiles.crossJoin(F.broadcast(tokens.select(F.col("tokens").cast("long"))))
    bad_practical, bad_hard = F.coalesce(F.col("practical") <= 0, F.lit(False)), F.coalesce(F.col("hard") <= 0, F.lit(False))
    rows = rows.withColumn("p", F.when(F.col("practical") > 0, F.col("practical").cast("long")).otherwise(F.lit(128000).cast("long")))
    rows = rows.withColumn("h0", F.when(F.col("hard") > 0, F.col("hard").cast("long")).otherwise(F.col("p")))
    rows = rows.withColumn("h", F.greatest("h0", "p"))
    fallback = F.least(F.lit(1.0), F.col("p") / F.greatest(F.lit(1.0), F.col("tokens").cast("double")))
    rows = rows.withColumn("r0", F.coalesce(F.col("ratio").cast("double"), fallback)).withColumn("r", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("r0"))))
    rows = rows.withColumn("c", F.greatest(F.lit(0), F.floor(F.col("tokens") * F.col("r") + 0.5)).cast("long"))
    t, p, h, c = (F.col(k) for k in ("tokens", "p", "h", "c"))
    warnings = F.filter(
        F.array(
            F.when(bad_practical, "Configured practical context budget must be positive; using fallback."),
            F.when(bad_hard, "Configured hard context limit must be positive; using fallback."),
            F.when(F.col("h0") < p, "Configured hard context limit is below the practical budget, which is used instead."),
            F.when(F.col("r0") < 0, "Target compression ratio below 0 is clamped to 0."),
            F.when(F.col("r0") > 1, "Target compression ratio above 1 is clamped to 1."),
            F.when(t > p, "Estimated raw context exceeds the practical budget."),
            F.when(t > h, "Estimated raw context exceeds the hard context limit."),
            F.when(c > p, "Target compression still exceeds the practical budget."),
            F.when(c > h, "Target compression still exceeds the hard context limit."),
        ),
        lambda x: x.isNotNull(),
    )
    rows = rows.withColumns({"warnings": warnings, "fits_practical": t <= p, "fits_hard": t <= h, "compressed_fits_practical": c <= p, "compressed_fits_hard": c <= h})
    budget = F.when(~F.col("compressed_fits_hard"), "high").when(~F.col("compressed_fits_practical"), "medium").otherwise("low")
    missing = F.when(F.col("r") <= 0.4, "high").when(F.col("r") <= 0.7, "medium").otherwise("low")
    rows = rows.withColumns({"budget_risk": budget, "missing_context_risk": missing})
    return rows.select(
        F.col("id").alias("profile"), p.alias("practical_budget"), h.alias("hard_limit"), F.col("r").alias("compression_ratio"), "preference", t.alias("raw_tokens"), c.alias("compressed_tokens"),
        "fits_practical", "fits_hard", "compressed_fits_practical", "compressed_fits_hard", "budget_risk", "missing_context_risk",
        X.risk_name(F.greatest(X.risk_rank(F.col("budget_risk")), X.risk_rank(F.col("missing_context_risk")))).alias("risk"), "warnings", "ord",
    )


def recommended(results: DataFrame) -> DataFrame:
    """One row (recommended): review if there, else the first of low risk, else the first, else none."""
    order = F.struct(F.when(F.col("profile") == "review", 0).when(F.col("risk") == "low", 1).otherwise(2), F.col("ord"))
    return results.agg(F.coalesce(F.min_by("profile", order), F.lit("none")).alias("recommended"))


def empirical(fixtures: DataFrame) -> DataFrame:
    """Per fixture (id, profile, tokenUsage, latencyMs, reviewQuality, suggestions, existingFeatures, suggestedFeatures, taskSuccess)."""
    none = F.array().cast("array<string>")
    missed = F.array_except(F.coalesce("existingFeatures", none), F.coalesce("suggestedFeatures", none))
    tips = F.coalesce("suggestions", none)
    return fixtures.select(
        "id", F.coalesce("profile", F.lit("review")).alias("profile"), F.coalesce("tokenUsage", F.lit(0)).cast("long").alias("tokenUsage"), F.coalesce("latencyMs", F.lit(0)).cast("long").alias("latencyMs"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("reviewQuality").cast("double"), F.lit(0.0)))).alias("reviewQuality"),
        (F.size(tips) - F.size(F.array_distinct(tips))).cast("long").alias("duplicateSuggestions"),
        missed.alias("missedExistingFeatures"),
        (F.coalesce("taskSuccess", F.lit(True)) & (F.size(missed) == 0)).alias("taskSuccess"),
    )


def empirical_summary(results: DataFrame) -> DataFrame:
    n = F.count("*")
    mean = lambda c: F.when(n == 0, 0.0).otherwise(F.sum(c).cast("double") / n)
    return results.agg(
        n.alias("fixtureCount"),
        F.when(n == 0, 0).otherwise(F.floor(mean("tokenUsage") + 0.5)).cast("long").alias("averageTokenUsage"),
        F.when(n == 0, 0).otherwise(F.floor(mean("latencyMs") + 0.5)).cast("long").alias("averageLatencyMs"),
        mean("reviewQuality").alias("averageReviewQuality"),
        F.coalesce(F.sum("duplicateSuggestions"), F.lit(0)).cast("long").alias("totalDuplicateSuggestions"),
        F.coalesce(F.sum(F.size("missedExistingFeatures")), F.lit(0)).cast("long").alias("totalMissedExistingFeatures"),
        F.when(n == 0, 0.0).otherwise(F.count_if("taskSuccess").cast("double") / n).alias("taskSuccessRate"),
    )


def unpivot(row: DataFrame, value: str) -> DataFrame:
    """(metric, value) of a one-row table that has the trend's metrics; missing ones are 0."""
    at = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) if k in row.columns else F.lit(0.0)
    return row.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("metric"), at(k).alias(value)) for i, k in enumerate(TREND_KEYS)])).alias("m")).select("m.*")


def deltas(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(metric, baseline, current, absolute, percent, ord)."""
    both = unpivot(current, "current").join(unpivot(baseline, "baseline").drop("ord"), "metric")
    return both.select("metric", "baseline", "current", (F.col("current") - F.col("baseline")).alias("absolute"), X.percent_delta(F.col("baseline"), F.col("current")).alias("percent"), "ord")


def trend_violations(changes: DataFrame, limits: dict[str, float | None]) -> DataFrame:
    """(metric, increase, threshold, message, ord); a metric without a limit is not gated."""
    threshold = F.lit(None).cast("double")
    for k, v in limits.items():
        if v is not None:
            threshold = F.when(F.col("metric") == k, F.lit(float(v))).otherwise(threshold)
    rows = changes.select("metric", F.col("absolute").alias("increase"), threshold.alias("threshold"), "ord").filter("increase > threshold")
    return rows.withColumn("message", X.lookup(F.col("metric"), TREND_GATES, "")).select("metric", "increase", "threshold", "message", "ord")
