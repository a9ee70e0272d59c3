"""The engine: a snapshot of a repository's facts, the reports over it, and the artifacts that hold them.

Facts and what is computed over them are DataFrames; a report is a handful of rows that the driver collects and writes.
"""

from __future__ import annotations

import html
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exprs as X
from .operators import artifacts, footprint, gates, graphs, lineage, metrics, packs, review
from .operators import claims as C
from .options import OFF_FLOAT, OFF_INT, Options
from .sources import facts, seeds

Report = dict[str, Any]
_LIMITS = {
    "maxMethodCognitiveComplexity": ("maxMethodCognitiveComplexity", "max_cognitive"),
    "maxMethodCyclomaticComplexity": ("maxMethodCyclomaticComplexity", "max_cyclomatic"),
    "averageMethodCognitiveComplexity": ("maxAverageMethodCognitiveComplexity", "max_average_cognitive"),
    "averageMethodCyclomaticComplexity": ("maxAverageMethodCyclomaticComplexity", "max_average_cyclomatic"),
    "methodsAboveCognitiveThreshold": ("maxMethodsAboveCognitiveThreshold", "max_above_cognitive"),
    "methodsAboveCyclomaticThreshold": ("maxMethodsAboveCyclomaticThreshold", "max_above_cyclomatic"),
}
_COMPACT = ("type", "signature", "sourceFile", "startLine", "endLine", "cyclomaticComplexity", "cognitiveComplexity", "maxNestingDepth")
_RENAMED = {"name": {"classes": "class", "tests": "testClass"}, "path": {"classes": "sourceFile", "tests": "sourceFile"}}


class GateFailed(Exception):
    """A quality gate has violations, or an artifact isn't sound."""


def encode(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def _tag(name: str, inner: str) -> str:
    return f"<{name}>{inner}</{name}>"


def page(title: str, report: Report) -> str:
    head = _tag("head", '<meta charset="utf-8">' + _tag("title", title))
    body = _tag("body", _tag("h1", title) + _tag("pre", html.escape(encode(report), quote=False)))
    return "<!doctype html>" + _tag("html", head + body) + "\n"


def _row(df: DataFrame) -> Report:
    return df.first().asDict(recursive=True)


def _rows(df: DataFrame) -> list[Report]:
    return [r.asDict(recursive=True) for r in df.collect()]


class Engine:
    def __init__(self, spark: SparkSession, options: Options) -> None:
        self.spark, self.options = spark, options
        self.snapshot = facts.read(spark, options)
        self._packs = lineage.cut(packs.packs(self.snapshot.capabilities, self.snapshot.claims, self._named("classes"), self._named("tests")))

    # --- tables that the reports share

    def _named(self, table: str) -> DataFrame:
        return getattr(self.snapshot, table).select("name", "path", "ord")

    def _sized(self, table: str) -> DataFrame:
        """(name, path, lines, package, module, ord): docs have no line count, so their size is the fallback."""
        df = getattr(self.snapshot, table)
        if table == "docs":
            return df.select(F.col("path").alias("name"), "path", F.lit(None).cast("int").alias("lines"), "ord")
        module = F.coalesce("module", F.lit("")) if "module" in df.columns else F.lit("")
        return df.select("name", "path", F.col("lineCount").alias("lines"), "package", module.alias("module"), "ord")

    def counts(self) -> Report:
        found = {r.fact: r.rows for r in metrics.counts(**self.snapshot.tables()).collect()}
        return {t: found[t] for t in facts.TABLES}

    def contexts(self) -> list[Report]:
        rows = self._packs.orderBy("ord").select("id", "label", "status", "tokenEstimate", "file", "intendedUse")
        return _rows(rows)

    # --- reports

    def index(self) -> Report:
        return {"schemaVersion": 1, "repository": self.snapshot.repository, "generationMode": "deterministic-static", "counts": self.counts()}

    def footprint(self) -> Report:
        caps = self.snapshot.capabilities
        classes, wanted = footprint.sized(self._sized("classes"), "class"), footprint.selectors(caps)
        found = lineage.cut(footprint.matches(classes, wanted, self.snapshot.modules))
        r = _row(footprint.footprint(classes, footprint.sized(self._sized("tests"), "test"), footprint.sized(self._sized("docs"), "doc"), found))
        tiers = {t["tier"]: t["n"] for t in _rows(footprint.working_sets(found).groupBy("tier").agg(F.count("*").alias("n")))}
        missing = {u["kind"]: u["unresolved"] for u in _rows(footprint.unresolved(wanted, found))}
        with_any = wanted.select("capability").distinct().count()
        sources = ("matchedTypes", "classes", "matchedModules", "modules", "ownerModules", "matchedPackages", "packages")
        given = _row(caps.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).cast("long").alias(c) for c in sources]))
        return {
            "schemaVersion": 3, "measurementStatus": r["measurement_status"], "repositoryContextTokens": r["repository_tokens"], "productionContextTokens": r["production_tokens"], "testEvidenceTokens": r["test_tokens"],
            "documentationContextTokens": r["doc_tokens"], "productionLines": r["production_lines"], "totalContextLines": r["total_lines"], "tokensPerKloc": r["tokens_per_kloc"], "medianCapabilityWorkingSetTokens": r["median_tokens"],
            "p90CapabilityWorkingSetTokens": r["p90_tokens"], "p90RepositoryContextShare": r["p90_share"], "evidenceToProductionRatio": r["evidence_ratio"], "normalizedContextDebt": r["debt"], "contextEfficiencyScore": r["efficiency"],
            "capabilityCount": given["n"], "capabilitySampleCount": r["samples"], "capabilitiesWithoutSelectors": given["n"] - with_any, "capabilitiesWithoutResolvedTypes": with_any - r["samples"],
            "unresolvedCapabilityTypeReferences": missing.get("type", 0), "unresolvedCapabilityModuleReferences": missing.get("module", 0), "unresolvedCapabilityPackageReferences": missing.get("package", 0),
            "capabilityReferenceSources": {c: given[c] for c in sources}, "capabilityWorkingSetSources": {"typeOrPackage": tiers.get(1, 0), "ownerModules": tiers.get(2, 0), "modules": tiers.get(3, 0)}, "method": artifacts.METHOD,
        }

    def code_complexity(self) -> Report:
        methods = self.snapshot.methods.withColumns({"cyclomatic": F.col("cyclomaticComplexity"), "cognitive": F.col("cognitiveComplexity")})
        out = _row(metrics.method_summary(methods))
        for metric in ("cyclomatic", "cognitive"):
            out[f"top{metric.capitalize()}Methods"] = _rows(metrics.top_methods(methods, metric).select(*_COMPACT))
        return out

    def profiles(self, tokens: int) -> list[Report]:
        """The built-in profiles, overwritten and added to by the user's."""
        merged = {p[0]: dict(zip(("practical", "hard", "ratio", "preference"), p[1:], strict=True)) for p in metrics.PROFILES}
        for p in seeds.profile_records(self.options.profiles):
            merged.setdefault(p["id"], {"practical": None, "hard": None, "ratio": None, "preference": None}).update({k: v for k, v in p.items() if k != "id" and v is not None})
        rows = [(k, v["practical"], v["hard"], v["ratio"], v["preference"] or "balanced", i) for i, (k, v) in enumerate(merged.items())]
        table = self.spark.createDataFrame(rows, "id string, practical long, hard long, ratio double, preference string, ord long")
        return _rows(metrics.profile_metrics(table, self.spark.createDataFrame([(tokens,)], "tokens long")).orderBy("ord"))

    def method_limits(self) -> Report:
        return {name: (OFF_FLOAT if "verage" in name else OFF_INT) if (v := getattr(self.options, own)) is None else v for name, own in _LIMITS.values()}

    def complexity(self) -> Report:
        o, n, code = self.options, self.counts(), self.code_complexity()
        row = self.spark.createDataFrame([tuple(n[k] for k in X.WEIGHTS)], ", ".join(f"{k} long" for k in X.WEIGHTS))
        r = _row(metrics.complexity(row))
        profiles = self.profiles(r["estimatedContextTokens"])
        warnings = [f"Profile {p['profile']}: {p['warnings'][0]}" for p in profiles if p["warnings"]]
        warnings += ["Knowledge density is low: many files are needed per capability."] * r["densityWarning"] + ["Test evidence appears weak compared with production classes."] * r["testWarning"]
        foot = self.footprint()
        tips = row.select(F.explode(metrics.cost_advice(F.lit(r["estimatedContextTokens"]), F.lit(code["maxMethodCognitiveComplexity"]), F.lit(code["maxMethodCyclomaticComplexity"]), F.col("classes"), F.col("docs"))).alias("tip"))
        largest = metrics.contributors(*[self._sized(t).select("name", "path", "lines") for t in ("classes", "tests", "docs")]).orderBy(F.desc("tokens"), "path").limit(10)
        drivers = {
            "description": "What the context costs in tokens, and what the code costs in reasoning.", "estimatedContextTokens": r["estimatedContextTokens"],
            "tokenCostDrivers": {d["driver"]: {"count": d["count"], "tokenWeight": d["token_weight"], "estimatedTokens": d["tokens"]} for d in _rows(metrics.cost_drivers(row))},
            "largestContextContributors": [{"kind": c["kind"], "name": c["name"], "path": c["path"], "estimatedTokens": c["tokens"]} for c in _rows(largest)],
            "reasoningCostDrivers": {k: v for k, v in code.items() if not k.startswith("average")}, "recommendations": [t.tip for t in tips.collect()],
        }
        shown = [
            {"id": p["profile"], "practicalContextBudget": p["practical_budget"], "hardContextLimit": p["hard_limit"], "targetCompressionRatio": p["compression_ratio"], "compressionPreference": p["preference"], "estimatedRawTokens": p["raw_tokens"],
             "estimatedCompressedTokens": p["compressed_tokens"], "fitsPracticalBudget": p["fits_practical"], "fitsHardLimit": p["fits_hard"], "compressedFitsPracticalBudget": p["compressed_fits_practical"], "compressedFitsHardLimit": p["compressed_fits_hard"], "warnings": p["warnings"]}
            for p in profiles
        ]
        keys = ("estimatedContextTokens", "conceptRadius", "dependencyRadius", "knowledgeDensity", "contextLocality", "compressionRatio", "aiCognitiveComplexity")
        return {
            "schemaVersion": 1, **{k: r[k] for k in keys}, "aiContextDebt": foot["normalizedContextDebt"], "aiCognitiveDebt": r["aiCognitiveDebt"], "codeComplexity": code, "aiCostDrivers": drivers, "warningCount": len(warnings), "warnings": warnings,
            "modelProfiles": shown, "thresholds": {"maxCognitiveDebt": o.max_debt, **self.method_limits(), "failOnWarnings": o.fail_on_warnings, "modelProfileDirectory": o.shown(o.profiles)}, "legacyAiContextDebt": r["aiCognitiveDebt"],
            "contextFootprint": foot, "repositoryContextTokens": foot["repositoryContextTokens"], "normalizedContextDebt": foot["normalizedContextDebt"], "contextEfficiencyScore": foot["contextEfficiencyScore"],
        }

    def metrics_snapshot(self, complexity: Report) -> Report:
        return {"schemaVersion": 1, **{k: float(complexity.get(k) or 0) for k in metrics.TREND_KEYS}}

    def trend(self, complexity: Report) -> Report:
        o, current = self.options, self.metrics_snapshot(complexity)
        path = os.path.join(o.seeds, "complexity-baseline.json")
        baseline = seeds.baseline_record(path, metrics.TREND_KEYS)
        limits = {"aiCognitiveDebt": o.max_debt_increase, "conceptRadius": o.max_radius_increase, "estimatedContextTokens": o.max_token_increase}
        names = {"maxCognitiveDebtIncrease": o.max_debt_increase, "maxConceptRadiusIncrease": o.max_radius_increase, "maxContextTokenIncrease": o.max_token_increase}
        deltas, violations, warnings = {}, [], []
        if baseline is None:
            warnings = ["No complexity baseline found: trend checks need a metrics-snapshot.json as complexity-baseline.json beside the seeds."]
        else:
            one = lambda r: self.spark.createDataFrame([tuple(float(r.get(k) or 0) for k in metrics.TREND_KEYS)], ", ".join(f"{k} double" for k in metrics.TREND_KEYS))
            changes = metrics.deltas(one(baseline), one(current))
            deltas = {d.pop("metric"): {k: d[k] for k in ("baseline", "current", "absolute", "percent")} for d in _rows(changes.orderBy("ord"))}
            found = {v["metric"]: {k: v[k] for k in ("metric", "increase", "threshold", "message")} for v in _rows(metrics.trend_violations(changes, limits))}
            violations = [found[k] for k in limits if k in found]
        return {
            "schemaVersion": 1, "baselinePresent": baseline is not None, "baselinePath": o.shown(path), "current": current, "thresholds": {k: OFF_FLOAT if v is None else float(v) for k, v in names.items()}, "baseline": baseline, "deltas": deltas,
            "warnings": warnings, "violations": violations, "violationCount": len(violations), "passed": not violations,
        }

    def optimization(self, complexity: Report) -> Report:
        s = self.snapshot
        imports = s.classes.select("package", "ord", F.explode("imports").alias("import"))
        packages = s.classes.select(F.col("name").alias("import"), F.col("package").alias("dst"))
        edges = imports.join(packages, "import").select(F.col("package").alias("src"), "dst").filter("src <> '' and dst <> ''")
        first = s.classes.groupBy("package").agg(F.min("ord").alias("ord"))
        mutual = graphs.mutual(edges).join(first.select(F.col("package").alias("a"), "ord"), "a")
        caps = s.capabilities.select("id", "status", "classes", "ord")
        one = self.spark.createDataFrame([(s.classes.count(),)], "classes long")
        found = lineage.cut(metrics.smells(caps, mutual, metrics.duplicate_titles(s.docs.select("title", "ord")), F.col("classes"), one))
        order = (F.desc("savings"), F.col("ord"))
        smells = [{"type": r["type"], "subject": r["subject"], "estimatedTokenSavings": r["savings"]} for r in _rows(found.orderBy(*order))]
        advice = [{"title": r["title"], "action": r["action"], "estimatedTokenSavings": r["savings"]} for r in _rows(metrics.recommendations(found).orderBy(*order))]
        saved = sum(x["estimatedTokenSavings"] for x in smells)
        after = {"estimatedContextTokens": max(0, complexity["estimatedContextTokens"] - saved), "estimatedTokenSavings": saved}
        return {"schemaVersion": 1, "smells": smells, "recommendations": advice, "before": complexity, "afterEstimate": after}

    def benchmark(self, complexity: Report) -> Report:
        rows = self.profiles(complexity["estimatedContextTokens"])
        results = [
            {"profile": p["profile"], "estimatedTokens": p["compressed_tokens"], "rawTokens": p["raw_tokens"], "compressionRatio": p["compression_ratio"], "rawFitsPracticalBudget": p["fits_practical"], "rawFitsHardLimit": p["fits_hard"],
             "compressedFitsPracticalBudget": p["compressed_fits_practical"], "compressedFitsHardLimit": p["compressed_fits_hard"], "budgetRisk": p["budget_risk"], "missingContextRisk": p["missing_context_risk"], "risk": p["risk"]}
            for p in rows
        ]
        chosen = next((r["profile"] for r in results if r["profile"] == "review"), None) or next((r["profile"] for r in results if r["risk"] == "low"), results[0]["profile"] if results else "none")
        return {"schemaVersion": 1} | {"method": "deterministic-preflight"} | {"results": results, "recommendedProfile": chosen, "empirical": self.empirical()}

    def empirical(self) -> Report:
        o = self.options
        schema = "id string, profile string, tokenUsage long, latencyMs long, reviewQuality double, suggestions array<string>, existingFeatures array<string>, suggestedFeatures array<string>, taskSuccess boolean"
        names = [c.split()[0] for c in schema.split(", ")]
        records = [tuple(r[k] for k in names) for r in seeds.fixture_records(o.fixtures)] if o.empirical else []
        results = metrics.empirical(self.spark.createDataFrame(records, schema)).coalesce(1)
        summary = _row(metrics.empirical_summary(results))
        return {"enabled": o.empirical, "fixtureFile": o.shown(o.fixtures), "fixtureCount": summary["fixtureCount"], "results": _rows(results), "summary": summary}

    def knowledge_gates(self) -> Report:
        o, s, none = self.options, self.snapshot, None
        on = {"requireCapabilityEvidence": o.require_capability_evidence, "requireClaimVerification": o.require_claim_verification, "minContextPackCount": o.min_packs > 0, "maxContextPackTokens": o.max_pack_tokens is not None}
        parts = {
            "requireCapabilityEvidence": lambda: gates.capability_evidence(s.capabilities), "requireClaimVerification": lambda: gates.claim_verification(s.claims), "minContextPackCount": lambda: gates.pack_count(self._packs, o.min_packs),
            "maxContextPackTokens": lambda: gates.pack_tokens(self._packs, o.max_pack_tokens),
        }
        names = [k for k, v in on.items() if v]
        for k in names:
            none = parts[k]() if none is None else none.unionByName(parts[k]())
        rows = {} if none is None else {r["gate"]: r for r in _rows(gates.results(self.spark.createDataFrame([(k,) for k in names], "gate string"), none))}
        found = [{"gate": k, "passed": rows[k]["passed"], **({} if rows[k]["passed"] else {"violations": rows[k]["violations"]})} for k in names]
        return {"passed": all(g["passed"] for g in found), "gates": found}

    def quality_gate(self, complexity: Report, trend: Report) -> Report:
        o, knowledge, code = self.options, self.knowledge_gates(), complexity["codeComplexity"]
        debt, failures = complexity["aiContextDebt"], C.error_failures(self.snapshot.claims).first()[0]
        violations = [f"aiContextDebt={debt} > maxCognitiveDebt={o.max_debt}"] if debt > o.max_debt else []
        for metric, (name, own) in _LIMITS.items():
            most = getattr(o, own)
            if most is not None and code[metric] > most:
                violations.append(f"{metric}={code[metric]} > {name}={most}")
        violations += [f"trendViolations={trend['violationCount']}"] * (trend["violationCount"] > 0) + [f"claimFailures={failures}"] * (failures > 0) + ["knowledgeQualityGatesPassed=false"] * (not knowledge["passed"])
        if o.fail_on_warnings and complexity["warningCount"]:
            violations.append(f"warnings={complexity['warningCount']} while failOnWarnings=true")
        return {
            "passed": not violations, "aiContextDebt": debt, "legacyAiContextDebt": complexity["legacyAiContextDebt"], "aiCognitiveDebt": complexity["aiCognitiveDebt"], "maxCognitiveDebt": o.max_debt, "contextFootprint": complexity["contextFootprint"],
            "codeComplexity": code, "methodComplexityThresholds": self.method_limits(), "violations": violations, "warningCount": complexity["warningCount"], "failOnWarnings": o.fail_on_warnings, "trendViolationCount": trend["violationCount"],
            "trendPassed": trend["passed"], "trendThresholds": trend["thresholds"], "claimFailureCount": failures, "knowledgeQualityGates": knowledge,
        }

    # --- artifacts

    def _write(self, name: str, text: str) -> None:
        path = os.path.join(self.options.output, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)

    def _write_table(self, name: str) -> None:
        """{name: [rows]}, streamed a partition at a time, so the driver never holds the table."""
        df = getattr(self.snapshot, name)
        order = [c for c in ("ord", "at") if c in df.columns]
        shown = [F.col(c).alias(_RENAMED.get(c, {}).get(name, c)) for c in df.columns if c not in ("ord", "at", "simple", "test")]
        path = os.path.join(self.options.output, f"{name}.json")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(f'{{"{name}":[')
            for i, row in enumerate(df.orderBy(*order).select(F.to_json(F.struct(*shown)).alias("j")).toLocalIterator()):
                f.write("," * (i > 0) + row.j)
            f.write("]}\n")

    def generate(self) -> Report:
        index, contexts = self.index(), self.contexts()
        self._write("index.json", encode(index) + "\n")
        for name in facts.TABLES:
            self._write_table(name)
        for row in self._packs.select("file", "json").toLocalIterator():
            self._write(row.file, row.json)
        self._write("context-packs/index.json", encode({"contextPacks": contexts}) + "\n")
        self._write("review-context.md", review.markdown(index, self.snapshot, contexts))
        return index

    def _report(self, name: str, title: str, report: Report) -> Report:
        self._write(f"{name}.json", encode(report) + "\n")
        self._write(f"{name}.html", page(title, report))
        return report

    def _analysed(self) -> tuple[Report, Report]:
        self.generate()
        report = self._report("complexity", "AI Cognitive Complexity", self.complexity())
        self._write("metrics-snapshot.json", encode(self.metrics_snapshot(report)) + "\n")
        return report, self._report("trend", "AI Complexity Trend", self.trend(report))

    def analyze(self) -> Report:
        return self._analysed()[0]

    def optimize(self) -> Report:
        return self._report("optimization", "AI Knowledge Optimization", self.optimization(self.analyze()))

    def benchmarked(self) -> Report:
        return self._report("benchmark", "AI Extraction Benchmark", self.benchmark(self.analyze()))

    def _gated(self, *, lifecycle: bool) -> Report:
        report, trend = self._analysed()
        if lifecycle:
            self._report("optimization", "AI Knowledge Optimization", self.optimization(report))
            self._report("benchmark", "AI Extraction Benchmark", self.benchmark(report))
        check = self.quality_gate(report, trend)
        self._write("check.json", encode(check) + "\n")
        if errors := artifacts.verify(self.options.output, lifecycle=lifecycle):
            raise GateFailed("AI knowledge artifact verification failed: " + "; ".join(errors))
        if check["violations"]:
            raise GateFailed("AI knowledge quality gate failed: " + "; ".join(check["violations"]))
        return check

    def check(self) -> Report:
        return self._gated(lifecycle=False)

    def verify(self) -> Report:
        return self._gated(lifecycle=True)
