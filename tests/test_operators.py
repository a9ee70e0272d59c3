"""Operators on small fixtures with exact values."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from lodespark.functions import exprs as X
from lodespark.functions import java
from lodespark.operators import claims as C
from lodespark.operators import footprint, gates, graphs, links, metrics
from lodespark.sources import seeds, strict_json

LISTS = ("matchedTypes", "classes", "matchedPackages", "packages", "ownerModules", "matchedModules", "modules")


def _footprint(spark, classes, capabilities, modules=(), tests=(), docs=()):
    table = lambda rows, kind: footprint.sized(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, lines int, package string, module string, path string, ord long"), kind)
    caps = spark.createDataFrame([(f"c{i}", *[c.get(k, []) for k in LISTS]) for i, c in enumerate(capabilities)], "id string, " + ", ".join(f"{k} array<string>" for k in LISTS))
    mods = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(modules)], "name string, path string, ord long")
    sized, wanted = table(classes, "class"), footprint.selectors(caps)
    found = footprint.matches(sized, wanted, mods)
    row = footprint.footprint(sized, table(tests, "test"), table(docs, "doc"), found).first()
    tiers = {r.tier: r.n for r in footprint.working_sets(found).groupBy("tier").agg(F.count("*").alias("n")).collect()}
    return row, tiers, {r.kind: r.unresolved for r in footprint.unresolved(wanted, found).collect()}


def test_linked_types(spark):
    row, tiers, missing = _footprint(spark, [("A", 100, "", "", "A.java"), ("B", 50, "", "", "B.java")], [{"matchedTypes": ["A"]}, {"classes": ["B"]}], tests=[("T", 40, "", "", "")], docs=[("D", 20, "", "", "")])
    assert (row.production_tokens, row.test_tokens, row.doc_tokens, row.p90_tokens, row.samples) == (1200, 320, 120, 800, 2)
    assert row.measurement_status == "MEASURED" and row.debt < 100 and tiers == {1: 2} and missing == {}


def test_tiers_stop_at_the_first_that_matches(spark):
    classes = [("Engine", 100, "x", "search", "search/Engine.java"), ("Large", 1000, "y", "app", "app/Large.java")]
    row, tiers, missing = _footprint(spark, classes, [{"matchedTypes": ["Engine"], "ownerModules": ["search"], "modules": ["search", "app", "gone"]}], modules=[("search", "search"), ("app", "app")])
    assert row.p90_tokens == 800 and tiers == {1: 1} and missing == {}


def test_the_root_module_leaves_out_nested_ones(spark):
    row, _, missing = _footprint(spark, [("Root", 100, "", "", "src/Root.java"), ("Child", 50, "", "", "child/src/Child.java")], [{"modules": ["root"]}], modules=[("root", ""), ("child", "child")])
    assert row.p90_tokens == 800 and missing == {}


def test_package_prefixes_and_missing_types(spark):
    classes = [("s.Engine", 100, "example.search", "", ""), ("s.i.Index", 50, "example.search.index", "", ""), ("o.Other", 20, "example.searching", "", "")]
    row, _, missing = _footprint(spark, classes, [{"matchedTypes": ["s.Engine"], "packages": ["example.search"], "classes": ["Missing"]}])
    assert row.samples == 1 and row.p90_tokens == 1200 and missing == {"type": 1}


def test_no_samples_is_full_debt_and_splitting_changes_nothing(spark):
    row, _, _ = _footprint(spark, [("A", 100, "", "", "")], [{}])
    assert (row.measurement_status, row.samples, row.p90_tokens, row.debt) == ("NO_CAPABILITY_SAMPLES", 0, 0, 100.0)
    one, _, _ = _footprint(spark, [("M", 150, "", "", "")], [{"classes": ["M"]}])
    two, _, _ = _footprint(spark, [("P", 100, "", "", ""), ("Q", 50, "", "", "")], [{"classes": ["P", "Q"]}])
    assert (one.repository_tokens, one.debt) == (two.repository_tokens, two.debt)


def test_nearest_rank(spark):
    for n in (1, 2, 9, 10, 11):
        got = spark.range(1, n + 1).agg(footprint.nearest_rank(0.5, "id"), footprint.nearest_rank(0.9, "id")).first()
        assert tuple(got) == (-(-n // 2), -(-9 * n // 10))


def _plain_glob(glob, path):
    if not glob:
        return not path
    if glob.startswith("**"):
        rest = glob[3:] if glob.startswith("**/") else glob[2:]
        return any(_plain_glob(rest, path[i:]) for i in range(len(path) + 1))
    if glob[0] == "*":
        end = path.find("/") if "/" in path else len(path)
        return any(_plain_glob(glob[1:], path[i:]) for i in range(end + 1))
    return bool(path) and path[0] == glob[0] and _plain_glob(glob[1:], path[1:])


def test_globs_match_a_plain_model(spark):
    rng = random.Random(1)
    pairs = {("".join(rng.choice("ab/.*?") for _ in range(rng.randrange(7))), "".join(rng.choice("ab/.?\n") for _ in range(rng.randrange(7)))) for _ in range(3000)}
    pairs |= {("docs/**/x", "docs/abx"), ("docs/*", "docs/a/b"), ("a?c", "abc"), ("**", "")}
    for glob, path in pairs:
        assert bool(re.match(X.glob_regex(glob).replace(r"\z", r"\Z"), path)) == _plain_glob(glob, path), (glob, path)
    rows = spark.createDataFrame([(g, p, [g]) for g, p in sorted(pairs)], "glob string, path string, globs array<string>").withColumn("rx", links.globs("globs")[0])
    assert all(r.hit == _plain_glob(r.glob, r.path) for r in rows.select("glob", "path", F.expr("path rlike rx").alias("hit")).collect())


def test_small_functions(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    assert tuple(one(X.half_up(F.lit(1.005), 2), X.half_up(F.lit(2.345), 2), X.ratio(F.lit(1), F.lit(0)))) == (1.0, 2.35, 0.0)
    assert tuple(one(X.line_count(F.lit("")), X.line_count(F.lit("a\r\nb\n")), X.token_estimate(F.lit("a\U0001f600bcde\n")))) == (1, 3, 2)
    assert tuple(one(X.percent_delta(F.lit(0.0), F.lit(0.0)), X.percent_delta(F.lit(0.0), F.lit(3.0)), X.percent_delta(F.lit(-4.0), F.lit(-2.0)))) == (0.0, 100.0, 50.0)
    assert tuple(one(X.normal_path(F.lit("././a\\b//")), X.package_of(F.lit("a.b.C")), X.package_of(F.lit("C")))) == ("a/b", "a.b", "")
    paths = {"app/src/e2eTest/java/A.java": True, "app/src/jmh/java/A.java": False, "src/test/A.java": True, "a/src/main/src/test/A.java": False, "src/testFixtures/x": True}
    rows = spark.createDataFrame(list(paths.items()), "path string, wanted boolean").select("path", "wanted", X.is_test_path(F.col("path")).alias("got")).collect()
    assert all(r.got == r.wanted for r in rows), rows


FACTS = dict(
    modules=([("core", ["p.core"], ["implementation project(':util')"], ["implementation 'com.acme:lib:1'"], 1), ("app", ["p.app"], [], [], 2)], "name string, mainPackages array<string>, projectDependencies array<string>, externalDependencies array<string>, ord long"),
    classes=([("p.core.A", "A.java", "p.core", ["p.core.B", "bad.x.Y"], 1), ("p.core.B", "B.java", "p.core", ["p.core.A"], 2), ("p.app.C", "C.java", "p.app", ["bad.Z"], 3)], "name string, path string, package string, imports array<string>, ord long"),
    tests=([("p.core.ATest",)], "name string"), docs=([("docs/a.md", 1), ("docs/b.md", 2)], "path string, ord long"), evidence=([("ci",)], "type string"),
)
RULES = "scopeModules forbiddenReferences forbiddenImports forbiddenDependencies allowedDependencies allowedTargetModules verifiedBy requiredTests requiredEvidenceTypes requiredDocs".split()


def _verify(spark, *claims):
    schema = "id string, ord long, severity string, status string, mustBeAcyclic boolean, " + ", ".join(f"{k} array<string>" for k in RULES)
    rows = [(f"c{i}", i, c.get("severity"), c.get("status"), c.get("mustBeAcyclic", False), *[c.get(k) for k in RULES]) for i, c in enumerate(claims)]
    done = C.verified(spark.createDataFrame(rows, schema), **{k: spark.createDataFrame(*v) for k, v in FACTS.items()}).orderBy("ord").persist()
    return done.collect(), C.error_failures(done).first()[0]


def test_claims(spark):
    rows, failures = _verify(
        spark, {"scopeModules": ["core"], "forbiddenReferences": ["bad."]}, {"scopeModules": ["app"], "forbiddenReferences": ["worse."]}, {"forbiddenImports": ["bad."], "severity": "warning"}, {"forbiddenDependencies": ["acme"], "scopeModules": ["core"]},
        {"allowedDependencies": []}, {"allowedDependencies": ["acme"]}, {"allowedTargetModules": ["other"]}, {"verifiedBy": ["ATest", "NoTest"]}, {"verifiedBy": ["p.core.ATest"]}, {"requiredEvidenceTypes": ["ci", "bench"]},
        {"requiredDocs": ["docs/*", "notes/*"]}, {"mustBeAcyclic": True}, {}, {"status": "accepted"},
    )
    assert [r.status for r in rows] == ["failed", "passed", "failed", "failed", "failed", "passed", "failed", "failed", "passed", "failed", "failed", "failed", "unverified", "accepted"]
    got = {i: r.violations for i, r in enumerate(rows)}
    assert got[0] == ["forbidden-reference:bad. in p.core.A (A.java)"] and rows[0].verificationEvidence == ["module:core"]
    assert got[2] == ["forbidden-import:bad. in p.core.A (A.java)", "forbidden-import:bad. in p.app.C (C.java)"]
    assert got[3] == ["forbidden-dependency:acme in module:core (implementation 'com.acme:lib:1')"] and got[4] == ["disallowed-dependency:implementation 'com.acme:lib:1' in module:core"]
    assert got[6] == ["disallowed-target-module:util from module:core"] and got[7] == ["missing-verifier-test:NoTest"] and rows[7].matchedVerifiedBy == ["ATest"]
    assert got[9] == ["missing-evidence-type:bench"] and got[10] == ["missing-required-doc:notes/*"] and "doc:docs/a.md" in rows[10].verificationEvidence
    assert got[11] == ["import-cycle:p.core.A -> p.core.B -> p.core.A"] and failures == 8


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "a"), ("x", "x")], "src string, dst string")
    assert {tuple(r) for r in graphs.mutual(edges).collect()} == {("a", "b"), ("c", "d")}
    assert {tuple(r) for r in graphs.on_cycles(edges).collect()} == {("a", 4), ("b", 4), ("c", 2), ("d", 2), ("x", 1)}
    assert graphs.on_cycles(edges.limit(0)).count() == 0
    chain = spark.createDataFrame([(str(i), str((i + 1) % 40)) for i in range(40)], "src string, dst string")
    assert {r.reachable for r in graphs.on_cycles(chain).collect()} == {40}


def test_profiles_and_recommendation(spark):
    rows = [(*p, i) for i, p in enumerate(metrics.PROFILES)] + [("broken", -10, -20, 2.5, "x", 9)]
    table = spark.createDataFrame(rows, "id string, practical long, hard long, ratio double, preference string, ord long")
    out = metrics.profile_metrics(table, spark.createDataFrame([(1060,)], "tokens long"))
    got = {r.profile: r for r in out.collect()}
    assert [got[p].compressed_tokens for p in ("raw", "compact", "review", "architecture", "deep-research")] == [1060, 371, 636, 795, 901]
    assert len(got["broken"].warnings) == 3 and "ratio above 1" in got["broken"].warnings[2]
    assert metrics.recommended(out).first()[0] == "review" and metrics.recommended(out.filter("profile <> 'review'")).first()[0] == "raw" and metrics.recommended(out.limit(0)).first()[0] == "none"


def test_sample_complexity(spark):
    r = metrics.complexity(spark.createDataFrame([(1, 0, 0, 0, 10)], "classes long, tests long, docs long, dependencies long, capabilities long")).first()
    assert (r.estimatedContextTokens, r.knowledgeDensity, r.conceptRadius, r.compressionRatio) == (1060, 0.1, 1, 1.0) and r.aiCognitiveDebt == pytest.approx(1.16) and r.testWarning


def test_trend_gates(spark):
    one = lambda **k: spark.createDataFrame([tuple(float(v) for v in k.values())], ", ".join(f"{n} double" for n in k))
    changes = metrics.deltas(one(estimatedContextTokens=0, conceptRadius=1), one(estimatedContextTokens=10, conceptRadius=1))
    assert [r.metric for r in metrics.trend_violations(changes, {"estimatedContextTokens": 0.0, "conceptRadius": 0.0, "aiCognitiveDebt": None}).collect()] == ["estimatedContextTokens"]
    assert metrics.trend_violations(changes, {}).count() == 0


def test_gates(spark):
    capabilities = spark.createDataFrame([("ghost", None, "unknown", 1), ("real", "Real", "documented", 2)], "id string, label string, status string, ord long")
    found = gates.capability_evidence(capabilities)
    rows = gates.results(spark.createDataFrame([("requireCapabilityEvidence",), ("other",)], "gate string"), found).collect()
    assert {r.gate: r.passed for r in rows} == {"requireCapabilityEvidence": False, "other": True}
    assert [r.violations for r in rows if not r.passed] == [["capability:ghost (ghost) has no matched module/type/doc/evidence"]]


@pytest.mark.parametrize(("text", "ok"), [('{"a":[1,-2.5e3,null,true,"\\u00e9"]}', True), ("01", False), ("1.", False), ('"\\ud800"', False), ('{"a":1,"a":2}', False), ("{} []", False), ("NaN", False), ("", False), ('"\t"', False)])
def test_strict_json(text, ok):
    assert (strict_json.problem(text) is None) == ok


def test_seed_readers():
    records = seeds.yaml_records("- id: a # note\n  modules: [x, \"y, z\"]\n  tests:\n    - T1\n    - \"T2\"\n- id: b\n  label: \"\n")
    assert records == [{"id": "a", "modules": ["x", "y, z"], "tests": ["T1", "T2"]}, {"id": "b", "label": '"'}]
    assert seeds.json_records('[{"id":"a","modules":["x","y"]},{"id":"b","label":"q\\"r"}]') == [{"id": "a", "modules": ["x", "y"]}, {"id": "b", "label": 'q"r'}]


def _method(body):
    unit = java.parse(f"class A {{ int f(int x, int y) {{ {body} }} }}")
    c = java.complexity(unit, unit.types[0].methods[0])
    return c["cyclomaticComplexity"], c["cognitiveComplexity"], c["maxNestingDepth"]


def test_java_complexity():
    assert _method("return 42;") == (1, 0, 0)
    nested, guarded = _method("if (x > 0) { if (y > 0) { return 1; } } return 0;"), _method("if (x <= 0) return 0; if (y <= 0) return 0; return 1;")
    assert nested[0] == guarded[0] == 3 and nested[1] > guarded[1]
    assert _method("if (x > 0) return 1; else if (y > 0) return 2; else return 3;")[0] == 3
    assert _method("for (int i = 0; i < x; i++) if (i > 1 && y > 2) x++; do { x--; } while (x > 0); while (y > 0) y--;")[0] == 6
    big = _method("try { for (int i = 0; i < x; i++) { if (i > 1 && y > 0) { y++; } } int z = switch (x) { case 1 -> 2; default -> 3; }; return x > 0 ? z : y; } catch (RuntimeException e) { return 0; }")
    assert big[0] >= 7 and big[1] >= 6 and big[2] >= 2
    assert _method('String s = "if (a && b) {"; char c = \'{\'; /* while (x) */ // for (;;)\n return 0;') == (1, 0, 0)
    unit = java.parse("package p; import static a.B.*; class A { void f(){} void f(int x){} } interface I { int g(); }")
    assert [t.name for t in unit.types] == ["A", "I"] and [m.name for m in unit.types[0].methods] == ["f", "f"] and unit.package == "p"
