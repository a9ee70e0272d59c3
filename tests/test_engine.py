"""The engine on a small repository, from files to verified artifacts; and the driver's contract."""

from __future__ import annotations

import json
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from lodespark.__main__ import main
from lodespark.engine import Engine, GateFailed
from lodespark.operators import artifacts
from lodespark.options import Options
from lodespark.plans import driver
from lodespark.sources import files

SOURCES = {
    "build.gradle": "dependencies {\n  implementation 'com.acme:lib:1'\n}\n",
    "src/main/java/shop/Cart.java": "package shop;\nimport shop.Item;\npublic class Cart {\n  public int total(int x) { if (x > 0) { if (x > 1) { return 2; } } return 0; }\n}\n",
    "src/main/java/shop/Item.java": "package shop;\npublic class Item { }\n",
    "src/test/java/shop/CartTest.java": "package shop;\nclass CartTest { @Test void t() { new Cart(); } }\n",
    "docs/cart.md": "# Cart\n[code](../src)\n", ".github/workflows/ci.yml": "name: CI\njobs:\n  build:\n    runs-on: x\n", "build/skipped.md": "# no\n", ".git/x.md": "# no\n", "docs/empty.md": "",
    "ai-knowledge/capabilities.seed.yaml": "- id: cart\n  label: Cart\n  packages: [shop]\n  testPatterns:\n    - '*Test'\n  docPatterns: [docs/cart*]\n  evidenceTypes: [github-workflow]\n- id: ghost\n  typePatterns: [Nothing*]\n",
    "ai-knowledge/claims.seed.yaml": "- id: cart\n  verifiedBy: [CartTest]\n- id: clean\n  forbiddenReferences: [shop.It]\n  severity: warning\n",
}


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for path, text in SOURCES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, repository, tmp_path_factory):
    e = Engine(spark, Options(root=str(repository), output=str(tmp_path_factory.mktemp("out")), provider="jdt"))
    e.verify()
    return e


def _json(engine, name):
    with open(os.path.join(engine.options.output, name)) as f:
        return json.load(f)


def test_hidden_and_empty_files_are_listed_and_build_folders_are_not(repository):
    assert sorted(p for p, _ in files.inventory(str(repository)) if not p.startswith(("src", "ai-"))) == [".github/workflows/ci.yml", "build.gradle", "docs/cart.md", "docs/empty.md"]


def test_the_artifacts_are_sound(engine):
    assert _json(engine, "index.json")["counts"] == {"modules": 1, "classes": 2, "tests": 1, "docs": 2, "dependencies": 1, "capabilities": 2, "claims": 2, "evidence": 1}
    caps = {c["id"]: c for c in _json(engine, "capabilities.json")["capabilities"]}
    assert caps["cart"]["status"] == "evidence-backed" and caps["cart"]["matchedTypes"] == ["shop.Cart", "shop.Item"] and caps["cart"]["matchedDocs"] == ["docs/cart.md"]
    assert caps["ghost"]["status"] == "unknown" and caps["ghost"]["warnings"] == ["no-evidence-found"]
    claims = {c["id"]: c for c in _json(engine, "claims.json")["claims"]}
    assert claims["cart"]["status"] == "passed" and claims["clean"]["violations"] == ["forbidden-reference:shop.It in shop.Cart (src/main/java/shop/Cart.java)"]
    pack = _json(engine, "context-packs/cart.json")
    assert [c["id"] for c in pack["claims"]] == ["cart"] and "docs/cart.md" in pack["suggestedFiles"]
    text = open(os.path.join(engine.options.output, "review-context.md")).read()
    assert all(f"## {t}" in text for t in ("Repository Overview", "Module Graph", "Capability Overview", "Architecture Claims", "Risk Areas", "Suggested Context Packs", "Consumption Guide"))
    report = _json(engine, "complexity.json")
    assert report["codeComplexity"]["maxMethodCognitiveComplexity"] == 3 and report["contextFootprint"]["measurementStatus"] == "MEASURED"
    assert {s["type"] for s in _json(engine, "optimization.json")["smells"]} == {"Hidden Concept"}


def test_tampering_is_noticed(engine, tmp_path):
    import shutil

    def broken(change):
        at = tmp_path / str(len(list(tmp_path.iterdir())))
        shutil.copytree(engine.options.output, at)
        change(at)
        return " ".join(artifacts.verify(str(at), lifecycle=True))

    assert artifacts.verify(engine.options.output, lifecycle=True) == []
    assert "duplicate object field" in broken(lambda p: (p / "index.json").write_text('{"a":1,"a":2}'))
    assert "count mismatch for classes" in broken(lambda p: (p / "classes.json").write_text('{"classes":[]}'))
    assert "missing required artifact" in broken(lambda p: (p / "context-packs/cart.json").unlink())
    assert "tokenEstimate does not match" in broken(lambda p: (p / "context-packs/cart.json").write_text((p / "context-packs/cart.json").read_text() + " " * 9))
    assert "not a directory" in artifacts.verify(str(tmp_path / "nowhere"))[0]


def test_gates_fail_by_name(spark, engine, repository):
    strict = Options(root=str(repository), output=engine.options.output, require_capability_evidence=True, max_cognitive=1, min_packs=3, max_pack_tokens=1)
    before = engine.options
    engine.options = strict
    try:
        check = engine.quality_gate(_json(engine, "complexity.json"), _json(engine, "trend.json"))
    finally:
        engine.options = before
    assert "maxMethodCognitiveComplexity=3 > maxMethodCognitiveComplexity=1" in check["violations"] and "knowledgeQualityGatesPassed=false" in check["violations"]
    assert [g["gate"] for g in check["knowledgeQualityGates"]["gates"] if not g["passed"]] == ["requireCapabilityEvidence", "minContextPackCount", "maxContextPackTokens"]
    assert issubclass(GateFailed, Exception)


def test_publish_copies(engine, tmp_path):
    assert main(["publish", engine.options.root, engine.options.output, "--to", str(tmp_path / "site")]) == 0
    assert (tmp_path / "site/index.json").exists() and main(["publish", "a", "b"]) == 2


def test_negative_thresholds_are_off():
    o = Options(root="/r", output="/o", max_cognitive=-1, max_debt_increase=float("nan"), max_debt=-5, min_packs=-2, provider="other")
    assert (o.max_cognitive, o.max_debt_increase, o.max_debt, o.min_packs, o.provider) == (None, None, -5, 0, "basic")
    assert (o.shown("/r/a/b"), o.shown("/else")) == ("a/b", "/else")


FAST = ["line_metrics", "module_membership", "context_footprint", "glob_select", "seed_merge", "claim_status", "smells_ranked", "profile_budget", "trend_violations", "java_basic_facts"]


@pytest.mark.parametrize("name", FAST)
def test_queries_match_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    wanted = con.execute(driver.ORACLE[name])
    names = [c[0] for c in wanted.description]
    df = driver.QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, wanted.fetchall())) == sorted(str(tuple(r)) for r in df.select(*[f"`{n}`" for n in names]).collect())


def test_the_contract_needs_no_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)), capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) >= 55, done.stderr


def test_the_flagship(spark):
    assert __spark_entry__.entry(spark).count() == 1
