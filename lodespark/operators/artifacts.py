"""Integrity of the written artifacts: each check gives the errors that it finds."""

from __future__ import annotations

import os
from collections.abc import Iterator
from decimal import Decimal
from typing import Any

from ..sources import strict_json
from ..sources.facts import TABLES

METHOD = "-".join("line weighted prioritized capability selector working set proxy".split())
JSON = tuple(f"{name}.json" for name in ("index", *TABLES, "context-packs/index", *"complexity metrics-snapshot trend check".split()))
TEXT = tuple("review-context.md complexity.html trend.html".split())
LIFECYCLE_JSON, LIFECYCLE_TEXT = (tuple(f"{name}.{kind}" for name in ("optimization", "benchmark")) for kind in ("json", "html"))
AMOUNTS = (
    "repositoryContextTokens productionContextTokens testEvidenceTokens documentationContextTokens productionLines totalContextLines medianCapabilityWorkingSetTokens p90CapabilityWorkingSetTokens capabilityCount capabilitySampleCount "
    "capabilitiesWithoutSelectors capabilitiesWithoutResolvedTypes unresolvedCapabilityTypeReferences unresolvedCapabilityModuleReferences unresolvedCapabilityPackageReferences tokensPerKloc p90RepositoryContextShare evidenceToProductionRatio"
).split()
PACK_LISTS = "modules types tests docs evidence claims suggestedFiles".split()


def _file(root: str, name: str, errors: list[str]) -> str | None:
    whole = os.path.normpath(os.path.join(root, name))
    if os.path.commonpath([whole, root]) != root:
        problem = "artifact path escapes output directory"
    elif os.path.islink(whole):
        problem = "artifact must not be a symbolic link"
    elif not os.path.isfile(whole):
        problem = "missing required artifact"
    elif os.path.getsize(whole) == 0:
        problem = "required artifact is empty"
    else:
        return whole
    errors.append(f"{problem}: {name}")
    return None


def _text(root: str, name: str, errors: list[str]) -> str | None:
    whole = _file(root, name, errors)
    if whole is None:
        return None
    try:
        with open(whole, encoding="utf-8", newline="") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as e:
        errors.append(f"cannot read {name}: {e}")
        return None


def _json(root: str, name: str, errors: list[str]) -> tuple[Any, str]:
    text = _text(root, name, errors)
    if text is None:
        return None, ""
    try:
        return strict_json.parse(text), text
    except strict_json.JsonError as e:
        errors.append(f"cannot parse {name}: {e}")
        return None, text


class Node:
    """A value of a document under its place, which checks itself; node / key is the value below it."""

    def __init__(self, value: Any, place: str, errors: list[str]) -> None:
        self.value, self.place, self.errors = value, place, errors

    def __truediv__(self, key: str) -> Node:
        return Node(self.value.get(key) if isinstance(self.value, dict) else None, f"{self.place}.{key}", self.errors)

    def must(self, ok: bool, what: str) -> bool:
        if not ok:
            self.errors.append(f"{self.place} must be {what}")
        return ok

    def mapping(self) -> Node:
        self.must(isinstance(self.value, dict), "an object")
        return self

    def items(self) -> list[Node]:
        ok = self.must(isinstance(self.value, list), "an array")
        return [Node(x, f"{self.place}[{i}]", self.errors) for i, x in enumerate(self.value)] if ok else []

    def text(self) -> str | None:
        return self.value if self.must(isinstance(self.value, str) and bool(self.value.strip()), "non-blank text") else None

    def same(self, wanted: Any) -> None:
        self.must(self.value == wanted, str(wanted))

    @property
    def whole(self) -> bool:
        return isinstance(self.value, Decimal) and self.value == self.value.to_integral_value()

    def within(self, low: int, high: int | None, what: str) -> None:
        self.must(isinstance(self.value, Decimal) and low <= self.value and (high is None or self.value <= high), what)


def _counts(documents: dict[str, Node], errors: list[str]) -> None:
    index = documents["index.json"].mapping()
    (index / "schemaVersion").same(1)
    (index / "generationMode").same("deterministic-static")
    (index / "repository").text()
    counts = (index / "counts").mapping()
    for t in TABLES:
        n, given = len((documents[f"{t}.json"].mapping() / t).items()), counts / t
        if given.must(given.whole, "an integer") and given.value != n:
            errors.append(f"index.json count mismatch for {t}: expected {n} but found {given.value}")


def _packs(root: str, documents: dict[str, Node], errors: list[str]) -> None:
    known: list[str] = []
    for c in (documents["capabilities.json"] / "capabilities").items():
        ident = (c.mapping() / "id").value
        if isinstance(ident, str) and ident.strip():
            if ident in known:
                errors.append(f"duplicate capability id: {ident}")
            known.append(ident)
    seen: dict[str, str] = {}
    for entry in (documents["context-packs/index.json"] / "contextPacks").items():
        ident, label, status, name, _ = ((entry.mapping() / k).text() for k in ("id", "label", "status", "file", "intendedUse"))
        tokens = entry / "tokenEstimate"
        tokens.must(tokens.whole and tokens.value >= 0, "a non-negative integer")
        if ident is None or name is None:
            continue
        if ident in seen:
            errors.append(f"duplicate context-pack id: {ident}")
        if name in seen.values():
            errors.append(f"duplicate context-pack file: {name}")
        seen[ident] = name
        if not (entry / "file").must(name == f"context-packs/{ident}.json", f"context-packs/{ident}.json"):
            continue
        value, text = _json(root, name, errors)
        if value is None:
            continue
        pack = Node(value, name, errors).mapping()
        for key, wanted in (("id", ident), ("label", label), ("status", status)):
            if wanted is not None:
                (pack / key).same(wanted)
        for key in PACK_LISTS + ["warnings"] * ((pack / "warnings").value is not None):
            (pack / key).items()
        if tokens.value != len(text.encode("utf-16-be")) // 2 // 4:
            errors.append(f"{tokens.place} does not match {name}")
    if missing := [x for x in known if x not in seen]:
        errors.append(f"context-pack index is missing capability ids: {missing}")
    if extra := [x for x in seen if x not in known]:
        errors.append(f"context-pack index has unexpected ids: {extra}")


def _complexity(documents: dict[str, Node], errors: list[str]) -> None:
    report = documents["complexity.json"].mapping()
    (report / "codeComplexity").mapping()
    ((report / "aiCostDrivers").mapping() / "tokenCostDrivers").mapping()
    foot = (report / "contextFootprint").mapping()
    (foot / "schemaVersion").same(3)
    (foot / "method").same(METHOD)
    status, samples, debt = ((foot / k) for k in ("measurementStatus", "capabilitySampleCount", "normalizedContextDebt"))
    status.must(status.value in ("MEASURED", "NO_CAPABILITY_SAMPLES"), "a known status")
    for key in AMOUNTS:
        (foot / key).within(0, None, "a non-negative number")
    for key in ("normalizedContextDebt", "contextEfficiencyScore"):
        (foot / key).within(0, 100, "from 0 to 100")
    for key in ("capabilityReferenceSources", "capabilityWorkingSetSources"):
        (foot / key).mapping()
    if (report / "aiContextDebt").value != debt.value:
        errors.append("complexity.json.aiContextDebt differs from the footprint's normalizedContextDebt")
    if status.value == "MEASURED":
        samples.must(samples.whole and samples.value > 0, "above 0 where the footprint is MEASURED")
    if status.value == "NO_CAPABILITY_SAMPLES":
        samples.must(samples.value == 0, "0 without capability samples")
        debt.must(debt.value == 100, "100 without capability samples")


def _check(documents: dict[str, Node], errors: list[str]) -> None:
    check, report = documents["check.json"].mapping(), documents["complexity.json"]
    passed, violations = check / "passed", (check / "violations").items()
    if passed.must(isinstance(passed.value, bool), "a boolean") and passed.value == bool(violations):
        errors.append("check.json cannot pass with violations" if passed.value else "check.json cannot fail without violations")
    for key in ("methodComplexityThresholds", "knowledgeQualityGates"):
        (check / key).mapping()
    for key in ("contextFootprint", "codeComplexity", "aiContextDebt"):
        if (check / key).value is None or (check / key).value != (report / key).value:
            errors.append(f"check.json.{key} differs from complexity.json")


def _errors(root: str, lifecycle: bool) -> Iterator[str]:
    root = os.path.abspath(root)
    errors: list[str] = []
    if not os.path.isdir(root):
        return iter([f"artifact root does not exist or is not a directory: {root}"])
    documents = {name: Node(_json(root, name, errors)[0], name, errors) for name in (*JSON, *(LIFECYCLE_JSON if lifecycle else ()))}
    for name in (*TEXT, *(LIFECYCLE_TEXT if lifecycle else ())):
        text = _text(root, name, errors)
        if text is not None and not text.strip():
            errors.append(f"{name} must not be blank")
        if text is not None and name.endswith(".md"):
            errors += [f"review-context.md lacks {what}" for what, line in (("its canonical title", "# AI Knowledge Review Context"), ("repository overview", "## Repository Overview")) if line not in text]
    _counts(documents, errors)
    _packs(root, documents, errors)
    _complexity(documents, errors)
    _check(documents, errors)
    for name in ("metrics-snapshot.json", "trend.json", *(LIFECYCLE_JSON if lifecycle else ())):
        documents[name].must(isinstance(documents[name].value, dict) and bool(documents[name].value), "a non-empty object")
    return iter(errors)


def verify(root: str, *, lifecycle: bool = False) -> list[str]:
    """What is wrong with the artifacts in a folder; of the complete lifecycle, or of the quality gate alone."""
    return list(_errors(root, lifecycle))
