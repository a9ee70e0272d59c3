"""The engine's settings. None switches a threshold off; negative and NaN thresholds are off too, but for max_debt, which is taken as it is."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass, fields

PROVIDERS = ("basic", "jdt", "jdt-search")
#: What a threshold that is off looks like in the reports.
OFF_INT, OFF_FLOAT = 2**31 - 1, 1.7976931348623157e308


@dataclass(frozen=True)
class Options:
    root: str
    output: str
    seeds: str | None = None
    profiles: str | None = None
    provider: str = "basic"
    fail_on_warnings: bool = False
    max_debt: float = 100.0
    max_debt_increase: float | None = None
    max_radius_increase: float | None = None
    max_token_increase: float | None = None
    empirical: bool = False
    fixtures: str | None = None
    require_capability_evidence: bool = False
    require_claim_verification: bool = False
    min_packs: int = 0
    max_pack_tokens: int | None = None
    max_cognitive: int | None = None
    max_cyclomatic: int | None = None
    max_average_cognitive: float | None = None
    max_average_cyclomatic: float | None = None
    max_above_cognitive: int | None = None
    max_above_cyclomatic: int | None = None

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("root", os.path.abspath(self.root))
        put("output", os.path.abspath(self.output))
        put("seeds", os.path.abspath(self.seeds or os.path.join(self.root, "ai-knowledge")))
        put("profiles", os.path.abspath(self.profiles or self.seeds))
        put("fixtures", os.path.abspath(self.fixtures or os.path.join(self.seeds, "benchmark-fixtures.yaml")))
        put("min_packs", max(0, self.min_packs))
        if self.provider not in PROVIDERS:
            put("provider", "basic")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.startswith("max_") and f.name != "max_debt" and value is not None and (math.isnan(value) or value < 0):
                put(f.name, None)

    def shown(self, path: str) -> str:
        """A path as reports have it: relative to the root if inside."""
        inside = os.path.relpath(path, self.root)
        return path if inside.startswith("..") else inside.replace(os.sep, "/")
