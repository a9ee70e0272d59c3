"""The Markdown summary of a snapshot; its tables are built as expressions, a line per row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import listed
from .packs import either

GUIDE = """## Consumption Guide

**CI workflow**: Run the `generate` command on every change and keep `review-context.md` with the code, so that the health of the capabilities can be followed over time.

**AI assistant**: Start with `review-context.md`, then load the `context-packs/<capability-id>.json` of the capability at hand.

**Architecture review**: Read the _Architecture Claims_ beside the _Risk Areas_ to see what needs attention.
"""


def _cells(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string") if isinstance(c, Column) else F.col(c).cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def _joined(column: str) -> Column:
    text = F.array_join(listed(column), ", ")
    return F.when(text == "", "_none_").otherwise(text)


def _size(column: Column) -> Column:
    return F.size(column)


def _lines(df: DataFrame, line: Column) -> list[str]:
    return [r.line for r in df.orderBy("ord").select(line.alias("line")).toLocalIterator()]


def _table(title: str, header: list[str], lines: list[str], empty: str) -> str:
    if not lines:
        return f"## {title}\n\n{empty}\n\n"
    return "\n".join([f"## {title}", "", "| " + " | ".join(header) + " |", "|" + "|".join("-" * (len(h) + 2) for h in header) + "|", *lines, "", ""])


def _bullets(title: str, lines: list[str]) -> str:
    return f"### {title}\n\n" + ("_None._" if not lines else "\n".join(f"- {x}" for x in lines)) + "\n\n"


def markdown(index: dict[str, Any], s: Any, contexts: list[dict[str, Any]]) -> str:
    n = index["counts"]
    out = f"# AI Knowledge Review Context\n\n## Repository Overview\n\n- **Repository**: {index['repository']}\n- **Generation Mode**: {index['generationMode']}\n- **Schema Version**: {index['schemaVersion']}\n"
    out += "- " + " | ".join(f"**{k}**: {n[t]}" for k, t in (("Modules", "modules"), ("Classes", "classes"), ("Tests", "tests"), ("Documents", "docs"))) + "\n"
    out += "- " + " | ".join(f"**{k}**: {n[k.lower()]}" for k in ("Capabilities", "Claims", "Evidence")) + "\n\n"
    out += _table("Module Graph", ["Module", "Build System", "Main Packages", "Project Dependencies"], _lines(s.modules, _cells("name", "buildSystem", _joined("mainPackages"), _joined("projectDependencies"))), "_No modules detected._")
    label, status = F.coalesce("label", "id"), F.coalesce("status", F.lit("unknown"))
    sizes = (_size(either("matchedTypes", "classes")), _size(either("matchedTests", "tests")), _size(listed("matchedEvidence")))
    out += _table("Capability Overview", ["ID", "Label", "Status", "Types", "Tests", "Evidence"], _lines(s.capabilities, _cells("id", label, status, *sizes)), "_No capabilities detected._")
    many = F.size(listed("violations"))
    violations = F.when(many == 0, "_none_").otherwise(F.concat(many.cast("string"), F.lit(" violation(s)")))
    category = F.when(F.coalesce("category", F.lit("")) == "", "_none_").otherwise(F.col("category"))
    out += _table("Architecture Claims", ["ID", "Category", "Status", "Violations"], _lines(s.claims, _cells("id", category, F.coalesce("status", F.lit("unverified")), violations)), "_No claims defined._")
    warnings = F.array_join(listed("warnings"), ", ")
    weak = F.concat(F.lit("**"), "id", F.lit("** ("), label, F.lit("): status="), status, F.when(warnings == "", "").otherwise(F.concat(F.lit(", warnings: "), warnings)))
    out += "## Risk Areas\n\n" + _bullets("Weakly Evidenced Capabilities", _lines(s.capabilities.filter((status == "unknown") | (warnings != "")), weak))
    out += _bullets("Failed Claims", _lines(s.claims.filter("status = 'failed'"), F.concat(F.lit("**"), "id", F.lit("**: "), many.cast("string"), F.lit(" violation(s)"))))
    rows = [f"| {c['id']} | `{c['file']}` | {c['status']} | ~{c['tokenEstimate']} | {c['intendedUse']} |" for c in contexts]
    out += _table("Suggested Context Packs", ["ID", "File", "Status", "Token Estimate", "Intended Use"], rows, "_No context packs generated._")
    if rows:
        out += "All packs are listed in `context-packs/index.json`.\n\n"
    return out + GUIDE
