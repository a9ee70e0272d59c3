"""Column expressions that the operators share. All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINE = r"\R"
#: Tokens per line, and for a fact whose lines are unknown.
TOKENS = {"class": (8, 260), "test": (8, 140), "doc": (6, 180)}
#: Tokens per fact in the estimate by counts.
WEIGHTS = {"classes": 260, "tests": 140, "docs": 180, "dependencies": 35, "capabilities": 80}


def glob_regex(glob: str) -> str:
    """A regular expression for the whole path: ** (and a slash after it) is anything, * stays within a folder, all else is literal."""
    parts = re.split(r"(\*\*/?|\*)", glob)
    return "^(?s:" + "".join(".*" if p.startswith("**") else "[^/]*" if p == "*" else re.sub(r"([^0-9A-Za-z_/ -])", r"\\\1", p) for p in parts if p) + r")\z"


def line_count(text: Column) -> Column:
    """Lines of a text, an empty one and the piece after a last line break included."""
    return F.size(F.split(text, NEWLINE, -1))


def fact_tokens(kind: str, lines: Column) -> Column:
    per_line, unknown = TOKENS[kind]
    return F.when(lines > 0, lines.cast("long") * per_line).otherwise(F.lit(unknown).cast("long"))


def half_up(x: Column, digits: int) -> Column:
    """Rounded half up as floor(x * 10**digits + 0.5), which is not what round() gives."""
    scale = F.lit(float(10**digits))
    return F.floor(x * scale + F.lit(0.5)).cast("double") / scale


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def utf16_units(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")).cast("long") / 2


def token_estimate(text: Column) -> Column:
    return F.floor(utf16_units(text) / 4).cast("long")


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def package_of(fqn: Column) -> Column:
    return F.when(F.instr(fqn, ".") > 0, F.regexp_replace(fqn, r"[.][^.]*$", "")).otherwise(F.lit(""))


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def keyword_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[-_ ]", "")


def normal_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(?:\./)+", ""), "/+$", "")


def ancestors(name: Column, separator: str) -> Column:
    """The name and all its prefixes that end before a separator: a prefix join becomes an equi-join on these."""
    parts = F.split(name, re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def ordered_distinct(value: Column, order: Column) -> Column:
    """The values of a group without repetition, in the order of their first row."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def is_test_path(path: Column) -> Column:
    inner = F.nullif(F.regexp_extract(path, "/src/([^/]+)", 1), F.lit(""))
    source_set = F.coalesce(inner, F.regexp_extract(path, "^src/([^/]+)", 1))
    return source_set.isin("test", "testFixtures") | source_set.endswith("Test")


def status(evidence: Column, types: Column, tests: Column, docs: Column) -> Column:
    """Of a capability with selectors; each argument tells whether there is any."""
    return (
        F.when(evidence, "evidence-backed").when(types & tests, "implemented-and-tested").when(types, "implemented").when(tests, "partial").when(docs, "documented").otherwise("unknown")
    )


def keyword_status(classes: Column, tests: Column, docs: Column) -> Column:
    return F.when(classes & tests, "implemented").when(classes | tests, "partial").when(docs, "documented").otherwise("unknown")


def lookup(value: Column, pairs: dict[str, str], otherwise: str) -> Column:
    found = F.lit(otherwise)
    for k, v in pairs.items():
        found = F.when(value == k, F.lit(v)).otherwise(found)
    return found


INTENDED_USE = {
    "evidence-backed": "Review evidence and assertions for this capability",
    "implemented-and-tested": "Code review with implementation and test evidence",
    "implemented": "Review implementation – tests may be missing",
    "partial": "Tests exist but implementation may be incomplete",
    "documented": "Documentation-focused review; implementation evidence may be missing",
    "unknown": "No evidence found – investigate this capability",
}
GENERAL_USE = "General capability review"
ACTIONS = {
    "Large Concept": "Split the concept into smaller, more focused modules or packages.",
    "Hidden Concept": "Add the classes and tests that reveal and verify the capability.",
    "Concept Cycle": "Introduce an abstraction layer or extract shared code to break the cycle.",
    "Scattered Capability": "Consolidate capability classes into a single cohesive package.",
    "Weak Evidence": "Add test coverage and implementation to strengthen the evidence for this capability.",
    "Duplicate Knowledge": "Consolidate duplicate documentation into a single authoritative source.",
    "Oversized Context Cluster": "Modularize the repository by splitting large clusters into smaller bounded contexts.",
}
ANY_ACTION = "Improve locality, documentation and test evidence."


def risk_rank(risk: Column) -> Column:
    return F.when(risk == "high", 3).when(risk == "medium", 2).otherwise(1)


def risk_name(rank: Column) -> Column:
    return F.when(rank == 3, "high").when(rank == 2, "medium").otherwise("low")


def percent_delta(before: Column, now: Column) -> Column:
    return F.when(before == 0, F.when(now == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise((now - before) * 100.0 / F.abs(before))


def any_of(conditions: Sequence[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
