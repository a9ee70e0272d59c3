"""Readers of small hand-written files: seeds, model profiles, benchmark fixtures and the baseline.

The dialects are narrow on purpose: a sequence of flat records, with inline or indented lists in YAML, strings and
lists of strings in JSON.
"""

from __future__ import annotations

import os
import re
from typing import Any

Record = dict[str, Any]
#: Of a seed named n, in the order in which they are merged.
SUFFIXES = (".seed.yaml", ".seed.yml", ".yaml", ".yml", ".json")


def _bare(text: str) -> str:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return _unescape(text[1:-1]) if text[0] == '"' else text[1:-1]
    return text


def _uncommented(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "#" and (i == 0 or line[i - 1].isspace()):
            return line[:i].rstrip()
    return line.rstrip()


def _inline(text: str) -> Any:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_bare(x) for x in split(text[1:-1]) if x.strip()]
    return _bare(text)


def split(text: str, at: str = ",") -> list[str]:
    """Pieces between separators that are outside quotes and brackets."""
    out, depth, quote, piece, escaped = [], 0, "", "", False
    for c in text:
        if quote:
            quote = "" if c == quote and not escaped else quote
            escaped = c == "\\" and not escaped
        elif c == '"':
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == at and depth == 0:
            out.append(piece)
            piece = ""
            continue
        piece += c
    return [*out, piece] if piece.strip() or out else []


def yaml_records(text: str) -> list[Record]:
    records: list[Record] = []
    base, key, key_indent = None, None, -1
    for raw in text.splitlines():
        line = _uncommented(raw)
        body = line.strip()
        if not body or body == "---":
            continue
        indent = len(line) - len(line.lstrip())
        item = body.startswith("- ") or body == "-"
        if item and (base is None or indent <= base):
            base, key = indent, None
            records.append({})
            body = body[1:].strip()
            indent += 2
            if not body:
                continue
        elif item and records and key is not None and indent >= key_indent:
            if not isinstance(records[-1].get(key), list):
                records[-1][key] = []
            records[-1][key].append(_bare(body[1:]))
            continue
        if records and ":" in body:
            name, _, value = body.partition(":")
            key, key_indent = _bare(name), indent
            records[-1][key] = _inline(value) if value.strip() else ""
    return records


def _unescape(text: str) -> str:
    return re.sub(r'\\(u[0-9a-fA-F]{4}|.)', lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), text)


def _json_value(text: str) -> Any:
    text = text.strip()
    if text.startswith("["):
        return [v for x in split(text[1:].rstrip().removesuffix("]")) if (v := _json_value(x)) not in ("", None)]
    if text.startswith('"'):
        return _unescape(text[1:].removesuffix('"'))
    return None if text == "null" else text


def json_records(text: str) -> list[Record]:
    """Every object that is not inside another one."""
    records, depth, quoted, escaped, start = [], 0, False, False, 0
    for i, c in enumerate(text):
        if quoted:
            quoted = not (c == '"' and not escaped)
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
            start = i + 1 if depth == 1 else start
        elif c == "}":
            depth -= 1
            if depth == 0:
                pairs = [split(p, ":") for p in split(text[start:i])]
                records.append({_unescape(p[0].strip().strip('"')): _json_value(":".join(p[1:])) for p in pairs if len(p) > 1})
    return records


def _read(path: str) -> str | None:
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return f.read()


def as_list(value: Any) -> list[str]:
    """A scalar is a list of one; blank values and "null" are dropped."""
    return [str(x) for x in (value if isinstance(value, list) else [value]) if x is not None and str(x).strip() and str(x) != "null"]


def seed_records(folder: str, name: str) -> list[Record]:
    """The records of all of a seed's files, in the order in which they are merged."""
    out = []
    for suffix in SUFFIXES:
        text = _read(os.path.join(folder, name + suffix))
        if text is not None:
            out += json_records(text) if suffix == ".json" else yaml_records(text)
    return out


def number(value: Any, kind: type = int) -> Any:
    try:
        return kind(float(value)) if kind is int and re.fullmatch(r"\s*[+-]?\d+\s*", str(value)) else kind(value)
    except (TypeError, ValueError):
        return None


PROFILE_KEYS = {
    "practical": ("practicalContextBudget", "practicalBudget", "contextBudget", "budget"),
    "hard": ("hardContextLimit", "hardLimit", "contextLimit"),
    "ratio": ("targetCompressionRatio", "compressionRatio"),
    "preference": ("compressionPreference", "preference"),
}


def profile_records(folder: str) -> list[Record]:
    """(id, practical, hard, ratio, preference) of the user's profiles; keys that are absent are None."""
    out = []
    for name in ("model-profiles.yaml", "model-profiles.yml"):
        for r in yaml_records(_read(os.path.join(folder, name)) or ""):
            one = {k: next((r[a] for a in names if a in r), None) for k, names in PROFILE_KEYS.items()}
            ident = r.get("id") or r.get("name") or r.get("profile")
            if ident:
                out.append({"id": ident, "practical": number(one["practical"]), "hard": number(one["hard"]), "ratio": number(one["ratio"], float), "preference": one["preference"]})
    return out


def fixture_records(path: str) -> list[Record]:
    text = _read(path)
    if text is None:
        raise FileNotFoundError(f"Empirical benchmark fixture file not found: {path}")
    out = []
    for i, r in enumerate(yaml_records(text), 1):
        tokens = number(r.get("tokenUsage"))
        out.append(
            {
                "id": r.get("id") or f"fixture-{i}", "profile": r.get("profile") or "review", "tokenUsage": tokens if tokens is not None else number(r.get("tokens")) or 0, "latencyMs": number(r.get("latencyMs")) or 0,
                "reviewQuality": number(r.get("reviewQuality"), float) or 0.0, "suggestions": as_list(r.get("suggestions")), "existingFeatures": as_list(r.get("existingFeatures")), "suggestedFeatures": as_list(r.get("suggestedFeatures")),
                "taskSuccess": str(r.get("taskSuccess", "true")).lower() != "false",
            }
        )
    return out


def baseline_record(path: str, keys: tuple[str, ...]) -> Record | None:
    """Whatever of the keys is followed by a number; None without a file. Whole numbers stay whole."""
    text = _read(path)
    if text is None:
        return None
    out: Record = {}
    for key in keys:
        m = re.search(rf'"{key}":\s*([0-9+\-.eE]+)', text)
        value = m and (number(m[1]) if re.fullmatch(r"[+-]?\d+", m[1]) else number(m[1], float))
        if value is not None:
            out[key] = value
    return out
