"""A JSON reader that rejects what lenient ones let pass: repeated keys, rest after the value, NaN, lone surrogates, control characters."""

from __future__ import annotations

import json
from decimal import Decimal
from typing import Any


class JsonError(ValueError):
    pass


def _pairs(pairs: list[tuple[str, Any]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise JsonError(f"duplicate object field: {key}")
        out[key] = value
    return out


def _constant(name: str) -> None:
    raise JsonError(f"not a JSON value: {name}")


def _check(value: Any) -> None:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str) and any("\ud800" <= c <= "\udfff" for c in x):
            raise JsonError("lone surrogate in a string")
        if isinstance(x, dict):
            todo += [*x, *x.values()]
        elif isinstance(x, list):
            todo += x


def parse(text: str) -> Any:
    """The value, numbers as Decimal."""
    try:
        value = json.loads(text, object_pairs_hook=_pairs, parse_float=Decimal, parse_int=Decimal, parse_constant=_constant)
    except JsonError:
        raise
    except (ValueError, RecursionError) as e:
        raise JsonError(str(e)) from e
    _check(value)
    return value


def problem(text: str | None) -> str | None:
    """Why a text isn't strict JSON, or None."""
    if text is None:
        return "no text"
    try:
        parse(text)
    except JsonError as e:
        return str(e)
    return None
