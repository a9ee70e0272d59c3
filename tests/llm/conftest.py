"""Fixtures of the operators' hard cases, and plain models that they are held against."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int, root long, word string, times int, slot long, ord long, count long, blob_id string"
WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "un", "sol", "vex") for b in ("ra", "din", "posh", "quell", "tan", "be", "zim", "orp")]
_WORD = re.compile(r"[0-9A-Za-z_\x80-\U0010ffff]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingles(text: str | None, n: int) -> Counter:
    w = tokens(text)
    return Counter(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1))))


def jaccard(a: Counter, b: Counter) -> float:
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    """rows of (doc_id, text, lang, source), with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 1, 2, "w", 3, 4, 5, 6, "b") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    rows = [
        (1, "one two three four five six", "en", "a"), (1, "one two three four five six", "en", "a"), (2, "one two three four five six", None, None), (None, "one two three four five six", "en", "a"), (None, None, None, None), (3, None, "en", "b"),
        (4, "", "en", "b"), (5, " \n\t ", "fr", "b"), (6, "...", "fr", "b"), (7, long, "en", "c"), (8, long + " end", "en", "c"), (9, "x" * 300_000, "de", "c"), (10, "a", "de", ""), (11, "a a a a a a a a", "de", ""), (12, "Ünïcödé \U0001f600 straße", "de", "d"),
        (13, "seven eight nine", "en", "d"), (13, "another text of the same id", "en", "d"),
    ]
    return docs_of(spark, rows).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """120 documents: originals, exact copies and copies with some words replaced, and their texts by doc_id."""
    rng, rows = random.Random(7), []
    for i in range(40):
        w = prose(rng, rng.choice((30, 120, 400))).split()
        for k in range(3):
            copy = list(w)
            for _ in range(len(w) * (0, 2, 9)[rng.randrange(3)] // 100):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append((i * 3 + k, " ".join(copy), ("en", "fr")[i % 2], f"s{i % 4}"))
    return docs_of(spark, rows).persist(), {r[0]: r[1] for r in rows}
