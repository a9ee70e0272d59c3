"""Hashes of the words of many texts at once, in numpy: no Python loop over words.

A word is a run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 20
_GOLD, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _GOLD
        x = (x ^ (x >> U(30))) * _M1
        x = (x ^ (x >> U(27))) * _M2
        return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U))
_powers = np.ones(1, U)


def _power(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n, modulo 2**64."""
    global _powers
    if len(_powers) <= n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[U(1)], np.full(max(n, CHUNK), U(_BASE))]), dtype=U)
    return _powers


def _of_bytes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start of each word, and its hash."""
    a = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[a], [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, np.zeros(0, U)
    n = len(a)
    power = _power(n)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[U(0)], np.cumsum(_BYTE[a] * power[:n], dtype=U)])
        return start, mix((prefix[end] - prefix[start]) * power[n - start] * power[CHUNK - n] if n <= CHUNK else (prefix[end] - prefix[start]) * _shift(n, start))


def _shift(n: int, start: np.ndarray) -> np.ndarray:
    """For a piece longer than CHUNK: powers that bring a word to where it would be in a CHUNK (the base is odd, so it has an inverse)."""
    inverse = pow(_BASE, -1, 1 << 64)
    return np.array([pow(_BASE, CHUNK - int(s), 1 << 64) if s <= CHUNK else pow(inverse, int(s) - CHUNK, 1 << 64) for s in start], U)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes): the words of text i are hashes[offsets[i]:offsets[i + 1]]."""
    blobs = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    counts, hashes = np.zeros(len(blobs), np.int64), []
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            start, h = _of_bytes(b"\n".join(blobs[i] for i in group))
            ends = np.cumsum([len(blobs[i]) + 1 for i in group])
            np.add.at(counts, np.array(group)[np.searchsorted(ends, start, "right")], 1)
            hashes.append(h)
        group, size = [], 0

    for i, b in enumerate(blobs):
        if len(b) >= CHUNK:
            flush()
            at = 0
            while at < len(b):
                to = min(at + CHUNK, len(b))
                while at < to < len(b) and _IS_WORD[b[to - 1]]:  # back to a gap between words
                    to -= 1
                if to == at:  # one word fills the chunk: on to its end
                    to = at + CHUNK
                    while to < len(b) and _IS_WORD[b[to]]:
                        to += 1
                h = _of_bytes(b[at:to])[1]
                counts[i] += len(h)
                hashes.append(h)
                at = to
            continue
        if size + len(b) + 1 > CHUNK:
            flush()
        group.append(i)
        size += len(b) + 1
    flush()
    return np.concatenate([[0], np.cumsum(counts)]), np.concatenate([*hashes, np.zeros(0, U)])


def shingle_hashes(offsets: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of runs of n words; a text of fewer words, but one at least, has one shingle of all of them."""
    length = np.diff(offsets)
    count = np.where(length >= n, length - n + 1, np.minimum(length, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    end = np.repeat(offsets[1:], count)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), U)
        for k in range(n):
            pos = at + k
            inside = pos < end
            h = np.where(inside, mix(h * U(0x2545F4914F6CDD1D) + (hashes[np.minimum(pos, max(len(hashes) - 1, 0))] if len(hashes) else U(0))), h)
    return out, h


def bags(offsets: np.ndarray, hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the multiset of each text, sorted; elements are the top 64 - bits bits. Texts must number under 2**bits."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=U), np.diff(offsets))
    keys = np.sort((doc << U(64 - bits)) | (hashes >> U(bits)))
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    return (keys >> U(64 - bits)).astype(np.int64), keys & U((1 << (64 - bits)) - 1), count
