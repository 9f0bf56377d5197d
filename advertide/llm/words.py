"""Words and word windows of many texts at once, as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes outside a set of separators. Its hash is a
Rabin-Karp polynomial over its bytes, finished by a mixing step; a window's
hash is the same polynomial over the mixed word hashes. Both come from running
sums, so a window costs the same whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
# Bytes of texts worked on together; bounds the arrays of one step.
SLICE_BYTES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_ONE = np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base to 0 … n-1 and its inverses, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial over ``values[start:end]`` of each span, independent of where it lies."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def sliced(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about ``SLICE_BYTES``; a longer text is a run of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > SLICE_BYTES:
            yield slice(start, i)
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield slice(start, len(texts))


def separators(blanks: bytes = BLANKS) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(blanks)] = True
    return table


def word_hashes(texts: list[bytes], blank: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (with the end behind the last)."""
    buffer = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    if lower:
        buffer = np.where((buffer >= 65) & (buffer <= 90), buffer + np.uint8(32), buffer)
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    text_starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~blank[buffer]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    raw = _spans(buffer.astype(np.uint64) + _ONE, starts, ends)
    hashes = mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return hashes, np.searchsorted(starts, text_starts)


def windows(hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every window of ``length`` words inside one text: its hash, its text and the index of its first word."""
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.arange(len(hashes))
    first = first[first + length <= bounds[1:][owner]] if len(hashes) else first
    return mix(_spans(hashes, first, first + length) + np.uint64(length)), owner[first], first
