"""Words of UTF-8 texts as 64-bit keys, in NumPy; used inside tasks.

A word is a maximal run of bytes other than ASCII white space, upper-case A-Z lowered. Its key is a
polynomial over random byte values modulo 2**64, mixed with its length. Two different words
of a corpus share a key with a chance of about ``distinct**2 / 2**65``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 20  # bytes hashed at once
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_draw = np.random.default_rng(20240607)
BYTE_VALUE = _draw.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n-1 of the base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values with well-spread bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slices(data: bytes, limit: int = SLICE) -> Iterator[bytes]:
    """``data`` in pieces of about ``limit`` bytes, cut at ASCII white space only."""
    begin, size = 0, len(data)
    while size - begin > limit:
        end = begin + limit
        while end < size and not IS_SPACE[data[end]]:
            end += 1
        yield data[begin:end]
        begin = end
    yield data[begin:]


def _keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of ``data`` and the places where they start."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = ~IS_SPACE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    up, down = powers(max(len(raw), SLICE + 4096))
    prefix = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUE[raw] * up[: len(raw)], out=prefix[1:])
    keys = (prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * GOLD
    return mix(keys), start


def word_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of all texts in order, and the number of words of each text."""
    keys: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    pending: list[bytes] = []
    first = held = 0

    def flush() -> None:
        if pending:
            found, start = _keys(b"\n".join(pending))
            ends = np.cumsum([len(t) + 1 for t in pending])
            per = np.bincount(np.searchsorted(ends, start, side="right"), minlength=len(pending))
            counts[first : first + len(pending)] += per
            keys.append(found)

    for i, text in enumerate(texts):
        text = text or b""
        if len(text) > SLICE:
            flush()
            for piece in slices(text):
                found, _ = _keys(piece)
                keys.append(found)
                counts[i] += len(found)
            pending, first, held = [], i + 1, 0
            continue
        pending.append(text)
        held += len(text) + 1
        if held > SLICE // 2:
            flush()
            pending, first, held = [], i + 1, 0
    flush()
    return (np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)), counts


def window_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Keys of the windows of ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = mix(out * GOLD + words[k : k + n] + U(k))
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values
