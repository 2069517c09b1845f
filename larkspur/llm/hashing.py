"""Vectorised words and hashes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from larkspur.llm import memory

# White space of the contracts as bytes.
SPACE_BYTES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[SPACE_BYTES] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BYTE = np.random.default_rng(20250101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
memory.when_idle(_powers.clear)


def _power(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i below n."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        found = _powers[base] = np.multiply.accumulate(steps)
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit counts."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grouped(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """UTF-8 texts in groups of about ``limit`` bytes; a longer text stands alone."""
    group, size = [], 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if group and size + len(data) > limit:
            memory.busy()
            yield group
            group, size = [], 0
        group.append(data)
        size += len(data) + 1
    if group:
        memory.busy()
        yield group


def word_hashes(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lowered, and where each text's words begin (and end)."""
    data = _LOWER[np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
    begins = np.concatenate([[0], np.cumsum([len(x) + 1 for x in group])])
    return hashes, np.searchsorted(starts, begins)


def shingle_sets(group: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of n words; a shorter text is one run."""
    hashes, bounds = word_hashes(group)
    runs = np.full(max(0, len(hashes) - n + 1), n, dtype=np.uint64)
    for k in range(n):
        runs = mix(runs + hashes[k : len(runs) + k])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for h in hashes[a:b]:
                short = mix(short + h)
            out.append(short)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
