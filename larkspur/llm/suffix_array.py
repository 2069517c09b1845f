"""Suffix arrays by induced sorting, with whole buckets induced at once, and bounded common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next (S), the last one included."""
    n = len(s)
    sign = np.zeros(n, dtype=np.int8)
    sign[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    sign[-1] = 1
    # An equal neighbour takes the type of the suffix after it: the next place with a sign decides.
    places = np.where(sign != 0, np.arange(n), n)
    following = np.minimum.accumulate(places[::-1])[::-1]
    return sign[following] > 0


def induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix order from sorted leftmost-smaller places ``seeds``: larger suffixes left to right, then smaller ones right to left.

    A bucket's places induce their predecessors in one step; only predecessors in the same bucket need
    another, so there are as many steps in a bucket as its longest run of one symbol.
    """
    n = len(s)
    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    seed_symbols = s[seeds]
    bounds = np.searchsorted(seed_symbols, np.arange(symbols + 1))  # seeds ascend by symbol
    done_large: list[np.ndarray] = []
    empty = np.empty(0, dtype=np.int64)

    def deal(places: np.ndarray, want_small: bool, here: int, into: list[list[np.ndarray]]) -> np.ndarray:
        """Predecessors of the wanted type, put behind their buckets; those of bucket ``here`` are returned."""
        before = places[places > 0] - 1
        before = before[small[before] == want_small]
        if not len(before):
            return empty
        kinds = s[before]
        order = np.argsort(kinds, kind="stable")
        before, kinds = before[order], kinds[order]
        cuts = np.flatnonzero(np.diff(kinds)) + 1
        same = empty
        for part in np.split(before, cuts):
            symbol = int(s[part[0]])
            if symbol == here:
                same = part
            else:
                into[symbol].append(part)
        return same

    for c in range(symbols):
        bucket = list(larger[c])
        wave = np.concatenate(bucket) if bucket else empty
        parts = []
        while len(wave):
            parts.append(wave)
            wave = deal(wave, False, c, larger)
        done_large.append(np.concatenate(parts) if parts else empty)
        deal(seeds[bounds[c] : bounds[c + 1]], False, -1, larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out: list[np.ndarray] = [empty] * symbols
    # From the right, so everything is kept in reverse order; the last suffix is the seed of its own.
    smaller[int(s[n - 1])].append(np.array([n - 1]))
    for c in range(symbols - 1, -1, -1):
        wave = np.concatenate(smaller[c]) if smaller[c] else empty
        parts = []
        while len(wave):
            parts.append(wave)
            wave = deal(wave, True, c, smaller)
        own = np.concatenate(parts) if parts else empty
        deal(done_large[c][::-1], True, -1, smaller)
        out[c] = np.concatenate([done_large[c], own[::-1]])
    return np.concatenate(out)


def suffix_array(s: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of ``s`` (symbols below ``symbols``), or order by their first ``depth`` symbols at least.

    Leftmost-smaller (LMS) substrings are ordered by one induction, named, and the string of names, at most
    half as long, is ordered in turn; its order seeds the final induction. Names are many, so that string
    is ordered by doubling ranks rather than by buckets.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    small = suffix_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return induce(s, small, lms, symbols)
    rough = induce(s, small, lms[np.argsort(s[lms], kind="stable")], symbols)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    names = _names(s, ordered, lms)
    reduced = names[lms]
    order = _ranked(reduced, None if depth is None else depth // 2 + 1)
    return induce(s, small, lms[order], symbols)


def _names(s: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Equal LMS substrings get equal names that ascend in the order found."""
    n = len(s)
    length = np.zeros(n, dtype=np.int64)
    length[lms] = np.concatenate([lms[1:], [n - 1]]) - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    going = np.flatnonzero(same)
    at = 0
    while len(going):
        x, y = a[going] + at, b[going] + at
        equal = s[x] == s[y]
        same[going[~equal]] = False
        at += 1
        going = going[equal & (length[a[going]] > at)]
    names = np.zeros(n, dtype=np.int64)
    names[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return names


def _ranked(names: np.ndarray, depth: int | None) -> np.ndarray:
    """Order of the suffixes of a string of names, by ranks of prefixes that double in length."""
    n, rank, step = len(names), names, 1
    order = np.argsort(rank, kind="stable")
    while True:
        if rank.max() == n - 1 or (depth is not None and step >= depth) or step >= n:
            return np.argsort(rank, kind="stable")
        after = np.zeros(n, dtype=np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        step *= 2


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each suffix, what it shares with the one before it in order, up to ``most`` bytes."""
    n = len(data)
    padded = np.frombuffer(data + b"\0" * (most + 16), dtype=np.uint8)
    wide = np.ndarray(shape=(n + most + 8,), dtype="<u8", buffer=padded, strides=(1,))
    shared = np.zeros(len(order), dtype=np.int64)
    going = np.arange(1, len(order))
    for at in range(0, most, 8):
        x, y = wide[order[going] + at], wide[order[going - 1] + at]
        differ = x ^ y
        equal = differ == 0
        bits = differ[~equal]
        shared[going[~equal]] = at + _trailing_zero_bytes(bits)
        going = going[equal]
        if not len(going):
            break
    shared[going] = most
    out = np.zeros(n, dtype=np.int64)
    out[order] = np.minimum(shared, most)
    return out


def _trailing_zero_bytes(x: np.ndarray) -> np.ndarray:
    low = x & (~x + np.uint64(1))
    return np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8
