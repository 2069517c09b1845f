"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def discounts(counts):
    n = Counter(counts)
    if not n[1] or not n[2]:
        return [0, 0.5, 0.5, 0.5]
    y = n[1] / (n[1] + 2 * n[2])
    d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 0.5]
    return [0, *[min(max(x, 0), i + 1) for i, x in enumerate(d)]]


def language_model(docs):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score, score)}"""
    lines = {i: [*words(t), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    c, pairs = Counter(), Counter()
    for i, line in lines.items():
        if not held[i]:
            c.update(line)
            pairs.update(zip(["<s>", *line[:-1]], line))
    n, v = sum(c.values()), len(c)
    context, fans, cont = Counter(), defaultdict(Counter), Counter()
    for (u, w), k in pairs.items():
        context[u] += k
        fans[u][min(k, 3)] += 1
        cont[w] += 1
    d2, d1, types = discounts(pairs.values()), discounts(cont.values()), sum(cont.values())
    rest = sum(d1[min(k, 3)] for k in cont.values()) / types

    def p(u, w):
        k = cont[w]
        low = rest / (v + 1) + max(k - d1[min(k, 3)], 0) / types
        if not context[u]:
            return low
        k = pairs[u, w]
        return max(k - d2[min(k, 3)], 0) / context[u] + sum(d2[j] * fans[u][j] for j in (1, 2, 3)) / context[u] * low

    out = {}
    for i, line in lines.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in line)
        score = sum(math.log10(p(u, w)) for u, w in zip(["<s>", *line[:-1]], line))
        out[i] = (held[i], len(line), sum(c[w] > 0 for w in line), n, base, score)
    return out


def repeats(docs, span=100):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)}; docs in order of their ids."""
    import hashlib

    seen, out = set(), {}
    for i, text in sorted(docs):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - span + 1):
            window = data[p : p + span]
            if window in seen:
                covered[p : p + span] = b"\1" * span
            seen.add(window)
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out
