"""Quality classifier by positive-unlabelled learning.

Texts become TRAITS (shares of kinds of characters, words and repeats) and shares of hashed words and hashed
byte trigrams, computed from whole texts. A network with one hidden layer is fitted to the non-negative
unbiased risk of trusted positives (label 1) and unlabelled rows with the class prior pi:

    pi E_p[l(f)] + max(0, E_u[l(-f)] - pi E_p[l(-f)]),   l(z) = log(1 + exp(-z)),

whose second part, when negative, is climbed instead of descended. The prior is estimated from positives and
unlabelled rows alone: a network that tells the two apart is fitted to half of the sample, and in the other
half the least ratio of the share of unlabelled rows to that of positives above a score bounds the part of
positives among the unlabelled. At most SAMPLE positives and SAMPLE unlabelled rows, those of least digest
of id and text, are fitted on; every row is scored. Labels of 0 are not used.

Labels of the held-out folds are never read, and only the text makes a score. Ids are integers (cast to
bigint). Edge cases: NULL and empty texts have the features of no words and are scored like others. Rows with
NULL labels are unlabelled, so are rows with a NULL id. Several labels of one id count once; repeated rows
are scored each and fitted on once; ties in digest go by id. Very long texts are measured whole. Extra
columns are left out. Without trusted positives every score is 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.hashing import _SPACE, grouped, word_hashes
from larkspur.llm.language_model import fold

FOLDS, THRESHOLD, SAMPLE = 5, 0.3, 10_000
HIDDEN, STEPS, BATCH, RATE, DECAY, SEED = 24, 500, 2_000, 0.01, 1e-3, 7
# Buckets of hashed words, and of hashed trigrams. They are many and each says little: their deviations count so much less than traits'.
BUCKETS, HASHED = 256, 12
# Least share of positives above a score at which the prior is read, and its confidence.
LEAST_SHARE, DELTA = 0.05, 0.1

# The kinds of bytes whose shares are traits.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|",
    "percent": b"%", "dollar": b"$", "amp": b"&", "star": b"*", "hash": b"#", "angle": b"<>", "bracket": b"()[]{}", "slash": b"/\\:@_=-+", "line": b"\n", "high": bytes(range(128, 256)),
}
_TABLE = np.zeros(256, dtype=np.uint8)
for _i, _bytes in enumerate(KINDS.values()):
    _TABLE[list(_bytes)] = _i + 1
TRAITS = [*KINDS, "word_length", "same_as_before", "same_as_two_before", "distinct", "log_words", "log_lines"]
FEATURES = len(TRAITS) + 2 * BUCKETS


def features(group: list[bytes]) -> np.ndarray:
    """(texts, FEATURES) of whole texts."""
    sizes = np.array([len(x) for x in group])
    owner = np.repeat(np.arange(len(group)), sizes)
    data = np.frombuffer(b"".join(group), dtype=np.uint8)
    kinds = len(KINDS) + 1
    counts = np.bincount(owner * kinds + _TABLE[data], minlength=len(group) * kinds).reshape(-1, kinds)[:, 1:].astype(np.float64)
    chars = np.maximum(sizes - np.bincount(owner, weights=_SPACE[data], minlength=len(group)), 1)
    hashes, bounds = word_hashes(group)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(group)), n)
    out = np.zeros((len(group), FEATURES), dtype=np.float32)
    words = np.maximum(n, 1)
    out[:, : kinds - 1] = np.log1p(8 * counts / chars[:, None])
    out[:, kinds - 1] = np.log(chars / words)
    for k in (1, 2):
        again = np.zeros(len(hashes), dtype=bool)
        again[k:] = (hashes[k:] == hashes[:-k]) & (text[k:] == text[:-k])
        out[:, kinds - 1 + k] = np.log1p(4 * np.bincount(text, weights=again, minlength=len(group)) / words)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        # Distinct words against the square root of words, which long clean texts approach alike.
        out[i, kinds + 2] = np.log((len(np.unique(hashes[a:b])) + 1) / np.sqrt(b - a + 1))
    out[:, kinds + 3], out[:, kinds + 4] = np.log1p(n), np.log1p(counts[:, list(KINDS).index("line")])
    spread = lambda owner, bucket, total: np.log1p(
        BUCKETS * np.bincount(owner * BUCKETS + bucket, minlength=len(group) * BUCKETS).reshape(-1, BUCKETS) / np.maximum(total, 1)[:, None]
    )
    out[:, len(TRAITS) : -BUCKETS] = spread(text, (hashes % np.uint64(BUCKETS)).astype(np.int64), n)
    wide = data.astype(np.uint32)
    three = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)) if len(data) > 2 else wide[:0]
    whole = owner[:-2] == owner[2:] if len(data) > 2 else np.empty(0, dtype=bool)
    bucket = ((three ^ three >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int64) % BUCKETS
    out[:, -BUCKETS:] = spread(owner[:-2][whole] if len(data) > 2 else owner[:0], bucket[whole], np.maximum(sizes - 2, 0))
    return out


class Network:
    """Standardised features through one hidden layer to a logit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: list[np.ndarray]):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -40, 40)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def _slope(z: np.ndarray) -> np.ndarray:
    return -1 / (1 + np.exp(np.clip(z, -40, 40)))


def risk(f: np.ndarray, p: int, prior: float) -> tuple[float, np.ndarray]:
    """What is descended, and its slope by logit: the unbiased risk of logits f, the first p of positives, or
    minus the risk of negatives where that has fallen below 0."""
    fp, fu = f[:p], f[p:]
    rest = _loss(-fu).mean() - prior * _loss(-fp).mean()
    negative = np.concatenate([prior * _slope(-fp) / p, -_slope(-fu) / len(fu)])
    if rest < 0:
        return float(-rest), -negative
    return float(prior * _loss(fp).mean() + rest), negative + np.concatenate([prior * _slope(fp) / p, np.zeros(len(fu))])


def contrast(f: np.ndarray, p: int, _: float) -> tuple[float, np.ndarray]:
    """The logistic risk of telling positives from unlabelled rows, and its slope by logit."""
    fp, fu = f[:p], f[p:]
    return float(_loss(fp).mean() + _loss(-fu).mean()), np.concatenate([_slope(fp) / p, -_slope(-fu) / len(fu)])


def gradients(x: np.ndarray, weights: list[np.ndarray], p: int, prior: float, objective=risk) -> tuple[float, list[np.ndarray]]:
    hidden = np.tanh(x @ weights[0] + weights[1])
    value, g = objective(hidden @ weights[2] + weights[3], p, prior)
    g = g.astype(x.dtype)
    back = np.outer(g, weights[2]) * (1 - hidden**2)
    return value, [x.T @ back, back.sum(axis=0), hidden.T @ g, np.array(g.sum())]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, objective=risk) -> Network:
    """Minimises the risk by Adam over batches of the given rows."""
    rng = np.random.default_rng(SEED)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + np.float32(0.05)
    scale[len(TRAITS) :] *= HASHED
    xp, xu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = xp.shape[1]
    weights = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
    weights = [w.astype(xp.dtype) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        some = [x if len(x) <= BATCH else x[rng.integers(0, len(x), BATCH)] for x in (xp, xu)]
        _, grads = gradients(np.concatenate(some), weights, len(some[0]), prior, objective)
        rate = RATE * min(1.0, 2 - 2 * t / (steps + 1))
        for i, grad in enumerate(grads):
            grad = grad + DECAY * weights[i]
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.999 * second[i] + 0.001 * grad**2
            weights[i] = weights[i] - (rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(weights[i].dtype)
    return Network(mean, scale, weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, by the least ratio of their parts above a score.

    Above any score the unlabelled are at least the prior times the positives there, and where only positives
    score the two are equal. The score is chosen by the ratio's upper confidence bound.
    """
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    network = fit(positive[::2], unlabelled[::2], 0.5, objective=contrast)
    fp, fu = np.sort(network.logits(positive[1::2])), np.sort(network.logits(unlabelled[1::2]))
    share = 1 - np.arange(len(fp)) / len(fp)
    above = 1 - np.searchsorted(fu, fp) / len(fu)
    width = np.sqrt(np.log(4 / DELTA) / 2) * (len(fp) ** -0.5 + len(fu) ** -0.5)
    bound = np.where(share >= LEAST_SHARE, (above + width) / share, np.inf)
    at = int(bound.argmin())
    return float(np.clip(above[at] / share[at], 0.01, 0.99))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))


def _least(rows: DataFrame, n: int) -> DataFrame:
    """At most n of the rows (doc_id, th), by least digest: a bounded sample that reruns repeat."""
    return rows.filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(SEED), "doc_id", "th"), "doc_id", "th").limit(n)


def _sample(rows: DataFrame, positive: DataFrame, n: int) -> list[np.ndarray]:
    """Features of the sampled unlabelled and positive rows: at most 2 n rows of 2 * FEATURES bytes reach the driver."""
    ids = rows.select("doc_id", "th")
    chosen = _least(ids, n).withColumn("trusted", F.lit(False)).unionAll(_least(ids.join(positive, "doc_id", "left_semi"), n).withColumn("trusted", F.lit(True)))
    texts = rows.join(F.broadcast(chosen), ["doc_id", "th"]).dropDuplicates(["doc_id", "th", "trusted"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if found := [features(group) for group in grouped(pdf["text"], 1 << 21)]:
                x = np.concatenate(found).astype("<f2")
                yield pd.DataFrame({"doc_id": pdf["doc_id"], "th": pdf["th"], "trusted": pdf["trusted"], "x": [row.tobytes() for row in x]})

    found = texts.mapInPandas(run, "doc_id bigint, th bigint, trusted boolean, x binary").orderBy(F.xxhash64(F.lit(SEED), "doc_id", "th"), "doc_id", "th").collect()
    load = lambda trusted: np.frombuffer(b"".join(r.x for r in found if r.trusted == trusted), "<f2").reshape(-1, FEATURES).astype(np.float32)
    return [load(False), load(True)]


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row. ``labels``: doc_id, quality (1: trusted positive)."""
    rows = _keys(docs, id_col, text_col)
    trusted = labels.select(F.col("doc_id").cast("bigint").alias("doc_id")).filter((fold(F.col("doc_id"), folds) != 0) & (labels["quality"] == 1)).distinct()
    unlabelled, positive = _sample(rows.filter(fold(F.col("doc_id"), folds) != 0), trusted, sample)
    network = fit(positive, unlabelled, class_prior(positive, unlabelled)) if len(positive) and len(unlabelled) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [np.full(len(g), 0.5) if network is None else network.scores(features(g)) for g in grouped(pdf["text"], 1 << 21)]
            if scores:
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": np.concatenate(scores)})

    scored = rows.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
