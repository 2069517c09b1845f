"""Interpolated modified Kneser-Ney bigram model, counted in Spark, scored from memory-mapped arrays.

Training words are counted first: tasks send sorted arrays of word hashes and counts by hash range, merged
per range into sorted hash arrays in the shared folder; a word's place in them is its id. Pairs of ids are
counted the same way by ranges of the context's id, so one task sees a whole context and writes its total
and its numbers of followers seen once, twice and more. The numbers of contexts per follower (continuation
counts) are summed per word range. Discounts come of the counts of counts. Scoring tasks map the arrays
and look their words and pairs up by bisection; nothing of the model is held in memory or sent around. The
arrays are a bounded number of files, written by parts of bounded size (see ``store``).

p(w | u) = (c(uw) - D(c(uw))) / c(u) + g(u) p(w), p(w) = (k(w) - D'(k(w))) / K + g' / (V + 1), where k are
continuation counts; a word not seen in training has only the last term.

Ids are integers (cast to bigint). Edge cases: NULL, empty and blank texts are the end token alone. A NULL id
is written "null" for the fold. Repeated rows count each, and equal texts have equal scores. Very long texts
are counted and scored whole. Extra columns are left out, whatever their names. Without training documents
every probability is 1 / (V + 1) with V = 0; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm import counting, store
from larkspur.llm.counting import PACKED
from larkspur.llm.hashing import grouped, word_hashes
from larkspur.session import fresh_dir, written

FOLDS = 10
SHARD_BYTES = 24 << 20
# Bytes of text scored together: at least so many, and more for each file to look into.
TOGETHER, TOGETHER_A_FILE = 1 << 20, 8 << 10
# Fixed value: the end token's hash, which no word has but by chance.
END = np.uint64(0x5E0FE0D0C5E0FE0D)
# Ids take 32 bits of a pair's number; one past the last word begins a text, one more follows unknown words.
MOST_WORDS = (1 << 32) - 3


def fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % folds


def tokens(group: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end token, and where each text begins (and the last ends)."""
    hashes, bounds = word_hashes(group)
    out = np.full(len(hashes) + len(group), END, dtype=np.uint64)
    begins = bounds + np.arange(len(bounds))
    words = np.ones(len(out), dtype=bool)
    words[begins[1:] - 1] = False
    out[words] = hashes
    return out, begins


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D for counts 0 to 3 and more; where counts of counts are missing, half a count."""
    if min(n1, n2) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *[min(max(x, 0.0), i + 1.0) for i, x in enumerate(d[1:])]])


@dataclass
class Model:
    """Where the arrays are, and the few numbers that stand for the whole corpus."""

    folder: str
    parts: store.Parts
    offsets: np.ndarray  # first id of each word file, and the number of words
    total: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    word_rest: float
    types: int

    @property
    def size(self) -> int:
        return int(self.offsets[-1])


def _ids(hashes: np.ndarray, folder: str, parts: store.Parts, offsets: np.ndarray) -> np.ndarray:
    """Ids of hashes; the number of words for unknown ones."""
    distinct, back = np.unique(hashes, return_inverse=True)
    file, place, hit = store.find(distinct, folder, "word", parts)
    return np.where(hit, offsets[file] + place, offsets[-1])[back]


def _ranges(size: int, parts: int) -> np.ndarray:
    """First context id of each part; the context past the last word is the beginning of a text."""
    return np.array([p * (size + 1) // parts for p in range(parts + 1)], dtype=np.int64)


def _by_context(keys: np.ndarray, ranges: np.ndarray):
    """(range, from, to) of sorted pairs by their contexts' ranges."""
    return store.runs_of(np.searchsorted(ranges, (keys >> np.uint64(32)).astype(np.int64), side="right") - 1)


def _pairs(ids: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Context and word of every token as one number."""
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[begins[:-1]] = size
    return before.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64)


def _pack_all(batches: Iterator[pd.DataFrame], keys, files_in, together: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for pdf in batches:
        for group in grouped(pdf["text"], together):
            held.append(keys(group))
            size += len(held[-1])
            if size > counting.GATHERED:
                yield from counting.pack(held, files_in)
                held, size = [], 0
    if size:
        yield from counting.pack(held, files_in)


def _together(parts: store.Parts) -> int:
    return max(TOGETHER, parts.files * TOGETHER_A_FILE)


def train(docs: DataFrame, text_col: str = "text") -> Model:
    spark = docs.sparkSession
    docs = docs.select(F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, folder = store.parts_for(size, SHARD_BYTES), fresh_dir(spark, "model")

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _pack_all(batches, lambda group: tokens(group)[0], parts.files_in, _together(parts))

    def merge_words(f: int, found) -> Iterator[pd.DataFrame]:
        n = total = 0
        with store.writing(folder, [f"word-{f}", f"wordn-{f}"]) as (word, count):
            for _, keys, counts in found:
                word(keys)
                count(counts.astype("<u8"))
                n, total = n + len(keys), total + int(counts.sum())
        yield pd.DataFrame([(f, n, total)], columns=["file", "n", "total"])

    subs_in = lambda f, keys: store.runs_of(parts.part_of(keys) - f * parts.subs)
    counted = counting.by_file(docs.mapInPandas(words, PACKED), parts.files, parts.subs, subs_in, merge_words, "file int, n bigint, total bigint")
    sizes = np.zeros(parts.files, dtype=np.int64)
    total, made = 0, set()
    for r in counted.collect():  # a row per file
        sizes[r.file], total = r.n, total + r.total
        made.add(r.file)
    store.fill(folder, ["word", "wordn"], parts.files, made)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    n_words = int(offsets[-1])
    if n_words > MOST_WORDS:
        raise ValueError(f"{n_words} distinct words: a pair of ids takes 64 bits, so at most {MOST_WORDS} are modelled")
    fine = _ranges(n_words, parts.total)
    ranges = fine[:: parts.subs]

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def keys(group: list[bytes]) -> np.ndarray:
            hashes, begins = tokens(group)
            return _pairs(_ids(hashes, folder, parts, offsets), begins, n_words)

        return _pack_all(batches, keys, lambda found: _by_context(found, ranges), _together(parts))

    def followers_by_file(held: list[np.ndarray]) -> pd.DataFrame:
        ids, contexts = np.unique(np.concatenate(held), return_counts=True)
        rows = [(w, *[0] * 4, ids[a:b].astype("<u4").tobytes(), contexts[a:b].astype("<u4").tobytes()) for w, a, b in store.runs_of(np.searchsorted(offsets, ids, side="right") - 1)]
        return pd.DataFrame(rows, columns=SENT)

    def merge_pairs(f: int, found) -> Iterator[pd.DataFrame]:
        few, held, size = np.zeros(4, dtype=np.int64), [], 0
        with store.writing(folder, [f"{name}-{f}" for name in PAIR_ARRAYS]) as (pair, pairn, paira, pairl, ctx, fan):
            n = 0
            for sub, keys, counts in found:
                large = np.flatnonzero(counts > 254)
                pair(keys)
                pairn(np.minimum(counts, 255).astype("u1"))
                paira((large + n).astype("<u8"))
                pairl(counts[large].astype("<u8"))
                n += len(keys)
                low, high = fine[f * parts.subs + sub], fine[f * parts.subs + sub + 1]
                context, width = (keys >> np.uint64(32)).astype(np.int64) - low, int(high - low)
                ctx(np.bincount(context, weights=counts, minlength=width).astype("<u8"))
                fan(np.stack([np.bincount(context[c], minlength=width) for c in (counts == 1, counts == 2, counts > 2)], axis=1).astype("<u4"))
                few += [int((counts == k).sum()) for k in (1, 2, 3, 4)]
                held.append((keys & np.uint64(0xFFFFFFFF)).astype(np.int64))
                size += len(keys)
                if size > counting.GATHERED:
                    yield followers_by_file(held)
                    held, size = [], 0
        if size:
            yield followers_by_file(held)
        # The counts of counts go with no followers, under the number of the file that is past the last.
        yield pd.DataFrame([(-1 - f, *few.tolist(), b"", b"")], columns=SENT)

    schema = "words int, t1 bigint, t2 bigint, t3 bigint, t4 bigint, ids binary, contexts binary"
    packed = docs.mapInPandas(pairs, PACKED)
    by_fine = lambda f, keys: store.runs_of(np.searchsorted(fine, (keys >> np.uint64(32)).astype(np.int64), side="right") - 1 - f * parts.subs)
    sent = written(counting.by_file(packed, parts.files, parts.subs, by_fine, merge_pairs, schema), "pairs")
    made = {-1 - r.words for r in sent.filter("words < 0").select("words").collect()}  # a row per file
    for f in set(range(parts.files)) - made:
        list(merge_pairs(f, ((s, np.empty(0, "<u8"), np.empty(0, np.int64)) for s in range(parts.subs))))

    def merge_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for w, rows in groupby(counting.streamed(batches), key=lambda r: r.words):
            counts = np.zeros(int(sizes[w]), dtype=np.int64)
            for r in rows:
                counts[np.frombuffer(r.ids, "<u4").astype(np.int64) - offsets[w]] += np.frombuffer(r.contexts, "<u4")
            store.put(folder, f"cont-{w}", counts.astype("<u8"))
            kinds = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            yield pd.DataFrame([(w, *kinds, int((counts > 2).sum()), int(counts.sum()))], columns=["words", "t1", "t2", "t3", "t4", "t3up", "types"])

    few = sent.filter("words < 0").groupBy().agg(*[F.sum(f"t{k}") for k in (1, 2, 3, 4)]).first()
    dealt = sent.filter("words >= 0").repartition(parts.files, "words").sortWithinPartitions("words")
    conts = dealt.mapInPandas(merge_contexts, "words int, t1 bigint, t2 bigint, t3 bigint, t4 bigint, t3up bigint, types bigint").collect()  # a row per file
    store.fill(folder, ["cont"], parts.files, {r.words for r in conts})
    cont = [sum(r[i] for r in conts) for i in range(1, 7)]
    d1 = discounts(*cont[:4])
    rest = (d1[1] * cont[0] + d1[2] * cont[1] + d1[3] * cont[4]) / cont[5] if cont[5] else 1.0
    return Model(folder, parts, offsets, total, discounts(*[x or 0 for x in few]), d1, float(rest), cont[5])


SENT = ["words", "t1", "t2", "t3", "t4", "ids", "contexts"]
# Pairs, their counts in a byte each, places and counts of the few of 255 and more; totals of contexts, their followers by count.
PAIR_ARRAYS = ["pair", "pairn", "paira", "pairl", "ctx", "fan"]


def _gather(model: Model, name: str, dtype: str, ids: np.ndarray, edges: np.ndarray, columns: int = 1) -> np.ndarray:
    """Values of the files' arrays at ids below the last edge; 0 elsewhere."""
    distinct, back = np.unique(ids, return_inverse=True)
    out = np.zeros((len(distinct), columns) if columns > 1 else len(distinct), dtype=np.float64)
    known = int(np.searchsorted(distinct, edges[-1]))
    for f, a, b in store.runs_of(np.searchsorted(edges, distinct[:known], side="right") - 1):
        values = store.get(model.folder, f"{name}-{f}", dtype)
        if len(values):
            out[a:b] = (values.reshape(-1, columns) if columns > 1 else values)[distinct[a:b] - edges[f]]
    return out[back]


def probabilities(model: Model, ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each token from its id and its context-and-word number."""
    v = model.size
    word_uniform = model.word_rest / (v + 1)
    k = _gather(model, "cont", "<u8", ids, model.offsets)
    lower = word_uniform + (np.maximum(k - model.word_discounts[np.minimum(k, 3).astype(np.int64)], 0) / model.types if model.types else 0)
    distinct, back = np.unique(keys, return_inverse=True)
    context, word = (distinct >> np.uint64(32)).astype(np.int64), (distinct & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ranges = _ranges(v, model.parts.total)[:: model.parts.subs]
    counts = np.zeros(len(distinct))
    inside = int(np.searchsorted(context, v + 1)) if model.types else 0
    for s, a, b in _by_context(distinct[:inside], ranges):
        found = store.get(model.folder, f"pair-{s}", "<u8")
        if not len(found):
            continue
        at = np.minimum(np.searchsorted(found, distinct[a:b]), len(found) - 1)
        c = np.where(found[at] == distinct[a:b], store.get(model.folder, f"pairn-{s}", "u1")[at], 0).astype(np.float64)
        if (c == 255).any():
            large = c == 255
            c[large] = store.get(model.folder, f"pairl-{s}", "<u8")[np.searchsorted(store.get(model.folder, f"paira-{s}", "<u8"), at[large])]
        counts[a:b] = c
    contexts, where = np.unique(context, return_inverse=True)
    # An unknown word shares its number with the beginning of a text only as a follower, never as a context here.
    totals = _gather(model, "ctx", "<u8", contexts, ranges) if model.types else np.zeros(len(contexts))
    fans = _gather(model, "fan", "<u4", contexts, ranges, 3) if model.types else np.zeros((len(contexts), 3))
    d = model.pair_discounts
    gamma = (fans @ d[1:]) / np.maximum(totals, 1)
    total, gamma = totals[where], np.where(totals > 0, gamma, 1.0)[where]
    higher = np.maximum(counts - d[np.minimum(counts, 3).astype(np.int64)], 0) / np.maximum(total, 1)
    higher = np.where(word < v, higher, 0.0)
    return np.log10(higher[back] + gamma[back] * lower)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of every row."""
    v, n = model.size, model.total

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, doc_ids = [], iter(pdf["doc_id"])
            for group in grouped(pdf["text"], _together(model.parts)):
                hashes, begins = tokens(group)
                ids = _ids(hashes, model.folder, model.parts, model.offsets)
                keys = _pairs(ids, begins, v)
                # The context after an unknown word has no entry: a number past the beginning's.
                unknown = np.zeros(len(ids), dtype=bool)
                unknown[1:] = ids[:-1] == v
                unknown[begins[:-1]] = False
                keys[unknown] += np.uint64(1) << np.uint64(32)
                c = _gather(model, "wordn", "<u8", ids, model.offsets)
                base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
                full = probabilities(model, ids, keys)
                sums = [np.add.reduceat(x, begins[:-1]) for x in ((ids < v).astype(np.int64), base, full)]
                for size, known, b, f in zip(np.diff(begins).tolist(), *[x.tolist() for x in sums], strict=True):
                    rows.append((next(doc_ids), size, known, b, f, 10 ** (-f / size)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_known", "base_score", "score", "perplexity"]).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(scored, schema)


def score_all(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Every document scored by a model of those outside fold 0."""
    model = train(docs.filter(fold(F.col("doc_id"), folds) != 0))
    out = score(docs, model).withColumns({"held_out": fold(F.col("doc_id"), folds) == 0, "train_tokens": F.lit(model.total).cast("bigint")})
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
