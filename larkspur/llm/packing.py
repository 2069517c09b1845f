"""Packing documents into training sequences by cutting-stock column generation.

Documents are tokenized once. Texts longer than a sequence give whole sequences and one rest. Piece lengths
in classes of GRAIN tokens make a histogram (at most CAPACITY / GRAIN rows), all that the driver sees. A
linear program over patterns, which say how many pieces of each class share a sequence, is solved by column
generation: the program's prices go into a knapsack by dynamic programming, which offers the next pattern.
Pattern counts are rounded down, what is left is packed first-fit by falling class. Pieces are ranked in
their class by two-level counting, and a rank's place in the list of patterns gives its sequence.

Edge cases: a NULL or empty text is the end id alone. Repeated rows are packed each; NULL ids are ids.
Empty tables give empty results. Extra columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.tokens import vocabulary_path, word_memo
from larkspur.session import written

CAPACITY, GRAIN, END = 4096, 8, 2
# Pieces that one task ranks, on average.
RANKED = 250_000
# Column generation ends when no pattern is worth more than this over its cost, or after so many rounds.
GAIN, ROUNDS = 1.0002, 2_500


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and the ids as little-endian uint32) of every piece."""
    path = path or vocabulary_path()
    tail = np.array([end], dtype="<u4").tobytes()
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = word_memo(path)
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], memo.encode(pdf["text"]), strict=True):
                ids += tail
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, *([part] if with_ids else [])))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(cut, schema)


def best_pattern(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most worth that fits, and how many of each size."""
    worth, chosen = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        worth[room] = worth[room - 1]
        if k := fitting[room]:
            offers = worth[room - sizes[:k]] + prices[:k]
            at = int(offers.argmax())
            if offers[at] > worth[room] + 1e-12:
                worth[room], chosen[room] = offers[at], at
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if chosen[room] < 0:
            room -= 1
        else:
            counts[chosen[room]] += 1
            room -= sizes[chosen[room]]
    return float(worth[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and their fractional counts, by the revised simplex method with priced columns."""
    m = len(sizes)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(patterns))
    amounts = demand / np.diag(patterns)
    for _ in range(ROUNDS):
        value, counts = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if value <= GAIN:
            break
        column = inverse @ counts
        ratios = np.full(m, np.inf)
        usable = column > 1e-9
        ratios[usable] = amounts[usable] / column[usable]
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        amounts = np.maximum(amounts - step * column, 0.0)
        amounts[out] = step
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
        patterns[out] = counts
    return patterns, amounts


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} with whole counts that hold every piece of the histogram exactly."""
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[int(s)] for s in sizes], dtype=float)
    patterns, amounts = solve(sizes, demand, capacity)
    left = demand.astype(np.int64)
    out = []
    for row, amount in zip(patterns.astype(np.int64), amounts, strict=True):
        used = row > 0
        times = int(min(amount + 1e-7, (left[used] // row[used]).min())) if used.any() else 0
        if times > 0:
            out.append(({int(s): int(c) for s, c in zip(sizes[used], row[used], strict=True)}, times))
            left -= times * row
    # First fit by falling class over what rounding left: a bounded number of pieces per class.
    while left.any():
        room, counts = capacity, {}
        for i in range(len(sizes) - 1, -1, -1):
            if (fit := min(int(left[i]), room // int(sizes[i]))) > 0:
                counts[int(sizes[i])] = fit
                room -= fit * int(sizes[i])
        times = min(int(left[i]) // counts[int(sizes[i])] for i in range(len(sizes)) if int(sizes[i]) in counts)
        out.append((counts, times))
        for i in range(len(sizes)):
            left[i] -= times * counts.get(int(sizes[i]), 0)
    return out


def layout(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: first rank, pieces per sequence, first sequence and first slot of each pattern that holds it."""
    rows: dict[int, list[tuple[int, ...]]] = {}
    at, sequence = {}, 0
    for counts, times in patterns:
        slot = 0
        for size in sorted(counts, reverse=True):
            rows.setdefault(size, []).append((at.get(size, 0), counts[size], sequence, slot))
            at[size] = at.get(size, 0) + counts[size] * times
            slot += counts[size]
        sequence += times
    return {size: tuple(np.array(x) for x in zip(*found, strict=True)) for size, found in rows.items()}


def ranked(found: DataFrame, total: int) -> DataFrame:
    """Adds _rank, 0-based in its class: places in (class, bucket), after the buckets before it."""
    buckets = max(16, total // RANKED)
    keyed = found.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy("_class", "_bucket").orderBy("doc_id", "start", "ids_crc32"))
    offsets = counts.select("_class", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    return keyed.withColumn("_place", place).join(offsets, ["_class", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_place") - 1)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, **options) -> DataFrame:
    """The pieces with sequence_id and offset."""
    found = written(pieces(docs, path, capacity, **options).withColumn("_class", F.ceil(F.col("length") / grain).cast("int")), "pieces")
    histogram = {r["_class"]: r["count"] for r in found.groupBy("_class").count().collect()}  # at most capacity / grain rows
    columns = [c for c in found.columns if c != "_class"]
    if not histogram:
        return found.select(*columns, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    where = layout(plan(histogram, capacity // grain))

    @F.pandas_udf("sequence bigint, slot int")
    def placed(kinds: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        kinds, ranks = kinds.to_numpy(), ranks.to_numpy()
        sequence, slot = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int32)
        for kind in np.unique(kinds):
            mine = kinds == kind
            first, per, base, offset = where[int(kind)]
            at = np.searchsorted(first, ranks[mine], side="right") - 1
            inside = ranks[mine] - first[at]
            sequence[mine], slot[mine] = base[at] + inside // per[at], offset[at] + inside % per[at]
        return pd.DataFrame({"sequence": sequence, "slot": slot})

    at = ranked(found, sum(histogram.values())).withColumn("_at", placed("_class", "_rank"))
    before = Window.partitionBy("_at.sequence").orderBy("_at.slot").rowsBetween(Window.unboundedPreceding, -1)
    return at.select(*columns, F.col("_at.sequence").alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
