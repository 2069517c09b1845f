"""Exact top-k search by inner product over a bit-sliced index.

Vectors become integers. Rows are cut into blocks of about BLOCK_ROWS; in a block every attribute is kept
as SLICES bitmaps over the rows (its most significant bits). For a query the slices of all attributes are
added with bitmap arithmetic: the query's value is written in signed digits, each digit puts the
attribute's slices (complemented for a negative digit) on the pile of their weight, and piles are reduced
by full adders to one bitmap a weight, the bit-sliced score. The k-th best score is found from the most
significant slice down. Rows that the dropped low bits could still lift to it are the boundary, and are
resolved exactly by integer products. Blocks' winners are merged by rank.

Queries and rows meet by block number: an equality join of query batches with blocks, a stated query set
against all rows in blocks.

Edge cases: vectors that are NULL or hold NULL or non-finite components take no part; shorter vectors
count as padded with zeros. Rows with the query's own id are never its candidates, repeated ones included.
Every query row has its own answer: equal rows are searched once and answered each, an id asked with
several vectors is answered for each. Of candidates repeated under one id each row counts. Ties go to the
smaller vec_id. Fewer candidates than k give them all. Extra columns are left out; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import written

SCALE, K, SLICES = 256, 5, 5
BLOCK_ROWS, BATCH_QUERIES = 65_536, 4_096
# Tasks wanted at least: small inputs have few blocks, so queries are dealt over copies of them.
TASKS = 12


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and its vector as floor(scale * x) in bigint."""
    x = F.col(vector_col)
    usable = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return df.filter(F.col(id_col).isNotNull() & usable).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(scale * v.cast("double")).cast("bigint")).alias("v")
    )


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _small(m: np.ndarray, low: int, high: int) -> np.ndarray:
    return m.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def bitmaps(m: np.ndarray, low: int, shift: int, slices: int) -> np.ndarray:
    """(attributes * slices, words) uint64: bit r of row d * slices + b is bit b of the cut value of row r."""
    cut = ((m - low) >> shift).T
    words = (m.shape[0] + 63) // 64
    out = np.zeros((cut.shape[0] * slices, words * 8), dtype=np.uint8)
    for b in range(slices):
        packed = np.packbits((cut >> b) & 1, axis=1, bitorder="little")
        out[b::slices, : packed.shape[1]] = packed
    return out.view("<u8")


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(position, digit) of the form with the fewest non-zero digits."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


def add_slices(both: np.ndarray, query: np.ndarray, slices: int) -> tuple[list[np.ndarray], int]:
    """Bit-sliced sum, and what a digit form with complements adds to the true sum."""
    half, piles, extra = both.shape[0] // 2, {}, 0
    for d, value in enumerate(query.tolist()):
        for at, digit in signed_digits(value):
            base = d * slices + (0 if digit > 0 else half)
            for b in range(slices):
                piles.setdefault(at + b, []).append(base + b)
            extra += ((1 << slices) - 1 << at) if digit < 0 else 0
    sums, weight, carried = [], 0, None
    top = max(piles, default=-1)
    while weight <= top or carried is not None:
        pile = both[piles[weight]] if weight in piles else None
        if carried is not None:
            pile = carried if pile is None else np.concatenate([pile, carried])
        carries = []
        while pile is not None and len(pile) > 1:
            k = len(pile) // 3
            if k:
                a, b, c, rest = pile[:k], pile[k : 2 * k], pile[2 * k : 3 * k], pile[3 * k :]
                t = a ^ b
                carries.append((a & b) | (t & c))
                t ^= c
                pile = np.concatenate([t, rest]) if len(rest) else t
            else:
                carries.append(pile[:1] & pile[1:])
                pile = pile[:1] ^ pile[1:]
        sums.append(pile[0] if pile is not None else np.zeros(both.shape[1], dtype=both.dtype))
        carried = np.concatenate(carries) if carries else None
        weight += 1
    return sums, extra


def kth_largest(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """Value of the k-th largest score among the rows of a bitmap; 0 if there are fewer."""
    value = 0
    for w in range(len(sums) - 1, -1, -1):
        hits = rows & sums[w]
        n = int(np.bitwise_count(hits).sum())
        if n >= k:
            rows, value = hits, value | 1 << w
        else:
            k -= n
            rows = rows & ~sums[w]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """Bitmap of the rows whose score is value or more."""
    if value >> len(sums):
        return np.zeros_like(rows)
    more, same = np.zeros_like(rows), rows
    for w in range(len(sums) - 1, -1, -1):
        if value >> w & 1:
            same = same & sums[w]
        else:
            more = more | (same & sums[w])
            same = same & ~sums[w]
    return more | same


def search_block(ids: np.ndarray, m: np.ndarray, both: np.ndarray, shift: int, slices: int, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of a block's k best rows for one query. ``ids`` ascend."""
    n = len(ids)
    valid = np.zeros(both.shape[1] * 64, dtype=np.uint8)
    valid[:n] = 1
    valid[np.searchsorted(ids, query_id) : np.searchsorted(ids, query_id, side="right")] = 0
    rows = np.packbits(valid, bitorder="little").view("<u8")
    sums, _ = add_slices(both, query, slices)
    width = ((1 << shift) - 1) * int(np.abs(query).sum()) >> shift
    near = at_least(sums, rows, max(0, kth_largest(sums, rows, k) - width))
    at = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
    scores = m[at].astype(np.int64) @ query
    if len(at) > k:
        best = scores >= np.partition(scores, len(at) - k)[len(at) - k]
        at, scores = at[best], scores[best]
    order = np.lexsort((ids[at], -scores))[:k]
    return ids[at][order], scores[order]


def top_k(df: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames: vec_id, v (see ``quantised``)."""
    spark = df.sparkSession
    asked_rows = queries.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    # Vectors asked under one id are numbered in their order.
    queries = written(asked_rows.withColumn("nth", F.row_number().over(Window.partitionBy("vec_id").orderBy("v"))), "queries")
    span = F.aggregate(F.col("v"), F.lit(None).cast("bigint"), lambda a, x: F.least(a, x)), F.aggregate(F.col("v"), F.lit(None).cast("bigint"), lambda a, x: F.greatest(a, x))
    n, low, high, dims = df.agg(F.count(F.lit(1)), F.min(span[0]), F.max(span[1]), F.max(F.size("v"))).first()
    n_queries, q_dims = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    dims = max(dims, q_dims)
    low, high = min(low or 0, 0), max(high or 0, 0)
    slices = min(SLICES, max(1, (high - low).bit_length()))
    shift = max(0, (high - low).bit_length() - slices)
    n_blocks = -(-n // block_rows)
    copies = max(1, -(-TASKS // n_blocks))
    batch = min(BATCH_QUERIES, max(1, -(-n_queries // copies)))
    n_batches = -(-n_queries // batch)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        m = _matrix(pdf.v, dims)
        payload = (pdf.vec_id.to_numpy("<i8").tobytes(), _small(m, low, high).tobytes(), bitmaps(m, low, shift, slices).tobytes())
        return pd.DataFrame([(int(pdf.block.iloc[0]), *payload)], columns=["block", "ids", "matrix", "slices"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf[c].to_numpy("<i8").tobytes() for c in ("vec_id", "nth", "times")]
        return pd.DataFrame([(int(pdf.batch.iloc[0]), *parts, _matrix(pdf.v, dims).tobytes())], columns=["batch", "q_ids", "q_nth", "q_times", "q_matrix"])

    part = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    blocks = df.withColumn("block", part(n_blocks)).groupBy("block").applyInPandas(build, "block int, ids binary, matrix binary, slices binary")
    batches = queries.withColumn("batch", part(n_batches)).groupBy("batch").applyInPandas(gather, "batch int, q_ids binary, q_nth binary, q_times binary, q_matrix binary")
    rows = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asked = batches.withColumn("copy", (F.col("batch") % copies).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    kind = _small(np.zeros(1, dtype=np.int64), low, high).dtype

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples():
                ids, m = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.matrix, kind).reshape(-1, dims)
                plain = np.frombuffer(r.slices, "<u8").reshape(dims * slices, -1)
                both = np.concatenate([plain, ~plain])
                asked_ids, vectors = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_matrix, "<i8").reshape(-1, dims)
                found = [search_block(ids, m, both, shift, slices, int(q), v, k) for q, v in zip(asked_ids, vectors, strict=True)]
                sizes = [len(x[0]) for x in found]
                about = {name: np.repeat(np.frombuffer(getattr(r, f"q_{name}"), "<i8"), sizes) for name in ("ids", "nth", "times")}
                yield pd.DataFrame({
                    "query_id": about["ids"], "nth": about["nth"], "times": about["times"], "vec_id": np.concatenate([x[0] for x in found]), "score": np.concatenate([x[1] for x in found])
                })

    best = rows.join(asked, ["block", "copy"]).mapInPandas(search, "query_id bigint, nth bigint, times bigint, vec_id bigint, score bigint")
    order = F.row_number().over(Window.partitionBy("query_id", "nth").orderBy(F.desc("score"), "vec_id"))
    kept = best.withColumn("rank", order).filter(F.col("rank") <= k)
    return kept.withColumn("_each", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("query_id", "rank", "vec_id", "score")
