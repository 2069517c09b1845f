"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only.

A source's budget is first spent on complete epochs of all its documents; what is left is filled in the
order of exponential keys -ln(u) / quality weight, prefix-summed until the budget is met, the last document
in part. u comes of a digest of the id (of the text where the id is NULL), so reruns agree. Keys fall into
buckets of exp(-key / SPREAD), and those into cells; sums per (source, bucket), then per cell of the one
bucket in which a source's budget ends, find the one cell of 2**24 whose documents are ranked one by one.
Equal rows of that cell are summed before they are ranked, and told apart by partition and place, so
neither a source nor a row repeated in a third of all rows lands in one task. What is known of a source is
broadcast up to BROADCAST_SOURCES sources, joined by shuffle beyond. ``mix`` decides with the text in hand:
texts are not shuffled.

Edge cases: NULL text has size 0; a NULL source is a source, ordered last; sources without words get
target 0. Ties in key go by doc_id (NULL first), size and text; of equal rows each has a share of its own,
dealt in any order. Very long texts are counted whole. Empty tables give empty results. Extra columns
survive ``mix``, but n_copies and taken_words, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.text import SPACE_RUN, carried, let, unpacked
from larkspur.session import written

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "mix-1"
# Buckets a source, and cells a bucket.
BUCKETS = 4096
# The least quality weight is 1 / SPREAD: keys are spread over the cells whatever the weights.
SPREAD = 21
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_RUN.replace("[", "[^"))), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Between 0 and 1: falls with the share of marks that prose lacks."""
    text = F.coalesce(text, F.lit(""))
    marks = F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))
    return 1 / (1 + 20 * marks / F.greatest(F.length(text), F.lit(1)))


def unit_draw(id_col: Column, text: Column, seed: str) -> Column:
    """In (0, 1), from 52 bits of a digest of the id, or of the text's hash where there is no id."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.xxhash64(text).cast("string")))
    digest = F.md5(F.concat(F.lit(seed + ":"), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target. ``sizes``: source, source_size, one row each.

    The level at which every target is the smaller of cap times its source and level times its weight:
    sources are met in the order of the level at which they are full, and the first one that the level
    over the rest does not fill gives it. One row per source goes through the ordered windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    base = sizes.withColumn("_weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    base = base.withColumn("_full", cap * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("_full") / F.col("_weight"), F.col("source").asc_nulls_last())
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = share * F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_full").over(before), F.lit(0.0))
    left = F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0))
    tried = base.withColumn("_level", rest / left)
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_full"), F.col("_level"))
    level = F.first(fits, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("_full"), F.coalesce(level * F.col("_weight"), F.col("_full")))
    return tried.select("source", "source_size", target.alias("target"))


def _draw(id_col: str, text_col: str, source_col: str, seed: str) -> dict[str, Column]:
    """What decides about a row: _id, _source, _size, _key, _hash (of the text), _cell and _bucket."""
    key = -F.ln(unit_draw(F.col(id_col), F.col(text_col), seed)) / quality_weight(F.col(text_col))
    last = BUCKETS * BUCKETS - 1
    cell = lambda key: F.least(F.floor((1 - F.exp(-key / SPREAD)) * (last + 1)), F.lit(last)).cast("int")
    made = {
        "_id": F.col(id_col), "_source": F.col(source_col), "_size": word_count(F.col(text_col)),
        "_hash": F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))),
    }
    drawn = let(key, lambda k: F.struct(k.alias("_key"), cell(k).alias("_cell"), F.floor(cell(k) / BUCKETS).cast("int").alias("_bucket")))
    return made | {"_drawn": drawn}


_DRAWN = ("_key", "_cell", "_bucket")


def _unfolded(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select(*columns, "_id", "_source", "_size", "_hash", *[F.col(f"_drawn.{c}").alias(c) for c in _DRAWN])


def draws(docs: DataFrame, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """_id, _source, _size, _hash, _key, _cell, _bucket of each row."""
    return _unfolded(docs.select(*[v.alias(k) for k, v in _draw(id_col, text_col, source_col, seed).items()]), [])


def _ends(sums: DataFrame, plans: DataFrame) -> DataFrame:
    """``plans`` with the first slot whose running sum reaches the rest as _end, and the sum before it as _before.

    ``sums``: _source, _slot, _sum. ``plans``: a row per source, with _rest and the sum _before all slots.
    """
    steps = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_slot")))
    kept = ["source_size", "target", "epochs", "_rest"]
    first = F.min(F.struct("_slot", (F.col("_before") + F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_first")
    return (
        steps.join(plans, F.col("_source").eqNullSafe(F.col("source")))
        .filter(F.col("_before") + F.col("_upto") >= F.col("_rest")).groupBy("source").agg(*[F.first(c).alias(c) for c in kept], first)
        .select("source", *kept, F.col("_first._before").alias("_before"), F.col("_first._slot").alias("_end"))
    )


def _with_plan(drawn: DataFrame, plans: DataFrame, sources: int) -> DataFrame:
    return drawn.join(F.broadcast(plans) if sources <= BROADCAST_SOURCES else plans, F.col("_source").eqNullSafe(F.col("source"))).drop("source")


def _plans(drawn: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, int]:
    """A row per source: target, epochs, the cell _end in which the _rest of its budget is met, the words _before that cell. And their number."""
    sums = drawn.groupBy("_source", F.col("_bucket").alias("_slot")).agg(F.sum("_size").alias("_sum"))
    targets = source_targets(sums.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    budget, size = F.round("target").cast("bigint"), F.greatest(F.col("source_size"), F.lit(1))
    rest = F.expr("cast(round(target) as bigint) % greatest(source_size, 1L)")
    plans = targets.withColumns({"epochs": F.floor(budget / size), "_rest": rest, "_before": F.lit(0).cast("bigint")})
    buckets = written(_ends(sums, plans), "buckets")
    sources = buckets.count()
    inside = _with_plan(drawn, buckets, sources).filter(F.col("_bucket") == F.col("_end"))
    return written(_ends(inside.groupBy("_source", F.col("_cell").alias("_slot")).agg(F.sum("_size").alias("_sum")), buckets), "cells"), sources


def _taken(drawn: DataFrame, plans: DataFrame, sources: int) -> DataFrame:
    """``drawn``, extra columns kept, with source_size, target, epochs and the words taken of each row."""
    joined = _with_plan(drawn, plans, sources)
    inside = F.col("_cell") == F.col("_end")
    # The one cell of a source in which its budget ends. Its rows stay where they are read; only sums of equal rows are ranked.
    edge = written(joined.filter(inside).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "edge")
    same = ["_source", "_key", "_id", "_size", "_hash"]
    parts = edge.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
    equal = parts.groupBy(*same).agg(F.sum(F.col("_n") * F.col("_size")).alias("_words"))
    ahead = F.coalesce(F.sum("_words").over(Window.partitionBy("_source").orderBy(*same[1:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.coalesce(F.sum("_n").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = lambda a, b, on: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on]
    starts = parts.withColumn("_place", place).alias("p").join(equal.withColumn("_ahead", ahead).alias("e"), every("p", "e", same))
    starts = starts.select(*[F.col(f"p.{c}").alias(c) for c in [*same, "_part"]], (F.col("_ahead") + F.col("_place") * F.col("p._size")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy(*same, "_part").orderBy("_at")) - 1
    met = edge.withColumn("_own", own).alias("d").join(starts.alias("s"), every("d", "s", [*same, "_part"]))
    left = F.col("_rest") - F.col("_before") - F.col("s._ahead") - F.col("_own") * F.col("d._size")
    part = F.greatest(F.lit(0), F.least(F.col("d._size"), left))
    shown = [*drawn.columns, "source_size", "target", "epochs"]
    at_end = met.select(*[F.col(f"d.{c}").alias(c) for c in shown], (F.col("epochs") * F.col("d._size") + part).cast("bigint").alias("taken"))
    clear = F.when(F.col("_cell") < F.col("_end"), F.col("_size")).otherwise(F.lit(0))
    others = joined.filter(~inside).select(*shown, (F.col("epochs") * F.col("_size") + clear).cast("bigint").alias("taken"))
    return others.unionByName(at_end)


def allot(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs and taken of every row."""
    drawn = written(draws(docs, seed, **columns), "draws")
    plans, sources = _plans(drawn, weights, share, cap)
    return _taken(drawn, plans, sources).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "epochs", "taken"
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes: taken_words, and n_copies whole or partial uses of the row."""
    plans, sources = _plans(written(draws(docs, seed, id_col, text_col, source_col), "draws"), weights, share, cap)
    docs = docs.drop("n_copies", "taken_words")
    held = carried(docs, **_draw(id_col, text_col, source_col, seed))
    drawn = _unfolded(held, [F.col(f"_carried{i}") for i in range(len(docs.columns))])
    copies = F.ceil(F.col("taken") / F.greatest("_size", F.lit(1))).cast("int").alias("n_copies")
    return _taken(drawn, plans, sources).filter("taken > 0").select(*unpacked(docs), copies, F.col("taken").alias("taken_words"))
