"""Global prefix sums, ranks and order statistics without a one-task window over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larkspur.functions.expr import quoted
from larkspur.session import written

# Rows up to which one task may rank or sort; beyond it the partitioned way is taken.
ONE_TASK_ROWS = 200_000
# Accuracy of approximate percentiles, and the share of the rows on each side of a rank that brackets it whatever their error.
ACCURACY, SPREAD = 10_000, 0.0005


def prefix_sum(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the running sum of ``value`` in the order of the ``order`` columns (they should be unique).

    Rows are range partitioned, each partition sums itself, and the sums of the partitions before it
    (one row per partition, so a bounded broadcast) are added.
    """
    keys = [F.col(quoted(c)) for c in order]
    # Partition numbers must not change between the two uses, so the dealt rows are written once.
    parts = written(
        df.withColumn("_value", value).repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "prefix"
    )
    before = (
        parts.groupBy("_part").agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.join(F.broadcast(before), "_part")
        .withColumn(out, F.sum("_value").over(inside) + F.col("_before"))
        .drop("_part", "_value", "_before")
    )


def numbered(df: DataFrame, order: list[str], out: str, rows: int | None = None) -> DataFrame:
    """Adds 0-based positions in the order of ``order``; ``rows`` (counted if not given) picks the way."""
    rows = df.count() if rows is None else rows
    if rows <= ONE_TASK_ROWS:
        place = F.row_number().over(Window.orderBy(*[F.col(quoted(c)) for c in order]))
        return df.withColumn(out, (place - 1).cast("bigint"))
    return prefix_sum(df, order, F.lit(1).cast("bigint"), out).withColumn(out, F.col(out) - 1)


def order_statistics(df: DataFrame, shares: list[float], extra: list[Column]) -> tuple[Row, dict[str, list[float]]]:
    """The row of ``extra`` aggregates, and for each double column with values its exact ones at ranks floor(n * share).

    One pass gives ``extra`` and brackets each rank by approximate percentiles, a second counts what lies below
    and between the ends, for all columns together. Values strictly between two ends are written once if they are
    still many, and bracketed again; at most ONE_TASK_ROWS values of an interval are ranked at the end, so memory
    stays bounded whatever the number of rows and equal values.
    """
    ends = [p for q in shares for p in (max(0.0, q - SPREAD), min(1.0, q + SPREAD))]
    values = {c: F.col(quoted(c)) for c in df.columns}
    first = df.agg(
        *extra, F.struct(*[F.struct(F.count(v).alias("n"), F.percentile_approx(v, ends, ACCURACY).alias("ends")) for v in values.values()]).alias("_found")
    ).first()
    found = {c: x for c, x in zip(df.columns, first["_found"], strict=True) if x["n"]}
    # An open target: its place in the result, the rank in its interval, the interval's column, ends and rows.
    targets = [
        {"out": (c, i), "rank": min(x["n"] - 1, int(x["n"] * q)), "of": c, "low": None, "high": None, "rows": x["n"], "ends": x["ends"][2 * i : 2 * i + 2]}
        for c, x in found.items() for i, q in enumerate(shares)
    ]
    done: dict[tuple[str, int], float] = {}
    while many := [t for t in targets if t["rows"] > ONE_TASK_ROWS]:
        narrowed = _narrowed(df, values, many, done)
        targets = [t for t in targets if t["rows"] <= ONE_TASK_ROWS] + narrowed
        if not any(t["rows"] > ONE_TASK_ROWS for t in narrowed):
            break
        df, values = _apart(df, values, targets)
        wide = [t for t in targets if t["rows"] > ONE_TASK_ROWS]
        around = [[max(0.0, t["rank"] / t["rows"] - SPREAD), min(1.0, (t["rank"] + 1) / t["rows"] + SPREAD)] for t in wide]
        for t, x in zip(wide, df.agg(*[F.percentile_approx(values[t["of"]], p, ACCURACY) for t, p in zip(wide, around, strict=True)]).first(), strict=True):
            t["ends"] = x
    if targets:
        done |= _ranked(df, values, targets)
    return first, {c: [done[c, i] for i in range(len(shares))] for c in found}


def _inside(value: Column, t: dict) -> Column:
    """Whether a value lies strictly between the ends of a target's interval."""
    sides = [value > t["low"]] if t["low"] is not None else []
    sides += [value < t["high"]] if t["high"] is not None else []
    return reduce(lambda a, b: a & b, sides, value.isNotNull())


def _narrowed(df: DataFrame, values: dict[str, Column], targets: list[dict], done: dict) -> list[dict]:
    """The targets that none of their bracket's ends answers, in smaller intervals."""

    def counts(t: dict) -> list[Column]:
        v, (low, high) = values[t["of"]], t["ends"]
        here = _inside(v, t)
        return [F.count_if(here & (v < low)), F.count_if(v == low), F.count_if((v > low) & (v < high)), F.count_if(v == high)]

    row, out = df.agg(*[x.alias(f"_{i}_{j}") for i, t in enumerate(targets) for j, x in enumerate(counts(t))]).first(), []
    for i, t in enumerate(targets):
        below, least, between, most = row[4 * i : 4 * i + 4]
        (low, high), rank = t["ends"], t["rank"]
        most = 0 if low == high else most
        if rank < below:
            out.append(t | {"high": low, "rows": below})
        elif rank < below + least:
            done[t["out"]] = low
        elif rank < below + least + between:
            out.append(t | {"low": low, "high": high, "rank": rank - below - least, "rows": between})
        elif rank < below + least + between + most:
            done[t["out"]] = high
        else:
            upto = below + least + between + most
            out.append(t | {"low": high, "rank": rank - upto, "rows": t["rows"] - upto})
    return out


def _apart(df: DataFrame, values: dict[str, Column], targets: list[dict]) -> tuple[DataFrame, dict[str, Column]]:
    """The values of the targets' intervals, written; each target gets a column name of its own."""
    of_target = [F.when(_inside(values[t["of"]], t), F.struct(F.lit(k).alias("k"), values[t["of"]].alias("v"))) for k, t in enumerate(targets)]
    long = written(df.select(F.explode(F.array_compact(F.array(*of_target))).alias("x")).select("x.k", "x.v"), "ranks")
    for k, t in enumerate(targets):
        t["of"] = f"k{k}"
    return long, {f"k{k}": F.when(F.col("k") == k, F.col("v")) for k in range(len(targets))}


def _ranked(df: DataFrame, values: dict[str, Column], targets: list[dict]) -> dict[tuple[str, int], float]:
    """The targets' values, by counts of the values of each interval in order."""
    intervals = list(dict.fromkeys((t["of"], t["low"], t["high"]) for t in targets))
    held = [F.when(_inside(values[of], {"low": low, "high": high}), F.struct(F.lit(k).alias("k"), values[of].alias("v"))) for k, (of, low, high) in enumerate(intervals)]
    long = df.select(F.explode(F.array_compact(F.array(*held))).alias("x"))
    counts = long.groupBy("x.k", "x.v").agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    asked = df.sparkSession.createDataFrame([(intervals.index((t["of"], t["low"], t["high"])), i, t["rank"]) for i, t in enumerate(targets)], "k int, i int, rank bigint")
    hits = upto.join(F.broadcast(asked), "k").filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))).select("i", "v").collect()
    return {targets[i]["out"]: v for i, v in hits}
