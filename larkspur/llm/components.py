"""Connected components of an edge table, in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import discard, written

# Parts into which the rows of one group are dealt.
SALTS = 1024


def salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of), F.lit(SALTS)).cast("int")


def group_least(rows: DataFrame, group: str, unit: str, value: str) -> DataFrame:
    """A row per group: the least ``value`` as least, and the salts of ``unit`` that its rows have as salts."""
    parts = rows.groupBy(group, salt(unit).alias("_salt")).agg(F.min(value).alias("least"))
    return parts.groupBy(group).agg(F.min("least").alias("least"), F.collect_list("_salt").alias("salts"))


def join_back(rows: DataFrame, groups: DataFrame, group: str, unit: str) -> DataFrame:
    """``rows`` with the columns of their group, joined by group and salt: a group may hold any share of the rows."""
    return rows.withColumn("_salt", salt(unit)).join(groups.withColumn("_salt", F.explode("salts")).drop("salts"), [group, "_salt"]).drop("_salt")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, label: the smallest node reachable, for every node of the edges (a, b).

    Alternating stars: a large step ties the greater neighbours of every node to its least neighbour, a small
    step the lesser ones and itself, until every component is one star. Least neighbours are found by partial
    aggregates and go back to a node's edges by salt, so a hub may have any share of the edges. Rounds are
    written to the shared folder, and only counts reach the driver.
    """
    pairs = lambda a, b: F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    given = written(edges.select(pairs("a", "b").alias("x")).select("x.*").distinct(), "edges")
    loops, stars = given.filter("a = b"), written(given.filter("a <> b"), "stars")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 20)))).first()
    seen = mark(stars)
    for _ in range(rounds):
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = group_least(both, "a", "b", "b")
        large = join_back(both, least, "a", "b").filter("b > a").select(F.col("b").alias("x"), F.least("a", "least").alias("y"))
        large = written(large.filter("x <> y").select(pairs("x", "y").alias("e")).select("e.*").distinct(), "large")
        least = group_least(large, "a", "b", "b")
        small = join_back(large, least, "a", "b").select(F.explode(F.array(pairs("a", "least"), pairs("b", "least"))).alias("e")).select("e.*")
        before, stars = stars, written(small.filter("a <> b").distinct(), "small")
        discard(before)
        discard(large)
        now = mark(stars)
        if now == seen:
            centres = stars.select("b").unionAll(loops.select("b")).distinct().select(F.col("b").alias("node"), F.col("b").alias("label"))
            rest = stars.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return rest.unionAll(centres.join(rest.select("node"), "node", "left_anti"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
