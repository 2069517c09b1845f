"""Native text expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the contracts, space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, nothing else: the quick function serves where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The runs of other characters than white space; NULL and blank texts have none."""
    bare = stripped(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def lines(text: Column) -> Column:
    """The parts between line feeds; a NULL text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def carried(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns under numbered names, so that none of theirs clashes with those of a join; beside them the keys."""
    return docs.select(*[cell(docs, c, F.col("`" + c.replace("`", "``") + "`")) for c in docs.columns], *[v.alias(k) for k, v in keys.items()])


def cell(docs: DataFrame, name: str, value: Column | None = None) -> Column:
    """The numbered column that carries ``name``, or ``value`` under its name."""
    numbered = f"_carried{docs.columns.index(name)}"
    return F.col(numbered) if value is None else value.alias(numbered)


def unpacked(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of ``docs`` under their own names, some replaced."""
    return [(replaced[c] if c in replaced else cell(docs, c)).alias(c) for c in docs.columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
