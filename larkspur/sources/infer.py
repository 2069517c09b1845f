"""Schema inference by banded sample and vote for NDJSON, and by first records for JSON."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.expr import quoted

KINDS = {"number": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
# On equal votes the first of these wins.
TIE_ORDER = ("number", "boolean", "string")


def _leaves(value: dict, path: tuple[str, ...] = ()):
    """(path, value) of every leaf; arrays are leaves, empty objects vanish."""
    for key, item in value.items():
        if isinstance(item, dict):
            yield from _leaves(item, (*path, key))
        else:
            yield (*path, key), item


def kind_of(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string"


def banded_sample(lines: DataFrame, rows: int) -> list[str]:
    """Head, middle and tail third of ``rows`` lines. Only the sample reaches the driver."""
    total = lines.count()
    if total <= rows:
        return [r.value for r in lines.collect()]
    band = max(1, rows // 3)
    middle = max(0, total // 2 - band // 2)
    starts = [(0, band), (middle, middle + band), (total - band, total)]
    # An id holds the partition above bit 33 and the place in it below: counts per partition turn bands into ranges of ids.
    placed = lines.withColumn("_id", F.monotonically_increasing_id())
    counts = sorted(placed.groupBy(F.shiftright("_id", 33).alias("part")).count().collect())
    inside, before = F.lit(False), 0
    for part, n in counts:
        for a, b in starts:
            low, high = max(a, before), min(b, before + n)
            if low < high:
                inside = inside | F.col("_id").between((part << 33) + low - before, (part << 33) + high - before - 1)
        before += n
    return [r.value for r in placed.filter(inside).orderBy("_id").collect()]


def vote(lines: list[str]) -> dict[tuple[str, ...], str]:
    """Kind per leaf path by majority; malformed and primitive lines have no vote."""
    votes: dict[tuple[str, ...], Counter] = defaultdict(Counter)
    for line in lines:
        try:
            record = json.loads(line)
        except ValueError:
            continue
        if isinstance(record, dict):
            for path, value in _leaves(record):
                votes[path][kind_of(value)] += 1
    return {p: min(TIE_ORDER, key=lambda k: (-v[k], TIE_ORDER.index(k))) for p, v in votes.items()}


def first_record_kinds(records: list[dict]) -> dict[tuple[str, ...], str]:
    """A leaf is numeric if every value found is a number or null, otherwise text."""
    kinds: dict[tuple[str, ...], str] = {}
    for record in records:
        for path, value in _leaves(record):
            number = value is None or kind_of(value) == "number"
            kinds[path] = "number" if number and kinds.get(path, "number") == "number" else "string"
    return kinds


def struct_type(kinds: dict[tuple[str, ...], str]) -> T.StructType:
    """Nested schema of leaf paths. A path that is both leaf and object keeps its object."""
    tree: dict = {}
    for path, kind in sorted(kinds.items(), key=lambda x: len(x[0])):
        node = tree
        for key in path[:-1]:
            if not isinstance(node.get(key), dict):
                node[key] = {}
            node = node[key]
        node[path[-1]] = kind
    build = lambda node: T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else KINDS[v]) for k, v in node.items()])
    return build(tree)


def flat_columns(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, Column, T.DataType]]:
    """(dotted name, expression, type) of every leaf."""
    out = []
    for field in schema:
        here = (*path, field.name)
        if isinstance(field.dataType, T.StructType):
            out += flat_columns(field.dataType, here)
        else:
            out.append((".".join(here), F.col(".".join(quoted(p) for p in here)), field.dataType))
    return out


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*[expr.alias(name) for name, expr, _ in flat_columns(df.schema)])


def name_order(name: str) -> tuple:
    """Case-insensitive first, lower case before upper on ties."""
    return (re.sub(r"[\W_]", "", name.casefold()), name.swapcase())


# Whole strings (open ones up to the end of the text) and brackets.
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\]]', re.DOTALL)


def json_objects(text: str) -> Iterator[str]:
    """The balanced top-level objects of a text as they are written: array members, a root object, or concatenated
    ones. What stands between them is passed over, and an object that does not end is left out."""
    at = text.find("{")
    while at >= 0:
        depth, end = 0, -1
        for mark in _MARKS.finditer(text, at):
            depth += (mark[0] in "{[") - (mark[0] in "}]")
            if not depth and mark[0] in "}]":
                end = mark.end()
                break
        if end < 0:
            return
        yield text[at:end]
        at = text.find("{", end)


def json_records(texts: DataFrame) -> DataFrame:
    """value: the objects of whole files' texts. A file is read by one task, its records leave it in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                found = json_objects(text)
                while some := list(islice(found, 5_000)):
                    yield pd.DataFrame({"value": some})

    return texts.mapInPandas(run, "value string")


def sample_json_records(records: DataFrame, rows: int = 500) -> list[dict]:
    """The first records, parsed; malformed ones raise."""
    return [json.loads(r.value) for r in records.limit(rows).collect()]
