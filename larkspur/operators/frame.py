"""Frame: a DataFrame with a row order and metadata, and the relational operators over it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.expr import (
    FLOATS,
    NUMBERS,
    comparable,
    is_missing,
    js_string,
    parse_float,
    quoted,
    to_double,
    type_of,
)
from larkspur.operators.column import ColumnHandle
from larkspur.plans.ranks import order_statistics, prefix_sum

ROW_ID = "_row_id"
GROUP_OPS = ("sum", "mean", "count", "max", "min")
INF = float("inf")


class Frame:
    """Operators named "in place" rebind ``df`` and return self; the others return a new frame.

    ``order_by`` names columns that order the rows uniquely. Without it a row id is added at the scan.
    """

    def __init__(self, df: DataFrame, order_by: Sequence[str] | None = None, metadata: dict | None = None):
        if order_by is None:
            if ROW_ID not in df.columns:
                df = df.withColumn(ROW_ID, F.monotonically_increasing_id())
            order_by = [ROW_ID]
        self.df, self.order, self.metadata = df, list(order_by), dict(metadata or {})

    # -- helpers -------------------------------------------------------------------------------

    def _new(self, df: DataFrame, order: Sequence[str] | None = None) -> Frame:
        return Frame(df, self.order if order is None else order, self.metadata)

    def _type(self, name: str) -> T.DataType:
        return type_of(self.df, name)

    def _check(self, name: str) -> str:
        if name not in self.df.columns:
            raise KeyError(f"Column {name} not found")
        return name

    def _col(self, name: str) -> Column:
        return F.col(quoted(self._check(name)))

    def _value(self, name: str) -> Column:
        return comparable(self._col(name), self._type(name))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    @property
    def data(self) -> DataFrame:
        """The rows without the row id."""
        return self.df.select(*[quoted(c) for c in self.columns])

    @property
    def row_count(self) -> int:
        return self.df.count()

    def _ordered(self, ascending: bool = True) -> list[Column]:
        return [self._col(c).asc() if ascending else self._col(c).desc() for c in self.order]

    # -- projection ----------------------------------------------------------------------------

    def select(self, names: Sequence[str]) -> Frame:
        """Unknown names raise. Order columns that are not selected are dropped with their order."""
        for name in names:
            self._check(name)
        keep_id = [ROW_ID] if ROW_ID in self.df.columns and ROW_ID not in names else []
        out = self.df.select(*[quoted(c) for c in [*names, *keep_id]])
        return self._new(out, self.order if set(self.order) <= set(out.columns) else None)

    def rename(self, mapping: dict[str, str]) -> Frame:
        out = self.df.select(*[self._col(c).alias(mapping.get(c, c)) for c in self.df.columns])
        return self._new(out, [mapping.get(c, c) for c in self.order])

    def with_columns(self, specs: Iterable[dict]) -> Frame:
        """In place. Specs ``{name, inputs, formula}`` in sequence; results are doubles.

        A formula is a Column, SQL text, or a Python callable over the inputs, which runs as a
        pandas UDF (the slow way: prefer expressions).
        """
        for spec in specs:
            name, formula = spec["name"], spec["formula"]
            if callable(formula) and not isinstance(formula, Column):
                expr = _row_udf(formula, "double")(*[self._col(c) for c in spec["inputs"]])
            else:
                expr = F.expr(formula) if isinstance(formula, str) else formula
            kind = self.df.select(expr.alias("x")).schema["x"].dataType
            self.df = self.df.withColumn(name, to_double(expr, kind))
        return self

    def with_label(self, specs: Iterable[dict]) -> Frame:
        """Specs ``{input, indexer}`` add ``<input>_indexed``; the indexers are kept in the metadata."""
        out = self._new(self.df)
        for spec in specs:
            out.df = spec["indexer"].transform(out.df, spec["input"], f"{spec['input']}_indexed")
            out.metadata.setdefault("indexers", {})[spec["input"]] = spec["indexer"]
        return out

    def assign(self, columns: dict[str, Column | Sequence] | Frame) -> Frame:
        """In place. Expressions are projected; value lists and frames are zipped on by position."""
        if isinstance(columns, Frame):
            return self._zip(columns)
        lists = {k: v for k, v in columns.items() if not isinstance(v, Column)}
        for name, expr in columns.items():
            if isinstance(expr, Column):
                self.df = self.df.withColumn(name, expr)
        if lists:
            rows = list(zip(*lists.values(), strict=False))
            if len({len(v) for v in lists.values()}) > 1:
                raise ValueError("integrity error: columns of different lengths")
            extra = self.df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["_at", *lists])
            return self._zip(Frame(extra, ["_at"]), drop=["_at"])
        return self

    def _zip(self, other: Frame, drop: Sequence[str] = ()) -> Frame:
        mine, theirs = self.row_count, other.row_count
        if mine != theirs:
            raise ValueError(f"integrity error: {theirs} values for {mine} rows")
        one = F.lit(1).cast("bigint")
        left = prefix_sum(self.df, self.order, one, "_at_left")
        right = prefix_sum(other.df, other.order, one, "_at_right").drop(*drop)
        added = [c for c in right.columns if c not in ("_at_right", ROW_ID)]
        joined = left.drop(*added).join(right.drop(ROW_ID), F.col("_at_left") == F.col("_at_right"))
        order = self.order if set(self.order) <= set(joined.columns) else ["_at_left"]
        self.df = joined.drop("_at_right") if order == ["_at_left"] else joined.drop("_at_left", "_at_right")
        self.order = order
        return self

    def cast(self, name: str, to: str) -> Frame:
        """In place. 'float' and 'int' both take the numeric prefix, junk counting 0; 'string' spells the value."""
        kind = self._type(self._check(name))
        if to == "string":
            expr = js_string(self._col(name), kind)
        elif to in ("float", "int"):
            expr = F.coalesce(parse_float(self._col(name), kind), F.lit(0.0))
        else:
            raise ValueError(f"unknown cast {to!r}")
        self.df = self.df.withColumn(name, expr)
        return self

    def col(self, name: str) -> ColumnHandle:
        return ColumnHandle(self, self._check(name))

    def get_col(self, name: str) -> DataFrame | None:
        return self.df.select(quoted(name)) if name in self.df.columns else None

    # -- filters -------------------------------------------------------------------------------

    def filter(self, predicate: Column | str | Callable, inputs: Sequence[str] = ()) -> Frame:
        """Comparisons with missing inputs are false: inputs' NaN is read as NULL.

        Naming ``inputs`` lets the frame guard them; a Python callable runs as a boolean pandas UDF.
        """
        if callable(predicate) and not isinstance(predicate, Column):
            return self._new(self.df.filter(_row_udf(predicate, "boolean")(*[self._col(c) for c in inputs])))
        expr = F.expr(predicate) if isinstance(predicate, str) else predicate
        for name in inputs:
            if isinstance(self._type(self._check(name)), FLOATS):
                expr = expr & ~F.isnan(self._col(name))
        return self._new(self.df.filter(expr))

    def str_contains(self, name: str, pattern: str) -> Frame:
        """Case-insensitive regular expression; missing and empty texts never match."""
        text = self._col(name)
        return self._new(self.df.filter((text != "") & text.rlike(f"(?iu){pattern}")))

    def drop_na(self, how: str = "any") -> Frame:
        if how not in ("any", "all"):
            raise ValueError(f"how must be any or all, not {how!r}")
        tests = [is_missing(self._col(c), self._type(c)) for c in self.columns]
        drop = tests[0]
        for test in tests[1:]:
            drop = (drop | test) if how == "any" else (drop & test)
        return self._new(self.df.filter(~drop))

    def fill_na(self, value) -> Frame:
        """In place: NULL and NaN of every column that can hold the value."""
        text = isinstance(value, str)
        exprs = []
        for name in self.df.columns:
            kind, column = self._type(name), self._col(name)
            fits = name != ROW_ID and (
                isinstance(kind, T.StringType) if text
                else isinstance(kind, T.BooleanType) if isinstance(value, bool)
                else isinstance(kind, NUMBERS)
            )
            exprs.append((F.coalesce(comparable(column, kind), F.lit(value).cast(kind)) if fits else column).alias(name))
        self.df = self.df.select(*exprs)
        return self

    def head(self, n: int = 5) -> Frame:
        return self._new(self.df.orderBy(*self._ordered()).limit(n))

    def tail(self, n: int = 5) -> Frame:
        return self._new(self.df.orderBy(*self._ordered(False)).limit(n).orderBy(*self._ordered()))

    # -- reducers ------------------------------------------------------------------------------

    def _total(self, name: str, skipna: bool) -> Column:
        """Sum that a missing value turns to NaN unless skipped."""
        kind, column = self._type(name), self._col(name)
        total = F.coalesce(F.sum(comparable(column, kind).cast("double")), F.lit(0.0))
        if skipna:
            return total
        return F.when(F.bool_or(is_missing(column, kind)), F.lit(float("nan"))).otherwise(total)

    def stats_frame(self, name: str, skipna: bool = False) -> DataFrame:
        """count, sum, mean (over all rows), min, max in one aggregate."""
        value, total = self._value(name).cast("double"), self._total(name, skipna)
        rows = F.count(F.lit(1))
        return self.df.agg(
            rows.alias("count"),
            total.alias("sum"),
            F.when(rows == 0, F.lit(0.0)).otherwise(total / F.greatest(rows, F.lit(1))).alias("mean"),
            F.when(rows > 0, F.coalesce(F.min(value), F.lit(INF))).alias("min"),
            F.when(rows > 0, F.coalesce(F.max(value), F.lit(-INF))).alias("max"),
        )

    def stats(self, name: str, skipna: bool = False) -> dict | None:
        if name not in self.df.columns:
            return None
        return self.stats_frame(name, skipna).first().asDict()

    def sum(self, name: str, skipna: bool = False) -> float:
        return self.df.agg(self._total(name, skipna).alias("x")).first().x if name in self.df.columns else 0

    def mean(self, name: str, skipna: bool = False) -> float:
        found = self.stats(name, skipna)
        return found["mean"] if found else 0

    def max(self, name: str) -> float | None:
        if name not in self.df.columns:
            return None
        return self.df.agg(F.coalesce(F.max(self._value(name)).cast("double"), F.lit(-INF)).alias("x")).first().x

    def min(self, name: str) -> float | None:
        if name not in self.df.columns:
            return None
        return self.df.agg(F.coalesce(F.min(self._value(name)).cast("double"), F.lit(INF)).alias("x")).first().x

    # -- grouping ------------------------------------------------------------------------------

    def group_by(self, key: str, aggs: dict[str, str | Sequence[str]], ordered: bool = False) -> Frame:
        """Values by numeric prefix, unparsable ones dropped; NULL and NaN keys form groups.

        One op names its column after the input, several ``<col>_<op>``. ``ordered`` sorts groups by
        first appearance.
        """
        self._check(key)
        exprs, names = [], [key]
        for name, ops in aggs.items():
            value = parse_float(self._col(name), self._type(name))
            found = {
                "sum": F.coalesce(F.sum(value), F.lit(0.0)),
                "mean": F.coalesce(F.avg(value), F.lit(float("nan"))),
                "count": F.count(value),
                "max": F.coalesce(F.max(value), F.lit(-INF)),
                "min": F.coalesce(F.min(value), F.lit(INF)),
            }
            wanted = [ops] if isinstance(ops, str) else list(ops)
            for op in wanted:
                if op in found:
                    out = name if len(wanted) == 1 else f"{name}_{op}"
                    exprs.append(found[op].alias(f"_agg_{len(exprs)}"))
                    names.append(out)
        first = [F.min(F.struct(*self._ordered_names())).alias("_first")] if ordered else []
        out = self.df.groupBy(self._col(key).alias("_key")).agg(*(exprs or [F.count(F.lit(1)).alias("_n")]), *first)
        shown = [F.col("_key").alias(key), *[F.col(f"_agg_{i}").alias(names[i + 1]) for i in range(len(exprs))]]
        if key in names[1:]:  # aggregating the key under one op overwrites it
            shown = shown[1:]
        if ordered:
            out = out.orderBy("_first")
        return Frame(out.select(*shown), [key])

    def _ordered_names(self) -> list[Column]:
        return [self._col(c) for c in self.order]

    def group_by_category(self, key: str, value: str) -> DataFrame:
        """key, sum, count over rows with a key and a number."""
        if key not in self.df.columns or value not in self.df.columns:
            raise KeyError("Column not found")
        # Numbers only: text that begins with one does not count.
        kind = self._type(value)
        number = comparable(self._col(value), kind).cast("double") if isinstance(kind, NUMBERS) else F.lit(None).cast("double")
        kept = self.df.filter(self._col(key).isNotNull() & (self._col(key).cast("string") != "") & number.isNotNull())
        return kept.groupBy(self._col(key)).agg(F.sum(number).alias("sum"), F.count(number).alias("count"))

    def group_by_range(self, key: str, value: str, max_range: int) -> DataFrame:
        """group, avg: averages by floor(key) in [0, max_range), only those above 0, best first."""
        if key not in self.df.columns or value not in self.df.columns:
            return self.df.sparkSession.createDataFrame([], "group int, avg double")
        k, v = self._value(key), self._value(value).cast("double")
        bucket = F.floor(k)
        return (
            self.df.filter(k.isNotNull() & v.isNotNull() & (bucket >= 0) & (bucket < max_range))
            .groupBy(bucket.cast("int").alias("group")).agg(F.avg(v).alias("avg"))
            .filter(F.col("avg") > 0).orderBy(F.desc("avg"), "group")
        )

    def group_by_id(self, key: str, value: str) -> DataFrame:
        return self.group_by_range(key, value, 300)

    def unique(self, name: str) -> DataFrame:
        """Distinct values in order of first appearance."""
        first = F.min(F.struct(*self._ordered_names())).alias("_first")
        return self.df.groupBy(self._col(name)).agg(first).orderBy("_first").drop("_first")

    def nunique(self, name: str) -> int:
        """NULL counts as a value."""
        return self.df.select(self._col(name)).distinct().count()

    def value_counts(self, name: str) -> DataFrame:
        """value (text), count; most frequent first, integer-like values ascending, then first appearance."""
        first = F.min(F.struct(*self._ordered_names())).alias("_first")
        shown = js_string(self._col(name), self._type(name)).alias("value")
        index = F.when(F.col("value").rlike(r"^(0|[1-9]\d{0,9})$"), F.col("value").try_cast("bigint"))
        out = self.df.groupBy(shown).agg(F.count(F.lit(1)).alias("count"), first)
        return out.orderBy(F.desc("count"), index.asc_nulls_last(), "_first").drop("_first")

    # -- joins, sort, running sums -------------------------------------------------------------

    def join(self, other: Frame, on: str, how: str = "inner") -> Frame:
        """Missing keys match each other; same-named columns are taken from the right, in the left's place."""
        if how not in ("inner", "left"):
            raise ValueError(f"how must be inner or left, not {how!r}")
        self._check(on)
        left, right = self.df, other.data.withColumnRenamed(on, "_right_key")
        theirs = [c for c in right.columns if c != "_right_key"]
        right = right.select(*[F.col(quoted(c)).alias(c if c == "_right_key" else f"_right.{c}") for c in right.columns])
        joined = left.join(right, F.col(quoted(on)).eqNullSafe(F.col("_right_key")), how)
        shown = [F.col(quoted(f"_right.{c}")).alias(c) if c in theirs else F.col(quoted(c)) for c in left.columns]
        added = [F.col(quoted(f"_right.{c}")).alias(c) for c in theirs if c not in left.columns]
        order = [c for c in self.order if c not in theirs] or None
        return self._new(joined.select(*shown, *added), order)

    def sort(self, name: str, ascending: bool = True) -> Frame:
        """Stable by the frame's order, missing values last."""
        key = self._value(name)
        ordered = key.asc_nulls_last() if ascending else key.desc_nulls_last()
        return self._new(self.df.orderBy(ordered, *self._ordered()))

    def cumsum(self, name: str) -> Frame:
        """In place: adds ``<name>_cumsum`` in row order, junk counting 0."""
        value = F.coalesce(parse_float(self._col(name), self._type(name)), F.lit(0.0))
        self.df = prefix_sum(self.df, self.order, value, f"{name}_cumsum")
        return self

    # -- reporting -----------------------------------------------------------------------------

    def info(self) -> dict:
        rows, columns = self.row_count, self.columns
        return {"rowCount": rows, "columnCount": len(columns), "columns": columns, "memory": f"{rows * len(columns) * 8 / 2**20:.2f} MB"}

    def describe(self) -> DataFrame:
        """column, count, mean (2-decimal text), min, 25%, 50%, 75%, max over numeric prefixes.

        A quantile is the value at 0-based rank floor(n * q) of the sorted values, exactly.
        """
        spark = self.df.sparkSession
        parsed = self.df.select(*[parse_float(self._col(c), self._type(c)).alias(f"c{i}") for i, c in enumerate(self.columns)])
        sums = [f(f"c{i}").alias(f"{k}{i}") for i in range(len(self.columns)) for k, f in (("n", F.count), ("a", F.avg), ("lo", F.min), ("hi", F.max))]
        found, quartiles = order_statistics(parsed, [0.25, 0.5, 0.75], sums)
        rows = [
            (name, found[f"n{i}"], f"{found[f'a{i}']:.2f}", found[f"lo{i}"], *quartiles[f"c{i}"], found[f"hi{i}"])
            for i, name in enumerate(self.columns) if f"c{i}" in quartiles
        ]
        kinds = "column string, count bigint, mean string, min double, `25%` double, `50%` double, `75%` double, max double"
        return spark.createDataFrame(rows, kinds)

    def show(self, n: int = 5) -> None:
        self._new(self.df.orderBy(*self._ordered())).data.show(n, truncate=20)

    def to_array(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self._new(self.df.orderBy(*self._ordered())).data.toLocalIterator()]


def _row_udf(formula: Callable, kind: str):
    """A row function as a pandas UDF; a scalar result of a vectorised formula is spread over the batch."""

    @F.pandas_udf(kind)
    def run(*inputs: pd.Series) -> pd.Series:
        rows = [formula(*values) for values in zip(*inputs, strict=True)]
        if kind == "boolean":
            return pd.Series([bool(r) for r in rows], dtype="bool")
        return pd.to_numeric(pd.Series([0.0 if r is None else r for r in rows], dtype="object"), errors="coerce").astype("float64")

    return run
