"""Readers: delimited files, JSON, NDJSON and Parquet into frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.expr import numeric_field, quoted
from larkspur.operators.frame import Frame
from larkspur.sources.infer import (
    banded_sample,
    first_record_kinds,
    flat_columns,
    flatten,
    json_records,
    name_order,
    sample_json_records,
    struct_type,
    vote,
)

DEFAULTS = {"double": 0.0, "boolean": False, "string": ""}


def read(spark: SparkSession, path: str, kind: str | None = None, mode: str | None = None, on_batch: Callable | None = None, **options) -> Frame:
    """Dispatch by mode, then extension or ``kind``; anything unknown is read as CSV."""
    if mode == "stream":
        if on_batch is None:
            raise ValueError("mode 'stream' needs on_batch")
        from larkspur.streaming.batches import stream_batches

        return stream_batches(spark, path, on_batch, kind=kind, **options)
    ext = PurePosixPath(path).suffix.lower().lstrip(".")
    for known in ("ndjson", "parquet", "json", "tsv"):
        if known in (ext, kind) and not (known == "tsv" and ext == "json"):
            return {"ndjson": read_ndjson, "parquet": read_parquet, "json": read_json, "tsv": read_tsv}[known](spark, path, **options)
    return read_csv(spark, path, **options)


def _delimited(spark: SparkSession, path: str, delimiter: str):
    return spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", schema: T.StructType | str | None = None, numeric_only: bool = False, multiline: bool = False) -> Frame:
    """A header row is required. Without ``schema`` every column is text.

    ``numeric_only`` parses every cell as a plain number (NULL for anything else). Files are split over
    tasks; ``multiline`` allows line breaks in quoted cells but keeps a file in one task.
    """
    source = _delimited(spark, path, delimiter).option("multiLine", multiline)
    if schema is not None:
        df = source.schema(schema).csv(path)
    else:
        df = source.csv(path)
        if numeric_only:
            df = df.select(*[numeric_field(F.col(quoted(c))).alias(c) for c in df.columns])
    return Frame(df, metadata={"source": path})


def read_tsv(spark: SparkSession, path: str, **options) -> Frame:
    return read_csv(spark, path, **(options | {"delimiter": "\t"}))


def read_parquet(spark: SparkSession, path: str, order_by: Sequence[str] | None = None) -> Frame:
    return Frame(spark.read.parquet(path), order_by, {"source": path})


def _json_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def json_schema(spark: SparkSession, path: str) -> T.StructType:
    return struct_type(first_record_kinds(sample_json_records(json_records(_json_texts(spark, path)))))


def json_rows(texts: DataFrame, schema: T.StructType) -> DataFrame:
    """Flattened rows of the objects in whole files' texts; a balanced object that is no JSON raises."""
    parsed = json_records(texts).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_record"))
    return flatten(parsed.select("_record.*"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> Frame:
    """Array members, a root object or concatenated objects as rows, nested objects as dotted columns, arrays as
    JSON text. Arrays of other values have no rows, an object that does not end is left out."""
    schema = schema or json_schema(spark, path)
    if not schema.fields:
        return Frame(spark.createDataFrame([], T.StructType()), metadata={"source": path})
    return Frame(json_rows(_json_texts(spark, path), schema), metadata={"source": path})


class NdjsonScan:
    """A lazy scan with an inferred schema; a selection prunes what the parser reads."""

    def __init__(self, spark: SparkSession, path: str, sample_rows: int = 300, schema: T.StructType | None = None, defaults: bool = False):
        self.spark, self.path, self.defaults = spark, path, defaults
        self._lines = spark.read.text(path).filter(F.col("value") != "")
        self._nested = schema or struct_type(vote(banded_sample(self._lines, sample_rows)))
        self._leaves = sorted(flat_columns(self._nested), key=lambda x: name_order(x[0]))

    @property
    def schema(self) -> list[tuple[str, str]]:
        names = {"double": "number", "boolean": "boolean", "string": "string"}
        return [(n, names[t.simpleString()]) for n, _, t in self._leaves]

    @property
    def row_count(self) -> int:
        return self._lines.count()

    def _frame(self, leaves) -> Frame:
        if not leaves:
            return Frame(self._lines.select(), metadata={"source": self.path})
        df = self.spark.read.schema(self._nested).option("mode", "PERMISSIVE").json(self.path)
        shown = []
        for name, expr, kind in leaves:
            value = F.coalesce(expr, F.lit(DEFAULTS[kind.simpleString()])) if self.defaults else expr
            shown.append(value.alias(name))
        return Frame(df.select(*shown), metadata={"source": self.path})

    def select(self, names: Sequence[str]) -> Frame:
        """Unknown names are ignored; columns come in schema order."""
        return self._frame([x for x in self._leaves if x[0] in set(names)])

    def collect(self) -> Frame:
        return self._frame(self._leaves)


def scan_ndjson(spark: SparkSession, path: str, **options) -> NdjsonScan:
    return NdjsonScan(spark, path, **options)


def read_ndjson(spark: SparkSession, path: str, **options) -> Frame:
    return NdjsonScan(spark, path, **options).collect()


def json_to_ndjson(spark: SparkSession, source: str, target: str) -> None:
    """Each top-level object on a line of its own, as it is written; line breaks between its parts become blanks."""
    json_records(_json_texts(spark, source)).select(F.regexp_replace("value", r"\r?\n|\r", " ").alias("value")).write.text(target)


def from_objects(spark: SparkSession, rows: Sequence[dict], schema: T.StructType | str | None = None) -> Frame:
    """Rows as dicts. Without a schema, a column is numeric if all its non-null values are numbers."""
    if schema is None:
        names = list(dict.fromkeys(k for r in rows for k in r))
        fields = []
        for name in names:
            found = [r[name] for r in rows if r.get(name) is not None]
            if found and all(isinstance(v, bool) for v in found):
                kind = T.BooleanType()
            elif found and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in found):
                kind = T.DoubleType()
            else:
                kind = T.StringType()
            fields.append(T.StructField(name, kind))
        schema = T.StructType(fields)
        convert = {"double": float, "boolean": bool, "string": str}
        rows = [{f.name: None if r.get(f.name) is None else convert[f.dataType.simpleString()](r[f.name]) for f in fields} for r in rows]
        values = [(i, *[r[f.name] for f in fields]) for i, r in enumerate(rows)]
    else:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        values = [(i, *[r.get(f.name) for f in schema]) for i, r in enumerate(rows)]
    numbered = T.StructType([T.StructField("_row_id", T.LongType()), *schema.fields])
    return Frame(spark.createDataFrame(values, numbered), ["_row_id"])


def from_array(spark: SparkSession, rows: Sequence[dict]) -> Frame:
    """Everything as double; what is no number becomes NULL."""
    frame = from_objects(spark, rows, T.StructType([T.StructField(n, T.StringType()) for n in dict.fromkeys(k for r in rows for k in r)]))
    frame.df = frame.df.select("_row_id", *[F.col(quoted(c)).try_cast("double").alias(c) for c in frame.columns])
    return frame


# Array-interface codes to numpy types; unsigned ones widen to the next signed Spark type.
SHARED_TYPES = {"f8": "f8", "f4": "f4", "i1": "i1", "i2": "i2", "i4": "i4", "u1": "i2", "u2": "i4", "u4": "i8", "b1": "i2"}


def from_shared(spark: SparkSession, buffer: bytes, columns: Sequence[dict]) -> Frame:
    """Typed views ``{name, dtype, offset, length}`` on a raw buffer."""
    made = {}
    for column in columns:
        code = re.sub(r"[<>=|]", "", column["dtype"])
        if code not in SHARED_TYPES:
            raise ValueError(f"Unsupported dtype: {column['dtype']}")
        raw = np.frombuffer(buffer, dtype="u1" if code == "b1" else code, offset=column["offset"], count=column["length"])
        made[column["name"]] = raw.astype(SHARED_TYPES[code])
    pdf = pd.DataFrame(made)
    pdf.insert(0, "_row_id", range(len(pdf)))
    return Frame(spark.createDataFrame(pdf), ["_row_id"])


def ingest(spark: SparkSession, path: str, transforms: Sequence[dict] = (), **options) -> Frame:
    """Delimited scan with derived columns ``{name, formula}`` (SQL text) fused into the same stage."""
    frame = read_csv(spark, path, **options)
    frame.df = frame.df.selectExpr("*", *[f"{t['formula']} AS {quoted(t['name'])}" for t in transforms])
    return frame
