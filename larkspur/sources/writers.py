"""Exports: CSV, JSON, NDJSON, a text report and the quick CSV. Directories by default, one file on request."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.expr import FLOATS, comparable, js_number, js_string, quoted, type_of
from larkspur.operators.frame import Frame

# The report's fixed layout: widest cell, cut texts, and the footer for rows left out.
MAX_WIDTH = 50
CUT = 47
FOOTER = "... y {n} filas más"


def with_extension(path: str, ext: str) -> str:
    """Appends the extension when there is none; another one raises."""
    found = PurePosixPath(path).suffix
    if not found:
        return f"{path}.{ext}"
    if found.lower() != f".{ext}":
        raise ValueError(f"Invalid extension: expected .{ext}, got {found}")
    return path


def _lines(df: DataFrame, line: Column, header: str | None, path: str, single: bool) -> None:
    """Text lines to a directory; each part begins with the header."""
    out = df.select(line.alias("value"))
    out = out.coalesce(1) if single else out
    if header is not None:

        def headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({"value": [header]})
            yield from batches

        out = out.mapInPandas(headed, "value string")
    out.write.text(path)


def _csv_cell(column: Column, kind, delimiter: str) -> Column:
    text = F.coalesce(js_number(column, kind), F.lit(""))
    needs = text.contains(delimiter) | text.contains('"') | text.contains("\n") | text.contains("\r")
    return F.when(needs, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _quote(text: str, delimiter: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(x in text for x in (delimiter, '"', "\n", "\r")) else text


def csv_line(df: DataFrame, delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[_csv_cell(F.col(quoted(c)), type_of(df, c), delimiter) for c in df.columns])


def to_csv(frame: Frame, path: str, delimiter: str = ",", header: bool = True, single: bool = False) -> int:
    """Quotes only where needed, NULL empty, whole doubles without a fraction; each part has the header. Returns the row count."""
    df = frame.data
    head = delimiter.join(_quote(c, delimiter) for c in df.columns) if header else None
    _lines(df, csv_line(df, delimiter), head, with_extension(path, "csv"), single)
    return df.count()


def json_line(df: DataFrame) -> Column:
    """One object; NaN and NULL written as null."""
    values = [comparable(F.col(quoted(c)), type_of(df, c)).alias(c) for c in df.columns]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def to_ndjson(frame: Frame, path: str, single: bool = False) -> int:
    df = frame.data
    _lines(df, json_line(df), None, with_extension(path, "ndjson"), single)
    return df.count()


def to_json(frame: Frame, path: str, pretty: bool = False, ndjson: bool = False) -> int:
    """One array in one file. Rows stream into a single writer; nothing is collected to the driver."""
    if ndjson:
        return to_ndjson(frame, path)
    df = frame.data
    spark = df.sparkSession
    row = json_line(df)
    if pretty:
        fields = [F.concat(F.lit(f"    {json.dumps(c, ensure_ascii=False)}: "), F.regexp_replace(F.to_json(F.struct(comparable(F.col(quoted(c)), type_of(df, c)).alias("v")), {"ignoreNullFields": "false"}), r'^\{"v":|\}$', "")) for c in df.columns]
        row = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *fields), F.lit("\n  }"))
    rows = df.select(row.alias("value"), F.monotonically_increasing_id().alias("_at"))
    first = rows.agg(F.min("_at").alias("_first"))
    body = rows.join(F.broadcast(first)).select(
        F.when(F.col("_at") == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(",\n" if pretty else ","), F.col("value"))).alias("value")
    )
    edge = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    gap = "\n" if pretty else ""
    out = edge("[" + gap).unionAll(body).unionAll(edge(gap + "]"))
    out.coalesce(1).write.text(with_extension(path, "json"))
    return df.count()


def report_lines(frame: Frame, delimiter: str = " | ", header: bool = True, max_rows: int = 1000) -> list[str]:
    """Padded table of the first ``max_rows`` rows (a bounded report, made on the driver)."""
    df = frame.data
    shown = frame._new(frame.df.orderBy(*frame._ordered()).limit(max_rows)).data
    rows = [list(r) for r in shown.select(*[F.coalesce(js_number(F.col(quoted(c)), type_of(df, c)), F.lit("")).alias(f"c{i}") for i, c in enumerate(df.columns)]).collect()]
    cut = lambda text: text if len(text) <= MAX_WIDTH else text[:CUT] + "..."
    cells = [[cut(x) for x in r] for r in rows]
    widths = [min(MAX_WIDTH, max([len(c), *(len(r[i]) for r in cells)])) for i, c in enumerate(df.columns)]
    line = lambda values: delimiter.join(v.ljust(w) for v, w in zip(values, widths, strict=True))
    out = []
    if header:
        out += [line([cut(c) for c in df.columns]), delimiter.join("-" * w for w in widths)]
    out += [line(r) for r in cells]
    total = frame.row_count
    return out + [FOOTER.format(n=total - len(rows))] * (total > len(rows))


def to_txt(frame: Frame, path: str, **options) -> dict:
    lines = report_lines(frame, **options)
    spark = frame.df.sparkSession
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(with_extension(path, "txt"))
    total = frame.row_count
    return {"rows": min(total, options.get("max_rows", 1000)), "totalRows": total}


def fixed4_line(df: DataFrame) -> Column:
    """Quick CSV line: non-integer numbers with four decimals, no quoting."""
    cells = []
    for name in df.columns:
        kind, column = type_of(df, name), F.col(quoted(name))
        text = js_string(column, kind)
        if isinstance(kind, FLOATS):
            text = F.when(column != F.floor(column), F.format_string("%.4f", column.cast("double"))).otherwise(text)
        cells.append(text)
    return F.concat_ws(",", *cells)


def write(frame: Frame, path: str, single: bool = False) -> None:
    df = frame.data
    _lines(df, fixed4_line(df), ",".join(df.columns), path, single)
