"""Column expressions behind the frame operators. All stay inside Catalyst: no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
NUMBERS = (*FLOATS, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)

# Longest numeric prefix of a text, as a float parser that ignores what follows reads it.
FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
# A delimited-file number: no exponent, no plus sign, at most one dot.
PLAIN_NUMBER = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"


def quoted(name: str) -> str:
    """A column name safe for dots and backquotes."""
    return "`" + name.replace("`", "``") + "`"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(column: Column, kind: T.DataType) -> Column:
    """NULL, and NaN where the type has one."""
    return column.isNull() | F.isnan(column) if isinstance(kind, FLOATS) else column.isNull()


def comparable(column: Column, kind: T.DataType) -> Column:
    """The value with NaN turned to NULL, so that comparisons and extremes skip it."""
    return F.nanvl(column, F.lit(None).cast(kind)) if isinstance(kind, FLOATS) else column


def parse_float(column: Column, kind: T.DataType) -> Column:
    """Longest numeric prefix as double; NULL for junk, booleans and missing values."""
    if isinstance(kind, NUMBERS):
        return comparable(column.cast("double"), T.DoubleType())
    if isinstance(kind, T.BooleanType):
        return F.lit(None).cast("double")
    text = column.cast("string")
    infinite = F.regexp_extract(text, r"^\s*([+-]?)Infinity", 0)
    return (
        F.when(infinite != "", F.when(infinite.contains("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .otherwise(F.regexp_extract(text, FLOAT_PREFIX, 1).try_cast("double"))
    )


def numeric_field(column: Column) -> Column:
    """A delimited-file cell as number: blanks trimmed, plain digits only, NULL otherwise."""
    text = F.regexp_replace(F.trim(column), "\r$", "")
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def js_string(column: Column, kind: T.DataType) -> Column:
    """Text of a value, whole doubles without a fraction, missing spelled out."""
    if isinstance(kind, FLOATS):
        wide = column.cast("double")
        whole = (wide == F.floor(wide)) & (F.abs(wide) < 1e15)
        shown = (
            F.when(F.isnan(wide), F.lit("NaN"))
            .when(wide == float("inf"), F.lit("Infinity"))
            .when(wide == float("-inf"), F.lit("-Infinity"))
            .when(whole, wide.cast("bigint").cast("string"))
            .otherwise(column.cast("string"))
        )
    else:
        shown = column.cast("string")
    return F.coalesce(shown, F.lit("null"))


def js_number(column: Column, kind: T.DataType) -> Column:
    """Text for an export cell: NULL stays NULL (an empty cell)."""
    return F.when(column.isNotNull(), js_string(column, kind))


def safe_divisor(column: Column) -> Column:
    """A divisor of zero counts as one."""
    return F.when(column == 0, F.lit(1.0)).otherwise(column)


def to_double(column: Column, kind: T.DataType) -> Column:
    """Coercion of a derived value to double: booleans 1/0, NULL 0, numeric text its number, otherwise NULL."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(column.cast("double"), F.lit(0.0))
    if isinstance(kind, T.StringType):
        return F.when(column.isNull() | (F.trim(column) == ""), F.lit(0.0)).otherwise(F.trim(column).try_cast("double"))
    return F.coalesce(column.cast("double"), F.lit(0.0))
