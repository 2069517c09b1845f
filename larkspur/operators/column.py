"""Column handles: arithmetic that commits to the parent frame, and dictionary-decoded series."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.expr import quoted, safe_divisor, type_of

if TYPE_CHECKING:
    from larkspur.operators.frame import Frame


class ColumnHandle:
    """A live view on one column of a frame; each operation rebinds that column and returns the handle."""

    def __init__(self, frame: Frame, name: str):
        self.frame, self.name = frame, name

    @property
    def expr(self) -> Column:
        return F.col(quoted(self.name))

    def _other(self, other: ColumnHandle | Column | float) -> Column:
        if isinstance(other, ColumnHandle):
            return other.expr.cast("double")
        return other.cast("double") if isinstance(other, Column) else F.lit(float(other))

    def _commit(self, expr: Column) -> ColumnHandle:
        self.frame.df = self.frame.df.withColumn(self.name, expr)
        return self

    def add(self, other) -> ColumnHandle:
        return self._commit(self.expr.cast("double") + self._other(other))

    def sub(self, other) -> ColumnHandle:
        return self._commit(self.expr.cast("double") - self._other(other))

    def mul(self, other) -> ColumnHandle:
        return self._commit(self.expr.cast("double") * self._other(other))

    def div(self, other) -> ColumnHandle:
        """A zero divisor leaves the value as it is."""
        return self._commit(self.expr.cast("double") / safe_divisor(self._other(other)))

    def to_datetime(self) -> ColumnHandle:
        """Epoch milliseconds as double; NULL where the text is no date."""
        kind = type_of(self.frame.df, self.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            stamp = self.expr.cast("timestamp")
        else:
            stamp = F.try_to_timestamp(self.expr.cast("string"))
        return self._commit(F.unix_millis(stamp).cast("double"))

    def extract_hour(self, offset_seconds: int = 32400) -> ColumnHandle:
        """Adds ``<name>_hour`` from epoch milliseconds, shifted back by the offset."""
        seconds = F.floor(self.expr / 1000) - F.lit(offset_seconds)
        hour = F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("double")
        self.frame.df = self.frame.df.withColumn(f"{self.name}_hour", hour)
        return ColumnHandle(self.frame, f"{self.name}_hour")


class Series:
    """Numeric vector with an optional dictionary (id, text); both sides are DataFrames, joined on demand."""

    def __init__(self, values: DataFrame, dictionary: DataFrame | None = None):
        """``values``: pos, id. ``dictionary``: id, label."""
        self.values, self.dictionary = values, dictionary

    def decoded(self) -> DataFrame:
        """pos, value: dictionary text, or the id where the dictionary lacks it."""
        if self.dictionary is None:
            return self.values.select("pos", F.col("id").alias("value"))
        return self.values.join(self.dictionary, "id", "left").select(
            "pos", F.coalesce("label", F.col("id").cast("string")).alias("value")
        )

    def get(self, position: int):
        row = Series(self.values.filter(F.col("pos") == position), self.dictionary).decoded().first()
        return row.value if row else None

    def slice(self, start: int, stop: int) -> Series:
        kept = self.values.filter((F.col("pos") >= start) & (F.col("pos") < stop))
        return Series(kept.withColumn("pos", F.col("pos") - start), self.dictionary)

    def __len__(self) -> int:
        return self.values.count()
