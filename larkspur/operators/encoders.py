"""Feature encoders, scalers and a fit/transform pipeline over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.expr import comparable, is_missing, quoted, type_of
from larkspur.plans.ranks import ONE_TASK_ROWS, numbered

# One-hot makes a column per category: more than this is a mistake, not a feature.
MAX_ONE_HOT = 10_000


class NotFitted(RuntimeError):
    pass


def _need(value, who: object):
    if value is None:
        raise NotFitted(f"{type(who).__name__} must be fitted before use")
    return value


class LabelEncoder:
    """Sorted distinct non-null values to 0..n-1; NULL and unseen values to -1."""

    def __init__(self):
        self._classes: list | None = None

    def fit(self, values: Sequence) -> LabelEncoder:
        self._classes = sorted({v for v in values if v is not None and v == v})
        return self

    def fit_column(self, df: DataFrame, name: str) -> LabelEncoder:
        """From a column with a bounded number of classes (ONE_TASK_ROWS); use StringIndexer beyond."""
        found = df.select(F.col(quoted(name)).alias("v")).distinct().limit(ONE_TASK_ROWS + 1).collect()
        if len(found) > ONE_TASK_ROWS:
            raise ValueError(f"{name} has more than {ONE_TASK_ROWS} classes: use StringIndexer, which joins")
        return self.fit([r.v for r in found])

    def get_classes(self) -> list:
        return list(_need(self._classes, self))

    def transform(self, values: Sequence) -> list[int]:
        index = {v: i for i, v in enumerate(_need(self._classes, self))}
        return [index.get(v, -1) for v in values]

    def fit_transform(self, values: Sequence) -> list[int]:
        return self.fit(values).transform(values)

    def inverse_transform(self, codes: Sequence[int]) -> list:
        classes = _need(self._classes, self)
        return [classes[int(c)] if c is not None and 0 <= c < len(classes) else None for c in codes]

    def _table(self, df: DataFrame, kind: T.DataType) -> DataFrame:
        schema = T.StructType([T.StructField("_class", kind), T.StructField("_code", T.IntegerType())])
        return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(_need(self._classes, self))], schema)

    def encode(self, df: DataFrame, name: str, out: str) -> DataFrame:
        table = self._table(df, type_of(df, name))
        joined = df.join(F.broadcast(table), F.col(quoted(name)) == F.col("_class"), "left")
        return joined.withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_class", "_code")

    def decode(self, df: DataFrame, name: str, out: str, kind: T.DataType) -> DataFrame:
        table = self._table(df, kind)
        joined = df.join(F.broadcast(table), F.col(quoted(name)) == F.col("_code"), "left")
        return joined.withColumn(out, F.col("_class")).drop("_class", "_code")


class StringIndexer:
    """Trimmed texts, sorted ascending, to indexes as doubles; unseen and NULL to n."""

    def __init__(self):
        self.labels: DataFrame | None = None
        self.size = 0

    def fit(self, df: DataFrame, name: str) -> StringIndexer:
        texts = df.select(F.trim(F.col(quoted(name)).cast("string")).alias("_label")).filter("_label is not null").distinct()
        self.size = texts.count()
        self.labels = numbered(texts, ["_label"], "_index", self.size)
        return self

    def transform(self, df: DataFrame, name: str, out: str | None = None) -> DataFrame:
        labels = _need(self.labels, self)
        joined = df.join(labels, F.trim(F.col(quoted(name)).cast("string")) == F.col("_label"), "left")
        index = F.coalesce(F.col("_index").cast("double"), F.lit(float(self.size)))
        return joined.withColumn(out or f"{name}_indexed", index).drop("_label", "_index")

    def fit_transform(self, df: DataFrame, name: str, out: str | None = None) -> DataFrame:
        return self.fit(df, name).transform(df, name, out)

    def get_labels(self) -> list[str]:
        return [r[0] for r in _need(self.labels, self).orderBy("_index").select("_label").toLocalIterator()]

    def get_index(self, label: str) -> int:
        row = _need(self.labels, self).filter(F.col("_label") == label.strip(" ")).first()
        return row["_index"] if row else self.size


class OneHotEncoder:
    """A 0/1 column ``<col>_<category>`` per sorted category; unseen values are all 0."""

    def __init__(self, columns: Sequence[str] = (), drop_first: bool = False):
        self.columns, self.drop_first = list(columns), drop_first
        self.categories: dict[str, list] | None = None

    def fit(self, df: DataFrame) -> OneHotEncoder:
        found = {}
        for name in self.columns:
            value = comparable(F.col(quoted(name)), type_of(df, name)).alias("v")
            values = [r.v for r in df.select(value).filter("v is not null").distinct().limit(MAX_ONE_HOT + 1).collect()]
            if len(values) > MAX_ONE_HOT:
                raise ValueError(f"{name} has more than {MAX_ONE_HOT} categories")
            found[name] = sorted(values)
        self.categories = found
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = {}
        for name, values in _need(self.categories, self).items():
            for v in values[1:] if self.drop_first else values:
                shown = int(v) if isinstance(v, float) and v == int(v) else v
                made[f"{name}_{shown}"] = F.coalesce((F.col(quoted(name)) == F.lit(v)).cast("tinyint"), F.lit(0).cast("tinyint"))
        return df.withColumns(made)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fits only when not fitted yet."""
        return (self if self.categories is not None else self.fit(df)).transform(df)


class _Scaler:
    suffix = ""

    def __init__(self, columns: Sequence[str] = ()):
        self.columns = list(columns)
        self.params: dict[str, tuple[float, float]] | None = None

    def _measures(self, value):
        raise NotImplementedError

    def _scaled(self, value, params):
        raise NotImplementedError

    def fit(self, df: DataFrame) -> _Scaler:
        exprs = []
        for i, name in enumerate(self.columns):
            value = comparable(F.col(quoted(name)), type_of(df, name)).cast("double")
            exprs += [m.alias(f"{k}{i}") for k, m in zip("ab", self._measures(value), strict=True)]
        row = df.agg(*exprs).first()
        self.params = {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(self.columns)}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        made = {}
        for name, params in _need(self.params, self).items():
            kind, column = type_of(df, name), F.col(quoted(name))
            made[f"{name}_{self.suffix}"] = F.when(~is_missing(column, kind), self._scaled(column.cast("double"), params))
        return df.withColumns(made)

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)


class StandardScaler(_Scaler):
    """(x - mean) / population deviation, a zero deviation counting 1."""

    suffix = "scaled"

    def _measures(self, value):
        return F.avg(value), F.stddev_pop(value)

    def _scaled(self, value, params):
        mean, deviation = params
        return (value - F.lit(mean)) / F.lit(deviation or 1.0)


class MinMaxScaler(_Scaler):
    """Scaled into ``feature_range``; a constant column takes its lower end."""

    suffix = "normalized"

    def __init__(self, columns: Sequence[str] = (), feature_range: tuple[float, float] = (0.0, 1.0)):
        super().__init__(columns)
        self.feature_range = feature_range

    def _measures(self, value):
        return F.min(value), F.max(value)

    def _scaled(self, value, params):
        (low, high), (to, until) = params, self.feature_range
        width = None if low is None else (high - low) or 1.0
        return (value - F.lit(low)) / F.lit(width) * F.lit(float(until - to)) + F.lit(float(to))


class Pipeline:
    """Stages fitted in turn, each on what those before it made."""

    def __init__(self, stages: Sequence = ()):
        self.stages, self.fitted = list(stages), False

    def add(self, stage) -> Pipeline:
        """The pipeline has to be fitted again."""
        self.stages.append(stage)
        self.fitted = False
        return self

    def fit(self, df: DataFrame) -> Pipeline:
        for stage in self.stages:
            df = stage.fit(df).transform(df)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFitted("Pipeline must be fitted before use")
        for stage in self.stages:
            df = stage.transform(df)
        return df

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)
