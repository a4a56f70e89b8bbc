"""Benign-baseline preprocessing: median imputation, then standard scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.base import Estimator, Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logvane.functions.coerce import column_number, finite, read_number
from logvane.operators.quantiles import exact_quantiles
from logvane.schema import FEATURE_COLUMNS

MIN_ROWS = 100

PARAMS_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("feature", T.StringType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class FeatureParams:
    feature: str
    median: float
    mean: float
    scale: float


def require_columns(df: DataFrame, columns) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")


def clean_rows(df: DataFrame, columns) -> DataFrame:
    """The feature columns of the rows in which every one of them is finite.

    A finite number times zero is zero; infinity and NaN give NaN, null stays
    null. One sum therefore tests all columns at once.
    """
    require_columns(df, columns)
    numbers = [read_number(df, c) for c in columns]
    all_zero = reduce(Column.__add__, [n * F.lit(0.0) for n in numbers])
    return df.where(all_zero == F.lit(0.0)).select(
        *[n.alias(c) for n, c in zip(numbers, columns)]
    )


class BaselineScaler(Estimator):
    """Learns median, mean and population deviation per feature from benign rows.

    The caller passes benign rows only. Rows with any non-finite feature are
    left out of the fit. The rows are read in four passes: pass a stored frame,
    or a narrow view of one that always gives the same rows.
    """

    def __init__(self, columns=FEATURE_COLUMNS):
        super().__init__()
        self.columns = list(columns)

    def _fit(self, dataset: DataFrame) -> BaselineScalerModel:
        # All columns side by side, no row multiplied; the sums alone, so that their code is compiled.
        clean = clean_rows(dataset, self.columns)
        wanted = [F.count("*")]
        for c in self.columns:
            value = F.col(f"`{c}`")
            wanted += [F.avg(value), F.stddev_pop(value)]
        rows, *figures = clean.agg(*wanted).first()
        if rows < MIN_ROWS:
            raise ValueError(
                f"only {rows} clean rows; at least {MIN_ROWS} are needed to fit a scaler"
            )
        stats = {c: figures[2 * i : 2 * i + 2] for i, c in enumerate(self.columns)}
        medians = exact_quantiles(clean, self.columns, 0.5, dict.fromkeys(self.columns, rows))
        return BaselineScalerModel(
            [
                FeatureParams(
                    c,
                    medians[c],
                    stats[c][0],
                    stats[c][1] if stats[c][1] > 0 else 1.0,
                )
                for c in self.columns
            ],
            fitted_rows=rows,
        )


class BaselineScalerModel(Model):
    """Fitted parameters; transforming is plain column arithmetic."""

    def __init__(self, params: list[FeatureParams], fitted_rows: int | None = None):
        super().__init__()
        self.feature_params = params
        self.fitted_rows = fitted_rows

    @property
    def columns(self) -> list[str]:
        return [p.feature for p in self.feature_params]

    def scaled(self, raw: dict[str, Column]) -> list[Column]:
        """Standard scores in feature order; missing or non-finite is imputed."""
        scores = []
        for p in self.feature_params:
            value = F.coalesce(finite(raw[p.feature]), F.lit(p.median)) if p.feature in raw \
                else F.lit(p.median)
            scores.append((value - F.lit(p.mean)) / F.lit(p.scale))
        return scores

    def _transform(self, dataset: DataFrame) -> DataFrame:
        require_columns(dataset, self.columns)
        raw = {c: read_number(dataset, c) for c in self.columns}
        return dataset.withColumn("scaled", F.array(*self.scaled(raw)))

    def params_frame(self, spark: SparkSession) -> DataFrame:
        """One row per feature."""
        rows = [
            (i, p.feature, p.median, p.mean, p.scale)
            for i, p in enumerate(self.feature_params)
        ]
        return spark.createDataFrame(rows, PARAMS_SCHEMA)

    @classmethod
    def from_params_frame(cls, params: DataFrame) -> BaselineScalerModel:
        rows = params.orderBy("position").collect()  # one row per feature
        return cls([FeatureParams(r.feature, r.median, r.mean, r.scale) for r in rows])


def long_deviations(df: DataFrame, model: BaselineScalerModel, keep: list[str]) -> DataFrame:
    """Long form: one row per (row, feature) with its standard score."""
    raw = {c: read_number(df, c) for c in model.columns}
    entries = [
        F.struct(F.lit(c).alias("feature"), z.alias("deviation"))
        for c, z in zip(model.columns, model.scaled(raw))
    ]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_entry")).select(
        *keep, "_entry.*"
    )


def class_feature_stats(df: DataFrame, columns, class_column: str) -> DataFrame:
    """Mean and population deviation of each feature per class, long form.

    Wide aggregates are computed in one pass and turned long afterwards, so
    rows are not multiplied by the number of features.
    """
    wide = df.groupBy(class_column).agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.avg(column_number(df, c)).alias("mean"),
                F.stddev_pop(column_number(df, c)).alias("std"),
            ).alias(f"_f{i}")
            for i, c in enumerate(columns)
        ]
    )
    return wide.select(
        class_column, F.explode(F.array(*[f"_f{i}" for i in range(len(columns))])).alias("_s")
    ).select(class_column, "_s.*")
