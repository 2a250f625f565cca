"""Naming, typing and assembling feature tables."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.functions.vectors import quoted
from fityard.spec import TARGET, DatasetSpec


def name_columns(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Positional names of ``spec``; a table of another width is an error."""
    if len(df.columns) != len(spec.columns):
        raise ValueError(f"{spec.name} has {len(spec.columns)} columns, the table {len(df.columns)}")
    return df.toDF(*spec.columns)


def rename_label(df: DataFrame, target_col: str = TARGET, label_col: str = "label") -> DataFrame:
    return df.withColumnRenamed(target_col, label_col)


def feature_names(df: DataFrame, target_col: str = TARGET) -> list[str]:
    """All columns but the target, in order."""
    if target_col not in df.columns:
        raise ValueError(f"no column {target_col!r}")
    return [c for c in df.columns if c != target_col]


def drop_target(df: DataFrame, target_col: str = TARGET) -> DataFrame:
    return df.select(*[quoted(c) for c in feature_names(df, target_col)])


def to_double_features(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    return df.withColumns({c: quoted(c).cast("double") for c in feature_cols})


def assemble_features(df: DataFrame, feature_cols: list[str], out: str = "features",
                      handle_invalid: str = "error") -> DataFrame:
    """Feature columns as one vector; nulls fail, drop the row or become NaN
    (``error`` / ``skip`` / ``keep``)."""
    return VectorAssembler(inputCols=feature_cols, outputCol=out,
                           handleInvalid=handle_invalid).transform(df)


def select_label_features(df: DataFrame, label_col: str = "label",
                          features_col: str = "features") -> DataFrame:
    return df.select(label_col, features_col)


def select_pred_label(df: DataFrame, prediction_col: str = "prediction",
                      label_col: str = "label") -> DataFrame:
    return df.select(prediction_col, label_col)


def encode_label(df: DataFrame, target_col: str, out: str = "label",
                 handle_invalid: str = "error") -> tuple[DataFrame, StringIndexerModel]:
    """Categorical target as 0, 1, ... in alphabetical order of its levels."""
    model = StringIndexer(inputCol=target_col, outputCol=out, stringOrderType="alphabetAsc",
                          handleInvalid=handle_invalid).fit(df)
    return model.transform(df), model


def impute_mean(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Replace missing features by the mean of the column's present values."""
    return Imputer(strategy="mean", inputCols=feature_cols,
                   outputCols=feature_cols).fit(df).transform(df)


def first_row(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row with the smallest key; each task keeps one row, no full sort."""
    return df.orderBy(*keys).limit(1)


def output_arity(df: DataFrame, vector_col: str) -> DataFrame:
    """Number of components of a vector column, checked over all rows."""
    width = F.size(vector_to_array(F.col(vector_col)))
    return df.agg(F.min(width).alias("min_cols"), F.max(width).alias("n_cols"),
                  F.count("*").alias("n_rows"))
