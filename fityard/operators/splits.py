"""Train / validation / test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.functions.vectors import VAL_MULTIPLIER, unit_hash


def train_fraction(n_train: int, n_test: int) -> float:
    if n_train < 0 or n_test < 0 or n_train + n_test == 0:
        raise ValueError("chunk counts must be non-negative and not both zero")
    return n_train / (n_train + n_test)


def positional_split(rows: DataFrame, chunk_rows: int, n_train: int, n_test: int,
                     idx_col: str = "row_idx") -> DataFrame:
    """Label the prefix ``train`` / ``test`` by position; rows past the prefix are left out.

    Positions are dense from 0, so the number of rows tells whether a side would be empty, which is a ``ValueError``.
    Of a written table that number comes from file footers.
    """
    cut, end = n_train * chunk_rows, (n_train + n_test) * chunk_rows
    if min(cut, end - cut) < 1 or rows.count() <= cut:
        raise ValueError("the table is too short: train or test side is empty")
    idx = F.col(idx_col)
    return rows.filter(idx < end).withColumn("split", F.when(idx < cut, "train").otherwise("test"))


def merge_train_test(train: DataFrame, test: DataFrame) -> DataFrame:
    """Bag union; duplicates are kept."""
    return train.unionByName(test)


def random_split(df: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """Random split of approximate size. Depends on partitioning: see :func:`hash_split`."""
    train, test = df.randomSplit([fraction, 1 - fraction], seed)
    return train, test


def hash_split(df: DataFrame, key: str, fraction: float, out: str = "split") -> DataFrame:
    """Split by a hash of an integer key: the same on any engine and partitioning, and stable when
    a lost partition is computed again."""
    return df.withColumn(out, F.when(unit_hash(key) < fraction, "train").otherwise("test"))


def train_val_split(df: DataFrame, key: str, ratio: float = 0.8, out: str = "split") -> DataFrame:
    """Split the ``train`` side of ``out`` again into ``train`` and ``val``; ``test`` stays.

    The hash differs from that of :func:`hash_split`, so the two can be chained.
    """
    is_val = (F.col(out) == "train") & (unit_hash(key, VAL_MULTIPLIER) >= ratio)
    return df.withColumn(out, F.when(is_val, "val").otherwise(F.col(out)))
