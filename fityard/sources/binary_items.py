"""Named binary items (images, pages, texts): label from the name, features in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as ``(path, modificationTime, length, content)``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def label_from_filename(path: str) -> Column:
    """Last part of a path up to its first dot: ``.../cat.12.jpg`` gives ``cat``."""
    return F.substring_index(F.regexp_extract(F.col(path), r"([^/]+)$", 1), ".", 1)


def batch_featurize(items: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
                    schema: T.StructType | str) -> DataFrame:
    """Apply a user-supplied bulk model to the items; Spark feeds it Arrow batches per partition.

    A model that is costly to load is loaded once at the top of ``fn``, before its loop.
    """
    return items.mapInPandas(fn, schema)


def byte_histogram(id_col: str, content_col: str):
    """Built-in featurizer for :func:`batch_featurize`: 256 byte counts of the whole content."""

    def fn(batches):
        for batch in batches:
            counts = [np.bincount(np.frombuffer(c or b"", dtype=np.uint8), minlength=256)
                      for c in batch[content_col]]
            yield pd.DataFrame({id_col: batch[id_col], "features": counts})

    return fn
