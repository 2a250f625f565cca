"""Dataset and library descriptions that the operators are driven by."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

TARGET = "target"


@dataclass(frozen=True)
class DatasetSpec:
    """A headerless table: one target column and ``num_cols`` numeric features.

    ``target_col_idx`` is the position of the target in the file; features keep their file order and
    are called ``"0"``, ``"1"``, ... whatever that position is.
    """

    name: str
    num_cols: int
    target_col_idx: int = 0
    chunk_rows: int = 100_000

    def __post_init__(self):
        if self.num_cols < 1:
            raise ValueError("a dataset needs at least one feature column")
        if not 0 <= self.target_col_idx <= self.num_cols:
            raise ValueError("target_col_idx lies outside the row")
        if self.chunk_rows < 1:
            raise ValueError("chunk_rows must be positive")

    @property
    def feature_cols(self) -> list[str]:
        return [str(i) for i in range(self.num_cols)]

    @property
    def columns(self) -> list[str]:
        names = self.feature_cols
        names.insert(self.target_col_idx, TARGET)
        return names

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c, T.DoubleType()) for c in self.columns])


# Width and target position of the two known datasets.
DATASETS = {
    "susy": DatasetSpec("susy", num_cols=18, target_col_idx=0, chunk_rows=10_000),
    "cats_dogs": DatasetSpec("cats_dogs", num_cols=2048, target_col_idx=0, chunk_rows=100),
}


@dataclass(frozen=True)
class LibraryProfile:
    """Name of a library as it stands in a run log, and the positions of its setup events."""

    name: str
    first_setup_pos: int
    last_setup_pos: int


# The first library logs three setup events, the second one four; both start at position 8.
LIB_A = LibraryProfile("lib_a", 8, 10)
LIB_B = LibraryProfile("lib_b", 8, 11)
