"""fityard: model-benchmark analytics as PySpark DataFrame operators."""

from fityard.spec import DATASETS, DatasetSpec, LibraryProfile

__all__ = ["DATASETS", "DatasetSpec", "LibraryProfile"]
