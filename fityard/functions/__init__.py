from fityard.functions.ordering import file_order_index, index_within, place_in_files, row_index, score_buckets
from fityard.functions.vectors import as_vector, dot, nearest_center, ntz_micros, unit_hash

__all__ = [
    "as_vector", "dot", "file_order_index", "index_within", "nearest_center", "ntz_micros",
    "place_in_files", "row_index", "score_buckets", "unit_hash",
]
