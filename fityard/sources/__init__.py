from fityard.sources.binary_items import (
    batch_featurize, byte_histogram, label_from_filename, read_items)
from fityard.sources.feature_csv import (
    chunk_table, export_feature_csv, index_feature_csv, read_prefix, scan_feature_csv, with_chunks)
from fityard.sources.run_logs import (
    read_run_files, read_run_logs, write_run_files, write_run_logs)

__all__ = [
    "batch_featurize", "byte_histogram", "chunk_table", "export_feature_csv", "index_feature_csv",
    "label_from_filename", "read_items", "read_prefix", "read_run_files", "read_run_logs",
    "scan_feature_csv", "with_chunks", "write_run_files", "write_run_logs",
]
