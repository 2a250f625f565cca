"""Headerless feature files: scan, ordered prefix, chunks, export."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fityard.functions.ordering import place_in_files
from fityard.runtime import new_table_path
from fityard.spec import DatasetSpec


def scan_feature_csv(spark: SparkSession, path: str | list[str], spec: DatasetSpec) -> DataFrame:
    """Read a headerless CSV with the fixed schema of ``spec``; a row of another width fails."""
    return (spark.read.schema(spec.struct())
            .option("header", False).option("mode", "FAILFAST").csv(path))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that aren't blank, with their file and the start of their split."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    return lines.filter(F.trim("value") != "")


def _listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, size, modified)`` of the files under a path; none is opened for its content."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"))


def index_feature_csv(spark: SparkSession, path: str | list[str], index_path: str | None = None) -> DataFrame:
    """Count the rows of every split of the files once: ``(file, size, modified, start, rows)``, written.

    Lines are counted, not parsed. By default the index goes next to the files, into ``_row_counts`` below a single
    folder, where no reader takes it for data.
    """
    if index_path is None:
        if not isinstance(path, str):
            raise ValueError("files of several paths need an index_path")
        index_path = f"{path.rstrip('/')}/_row_counts"
    counts = _lines(spark, path).groupBy(F.col("_file").alias("file"), F.col("_start").alias("start")).agg(
        F.count("*").alias("rows"))
    index = _listing(spark, path).join(counts, "file", "left").select(
        "file", "size", "modified", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("rows", F.lit(0)).alias("rows"))
    index.write.mode("overwrite").parquet(index_path)
    return spark.read.schema(index.schema).parquet(index_path)


def _check_index(spark: SparkSession, path: str | list[str], index: DataFrame) -> None:
    known = index.select("file", F.col("size").alias("_size"), F.col("modified").alias("_modified")).distinct()
    fresh = F.col("size").eqNullSafe(F.col("_size")) & F.col("modified").eqNullSafe(F.col("_modified"))
    other = _listing(spark, path).join(known, "file", "full").filter(~fresh).first()
    if other is not None:
        raise ValueError(f"the index doesn't fit {other['file']}; make it again")


def _pattern(file: str) -> str:
    """A path as a pattern that only it matches; names come encoded as URLs."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _indexed_prefix(spark: SparkSession, path: str | list[str], index: DataFrame, rows: int) -> DataFrame:
    """Lines of the splits in which the first ``rows`` rows are, and of no other split."""
    _check_index(spark, path, index)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file in the only window that isn't keyed.
    files = index.groupBy("file").agg(F.sum("rows").alias("_n")).select(
        "file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_n").filter(F.col("_before") < rows)
    leading = files.orderBy("file").collect()
    if not leading:
        return _lines(spark, path)
    last = leading[-1]
    lines = _lines(spark, [_pattern(r["file"]) for r in leading])
    if last["_before"] + last["_n"] <= rows:
        return lines
    # The first split of the last file that begins at or beyond the prefix; a line that starts on the border between two
    # splits belongs to the first one, whatever splits this scan makes.
    beyond = (index.filter(F.col("file") == last["file"])
              .select("start", F.coalesce(F.sum("rows").over(within), F.lit(0)).alias("_at"))
              .filter(F.col("_at") >= rows - last["_before"]).agg(F.min("start")).first()[0])
    return lines if beyond is None else lines.filter(~((F.col("_file") == last["file"]) & (F.col("_start") >= beyond)))


def _files_of_prefix(spark: SparkSession, path: str, spec: DatasetSpec, rows: int) -> list[str]:
    """Leading files (in path order) that hold the first ``rows`` rows.

    Files are counted in batches of growing size, so that a short prefix of a long table does not
    cost a pass over the whole table.
    """
    files = sorted(_pattern(f) for f in scan_feature_csv(spark, path, spec).inputFiles())
    if len(files) == 1:
        return files
    taken, batch, have = 0, 1, 0
    while have < rows and taken < len(files):
        have += _lines(spark, files[taken:taken + batch]).count()
        taken += batch
        batch *= 2
    return files[:taken]


def read_prefix(spark: SparkSession, path: str, spec: DatasetSpec, n_train: int, n_test: int,
                chunk_rows: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """First ``(n_train + n_test) * chunk_rows`` rows in file order, with their ``row_idx``.

    A shorter table gives all its rows. With an ``index`` of :func:`index_feature_csv` nothing is counted again, and only
    lines of the splits that hold the prefix are parsed and kept; a stale index is an error. Without one, leading
    files are counted until there are enough rows.
    """
    chunk_rows = chunk_rows or spec.chunk_rows
    wanted = (n_train + n_test) * chunk_rows
    if n_train < 1 or n_test < 1 or wanted < 1:
        raise ValueError("at least one train chunk and one test chunk are needed")
    if index is not None:
        lines = _indexed_prefix(spark, path, index, wanted)
    else:
        files = _files_of_prefix(spark, path, spec, wanted)
        if not files:
            raise ValueError(f"no feature files under {path}")
        lines = _lines(spark, files)
    schema = ", ".join(f"`{c}` double" for c in spec.columns)
    parsed = lines.select(F.from_csv("value", schema, {"mode": "FAILFAST"}).alias("r"), "_file", "_start")
    return place_in_files(parsed.select("r.*", "_file", "_start")).filter(F.col("row_idx") < wanted)


def with_chunks(rows: DataFrame, chunk_rows: int, n_train: int) -> DataFrame:
    """Add ``chunk_id``, its side of the split and the chunk's position on that side."""
    chunk = F.expr(f"row_idx div {int(chunk_rows)}")
    train = F.col("chunk_id") < n_train
    return (rows.withColumn("chunk_id", chunk)
            .withColumn("split", F.when(train, "train").otherwise("test"))
            .withColumn("chunk_pos", F.when(train, F.col("chunk_id"))
                        .otherwise(F.col("chunk_id") - n_train)))


def chunk_table(rows: DataFrame, chunk_rows: int, n_train: int, path: str | None = None) -> DataFrame:
    """Write the prefix as a table with ``split`` and ``chunk_id``, and read it back.

    Rows arrive in file order, so every file holds a range of chunks and its row groups know which: there are
    as many files as tasks, however many chunks, and readers of one side or one chunk skip all others by statistics.
    """
    spark = rows.sparkSession
    path = path or new_table_path(spark, "chunks")
    chunked = with_chunks(rows, chunk_rows, n_train)
    chunked.write.parquet(path)
    return spark.read.schema(chunked.schema).parquet(path)


def export_feature_csv(df: DataFrame, path: str, label_col: str, features_col: str, width: int,
                       mode: str = "append") -> None:
    """Write ``label, f0, ..., f(width-1)`` without header and without an index column."""
    wide = df.select(F.col(label_col).alias("label"),
                     *[F.col(features_col)[i].alias(f"f{i}") for i in range(width)])
    wide.write.mode(mode).option("header", False).csv(path)
