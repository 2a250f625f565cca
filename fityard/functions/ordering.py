"""Positions and running totals over a global order, without ever sorting in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fityard.runtime import join_lookup, new_table_path, written

# Rows of one group that may share a task in a blocked computation.
BLOCK_ROWS = 1 << 16
# Distinct scores that may share a task in a running total.
BUCKET_ROWS = 1 << 20


def row_index(df: DataFrame, keys: list[str], out: str = "row_idx") -> DataFrame:
    """Dense 0-based position of every row in the order of ``keys`` (unique together).

    The rows are range-partitioned, sorted and written once, one file for each partition; the position inside
    a file is then read from Parquet metadata, so that the second scan neither sorts nor shuffles. Files are
    ordered by the partition number that their rows carry, never by their names.
    """
    spark = df.sparkSession
    part, at, n, off = _unused(df, "_part", "_at", "_n", "_off")
    path = new_table_path(spark, "ordered")
    ordered = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
               .withColumn(part, F.spark_partition_id()))
    ordered.write.option("maxRecordsPerFile", 0).parquet(path)
    rows = spark.read.schema(ordered.schema).parquet(path).select(
        "*", F.col("_metadata.row_index").alias(at))
    sizes = rows.groupBy(part).agg(F.count("*").alias(n))
    # One row per written file, that is at most spark.sql.shuffle.partitions rows.
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    return (rows.join(F.broadcast(offsets), part)
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col(off) + F.col(at)).alias(out)))


def _unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores where a column of ``df`` has one already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def index_within(df: DataFrame, group: list[str], keys: list[str], out: str = "pos",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of every row inside its group; a group may be larger than any task.

    Equal to ``row_number() - 1`` over the group, but the rows of one group are only ever brought
    together in blocks of ``block_rows``.
    """
    numbered = row_index(df, [*group, *keys], out="_idx").withColumn(
        "_blk", F.expr(f"_idx div {block_rows}"))
    firsts = numbered.groupBy(*group, "_blk").agg(F.min("_idx").alias("_first"))
    starts = firsts.select(*group, "_blk",
                           F.min("_first").over(Window.partitionBy(*group)).alias("_start"))
    return (join_lookup(numbered, written(starts, "starts"), [*group, "_blk"])
            .select(*df.columns, (F.col("_idx") - F.col("_start")).alias(out)))


def file_order_index(rows: DataFrame, out: str = "row_idx") -> DataFrame:
    """0-based position of every row of a file scan, in file order (files in path order).

    ``rows`` must be a plain file scan. It is read once, into a written table that keeps for every row
    its input split and its place in the scan; the position is the split's offset plus the place inside
    the split. Scanning the files a second time instead would parse them again, and could find other
    splits when the number of executors has changed in between.
    """
    return place_in_files(rows.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")), out)


def place_in_files(rows: DataFrame, out: str = "row_idx") -> DataFrame:
    """As :func:`file_order_index` for rows that carry their ``_file`` and the ``_start`` of their split, in the order of the
    scan; rows of whole splits may be missing at the end."""
    tagged = written(rows.withColumn("_mid", F.monotonically_increasing_id()), "scan")
    splits = written(tagged.groupBy("_file", "_start").agg(
        F.count("*").alias("_n"), F.min("_mid").alias("_m0")), "splits")
    # Prefix sums in two steps, so that the widest window is one row per file.
    within = (Window.partitionBy("_file").orderBy("_start")
              .rowsBetween(Window.unboundedPreceding, -1))
    across = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_fn")).select(
        "_file", F.coalesce(F.sum("_fn").over(across), F.lit(0)).alias("_foff"))
    offsets = (splits.withColumn("_boff", F.coalesce(F.sum("_n").over(within), F.lit(0)))
               .join(files, "_file")
               .select("_file", "_start", "_m0", (F.col("_foff") + F.col("_boff")).alias("_off")))
    return (join_lookup(tagged, written(offsets, "split-offsets"), ["_file", "_start"])
            .withColumn(out, F.col("_off") + F.col("_mid") - F.col("_m0"))
            .drop("_file", "_start", "_mid", "_m0", "_off"))


def score_buckets(scores: DataFrame, score: str, out: str = "_bucket") -> DataFrame:
    """Add an order-preserving bucket number with about equally many rows per bucket.

    ``scores`` has one row per distinct score and should be a written table, for it is read twice.
    The cut points are approximate quantiles; being constants of the plan they give every evaluation
    the same buckets. Larger scores never get a smaller bucket, so only the place of the cuts is
    approximate, never a result that is put together from all buckets.
    """
    partitions = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(partitions, 8, -(-scores.count() // BUCKET_ROWS))  # the count reads Parquet footers
    cuts = sorted(set(scores.approxQuantile(score, [i / n for i in range(1, n)], 1 / (2 * n))))
    if not cuts:
        return scores.withColumn(out, F.lit(0))
    bucketed = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=score,
                          outputCol=out).transform(scores)
    return bucketed.withColumn(out, F.col(out).cast("int"))
