"""Where intermediate tables live.

Everything that has to outlive one query stage goes to the folder the cluster names in
``spark.checkpoint.dir``; a private folder is made only for a local session without that setting.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Narrow lookup tables up to so many rows, and bytes in their strings, may be broadcast; larger ones are joined by shuffle.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors can reach; also makes sure ``checkpoint()`` can be used."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    active = sc.getCheckpointDir()
    if root is None and active is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="fityard-")
    if active is None:
        sc.setCheckpointDir(root)
    return root or active


def new_table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/fityard/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and read it back."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_old_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark deletes the files of shuffles that nothing refers to any more then, and
    otherwise whenever the driver happens to run short of memory."""
    spark.sparkContext._jvm.System.gc()


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a written lookup table, broadcast only after its rows have been counted (which reads Parquet
    footers) and the bytes of its strings added up."""
    return rows.join(F.broadcast(lookup) if is_small(lookup) else lookup, keys)


def is_small(lookup: DataFrame) -> bool:
    """Whether a written table is small enough to be sent to all executors."""
    if lookup.count() > MAX_BROADCAST_ROWS:
        return False
    texts = [F.sum(F.octet_length(f"`{c}`")) for c, kind in lookup.dtypes if kind in ("string", "binary")]
    return not texts or sum(v or 0 for v in lookup.agg(*texts).first()) <= MAX_BROADCAST_BYTES


def spread(rows: DataFrame) -> DataFrame:
    """Repartition a file scan that comes in fewer pieces than there are cores, ahead of iterative
    fits. Large tables have more splits than cores and pass unchanged, without a shuffle."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
