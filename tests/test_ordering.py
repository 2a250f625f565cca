import random

import pytest
from pyspark.sql import functions as F

from fityard import runtime
from fityard.functions.ordering import file_order_index, index_within, row_index, score_buckets
from fityard.functions.vectors import ntz_micros, unit_hash
from tests.conftest import rows_of


def _skewed(n=500, seed=1):
    """A third of the rows in one group; unique keys in random order."""
    rnd = random.Random(seed)
    keys = list(range(n))
    rnd.shuffle(keys)
    return [("hot" if rnd.random() < 0.34 else f"g{rnd.randrange(40)}", k // 7, k) for k in keys]


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_row_index(spark, partitions):
    rows = _skewed()
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(partitions)
    got = rows_of(row_index(df, ["a", "b"]), "row_idx", "a", "b")
    assert got == [(i, a, b) for i, (a, b) in enumerate(sorted((a, b) for _, a, b in rows))]


def test_positions_of_no_rows(spark):
    empty = spark.createDataFrame([], "g string, a int")
    assert row_index(empty, ["a"]).count() == 0
    assert index_within(empty, ["g"], ["a"]).count() == 0


@pytest.mark.parametrize("block_rows", [1, 8, 1 << 16])
def test_index_within_splits_hot_groups(spark, block_rows):
    rows = _skewed()
    df = spark.createDataFrame(rows, "g string, a int, b int").repartition(5)
    got = rows_of(index_within(df, ["g"], ["a", "b"], block_rows=block_rows), "g", "a", "b", "pos")
    seen, want = {}, []
    for g, a, b in sorted(rows):
        want.append((g, a, b, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + 1
    assert got == want


def test_file_order_over_files_and_splits(spark, tmp_path):
    folder, n = tmp_path / "in", 0
    folder.mkdir()
    for f, size in enumerate((900, 1, 300)):
        (folder / f"f{f}.csv").write_text("".join(f"{n + i},{'x' * (i % 50)}\n" for i in range(size)))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        scan = spark.read.schema("v bigint, s string").csv(str(folder))
        assert scan.rdd.getNumPartitions() > 5
        indexed = file_order_index(scan)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # The result no longer depends on how the files are split.
    assert rows_of(indexed, "row_idx", "v") == [(i, i) for i in range(n)]


def test_score_buckets_keep_order(spark):
    scores = spark.createDataFrame([(float(i * i % 97),) for i in range(97)], "s double").distinct()
    buckets = [r["_bucket"] for r in score_buckets(scores, "s").orderBy("s").collect()]
    assert buckets == sorted(buckets) and len(set(buckets)) > 4


def test_score_buckets_of_nothing(spark):
    assert score_buckets(spark.createDataFrame([], "s double"), "s").count() == 0


def test_unit_hash_takes_any_integer(spark):
    keys = [0, 1, -5, 2**31, 2**40 + 3, 2**62, -(2**63)]
    got = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", unit_hash("k").alias("h"))
    for k, h in rows_of(got):
        assert h == k % 2**31 * 2654435761 % 2**32 / 2**32 and 0 <= h < 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_micros_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        text = ["2024-03-10 02:30:00.123456", "1969-12-31 23:59:59.999999", "2024-11-03 01:30:00"]
        df = spark.createDataFrame([(t,) for t in text], "t string").select(
            F.expr("cast(t as timestamp_ntz)").alias("ts"))
        got = [r[0] for r in df.select(ntz_micros("ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [1710037800123456, -1, 1730597400000000]


def test_positions_do_not_depend_on_file_names_or_sizes(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "2")
    try:
        rows = [(x,) for x in range(5000)]
        df = spark.createDataFrame(rows, "a int").repartition(7)
        assert rows_of(row_index(df, ["a"]), "row_idx", "a") == [(i, i) for i in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_row_index_beside_columns_of_the_same_names(spark):
    df = spark.range(50).select((49 - F.col("id")).alias("_part"), F.col("id").alias("_at"), F.lit("x").alias("_n")).repartition(3)
    got = row_index(df, ["_at"])
    assert got.columns == ["_part", "_at", "_n", "row_idx"]
    assert all(r["row_idx"] == r["_at"] == 49 - r["_part"] for r in got.collect())


def test_lookups_are_sent_by_rows_and_bytes(spark, monkeypatch):
    lookup = runtime.written(spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("name")), "lookup")
    assert runtime.is_small(lookup)
    monkeypatch.setattr(runtime, "MAX_BROADCAST_BYTES", 4999)
    assert not runtime.is_small(lookup) and runtime.is_small(lookup.select("id"))
    assert runtime.join_lookup(spark.range(7), lookup, ["id"]).count() == 7
    monkeypatch.setattr(runtime, "MAX_BROADCAST_ROWS", 99)
    assert not runtime.is_small(lookup.select("id"))
