import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fityard.operators import features as ft
from fityard.operators import splits as sp
from fityard.spec import DatasetSpec
from tests.conftest import rows_of


def test_width_mismatch_is_an_error(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert ft.name_columns(df, DatasetSpec("x", 1)).columns == ["target", "0"]
    with pytest.raises(ValueError):
        ft.name_columns(df, DatasetSpec("x", 2))


def test_drop_target(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "`0` double, target double, `1` double")
    assert ft.drop_target(df).columns == ["0", "1"]
    with pytest.raises(ValueError):
        ft.feature_names(df, "nope")


def test_assemble_and_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "k int, `0` double, `1` double")
    with pytest.raises(Exception):
        ft.assemble_features(df, ["0", "1"]).collect()
    assert [r["k"] for r in ft.assemble_features(df, ["0", "1"], handle_invalid="skip").collect()] == [2]
    kept = ft.assemble_features(df, ["0", "1"], handle_invalid="keep").orderBy("k")
    nan = kept.select(F.isnan(vector_to_array("features")[1])).collect()
    assert [r[0] for r in nan] == [True, False]


def test_encode_label_is_alphabetical(spark):
    df = spark.createDataFrame([("R",), ("A",), ("R",), ("N",)], "v string")
    out, model = ft.encode_label(df, "v")
    assert list(model.labels) == ["A", "N", "R"]
    assert rows_of(out.distinct()) == [("A", 0.0), ("N", 1.0), ("R", 2.0)]


def test_impute_mean_of_present_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (float("nan"),)], "`0` double")
    assert sorted(r[0] for r in ft.impute_mean(df, ["0"]).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_first_row_and_arity(spark):
    df = spark.createDataFrame([(i, [0.0] * 3) for i in (5, 2, 9)], "k int, a array<double>")
    assert ft.first_row(df, ["k"]).collect()[0]["k"] == 2
    from fityard.functions.vectors import as_vector
    assert rows_of(ft.output_arity(df.select(as_vector("a").alias("v")), "v")) == [(3, 3, 3)]


def test_positional_split(spark):
    df = spark.range(100).withColumnRenamed("id", "row_idx")
    got = sp.positional_split(df, 10, 3, 2).groupBy("split").agg(F.min("row_idx"), F.max("row_idx"))
    assert rows_of(got) == [("test", 30, 49), ("train", 0, 29)]


@pytest.mark.parametrize("rows", [0, 1, 30])
def test_too_short_for_both_sides(spark, rows):
    with pytest.raises(ValueError):
        sp.positional_split(spark.range(rows).withColumnRenamed("id", "row_idx"), 10, 3, 2)


def test_fraction():
    assert sp.train_fraction(7, 3) == 0.7
    for bad in ((0, 0), (-1, 2)):
        with pytest.raises(ValueError):
            sp.train_fraction(*bad)


@pytest.mark.parametrize("partitions", [1, 4, 7])
def test_hash_split_is_stable_and_fair(spark, partitions):
    df = spark.range(20000).repartition(partitions)
    split = sp.train_val_split(sp.hash_split(df, "id", 0.7), "id", 0.8)
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert abs(n["train"] / 20000 - 0.56) < 0.01 and abs(n["val"] / 20000 - 0.14) < 0.01
    ids = split.filter("split = 'val'").agg(F.sum("id")).first()[0]
    again = sp.train_val_split(sp.hash_split(spark.range(20000), "id", 0.7), "id", 0.8)
    assert ids == again.filter("split = 'val'").agg(F.sum("id")).first()[0]


def test_random_split_repeats_with_its_seed_and_merges_back(spark):
    df = spark.range(5000)
    train, test = sp.random_split(df, 0.7, seed=5)
    assert train.count() == sp.random_split(df, 0.7, seed=5)[0].count()
    assert abs(train.count() / 5000 - 0.7) < 0.05
    assert rows_of(sp.merge_train_test(train, test)) == rows_of(df)
    assert sp.merge_train_test(df, df).count() == 10000
