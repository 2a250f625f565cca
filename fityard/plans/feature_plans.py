"""Projections, types, features and splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fityard.operators import features as ft
from fityard.operators import splits as sp
from fityard.operators.linear import score_weights
from fityard.operators.pca import fit_pca
from fityard.plans.fixtures import (
    FILE_SPEC, INDEXED_SQL, KEYS_SQL, N_TEST, N_TRAIN, SPLIT_SQL, SUSY_FEATURES, SUSY_KEYS,
    SUSY_SQL, TRAIN_FRACTION, VAL_HASH_SQL, chunk_rows, emb, susy, susy_files, susy_indexed,
    susy_split, table)
from fityard.plans.registry import query
from fityard.sources.feature_csv import scan_feature_csv

FEATURES_SQL = ", ".join(f'"{f}"' for f in SUSY_FEATURES)
QUOTED = [f"`{f}`" for f in SUSY_FEATURES]

# Weights of a fixed linear score over features 0, 1 and 2.
WEIGHTS, INTERCEPT = (6.5, 0.25, -3.5), -3.6
SCORED_SQL = SPLIT_SQL + f""", sc as (
  select *, {INTERCEPT} + {WEIGHTS[0]} * "0" + {WEIGHTS[1]} * "1" + {WEIGHTS[2]} * "2" as margin
  from sp), scored as (
  select *, 1 / (1 + exp(-margin)) as probability,
         case when margin > 0 then 1.0 else 0.0 end::double as prediction, target as label
  from sc)"""


def scored(spark, sf_dir):
    """All rows with split, margin, probability and prediction of the fixed score."""
    rows = ft.rename_label(susy_split(spark, sf_dir))
    return score_weights(rows, SUSY_FEATURES[:3], WEIGHTS, INTERCEPT)


@query("name_columns", f"""with {SUSY_SQL}
select target, "0", "1", "2", "3", cast(l_orderkey as double) as "4",
       cast(l_linenumber as double) as "5", cast(l_partkey as double) as "6",
       cast(l_suppkey as double) as "7", l_extendedprice as "8" from susy""")
def _names(spark, sf_dir):
    unnamed = scan_feature_csv(spark, susy_files(spark, sf_dir), FILE_SPEC)
    unnamed = unnamed.toDF(*[f"_c{i}" for i in range(len(unnamed.columns))])
    return ft.name_columns(unnamed, FILE_SPEC)


@query("rename_label", f"with {SUSY_SQL} select {KEYS_SQL}, target as label from susy")
def _rename(spark, sf_dir):
    return ft.rename_label(susy(spark, sf_dir)).select(*SUSY_KEYS, "label")


@query("drop_target", f"with {SUSY_SQL} select {FEATURES_SQL} from susy")
def _drop(spark, sf_dir):
    return ft.drop_target(susy(spark, sf_dir).select("target", *QUOTED))


@query("assemble_features", f"""with {SUSY_SQL}
select {KEYS_SQL}, "0" as f0, "1" as f1, "2" as f2, "3" as f3, cast(4 as integer) as width
from susy""")
def _assemble(spark, sf_dir):
    rows = ft.assemble_features(susy(spark, sf_dir), SUSY_FEATURES)
    array = vector_to_array("features")
    return rows.select(*SUSY_KEYS, *[array[i].alias(f"f{i}") for i in range(len(SUSY_FEATURES))],
                       F.size(array).alias("width"))


@query("select_label_features", f"""with {SUSY_SQL}
select target as label, "0" + "1" + "2" + "3" as feature_sum from susy""")
def _select(spark, sf_dir):
    rows = ft.assemble_features(ft.rename_label(susy(spark, sf_dir)), SUSY_FEATURES)
    array = vector_to_array("features")
    return ft.select_label_features(rows).select(
        "label", (array[0] + array[1] + array[2] + array[3]).alias("feature_sum"))


@query("encode_label", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag,
       cast(dense_rank() over (order by l_returnflag) - 1 as double) as label from lineitem""")
def _encode(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*SUSY_KEYS, "l_returnflag")
    return ft.encode_label(rows, "l_returnflag")[0]


@query("to_double_features", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       cast(l_linenumber as double) as d_linenumber, cast(l_suppkey as double) as d_suppkey,
       cast(l_quantity as double) as d_quantity from lineitem""")
def _doubles(spark, sf_dir):
    copies = {f"d_{c}": F.col(f"l_{c}") for c in ("linenumber", "suppkey", "quantity")}
    rows = table(spark, sf_dir, "lineitem").select(
        *SUSY_KEYS, *[c.alias(name) for name, c in copies.items()])
    return ft.to_double_features(rows, list(copies))


MISSING_SQL = SUSY_SQL + """, ms as (
  select * exclude ("2"), nullif("2", 0) as "2" from susy), im as (
  select * exclude ("2"), coalesce("2", avg("2") over ()) as "2" from ms)"""


def with_missing(spark, sf_dir):
    """``susy`` with the zeros of feature 2 turned into missing values."""
    return susy(spark, sf_dir).withColumn("2", F.nullif(F.col("`2`"), F.lit(0.0)))


@query("impute_mean", f"with {MISSING_SQL} select {KEYS_SQL}, round(\"2\", 9) as f2 from im")
def _impute(spark, sf_dir):
    return ft.impute_mean(with_missing(spark, sf_dir), ["2"]).select(
        *SUSY_KEYS, F.round("`2`", 9).alias("f2"))


@query("select_pred_label", f"with {SCORED_SQL} select prediction, label from scored")
def _pred_label(spark, sf_dir):
    return ft.select_pred_label(scored(spark, sf_dir))


@query("first_projected_row", f"""with {SUSY_SQL}
select {KEYS_SQL}, "0" as f0, "1" as f1, "2" as f2, "3" as f3 from susy
order by {KEYS_SQL} limit 1""")
def _first(spark, sf_dir):
    rows = susy(spark, sf_dir).select(
        *SUSY_KEYS, *[F.col(q).alias(f"f{i}") for i, q in enumerate(QUOTED)])
    return ft.first_row(rows, SUSY_KEYS)


@query("output_arity", """
select cast(10 as integer) as min_cols, cast(10 as integer) as n_cols, count(*) as n_rows
from embeddings""")
def _arity(spark, sf_dir):
    rows = emb(spark, sf_dir)
    return ft.output_arity(fit_pca(rows, 10).transform(rows), "pca_features")


# --- splits --------------------------------------------------------------------------------------

@query("positional_split", f"""with {INDEXED_SQL}
select {KEYS_SQL}, row_idx, case when row_idx < {N_TRAIN} * chunk_rows then 'train' else 'test' end as split
from ix where row_idx < {N_TRAIN + N_TEST} * chunk_rows""")
def _positional(spark, sf_dir):
    rows = susy_indexed(spark, sf_dir).select(*SUSY_KEYS, "row_idx")
    return sp.positional_split(rows, chunk_rows(spark, sf_dir), N_TRAIN, N_TEST)


@query("merge_train_test", f"with {SUSY_SQL} select {KEYS_SQL}, target from susy")
def _merge(spark, sf_dir):
    rows = susy_split(spark, sf_dir).select(*SUSY_KEYS, "target", "split")
    train, test = (rows.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    return sp.merge_train_test(train, test)


@query("train_fraction", f"""with {INDEXED_SQL}
select cast({N_TRAIN / (N_TRAIN + N_TEST)} as double) as planned,
       count(*) filter (where row_idx < {N_TRAIN} * chunk_rows) as train_rows, count(*) as n_rows,
       round(count(*) filter (where row_idx < {N_TRAIN} * chunk_rows) / count(*), 9) as found
from ix where row_idx < {N_TRAIN + N_TEST} * chunk_rows""")
def _fraction(spark, sf_dir):
    rows = sp.positional_split(susy_indexed(spark, sf_dir).select("row_idx"),
                               chunk_rows(spark, sf_dir), N_TRAIN, N_TEST)
    train = F.count_if(F.col("split") == "train")
    return rows.agg(F.lit(sp.train_fraction(N_TRAIN, N_TEST)).alias("planned"),
                    train.alias("train_rows"), F.count("*").alias("n_rows"),
                    F.round(train / F.count("*"), 9).alias("found"))


# The sides themselves depend on the random numbers of the engine; that they part the rows does not.
@query("random_split", f"""with {SUSY_SQL}
select count(*) as n_rows, cast(sum(target) as bigint) as positives,
       cast(sum(split_key) % 1000000007 as bigint) as key_sum, true as both_sides_filled, true as fraction_kept
from susy""")
def _random(spark, sf_dir):
    train, test = sp.random_split(susy(spark, sf_dir), TRAIN_FRACTION, seed=123)
    merged = sp.merge_train_test(train.withColumn("split", F.lit("train")),
                                 test.withColumn("split", F.lit("test")))
    share = F.avg((F.col("split") == "train").cast("double"))
    return merged.agg(
        F.count("*").alias("n_rows"), F.sum("target").cast("bigint").alias("positives"),
        (F.sum("split_key") % 1000000007).alias("key_sum"),
        (F.count_distinct("split") == 2).alias("both_sides_filled"),
        (F.abs(share - TRAIN_FRACTION) < 0.03).alias("fraction_kept"))


@query("hash_split", f"with {SPLIT_SQL} select {KEYS_SQL}, split from sp")
def _hash(spark, sf_dir):
    return susy_split(spark, sf_dir).select(*SUSY_KEYS, "split")


@query("train_val_split", f"""with {INDEXED_SQL}
select {KEYS_SQL}, case when row_idx >= {N_TRAIN} * chunk_rows then 'test'
                        when {VAL_HASH_SQL} >= 0.8 then 'val' else 'train' end as split
from ix where row_idx < {N_TRAIN + N_TEST} * chunk_rows""")
def _validation(spark, sf_dir):
    rows = sp.positional_split(susy_indexed(spark, sf_dir).select(*SUSY_KEYS, "split_key", "row_idx"),
                               chunk_rows(spark, sf_dir), N_TRAIN, N_TEST)
    return sp.train_val_split(rows, "split_key", 0.8).select(*SUSY_KEYS, "split")
