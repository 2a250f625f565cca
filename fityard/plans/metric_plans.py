"""Metrics on a fixed score, on a fitted model and on fixed clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fityard.operators import evaluation as ev
from fityard.operators import features as ft
from fityard.operators.linear import score_weights
from fityard.plans.feature_plans import SCORED_SQL, scored
from fityard.plans.fixtures import SUSY_FEATURES
from fityard.plans.model_plans import CLUSTERED_SQL, MARGIN_SQL, NEWTON_SQL, clustered, logreg_all
from fityard.plans.registry import query


def _test_side(spark, sf_dir):
    return scored(spark, sf_dir).filter("split = 'test'")


def _rounded(df, digits=9, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("accuracy", f"""with {SCORED_SQL}
select count(*) as n, round(avg(case when prediction = label then 1.0 else 0.0 end), 9) as accuracy
from scored where split = 'test'""")
def _accuracy(spark, sf_dir):
    return _rounded(ev.accuracy(_test_side(spark, sf_dir)), 9, "accuracy")


@query("hit_rate", f"""with {SCORED_SQL}
select count(*) filter (where prediction = label) as hits, count(*) as n,
       round(count(*) filter (where prediction = label) / count(*), 9) as hit_rate
from scored where split = 'test'""")
def _hit_rate(spark, sf_dir):
    return _rounded(ev.hit_rate(_test_side(spark, sf_dir)), 9, "hit_rate")


@query("confusion_matrix", f"""with {SCORED_SQL}
select label, prediction, count(*) as n from scored where split = 'test' group by 1, 2""")
def _confusion(spark, sf_dir):
    return ev.confusion_matrix(_test_side(spark, sf_dir))


def _auc_sql(side: str) -> str:
    """Rank formula with mid-ranks over the margins of the exact fit; rows that are alike up to rounding count as tied."""
    return f"""with {NEWTON_SQL}, m as (
  select target, round({MARGIN_SQL}, 9) as margin from sp, nw where split = '{side}'), r as (
  select target, rank() over (order by margin) + (count(*) over (partition by margin) - 1) / 2.0 as rnk from m), t as (
  select sum(rnk) filter (where target = 1) as s, count(*) filter (where target = 1) as p,
         count(*) filter (where target = 0) as q from r)
select round((s - p * (p + 1) / 2.0) / (cast(p as double) * q), 6) as auc from t"""


def _model_auc(side):
    def run(spark, sf_dir):
        fit, train, test = logreg_all(spark, sf_dir)
        rows = score_weights(train if side == "train" else test, SUSY_FEATURES, fit.coefficients, fit.intercept)
        return _rounded(ev.auc(rows.withColumn("margin", F.round("margin", 9))), 6, "auc")
    return run


query("auc_train", _auc_sql("train"))(_model_auc("train"))
query("auc_test", _auc_sql("test"))(_model_auc("test"))

CURVE_SQL = SCORED_SQL + """, s as (
  select margin, count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as q
  from scored where split = 'test' group by 1), c as (
  select margin, sum(p) over (order by margin desc) as cp, sum(q) over (order by margin desc) as cq,
         sum(p) over () as ap, sum(q) over () as aq from s)"""


@query("roc_curve", f"""with {CURVE_SQL}
select round(margin, 9) as threshold, round(cq / aq, 9) as fpr, round(cp / ap, 9) as tpr from c""")
def _roc(spark, sf_dir):
    return _rounded(ev.roc_curve(_test_side(spark, sf_dir)), 9, "threshold", "fpr", "tpr")


@query("best_threshold_accuracy", f"""with {CURVE_SQL}, a as (
  select margin, cp + aq - cq as hits, ap + aq as n from c)
select round(arg_min(margin, margin) filter (where hits = top), 9) as threshold,
       round(any_value(top / n), 9) as accuracy
from (select *, max(hits) over () as top from a)""")
def _best(spark, sf_dir):
    return _rounded(ev.best_threshold_accuracy(_test_side(spark, sf_dir)), 9, "threshold", "accuracy")


@query("model_performance", f"""with {SCORED_SQL}, t as (
  select *, least(greatest(probability, 1e-15), 1 - 1e-15) as pr from scored where split = 'test'), rk as (
  select label, rank() over (order by margin) + (count(*) over (partition by margin) - 1) / 2.0 as rnk
  from t), ar as (
  select sum(rnk) filter (where label = 1) as s, count(*) filter (where label = 1) as p,
         count(*) filter (where label = 0) as q from rk)
select count(*) as n, round(avg(case when prediction = label then 1.0 else 0.0 end), 9) as accuracy,
       round(-avg(label * ln(pr) + (1 - label) * ln(1 - pr)), 9) as log_loss,
       round(sqrt(avg((label - probability) * (label - probability))), 9) as rmse,
       (select round((s - p * (p + 1) / 2.0) / (cast(p as double) * q), 9) from ar) as auc
from t""")
def _performance(spark, sf_dir):
    return _rounded(ev.model_performance(_test_side(spark, sf_dir)), 9,
                    "accuracy", "log_loss", "rmse", "auc")


SECOND_WEIGHTS, SECOND_INTERCEPT = (8.0, 0.0, -8.0), -4.0


@query("model_comparison", f"""with {SCORED_SQL}, two as (
  select *, case when {SECOND_INTERCEPT} + {SECOND_WEIGHTS[0]} * "0" + {SECOND_WEIGHTS[1]} * "1"
                      + {SECOND_WEIGHTS[2]} * "2" > 0 then 1.0 else 0.0 end as second
  from scored where split = 'test')
select count(*) as n, round(avg(case when prediction = label then 1.0 else 0.0 end), 9) as first_accuracy,
       round(avg(case when second = label then 1.0 else 0.0 end), 9) as second_accuracy from two""")
def _comparison(spark, sf_dir):
    first = _test_side(spark, sf_dir).withColumnRenamed("prediction", "first")
    both = score_weights(first, SUSY_FEATURES[:3], SECOND_WEIGHTS, SECOND_INTERCEPT)
    result = ev.model_comparison(both, {"first": "first", "second": "prediction"})
    return _rounded(result, 9, "first_accuracy", "second_accuracy")


# --- clusters ------------------------------------------------------------------------------------

_SQUARE = " + ".join(f'"{f}" * "{f}"' for f in SUSY_FEATURES)
_CROSS = " + ".join(f'"{f}" * s{i}' for i, f in enumerate(SUSY_FEATURES))
_SUMS = ", ".join(f'sum("{f}") as s{i}' for i, f in enumerate(SUSY_FEATURES))


@query("silhouette", f"""with {CLUSTERED_SQL}, st as (
  select prediction as k, count(*) as n, {_SUMS}, sum({_SQUARE}) as ss from cl group by 1), dist as (
  select cl.l_orderkey, cl.l_linenumber, cl.l_partkey, cl.l_suppkey, cl.l_extendedprice,
         max(case when st.k = prediction then (n * ({_SQUARE}) - 2 * ({_CROSS}) + ss) / (n - 1) end) as a,
         min(case when st.k <> prediction then (n * ({_SQUARE}) - 2 * ({_CROSS}) + ss) / n end) as b
  from cl, st group by all)
select round(avg((b - a) / greatest(a, b)), 6) as silhouette from dist""")
def _silhouette(spark, sf_dir):
    rows = ft.assemble_features(clustered(spark, sf_dir).select(
        *[F.col(f"`{f}`") for f in SUSY_FEATURES], "prediction"), SUSY_FEATURES)
    return _rounded(ev.silhouette(rows), 6, "silhouette")


@query("cluster_label_agreement", f"""with {CLUSTERED_SQL}
select count(*) as n, round(avg(case when prediction = label then 1.0 else 0.0 end), 9) as agreement,
       round(greatest(avg(case when prediction = label then 1.0 else 0.0 end),
                      avg(case when 1 - prediction = label then 1.0 else 0.0 end)), 9) as best_agreement
from cl where split = 'test'""")
def _agreement(spark, sf_dir):
    test = clustered(spark, sf_dir).filter("split = 'test'")
    return _rounded(ev.cluster_label_agreement(test), 9, "agreement", "best_agreement")


@query("cluster_label_crosstab", f"""with {CLUSTERED_SQL}
select label, count(*) filter (where prediction = 0) as cluster_0,
       count(*) filter (where prediction = 1) as cluster_1
from cl where split = 'test' group by 1""")
def _crosstab(spark, sf_dir):
    return ev.cluster_label_crosstab(clustered(spark, sf_dir).filter("split = 'test'"), [0, 1])
