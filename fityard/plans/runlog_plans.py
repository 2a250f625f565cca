"""Run-log analytics and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from fityard.operators import comparison as cmp
from fityard.operators import runlog as rl
from fityard.plans.fixtures import EV_SQL, LOG_SQL, PAIR_SQL, SPAN_SQL, once, run_log
from fityard.plans.registry import query
from fityard.runtime import written


@query("event_durations", f"with {EV_SQL} select run_id, pos, event, cast(dur as bigint) as dur_us from ev")
def _durations(spark, sf_dir):
    return rl.event_durations(run_log(spark, sf_dir)).select("run_id", "pos", "event", "dur_us")


@query("run_config", f"with {LOG_SQL} select run_id, " + ", ".join(
    f"max(value) filter (where pos = {i}) as {name}" for i, name in enumerate(rl.HEADER))
    + " from lg where pos < 6 group by 1")
def _config(spark, sf_dir):
    return rl.run_config(run_log(spark, sf_dir))


# Every seventh run gets a library name that no profile knows.
@query("validate_library", f"""with {LOG_SQL}, hd as (
  select run_id, case when run_id % 7 = 0 then 'lib_x' else library end as library from lg where pos = 0)
select run_id, library, library in ('lib_a', 'lib_b') as known from hd""")
def _validate(spark, sf_dir):
    heads = run_log(spark, sf_dir).withColumn(
        "value", F.when(F.col("run_id") % 7 == 0, "lib_x").otherwise(F.col("library")))
    known, rejected = rl.validate_library(rl.run_library(heads))
    return known.select("run_id", "library", F.lit(True).alias("known")).unionByName(
        rejected.select("run_id", "library", F.lit(False).alias("known")))


def _setup_sql(name: str) -> str:
    return EV_SQL + f""", setup as (
  select run_id, library, {name} as event, cast(arg_max(dur, pos) as bigint) as setup_us from ev
  where (library = 'lib_a' and pos between 8 and 10) or (library = 'lib_b' and pos between 8 and 11)
  group by 1, 2, 3)"""


@query("setup_times", f"with {_setup_sql('event')} select * from setup")
def _setup(spark, sf_dir):
    return rl.setup_times(run_log(spark, sf_dir))


@query("run_models", f"with {LOG_SQL} select run_id, pos, value as model from lg where event = 'Training'")
def _models(spark, sf_dir):
    return rl.run_models(run_log(spark, sf_dir))


@query("model_span", f"""with {SPAN_SQL}
select run_id, library, model, st as start, en as "end" from spans""")
def _span(spark, sf_dir):
    return rl.model_span(run_log(spark, sf_dir))


@query("training_time", f"with {SPAN_SQL} select run_id, library, model, train_us from spans")
def _training(spark, sf_dir):
    return rl.training_time(run_log(spark, sf_dir))


@query("testing_time", f"with {SPAN_SQL} select run_id, library, model, test_us from spans")
def _testing(spark, sf_dir):
    return rl.testing_time(run_log(spark, sf_dir))


@query("span_accuracy", f"with {SPAN_SQL} select run_id, library, model, train_acc, test_acc from spans")
def _span_accuracy(spark, sf_dir):
    return rl.span_accuracy(run_log(spark, sf_dir))


SUMMARY_SQL = SPAN_SQL + """, setup as (
  select run_id, event, arg_max(dur, pos) as setup_us from ev
  where (library = 'lib_a' and pos between 8 and 10) or (library = 'lib_b' and pos between 8 and 11)
  group by 1, 2), st as (
  select run_id, count(*) as setup_events, sum(setup_us) as setup_us from setup group by 1), sm as (
  select run_id, library, model, train_us, test_us, train_acc, test_acc,
         coalesce(setup_events, 0) as setup_events, cast(coalesce(setup_us, 0) as bigint) as setup_us
  from spans left join st using (run_id))"""


@query("run_summary", f"with {SUMMARY_SQL} select * from sm")
def _summary(spark, sf_dir):
    return rl.run_summary(run_log(spark, sf_dir))


# --- comparisons ---------------------------------------------------------------------------------

def _runs(spark, sf_dir):
    first = run_log(spark, sf_dir).filter("pos = 0")
    return first.select("run_id", "library")


def _pairs(spark, sf_dir):
    return cmp.pair_runs(_runs(spark, sf_dir))


def _members(spark, sf_dir):
    """Pairs are made and written once for all comparisons."""
    return once(spark, "pair_members", sf_dir,
                lambda: written(cmp.pair_members(_pairs(spark, sf_dir)), "pair-members"))


def _dimensions(members):
    """Training rows of the i-th pair: 36,000 more than those of the pair before."""
    return members.select("run_id", ((F.col("pair_idx") + 1) * 36000).alias("dimension"))


@query("pair_runs", f"with {LOG_SQL}{PAIR_SQL} select * from pairs")
def _pair_runs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("check_model_parity", f"""with {LOG_SQL}{PAIR_SQL}, tr as (
  select m.pair_idx, m.library, lg.value as model, count(*) as n
  from members m join lg on lg.run_id = m.run_id and lg.event = 'Training' group by 1, 2, 3), sd as (
  select pair_idx, model, coalesce(sum(n) filter (where library = 'lib_a'), 0) as a,
         coalesce(sum(n) filter (where library = 'lib_b'), 0) as b from tr group by 1, 2)
select p.pair_idx, p.run_a, p.run_b, cast(coalesce(sum(a), 0) as bigint) as models_a,
       cast(coalesce(sum(b), 0) as bigint) as models_b, coalesce(sum(a), 0) = coalesce(sum(b), 0) as same_count,
       count(*) filter (where (a = 0) <> (b = 0)) as one_sided_models
from pairs p left join sd using (pair_idx) group by 1, 2, 3""")
def _parity(spark, sf_dir):
    return cmp.check_model_parity(rl.run_models(run_log(spark, sf_dir)), _pairs(spark, sf_dir))


COMPARED_SETUP_SQL = _setup_sql("concat(event, '_', pos)") + PAIR_SQL + """, a as (
  select m.pair_idx, s.event, s.setup_us from members m join setup s using (run_id)
  where m.library = 'lib_a'), b as (
  select m.pair_idx, s.event, s.setup_us from members m join setup s using (run_id)
  where m.library = 'lib_b'), cmp as (
  select pair_idx, event, a.setup_us is not null and b.setup_us is not null as both_present,
         coalesce(a.setup_us, 0) as a_us, coalesce(b.setup_us, 0) as b_us
  from a full join b using (pair_idx, event)), od as (
  select *, cast(row_number() over (partition by pair_idx order by both_present desc, event) - 1
                 as integer) as ord from cmp)"""


def _compared_setup(spark, sf_dir):
    named = run_log(spark, sf_dir).withColumn("event", F.concat_ws("_", "event", F.col("pos").cast("string")))
    return cmp.setup_comparison(rl.setup_times(named), _members(spark, sf_dir))


@query("setup_comparison", f"with {COMPARED_SETUP_SQL} select * from od")
def _setup_comparison(spark, sf_dir):
    return _compared_setup(spark, sf_dir)


@query("setup_stack", f"""with {COMPARED_SETUP_SQL}
select *, cast(coalesce(sum(a_us) over w, 0) as bigint) as a_base_us,
       cast(coalesce(sum(b_us) over w, 0) as bigint) as b_base_us
from od window w as (partition by pair_idx order by ord rows between unbounded preceding and 1 preceding)""")
def _stack(spark, sf_dir):
    return cmp.setup_stack(_compared_setup(spark, sf_dir))


@query("setup_by_dimension", f"""with {COMPARED_SETUP_SQL}, rows as (
  select (m.pair_idx + 1) * 36000 as dimension, m.library, s.event, s.setup_us from members m join setup s using (run_id)), names as (
  select event, bool_or(library = 'lib_a') and bool_or(library = 'lib_b') as both_present from rows group by 1), bars as (
  select dimension, event, both_present, coalesce(avg(setup_us) filter (where library = 'lib_a') / 1e6, 0) as a_s,
         coalesce(avg(setup_us) filter (where library = 'lib_b') / 1e6, 0) as b_s
  from rows join names using (event) group by 1, 2, 3)
select dimension, event, both_present, round(a_s, 6) as a_s, round(b_s, 6) as b_s,
       cast(row_number() over o - 1 as integer) as ord, round(coalesce(sum(a_s) over w, 0), 6) as a_base_s,
       round(coalesce(sum(b_s) over w, 0), 6) as b_base_s
from bars window o as (partition by dimension order by both_present desc, event),
  w as (partition by dimension order by both_present desc, event rows between unbounded preceding and 1 preceding)""")
def _setup_dimension(spark, sf_dir):
    named = run_log(spark, sf_dir).withColumn("event", F.concat_ws("_", "event", F.col("pos").cast("string")))
    members = _members(spark, sf_dir)
    bars = cmp.setup_by_dimension(rl.setup_times(named), members, _dimensions(members))
    return bars.withColumns({c: F.round(c, 6) for c in ("a_s", "b_s", "a_base_s", "b_base_s")})


SIDES_SQL = SPAN_SQL + PAIR_SQL + """, sides as (
  select p.pair_idx, a.model, a.train_us as train_us_a, b.train_us as train_us_b,
         a.test_us as test_us_a, b.test_us as test_us_b, a.train_acc as train_acc_a,
         b.train_acc as train_acc_b, a.test_acc as test_acc_a, b.test_acc as test_acc_b
  from pairs p join spans a on a.run_id = p.run_a
               join spans b on b.run_id = p.run_b and b.model = a.model)"""


@query("model_time_comparison", f"""with {SIDES_SQL}
select pair_idx, model, train_us_a, train_us_b, test_us_a, test_us_b from sides""")
def _times(spark, sf_dir):
    return cmp.model_time_comparison(rl.model_summary(run_log(spark, sf_dir)), _members(spark, sf_dir))


@query("model_accuracy_comparison", f"""with {SIDES_SQL}
select pair_idx, model, train_acc_a, train_acc_b, test_acc_a, test_acc_b from sides
where train_acc_a * train_acc_b * test_acc_a * test_acc_b <> 1.0""")
def _accuracies(spark, sf_dir):
    return cmp.model_accuracy_comparison(rl.model_summary(run_log(spark, sf_dir)), _members(spark, sf_dir))


LONG_SQL = SUMMARY_SQL + PAIR_SQL + """, lm as (
  select run_id, library, model, 'Runtime(Sec)' as result_type, 'setup_us' as metric,
         setup_us / 1e6 as value from sm
  union all select run_id, library, model, 'Runtime(Sec)', 'train_us',
         case when train_us < 0 then -1 else train_us / 1e6 end from sm
  union all select run_id, library, model, 'Runtime(Sec)', 'test_us',
         case when test_us < 0 then -1 else test_us / 1e6 end from sm
  union all select run_id, library, model, 'Accuracy', 'train_acc', train_acc from sm
  union all select run_id, library, model, 'Accuracy', 'test_acc', test_acc from sm)"""


def _long(spark, sf_dir):
    return cmp.long_metrics(rl.run_summary(run_log(spark, sf_dir)))


@query("select_metric", f"""with {LONG_SQL}
select run_id, library, model, result_type, metric, value from lm where result_type = 'Runtime(Sec)'""")
def _metric(spark, sf_dir):
    return cmp.select_metric(_long(spark, sf_dir), "Runtime(Sec)")


@query("dimension_comparison", f"""with {LONG_SQL}
select model, result_type, metric, (pair_idx + 1) * 36000 as dimension,
       coalesce(avg(value) filter (where lm.library = 'lib_a' and value >= 0),
                max(-1.0::double) filter (where lm.library = 'lib_a' and value < 0)) as value_a,
       coalesce(avg(value) filter (where lm.library = 'lib_b' and value >= 0),
                max(-1.0::double) filter (where lm.library = 'lib_b' and value < 0)) as value_b,
       count(*) filter (where lm.library = 'lib_a' and value < 0) as failures_a,
       count(*) filter (where lm.library = 'lib_b' and value < 0) as failures_b
from lm join members using (run_id) group by 1, 2, 3, 4""")
def _dimension(spark, sf_dir):
    members = _members(spark, sf_dir)
    return cmp.dimension_comparison(_long(spark, sf_dir), _dimensions(members))


@query("interleaved_series", f"""with {LOG_SQL}{PAIR_SQL}
select row_number() over (order by pair_idx, library) - 1 as series_pos,
       concat((pair_idx + 1) * 36000, case when library = 'lib_a' then '_A' else '_B' end) as label, run_id
from members""")
def _series(spark, sf_dir):
    members = _members(spark, sf_dir)
    return cmp.interleaved_series(members, _dimensions(members), {"lib_a": "A", "lib_b": "B"})


@query("check_dimension_arity", f"""with {LOG_SQL}{PAIR_SQL}, c as (
  select count(*) filter (where library = 'lib_a') as logs_a,
         count(*) filter (where library = 'lib_b') as logs_b,
         (select count(*) from pairs) as n_dimensions from placed)
select *, logs_a = logs_b and logs_a = n_dimensions as ok from c""")
def _arity(spark, sf_dir):
    return cmp.check_dimension_arity(_runs(spark, sf_dir), _pairs(spark, sf_dir))
