"""Sources, sinks and experiment grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from fityard.operators import design
from fityard.operators.runlog import event_durations
from fityard.plans.fixtures import (
    EMB_WIDTH, EV_SQL, FILE_COLUMNS, FILE_SPEC, INDEXED_SQL, LOG_SQL, N_TEST, N_TRAIN, SUSY_FEATURES,
    SUSY_KEYS, SUSY_SQL, chunk_rows, file_rows, once, run_log, susy_files, susy_prefix, table)
from fityard.plans.registry import query
from fityard.runtime import new_table_path, spread
from fityard.sources import (
    batch_featurize, byte_histogram, chunk_table, export_feature_csv, label_from_filename,
    read_run_files, read_run_logs, scan_feature_csv, write_run_files, write_run_logs)
from fityard.spec import DatasetSpec

ROW_SQL = ", ".join([*SUSY_KEYS, "target", *[f'"{f}"' for f in SUSY_FEATURES]])


@query("scan_feature_csv", f"with {SUSY_SQL} select {ROW_SQL} from susy")
def _scan(spark, sf_dir):
    return file_rows(scan_feature_csv(spark, susy_files(spark, sf_dir), FILE_SPEC))


@query("read_prefix_chunks", f"""with {INDEXED_SQL}
select {ROW_SQL}, row_idx from ix where row_idx < {N_TRAIN + N_TEST} * chunk_rows""")
def _prefix(spark, sf_dir):
    return susy_prefix(spark, sf_dir)


@query("chunk_table", f"""with {INDEXED_SQL}, ch as (
  select *, row_idx // chunk_rows as chunk_id from ix
  where row_idx < {N_TRAIN + N_TEST} * chunk_rows)
select case when chunk_id < {N_TRAIN} then 'train' else 'test' end as split, chunk_id,
       case when chunk_id < {N_TRAIN} then chunk_id else chunk_id - {N_TRAIN} end as chunk_pos,
       count(*) as n, cast(sum(target) as bigint) as positives,
       round(sum("0"), 8) as sum_0, round(sum("2"), 8) as sum_2,
       min(row_idx) as first_row, max(row_idx) as last_row
from ch group by 1, 2, 3""")
def _chunks(spark, sf_dir):
    chunks = chunk_table(susy_prefix(spark, sf_dir), chunk_rows(spark, sf_dir), N_TRAIN)
    return chunks.groupBy("split", "chunk_id", "chunk_pos").agg(
        F.count("*").alias("n"), F.sum("target").cast("bigint").alias("positives"),
        F.round(F.sum("`0`"), 8).alias("sum_0"), F.round(F.sum("`2`"), 8).alias("sum_2"),
        F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"))


@query("label_from_filename", """
select page_id, split_part(regexp_extract(url, '([^/]+)$', 1), '.', 1) as label from pages""")
def _label(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", label_from_filename("url").alias("label"))


# Bytes reported by name; an ASCII byte never occurs inside a longer UTF-8 sequence.
NAMED_BYTES = {"a": "a", "e": "e", "i": "i", "o": "o", "u": "u", "t": "t", "n": "n", "s": "s",
               "zero": "0", "one": "1", "space": " ", "dot": ".", "comma": ",", "at": "@"}


@query("batch_featurize", "select doc_id, octet_length(encode(text)) as n_bytes, " + ", ".join(
    f"length(text) - length(replace(text, '{c}', '')) as n_{name}"
    for name, c in NAMED_BYTES.items()) + """,
  octet_length(encode(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'))) as n_non_ascii
from documents""")
def _featurize(spark, sf_dir):
    items = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.encode("text", "UTF-8").alias("content"))
    hist = batch_featurize(items, byte_histogram("doc_id", "content"),
                           "doc_id bigint, features array<bigint>")

    def total(array):
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    return hist.select(
        "doc_id", total(F.col("features")).alias("n_bytes"),
        *[F.col("features")[ord(c)].alias(f"n_{name}") for name, c in NAMED_BYTES.items()],
        total(F.slice("features", 129, 128)).alias("n_non_ascii"))


@query("export_feature_csv", "select cast(label as double) as label, " + ", ".join(
    f"cast(embedding[{i + 1}] as double) as f{i}" for i in range(EMB_WIDTH)) + " from embeddings")
def _export(spark, sf_dir):
    path = new_table_path(spark, "export")
    rows = table(spark, sf_dir, "embeddings").select(
        "label", F.col("embedding").cast("array<double>").alias("features"))
    export_feature_csv(rows, path, "label", "features", EMB_WIDTH)
    back = scan_feature_csv(spark, path, DatasetSpec("export", EMB_WIDTH))
    return back.toDF("label", *[f"f{i}" for i in range(EMB_WIDTH)])


# Bulk layout: any number of runs per file.

def _new_log_files(spark, sf_dir) -> str:
    path = new_table_path(spark, "run-logs")
    write_run_logs(run_log(spark, sf_dir).withColumn(
        "start_time_epoch", F.col("epoch_us") / 1e6), path)
    return path


def _log_files(spark, sf_dir) -> str:
    return once(spark, "log_files", sf_dir, lambda: _new_log_files(spark, sf_dir))


@query("read_run_log_bulk", f"""with {LOG_SQL}
select run_id, pos, event, value, epoch_us from lg""")
def _read_bulk(spark, sf_dir):
    return read_run_logs(spark, _log_files(spark, sf_dir), "bigint").select(
        "run_id", "pos", "event", "value",
        F.round(F.col("start_time_epoch") * 1e6).cast("bigint").alias("epoch_us"))


@query("write_run_log_bulk", f"""with {LOG_SQL}
select run_id, count(*) as n_events, arg_min(event, pos) as first_event,
       arg_max(event, pos) as last_event, count(*) filter (where event = 'Training') as trainings
from lg group by 1""")
def _write_bulk(spark, sf_dir):
    lines = spark.read.schema("run_id bigint, segment bigint, events array<struct<event:string>>").json(
        _new_log_files(spark, sf_dir))
    names = F.col("events.event")
    return lines.groupBy("run_id").agg(
        F.sum(F.size(names)).alias("n_events"),
        F.min_by(F.element_at(names, 1), "segment").alias("first_event"),
        F.max_by(F.element_at(names, -1), "segment").alias("last_event"),
        F.sum(F.size(F.filter(names, lambda e: e == "Training"))).alias("trainings"))


# One file per run. The runs of each library lie in a folder of their own, under the same names: half the run's id.

def _run_records(spark, sf_dir):
    """The five fields of every logged event; times as the run itself writes them."""
    seconds = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, epoch_us div 1000000)")
    return event_durations(run_log(spark, sf_dir)).select(
        "run_id", "pos", "library", "event", "value", (F.col("dur_us") / F.lit(1e6)).alias("execution_time"),
        seconds.cast("string").alias("start_time"), (F.col("epoch_us") / F.lit(1e6)).alias("start_time_epoch"))


def _new_run_files(spark, sf_dir) -> list[str]:
    root = new_table_path(spark, "run-files")
    records = _run_records(spark, sf_dir).withColumn("run_id", F.expr("run_id div 2"))
    for library in ("lib_a", "lib_b"):
        write_run_files(records.filter(F.col("library") == library).drop("library"), f"{root}/{library}")
    return [f"{root}/{library}" for library in ("lib_a", "lib_b")]


def _run_files(spark, sf_dir) -> list[str]:
    return once(spark, "run_files", sf_dir, lambda: _new_run_files(spark, sf_dir))


# A run's id again, from the folder of its library and its name there.
RUN_OF_PATH = "cast(split_part(run_id, '/', 2) as bigint) * 2 + if(run_id like 'lib_b/%', 1, 0)"
RECORD_SQL = EV_SQL + """, rec as (
  select run_id, pos, event, v as value, round(dur / 1e6, 6) as execution_time,
         strftime(make_timestamp(epoch_us), '%Y-%m-%d %H:%M:%S') as start_time, epoch_us from ev)"""


@query("read_run_log", f"with {RECORD_SQL} select * from rec")
def _read_log(spark, sf_dir):
    return read_run_files(spark, _run_files(spark, sf_dir)).select(
        F.expr(RUN_OF_PATH).alias("run_id"), "pos", "event", "value", F.round("execution_time", 6).alias("execution_time"),
        "start_time", F.round(F.col("start_time_epoch") * 1e6).cast("bigint").alias("epoch_us"))


@query("write_run_log", f"""with {RECORD_SQL}
select run_id, count(*) as n_events, cast(1 as bigint) as n_files,
       count(*) filter (where event = 'Result' and value in ('true', 'false')) as bare_results,
       cast(sum(length(event)) as bigint) as event_chars, cast(sum(length(value)) as bigint) as value_chars,
       min(start_time) as first_start, round(sum(execution_time), 3) as seconds
from rec group by 1""")
def _write_log(spark, sf_dir):
    # The files as any JSON reader sees them, a whole array each.
    files = spark.read.option("recursiveFileLookup", True).text(_new_run_files(spark, sf_dir), wholetext=True)
    array = F.from_json("value", "array<map<string,string>>", {"mode": "FAILFAST"})
    rows = files.select(
        F.concat(F.regexp_extract("_metadata.file_path", r"/(lib_[ab])/run_id=", 1), F.lit("/"),
                 F.regexp_extract("_metadata.file_path", r"/run_id=([^/]*)/", 1)).alias("run_id"),
        F.regexp_count("value", F.lit(r'"event": "Result",\n +"value": (true|false),')).alias("bare"), array.alias("e"))

    def total(array_, fn):
        return F.aggregate(array_, F.lit(0.0), lambda acc, x: acc + F.coalesce(fn(x).cast("double"), F.lit(0.0)))

    return rows.groupBy(F.expr(RUN_OF_PATH).alias("run_id")).agg(
        F.sum(F.size("e")).cast("bigint").alias("n_events"), F.count("*").alias("n_files"),
        F.sum("bare").cast("bigint").alias("bare_results"),
        F.sum(total(F.col("e"), lambda x: F.length(x["event"]))).cast("bigint").alias("event_chars"),
        F.sum(total(F.col("e"), lambda x: F.length(x["value"]))).cast("bigint").alias("value_chars"),
        F.min(F.array_min(F.transform("e", lambda x: x["start_time"]))).alias("first_start"),
        F.round(F.sum(total(F.col("e"), lambda x: x["execution_time"])), 3).alias("seconds"))


# --- experiment grids ----------------------------------------------------------------------------

def _tables(spark, sf_dir):
    """Rows there are for the narrow and for the wide dataset."""
    def counted(name, dataset):
        return table(spark, sf_dir, name).agg(F.count("*").alias("n_rows")).select(
            F.lit(dataset).alias("dataset"), "n_rows")

    return counted("lineitem", "susy").unionByName(counted("embeddings", "cats_dogs"))


WORKERS = (2, 4, 8)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)


def _grid_sql(plans) -> str:
    numbered = [(i, *p, {"susy": 10000, "cats_dogs": 100}[p[0]]) for i, p in enumerate(plans)]
    return f"""tb as (
  select 'susy' as dataset, count(*) as n_rows from lineitem union all
  select 'cats_dogs', count(*) from embeddings), plan as (
  select * from (values {_values(numbered)})
  as p(plan_no, dataset, train_chunks, test_chunks, chunk_rows)), sized as (
  select dataset, n_rows, plan_no, train_chunks, test_chunks,
         cast(chunk_rows as bigint) as chunk_rows,
         cast(train_chunks * chunk_rows as bigint) as train_rows,
         cast(test_chunks * chunk_rows as bigint) as test_rows
  from tb join plan using (dataset)), found as (
  select *, least(train_rows, n_rows) as train_found,
         greatest(0, least(test_rows, n_rows - train_rows)) as test_found from sized)"""


GRID_SQL = _grid_sql(design.PLANS) + """, grid as (
  select f.*, algorithm, library from found f,
    (values ('lr'), ('kmeans'), ('pca'), ('mlp')) as a(algorithm),
    (values ('lib_a'), ('lib_b')) as l(library))"""


@query("experiment_grid", f"with {GRID_SQL} select * from grid")
def _grid(spark, sf_dir):
    return design.experiment_grid(_tables(spark, sf_dir))


@query("grid_output_name", f"""with {GRID_SQL}
select concat_ws('_', dataset, train_chunks, test_chunks, algorithm) as output_name,
       count(*) as runs, count(distinct library) as libraries, count(distinct plan_no) as plans,
       count(*) > 1 as collides
from grid group by 1""")
def _grid_names(spark, sf_dir):
    return design.grid_output_name(design.experiment_grid(_tables(spark, sf_dir)))


@query("scaling_grid", f"""with {_grid_sql(design.SCALING_PLANS)}
select f.*, workers, concat_ws('_', dataset, train_chunks, test_chunks, workers) as run_name
from found f, (values {_values([(w,) for w in WORKERS])}) as w(workers)""")
def _scaling(spark, sf_dir):
    return design.scaling_grid(_tables(spark, sf_dir), WORKERS)
