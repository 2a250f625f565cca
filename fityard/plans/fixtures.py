"""The tables that stand in for feature files and run logs, derived from the given Parquet tables.

Each has a DataFrame form and the same thing as SQL common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fityard.functions.ordering import index_within, row_index
from fityard.functions.vectors import as_vector, ntz_micros
from fityard.operators.features import assemble_features, rename_label
from fityard.operators.splits import hash_split
from fityard.runtime import new_table_path, spread, written
from fityard.sources.feature_csv import index_feature_csv, read_prefix
from fityard.spec import TARGET, DatasetSpec

SUSY_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
SUSY_FEATURES = ["0", "1", "2", "3"]
TRAIN_FRACTION = 0.7
EMB_WIDTH = 64

# Plan of the positional split: 40 train and 10 test chunks of a sixtieth of the table each.
CHUNKS_PER_TABLE, N_TRAIN, N_TEST = 60, 40, 10

_made: dict[tuple, object] = {}


def once(spark: SparkSession, name: str, sf_dir: str, make):
    """Make a written fixture (a table, or the path of a folder) once per application."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- narrow table with a binary target -----------------------------------------------------------

def susy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key columns, ``split_key``, ``target`` and four features of every ``lineitem`` row."""
    return _featured(table(spark, sf_dir, "lineitem"))


def _featured(lines: DataFrame) -> DataFrame:
    c = F.col
    score = c("l_extendedprice") * (1 - c("l_discount")) + F.lit(1e6) * (c("l_tax") - 0.04)
    return lines.select(
        *SUSY_KEYS,
        (c("l_orderkey") * 8 + c("l_linenumber")).alias("split_key"),
        F.when(score > 53000, 1.0).otherwise(0.0).alias(TARGET),
        (c("l_extendedprice") / F.lit(1e5)).alias("0"),
        (c("l_quantity") / 50).alias("1"),
        c("l_discount").alias("2"),
        c("l_linenumber").cast("double").alias("3"))


SUSY_SQL = """susy as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
         l_orderkey * 8 + l_linenumber as split_key,
         cast(case when l_extendedprice * (1 - l_discount) + 1e6 * (l_tax - cast(0.04 as double)) > 53000
                   then 1.0 else 0.0 end as double) as target,
         l_extendedprice / 1e5 as "0", l_quantity / 50 as "1", l_discount as "2",
         cast(l_linenumber as double) as "3"
  from lineitem)"""

KEYS_SQL = ", ".join(SUSY_KEYS)

# The same hash as functions.unit_hash, for both multipliers.
HASH_SQL = "((split_key % 2147483648) * 2654435761 % 4294967296 / 4294967296.0)"
VAL_HASH_SQL = "((split_key % 2147483648) * 2246822519 % 4294967296 / 4294967296.0)"

SPLIT_SQL = SUSY_SQL + f""", sp as (
  select *, case when {HASH_SQL} < {TRAIN_FRACTION} then 'train' else 'test' end as split
  from susy)"""

INDEXED_SQL = SUSY_SQL + f""", ix as (
  select *, row_number() over (order by {KEYS_SQL}) - 1 as row_idx,
         count(*) over () // {CHUNKS_PER_TABLE} as chunk_rows
  from susy)"""


def susy_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_split(susy(spark, sf_dir), "split_key", TRAIN_FRACTION)


def susy_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``susy`` with its position in key order."""
    return once(spark, "susy_indexed", sf_dir,
                 lambda: row_index(susy(spark, sf_dir), SUSY_KEYS))


def susy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``susy_split`` as a written feature table, which iterative fits scan several times."""
    return once(spark, "susy_table", sf_dir,
                lambda: written(spread(susy_split(spark, sf_dir)), "susy-split"))


def susy_vectors(spark: SparkSession, sf_dir: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Train and test side of the hash split with ``label`` and ``features``."""
    rows = assemble_features(rename_label(susy_table(spark, sf_dir)), features).select(
        *SUSY_KEYS, "split", "label", *[F.col(f"`{f}`") for f in features], "features")
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def chunk_rows(spark: SparkSession, sf_dir: str) -> int:
    return max(table(spark, sf_dir, "lineitem").count() // CHUNKS_PER_TABLE, 1)


SUSY_SPEC = DatasetSpec("susy_stand_in", num_cols=len(SUSY_FEATURES))
# Reader of the exported file: the keys are carried along as further columns.
FILE_COLUMNS = [TARGET, *SUSY_FEATURES, *SUSY_KEYS]
FILE_SPEC = DatasetSpec("susy_file", num_cols=len(FILE_COLUMNS) - 1)


def susy_csv(spark: SparkSession, sf_dir: str) -> str:
    """Folder of headerless CSV files whose file order is the key order."""
    def make() -> str:
        # The shuffle carries what the features are made of, which is less than the features.
        lines = table(spark, sf_dir, "lineitem").select(*SUSY_KEYS, "l_quantity", "l_discount", "l_tax")
        return _write_csv(_featured(lines.repartitionByRange(*SUSY_KEYS).sortWithinPartitions(*SUSY_KEYS)))

    return once(spark, "susy_csv", sf_dir, make)


def susy_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder of headerless CSV files with the same rows as they are scanned: neither shuffled nor sorted."""
    return once(spark, "susy_files", sf_dir, lambda: _write_csv(susy(spark, sf_dir)))


def _write_csv(rows: DataFrame) -> str:
    path = new_table_path(rows.sparkSession, "susy-csv")
    rows.select(*[F.col(f"`{c}`") for c in FILE_COLUMNS]).write.option("header", False).csv(path)
    return path


def file_rows(rows: DataFrame) -> DataFrame:
    """Rows of the exported file under their own names again."""
    extra = [c for c in rows.columns if c not in FILE_SPEC.columns]
    named = [F.col(f"`{at}`").alias(name) for at, name in zip(FILE_SPEC.columns, FILE_COLUMNS)]
    keys = [F.col(k).cast("bigint" if k != "l_linenumber" else "int").alias(k)
            if k != "l_extendedprice" else F.col(k) for k in SUSY_KEYS]
    inner = rows.select(*named, *extra)
    return inner.select(*keys, TARGET, *[F.col(f"`{f}`") for f in SUSY_FEATURES], *extra)


def susy_csv_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every split of the exported files."""
    return once(spark, "susy_csv_index", sf_dir, lambda: index_feature_csv(spark, susy_csv(spark, sf_dir)))


def susy_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunks of the exported file, with their position in it."""
    rows = read_prefix(spark, susy_csv(spark, sf_dir), FILE_SPEC, N_TRAIN, N_TEST, chunk_rows(spark, sf_dir),
                       susy_csv_index(spark, sf_dir))
    return file_rows(rows)


# --- wide table ----------------------------------------------------------------------------------

def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id``, ``features``, ten-level ``level`` and binary ``label`` of every embedding."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", as_vector("embedding").alias("features"), F.col("label").alias("level"),
        (F.col("label") < 5).cast("double").alias("label"))


# --- run log -------------------------------------------------------------------------------------

def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events ``(run_id, pos, event, value, epoch_us, library)``; one run per user."""
    return once(spark, "run_log", sf_dir, lambda: _make_run_log(spark, sf_dir))


def _make_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    event = (F.when(kind == "click", "Training").when(kind == "view", "Testing")
             .when(kind == "purchase", "Training Accuracy")
             .when(kind == "signup", "Testing Accuracy").when(kind == "error", "Result"))
    value = (F.when(kind.isin("click", "view"), F.concat(F.lit("m"), (k % 4).cast("string")))
             .when(kind == "error", (k % 2 == 0).cast("string"))
             .otherwise(F.col("value").cast("string")))
    events = raw.select(
        F.col("user_id").alias("run_id"), event.alias("event"), value.alias("value"),
        ntz_micros("ts").alias("epoch_us"), "event_id",
        F.when(F.col("user_id") % 2 == 0, "lib_a").otherwise("lib_b").alias("library"))
    placed = index_within(events, ["run_id"], ["epoch_us", "event_id"], "pos")
    return written(placed.select("run_id", "pos", "event", "value", "epoch_us", "library"), "run-log")


LOG_SQL = """lg as (
  select user_id as run_id,
         row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
         case event_type when 'click' then 'Training' when 'view' then 'Testing'
              when 'purchase' then 'Training Accuracy' when 'signup' then 'Testing Accuracy'
              when 'error' then 'Result' end as event,
         case when event_type in ('click', 'view')
                   then concat('m', cast(cast(props->>'$.k' as integer) % 4 as varchar))
              when event_type = 'error'
                   then cast(cast(props->>'$.k' as integer) % 2 = 0 as varchar)
              else cast(value as varchar) end as value,
         epoch_us(ts) as epoch_us,
         case when user_id % 2 = 0 then 'lib_a' else 'lib_b' end as library
  from events)"""

EV_SQL = LOG_SQL + """, gaps as (
  select *, lead(epoch_us) over (partition by run_id order by pos) - epoch_us as gap,
         count(*) over (partition by run_id) as n
  from lg), ev as (
  select run_id, library, pos, event, value as v, n, epoch_us,
         case when gap is null or gap < 10000 then 0 else gap end as dur
  from gaps)"""

# One row per (run, model): positions st and en, training and testing time, accuracies.
SPAN_SQL = EV_SQL + """, f as (
  select run_id, v as model, min(pos) as p0, any_value(n) as n, any_value(library) as library
  from ev where event = 'Training' group by 1, 2), en as (
  select f.run_id, f.model, f.library, f.n, f.p0, coalesce(min(e.pos), -1) as en
  from f left join ev e on e.run_id = f.run_id and e.event = 'Result' and e.pos > f.p0
  group by 1, 2, 3, 4, 5), sp as (
  select en.run_id, en.model, en.library, en.n, en.en, max(e.pos) as st,
         case when en.en = -1 then en.n - 1 else en.en end as hi
  from en join ev e on e.run_id = en.run_id and e.event = 'Training' and e.v = en.model
                   and (en.en = -1 or e.pos < en.en)
  group by 1, 2, 3, 4, 5), j as (
  select sp.*, s.dur as sdur, r.v as rv
  from sp join ev s on s.run_id = sp.run_id and s.pos = sp.st
          join ev r on r.run_id = sp.run_id and r.pos = sp.hi), x as (
  select j.run_id, j.model, j.library, j.st, j.en, j.sdur, j.rv,
         arg_min(e.dur, e.pos) filter (where e.event = 'Testing' and e.pos > j.st) as tdur,
         arg_min(e.v, e.pos) filter (where e.event = 'Training Accuracy') as ta,
         arg_min(e.v, e.pos) filter (where e.event = 'Testing Accuracy') as sa
  from j left join ev e on e.run_id = j.run_id and e.pos >= j.st and e.pos < j.hi
  group by 1, 2, 3, 4, 5, 6, 7), spans as (
  select run_id, library, model, st, en,
         cast(case when en - st = 1 then -1 else sdur end as bigint) as train_us,
         cast(case when en - st = 1 or rv is null or rv in ('', 'false') then -1
                   else coalesce(tdur, -1) end as bigint) as test_us,
         coalesce(cast(ta as double), -1) as train_acc,
         coalesce(cast(sa as double), -1) as test_acc
  from x)"""

PAIR_SQL = """, placed as (
  select run_id, library, row_number() over (partition by library order by run_id) - 1 as pair_idx
  from (select distinct run_id, library from lg)), pairs as (
  select a.pair_idx, a.run_id as run_a, b.run_id as run_b
  from placed a join placed b on a.pair_idx = b.pair_idx and a.library = 'lib_a'
                             and b.library = 'lib_b'), members as (
  select p.* from placed p where p.pair_idx in (select pair_idx from pairs))"""
