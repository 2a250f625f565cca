"""Run logs: ordered events of a run as a JSON array.

Two layouts. *Bulk*: JSON lines ``{run_id, segment, events: [...]}``, any number of runs per file.
*One file per run*: files that hold one indented JSON array each, as a single run writes its log. A run of up
to ``SEGMENT_EVENTS`` events is one array; a longer run continues in further segments, so no task
ever builds a run of any length in memory.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fityard.runtime import join_lookup, written

SEGMENT_EVENTS = 10_000
TASKS_PER_CORE = 4
# What ends an element of an array that is indented by four spaces, and nothing else: strings hold no line feed.
ELEMENT_END = "\n    }"

EVENT_TYPE = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("execution_time", T.DoubleType()),
    T.StructField("start_time", T.StringType()),
    T.StructField("start_time_epoch", T.DoubleType()),
])
EVENT_FIELDS = EVENT_TYPE.fieldNames()


def _segments(events: DataFrame, segment_events: int) -> DataFrame:
    """``(run_id, segment, events)``; fields of the record that ``events`` lacks are left out."""
    fields = [F.col(c) for c in EVENT_FIELDS if c in events.columns]
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("e"))))
    return (events.groupBy("run_id", F.expr(f"pos div {segment_events}").alias("segment"))
            .agg(F.min("pos").alias("first_pos"), F.transform(ordered, lambda x: x["e"]).alias("events")))


def _events(segments: DataFrame, segment_events: int) -> DataFrame:
    """Positions follow from the segment's own first position, where it is stored."""
    first = F.col("segment").cast("bigint") * segment_events
    if "first_pos" in segments.columns:
        first = F.coalesce(F.col("first_pos"), first)
    return (segments.select("run_id", first.alias("_first"), F.posexplode("events").alias("_p", "_e"))
            .select("run_id", (F.col("_first") + F.col("_p")).alias("pos"), "_e.*"))


def write_run_logs(events: DataFrame, path: str, segment_events: int = SEGMENT_EVENTS) -> None:
    """Write events ``(run_id, pos, event, value, ...)`` in bulk layout."""
    _segments(events, segment_events).write.option("ignoreNullFields", False).json(path)


def read_run_logs(spark: SparkSession, path: str | list[str], run_id_type: str = "string",
                  segment_events: int = SEGMENT_EVENTS) -> DataFrame:
    """Read the bulk layout into ``(run_id, pos, event, value, execution_time, start_time,
    start_time_epoch)``. A broken line is an error. ``segment_events`` matters only for files without ``first_pos``."""
    schema = T.StructType([
        T.StructField("run_id", T.StringType()), T.StructField("segment", T.LongType()),
        T.StructField("first_pos", T.LongType()), T.StructField("events", T.ArrayType(EVENT_TYPE))])
    segments = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return _events(segments.withColumn("run_id", F.col("run_id").cast(run_id_type)), segment_events)


def _json_scalar(name: str, booleans: Sequence[str]) -> Column:
    """The field's value as JSON; ``true`` and ``false`` of the named events stay bare."""
    # {"v":...} without the braces and the name.
    record = F.to_json(F.struct(F.col(name).alias("v")), {"ignoreNullFields": "false"})
    scalar = F.regexp_extract(record, r"(?s)^\{\"v\":(.*)\}$", 1)
    if name != "value":
        return scalar
    bare = F.col("event").isin(*booleans) & F.col(name).isin("true", "false")
    return F.when(bare, F.col(name)).otherwise(scalar)


def file_tasks(spark: SparkSession) -> int:
    """Tasks that write many small files: several for every core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def write_run_files(events: DataFrame, path: str, segment_events: int = SEGMENT_EVENTS,
                    booleans: Sequence[str] = ("Result",)) -> None:
    """Write every run to a file of its own in ``run_id=<id>/``: one indented JSON array, as a single run writes its log. Fields that ``events`` lacks are left out; values ``true`` and ``false`` of the events in
    ``booleans`` are JSON booleans.

    Lines are brought together by run and segment and written one by one, so no array is ever built in memory; a
    run of more than ``segment_events`` events continues in further files, which other tasks can write. Where there is such a
    run, all files lie in ``run_id=<id>/segment=<s>/``; a folder more for each file takes as long as the file, so it is not
    made for nothing.
    """
    segment = F.expr(f"pos div {segment_events}")
    folders = ["run_id", "segment"] if events.agg(F.max(~segment.eqNullSafe(0))).first()[0] else ["run_id"]
    fields = [c for c in EVENT_FIELDS if c in events.columns]
    lines = [F.concat(F.lit(f'{" " * 8}"{c}": '), _json_scalar(c, booleans)) for c in fields]
    in_file = Window.partitionBy("run_id", "segment").orderBy("pos")
    # A file costs the same however short it is, which the bytes of a partition don't tell: the number of tasks is fixed here, or
    # small runs would be put into about as many tasks as there are cores, of which the last one over keeps the others waiting.
    placed = events.withColumn("segment", segment).repartition(
        file_tasks(events.sparkSession), "run_id", "segment").select(
        "*", F.lag("pos").over(in_file).isNull().alias("_first"), F.lead("pos").over(in_file).isNull().alias("_last"))
    element = F.concat(F.when(F.col("_first"), "[\n").otherwise(""), F.lit("    {\n"), F.concat_ws(",\n", *lines),
                       F.lit(ELEMENT_END), F.when(F.col("_last"), "\n]").otherwise(","))
    (placed.sortWithinPartitions("run_id", "segment", "pos").select(*folders, element.alias("value"))
     .write.partitionBy(*folders).text(path))


def read_run_files(spark: SparkSession, path: str | list[str], segment_events: int | None = None) -> DataFrame:
    """Read files of one JSON array each, with the columns of :func:`read_run_logs`.

    In a folder of :func:`write_run_files` a run keeps its id, after the folders between it and the one that all given paths
    have in common; otherwise each file is one run and its id is the file's path below that folder, without extension. So
    equal names in different folders are different runs. Segments of a run follow each other by number; with
    ``segment_events`` a segment's first position is a multiple of it, as when a segment is read alone.

    An indented array (four spaces) is split at the ends of its elements, and their order follows from file, split and
    place in the split: a file of any length is read in pieces, by as many tasks as it has splits. Any other
    array is one row. A file that isn't one whole JSON array is an error.
    """
    full, below = _paths([path] if isinstance(path, str) else path)
    ids = r"/run_id=([^/]*)/(?:segment=(\d+)/[^/]*|part-[^/]*\.txt[^/]*)$"
    ours = F.col("_full").rlike(ids)
    own = F.nullif(F.regexp_extract("_full", ids, 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    run_id = F.when(ours, F.concat(F.regexp_extract("_below", r"^(.*/)?run_id=", 1), _decoded(own))).otherwise(
        F.regexp_replace("_below", r"\.[^./]*$", ""))
    segment = F.coalesce(F.when(ours, F.nullif(F.regexp_extract("_full", ids, 2), F.lit("")).cast("bigint")), F.lit(0))
    opened = F.col("value").rlike(r"^\s*[\[,]\s*\n    \{")
    closing = F.col("value").rlike(r"^\s*\]\s*$")
    strict = {"mode": "FAILFAST"}
    element = F.concat(F.regexp_replace("value", r"^\s*[\[,]\s*", ""), F.lit(ELEMENT_END))
    events = (F.when(closing, F.array().cast(T.ArrayType(EVENT_TYPE)))
              .when(opened, F.array(F.from_json(element, EVENT_TYPE, strict)))
              .when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(EVENT_TYPE), strict))
              .otherwise(F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("_file")))))
    pieces = spark.read.option("lineSep", ELEMENT_END).option("recursiveFileLookup", True).text(path).select(
        "value", full.alias("_full"), below.alias("_below"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"))
    parsed = written(pieces.select(
        run_id.alias("run_id"), segment.alias("segment"), "_file", "_start", F.monotonically_increasing_id().alias("_mid"),
        events.alias("events"), (~opened).cast("int").alias("_end")), "log-pieces")
    full_of_events = F.size("events") > 0
    splits = parsed.groupBy("run_id", "segment", "_file", "_start").agg(
        F.sum(F.size("events")).alias("_n"), F.min(F.when(full_of_events, F.col("_mid"))).alias("_m0"),
        F.sum("_end").alias("_ends"))
    # One row per split of a file: a run's events before it, and how often its file ends.
    before = Window.partitionBy("run_id").orderBy("segment", "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.sum("_ends").over(Window.partitionBy("run_id", "segment", "_file"))
    in_segment = (Window.partitionBy("run_id", "segment").orderBy("_file", "_start")
                  .rowsBetween(Window.unboundedPreceding, -1))
    offset = (F.coalesce(F.sum("_n").over(before), F.lit(0)) if segment_events is None else
              F.col("segment") * segment_events + F.coalesce(F.sum("_n").over(in_segment), F.lit(0)))
    offsets = splits.select("_file", "_start", "_m0", offset.alias("_off"), ends.alias("_whole"))
    placed = join_lookup(parsed.drop("segment"), written(offsets, "log-splits"), ["_file", "_start"])
    whole = F.when(F.col("_whole") == 1, F.col("events")).otherwise(
        F.raise_error(F.concat(F.lit("not one whole JSON array: "), F.col("_file"))))
    return (placed.select("run_id", "_off", "_mid", "_m0", F.posexplode(whole).alias("_p", "_e"))
            .select("run_id", (F.col("_off") + F.col("_mid") - F.col("_m0") + F.col("_p")).alias("pos"), "_e.*"))


def _decoded(path: Column) -> Column:
    """Paths come encoded as URLs; a plus sign stands for itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _paths(paths: list[str]) -> tuple[Column, Column]:
    """Each row's file path, and the part below the folder that all paths have in common."""
    full = _decoded(F.col("_metadata.file_path"))
    root = F.lit(_common_folder(paths))
    below = F.when(F.instr(full, root) > 0, F.substring(
        full, F.instr(full, root) + F.length(root) + 1, F.length(full))).otherwise(full)
    return full, F.when(below == "", F.regexp_extract(full, r"([^/]+)$", 1)).otherwise(below)


def _common_folder(paths: list[str]) -> str:
    """Folder above all paths, up to the first wildcard, without a scheme; of a single path, the path itself."""
    plain = [re.sub(r"^\w+:(//[^/]*)?", "", p).rstrip("/") for p in paths]
    fixed = [os.path.dirname(re.split(r"[*?\[{]", p)[0] + "x") if re.search(r"[*?\[{]", p) else p for p in plain]
    return os.path.commonpath(fixed)
