"""Run-log analytics: from ordered events to durations, spans and a summary per model.

Events are rows ``(run_id, pos, event, value, epoch_us)`` with a dense 0-based ``pos`` per run and,
if known, the run's ``library``, which results then carry along. One run may hold a large share of all
events, so nothing here gathers a whole run: events are handled in blocks of consecutive positions.
What a block needs from later ones is either a copy of the next block's first event, or the first
event of each kind in later blocks, which comes from a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fityard.functions.ordering import BLOCK_ROWS
from fityard.spec import LIB_A, LIB_B, LibraryProfile

# Shorter durations count as zero; the six header events; marker of a missing result.
CLAMP_US = 10_000
HEADER = ("library", "dataset", "model", "chunksize", "num_train_chunks", "num_test_chunks")
MISSING = -1

_FAR = (1 << 63) - 1


def event_durations(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``dur_us``: time to the next event of the run, 0 if below 10 ms or for the last event.

    The first event of every block is also copied into the block before it, where it is the "next
    event" of that block's last one. So a single shuffle on (run, block) is enough.
    """
    return _durations(events, block_rows).drop("_blk")


def _durations(events: DataFrame, block_rows: int) -> DataFrame:
    blk = F.expr(f"pos div {block_rows}")
    starts_block = (F.col("pos") % block_rows == 0) & (F.col("pos") > 0)
    homes = F.when(starts_block, F.array(blk, blk - 1)).otherwise(F.array(blk))
    copies = events.select("*", F.explode(homes).alias("_blk"))
    backwards = Window.partitionBy("run_id", "_blk").orderBy(F.desc("pos"))
    gap = F.col("_next_us") - F.col("epoch_us")
    return (copies.withColumn("_next_us", F.lag("epoch_us").over(backwards))
            .filter(F.col("_blk") == blk)
            .withColumn("dur_us", F.when(gap >= CLAMP_US, gap).otherwise(F.lit(0)))
            .drop("_next_us"))


def run_config(events: DataFrame) -> DataFrame:
    """The header events as columns, one row per run."""
    return (events.filter(F.col("pos") < len(HEADER)).groupBy("run_id")
            .agg(*[F.max(F.when(F.col("pos") == i, F.col("value"))).alias(name)
                   for i, name in enumerate(HEADER)]))


def run_library(events: DataFrame) -> DataFrame:
    """``(run_id, library)`` from the first event of each run."""
    return events.filter(F.col("pos") == 0).select("run_id", F.col("value").alias("library"))


def with_library(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Add the library of each run to rows that are few per run (summaries, log heads)."""
    return rows.join(run_library(events), "run_id")


def _profile_table(df: DataFrame, profiles: Sequence[LibraryProfile]) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(p.name, p.first_setup_pos, p.last_setup_pos) for p in profiles],
        "library string, _lo int, _hi int")


def validate_library(runs: DataFrame,
                     profiles: Sequence[LibraryProfile] = (LIB_A, LIB_B)) -> tuple[DataFrame, DataFrame]:
    """Split ``(run_id, library)`` into runs of known libraries and rejected runs."""
    known = F.broadcast(_profile_table(runs, profiles))
    return runs.join(known, "library", "left_semi"), runs.join(known, "library", "left_anti")


def setup_times(events: DataFrame, profiles: Sequence[LibraryProfile] = (LIB_A, LIB_B),
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Setup durations ``(run_id, library, event, setup_us)``; a name that comes twice counts last.

    Only the head of each run is read: positions up to one past the last setup event.
    """
    head = max(p.last_setup_pos for p in profiles) + 1
    timed = event_durations(events.filter(F.col("pos") <= head), block_rows)
    if "library" not in timed.columns:
        timed = with_library(timed, events)
    ranges = F.broadcast(_profile_table(events, profiles))
    return (timed.join(ranges, "library").filter(F.col("pos").between(F.col("_lo"), F.col("_hi")))
            .groupBy("run_id", "library", "event")
            .agg(F.max_by("dur_us", "pos").alias("setup_us")))


def run_models(events: DataFrame) -> DataFrame:
    """The models of each run in order of training, repeats kept."""
    return events.filter(F.col("event") == "Training").select(
        "run_id", "pos", F.col("value").alias("model"))


def _of_kind(kind: str, *fields: str) -> Column:
    return F.when(F.col("event") == kind, F.struct(*fields))


# Per kind of event, the fields that a span needs of the first such event after its Training.
_MARKERS = {
    "_result": ("Result", ("pos", "value")),
    "_testing": ("Testing", ("pos", "dur_us")),
    "_train_acc": ("Training Accuracy", ("pos", "value")),
    "_test_acc": ("Testing Accuracy", ("pos", "value")),
}


def _trainings(events: DataFrame, block_rows: int) -> DataFrame:
    """Training events with the next event of every marker kind, and with the run's last event."""
    timed = _durations(events, block_rows)
    backwards = Window.partitionBy("run_id", "_blk").orderBy(F.desc("pos"))
    later = backwards.rowsBetween(Window.unboundedPreceding, -1)
    so_far = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = timed.select(
        "*",
        *[F.last(_of_kind(kind, *fields), ignorenulls=True).over(later).alias(name)
          for name, (kind, fields) in _MARKERS.items()],
        F.first(F.struct("pos", "value")).over(so_far).alias("_tail")
    ).filter(F.col("event") == "Training")

    # What later blocks hold, one row per block. No block is later than the first one of its run, so
    # this branch reads nothing of runs that fit one block, and windows only blocks over a whole run.
    overflow = _durations(events.filter(F.col("pos") >= block_rows), block_rows)
    blocks = overflow.groupBy("run_id", "_blk").agg(
        *[F.min(_of_kind(kind, *fields)).alias(name) for name, (kind, fields) in _MARKERS.items()],
        F.max(F.struct("pos", "value")).alias("_tail"))
    from_here = (Window.partitionBy("run_id").orderBy(F.desc("_blk"))
                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = blocks.select(
        "run_id", (F.col("_blk") - 1).alias("_blk"),
        *[F.last(name, ignorenulls=True).over(from_here).alias(f"{name}_later") for name in _MARKERS],
        F.first("_tail").over(from_here).alias("_tail_later"))
    joined = marked.join(carried, ["run_id", "_blk"], "left")
    return joined.withColumns({
        **{name: F.coalesce(F.col(name), F.col(f"{name}_later")) for name in _MARKERS},
        "_tail": F.coalesce(F.col("_tail_later"), F.col("_tail")),
    })


def _spans(events: DataFrame, block_rows: int) -> DataFrame:
    """One row per run and model: the Training that counts, with its markers.

    ``end`` is the first Result after the model's first Training, and ``start`` the model's last
    Training before it. Since the next Result can only move back as positions grow, that is the
    latest Training among those whose next Result comes first: one pre-aggregated minimum.
    """
    t = _trainings(events, block_rows)
    first = F.struct(F.coalesce(F.col("_result.pos"), F.lit(_FAR)), -F.col("pos"))
    per_run = [c for c in ("library",) if c in events.columns]
    kept = F.struct("pos", "dur_us", *_MARKERS, "_tail", *per_run)
    best = t.groupBy("run_id", F.col("value").alias("model")).agg(F.min_by(kept, first).alias("s"))
    has_end = F.col("s._result").isNotNull()
    return best.select(
        "run_id", *[F.col(f"s.{c}").alias(c) for c in per_run], "model",
        F.col("s.pos").alias("start"),
        F.coalesce(F.col("s._result.pos"), F.lit(MISSING)).alias("end"),
        # Without a Result, ranges run up to the run's last event, which also gives the status.
        F.when(has_end, F.col("s._result.pos")).otherwise(F.col("s._tail.pos")).alias("_hi"),
        F.when(has_end, F.col("s._result.value")).otherwise(F.col("s._tail.value")).alias("_status"),
        F.col("s.dur_us").alias("_dur"), F.col("s._testing").alias("_testing"),
        F.col("s._train_acc").alias("_train_acc"), F.col("s._test_acc").alias("_test_acc"))


def _failed() -> Column:
    return F.col("end") - F.col("start") == 1


def _training_us() -> Column:
    return F.when(_failed(), F.lit(MISSING)).otherwise(F.col("_dur"))


def _testing_us() -> Column:
    falsy = F.col("_status").isNull() | F.col("_status").isin("", "false")
    inside = F.col("_testing.pos") < F.col("_hi")
    return (F.when(_failed() | falsy, F.lit(MISSING))
            .when(inside, F.col("_testing.dur_us")).otherwise(F.lit(MISSING)))


def _accuracy(marker: str) -> Column:
    inside = F.col(f"{marker}.pos") < F.col("_hi")
    return F.coalesce(F.when(inside, F.col(f"{marker}.value").cast("double")),
                      F.lit(float(MISSING)))


def _span_values(events: DataFrame, block_rows: int, *values: Column | str) -> DataFrame:
    spans = _spans(events, block_rows)
    keys = [c for c in ("run_id", "library", "model") if c in spans.columns]
    return spans.select(*keys, *values)


def model_span(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(run_id, model, start, end)``; ``end = -1`` when no Result follows."""
    return _span_values(events, block_rows, "start", "end")


def training_time(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Duration of the Training event, -1 if its Result follows at once (training failed)."""
    return _span_values(events, block_rows, _training_us().alias("train_us"))


def testing_time(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Duration of the first Testing inside the span, -1 if training or testing failed."""
    return _span_values(events, block_rows, _testing_us().alias("test_us"))


def span_accuracy(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """First training and testing accuracy inside the span, else -1."""
    return _span_values(events, block_rows, _accuracy("_train_acc").alias("train_acc"),
                        _accuracy("_test_acc").alias("test_acc"))


def model_summary(events: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All four numbers per run and model; a model that was trained repeatedly has one row."""
    return _span_values(events, block_rows,
                        _training_us().alias("train_us"), _testing_us().alias("test_us"),
                        _accuracy("_train_acc").alias("train_acc"),
                        _accuracy("_test_acc").alias("test_acc"))


def run_summary(events: DataFrame, profiles: Sequence[LibraryProfile] = (LIB_A, LIB_B),
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`model_summary` with the run's number of setup events and their total time.

    A run with setup events but without any Training keeps one row, whose model and results are null.
    """
    setup = setup_times(events, profiles, block_rows).groupBy("run_id").agg(
        F.count("*").alias("setup_events"), F.sum("setup_us").alias("setup_us"))
    return model_summary(events, block_rows).join(setup, "run_id", "full").withColumns({
        "setup_events": F.coalesce("setup_events", F.lit(0)),
        "setup_us": F.coalesce("setup_us", F.lit(0)),
    })
