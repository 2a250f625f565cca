import random

import pytest

from fityard.operators import comparison as cmp
from fityard.operators import runlog as rl
from fityard.spec import LibraryProfile
from tests.conftest import rows_of

SCHEMA = "run_id bigint, pos bigint, event string, value string, epoch_us bigint, library string"
PROFILES = (LibraryProfile("lib_a", 8, 10), LibraryProfile("lib_b", 8, 11))
SECOND = 1_000_000
BLOCKS = [2, 3, 1 << 16]


def _frame(spark, runs):
    """``runs``: {run_id: (library, [(event, value, epoch_us)])}."""
    rows = [(run, p, e, v, t, lib) for run, (lib, events) in runs.items()
            for p, (e, v, t) in enumerate(events)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def _timed(*pairs, step=SECOND):
    return [(e, v, i * step) for i, (e, v) in enumerate(pairs)]


def _expected(events):
    """Durations and per-model results of one run, stated directly from the rules."""
    times = [t for _, _, t in events]
    dur = [b - a if b - a >= 10_000 else 0 for a, b in zip(times, times[1:])] + [0]
    at = {kind: [i for i, e in enumerate(events) if e[0] == kind] for kind in {e[0] for e in events}}
    models = {}
    for m in {v for e, v, _ in events if e == "Training"}:
        mine = [i for i in at["Training"] if events[i][1] == m]
        end = min((i for i in at.get("Result", []) if i > mine[0]), default=-1)
        start = max(i for i in mine if end == -1 or i < end)
        stop = end if end != -1 else len(events) - 1

        def first(kind, low):
            return min((i for i in at.get(kind, []) if low <= i < stop), default=None)

        failed = end - start == 1
        status = events[end][1] if end != -1 else events[-1][1]
        test = first("Testing", start + 1)
        accs = [first(k, start) for k in ("Training Accuracy", "Testing Accuracy")]
        models[m] = (start, end, -1 if failed else dur[start],
                     -1 if failed or status in (None, "", "false") or test is None else dur[test],
                     *[-1.0 if a is None else float(events[a][1]) for a in accs])
    return dur, models


def _random_run(rnd, n):
    t, events = 0, []
    for _ in range(n):
        kind = rnd.choice(["Training", "Testing", "Result", "Training Accuracy", "Testing Accuracy", "End"])
        value = {"Training": f"m{rnd.randrange(3)}", "Testing": "m0",
                 "Result": rnd.choice(["true", "false", None, "", "x"]),
                 "End": None}.get(kind, str(rnd.randrange(100) / 4))
        events.append((kind, value, t))
        t += rnd.choice([0, 9_999, 10_000, 10_001, SECOND])
    return events


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("partitions", [1, 7])
def test_against_the_rules_on_random_logs(spark, block_rows, partitions):
    rnd = random.Random(11)
    runs = {r: ("lib_a", _random_run(rnd, 120 if r == 0 else rnd.randrange(1, 30))) for r in range(40)}
    events = _frame(spark, runs).repartition(partitions)
    dur = rows_of(rl.event_durations(events, block_rows), "run_id", "pos", "dur_us")
    want = {r: _expected(e) for r, (_, e) in runs.items()}
    assert dur == [(r, p, d) for r in sorted(want) for p, d in enumerate(want[r][0])]
    spans = rows_of(rl.model_span(events, block_rows), "run_id", "model", "start", "end")
    assert spans == sorted((r, m, *v[:2]) for r, (_, ms) in want.items() for m, v in ms.items())
    summary = rows_of(rl.model_summary(events, block_rows), "run_id", "model", "train_us", "test_us",
                      "train_acc", "test_acc")
    assert summary == sorted((r, m, *v[2:]) for r, (_, ms) in want.items() for m, v in ms.items())


CASES = {
    "plain": (_timed(("Training", "m"), ("Training Accuracy", "0.5"), ("Testing", "m"),
                     ("Testing Accuracy", "0.25"), ("Result", "true"), ("End", None)),
              (0, 4, SECOND, SECOND, 0.5, 0.25)),
    "training failed": (_timed(("Training", "m"), ("Result", "false")), (0, 1, -1, -1, -1.0, -1.0)),
    "testing failed": (_timed(("Training", "m"), ("Testing", "m"), ("Result", "false")),
                       (0, 2, SECOND, -1, -1.0, -1.0)),
    "null result": (_timed(("Training", "m"), ("Testing", "m"), ("Result", None)),
                    (0, 2, SECOND, -1, -1.0, -1.0)),
    "no testing though the result is true": (
        _timed(("Training", "m"), ("Training Accuracy", "1"), ("Result", "true")),
        (0, 2, SECOND, -1, 1.0, -1.0)),
    "no result, last event without value": (
        _timed(("Training", "m"), ("Testing", "m"), ("Testing Accuracy", "0.5"), ("End", None)),
        (0, -1, SECOND, -1, -1.0, 0.5)),
    "no result, last event is out of range but gives the status": (
        _timed(("Training", "m"), ("Testing", "m"), ("Testing Accuracy", "0.5")),
        (0, -1, SECOND, SECOND, -1.0, -1.0)),
    "nothing but the training": (_timed(("Training", "m")), (0, -1, 0, -1, -1.0, -1.0)),
    "trained twice before the result": (
        _timed(("Training", "m"), ("Training Accuracy", "0.1"), ("Training", "m"), ("Testing", "m"),
               ("Result", "true"), ("Training", "m"), ("Result", "false")),
        (2, 4, SECOND, SECOND, -1.0, -1.0)),
    "another training in between": (
        _timed(("Training", "m"), ("Training", "x"), ("Testing", "x"), ("Result", "true")),
        (0, 3, SECOND, SECOND, -1.0, -1.0)),
}


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_every_branch(spark, block_rows):
    names = list(CASES)
    events = _frame(spark, {i: ("lib_a", CASES[n][0]) for i, n in enumerate(names)}).drop("library")
    s = {(r["run_id"], r["model"]): r for r in rl.model_summary(events, block_rows).collect()}
    span = {(r["run_id"], r["model"]): r for r in rl.model_span(events, block_rows).collect()}
    for i, name in enumerate(names):
        r, p = s[i, "m"], span[i, "m"]
        got = (p["start"], p["end"], r["train_us"], r["test_us"], r["train_acc"], r["test_acc"])
        assert got == CASES[name][1], name


@pytest.mark.parametrize("gap,want", [(9_999, 0), (10_000, 10_000), (10_001, 10_001), (-5, 0)])
def test_short_durations_count_as_zero(spark, gap, want):
    events = _frame(spark, {1: ("lib_a", [("a", None, 100), ("b", None, 100 + gap)])})
    assert rows_of(rl.event_durations(events), "pos", "dur_us") == [(0, want), (1, 0)]


def _headed(library, setup, models=()):
    head = [("Library", library), ("Dataset", "susy"), ("Model", "all"), ("Chunksize", "10"),
            ("Num train chunks", "4"), ("Num test chunks", "1"), ("Start", None),
            ("Loading Dataset", None)]
    tail = [x for m in models for x in (("Training", m), ("Testing", m), ("Result", "true"))]
    return _timed(*head, *[(e, None) for e in setup], *tail, ("End", None))


def test_header_library_and_setup(spark):
    runs = {1: ("", _headed("lib_a", ["Session", "Frame", "Assemble"], ["m"])),
            2: ("", _headed("lib_b", ["Session", "Context", "Frame", "Assemble"], ["m"])),
            3: ("", _headed("lib_z", ["Session"])),
            4: ("", _headed("lib_a", ["Session", "Frame", "Session"]))}
    events = _frame(spark, runs).drop("library")
    config = {r["run_id"]: r.asDict() for r in rl.run_config(events).collect()}
    assert config[2] == {"run_id": 2, "library": "lib_b", "dataset": "susy", "model": "all",
                         "chunksize": "10", "num_train_chunks": "4", "num_test_chunks": "1"}
    known, rejected = rl.validate_library(rl.run_library(events), PROFILES)
    assert rows_of(known, "run_id") == [(1,), (2,), (4,)] and rows_of(rejected, "run_id") == [(3,)]
    setup = rows_of(rl.setup_times(events, PROFILES), "run_id", "event", "setup_us")
    assert [s[:2] for s in setup] == [(1, "Assemble"), (1, "Frame"), (1, "Session"), (2, "Assemble"),
                                      (2, "Context"), (2, "Frame"), (2, "Session"),
                                      (4, "Frame"), (4, "Session")]
    total = rl.run_summary(events, PROFILES).collect()
    assert {(r["run_id"], r["setup_events"], r["setup_us"]) for r in total} == {
        (1, 3, 3 * SECOND), (2, 4, 4 * SECOND), (4, 2, sum(s[2] for s in setup if s[0] == 4))}
    assert {r["run_id"] for r in total if r["model"] is None} == {4}


def _runs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "run_id bigint, library string")


def test_pairs_stop_at_the_shorter_side(spark):
    runs = _runs(spark, (5, "lib_a"), (9, "lib_a"), (2, "lib_a"), (7, "lib_b"), (1, "lib_b"), (3, "other"))
    assert rows_of(cmp.pair_runs(runs, block_rows=1)) == [(0, 2, 1), (1, 5, 7)]
    values = spark.range(2)
    assert rows_of(cmp.check_dimension_arity(runs, values)) == [(3, 2, 2, False)]
    assert rows_of(cmp.check_dimension_arity(runs.filter("run_id <> 9"), values)) == [(2, 2, 2, True)]


def test_parity_counts_trainings_and_names(spark):
    models = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "z")],
                                   "run_id bigint, model string")
    pairs = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "pair_idx bigint, run_a bigint, run_b bigint")
    got = rows_of(cmp.check_model_parity(models, pairs), "pair_idx", "models_a", "models_b",
                  "same_count", "one_sided_models")
    assert got == [(0, 3, 3, True, 1), (1, 0, 0, True, 0)]


def _members(spark):
    return cmp.pair_members(spark.createDataFrame([(0, 1, 2)], "pair_idx bigint, run_a bigint, run_b bigint"))


def test_setup_order_and_stack(spark):
    setup = spark.createDataFrame(
        [(1, "lib_a", "Frame", 5), (1, "lib_a", "Session", 7), (2, "lib_b", "Session", 11),
         (2, "lib_b", "Context", 13), (2, "lib_b", "Frame", 17)],
        "run_id bigint, library string, event string, setup_us bigint")
    stack = cmp.setup_stack(cmp.setup_comparison(setup, _members(spark)))
    assert rows_of(stack, "ord", "event", "a_us", "b_us", "a_base_us", "b_base_us") == [
        (0, "Frame", 5, 17, 0, 0), (1, "Session", 7, 11, 5, 17), (2, "Context", 0, 13, 12, 28)]


SUMMARY = "run_id bigint, library string, model string, train_us bigint, test_us bigint, " \
          "train_acc double, test_acc double, setup_us bigint"


@pytest.fixture
def summary(spark):
    return spark.createDataFrame(
        [(1, "lib_a", "ones", 1, 2, 1.0, 1.0, 9), (2, "lib_b", "ones", 3, 4, 1.0, 1.0, 8),
         (1, "lib_a", "none", 1, -1, -1.0, -1.0, 9), (2, "lib_b", "none", 3, -1, -1.0, -1.0, 8),
         (1, "lib_a", "real", 1, 2, 0.5, 0.25, 9), (2, "lib_b", "real", 3, 4, 0.75, -1.0, 8),
         (1, "lib_a", "lonely", 1, 2, 0.5, 0.25, 9)], SUMMARY)


def test_comparisons_hide_products_of_one(spark, summary):
    times = cmp.model_time_comparison(summary, _members(spark))
    assert rows_of(times, "model", "train_us_a", "train_us_b") == [
        ("none", 1, 3), ("ones", 1, 3), ("real", 1, 3)]
    accs = cmp.model_accuracy_comparison(summary, _members(spark))
    assert rows_of(accs) == [(0, "real", 0.5, 0.75, 0.25, -1.0)]


def test_metrics_over_a_dimension(spark, summary):
    metrics = cmp.long_metrics(summary)
    assert metrics.count() == 35
    with pytest.raises(ValueError):
        cmp.select_metric(metrics, "Memory")
    accuracies = cmp.select_metric(metrics, "Accuracy")
    dims = spark.createDataFrame([(1, 36000), (2, 36000)], "run_id bigint, dimension bigint")
    got = cmp.dimension_comparison(accuracies, dims).filter("model = 'real'")
    assert rows_of(got, "metric", "dimension", "value_a", "value_b") == [
        ("test_acc", 36000, 0.25, -1.0), ("train_acc", 36000, 0.5, 0.75)]
    some = spark.createDataFrame([(1, "lib_a", "m", "Runtime(Sec)", "train_us", -1.0),
                                  (2, "lib_a", "m", "Runtime(Sec)", "train_us", 12.5)],
                                 "run_id bigint, library string, model string, result_type string, metric string, value double")
    assert rows_of(cmp.dimension_comparison(some, dims), "value_a", "value_b", "failures_a", "failures_b") == [
        (12.5, None, 1, 0)]
    lonely = cmp.dimension_comparison(metrics, dims).filter("model = 'lonely' and metric = 'train_us'")
    assert rows_of(lonely, "value_a", "value_b") == [(1e-6, None)]
    series = cmp.interleaved_series(_members(spark), dims, {"lib_a": "A", "lib_b": "B"})
    assert rows_of(series) == [(0, "36000_A", 1), (1, "36000_B", 2)]


def test_setup_times_stack_over_a_dimension(spark):
    setup = spark.createDataFrame(
        [("r1", "lib_a", "x", 2_000_000), ("r1", "lib_a", "z", 1_000_000), ("r2", "lib_b", "x", 4_000_000), ("r2", "lib_b", "y", 500_000),
         ("r3", "lib_a", "x", 6_000_000), ("r4", "lib_b", "y", 100_000), ("r5", "lib_a", "x", 9_000_000)],
        "run_id string, library string, event string, setup_us bigint")
    members = spark.createDataFrame([(0, "r1", "lib_a"), (0, "r2", "lib_b"), (1, "r3", "lib_a"), (1, "r4", "lib_b")],
                                    "pair_idx int, run_id string, library string")
    dimensions = spark.createDataFrame([("r1", 10), ("r2", 10), ("r3", 20), ("r4", 20), ("r5", 20)], "run_id string, dimension int")
    got = cmp.setup_by_dimension(setup, members, dimensions).orderBy("dimension", "ord").collect()
    assert [tuple(r) for r in got] == [
        (10, "x", True, 2.0, 4.0, 0, 0.0, 0.0), (10, "y", False, 0.0, 0.5, 1, 2.0, 4.0), (10, "z", False, 1.0, 0.0, 2, 2.0, 4.5),
        (20, "x", True, 6.0, 0.0, 0, 0.0, 0.0), (20, "y", False, 0.0, 0.1, 1, 6.0, 0.0)]
