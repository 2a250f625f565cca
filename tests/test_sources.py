import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fityard.functions.ordering import file_order_index
from fityard.plans import fixtures, source_plans
from fityard.sources import (
    batch_featurize, byte_histogram, chunk_table, export_feature_csv, feature_csv, index_feature_csv, label_from_filename,
    read_items, read_prefix, read_run_files, read_run_logs, scan_feature_csv, write_run_files,
    write_run_logs)
from fityard.sources.feature_csv import _files_of_prefix
from fityard.spec import DatasetSpec
from tests.conftest import rows_of

SPEC = DatasetSpec("t", num_cols=2, chunk_rows=10)


def _csv(folder, n, files=3):
    folder.mkdir()
    lines = [f"{i % 2},{i},{i * 0.1}\n" for i in range(n)]
    cuts = [n * f // files for f in range(files + 1)]
    for f in range(files):
        (folder / f"part-{f}.csv").write_text("".join(lines[cuts[f]:cuts[f + 1]]))
    return str(folder)


def test_scanned_files_need_no_shuffle(spark, tmp_path, monkeypatch):
    lines = [(i // 7, i % 7, i % 11, i % 5, 100.0 * i, 1.0 + i % 50, 0.01 * (i % 9), 0.01 * (i % 8)) for i in range(300, 0, -1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice double, "
                          "l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = rows_of(fixtures.susy(spark, str(tmp_path)).select(*fixtures.SUSY_KEYS, "target", "`0`", "`1`", "`2`", "`3`"))
    ordered = file_order_index(scan_feature_csv(spark, fixtures.susy_csv(spark, str(tmp_path)), fixtures.FILE_SPEC))
    keys = [r[:5] for r in fixtures.file_rows(ordered).orderBy("row_idx").collect()]
    assert keys == sorted(keys) and len(keys) == 300

    def refused(*_):
        raise AssertionError("rows that are only scanned were sorted")

    monkeypatch.setattr(type(ordered), "repartitionByRange", refused)
    monkeypatch.setitem(fixtures._made, (spark.sparkContext.applicationId, "susy_csv", str(tmp_path)), "nowhere")
    assert rows_of(source_plans._scan(spark, str(tmp_path))) == want


def test_scan_uses_the_fixed_schema(spark, tmp_path):
    df = scan_feature_csv(spark, _csv(tmp_path / "a", 30), SPEC)
    assert df.columns == ["target", "0", "1"] and df.count() == 30
    assert {t for _, t in df.dtypes} == {"double"}


@pytest.mark.parametrize("line", ["1,2\n", "1,2,3,4\n", "1,two,3\n"])
def test_rows_of_another_shape_fail(spark, tmp_path, line):
    (tmp_path / "bad.csv").write_text("1,2,3\n" + line)
    with pytest.raises(Exception):
        scan_feature_csv(spark, str(tmp_path / "bad.csv"), SPEC).collect()


@pytest.mark.parametrize("n", [100, 50, 33])
def test_prefix_keeps_what_exists(spark, tmp_path, n):
    got = read_prefix(spark, _csv(tmp_path / "a", n), SPEC, n_train=3, n_test=2)
    assert rows_of(got.select("row_idx", F.col("`0`").cast("int"))) == [(i, i) for i in range(min(n, 50))]


def test_prefix_reads_only_the_files_it_needs(spark, tmp_path):
    path = _csv(tmp_path / "a", 1000, files=20)
    files = _files_of_prefix(spark, path, SPEC, 160)
    assert [f.split("/")[-1] for f in files] == [f"part-{i}.csv" for i in (0, 1, 10, 11, 12, 13, 14)]
    assert read_prefix(spark, path, SPEC, n_train=3, n_test=2).count() == 50


def _splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)


@pytest.mark.parametrize("size", [300, 1000, 10_000_000])
def test_prefix_of_an_index_equals_the_plain_one(spark, tmp_path, size):
    path = _csv(tmp_path / "a", 1000, files=4)
    index = index_feature_csv(spark, path)
    assert index.agg(F.sum("rows")).first()[0] == 1000 and (tmp_path / "a" / "_row_counts").is_dir()
    assert scan_feature_csv(spark, path, SPEC).count() == 1000
    try:
        _splits(spark, size)  # other splits than those of the index
        for n_train, n_test in ((1, 1), (20, 5), (24, 1), (25, 1), (60, 30), (200, 1)):
            got = read_prefix(spark, path, SPEC, n_train, n_test, index=index)
            want = min(1000, (n_train + n_test) * 10)
            assert rows_of(got.select("row_idx", F.col("`0`").cast("int"))) == [(i, i) for i in range(want)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_prefix_of_one_large_file_parses_little_more_than_itself(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "one.csv").write_text("".join(f"{i % 2},{i},{i * 0.25}\n" for i in range(100_000)) + "\n1,broken\n")
    try:
        _splits(spark, 10_000)
        index = index_feature_csv(spark, str(folder))
        assert index.count() > 100
        lines = feature_csv._indexed_prefix(spark, str(folder), index, 1000)
        assert 1000 <= lines.count() < 3000
        got = read_prefix(spark, str(folder), SPEC, 80, 20, index=index)  # the broken line is never parsed
        assert rows_of(got.select("row_idx", F.col("`0`").cast("int"))) == [(i, i) for i in range(1000)]
        with pytest.raises(Exception):
            read_prefix(spark, str(folder), SPEC, 20_000, 1, index=index).count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stale_indexes_are_errors(spark, tmp_path):
    path = _csv(tmp_path / "a", 100, files=2)
    index = index_feature_csv(spark, path, str(tmp_path / "index")).cache()
    assert read_prefix(spark, path, SPEC, 3, 2, index=index).count() == 50
    (tmp_path / "a" / "part-2.csv").write_text("1,2,3\n")
    with pytest.raises(ValueError, match="part-2"):
        read_prefix(spark, path, SPEC, 3, 2, index=index)


def test_prefix_needs_chunks_on_both_sides(spark, tmp_path):
    path = _csv(tmp_path / "a", 30)
    for n_train, n_test in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            read_prefix(spark, path, SPEC, n_train, n_test)


def test_chunk_table(spark, tmp_path):
    rows = read_prefix(spark, _csv(tmp_path / "a", 45), SPEC, n_train=3, n_test=2)
    table = chunk_table(rows, 10, 3, str(tmp_path / "chunks"))
    got = table.groupBy("split", "chunk_id", "chunk_pos").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first"))
    assert rows_of(got) == [("test", 3, 0, 10, 30), ("test", 4, 1, 5, 40), ("train", 0, 0, 10, 0),
                            ("train", 1, 1, 10, 10), ("train", 2, 2, 10, 20)]
    one_by_one = chunk_table(rows.coalesce(2), 1, 30, str(tmp_path / "small"))
    assert one_by_one.select("chunk_id").distinct().count() == 45
    assert len(list((tmp_path / "small").glob("*.parquet"))) <= 2


def test_label_from_filename(spark):
    paths = ["/a/b.c/cat.12.jpg", "dog.1.jpg", "s3://x/plain", "/a/.hidden", "/a/"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r[0] for r in df.select(label_from_filename("path")).collect()] == [
        "cat", "dog", "plain", "", ""]


def test_images_to_features_to_csv(spark, tmp_path):
    folder = tmp_path / "img"
    folder.mkdir()
    contents = {"cat.0.jpg": bytes([0, 0, 255]), "dog.1.jpg": bytes([7]), "cat.2.jpg": bytes(range(256)) * 3}
    for name, content in contents.items():
        (folder / name).write_bytes(content)
    items = read_items(spark, str(folder)).withColumn("label", label_from_filename("path"))
    feats = batch_featurize(items.select("path", "content"), byte_histogram("path", "content"),
                            "path string, features array<double>")
    for row in feats.collect():
        want = np.bincount(np.frombuffer(contents[row["path"].split("/")[-1]], np.uint8), minlength=256)
        assert row["features"] == want.tolist()
    out = str(tmp_path / "csv")
    labelled = items.select("path", "label").join(feats, "path")
    for _ in range(2):
        export_feature_csv(labelled, out, "label", "features", 4)
    lines = [r[0] for r in spark.read.text(out).collect()]
    assert sorted(lines) == ["cat,2.0,0.0,0.0,0.0"] * 2 + ["cat,3.0,3.0,3.0,3.0"] * 2 \
        + ["dog,0.0,0.0,0.0,0.0"] * 2


LOG = [{"event": "Library", "value": "lib_a", "execution_time": 0, "start_time": "2024-01-01 00:00:00",
        "start_time_epoch": 1.25},
       {"event": "Start", "value": None, "execution_time": 0.5, "start_time": "2024-01-01 00:00:00",
        "start_time_epoch": 1.5},
       {"event": "Result", "value": True, "execution_time": 0, "start_time": "2024-01-01 00:00:01",
        "start_time_epoch": 2.0}]


def test_foreign_logs_keep_order_and_take_their_file_name(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(LOG, indent=4))
    (tmp_path / "two.json").write_text(json.dumps(LOG[:1]))
    got = rows_of(read_run_files(spark, str(tmp_path)), "run_id", "pos", "event")
    assert got == [("one", 0, "Library"), ("one", 1, "Start"), ("one", 2, "Result"), ("two", 0, "Library")]
    values = {r["pos"]: r["value"] for r in read_run_files(spark, str(tmp_path / "one.json")).collect()}
    assert values == {0: "lib_a", 1: None, 2: "true"}


@pytest.mark.parametrize("segment", [1, 3, 10_000])
def test_log_round_trip(spark, out_dir, segment):
    rows = [(r, p, f"e{p}", None if p % 4 == 0 else f"v{p}", p / 8) for r in (1, 2)
            for p in range(10 * r)]
    events = spark.createDataFrame(
        rows, "run_id bigint, pos bigint, event string, value string, start_time_epoch double")
    for write, read, name in ((write_run_logs, read_run_logs, "/bulk"), (write_run_files, read_run_files, "/files")):
        write(events.repartition(3), out_dir + name, segment_events=segment)
        got = read(spark, out_dir + name, segment_events=segment)
        assert rows_of(got.select(F.col("run_id").cast("bigint"), "pos", "event",
                                  F.coalesce("value", F.lit("")), "start_time_epoch")) == sorted(
            (r, p, e, v or "", t) for r, p, e, v, t in rows)


def test_run_files_have_no_folders_and_tasks_for_nothing(spark, out_dir):
    events = spark.range(600).select((F.col("id") % 60).alias("run_id"), F.expr("id div 60").alias("pos"), F.lit("e").alias("event"))
    write_run_files(events, out_dir + "/one", segment_events=10)
    files = [r["file"].split("/one/")[1] for r in feature_csv._listing(spark, out_dir + "/one/*").collect()]
    assert len(files) == 60 and all(f.count("/") == 1 for f in files)
    tasks = {f.split("/part-")[1].split("-")[0] for f in files}
    assert len(tasks) > spark.sparkContext.defaultParallelism
    write_run_files(events, out_dir + "/two", segment_events=6)
    assert feature_csv._listing(spark, out_dir + "/two/*/*").count() == 120
    want = rows_of(events.select(F.col("run_id").cast("string"), "pos", "event"))
    for folder in ("/one", "/two"):
        assert rows_of(read_run_files(spark, out_dir + folder), "run_id", "pos", "event") == want


def test_run_files_are_what_a_run_writes(spark, out_dir):
    rows = [(7, p, e["event"], {True: "true"}.get(e["value"], e["value"]), float(e["execution_time"]), e["start_time"],
             e["start_time_epoch"]) for p, e in enumerate(LOG)]
    schema = ("run_id bigint, pos bigint, event string, value string, execution_time double, start_time string, "
              "start_time_epoch double")
    odd = [(8, 0, 'quote " back \\ brace }\n    }', "true", 0.1, "x", 1e300), (8, 1, "Result", "false", None, None, None)]
    write_run_files(spark.createDataFrame(rows + odd, schema), out_dir)
    files = {r["p"].split("run_id=")[1].split("/")[0]: r["value"] for r in spark.read.option(
        "recursiveFileLookup", True).text(out_dir, wholetext=True).select("value", F.col("_metadata.file_path").alias("p")).collect()}
    assert files["7"].rstrip("\n") == json.dumps([{**e, "execution_time": float(e["execution_time"])} for e in LOG], indent=4)
    assert json.loads(files["8"])[0]["event"] == odd[0][2] and json.loads(files["8"])[1]["value"] is False
    got = read_run_files(spark, out_dir).orderBy("run_id", "pos").collect()
    assert [tuple(r) for r in got] == [(str(r[0]), *r[1:]) for r in rows + odd]


@pytest.mark.parametrize("size", [100, 1000, 100_000])
def test_long_logs_are_read_in_pieces(spark, tmp_path, size):
    log = [{"event": f"e{i} }}", "value": "x" * (i % 40) if i % 3 else None, "execution_time": i / 4,
            "start_time": "t", "start_time_epoch": float(i)} for i in range(500)]
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.json").write_text(json.dumps(log, indent=4) + "\n")
    (tmp_path / "b" / "short.json").write_text(json.dumps(log[:7]))
    (tmp_path / "b" / "none.json").write_text("[]")
    try:
        _splits(spark, size)
        got = read_run_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
        assert rows_of(got, "run_id", "pos", "event", "start_time_epoch") == sorted(
            (run, i, e["event"], e["start_time_epoch"]) for run, n in (("a/run", 500), ("b/run", 500), ("b/short", 7))
            for i, e in enumerate(log[:n]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("cut", [3, 40, 250, 700])
def test_a_log_cut_short_is_an_error(spark, tmp_path, cut):
    text = json.dumps(LOG * 2, indent=4)
    (tmp_path / "one.json").write_text(text[:-cut])
    with pytest.raises(Exception):
        read_run_files(spark, str(tmp_path)).collect()


def test_log_ending_at_an_element_is_an_error(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(LOG, indent=4)[:-2])
    with pytest.raises(Exception):
        read_run_files(spark, str(tmp_path)).collect()


def test_equal_file_names_in_two_folders_are_two_runs(spark, tmp_path):
    for plan in ("a b", "c+d"):
        (tmp_path / plan).mkdir()
        (tmp_path / plan / "lib.json").write_text(json.dumps(LOG))
    got = rows_of(read_run_files(spark, [str(tmp_path / "a b"), str(tmp_path / "c+d")]), "run_id", "pos")
    assert got == [(f"{plan}/lib", p) for plan in ("a b", "c+d") for p in range(3)]


def test_broken_logs_are_errors(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(LOG)[:-20])
    with pytest.raises(Exception):
        read_run_files(spark, str(tmp_path / "one.json")).collect()
    (tmp_path / "bulk").mkdir()
    (tmp_path / "bulk" / "x.json").write_text('{"run_id": "1", "segment": 0, "events": [{"event": "a"')
    with pytest.raises(Exception):
        read_run_logs(spark, str(tmp_path / "bulk")).collect()


def test_segments_know_their_first_position(spark, out_dir):
    rows = [(1, p, f"e{p}") for p in range(25)]
    write_run_logs(spark.createDataFrame(rows, "run_id bigint, pos bigint, event string"), out_dir, 4)
    assert rows_of(read_run_logs(spark, out_dir, "bigint"), "run_id", "pos", "event") == rows


def test_prefix_of_a_path_with_odd_characters(spark, tmp_path):
    path = _csv(tmp_path / "a b%20+c", 60, files=4)
    got = read_prefix(spark, path, SPEC, n_train=3, n_test=2)
    assert got.count() == 50
