"""Cases that once gave wrong results without an error."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fityard.llm import line_dedup, minhash_join, mixing, suffix_dedup
from tests.llm.test_llm import brute_lines, brute_repeats, table


@pytest.mark.parametrize("ids", [(5, 1 << 39), (1, 2199023255553), (1099511627777, 1099511627778), (-(1 << 63), (1 << 63) - 1)])
def test_line_places_of_any_id(spark, ids):
    rows = [(ids[0], "a first line of some words\nthe line that both have"), (ids[1], "the line that both have\nits own one")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute_lines(rows)
    assert got[ids[1]]["n_removed"] == 1 and {r["class_id"] for r in got.values()} == {ids[0]}


def test_near_lines_of_any_id(spark):
    base = [f"w{i}" for i in range(20)]
    rows = [((1 << 62) + 7 * i, " ".join(base[:i % 20] + [f"x{i}"] + base[i % 20 + 1:])) for i in range(30)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i: r["text"] for i, r in got.items()} == brute_lines(rows)
    assert min(r["class_id"] for r in got.values()) >= 1 << 62


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_near_the_threshold_at_all_sizes(spark, seed):
    """Prefix places, sizes and parities (of 64 bits and wider) cut no pair that brute force finds."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        size = rng.choice([2, 4, 5, 9, 10, 18, 20, 40, 95, 97, 130])
        start = rng.choice([0, 0, 1, 2, size // 9, size // 5])
        rows.append((i, " ".join(f"w{n}" for n in range(start, start + size))))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)


def test_near_duplicates_of_an_id_with_several_texts(spark):
    base = [f"w{i}" for i in range(80)]
    other = [f"x{i}" for i in range(80)]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (2, " ".join(base + ["more"])), (3, " ".join(other + ["more"])),
            (4, "nothing like those at all")]
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


@pytest.mark.parametrize("size", [1, 8, 1000])
def test_repeats_whatever_the_batches(spark, size):
    rng = random.Random(size)
    part = ["".join(rng.choices("abcdefgh ", k=n)) for n in (150, 240, 90, 400)]
    rows = [(i, "".join(rng.choices(part, k=rng.randint(1, 5)))) for i in range(60)]
    want = brute_repeats([(i, t.encode()) for i, t in rows], 100)
    frame = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(frame).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed, wanted", [(0, (0.85, 0.10, 0.05)), (1, (0.0, 0.0, 1.0)), (3, (0.2, 0.7, 0.1)),
                                          (4, (0.05, 0.05, 3.0)), (5, (0.5, np.nan, 0.1))])
def test_rates_are_at_the_least_squares_optimum(spark, seed, wanted):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.5, 0.5, 0.1], size=60)
    tokens = rng.integers(0, 500, 60)
    members = spark.createDataFrame([(int(t), [float(v) for v in q]) for t, q in zip(tokens, p)],
                                    "n_tokens bigint, posteriors array<double>").repartition(4)
    targets = np.array(wanted) * tokens.sum()
    rate = mixing.replay(p, mixing.fit_rates(members, targets))
    assert (rate >= 0).all()
    gap = np.nan_to_num(targets - (rate * tokens) @ p)
    push, scale = p @ gap, np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1]
    # Convex, so this is the optimum: nothing that is above 0 is pushed, nothing at 0 is pushed upwards.
    far = np.abs(rate - np.maximum(0.0, rate + push / scale)) @ tokens
    assert far <= 2e-6 * np.nansum(targets)


def test_documents_are_mixed_as_often_as_told(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    told = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels).collect()}
    got = {r["doc_id"]: r["count"] for r in mixing.mixed_documents(docs, labels).groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in told.items() if n}


def test_pipeline_stages_on_an_empty_table(spark, sf_dir):
    docs = table(spark, "documents")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs.limit(0), sf_dir)
        assert got.count() == 0
        assert name.startswith("bpe") or set(got.columns) == set(docs.columns)


def test_stages_count_rows_of_odd_tables(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "some words without an id", "en", "s", 24), (2, "", "en", "s", 0),
            (2, "", "en", "s", 0), (3, "a line\na line", None, "s", 13)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["line dedup"](spark, docs, sf_dir).filter(F.col("doc_id") == 3).first()["text"] == "a line\n"
    assert stages["minhash near-dedup"](spark, docs, sf_dir).count() == len(rows)
    coded = stages["bpe encoding and decoding"](spark, docs, sf_dir).collect()
    assert sorted(r["n_tokens"] for r in coded)[:3] == [0, 0, 0] and len(coded) == len(rows)
