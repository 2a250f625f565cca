"""Token alignment, pairwise quality and importance resampling against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fityard.llm import importance, quality_ranking, token_alignment
from fityard.llm.byte_bpe import _byte_chars
from fityard.llm.queries import PIECES, VOCABULARY
from tests.llm.test_llm import ODD, SCHEMA

LOWER = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# token alignment

def spans_by_hand(text, a, b):
    """Tokens of both sides as (id, bytes), or nothing if they don't give back the text."""
    if not text:
        return [], []
    byte_of = _byte_chars()
    left = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(left.ids, left.tokens)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
             for i in b.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if b"".join(t for _, t in left) == b"".join(t for _, t in right) == whole else ([], [])


def aligned_by_hand(texts):
    a = Tokenizer.from_file(VOCABULARY)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found, count = [], Counter()
    for text in texts:
        left, right = spans_by_hand(text, a, b)
        ends = []
        for side in (left, right):
            at, out = 0, []
            for i, t in side:
                out.append((at, at + len(t), i))
                at += len(t)
            ends.append(out)
        by_end = {e: i for _, e, i in ends[1]}
        links = [(i, by_end[e]) for _, e, i in ends[0] if e in by_end]
        count.update(links)
        cuts = sorted({e for _, e, _ in ends[0]} & set(by_end))
        groups, begin = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if s >= begin and e <= cut) for side in ends)
                          if len(cuts) < 300 else None)
            begin = cut
        overlaps = sum(s < f and t < e for s, e, _ in ends[0] for t, f, _ in ends[1]) if len(cuts) < 300 else None
        found.append((len(left), len(right), links, groups, overlaps))
    top = defaultdict(int)
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(na, nb, len(g), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls), o,
             None if None in g else ";".join(g)) for na, nb, ls, g, o in found]


def check_alignment(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r for r in token_alignment.aligned_documents(rows, VOCABULARY, PIECES).collect()}
    kept = {r["id"]: r["groups"] for r in token_alignment.align_documents(rows, VOCABULARY, PIECES).collect()}
    for i, (na, nb, groups, links, best, total, overlaps, text) in enumerate(aligned_by_hand(texts)):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (
            na, nb, groups, links, best, total), texts[i][:80]
        assert overlaps is None or r["n_overlaps"] == overlaps
        if text is not None:
            assert kept[i] == text
        assert r["groups_sha256"] == (hashlib.sha256(kept[i].encode()).hexdigest() if na else "")


def test_alignment_against_brute_force(spark, docs):
    check_alignment(spark, [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()])


def test_alignment_of_random_texts(spark):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "the", " The", "é", "ñü", "日本", "😀", "▁", "'s", "12", "<s>", "<|endoftext|>", "<0x41>",
             "\x1c", " ", "é", "\x00", ".", "ing", "ABC", "　", "​", "ﬁ"]
    check_alignment(spark, ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "\n \n"])


def test_alignment_of_texts_longer_than_a_slab(spark, monkeypatch):
    long = " ".join(f"word{i % 977} été" for i in range(100_000))
    assert len(long) > token_alignment.SLAB
    check_alignment(spark, [long, "short one", long + " ▁ ", "x" * 3000 + " y", long])


def test_alignment_of_odd_rows(spark, odd, empty):
    got = token_alignment.aligned_documents(odd, VOCABULARY, PIECES)
    assert got.count() == len(ODD) and got.filter("n_links is null or groups_sha256 is null").isEmpty()
    assert {r["n_a"] for r in got.filter("doc_id in (1, 2)").collect()} == {0}
    twice = got.filter("doc_id = 4").drop("doc_id").distinct().collect()
    assert len(twice) == 1 and twice[0]["n_links"] > 0
    assert got.filter("doc_id is null").first()["n_a"] > 0
    assert token_alignment.aligned_documents(empty, VOCABULARY, PIECES).isEmpty()


def test_overlaps_of_both_directions():
    frame = lambda *rows: pd.DataFrame(rows, columns=["doc", "start", "end"]).astype("int64")
    a = frame((0, 0, 2), (0, 2, 6), (1, 6, 7))
    b = frame((0, 0, 3), (0, 3, 4), (0, 4, 6), (1, 6, 7))
    got = {(r.a, r.b, bool(r.ends)) for r in token_alignment.overlaps(a, b).itertuples()}
    assert got == {(0, 0, False), (1, 0, False), (1, 1, False), (1, 2, True), (2, 3, True)}


def test_pairs_of_ids(spark, docs):
    aligned = token_alignment.align_documents(docs, VOCABULARY, PIECES)
    pairs = token_alignment.id_pairs(aligned, VOCABULARY, PIECES).toPandas()
    total = token_alignment.aligned_documents(docs, VOCABULARY, PIECES).agg({"n_links": "sum"}).first()[0]
    assert pairs.n.sum() == total and (pairs.groupby("b").n.transform("max").eq(pairs.n) == pairs.best).all()


# pairwise quality

def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_ranking.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(scored) > 50 and scored.score.between(0, 1).all()
    a, b = (scored[scored.quality == q].score.to_numpy() for q in (1, 0))
    assert (a[:, None] > b[None]).mean() > 0.97
    assert (scored.predicted == scored.quality).mean() > 0.95
    assert ((scored.score >= 0.7) == (scored.predicted == 1)).all()


def test_preference_pairs():
    for label in ([1, 1, 1, 0, 0], [0, 0, 0, 0, 1], [1, 0], [1, 1], [], [1] * 50 + [0] * 9):
        label = np.array(label)
        win, lose = quality_ranking._partners(label)
        assert (label[win] == 1).all() and (label[lose] == 0).all()
        assert len(set(zip(win, lose))) == len(win)
        if 0 < label.sum() < len(label):
            assert set(win) | set(lose) == set(range(len(label)))


def test_ranking_learns_from_differences_only(spark):
    rows = [(i, f"{'plain words of a text' if i % 3 else 'BUY!!! NOW$$$ %%%'} number {i % 11} here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id bigint, quality int")
    got = quality_ranking.score(docs, labels).toPandas()
    assert ((got.doc_id % 3 > 0) == (got.predicted == 1)).all()
    same = quality_ranking.score(docs.repartition(5), labels.repartition(3)).toPandas()
    pd.testing.assert_frame_equal(got.sort_values("doc_id", ignore_index=True), same.sort_values("doc_id", ignore_index=True))
    best = quality_ranking.best_documents(docs.withColumn("row", docs.doc_id), labels, 0.5)
    assert best.columns == ["doc_id", "text", "row"] and 0.3 <= best.count() / 300 <= 0.7
    assert best.filter("doc_id % 3 = 0").isEmpty()


def test_quantile_threshold(spark):
    values = [float(v) for v in np.random.default_rng(1).normal(size=2000)] + [5.0] * 1000
    rows = spark.createDataFrame([(v,) for v in values], "utility double")
    for level in (0.1, 0.5, 0.66):
        cut = quality_ranking.quantile_threshold(rows, level)
        assert abs((np.array(values) < cut).mean() - level) < 0.002
    assert 3 < quality_ranking.quantile_threshold(rows, 0.66, 0.01) < 5  # the gap below the many equal ones
    assert quality_ranking.quantile_threshold(rows.limit(0), 0.5) == 0.0


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (6, 0), (None, 1), (7, 9), (1, 1)], "doc_id bigint, quality int")
    got = quality_ranking.score(odd, labels)
    assert got.count() == len(ODD) and got.filter("score is null or predicted is null").isEmpty()
    assert got.filter("doc_id in (5, 6)").select("score").distinct().count() == 1
    assert quality_ranking.score(empty, labels).isEmpty()
    assert {r[0] for r in quality_ranking.score(odd, labels.limit(0)).select("score").collect()} == {0.5}
    assert quality_ranking.best_documents(odd, labels, 0.5).columns == odd.columns


def test_quality_of_long_texts(spark):
    long = "some words of a long text\n" * 120_000
    rows = spark.createDataFrame([(i, long if i % 2 else "A!! B!! C!!") for i in range(12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    got = quality_ranking.score(rows, labels).toPandas()
    assert ((got.predicted == 1) == (got.doc_id % 2 == 1)).all()


# importance resampling

def features_by_hand(text, n_words):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [" ".join(w[i:i + n]) for n in range(1, n_words + 1) for i in range(len(w) - n + 1)]


def resampled_by_hand(rows, target, n_words, n_buckets=10_000, percent=10, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    own = [(i, *features_by_hand(t, n_words)) for i, t in rows]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for x in target for f in features_by_hand(x, n_words)[1])
    big_s, big_t = sum(s.values()) + n_buckets, sum(t.values()) + n_buckets
    out = []
    for i, n, fs in own:
        total = sum(floor(1000 * log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = total // len(fs) if fs else 0
        out.append([i, len(fs), weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    rank = {id(r): k for k, r in enumerate(fit[:percent * len(fit) // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def as_rows(df):
    return sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n_words, percent", [(1, 10), (2, 35), (3, 100)])
def test_resampling_against_brute_force(spark, docs, n_words, percent):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = importance.resample(docs, target, n_words=n_words, percent=percent)
    want = resampled_by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()],
                             n_words, percent=percent)
    assert as_rows(got) == want
    assert {t for _, t in got.dtypes} == {"bigint"}


def test_resampling_ties_and_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([("ein langer Satz",), (None,), ("",)], "text string")
    for n_words, least in ((1, 1), (2, 3)):
        got = importance.resample(odd, target, percent=50, least_words=least, n_words=n_words)
        assert as_rows(got) == resampled_by_hand([(r[0], r[1]) for r in ODD], ["ein langer Satz"], n_words, percent=50, least=least)
    assert importance.resample(empty, target).isEmpty()
    assert importance.resample(odd, empty).filter("rank is not null").isEmpty()
    many = spark.createDataFrame([(3, "one two three")] * 40, "doc_id bigint, text string").withColumn("score", importance.F.lit("x"))
    ranks = [r["rank"] for r in importance.resample(many, target, percent=50, least_words=2).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 21))


def test_words_over_cuts_of_long_texts():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abÉé9", k=rng.randint(1, 12))) for _ in range(40_000)) + "z" * 200_000 + " Q?q"
    assert [w for part in importance.words_of(text) for w, _ in part] == re.findall(importance.WORD, text.translate(LOWER))
    n, got = importance.text_buckets(text, 3, 1000)
    words, features = features_by_hand(text, 3)
    assert n == words and got == Counter(zlib.crc32(f.encode()) % 1000 for f in features)
