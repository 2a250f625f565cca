"""The training-data operators against brute force, exact round trips and held-out labels, on small tables."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from fityard.llm import (byte_bpe, fingerprints, language_id, line_dedup, minhash_join, mixing, multi_index,
                         suffix_dedup, text_classifier, toxicity, url_filter)
from fityard.llm.queries import URL_RULES, VOCABULARY

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint, row string"
ODD = [  # nulls anywhere, empty, blank, repeated rows and clashing names
    (1, None, "en", "a", None, 0.5, 7, "x"), (2, "", None, "a", 0, None, None, None),
    (3, " \n\t ", "en", None, 3, 0.1, 1, "y"), (4, "One line here\nOne line here\nand then another one of them", "en", "b", 1, 0.1, 1, ""),
    (4, "One line here\nOne line here\nand then another one of them", "en", "b", 1, 0.1, 1, ""),
    (None, "a row without an id that is kept as it is", "de", "b", 1, 0.1, 1, ""),
    (5, "ein langer Satz " * 4000, "de", "b", 1, 0.1, 1, ""), (6, "ein langer Satz " * 4000, "de", "c", 1, 0.1, 1, ""),
    (7, "€ü😀 \x00 <|endoftext|> it's  two   spaces ", "xx", "c", 1, 0.1, 1, ""),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


# toxicity and mixing

def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(scored) > 50 and scored.score.between(0, 1).all()
    a, b = (scored[scored.toxic == t].score.to_numpy() for t in (1, 0))
    assert (a[:, None] > b[None]).mean() > 0.9
    assert ((scored.predicted == 1) & (scored.toxic == 0)).mean() < 0.02


def test_swap_penalty_evens_out_identity_words(spark):
    rows = [(f"{'idiot' if i % 4 == 0 else 'flower'} {'muslims' if i % 4 < 2 else 'people'} word{i % 7}", int(i % 4 == 0))
            for i in range(200)]
    texts = spark.createDataFrame(rows, "text string, label int")
    swaps = toxicity.swap_pairs([["people", "muslims"]])

    def gap(weight):
        model = text_classifier.fit(texts, [0, 1], swaps, swap_weight=weight)
        p = model.posteriors(pa.array(["muslims word1", "people word1"]))[:, 1]
        return abs(p[0] - p[1]), model.posteriors(pa.array(["idiot word1"]))[0, 1]

    (free, _), (held, toxic) = gap(0.0), gap(10.0)
    assert held < free / 2 and toxic > 0.5


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (7, 9)], "doc_id bigint, toxic int")
    got = toxicity.score(odd, labels)
    assert got.count() == len(ODD) and got.filter("score is null or predicted is null").isEmpty()
    assert toxicity.score(empty, labels).isEmpty()
    none = toxicity.score(odd, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert toxicity.clean_documents(odd, labels).columns == odd.columns


def test_mixing_meets_its_targets(spark, docs):
    got = mixing.mix(docs, table(spark, "labels")).toPandas()
    tokens = got.n_tokens.to_numpy()
    share = [(got[f"p_{d}"] * got.rate * tokens).sum() / tokens.sum() for d in mixing.DOMAINS]
    assert np.allclose(share, [0.85, 0.10, 0.05], atol=1e-3) and (got.rate >= 0).all()
    assert (np.abs(got["copies"] - got.rate) < 1).all()
    assert got.set_index("doc_id").n_tokens.to_dict() == {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}


def test_rates_stay_at_zero_where_a_target_is_out_of_reach(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0]), (30, [0.0, 1.0])], "n_tokens bigint, posteriors array<double>")
    steps = mixing.fit_rates(members, np.array([20.0, 0.0]))
    assert np.allclose(mixing.replay(np.eye(2), steps), [2.0, 0.0], atol=1e-3)


def test_mixing_of_odd_rows(spark, odd, empty):
    labels = table(spark, "labels")
    assert mixing.mix(odd, labels).count() == len(ODD)
    assert mixing.mix(empty, labels).isEmpty() and mixing.mixed_documents(empty, labels).isEmpty()
    assert mixing.mixed_documents(odd, labels.limit(0)).columns == odd.columns


# URLs

def test_url_parts():
    assert url_filter.url_parts("HTTP://A.Com:80/x/Y?q#z") == ("a.com:80", "/x/Y")
    assert url_filter.url_parts("x://h#/a") == ("h", "") and url_filter.url_parts("x://?a") == ("", "")
    assert url_filter.url_parts(None) == url_filter.url_parts("no scheme") == ("", "")


def test_url_rules_against_brute_force(spark):
    rng = random.Random(3)
    names, ends = ["a", "b", "com", "net", "example"], ["", "/", "/en", "/en/", "/en/x", "/fr/y"]
    rules = {(".".join(rng.choices(names, k=rng.randint(1, 3))), rng.choice(ends)): rng.choice(["allow", "block"])
             for _ in range(60)}
    urls = [None, "", "://", "x"] + [f"http://{'.'.join(rng.choices(names, k=rng.randint(1, 4)))}{rng.choice(ends)}{t}"
                                     for _ in range(300) for t in ("", "?q=1")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame([(*k, v) for k, v in rules.items()], url_filter.RULE_SCHEMA))
    for r in got.collect():
        h, p = url_filter.url_parts(urls[r["page_id"]])
        fits = [(a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (h, p, *best)


def test_colliding_digests_are_confirmed(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "_digests", lambda keys: np.zeros(len(keys), np.uint64))
    array = url_filter.DigestArray.__new__(url_filter.DigestArray)
    array.keys, array.ends = np.zeros(2, np.uint64), np.array([0, 4, 8])
    array.strings = np.frombuffer(b"com/net/", np.uint8)
    assert array.find(["net/", "com/", "org/"]).tolist() == [1, 0, -1]


def test_url_rules_empty_and_bad(spark):
    pages = spark.createDataFrame([(None, "http://a.com/"), (1, None)], "page_id bigint, url string")
    none = spark.createDataFrame([], url_filter.RULE_SCHEMA)
    assert {r["verdict"] for r in url_filter.judge_urls(pages, none, default="block").collect()} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, url_filter.RULE_SCHEMA)).isEmpty()
    with pytest.raises(Exception, match="not a rule"):
        url_filter.build_index(spark, spark.createDataFrame([("", "/", "block")], url_filter.RULE_SCHEMA))


def test_url_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    rows = con.execute(entry.oracle_sql()["op2_url_digest_array"]).fetchall()
    got = entry.queries()["op2_url_digest_array"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(rows)


# languages

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, docs.filter(~language_id.is_held_out("doc_id"))).join(docs, "doc_id")
    held = out.filter(language_id.is_held_out("doc_id"))
    assert held.filter("lang_pred = lang").count() / held.count() > 0.97


def test_language_mixture_and_odd_rows(spark, odd, empty, docs):
    one, other = (docs.filter(f"lang = '{x}' and n_chars > 2000").first()["text"][:1500] for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, one + "\n" + other)], "doc_id bigint, text string")
    found = language_id.identify(mixed, docs).first()["languages"]
    assert set(found) == {"en", "de"} and abs(found["en"] - 0.5) < 0.15
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, docs).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[5][0] == "de"
    assert language_id.identify(empty, docs).isEmpty()
    assert language_id.identify(odd, empty).filter("lang_pred != 'und'").isEmpty()


# lines

def brute_lines(rows, percent=80):
    lines = [(i, n, frozenset(words(x))) for i, t in rows for n, x in enumerate(t.split("\n")) if words(x)]
    drop = set()
    for k, (i, n, s) in enumerate(lines):
        if any(100 * len(s & v) >= percent * len(s | v) for _, _, v in lines[:k]):
            drop.add((i, n))
    out = {}
    for i, t in rows:
        parts = t.split("\n")
        ended = [p + "\n" for p in parts[:-1]] + parts[-1:]
        out[i] = "".join(p for n, p in enumerate(ended) if (i, n) not in drop)
    return out


def test_lines_against_brute_force(spark, docs):
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == brute_lines(rows)


def test_lines_in_blocks_and_long_ones(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        own = base[: rng.choice([9, 10, 11, 140, 150])]
        for _ in range(rng.randint(0, 3)):
            own = own[:(k := rng.randrange(len(own)))] + [f"x{rng.randrange(30)}"] + own[k + 1:]
        rows.append((i, " ".join(own)))
    sets = {i: frozenset(t.split()) for i, t in rows}
    links = {i: sum(x != y and 100 * len(x & y) >= 80 * len(x | y) for y in set(sets.values()))
             for i, x in sets.items()}
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for wide in (512, 140):  # all pairs in their units; some of them joined with their sets
        monkeypatch.setattr(line_dedup, "WIDE", wide)
        got = line_dedup.dedup_lines(docs).collect()
        assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)
        assert {r["doc_id"]: r["n_links"] for r in got} == links


def test_lines_of_odd_rows(odd, empty):
    got = [(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(odd).collect()]
    assert len(got) == len(ODD)
    assert (1, None, 0) in got and (2, "", 0) in got and (3, " \n\t ", 0) in got and (6, "", 1) in got
    assert got.count((4, "One line here\nand then another one of them", 1)) == 2
    assert line_dedup.dedup_lines(empty).isEmpty()
    assert line_dedup.deduplicated_documents(odd).columns == odd.columns


# fingerprints

def test_fingerprints_estimate_resemblance(spark, docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.neighbour_fingerprints(docs).collect()}
    gaps = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 3
        edited = t[:len(t) - n] + after[:n]
        assert got[i]["edited_text"] == edited and got[i]["n_chars"] == len(t)
        a, b = shingles(t, 5), shingles(edited, 5)
        gaps.append(got[i]["near_edited"] - len(a & b) / max(1, len(a | b)))
    assert abs(np.mean(gaps)) < 0.01 and np.std(gaps) < 0.04


def test_fingerprints_packed_bits_and_odd_rows(spark, odd, empty):
    column = pa.array(["a b c d e f g h", "a b c d e f g h", "", None, "a"])
    for bits in (1, 4, 8):
        f, some = fingerprints.fingerprints(column, 64, bits)
        assert f.shape == (5, 8 * bits) and (f[0] == f[1]).all() and some.tolist() == [True, True, False, False, True]
        near = fingerprints.likeness(f[[0, 0, 2]], some[[0, 0, 2]], f[[1, 2, 3]], some[[1, 2, 3]], bits)
        assert near.tolist() == [1.0, 0.0, 1.0]
    got = fingerprints.neighbour_fingerprints(odd)
    assert got.count() == len(ODD) and got.filter("fingerprint is null or near_next is null").isEmpty()
    assert fingerprints.neighbour_fingerprints(empty).isEmpty()
    assert fingerprints.neighbour_fingerprints(odd.limit(1)).count() == 1


# repeated strings

def brute_repeats(rows, length):
    seen, out = set(), {}
    for i, raw in rows:
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - length + 1):
            if raw[a:a + length] in seen:
                gone[a:a + length] = True
            seen.add(raw[a:a + length])
        out[i] = bytes(np.frombuffer(raw, np.uint8)[~gone])
    return out


def test_repeats_against_brute_force(spark, docs, monkeypatch):
    rows = sorted((r["doc_id"], r["text"].encode()) for r in docs.collect())
    want = brute_repeats(rows, 100)
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs).collect()} == want


def test_interval_expansion_finds_all_long_common_prefixes():
    rng = random.Random(2)
    text = np.frombuffer("".join(rng.choices("ab", k=600)).encode() * 2 + bytes(50) + b"ab" * 100, np.uint8)
    order, like = suffix_dedup.long_common_prefixes(text, 40)
    raw = text.tobytes() + bytes(128)
    assert all(like[k] == (raw[order[k]:order[k] + 40] == raw[order[k - 1]:order[k - 1] + 40]) for k in range(1, len(text)))


def test_repeats_across_sections_and_odd_rows(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SECTION", 700)
    rng = random.Random(4)
    part = ["".join(rng.choices("abcdefgh ", k=n)) for n in (150, 240, 90, 400, 1500)]
    texts = ["".join(rng.choices(part, k=rng.randint(1, 9))) for _ in range(30)] + ["ab" * 700, "b" * 99, "b" * 301]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)], 100)
    rest = suffix_dedup.remove_repeats(odd).collect()
    assert len(rest) == len(ODD) and suffix_dedup.remove_repeats(empty).isEmpty()
    by_id = {r["doc_id"]: r for r in rest}
    assert by_id[1]["n_bytes"] == by_id[2]["n_bytes"] == 0 and by_id[6]["n_removed"] == 64000


# vectors

def test_neighbours_recall_and_odd_rows(spark):
    data = table(spark, "embeddings")
    rows = data.toPandas()
    vec, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = multi_index.search(data).toPandas()
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = vec @ vec[i]
        best = set(ids[np.lexsort((ids, -np.where(ids == ids[i], -np.inf, score)))[:20]])
        mine = got[got.query_id == ids[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and np.allclose(mine.score, [score[ids == v][0] for v in mine.vec_id])
        hit, total = hit + len(best & set(mine.vec_id)), total + 20
    assert hit / total >= 0.9
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
            (6, [0.5, 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0])]
    few = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = multi_index.search(few).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 6, 0.5),
                                       (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 6, 0.5)]
    assert multi_index.search(few.limit(0)).isEmpty()


# BPE

def test_bpe_equals_the_library(docs):
    library, own = Tokenizer.from_file(VOCABULARY), byte_bpe.ByteBpe(VOCABULARY)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "1", "²", "é", "\u00a0", "\u3000", "\x1c", "'s", "'ll", "<|endoftext|>", "!", "..", "😀",
             "\r\n", "中文", "x" * 300, "\x85", "ab", "\t"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    texts += [r["text"] for r in docs.collect()] + ["", "z" * 3000, "ab" * 2000]
    for text, ref in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = np.frombuffer(own.encode(text), "<u4")
        assert ids.tolist() == ref.ids
        assert own.decode(ids) == library.decode(ref.ids, skip_special_tokens=False)


def test_bpe_of_odd_rows(odd, empty):
    got = byte_bpe.encode_documents(odd, VOCABULARY).collect()
    assert sorted((r["decoded"] for r in got)) == sorted((r[1] or "" for r in ODD))
    assert byte_bpe.encode_documents(empty, VOCABULARY).isEmpty()


# near duplicates

def brute_components(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(docs, k):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = minhash_join.near_duplicates(docs, shingle_words=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(own)))
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, 2)


def _counted(monkeypatch):
    """Rows that near_duplicates writes, by the name of the table."""
    rows, write = {}, minhash_join.written

    def written(df, name):
        out = write(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash_join, "written", written)
    return rows


def test_a_large_group_of_near_copies_is_linked_by_few_pairs(spark, monkeypatch):
    counted, rng = _counted(monkeypatch), random.Random(8)
    rows = []
    for i in range(150):
        words = [f"w{k}" for k in range(120)]
        for k in rng.sample(range(120), 7):  # two of them have a similarity about 0.8
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    got = minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle_words=1)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, 1)
    assert counted["first-pairs"] + counted["pairs"] <= 8 * len(rows)  # of 11,175 pairs


def test_postings_grow_with_the_classes_only(spark, monkeypatch):
    counted = _counted(monkeypatch)
    made = []
    for n in (20, 200):
        counted.clear()
        rows = [(i, " ".join(f"d{i}w{k}" for k in range(30))) for i in range(n)]
        assert minhash_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).count() == n
        made.append(counted["postings"])
    assert 0 < made[1] <= 10 * made[0]


def test_signatures_above_the_threshold_share_a_group():
    rng = np.random.default_rng(4)
    for coordinates, threshold in ((64, 33), (64, 20), (64, 60), (7, 7)):
        one = rng.integers(0, 2 ** 32, (300, coordinates), dtype=np.uint32)
        two = one.copy()
        for row in two:
            row[rng.permutation(coordinates)[threshold:]] ^= 1
        a, b = (minhash_join._group_values(pa.array([x.tobytes() for x in s], pa.binary()), coordinates, threshold)
                for s in (one, two))
        assert a.shape == (300, coordinates - threshold + 1) and (a == b).any(axis=1).all()


def test_near_duplicates_of_odd_rows(odd, empty):
    got = sorted(((r["doc_id"], r["n_shingles"] > 0, r["component_id"], r["kept"])
                  for r in minhash_join.near_duplicates(odd).collect()), key=str)
    assert len(got) == len(ODD) and (None, True, None, True) in got and (6, True, 5, False) in got
    assert (1, False, 1, True) in got and got.count((4, True, 4, True)) == 2
    assert minhash_join.near_duplicates(empty).isEmpty()


# pipeline

def test_pipeline_stages(spark, odd, sf_dir):
    docs = table(spark, "documents")
    numbers = [name for name, _ in corpus_pipeline.STAGES]
    assert len(numbers) == 5
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == table(spark, "documents").columns and 0 < docs.count() <= before
        before = docs.count()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(c == i for i, (_, c) in brute_components(rows, 5).items())
    mixed = corpus_pipeline.mix_domains(spark, docs, sf_dir).cache()
    assert set(mixed.columns) == set(docs.columns) and mixed.count() >= 0.9 * before
    coded = corpus_pipeline.encode(spark, mixed, sf_dir).collect()
    assert sorted(r["decoded"] for r in coded) == sorted(r["text"] for r in mixed.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), sf_dir).count() >= 0


def test_digests_of_queries(spark, sf_dir):
    coded = entry.queries()["op8_byte_bpe"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, "documents").collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in coded)
