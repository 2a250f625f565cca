"""Near-duplicate documents by an inverted join on signature coordinates.

1. Every text becomes its set of word shingles and a signature of ``coordinates`` minima. Texts with
   equal sets are one class, represented by its smallest id.
2. A pair at the wanted similarity agrees in at least ``T`` of ``K`` coordinates but for a stated chance
   (``match_threshold``). It differs in at most ``K - T`` of them, so of ``K - T + 1`` groups of coordinates one is equal
   as a whole; a class is posted under these groups' values (``K - T + 1`` rows at any size of the corpus). Values
   of one class are dropped by exact counts before anything but the ids is shuffled.
3. Under each value, collisions are counted over all coordinates, on a few bits of each; pairs below ``T`` go. Pairs of
   classes that are known to be connected are skipped: a first pass takes the best candidate of each
   class, a second one the best ``FURTHER`` between different components, a third one all that remain between
   different components. So a large group of near copies is connected by a few pairs a class, not by all.
4. Every candidate is confirmed on the full shingle sets; confirmed links give the components.

A value under which many classes are posted is cut into blocks; pairs of blocks are separate units of
work, and blocks whose members all are in one component aren't compared at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.llm.components import connected_components
from fityard.llm.textcols import U64, mix, released, shingle_hashes, texts_words
from fityard.runtime import written

COORDINATES = 64
MISS = 1e-7  # chance that a pair of exactly the wanted similarity agrees in too few coordinates
BLOCK = 4096
PARITY_BITS = 1024
LOW_BITS = 4  # of every coordinate, sent with each posting
SMALL = 12
FURTHER = 4  # candidates of a class that the second pass confirms
_TO_SIGNED = np.int64(-1 << 63)


def match_threshold(coordinates: int, similarity: float, miss: float = MISS) -> int:
    """Largest T with P(fewer than T of the coordinates agree) <= miss at that similarity."""
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * similarity ** t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


def _coefficients(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * coordinates + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
    return x[:coordinates] | U64(1), x[coordinates:]


def signature(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the minimum of every permutation over a set."""
    least = np.full(len(factor), np.iinfo(U64).max, dtype=U64)
    for a in range(0, len(shingles), 4096):
        x = shingles[a:a + 4096, None] * factor + shift
        np.minimum(least, (x ^ (x >> U64(29))).min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct shingle hashes of every text."""
    for a, b, words, at in texts_words(column):
        shingles, to = shingle_hashes(words, at, k)
        for i in range(b - a):
            yield a + i, np.unique(shingles[to[i]:to[i + 1]])


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets have in common."""
    return (int(_signed(mix(s).sum(dtype=U64).reshape(1))[0]),
            int(_signed(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).reshape(1))[0]))


def _parity(s: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the set's hashes fall on it: two sets differ in at least as many
    elements as their bits differ."""
    odd = np.bincount((mix(s) & U64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signatures(docs: DataFrame, k: int, coordinates: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, shift = _coefficients(coordinates)
        for batch in batches:
            n, one, two, sig, parity = [], [], [], [], []
            for _, s in _sets(batch.column(1), k):
                x, y = _set_key(s)
                n.append(len(s))
                one.append(x)
                two.append(y)
                sig.append(signature(s, factor, shift).tobytes() if len(s) else None)
                parity.append(_parity(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()),
                 pa.array(two, pa.int64()), pa.array(sig, pa.binary()), pa.array(parity, pa.binary())],
                names=["id", "n", "k1", "k2", "sig", "parity"])

    return docs.mapInArrow(released(sign), "id bigint, n bigint, k1 bigint, k2 bigint, sig binary, parity binary")


def _group_values(sig: pa.Array, coordinates: int, threshold: int) -> np.ndarray:
    """One 64-bit hash for each signature (row) and group of coordinates (column): as many groups as signatures with
    ``threshold`` equal coordinates can't all differ in, each as wide as the coordinates allow."""
    groups = coordinates - threshold + 1
    width = coordinates // groups
    values = np.frombuffer(b"".join(sig.to_pylist()), dtype=np.uint32).reshape(-1, coordinates)
    values = values[:, :groups * width].reshape(-1, groups, width).astype(U64)
    out = np.broadcast_to(mix(np.arange(1, groups + 1, dtype=U64)), values.shape[:2])
    for i in range(width):
        out = mix(out ^ values[:, :, i])
    return out


def low_bits(signatures: np.ndarray) -> np.ndarray:
    """The lowest ``LOW_BITS`` bits of every coordinate, packed into 64-bit words (rows, words)."""
    n, k = signatures.shape
    a_word = 64 // LOW_BITS
    padded = np.zeros((n, -(-k // a_word) * a_word), dtype=U64)
    padded[:, :k] = signatures & ((1 << LOW_BITS) - 1)
    return np.bitwise_or.reduce(padded.reshape(n, -1, a_word) << (np.arange(a_word, dtype=U64) * U64(LOW_BITS)), axis=2)


def may_agree(x: np.ndarray, y: np.ndarray, coordinates: int) -> np.ndarray:
    """In how many coordinates two rows of ``low_bits`` agree: at least as many as the signatures themselves."""
    differ = x ^ y
    differ = differ | differ >> U64(1)
    differ = (differ | differ >> U64(2)) & U64(0x1111111111111111)
    return coordinates - np.bitwise_count(differ).sum(axis=1).astype(np.int64)


def _postings(classes: DataFrame, coordinates: int, threshold: int) -> DataFrame:
    """``(value, rep)``: every class under its groups of coordinates."""
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                rows = batch.slice(a, 2048)
                values = _group_values(rows.column(1), coordinates, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(values.reshape(-1))),
                     rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), values.shape[1])))],
                    names=["value", "rep"])

    return classes.select("rep", "sig").mapInArrow(released(post), "value bigint, rep bigint")


def _compared(classes: DataFrame, coordinates: int) -> DataFrame:
    """``(rep, size, parity, low)``: what two classes are compared by. An id that stands for several classes has a row
    for each, so no pair is judged by another class's bits."""
    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint32).reshape(-1, coordinates)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([x.tobytes() for x in low_bits(sig)], pa.binary())],
                    names=["rep", "size", "parity", "low"])

    return classes.select("rep", F.col("n").alias("size"), "parity", "sig").mapInArrow(
        released(shorten), "rep bigint, size bigint, parity binary, low binary")


def _words(column: pa.Array) -> np.ndarray:
    """Binary values of one length as 64-bit words (rows, words)."""
    values = np.frombuffer(b"".join(column.to_pylist()), dtype=U64)
    return values.reshape(len(column), -1)


def _pairs(blocks: DataFrame, threshold: int, coordinates: int, percent: int, best: int | None) -> DataFrame:
    """Candidate pairs ``(a, b, agreed)``, a < b, within the rows of each unit.

    ``blocks``: unit (bigint), side (-1: one block against itself; else which of two blocks), rep,
    component, low (low bits of each coordinate), n (set size) and parity. Collisions of low bits can only add
    candidates; with parities, pairs go whose bits differ in more places than similar sets may differ in elements.
    Every candidate between different components; with ``best``, for each row of a large unit only so many of those
    before it, in the order of rep, that agree with it in most coordinates.
    """
    def alike(i, j, n, bits) -> np.ndarray:
        if not bits.shape[1]:
            return np.ones(len(j), dtype=bool)
        # |A - B| + |B - A| <= (n_a + n_b) (1 - s) / (1 + s) at a similarity of s or more.
        return np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) * (100 + percent) <= (n[i] + n[j]) * (100 - percent)

    def found(rep, comp, side, low, n_of, bits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(rep)
        for i in range(1, n):
            rest = np.flatnonzero((comp[:i] != comp[i]) & ((side[:i] != side[i]) | (side[i] < 0)))
            like = may_agree(low[rest], low[i], coordinates)
            rest, like = rest[like >= threshold], like[like >= threshold]
            ok = alike(i, rest, n_of, bits)
            rest, like = rest[ok], like[ok]
            if best and len(rest) > best:
                top = np.argsort(-like, kind="stable")[:best]
                rest, like = rest[top], like[top]
            if len(rest):
                yield rep[rest], np.full(len(rest), rep[i]), like

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(4)] + [
                _words(batch.column(4)), np.asarray(batch.column(5)), _words(batch.column(6))]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # sorted by unit; the last may go on
            if last:
                yield [c[:last] for c in cols]
            held = [c[last:] for c in cols]
        if held is not None:
            yield held

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, side, rep, comp, low, n_of, bits in units(batches):
            edge = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            size = np.diff(edge)
            out = []
            # Small units together: row i with row i + s, for every distance s within a unit.
            small = np.repeat(size <= SMALL, size)
            for s in range(1, SMALL):
                i = np.flatnonzero((unit[s:] == unit[:-s]) & small[s:] & (comp[s:] != comp[:-s])
                                   & ((side[s:] != side[:-s]) | (side[s:] < 0)))
                for a in range(0, len(i), 65536):
                    j = i[a:a + 65536]
                    like = may_agree(low[j], low[j + s], coordinates)
                    j, like = j[like >= threshold], like[like >= threshold]
                    ok = alike(j, j + s, n_of, bits)
                    j, like = j[ok], like[ok]
                    out.append((rep[j], rep[j + s], like))
            for a, b in zip(edge[:-1][size > SMALL], edge[1:][size > SMALL]):
                out += found(*(x[a:b] for x in (rep, comp, side, low, n_of, bits)))
            if out:
                a, b, like = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()),
                     pa.array(like, pa.int32())], names=["a", "b", "agreed"])

    return (blocks.select("unit", "side", "rep", "component", "low", "size", "parity").repartition("unit")
            .sortWithinPartitions("unit", "rep").mapInArrow(released(match), "a bigint, b bigint, agreed int"))


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs whose full sets have ``den * intersection >= num * union``."""
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = batch.slice(a, 512)
                sets = [_signed(s) for _, s in _sets(rows.column(1), k)]
                keys = [_set_key(s.view(U64)) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([x for x, _ in keys], pa.int64()),
                     pa.array([y for _, y in keys], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["id", "k1", "k2", "set"])

    wanted = (pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))
              .distinct().join(classes.select("rep", "k1", "k2"), "rep"))
    texts = docs.join(wanted.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    sets = (texts.mapInArrow(released(shingle), "id bigint, k1 bigint, k2 bigint, set array<bigint>")
            .join(wanted.withColumnRenamed("rep", "id"), ["id", "k1", "k2"])
            .dropDuplicates(["id", "k1", "k2"]).select("id", "set"))
    sets = written(sets, "sets")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b"))
    common = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return (both.select("a", "b", common.alias("common"),
                        (F.size("set_a") + F.size("set_b")).cast("bigint").alias("total"))
            .filter(F.col("common") * den >= (F.col("total") - F.col("common")) * num)
            .select("a", "b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` for every row.

    Words are maximal runs without white space (space and U+0009 to U+000D), A-Z lower-cased. A text's set
    is that of its distinct runs of ``shingle_words`` words; with fewer words, the whole sequence as one.
    Two texts are linked if ``100 * intersection >= percent * union``. ``component_id`` is the smallest id
    that links reach, ``kept`` tells whether it is the row's own.

    Null and empty texts, and texts of white space, have empty sets and are linked with nothing. Rows that
    repeat an id are one node. A row whose id is null is linked with nothing, has a null component and is
    kept. Other columns are not read. An empty table gives an empty table.
    """
    threshold = match_threshold(coordinates, percent / 100)
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    signed = written(_signatures(texts, shingle_words, coordinates), "signatures")
    linkable = signed.filter("n > 0 and id is not null")
    classes = written(linkable.groupBy("k1", "k2").agg(F.min("id").alias("rep"))
                      .join(linkable.select(F.col("id").alias("rep"), "n", "k1", "k2", "sig", "parity"), ["k1", "k2", "rep"])
                      .dropDuplicates(["k1", "k2"]), "classes")

    posted = written(_postings(classes, coordinates, threshold), "postings")
    counts = posted.groupBy("value").agg(F.count("*").alias("n")).filter("n > 1")  # values of one class make no pair
    live = written(posted.join(counts, "value"), "shared-postings")
    compared = written(_compared(classes, coordinates), "compared")
    blocks = F.expr(f"cast(ceil(n / {BLOCK}) as int)")
    block = F.pmod(F.xxhash64("rep", "value"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("nb") - 1),
                         lambda j: F.struct(F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))
    texts_of = texts.filter("id is not null")

    def open_pairs(component: DataFrame, best: int | None) -> DataFrame:
        """Candidates between different components, under the values that have several."""
        known = live.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
            "component", F.coalesce("component", "rep"))
        open_values = (known.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y"))
                       .filter("x != y").select("value"))
        still = (known.join(open_values, "value").join(compared, "rep")
                 .withColumn("nb", blocks).withColumn("at", block))
        units = still.withColumn("u", F.explode(others)).select(
            F.xxhash64("value", "u.i", "u.j").alias("unit"),
            F.when(F.col("u.i") == F.col("u.j"), -1).when(F.col("at") == F.col("u.i"), 0).otherwise(1).alias("side"),
            "rep", "component", "low", "size", "parity")
        return _pairs(units, threshold, coordinates, percent, best)

    def chosen(pairs: DataFrame, best: int) -> DataFrame:
        """The ``best`` pairs of each b."""
        top = F.slice(F.sort_array(F.collect_set(F.struct("agreed", (-F.col("a")).alias("minus_a"))), asc=False), 1, best)
        return (pairs.filter("a != b").groupBy("b").agg(top.alias("top"))
                .select("b", F.explode("top.minus_a").alias("minus_a")).select((-F.col("minus_a")).alias("a"), "b"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        return _confirmed(pairs, texts_of, classes, shingle_words, percent, 100)

    own = live.join(compared.select("rep", "low"), "rep").select(
        F.xxhash64("value", block).alias("unit"), F.lit(-1).alias("side"), "rep", F.col("rep").alias("component"),
        "low", F.lit(0).cast("bigint").alias("size"), F.unhex(F.lit("")).alias("parity"))
    tried = written(chosen(_pairs(own, threshold, coordinates, percent, 1), 1), "first-pairs")
    links = written(confirmed(tried), "links")
    component = connected_components(links)
    for best in (FURTHER, None):
        found = open_pairs(component, best)
        found = chosen(found, best) if best else found.filter("a != b").select("a", "b").distinct()
        # Written before the tried ones are taken away: else that join goes ahead of the distinct pairs.
        rest = written(written(found, "open-pairs").join(tried, ["a", "b"], "left_anti"), "pairs")
        links = written(links.unionByName(confirmed(rest)), "links")
        tried = tried.unionByName(rest)
        component = connected_components(links)

    of_class = classes.select("k1", "k2", "rep").join(
        component.withColumnRenamed("node", "rep"), "rep", "left").select(
        "k1", "k2", F.coalesce("component", "rep").alias("of"))
    own_id = F.when(F.col("n") > 0, F.col("of"))
    found = (signed.select("id", "n", "k1", "k2").join(of_class, ["k1", "k2"], "left")
             .select("id", F.col("n").alias("n_shingles"),
                     F.when(F.col("id").isNotNull(), F.coalesce(own_id, "id")).alias("component_id")))
    return found.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles",
                        "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
