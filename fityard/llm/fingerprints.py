"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every word shingle is hashed once: its upper bits choose a bin, the rest compete for the bin's minimum. An
empty bin takes the value of a bin that a universal hash of (empty bin, attempt) chooses, trying further attempts until that
bin isn't empty; the choice is the same for all documents. Of each bin the lowest ``BITS`` bits are packed. Two
fingerprints agree by chance in 1 of 2^BITS bins, so likeness is ``(agreement - c) / (1 - c)`` with ``c = 2^-BITS``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fityard.llm.textcols import U64, mix, shingle_hashes, texts_words

BINS = 512
BITS = 8
SHINGLE_WORDS = 5


def bin_minima(shingles: np.ndarray, to: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum by text (row) and bin (column), and which bins are filled."""
    n = len(to) - 1
    text = np.repeat(np.arange(n), np.diff(to))
    low = U64(64 - bins.bit_length() + 1)
    place = text * bins + (shingles >> low).astype(np.int64)
    least = np.full(n * bins, np.iinfo(U64).max, dtype=U64)
    np.minimum.at(least, place, mix(shingles & ((U64(1) << low) - U64(1))) >> U64(1))
    least = least.reshape(n, bins)
    return least, least != np.iinfo(U64).max


def densify(least: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Optimal densification; rows without a filled bin stay as they are."""
    out, bins = least.copy(), U64(least.shape[1])
    row, empty = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    attempt = 0
    while len(row):
        attempt += 1
        donor = (mix((empty.astype(U64) << U64(32)) + U64(attempt)) % bins).astype(np.int64)
        ok = filled[row, donor]
        out[row[ok], empty[ok]] = least[row[ok], donor[ok]]
        row, empty = row[~ok], empty[~ok]
    return out


def fingerprints(column: pa.Array, bins: int = BINS, bits: int = BITS,
                 shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Packed fingerprint (row of bytes) of every text, and which texts have a shingle. A text without
    words has an all-zero fingerprint."""
    out = np.zeros((len(column), bins * bits // 8), dtype=np.uint8)
    some = np.zeros(len(column), dtype=bool)
    for a, b, words, at in texts_words(column):
        shingles, to = shingle_hashes(words, at, shingle_words)
        for c in range(a, b, 256):
            part = to[c - a:min(b, c + 256) - a + 1]
            least, filled = bin_minima(shingles[part[0]:part[-1]], part - part[0], bins)
            low = densify(least, filled) & U64((1 << bits) - 1)
            has = filled.any(axis=1)
            spread = (low[:, :, None] >> np.arange(bits, dtype=U64)[::-1]) & U64(1)
            packed = np.packbits(spread.astype(np.uint8).reshape(len(has), -1), axis=1)
            out[c:c + len(has)] = np.where(has[:, None], packed, 0)
            some[c:c + len(has)] = has
    return out, some


def likeness(x: np.ndarray, x_some: np.ndarray, y: np.ndarray, y_some: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated resemblance, 0 to 1, row by row. Two texts without words are equal (1), a text without words
    and one with words have nothing in common (0)."""
    def values(f: np.ndarray) -> np.ndarray:
        return f if bits == 8 else np.packbits(
            np.unpackbits(f, axis=1).reshape(len(f), -1, bits), axis=2)[:, :, 0]

    chance = 2.0 ** -bits
    agree = (values(x) == values(y)).mean(axis=1) if len(x) else np.zeros(0)
    found = np.clip((agree - chance) / (1 - chance), 0.0, 1.0)
    return np.where(x_some & y_some, found, np.where(x_some | y_some, 0.0, 1.0))


def _edit(text: str, after: str) -> str:
    n = len(text) // 3
    return text[:len(text) - n] + after[:n]


def neighbour_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS,
                           bits: int = BITS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id_col, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The next document of a row is the following one in the order of descending ids, the first one for the last
    row. Its edited text has the last ``floor(n_chars / 3)`` code points replaced by as many (or all) from the
    start of the next one. Fingerprints are binary.

    Texts are moved once: rows are dealt by ranges of ids, sorted inside a range, and each range also gets a
    copy of the row that follows it. Null texts count as empty. A null id comes last. Rows that repeat an id are ordered by their
    texts. A single row is its own next document. Other columns are not read. An empty table gives an
    empty table. Words are runs without white space, A-Z lower-cased; fewer than ``shingle_words`` words are one shingle.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(docs[id_col].cast("bigint").alias("id"),
                       F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    ids = rows.filter("id is not null").select("id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.rdd.getNumPartitions())
    # Approximate quantiles are constants of the plan: every run of a task cuts the same ranges.
    cuts = sorted({int(q) for q in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 1 / (4 * parts))},
                  reverse=True)
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # Ranges are numbered in descending order of ids: how many cuts lie above the id. Nulls come last.
    at = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(
        F.size(F.filter(bounds, lambda c: c > F.col("id")))).cast("int")
    placed = rows.withColumn("range", at)
    # The first row of each range, one for each of a bounded number of ranges, is copied to the range before.
    top = placed.groupBy("range").agg(F.max("id").alias("id"))
    order = Window.orderBy("range")
    top = top.select("range", "id", F.coalesce(F.lag("range").over(order),
                                               F.max("range").over(Window.partitionBy())).alias("to"))
    top = spark.createDataFrame(top.collect(), "range int, id bigint, to int")
    heads = (placed.join(F.broadcast(top.withColumnRenamed("id", "first")), "range")
             .filter(F.col("id").eqNullSafe(F.col("first")))
             .groupBy("to", "id").agg(F.min("text").alias("text"))
             .select("id", "text", F.col("to").alias("range"), F.lit(1).alias("copy")))
    dealt = placed.select("id", "text", "range", F.lit(0).alias("copy")).unionByName(heads)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, text, next text); a copied row closes its range."""
        held = None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held is not None:
                    yield held[0], held[1], row[1]
                held = None if row[3] else row

    def chunks(found: Iterator[tuple]) -> Iterator[list[tuple]]:
        out, size = [], 0
        for x in found:
            out.append(x)
            size += len(x[1]) + len(x[2])
            if size > 1 << 21 or len(out) >= 512:
                yield out
                out, size = [], 0
        if out:
            yield out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(pairs(batches)):
            texts = [t for _, t, _ in part]
            edited = [_edit(t, after) for _, t, after in part]
            own, own_some = fingerprints(pa.array(texts, pa.string()), bins, bits, shingle_words)
            new, new_some = fingerprints(pa.array(edited, pa.string()), bins, bits, shingle_words)
            # The next row's fingerprint is the following one, unless the range ends here.
            follows = [i for i in range(len(part) - 1) if part[i][2] is part[i + 1][1]]
            nxt, nxt_some = np.empty_like(own), np.empty_like(own_some)
            nxt[follows], nxt_some[follows] = own[np.array(follows, int) + 1], own_some[np.array(follows, int) + 1]
            other = np.setdiff1d(np.arange(len(part)), follows)
            f, s = fingerprints(pa.array([part[i][2] for i in other], pa.string()), bins, bits, shingle_words)
            nxt[other], nxt_some[other] = f, s
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _, _ in part], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(edited, pa.string()), pa.array([x.tobytes() for x in own], pa.binary()),
                 pa.array([x.tobytes() for x in new], pa.binary()),
                 pa.array(likeness(own, own_some, new, new_some, bits)),
                 pa.array(likeness(own, own_some, nxt, nxt_some, bits))],
                names=["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    done = (dealt.repartition(parts, "range")
            .sortWithinPartitions("range", "copy", F.col("id").desc_nulls_last(), "text")
            .mapInArrow(work, "id bigint, n_chars bigint, edited_text string, fingerprint binary, "
                              "edited_fingerprint binary, near_edited double, near_next double"))
    return done.select(F.col("id").cast(kind).alias(id_col), *done.columns[1:])
