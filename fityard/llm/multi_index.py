"""Nearest neighbours by inner product with an inverted multi-index.

Vectors are cut into two halves, each half is assigned to one of ``k`` centroids fitted on a bounded sample;
a pair of centroids is a cell. A query visits cells by descending sum of its halves' inner products with
the two centroids (a heap over two sorted lists), until they hold a given share of all rows, and all rows
of those cells are reranked with exact inner products in double precision.

Equal vectors are one entry that keeps its smallest ``top + 1`` ids: no other of its ids can be among
the nearest of anything, ties going to smaller ids. Equal queries search once. Cells are split into blocks of
``BLOCK`` entries, queries stream past a block, and each (query, block) gives one row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fityard.runtime import written

FIT_ROWS = 1 << 15     # entries that centroids are fitted on, about; chosen by a hash
CELL_ENTRIES = 512     # wanted entries per cell
MAX_CENTROIDS = 1024
SHARE = 0.8            # of all rows that a query reranks; uniformly random directions need so many
BLOCK = 4096
ROUNDS = 12


def _finite(vec: str):
    return (F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
            & F.exists(vec, lambda x: x != 0))


def fit_centroids(rows: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows; an emptied centroid stays where it was."""
    at = np.unique(np.linspace(0, len(rows) - 1, min(k, len(rows))).astype(int))
    centers = rows[at].copy()
    for _ in range(ROUNDS):
        own = assign(rows, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        count = np.bincount(own, minlength=len(centers))
        centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
    return centers


def assign(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ centers.T - (centers ** 2).sum(axis=1) / 2, axis=1)


def visited_cells(left: np.ndarray, right: np.ndarray, sizes: dict[int, int], wanted: int) -> list[int]:
    """Cells in descending order of ``left[i] + right[j]`` until they hold the wanted rows."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    x, y = left[a].tolist(), right[b].tolist()
    k, held, out = len(b), 0, []
    heap, seen = [(-(x[0] + y[0]), 0, 0)], {(0, 0)}
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * k + int(b[j])
        if n := sizes.get(cell):
            out.append(cell)
            held += n
        for step in ((i + 1, j), (i, j + 1)):
            if step[0] < len(x) and step[1] < k and step not in seen:
                seen.add(step)
                heapq.heappush(heap, (-(x[step[0]] + y[step[1]]), *step))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(len(column), -1)


def search(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, top: int = 20,
           share: float = SHARE) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the ``top`` nearest rows found of every row whose id is divisible by
    ``every``, by descending inner product, ties to the smaller id; all other rows if there are fewer.

    Null vectors, zero vectors and those with null or non-finite components take no part, nor do rows
    with a null id or a length other than the most frequent one. Rows that repeat an id with the same vector
    count once; a row never finds its own id. An empty table gives an empty table. Other columns are not read.
    """
    spark = table.sparkSession
    keep = top + 1
    rows = table.select(table[id_col].cast("bigint").alias("id"), table[vec_col].cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & _finite("vec"))
    length = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if length is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score double")
    rows = rows.filter(F.size("vec") == length["dim"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each distinct vector of a batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.asarray(batch.column(0))
            vec = np.asarray(batch.column(1).flatten()).reshape(len(ids), -1) + 0.0
            order = np.argsort(ids, kind="stable")
            own: dict[bytes, list[int]] = {}
            asked: set[bytes] = set()
            for i in order.tolist():
                key = vec[i].tobytes()
                some = own.setdefault(key, [])
                if len(some) < keep and (not some or some[-1] != ids[i]):
                    some.append(int(ids[i]))
                if ids[i] % every == 0:
                    asked.add(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.list_(pa.int64())),
                 pa.array([k in asked for k in own])], names=["vec", "ids", "asked"])

    def least(ids):
        return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ids)))), 1, keep).alias("ids")

    # Equal vectors of many batches meet in two steps, so that none gathers more than a part of them.
    parts = rows.mapInArrow(packed, "vec binary, ids array<bigint>, asked boolean")
    salted = parts.groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).agg(
        least("ids"), F.max("asked").alias("asked"))
    entries = written(salted.groupBy("vec").agg(least("ids"), F.max("asked").alias("asked")), "entries")
    n = entries.count()
    k = int(min(max((n / CELL_ENTRIES) ** 0.5, 8), MAX_CENTROIDS))
    chosen = entries.select("vec").filter(
        F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int(min(1.0, FIT_ROWS / n) * (1 << 30)))
    sample = np.array([np.frombuffer(r["vec"], "<f8") for r in chosen.orderBy(F.xxhash64("vec")).collect()])
    if not len(sample):
        sample = np.array([np.frombuffer(entries.first()["vec"], "<f8")])
    wanted = max(int(share * rows.count()), 4 * keep)
    half = (sample.shape[1] + 1) // 2
    centers = spark.sparkContext.broadcast((fit_centroids(sample[:, :half], k), fit_centroids(sample[:, half:], k)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = centers.value
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                cell = assign(v[:, :half], one) * len(two) + assign(v[:, half:], two)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())],
                                                 names=["vec", "ids", "asked", "cell"])

    index = written(entries.mapInArrow(place, "vec binary, ids array<bigint>, asked boolean, cell bigint"), "cells")
    # At most MAX_CENTROIDS^2 cells.
    counted = {r["cell"]: (r["n"], r["held"]) for r in index.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum(F.size("ids")).alias("held")).collect()}
    sizes = spark.sparkContext.broadcast(({c: h for c, (_, h) in counted.items()},
                                          {c: -(-m // BLOCK) for c, (m, _) in counted.items() if m > BLOCK}))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each entry to its block, and each asked entry to the blocks of the cells that it visits."""
        one, two = centers.value
        held, split = sizes.value
        for batch in batches:
            ids, cells = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            salt = [i[0] % split.get(c, 1) for i, c in zip(ids, cells)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.int64()), pa.array(salt, pa.int32()), pa.array([False] * len(ids)),
                 pa.array([i[0] for i in ids], pa.int64()), batch.column(0), batch.column(1)],
                names=["cell", "part", "query", "entry", "vec", "ids"])
            asked = batch.filter(batch.column(2))
            for a in range(0, asked.num_rows, 64):
                some = asked.slice(a, 64)
                v = _matrix(some.column(0))
                left, right = v[:, :half] @ one.T, v[:, half:] @ two.T
                to = [(r, c, p) for r in range(len(v)) for c in visited_cells(left[r], right[r], held, wanted)
                      for p in range(split.get(c, 1))]
                who, raw = some.column(1).to_pylist(), some.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for _, c, _ in to], pa.int64()), pa.array([p for _, _, p in to], pa.int32()),
                     pa.array([True] * len(to)), pa.array([who[r][0] for r, _, _ in to], pa.int64()),
                     pa.array([raw[r] for r, _, _ in to], pa.binary()),
                     pa.array([None] * len(to), pa.list_(pa.int64()))],
                    names=["cell", "part", "query", "entry", "vec", "ids"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by block, its entries first: they are held, the queries pass."""
        block, held, base, ids = None, [], None, []
        for batch in batches:
            for part in _by_block(batch):
                key = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if key != block:
                    block, held, base = key, [], None
                asked = np.asarray(part.column(2).to_numpy(zero_copy_only=False), dtype=bool)
                if not asked.all():
                    held.append(part.filter(pa.array(~asked)))
                    base = None
                queries = part.filter(pa.array(asked))
                if not queries.num_rows or not held:
                    continue
                if base is None:
                    base = np.concatenate([_matrix(h.column(4)) for h in held])
                    ids = [i for h in held for i in h.column(5).to_pylist()]
                found = []
                for a in range(0, queries.num_rows, 256):
                    scores = _matrix(queries.slice(a, 256).column(4)) @ base.T
                    for row in scores:
                        # All entries that tie with the last of the best are looked at.
                        near = np.arange(len(row)) if len(row) <= keep else np.flatnonzero(
                            row >= np.partition(row, len(row) - keep)[len(row) - keep])
                        best = sorted((-row[j], i) for j in near.tolist() for i in ids[j])[:keep]
                        found.append([{"score": -float(s), "id": i} for s, i in best])
                yield pa.RecordBatch.from_arrays(
                    [queries.column(3), pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))],
                    names=["entry", "near"])

    near = (index.mapInArrow(deal, "cell bigint, part int, query boolean, entry bigint, vec binary, ids array<bigint>")
            .repartition("cell", "part").sortWithinPartitions("cell", "part", "query")
            .mapInArrow(rerank, "entry bigint, near array<struct<score:double,id:bigint>>"))
    order = F.transform(F.flatten(F.collect_list("near")), lambda x: F.struct((-x["score"]).alias("far"), x["id"].alias("id")))
    best = near.groupBy("entry").agg(F.slice(F.array_sort(order), 1, keep).alias("best"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) + 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in v], pa.binary())],
                                             names=["query_id", "vec"])

    asked = (rows.filter(F.col("id") % every == 0).mapInArrow(ask, "query_id bigint, vec binary").distinct()
             .join(entries.filter("asked").select("vec", F.col("ids")[0].alias("entry")), "vec"))
    mine = asked.select("query_id", "entry").join(best, "entry").select(
        "query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, top)))
    return mine.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias(id_col),
                       (-F.col("col.far")).alias("score"))


def _by_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    cell, part = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    edge = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), [True]]))
    for a, b in zip(edge[:-1], edge[1:]):
        yield batch.slice(a, b - a)
