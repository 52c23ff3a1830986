"""Exact top-k inner products by a Voronoi join.

Vectors are rounded to integers. Pivots split data and queries into Voronoi cells. A
cell's summary is its size, its radius and the largest norm in it. From the summaries
alone each query gets, for every cell, an upper and a lower bound of its products with
the cell's vectors: q.p +- |q| r. The cells with the greatest lower bounds that hold k
others fix a product that the k-th best cannot fall short of, and the query is
replicated only to cells whose upper bound reaches it. Cells are solved apart: a task holds a block
of a cell's queries and streams a part of the cell's vectors past them; the best k of each are merged.

The queries that visit a cell are split into numbered blocks of bounded size, and a vector is copied
to those blocks only, once for each; a cell of any size is split into hashed parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import written

PIVOTS = 48
PIVOT_SAMPLE = 4096
DATA_BLOCK = 1 << 16  # vectors that a task streams past a block of queries, on the average
QUERY_BLOCK = 1 << 13  # queries that a task holds, on the average
SLACK = 1e-6  # relative; bounds are in floating point, products are not


def _matrix(vectors, width: int = 0) -> np.ndarray:
    """Rows of float64; shorter vectors are padded with zeros."""
    if not len(vectors):
        return np.zeros((0, width))
    sizes = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    if (sizes == sizes[0]).all() and sizes[0] >= width:
        return np.vstack(vectors).astype(np.float64)
    out = np.zeros((len(vectors), max(width, int(sizes.max()))))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as int64; clipped to it where they do not fit."""
    most = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, queries.shape[1])
    if most < 2**53:
        return (queries @ data.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    found = exact(queries).dot(exact(data).T)
    return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample by farthest-first choice, moved to the means of their cells once."""
    if not len(sample):
        return sample
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    pivots = sample[chosen]
    cell = _nearest(sample, pivots)[0]
    return np.vstack([sample[cell == i].mean(axis=0) if (cell == i).any() else pivots[i] for i in range(len(pivots))])


def _nearest(rows: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (rows**2).sum(axis=1)[:, None] - 2 * rows @ pivots.T + (pivots**2).sum(axis=1)
    cell = squares.argmin(axis=1)
    return cell, np.sqrt(((rows - pivots[cell]) ** 2).sum(axis=1))


def _assign(pivots: np.ndarray):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = _matrix(batch["v"].tolist(), pivots.shape[1])
            wide = np.zeros((len(pivots), rows.shape[1]))
            wide[:, : pivots.shape[1]] = pivots
            cell, radius = _nearest(rows, wide) if len(rows) else (np.zeros(0, dtype=np.int64), np.zeros(0))
            yield batch.assign(cell=cell, radius=radius)

    return work


def _route(pivots: np.ndarray, cells: np.ndarray, sizes: np.ndarray, radius: np.ndarray, k: int):
    """(id, v) of queries to a row for each cell that may hold one of their k best."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            q = _matrix(batch["v"].tolist(), pivots.shape[1])
            if not len(q):
                continue
            own = pivots[cells]
            middle, norm = q[:, : own.shape[1]] @ own.T, np.sqrt((q**2).sum(axis=1))[:, None]
            slack = SLACK * (np.abs(middle) + norm * radius + 1)
            upper, lower = middle + norm * radius + slack, middle - norm * radius - slack
            order = np.argsort(-lower, axis=1)
            held = np.cumsum(sizes[order], axis=1)
            enough = held >= k + 1  # one of them may be the query's own row
            at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(cells) - 1)
            floor = np.take_along_axis(lower, np.take_along_axis(order, at[:, None], axis=1), axis=1)
            floor[~enough.any(axis=1)] = -np.inf
            row, col = np.nonzero(upper >= floor)
            yield pd.DataFrame({"id": batch["id"].to_numpy()[row], "v": [batch["v"].iloc[i] for i in row], "cell": cells[col]})

    return work


class _Best:
    """The ``k`` best of each query so far: greatest scores, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.score = np.full((len(ids), k), -(2**63), dtype=np.int64)
        self.place = np.full((len(ids), k), 2**63 - 1, dtype=np.int64)
        self.have = np.zeros(len(ids), dtype=np.int64)

    def see(self, ids: np.ndarray, data: np.ndarray) -> None:
        """Take in a batch of candidates."""
        width = max(self.vectors.shape[1], data.shape[1])
        data = np.pad(data, ((0, 0), (0, width - data.shape[1])))
        self.vectors = np.pad(self.vectors, ((0, 0), (0, width - self.vectors.shape[1])))
        step = max(1, (1 << 21) // max(1, len(ids)))
        for at in range(0, len(self.ids), step):
            own = slice(at, at + step)
            score = products(self.vectors[own], data)
            # a full list keeps out what is below its last, and a batch what is below its own k best (one may be the query itself)
            limit = np.where(self.have[own] < self.k, -(2**63), self.score[own, -1])
            near = score >= limit[:, None]
            if len(ids) > self.k + 1 and near.sum() > 8 * self.k * len(score):
                edge = np.partition(score, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1]
                near &= score >= edge[:, None]
            row, col = np.nonzero(near & (ids[None, :] != self.ids[own, None]))
            if not len(row):
                continue
            held_row, held_col = np.nonzero(np.arange(self.k) < self.have[own, None])
            row_all = np.append(held_row, row)
            score_all = np.append(self.score[own][held_row, held_col], score[row, col])
            id_all = np.append(self.place[own][held_row, held_col], ids[col])
            order = np.lexsort((id_all, ~score_all, row_all))  # ~x falls as x grows
            row_all, score_all, id_all = row_all[order], score_all[order], id_all[order]
            rank = np.arange(len(row_all)) - np.searchsorted(row_all, row_all)
            top = rank < self.k
            row_all, rank = row_all[top] + at, rank[top]
            self.score[row_all, rank], self.place[row_all, rank] = score_all[top], id_all[top]
            np.maximum.at(self.have, row_all, rank + 1)

    def rows(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.arange(self.k) < self.have[:, None])
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.place[row, col]), pa.array(self.score[row, col])], ["query_id", "vec_id", "score"])


def _vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _solve(k: int):
    """(cell, b, q, asks, id, v), sorted so that each group's queries come before its vectors, to each query's best in the group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, queries, best = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(i).to_numpy() for i in range(3)])
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                if group != (now := tuple(keys[a].tolist())):
                    if best:
                        yield best.rows()
                    group, queries, best = now, [], None
                ids, vectors = batch.column(4).slice(a, b - a).to_numpy(), _vectors(batch.column(5).slice(a, b - a))
                own = asks[a:b].astype(bool)
                if own.any():
                    queries.append((ids[own], vectors[own]))
                if not own.all():
                    if best is None and queries:
                        width = max(v.shape[1] for _, v in queries)
                        best = _Best(np.concatenate([i for i, _ in queries]), np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for _, v in queries]), k)
                    if best:
                        best.see(ids[~own], vectors[~own])
        if best:
            yield best.rows()

    return work


def top_products(
    vectors: DataFrame,
    is_query: str,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    pivots: int = PIVOTS,
    data_block: int = DATA_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where the SQL condition ``is_query`` holds, its ``k`` best others.

    A vector counts as floor(scale * x) of its components as double; the score is the
    integer inner product (clipped to 64 bits), ties go to the smaller id. Rows whose
    id or vector is null, or whose vector holds a null or non-finite component, take no
    part. A shorter vector counts as padded with zeros. A query's own id is no candidate;
    rows that share an id are candidates each, and queries of one id are one query, the
    first by vector. Pivots come from PIVOT_SAMPLE rows at most, those of least hashed
    id; they change the work, not the result. An empty table gives no rows; other columns,
    whatever their names, do not matter.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(F.col(vector_col).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.expr(is_query).alias("asks"))
    sample = rows.select("v").orderBy(F.xxhash64("id"), "v").limit(PIVOT_SAMPLE).toPandas()
    points = _pivots(_matrix(sample["v"].tolist()), pivots)
    if not len(points):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    data = written(rows.mapInPandas(_assign(points), "id long, v array<double>, asks boolean, cell long, radius double"), "cells")
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).orderBy("cell").toPandas()  # a row for each pivot at most
    cells, sizes = summary["cell"].to_numpy(), summary["n"].to_numpy()
    asks = data.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    routed = written(asks.mapInPandas(_route(points, cells, sizes, summary["r"].to_numpy(), k), "id long, v array<double>, cell long"), "routed")
    visits = routed.groupBy("cell").agg(F.count("*").alias("visits"))
    blocks = F.ceil(F.col("visits") / F.lit(float(query_block)))
    parts = {int(c): -(-int(n) // data_block) for c, n in zip(cells, sizes, strict=True)}
    about = spark.createDataFrame(list(parts.items()), "cell long, parts long").join(visits, "cell").select("cell", "parts", blocks.alias("blocks"))  # a row for each pivot at most
    hashed = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = ["cell", "b", "q"]
    left = routed.join(F.broadcast(about), "cell").withColumn("q", hashed("blocks")).withColumn("b", each("parts")).select(*keys, F.lit(True).alias("asks"), "id", "v")
    right = data.join(F.broadcast(about), "cell").withColumn("b", hashed("parts")).withColumn("q", each("blocks")).select(*keys, F.lit(False).alias("asks"), "id", "v")
    blocks_of = {r.cell: r.blocks for r in about.collect()}
    copies = sum(int(n) * blocks_of.get(int(c), 0) for c, n in zip(cells, sizes, strict=True))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(copies) // data_block))
    solved = left.union(right).repartition(tasks, *keys).sortWithinPartitions(*keys, F.desc("asks")).mapInArrow(_solve(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return solved.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
