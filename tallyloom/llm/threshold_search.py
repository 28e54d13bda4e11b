"""Exact top-k search by the threshold algorithm over sorted lists, one per dimension."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import frozen

#: Vectors in one set of sorted lists, at most, and the number below which lists are not split further.
SHARD_ROWS, LEAST_ROWS = 1 << 16, 1 << 12
#: Queries that one task asks of a set of lists, at most.
QUERY_ROWS = 1 << 14
#: Sets of lists that are aimed at before they grow to ``SHARD_ROWS``.
SHARDS = 32

_LONG = np.iinfo(np.int64)


class SortedLists:
    """Vectors of one length, in order of their ids, and the order of each component."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32))
        self.largest = max(int(vectors.max()), -int(vectors.min())) if vectors.size else 0
        self.vectors = vectors.astype(np.float64) if self.largest < 1 << 53 else vectors
        self.unbounded = None

    def _scored(self, query: np.ndarray):
        """The vectors and the query in doubles where those are exact, else in unbounded integers."""
        if self.vectors.shape[1] * self.largest * max(map(abs, query.tolist()), default=0) < 1 << 53:
            return self.vectors, query.astype(np.float64)
        if self.unbounded is None:
            self.unbounded = self.vectors.astype(np.int64).astype(object)
        return self.unbounded, query.astype(object)

    def top(self, query: np.ndarray, own: list[int], k: int) -> tuple[np.ndarray, list[int]]:
        """``(rows, scores)`` of the ``k`` best rows but ``own``; equal scores by row.

        Lists are read from the end that the sign of the query's component favours, deeper each
        round. What the last entries read would score together bounds every row not met so far;
        reading stops when that is below the k-th score, or when all rows have been met.
        """
        n, width = self.vectors.shape
        vectors, query = self._scored(query)
        met = np.zeros(n, bool)
        met[own] = True
        rows, scores = np.zeros(0, np.int64), np.zeros(0, vectors.dtype)
        down = np.flatnonzero(query > 0)
        up = np.flatnonzero(query < 0)
        depth, step = 0, max(32, n // 64)
        while depth < n and not met.all():
            deeper = min(n, depth + step)
            before = met.copy()
            met[self.order[down, n - deeper : n - depth]] = True
            met[self.order[up, depth:deeper]] = True
            if len(down) + len(up) == 0:
                met[:] = True  # no list has a weight: every score is 0
            fresh = np.flatnonzero(met & ~before)
            rows = np.concatenate([rows, fresh])
            here = vectors[fresh] @ query if width else np.zeros(len(fresh), vectors.dtype)
            scores = np.concatenate([scores, np.clip(here, _LONG.min, _LONG.max) if here.dtype == object else here])
            best = np.lexsort((rows, -scores))[:k] if len(rows) <= 4 * k else _best(rows, scores, k)
            rows, scores = rows[best], scores[best]
            depth, step = deeper, 2 * step
            if len(rows) == k and depth < n:
                last = vectors[self.order[down, n - depth], down] @ query[down] + vectors[self.order[up, depth - 1], up] @ query[up]
                if min(max(last, _LONG.min), _LONG.max) < scores[-1]:
                    break
        return rows, [int(s) for s in scores]


def _best(rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    held = np.flatnonzero(scores >= least)
    return held[np.lexsort((rows[held], -scores[held]))[:k]]


def top_inner_products(
    vectors: DataFrame,
    *,
    queries: Column,
    k: int = 10,
    scale: int = 1024,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    least_rows: int = LEAST_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every row that ``queries`` marks.

    Components become ``floor(scale * x)``, saturating at 64 bits; the score is their inner product,
    saturating likewise. Rows of one vector length are dealt into sets of sorted lists by a hash,
    queries into blocks; every block asks every set, in tasks of bounded size, and the best of all
    sets are ranked. Of equal vectors only the ``k + 1`` smallest ids can be among the best, so no
    more of them travel: a group of copies is cut inside the map tasks.

    Equal scores go to the smaller id, null ids last. Rows that share a query's id are its own.
    Vectors that are null or hold nulls or non-finite numbers take no part; those of other lengths
    are not compared. Rows equal in id and vector count once; equal ids with different vectors are
    rows, and queries, of their own. An empty table gives an empty result; extra columns are ignored.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # Spark's floor of a double saturates at 64 bits.
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    marked = vectors.select(F.col(vec_id).alias("_id"), F.coalesce(queries, F.lit(False)).alias("_asks"), F.when(finite, whole).alias("_v"))
    rows = frozen(marked.filter("_v is not null").groupBy("_id", "_v").agg(F.max("_asks").alias("_asks")).withColumns({"_size": F.size("_v"), "_key": F.xxhash64("_v")}), "whole-vectors")
    kind = rows.schema["_id"].dataType.simpleString()

    alike = Window.partitionBy("_v").orderBy(F.col("_id").asc_nulls_last())
    fewest = rows.withColumn("_nth", F.row_number().over(alike)).filter(F.col("_nth") <= k + 1).drop("_nth")
    per_set = F.least(F.greatest(F.ceil(F.col("_n") / SHARDS), F.lit(least_rows)), F.lit(shard_rows))
    sizes = rows.groupBy("_size").agg(F.count("*").alias("_n"), F.count_if("_asks").alias("_q"))
    plan = sizes.filter("_q > 0").select(
        "_size", F.ceil(F.col("_n") / per_set).cast("int").alias("_sets"), F.ceil(F.col("_q") / query_rows).cast("int").alias("_blocks")
    )
    dealt = F.xxhash64("_id", "_v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    listed = fewest.join(plan, "_size").select("_size", F.pmod(dealt, "_sets").cast("int").alias("_set"), every("_blocks").alias("_block"), F.lit(False).alias("_asks"), "_id", "_v", "_key")
    asking = rows.filter("_asks").join(plan, "_size").select("_size", every("_sets").alias("_set"), F.pmod(dealt, "_blocks").cast("int").alias("_block"), "_asks", "_id", "_v", "_key")
    task = ["_size", "_set", "_block"]
    together = listed.unionByName(asking).repartition(*task).sortWithinPartitions(*task, "_asks", F.col("_id").asc_nulls_last(), "_v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, lists, ids, own = None, [], None, [], {}
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in task] + [batch.column("_asks").to_numpy(zero_copy_only=False)])
            border = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
            for lo, hi in zip(border[:-1].tolist(), border[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                key, asks = tuple(keys[lo, :3].tolist()), bool(keys[lo, 3])
                if key != current:
                    current, held, lists = key, [], None
                if not asks:
                    held.append(part)
                    continue
                if lists is None:
                    ids = [i for p in held for i in p.column("_id").to_pylist()]
                    own = {}
                    for row, i in enumerate(ids):
                        own.setdefault(i, []).append(row)
                    lists = SortedLists(np.concatenate([_matrix(p.column("_v"), key[0]) for p in held]) if held else np.zeros((0, key[0]), np.int64))
                    held = []
                asked, best, score = [], [], []
                for row, query in enumerate(_matrix(part.column("_v"), key[0])):
                    found, scores = lists.top(query, own.get(part.column("_id")[row].as_py(), []), k)
                    asked += [row] * len(found)
                    best += [ids[i] for i in found.tolist()]
                    score += scores
                of = pa.array(asked, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id").take(of), part.column("_key").take(of), pa.array(best, part.column("_id").type), pa.array(score, pa.int64())],
                    names=["_query", "_key", "_id", "score"],
                )

    found = together.mapInArrow(work, f"_query {kind}, _key bigint, _id {kind}, score bigint")
    best = Window.partitionBy("_query", "_key").orderBy(F.col("score").desc(), F.col("_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("_query").alias("query_id"), "rank", F.col("_id").alias(vec_id), "score")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), size)
