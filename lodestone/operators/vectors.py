"""Nearest vectors by cosine: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of query vectors sent to a task at once; more queries take several passes.
SLICE_BYTES = 32 << 20
#: Queries and rows whose scores a task has at once: 8 MB.
QUERIES, ROWS = 512, 2048


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a column of equally long lists, and which rows have one; a vector without length is zeros."""
    rows = [i for i, x in enumerate(column.is_valid().to_pylist()) if x]
    some = column.take(pa.array(rows, pa.int64()))
    flat = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.nan_to_num(flat.reshape(len(rows), -1)) if len(rows) else np.zeros((0, 0))
    size = np.sqrt((x * x).sum(axis=1, keepdims=True)) if x.size else np.ones((len(rows), 1))
    return x / np.where(size > 0, size, 1), np.array(rows, np.int64)


def _nearest(ids: np.ndarray, q: np.ndarray, k: int, itself: bool):
    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_id, best = np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x, rows = _matrix(part.column("v"))
                if not len(rows):
                    continue
                own = part.column("id").to_numpy(zero_copy_only=False)[rows]
                for first in range(0, len(ids), QUERIES):
                    some = slice(first, first + QUERIES)
                    score = np.round(q[some] @ x.T, 6)
                    if not itself:
                        score[ids[some, None] == own[None, :]] = -np.inf
                    # what is below a query's k-th so far can't enter; most rows go so, before anything is sorted
                    at_query, at_row = np.nonzero(score >= best[some, -1:]) if k else ((), ())
                    if not len(at_query):
                        continue
                    touched, within = np.unique(at_query, return_inverse=True)
                    value = np.concatenate([best[some][touched].ravel(), score[at_query, at_row]])
                    of = np.concatenate([best_id[some][touched].ravel(), own[at_row]])
                    whose = np.concatenate([np.repeat(np.arange(len(touched)), k), within])
                    order = np.lexsort((of, -value, whose))
                    starts = np.searchsorted(whose[order], np.arange(len(touched)))
                    take = order[starts[:, None] + np.arange(k)]
                    best[first + touched], best_id[first + touched] = value[take], of[take]
        query, place = np.nonzero(best > -np.inf)
        for at in range(0, len(query), 100_000):
            i, j = query[at : at + 100_000], place[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(best_id[i, j]), pa.array(best[i, j])], ["query", "unit_id", "score"])

    return nearest


def nearest(base: DataFrame, queries: DataFrame, key: str, vector: str, k: int, itself: bool = True, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query, unit_id, score): the k rows of the greatest cosine for each query vector, ties by the lesser id.

    Every task keeps k rows a query, so only those are shuffled. Queries go to the
    tasks in slices of bounded size. Null vectors match nothing. itself: whether a
    row is among its own neighbours.
    """
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    slices = rows.count() * width * 8 // slice_bytes + 1
    other = base.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    out = None
    for i in range(slices):
        part = rows if slices == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == i)
        table = part.toArrow()
        q, at = _matrix(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())))
        ids = table.column("id").to_numpy()[at]
        if not len(ids):
            continue
        found = other.mapInArrow(_nearest(ids, q, k, itself), "query long, unit_id long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return base.sparkSession.createDataFrame([], "query long, unit_id long, score double")
    first = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "unit_id"))
    return out.withColumn("rank", first).where(F.col("rank") <= k).select("query", "unit_id", "score")
