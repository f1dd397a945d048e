"""Connected components of an undirected graph by min-label propagation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import durable

#: Edges up to which the labels are worked out in the driver's memory (16 bytes an edge).
LOCAL_EDGES = 1_000_000


def components_in_memory(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids and the least id reachable from each, for edges (a, b)."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        least = np.minimum(label[x], label[y])
        # hang the roots of both ends under the lesser label, then flatten
        np.minimum.at(label, before[x], least)
        np.minimum.at(label, before[y], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return ids, ids[label]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every id that an edge touches.

    component is the smallest id reachable. Up to ``local_edges`` distinct edges
    between whole-number ids are labelled in the driver. Beyond, each round takes
    the least label of the neighbours and then jumps once along the label itself,
    so the number of rounds grows with the logarithm of a path's length. Both
    ways give the same labels. Edges with a null end count for nothing; an empty
    input gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = durable(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kinds = dict(both.dtypes)
    if kinds["a"] in ("int", "bigint") and kinds["b"] == kinds["a"] and both.count() <= local_edges:
        pairs = both.toPandas()
        ids, label = components_in_memory(pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64))
        kind = kinds["a"]
        if not len(ids):
            return both.select(F.col("a").alias("id"), F.col("b").alias("component"))
        return edges.sparkSession.createDataFrame(pd.DataFrame({"id": ids, "component": label}), f"id {kind}, component {kind}")
    both = durable(both.union(both.select("b", "a")).distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    while True:
        around = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        stepped = labels.join(around, "id").select("id", "component", F.least("component", "near").alias("step"))
        target = labels.select(F.col("id").alias("step"), F.col("component").alias("jump"))
        moved = durable(
            stepped.join(target, "step").select("id", F.col("component").alias("before"), F.least("step", "jump").alias("component"))
        )
        done = moved.where("before <> component").isEmpty()
        labels = moved.select("id", "component")
        if done:
            return labels
