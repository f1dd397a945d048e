"""Pairs of rows that share a key, in blocks, so that a key with many rows is work for many tasks.

All pairs are made, as many as there are; a task holds a block of them at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a key in a block.
BLOCK = 2000


def tasks(df: DataFrame) -> int:
    """Tasks for work that the sizes of its inputs don't tell: some for each core."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _numbered(rows: DataFrame, key: str, order: str, block: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.where(F.col(key).isNotNull()).withColumns({"_own": F.floor((place - 1) / block).cast("int"), "_blocks": F.ceil(F.count("*").over(Window.partitionBy(key)) / block).cast("int")})


def _met(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    on, n = [key, "_a", "_b"], tasks(a)
    # sizes are known to no one before the rows are there, so neither side is broadcast
    return a.repartition(n, *on).hint("merge").join(b.repartition(n, *on), on).drop("_a", "_b")


def pairs(a: DataFrame, b: DataFrame, key: str, order_a: str, order_b: str, block: int = BLOCK) -> DataFrame:
    """Every row of a with every row of b of the same key; their other columns have different names."""
    a, b = _numbered(a, key, order_a, block), _numbered(b, key, order_b, block)
    some_a, some_b = (x.groupBy(key).agg(F.max("_blocks").alias("_others")) for x in (a, b))
    each = F.explode(F.sequence(F.lit(0), F.col("_others") - 1))
    left = a.drop("_blocks").join(some_b, key).withColumnRenamed("_own", "_a").withColumn("_b", each).drop("_others")
    right = b.drop("_blocks").join(some_a, key).withColumnRenamed("_own", "_b").withColumn("_a", each).drop("_others")
    return _met(left, right, key)


def ordered_pairs(rows: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame:
    """Every two rows of a key of which the first is less by ``order``: the key and the columns of each, prefixed by a_ and b_."""
    numbered = _numbered(rows, key, order, block)
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != key]
    left = numbered.select(key, *named("a"), F.col("_own").alias("_a"), F.explode(F.sequence("_own", F.col("_blocks") - 1)).alias("_b"))
    right = numbered.select(key, *named("b"), F.explode(F.sequence(F.lit(0), "_own")).alias("_a"), F.col("_own").alias("_b"))
    return _met(left, right, key).where(F.col(f"a_{order}") < F.col(f"b_{order}"))
