"""Best-two-fit packing of documents into token sequences.

A document of more than ``capacity`` tokens is first cut into whole sequences
and a rest, so that nothing is truncated. The rests and the other documents are
packed shard by shard: a bin is filled greedily with the largest document that
fits, and then its smallest document is replaced by the two unpacked documents
that fill its expanded gap best, if they fill more.

Shards are made by a hash of doc_id and hold about ``shard_docs`` documents;
only (doc_id, tokens) is moved, never a text.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb

#: Tokens of a sequence.
CAPACITY = 2048
#: Documents of a shard; a shard is packed in one task's memory.
SHARD_DOCS = 20_000


def count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, tokens): words and, one by one, the other visible characters."""
    mark = np.zeros(256, np.uint8)
    mark[33:127] = 1
    mark[tb._WORD] = 0
    for batch in batches:
        texts = tb.string_array(batch.column("text"))
        counts = np.zeros(len(texts), np.int64)
        for i, part in tb.chunks(texts):
            data, at = tb.buffers(part)
            start, _ = tb.spans(data, at, tb._WORD)
            words = np.diff(np.searchsorted(start, at))
            marks = np.diff(np.concatenate([[0], np.cumsum(mark[data], dtype=np.int64)])[at])
            counts[i : i + len(part)] = words + marks
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts)], ["doc_id", "tokens"])


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices into ``sizes``; every index is in one bin. Sizes lie between 1 and the capacity.

    Equal sizes are taken in order of their index, so the result is fully determined.
    """
    left: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        left.setdefault(sizes[i], []).append(i)
    here = sorted(left)  # sizes that some unpacked document has

    def take(size: int) -> int:
        i = left[size].pop()
        if not left[size]:
            del here[bisect_right(here, size) - 1]
        return i

    def give_back(size: int, i: int) -> None:
        if not left[size]:
            insort(here, size)
        left[size].append(i)

    bins = []
    while here:
        content: list[int] = []
        gap = capacity
        while here and here[0] <= gap:
            size = here[bisect_right(here, gap) - 1]
            content.append(take(size))
            gap -= size
        if len(content) > 1 and gap and here:
            small = sizes[content[-1]]
            a, b = best_pair(here, left, gap + small)
            if a + b > small:
                give_back(small, content.pop())
                content += [take(a), take(b)]
        bins.append(content)
    return bins


def best_pair(here: list[int], left: dict[int, list[int]], room: int) -> tuple[int, int]:
    """Two sizes (larger first) of unpacked documents with the largest sum within room; (0, 0) if none fit. Of equal sums, the one with the largest first size."""
    best = (0, 0)
    low, high = 0, bisect_right(here, room) - 1
    while low <= high:
        a, b = here[high], here[low]
        if low == high and len(left[a]) < 2:
            break
        if a + b > room:
            high -= 1
            continue
        if a + b > sum(best):
            best = (a, b)
            if a + b == room:
                break
        low += 1
    return best


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        group = group.sort_values(["doc_id", "start"], kind="stable")
        ids, starts, sizes = (group[c].tolist() for c in ("doc_id", "start", "size"))
        rows = [
            (shard, k, [ids[i] for i in b], [starts[i] for i in b], [sizes[i] for i in b], sum(sizes[i] for i in b))
            for k, b in enumerate(best_two_fit(sizes, capacity))
        ]
        return pd.DataFrame(rows, columns=["shard", "bin", "doc_ids", "starts", "lengths", "tokens"])

    return pack


BINS = "shard int, bin long, doc_ids array<long>, starts array<long>, lengths array<long>, tokens long"


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Bins (shard, bin, doc_ids, starts, lengths, tokens): the spans of tokens that make up each sequence.

    A span is tokens starts[i] to starts[i] + lengths[i] of document doc_ids[i].
    Every token of every document lies in one bin, and no bin holds more than
    ``capacity``. Null, empty and blank texts have no token and are in no bin;
    rows with a null doc_id are left out. Repeated rows of a doc_id are packed
    as often as they occur. An empty table gives no bin.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    rows = docs.select("doc_id", "text").where("doc_id is not null")
    shards = rows.count() // shard_docs + 1
    sized = rows.mapInArrow(count_tokens, "doc_id long, tokens long").where("tokens > 0")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    pieces = sized.select(
        "shard",
        "doc_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), (F.ceil(F.col("tokens") / capacity) - 1).cast("int")),
                lambda k: F.struct((k * capacity).cast("long").alias("start"), F.least(F.lit(capacity).cast("long"), F.col("tokens") - k * capacity).alias("size")),
            )
        ).alias("p"),
    ).select("shard", "doc_id", "p.start", "p.size")
    return pieces.groupBy("shard").applyInPandas(_pack(capacity), BINS)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of CAPACITY tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
