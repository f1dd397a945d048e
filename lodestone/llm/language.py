"""Language identification by prediction by partial matching.

For every language a byte context tree of variable order up to ORDER is counted
on a bounded sample of labelled documents and then frozen. A byte costs
-log2(c / (n + d)) bits in the longest context that has seen it, after an escape
of -log2(d / (n + d)) bits in each longer context that knows d successors in n
occurrences but not this one; a byte that was never seen costs 8 bits at the
end of the escapes. The language whose tree gives the shortest code for the
whole text wins.

The trees are looked up with array operations: a byte is an index into the
alphabet of the training texts, the orders 0 and 1 are plain tables, and those of
orders 2 and 3 hash tables of what occurred, with the code lengths of all
languages in one row, so that memory grows with the samples and not with the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import textbytes as tb

#: Labelled documents of a language that its tree is counted on, at most: those of the least hash of doc_id.
MAX_DOCS = 200
ORDER = 3
#: Bytes of text looked up at once.
CHUNK = 1 << 18


class _Table:
    """Rows by whole-number key: open addressing with linear probing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.rows = rows
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, np.int64)
        self.slot_row = np.zeros((1 << bits) + 64, np.int32)
        left = np.arange(len(keys))
        place = self._slot(keys)
        self.probes = 0
        while len(left):
            free = self.slot_key[place[left]] < 0
            take, first = np.unique(place[left[free]], return_index=True)
            winners = left[free][first]
            self.slot_key[take], self.slot_row[take] = keys[winners], winners
            left = np.setdiff1d(left, winners)
            place[left] += 1
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(tb._MULTIPLIER)) >> self.shift).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Row numbers of keys, -1 for those that there aren't."""
        slot, row = self._slot(key), np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes + 1):
            there = self.slot_key[slot[open_]]
            hit = there == key[open_]
            row[open_[hit]] = self.slot_row[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
            slot[open_] += 1
        return row


class Trees:
    """Frozen context trees of all languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.names = sorted(samples)
        many = len(self.names)
        if not many:
            return
        seen = np.unique(np.frombuffer(b"".join(x for s in samples.values() for x in s), np.uint8))
        # symbol 0 stands for all bytes that the samples don't have
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.size = a = len(seen) + 1
        self.plain: list[np.ndarray] = []  # code lengths of (context, symbol) for orders 0 and 1
        self.codes: dict[int, _Table] = {}  # and for orders 2 and 3
        self.escapes: dict[int, _Table] = {}  # escape costs of the contexts of orders 2 and 3
        for order in range(ORDER + 1):
            keys, counts = {}, {}
            for n in self.names:
                rows = (self._keys(self.symbol[np.frombuffer(x, np.uint8)].astype(np.int64), order + 1) for x in samples[n] if len(x) > order)
                keys[n], counts[n] = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_counts=True)
            union = np.arange(a ** (order + 1)) if order < 2 else np.unique(np.concatenate([keys[n] for n in self.names]))
            contexts = np.unique(union // a)
            escape = np.zeros((len(contexts), many), np.float32)
            code = self._code(order - 1, union % a**order).astype(np.float64) if order else np.full((a, many), 8.0)
            of = np.searchsorted(contexts, union // a)
            for j, n in enumerate(self.names):
                own = np.searchsorted(contexts, keys[n] // a)
                total, kinds = np.bincount(own, counts[n], len(contexts)), np.bincount(own, minlength=len(contexts))
                known = total > 0
                escape[known, j] = -np.log2(kinds[known] / (total[known] + kinds[known]))
                code[:, j] += escape[of, j]
                code[np.searchsorted(union, keys[n]), j] = -np.log2(counts[n] / (total[own] + kinds[own]))
            if order < 2:
                self.plain.append(code.astype(np.float32))
            else:
                self.codes[order] = _Table(union, code.astype(np.float32))
                self.escapes[order] = _Table(contexts, escape)

    def _keys(self, t: np.ndarray, width: int) -> np.ndarray:
        key = t[: len(t) - width + 1]
        for k in range(1, width):
            key = key * self.size + t[k : len(t) - width + 1 + k]
        return key

    def _code(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths of keys (context, symbol) in contexts of an order, a column for each language."""
        if order < 2:
            return self.plain[order][keys]
        table, above = self.codes[order], self.escapes[order]
        row = table.find(keys)
        miss = np.flatnonzero(row < 0)
        out = table.rows[np.maximum(row, 0)] if len(table.rows) else np.zeros((len(keys), len(self.names)), np.float32)
        if len(miss):
            context = above.find(keys[miss] // self.size)
            lost = above.rows[np.maximum(context, 0)] * (context >= 0)[:, None] if len(above.rows) else 0.0
            out[miss] = lost + self._code(order - 1, keys[miss] % self.size**order)
        return out

    def bits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code lengths in bits of the texts data[at[r]:at[r + 1]], a column for each language.

        The first bytes of a text have the contexts that there are.
        """
        many, a = len(self.names), self.size
        out = np.zeros((len(at) - 1, many))
        for low in range(0, len(data), CHUNK):
            high = min(low + CHUNK, len(data))
            s = self.symbol[data[max(0, low - 3) : high]].astype(np.int64)
            if low < 3:
                s = np.concatenate([np.zeros(3 - low, np.int64), s])
            two = (s[1:-2] * a + s[2:-1]) * a + s[3:]
            key = two + s[:-3] * a**3
            cost = self._code(ORDER, key)
            # the first three bytes of each text
            starts = at[:-1][np.diff(at) > 0]
            for order in range(3):
                p = starts + order
                row_end = at[1:][np.diff(at) > 0]
                p = p[(p < row_end) & (p >= low) & (p < high)] - low
                cost[p] = self._code(order, two[p] % a ** (order + 1))
            r0, r1 = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high, "left")
            cuts = np.clip(at[r0 : r1 + 1], low, high) - low
            total = np.concatenate([np.zeros((1, many)), np.cumsum(cost, axis=0, dtype=np.float64)])
            out[r0:r1] += np.diff(total[cuts], axis=0)
        return out


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Trees:
    """Trees of the languages in ``lang``, from the whole texts of at most ``max_docs`` documents of each.

    Null languages and null or empty texts aren't learnt from.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    labelled = docs.where("lang is not null and text is not null and text <> '' and doc_id is not null")
    # a document of a hash in the lowest part of the range may be among the least; the number of languages is small
    some = labelled.select("doc_id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_docs).select("doc_id", "k")
    rows = docs.select("doc_id", "lang", F.encode("text", "utf-8").alias("b")).join(F.broadcast(some), "doc_id").where("lang is not null and b is not null")
    samples: dict[str, list[bytes]] = {}
    for r in rows.orderBy("lang", "k", "b").collect():
        samples.setdefault(r["lang"], []).append(bytes(r["b"]))
    return Trees(samples)


def _identify(sent):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        names = np.array(trees.names, object)
        for batch in batches:
            texts = tb.string_array(batch.column("text"))
            for i, part in tb.chunks(texts):
                data, at = tb.buffers(part)
                bits = trees.bits(data, at)
                size = np.diff(at)
                some = size > 0
                order = np.argsort(bits, axis=1, kind="stable")
                rows = np.arange(len(part))
                best = names[order[:, 0]]
                per_byte = bits[rows, order[:, 0]] / np.maximum(size, 1)
                second = bits[rows, order[:, min(1, len(names) - 1)]] / np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, len(part)),
                        pa.array([x if s else None for x, s in zip(best, some)], pa.string()),
                        pa.array(np.round(per_byte, 4), mask=~some),
                        pa.array(np.round(second - per_byte, 4), mask=~some),
                    ],
                    ["doc_id", "language", "bits_per_byte", "margin"],
                )

    return identify


IDENTIFIED = "doc_id long, language string, bits_per_byte double, margin double"


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, language, bits_per_byte, margin) of every document, from its whole text.

    margin is by how many bits a byte the next language is longer; of languages with
    the same code length the first in the alphabet wins. Null and empty texts
    have a null language, bits and margin. Rows with a null doc_id and repeated rows
    are answered like any other. Without any language all are null. An empty table
    gives an empty result. Texts of any length are read whole, CHUNK bytes at once;
    other columns, whatever their names, don't matter.
    """
    if not trees.names:
        none = [F.lit(None).cast(t).alias(n) for n, t in (("language", "string"), ("bits_per_byte", "double"), ("margin", "double"))]
        return docs.select(F.col("doc_id").cast("long"), *none)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_identify(docs.sparkSession.sparkContext.broadcast(trees)), IDENTIFIED)  # at most MAX_DOCS samples a language


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))


QUERIES = {"op8_language": op8_language}
