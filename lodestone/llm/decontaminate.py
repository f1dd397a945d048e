"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Every n-gram of a benchmark item is counted over all documents. Those found in
at most ``max_share`` of the documents, and the rarest of each stretch of an item, however common,
are seeds. A document that holds a seed
of an item is aligned with that item, word by word, in the window around each
group of seeds; the local alignment score, as a share of the item's own score,
says how much of the item the passage repeats, edited or not.

The benchmark is the small side: it is sent to every task in slices of at most
``SLICE_BYTES``. A benchmark above that takes several passes over the documents
and is never sent whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.operators.durable import durable

#: Words of a seed.
SEED_WORDS = 3
#: Words that an item has at least; shorter ones are phrases that any text may hold, and are left out.
MIN_WORDS = 5
#: Share of the documents (and at least so many documents) up to which an n-gram is rare.
MAX_SHARE, MIN_COUNT = 0.001, 20
#: Seeds of every stretch of an item as long as a passage that counts, its rarest: where a part of the
#: item is spread over the corpus, none of that part may be rare.
MIN_SEEDS = 8
#: A passage counts from this share of the item's own alignment score.
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of benchmark text sent to a task at once.
SLICE_BYTES = 32 << 20


class Items:
    """Word hashes of benchmark items and the sorted table of their n-grams."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int = SEED_WORDS, min_words: int = MIN_WORDS):
        w = tb.words(tb.string_array(pa.array(texts, pa.string())))
        some = [k for k in range(len(ids)) if w.first[k + 1] - w.first[k] >= max(1, min_words)]
        self.ids = np.array([ids[k] for k in some], np.int64)
        self.words = [w.hash[w.first[k] : w.first[k + 1]] for k in some]
        lengths = sorted({min(n, len(x)) for x in self.words})
        self.tables = {}
        for m in lengths:
            grams, item, offset = [], [], []
            for k, x in enumerate(self.words):
                if min(n, len(x)) == m:
                    g = gram_hashes(x, m)
                    grams.append(g)
                    item.append(np.full(len(g), k))
                    offset.append(np.arange(len(g)))
            g, k, o = np.concatenate(grams), np.concatenate(item), np.concatenate(offset)
            order = np.argsort(g, kind="stable")
            self.tables[m] = (g[order], k[order], o[order])

    def only_rare(self, grams: np.ndarray, counts: np.ndarray, limit: int, at_least: int, min_score: float) -> "Items":
        """Leaves the n-grams that at most ``limit`` documents have, and of every stretch of ``min_score`` of an item's
        n-grams the rarest ``at_least`` with those as rare as the last."""
        order = np.argsort(grams)
        grams, counts = grams[order], counts[order]
        for m, (g, k, o) in self.tables.items():
            if len(grams):
                place = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
                n = np.where(grams[place] == g, counts[place], 0)
            else:
                n = np.zeros(len(g), np.int64)
            keep = n <= limit
            by_item = np.lexsort((o, k))
            cut = np.flatnonzero(np.diff(k[by_item], prepend=-1))
            for rows in np.split(by_item, cut[1:]):
                keep[rows] |= rarest_of_stretches(n[rows], max(1, int(min_score * (len(rows) + m - 1)) - m + 1), at_least)
            self.tables[m] = (g[keep], k[keep], o[keep])
        return self


def rarest_of_stretches(n: np.ndarray, length: int, at_least: int) -> np.ndarray:
    """Which of the counts are among the least ``at_least`` of some run of ``length``, or as small as the last of them."""
    if not len(n):
        return np.zeros(0, bool)
    length = min(length, len(n))
    keep = np.zeros(len(n), bool)
    runs = np.lib.stride_tricks.sliding_window_view(n, length)
    step = max(1, (1 << 22) // length)
    for a in range(0, len(runs), step):
        some = runs[a : a + step]
        last = min(at_least, length) - 1
        bound = np.partition(some, last, axis=1)[:, last]
        # a count stays if it is within the bound of some run that it is in
        most = np.full(len(some) + 2 * (length - 1), np.iinfo(n.dtype).min, n.dtype)
        most[length - 1 : length - 1 + len(some)] = bound
        reach = np.lib.stride_tricks.sliding_window_view(most, length).max(axis=1)
        keep[a : a + len(reach)] |= n[a : a + len(reach)] <= reach
    return keep


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; empty where there are fewer."""
    if len(words) < n:
        return words[:0]
    g = words[: len(words) - n + 1]
    for k in range(1, n):
        g = tb.mix(g * np.uint64(tb._MULTIPLIER) + words[k : len(words) - n + 1 + k])
    return g


def _filter(grams: np.ndarray) -> np.ndarray:
    """Bit table that lets through every gram and few others."""
    bits = np.zeros(1 << max(16, int(np.ceil(np.log2(max(1, len(grams)) * 16)))), bool)
    bits[grams & np.uint64(len(bits) - 1)] = True
    return bits


def _hits(hashes: np.ndarray, bounds: np.ndarray, n: int, table: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``hashes`` where an n-gram of the table starts within one row, and the grams there."""
    g = gram_hashes(hashes, n)
    at = np.flatnonzero(bits[g & np.uint64(len(bits) - 1)])
    place = np.minimum(np.searchsorted(table, g[at]), len(table) - 1)
    at = at[table[place] == g[at]]
    row = np.searchsorted(bounds, at, "right")
    at = at[at + n <= bounds[np.minimum(row, len(bounds) - 1)]]
    return at, g[at]


def _count(items: Items):
    tables = {m: np.unique(t[0]) for m, t in items.tables.items()}
    bits = {m: _filter(t) for m, t in tables.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, texts in tb.chunks(tb.string_array(batch.column("text"))):
                w = tb.words(texts)
                for m, table in tables.items():
                    at, g = _hits(w.hash, w.first, m, table, bits[m])
                    row = np.searchsorted(w.first, at, "right")
                    pair = np.unique(np.stack([row.astype(np.uint64), g]), axis=1)
                    found.append(pair[1])
            grams, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])

    return count


def smith_waterman(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of an item with equally long passages (rows), and where they end.

    Words score MATCH or MISMATCH, a left-out word GAP. A passage is padded with
    zeros, which match nothing.
    """
    many, width = passages.shape
    kind = np.int16 if MATCH * max(len(item), width) < 30_000 else np.int32
    known, code = np.unique(item, return_inverse=True)
    place = np.minimum(np.searchsorted(known, passages), len(known) - 1)
    coded = np.where(known[place] == passages, place, -1).astype(np.int32)
    h = np.zeros((many, width + 1), kind)
    steps = (np.arange(width + 1) * -GAP).astype(kind)
    best, end = np.zeros(many, kind), np.zeros(many, np.int64)
    for word in code.tolist():
        up = h + kind(GAP)
        gain = (coded == word).astype(kind)
        gain *= kind(MATCH - MISMATCH)
        gain += kind(MISMATCH)
        gain += h[:, :-1]
        np.maximum(up[:, 1:], gain, out=up[:, 1:])
        np.maximum(up, 0, out=up)
        # gaps in the item: the best of all cells to the left, less a gap for each step
        up += steps
        h = np.maximum.accumulate(up, axis=1)
        h -= steps
        top = h.max(axis=1)
        better = top > best
        if better.any():
            end[better] = h[better].argmax(axis=1)
            best = np.maximum(best, top)
    return best.astype(np.int64), end


def _windows(at: np.ndarray, offset: np.ndarray, length: int, first: int, last: int) -> list[tuple[int, int]]:
    """Windows around seeds (at, offset in the item) in which the whole item with insertions fits; those that overlap are joined."""
    slack = length // 2 + 2
    low = np.maximum(first, at - offset - slack)
    high = np.minimum(last, at - offset + length + slack)
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(low.tolist(), high.tolist())):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _align(items: Items, min_score: float):
    bits = {m: _filter(t[0]) for m, t in items.tables.items() if len(t[0])}

    def batch_pairs(w: tb.Words) -> list[tuple[int, int, float, int, int]]:
        """(row, item, score, first word, last word) of the passages."""
        rows, ks, ats, offsets = [], [], [], []
        for m, filter_bits in bits.items():
            grams, item, offset = items.tables[m]
            at, g = _hits(w.hash, w.first, m, grams, filter_bits)
            low, high = np.searchsorted(grams, g, "left"), np.searchsorted(grams, g, "right")
            which = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)])[:-1], high - low) + np.arange((high - low).sum())
            at = np.repeat(at, high - low)
            rows.append(np.searchsorted(w.first, at, "right") - 1)
            ks.append(item[which])
            ats.append(at)
            offsets.append(offset[which])
        if not rows:
            return []
        row, k, at, offset = (np.concatenate(x) for x in (rows, ks, ats, offsets))
        order = np.lexsort((at, row, k))
        row, k, at, offset = row[order], k[order], at[order], offset[order]
        cut = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(k, prepend=-1) != 0))
        jobs: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(row)).tolist()):
            r, i = int(row[a]), int(k[a])
            spans = _windows(at[a:b], offset[a:b], len(items.words[i]), int(w.first[r]), int(w.first[r + 1]))
            jobs.setdefault(i, []).extend((r, x, y) for x, y in spans)
        out = []
        for i, spans in jobs.items():
            own = items.words[i]
            spans.sort(key=lambda s: s[2] - s[1])
            for part in range(0, len(spans), 512):
                some = spans[part : part + 512]
                width = some[-1][2] - some[-1][1]
                passages = np.zeros((len(some), width), np.uint64)
                for j, (_, x, y) in enumerate(some):
                    passages[j, : y - x] = w.hash[x:y]
                score, end = smith_waterman(own, passages)
                for (r, x, _), s, e in zip(some, score.tolist(), end.tolist()):
                    share = s / (MATCH * len(own))
                    if share >= min_score:
                        out.append((r, i, share, int(x - w.first[r]), int(x - w.first[r] + e)))
        best: dict[tuple[int, int], tuple] = {}
        for r, i, share, x, e in out:
            if (r, i) not in best or (share, -e) > (best[r, i][2], -best[r, i][4]):
                best[r, i] = (r, i, share, x, e)
        return sorted(best.values())

    return batch_pairs


def _emit(items: Items, min_score: float):
    batch_pairs = _align(items, min_score)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], []]
            for i, texts in tb.chunks(tb.string_array(batch.column("text"))):
                for r, k, share, _, e in batch_pairs(tb.words(texts)):
                    for column, x in zip(out, (int(ids[i + r]), int(items.ids[k]), share, e)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "score", "end_word"])

    return emit


def _slices(benchmark: DataFrame, slice_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark by and by, at most about ``slice_bytes`` of text in the driver at once."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    many = int(total // slice_bytes) + 1
    for k in range(many):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == k).orderBy("item_id", "text").collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = SEED_WORDS, max_share: float = MAX_SHARE, min_score: float = MIN_SCORE, slice_bytes: int = SLICE_BYTES, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, score, end_word): documents that hold a copy of a benchmark item, and how much of it.

    score is the best local alignment score of any passage divided by the
    score of the whole item, from min_score to 1; end_word is the place of the
    passage's last word. Rows with null ids, null or empty texts and items
    of fewer than ``min_words`` words give nothing; an empty table on either side gives an empty
    result. Repeated rows of a doc_id give repeated result rows; items with the
    same text each give their own. Of passages with equal scores the first counts.
    Texts of any length are read whole; other columns, whatever their names, don't matter.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    limit = max(MIN_COUNT, int(max_share * docs.count()))
    out = None
    for ids, texts in _slices(benchmark, slice_bytes):
        items = Items(ids, texts, n, min_words)
        if not items.tables:
            continue
        counted = docs.mapInArrow(_count(items), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
        seen = counted.where(F.col("n") > limit).toPandas()  # no more rows than the slice has n-grams
        items = items.only_rare(seen["gram"].to_numpy(np.int64).view(np.uint64), seen["n"].to_numpy(np.int64), limit, MIN_SEEDS, min_score)
        part = docs.mapInArrow(_emit(items, min_score), "doc_id long, item_id long, score double, end_word long")
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without those that hold a copy of a benchmark item; all columns as they were.

    Rows with a null doc_id stay.
    """
    lost = durable(contaminated(docs, benchmark, **options).select("doc_id").distinct())
    few = lost.count() <= 2_000_000
    return docs.join(F.broadcast(lost) if few else lost, "doc_id", "left_anti").select(docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document repeats at least half."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op1_decontaminate": op1_decontaminate}
