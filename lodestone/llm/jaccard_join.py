"""N-gram Jaccard join by parity sketches.

Sets whose Jaccard similarity is at least ``t`` have sizes within a factor of
``1/t`` and differ in at most ``(1 - t) / t`` times the smaller size. Documents
fall into size bands; the n-grams of a document are dealt by their hash into as
many sketch words as the band says, more than pairs of that band can differ in, and
a word is the parity (xor) of the hashes in it. An n-gram that only one of two
documents has changes one word. In short documents every n-gram is a word.

So similar documents have all words in common but so many, and if the words are
taken in one order, the same for all documents, then the first ``differ + SHARED``
of each hold at least SHARED common ones (prefix filter). The order puts the words
of the rarest n-grams first, counted over all documents. It decides how many
strangers meet, never which similar documents do.

Documents that have a word in common meet in that word's list. Groups of copies
would make all pairs of their members there, so groups are found first: in a few
rounds, every list's members are held against one of them, the pairs that meet most
often are verified on the whole n-gram sets, and documents that got connected carry
one label from then on. Last, all members of each list that have different labels
are held against each other where their sizes allow it, and pairs with SHARED words
in common are verified. So every similar pair is either verified or already
connected by verified ones: the groups are those of all similar pairs (but for
clashes of 64-bit hashes), and only links within a group that is known to hold
together are left out. No list, bucket or group is cut. Documents with equal sets
in one task are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.operators.components import connected_components
from lodestone.operators.durable import durable, written

#: Production parameters: n-grams of one word, Jaccard of at least 0.8. With edits in one word of
#: ten, near copies stay above 0.8 for n = 1 but fall below 0.7 for n = 2, where the pigeonhole
#: leaves fewer than two n-grams a sketch word.
N, T = 1, 0.8
#: Documents of a routing table up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Sketch words that the documents of a candidate pair have in common, where so many are sure to be.
SHARED = 3
#: Sizes from which n-grams are dealt into sketch words; in smaller sets each is a word.
DEALT = 64
#: Counters that tell which n-grams are rare, and the blocks that they are summed in; n-grams of one counter are as rare as all of them together.
COUNTERS, BLOCKS = 1 << 20, 64
#: Signatures of a task that are packed together, and those unpacked at once.
PACKED, UNPACKED = 1 << 19, 1 << 16
#: Candidate pairs put out at once.
PAIRS = 1 << 18
#: Members of a list in one row; longer lists take several, and those are held against each other in pairs.
PART = 1 << 16
#: Bits of the sketch of a whole set at least and at most; between, as many as it has n-grams.
BITS = 256, 1 << 17
#: Rounds that look for groups, and the share of the lists (one in so many) that each looks at.
ROUNDS, LOOK = 3, 8
#: Documents of a group in one row of the query's result.
LISTED = 10_000
#: Labelled documents up to which their labels are sent to all tasks (16 bytes each); beyond, they are joined by a shuffle.
LABELS = 2_000_000


def bands(t: float, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower ends of the size bands up to ``largest`` and the number of sketch words of each."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] + 1, int(lows[-1] / t / t)))
    low = np.array(lows, np.int64)
    most = np.floor((1 - t) / t * (low[1:] - 1) + 1e-9).astype(np.int64)
    return low[:-1], most + most * 3 // 10 + 4


def _words_of(sets: np.ndarray, weight: np.ndarray, bounds: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sketch words of rows that have so many, the sums of their n-grams' weights, and their bounds."""
    first = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    row = np.repeat(np.arange(len(words)), np.diff(bounds))
    at = first[row] + ((sets >> np.uint64(16)) % words[row].astype(np.uint64)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    held, start = np.unique(at[order], return_index=True)
    sketch, total = np.zeros(first[-1], np.uint64), np.zeros(first[-1], np.int64)
    if len(held):
        sketch[held] = np.bitwise_xor.reduceat(tb.mix(sets[order]), start)
        total[held] = np.add.reduceat(weight[order], start)
    return sketch, total, first


def _firsts(row: np.ndarray, sign: np.ndarray, weight: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, sign) of the first ``most`` words of each row, the heaviest; rows ascend."""
    order = np.lexsort((sign, -weight, row))
    row, sign = row[order], sign[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
    keep = rank < most[row]
    return row[keep], sign[keep]


def _needs(size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether sets of the sizes are similar to their equals only, as one n-gram more or less is too many; signs that each shares with a similar one at least."""
    share = np.ceil(t * size - 1e-9).astype(np.int64)
    alone = (size > 0) & (share == size) & (np.floor(size / t + 1e-9) < size + 1)
    return alone, np.where(alone, 1, np.minimum(SHARED, share))


def signatures(sets: np.ndarray, bounds: np.ndarray, t: float, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature) of all rows; for each row the least number of signatures it has in a band, and a hash of its whole set.

    Signatures are the first sketch words of the row's band, and of the band below
    where a smaller partner may be. weights: of the n-grams of each counter.
    """
    size = np.diff(bounds)
    weight = weights[_counter(sets)].astype(np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(sets ^ np.uint64(tb._INVERSE)), dtype=np.uint64)])
    key = tb.mix(total[bounds[1:]] - total[bounds[:-1]] + size.astype(np.uint64))
    low, words = bands(t, int(size.max(initial=1)))
    differ = np.floor((1 - t) / t * (np.append(low[1:], 1 << 40) - 1) + 1e-9).astype(np.int64)
    own = np.searchsorted(low, size, "right") - 1
    share = np.ceil(t * size - 1e-9).astype(np.int64)
    alone, needs = _needs(size, t)
    rows, signs = [np.flatnonzero(alone)], [key[alone]]
    least = np.where(alone, 1, 1 << 30)
    # partners of a set below DEALT / t may themselves be below DEALT
    pick = np.flatnonzero((size > 0) & ~alone & (share < DEALT))
    if len(pick):
        part_bounds = np.concatenate([[0], np.cumsum(size[pick])]).astype(np.int64)
        at = np.repeat(bounds[pick] - part_bounds[:-1], size[pick]) + np.arange(part_bounds[-1])
        row, sign = _firsts(np.repeat(np.arange(len(pick)), size[pick]), tb.mix(sets[at]), weight[at], (size - share + needs)[pick])
        rows.append(pick[row])
        signs.append(sign)
        least[pick] = (size - share + needs)[pick]
    for step in (0, 1):
        band = own - step
        use = (size >= DEALT) & (band >= 0)
        if step:
            # the largest member of the band below that can still be similar enough
            use &= ((low[np.maximum(own, 0)] - 1) >= share) & (low[np.maximum(own, 0)] > DEALT)
        pick = np.flatnonzero(use)
        if not len(pick):
            continue
        part_bounds = np.concatenate([[0], np.cumsum(size[pick])]).astype(np.int64)
        at = np.repeat(bounds[pick] - part_bounds[:-1], size[pick]) + np.arange(part_bounds[-1])
        sketch, heavy, first = _words_of(sets[at], weight[at], part_bounds, words[band[pick]])
        row = np.repeat(np.arange(len(pick)), np.diff(first))
        place = (band[pick][row].astype(np.uint64) << np.uint64(40)) | (np.arange(len(sketch)) - first[row]).astype(np.uint64)
        most = np.minimum(np.floor((1 - t) / t * size[pick] + 1e-9).astype(np.int64), differ[band[pick]])
        row, sign = _firsts(row, tb.mix(tb.mix(place + np.uint64(1)) ^ sketch), heavy, most + SHARED)
        rows.append(pick[row])
        signs.append(sign)
        least[pick] = np.minimum(least[pick], most + SHARED)
    return np.concatenate(rows), np.concatenate(signs), least, key


def allowed(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """N-grams that only one of two similar sets of the sizes a and b has, at most."""
    return np.floor((1 - t) / (1 + t) * (a + b) + 1e-9).astype(np.int64)


def _gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    return tb.distinct_by_row(*tb.grams(tb.words(texts), n))


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(32)).astype(np.int64) % COUNTERS


def _packed(number: np.ndarray) -> bytes:
    # the bytes of one rank together, as most are 0
    return pa.compress(number.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, many: int) -> np.ndarray:
    each = pa.decompress(packed, many * 8, "zstd", asbytes=True)
    return np.frombuffer(each, np.uint8).reshape(8, -1).T.copy().view(np.int64)[:, 0]


def _pack_signatures(bucket: np.ndarray, doc: np.ndarray, meta: np.ndarray, sign: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket, with its documents, metas and signs; so a signature takes as many bytes in many buckets as in few."""
    order = np.lexsort((doc, meta, bucket))
    bucket, doc, meta, sign = (c[order] for c in (bucket, doc, meta, sign))
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket)).tolist()
    many, docs, metas, signs = [], [], [], []
    for a, b in zip(cut[:-1], cut[1:]):
        least = doc[a:b].min(keepdims=True)
        many.append(b - a)
        docs.append(_packed(np.concatenate([least, doc[a:b] - least])))
        metas.append(_packed(np.diff(meta[a:b], prepend=0)))
        signs.append(sign[a:b].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array(many, pa.int32()), *(pa.array(x, pa.binary()) for x in (docs, metas, signs))], ["bucket", "many", "docs", "metas", "signs"]
    )


def _unpack_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, sign, doc_id, meta) of rows that ``_pack_signatures`` made."""
    for batch in batches:
        for x in batch.to_pylist():
            doc = _unpacked(x["docs"], x["many"] + 1)
            rows = [np.full(x["many"], x["bucket"], np.int32), np.frombuffer(x["signs"], np.int32), doc[1:] + doc[0], np.cumsum(_unpacked(x["metas"], x["many"]))]
            for i in range(0, x["many"], UNPACKED):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + UNPACKED]) for c in rows], ["bucket", "sign", "doc_id", "meta"])


def _emit_signatures(n: int, t: float, weights: np.ndarray, buckets: int):
    """Packed rows of signatures; of the documents of a task with equal sets only the first, and signatures of a negative meta, in bucket 0, that link the others to it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: dict[int, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, texts in tb.chunks(tb.string_array(batch.column("text"))):
                sets, bounds = _gram_sets(texts, n)
                size = np.diff(bounds).astype(np.int64)
                row, sign, least, key = signatures(sets, bounds, t, weights)
                own = ids[i : i + len(size)]
                first = np.fromiter((firsts.setdefault(k, d) for k, d in zip(key.tolist(), own.tolist())), np.int64, len(own))
                again = (first != own) & (size > 0)
                keep = ~again[row]
                # repeated rows of one document, too, count once
                row, sign = row[keep], sign[keep]
                none = np.zeros(int(again.sum()), np.int32)
                bucket = ((sign >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
                low = sign.astype(np.uint32).view(np.int32)
                new = (np.append(bucket, none), np.append(own[row], own[again]), np.append((size << 32 | least)[row], -1 - first[again]), np.append(low, none))
                held.append(new)
                waiting += len(new[0])
                if waiting >= PACKED:
                    yield _pack_signatures(*(np.concatenate(x) for x in zip(*held)))
                    held, waiting = [], 0
        if waiting:
            yield _pack_signatures(*(np.concatenate(x) for x in zip(*held)))

    return emit


def _count_grams(n: int):
    """(block, numbers): in how many of a task's documents the n-grams of each counter are, a row a block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            held = [_counter(_gram_sets(part, n)[0]) for _, part in tb.chunks(tb.string_array(batch.column("text")))]
            if held:
                number += np.bincount(np.concatenate(held), minlength=COUNTERS)
        blocks = pa.array(np.arange(BLOCKS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([blocks, pa.array([_packed(x) for x in number.reshape(BLOCKS, -1)], pa.binary())], ["block", "numbers"])

    return count


def _summed(rows: pa.Table) -> pa.Table:
    total = np.zeros(COUNTERS // BLOCKS, np.int64)
    for packed in rows.column("numbers"):
        total += _unpacked(packed.as_py(), len(total))
    return pa.table({"block": rows.column("block").slice(0, 1), "numbers": pa.array([_packed(total)], pa.binary())})


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many of the documents, all of them, the n-grams of each counter are."""
    counted = docs.select("text").mapInArrow(_count_grams(n), "block int, numbers binary").groupBy("block").applyInArrow(_summed, "block int, numbers binary")
    number = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for row in counted.toArrow().to_pylist():
        number[row["block"]] = _unpacked(row["numbers"], COUNTERS // BLOCKS)
    return number.ravel()


def gram_weights(docs: DataFrame, n: int) -> np.ndarray:
    """Weights of the n-grams of each counter that are greater the rarer they are.

    The weights only order the sketch words; any would give the same similar pairs.
    """
    number = np.maximum(gram_counts(docs, n), 1)
    return np.round(8 * np.log2(number.max() / number)).astype(np.int16) + np.int16(1)


def _emit_lists(rows: list[list[np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
    key, doc, meta = (np.concatenate(x) for x in zip(*rows))
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc, meta = key[fresh], doc[fresh], meta[fresh]
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]]))
    many = np.diff(np.append(start, len(key)))
    use = many > (0 if part else 1)
    if use.any():
        keep = np.repeat(use, many)
        at = pa.array(np.concatenate([[0], np.cumsum(many[use])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(x[keep])) for x in (doc, meta)]
        yield pa.RecordBatch.from_arrays([pa.array(key[start[use]]), pa.array(np.full(int(use.sum()), part, np.int32)), *lists], ["list", "part", "docs", "metas"])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, part, docs, metas) of the signs that several documents have, from rows sorted by bucket, sign, meta and doc_id."""
    held: list[list[np.ndarray]] = []
    waiting = part = 0
    sign = np.int64(-1)
    for batch in batches:
        key = (batch.column("bucket").to_numpy().astype(np.int64) << 32) + (batch.column("sign").to_numpy().astype(np.int64) + (1 << 31))
        rows = [key, batch.column("doc_id").to_numpy(), batch.column("meta").to_numpy()]
        link = rows[2] < 0
        if link.any():
            first, other = -1 - rows[2][link], rows[1][link]
            twos = pa.array(np.arange(len(first) + 1, dtype=np.int32) * 2)
            lists = [pa.ListArray.from_arrays(twos, pa.array(x.ravel())) for x in (np.stack([first, other], 1), np.zeros((len(first), 2), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), -1, np.int64)), pa.array(np.zeros(len(first), np.int32)), *lists], ["list", "part", "docs", "metas"])
            key, *rows = (c[~link] for c in (key, *rows))
        at, end = 0, len(key)
        if waiting or part:
            # the list that the last batch ended in
            at = int(np.searchsorted(key, sign, "right"))
            held.append([c[:at] for c in rows])
            waiting += at
            if at < end:
                if waiting:
                    yield from _emit_lists(held, part)
                held, waiting, part = [], 0, 0
        if at < end:
            sign = key[-1]
            last = int(np.searchsorted(key, sign, "left"))
            if last > at:
                yield from _emit_lists([[c[at:last] for c in rows]], 0)
            held, waiting = [[c[last:] for c in rows]], end - last
        if waiting >= PART:
            yield from _emit_lists(held, part)
            held, waiting, part = [], 0, part + 1
    if waiting:
        yield from _emit_lists(held, part)


def _meetings(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(list, part, docs, metas) as a written table: who meets by which sign; meta holds the size and, in its lower half, how many signs the document has at least.

    Rows of list -1 link a document to one with the same set: docs = [first, other].
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = docs.mapInArrow(_emit_signatures(n, t, gram_weights(docs, n), buckets), "bucket int, many int, docs binary, metas binary, signs binary")
    rows = packed.repartitionById(buckets, "bucket").mapInArrow(_unpack_signatures, "bucket int, sign int, doc_id long, meta long")
    rows = rows.sortWithinPartitions("bucket", "sign", "meta", "doc_id")
    return written(rows.mapInArrow(_lists, "list long, part int, docs array<long>, metas array<long>"))


def _batch(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _labels_of(doc: np.ndarray, labels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    known, label = labels
    if not len(known):
        return doc
    at = np.minimum(np.searchsorted(known, doc), len(known) - 1)
    return np.where(known[at] == doc, label[at], doc)


def _with_labels(batches: Iterator[pa.RecordBatch], labels: tuple[np.ndarray, np.ndarray] | None):
    """(batch, row, doc, size, signs, label) of the members of the lists in a batch that have several labels."""
    for batch in batches:
        doc, bounds = _batch(batch, "docs")
        meta = _batch(batch, "metas")[0]
        label = _labels_of(doc, labels) if labels is not None else _batch(batch, "labels")[0]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        mixed = np.zeros(len(bounds) - 1, bool)
        mixed[row[label != label[bounds[:-1]][row]]] = True
        keep = mixed[row]
        yield batch, row[keep], doc[keep], meta[keep] >> 32, meta[keep] & 0xFFFFFFFF, label[keep]


def _stars(labels: tuple[np.ndarray, np.ndarray] | None, turn: int, t: float):
    """(doc_id, center, need) of each list's members and one of them that has another label: the least in the first turn, any in later ones."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, row, doc, size, need, label in _with_labels(batches, labels):
            chance = doc if not turn else tb.mix(doc.astype(np.uint64) ^ np.uint64(turn)).view(np.int64)
            order = np.lexsort((chance, row))
            row, doc, size, need, label = (c[order] for c in (row, doc, size, need, label))
            head = np.maximum.accumulate(np.where(np.diff(row, prepend=-1) != 0, np.arange(len(row)), 0))
            use = (label != label[head]) & (np.minimum(size, size[head]) >= np.ceil(t * np.maximum(size, size[head]) - 1e-9))
            x, y = doc[use], doc[head][use]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(np.ones(len(x), np.int64))], ["doc_id", "center", "need"])

    return stars


def _cross(labels: tuple[np.ndarray, np.ndarray] | None, t: float):
    """(doc_id, center, need) of all members of a list that have different labels and sizes that allow the similarity.

    Where a row has a second list (of the same sign), members of the one are held against those of the other.
    """

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, row, doc, size, need, label in _with_labels(batches, labels):
            side = np.zeros(len(row), np.int64)
            if "split" in batch.schema.names:
                # members up to the split are the first list's
                whole, bounds = _batch(batch, "docs")
                at = np.arange(len(whole)) - np.repeat(bounds[:-1], np.diff(bounds))
                number = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                side = (at >= batch.column("split").to_numpy()[number]).astype(np.int64)[np.isin(number, row)]
            order = np.lexsort((size, label, row))
            row, doc, size, need, label, side = (c[order] for c in (row, doc, size, need, label, side))
            n = len(row)
            over = np.searchsorted(row, row, "right")
            turns = np.ones(n, bool)
            turns[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
            run = np.cumsum(turns) - 1
            after = np.append(np.flatnonzero(turns), n)[run + 1] if n else run
            number = over - after
            done = np.concatenate([[0], np.cumsum(number)])
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
                # a member of a very long list alone may have more
                x = np.repeat(np.arange(a, b), number[a:b])
                y = after[x] + np.arange(len(x)) - (done[x] - done[a])
                use = np.minimum(size[x], size[y]) >= np.ceil(t * np.maximum(size[x], size[y]) - 1e-9)
                if "split" in batch.schema.names:
                    use &= side[x] != side[y]
                x, y = x[use], y[use]
                if len(x):
                    # of the first p words of two documents, p less those that they differ in are common
                    both = np.minimum(need[x], need[y]) - allowed(size[x], size[y], t)
                    both = np.maximum(both, np.minimum(_needs(size[x], t)[1], _needs(size[y], t)[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(doc[x], doc[y])), pa.array(np.minimum(doc[x], doc[y])), pa.array(both)], ["doc_id", "center", "need"])
                a = b

    return cross


def _emit_sets(n: int):
    """(doc_id, size, sketch, grams): the upper halves of the sorted hashes of each document's distinct n-grams, and the parity of those in each of as many places, to a power of two."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in tb.chunks(tb.string_array(batch.column("text"))):
                values, bounds = _gram_sets(texts, n)
                size = np.diff(bounds)
                bits = np.left_shift(1, np.ceil(np.log2(np.clip(size, *BITS))).astype(np.int64))
                first = np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)
                place = np.repeat(first[:-1], size) + (values & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64)
                sketch = np.packbits((np.bincount(place, minlength=first[-1]) & 1).astype(np.uint8)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                sketches = pa.ListArray.from_arrays(pa.array((first // 64).astype(np.int32)), pa.array(sketch))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(texts)), pa.array(size.astype(np.int32)), sketches, lists], ["doc_id", "size", "sketch", "grams"])

    return emit


def verified(sets: DataFrame, pairs: DataFrame, t: float) -> DataFrame:
    """(center, doc_id, jaccard) of the pairs (center, doc_id) of Jaccard >= t, on the whole n-gram sets.

    Pairs whose sketches differ in more bits than the sets may in n-grams are
    dropped before the sets travel: a bit differs only where an odd number of n-grams does.
    """
    own = sets.select("doc_id", F.col("size").alias("a"), F.col("sketch").alias("own"))
    other = sets.select(F.col("doc_id").alias("center"), F.col("size").alias("b"), F.col("sketch").alias("other"))

    def folded(x: str, y: str) -> Column:
        """x, of at most twice the length of y, with its halves laid over each other where it is longer."""
        n = F.size(y)
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(x))

    differ = F.aggregate(F.zip_with(folded("own", "other"), folded("other", "own"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = F.floor(F.lit((1 - t) / (1 + t)) * (F.col("a") + F.col("b")) + 1e-9)
    near = durable(pairs.select("doc_id", "center").join(own, "doc_id").join(other, "center").where(differ <= most).select("doc_id", "center"))
    own, other = sets.select("doc_id", F.col("grams").alias("own")), sets.select(F.col("doc_id").alias("center"), F.col("grams").alias("other"))
    shared = F.size(F.array_intersect("own", "other"))
    both = near.join(own, "doc_id").join(other, "center").withColumn("shared", shared)
    jaccard = F.col("shared") / F.greatest(F.lit(1), F.size("own") + F.size("other") - F.col("shared"))
    return both.select("center", "doc_id", jaccard.alias("jaccard")).where(F.col("jaccard") >= t)


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _sets_of(docs: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(doc_id, size, sketch, grams) of the documents of the pairs; one row a doc_id."""
    wanted = durable(pairs.select("doc_id").union(pairs.select(F.col("center").alias("doc_id"))).distinct())
    sets = docs.join(_small(wanted), "doc_id", "left_semi").mapInArrow(_emit_sets(n), "doc_id long, size int, sketch array<long>, grams array<int>")
    # repeated rows of a doc_id have the same text
    return written(sets).groupBy("doc_id").agg(*(F.first(c).alias(c) for c in ("size", "sketch", "grams")))


def _labelled(meetings: DataFrame, labels: DataFrame, kernel, t: float, turn: int | None = None) -> DataFrame:
    """Pairs (doc_id, center, need) that a kernel makes of the lists and the labels (id, component) of their members."""
    made = "doc_id long, center long, need long"
    args = (t,) if turn is None else (turn, t)
    if labels.limit(LABELS + 1).count() <= LABELS:
        found = labels.toPandas().sort_values("id")
        held = (found["id"].to_numpy(np.int64), found["component"].to_numpy(np.int64))
        return meetings.mapInArrow(kernel(held, *args), made)
    order = [x for x in meetings.columns if x not in ("docs", "metas")]
    flat = meetings.select(*order, F.posexplode(F.arrays_zip("docs", "metas")).alias("at", "m")).select(*order, "at", F.col("m.docs").alias("id"), F.col("m.metas").alias("meta"))
    named = flat.join(labels, "id", "left").select(*order, F.struct("at", "id", "meta", F.coalesce("component", "id").alias("label")).alias("m"))
    again = named.groupBy(*order).agg(F.sort_array(F.collect_list("m")).alias("m"))
    return again.select(*order, F.col("m.id").alias("docs"), F.col("m.meta").alias("metas"), F.col("m.label").alias("labels")).mapInArrow(kernel(None, *args), made)


def near_duplicate_edges(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """Verified edges (center, doc_id, jaccard) whose connected components are those of all pairs of Jaccard >= t.

    A pair of Jaccard >= t that isn't among them is one whose ends they connect.

    Rows with a null doc_id are left out; null and empty texts, and texts
    without a word, resemble nothing. doc_id is taken to be unique; repeated rows
    of one doc_id count as that document. An empty table has no edges.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    meetings = _meetings(docs, n, t)
    links = meetings.where("list = -1").select(F.col("docs")[0].alias("center"), F.col("docs")[1].alias("doc_id"), F.lit(1.0).alias("jaccard"))
    edges = written(links.where("center <> doc_id"))
    lists = meetings.where("list >= 0")
    for turn in range(ROUNDS):
        labels = connected_components(edges, "doc_id", "center")
        looked = lists.where(F.pmod(F.xxhash64("list"), F.lit(LOOK)) == turn)
        met = _labelled(looked, labels, _stars, t, turn).groupBy("doc_id", "center").agg(F.count("*").alias("signs")).where("signs > 1")
        best = met.groupBy("doc_id").agg(F.max(F.struct("signs", -F.col("center"))).alias("best"))
        pairs = durable(best.select("doc_id", (-F.col("best")["col2"]).alias("center")))
        if pairs.isEmpty():
            break
        edges = written(edges.union(verified(_sets_of(docs, pairs, n), pairs, t)))
    labels = connected_components(edges, "doc_id", "center")
    # at most one in PART signatures is a long list's last: the other lists don't travel to find theirs
    long = durable(lists.where("part > 0").select("list").distinct())
    split = lists.join(_small(long), "list", "left_semi")
    ahead = split.select("list", F.col("part").alias("next"), F.col("docs").alias("d"), F.col("metas").alias("m"))
    across = split.join(ahead, "list").where("part < next").select(
        "list", "part", "next", F.size("docs").alias("split"), F.concat("docs", "d").alias("docs"), F.concat("metas", "m").alias("metas")
    )
    met = _labelled(lists, labels, _cross, t).union(_labelled(across, labels, _cross, t))
    agreed = met.groupBy("doc_id", "center").agg(F.count("*").alias("signs"), F.min("need").alias("need")).where("signs >= need")
    pairs = durable(agreed.select("doc_id", "center"))
    return edges.union(verified(_sets_of(docs, pairs, n), pairs, t))


def near_duplicate_groups(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """(doc_id, group_id) of the documents in groups of two or more; group_id is the least doc_id."""
    edges = near_duplicate_edges(docs, n, t)
    return connected_components(edges, "doc_id", "center").select(F.col("id").alias("doc_id"), F.col("component").alias("group_id"))


def keep_one(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """The documents without those whose group has a smaller doc_id; all columns as they were.

    Rows with a null doc_id stay.
    """
    lost = durable(near_duplicate_groups(docs, n, t).where("doc_id <> group_id").select("doc_id"))
    return docs.join(_small(lost), "doc_id", "left_anti").select(docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group of near-duplicate documents, with the sorted list of its doc_ids; groups of more than LISTED documents take several rows (parts)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = durable(near_duplicate_groups(docs))
    large = groups.groupBy("group_id").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > LISTED)
    parts = F.coalesce(F.ceil(F.col("n_docs") / LISTED), F.lit(1)).cast("long")
    dealt = groups.join(large, "group_id", "left").select("group_id", (F.col("doc_id") % parts).cast("int").alias("part"), "doc_id")
    return dealt.groupBy("group_id", "part").agg(
        F.count("*").alias("n_docs"), F.sort_array(F.collect_list("doc_id")).alias("doc_ids")
    ).select("group_id", "part", "n_docs", "doc_ids")


QUERIES = {"op6_jaccard_join": op6_jaccard_join}

ORACLE_SQL = {
    "op6_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(ws) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE shared / (na.size + nb.size - shared) >= {T}),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS reach FROM u UNION SELECT u.b, r.reach FROM r JOIN u ON u.a = r.doc_id),
c AS (SELECT doc_id, min(reach) AS group_id FROM r GROUP BY doc_id),
m AS (SELECT group_id, ceil(count(*) / {LISTED})::BIGINT AS parts FROM c GROUP BY group_id)
SELECT group_id, (doc_id % parts)::INT AS part, count(*) AS n_docs, list(doc_id ORDER BY doc_id) AS doc_ids FROM c JOIN m USING (group_id) GROUP BY 1, 2
"""
}
