"""Line dedup by a segment-partition edit join.

Two lines within ``tau`` edits of each other: cut the shorter into tau + 1
segments, and at least one of them occurs unchanged in the other, at a place
that the lengths and the segment's number confine to a few. Lines are indexed by
their segments (with length and number) and probe with those substrings of
theirs; lines that meet in a slot are candidates and are verified by a
bit-parallel edit distance over a band of 2 tau + 1 diagonals.

Of equal lines the first, by (doc_id, line number), stays. A line goes
altogether where a line that occurs earlier lies within tau edits. Lines are told
apart by a 64-bit hash of their characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.llm import textbytes as tb
from lodestone.operators.durable import durable

#: Edits between lines that count as the same, and characters from which a line may differ at all.
TAU, MIN_CHARS = 2, 20
#: Pairs of lines put out at once.
PAIRS = 1 << 18
#: Rows of a side up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 2_000_000


class Lines:
    """Lines of some texts as runs of code points."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.end = np.flatnonzero(self.points == 10)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else self.end
        self.length = self.end - self.start
        per_text = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
        self.row = np.repeat(np.arange(len(texts)), per_text)
        self.number = np.arange(len(self.row)) - first[self.row]
        up, self.down = tb._Powers.upto(len(self.points) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.points.astype(np.uint64) + np.uint64(1)) * up[: len(self.points)])])
        self.hash = self.of(self.start, self.length)

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of the substrings."""
        return tb.mix((self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))

    def visible(self) -> np.ndarray:
        """Lines with a character above the space."""
        seen = np.concatenate([[0], np.cumsum(self.points > 32)])
        return seen[self.end] > seen[self.start]


def segment(length: np.ndarray, i: int, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of tau + 1 in lines of the given lengths; the last ones are longer by one where it doesn't divide."""
    small, extra = length // (tau + 1), length % (tau + 1)
    long_before = np.maximum(0, i - (tau + 1 - extra))
    return i * small + long_before, small + (i >= tau + 1 - extra)


def slots(lines: Lines, tau: int, min_chars: int, seen: set[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, line hash, probes) of the lines: tau + 1 index slots each, and those that they probe. Lines whose hash is in seen are left out, the others are added to it."""
    pick = np.flatnonzero((lines.length >= min_chars) & lines.visible())
    if len(pick):
        pick = pick[np.unique(lines.hash[pick], return_index=True)[1]]
    if seen is not None:
        hashes = lines.hash[pick].tolist()
        fresh = np.fromiter((x not in seen for x in hashes), bool, len(hashes))
        seen.update(hashes)
        pick = pick[fresh]
    start, length, h = lines.start[pick], lines.length[pick], lines.hash[pick]
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def slot(at: np.ndarray, size: np.ndarray, i: int, indexed: np.ndarray) -> np.ndarray:
        return tb.mix(lines.of(at, size) ^ tb.mix(indexed.astype(np.uint64) * np.uint64(64) + np.uint64(i)))

    for i in range(tau + 1):
        p, n = segment(length, i, tau)
        out.append((slot(start + p, n, i, length), h, False))
        for delta in range(tau + 1):
            shorter = length - delta
            p, n = segment(shorter, i, tau)
            low = np.maximum.reduce([np.zeros_like(p), p - i, p + delta - (tau - i)])
            high = np.minimum.reduce([length - n, p + i, p + delta + (tau - i)])
            for step in range(2 * tau + 1):
                ok = (low + step <= high) & (shorter >= min_chars)
                if ok.any():
                    out.append((slot(start[ok] + low[ok] + step, n[ok], i, shorter[ok]), h[ok], True))
    return (
        np.concatenate([x for x, _, _ in out]),
        np.concatenate([x for _, x, _ in out]),
        np.concatenate([np.full(len(x), probe) for x, _, probe in out]),
    )


def _chunked(batch: pa.RecordBatch) -> Iterator[tuple[int, Lines]]:
    for i, texts in tb.chunks(tb.string_array(batch.column("text"))):
        yield i, Lines(texts.to_pylist())


def _emit_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, lines in _chunked(batch):
            use = np.flatnonzero(lines.visible())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines.hash[use].view(np.int64)), pa.array(ids[i + lines.row[use]]), pa.array(lines.number[use].astype(np.int32))], ["line", "doc_id", "number"]
            )


def _emit_slots(tau: int, min_chars: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task says of every line once where it belongs, however often it occurs
        for batch in batches:
            for _, lines in _chunked(batch):
                slot, line, probes = slots(lines, tau, min_chars, seen)
                yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64)), pa.array(line.view(np.int64)), pa.array(probes)], ["slot", "line", "probes"])

    return emit


def _emit_texts(min_chars: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in tb.chunks(tb.string_array(batch.column("text"))):
                values = texts.to_pylist()
                lines = Lines(values)
                use = np.flatnonzero((lines.length >= min_chars) & lines.visible())
                _, first = np.unique(lines.hash[use], return_index=True)
                use = use[np.sort(first)]
                split = [line for text in values for line in text.split("\n")]
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash[use].view(np.int64)), pa.array([split[k] for k in use.tolist()], pa.string())], ["line", "text"])

    return emit


def banded_distance(a: list[str], b: list[str], tau: int) -> np.ndarray:
    """Edit distances of pairs of strings, tau + 1 where they are larger than tau.

    Bit-parallel over the 2 tau + 1 diagonals around the main one, all pairs at
    once: bit k of a column stands for the row that lies k - tau below the
    column's number.
    """
    n = np.fromiter(map(len, a), np.int64, len(a))
    m = np.fromiter(map(len, b), np.int64, len(b))
    out = np.full(len(a), tau + 1, np.int64)
    out[m == 0] = np.minimum(n[m == 0], tau + 1)
    fits = np.flatnonzero((np.abs(n - m) <= tau) & (m > 0))
    for part in _alike(fits, m):
        out[part] = _banded([a[k] for k in part], [b[k] for k in part], n[part], m[part], tau)
    return out


def _alike(rows: np.ndarray, length: np.ndarray, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Rows in groups of like length, so that padding stays small."""
    rows = rows[np.argsort(length[rows], kind="stable")]
    i = 0
    while i < len(rows):
        j = int(np.searchsorted(length[rows], length[rows[i]] * 1.1 + 8, "right"))
        j = min(j, i + max(1, most // int(length[rows[i]] * 1.1 + 16)))
        yield rows[i:j]
        i = j


def _points(strings: list[str], length: np.ndarray, before: int, width: int, pad: int) -> np.ndarray:
    table = np.full((len(strings), width), pad, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(strings)), length)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    table[row, before + at] = flat
    return np.ascontiguousarray(table.T)


def _banded(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, tau: int) -> np.ndarray:
    band = 2 * tau + 1
    width = int(max(n.max(), m.max()))
    # a is padded by tau on the left, so that row j - tau + k of column j is a[j + k] here
    pa_ = _points(a, n, tau, width + 2 * band, -1)
    pb = _points(b, m, 0, width, -2)
    many, full = len(a), np.uint64((1 << band) - 1)
    one = np.uint64(1)
    # column 0 grows by one from row 0 down; rows above it are flat, so that they cost a gap each
    plus = np.full(many, (1 << band) - (1 << tau), np.uint64)
    minus = np.zeros(many, np.uint64)
    score = np.zeros(many, np.int64)
    top = np.uint64(1 << tau)
    for j in range(int(m.max())):
        eq = np.zeros(many, np.uint64)
        for k in range(band):
            eq |= (pa_[j + k] == pb[j]).astype(np.uint64) << np.uint64(k)
        # plus and minus hold the vertical differences of column j, shifted to the rows of column j + 1
        d0 = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        score = np.where(j < m, score + ((d0 & top) == 0), score)
        hp = (minus | ~(d0 | plus)) & full
        hn = d0 & plus
        shifted = d0 >> one
        plus = (hn | ~(shifted | hp)) & full
        minus = shifted & hp
        if j + 1 < int(m.min()):
            continue
        done = m == j + 1
        if done.any():
            # from the cell on the main diagonal down or up to row n of the last column
            d = score[done]
            p, q = plus[done], minus[done]
            gap = (n - m)[done]
            for step in range(1, tau + 1):
                bit = np.uint64(1 << (tau + step - 1))
                d = np.where(gap >= step, d + ((p & bit) != 0) - ((q & bit) != 0), d)
                bit = np.uint64(1 << (tau - step))
                d = np.where(gap <= -step, d - ((p & bit) != 0) + ((q & bit) != 0), d)
            score[done] = d
    return np.minimum(score, tau + 1)


def _verify(tau: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = banded_distance(batch.column("text").to_pylist(), batch.column("other_text").to_pylist(), tau) <= tau
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(x).filter(keep) for x in ("line", "other")], ["line", "other"])

    return verify


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _pairs_of(slot: np.ndarray, line: np.ndarray, probes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(line, other) of the indexed and the probing lines of each slot, from rows sorted by slot, probes and line."""
    fresh = np.ones(len(slot), bool)
    fresh[1:] = (slot[1:] != slot[:-1]) | (line[1:] != line[:-1]) | (probes[1:] != probes[:-1])
    slot, line, probes = slot[fresh], line[fresh], probes[fresh]
    start = np.flatnonzero(np.concatenate([np.ones(1, bool), slot[1:] != slot[:-1]]))
    many = np.diff(np.append(start, len(slot)))
    indexed = np.add.reduceat(~probes, start, dtype=np.int64) if len(start) else start
    use = (indexed > 0) & (indexed < many)
    if not use.any():
        return
    # each probing line with all indexed ones of its slot
    keep = np.repeat(use, many) & probes
    number = np.repeat(indexed, many)[keep]
    first = np.repeat(start, many)[keep]
    own = line[keep]
    done = np.concatenate([[0], np.cumsum(number)])
    a = 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(done, done[a] + PAIRS, "right")) - 1)
        which = np.repeat(np.arange(a, b), number[a:b])
        other = line[first[which] + np.arange(len(which)) - (done[which] - done[a])]
        x, y = own[which], other
        two = x != y
        pair = np.unique(np.stack([np.minimum(x, y)[two], np.maximum(x, y)[two]], 1), axis=0)
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["line", "other"])
        a = b


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the lines that meet in a slot; a slot's lines are held, never its pairs."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column("slot").to_numpy(), batch.column("line").to_numpy(), batch.column("probes").to_numpy(zero_copy_only=False)]
        # the last slot may go on in the next batch
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        if last or (held and held[-1][0][-1] != rows[0][-1]):
            yield from _pairs_of(*(np.concatenate(x) for x in zip(*held, [c[:last] for c in rows])))
            held = []
        held.append([c[last:] for c in rows])
    if held:
        yield from _pairs_of(*(np.concatenate(x) for x in zip(*held)))


def similar_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (line, other), line < other, of hashes of different lines within tau edits."""
    slot_rows = docs.mapInArrow(_emit_slots(tau, min_chars), "slot long, line long, probes boolean")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = slot_rows.repartition(parts, "slot").sortWithinPartitions("slot", "probes", "line")
    pairs = met.mapInArrow(_meet, "line long, other long").distinct()
    pairs = durable(pairs)
    wanted = durable(pairs.select("line").union(pairs.select("other")).distinct())
    texts = docs.mapInArrow(_emit_texts(min_chars), "line long, text string").join(_small(wanted), "line", "left_semi")
    texts = durable(texts.dropDuplicates(["line"]))
    both = pairs.join(texts, "line").join(texts.select(F.col("line").alias("other"), F.col("text").alias("other_text")), "other")
    return both.select("line", "other", "text", "other_text").mapInArrow(_verify(tau), "line long, other long")


def dropped_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, numbers): the numbers, from 0, of the lines that go from each document."""
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    lines = docs.mapInArrow(_emit_lines, "line long, doc_id long, number int")
    firsts = lines.groupBy("line").agg(F.min(F.struct("doc_id", "number")).alias("first"))
    near = durable(similar_lines(docs, tau, min_chars))
    ends = near.select("line").union(near.select("other")).distinct()
    places = durable(firsts.join(_small(durable(ends)), "line", "left_semi"))
    known = near.join(places, "line").join(places.select(F.col("line").alias("other"), F.col("first").alias("other_first")), "other")
    later = known.select(F.when(F.col("first") < F.col("other_first"), F.col("other_first")).otherwise(F.col("first")).alias("at")).distinct()
    again = lines.withColumn("first", F.min(F.struct("doc_id", "number")).over(Window.partitionBy("line"))).where(
        F.struct("doc_id", "number") > F.col("first")
    )
    gone = again.select("doc_id", "number").union(later.select("at.doc_id", "at.number"))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("number")).alias("numbers"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, kept, n_lines, n_dropped) from (doc, numbers)."""
    for whole in batches:
        texts = whole.column(0).field("text")
        for i, some in tb.chunks(tb.string_array(texts)):
            batch = whole.slice(i, len(some))
            kept, totals = [], []
            numbers = batch.column(1).to_pylist()
            for text, gone in zip(texts.slice(i, len(some)).to_pylist(), numbers):
                if text is None:
                    kept.append(None)
                    totals.append(0)
                    continue
                if not gone:
                    kept.append(text)
                    totals.append(text.count("\n") + 1)
                    continue
                lines, drop = text.split("\n"), set(gone)
                totals.append(len(lines))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(totals, pa.int32()), pa.array([len(g or ()) for g in numbers], pa.int32())], ["doc", "kept", "n_lines", "n_dropped"]
            )


def deduplicated(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, kept, n_lines, n_dropped): every row of ``docs`` as the struct doc, its text without its repeated lines, and the counts.

    Blank lines are never dropped. Lines of fewer than ``min_chars`` characters go
    only if an equal line occurs earlier. doc_id is taken to be unique; of repeated
    rows of a doc_id all lose the same lines. Rows with a null doc_id or text stay as
    they are and make no other line go. An empty table gives an empty result. Other
    columns are carried along in doc, whatever their names. Texts of any length are read whole.
    """
    gone = durable(dropped_lines(docs, tau, min_chars)).select(F.col("doc_id").alias("id"), "numbers")
    side = F.broadcast(gone) if (gone.agg(F.sum(F.size("numbers"))).first()[0] or 0) <= BROADCAST_ROWS else gone
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    joined = rows.join(side, F.col("doc.doc_id") == F.col("id"), "left").select("doc", "numbers")
    made = [StructField("kept", StringType()), StructField("n_lines", IntegerType()), StructField("n_dropped", IntegerType())]
    return joined.mapInArrow(_rebuild, StructType([rows.schema["doc"], *made]))


def drop_repeated_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines, n_chars (where there is such a column) brought up to date.

    A document of which no visible character is left, though it had some, goes.
    """
    out = deduplicated(docs, tau, min_chars).where(r"n_dropped = 0 or kept rlike '[^\\s]'")
    columns = []
    for name, kind in docs.dtypes:
        value = F.col(f"doc.`{name}`")
        if name == "text":
            value = F.col("kept")
        elif name == "n_chars":
            value = F.when(F.col("n_dropped") > 0, F.length("kept")).otherwise(value).cast(kind)
        columns.append(value.alias(name))
    return out.select(columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text after line dedup, and how many of its lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc.doc_id", "n_lines", "n_dropped", F.col("kept").alias("text"))


QUERIES = {"op4_line_dedup": op4_line_dedup}

ORACLE_SQL = {
    "op4_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents),
f AS (SELECT line, min(struct_pack(d := doc_id, n := number)) AS first FROM l WHERE regexp_matches(line, '[^\\x00-\\x20]') GROUP BY line),
near AS (
  SELECT DISTINCT b.line FROM f a JOIN f b
  ON a.first < b.first AND abs(length(a.line) - length(b.line)) <= {TAU} AND length(a.line) >= {MIN_CHARS} AND length(b.line) >= {MIN_CHARS}
  AND levenshtein(a.line, b.line) <= {TAU}),
kept AS (
  SELECT l.doc_id, l.number, l.line, f.line IS NULL OR (near.line IS NULL AND f.first = struct_pack(d := l.doc_id, n := l.number)) AS stays
  FROM l LEFT JOIN f ON f.line = l.line LEFT JOIN near ON near.line = l.line)
SELECT doc_id, count(*)::INT AS n_lines, (count(*) FILTER (NOT stays))::INT AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY number) FILTER (stays), '') AS text
FROM kept GROUP BY doc_id
"""
}
