"""WARC captures and their external index merge.

Every input split is sorted by (URL key, timestamp, page) where it is, by Spark's
sort, which spills, and written as a run: a file in the shared folder. Keys of a
sample cut the whole order into ranges; each range is a task that opens all runs,
reads of each only the row groups that its range touches, a batch at a time, and
merges them by a loser tree: the winner goes out, its successor climbs from its
leaf, one comparison a level. Nothing is shuffled, and a task holds a batch a run.
Ranges may cut through the captures of one URL; what a range needs to know of
those before it is one row, which is worked out in between.

``write_warc`` and ``read_warc`` store pages as WARC/1.1 records, gzipped one by one.
"""

from __future__ import annotations

import gzip
import io
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.durable import durable, ensure_checkpoint_dir

#: Pages carry no capture time; the crawl clock ticks so many seconds a page_id from this instant on.
CLOCK_START, CLOCK_STEP = 1_704_067_200, 37
#: Runs that a task merges at once, entries of a run that it holds, and keys sampled for each range.
FAN_IN, BATCH, SAMPLED = 512, 4096, 60
#: Compressed bytes taken at once, and the bytes that a record's headers may take.
FEED, HEAD = 1 << 16, 1 << 16


def url_key(url: Column) -> Column:
    """Sort-friendly key: host parts reversed, then path and sorted query in lower case.

    Scheme, user, port, a leading www., the fragment, a trailing slash and utm_
    parameters don't count. A null URL has the key ")".
    """
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://([^/?#]*@)?([^/?#:]*)", 2), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/$", "")
    query = F.regexp_extract(low, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    joined = F.array_join(kept, "&")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def captures(pages: DataFrame) -> DataFrame:
    """Index entries (url_key, ts, page_id, url, digest, length) of pages.

    A page with a null page_id is left out; null html is an empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    return pages.where("page_id is not null").select(
        url_key(F.col("url")).alias("url_key"),
        F.date_format(F.timestamp_seconds(F.lit(CLOCK_START) + F.col("page_id") * CLOCK_STEP), "yyyyMMddHHmmss").alias("ts"),
        "page_id",
        "url",
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).alias("length"),
    )


class LoserTree:
    """Merges sorted runs by the first part of their items; ties go to the run with the lesser number. Runs may be iterators and are read one item ahead."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.k = max(1, len(self.runs))
        self.tree = [-1] * self.k
        for leaf in range(len(self.runs) - 1, -1, -1):
            self._climb(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes out before run b. An ended run goes last."""
        x, y = self.head[a], self.head[b]
        if x is None:
            return False
        return y is None or (x[0], a) < (y[0], b)

    def _climb(self, winner: int) -> None:
        node = (winner + self.k) >> 1
        while node:
            other = self.tree[node]
            if other < 0:  # while the tree is built, the first to come waits for its rival
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node >>= 1
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        """(run, item) in order."""
        while self.runs:
            w = self.tree[0]
            if self.head[w] is None:
                return
            yield w, self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._climb(w)


Key = tuple[str, str, int]


def _run(path: str, low: Key | None, high: Key | None) -> Iterator[tuple[Key, tuple]]:
    """(key, (url, digest, length)) of a run's entries from low on, before high, a batch at a time."""
    files, name = pa.fs.FileSystem.from_uri(path)
    with files.open_input_file(name) as source:
        run = pq.ParquetFile(source)
        groups = []
        for g in range(run.num_row_groups):
            column = run.metadata.row_group(g).column(0)
            seen = column.statistics if column.path_in_schema == "url_key" else None
            if seen is not None and seen.has_min_max and ((high is not None and seen.min > high[0]) or (low is not None and seen.max < low[0])):
                continue
            groups.append(g)
        for batch in run.iter_batches(BATCH, groups, ["url_key", "ts", "page_id", "url", "digest", "length"]):
            columns = [batch.column(i).to_pylist() for i in range(6)]
            if (low is not None and (columns[0][-1], columns[1][-1], columns[2][-1]) < low) or (high is not None and (columns[0][0], columns[1][0], columns[2][0]) >= high):
                continue
            for key, ts, page, *rest in zip(*columns):
                at = (key, ts, page)
                if (low is None or at >= low) and (high is None or at < high):
                    yield at, tuple(rest)


MERGED = "url_key string, ts string, page_id long, url string, digest string, length int, capture long, previous_ts string, changed boolean, range int, at long"


def _merge(paths: list[str], bounds: list[Key]):
    """Merges the runs within each range, and adds each capture's place in its URL's history, as far as the range tells."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in MERGED.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for here in [int(r) for batch in batches for r in batch.column(0).to_pylist()]:
            low, high = bounds[here - 1] if here else None, bounds[here] if here < len(bounds) else None
            out: list[tuple] = []
            number, last, at = 0, None, 0
            for _, ((key, ts, page), (url, digest, length)) in LoserTree(_run(p, low, high) for p in paths):
                same = last is not None and last[0] == key
                number = number + 1 if same else 1
                out.append((key, ts, page, url, digest, length, number, last[1] if same else None, not same or last[2] != digest, here, at))
                last, at = (key, ts, digest), at + 1
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return merge


def _bounds(runs: DataFrame, ranges: int) -> list[Key]:
    """Keys that cut the runs' entries into about equal ranges, from a sample of about SAMPLED a range."""
    many = runs.count()
    share = min(1.0, SAMPLED * ranges / max(1, many))
    keys = sorted(tuple(r) for r in runs.select("url_key", "ts", "page_id").sample(share, seed=1).collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def merged_index(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """The globally ordered capture index.

    (position, url_key, ts, page_id, url, digest, length, capture, previous_ts,
    changed): position counts from 1 over the whole index, capture within the
    URL key; changed tells whether the digest differs from the capture before.
    Captures of the same key and time are ordered by page_id; repeated rows stay.
    Pages with a null page_id are left out; null URLs and html count as empty.
    Payloads of any length are only hashed. An empty table gives an empty index.
    Other columns, whatever their names, don't matter.
    """
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    # no more runs than a task can keep open; a run of several splits is sorted whole
    captures(pages).coalesce(FAN_IN).sortWithinPartitions("url_key", "ts", "page_id").write.option("maxRecordsPerFile", 0).parquet(folder)
    runs = spark.read.schema("url_key string, ts string, page_id long, url string, digest string, length int").parquet(folder)
    paths = sorted(runs.inputFiles())
    bounds = _bounds(runs, ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = spark.range(0, len(bounds) + 1, 1, len(bounds) + 1)
    merged = durable(tasks.mapInArrow(_merge(paths, bounds), MERGED))
    ends = merged.groupBy("range").agg(
        F.count("*").alias("n"), F.min_by("url_key", "at").alias("first"), F.max_by(F.struct("url_key", "ts", "digest", "capture"), "at").alias("last")
    )
    carried, total, before = [], 0, (None, 0, None, None)
    for r in ends.orderBy("range").collect():  # a row a range
        key, ts, digest, capture = r["last"]
        more = before[1] if before[0] == r["first"] else 0
        carried.append((r["range"], total, before[0] if more else None, more, before[2], before[3]))
        total += r["n"]
        before = (key, capture + (more if key == r["first"] else 0), ts, digest)
    table = spark.createDataFrame(carried, "range int, offset long, carried_key string, more long, carried_ts string, carried_digest string")
    joined = merged.join(F.broadcast(table), "range")  # a row a range
    goes_on = F.col("url_key") == F.coalesce("carried_key", F.lit("\x00"))
    first = goes_on & (F.col("at") == 0)
    return joined.select(
        (F.col("offset") + F.col("at") + 1).alias("position"), "url_key", "ts", "page_id", "url", "digest", "length", (F.col("capture") + F.when(goes_on, F.col("more")).otherwise(0)).alias("capture"),
        F.when(first, F.col("carried_ts")).otherwise(F.col("previous_ts")).alias("previous_ts"), F.when(first, F.col("digest") != F.col("carried_digest")).otherwise(F.col("changed")).alias("changed"),
    )


def _record(url: str, ts: str, page_id: int, payload: bytes) -> bytes:
    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:14]}Z"
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{page_id}>\r\nWARC-Target-URI: {url}\r\n"
        f"WARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + payload + b"\r\n\r\n", mtime=0)


def write_warc(pages: DataFrame, folder: str) -> None:
    """Writes pages as .warc.gz files in a folder that all executors share, one a partition.

    A file gets its name when it is whole, so that a repeated task replaces it.
    Null page_ids are left out; null URLs and html are written as empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        task = TaskContext.get()
        name = os.path.join(folder, f"part-{task.partitionId():06d}.warc.gz")
        part, n = f"{name}.{task.taskAttemptId()}", 0
        with open(part, "wb") as out:
            for batch in batches:
                for row in batch.to_pylist():
                    out.write(_record(row["url"] or "", row["ts"], row["page_id"], (row["html"] or "").encode()))
                    n += 1
        os.replace(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows = pages.where("page_id is not null").select(
        "page_id", "url", "html", F.date_format(F.timestamp_seconds(F.lit(CLOCK_START) + F.col("page_id") * CLOCK_STEP), "yyyyMMddHHmmss").alias("ts")
    )
    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def _members(data: bytes) -> Iterator[bytes]:
    """The contents of a file's gzip members, one by one; of a file that isn't gzipped, the file."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, out = zlib.decompressobj(31), []
        while not member.eof and at < len(data):
            out.append(member.decompress(view[at : at + FEED]))
            at += min(FEED, len(data) - at)
        at -= len(member.unused_data)
        yield b"".join(out)
        if view[at : at + 2] != b"\x1f\x8b":
            return  # padding behind the last member


def _records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payloads of the records of a WARC file; several may share a gzip member."""
    for body in _members(data):
        at = 0
        while True:
            while body[at : at + 1] in (b"\r", b"\n"):
                at += 1
            if at >= len(body):
                break
            stream = io.BytesIO(body[at : at + HEAD])
            if not stream.readline().startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            start = at + stream.tell()
            at = start + int(headers.get("content-length") or 0)
            yield headers, body[start:at]


def _content(headers: dict[str, str], payload: bytes) -> str:
    """The text of a record, without the HTTP head of a response, in the charset that it names or else UTF-8; bytes that don't fit are replaced."""
    kind = headers.get("content-type", "")
    if headers.get("warc-type", "").lower() == "response":
        head, _, payload = payload.partition(b"\r\n\r\n")
        kind = next((x.partition(b":")[2].decode("latin-1") for x in head.split(b"\r\n") if x.lower().startswith(b"content-type:")), "")
    charset = kind.lower().partition("charset=")[2].partition(";")[0].strip(" \"'") or "utf-8"
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(record_id, page_id, url, ts, html) of the response and resource records in .warc and .warc.gz files; one task reads whole files.

    page_id is null but in records that ``write_warc`` wrote; headers that a
    record lacks are null. Records of other types are passed over.
    """
    names = ["record_id", "page_id", "url", "ts", "html"]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for h, p in _records(content.as_py()):
                    if h.get("warc-type", "").lower() not in ("response", "resource"):
                        continue
                    record = h.get("warc-record-id", "").strip("<>")
                    own = record.removeprefix("urn:page:")
                    page_id = int(own) if own != record and own.lstrip("-").isdigit() else None
                    ts = "".join(c for c in h.get("warc-date", "").partition(".")[0] if c.isdigit())
                    rows.append((record or None, page_id, h.get("warc-target-uri"), ts or None, _content(h, p)))
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("content")
    return files.mapInArrow(parse, "record_id string, page_id long, url string, ts string, html string")


def op5_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged capture index of all pages."""
    return merged_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op5_capture_index": op5_capture_index}

ORACLE_SQL = {
    "op5_capture_index": rf"""
WITH a AS (SELECT page_id, url, lower(coalesce(url, '')) AS low, coalesce(html, '') AS html FROM pages WHERE page_id IS NOT NULL),
b AS (SELECT *, regexp_replace(regexp_extract(low, '^[a-z][a-z0-9+.-]*://([^/?#]*@)?([^/?#:]*)', 2), '^www\.', '') AS host,
  regexp_replace(regexp_extract(low, '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/$', '') AS path,
  array_to_string(list_sort(list_filter(string_split(regexp_extract(low, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query FROM a),
c AS (SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key,
  strftime(make_timestamp(({CLOCK_START} + page_id * {CLOCK_STEP}) * 1000000), '%Y%m%d%H%M%S') AS ts, page_id, url, sha1(html) AS digest, strlen(html)::INT AS length FROM b)
SELECT row_number() OVER o AS position, url_key, ts, page_id, url, digest, length,
  row_number() OVER u AS capture, lag(ts) OVER u AS previous_ts, coalesce(digest <> lag(digest) OVER u, true) AS changed
FROM c WINDOW o AS (ORDER BY url_key, ts, page_id), u AS (PARTITION BY url_key ORDER BY ts, page_id)
"""
}
