"""The three inverted indices of units, kept as one table of postings, and as a store on disk that searches read little of.

Postings are rows (index, key, unit_id): index is 'term', 'symbol' or 'file'.
A store holds term postings with frequencies, in files by a hash of the term and
sorted within them, and a table of document frequencies: a query reads the
folders of its terms and, by the files' statistics, few of their row groups.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators.durable import ensure_checkpoint_dir, written


def index_term(word: Column) -> Column:
    return T.stem(T.plain(word))


def three_indices(units: DataFrame) -> DataFrame:
    """Distinct postings of units (id, file_path, name, symbol_type, parameters, keywords, content).

    Keywords are normalised whole and content word by word; symbols go under their
    normalised name and parameters and their type as it is.
    """
    u = units.select(F.col("id").alias("unit_id"), "*")
    words = F.transform(T.words(F.coalesce("content", F.lit(""))), lambda w: T.stem(w))
    terms = F.concat(F.filter(F.transform("keywords", lambda w: index_term(w)), lambda w: ~w.isin(T.STOP_WORDS) & (w != "")), F.filter(words, lambda w: T.is_term(w)))
    symbols = F.array_compact(F.concat(F.array(index_term(F.col("name")), F.col("symbol_type")), F.transform("parameters", lambda p: index_term(p))))
    parts = [
        u.select(F.lit(kind).alias("index"), F.explode(F.array_distinct(keys)).alias("key"), "unit_id")
        for kind, keys in (("term", terms), ("symbol", F.when(F.col("name").isNotNull(), symbols).otherwise(F.array().cast("array<string>"))), ("file", F.array("file_path")))
    ]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def updated(index: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """Postings without those of the units gone (unit_id) and with those of new units; keys without a unit are no rows."""
    return index.join(gone.select("unit_id").distinct(), "unit_id", "left_anti").select("index", "key", "unit_id").union(fresh.select("index", "key", "unit_id")).distinct()


def scored(index: DataFrame, terms: list[str], k: int) -> DataFrame:
    """(unit_id, score): a term that a unit has adds ln(V / (df + 1)), a symbol twice that of its own index; repeated terms add again."""
    some = index.where(F.col("index").isin("term", "symbol"))
    sizes = some.groupBy("index").agg(F.countDistinct("key").alias("v"))
    hit = some.where(F.col("key").isin(terms))
    df = hit.groupBy("index", "key").agg(F.count("*").alias("df"))
    times = F.lit(0)
    for t in dict.fromkeys(terms):
        times = F.when(F.col("key") == t, terms.count(t)).otherwise(times)
    gain = F.when(F.col("index") == "symbol", 2.0).otherwise(1.0) * F.ln(F.col("v") / (F.col("df") + 1)) * times
    # two rows of sizes, and at most two a query term
    rate = df.join(F.broadcast(sizes), "index").select("index", "key", gain.alias("gain"))
    hits = hit.join(F.broadcast(rate), ["index", "key"]).groupBy("unit_id").agg(F.round(F.sum("gain"), 6).alias("score"))
    return hits.orderBy(F.desc("score"), "unit_id").limit(k)


def exact(index: DataFrame, query: str) -> DataFrame:
    """(unit_id): units under the whole query as a symbol or a term."""
    key = query.lower()
    return index.where(F.col("index").isin("term", "symbol") & (F.col("key") == key)).select("unit_id").distinct()


def routed(index: DataFrame, query: str, k: int) -> DataFrame:
    """(unit_id, score): what a query asks for by its prefix, find: for exact, search: or none for text search."""
    if query.startswith("find:"):
        return exact(index, query[5:].strip()).select("unit_id", F.lit(1).cast("long").alias("score")).orderBy("unit_id").limit(k)
    terms = [t for t in T.query_terms(query.removeprefix("search:"), stemmed=False)]
    hits = index.where((F.col("index") == "term") & F.col("key").isin(terms)).groupBy("unit_id").agg(F.count("*").alias("score"))
    return hits.orderBy(F.desc("score"), "unit_id").limit(k)


def filter_ids(index: DataFrame, filters: dict[str, str], union: bool = False) -> DataFrame:
    """(unit_id) of the units that all filters, or any of them, let through: file on the path, symbol_type on the symbol's type."""
    out = None
    for name, value in filters.items():
        kind, test = ("file", F.contains("key", F.lit(value))) if name == "file" else ("symbol", F.col("key") == value)
        ids = index.where((F.col("index") == kind) & test).select("unit_id").distinct()
        out = ids if out is None else (out.union(ids).distinct() if union else out.join(ids, "unit_id", "left_semi"))
    return out if out is not None else index.select("unit_id").distinct()


def substrings(index: DataFrame, kind: str, query: str) -> DataFrame:
    """(unit_id) under keys of a kind that hold the query, in any case."""
    return index.where((F.col("index") == kind) & F.contains(F.lower("key"), F.lit(query.lower()))).select("unit_id").distinct()


BUCKETS = 64


class IndexStore:
    """Term postings on disk: (term, unit_id, tf) by bucket, and (term, df)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._size: int | None = None

    @classmethod
    def build(cls, units: DataFrame, unit_id: str, content: str, folder: str | None = None) -> "IndexStore":
        """Writes the index of units: one shuffle by term, one sort within each file."""
        spark = units.sparkSession
        folder = folder or f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        word = units.select(F.col(unit_id).alias("unit_id"), F.explode(T.words(F.col(content))).alias("w")).select("unit_id", T.stem(F.col("w")).alias("term")).where(T.is_term(F.col("term")))
        counted = word.groupBy("term", "unit_id").agg(F.count("*").cast("int").alias("tf"))
        bucketed = counted.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        bucketed.repartition("bucket", "term").sortWithinPartitions("bucket", "term", "unit_id").write.partitionBy("bucket").parquet(f"{folder}/postings")
        store = cls(spark, folder)
        store.postings().groupBy("term").agg(F.count("*").alias("df")).sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        store.size()
        return store

    def postings(self) -> DataFrame:
        """(term, unit_id, tf, bucket)."""
        return self.spark.read.schema("term string, unit_id long, tf int, bucket int").parquet(f"{self.folder}/postings")

    def terms(self) -> DataFrame:
        return self.spark.read.schema("term string, df long").parquet(f"{self.folder}/terms")

    def size(self) -> int:
        """How many terms there are, from the files' footers, once."""
        if self._size is None:
            self._size = self.terms().count()
        return self._size

    def of(self, terms: list[str]) -> DataFrame:
        """Postings of some terms: only their buckets are read."""
        known = list(dict.fromkeys(terms))
        row = self.spark.createDataFrame([(t,) for t in known], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int").alias("b")).collect()
        return self.postings().where(F.col("bucket").isin([r["b"] for r in row]) & F.col("term").isin(known)).select("term", "unit_id", "tf")

    def search(self, terms: list[str], k: int) -> DataFrame:
        """(unit_id, score) by ln(V / (df + 1)) a term; repeated terms add again."""
        return self._scored(self.of(terms), self.terms().where(F.col("term").isin(list(dict.fromkeys(terms)))), terms, k)

    def _scored(self, hit: DataFrame, known: DataFrame, terms: list[str], k: int) -> DataFrame:
        v, times = self.size(), F.lit(0)
        for t in dict.fromkeys(terms):
            times = F.when(F.col("term") == t, terms.count(t)).otherwise(times)
        rate = known.select("term", (F.ln(F.lit(float(v)) / (F.col("df") + 1)) * times).alias("gain"))
        hits = hit.join(F.broadcast(rate), "term").groupBy("unit_id").agg(F.round(F.sum("gain"), 6).alias("score"))  # a row a query term
        return hits.orderBy(F.desc("score"), "unit_id").limit(k)

    def near(self, terms: list[str], most: int, k: int) -> DataFrame:
        """(query, term, df, distance): the k terms nearest to each query term, itself excluded, in one pass over the table of terms."""
        return self._nearest(self.terms(), terms, most, k).select("query", "term", "df", "distance")

    def _nearest(self, known: DataFrame, terms: list[str], most: int, k: int) -> DataFrame:
        words = self.spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "query int, said string")
        found = known.join(F.broadcast(words), F.abs(F.length("term") - F.length("said")) <= most)  # as many rows as the query has terms
        found = found.withColumn("distance", F.levenshtein("term", "said", most)).where("distance > 0")
        first = F.row_number().over(Window.partitionBy("query").orderBy("distance", "term"))
        return found.withColumn("r", first).where(F.col("r") <= k)

    def _close(self, terms: list[str], most: int, near: int) -> DataFrame:
        return self.near(terms, most, near)

    def matching(self, pattern: str) -> DataFrame:
        """Postings of the terms that a pattern is found in."""
        return self.postings().join(self.terms().where(F.col("term").rlike(pattern)).select("term"), "term", "left_semi")

    def starting(self, prefix: str) -> DataFrame:
        """(term, df) of the terms that start so."""
        return self.terms().where(F.col("term").startswith(prefix))

    def fuzzy(self, terms: list[str], k: int, most: int = 2, near: int = 10) -> DataFrame:
        """(unit_id, score): how many of the query terms' neighbours a unit has, a neighbour of two counting twice."""
        close = self._close(terms, most, near).groupBy("term").agg(F.count("*").alias("times")).collect()  # at most ``near`` a query term
        if not close:
            return self.postings().select("unit_id", F.lit(0).cast("long").alias("score")).limit(0)
        times = F.lit(0)
        for r in close:
            times = F.when(F.col("term") == r["term"], r["times"]).otherwise(times)
        hits = self.of([r["term"] for r in close]).groupBy("unit_id").agg(F.sum(times).cast("long").alias("score"))
        return hits.orderBy(F.desc("score"), "unit_id").limit(k)


class IndexScan(IndexStore):
    """The searches of a store without one: each reads the units, and only postings that it asks for are shuffled.

    A store costs a shuffle of all postings, which pays where many searches follow.
    """

    def __init__(self, units: DataFrame, unit_id: str, content: str):
        super().__init__(units.sparkSession, "")
        self._units = units.select(F.col(unit_id).cast("long").alias("unit_id"), F.lower(content).alias("text"))
        self._words = units.select(F.col(unit_id).cast("long").alias("unit_id"), F.explode(T.words(F.col(content))).alias("w")).select(T.stem(F.col("w")).alias("term"), "unit_id").where(T.is_term(F.col("term")))

    def _grouped(self, words: DataFrame) -> DataFrame:
        return words.groupBy("term", "unit_id").agg(F.count("*").cast("int").alias("tf"))

    def postings(self) -> DataFrame:
        return self._grouped(self._words)

    def matching(self, pattern: str) -> DataFrame:
        return self._grouped(self._words.where(F.col("term").rlike(pattern)))

    def starting(self, prefix: str) -> DataFrame:
        return self._grouped(self._words.where(F.col("term").startswith(prefix))).groupBy("term").agg(F.count("*").alias("df"))

    def terms(self) -> DataFrame:
        return self.postings().groupBy("term").agg(F.count("*").alias("df"))

    def size(self) -> int:
        if self._size is None:
            self._size = self._words.select("term").distinct().count()
        return self._size

    def of(self, terms: list[str]) -> DataFrame:
        known = list(dict.fromkeys(terms))
        if not known:
            return self._grouped(self._words.where(F.lit(False)))
        # a stem begins its word: only words that begin with a term are taken out of the text
        words = rf"(?<!{T.WORD[:-1]})(?:{'|'.join(re.escape(t) for t in known)}){T.WORD[:-1]}*"
        said = self._units.select("unit_id", F.explode(F.regexp_extract_all("text", F.lit(words), F.lit(0))).alias("w")).select(T.stem(F.col("w")).alias("term"), "unit_id")
        return self._grouped(said.where(T.is_term(F.col("term")) & F.col("term").isin(known)))

    def search(self, terms: list[str], k: int) -> DataFrame:
        hit = written(self.of(terms))  # read twice
        rate = hit.groupBy("term").agg(F.count("*").alias("df"))
        return self._scored(hit, rate, terms, k)

    def near(self, terms: list[str], most: int, k: int) -> DataFrame:
        # the vocabulary first, how often a term occurs only of those found
        found = self._nearest(self._words.select("term").distinct(), terms, most, k).select("query", "term", "distance").collect()  # k rows a query term
        rows = self.spark.createDataFrame([tuple(r) for r in found], "query int, term string, distance int")
        df = self.of([r["term"] for r in found]).groupBy("term").agg(F.count("*").alias("df")) if found else self.spark.createDataFrame([], "term string, df long")
        return rows.join(df, "term").select("query", "term", "df", "distance")

    def _close(self, terms: list[str], most: int, near: int) -> DataFrame:
        return self._nearest(self._words.select("term").distinct(), terms, most, near)
