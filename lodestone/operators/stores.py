"""Key-value storage as tables: records (key, value, created_at, updated_at) in versioned Parquet folders, and caches as expiry over a table.

A store's state is the folder of its current version; a write makes the next one
and then switches the pointer, so readers see whole versions, a failed write
leaves the old one, and a rollback is a switch back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "key string, value string, created_at timestamp, updated_at timestamp"


def upserted(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with rows (key, value, updated_at) put in: the latest of each key counts, of equally late ones the greater value; created_at is the first there was."""
    fresh = rows.select("key", "value", F.col("updated_at").alias("created_at"), "updated_at")
    latest = F.max(F.struct("updated_at", "value"))
    return table.select("key", "value", "created_at", "updated_at").union(fresh).groupBy("key").agg(F.min("created_at").alias("created_at"), latest.alias("l")).select("key", "l.value", "created_at", "l.updated_at")


def got(table: DataFrame, keys: DataFrame, missing: bool = False) -> DataFrame:
    """(key, value) of the keys that there are; with ``missing`` all of them, absent ones null."""
    wanted = keys.select("key").distinct()
    return wanted.join(table.select("key", "value"), "key", "left" if missing else "inner")


def deleted(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("key"), "key", "left_anti").select(table.columns)


def exists(table: DataFrame, key: str) -> bool:
    return not table.where(F.col("key") == key).limit(1).isEmpty()


def listed(table: DataFrame, prefix: str = "") -> DataFrame:
    """(key) that begin with a prefix, in order."""
    return table.where(F.col("key").startswith(prefix)).select("key").orderBy("key")


def like(table: DataFrame, pattern: str) -> DataFrame:
    """(key) that a LIKE pattern matches in any case, in order."""
    return table.where(F.col("key").ilike(pattern)).select("key").orderBy("key")


def between(table: DataFrame, first: str, last: str, column: str = "created_at") -> DataFrame:
    """Rows of a span of time, both ends in it, in order."""
    return table.where(F.col(column).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))).orderBy(column, "key")


def kind_of(key: Column) -> Column:
    """What a key's prefix says that it holds."""
    return F.when(key.contains(":"), F.regexp_extract(key, r"^([^:]*):", 1)).otherwise("data")


def stats(table: DataFrame) -> DataFrame:
    """(kind, records, bytes, first, last) by kind of key."""
    return table.groupBy(kind_of(F.col("key")).alias("kind")).agg(
        F.count("*").alias("records"), F.sum(F.octet_length("value")).cast("long").alias("bytes"), F.min("created_at").alias("first"), F.max("created_at").alias("last")
    )


def live(table: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """Rows that haven't expired at an instant."""
    return table.where(F.col("updated_at") >= F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(ttl_seconds))))


def expired_count(table: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """(expired): how many rows a purge drops."""
    at = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    return table.agg(F.count(F.when(F.col("updated_at") < at, 1)).alias("expired"))


def cached(accesses: DataFrame, capacity: int) -> DataFrame:
    """(key): what a cache of so many keys holds after accesses (key, ts, seq): the most lately used."""
    return accesses.groupBy("key").agg(F.max(F.struct("ts", "seq")).alias("last")).orderBy(F.desc("last")).limit(capacity).select("key")


def hottest(accesses: DataFrame, k: int) -> DataFrame:
    """(key, times): the keys to warm a cache with, most often used first."""
    return accesses.groupBy("key").agg(F.count("*").alias("times")).orderBy(F.desc("times"), "key").limit(k)


def hit_rate(accesses: DataFrame) -> DataFrame:
    """(hits, misses, rate): accesses of keys seen before, over all."""
    first = F.row_number().over(Window.partitionBy("key").orderBy("ts", "seq"))
    n = accesses.withColumn("n", first).agg(F.count(F.when(F.col("n") > 1, 1)).alias("hits"), F.count(F.when(F.col("n") == 1, 1)).alias("misses"))
    return n.withColumn("rate", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), 6))


def cache_key(prefix: str, *parts: Column) -> Column:
    """prefix:a:b..., for readable keys."""
    return F.concat_ws(":", F.lit(prefix), *[p.cast("string") for p in parts])


def digest_key(*parts: Column) -> Column:
    """One md5 over the parts, for keys of any length."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def file_safe(key: Column) -> Column:
    return F.translate(key, ":/\\ ", "____")


class TableStore:
    """A store in a folder: versions of a Parquet table and a pointer to the current one. codec: snappy, gzip, zstd or none."""

    def __init__(self, spark: SparkSession, folder: str, codec: str = "zstd"):
        self.spark, self.folder, self.codec = spark, folder.rstrip("/"), codec
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        """Whole versions that there are, in order."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._path(f"{n}/_SUCCESS")))

    def version(self) -> int:
        """The current version, 0 for a new store."""
        marks = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        current = [int(n.split("-")[1]) for n in marks if n.startswith("current-")]
        return max(current, default=0)

    def _switch(self, version: int) -> None:
        for s in self._fs.listStatus(self._path("")):
            if s.getPath().getName().startswith("current-") and int(s.getPath().getName().split("-")[1]) > version:
                self._fs.delete(s.getPath(), False)
        self._fs.create(self._path(f"current-{version}"), True).close()

    def read(self) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v{v}")

    def _write(self, table: DataFrame) -> None:
        v = max([*self.versions(), self.version()], default=0) + 1
        table.write.mode("overwrite").option("compression", self.codec).parquet(f"{self.folder}/v{v}")
        self._switch(v)

    def put(self, rows: DataFrame) -> None:
        """Puts rows (key, value, updated_at), all or none."""
        self._write(upserted(self.read(), rows))

    def get(self, keys: DataFrame, missing: bool = False) -> DataFrame:
        return got(self.read(), keys, missing)

    def delete(self, keys: DataFrame) -> None:
        self._write(deleted(self.read(), keys))

    def clear(self) -> None:
        self._write(self.read().limit(0))

    def rollback(self) -> bool:
        """Back to the version before; False where there is none."""
        before = [v for v in self.versions() if v < self.version()]
        if not before:
            return False
        self._switch(before[-1])
        return True

    def compact(self, files: int = 1) -> None:
        """The current table in so many files, sorted by key."""
        self._write(self.read().repartitionByRange(files, "key").sortWithinPartitions("key"))

    def vacuum(self) -> int:
        """Deletes versions other than the current; how many."""
        old = [v for v in self.versions() if v != self.version()]
        for v in old:
            self._fs.delete(self._path(f"v{v}"), True)
        return len(old)

    def backup(self, folder: str) -> None:
        """The current table, written to another folder."""
        self.read().write.mode("overwrite").option("compression", self.codec).parquet(folder)

    def restore(self, folder: str) -> None:
        self._write(self.spark.read.schema(SCHEMA).parquet(folder))


def encrypted(value: Column, key: str) -> Column:
    """A value under AES-GCM with a 16, 24 or 32 byte key, as base64."""
    return F.base64(F.aes_encrypt(value, F.lit(key)))


def decrypted(value: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(key)).cast("string")
