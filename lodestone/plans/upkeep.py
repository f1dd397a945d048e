"""Queries of the stores, the caches and the incremental operators, over the events, the parts and the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import incremental as N
from lodestone.operators import stores as K
from lodestone.plans.code import U, units
from lodestone.plans.code_search import INDEX, _index, keyed
from lodestone.plans.edges import EXTRACT, _extracted, _q
from lodestone.plans.registry import register

#: Records: every event is a put under its type and user.
PUTS = "pt AS (SELECT event_type || ':' || user_id AS key, props AS value, ts AS updated_at, event_id FROM events)"
#: The store after all puts.
KV = f"{PUTS}, kv AS (SELECT key, arg_max(value, (updated_at, value)) AS value, min(updated_at) AS created_at, max(updated_at) AS updated_at FROM pt GROUP BY key)"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _puts(spark, sf_dir):
    return _events(spark, sf_dir).select(F.concat_ws(":", "event_type", "user_id").alias("key"), F.col("props").alias("value"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id")


def _store(spark, sf_dir):
    return K.upserted(spark.createDataFrame([], K.SCHEMA), _puts(spark, sf_dir))


def _seconds(c):
    return F.round(F.col(c).cast("double"), 3).alias(c)


@register("st14_upserts", f"WITH {KV} SELECT key, value, round(epoch(created_at), 3)::DOUBLE AS created_at, round(epoch(updated_at), 3)::DOUBLE AS updated_at FROM kv")
def st14(spark, sf_dir):
    """Rows 1, 14 and 18."""
    return _store(spark, sf_dir).select("key", "value", _seconds("created_at"), _seconds("updated_at"))


def _keys(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("click:"), "c_custkey").alias("key"))


@register("st17_batch_get", f"WITH {KV} SELECT key, value FROM kv WHERE key IN (SELECT 'click:' || c_custkey FROM customer)")
def st17(spark, sf_dir):
    """Rows 2, 15 and 17."""
    return K.got(_store(spark, sf_dir), _keys(spark, sf_dir))


@register("st36_batch_get_missing", f"WITH {KV} SELECT 'click:' || c_custkey AS key, (SELECT value FROM kv WHERE key = 'click:' || c_custkey) AS value FROM customer")
def st36(spark, sf_dir):
    """Rows 8 and 36."""
    return K.got(_store(spark, sf_dir), _keys(spark, sf_dir), missing=True)


@register("st33_delete", f"WITH {KV} SELECT key FROM kv WHERE key NOT IN (SELECT 'click:' || c_custkey FROM customer)")
def st33(spark, sf_dir):
    """Rows 4, 15 and 33."""
    return K.deleted(_store(spark, sf_dir), _keys(spark, sf_dir)).select("key")


@register("st06_prefix_listing", f"WITH {KV} SELECT key FROM kv WHERE starts_with(key, 'purchase:1')")
def st06(spark, sf_dir):
    """Rows 6 and 16."""
    return K.listed(_store(spark, sf_dir), "purchase:1")


@register("st20_key_pattern", "SELECT p_type || ' ' || p_partkey AS key FROM part WHERE p_type || ' ' || p_partkey ILIKE '%S%_7%'")
def st20(spark, sf_dir):
    return K.like(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", "p_type", "p_partkey").alias("key")), "%S%_7%")


@register("st21_date_range", "SELECT event_id::VARCHAR AS key FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00'")
def st21(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("created_at"))
    return K.between(e, "2024-01-05 00:00:00", "2024-01-06 12:00:00").select("key")


@register("st19_statistics", f"WITH {KV} SELECT regexp_extract(key, '^([^:]*):', 1) AS kind, count(*) AS records, sum(strlen(value))::BIGINT AS bytes, round(epoch(min(created_at)), 3)::DOUBLE AS first, round(epoch(max(created_at)), 3)::DOUBLE AS last FROM kv GROUP BY 1")
def st19(spark, sf_dir):
    """Rows 10 and 19."""
    return K.stats(_store(spark, sf_dir)).select("kind", "records", "bytes", _seconds("first"), _seconds("last"))


@register("st34_exists", f"WITH {KV} SELECT (SELECT count(*) > 0 FROM kv WHERE key = (SELECT min(key) FROM kv)) AS first, (SELECT count(*) > 0 FROM kv WHERE key = 'nothing') AS nothing")
def st34(spark, sf_dir):
    """Rows 5 and 34."""
    table = _store(spark, sf_dir)
    return spark.createDataFrame([(K.exists(table, table.agg(F.min("key")).first()[0]), K.exists(table, "nothing"))], "first boolean, nothing boolean")


_NOW, _TTL = "2024-01-31 00:00:00", 5 * 86400


@register("st26_expired", f"WITH {KV} SELECT count(*) FILTER (updated_at < TIMESTAMP '{_NOW}' - INTERVAL {_TTL} SECOND) AS expired FROM kv")
def st26(spark, sf_dir):
    return K.expired_count(_store(spark, sf_dir), _NOW, _TTL)


@register("st25_live_entries", f"WITH {KV} SELECT key FROM kv WHERE updated_at >= TIMESTAMP '{_NOW}' - INTERVAL {_TTL} SECOND")
def st25(spark, sf_dir):
    return K.live(_store(spark, sf_dir), _NOW, _TTL).select("key")


def _accesses(spark, sf_dir):
    return _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"))


@register("st25_lru_content", "SELECT user_id AS key FROM (SELECT user_id, max((ts, event_id)) AS l FROM events GROUP BY 1) ORDER BY l DESC LIMIT 50")
def st25l(spark, sf_dir):
    """What a least-recently-used cache of 50 holds in the end (rows 25, 27 and 28)."""
    return K.cached(_accesses(spark, sf_dir), 50)


@register("st30_hottest_keys", "SELECT user_id AS key, count(*) AS times FROM events GROUP BY 1 ORDER BY times DESC, key LIMIT 100")
def st30(spark, sf_dir):
    return K.hottest(_accesses(spark, sf_dir), 100)


@register("ag15_hit_rate", "SELECT count(*) - count(DISTINCT user_id) AS hits, count(DISTINCT user_id) AS misses, round((count(*) - count(DISTINCT user_id)) / count(*), 6)::DOUBLE AS rate FROM events")
def ag15(spark, sf_dir):
    """Rows 14 and 15."""
    return K.hit_rate(_accesses(spark, sf_dir))


@register("st29_cache_keys", "SELECT event_id, 'events:' || user_id || ':' || event_type AS readable, md5(user_id || '|' || event_type || '|' || props) AS digest FROM events")
def st29(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", K.cache_key("events", F.col("user_id"), F.col("event_type")).alias("readable"), K.digest_key(F.col("user_id"), F.col("event_type"), F.col("props")).alias("digest"))


@register("st24_encryption", "SELECT event_id, props FROM events")
def st24(spark, sf_dir):
    """What comes back of values that were encrypted."""
    key = "0123456789abcdef"
    e = _events(spark, sf_dir).select("event_id", K.encrypted(F.col("props"), key).alias("sealed"))
    return e.select("event_id", K.decrypted(F.col("sealed"), key).alias("props"))


@register("ex12_safe_names", "SELECT p_partkey, translate(p_type || ':' || p_brand, ':/\\ ', '____') AS name FROM part")
def ex12(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", K.file_safe(F.concat_ws(":", "p_type", "p_brand")).alias("name"))


# --- incremental ---

#: Snapshots of the code corpus: units whose key ends in 7 are new, in 3 are gone, in 1 are changed.
OLD = "o AS (SELECT id AS path, sha256(content) AS h, content FROM u WHERE k % 10 <> 7)"
NEW = "nw AS (SELECT id AS path, sha256(CASE WHEN k % 10 = 1 THEN content || 'def added_' || k || '(' || chr(10) || 'class New_' || k || '(A):' || chr(10) ELSE content END) AS h, CASE WHEN k % 10 = 1 THEN content || 'def added_' || k || '(' || chr(10) || 'class New_' || k || '(A):' || chr(10) ELSE content END AS content FROM u WHERE k % 10 <> 3)"


def _snapshots(spark, sf_dir):
    u = units(spark, sf_dir).select(F.col("id").alias("path"), "k", "content")
    more = F.concat("content", F.lit("def added_"), "k", F.lit("(\nclass New_"), "k", F.lit("(A):\n"))
    old = u.where("k % 10 <> 7").select("path", "content")
    new = u.where("k % 10 <> 3").select("path", F.when(F.col("k") % 10 == 1, more).otherwise(F.col("content")).alias("content"))
    return tuple(x.withColumn("content_hash", F.sha2("content", 256)) for x in (old, new))


@register("in01_snapshot_diff", f"WITH {U}, {OLD}, {NEW} SELECT path, CASE WHEN o.h IS NULL THEN 'added' WHEN nw.h IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM o FULL JOIN nw USING (path) WHERE o.h IS DISTINCT FROM nw.h")
def in01(spark, sf_dir):
    """Rows 1 and 2."""
    return N.changes(*_snapshots(spark, sf_dir))


@register("in03_content_changes", f"WITH {U}, {OLD}, {NEW} SELECT path, CASE WHEN k % 10 = 1 THEN 'added_' || k ELSE '' END AS functions, CASE WHEN k % 10 = 1 THEN 'New_' || k ELSE '' END AS classes, CASE WHEN k % 10 = 1 THEN 2 ELSE 0 END AS lines_added, 0 AS lines_removed FROM o JOIN nw USING (path) JOIN u ON u.id = path")
def in03(spark, sf_dir):
    """Lines, functions and classes that changed (rows 3, 16 and 18)."""
    old, new = _snapshots(spark, sf_dir)
    pairs = old.select("path", F.col("content").alias("old")).join(new.select("path", F.col("content").alias("new")), "path")
    names = N.name_changes(pairs).select("path", F.array_join("functions_added", ",").alias("functions"), F.array_join("classes_added", ",").alias("classes"))
    return names.join(N.line_changes(pairs).select("path", "lines_added", "lines_removed"), "path")


_IMPORTS = "list_distinct(list_concat(list_concat(regexp_extract_all({c}, 'import\\s+(.+)', 1), regexp_extract_all({c}, 'from\\s+(.+)\\s+import', 1)), list_concat(regexp_extract_all({c}, 'import\\s+.+\\s+from\\s+(.+)', 1), regexp_extract_all({c}, 'require\\s*\\(\\s*[''\\x22](.+)[''\\x22]', 1))))"


@register("in04_import_changes", f"WITH {U} SELECT id AS path, array_to_string(list_sort(list_filter({_IMPORTS.format(c='n')}, lambda x: NOT list_contains({_IMPORTS.format(c='content')}, x))), ',') AS added FROM (SELECT *, replace(content, 'import run_', 'import ran_') AS n FROM u)")
def in04(spark, sf_dir):
    """Rows 4 and 19."""
    u = units(spark, sf_dir)
    pairs = u.select(F.col("id").alias("path"), F.col("content").alias("old"), F.replace("content", F.lit("import run_"), F.lit("import ran_")).alias("new"))
    return N.name_changes(pairs).select("path", F.array_join("imports_added", ",").alias("added"))


@register("in05_given_paths", f"WITH {U}, {OLD}, {NEW} SELECT path, CASE WHEN o.h IS NULL THEN 'added' ELSE 'modified' END AS change FROM nw LEFT JOIN o USING (path) WHERE o.h IS DISTINCT FROM nw.h")
def in05(spark, sf_dir):
    """Rows 5 and 6."""
    return N.changed_of(*_snapshots(spark, sf_dir))[0]


@register("in06_registry", f"WITH {U}, {OLD}, {NEW} SELECT path, coalesce(nw.h, o.h) AS content_hash FROM o FULL JOIN nw USING (path)")
def in06(spark, sf_dir):
    return N.changed_of(*_snapshots(spark, sf_dir))[1]


@register("in07_hash_history", "SELECT event_id, md5(event_type) <> lag(md5(event_type)) OVER w OR lag(event_type) OVER w IS NULL AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, md5(event_type))")
def in07(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("user_id").alias("path"), "ts", F.md5("event_type").alias("content_hash"), "event_id")
    h = N.history(e)
    # ts is unique by user in this table
    return e.join(h, ["path", "ts", "content_hash"]).select("event_id", "changed")


@register("in08_updated_index", f"WITH {U}, {INDEX} SELECT \"index\", count(*) AS postings FROM (SELECT \"index\", key, unit_id FROM ix JOIN u ON u.id = unit_id WHERE NOT contains(file_path, 'views') UNION SELECT \"index\", key, unit_id FROM ix JOIN u ON u.id = unit_id WHERE contains(file_path, 'views') AND k % 2 = 0) GROUP BY 1")
def in08(spark, sf_dir):
    """Index upkeep after the files of a folder changed, losing every second unit (rows 8, 10, 11 and 20)."""
    u = keyed(spark, sf_dir)
    changed = u.where("contains(file_path, 'views')").select(F.col("file_path").alias("path")).distinct()
    fresh = u.where("contains(file_path, 'views') AND k % 2 = 0")
    return N.updated_index(_index(spark, sf_dir), u, changed, fresh).groupBy("index").agg(F.count("*").alias("postings"))


@register("in09_updated_graph", _q(*EXTRACT) + "SELECT relation_type, count(*) AS edges FROM (SELECT DISTINCT x.src, x.dst, relation_type FROM x JOIN u a ON a.id = x.src JOIN u b ON b.id = x.dst WHERE (NOT contains(a.file_path, 'views') OR a.k % 2 = 0) AND (NOT contains(b.file_path, 'views') OR b.k % 2 = 0)) GROUP BY 1")
def in09(spark, sf_dir):
    u = units(spark, sf_dir)
    still = u.where("NOT contains(file_path, 'views') OR k % 2 = 0").select("id")
    edges = _extracted(spark, sf_dir).select("src", "dst", "relation_type").join(u.select(F.col("id").alias("src")), "src", "left_semi").join(u.select(F.col("id").alias("dst")), "dst", "left_semi")
    changed = u.where("contains(file_path, 'views')").select(F.col("file_path").alias("path")).distinct()
    return N.updated_graph(edges.select("src", "dst", "relation_type"), u, changed, edges.select("src", "dst", "relation_type"), still).groupBy("relation_type").agg(F.count("*").alias("edges"))


@register("in12_updated_units", f"WITH {U} SELECT id FROM u WHERE NOT contains(file_path, 'views') OR k % 2 = 0")
def in12(spark, sf_dir):
    """Rows 10, 12, 13 and 21."""
    u = units(spark, sf_dir)
    changed = u.where("contains(file_path, 'views')").select(F.col("file_path").alias("path")).distinct()
    return N.updated_units(u, changed, u.where("contains(file_path, 'views') AND k % 2 = 0")).select("id")


@register("in17_update_statistics", "SELECT count(*) AS updates, round(avg(n + m + d), 6)::DOUBLE AS avg_files, max(day)::VARCHAR AS last FROM (SELECT date_trunc('day', ts)::DATE AS day, count(*) FILTER (event_type = 'view') AS n, count(*) FILTER (event_type = 'click') AS m, count(*) FILTER (event_type = 'error') AS d FROM events GROUP BY 1)")
def in17(spark, sf_dir):
    """A log of updates, made of the events of each day (row 17, and 16 of the metrics)."""
    of = lambda kind: F.count(F.when(F.col("event_type") == kind, 1))
    log = _events(spark, sf_dir).groupBy(F.to_date("ts").alias("ts")).agg(of("view").alias("added"), of("click").alias("modified"), of("error").alias("deleted"))
    return N.update_statistics(log).withColumn("last", F.col("last").cast("string"))


@register("ev01_last_events", "SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM events) WHERE place <= 100")
def ev01(spark, sf_dir):
    return N.last_events(_events(spark, sf_dir), 100).select("event_type", "event_id", "place")
