"""Queries of the unit scalars and the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import embed as M
from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.operators import analysis as A
from lodestone.operators import units as N
from lodestone.operators.blocks import tasks
from lodestone.plans.code import U, units
from lodestone.plans.registry import register


def _part(spark, sf_dir):
    # a small file is one task's, but its tokens are many
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return p.repartition(tasks(p), "id")


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


TOKENS = f"""w AS (SELECT p_partkey AS id, unnest({T.words_sql('p_name')}) AS w FROM part),
t AS (SELECT id, unnest(CASE WHEN length(w) > 6 THEN list_concat([w], flatten(list_transform(generate_series(3, least(6, length(w) - 1)), lambda n: list_transform(generate_series(1, length(w) - n + 1), lambda i: substr(w, i, n))))) ELSE [w] END) AS token FROM w)"""
IDF = f"(1 + ln(least(2.0, length(token) / 3) / (1 + greatest(-0.99, (length(regexp_replace(token, '[^{M.COMMON}]', '', 'g')) - length(regexp_replace(token, '[^{M.RARE}]', '', 'g'))) / length(token)))))::DOUBLE"


def _at(k: int) -> str:
    digest = ("md5", "sha1", "sha256")[k] + f"(token || '_{k}')"
    parts = (4, 5, 8)[k]
    return f"list_reduce([{', '.join(f'''('0x' || substr({digest}, {8 * i + 1}, 8))::BIGINT''' for i in range(parts))}], lambda a, x: (a * 256 + x) % 384, 0::BIGINT)::INT"


WEIGHTS = f"{TOKENS}, c AS (SELECT id, token, count(*) AS times, sum(count(*)) OVER (PARTITION BY id) AS n FROM t GROUP BY id, token), wt AS (SELECT id, token, times / n * {IDF} AS weight FROM c)"
VECTORS = f"{WEIGHTS}, pl AS (SELECT id, {_at(0)} AS slot, weight FROM wt UNION ALL SELECT id, {_at(1)}, -weight FROM wt UNION ALL SELECT id, {_at(2)}, weight FROM wt), v AS (SELECT id, slot, sum(weight) AS w FROM pl GROUP BY id, slot)"


@register("pr14_tokens", f"WITH {TOKENS} SELECT id, token, count(*) AS times FROM t GROUP BY ALL")
def pr14(spark, sf_dir):
    """Tokens with their character n-grams (rows 14 and 15)."""
    return _part(spark, sf_dir).select("id", F.explode(M.tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("times"))


@register("pr16_token_weights", f"WITH {WEIGHTS} SELECT id AS unit, token, round(weight, 6) AS weight FROM wt")
def pr16(spark, sf_dir):
    """Rows 16 to 18."""
    return M.weights(_part(spark, sf_dir), "id", "text").select("unit", "token", F.round("weight", 6).alias("weight"))


@register("pr19_hash_places", f"WITH {TOKENS} SELECT DISTINCT token, {_at(0)} AS a, {_at(1)} AS b, {_at(2)} AS c FROM t")
def pr19(spark, sf_dir):
    t = _part(spark, sf_dir).select(F.explode(M.tokens(F.col("text"))).alias("token")).distinct()
    return t.select("token", *[M.place(F.col("token"), k).alias("abc"[k]) for k in range(3)])


@register("pr20_embeddings", f"WITH {VECTORS} SELECT id AS unit, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS value FROM v WHERE w <> 0")
def pr20(spark, sf_dir):
    """Embeddings by their places that aren't zero (rows 20 and 21)."""
    e = M.embed(_part(spark, sf_dir), "id", "text")
    return e.select("unit", F.posexplode("embedding").alias("slot", "value")).where("value <> 0").select("unit", "slot", F.round("value", 6).alias("value"))


_LOW = "lower(text)"


def _has(signs) -> str:
    return "CASE WHEN " + " OR ".join(f"contains({_LOW}, '{s}')" for s in signs) + " THEN 1.0 ELSE 0.0 END::DOUBLE"


def _sum(words) -> str:
    return "(" + " + ".join(f"(length({_LOW}) - length(replace({_LOW}, '{w}', ''))) / {len(w)}" for w in words) + ")"


_SPACED = r"greatest(1, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')))"
FEATURES = ", ".join(
    [f"{_has(s)} AS {n}" for n, s in M._SIGNS.items()]
    + [f"round(least(1.0, {_sum(M._COMPLEX)} / 10), 6)::DOUBLE AS complexity", rf"round(least(1.0, len(regexp_extract_all(text, '\b[a-zA-Z_][a-zA-Z0-9_]*\b')) / {_SPACED}), 6)::DOUBLE AS identifier_density", f"round(least(1.0, {_sum(M._KEYWORDS)} / {_SPACED}), 6)::DOUBLE AS keyword_density"]
)


@register("pr23_features", f"SELECT id, {FEATURES} FROM (SELECT id, content AS text FROM (WITH {U} SELECT * FROM u))")
def pr23(spark, sf_dir):
    """Rows 23 and 32 to 38."""
    return units(spark, sf_dir).select("id", *[F.round(x, 6).cast("double").alias(n) for n, x in M.features(F.col("content")).items()])


@register("pr24_advanced_embedding", f"WITH {VECTORS} SELECT id AS unit, 391 AS dimensions, round(sum(w / s), 5) AS total FROM (SELECT id, w, sqrt(sum(w * w) OVER (PARTITION BY id)) AS s FROM v) GROUP BY id")
def pr24(spark, sf_dir):
    """Vectors with features behind them; the sum is of the hashed part (rows 24 and 39)."""
    e = M.embed_with_features(_part(spark, sf_dir), "id", "text")
    return e.select("unit", F.size("embedding").alias("dimensions"), F.round(F.aggregate(F.slice("embedding", 1, M.DIMENSIONS), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@register("pr06_symbol_content", f"WITH {U} SELECT id, array_to_string(string_split(content, chr(10))[2:3], chr(10)) AS body FROM u WHERE len(string_split(content, chr(10))) >= 2")
def pr06(spark, sf_dir):
    return units(spark, sf_dir).select("id", N.symbol_content(F.col("content"), F.lit(2), F.lit(3)).alias("body")).where("body is not null")


@register("pr03_symbol_ids", f"WITH {U} SELECT sha256(file_path || ':' || name || ':' || symbol_type) AS unit_id, max(k) AS k FROM u GROUP BY 1")
def pr03(spark, sf_dir):
    """Symbol units: ids that don't depend on content, the last of those that share one (rows 1 and 3)."""
    u = units(spark, sf_dir).withColumn("unit_id", N.symbol_id(F.col("file_path"), F.col("name"), F.col("symbol_type")))
    return u.groupBy("unit_id").agg(F.max("k").alias("k"))


@register("pr02_file_ids", f"WITH {U} SELECT file_path, sha256('file:' || file_path || ':' || sha256(string_agg(content, '' ORDER BY k))) AS unit_id, count(*) AS symbol_count FROM u GROUP BY file_path")
def pr02(spark, sf_dir):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "")
    f = units(spark, sf_dir).groupBy("file_path").agg(whole.alias("content"), F.count("*").alias("symbol_count"))
    return f.select("file_path", N.file_id(F.col("file_path"), F.sha2("content", 256)).alias("unit_id"), "symbol_count")


_WORDS = "list_distinct(list_concat([lower(regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', ''))], list_transform(s, lambda x: lower(x.name)), list_transform(list_filter(s, lambda x: x.symbol_type IN ('class', 'function', 'method')), lambda x: x.symbol_type || ' ' || lower(x.name)), ['import', 'python', 'python file']))"


@register("pr04_file_keywords", f"WITH {U}, g AS (SELECT file_path, list(struct_pack(name := name, symbol_type := symbol_type)) AS s FROM u GROUP BY file_path) SELECT DISTINCT file_path, unnest({_WORDS}) AS keyword FROM g")
def pr04(spark, sf_dir):
    f = units(spark, sf_dir).groupBy("file_path").agg(F.collect_list(F.struct("name", "symbol_type")).alias("s"))
    return f.select("file_path", F.explode(N.file_keywords(F.col("file_path"), F.lit("python"), F.col("s"), F.array(F.lit("import os")))).alias("keyword"))


@register("pr05_symbol_keywords", f"WITH {U} SELECT id, array_to_string(list_concat([symbol_type], CASE WHEN params = '' THEN [] ELSE string_split(params, ',') END, CASE WHEN k % 4 = 0 THEN ['int'] ELSE [] END, CASE WHEN k % 3 = 0 THEN ['async'] ELSE [] END, CASE WHEN k % 5 = 0 THEN ['exported'] ELSE [] END), ' ') AS keywords FROM u")
def pr05(spark, sf_dir):
    s = F.struct(
        "symbol_type", "parameters", F.when(F.col("k") % 4 == 0, "INT").alias("return_type"), F.lit("").alias("visibility"), (F.col("k") % 3 == 0).alias("is_async"), F.lit(False).alias("is_static"), (F.col("k") % 5 == 0).alias("is_exported")
    )
    return units(spark, sf_dir).select("id", s.alias("s")).select("id", F.array_join(N.symbol_keywords(F.col("s")), " ").alias("keywords"))


@register("pr30_function_ends", f"WITH {U}, l AS (SELECT id, string_split(content, chr(10)) AS lines FROM u WHERE symbol_type = 'function') SELECT id, coalesce(list_filter(generate_series(2, len(lines)), lambda j: regexp_matches(lines[j], '^\\S'))[1], len(lines) + 1)::INT - 1 AS n FROM l")
def pr30(spark, sf_dir):
    """Lines of a function up to the next that isn't indented."""
    return units(spark, sf_dir).where("symbol_type = 'function'").select("id", F.size(A.body(F.split("content", "\n"), F.lit(1))).alias("n"))


@register(
    "pr26_paths",
    r"""SELECT url, regexp_extract(url, '(\.[^./]*)$', 1) AS extension, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(.+?)(\.[^.]*)?$', 1) AS stem, left(translate(url, '<>:"/\|?*', '_________'), 255) AS safe, starts_with(url, 'https://') AS below,
CASE WHEN n < 1024 THEN n || '.0 B' WHEN n < 1048576 THEN format('{:.1f} KB', round(n / 1024, 1)) ELSE format('{:.1f} MB', round(n / 1048576, 1)) END AS size FROM (SELECT url, strlen(html) AS n FROM pages)""",
)
def pr26(spark, sf_dir):
    """Path scalars over the pages' addresses, and sizes for people."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("url", P.extension(F.col("url")).alias("extension"), P.stem(F.col("url")).alias("stem"), P.sanitized(F.col("url")).alias("safe"), P.is_below(F.col("url"), "https:").alias("below"), P.human_size(F.octet_length("html")).alias("size"))


@register("pr27_durations", "SELECT event_id, CASE WHEN value < 0.001 THEN format('{:.2f}us', value * 1000000) WHEN value < 1 THEN format('{:.2f}ms', value * 1000) WHEN value < 60 THEN format('{:.2f}s', value) ELSE floor(value / 60)::INT || 'm ' || format('{:.2f}s', value - 60 * floor(value / 60)) END AS duration FROM (SELECT event_id, round(abs(value), 2) AS value FROM events WHERE value IS NOT NULL)")
def pr27(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("value is not null")
    return e.select("event_id", P.duration(F.round(F.abs("value"), 2)).alias("duration"))


@register("pr07_index_terms", f"SELECT p_partkey AS id, {T.stem_sql('x')} AS term FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g') AS x FROM part)")
def pr07(spark, sf_dir):
    """Keywords as index terms: a keyword of several words stays one."""
    return _part(spark, sf_dir).select("id", T.stem(T.plain(F.col("text"))).alias("term"))
