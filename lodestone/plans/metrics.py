"""Queries of the metrics, the rules and the trend operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.plans.registry import register


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@register("ag02_basic_metrics", "SELECT count(*) AS total_units, count(DISTINCT source) AS total_files, count(*) FILTER (lang = 'en') AS en_count, round(count(*) / count(DISTINCT source), 6) AS units_per_file FROM documents")
def ag02(spark, sf_dir):
    d = _documents(spark, sf_dir)
    return d.agg(
        F.count("*").alias("total_units"), F.countDistinct("source").alias("total_files"), F.count(F.when(F.col("lang") == "en", 1)).alias("en_count"),
        F.round(F.count("*") / F.countDistinct("source"), 6).alias("units_per_file"),
    )


_COUNTED = {"if ": 1, "for ": 1, "while ": 1, "try:": 2, "elif ": 1, "except": 1}


@register(
    "ag03_complexity",
    f"WITH c AS (SELECT {' + '.join(f'''{n} * ((length(text) - length(replace(text, '{w}', ''))) // {len(w)})''' for w, n in _COUNTED.items())} AS x FROM documents) "
    "SELECT round(avg(x), 6) AS avg_complexity, max(x)::BIGINT AS max_complexity, min(x)::BIGINT AS min_complexity, sum(x)::BIGINT AS total_complexity FROM c",
)
def ag03(spark, sf_dir):
    x = sum((n * F.floor((F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w)) for w, n in _COUNTED.items()), F.lit(0))
    c = _documents(spark, sf_dir).select(x.alias("x"))
    return c.agg(F.round(F.avg("x"), 6).alias("avg_complexity"), F.max("x").alias("max_complexity"), F.min("x").alias("min_complexity"), F.sum("x").alias("total_complexity"))


@register(
    "ag04_size_metrics",
    "SELECT round(avg(length(text)), 6) AS avg_chars, max(length(text))::BIGINT AS max_chars, min(length(text))::BIGINT AS min_chars, sum(length(text))::BIGINT AS total_chars, median(length(text))::DOUBLE AS median_chars, "
    "sum(len(string_split(text, chr(10))))::BIGINT AS total_lines FROM documents",
)
def ag04(spark, sf_dir):
    n = F.length("text").cast("long")
    return _documents(spark, sf_dir).agg(
        F.round(F.avg(n), 6).alias("avg_chars"), F.max(n).alias("max_chars"), F.min(n).alias("min_chars"), F.sum(n).alias("total_chars"), F.median(n).alias("median_chars"),
        F.sum(F.size(F.split("text", "\n"))).alias("total_lines"),
    )


@register("ag09_file_metrics", "SELECT source AS file_path, count(*) AS units, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 6) AS avg_chars FROM documents GROUP BY source")
def ag09(spark, sf_dir):
    return _documents(spark, sf_dir).groupBy(F.col("source").alias("file_path")).agg(F.count("*").alias("units"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("avg_chars"))


@register(
    "ag10_trend",
    "SELECT event_type, round((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / count(*), 6) AS trend, round((arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))) / arg_min(value, (ts, event_id)) * 100, 6) AS percent FROM events GROUP BY event_type",
)
def ag10(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.struct("ts", "event_id")
    ends = events.groupBy("event_type").agg(F.min_by("value", at).alias("first"), F.max_by("value", at).alias("last"), F.count("*").alias("n"))
    step = F.col("last") - F.col("first")
    return ends.select("event_type", F.round(step / F.col("n"), 6).alias("trend"), F.round(F.try_divide(step, F.col("first")) * 100, 6).alias("percent"))


@register("ag17_profile", "SELECT event_type AS name, round(sum(value), 4) AS total, count(*) AS count, round(avg(value), 6) AS average FROM events GROUP BY event_type")
def ag17(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("event_type").alias("name")).agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("count"), F.round(F.avg("value"), 6).alias("average"))


#: Rules of the scan: name, severity, pattern (Java and RE2 read them alike).
RULES = (
    ("secret_assignment", "critical", r"(?i)(password|api_key|secret|token)\s*=\s*[\x22'][^\x22']+[\x22']"),
    ("shell_call", "high", r"(?i)(os\.system|subprocess\.call|eval|exec)\s*\("),
    ("parent_path", "medium", r"(?i)(open|file|read)\s*\(\s*[\x22'].*\.\."),
    ("index_loop", "medium", r"(?i)for\s+\w+\s+in\s+range\s*\(\s*len\s*\("),
    ("number", "low", r"\b[2-9][0-9]+\b"),
)


@register(
    "an01_findings",
    " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS rule, '{severity}' AS severity, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}'))::BIGINT AS hits FROM documents WHERE regexp_matches(text, '{pattern.replace(chr(39), chr(39) * 2)}')"
        for name, severity, pattern in RULES
    ),
)
def an01(spark, sf_dir):
    """How often each rule matches in each document, in one pass over the texts."""
    found = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.regexp_count("text", F.lit(p)).cast("long").alias("hits")) for n, s, p in RULES])
    return _documents(spark, sf_dir).select("doc_id", F.inline(found)).where("hits > 0")


@register("ag13_findings_by_severity", "SELECT severity, sum(hits)::BIGINT AS findings FROM (" + " UNION ALL ".join(
    f"SELECT '{severity}' AS severity, len(regexp_extract_all(text, '{pattern.replace(chr(39), chr(39) * 2)}')) AS hits FROM documents" for _, severity, pattern in RULES) + ") WHERE hits > 0 GROUP BY severity")
def ag13(spark, sf_dir):
    return an01(spark, sf_dir).groupBy("severity").agg(F.sum("hits").alias("findings"))
