"""Queries of the front end over the conversations, and of results as text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import analysis as A
from lodestone.operators import front as Q
from lodestone.plans.analysis import _findings_sql
from lodestone.plans.code import U, units
from lodestone.plans.registry import register

#: Queries: what users said, with words of the rules in front, by the turn.
SAID = "CASE turn % 7 WHEN 0 THEN 'find: ' WHEN 1 THEN 'how many ' WHEN 2 THEN 'what is connected to ' WHEN 3 THEN 'Explain the call graph of ' WHEN 4 THEN 'search for ' WHEN 5 THEN 'quality report ' ELSE '' END || text || CASE WHEN turn % 3 = 0 THEN '?' ELSE '' END"
LOW = f"ql AS (SELECT conv_id, turn, trim(lower(q), ' ') AS low, q FROM (SELECT conv_id, turn, {SAID} AS q FROM conversations))"


def _queries(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id", "turn", f"{SAID} AS q")


def _score(intent: str) -> str:
    patterns = ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN {s} ELSE 0 END" for i, s, p in Q.PATTERNS if i == intent)
    words = " + ".join(f"{w} * list_contains(string_split_regex(low, '\\s+'), '{k}')::INT" for k, w in Q.KEYWORDS[intent].items())
    form = {
        "help": "0.3 * contains(low, '?')::INT", "analyze": "0.3 * contains(low, '?')::INT + 0.2 * (len(list_filter(string_split_regex(low, '\\s+'), lambda w: w <> '')) > 5)::INT", "find": "0.4 * contains(low, ':')::INT",
        "graph": f"0.3 * regexp_matches(low, '{'|'.join(Q.TECHNICAL)}')::INT",
    }.get(intent, "0")
    return f"round(0.4 * greatest(0, {patterns}) + 0.3 * ({words}) / {sum(Q.KEYWORDS[intent].values())} + 0.1 * ({form}), 9)::DOUBLE"


_SCORES = f"{LOW}, qs AS (SELECT conv_id, turn, {', '.join(f'{_score(i)} AS {i}_score' for i in Q.INTENTS)} FROM ql)"
_BEST = "greatest(" + ", ".join(f"{i}_score" for i in Q.INTENTS) + ")"


@register("qf02_intent_scores", f"WITH {_SCORES} SELECT * FROM qs")
def qf02(spark, sf_dir):
    """Rows 2 to 6."""
    return _queries(spark, sf_dir).select("conv_id", "turn", *[s.alias(f"{i}_score") for i, s in Q.intent_scores(F.col("q")).items()])


@register("qf01_intents", f"WITH {_SCORES} SELECT conv_id, turn, CASE WHEN {_BEST} < {Q.THRESHOLD} THEN 'search' {' '.join(f'''WHEN {i}_score = {_BEST} THEN '{i}' ''' for i in Q.INTENTS)} END AS intent, {_BEST} AS confidence FROM qs")
def qf01(spark, sf_dir):
    """Rows 1 and 7."""
    return Q.classified(_queries(spark, sf_dir), "q").select("conv_id", "turn", "intent", "confidence")


@register("qf09_simple_intents", f"WITH {LOW} SELECT conv_id, turn, CASE {' '.join('WHEN ' + ' OR '.join(f'''contains(lower(q), '{w}')''' for w in words) + f''' THEN '{i}' ''' for i, words in Q.SIMPLE)} ELSE 'search' END AS intent FROM ql")
def qf09(spark, sf_dir):
    return _queries(spark, sf_dir).select("conv_id", "turn", Q.simple_intent(F.col("q")).alias("intent"))


@register("qf16_cache_keys", f"WITH {LOW} SELECT conv_id, turn, md5('search|' || q || '|{{}}|10|' || turn) AS key FROM ql")
def qf16(spark, sf_dir):
    return _queries(spark, sf_dir).select("conv_id", "turn", Q.cache_key(F.lit("search"), F.col("q"), F.lit("{}"), F.lit(10), F.col("turn")).alias("key"))


def _hits(spark, sf_dir):
    u = units(spark, sf_dir).withColumn("score", F.round(F.length("content") / 7.0, 3))
    return u.withColumn("rank", F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id")))


_H = f"{U}, h AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS rank FROM (SELECT *, round(length(content) / 7.0, 3)::DOUBLE AS score FROM u))"


@register("qf12_text", f"WITH {_H} SELECT rank || '. ' || name || ' (' || symbol_type || ') - ' || file_path || ' [' || format('{{:.4f}}', score) || ']' AS line FROM h")
def qf12(spark, sf_dir):
    return Q.formatted(_hits(spark, sf_dir), "text")


@register("qf12_table", f"WITH {_H} SELECT rpad(CASE WHEN length(name) > 30 THEN left(name, 27) || '...' ELSE name END, 30, ' ') || ' | ' || rpad(CASE WHEN length(file_path) > 40 THEN left(file_path, 37) || '...' ELSE file_path END, 40, ' ') || ' | ' || format('{{:.4f}}', score) AS line FROM h")
def qf12t(spark, sf_dir):
    return Q.formatted(_hits(spark, sf_dir), "table")


@register("qf12_json", f"WITH {_H} SELECT '{{\"rank\":' || rank || ',\"id\":\"' || id || '\",\"name\":\"' || name || '\",\"symbol_type\":\"' || symbol_type || '\",\"file_path\":\"' || file_path || '\"}}' AS line FROM h")
def qf12j(spark, sf_dir):
    return Q.formatted(_hits(spark, sf_dir), "json").select(F.regexp_replace("line", r',"score":[^}]*', "").alias("line"))


@register("qf12_markdown", f"WITH {_H} SELECT '### ' || rank || '. `' || name || '`' || chr(10) || chr(10) || file_path || chr(10) || chr(10) || '```' || chr(10) || CASE WHEN length(content) > 500 THEN left(content, 497) || '...' ELSE content END || chr(10) || '```' AS line FROM h")
def qf12m(spark, sf_dir):
    return Q.formatted(_hits(spark, sf_dir), "markdown")


@register("qf19_findings_report", f"WITH {U} SELECT '[' || upper(severity) || '] ' || file_path || ':' || line_number || ' ' || issue AS line FROM ({_findings_sql('security')}) JOIN u USING (id)")
def qf19(spark, sf_dir):
    return Q.findings_report(A.findings(units(spark, sf_dir), "security"))


@register("qf14_query_history", "SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC)::INT AS place FROM conversations) WHERE place <= 100")
def qf14(spark, sf_dir):
    """The last hundred queries of each role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("conv_id"), F.desc("turn"))).alias("place")).where("place <= 100")
