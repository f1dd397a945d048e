"""Queries of the three indices, of the searches and filters over them, and of the ranking of units, over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import blocks as B
from lodestone.operators import index as I
from lodestone.operators import ranking as R
from lodestone.plans.code import U, units
from lodestone.plans.edges import EXTRACT, _extracted, _q
from lodestone.plans.registry import register

QUERY = "component plain_70 execute self run_3 class component"
TERMS, WORDS = T.query_terms(QUERY), T.query_terms(QUERY, stemmed=False)
K = 20


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _term(x: str) -> str:
    return T.stem_sql(f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g')")


#: Keywords of the symbol units: their type and parameters.
INDEX = f"""kw AS (SELECT id, unnest(list_concat([symbol_type], CASE WHEN params = '' THEN [] ELSE string_split(params, ',') END)) AS w FROM u),
ix AS (SELECT DISTINCT 'term' AS "index", key, unit_id FROM (SELECT {_term('w')} AS key, id AS unit_id FROM kw) WHERE key <> '' AND key NOT IN ({_quoted(T.STOP_WORDS)})
 UNION SELECT 'term', key, unit_id FROM (SELECT {T.stem_sql('w')} AS key, id AS unit_id FROM (SELECT id, unnest({T.words_sql('content')}) AS w FROM u)) WHERE {T.is_term_sql('key')}
 UNION SELECT 'symbol', {_term('name')}, id FROM u UNION SELECT 'symbol', symbol_type, id FROM u UNION SELECT 'symbol', {_term('w')}, id FROM (SELECT id, unnest(string_split(params, ',')) AS w FROM u WHERE params <> '') UNION SELECT 'file', file_path, id FROM u)"""


def keyed(spark, sf_dir):
    """The symbol units with their keywords."""
    return units(spark, sf_dir).withColumn("keywords", F.concat(F.array("symbol_type"), "parameters"))


def _index(spark, sf_dir):
    return I.three_indices(keyed(spark, sf_dir))


@register("ix01_three_indices", f'WITH {U}, {INDEX} SELECT "index", key, unit_id FROM ix')
def ix01(spark, sf_dir):
    """Rows 1, 2 and 9."""
    return _index(spark, sf_dir)


@register("ix03_updated_index", f'WITH {U}, {INDEX} SELECT "index", key, count(*) AS units FROM (SELECT "index", key, unit_id FROM ix WHERE substr(unit_id, 2)::BIGINT % 3 <> 0 UNION SELECT "index", key, \'new\' || unit_id FROM ix WHERE substr(unit_id, 2)::BIGINT % 5 = 0) GROUP BY 1, 2')
def ix03(spark, sf_dir):
    """The indices after units went and others came (rows 3, 4, 5 and 8)."""
    index = _index(spark, sf_dir)
    gone = units(spark, sf_dir).where("k % 3 = 0").select(F.col("id").alias("unit_id"))
    fresh = I.three_indices(keyed(spark, sf_dir).where("k % 5 = 0").withColumn("id", F.concat(F.lit("new"), "id")))
    return I.updated(index, gone, fresh).groupBy("index", "key").agg(F.count("*").alias("units"))


@register(
    "se01_symbol_search",
    f"""WITH {U}, {INDEX}, df AS (SELECT "index", key, count(*) AS df FROM ix GROUP BY 1, 2), v AS (SELECT "index", count(*) AS v FROM df GROUP BY 1)
SELECT unit_id, round(sum(CASE "index" WHEN 'symbol' THEN 2 ELSE 1 END * ln(v / (df + 1))), 6) AS score FROM (SELECT unnest([{_quoted(TERMS)}]) AS key) JOIN df USING (key) JOIN v USING ("index") JOIN ix USING ("index", key) WHERE "index" <> 'file' GROUP BY unit_id ORDER BY score DESC, unit_id LIMIT {K}""",
)
def se01(spark, sf_dir):
    """Terms and symbols scored together (rows 1 and 2)."""
    return I.scored(_index(spark, sf_dir), TERMS, K)


@register("se03_routed_exact", f"WITH {U}, {INDEX} SELECT DISTINCT unit_id, 1::BIGINT AS score FROM ix WHERE \"index\" <> 'file' AND key = 'run_13' ORDER BY unit_id LIMIT {K}")
def se03(spark, sf_dir):
    """Rows 3, 4 and 24."""
    return I.routed(_index(spark, sf_dir), "find: run_13", K)


@register("se25_routed_text", f"WITH {U}, {INDEX} SELECT unit_id, count(*) AS score FROM ix WHERE \"index\" = 'term' AND key IN ({_quoted(WORDS)}) GROUP BY 1 ORDER BY score DESC, unit_id LIMIT {K}")
def se25(spark, sf_dir):
    """Rows 3, 21 and 25."""
    return I.routed(_index(spark, sf_dir), f"search: {QUERY}", K)


@register("se19_symbol_substrings", f"WITH {U}, {INDEX} SELECT DISTINCT unit_id FROM ix WHERE \"index\" = 'symbol' AND contains(lower(key), 'repository')")
def se19(spark, sf_dir):
    return I.substrings(_index(spark, sf_dir), "symbol", "Repository")


@register("se20_file_substrings", f"WITH {U}, {INDEX} SELECT DISTINCT unit_id FROM ix WHERE \"index\" = 'file' AND contains(lower(key), 'models/brand_1')")
def se20(spark, sf_dir):
    return I.substrings(_index(spark, sf_dir), "file", "models/Brand_1")


@register("se21_units_found", f"WITH {U}, {INDEX} SELECT u.id, file_path, name, score FROM (SELECT unit_id, count(*) AS score FROM ix WHERE \"index\" = 'term' AND key IN ({_quoted(WORDS)}) GROUP BY 1 ORDER BY score DESC, unit_id LIMIT {K}) JOIN u ON u.id = unit_id")
def se21(spark, sf_dir):
    """Hits joined to their units (rows 21 and 24)."""
    hits = I.routed(_index(spark, sf_dir), QUERY, K)
    return units(spark, sf_dir).join(F.broadcast(hits), F.col("id") == F.col("unit_id")).select("id", "file_path", "name", "score")  # K rows


_ANY = f"(SELECT unit_id FROM ix WHERE (\"index\" = 'file' AND contains(key, 'views')) {{op}} SELECT unit_id FROM ix WHERE (\"index\" = 'symbol' AND key = 'method'))"


@register("fi03_any_filter", f"WITH {U}, {INDEX} SELECT DISTINCT unit_id FROM {_ANY.format(op='UNION')}")
def fi03(spark, sf_dir):
    return I.filter_ids(_index(spark, sf_dir), {"file": "views", "symbol_type": "method"}, union=True)


@register("fi03_all_filters", f"WITH {U}, {INDEX} SELECT DISTINCT unit_id FROM {_ANY.format(op='INTERSECT')}")
def fi03a(spark, sf_dir):
    return I.filter_ids(_index(spark, sf_dir), {"file": "views", "symbol_type": "method"})


@register("fi02_post_filter", f"WITH {U} SELECT id FROM u WHERE contains(lower(file_path), 'models') AND symbol_type = 'class' AND k > 10")
def fi02(spark, sf_dir):
    found = R.post_filter(units(spark, sf_dir).withColumn("file_type", F.lit("python")), {"file_path": "MODELS", "symbol_type": "class", "language": "PY"})
    return found.where("k > 10").select("id")


@register("fi05_page", f"WITH {U} SELECT id, length(content)::BIGINT AS n FROM u ORDER BY n DESC, id LIMIT 15 OFFSET 30")
def fi05(spark, sf_dir):
    return R.page(units(spark, sf_dir).select("id", F.length("content").cast("long").alias("n")), [F.desc("n"), F.col("id")], 30, 15)


@register("fi06_sizes_and_dates", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND value > 50 AND regexp_matches(event_type, 'c.*k')")
def fi06(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return R.compared(e, {"ts": ">2024-01-10", "value": ">50", "event_type": "/c.*k/"}).select("event_id")


@register("fi07_relation_types", _q(*EXTRACT) + "SELECT src, dst, relation_type FROM x WHERE relation_type IN ('calls', 'inherits')")
def fi07(spark, sf_dir):
    return _extracted(spark, sf_dir).where(F.col("relation_type").isin("calls", "inherits")).select("src", "dst", "relation_type")


_FILTERS = "SELECT conv_id, turn, text || ' file:src/' || turn || ' type:class lang:py date:2024-01-0' || (1 + turn % 9) AS q FROM conversations WHERE role = 'user'"


@register("fi01_extracted_filters", f"SELECT conv_id, turn, regexp_extract(q, 'file:(\\S+)', 1) AS file, regexp_extract(q, 'type:(\\S+)', 1) AS type, regexp_extract(q, 'lang:(\\S+)', 1) AS lang, regexp_extract(q, 'date:(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS date FROM ({_FILTERS})")
def fi01(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    q = c.select("conv_id", "turn", F.concat("text", F.lit(" file:src/"), "turn", F.lit(" type:class lang:py date:2024-01-0"), (1 + F.col("turn") % 9).cast("string")).alias("q"))
    return q.select("conv_id", "turn", *[F.coalesce(x, F.lit("")).alias(n) for n, x in R.filters_in(F.col("q")).items()])


# --- ranking ---

_NOW = "2025-01-01 00:00:00"
_RQ = ["component", "run", "total", "self"]
_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_HITS = " + ".join(f"contains(lower(content), '{t}')::INT" for t in _RQ)
_KEYHITS = " + ".join(f"0.5 * len(list_filter(kws, lambda w: contains(w, '{t}')))" for t in _RQ)
#: CTE rk: the units with the signals of ranking; updated_at is so many days before now, as k says.
SIGNALS = f"""r0 AS (SELECT *, list_concat([symbol_type], CASE WHEN params = '' THEN [] ELSE string_split(params, ',') END) AS kws, k % 120 AS age FROM u),
rk AS (SELECT r0.*, least(1.0, ({_HITS} + {_KEYHITS}) / {2.0 * len(_RQ)})::DOUBLE AS text_relevance, coalesce((SELECT {_COSINE} FROM embeddings e, embeddings q WHERE e.vec_id = r0.k AND q.vec_id = 0), 0)::DOUBLE AS semantic,
 CASE WHEN age < 1 THEN 1.0 WHEN age < 7 THEN 0.8 WHEN age < 30 THEN 0.6 WHEN age < 90 THEN 0.4 ELSE 0.2 END::DOUBLE AS recency, CASE WHEN length(content) > 1000 THEN 1.0 WHEN length(content) > 500 THEN 0.8 WHEN length(content) > 100 THEN 0.6 ELSE 0.4 END::DOUBLE AS popularity,
 CASE symbol_type WHEN 'class' THEN 1.0 WHEN 'function' THEN 0.9 WHEN 'method' THEN 0.8 WHEN 'variable' THEN 0.6 ELSE 0.3 END::DOUBLE AS symbol_weight, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.3 END::DOUBLE AS file_weight FROM r0)"""
_SCORE = "round(0.3 * text_relevance + 0.25 * semantic + 0.15 * recency + 0.15 * popularity + 0.1 * symbol_weight + 0.05 * file_weight, 6)"


def signalled(spark, sf_dir):
    u = keyed(spark, sf_dir).withColumns(
        {
            "updated_at": F.lit(_NOW).cast("timestamp") - F.make_dt_interval((F.col("k") % 120).cast("int")),
            "file_type": F.when(F.col("k") % 3 == 0, "python").when(F.col("k") % 3 == 1, "java").otherwise("text"),
        }
    )
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))  # vec_id is unique: one row
    near = e.crossJoin(q).select(F.col("vec_id").alias("k"), T.cosine(F.col("embedding"), F.col("q")).alias("semantic"))
    return R.signals(u.join(near, "k", "left"), _RQ, _NOW)


@register("rk01_weighted_rank", f"WITH {U}, {SIGNALS} SELECT id, {_SCORE} AS score FROM rk ORDER BY score DESC, id LIMIT {K}")
def rk01(spark, sf_dir):
    """All six signals (rows 1 to 8)."""
    return R.ranked(signalled(spark, sf_dir), k=K)


@register("rk02_scores", f"WITH {U}, {SIGNALS} SELECT id, round(text_relevance, 6) AS text_relevance, round(semantic, 6) AS semantic, recency, popularity, symbol_weight, file_weight FROM rk")
def rk02(spark, sf_dir):
    """The signals one by one (rows 2 to 8)."""
    return signalled(spark, sf_dir).select("id", F.round("text_relevance", 6).alias("text_relevance"), F.round("semantic", 6).alias("semantic"), "recency", "popularity", "symbol_weight", "file_weight")


@register("rk16_learned_rank", f"WITH {U}, {SIGNALS} SELECT id, round(({'{w[0]}'} * text_relevance + {'{w[1]}'} * semantic + {'{w[2]}'} * recency + {'{w[3]}'} * popularity + {'{w[4]}'} * symbol_weight + {'{w[5]}'} * file_weight), 6) AS score FROM rk ORDER BY score DESC, id LIMIT {K}".format(w=[repr(x) + "::DOUBLE" for x in R.learned([(0, {"text_relevance": 0.9, "symbol_weight": 1.0, "file_weight": 1.0}), (4, {"text_relevance": 0.2, "symbol_weight": 0.9, "file_weight": 0.3})]).values()]))
def rk16(spark, sf_dir):
    """Ranking by the weights that two clicks have taught (rows 14, 15, 16 and 19)."""
    clicks = [(0, {"text_relevance": 0.9, "symbol_weight": 1.0, "file_weight": 1.0}), (4, {"text_relevance": 0.2, "symbol_weight": 0.9, "file_weight": 0.3})]
    return R.ranked(signalled(spark, sf_dir), R.learned(clicks), K)


@register("rk09_diverse_rank")
def rk09(spark, sf_dir):
    """The best units, each next one by its score less what it shares with those before."""
    return R.diverse(signalled(spark, sf_dir), 50)


_PAIR = "least(1.0, CASE WHEN a.file_path = b.file_path THEN 0.4 ELSE 0 END + CASE WHEN a.symbol_type = b.symbol_type THEN 0.3 ELSE 0 END + 0.3 * least(length(a.content), length(b.content)) / greatest(length(a.content), length(b.content)))"


@register("rk10_pair_similarity", f"WITH {U} SELECT a.id, b.id AS other, round({_PAIR}, 6)::DOUBLE AS similarity FROM u a JOIN u b USING (file_path) WHERE a.k < b.k")
def rk10(spark, sf_dir):
    """How alike the units of each file are. Rounded as SQL's round does, by the scaled double; F.round goes by its shortest decimals, and ties may differ. A unit's length is counted once."""
    u = units(spark, sf_dir).select("id", "k", "file_path", "symbol_type", F.length(F.coalesce("content", F.lit(""))).alias("n"))
    both = B.ordered_pairs(u, "file_path", "k").withColumns({"a_file_path": F.col("file_path"), "b_file_path": F.col("file_path")})
    alike = R.similarity_by_length("a_", "b_", F.col("a_n"), F.col("b_n"))
    return both.select(F.col("a_id").alias("id"), F.col("b_id").alias("other"), (F.floor(alike * 1e6 + 0.5) / 1e6).alias("similarity"))


@register("rk11_by_recency", f"WITH {U} SELECT id, k % 120 AS age FROM u ORDER BY age, id LIMIT {K}")
def rk11(spark, sf_dir):
    u = units(spark, sf_dir).select("id", (F.col("k") % 120).alias("age"), (F.lit(_NOW).cast("timestamp") - F.make_dt_interval((F.col("k") % 120).cast("int"))).alias("updated_at"))
    return u.orderBy(F.desc("updated_at"), "id").limit(K).select("id", "age")


@register("rk12_by_length", f"WITH {U} SELECT id, length(content)::BIGINT AS n FROM u ORDER BY n DESC, id LIMIT {K}")
def rk12(spark, sf_dir):
    return units(spark, sf_dir).select("id", F.length("content").cast("long").alias("n")).orderBy(F.desc("n"), "id").limit(K)


_PQ = ["run", "models", "x", "plain_70"]
_PROC = " + ".join(f"contains(lower(content), '{t}')::INT + 0.5 * len(list_filter(kws, lambda w: contains(lower(w), '{t}'))) + 2 * contains(lower(name), '{t}')::INT + 0.3 * contains(lower(file_path), '{t}')::INT" for t in _PQ)


@register("rk13_processor_rank", f"WITH {U}, {SIGNALS} SELECT id, round({_PROC}, 6)::DOUBLE AS score FROM r0 ORDER BY score DESC, id LIMIT {K}")
def rk13(spark, sf_dir):
    return R.processor_ranked(keyed(spark, sf_dir), _PQ, K)


@register("rk18_top_degrees", _q(*EXTRACT) + "SELECT src AS id, count(DISTINCT dst) AS degree FROM x GROUP BY src ORDER BY degree DESC, id LIMIT 10")
def rk18(spark, sf_dir):
    return _extracted(spark, sf_dir).groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("degree")).orderBy(F.desc("degree"), "id").limit(10)
