"""Queries of the relationship extraction, over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import edges as E
from lodestone.plans.code import FILES, U, files, units
from lodestone.plans.registry import register


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


S = "s AS (SELECT name, arg_max(id, k) AS target, arg_max(symbol_type, k) AS target_type FROM u GROUP BY name)"
CALLED = rf"c AS (SELECT id, symbol_type, name AS own, unnest(regexp_extract_all(content, '{E.CALL}', 1)) AS said FROM u WHERE symbol_type IN ('function', 'method'))"
MENTIONED = rf"m AS (SELECT id, content, unnest(regexp_extract_all(content, '{E.IDENTIFIER}', 1)) AS said FROM u)"
#: Rows (src, dst, said, count) of distinct names that a unit mentions.
COUNTED = f"{MENTIONED}, t AS (SELECT id, content, said, count(*) AS count FROM m WHERE said NOT IN ({_in(E.RESERVED_EITHER)}) AND length(said) > 1 GROUP BY ALL)"
IMPORTED = rf"i AS (SELECT DISTINCT id, content, trim(said) AS said FROM (SELECT id, content, unnest(regexp_extract_all(content, '{E.IMPORT}', 1)) AS said FROM f UNION ALL SELECT id, content, unnest(regexp_split_to_array(x, '\s*,\s*')) FROM (SELECT id, content, unnest(regexp_extract_all(content, '{E.FROM}', 1)) AS x FROM f)))"
JN02 = f"SELECT c.id AS src, target AS dst FROM c JOIN s ON s.name = said WHERE said NOT IN ({_in(E.NOT_CALLED)}) AND target <> c.id"
JN03 = "SELECT a.id AS src, b.id AS dst FROM u a JOIN u b USING (file_path) WHERE a.symbol_type = 'class' AND b.symbol_type = 'method'"
JN04 = "SELECT i.id AS src, target AS dst, 0.8::DOUBLE AS weight, CASE WHEN contains(content, 'import ' || said) THEN 'direct' ELSE 'unknown' END AS import_type, coalesce(trim(list_filter(string_split(content, chr(10)), lambda x: contains(x, said) AND contains(x, 'import'))[1]), '') AS imported_from FROM i JOIN s ON s.name = said WHERE target <> i.id"
JN05 = "SELECT f.id AS src, u.id AS dst, symbol_type FROM f JOIN u USING (file_path)"
JN06 = f"SELECT m.id AS src, target AS dst FROM m JOIN s ON s.name = said WHERE said NOT IN ({_in(E.RESERVED)}) AND length(said) > 1 AND target <> m.id"
JN07 = f"SELECT c.id AS src, target AS dst, count(*) AS count, least(1.0, round(0.3 + 0.1 * count(*), 6))::DOUBLE AS weight, c.symbol_type AS caller_type, target_type AS callee_type FROM c JOIN s ON s.name = said WHERE said NOT IN ({_in(E.NOT_CALLED_EITHER)}) AND said <> own AND target <> c.id GROUP BY ALL"
JN09 = r"SELECT src, target AS dst, said AS base FROM (SELECT DISTINCT id AS src, trim(unnest(string_split(x, ','))) AS said FROM (SELECT id, unnest(regexp_extract_all(content, 'class\s+\w+\s*\(([^)]+)\)', 1)) AS x FROM u WHERE symbol_type = 'class')) JOIN s ON s.name = said WHERE src <> '' "
JN10 = "SELECT c.id AS src, m.id AS dst, CASE WHEN m.symbol_type = 'method' THEN 'class_contains_method' ELSE 'class_contains_attribute' END AS containment_type FROM u c JOIN u m USING (file_path) WHERE c.symbol_type = 'class' AND m.line_start > c.line_start AND m.line_end <= c.line_end AND m.id <> c.id"
JN11 = "SELECT t.id AS src, target AS dst, count, least(1.0, round(0.2 + 0.05 * count, 6))::DOUBLE AS weight FROM t JOIN s ON s.name = said WHERE target <> t.id"
JN12 = "SELECT t.id AS src, target AS dst, count, least(1.0, round(0.4 + 0.1 * count, 6))::DOUBLE AS weight, CASE WHEN contains(content, said || '(') THEN 'function_call' WHEN contains(content, '(' || said || ')') THEN 'type_annotation' ELSE 'reference' END AS usage_type FROM t JOIN s ON s.name = said WHERE target <> t.id"


def _q(*ctes: str) -> str:
    return f"WITH {', '.join((U, *ctes))} "


@register("jn02_calls", _q(S, CALLED) + JN02)
def jn02(spark, sf_dir):
    return E.calls(units(spark, sf_dir))


@register("jn03_class_methods", _q() + JN03)
def jn03(spark, sf_dir):
    return E.class_methods(units(spark, sf_dir))


@register("jn04_file_imports", _q(FILES, S, IMPORTED) + JN04)
def jn04(spark, sf_dir):
    """Imports with their kind and source line (rows 4, 8, 14, 24 and 28)."""
    return E.file_imports(files(spark, sf_dir), units(spark, sf_dir))


@register("jn05_file_symbols", _q(FILES) + JN05)
def jn05(spark, sf_dir):
    return E.file_symbols(files(spark, sf_dir), units(spark, sf_dir))


@register("jn06_references", _q(S, MENTIONED) + JN06)
def jn06(spark, sf_dir):
    return E.references(units(spark, sf_dir))


@register("jn07_weighed_calls", _q(S, CALLED) + JN07)
def jn07(spark, sf_dir):
    """Distinct calls with counts and weights (rows 7, 13, 23 and 25)."""
    return E.weighed_calls(units(spark, sf_dir))


@register("jn09_inheritance", _q(S) + JN09)
def jn09(spark, sf_dir):
    """Rows 9 and 27."""
    return E.inheritance(units(spark, sf_dir))


@register("jn10_class_members", _q() + JN10)
def jn10(spark, sf_dir):
    """The range join of rows 10 and 30."""
    return E.class_members(units(spark, sf_dir))


@register("jn11_weighed_references", _q(S, COUNTED) + JN11)
def jn11(spark, sf_dir):
    """Rows 11, 23 and 26."""
    return E.weighed_references(units(spark, sf_dir)).drop("contexts")


@register(
    "jn29_reference_contexts",
    _q(S, COUNTED)
    + """, l AS (SELECT t.id AS src, target AS dst, said, string_split(content, chr(10)) AS lines FROM t JOIN s ON s.name = said WHERE target <> t.id)
SELECT src, dst, array_to_string(list_transform(list_filter(generate_series(1, len(lines)), lambda i: contains(lines[i], said))[:3], lambda i: trim(array_to_string(lines[greatest(i - 1, 1):i + 1], chr(10)), ' ')), '|') AS contexts FROM l""",
)
def jn29(spark, sf_dir):
    return E.weighed_references(units(spark, sf_dir)).select("src", "dst", F.array_join("contexts", "|").alias("contexts"))


@register("jn12_usages", _q(S, COUNTED) + JN12)
def jn12(spark, sf_dir):
    """Rows 12, 14 and 23."""
    return E.usages(units(spark, sf_dir))


@register("jn15_symbol_lookup", _q(S) + "SELECT name, target, target_type FROM s")
def jn15(spark, sf_dir):
    return E.symbols(units(spark, sf_dir)).select("name", "target", "target_type")


ALL = f"""a AS (SELECT src, dst, 'calls' AS relation_type, 1.0::DOUBLE AS weight FROM ({JN02}) UNION ALL SELECT src, dst, 'contains', 1.0 FROM ({JN03}) UNION ALL SELECT src, dst, 'imports', 0.8 FROM ({JN04})
 UNION ALL SELECT src, dst, 'contains', 1.0 FROM ({JN05}) UNION ALL SELECT src, dst, 'references', 0.6 FROM ({JN06}))"""
#: One row an edge, as the extractor has them.
EXTRACTED = f"""x AS (SELECT src, dst, 'calls' AS relation_type, weight FROM ({JN07}) UNION ALL SELECT src, dst, 'imports', weight FROM ({JN04}) UNION ALL SELECT src, dst, 'inherits', 1.0 FROM ({JN09}) UNION ALL SELECT src, dst, 'contains', 1.0 FROM ({JN05})
 UNION ALL SELECT src, dst, 'contains', 1.0 FROM ({JN10}) UNION ALL SELECT src, dst, 'references', weight FROM ({JN11}) UNION ALL SELECT src, dst, 'uses', weight FROM ({JN12}))"""
EXTRACT = (FILES, S, CALLED, IMPORTED, COUNTED, EXTRACTED)


@register("jn01_relationships", _q(FILES, S, CALLED, IMPORTED, MENTIONED, ALL) + "SELECT src, dst, relation_type, weight, count(*) AS times FROM a GROUP BY ALL")
def jn01(spark, sf_dir):
    return E.counted_relationships(files(spark, sf_dir), units(spark, sf_dir))


@register("jn01_extracted_edges", _q(*EXTRACT) + "SELECT relation_type, count(*) AS edges, round(sum(weight), 4) AS weight FROM x GROUP BY 1")
def jn01x(spark, sf_dir):
    found = E.extracted(files(spark, sf_dir), units(spark, sf_dir))
    return found.groupBy("relation_type").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


COUPLED = """e AS (SELECT a.file_path AS f, b.file_path AS t, x.src FROM x JOIN u a ON a.id = x.src JOIN u b ON b.id = x.dst WHERE a.file_path <> b.file_path),
w AS (SELECT file_path, (SELECT count(*) FROM e WHERE t = file_path) AS afferent, (SELECT count(DISTINCT t) FROM e WHERE f = file_path) AS efferent FROM (SELECT DISTINCT file_path FROM u))"""


def _extracted(spark, sf_dir):
    return E.extracted(files(spark, sf_dir), units(spark, sf_dir))


@register("jn17_coupling", _q(*EXTRACT, COUPLED) + "SELECT file_path, afferent, efferent FROM w")
def jn17(spark, sf_dir):
    return E.coupling(units(spark, sf_dir), _extracted(spark, sf_dir))


@register(
    "jn19_duplicated_code",
    """WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents), s AS (SELECT id, i AS at, md5(array_to_string(lines[i:i + 3], chr(10))) AS h FROM l, unnest(generate_series(1, len(lines) - 3)) AS g(i))
SELECT a.id, b.id AS other, count(*) AS common FROM s a JOIN (SELECT DISTINCT id, h FROM s) b ON a.h = b.h AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) > 2""",
)
def jn19(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return E.duplicated(d.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@register("jn22_shotgun_surgery", _q(*EXTRACT) + "SELECT b.id, count(DISTINCT a.file_path) AS files FROM x JOIN u a ON a.id = x.src JOIN u b ON b.id = x.dst WHERE b.symbol_type = 'class' AND a.file_path <> b.file_path GROUP BY b.id HAVING count(DISTINCT a.file_path) > 5")
def jn22(spark, sf_dir):
    """Classes on which more than five other files depend."""
    u = units(spark, sf_dir)
    a, b = u.select(F.col("id").alias("src"), F.col("file_path").alias("from")), u.where("symbol_type = 'class'").select("id", F.col("id").alias("dst"), "file_path")
    across = _extracted(spark, sf_dir).join(E.unsent(b), "dst").join(E.unsent(a), "src").where(F.col("from") != F.col("file_path"))
    return across.groupBy("id").agg(F.countDistinct("from").alias("files")).where("files > 5")
