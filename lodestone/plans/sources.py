"""Queries of the scan's predicates over a table of paths, and of the parsers over files made of the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import units as N
from lodestone.operators.blocks import tasks
from lodestone.plans.code import U, _sql, units
from lodestone.plans.registry import register
from lodestone.sources import files as S
from lodestone.sources import parse as P

_PATHS = """SELECT k, CASE k % 11 WHEN 0 THEN 'node_modules/x/' WHEN 1 THEN '.hidden/' WHEN 2 THEN 'build/' WHEN 3 THEN 'docs/' WHEN 4 THEN 'a/logs/' ELSE '' END || file_path ||
CASE k % 7 WHEN 0 THEN '.log' WHEN 1 THEN 'c' WHEN 2 THEN '.tar.gz' WHEN 3 THEN '.min.js' WHEN 4 THEN '.TS' ELSE '' END AS path, k * 99991 % 20000000 AS size_bytes FROM u"""
IGNORE = "# comment\n*.log\n!brand_1*.log\nlogs/\n/docs\nsrc/**/brand_2.py\n"


def _paths(spark, sf_dir):
    return _sql(spark, sf_dir, f"WITH {U} {_PATHS}")


def _table(sql: str) -> str:
    return f"WITH {U}, pa AS ({_PATHS}) {sql}"


_SKIPPED = ", ".join(f"'{x}'" for x in S.SKIPPED)
_BINARY = ", ".join(f"'.{x}'" for x in S.BINARY)
_EXT = "lower(regexp_extract(path, '(\\.[^./]*)$', 1))"
_PARTS = "string_split(path, '/')"
_FOLDERS = f"{_PARTS}[:len({_PARTS}) - 1]"
#: The last pattern that matches decides.
_IGNORED = f"""CASE WHEN regexp_matches(path, '^src/.*brand_2\\.py$') OR len(list_filter({_PARTS}, lambda x: regexp_matches(x, '^src/.*brand_2\\.py$'))) > 0 THEN true WHEN list_contains({_PARTS}, 'docs') OR path = 'docs' THEN true WHEN list_contains({_FOLDERS}, 'logs') THEN true
 WHEN regexp_matches(path, '^brand_1.*\\.log$') OR len(list_filter({_PARTS}, lambda x: regexp_matches(x, '^brand_1.*\\.log$'))) > 0 THEN false WHEN regexp_matches(path, '\\.log$') OR len(list_filter({_PARTS}, lambda x: regexp_matches(x, '\\.log$'))) > 0 THEN true ELSE false END"""
_KEPT = f"len(list_filter({_FOLDERS}, lambda x: starts_with(x, '.') OR x IN ({_SKIPPED}))) = 0"


@register("sc03_kept_folders", _table(f"SELECT k FROM pa WHERE {_KEPT}"))
def sc03(spark, sf_dir):
    return _paths(spark, sf_dir).where(S.in_kept_folder(F.col("path"))).select("k")


@register("sc09_ignored", _table(f"SELECT k, {_IGNORED} AS ignored FROM pa"))
def sc09(spark, sf_dir):
    """Rows 8, 9 and 10."""
    return _paths(spark, sf_dir).select("k", S.ignored(F.col("path"), S.parse_ignore(IGNORE)).alias("ignored"))


@register("sc04_wanted_files", _table(f"SELECT k FROM pa WHERE {_KEPT} AND {_EXT} NOT IN ({_BINARY}) AND {_EXT} IN ('.py', '.js', '.log') AND size_bytes <= 10485760 AND NOT regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^.*\\.min\\.js$') AND NOT ({_IGNORED})"))
def sc04(spark, sf_dir):
    """Rows 1, 2, 4 and 5."""
    rows = _paths(spark, sf_dir)
    keep = S.in_kept_folder(F.col("path")) & S.is_wanted(F.col("path"), F.col("size_bytes"), 10 << 20, (".py", ".js", ".log"), ("*.min.js",), S.parse_ignore(IGNORE))
    return rows.where(keep).select("k")


@register("sc06_totals", _table("SELECT count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM pa"))
def sc06(spark, sf_dir):
    """Rows 6 and 7."""
    return S.totals(_paths(spark, sf_dir))


@register("sc11_globally_ignored", _table("SELECT k FROM pa WHERE contains('/' || path, '/node_modules/') OR contains('/' || path, '/__pycache__/') OR regexp_matches(path, '\\.(pyc|log|tmp|swp)$')"))
def sc11(spark, sf_dir):
    return _paths(spark, sf_dir).where(S.globally_ignored(F.col("path"))).select("k")


@register("sc13_languages", _table(f"SELECT k, CASE {' '.join(f'''WHEN {_EXT} = '{e}' THEN '{l}' ''' for e, l in S.LANGUAGES.items())} ELSE 'unknown' END AS language FROM pa"))
def sc13(spark, sf_dir):
    """Rows 13 and 20 of the parsers."""
    return _paths(spark, sf_dir).select("k", S.language(F.col("path")).alias("language"))


@register("sc14_by_extension", _table(f"SELECT k FROM pa WHERE {_EXT} = '.ts'"))
def sc14(spark, sf_dir):
    return S.with_extension(_paths(spark, sf_dir), ".ts").select("k")


@register("sc12_file_records", "SELECT doc_id, sha256(text) AS content_hash, strlen(text)::BIGINT AS size_bytes, 'python' AS file_type FROM documents")
def sc12(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = d.select("doc_id", F.concat(F.lit("a/"), "doc_id", F.lit(".py")).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("last_modified"), F.col("text").cast("binary").alias("content"))
    r = S.records(files)
    return r.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("doc_id"), "content_hash", "size_bytes", "file_type")


# --- parsing ---

#: Python files: the units of each file, one after the other. CTE py(file_path, text).
PY = "py AS (SELECT file_path, string_agg(content, '' ORDER BY k) AS text FROM u GROUP BY file_path), ln AS (SELECT file_path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM py)"


def _python(spark, sf_dir):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]), "")
    # a file is a task's work, whatever its length
    u = units(spark, sf_dir)
    files = u.repartition(4 * tasks(u), "file_path").groupBy(F.col("file_path").alias("path")).agg(whole.alias("content")).withColumn("file_type", F.lit("python"))
    return P.parsed(files)


def _symbols(spark, sf_dir):
    return _python(spark, sf_dir).select("path", F.explode("symbols").alias("s")).select("path", "s.*")


@register("pa06_python_functions", f"WITH {U}, {PY} SELECT file_path AS path, regexp_extract(line, 'def (\\w+)', 1) AS name, CASE WHEN starts_with(line, ' ') THEN 'method' ELSE 'function' END AS symbol_type, n::INT AS line_start, regexp_extract(line, 'def \\w+\\(([^)]*)\\)', 1) AS signature FROM ln WHERE regexp_matches(line, '^ *def ')")
def pa06(spark, sf_dir):
    """Functions and methods with their places and parameters (rows 1, 4 to 8, 19 and 21)."""
    s = _symbols(spark, sf_dir).where("symbol_type IN ('function', 'method')")
    return s.select("path", "name", "symbol_type", "line_start", F.regexp_extract("signature", r"def \w+\(([^)]*)\)", 1).alias("signature"))


@register("pa09_python_classes", f"WITH {U}, {PY} SELECT file_path AS path, regexp_extract(line, '^class (\\w+)', 1) AS name, n::INT AS line_start, replace(regexp_extract(line, '\\(([^)]*)\\)', 1), ' ', '') AS bases FROM ln WHERE starts_with(line, 'class ')")
def pa09(spark, sf_dir):
    return _symbols(spark, sf_dir).where("symbol_type = 'class'").select("path", "name", "line_start", F.array_join("bases", ",").alias("bases"))


@register("pa10_python_variables", f"WITH {U}, {PY} SELECT file_path AS path, regexp_extract(line, '^ *(\\w+) = ', 1) AS name, CASE WHEN regexp_matches(line, '^ *[A-Z0-9_]+ = ') THEN 'constant' ELSE 'variable' END AS symbol_type, n::INT AS line_start FROM ln WHERE regexp_matches(line, '^ *\\w+ = ')")
def pa10(spark, sf_dir):
    return _symbols(spark, sf_dir).where("symbol_type IN ('constant', 'variable')").select("path", "name", "symbol_type", "line_start")


@register("pa11_python_imports", f"WITH {U}, {PY} SELECT file_path AS path, trim(line) AS import, count(*) AS times FROM ln WHERE regexp_matches(line, '^ *import ') GROUP BY ALL")
def pa11(spark, sf_dir):
    p = _python(spark, sf_dir).select("path", F.explode("imports").alias("import"))
    return p.groupBy("path", "import").agg(F.count("*").alias("times"))


@register("pa14_docstrings", f"WITH {U} SELECT file_path AS path, name, doc AS documentation FROM u WHERE doc IS NOT NULL")
def pa14(spark, sf_dir):
    return _symbols(spark, sf_dir).where("documentation is not null").select("path", "name", F.regexp_replace("documentation", "^Holds ", "").alias("documentation"))


@register("pr01_units_of_files", f"WITH {U}, {PY} SELECT path, count(DISTINCT id) AS units FROM (SELECT file_path AS path, name || symbol_type AS id FROM (SELECT file_path, regexp_extract(line, 'def (\\w+)', 1) AS name, CASE WHEN starts_with(line, ' ') THEN 'method' ELSE 'function' END AS symbol_type FROM ln WHERE regexp_matches(line, '^ *def ') UNION ALL SELECT file_path, regexp_extract(line, '^class (\\w+)', 1), 'class' FROM ln WHERE starts_with(line, 'class ') UNION ALL SELECT file_path, regexp_extract(line, '^ *(\\w+) = ', 1), CASE WHEN regexp_matches(line, '^ *[A-Z0-9_]+ = ') THEN 'constant' ELSE 'variable' END FROM ln WHERE regexp_matches(line, '^ *\\w+ = ') UNION ALL SELECT file_path, regexp_extract(line, 'import (\\w+)', 1), 'import' FROM ln WHERE regexp_matches(line, '^ *import ')) UNION ALL SELECT file_path, 'file' FROM py) GROUP BY path")
def pr01(spark, sf_dir):
    """Files parsed and made into units."""
    p = _python(spark, sf_dir).withColumns({"content_hash": F.sha2("content", 256), "size_bytes": F.length("content").cast("long")})
    return N.build(p).groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("units"))


_JS = """'import dep_' || k || ' from "m";' || chr(10) || '/** Adds ' || k || '. */' || chr(10) || 'async function fn_' || k || '(a, b = ' || k || ') {' || chr(10) || '  return a;' || chr(10) || '}' || chr(10) || 'class C_' || k || ' extends Base_' || (k % 9) || ' {' || chr(10) || '  static run(x) {' || chr(10) || '    if (x) { return 1; }' || chr(10) || '  }' || chr(10) || '}' || chr(10) || 'const K_' || k || ' = ' || k || ';' || chr(10) || 'let v = 2;' || chr(10) || 'export { fn_' || k || ', K_' || k || ' };' || chr(10)"""


def _javascript(spark, sf_dir):
    text = f"SELECT 'f' || k || '.js' AS path, 'javascript' AS file_type, {_JS} AS content FROM ".replace("{", "{{").replace("}", "}}")
    files = spark.sql(text + "{u}", u=units(spark, sf_dir).select("k"))
    return P.parsed(files)


@register(
    "pa15_javascript_symbols",
    f"""WITH {U} SELECT path, name, symbol_type, line_start, line_end, parameters, is_exported FROM (
 SELECT 'f' || k || '.js' AS path, unnest([{{'name': 'fn_' || k, 'symbol_type': 'function', 'line_start': 3, 'line_end': 5, 'parameters': 'a,b', 'is_exported': true}}, {{'name': 'C_' || k, 'symbol_type': 'class', 'line_start': 6, 'line_end': 10, 'parameters': '', 'is_exported': false}},
 {{'name': 'run', 'symbol_type': 'method', 'line_start': 7, 'line_end': 9, 'parameters': 'x', 'is_exported': false}}, {{'name': 'K_' || k, 'symbol_type': 'constant', 'line_start': 11, 'line_end': 11, 'parameters': '', 'is_exported': true}}, {{'name': 'v', 'symbol_type': 'variable', 'line_start': 12, 'line_end': 12, 'parameters': '', 'is_exported': false}}], recursive := true) FROM u)""",
)
def pa15(spark, sf_dir):
    """Rows 15, 16, 22, 23 and 25."""
    s = _javascript(spark, sf_dir).select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return s.select("path", "name", "symbol_type", "line_start", "line_end", F.array_join("parameters", ",").alias("parameters"), "is_exported")


@register("pa24_javascript_exports", f"WITH {U} SELECT 'f' || k || '.js' AS path, 'fn_' || k || ',K_' || k AS exports, 'import dep_' || k || ' from \"m\"' AS imports FROM u")
def pa24(spark, sf_dir):
    return _javascript(spark, sf_dir).select("path", F.array_join("exports", ",").alias("exports"), F.array_join("imports", ",").alias("imports"))
