"""Queries of the rules, the patterns and the metrics, over the code corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import analysis as A
from lodestone.operators import edges as E
from lodestone.operators import ranking as R
from lodestone.operators.durable import written
from lodestone.plans.code import U, files, units
from lodestone.plans.edges import COUPLED, EXTRACT, JN10, _extracted, _q
from lodestone.plans.registry import register

_MARKED = "string_split(regexp_replace(content, '{p}', chr(1) || '\\0', 'g'), chr(1))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def _lines_sql(kind: str, issue: str, severity: str, confidence: float, pattern: str, extra: str = "") -> str:
    pieces = _MARKED.format(p=_quoted(pattern))
    line = "1 + length(array_to_string(pieces[:i], '')) - length(replace(array_to_string(pieces[:i], ''), chr(10), ''))"
    return f"SELECT id, content, '{kind}' AS analysis_type, '{issue}' AS issue, '{severity}' AS severity, {confidence}::DOUBLE AS confidence, {line} AS line_number FROM (SELECT id, content, pieces, unnest(generate_series(1, len(pieces) - 1)) AS i FROM (SELECT id, content, {pieces} AS pieces FROM u))"


_BODY = "array_to_string(lines[line_number:coalesce(list_filter(generate_series(line_number + 1, len(lines)), lambda j: regexp_matches(lines[j], '^\\S'))[1], len(lines) + 1) - 1], chr(10))"


def _body_sql(kind, issue, severity, confidence, header) -> str:
    test = f"length(b) - length(replace(b, chr(10), '')) + 1 > {A.LONG}" if issue == "long_function" else "length(b) - length(replace(b, '\"\"\"', '')) < 6"
    inner = _lines_sql(kind, issue, severity, confidence, header)
    return f"SELECT id, content, analysis_type, issue, severity, confidence, line_number FROM (SELECT *, {_BODY} AS b FROM (SELECT *, string_split(content, chr(10)) AS lines FROM ({inner}))) WHERE {test}"


def _findings_sql(kind: str | None) -> str:
    parts = [_lines_sql(*r) for r in A.RULES if kind in (None, r[0])] + [_body_sql(*r) for r in A.BODY_RULES if kind in (None, r[0])]
    return " UNION ALL ".join(parts)


def _finding_query(name: str, kind: str):
    @register(name, f"WITH {U} SELECT id, issue, severity, confidence, line_number::INT AS line_number, count(*) AS matches FROM ({_findings_sql(kind)}) GROUP BY ALL")
    def query(spark, sf_dir):
        return A.findings(units(spark, sf_dir), kind).groupBy("id", "issue", "severity", "confidence", "line_number").agg(F.count("*").alias("matches"))


for _name, _kind in (("an02_security", "security"), ("an03_quality", "quality"), ("an04_performance", "performance"), ("an05_maintainability", "maintainability")):
    _finding_query(_name, _kind)


@register("an01_all_findings", f"WITH {U} SELECT analysis_type, severity, count(*) AS findings, count(DISTINCT id) AS units FROM ({_findings_sql(None)}) GROUP BY ALL")
def an01_all(spark, sf_dir):
    """All kinds of analysis in one scan (rows 1 and 9)."""
    return A.findings(units(spark, sf_dir)).groupBy("analysis_type", "severity").agg(F.count("*").alias("findings"), F.countDistinct("id").alias("units"))


@register("pr29_snippets", f"WITH {U} SELECT id, line_number::INT AS line_number, array_to_string(string_split(content, chr(10))[greatest(1, line_number - 2):line_number + 2], chr(10)) AS snippet FROM ({_findings_sql('security')})")
def pr29(spark, sf_dir):
    """Line numbers and the lines around each finding (rows 28 and 29)."""
    return A.findings(units(spark, sf_dir), "security").select("id", "line_number", "snippet")


_C = f"low AS (SELECT *, lower(content) AS c, lower(name) AS n, lower(file_path) AS f FROM u)"


def _tag_sql(kinds: dict[str, str], regex: bool = False) -> str:
    def duck(test: str) -> str:
        if "regexp_count" not in test:
            return test
        return f"regexp_matches(content, {test[test.index(chr(39)) : test.rindex(chr(39)) + 1]})".replace("\\\\", "\\")

    return " UNION ALL ".join(f"SELECT id, '{name}' AS pattern FROM low WHERE length(content) > 0 AND ({duck(test)})" for name, test in kinds.items())


def _tag_query(name: str, kinds: dict[str, str], doc: str):
    @register(name, f"WITH {U}, {_C} {_tag_sql(kinds)}")
    def query(spark, sf_dir):
        return A.tagged(units(spark, sf_dir), kinds).select("id", "pattern")

    query.__doc__ = doc


_tag_query("pt22_design_patterns", A.DESIGN, "Rows 2 to 8 and 22.")
_tag_query("pt24_architecture", A.ARCHITECTURE, "Rows 17 to 21 and 24.")

_LARGE = "SELECT id, 'large_class' AS pattern FROM u WHERE symbol_type = 'class' AND (SELECT count(*) FROM x WHERE src = id AND relation_type = 'contains') > {n}"
_ENVY = "SELECT id, 'feature_envy' AS pattern FROM (SELECT a.id, count(*) FILTER (b.file_path = a.file_path) AS own, count(*) AS n FROM x JOIN u a ON a.id = x.src LEFT JOIN u b ON b.id = x.dst WHERE relation_type = 'calls' GROUP BY a.id) WHERE n - own > 2 * own"
_DUP = "SELECT DISTINCT id, 'duplicated_code' AS pattern FROM (SELECT a.id, b.id AS other FROM sh a JOIN (SELECT DISTINCT id, h FROM sh) b ON a.h = b.h AND a.id <> b.id GROUP BY 1, 2 HAVING count(*) > 2)"
_SHOT = "SELECT b.id, 'shotgun_surgery' AS pattern FROM x JOIN u a ON a.id = x.src JOIN u b ON b.id = x.dst WHERE b.symbol_type = 'class' AND a.file_path <> b.file_path GROUP BY b.id HAVING count(DISTINCT a.file_path) > 5"
_SH = "sh AS (SELECT id, i AS at, md5(array_to_string(lines[i:i + 3], chr(10))) AS h FROM (SELECT id, string_split(content, chr(10)) AS lines FROM u), unnest(generate_series(1, len(lines) - 3)) AS g(i))"


@register("an06_unit_patterns", _q(*EXTRACT, _C) + f"{_tag_sql(A.TAGS)} UNION ALL {_LARGE.format(n=10)}")
def an06(spark, sf_dir):
    return A.unit_patterns(units(spark, sf_dir), _extracted(spark, sf_dir)).select("id", "pattern")


@register("an07_units_by_pattern", _q(*EXTRACT, _C) + f"SELECT pattern, count(*) AS units, min(id) AS first, max(id) AS last FROM ({_tag_sql(A.TAGS)} UNION ALL {_LARGE.format(n=10)}) GROUP BY pattern")
def an07(spark, sf_dir):
    return an06(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("units"), F.min("id").alias("first"), F.max("id").alias("last"))


def _smells(spark, sf_dir):
    u, x = units(spark, sf_dir), written(_extracted(spark, sf_dir))
    a, b = u.select(F.col("id").alias("src"), F.col("file_path").alias("from")), u.where("symbol_type = 'class'").select("id", F.col("id").alias("dst"), "file_path")
    shotgun = x.join(E.unsent(b), "dst").join(E.unsent(a), "src").where(F.col("from") != F.col("file_path")).groupBy("id").agg(F.countDistinct("from").alias("n")).where("n > 5")
    return A.smells(u, x, E.duplicated_ids(u), shotgun).select("id", "pattern")


_SMELL_SQL = f"{_tag_sql(A.SMELLS)} UNION ALL {_LARGE.format(n=20)} UNION ALL {_ENVY} UNION ALL {_DUP} UNION ALL {_SHOT}"


@register("pt23_code_smells", _q(*EXTRACT, _C, _SH) + _SMELL_SQL)
def pt23(spark, sf_dir):
    """Rows 9 to 16 and 23."""
    return _smells(spark, sf_dir)


@register("pt01_all_patterns", _q(*EXTRACT, _C, _SH) + f"SELECT pattern, count(*) AS units FROM ({_tag_sql(A.DESIGN)} UNION ALL {_tag_sql(A.ARCHITECTURE)} UNION ALL {_SMELL_SQL}) GROUP BY pattern")
def pt01(spark, sf_dir):
    u = units(spark, sf_dir)
    every = A.tagged(u, A.DESIGN | {f"{k}": v for k, v in A.ARCHITECTURE.items()}).select("id", "pattern").union(_smells(spark, sf_dir))
    return every.groupBy("pattern").agg(F.count("*").alias("units"))


_M = """mm AS (SELECT *, len(string_split(content, chr(10))) AS lines, len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: starts_with(x, '#') OR starts_with(x, '//') OR starts_with(x, '/*'))) AS comments,
 len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: NOT (starts_with(x, '#') OR starts_with(x, '//') OR starts_with(x, '/*') OR x = '' OR starts_with(x, '*')))) AS codes, CASE WHEN params = '' THEN 0 ELSE len(string_split(params, ',')) END AS n_params FROM u)"""


def _duck(name: str, x: str) -> str:
    """An aggregate with the type that Spark gives it."""
    return f"({x})::{'DOUBLE' if name.startswith(('avg', 'median')) or 'ratio' in name or 'coverage' in name else 'BIGINT'} AS {name}"


def _values(*kinds: str) -> str:
    return ", ".join(_duck(name, x) for kind in kinds for name, x in A.METRICS[kind].items())


def _metric_query(name: str, kind: str):
    @register(name, f"WITH {U}, {_M} SELECT {_values(kind)} FROM mm")
    def query(spark, sf_dir):
        return _plain(A.metrics(units(spark, sf_dir), kind))


def _plain(row):
    """Doubles and longs, whatever Spark made of the aggregates."""
    return row.select(*[F.col(c).cast("double" if c.startswith(("avg", "median", "max_lcom", "min_lcom", "instab", "overall")) or "ratio" in c or "coverage" in c else "long").alias(c) if k != "string" else F.col(c) for c, k in row.dtypes])


for _name, _kind in (("ag02_basic", "basic"), ("ag03_complexity_metrics", "complexity"), ("ag04_sizes", "size"), ("ag07_maintainability", "maintainability"), ("ag12_analyzer_metrics", "analyzer")):
    _metric_query(_name, _kind)


@register("ag09_metrics_by_file", f"WITH {U}, {_M} SELECT file_path, {_values('basic', 'complexity', 'size', 'maintainability')} FROM mm GROUP BY file_path")
def ag09(spark, sf_dir):
    rows = A.measured(units(spark, sf_dir))
    return _plain(rows.groupBy("file_path").agg(*[F.expr(x).alias(n) for k in ("basic", "complexity", "size", "maintainability") for n, x in A.METRICS[k].items()]))


_COUPLING = """cm AS (SELECT round(avg(n), 6)::DOUBLE AS avg_coupling, max(n)::BIGINT AS max_coupling, sum(n)::BIGINT AS total_coupling, sum(i)::BIGINT AS total_imports FROM (SELECT u.id, count(x.src) AS n, count(*) FILTER (relation_type = 'imports') AS i FROM u LEFT JOIN x ON x.src = u.id GROUP BY u.id)),
cf AS (SELECT round(avg(afferent), 6)::DOUBLE AS avg_afferent, max(afferent)::BIGINT AS max_afferent, round(avg(efferent), 6)::DOUBLE AS avg_efferent, max(efferent)::BIGINT AS max_efferent, round(sum(efferent) / (sum(afferent) + sum(efferent)), 6)::DOUBLE AS instability FROM w)"""
_LCOM = f"""mem AS ({JN10}), me AS (SELECT mem.src AS class, u.id, list_distinct(regexp_extract_all(content, 'self\\.(\\w+)', 1)) AS a FROM u JOIN mem ON mem.dst = u.id WHERE symbol_type = 'method'),
ms AS (SELECT class, count(*) AS n FROM me GROUP BY class), md AS (SELECT p.class, count(*) AS d FROM me p JOIN me q ON p.class = q.class AND p.id < q.id WHERE len(list_intersect(p.a, q.a)) = 0 GROUP BY 1),
lc AS (SELECT u.id, CASE WHEN n > 1 THEN coalesce(d, 0) / (n * (n - 1) / 2) ELSE 0 END::DOUBLE AS lcom FROM u LEFT JOIN ms ON ms.class = u.id LEFT JOIN md ON md.class = u.id WHERE symbol_type = 'class'),
lm AS (SELECT round(avg(lcom), 6)::DOUBLE AS avg_lcom, round(max(lcom), 6)::DOUBLE AS max_lcom, round(min(lcom), 6)::DOUBLE AS min_lcom FROM lc)"""


def _by_file(spark, sf_dir):
    return E.coupling(units(spark, sf_dir), _extracted(spark, sf_dir))


@register("ag05_coupling_metrics", _q(*EXTRACT, COUPLED, _COUPLING) + "SELECT * FROM cm, cf")
def ag05(spark, sf_dir):
    return _plain(A.coupling_metrics(units(spark, sf_dir), _extracted(spark, sf_dir), _by_file(spark, sf_dir)))


@register("ag06_cohesion", _q(_LCOM) + "SELECT id, round(lcom, 6) AS lcom FROM lc")
def ag06(spark, sf_dir):
    u = units(spark, sf_dir)
    return A.cohesion(u, E.class_members(u)).select("id", F.round("lcom", 6).alias("lcom"))


_EVERY = (*EXTRACT, COUPLED, _COUPLING, _LCOM, _M, f"am AS (SELECT {_values('basic', 'complexity', 'size', 'maintainability')} FROM mm)", f"aq AS (SELECT *, ({A.QUALITY})::DOUBLE AS overall_quality FROM am, cm, cf, lm)")


def _every(spark, sf_dir):
    u, x = units(spark, sf_dir), written(_extracted(spark, sf_dir))
    return _plain(A.all_metrics(u, x, E.coupling(u, x), E.class_members(u)))


@register("ag01_all_metrics", _q(*_EVERY) + "SELECT * FROM aq")
def ag01(spark, sf_dir):
    """All metrics and the quality score (rows 1 and 8)."""
    return _every(spark, sf_dir)


@register("ag11_ratings", _q(*_EVERY) + f"SELECT {', '.join(f'{x} AS {n}' for n, x in A.RATINGS.items())} FROM aq")
def ag11(spark, sf_dir):
    return _every(spark, sf_dir).select(*[F.expr(x).alias(n) for n, x in A.RATINGS.items()])


@register("an08_complexity", f"WITH {U}, {_M} SELECT symbol_type, {_values('analyzer')} FROM mm GROUP BY symbol_type")
def an08(spark, sf_dir):
    rows = A.measured(units(spark, sf_dir))
    return _plain(rows.groupBy("symbol_type").agg(*[F.expr(x).alias(n) for n, x in A.METRICS["analyzer"].items()]))


_ORDER = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"


@register("rk17_by_severity", f"WITH {U} SELECT id, issue, severity, line_number::INT AS line_number FROM ({_findings_sql(None)}) ORDER BY {_ORDER}, id, line_number, issue LIMIT 100")
def rk17(spark, sf_dir):
    return R.by_severity(A.findings(units(spark, sf_dir)).select("id", "issue", "severity", "line_number"))
