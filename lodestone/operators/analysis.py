"""Static analysis of units: findings by rules, design patterns, code smells, architecture, and metrics.

Every rule and pattern is an expression over a unit's own columns, so all of them
take one scan and no shuffle; only metrics that aggregate, and smells that count
edges, group or join. Units have the columns id, file_path, name, symbol_type,
content, parameters, line_start, line_end and doc. A null content says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.edges import unsent

#: (analysis, issue, severity, confidence, pattern). Java and RE2 read the patterns alike.
RULES = tuple(
    [("security", issue, "critical", 0.8, f"(?i){p}") for issue, ps in {
        "sql_injection": (r"execute\s*\(\s*[\x22'].*%.*[\x22']", r"cursor\.execute\s*\(\s*[\x22'].*\+.*[\x22']", r"query\s*\(\s*[\x22'].*\+.*[\x22']"),
        "command_injection": (r"os\.system\s*\(", r"subprocess\.call\s*\(", r"eval\s*\(", r"exec\s*\("),
        "hardcoded_secrets": tuple(rf"{w}\s*=\s*[\x22'][^\x22']+[\x22']" for w in ("password", "api_key", "secret", "token")),
        "path_traversal": tuple(rf"{w}\s*\(\s*[\x22'].*\.\." for w in ("open", "file", "read")),
    }.items() for p in ps]
    + [("performance", issue, "medium", 0.6, f"(?i){p}") for issue, ps in {
        "inefficient_loops": (r"for\s+\w+\s+in\s+range\s*\(\s*len\s*\(", r"while\s+.*\.pop\s*\(\s*0\s*\)"),
        "memory_leaks": (r"global\s+\w+", r"\w+\s*\[\s*\]\s*=.*\[\s*\]"),
        "slow_operations": (r"\.sort\s*\(\s*\)", r"regex\s*=\s*re\.compile"),
    }.items() for p in ps]
    + [("quality", "deep_nesting", "low", 0.6, r"\s{16,}")]
    + [("maintainability", "complex_expressions", "low", 0.5, r"\w+\s*[+\-*/]\s*\w+\s*[+\-*/]\s*\w+\s*[+\-*/]\s*\w+"), ("maintainability", "magic_numbers", "low", 0.5, r"\b[2-9][0-9]+\b")]
)
#: (analysis, issue, severity, confidence, header): rules on what follows a header up to the next line that isn't indented.
BODY_RULES = (
    ("quality", "long_function", "medium", 0.7, r"def\s+\w+\s*\([^)]*\)\s*:"),
    ("quality", "long_function", "medium", 0.7, r"function\s+\w+\s*\([^)]*\)\s*\{"),
    ("maintainability", "missing_documentation", "low", 0.8, r"def\s+\w+\s*\([^)]*\)\s*:"),
    ("maintainability", "missing_documentation", "low", 0.8, r"class\s+\w+\s*:"),
)
LONG = 50
_MARK = "\x01"


def match_lines(content: Column, pattern: str) -> Column:
    """Line numbers, from 1, at which the matches of a pattern start, in order."""
    pieces = F.split(F.regexp_replace(content, pattern, _MARK + "$0"), _MARK)
    newlines = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    before = F.slice(newlines, F.lit(1), F.size(pieces) - 1)
    return F.transform(before, lambda n, i: F.aggregate(F.slice(newlines, F.lit(1), i + 1), F.lit(1), lambda s, x: s + x))


def body(lines: Column, at: Column) -> Column:
    """The lines from one on up to the next that is neither blank nor indented."""
    after = F.filter(F.when(at < F.size(lines), F.sequence(at + 1, F.size(lines))).otherwise(F.array().cast("array<int>")), lambda j: F.element_at(lines, j).rlike(r"^\S"))
    end = F.coalesce(F.get(after, F.lit(0)), F.size(lines) + 1)
    return F.slice(lines, at, end - at)


def snippet(lines: Column, at: Column, around: int = 2) -> Column:
    """The lines around one."""
    first = F.greatest(F.lit(1), at - around)
    return F.array_join(F.slice(lines, first, at + around - first + 1), "\n")


def findings(units: DataFrame, analysis: str | None = None) -> DataFrame:
    """(id, file_path, analysis_type, issue, line_number, severity, confidence, snippet), one row a match; of one kind of analysis, or all."""
    lines = F.split("content", "\n")
    found = []
    for kind, issue, severity, confidence, pattern in RULES:
        if analysis in (None, kind):
            found.append((kind, issue, severity, confidence, match_lines(F.col("content"), pattern)))
    for kind, issue, severity, confidence, header in BODY_RULES:
        if analysis in (None, kind):
            if issue == "long_function":
                bad = lambda at: F.size(body(lines, at)) > LONG
            else:
                bad = lambda at: F.regexp_count(F.array_join(body(lines, at), "\n"), F.lit('"""')) < 2
            found.append((kind, issue, severity, confidence, F.filter(match_lines(F.col("content"), header), bad)))

    def rows_of(kind: str, issue: str, severity: str, confidence: float, at: Column) -> Column:
        said = [F.lit(x).alias(name) for name, x in (("analysis_type", kind), ("issue", issue), ("severity", severity), ("confidence", confidence))]
        return F.transform(at, lambda n: F.struct(n.alias("line_number"), *said))

    rows = F.flatten(F.array(*[rows_of(*f) for f in found]))
    some = units.where("coalesce(length(content), 0) > 0")
    return some.select("id", "file_path", "content", F.inline(rows)).select(
        "id", "file_path", "analysis_type", "issue", "line_number", "severity", "confidence", snippet(lines, F.col("line_number")).alias("snippet")
    )


def count_of(word: str, text: str = "c") -> str:
    """SQL that counts a substring, as Spark and DuckDB both read it."""
    return f"CAST((length({text}) - length(replace({text}, '{word}', ''))) / {len(word)} AS INT)"


_CLASS, _CALLABLE = "symbol_type = 'class'", "symbol_type IN ('function', 'method')"


def _any(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _all(text: str, *words: str) -> str:
    return "(" + " AND ".join(f"contains({text}, '{w}')" for w in words) + ")"


#: Design patterns as SQL over c (the content in lower case), n (the name in lower case) and symbol_type.
DESIGN = {
    "singleton": f"{_CLASS} AND {_all('c', 'def __init__(self', '__new__', 'instance')}",
    "factory": f"{_any('n', 'factory', 'create')} AND ({_any('c', 'def create', 'def build')} OR ({_all('c', 'if', 'return')} AND {_any('c', 'class', 'type')}))",
    "observer": f"({_CLASS} AND {_any('n', 'observer', 'listener')}) OR ({_CALLABLE} AND {_any('n', 'notify', 'update', 'subscribe')})",
    "strategy": f"{_CLASS} AND ({_any('n', 'strategy', 'algorithm')} OR {_all('c', 'def execute', 'context')})",
    "adapter": f"{_CLASS} AND ({_any('n', 'adapter')} OR ({_all('c', 'def __init__', 'self.')} AND {_any('c', 'wrap', 'adapt')}))",
    "decorator": f"{_any('n', 'decorator')} OR ({_all('c', 'def __init__', 'self.', 'component')} AND {_all('c', 'def', 'return self.')})",
    "command": f"{_any('n', 'command')} OR {_all('c', 'def execute', 'def undo')}",
}
#: Architecture by the unit's own text, and by f, the file's path in lower case.
ARCHITECTURE = {
    "layered": _any("f", "controller", "handler", "endpoint", "service", "business", "logic", "repository", "dao", "persistence", "model", "entity", "dto"),
    "mvc": _any("f", "controller", "view", "model"),
    "repository": f"{_any('n', 'repository', 'dao')} OR {_any('c', 'def save', 'def find', 'def delete')}",
    "service": f"{_any('n', 'service')} OR {_any('c', 'def calculate', 'def process', 'def validate')}",
    "controller": f"{_any('n', 'controller')} OR {_any('c', 'def get', 'def post', 'def put', 'def delete')}",
}
_ACCESS = f"({count_of('def get_')} + {count_of('def set_')})"
_WORDS = " + ".join(count_of(w) for w in "select insert update button window dialog file read write".split())
#: Smells that a unit's own text tells.
SMELLS = {
    "long_method": f"{_CALLABLE} AND length(content) - length(replace(content, chr(10), '')) >= {LONG}",
    "god_class": f"{_CLASS} AND {_WORDS} > 5",
    "data_class": f"{_CLASS} AND {count_of('def ')} > 0 AND {_ACCESS} * 10 > 7 * {count_of('def ')}",
    "lazy_class": f"{_CLASS} AND {count_of('def ')} - {_ACCESS} < 2",
}
#: Tags of a unit; large_class counts edges and is added by ``unit_patterns``.
TAGS = {
    "constructor_pattern": r"regexp_count(content, '(?s)class\\s+\\w+\\s*\\([^)]*\\)\\s*:.*def\\s+__init__') > 0",
    "interface_pattern": r"regexp_count(content, 'class\\s+\\w+\\s*\\(.*\\w+Interface.*\\)\\s*:') > 0",
    "exception_pattern": r"regexp_count(content, 'class\\s+\\w+\\s*\\(.*\\w+Exception.*\\)\\s*:') > 0",
    "singleton_pattern": r"regexp_count(content, 'def\\s+singleton\\s*\\(') > 0",
    "factory_pattern": r"regexp_count(content, 'def\\s+factory\\s*\\(') > 0",
    "observer_pattern": r"regexp_count(content, 'def\\s+observer\\s*\\(') > 0",
    "complex_conditional": f"{count_of('if ', 'content')} > 5",
    "nested_loops": f"{count_of('for ', 'content')} > 3",
}


def tagged(units: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(id, file_path, pattern): a row for each of the kinds that a unit is of."""
    rows = units.where("coalesce(length(content), 0) > 0").selectExpr("id", "file_path", "symbol_type", "content", "lower(content) AS c", "lower(name) AS n", "lower(file_path) AS f")
    tags = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in kinds.items()]))
    return rows.select("id", "file_path", F.explode(tags).alias("pattern"))


def many_members(edges: DataFrame, units: DataFrame, more_than: int) -> DataFrame:
    """(id, file_path) of classes with more than so many edges of containment."""
    large = edges.where("relation_type = 'contains'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return units.where(_CLASS).join(unsent(large), "id", "left_semi").select("id", "file_path")


def unit_patterns(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file_path, pattern): the tags of units."""
    return tagged(units, TAGS).union(many_members(edges, units, 10).withColumn("pattern", F.lit("large_class")))


def feature_envy(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, file_path) of units whose calls go to other files more than twice as often as to their own."""
    a, b = units.select(F.col("id").alias("src"), "file_path"), units.select(F.col("id").alias("dst"), F.col("file_path").alias("to"))
    called = edges.where("relation_type = 'calls'").select("src", "dst").join(unsent(a), "src").join(unsent(b), "dst", "left")
    own = F.count(F.when(F.col("to") == F.col("file_path"), 1))
    return called.groupBy(F.col("src").alias("id"), "file_path").agg(own.alias("own"), F.count("*").alias("n")).where("n - own > 2 * own").select("id", "file_path")


def smells(units: DataFrame, edges: DataFrame, duplicated: DataFrame, shotgun: DataFrame) -> DataFrame:
    """(id, file_path, pattern): all smells of units. duplicated, shotgun: rows with the ids of those."""
    out = tagged(units, SMELLS).union(many_members(edges, units, 20).withColumn("pattern", F.lit("large_class"))).union(feature_envy(units, edges).withColumn("pattern", F.lit("feature_envy")))
    places = units.select("id", "file_path")
    for name, ids in (("duplicated_code", duplicated), ("shotgun_surgery", shotgun)):
        out = out.union(places.join(unsent(ids.select("id").distinct()), "id", "left_semi").withColumn("pattern", F.lit(name)))
    return out


#: Metrics as aggregates in SQL that Spark and DuckDB read alike, over the units' columns and lines = its number of lines.
_X = "(" + " + ".join(f"{n} * {count_of(w, 'content')}" for w, n in {"if ": 1, "for ": 1, "while ": 1, "try ": 2}.items()) + ")"
_CYCLO = "(1 + " + " + ".join(count_of(w, "content") for w in ("if ", "for ", "while ", "and ", "or ")) + ")"
METRICS = {
    "basic": {
        "total_units": "count(*)", "total_files": "count(DISTINCT file_path)", "total_symbols": "count(name)", **{f"{k}_count": f"sum(CASE WHEN symbol_type = '{k}' THEN 1 ELSE 0 END)" for k in ("class", "method", "function", "variable")},
        "avg_symbols_per_file": "round(count(name) * 1e0 / count(DISTINCT file_path), 6)",
    },
    "complexity": {
        "avg_complexity": f"round(avg({_X} + {count_of('elif ', 'content')} + {count_of('except ', 'content')}), 6)", "max_complexity": f"max({_X} + {count_of('elif ', 'content')} + {count_of('except ', 'content')})",
        "avg_cyclomatic": f"round(avg({_CYCLO}), 6)", "max_cyclomatic": f"max({_CYCLO})", "total_cyclomatic": f"sum({_CYCLO})",
    },
    "size": {
        **{f"{f}_size_bytes": (f"round({f}(length(content)), 6)" if f == "avg" else f"{f}(length(content))") for f in ("avg", "max", "min", "sum")}, "median_size_bytes": "CAST(median(length(content)) AS DOUBLE)",
        **{f"{f}_lines": (f"round({f}(lines), 6)" if f == "avg" else f"{f}(lines)") for f in ("avg", "max", "min", "sum")}, "median_lines": "CAST(median(lines) AS DOUBLE)",
    },
    "maintainability": {
        "documentation_coverage": f"round(avg(CASE WHEN symbol_type IN ('class', 'method', 'function') THEN CASE WHEN doc IS NOT NULL THEN 1e0 ELSE 0e0 END END), 6)",
        "comment_ratio": "round(sum(comments) * 1e0 / (sum(comments) + sum(codes)), 6)",
        "avg_function_length": f"round(avg(CASE WHEN {_CALLABLE} THEN lines END), 6)", "max_function_length": f"max(CASE WHEN {_CALLABLE} THEN lines END)", "long_functions": f"sum(CASE WHEN {_CALLABLE} AND lines > {LONG} THEN 1 ELSE 0 END)",
        "avg_parameters": "round(avg(CASE WHEN n_params > 0 THEN n_params END), 6)", "max_parameters": "max(CASE WHEN n_params > 0 THEN n_params END)", "complex_functions": "sum(CASE WHEN n_params > 5 THEN 1 ELSE 0 END)",
    },
    "analyzer": {"total_units": "count(*)", "avg_complexity": f"round(avg({_X}), 6)", "max_complexity": f"max({_X})", "avg_length": "round(avg(length(content)), 6)"},
}


def measured(units: DataFrame) -> DataFrame:
    """``units`` with lines, comments, codes and n_params: what the metrics are made of."""
    lines = F.split("content", "\n")
    bare = F.transform(lines, lambda x: F.trim(x))
    comment = lambda x: x.startswith("#") | x.startswith("//") | x.startswith("/*")
    return units.withColumns(
        {
            "lines": F.size(lines), "comments": F.size(F.filter(bare, comment)), "codes": F.size(F.filter(bare, lambda x: ~comment(x) & (x != "") & ~x.startswith("*"))), "n_params": F.size("parameters"),
        }
    )


def metrics(units: DataFrame, kind: str, by: str | None = None) -> DataFrame:
    """The metrics of a kind in one row, or in a row for each value of a column."""
    values = [F.expr(x).alias(name) for name, x in METRICS[kind].items()]
    rows = measured(units)
    return rows.groupBy(by).agg(*values) if by else rows.agg(*values)


def coupling_metrics(units: DataFrame, edges: DataFrame, by_file: DataFrame) -> DataFrame:
    """Coupling in one row: edges by unit, and what files need of each other (by_file: file_path, afferent, efferent)."""
    per_unit = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("relation_type") == "imports", 1)).alias("i"))
    own = units.select("id").join(unsent(per_unit), "id", "left").na.fill(0, ["n", "i"])
    one = own.agg(F.round(F.avg("n"), 6).alias("avg_coupling"), F.max("n").alias("max_coupling"), F.sum("n").alias("total_coupling"), F.sum("i").alias("total_imports"))
    two = by_file.agg(
        F.round(F.avg("afferent"), 6).alias("avg_afferent"), F.max("afferent").alias("max_afferent"), F.round(F.avg("efferent"), 6).alias("avg_efferent"), F.max("efferent").alias("max_efferent"),
        F.round(F.coalesce(F.try_divide(F.sum("efferent"), F.sum("afferent") + F.sum("efferent")), F.lit(0.0)), 6).alias("instability"),
    )
    return one.crossJoin(F.broadcast(two))  # one row each


def cohesion(units: DataFrame, members: DataFrame) -> DataFrame:
    """(id, lcom) of classes: pairs of methods that share no attribute of self, over all pairs; 0 with fewer than two methods. members: (src, dst).

    Pairs that share one are counted by an equi-join on (class, attribute), and the rest is arithmetic.
    """
    methods = units.where("symbol_type = 'method'").join(unsent(members.select(F.col("src").alias("class"), F.col("dst").alias("id"))), "id")
    size = methods.groupBy("class").agg(F.count("*").alias("m"))
    said = methods.select("class", "id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"self\.(\w+)"), F.lit(1)))).alias("a"))
    meet = said.join(unsent(said.withColumnRenamed("id", "other")), ["class", "a"]).where("id < other").select("class", "id", "other").distinct().groupBy("class").agg(F.count("*").alias("shared"))
    c = units.where(_CLASS).select("id").join(unsent(size.withColumnRenamed("class", "id")), "id", "left").join(unsent(meet.withColumnRenamed("class", "id")), "id", "left")
    pairs = F.col("m") * (F.col("m") - 1) / 2
    return c.select("id", F.when(F.col("m") > 1, (pairs - F.coalesce("shared", F.lit(0))) / pairs).otherwise(0.0).alias("lcom"))


#: The quality score and its ratings, over the metrics' names, in SQL that both engines read.
QUALITY = """round(greatest(0.0, least(1.0, 0.3 * greatest(0.0, 1.0 - avg_complexity / 20.0) + 0.2 * greatest(0.0, least(1.0, 1.0 - abs(avg_size_bytes - 1000) / 2000)) + 0.2 * greatest(0.0, 1.0 - avg_coupling / 10.0)
 + 0.15 * (1.0 - avg_lcom) + 0.15 * (documentation_coverage + comment_ratio) / 2.0)), 6)"""
RATINGS = {
    "quality_rating": "CASE WHEN overall_quality >= 0.8 THEN 'Excellent' WHEN overall_quality >= 0.6 THEN 'Good' WHEN overall_quality >= 0.4 THEN 'Fair' ELSE 'Poor' END",
    "complexity_rating": "CASE WHEN avg_complexity <= 5 THEN 'Low' WHEN avg_complexity <= 10 THEN 'Medium' WHEN avg_complexity <= 20 THEN 'High' ELSE 'Very High' END",
    "size_rating": "CASE WHEN avg_size_bytes <= 500 THEN 'Small' WHEN avg_size_bytes <= 2000 THEN 'Medium' WHEN avg_size_bytes <= 5000 THEN 'Large' ELSE 'Very Large' END",
    "documentation_rating": "CASE WHEN documentation_coverage >= 0.8 THEN 'Well Documented' WHEN documentation_coverage >= 0.5 THEN 'Moderately Documented' ELSE 'Poorly Documented' END",
}


def all_metrics(units: DataFrame, edges: DataFrame, by_file: DataFrame, members: DataFrame) -> DataFrame:
    """All metrics and the overall quality in one row."""
    lcom = cohesion(units, members).agg(F.round(F.avg("lcom"), 6).alias("avg_lcom"), F.round(F.max("lcom"), 6).alias("max_lcom"), F.round(F.min("lcom"), 6).alias("min_lcom"))
    own = measured(units).agg(*[F.expr(x).alias(name) for kind in ("basic", "complexity", "size", "maintainability") for name, x in METRICS[kind].items()])
    row = own.crossJoin(F.broadcast(coupling_metrics(units, edges, by_file))).crossJoin(F.broadcast(lcom))  # one row each
    return row.withColumn("overall_quality", F.expr(QUALITY))
