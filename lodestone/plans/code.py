"""A corpus of source code made of the ``part`` table, in SQL that Spark and DuckDB read alike.

The test tables hold no code. Every part becomes a symbol unit of a file of its
brand: classes with the methods, functions and variables in their lines. Both
engines make the same rows, so that every operator on code can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.blocks import tasks

_NL = "chr(10)"
_CLASS = f"""'class ' || name || '(Plain_' || (k * 7 % 500) || ', BaseInterface):' || {_NL} || '    \"\"\"Holds ' || doc || '\"\"\"' || {_NL} || '    def __init__(self, component):' || {_NL} || '        self.component = component' || {_NL} ||
CASE k % 9 WHEN 0 THEN '    def __new__(cls):' || {_NL} || '        return cls._instance' || {_NL}
 WHEN 1 THEN '    def create(self, kind):' || {_NL} || '        if kind: return type(kind)' || {_NL}
 WHEN 2 THEN '    def execute(self, context):' || {_NL} || '        return self.component.run()' || {_NL} || '    def undo(self): pass' || {_NL}
 WHEN 3 THEN '    def get_a(self): pass' || {_NL} || '    def set_a(self, a): pass' || {_NL} || '    def get_b(self): pass' || {_NL} || '    def set_b(self, b): pass' || {_NL} || '    def get_c(self): pass' || {_NL}
 WHEN 4 THEN '    def save(self, row):' || {_NL} || '        insert(row); update(row); select(row); read(row); write(row); file(row)' || {_NL}
 WHEN 5 THEN '    def validate(self):' || {_NL} || '        return self.wrap(context)' || {_NL} || '    def execute(self): pass' || {_NL}
 WHEN 6 THEN '    def post(self):' || {_NL} || '        open("../x' || k || '")' || {_NL}
 ELSE '' END"""
_METHOD = f"""'    def ' || name || '(self, x, y=' || (k % 90) || '):' || {_NL} || '        self.count = self.total_' || (k % 3) || ' + fn_' || (k * 3 % 300) || '(x) + fn_' || (k * 3 % 300) || ' (y)' || {_NL} ||
'        for i in range(len(x)):' || {_NL} || '            if x[i] and y or not x: self.emit_' || (k % 4) || '(i)' || {_NL} || repeat('        y = y + 1' || {_NL}, CAST(k % 60 AS INT)) || CASE WHEN k % 8 = 1 THEN '        password = "pw' || k || '"' || {_NL} ELSE '' END"""
_FUNCTION = f"""'def ' || name || '(a, b, c=1):' || {_NL} || CASE k % 3 WHEN 0 THEN '    \"\"\"' || doc || '\"\"\"' || {_NL} WHEN 1 THEN '    # ' || doc || {_NL} ELSE '' END || '    import run_' || (k % 200) || {_NL} || '    x = fn_' || (k * 11 % 300) || '(a) + other.run_' || (k * 5 % 200) || '(b) * 37 + ' || (k % 500) || {_NL} ||
'    try:' || {_NL} || '        return Plain_' || (k * 13 % 500) || '(x)' || {_NL} || '    except ValueError:' || {_NL} || '                    raise' || {_NL} || CASE WHEN k % 7 = 3 THEN '    os.system("ls")' || {_NL} || '    global LIMIT_' || (k - 1) || {_NL} ELSE '' END"""

#: CTEs b and n: the units without what makes them long.
_SHORT = f"""b AS (SELECT CAST(p_partkey AS BIGINT) AS k, 'src/' || CASE CAST(p_size AS INT) % 4 WHEN 0 THEN 'models' WHEN 1 THEN 'views' WHEN 2 THEN 'handlers' ELSE 'core' END || '/' || lower(replace(p_brand, '#', '_')) || '.py' AS file_path, p_name AS doc,
 row_number() OVER (PARTITION BY p_brand, CAST(p_size AS INT) % 4 ORDER BY p_partkey) AS r FROM part),
n AS (SELECT k, file_path, doc, 10 * r AS line_start, CASE WHEN (r - 1) % 5 = 0 THEN 10 * r + 49 ELSE 10 * r + 8 END AS line_end,
 CASE (r - 1) % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'method' WHEN 3 THEN 'function' ELSE 'variable' END AS symbol_type,
 CASE (r - 1) % 5 WHEN 0 THEN (CASE k % 12 WHEN 0 THEN 'WidgetFactory_' WHEN 1 THEN 'EventListener_' WHEN 2 THEN 'OrderService_' WHEN 3 THEN 'UserRepository_' WHEN 4 THEN 'PageController_' WHEN 5 THEN 'SortStrategy_'
  WHEN 6 THEN 'SizeAdapter_' WHEN 7 THEN 'TextDecorator_' WHEN 8 THEN 'UndoCommand_' ELSE 'Plain_' END) || k
  WHEN 1 THEN 'run_' || (k % 200) WHEN 2 THEN (CASE WHEN k % 3 = 0 THEN 'update_' ELSE 'run_' END) || (k % 200) WHEN 3 THEN 'fn_' || (k % 300) ELSE (CASE WHEN k % 2 = 0 THEN 'LIMIT_' ELSE 'total_' END) || k END AS name FROM b)"""
_LONG = f"""SELECT k, 'u' || k AS id, file_path, symbol_type, name, line_start, line_end,
 CASE symbol_type WHEN 'method' THEN 'self,x,y' WHEN 'function' THEN 'a,b,c' ELSE '' END AS params, CASE WHEN symbol_type = 'class' OR (symbol_type = 'function' AND k % 3 = 0) THEN doc END AS doc,
 CASE symbol_type WHEN 'class' THEN {_CLASS} WHEN 'method' THEN {_METHOD} WHEN 'function' THEN {_FUNCTION} ELSE name || ' = ' || (k * 37 % 1000) || {_NL} END AS content FROM n"""
#: CTEs b and u. u(k, id, file_path, symbol_type, name, line_start, line_end, params, doc, content): symbol units; k orders them.
U = f"{_SHORT},\nu AS ({_LONG})"

#: CTE f(file_path, id, content): the files, whose text imports two of their own units' neighbours; needs u.
FILES = f"""f AS (SELECT file_path, 'file:' || file_path AS id, 'import os' || {_NL} || 'from core.base import fn_' || (min(k) % 300) || ', run_' || (max(k) % 200) || {_NL} || 'from views import Plain_' || (max(k) * 3 % 500) || {_NL} || 'import fn_' || (max(k) % 300) || {_NL} AS content FROM u GROUP BY file_path)"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("FROM part", "FROM {part}"), part=part)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbol units, with their parameters as an array."""
    from pyspark.sql import functions as F

    # spread while they are short: the tasks that their bytes ask for are few, and every text is made and read in one
    short = _sql(spark, sf_dir, f"WITH {_SHORT} SELECT * FROM n")
    u = spark.sql(_LONG.replace("{", "{{").replace("}", "}}").replace("FROM n", "FROM {n}"), n=short.repartition(tasks(short), "k"))
    return u.withColumn("parameters", F.when(F.col("params") == "", F.array().cast("array<string>")).otherwise(F.split("params", ","))).drop("params")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file units."""
    return _sql(spark, sf_dir, f"WITH {U}, {FILES} SELECT * FROM f")
