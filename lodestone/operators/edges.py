"""Relationship extraction: occurrences of names in content, joined to the symbols that bear them.

Content is looked at once per kind of relationship, as an explode of all matches;
names meet symbols by an equi-join. A name that several units bear stands for the last.
Units have the columns id, file_path, name, symbol_type, content, line_start,
line_end and k, which orders them. A null or empty content says nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import blocks as B
from lodestone.operators.durable import written

IDENTIFIER = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b"
CALL = r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
BASES = r"class\s+\w+\s*\(([^)]+)\)"
IMPORT = r"import\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*)"
FROM = r"from\s+[a-zA-Z_][a-zA-Z0-9_]*(?:\.[a-zA-Z_][a-zA-Z0-9_]*)*\s+import\s+([a-zA-Z_][a-zA-Z0-9_]*(?:\s*,\s*[a-zA-Z_][a-zA-Z0-9_]*)*)"
NOT_CALLED = "if for while switch return print len range".split()
NOT_CALLED_EITHER = [*NOT_CALLED, *"str int float list dict set".split()]
RESERVED = (
    "if else elif for while break continue def class return yield import from as try except finally with pass global nonlocal and or not in is lambda None True False"
).split()
RESERVED_EITHER = [*RESERVED, "self", "cls"]


def matches(content: Column, pattern: str) -> Column:
    """All first groups of a pattern, repeats kept."""
    return F.regexp_extract_all(F.coalesce(content, F.lit("")), F.lit(pattern), F.lit(1))


def unsent(df: DataFrame) -> DataFrame:
    """``df``, which no join is to broadcast: it grows with the units, and its size is guessed too low, by the columns its texts are made of."""
    return df.hint("merge")


def symbols(units: DataFrame) -> DataFrame:
    """(name, target, target_type, target_file): the last unit of each name."""
    last = F.max(F.struct("k", "id", "symbol_type", "file_path"))
    return units.where("name is not null").groupBy("name").agg(last.alias("s")).select("name", F.col("s.id").alias("target"), F.col("s.symbol_type").alias("target_type"), F.col("s.file_path").alias("target_file"))


def named(units: DataFrame, names: Column, known: DataFrame, *keep: str) -> DataFrame:
    """A row for each name in an array column that a symbol bears, other than the unit itself."""
    said = units.select("id", *keep, F.explode(names).alias("name"))
    return said.join(unsent(known), "name").where(F.col("id") != F.col("target"))


def calls(units: DataFrame) -> DataFrame:
    """(src, dst): an edge for every call in a function or method, as often as it occurs."""
    some = units.where(F.col("symbol_type").isin("function", "method"))
    found = F.filter(matches(F.col("content"), CALL), lambda n: ~n.isin(NOT_CALLED))
    return named(some, found, symbols(units)).select(F.col("id").alias("src"), F.col("target").alias("dst"))


def class_methods(units: DataFrame) -> DataFrame:
    """(src, dst): classes and the methods of their file; as many as the product of both."""
    c, m = _classes(units), _methods(units)
    return B.pairs(c, m, "file_path", "src", "dst").select("src", "dst")


def _classes(units: DataFrame) -> DataFrame:
    return units.where("symbol_type = 'class'").select(F.col("id").alias("src"), "file_path")


def _methods(units: DataFrame) -> DataFrame:
    return units.where("symbol_type = 'method'").select(F.col("id").alias("dst"), "file_path")


def imported(content: Column) -> Column:
    """Distinct names that a text imports; lists of names are split."""
    listed = F.flatten(F.transform(matches(content, FROM), lambda x: F.split(x, r"\s*,\s*")))
    return F.array_distinct(F.filter(F.transform(F.concat(matches(content, IMPORT), listed), lambda x: F.trim(x)), lambda x: x != ""))


def file_imports(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, weight, import_type, imported_from): files and the symbols that they import."""
    found = named(files, imported(F.col("content")), symbols(units), "content")
    line = F.get(F.filter(F.split("content", "\n"), lambda x: F.contains(x, F.col("name")) & x.contains("import")), F.lit(0))
    kind = F.when(F.contains("content", F.concat(F.lit("import "), F.col("name"))), "direct").otherwise("unknown")
    return found.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit(0.8).alias("weight"), kind.alias("import_type"), F.coalesce(F.trim(line), F.lit("")).alias("imported_from"))


def file_symbols(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, symbol_type): files and the symbols in them."""
    return units.join(files.select(F.col("id").alias("src"), "file_path"), "file_path").select("src", F.col("id").alias("dst"), "symbol_type")


def references(units: DataFrame) -> DataFrame:
    """(src, dst): an edge for every mention of a symbol, as often as it occurs."""
    found = F.filter(matches(F.col("content"), IDENTIFIER), lambda n: ~n.isin(RESERVED) & (F.length(n) > 1))
    return named(units, found, symbols(units)).select(F.col("id").alias("src"), F.col("target").alias("dst"))


def weighed_calls(units: DataFrame) -> DataFrame:
    """(src, dst, count, weight, caller_type, callee_type): calls of functions and methods but those of their own name."""
    found = F.filter(matches(F.col("content"), CALL), lambda n: ~n.isin(NOT_CALLED_EITHER) & (n != F.col("name")))
    some = units.where(F.col("symbol_type").isin("function", "method")).withColumn("called", found)
    edges = _weighed(some, F.col("called"), units, 0.3, 0.1)
    return edges.select("src", "dst", "count", "weight", F.col("symbol_type").alias("caller_type"), F.col("target_type").alias("callee_type"))


def _weighed(some: DataFrame, names: Column, units: DataFrame, base: float, each: float) -> DataFrame:
    said = some.select("id", "symbol_type", F.explode(names).alias("name")).groupBy("id", "symbol_type", "name").agg(F.count("*").alias("count"))
    found = said.join(unsent(symbols(units)), "name").where(F.col("id") != F.col("target"))
    return found.select(
        F.col("id").alias("src"), F.col("target").alias("dst"), "name", "count", F.least(F.lit(1.0), F.round(base + each * F.col("count"), 6)).alias("weight"), "symbol_type", "target_type"
    )


def _mentions(units: DataFrame) -> Column:
    return F.filter(matches(F.col("content"), IDENTIFIER), lambda n: ~n.isin(RESERVED_EITHER) & (F.length(n) > 1))


def contexts(content: Column, name: Column) -> Column:
    """The first three lines that mention a name, each with the lines around it."""
    lines = F.split(content, "\n")
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.contains(F.element_at(lines, i), name))
    around = F.transform(at, lambda i: F.trim(F.array_join(F.slice(lines, F.greatest(i - 1, F.lit(1)), F.when(i > 1, 3).otherwise(2)), "\n")))
    return F.slice(around, 1, 3)


def weighed_references(units: DataFrame) -> DataFrame:
    """(src, dst, count, weight, contexts): mentions of symbols, with up to three places."""
    edges = _weighed(units, _mentions(units), units, 0.2, 0.05)
    text = units.select(F.col("id").alias("src"), "content")
    return edges.join(unsent(text), "src").select("src", "dst", "count", "weight", contexts(F.col("content"), F.col("name")).alias("contexts"))


def usages(units: DataFrame) -> DataFrame:
    """(src, dst, count, weight, usage_type): uses of symbols, by how they are used."""
    edges = _weighed(units, _mentions(units), units, 0.4, 0.1)
    text = units.select(F.col("id").alias("src"), "content")
    kind = (
        F.when(F.contains("content", F.concat("name", F.lit("("))), "function_call").when(F.contains("content", F.concat(F.lit("("), F.col("name"), F.lit(")"))), "type_annotation").otherwise("reference")
    )
    return edges.join(unsent(text), "src").select("src", "dst", "count", "weight", kind.alias("usage_type"))


def bases(content: Column) -> Column:
    """Distinct names in the headers of classes."""
    return F.array_distinct(F.flatten(F.transform(matches(content, BASES), lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y)))))


def inheritance(units: DataFrame) -> DataFrame:
    """(src, dst, base): classes and the known classes that they derive from, themselves too where they say so."""
    said = units.where("symbol_type = 'class'").select("id", F.explode(bases(F.col("content"))).alias("name"))
    return said.join(unsent(symbols(units)), "name").select(F.col("id").alias("src"), F.col("target").alias("dst"), F.col("name").alias("base"))


def class_members(units: DataFrame) -> DataFrame:
    """(src, dst, containment_type): classes and what lies in their lines.

    A class of up to 2 ** n lines is in one or two bins of 2 ** n lines; a unit looks
    for classes in its own bin of every size that there is. So both meet by an
    equi-join, and most pairs that do are answers. Units that end before they begin
    are held against all classes of their file.
    """
    a, b, p, q = (F.col(x).cast("long") for x in ("a", "b", "line_start", "line_end"))
    c = units.where("symbol_type = 'class'").select(F.col("id").alias("src"), "file_path", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    c = c.withColumn("size", F.when(b > a, F.length(F.bin(b - a - 1))))
    sizes = F.broadcast(c.agg(F.collect_set("size").alias("sizes")))  # one row
    bins = lambda size, first, last: F.transform(F.sequence(F.expr(f"shiftright({first}, {size})"), F.expr(f"shiftright({last}, {size})")), lambda x: F.struct(F.col(size).alias("size"), x.alias("bin")))
    any_file = F.array(F.struct(F.lit(-1).alias("size"), F.lit(0).cast("long").alias("bin")))
    c = c.withColumns({"first": a + 1, "last": b}).select("src", "file_path", "a", "b", F.inline(F.concat(any_file, F.when(F.col("size").isNotNull(), bins("size", "first", "last")).otherwise(F.array().cast("array<struct<size:int,bin:bigint>>")))))
    own = F.when(q < p, any_file).otherwise(F.transform("sizes", lambda n: F.struct(n.alias("size"), F.floor(p / F.pow(F.lit(2.0), n)).cast("long").alias("bin"))))
    u = units.crossJoin(sizes).select("id", "file_path", "symbol_type", "line_start", "line_end", F.inline(own))
    inside = (F.col("line_start") > F.col("a")) & (F.col("line_end") <= F.col("b")) & (F.col("id") != F.col("src"))
    kind = F.when(F.col("symbol_type") == "method", "class_contains_method").otherwise("class_contains_attribute")
    return u.join(unsent(c), ["file_path", "size", "bin"]).where(inside).select("src", F.col("id").alias("dst"), kind.alias("containment_type"))


def relationships(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, relation_type, weight) of all kinds: calls, containment, imports and references, repeats kept."""
    return _of_kinds(files, units, class_methods(units))


def _of_kinds(files: DataFrame, units: DataFrame, contained: DataFrame) -> DataFrame:
    kinds = (
        (calls(units), "calls", 1.0), (contained, "contains", 1.0), (file_imports(files, units), "imports", 0.8),
        (file_symbols(files, units), "contains", 1.0), (references(units), "references", 0.6),
    )
    out = None
    for edges, kind, weight in kinds:
        part = edges.select("src", "dst", F.lit(kind).alias("relation_type"), F.lit(weight).alias("weight"))
        out = part if out is None else out.union(part)
    return out


def counted_relationships(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, relation_type, weight, times): ``relationships`` and how often each occurs. No file has the id of a unit.

    Pairs of a class and a method are counted before they are made: those of one
    file only, by far the most, are never shuffled to be grouped.
    """
    sides = []
    for rows, end in ((_classes(units), "src"), (_methods(units), "dst")):
        own = rows.where("file_path is not null").groupBy("file_path", end).agg(F.count("*").alias(f"{end}_times"))
        sides.append(own.withColumn(f"{end}_files", F.count("*").over(Window.partitionBy(end))))
    c, m = sides
    pairs = B.pairs(c, m, "file_path", "src", "dst").where("src_files = 1 or dst_files = 1")
    once = pairs.select("src", "dst", F.lit("contains").alias("relation_type"), F.lit(1.0).alias("weight"), (F.col("src_times") * F.col("dst_times")).alias("times"))
    # what has its id in several files, if anything
    again = c.where("src_files > 1").join(unsent(m.where("dst_files > 1")), "file_path").select("src", "dst", F.explode(F.array_repeat(F.lit(1), (F.col("src_times") * F.col("dst_times")).cast("int"))))
    rest = _of_kinds(files, units, again).groupBy("src", "dst", "relation_type", "weight").agg(F.count("*").alias("times"))
    return rest.union(once)


def extracted(files: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, relation_type, weight), one row an edge: calls, imports, inheritance, containment, references and uses."""
    parts = (
        (weighed_calls(units), "calls", F.col("weight")), (file_imports(files, units), "imports", F.col("weight")), (inheritance(units), "inherits", F.lit(1.0)),
        (file_symbols(files, units), "contains", F.lit(1.0)), (class_members(units), "contains", F.lit(1.0)),
        (_weighed(units, _mentions(units), units, 0.2, 0.05), "references", F.col("weight")), (_weighed(units, _mentions(units), units, 0.4, 0.1), "uses", F.col("weight")),
    )
    out = None
    for edges, kind, weight in parts:
        part = edges.select("src", "dst", F.lit(kind).alias("relation_type"), weight.alias("weight"))
        out = part if out is None else out.union(part)
    return out


def shingles(units: DataFrame, lines: int = 4) -> DataFrame:
    """(id, at, shingle): the hashes of every run of so many lines of each unit."""
    rows = F.split("content", "\n")
    runs = F.when(F.size(rows) >= lines, F.transform(F.sequence(F.lit(1), F.size(rows) - lines + 1), lambda i: F.struct(i.alias("at"), F.md5(F.array_join(F.slice(rows, i, lines), "\n")).alias("shingle"))))
    return units.where("coalesce(length(content), 0) > 0").select("id", F.explode(runs).alias("r")).select("id", "r.at", "r.shingle")


def duplicated(units: DataFrame, lines: int = 4, more_than: int = 2) -> DataFrame:
    """(id, other, common): how many runs of lines of a unit some other unit has too, where they are more than a few.

    Equal units meet by their shingles. Shingles that one unit has are dropped first.
    """
    s = shingles(units, lines)
    shared = s.groupBy("shingle").agg(F.countDistinct("id").alias("n")).where("n > 1").select("shingle")
    s = s.join(shared, "shingle")
    other = s.select("shingle", F.col("id").alias("other")).distinct()
    return s.join(other, "shingle").where("id <> other").groupBy("id", "other").agg(F.count("*").alias("common")).where(F.col("common") > more_than)


def duplicated_ids(units: DataFrame, lines: int = 4, more_than: int = 2) -> DataFrame:
    """(id): the units that ``duplicated`` has, without making their pairs.

    A unit is one at once where another has a longer run of its lines, or one run
    that it repeats often enough. The rest look for partners among the different sets
    of runs, by their rarer runs only: a partner has more than the few commonest.
    """
    longer = shingles(units, lines + more_than).select("id", "shingle").distinct()
    runs = shingles(units, lines).groupBy("id", "shingle").agg(F.count("*").alias("times"))
    longer, s = (rows.join(unsent(rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")), "shingle") for rows in (longer, runs))
    s = written(s.select("id", "shingle", "times"))
    at_once = written(longer.select("id").union(s.where(F.col("times") > more_than).select("id")).distinct())
    # units by their sets of runs: one of each set stands for all
    sets = written(s.groupBy("id").agg(F.sum("times").alias("total"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("shingle", "times")))), 256).alias("set")))
    ones = written(sets.groupBy("set").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("total").alias("total")))
    equal = sets.where(F.col("total") > more_than).join(unsent(ones.where("n > 1").select("set")), "set").select("id")
    some = s.join(unsent(ones.select("id")), "id")
    left = ones.where((F.col("total") > more_than) & (F.col("n") == 1)).select("id").join(unsent(at_once), "id", "left_anti")
    commonness = some.groupBy("shingle").agg(F.count("*").alias("n"))
    looking = written(s.join(unsent(left), "id").join(unsent(commonness), "shingle"))
    before = Window.partitionBy("id").orderBy(F.desc("n"), "shingle")
    rarer = looking.withColumn("before", F.sum("times").over(before)).where(F.col("before") > more_than).select("id", "shingle")
    other = some.select("shingle", F.col("id").alias("other"))
    maybe = rarer.join(unsent(other), "shingle").where("id <> other").select("id", "other").distinct()
    both = maybe.join(unsent(looking.select("id", "shingle", "times")), "id").join(unsent(other), ["other", "shingle"])
    found = both.groupBy("id", "other").agg(F.sum("times").alias("common")).where(F.col("common") > more_than).select("id")
    return at_once.union(equal).union(found).distinct()


def coupling(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, afferent, efferent) by file: edges that come from other files, and other files that its own edges go to."""
    a, b = unsent(units.select(F.col("id").alias("src"), F.col("file_path").alias("from"))), unsent(units.select(F.col("id").alias("dst"), F.col("file_path").alias("to")))
    across = edges.select("src", "dst").join(a, "src").join(b, "dst").where(F.col("from") != F.col("to"))
    ca = across.groupBy(F.col("to").alias("file_path")).agg(F.count("*").alias("afferent"))
    ce = across.groupBy(F.col("from").alias("file_path")).agg(F.countDistinct("to").alias("efferent"))
    return units.select("file_path").distinct().join(ca, "file_path", "left").join(ce, "file_path", "left").na.fill(0, ["afferent", "efferent"])
