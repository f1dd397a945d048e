"""Change detection between snapshots, what changed inside files, and the upkeep of index, graph and state by deltas."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import index as I
from lodestone.operators.edges import matches

FUNCTIONS = (r"def\s+(\w+)\s*\(", r"function\s+(\w+)\s*\(", r"const\s+(\w+)\s*=\s*\(")
CLASSES = (r"class\s+(\w+)\s*\(", r"class\s+(\w+)\s*\{")
IMPORTS = (r"import\s+(.+)", r"from\s+(.+)\s+import", r"import\s+.+\s+from\s+(.+)", r"require\s*\(\s*['\x22](.+)['\x22]")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) from snapshots (path, content_hash): added, modified or deleted; what stayed is left out."""
    both = old.select("path", F.col("content_hash").alias("o")).join(new.select("path", F.col("content_hash").alias("n")), "path", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "deleted").when(F.col("o") != F.col("n"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def changed_of(registry: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, change) of the given paths only, the registry brought up to date): no path is taken as deleted."""
    both = current.select("path", F.col("content_hash").alias("n")).join(registry.select("path", F.col("content_hash").alias("o")), "path", "left")
    change = F.when(F.col("o").isNull(), "added").when(F.col("o") != F.col("n"), "modified")
    rest = registry.join(current.select("path"), "path", "left_anti").select("path", "content_hash")
    return both.select("path", change.alias("change")).where("change is not null"), rest.union(current.select("path", "content_hash"))


def history(hashes: DataFrame) -> DataFrame:
    """(path, ts, content_hash, changed, old_hash): each observation against the one before of its path; the first one counts as changed."""
    before = F.lag("content_hash").over(Window.partitionBy("path").orderBy("ts", "content_hash"))
    return hashes.select("path", "ts", "content_hash", before.alias("old_hash")).withColumn("changed", F.col("old_hash").isNull() | (F.col("old_hash") != F.col("content_hash")))


def named(content: Column, patterns: tuple[str, ...]) -> Column:
    """Names that patterns find, pattern by pattern, repeats kept."""
    return F.concat(*[matches(content, p) for p in patterns])


def name_changes(pairs: DataFrame) -> DataFrame:
    """(path, functions_added, functions_removed, classes_added, classes_removed, imports_added, imports_removed) from (path, old, new), sorted."""
    out = ["path"]
    for name, patterns in (("functions", FUNCTIONS), ("classes", CLASSES), ("imports", IMPORTS)):
        o, n = (named(F.col(c), patterns) for c in ("old", "new"))
        out += [F.array_sort(F.array_except(n, o)).alias(f"{name}_added"), F.array_sort(F.array_except(o, n)).alias(f"{name}_removed")]
    return pairs.select(*out)


def line_changes(pairs: DataFrame) -> DataFrame:
    """(path, lines_added, lines_removed, lines_modified) from (path, old, new), by a line diff of each pair."""
    kind = pairs.schema["path"].dataType.simpleString()

    def diff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, old, new in zip(batch["path"], batch["old"], batch["new"]):
                a, b = (old or "").split("\n"), (new or "").split("\n")
                added = removed = 0
                for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
                    removed += j - i if op in ("replace", "delete") else 0
                    added += m - k if op in ("replace", "insert") else 0
                rows.append((path, added, removed, min(added, removed)))
            yield pd.DataFrame(rows, columns=["path", "lines_added", "lines_removed", "lines_modified"])

    return pairs.select("path", "old", "new").mapInPandas(diff, f"path {kind}, lines_added int, lines_removed int, lines_modified int")


def updated_units(units: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Units without those of changed or deleted files (path, change), and with the fresh ones of added and modified files."""
    return units.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(units.columns).unionByName(fresh.select(units.columns))


def updated_index(index: DataFrame, units: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The three indices after changed files (path, change): their old units' postings go, those of the fresh units come."""
    gone = units.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("id").alias("unit_id"))
    return I.updated(index, gone, I.three_indices(fresh))


def updated_graph(edges: DataFrame, units: DataFrame, changed: DataFrame, fresh_edges: DataFrame, still: DataFrame) -> DataFrame:
    """Edges after changed files: those at old units go and fresh ones come, if both their ends are still there (id)."""
    gone = units.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id")
    rest = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(edges.columns)
    whole = rest.unionByName(fresh_edges.select(edges.columns)).distinct()
    return whole.join(still.select(F.col("id").alias("src")), "src", "left_semi").join(still.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def update_statistics(log: DataFrame) -> DataFrame:
    """(updates, avg_files, last): from rows (ts, added, modified, deleted) of updates, the counts of their files."""
    n = F.col("added") + F.col("modified") + F.col("deleted")
    return log.agg(F.count("*").alias("updates"), F.round(F.avg(n), 6).alias("avg_files"), F.max("ts").alias("last"))


def last_events(events: DataFrame, k: int) -> DataFrame:
    """The last k events of each type, latest first: (event_type, event_id, ts, place)."""
    place = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.select("event_type", "event_id", "ts", place.alias("place")).where(F.col("place") <= k)
