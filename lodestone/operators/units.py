"""Memory units: the files and symbols of a parsed tree, with ids, keywords, content and metadata.

Files have the columns path, file_type, content_hash, size_bytes, symbols (an array
of structs), imports, exports and content, as ``sources.parse`` makes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_id(path: Column, content_hash: Column) -> Column:
    """Changes with the content."""
    return F.sha2(F.concat_ws(":", F.lit("file"), path, content_hash), 256)


def symbol_id(path: Column, name: Column, symbol_type: Column) -> Column:
    """Doesn't change with the content; symbols of one name and type in a file share it."""
    return F.sha2(F.concat_ws(":", path, name, symbol_type), 256)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def symbol_content(content: Column, start: Column, end: Column) -> Column:
    """The lines from start to end; null where they are out of range."""
    lines = F.split(content, "\n")
    return F.when((start >= 1) & (start <= F.size(lines)) & (end >= start), F.array_join(F.slice(lines, start, F.least(end, F.size(lines)) - start + 1), "\n"))


def file_keywords(path: Column, file_type: Column, symbols: Column, imports: Column) -> Column:
    """Distinct: the stem, the symbols' names and kinds, the first word of each import, the file's type."""
    names = F.transform(symbols, lambda s: F.lower(s["name"]))
    kinds = F.transform(F.filter(symbols, lambda s: s["symbol_type"].isin("class", "function", "method")), lambda s: F.concat_ws(" ", s["symbol_type"], F.lower(s["name"])))
    first = F.transform(F.filter(imports, lambda i: F.trim(i) != ""), lambda i: F.lower(F.get(F.split(F.trim(i), r"\s+"), F.lit(0))))
    return F.array_distinct(F.concat(F.array(F.lower(stem(path))), names, kinds, first, F.array(file_type, F.concat(file_type, F.lit(" file")))))


def symbol_keywords(s: Column) -> Column:
    """The symbol's type, parameters, return type, visibility and flags."""
    flags = [F.when(s[flag], F.lit(word)) for flag, word in (("is_async", "async"), ("is_static", "static"), ("is_exported", "exported"))]
    more = [F.when(F.length(s[x]) > 0, F.lower(s[x])) for x in ("return_type", "visibility")]
    return F.array_compact(F.concat(F.array(s["symbol_type"]), F.transform(s["parameters"], lambda p: F.lower(p)), F.array(*more, *flags)))


def file_units(files: DataFrame) -> DataFrame:
    """(id, file_path, symbol, content, keywords, metadata) of files."""
    metadata = F.create_map(
        *[
            x
            for name, value in (
                ("type", F.lit("file")), ("file_type", F.col("file_type")), ("size_bytes", F.col("size_bytes").cast("string")), ("symbol_count", F.size("symbols").cast("string")),
                ("import_count", F.size("imports").cast("string")), ("export_count", F.size("exports").cast("string")),
            )
            for x in (F.lit(name), value)
        ]
    )
    symbol = F.lit(None).cast(files.schema["symbols"].dataType.elementType)
    return files.select(
        file_id(F.col("path"), F.col("content_hash")).alias("id"), F.col("path").alias("file_path"), symbol.alias("symbol"), "content",
        file_keywords(F.col("path"), F.col("file_type"), F.col("symbols"), F.col("imports")).alias("keywords"), metadata.alias("metadata"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, file_type, symbol, content): a row for each symbol with its own lines only, as ``symbol_content`` has them."""
    for batch in batches:
        for i in range(batch.num_rows):
            path, kind, content, symbols = (batch.column(c)[i] for c in ("path", "file_type", "content", "symbols"))
            if not content.is_valid or not symbols.is_valid or not len(symbols):
                continue
            text, all_symbols = content.as_py().encode(), symbols.values
            ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 10), len(text))
            for at in range(0, len(all_symbols), 10_000):
                some = all_symbols.slice(at, 10_000)
                cut = []
                for start, end in zip(some.field("line_start").to_pylist(), some.field("line_end").to_pylist()):
                    good = start is not None and end is not None and 1 <= start <= len(ends) and end >= start
                    cut.append(text[ends[start - 2] + 1 if start > 1 else 0 : ends[min(end, len(ends)) - 1]].decode() if good else None)
                n = len(some)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n, pa.string()), pa.array([kind.as_py()] * n, pa.string()), some, pa.array(cut, pa.string())], ["path", "file_type", "symbol", "content"])


def symbol_units(files: DataFrame) -> DataFrame:
    """(id, file_path, symbol, content, keywords, metadata) of symbols with content; of those that share an id the last in the file."""
    kind = files.schema["symbols"].dataType.elementType.simpleString()
    s = files.select("path", "file_type", "content", "symbols").mapInArrow(_cut, f"path string, file_type string, symbol {kind}, content string")
    made = s.select(
        symbol_id(F.col("path"), F.col("symbol.name"), F.col("symbol.symbol_type")).alias("id"), F.col("path").alias("file_path"), "symbol", "content", symbol_keywords(F.col("symbol")).alias("keywords"),
        F.create_map(F.lit("type"), F.lit("symbol"), F.lit("file_type"), F.col("file_type")).alias("metadata"),
    ).where("coalesce(length(content), 0) > 0")
    rest = [c for c in made.columns if c != "id"]
    # a map can't be ordered, so the symbol's place decides
    last = F.max_by(F.struct(*rest), F.struct("symbol.line_start", "symbol.line_end", "symbol.column_start"))
    return made.groupBy("id").agg(last.alias("u")).select("id", "u.*")


def build(files: DataFrame) -> DataFrame:
    """All units of parsed files."""
    return file_units(files).unionByName(symbol_units(files))
