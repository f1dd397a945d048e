"""Scalars on paths, sizes and durations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """The last suffix with its dot, or nothing."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file's name without its last suffix; a name that is all suffix stays."""
    return F.regexp_extract(name(path), r"^(.+?)(\.[^.]*)?$", 1)


def relative(path: Column, base: str) -> Column:
    """The path from a folder on; other paths as they are."""
    base = base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def is_below(path: Column, base: str) -> Column:
    return path.startswith(base.rstrip("/") + "/")


def sanitized(path: Column) -> Column:
    """A name that any file system takes."""
    return F.left(F.translate(path, '<>:"/\\|?*', "_" * 9), F.lit(255))


def human_size(n: Column) -> Column:
    """Bytes for people: B, KB, MB, GB or TB with one digit."""
    out = F.format_string("%.1f TB", n / 1024**4)
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1), ("B", 0)):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def duration(seconds: Column) -> Column:
    """Seconds for people: us, ms, s, or m and s."""
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 0.001, F.format_string("%.2fus", seconds * 1_000_000))
        .when(seconds < 1, F.format_string("%.2fms", seconds * 1000))
        .when(seconds < 60, F.format_string("%.2fs", seconds))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), F.format_string("%.2fs", seconds - minutes * 60)))
    )


def common_base(paths: list[str]) -> str:
    """The deepest folder that all paths lie in."""
    import os.path

    return os.path.commonpath(paths) if paths else ""
