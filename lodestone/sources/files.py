"""Files of a source tree as rows: scan, ignore rules, records, and what git says of them.

Predicates on paths are columns, so that they filter any table of paths; a scan
reads folders through Spark's binary file source, which pushes size and time
filters down. Paths are relative to the tree, with / between components.
"""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.operators.front import glob_regex

SKIPPED = ("node_modules", "vendor", "dist", "build", "target", "__pycache__", "venv", "env", "eggs", "site-packages", "CVS", "svn", "hg", "bzr", "out")
BINARY = (
    "exe dll so dylib bin obj o a lib class jar war ear zip tar gz bz2 xz 7z rar jpg jpeg png gif bmp ico svg pdf doc docx xls xlsx ppt pptx mp3 mp4 avi mov wmv db sqlite sqlite3"
).split()
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".rs": "rust", ".go": "go", ".rb": "ruby", ".php": "php",
}
IGNORED_EVERYWHERE = ((".git/", ".svn/", "__pycache__/", "node_modules/"), ("*.pyc", "*.log", "*.tmp", "*.swp", ".DS_Store"))


@dataclass(frozen=True)
class Ignore:
    """A line of an ignore file: a regular expression, whether it lets in again, and whether it is for folders only."""

    regex: str
    negated: bool
    folders: bool


def parse_ignore(text: str) -> list[Ignore]:
    """The patterns of an ignore file, without blank lines and comments; ! lets in again, a / at the end is for folders, one in front is dropped, ** counts as *."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line.removeprefix("!")
        folders = line.endswith("/")
        line = line.rstrip("/").lstrip("/").replace("**/", "*")
        if line:
            out.append(Ignore(glob_regex(line), negated, folders))
    return out


def ignored(path: Column, patterns: list[Ignore]) -> Column:
    """Whether the last pattern that matches a path leaves it out. Folder patterns match folders on the way, others the whole path or any component."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    out = F
    for p in reversed(patterns):
        some = above if p.folders else parts
        hit = _some(some, p.regex)
        if not p.folders:
            hit = hit | path.rlike(p.regex)
        out = out.when(hit, not p.negated)
    return out.otherwise(False) if patterns else F.lit(False)


def _some(parts: Column, regex: str) -> Column:
    return F.exists(parts, lambda x: x.rlike(regex))


def globally_ignored(path: Column) -> Column:
    """Left out in any tree: certain folders on the way, and certain file names."""
    test = F.lit(False)
    for folder in IGNORED_EVERYWHERE[0]:
        test = test | F.concat(F.lit("/"), path).contains("/" + folder)
    for pattern in IGNORED_EVERYWHERE[1]:
        test = test | P.name(path).rlike(glob_regex(pattern))
    return test


def in_kept_folder(path: Column) -> Column:
    """No folder on the way is hidden or one of SKIPPED."""
    parts = F.split(path, "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.exists(above, lambda x: x.startswith(".") | x.isin(*SKIPPED))


def language(path: Column) -> Column:
    """The language that the file's extension stands for, or unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(P.extension(path))), F.lit("unknown"))


def is_wanted(path: Column, size: Column, max_bytes: int = 10 << 20, extensions: tuple[str, ...] = (), excluded: tuple[str, ...] = (), patterns: list[Ignore] | None = None) -> Column:
    """Whether a scan takes a file: not binary by its extension, of a wanted one if there are such, not too large, not excluded by name, not ignored."""
    extension = F.lower(P.extension(path))
    keep = ~extension.isin(*[f".{x}" for x in BINARY])
    if extensions:
        keep = keep & extension.isin(*extensions)
    keep = keep & (size <= max_bytes)
    for pattern in excluded:
        keep = keep & ~P.name(path).rlike(glob_regex(pattern))
    return keep & ~ignored(path, patterns or [])


def scan(spark: SparkSession, folder: str, ignore: str = "", max_bytes: int = 10 << 20, extensions: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, size_bytes, last_modified, content) of the files that are taken. ignore: the text of an ignore file. A folder without files gives no row, and neither does a file without a byte: Spark's file sources pass those over."""
    base = folder.rstrip("/")
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(base)
    full = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    rows = read.where(F.col("length") <= max_bytes).select(P.relative(full, base).alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("last_modified"), "content")
    return rows.where(in_kept_folder(F.col("path")) & is_wanted(F.col("path"), F.col("size_bytes"), max_bytes, extensions, excluded, parse_ignore(ignore)))


def with_extension(files: DataFrame, extension: str) -> DataFrame:
    return files.where(F.lower(P.extension(F.col("path"))) == extension.lower())


def totals(files: DataFrame) -> DataFrame:
    """(files, bytes)."""
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def records(files: DataFrame) -> DataFrame:
    """(path, file_type, content_hash, size_bytes, last_modified, content), the content as text: bytes that aren't UTF-8 are replaced."""
    return files.select("path", language(F.col("path")).alias("file_type"), F.sha2("content", 256).alias("content_hash"), "size_bytes", "last_modified", _text("content").alias("content"))


def _text(column: str) -> Column:
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string")).otherwise(F.make_valid_utf8(F.col(column).cast("string")))


# --- git ---


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def git_status(spark: SparkSession, repo: str) -> DataFrame:
    """(path, change) of the work tree: added, modified or deleted, staged or not."""
    rows = []
    for line in _git(repo, "status", "--porcelain", "-z", "--untracked-files=all", "--no-renames").split("\0"):
        if len(line) > 3:
            code = line[:2]
            rows.append((line[3:], "deleted" if "D" in code else "added" if "A" in code or "?" in code else "modified"))
    return spark.createDataFrame(rows, "path string, change string")


def git_files(spark: SparkSession, repo: str, commit: str = "HEAD") -> DataFrame:
    """(path) of the files of a commit."""
    return spark.createDataFrame([(p,) for p in _git(repo, "ls-tree", "-r", "-z", "--name-only", commit).split("\0") if p], "path string")


def git_changes(spark: SparkSession, repo: str, old: str, new: str) -> DataFrame:
    """(path, change) between two commits; a rename is a deletion and an addition."""
    said = [x for x in _git(repo, "diff", "--name-status", "--no-renames", "-z", old, new).split("\0") if x]
    kinds = {"A": "added", "M": "modified", "T": "modified", "D": "deleted"}
    return spark.createDataFrame([(p, kinds[k[0]]) for k, p in zip(said[::2], said[1::2]) if k[0] in kinds], "path string, change string")


def git_diff(repo: str, path: str, commit: str = "HEAD") -> str:
    """The unified diff of a file against a commit."""
    return _git(repo, "diff", commit, "--", path)
