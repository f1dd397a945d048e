"""The engine: a source tree scanned, parsed, linked and indexed into tables, and asked, searched, ranked, walked and analysed.

An ``Engine`` works on a folder with one Parquet table an entity: files, units,
edges, postings and hashes. ``build`` makes them, ``update`` brings them up to date
with the files that changed, and the rest reads them. Each table is kept in
versions, like ``stores.TableStore``'s, so that a failed build leaves the last one.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import analysis as A
from lodestone.operators import edges as E
from lodestone.operators import front as Q
from lodestone.operators import graph as G
from lodestone.operators import incremental as N
from lodestone.operators import index as I
from lodestone.operators import ranking as R
from lodestone.operators import units as U
from lodestone.sources import files as S
from lodestone.sources import parse as P


@dataclass(frozen=True)
class Config:
    """What a build is told. ``problems`` says what is wrong with it."""

    repo_path: str
    storage_path: str
    max_file_size_mb: int = 10
    excluded_patterns: tuple[str, ...] = ()
    included_extensions: tuple[str, ...] = ()
    ignore: str = ""
    graph_max_depth: int = 5
    cache_results: int = 100
    verbosity: int = 1

    def problems(self) -> list[str]:
        out = []
        if not self.repo_path or not self.storage_path:
            out.append("repo_path and storage_path must be given")
        if self.max_file_size_mb <= 0:
            out.append("max_file_size_mb must be positive")
        if self.graph_max_depth <= 0:
            out.append("graph_max_depth must be positive")
        if self.verbosity not in range(4):
            out.append("verbosity must be 0 to 3")
        return out

    def merged(self, **changes) -> "Config":
        """This configuration with some values changed; unknown names are an error."""
        return replace(self, **changes)

    def saved(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loaded(cls, text: str) -> "Config":
        said = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in said.items()})


@dataclass
class Profiler:
    """Seconds by name."""

    spans: list[tuple[str, float]] = field(default_factory=list)

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.spans.append((name, time.perf_counter() - began))

    def summary(self) -> dict[str, dict[str, float]]:
        """Total, count and average by name."""
        out: dict[str, dict[str, float]] = {}
        for name, s in self.spans:
            x = out.setdefault(name, {"total": 0.0, "count": 0, "average": 0.0})
            x["total"] += s
            x["count"] += 1
            x["average"] = x["total"] / x["count"]
        return out


class Engine:
    """Builds, updates and answers over one source tree."""

    TABLES = ("files", "units", "edges", "postings")

    def __init__(self, spark: SparkSession, config: Config):
        if wrong := config.problems():
            raise ValueError("; ".join(wrong))
        self.spark, self.config, self.profiler = spark, config, Profiler()
        self.history: list[tuple[str, str]] = []
        self._cache: dict[str, list] = {}
        base = spark._jvm.org.apache.hadoop.fs.Path(config.storage_path)
        self._fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(base)

    # tables

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.config.storage_path, *parts)))

    def version(self) -> int:
        """The current version of the tables, 0 before the first build."""
        marks = [s.getPath().getName() for s in self._fs.listStatus(self._path())]
        return max((int(m[8:]) for m in marks if m.startswith("current-")), default=0)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.config.storage_path}/v{version or self.version()}/{name}")

    def rollback(self) -> bool:
        """Back to the tables before the last build or update; False where there are none."""
        v = self.version()
        if v < 2 or not self._fs.exists(self._path(f"v{v - 1}")):
            return False
        self._fs.delete(self._path(f"current-{v}"), False)
        self._cache.clear()
        return True

    # build and update

    def scanned(self) -> DataFrame:
        c = self.config
        return S.records(S.scan(self.spark, c.repo_path, c.ignore, c.max_file_size_mb << 20, c.included_extensions, c.excluded_patterns))

    @staticmethod
    def _flat(units: DataFrame) -> DataFrame:
        """Units with their symbol's name, type, place and parameters as columns; k orders them."""
        s = units.select(
            "*", F.col("symbol.name").alias("name"), F.col("symbol.symbol_type").alias("symbol_type"), F.col("symbol.line_start").alias("line_start"), F.col("symbol.line_end").alias("line_end"),
            F.coalesce("symbol.parameters", F.array().cast("array<string>")).alias("parameters"), F.col("symbol.documentation").alias("doc"),
        )
        # an order that doesn't need all units in one place
        return s.withColumn("k", F.struct("file_path", F.coalesce("line_start", F.lit(0)).alias("line"), "id"))

    def _linked(self, units: DataFrame) -> DataFrame:
        flat = self._flat(units)
        files, symbols = flat.where("symbol is null"), flat.where("symbol is not null")
        return E.extracted(files, symbols).distinct()

    def build(self) -> int:
        """All tables from all files; returns their version."""
        v = self.version() + 1
        with self.profiler.timed("build"):
            files = P.parsed(self.scanned())
            self._write_one(v, "files", files)
            files = self.table("files", v)
            self._write_one(v, "units", U.build(files))
            units = self.table("units", v)
            self._write_one(v, "edges", self._linked(units))
            self._write_one(v, "postings", I.three_indices(self._flat(units)))
            self._fs.create(self._path(f"current-{v}"), True).close()
            self._cache.clear()
        return v

    def _write_one(self, version: int, name: str, df: DataFrame) -> None:
        with self.profiler.timed(f"write {name}"):
            df.write.mode("overwrite").parquet(f"{self.config.storage_path}/v{version}/{name}")

    def update(self, force: bool = False) -> dict[str, int]:
        """Brings the tables up to date; counts of added, modified and deleted files. force builds anew.

        Files that didn't change aren't parsed again; their units and postings stay.
        """
        if force or not self.version():
            self.build()
            return {"added": self.table("files").count(), "modified": 0, "deleted": 0}
        old, now = self.table("files"), self.scanned()
        changed = N.changes(old.select("path", "content_hash"), now.select("path", "content_hash")).persist()
        counts = {"added": 0, "modified": 0, "deleted": 0} | {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
        if any(counts.values()):
            fresh = P.parsed(now.join(changed.where("change <> 'deleted'").select("path"), "path", "left_semi"))
            v = self.version() + 1
            self._write_one(v, "files", old.join(changed.select("path"), "path", "left_anti").select(old.columns).unionByName(fresh.select(old.columns)))
            files = self.table("files", v)
            more = U.build(files.join(changed.select("path"), "path", "left_semi"))
            before = self.table("units")
            self._write_one(v, "units", N.updated_units(before, changed, more))
            units = self.table("units", v)
            self._write_one(v, "edges", self._linked(units))
            again = self._flat(units.join(changed.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
            self._write_one(v, "postings", N.updated_index(self.table("postings"), before, changed, again))
            self._fs.create(self._path(f"current-{v}"), True).close()
            self._cache.clear()
        changed.unpersist()
        return counts

    # questions

    def query(self, text: str, filters: dict[str, str] | None = None, limit: int = 10, offset: int = 0) -> list[dict]:
        """Hits (rank, id, name, symbol_type, file_path, content, score) of a text, or of find: and the exact name; kept for the next time."""
        key = json.dumps([text, sorted((filters or {}).items()), limit, offset])
        self.history.append(("query", text))
        if key not in self._cache:
            with self.profiler.timed("query"):
                found = I.routed(self.table("postings"), text, 1 << 30)
                units = self._flat(self.table("units")).withColumn("file_type", F.col("metadata")["file_type"])
                hits = R.post_filter(units.join(found, F.col("id") == F.col("unit_id")), filters or {})
                page = R.page(hits.select("id", "name", "symbol_type", "file_path", "content", F.col("score").cast("double")), [F.desc("score"), F.col("id")], offset, limit)
                self._cache[key] = [{"rank": offset + i + 1} | r.asDict() for i, r in enumerate(page.collect())]  # a page
                if len(self._cache) > self.config.cache_results:
                    self._cache.pop(next(iter(self._cache)))
        return self._cache[key]

    def ask(self, text: str, limit: int = 10) -> tuple[str, list[dict]]:
        """(intent, answer): what a question asks for decides who answers it. Filters in the text hold for searches."""
        row = Q.classified(self.spark.createDataFrame([(text,)], "q string"), "q").select("intent", *[x.alias(n) for n, x in R.filters_in(F.col("q")).items()]).first()
        intent = row["intent"]
        named = {"file": "file_path", "type": "symbol_type", "lang": "language"}
        filters = {named[n]: row[n] for n in named if row[n]}
        self.history.append(("ask", text))
        words = [w for w in T.query_terms(text, stemmed=False)]
        if intent == "analyze":
            return intent, [r.asDict() for r in self.analyze().groupBy("analysis_type", "severity").count().orderBy("analysis_type", "severity").collect()]
        if intent == "graph":
            known = self._flat(self.table("units")).where(F.lower("name").isin(words or [""])).select("name").limit(1).collect()
            return intent, [r.asDict() for r in self.graph(known[0]["name"] if known else None).limit(limit).collect()]
        if intent == "help":
            return intent, [{"line": x} for x in ("query(text): search", "query('find: name'): exact", "graph(name): what it touches", "analyze(kind): findings", "update(): new files")]
        return intent, self.query(text, filters, limit)

    def graph(self, symbol: str | None = None, depth: int | None = None) -> DataFrame:
        """The edges around a symbol (src, dst, relation_type, weight), or all of them."""
        edges = self.table("edges")
        if symbol is None:
            return edges
        start = self._flat(self.table("units")).where(F.col("name") == symbol).select("id")
        both = edges.select("src", "dst").union(edges.select("dst", "src"))
        return G.induced(edges, G.bfs(both, start, depth or 1).select("id").distinct())

    def analyze(self, kind: str | None = None) -> DataFrame:
        """Findings of one kind of analysis, or of all, in one pass over the units."""
        return A.findings(self._flat(self.table("units")).where("symbol is not null"), kind)

    def diagnose(self) -> tuple[str, list[str]]:
        """('healthy', 'warning' or 'critical', what is amiss): the folder, the tables, their rows, the configuration."""
        issues = list(self.config.problems())
        if not self._fs.exists(self._path()):
            issues.append("the storage folder is missing")
        v = self.version()
        if not v:
            issues.append("nothing is built yet")
        else:
            issues += [f"table {t} is missing" for t in self.TABLES if not self._fs.exists(self._path(f"v{v}", t))]
            if not any("missing" in i for i in issues) and self.table("units").isEmpty():
                issues.append("there are no units")
        return ("healthy" if not issues else "warning" if len(issues) <= 2 else "critical"), issues

    def fix(self) -> list[str]:
        """Makes what is missing: the folder, and the tables by a build."""
        state, issues = self.diagnose()
        if state != "healthy":
            self._fs.mkdirs(self._path())
            self.build()
        return issues


def run_all(spark: SparkSession, jobs: dict[str, Callable[[], object]], workers: int = 4) -> dict[str, object]:
    """Runs driver-side calls side by side, each of which may start Spark jobs; what fails is its exception."""
    from concurrent.futures import ThreadPoolExecutor

    def one(call: Callable[[], object]) -> object:
        try:
            return call()
        except Exception as wrong:  # noqa: BLE001 - each call's failure is its own result
            return wrong

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(jobs, pool.map(one, jobs.values())))

