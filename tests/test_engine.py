"""A small source tree from scan to answers, and its upkeep."""

import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Config, Engine, Profiler
from lodestone.operators.stores import TableStore
from lodestone.sources import files as S
from lodestone.sources import parse as P
from lodestone.streaming import jobs

SHAPES = '''"""Shapes."""
import os
from math import pi as PI_OF

__all__ = ["Circle", "area"]
LIMIT = 10


class Shape(Base):
    """A shape."""

    def area(self, scale: float = 1.0, *rest, unit="cm", **more) -> float:
        """Its area."""
        return measure(self) * scale

    @staticmethod
    def make():
        return Circle(1)


class Circle(Shape):
    async def draw(self, é):
        password = "hunter2"
        return area(é)


def measure(shape):
    for i in range(len(shape)):
        os.system("ls")
    return Circle(3)
'''
SCRIPT = """// not function hidden() {}
import { x } from "./y";
/** Greets. */
export async function greet(name, loud = true) {
  if (loud) { return `hi ${name}`; }
}
class Greeter extends Base {
  constructor(name) {
    this.name = name;
  }
  static all() { return greet(1); }
}
const LIMIT = 3;
const twice = (n) => n * 2;
module.exports = { Greeter, LIMIT };
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, text in {"src/shapes.py": SHAPES, "web/greet.js": SCRIPT, "broken.py": "def (", "notes.md": "hello", "node_modules/x.js": "var a = 1;", ".git/config": "x", "logs/a.py": "a = 1", "b.log": "x", "empty.py": "", "a.bin": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "latin.py").write_bytes(b"x = 1  # \xe9\n")
    return root


def test_parse_python():
    symbols, imports, exports = P.parse_python(SHAPES)
    got = {(s["name"], s["symbol_type"]): s for s in symbols}
    assert set(got) == {("Shape", "class"), ("Circle", "class"), ("area", "method"), ("make", "method"), ("draw", "method"), ("measure", "function"), ("LIMIT", "constant"), ("password", "variable"), ("os", "import"), ("PI_OF", "import"), ("__all__", "variable")}
    area = got["area", "method"]
    assert area["parameters"] == ["self", "scale", "*rest", "unit", "**more"] and area["return_type"] == "float" and area["documentation"] == "Its area." and area["is_exported"]
    assert (area["line_start"], area["line_end"], area["column_start"]) == (12, 14, 5)
    assert got["draw", "method"]["is_async"] and got["draw", "method"]["parameters"] == ["self", "é"] and got["make", "method"]["is_static"] and got["Circle", "class"]["bases"] == ["Shape"]
    assert imports == ["import os", "from math import pi as PI_OF"] and exports == ["Circle", "area"]
    assert P.parse_python("") == ([], [], [])


def test_parse_javascript():
    symbols, imports, exports = P.parse_javascript(SCRIPT)
    got = {s["name"]: s for s in symbols}
    assert {n: s["symbol_type"] for n, s in got.items()} == {"greet": "function", "Greeter": "class", "constructor": "method", "all": "method", "LIMIT": "constant", "twice": "function"}
    assert got["greet"]["parameters"] == ["name", "loud"] and got["greet"]["is_async"] and got["greet"]["is_exported"] and got["greet"]["documentation"] == "Greets."
    assert (got["greet"]["line_start"], got["greet"]["line_end"]) == (4, 6) and (got["Greeter"]["line_start"], got["Greeter"]["line_end"]) == (7, 12) and got["Greeter"]["bases"] == ["Base"]
    assert got["all"]["is_static"] and got["Greeter"]["is_exported"] and imports == ['import { x } from "./y"'] and set(exports) == {"greet", "Greeter", "LIMIT"}
    assert P.parse_javascript("") == ([], [], [])


def test_engine(spark, tree, tmp_path):
    config = Config(str(tree), str(tmp_path / "store"), ignore="logs/\n*.log\n", included_extensions=())
    assert Config.loaded(config.merged(verbosity=2).saved()) == config.merged(verbosity=2)
    assert Config("", "x", max_file_size_mb=0, verbosity=9).problems() and pytest.raises(ValueError, Engine, spark, Config("", ""))
    engine = Engine(spark, config)
    assert engine.diagnose()[0] == "warning"
    assert engine.build() == 1 and engine.diagnose() == ("healthy", [])
    files = {r["path"]: r for r in engine.table("files").collect()}
    assert set(files) == {"src/shapes.py", "web/greet.js", "broken.py", "notes.md", "latin.py"}  # files without a byte are no rows
    assert files["broken.py"]["error"].startswith("SyntaxError") and files["broken.py"]["symbols"] == [] and len(files["src/shapes.py"]["content_hash"]) == 64
    hits = engine.query("find: measure")
    assert [h["name"] for h in hits] == ["measure"] or "measure" in {h["name"] for h in hits}
    assert engine.query("find: measure") is hits  # kept
    assert {h["file_path"] for h in engine.query("password", {"file_path": "SHAPES"})} == {"src/shapes.py"} and engine.query("password", {"language": "java"}) == []
    units = {r["name"]: r["id"] for r in engine._flat(engine.table("units")).where("name is not null").collect()}
    edges = {(r["src"], r["dst"], r["relation_type"]) for r in engine.table("edges").collect()}
    assert (units["Circle"], units["Shape"], "inherits") in edges and (units["measure"], units["Circle"], "calls") in edges and (units["Shape"], units["area"], "contains") in edges
    assert {"hardcoded_secrets", "command_injection"} <= {r["issue"] for r in engine.analyze("security").collect()}
    assert engine.graph("measure").count() > 0 and engine.ask("what is connected to measure")[0] == "graph" and engine.ask("help")[0] in ("help", "search")
    (tree / "src/shapes.py").write_text(SHAPES.replace("measure", "gauge"))
    (tree / "new.py").write_text("def fresh(): pass\n")
    (tree / "notes.md").unlink()
    assert engine.update() == {"added": 1, "modified": 1, "deleted": 1} and engine.version() == 2
    assert engine.query("find: measure") == [] and {h["name"] for h in engine.query("find: fresh")} >= {"fresh"} and {h["name"] for h in engine.query("find: gauge")} >= {"gauge"}
    fresh = Engine(spark, config.merged(storage_path=str(tmp_path / "other")))
    fresh.build()
    for table in ("units", "edges", "postings"):  # an update ends where a build does
        keep = ["id", "content"] if table == "units" else engine.table(table).columns
        assert sorted(map(tuple, engine.table(table).select(keep).collect()), key=str) == sorted(map(tuple, fresh.table(table).select(keep).collect()), key=str)
    assert engine.update() == {"added": 0, "modified": 0, "deleted": 0} and engine.version() == 2
    assert engine.rollback() and engine.version() == 1 and engine.query("find: measure") and not engine.rollback()
    p = Profiler()
    with p.timed("a"):
        pass
    assert p.summary()["a"]["count"] == 1


def test_git_sources(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *args], check=True, capture_output=True)

    git("init", "-q")
    for name in ("a b.txt", "c.txt", "d.txt"):
        (tmp_path / name).write_text("1\n")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "a b.txt").write_text("2\n")
    (tmp_path / "d.txt").unlink()
    (tmp_path / "é.txt").write_text("new")
    repo = str(tmp_path)
    want = {("a b.txt", "modified"), ("d.txt", "deleted"), ("é.txt", "added")}
    assert {tuple(r) for r in S.git_status(spark, repo).collect()} == want
    assert "+2" in S.git_diff(repo, "a b.txt")
    git("add", "-A")
    git("commit", "-qm", "two")
    assert {tuple(r) for r in S.git_changes(spark, repo, "HEAD~1", "HEAD").collect()} == want
    assert {r["path"] for r in S.git_files(spark, repo).collect()} == {"a b.txt", "c.txt", "é.txt"} and S.git_status(spark, repo).count() == 0


def test_store_and_streams(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "kv"))
    rows = lambda *r: spark.createDataFrame([(k, v, t) for k, v, t in r], "key string, value string, t string").select("key", "value", F.col("t").cast("timestamp").alias("updated_at"))
    assert store.read().count() == 0 and not store.rollback()
    store.put(rows(("a", "1", "2024-01-01"), ("b", "1", "2024-01-01"), ("a", "2", "2024-01-02")))
    store.put(rows(("a", "3", "2024-01-03")))
    got = {r["key"]: (r["value"], str(r["created_at"])[:10]) for r in store.read().collect()}
    assert got == {"a": ("3", "2024-01-01"), "b": ("1", "2024-01-01")}
    keys = spark.createDataFrame([("b",), ("zz",)], "key string")
    assert {tuple(r) for r in store.get(keys, missing=True).collect()} == {("b", "1"), ("zz", None)} and store.get(keys).count() == 1
    store.delete(keys)
    assert [r["key"] for r in store.read().collect()] == ["a"]
    assert store.rollback() and store.read().count() == 2
    store.backup(str(tmp_path / "copy"))
    store.clear()
    assert store.read().count() == 0
    store.restore(str(tmp_path / "copy"))
    store.compact()
    assert store.read().count() == 2 and store.vacuum() > 0 and store.versions() == [store.version()]
    # a stream of files into a store
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.txt").write_text(str(i))
    seen = []
    state = TableStore(spark, str(tmp_path / "hashes"))
    run = lambda: jobs.keep_hashes(jobs.files(spark, str(folder)), state, str(tmp_path / "cp"), lambda c: seen.extend(r["change"] for r in c.collect())).awaitTermination()
    run()
    (folder / "9.txt").write_text("9")
    run()
    assert seen == ["added"] * 4 and state.read().count() == 4
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:50:00", "x"), ("2024-01-01 03:00:00", "y")], "t string, kind string")
    events.select(F.col("t").cast("timestamp").alias("ts"), "kind").write.parquet(str(tmp_path / "ev"))
    stream = jobs.windowed_counts(spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "ev")), "ts", "kind")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {(str(r["window_start"]), r["kind"], r["n"]) for r in spark.table("counts").collect()} == {("2024-01-01 00:00:00", "x", 2), ("2024-01-01 03:00:00", "y", 1)}


def test_python_in_pieces_is_the_whole():
    # what looks like a statement at the margin is in a string, in brackets, or goes on a statement
    odd = SHAPES + 'x = """\ny = 1\ndef no(): pass\n"""\nif x:\n    a = 1\nelse:\n    b = 2\ntry:\n    import re\nfinally:\n    c = (\n1,\n2)\n@wraps\n\n# more\nasync def last(k): return k\r\nz = 1\rw = 2\n__all__ += ["last", "b"]\nd = 1 + \\\n2\n'
    text = odd * 3
    whole = P.parse_python(text, len(text) + 1)
    assert {s["name"] for s in whole[0] if s["is_exported"]} >= {"last", "b", "area"}
    for piece in (1, 20, 300):
        assert P.parse_python(text, piece) == whole
    assert len(list(P.python_pieces(text, 1))) > 20
    for wrong in ("a = 1\nb = (\nc = 2\n", "def f(:\n", "a = 1\n  b = 2\n", 'x = """\n' + text, "a\x00b"):
        said = []
        for parse in (lambda: __import__("ast").parse(wrong), lambda: P.parse_python(wrong, 4)):
            with pytest.raises((SyntaxError, ValueError)) as found:
                parse()
            said.append(str(found.value))
        assert said[0] == said[1]


def test_a_long_file_costs_its_length(spark):
    # every symbol's row held the whole file
    from lodestone.operators import units as N

    text = "\n".join(f'class C{i}:\n    """Döc {i}"""\n    def run(self):\n        return {i}\n' for i in range(300))
    rows = [("a.py", "python", text), ("b.py", "python", ""), ("c.py", "python", None), ("d.py", "cobol", "x"), ("e.py", "python", "def f(:")]
    files = P.parsed(spark.createDataFrame(rows, "path string, file_type string, content string"))
    assert {r["path"]: (len(r["symbols"]), r["error"] is None) for r in files.collect()} == {"a.py": (600, True), "b.py": (0, True), "c.py": (0, True), "d.py": (0, True), "e.py": (0, False)}
    made = N.symbol_units(files)
    found = {r["symbol"]["name"]: r["content"] for r in made.collect()}
    assert len(found) == 301 and found["C7"] == 'class C7:\n    """Döc 7"""\n    def run(self):\n        return 7' and found["run"] == "    def run(self):\n        return 299"
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
