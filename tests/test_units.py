"""Text, search, ranking, analysis and upkeep operators on small inputs: nulls, empty texts, ties, repeated rows and empty tables."""

import datetime
import difflib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import embed as M
from lodestone.functions import text as T
from lodestone.operators import analysis as A
from lodestone.operators import blocks as B
from lodestone.operators import edges as E
from lodestone.operators import front as Q
from lodestone.operators import incremental as N
from lodestone.operators import index as I
from lodestone.operators import ranking as R
from lodestone.operators import search as S
from lodestone.operators import vectors as V
from lodestone.sources import files as X

TEXTS = [(1, "Parsing the functions, functions!"), (2, "fastest parser über alles 語"), (3, None), (4, ""), (5, "the and of"), (6, "parser parser PARSER"), (7, "parser parser PARSER")]


def stem(w):
    return next((w[: -len(s)] for s in T.SUFFIXES if w.endswith(s) and len(w) > len(s) + 2), w)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_index_store_is_what_plain_python_finds(spark, docs, tmp_path):
    import re

    index = {}
    for i, text in TEXTS:
        for w in re.findall(r"\w+", (text or "").lower()):
            if len(stem(w)) > 2 and stem(w) not in T.STOP_WORDS:
                index.setdefault(stem(w), {}).setdefault(i, 0)
                index[stem(w)][i] += 1
    store = I.IndexStore.build(docs, "id", "text", str(tmp_path / "ix"))
    assert {(r["term"], r["unit_id"], r["tf"]) for r in store.postings().collect()} == {(t, i, n) for t, d in index.items() for i, n in d.items()}
    terms = T.query_terms("Parser parser functions nothing")
    want = {}
    for t in terms:
        for i in index.get(t, ()):
            want[i] = want.get(i, 0) + np.log(len(index) / (len(index[t]) + 1))
    got = [(r["unit_id"], r["score"]) for r in store.search(terms, 10).collect()]
    assert got == [(i, pytest.approx(s, abs=1e-5)) for i, s in sorted(want.items(), key=lambda x: (-round(x[1], 6), x[0]))]
    assert store.search(["nothing"], 5).count() == 0 and store.fuzzy(["qqqqqq"], 5).count() == 0
    assert {r["term"] for r in store.near(["parx"], 1, 5).collect()} == {"pars"}
    assert [r["unit_id"] for r in store.fuzzy(["parz"], 1).collect()] == [1]  # a tie: the least id
    assert S.phrase_search(store.of(["fast", "pars"]), ["fast", "pars"]).collect()[0]["unit_id"] == 2
    assert I.IndexStore.build(docs.limit(0), "id", "text", str(tmp_path / "none")).search(["pars"], 5).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(50, 6)).round(2)
    x[7] = x[3]
    x[9] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>").repartition(4)
    size = np.linalg.norm(x, axis=1)
    cos = np.round(x @ x.T / np.where(np.outer(size, size) > 0, np.outer(size, size), 1), 6)
    for itself in (True, False):
        for slice_bytes in (1 << 20, 60):
            got = {}
            for h in V.nearest(rows, rows.where("id % 20 = 0 or id = 99"), "id", "v", 5, itself, slice_bytes).collect():
                got.setdefault(h["query"], []).append((-round(h["score"], 5), h["unit_id"]))
            assert set(got) == {0, 20, 40}
            for q, hits in got.items():
                want = sorted((-round(cos[q, j], 5), j) for j in range(50) if itself or j != q)[:5]
                assert sorted(hits) == want
    assert V.nearest(rows.limit(0), rows, "id", "v", 3).count() == 0 and V.nearest(rows, rows.limit(0), "id", "v", 3).count() == 0


def test_embeddings(spark, docs):
    got = {r["unit"]: r["embedding"] for r in M.embed(docs, "id", "text").collect()}
    assert all(len(v) == 384 for v in got.values()) and not any(got[3]) and not any(got[4])
    assert np.linalg.norm(got[1]) == pytest.approx(1) and got[6] == got[7]
    more = {r["unit"]: r["embedding"] for r in M.embed_with_features(docs, "id", "text").collect()}
    assert len(more[3]) == 391 and more[1][:384] == got[1]
    assert spark.range(1).select(M.place(F.lit("é語"), 2).alias("p")).first()["p"] == int(__import__("hashlib").sha256("é語_2".encode()).hexdigest(), 16) % 384


def units(spark, rows):
    made = [(f"u{i}", i, f, n, t, c, a, b, [], None) for i, (f, n, t, c, a, b) in enumerate(rows)]
    return spark.createDataFrame(made, "id string, k long, file_path string, name string, symbol_type string, content string, line_start int, line_end int, parameters array<string>, doc string")


def test_edges(spark):
    u = units(
        spark,
        [
            ("a.py", "Base", "class", "class Base(object):\n  pass", 1, 2), ("a.py", "Kid", "class", "class Kid(Base, metaclass=Meta):\n  def go(self): run(1); run (2); print(3)", 4, 9), ("a.py", "go", "method", "def go(self): run(1); go(); x.run(2)", 5, 6),
            ("b.py", "run", "function", "def run(n):\n  return Kid(n) if n else run(n - 1)", 1, 3), ("b.py", "x", "variable", None, 5, 5), ("b.py", "run", "function", "", 7, 8),
        ],
    )
    pairs = lambda df: sorted((r["src"], r["dst"]) for r in df.collect())
    assert pairs(E.calls(u)) == [("u2", "u5"), ("u2", "u5"), ("u3", "u1"), ("u3", "u5"), ("u3", "u5")]  # the last "run" stands for the name; go doesn't call itself
    assert [(r["src"], r["dst"], r["count"], r["weight"]) for r in E.weighed_calls(u).orderBy("src", "dst").collect()] == [("u2", "u5", 2, 0.5), ("u3", "u1", 1, 0.4)]
    assert pairs(E.inheritance(u)) == [("u1", "u0")] and pairs(E.class_methods(u)) == [("u0", "u2"), ("u1", "u2")]
    assert {(r["src"], r["dst"], r["containment_type"]) for r in E.class_members(u).collect()} == {("u1", "u2", "class_contains_method")}
    f = spark.createDataFrame([("f", "a.py", "from m import run, Kid\nimport Base\n"), ("g", "c.py", None)], "id string, file_path string, content string")
    got = {(r["src"], r["dst"], r["import_type"], r["imported_from"]) for r in E.file_imports(f, u).collect()}
    assert got == {("f", "u5", "direct", "from m import run, Kid"), ("f", "u1", "unknown", "from m import run, Kid"), ("f", "u0", "direct", "import Base")}
    assert {r["dst"] for r in E.file_symbols(f, u).collect()} == {"u0", "u1", "u2"}
    assert E.relationships(f, u.limit(0)).count() == 0
    text = "\n".join(f"line {i}" for i in range(9))
    d = spark.createDataFrame([("a", text), ("b", "x\n" + text), ("c", text[:20]), ("d", None)], "id string, content string")
    assert {(r["id"], r["other"], r["common"]) for r in E.duplicated(d).collect()} == {("a", "b", 6), ("b", "a", 6)}


def test_findings(spark):
    code = "x = 1\ndef f(a):\n    eval('x'); eval('y')\n    return 25 * a\n\nclass A:\n    '''no'''\n" + "def g():\n" + "    pass\n" * 60
    u = units(spark, [("a.py", "f", "function", code, 1, 9), ("a.py", "n", "function", None, 1, 1), ("a.py", "e", "function", "", 1, 1)])
    got = sorted((r["issue"], r["line_number"]) for r in A.findings(u).collect())
    assert got == [("command_injection", 3), ("command_injection", 3), ("long_function", 8), ("magic_numbers", 4), ("missing_documentation", 2), ("missing_documentation", 6), ("missing_documentation", 8)]
    assert {r["snippet"] for r in A.findings(u, "security").collect()} == {"\n".join(code.split("\n")[:5])} and A.findings(u.limit(0)).count() == 0


def test_ranking(spark):
    now = "2024-02-01 00:00:00"
    rows = [(f"u{i}", f"f{i % 3}", ("class", "function", None)[i % 3], "run it " * (i % 5), ["Run"] * (i % 2), datetime.datetime(2024, 1, 1 + i % 28), "python", None) for i in range(30)]
    u = spark.createDataFrame(rows, "id string, file_path string, symbol_type string, content string, keywords array<string>, updated_at timestamp, file_type string, semantic double")
    s = R.signals(u, ["run"], now)
    order = [(r["score"], r["id"]) for r in R.ranked(s, k=30).collect()]
    assert order == sorted(order, key=lambda x: (-x[0], x[1]))
    rest = {r["id"]: (r["score"], r) for r in s.select("id", "file_path", "symbol_type", F.length("content").alias("n"), R.score().alias("score")).collect()}
    want = []
    while rest:
        top = min(rest, key=lambda i: (-rest[i][0], i))
        score, a = rest.pop(top)
        want.append((top, pytest.approx(score)))
        for i, (x, b) in rest.items():
            near = 0.4 * (a["file_path"] == b["file_path"]) + 0.3 * (a["symbol_type"] is not None and a["symbol_type"] == b["symbol_type"]) + (0.3 * min(a["n"], b["n"]) / max(a["n"], b["n"]) if min(a["n"], b["n"]) else 0)
            rest[i] = (x * (1 - 0.3 * min(1, near)), b)
    assert [(r["id"], r["score"]) for r in R.diverse(s, 30).orderBy("rank").collect()] == want
    w = R.learned([(0, {"text_relevance": 0.9})])
    assert sum(w.values()) == pytest.approx(1) and w["text_relevance"] > 0.3 and R.learned([]) == R.WEIGHTS and R.learning_stats([(0, {})])["feedback_count"] == 1
    assert R.parsed_filters("file:a, type:class,x") == {"file": "a", "type": "class"}
    assert R.page(u, [F.col("id")], 28, 0).count() == 2


def test_front_and_ignore(spark):
    said = spark.createDataFrame([("What is connected to x?",), ("",), (None,), ("zebra",)], "q string")
    got = {r["q"]: r["intent"] for r in Q.classified(said, "q").collect()}
    assert got["What is connected to x?"] == "graph" and got["zebra"] == "search" and got[""] == "search"
    assert Q.command("/a b") == ("search", "a b") and Q.command(":q") == ("command", "q") and Q.command("x") == ("query", "x")
    assert Q.context_score({"view": "the Graph", "b": 1}, {"view": ("graph",), "b": ("2",)}) == 0.5
    paths = ["a.log", "keep.log", "dir/x.py", "x/dir/y.py", "dir", "root_only", "x/root_only", "a/q/b", "z.py", "q[1].txt"]
    rules = X.parse_ignore("# c\n\n*.log\n!keep.log\ndir/\n/root_only\na/**/b\nq[[]1].txt\n")
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"] for r in rows.where(X.ignored(F.col("path"), rules)).collect()} == {"a.log", "dir/x.py", "x/dir/y.py", "root_only", "x/root_only", "a/q/b", "q[1].txt"}
    assert rows.where(X.ignored(F.col("path"), [])).count() == 0


def test_changes(spark):
    snap = lambda *r: spark.createDataFrame(list(r), "path string, content_hash string")
    old, new = snap(("a", "1"), ("b", "1"), ("c", "1")), snap(("b", "2"), ("c", "1"), ("d", "1"))
    assert {tuple(r) for r in N.changes(old, new).collect()} == {("a", "deleted"), ("b", "modified"), ("d", "added")}
    got, registry = N.changed_of(old, new)
    assert {tuple(r) for r in got.collect()} == {("b", "modified"), ("d", "added")} and {tuple(r) for r in registry.collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}
    assert N.changes(old.limit(0), new.limit(0)).count() == 0
    a, b = "one\ntwo\nthree\nfour", "one\n2\nthree\nfour\nfive"
    r = N.line_changes(spark.createDataFrame([("p", a, b), ("q", None, ""), ("r", a, a)], "path string, old string, new string")).collect()
    said = list(difflib.unified_diff(a.split("\n"), b.split("\n"), lineterm=""))
    assert (r[0]["lines_added"], r[0]["lines_removed"]) == (sum(x.startswith("+") and not x.startswith("+++") for x in said), sum(x.startswith("-") and not x.startswith("---") for x in said)) and r[1]["lines_added"] == r[2]["lines_added"] == 0


def test_pair_similarity_is_what_its_sql_makes(spark):
    # ties at the sixth digit too, so no tolerance
    duckdb = pytest.importorskip("duckdb")
    from lodestone.plans import code_search, registry

    folder = "/root/testdata/sf0.01"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet'")
        want = set(db.execute(registry.oracle_sql()["rk10_pair_similarity"]).fetchall())
    assert {tuple(r) for r in code_search.rk10(spark, folder).collect()} == want


def test_pairs_in_blocks(spark):
    # keys of none, one and several blocks, ties, and a null key, which meets nothing
    rows = [(i, "pqr"[i % 3] if i % 7 else None, i // 2) for i in range(40)] + [(99, "alone", 1)]
    df = spark.createDataFrame(rows, "id int, f string, k int")
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[1] is not None and x[1] == y[1] and x[2] < y[2])
    for block in (1, 3, 1000):
        got = B.ordered_pairs(df, "f", "k", block)
        assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == want
        a, b = df.where("id % 2 = 0").select("f", F.col("id").alias("x")), df.where("id % 2 = 1").select("f", F.col("id").alias("y"))
        want_all = sorted((x[0], y[0]) for x in rows for y in rows if x[1] is not None and x[1] == y[1] and x[0] % 2 == 0 and y[0] % 2 == 1)
        assert sorted((r["x"], r["y"]) for r in B.pairs(a, b, "f", "x", "y", block).collect()) == want_all


def test_pair_similarity_counts_a_text_once(spark):
    # texts took part in the join, and each was read again for each pair
    from lodestone.plans import code_search

    plan = code_search.rk10(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join Inner")[0]
    assert "Join Inner" in plan and "class " not in joined and "content" not in joined and "length" not in joined


def test_duplicated_ids_are_those_of_the_pairs(spark):
    import random

    rng = random.Random(7)
    rows = [(f"r{i}", "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))) for i in range(60)]  # short runs that many share
    rows += [(f"s{i}", "\n".join(str(rng.randint(0, 12)) for _ in range(rng.randint(4, 12)))) for i in range(60)]
    rows += [("x1", "p\nq\nr\ns\n1\n2\n3\n4\n5\np\nq\nr\ns\n6\nt\nu\nv\nw"), ("x2", "t\nu\nv\nw\n0\np\nq\nr\ns"), ("x3", "p\nq\nr\ns\n9"), ("n", None), ("e", "")]
    d = spark.createDataFrame(rows, "id string, content string")
    pairs = {r["id"] for r in E.duplicated(d).collect()}
    got = [r["id"] for r in E.duplicated_ids(d).collect()]
    assert set(got) == pairs and len(got) == len(pairs) and "x1" in pairs and "x2" not in pairs
    # a run that all units have made pairs of all of them
    same = spark.range(3000).selectExpr("concat('u', id) AS id", "concat('a', id, repeat('\\ny = y + 1', 40)) AS content")
    assert E.duplicated_ids(same).count() == 3000


def test_members_and_counts_without_all_pairs(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(150):
        start = rng.randint(-5, 400)
        rows.append((f"{i % 3}.py", f"n{i % 40}", rng.choice(["class", "class", "method", "function"]), "def f(): n1(); n2()", start, start + rng.choice([-3, 0, 1, 2, 7, 8, 49, 63, 64, 300])))
    rows += [("0.py", "none", "class", "x", None, 5), ("0.py", "none", "method", "x", 5, None)]
    u = units(spark, rows)
    ids = [f"u{i}" for i in range(len(rows))]
    want = {(ids[c], ids[m]) for c, x in enumerate(rows) for m, y in enumerate(rows) if c != m and x[2] == "class" and x[0] == y[0] and None not in (*x[4:], *y[4:]) and y[4] > x[4] and y[5] <= x[5]}
    got = [(r["src"], r["dst"]) for r in E.class_members(u).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    plan = E.class_members(u)._jdf.queryExecution().optimizedPlan().toString()
    assert "(bin#" in plan  # not by the file alone
    # repeated rows, and an id in two files
    more = u.union(u.where("id in ('u1', 'u4', 'u5', 'u8')")).union(u.where("id in ('u0', 'u3', 'u2', 'u7')").withColumn("file_path", F.lit("1.py")))
    f = spark.createDataFrame([("f", "0.py", "import n1\n")], "id string, file_path string, content string")
    grouped = E.relationships(f, more).groupBy("src", "dst", "relation_type", "weight").agg(F.count("*").alias("times"))
    assert sorted(map(tuple, E.counted_relationships(f, more).collect())) == sorted(map(tuple, grouped.collect()))
    # texts of units are never sent to all tasks
    assert "Broadcast" not in E.usages(u)._jdf.queryExecution().executedPlan().toString()


def test_scores_are_held_in_blocks(monkeypatch):
    # the scores of all queries with 2048 rows were held at once
    import tracemalloc

    import pyarrow as pa

    x = np.random.default_rng(5).normal(size=(6000, 4)).round(1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6000)), pa.array(x.tolist())], ["id", "v"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(V._nearest(np.arange(6000), unit, 3, False)(iter([batch]))))
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    score = np.round(unit @ unit.T, 6)
    np.fill_diagonal(score, -np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(6000), score.shape), -score))[:, :3]
    assert got["unit_id"].to_numpy().reshape(-1, 3).tolist() == want.tolist()


def test_a_scan_finds_what_the_store_finds(spark, docs, tmp_path):
    # one search built the whole index first
    built, scan = I.IndexStore.build(docs, "id", "text", str(tmp_path / "again")), I.IndexScan(docs, "id", "text")
    rows = lambda df: [tuple(r) for r in df.collect()]
    for terms in (["pars", "function", "pars"], ["nothing"], []):
        assert scan.size() == built.size() and rows(scan.search(terms, 5)) == rows(built.search(terms, 5)) and sorted(rows(scan.of(terms))) == sorted(rows(built.of(terms)))
    for terms in (["parsr", "über"], ["zzzzzzzzz"]):
        assert sorted(rows(scan.near(terms, 2, 3))) == sorted(rows(built.near(terms, 2, 3))) and rows(scan.fuzzy(terms, 5)) == rows(built.fuzzy(terms, 5))
    assert sorted(rows(scan.matching("(?i)^P").select("term", "unit_id", "tf"))) == sorted(rows(built.matching("(?i)^P").select("term", "unit_id", "tf"))) and sorted(rows(scan.starting("p"))) == sorted(rows(built.starting("p")))
