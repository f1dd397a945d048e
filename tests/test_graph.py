"""Graph operators against plain Python: diamonds, cycles, parallel edges, dangling nodes, separate parts, and no edges; small and joined ways."""

import itertools
import random
from collections import deque

import numpy as np
import pytest

from lodestone.operators import graph as G
from lodestone.operators import graph_small as H
from lodestone.operators.components import connected_components

EDGES = "src long, dst long, weight double, relation_type string"
SHAPES = {
    "diamond": [(1, 2, 0.9), (1, 3, 0.5), (2, 4, 0.4), (3, 4, 0.8)],
    "cycle": [(1, 2, 0.5), (2, 3, 0.5), (3, 1, 0.5), (3, 4, 1.0)],
    "multi": [(1, 2, 0.2), (1, 2, 0.8), (1, 2, 0.5), (2, 2, 0.1)],
    "split": [(5, 1, 0.3), (2, 3, 0.6), (3, 2, 0.6), (7, 6, 0.9)],
    "none": [],
}


def random_edges():
    r = random.Random(5)
    return [(r.randint(1, 14), r.randint(1, 14), round(r.random(), 3)) for _ in range(34)]


@pytest.fixture(params=[*SHAPES, "random"])
def graph(request, spark):
    rows = SHAPES.get(request.param, random_edges() if request.param == "random" else None)
    nodes = sorted({x for a, b, _ in rows for x in (a, b)} | {20})
    return rows, nodes, spark.createDataFrame([(a, b, w, "calls") for a, b, w in rows], EDGES), spark.createDataFrame([(n,) for n in nodes], "id long")


def distances(rows, start):
    out, seen, queue = {}, {start: 0}, deque([start])
    for a, b, _ in rows:
        out.setdefault(a, set()).add(b)
    while queue:
        v = queue.popleft()
        for w in out.get(v, ()):
            if w not in seen:
                seen[w] = seen[v] + 1
                queue.append(w)
    return seen


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_reach_and_components(graph, local):
    rows, nodes, edges, ids = graph
    want = {(s, n, d) for s in nodes for n, d in distances(rows, s).items() if d <= 3}
    assert {tuple(r) for r in G.bfs(edges, ids, 3, local).collect()} == want
    reach = {s: set(distances(rows, s)) for s in nodes}
    strong = {r["id"]: r["component"] for r in H.strong_components(edges, ids, local).collect()}
    assert strong == {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    both = rows + [(b, a, w) for a, b, w in rows]
    weak = {r["id"]: r["component"] for r in connected_components(edges, "src", "dst", local).collect()}
    assert weak == {n: min(distances(both, n)) for n in {x for a, b, _ in rows for x in (a, b)}}
    start = ids.where(f"id = {nodes[0]}")
    best = {nodes[0]: 0.0}
    for _ in nodes:
        for a, b, w in rows:
            if a in best:
                best[b] = min(best.get(b, 9e9), best[a] + 1 - w)
    assert {r["id"]: pytest.approx(r["distance"]) for r in G.dijkstra(edges, start, local_edges=local).collect()} == best
    paths = {r["id"]: r for r in G.shortest_paths(edges, start).collect()}
    assert {n: pytest.approx(p["distance"]) for n, p in paths.items()} == best
    pairs = {(a, b) for a, b, _ in rows}
    assert all(p["path"][0] == nodes[0] and p["path"][-1] == n and set(zip(p["path"], p["path"][1:])) <= pairs for n, p in paths.items())


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_ranks(graph, local):
    rows, nodes, edges, ids = graph
    n, at = len(nodes), {x: i for i, x in enumerate(nodes)}
    links = np.zeros((n, n))
    for a, b, _ in rows:
        links[at[b], at[a]] += 1
    out = links.sum(axis=0)
    x = np.full(n, 1 / n)
    for _ in range(10):
        x = 0.15 / n + 0.85 * (links / np.where(out > 0, out, 1)) @ x
    got = {r["id"]: r["rank"] for r in G.pagerank(edges, ids, rounds=10, tolerance=0.0, local_edges=local).collect()}
    assert [got[i] for i in nodes] == pytest.approx(x.tolist(), abs=1e-9)
    y = np.full(n, 1 / n**0.5)
    for _ in range(6):
        z = (links > 0).astype(float).T @ y
        y = z / np.sqrt((z * z).sum()) if z.any() else z
    got = {r["id"]: r["centrality"] for r in G.eigenvector(edges, ids, rounds=6, tolerance=0.0, local_edges=local).collect()}
    assert [got[i] for i in nodes] == pytest.approx(y.tolist(), abs=1e-9)


def test_structure(graph, spark):
    rows, nodes, edges, ids = graph
    pairs = {(a, b) for a, b, _ in rows if a != b}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}
    want = {}
    for v in nodes:
        k, links = len(out[v]), sum((a, b) in pairs for a in out[v] for b in out[v])
        want[v] = links // 2 / (k * (k - 1) / 2) if k > 1 else 0.0
    assert {r["id"]: r["coefficient"] for r in G.clustering(edges, ids).collect()} == pytest.approx(want)
    near = {frozenset(p) for p in pairs}

    def parts(links):
        both = [(a, b, 0) for a, b in links] + [(b, a, 0) for a, b in links]
        return len({min(distances(both, n)) for n in nodes})

    und = [tuple(sorted(p)) for p in near]
    bridges = {p for p in und if parts([q for q in und if q != p]) > parts(und)}
    assert {(r["src"], r["dst"]) for r in H.bridges(edges).collect()} == bridges
    points = set()
    for v in nodes:
        rest = [p for p in und if v not in p]
        left = {n for n in nodes if n != v}
        both = [(a, b, 0) for a, b in rest] + [(b, a, 0) for a, b in rest]
        if len({min(distances(both, n)) for n in left}) > parts(und) - (0 if any(v in p for p in und) else 1):
            points.add(v)
    assert {r["id"] for r in H.articulation_points(edges).collect()} == points

    def shortest(s, t):
        """All shortest paths, by growing them."""
        front = [[s]]
        while front:
            if done := [p for p in front if p[-1] == t]:
                return done
            front = [[*p, w] for p in front for w in sorted(out[p[-1]]) if w not in p]
            if front and len(front[0]) > len(nodes):
                return []
        return []

    if len(nodes) < 9:
        score = dict.fromkeys(nodes, 0.0)
        for s, t in itertools.permutations(nodes, 2):
            found = shortest(s, t)
            for p in found:
                for v in p[1:-1]:
                    score[v] += 1 / len(found)
        n = len(nodes)
        scale = (n - 1) * (n - 2) if n > 2 else 1
        assert {r["id"]: r["centrality"] for r in H.betweenness(edges, ids).collect()} == pytest.approx({v: x / scale for v, x in score.items()})
        some = {(s, t): shortest(s, t) for s, t in itertools.permutations(nodes[:3], 2)}
        for (s, t), found in some.items():
            got = G.path_between(edges, s, t, 20)
            assert got in found if found else got == []
        loops = {tuple(p) for k in range(1, 6) for p in itertools.permutations(nodes, k) if p[0] == min(p) and all((a, b) in {(x, y) for x, y, _ in rows} for a, b in zip(p, [*p[1:], p[0]]))}
        assert {tuple(r["cycle"]) for r in G.cycles(edges, 5).collect()} == loops
    level = {}
    acyclic = not any((n in distances(rows, b)) for n in nodes for b in {b for a, b, _ in rows if a == n})
    if acyclic:
        for _ in nodes:
            for v in nodes:
                level[v] = max((level.get(a, 0) + 1 for a, b, _ in rows if b == v), default=0)
        assert {r["id"]: r["level"] for r in G.topological_levels(edges, ids).collect()} == level
    else:
        with pytest.raises(ValueError, match="cycle"):
            G.topological_levels(edges, ids)
    degree = {r["id"]: (r["in_degree"], r["out_degree"]) for r in G.degrees(edges, ids).collect()}
    assert degree == {n: (sum(b == n for _, b, _ in rows), len({b for a, b, _ in rows if a == n})) for n in nodes}
    order = H.dfs_order(edges, nodes[0])
    assert order[0] == nodes[0] and set(order) == set(distances(rows, nodes[0])) and len(order) == len(set(order))
    labels = {r["id"]: r["community"] for r in G.communities(edges, ids).collect()}
    assert set(labels) == set(nodes) and labels[20] == 20
    assert G.density(edges, ids) == pytest.approx(len(rows) / max(1, len(nodes) * (len(nodes) - 1) / 2))


def test_searches_and_upkeep(spark):
    rows = SHAPES["diamond"] + SHAPES["cycle"]
    edges = spark.createDataFrame([(a, b, w, "calls") for a, b, w in rows], EDGES)
    assert H.a_star(edges, 1, 4, lambda *_: 0.0) == ([1, 3, 4], pytest.approx(0.5))
    assert H.a_star(edges, 4, 1, lambda *_: 0.0) is None
    assert {tuple(r["path"]) for r in G.simple_paths(edges, 1, 4, 4).collect()} == {(1, 2, 4), (1, 3, 4), (1, 2, 3, 4)}
    one = spark.createDataFrame([(2,)], "id long")
    assert {r["id"] for r in G.neighbours(edges, one).collect()} == {1, 3, 4} and {r["id"] for r in G.neighbours(edges, one, 1, "in").collect()} == {1}
    assert {r["id"] for r in G.neighbours(edges, one, 2).collect()} == {1, 3, 4}
    ids = spark.createDataFrame([(i,) for i in range(1, 5)], "id long")
    whole, more = G.grown(ids, edges, spark.createDataFrame([(4,), (9,)], "id long"), spark.createDataFrame([(9, 1, 1.0, "uses"), (9, 77, 1.0, "uses")], EDGES))
    assert whole.count() == 5 and more.count() == len(rows) + 1
    rest, left = G.shrunk(whole, more, one, spark.createDataFrame([(9, 1, "uses")], "src long, dst long, relation_type string"))
    assert rest.count() == 4 and {(r["src"], r["dst"]) for r in left.collect()} == {(1, 3), (3, 4), (3, 1)}
    with pytest.raises(ValueError, match="at most"):
        H.betweenness(edges, ids, most=2)
    lines = [r["line"] for r in G.dot(edges).collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and len(lines) == len(rows) + 2
