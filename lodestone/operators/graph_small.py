"""Graph operators whose algorithms go node by node: betweenness, strong components, bridges, articulation points, search orders.

They take a graph that fits the memory of one task, of at most LOCAL_EDGES edges,
and say so where it doesn't; strong components have a distributed way beyond.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import LOCAL_EDGES
from lodestone.operators.durable import durable


def _adjacency(edges: DataFrame, most: int = LOCAL_EDGES) -> dict:
    """Sorted distinct out-neighbours by node; raises where there are too many edges."""
    rows = edges.select("src", "dst").distinct().limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"this operator takes graphs of at most {most} edges")
    out: dict = {}
    for a, b in zip(rows["src"].to_pylist(), rows["dst"].to_pylist()):
        out.setdefault(a, []).append(b)
    return {k: sorted(v) for k, v in out.items()}


def betweenness(edges: DataFrame, nodes: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """(id, centrality): the share of shortest paths that go through a node, by Brandes' accumulation from every source, over (n - 1)(n - 2).

    Sources are spread over the tasks, each of which holds the graph; contributions are summed by node.
    """
    spark = edges.sparkSession
    graph = spark.sparkContext.broadcast(_adjacency(edges, most))  # at most ``most`` edges
    n = nodes.count()
    kind = nodes.schema["id"].dataType.simpleString()

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for batch in batches:
            for source in batch["id"]:
                order, before, paths, depth = [], {}, {source: 1.0}, {source: 0}
                queue = deque([source])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in graph.value.get(v, ()):
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            before.setdefault(w, []).append(v)
                need = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        need[v] += paths[v] / paths[w] * (1 + need[w])
                    if w != source:
                        total[w] = total.get(w, 0.0) + need[w]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    parts = nodes.select("id").distinct().mapInPandas(accumulate, f"id {kind}, part double")
    summed = parts.groupBy("id").agg(F.sum("part").alias("s"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.select("id").join(summed, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * scale).alias("centrality"))


def _tarjan(graph: dict, nodes: list) -> dict:
    """The least node of each node's strong component."""
    index, low, on, stack, out = {}, {}, set(), [], {}
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(graph.get(root, ())))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(graph.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    least = min(group)
                    out.update(dict.fromkeys(group, least))
    return out


def strong_components(edges: DataFrame, nodes: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, component): component is the least node that an id reaches and is reached from.

    Small graphs are worked out in the driver. Beyond, nodes take the least node
    that reaches them as colour until none changes; those of a colour that reach
    its own node are one component, and the rest goes round again.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    e = durable(edges.select("src", "dst").where("src <> dst").distinct())
    if e.count() <= local_edges:
        ids = [r["id"] for r in nodes.select("id").distinct().limit(2 * local_edges + 1).collect()]
        if len(ids) <= 2 * local_edges:
            found = _tarjan(_adjacency(e, local_edges), sorted(ids))
            return edges.sparkSession.createDataFrame([(i, found[i]) for i in ids], f"id {kind}, component {kind}")
    left, done = durable(nodes.select("id").distinct()), None
    while not left.isEmpty():
        inside = durable(e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
        colour = left.select("id", F.col("id").alias("colour"))
        while True:
            offer = inside.join(colour.select(F.col("id").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("o"))
            moved = durable(colour.join(offer, "id", "left").select("id", "colour", F.least("colour", "o").alias("new")))
            colour = moved.select("id", F.col("new").alias("colour"))
            if moved.where("new <> colour").isEmpty():
                break
        colour = durable(colour)
        front = seen = colour.where("id = colour")
        within = inside.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        within = durable(within.select("src", "dst"))
        while not front.isEmpty():
            back = within.join(front.select(F.col("id").alias("dst"), "colour"), "dst").select(F.col("src").alias("id"), "colour").distinct()
            front = durable(back.join(seen.select("id"), "id", "left_anti"))
            seen = durable(seen.union(front))
        done = seen if done is None else done.union(seen)
        left = durable(left.join(seen.select("id"), "id", "left_anti"))
    return done.select("id", F.col("colour").alias("component")) if done is not None else nodes.select("id", F.col("id").alias("component")).limit(0)


def _low_links(rows: pd.DataFrame) -> tuple[list, list]:
    """(bridges, articulation points) of an undirected graph of distinct edges src < dst."""
    around: dict = {}
    for a, b in zip(rows["src"], rows["dst"]):
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    index, low, bridges, points = {}, {}, [], set()
    for root in sorted(around):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        work, kids = [(root, None, iter(around[root]))], 0
        while work:
            v, above, rest = work[-1]
            for w in rest:
                if w == above:
                    continue
                if w in index:
                    low[v] = min(low[v], index[w])
                    continue
                index[w] = low[w] = len(index)
                work.append((w, v, iter(around[w])))
                break
            else:
                work.pop()
                if not work:
                    continue
                up = work[-1][0]
                low[up] = min(low[up], low[v])
                if low[v] > index[up]:
                    bridges.append((min(up, v), max(up, v)))
                if up == root:
                    kids += 1
                elif low[v] >= index[up]:
                    points.add(up)
        if kids > 1:
            points.add(root)
    return bridges, sorted(points)


def _by_component(edges: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int) -> DataFrame:
    from lodestone.operators.components import connected_components

    e = durable(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    labelled = durable(e.join(connected_components(e).select(F.col("id").alias("src"), "component"), "src"))
    largest = labelled.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        raise ValueError(f"a component has {largest} edges; at most {most} fit")
    return labelled.groupBy("component").applyInPandas(work, schema)


def bridges(edges: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """(src, dst), src < dst: edges, taken without direction, whose removal parts their component. Components are worked on side by side."""
    kind = edges.schema["src"].dataType.simpleString()

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_low_links(rows)[0], columns=["src", "dst"])

    return _by_component(edges, work, f"src {kind}, dst {kind}", most)


def articulation_points(edges: DataFrame, most: int = LOCAL_EDGES) -> DataFrame:
    """(id): nodes whose removal parts their component, edges taken without direction."""
    kind = edges.schema["src"].dataType.simpleString()

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": _low_links(rows)[1]})

    return _by_component(edges, work, f"id {kind}", most)


def dfs_order(edges: DataFrame, start, max_depth: int | None = None, most: int = LOCAL_EDGES) -> list:
    """Nodes in the order of a depth-first search with a stack, lesser neighbours first; a node is marked when it is put on the stack."""
    graph = _adjacency(edges, most)
    seen, stack, out = {start}, [(start, 0)], []
    while stack:
        v, depth = stack.pop()
        out.append(v)
        if max_depth is not None and depth >= max_depth:
            continue
        for w in reversed(graph.get(v, [])):
            if w not in seen:
                seen.add(w)
                stack.append((w, depth + 1))
    return out


def a_star(edges: DataFrame, start, target, heuristic: Callable, most: int = LOCAL_EDGES) -> tuple[list, float] | None:
    """(path, cost) of the cheapest path by cost 1 - weight, not below 0, or None; heuristic(node, target) never says more than the cost that is left."""
    rows = edges.groupBy("src", "dst").agg(F.min(F.greatest(F.lit(0.0), 1 - F.col("weight"))).alias("cost")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"this operator takes graphs of at most {most} edges")
    graph: dict = {}
    for r in rows:
        graph.setdefault(r["src"], []).append((r["dst"], r["cost"]))
    heap, best = [(heuristic(start, target), 0.0, [start])], {start: 0.0}
    while heap:
        _, cost, path = heappop(heap)
        v = path[-1]
        if v == target:
            return path, cost
        if cost > best[v] + 1e-12:
            continue
        for w, c in graph.get(v, ()):
            if cost + c < best.get(w, float("inf")) - 1e-12:
                best[w] = cost + c
                heappush(heap, (cost + c + heuristic(w, target), cost + c, [*path, w]))
    return None
