"""Graph operators over edges (src, dst, weight), as joins and bounded loops."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import LOCAL_EDGES
from lodestone.operators.durable import durable
from lodestone.operators.edges import unsent


def _walked(cost: DataFrame, starts: DataFrame, walk: Callable[[dict, object], dict], kind: str, local_edges: int) -> DataFrame | None:
    """(start, id, distance) by a walk from each start in the tasks, which hold the graph (src, dst, cost); None where it is too large to be sent."""
    if cost.count() > local_edges:  # of a checkpoint: nothing is brought to the driver to be thrown away
        return None
    rows = cost.toArrow().to_pandas()
    graph: dict = {}
    for a, b, c in zip(rows["src"].tolist(), rows["dst"].tolist(), rows["cost"].tolist()):
        graph.setdefault(a, []).append((b, c))
    sent = cost.sparkSession.sparkContext.broadcast(graph)  # at most ``local_edges`` edges

    def from_starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        start, ids, distance = [], [], []
        for batch in batches:
            for s in batch["id"].tolist():
                found = walk(sent.value, s)
                start += [s] * len(found)
                ids += found
                distance += found.values()
                if len(ids) > 100_000:
                    yield pd.DataFrame({"start": start, "id": ids, "distance": distance})
                    start, ids, distance = [], [], []
        if ids:
            yield pd.DataFrame({"start": start, "id": ids, "distance": distance})

    id_kind = starts.schema["id"].dataType.simpleString()
    return starts.select("id").mapInPandas(from_starts, f"start {id_kind}, id {id_kind}, distance {kind}")


def kept_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    a, b = nodes.select(F.col("id").alias("src")), nodes.select(F.col("id").alias("dst"))
    return edges.join(unsent(a), "src", "left_semi").join(unsent(b), "dst", "left_semi").select(edges.columns)


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree): in-degree counts parallel edges, out-degree distinct neighbours."""
    i = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    o = edges.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("out_degree"))
    return nodes.select("id").join(i, "id", "left").join(o, "id", "left").na.fill(0, ["in_degree", "out_degree"])


def bfs(edges: DataFrame, starts: DataFrame, max_depth: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(start, id, distance) of all that lies within max_depth hops of each start, the start at 0.

    A graph of up to ``local_edges`` edges goes to the tasks, which walk it from
    their starts; a larger one is joined front by front.
    """
    step = durable(edges.select("src", "dst").distinct())

    def walk(graph: dict, start) -> dict:
        seen, front = {start: 0}, [start]
        for depth in range(1, max_depth + 1):
            front = [w for w in dict.fromkeys(w for v in front for w, _ in graph.get(v, ())) if w not in seen]
            if not front:
                break
            seen.update(dict.fromkeys(front, depth))
        return seen

    near = _walked(step.withColumn("cost", F.lit(1)), starts, walk, "int", local_edges)
    if near is not None:
        return near
    seen = durable(starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("distance")))
    front = seen
    for depth in range(1, max_depth + 1):
        near = front.join(step, front["id"] == step["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = durable(near.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def dijkstra(edges: DataFrame, start: DataFrame, max_hops: int = 1000, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, distance): least sum of 1 - weight, not below 0 an edge, from the nearest start.

    A graph of up to ``local_edges`` edges is walked in a task for each start; in a
    larger one only the edges of what got nearer are relaxed, round by round.
    """
    cost = durable(edges.groupBy("src", "dst").agg(F.min(F.greatest(F.lit(0.0), 1 - F.col("weight"))).alias("cost")))

    def walk(graph: dict, s) -> dict:
        best, heap = {s: 0.0}, [(0.0, s)]
        while heap:
            d, v = heappop(heap)
            if d > best[v]:
                continue
            for w, c in graph.get(v, ()):
                if d + c < best.get(w, float("inf")):
                    best[w] = d + c
                    heappush(heap, (d + c, w))
        return best

    near = _walked(cost, start, walk, "double", local_edges)
    if near is not None:
        return near.groupBy("id").agg(F.min("distance").alias("distance"))
    best = durable(start.select("id", F.lit(0.0).alias("distance")))
    front = best
    for _ in range(max_hops):
        offer = front.join(cost, front["id"] == cost["src"]).groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("cost")).alias("offer"))
        merged = durable(
            best.join(offer, "id", "full").select(
                "id", F.least("distance", "offer").alias("distance"), (F.col("offer").isNotNull() & (F.col("distance").isNull() | (F.col("offer") < F.col("distance") - 1e-12))).alias("nearer")
            )
        )
        best, front = merged.select("id", "distance"), merged.where("nearer").select("id", "distance")
        if front.isEmpty():
            break
    return best


def _shares(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    return edges.groupBy("src", "dst").agg(F.count("*").alias("times")).join(out, "src").select("src", "dst", (F.col("times") / F.col("out")).alias("share"))


def _iterated(links: DataFrame, nodes: DataFrame, step: Callable[[np.ndarray, Callable], tuple[np.ndarray, bool]], first: Callable[[int], float], rounds: int, name: str, local_edges: int) -> DataFrame | None:
    """(id, name) after rounds of a step in the driver, from links (to, of, w): a step gets the values and the sums that links bring; None for a large graph."""
    if max(links.count(), nodes.count()) > local_edges:  # of checkpoints: nothing is brought to the driver to be thrown away
        return None
    rows, ids = links.toArrow().to_pandas(), nodes.select("id").toArrow().to_pandas()["id"]
    place = pd.Index(ids)
    to, of, w = place.get_indexer(rows["to"]), place.get_indexer(rows["of"]), rows["w"].to_numpy(float)
    known = (to >= 0) & (of >= 0)
    to, of, w = to[known], of[known], w[known]
    x = np.full(len(ids), first(len(ids)) if len(ids) else 0.0)
    for _ in range(rounds):
        x, still = step(x, lambda v: np.bincount(to, v[of] * w, len(ids)))
        if still:
            break
    kind = nodes.schema["id"].dataType.simpleString()
    return links.sparkSession.createDataFrame(pa.table({"id": pa.Array.from_pandas(ids), name: pa.array(x, pa.float64())})).select(F.col("id").cast(kind).alias("id"), name)


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, rank) by synchronous rounds until no rank moves by ``tolerance``, or so many; the mass of nodes without an out-edge is dropped.

    A graph of up to ``local_edges`` edges and nodes is worked out in the driver. In
    a larger one lineage is cut every fifth round, and that is where it is seen
    whether ranks still move.
    """
    n = nodes.count()
    share, ids = durable(_shares(edges)), durable(nodes.select("id"))

    def step(x: np.ndarray, brought: Callable) -> tuple[np.ndarray, bool]:
        y = (1 - damping) / len(x) + damping * brought(x) if len(x) else x
        return y, np.abs(y - x).max(initial=0) < tolerance

    found = _iterated(share.select(F.col("dst").alias("to"), F.col("src").alias("of"), F.col("share").alias("w")), ids, step, lambda m: 1.0 / m, rounds, "rank", local_edges)
    if found is not None:
        return found
    ranks = ids.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for k in range(1, rounds + 1):
        given = share.join(unsent(ranks), share["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        before = ranks
        ranks = ids.join(unsent(given), "id", "left").select("id", ((1 - damping) / max(n, 1) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        if k % 5 == 0:
            both = durable(ranks.join(before.select("id", F.col("rank").alias("old")), "id"))
            ranks = both.select("id", "rank")
            if not (both.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0) >= tolerance:
                break
    return ranks


def eigenvector(edges: DataFrame, nodes: DataFrame, rounds: int = 100, tolerance: float = 1e-6, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, centrality): the sum of the out-neighbours' values, brought to length 1 each round; all 0 where nothing is left."""
    step, ids = durable(edges.select("src", "dst").distinct()), durable(nodes.select("id"))

    def once(v: np.ndarray, brought: Callable) -> tuple[np.ndarray, bool]:
        y = brought(v)
        size = np.sqrt((y * y).sum())
        y = y / size if size else np.zeros(len(v))
        return y, not size or np.abs(y - v).max(initial=0) < tolerance

    found = _iterated(step.select(F.col("src").alias("to"), F.col("dst").alias("of"), F.lit(1.0).alias("w")), ids, once, lambda m: 1.0 / m**0.5, rounds, "centrality", local_edges)
    if found is not None:
        return found
    n = ids.count()
    x = ids.withColumn("x", F.lit(1.0 / max(n, 1) ** 0.5))
    for _ in range(rounds):
        summed = step.join(x, step["dst"] == x["id"]).groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("s"))
        both = durable(x.select("id", F.col("x").alias("old")).join(summed, "id", "left").select("id", "old", F.coalesce("s", F.lit(0.0)).alias("s")))
        size = (both.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0) ** 0.5
        moved = both.select("id", "old", (F.col("s") / size if size else F.lit(0.0)).alias("x"))
        x = moved.select("id", "x")
        if not size or (moved.agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return x.select("id", F.col("x").alias("centrality"))


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, level): the length of the longest path from a source; raises where there is a cycle."""
    left = durable(edges.select("src", "dst").distinct())
    rest = durable(nodes.select("id").distinct())
    done, level = None, 0
    while not rest.isEmpty():
        free = durable(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        done = free if done is None else done.union(free)
        rest = durable(rest.join(free.select("id"), "id", "left_anti"))
        left = durable(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        level += 1
    return done if done is not None else nodes.select("id", F.lit(0).alias("level")).limit(0)


def clustering(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, coefficient): edges among the out-neighbours, halved and floored, over the pairs of them.

    Every edge x -> y looks for the nodes that point at both among those that point
    at the end with fewer: a hub's neighbours are never paired with each other.
    """
    e = durable(edges.select("src", "dst").where("src <> dst").distinct())
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    a, b = into.select(F.col("id").alias("src"), F.col("n").alias("a")), into.select(F.col("id").alias("dst"), F.col("n").alias("b"))
    few = e.join(a, "src", "left").join(b, "dst", "left").na.fill(0, ["a", "b"])
    x_first = F.col("a") <= F.col("b")
    few = few.select(F.when(x_first, F.col("src")).otherwise(F.col("dst")).alias("near"), F.when(x_first, F.col("dst")).otherwise(F.col("src")).alias("far"))
    over = few.join(e.select(F.col("src").alias("id"), F.col("dst").alias("near")), "near")
    closed = over.join(e.select(F.col("src").alias("id"), F.col("dst").alias("far")), ["id", "far"], "left_semi").groupBy("id").agg(F.count("*").alias("links"))
    k = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    value = F.when(F.col("k") > 1, F.floor(F.coalesce("links", F.lit(0)) / 2) / (F.col("k") * (F.col("k") - 1) / 2)).otherwise(0.0)
    return nodes.select("id").join(k, "id", "left").join(closed, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("coefficient"))


def grown(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame, more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with those that are new, and edges with more behind them, repeats kept; edges whose ends are missing go."""
    fresh = more_nodes.join(nodes.select("id"), "id", "left_anti").select(nodes.columns)
    whole = nodes.union(fresh)
    return whole, edges.union(kept_edges(more_edges, whole).select(edges.columns))


def shrunk(nodes: DataFrame, edges: DataFrame, gone_nodes: DataFrame, gone_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without some nodes, the edges at them, and some edges (src, dst, relation_type)."""
    rest = edges.join(unsent(gone_nodes.select(F.col("id").alias("src"))), "src", "left_anti").join(unsent(gone_nodes.select(F.col("id").alias("dst"))), "dst", "left_anti")
    rest = rest.join(unsent(gone_edges.select("src", "dst", "relation_type").distinct()), ["src", "dst", "relation_type"], "left_anti").select(edges.columns)
    return nodes.join(unsent(gone_nodes.select("id")), "id", "left_anti").select(nodes.columns), rest


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, direction: str | None = None) -> DataFrame:
    """(id): nodes within so many hops of the starts, those left out. direction: out, in or both; by default both at depth 1 and out beyond."""
    direction = direction or ("both" if depth == 1 else "out")
    out = edges.select("src", "dst")
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    step = {"out": out, "in": back, "both": out.union(back)}[direction]
    return bfs(step, start, depth).select("id").distinct().join(start.select("id"), "id", "left_anti")


def total_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, centrality): distinct out-neighbours and all in-edges over the other nodes; may exceed 1."""
    n = nodes.count()
    return degrees(edges, nodes).select("id", ((F.col("in_degree") + F.col("out_degree")) / float(max(n - 1, 1))).alias("centrality"))


def simple_paths(edges: DataFrame, start, target, max_nodes: int) -> DataFrame:
    """(path): all simple paths between two nodes with at most so many nodes, grown from the start by joins."""
    step = durable(edges.select("src", "dst").where("src <> dst").distinct())
    front = step.where(F.col("src") == F.lit(start)).select(F.array("src").alias("path"), "dst")
    found = front.where("false").select("path")
    for _ in range(max_nodes - 1):
        there = front.where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        there = durable(there)
        found = found.union(there.where(F.col("end") == F.lit(target)).select("path"))
        on = there.where(F.col("end") != F.lit(target))
        if on.isEmpty():
            break
        front = on.join(step, on["end"] == step["src"]).select("path", "dst")
    return found


def shortest_paths(edges: DataFrame, start: DataFrame, weighted: bool = True, max_distance: float | None = None, max_hops: int = 1000) -> DataFrame:
    """(id, distance, path) from the start to all that it reaches: by cost 1 - weight (not below 0), or by hops.

    Every node carries the path of its predecessor; of equally near ones the one with the lesser path.
    """
    cost = F.greatest(F.lit(0.0), 1 - F.col("weight")) if weighted else F.lit(1.0)
    step = durable(edges.groupBy("src", "dst").agg(F.min(cost).alias("cost")))
    best = durable(start.select("id", F.lit(0.0).alias("distance"), F.array("id").alias("path")))
    front = best
    for _ in range(max_hops):
        offer = front.join(step, front["id"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("id"), F.round(F.col("distance") + F.col("cost"), 12).alias("d"), F.concat("path", F.array("dst")).alias("p"))
        if max_distance is not None:
            offer = offer.where(F.col("d") <= max_distance)
        offer = offer.groupBy("id").agg(F.min(F.struct("d", F.size("p").alias("n"), "p")).alias("o"))
        better = F.col("o").isNotNull() & (F.col("distance").isNull() | (F.struct(F.col("o.d"), F.col("o.n"), F.col("o.p")) < F.struct(F.col("distance").alias("d"), F.size("path").alias("n"), F.col("path").alias("p"))))
        merged = durable(
            best.join(offer, "id", "full").withColumn("nearer", better).select("id", F.when(F.col("nearer"), F.col("o.d")).otherwise(F.col("distance")).alias("distance"), F.when(F.col("nearer"), F.col("o.p")).otherwise(F.col("path")).alias("path"), "nearer")
        )
        best, front = merged.select("id", "distance", "path"), merged.where("nearer").select("id", "distance", "path")
        if front.isEmpty():
            break
    return best


def path_between(edges: DataFrame, start, target, max_nodes: int = 5) -> list:
    """The nodes of a path with the fewest hops, at most so many nodes; [] where there is none. Searches from both ends, and stops where they meet."""
    spark = edges.sparkSession
    if start == target:
        return [start]
    kind = edges.schema["src"].dataType.simpleString()
    out = durable(edges.select("src", "dst").distinct())
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = [spark.createDataFrame([(x, [x])], f"id {kind}, path array<{kind}>") for x in (start, target)]
    seen, fronts, sizes = list(ends), list(ends), [1, 1]
    for _ in range(max_nodes - 1):
        side = 0 if sizes[0] <= sizes[1] else 1
        step = (out, back)[side]
        near = fronts[side].join(step, fronts[side]["id"] == step["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")).groupBy("id").agg(F.min("path").alias("path"))
        fronts[side] = durable(near.join(seen[side].select("id"), "id", "left_anti"))
        sizes[side] = fronts[side].count()
        if not sizes[side]:
            return []
        seen[side] = seen[side].union(fronts[side])
        met = fronts[side].join(seen[1 - side].select("id", F.col("path").alias("other")), "id")
        whole = F.concat("path", F.slice(F.reverse("other"), 2, 1 << 20)) if not side else F.concat("other", F.slice(F.reverse("path"), 2, 1 << 20))
        row = met.select(whole.alias("p")).orderBy(F.size("p"), "p").first()
        if row:
            return list(row["p"]) if len(row["p"]) <= max_nodes else []
    return []


def cycles(edges: DataFrame, max_nodes: int) -> DataFrame:
    """(cycle): the simple cycles of at most so many nodes, each once, from its least node on."""
    step = durable(edges.select("src", "dst").distinct())
    loops = step.where("src = dst").select(F.array("src").alias("cycle"))
    front = step.where("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("end"))
    for _ in range(max_nodes - 1):
        front = durable(front.join(step, front["end"] == step["src"]).select("path", "dst"))
        loops = loops.union(front.where(F.col("dst") == F.col("path")[0]).select(F.col("path").alias("cycle")))
        front = front.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end"))
        if front.isEmpty():
            break
    return loops


def out_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, weight): the weight of the last of parallel edges; edges may have a column k that orders them."""
    order = "k" if "k" in edges.columns else "weight"
    return edges.groupBy("src", "dst").agg(F.max_by("weight", order).alias("weight"))


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, community): in each round every node takes the label that most of its edges lead to, the least of several, if more than its own; all at once."""
    both = edges.select("src", "dst").where("src <> dst")
    step = durable(both.union(both.select("dst", "src")).groupBy("src", "dst").agg(F.count("*").alias("n")))
    labels = durable(nodes.select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        said = step.join(labels.select(F.col("id").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("n").alias("n"))
        own = labels.select("id", F.col("community").alias("own"))
        tally = said.join(own, "id").groupBy("id", "own").agg(F.max(F.struct("n", (-F.col("community")).alias("c"))).alias("best"), F.coalesce(F.sum(F.when(F.col("community") == F.col("own"), F.col("n"))), F.lit(0)).alias("n_own"))
        moves = tally.where("best.n > n_own").select("id", (-F.col("best.c")).alias("to"))
        joined = durable(labels.join(moves, "id", "left"))
        labels = joined.select("id", F.coalesce("to", "community").alias("community"))
        if joined.where("`to` is not null").isEmpty():
            break
    return labels


def modularity_gain(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, to, gain): edges into a community less those into the own one, over the degree, for each that a node has edges to."""
    both = edges.select("src", "dst").where("src <> dst")
    step = both.union(both.select("dst", "src"))
    said = step.join(labels.select(F.col("id").alias("dst"), F.col("community").alias("to")), "dst").groupBy(F.col("src").alias("id"), "to").agg(F.count("*").alias("n"))
    degree = said.groupBy("id").agg(F.sum("n").alias("d"))
    own = said.join(labels, "id").where("to = community").select("id", F.col("n").alias("own"))
    return said.join(degree, "id").join(own, "id", "left").select("id", "to", ((F.col("n") - F.coalesce("own", F.lit(0))) / F.col("d")).alias("gain"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes."""
    return kept_edges(edges, nodes)


def dot(edges: DataFrame) -> DataFrame:
    """(line): the graph in the DOT language; lines of edges in any order between the first and the last."""
    spark = edges.sparkSession
    lines = edges.select(F.lit(1).alias("at"), F.format_string('  "%s" -> "%s" [label="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("relation_type")).alias("line"))
    ends = spark.createDataFrame([(0, "digraph G {"), (2, "}")], "at int, line string")
    return ends.union(lines).orderBy("at", "line").select("line")


def density(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> float:
    """Edges over the pairs of nodes, or over the ordered pairs; 0 with fewer than two nodes."""
    n, m = nodes.count(), edges.count()
    return m / (n * (n - 1) / (1 if directed else 2)) if n > 1 else 0.0


def properties(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph's size, density and out-degrees in one row."""
    d = degrees(edges, nodes).agg(
        F.count("*").alias("n"), F.round(F.avg("out_degree"), 6).alias("avg_degree"), F.max("out_degree").alias("max_degree"), F.min("out_degree").alias("min_degree")
    )
    both = d.crossJoin(F.broadcast(edges.agg(F.count("*").alias("m"))))  # one row each
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return both.select("n", "m", F.round(F.coalesce(F.try_divide(F.col("m"), pairs), F.lit(0.0)), 9).alias("density"), "avg_degree", "max_degree", "min_degree")
