"""Queries of the graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import edges as E
from lodestone.operators import graph as G
from lodestone.operators import graph_small as H
from lodestone.operators.components import connected_components
from lodestone.operators.durable import durable, written
from lodestone.plans.code import U, units
from lodestone.plans.edges import CALLED, EXTRACT, JN07, S, _extracted, _q
from lodestone.plans.registry import register

#: Trade between nations: an edge for each pair of customer's and supplier's nation, weighted by its share of the largest.
TRADE = """e AS (SELECT src, dst, round(n / max(n) OVER (), 9) AS weight FROM (SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::DOUBLE AS n
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))"""
CHAIN = "c AS (SELECT a.conv_id * 1000 + a.turn AS src, b.conv_id * 1000 + b.turn AS dst FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trade(spark, sf_dir):
    lines, orders = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer, supplier = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    counted = joined.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").cast("double").alias("n"))
    counted = counted.crossJoin(F.broadcast(counted.agg(F.max("n").alias("most"))))
    return counted.select("src", "dst", F.round(F.col("n") / F.col("most"), 9).alias("weight"))


def _nations(spark, sf_dir):
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))


def _chain(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.lit(1).alias("next"))
    return c.join(following, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("dst"))


@register("gr01_build_graph", f"WITH {TRADE} SELECT src, dst, weight FROM e WHERE src IN (SELECT n_nationkey FROM nation) AND dst IN (SELECT n_nationkey FROM nation)")
def gr01(spark, sf_dir):
    return G.kept_edges(_trade(spark, sf_dir), _nations(spark, sf_dir))


@register("gr03_weighted_graph", f"WITH {TRADE} SELECT src, dst, round((weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()), 6) AS normal FROM e")
def gr03(spark, sf_dir):
    e = _trade(spark, sf_dir)
    ends = e.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    return e.crossJoin(F.broadcast(ends)).select("src", "dst", F.round(F.coalesce(F.try_divide(F.col("weight") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)), 6).alias("normal"))


@register("gr04_degrees", f"WITH {TRADE} SELECT n_nationkey AS id, (SELECT count(*) FROM e WHERE dst = n_nationkey) AS in_degree, (SELECT count(DISTINCT dst) FROM e WHERE src = n_nationkey) AS out_degree FROM nation")
def gr04(spark, sf_dir):
    return G.degrees(_trade(spark, sf_dir), _nations(spark, sf_dir))


@register("gr12_density", f"WITH {TRADE} SELECT round(count(*) / (25 * 24), 6) AS density FROM e")
def gr12(spark, sf_dir):
    n = _nations(spark, sf_dir).count()
    return _trade(spark, sf_dir).agg(F.round(F.count("*") / F.lit(float(n * (n - 1))), 6).alias("density"))


#: The graph of calls between the units of the code corpus: sparse, with cycles, and with paths of many steps.
CALLS = f"{U}, {S}, {CALLED}, g AS (SELECT a.k AS src, b.k AS dst, weight FROM ({JN07}) c JOIN u a ON a.id = c.src JOIN u b ON b.id = c.dst), nd AS (SELECT k AS id FROM u)"


def _calls(spark, sf_dir):
    u = units(spark, sf_dir)
    a, b = u.select(F.col("id").alias("src"), F.col("k").alias("a")), u.select(F.col("id").alias("dst"), F.col("k").alias("b"))
    edges = E.weighed_calls(u).join(E.unsent(a), "src").join(E.unsent(b), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
    return durable(edges), u.select(F.col("k").alias("id"))


def _walk(depth: int | None = None) -> str:
    limit = f"WHERE distance < {depth}" if depth else ""
    return f"WITH RECURSIVE {CALLS}, r AS (SELECT id AS start, id, 0 AS distance FROM nd UNION SELECT start, dst, distance + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM g) g ON src = id {limit})"


#: Reachability without distances ends on cycles; CTE rc(start, id).
_REACH = f"WITH RECURSIVE {CALLS}, rc AS (SELECT id AS start, id FROM nd UNION SELECT start, dst FROM rc JOIN g ON src = id)"


@register("gr13_bfs", f"{_walk(4)} SELECT start, id, min(distance)::INT AS distance FROM r GROUP BY ALL")
def gr13(spark, sf_dir):
    """Distances of at most four hops from every node (rows 13 and 36)."""
    edges, nodes = _calls(spark, sf_dir)
    return G.bfs(edges, nodes, 4)


@register("gr13_bfs_by_type", _q(*EXTRACT).rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + """, r AS (SELECT id AS start, id, 0 AS distance FROM u WHERE symbol_type = 'class' UNION SELECT start, dst, distance + 1 FROM r JOIN (SELECT DISTINCT src, dst FROM x WHERE relation_type IN ('contains', 'inherits')) e ON src = r.id WHERE distance < 3) SELECT start, id, min(distance)::INT AS distance FROM r GROUP BY ALL""")
def gr13t(spark, sf_dir):
    """Distances from classes along containment and inheritance only (rows 7 and 13)."""
    edges = _extracted(spark, sf_dir).where(F.col("relation_type").isin("contains", "inherits"))
    return G.bfs(edges, units(spark, sf_dir).where("symbol_type = 'class'").select("id"), 3)


@register("gr27_closeness", f"{_walk(60)}, d AS (SELECT start, id, min(distance) AS distance FROM r GROUP BY ALL) SELECT start AS id, round(coalesce(((SELECT count(*) FROM nd) - 1) / nullif(sum(distance), 0), 0), 6)::DOUBLE AS closeness FROM d GROUP BY start")
def gr27(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    n = nodes.count()
    near = G.bfs(edges, nodes, 1000).groupBy(F.col("start").alias("id")).agg(F.sum("distance").alias("d"))
    return near.select("id", F.round(F.coalesce(F.try_divide(F.lit(float(n - 1)), F.col("d")), F.lit(0.0)), 6).alias("closeness"))


@register("gr15_dijkstra", f"WITH RECURSIVE {TRADE}, r AS (SELECT 0 AS id, 0.0::DOUBLE AS distance, 0 AS hops UNION ALL SELECT dst, min(distance + 1 - weight), min(hops) + 1 FROM r JOIN e ON src = id WHERE hops < 12 GROUP BY dst) SELECT id, round(min(distance), 6) AS distance FROM r GROUP BY id")
def gr15(spark, sf_dir):
    start = _nations(spark, sf_dir).where("id = 0")
    return G.dijkstra(_trade(spark, sf_dir), start).select("id", F.round("distance", 6).alias("distance"))


@register("gr18_shortest_paths", f"WITH RECURSIVE {CALLS}, st AS (SELECT min(src) AS id FROM g), r AS (SELECT id, 0.0::DOUBLE AS distance, [id] AS path FROM st UNION ALL SELECT dst, round(distance + greatest(0, 1 - weight), 12), list_append(path, dst) FROM r JOIN (SELECT src, dst, max(weight) AS weight FROM g GROUP BY 1, 2) ON src = id WHERE NOT list_contains(path, dst) AND len(path) < 12) SELECT id, round(arg_min(distance, (distance, len(path), path)), 6)::DOUBLE AS distance, array_to_string(arg_min(path, (distance, len(path), path)), '>') AS path FROM r GROUP BY id")
def gr18(spark, sf_dir):
    """Cheapest paths from the first caller, with the nodes on them (rows 6, 18 and 19)."""
    edges, _ = _calls(spark, sf_dir)
    start = edges.agg(F.min("src").alias("id"))
    return G.shortest_paths(edges, start).select("id", F.round("distance", 6).alias("distance"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@register("gr17_simple_paths", f"WITH RECURSIVE {TRADE}, r AS (SELECT [src, dst] AS path FROM e WHERE src = 0 UNION ALL SELECT list_append(path, dst) FROM r JOIN e ON src = path[-1] WHERE path[-1] <> 7 AND NOT list_contains(path, dst) AND len(path) < 4) SELECT array_to_string(path, '>') AS path FROM r WHERE path[-1] = 7")
def gr17(spark, sf_dir):
    """All simple paths of at most four nations between two."""
    return G.simple_paths(_trade(spark, sf_dir), 0, 7, 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@register("gr10_cycles", f"WITH RECURSIVE {CALLS}, e AS (SELECT DISTINCT src, dst FROM g), r AS (SELECT src AS a, [src] AS path, dst FROM e UNION ALL SELECT a, list_append(path, r.dst), e.dst FROM r JOIN e ON e.src = r.dst WHERE r.dst > a AND NOT list_contains(path, r.dst) AND len(path) < 5) SELECT array_to_string(path, '>') AS cycle FROM r WHERE dst = a")
def gr10(spark, sf_dir):
    """Cycles of calls of at most five units, each once."""
    edges, _ = _calls(spark, sf_dir)
    return G.cycles(edges, 5).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ">").alias("cycle"))


@register("gr07_neighbours", f"WITH {CALLS}, st AS (SELECT max(dst) AS id FROM g) SELECT DISTINCT id FROM (SELECT dst AS id FROM g WHERE src = (SELECT id FROM st) UNION SELECT src FROM g WHERE dst = (SELECT id FROM st)) WHERE id <> (SELECT id FROM st)")
def gr07(spark, sf_dir):
    """Neighbours either way of the last unit that is called (rows 7 and 8)."""
    edges, _ = _calls(spark, sf_dir)
    return G.neighbours(edges, edges.agg(F.max("dst").alias("id")))


@register("gr09_total_degree", f"WITH {CALLS} SELECT id, round(((SELECT count(*) FROM g WHERE dst = id) + (SELECT count(DISTINCT dst) FROM g WHERE src = id)) / ((SELECT count(*) FROM nd) - 1), 6)::DOUBLE AS centrality FROM nd")
def gr09(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return G.total_degree(edges, nodes).select("id", F.round("centrality", 6).alias("centrality"))


@register("gr20_out_weights", f"WITH {CALLS} SELECT src, dst, round(max(weight), 6) AS weight FROM g GROUP BY 1, 2")
def gr20(spark, sf_dir):
    edges, _ = _calls(spark, sf_dir)
    return G.out_weights(edges).select("src", "dst", F.round("weight", 6).alias("weight"))


@register("gr22_strong_components", f"{_REACH} SELECT a.start AS id, min(a.id) AS component FROM rc a JOIN rc b ON a.start = b.id AND a.id = b.start GROUP BY a.start")
def gr22(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return H.strong_components(edges, nodes)


@register("gr26_betweenness")
def gr26(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return H.betweenness(edges, nodes).select("id", F.round("centrality", 9).alias("centrality"))


@register("gr28_eigenvector")
def gr28(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return G.eigenvector(edges, nodes).select("id", F.round("centrality", 6).alias("centrality"))


@register("gr30_communities")
def gr30(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return G.communities(edges, nodes)


@register("gr31_modularity_gain", f"WITH {CALLS}, b AS (SELECT src, dst FROM g WHERE src <> dst UNION ALL SELECT dst, src FROM g WHERE src <> dst), t AS (SELECT src AS id, dst % 7 AS \"to\", count(*) AS n FROM b GROUP BY 1, 2) SELECT id, \"to\", round((n - coalesce((SELECT o.n FROM t o WHERE o.id = t.id AND o.\"to\" = t.id % 7), 0)) / sum(n) OVER (PARTITION BY id), 6)::DOUBLE AS gain FROM t".replace("b AS (SELECT src, dst FROM g", "bb AS (SELECT src, dst FROM g").replace("FROM b GROUP", "FROM bb GROUP"))
def gr31(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return G.modularity_gain(edges, nodes.select("id", (F.col("id") % 7).alias("community"))).select("id", "to", F.round("gain", 6).alias("gain"))


_UNDIRECTED = f"{CALLS}, w AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst)"


@register("gr33_bridges")
def gr33(spark, sf_dir):
    edges, _ = _calls(spark, sf_dir)
    return H.bridges(edges)


@register("gr34_articulation_points")
def gr34(spark, sf_dir):
    edges, _ = _calls(spark, sf_dir)
    return H.articulation_points(edges)


@register("gr02_grown_graph", f"WITH {CALLS}, n0 AS (SELECT id FROM nd WHERE id % 3 <> 0), e0 AS (SELECT * FROM g WHERE src IN (SELECT id FROM n0) AND dst IN (SELECT id FROM n0)), n1 AS (SELECT id FROM nd WHERE id % 9 <> 0) SELECT src, dst, count(*) AS times FROM (SELECT src, dst FROM e0 UNION ALL SELECT src, dst FROM g WHERE src IN (SELECT id FROM n1) AND dst IN (SELECT id FROM n1)) GROUP BY ALL")
def gr02(spark, sf_dir):
    """A graph without some units, to which most of them and all edges are added (rows 2 and 40)."""
    edges, nodes = _calls(spark, sf_dir)
    few = nodes.where("id % 3 <> 0")
    _, both = G.grown(few, G.kept_edges(edges, few), nodes.where("id % 9 <> 0"), edges)
    return both.groupBy("src", "dst").agg(F.count("*").alias("times"))


@register("gr05_shrunk_graph", _q(*EXTRACT) + "SELECT relation_type, count(*) AS edges FROM x WHERE right(src, 1) <> '7' AND right(dst, 1) <> '7' AND NOT (relation_type = 'uses' AND src IN (SELECT id FROM u WHERE k % 2 = 0)) GROUP BY 1")
def gr05(spark, sf_dir):
    """Without the nodes whose id ends in 7, and without the uses of every second unit."""
    edges, u = written(_extracted(spark, sf_dir)), units(spark, sf_dir)  # read four times
    nodes = u.select("id").union(edges.select("src")).union(edges.select("dst")).distinct()
    even = u.where("k % 2 = 0").select(F.col("id").alias("src"))
    _, rest = G.shrunk(nodes, edges, nodes.where("endswith(id, '7')"), edges.where("relation_type = 'uses'").join(E.unsent(even), "src", "left_semi"))
    return rest.groupBy("relation_type").agg(F.count("*").alias("edges"))


@register("gr35_properties", f"WITH {CALLS}, e AS (SELECT DISTINCT src, dst FROM g), o AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS d FROM nd) SELECT count(*) AS n, (SELECT count(*) FROM g) AS m, round((SELECT count(*) FROM g) / (count(*) * (count(*) - 1) / 2), 9)::DOUBLE AS density, round(avg(d), 6)::DOUBLE AS avg_degree, max(d)::BIGINT AS max_degree, min(d)::BIGINT AS min_degree FROM o")
def gr35(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return G.properties(edges, nodes)


@register("gr37_neighbourhood", f"WITH RECURSIVE {CALLS}, st AS (SELECT min(src) AS id FROM g), r AS (SELECT id, 0 AS d FROM st UNION SELECT dst, d + 1 FROM r JOIN g ON src = id WHERE d < 2), h AS (SELECT DISTINCT id FROM r) SELECT DISTINCT src, dst FROM g WHERE src IN (SELECT id FROM h) AND dst IN (SELECT id FROM h)")
def gr37(spark, sf_dir):
    """The edges between what lies within two calls of a unit."""
    edges, _ = _calls(spark, sf_dir)
    near = G.bfs(edges, edges.agg(F.min("src").alias("id")), 2).select("id").distinct()
    return G.induced(edges, near).select("src", "dst").distinct()


@register("gr38_dot", f"WITH {CALLS} SELECT line FROM (SELECT 'digraph G ' || chr(123) AS line UNION ALL SELECT chr(125) UNION ALL SELECT '  \"' || src || '\" -> \"' || dst || '\" [label=\"calls\"];' FROM g)")
def gr38(spark, sf_dir):
    edges, _ = _calls(spark, sf_dir)
    return G.dot(edges.withColumn("relation_type", F.lit("calls")))


@register("gr39_display", f"{_walk(2)} SELECT start, id, min(distance)::INT AS distance FROM r WHERE start = (SELECT min(src) FROM g) GROUP BY ALL ORDER BY distance, id LIMIT 50")
def gr39(spark, sf_dir):
    """What a display shows: up to 50 nodes within two hops of the first."""
    edges, _ = _calls(spark, sf_dir)
    return G.bfs(edges, edges.agg(F.min("src").alias("id")), 2).orderBy("distance", "id").limit(50)


@register("gr21_weak_components", f"WITH {CHAIN} SELECT conv_id * 1000 + turn AS id, min(conv_id * 1000 + turn) OVER (PARTITION BY conv_id) AS component FROM conversations WHERE conv_id * 1000 + turn IN (SELECT src FROM c UNION SELECT dst FROM c)")
def gr21(spark, sf_dir):
    return connected_components(_chain(spark, sf_dir))


@register("gr23_topological_levels", "SELECT conv_id * 1000 + turn AS id, (turn - min(turn) OVER (PARTITION BY conv_id))::INT AS level FROM conversations")
def gr23(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return G.topological_levels(_chain(spark, sf_dir), c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")))


@register("gr25_degree_centrality", f"WITH {TRADE} SELECT n_nationkey AS id, round((SELECT count(DISTINCT dst) FROM e WHERE src = n_nationkey) / 24.0, 6)::DOUBLE AS centrality FROM nation")
def gr25(spark, sf_dir):
    n = _nations(spark, sf_dir).count()
    return G.degrees(_trade(spark, sf_dir), _nations(spark, sf_dir)).select("id", F.round(F.col("out_degree") / float(n - 1), 6).alias("centrality"))


@register("gr29_pagerank", f"""WITH RECURSIVE {CALLS}, o AS (SELECT src, count(*) AS k FROM g GROUP BY src), w AS (SELECT g.src, g.dst, count(*) / any_value(o.k) AS share FROM g JOIN o ON o.src = g.src GROUP BY 1, 2), z AS (SELECT count(*) AS n FROM nd),
r AS (SELECT id, 1.0::DOUBLE / n AS rank, 0 AS i FROM nd, z UNION ALL SELECT nd.id, 0.15::DOUBLE / z.n + 0.85::DOUBLE * coalesce(sum(r.rank * w.share), 0), max(i.i) + 1 FROM nd CROSS JOIN z CROSS JOIN (SELECT max(i) AS i FROM r) i LEFT JOIN w ON w.dst = nd.id LEFT JOIN r ON r.id = w.src WHERE i.i < 100 GROUP BY nd.id, z.n)
SELECT id, round(rank, 7) AS rank FROM r WHERE i = 100""")
def gr29(spark, sf_dir):
    """PageRank until no rank moves any more."""
    edges, nodes = _calls(spark, sf_dir)
    return G.pagerank(edges, nodes, tolerance=1e-12).select("id", F.round("rank", 7).alias("rank"))


@register(
    "gr32_clustering",
    f"""WITH {CALLS}, e AS (SELECT DISTINCT src, dst FROM g WHERE src <> dst), kk AS (SELECT src, count(*) AS k FROM e GROUP BY src), l AS (SELECT a.src, count(*) AS links FROM e a JOIN e b ON a.src = b.src JOIN e c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
SELECT id, round(coalesce(CASE WHEN k > 1 THEN floor(coalesce(links, 0) / 2) / (k * (k - 1) / 2) ELSE 0 END, 0), 6)::DOUBLE AS coefficient FROM nd LEFT JOIN kk ON kk.src = id LEFT JOIN l ON l.src = id""",
)
def gr32(spark, sf_dir):
    edges, nodes = _calls(spark, sf_dir)
    return G.clustering(edges, nodes).select("id", F.round("coefficient", 6).alias("coefficient"))


@register("gr32_trade_clustering", f"""WITH {TRADE}, k AS (SELECT src, count(*) AS k FROM e GROUP BY src), l AS (SELECT a.src, count(*) AS links FROM e a JOIN e b ON a.src = b.src JOIN e c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
SELECT n_nationkey AS id, round(coalesce(CASE WHEN k > 1 THEN floor(coalesce(links, 0) / 2) / (k * (k - 1) / 2) ELSE 0 END, 0), 6)::DOUBLE AS coefficient FROM nation LEFT JOIN k ON k.src = n_nationkey LEFT JOIN l ON l.src = n_nationkey""")
def gr32t(spark, sf_dir):
    return G.clustering(_trade(spark, sf_dir), _nations(spark, sf_dir)).select("id", F.round("coefficient", 6).alias("coefficient"))
