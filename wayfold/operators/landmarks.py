"""Landmarks: far-apart nodes, distance tables, and lower bounds from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions.fields import QUICK_TELEPORT_MS, TICKS
from wayfold.operators.components import connected
from wayfold.operators.search import BROADCAST_EDGES, Graph, Mapped, Parts, distances, mapped_parts, parts, tables_of_distances
from wayfold.operators.tables import stored

#: No node: where all rings meet in bound_edges().
HUB = -1


def _cheapest(macros: DataFrame) -> DataFrame:
    low = F.when(F.col("kind") == "lodestone", F.least("cost", F.lit(QUICK_TELEPORT_MS * TICKS))).otherwise(F.col("cost"))
    return macros.groupBy("src", "dst").agg(F.min(low).alias("w"))


def bound_edges(walk: DataFrame, macros: DataFrame, rings: DataFrame) -> DataFrame:
    """src, dst, w of the graph of bound_graph(), for joins. Every ring leads to
    HUB for nothing, and HUB to every ring at that ring's cost: as far as from
    ring to ring, without their pairs."""
    ring = rings.groupBy("node").agg(F.min("cost").alias("w"))
    to = ring.select(F.col("node").alias("src"), F.lit(HUB).cast("long").alias("dst"), F.lit(0).cast("long").alias("w"))
    back = ring.select(F.lit(HUB).cast("long").alias("src"), F.col("node").alias("dst"), "w")
    return walk.select("src", "dst", "w").unionByName(_cheapest(macros)).unionByName(to).unionByName(back)


def bound_graph(n: int, walk: DataFrame, macros: DataFrame, rings: DataFrame) -> Graph:
    """The graph that bounds hold for: every teleport at its lowest price,
    whatever it requires. BROADCAST_EDGES edges at most."""
    edges = walk.count() + macros.count()
    if edges > BROADCAST_EDGES:
        raise ValueError(f"{edges} edges are more than a task may hold: use bound_edges()")
    w, m = walk.select("src", "dst", "w").toPandas(), _cheapest(macros).toPandas()
    r = rings.groupBy("node").agg(F.min("cost").alias("w")).toPandas()
    cat = lambda c: np.concatenate([w[c].to_numpy(np.int64), m[c].to_numpy(np.int64)])
    return Graph(n, cat("src"), cat("dst"), cat("w"), zip(r.node.tolist(), r.w.tolist(), strict=True))


def _bound(macros: DataFrame, rings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = lambda rows: rows.withColumn("profile_id", F.lit(0))
    none = rings.where("false").select(F.lit(0).alias("profile_id"), F.col("node").alias("dst"), "cost")
    return own(_cheapest(macros).withColumnRenamed("w", "cost")), own(rings.select("node", "cost")), none


def bound_mapped(n: int, walk: DataFrame, macros: DataFrame, rings: DataFrame) -> Mapped:
    """bound_parts() for files of the tasks' own."""
    return mapped_parts(n, walk, *_bound(macros, rings))


def bound_parts(n: int, walk: DataFrame, macros: DataFrame, rings: DataFrame) -> Parts:
    """bound_graph() without a row that passes the driver, as profile 0. Callers
    check the number of edges before."""
    return parts(n, walk, *_bound(macros, rings))


def distance_tables(graph: Graph | Parts, landmarks: DataFrame) -> DataFrame:
    """landmarks: li, node. Returns li, node, fw (from the landmark) and bw (to
    it), ticks, null where there is no path. One task searches one landmark one way."""
    both = landmarks.select(F.col("li").cast("long").alias("key"), F.lit(0).alias("profile_id"), "node", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    rows = tables_of_distances(graph if isinstance(graph, Parts) else {0: graph}, both)
    return rows.groupBy(F.col("key").alias("li"), "node").agg(F.max(F.when(~F.col("backward"), F.col("cost"))).alias("fw"), F.max(F.when(F.col("backward"), F.col("cost"))).alias("bw"))


def joined_tables(edges: DataFrame, landmarks: DataFrame) -> DataFrame:
    """distance_tables() by rounds of joins, whatever the number of edges."""
    at = landmarks.select(F.col("li").cast("long").alias("source"), "node", F.lit(0).cast("long").alias("cost"))
    ahead = distances(edges, at).withColumnRenamed("cost", "fw")
    back = distances(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), at).withColumnRenamed("cost", "bw")
    return ahead.join(back, ["source", "node"], "full").where(F.col("node") != HUB).select(F.col("source").alias("li"), "node", "fw", "bw")


Reach = Callable[[int], DataFrame]


def searched(spark: SparkSession, graph: Graph | Parts) -> Reach:
    """From a node to what it reaches: node, d."""
    return lambda at: tables_of_distances(graph if isinstance(graph, Parts) else {0: graph}, spark.createDataFrame([(0, 0, at, False)], "key long, profile_id int, node long, backward boolean")).select("node", F.col("cost").alias("d"))


def joined(spark: SparkSession, edges: DataFrame) -> Reach:
    """searched() by rounds of joins."""
    return lambda at: distances(edges, spark.createDataFrame([(0, at, 0)], "source long, node long, cost long")).where(F.col("node") != HUB).select("node", F.col("cost").alias("d"))


def _labels(walk: DataFrame, macros: DataFrame, nodes: DataFrame) -> DataFrame:
    edges = walk.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(macros.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return nodes.select("id").join(connected(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def farthest(reach: Reach, walk: DataFrame, macros: DataFrame, nodes: DataFrame, k: int, largest: int = 4096, labels: DataFrame | None = None) -> list[int]:
    """k landmarks: from the lowest node of the largest component on, each is
    the node farthest from those before (unreached ones first, then the lowest
    id), in components that are large enough. Each needs the ones before it. labels: node, component by
    walk alone, where they are known."""
    if labels is None:
        label = _labels(walk, macros, nodes)
    else:
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_comp"))
        pairs = macros.select("src", "dst").join(of("src"), "src").join(of("dst"), "dst").where("src_comp <> dst_comp")
        joint = connected(pairs.select(F.col("src_comp").alias("a"), F.col("dst_comp").alias("b")).distinct()).select(F.col("node").alias("c"), F.col("component").alias("joint"))
        label = stored(labels.withColumnRenamed("component", "c").join(joint, "c", "left").select(F.col("node").alias("id"), F.coalesce("joint", "c").alias("component")))
    sizes = label.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "component").first()
    if top is None:
        return []
    eligible = label.join(sizes, "component").where(F.col("n") >= min(largest, top["n"])).select(F.col("id").alias("node")).cache()
    chosen: list[int] = []
    near, at = None, top["component"]
    for _ in range(k):
        now = eligible.join(reach(at), "node", "left")
        if near is not None and chosen:
            now = now.join(near.withColumnRenamed("d", "e"), "node").select("node", F.expr("CASE WHEN d IS NULL THEN e WHEN e IS NULL THEN d ELSE least(d, e) END").alias("d"))
        near = now.cache()
        free = near.where(~F.col("node").isin(chosen)) if chosen else near
        best = free.orderBy(F.expr("d IS NULL DESC"), F.desc("d"), "node").first()
        if best is None:
            break
        if not chosen:
            near = None  # the first search only finds where to begin
        chosen.append(best["node"])
        at = best["node"]
    return chosen


def bounds(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs: query_id, start, goal. Adds bound: what a path costs at least, by
    the triangle inequality over all landmarks, and hopeless: some landmark is
    reached from the start's side and not from the goal's, so there is no path."""
    s = table.select("li", F.col("node").alias("start"), F.col("fw").alias("sf"), F.col("bw").alias("sb"))
    g = table.select("li", F.col("node").alias("goal"), F.col("fw").alias("gf"), F.col("bw").alias("gb"))
    both = pairs.join(s, "start").join(g, ["li", "goal"])
    low = F.greatest(F.lit(0).cast("long"), F.col("gf") - F.col("sf"), F.col("sb") - F.col("gb"))
    hopeless = (F.col("sf").isNotNull() & F.col("gf").isNull()) | (F.col("gb").isNotNull() & F.col("sb").isNull())
    found = both.groupBy("query_id").agg(F.max(low).alias("bound"), F.coalesce(F.bool_or(hopeless), F.lit(False)).alias("hopeless"))
    return pairs.join(found, "query_id", "left").select("query_id", "start", "goal", F.coalesce("bound", F.lit(0).cast("long")).alias("bound"), F.coalesce("hopeless", F.lit(False)).alias("hopeless"))
