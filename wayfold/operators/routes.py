"""Route results: resolving queries, reachability, annotation of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.fields import milliseconds, place_key
from wayfold.operators.tables import stored


def tile_exists(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """points: x, y, plane and more columns. Adds exists and node."""
    return points.join(nodes.select("x", "y", "plane", F.col("id").alias("node")), ["x", "y", "plane"], "left").withColumn("exists", F.col("node").isNotNull())


def resolve(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds start and goal node ids and problem: a goal that is no node is an
    error; a start that is none is a virtual start (null)."""
    at = lambda side: nodes.select(F.col("key").alias(f"_{side}"), F.col("id").alias(side))
    own = queries.withColumns({f"_{s}": place_key(f"{s}_x", f"{s}_y", f"{s}_plane") for s in ("start", "goal")})
    return own.join(at("start"), "_start", "left").join(at("goal"), "_goal", "left").drop("_start", "_goal").withColumn("problem", F.when(F.col("goal").isNull(), "goal_not_found"))


def component_edges(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Teleports between different walk components. labels: node, component."""
    a = labels.select(F.col("node").alias("src"), F.col("component").alias("from_comp"))
    b = labels.select(F.col("node").alias("dst"), F.col("component").alias("to_comp"))
    return edges.join(a, "src").join(b, "dst").where("from_comp <> to_comp").drop("src", "dst")


HUB = -1  # all rings of a profile lead into it and out of it


def reachable(queries: DataFrame, labels: DataFrame, macros: DataFrame, rings: DataFrame, globals_: DataFrame) -> DataFrame:
    """query_id, reachable: whether the goal's component is reached from the
    start's, by the teleports the profile may use. Walking asks for nothing, so
    components decide; every round adds some that were not seen, until none is left.
    queries: query_id, profile_id, start, goal (node ids)."""
    comp = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_comp"))
    own = queries.join(comp("start"), "start", "left").join(comp("goal"), "goal", "left").select("query_id", "profile_id", "start_comp", "goal_comp")
    ring = rings.join(comp("node"), "node").select("profile_id", F.col("node_comp").alias("c")).distinct()
    hub = ring.select("profile_id", F.col("c").alias("a"), F.lit(HUB).cast("long").alias("b")).unionByName(ring.select("profile_id", F.lit(HUB).cast("long").alias("a"), F.col("c").alias("b")))
    steps = stored(component_edges(labels, macros).select("profile_id", F.col("from_comp").alias("a"), F.col("to_comp").alias("b")).unionByName(hub).distinct())
    entry = globals_.join(comp("dst"), "dst").select("profile_id", F.col("dst_comp").alias("c")).distinct()
    starts = own.select("profile_id", "start_comp").distinct()
    seen = starts.where("start_comp IS NOT NULL").select("profile_id", "start_comp", F.col("start_comp").alias("c")).unionByName(starts.join(entry, "profile_id").select("profile_id", "start_comp", "c"))
    seen = stored(seen.withColumn("start_comp", F.coalesce("start_comp", F.lit(-2))).distinct())
    front = seen
    while True:
        new = front.join(steps.withColumnRenamed("a", "c"), ["profile_id", "c"]).select("profile_id", "start_comp", F.col("b").alias("c")).distinct()
        front = stored(new.join(seen, ["profile_id", "start_comp", "c"], "left_anti"))
        if front.isEmpty():
            break
        seen = stored(seen.unionByName(front))
    hit = seen.select("profile_id", "start_comp", F.col("c").alias("goal_comp"), F.lit(True).alias("hit"))
    keyed = own.withColumn("start_comp", F.coalesce("start_comp", F.lit(-2)))
    return keyed.join(hit, ["profile_id", "start_comp", "goal_comp"], "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("reachable"))


def hops(routes: DataFrame) -> DataFrame:
    """query_id, profile_id, pos, u, v: neighbouring nodes of each path."""
    at = routes.where("path IS NOT NULL").select("query_id", "profile_id", F.posexplode("path").alias("pos", "v"))
    w = Window.partitionBy("query_id").orderBy("pos")
    return at.withColumn("u", F.lag("v").over(w)).where("pos > 0").select("query_id", "profile_id", F.col("pos").cast("int").alias("pos"), "u", "v")


def geometry(routes: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, pos, x, y, plane of every node of a path."""
    at = routes.where("path IS NOT NULL").select("query_id", F.posexplode("path").alias("pos", "id"))
    return at.join(nodes.select("id", "x", "y", "plane"), "id").select("query_id", F.col("pos").cast("int").alias("pos"), "x", "y", "plane")


def annotate(hop_table: DataFrame, macros_any: DataFrame, macros_ok: DataFrame, walk: DataFrame, globals_: DataFrame, rings: DataFrame) -> DataFrame:
    """What each hop is: a macro edge of the pair if there is one (the cheapest
    that the profile may use, else the first of any), else a walk edge, else a
    global teleport to its end, else a ring, else a bare teleport that costs
    nothing. Columns: query_id, pos, u, v, type, kind, id, cost_ms."""
    first = macros_any.groupBy("src", "dst").agg(F.min_by(F.struct("kind", "id", "cost"), F.struct("cost", "n_steps", "kind", "id")).alias("any"))
    best = macros_ok.groupBy("profile_id", "src", "dst").agg(F.min_by(F.struct("kind", "id", "cost"), F.struct("cost", "n_steps", "kind", "id")).alias("ok"))
    step = walk.groupBy("src", "dst").agg(F.min("w").alias("walk"))
    ends = globals_.select("profile_id", F.col("dst").alias("v"), F.struct("kind", "id", "cost").alias("far"))
    own = rings.groupBy("profile_id", "node").agg(F.min_by(F.struct(F.lit("fairy_ring").alias("kind"), "id", "cost"), F.struct("cost", "id")).alias("ring"))
    pair = lambda t: t.withColumnsRenamed({"src": "u", "dst": "v"})
    out = hop_table.join(pair(first), ["u", "v"], "left").join(pair(best), ["profile_id", "u", "v"], "left").join(pair(step), ["u", "v"], "left").join(ends, ["profile_id", "v"], "left")
    out = out.join(own.select("profile_id", F.col("node").alias("u"), F.lit(True).alias("at_ring")), ["profile_id", "u"], "left").join(own.withColumnRenamed("node", "v"), ["profile_id", "v"], "left")
    macro = F.coalesce("ok", "any")
    none = F.lit(None).cast("long")
    hop = lambda type_, kind, id_, ms: F.struct(F.lit(type_).alias("type"), kind.alias("kind"), id_.alias("id"), ms.alias("cost_ms"))
    found = (
        F.when(macro.isNotNull(), hop("macro", F.when(macro["kind"] == "poa_item", "teleport").otherwise(macro["kind"]), macro["id"], milliseconds(macro["cost"])))
        .when(F.col("walk").isNotNull(), hop("move", F.lit("move"), none, F.round(milliseconds("walk"))))
        .when(F.col("far").isNotNull(), hop("global", F.col("far.kind"), F.col("far.id"), milliseconds("far.cost")))
        .when(F.col("at_ring") & F.col("ring").isNotNull(), hop("fairy", F.lit("fairy_ring"), F.col("ring.id"), milliseconds("ring.cost")))
        .otherwise(hop("teleport", F.lit("teleport"), none, F.lit(0.0)))
    )
    return out.withColumn("hop", found).select("query_id", "pos", "u", "v", "hop.*")


def virtual_entries(routes: DataFrame, globals_: DataFrame) -> DataFrame:
    """For paths that begin beside the graph, the action that comes first:
    query_id, node, kind, cost_ms, reason."""
    first = routes.where("start IS NULL AND path IS NOT NULL").select("query_id", "profile_id", F.element_at("path", 1).alias("dst"))
    return first.join(globals_, ["profile_id", "dst"]).select("query_id", F.col("dst").alias("node"), "kind", milliseconds("cost").alias("cost_ms"), F.lit("start_coordinate_not_found").alias("reason"))


def door_direction(hop_table: DataFrame, nodes: DataFrame, doors: DataFrame) -> DataFrame:
    """IN or OUT for hops through doors. hop_table: query_id, pos, u, v, id (of
    the door); doors: id, src (outside) and dst (inside) keys."""
    at = lambda name: nodes.select(F.col("id").alias(name), F.col("key").alias(f"{name}_key"))
    door = doors.select("id", F.col("src").alias("outside"), F.col("dst").alias("inside"))
    way = F.when(F.col("u_key") == F.col("outside"), "IN").when(F.col("u_key") == F.col("inside"), "OUT").when(F.col("v_key") == F.col("inside"), "IN").when(F.col("v_key") == F.col("outside"), "OUT")
    return hop_table.join(door, "id").join(at("u"), "u").join(at("v"), "v").select("query_id", "pos", "id", way.alias("direction"))


def response(routes: DataFrame) -> DataFrame:
    """query_id and the result as JSON without nulls: found, cost in ms,
    length_tiles (nodes of the path), path, and why a search gave up."""
    body = F.struct((F.col("status") == "found").alias("found"), milliseconds("cost").alias("cost"), F.size("path").alias("length_tiles"), "path", F.when(F.col("status") == "budget_exceeded", F.col("status")).alias("reason"))
    return routes.select("query_id", F.to_json(body).alias("body"))

