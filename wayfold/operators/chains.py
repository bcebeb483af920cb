"""Teleport chains: rows that point to a next row act as one edge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.fields import place_key, requirement_ids, ticks
from wayfold.operators.tables import stored

LOCAL, GLOBAL = ("door", "npc", "object"), ("lodestone", "item", "ifslot", "poa_item")
POINTING = ("door", "lodestone", "npc", "object", "item", "ifslot")  # kinds whose pointers make a row no head


def parsed_steps(steps: DataFrame) -> DataFrame:
    """kind, id, src and dst keys, cost (ticks, 0 for negative or odd ones),
    next_kind, next_id, reqs."""
    cost = F.when((F.col("cost_ms") > 0) & ~F.isnan("cost_ms"), ticks("cost_ms")).otherwise(F.lit(0).cast("long"))
    return steps.select("kind", "id", place_key("src_x", "src_y", "src_plane").alias("src"), place_key("dst_x", "dst_y", "dst_plane").alias("dst"), cost.alias("cost"), "next_kind", "next_id", requirement_ids("requirements").alias("reqs"))


def heads(steps: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of these kinds that nothing points to; local ones have a source."""
    targets = steps.where(F.col("kind").isin(*POINTING) & F.col("next_kind").isNotNull() & F.col("next_id").isNotNull()).select(F.col("next_kind").alias("kind"), F.col("next_id").alias("id"))
    own = steps.where(F.col("kind").isin(*kinds))
    return (own.where("src IS NOT NULL") if set(kinds) <= set(LOCAL) else own).join(targets, ["kind", "id"], "left_anti")


def chains(steps: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Chains from their heads to their ends: kind, id, src, dst (the last that a
    row names), cost, reqs (sorted, each once), n_steps, path. A chain that comes
    back to itself or points to a missing row is left out; an unknown kind, or a
    kind without an id, ends it. Each round follows one pointer of every chain, and
    there are as many rounds as the longest has steps: none meets a row twice."""
    known = [*LOCAL, *GLOBAL]
    one = F.array(F.concat_ws(":", "kind", "id"))
    now = heads(steps, kinds).select("kind", "id", "src", "dst", "cost", "reqs", F.lit(1).alias("n_steps"), one.alias("path"), "next_kind", "next_id")
    names = ["kind", "id", "src", "dst", "cost", "reqs", "n_steps", "path"]
    follows = F.col("next_kind").isin(*known) & F.col("next_id").isNotNull()
    nxt = steps.select(F.col("kind").alias("next_kind"), F.col("id").alias("next_id"), F.col("dst").alias("d"), F.col("cost").alias("c"), F.col("reqs").alias("r"), F.col("next_kind").alias("nk"), F.col("next_id").alias("ni"))
    done = []
    while True:
        done.append(now.where(~F.coalesce(follows, F.lit(False))).select(names))
        going = now.where(follows)
        if going.isEmpty():
            break
        step = F.concat_ws(":", "next_kind", "next_id")
        now = stored(
            going.join(nxt, ["next_kind", "next_id"])
            .where(~F.array_contains("path", step))
            .select("kind", "id", "src", F.coalesce("d", "dst").alias("dst"), (F.col("cost") + F.col("c")).alias("cost"), F.concat("reqs", "r").alias("reqs"), (F.col("n_steps") + 1).alias("n_steps"), F.array_append("path", step).alias("path"), F.col("nk").alias("next_kind"), F.col("ni").alias("next_id"))
        )
    return reduce(DataFrame.unionByName, done).withColumn("reqs", F.array_sort(F.array_distinct("reqs")))


def macro_edges(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Local chains between nodes, and the way back through each door: kind, id,
    src, dst (node ids), cost, reqs, n_steps, backward. The way back costs what
    the door itself does and asks for its own requirements."""
    at = lambda key, name: nodes.select(F.col("key").alias(key), F.col("id").alias(name))
    ahead = chains(steps, LOCAL).withColumnsRenamed({"src": "sk", "dst": "dk"}).join(at("sk", "src"), "sk").join(at("dk", "dst"), "dk")
    doors = steps.where("kind = 'door'").select("kind", "id", F.col("src").alias("ok"), F.col("dst").alias("ik"), F.col("cost").alias("c"), F.col("reqs").alias("r"))
    back = ahead.where("kind = 'door'").select("kind", "id").join(doors, ["kind", "id"]).join(at("ik", "src"), "ik").join(at("ok", "dst"), "ok")
    own = ahead.select("kind", "id", "src", "dst", "cost", "reqs", "n_steps", F.lit(False).alias("backward"))
    return own.unionByName(back.select("kind", "id", "src", "dst", F.col("c").alias("cost"), F.col("r").alias("reqs"), F.lit(1).alias("n_steps"), F.lit(True).alias("backward")))


def global_edges(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Global chains that end on a node: kind, id, dst, cost, reqs, n_steps."""
    ends = nodes.select(F.col("key").alias("dk"), F.col("id").alias("dst"))
    return chains(steps, GLOBAL).withColumnRenamed("dst", "dk").join(ends, "dk").select("kind", "id", "dst", "cost", "reqs", "n_steps")


def ring_nodes(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rings on a node: id, node, cost, code, reqs."""
    cost = F.when((F.col("cost_ms") > 0) & ~F.isnan("cost_ms"), ticks("cost_ms")).otherwise(F.lit(0).cast("long"))
    own = rings.select(F.col("id").alias("ring_id"), place_key("x", "y", "plane").alias("key"), cost.alias("cost"), "code", requirement_ids("requirements").alias("reqs"))
    return own.join(nodes.select("key", F.col("id").alias("node")), "key").select(F.col("ring_id").alias("id"), "node", "cost", "code", "reqs")
