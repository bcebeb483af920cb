"""Nodes and walk edges of a tile world, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.fields import CARDINAL, DIAGONAL, pack, place_key

# Direction, step, bits that the tile has to have, bits that its
# neighbour has to have. Bits: left, bottom, right, top, then the four diagonals.
DIRECTIONS = (
    (0, -1, 0, 1, 4),
    (1, 0, -1, 2, 8),
    (2, 1, 0, 4, 1),
    (3, 0, 1, 8, 2),
    (4, -1, 1, 25, 6),
    (5, -1, -1, 35, 12),
    (6, 1, -1, 70, 9),
    (7, 1, 1, 140, 3),
)


def dense_ids(tiles: DataFrame) -> DataFrame:
    """Tiles with key and id, the rank from 0 by plane, y and x. All tiles get
    one, also those too far out to be packed. Ranks are taken within rows of tiles
    (one plane and y), whose sizes are summed before: one task sees a number for
    each row, none sees all tiles."""
    own = tiles.withColumn("key", place_key("x", "y", "plane"))
    before = Window.orderBy("plane", "y").rowsBetween(Window.unboundedPreceding, -1)
    rows = own.groupBy("plane", "y").agg(F.count("*").alias("_n")).select("plane", "y", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(Window.partitionBy("plane", "y").orderBy("x")) - 1
    return own.withColumn("_rank", rank).join(rows, ["plane", "y"]).select("x", "y", "plane", "key", "walk_mask", (F.col("_base") + F.col("_rank")).alias("id"))


def duplicate_tiles(tiles: DataFrame) -> DataFrame:
    """Coordinates that occur more than once or can't be packed: a build has none."""
    key = pack("x", "y", "plane")
    return tiles.groupBy("x", "y", "plane").agg(F.count("*").alias("n")).where((F.col("n") > 1) | key.isNull())


def walk_edges(nodes: DataFrame) -> DataFrame:
    """src, dst, dir, w (ticks). One equi-join of nodes with their neighbours'
    places, eight for each node; what the masks of both have to hold is known by
    direction."""
    table = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(d, ("dir", "dx", "dy", "a", "b"), strict=True))) for d in DIRECTIONS))
    out = nodes.select(F.col("id").alias("src"), "x", "y", "plane", "walk_mask", F.explode(table).alias("d")).where("(walk_mask & d.a) = d.a")
    out = out.select("src", "d.dir", "d.b", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "plane")
    ends = nodes.select("x", "y", "plane", F.col("id").alias("dst"), F.col("walk_mask").alias("m"))
    weight = F.when(F.col("dir") < 4, F.lit(CARDINAL)).otherwise(F.lit(DIAGONAL)).cast("long")
    return out.join(ends, ["x", "y", "plane"]).where("(m & b) = b").select("src", "dst", "dir", weight.alias("w"))


def without_mirror(edges: DataFrame) -> DataFrame:
    """Walk edges whose reverse is missing: a build has none."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its out-edges, sorted: (dst, w) by dst. At most eight and the
    teleports of one tile."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dst", "w"))).alias("out"))


def direction_masks(edges: DataFrame) -> DataFrame:
    """src and the bits of the directions in which an edge leaves it."""
    return edges.groupBy("src").agg(F.expr("bit_or(shiftleft(1, dir))").alias("mask"))


def dominated_steps(edges: DataFrame) -> DataFrame:
    """(prev, node, next): walking prev -> node -> next costs more than another
    way from prev to next of one or two steps, so no best path does it."""
    a = edges.select(F.col("src").alias("prev"), F.col("dst").alias("node"), F.col("w").alias("w1"))
    b = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("w").alias("w2"))
    two = a.join(b, "node").where("prev <> next").select("prev", "node", "next", (F.col("w1") + F.col("w2")).alias("cost"))
    one = edges.select(F.col("src").alias("prev"), F.col("dst").alias("next"), F.col("w").alias("cost"))
    best = two.select("prev", "next", "cost").unionByName(one).groupBy("prev", "next").agg(F.min("cost").alias("best"))
    return two.join(best, ["prev", "next"]).where("cost > best").select("prev", "node", "next")


def cheap_adjacent_macros(macros: DataFrame, nodes: DataFrame) -> DataFrame:
    """Teleports between neighbouring tiles that cost less than a diagonal step:
    where there are any, dominated steps can't be told from directions alone."""
    at = lambda end: nodes.select(F.col("id").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("x", "y", "plane")))
    both = macros.join(at("src"), "src").join(at("dst"), "dst")
    near = (F.col("src_plane") == F.col("dst_plane")) & (F.abs(F.col("src_x") - F.col("dst_x")) <= 1) & (F.abs(F.col("src_y") - F.col("dst_y")) <= 1)
    return both.where(near & (F.col("cost") < DIAGONAL)).select(macros.columns)


def nodes_with_macros(nodes: DataFrame, macros: DataFrame) -> DataFrame:
    """ids of the nodes that a teleport leaves."""
    return nodes.select("id").join(macros.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
