"""Connected components and hot-key joins, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.tables import stored

#: Keys with this share of the rows or more are hot: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, total: int, count: str = "n") -> DataFrame:
    """Inner join of rows with one row for each key. keyed has in `count` how
    many of the `total` rows have its key. Hot keys, a bounded number, are
    broadcast, so their rows stay where they are; the others meet in a
    sort-merge join."""
    least = max(2, int(total * HOT_SHARE))
    names = [*rows.columns, *(c for c in keyed.columns if c != key)]
    hot = keyed.where(F.col(count) >= least)
    common = rows.join(F.broadcast(hot), key).select(names)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) < least).hint("merge"), key).select(names)
    return common.unionByName(rest)


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"] or 0


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a, b), longs. Returns (node, component): the smallest node that
    each node of an edge reaches. Stars are contracted in alternation, which
    takes about as many rounds as the logarithm of the longest path; every round
    is written to the shared folder."""
    pair = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(pair.distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = join_hot(both, least, "u", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # a node has few smaller neighbours once the larger ones have been dealt out
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state, now = state, _state(new), new
        if state == before:
            break
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
