"""Checks of results, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.fields import jitter, log2_bucket


def recost(hops: DataFrame, seeds: DataFrame, walk: DataFrame, macros: DataFrame, rings: DataFrame, globals_: DataFrame) -> DataFrame:
    """The cost of each path, from its hops alone: query_id, cost, n_hops, valid
    (every hop is an edge). hops: query_id, profile_id, pos, u, v; seeds:
    query_id, seed, start, first cost of a virtual start."""
    step = walk.groupBy("src", "dst").agg(F.min("w").alias("walk")).withColumnsRenamed({"src": "u", "dst": "v"})
    macro = macros.groupBy("profile_id", "src", "dst").agg(F.min("cost").alias("macro")).withColumnsRenamed({"src": "u", "dst": "v"})
    ring = rings.groupBy("profile_id", "node").agg(F.min("cost").alias("ring"))
    far = globals_.select("profile_id", F.col("dst").alias("v"), F.col("cost").alias("far"))
    out = hops.join(step, ["u", "v"], "left").join(macro, ["profile_id", "u", "v"], "left").join(ring.withColumnRenamed("node", "v"), ["profile_id", "v"], "left")
    out = out.join(ring.select("profile_id", F.col("node").alias("u"), F.lit(1).alias("from_ring")), ["profile_id", "u"], "left").join(far, ["profile_id", "v"], "left").join(seeds, "query_id")
    at_start = (F.col("pos") == 1) & F.col("start").isNotNull()
    cost = F.least("walk", "macro", F.when(F.col("from_ring") == 1, F.col("ring")), F.when(at_start, F.col("far")))
    paid = out.withColumn("c", cost + jitter("seed", "u", "v"))
    return paid.groupBy("query_id").agg((F.sum("c") + F.first("entry_cost")).alias("cost"), F.count("*").alias("n_hops"), F.bool_and(F.col("c").isNotNull()).alias("valid"))


def beyond(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Rows of two runs that one lacks or whose values differ by more than the
    relative tolerance: keys, left, right, problem."""
    x, y = a.select(*keys, F.col(value).alias("left")), b.select(*keys, F.col(value).alias("right"))
    both = x.join(y, keys, "full")
    off = F.abs(F.col("left") - F.col("right")) > tolerance * F.greatest(F.abs("left"), F.abs("right"), F.lit(1e-9))
    problem = F.when(F.col("left").isNull() & F.col("right").isNull(), None).when(F.col("left").isNull(), "only_right").when(F.col("right").isNull(), "only_left").when(off, "differs")
    return both.withColumn("problem", problem).where("problem IS NOT NULL")


def gate(samples: DataFrame, baseline: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Medians of samples (name, value) against a baseline (name, median), each
    with the tolerance of the longest prefix of its name (prefix, tolerance)."""
    now = samples.groupBy("name").agg(F.expr("percentile(value, 0.5)").alias("median"))
    limits = now.join(tolerances, F.expr("startswith(name, prefix)")).groupBy("name").agg(F.max_by("tolerance", F.length("prefix")).alias("tolerance"))
    both = now.join(limits, "name").join(baseline.withColumnRenamed("median", "base"), "name")
    ratio = F.col("median") / F.col("base")
    verdict = F.when(ratio > 1 + F.col("tolerance"), "slower").when(ratio < 1 - F.col("tolerance"), "faster").otherwise("same")
    return both.select("name", "median", "base", "tolerance", verdict.alias("verdict"))


def histogram(values: DataFrame, column: str) -> DataFrame:
    """bucket (binary digits) and n."""
    return values.groupBy(log2_bucket(column).alias("bucket")).agg(F.count("*").alias("n"))
