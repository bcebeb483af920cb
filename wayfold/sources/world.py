"""A world of tiles, teleports, rings and requirements from the star-schema
tables: tiles from orders; doors, npcs, objects, slots and rings from supplier;
lodestones from nation; items and charges from region; requirements from part;
route queries from nation: 25 at every scale factor, since the SQL that they are
held against relaxes from each of them. Every table is used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(k: str) -> list:
    """Coordinates of place number k."""
    return [F.expr(f"CAST(3200 + (({k} DIV 4096) % 2) * 64 + ({k} % 4096) % 64 AS INT)"), F.expr(f"CAST(3200 + (({k} DIV 4096) DIV 4) * 64 + ({k} % 4096) DIV 64 AS INT)"), F.expr(f"CAST((({k} DIV 4096) DIV 2) % 2 AS INT)")]


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, plane, walk_mask."""
    x, y, p = _place("o_orderkey")
    mask = F.expr("CAST(240 | (15 - CASE WHEN o_custkey % 6 < 4 THEN 0 ELSE shiftleft(1, CAST(o_custkey % 4 AS INT)) END) AS INT)")
    return table(spark, sf_dir, "orders").where("o_custkey % 7 <> 0").select(x.alias("x"), y.alias("y"), p.alias("plane"), mask.alias("walk_mask"))


STEP_COLUMNS = ["kind", "id", "src_x", "src_y", "src_plane", "dst_x", "dst_y", "dst_plane", "cost_ms", "next_kind", "next_id", "requirements"]


def _with_places(df: DataFrame, n: int) -> DataFrame:
    """src_k and dst_k, reduced modulo the number of places, to coordinates."""
    df = df.withColumn("src_k", F.col("src_k") % n).withColumn("dst_k", F.col("dst_k") % n)
    for side in ("src", "dst"):
        for name, column in zip(("x", "y", "plane"), _place(f"{side}_k"), strict=True):
            df = df.withColumn(f"{side}_{name}", column)
    return df


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All teleport rows as one table; src is null for teleports from anywhere."""
    n = table(spark, sf_dir, "orders").count()
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "s")
    text = """CASE WHEN s % 3 = 0 THEN NULL WHEN s % 3 = 1 THEN CAST(s % 40 AS STRING)
              ELSE concat(s % 40, '; ', (7 * s) % 45 + CASE WHEN s % 15 = 2 THEN 1000000 ELSE 0 END) END"""
    a, a1, b = "s * 149", "s * 149 + 1", "s * 7919 + 31"
    none, no_id = "CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)"

    def rows(df, kind, key, src, dst, cost, next_kind, next_id, reqs):
        return df.select(F.lit(kind).alias("kind"), F.expr(f"CAST({key} AS BIGINT)").alias("id"), F.expr(f"CAST({src} AS BIGINT)").alias("src_k"), F.expr(f"CAST({dst} AS BIGINT)").alias("dst_k"), F.expr(f"CAST({cost} AS DOUBLE)").alias("cost_ms"), F.expr(next_kind).alias("next_kind"), F.expr(f"CAST({next_id} AS BIGINT)").alias("next_id"), F.expr(reqs).alias("requirements"))

    parts = [
        rows(s.where("s % 5 = 0"), "door", "s", a, a1, "600", "CASE WHEN s % 10 = 0 THEN 'lodestone' END", "CASE WHEN s % 10 = 0 THEN s % 25 END", text),
        rows(s.where("s % 5 = 1"), "npc", "s", a, b, "1800", none, no_id, text),
        rows(s.where("s % 5 = 2"), "object", "s", a, f"CASE WHEN s % 3 = 0 THEN NULL ELSE {b} END", "1200", "CASE WHEN s % 35 = 2 THEN 'object' WHEN s % 3 = 0 THEN 'npc' END", "CASE WHEN s % 35 = 2 THEN s WHEN s % 3 = 0 THEN s - 1 END", text),
        rows(s.where("s % 5 = 3"), "ifslot", "s", no_id, b, "3000", none, no_id, text),
        rows(table(spark, sf_dir, "nation"), "lodestone", "n_nationkey", no_id, "n_nationkey * 601 + 17", "17000 + 100 * n_nationkey", none, no_id, "CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS STRING) END"),
        rows(table(spark, sf_dir, "region"), "item", "r_regionkey", no_id, no_id, "2000", "CASE WHEN r_regionkey < 4 THEN 'ifslot' ELSE 'nosuch' END", "CASE WHEN r_regionkey < 4 THEN 5 * r_regionkey + 3 ELSE 1 END", none),
        rows(table(spark, sf_dir, "region"), "poa_item", "r_regionkey", no_id, "r_regionkey * 31 + 3", "2500", none, no_id, "CAST(r_regionkey AS STRING)"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _with_places(out, n).select(STEP_COLUMNS)


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, plane, cost_ms (null counts as 0), code, requirements."""
    n = table(spark, sf_dir, "orders").count()
    x, y, p = _place("k")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 5 = 4").withColumn("k", F.expr(f"(s_suppkey * 149) % {n}"))
    reqs = F.expr("CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 40 AS STRING) END")
    return s.select(F.col("s_suppkey").alias("id"), x.alias("x"), y.alias("y"), p.alias("plane"), F.expr("CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(600 * (1 + s_suppkey % 3) AS DOUBLE) END").alias("cost_ms"), F.concat(F.lit("C"), F.col("s_suppkey")).alias("code"), reqs.alias("requirements"))


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, key, value, comparison: text as in the source."""
    op = "element_at(array('==', ' = ', '!=', '>=', '>', '<=', '<', '~'), CAST(p_partkey % 8 AS INT) + 1)"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(' ', p_brand, '\\t')").alias("key"), F.expr("CASE WHEN p_partkey % 4 = 3 THEN p_type ELSE CAST(p_size AS STRING) END").alias("value"), F.expr(op).alias("comparison"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """profile_id, key, value: 2 has a number and a text for each brand, 3 the
    same and quick teleports; 0 is empty and 1 satisfies everything."""
    brands = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_type").alias("t"))
    both = brands.select(F.explode(F.array(F.lit(2), F.lit(3))).alias("profile_id"), "p_brand", "t")
    rows = both.select("profile_id", F.upper("p_brand").alias("key"), F.lit(" 25 ").alias("value")).unionByName(both.select("profile_id", F.col("p_brand").alias("key"), F.col("t").alias("value")))
    quick = spark.createDataFrame([(3, "HASQuickTele", "1")], "profile_id int, key string, value string")
    return rows.unionByName(quick)


def route_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, profile_id, seed, start and goal coordinates: one for each
    nation; starts may lie beside the tiles."""
    n = table(spark, sf_dir, "orders").count()
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.expr("CAST(n_nationkey % 4 AS INT)").alias("profile_id"), F.expr("CAST(n_nationkey % 3 AS BIGINT)").alias("seed"), F.expr(f"(n_nationkey * 97 + 5) % {n}").alias("a"), F.expr(f"(n_nationkey * 577 + 11) % {n}").alias("b"))
    names = [f"{s}_{c}" for s in ("start", "goal") for c in ("x", "y", "plane")]
    return q.select("query_id", "profile_id", "seed", *(c.alias(k) for k, c in zip(names, [*_place("a"), *_place("b")], strict=True)))
