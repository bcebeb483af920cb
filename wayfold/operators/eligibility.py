"""Requirements against client profiles, and what a profile may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.fields import QUICK_TELEPORT_MS, TICKS, fnv1a, integer, normalised, operator_code, trimmed

NOBODY, EVERYTHING = 0, 1  # profiles without any requirement met, and with all


def tags(requirements: DataFrame) -> DataFrame:
    """id, key, key_hash, op, is_number, number, word: a value is a number if it
    is integer text that fits 32 bits."""
    value = integer(trimmed("value"))
    number = F.when(value.between(-(2**31), 2**31 - 1), value)
    return requirements.select("id", normalised("key").alias("key"), fnv1a(normalised("key")).alias("key_hash"), operator_code("comparison").alias("op"), number.isNotNull().alias("is_number"), number.alias("number"), F.when(number.isNull(), normalised("value")).alias("word"))


def client_values(profiles: DataFrame) -> DataFrame:
    """profile_id, key, number, word: one key may have both; of several values of
    a type, the largest counts (a table has no order)."""
    value = integer(trimmed("value"))
    own = profiles.select("profile_id", normalised("key").alias("key"), value.alias("number"), F.when(value.isNull(), normalised("value")).alias("word"))
    return own.groupBy("profile_id", "key").agg(F.max("number").alias("number"), F.max("word").alias("word"))


def satisfaction(tag_table: DataFrame, profiles: DataFrame, ids: list[int]) -> DataFrame:
    """profile_id, req_id, ok for the given profiles. A missing key fails even
    "not equal"; words can only be equal or not; an unknown operator fails."""
    spark = tag_table.sparkSession
    values = client_values(profiles).select("profile_id", F.col("key").alias("k"), F.col("number").alias("n"), F.col("word").alias("v"))
    each = tag_table.crossJoin(F.broadcast(spark.createDataFrame([(i,) for i in ids], "profile_id int").withColumnRenamed("profile_id", "p")))  # one row a profile
    joined = each.join(values, (F.col("p") == F.col("profile_id")) & (F.col("key") == F.col("k")), "left")
    numeric = F.expr("CASE op WHEN 0 THEN n = number WHEN 1 THEN n <> number WHEN 2 THEN n > number WHEN 3 THEN n >= number WHEN 4 THEN n < number WHEN 5 THEN n <= number END")
    words = F.expr("CASE op WHEN 0 THEN v = word WHEN 1 THEN v <> word END")
    ok = F.when(F.col("p") == EVERYTHING, True).when(F.col("p") == NOBODY, False).otherwise(F.coalesce(F.when(F.col("is_number"), numeric).otherwise(words), F.lit(False)))
    return joined.select(F.col("p").alias("profile_id"), F.col("id").alias("req_id"), ok.alias("ok"))


def quick_profiles(profiles: DataFrame) -> DataFrame:
    """profile_id of those with quick teleports."""
    return profiles.where((normalised("key") == "hasquicktele") & normalised("value").isin("1", "true")).select("profile_id").distinct()


def identity(met: DataFrame) -> DataFrame:
    """profile_id, words: the requirements that a profile meets, a bit for each
    id in words of 64, as hexadecimal text. Profiles with equal words get equal
    answers, and no two others have the same."""
    bits = met.groupBy("profile_id", F.expr("req_id DIV 64").alias("word")).agg(F.expr("bit_or(CASE WHEN ok THEN shiftleft(1L, CAST(req_id % 64 AS INT)) ELSE 0L END)").alias("bits"))
    return bits.where("bits <> 0").groupBy("profile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: F.concat(w["word"].cast("string"), F.lit(":"), F.lower(F.hex(w["bits"])))), ",").alias("words"))


def allowed(edges: DataFrame, met: DataFrame, ids: list[int], key: list[str]) -> DataFrame:
    """edges by profile whose requirements are all met; ids that no requirement
    defines are not met, negative ids don't count. key names an edge."""
    spark = edges.sparkSession
    every = edges.crossJoin(F.broadcast(spark.createDataFrame([(i,) for i in ids], "profile_id int")))
    asked = every.select("profile_id", *key, F.explode(F.filter("reqs", lambda r: r >= 0)).alias("req_id"))
    failed = asked.join(met.where("ok"), ["profile_id", "req_id"], "left_anti").select("profile_id", *key).distinct()
    return every.join(failed, ["profile_id", *key], "left_anti")


def priced(edges: DataFrame, quick: DataFrame, kind: str = "kind") -> DataFrame:
    """edges by profile with cost as the profile pays it: what starts with a
    lodestone costs a quick teleport, dearer or not."""
    fast = quick.withColumn("_quick", F.lit(True))
    price = F.when(F.col("_quick") & (F.col(kind) == "lodestone"), F.lit(QUICK_TELEPORT_MS * TICKS).cast("long")).otherwise(F.col("cost"))
    return edges.join(fast, "profile_id", "left").withColumn("cost", price).drop("_quick")


def cheapest_globals(globals_: DataFrame) -> DataFrame:
    """profile_id, dst and the cheapest teleport that leads there."""
    return globals_.groupBy("profile_id", "dst").agg(F.min("cost").alias("cost"), F.min_by(F.struct("kind", "id"), F.struct("cost", "kind", "id")).alias("by")).select("profile_id", "dst", "cost", "by.kind", "by.id")
