"""Golden answers, and runs held against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The generator of sample ids.
_TIMES, _PLUS, _SEED = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15
#: Relative tolerance of a cost, and what a seed adds to an edge at most (ms).
TOLERANCE, JITTER_MS = 1e-4, 0.1

CORPUS = "name string, start array<int>, goal array<int>, profile string, quick_tele boolean, expect struct<found:boolean,cost_unseeded:double,entry:long,pops_max:long>"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON file of golden entries, by name: found, cost, entry, pops_max."""
    return spark.read.schema(CORPUS).option("multiLine", True).json(path).select("name", "start", "goal", "profile", "quick_tele", "expect.*")


def bless(runs: DataFrame, corpus: DataFrame, path: str) -> None:
    """Write the corpus anew, with what the runs found as its expectations:
    runs: name, found, cost, entry, pops."""
    kept = corpus.select("name", "start", "goal", "profile", "quick_tele").join(runs, "name")
    made = F.struct("found", F.col("cost").alias("cost_unseeded"), "entry", F.col("pops").alias("pops_max"))
    kept.select("name", "start", "goal", "profile", "quick_tele", made.alias("expect")).coalesce(1).write.mode("overwrite").json(path)


def failures(golden: DataFrame, runs: DataFrame, slack: float = 1.0, bucket_ms: float = 0.0) -> DataFrame:
    """What is wrong with each run: name, run, problem, a row for each. golden:
    name, found, cost, edges, pops_max; runs: name, run, seed, found, cost, pops.
    A seed may add JITTER_MS an edge."""
    both = runs.join(golden.select("name", F.col("found").alias("g_found"), F.col("cost").alias("g"), "edges", "pops_max"), "name")
    rough = TOLERANCE * F.greatest("g", F.lit(1.0))
    high = F.when(F.col("seed") > 0, F.col("g") + JITTER_MS * F.col("edges") + bucket_ms + 1e-3).otherwise(F.col("g") + rough + bucket_ms)
    low = F.when(F.col("seed") > 0, F.col("g") - 1e-3).otherwise(F.col("g") - rough)
    checks = F.array(
        F.when(F.col("found") != F.col("g_found"), "found"),
        F.when(F.col("pops") > slack * F.col("pops_max"), "pops"),
        F.when(F.col("found") & F.col("g_found") & ~F.col("cost").between(low, high), "cost"),
    )
    return both.select("name", "run", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("problem"))


def disagreements(runs: DataFrame, bucket_ms: float = 0.0) -> DataFrame:
    """name, seed of runs that found an answer at different costs."""
    found = runs.where("found").groupBy("name", "seed").agg(F.min("cost").alias("low"), F.max("cost").alias("high"), F.count("*").alias("n"))
    return found.where((F.col("n") > 1) & (F.col("high") - F.col("low") > 1e-3 * F.greatest("low", F.lit(1.0)) + bucket_ms)).select("name", "seed", "low", "high")


def summary(golden: DataFrame, runs: DataFrame, slack: float = 1.0) -> DataFrame:
    """run, n (answers), failures (with one or more) and the most nodes settled."""
    wrong = failures(golden, runs, slack).select("name", "run").distinct().withColumn("bad", F.lit(1))
    return runs.join(wrong, ["name", "run"], "left").groupBy("run").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("failures"), F.max("pops").alias("most_pops"))


def payload_differences(expected: DataFrame, got: DataFrame) -> DataFrame:
    """name, field, problem of answers as JSON objects: fields that one lacks or
    that differ, and names without an answer. What changes from run to run
    (duration_ms) doesn't count."""
    fields = lambda rows: rows.select("name", F.explode(F.map_filter(F.from_json("body", "map<string,string>"), lambda k, v: k != "duration_ms")).alias("field", "value"))
    a, b = fields(expected).withColumnRenamed("value", "a"), fields(got).withColumnRenamed("value", "b")
    there = got.select("name", F.lit(True).alias("there")).distinct()
    both = a.join(b, ["name", "field"], "full").join(there, "name", "left")
    kind = F.when(F.col("there").isNull(), "no_answer").when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "differs")
    return both.join(expected.select("name").distinct(), "name", "left_semi").withColumn("problem", kind).where("problem IS NOT NULL").select("name", F.when(F.col("problem") != "no_answer", F.col("field")).alias("field"), "problem").distinct()


def sample_ids(spark: SparkSession, n: int, draws: int = 4096) -> DataFrame:
    """id, draw: numbers below n from a linear congruential generator of 64 bits,
    each id at its first draw. As many numbers as asked for are made."""
    state, out = _SEED, {}
    for k in range(draws):
        state = (state * _TIMES + _PLUS) % (1 << 64)
        out.setdefault((state >> 33) % n, k)
    return spark.createDataFrame(sorted(out.items()), "id long, draw int")


def every(rows: DataFrame, column: str, step: int, first: int | None = None) -> DataFrame:
    """Rows whose number is a multiple of step; the first so many of them."""
    chosen = rows.where(F.col(column) % step == 0)
    return chosen if first is None else chosen.orderBy(column).limit(first)


def far_pairs(samples: DataFrame, reachable: Column, buckets: list[tuple[str, int, int]], each: int = 4) -> DataFrame:
    """bucket, a, b: of the pairs of a table of sample nodes (id, x, y, and what
    reachable reads as a.* and b.*; a few thousand at most), the first `each` of
    every bucket of distances that are reachable."""
    pairs = samples.alias("a").join(samples.alias("b"), F.col("a.id") < F.col("b.id")).where(reachable)
    far = F.greatest(F.abs(F.col("a.x") - F.col("b.x")), F.abs(F.col("a.y") - F.col("b.y")))
    name = F.coalesce(*(F.when(far.between(low, high), F.lit(n)) for n, low, high in buckets))
    named = pairs.select(name.alias("bucket"), F.col("a.id").alias("a"), F.col("b.id").alias("b")).where("bucket IS NOT NULL")
    return named.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("a", "b"))).where(F.col("k") <= each).drop("k")
