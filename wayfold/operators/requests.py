"""Route requests as JSON, and full answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.fields import milliseconds

# The fields of a request.
_TILE = "struct<wx:int,wy:int,plane:int>"
_ABILITY = "enabled:boolean,cooldown_ms:double"
REQUEST = f"""start_id long, goal_id long, start {_TILE}, goal {_TILE}, seed long,
  profile struct<requirements:array<struct<key:string,value:string>>>, options struct<return_geometry:boolean,only_actions:boolean>,
  surge struct<{_ABILITY},charges:int>, dive struct<{_ABILITY},available_in_ms:double>"""


def decoded(bodies: DataFrame, column: str = "body") -> DataFrame:
    """bodies with the fields of a request in their place: ids or coordinates of
    both ends, requirements, seed (0 for none), what to return, abilities. What is
    not said has its default; a body that is no JSON object has problem set."""
    parsed = F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE"})
    own = bodies.withColumn("_r", parsed)
    at = lambda path, default: F.coalesce(F.col(f"_r.{path}"), F.lit(default))
    sound = F.get_json_object(F.col(column), "$").startswith("{")
    return own.select(
        *(c for c in bodies.columns if c != column),
        *(F.col(f"_r.{c}").alias(c) for c in ("start_id", "goal_id")),
        *(F.col(f"_r.{side}.{c}").alias(f"{side}_{name}") for side in ("start", "goal") for c, name in (("wx", "x"), ("wy", "y"), ("plane", "plane"))),
        at("seed", 0).alias("seed"),
        F.coalesce(F.col("_r.profile.requirements"), F.array().cast("array<struct<key:string,value:string>>")).alias("requirements"),
        at("options.return_geometry", False).alias("return_geometry"),
        at("options.only_actions", False).alias("only_actions"),
        at("surge.enabled", False).alias("surge"),
        at("surge.charges", 2).alias("surge_charges"),
        at("dive.enabled", False).alias("dive"),
        F.when(~F.coalesce(sound, F.lit(False)), "no_request").when(F.col("_r.goal_id").isNull() & F.col("_r.goal").isNull(), "no_goal").alias("problem"),
    )


def profile_rows(requests: DataFrame, key: str) -> DataFrame:
    """decoded() requests' requirements as rows: key (of the request), key, value."""
    return requests.select(F.col(key).alias("profile_id"), F.explode("requirements").alias("r")).select("profile_id", "r.key", "r.value")


def answered(routes: DataFrame, actions: DataFrame, points: DataFrame, asked: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """query_id and the answer as JSON, without what is null: found, cost in ms,
    path, length_tiles, reason (why a search gave up), degraded (that its seed was
    dropped), actions and geometry as far as they are asked for. asked: query_id,
    return_geometry, only_actions. only_actions leaves the path out. actions:
    query_id, pos, type, kind, id, cost_ms; points: query_id, pos, x, y, plane;
    dropped: query_id of answers without their seed."""
    ordered = lambda rows, item, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("v")))), lambda s: s["v"]).alias(name))
    acts = ordered(actions, F.struct("type", "kind", "id", "cost_ms"), "actions")
    shape = ordered(points, F.array("x", "y", "plane"), "geometry")
    out = routes.select("query_id", "status", "cost", "path").join(asked, "query_id").join(acts, "query_id", "left").join(shape, "query_id", "left")
    if dropped is not None:
        out = out.join(dropped.select("query_id", F.lit("seed_dropped").alias("degraded")), "query_id", "left")
    found = F.col("status") == "found"
    body = F.struct(
        found.alias("found"),
        F.coalesce(milliseconds("cost"), F.lit(0.0)).alias("cost"),
        F.when(found & ~F.col("only_actions"), F.col("path")).alias("path"),
        F.coalesce(F.size("path"), F.lit(0)).alias("length_tiles"),
        F.when(F.col("status").isin("budget_exceeded", "cancelled"), F.col("status")).alias("reason"),
        *([F.col("degraded")] if dropped is not None else []),
        F.when(found, F.coalesce("actions", F.array().cast(acts.schema["actions"].dataType))).alias("actions"),
        F.when(found & F.col("return_geometry"), F.col("geometry")).alias("geometry"),
    )
    return out.select("query_id", F.to_json(body).alias("body"))


def dumped(answers: DataFrame, path: str) -> None:
    """Write answers as lines of JSON."""
    answers.select("body").write.mode("overwrite").text(path)


def step_metadata(steps: DataFrame) -> DataFrame:
    """kind, id, row: a teleport row as JSON without nulls, and next_row: that of
    the row it points to, if there is one."""
    names = [c for c in steps.columns if c not in ("kind", "id")]
    own = steps.select("kind", "id", "next_kind", "next_id", F.to_json(F.struct("kind", "id", *names)).alias("row"))
    following = own.select(F.col("kind").alias("next_kind"), F.col("id").alias("next_id"), F.col("row").alias("next_row"))
    return own.join(following, ["next_kind", "next_id"], "left").select("kind", "id", "row", "next_row")


def statistics(routes: DataFrame) -> DataFrame:
    """status, n, and the costs' least and greatest, of a table of answers."""
    return routes.groupBy("status").agg(F.count("*").alias("n"), F.min("cost").alias("least"), F.max("cost").alias("greatest"))
