"""Tables of path blobs, and texts made of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources.text import sniffed, triplets


def path_table(spark: SparkSession, name: str, entrance_from: int | None = None) -> DataFrame:
    """entrance_from, entrance_to, points of a catalog table; a null blob has no
    points. Names are letters, digits and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"not a table name: {name}")
    return path_points(spark.table(name), entrance_from)


def path_points(rows: DataFrame, entrance_from: int | None = None) -> DataFrame:
    """rows: entrance_from, entrance_to, path_blob (text in hex or base64, or bytes)."""
    kept = rows if entrance_from is None else rows.where(F.col("entrance_from") == entrance_from)
    blob = sniffed("path_blob") if dict(rows.dtypes)["path_blob"] == "string" else F.col("path_blob")
    own = kept.select("entrance_from", "entrance_to", F.coalesce(blob, F.lit(b"")).alias("_b"))
    return own.select("entrance_from", "entrance_to", triplets("_b").alias("points")).orderBy("entrance_from", "entrance_to")


def as_csv(paths: DataFrame) -> DataFrame:
    """line: one for each point, or one without a point."""
    each = paths.select("entrance_from", "entrance_to", F.posexplode_outer("points").alias("pos", "p"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return each.select("entrance_from", "entrance_to", "pos", F.concat_ws(",", "entrance_from", "entrance_to", text("p.x"), text("p.y"), text("p.plane")).alias("line"))


def as_json(paths: DataFrame) -> DataFrame:
    """One JSON object for each path."""
    return paths.select("entrance_from", "entrance_to", F.to_json(F.struct("entrance_from", "entrance_to", "points")).alias("text"))


def as_coordinates(paths: DataFrame) -> DataFrame:
    """Each path as the declaration of an array of coordinates."""
    point = lambda p: F.concat(F.lit("    new Coordinate("), F.concat_ws(", ", p["x"], p["y"], p["plane"]), F.lit(")"))
    head = F.concat(F.lit("Coordinate[] path_from_"), F.col("entrance_from"), F.lit("_to_"), F.col("entrance_to"), F.lit(" = {\n"))
    body = F.when(F.size("points") > 0, F.concat(F.array_join(F.transform("points", point), ",\n"), F.lit("\n"))).otherwise("")
    return paths.select("entrance_from", "entrance_to", F.concat(head, body, F.lit("};")).alias("text"))


def tiles_of(spark: SparkSession, regions: str = "tiles_regions", rows: str = "tiles") -> DataFrame:
    """Tiles from the table of region blobs where the catalog has one, else from
    the table of single tiles."""
    from wayfold.sources.regions import unpack_regions

    if spark.catalog.tableExists(regions):
        return unpack_regions(spark.table(regions)).select("x", "y", "plane", "walk_mask")
    return spark.table(rows).select("x", "y", "plane", "walk_mask")


def with_column(rows: DataFrame, name: str, kind: str = "string") -> DataFrame:
    """rows with a column that older tables lack, null there."""
    return rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
