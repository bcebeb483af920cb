"""Tiles packed by 64 x 64 region: a blob of 512 bytes with a presence bit for
each place and 4096 bytes with its movement mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOB = 512 + 4096


def pack_regions(tiles: DataFrame) -> DataFrame:
    """plane, base_x, base_y, blob. A region has 4096 tiles at most, so a group
    is small whatever the world."""
    own = tiles.withColumns({"base_x": F.expr("x - x % 64"), "base_y": F.expr("y - y % 64")})

    def run(group: pd.DataFrame) -> pd.DataFrame:
        at = ((group.y - group.base_y) * 64 + group.x - group.base_x).to_numpy()
        here, masks = np.zeros(4096, np.uint8), np.zeros(4096, np.uint8)
        here[at], masks[at] = 1, group.walk_mask.to_numpy()
        first = group.iloc[0]
        return pd.DataFrame({"plane": [first.plane], "base_x": [first.base_x], "base_y": [first.base_y], "blob": [np.packbits(here, bitorder="little").tobytes() + masks.tobytes()]})

    return own.groupBy("plane", "base_x", "base_y").applyInPandas(run, "plane int, base_x int, base_y int, blob binary")


def unpack_regions(regions: DataFrame) -> DataFrame:
    """x, y, plane, walk_mask of every present place, in SQL functions; a blob
    of another length is an error."""
    checked = regions.withColumn("blob", F.when(F.length("blob") == BLOB, F.col("blob")).otherwise(F.raise_error(F.lit("a region blob has 4608 bytes")).cast("binary")))
    places = checked.select("plane", "base_x", "base_y", F.hex("blob").alias("h"), F.explode(F.sequence(F.lit(0), F.lit(4095))).alias("i"))
    byte = lambda at: F.conv(F.expr(f"substring(h, 2 * ({at}) + 1, 2)"), 16, 10).cast("int")
    bit = F.expr("shiftright(b, i % 8) & 1")
    return places.withColumn("b", byte("i DIV 8")).where(bit == 1).select(F.expr("base_x + i % 64").alias("x"), F.expr("base_y + i DIV 64").cast("int").alias("y"), "plane", byte("512 + i").alias("walk_mask"))
