"""Text and blob readers: coordinate files, packed integers, results in several
shapes, and the writers that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coordinates(lines: DataFrame, column: str = "value") -> DataFrame:
    """x, y, plane of each line with three integers or more, with more columns
    kept; blank lines go, any other line gives nulls and ok = false."""
    parts = F.filter(F.split(F.trim(F.translate(F.col(column), ",;\t", "   ")), " +"), lambda p: p != "")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    got = lines.where(F.length(F.trim(F.col(column))) > 0).withColumns({"x": number(0), "y": number(1), "plane": number(2)})
    return got.withColumn("ok", F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("plane").isNotNull())


def triplets(blob: str) -> Column:
    """Little-endian 32-bit integers in threes as an array of structs; null where
    the length is no multiple of 12."""
    digits = F.hex(F.col(blob))
    word = lambda i: F.conv(F.concat(*(F.substring(digits, i * 8 + 7 - 2 * k, 2) for k in range(4))), 16, 10).cast("long")
    signed = lambda v: F.when(v >= 2**31, v - 2**32).otherwise(v).cast("int")
    n = (F.length(F.col(blob)) / 12).cast("int")
    made = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(signed(word(i * 3)).alias("x"), signed(word(i * 3 + 1)).alias("y"), signed(word(i * 3 + 2)).alias("plane")))
    return F.when(F.length(F.col(blob)) % 12 == 0, F.when(n == 0, F.array().cast("array<struct<x:int,y:int,plane:int>>")).otherwise(made))


def sniffed(text: str) -> Column:
    """Bytes of text that may be hex (with 0x or X'..' or not) or base64; else
    its UTF-8 bytes."""
    t = F.trim(F.col(text))
    bare = F.regexp_replace(F.regexp_replace(t, r"^(0[xX]|\\x)", ""), r"^[xX]'([0-9a-fA-F]*)'$", "$1")
    is_hex = bare.rlike(r"^([0-9a-fA-F]{2})+$")
    is_64 = t.rlike(r"^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (F.length(t) > 0)
    return F.when(is_hex, F.unhex(bare)).when(is_64, F.unbase64(t)).otherwise(F.encode(t, "UTF-8"))


_POINT = "array<int>"


def path_points(body: str) -> Column:
    """Points of a result body in any of four shapes: {path: [[x,y,p]]},
    {geometry: [[x,y,p]]}, {actions: [{to: [x,y,p]}]}, {actions: [{to: {min: [x,y,p]}}]}."""
    of = lambda shape, field: F.from_json(F.col(body), shape)[field]
    plain = of(f"path array<{_POINT}>", "path")
    shown = of(f"geometry array<{_POINT}>", "geometry")
    to = F.transform(of(f"actions array<struct<to:{_POINT}>>", "actions"), lambda a: a["to"])
    boxed = F.transform(of(f"actions array<struct<to:struct<min:{_POINT},max:{_POINT}>>>", "actions"), lambda a: F.coalesce(a["to"]["max"], a["to"]["min"]))
    full = lambda c: F.when((F.size(c) > 0) & F.forall(c, lambda p: p.isNotNull()), c)
    return F.coalesce(full(plain), full(shown), full(to), full(boxed))


def array_text(points: Column) -> Column:
    """The points as an array literal: {{x, y, p}, ...}."""
    return F.concat(F.lit("{"), F.array_join(F.transform(points, lambda p: F.concat(F.lit("{"), F.array_join(p.cast("array<string>"), ", "), F.lit("}"))), ", "), F.lit("}"))


def without_repeats(points: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Rows that differ in values from the one before, in order, by keys."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    now, before = F.struct(*values), F.lag(F.struct(*values)).over(w)
    return points.withColumn("_same", now.eqNullSafe(before) & (F.row_number().over(w) > 1)).where("not _same").drop("_same")
