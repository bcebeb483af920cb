"""Surge and dive: abilities that cover several walked tiles at no cost.

A route's actions are taken in order, with charges, cooldowns and the heading of
the character as state, so a route is one row group of a pandas function."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SURGE_LEAST, DIVE_LEAST, LONGEST, FACING = 5, 2, 10, 3
DIVE_REACH, SURGE_SLACK = 10.5, 2.0
COOLDOWN_MS = 20400.0

ACTIONS = "query_id long, pos int, type string, from_x int, from_y int, from_plane int, x int, y int, plane int, cost_ms double, tiles int"


@dataclass
class Abilities:
    surge: bool = True
    charges: int = 2
    surge_cooldown: float = COOLDOWN_MS
    dive: bool = True
    dive_ready: float = 0.0
    dive_cooldown: float = COOLDOWN_MS


def _sign(a: int) -> int:
    return (a > 0) - (a < 0)


def _way(a: tuple, b: tuple) -> tuple | None:
    way = (_sign(b[0] - a[0]), _sign(b[1] - a[1]))
    return way if way != (0, 0) else None


@dataclass
class _Walk:
    """State while the actions of a route pass by."""

    rules: Abilities
    clock: float = 0.0
    ready: list[float] = field(default_factory=list)
    dive_ready: float = 0.0
    out: list[dict] = field(default_factory=list)

    def emit(self, kind: str, start: tuple | None, end: tuple, cost: float, tiles: int) -> None:
        self.out.append({"type": kind, "from": start, "to": end, "cost_ms": cost, "tiles": tiles})

    def faces(self, way: tuple) -> bool:
        """Whether the last FACING emitted actions were moves that way."""
        if len(self.out) <= FACING:
            return False
        last = self.out[-FACING - 1 :]
        return all(b["type"] == "move" and _way(a["to"], b["to"]) == way for a, b in zip(last, last[1:], strict=False))

    def try_dive(self, here: tuple, ahead: list[tuple]) -> int:
        if not self.rules.dive or self.dive_ready > self.clock:
            return 0
        for n in range(min(LONGEST, len(ahead)), DIVE_LEAST - 1, -1):
            end = ahead[n - 1]
            if end[2] == here[2] and math.dist(here[:2], end[:2]) <= DIVE_REACH:
                return n
        return 0

    def try_surge(self, here: tuple, ahead: list[tuple], dived: tuple | None) -> int:
        if not self.rules.surge or not any(t <= self.clock for t in self.ready):
            return 0
        for n in range(min(LONGEST, len(ahead)), SURGE_LEAST - 1, -1):
            end = ahead[n - 1]
            way = _way(here, end)
            if end[2] == here[2] and n <= math.dist(here[:2], end[:2]) + SURGE_SLACK and way:
                return n if dived == way or self.faces(way) else 0
        return 0


def insert_abilities(actions: list[tuple], rules: Abilities) -> list[dict]:
    """actions: (type, to, cost_ms), to a tuple of x, y, plane. Runs of moves are
    shortened where an ability may be used; anything else passes unchanged."""
    walk, at = _Walk(rules, ready=[0.0] * rules.charges, dive_ready=rules.dive_ready), 0
    while at < len(actions):
        kind, to, cost = actions[at]
        if kind != "move" or not (rules.surge or rules.dive):
            walk.emit(kind, None, to, cost, 1 if kind == "move" else 0)
            walk.clock += cost
            at += 1
            continue
        end = at
        while end < len(actions) and actions[end][0] == "move":
            end += 1
        run = [a[1] for a in actions[at:end]]
        here, i = (walk.out[-1]["to"] if walk.out else run[0]), 0
        while i < len(run):
            used, way = 0, None
            if n := walk.try_dive(here, run[i:]):
                walk.emit("dive", here, run[i + n - 1], 0.0, n)
                walk.dive_ready = walk.clock + rules.dive_cooldown
                way, here, i, used = _way(here, run[i + n - 1]), run[i + n - 1], i + n, n
            if n := walk.try_surge(here, run[i:], way):
                walk.emit("surge", here, run[i + n - 1], 0.0, n)
                charge = next(k for k, t in enumerate(walk.ready) if t <= walk.clock)
                walk.ready[charge] = walk.clock + rules.surge_cooldown
                here, i, used = run[i + n - 1], i + n, n
            if not used:
                walk.emit("move", None, run[i], actions[at + i][2], 1)
                walk.clock += actions[at + i][2]
                here, i = run[i], i + 1
        at = end
    return walk.out


def with_abilities(actions: DataFrame, rules: Abilities) -> DataFrame:
    """actions: query_id, pos, type, x, y, plane (where it ends), cost_ms."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("pos")
        out = insert_abilities([(r.type, (int(r.x), int(r.y), int(r.plane)), float(r.cost_ms)) for r in rows.itertuples()], rules)
        made = [(int(rows.query_id.iloc[0]), k, a["type"], *(a["from"] or (None,) * 3), *a["to"], a["cost_ms"], a["tiles"]) for k, a in enumerate(out)]
        return pd.DataFrame(made, columns=[c.split()[0] for c in ACTIONS.split(", ")]).astype({c: "Int32" for c in ("from_x", "from_y", "from_plane")})

    return actions.groupBy("query_id").applyInPandas(run, ACTIONS)


def move_runs(actions: DataFrame) -> DataFrame:
    """Runs of neighbouring actions of one type: query_id, run, type, first_pos,
    n, cost_ms."""
    w = Window.partitionBy("query_id").orderBy("pos")
    new = F.when(F.lag("type").over(w).eqNullSafe(F.col("type")), 0).otherwise(1)
    own = actions.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return own.groupBy("query_id", "run", "type").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"), F.sum("cost_ms").alias("cost_ms"))
