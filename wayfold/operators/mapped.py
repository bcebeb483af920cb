"""Searches over graphs whose edges a task keeps in files of its own, mapped into
memory: for more edges than `search.route` ships as arrays. A search holds one
cost for each node, and moves all nodes of a range of costs on at once, so the
steps of a search are arrays, not nodes. Costs, paths and counts of settled nodes
are those of `search.Graph`.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.fields import CARDINAL
from wayfold.operators.tables import stored

#: Edges, and nodes, of which every task may keep files (10 bytes an edge, 16 a
#: node) and, of nodes, a cost in memory.
MAPPED_EDGES = 100_000_000
#: Nodes of one row of edges.
BLOCK = 32_768
#: Nodes whose edges a search follows at once.
FRONT = 65_536
#: Rows that a task hands on at once.
OUT_ROWS = 250_000
PARTS = "kind string, profile_id int, key long, a binary, b binary, c binary"
NO_WAY = 1 << 62
JITTER = 65535


def jitters(seed: int, u: np.ndarray | int, v: np.ndarray | int) -> np.ndarray | int:
    """search.tick_jitter() for arrays."""
    if not seed:
        return 0
    h = (np.bitwise_xor(seed & JITTER, np.asarray(u, np.int64)) & JITTER) * 435
    return (((h ^ np.asarray(v, np.int64)) & JITTER) * 435) & JITTER


def _runs(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places first, first + 1, ... of every run, and the number of its run."""
    ends = np.cumsum(count)
    at = np.arange(ends[-1] if len(ends) else 0)
    at += np.repeat(first - ends + count, count)
    return at, np.repeat(np.arange(len(count)), count)


class Side:
    """Edges by the node at one end: those of all profiles in mapped arrays, a
    profile's own (near, far, w) sorted here. weights: what codes stand for, if
    they are codes."""

    def __init__(self, first: np.ndarray, other: np.ndarray, code: np.ndarray, weights: np.ndarray | None, own: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.first, self.other, self.code, self.weights = first, other, code, weights
        order = np.argsort(own[0], kind="stable")
        self.near, self.far, self.w = (c[order] for c in own)

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every edge at nodes: the place of its node in nodes, its other end
        and its weight."""
        a = self.first[nodes]
        at, i = _runs(a, self.first[nodes + 1] - a)
        other, w = self.other[at], self.code[at]
        w = w if self.weights is None else self.weights[w]
        lo = np.searchsorted(self.near, nodes)
        count = np.searchsorted(self.near, nodes, "right") - lo
        if not count.any():
            return i, other, w
        at, j = _runs(lo, count)
        return np.concatenate([i, j]), np.concatenate([other, self.far[at]]), np.concatenate([w, self.w[at]])


class Wide:
    """A profile's graph: both sides (None if not asked for), rings and globals."""

    def __init__(self, n: int, out: Side | None, into: Side | None, rings: dict[int, int], globals_: dict[int, int]):
        self.n, self.out, self.into, self.globals = n, out, into, globals_
        self.ring = np.array(sorted(rings), np.int64)
        self.fare = np.array([rings[r] for r in sorted(rings)], np.int64)

    def _ring(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those of nodes that are rings, and of their rings."""
        at = np.searchsorted(self.ring, nodes)
        at[at == len(self.ring)] = 0
        here = np.flatnonzero(self.ring[at] == nodes) if len(self.ring) else np.zeros(0, np.int64)
        return here, at[here]

    def _entries(self, sources: dict[int, int], seed: int, origin: bool) -> dict[int, int]:
        best = dict(sources)
        for s, c in sources.items() if origin else ():
            for v, g in self.globals.items():
                d = c + g + int(jitters(seed, s, v))
                if v != s and d < best.get(v, d + 1):
                    best[v] = d
        return best

    def costs(self, sources: dict[int, int], goals: set[int] | None = None, seed: int = 0, origin: bool = True, back: bool = False) -> np.ndarray:
        """Least cost of each node, NO_WAY where there is none (back: of the way
        from it, by no global teleport). With goals, costs up to the dearest
        goal's are final, others may be too high."""
        side = self.into if back else self.out
        entry = dict(sources) if back else self._entries(sources, seed, origin)
        best, waiting = np.full(self.n, NO_WAY), np.zeros(self.n, bool)
        open_ = np.array(sorted(entry), np.int64)
        best[open_] = [entry[v] for v in open_.tolist()]
        waiting[open_] = True
        wanted = None if goals is None else np.array(sorted(goals), np.int64)
        low = NO_WAY  # the cheapest way into the rings that was followed
        while len(open_):
            d = best[open_]
            least = int(d.min())
            if wanted is not None and (best[wanted] < least).all():
                break
            now = d < (least // CARDINAL + 1) * CARDINAL
            front, d, open_ = open_[now], d[now], open_[~now]
            waiting[front] = False
            tried = [self._by_edges(side, best, front[k : k + FRONT], d[k : k + FRONT], seed, back) for k in range(0, len(front), FRONT)]
            here, ring = self._ring(front)
            if len(here):
                by, low = self._by_rings(front[here], ring, d[here], low, seed, back)
                better = by < best[self.ring]
                tried.append((self.ring[better], by[better]))
            v, c = (np.concatenate(x) for x in zip(*tried, strict=True))
            if len(v):
                np.minimum.at(best, v, c)
                fresh = np.unique(v[~waiting[v]])
                waiting[fresh] = True
                open_ = np.concatenate([open_, fresh])
        return best

    def _by_edges(self, side: Side, best: np.ndarray, nodes: np.ndarray, d: np.ndarray, seed: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that get cheaper by an edge at nodes, which cost d, and their costs."""
        i, v, w = side.of(nodes)
        c = d[i] + w
        if seed:
            c += jitters(seed, v, nodes[i]) if back else jitters(seed, nodes[i], v)
        better = c < best[v]
        return v[better].astype(np.int64), c[better]

    def _by_rings(self, nodes: np.ndarray, ring: np.ndarray, d: np.ndarray, low: int, seed: int, back: bool) -> tuple[np.ndarray, int]:
        """What each ring costs by way of nodes, which are rings. One that is as
        dear as one before, or dearer by more than a jitter, leads nowhere cheaper."""
        out, key = np.full(len(self.ring), NO_WAY), d + self.fare[ring] if back else d
        first = int(np.argmin(key))
        if seed:
            use = np.flatnonzero(key <= min(low, int(key[first])) + JITTER)
        else:
            use = np.array([first] if key[first] < low else [], np.int64)
        for k in use.tolist():
            u = int(nodes[k])
            c = key[k] + (0 if back else self.fare) + (jitters(seed, self.ring, u) if back else jitters(seed, u, self.ring)) + np.zeros(len(self.ring), np.int64)
            c[ring[k]] = NO_WAY
            np.minimum(out, c, out)
        return out, min(low, int(key[first]))

    def _before(self, best: np.ndarray, sources: dict[int, int], nodes: np.ndarray, seed: int, origin: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (u, place in nodes) of edges that lead to nodes at their cost."""
        def fit(u, w, i):
            ok = best[u] + w + jitters(seed, u, nodes[i]) == best[nodes[i]]
            return u[ok].astype(np.int64), (i if np.ndim(i) else np.full(len(u), i))[ok]

        i, u, w = self.into.of(nodes)
        yield fit(u, w, i)
        for k, r in zip(*(x.tolist() for x in self._ring(nodes)), strict=True):
            yield fit(np.delete(self.ring, r), self.fare[r], k)
        for k, v in enumerate(nodes.tolist()) if origin and self.globals else ():
            if v in self.globals:
                yield fit(np.array([s for s in sources if s != v], np.int64), self.globals[v], k)

    def before(self, best: np.ndarray, sources: dict[int, int], nodes: np.ndarray, seed: int, origin: bool) -> tuple[np.ndarray, np.ndarray]:
        """_before() in one."""
        u, i = (np.concatenate(x) for x in zip(*self._before(best, sources, nodes, seed, origin), strict=True))
        return u, i

    def _level(self, best: np.ndarray, sources: dict[int, int], nodes: np.ndarray, seed: int, origin: bool) -> list[int]:
        """nodes, all those of one cost (or all that lead to some of them at that
        cost), in the order in which a search with a heap settles them."""
        u, i = self.before(best, sources, nodes, seed, origin)
        cost = best[nodes[0]]
        less = best[u] < cost
        ready = np.zeros(len(nodes), bool)
        ready[i[less]] = True
        ready |= np.array([v in sources and sources[v] == cost for v in nodes.tolist()], bool)
        if not origin or not self.globals:
            entered = {}
        else:
            entered = self._entries(sources, seed, origin)
        ready |= np.array([entered.get(v) == cost for v in nodes.tolist()], bool)
        after: dict[int, list[int]] = {}
        for a, k in zip(u[~less].tolist(), i[~less].tolist(), strict=True):
            after.setdefault(a, []).append(int(nodes[k]))
        heap = nodes[ready].tolist()
        if not after:
            return sorted(heap)
        heapq.heapify(heap)
        seen, order = set(heap), []
        while heap:
            v = heapq.heappop(heap)
            order.append(v)
            for x in after.get(v, ()):
                if x not in seen:
                    seen.add(x)
                    heapq.heappush(heap, x)
        return order

    def settled(self, best: np.ndarray, sources: dict[int, int], goal: int, seed: int, origin: bool) -> int:
        """How many nodes a search has settled with the goal."""
        same = np.flatnonzero(best == best[goal])
        rank = 1 if len(same) == 1 else self._level(best, sources, same, seed, origin).index(goal) + 1
        return int((best < best[goal]).sum()) + rank

    def path(self, best: np.ndarray, sources: dict[int, int], goal: int, seed: int = 0, origin: bool = True) -> list[int]:
        """search.Graph.path() by the costs of all nodes."""
        out, v = [goal], goal
        while not (v in sources and best[v] == sources[v]):
            u, _ = self.before(best, sources, np.array([v]), seed, origin)
            less, same = u[best[u] < best[v]], np.unique(u[best[u] == best[v]])
            if not len(less):
                fed = {int(same[k]) for x, k in zip(*self.before(best, sources, same, seed, origin), strict=True) if best[x] < best[v]}
                less = [x for x in same.tolist() if x in sources or x in fed]
            v = int(min(less)) if len(less) else self._earlier(best, sources, v, same, seed, origin)
            out.append(v)
        return out[::-1]

    def _earlier(self, best: np.ndarray, sources: dict[int, int], v: int, same: np.ndarray, seed: int, origin: bool) -> int:
        """The smallest of same, which lead to v for nothing, that is settled
        before v."""
        level, front = {v}, same.tolist()
        while front:
            level.update(front)
            u, _ = self.before(best, sources, np.array(front), seed, origin)
            front = [x for x in np.unique(u[best[u] == best[v]]).tolist() if x not in level]
        order = self._level(best, sources, np.array(sorted(level)), seed, origin)
        return min(x for x in same.tolist() if order.index(x) < order.index(v))


def _local(total: int, dtype) -> np.ndarray:
    """An array in a file of this task's, which goes with it."""
    if not total:
        return np.zeros(0, dtype)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    with tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None) as file:
        return np.memmap(file, dtype, "w+", shape=(total,))


@dataclass
class Mapped:
    """Graphs of n nodes, one for each profile. rows: PARTS, with edges (`out` by
    their source, `into` by their end) in blocks of BLOCK nodes: how many each
    node has, their other ends and weights, or codes of weights. places: where the
    edges of each kind and block begin; totals: how many there are."""

    n: int
    rows: DataFrame
    weights: list[int] | None
    places: dict[tuple[str, int], int]
    totals: dict[str, int]

    def run(self, asked: DataFrame, f: Callable[[list[dict], Callable[[int], Wide]], Iterator[pa.RecordBatch]], schema: str, sides: tuple[str, ...] = ("out", "into")) -> DataFrame:
        """f for the rows of asked that have the same p (0, 1, ...), and a function
        that gives a profile's graph. Each p is a task, and gets the edges once,
        batch by batch, into files of its own."""
        ps = asked.select("p").distinct()
        count = 1 + (asked.agg(F.max("p")).first()[0] or 0)
        held = self.rows.where(~F.col("kind").isin([s for s in ("out", "into") if s not in sides])).join(F.broadcast(ps))  # a row for each task
        none = F.lit(None)
        own = asked.select(F.lit("ask").alias("kind"), none.cast("int").alias("profile_id"), F.lit(0).cast("long").alias("key"), F.to_json(F.struct(*asked.columns)).cast("binary").alias("a"), none.cast("binary").alias("b"), none.cast("binary").alias("c"), "p")
        sent = held.select("kind", "profile_id", "key", "a", "b", "c", "p").unionByName(own).repartitionById(count, F.col("p").cast("int")).drop("p")
        n, weights, places, totals = self.n, self.weights, self.places, self.totals

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks, own, files = [], {}, {}
            for batch in batches:
                kinds, profiles, keys = (batch.column(c).to_pylist() for c in ("kind", "profile_id", "key"))
                for k, (kind, p, key) in enumerate(zip(kinds, profiles, keys, strict=True)):
                    a, b, c = (batch.column(x)[k].as_buffer() for x in "abc")
                    if kind == "ask":
                        asks.append(json.loads(bytes(a)))
                    elif kind in ("out", "into"):
                        if kind not in files:
                            files[kind] = (np.zeros(n, np.int32), _local(totals[kind], np.int32), _local(totals[kind], np.int64 if weights is None else np.uint8))
                        degree, other, code = files[kind]
                        some, at = np.frombuffer(a, np.int32), places[kind, key]
                        degree[key * BLOCK : key * BLOCK + len(some)] = some
                        ends = np.frombuffer(b, np.int32)
                        other[at : at + len(ends)] = ends
                        code[at : at + len(ends)] = np.frombuffer(c, code.dtype)
                    else:
                        own.setdefault((p, kind), []).append((np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(b, np.int32 if kind == "edge" else np.int64).astype(np.int64), np.frombuffer(c, np.int64).copy()))
                del batch
            if not asks:
                return
            names = np.array(weights, np.int64) if weights is not None else None
            indexes = {}
            for side in sides:
                degree, other, code = files.pop(side, (np.zeros(n, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64 if weights is None else np.uint8)))
                first = _local(n + 1, np.int64)
                np.cumsum(degree, out=first[1:])
                indexes[side] = (first, other, code, names)
                del degree

            def graph(profile: int) -> Wide:
                rows = lambda kind: [np.concatenate(x) for x in zip(*own[profile, kind], strict=True)] if (profile, kind) in own else [np.zeros(0, np.int64)] * 3
                src, dst, w = rows("edge")
                made = {s: Side(*indexes[s], (src, dst, w) if s == "out" else (dst, src, w)) for s in sides}
                pairs = lambda kind: dict(zip(rows(kind)[0].tolist(), rows(kind)[2].tolist(), strict=True))
                return Wide(n, made.get("out"), made.get("into"), pairs("ring"), pairs("global"))

            yield from f(asks, graph)

        return sent.mapInArrow(run, schema)

    def __reduce__(self):
        return Mapped, (self.n, None, self.weights, self.places, self.totals)  # tasks have no use for the table


def mapped(n: int, walk: DataFrame, own: DataFrame | None, sides: tuple[str, ...] = ("out", "into")) -> Mapped:
    """walk: src, dst, w, the edges of all profiles; own: PARTS of the profiles'
    own edges, rings and globals. No row passes the driver but the number of
    edges of every block."""
    found = [r["w"] for r in walk.select("w").distinct().limit(257).collect()]
    weights = sorted(found) if len(found) <= 256 else None
    names = None if weights is None else np.array(weights, np.int64)

    def side(kind: str, near: str, far: str) -> DataFrame:
        def pack(rows: pa.Table) -> pa.Table:
            key, at, to, w = (rows.column(c).to_numpy() for c in ("key", "near", "far", "w"))
            block, order = int(key[0]), np.argsort(at, kind="stable")
            count = np.bincount(at - block * BLOCK, minlength=min(BLOCK, n - block * BLOCK)).astype(np.int32)
            code = w[order] if names is None else np.searchsorted(names, w[order]).astype(np.uint8)
            cells = ([kind], [None], [block], [count.tobytes()], [to[order].astype(np.int32).tobytes()], [code.tobytes()])
            return pa.table([pa.array(v, t) for v, t in zip(cells, (pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["kind", "profile_id", "key", "a", "b", "c"])

        return walk.select(F.expr(f"{near} DIV {BLOCK}").cast("long").alias("key"), F.col(near).cast("int").alias("near"), F.col(far).cast("int").alias("far"), F.col("w").cast("long").alias("w")).groupBy("key").applyInArrow(pack, PARTS)

    made = [side("out", "src", "dst")] if "out" in sides else []
    made += [side("into", "dst", "src")] if "into" in sides else []
    made += [own] if own is not None else []
    rows = made[0]
    for more in made[1:]:
        rows = rows.unionByName(more)
    rows = stored(rows)
    sizes = rows.where("kind IN ('out', 'into')").select("kind", "key", F.expr("octet_length(b) DIV 4").alias("n")).orderBy("kind", "key").collect()
    places, totals = {}, {"out": 0, "into": 0}
    for r in sizes:
        places[r["kind"], r["key"]] = totals[r["kind"]]
        totals[r["kind"]] += r["n"]
    return Mapped(n, rows, weights, places, totals)


def dealt(asked: DataFrame, *by: str) -> DataFrame:
    """asked with p: rows with the same `by` have the same, and there are as many
    as cores at most."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    return asked.withColumn("p", (F.dense_rank().over(Window.orderBy(*by)) - 1) % cores)


def _batches(schema: pa.Schema, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), OUT_ROWS):
        cells = []
        for c in columns:
            part = c[at : at + OUT_ROWS]
            cells.append(pa.array(part, pa.int64(), mask=part == NO_WAY))
        yield pa.RecordBatch.from_arrays(cells, schema=schema)


def tables(graphs: Mapped, landmarks: DataFrame) -> DataFrame:
    """landmarks.distance_tables() for profile 0; one task searches a landmark
    both ways."""
    schema = pa.schema([(c, pa.int64()) for c in ("li", "node", "fw", "bw")])

    def run(asks: list[dict], graph: Callable[[int], Wide]) -> Iterator[pa.RecordBatch]:
        own = graph(0)
        for ask in asks:
            fw, bw = own.costs({ask["node"]: 0}), own.costs({ask["node"]: 0}, back=True)
            node = np.flatnonzero((fw < NO_WAY) | (bw < NO_WAY))
            yield from _batches(schema, [np.full(len(node), ask["li"]), node, fw[node], bw[node]])

    marks = landmarks.select(F.col("li").cast("long").alias("li"), F.col("node").cast("long").alias("node"))
    return graphs.run(dealt(marks, "li", "node"), run, "li long, node long, fw long, bw long")


def reached(graphs: Mapped, at: int) -> DataFrame:
    """What a node reaches in profile 0's graph: node, d."""
    schema = pa.schema([("node", pa.int64()), ("d", pa.int64())])

    def run(asks: list[dict], graph: Callable[[int], Wide]) -> Iterator[pa.RecordBatch]:
        for ask in asks:
            d = graph(0).costs({ask["at"]: 0})
            node = np.flatnonzero(d < NO_WAY)
            yield from _batches(schema, [node, d[node]])

    return graphs.run(graphs.rows.sparkSession.createDataFrame([(at, 0)], "at long, p int"), run, "node long, d long", ("out",))


def components(n: int, walk: DataFrame) -> DataFrame:
    """node, component: the smallest node that walking connects it with, either
    way. One task; for nodes 0 to n - 1, also those without an edge."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(asks: list[dict], graph: Callable[[int], Wide]) -> Iterator[pa.RecordBatch]:
        low, side = np.arange(n, dtype=np.int32), graph(0).out
        while asks:
            before = low.copy()
            for at in range(0, n, FRONT):
                nodes = np.arange(at, min(n, at + FRONT))
                i, v, _ = side.of(nodes)
                a, b = low[nodes[i]], low[v]
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
            while True:
                further = low[low]
                if (further == low).all():
                    break
                low = further
            if (before == low).all():
                break
        for at in range(0, n if asks else 0, OUT_ROWS):
            part = low[at : at + OUT_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part.astype(np.int64))], schema=schema)

    graphs = mapped(n, walk, None, ("out",))
    return graphs.run(walk.sparkSession.range(1).selectExpr("CAST(0 AS INT) AS p"), run, "node long, component long", ("out",))
