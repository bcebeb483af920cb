"""Shortest paths over walk edges, teleports, rings and global teleports.

`route` answers a table of queries with one search for each start, profile and
seed; its edges reach the tasks as arrays, which is done up to BROADCAST_EDGES
edges: as rows of the shared folder (`Parts`), so that the driver holds none, or
as graphs that a caller has made. `relaxed` gives the same answers by rounds of joins,
without a bound on edges: each round moves every search one hop on, so it takes
as many rounds as the longest path has hops. Between them, for graphs that fit
into files of a task's own, `route` takes `mapped.Mapped`. `distances` gives costs
over given edges only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions.fields import jitter
from wayfold.operators.mapped import Mapped, Wide, mapped
from wayfold.operators.mapped import dealt as dealt_to_tasks
from wayfold.operators.tables import release, stored

#: Edges of which every task may hold the arrays (16 bytes each, three times).
BROADCAST_EDGES = 10_000_000
FOUND, NOT_FOUND, OVER_BUDGET, CANCELLED = "found", "not_found", "budget_exceeded", "cancelled"
#: A search asks so often, in settled nodes, whether it is to stop.
ASK_EVERY = 1024
#: Cost of what can't be reached.
NO_WAY = 1 << 62


def first_budget(n: int) -> int:
    """Nodes that a first attempt may settle in a graph of n nodes; a second
    attempt gets four times as many."""
    return max(1_500_000, n // 2)


def tick_jitter(seed: int, u: int, v: int) -> int:
    if not seed:
        return 0
    return ((((((seed ^ u) & 65535) * 435) ^ v) & 65535) * 435) & 65535


class Graph:
    """Edges as arrays by source, and, once asked for, by destination; rings and
    globals apart."""

    def __init__(self, n: int, src, dst, w, rings=(), globals_=()):
        self.n = n
        order = np.lexsort((w, dst, src))
        self.out = self._index(n, src[order], dst[order], w[order])
        self.rings, self.globals = dict(rings), dict(globals_)

    @cached_property
    def into(self):
        first, dst, w = self.out
        src = np.repeat(np.arange(self.n, dtype=dst.dtype), np.diff(first))
        order = np.lexsort((w, src, dst))
        return self._index(self.n, dst[order], src[order], w[order])

    @staticmethod
    def _index(n, by, other, w):
        return np.searchsorted(by, np.arange(n + 1)), other, w

    def search(self, sources: dict[int, int], goals: set[int], seed: int = 0, origin: bool = True, budget: int | None = None):
        """Least cost of the nodes settled until all goals are. sources: node ->
        cost at the start. origin: the sources may use global teleports."""
        first, other, weight = (self.out[0].tolist(), self.out[1], self.out[2])
        best, done, heap = dict(sources), {}, [(c, v) for v, c in sources.items()]
        if origin:
            for s, c in sources.items():
                for v, g in self.globals.items():
                    d = c + g + tick_jitter(seed, s, v)
                    if v != s and d < best.get(v, d + 1):
                        best[v] = d
                        heap.append((d, v))
        heapq.heapify(heap)
        left, pops, rings = set(goals), 0, self.rings
        while heap and left:
            if budget is not None and pops >= budget:
                return best, done, OVER_BUDGET, pops
            d, u = heapq.heappop(heap)
            if u in done or d > best[u]:
                continue
            pops += 1
            done[u] = d
            left.discard(u)
            a, b = first[u], first[u + 1]
            for v, w in zip(other[a:b].tolist(), weight[a:b].tolist(), strict=True):
                c = d + w + tick_jitter(seed, u, v)
                if c < best.get(v, c + 1):
                    best[v] = c
                    heapq.heappush(heap, (c, v))
            if u in rings:
                for v, w in rings.items():
                    c = d + w + tick_jitter(seed, u, v)
                    if v != u and c < best.get(v, c + 1):
                        best[v] = c
                        heapq.heappush(heap, (c, v))
        return best, done, FOUND if not left else NOT_FOUND, pops

    def reach(self, node: int, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All nodes that node reaches, by global teleports too (back: that reach
        it, by no global teleport), and their costs. A ring is entered at its own
        cost, so going back from a ring costs what that ring does."""
        first, other, weight = self.into if back else self.out
        first, best, rings = first.tolist(), [NO_WAY] * self.n, self.rings
        best[node] = 0
        heap = [(0, node)]
        for v, g in () if back else self.globals.items():
            if g < best[v]:
                best[v] = g
                heap.append((g, v))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > best[u]:
                continue
            a, b = first[u], first[u + 1]
            for v, w in zip(other[a:b].tolist(), weight[a:b].tolist(), strict=True):
                if d + w < best[v]:
                    best[v] = d + w
                    heapq.heappush(heap, (d + w, v))
            if u in rings:
                for v, w in rings.items():
                    c = d + (rings[u] if back else w)
                    if c < best[v]:
                        best[v] = c
                        heapq.heappush(heap, (c, v))
        costs = np.array(best, np.int64)
        nodes = np.flatnonzero(costs < NO_WAY)
        return nodes, costs[nodes]

    def _next(self, u: int, d: int, seed: int, back: bool = False) -> Iterator[tuple[int, int]]:
        """Neighbours of u and their costs by way of u, which costs d. back: the
        nodes that lead to u."""
        first, other, weight = self.into if back else self.out
        a, b = int(first[u]), int(first[u + 1])
        jit = (lambda v: tick_jitter(seed, v, u)) if back else (lambda v: tick_jitter(seed, u, v))
        for v, w in zip(other[a:b].tolist(), weight[a:b].tolist(), strict=True):
            yield v, d + w + jit(v)
        if u in self.rings:
            for v, w in self.rings.items():
                if v != u:
                    yield v, d + (self.rings[u] if back else w) + jit(v)

    def _entries(self, sources: dict[int, int], seed: int, origin: bool) -> dict[int, int]:
        """sources and, from an origin, the ends of global teleports, with costs."""
        best = dict(sources)
        for s, c in sources.items() if origin else ():
            for v, g in self.globals.items():
                d = c + g + tick_jitter(seed, s, v)
                if v != s and d < best.get(v, d + 1):
                    best[v] = d
        return best

    def guided(self, sources: dict[int, int], goal: int, guide: np.ndarray, seed: int = 0, origin: bool = True, budget: int | None = None, bucket: int = 0, cancel: Callable[[], bool] | None = None):
        """A*: as search(), for one goal. guide: what is left from each node at
        least, NO_WAY where there is no way, and never less than a step brings it
        down. All nodes that may lie on a best path are settled. With a bucket,
        nodes whose estimates fall into the same bucket count as equal, nearer
        ones to the goal first, and the cost is less than a bucket above the best."""
        best, done, came = self._entries(sources, seed, origin), {}, {}
        left = lambda v: int(guide[v])
        rank = (lambda v, d: ((d + left(v)) // bucket, -d, v, d)) if bucket else (lambda v, d: (d + left(v), d, v, d))
        heap = [rank(v, d) for v, d in best.items() if left(v) < NO_WAY]
        heapq.heapify(heap)
        pops, least = 0, None
        while heap and (least is None or heap[0][0] <= least):
            if budget is not None and pops >= budget:
                return best, done, OVER_BUDGET, pops, came
            if cancel is not None and pops % ASK_EVERY == 0 and cancel():
                return best, done, CANCELLED, pops, came
            *_, u, d = heapq.heappop(heap)
            if d > best[u] or u in done and done[u] <= d:
                continue
            pops += 1
            done[u] = d
            if u == goal:
                if bucket:
                    break
                least = d
            for v, c in self._next(u, d, seed):
                if c < best.get(v, c + 1) and left(v) < NO_WAY:
                    best[v], came[v] = c, u
                    heapq.heappush(heap, rank(v, c))
        for s in sources:  # from where a global teleport may lead, though no other way does
            done.setdefault(s, best[s])
        return best, done, FOUND if goal in done else NOT_FOUND, pops, came

    def both_ways(self, sources: dict[int, int], goal: int, seed: int = 0, origin: bool = True, budget: int | None = None) -> tuple[int | None, list[int] | None, str, int]:
        """Cost, path, status and settled nodes of a search from both ends, which
        stops as soon as no path through an open node can be cheaper. One of
        several best paths."""
        best = (self._entries(sources, seed, origin), {goal: 0})
        came, done, heaps = ({}, {}), (set(), set()), ([(c, v) for v, c in best[0].items()], [(0, goal)])
        heapq.heapify(heaps[0])
        least, meet, pops = NO_WAY, None, 0
        if goal in best[0]:
            least, meet = best[0][goal], goal
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] < least:
            if budget is not None and pops >= budget:
                return None, None, OVER_BUDGET, pops
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
            d, u = heapq.heappop(heaps[side])
            if u in done[side]:
                continue
            done[side].add(u)
            pops += 1
            for v, c in self._next(u, d, seed, side == 1):
                if c < best[side].get(v, c + 1):
                    best[side][v], came[side][v] = c, u
                    heapq.heappush(heaps[side], (c, v))
                    if v in best[1 - side] and c + best[1 - side][v] < least:
                        least, meet = c + best[1 - side][v], v
        if meet is None:
            return None, None, NOT_FOUND, pops
        path = [meet]
        while path[-1] in came[0]:
            path.append(came[0][path[-1]])
        if origin and path[-1] not in sources:  # entered by a global teleport
            path.append(min(s for s in sources if best[0][path[-1]] == sources[s] + self.globals[path[-1]] + tick_jitter(seed, s, path[-1])))
        path.reverse()
        while path[-1] in came[1]:
            path.append(came[1][path[-1]])
        return least, path, FOUND, pops

    def _before(self, done: dict[int, int], sources: dict[int, int], v: int, seed: int, origin: bool) -> tuple[list[int], list[int]]:
        """Nodes from which an edge leads to v at v's cost: those that cost less,
        and those that cost as much, over an edge that costs nothing."""
        first, other, weight = self.into
        a, b, cost = int(first[v]), int(first[v + 1]), done[v]
        edges = list(zip(other[a:b].tolist(), weight[a:b].tolist(), strict=True))
        if v in self.rings:
            edges += [(u, self.rings[v]) for u in self.rings if u != v]
        if origin and v in self.globals:
            edges += [(u, self.globals[v]) for u in sources if u != v]
        fit = [u for u, w in edges if u in done and done[u] + w + tick_jitter(seed, u, v) == cost]
        return [u for u in fit if done[u] < cost], [u for u in fit if done[u] == cost]

    def path(self, done: dict[int, int], sources: dict[int, int], goal: int, seed: int = 0, origin: bool = True) -> list[int]:
        """Nodes of the best path; where several are, each node's predecessor is
        the smallest that costs less; without one, the smallest that costs as
        much and has such a predecessor or is a source, else what was settled
        before."""
        order: dict[int, int] = {}
        out, v = [goal], goal
        while not (v in sources and done[v] == sources[v]):
            less, same = self._before(done, sources, v, seed, origin)
            if not less:
                order = order or {u: i for i, u in enumerate(done)}
                sound = [u for u in same if u in sources or self._before(done, sources, u, seed, origin)[0]]
                less = sound or [u for u in same if order[u] < order[v]]
            v = min(less)
            out.append(v)
        return out[::-1]


class Landmarks:
    """Distances from (fw) and to (bw) landmarks, [landmark, node], -1 where there
    is no way, and the lower bounds that follow."""

    def __init__(self, fw: np.ndarray, bw: np.ndarray):
        self.fw, self.bw = fw, bw

    @classmethod
    def of(cls, table: DataFrame, n: int) -> Landmarks:
        """table: li, node, fw, bw. Two numbers for each landmark and node."""
        rows = table.select("li", "node", "fw", "bw").toPandas()
        names, place = np.unique(rows.li.to_numpy(np.int64), return_inverse=True)
        out = []
        for c in ("fw", "bw"):
            held = np.full((len(names), n), -1, np.int64)
            held[place, rows.node.to_numpy(np.int64)] = rows[c].astype("Int64").fillna(-1).to_numpy(np.int64)
            out.append(held)
        return cls(*out)

    @classmethod
    def read(cls, rows: pa.Table | pd.DataFrame, n: int) -> Landmarks:
        """From the rows of marked()."""
        if isinstance(rows, pd.DataFrame):
            rows = pa.Table.from_pandas(rows, preserve_index=False)
        names = sorted({r["key"] for r in _parted(rows, "mark")})
        fw, bw = (np.full((len(names), n), -1, np.int64) for _ in range(2))
        for r in _parted(rows, "mark"):
            i, at = names.index(r["key"]), np.frombuffer(r["a"], np.int32)
            fw[i, at], bw[i, at] = np.frombuffer(r["b"], np.int64), np.frombuffer(r["c"], np.int64)
        return cls(fw, bw)

    def scores(self, starts: list[int], goal: int) -> np.ndarray:
        """The bound that each landmark gives from the nearest of the starts to
        the goal; -1 for landmarks without a way from or to the goal."""
        out = np.full(len(self.fw), NO_WAY)
        for s in starts:
            ahead = np.where(self.fw[:, s] < 0, 0, self.fw[:, goal] - self.fw[:, s])
            back = np.where(self.bw[:, s] < 0, NO_WAY, self.bw[:, s] - self.bw[:, goal])
            out = np.minimum(out, np.maximum(0, np.maximum(ahead, back)))
        return np.where((self.fw[:, goal] < 0) | (self.bw[:, goal] < 0), -1, out)

    def best(self, starts: list[int], goal: int, k: int | None = None) -> np.ndarray:
        """The k landmarks with the highest scores (all, if not said), the first
        of equal ones, in ascending order."""
        score = self.scores(starts, goal)
        usable = np.flatnonzero(score >= 0)
        order = usable[np.lexsort((usable, -score[usable]))]
        return np.sort(order[:k])

    def guide(self, goal: int, chosen: np.ndarray) -> np.ndarray:
        """What is left from each node to the goal at least."""
        out = np.zeros(self.fw.shape[1], np.int64)
        for i in chosen:
            np.maximum(out, np.where(self.fw[i] < 0, 0, self.fw[i, goal] - self.fw[i]), out)
            np.maximum(out, np.where(self.bw[i] < 0, NO_WAY, self.bw[i] - self.bw[i, goal]), out)
        return out


def graphs(n: int, walk: DataFrame, macros: DataFrame, rings: DataFrame, globals_: DataFrame, ids: list[int]) -> dict[int, Graph]:
    """A graph for each profile. Callers check the number of edges before."""
    w = walk.select("src", "dst", "w").toPandas()
    m = macros.groupBy("profile_id", "src", "dst").agg(F.min("cost").alias("w")).toPandas()
    r = rings.groupBy("profile_id", "node").agg(F.min("cost").alias("w")).toPandas()
    g = globals_.select("profile_id", "dst", "cost").toPandas()
    out = {}
    for p in ids:
        own = m[m.profile_id == p]
        cat = lambda a, b: np.concatenate([a.to_numpy(np.int64), b.to_numpy(np.int64)])
        ring, glob = r[r.profile_id == p], g[g.profile_id == p]
        out[p] = Graph(n, cat(w.src, own.src), cat(w.dst, own.dst), cat(w.w, own.w), zip(ring.node.tolist(), ring.w.tolist(), strict=True), zip(glob.dst.tolist(), glob.cost.tolist(), strict=True))
    return out


PARTS = "kind string, profile_id int, key long, a binary, b binary, c binary"
#: Rows of a table in one row of parts, at most.
PART_ROWS = 50_000


def _packed(rows: DataFrame, kind: str, a: str, b: str, c: str, profile: str = "CAST(NULL AS INT)", key: str = "0") -> DataFrame:
    """PARTS: three columns of numbers as arrays, by profile and key: a (node
    ids), and b of edges, in 32 bits, the others in 64. A null number is -1."""
    kinds = {"a": np.int32, "b": np.int32 if kind == "edge" else np.int64, "c": np.int64}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS).to_pandas()
                for (p, k), own in part.groupby(["profile_id", "key"], dropna=False):
                    cells = [[kind], [None if pd.isna(p) else int(p)], [int(k)], *([own[x].to_numpy(t).tobytes()] for x, t in kinds.items())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cells, (pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], ["kind", "profile_id", "key", "a", "b", "c"])

    cells = [F.coalesce(F.expr(x).cast("long"), F.lit(-1).cast("long")).alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
    return rows.select(F.expr(profile).cast("int").alias("profile_id"), F.expr(key).cast("long").alias("key"), *cells).mapInArrow(run, PARTS)


def _parted(rows: pa.Table, kind: str) -> Iterator[dict]:
    """key, a, b, c of the parts of a kind; arrays as they lie in the table."""
    for batch in rows.to_batches():
        for i in np.flatnonzero(np.array(batch.column("kind").to_pylist()) == kind).tolist():
            yield {"key": batch.column("key")[i].as_py()} | {c: batch.column(c)[i].as_buffer() for c in "abc"}


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_NULLABLE = {pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype()}


@dataclass
class Parts:
    """Graphs of n nodes, one for each profile, as rows of PARTS. Rows without a
    profile belong to all."""

    n: int
    rows: DataFrame

    def graph(self, rows: pa.Table) -> Graph:
        column = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(r[c], t) for r in _parted(rows, "edge"))])
        pairs = lambda kind: [x for r in _parted(rows, kind) for x in zip(np.frombuffer(r["a"], np.int32).tolist(), np.frombuffer(r["c"], np.int64).tolist(), strict=True)]
        return Graph(self.n, column("a", np.int32), column("b", np.int32), column("c", np.int64), pairs("ring"), pairs("global"))

    def run(self, asked: DataFrame, f: Callable[[pd.DataFrame, Graph, Landmarks | None], pd.DataFrame], schema: str, marks: DataFrame | None = None) -> DataFrame:
        """f for the rows of asked of each profile_id and t, in one task, with the
        profile's graph and the marks; each task gets its own copy of the rows, in
        Arrow, and makes nothing of them but the arrays that are searched."""
        rows = self.rows if marks is None else self.rows.unionByName(marks)
        tasks = asked.select(F.col("profile_id").cast("int").alias("_p"), F.col("t").alias("_t")).distinct()
        sent = rows.join(F.broadcast(tasks), F.coalesce("profile_id", "_p") == F.col("_p"))  # a row for each task
        sent = sent.select(F.col("_p").alias("profile_id"), F.col("_t").alias("t"), "kind", "key", "a", "b", "c")
        n, made, marked_ = self.n, self.graph, marks is not None
        out = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in schema.split(", ")])

        def run(own: pa.Table, held: pa.Table) -> pa.Table:
            release()  # what the group before it took
            if not own.num_rows:
                return out.empty_table()
            found = f(own.to_pandas(types_mapper=_NULLABLE.get), made(held), Landmarks.read(held, n) if marked_ else None)
            return pa.Table.from_pandas(found[out.names], out, preserve_index=False)

        return asked.groupBy("profile_id", "t").cogroup(sent.groupBy("profile_id", "t")).applyInArrow(run, schema)

    def __reduce__(self):
        return Parts, (self.n, None)  # tasks have no use for the table


def parts(n: int, walk: DataFrame, macros: DataFrame, rings: DataFrame, globals_: DataFrame) -> Parts:
    """graphs(), for any profiles, without a row that passes the driver. Callers
    check the number of edges before."""
    own = _own_parts(macros, rings, globals_)
    return Parts(n, stored(_packed(walk, "edge", "src", "dst", "w").unionByName(own)))


def _own_parts(macros: DataFrame, rings: DataFrame, globals_: DataFrame) -> DataFrame:
    hops = macros.groupBy("profile_id", "src", "dst").agg(F.min("cost").alias("w"))
    ring = rings.groupBy("profile_id", "node").agg(F.min("cost").alias("w"))
    return _packed(hops, "edge", "src", "dst", "w", "profile_id").unionByName(_packed(ring, "ring", "node", "0", "w", "profile_id")).unionByName(_packed(globals_, "global", "dst", "0", "cost", "profile_id"))


def mapped_parts(n: int, walk: DataFrame, macros: DataFrame, rings: DataFrame, globals_: DataFrame) -> Mapped:
    """parts() for files of the tasks' own. Callers check the number of edges before."""
    return mapped(n, walk, _own_parts(macros, rings, globals_))


def marked(table: DataFrame) -> DataFrame:
    """Landmarks (li, node, fw, bw) as PARTS for Parts.run()."""
    return stored(_packed(table, "mark", "node", "fw", "bw", key="li"))


def tasks_a_profile(rows: DataFrame) -> int:
    """So many that a few profiles keep all cores at work."""
    return max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // 4))


ROUTES = "query_id long, profile_id int, seed long, start long, goal long, status string, cost long, pops long, path array<long>"


def _routed(queries: DataFrame, graphs: Mapped, budget: int | None) -> DataFrame:
    """route() by mapped graphs."""
    names = [c.split()[0] for c in ROUTES.split(", ")]
    schema = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in ROUTES.split(", ")])

    def answer(own: Wide, asks: list[dict]) -> Iterator[tuple]:
        start, seed, virtual = asks[0].get("start"), asks[0]["seed"], asks[0].get("start") is None
        sources = dict(own.globals) if virtual else {start: 0}
        goals = {a["goal"] for a in asks if a.get("goal") is not None}
        best = own.costs(sources, goals, seed, not virtual)
        place = {g: own.settled(best, sources, g, seed, not virtual) for g in goals if best[g] < NO_WAY}
        needed = max(place.values(), default=0) if len(place) == len(goals) else int((best < NO_WAY).sum())
        over = budget is not None and needed > budget
        for a in asks:
            goal = a.get("goal")
            found = goal in place and not (over and place[goal] > budget)
            state = FOUND if found else OVER_BUDGET if over else NOT_FOUND
            yield a["query_id"], a["profile_id"], seed, start, goal, state, int(best[goal]) if found else None, budget if over else needed, own.path(best, sources, goal, seed, not virtual) if found else None

    def run(asks: list[dict], graph: Callable[[int], Wide]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list[dict]] = {}
        for a in asks:
            groups.setdefault((a["profile_id"], a["seed"], -1 if a.get("start") is None else a["start"]), []).append(a)
        own, held = None, None
        for key in sorted(groups):
            if key[0] != held:
                own, held = graph(key[0]), key[0]
            rows = list(answer(own, groups[key]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], names)

    asked = queries.select("query_id", "profile_id", "seed", "start", "goal")
    return graphs.run(dealt_to_tasks(asked, "profile_id", "seed", "start"), run, ROUTES)


def route(queries: DataFrame, by_profile: dict[int, Graph] | Parts | Mapped, budget: int | None = None, marks: Landmarks | DataFrame | None = None, active: int | None = None) -> DataFrame:
    """queries: query_id, profile_id, seed, start and goal (node ids; a null start
    lies beside the graph and enters through any global teleport). Queries with
    the same start, profile and seed share a search, 200 goals at most. With
    marks (with Parts: marked() ones), searches for one goal are guided by the
    best `active` of them (all, if not said), which changes nothing but the nodes
    that are settled. With Mapped, no search is guided."""
    if isinstance(by_profile, Mapped):
        return _routed(queries, by_profile, budget)

    def answer(group: pd.DataFrame, graph: Graph, marks: Landmarks | None) -> pd.DataFrame:
        one = group.iloc[0]
        seed, virtual = int(one.seed), pd.isna(one.start)
        sources = dict(graph.globals) if virtual else {int(one.start): 0}
        goals = {int(g) for g in group.goal if not pd.isna(g)}
        if marks is not None and len(goals) == 1:
            (goal,), m = goals, marks
            _, done, status, pops, _ = graph.guided(sources, goal, m.guide(goal, m.best(list(sources), goal, active)), seed, not virtual, budget)
        else:
            _, done, status, pops = graph.search(sources, goals, seed, not virtual, budget)
        out = []
        for r in group.itertuples():
            goal = None if pd.isna(r.goal) else int(r.goal)
            found = goal in done
            state = FOUND if found else OVER_BUDGET if status == OVER_BUDGET else NOT_FOUND
            out.append((r.query_id, one.profile_id, seed, None if virtual else int(one.start), goal, state, done.get(goal), pops, graph.path(done, sources, goal, seed, not virtual) if found else None))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROUTES.split(", ")])
        return frame.astype({"start": "Int64", "goal": "Int64", "cost": "Int64"})

    part = F.expr("CAST(pmod(xxhash64(goal), 1 + n DIV 200) AS INT)")
    counts = queries.groupBy(F.col("profile_id").alias("p"), F.col("seed").alias("s"), F.col("start").alias("a")).agg(F.count("*").alias("n"))
    same = F.col("profile_id").eqNullSafe(F.col("p")) & F.col("seed").eqNullSafe(F.col("s")) & F.col("start").eqNullSafe(F.col("a"))
    dealt = queries.select("query_id", "profile_id", "seed", "start", "goal").join(counts, same).drop("p", "s", "a").withColumn("part", part)
    if isinstance(by_profile, Parts):
        t = F.expr(f"CAST(pmod(xxhash64(seed, start, part), {tasks_a_profile(queries)}) AS INT)")
        each = lambda own, graph, marks: pd.concat([answer(g, graph, marks) for _, g in own.groupby(["seed", "start", "part"], dropna=False)])
        return by_profile.run(dealt.drop("n").withColumn("t", t), each, ROUTES, marks)
    shared = queries.sparkSession.sparkContext.broadcast(by_profile)
    held = queries.sparkSession.sparkContext.broadcast(marks)  # two numbers for each landmark and node
    run = lambda group: answer(group, shared.value[int(group.iloc[0].profile_id)], held.value)
    return dealt.drop("n").groupBy("profile_id", "seed", "start", "part").applyInPandas(run, ROUTES)


def retried(queries: DataFrame, by_profile: dict[int, Graph] | Parts | Mapped, budget: int) -> DataFrame:
    """Searches with a budget: what exceeds it is tried with four times as much,
    then without a seed. seed_dropped says that the last helped."""
    first = stored(route(queries, by_profile, budget))
    over = lambda rows: rows.where(F.col("status") == OVER_BUDGET).select("query_id", "profile_id", "seed", "start", "goal")
    second = stored(route(over(first), by_profile, 4 * budget))
    third = stored(route(over(second).withColumn("seed", F.lit(0).cast("long")), by_profile, 4 * budget))
    keep = lambda rows: rows.where(F.col("status") != OVER_BUDGET)
    return keep(first).withColumn("seed_dropped", F.lit(False)).unionByName(keep(second).withColumn("seed_dropped", F.lit(False))).unionByName(third.withColumn("seed_dropped", F.lit(True)))


def distances(edges: DataFrame, sources: DataFrame, within: int | None = None) -> DataFrame:
    """(source, node, cost) by relaxation: each round joins the nodes that got
    cheaper with their out-edges and keeps what improves. edges: src, dst, w;
    sources: source, node, cost. Costs over `within` ticks are left out. Every
    round is written to the shared folder; there are as many as hops on the
    longest path."""
    best = stored(sources.groupBy("source", "node").agg(F.min("cost").alias("cost")))
    front = best
    out = edges.select(F.col("src").alias("node"), "dst", "w")
    while not front.isEmpty():
        tried = front.join(out, "node").select("source", F.col("dst").alias("node"), (F.col("cost") + F.col("w")).alias("cost"))
        if within is not None:
            tried = tried.where(F.col("cost") <= within)
        new = tried.groupBy("source", "node").agg(F.min("cost").alias("cost"))
        front = stored(new.join(best.withColumnRenamed("cost", "old"), ["source", "node"], "left").where("old IS NULL OR cost < old").select("source", "node", "cost"))
        best = stored(best.unionByName(front).groupBy("source", "node").agg(F.min("cost").alias("cost")))
    return best


def relaxed(queries: DataFrame, walk: DataFrame, macros: DataFrame, rings: DataFrame, globals_: DataFrame) -> DataFrame:
    """The answers that route() gives (pops are the rounds), by joins alone:
    costs by relaxation from every start, profile and seed, then each path from
    its goal backwards. Rings meet only where a search has reached one."""
    key = ["profile_id", "seed", "a"]
    own = stored(queries.select("query_id", "profile_id", "seed", "start", "goal", F.coalesce("start", F.lit(-1)).alias("a")))
    walks = walk.select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    hops = macros.groupBy("profile_id", F.col("src").alias("u"), F.col("dst").alias("v")).agg(F.min("cost").alias("w"))
    ring = rings.groupBy("profile_id", "node").agg(F.min("cost").alias("w"))
    clique = ring.select("profile_id", F.col("node").alias("u")).join(ring.withColumnRenamed("node", "v"), "profile_id").where("u <> v")
    paid = (F.col("cost") + F.col("w") + jitter(F.col("seed"), F.col("u"), F.col("v"))).alias("cost")
    starts = own.select(*key).distinct()
    far = starts.join(globals_.select("profile_id", F.col("dst").alias("v"), F.col("cost").alias("w")), "profile_id")
    entered = far.where("a = -1 OR a <> v").select(*key, F.col("v").alias("node"), F.when(F.col("a") < 0, F.col("w")).otherwise(F.col("w") + jitter(F.col("seed"), F.col("a"), F.col("v"))).alias("cost"))
    sources = stored(starts.where("a >= 0").select(*key, F.col("a").alias("node"), F.lit(0).cast("long").alias("cost")).unionByName(entered.where("a = -1")))
    best = stored(sources.unionByName(entered.where("a >= 0")).groupBy(*key, "node").agg(F.min("cost").alias("cost")))
    front, rounds = best, 0
    while not front.isEmpty():
        at = front.withColumnRenamed("node", "u")
        tried = at.join(walks, "u").select(*key, "v", paid).unionByName(at.join(hops, ["profile_id", "u"]).select(*key, "v", paid)).unionByName(at.join(clique, ["profile_id", "u"]).select(*key, "v", paid))
        new = tried.groupBy(*key, F.col("v").alias("node")).agg(F.min("cost").alias("cost"))
        front = stored(new.join(best.withColumnRenamed("cost", "old"), [*key, "node"], "left").where("old IS NULL OR cost < old").select(*key, "node", "cost"))
        best = stored(best.unionByName(front).groupBy(*key, "node").agg(F.min("cost").alias("cost")))
        rounds += 1
    found = stored(own.join(best.withColumnRenamed("node", "goal"), [*key, "goal"], "left"))
    first = sources.select(*key, "node", F.col("cost").alias("begin"))
    edges = lambda at: at.join(walks, "v").select(*at.columns, "u", "w").unionByName(at.join(hops, ["profile_id", "v"]).select(*at.columns, "u", "w")).unionByName(at.join(clique, ["profile_id", "v"]).select(*at.columns, "u", "w")).unionByName(at.where("a >= 0 AND a <> v").join(globals_.select("profile_id", F.col("dst").alias("v"), F.col("cost").alias("w")), ["profile_id", "v"]).select(*at.columns, F.col("a").alias("u"), "w"))

    def before(at: DataFrame) -> DataFrame:
        """at: key, v, cost, more. With u: the nodes before v on best paths, and their cost."""
        u = best.select(*key, F.col("node").alias("u"), F.col("cost").alias("u_cost"))
        return edges(at).join(u, [*key, "u"]).where(F.col("u_cost") + F.col("w") + jitter(F.col("seed"), F.col("u"), F.col("v")) == F.col("cost"))

    now = found.where("cost IS NOT NULL").select("query_id", *key, F.col("goal").alias("v"), "cost", F.array("goal").alias("path"))
    done = None
    while True:
        marked = stored(now.join(first.withColumnRenamed("node", "v"), [*key, "v"], "left"))
        ended = marked.where("begin = cost").select("query_id", "path")
        done = ended if done is None else done.unionByName(ended)
        going = marked.where("begin IS NULL OR begin <> cost").drop("begin")
        if going.isEmpty():
            break
        step = stored(before(going))
        # over an edge that costs nothing: only from a source, or from a node that a cheaper one leads to
        free = step.where("u_cost = cost")
        led = before(free.select(*key, F.col("u").alias("v"), F.col("u_cost").alias("cost")).distinct()).where("u_cost < cost").select(*key, F.col("v").alias("u")).distinct()
        led = led.unionByName(first.select(*key, F.col("node").alias("u"))).distinct()
        sound = step.where("u_cost < cost").withColumn("o", F.lit(0)).unionByName(free.join(led, [*key, "u"], "left_semi").select(step.columns).withColumn("o", F.lit(1)))
        chosen = sound.where(~F.array_contains("path", F.col("u"))).groupBy("query_id").agg(F.min(F.struct("o", "u", "u_cost")).alias("m"))
        now = stored(going.join(chosen, "query_id").select("query_id", *key, F.col("m.u").alias("v"), F.col("m.u_cost").alias("cost"), F.array_prepend("path", F.col("m.u")).alias("path")))
    return found.join(done, "query_id", "left").select("query_id", "profile_id", "seed", "start", "goal", F.when(F.col("cost").isNull(), NOT_FOUND).otherwise(FOUND).alias("status"), "cost", F.lit(rounds).cast("long").alias("pops"), "path")


DISTANCES = "key long, node long, backward boolean, cost long"


def tables_of_distances(edges_by_profile: dict[int, Graph] | Parts, sources: DataFrame) -> DataFrame:
    """sources: key, profile_id, node, backward. All nodes that a source reaches
    (or that reach it, if backward) with their cost: key, node, backward, cost."""

    def table(r, graph: Graph) -> pd.DataFrame:
        node, cost = graph.reach(int(r.node), bool(r.backward))
        return pd.DataFrame({"key": r.key, "node": node, "backward": bool(r.backward), "cost": cost})

    if isinstance(edges_by_profile, Parts):
        # a task for each source, 200 at most
        t = F.row_number().over(Window.partitionBy("profile_id").orderBy("key", "backward", "node")) % 200
        return edges_by_profile.run(sources.withColumn("t", t), lambda own, graph, _: pd.concat([table(r, graph) for r in own.itertuples()]), DISTANCES)
    shared = sources.sparkSession.sparkContext.broadcast(edges_by_profile)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                yield table(r, shared.value[int(r.profile_id)])

    return sources.repartition(max(1, min(200, sources.count()))).mapInPandas(run, DISTANCES)
