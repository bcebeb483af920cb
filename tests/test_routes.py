"""The route engine on small fixtures, and every query against its SQL."""

from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import fields
from wayfold.operators import abilities, chains, components, eligibility, graph, landmarks, mapped, routes, search, store, validate
from wayfold.plans import queries
from wayfold.plans.oracle import ORACLE
from wayfold.plans.queries import QUERIES
from wayfold.plans.world import World
from wayfold.sources import regions, text

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[str]:
    def value(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(str([value(v) for v in row]) for row in frame[sorted(frame.columns)].astype(object).to_numpy())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLE:
        want = duck.execute(ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fields(spark):
    lit = F.lit
    assert one(spark, fields.pack(lit(3200), lit(77), lit(3))) == 3 << 30 | 77 << 15 | 3200
    assert one(spark, fields.pack(lit(40000), lit(1), lit(0))) is None
    assert one(spark, fields.fnv1a(lit("coins"))) == 2386639341 and one(spark, fields.fnv1a(lit(""))) == 2166136261
    assert one(spark, fields.normalised(lit(" \t ÀBc \n"))) == "Àbc"
    assert [one(spark, fields.integer(lit(t))) for t in ("12", "-3", "1.5", "1e3", "")] == [12, -3, None, None, None]
    for t, want in ((None, []), ("", []), ("  ", []), ("78", [78]), (" 78 ", [78]), ("55;58", [55, 58]), ("55; 58", [55, 58]), ("55;;58", [55, 58]), ("55;58;", [55, 58]), ("55,58", [55, 58]), ("55, 58;x", [55, 58])):
        assert one(spark, fields.requirement_ids(lit(t).cast("string"))) == want
    assert [one(spark, fields.quantised(lit(v).cast("long"))) for v in (None, 0, int(63.9 * 655360), 64 * 655360, 10**18)] == [None, 0, 0, 1, 65534]
    assert [one(spark, fields.heading(lit(a), lit(b))) for a, b in ((0, 2), (-1, -1), (3, 0), (0, 0))] == ["north", "southwest", "east", None]
    for seed, u, v in ((1, 2, 3), (12345, 999999, 7), (0, 5, 6)):
        assert one(spark, fields.jitter(lit(seed), lit(u), lit(v))) == search.tick_jitter(seed, u, v)


def test_walk_edges(spark):
    """An open 2 x 2 square, and the same with diagonals barred."""
    for mask, n in ((255, 12), (15, 8)):
        nodes = graph.dense_ids(spark.createDataFrame([(x, y, 0, mask) for x in (10, 11) for y in (20, 21)], "x int, y int, plane int, walk_mask int"))
        edges = graph.walk_edges(nodes)
        assert edges.count() == n and graph.without_mirror(edges).isEmpty()
    assert graph.duplicate_tiles(spark.createDataFrame([(1, 1, 0, 0)] * 2, "x int, y int, plane int, walk_mask int")).count() == 1


def test_regions(spark):
    tiles = spark.createDataFrame([(3200 + i * 7 % 130, 64 + i, i % 3, i % 256) for i in range(300)], "x int, y int, plane int, walk_mask int").dropDuplicates(["x", "y", "plane"])
    assert sorted(regions.unpack_regions(regions.pack_regions(tiles)).collect()) == sorted(tiles.collect())
    with pytest.raises(Exception, match="4608"):
        regions.unpack_regions(spark.createDataFrame([(0, 0, 0, b"xx")], "plane int, base_x int, base_y int, blob binary")).collect()


STEP = "kind string, id long, src long, dst long, cost long, next_kind string, next_id long, reqs array<long>"


def chain_of(spark, rows, kinds=chains.LOCAL):
    return [(r["kind"], r["id"], r["src"], r["dst"], r["cost"], r["reqs"], r["n_steps"]) for r in chains.chains(spark.createDataFrame(rows, STEP), kinds).collect()]


def test_chains(spark):
    two = [("door", 1, 0, 11, 1, "lodestone", 2, [100]), ("lodestone", 2, None, 10, 3, None, None, [200])]
    assert chain_of(spark, two) == [("door", 1, 0, 10, 4, [100, 200], 2)]
    four = [("door", 1, 0, None, 1, "npc", 2, [101]), ("npc", 2, 5, None, 2, "object", 3, [102]), ("object", 3, 6, None, 3, "lodestone", 4, [104, 103]), ("lodestone", 4, None, 77, 4, None, None, [101])]
    assert chain_of(spark, four) == [("door", 1, 0, 77, 10, [101, 102, 103, 104], 4)]
    assert chain_of(spark, [("door", 1, 0, 5, 1, "door", 1, [])]) == []  # comes back to itself
    assert chain_of(spark, [("door", 1, 0, 5, 1, "npc", 9, [])]) == []  # points nowhere
    assert chain_of(spark, [("door", 1, 0, 5, 1, "nosuch", 9, [])]) == [("door", 1, 0, 5, 1, [], 1)]
    assert chain_of(spark, [("door", 1, 0, 5, 1, "npc", None, [])]) == [("door", 1, 0, 5, 1, [], 1)]
    assert chain_of(spark, [("item", 1, None, 5, 1, None, None, [])], chains.GLOBAL)[0][3] == 5


def test_rings(spark):
    nodes = spark.createDataFrame([(0, fields_key(3200, 3200)), (1, fields_key(3250, 3250))], "id long, key long")
    rings = spark.createDataFrame([(1, 3200, 3200, 0, 600.0, "ALS", "50;51"), (2, 3250, 3250, 0, None, "DKS", "52"), (3, 9999, 9999, 0, 1.0, "XXX", None)], "id long, x int, y int, plane int, cost_ms double, code string, requirements string")
    assert sorted((r["node"], r["cost"], r["reqs"]) for r in chains.ring_nodes(rings, nodes).collect()) == [(0, 600 * 655360, [50, 51]), (1, 0, [52])]


def fields_key(x, y, p=0):
    return p << 30 | y << 15 | x


def test_eligibility(spark):
    need = spark.createDataFrame([(1, "coins", "100", ">="), (2, "varbit_38", "1", "=="), (3, "Quest_State ", "done", "="), (4, "membership", "ironman", "!="), (5, "level", "50", "<"), (6, "level", "50", "~"), (7, "nothing", "1", "!="), (8, "quest_state", "a", ">")], "id long, key string, value string, comparison string")
    good = [("Coins", "150"), ("varbit_38", "1"), ("quest_state", "DONE "), ("membership", "main"), ("level", "49")]
    bad = [("coins", "99"), ("varbit_38", "0"), ("quest_state", "x"), ("membership", "ironman"), ("level", "50")]
    people = spark.createDataFrame([(2, *r) for r in good] + [(3, *r) for r in bad], "profile_id int, key string, value string")
    got = {(r["profile_id"], r["req_id"]): r["ok"] for r in eligibility.satisfaction(eligibility.tags(need), people, [0, 1, 2, 3]).collect()}
    assert {i for i in range(1, 9) if got[2, i]} == {1, 2, 3, 4, 5} and not any(got[3, i] or got[0, i] for i in range(1, 9)) and all(got[1, i] for i in range(1, 9))
    edges = spark.createDataFrame([("a", [1]), ("b", [1, 6]), ("c", [99]), ("d", [-1]), ("e", [])], "id string, reqs array<long>")
    met = spark.createDataFrame([(2, 1, True), (2, 6, False)], "profile_id int, req_id long, ok boolean")
    assert {r["id"] for r in eligibility.allowed(edges, met, [2], ["id"]).collect()} == {"a", "d", "e"}
    quick = eligibility.quick_profiles(spark.createDataFrame([(2, " HasQuickTele", "TRUE"), (3, "hasquicktele", "0")], "profile_id int, key string, value string"))
    assert [r[0] for r in quick.collect()] == [2]


def small(n, edges, rings=(), globals_=()):
    a = np.array(edges, np.int64).reshape(-1, 3)
    return search.Graph(n, a[:, 0], a[:, 1], a[:, 2], rings, globals_)


def ask(g, sources, goal, seed=0, origin=True, budget=None):
    _, done, status, _ = g.search(sources, {goal}, seed, origin, budget)
    return (g.path(done, sources, goal, seed, origin), done[goal]) if goal in done else (None, status)


def test_search():
    line = [(0, 1, 100), (1, 2, 100), (2, 3, 100)]
    assert ask(small(3, [*line[:2], (0, 2, 350)]), {0: 0}, 2) == ([0, 1, 2], 200)
    assert ask(small(4, line, globals_=[(3, 150)]), {0: 0}, 3) == ([0, 3], 150)
    ring = small(4, line[:2], rings=[(1, 25), (3, 25)])
    assert ask(ring, {0: 0}, 3) == ([0, 1, 3], 125) and ask(ring, {2: 0}, 3) == (None, "not_found")
    assert ask(small(4, [*line[:2], (3, 2, 100)]), {0: 500, 3: 100}, 2, origin=False) == ([3, 2], 200)
    assert ask(ring, {0: 200}, 3, origin=False) == ([0, 1, 3], 325)
    both = [(a, b, w) for x, y, w in [*line, (3, 4, 100)] for a, b in ((x, y), (y, x))]
    assert ask(small(5, [*both, (0, 3, 150)]), {4: 0}, 0) == ([4, 3, 2, 1, 0], 400)
    assert ask(small(6, both), {0: 0}, 5) == (None, "not_found") and ask(small(6, both), {0: 0}, 5, budget=2) == (None, "budget_exceeded")
    diamond = small(4, [(0, 1, 655360), (0, 2, 655360), (1, 3, 655360), (2, 3, 655360)])
    winners = set()
    for seed in (1, 2, 3, 5, 8, 13, 21, 42):
        path, cost = ask(diamond, {0: 0}, 3, seed)
        j = lambda m: search.tick_jitter(seed, 0, m) + search.tick_jitter(seed, m, 3)
        assert cost == 2 * 655360 + min(j(1), j(2)) and path[1] == (1 if j(1) <= j(2) else 2)
        winners.add(path[1])
    assert winners == {1, 2}
    free = small(4, [(0, 1, 10)], rings=[(1, 0), (2, 0), (3, 0)])
    assert ask(free, {0: 0}, 3) == ([0, 1, 3], 10)


def bellman(n, edges, start):
    d = {start: 0}
    for _ in range(n):
        for a, b, w in edges:
            if a in d and d[a] + w < d.get(b, 10**18):
                d[b] = d[a] + w
    return d


def test_search_against_relaxation(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, 60, 200), rng.integers(0, 60, 200), rng.integers(1, 50, 200), strict=True)]
    g, want = small(60, edges), bellman(60, edges, 3)
    for goal in range(60):
        path, cost = ask(g, {3: 0}, goal)
        assert cost == want.get(goal, "not_found")
        if path:
            assert sum(min(w for a, b, w in edges if (a, b) == hop) for hop in zip(path, path[1:], strict=False)) == cost
    frame = spark.createDataFrame(edges, "src long, dst long, w long")
    got = search.distances(frame, spark.createDataFrame([(1, 3, 0)], "source long, node long, cost long"))
    assert {r["node"]: r["cost"] for r in got.collect()} == want
    back = landmarks.distance_tables(g, spark.createDataFrame([(0, 3)], "li int, node long"))
    turned = bellman(60, [(b, a, w) for a, b, w in edges], 3)
    assert {r["node"]: (r["fw"], r["bw"]) for r in back.collect()} == {v: (want.get(v), turned.get(v)) for v in {*want, *turned}}


def test_virtual_routes(spark):
    """Answers from beside the graph, against relaxation from all global teleports."""
    rng, n = np.random.default_rng(3), 25
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 60), rng.integers(0, n, 60), rng.integers(1, 200_000, 60), strict=True) if a != b]
    entries = {2: 50_000, 11: 90_000, 19: 10_000}
    src, dst, w = (np.array(c, np.int64) for c in zip(*edges, strict=True))
    graph_ = {0: search.Graph(n, src, dst, w, (), entries.items())}
    asked = spark.createDataFrame([(i, 0, (0, 77)[i % 2], None if i < n else 5, i % n) for i in range(n + 3)], "query_id long, profile_id int, seed long, start long, goal long")
    plain_, seeded = search.route(asked.withColumn("seed", F.lit(0).cast("long")), graph_).cache(), search.route(asked, graph_).cache()
    got = {r["query_id"]: r for r in queries.virtual_routes(SimpleNamespace(routes=plain_, seeded_routes=seeded)).collect()}
    assert sorted(got) == list(range(n))
    for seed in (0, 77):
        best = dict(entries)
        for _ in range(n):
            for a, b, c in edges:
                if a in best:
                    best[b] = min(best.get(b, 1 << 60), best[a] + c + search.tick_jitter(seed, a, b))
        for i in range(n):
            if seed == 0:
                assert got[i]["cost"] == best.get(i) and (got[i]["status"] == "found") == (i in best)
                assert got[i]["path"] is None or int(got[i]["path"].split(",")[0]) in entries
            if got[i]["seed"] == seed:
                assert got[i]["seeded_cost"] == best.get(i)


def test_landmarks(spark):
    both = [(a, b, 100) for x in range(3) for a, b in ((x, x + 1), (x + 1, x))] + [(4, 5, 100), (5, 4, 100)]
    walk = spark.createDataFrame(both, "src long, dst long, w long")
    none = spark.createDataFrame([], "src long, dst long, cost long, kind string")
    nodes = spark.range(6)
    rings = spark.createDataFrame([], "node long, cost long")
    for reach in (landmarks.searched(spark, small(6, both)), landmarks.joined(spark, landmarks.bound_edges(walk, none, rings))):
        assert sorted(landmarks.farthest(reach, walk, none, nodes, 2)) == [0, 3]


def test_landmarks_beyond_the_bound(spark):
    """Tables by joins hold the same distances, rings and unreached nodes included."""
    rng, n = np.random.default_rng(9), 40
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 55), rng.integers(0, n, 55), rng.integers(1, 900, 55), strict=True) if a != b]
    walk = spark.createDataFrame(edges[:35], "src long, dst long, w long")
    macros = spark.createDataFrame([(*e, "door") for e in edges[35:]] + [(1, 2, 1 << 40, "lodestone")], "src long, dst long, cost long, kind string")
    rings = spark.createDataFrame([(4, 50), (31, 0), (20, 700), (20, 90)], "node long, cost long")
    marks = spark.createDataFrame([(0, 3), (1, 31), (2, 20)], "li int, node long")
    want = landmarks.distance_tables(landmarks.bound_graph(n, walk, macros, rings), marks)
    got = landmarks.joined_tables(landmarks.bound_edges(walk, macros, rings), marks)
    rows = lambda t: {(r["li"], r["node"]): (r["fw"], r["bw"]) for r in t.collect()}
    assert rows(got) == rows(want) and any(None in v for v in rows(want).values())


def test_queries_beyond_the_bound(spark, monkeypatch):
    """Nothing is shipped to tasks when edges are more than the bound."""
    frame = spark.createDataFrame
    own = World(spark, "")
    edges = [(0, 1, 10), (1, 2, 10), (2, 3, 500)]
    own.__dict__.update(n=6, walk=frame(edges, "src long, dst long, w long"), macros=frame([(1, 3, 20, "npc")], "src long, dst long, cost long, kind string"), macros_ok=frame([(0, 1, 3, 20)], "profile_id int, src long, dst long, cost long"), rings=frame([(2, 5), (4, 5)], "node long, cost long"), rings_ok=frame([(0, 2, 5), (0, 4, 5)], "profile_id int, node long, cost long"), globals_ok=frame([(0, 2, 7)], "profile_id int, dst long, cost long"))
    own.globals = frame([("poa_item", 0, 3)], "kind string, id int, dst long")
    asked = frame([(0, 0, 0, 0, 3), (1, 0, 0, None, 4), (2, 0, 0, 0, 5)], "query_id long, profile_id int, seed long, start long, goal long")
    rows = lambda: ({(r["query_id"], r["status"], r["cost"]) for r in own.answers(asked, guided=True).collect()}, {tuple(r) for r in own.bound_table.collect()})
    shipped = rows()
    assert shipped[0] == {(0, "found", 30), (1, "found", 12), (2, "not_found", None)}
    monkeypatch.setattr(search, "BROADCAST_EDGES", 0)
    for name in ("small", "by_profile", "bound_table", "marks"):
        own.__dict__.pop(name, None)
    assert rows() == shipped
    with pytest.raises(ValueError):
        own.by_profile


def test_components(spark):
    got = {r["node"]: r["component"] for r in components.connected(spark.createDataFrame([(0, 1), (2, 3), (3, 1), (7, 8)], "a long, b long")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7}


def test_reachable(spark):
    labels = spark.createDataFrame([(i, i) for i in range(4)], "node long, component long")
    macros = spark.createDataFrame([(2, 0, 1)], "profile_id int, src long, dst long")
    rings = spark.createDataFrame([(2, 1), (2, 2)], "profile_id int, node long")
    globals_ = spark.createDataFrame([(3, 3)], "profile_id int, dst long")
    ask_ = [(1, 2, 0, 2), (2, 2, 2, 0), (3, 3, 0, 3), (4, 3, 0, 1), (5, 3, None, 3), (6, 2, 0, 0)]
    got = routes.reachable(spark.createDataFrame(ask_, "query_id long, profile_id int, start long, goal long"), labels, macros, rings, globals_)
    assert {r[0]: r[1] for r in got.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: True}


def test_budgets(spark):
    g = {0: small(50, [(k, k + 1, 10) for k in range(49)])}
    q = spark.createDataFrame([(1, 0, 5, 0, 49), (2, 0, 5, 0, 3), (3, 0, 0, None, 4)], "query_id long, profile_id int, seed long, start long, goal long")
    got = {r["query_id"]: r for r in search.retried(q, g, 10).collect()}
    assert got[1]["status"] == "budget_exceeded" and got[2]["status"] == "found" and got[3]["status"] == "not_found"


def test_abilities():
    east = [("move", (k, 0, 0), 600.0) for k in range(1, 21)]
    got = [a["type"] for a in abilities.insert_abilities(east, abilities.Abilities())]
    assert got[:2] == ["dive", "surge"]
    turn = [("move", (0, k, 0), 600.0) for k in range(1, 12)] + [("move", (k, 11, 0), 600.0) for k in range(1, 16)]
    out = abilities.insert_abilities(turn, abilities.Abilities())
    assert out[0]["type"] == "dive" and sum(a["tiles"] for a in out) == 26
    assert abilities.insert_abilities(east, abilities.Abilities(surge=False, dive=False))[3]["to"] == (4, 0, 0)
    assert abilities.insert_abilities([], abilities.Abilities()) == []
    first = next(k for k, a in enumerate(abilities.insert_abilities(east, abilities.Abilities(dive=False))) if a["type"] == "surge")
    assert first == 4  # three moves in the heading after the first tile


def test_store(spark, tmp_path):
    root = str(tmp_path / "snap")
    a = spark.createDataFrame([(1, "x"), (2, None)], "k long, v string")
    first = store.write_snapshot(spark, root, {"t": a})
    service = store.Service(spark, root)
    assert service.health()["counts"] == {"t": 2}
    second = store.write_snapshot(spark, root, {"t": a.union(a)})
    assert first != second and service.snapshot.tables["t"].count() == 2 and service.reload() and service.health()["counts"] == {"t": 4}
    store.open_snapshot(spark, root, verify=True)
    (tmp_path / "snap" / "CURRENT").write_text("{")
    assert not service.reload() and service.health()["counts"] == {"t": 4}


def test_text(spark):
    lines = spark.createDataFrame([("1 2 0",), ("  ",), ("3,4,1 extra",), ("a b c",), ("1 2",)], "value string")
    assert sorted((r["x"], r["ok"]) for r in text.coordinates(lines).collect() if r["ok"]) == [(1, True), (3, True)]
    assert text.coordinates(lines).count() == 4
    blob = spark.createDataFrame([(np.array([1, -2, 3, 70000, 5, 6], "<i4").tobytes(),), (b"123",), (b"",)], "b binary")
    got = [r[0] for r in blob.select(text.triplets("b")).collect()]
    assert [tuple(t) for t in got[0]] == [(1, -2, 3), (70000, 5, 6)] and got[1] is None and got[2] == []


def test_validate(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0005), ("z", 2.0)], "k string, v double")
    assert {(r["k"], r["problem"]) for r in validate.beyond(a, b, ["k"], "v", 1e-3).collect()} == {("y", "only_left"), ("z", "only_right")}


def test_stream(spark, tmp_path):
    from wayfold.streaming import answer_stream

    g = {0: small(5, [(k, k + 1, 10) for k in range(4)])}
    spark.createDataFrame([(1, 0, 0, 0, 4)], "query_id long, profile_id int, seed long, start long, goal long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, profile_id int, seed long, start long, goal long").parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda q: search.route(q, g), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["cost"] == 40


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

def test_searches_agree(spark):
    """Guided, from both ends, in buckets and by joins: the same costs, and by joins the same paths."""
    rng, n = np.random.default_rng(5), 70
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 180), rng.integers(0, n, 180), rng.integers(100_000, 900_000, 180), strict=True) if a != b]
    rings, globals_ = {4: 50_000, 31: 0, 55: 70_000}, {8: 2_000_000, 60: 1_500_000}
    g = small(n, edges, rings.items(), globals_.items())
    free = small(n, edges, rings.items())
    table = landmarks.distance_tables(free, spark.createDataFrame([(0, 3), (1, 40), (2, 66)], "li int, node long"))
    marks = search.Landmarks.of(table, n)
    fewer = more = 0
    for start in range(0, n, 3):
        for goal in range(0, n, 4):
            for seed in (0, 77):
                _, done, status, pops = g.search({start: 0}, {goal}, seed)
                guide = marks.guide(goal, marks.best([start], goal))
                _, near, state, some, _ = g.guided({start: 0}, goal, guide, seed)
                assert (status, done.get(goal)) == (state, near.get(goal))
                cost, path, both, _ = g.both_ways({start: 0}, goal, seed)
                assert (both, cost) == (status, done.get(goal))
                if cost is not None:
                    assert g.path(near, {start: 0}, goal, seed) == g.path(done, {start: 0}, goal, seed)
                    assert path[0] == start and path[-1] == goal
                    _, rough, _, _, _ = g.guided({start: 0}, goal, guide, seed, bucket=200_000)
                    assert cost <= rough[goal] < cost + 200_000
                    for k in (1, 2):  # fewer landmarks change nothing
                        assert g.guided({start: 0}, goal, marks.guide(goal, marks.best([start], goal, k)), seed)[1][goal] == cost
                    assert guide[start] <= cost or any(cost < guide[start] for _ in globals_)
                fewer, more = fewer + some, more + pops
    assert fewer < more
    assert g.guided({0: 0}, 1, np.zeros(n, np.int64), budget=1)[2] == "budget_exceeded" and g.guided({0: 0}, 1, np.zeros(n, np.int64), cancel=lambda: True)[2] == "cancelled"
    assert marks.best([5], 9, 2).tolist() == sorted(np.lexsort((np.arange(3), -marks.scores([5], 9)))[:2].tolist())
    assert (marks.scores([5, 7], 9) == np.minimum(marks.scores([5], 9), marks.scores([7], 9))).all() and search.first_budget(4_000_000) == 2_000_000
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    asked = frame([(i, 0, (0, 77)[i % 2], None if i % 3 == 0 else (7 * i) % n, (11 * i) % n) for i in range(24)], "query_id long, profile_id int, seed long, start long, goal long")
    want = {r["query_id"]: (r["status"], r["cost"], r["path"]) for r in search.route(asked, {0: g}).collect()}
    walk, hops = frame(edges[:120], "src long, dst long, w long"), frame([(0, *e) for e in edges[120:]], "profile_id int, src long, dst long, cost long")
    got = search.relaxed(asked, walk, hops, frame([(0, *r) for r in rings.items()], "profile_id int, node long, cost long"), frame([(0, *r) for r in globals_.items()], "profile_id int, dst long, cost long"))
    assert {r["query_id"]: (r["status"], r["cost"], r["path"]) for r in got.collect()} == want
    led = {r["query_id"]: (r["status"], r["cost"], r["path"]) for r in search.route(asked, {0: g}, marks=marks).collect()}
    assert led == want


def test_requests_and_paths(spark, tmp_path):
    from wayfold.operators import replay, requests
    from wayfold.sources import paths

    with pytest.raises(ValueError, match="table name"):
        paths.path_table(spark, "a; drop table b")
    tiles = spark.createDataFrame([(3200, 64, 0, 255), (3201, 64, 0, 7)], "x int, y int, plane int, walk_mask int")
    tiles.createOrReplaceTempView("tiles_one")
    regions.pack_regions(tiles).createOrReplaceTempView("tiles_packed")
    for name in ("tiles_packed", "no_such_table"):
        assert sorted(map(tuple, paths.tiles_of(spark, name, "tiles_one").collect())) == sorted(map(tuple, tiles.collect()))
    assert paths.with_column(tiles, "lodestone").columns == [*tiles.columns, "lodestone"] and paths.with_column(tiles, "x").columns == tiles.columns
    entry = '{"name": "a", "start": [1, 2, 0], "goal": [3, 4, 0], "profile": "all", "quick_tele": true, "expect": {"found": true, "cost_unseeded": 5.5, "pops_max": 9}}'
    (tmp_path / "golden.json").write_text(f"[{entry}]")
    corpus = replay.read_corpus(spark, str(tmp_path / "golden.json"))
    assert corpus.first()["cost_unseeded"] == 5.5 and corpus.first()["entry"] is None
    replay.bless(spark.createDataFrame([("a", True, 7.5, None, 12)], "name string, found boolean, cost double, entry long, pops long"), corpus, str(tmp_path / "blessed"))
    assert replay.read_corpus(spark, str(tmp_path / "blessed")).first()["pops_max"] == 12
    given = spark.createDataFrame([(1, '{"goal_id": 4, "profile": {"requirements": [{"key": "coins", "value": 5}]}}')], "id long, body string")
    assert [tuple(r) for r in requests.profile_rows(requests.decoded(given), "id").collect()] == [(1, "coins", "5")]
    bodies = spark.createDataFrame([(1, "{}")], "query_id long, body string")
    requests.dumped(bodies, str(tmp_path / "dump"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "dump")).collect()] == ["{}"]


def test_places_beyond_the_range_of_keys(spark):
    """Every tile is a node, in the order of plane, y and x, and walks; steps keep
    their ends, with keys as in the SQL."""
    tiles = spark.createDataFrame([(x, y, p, 255) for p in (0, 1) for y in (3200, 40000, 40001) for x in (10, 11)], "x int, y int, plane int, walk_mask int")
    nodes = graph.dense_ids(tiles)
    rows = sorted(nodes.collect(), key=lambda r: (r["plane"], r["y"], r["x"]))
    assert [r["id"] for r in rows] == list(range(12)) and all(r["key"] == r["plane"] << 30 | r["y"] << 15 | r["x"] for r in rows)
    assert graph.walk_edges(nodes).count() == 2 * (12 + 2)
    step = spark.createDataFrame([("door", 1, 10, 40000, 0, 11, 40001, 0, 1.0, None, None, None)], "kind string, id long, src_x int, src_y int, src_plane int, dst_x int, dst_y int, dst_plane int, cost_ms double, next_kind string, next_id long, requirements string")
    assert [(r["src"], r["dst"]) for r in chains.heads(chains.parsed_steps(step), chains.LOCAL).collect()] == [(40000 << 15 | 10, 40001 << 15 | 11)]
    points = nodes.where("y = 40001 AND x = 11").select("x", "y", "plane")
    assert sorted((r["plane"], r["node"]) for r in routes.tile_exists(points, nodes).collect()) == [(0, 5), (1, 11)]


def test_graphs_in_parts(spark):
    """Tasks read the graphs from the shared folder: the same answers and tables
    as from graphs that the driver holds."""
    rng, n = np.random.default_rng(21), 40
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 90), rng.integers(0, n, 90), rng.integers(1, 900, 90), strict=True) if a != b]
    walk = spark.createDataFrame(edges[:60], "src long, dst long, w long")
    hops = spark.createDataFrame([(p, *e) for p in (0, 7) for e in edges[60 + p :]], "profile_id int, src long, dst long, cost long")
    rings = spark.createDataFrame([(0, 4, 50), (0, 31, 0), (7, 20, 700), (7, 5, 3), (7, 5, 90)], "profile_id int, node long, cost long")
    far = spark.createDataFrame([(7, 9, 40), (0, 2, 10)], "profile_id int, dst long, cost long")
    held = search.parts(n, walk, hops, rings, far)
    asked = spark.createDataFrame([(i, (0, 7)[i % 2], i % 3, None if i % 5 == 0 else i % n, (7 * i) % n) for i in range(30)], "query_id long, profile_id int, seed long, start long, goal long")
    rows = lambda t: sorted(map(str, t.collect()))
    assert rows(search.route(asked, held)) == rows(search.route(asked, search.graphs(n, walk, hops, rings, far, [0, 7])))
    macros = spark.createDataFrame([(*e, "door") for e in edges[60:]], "src long, dst long, cost long, kind string")
    marks = spark.createDataFrame([(0, 3), (1, 31)], "li int, node long")
    ring = rings.select("node", "cost")
    table = landmarks.distance_tables(landmarks.bound_parts(n, walk, macros, ring), marks)
    assert rows(table) == rows(landmarks.distance_tables(landmarks.bound_graph(n, walk, macros, ring), marks))
    read = search.Landmarks.read(search.marked(table).toPandas(), n)
    plain_ = search.Landmarks.of(table, n)
    assert (read.fw == plain_.fw).all() and (read.bw == plain_.bw).all()


def test_world_ships_no_edges(spark, monkeypatch):
    """Neither edges nor landmark tables pass the driver."""
    def refuse(*_):
        raise AssertionError("an edge table in the driver")

    for name in ("graphs", "Landmarks.of"):
        monkeypatch.setattr(f"wayfold.operators.search.{name}", refuse)
    monkeypatch.setattr(landmarks, "bound_graph", refuse)
    own, frame = World(spark, ""), spark.createDataFrame
    own.__dict__.update(n=6, walk=frame([(0, 1, 10), (1, 2, 10), (2, 3, 500)], "src long, dst long, w long"), macros=frame([(1, 3, 20, "npc")], "src long, dst long, cost long, kind string"), macros_ok=frame([(0, 1, 3, 20)], "profile_id int, src long, dst long, cost long"), rings=frame([(2, 5), (4, 5)], "node long, cost long"), rings_ok=frame([(0, 2, 5), (0, 4, 5)], "profile_id int, node long, cost long"), globals_ok=frame([(0, 2, 7)], "profile_id int, dst long, cost long"))
    own.globals = frame([("poa_item", 0, 3)], "kind string, id int, dst long")
    asked = frame([(0, 0, 0, 0, 3)], "query_id long, profile_id int, seed long, start long, goal long")
    assert own.small and [r["cost"] for r in own.answers(asked, guided=True).collect()] == [30]


def test_reach_holds_one_side(spark):
    """What a node reaches, and what reaches it, with rings, against relaxation; a
    search ahead makes no index of edges by their ends."""
    rng, n = np.random.default_rng(5), 30
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 45), rng.integers(0, n, 45), rng.integers(0, 90, 45), strict=True) if a != b]
    rings, far = {4: 50, 11: 0, 20: 7}, {9: 40}
    held = search.Graph(n, *(np.array(c) for c in zip(*edges, strict=True)), rings, far)
    every = edges + [(a, b, w) for a in rings for b, w in rings.items() if a != b]

    def relaxed(at, back):
        best = {at: 0} if back else {v: c for v, c in far.items()} | {at: 0}
        for _ in range(n):
            for a, b, w in every:
                u, v = (b, a) if back else (a, b)
                if u in best and best[u] + w < best.get(v, best[u] + w + 1):
                    best[v] = best[u] + w
        return best

    for at in (0, 4, 11, 17, 29):
        assert dict(zip(*(x.tolist() for x in held.reach(at)), strict=True)) == relaxed(at, False)
    assert "into" not in vars(held)
    for at in (0, 4, 11, 17, 29):
        assert dict(zip(*(x.tolist() for x in held.reach(at, back=True)), strict=True)) == relaxed(at, True)


def wide(n, edges, own, rings, globals_):
    """mapped.Wide of edges of all profiles and of one's own."""
    def side(a, b):
        by = np.array([e[a] for e in edges], np.int64)
        order = np.argsort(by, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(by, minlength=n))])
        cols = [np.array([e[k] for e in own], np.int64) for k in (a, b, 2)]
        return mapped.Side(first, np.array([e[b] for e in edges], np.int32)[order], np.array([e[2] for e in edges], np.int64)[order], None, tuple(cols))

    return mapped.Wide(n, side(0, 1), side(1, 0), rings, globals_)


def test_mapped_searches_agree():
    """Costs, counts of settled nodes and paths of searches by arrays are those of
    searches with a heap, also where edges cost nothing or much the same."""
    for k in range(12):
        rng, n = np.random.default_rng(k), 40
        step = (1, 40_000_000)[k % 2]
        edges = [(int(a), int(b), int(w) * step) for a, b, w in zip(rng.integers(0, n, 90), rng.integers(0, n, 90), rng.integers(k % 3 // 2, 9, 90), strict=True) if a != b]
        rings = [{}, {4: 2 * step, 11: 0, 20: 0, 31: 7 * step}][k % 4 > 0]
        far = [{}, {8: 12 * step, 30: 9 * step}][k % 4 > 1]
        plain, arrays = small(n, edges, rings.items(), far.items()), wide(n, edges[:60], edges[60:], rings, far)
        for seed in (0, 3, 70001):
            for start in (0, 4, 9, 11, 25, None):
                sources, origin = (dict(far), False) if start is None else ({start: 0}, True)
                if not sources:
                    continue
                _, every, _, reached = plain.search(sources, {-1}, seed, origin)
                whole = arrays.costs(sources, None, seed, origin)
                assert {v: int(whole[v]) for v in np.flatnonzero(whole < search.NO_WAY)} == every and reached == len(every)
                for goal in range(0, n, 3):
                    best = arrays.costs(sources, {goal}, seed, origin)
                    _, done, status, pops = plain.search(sources, {goal}, seed, origin)
                    assert (best[goal] < search.NO_WAY) == (status == "found")
                    if status == "found":
                        assert best[goal] == done[goal] and arrays.settled(best, sources, goal, seed, origin) == pops
                        assert arrays.path(best, sources, goal, seed, origin) == plain.path(done, sources, goal, seed, origin)
        bare = small(n, edges, rings.items())
        for at in (0, 4, 20, 33):
            for back in (False, True):
                best = wide(n, edges[:60], edges[60:], rings, {}).costs({at: 0}, back=back)
                node, cost = bare.reach(at, back)
                assert dict(zip(node.tolist(), cost.tolist(), strict=True)) == {int(v): int(best[v]) for v in np.flatnonzero(best < search.NO_WAY)}


def test_mapped_routes(spark, monkeypatch):
    """Beyond the bound on shipped edges, routes, budgets and landmark tables come
    from mapped files, in blocks, without a round of joins."""
    rng, n = np.random.default_rng(8), 50
    edges = [(int(a), int(b), int(w)) for a, b, w in zip(rng.integers(0, n, 110), rng.integers(0, n, 110), rng.integers(1, 900, 110), strict=True) if a != b]
    frame = spark.createDataFrame
    asked = frame([(i, (0, 2)[i % 2], (0, 77)[i % 3 % 2], None if i % 5 == 0 else (7 * i) % n, (11 * i) % n) for i in range(30)], "query_id long, profile_id int, seed long, start long, goal long")
    own = World(spark, "")
    pair = lambda rows: [(p, *r) for p in (0, 2) for r in rows[p:]]
    own.__dict__.update(
        n=n, walk=frame(edges[:70], "src long, dst long, w long"), macros=frame([(*e, "npc") for e in edges[70:]], "src long, dst long, cost long, kind string"),
        macros_ok=frame(pair(edges[70:]), "profile_id int, src long, dst long, cost long"), rings=frame([(4, 50), (31, 0), (40, 7)], "node long, cost long"),
        rings_ok=frame(pair([(4, 50), (31, 0), (40, 7)]), "profile_id int, node long, cost long"), globals_ok=frame(pair([(8, 2000), (20, 1500), (9, 900)]), "profile_id int, dst long, cost long"),
        globals=frame([("poa_item", 0, 3), ("poa_item", 5, 44)], "kind string, id int, dst long"), nodes=frame([(k,) for k in range(n)], "id long"),
    )
    rows = lambda df: {tuple(str(v) for v in r) for r in df.collect()}

    def got():
        for name in ("bound_table", "marks"):
            own.__dict__.pop(name, None)
        graphs = own.by_profile if own.small else own.mapped
        return [rows(own.answers(asked)), rows(own.bound_table.select("li", "node", "fw", "bw")), landmarks.farthest(own.reach, own.walk, own.macros, own.nodes, 3), *(rows(search.retried(asked, graphs, b)) for b in (3, 10))]

    want = got()
    monkeypatch.setattr(search, "BROADCAST_EDGES", 0)
    for name in ("relaxed", "distances"):
        monkeypatch.setattr(search, name, None)
    for name in ("joined", "joined_tables", "bound_edges"):
        monkeypatch.setattr(landmarks, name, None)
    for block in (mapped.BLOCK, 16):
        monkeypatch.setattr(mapped, "BLOCK", block)
        for name in ("mapped", "bound_mapped"):
            own.__dict__.pop(name, None)
        assert got() == want
    many = frame([(k, k + 1, 3 * k) for k in range(400)], "src long, dst long, w long")  # more weights than codes
    graphs = search.mapped_parts(401, many, own.macros_ok.limit(0), own.rings_ok.limit(0), own.globals_ok.limit(0))
    assert graphs.weights is None and search.route(frame([(0, 0, 0, 2, 399)], "query_id long, profile_id int, seed long, start long, goal long"), graphs).first()["cost"] == sum(3 * k for k in range(2, 399))


def test_retries_of_one_id(spark):
    """Rows that share a query's id are retried each for itself."""
    g = {0: small(50, [(k, k + 1, 10) for k in range(49)])}
    asked = spark.createDataFrame([(7, 0, 5, 0, 30), (7, 0, 5, 0, 40), (7, 0, 5, 0, 2)], "query_id long, profile_id int, seed long, start long, goal long")
    assert sorted((r["goal"], r["status"]) for r in search.retried(asked, g, 12).collect()) == [(2, "found"), (30, "found"), (40, "found")]


def test_mapped_components(spark, monkeypatch):
    """Components by arrays are those by joins, in one step of FRONT nodes or many,
    and landmarks chosen with them are the same."""
    rng, n = np.random.default_rng(2), 60
    edges = [(int(a), int(b), 5) for a, b in zip(rng.integers(0, n, 45), rng.integers(0, n, 45), strict=True) if a != b]
    edges += [(b, a, w) for a, b, w in edges]
    walk, nodes = spark.createDataFrame(edges, "src long, dst long, w long"), spark.range(n)
    macros = spark.createDataFrame([(3, 40, 7, "npc"), (41, 2, 9, "npc"), (17, 55, 30, "npc")], "src long, dst long, cost long, kind string")
    joined = {r["node"]: r["component"] for r in components.connected(walk.selectExpr("src AS a", "dst AS b")).collect()}
    want = {k: joined.get(k, k) for k in range(n)}
    for front in (mapped.FRONT, 7):
        monkeypatch.setattr(mapped, "FRONT", front)
        labels = mapped.components(n, walk)
        assert {r["node"]: r["component"] for r in labels.collect()} == want
    graphs = landmarks.bound_mapped(n, walk, macros, spark.createDataFrame([], "node long, cost long"))
    reach = lambda at: mapped.reached(graphs, at)
    assert landmarks.farthest(reach, walk, macros, nodes, 3) == landmarks.farthest(reach, walk, macros, nodes, 3, labels=labels)
