"""DuckDB SQL for the registered queries: common tables by name, put together as
one WITH clause for each query."""

from __future__ import annotations

import re

_PLACE = """3200 + (({k} // 4096) % 2) * 64 + ({k} % 4096) % 64 AS {p}x, 3200 + (({k} // 4096) // 4) * 64 + ({k} % 4096) // 64 AS {p}y, (({k} // 4096) // 2) % 2 AS {p}plane"""
_KEY = "(({p}plane << 30) | ({p}y << 15) | {p}x)"


def _key_of(k: str) -> str:
    return f"((((({k} // 4096) // 2) % 2) << 30) | ((3200 + (({k} // 4096) // 4) * 64 + ({k} % 4096) // 64) << 15) | (3200 + (({k} // 4096) % 2) * 64 + ({k} % 4096) % 64))"


def _jit(seed: str, u: str, v: str) -> str:
    return f"(CASE WHEN {seed} = 0 THEN 0 ELSE (((xor(((xor({seed}, {u}) & 65535) * 435), {v})) & 65535) * 435) & 65535 END)"


_TRIM = r"regexp_replace({c}, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g')"
_NORM = "translate(" + _TRIM + ", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REQS = "coalesce(list_filter(list_transform(regexp_split_to_array(coalesce({c}, ''), '[;,]'), lambda p: CASE WHEN regexp_full_match(trim(p), '[+-]?[0-9]+') THEN CAST(trim(p) AS BIGINT) END), lambda v: v IS NOT NULL), [])"
_TEXT = "CASE WHEN s % 3 = 0 THEN NULL WHEN s % 3 = 1 THEN CAST(s % 40 AS VARCHAR) ELSE (s % 40) || '; ' || ((7 * s) % 45 + CASE WHEN s % 15 = 2 THEN 1000000 ELSE 0 END) END"
_TICKS = 655360


def _rows(kind, key, src, dst, cost, nk, ni, text, source):
    return f"SELECT '{kind}' AS kind, CAST({key} AS BIGINT) AS id, CAST({src} AS BIGINT) AS sk, CAST({dst} AS BIGINT) AS dk, CAST({cost} AS BIGINT) * {_TICKS} AS cost, {nk} AS next_kind, CAST({ni} AS BIGINT) AS next_id, {text} AS t FROM {source}"


def _chain(kinds: str, local: bool) -> str:
    """Recursive: every chain from its head, a row for each step taken."""
    return f"""SELECT kind, id, src, dst, cost, reqs, 1 AS n_steps, [kind || ':' || id] AS path, next_kind AS nk, next_id AS ni
  FROM steps h WHERE kind IN ({kinds}) {'AND src IS NOT NULL' if local else ''}
    AND NOT EXISTS (SELECT 1 FROM steps t WHERE t.kind <> 'poa_item' AND t.next_kind = h.kind AND t.next_id = h.id)
  UNION ALL
  SELECT c.kind, c.id, c.src, coalesce(s.dst, c.dst), c.cost + s.cost, list_concat(c.reqs, s.reqs), c.n_steps + 1, list_append(c.path, s.kind || ':' || s.id), s.next_kind, s.next_id
  FROM {{me}} c JOIN steps s ON s.kind = c.nk AND s.id = c.ni
  WHERE NOT list_contains(c.path, s.kind || ':' || s.id)"""


_KNOWN = "'door','lodestone','npc','object','item','ifslot','poa_item'"
_ENDED = f"nk IS NULL OR ni IS NULL OR nk NOT IN ({_KNOWN})"
_SORTED = "list_sort(list_distinct(reqs))"

CTES: dict[str, str] = {
    "n": "SELECT count(*) AS n FROM orders",
    "tiles": f"SELECT {_PLACE.format(k='o_orderkey', p='')}, 240 | (15 - CASE WHEN o_custkey % 6 < 4 THEN 0 ELSE 1 << CAST(o_custkey % 4 AS INT) END) AS walk_mask FROM orders WHERE o_custkey % 7 <> 0",
    "nodes": f"SELECT row_number() OVER (ORDER BY plane, y, x) - 1 AS id, {_KEY.format(p='')} AS key, x, y, plane, walk_mask FROM tiles",
    "dirs": "SELECT * FROM (VALUES (0,-1,0,1,4),(1,0,-1,2,8),(2,1,0,4,1),(3,0,1,8,2),(4,-1,1,25,6),(5,-1,-1,35,12),(6,1,-1,70,9),(7,1,1,140,3)) d(dir, dx, dy, a, b)",
    "walk": "SELECT s.id AS src, t.id AS dst, dir, CASE WHEN dir < 4 THEN 196608000 ELSE 278045700 END AS w FROM nodes s CROSS JOIN dirs JOIN nodes t ON t.x = s.x + dx AND t.y = s.y + dy AND t.plane = s.plane WHERE (s.walk_mask & a) = a AND (t.walk_mask & b) = b",
    "raw_steps": " UNION ALL ".join([
        _rows("door", "s_suppkey", "s_suppkey * 149", "s_suppkey * 149 + 1", 600, "CASE WHEN s_suppkey % 10 = 0 THEN 'lodestone' END", "CASE WHEN s_suppkey % 10 = 0 THEN s_suppkey % 25 END", _TEXT.replace("s %", "s_suppkey %").replace("* s)", "* s_suppkey)"), "supplier WHERE s_suppkey % 5 = 0"),
        _rows("npc", "s_suppkey", "s_suppkey * 149", "s_suppkey * 7919 + 31", 1800, "NULL", "NULL", _TEXT.replace("s %", "s_suppkey %").replace("* s)", "* s_suppkey)"), "supplier WHERE s_suppkey % 5 = 1"),
        _rows("object", "s_suppkey", "s_suppkey * 149", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey * 7919 + 31 END", 1200, "CASE WHEN s_suppkey % 35 = 2 THEN 'object' WHEN s_suppkey % 3 = 0 THEN 'npc' END", "CASE WHEN s_suppkey % 35 = 2 THEN s_suppkey WHEN s_suppkey % 3 = 0 THEN s_suppkey - 1 END", _TEXT.replace("s %", "s_suppkey %").replace("* s)", "* s_suppkey)"), "supplier WHERE s_suppkey % 5 = 2"),
        _rows("ifslot", "s_suppkey", "NULL", "s_suppkey * 7919 + 31", 3000, "NULL", "NULL", _TEXT.replace("s %", "s_suppkey %").replace("* s)", "* s_suppkey)"), "supplier WHERE s_suppkey % 5 = 3"),
        _rows("lodestone", "n_nationkey", "NULL", "n_nationkey * 601 + 17", "17000 + 100 * n_nationkey", "NULL", "NULL", "CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END", "nation"),
        _rows("item", "r_regionkey", "NULL", "NULL", 2000, "CASE WHEN r_regionkey < 4 THEN 'ifslot' ELSE 'nosuch' END", "CASE WHEN r_regionkey < 4 THEN 5 * r_regionkey + 3 ELSE 1 END", "NULL", "region"),
        _rows("poa_item", "r_regionkey", "NULL", "r_regionkey * 31 + 3", 2500, "NULL", "NULL", "CAST(r_regionkey AS VARCHAR)", "region"),
    ]),
    "steps": f"SELECT kind, id, {_key_of('(sk % n.n)')} AS src, {_key_of('(dk % n.n)')} AS dst, cost, next_kind, next_id, {_REQS.format(c='t')} AS reqs FROM raw_steps, n",
    "local_walks": _chain("'door','npc','object'", True).replace("{me}", "local_walks"),
    "global_walks": _chain("'lodestone','item','ifslot','poa_item'", False).replace("{me}", "global_walks"),
    "local_chains": f"SELECT kind, id, src, dst, cost, {_SORTED} AS reqs, n_steps, path FROM local_walks WHERE {_ENDED}",
    "global_chains": f"SELECT kind, id, src, dst, cost, {_SORTED} AS reqs, n_steps, path FROM global_walks WHERE {_ENDED}",
    "ahead": "SELECT c.kind, c.id, a.id AS src, b.id AS dst, c.cost, c.reqs, c.n_steps, false AS backward FROM local_chains c JOIN nodes a ON a.key = c.src JOIN nodes b ON b.key = c.dst",
    "macros": "SELECT * FROM ahead UNION ALL SELECT s.kind, s.id, i.id, o.id, s.cost, s.reqs, 1, true FROM ahead a JOIN steps s ON s.kind = 'door' AND s.id = a.id AND a.kind = 'door' JOIN nodes i ON i.key = s.dst JOIN nodes o ON o.key = s.src",
    "globals": "SELECT c.kind, c.id, b.id AS dst, c.cost, c.reqs, c.n_steps FROM global_chains c JOIN nodes b ON b.key = c.dst",
    "rings": f"SELECT s_suppkey AS id, b.id AS node, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE 600 * (1 + s_suppkey % 3) * {_TICKS} END AS cost, 'C' || s_suppkey AS code, {_REQS.format(c='CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CAST(s_suppkey % 40 AS VARCHAR) END')} AS reqs FROM supplier, n JOIN nodes b ON b.key = {_key_of('((s_suppkey * 149) % n.n)')} WHERE s_suppkey % 5 = 4",
    "tags": f"""SELECT p_partkey AS id, {_NORM.format(c="' ' || p_brand || chr(9)")} AS key, [0, 0, 1, 3, 2, 5, 4, 255][CAST(p_partkey % 8 AS INT) + 1] AS op, p_partkey % 4 <> 3 AS is_number,
        CASE WHEN p_partkey % 4 <> 3 THEN CAST(p_size AS BIGINT) END AS number, CASE WHEN p_partkey % 4 = 3 THEN {_NORM.format(c='p_type')} END AS word FROM part""",
    "client": f"SELECT p AS profile_id, {_NORM.format(c='p_brand')} AS key, CAST(25 AS BIGINT) AS number, {_NORM.format(c='min(p_type)')} AS word FROM part, (VALUES (2), (3)) v(p) GROUP BY p, p_brand UNION ALL SELECT 3, 'hasquicktele', 1, NULL",
    "met": """SELECT p AS profile_id, t.id AS req_id, CASE p WHEN 0 THEN false WHEN 1 THEN true ELSE coalesce(CASE WHEN is_number
          THEN CASE op WHEN 0 THEN c.number = t.number WHEN 1 THEN c.number <> t.number WHEN 2 THEN c.number > t.number WHEN 3 THEN c.number >= t.number WHEN 4 THEN c.number < t.number WHEN 5 THEN c.number <= t.number END
          ELSE CASE op WHEN 0 THEN c.word = t.word WHEN 1 THEN c.word <> t.word END END, false) END AS ok
        FROM tags t CROSS JOIN (VALUES (0), (1), (2), (3)) v(p) LEFT JOIN client c ON c.profile_id = p AND c.key = t.key""",
    "macros_ok": f"""SELECT p AS profile_id, m.* REPLACE (CASE WHEN p = 3 AND kind = 'lodestone' THEN 2400 * {_TICKS} ELSE cost END AS cost) FROM macros m, (VALUES (0), (1), (2), (3)) v(p)
        WHERE NOT EXISTS (SELECT 1 FROM unnest(m.reqs) u(r) WHERE r >= 0 AND NOT EXISTS (SELECT 1 FROM met WHERE met.profile_id = p AND met.req_id = r AND ok))""",
    "globals_ok": f"""SELECT profile_id, dst, min(cost) AS cost FROM (SELECT p AS profile_id, dst, CASE WHEN p = 3 AND kind = 'lodestone' THEN 2400 * {_TICKS} ELSE cost END AS cost FROM globals m, (VALUES (0), (1), (2), (3)) v(p)
        WHERE NOT EXISTS (SELECT 1 FROM unnest(m.reqs) u(r) WHERE r >= 0 AND NOT EXISTS (SELECT 1 FROM met WHERE met.profile_id = p AND met.req_id = r AND ok))) GROUP BY ALL""",
    "rings_ok": "SELECT p AS profile_id, m.* FROM rings m, (VALUES (0), (1), (2), (3)) v(p) WHERE NOT EXISTS (SELECT 1 FROM unnest(m.reqs) u(r) WHERE r >= 0 AND NOT EXISTS (SELECT 1 FROM met WHERE met.profile_id = p AND met.req_id = r AND ok))",
    "labels": "RECURSIVE",
    "queries": f"""SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_nationkey % 4 AS profile_id, n_nationkey % 3 AS seed, a.id AS start, b.id AS goal, CASE WHEN b.id IS NULL THEN 'goal_not_found' END AS problem
        FROM nation CROSS JOIN n LEFT JOIN nodes a ON a.key = {_key_of('((n_nationkey * 97 + 5) % n.n)')} LEFT JOIN nodes b ON b.key = {_key_of('((n_nationkey * 577 + 11) % n.n)')}""",
    "edges": "SELECT profile_id, src, dst, cost AS w FROM macros_ok UNION ALL SELECT p, src, dst, w FROM walk, (VALUES (0), (1), (2), (3)) v(p) UNION ALL SELECT a.profile_id, a.node, b.node, b.cost FROM rings_ok a JOIN rings_ok b ON a.profile_id = b.profile_id AND a.node <> b.node",
}

_RECURSIVE = {
    "labels": "labels(node, component) USING KEY (node) AS (SELECT id, id FROM nodes UNION SELECT w.dst, min(l.component) FROM labels l JOIN walk w ON w.src = l.node JOIN recurring.labels r ON r.node = w.dst WHERE l.component < r.component GROUP BY w.dst)",
}


def _search(seeded: bool, virtual: bool = False) -> str:
    """Least costs from each query's start, by query and node."""
    seed = "seed" if seeded else "0"
    step = f"e.w + {_jit('q.seed', 'd.node', 'e.dst')}" if seeded else "e.w"
    enter = f"g.cost + {_jit('q.seed', 'q.start', 'g.dst')}" if seeded else "g.cost"
    begin = "SELECT query_id, g.dst AS node, g.cost FROM queries q JOIN globals_ok g USING (profile_id) WHERE problem IS NULL" if virtual else (
        f"SELECT query_id, node, min(cost) FROM (SELECT query_id, start AS node, 0 AS cost FROM queries WHERE problem IS NULL AND start IS NOT NULL UNION ALL SELECT query_id, g.dst, {enter} FROM queries q JOIN globals_ok g USING (profile_id) WHERE problem IS NULL AND start IS NOT NULL UNION ALL SELECT query_id, g.dst, g.cost FROM queries q JOIN globals_ok g USING (profile_id) WHERE problem IS NULL AND start IS NULL) GROUP BY ALL")
    return f"""found(query_id, node, cost) USING KEY (query_id, node) AS ({begin}
      UNION SELECT d.query_id, e.dst, min(d.cost + {step}) FROM found d JOIN queries q ON q.query_id = d.query_id JOIN edges e ON e.profile_id = q.profile_id AND e.src = d.node
      LEFT JOIN recurring.found r ON r.query_id = d.query_id AND r.node = e.dst WHERE r.cost IS NULL OR d.cost + {step} < r.cost GROUP BY d.query_id, e.dst)"""


_ORDER = list(CTES)


def sql(body: str, extra: dict[str, str] | None = None, last: list[str] | None = None) -> str:
    """The body with all common tables that it needs, in order; extra: further
    recursive definitions (name -> text), which come last."""
    need: set[str] = set()
    texts = [body, *(extra or {}).values(), *(last or [])]
    while texts:
        text = texts.pop()
        for name in _ORDER:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                texts.append(_RECURSIVE.get(name, CTES[name]))
    parts = []
    for name in _ORDER:
        if name in need:
            # what is read again and again is worked out once
            kind = "" if name in ("local_walks", "global_walks") else "MATERIALIZED "
            parts.append(_RECURSIVE[name] if name in _RECURSIVE else f"{name} AS {kind}({CTES[name]})")
    parts += list((extra or {}).values()) + list(last or [])
    return f"WITH RECURSIVE {', '.join(parts)} {body}"


def _listed(c: str) -> str:
    return f"array_to_string({c}, ',')"


_COSTS = f"SELECT q.query_id, q.profile_id, CASE WHEN f.cost IS NULL THEN 'not_found' ELSE 'found' END AS status, f.cost, round(f.cost / {_TICKS}.0::DOUBLE, 3) AS cost_ms FROM queries q LEFT JOIN found f ON f.query_id = q.query_id AND f.node = q.goal WHERE q.problem IS NULL"
_BACK = """begun AS MATERIALIZED (SELECT query_id, start AS node, 0::BIGINT AS cost FROM queries WHERE start IS NOT NULL UNION ALL SELECT query_id, g.dst, g.cost FROM queries q JOIN globals_ok g USING (profile_id) WHERE start IS NULL),
  step AS MATERIALIZED (SELECT q.query_id, v.node, u.node AS before, u.cost < v.cost AS less, EXISTS (SELECT 1 FROM begun s WHERE s.query_id = q.query_id AND s.node = u.node) AS first
    FROM queries q JOIN found v ON v.query_id = q.query_id JOIN (SELECT profile_id, src, dst, w, false AS far FROM edges
      UNION ALL SELECT q2.profile_id, q2.start, g.dst, g.cost, true FROM (SELECT DISTINCT profile_id, start FROM queries WHERE start IS NOT NULL) q2 JOIN globals_ok g USING (profile_id)) e
      ON e.profile_id = q.profile_id AND e.dst = v.node AND (NOT e.far OR e.src = q.start)
    JOIN found u ON u.query_id = q.query_id AND u.node = e.src AND u.cost <= v.cost AND u.cost + e.w = v.cost WHERE NOT EXISTS (SELECT 1 FROM begun s WHERE s.query_id = q.query_id AND s.node = v.node AND s.cost = v.cost)),
  pred AS MATERIALIZED (SELECT query_id, node, min(before) AS before FROM step WHERE less GROUP BY ALL),
  pred0 AS MATERIALIZED (SELECT * FROM pred UNION ALL SELECT s.query_id, s.node, min(s.before) FROM step s LEFT JOIN pred p ON p.query_id = s.query_id AND p.node = s.before
    WHERE NOT s.less AND (s.first OR p.node IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM pred o WHERE o.query_id = s.query_id AND o.node = s.node) GROUP BY s.query_id, s.node),
  back(query_id, pos, node) AS (SELECT q.query_id, 0, q.goal FROM queries q JOIN found f ON f.query_id = q.query_id AND f.node = q.goal
    UNION ALL SELECT b.query_id, b.pos + 1, p.before FROM back b JOIN pred0 p ON p.query_id = b.query_id AND p.node = b.node)"""
_WAY = "way AS MATERIALIZED (SELECT query_id, max(pos) OVER (PARTITION BY query_id) - pos AS pos, node FROM back)"
_REACH = {"reach": """hubs AS MATERIALIZED (SELECT DISTINCT r.profile_id, l.component AS c FROM rings_ok r JOIN labels l ON l.node = r.node),
  hop AS MATERIALIZED (SELECT DISTINCT m.profile_id, a.component AS a, b.component AS b FROM macros_ok m JOIN labels a ON a.node = m.src JOIN labels b ON b.node = m.dst WHERE a.component <> b.component UNION SELECT profile_id, c, -1 FROM hubs UNION SELECT profile_id, -1, c FROM hubs),
  reach(query_id, profile_id, c) AS (SELECT q.query_id, q.profile_id, l.component FROM queries q JOIN labels l ON l.node = q.start UNION SELECT q.query_id, q.profile_id, l.component FROM queries q JOIN globals_ok g USING (profile_id) JOIN labels l ON l.node = g.dst
  UNION SELECT r.query_id, r.profile_id, h.b FROM reach r JOIN hop h ON h.profile_id = r.profile_id AND h.a = r.c)"""}
_TRIE_MARKS = {"free": f"""marks AS MATERIALIZED (SELECT id AS li, dst AS node FROM globals WHERE kind = 'poa_item'),
  free AS MATERIALIZED (SELECT src, dst, w FROM walk UNION ALL SELECT src, dst, CASE WHEN kind = 'lodestone' THEN least(cost, 2400 * {_TICKS}) ELSE cost END FROM macros UNION ALL SELECT a.node, b.node, b.cost FROM rings a JOIN rings b ON a.node <> b.node),
  fw(li, node, cost) USING KEY (li, node) AS (SELECT li, node, 0::BIGINT FROM marks UNION SELECT d.li, e.dst, min(d.cost + e.w) FROM fw d JOIN free e ON e.src = d.node LEFT JOIN recurring.fw r ON r.li = d.li AND r.node = e.dst WHERE r.cost IS NULL OR d.cost + e.w < r.cost GROUP BY d.li, e.dst),
  bw(li, node, cost) USING KEY (li, node) AS (SELECT li, node, 0::BIGINT FROM marks UNION SELECT d.li, e.src, min(d.cost + e.w) FROM bw d JOIN free e ON e.dst = d.node LEFT JOIN recurring.bw r ON r.li = d.li AND r.node = e.src WHERE r.cost IS NULL OR d.cost + e.w < r.cost GROUP BY d.li, e.src),
  far AS MATERIALIZED (SELECT coalesce(fw.li, bw.li) AS li, coalesce(fw.node, bw.node) AS node, fw.cost AS fw, bw.cost AS bw FROM fw FULL JOIN bw ON fw.li = bw.li AND fw.node = bw.node)"""}
_BOUND = """SELECT q.query_id, q.start, q.goal, coalesce(max(greatest(0, g.fw - s.fw, s.bw - g.bw)), 0) AS bound, coalesce(bool_or((s.fw IS NOT NULL AND g.fw IS NULL) OR (g.bw IS NOT NULL AND s.bw IS NULL)), false) AS hopeless
  FROM queries q LEFT JOIN (far s JOIN far g ON g.li = s.li) ON s.node = q.start AND g.node = q.goal WHERE q.start IS NOT NULL AND q.goal IS NOT NULL GROUP BY ALL"""
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(substr(c_name, i, 1))::BIGINT)), lambda h, b: (((xor(h, b) & 255) << 24) + xor(h, b) * 403) & 4294967295)"
_FOUND = {"found": _search(False)}

ORACLE: dict[str, str] = {
    "tiles_pack_roundtrip": sql(f"SELECT {_KEY.format(p='')} AS key, x, y, plane, walk_mask FROM tiles"),
    "region_pack_scan": sql("SELECT x, y, plane, walk_mask FROM tiles"),
    "coordinate_text": "SELECT CASE WHEN o_orderkey % 10 <> 1 THEN o_orderkey END AS x, CASE WHEN o_orderkey % 10 = 1 THEN o_orderkey ELSE o_custkey END AS y, CASE WHEN o_orderkey % 10 <> 1 THEN o_orderkey % 4 END AS plane, o_orderkey % 10 <> 1 AS ok FROM orders WHERE o_orderkey % 10 <> 0",
    "packed_triplets": sql(f"SELECT {_KEY.format(p='')} AS key, x, y, plane FROM tiles"),
    "result_shapes": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '{{' || c_custkey || ', 2, 0}, {3, 4, 1}}' WHEN 1 THEN '{{' || c_custkey || ', 2, 0}}' WHEN 2 THEN '{{' || c_custkey || ', 5, 0}, {1, 1, 1}}' ELSE '{{' || c_custkey || ', 9, 0}}' END AS points FROM customer",
    "sniffed_blobs": "SELECT c_custkey, hex(encode(c_name)) AS bytes FROM customer",
    "dedupe_consecutive": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE k = 1 OR before IS DISTINCT FROM event_type",
    "edge_jitter": sql(f"SELECT src, dst, 0 AS seed_0, {_jit('1', 'src', 'dst')} AS seed_1, {_jit('12345', 'src', 'dst')} AS seed_12345 FROM walk"),
    "key_hashes": f"SELECT c_custkey, {_FNV} AS hash FROM customer",
    "headings": "SELECT nullif(CASE sign(l_suppkey % 5 - 2) WHEN 1 THEN 'north' WHEN -1 THEN 'south' ELSE '' END || CASE sign(l_partkey % 5 - 2) WHEN 1 THEN 'east' WHEN -1 THEN 'west' ELSE '' END, '') AS heading, count(*) AS n, sum(greatest(abs(l_partkey % 5 - 2), abs(l_suppkey % 5 - 2)))::BIGINT AS steps FROM lineitem GROUP BY 1",
    "nodes_dense_ids": sql("SELECT id, key, x, y, plane, walk_mask FROM nodes"),
    "duplicate_tiles": sql("SELECT x, y, plane, 2 AS n FROM tiles WHERE x % 7 = 0"),
    "walk_edges": sql("SELECT src, dst, dir, w FROM walk"),
    "walk_edges_by_dir": sql("SELECT dir, count(*) AS n, sum(w)::BIGINT AS w FROM walk GROUP BY dir"),
    "walk_asymmetry": sql("SELECT count(*) AS n FROM walk a WHERE NOT EXISTS (SELECT 1 FROM walk b WHERE b.src = a.dst AND b.dst = a.src)"),
    "adjacency": sql("SELECT src, string_agg(dst || ':' || w, ',' ORDER BY dst) AS out FROM walk GROUP BY src"),
    "direction_masks": sql("SELECT src, bit_or(1 << dir) AS mask FROM walk GROUP BY src"),
    "dominated_steps": sql("SELECT t.prev, t.node, t.next FROM two t JOIN (SELECT prev, next, min(cost) AS best FROM (SELECT prev, next, cost FROM two UNION ALL SELECT src, dst, w FROM walk) GROUP BY ALL) b ON b.prev = t.prev AND b.next = t.next WHERE t.cost > b.best", last=["two AS MATERIALIZED (SELECT a.src AS prev, a.dst AS node, b.dst AS next, a.w + b.w AS cost FROM walk a JOIN walk b ON b.src = a.dst WHERE a.src <> b.dst)"]),
    "steps_union": sql(f"SELECT kind, id, src, dst, cost, next_kind, next_id, {_listed('reqs')} AS reqs FROM steps"),
    "requirement_lists": "SELECT p_partkey, CASE p_partkey % 6 WHEN 5 THEN '' ELSE (p_partkey % 50) || ',' || p_size END AS ids FROM part",
    "chain_heads": sql("SELECT kind, id FROM local_walks WHERE n_steps = 1 UNION ALL SELECT kind, id FROM global_walks WHERE n_steps = 1"),
    "chains_local": sql(f"SELECT kind, id, src, dst, cost, {_listed('reqs')} AS reqs, n_steps, array_to_string(path, '>') AS path FROM local_chains"),
    "chains_global": sql(f"SELECT kind, id, src, dst, cost, {_listed('reqs')} AS reqs, n_steps, array_to_string(path, '>') AS path FROM global_chains"),
    "macro_edges": sql(f"SELECT kind, id, src, dst, cost, {_listed('reqs')} AS reqs, n_steps, backward FROM macros"),
    "door_reverse_edges": sql(f"SELECT id, src, dst, cost, {_listed('reqs')} AS reqs FROM macros WHERE backward"),
    "global_edges": sql(f"SELECT kind, id, dst, cost, {_listed('reqs')} AS reqs, n_steps FROM globals"),
    "rings_resolved": sql(f"SELECT id, node, cost, code, {_listed('reqs')} AS reqs FROM rings"),
    "ring_hops": sql("SELECT a.node AS src, b.node AS dst, b.cost FROM rings a JOIN rings b ON a.id <> b.id"),
    "step_rows_json": sql("SELECT kind, id, cost, next_kind FROM steps"),
    "requirement_tags": sql(f"SELECT id, key, {_FNV.replace('c_name', 'key')} AS key_hash, op, is_number, number, word FROM tags"),
    "tag_satisfaction": sql("SELECT profile_id, req_id, ok FROM met"),
    "macro_filter": sql("SELECT profile_id, kind, id, backward, src, dst, cost FROM macros_ok"),
    "eligible_globals": sql("SELECT profile_id, dst, cost FROM globals_ok"),
    "eligible_rings": sql("SELECT profile_id, id, node, cost FROM rings_ok"),
    "walk_components": sql("SELECT node, component FROM labels"),
    "component_sizes": sql("SELECT component, count(*) AS n FROM labels GROUP BY component"),
    "component_graph": sql("SELECT m.profile_id, m.kind, m.id, m.backward, a.component AS from_comp, b.component AS to_comp FROM macros_ok m JOIN labels a ON a.node = m.src JOIN labels b ON b.node = m.dst WHERE a.component <> b.component"),
    "goal_reachable": sql("SELECT q.query_id, bool_or(r.c IS NOT NULL) AS reachable FROM queries q JOIN labels l ON l.node = q.goal LEFT JOIN reach r ON r.query_id = q.query_id AND r.c = l.component WHERE problem IS NULL GROUP BY 1", extra=_REACH),
    "resolved_queries": sql("SELECT query_id, profile_id, seed, start, goal, problem FROM queries"),
    "tile_exists": sql(f"SELECT CAST(n_nationkey AS BIGINT) AS query_id, g.x, g.y, g.plane, o.id AS node, o.id IS NOT NULL AS exists FROM (SELECT n_nationkey, {_PLACE.format(k='((n_nationkey * 577 + 11) % n.n)', p='')} FROM nation, n) g LEFT JOIN nodes o ON o.x = g.x AND o.y = g.y AND o.plane = g.plane"),
    "near_distances": sql("SELECT source, node, cost FROM near", extra={"near": f"near(source, node, cost) USING KEY (source, node) AS (SELECT id, node, 0::BIGINT FROM rings UNION SELECT d.source, e.dst, min(d.cost + e.w) FROM near d JOIN walk e ON e.src = d.node LEFT JOIN recurring.near r ON r.source = d.source AND r.node = e.dst WHERE d.cost + e.w <= 6000::BIGINT * {_TICKS} AND (r.cost IS NULL OR d.cost + e.w < r.cost) GROUP BY d.source, e.dst)"}),
    "route_costs": sql(_COSTS, extra=_FOUND),
    "route_costs_seeded": sql("SELECT q.query_id, q.seed, CASE WHEN f.cost IS NULL THEN 'not_found' ELSE 'found' END AS status, f.cost FROM queries q LEFT JOIN found f ON f.query_id = q.query_id AND f.node = q.goal WHERE q.problem IS NULL", extra={"found": _search(True)}),
    "route_virtual_start": sql(_COSTS, extra={"found": _search(False, True)}),
    "route_paths": sql("SELECT query_id, count(*) AS length_tiles, string_agg(node::VARCHAR, ',' ORDER BY pos) AS path FROM way GROUP BY query_id", extra=_FOUND, last=[_BACK, _WAY]),
    "route_geometry": sql("SELECT w.query_id, w.pos, o.x, o.y, o.plane FROM way w JOIN nodes o ON o.id = w.node", extra=_FOUND, last=[_BACK, _WAY]),
    "minimum_slice": sql("SELECT c.query_id, c.status, c.cost_ms, n.length_tiles FROM (" + _COSTS + ") c LEFT JOIN (SELECT query_id, count(*) AS length_tiles FROM way GROUP BY 1) n ON n.query_id = c.query_id", extra=_FOUND, last=[_BACK, _WAY]),
    "response_bodies": sql("SELECT c.query_id, c.status = 'found' AS found, n.length_tiles FROM (" + _COSTS + ") c LEFT JOIN (SELECT query_id, count(*) AS length_tiles FROM way GROUP BY 1) n ON n.query_id = c.query_id", extra=_FOUND, last=[_BACK, _WAY]),
    "route_actions": sql(f"""SELECT h.query_id, h.pos, h.u, h.v, CASE WHEN m.m IS NOT NULL THEN 'macro' WHEN w.w IS NOT NULL THEN 'move' WHEN g.g IS NOT NULL THEN 'global' WHEN ra.node IS NOT NULL AND rb.r IS NOT NULL THEN 'fairy' ELSE 'teleport' END AS type,
        CASE WHEN m.m IS NOT NULL THEN CASE m.m.kind WHEN 'poa_item' THEN 'teleport' ELSE m.m.kind END WHEN w.w IS NOT NULL THEN 'move' WHEN g.g IS NOT NULL THEN g.g.kind WHEN ra.node IS NOT NULL AND rb.r IS NOT NULL THEN 'fairy_ring' ELSE 'teleport' END AS kind,
        CASE WHEN m.m IS NOT NULL THEN m.m.id WHEN w.w IS NOT NULL THEN NULL WHEN g.g IS NOT NULL THEN g.g.id WHEN ra.node IS NOT NULL THEN rb.r.id END AS id,
        round(CASE WHEN m.m IS NOT NULL THEN m.m.cost / {_TICKS}.0::DOUBLE WHEN w.w IS NOT NULL THEN round(w.w / {_TICKS}.0::DOUBLE) WHEN g.g IS NOT NULL THEN g.g.cost / {_TICKS}.0::DOUBLE WHEN ra.node IS NOT NULL AND rb.r IS NOT NULL THEN rb.r.cost / {_TICKS}.0::DOUBLE ELSE 0 END, 3) AS cost_ms
      FROM (SELECT w.query_id, w.pos, q.profile_id, lag(w.node) OVER (PARTITION BY w.query_id ORDER BY w.pos) AS u, w.node AS v FROM way w JOIN queries q ON q.query_id = w.query_id) h
      LEFT JOIN (SELECT p AS profile_id, a.src, a.dst, coalesce(min(struct_pack(cost := o.cost, n_steps := o.n_steps, kind := o.kind, id := o.id)) FILTER (o.src IS NOT NULL), min(struct_pack(cost := a.cost, n_steps := a.n_steps, kind := a.kind, id := a.id))) AS m
        FROM macros a CROSS JOIN (VALUES (0), (1), (2), (3)) x(p) LEFT JOIN macros_ok o ON o.profile_id = p AND o.src = a.src AND o.dst = a.dst GROUP BY ALL) m ON m.profile_id = h.profile_id AND m.src = h.u AND m.dst = h.v
      LEFT JOIN (SELECT src, dst, min(w) AS w FROM walk GROUP BY ALL) w ON w.src = h.u AND w.dst = h.v
      LEFT JOIN (SELECT p AS profile_id, dst, min(struct_pack(cost := CASE WHEN p = 3 AND kind = 'lodestone' THEN 2400 * {_TICKS} ELSE cost END, kind := kind, id := id)) AS g FROM globals g2, (VALUES (0), (1), (2), (3)) v(p)
        WHERE NOT EXISTS (SELECT 1 FROM unnest(g2.reqs) u(r) WHERE r >= 0 AND NOT EXISTS (SELECT 1 FROM met WHERE met.profile_id = p AND met.req_id = r AND ok)) GROUP BY ALL) g ON g.profile_id = h.profile_id AND g.dst = h.v
      LEFT JOIN (SELECT DISTINCT profile_id, node FROM rings_ok) ra ON ra.profile_id = h.profile_id AND ra.node = h.u
      LEFT JOIN (SELECT profile_id, node, min(struct_pack(cost := cost, id := id)) AS r FROM rings_ok GROUP BY ALL) rb ON rb.profile_id = h.profile_id AND rb.node = h.v
      WHERE h.u IS NOT NULL""", extra=_FOUND, last=[_BACK, _WAY]),
    "path_recost": sql("SELECT query_id, true AS valid, true AS same FROM (SELECT q.query_id FROM queries q JOIN found f ON f.query_id = q.query_id AND f.node = q.goal WHERE q.start <> q.goal)", extra=_FOUND),
    "landmark_distances": sql("SELECT li, node, fw, bw FROM far", extra=_TRIE_MARKS),
    "landmark_bounds": sql(_BOUND, extra=_TRIE_MARKS),
    "bound_quanta": sql("SELECT li, node, CASE WHEN fw IS NOT NULL THEN least(fw // 41943040, 65534) END AS fw_q, CASE WHEN bw IS NOT NULL THEN least(bw // 41943040, 65534) END AS bw_q FROM far", extra=_TRIE_MARKS),
    "bound_violations": sql(f"SELECT coalesce(sum(CASE WHEN f.cost < least(b.bound, least(g.least, 2400 * {_TICKS})) THEN 1 ELSE 0 END), 0)::BIGINT AS n FROM ({_BOUND}) b JOIN found f ON f.query_id = b.query_id AND f.node = b.goal CROSS JOIN (SELECT min(cost) AS least FROM globals) g", extra=_TRIE_MARKS | _FOUND),
    "door_directions": sql("SELECT m.id AS query_id, 1 AS pos, m.id, CASE WHEN u.key = s.src THEN 'IN' WHEN u.key = s.dst THEN 'OUT' WHEN v.key = s.dst THEN 'IN' WHEN v.key = s.src THEN 'OUT' END AS direction, m.backward FROM macros m JOIN steps s ON s.kind = 'door' AND s.id = m.id JOIN nodes u ON u.id = m.src JOIN nodes v ON v.id = m.dst WHERE m.kind = 'door'"),
    "action_runs": "SELECT user_id AS query_id, run, event_type AS type, min(event_id) AS first_pos, count(*) AS n, sum(event_id % 7)::BIGINT AS cost_ms FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL",
    "snapshot_counts": sql("SELECT 'nodes' AS name, count(*) AS n FROM nodes UNION ALL SELECT 'walk', count(*) FROM walk UNION ALL SELECT 'macros', count(*) FROM macros UNION ALL SELECT 'globals', count(*) FROM globals UNION ALL SELECT 'rings', count(*) FROM rings UNION ALL SELECT 'tags', count(*) FROM tags"),
    "content_hashes": sql("SELECT count(*) AS rows FROM walk"),
    "request_histogram": "SELECT CASE WHEN floor(value) <= 0 THEN 0 ELSE length(bin(CAST(floor(value) AS BIGINT))) END AS bucket, count(*) AS n FROM events GROUP BY 1",
    "run_differences": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'only_right' WHEN o_orderkey % 7 = 0 THEN 'only_left' ELSE 'differs' END AS problem FROM orders WHERE o_orderkey % 35 <> 0 AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR (o_orderkey % 11 = 0 AND o_totalprice <> 0))",
    "perf_gate_medians": "SELECT name, median, tolerance, CASE WHEN median / base > 1 + tolerance THEN 'slower' WHEN median / base < 1 - tolerance THEN 'faster' ELSE 'same' END AS verdict FROM (SELECT l_returnflag || '/' || l_linestatus AS name, quantile_cont(l_quantity, 0.5) AS median, avg(l_quantity) AS base, CASE WHEN l_returnflag || '/' || l_linestatus LIKE 'A/F%' THEN 0.0001::DOUBLE WHEN l_returnflag = 'A' THEN 0.02::DOUBLE WHEN l_returnflag = 'N' THEN 0.1::DOUBLE ELSE 0.5::DOUBLE END AS tolerance FROM lineitem GROUP BY l_returnflag, l_linestatus)",
    "pair_corpus": sql(f"SELECT query_id, d AS distance, CASE WHEN d BETWEEN 50 AND 200 THEN 'short' WHEN d BETWEEN 500 AND 1500 THEN 'medium' WHEN d >= 2500 THEN 'long' ELSE 'other' END AS bucket FROM (SELECT n_nationkey::BIGINT AS query_id, greatest(abs(s_x - g_x), abs(s_y - g_y)) AS d FROM (SELECT n_nationkey, {_PLACE.format(k='((n_nationkey * 97 + 5) % n.n)', p='s_')}, {_PLACE.format(k='((n_nationkey * 577 + 11) % n.n)', p='g_')} FROM nation, n))"),
    "profile_values": sql("SELECT profile_id, key, number, word FROM client"),
}
ORACLE["precheck_agrees"] = sql("SELECT query_id, true AS agrees FROM queries WHERE problem IS NULL")
ORACLE["seeded_envelope"] = sql("SELECT DISTINCT q.query_id, true AS inside FROM queries q JOIN labels l ON l.node = q.goal JOIN reach r ON r.query_id = q.query_id AND r.c = l.component WHERE problem IS NULL", extra=_REACH)
ORACLE["route_costs_guided"] = ORACLE["route_costs_both_ways"] = ORACLE["route_costs"]
ORACLE["answer_statistics"] = sql("SELECT status, count(*) AS n, min(cost) AS least, max(cost) AS greatest FROM (" + _COSTS + ") GROUP BY status", extra=_FOUND)
ORACLE["landmark_choice"] = sql("""SELECT query_id, li, score FROM (SELECT q.query_id, g.li, CASE WHEN s.bw IS NULL THEN 4611686018427387904 ELSE greatest(0, coalesce(g.fw - s.fw, 0), s.bw - g.bw) END AS score, row_number() OVER (PARTITION BY q.query_id ORDER BY score DESC, g.li) AS k
  FROM queries q JOIN far g ON g.node = q.goal AND g.fw IS NOT NULL AND g.bw IS NOT NULL LEFT JOIN far s ON s.li = g.li AND s.node = q.start WHERE q.start IS NOT NULL) WHERE k <= 2""", extra=_TRIE_MARKS)
ORACLE["bound_quality"] = sql(f"SELECT b.query_id, b.bound, f.cost, round(b.bound / f.cost::DOUBLE, 6) AS share FROM ({_BOUND}) b JOIN found f ON f.query_id = b.query_id AND f.node = b.goal WHERE f.cost > 0", extra=_TRIE_MARKS | _FOUND)
ORACLE["request_decode"] = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 3 THEN 1 END AS start_id, CASE WHEN event_id % 5 IN (0, 2) THEN event_id END AS goal_id,
  CASE WHEN event_id % 5 = 1 THEN user_id END AS start_x, CASE WHEN event_id % 5 = 1 THEN 2 END AS start_y, CASE WHEN event_id % 5 = 1 THEN 1 END AS start_plane, CASE WHEN event_id % 5 = 1 THEN 3 END AS goal_x, CASE WHEN event_id % 5 = 1 THEN event_id END AS goal_y, CASE WHEN event_id % 5 = 1 THEN 0 END AS goal_plane,
  CASE WHEN event_id % 5 = 0 THEN event_id % 3 ELSE 0 END AS seed, CASE WHEN event_id % 5 = 1 THEN 'coins=' || event_id % 9 ELSE '' END AS requirements, event_id % 5 = 1 AS return_geometry, event_id % 5 = 2 AS surge, CASE WHEN event_id % 5 = 2 THEN 1 ELSE 2 END AS surge_charges, event_id % 5 = 2 AND event_id % 2 = 0 AS dive,
  CASE event_id % 5 WHEN 3 THEN 'no_goal' WHEN 4 THEN 'no_request' END AS problem FROM events"""
ORACLE["full_answers"] = sql("""SELECT c.query_id, c.status = 'found' AS found, coalesce(c.cost_ms, 0) AS cost, CASE WHEN c.query_id % 3 <> 0 THEN n.n END AS n_path, coalesce(n.n, 0) AS length_tiles, NULL AS reason, n.n - 1 AS n_actions, CASE WHEN c.query_id % 2 = 0 THEN n.n END AS n_geometry, CASE WHEN c.query_id % 2 = 0 THEN n.x END AS last_x
  FROM (""" + _COSTS + """) c LEFT JOIN (SELECT w.query_id, count(*) AS n, max_by(o.x, w.pos) AS x FROM way w JOIN nodes o ON o.id = w.node GROUP BY 1) n ON n.query_id = c.query_id""", extra=_FOUND, last=[_BACK, _WAY])
_ROW = """'{"kind":"' || {t}.kind || '","id":' || {t}.id || ',"cost":' || {t}.cost || CASE WHEN {t}.next_kind IS NULL THEN '' ELSE ',"next_kind":"' || {t}.next_kind || '"' END || CASE WHEN {t}.next_id IS NULL THEN '' ELSE ',"next_id":' || {t}.next_id END || '}'"""
ORACLE["step_metadata"] = sql(f"SELECT s.kind, s.id, {_ROW.replace('{t}', 's')} AS row, CASE WHEN o.id IS NOT NULL THEN {_ROW.replace('{t}', 'o')} END AS next_row FROM steps s LEFT JOIN steps o ON o.kind = s.next_kind AND o.id = s.next_id")
ORACLE["profile_words"] = sql("SELECT profile_id, string_agg(word || ':' || lower(hex(bits)), ',' ORDER BY word) AS words FROM (SELECT profile_id, req_id // 64 AS word, bit_or(1::UBIGINT << (req_id % 64)::INT) AS bits FROM met WHERE ok GROUP BY ALL) GROUP BY profile_id")
ORACLE["cheap_adjacent_macros"] = sql("SELECT m.kind, m.id, m.src, m.dst, m.cost, m.backward FROM macros m JOIN nodes a ON a.id = m.src JOIN nodes b ON b.id = m.dst WHERE a.plane = b.plane AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND m.cost < 278045700")
ORACLE["nodes_with_macros"] = sql("SELECT DISTINCT src AS id FROM macros")
_POINTS = "SELECT c_custkey % 7 AS f, c_custkey AS t, k, CASE k WHEN 0 THEN 256 + c_custkey % 256 ELSE -1 END AS x, CASE k WHEN 0 THEN 2 ELSE 256 END AS y, CASE k WHEN 0 THEN 1 ELSE 0 END AS p, c_custkey % 5 <> 0 AS held FROM customer, (VALUES (0), (1)) v(k) WHERE k = 0 OR c_custkey % 5 <> 0"
ORACLE["path_csv"] = f"SELECT f AS entrance_from, t AS entrance_to, CASE WHEN held THEN k END AS pos, CASE WHEN held THEN concat_ws(',', f, t, x, y, p) ELSE f || ',' || t || ',,,' END AS line FROM ({_POINTS})"
ORACLE["path_json"] = f"""SELECT f AS entrance_from, t AS entrance_to, '{{"entrance_from":' || f || ',"entrance_to":' || t || ',"points":[' || coalesce(string_agg('{{"x":' || x || ',"y":' || y || ',"plane":' || p || '}}', ',' ORDER BY k) FILTER (held), '') || ']}}' AS text FROM ({_POINTS}) GROUP BY f, t"""
ORACLE["path_coordinates"] = f"SELECT f AS entrance_from, t AS entrance_to, 'Coordinate[] path_from_' || f || '_to_' || t || ' = {{' || chr(10) || coalesce(string_agg('    new Coordinate(' || x || ', ' || y || ', ' || p || ')', ',' || chr(10) ORDER BY k) FILTER (held) || chr(10), '') || '}};' AS text FROM ({_POINTS}) GROUP BY f, t"
_REPLAY = """golden AS (SELECT o_orderkey AS k, o_orderkey % 10 <> 0 AS found, o_totalprice AS cost FROM orders),
  runs AS (SELECT o_orderkey AS k, run, o_orderkey % 3 AS seed, o_orderkey % 11 <> 0 AS found, o_totalprice + CASE WHEN run = 'two' AND o_orderkey % 13 = 0 THEN 1.5::DOUBLE ELSE 0::DOUBLE END + CASE WHEN o_orderkey % 3 > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS cost, o_orderkey % 520 AS pops FROM orders, (VALUES ('one'), ('two')) v(run)),
  wrong AS (SELECT r.k, r.run, unnest([CASE WHEN r.found <> g.found THEN 'found' END, CASE WHEN r.pops > 500 THEN 'pops' END, CASE WHEN r.found AND g.found AND (r.cost < g.cost - CASE WHEN seed > 0 THEN 0.001 ELSE 1e-4 * greatest(g.cost, 1) END OR r.cost > g.cost + CASE WHEN seed > 0 THEN 2.001 ELSE 1e-4 * greatest(g.cost, 1) END) THEN 'cost' END]) AS problem FROM runs r JOIN golden g ON g.k = r.k)"""
ORACLE["replay_failures"] = f"WITH {_REPLAY} SELECT k::VARCHAR AS name, run, problem FROM wrong WHERE problem IS NOT NULL"
ORACLE["replay_summary"] = f"WITH {_REPLAY} SELECT r.run, count(*) AS n, count(w.k) AS failures, max(r.pops)::INT AS most_pops FROM runs r LEFT JOIN (SELECT DISTINCT k, run FROM wrong WHERE problem IS NOT NULL) w ON w.k = r.k AND w.run = r.run GROUP BY r.run"
ORACLE["replay_disagreements"] = f"WITH {_REPLAY} SELECT k::VARCHAR AS name, seed FROM runs WHERE found GROUP BY k, seed HAVING count(*) > 1 AND max(cost) - min(cost) > 1e-3 * greatest(min(cost), 1)"
ORACLE["payload_differences"] = "SELECT c_custkey AS name, CASE c_custkey % 10 WHEN 3 THEN NULL WHEN 4 THEN 'reason' ELSE 'cost' END AS field, CASE c_custkey % 10 WHEN 1 THEN 'missing' WHEN 2 THEN 'differs' WHEN 3 THEN 'no_answer' ELSE 'added' END AS problem FROM customer WHERE c_custkey % 10 BETWEEN 1 AND 4"
_LCG = """lcg(k, state) AS (SELECT 0, (11400714819323198485::UHUGEINT * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 UNION ALL SELECT k + 1, (state * 6364136223846793005 + 1442695040888963407) % 18446744073709551616 FROM lcg WHERE k < 4095)"""
ORACLE["sample_ids"] = sql("SELECT ((state // 8589934592) % n.n)::BIGINT AS id, min(k)::INT AS draw FROM lcg, (SELECT count(*) AS n FROM nodes) n GROUP BY 1", extra={"lcg": _LCG})
ORACLE["sampled_every"] = sql("SELECT id, key FROM nodes WHERE id % 64 = 0 ORDER BY id LIMIT 100")
ORACLE["reachable_pairs"] = sql("""SELECT bucket, a, b FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY a, b) AS k FROM (
  SELECT a.id AS a, b.id AS b, CASE WHEN d BETWEEN 5 AND 40 THEN 'near' WHEN d BETWEEN 50 AND 200 THEN 'short' WHEN d BETWEEN 500 AND 1500 THEN 'medium' WHEN d >= 2500 THEN 'long' END AS bucket FROM (SELECT a.id, b.id AS other, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d FROM picked a JOIN picked b ON b.id > a.id AND a.component = b.component) p JOIN picked a ON a.id = p.id JOIN picked b ON b.id = p.other) WHERE bucket IS NOT NULL) WHERE k <= 4""", extra={"lcg": _LCG}, last=["picked AS MATERIALIZED (SELECT o.id, o.x, o.y, l.component FROM nodes o JOIN labels l ON l.node = o.id WHERE o.plane = 0 AND o.id IN (SELECT ((state // 8589934592) % n.n)::BIGINT FROM lcg, (SELECT count(*) AS n FROM nodes) n WHERE k < 300))"])
