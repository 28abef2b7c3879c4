"""DuckDB SQL of the derived network and demand; the counterpart of :mod:`arterial.plans.star`."""

from __future__ import annotations

from .star import PERIODS, TOTAL_TRIPS

NODE = """net_node AS (SELECT n_nationkey + 1 AS node_id, n_nationkey + 1 AS zone_id, n_regionkey AS district_id,
  -112.0::DOUBLE + 0.02::DOUBLE * (n_nationkey % 5) AS x_coord, 33.40::DOUBLE + 0.02::DOUBLE * (n_nationkey // 5) AS y_coord FROM nation)"""

LINK = """net_ends AS (SELECT n_nationkey % 5 AS cx, n_nationkey // 5 AS cy FROM nation),
net_pair AS (SELECT cy * 5 + cx + 1 AS from_node_id, (cy + dy) * 5 + cx + dx + 1 AS to_node_id FROM net_ends, (VALUES (0, -1), (-1, 0), (1, 0), (0, 1)) s(dx, dy)
  WHERE cx + dx BETWEEN 0 AND 4 AND cy + dy BETWEEN 0 AND 4),
net_num AS (SELECT *, (row_number() OVER (ORDER BY from_node_id, to_node_id))::INTEGER AS link_id FROM net_pair),
net_link AS (SELECT link_id, from_node_id, to_node_id, 1609.0::DOUBLE * (1 + (7 * link_id) % 5) AS length_m, (1 + link_id % 3)::DOUBLE AS lanes,
  (30 + 10 * (link_id % 4))::DOUBLE AS free_speed, (900 + 150 * (link_id % 5))::DOUBLE AS lane_capacity, 1 + link_id % 3 AS link_type,
  CASE WHEN link_id % 11 = 0 THEN 'building;machinery' ELSE '' END AS allowed_uses FROM net_num),
clink AS (SELECT *, length_m / 1609.0::DOUBLE / free_speed * 60.0::DOUBLE AS fftt, free_speed * 0.85::DOUBLE AS cutoff, lane_capacity * lanes * 4.0::DOUBLE AS period_cap,
  length_m / 1609.0::DOUBLE / free_speed * 60.0::DOUBLE + link_id * 1e-6::DOUBLE AS cost FROM net_link)"""

OD = f"""od_raw AS (SELECT c_nationkey + 1 AS o_zone_id, s_nationkey + 1 AS d_zone_id, lower(c_mktsegment) AS agent_type, sum(l_quantity) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY ALL),
od AS (SELECT o_zone_id, d_zone_id, agent_type, q * {TOTAL_TRIPS}::DOUBLE / (SELECT sum(q) FROM od_raw) AS volume FROM od_raw)"""

LABEL = """lab(o, node, cost, links) USING KEY (o, node) AS (
  SELECT node_id, node_id, 0.0::DOUBLE, []::INTEGER[] FROM net_node
  UNION
  SELECT l.o, e.to_node_id, min(l.cost + e.cost), arg_min(list_append(l.links, e.link_id), l.cost + e.cost)
  FROM lab l JOIN clink e ON e.from_node_id = l.node LEFT JOIN recurring.lab r ON r.o = l.o AND r.node = e.to_node_id
  WHERE r.cost IS NULL OR l.cost + e.cost < r.cost GROUP BY l.o, e.to_node_id)"""

PATH = """path AS (SELECT d.o_zone_id, d.d_zone_id, d.agent_type, d.volume, f.links, f.cost AS path_cost FROM od d JOIN lab f ON f.o = d.o_zone_id AND f.node = d.d_zone_id)"""

LOAD = """load AS (SELECT l.link_id, coalesce(sum(p.volume), 0.0) AS volume FROM clink l LEFT JOIN (SELECT volume, unnest(links) AS link_id FROM path) p USING (link_id) GROUP BY l.link_id)"""

_H = "extract(hour FROM ts) * 60 + extract(minute FROM ts)"
EVENT = f"""ev AS (SELECT event_id, user_id, (user_id % 80 + 1)::INTEGER AS link_id, ts, ({_H})::BIGINT AS minute, datediff('day', DATE '2024-01-01', ts::DATE) AS day FROM events)"""
OBS = f"""obs AS (SELECT link_id, demand_period, count(*)::DOUBLE AS obs_count, (link_id % 7 = 0)::INTEGER AS upper_bound_flag FROM (
  SELECT link_id, CASE {' '.join(f"WHEN minute >= {a * 60} AND minute < {b * 60} THEN '{n}'" for n, a, b, _ in PERIODS)} END AS demand_period FROM ev) WHERE demand_period IS NOT NULL GROUP BY ALL)"""
TRIP = """trip AS (SELECT user_id AS agent_id, event_id, (event_id % 80 + 1)::INTEGER AS link_id, t AS t_in, least(coalesce(lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id), t + 5), t + 5) AS t_out FROM (SELECT *, day * 1440 + minute AS t FROM ev))"""

#: The volume-delay algebra over ``load``: the same formulas as :mod:`arterial.functions.vdf`.
VDF = """v0 AS (SELECT c.*, l.volume, greatest(0.0, l.volume) * 1.0::DOUBLE / greatest(1e-6, lanes) AS demand FROM clink c JOIN load l USING (link_id)),
v1 AS (SELECT *, demand / greatest(1e-5, lane_capacity) AS doc, volume / greatest(1e-5, period_cap) AS voc FROM v0),
v2 AS (SELECT *, CASE WHEN doc < 1 THEN free_speed / (1 + ((1 + 0.272876961::DOUBLE) * free_speed / cutoff - 1) * doc ** 4) ELSE cutoff / (1 + 0.272876961::DOUBLE * doc ** 4) END AS queue_speed,
  CASE WHEN doc < 1 THEN 1 / free_speed ELSE 1 / cutoff END AS rtt, CASE WHEN doc < 1 THEN 4.0::DOUBLE ELSE 1.141574427::DOUBLE END AS exponent, free_speed / (1 + 0.15::DOUBLE * voc ** 4) AS bpr_speed FROM v1),
v3 AS (SELECT *, fftt * free_speed / greatest(0.1, bpr_speed) AS minutes FROM v2),
vdf AS (SELECT *, minutes - fftt AS wait FROM v3),
s1 AS (SELECT *, 0.954946463::DOUBLE * doc ** exponent AS p FROM vdf),
s2 AS (SELECT *, cutoff / greatest(0.001, 0.400089684::DOUBLE * p ** 4 + 1) AS vt2, 8.0 - p / 2 AS t0, 8.0 + p / 2 AS t3, CASE WHEN p > 0 THEN least(lane_capacity, demand / p) END AS mu FROM s1),
shape AS (SELECT *, CASE WHEN p > 0 THEN (1 / vt2 - rtt) * 64 * mu / p ** 4 END AS gamma FROM s2),
perf AS (SELECT *, volume * length_m / 1609.0::DOUBLE AS vmt, volume * minutes / 60.0::DOUBLE AS vht, CASE WHEN minutes > 0.001 THEN free_speed / greatest(1e-6, minutes) * fftt ELSE free_speed END AS speed FROM shape)"""

PARTS = [("net_node", NODE), ("clink", LINK), ("od", OD), ("lab", LABEL), ("path", PATH), ("load", LOAD), ("ev", EVENT), ("obs", OBS), ("trip", TRIP), ("vdf", VDF)]
#: What each part is built on.
NEEDS = {"net_node": (), "clink": (), "od": (), "lab": ("net_node", "clink"), "path": ("od", "lab"), "load": ("path", "clink"), "ev": (), "obs": ("ev",), "trip": ("ev",), "vdf": ("load",)}


def sql(select: str, *parts: str, more: str = "") -> str:
    """``select`` with the named parts, and all they need, as common table expressions; ``more`` adds further ones."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        wanted.add(name)
        for n in NEEDS[name]:
            add(n)

    for p in parts:
        add(p)
    ctes = [text for name, text in PARTS if name in wanted] + ([more] if more else [])
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" if ctes else "") + select
