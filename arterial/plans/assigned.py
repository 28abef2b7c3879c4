"""Queries of the assignment of several classes, fixed routes, centroids and counts, with their SQL.

They are registered in :data:`catalog.QUERIES` and :data:`catalog.ORACLES` like the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, classes, correction, demand, queues, scenario
from ..session import settle
from . import star
from .catalog import C, free_paths, query, r6, timed

#: Fixed values of the queries: a truck type with tolls, half-empty household cars, and the shares of two periods.
TYPES = [classes.AgentType("automobile"), classes.AgentType("building", vot=20.0), classes.AgentType("furniture"), classes.AgentType("household", occ=1.5), classes.AgentType("machinery", vot=20.0, pce=2.0)]
SHARES = [("am", 0.6), ("pm", 0.4)]
_TYPE = "ty(t, vot, pce, occ) AS (VALUES ('automobile', 10.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('building', 20.0, 1.0, 1.0), ('furniture', 10.0, 1.0, 1.0), ('household', 10.0, 1.0, 1.5), ('machinery', 20.0, 2.0, 1.0)), per(p, share) AS (VALUES ('am', 0.6::DOUBLE), ('pm', 0.4::DOUBLE))"


def _labels(name: str, links: str, starts: str, keys: str = "") -> str:
    """A recursive table of least costs and their links from every start, for each value of ``keys``."""
    own = "".join(f"l.{k}, " for k in keys.split())
    same = "".join(f" AND e.{k} = l.{k}" for k in keys.split())
    again = "".join(f" AND r.{k} = l.{k}" for k in keys.split())
    listed = "".join(f"{k}, " for k in keys.split())
    return f"""{name}({listed}o, node, cost, links) USING KEY ({listed}o, node) AS (SELECT {listed}o, o, 0.0::DOUBLE, []::INTEGER[] FROM {starts}
UNION SELECT {own}l.o, e.to_node_id, min(l.cost + e.c), arg_min(list_append(l.links, e.link_id), l.cost + e.c) FROM {name} l JOIN {links} e ON e.from_node_id = l.node{same}
LEFT JOIN recurring.{name} r ON r.o = l.o AND r.node = e.to_node_id{again} WHERE r.cost IS NULL OR l.cost + e.c < r.cost GROUP BY {own}l.o, e.to_node_id)"""


def period_links(spark, sf, periods=("am", "pm")):
    out = star.costed_links(spark, sf).drop("cost").withColumn("demand_period", F.explode(F.array(*[F.lit(p) for p in periods])))
    return out.drop("cost")


def period_tolls(spark, sf):
    """Trucks pay on every seventh link in the morning."""
    net = star.links(spark, sf).where("link_id % 7 = 0")
    return net.select(F.lit("am").alias("demand_period"), "link_id", F.lit("machinery").alias("agent_type"), (C("link_id") % 5).cast("double").alias("toll"))


_COSTS = """ecost AS (SELECT p, t, link_id, from_node_id, to_node_id, fftt + link_id * 1e-9::DOUBLE + CASE WHEN p = 'am' AND t = 'machinery' AND link_id % 7 = 0 THEN (link_id % 5) / vot * 60.0 ELSE 0.0 END AS c FROM clink, ty, per WHERE allowed_uses = '' OR t IN ('building', 'machinery')),
begin_ AS (SELECT p, t, node_id AS o FROM net_node, ty, per)"""


@query("""SELECT p AS demand_period, link_id, round(sum(v * pce), 4) AS volume, round(sum(v * occ), 4) AS persons FROM (
SELECT b.p, b.t, d.volume * share AS v, unnest(b.links) AS link_id FROM od d JOIN per ON true JOIN class_lab b ON b.p = per.p AND b.t = d.agent_type AND b.o = d.o_zone_id AND b.node = d.d_zone_id) JOIN ty USING (t) GROUP BY p, link_id""",
"od", "clink", "net_node", more=f"{_TYPE},\n{_COSTS},\n{_labels('class_lab', 'ecost', 'begin_', 'p t')}")
def as_class_loads(spark, sf):
    """GR-01, 08, FN-07, 08, SRC-13: one all-or-nothing step of five types in two periods: links closed to three types, tolls for one, loads in passenger cars and persons."""
    shares = spark.createDataFrame(SHARES, "demand_period string, share double")
    od = demand.by_period(star.od_demand(spark, sf), shares)
    columns, _ = classes.assign(period_links(spark, sf), od, TYPES, 1, timed, period_tolls(spark, sf))
    return classes.loads(columns, TYPES).select("demand_period", "link_id", F.round("volume", 4).alias("volume"), F.round("persons", 4).alias("persons"))


_FIX = f"""fix AS (SELECT o_zone_id, d_zone_id, agent_type, volume / 2 AS v, [link_id] AS links, link_id FROM od JOIN clink ON from_node_id = o_zone_id AND to_node_id = d_zone_id),
begin1 AS (SELECT node_id AS o FROM net_node),
e0 AS (SELECT link_id, from_node_id, to_node_id, fftt + link_id * 1e-9::DOUBLE AS c FROM clink),
e1 AS (SELECT c.link_id, from_node_id, to_node_id, fftt * free_speed / greatest(0.1, free_speed / (1 + 0.15::DOUBLE * (coalesce(v, 0.0) / period_cap) ** 4)) + c.link_id * 1e-9::DOUBLE AS c FROM clink c LEFT JOIN (SELECT link_id, sum(v) AS v FROM fix GROUP BY link_id) f USING (link_id)),
{_labels('lab0', 'e0', 'begin1')},
{_labels('lab1', 'e1', 'begin1')}"""


@query("""SELECT o_zone_id, d_zone_id, agent_type, state, array_to_string(links, ';') AS links, round(sum(v), 6) AS volume FROM (
SELECT o_zone_id, d_zone_id, agent_type, 'fixed' AS state, links, v FROM fix UNION ALL
SELECT o_zone_id, d_zone_id, agent_type, 'generated', l.links, volume / 4 FROM od JOIN lab0 l ON l.o = o_zone_id AND l.node = d_zone_id UNION ALL
SELECT o_zone_id, d_zone_id, agent_type, 'generated', l.links, volume / 4 FROM od JOIN lab1 l ON l.o = o_zone_id AND l.node = d_zone_id) GROUP BY ALL""",
"od", "clink", "net_node", more=_FIX)
def as_fixed_routes(spark, sf):
    """SRC-17, GR-09, FN-25: half of all demand is assigned in two iterations; between neighbours the other half keeps a given route, whose load the second iteration sees."""
    od = star.od_demand(spark, sf).withColumns({"demand_period": F.lit("am"), "volume": C("volume") / 2})
    near = star.links(spark, sf).select(C("from_node_id").alias("o_zone_id"), C("to_node_id").alias("d_zone_id"))
    routes = od.join(near, ["o_zone_id", "d_zone_id"]).withColumn("nodes", F.array("o_zone_id", "d_zone_id"))
    net = period_links(spark, sf, ("am",)).withColumn("allowed_uses", F.lit(""))
    pool, _ = classes.fixed_columns(routes, net)
    types = [classes.AgentType(t.name) for t in TYPES]
    columns, _ = classes.assign(net, od, types, 2, timed, fixed=pool)
    return columns.select("o_zone_id", "d_zone_id", "agent_type", "state", F.array_join("links", ";").alias("links"), r6("volume").alias("volume"))


@query("""SELECT o_zone_id, d_zone_id, round(cost + 0.0002::DOUBLE, 6) AS cost, array_to_string(links, ';') AS links, round(v, 6) AS volume FROM (
SELECT a.district_id + 1 AS o_zone_id, b.district_id + 1 AS d_zone_id, sum(volume) AS v FROM od JOIN net_node a ON a.zone_id = o_zone_id JOIN net_node b ON b.zone_id = d_zone_id WHERE a.district_id <> b.district_id GROUP BY ALL) JOIN (
SELECT a.district_id + 1 AS o_zone_id, b.district_id + 1 AS d_zone_id, min(l.cost) AS cost, arg_min(l.links, l.cost) AS links FROM lab0 l JOIN net_node a ON a.node_id = l.o JOIN net_node b ON b.node_id = l.node WHERE a.district_id <> b.district_id GROUP BY ALL) USING (o_zone_id, d_zone_id)""",
"od", "clink", "net_node", more=_FIX)
def as_connectors(spark, sf):
    """GR-21, FLT-09, SRC-12: districts are zones with an access node in each of their nations; trips enter and leave where the whole way is cheapest, and columns have no connectors."""
    n = star.nodes(spark, sf)
    zone = lambda end: n.select(C("zone_id").alias(end), (C("district_id") + 1).alias(f"_{end}"))
    od = star.od_demand(spark, sf).join(zone("o_zone_id"), "o_zone_id").join(zone("d_zone_id"), "d_zone_id").where("_o_zone_id <> _d_zone_id")
    od = od.groupBy(C("_o_zone_id").alias("o_zone_id"), C("_d_zone_id").alias("d_zone_id")).agg(F.sum("volume").alias("volume")).withColumns({"demand_period": F.lit("am"), "agent_type": F.lit("all")})
    net = classes.connected(period_links(spark, sf, ("am",)).withColumn("allowed_uses", F.lit("")), n.select((C("district_id") + 1).alias("zone_id"), "node_id"))
    types = [classes.AgentType("all")]
    idle = timed(net.withColumns({"volume": F.lit(0.0), "persons": F.lit(0.0)}))
    best = classes.best_routes(classes.costed(idle, types), od, types, centroids=True)
    return od.join(best, classes.CELL).select("o_zone_id", "d_zone_id", r6("cost").alias("cost"), F.array_join("links", ";").alias("links"), r6("volume").alias("volume"))


_DEV = "coalesce((SELECT sum(d) FROM {dev} WHERE list_contains(p.links, {dev}.link_id)), 0.0)"
_NEXT = "CASE WHEN g = 0 THEN v ELSE greatest(1.0, v - greatest(-v * 0.1::DOUBLE, least(v * 0.1::DOUBLE, g * 0.05::DOUBLE))) END"


def _off(i: int) -> str:
    return f"dev{i} AS (SELECT link_id, coalesce(sum(v), 0.0) - obs AS d FROM cnt LEFT JOIN (SELECT v, unnest(links) AS link_id FROM step{i} p) USING (link_id) GROUP BY link_id, obs, ub HAVING ub = 0 OR coalesce(sum(v), 0.0) > obs)"


_STEPS = f"""cnt AS (SELECT link_id, obs_count * 100.0::DOUBLE AS obs, upper_bound_flag AS ub FROM obs WHERE demand_period = 'am' AND obs_count * 100.0 >= 1),
step0 AS (SELECT o_zone_id, d_zone_id, agent_type, links, volume AS v FROM path),
{_off(0)},
step1 AS (SELECT o_zone_id, d_zone_id, agent_type, links, {_NEXT} AS v FROM (SELECT p.*, {_DEV.format(dev='dev0')} AS g FROM step0 p)),
{_off(1)},
step2 AS (SELECT o_zone_id, d_zone_id, agent_type, links, {_NEXT} AS v FROM (SELECT p.*, {_DEV.format(dev='dev1')} AS g FROM step1 p))"""


@query("SELECT o_zone_id, d_zone_id, agent_type, round(v, 6) AS volume FROM step2", "path", "obs", more=_STEPS)
def od_correction(spark, sf):
    """OD-01..03, 06: two correction steps against the morning's counts, times a hundred, by the columns' counted links."""
    p = free_paths(spark, sf).select("o_zone_id", "d_zone_id", "agent_type", "links", "volume").withColumns({"demand_period": F.lit("am"), "state": F.lit(classes.GENERATED)})
    counts = star.link_observations(spark, sf).where("demand_period = 'am'").withColumn("obs_count", C("obs_count") * 100.0)
    types = [classes.AgentType(t.name) for t in TYPES]
    out, _ = correction.correct_columns(p, period_links(spark, sf, ("am",)), counts, types, 2)
    return out.select("o_zone_id", "d_zone_id", "agent_type", r6("volume").alias("volume"))


_U = "('0x' || substr(md5(link_id || ';' || minute || ';101'), 1, 10))::BIGINT / 1099511627776.0::DOUBLE"
_QUEUE = f"""per_min AS (SELECT link_id, minute, lane_capacity * lanes / 60.0 AS c FROM clink, range(1440) r(minute)),
cap AS (SELECT link_id, minute, (floor(c) + CASE WHEN {_U} < c - floor(c) THEN 1 ELSE 0 END) * CASE WHEN link_id % 10 = 0 AND minute >= 480 AND minute < 540 THEN 0.02::DOUBLE ELSE 1.0::DOUBLE END AS c FROM per_min),
step AS (SELECT *, sum(c) OVER (PARTITION BY link_id ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, coalesce(sum(c) OVER (PARTITION BY link_id ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS b FROM cap),
arr AS (SELECT event_id, t.link_id, (t.t_in % 1440)::DOUBLE AS r, s.b AS u FROM trip t JOIN step s ON s.link_id = t.link_id AND s.minute = t.t_in % 1440),
num AS (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY u, event_id) - 1 AS i FROM arr),
dep AS (SELECT *, i + max(u - i) OVER (PARTITION BY link_id ORDER BY u, event_id) AS d FROM num)"""


@query("""SELECT event_id, dep.link_id, round(minute + (d - b) / c, 4) AS depart FROM dep JOIN step ON step.link_id = dep.link_id AND c > 0 AND d >= b AND (d < e OR minute = 1439)""", "trip", "clink", more=_QUEUE)
def sim_incident_queue(spark, sf):
    """SIM-02, 06, SC-08: every event's vehicle queues on its link under a random capacity by minute, which incidents on every tenth link cut to a fiftieth from eight to nine."""
    net = star.links(spark, sf)
    drawn = queues.stochastic_capacity(net, 1440, an_hour=60)
    hit = (C("link_id") % 10 == 0) & (C("step") >= 480) & (C("step") < 540)
    capacity = drawn.select("link_id", C("step").alias("minute"), (C("capacity") * F.when(hit, 0.02).otherwise(1.0)).alias("capacity"))
    rows = star.trip_events(spark, sf).select("event_id", "link_id", (C("t_in") % 1440).cast("double").alias("ready"))
    return queues.varying_link(rows, capacity, "link_id", "event_id", "ready").select("event_id", "link_id", F.round("depart", 4).alias("depart"))


@query("SELECT o AS origin, node, round(cost, 6) AS cost, coalesce(list_last(links), -1) AS pred_link FROM lab", "lab")
def gr_cells(spark, sf):
    """GR-02, 18: the labels of all nodes by cells, one for each column of the grid, as on a network too large to broadcast."""
    n = star.nodes(spark, sf)
    tree = cells.labels(star.costed_links(spark, sf), n.select(C("node_id").alias("origin")), n.select("node_id", (C("node_id") % 5).alias("cell")))
    return tree.select("origin", "node", r6("cost").alias("cost"), F.coalesce("pred_link", F.lit(-1)).alias("pred_link"))


_SIGNS = f"""begin1 AS (SELECT node_id AS o FROM net_node),
e0 AS (SELECT link_id, from_node_id, to_node_id, fftt + link_id * 1e-9::DOUBLE AS c FROM clink),
e2 AS (SELECT link_id, from_node_id, to_node_id, CASE WHEN link_id % 10 = 0 THEN 1440.0::DOUBLE ELSE fftt END + link_id * 1e-9::DOUBLE AS c FROM clink),
{_labels('lab0', 'e0', 'begin1')},
{_labels('lab2', 'e2', 'begin1')},
col AS (SELECT o_zone_id, d_zone_id, agent_type, volume, l.links, list_min(list_filter(range(1, len(l.links) + 1), lambda i: l.links[i] % 8 = 1)) AS pos, len(list_filter(l.links, lambda x: x % 10 = 0)) > 0 AS hit FROM od JOIN lab0 l ON l.o = o_zone_id AND l.node = d_zone_id),
way AS (SELECT DISTINCT o AS z, node AS d, links FROM (SELECT o, node, links FROM lab0 UNION ALL SELECT o, node, links FROM lab2) WHERE o <> node),
cost_ AS (SELECT z, d, w.links, sum(c) AS cost, max((link_id % 10 = 0)::INTEGER) AS hit FROM (SELECT z, d, links, unnest(links) AS link_id FROM way) w JOIN e2 USING (link_id) GROUP BY z, d, w.links),
offer AS (SELECT z, d, min(cost) FILTER (WHERE hit = 1) AS ref, min(cost) FILTER (WHERE hit = 0) AS best, arg_min(links, cost) FILTER (WHERE hit = 0) AS more FROM cost_ GROUP BY z, d),
led AS (SELECT col.*, ref, best, more, 1 / (1 + exp(-0.1::DOUBLE * (ref - best))) AS share FROM col JOIN clink ON link_id = links[pos] JOIN offer ON z = to_node_id AND d = d_zone_id WHERE agent_type = 'building' AND hit AND ref - best > 3 AND ref - best > 0.15::DOUBLE * ref)"""


@query("""SELECT o_zone_id, d_zone_id, agent_type, state, array_to_string(links, ';') AS links, round(sum(v), 6) AS volume FROM (
SELECT o_zone_id, d_zone_id, agent_type, 'generated' AS state, links, volume AS v FROM col WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.o_zone_id = col.o_zone_id AND led.d_zone_id = col.d_zone_id AND led.agent_type = col.agent_type) UNION ALL
SELECT o_zone_id, d_zone_id, agent_type, 'generated', links, volume * (1 - share) FROM led UNION ALL
SELECT o_zone_id, d_zone_id, agent_type, 'spliced', list_concat(links[1 : pos], more), volume * share FROM led) GROUP BY ALL""", "od", "clink", "net_node", more=_SIGNS)
def sc_signs(spark, sf):
    """SC-05, GR-16, 17, JN-18: every tenth link is closed; drivers of one type who pass a sign, on every eighth link, before a closed one are offered the best way on that is open, and split by logit."""
    net = settle(period_links(spark, sf, ("am",)).withColumn("allowed_uses", F.lit("")))
    od = star.od_demand(spark, sf).withColumn("demand_period", F.lit("am"))
    types = [classes.AgentType(t.name) for t in TYPES]
    free = lambda df: df.withColumn("minutes", C("fftt"))
    columns, _ = classes.assign(net, od, types, 1, free)
    closed = net.where("link_id % 10 = 0").select("from_node_id", "to_node_id", F.lit(0.0).alias("lanes"))
    now, before = settle(classes.costed(free(scenario.lane_changes(net, closed)), types)), settle(classes.costed(free(net), types))
    signs = net.where("link_id % 8 = 1").select("link_id", C("to_node_id").alias("node_id"), C("to_node_id").alias("zone_id"))
    told = spark.createDataFrame([("building",)], "agent_type string")
    out = scenario.spliced(columns, now, before, types, told, signs, None, False)
    return out.select("o_zone_id", "d_zone_id", "agent_type", "state", F.array_join("links", ";").alias("links"), r6("volume").alias("volume"))
