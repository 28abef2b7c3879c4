"""More queries over the derived network: runs, scenarios, sinks, zones and traces, with their SQL.

They are registered in :data:`catalog.QUERIES` and :data:`catalog.ORACLES` like the others.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, assign, demand, paths, reports, run, scenario
from ..sources import sinks
from . import star
from .catalog import _HAV, _PROFILE, _TWO, SUBAREA_SQL, C, KEY, free_paths, loads, morning_profile, query, r6, timed, two_paths



# ---- runs and scenarios

#: The four links of the two-corridor network (link, from, to, miles, minutes, capacity), and its trips for a unit of an order's mean quantity.
CORRIDOR_LINKS = [(1, 1, 3, 10.0, 10.0, 4000.0), (2, 3, 2, 10.0, 10.0, 4000.0), (3, 1, 4, 15.0, 15.0, 3000.0), (4, 4, 2, 15.0, 15.0, 3000.0)]
CORRIDOR_RATE = 70.0


def two_corridors(spark, sf) -> run.Inputs:
    links = spark.createDataFrame(CORRIDOR_LINKS, "link_id int, from_node_id int, to_node_id int, mile double, fftt double, period_cap double")
    links = links.withColumns({"free_speed": F.lit(60.0), "lanes": F.lit(1.0), "lane_capacity": F.col("period_cap"), "cutoff": F.lit(51.0), "link_type": F.lit(1), "demand_period": F.lit("am")})
    lines = star.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    mean = lines.agg((F.sum("q") / F.count("*")).cast("double").alias("q"))
    od = mean.select(F.lit("am").alias("demand_period"), F.lit("p").alias("agent_type"), F.lit(1).alias("o_zone_id"), F.lit(2).alias("d_zone_id"), (C("q") * CORRIDOR_RATE).alias("volume"))
    return run.Inputs(links, od, run.delays(1.0, 7.5))


_CORRIDOR = """trips AS (SELECT 70.0::DOUBLE * sum(l_quantity)::DOUBLE / count(DISTINCT l_orderkey) AS v FROM lineitem),
it(k, a, p, v) AS (SELECT 1, v, v, v FROM trips UNION ALL
SELECT k + 1, a * (k + 1) / (k + 2)::DOUBLE + CASE WHEN 20 * (1 + 0.15::DOUBLE * pow(p / 4000.0::DOUBLE, 4)) <= 30 * (1 + 0.15::DOUBLE * pow((v - p) / 3000.0::DOUBLE, 4)) THEN v / (k + 2) ELSE 0.0 END, a, v FROM it WHERE k < 19)"""


@query("SELECT link_id, round(CASE WHEN link_id <= 2 THEN a ELSE v - a END, 4) AS volume FROM it, (VALUES (1), (2), (3), (4)) l(link_id) WHERE k = 19", more=_CORRIDOR)
def run_two_corridor(spark, sf):
    """GR-08, 09, SNK-01: the whole run over the two-corridor network, twenty iterations; the demand follows from the orders' mean quantity."""
    return run.solve(two_corridors(spark, sf), 20).performance.select("link_id", F.round("volume", 4).alias("volume"))


_AFTER = "after_(link_id, from_node_id, to_node_id, minutes) AS (SELECT link_id, from_node_id, to_node_id, CASE WHEN link_id % 10 = 0 THEN fftt * free_speed / greatest(0.1, free_speed / (1 + 0.15::DOUBLE * (volume / (period_cap * 1.0::DOUBLE / lanes)) ** 4)) ELSE minutes END FROM vdf)"
_SC = _AFTER + """,
sc(o, node, cost, links) USING KEY (o, node) AS (SELECT node_id, node_id, 0.0::DOUBLE, []::INTEGER[] FROM net_node
UNION SELECT l.o, e.to_node_id, min(l.cost + e.minutes + e.link_id * 1e-9::DOUBLE), arg_min(list_append(l.links, e.link_id), l.cost + e.minutes + e.link_id * 1e-9::DOUBLE)
FROM sc l JOIN after_ e ON e.from_node_id = l.node LEFT JOIN recurring.sc r ON r.o = l.o AND r.node = e.to_node_id WHERE r.cost IS NULL OR l.cost + e.minutes + e.link_id * 1e-9::DOUBLE < r.cost GROUP BY l.o, e.to_node_id)"""


@query("""SELECT link_id, round(coalesce(sum(v), 0.0), 4) AS volume FROM clink LEFT JOIN (SELECT volume AS v, unnest(CASE WHEN agent_type = 'building' OR agent_type = 'machinery' AND o_zone_id IN (1, 7, 13) THEN s.links ELSE p.links END) AS link_id
FROM path p JOIN sc s ON s.o = p.o_zone_id AND s.node = p.d_zone_id) USING (link_id) GROUP BY link_id""", "vdf", "net_node", more=_SC)
def sc_reassign(spark, sf):
    """SC-04, 07, FN-26: every tenth link is cut to one lane; drivers with real-time information, and those of message signs in three zones, choose anew."""
    base = free_paths(spark, sf)
    changes = star.links(spark, sf).where("link_id % 10 = 0").select("from_node_id", "to_node_id", F.lit(1.0).alias("lanes"))
    changed = scenario.lane_changes(star.costed_links(spark, sf), changes)
    types = spark.createDataFrame([("building", 1), ("machinery", 2)], "agent_type string, real_time_info int")
    zones = spark.createDataFrame([(1,), (7,), (13,)], "zone_id int")
    after, _ = scenario.reassign(changed, base, types, zones, timed, 0)
    return assign.loaded(star.costed_links(spark, sf), assign.link_volumes(after)).select("link_id", F.round("volume", 4).alias("volume"))


@query("SELECT 'sa' AS scenario_type, link_id, lanes AS lanes_before, 1.0::DOUBLE AS lanes_after FROM clink WHERE link_id % 10 = 0", "clink")
def snk_scenario_log(spark, sf):
    """SNK-18."""
    net = star.links(spark, sf)
    return scenario.scenario_log(net, net.where("link_id % 10 = 0").select("from_node_id", "to_node_id", F.lit(1.0).alias("lanes")))


# ---- paths


@query("SELECT path_id, array_to_string(CASE path_id % 4 WHEN 0 THEN links[2 : len(links) - 1] WHEN 3 THEN links ELSE links[1 : len(links) - 1] END, ';') AS links FROM (SELECT o * 100 + node AS path_id, links FROM lab WHERE o <> node)", "lab")
def fn_path_trim(spark, sf):
    """FN-25."""
    best = paths.routes_grouped(star.costed_links(spark, sf), star.nodes(spark, sf).select(C("node_id").alias("origin"))).withColumn("path_id", C("o_zone_id") * 100 + C("d_zone_id"))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("free", "fixed", "info", "activity")]), C("path_id") % 4 + 1)
    return paths.trimmed(best.withColumn("kind", kind), "links", "kind").select("path_id", F.array_join("links", ";").alias("links"))


@query("SELECT o_zone_id, d_zone_id, agent_type, (o_zone_id IN (1, 7, 13))::INTEGER AS info_origin FROM od", "od")
def fn_info_zone(spark, sf):
    """FN-26."""
    return paths.from_info_zone(star.od_demand(spark, sf), spark.createDataFrame([(1,), (7,), (13,)], "zone_id int")).select(*KEY, "info_origin")


@query("SELECT from_node_id, to_node_id, demand_period, obs_count, c.link_id FROM obs o JOIN clink c USING (link_id)", "obs", "clink")
def jn_pair_links(spark, sf):
    """JN-04: counts by pair of nodes, and the link between them."""
    net = star.links(spark, sf)
    seen = star.link_observations(spark, sf).join(net.select("link_id", "from_node_id", "to_node_id"), "link_id").drop("link_id")
    return paths.links_of_pairs(seen, net).select("from_node_id", "to_node_id", "demand_period", "obs_count", "link_id")


@query("SELECT o_zone_id, d_zone_id, agent_type, demand_period, round(volume * share, 6) AS volume FROM od, (VALUES ('am', 0.5::DOUBLE), ('md', 0.2::DOUBLE), ('pm', 0.3::DOUBLE)) p(demand_period, share)", "od")
def jn_od_periods(spark, sf):
    """JN-09."""
    shares = spark.createDataFrame([("am", 0.5), ("md", 0.2), ("pm", 0.3)], "demand_period string, share double")
    return demand.by_period(star.od_demand(spark, sf), shares).select(*KEY, "demand_period", r6("volume").alias("volume"))


@query("SELECT o_zone_id, d_zone_id, agent_type, path_id, (row_number() OVER (PARTITION BY o_zone_id, d_zone_id, agent_type ORDER BY path_cost, path_id) - 1)::INTEGER AS path_no FROM two", "path", more=_TWO)
def win_path_number(spark, sf):
    """WIN-10."""
    return paths.numbered(two_paths(spark, sf)).select(*KEY, "path_id", "path_no")


@query("SELECT lab.o AS origin, node, coalesce(c.from_node_id, -1) AS pred_node, coalesce(list_last(links), -1) AS pred_link, round(lab.cost, 6) AS cost FROM lab LEFT JOIN clink c ON c.link_id = list_last(links)", "lab", "clink")
def snk_path_tree(spark, sf):
    """SNK-13."""
    tree = paths.labels_grouped(star.costed_links(spark, sf), star.nodes(spark, sf).select(C("node_id").alias("origin")))
    return sinks.tree_rows(tree).withColumn("cost", r6("cost"))


# ---- demand


@query("SELECT o_zone_id AS zone_id, round(sum(volume), 6) AS volume, (o_zone_id IN (3, 9))::INTEGER AS info FROM od WHERE o_zone_id % 6 <> 0 GROUP BY o_zone_id HAVING sum(volume) > 1100 OR o_zone_id IN (3, 9)", "od")
def flt_search_origins(spark, sf):
    """FLT-07: origins above 1,100 trips or with information, every sixth zone absorbed."""
    info = spark.createDataFrame([(3,), (9,)], "zone_id int")
    absorbed = star.nodes(spark, sf).where("zone_id % 6 = 0").select("zone_id")
    return demand.search_origins(star.od_demand(spark, sf), info, absorbed, 1100.0).select("zone_id", r6("volume").alias("volume"), "info")


@query("SELECT min(a) AS start_min, max(b) AS end_min, count(*) AS n FROM (VALUES ('am', 360, 600), ('md', 600, 900), ('pm', 900, 1140), ('nt', 1200, 1260)) p(demand_period, a, b) WHERE demand_period IN (SELECT demand_period FROM obs)", "obs")
def agg_loading_window(spark, sf):
    """AGG-23, FLT-08."""
    periods = spark.createDataFrame([(n, a * 60, b * 60) for n, a, b, _ in star.PERIODS] + [("nt", 1200, 1260)], "demand_period string, start_min int, end_min int")
    return demand.loading_window(periods, star.link_observations(spark, sf))


@query("""SELECT row_number() OVER (ORDER BY round(depart_min, 4), o_zone_id, d_zone_id, agent_type, v) AS rank, o_zone_id, d_zone_id, agent_type, v, round(depart_min, 4) AS depart_min FROM (
SELECT o_zone_id, d_zone_id, agent_type, v, slot5 + (v / n::DOUBLE - (cum - ratio)) / ratio * 5.0 AS depart_min FROM (
SELECT o_zone_id, d_zone_id, agent_type, n, g.v, (SELECT min(slot5) FROM prof WHERE cum > g.v / n::DOUBLE) AS s FROM (SELECT o_zone_id, d_zone_id, agent_type, floor(volume + 0.5)::INTEGER AS n FROM od), LATERAL (SELECT unnest(range(n))::INTEGER AS v) g) JOIN prof ON slot5 = s)""", "od", "ev", more=_PROFILE)
def srt_departures(spark, sf):
    """SRT-04, DM-09, 10: the vehicles of all segments in order of departure."""
    v = demand.vehicles(star.od_demand(spark, sf), morning_profile(spark, sf)).withColumn("depart_min", F.round("depart_min", 4))
    return reports.ranked_by_time(v, "depart_min", *KEY, "v").select("rank", *KEY, "v", "depart_min")


# ---- zones and access


@query("""SELECT (cx - x0) * (y1 - y0 + 1) + cy - y0 + 1 AS zone_id, chr((65 + cx - x0)::INTEGER) || (cy - y0)::VARCHAR AS cell_code, round((cx + 0.5) * 0.04::DOUBLE, 6) AS x_coord, round((cy + 0.5) * 0.04::DOUBLE, 6) AS y_coord, nodes AS access_node_vector, n AS n_nodes FROM (
SELECT cx, cy, count(*) AS n, string_agg(node_id::VARCHAR, ';' ORDER BY node_id) AS nodes, min(cx) OVER () AS x0, min(cy) OVER () AS y0, max(cy) OVER () AS y1 FROM (SELECT node_id, floor(x_coord / 0.04::DOUBLE + 1e-9)::BIGINT AS cx, floor(y_coord / 0.04::DOUBLE + 1e-9)::BIGINT AS cy FROM net_node) GROUP BY cx, cy)""", "net_node")
def dm_grid_zones(spark, sf):
    """DM-03, SNK-16."""
    return access.grid_zones(star.nodes(spark, sf), 0.04).withColumns({"x_coord": r6("x_coord"), "y_coord": r6("y_coord")})


_TAZ = "taz AS (SELECT 100 + zone_id AS zone_id, x_coord + 0.003::DOUBLE AS x_coord, y_coord + 0.002::DOUBLE AS y_coord FROM net_node WHERE zone_id % 3 = 1)"


@query(f"""SELECT zone_id, node_id, rank::INTEGER AS rank, round(m, 3) AS metres FROM (SELECT zone_id, node_id, m, row_number() OVER (PARTITION BY zone_id ORDER BY round(m, 3), node_id) AS rank FROM (
SELECT *, max(b) OVER (PARTITION BY zone_id) AS any_b FROM (SELECT a.zone_id, b.node_id, {_HAV.format(a='a', b='b')} AS m, (b.node_id <= 5)::INTEGER AS b FROM taz a, net_node b) WHERE m <= 3000) WHERE b = any_b) WHERE rank <= 4""", "net_node", more=_TAZ)
def dm_taz_access(spark, sf):
    """SRC-24, DM-04, JN-13: planning areas reach boundary nodes, those of the southern edge, or any."""
    n = star.nodes(spark, sf)
    areas = n.where("zone_id % 3 = 1").select((C("zone_id") + 100).alias("zone_id"), (C("x_coord") + 0.003).alias("x_coord"), (C("y_coord") + 0.002).alias("y_coord"))
    return access.taz_access(areas, n.withColumn("is_boundary", (C("node_id") <= 5).cast("int")), 4, 3000.0).withColumn("metres", F.round("metres", 3))


@query(f"""SELECT node_id, stop_id, rank::INTEGER AS rank, round(m, 3) AS metres, within FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY round(m, 3), stop_id) AS rank FROM (
SELECT *, m >= 2000 AS within, bool_or(m >= 2000) OVER (PARTITION BY node_id) AS banded FROM (SELECT a.node_id, b.node_id AS stop_id, {_HAV.format(a='a', b='b')} AS m FROM net_node a, net_node b WHERE a.node_id % 2 = 0 AND b.node_id % 7 = 1) WHERE m <= 2500) WHERE within = banded) WHERE rank <= CASE WHEN banded THEN 2 ELSE 1 END""", "net_node")
def jn_activity_stops(spark, sf):
    """JN-14, SNK-12: stops between 2,000 and 2,500 metres, or the nearest below."""
    n = star.nodes(spark, sf)
    stops = n.where("node_id % 7 = 1").withColumnRenamed("node_id", "stop_id")
    return access.activity_stops(n.where("node_id % 2 = 0"), stops, 2000.0, 2500.0, 2).withColumn("metres", F.round("metres", 3))


@query(f"SELECT a AS from_node_id, b AS to_node_id, round(m, 3) AS length_m, 1000 AS link_type FROM (SELECT a.zone_id + 1000 AS a, b.node_id AS b, {_HAV.format(a='a', b='b')} AS m FROM net_node a, net_node b WHERE a.zone_id = b.node_id UNION ALL SELECT b.node_id, a.zone_id + 1000, {_HAV.format(a='a', b='b')} FROM net_node a, net_node b WHERE a.zone_id = b.node_id)", "net_node")
def snk_access_links(spark, sf):
    """SNK-12: connectors between centroids, numbered from 1,000, and the nearest node."""
    n = star.nodes(spark, sf)
    near = access.ranked(access.near_pairs(n, n, "zone_id", "node_id", 500.0), "zone_id", "node_id", 1)
    return access.access_links(near.withColumn("centroid", C("zone_id") + 1000), "centroid", "node_id").withColumn("length_m", F.round("length_m", 3))


@query("SELECT n.node_id, n.zone_id, (SELECT count(*) FROM clink WHERE from_node_id = n.node_id) AS n_out, round(x_coord, 6) AS x_coord, round(y_coord, 6) AS y_coord FROM net_node n", "net_node", "clink")
def snk_model_node(spark, sf):
    """SNK-12."""
    return sinks.model_nodes(star.nodes(spark, sf), star.links(spark, sf)).withColumns({"x_coord": r6("x_coord"), "y_coord": r6("y_coord")})


@query("SELECT link_id, printf('LINESTRING (%.6f %.6f,%.6f %.6f)', a.x_coord, a.y_coord, b.x_coord, b.y_coord) AS geometry FROM clink JOIN net_node a ON a.node_id = from_node_id JOIN net_node b ON b.node_id = to_node_id", "clink", "net_node")
def snk_model_link(spark, sf):
    """SNK-12."""
    return sinks.model_links(star.links(spark, sf), star.nodes(spark, sf)).select("link_id", "geometry")


@query("SELECT zone_id, CASE WHEN inside THEN 'inside' ELSE 'related' END AS relation, round(impact, 6) AS impact FROM area WHERE inside OR impact > 0", "od", "net_node", more=SUBAREA_SQL)
def snk_subarea_zones(spark, sf):
    """SNK-17, DM-07: zones in the subarea, and those with demand that ends or passes there."""
    zones = demand.subarea_zones(star.nodes(spark, sf), star.od_demand(spark, sf), star.FOCUS)
    return sinks.subarea_rows(zones).withColumn("impact", r6("impact"))


# ---- reports


@query("SELECT count(*) AS n, round(avg(abs(volume - r) / r * 100), 6) AS mape FROM (SELECT volume, 50.0::DOUBLE * (link_id % 13) AS r FROM load) WHERE r > 1", "load")
def agg_reference_error(spark, sf):
    """AGG-13: against reference volumes of fifty times the link's number modulo thirteen."""
    rows = loads(spark, sf).withColumns({"preload": F.lit(0.0), "ref_link_volume": F.lit(50.0) * (C("link_id") % 13)})
    return reports.reference_error(rows).withColumn("mape", r6("mape"))


@query("""SELECT agent_type, sum(v)::BIGINT AS vehicles, sum(CASE WHEN i THEN v ELSE 0 END)::BIGINT AS impacted, sum(CASE WHEN i AND d THEN v ELSE 0 END)::BIGINT AS diverted, sum(CASE WHEN i AND NOT d THEN v ELSE 0 END)::BIGINT AS kept, round(sum(v * path_cost) / sum(v), 6) AS avg_minutes FROM (
SELECT agent_type, path_cost, floor(volume + 0.5)::BIGINT AS v, len(list_filter(links, lambda x: x % 10 = 0)) > 0 AS i, o_zone_id % 3 = 0 AS d FROM path) GROUP BY agent_type""", "path")
def agg_vehicle_groups(spark, sf):
    """AGG-15: paths over every tenth link are impacted; those from every third zone are diverted."""
    flags = star.links(spark, sf).select("link_id", F.when(C("link_id") % 10 == 0, -1).otherwise(0).alias("design_flag"))
    rows = scenario.impacted_paths(free_paths(spark, sf), flags).withColumn("diverted", (C("o_zone_id") % 3 == 0).cast("int"))
    return reports.vehicle_groups(rows).withColumn("avg_minutes", r6("avg_minutes"))


@query("""SELECT link_id, minute, va::BIGINT AS va, cd::BIGINT AS cd, (va - cd)::BIGINT AS queue FROM (SELECT link_id, minute, sum(sum(a)) OVER w AS va, sum(sum(d)) OVER w AS cd FROM (
SELECT link_id, t_in + 1 + link_id % 4 AS minute, 1 AS a, 0 AS d FROM trip UNION ALL SELECT link_id, t_out, 0, 1 FROM trip) GROUP BY link_id, minute WINDOW w AS (PARTITION BY link_id ORDER BY minute))""", "trip")
def win_virtual_arrival(spark, sf):
    """WIN-08: free-flow times of one to four minutes."""
    offsets = star.links(spark, sf).select("link_id", (1 + C("link_id") % 4).alias("offset"))
    return reports.virtual_arrivals(star.trip_events(spark, sf), offsets)


@query("""SELECT agent_id, (row_number() OVER w - 1)::INTEGER AS pos, link_id, t_in, t_in - min(t_in) OVER (PARTITION BY agent_id) AS elapsed, (t_out - t_in)::DOUBLE AS on_link, round(greatest(0.0, t_out - t_in - fftt), 6) AS wait
FROM trip JOIN clink USING (link_id) WINDOW w AS (PARTITION BY agent_id ORDER BY t_in, event_id)""", "trip", "clink")
def win_trace(spark, sf):
    """WIN-09, SNK-09."""
    return reports.trace(star.trip_events(spark, sf), star.costed_links(spark, sf).select("link_id", "fftt")).withColumn("wait", r6("wait"))


@query("SELECT agent_id, count(*) AS n_links, max(t_out) - min(t_in) AS minutes FROM trip GROUP BY agent_id", "trip")
def snk_agents(spark, sf):
    """SNK-10."""
    return sinks.agent_summary(star.trip_events(spark, sf))


@query("SELECT agent_id, 20 + 8 * count(*) AS n_bytes FROM trip GROUP BY agent_id", "trip")
def snk_trajectories(spark, sf):
    """SNK-11: the length of each vehicle's binary record (the tests unpack them)."""
    return sinks.trajectory_records(star.trip_events(spark, sf)).select("agent_id", F.octet_length("record").cast("long").alias("n_bytes"))




@query("SELECT count(DISTINCT CASE WHEN d_zone_id <> 25 THEN o_zone_id * 100 + d_zone_id END) AS connected, count(*) FILTER (WHERE d_zone_id = 25) AS without_path FROM od", "od")
def agg_connectivity(spark, sf):
    """AGG-16, JN-11: connectivity over all computed paths of a network in which no link enters node 25."""
    net = star.costed_links(spark, sf).where("to_node_id <> 25")
    return reports.connectivity(star.od_demand(spark, sf), paths.routes_grouped(net, star.nodes(spark, sf).select(C("node_id").alias("origin"))))
