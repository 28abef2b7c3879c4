"""Queries over the derived network, one for each group of operators, with their SQL.

``QUERIES`` maps names to callables of (spark, sf_dir); ``ORACLES`` maps names to
DuckDB SQL of the same rows.  Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, geometry, units, vdf
from ..operators import assign, correction, demand, paths, queues, reports, scenario
from ..session import broadcast_within
from ..streaming import slots
from . import oracle, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
C = F.col
KEY = ["o_zone_id", "d_zone_id", "agent_type"]
SEEDS = (1, 7, 13, 19, 25)
CELL = 0.04
FACTORS = [("o_based", 0, None, 1.1), ("d_based", None, 1, 0.9), ("od_based", 2, 3, 1.5)]
FACTOR_SCHEMA = "scenario_type string, o_district_id int, d_district_id int, scale_factor double"


def r6(c: Column | str) -> Column:
    return F.round(C(c) if isinstance(c, str) else c, 6)


def query(sql: str | None = None, *parts: str, more: str = ""):
    """Register a query under the function's name, with the SQL of the same rows where there is one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = oracle.sql(sql, *parts, more=more)
        return f

    return keep


# ---- shared inputs


def free_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All-or-nothing paths on free-flow cost: KEY, ``volume, links, path_cost``."""
    best = paths.routes_grouped(star.costed_links(spark, sf), star.nodes(spark, sf).select(C("node_id").alias("origin")))
    return star.od_demand(spark, sf).join(best.withColumnRenamed("cost", "path_cost"), ["o_zone_id", "d_zone_id"])


def loads(spark: SparkSession, sf: str) -> DataFrame:
    return assign.loaded(star.costed_links(spark, sf), assign.link_volumes(free_paths(spark, sf)))


def timed(links: DataFrame, kind: str = "bpr") -> DataFrame:
    """Volume-delay results of the four-hour morning; an hour's demand is the volume, the peak is at eight."""
    return vdf.travel_time(vdf.with_defaults(links.withColumn("qdf", F.lit(1.0)), 4.0, 8.0), kind)


def performance(spark: SparkSession, sf: str) -> DataFrame:
    rows = vdf.queue_shape(timed(loads(spark, sf)))
    mile = units.miles(C("length_m"))
    m = units.measures(C("volume"), C("persons"), mile, C("minutes"), C("fftt"), mile / C("cutoff") * 60)
    return rows.withColumns({**m, "speed": units.travel_speed(C("free_speed"), C("minutes"), C("fftt"))})


# ---- scalars, filters, joins


@query("""SELECT link_id, round(length_m / 1609.0::DOUBLE, 6) AS mile, round(length_m / 1000.0, 6) AS km, round(fftt, 6) AS fftt_min,
round(greatest(1.0, length_m / 1609.0::DOUBLE * lanes * 300.0), 6) AS spatial_cap, round(period_cap, 6) AS period_cap, round(cutoff, 6) AS cutoff FROM clink""", "clink")
def fn_link_units(spark, sf):
    """FN-01, 02, 03, 04."""
    return star.costed_links(spark, sf).select("link_id", r6(units.miles(C("length_m"))).alias("mile"), r6(C("length_m") / 1000).alias("km"), r6("fftt").alias("fftt_min"), r6(units.spatial_capacity(C("length_m"), C("lanes"))).alias("spatial_cap"), r6("period_cap").alias("period_cap"), r6("cutoff").alias("cutoff"))


@query("""SELECT event_id, minute AS minute_of_day, minute // 5 * 5 AS slot5, 'T' || lpad((minute // 60)::VARCHAR, 2, '0') || lpad((minute % 60)::VARCHAR, 2, '0') AS hhmm FROM ev""", "ev")
def fn_time_window(spark, sf):
    """FN-11, 13, 14, 17."""
    m = C("minute")
    return star.event_times(spark, sf).select("event_id", m.alias("minute_of_day"), clock.slot5(m).alias("slot5"), clock.hhmm(m).alias("hhmm"))


@query("""SELECT node_id, cx AS cell_x, cy AS cell_y, chr((65 + cx - min(cx) OVER ())::INTEGER) || (cy - min(cy) OVER ())::VARCHAR AS cell_code FROM (
SELECT node_id, floor(x_coord / 0.04::DOUBLE + 1e-9)::BIGINT AS cx, floor(y_coord / 0.04::DOUBLE + 1e-9)::BIGINT AS cy FROM net_node)""", "net_node")
def fn_cell_code(spark, sf):
    """FN-20, GEO-09, DM-03, AGG-19."""
    cx, cy = geometry.cell_of(C("x_coord"), C("y_coord"), CELL)
    rows = star.nodes(spark, sf).select("node_id", cx.alias("cell_x"), cy.alias("cell_y"))
    low = rows.agg(F.min("cell_x").alias("x0"), F.min("cell_y").alias("y0"))
    return rows.crossJoin(F.broadcast(low)).select("node_id", "cell_x", "cell_y", geometry.cell_code(C("cell_x"), C("cell_y"), C("x0"), C("y0")).alias("cell_code"))


_TYPES = "(SELECT DISTINCT lower(c_mktsegment) AS agent_type FROM customer)"


@query(f"SELECT agent_type, link_id FROM clink, {_TYPES} t WHERE allowed_uses = '' OR list_contains(string_split(allowed_uses, ';'), agent_type)", "clink")
def flt_allowed_links(spark, sf):
    """FN-06, GR-01."""
    types = star.table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("agent_type")).distinct()
    return paths.adjacency(star.links(spark, sf), types).select("agent_type", "link_id")


@query("""SELECT o_zone_id, d_zone_id, agent_type, round(volume, 6) AS volume FROM od JOIN net_node a ON a.zone_id = o_zone_id JOIN net_node b ON b.zone_id = d_zone_id
WHERE volume > 10 AND (a.x_coord > -111.985 AND a.x_coord < -111.935 AND a.y_coord > 33.415 AND a.y_coord < 33.465 OR b.x_coord > -111.985 AND b.x_coord < -111.935 AND b.y_coord > 33.415 AND b.y_coord < 33.465)""", "od", "net_node")
def flt_major_od(spark, sf):
    """FLT-04, 05, 06."""
    n = star.nodes(spark, sf).where(geometry.in_polygon(C("x_coord"), C("y_coord"), star.SUBAREA)).agg(F.collect_set("zone_id").alias("_in"))
    rows = demand.known_pairs(star.od_demand(spark, sf), star.nodes(spark, sf)).where("volume > 10").crossJoin(F.broadcast(n))
    return rows.where(F.array_contains("_in", C("o_zone_id")) | F.array_contains("_in", C("d_zone_id"))).select(*KEY, r6("volume").alias("volume"))


@query("""SELECT link_id, from_node_id, to_node_id, round(a.x_coord, 6) AS from_x, round(a.y_coord, 6) AS from_y, round(b.x_coord, 6) AS to_x, round(b.y_coord, 6) AS to_y
FROM clink JOIN net_node a ON a.node_id = from_node_id JOIN net_node b ON b.node_id = to_node_id""", "clink", "net_node")
def jn_link_nodes(spark, sf):
    """JN-01."""
    n = star.nodes(spark, sf)
    a = n.select(C("node_id").alias("from_node_id"), r6("x_coord").alias("from_x"), r6("y_coord").alias("from_y"))
    b = n.select(C("node_id").alias("to_node_id"), r6("x_coord").alias("to_x"), r6("y_coord").alias("to_y"))
    return star.links(spark, sf).select("link_id", "from_node_id", "to_node_id").join(a, "from_node_id").join(b, "to_node_id")


@query("SELECT a.zone_id AS o_zone_id, b.zone_id AS d_zone_id FROM net_node a, net_node b WHERE a.zone_id <> b.zone_id EXCEPT SELECT o_zone_id, d_zone_id FROM od WHERE volume > 20", "od", "net_node")
def jn_unknown_zones(spark, sf):
    """JN-02, 09, 11, SET-04: ordered zone pairs without any cell above 20 trips."""
    z = star.nodes(spark, sf).select("zone_id")
    every = z.select(C("zone_id").alias("o_zone_id")).crossJoin(z.select(C("zone_id").alias("d_zone_id"))).where("o_zone_id <> d_zone_id")
    return every.join(star.od_demand(spark, sf).where("volume > 20"), ["o_zone_id", "d_zone_id"], "left_anti")


_CLASSES = [("t1", 0.3, 0.2), ("t1", 0.4, 0.3), ("all", 0.25, 0.27)]


@query("""SELECT link_id, coalesce(c.vdf_code, 'all') AS vdf_code_used, round(coalesce(c.qdf, a.qdf), 6) AS qdf, round(coalesce(c.q_alpha, a.q_alpha), 6) AS q_alpha
FROM clink LEFT JOIN cls c ON c.vdf_code = 't' || link_type CROSS JOIN (SELECT * FROM cls WHERE vdf_code = 'all') a""", "clink", more="""cls AS (SELECT vdf_code, avg(qdf) AS qdf, avg(q_alpha) AS q_alpha FROM (VALUES ('t1', 0.3::DOUBLE, 0.2::DOUBLE), ('t1', 0.4::DOUBLE, 0.3::DOUBLE), ('all', 0.25::DOUBLE, 0.27::DOUBLE)) v(vdf_code, qdf, q_alpha) GROUP BY vdf_code)""")
def jn_vdf_fallback(spark, sf):
    """JN-03, 07, AGG-07."""
    means = reports.class_means(spark.createDataFrame(_CLASSES, "vdf_code string, qdf double, q_alpha double"), ["vdf_code"], ["qdf", "q_alpha"])
    own = means.select(C("vdf_code").alias("code"), F.struct("vdf_code", "qdf", "q_alpha").alias("_own"))
    any_ = means.where("vdf_code = 'all'").select(F.struct("vdf_code", "qdf", "q_alpha").alias("_any"))
    rows = star.links(spark, sf).withColumn("code", F.concat(F.lit("t"), "link_type")).join(F.broadcast(own), "code", "left").join(F.broadcast(any_))
    used = F.coalesce("_own", "_any")
    return rows.select("link_id", used["vdf_code"].alias("vdf_code_used"), r6(used["qdf"]).alias("qdf"), r6(used["q_alpha"]).alias("q_alpha"))


_ONE = "one AS (SELECT o * 100 + node AS path_id, links, cost FROM lab WHERE o <> node)"


@query("SELECT path_id, (i - 1)::INTEGER AS pos, links[i] AS link_id FROM one, generate_series(1, 8) g(i) WHERE i <= len(links)", "lab", more=_ONE)
def jn_path_links(spark, sf):
    """JN-05, 08, SRC-17, FN-15, 18: node sequences as text, and back to links."""
    net = star.costed_links(spark, sf)
    best = paths.routes_grouped(net, star.nodes(spark, sf).select(C("node_id").alias("origin"))).withColumn("path_id", C("o_zone_id") * 100 + C("d_zone_id"))
    at = best.select("path_id", "o_zone_id", F.posexplode("links").alias("pos", "link_id")).join(net.select("link_id", "to_node_id"), "link_id")
    text = at.groupBy("path_id", "o_zone_id").agg(F.array_sort(F.collect_list(F.struct("pos", "to_node_id"))).alias("s"))
    text = text.select("path_id", F.concat_ws(";", C("o_zone_id").cast("string"), F.transform("s", lambda x: x["to_node_id"].cast("string"))).alias("t"))
    return paths.links_of_nodes(text.select("path_id", clock.id_list(C("t")).alias("nodes")), net, "path_id", "nodes")


_HAV = "2 * 6372797.56085::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({b}.y_coord - {a}.y_coord) / 2), 2) + cos(radians({a}.y_coord)) * cos(radians({b}.y_coord)) * pow(sin(radians({b}.x_coord - {a}.x_coord) / 2), 2))))"


@query(f"""SELECT zone_id, node_id, rank::INTEGER AS rank, round(m, 3) AS metres FROM (SELECT a.zone_id, b.node_id, {_HAV.format(a='a', b='b')} AS m,
row_number() OVER (PARTITION BY a.zone_id ORDER BY round({_HAV.format(a='a', b='b')}, 3), b.node_id) AS rank FROM net_node a, net_node b WHERE {_HAV.format(a='a', b='b')} <= 2500) WHERE rank <= 4""", "net_node")
def jn_knn_nodes(spark, sf):
    """JN-13, 14, SRT-03, GEO-02."""
    n = star.nodes(spark, sf)
    return demand.k_nearest(n, n, 4, 2500.0).withColumn("metres", F.round("metres", 3))


@query(f"SELECT a.zone_id, arg_min(b.node_id, round({_HAV.format(a='a', b='b')}, 3) * 1000 + b.node_id * 1e-3) AS seed_id FROM net_node a, net_node b WHERE b.node_id IN {SEEDS} GROUP BY a.zone_id", "net_node")
def jn_nearest_seed(spark, sf):
    """JN-16, DM-08."""
    n = star.nodes(spark, sf)
    return demand.nearest(n, n.where(C("node_id").isin(*SEEDS)).withColumnRenamed("node_id", "seed_id"), "zone_id", "seed_id")


# ---- geometry


@query("""SELECT link_id, (a.x_coord > -111.985 AND a.x_coord < -111.935 AND a.y_coord > 33.415 AND a.y_coord < 33.465) AS from_inside,
(a.x_coord > -111.985 AND a.x_coord < -111.935 AND a.y_coord > 33.415 AND a.y_coord < 33.465) <> (b.x_coord > -111.985 AND b.x_coord < -111.935 AND b.y_coord > 33.415 AND b.y_coord < 33.465) AS crosses
FROM clink JOIN net_node a ON a.node_id = from_node_id JOIN net_node b ON b.node_id = to_node_id""", "clink", "net_node")
def geo_in_polygon(spark, sf):
    """GEO-03, 04, JN-17, DM-07: grid links are axis-parallel, so one crosses the rectangle exactly when its ends differ."""
    n = star.nodes(spark, sf)
    rows = star.links(spark, sf).join(n.select(C("node_id").alias("from_node_id"), C("x_coord").alias("x1"), C("y_coord").alias("y1")), "from_node_id").join(n.select(C("node_id").alias("to_node_id"), C("x_coord").alias("x2"), C("y_coord").alias("y2")), "to_node_id")
    return rows.select("link_id", geometry.in_polygon(C("x1"), C("y1"), star.SUBAREA).alias("from_inside"), geometry.crosses_ring(C("x1"), C("y1"), C("x2"), C("y2"), star.SUBAREA).alias("crosses"))


@query("""SELECT link_id, 2 AS n_points, round(a.x_coord, 6) AS first_x, round(b.y_coord, 6) AS last_y FROM clink JOIN net_node a ON a.node_id = from_node_id JOIN net_node b ON b.node_id = to_node_id""", "clink", "net_node")
def geo_wkt_roundtrip(spark, sf):
    """GEO-01, 08, FN-18."""
    n = star.nodes(spark, sf)
    pt = lambda side: n.select(C("node_id").alias(f"{side}_node_id"), F.struct(C("x_coord").alias("x"), C("y_coord").alias("y")).alias(side))
    rows = star.links(spark, sf).join(pt("from"), "from_node_id").join(pt("to"), "to_node_id")
    back = rows.select("link_id", geometry.points_of(geometry.line_text(F.array("from", "to"))).alias("p"))
    return back.select("link_id", F.size("p").alias("n_points"), r6(C("p")[0]["x"]).alias("first_x"), r6(F.element_at("p", -1)["y"]).alias("last_y"))


def _hull_sql(key: str) -> dict[str, str]:
    """Corners of the hull of each group: points that lie neither between two others nor inside a triangle of others, by angle from the first."""
    cross = lambda a, b, p: f"(({b}.x - {a}.x) * ({p}.y - {a}.y) - ({b}.y - {a}.y) * ({p}.x - {a}.x))"
    return {"more": f"""hp AS (SELECT DISTINCT {key} AS g, x_coord AS x, y_coord AS y FROM net_node),
corner AS (SELECT * FROM hp p WHERE (SELECT count(*) FROM hp WHERE g = p.g) >= 4
 AND NOT EXISTS (SELECT 1 FROM hp a, hp b WHERE a.g = p.g AND b.g = p.g AND abs({cross('a', 'b', 'p')}) < 1e-12 AND (a.x - p.x) * (b.x - p.x) + (a.y - p.y) * (b.y - p.y) < -1e-12)
 AND NOT EXISTS (SELECT 1 FROM hp a, hp b, hp c WHERE a.g = p.g AND b.g = p.g AND c.g = p.g AND {cross('a', 'b', 'p')} > 1e-12 AND {cross('b', 'c', 'p')} > 1e-12 AND {cross('c', 'a', 'p')} > 1e-12)),
ring AS (SELECT g, printf('%.6f %.6f', x, y) AS t, row_number() OVER (PARTITION BY g ORDER BY x, y) AS i, atan2(y - first_value(y) OVER w, x - first_value(x) OVER w) AS angle FROM corner WINDOW w AS (PARTITION BY g ORDER BY x, y)),
hull AS (SELECT g, count(*) AS n_vertices, 'POLYGON ((' || string_agg(t, ', ' ORDER BY (i > 1)::INTEGER, angle) || ', ' || min(CASE WHEN i = 1 THEN t END) || '))' AS geometry FROM ring GROUP BY g)"""}


@query("SELECT g AS district_id, n_vertices, geometry FROM hull", "net_node", **_hull_sql("district_id"))
def geo_hull(spark, sf):
    """GEO-05, AGG-21."""
    return geometry.hulls(star.nodes(spark, sf), "district_id", "x_coord", "y_coord")


@query("SELECT g AS part, n_vertices, geometry FROM hull", "net_node", **_hull_sql("node_id % 4"))
def geo_hull_parts(spark, sf):
    """GEO-05: hulls of every fourth node, which have points inside and on their edges."""
    return geometry.hulls(star.nodes(spark, sf).withColumn("part", C("node_id") % 4), "part", "x_coord", "y_coord")


@query("""SELECT x1 - x0 AS extent_x, r AS cell FROM (SELECT round(max(x_coord), 6) AS x1, round(min(x_coord), 6) AS x0 FROM net_node), (SELECT 0.0025::DOUBLE AS unused, min(r) AS r FROM (VALUES (0.0025::DOUBLE), (0.005), (0.0075), (0.01), (0.02), (0.025)) v(r) WHERE r > 0.08::DOUBLE / 8 + 1e-12)""".replace("x1 - x0 AS extent_x", "round(x1 - x0, 6) AS extent_x"), "net_node")
def geo_resolution(spark, sf):
    """GEO-07, AGG-19."""
    box = reports.bounding_box(star.nodes(spark, sf))
    extent = F.round(C("x1") - C("x0"), 6)
    return box.select(extent.alias("extent_x"), geometry.resolution(extent + 1e-11, F.lit(25)).alias("cell"))


@query(f"SELECT a.zone_id, round(min({_HAV.format(a='a', b='b')}), 3) AS metres FROM net_node a, net_node b WHERE a.zone_id <> b.zone_id GROUP BY a.zone_id", "net_node")
def agg_nearest_neighbour(spark, sf):
    """AGG-20."""
    n = star.nodes(spark, sf)
    return demand.k_nearest(n, n, 2, 5000.0).where("zone_id <> node_id").groupBy("zone_id").agg(F.round(F.min("metres"), 3).alias("metres"))


# ---- demand


@query(f"SELECT a.zone_id AS o_zone_id, b.zone_id AS d_zone_id, round({_HAV.format(a='a', b='b')} / 1609.0, 6) AS mile, round({_HAV.format(a='a', b='b')} / 1609.0 / 30.0 * 60, 6) AS minute FROM net_node a, net_node b WHERE a.zone_id <> b.zone_id", "net_node")
def dm_accessibility(spark, sf):
    """DM-01, JN-10."""
    return demand.accessibility(star.nodes(spark, sf)).withColumns({"mile": r6("mile"), "minute": r6("minute")})


def zone_totals(spark, sf) -> DataFrame:
    """Zones with the counts of their customers (production) and suppliers (attraction)."""
    p = star.table(spark, sf, "customer").groupBy((C("c_nationkey") + 1).alias("zone_id")).agg(F.count("*").cast("double").alias("production"))
    a = star.table(spark, sf, "supplier").groupBy((C("s_nationkey") + 1).alias("zone_id")).agg(F.count("*").cast("double").alias("attraction"))
    return star.nodes(spark, sf).join(p, "zone_id", "left").join(a, "zone_id", "left").fillna(0.0, ["production", "attraction"])


@query(f"""SELECT o_zone_id, d_zone_id, round(production * attraction / greatest(1e-5, sum(CASE WHEN minute <= 10 THEN attraction END) OVER (PARTITION BY o_zone_id)), 6) AS trips
FROM (SELECT a.zone_id AS o_zone_id, b.zone_id AS d_zone_id, {_HAV.format(a='a', b='b')} / 1609.0 / 30.0 * 60 AS minute, a.p AS production, b.a AS attraction FROM z a, z b WHERE a.zone_id <> b.zone_id)""", "net_node", more="""z AS (SELECT n.*,
coalesce((SELECT count(*) FROM customer WHERE c_nationkey + 1 = n.zone_id), 0)::DOUBLE AS p, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey + 1 = n.zone_id), 0)::DOUBLE AS a FROM net_node n)""")
def dm_distribution(spark, sf):
    """DM-02."""
    z = zone_totals(spark, sf)
    return demand.distribution(demand.accessibility(z), z, 10.0).withColumn("trips", r6("trips"))


@query("""SELECT o_zone_id, d_zone_id, agent_type, round(volume * 1.2::DOUBLE * CASE WHEN a.district_id = 2 AND b.district_id = 3 THEN 1.5::DOUBLE WHEN b.district_id = 1 THEN 0.9::DOUBLE WHEN a.district_id = 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS volume
FROM od JOIN net_node a ON a.zone_id = o_zone_id JOIN net_node b ON b.zone_id = d_zone_id""", "od", "net_node")
def dm_factors(spark, sf):
    """DM-05, 06, SC-02."""
    factors = spark.createDataFrame(FACTORS, FACTOR_SCHEMA)
    rows = demand.district_factors(star.od_demand(spark, sf), star.nodes(spark, sf), factors, 1.2)
    return rows.select(*KEY, r6("volume").alias("volume"))


_PROFILE = """prof AS (SELECT slot5, n / sum(n) OVER ()::DOUBLE AS ratio, sum(n) OVER (ORDER BY slot5)::DOUBLE / sum(n) OVER ()::DOUBLE AS cum FROM (SELECT minute // 5 * 5 AS slot5, count(*) AS n FROM ev WHERE minute >= 360 AND minute < 600 GROUP BY 1))"""


def morning_profile(spark, sf) -> DataFrame:
    e = star.event_times(spark, sf).where("minute >= 360 and minute < 600")
    return demand.departure_profile(e.groupBy(clock.slot5(C("minute")).alias("slot5")).agg(F.count("*").alias("n")), "slot5", "n")


@query("SELECT slot5, round(ratio, 6) AS ratio, round(cum, 6) AS cum FROM prof", "ev", more=_PROFILE)
def win_profile(spark, sf):
    """WIN-01."""
    return morning_profile(spark, sf).select("slot5", r6("ratio").alias("ratio"), r6("cum").alias("cum"))


@query("""SELECT o_zone_id, d_zone_id, agent_type, v, round(slot5 + (v / n::DOUBLE - (cum - ratio)) / ratio * 5.0, 4) AS depart_min FROM (
SELECT o_zone_id, d_zone_id, agent_type, n, g.v, (SELECT min(slot5) FROM prof WHERE cum > g.v / n::DOUBLE) AS s FROM (SELECT o_zone_id, d_zone_id, agent_type, floor(volume + 0.5)::INTEGER AS n FROM od), LATERAL (SELECT unnest(range(n))::INTEGER AS v) g) JOIN prof ON slot5 = s""", "od", "ev", more=_PROFILE)
def dm_departures(spark, sf):
    """DM-09, 10, SIM-04: the vehicles of all segments."""
    v = demand.vehicles(star.od_demand(spark, sf), morning_profile(spark, sf))
    return v.select(*KEY, "v", F.round("depart_min", 4).alias("depart_min"))


def _crossed(axis: str) -> tuple[str, str]:
    """SQL of the shares of the way from a to b at which it enters and leaves the band of FOCUS along an axis."""
    low, high = (min(c[axis == "y"] for c in star.FOCUS), max(c[axis == "y"] for c in star.FOCUS))
    d = f"(b.{axis}_coord - a.{axis}_coord)"
    at = lambda v: f"({v}::DOUBLE - a.{axis}_coord) / {d}"
    inside = f"a.{axis}_coord > {low} AND a.{axis}_coord < {high}"
    return f"CASE WHEN {d} = 0 THEN CASE WHEN {inside} THEN -1e9::DOUBLE ELSE 1e9::DOUBLE END ELSE least({at(low)}, {at(high)}) END", f"CASE WHEN {d} = 0 THEN 1e9::DOUBLE ELSE greatest({at(low)}, {at(high)}) END"


(_X0, _X1), (_Y0, _Y1) = _crossed("x"), _crossed("y")
_IN_FOCUS = "({n}.x_coord > -111.9857 AND {n}.x_coord < -111.9341 AND {n}.y_coord > 33.4143 AND {n}.y_coord < 33.4657)"
#: Each zone, whether it lies in FOCUS, and its demand that starts, ends or passes there.
SUBAREA_SQL = f"""area AS (SELECT n.zone_id, {_IN_FOCUS.format(n='n')} AS inside, coalesce(t.impact, 0.0) AS impact FROM net_node n LEFT JOIN (
SELECT o_zone_id, sum(volume) AS impact FROM od JOIN net_node a ON a.zone_id = o_zone_id JOIN net_node b ON b.zone_id = d_zone_id WHERE greatest({_X0}, {_Y0}, 0.0) < least({_X1}, {_Y1}, 1.0) GROUP BY o_zone_id) t ON t.o_zone_id = n.zone_id)"""


@query("SELECT zone_id, inside, round(impact, 6) AS impact FROM area", "od", "net_node", more=SUBAREA_SQL)
def dm_subarea(spark, sf):
    """DM-07: all demand that starts, ends or passes in the subarea."""
    return demand.subarea_zones(star.nodes(spark, sf), star.od_demand(spark, sf), star.FOCUS).select("zone_id", "inside", r6("impact").alias("impact"))


# ---- aggregates, windows, rankings


@query("SELECT CASE grouping_id(o_zone_id, d_zone_id) WHEN 0 THEN 'cell' WHEN 1 THEN 'origin' ELSE 'all' END AS level, o_zone_id, d_zone_id, round(sum(volume), 6) AS volume FROM od GROUP BY GROUPING SETS ((o_zone_id, d_zone_id), (o_zone_id), ())", "od")
def agg_od_totals(spark, sf):
    """AGG-02, SRC-19, SET-01."""
    return reports.od_totals(star.od_demand(spark, sf)).withColumn("volume", r6("volume"))


@query("SELECT link_type, count(*) AS n, round(avg(free_speed), 6) AS avg_speed, round(sum(length_m / 1609.0::DOUBLE), 6) AS miles, round(sum(lane_capacity * lanes), 6) AS capacity FROM clink GROUP BY link_type", "clink")
def agg_network_summary(spark, sf):
    """AGG-03."""
    return reports.network_summary(star.links(spark, sf)).select("link_type", "n", r6("avg_speed").alias("avg_speed"), r6("miles").alias("miles"), r6("capacity").alias("capacity"))


@query("SELECT link_id, round(volume, 6) AS volume, round(volume * 1.5::DOUBLE, 6) AS persons FROM load WHERE volume > 0", "load")
def agg_link_volume(spark, sf):
    """AGG-01, 09, JN-08."""
    v = assign.link_volumes(free_paths(spark, sf).withColumn("occ", F.lit(1.5)), occupancy="occ")
    return v.select("link_id", r6("volume").alias("volume"), r6("persons").alias("persons"))


@query("""SELECT corridor, count(*) AS n, round(avg(volume), 6) AS vol, round(avg(speed), 6) AS speed, round(avg(doc), 6) AS doc, round(max(p), 6) AS max_p FROM (
SELECT 'type ' || link_type AS corridor, volume, speed, doc, p FROM perf UNION ALL SELECT 'sa link_id:' || link_id, volume, speed, doc, p FROM perf WHERE link_id % 20 = 0) GROUP BY corridor""", "vdf")
def agg_corridor(spark, sf):
    """AGG-05, SET-02."""
    rows = reports.corridors(performance(spark, sf), F.concat(F.lit("type "), C("link_type").cast("string")), F.when(C("link_id") % 20 == 0, F.lit("sa")))
    return rows.select("corridor", "n", *[r6(c).alias(c) for c in ("vol", "speed", "doc", "max_p")])


_MILES = "(SELECT sum(c.length_m / 1609.0::DOUBLE) FROM clink c WHERE list_contains(p.links, c.link_id))"


def mile_paths(spark, sf) -> DataFrame:
    net = star.costed_links(spark, sf).withColumn("mile", units.miles(C("length_m")))
    rows = free_paths(spark, sf)
    each = rows.select("o_zone_id", "d_zone_id", "links").dropDuplicates(["o_zone_id", "d_zone_id"])
    miles = each.select("o_zone_id", "d_zone_id", F.explode("links").alias("link_id")).join(broadcast_within(net.select("link_id", "mile"), 16), "link_id").groupBy("o_zone_id", "d_zone_id").agg(F.sum("mile").alias("path_miles"))
    return rows.join(miles, ["o_zone_id", "d_zone_id"])


_MP = "mp AS (SELECT p.*, m.path_miles FROM path p JOIN (SELECT o, node, sum(length_m / 1609.0::DOUBLE) AS path_miles FROM (SELECT o, node, unnest(links) AS link_id FROM lab) JOIN clink USING (link_id) GROUP BY o, node) m ON m.o = p.o_zone_id AND m.node = p.d_zone_id)"


@query("SELECT district_id, agent_type, round(sum(volume), 6) AS volume, round(sum(volume * path_cost) / sum(volume), 6) AS avg_time, round(sum(volume * path_miles) / sum(volume), 6) AS avg_mile FROM mp JOIN net_node ON zone_id = o_zone_id GROUP BY ALL", "path", "net_node", more=_MP)
def agg_district(spark, sf):
    """AGG-06, 12."""
    rows = reports.districts(mile_paths(spark, sf), star.nodes(spark, sf))
    return rows.select("district_id", "agent_type", *[r6(c).alias(c) for c in ("volume", "avg_time", "avg_mile")])


@query("SELECT round(sum(vmt), 4) AS vmt, round(sum(vht), 4) AS vht, round(sum(vmt), 4) AS pmt, round(sum(vht), 4) AS pht, round(sum(vmt) / sum(vht), 6) AS mph, round(sum(vmt) * 1.609::DOUBLE, 4) AS vkt FROM perf", "vdf")
def agg_moe_totals(spark, sf):
    """AGG-14, FN-09, 10."""
    return reports.moe_totals(performance(spark, sf)).select(*[F.round(c, 4).alias(c) for c in ("vmt", "vht", "pmt", "pht", "vkt")], r6("mph").alias("mph"))


@query("""SELECT demand_period, count(*) AS n, round(avg(abs(d)), 6) AS mae, round(avg(abs(d) / obs_count) * 100, 6) AS mape, round(avg(d / obs_count) * 100, 6) AS mpe FROM (
SELECT demand_period, obs_count, upper_bound_flag, volume - obs_count AS d FROM obs JOIN load USING (link_id) WHERE obs_count >= 1) WHERE upper_bound_flag = 0 OR d > 0 GROUP BY demand_period""", "obs", "load")
def agg_count_error(spark, sf):
    """AGG-11, 13, OD-01."""
    rows = reports.count_errors(loads(spark, sf).select("link_id", "volume"), star.link_observations(spark, sf), "demand_period")
    return rows.select("demand_period", "n", *[r6(c).alias(c) for c in ("mae", "mape", "mpe")])


@query("""SELECT count(DISTINCT CASE WHEN links IS NOT NULL THEN o_zone_id * 100 + d_zone_id END) AS connected, count(*) FILTER (WHERE links IS NULL) AS without_path
FROM od LEFT JOIN lab f ON f.o = o_zone_id AND f.node = d_zone_id""", "od", "lab")
def agg_od_connect(spark, sf):
    """AGG-16, JN-11: over all demand and all paths; agg_connectivity has a node that cannot be reached."""
    best = paths.routes_grouped(star.costed_links(spark, sf), star.nodes(spark, sf).select(C("node_id").alias("origin")))
    return reports.connectivity(star.od_demand(spark, sf), best)


@query("""SELECT o_zone_id, d_zone_id, round(sum(volume), 6) AS volume, round(sum(volume * path_miles) / sum(volume), 6) AS avg_mile, round(sum(volume * path_cost) / sum(volume), 6) AS avg_time,
round(sum(volume * path_cost) FILTER (WHERE agent_type = 'building') / sum(volume) FILTER (WHERE agent_type = 'building'), 6) AS time_building FROM mp GROUP BY ALL""", "path", more=_MP)
def agg_od_weighted(spark, sf):
    """AGG-10."""
    rows = reports.od_weighted(mile_paths(spark, sf), ["building"])
    return rows.select("o_zone_id", "d_zone_id", *[r6(c).alias(c) for c in ("volume", "avg_mile", "avg_time", "time_building")])


@query("SELECT link_id, count(DISTINCT agent_id) AS agents, count(*) AS visits FROM trip GROUP BY link_id", "trip")
def agg_event_meso(spark, sf):
    """AGG-24."""
    return reports.meso_links(star.trip_events(spark, sf))


@query("SELECT agent_id, link_id, (t_out - t_in)::DOUBLE AS wait FROM trip QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY t_out - t_in DESC, link_id) = 1 AND t_out - t_in >= 0.001", "trip")
def agg_worst_link(spark, sf):
    """AGG-25, 26."""
    return reports.worst_links(star.trip_events(spark, sf).withColumn("w", (C("t_out") - C("t_in")).cast("double")), "w")


@query("""SELECT link_id, minute, ca::BIGINT AS ca, cd::BIGINT AS cd, (ca - cd)::BIGINT AS queue, (ca - coalesce(lag(ca) OVER (PARTITION BY link_id ORDER BY minute), 0))::BIGINT AS inflow FROM (
SELECT link_id, minute, sum(sum(a)) OVER w AS ca, sum(sum(d)) OVER w AS cd FROM (SELECT link_id, t_in AS minute, 1 AS a, 0 AS d FROM trip UNION ALL SELECT link_id, t_out, 0, 1 FROM trip) GROUP BY link_id, minute WINDOW w AS (PARTITION BY link_id ORDER BY minute))""", "trip")
def win_cumulative(spark, sf):
    """WIN-02, 03."""
    return reports.cumulative(star.trip_events(spark, sf))


_SIG = "sig AS (SELECT link_id, 60 + 10 * (link_id % 4) AS cycle, 5 * (link_id % 3) AS sg, 25 + 5 * (link_id % 3) AS eg FROM clink WHERE link_id % 8 = 0)"


@query("""SELECT link_id, min(second)::INTEGER AS start, count(*) AS duration, state FROM (SELECT *, second - row_number() OVER (PARTITION BY link_id, state ORDER BY second) AS run FROM (
SELECT link_id, second, (second % cycle >= sg AND second % cycle < eg)::INTEGER AS state FROM sig, range(300) r(second))) GROUP BY link_id, state, run""", "clink", more=_SIG)
def win_runlength(spark, sf):
    """WIN-05, SIM-03, JN-20."""
    i = C("link_id")
    signals = star.links(spark, sf).where(i % 8 == 0).select("link_id", "lanes", (60 + 10 * (i % 4)).alias("cycle"), (5 * (i % 3)).alias("start_green"), (25 + 5 * (i % 3)).alias("end_green"))
    return reports.run_lengths(queues.signal_seconds(signals, 300), "link_id", "second", "state")


@query("SELECT path_id, (i - 1)::INTEGER AS pos, links[i] AS link_id, round(sum(fftt) OVER (PARTITION BY path_id ORDER BY i), 6) AS elapsed FROM one, generate_series(1, 8) g(i), clink WHERE i <= len(links) AND clink.link_id = links[i]", "lab", more=_ONE)
def win_path_clock(spark, sf):
    """WIN-06, 09, 10."""
    net = star.costed_links(spark, sf)
    best = paths.routes_grouped(net, star.nodes(spark, sf).select(C("node_id").alias("origin"))).withColumn("path_id", C("o_zone_id") * 100 + C("d_zone_id"))
    at = best.select("path_id", F.posexplode("links").alias("pos", "link_id"))
    return reports.path_clock(at, net, "fftt").select("path_id", "pos", "link_id", r6("elapsed").alias("elapsed"))


@query("""SELECT link_id, hour, round(s - least(0.0, min(s) OVER (PARTITION BY link_id ORDER BY hour)), 6) AS queue FROM (
SELECT link_id, hour, sum(n - 4.5::DOUBLE) OVER (PARTITION BY link_id ORDER BY hour) AS s FROM (SELECT link_id, minute // 60 AS hour, count(*) AS n FROM ev GROUP BY ALL))""", "ev")
def win_period_queue(spark, sf):
    """WIN-07."""
    v = star.event_times(spark, sf).groupBy("link_id", F.floor(C("minute") / 60).alias("hour")).agg(F.count("*").alias("arrivals")).withColumn("capacity", F.lit(4.5))
    return reports.period_queue(v, "link_id", "hour").select("link_id", "hour", r6("queue").alias("queue"))


@query("SELECT row_number() OVER (ORDER BY round(volume, 6) DESC, o_zone_id, d_zone_id, agent_type)::INTEGER AS rank, o_zone_id, d_zone_id, agent_type, round(volume, 6) AS volume FROM od ORDER BY rank LIMIT 100", "od")
def srt_top_od(spark, sf):
    """SRT-01."""
    return reports.top_od(star.od_demand(spark, sf), 100).select("rank", *KEY, r6("volume").alias("volume"))


@query("""SELECT round(cutoff, 6) AS cutoff, count(*) AS n_kept FROM r, (SELECT max(CASE WHEN rk = floor(n - greatest(0.25 * n, 100)) THEN volume END) AS cutoff FROM r) WHERE volume >= cutoff GROUP BY 1""", "od", more="r AS (SELECT volume, row_number() OVER (ORDER BY volume DESC) AS rk, count(*) OVER () AS n FROM od WHERE volume > 0)")
def srt_cutoff(spark, sf):
    """SRT-02, DM-07."""
    return demand.cutoff_value(star.od_demand(spark, sf), "volume").select(r6("cutoff").alias("cutoff"), "n_kept")


# ---- volume-delay


@query("SELECT link_id, round(volume, 6) AS volume, round(doc, 6) AS doc, round(voc, 6) AS voc, round(queue_speed, 6) AS queue_speed, round(minutes, 6) AS minutes, round(wait, 6) AS wait FROM vdf", "vdf")
def vdf_travel_time(spark, sf):
    """VDF-01..07, 09."""
    return timed(loads(spark, sf)).select("link_id", *[r6(c).alias(c) for c in ("volume", "doc", "voc", "queue_speed", "minutes", "wait")])


@query("SELECT link_id, round(p, 6) AS p, round(vt2, 6) AS vt2, round(t0, 6) AS t0, round(t3, 6) AS t3, round(mu, 4) AS mu, round(gamma, 2) AS gamma FROM shape WHERE p > 0.01", "vdf")
def vdf_queue_shape(spark, sf):
    """VDF-10..15."""
    return vdf.queue_shape(timed(loads(spark, sf))).where("p > 0.01").select("link_id", *[r6(c).alias(c) for c in ("p", "vt2", "t0", "t3")], F.round("mu", 4).alias("mu"), F.round("gamma", 2).alias("gamma"))


_PROF = """slots AS (SELECT s.*, g.slot::INTEGER AS slot, g.slot / 12.0::DOUBLE AS t, greatest(cutoff, free_speed * fftt / greatest(1e-6, minutes)) AS edge FROM shape s, range(72, 121) g(slot) WHERE p > 0.01),
speeds AS (SELECT link_id, slot, free_speed, cutoff, coalesce(CASE WHEN t >= t0 AND t <= t3 THEN 1 / (gamma / 4 * (t - t0) ** 2 * (t - t3) ** 2 / greatest(0.001, mu) + rtt)
 WHEN t < t0 THEN free_speed + (edge - free_speed) * (t - 6) / (t0 - 6) ELSE edge + (free_speed - edge) * (t - t3) / (10 - t3) END, free_speed) AS speed FROM slots)"""


@query("SELECT link_id, slot, round(speed, 4) AS speed FROM speeds", "vdf", more=_PROF)
def vdf_profile(spark, sf):
    """VDF-16."""
    rows = vdf.queue_shape(timed(loads(spark, sf))).where("p > 0.01")
    return vdf.profile(rows, "link_id", 6.0, 10.0).select("link_id", "slot", F.round("speed", 4).alias("speed"))


@query("SELECT link_id, bucket, round(m, 4) AS speed, round(least(1.0, m / cutoff), 4) AS ratio FROM (SELECT link_id, slot // 3 AS bucket, any_value(cutoff) AS cutoff, coalesce(sum(speed) FILTER (WHERE speed >= 1), 0.0) / greatest(1, count(*) FILTER (WHERE speed >= 1)) AS m FROM speeds GROUP BY ALL)", "vdf", more=_PROF)
def agg_speed_15min(spark, sf):
    """AGG-17, FN-24."""
    rows = vdf.profile(vdf.queue_shape(timed(loads(spark, sf))).where("p > 0.01"), "link_id", 6.0, 10.0)
    means = reports.mean_speed(rows, 15)
    return means.select("link_id", "bucket", F.round("speed", 4).alias("speed"), F.round(units.capped_ratio(C("speed"), C("cutoff")), 4).alias("ratio"))


@query("SELECT link_id, round(count(*) FILTER (WHERE speed < free_speed / 2) * 5.0 / 60.0, 6) AS severe_hours FROM speeds GROUP BY link_id", "vdf", more=_PROF)
def vdf_severe_hours(spark, sf):
    """VDF-17."""
    rows = vdf.profile(vdf.queue_shape(timed(loads(spark, sf))).where("p > 0.01"), "link_id", 6.0, 10.0)
    return vdf.severe_hours(rows, "link_id").withColumn("severe_hours", r6("severe_hours"))


@query("""SELECT link_id, round(CASE WHEN link_id % 8 = 0 THEN pow(60 + 10 * (link_id % 4) - 20, 2) / (2 * (60 + 10 * (link_id % 4))) / 60.0 / greatest(1 - demand / 1800.0, 0.1) + fftt ELSE minutes END, 6) AS minutes FROM vdf""", "vdf")
def vdf_signal(spark, sf):
    """VDF-08, FN-05."""
    i = C("link_id")
    cycle = F.when(i % 8 == 0, 60 + 10 * (i % 4)).otherwise(0)
    rows = timed(loads(spark, sf)).withColumns({"cycle": cycle, "red": units.red_seconds(cycle, F.lit(0), F.lit(20)), "saturation": F.lit(1800.0)})
    return vdf.signal_delay(rows, "cycle", "red", "saturation").select("link_id", r6("minutes").alias("minutes"))


# ---- graph and assignment


@query("SELECT o AS origin, node, round(cost, 6) AS cost FROM lab", "lab")
def gr_shortest_path(spark, sf):
    """GR-02, 18, 21."""
    tree = paths.labels(star.costed_links(spark, sf), star.nodes(spark, sf).select(C("node_id").alias("origin")))
    return tree.select("origin", "node", r6("cost").alias("cost"))


@query("SELECT o AS o_zone_id, node AS d_zone_id, array_to_string(links, ';') AS links, round(cost, 6) AS cost FROM lab WHERE o <> node", "lab")
def gr_backtrace(spark, sf):
    """GR-07, SET-03."""
    net, n = star.costed_links(spark, sf), star.nodes(spark, sf)
    tree = paths.labels_grouped(net, n.select(C("node_id").alias("origin")))
    pairs = tree.where("origin <> node").select(C("origin").alias("o_zone_id"), C("node").alias("d_zone_id"))
    return paths.routes(tree, pairs).select("o_zone_id", "d_zone_id", F.array_join("links", ";").alias("links"), r6("cost").alias("cost"))


@query("""SELECT 0 AS iteration, 0.0::DOUBLE AS avg_minutes, -1.0::DOUBLE AS gap UNION ALL SELECT 1, 0.0, -1.0 UNION ALL
SELECT 2, round(t / v, 4), round((t - t0) / t0, 6) + 0.0 FROM (SELECT sum(minutes * volume) AS t FROM vdf), (SELECT sum(volume) AS v FROM od), (SELECT sum(d.volume * m) AS t0 FROM od d JOIN (SELECT o, node, cost AS m FROM best) b ON b.o = d.o_zone_id AND b.node = d.d_zone_id)""", "vdf",
more="""elink AS (SELECT link_id, from_node_id, to_node_id, minutes + link_id * 1e-9::DOUBLE AS cost FROM vdf),
best(o, node, cost) USING KEY (o, node) AS (SELECT node_id, node_id, 0.0::DOUBLE FROM net_node UNION SELECT l.o, e.to_node_id, min(l.cost + e.cost) FROM best l JOIN elink e ON e.from_node_id = l.node LEFT JOIN recurring.best r ON r.o = l.o AND r.node = e.to_node_id WHERE r.cost IS NULL OR l.cost + e.cost < r.cost GROUP BY l.o, e.to_node_id)""")
def gr_msa_3(spark, sf):
    """GR-08, 09, 14, AGG-04: the trace of three iterations; at k = 2 times follow the all-or-nothing load of free-flow paths."""
    od = star.od_demand(spark, sf)
    _, trace = assign.column_generation(star.costed_links(spark, sf), od, 3, timed)
    total = od.agg(F.sum("volume").alias("v"))
    return trace.crossJoin(total).select("iteration", F.round(C("total_minutes") / C("v"), 4).alias("avg_minutes"), (r6("gap") + 0.0).alias("gap"))


_TWO = """two AS (SELECT o_zone_id, d_zone_id, agent_type, 0.75::DOUBLE * volume AS volume, path_cost, 1 AS path_id FROM path UNION ALL SELECT o_zone_id, d_zone_id, agent_type, 0.25::DOUBLE * volume, path_cost * (1 + (o_zone_id % 5) * 0.1::DOUBLE) + 0.5::DOUBLE, 2 FROM path)"""


def two_paths(spark, sf) -> DataFrame:
    """A cheap path with three quarters of each cell, and a dearer one with the rest."""
    p = free_paths(spark, sf)
    a = p.select(*KEY, (C("volume") * 0.75).alias("volume"), "path_cost", F.lit(1).alias("path_id"), "links")
    b = p.select(*KEY, (C("volume") * 0.25).alias("volume"), (C("path_cost") * (1 + (C("o_zone_id") % 5) * 0.1) + 0.5).alias("path_cost"), F.lit(2).alias("path_id"), "links")
    return a.unionByName(b)


@query("""SELECT a.o_zone_id, a.d_zone_id, a.agent_type, u.path_id, round(CASE WHEN u.path_id = 1 THEN a.volume + s ELSE b.volume - s END, 6) AS volume FROM two a JOIN two b USING (o_zone_id, d_zone_id, agent_type),
LATERAL (SELECT least(b.volume, (a.volume + b.volume) / 2 * (b.path_cost - a.path_cost) / greatest(1e-4, a.path_cost)) AS s) q, (VALUES (1), (2)) u(path_id) WHERE a.path_id = 1 AND b.path_id = 2""", "path", more=_TWO)
def gr_column_update(spark, sf):
    """GR-10, SRT-06."""
    return assign.column_update(two_paths(spark, sf), 0).select(*KEY, "path_id", r6("volume").alias("volume"))


@query("SELECT round(sum(volume * (path_cost - least_cost)), 4) AS gap, round(sum(volume * least_cost), 4) AS total FROM (SELECT *, min(path_cost) OVER (PARTITION BY o_zone_id, d_zone_id, agent_type) AS least_cost FROM two)", "path", more=_TWO)
def srt_best_path(spark, sf):
    """SRT-06, OD-05."""
    return assign.ue_gap(two_paths(spark, sf)).select(F.round("gap", 4).alias("gap"), F.round("total", 4).alias("total"))


@query("SELECT o_zone_id, d_zone_id, max((len(list_filter(links, lambda x: x % 10 = 0)) > 0)::INTEGER) AS impacted FROM path GROUP BY ALL", "path")
def gr_impacted_od(spark, sf):
    """GR-15, AGG-27."""
    flags = star.links(spark, sf).select("link_id", F.when(C("link_id") % 10 == 0, -1).otherwise(0).alias("design_flag"))
    return scenario.impacted_od(scenario.impacted_paths(free_paths(spark, sf), flags))


@query("SELECT o_zone_id, d_zone_id, agent_type, path_id, round(w * exp(-0.1::DOUBLE * (path_cost - m)) / sum(exp(-0.1::DOUBLE * (path_cost - m))) OVER (PARTITION BY o_zone_id, d_zone_id, agent_type), 6) AS volume FROM (SELECT *, min(path_cost) OVER (PARTITION BY o_zone_id, d_zone_id, agent_type) AS m, sum(volume) OVER (PARTITION BY o_zone_id, d_zone_id, agent_type) AS w FROM two)", "path", more=_TWO)
def gr_logit_detour(spark, sf):
    """GR-17."""
    rows = two_paths(spark, sf)
    whole = rows.groupBy(*KEY).agg(F.sum("volume").alias("whole"))
    return scenario.logit_split(rows.drop("volume").join(whole, KEY), KEY, "path_cost", "whole").select(*KEY, "path_id", r6("volume").alias("volume"))


# ---- correction, scenario


@query("""SELECT o_zone_id, d_zone_id, agent_type, round(g, 6) AS gradient, round(CASE WHEN g = 0 THEN volume ELSE greatest(1.0, volume - greatest(-volume * 0.1::DOUBLE, least(volume * 0.1::DOUBLE, g * 0.05::DOUBLE))) END, 6) AS new_volume FROM (
SELECT o_zone_id, d_zone_id, agent_type, volume, coalesce((SELECT sum(d) FROM dev WHERE list_contains(path.links, dev.link_id)), 0.0) AS g FROM path)""", "path", "load", "obs", more="dev AS (SELECT link_id, volume - obs_count * 100.0::DOUBLE AS d FROM obs JOIN load USING (link_id) WHERE demand_period = 'am' AND (upper_bound_flag = 0 OR volume > obs_count * 100.0::DOUBLE))")
def od_update_step(spark, sf):
    """OD-01, 02, 03: the morning's counts times a hundred stand for observed volumes."""
    p = free_paths(spark, sf)
    counts = star.link_observations(spark, sf).where("demand_period = 'am'").withColumn("obs_count", C("obs_count") * 100.0)
    off = correction.deviations(assign.loaded(star.costed_links(spark, sf), assign.link_volumes(p)), counts)
    return correction.update_step(p, off).select(*KEY, r6("gradient").alias("gradient"), r6("new_volume").alias("new_volume"))


@query("""SELECT link_id, round(a.minutes, 6) AS minutes_before, round(b.m, 6) AS minutes_after, round(b.m - a.minutes, 6) AS minutes_diff FROM vdf a JOIN (
SELECT link_id, CASE WHEN link_id % 10 = 0 THEN fftt * free_speed / greatest(0.1, free_speed / (1 + 0.15::DOUBLE * (volume / (period_cap * 1.0::DOUBLE / lanes)) ** 4)) ELSE minutes END AS m FROM vdf) b USING (link_id)""", "vdf")
def sc_before_after(spark, sf):
    """SC-01, 03, 06, JN-12: every tenth link is cut to one lane, with the base case's volumes."""
    base = timed(loads(spark, sf))
    changes = star.links(spark, sf).where("link_id % 10 = 0").select("from_node_id", "to_node_id", F.lit(1.0).alias("lanes"))
    after = timed(scenario.lane_changes(loads(spark, sf), changes))
    return reports.before_after(base, after, "link_id", ["minutes"]).select("link_id", *[r6(f"minutes_{s}").alias(f"minutes_{s}") for s in ("before", "after", "diff")])


# ---- queues and streams


@query("SELECT event_id, link_id, round(i * 0.7::DOUBLE + max(t_in - i * 0.7::DOUBLE) OVER (PARTITION BY link_id ORDER BY t_in, event_id), 4) AS depart FROM (SELECT *, row_number() OVER (PARTITION BY link_id ORDER BY t_in, event_id) - 1 AS i FROM trip)", "trip")
def sim_single_link(spark, sf):
    """SIM-05, 06, 08, 14, 15, AGG-22."""
    rows = star.trip_events(spark, sf).withColumns({"h": F.lit(0.7), "ready": C("t_in").cast("double")})
    return queues.single_link(rows, "link_id", "event_id", "ready", "h").select("event_id", "link_id", F.round("depart", 4).alias("depart"))


@query("""SELECT o_zone_id, d_zone_id, agent_type, v, link_id, round(i * h + max(depart_min - i * h) OVER (PARTITION BY link_id ORDER BY depart_min, key) + 1e-7::DOUBLE, 4) AS leave_min FROM (
SELECT *, 60.0::DOUBLE / (lane_capacity * lanes) AS h, row_number() OVER (PARTITION BY link_id ORDER BY depart_min, key) - 1 AS i FROM (
SELECT d.*, links[1] AS link_id, printf('%03d;%03d;%s;%06d', d.o_zone_id, d.d_zone_id, d.agent_type, v) AS key FROM (SELECT o_zone_id, d_zone_id, agent_type, v, round(slot5 + (v / n::DOUBLE - (cum - ratio)) / ratio * 5.0, 6) AS depart_min FROM (
SELECT o_zone_id, d_zone_id, agent_type, n, g.v, (SELECT min(slot5) FROM prof WHERE cum > g.v / n::DOUBLE) AS s FROM (SELECT o_zone_id, d_zone_id, agent_type, floor(volume + 0.5)::INTEGER AS n FROM od), LATERAL (SELECT unnest(range(n))::INTEGER AS v) g) JOIN prof ON slot5 = s) d
JOIN lab ON lab.o = d.o_zone_id AND lab.node = d.d_zone_id) JOIN clink USING (link_id))""", "od", "ev", "lab", "clink", more=_PROFILE)
def sim_origin_queues(spark, sf):
    """SIM-04, 06, 08, 14: vehicles of all segments queue for the first link of their paths."""
    v = demand.vehicles(free_paths(spark, sf), morning_profile(spark, sf)).withColumn("depart_min", r6("depart_min"))
    key = F.format_string("%03d;%03d;%s;%06d", "o_zone_id", "d_zone_id", "agent_type", "v")
    rows = v.select(*KEY, "v", "depart_min", C("links")[0].alias("link_id"), key.alias("key"))
    h = star.links(spark, sf).select("link_id", (F.lit(60.0) / (C("lane_capacity") * C("lanes"))).alias("h"))
    out = queues.single_link(rows.join(broadcast_within(h, 16), "link_id"), "link_id", "key", "depart_min", "h")
    return out.select(*KEY, "v", "link_id", F.round(C("depart") + 1e-7, 4).alias("leave_min"))


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, link_id, count(*) AS n FROM ev GROUP BY ALL", "ev")
def st_slot_counts(spark, sf):
    """Events by link and 5-minute window; the same function runs on a stream (see the tests)."""
    return slots.slot_counts(star.event_times(spark, sf))


@query("""SELECT link_id, from_node_id, to_node_id, round(volume, 4) AS volume, round(minutes, 6) AS minutes, round(speed, 6) AS speed, round(p, 6) AS p, round(vmt, 4) AS vmt, round(vht, 4) AS vht, round(volume * (minutes - fftt) / 60.0, 4) AS delay FROM perf""", "vdf")
def link_performance(spark, sf):
    """The flagship: from order lines to link performance (SNK-01)."""
    rows = performance(spark, sf)
    return rows.select("link_id", "from_node_id", "to_node_id", F.round("volume", 4).alias("volume"), r6("minutes").alias("minutes"), r6("speed").alias("speed"), r6("p").alias("p"), F.round("vmt", 4).alias("vmt"), F.round("vht", 4).alias("vht"), F.round("delay_free", 4).alias("delay"))


# ---- extras


@query("SELECT node AS destination, o AS node, round(cost, 6) AS cost FROM lab", "lab")
def gr_backward_tree(spark, sf):
    """GR-04, 05: the backward tree costs what the forward one does."""
    tree = paths.backward_labels(star.costed_links(spark, sf), star.nodes(spark, sf).select(C("node_id").alias("destination")))
    return tree.select("destination", "node", r6("cost").alias("cost"))


@query("SELECT o AS origin, to_node_id AS node, round(min(w.cost), 6) AS cost FROM walk w JOIN clink USING (link_id) WHERE o <> to_node_id GROUP BY ALL", "net_node", "clink",
more="""walk(o, link_id, cost) USING KEY (o, link_id) AS (SELECT from_node_id, link_id, cost FROM clink UNION SELECT l.o, b.link_id, min(l.cost + b.cost) FROM walk l JOIN clink a ON a.link_id = l.link_id JOIN clink b ON b.from_node_id = a.to_node_id AND (a.link_id + b.link_id) % 9 <> 0
LEFT JOIN recurring.walk r ON r.o = l.o AND r.link_id = b.link_id WHERE r.cost IS NULL OR l.cost + b.cost < r.cost GROUP BY l.o, b.link_id)""")
def gr_turns(spark, sf):
    """GR-03, SRC-29: turns whose links' numbers sum to a multiple of nine are prohibited."""
    net = star.costed_links(spark, sf)
    met = net.select(C("link_id").alias("ib_link_id"), C("to_node_id").alias("via")).join(net.select(C("link_id").alias("ob_link_id"), C("from_node_id").alias("via")), "via")
    ids = met.where("(ib_link_id + ob_link_id) % 9 = 0").select("ib_link_id", "ob_link_id")
    return paths.labels_with_turns(net, ids, star.nodes(spark, sf).select(C("node_id").alias("origin"))).withColumn("cost", r6("cost"))


@query("SELECT link_id, minute::INTEGER AS minute, round(lane_capacity * lanes / 60.0::DOUBLE * CASE WHEN link_id % 10 = 0 AND minute >= 5 AND minute < 20 THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END, 6) AS capacity FROM clink, range(30) r(minute)", "clink")
def sc_incident(spark, sf):
    """SC-08."""
    net = star.links(spark, sf)
    cuts = net.where("link_id % 10 = 0").select("link_id", F.lit(5).alias("start_min"), F.lit(20).alias("end_min"), F.lit(0.4).alias("share"))
    return scenario.incident_capacity(net, cuts, 30).withColumn("capacity", r6("capacity"))


@query("SELECT o AS agent, array_to_string(list_concat(a.links, b.links), ';') AS links FROM lab a JOIN (SELECT o AS m, node AS e, links FROM lab) b ON m = a.node AND e = 25 WHERE a.node = 13 AND o NOT IN (13, 25)", "lab")
def gr_chains(spark, sf):
    """GR-12, SRC-18: every node visits node 13, then node 25."""
    net = star.costed_links(spark, sf)
    best = paths.routes_grouped(net, star.nodes(spark, sf).select(C("node_id").alias("origin")))
    first = best.where("d_zone_id = 13 and o_zone_id not in (13, 25)").select(C("o_zone_id").alias("agent"), F.lit(0).alias("leg"), "links")
    then = best.where("o_zone_id = 13 and d_zone_id = 25").select("links").withColumn("leg", F.lit(1))
    legs = first.unionByName(first.select("agent").crossJoin(F.broadcast(then)).select("agent", "leg", "links"))
    return paths.stitched(legs, "agent", "leg").select("agent", F.array_join("links", ";").alias("links"))
