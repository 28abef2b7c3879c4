"""Queries of readers, output rows and small rules: the derived network in the form of files, with their SQL.

A file's table is text by column with ``_row``, its order; here it is made from the given
tables, so that it grows with them, and has the blanks, repeats and defaults that files have.
They are registered in :data:`catalog.QUERIES` and :data:`catalog.ORACLES` like the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, units, vdf
from ..operators import assign, classes, demand, queues, reports
from ..sources import sinks, tables
from . import star
from .assigned import _labels, period_links
from .catalog import C, free_paths, loads, performance, query, r6, timed


def filed(rows: DataFrame, row, **columns) -> DataFrame:
    """``rows`` as a file's table."""
    return rows.select(row.cast("long").alias("_row"), *[(c if not isinstance(c, str) else F.lit(c)).cast("string").alias(n) for n, c in columns.items()])


def unless(condition, value):
    """The value as text, blank where ``condition`` holds."""
    return F.when(condition, "").otherwise(value.cast("string"))


# ---- readers


@query("""SELECT event_id AS id, 'user ' || user_id || ', day ' || day AS name, CASE WHEN user_id % 7 = 0 THEN -1.0 ELSE user_id / 4.0 END AS value FROM ev""", "ev")
def src_csv_rows(spark, sf):
    """SRC-01, 02: a line for each event, under a header with a mark and blanks, above a blank line and remarks; names have commas in quotes, some numbers are blank or have a unit."""
    e = star.event_times(spark, sf)
    value = unless(C("user_id") % 7 == 0, F.concat((C("user_id") / 4.0).cast("string"), F.when(C("user_id") % 5 == 0, " veh").otherwise("")))
    body = e.select(F.concat(C("event_id").cast("string"), F.lit(',"user '), C("user_id").cast("string"), F.lit(", day "), C("day").cast("string"), F.lit('",'), value, F.lit("\r")).alias("line"), C("event_id").cast("long").alias("_row"))
    ends = spark.createDataFrame([("﻿ id , name,value,", -1), (" ,,", 1 << 40), ("9,remark,1", (1 << 40) + 1)], "line string, _row long")
    rows = tables.from_lines(body.unionByName(ends))
    return rows.select(tables.field(rows, "id", "long", required=True).alias("id"), tables.field(rows, "name", "string", "").alias("name"), tables.field(rows, "value", default=-1.0).alias("value"))


@query("""SELECT node_id::INTEGER AS node_id, CASE WHEN node_id % 4 <> 0 THEN zone_id::INTEGER END AS zone_id, x_coord, y_coord, CASE WHEN node_id % 3 = 0 THEN 'signal' ELSE '' END AS node_type,
CASE WHEN node_id % 5 = 1 THEN 1 ELSE 0 END AS is_boundary, CASE WHEN node_id % 6 = 0 THEN -1 ELSE district_id::INTEGER END AS district_id, '' AS agent_type FROM net_node""", "net_node")
def src_nodes(spark, sf):
    """SRC-11: nodes with blanks, and each a second time with another zone, which is left out."""
    n, k = star.nodes(spark, sf), C("node_id")
    same = {"node_id": k, "x_coord": C("x_coord"), "y_coord": C("y_coord"), "node_type": F.when(k % 3 == 0, "signal").otherwise(""), "is_boundary": F.when(k % 5 == 1, "1").otherwise(""), "district_id": unless(k % 6 == 0, C("district_id"))}
    first = filed(n, k, zone_id=unless(k % 4 == 0, C("zone_id")), **same)
    return tables.nodes(first.unionByName(filed(n, k + 1000, zone_id="99", **same)))


@query("""SELECT node_id, CASE WHEN node_id % 7 <> 0 THEN district_id::INTEGER + 1 END AS zone_id, CASE WHEN node_id % 7 <> 0 THEN 10.5::DOUBLE * (district_id + 1) END AS production, CASE WHEN node_id % 7 <> 0 THEN 0.0::DOUBLE END AS attraction FROM net_node""", "net_node")
def src_zones(spark, sf):
    """SRC-12, JN-06: zones with lists of access nodes, read up to the first item that is no number; every node with its zone, or none."""
    n, k = star.nodes(spark, sf), C("node_id")
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, k))), "; ")
    rows = n.groupBy("district_id").agg(F.concat(listed(k % 7 != 0), F.lit(";x;"), listed(k % 7 == 0)).alias("access"))
    zones = tables.zones(filed(rows, C("district_id"), zone_id=C("district_id") + 1, production=10.5 * (C("district_id") + 1), attraction="", access_node_vector=C("access")))
    return n.select("node_id").join(zones, "node_id", "left")


def link_file(spark, sf) -> DataFrame:
    """Links in falling order of number, with the columns of a second period."""
    n, i = star.links(spark, sf), C("link_id")
    return filed(
        n, 81 - i, link_id=F.concat(F.lit("L"), i.cast("string")), from_node_id=C("from_node_id"), to_node_id=C("to_node_id"),
        length=F.concat(C("length_m").cast("string"), F.when(i % 3 == 0, " m").otherwise("")), lanes=unless(i % 5 == 0, C("lanes")), free_speed=F.when(i % 9 == 0, "0").otherwise(C("free_speed").cast("string")),
        capacity=C("lane_capacity"), link_type=unless(i % 6 == 0, C("link_type")), vdf_code="", VDF_fftt1="99", VDF_fftt2=unless(i % 4 != 0, F.lit(7.5)), VDF_cap2=F.when(i % 6 == 0, "4000").otherwise("-1"),
        VDF_alpha2=unless(i % 2 == 0, F.lit(0.2)), VDF_allowed_uses2=C("allowed_uses"), cycle_length=unless(i % 8 != 0, F.lit(60)), start_green_time="5", end_green_time=F.when(i % 16 == 0, "2").otherwise("30"), VDF_tollbuilding2=F.when(i % 4 == 1, "1.5").otherwise(""), VDF_tollmachinery2=F.when(i % 8 == 1, "2").otherwise("0"), VDF_tollmachinery1="9",
    )


_RAW = """raw AS (SELECT link_id AS i, from_node_id::INTEGER AS f, to_node_id::INTEGER AS t, length_m, CASE WHEN link_id % 5 = 0 THEN 1.0 ELSE lanes END AS lanes, CASE WHEN link_id % 9 = 0 THEN 60.0 ELSE free_speed END AS speed, lane_capacity, allowed_uses, CASE WHEN link_id % 6 = 0 THEN 2 ELSE link_type END AS kind FROM clink)"""


@query("""SELECT (81 - i)::INTEGER AS link_id, 'L' || i AS name, f AS from_node_id, t AS to_node_id, lanes, speed AS free_speed, kind::INTEGER AS link_type, round(CASE WHEN i % 4 = 0 THEN 7.5 ELSE length_m / 1609.0::DOUBLE / speed * 60.0 END, 6) AS fftt,
CASE WHEN i % 6 = 0 THEN 4000.0 ELSE lane_capacity * lanes * 5.0::DOUBLE END AS period_cap, round(speed * 0.85::DOUBLE, 6) AS cutoff, CASE WHEN i % 2 = 0 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END AS alpha, 4.0::DOUBLE AS beta, allowed_uses,
CASE WHEN i % 8 = 0 THEN 60.0::DOUBLE ELSE 0.0 END AS cycle, CASE WHEN i % 16 = 0 THEN 1.0::DOUBLE WHEN i % 8 = 0 THEN 35.0 ELSE 1.0 END AS red, round(greatest(1.0, length_m / 1609.0::DOUBLE * lanes * 300.0), 6) AS room FROM raw""", "clink", more=_RAW)
def src_links(spark, sf):
    """SRC-13, FN-01..05: links of the second period: numbers in file order, lengths with a unit, blanks that take their defaults, given times and capacities, signals."""
    rows = tables.links(link_file(spark, sf), 2, 5.0)
    return rows.select("link_id", "name", "from_node_id", "to_node_id", "lanes", "free_speed", "link_type", r6("fftt").alias("fftt"), "period_cap", r6("cutoff").alias("cutoff"), "alpha", "beta", "allowed_uses", "cycle", "red", r6("room").alias("room"))


@query("""SELECT link_id::INTEGER AS link_id, agent_type, toll FROM (SELECT link_id, 'building' AS agent_type, CASE WHEN link_id % 4 = 1 THEN 1.5::DOUBLE ELSE 0.0 END + CASE WHEN link_id % 10 = 0 THEN 3.0::DOUBLE ELSE 0.0 END AS toll FROM clink
UNION ALL SELECT link_id, 'machinery', CASE WHEN link_id % 8 = 1 THEN 2.0::DOUBLE ELSE 0.0 END FROM clink) WHERE toll <> 0""", "clink")
def src_tolls(spark, sf):
    """SRC-13: tolls by agent type of the second period; of two rows between the same nodes the greatest toll holds."""
    first = link_file(spark, sf)
    more = filed(star.links(spark, sf).where("link_id % 10 = 0"), C("link_id") + 100, from_node_id=C("from_node_id"), to_node_id=C("to_node_id"), VDF_tollbuilding2="3")
    return tables.tolls(first.unionByName(more, allowMissingColumns=True), star.links(spark, sf), 2)


_QDF = """q AS (SELECT link_id, link_type, from_node_id, to_node_id, 0.1::DOUBLE * (link_id % 5) AS qdf, 1.0::DOUBLE + link_id % 3 AS qn FROM clink),
own AS (SELECT * FROM q WHERE link_id % 9 = 0), cls AS (SELECT link_type, avg(qdf) AS qdf, avg(qn) AS qn FROM q WHERE link_type <> 3 GROUP BY link_type), any_ AS (SELECT avg(qdf) AS qdf, avg(qn) AS qn FROM q WHERE link_type = 3)"""


@query("""SELECT c.link_id, round(coalesce(o.qdf, k.qdf, a.qdf), 6) AS qdf, round(coalesce(o.qn, k.qn, a.qn), 6) AS q_n, 0.272876961::DOUBLE AS q_alpha FROM clink c LEFT JOIN own o USING (link_id) LEFT JOIN cls k ON k.link_type = c.link_type, any_ a""", "clink", more=_QDF)
def src_queue_parameters(spark, sf):
    """SRC-14, JN-07, VDF-19, AGG-07: parameters of the link, else the mean of its class, else of class ``all``; a column that the file has not takes the default."""
    n, i = star.links(spark, sf), C("link_id")
    values = {"from_node_id": C("from_node_id"), "to_node_id": C("to_node_id"), "QVDF_qdf1": 0.1 * (i % 5), "QVDF_n1": 1.0 + i % 3}
    code = F.when(C("link_type") == 3, "all").otherwise(F.concat(F.lit("c"), C("link_type").cast("string")))
    rows = filed(n.where(i % 9 == 0), i, data_type="link", vdf_code="", **values).unionByName(filed(n, i + 100, data_type="vdf_code", vdf_code=code, **values))
    own = n.withColumn("vdf_code", F.concat(F.lit("c"), C("link_type").cast("string")))
    return tables.with_queue_parameters(own, *tables.queue_parameters(rows), 4.0).select("link_id", r6("qdf").alias("qdf"), r6("q_n").alias("q_n"), "q_alpha")


_CELLS = "odsum AS (SELECT o_zone_id::INTEGER AS o_zone_id, d_zone_id::INTEGER AS d_zone_id, sum(volume) AS v FROM od GROUP BY ALL)"


def od_sums(spark, sf) -> DataFrame:
    return star.od_demand(spark, sf).groupBy("o_zone_id", "d_zone_id").agg(F.sum("volume").alias("v"))


@query("SELECT o_zone_id, d_zone_id, 'p' AS agent_type, round(v * 1.5::DOUBLE, 6) AS volume FROM odsum", "od", more=_CELLS)
def src_demand_column(spark, sf):
    """SRC-15, FLT-12: a long list of all pairs, with trips inside zones and without volume, which do not count, and more rows after its end mark."""
    rows, o, d = od_sums(spark, sf), C("o_zone_id"), C("d_zone_id")
    whole = filed(rows, o * 100 + d, o_zone_id=o, d_zone_id=d, volume=C("v"))
    inside = filed(star.nodes(spark, sf), C("zone_id") * 100, o_zone_id=C("zone_id"), d_zone_id=C("zone_id"), volume="7")
    empty = filed(star.nodes(spark, sf), C("zone_id") * 100 + 99, o_zone_id=C("zone_id"), d_zone_id="1", volume="0")
    after = filed(rows, 10_000 + o * 100 + d, o_zone_id=o, d_zone_id=d, volume=C("v"))
    mark = spark.createDataFrame([(9_999, "1", "2", "-100")], whole.schema)
    listed = whole.unionByName(inside).unionByName(empty).unionByName(after).unionByName(mark)
    return tables.demand_column(listed, "p", 1.5).withColumn("volume", r6("volume"))


@query("SELECT o_zone_id, d_zone_id, 'p' AS agent_type, round(v * 2, 6) AS volume FROM odsum", "od", more=_CELLS)
def src_demand_matrix(spark, sf):
    """SRC-16: all pairs as a square matrix, whose diagonal does not count."""
    wide = od_sums(spark, sf).groupBy("o_zone_id").pivot("d_zone_id", list(range(1, 26))).agg(F.sum("v"))
    cells = {str(k): F.when(C("o_zone_id") == k, 5.0).otherwise(C(f"`{k}`")) for k in range(1, 26)}
    return tables.demand_matrix(filed(wide, C("o_zone_id"), zone=C("o_zone_id"), **cells), "p", 2.0).withColumn("volume", r6("volume"))


@query("SELECT 'r' || o_zone_id || '.' || d_zone_id AS path_id, o_zone_id, d_zone_id, round(v / 2, 6) AS volume, o_zone_id || '-' || d_zone_id AS nodes FROM odsum", "od", more=_CELLS)
def src_demand_paths(spark, sf):
    """SRC-17, FN-15: a fixed route for each pair; its list of nodes ends with a separator."""
    rows, o, d = od_sums(spark, sf), C("o_zone_id"), C("d_zone_id")
    file = filed(rows, o * 100 + d, path_id=F.concat(F.lit("r"), o.cast("string"), F.lit("."), d.cast("string")), o_zone_id=o, d_zone_id=d, volume=C("v"), node_sequence=F.concat(o.cast("string"), F.lit(";"), d.cast("string"), F.lit(";")))
    return tables.demand_paths(file, "p", 0.5).select("path_id", "o_zone_id", "d_zone_id", r6("volume").alias("volume"), F.array_join("nodes", "-").alias("nodes"))


@query("""SELECT from_node_id::INTEGER AS from_node_id, to_node_id::INTEGER AS to_node_id, CASE WHEN link_id % 11 = 0 THEN obs_count * 2 WHEN link_id % 5 = 0 THEN obs_count + 1 ELSE obs_count END AS obs_count, CASE WHEN link_id % 11 = 0 THEN 1 ELSE 0 END AS upper_bound_flag
FROM obs JOIN clink USING (link_id) WHERE demand_period = 'am'""", "obs", "clink")
def src_measurements(spark, sf):
    """SRC-20: counts of links: an actual count comes before an upper bound, a later row before an earlier; every eleventh link has an upper bound only."""
    n, i = star.link_observations(spark, sf).where("demand_period = 'am'").join(star.links(spark, sf), "link_id"), C("link_id")
    row = lambda rows, at, count, flag: filed(rows, at, measurement_type="link", from_node_id=C("from_node_id"), to_node_id=C("to_node_id"), o_zone_id="", d_zone_id="", count1=count, upper_bound_flag1=flag)
    file = row(n.where(i % 11 != 0), i, C("obs_count"), "0").unionByName(row(n.where(i % 5 == 0).where(i % 11 != 0), i + 100, C("obs_count") + 1, "")).unionByName(row(n, i + 200, C("obs_count") * 2, "1"))
    return tables.measurements(file).select("from_node_id", "to_node_id", "obs_count", "upper_bound_flag")


@query("SELECT from_node_id::INTEGER AS from_node_id, to_node_id::INTEGER AS to_node_id, CASE WHEN link_id % 20 = 0 THEN 0.0 ELSE lanes / 2 END AS lanes FROM clink WHERE link_id % 10 = 0", "clink")
def src_scenario_links(spark, sf):
    """SRC-21: links of one kind of scenario; no lanes means closed."""
    n, i = star.links(spark, sf), C("link_id")
    file = filed(n, i, scenario_type=F.when(i % 10 == 0, "sa").otherwise("dms"), from_node_id=C("from_node_id"), to_node_id=C("to_node_id"), lanes=unless(i % 20 == 0, C("lanes") / 2))
    return tables.scenario_links(file)


@query("""SELECT kind AS scenario_type, CASE WHEN kind = 'd_based' THEN NULL ELSE district_id::INTEGER END AS o_district_id, CASE WHEN kind = 'o_based' THEN NULL ELSE district_id::INTEGER + 1 END AS d_district_id, CASE WHEN district_id = 3 THEN 1.0 ELSE 0.5::DOUBLE * n END AS scale_factor
FROM (SELECT district_id, count(*) AS n FROM net_node GROUP BY district_id), (VALUES ('o_based'), ('d_based'), ('od_based')) k(kind)""", "net_node")
def src_factors(spark, sf):
    """SRC-22: the scenario's district factors, apart from those of the base."""
    n = star.nodes(spark, sf).groupBy("district_id").agg(F.count("*").alias("n")).withColumn("kind", F.explode(F.array(*[F.lit(p + k) for p in ("", "sa_") for k in ("o_based", "d_based", "od_based")])))
    file = filed(n, C("district_id"), scenario_type=C("kind"), o_district_id=unless(C("kind").endswith("d_based") & ~C("kind").endswith("od_based"), C("district_id")), d_district_id=unless(C("kind").endswith("o_based"), C("district_id") + 1), scale_factor=unless(C("district_id") == 3, F.when(C("kind").startswith("sa_"), 0.5 * C("n")).otherwise(F.lit(9.0))))
    return tables.demand_factors(file, True)


@query("""SELECT CASE s WHEN 'building' THEN 'rt' WHEN 'furniture' THEN 'dms' ELSE s END AS agent_type, CASE WHEN s = 'automobile' THEN 10.0 ELSE n / 100.0::DOUBLE END AS vot, CASE WHEN s = 'machinery' THEN 2.0::DOUBLE ELSE 1.0 END AS pce, 1.0::DOUBLE AS occ,
CASE s WHEN 'building' THEN 1 WHEN 'furniture' THEN 2 WHEN 'household' THEN 3 ELSE 0 END AS real_time_info FROM (SELECT lower(c_mktsegment) AS s, count(*) AS n FROM customer GROUP BY ALL)""")
def src_agent_types(spark, sf):
    """SRC-07: agent types, two of which have information by their name; a car equivalent of 0 counts as 1."""
    n = star.table(spark, sf, "customer").groupBy(F.lower("c_mktsegment").alias("s")).agg(F.count("*").alias("n"))
    s = C("s")
    file = filed(n, C("n"), agent_type=F.when(s == "building", "rt").when(s == "furniture", " dms ").otherwise(s), vot=unless(s == "automobile", C("n") / 100.0), pce=F.when(s == "machinery", "2").when(s == "household", "0").otherwise(""), real_time_info=F.when(s == "household", "3").otherwise(""))
    return tables.agent_types(file).select("agent_type", "vot", "pce", "occ", "real_time_info")


@query("""SELECT link_type::INTEGER AS link_type, 'type ' || n AS link_type_name, 'h' AS type_code, CASE WHEN link_type = 2 THEN 'bpr' ELSE 'qvdf' END AS vdf_type, 'spatial_queue' AS flow_model FROM (SELECT link_type, count(*) AS n FROM clink GROUP BY ALL)
UNION ALL SELECT -1, 'connector', 'c', 'bpr', 'spatial_queue'""", "clink")
def src_link_types(spark, sf):
    """SRC-06: link types and the built-in one."""
    n, t = star.links(spark, sf).groupBy("link_type").agg(F.count("*").alias("n")), C("link_type")
    return tables.link_types(filed(n, t, link_type=t, link_type_name=F.concat(F.lit("type "), C("n").cast("string")), type_code="h", vdf_type=F.when(t == 2, "").otherwise("qvdf")))


@query("""SELECT p::INTEGER AS profile_no, h * 60 AS slot5, coalesce(n / 8.0::DOUBLE, 0.0) AS ratio FROM (SELECT DISTINCT user_id % 3 + 1 AS p FROM ev) CROSS JOIN range(24) r(h) LEFT JOIN (SELECT user_id % 3 + 1 AS p, minute // 60 AS h, count(*) AS n FROM ev GROUP BY ALL) USING (p, h)""", "ev")
def src_profiles(spark, sf):
    """SRC-08: departure profiles with a column for each hour."""
    e = star.event_times(spark, sf).withColumn("h", F.floor(C("minute") / 60)).groupBy((C("user_id") % 3 + 1).alias("p")).pivot("h", list(range(24))).count()
    file = filed(e, C("p"), departure_time_profile_no=C("p"), **{f"T{h:02d}00": C(f"`{h}`") / 8.0 for h in range(24)})
    return tables.departure_profiles(file)


@query("""SELECT event_id AS agent_id, (user_id % 25 + 1)::INTEGER AS o_node_id, (event_id % 25 + 1)::INTEGER AS d_node_id, minute + 0.5::DOUBLE AS depart_min, CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 2.5::DOUBLE END AS pce, (event_id % 3 = 0)::INTEGER AS path_fixed_flag,
(user_id % 25 + 1) || '-' || (event_id % 25 + 1) AS nodes FROM ev""", "ev")
def src_agents(spark, sf):
    """SRC-27: an agent for each event."""
    e, o, d = star.event_times(spark, sf), (C("user_id") % 25 + 1).cast("string"), (C("event_id") % 25 + 1).cast("string")
    file = filed(e, C("event_id"), agent_id=C("event_id"), o_node_id=o, d_node_id=d, departure_time_in_min=C("minute") + 0.5, PCE=unless(C("event_id") % 2 == 0, F.lit(2.5)), path_fixed_flag=F.when(C("event_id") % 3 == 0, "1").otherwise(""), path_node_sequence=F.concat(o, F.lit(";"), d, F.lit(";")))
    return tables.agents(file).withColumn("nodes", F.array_join("nodes", "-"))


@query("""SELECT event_id, round(m, 6) AS minutes, floor(m * 60.0 / 6.0)::BIGINT AS step, user_id || '|' || event_id || '|' || day AS parts FROM (SELECT *, minute + CASE event_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1440.0 WHEN 2 THEN 0.5 ELSE 15 / 60.0::DOUBLE + 250 / 60000.0::DOUBLE END AS m FROM ev)""", "ev")
def fn_time_texts(spark, sf):
    """FN-12, 16, 19: times of events in four forms, as minutes and steps of six seconds; texts cut at any of three separators."""
    e, k = star.event_times(spark, sf), C("event_id") % 4
    at = clock.hhmm(C("minute"), "")
    text = F.when(k == 0, F.concat(F.lit("T"), at)).when(k == 1, F.concat(F.lit("01"), at)).when(k == 2, F.concat(at, F.lit(":30"))).otherwise(F.concat(at, F.lit(":15:250")))
    rows = e.select("event_id", clock.minutes_of(text).alias("m"), clock.split_any(F.concat(C("user_id").cast("string"), F.lit(",;"), C("event_id").cast("string"), F.lit(" "), C("day").cast("string"), F.lit(";")), ",; ").alias("p"))
    return rows.select("event_id", r6("m").alias("minutes"), clock.to_steps(C("m"), 6.0).alias("step"), F.array_join("p", "|").alias("parts"))


# ---- scalars


@query("""SELECT link_id, greatest(1, floor(lanes + 0.5))::INTEGER AS pce, round(greatest(1.0, 1 / greatest(0.01::DOUBLE, free_speed / 50)), 6) AS ratio, floor(lane_capacity / 500 / 0.25 + 0.5)::BIGINT AS headway, round(lane_capacity / 45, 6) AS density, round(m, 6) AS m,
round(cutoff * (lane_capacity / 45) * greatest(0.0, (free_speed / cutoff) ** (m / 2) - 1) ** (1 / m), 4) AS flow, round(fftt * (1 + 0.15::DOUBLE * (volume / greatest(1e-5, period_cap)) ** 4), 6) AS minutes FROM (SELECT *, 2 * ln(2.0::DOUBLE) / ln(free_speed / cutoff) AS m FROM clink) JOIN load USING (link_id)""", "clink", "load")
def fn_vehicles(spark, sf):
    """FN-21, 22, 23, VDF-20: vehicles' whole equivalents and headways, the S-shaped curve at the cutoff speed, and the plain volume-delay function on all links."""
    n = loads(spark, sf).withColumn("m", units.s3_exponent(C("free_speed"), C("cutoff")))
    dense = units.critical_density(C("lane_capacity"))
    return n.select("link_id", units.vehicle_pce(C("lanes")).alias("pce"), r6(units.free_time_ratio(C("free_speed") / 50)).alias("ratio"), units.headway_steps(C("lane_capacity") / 500).alias("headway"), r6(dense).alias("density"), r6("m").alias("m"), F.round(units.s3_flow(C("cutoff"), C("free_speed"), dense, C("m")), 4).alias("flow"), r6(vdf.bpr_minutes(C("fftt"), C("volume"), C("period_cap"))).alias("minutes"))


# ---- routes and demand


@query("""SELECT event_id, round(cost, 6) AS cost, array_to_string(links, ';') AS links FROM ev LEFT JOIN lab0 ON o = user_id % 25 + 1 AND node = event_id % 25 + 1 WHERE user_id % 25 <> event_id % 25""", "ev", "clink", "net_node",
more=f"""begin1 AS (SELECT node_id AS o FROM net_node), e0 AS (SELECT link_id, from_node_id, to_node_id, fftt + link_id * 1e-9::DOUBLE AS c FROM clink), {_labels('lab0', 'e0', 'begin1')}""")
def gr_agent_routes(spark, sf):
    """GR-19: the route of every event's agent; each pair is searched once."""
    types = [classes.AgentType("all")]
    net = classes.costed(period_links(spark, sf, ("am",)).withColumns({"minutes": C("fftt"), "allowed_uses": F.lit("")}), types)
    agents = star.event_times(spark, sf).select(F.lit("am").alias("demand_period"), F.lit("all").alias("agent_type"), (C("user_id") % 25 + 1).alias("o_zone_id"), (C("event_id") % 25 + 1).alias("d_zone_id"), "event_id").where("o_zone_id <> d_zone_id")
    return classes.agent_routes(agents, net, types).select("event_id", r6("cost").alias("cost"), F.array_join("links", ";").alias("links"))


_TWO_STEPS = f"""begin1 AS (SELECT node_id AS o FROM net_node),
e0 AS (SELECT link_id, from_node_id, to_node_id, fftt + link_id * 1e-9::DOUBLE AS c FROM clink),
{_labels('lab0', 'e0', 'begin1')},
load0 AS (SELECT link_id, sum(volume) AS v FROM (SELECT volume, unnest(links) AS link_id FROM od JOIN lab0 ON o = o_zone_id AND node = d_zone_id) GROUP BY link_id),
e1 AS (SELECT c.link_id, from_node_id, to_node_id, fftt * free_speed / greatest(0.1, free_speed / (1 + 0.15::DOUBLE * (coalesce(v, 0.0) / period_cap) ** 4)) + c.link_id * 1e-9::DOUBLE AS c FROM clink c LEFT JOIN load0 USING (link_id)),
{_labels('lab1', 'e1', 'begin1')},
load1 AS (SELECT link_id, sum(volume) AS v FROM (SELECT volume, unnest(links) AS link_id FROM od JOIN lab1 ON o = o_zone_id AND node = d_zone_id) GROUP BY link_id)"""


@query("SELECT link_id, round(coalesce(a.v, 0.0) / 2 + coalesce(b.v, 0.0) / 2, 4) AS volume FROM clink LEFT JOIN load0 a USING (link_id) LEFT JOIN load1 b USING (link_id)", "od", "clink", "net_node", more=_TWO_STEPS)
def gr_link_based(spark, sf):
    """GR-13: two iterations of link-based loading, all demand."""
    out = assign.link_based(star.costed_links(spark, sf).drop("cost"), star.od_demand(spark, sf), 2, timed)
    return out.select("link_id", F.round("volume", 4).alias("volume"))


@query("""SELECT o_zone_id, d_zone_id, agent_type, 'unserved' AS what, round(volume, 6) AS volume FROM od WHERE d_zone_id = 25 UNION ALL SELECT o_zone_id, d_zone_id, agent_type, 'physical', round(volume, 6) FROM od WHERE d_zone_id <> 25""", "od")
def flt_served(spark, sf):
    """FLT-10: demand to a node that no link enters has no path; stays inside a zone have one without links, and both are never on the road."""
    od = star.od_demand(spark, sf).withColumn("demand_period", F.lit("am"))
    types = [classes.AgentType(r[0]) for r in od.select("agent_type").distinct().collect()]
    net = period_links(spark, sf, ("am",)).where("to_node_id <> 25").withColumns({"minutes": C("fftt"), "allowed_uses": F.lit("")})
    stays = od.withColumns({"d_zone_id": C("o_zone_id"), "links": F.array().cast("array<int>")})
    ways = od.join(classes.best_routes(classes.costed(net, types), od, types).drop("cost"), classes.CELL)
    columns = ways.unionByName(stays)
    rows = lambda df, what: df.select("o_zone_id", "d_zone_id", "agent_type", F.lit(what).alias("what"), r6("volume").alias("volume"))
    return rows(classes.unserved(od, columns), "unserved").unionByName(rows(classes.physical(columns), "physical"))


@query("SELECT event_id, minute FROM (SELECT *, row_number() OVER (ORDER BY minute, event_id) AS n FROM ev WHERE link_id % 10 = 0) WHERE (n - 1) % 7 = 0 AND n <= 7 * 50", "ev")
def flt_sampled(spark, sf):
    """FLT-11: every seventh vehicle in order of time, of those on every tenth link, fifty at most."""
    return queues.sampled(star.event_times(spark, sf), ["minute", "event_id"], 7, 50, C("link_id") % 10 == 0).select("event_id", "minute")


@query("""SELECT 'marked' AS kind, node_id, node_id AS zone_id FROM net_node WHERE node_id % 5 = 1 UNION ALL SELECT 'every tenth', node_id, node_id FROM net_node WHERE node_id % 10 = 0""", "net_node")
def dm_sampled_zones(spark, sf):
    """DM-11: boundary nodes as zones, and every tenth node where no node is marked."""
    n = star.nodes(spark, sf)
    kind = lambda rows, k: demand.sampled_zones(rows).select(F.lit(k).alias("kind"), "node_id", "zone_id")
    return kind(n.withColumn("is_boundary", (C("node_id") % 5 == 1).cast("int")), "marked").unionByName(kind(n.withColumn("is_boundary", F.lit(0)), "every tenth"))


@query("SELECT node_id, round(5000.0::DOUBLE / count(*) OVER (PARTITION BY district_id), 6) AS production FROM net_node", "net_node")
def dm_node_production(spark, sf):
    """DM-12: a district's production shared by its nodes."""
    return demand.node_production(star.nodes(spark, sf).withColumn("zone_id", C("district_id"))).select("node_id", r6("production").alias("production"))


@query("""SELECT CASE WHEN a.node_id % 3 = 0 THEN 'inside' ELSE 'outside' END AS from_, round(sum(volume) FILTER (WHERE d_zone_id % 3 = 0), 6) AS inside, round(sum(volume) FILTER (WHERE d_zone_id % 3 <> 0), 6) AS outside FROM od JOIN net_node a ON a.zone_id = o_zone_id GROUP BY ALL""", "od", "net_node")
def agg_inside_outside(spark, sf):
    """AGG-08: volumes between every third zone and the others."""
    flags = star.nodes(spark, sf).select("zone_id", (C("zone_id") % 3 == 0).alias("inside"))
    return reports.inside_outside(star.od_demand(spark, sf), flags).select("from_", r6("inside").alias("inside"), r6("outside").alias("outside"))


# ---- vehicles and output rows


@query("SELECT path_id, count(*) AS n, round(avg(m), 6) AS minutes FROM (SELECT agent_id, agent_id % 6 AS path_id, (max(t_out) - min(t_in))::DOUBLE AS m FROM trip GROUP BY agent_id) GROUP BY path_id HAVING count(*) > 1", "trip")
def agg_path_times(spark, sf):
    """AGG-18, JN-19: mean minutes by path, of paths with more than one vehicle."""
    visits = star.trip_events(spark, sf)
    agents = visits.select("agent_id").distinct().withColumn("path_id", C("agent_id") % 6)
    return queues.path_times(visits, agents).withColumn("minutes", r6("minutes"))


@query("SELECT t_in // 10 * 10 AS minute, count(*) AS entries, round(avg(t_out - t_in), 6) AS minutes FROM trip GROUP BY ALL", "trip")
def sim_counters(spark, sf):
    """SIM-13: entries and mean minutes on a link by ten minutes."""
    return queues.network_counters(star.trip_events(spark, sf)).withColumn("minutes", r6("minutes"))


@query("SELECT link_id, day, n, n - coalesce(lag(n) OVER (PARTITION BY link_id ORDER BY day), 0.0) AS delta FROM (SELECT link_id, day, count(*)::DOUBLE AS n FROM ev GROUP BY ALL)", "ev")
def win_deltas(spark, sf):
    """WIN-04: the change of each link's count from one day to the next."""
    n = star.event_times(spark, sf).groupBy("link_id", "day").agg(F.count("*").cast("double").alias("n"))
    return reports.deltas(n, "link_id", "day", "n")


@query("""SELECT link_id, demand_period, round(volume, 6) AS volume FROM (SELECT link_id, 'am' AS demand_period, volume, CASE WHEN link_id % 4 = 0 THEN 0.0 ELSE volume END AS v FROM load) WHERE link_id % 13 <> 0 AND (v >= 0.001 OR link_id % 8 = 0)""", "load")
def snk_link_rows(spark, sf):
    """FLT-01, 02: connectors (every thirteenth link) have no row, nor have links without volume (every fourth) unless they have a scenario code."""
    n, i = loads(spark, sf), C("link_id")
    rows = n.withColumns({"link_type": F.when(i % 13 == 0, -1).otherwise(C("link_type")), "own": C("volume"), "volume": F.when(i % 4 == 0, 0.0).otherwise(C("volume")), "scenario_code": F.when(i % 8 == 0, "sa")})
    return sinks.link_rows(rows, "am").select("link_id", "demand_period", r6("own").alias("volume"))


@query("SELECT o_zone_id, d_zone_id, agent_type, round(volume, 6) AS volume, round(path_cost, 6) AS path_cost, array_to_string(links, ';') AS link_sequence, len(links)::INTEGER AS n_links FROM path WHERE volume >= 2", "path")
def snk_routes(spark, sf):
    """SNK-02, FN-18, FLT-06: rows of paths of two trips or more."""
    return sinks.route_rows(free_paths(spark, sf), 2.0).withColumns({"volume": r6("volume"), "path_cost": r6("path_cost")})


@query("SELECT o_zone_id, d_zone_id, agent_type, round(volume, 6) AS volume, CASE WHEN volume >= 5 THEN round(volume, 6) ELSE 0.0 END AS path_volume, CASE WHEN volume >= 5 THEN round(path_cost, 6) ELSE -1.0 END AS path_cost, (volume >= 5)::INTEGER AS connectivity FROM path", "path")
def snk_accessibility(spark, sf):
    """SNK-03, JN-11: every demand cell; those without a path (here, of under five trips) are not connected."""
    rows = sinks.accessibility_rows(star.od_demand(spark, sf), free_paths(spark, sf).where("volume >= 5"))
    return rows.withColumns({c: r6(c) for c in ("volume", "path_volume", "path_cost")})


@query("SELECT link_id, round(volume, 6) AS volume, round(doc, 6) AS doc, round(p, 6) AS p, round(t0, 6) AS t0, round(t3, 6) AS t3, round(vt2, 6) AS vt2, round(mu, 6) AS mu FROM perf WHERE volume >= 1", "vdf")
def snk_queue_rows(spark, sf):
    """SNK-04, FLT-03: queue parameters of links with a volume."""
    return sinks.queue_rows(performance(spark, sf)).select("link_id", *[r6(c).alias(c) for c in ("volume", "doc", "p", "t0", "t3", "vt2", "mu")])


@query("""SELECT c.link_id, minute, ca::BIGINT AS ca, cd::BIGINT AS cd, (ca - cd)::BIGINT AS queue, round((ca - cd) / (length_m / 1609.0::DOUBLE * lanes), 6) AS density FROM (
SELECT link_id, minute, sum(sum(a)) OVER w AS ca, sum(sum(d)) OVER w AS cd FROM (SELECT link_id, t_in AS minute, 1 AS a, 0 AS d FROM trip UNION ALL SELECT link_id, t_out, 0, 1 FROM trip) GROUP BY link_id, minute WINDOW w AS (PARTITION BY link_id ORDER BY minute)) c JOIN clink USING (link_id)""", "trip", "clink")
def snk_time_dependent(spark, sf):
    """SNK-05: counts, queue and density by link and minute."""
    rows = sinks.td_rows(reports.cumulative(star.trip_events(spark, sf)), star.links(spark, sf))
    return rows.select("link_id", "minute", "ca", "cd", "queue", r6("density").alias("density"))


@query("SELECT agent_id, min(t_in) AS departure, max(t_out) AS arrival, sum(t_out - t_in)::BIGINT AS wait, max(t_out) - min(t_in) AS minutes FROM trip GROUP BY agent_id", "trip")
def snk_agent_rows(spark, sf):
    """SNK-07: a row for each vehicle."""
    return sinks.agent_rows(star.trip_events(spark, sf).withColumn("wait", C("t_out") - C("t_in"))).drop("departure_text")


@query("SELECT agent_id, string_agg(link_id::VARCHAR, ';' ORDER BY t_in, link_id, t_out) AS link_sequence, string_agg(t_in::VARCHAR, ';' ORDER BY t_in, link_id, t_out) AS time_sequence FROM trip GROUP BY agent_id", "trip")
def snk_trajectory_rows(spark, sf):
    """SNK-08: link and time sequences of each vehicle."""
    return sinks.trajectory_rows(star.trip_events(spark, sf))


@query("SELECT 'link' AS measurement_type, from_node_id, to_node_id, round(period_cap / 3, 6) AS count1, 0 AS upper_bound_flag1 FROM clink WHERE link_id % 10 = 0", "clink")
def snk_measurements(spark, sf):
    """SNK-19: a default measurement table."""
    return sinks.measurement_rows(star.costed_links(spark, sf)).withColumn("count1", r6("count1"))


@query("SELECT link_id, round(sum(volume), 6) AS background_volume FROM (SELECT volume, unnest(links) AS link_id FROM path WHERE volume < 10) GROUP BY link_id", "path")
def snk_background(spark, sf):
    """SNK-20, AGG-09: volumes of paths of under ten trips."""
    return sinks.background_volume(free_paths(spark, sf), 10.0).withColumn("background_volume", r6("background_volume"))
