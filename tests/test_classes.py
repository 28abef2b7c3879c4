"""Assignment of several classes, fixed routes, centroids, counts and signs, on small networks and from folders."""

import pytest
from pyspark.sql import functions as F

from arterial.operators import assign, classes, correction, paths, run, scenario
from tests.test_assignment import TRACE, minutes, two_corridors

LINK = "demand_period string, link_id int, from_node_id int, to_node_id int, minutes double, allowed_uses string"
CELLS = "demand_period string, agent_type string, o_zone_id int, d_zone_id int, volume double"


def still(links):
    """Times that do not follow volumes."""
    return links


def network(spark, rows):
    return spark.createDataFrame([("am", *r) for r in rows], LINK)


def by_links(columns):
    return {(r["agent_type"], r["o_zone_id"], r["d_zone_id"], tuple(r["links"]), r["state"]): r["volume"] for r in columns.collect()}


def test_the_trace_of_two_corridors_is_the_same(spark):
    od = spark.createDataFrame([("am", "p", 1, 2, 7000.0)], CELLS)
    columns, trace = classes.assign(two_corridors(spark).withColumn("demand_period", F.lit("am")), od, [classes.AgentType("p")], 6, minutes)
    for r, (t, g) in zip(trace.orderBy("iteration").collect()[2:], TRACE):
        assert r["total_minutes"] / 7000 == pytest.approx(t, abs=6e-4) and r["gap"] == pytest.approx(g, abs=1e-5)
    assert sum(by_links(columns).values()) == pytest.approx(7000)


@pytest.mark.parametrize("bytes_", [paths.NETWORK_BYTES, 0])
def test_uses_and_tolls_choose_the_route(spark, monkeypatch, bytes_):
    monkeypatch.setattr(paths, "NETWORK_BYTES", bytes_)
    net = network(spark, [(1, 1, 2, 1.0, "car;bus"), (2, 1, 3, 2.0, ""), (3, 3, 2, 2.0, "all"), (4, 1, 2, 9.0, "")])
    tolls = spark.createDataFrame([("am", 1, "bus", 2.0)], "demand_period string, link_id int, agent_type string, toll double")
    od = spark.createDataFrame([("am", t, 1, 2, v) for t, v in (("car", 10.0), ("bus", 5.0), ("truck", 3.0))] + [("am", "car", 2, 1, 7.0)], CELLS)
    types = [classes.AgentType("bus", vot=20.0, pce=3.0, occ=30.0), classes.AgentType("car"), classes.AgentType("truck", pce=2.0)]
    columns, _ = classes.assign(net, od, types, 1, still, tolls)
    # a toll of 2 at 20 an hour is 6 minutes: the bus goes round, the truck must
    assert by_links(columns) == {("car", 1, 2, (1,), "generated"): 10.0, ("bus", 1, 2, (2, 3), "generated"): 5.0, ("truck", 1, 2, (2, 3), "generated"): 3.0}
    load = {r["link_id"]: (r["volume"], r["persons"]) for r in classes.loads(columns, types).collect()}
    assert load == {1: (10.0, 10.0), 2: (21.0, 153.0), 3: (21.0, 153.0)}
    assert [(r["o_zone_id"], r["volume"]) for r in classes.unserved(od, columns).collect()] == [(2, 7.0)]
    cost = {(r["agent_type"], tuple(r["links"])): r["path_cost"] for r in classes.column_costs(columns.withColumn("links", F.array(F.lit(1))), classes.costed(net, types), types, tolls).collect()}
    assert cost["bus", (1,)] == pytest.approx(7.0) and cost["car", (1,)] == pytest.approx(1.0)


@pytest.mark.parametrize("bytes_", [paths.NETWORK_BYTES, 0])
def test_no_path_passes_a_centroid(spark, monkeypatch, bytes_):
    monkeypatch.setattr(paths, "NETWORK_BYTES", bytes_)
    # zone 9 has access at both ends of the long link: through it would be a short cut
    net = network(spark, [(1, 1, 2, 50.0, ""), (2, 2, 3, 1.0, ""), (3, 4, 3, 1.0, "")])
    access = spark.createDataFrame([(1, 1), (3, 3), (9, 1), (9, 2), (5, 2), (5, 4), (7, 3)], "zone_id int, node_id int")
    od = spark.createDataFrame([("am", "p", 1, 3, 1.0), ("am", "p", 9, 3, 2.0), ("am", "p", 3, 7, 4.0), ("am", "p", 5, 3, 6.0)], CELLS)
    types = [classes.AgentType("p")]
    columns, _ = classes.assign(classes.connected(net, access), od, types, 1, still, centroids=True)
    got = by_links(columns)
    assert got.pop(("p", 5, 3, (2,), "generated"), None) or got.pop(("p", 5, 3, (3,), "generated"))
    assert got == {("p", 1, 3, (1, 2), "generated"): 1.0, ("p", 9, 3, (2,), "generated"): 2.0, ("p", 3, 7, (), "generated"): 4.0}
    assert ("p", 3, 7, (), "generated") not in by_links(classes.physical(columns))


def test_only_demanded_pairs_leave_the_search(spark):
    n = 30
    rows = [(i + 1, i, i + 1, 1.0, "") for i in range(n)]
    demand = spark.createDataFrame([("am", "p", 0, 3, 1.0), ("am", "p", 0, n, 1.0), ("am", "q", 5, 6, 1.0), ("am", "p", 4, 4, 1.0), ("am", "none", 0, 1, 1.0)], CELLS)
    types = [classes.AgentType("p"), classes.AgentType("q")]
    got = classes.best_routes(classes.costed(network(spark, rows), types), demand, types).collect()
    assert {(r["agent_type"], r["o_zone_id"], r["d_zone_id"], len(r["links"])) for r in got} == {("p", 0, 3, 3), ("p", 0, n, n), ("q", 5, 6, 1)} and len(got) == 3


def test_large_numbers_stay_exact(spark):
    big = 2**53
    net = spark.createDataFrame([("am", big + 1, big + 3, big + 5, 1.0, "")], LINK.replace(" int", " long"))
    demand = spark.createDataFrame([("am", "p", big + 3, big + 5, 1.0)], CELLS.replace(" int", " long"))
    types = [classes.AgentType("p")]
    r = classes.best_routes(classes.costed(net, types), demand, types).first()
    assert (r["o_zone_id"], r["d_zone_id"], r["links"]) == (big + 3, big + 5, [big + 1])


def test_fixed_routes_keep_their_volume(spark):
    links = two_corridors(spark).withColumn("demand_period", F.lit("am"))
    routes = spark.createDataFrame([("am", "p", 1, 2, 500.0, [1, 4, 2]), ("am", "p", 1, 2, 100.0, [1, 4, 2]), ("am", "p", 1, 2, 7.0, [1, 2])], CELLS + ", nodes array<int>")
    fixed, lost = classes.fixed_columns(routes, links)
    assert [r["volume"] for r in lost.collect()] == [7.0]
    od = spark.createDataFrame([("am", "p", 1, 2, 6400.0)], CELLS)
    types = [classes.AgentType("p")]
    columns, _ = classes.assign(links, od, types, 4, minutes, fixed=fixed)
    columns = classes.updates(columns, links, types, 2, minutes)
    got = by_links(columns)
    assert got["p", 1, 2, (3, 4), "fixed"] == 600.0 and sum(got.values()) == pytest.approx(7000)
    counts = spark.createDataFrame([("am", 3, 900.0, 0)], "demand_period string, link_id int, obs_count double, upper_bound_flag int")
    after = by_links(correction.correct_columns(columns, links, counts, types, 3)[0])
    assert after["p", 1, 2, (3, 4), "fixed"] == 600.0 and after != got


def test_correction_by_counted_links_is_that_by_all_links(spark, monkeypatch):
    monkeypatch.setattr(correction, "REPLAYED", 3)
    links = two_corridors(spark)
    p = spark.createDataFrame([(1, 2, "p", [1, 2], 5600.0), (1, 2, "p", [3, 4], 1400.0), (2, 1, "p", [4], 3.0), (3, 1, "p", [], 2.0)], "o_zone_id int, d_zone_id int, agent_type string, links array<int>, volume double")
    counts = spark.createDataFrame([(1, 5000.0, 0), (3, 2500.0, 0), (4, 9000.0, 1), (2, 0.0, 0)], "link_id int, obs_count double, upper_bound_flag int")
    want, want_trace = correction.correct(p, links, counts, minutes, steps=10)
    got, trace = correction.correct_columns(p.withColumns({"demand_period": F.lit("am"), "state": F.lit("generated")}), links.withColumn("demand_period", F.lit("am")), counts.withColumn("demand_period", F.lit("am")), [classes.AgentType("p")], 10)
    volumes = lambda df: {(r["o_zone_id"], tuple(r["links"])): round(r["volume"], 8) for r in df.collect()}
    assert volumes(got) == volumes(want)
    assert [r["mape"] for r in trace.orderBy("step").collect()] == pytest.approx([r["mape"] for r in want_trace.orderBy("step").collect()])


def test_a_sign_leads_drivers_round_a_closed_link(spark):
    # 1 -> 2 -> 3, and a way round 2 -> 4 -> 3; link 2 is cut, the sign stands on link 1
    rows = [(1, 1, 2, 1.0, ""), (2, 2, 3, 2.0, ""), (3, 2, 4, 3.0, ""), (4, 4, 3, 3.0, "")]
    base = network(spark, rows).withColumns({"lanes": F.lit(2.0), "period_cap": F.lit(100.0), "fftt": F.col("minutes"), "doc": F.lit(0.0)})
    changed = scenario.lane_changes(base, spark.createDataFrame([(2, 3, 0.001)], "from_node_id int, to_node_id int, lanes double"))
    free = lambda df: df.withColumns({"minutes": F.col("fftt"), "doc": F.lit(0.0)})
    columns = spark.createDataFrame([("am", t, 1, 3, [1, 2], "generated", 100.0) for t in ("sign", "deaf")] + [("am", "sign", 1, 3, [1, 2], "fixed", 40.0)], "demand_period string, agent_type string, o_zone_id int, d_zone_id int, links array<int>, state string, volume double")
    kinds = spark.createDataFrame([("sign", 2), ("deaf", 0)], "agent_type string, real_time_info int")
    signs = spark.createDataFrame([(1, 2, 2)], "link_id int, node_id int, zone_id int")
    types = [classes.AgentType("deaf"), classes.AgentType("sign")]
    out, trace = scenario.reassign_classes(changed, columns, types, free, 1, base=base, informed_types=kinds, signs=signs)
    got = by_links(out)
    assert got["deaf", 1, 3, (1, 2), "generated"] == 100.0 and got["sign", 1, 3, (1, 2), "fixed"] == 40.0
    assert got["sign", 1, 3, (1, 3, 4), "spliced"] > 99 and sum(got.values()) == pytest.approx(240)
    assert trace.count() == 2


def test_shifts_stay_with_affected_pairs_of_informed_types(spark):
    rows = [(1, 1, 2, 10.0, ""), (2, 1, 2, 20.0, ""), (3, 3, 4, 10.0, ""), (4, 3, 4, 20.0, "")]
    base = network(spark, rows).withColumns({"lanes": F.lit(2.0), "period_cap": F.lit(100.0), "fftt": F.col("minutes"), "doc": F.lit(0.0), "design_flag": F.when(F.col("link_id") == 1, -1).otherwise(0)})
    schema = "demand_period string, agent_type string, o_zone_id int, d_zone_id int, links array<int>, state string, volume double"
    columns = spark.createDataFrame([("am", t, o, o + 1, [x], "generated", 50.0) for t in ("told", "deaf") for o, x in ((1, 1), (1, 2), (3, 3), (3, 4))], schema)
    rows = classes.column_costs(columns, classes.costed(base, [classes.AgentType("told"), classes.AgentType("deaf")]), [])
    only = (F.col("agent_type") == "told") & (F.col("o_zone_id") == 1)
    got = by_links(classes.column_update(rows, 0, only))
    changed = {k[:4] for k, v in got.items() if v != 50.0}
    assert changed == {("told", 1, 2, (1,)), ("told", 1, 2, (2,))} and got["told", 1, 2, (2,), "generated"] == 0.0


# ---- folders

NODES = "node_id,zone_id,x_coord,y_coord\n1,1,0.0,0.0\n2,2,0.3,0.0\n3,,0.15,0.1\n4,,0.15,-0.1\n5,,0.0,0.1\n"
LINKS = (
    "link_id,from_node_id,to_node_id,length,lanes,free_speed,capacity,link_type,VDF_fftt2,VDF_allowed_uses1,VDF_tollcar1\n"
    "a,1,3,16090,1,60,4000,1,99,,0\nb,3,2,16090,1,60,4000,1,99,,0\nc,1,4,24135,1,60,3000,1,,,0\nd,4,2,24135,1,60,3000,1,,,0\ne,5,3,1609,1,60,9000,1,99,truck,0\n"
)
SETTINGS = (
    "[assignment],,assignment_mode,column_generation_iterations,column_updating_iterations,odme_iterations\n,,ue,{n},0,4\n[agent_type],agent_type,name,vot,pce,occ\n,car,car,10,1,1.5\n,truck,truck,20,2,1\n"
    "[demand_period],demand_period_id,demand_period,time_period\n,1,am,0700_0800\n,2,pm,1500_1700\n[demand_file_list],file_sequence_no,file_name,demand_period,agent_type,format_type,scale_factor\n{files}"
)


def folder_of(tmp_path, files, **texts):
    texts = {"node": NODES, "link": LINKS} | texts
    texts["settings"] = SETTINGS.format(n=texts.pop("n", 2), files="".join(f",{i},{f}\n" for i, f in enumerate(files)))
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_all_periods_and_types_are_run(spark, tmp_path):
    place = folder_of(tmp_path, ["am.csv,am,car,column,1", "pm.csv,pm,truck,column,1", "way.csv,am,truck,path,2"], am="o_zone_id,d_zone_id,volume\n1,2,100\n", pm="o_zone_id,d_zone_id,volume\n1,2,900\n2,1,5\n", way="path_id,o_zone_id,d_zone_id,volume,node_sequence\nx,1,2,250,1;4;2;\ny,1,2,3,1;2\n", zone="zone_id,access_node_vector\n1,1;5\n2,2\n")
    out = run.run(spark, place, str(tmp_path / "out"))
    got = {(r["demand_period"], r["agent_type"], tuple(r["links"]), r["state"]): r["volume"] for r in out.paths.collect()}
    # the car may not use link 5, which the second access node of its zone needs; a truck may, but not in vain at 99 minutes in the afternoon
    assert got == {("am", "car", (1, 2), "generated"): pytest.approx(100), ("am", "truck", (3, 4), "fixed"): 500.0, ("pm", "truck", (3, 4), "generated"): pytest.approx(900)}
    load = {(r["demand_period"], r["link_id"]): (r["volume"], r["persons"]) for r in out.performance.collect()}
    assert load["am", 1] == (pytest.approx(100), pytest.approx(150)) and load["am", 3] == (1000.0, 500.0) and load["pm", 3] == (pytest.approx(1800), pytest.approx(900)) and load["pm", 1] == (0, 0)
    times = {(r["demand_period"], r["link_id"]): r["fftt"] for r in out.performance.collect()}
    assert times["pm", 1] == 99 and times["am", 1] == 10
    assert sorted((r["reason"], r["volume"]) for r in out.unserved.collect()) == [("fixed route without links", 6.0), ("no path", 5.0)]
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / "link_performance")).collect()
    assert {(r["demand_period"], r["link_id"]) for r in rows} == {("am", "1"), ("am", "2"), ("am", "3"), ("am", "4"), ("pm", "3"), ("pm", "4")}


def test_a_zone_splits_over_its_access_nodes(spark, tmp_path):
    links = LINKS.replace(",truck,", ",,").replace("c,1,4,24135", "c,1,4,241350")
    place = folder_of(tmp_path, ["am.csv,am,car,column,1"], am="o_zone_id,d_zone_id,volume\n1,2,9000\n", link=links, zone="zone_id,access_node_vector\n1,1;5\n2,2\n", n=6)
    (tmp_path / "link.csv").write_text(links.replace("e,5,3,1609,1,60,9000", "e,5,3,16090,1,60,4000"), encoding="utf-8")
    got = {tuple(r["links"]): r["volume"] for r in run.run(spark, place).paths.collect()}
    assert set(got) == {(1, 2), (5, 2)} and sum(got.values()) == pytest.approx(9000) and min(got.values()) > 1000


def test_counts_and_tolls_of_a_folder_act(spark, tmp_path):
    tolled = LINKS.replace("16090,1,60,4000,1,99,,0\nb", "16090,1,60,4000,1,99,,9\nb")
    place = folder_of(tmp_path, ["am.csv,am,car,column,1"], am="o_zone_id,d_zone_id,volume\n1,2,100\n", link=tolled, measurement="measurement_type,from_node_id,to_node_id,o_zone_id,d_zone_id,count1,count,upper_bound_flag1\nlink,1,4,,,50,,0\nproduction,,,1,,,80,\nattraction,,,,2,,120,\n")
    out = run.run(spark, place)
    got = {tuple(r["links"]): r["volume"] for r in out.paths.collect()}
    # a toll of 9 at 10 an hour is 54 minutes, so all take the longer way; counts then pull its volume down
    assert set(got) == {(3, 4)} and got[3, 4] == pytest.approx(100 - 2.5 - 0.05 * 47.5 - 0.05 * 45.125 - 0.05 * 42.86875)
    log = [(r["iteration"], r["value"]) for r in out.summary.where("stage = 'correction'").orderBy("iteration").collect()]
    assert [i for i, _ in log] == [0, 1, 2, 3] and log[0][1] == pytest.approx(100) and log[3][1] < log[0][1]
    errors = {(r["measurement_type"], r["zone_id"]): r["deviation"] for r in out.zone_errors.collect()}
    assert errors["production", 1] == pytest.approx(got[3, 4] - 80) and errors["attraction", 2] == pytest.approx(got[3, 4] - 120)


def test_factors_and_profiles_of_a_folder_act(spark, tmp_path):
    nodes = "node_id,zone_id,x_coord,y_coord,district_id\n1,1,0.0,0.0,1\n2,2,0.3,0.0,2\n3,,0.15,0.1,\n4,,0.15,-0.1,\n"
    place = folder_of(tmp_path, ["am.csv,am,car,column,1"], node=nodes, am="o_zone_id,d_zone_id,volume\n1,2,100\n", demand_side_scenario="scenario_type,o_district_id,d_district_id,scale_factor\no_based,1,,1.5\nsa_od_based,1,2,2\n", supply_side_scenario="scenario_type,from_node_id,to_node_id,lanes\nsa,4,2,2\n", link=LINKS.replace("e,5,3,1609,1,60,9000,1,99,truck,0\n", ""))
    settings = (tmp_path / "settings.csv").read_text() + "[departure_time_profile],departure_time_profile_no,T0700,T0705\n,1,0.5,0.5\n"
    (tmp_path / "settings.csv").write_text(settings, encoding="utf-8")
    out = run.run(spark, place)
    assert out.paths.agg(F.sum("volume")).first()[0] == pytest.approx(150) and out.scenario_paths.agg(F.sum("volume")).first()[0] == pytest.approx(300)
    times = [r["depart_min"] for r in out.agents.collect()]
    assert len(times) == 150 and min(times) == 420 and max(times) < 430


def test_a_queue_function_by_link_type(spark, tmp_path):
    place = folder_of(tmp_path, ["am.csv,am,car,column,1"], am="o_zone_id,d_zone_id,volume\n1,2,3000\n", link_qvdf="data_type,from_node_id,to_node_id,vdf_code,QVDF_qdf1,QVDF_alpha1,QVDF_beta1\nlink,1,3,,0.5,0.5,2\n", n=1)
    settings = (tmp_path / "settings.csv").read_text() + "[link_type],link_type,link_type_name,type_code,vdf_type\n,1,road,f,qvdf\n"
    (tmp_path / "settings.csv").write_text(settings, encoding="utf-8")
    rows = {r["link_id"]: r for r in run.run(spark, place).performance.collect()}
    doc = 3000 * 0.5 / 4000
    a = 1.5 * 60 / 51 - 1
    assert rows[1]["doc"] == pytest.approx(doc) and rows[1]["minutes"] == pytest.approx(10 * (1 + a * doc**4))


def test_every_report_of_a_folder_is_written(spark, tmp_path):
    links = LINKS.replace("VDF_tollcar1\n", "VDF_tollcar1,tmc_corridor_name,cycle_length,start_green_time,end_green_time\n").replace(",0\nb", ",0,east,60,0,20\nb")
    place = folder_of(tmp_path, ["am.csv,am,car,column,1"], am="o_zone_id,d_zone_id,volume\n1,2,100\n2,1,7\n", link=links, supply_side_scenario="scenario_type,from_node_id,to_node_id,lanes\nsa,1,4,2\n", n=1)
    run.run(spark, place, str(tmp_path / "out"))
    rows = {p.name: [r.asDict() for r in spark.read.option("header", True).csv(str(p)).collect()] for p in (tmp_path / "out").iterdir()}
    route = rows["route_assignment"][0]
    assert route["link_sequence"] == "1;2" and float(route["path_miles"]) == pytest.approx(20) and float(route["path_cost"]) > 20 and route["n_links"] == "2"
    assert {(r["o_zone_id"], r["connectivity"]) for r in rows["od_accessibility"]} == {("1", "1"), ("2", "0")}
    assert float(rows["results"][0]["volume"]) == 100 and float(rows["results"][0]["time_car"]) == pytest.approx(float(route["path_cost"]))
    assert {(r["stage"], r["corridor"]) for r in rows["corridor_performance"]} == {(s, c) for s in ("base", "scenario") for c in ("am east", "am network_wide")}
    assert float(rows["analysis_district_performance"][0]["volume"]) == 100
    assert {(r["demand_period"], r["link_id"]) for r in rows["link_queue_profile"]} == {("am", "1"), ("am", "2")}
    signal = rows["dynamic_link_state"]
    assert len(signal) == 120 and {(r["duration"], r["state"]) for r in signal} == {("20", "1"), ("40", "0")}
    assert {"link_performance", "od_totals", "final_summary", "unserved_demand", "scenario_comparison", "scenario_assignment"} <= rows.keys()


def test_assign_module_form_agrees(spark):
    od = spark.createDataFrame([(1, 2, "p", 7000.0)], "o_zone_id int, d_zone_id int, agent_type string, volume double")
    old, _ = assign.column_generation(two_corridors(spark), od, 3, minutes)
    new, _ = classes.assign(two_corridors(spark).withColumn("demand_period", F.lit("am")), od.withColumn("demand_period", F.lit("am")), [classes.AgentType("p")], 3, minutes)
    assert {tuple(r["links"]): r["volume"] for r in old.collect()} == {tuple(r["links"]): pytest.approx(r["volume"]) for r in new.collect()}


@pytest.mark.parametrize("bytes_", [paths.NETWORK_BYTES, 0])
def test_agents_of_a_pair_share_its_route(spark, monkeypatch, bytes_):
    monkeypatch.setattr(paths, "NETWORK_BYTES", bytes_)
    types = [classes.AgentType("p"), classes.AgentType("truck")]
    net = classes.costed(network(spark, [(1, 1, 2, 1.0, "p"), (2, 1, 3, 2.0, ""), (3, 3, 2, 2.0, "")]), types)
    agents = spark.createDataFrame([("am", "p", 1, 2, 7), ("am", "p", 1, 2, 8), ("am", "truck", 1, 2, 9), ("am", "p", 2, 1, 10)], "demand_period string, agent_type string, o_zone_id int, d_zone_id int, agent_id int")
    got = {r["agent_id"]: r["links"] for r in classes.agent_routes(agents, net, types).collect()}
    assert got == {7: [1], 8: [1], 9: [2, 3], 10: None}
    assert classes.agent_routes(agents.limit(0), net, types).count() == 0
