"""Assignment, correction, scenarios and paths on small networks with known results."""

import pytest
from pyspark.sql import functions as F

from arterial.functions import vdf
from arterial.operators import assign, correction, demand, paths, queues, reports, scenario

#: Average minutes and gap of twenty iterations on the two-corridor network.
TRACE = [(48.1371, 0.60455), (48.1371, 0.60455), (27.5878, 0.0794123), (30.048, 0.380954), (27.5542, 0.165235), (27.5878, 0.0794122), (28.343, 0.0372733), (29.3076, 0.0139987), (30.3033, 0.000210117), (31.2629, 0.0347227), (32.1613, 0.0668473), (29.3076, 0.0139987), (27.9199, 0.0550192), (28.343, 0.0372733), (28.8142, 0.024046), (29.3076, 0.0139987), (29.8072, 0.00625264), (30.3033, 0.000210117)]


def two_corridors(spark):
    rows = [(1, 1, 3, 10.0, 10.0, 4000.0), (2, 3, 2, 10.0, 10.0, 4000.0), (3, 1, 4, 15.0, 15.0, 3000.0), (4, 4, 2, 15.0, 15.0, 3000.0)]
    links = spark.createDataFrame(rows, "link_id int, from_node_id int, to_node_id int, mile double, fftt double, period_cap double")
    return links.withColumns({"free_speed": F.lit(60.0), "lanes": F.lit(1.0), "lane_capacity": F.col("period_cap"), "cutoff": F.lit(51.0)})


def minutes(links):
    return vdf.travel_time(vdf.with_defaults(links, 1.0, 7.5))


@pytest.fixture(scope="module")
def solved(spark):
    od = spark.createDataFrame([(1, 2, "p", 7000.0)], "o_zone_id int, d_zone_id int, agent_type string, volume double")
    return assign.column_generation(two_corridors(spark), od, 20, minutes)


def test_trace_of_twenty_iterations(solved):
    rows = [(r["total_minutes"] / 7000, r["gap"]) for r in solved[1].orderBy("iteration").collect()]
    assert [r[1] for r in rows[:2]] == [-1.0, -1.0]
    for (t, g), (want_t, want_g) in zip(rows[2:], TRACE):
        assert t == pytest.approx(want_t, abs=6e-4) and g == pytest.approx(want_g, abs=1e-5)


def test_split_of_the_two_routes(solved):
    volumes = {tuple(r["links"]): r["volume"] for r in solved[0].collect()}
    assert volumes == {(1, 2): pytest.approx(5600), (3, 4): pytest.approx(1400)}


def test_column_updates_keep_demand_and_narrow_the_gap(spark, solved):
    links = two_corridors(spark)
    cost = lambda p: assign.ue_gap(assign.path_costs(p, minutes(assign.loaded(links, assign.link_volumes(p))))).first()["gap"]
    uneven = solved[0].withColumn("volume", F.lit(3500.0))
    better = assign.column_updates(uneven, links, 5, minutes)
    assert better.agg(F.sum("volume")).first()[0] == pytest.approx(7000)
    assert cost(better) < cost(uneven)


def test_both_tree_forms_agree_and_labels_obey_the_links(spark, sf):
    from arterial.plans import star

    links, origins = star.costed_links(spark, sf), star.nodes(spark, sf).select(F.col("node_id").alias("origin"))
    a = {(r["origin"], r["node"]): r["cost"] for r in paths.labels(links, origins).collect()}
    b = {(r["origin"], r["node"]): r["cost"] for r in paths.labels_grouped(links, origins).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    for r in links.collect():
        for o in range(1, 26):
            assert a[o, r["to_node_id"]] <= a[o, r["from_node_id"]] + r["cost"] + 1e-9


def test_equal_costs_take_the_smaller_link_in_both_forms(spark):
    rows = [(5, 1, 2, 1.0), (2, 1, 3, 1.0), (7, 2, 4, 1.0), (6, 3, 4, 1.0), (4, 1, 4, 2.0), (9, 1, 2, 1.0), (3, 4, 5, 0.0), (1, 5, 4, 0.0)]
    links = spark.createDataFrame(rows, "link_id int, from_node_id int, to_node_id int, cost double")
    origins = spark.createDataFrame([(1,), (4,), (77,)], "origin int")
    a, b = ({tuple(r) for r in f(links, origins).select("origin", "node", "cost", "pred_link", "pred_node").collect()} for f in (paths.labels, paths.labels_grouped))
    assert a == b and (1, 4, 2.0, 4, 1) in a and (1, 2, 1.0, 5, 1) in a and (77, 77, 0.0, None, None) in a


def test_routes_of_a_thousand_links(spark):
    n = 1000
    links = spark.range(n).select((F.col("id") + 1).cast("int").alias("link_id"), F.col("id").cast("int").alias("from_node_id"), (F.col("id") + 1).cast("int").alias("to_node_id"), F.lit(1.0).alias("cost"))
    tree = paths.labels_grouped(links, spark.createDataFrame([(0,)], "origin int"))
    got = {r["d_zone_id"]: (r["links"], r["cost"]) for r in paths.routes(tree, spark.createDataFrame([(0, 0), (0, 1), (0, 777), (0, n)], "o_zone_id int, d_zone_id int")).collect()}
    assert got == {d: (list(range(1, d + 1)), float(d)) for d in (0, 1, 777, n)}


def test_long_chains_have_all_labels_in_both_forms(spark):
    n = 205
    links = spark.range(n).select((F.col("id") + 1).cast("int").alias("link_id"), F.col("id").cast("int").alias("from_node_id"), (F.col("id") + 1).cast("int").alias("to_node_id"), F.lit(1.0).alias("cost"))
    links = links.unionByName(spark.createDataFrame([(n + 1, 0, n, 1000.0)], links.schema)).coalesce(1)
    origins = spark.createDataFrame([(0,)], "origin int").coalesce(1)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        a = {r["node"]: r["cost"] for r in paths.labels(links, origins).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert a == {r["node"]: r["cost"] for r in paths.labels_grouped(links, origins).collect()} == {i: float(i) for i in range(n + 1)}


def test_what_cannot_end_is_an_error(spark):
    links = spark.createDataFrame([(1, 1, 2, -1.0), (2, 2, 1, -1.0)], "link_id int, from_node_id int, to_node_id int, cost double")
    with pytest.raises(ValueError):
        paths.labels(links, spark.createDataFrame([(1,)], "origin int"))
    tree = spark.createDataFrame([(1, 1, 0.0, None, None), (1, 2, 1.0, 5, 3), (1, 3, 1.0, 6, 2)], "origin int, node int, cost double, pred_link int, pred_node int")
    with pytest.raises(ValueError):
        paths.routes(tree, spark.createDataFrame([(1, 2)], "o_zone_id int, d_zone_id int"))


def test_paths_of_equal_sums_stay_apart(spark):
    rows = [(1, 2, "p", [1, 4], 2.0), (1, 2, "p", [2, 3], 3.0), (1, 2, "p", [1, 4], 5.0)]
    df = spark.createDataFrame(rows, "o_zone_id int, d_zone_id int, agent_type string, links array<int>, volume double")
    got = {tuple(r["links"]): r["volume"] for r in paths.merge_paths(df, ["o_zone_id", "d_zone_id", "agent_type"]).collect()}
    assert got == {(1, 4): 7.0, (2, 3): 3.0}


def test_unreachable_nodes_have_no_label_or_route(spark):
    links = spark.createDataFrame([(1, 1, 2, 1.0)], "link_id int, from_node_id int, to_node_id int, cost double")
    origins = spark.createDataFrame([(1,), (2,)], "origin int")
    assert {(r["origin"], r["node"]) for r in paths.labels(links, origins).collect()} == {(1, 1), (1, 2), (2, 2)}
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "o_zone_id int, d_zone_id int")
    assert [(r["o_zone_id"], r["links"]) for r in paths.routes(paths.labels(links, origins), pairs).collect()] == [(1, [1])]


def test_connectors_join_centroids(spark):
    nodes = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "node_id int, zone_id int")
    links = spark.createDataFrame([(1, 1, 3, 1.0), (2, 3, 2, 1.0)], "link_id int, from_node_id int, to_node_id int, cost double")
    tree = paths.labels_grouped(paths.with_connectors(links, nodes), spark.createDataFrame([(-1,)], "origin int"))
    assert {r["node"]: round(r["cost"], 6) for r in tree.collect()}[-2] == pytest.approx(2.0002)


def test_a_missing_link_drops_the_route(spark):
    links = spark.createDataFrame([(7, 1, 2), (8, 2, 3)], "link_id int, from_node_id int, to_node_id int")
    seq = spark.createDataFrame([("a", [1, 2, 3]), ("b", [1, 3]), ("c", [1])], "path_id string, nodes array<int>")
    assert sorted((r["path_id"], r["pos"], r["link_id"]) for r in paths.links_of_nodes(seq, links, "path_id", "nodes").collect()) == [("a", 0, 7), ("a", 1, 8)]


def test_correction_moves_loads_toward_counts(spark, solved):
    counts = spark.createDataFrame([(1, 5000.0, 0), (3, 2500.0, 0)], "link_id int, obs_count double, upper_bound_flag int")
    new, trace = correction.correct(solved[0], two_corridors(spark), counts, minutes, steps=12)
    errors = [r["mape"] for r in trace.orderBy("step").collect()]
    assert errors[-1] < 0.7 * errors[0] and errors == sorted(errors, reverse=True)


def test_lane_changes_and_their_report(spark):
    links = two_corridors(spark).withColumn("volume", F.lit(100.0))
    changes = spark.createDataFrame([(1, 3, 0.0), (3, 2, 2.0)], "from_node_id int, to_node_id int, lanes double")
    got = {r["link_id"]: r for r in scenario.lane_changes(links, changes).collect()}
    assert got[1]["fftt"] == 1440 and got[1]["design_flag"] == -1 and got[2]["period_cap"] == 8000 and got[3]["design_flag"] == 0
    diff = {r["link_id"]: r["fftt_diff"] for r in reports.before_after(links, scenario.lane_changes(links, changes), "link_id", ["fftt"]).collect()}
    assert diff[1] == 1430 and diff[3] == 0


def test_detours_keep_volume(spark):
    s = "o_zone_id int, d_zone_id int, agent_type string, links array<int>, volume double, path_cost double, impacted int"
    first = spark.createDataFrame([(1, 2, "dms", [1, 2, 3], 100.0, 60.0, 1), (1, 3, "dms", [1, 9], 10.0, 5.0, 0)], s)
    second = spark.createDataFrame([(5, 2, "dms", [2, 3], 1.0, 50.0, 1), (5, 2, "dms", [4], 1.0, 20.0, 0)], s)
    out = scenario.detours(first, spark.createDataFrame([(1, 5)], "link_id int, zone_id int"), second)
    got = {tuple(r["links"]): r["volume"] for r in out.collect()}
    assert set(got) == {(1, 2, 3), (1, 4), (1, 9)} and sum(got.values()) == pytest.approx(110) and got[1, 4] > 90


def test_scenario_drivers_without_information_stay(spark, solved):
    links = two_corridors(spark)
    cut = scenario.lane_changes(links, spark.createDataFrame([(1, 3, 0.25)], "from_node_id int, to_node_id int, lanes double"))
    none = spark.createDataFrame([], "zone_id int")
    split = lambda info: {tuple(r["links"]): round(r["volume"], 3) for r in scenario.reassign(cut, solved[0], spark.createDataFrame([("p", info)], "agent_type string, real_time_info int"), none, minutes, 5)[0].collect()}
    assert split(0) == split(2) == {(1, 2): 5600.0, (3, 4): 1400.0}
    moved = split(1)
    assert sum(moved.values()) == pytest.approx(7000) and moved[3, 4] > 3000
    signs = scenario.reassign(cut, solved[0], spark.createDataFrame([("p", 2)], "agent_type string, real_time_info int"), spark.createDataFrame([(1,)], "zone_id int"), minutes, 5)
    assert {tuple(r["links"]): round(r["volume"], 3) for r in signs[0].collect()} == moved and signs[1].count() == 6


def test_neighbours_at_high_latitudes_and_across_the_date_line(spark):
    from math import cos, radians

    points = [(1, 179.99, 10.0), (2, -179.99, 10.0), (3, 20.0, 78.0), (4, 20.0 + 0.015 / cos(radians(78.0)), 78.0), (5, 0.0, 89.999), (6, 180.0, 89.999), (7, 50.0, -0.001)]
    n = spark.createDataFrame(points, "node_id int, x_coord double, y_coord double")
    z = n.withColumnRenamed("node_id", "zone_id")
    got = {(r["zone_id"], r["node_id"]) for r in demand.k_nearest(z, n, 9, 3000.0).collect()}
    assert got == {(i, i) for i in range(1, 8)} | {(1, 2), (2, 1), (3, 4), (4, 3), (5, 6), (6, 5)}
    assert demand.k_nearest(z.limit(0), n, 9, 3000.0).count() == 0


@pytest.mark.parametrize("n,share", [(400, 0.25), (50, 0.25), (1000, 0.9), (3, 0.0)])
def test_cutoff_is_the_value_at_its_rank(spark, n, share):
    import random

    rng = random.Random(n)
    values = [rng.choice([rng.random() * 100, 5.0]) for _ in range(n)]
    got = demand.cutoff_value(spark.createDataFrame([(v,) for v in values], "v double"), "v", share, 100 if n > 100 else 1).first()
    down = sorted(values, reverse=True)
    at = int(n - max(share * n, 100.0 if n > 100 else 1.0))
    cutoff = down[at - 1] if at >= 1 else down[-1]
    assert got["cutoff"] == cutoff and got["n_kept"] == sum(v >= cutoff for v in values)


def test_single_link_closed_form(spark):
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate([0.0, 0.1, 0.2, 5.0, 5.1])], "link_id int, agent long, ready double").withColumn("h", F.lit(1.0))
    got = [r["depart"] for r in queues.single_link(rows, "link_id", "agent", "ready", "h").orderBy("agent").collect()]
    assert got == [0.0, 1.0, 2.0, 5.0, 6.0]


def test_stochastic_capacity_keeps_the_mean(spark):
    got = queues.stochastic_capacity(two_corridors(spark).where("link_id = 1"), 20000).agg(F.avg("capacity")).first()[0]
    assert got == pytest.approx(4000 / 3600, rel=0.02)


def test_sentinel_and_unknown_zones(spark):
    d = spark.createDataFrame([(1, 1, 2, 5.0), (2, 1, 1, 5.0), (3, 1, 9, 5.0), (4, 1, 2, -100.0), (5, 2, 1, 5.0)], "_row long, o_zone_id int, d_zone_id int, volume double")
    z = spark.createDataFrame([(1,), (2,)], "zone_id int")
    cut = demand.before_sentinel(d, "_row")
    assert cut.count() == 3 and demand.known_pairs(cut, z).count() == 1 and demand.unknown_rows(cut, z).count() == 1


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "o_zone_id int, d_zone_id int, agent_type string, volume double, links array<int>, path_cost double, impacted int")
    assert assign.link_volumes(none).count() == 0
    assert assign.column_update(assign.path_costs(none.drop("path_cost"), two_corridors(spark).withColumn("minutes", F.col("fftt"))), 0).count() == 0
    assert scenario.impacted_od(none).count() == 0
