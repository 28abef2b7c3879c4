"""CSV rules: defaults, blank lines, prefixes, sections, wide columns; sinks."""

import pytest
from pyspark.sql import functions as F

from arterial.functions import clock, geometry
from arterial.sources import sinks, tables


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_fields(spark, tmp_path):
    df = tables.read_csv(spark, write(tmp_path, "a.csv", "﻿ id , v,name,geometry,\n1,12abc,,\"LINESTRING (1 2, 3 4)\",\n2,,x,,\n3,-4,y,,\n\n4,5,z,,\n"))
    rows = {r["id"]: r for r in df.select("id", tables.field(df, "v", default=7.0).alias("v"), tables.field(df, "name", "string", "none").alias("name"), tables.field(df, "w", "int", 3).alias("w"), tables.field(df, "v", required=True, nonnegative=True, default=0.0).alias("p"), "geometry").collect()}
    assert set(rows) == {"1", "2", "3"}  # reading stops at the blank line
    assert rows["1"]["v"] == 12 and rows["2"]["v"] == 7 and rows["3"]["v"] == -4 and rows["3"]["p"] == 0
    assert rows["1"]["name"] == "none" and rows["1"]["w"] == 3 and rows["1"]["geometry"] == "LINESTRING (1 2, 3 4)"
    with pytest.raises(ValueError):
        tables.field(df, "missing", required=True)


def test_empty_file(spark, tmp_path):
    assert tables.read_csv(spark, write(tmp_path, "e.csv", "")).count() == 0


def test_settings(spark, tmp_path):
    text = "[assignment],,column_generation_iterations,simulation_iterations\n,,12,1\n,,,\n[agent_type],agent_type,vot,pce\n,p,10,1\n,dms,20,2\n[demand_period],demand_period_id,demand_period,time_period\n,1,AM,0700_0800\n"
    s = tables.Settings.read(spark, write(tmp_path, "settings.csv", text))
    assert s.column_generation == 12 and s.simulation == 1 and s.column_updates == 0
    types = {r["agent_type"]: r for r in tables.agent_types(s.tables["agent_type"]).collect()}
    assert types["dms"]["real_time_info"] == 2 and types["p"]["real_time_info"] == 0 and types["dms"]["pce"] == 2
    assert tables.demand_periods(s.tables["demand_period"]).first().asDict() == {"demand_period": "AM", "start_min": 420.0, "end_min": 480.0, "hours": 1.0, "peak_min": 450.0}
    assert tables.Settings.read(spark, None).column_generation == 20


def test_links_and_parameters(spark, tmp_path):
    df = tables.read_csv(spark, write(tmp_path, "link.csv", "link_id,from_node_id,to_node_id,length,lanes,free_speed,capacity,VDF_fftt1,VDF_cap1,vdf_code,VDF_tollsov1\na,1,2,1609,2,60,1800,,,c1,\nb,2,3,0,1,0.05,900,5,700,c2,1.5\n"))
    links = {r["name"]: r for r in tables.links(df, 1, 2.0).collect()}
    assert links["a"]["fftt"] == pytest.approx(1) and links["a"]["period_cap"] == 7200 and links["a"]["cutoff"] == pytest.approx(51)
    assert links["b"]["fftt"] == 5 and links["b"]["period_cap"] == 700 and links["b"]["free_speed"] == 60 and links["b"]["length_m"] == 1
    assert [links["a"]["link_id"], links["b"]["link_id"]] == [1, 2]
    q = tables.read_csv(spark, write(tmp_path, "q.csv", "data_type,from_node_id,to_node_id,vdf_code,QVDF_qdf1\nvdf_code,,,c1,0.4\nvdf_code,,,c1,0.6\nvdf_code,,,all,0.3\nlink,2,3,,0.9\n"))
    got = {r["name"]: r["qdf"] for r in tables.with_queue_parameters(tables.links(df, 1, 2.0), *tables.queue_parameters(q), 2.0).collect()}
    assert got == {"a": pytest.approx(0.5), "b": pytest.approx(0.9)}
    assert [(r["agent_type"], r["toll"]) for r in tables.tolls(df, tables.links(df)).collect()] == [("sov", 1.5)]


def test_demand_forms(spark, tmp_path):
    col = tables.read_csv(spark, write(tmp_path, "d.csv", "o_zone_id,d_zone_id,volume\n1,2,7\n1,1,9\n2,1,-100\n2,1,5\n"))
    assert [tuple(r) for r in tables.demand_column(col, "p", 2.0).collect()] == [(1, 2, "p", 14.0)]
    mat = tables.read_csv(spark, write(tmp_path, "m.csv", "﻿zone,1,2\n1,0,3\n2,4,8\n"))
    assert sorted(tuple(r) for r in tables.demand_matrix(mat, "p").collect()) == [(1, 2, "p", 3.0), (2, 1, "p", 4.0)]
    fixed = tables.read_csv(spark, write(tmp_path, "p.csv", "path_id,o_zone_id,d_zone_id,volume,node_sequence\n1,1,2,5,1;3;2;\n"))
    assert tables.demand_paths(fixed, "p").first()["nodes"] == [1, 3, 2]
    act = tables.read_csv(spark, write(tmp_path, "a.csv", "agent_id,o_zone_id,d_zone_id,activity_zone_sequence,activity_agent_type_sequence\n1,1,3,2,p;bus\n"))
    assert [(r["o_zone_id"], r["d_zone_id"], r["agent_type"]) for r in tables.demand_activities(act).orderBy("leg").collect()] == [(1, 2, "p"), (2, 3, "bus")]


def test_measurements_prefer_counts(spark, tmp_path):
    m = tables.read_csv(spark, write(tmp_path, "m.csv", "measurement_type,from_node_id,to_node_id,o_zone_id,d_zone_id,count1,upper_bound_flag1\nlink,1,2,,,50,0\nlink,1,2,,,90,1\nlink,1,2,,,60,0\n"))
    assert [r["obs_count"] for r in tables.measurements(m).collect()] == [60.0]


def test_times(spark):
    df = spark.createDataFrame([("0700",), ("T0730:30",), ("010000",), ("0700:00:500",), ("x",), (None,)], "t string")
    got = [r[0] for r in df.select(clock.minutes_of(F.col("t"))).collect()]
    assert got[:4] == [420.0, 450.5, 1440.0, pytest.approx(420 + 0.5 / 60)] and got[4:] == [None, None]
    assert df.limit(1).select(clock.clock_text(F.lit(450.5))).first()[0] == "0730:30.020"
    assert spark.range(1).select(clock.id_list(F.lit("1; 2;x;3")), clock.split_any(F.lit("a,,b;c"), ",;")).first()[:] == ([1, 2], ["a", "b", "c"])


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    pts = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.5, 3.0), (5.0, 1.0)], "x double, y double")
    assert [r[0] for r in pts.select(geometry.in_polygon(F.col("x"), F.col("y"), ring)).collect()] == [True, False, True, False]
    zones = spark.createDataFrame([(1, x, y) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0)]] + [(2, 0.0, 0.0)], "d int, x double, y double")
    assert [(r["d"], r["n_vertices"]) for r in geometry.hulls(zones, "d", "x", "y").collect()] == [(1, 4)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "p", [1, 2], 5.0, 3.0)], "o_zone_id int, d_zone_id int, agent_type string, links array<int>, volume double, path_cost double")
    sinks.write_csv(sinks.route_rows(df), str(tmp_path / "routes"))
    back = spark.read.csv(str(tmp_path / "routes"), header=True).first()
    assert back["link_sequence"] == "1;2" and back["volume"] == "5.0"
    long = spark.createDataFrame([(1, 0, 60.0), (1, 1, 50.0)], "link_id int, slot int, speed double")
    assert sinks.wide_profile(long, "link_id", [0, 1]).first().asDict() == {"link_id": 1, "v00:00": 60.0, "v00:05": 50.0}


def test_lines_in_any_order_of_rows(spark):
    lines = spark.createDataFrame([("7,late", 9), ("", 8), ("2,\"b, c\"", 5), (" a ,a,b", 2), ("1,x", 4), (" ", 1)], "line string, _row long")
    got = tables.from_lines(lines)
    assert got.columns == ["_row", "a", "_1", "b"]  # a name that repeats is given up
    assert [tuple(r) for r in got.orderBy("_row").collect()] == [(4, "1", "x", None), (5, "2", "b, c", None)]
    assert tables.from_lines(lines, False).count() == 4 and tables.from_lines(lines.limit(0)).columns == ["_row"]
