"""A run from a folder of CSV files to reports."""

import struct

import pytest
from pyspark.sql import functions as F

from arterial.operators import run
from arterial.plans import star
from arterial.sources import sinks, tables

FILES = {
    "node.csv": "node_id,zone_id,x_coord,y_coord\n1,1,0.0,0.0\n2,2,0.3,0.0\n3,,0.15,0.1\n4,,0.15,-0.1\n",
    "link.csv": "link_id,from_node_id,to_node_id,length,lanes,free_speed,capacity,link_type\na,1,3,16090,1,60,4000,1\nb,3,2,16090,1,60,4000,1\nc,1,4,24135,1,60,3000,1\nd,4,2,24135,1,60,3000,1\n",
    "settings.csv": "[assignment],,assignment_mode,column_generation_iterations,column_updating_iterations,sensitivity_analysis_iterations\n,,ue,20,0,2\n[agent_type],agent_type,name,real_time_info\n,p,passenger,1\n"
    "[demand_period],demand_period_id,demand_period,time_period\n,1,am,0700_0800\n[demand_file_list],file_sequence_no,file_name,demand_period,agent_type,format_type,scale_factor\n,1,demand.csv,am,p,column,1\n,2,matrix.csv,am,p,matrix format,2\n,3,gone.csv,am,p,column,1\n",
    "demand.csv": "o_zone_id,d_zone_id,volume\n1,2,6000\n1,9,50\n2,2,5\n",
    "matrix.csv": "o,1,2\n1,0,500\n2,0,0\n",
    "supply_side_scenario.csv": "scenario_type,from_node_id,to_node_id,lanes\nsa,1,3,0.25\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_a_folder_is_run_to_reports(spark, folder, tmp_path):
    out = run.run(spark, folder, str(tmp_path / "out"))
    volumes = {r["link_id"]: r["volume"] for r in out.performance.collect()}
    assert volumes == {1: pytest.approx(5600), 2: pytest.approx(5600), 3: pytest.approx(1400), 4: pytest.approx(1400)}
    rows = spark.read.option("header", True).csv(str(tmp_path / "out" / "link_performance")).collect()
    assert len(rows) == 4 and {r["demand_period"] for r in rows} == {"am"}
    log = {(r["stage"], r["iteration"], r["name"]): r["value"] for r in out.summary.collect()}
    assert log["assignment", 19, "gap"] == pytest.approx(0.000210117, abs=2e-5)
    assert {k for k, *_ in log} == {"assignment", "scenario"}
    change = {r["link_id"]: r["volume_diff"] for r in out.comparison.collect()}
    assert change[1] < -500 and change[1] == pytest.approx(-change[3])


def test_probe_and_formats(spark, folder):
    found = tables.probe(spark, folder)
    assert found == {"settings": 1, "node": 1, "link": 1, "zone": 0, "TAZ": 0, "measurement": 0, "supply_side_scenario": 1, "subarea": 0, "zones_in_nodes": 1}
    settings = tables.Settings.read(spark, f"{folder}/settings.csv")
    assert [x[1] for x in tables.demand_formats(settings.tables["demand_file_list"])] == ["column", "matrix", "column"]
    cells, fixed = tables.demand(spark, folder, settings.tables["demand_file_list"])
    assert sorted(r["volume"] for r in cells.collect()) == [50.0, 1000.0, 6000.0] and fixed.count() == 0
    assert settings.sensitivity == 2 and settings.trajectory_every == 1


def test_taz(spark, tmp_path):
    (tmp_path / "TAZ.csv").write_text('zone_id,x_coord,y_coord,geometry\n1,2.5,3.5,\n2,,,"LINESTRING (0 0, 2 4)"\n', encoding="utf-8")
    got = {r["zone_id"]: (r["x_coord"], r["y_coord"]) for r in tables.taz(tables.read_csv(spark, str(tmp_path / "TAZ.csv"))).collect()}
    assert got == {1: (2.5, 3.5), 2: (1.0, 2.0)}


def test_trajectories_unpack(spark, sf):
    visits = star.trip_events(spark, sf)
    want = {}
    for r in visits.orderBy("agent_id", "t_in", "link_id").collect():
        want.setdefault(r["agent_id"], []).append((r["link_id"], float(r["t_in"])))
    size = struct.calcsize(sinks.TRAJECTORY_HEAD)
    for r in sinks.trajectory_records(visits).collect():
        agent, first, last, n = struct.unpack_from(sinks.TRAJECTORY_HEAD, r["record"])
        rest = struct.unpack_from(f"<{n}i{n}f", r["record"], size)
        assert list(zip(rest[:n], rest[n:])) == want[agent] and (first, last) == (rest[0], rest[n - 1])
    assert visits.select(F.count_distinct("agent_id")).first()[0] == len(want)
