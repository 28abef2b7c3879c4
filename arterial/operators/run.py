"""A run from input tables to reports: demand, assignment, correction, performance, scenario (SRC-09, GR-08, AGG-04, OD-06, SC-02, SC-04, SNK-15).

All periods that a demand file names and all agent types are assigned together, by
:mod:`classes`: links have a row for each period, zones are centroids with connectors to
all their access nodes, fixed routes are columns of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import units, vdf
from ..session import settle
from ..sources import sinks, tables
from . import access, cells, classes, correction, demand, queues, reports, scenario
from .classes import CELL

Minutes = Callable[[DataFrame], DataFrame]


@dataclass
class Inputs:
    """What a run needs; None where there is nothing of a kind.

    ``links``: a row for each period and link, connectors included where ``centroids`` is
    set; ``cells``: ``node_id, cell``, for networks beyond a broadcast; ``od``: CELL and volume; ``tolls``: ``demand_period, link_id, agent_type, toll``;
    ``routes``: CELL, volume and nodes of fixed routes; ``counts``: ``demand_period, link_id,
    obs_count, upper_bound_flag``; ``zone_counts``: ``measurement_type, zone_id,
    obs_count``; ``changes``, ``signs`` (``link_id, node_id, zone_id``) and ``factors`` are
    the scenario's.
    """

    links: DataFrame
    od: DataFrame
    minutes: Minutes
    types: list[classes.AgentType] = field(default_factory=lambda: [classes.AgentType("p")])
    centroids: bool = False
    cells: DataFrame | None = None
    tolls: DataFrame | None = None
    routes: DataFrame | None = None
    counts: DataFrame | None = None
    zone_counts: DataFrame | None = None
    informed: DataFrame | None = None
    changes: DataFrame | None = None
    info_zones: DataFrame | None = None
    signs: DataFrame | None = None
    factors: Callable[[DataFrame], DataFrame] | None = None
    profile: DataFrame | None = None
    districts: DataFrame | None = None


@dataclass
class Results:
    """Columns, priced with ``path_cost`` and ``path_miles``, link performance of the base and the scenario, demand totals, the log of (stage, iteration, name, value), and what could not be served."""

    paths: DataFrame
    performance: DataFrame
    totals: DataFrame
    summary: DataFrame
    unserved: DataFrame
    zone_errors: DataFrame | None = None
    agents: DataFrame | None = None
    scenario_paths: DataFrame | None = None
    comparison: DataFrame | None = None
    scenario_performance: DataFrame | None = None
    districts: DataFrame | None = None


def delays(hours: float = 1.0, peak_hour: float = 7.5) -> Minutes:
    """Travel times by the volume-delay functions: a link's ``vdf_type`` (SRC-06) chooses the form, a cycle means a signal; ``hours`` and ``peak_hour`` stand where links have no column ``hours`` or ``t2``."""

    def minutes(links: DataFrame) -> DataFrame:
        rows = vdf.travel_time(vdf.with_defaults(links, hours, peak_hour))
        if "vdf_type" in links.columns:
            queued = F.col("fftt") * F.col("free_speed") / F.greatest(F.lit(0.1), "queue_speed")
            rows = rows.withColumn("minutes", F.when(F.col("vdf_type") == "qvdf", queued).otherwise(F.col("minutes"))).withColumn("wait", F.col("minutes") - F.col("fftt"))
        return vdf.signal_delay(rows, "cycle", "red", "saturation") if "cycle" in links.columns else rows

    return minutes


def read(spark: SparkSession, folder: str) -> tuple[tables.Settings, Inputs]:
    """The inputs in a folder of CSV files, of all periods that demand files name.

    Demand between unknown or equal zones is left out, as are links of no period.  Zones
    come from zone.csv, else from TAZ.csv and the nearest nodes, else from the nodes.
    """
    has = lambda name: tables.exists(spark, f"{folder}/{name}.csv")
    table = lambda name: tables.read_csv(spark, f"{folder}/{name}.csv")
    settings = tables.Settings.read(spark, f"{folder}/settings.csv" if has("settings") else None)
    listed = settings.tables.get("demand_file_list")
    if listed is None or listed.isEmpty():
        listed = spark.createDataFrame([("demand.csv", "column", "p", "am")], "file_name string, format_type string, agent_type string, demand_period string")
    periods = [("am", 1, 1.0, 7.5, 420.0)]
    given = settings.tables.get("demand_period")
    if given is not None and not given.isEmpty():
        numbers = given.select("demand_period", tables.field(given, "demand_period_id", "int", 1).alias("no"))
        used = tables.demand_periods(given).join(numbers, "demand_period").join(listed.select("demand_period").distinct(), "demand_period", "left_semi")
        periods = [(r["demand_period"], r["no"], r["hours"], r["peak_min"] / 60.0, r["start_min"]) for r in used.orderBy("start_min").collect()]
    nodes = settle(tables.nodes(table("node")))
    if has("zone"):
        zones = tables.zones(table("zone")).select("zone_id", "node_id")
    elif has("TAZ"):
        zones = access.taz_access(tables.taz(table("TAZ")), nodes).select("zone_id", "node_id")
    else:
        zones = nodes.where("zone_id > 0").select("zone_id", "node_id")
    zones = settle(zones.distinct())
    districts = zones.join(nodes.select("node_id", "district_id"), "node_id", "left").groupBy("zone_id").agg(F.max("district_id").alias("district_id"))
    scaled = rescaled = None
    if has("demand_side_scenario"):
        side = table("demand_side_scenario")
        base, later = settle(tables.demand_factors(side)), settle(tables.demand_factors(side, scenario=True))
        scaled = lambda rows: demand.district_factors(rows, districts, base)
        rescaled = None if later.isEmpty() else lambda rows: demand.district_factors(rows, districts, later)
    trips, routes = tables.demand(spark, folder, listed, scaled)
    od = settle(demand.known_pairs(trips, zones).select(*CELL, "volume"))
    routes = settle(demand.known_pairs(routes, zones).select(*CELL, "volume", "nodes"))
    link = table("link")
    kinds = tables.link_types(settings.tables["link_type"]).select("link_type", "vdf_type") if "link_type" in settings.tables else None
    links, tolls, counts = [], [], []
    counted = table("measurement") if has("measurement") else None
    for name, no, hours, peak, _ in periods:
        rows = tables.links(link, no, hours)
        tolls.append(tables.tolls(link, rows, no).withColumn("demand_period", F.lit(name)))
        if has("link_qvdf"):
            rows = tables.with_queue_parameters(rows, *tables.queue_parameters(table("link_qvdf"), no), hours)
        rows = rows.withColumns({"demand_period": F.lit(name), "hours": F.lit(hours), "t2": F.lit(peak)})
        links.append(rows if "qdf" in rows.columns else rows.withColumn("qdf", F.lit(1.0 / hours)))
        if counted is not None:
            counts.append(tables.measurements(counted, no).where("measurement_type = 'link'").withColumn("demand_period", F.lit(name)))
    together = lambda frames: _union(frames) if frames else None
    whole = together(links)
    if kinds is not None:
        whole = whole.join(kinds, "link_type", "left")
    whole = settle(classes.connected(whole, zones))
    real = whole.where("link_id > 0")
    seen = together(counts)
    if seen is not None:
        pair = real.groupBy("demand_period", "from_node_id", "to_node_id").agg(F.min("link_id").alias("link_id"))
        seen = settle(seen.join(pair, ["demand_period", "from_node_id", "to_node_id"]).select("demand_period", "link_id", "obs_count", "upper_bound_flag"))
    zone_counts = None
    if counted is not None:
        z = tables.measurements(counted, 0)  # of the column without a period
        zone_counts = z.where("measurement_type in ('production', 'attraction')").select("measurement_type", F.when(F.col("measurement_type") == "production", F.col("o_zone_id")).otherwise(F.col("d_zone_id")).alias("zone_id"), "obs_count")
    kinds_of = tables.agent_types(settings.tables["agent_type"]) if "agent_type" in settings.tables else None
    types = classes.types_of(kinds_of) if kinds_of is not None else [classes.AgentType(r[0]) for r in od.select("agent_type").union(routes.select("agent_type")).distinct().orderBy("agent_type").limit(classes.MOST_TYPES).collect()]
    out = Inputs(whole, od, delays(), types, True, cells.grid_cells(nodes, _cell_size(nodes)), settle(together(tolls)), routes, seen, zone_counts, kinds_of, factors=rescaled, districts=districts)
    if has("supply_side_scenario"):
        supply = table("supply_side_scenario")
        out.changes = tables.scenario_links(supply)
        signs = tables.scenario_links(supply, "dms").join(real.select("link_id", "from_node_id", "to_node_id").distinct(), ["from_node_id", "to_node_id"])
        # a sign speaks for the place behind its link
        out.signs = settle(signs.select("link_id", F.col("to_node_id").alias("node_id"), F.col("to_node_id").alias("zone_id")))
        out.info_zones = zones.join(out.signs.select("node_id"), "node_id").select("zone_id").distinct()
    if "departure_time_profile" in settings.tables:
        slots = tables.departure_profiles(settings.tables["departure_time_profile"])
        first = slots.agg(F.min("profile_no").alias("profile_no"))
        out.profile = slots.join(F.broadcast(first), "profile_no").select(F.col("slot5"), "ratio")
    return settings, out


def _cell_size(nodes: DataFrame, each: int = 2000) -> float:
    """Side of squares that hold about ``each`` nodes if they are spread evenly."""
    n, w, h = nodes.agg(F.count("*"), F.max("x_coord") - F.min("x_coord"), F.max("y_coord") - F.min("y_coord")).first()
    return max((max(w or 0.0, 1e-9) * max(h or 0.0, 1e-9) * each / max(n, 1)) ** 0.5, 1e-9)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def performance(links: DataFrame, columns: DataFrame, types: list[classes.AgentType], minutes: Minutes) -> DataFrame:
    """SNK-01: links of every period, without connectors, with volume, times, speed and queue shape under the volumes of ``columns``."""
    rows = vdf.queue_shape(minutes(classes.loaded(links.where("link_id >= 0"), classes.loads(columns, types))))
    return rows.withColumn("speed", units.travel_speed(F.col("free_speed"), F.col("minutes"), F.col("fftt")))


def priced(columns: DataFrame, links: DataFrame, types: list[classes.AgentType], minutes: Minutes, tolls: DataFrame | None) -> DataFrame:
    """Columns with their class's cost at their own volumes, and their miles."""
    timed = settle(classes.costed(minutes(classes.loaded(links, classes.loads(columns, types))), types))
    rows = classes.column_costs(columns, timed, types, tolls)
    if "length_m" not in links.columns:
        return rows.withColumn("path_miles", F.lit(None).cast("double"))
    keys = [*CELL, "path_id", "state"]
    length = timed.select("demand_period", "link_id", units.miles(F.col("length_m")).alias("_m"))
    miles = rows.select(*keys, F.explode("links").alias("link_id")).join(length, ["demand_period", "link_id"]).groupBy(*keys).agg(F.sum("_m").alias("path_miles"))
    return rows.join(miles, keys, "left").fillna(0.0, ["path_miles"])


def solve(inputs: Inputs, iterations: int = 20, updates: int = 0, steps: int | None = None, scenario_iterations: int = 0) -> Results:
    """Assign, correct against counts where there are any, report, and run the scenario if there is one.

    With counts, ``steps`` is OD-06's number unless given, and the columns are updated
    OD-06's number of times at least before.
    """
    spark = inputs.links.sparkSession
    lost = None
    pool = None
    if inputs.routes is not None:
        pool, lost = classes.fixed_columns(inputs.routes, inputs.links)
        pool = settle(pool)
    columns, trace = classes.assign(inputs.links, inputs.od, inputs.types, iterations, inputs.minutes, inputs.tolls, pool, inputs.centroids, inputs.cells)
    corrects = inputs.counts is not None and not inputs.counts.isEmpty()
    updates = max(updates, correction.COLUMN_UPDATES) if corrects else updates
    columns = classes.updates(columns, inputs.links, inputs.types, updates, inputs.minutes, inputs.tolls)
    whole = inputs.od.select("volume").unionByName(inputs.routes.select("volume")) if inputs.routes is not None else inputs.od.select("volume")
    total = whole.agg(F.sum("volume")).first()[0] or 0.0
    log = trace.select(F.lit("assignment").alias("stage"), "iteration", F.explode(F.create_map(F.lit("avg_minutes"), F.col("total_minutes") / F.lit(max(total, 1e-9)), F.lit("gap"), F.col("gap"))).alias("name", "value"))
    errors = None
    if corrects:
        columns, error = correction.correct_columns(columns, inputs.links, inputs.counts, inputs.types, correction.STEPS if steps is None else steps)
        log = log.unionByName(error.select(F.lit("correction").alias("stage"), F.col("step").alias("iteration"), F.lit("mape").alias("name"), F.col("mape").alias("value")))
    if inputs.zone_counts is not None:
        made = [correction.zone_deviations(columns, inputs.zone_counts.where(F.col("measurement_type") == kind).withColumnRenamed("zone_id", end), end).select("measurement_type", F.col(end).alias("zone_id"), "obs_count", F.coalesce("estimate", F.lit(0.0)).alias("estimate"), "deviation") for kind, end in (("production", "o_zone_id"), ("attraction", "d_zone_id"))]
        errors = _union(made)
    base = settle(performance(inputs.links, columns, inputs.types, inputs.minutes))
    unserved = classes.unserved(inputs.od, columns.where(F.col("state") != classes.FIXED)).withColumn("reason", F.lit("no path"))
    if lost is not None:
        unserved = unserved.unionByName(lost.withColumn("reason", F.lit("fixed route without links")))
    columns = settle(priced(columns, inputs.links, inputs.types, inputs.minutes, inputs.tolls))
    out = Results(columns, base, reports.od_totals(columns), log, unserved, errors, districts=inputs.districts)
    if inputs.profile is not None:
        out.agents = demand.vehicles(classes.physical(columns), demand.departure_profile(inputs.profile, "slot5", "ratio"))
    if inputs.changes is not None:
        columns = columns.select(*CELL, "links", "state", "volume")
        changed = settle(scenario.lane_changes(inputs.links, inputs.changes))
        out.scenario_paths, told = scenario.reassign_classes(
            changed, columns, inputs.types, inputs.minutes, scenario_iterations, base=inputs.links, informed_types=inputs.informed, info_zones=inputs.info_zones,
            tolls=inputs.tolls, centroids=inputs.centroids, signs=inputs.signs, rescaled=inputs.factors,
        )
        after = performance(changed, out.scenario_paths, inputs.types, inputs.minutes)
        key = F.concat_ws(";", "demand_period", "link_id")
        both = reports.before_after(base.withColumn("_key", key), after.withColumn("_key", key), "_key", ["volume", "minutes", "speed"])
        out.scenario_performance = after
        out.comparison = both.withColumns({"demand_period": F.element_at(F.split("_key", ";"), 1), "link_id": F.element_at(F.split("_key", ";"), 2).cast("int")}).drop("_key")
        out.summary = log.unionByName(told.select(F.lit("scenario").alias("stage"), "iteration", F.lit("avg_minutes").alias("name"), (F.col("total_minutes") / F.lit(max(total, 1e-9))).alias("value")))
    return out


def write(results: Results, folder: str) -> None:
    """The reports as folders of CSV parts."""
    text = F.array_join("links", ";").alias("link_sequence")
    rows = results.performance.withColumn("_p", F.col("demand_period"))
    rows = sinks.link_rows(rows, "").withColumn("demand_period", F.col("_p"))
    sinks.write_csv(rows.select("link_id", "from_node_id", "to_node_id", "demand_period", "volume", "persons", "minutes", "speed", "doc", "p"), f"{folder}/link_performance")
    sinks.write_csv(results.paths.select(*CELL, "state", "volume", "path_cost", "path_miles", text, F.size("links").alias("n_links")), f"{folder}/route_assignment")
    # SNK-03: every demand cell, with its columns or without
    found = results.paths.select(*CELL, "volume", "path_cost", F.lit(1).alias("connectivity"))
    lost = results.unserved.select(*CELL, "volume", F.lit(-1.0).alias("path_cost"), F.lit(0).alias("connectivity"))
    sinks.write_csv(found.unionByName(lost), f"{folder}/od_accessibility")
    # SNK-22: one row a pair of zones
    names = [r[0] for r in results.paths.select("agent_type").distinct().orderBy("agent_type").limit(classes.MOST_TYPES).collect()]
    sinks.write_csv(reports.od_weighted(results.paths, names), f"{folder}/results")
    stages = [("base", results.performance)] + ([("scenario", results.scenario_performance)] if results.scenario_performance is not None else [])
    if "corridor" in results.performance.columns:
        # SNK-14
        sinks.write_csv(_union([reports.corridors(p, F.concat_ws(" ", "demand_period", "corridor")).withColumn("stage", F.lit(s)) for s, p in stages]), f"{folder}/corridor_performance")
    if results.districts is not None:
        sinks.write_csv(reports.districts(results.paths, results.districts), f"{folder}/analysis_district_performance")
    shapes = sinks.queue_rows(results.performance.withColumn("link_id", F.concat_ws(";", "demand_period", "link_id")))
    place = F.split("link_id", ";")
    sinks.write_csv(shapes.withColumn("demand_period", place[0]).withColumn("link_id", place[1]), f"{folder}/link_queue_profile")
    if "cycle" in results.performance.columns:
        # SNK-06: states of signals over an hour, as runs
        signals = results.performance.where("cycle >= 1").select("link_id", F.round("cycle").cast("int").alias("cycle"), F.lit(0).alias("start_green"), F.round(F.col("cycle") - F.col("red")).cast("int").alias("end_green"), "lanes").dropDuplicates(["link_id"])
        sinks.write_csv(reports.run_lengths(queues.signal_seconds(signals, 3600), "link_id", "second", "state"), f"{folder}/dynamic_link_state")
    sinks.write_csv(results.totals, f"{folder}/od_totals")
    sinks.write_csv(results.summary, f"{folder}/final_summary")
    sinks.write_csv(results.unserved, f"{folder}/unserved_demand")
    if results.zone_errors is not None:
        sinks.write_csv(results.zone_errors, f"{folder}/zone_errors")
    if results.agents is not None:
        sinks.write_csv(results.agents.select(*CELL, "v", "depart_min", text), f"{folder}/agent")
    if results.comparison is not None:
        sinks.write_csv(results.comparison, f"{folder}/scenario_comparison")
        sinks.write_csv(results.scenario_paths.select(*CELL, "state", "volume", text), f"{folder}/scenario_assignment")


def run(spark: SparkSession, folder: str, out: str | None = None) -> Results:
    """Read a folder, solve with the iterations of its settings, and write the reports to ``out`` if given."""
    settings, inputs = read(spark, folder)
    results = solve(inputs, settings.column_generation, settings.column_updates, settings.corrections, settings.sensitivity)
    if out:
        write(results, out)
    return results
