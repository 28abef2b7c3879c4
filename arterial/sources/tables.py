"""Readers of the CSV tables of a network (SRC-01..29).

Fields are fetched by name with the rules of :func:`field`: an empty or missing
optional field keeps its default, numbers are read from their leading part, a
required column that is missing is an error, and negative values of required
non-negative fields count as 0.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock, geometry, units, vdf
from ..session import broadcast_within

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def read_csv(spark: SparkSession, path: str, stop_at_blank: bool = True) -> DataFrame:
    """SRC-01: the table of a CSV file, by :func:`from_lines`.

    Spark's own reader skips blank lines, so files are read as lines first.
    """
    return from_lines(spark.read.text(path, lineSep="\n").select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_row")), stop_at_blank)


def from_lines(lines: DataFrame, stop_at_blank: bool = True) -> DataFrame:
    """SRC-01: all columns as text, header names trimmed; rows from the first blank line on are left out.

    ``lines`` has ``line`` and ``_row``, which orders lines as in the file (increasing, with
    gaps) and stays in the result.  The first line that is not blank is the header.
    """
    lines = lines.select(F.regexp_replace(F.regexp_replace("line", "\r$", ""), "^\ufeff", "").alias("line"), "_row")
    head = lines.where(F.trim("line") != "").orderBy("_row").limit(1).collect()
    if not head:
        return lines.sparkSession.createDataFrame([], "_row long")
    names = [c.strip() for c in next(csv.reader([head[0]["line"]]))]
    rows = lines.where(F.col("_row") > head[0]["_row"])
    if stop_at_blank:
        cut = rows.where(F.regexp_replace("line", "[,\\s]", "") == "").agg(F.min("_row").alias("_cut"))
        rows = rows.crossJoin(F.broadcast(cut)).where(F.col("_cut").isNull() | (F.col("_row") < F.col("_cut"))).drop("_cut")
    unique = [n if n and n not in names[:i] else f"_{i}" for i, n in enumerate(names)]
    schema = ", ".join(f"`{n}` string" for n in unique)
    parsed = rows.select("_row", F.from_csv("line", schema, {"mode": "PERMISSIVE", "quote": '"', "escape": '"'}).alias("r"))
    return parsed.select("_row", "r.*")


def field(df: DataFrame, name: str, kind: str = "double", default=None, required: bool = False, nonnegative: bool = False) -> Column:
    """SRC-02: a typed field with its default."""
    if name not in df.columns:
        if required:
            raise ValueError(f"column {name} is required")
        return F.lit(default).cast(kind)
    text = F.col(f"`{name}`")
    if kind == "string":
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(default)).otherwise(text)
    number = F.regexp_extract(text, _NUMBER, 1).try_cast("double")
    value = number if kind == "double" else number.try_cast(kind)
    value = F.coalesce(value, F.lit(default).cast(kind))
    return F.greatest(value, F.lit(0).cast(kind)) if required and nonnegative else value


def read_sections(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-03: tables of a sectioned settings file, by section name.

    A line with ``[name]`` starts a section and names its columns.  Settings are a
    configuration file of some dozen lines, so they are parsed on the driver.
    """
    lines = [r[0].lstrip("﻿") for r in spark.read.text(path).collect()]
    out: dict[str, tuple[list[str], list[list[str]]]] = {}
    name = ""
    for row in csv.reader(lines):
        if row and "[" in row[0] and "]" in row[0]:
            name = row[0][row[0].index("[") + 1 : row[0].index("]")].strip()
            out[name] = ([c.strip() for c in row[1:]], [])
        elif name and any(c.strip() for c in row[1:]):
            out[name][1].append([c.strip() for c in row[1:]])
    tables = {}
    for name, (head, rows) in out.items():
        keep = [i for i, c in enumerate(head) if c]
        schema = ", ".join(f"`{head[i]}` string" for i in keep) or "empty string"
        data = [[(r + [""] * len(head))[i] for i in keep] or [""] for r in rows]
        tables[name] = spark.createDataFrame(data, schema)
    return tables


@dataclass
class Settings:
    """SRC-04, 10, 26: run parameters with their defaults, and the small tables of the file."""

    column_generation: int = 20
    column_updates: int = 0
    sensitivity: int = 0
    simulation: int = 0
    path_output: int = 1
    least_path_volume: float = 0.001
    trajectory_every: int = 1
    trace_output: int = 0
    info_update_min: int = 5
    corrections: int | None = None
    tables: dict[str, DataFrame] = dc_field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str | None) -> Settings:
        """Settings of a file; without a path, the defaults."""
        if path is None:
            return cls()
        tables = read_sections(spark, path)
        row: dict[str, str] = {}
        for section in ("assignment", "output_file_configuration", "real_time_info"):
            found = tables[section].first() if section in tables else None
            row |= found.asDict() if found else {}
        get = lambda k, d: type(d)(float(row[k])) if (row.get(k) or "").replace(".", "", 1).isdigit() else d
        return cls(
            get("column_generation_iterations", 20), get("column_updating_iterations", 0), get("sensitivity_analysis_iterations", 0), get("simulation_iterations", 0),
            get("path_output", 1), get("major_path_volume_threshold", 0.001), get("trajectory_sampling_rate", 1), get("trace_output", 0), get("info_updating_freq_in_min", 5), get("odme_iterations", 0) if row.get("odme_iterations") else None, tables,
        )


def demand_periods(table: DataFrame) -> DataFrame:
    """SRC-05: ``demand_period, start_min, end_min, hours, peak_min``; the peak is the middle unless given."""
    a, b = clock.window_of(F.col("time_period"))
    peak = clock.minutes_of(F.col("peak_time")) if "peak_time" in table.columns else F.lit(None).cast("double")
    return table.select("demand_period", a.alias("start_min"), b.alias("end_min"), ((b - a) / 60).alias("hours"), F.coalesce(peak, (a + b) / 2).alias("peak_min"))


def link_types(table: DataFrame) -> DataFrame:
    """SRC-06, with the built-in type -1 of connectors."""
    rows = table.select(field(table, "link_type", "int", 0).alias("link_type"), field(table, "link_type_name", "string", "").alias("link_type_name"), field(table, "type_code", "string", "").alias("type_code"), field(table, "vdf_type", "string", "bpr").alias("vdf_type"), field(table, "traffic_flow_code", "string", "spatial_queue").alias("flow_model"))
    return rows.unionByName(table.sparkSession.createDataFrame([(-1, "connector", "c", "bpr", "spatial_queue")], rows.schema)).dropDuplicates(["link_type"])


def agent_types(table: DataFrame) -> DataFrame:
    """SRC-07; the names ``rt`` and ``dms`` mean real-time information."""
    name = F.trim("agent_type")
    info = F.when(name == "rt", 1).when(name == "dms", 2).otherwise(field(table, "real_time_info", "int", 0))
    return table.select(name.alias("agent_type"), field(table, "vot", default=10.0).alias("vot"), F.coalesce(F.nullif(field(table, "pce", default=1.0), F.lit(0.0)), F.lit(1.0)).alias("pce"), field(table, "occ", default=1.0).alias("occ"), field(table, "desired_speed_ratio", default=1.0).alias("desired_speed_ratio"), field(table, "headway", default=1.0).alias("headway"), info.alias("real_time_info")).dropDuplicates(["agent_type"])


def departure_profiles(table: DataFrame) -> DataFrame:
    """SRC-08: long ``profile_no, slot5, ratio`` from columns ``THHMM``."""
    slots = [c for c in table.columns if len(c) == 5 and c[0] == "T" and c[1:].isdigit()]
    wide = table.select(field(table, "departure_time_profile_no", "int", 1).alias("profile_no"), *[field(table, c, default=0.0).alias(c) for c in slots])
    long = wide.unpivot(["profile_no"], slots, "slot", "ratio")
    return long.select("profile_no", clock.minutes_of(F.col("slot")).cast("long").alias("slot5"), "ratio")


def nodes(df: DataFrame) -> DataFrame:
    """SRC-11: the first row of each node_id."""
    out = df.select("_row", field(df, "node_id", "int", required=True).alias("node_id"), field(df, "zone_id", "int").alias("zone_id"), field(df, "x_coord", default=0.0).alias("x_coord"), field(df, "y_coord", default=0.0).alias("y_coord"), field(df, "node_type", "string", "").alias("node_type"), field(df, "is_boundary", "int", 0).alias("is_boundary"), field(df, "district_id", "int", -1).alias("district_id"), field(df, "agent_type", "string", "").alias("agent_type"))
    first = out.where("node_id is not null").groupBy("node_id").agg(F.min_by(F.struct(*[c for c in out.columns if c not in ("node_id", "_row")]), "_row").alias("r"))
    return first.select("node_id", "r.*")


def zones(df: DataFrame) -> DataFrame:
    """SRC-12, JN-06: ``node_id, zone_id, production, attraction`` for each access node."""
    rows = df.select(field(df, "zone_id", "int", required=True).alias("zone_id"), field(df, "production", default=0.0).alias("production"), field(df, "attraction", default=0.0).alias("attraction"), F.explode_outer(clock.id_list(field(df, "access_node_vector", "string", ""))).alias("node_id"))
    return rows.select("node_id", "zone_id", "production", "attraction")


def links(df: DataFrame, period: int = 1, hours: float = 1.0) -> DataFrame:
    """SRC-13, FN-01..05: one row per link with units, defaults and the parameters of one period.

    ``link_id`` is the row's number in file order; of links between the same nodes all
    are kept.  The text id of the file is ``name``.
    """
    f = lambda name, default=None, **k: field(df, name, default=default, **k)
    length, speed = F.greatest(f("length", 1.0, required=True, nonnegative=True), F.lit(1.0)), units.usable_speed(f("free_speed", 60.0))
    lanes, lane_capacity = f("lanes", 1.0), f("capacity", 1800.0)
    p = str(period)
    rows = df.select(
        "_row",
        field(df, "from_node_id", "int", required=True).alias("from_node_id"), field(df, "to_node_id", "int", required=True).alias("to_node_id"),
        field(df, "link_id", "string", "").alias("name"), length.alias("length_m"), lanes.alias("lanes"), speed.alias("free_speed"), lane_capacity.alias("lane_capacity"),
        field(df, "link_type", "int", 2).alias("link_type"), field(df, "vdf_code", "string", "").alias("vdf_code"), field(df, "tmc_corridor_name", "string", "network_wide").alias("corridor"),
        F.coalesce(F.nullif(f(f"VDF_fftt{p}", -1.0), F.lit(-1.0)), units.free_minutes(length, speed)).alias("fftt"),
        units.period_capacity(lane_capacity, lanes, hours, F.nullif(f(f"VDF_cap{p}", -1.0), F.lit(-1.0))).alias("period_cap"),
        units.cutoff_speed(speed, F.nullif(f("cutoff_speed", -1.0), F.lit(-1.0))).alias("cutoff"),
        f(f"VDF_alpha{p}", vdf.DEFAULTS["alpha"]).alias("alpha"), f(f"VDF_beta{p}", vdf.DEFAULTS["beta"]).alias("beta"),
        f(f"VDF_preload{p}", 0.0).alias("preload"), f(f"VDF_penalty{p}", 0.0).alias("penalty"), field(df, f"VDF_allowed_uses{p}" if f"VDF_allowed_uses{p}" in df.columns else "allowed_uses", "string", "").alias("allowed_uses"),
        f("cycle_length", 0.0).alias("cycle"), units.red_seconds(f("cycle_length", 0.0), f("start_green_time", 0.0), f("end_green_time", 0.0)).alias("red"), f("saturation_flow_rate", 1800.0).alias("saturation"),
        units.spatial_capacity(length, lanes).alias("room"), field(df, "geometry", "string", "").alias("geometry"),
    )
    # numbers follow file order: counted per input part, then offset, so that no task holds all links
    part = F.shiftright("_row", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    numbered = rows.withColumn("_p", part).withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy("_row"))).join(F.broadcast(offsets), "_p")
    return numbered.withColumn("link_id", (F.col("_i") + F.col("_o")).cast("int")).drop("_p", "_i", "_o", "_row")


def tolls(df: DataFrame, links_: DataFrame, period: int = 1) -> DataFrame:
    """SRC-13: long ``link_id, agent_type, toll`` from columns ``VDF_toll{agent}{period}``; of parallel links each has the greatest toll between its nodes."""
    suffix = str(period)
    cols = [c for c in df.columns if c.startswith("VDF_toll") and c.endswith(suffix) and len(c) > 8 + len(suffix)]
    ends = [field(df, c, "int").alias(c) for c in ("from_node_id", "to_node_id")]
    if not cols:
        return links_.select("link_id", F.lit("").alias("agent_type"), F.lit(0.0).alias("toll")).limit(0)
    names = {c: c[8 : -len(suffix)] for c in cols}
    long = df.select(*ends, *[field(df, c, default=0.0).alias(names[c]) for c in cols]).unpivot(["from_node_id", "to_node_id"], list(names.values()), "agent_type", "toll")
    most = long.where("toll <> 0").groupBy("from_node_id", "to_node_id", "agent_type").agg(F.max("toll").alias("toll"))
    return links_.select("link_id", "from_node_id", "to_node_id").join(most, ["from_node_id", "to_node_id"]).select("link_id", "agent_type", "toll")


def queue_parameters(df: DataFrame, period: int = 1) -> tuple[DataFrame, DataFrame]:
    """SRC-14: (by link, by vdf_code) parameters; a column that is missing keeps its default; classes are averaged."""
    p = str(period)
    params = {"qdf": 1.0, "q_n": vdf.DEFAULTS["q_n"], "q_s": vdf.DEFAULTS["q_s"], "q_cp": vdf.DEFAULTS["q_cp"], "q_cd": vdf.DEFAULTS["q_cd"], "q_alpha": vdf.DEFAULTS["q_alpha"], "q_beta": vdf.DEFAULTS["q_beta"]}
    cols = [field(df, f"QVDF_{k.removeprefix('q_')}{p}", default=v).alias(k) for k, v in params.items()]
    rows = df.select(field(df, "data_type", "string", "").alias("data_type"), field(df, "from_node_id", "int").alias("from_node_id"), field(df, "to_node_id", "int").alias("to_node_id"), field(df, "vdf_code", "string", "").alias("vdf_code"), *cols)
    means = [F.avg(k).alias(k) for k in params]
    return rows.where("data_type = 'link'").groupBy("from_node_id", "to_node_id").agg(*means), rows.where("data_type = 'vdf_code'").groupBy("vdf_code").agg(*means)


def with_queue_parameters(links_: DataFrame, by_link: DataFrame, by_code: DataFrame, hours: float) -> DataFrame:
    """JN-07, VDF-19: parameters of the link, else of its class, else of class ``all``, else the defaults."""
    names = ["qdf", *[k for k in vdf.DEFAULTS if k.startswith("q_")]]
    own = by_link.select("from_node_id", "to_node_id", F.struct(*names).alias("_own"))
    code = by_code.select("vdf_code", F.struct(*names).alias("_code"))
    any_ = by_code.where("vdf_code = 'all'").select(F.struct(*names).alias("_any"))
    rows = links_.join(broadcast_within(own, 80), ["from_node_id", "to_node_id"], "left").join(broadcast_within(code, 100), "vdf_code", "left").join(F.broadcast(any_), F.lit(True), "left")  # one row at most: by_code has one for each code
    best = F.coalesce("_own", "_code", "_any")
    default = {**vdf.DEFAULTS, "qdf": 1.0 / hours}
    return rows.withColumns({n: F.coalesce(best[n], F.lit(default[n])) for n in names}).drop("_own", "_code", "_any")


def demand_column(df: DataFrame, agent_type: str, scale: float = 1.0) -> DataFrame:
    """SRC-15, FLT-12: ``o_zone_id, d_zone_id, agent_type, volume`` of a long list, up to its first volume below -99."""
    from ..operators.demand import before_sentinel

    rows = df.select("_row", field(df, "o_zone_id", "int", required=True).alias("o_zone_id"), field(df, "d_zone_id", "int", required=True).alias("d_zone_id"), field(df, "volume", default=0.0, required=True).alias("volume"))
    kept = before_sentinel(rows, "_row").where("o_zone_id <> d_zone_id and volume > 0")
    return kept.select("o_zone_id", "d_zone_id", F.lit(agent_type).alias("agent_type"), (F.col("volume") * scale).alias("volume"))


def demand_matrix(df: DataFrame, agent_type: str, scale: float = 1.0) -> DataFrame:
    """SRC-16: the same from a square matrix whose header has the destination zones (whole numbers from 1)."""
    origin = next(c for c in df.columns if c != "_row")
    targets = [c for c in df.columns if c.isdigit() and int(c) >= 1 and c != origin]
    wide = df.select(F.col(f"`{origin}`").try_cast("int").alias("o_zone_id"), *[field(df, c, default=0.0).alias(c) for c in targets])
    long = wide.unpivot(["o_zone_id"], targets, "d", "volume")
    return long.select("o_zone_id", F.col("d").cast("int").alias("d_zone_id"), F.lit(agent_type).alias("agent_type"), (F.col("volume") * scale).alias("volume")).where("o_zone_id is not null and o_zone_id <> d_zone_id and volume > 0")


def demand_paths(df: DataFrame, agent_type: str, scale: float = 1.0) -> DataFrame:
    """SRC-17: fixed routes: ``path_id, o_zone_id, d_zone_id, agent_type, volume, nodes``."""
    return df.select(field(df, "path_id", "string", "").alias("path_id"), field(df, "o_zone_id", "int", required=True).alias("o_zone_id"), field(df, "d_zone_id", "int", required=True).alias("d_zone_id"), F.lit(agent_type).alias("agent_type"), (field(df, "volume", default=0.0) * scale).alias("volume"), clock.id_list(field(df, "node_sequence", "string", "")).alias("nodes"))


def demand_activities(df: DataFrame) -> DataFrame:
    """SRC-18: one row per leg of an activity plan, each seeded with 0.01 trips."""
    zones_, types = clock.id_list(field(df, "activity_zone_sequence", "string", "")), F.split(field(df, "activity_agent_type_sequence", "string", ""), ";")
    whole = F.concat(F.array(field(df, "o_zone_id", "int")), zones_, F.array(field(df, "d_zone_id", "int")))
    rows = df.select(field(df, "agent_id", "string", "").alias("agent_id"), whole.alias("z"), types.alias("t"))
    legs = rows.select("agent_id", "t", "z", F.posexplode(F.slice("z", F.lit(1), F.size("z") - 1)).alias("leg", "o_zone_id"))
    return legs.select("agent_id", "leg", "o_zone_id", F.element_at("z", F.col("leg") + 2).alias("d_zone_id"), F.coalesce(F.try_element_at("t", F.col("leg") + 1), F.try_element_at("t", F.lit(1))).alias("agent_type"), F.lit(0.01).alias("volume"))


def measurements(df: DataFrame, period: int = 1) -> DataFrame:
    """SRC-20: ``measurement_type, from_node_id, to_node_id, o_zone_id, d_zone_id, obs_count, upper_bound_flag``; of several counts of a link an actual count comes before an upper bound, the later row before the earlier."""
    p = str(period)
    rows = df.select("_row", field(df, "measurement_type", "string", "").alias("measurement_type"), *[field(df, c, "int").alias(c) for c in ("from_node_id", "to_node_id", "o_zone_id", "d_zone_id")], field(df, f"count{p}" if f"count{p}" in df.columns else "count", default=0.0).alias("obs_count"), field(df, f"upper_bound_flag{p}", "int", 0).alias("upper_bound_flag"))
    w = W.partitionBy("measurement_type", "from_node_id", "to_node_id", "o_zone_id", "d_zone_id").orderBy("upper_bound_flag", F.desc("_row"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_row")


def scenario_links(df: DataFrame, kind: str = "sa") -> DataFrame:
    """SRC-21: ``from_node_id, to_node_id, lanes`` of one scenario type."""
    rows = df.where(F.col("scenario_type") == kind)
    return rows.select(field(df, "from_node_id", "int").alias("from_node_id"), field(df, "to_node_id", "int").alias("to_node_id"), field(df, "lanes", default=0.0).alias("lanes"))


def demand_factors(df: DataFrame, scenario: bool = False) -> DataFrame:
    """SRC-22: district factors, base (o_based, d_based, od_based) or with prefix ``sa_``."""
    kinds = [("sa_" if scenario else "") + k for k in ("o_based", "d_based", "od_based")]
    rows = df.where(F.col("scenario_type").isin(kinds))
    return rows.select(F.regexp_replace("scenario_type", "^sa_", "").alias("scenario_type"), field(df, "o_district_id", "int").alias("o_district_id"), field(df, "d_district_id", "int").alias("d_district_id"), field(df, "scale_factor", default=1.0).alias("scale_factor"))


def subarea(df: DataFrame) -> list[tuple[float, float]]:
    """SRC-23: the ring of the first polygon."""
    first = df.orderBy("_row").select(geometry.points_of(F.col("geometry")).alias("p")).first()
    ring = [(p["x"], p["y"]) for p in first["p"]] if first and first["p"] else []
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring


def movements(df: DataFrame, least_penalty: float = 99.0) -> DataFrame:
    """SRC-29: prohibited turns ``ib_link_id, ob_link_id``."""
    return df.where(field(df, "penalty", default=0.0) >= least_penalty).select(field(df, "ib_link_id", "string").alias("ib_link_id"), field(df, "ob_link_id", "string").alias("ob_link_id"))


def agents(df: DataFrame) -> DataFrame:
    """SRC-27: agents of the microscopic model."""
    return df.select(field(df, "agent_id", "long", required=True).alias("agent_id"), field(df, "o_node_id", "int", required=True).alias("o_node_id"), field(df, "d_node_id", "int", required=True).alias("d_node_id"), field(df, "departure_time_in_min", default=0.0).alias("depart_min"), field(df, "PCE", default=1.0).alias("pce"), field(df, "path_fixed_flag", "int", 0).alias("path_fixed_flag"), clock.id_list(field(df, "path_node_sequence", "string", "")).alias("nodes"))


def taz(df: DataFrame) -> DataFrame:
    """SRC-24: planning areas ``zone_id, x_coord, y_coord``; without coordinates, the mean of the geometry's points."""
    rows = df.select(field(df, "zone_id", "int", required=True).alias("zone_id"), field(df, "x_coord").alias("_x"), field(df, "y_coord").alias("_y"), geometry.points_of(field(df, "geometry", "string", "")).alias("_p"))
    mean = lambda c: F.aggregate("_p", F.lit(0.0), lambda acc, p: acc + p[c]) / F.nullif(F.size("_p"), F.lit(0))
    return rows.where("zone_id is not null").select("zone_id", F.coalesce("_x", mean("x")).alias("x_coord"), F.coalesce("_y", mean("y")).alias("y_coord"))


def exists(spark: SparkSession, path: str) -> bool:
    """SRC-25: whether there is a file, by the file system that Spark reads it with."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def demand_formats(files: DataFrame) -> list[tuple[str, str, str, str, float]]:
    """SRC-09: (file, format, agent type, period, scale) of each row of the demand file list, in order; the format is the kind that its text names."""
    rows = files.select(field(files, "file_name", "string", "").alias("f"), F.lower(field(files, "format_type", "string", "column")).alias("t"), field(files, "agent_type", "string", "p").alias("a"), field(files, "demand_period", "string", "am").alias("p"), field(files, "scale_factor", default=1.0).alias("s"))
    kind = lambda t: next((k for k in ("column", "path", "activity_plan", "matrix") if k in t), "column")
    return [(r["f"], kind(r["t"]), r["a"], r["p"], r["s"]) for r in rows.collect() if r["f"]]


def demand(spark: SparkSession, folder: str, files: DataFrame, scaled: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-09: the demand of all listed files that exist: cells (``o_zone_id, d_zone_id, agent_type, demand_period, volume``), and fixed paths (with ``path_id, nodes``).  ``scaled`` is applied to what column files give (DM-05)."""
    cells = spark.createDataFrame([], "o_zone_id int, d_zone_id int, agent_type string, demand_period string, volume double")
    fixed = spark.createDataFrame([], "path_id string, o_zone_id int, d_zone_id int, agent_type string, demand_period string, volume double, nodes array<int>")
    for name, kind, agent, period, scale in demand_formats(files):
        path = f"{folder}/{name}"
        if not exists(spark, path):
            continue
        df = read_csv(spark, path)
        if kind == "path":
            fixed = fixed.unionByName(demand_paths(df, agent, scale).withColumn("demand_period", F.lit(period)))
            continue
        rows = demand_matrix(df, agent, scale) if kind == "matrix" else demand_activities(df).drop("agent_id", "leg") if kind == "activity_plan" else demand_column(df, agent, scale)
        if scaled is not None and kind == "column":
            rows = scaled(rows).select("o_zone_id", "d_zone_id", "agent_type", "volume")
        cells = cells.unionByName(rows.withColumn("demand_period", F.lit(period)))
    return cells, fixed


def probe(spark: SparkSession, folder: str) -> dict[str, int]:
    """SRC-25: what a folder offers: rows (1 if any) by table, and whether the nodes name zones."""
    out = {}
    for name in ("settings", "node", "link", "zone", "TAZ", "measurement", "supply_side_scenario", "subarea"):
        path = f"{folder}/{name}.csv"
        out[name] = int(exists(spark, path) and (name == "settings" or not read_csv(spark, path).isEmpty()))
    out["zones_in_nodes"] = int(bool(out["node"]) and not nodes(read_csv(spark, f"{folder}/node.csv")).where("zone_id > 0").isEmpty())
    return out
