"""Unit and performance formulas of a link (FN-01..10, FN-21..24)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: metres of a mile in all reports.
METRES = 1609.0
#: Fixed value: kilometres per mile when distances of reports are converted.
KM_PER_MILE = 1.6090


def miles(length_m: Column) -> Column:
    """FN-01; lengths below one metre count as one metre."""
    return F.greatest(length_m, F.lit(1.0)) / METRES


def usable_speed(speed: Column) -> Column:
    """FN-01: missing or tiny speeds are 60 mph."""
    return F.when(speed <= 0.1, 60.0).otherwise(speed)


def free_minutes(length_m: Column, speed: Column) -> Column:
    """FN-01: free-flow travel time in minutes."""
    return miles(length_m) / usable_speed(speed) * 60.0


def spatial_capacity(length_m: Column, lanes: Column, jam_density: float | Column = 300.0) -> Column:
    """FN-02: vehicles that fit on a link, one at least."""
    return F.greatest(F.lit(1.0), miles(length_m) * lanes * jam_density)


def period_capacity(lane_capacity: Column, lanes: Column, hours: float | Column, given: Column | None = None) -> Column:
    """FN-03: capacity of a period, unless one is given."""
    own = lane_capacity * lanes * hours
    return own if given is None else F.coalesce(given, own)


def cutoff_speed(free_speed: Column, given: Column | None = None) -> Column:
    """FN-04: speed at capacity, 0.85 of free speed unless given."""
    own = free_speed * 0.85
    return own if given is None else F.coalesce(given, own)


def red_seconds(cycle: Column, start_green: Column, end_green: Column) -> Column:
    """FN-05: red time of a signal; a negative green means that green lasts the cycle."""
    green = F.when(end_green - start_green < 0, cycle).otherwise(end_green - start_green)
    return F.greatest(F.lit(1.0), cycle - green)


def allowed(uses: Column, agent_type: Column) -> Column:
    """FN-06: empty or ``all`` lets every type pass; else the type is one of the ``;`` list."""
    listed = F.transform(F.split(F.coalesce(uses, F.lit("")), ";"), lambda x: F.trim(x))
    return (F.coalesce(F.trim(uses), F.lit("")).isin("", "all")) | F.array_contains(listed, agent_type)


def generalized_cost(minutes: Column, penalty: Column, toll: Column, vot: Column, price: Column | float = 0.0) -> Column:
    """FN-07 (with a Lagrangian price) and FN-08 (without): minutes, penalty and toll over value of time per hour."""
    extra = price if isinstance(price, Column) else F.lit(float(price))
    return minutes + penalty + extra + toll / vot * 60.0


def travel_speed(free_speed: Column, minutes: Column, fftt: Column) -> Column:
    """FN-09: speed that a travel time means."""
    return F.when(minutes > 0.001, free_speed / F.greatest(F.lit(1e-6), minutes) * fftt).otherwise(free_speed)


def speed_ratio(speed: Column, free_speed: Column) -> Column:
    """FN-09."""
    return speed / F.greatest(F.lit(1.0), free_speed)


def capped_ratio(speed: Column, cutoff: Column) -> Column:
    """FN-24: speed over cutoff speed, 1 at most."""
    return F.least(F.lit(1.0), speed / F.greatest(F.lit(1.0), cutoff))


def measures(volume: Column, persons: Column, miles_: Column, minutes: Column, fftt: Column, cutoff_minutes: Column) -> dict[str, Column]:
    """FN-10: VMT, VHT, PMT, PHT, delay against free flow, delay against the cutoff speed (not below 0)."""
    return {
        "vmt": volume * miles_,
        "vht": volume * minutes / 60.0,
        "pmt": persons * miles_,
        "pht": persons * minutes / 60.0,
        "delay_free": volume * (minutes - fftt) / 60.0,
        "delay_cutoff": F.greatest(F.lit(0.0), volume * (minutes - cutoff_minutes) / 60.0),
    }


def vehicle_pce(pce: Column) -> Column:
    """FN-21: whole passenger-car equivalents, one at least."""
    return F.greatest(F.lit(1), F.floor(pce + 0.5)).cast("int")


def free_time_ratio(desired_speed_ratio: Column) -> Column:
    """FN-21: how much slower than free flow a vehicle wants to go, 1 at least."""
    return F.greatest(F.lit(1.0), 1.0 / F.greatest(F.lit(0.01), desired_speed_ratio))


def headway_steps(seconds: Column, step: float = 0.25) -> Column:
    """FN-21: headway in simulation steps."""
    return F.floor(seconds / step + 0.5).cast("long")


def critical_density(capacity: Column, speed: Column | float = 45.0) -> Column:
    """FN-22."""
    return capacity / speed


def s3_exponent(free_speed: Column, speed_at_capacity: Column) -> Column:
    """FN-22: exponent of the S-shaped speed-density curve."""
    return 2.0 * F.ln(F.lit(2.0)) / F.ln(free_speed / speed_at_capacity)


def s3_flow(speed: Column, free_speed: Column, density_at_capacity: Column, m: Column) -> Column:
    """FN-23: flow at a speed on the S-shaped curve."""
    density = density_at_capacity * F.pow(F.greatest(F.lit(0.0), F.pow(free_speed / F.greatest(speed, F.lit(0.001)), m / 2.0) - 1.0), 1.0 / m)
    return speed * density
