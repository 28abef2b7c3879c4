"""Times of day as text and as minutes (FN-11..17, FN-19)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_of(text: Column) -> Column:
    """FN-11, 12: minutes of ``[T][DD]HHMM[:SS[:sss]]``; null if it is no such text."""
    t = F.regexp_replace(text, "^T", "")
    digits = F.regexp_extract(t, r"^(\d{4}|\d{6})(?::|$)", 1)
    day = F.when(F.length(digits) == 6, F.substring(digits, 1, 2).try_cast("double")).otherwise(0.0)
    hhmm = F.right(digits, F.lit(4))
    seconds = F.coalesce(F.regexp_extract(t, r"^\d+:(\d{1,2})", 1).try_cast("double"), F.lit(0.0))
    milli = F.coalesce(F.regexp_extract(t, r"^\d+:\d{1,2}:(\d{1,3})", 1).try_cast("double"), F.lit(0.0))
    total = day * 1440.0 + F.substring(hhmm, 1, 2).try_cast("double") * 60.0 + F.right(hhmm, F.lit(2)).try_cast("double") + seconds / 60.0 + milli / 60000.0
    return F.when(digits != "", total)


def window_of(text: Column) -> tuple[Column, Column]:
    """FN-11: (start, end) minutes of ``HHMM_HHMM``."""
    parts = F.split(text, "_")
    return minutes_of(F.try_element_at(parts, F.lit(1))), minutes_of(F.try_element_at(parts, F.lit(2)))


def clock_text(minutes: Column) -> Column:
    """FN-13: ``HHMM:SS.sss`` of minutes."""
    seconds = minutes * 60.0 + 0.02
    whole = F.floor(seconds)
    milli = F.floor((seconds - whole) * 1000)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(pad(F.floor(whole / 3600), 2), pad(F.floor(whole / 60) % 60, 2), F.lit(":"), pad(whole % 60, 2), F.lit("."), pad(milli, 3))


def hhmm(minutes: Column, prefix: str = "T") -> Column:
    """FN-14, 17: ``THHMM`` of whole minutes."""
    m = F.floor(minutes)
    return F.concat(F.lit(prefix), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lpad((m % 60).cast("string"), 2, "0"))


def slot5(minutes: Column) -> Column:
    """FN-17: start of the 5-minute slot."""
    return (F.floor(minutes / 5) * 5).cast("long")


def minute_of_day(ts: Column) -> Column:
    """Minutes since midnight of a timestamp."""
    return (F.hour(ts) * 60 + F.minute(ts)).cast("long")


def to_steps(minutes: Column, seconds_per_step: float) -> Column:
    """FN-19: simulation step of a time."""
    return F.floor(minutes * 60.0 / seconds_per_step).cast("long")


def id_list(text: Column) -> Column:
    """FN-15: integers of a ``;`` list up to the first item that is none."""
    items = F.transform(F.split(text, ";"), lambda x: F.trim(x).try_cast("int"))
    bad = F.array_position(F.transform(items, lambda x: x.isNull()), True)
    return F.when(bad == 0, items).otherwise(F.slice(items, F.lit(1), F.greatest(bad - 1, F.lit(0)).cast("int")))


def split_any(text: Column, separators: str) -> Column:
    """FN-16: split at any of the characters; empty parts are dropped."""
    import re

    return F.filter(F.split(text, f"[{re.escape(separators)}]"), lambda x: x != "")
