"""WKT, distances, polygons and grid cells as column expressions (FN-20, GEO-01..09)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: earth radius in metres.
EARTH_M = 6372797.56085
#: Grid resolutions in degrees.
RESOLUTIONS = (0.00005, 0.0001, 0.0002, 0.00025, 0.0005, 0.00075, 0.001, 0.002, 0.0025, 0.005, 0.0075, 0.01, 0.02, 0.025, 0.05, 0.075, 0.1, 0.2, 0.25, 0.5, 0.75, 1.0, 2.0, 2.5, 5.0, 7.5, 10.0, 20.0, 25.0, 50.0, 75.0)


def points_of(wkt: Column) -> Column:
    """GEO-01: the points of POINT, LINESTRING, MULTILINESTRING or POLYGON text as array<struct<x, y>>."""
    body = F.regexp_replace(F.regexp_extract(wkt, r"(?s)\((.*)\)", 1), r"[()]", "")
    parts = F.filter(F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+")), lambda p: F.size(p) >= 2)
    return F.transform(parts, lambda p: F.struct(p[0].try_cast("double").alias("x"), p[1].try_cast("double").alias("y")))


def line_text(points: Column, kind: str = "LINESTRING") -> Column:
    """GEO-08, FN-18: WKT of points."""
    inner = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    return F.concat(F.lit(f"{kind} ({'(' if kind == 'POLYGON' else ''}"), inner, F.lit("))" if kind == "POLYGON" else ")"))


def haversine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """GEO-02: metres between two lon/lat points."""
    dy, dx = F.radians(y2 - y1), F.radians(x2 - x1)
    a = F.pow(F.sin(dy / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(dx / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """GEO-03: crossing number of a ray from the point, odd for inside; ``ring`` closes by itself."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if ay == by:
            continue
        spans = (F.lit(ay) <= y) != (F.lit(by) <= y)
        crossings = crossings + (spans & (x < (y - ay) * (bx - ax) / (by - ay) + ax)).cast("int")
    return crossings % 2 == 1


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: tuple, b: tuple, c: tuple, d: tuple) -> Column:
    """GEO-04: whether open segments ab and cd cross; shared end points do not count."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = a, b, c, d
    return (_side(ax, ay, bx, by, cx, cy) * _side(ax, ay, bx, by, dx, dy) < 0) & (_side(cx, cy, dx, dy, ax, ay) * _side(cx, cy, dx, dy, bx, by) < 0)


def crosses_ring(x1: Column, y1: Column, x2: Column, y2: Column, ring: list[tuple[float, float]]) -> Column:
    """GEO-04: whether a segment crosses an edge of a polygon."""
    out = F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        out = out | segments_cross((x1, y1), (x2, y2), (F.lit(ax), F.lit(ay)), (F.lit(bx), F.lit(by)))
    return out


def cell_of(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """FN-20: column and row of the grid cell of a point."""
    return F.floor(x / size + 1e-9).cast("long"), F.floor(y / size + 1e-9).cast("long")


def cell_code(cx: Column, cy: Column, cx0: Column, cy0: Column) -> Column:
    """FN-20: letters of the column and number of the row, counted from the lowest cell."""
    i = (cx - cx0).cast("int")
    letter = lambda k: F.char(F.lit(65) + k)
    name = F.when(i < 26, letter(i)).otherwise(F.concat(letter(F.floor(i / 26) - 1), letter(i % 26)))
    return F.concat(name, (cy - cy0).cast("string"))


def cell_polygon(cx: Column, cy: Column, size: float) -> Column:
    """GEO-09: WKT of a cell."""
    corner = lambda a, b: F.struct(F.round((cx + a) * size, 6).alias("x"), F.round((cy + b) * size, 6).alias("y"))
    return line_text(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)), "POLYGON")


def resolution(extent: Column, nodes: Column) -> Column:
    """GEO-07: the smallest listed cell size above the mean extent over 8 (10 with more than 3,000 nodes)."""
    wanted = extent / F.when(nodes > 3000, 10.0).otherwise(8.0)
    return F.coalesce(F.try_element_at(F.filter(F.array(*[F.lit(r) for r in RESOLUTIONS]), lambda r: r > wanted), F.lit(1)), F.lit(RESOLUTIONS[-1]))


def hull(points: np.ndarray) -> np.ndarray:
    """GEO-05: corners of the convex hull, counter-clockwise from the lowest-left point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(ordered: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in ordered:
            while len(out) > 1:
                u, v = out[-1] - out[-2], p - out[-2]
                if u[0] * v[1] - u[1] * v[0] > 1e-15:
                    break
                out.pop()
            out.append(p)
        return out

    return np.array(chain(pts)[:-1] + chain(pts[::-1])[:-1])


#: Points of a key that a task holds before it keeps their hull only.
HELD = 50_000


def hulls(nodes: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """GEO-05, AGG-21: ``key, n_vertices, geometry`` of the convex hull of each group with four different points or more.

    Hulls merge: each task keeps the hulls of its share of a group, and the hull of these
    is the group's, so a group of any size is worked on by many tasks and what meets in one
    is a hull for each of them.  A few points go along, so that groups of fewer than four
    are known.
    """

    def shrink(points: np.ndarray) -> np.ndarray:
        points = np.unique(points, axis=0)
        return np.unique(np.concatenate((hull(points), points[:4])), axis=0)

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, list[np.ndarray]] = {}
        sizes: dict[object, int] = {}
        for pdf in batches:
            for name, own in pdf.groupby(key, dropna=False):
                held.setdefault(name, []).append(own[[x, y]].to_numpy())
                sizes[name] = sizes.get(name, 0) + len(own)
                if sizes[name] > HELD:
                    held[name] = [shrink(np.concatenate(held[name]))]
                    sizes[name] = len(held[name][0])
        for name, parts in held.items():
            few = shrink(np.concatenate(parts))
            yield pd.DataFrame({key: pd.Series([None if pd.isna(name) else name] * len(few), dtype=object), x: few[:, 0], y: few[:, 1]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(pdf[[x, y]].to_numpy(), axis=0)
        corners = hull(points)
        ring = ", ".join(f"{a:.6f} {b:.6f}" for a, b in [*corners, corners[0]])
        out = pdf[[key]].head(1).assign(n_vertices=len(corners), geometry=pd.Series([f"POLYGON (({ring}))"], dtype=object, index=pdf.index[:1]))
        return out if len(points) >= 4 else out.head(0)

    kind = nodes.schema[key].dataType.simpleString()
    points = nodes.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))
    return points.mapInPandas(share, f"`{key}` {kind}, `{x}` double, `{y}` double").groupBy(key).applyInPandas(whole, f"`{key}` {kind}, n_vertices long, geometry string")
