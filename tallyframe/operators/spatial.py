"""Points in the plane: bounds, grids, hexagons, densities and map layers."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalar import hour_band, lookup
from tallyframe.operators.clean import drop_null_any
from tallyframe.operators.group import PARTS, region_summary
from tallyframe.plans.fitting import fit
from tallyframe.plans.sizing import small_table

# Colours of the map layers and the colour for anything else.
SEVERITY_COLOURS = {1: "green", 2: "yellow", 3: "orange", 4: "red"}
SEVERITY_OTHER = "gray"
WEATHER_COLOURS = {"Clear": "blue", "Cloudy": "gray", "Rain": "lightblue", "Snow": "white", "Fog": "darkgray"}
WEATHER_OTHER = "black"
HOUR_COLOURS = {"morning": "orange", "afternoon": "yellow", "evening": "purple", "night": "darkblue"}


def valid_points(df: DataFrame, lat: str, lng: str) -> DataFrame:
    return drop_null_any(df, [lat, lng])


def make_point(df: DataFrame, lat: str, lng: str, name: str = "point") -> DataFrame:
    """Add the point as a struct; x is the longitude."""
    return df.withColumn(name, F.struct(F.col(lng).alias("x"), F.col(lat).alias("y")))


def map_center(df: DataFrame, lat: str, lng: str) -> DataFrame:
    return valid_points(df, lat, lng).agg(F.avg(lat).alias("center_lat"), F.avg(lng).alias("center_lng"))


def point_bounds(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def _fit_bounds(df: DataFrame, x: str, y: str) -> dict:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return fit(df.select(x, y), {"minx": F.min(a), "miny": F.min(b), "maxx": F.max(a), "maxy": F.max(b)})


def _cell(c: Column, low: float, step: float) -> Column:
    return (c.cast("double") - F.lit(low)) / F.lit(step)


def grid_density(df: DataFrame, x: str, y: str, resolution: int = 20, closed: str = "none") -> DataFrame:
    """Points per cell of an equal grid over the point bounds.

    The cell is computed, not searched, so one scan serves any resolution.
    ``closed="none"`` counts points strictly inside a cell; ``"left"`` also
    counts points on the lower borders, and the last cell takes its far border.
    """
    s = _fit_bounds(df, x, y)
    steps = {} if s["minx"] is None else {
        "i": (x, s["minx"], (s["maxx"] - s["minx"]) / resolution),
        "j": (y, s["miny"], (s["maxy"] - s["miny"]) / resolution),
    }
    if not steps or any(step == 0 for _, _, step in steps.values()):
        return small_table(df.sparkSession, [], "i int, j int, n long")
    rows = drop_null_any(df.select(x, y), [x, y])
    rows = rows.select(*[_cell(F.col(c), low, step).alias(k) for k, (c, low, step) in steps.items()])
    if closed == "none":
        rows = rows.where((F.col("i") != F.floor("i")) & (F.col("j") != F.floor("j")))
    number = [F.least(F.floor(k), F.lit(resolution - 1)).cast("int").alias(k) for k in ("i", "j")]
    return rows.groupBy(*number).agg(F.count("*").alias("n"))


def points_in_grid(df: DataFrame, x: str, y: str, resolution: int = 20) -> DataFrame:
    """Occupied cells as rectangles with their point counts."""
    s = _fit_bounds(df, x, y)
    counted = grid_density(df, x, y, resolution)
    if s["minx"] is None:
        return counted
    dx, dy = (s["maxx"] - s["minx"]) / resolution, (s["maxy"] - s["miny"]) / resolution
    return counted.select(
        (F.lit(s["minx"]) + F.col("i") * F.lit(dx)).alias("minx"),
        (F.lit(s["miny"]) + F.col("j") * F.lit(dy)).alias("miny"),
        (F.lit(s["minx"]) + F.col("i") * F.lit(dx) + F.lit(dx)).alias("maxx"),
        (F.lit(s["miny"]) + F.col("j") * F.lit(dy) + F.lit(dy)).alias("maxy"),
        "n",
    )


def hexbin_density(df: DataFrame, x: str, y: str, columns: int = 30) -> DataFrame:
    """Points per hexagon: the nearer of two offset lattices of centres.

    Returns the centre in data coordinates and in lattice steps (``u``, ``v``).
    """
    s = _fit_bounds(df, x, y)
    if s["minx"] is None or s["maxx"] == s["minx"] or s["maxy"] == s["miny"]:
        return small_table(df.sparkSession, [], "u double, v double, x double, y double, n long")
    rows_n = int(columns / math.sqrt(3))
    dx, dy = (s["maxx"] - s["minx"]) / columns, (s["maxy"] - s["miny"]) / rows_n
    a, b = _cell(F.col(x), s["minx"], dx), _cell(F.col(y), s["miny"], dy)
    whole = (F.rint(a), F.rint(b))
    half = (F.floor(a) + F.lit(0.5), F.floor(b) + F.lit(0.5))

    def far(centre) -> Column:
        return (a - centre[0]) * (a - centre[0]) + 3.0 * (b - centre[1]) * (b - centre[1])

    near = F.when(far(whole) < far(half), F.struct(whole[0].alias("u"), whole[1].alias("v"))).otherwise(
        F.struct(half[0].alias("u"), half[1].alias("v"))
    )
    counted = drop_null_any(df.select(x, y), [x, y]).select(near.alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return counted.select(
        F.col("c.u").alias("u"),
        F.col("c.v").alias("v"),
        (F.lit(s["minx"]) + F.col("c.u") * F.lit(dx)).alias("x"),
        (F.lit(s["miny"]) + F.col("c.v") * F.lit(dy)).alias("y"),
        "n",
    )


def point_style(df: DataFrame, by: str, column: str, name: str = "colour") -> DataFrame:
    """Colour of each point by ``severity``, ``weather`` or ``hour`` (of a time column)."""
    c = F.col(column)
    styles = {
        "severity": lambda: lookup(c, SEVERITY_COLOURS, SEVERITY_OTHER),
        "weather": lambda: lookup(c, WEATHER_COLOURS, WEATHER_OTHER),
        "hour": lambda: hour_band(F.hour(c), HOUR_COLOURS),
    }
    if by not in styles:
        raise ValueError(f"unknown style {by!r}; choose from {tuple(styles)}")
    return df.withColumn(name, styles[by]())


def style_by_table(df: DataFrame, column: str, table: Mapping, default, name: str = "style") -> DataFrame:
    return df.withColumn(name, lookup(F.col(column), table, default))


def _square(c: Column, size: float) -> Column:
    return F.floor(c.cast("double") / F.lit(size)).cast("long")


def heat_points(df: DataFrame, lat: str, lng: str, cell: float) -> DataFrame:
    """Weighted points for a heat map: the centre and count of each square cell."""
    rows = valid_points(df, lat, lng)
    counted = rows.groupBy(_square(F.col(lat), cell).alias("r"), _square(F.col(lng), cell).alias("c")).agg(
        F.count("*").alias("weight")
    )
    half = F.lit(0.5)
    return counted.select(
        ((F.col("r") + half) * F.lit(cell)).alias("lat"), ((F.col("c") + half) * F.lit(cell)).alias("lng"), "weight"
    )


def zoom_cell(zoom: int, pixels: int = 80) -> float:
    """Degrees covered by a marker radius on a 256-pixel tiled map."""
    return pixels * 360.0 / (256 * 2**zoom)


def point_clusters(df: DataFrame, lat: str, lng: str, cell: float) -> DataFrame:
    """Points grouped by square cell with their count and mean position."""
    rows = valid_points(df, lat, lng)
    return rows.groupBy(_square(F.col(lat), cell).alias("row"), _square(F.col(lng), cell).alias("col")).agg(
        F.count("*").alias("n"), F.avg(lat).alias("lat"), F.avg(lng).alias("lng")
    )


def bubble_radius(df: DataFrame, region: str, row_id: str, means: Mapping[str, str]) -> DataFrame:
    """Region summary with a bubble radius of half the root of the count."""
    return region_summary(df, region, row_id, means).withColumn("radius", F.sqrt(F.col("n").cast("double")) / 2)


def spatial_density(df: DataFrame, x: str, y: str, resolution: int = 20, bandwidth: float = 1.0) -> DataFrame:
    """Gaussian density at the cell centres of the grid, from cell counts.

    ``bandwidth`` is in cell widths.  The kernel splits into an x and a y
    factor, so each count is spread along one axis and then along the other,
    and the cost depends on the resolution alone.
    """
    counted = grid_density(df, x, y, resolution, closed="left")
    axis = F.explode(F.sequence(F.lit(0), F.lit(resolution - 1)))

    def spread(rows: DataFrame, along: str, other: str, value: str) -> DataFrame:
        z = (F.col("to") - F.col(along)) / F.lit(bandwidth)
        out = rows.withColumn("to", axis).groupBy(F.col("to").alias(f"g{along}"), other)
        return out.agg(F.sum(F.col(value) * F.exp(-z * z / 2)).alias("density"))

    over_x = spread(counted, "i", "j", "n")
    over_y = spread(over_x, "j", "gi", "density")
    return over_y.select(F.col("gi").alias("i"), F.col("gj").alias("j"), "density")


def frames_by_time(
    df: DataFrame, time: str, part: str, x: str, y: str, cell: Sequence[float]
) -> DataFrame:
    """Points per time bucket and cell: the frames of an animation."""
    rows = drop_null_any(df, [time, x, y])
    return rows.groupBy(
        PARTS[part](F.col(time)).alias(part),
        _square(F.col(x), cell[0]).alias("i"),
        _square(F.col(y), cell[1]).alias("j"),
    ).agg(F.count("*").alias("n"))
