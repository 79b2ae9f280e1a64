"""Queries: points; prices stand in for longitude and quantities for latitude."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import query, rounded
from tallyframe.operators import spatial

_X, _Y = "l_extendedprice", "l_quantity"
_BOUNDS = f"""(SELECT min({_X}) AS minx, max({_X}) AS maxx, min({_Y}) AS miny, max({_Y}) AS maxy FROM lineitem)"""
_CELLS = f"""(SELECT ({_X} - minx) / ((maxx - minx) / 20) AS a, ({_Y} - miny) / ((maxy - miny) / 20) AS b, minx, maxx, miny, maxy
    FROM lineitem, {_BOUNDS})"""


@query("valid_points", "Y1", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_id % 7 >= 1 THEN value END AS v, user_id FROM events) WHERE v IS NOT NULL")
def _(t):
    from tallyframe.catalog.registry import nulled_events

    return spatial.valid_points(nulled_events(t).select("event_id", "v", "user_id"), "v", "user_id").drop("user_id")


@query("make_point", "Y2", "SELECT event_id, value AS x, user_id AS y FROM events")
def _(t):
    return spatial.make_point(t.events, "user_id", "value").select("event_id", "point.x", "point.y")


@query("map_center", "Y3", f"SELECT round(avg({_Y}), 6) AS center_lat, round(avg({_X}), 4) AS center_lng FROM lineitem")
def _(t):
    out = spatial.map_center(t.lineitem, _Y, _X)
    return rounded(rounded(out, 6, "center_lat"), 4, "center_lng")


@query("point_bounds", "Y4", f"SELECT minx, miny, maxx, maxy FROM {_BOUNDS}")
def _(t):
    return spatial.point_bounds(t.lineitem, _X, _Y)


@query(
    "grid_density",
    "G4",
    f"SELECT floor(a)::INTEGER AS i, floor(b)::INTEGER AS j, count(*) AS n FROM {_CELLS} WHERE a <> floor(a) AND b <> floor(b) GROUP BY 1, 2",
)
def _(t):
    return spatial.grid_density(t.lineitem, _X, _Y, 20)


@query(
    "grid_density_closed",
    "G4",
    f"SELECT least(floor(a), 19)::INTEGER AS i, least(floor(b), 19)::INTEGER AS j, count(*) AS n FROM {_CELLS} GROUP BY 1, 2",
)
def _(t):
    return spatial.grid_density(t.lineitem, _X, _Y, 20, closed="left")


@query(
    "points_in_grid",
    "J1",
    f"""SELECT round(minx + floor(a) * ((maxx - minx) / 20), 4) AS minx, round(miny + floor(b) * ((maxy - miny) / 20), 4) AS miny,
          round(minx + (floor(a) + 1) * ((maxx - minx) / 20), 4) AS maxx, round(miny + (floor(b) + 1) * ((maxy - miny) / 20), 4) AS maxy,
          count(*) AS n FROM (SELECT * FROM {_CELLS}) c WHERE a <> floor(a) AND b <> floor(b)
        GROUP BY floor(a), floor(b), c.minx, c.maxx, c.miny, c.maxy""",
)
def _(t):
    return rounded(spatial.points_in_grid(t.lineitem, _X, _Y, 20), 4)


@query(
    "hexbin_density",
    "G5",
    f"""WITH p AS (SELECT ({_X} - minx) / ((maxx - minx) / 30) AS a, ({_Y} - miny) / ((maxy - miny) / 17) AS b FROM lineitem, {_BOUNDS}),
          d AS (SELECT round_even(a, 0) AS wa, round_even(b, 0) AS wb, floor(a) + 0.5 AS ha, floor(b) + 0.5 AS hb, a, b FROM p)
        SELECT CASE WHEN w THEN wa ELSE ha END AS u, CASE WHEN w THEN wb ELSE hb END AS v, count(*) AS n
        FROM (SELECT *, (a-wa)*(a-wa) + 3.0*(b-wb)*(b-wb) < (a-ha)*(a-ha) + 3.0*(b-hb)*(b-hb) AS w FROM d) GROUP BY 1, 2""",
)
def _(t):
    return spatial.hexbin_density(t.lineitem, _X, _Y, 30).select("u", "v", "n")


@query(
    "point_style_severity",
    "Y5",
    """SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'green' WHEN 2 THEN 'yellow' WHEN 3 THEN 'orange' WHEN 4 THEN 'red'
       ELSE 'gray' END AS colour, count(*) AS n FROM lineitem GROUP BY ALL""",
)
def _(t):
    return spatial.point_style(t.lineitem, "severity", "l_linenumber").groupBy("l_linenumber", "colour").agg(
        F.count("*").alias("n")
    )


@query(
    "point_style_hour",
    "Y5 D4",
    """SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'orange' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'yellow'
       WHEN hour(ts) BETWEEN 18 AND 21 THEN 'purple' ELSE 'darkblue' END AS colour FROM events""",
)
def _(t):
    return spatial.point_style(t.events, "hour", "ts").select("event_id", "colour")


@query(
    "style_by_table",
    "Y5 B4",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'blue' WHEN 'O' THEN 'gray' ELSE 'black' END AS style FROM orders",
)
def _(t):
    return spatial.style_by_table(t.orders, "o_orderstatus", {"F": "blue", "O": "gray"}, "black").select("o_orderkey", "style")


@query(
    "heat_points",
    "Y6",
    f"""SELECT (floor({_Y} / 5000.0::DOUBLE) + 0.5) * 5000.0::DOUBLE AS lat, (floor({_X} / 5000.0::DOUBLE) + 0.5) * 5000.0::DOUBLE AS lng,
        count(*) AS weight FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    return spatial.heat_points(t.lineitem, _Y, _X, 5000.0)


@query(
    "point_clusters",
    "Y7",
    f"""SELECT floor({_Y} / 28.125::DOUBLE)::BIGINT AS "row", floor({_X} / 28.125::DOUBLE)::BIGINT AS col, count(*) AS n, round(sum({_Y}), 2) AS lat_total,
        round(sum({_X}), 2) AS lng_total FROM lineitem GROUP BY 1, 2""",
)
def _(t):
    """Mean positions are compared as totals, which have two decimals."""
    out = spatial.point_clusters(t.lineitem, _Y, _X, spatial.zoom_cell(2))
    totals = {f"{c}_total": F.round(F.col(c) * F.col("n"), 2) for c in ("lat", "lng")}
    return out.withColumns(totals).drop("lat", "lng")


@query(
    "bubble_radius",
    "Y8",
    """SELECT c_nationkey, count(c_custkey) AS n, round(avg(c_acctbal), 4) AS mean_balance, round(sqrt(count(c_custkey)) / 2, 6) AS radius
       FROM customer GROUP BY c_nationkey""",
)
def _(t):
    out = spatial.bubble_radius(t.customer, "c_nationkey", "c_custkey", {"mean_balance": "c_acctbal"})
    return rounded(rounded(out, 4, "mean_balance"), 6, "radius")


@query(
    "spatial_density",
    "Y9",
    f"""WITH c AS (SELECT least(floor(a), 19) AS i, least(floor(b), 19) AS j, count(*) AS n FROM {_CELLS} GROUP BY 1, 2),
          g AS (SELECT x.i::INTEGER AS gi, y.i::INTEGER AS gj FROM range(20) x(i), range(20) y(i))
        SELECT gi AS i, gj AS j, round(sum(n * exp(-((gi - i) ** 2 + (gj - j) ** 2) / 2)), 4) AS density FROM g, c GROUP BY gi, gj""",
)
def _(t):
    return rounded(spatial.spatial_density(t.lineitem, _X, _Y, 20), 4)


@query(
    "frames_by_time",
    "Y10",
    """SELECT hour(ts)::INTEGER AS hour, floor(value / 50.0::DOUBLE)::BIGINT AS i, floor(user_id / 25.0::DOUBLE)::BIGINT AS j, count(*) AS n
       FROM events GROUP BY 1, 2, 3""",
)
def _(t):
    return spatial.frames_by_time(t.events, "ts", "hour", "value", "user_id", (50.0, 25.0))
