"""Queries: row order and correlation."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import nulled_events, query, rounded
from tallyframe.operators import correlate, ordered, splines
from tallyframe.plans.sizing import small_table


@query(
    "pct_change_monthly",
    "W2",
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, sum(o_totalprice) AS total FROM orders GROUP BY 1)
       SELECT month, round((total - lag(total) OVER (ORDER BY month)) / lag(total) OVER (ORDER BY month), 6) AS pct_change FROM m""",
)
def _(t):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    totals = t.orders.groupBy(month).agg(F.sum("o_totalprice").alias("total"))
    return rounded(ordered.pct_change(totals, "total", "month", buckets=4).drop("total"), 6)


@query(
    "pct_change",
    "W2",
    "SELECT event_id, round((value - lag(value) OVER (ORDER BY ts)) / lag(value) OVER (ORDER BY ts), 6) + 0.0 AS pct_change FROM events",
)
def _(t):
    rows = ordered.pct_change(t.events.select("event_id", "ts", "value"), "value", "ts", buckets=8)
    return rounded(rows.select("event_id", "pct_change"), 6)


def _neighbours(by):
    part, eq = ("PARTITION BY user_id", "p.u = k.u") if by else ("", "TRUE")
    return f"""WITH p AS (SELECT event_id, {"user_id" if by else "0"} AS u, (row_number() OVER ({part} ORDER BY ts) - 1)::DOUBLE AS x,
         CASE WHEN event_id % 7 >= 3 THEN value END AS v FROM events),
       k AS (SELECT u, x AS x1, v AS v1, lag(x) OVER w AS x0, lag(v) OVER w AS v0, lead(x) OVER w AS x2, lead(v) OVER w AS v2,
         lead(x, 2) OVER w AS x3, lead(v, 2) OVER w AS v3, row_number() OVER w AS r FROM p WHERE v IS NOT NULL
         WINDOW w AS (PARTITION BY u ORDER BY x)),
       j AS (SELECT p.event_id, p.u, p.x, p.v, k.* EXCLUDE (u) FROM p ASOF LEFT JOIN k ON p.u = k.u AND p.x >= k.x1),
       f AS (SELECT u, x1 AS fx1, v1 AS fv1, x2 AS fx2, v2 AS fv2 FROM k WHERE r = 1)"""


_LINEAR = "CASE WHEN x1 IS NULL THEN NULL WHEN x2 IS NULL THEN v1 ELSE v1 + (v2 - v1) * (x - x1) / (x2 - x1) END"
_QUADRATIC = """CASE WHEN x1 IS NULL OR x2 IS NULL THEN NULL
  WHEN x0 IS NOT NULL THEN v0 * (x-x1)*(x-x2)/((x0-x1)*(x0-x2)) + v1 * (x-x0)*(x-x2)/((x1-x0)*(x1-x2)) + v2 * (x-x0)*(x-x1)/((x2-x0)*(x2-x1))
  WHEN x3 IS NOT NULL THEN v1 * (x-x2)*(x-x3)/((x1-x2)*(x1-x3)) + v2 * (x-x1)*(x-x3)/((x2-x1)*(x2-x3)) + v3 * (x-x1)*(x-x2)/((x3-x1)*(x3-x2))
  ELSE v1 + (v2 - v1) * (x - x1) / (x2 - x1) END"""
_CUBIC = """CASE WHEN x1 IS NULL AND fx2 IS NULL THEN fv1
  WHEN x1 IS NULL THEN fv1 + (fv2 - fv1) * (x - fx1) / (fx2 - fx1)
  WHEN x2 IS NULL AND x0 IS NULL THEN v1
  WHEN x2 IS NULL THEN v1 + (v0 - v1) * (x - x1) / (x0 - x1)
  ELSE v1 * (2*s*s*s - 3*s*s + 1) + (CASE WHEN x0 IS NULL THEN (v2-v1)/(x2-x1) ELSE (v2-v0)/(x2-x0) END) * (x2-x1) * (s*s*s - 2*s*s + s)
     + v2 * (3*s*s - 2*s*s*s) + (CASE WHEN x3 IS NULL THEN (v2-v1)/(x2-x1) ELSE (v3-v1)/(x3-x1) END) * (x2-x1) * (s*s*s - s*s) END"""


def _interpolated(method, formula, by, buckets):
    name = f"interpolate_{method}" + ("_per_user" if by else "")
    ids = {"linear": "W3 V5", "quadratic": "W4 V5", "cubic": "W5 V5"}[method]

    @query(
        name,
        ids,
        f"""{_neighbours(by)} SELECT event_id, round(coalesce(v, {formula}) * 0.7310585786, 6) + 0.0 AS v
            FROM (SELECT *, (x - x1) / (x2 - x1) AS s FROM j) LEFT JOIN f USING (u)""",
    )
    def _(t):
        rows = nulled_events(t, below=3).select("event_id", "user_id", "ts", "v")
        out = ordered.interpolate(rows, "v", "ts", ["user_id"] if by else [], method, buckets)
        # The factor keeps exact halves out of the rounding on both sides.
        return out.select("event_id", F.round(F.col("v") * 0.7310585786, 6).alias("v"))


for _method, _formula in (("linear", _LINEAR), ("quadratic", _QUADRATIC), ("cubic", _CUBIC)):
    _interpolated(_method, _formula, False, 8)
    _interpolated(_method, _formula, True, 3)


# The slopes at the known rows by elimination row after row, then the curve between them.
def _spline_sql(method, by):
    part = "PARTITION BY user_id" if by else ""
    k, least = {"quadratic": (3, 3), "cubic": (2, 4)}[method]
    edge = {
        "quadratic": ("(1.0, 1.0, 2 * sp)", "(1.0, 1.0, 2 * sm)"),
        "cubic": (
            "(x2 - x1, x2 - x, ((x1 - x + 2 * (x2 - x)) * (x2 - x1) * sp + (x1 - x) ** 2 * (y2 - y1) / (x2 - x1)) / (x2 - x))",
            "(x - w2, w1 - w2, ((x - w1 + 2 * (x - w2)) * (w1 - w2) * sm + (x - w1) ** 2 * (z1 - z2) / (w1 - w2)) / (x - w2))",
        ),
    }[method]
    first, last = (e[1:-1] for e in edge)
    fb, fc, fr = first.split(", ")
    la, lb, lr = last.split(", ")
    curve = {
        "cubic": "v1 + t * (d1 + t / h * (3 * s - 2 * d1 - d2 + t / h * (d1 + d2 - 2 * s)))",
        "quadratic": """CASE WHEN 2 * t <= h THEN v1 + t * (d1 + t * (4 * s - 3 * d1 - d2) / (2 * h))
          ELSE v2 + (t - h) * (d2 + (t - h) * (3 * d2 + d1 - 4 * s) / (2 * h)) END""",
    }[method]
    return f"""WITH RECURSIVE p AS (SELECT event_id, {"user_id" if by else "0"} AS u, (row_number() OVER ({part} ORDER BY ts) - 1)::DOUBLE AS x,
         CASE WHEN event_id % 7 >= 3 THEN value END AS v FROM events),
       k AS (SELECT u, x, v AS y, row_number() OVER w AS r, count(*) OVER (PARTITION BY u) AS n, lag(x) OVER w AS w1, lag(v) OVER w AS z1,
         lag(x, 2) OVER w AS w2, lag(v, 2) OVER w AS z2, lead(x) OVER w AS x1, lead(v) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(v, 2) OVER w AS y2
         FROM p WHERE v IS NOT NULL WINDOW w AS (PARTITION BY u ORDER BY x)),
       h AS (SELECT *, (y1 - y) / (x1 - x) AS sp, (y - z1) / (x - w1) AS sm FROM k WHERE n >= {least}),
       e AS MATERIALIZED (SELECT u, r, n, x, CASE WHEN r = 1 THEN 0.0::DOUBLE WHEN r = n THEN {la} ELSE 1 / (x - w1) END AS a,
         CASE WHEN r = 1 THEN {fb} WHEN r = n THEN {lb} ELSE {k} * (1 / (x - w1) + 1 / (x1 - x)) END AS b,
         CASE WHEN r = 1 THEN {fc} WHEN r = n THEN 0.0::DOUBLE ELSE 1 / (x1 - x) END AS c,
         CASE WHEN r = 1 THEN {fr} WHEN r = n THEN {lr} ELSE {k + 1} * (sm / (x - w1) + sp / (x1 - x)) END AS q FROM h),
       f AS (SELECT u, r, n, (c / b)::DOUBLE AS cp, (q / b)::DOUBLE AS dp FROM e WHERE r = 1
         UNION ALL SELECT e.u, e.r, e.n, e.c / (e.b - e.a * f.cp), (e.q - e.a * f.dp) / (e.b - e.a * f.cp) FROM f JOIN e ON e.u = f.u AND e.r = f.r + 1),
       g AS (SELECT u, r, dp AS d FROM f WHERE r = n UNION ALL SELECT f.u, f.r, f.dp - f.cp * g.d FROM g JOIN f ON f.u = g.u AND f.r = g.r - 1),
       m AS (SELECT k.u, k.x AS x1, k.y AS v1, g.d AS d1, lead(k.x) OVER w AS x2, lead(k.y) OVER w AS v2, lead(g.d) OVER w AS d2
         FROM k JOIN g ON k.u = g.u AND k.r = g.r WINDOW w AS (PARTITION BY k.u ORDER BY k.x)),
       j AS (SELECT p.event_id, p.v, p.x - m.x1 AS t, m.x2 - m.x1 AS h, (v2 - v1) / (m.x2 - m.x1) AS s, v1, v2, d1, d2
         FROM p ASOF LEFT JOIN m ON p.u = m.u AND p.x >= m.x1)
       SELECT event_id, round(coalesce(v, {curve}), 6) + 0.0 AS v FROM j"""


def _splined(method, by, buckets):
    ids = {"quadratic": "W4 V5", "cubic": "W5 V5"}[method]

    @query(f"spline_{method}" + ("_per_user" if by else ""), ids, _spline_sql(method, by))
    def _(t):
        rows = nulled_events(t, below=3).select("event_id", "user_id", "ts", "v")
        out = splines.spline(rows, "v", "ts", ["user_id"] if by else [], method, buckets)
        return rounded(out.select("event_id", "v"), 6, "v")


for _method in splines.LEAST:
    _splined(_method, False, 8)
    _splined(_method, True, 3)


@query(
    "average_rank",
    "W6",
    """SELECT p_partkey, p_size, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)::DOUBLE AS average_rank
       FROM part""",
)
def _(t):
    return ordered.average_rank(t.part.select("p_partkey", "p_size"), "p_size", buckets=6)


# --- correlation -----------------------------------------------------------

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(pairs, source):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM {source}" for a, b in pairs
    )


@query(
    "corr_matrix",
    "K0",
    _pairs_sql([(a, b) for a in _NUMBERS for b in _NUMBERS], "lineitem"),
)
def _(t):
    return rounded(correlate.corr_matrix(t.lineitem, _NUMBERS), 6)


@query(
    "corr_lower_triangle",
    "K1",
    _pairs_sql([(a, b) for i, a in enumerate(_NUMBERS) for b in _NUMBERS[:i]], "lineitem"),
)
def _(t):
    return rounded(correlate.corr_lower_triangle(t.lineitem, _NUMBERS), 6)


def _one(t, name, value):
    return rounded(small_table(t.spark, [(value,)], f"{name} double"), 6)


@query(
    "corr_pair",
    "K2",
    """SELECT round(corr(v, user_id), 6) AS r FROM (SELECT CASE WHEN event_id % 7 >= 1 THEN value END AS v, user_id FROM events)""",
)
def _(t):
    return _one(t, "r", correlate.corr_pair(nulled_events(t), "v", "user_id"))


_RANKS = """SELECT round(corr(a, b), 6) AS r FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE AS a,
    rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0::DOUBLE AS b FROM {t})"""


@query("corr_spearman", "K3a", _RANKS.format(x="p_size", y="p_retailprice", t="part"))
def _(t):
    return _one(t, "r", correlate.corr_spearman(t.part, "p_size", "p_retailprice", buckets=5))


@query("corr_spearman_rows", "K3a", _RANKS.format(x="l_quantity", y="l_extendedprice", t="lineitem"))
def _(t):
    return _one(t, "r", correlate.corr_pair(t.lineitem, "l_quantity", "l_extendedprice", "spearman"))


_TAU = """WITH p AS (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y, count(*) AS n FROM {t} GROUP BY ALL),
    s AS (SELECT sum(a.n * b.n * sign(b.y - a.y)) AS s FROM p a, p b WHERE a.x < b.x),
    n AS (SELECT sum(n) * (sum(n) - 1) / 2 AS every FROM p),
    tx AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM p GROUP BY x)),
    ty AS (SELECT sum(n * (n - 1) / 2) AS t FROM (SELECT sum(n) AS n FROM p GROUP BY y))
  SELECT round(s / sqrt((every - tx.t) * (every - ty.t)), 6) AS tau FROM s, n, tx, ty"""


@query("corr_kendall", "K3b", _TAU.format(x="p_size", y="floor(p_retailprice / 10)", t="part"))
def _(t):
    rows = t.part.select("p_size", F.floor(F.col("p_retailprice") / 10).alias("band"))
    return _one(t, "tau", correlate.corr_kendall(rows, "p_size", "band"))


@query("corr_kendall_pieces", "K3b", _TAU.format(x="user_id", y="value", t="events"))
def _(t):
    """Counted in pieces of about 1,000 rows, as a large table would be."""
    return _one(t, "tau", correlate.corr_kendall(t.events, "user_id", "value", task_rows=1_000))


@query(
    "trend_line",
    "K3c",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
         round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem""",
)
def _(t):
    out = correlate.trend_line(t.lineitem, "l_quantity", "l_extendedprice")
    return rounded(rounded(out, 4, "slope", "intercept"), 6, "r2")
