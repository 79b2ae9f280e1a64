"""Queries: imputation, outliers, scaling, encoding."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import NULLED_EVENTS, nulled_events, query, rounded
from tallyframe.operators import encode, impute, outliers, scale


@query("fill_mean", "V1 J6", f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {NULLED_EVENTS})), 6) AS v FROM {NULLED_EVENTS}")
def _(t):
    return rounded(impute.fill_mean(nulled_events(t).select("event_id", "v"), ["v"]), 6)


@query("fill_median", "V2", f"SELECT event_id, round(coalesce(v, (SELECT median(v) FROM {NULLED_EVENTS})), 6) AS v FROM {NULLED_EVENTS}")
def _(t):
    return rounded(impute.fill_median(nulled_events(t).select("event_id", "v"), ["v"]), 6)


@query(
    "fill_mode",
    "V3",
    f"""SELECT event_id, coalesce(kind, (SELECT kind FROM {NULLED_EVENTS} WHERE kind IS NOT NULL GROUP BY kind
        ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {NULLED_EVENTS}""",
)
def _(t):
    return impute.fill_mode(nulled_events(t).select("event_id", "kind"), ["kind"])


def _part_points(t):
    """Parts with nulls in two of three columns, some in both."""
    size = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size").cast("double"))
    price = F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice"))
    return t.part.select(
        "p_partkey", size.alias("size"), price.alias("price"), F.length("p_name").cast("double").alias("len")
    )


@query(
    "knn_impute",
    "V4 J2",
    """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS a,
           CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS b, length(p_name)::DOUBLE AS c FROM part),
         p AS (SELECT x.id, y.id AS donor, x.a IS NULL AS need_a, x.b IS NULL AS need_b, y.a AS da, y.b AS db,
           3.0::DOUBLE / ((x.a IS NOT NULL AND y.a IS NOT NULL)::INT + (x.b IS NOT NULL AND y.b IS NOT NULL)::INT + 1) *
           (0.0::DOUBLE + coalesce((x.a - y.a) * (x.a - y.a), 0) + coalesce((x.b - y.b) * (x.b - y.b), 0)
             + (x.c - y.c) * (x.c - y.c)) AS far
           FROM r x, r y WHERE x.a IS NULL OR x.b IS NULL),
         fa AS (SELECT id, avg(da) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS k FROM p
           WHERE need_a AND da IS NOT NULL) WHERE k <= 5 GROUP BY id),
         fb AS (SELECT id, avg(db) AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY far, donor) AS k FROM p
           WHERE need_b AND db IS NOT NULL) WHERE k <= 5 GROUP BY id)
       SELECT r.id AS p_partkey, round(coalesce(a, fa.v), 6) AS size, round(coalesce(b, fb.v), 6) AS price, c AS len
       FROM r LEFT JOIN fa ON r.id = fa.id LEFT JOIN fb ON r.id = fb.id""",
)
def _(t):
    return rounded(impute.knn_impute(_part_points(t), ["size", "price", "len"], "p_partkey", 5), 6, "size", "price")


@query(
    "knn_impute_events",
    "V4 J2",
    """WITH r AS (SELECT event_id AS id, CASE WHEN event_id % 7 >= 1 THEN value END AS v, user_id::DOUBLE AS u,
           hour(ts)::DOUBLE AS h FROM events),
         p AS (SELECT x.id, y.v, row_number() OVER (PARTITION BY x.id ORDER BY 3.0::DOUBLE / 2 *
             ((x.u - y.u) * (x.u - y.u) + (x.h - y.h) * (x.h - y.h)), y.id) AS k
           FROM r x, r y WHERE x.v IS NULL AND y.v IS NOT NULL),
         f AS (SELECT id, avg(v) AS v FROM p WHERE k <= 5 GROUP BY id)
       SELECT r.id AS event_id, round(coalesce(r.v, f.v), 6) AS v, u, h FROM r LEFT JOIN f ON r.id = f.id""",
)
def _(t):
    rows = nulled_events(t).select(
        "event_id", "v", F.col("user_id").cast("double").alias("u"), F.hour("ts").cast("double").alias("h")
    )
    return rounded(impute.knn_impute(rows, ["v", "u", "h"], "event_id", 5), 6, "v")


# --- outliers --------------------------------------------------------------

_B = """(SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, med, p10, p90 FROM
    (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, median(value) AS med,
     quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM events))"""


@query(
    "iqr_bounds",
    "E1",
    f"""SELECT round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower_bound,
        round(hi, 6) AS upper_bound FROM {_B}""",
)
def _(t):
    return rounded(outliers.iqr_bounds(t.events, "value"), 6)


_SUMMARY = """WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
    e AS (SELECT event_type, value, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM events JOIN b USING (event_type))
  SELECT event_type, count(*) FILTER (value < lo OR value > hi) AS n_outliers,
    round(100.0 * count(*) FILTER (value < lo OR value > hi) / count(value), 6) AS outlier_percent,
    round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
    min(value) FILTER (value < lo OR value > hi) AS min_outlier, max(value) FILTER (value < lo OR value > hi) AS max_outlier
  FROM e GROUP BY event_type"""


@query("outlier_summary_by_type", "E1 E2 J6", _SUMMARY)
def outlier_summary_by_type(t):
    return rounded(outliers.outlier_summary(t.events, "value", ["event_type"]), 6)


@query("outlier_summary_by_type_refined", "E2", _SUMMARY)
def _(t):
    return rounded(outliers.outlier_summary(t.events, "value", ["event_type"]), 6)


@query(
    "outlier_summary",
    "E2",
    f"""SELECT count(*) FILTER (value < lo OR value > hi) AS n_outliers,
        round(100.0 * count(*) FILTER (value < lo OR value > hi) / count(value), 6) AS outlier_percent,
        round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
        min(value) FILTER (value < lo OR value > hi) AS min_outlier, max(value) FILTER (value < lo OR value > hi) AS max_outlier
        FROM events, {_B} b""",
)
def _(t):
    return rounded(outliers.outlier_summary(t.events, "value"), 6)


@query(
    "top_outliers",
    "E3 F5",
    f"SELECT event_id, value FROM events, {_B} b WHERE value < lo OR value > hi ORDER BY value DESC, event_id LIMIT 10",
)
def _(t):
    return outliers.top_outliers(t.events.select("event_id", "value"), "value", 10, "event_id")


@query(
    "cap_outliers",
    "E4",
    f"""SELECT event_id, round(CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END, 6) AS v FROM {NULLED_EVENTS},
        {_B.replace("(value", "(v").replace("FROM events", "FROM " + NULLED_EVENTS)} b""",
)
def _(t):
    return rounded(outliers.cap_outliers(nulled_events(t).select("event_id", "v"), "v"), 6)


@query(
    "log_transform",
    "E5 N1",
    """SELECT c_custkey, round(ln(c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END
       FROM customer)), 8) AS c_acctbal FROM customer""",
)
def _(t):
    return rounded(outliers.log_transform(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal"), 8)


@query(
    "replace_outliers_mean",
    "E6",
    f"""SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN (SELECT avg(value) FROM events, {_B} c
        WHERE value BETWEEN c.lo AND c.hi) ELSE value END, 6) AS value FROM events, {_B} b""",
)
def _(t):
    return rounded(outliers.replace_outliers_mean(t.events.select("event_id", "value"), "value"), 6)


@query(
    "replace_outliers_median",
    "E7",
    f"SELECT event_id, round(CASE WHEN value < lo OR value > hi THEN med ELSE value END, 6) AS value FROM events, {_B} b",
)
def _(t):
    return rounded(outliers.replace_outliers_median(t.events.select("event_id", "value"), "value"), 6)


@query(
    "replace_outliers_percentile",
    "E8",
    f"SELECT event_id, round(CASE WHEN value < lo THEN p10 WHEN value > hi THEN p90 ELSE value END, 6) AS value FROM events, {_B} b",
)
def _(t):
    return rounded(outliers.replace_outliers_percentile(t.events.select("event_id", "value"), "value"), 6)


# --- scaling ---------------------------------------------------------------

_KEYS = ["o_orderkey", "o_totalprice", "o_custkey"]


@query(
    "scale_standard",
    "Z0 Z1",
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice)
       FROM orders), 6) + 0.0 AS o_totalprice, round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey)
       FROM orders), 6) + 0.0 AS o_custkey FROM orders""",
)
def _(t):
    return rounded(scale.scale_columns(t.orders.select(*_KEYS), _KEYS[1:], "standard")[0], 6)


@query(
    "scale_minmax",
    "Z0 Z2",
    """SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice, round((o_custkey - kl) / (kh - kl)::DOUBLE, 6) AS o_custkey
       FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_custkey) AS kl, max(o_custkey) AS kh FROM orders)""",
)
def _(t):
    return rounded(scale.scale_columns(t.orders.select(*_KEYS), _KEYS[1:], "minmax")[0], 6)


@query(
    "scale_robust",
    "Z0 Z3",
    """SELECT o_orderkey, round((o_totalprice - m) / w, 6) + 0.0 AS o_totalprice FROM orders, (SELECT median(o_totalprice) AS m,
         quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS w FROM orders)""",
)
def _(t):
    return rounded(scale.scale_columns(t.orders.select(*_KEYS[:2]), _KEYS[1:2], "robust")[0], 6)


@query(
    "scale_log",
    "Z0 Z4 N1",
    """SELECT c_custkey, round(ln(c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END
       FROM customer)), 8) AS c_acctbal FROM customer""",
)
def _(t):
    return rounded(scale.scale_columns(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "log")[0], 8)


@query(
    "scale_report",
    "Z5",
    """SELECT 'o_totalprice' AS "column", 'minmax' AS method, count(*) AS count, round(avg(z), 4) AS mean, round(stddev_samp(z), 4) AS std,
         round(min(z), 4) AS min, round(quantile_cont(z, 0.25), 4) AS p25, round(median(z), 4) AS p50,
         round(quantile_cont(z, 0.75), 4) AS p75, round(max(z), 4) AS max
       FROM (SELECT (o_totalprice - lo) / (hi - lo) AS z FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders))""",
)
def _(t):
    return rounded(scale.scale_report(t.orders, ["o_totalprice"], "minmax"), 4)


# --- encoding --------------------------------------------------------------

@query("label_codes", "H1", "SELECT p_type AS value, (row_number() OVER (ORDER BY p_type) - 1)::BIGINT AS code FROM (SELECT DISTINCT p_type FROM part)")
def _(t):
    return encode.label_codes(t.part, "p_type")


@query(
    "label_encode",
    "H1",
    "SELECT p_partkey, p_brand, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code FROM part",
)
def _(t):
    return encode.label_encode(t.part.select("p_partkey", "p_brand"), "p_brand")


@query(
    "label_codes_many",
    "H1",
    "SELECT c_name AS value, (row_number() OVER (ORDER BY c_name) - 1)::BIGINT AS code FROM (SELECT DISTINCT c_name FROM customer)",
)
def _(t):
    """The sorted numbering that a column with many values takes."""
    return encode.label_codes(t.customer, "c_name", few=100)


@query(
    "one_hot_encode",
    "H2",
    """SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS "o_orderstatus_F", (o_orderstatus = 'O')::INT::DOUBLE AS "o_orderstatus_O",
         (o_orderstatus = 'P')::INT::DOUBLE AS "o_orderstatus_P" FROM orders""",
)
def _(t):
    return encode.one_hot_encode(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus").drop("o_orderstatus")


@query(
    "one_hot_vectors",
    "H2",
    """SELECT p_partkey, p_brand, '(' || (SELECT count(DISTINCT p_brand) FROM part) || ',[' || (dense_rank() OVER (ORDER BY p_brand) - 1)
         || '],[1.0])' AS one_hot FROM part""",
)
def _(t):
    return encode.one_hot_vectors(t.part.select("p_partkey", "p_brand"), "p_brand").select(
        "p_partkey", "p_brand", F.col("one_hot").cast("string").alias("one_hot")
    )


@query("one_hot_totals", "H3", "SELECT 'o_orderstatus_' || o_orderstatus AS feature, count(*)::DOUBLE AS total FROM orders GROUP BY 1")
def _(t):
    return encode.one_hot_totals(t.orders, "o_orderstatus")
