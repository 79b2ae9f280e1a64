"""Queries: whole-table aggregates, profiles, histograms, box plots."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import NULLED_EVENTS, nulled_events, query, rounded
from tallyframe.operators import aggregate as agg


@query("row_count", "A1", "SELECT count(*) AS n_rows, 11::INTEGER AS n_columns FROM lineitem")
def _(t):
    return agg.row_count(t.lineitem)


@query("total", "A2", "SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS total FROM lineitem")
def _(t):
    return rounded(agg.total(t.lineitem, "l_extendedprice"), 2)


@query("mean", "A3", "SELECT round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_tax), 6) AS mean_l_tax FROM lineitem")
def _(t):
    return rounded(agg.mean(t.lineitem, "l_quantity", "l_tax"), 6)


@query("minimum", "A4", "SELECT min(o_totalprice) AS minimum FROM orders")
def _(t):
    return agg.minimum(t.orders, "o_totalprice")


@query("maximum", "A4", "SELECT greatest(max(o_totalprice), 0) AS maximum FROM orders")
def _(t):
    return agg.maximum(t.orders, "o_totalprice", floor=0.0)


@query(
    "conditional_sum",
    "A5",
    "SELECT round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS total FROM orders",
)
def _(t):
    return rounded(agg.conditional_sum(t.orders, F.col("o_orderstatus") == "F", "o_totalprice"), 2)


@query("row_of_max", "A6", "SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 1")
def _(t):
    return agg.row_of_max(t.part, "p_size", "p_partkey")


@query("row_of_min", "A6", "SELECT * FROM part ORDER BY p_size, p_partkey LIMIT 1")
def _(t):
    return agg.row_of_min(t.part, "p_size", "p_partkey")


_PROFILE = f"""SELECT unnest(['event_id', 'user_id', 'v', 'kind']) AS "column", unnest([count(*) - count(event_id),
    count(*) - count(user_id), count(*) - count(v), count(*) - count(kind)]) AS nulls, count(*) AS n
    FROM {NULLED_EVENTS}"""


@query("null_profile", "A7", f'SELECT "column", nulls, round(100.0 * nulls / n, 2) AS null_percent FROM ({_PROFILE})')
def _(t):
    return agg.null_profile(nulled_events(t), ["event_id", "user_id", "v", "kind"])


@query(
    "column_profile",
    "A8",
    f"""SELECT "column", CASE "column" WHEN 'v' THEN 'double' WHEN 'kind' THEN 'string' ELSE 'bigint' END AS type,
        nulls, round(100.0 * nulls / n, 2) AS null_percent FROM ({_PROFILE})""",
)
def _(t):
    return agg.column_profile(nulled_events(t).select("event_id", "user_id", "v", "kind"))


@query(
    "distinct_count",
    "A9",
    """SELECT unnest(['p_brand', 'p_type', 'p_size', 'p_retailprice']) AS "column", unnest([count(DISTINCT p_brand),
       count(DISTINCT p_type), count(DISTINCT p_size), count(DISTINCT p_retailprice)]) AS n_distinct FROM part""",
)
def _(t):
    return agg.distinct_count(t.part, ["p_brand", "p_type", "p_size", "p_retailprice"])


@query("distinct_values", "A10", f"SELECT DISTINCT kind FROM {NULLED_EVENTS}")
def _(t):
    return agg.distinct_values(nulled_events(t), "kind")


def _describe_sql(columns, source, digits=4, cast=""):
    one = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), {d}) AS mean, round(stddev_samp({c}), {d}) AS std,
      round(min({c}), {d})::DOUBLE AS min, round(quantile_cont({c}, 0.25), {d})::DOUBLE AS p25, round(quantile_cont({c}, 0.5), {d})::DOUBLE AS p50,
      round(quantile_cont({c}, 0.75), {d})::DOUBLE AS p75, round(max({c}), {d})::DOUBLE AS max FROM {s}"""
    return " UNION ALL ".join(one.format(c=c, d=digits, s=source) for c in columns)


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


@query("describe", "A11", _describe_sql(_DESCRIBED, "lineitem"))
def _(t):
    return rounded(agg.describe(t.lineitem, _DESCRIBED), 4)


@query("describe_refined", "A11 A12", _describe_sql(_DESCRIBED, "lineitem"))
def _(t):
    """The same columns under the inventory entry of the quartiles."""
    return rounded(agg.describe(t.lineitem, _DESCRIBED), 4)


@query(
    "describe_times",
    "A11",
    """SELECT 'o_orderdate' AS "column", count(o_orderdate) AS count,
         date_trunc('minute', make_timestamp(round(avg(epoch_us(o_orderdate)))::BIGINT)) AS mean, min(o_orderdate)::TIMESTAMP AS min,
         make_timestamp(round(quantile_cont(epoch_us(o_orderdate), 0.25))::BIGINT) AS p25,
         make_timestamp(round(quantile_cont(epoch_us(o_orderdate), 0.5))::BIGINT) AS p50,
         make_timestamp(round(quantile_cont(epoch_us(o_orderdate), 0.75))::BIGINT) AS p75,
         max(o_orderdate)::TIMESTAMP AS max FROM orders""",
)
def _(t):
    """The mean is kept to the minute, where the order of the sum does not show."""
    out = agg.describe_times(t.orders, ["o_orderdate"])
    return out.withColumn("mean", F.date_trunc("minute", "mean").cast("timestamp_ntz"))


@query(
    "quantile",
    "A12",
    """SELECT unnest([0.05, 0.1, 0.25, 0.9, 0.99])::DOUBLE AS p,
         round(unnest(quantile_cont(value, [0.05, 0.1, 0.25, 0.9, 0.99])), 6) AS value FROM events""",
)
def _(t):
    return rounded(agg.quantile(t.events, "value", [0.05, 0.1, 0.25, 0.9, 0.99]), 6)


@query(
    "quantile_refined",
    "A12",
    """SELECT unnest([0.0, 0.05, 0.25, 0.5, 0.999, 1.0])::DOUBLE AS p,
         round(unnest(quantile_cont(l_extendedprice, [0.0, 0.05, 0.25, 0.5, 0.999, 1.0])), 6) AS value FROM lineitem""",
)
def _(t):
    return rounded(agg.quantile(t.lineitem, "l_extendedprice", [0.0, 0.05, 0.25, 0.5, 0.999, 1.0]), 6)


@query("quantile_sketch", "A12", "SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS p, true AS within")
def _(t):
    """Whether the rank of each sketched value is within the sketch's bound."""
    found = agg.quantile_sketch(t.events, "value", [0.25, 0.5, 0.75])
    rows = [(r["p"], r["value"]) for r in found.collect()]
    pairs = F.inline(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(v).alias("q")) for p, v in rows]))
    ranks = t.events.select("value", pairs).groupBy("p").agg(
        F.avg((F.col("value") < F.col("q")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q")).cast("double")).alias("upto"))
    return ranks.select("p", ((F.col("below") - 1e-4 <= F.col("p")) & (F.col("p") <= F.col("upto") + 1e-4)).alias("within"))


@query("median", "A13", "SELECT round(median(value), 6) AS median FROM events")
def _(t):
    return rounded(agg.median(t.events, "value"), 6)


@query(
    "mode",
    "A14",
    "SELECT p_size AS mode FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1",
)
def _(t):
    return agg.mode(t.part, "p_size")


@query(
    "mode_by_group",
    "A14",
    """SELECT p_type, arg_min(p_size, (-n, p_size)) AS mode FROM (SELECT p_type, p_size, count(*) AS n FROM part
       GROUP BY ALL) GROUP BY p_type""",
)
def _(t):
    return agg.mode(t.part, "p_size", ["p_type"])


@query(
    "spread",
    "A15",
    """SELECT round(stddev_samp(l_quantity), 6) AS std_l_quantity, round(var_samp(l_quantity), 6) AS var_l_quantity,
         round(stddev_samp(l_discount), 6) AS std_l_discount, round(var_samp(l_discount), 6) AS var_l_discount FROM lineitem""",
)
def _(t):
    return rounded(agg.spread(t.lineitem, "l_quantity", "l_discount"), 6)


@query("any_match", "A16", "SELECT coalesce(bool_or(c_acctbal <= 0), false) AS any_match FROM customer")
def _(t):
    return agg.any_match(t.customer, F.col("c_acctbal") <= 0)


@query(
    "before_after",
    "V6",
    f"""SELECT * EXCLUDE ("column"), 'v' AS "column", 'before' AS stage FROM ({_describe_sql(["v"], NULLED_EVENTS)})
        UNION ALL BY NAME SELECT *, 'after' AS stage FROM ({_describe_sql(["v"],
        f"(SELECT coalesce(v, (SELECT median(v) FROM {NULLED_EVENTS})) AS v FROM {NULLED_EVENTS})")})""",
)
def _(t):
    from tallyframe.operators.impute import fill_median

    rows = nulled_events(t).select("v")
    return rounded(agg.before_after(rows, fill_median(rows, ["v"]), "v"), 4)


# --- histogram, density, box plot ------------------------------------------

@query(
    "histogram",
    "G13",
    """WITH b AS (SELECT min(value) AS lo, (max(value) - min(value)) / 20 AS w FROM events)
       SELECT i::INTEGER AS bin, round(lo + i * w, 6) AS "left", round(lo + i * w + w, 6) AS "right",
         (SELECT count(*) FROM events WHERE least(floor((value - lo) / w), 19) = i) AS n FROM b, range(20) r(i)""",
)
def _(t):
    return rounded(agg.histogram(t.events, "value", 20), 6)


@query(
    "histogram_auto",
    "G13",
    """WITH q AS (SELECT count(value) AS n, min(value) AS lo, max(value) - min(value) AS span,
           quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events),
         b AS (SELECT lo, ceil(span / least(span / (log2(n) + 1), 2 * iqr / n ** (1.0 / 3))) AS k, span FROM q)
       SELECT i::INTEGER AS bin, (SELECT count(*) FROM events WHERE least(floor((value - lo) / (span / k)), k - 1) = i) AS n
       FROM b, range(1000) r(i) WHERE i < k""",
)
def _(t):
    return agg.histogram(t.events, "value", None).select("bin", "n")


@query(
    "histogram_gaps",
    "G13",
    """WITH e AS (SELECT CASE WHEN event_id % 5 = 0 THEN 5000.0 ELSE value END AS v FROM events),
         b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 40 AS w FROM e)
       SELECT i::INTEGER AS bin, (SELECT count(*) FROM e WHERE least(floor((v - lo) / w), 39) = i) AS n FROM b, range(40) r(i)""",
)
def _(t):
    """A second heap of rows far from the others, with empty bins between."""
    far = t.events.select(F.when(F.col("event_id") % 5 == 0, 5000.0).otherwise(F.col("value")).alias("v"))
    return agg.histogram(far, "v", 40).select("bin", "n")


@query(
    "density_curve",
    "G14",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, stddev_samp(value) * count(*) ** -0.2 AS h, count(*) AS n FROM events),
         g AS (SELECT i::INTEGER AS point, lo + i * ((hi - lo) / 199) AS x, h, n FROM s, range(200) r(i))
       SELECT point, round(any_value(x), 6) AS x,
         round(sum(exp(-((x - value) / h * ((x - value) / h)) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
       FROM g, events GROUP BY point""",
)
def _(t):
    out = agg.density_curve(t.events, "value")
    return rounded(rounded(out, 6, "x"), 8, "density")


_BOX = """WITH b AS (SELECT {k} quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3
       FROM {s} {g})
   SELECT {k} count(*) AS n_rows, min({c}) AS min, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS median,
     round(any_value(q3), 6) AS q3, max({c}) AS max, round(any_value(q3 - q1), 6) AS iqr,
     round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_bound, round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_bound,
     min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
     max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
     count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
     round(100.0 * count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count({share}), 6) AS outlier_percent
   FROM {s} {j} {g}"""


@query("boxplot_stats", "G15", _BOX.format(k="", c="value", s="events", g="", j=", b", share="*"))
def _(t):
    return rounded(agg.boxplot_stats(t.events, "value"), 6)


@query(
    "boxplot_stats_by_group",
    "G15",
    _BOX.format(k="l_returnflag,", c="l_extendedprice", s="lineitem", g="GROUP BY l_returnflag",
                j="JOIN b USING (l_returnflag)", share="l_extendedprice"),
)
def _(t):
    return rounded(agg.boxplot_stats(t.lineitem, "l_extendedprice", ["l_returnflag"], share_of="values"), 6)


@query(
    "boxplot_stats_by_group_refined",
    "G15",
    _BOX.format(k="event_type,", c="value", s="events", g="GROUP BY event_type", j="JOIN b USING (event_type)", share="*"),
)
def _(t):
    return rounded(agg.boxplot_stats(t.events, "value", ["event_type"]), 6)
