"""Queries: scalar functions."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import NULLED_EVENTS, nulled_events, query, rounded
from tallyframe.functions import scalar as fn
from tallyframe.plans.fitting import fit


@query("log_shift", "N1", "SELECT c_custkey, round(ln(c_acctbal + (SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0 END FROM customer)), 8) AS y FROM customer")
def _(t):
    low = fit(t.customer, {"m": F.min("c_acctbal")})["m"]
    return rounded(t.customer.select("c_custkey", fn.shifted_log(F.col("c_acctbal"), low).alias("y")), 8)


@query(
    "clip",
    "N2",
    f"SELECT event_id, CASE WHEN v < 5 THEN 5.0 WHEN v > 100 THEN 100.0 ELSE v END AS v FROM {NULLED_EVENTS}",
)
def _(t):
    return nulled_events(t).select("event_id", fn.clip(F.col("v"), 5.0, 100.0).alias("v"))


@query(
    "abs_sqrt_round",
    "N3",
    """SELECT c_custkey, abs(c_acctbal) AS size, round(sqrt(abs(c_acctbal)) / 2, 6) AS radius,
         round_even(c_custkey / 4.0::DOUBLE, 0) AS quarter FROM customer""",
)
def _(t):
    size = F.abs("c_acctbal")
    return t.customer.select(
        "c_custkey", size.alias("size"), F.round(F.sqrt(size) / 2, 6).alias("radius"),
        fn.round_half_even(F.col("c_custkey") / F.lit(4.0)).alias("quarter"),
    )


@query(
    "calendar_parts",
    "D1 D2",
    """SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS m, hour(ts)::INTEGER AS h,
         (isodow(ts) - 1)::INTEGER AS d FROM events""",
)
def _(t):
    return t.events.select(
        "event_id", F.year("ts").alias("y"), F.month("ts").alias("m"), F.hour("ts").alias("h"),
        fn.weekday(F.col("ts")).alias("d"),
    )


@query(
    "seconds_between",
    "D3 P3",
    """SELECT o_orderkey, epoch_us(o_orderdate - TIMESTAMP '1995-01-01 06:30:00.5') / 1e6 AS s,
         round(epoch_us(o_orderdate - TIMESTAMP '1995-01-01 06:30:00.5') / 6e7, 6) AS m FROM orders""",
)
def _(t):
    start = F.lit("1995-01-01 06:30:00.5").cast("timestamp_ntz")
    end = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey", fn.seconds_between(start, end).alias("s"), F.round(fn.minutes_between(start, end), 6).alias("m")
    )


@query(
    "hour_band",
    "D4 M1",
    """SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 'morning' WHEN hour(ts) BETWEEN 12 AND 17 THEN 'afternoon'
         WHEN hour(ts) BETWEEN 18 AND 21 THEN 'evening' ELSE 'night' END AS band FROM events""",
)
def _(t):
    return t.events.select("event_id", fn.hour_band(F.hour("ts")).alias("band"))


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(
    "words",
    "B1 R1",
    f"""SELECT doc_id, len(list_filter(string_split_regex(lower(text), '{_SPACE}'), lambda w: w <> ''))::INTEGER AS n_words,
          len(list_distinct(list_filter(string_split_regex(lower(text), '{_SPACE}'), lambda w: w <> '')))::INTEGER AS n_different
        FROM documents""",
)
def _(t):
    w = fn.words(F.col("text"))
    return t.documents.select(
        "doc_id", fn.item_count(w).alias("n_words"), fn.item_count(F.array_distinct(w)).alias("n_different")
    )


@query(
    "to_text",
    "B2",
    f"""SELECT event_id, coalesce(user_id::VARCHAR, 'nan') AS u, coalesce(kind, 'nan') AS kind, printf('%.2f', value) AS v
        FROM {NULLED_EVENTS}""",
)
def _(t):
    return nulled_events(t).select(
        "event_id", fn.to_text(F.col("user_id"), "nan").alias("u"), fn.to_text(F.col("kind"), "nan").alias("kind"),
        fn.to_fixed(F.col("value")).alias("v"),
    )


@query(
    "point_label",
    "B3",
    f"""SELECT event_id, 'User: ' || user_id || '<br>Time: ' || strftime(ts, '%Y-%m-%d %H:%M') || '<br>Kind: ' ||
        coalesce(kind, 'nan') AS label FROM {NULLED_EVENTS}""",
)
def _(t):
    parts = {"User": F.col("user_id"), "Time": F.date_format("ts", "yyyy-MM-dd HH:mm"), "Kind": F.col("kind")}
    return nulled_events(t).select("event_id", fn.point_label(parts).alias("label"))


@query(
    "lookup",
    "B4",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 ELSE 0 END::INTEGER AS code FROM events""",
)
def _(t):
    return t.events.select("event_id", fn.lookup(F.col("event_type"), {"click": 1, "error": 2}, 0).alias("code"))


@query("array_fields", "R1", "SELECT vec_id, len(embedding)::INTEGER AS n, round(list_max(embedding)::DOUBLE, 6) AS top FROM embeddings")
def _(t):
    return t.embeddings.select(
        "vec_id", fn.item_count(F.col("embedding")).alias("n"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("top"),
    )


@query("fill_null", "M2", f"SELECT event_id, v IS NULL AS missing, coalesce(v, 0) AS v FROM {NULLED_EVENTS}")
def _(t):
    return nulled_events(t).select("event_id", F.col("v").isNull().alias("missing"), fn.fill_null(F.col("v"), 0.0).alias("v"))


@query(
    "indicator_above_median",
    "M3",
    "SELECT event_id, (value > (SELECT median(value) FROM events))::INTEGER AS above FROM events",
)
def _(t):
    middle = fit(t.events, quantiles={"m": ("value", 0.5)})["m"]
    return t.events.select("event_id", fn.indicator_above(F.col("value"), middle).alias("above"))
