"""Queries: sources and sinks, typing, null handling."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.catalog.registry import NULLED_EVENTS, nulled_events, query, rounded
from tallyframe.functions.scalar import lookup
from tallyframe.operators import clean, select
from tallyframe.plans.sizing import shared_folder, small_table
from tallyframe.sources import json_array, tables

_EVENT_TEXT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


@query("read_csv_table", "S1 S4", "SELECT event_id, event_type, value, props FROM events")
def _(t):
    path = shared_folder(t.spark, "events-csv")
    tables.write_csv_table(t.events.select(*_EVENT_TEXT.names), path)
    return tables.read_csv_table(t.spark, path, _EVENT_TEXT)


@query("read_json_records", "S2", "SELECT event_id, event_type, value, props FROM events")
def _(t):
    path = shared_folder(t.spark, "events-json")
    tables.write_json_lines(t.events.select(*_EVENT_TEXT.names), path)
    return tables.read_json_records(t.spark, path, _EVENT_TEXT, lines=True)


@query("read_json_array", "S2", "SELECT event_id, event_type, value, props FROM events")
def _(t):
    """Arrays of one file per partition, cut into chunks of 64 KiB that many tasks read."""
    path = shared_folder(t.spark, "events-arrays")
    json_array.write_json_arrays(t.events.select(*_EVENT_TEXT.names), path)
    return json_array.read_json_array(t.spark, path, _EVENT_TEXT, chunk_bytes=1 << 16)


@query(
    "literal_table",
    "S3",
    """SELECT label, count(*) AS n FROM orders
       JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('P', 'pending')) s(code, label) ON o_orderstatus = code
       GROUP BY label""",
)
def _(t):
    schema = T.StructType([T.StructField("code", T.StringType()), T.StructField("label", T.StringType())])
    names = tables.literal_table(t.spark, [("F", "finished"), ("O", "open"), ("P", "pending")], schema)
    counted = t.orders.groupBy(F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(names), "code").select("label", "n")  # three rows written in code


@query(
    "write_csv_table",
    "S4 F3 U1",
    """SELECT c_name, c_acctbal, CASE WHEN c_acctbal > 5000 THEN 6 ELSE c_nationkey END AS score
       FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1500""",
)
def _(t):
    kept = select.filter_and_project(
        t.customer.withColumn("score", F.col("c_nationkey")),
        (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 1500),
        ["c_name", "c_acctbal", "score"],
    )
    path = shared_folder(t.spark, "clients-csv")
    tables.write_csv_table(clean.update_where(kept, F.col("c_acctbal") > 5000, "score", 6), path)
    return tables.read_csv_table(t.spark, path, kept.schema)


@query(
    "load_events",
    "S5 C1 C3 P3 D3",
    """SELECT l_orderkey, l_partkey,
         coalesce(CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END, 'nan') AS flag,
         epoch_us(try_cast(CASE WHEN l_orderkey % 11 = 0 THEN 'unknown' ELSE l_shipdate::VARCHAR END AS TIMESTAMP)
           - o_orderdate::TIMESTAMP) / 6e7 AS duration
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def _(t):
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey",
        "l_partkey",
        F.when(F.col("l_orderkey") % 13 != 0, F.col("l_returnflag")).alias("flag"),
        F.col("o_orderdate").cast("string").alias("start"),
        F.when(F.col("l_orderkey") % 11 == 0, F.lit("unknown"))
        .otherwise(F.col("l_shipdate").cast("string")).alias("end"),
    )
    return tables.prepare_events(joined, "start", "end", "duration", null_label="nan").drop("start", "end")


@query(
    "cached_input",
    "S6",
    "SELECT round(avg(abs(value - m)), 6) AS mean_deviation FROM events, (SELECT avg(value) AS m FROM events)",
)
def _(t):
    with tables.cached_input(t.events.select("value")) as held:
        centre = held.agg(F.avg("value")).first()[0]
        spread = held.agg(F.avg(F.abs(F.col("value") - F.lit(centre)))).first()[0]
    return rounded(small_table(t.spark, [(spread,)], "mean_deviation double"), 6)


_FIRST_PER_YEAR = """SELECT o_orderkey, o_totalprice, o_orderdate FROM (
  SELECT *, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 1000"""


@query("sample_job", "S7 C2 P4", _FIRST_PER_YEAR)
def _(t):
    source, target = shared_folder(t.spark, "orders-csv"), shared_folder(t.spark, "sample-csv")
    kept = t.orders.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"))
    tables.write_csv_table(kept.orderBy("o_orderkey"), source)
    tables.sample_job(t.spark, source, target, 1000, kept.schema, "o_orderdate")
    return clean.parse_timestamp_lenient(tables.read_csv_table(t.spark, target, kept.schema), ["o_orderdate"])


@query("head_per_group", "W1", _FIRST_PER_YEAR)
def _(t):
    kept = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    return tables.first_per_year(kept, "o_orderdate", "o_orderkey", 1000)


@query(
    "head_per_group_large",
    "W1",
    """SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r
       FROM events) WHERE r <= 1500""",
)
def _(t):
    return select.head_per_group(t.events.select("event_type", "event_id"), ["event_type"], "event_id", 1500)


# --- typing ----------------------------------------------------------------

_LENIENT = "CASE WHEN o_orderkey % 5 = 0 THEN 'no date' ELSE o_orderdate::VARCHAR END"


@query(
    "parse_timestamp_lenient",
    "C1",
    f"SELECT o_orderkey, try_cast({_LENIENT} AS TIMESTAMP) AS t FROM orders",
)
def _(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no date")).otherwise(F.col("o_orderdate").cast("string"))
    return clean.parse_timestamp_lenient(t.orders.select("o_orderkey", text.alias("t")), ["t"])


@query("parse_timestamp_strict", "C2", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS t FROM orders")
def _(t):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")).otherwise(
        F.col("o_orderdate").cast("string")
    )
    return clean.parse_timestamp_strict(t.orders.select("o_orderkey", text.alias("t")), "t", ["dd/MM/yyyy HH:mm"])


@query(
    "text_cast",
    "C3 B2",
    f"SELECT coalesce(kind, 'nan') AS kind, count(*) AS n FROM {NULLED_EVENTS} GROUP BY 1",
)
def _(t):
    return clean.text_cast(nulled_events(t), ["kind"]).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "columns_by_kind",
    "C4",
    """SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'DOUBLE', 'INTEGER') THEN 'numeric'
         WHEN column_type = 'VARCHAR' THEN 'text' ELSE 'time' END AS kind
       FROM (DESCRIBE SELECT * FROM lineitem)""",
)
def _(t):
    found = [(c, kind) for kind in ("numeric", "text", "time") for c in clean.columns_by_kind(t.lineitem, kind)]
    return small_table(t.spark, found, "column string, kind string")


@query("drop_null_any", "C5", f"SELECT event_id, v, kind FROM {NULLED_EVENTS} WHERE v IS NOT NULL AND kind IS NOT NULL")
def _(t):
    return clean.drop_null_any(nulled_events(t).select("event_id", "v", "kind"), ["v", "kind"])


@query(
    "drop_null_all",
    "C6",
    f"""SELECT event_id, v, u FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN user_id END AS u FROM {NULLED_EVENTS})
        WHERE v IS NOT NULL OR u IS NOT NULL""",
)
def _(t):
    rows = nulled_events(t).select("event_id", "v", F.when(F.col("event_id") % 5 != 0, F.col("user_id")).alias("u"))
    return clean.drop_null_all(rows, ["v", "u"])


@query(
    "fill_constant",
    "C7 M2",
    f"SELECT event_id, coalesce(kind, 'Missing') AS kind, coalesce(v, -1.0::DOUBLE) AS v FROM {NULLED_EVENTS}",
)
def _(t):
    return clean.fill_constant(nulled_events(t).select("event_id", "kind", "v"), {"kind": "Missing", "v": -1.0})


@query(
    "columns_with_nulls",
    "C8",
    f"""SELECT "column" FROM (SELECT unnest(['event_id', 'user_id', 'v', 'kind']) AS "column",
          unnest([count(*) - count(event_id), count(*) - count(user_id), count(*) - count(v), count(*) - count(kind)])
          AS n FROM {NULLED_EVENTS}) WHERE n > 0""",
)
def _(t):
    from tallyframe.operators.aggregate import columns_with_nulls

    return columns_with_nulls(nulled_events(t).select("event_id", "user_id", "v", "kind"))


# --- projections, updates, appends -----------------------------------------

@query("select_columns", "P1", "SELECT l_orderkey, l_extendedprice FROM lineitem")
def _(t):
    return clean.select_columns(t.lineitem, ["l_orderkey", "l_extendedprice"])


@query("select_by_position", "P2", "SELECT p_partkey, p_retailprice FROM part")
def _(t):
    return clean.select_by_position(t.part, [0, -1])


@query("drop_column", "P4", "SELECT * EXCLUDE (o_orderdate, o_orderpriority) FROM orders")
def _(t):
    return clean.drop_column(t.orders, "o_orderdate", "o_orderpriority")


@query("rename_columns", "P5", "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer GROUP BY 1")
def _(t):
    return clean.rename_columns(t.customer.groupBy("c_mktsegment").count(), ["segment", "customers"])


@query(
    "with_columns",
    "P6",
    """SELECT o_orderkey, month(o_orderdate)::INTEGER AS m, isodow(o_orderdate)::INTEGER - 1 AS d,
         round(o_totalprice * 2, 2) AS twice FROM orders""",
)
def _(t):
    new = {
        "m": F.month("o_orderdate"), "d": F.weekday("o_orderdate"), "twice": F.round(F.col("o_totalprice") * 2, 2)
    }
    return clean.with_columns(t.orders, new).select("o_orderkey", *new)


@query(
    "update_where",
    "U1 M1",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer",
)
def _(t):
    return clean.update_where(
        t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), F.col("c_acctbal") < 0, "c_mktsegment", "DEBT"
    ).drop("c_acctbal")


@query(
    "update_status_by_id",
    "U2",
    "SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'O' ELSE o_orderstatus END AS o_orderstatus FROM orders",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return clean.update_status_by_id(rows, 7, "O", ["F", "O", "P"], "o_orderkey", "o_orderstatus")[0]


@query(
    "update_statuses",
    "U2",
    """SELECT o_orderkey, CASE WHEN c_acctbal < 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus
       FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _(t):
    debtors = t.customer.where(F.col("c_acctbal") < 0)
    updates = t.orders.join(debtors, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(
        "o_orderkey", F.lit("F").alias("o_orderstatus")
    )
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    return clean.update_statuses(rows, updates, ["F", "O", "P"], "o_orderkey", "o_orderstatus")


@query(
    "append_rows",
    "X1",
    """SELECT c_name AS name, c_acctbal AS balance FROM customer UNION ALL
       SELECT s_name, s_acctbal FROM supplier""",
)
def _(t):
    first = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    return clean.append_rows(first, t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query(
    "append_order",
    "X2",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders UNION ALL SELECT -1, 'P', 222.0""",
)
def _(t):
    return clean.append_order(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), [-1, "P", 222.0])[0]


@query("distinct_pairs", "X3", "SELECT DISTINCT p_type, p_brand FROM part")
def _(t):
    return clean.distinct_pairs(t.part, ["p_type", "p_brand"])


@query(
    "status_names",
    "B4",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status
       FROM orders""",
)
def _(t):
    return t.orders.select(
        "o_orderkey", lookup(F.col("o_orderstatus"), {"F": "finished", "O": "open"}, "other").alias("status")
    )
