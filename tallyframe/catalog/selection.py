"""Queries: filters, positional access, sorting, top-k."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import query
from tallyframe.operators import select


@query(
    "filter_year_and_levels",
    "F1",
    """SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998
       AND o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_orderpriority")
    return select.filter_year_and_levels(rows, "o_orderdate", 1996, 1998, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("filter_equal", "F2", "SELECT * FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return select.filter_equal(t.orders, "o_orderstatus", "F")


@query(
    "filter_and_project",
    "F3",
    "SELECT c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 1500",
)
def _(t):
    condition = (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 1500)
    return select.filter_and_project(t.customer, condition, ["c_name", "c_acctbal"])


@query("filter_in_list", "F4", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_nationkey IN (1, 4)")
def _(t):
    return select.filter_in_list(t.supplier, "s_nationkey", [1, 4], ["s_suppkey", "s_acctbal"])


@query("filter_outside_bounds", "F5", "SELECT event_id, value FROM events WHERE value < 2 OR value > 150")
def _(t):
    return select.filter_outside_bounds(t.events.select("event_id", "value"), "value", 2.0, 150.0)


@query("row_at", "I1", "SELECT * FROM part ORDER BY p_partkey LIMIT 1 OFFSET 2")
def _(t):
    return select.row_at(t.part, "p_partkey", 2)


@query(
    "rows_at",
    "I2",
    """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part)
       WHERE r IN (0, 3, 150)""",
)
def _(t):
    return select.rows_at(t.part, "p_partkey", [0, 3, 150], buckets=8)


@query("slice_inclusive", "I3", "SELECT * FROM part WHERE p_partkey BETWEEN 1 AND 3")
def _(t):
    return select.slice_inclusive(t.part, "p_partkey", 1, 3)


@query("slice_half_open", "I4", "SELECT * FROM part ORDER BY p_partkey LIMIT 3")
def _(t):
    return select.slice_half_open(t.part, "p_partkey", 0, 3)


@query("sort_desc", "O1 UD2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def _(t):
    return select.sort_desc(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("sort_table", "O2", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def _(t):
    return select.sort_table(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"])


@query("head", "O3", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def _(t):
    return select.head(t.orders, "o_orderkey", 10)


@query("top_k", "O4", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def _(t):
    return select.top_k(t.events.select("event_id", "value"), "value", 10, "event_id")
