"""Queries: group-by summaries."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import NULLED_EVENTS, nulled_events, query, rounded
from tallyframe.operators import group

_ONE = {
    "count": "count(*)", "mean": "round(avg(l_extendedprice), 4)", "sum": "round(sum(l_extendedprice), 2)",
    "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "median": "round(median(l_extendedprice), 4)",
}


def _group_one(function):
    @query(
        f"group_one_{function}",
        "G1 UD3",
        f"SELECT l_returnflag, {_ONE[function]} AS result FROM lineitem GROUP BY l_returnflag",
    )
    def _(t):
        out = group.group_one(t.lineitem, "l_returnflag", function, "l_extendedprice")
        return rounded(out, 2 if function == "sum" else 4)


for _name in _ONE:
    _group_one(_name)


@query(
    "group_many",
    "G2 UD3 A15",
    """SELECT l_returnflag, l_linestatus, count(l_quantity) AS l_quantity_count, round(avg(l_quantity), 4) AS l_quantity_mean,
         round(median(l_quantity), 4) AS l_quantity_median, round(stddev_samp(l_quantity), 4) AS l_quantity_std,
         round(sum(l_extendedprice), 2) AS l_extendedprice_sum, min(l_extendedprice) AS l_extendedprice_min,
         max(l_extendedprice) AS l_extendedprice_max, round(var_samp(l_tax), 8) AS l_tax_var
       FROM lineitem GROUP BY ALL""",
)
def _(t):
    wanted = {
        "l_quantity": ["count", "mean", "median", "std"], "l_extendedprice": ["sum", "min", "max"], "l_tax": ["var"]
    }
    out = group.group_many(t.lineitem, ["l_returnflag", "l_linestatus"], wanted)
    out = rounded(rounded(out, 2, "l_extendedprice_sum"), 8, "l_tax_var")
    return rounded(out, 4, "l_quantity_mean", "l_quantity_median", "l_quantity_std")


@query(
    "group_many_nulls",
    "G2",
    f"""SELECT kind, count(v) AS v_count, round(coalesce(sum(v), 0), 2) AS v_sum, round(median(v), 4) AS v_median
        FROM {NULLED_EVENTS} WHERE kind IS NOT NULL GROUP BY kind""",
)
def _(t):
    out = group.group_many(nulled_events(t), ["kind"], {"v": ["count", "sum", "median"]})
    return rounded(rounded(out, 2, "v_sum"), 4, "v_median")


@query("group_sum", "G3", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY 1")
def _(t):
    return rounded(group.group_sum(t.orders, "o_orderpriority", "o_totalprice"), 2)


@query("group_mean", "G3", "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice_mean FROM orders GROUP BY 1")
def _(t):
    return rounded(group.group_mean(t.orders, "o_orderpriority", "o_totalprice"), 4)


@query(
    "group_stats",
    "G3 UD3",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice_sum, round(avg(o_totalprice), 2) AS o_totalprice_mean,
         max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY 1""",
)
def _(t):
    return rounded(group.group_stats(t.orders, "o_orderpriority", "o_totalprice"), 2)


@query(
    "rows_of_extreme",
    "J4",
    """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS r
       FROM part) WHERE r = 1""",
)
def _(t):
    return group.rows_of_extreme(t.part, "p_type", "p_retailprice", "p_partkey")


@query(
    "pick_per_group",
    "UD1",
    """SELECT p_type, p_partkey, p_retailprice, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type
       ORDER BY p_size DESC, p_partkey) AS r FROM part) WHERE r = 1""",
)
def _(t):
    return group.pick_per_group(t.part, "p_type", "p_size", "p_partkey", ["p_partkey", "p_retailprice", "p_size"])


@query(
    "reduce_per_group",
    "UD1",
    """SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 6) AS unit_price
       FROM lineitem GROUP BY l_returnflag""",
)
def _(t):
    net = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum("l_quantity")
    return rounded(group.reduce_per_group(t.lineitem, ["l_returnflag"], {"unit_price": net}), 6)


@query(
    "region_summary",
    "G6 J6",
    """SELECT c_nationkey, count(c_custkey) AS n, round(avg(c_acctbal), 4) AS mean_balance, round(avg(c_custkey), 4) AS mean_key
       FROM customer GROUP BY c_nationkey""",
)
def _(t):
    means = {"mean_balance": "c_acctbal", "mean_key": "c_custkey"}
    return rounded(group.region_summary(t.customer, "c_nationkey", "c_custkey", means), 4)


@query(
    "city_summary",
    "G7",
    """SELECT s_nationkey, count(s_suppkey) AS n, round(avg(s_acctbal), 4) AS mean_balance, round(avg(s_suppkey), 4) AS mean_key
       FROM supplier GROUP BY s_nationkey""",
)
def _(t):
    means = {"mean_balance": "s_acctbal", "mean_key": "s_suppkey"}
    return rounded(group.city_summary(t.supplier, "s_nationkey", "s_suppkey", means), 4)


@query(
    "top_regions",
    "G6 O4",
    """SELECT c_nationkey, count(c_custkey) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer
       GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 10""",
)
def _(t):
    return rounded(group.region_summary(t.customer, "c_nationkey", "c_custkey", {"mean_balance": "c_acctbal"}).limit(10), 4)


def _chunked(t, chunk_rows):
    return group.collect_points(t.events, "ts", "hour", "event_id", "value", "user_id", chunk_rows)


@query(
    "collect_points",
    "G8",
    """SELECT hour(ts)::INTEGER AS hour, count(*) AS n, round(sum(value), 2) AS lat_sum, sum(user_id)::BIGINT AS lng_sum
       FROM events GROUP BY 1""",
)
def _(t):
    """Lists are compared through their sizes and sums; chunks are put together again."""
    add = lambda a, x: a + x
    parts = _chunked(t, 100).select(
        "hour", F.size("lats").alias("n"), F.aggregate("lats", F.lit(0.0), add).alias("lat"),
        F.aggregate("lngs", F.lit(0).cast("long"), add).alias("lng"),
    )
    return parts.groupBy("hour").agg(
        F.sum("n").alias("n"), F.round(F.sum("lat"), 2).alias("lat_sum"), F.sum("lng").alias("lng_sum")
    )


@query(
    "collect_points_chunks",
    "G8",
    """WITH r AS (SELECT hour(ts)::INTEGER AS hour, event_id, value, user_id FROM events),
         k AS (SELECT greatest(1, ceil(max(n) / 100.0))::BIGINT AS k FROM (SELECT count(*) AS n FROM r GROUP BY hour))
       SELECT hour, (('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % k)::INTEGER AS chunk, count(*) AS n,
         list(value ORDER BY event_id) AS lats, list(user_id ORDER BY event_id) AS lngs FROM r, k GROUP BY ALL""",
)
def _(t):
    return _chunked(t, 100)


for _part, _sql in {
    "hour": "hour(ts)", "weekday": "isodow(ts) - 1", "month": "month(ts)", "year": "year(ts)"
}.items():

    def _bucket(part, sql):
        @query(f"time_bucket_counts_{part}", "G9 D1", f"SELECT ({sql})::INTEGER AS {part}, count(*) AS n FROM events GROUP BY 1")
        def _(t):
            return group.time_bucket_counts(t.events, "ts", part)

    _bucket(_part, _sql)


@query("value_counts", "G10", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return group.value_counts(t.orders, "o_orderpriority")


@query(
    "value_shares",
    "G11",
    """SELECT o_orderstatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent
       FROM orders GROUP BY 1""",
)
def _(t):
    return group.value_shares(t.orders, "o_orderstatus")


# The same white space as the split of the library, written for this engine.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = f"(SELECT unnest(string_split_regex(lower(text), '{_SPACE}')) AS word FROM documents)"


@query(
    "word_count",
    "G12 O5 B1",
    f"""SELECT word, count(*) AS n FROM {_WORDS} WHERE word <> '' AND word NOT IN ('the', 'and', 'to', 'a')
        GROUP BY word HAVING count(*) > 1000""",
)
def _(t):
    return group.word_count(t.documents, "text", 1000)


@query(
    "word_count_nulls",
    "G12",
    f"""SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(coalesce(CASE WHEN doc_id % 7 <> 0 THEN text END,
        'none')), '{_SPACE}')) AS word FROM documents) WHERE word <> '' AND word NOT IN ('the', 'and', 'to', 'a')
        GROUP BY word HAVING count(*) > 20""",
)
def _(t):
    return group.word_count(t.documents.select(F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text")), "text", 20)
