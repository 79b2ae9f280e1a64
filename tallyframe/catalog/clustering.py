"""Queries: clustering and its scores."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import query, rounded
from tallyframe.operators import cluster
from tallyframe.plans.sizing import small_table

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]
# Centres in the units of (l_quantity, l_extendedprice / 1000).
_CENTERS = [(10.0, 20.0), (25.0, 50.0), (40.0, 80.0)]


def _scaled_sql(column):
    return f"""round((coalesce({column}, (SELECT avg({column}) FROM e)) - (SELECT avg({column}) FROM e)) /
      (SELECT stddev_pop(coalesce({column}, m)) FROM e, (SELECT avg({column}) AS m FROM e)), 6) + 0.0 AS {column}_scaled"""


@query(
    "cluster_prepare",
    "Q1",
    f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 >= 1 THEN value END AS v, user_id FROM events)
        SELECT event_id, {_scaled_sql("v")}, {_scaled_sql("user_id")} FROM e""",
)
def _(t):
    from tallyframe.catalog.registry import nulled_events

    out = cluster.cluster_prepare(nulled_events(t).select("event_id", "v", "user_id"), ["v", "user_id"])
    return rounded(out.select("event_id", "v_scaled", "user_id_scaled"), 6)


def _models_sql(score):
    """K-means for k = 2..10 as SQL: the seeded starts, every Lloyd step as a table of its own, then ``score`` over ``fin``.

    ``fin`` holds the last centres, ``own`` each row's nearest one and ``r`` the scaled rows.
    """
    xs = range(3)
    digest = "md5(concat_ws(',', '42', " + ", ".join(f"coalesce(round({c} * 1000)::BIGINT::VARCHAR, '')" for c in _FEATURES) + "))"
    place = ", ".join(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem) AS x{i}" for i, c in enumerate(_FEATURES))
    far = " + ".join(f"(x{i} - c{i}) * (x{i} - c{i})" for i in xs)

    def nearest(source):
        return f"SELECT id, k, min({{'d': {far}, 'c': c}}) AS near FROM r, {source} GROUP BY id, k"

    steps = "".join(
        f""", s{n + 1} AS MATERIALIZED (SELECT s.k, s.c, {", ".join(f"coalesce(a.m{i}, s.c{i}) AS c{i}" for i in xs)} FROM s{n} s LEFT JOIN
          (SELECT k, near.c AS c, {", ".join(f"avg(x{i}) AS m{i}" for i in xs)} FROM ({nearest(f"s{n}")}) JOIN r USING (id) GROUP BY ALL) a USING (k, c))"""
        for n in range(cluster.LLOYD_STEPS))
    return f"""WITH r AS MATERIALIZED (SELECT row_number() OVER () AS id, l_orderkey, l_linenumber, {digest} AS h, {place} FROM lineitem),
      parts AS (SELECT ('0x' || substr(h, 1, 7))::BIGINT % 10 AS part, {", ".join(f"arg_min(x{i}, h) AS c{i}" for i in xs)} FROM r GROUP BY 1),
      starts AS (SELECT row_number() OVER (ORDER BY part) - 1 AS c, c0, c1, c2 FROM parts),
      s0 AS MATERIALIZED (SELECT k, c, c0, c1, c2 FROM starts, range(2, 11) t(k) WHERE c < k AND k <= (SELECT count(*) FROM starts)){steps},
      fin AS (SELECT * FROM s{cluster.LLOYD_STEPS}),
      own AS MATERIALIZED (SELECT id, k, near.c AS c, near.d AS d, x0, x1, x2 FROM ({nearest("fin")}) JOIN r USING (id)),
      sums AS MATERIALIZED (SELECT k, c, count(*) AS n, sum(x0) AS t0, sum(x1) AS t1, sum(x2) AS t2, sum(x0 * x0 + x1 * x1 + x2 * x2) AS q
        FROM own GROUP BY k, c),
      total AS (SELECT k, sum(n) AS n, count(*) AS found, sum(t0) / sum(n) AS m0, sum(t1) / sum(n) AS m1, sum(t2) / sum(n) AS m2 FROM sums GROUP BY k),
      ch AS (SELECT k, (sum(s.n * ((t0 / s.n - m0) ** 2 + (t1 / s.n - m1) ** 2 + (t2 / s.n - m2) ** 2)) / (any_value(found) - 1)) /
          (sum(q - (t0 * t0 + t1 * t1 + t2 * t2) / s.n) / (any_value(t.n) - any_value(found))) AS ch FROM sums s JOIN total t USING (k) GROUP BY k),
      far AS (SELECT own.id, own.k, own.c = s.c AS me, s.n AS n, s.n * (x0 * x0 + x1 * x1 + x2 * x2) + q - 2 * (x0 * t0 + x1 * t1 + x2 * t2) AS f
        FROM own JOIN sums s USING (k)),
      ab AS (SELECT id, k, max(f / greatest(n - 1, 1)) FILTER (me) AS a, min(f / n) FILTER (NOT me) AS b, max(n) FILTER (me) AS size FROM far GROUP BY id, k),
      sil AS (SELECT k, avg(CASE WHEN size <= 1 THEN 0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0 END) AS silhouette FROM ab GROUP BY k),
      cost AS (SELECT k, sum(d) AS inertia FROM own GROUP BY k),
      sweep AS (SELECT k::INTEGER AS k, silhouette, inertia, ch AS calinski_harabasz FROM sil JOIN cost USING (k) JOIN ch USING (k))
      {score}"""


_BEST = "(SELECT arg_max(k, silhouette) FROM sweep)"


@query("cluster_sweep", "Q2 Q3 Q4 Q5", _models_sql(
    "SELECT k, round(silhouette, 6) AS silhouette, round(inertia, 2) AS inertia, round(calinski_harabasz, 2) AS calinski_harabasz FROM sweep"))
def _(t):
    sweep = cluster.cluster_sweep(t.lineitem, _FEATURES)[0]
    return rounded(rounded(sweep, 6, "silhouette"), 2, "inertia", "calinski_harabasz")


@query("best_k_of_sweep", "Q2 Q6", _models_sql(
    """, drops AS (SELECT k, (inertia - lag(inertia) OVER (ORDER BY k)) / lag(inertia) OVER (ORDER BY k) AS drop FROM sweep)
    SELECT (SELECT arg_max(k, silhouette) FROM sweep) AS by_silhouette, (SELECT arg_min(k, drop) FROM drops) AS by_elbow,
      (SELECT arg_max(k, calinski_harabasz) FROM sweep) AS by_calinski_harabasz"""))
def _(t):
    return cluster.best_k(cluster.cluster_sweep(t.lineitem, _FEATURES)[0])


@query("cluster_assign", "Q7 J5", _models_sql(
    f"SELECT l_orderkey, l_linenumber, c::INTEGER AS cluster FROM own JOIN r USING (id) WHERE k = {_BEST}"))
def _(t):
    return cluster.cluster_assign(t.lineitem, _FEATURES)[0].select("l_orderkey", "l_linenumber", "cluster")


@query("cluster_centers", "Q10", _models_sql(
    "SELECT c::INTEGER AS cluster, " + ", ".join(f"round(c{i}, 6) + 0.0 AS {c}" for i, c in enumerate(_FEATURES)) + f" FROM fin WHERE k = {_BEST}"))
def _(t):
    _, model = cluster.cluster_assign(t.lineitem, _FEATURES)
    return rounded(cluster.cluster_centers(t.lineitem, model), 6, *_FEATURES)


def _points(t):
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"), "l_discount"
    )


_NEAR_SQL = """(SELECT *, least(d0, d1, d2) AS d, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster
  FROM (SELECT *, l_extendedprice / 1000 AS price,
    (l_quantity - 10) * (l_quantity - 10) + (l_extendedprice / 1000 - 20) * (l_extendedprice / 1000 - 20) AS d0,
    (l_quantity - 25) * (l_quantity - 25) + (l_extendedprice / 1000 - 50) * (l_extendedprice / 1000 - 50) AS d1,
    (l_quantity - 40) * (l_quantity - 40) + (l_extendedprice / 1000 - 80) * (l_extendedprice / 1000 - 80) AS d2 FROM lineitem))"""


def _labelled(t):
    return cluster.nearest_center(_points(t), ["l_quantity", "price"], _CENTERS)


@query("nearest_center", "Q7", f"SELECT l_orderkey, l_partkey, cluster::INTEGER AS cluster, round(d, 4) AS squared_distance FROM {_NEAR_SQL}")
def _(t):
    return rounded(_labelled(t).select("l_orderkey", "l_partkey", "cluster", "squared_distance"), 4)


@query("inertia", "Q3", f"SELECT round(sum(d), 2) AS inertia FROM {_NEAR_SQL}")
def _(t):
    return rounded(cluster.inertia(_points(t), ["l_quantity", "price"], _CENTERS), 2)


@query("cluster_sizes", "Q8", f"SELECT cluster::INTEGER AS cluster, count(*) AS n FROM {_NEAR_SQL} GROUP BY 1")
def _(t):
    return cluster.cluster_sizes(_labelled(t))


@query(
    "cluster_profile",
    "Q9",
    f"""SELECT cluster::INTEGER AS cluster, round(avg(l_quantity), 2) AS l_quantity, round(avg(price), 2) AS price,
        round(avg(l_discount), 2) AS l_discount FROM {_NEAR_SQL} GROUP BY 1""",
)
def _(t):
    return cluster.cluster_profile(_labelled(t), ["l_quantity", "price", "l_discount"])


def _calinski_sql(label, columns, source):
    between = " + ".join(f"n * (m{i} - g{i}) * (m{i} - g{i})" for i, _ in enumerate(columns))
    within = " + ".join(f"n * v{i}" for i, _ in enumerate(columns))
    means = ", ".join(f"avg({c}) AS m{i}, var_pop({c}) AS v{i}" for i, c in enumerate(columns))
    overall = ", ".join(f"avg({c}) AS g{i}" for i, c in enumerate(columns))
    return f"""SELECT round((sum({between}) / (count(*) - 1)) / (sum({within}) / (sum(n) - count(*))), 4) AS score
        FROM (SELECT {label}, count(*) AS n, {means} FROM {source} GROUP BY {label}), (SELECT {overall} FROM {source})"""


@query("calinski_harabasz", "Q5", _calinski_sql("l_returnflag", _FEATURES[:2], "lineitem"))
def _(t):
    score = cluster.calinski_harabasz(t.lineitem, _FEATURES[:2], "l_returnflag")
    return rounded(small_table(t.spark, [(score,)], "score double"), 4)


def _vectors(t):
    names = [f"e{i}" for i in range(64)]
    return t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)]), names


_SILHOUETTE = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    d AS (SELECT a.vec_id, a.label, b.label AS other, {far} AS d, a.vec_id = b.vec_id AS me FROM v a, v b),
    m AS (SELECT vec_id, label, other, sum(d) AS s, count(*) - sum(me::INT) AS n FROM d GROUP BY ALL),
    s AS (SELECT vec_id, min(s / n) FILTER (label = other) AS a, min(s / n) FILTER (label <> other) AS b FROM m GROUP BY vec_id)
  SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s"""


@query("silhouette", "Q4 J3", _SILHOUETTE.format(far="list_distance(a.e, b.e) ** 2"))
def _(t):
    rows, names = _vectors(t)
    score = cluster.silhouette(cluster.assemble(rows, names), "features", "label")
    return rounded(small_table(t.spark, [(score,)], "silhouette double"), 6)


@query("silhouette_exact", "Q4 J3", _SILHOUETTE.format(far="list_distance(a.e, b.e)"))
def _(t):
    rows, names = _vectors(t)
    return rounded(cluster.silhouette_exact(rows, names, "label"), 6)


@query(
    "best_k",
    "Q6",
    """WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) - min(p_retailprice) AS w FROM part),
         g AS (SELECT k, least(floor((p_retailprice - lo) / (w / k)), k - 1) AS c, count(*) AS n, var_pop(p_retailprice) AS v
               FROM part, b, range(2, 11) r(k) GROUP BY ALL),
         s AS (SELECT k, sum(n * v) AS inertia FROM g GROUP BY k),
         d AS (SELECT k, inertia, (inertia - lag(inertia) OVER (ORDER BY k)) / lag(inertia) OVER (ORDER BY k) AS drop FROM s)
       SELECT arg_min(k, drop)::INTEGER AS by_elbow, arg_max(k, inertia)::INTEGER AS by_silhouette,
         arg_min(k, inertia)::INTEGER AS by_calinski_harabasz FROM d""",
)
def _(t):
    """The sweep of an equal-width labelling of the prices, for k = 2..10."""
    low, high = t.part.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    tried = t.part.select("p_retailprice", F.explode(F.sequence(F.lit(2), F.lit(10))).alias("k"))
    band = F.least(F.floor((F.col("p_retailprice") - low) / (F.lit(high - low) / F.col("k"))), F.col("k") - 1)
    groups = tried.groupBy("k", band.alias("c")).agg(
        F.count("*").alias("n"), F.var_pop("p_retailprice").alias("v")
    )
    sweep = groups.groupBy("k").agg(F.sum(F.col("n") * F.col("v")).alias("inertia"))
    return cluster.best_k(
        sweep.withColumns({"silhouette": F.col("inertia"), "calinski_harabasz": -F.col("inertia")})
    )
