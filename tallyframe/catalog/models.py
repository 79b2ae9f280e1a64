"""Queries: regression and classification reports."""

from pyspark.sql import functions as F

from tallyframe.catalog.registry import query, rounded
from tallyframe.operators import model

_FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query(
    "split_train_test",
    "L1",
    """SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 10 < 8 THEN 'train' ELSE 'test' END AS part
       FROM orders""",
)
def _(t):
    train, test = model.split_train_test(t.orders.select("o_orderkey"), "o_orderkey")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def _logistic(t):
    keyed = t.lineitem.select(
        "l_extendedprice", *_FEATURES, F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("key")
    )
    return model.logistic_fit(keyed, "l_extendedprice", _FEATURES, "key")


@query("logistic_coefficients", "L2 L6")
def _(t):
    return model.coefficients(t.lineitem, _logistic(t))


@query(
    "logistic_slopes",
    "L2 L3 L6",
    f"SELECT unnest({['const', *_FEATURES]!r}) AS feature, 0.0::DOUBLE AS slope",
)
def _(t):
    """The penalised loss is convex, so no slope proves the fit; computed over the training rows."""
    return model.logistic_slopes(_logistic(t)).withColumn("slope", F.abs(F.round("slope", 6)))


@query(
    "predict_labels",
    "L1 L2 L3",
    """WITH k AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_linenumber) AS key, (l_quantity > 25)::INTEGER AS large,
           (l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem))::INTEGER AS label FROM lineitem),
         s AS (SELECT *, ('0x' || substr(md5(key), 1, 8))::BIGINT % 10 < 8 AS train FROM k),
         m AS (SELECT large, (avg(label) > 0.5)::INTEGER AS prediction FROM s WHERE train GROUP BY large)
       SELECT key, label, prediction FROM s JOIN m USING (large) WHERE NOT train""",
)
def _(t):
    """With one feature of two values the fitted label is the training rows' majority for that value."""
    keyed = t.lineitem.select("l_extendedprice", (F.col("l_quantity") > 25).cast("int").alias("large"),
                              F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber").alias("key"))
    fitted = model.logistic_fit(keyed, "l_extendedprice", ["large"], "key")
    return fitted.predict_labels(fitted.test).select("key", "label", "prediction")


@query("logistic_confusion", "L2 L3 L5")
def _(t):
    fitted = _logistic(t)
    return model.confusion_matrix(fitted.predict_labels(fitted.test), "label", "prediction", [0, 1])


@query("logistic_report", "L3 L4")
def _(t):
    fitted = _logistic(t)
    return model.classification_report(fitted.predict_labels(fitted.test), "label", "prediction")


@query(
    "confusion_matrix",
    "L5",
    """SELECT quality AS actual, count(*) FILTER (toxic = 0) AS predicted_0, count(*) FILTER (toxic = 1) AS predicted_1
       FROM labels GROUP BY quality""",
)
def _(t):
    return model.confusion_matrix(t.labels, "quality", "toxic", [0, 1])


@query(
    "classification_report",
    "L4",
    """WITH c AS (SELECT k, (SELECT count(*) FROM labels WHERE quality = k) AS support, (SELECT count(*) FROM labels WHERE toxic = k) AS guessed,
           (SELECT count(*) FROM labels WHERE quality = k AND toxic = k) AS hit FROM range(2) r(k)),
         s AS (SELECT k::VARCHAR AS class, coalesce(hit / nullif(guessed, 0)::DOUBLE, 0) AS p, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS r,
           coalesce(2 * hit / nullif(guessed + support, 0)::DOUBLE, 0) AS f, support, hit FROM c),
         u AS (SELECT class, p, r, f, support FROM s
           UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM s
           UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM s
           UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM s)
       SELECT class, round(p, 6) AS "precision", round(r, 6) AS recall, round(f, 6) AS f1, support::BIGINT AS support FROM u""",
)
def _(t):
    return rounded(model.classification_report(t.labels, "quality", "toxic"), 6)


_X, _Y = "l_quantity", "l_extendedprice"
_NAMED = {"const": "1.0::DOUBLE", "l_quantity": "l_quantity", "l_discount": "l_discount", "l_extendedprice": "l_extendedprice"}


@query(
    "gram_sums",
    "L7",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(sum({_NAMED[a]} * {_NAMED[b]}) / count(*), 4) AS s FROM lineitem"
        for i, a in enumerate(_NAMED)
        for b in list(_NAMED)[: i + 1]
    ),
)
def _(t):
    """Divided by the row count, so that large sums compare."""
    n = t.lineitem.count()
    out = model.gram_sums(t.lineitem, list(_NAMED)[1:])
    return out.withColumn("s", F.round(F.col("s") / n, 4))


def _normal_sql(x1, x2, x3):
    """The normal equations of three features, solved by the inverse of their covariances: ``p`` holds the parameters."""
    x = {1: x1, 2: x2, 3: x3}
    sums = ", ".join(f"covar_pop({x[i]}, {x[j]}) * count(*) AS s{i}{j}" for i, j in ((1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)))
    means = ", ".join(f"avg({x[i]}) AS m{i}, covar_pop({x[i]}, {_Y}) * count(*) AS t{i}" for i in x)
    return f"""WITH c AS (SELECT count(*)::DOUBLE AS n, avg({_Y}) AS my, var_pop({_Y}) * count(*) AS tss, {sums}, {means} FROM lineitem),
      d AS (SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) AS det FROM c),
      i AS (SELECT *, (s22 * s33 - s23 * s23) / det AS i11, (s13 * s23 - s12 * s33) / det AS i12, (s12 * s23 - s13 * s22) / det AS i13,
        (s11 * s33 - s13 * s13) / det AS i22, (s12 * s13 - s11 * s23) / det AS i23, (s11 * s22 - s12 * s12) / det AS i33 FROM d),
      b AS (SELECT *, i11 * t1 + i12 * t2 + i13 * t3 AS b1, i12 * t1 + i22 * t2 + i23 * t3 AS b2, i13 * t1 + i23 * t2 + i33 * t3 AS b3 FROM i),
      p AS (SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS a, tss - b1 * t1 - b2 * t2 - b3 * t3 AS ssr,
        1 / n + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23) AS i00 FROM b)"""


@query(
    "ols_fit",
    "L7 L10",
    _normal_sql(*_FEATURES) + f""", f AS (SELECT unnest(['const', '{"', '".join(_FEATURES)}']) AS feature, unnest([a, b1, b2, b3]) AS b,
        unnest([sqrt(ssr / (n - 4) * i00), sqrt(ssr / (n - 4) * i11), sqrt(ssr / (n - 4) * i22), sqrt(ssr / (n - 4) * i33)]) AS e FROM p)
      SELECT feature, round(b, 3) AS coefficient, round(e, 3) AS std_error, round(b / e, 3) AS t FROM f""",
)
def _(t):
    out = model.ols_coefficients(model.ols_fit(t.lineitem, _Y, _FEATURES))
    return rounded(out.select("feature", "coefficient", "std_error", "t"), 3, "coefficient", "std_error", "t")


@query(
    "ols_collinear",
    "L7 L8 L10",
    f"""WITH r AS (SELECT regr_slope({_Y}, {_X}) AS b, regr_intercept({_Y}, {_X}) AS a, count(*) AS n, regr_r2({_Y}, {_X}) AS r2 FROM lineitem)
       SELECT unnest(['single', 'double', 'const', 'df_model', 'df_resid', 'r2']) AS name,
         unnest([round(b / 5, 4), round(2 * b / 5, 4), round(a, 4), 1, n - 2, round(r2, 4)]) AS value FROM r""",
)
def _(t):
    """A feature beside its double: the slope is shared out by the least norm, and the model has one degree of freedom."""
    both = t.lineitem.select(_Y, F.col(_X).alias("single"), (F.col(_X) * 2).alias("double"))
    fitted = model.ols_fit(both, _Y, ["single", "double"])
    params = model.ols_coefficients(fitted).select(F.col("feature").alias("name"), F.col("coefficient").alias("value"))
    report = model.ols_summary(fitted).where(F.col("name").isin("df_model", "df_resid", "r2"))
    return rounded(params.unionByName(report), 4, "value")


@query(
    "ols_coefficients",
    "L10",
    f"""WITH r AS (SELECT regr_slope({_Y}, {_X}) AS b, regr_intercept({_Y}, {_X}) AS a, count(*) AS n, avg({_X}) AS mx,
           regr_sxx({_Y}, {_X}) AS sxx, regr_syy({_Y}, {_X}) * (1 - regr_r2({_Y}, {_X})) AS ssr FROM lineitem),
         e AS (SELECT *, sqrt(ssr / (n - 2) / sxx) AS eb, sqrt(ssr / (n - 2) * (1.0 / n + mx * mx / sxx)) AS ea FROM r)
       SELECT 'const' AS feature, round(a, 4) AS coefficient, round(ea, 4) AS std_error, round(a / ea, 3) AS t FROM e
       UNION ALL SELECT '{_X}', round(b, 4), round(eb, 4), round(b / eb, 3) FROM e""",
)
def _(t):
    out = model.ols_coefficients(model.ols_fit(t.lineitem, _Y, [_X]))
    out = out.select("feature", "coefficient", "std_error", "t")
    return rounded(rounded(out, 3, "t"), 4, "coefficient", "std_error")


@query(
    "ols_residuals",
    "L9",
    """SELECT o_orderkey, round(a + b * o_custkey, 3) AS fitted, round(o_totalprice - (a + b * o_custkey), 3) AS residual FROM orders,
         (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders)""",
)
def _(t):
    fitted = model.ols_fit(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), "o_totalprice", ["o_custkey"])
    return rounded(model.ols_residuals(fitted).select("o_orderkey", "fitted", "residual"), 3)


_OLS = """WITH r AS (SELECT regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a, avg(value) AS my FROM events),
    e AS (SELECT event_id, value, value - (a + b * user_id) AS e, my FROM events, r),
    m AS (SELECT count(*)::DOUBLE AS n, avg(e) AS me FROM e),
    s AS (SELECT sum(e * e) AS ssr, sum((value - my) * (value - my)) AS tss,
            (sum((e - me) ** 3) / any_value(n)) / (sum((e - me) ** 2) / any_value(n)) ** 1.5 AS skew,
            (sum((e - me) ** 4) / any_value(n)) / (sum((e - me) ** 2) / any_value(n)) ** 2 AS kurt, any_value(n) AS n FROM e, m),
    w AS (SELECT sum((e - p) * (e - p)) AS turns FROM (SELECT e, lag(e) OVER (ORDER BY event_id) AS p FROM e)),
    l AS (SELECT *, 1 - ssr / tss AS r2, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM s, w)
  SELECT unnest(['n', 'r2', 'r2_adjusted', 'f', 'log_likelihood', 'aic', 'bic', 'skew', 'kurtosis', 'jarque_bera', 'durbin_watson']) AS name,
    unnest([n, round(r2, 8), round(1 - (1 - r2) * (n - 1) / (n - 2), 8), round((tss - ssr) / (ssr / (n - 2)), 4), round(ll, 2), round(4 - 2 * ll, 2),
      round(2 * ln(n) - 2 * ll, 2), round(skew, 6), round(kurt, 5), round(n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4), 1), round(turns / ssr, 6)]) AS value
  FROM l"""
_DIGITS = {"r2": 8, "r2_adjusted": 8, "f": 4, "log_likelihood": 2, "aic": 2, "bic": 2, "skew": 6, "kurtosis": 5,
           "jarque_bera": 1, "durbin_watson": 6, "n": 0}


@query("ols_summary", "L8 L7", _OLS)
def _(t):
    fitted = model.ols_fit(t.events.select("event_id", "value", "user_id"), "value", ["user_id"])
    out = model.ols_summary(fitted, "event_id", buckets=4)
    value = F.lit(None).cast("double")
    for name, digits in _DIGITS.items():
        value = F.when(F.col("name") == name, F.round("value", digits)).otherwise(value)
    return out.withColumn("value", value).where(F.col("value").isNotNull())


_FULL = {**{k: v for k, v in _DIGITS.items() if k != "durbin_watson"}, "f": 6, "df_model": 0, "df_resid": 0}


@query(
    "ols_summary_full",
    "L8",
    _normal_sql(*_FEATURES) + f""",
      e AS (SELECT {_Y} - (a + b1 * {_FEATURES[0]} + b2 * {_FEATURES[1]} + b3 * {_FEATURES[2]}) AS e FROM lineitem, p),
      m AS (SELECT avg(e) AS me FROM e),
      s AS (SELECT sum(e * e) AS ssr, (sum((e - me) ** 3) / count(*)) / (sum((e - me) ** 2) / count(*)) ** 1.5 AS skew,
        (sum((e - me) ** 4) / count(*)) / (sum((e - me) ** 2) / count(*)) ** 2 AS kurt FROM e, m),
      l AS (SELECT p.n, p.tss, s.*, 1 - s.ssr / p.tss AS r2, -p.n / 2 * (ln(2 * pi()) + ln(s.ssr / p.n) + 1) AS ll FROM p, s)
      SELECT unnest(['n', 'df_model', 'df_resid', 'r2', 'r2_adjusted', 'f', 'log_likelihood', 'aic', 'bic', 'skew', 'kurtosis', 'jarque_bera']) AS name,
        unnest([n, 3, n - 4, round(r2, 8), round(1 - (1 - r2) * (n - 1) / (n - 4), 8), round(((tss - ssr) / 3) / (ssr / (n - 4)), 6), round(ll, 2),
          round(8 - 2 * ll, 2), round(4 * ln(n) - 2 * ll, 2), round(skew, 6), round(kurt, 5), round(n / 6 * (skew ** 2 + (kurt - 3) ** 2 / 4), 1)]) AS value FROM l""",
)
def _(t):
    out = model.ols_summary(model.ols_fit(t.lineitem, _Y, _FEATURES))
    value = F.lit(None).cast("double")
    for name, digits in _FULL.items():
        value = F.when(F.col("name") == name, F.round("value", digits)).otherwise(value)
    return out.withColumn("value", value).where(F.col("value").isNotNull())
