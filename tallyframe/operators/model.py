"""Logistic and linear regression with their reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalar import indicator_above, stable_bucket
from tallyframe.functions.tails import chi_square_2_upper, f_upper, student_quantile, student_two_sided
from tallyframe.operators.impute import fill_mean
from tallyframe.operators.ordered import with_previous
from tallyframe.plans.fitting import fit
from tallyframe.plans.shipping import by_value
from tallyframe.plans.sizing import small_table
from tallyframe.sources.tables import cached_input


by_value(__name__)


def _check(df: DataFrame, target: str, features: Sequence[str]) -> None:
    unknown = [c for c in [target, *features] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    if target in features:
        raise ValueError(f"target {target!r} is also a feature")
    if not features:
        raise ValueError("at least one feature is needed")


# --- classification --------------------------------------------------------

def split_train_test(df: DataFrame, key: str, train_tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """About 80 / 20, decided by a digest of the key: the same on every run."""
    tenth = stable_bucket(F.col(key), 10)
    return df.where(tenth < train_tenths), df.where(tenth >= train_tenths)


@dataclass
class LogisticResult:
    coefficients: list[float]
    intercept: float
    features: list[str]
    train: DataFrame
    test: DataFrame

    def predict_labels(self, df: DataFrame) -> DataFrame:
        """Rows with ``prediction`` 0 or 1; a row with a null feature has none."""
        return df.withColumn("prediction", (_logit(self.features, [self.intercept, *self.coefficients]) > 0).cast("int"))


def _logit(features: Sequence[str], weights: Sequence[float]) -> Column:
    parts = [F.lit(float(w)) * F.col(f"`{c}`").cast("double") for c, w in zip(features, weights[1:])]
    return sum(parts, F.lit(float(weights[0])))


def logistic_sums(df: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], curved: bool = True):
    """Summed loss, its gradient and its second derivatives at the weights (intercept first), from one aggregate."""
    z, y = _logit(features, weights), F.col(label).cast("double")
    share = 1 / (1 + F.exp(-z))
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in features]]
    exprs = {"loss": F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)}
    exprs |= {f"g{i}": F.sum((share - y) * v) for i, v in enumerate(x)}
    if curved:
        exprs |= {f"h{i},{j}": F.sum(share * (1 - share) * x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)}
    s = fit(df, exprs)
    gradient = np.array([s[f"g{i}"] for i in range(len(x))])
    if not curved:
        return s["loss"], gradient, None
    return s["loss"], gradient, np.array([[s[f"h{max(i, j)},{min(i, j)}"] for j in range(len(x))] for i in range(len(x))])


def logistic_newton(df: DataFrame, features: Sequence[str], label: str, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights of least summed loss plus ``penalty / 2`` times the squared weights, the intercept left out.

    Every Newton step is one aggregate of d * d sums; a step that does not
    lower the loss is halved.
    """
    ridge = np.array([0.0, *[penalty] * len(features)])
    weights = np.zeros(len(ridge))
    best, step = math.inf, np.zeros(len(ridge))
    for _ in range(steps):
        loss, gradient, curve = logistic_sums(df, features, label, weights)
        total = loss + float((ridge * weights * weights).sum()) / 2
        if not total <= best + 1e-9 * abs(best):
            step = step / 2
            weights = weights - step
            continue
        gradient = gradient + ridge * weights
        # A constant feature leaves no curve besides the penalty; the pseudo-inverse takes the least step.
        step = -np.linalg.pinv(curve + np.diag(ridge), rcond=1e-14, hermitian=True) @ gradient
        if float(-gradient @ step) <= 1e-12 * max(1.0, abs(total)) or total == best:
            return weights
        best, weights = total, weights + step
    return weights


def logistic_fit(df: DataFrame, target: str, features: Sequence[str], key: str) -> LogisticResult:
    """Is the target above its median?  Features are mean-filled; L2 penalty with C = 1 on the summed loss."""
    _check(df, target, features)
    middle = fit(df.select(F.col(target).cast("double").alias(target)), quantiles={"m": (target, 0.5)})["m"]
    ready = fill_mean(df, features).withColumn("label", indicator_above(F.col(target), middle))
    train, test = split_train_test(ready, key)
    with cached_input(train.select("label", *features)) as held:
        if held.select("label").distinct().limit(2).count() < 2:
            raise ValueError(f"no value of {target!r} lies on one side of its median: a single class")
        intercept, *slopes = logistic_newton(held, features, "label").tolist()
    return LogisticResult(slopes, intercept, list(features), train, test)


def logistic_slopes(result: LogisticResult) -> DataFrame:
    """Derivative of the penalised loss by each weight at the fitted ones, per row and mean size of the feature; 0 at the optimum."""
    weights = [result.intercept, *result.coefficients]
    _, gradient, _ = logistic_sums(result.train, result.features, "label", weights, curved=False)
    scale = fit(result.train, {"n": F.count("*"), **{f"m{i}": F.avg(F.abs(f"`{c}`")) for i, c in enumerate(result.features)}})
    sizes = [1.0, *[scale[f"m{i}"] or 1.0 for i in range(len(result.features))]]
    pulled = gradient + np.array([0.0, *result.coefficients])
    rows = [(c, float(g / scale["n"] / s)) for c, g, s in zip(["const", *result.features], pulled, sizes)]
    return small_table(result.train.sparkSession, rows, "feature string, slope double")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: Sequence) -> DataFrame:
    """Counts, one row per actual class and one column per predicted class."""
    names = [f"predicted_{c}" for c in classes]
    counts = [F.count(F.when(F.col(predicted) == c, 1)).alias(n) for c, n in zip(classes, names)]
    met = df.where(F.col(actual).isin(*classes)).groupBy(F.col(actual).alias("actual")).agg(*counts)
    kind = df.schema[actual].dataType.simpleString()
    every = small_table(df.sparkSession, [(c,) for c in classes], f"actual {kind}")  # a class that never occurs has a row of zeros
    return every.join(met, "actual", "left").select("actual", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and two averages.

    Only the confusion counts leave the scan; the rest works on them.
    """
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    cells = cells.where(F.col("a").isNotNull() & F.col("p").isNotNull())
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("a").alias("c"), n.alias("actual"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("a") == F.col("p"), n).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("actual"), n.alias("guessed"),
                 F.lit(0).cast("long").alias("hit")),
    )
    per = cells.select(F.inline(sides)).groupBy("c").agg(
        F.sum("actual").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit")
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("guessed")), zero)
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("hit").cast("double"), F.col("guessed") + F.col("support")), zero)
    classes = per.select(
        F.col("c").cast("string").alias("class"), precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), "support", "hit",
    )
    scores = ("precision", "recall", "f1")
    overall = classes.agg(
        F.sum("hit").alias("hits"), F.sum("support").alias("support"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[(F.sum(F.col(s) * F.col("support")) / F.sum("support")).alias(f"weighted_{s}") for s in scores],
    )
    accuracy = F.col("hits") / F.col("support")
    lines = F.array(
        F.struct(F.lit("accuracy").alias("class"), *[accuracy.alias(s) for s in scores], "support"),
        *[
            F.struct(F.lit(f"{kind} avg").alias("class"), *[F.col(f"{kind}_{s}").alias(s) for s in scores], "support")
            for kind in ("macro", "weighted")
        ],
    )
    return classes.drop("hit").unionByName(overall.select(F.inline(lines)))


def coefficients(df: DataFrame, result: LogisticResult) -> DataFrame:
    """Feature and coefficient, largest first."""
    rows = [(f, float(c)) for f, c in zip(result.features, result.coefficients)]
    table = small_table(df.sparkSession, rows, "feature string, coefficient double")
    return table.orderBy(F.col("coefficient").desc())


# --- least squares ---------------------------------------------------------

def gram_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums of products of every column pair and the constant, from one aggregate."""
    named = {"const": F.lit(1.0), **{c: F.col(c).cast("double") for c in columns}}
    keys = list(named)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[: i + 1]]
    sums = df.agg(*[F.sum(named[a] * named[b]).alias(f"{a}|{b}") for a, b in pairs])
    entries = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}|{b}`").alias("s")) for a, b in pairs]
    return sums.select(F.inline(F.array(*entries)))


#: Triangles that one task, or the driver, puts together.
FAN_IN = 64
#: A scaled column whose rest is shorter than this depends on the others.
DEPENDENT = 1e-11


@dataclass
class OlsResult:
    """Least squares with a constant, whose parameters come first in every list."""

    features: list[str]
    target: str
    filled: DataFrame
    params: list[float]
    std_errors: list[float]
    n: int
    rank: int
    condition_number: float

    @property
    def names(self) -> list[str]:
        return ["const", *self.features]

    @property
    def freedom(self) -> int:
        return self.n - self.rank


def _triangles(df: DataFrame, width: int, parts: int) -> DataFrame:
    """(n, r): the triangular QR factor of each partition, combined in a tree until few are left."""
    kind = "n long, r array<double>"

    def out(n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["n", "r"])

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((width, width))
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            r = np.linalg.qr(np.vstack([r, np.column_stack([np.ones(batch.num_rows), *columns])]), mode="r")
            n += batch.num_rows
        if n:
            yield out(n, r)

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, r = 0, np.zeros((width, width))
        for batch in batches:
            found = np.asarray(batch.column(1).flatten()).reshape(-1, width)
            r = np.linalg.qr(np.vstack([r, found]), mode="r")
            n += sum(batch.column(0).to_pylist())
        if n:
            yield out(n, r)

    triangles = df.mapInArrow(of_rows, kind)
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        triangles = triangles.repartition(parts).mapInArrow(of_triangles, kind)
    return triangles


def pivoted_rank(r: np.ndarray, tolerance: float = DEPENDENT) -> int:
    """Rank of the columns, each scaled to length 1, by QR with column pivoting."""
    lengths = np.linalg.norm(r, axis=0)
    rest = r / np.where(lengths > 0, lengths, 1.0)
    rank = 0
    while rank < r.shape[1]:
        sizes = np.linalg.norm(rest, axis=0)
        pivot = int(sizes.argmax())
        if sizes[pivot] <= tolerance:
            break
        direction = rest[:, pivot] / sizes[pivot]
        for _ in range(2):  # the second turn removes what rounding left
            rest = rest - np.outer(direction, direction @ rest)
        rest[:, pivot] = 0.0
        rank += 1
    return rank


def ols_fit(df: DataFrame, target: str, features: Sequence[str]) -> OlsResult:
    """Least squares with a constant, by tall-skinny QR; target and features are mean-filled.

    Every partition reduces its rows to a triangle, and triangles are put
    together in a tree, so the squares of the values are never formed and one
    scan of any table ends in a matrix of the features' size.  Collinear and
    constant features get the solution of least norm, as a pseudo-inverse gives
    it; the rank is found on columns of equal length, so their units do not matter.
    A column without any value or a table without rows raises ValueError.
    """
    _check(df, target, features)
    features = list(features)
    filled = fill_mean(df, [*features, target])
    narrow = filled.select(*[F.col(f"`{c}`").cast("double").alias(f"__c{i}") for i, c in enumerate([*features, target])])
    width = len(features) + 2
    rows = _triangles(narrow, width, narrow.rdd.getNumPartitions()).collect()  # at most FAN_IN triangles
    if not rows:
        raise ValueError("least squares need at least one row")
    n = sum(r["n"] for r in rows)
    whole = np.linalg.qr(np.vstack([np.reshape(r["r"], (width, width)) for r in rows]), mode="r")
    if not np.isfinite(whole).all():
        raise ValueError(f"{[*features, target]} hold NaN, infinity or no value at all")
    r, z = whole[:-1, :-1], whole[:-1, -1]
    rank = pivoted_rank(r)
    lengths = np.linalg.norm(r, axis=0)
    if rank == r.shape[1]:  # on columns of equal length, so that units cost no digits
        inverse = np.linalg.inv(r / lengths) / lengths[:, None]
    else:
        u, size, v = np.linalg.svd(r)
        inverse = (v[:rank].T / size[:rank]) @ u[:, :rank].T
    params = inverse @ z
    ssr = float(whole[-1, -1] ** 2 + ((z - r @ params) ** 2).sum())
    variance = ssr / (n - rank) if n > rank else math.nan
    errors = np.sqrt(variance * (inverse**2).sum(axis=1))
    condition = float(np.linalg.cond(r)) if rank == r.shape[1] else math.inf
    return OlsResult(features, target, filled, params.tolist(), errors.tolist(), n, rank, condition)


def ols_residuals(result: OlsResult) -> DataFrame:
    """The rows with ``fitted`` and ``residual``, as plain column arithmetic."""
    const, *slopes = result.params
    fitted: Column = F.lit(const)
    for c, b in zip(result.features, slopes):
        fitted = fitted + F.lit(b) * F.col(c)
    return result.filled.withColumn("fitted", fitted).withColumn("residual", F.col(result.target) - F.col("fitted"))


def ols_coefficients(result: OlsResult, confidence: float = 0.95) -> DataFrame:
    """Coefficient, error, t, p and interval per feature, smallest p first."""
    freedom = result.freedom
    reach = student_quantile(0.5 + confidence / 2, freedom) if freedom > 0 else math.nan
    rows = []
    for name, b, e in zip(result.names, result.params, result.std_errors):
        known = e > 0  # false for nan, which an exact fit of as many rows as ranks gives
        t = b / e if known else math.nan
        p = student_two_sided(t, freedom) if known else math.nan
        rows.append((name, b, e, t, p, b - reach * e, b + reach * e))
    schema = "feature string, coefficient double, std_error double, t double, p_value double, low double, high double"
    return small_table(result.filled.sparkSession, rows, schema).orderBy("p_value", "feature")


def _normal_from_skew(skew: float, n: int) -> float:
    """Standard score of the sample skewness (D'Agostino)."""
    y = skew * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    b2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    a = math.sqrt(2 / (w2 - 1))
    return math.asinh(y / a) / math.sqrt(0.5 * math.log(w2))


def _normal_from_kurtosis(kurtosis: float, n: int) -> float:
    """Standard score of the sample kurtosis (Anscombe and Glynn)."""
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurtosis - mean) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    cube = (1 - 2 / a) / (1 + x * math.sqrt(2 / (a - 4)))
    return (1 - 2 / (9 * a) - math.copysign(abs(cube) ** (1 / 3), cube)) / math.sqrt(2 / (9 * a))


def residual_moments(df: DataFrame, residual: str, order: str | None = None, buckets: int | None = None) -> dict:
    """Sums behind the residual tests; Durbin-Watson needs a row order."""
    e = F.col(residual)
    exprs = {"n": F.count(e), "ssr": F.sum(e * e), "skew": F.skewness(e), "kurtosis": F.kurtosis(e) + 3}
    if order is not None:
        df = with_previous(df.select(order, residual), residual, order, buckets=buckets, name="__previous")
        gap = e - F.col("__previous")
        exprs["turns"] = F.sum(gap * gap)
    s = fit(df, exprs)
    s["durbin_watson"] = s["turns"] / s["ssr"] if order is not None and s["ssr"] else None
    return s


def ols_summary(result: OlsResult, order: str | None = None, buckets: int | None = None) -> DataFrame:
    """The numbers of a regression report as (name, value) rows."""
    moments = residual_moments(ols_residuals(result), "residual", order, buckets)
    spread = fit(result.filled, {"v": F.var_pop(result.target)})["v"]
    n, p, ssr = moments["n"], result.rank, moments["ssr"]
    k, freedom = p - 1, n - p
    tss = n * spread
    r2 = 1 - ssr / tss if tss else math.nan
    f = ((tss - ssr) / k) / (ssr / freedom) if ssr and k and freedom > 0 else math.inf
    log_lik = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1) if ssr else math.inf
    skew, kurt = (math.nan if moments[m] is None else moments[m] for m in ("skew", "kurtosis"))
    jarque_bera = n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
    omnibus = _normal_from_skew(skew, n) ** 2 + _normal_from_kurtosis(kurt, n) ** 2 if n >= 8 else math.nan
    rows = {
        "n": float(n), "df_model": float(k), "df_resid": float(freedom), "r2": r2,
        "r2_adjusted": 1 - (1 - r2) * (n - 1) / freedom if freedom > 0 else math.nan, "f": f,
        "f_p_value": f_upper(f, k, freedom) if k and freedom > 0 else math.nan,
        "log_likelihood": log_lik, "aic": 2 * p - 2 * log_lik, "bic": p * math.log(n) - 2 * log_lik,
        "skew": skew, "kurtosis": kurt, "jarque_bera": jarque_bera,
        "jarque_bera_p_value": chi_square_2_upper(jarque_bera), "omnibus": omnibus,
        "omnibus_p_value": chi_square_2_upper(omnibus), "condition_number": result.condition_number,
    }
    if moments["durbin_watson"] is not None:
        rows["durbin_watson"] = moments["durbin_watson"]
    return small_table(result.filled.sparkSession, [(k, float(v)) for k, v in rows.items()], "name string, value double")
