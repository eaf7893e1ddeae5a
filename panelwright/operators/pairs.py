"""Pair statistics: spreads, co-integration, half life, Kalman hedge ratio.  Pairs are groups; each pair's series is small."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import ratio
from .factors import register_factor


def pair_prices(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair, code_a, code_b, date, log_a, log_b on the dates that both have.  pairs: pair, code_a, code_b."""
    close = data.select("date", "code", F.log("close").alias("l")).dropDuplicates(["date", "code"])
    a, b = close.select("date", F.col("code").alias("code_a"), F.col("l").alias("log_a")), close.select("date", F.col("code").alias("code_b"), F.col("l").alias("log_b"))
    return pairs.join(a, "code_a").join(b, ["code_b", "date"])


def spread(prices: DataFrame, beta: float | None = None) -> DataFrame:
    """Adds spread = log a - beta * log b; beta by least squares with an intercept (which is not taken off)."""
    by = Window.partitionBy("pair")
    slope = F.lit(float(beta)) if beta is not None else ratio(F.covar_pop("log_a", "log_b").over(by), F.var_pop("log_b").over(by))
    return prices.withColumn("beta", slope).withColumn("spread", F.col("log_a") - F.col("beta") * F.col("log_b"))


def spread_zscore(spreads: DataFrame, window: int = 20) -> DataFrame:
    """Adds zscore over the last window rows; 0 where it has none."""
    w = Window.partitionBy("pair").orderBy("date").rowsBetween(-(window - 1), 0)
    z = ratio(F.col("spread") - F.avg("spread").over(w), F.stddev_samp("spread").over(w))
    return spreads.withColumn("zscore", F.when(F.count("spread").over(w) == window, F.coalesce(z, F.lit(0.0))).otherwise(0.0))


def half_life(spreads: DataFrame, window: int = 60) -> DataFrame:
    """pair, half_life: from the regression of changes on levels without intercept over the last window changes; null if not reverting."""
    by = Window.partitionBy("pair").orderBy("date")
    back = F.row_number().over(Window.partitionBy("pair").orderBy(F.col("date").desc()))
    rows = spreads.filter("spread is not null").withColumns({"x": F.lag("spread").over(by), "k": back, "n": F.count("*").over(Window.partitionBy("pair"))})
    s = rows.filter((F.col("k") <= window) & (F.col("n") > window) & F.col("x").isNotNull())
    lam = s.groupBy("pair").agg(ratio(F.sum((F.col("spread") - F.col("x")) * F.col("x")), F.sum(F.col("x") * F.col("x"))).alias("lam"))
    return spreads.select("pair").distinct().join(lam, "pair", "left").select("pair", F.when(F.col("lam") < 0, -math.log(2) / F.col("lam")).alias("half_life"))


def kalman(log_a: np.ndarray, log_b: np.ndarray, q: float = 1e-5, r: float = 1e-3) -> np.ndarray:
    """Scalar random-walk hedge ratio, started from the first ten points' regression with variance 1."""
    k = min(10, len(log_a))
    beta = np.linalg.lstsq(np.column_stack([log_b[:k], np.ones(k)]), log_a[:k], rcond=None)[0][0] if k else 0.0
    var, out = 1.0, np.zeros(len(log_a))
    for t, (a, b) in enumerate(zip(log_a, log_b)):
        ahead = var + q
        gain = ahead * b / (ahead * b * b + r)
        beta += gain * (a - beta * b)
        var = (1 - gain * b) * ahead
        out[t] = beta
    return out


def kalman_betas(prices: DataFrame, q: float = 1e-5, r: float = 1e-3) -> DataFrame:
    """pair, date, beta."""

    def run(pdf):
        pdf = pdf.sort_values("date")
        return pdf[["pair", "date"]].assign(beta=kalman(pdf["log_a"].to_numpy(), pdf["log_b"].to_numpy(), q, r))

    return prices.select("pair", "date", "log_a", "log_b").groupBy("pair").applyInPandas(run, f"pair {dict(prices.dtypes)['pair']}, date date, beta double")


#: MacKinnon's published response surface for the unit-root t statistic with a constant, one series.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


#: Terms of the series of erf: at 6, beyond which its complement is under 1e-16, the rest of 120 terms lies below the last bit.
ERF_TERMS, ERF_END = 120, 6.0


def normal_cdf(x: Column) -> Column:
    """Share of the normal distribution below x, to 1e-15: erf(z) = 2 / sqrt(pi) * exp(-z * z) * (z + 2 z^3 / 3 + 4 z^5 / 15 + ...)."""
    z = F.greatest(F.least(x / math.sqrt(2), F.lit(ERF_END)), F.lit(-ERF_END))
    zero = F.lit(0.0)
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(ERF_TERMS)),
        F.struct(z.alias("term"), z.alias("total")),
        lambda s, k: F.struct((s["term"] * 2 * z * z / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * 2 * z * z / (2 * k + 1)).alias("total")),
        lambda s: s["total"],
    )
    return F.greatest(zero, F.least(F.lit(1.0), 0.5 + F.exp(-z * z) * terms / math.sqrt(math.pi)))


def unit_root_pvalue(tau: Column) -> Column:
    def surface(coef):
        return sum((c * F.pow(tau, F.lit(float(k))) for k, c in enumerate(coef[1:], 1)), F.lit(coef[0]))

    return F.when(tau > TAU_MAX, 1.0).when(tau < TAU_MIN, 0.0).when(tau.isNotNull(), normal_cdf(F.when(tau <= TAU_STAR, surface(TAU_SMALL)).otherwise(surface(TAU_LARGE))))


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once: inside lambdas the optimizer would put its expression wherever it is read."""
    return F.transform(F.array(x), f)[0]


def _swept(m: Column) -> Column:
    """A symmetric matrix without its first row and column, their regression taken out of the rest."""
    return F.transform(F.slice(m, 2, F.size(m) - 1), lambda row: F.transform(F.slice(row, 2, F.size(row) - 1), lambda x, c: x - ratio(row[0] * m[0][c + 1], m[0][0])))


def unit_roots(series: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, tau, lags, n_obs: augmented Dickey-Fuller with a constant; the lag order is that of least AIC up to 12 * (n / 100) ** (1/4), all on
    the rows that the longest leaves.  tau is null for series that are too short or that a regressor describes without rest.

    Cross products of [y, 1, level, lagged changes] are summed by series, map-side first.  Regressors are swept out of that matrix one after the other:
    what is left of y's own cell after each is the residual sum of one more lag, so one sweep gives every order's AIC.  The chosen order has a few
    more rows than the longest; their vectors (at most that many a series) are kept aside and added.
    """
    at, whole = Window.partitionBy(*by).orderBy("date"), Window.partitionBy(*by)
    rows = series.filter(F.col(value).isNotNull()).select(*by, "date", F.col(value).alias("x")).withColumns({"n": F.count("*").over(whole), "t": F.row_number().over(at) - 1, "y": F.lead("x").over(at) - F.col("x")})
    longest = series.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    reach = max(1, math.ceil(12 * (longest / 100) ** 0.25))
    top = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int")
    before = F.reverse(F.collect_list("y").over(at.rowsBetween(-reach, -1)))
    rows = rows.withColumns({"top": top, "lagged": before}).filter("y is not null and top >= 0")
    rows = rows.select(*by, "n", "top", "t", F.concat(F.array("y", F.lit(1.0), "x"), F.slice("lagged", F.lit(1), F.col("top"))).alias("v"))

    left = rows.filter("t >= top").select(*by, "v", F.posexplode("v").alias("i", "a")).select(*by, "i", "a", F.posexplode(F.slice("v", F.col("i") + 1, F.size("v"))).alias("j", "b"))
    cells = left.groupBy(*by, "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "j", "g"))).alias("cells")).select(*by, F.transform("cells", lambda c: c["g"]).alias("g"))
    early = rows.groupBy(*by, "n", "top").agg(F.collect_list(F.when(F.col("t") < F.col("top"), F.struct("t", "v"))).alias("early"))
    both = cells.join(early, by)

    def cell(p, q):  # the upper triangle lies row by row
        lo, hi, m = F.least(p, q), F.greatest(p, q), F.col("top") + 3
        return F.col("g")[(lo * m - (lo * (lo - 1) / 2).cast("int") + hi - lo).cast("int")]

    def upto(k):
        return F.when(k > 0, F.sequence(F.lit(3), k + 2)).otherwise(F.array().cast("array<int>"))

    def matrix(order, more=lambda s, p, q: s):
        return _bound(order, lambda o: F.transform(o, lambda p: F.transform(o, lambda q: more(cell(p, q), p, q))))

    def rests(m):  # y's cell after each regressor
        def step(s, _):
            return _bound(_swept(s["m"]), lambda m: F.struct(m.alias("m"), F.concat(s["rest"], F.array(F.element_at(F.element_at(m, -1), -1))).alias("rest")))

        return F.aggregate(F.sequence(F.lit(1), F.col("top") + 2), F.struct(m.alias("m"), F.array().cast("array<double>").alias("rest")), step, lambda s: s["rest"])

    used = F.col("n") - 1 - F.col("top")

    def aic(rest, k):
        ssr = F.nullif(F.greatest(rest[k + 1], F.lit(0.0)), F.lit(0.0))
        return F.struct(F.coalesce(used * (math.log(2 * math.pi) + F.ln(ssr / used) + 1) + 2 * (k + 2), F.lit(float("inf"))).alias("aic"), k.alias("k"))

    everything = matrix(F.concat(F.array(F.lit(1), F.lit(2)), upto(F.col("top")), F.array(F.lit(0))))
    least = F.array_min(_bound(rests(everything), lambda rest: F.transform(F.sequence(F.lit(0), F.col("top")), lambda k: aic(rest, k))))
    both = both.withColumn("lags", least["k"])
    chosen = F.concat(F.array(F.lit(1)), upto(F.col("lags")), F.array(F.lit(2), F.lit(0)))
    added = F.filter("early", lambda e: e["t"] >= F.col("lags"))
    final = _bound(added, lambda rows: matrix(chosen, lambda s, p, q: F.aggregate(rows, s, lambda s, e: s + e["v"][p] * e["v"][q])))
    both = both.withColumn("m", F.aggregate(F.sequence(F.lit(1), F.col("lags") + 1), final, lambda m, _: _swept(m)))
    xx, xy, yy = F.col("m")[0][0], F.col("m")[0][1], F.col("m")[1][1]
    left_over = F.greatest(yy - ratio(xy * xy, xx), F.lit(0.0)) / F.nullif(F.col("n") - 1 - F.col("lags") - (F.col("lags") + 2), F.lit(0))
    return both.select(*by, ratio(ratio(xy, xx), F.sqrt(ratio(left_over, xx))).alias("tau"), "lags", F.col("n").alias("n_obs"))


def cointegration(prices: DataFrame, min_obs: int = 60) -> DataFrame:
    """pair, pvalue, tau, lags, n_obs: unit root of the residuals of log a on log b.  The p-value is 1 for under min_obs rows (tau and lags are null
    then) or where tau is undefined, and 0 for constant residuals.
    """
    by = Window.partitionBy("pair")
    slope = F.coalesce(ratio(F.covar_pop("log_a", "log_b").over(by), F.var_pop("log_b").over(by)), F.lit(0.0))
    rows = prices.filter("log_a is not null and log_b is not null").select("pair", "date", "log_a", "log_b")
    rest = rows.withColumn("slope", slope).withColumn("rest", F.col("log_a") - F.avg("log_a").over(by) - F.col("slope") * (F.col("log_b") - F.avg("log_b").over(by)))
    size = rest.groupBy("pair").agg(F.count("*").alias("n_obs"), F.stddev_pop("rest").alias("sd"))
    known = size.withColumn("enough", (F.col("n_obs") >= min_obs) & (F.col("sd") >= 1e-12))
    tested = unit_roots(rest.join(known.filter("enough").select("pair"), "pair", "left_semi"), "rest", ["pair"]).drop("n_obs")
    p = F.when(F.col("n_obs") < min_obs, 1.0).when(F.col("sd") < 1e-12, 0.0).otherwise(F.coalesce(unit_root_pvalue(F.col("tau")), F.lit(1.0)))
    return known.join(tested, "pair", "left").select("pair", p.alias("pvalue"), "tau", "lags", "n_obs")


for _name, _func in (("calc_spread", spread), ("calc_spread_zscore", spread_zscore), ("calc_coint_pvalue", cointegration), ("calc_half_life", half_life), ("kalman_filter_hedge_ratio", kalman_betas)):
    register_factor(_name, _func, ("pair", "cointegration"), kind="pair")
