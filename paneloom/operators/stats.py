"""Statistics as aggregates: information coefficients, explained variance, regressions, multiple testing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paneloom.operators.cross import average_rank


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation as an aggregate; null if a side does not vary. Both must be null together."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def monthly_ic(df: DataFrame, prediction: str, outcome: str, group: Sequence[str], least: int = 5) -> DataFrame:
    """``group, n, ic``: Spearman correlation per group over rows that know both; null below ``least`` rows."""
    both = df.where(F.col(prediction).isNotNull() & F.col(outcome).isNotNull())
    ranked = both.select(*group, average_rank(prediction, group).alias("_p"), average_rank(outcome, group).alias("_o"))
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), safe_corr("_p", "_o").alias("_ic")).withColumn("ic", F.when(F.col("n") >= least, F.col("_ic"))).drop("_ic")


def t_stat(value: str) -> Column:
    """Mean over its standard error, as an aggregate; null for fewer than two values."""
    return F.avg(value) / F.nullif(F.stddev_samp(value) / F.sqrt(F.count(value)), F.lit(0.0))


def oos_r2(prediction: Column | str, outcome: Column | str) -> Column:
    """1 - sum (y - f)^2 / sum y^2 over rows that know both: the forecast against zero, as an aggregate."""
    p, y = (F.col(c) if isinstance(c, str) else c for c in (prediction, outcome))
    return 1 - F.sum(F.pow(y - p, 2)) / F.nullif(F.sum(F.when(p.isNotNull(), y * y)), F.lit(0.0))


def ratio(mean: Column, sd: Column, periods: int = 12, tiny: float = 1e-8) -> Column:
    """Annualised mean over deviation; null for a deviation below ``tiny``."""
    return F.when(sd >= tiny, mean / F.nullif(sd, F.lit(0.0)) * math.sqrt(periods))


def simple_ols(x: str, y: str) -> list[Column]:
    """Aggregates ``n, slope, intercept, residual_variance`` (divisor n - 2) of y on x."""
    sse = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.nullif(F.regr_sxx(y, x), F.lit(0.0))
    n = F.regr_count(y, x)
    return [n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (sse / F.nullif(n - 2, F.lit(0))).alias("residual_variance")]


def newey_west(df: DataFrame, x: str, y: str, order: str, group: Sequence[str] = (), lags: int = 3) -> DataFrame:
    """``group, n, alpha, beta, alpha_se, beta_se, alpha_se_hac, beta_se_hac`` of y on x with a constant: ordinary and
    autocorrelation-robust errors (Bartlett weights, no small-sample factor). The meat of the sandwich is three sums per
    lag over products of neighbouring residual terms, so the series is windowed once and then aggregated."""
    whole = Window.partitionBy(*group)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = rows.withColumns({"b": F.covar_pop("y", "x").over(whole) / F.nullif(F.var_pop("x").over(whole), F.lit(0.0)), "mx": F.avg("x").over(whole), "my": F.avg("y").over(whole)})
    rows = rows.withColumn("a", F.col("my") - F.col("b") * F.col("mx")).withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    rows = rows.withColumns({"u": F.col("e"), "v": F.col("e") * F.col("x")})
    w = Window.partitionBy(*group).orderBy(order)
    for k in range(1, lags + 1):
        rows = rows.withColumns({f"u{k}": F.lag("u", k).over(w), f"v{k}": F.lag("v", k).over(w)})
    lit, weight = F.lit, {k: 1 - k / (lags + 1) for k in range(1, lags + 1)}
    uu, uv, vv = F.sum(F.col("u") * F.col("u")), F.sum(F.col("u") * F.col("v")), F.sum(F.col("v") * F.col("v"))
    for k, wk in weight.items():
        uu = uu + lit(2 * wk) * F.coalesce(F.sum(F.col("u") * F.col(f"u{k}")), lit(0.0))
        uv = uv + lit(wk) * F.coalesce(F.sum(F.col("u") * F.col(f"v{k}") + F.col("v") * F.col(f"u{k}")), lit(0.0))
        vv = vv + lit(2 * wk) * F.coalesce(F.sum(F.col("v") * F.col(f"v{k}")), lit(0.0))
    s = rows.groupBy(*group).agg(F.count(lit(1)).alias("n"), F.first("a").alias("alpha"), F.first("b").alias("beta"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("e") * F.col("e")).alias("see"), uu.alias("uu"), uv.alias("uv"), vv.alias("vv"))
    # Inverse of X'X: [[sxx, -sx], [-sx, n]] / det
    det = F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), lit(0.0))
    i00, i01, i11 = F.col("sxx") / det, -F.col("sx") / det, F.col("n") / det
    s2 = F.col("see") / F.nullif(F.col("n") - 2, lit(0))
    sandwich = lambda p, q: p * p * F.col("uu") + 2 * p * q * F.col("uv") + q * q * F.col("vv")
    return s.select(*group, "n", "alpha", "beta", F.sqrt(s2 * i00).alias("alpha_se"), F.sqrt(s2 * i11).alias("beta_se"), F.sqrt(sandwich(i00, i01)).alias("alpha_se_hac"), F.sqrt(sandwich(i01, i11)).alias("beta_se_hac"))


def normal_cdf(x: np.ndarray | float) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))(x)


def normal_cdf_column(x: Column | str) -> Column:
    """Standard normal distribution function in the JVM, by the rational approximation 26.2.17 of Abramowitz and Stegun
    (absolute error below 7.5e-8)."""
    x = F.col(x) if isinstance(x, str) else x
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def benjamini_hochberg(df: DataFrame, p_value: str, q: float = 0.1, tie: str = "feature") -> DataFrame:
    """``df`` with ``bh_rank`` and ``selected``: all hypotheses up to the largest rank k with p <= k / n * q. Null p-values count
    in n and are never selected. One row per hypothesis is sorted in one task: thousands, not rows of data."""
    w = Window.orderBy(F.round(p_value, 12).asc_nulls_last(), tie)  # to twelve digits, as summation order must not decide
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = df.withColumn("bh_rank", F.row_number().over(w))
    last = F.max(F.when(F.col(p_value) <= F.col("bh_rank") / n * q, F.col("bh_rank"))).over(Window.partitionBy())
    return ranked.withColumn("selected", F.coalesce((F.col("bh_rank") <= last) & F.col(p_value).isNotNull(), F.lit(False)))
