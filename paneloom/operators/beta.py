"""Estimates of one slow quantity from several noisy columns: calibration, precision-weighted fusion, filtering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneloom.functions.columns import month_number
from paneloom.operators.cross import clip, percent_rank, zscore


def shrunk(value: str, shrink: float = 0.33, missing: float = 1.0) -> Column:
    """(1 - shrink) * value + shrink; null gives ``missing``."""
    return F.coalesce(F.col(value) * (1 - shrink) + shrink, F.lit(missing))


def chained(first: str, second: str, volatility: str, group: Sequence[str], weights: tuple[float, float] = (0.6, 0.4), missing: float = 1.25, line: tuple[float, float, float] = (0.31, 0.56, 0.25)) -> Column:
    """First known of a clipped and shrunk estimator, another one and a constant, on a line with the volatility's percentile rank."""
    base = F.coalesce(clip(first, -1.0, 4.0) * weights[0] + weights[1], F.col(second) * 0.67 + 0.33, F.lit(missing))
    return base * line[1] + line[0] + percent_rank(volatility, group) * line[2]


@dataclass
class Calibration:
    """Line, clip bounds and error variance of each estimator; the prior's coefficients and variance; the pull towards it."""

    estimators: dict[str, tuple[float, float, float, float, float]] = field(default_factory=dict)  # a, b, low, high, variance
    prior: dict[str, float] = field(default_factory=dict)
    prior_variance: float = 1.0
    phi: float = 0.8
    q: float = 0.3

    def calibrated(self, name: str) -> Column:
        a, b, lo, hi, _ = self.estimators[name]
        return clip(name, lo, hi) * b + a

    def prior_mean(self) -> Column:
        out = F.lit(self.prior["constant"])
        for c, w in self.prior.items():
            if c == "constant":
                continue
            name, _, level = c.partition("=")
            out = out + (F.when(F.col(name) == level, w).otherwise(0.0) if level else F.col(name) * w)
        return out


def prior_features(df: DataFrame, group: str = "eom") -> DataFrame:
    """``ivp, size_z, age_c, lev_c``: percentile rank of volatility, z-score of log size, and age and leverage clipped at their 1 and
    99 % quantiles (nulls their median)."""
    bounds = df.agg(*[F.percentile(c, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99))).alias(c) for c in ("age", "at_be")]).first()
    out = df.withColumn("_log_me", F.log("me")).withColumn("ivp", percent_rank("ivol_capm_252d", [group])).withColumn("size_z", zscore("_log_me", [group])).drop("_log_me")
    for c, name in (("age", "age_c"), ("at_be", "lev_c")):
        lo, mid, hi = bounds[c] or (0.0, 0.0, 0.0)
        out = out.withColumn(name, F.coalesce(clip(c, lo, hi), F.lit(mid)))
    return out


def calibrate(df: DataFrame, target: str, estimators: Sequence[str], features: Sequence[str] = ("ivp", "size_z", "age_c", "lev_c"), category: str = "gics2", entity: str = "permno", time: str = "eom") -> Calibration:
    """Fits everything on the rows of ``df``: each estimator's line to ``target`` after clipping at 1 and 99 %, the prior regression with
    dummies (alphabetically first level as reference), and the yearly autoregression of what the prior leaves. Only sums come to the driver."""
    out = Calibration()
    known = df.where(F.col(target).isNotNull())
    for e in estimators:
        both = known.where(F.col(e).isNotNull())
        lo, hi = both.agg(F.percentile(e, F.array(F.lit(0.01), F.lit(0.99))).alias("q")).first()["q"] or (None, None)
        if lo is None:
            continue
        x = clip(e, lo, hi)
        row = both.select(x.alias("x"), F.col(target).alias("y")).agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.count("x").alias("n")).first()
        sse = row["syy"] - row["sxy"] ** 2 / row["sxx"] if row["sxx"] else row["syy"]
        out.estimators[e] = (row["a"] or 0.0, row["b"] or 0.0, lo, hi, max(sse / max(row["n"] - 2, 1), 1e-6))
    levels = sorted(r[0] for r in known.select(category).distinct().collect() if r[0] is not None)
    columns = {**{f: F.col(f).cast("double") for f in features}, **{f"{category}={v}": F.when(F.col(category) == v, 1.0).otherwise(0.0) for v in levels[1:]}}
    out.prior, out.prior_variance = regression(known, target, columns)
    left = known.withColumn("_dev", F.col(target) - out.prior_mean())
    w = Window.partitionBy(entity).orderBy(time)
    pairs = left.select("_dev", F.when(month_number(F.lag(time, 12).over(w)) == month_number(time) - 12, F.lag("_dev", 12).over(w)).alias("_old"))
    both = F.col("_old").isNotNull()
    s = pairs.agg(F.sum(F.when(both, F.col("_dev") * F.col("_old"))).alias("xy"), F.sum(F.when(both, F.col("_old") * F.col("_old"))).alias("xx"), F.count("_old").alias("n"), F.var_samp("_dev").alias("v")).first()
    if s["n"] >= 30 and s["xx"]:
        out.phi = float(np.clip(s["xy"] / s["xx"], 0.01, 0.98)) ** (1 / 12)
        out.q = max(s["v"] * (1 - out.phi**2), 1e-6)
    else:
        out.phi, out.q = 0.8, 0.3 * out.prior_variance
    return out


def regression(df: DataFrame, target: str, columns: dict[str, Column]) -> tuple[dict[str, float], float]:
    """Least squares with a constant from one aggregate of all products; coefficients and residual variance."""
    names = list(columns)
    z = df.select(F.lit(1.0).alias("z0"), *[c.alias(f"z{i + 1}") for i, c in enumerate(columns.values())], F.col(target).cast("double").alias("y"))
    z = z.na.drop()
    k = len(names) + 1
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = z.agg(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}_{j}") for i, j in cells], *[F.sum(F.col(f"z{i}") * F.col("y")).alias(f"b{i}") for i in range(k)], F.sum(F.col("y") * F.col("y")).alias("yy")).first()
    xx, xy = np.zeros((k, k)), np.array([row[f"b{i}"] or 0.0 for i in range(k)])
    for i, j in cells:
        xx[i, j] = xx[j, i] = row[f"c{i}_{j}"] or 0.0
    w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    sse = (row["yy"] or 0.0) - 2 * w @ xy + w @ xx @ w
    return {"constant": float(w[0]), **{n: float(x) for n, x in zip(names, w[1:])}}, float(max(sse / max(xx[0, 0] - k, 1), 1e-6))


def fuse(c: Calibration) -> tuple[Column, Column]:
    """Precision-weighted mean of the prior and the known calibrated estimators, and its variance."""
    total, weight = c.prior_mean() / c.prior_variance, F.lit(1 / c.prior_variance)
    for e, (*_, variance) in c.estimators.items():
        x = c.calibrated(e)
        total = total + F.coalesce(x / variance, F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), 1 / variance).otherwise(0.0)
    return total / weight, 1 / weight


def kalman(df: DataFrame, c: Calibration, entity: str = "permno", time: str = "eom") -> DataFrame:
    """``entity, time, beta, beta_var``: along each entity's rows the deviation from the prior decays by phi and is corrected by the known
    estimators. One step per row, gaps included. An entity's rows are one per month, so a group is a few hundred rows."""
    observed = F.lit(0.0), F.lit(0.0)
    total, weight = observed
    for e, (*_, variance) in c.estimators.items():
        x = c.calibrated(e)
        total = total + F.coalesce(x / variance, F.lit(0.0))
        weight = weight + F.when(x.isNotNull(), 1 / variance).otherwise(0.0)
    rows = df.select(entity, time, c.prior_mean().alias("m"), total.alias("s"), weight.alias("p"))
    schema = T.StructType([df.schema[entity], df.schema[time], T.StructField("beta", T.DoubleType()), T.StructField("beta_var", T.DoubleType())])
    phi, q, start = c.phi, c.q, c.prior_variance

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(time, kind="stable")
        m, s, p = (g[x].to_numpy() for x in ("m", "s", "p"))
        mean, var = np.empty(len(g)), np.empty(len(g))
        for i in range(len(g)):
            x, v = (m[i], start) if i == 0 else (m[i] + phi * (mean[i - 1] - m[i - 1]), phi * phi * var[i - 1] + q)
            gain = v * p[i] / (v * p[i] + 1)
            mean[i], var[i] = x + (gain * (s[i] / p[i] - x) if p[i] > 0 else 0.0), (1 - gain) * v
        return pd.DataFrame({entity: g[entity], time: g[time], "beta": mean, "beta_var": var})

    return rows.groupBy(entity).applyInPandas(run, schema)


#: Models by name, and whether they need a calibration.
MODELS = {"blume": False, "a15": False, "fusion": True, "kalman": True}


def estimate(df: DataFrame, model: str, calibration: Calibration | None = None, first: str = "betabab_1260d", second: str = "beta_60m", volatility: str = "ivol_capm_252d", entity: str = "permno", time: str = "eom") -> DataFrame:
    """``entity, time, beta, beta_var`` by the model of a name: the shrunk estimate ("blume"), the chain of two estimators on a line
    ("a15"), both with a variance of 0, the precision-weighted "fusion" and the "kalman" filter, which need a ``calibration``."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}: one of {', '.join(MODELS)}")
    if MODELS[model] and calibration is None:
        raise ValueError(f"{model} needs a calibration")
    if model == "kalman":
        return kalman(df, calibration, entity, time)
    certain = F.lit(0.0)
    value, variance = {"blume": lambda: (shrunk(second), certain), "a15": lambda: (chained(first, second, volatility, [time]), certain), "fusion": lambda: fuse(calibration)}[model]()
    return df.select(entity, time, value.alias("beta"), variance.alias("beta_var"))


def accuracy(df: DataFrame, models: Sequence[str], target: str) -> DataFrame:
    """``model, n, r2, bias`` of estimates against the target, by model."""
    long = df.where(F.col(target).isNotNull()).unpivot([target], list(models), "model", "estimate").where("estimate is not null")
    mean = F.avg(target).over(Window.partitionBy("model"))
    long = long.withColumn("_m", mean)
    return long.groupBy("model").agg(F.count(F.lit(1)).alias("n"), (1 - F.sum(F.pow(F.col(target) - F.col("estimate"), 2)) / F.nullif(F.sum(F.pow(F.col(target) - F.col("_m"), 2)), F.lit(0.0))).alias("r2"), F.avg(F.col("estimate") - F.col(target)).alias("bias"))
