"""Walk-forward modelling on per-month sufficient statistics.

A linear model needs no rows, only sums: each month gives one packed Gram matrix (n, sums, squares, products), and every train
window, fold and half-sample is a sum of months. The data are read once whatever the number of years, penalties and
folds; what comes to the driver is months times features squared.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.operators.cross import demean, winsorize, zscore


def split_rows(df: DataFrame, test_years: Iterable[int], label: str, last: str, month: str = "target_month") -> DataFrame:
    """``df`` once for each test year it takes part in, with ``test_year`` and ``split``: train before the two validation years (rows
    with a label), valid for 24 months, test for the year up to ``last``."""
    year = F.explode(F.array(*[F.lit(int(y)) for y in test_years]))
    t, y = F.col(month), F.col("test_year")
    start = lambda back: F.make_date(y - back, F.lit(1), F.lit(1))
    split = F.when((t < start(2)) & F.col(label).isNotNull(), "train").when((t >= start(2)) & (t < start(0)), "valid").when((t >= start(0)) & (t < start(-1)) & (t <= F.lit(last).cast("date")), "test")
    return df.withColumn("test_year", year).withColumn("split", split).where(F.col("split").isNotNull())


def with_target(df: DataFrame, label: str, month: str = "target_month", tail: float = 0.01, into: str = "target") -> DataFrame:
    """``into``: the label less its month's mean, clipped at the ``tail`` quantiles of the demeaned month."""
    return df.withColumn(into, demean(label, [month])).withColumn(into, winsorize(into, [month], tail))


class Gram:
    """Sums over rows of a design with features x and label y."""

    def __init__(self, n: float, sx: np.ndarray, sy: float, xx: np.ndarray, xy: np.ndarray, yy: float):
        self.n, self.sx, self.sy, self.xx, self.xy, self.yy = n, sx, sy, xx, xy, yy

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.n + other.n, self.sx + other.sx, self.sy + other.sy, self.xx + other.xx, self.xy + other.xy, self.yy + other.yy)

    def mapped(self, t: np.ndarray) -> Gram:
        """The sums of the design whose features are ``t`` times these."""
        return Gram(self.n, t @ self.sx, self.sy, t @ self.xx @ t.T, t @ self.xy, self.yy)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        mx, my = self.sx / self.n, self.sy / self.n
        return self.xx - self.n * np.outer(mx, mx), self.xy - self.n * mx * my

    def sse(self, w: np.ndarray, b: float) -> float:
        return float(self.yy - 2 * (w @ self.xy + b * self.sy) + w @ self.xx @ w + 2 * b * (w @ self.sx) + self.n * b * b)

    def intercept(self, w: np.ndarray) -> float:
        return float(self.sy / self.n - w @ self.sx / self.n)


def month_grams(df: DataFrame, features: Sequence[str], label: str, month: str = "target_month") -> dict:
    """One :class:`Gram` per month, from rows with all features and a label. Partial sums leave the map tasks as one row per
    month, so the shuffle is months times features squared whatever the number of rows."""
    p = len(features)
    known = F.col(label).isNotNull()
    for c in features:
        known = known & F.col(c).isNotNull()
    rows = df.where(known).select(F.col(month).alias("m"), F.col(label).cast("double").alias("y"), *[F.col(c).cast("double") for c in features])

    def sums(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(p + 1)], 1) if b.num_rows else np.empty((0, p + 1))
            z = np.concatenate([np.ones((len(x), 1)), x], 1)
            months = b.column(0).cast(pa.int32()).to_numpy(zero_copy_only=False) if b.num_rows else np.empty(0, int)
            for m in np.unique(months):
                q = z[months == m]
                total[int(m)] = total.get(int(m), 0) + q.T @ q
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.ravel().tolist() for t in total.values()], pa.list_(pa.float64()))], names=["m", "s"])

    parts = rows.mapInArrow(sums, "m int, s array<double>")
    cells = parts.select("m", F.posexplode("s").alias("at", "v")).groupBy("m", "at").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in cells.groupBy("m").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("s")).orderBy("m").collect():
        t = np.array(r["s"]).reshape(p + 2, p + 2)
        day = np.datetime64("1970-01-01") + np.timedelta64(r["m"], "D")
        out[str(day)] = Gram(t[0, 0], t[0, 2:], t[0, 1], t[2:, 2:], t[2:, 1], t[1, 1])
    return out


def total(grams: Iterable[Gram]) -> Gram:
    out = None
    for g in grams:
        out = g if out is None else out + g
    if out is None:
        raise ValueError("no months")
    return out


def ridge(g: Gram, alpha: float) -> tuple[np.ndarray, float]:
    """Minimises |y - Xw - b|^2 + alpha |w|^2; ordinary least squares for alpha 0."""
    xx, xy = g.centred()
    w = np.linalg.lstsq(xx + alpha * np.eye(len(xy)), xy, rcond=None)[0]
    return w, g.intercept(w)


def elastic_net(g: Gram, alpha: float, l1: float = 1.0, start: np.ndarray | None = None, rounds: int = 1000, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Minimises |y - Xw - b|^2 / 2n + alpha (l1 |w|_1 + (1 - l1) |w|^2 / 2) by coordinate descent on the Gram matrix."""
    xx, xy = (a / g.n for a in g.centred())
    w = np.zeros(len(xy)) if start is None else start.copy()
    scale = np.diag(xx) + alpha * (1 - l1)
    for _ in range(rounds):
        moved = 0.0
        for j in np.flatnonzero(scale > 0):
            rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / scale[j]
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tolerance:
            break
    return w, g.intercept(w)


def tune(train: Gram, valid: Gram, family: str, alphas: Sequence[float], l1: float = 0.5) -> dict:
    """The penalty of least validation error (ties: the first), with the fit on train and that on both."""
    best = None
    for a in alphas:
        fit = ridge if family in ("ols", "ridge") else (lambda g, a: elastic_net(g, a, 1.0 if family == "lasso" else l1))
        a = 0.0 if family == "ols" else a
        w, b = fit(train, a)
        error = valid.sse(w, b) / valid.n
        if best is None or error < best["mse"] - 1e-15:
            best = {"family": family, "alpha": a, "mse": error, "fit": fit}
        if family == "ols":
            break
    w, b = best.pop("fit")(train + valid, best["alpha"])
    return best | {"weights": w, "intercept": b}


def linear(features: Sequence[str], w: np.ndarray, b: float) -> Column:
    out = F.lit(float(b))
    for c, x in zip(features, w):
        out = out + F.col(c) * F.lit(float(x))
    return out


def blend(columns: Sequence[str]) -> Column:
    """Mean of columns that are already on one scale."""
    total_ = F.lit(0.0)
    for c in columns:
        total_ = total_ + F.col(c)
    return total_ / len(columns)


def blends(df: DataFrame, specialists: Sequence[str], text: Sequence[str], forecasts: Sequence[str], trees: str, month: str = "eom") -> DataFrame:
    """``df`` with the four equal-weight blends: ``pred_ew``, the mean of the specialists' z-scores within the month; ``pred_ew_notext``, that
    without the text specialists; ``pred_ew_ret``, the mean of the raw forecasts, unknown ones as 0; ``pred_blend``, the mean of the
    z-scores of ``pred_ew`` and of the tree model ``trees``. Unknown z-scores count as 0."""
    z = [f"z_{c}" for c in specialists]
    out = df.withColumns({f"z_{c}": zscore(c, [month]) for c in specialists})
    out = out.withColumns({"pred_ew": blend(z), "pred_ew_notext": blend([f"z_{c}" for c in specialists if c not in text])})
    total_ = F.lit(0.0)
    for c in forecasts:
        total_ = total_ + F.coalesce(F.col(c), F.lit(0.0))
    out = out.withColumn("pred_ew_ret", total_ / len(forecasts))
    return out.withColumn("pred_blend", (zscore("pred_ew", [month]) + zscore(trees, [month])) / 2).drop(*z)


def gate_design(signals: Sequence[str], states: Sequence[str]) -> dict[str, Column]:
    """Signals and their products with standardised states."""
    out = {s: F.col(s) for s in signals}
    return out | {f"{s}_x_{m}": F.col(s) * F.col(m) for s in signals for m in states}


def standardised(signals: int, means: Sequence[float], deviations: Sequence[float]) -> np.ndarray:
    """What turns the sums of :func:`gate_design` with raw states into those with states less their means over their deviations (0 as
    1): a gate for other months needs no further pass over the rows."""
    k, j = signals, len(means)
    t = np.eye(k * (1 + j))
    for s in range(k):
        for m in range(j):
            row, sd = k + s * j + m, deviations[m] or 1.0
            t[row, row], t[row, s] = 1 / sd, -means[m] / sd
    return t


def fit_gate(grams: dict, alphas: Sequence[float] | None = None, folds: int = 6) -> tuple[np.ndarray, float]:
    """Ridge without a constant, its penalty chosen by folds of whole months; every fold is a difference of month sums."""
    months = sorted(grams)
    n = total(grams.values()).n
    alphas = [n * a for a in np.logspace(-3, 2, 11)] if alphas is None else alphas
    folds = max(2, min(folds, len(months)))

    def solve(g: Gram, a: float) -> np.ndarray:
        return np.linalg.solve(g.xx + a * np.eye(len(g.xy)), g.xy)

    parts = [total(grams[m] for i, m in enumerate(months) if i % folds == f) for f in range(folds)]
    rests = [total(grams[m] for i, m in enumerate(months) if i % folds != f) for f in range(folds)]
    error = [sum(p.sse(solve(q, a), 0.0) for p, q in zip(parts, rests)) for a in alphas]
    a = float(alphas[int(np.argmin(error))])
    return solve(total(grams.values()), a), a


def stability(grams: dict, alpha: float, reps: int = 20, share: float = 0.5, seed: int = 42) -> np.ndarray:
    """How often the lasso keeps each feature over ``reps`` random halves of the months."""
    months, rng = sorted(grams), np.random.default_rng(seed)
    kept = 0
    for _ in range(reps):
        some = rng.choice(len(months), max(1, int(len(months) * share)), replace=False)
        w, _ = elastic_net(total(grams[months[i]] for i in some), alpha)
        kept = kept + (np.abs(w) > 1e-12)
    return kept / reps


def boosted_trees(train: DataFrame, features: Sequence[str], label: str, depth: int = 3, rounds: int = 20, seed: int = 42):
    """Gradient-boosted regression trees of Spark's library."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    points = VectorAssembler(inputCols=list(features), outputCol="features").transform(train)
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", maxDepth=depth, maxIter=rounds, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.5", seed=seed).fit(points)

